"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_score, toxicity
from .bpe_codec import digests
from .decontaminate import contaminated
from .jaccard_join import similarity_classes
from .language_id import fit, held_out, identify
from .permutation_index import nearest
from .substring_dedup import deduplicate
from .token_counts import token_counts
from .url_filter import Rule, judge

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.predict(docs, toxicity.fit(docs, marks, ["low_quality", "toxic"]))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


#: The rules of the url query.
RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM page
), rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
links AS (
  SELECT regexp_extract(url, '^([^#]*)', 1) AS a, url, unnest(regexp_extract_all(html, '(?i)(<link\b[^>]*>|<meta\b[^>]*>)', 1)) AS link FROM page
  WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')
), target AS (
  SELECT a, url, replace(regexp_extract(link, '(?i)(?:\bhref\s*=\s*|\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*)["'']?\s*([^"''>\s]+)', 1), '&amp;', '&') AS t FROM links
  WHERE regexp_matches(link, '(?i)rel\s*=\s*["'']?canonical\b|http-equiv\s*=\s*["'']?refresh\b')
), edge AS (
  SELECT a, regexp_extract(CASE WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^/?#]*:)', 1) || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || t ELSE t END, '^([^#]*)', 1) AS b
  FROM target WHERE t <> ''
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON r.m = e.a),
urls AS (SELECT regexp_extract(url, '^([^#]*)', 1) AS n, host, path FROM split WHERE url IS NOT NULL),
ruled AS (
  SELECT u.n, arg_max(rverdict, length(rhost || rpath)) AS v FROM urls u JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY u.n
), carried AS (SELECT reach.n, min(v) AS v FROM reach JOIN ruled ON reach.m = ruled.n GROUP BY reach.n),
own AS (
  SELECT s.page_id, s.url, s.host, s.path, (SELECT arg_max(struct_pack(r := rhost || rpath, v := rverdict), length(rhost || rpath)) FROM rules WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS hit FROM split s
)
SELECT page_id, host, path, hit.r AS rule, coalesce(hit.v, CASE WHEN c.v = 'block' THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN carried c ON c.n = regexp_extract(own.url, '^([^#]*)', 1)
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 7)
    return lm_score.score(docs, lm_score.fit(docs.where(~out))).withColumn("held_out", out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, md5(text) AS dg, regexp_extract_all(translate(text, {ABC}), '[^\x20\x09-\x0D]+') AS ws FROM documents
), u AS (
  SELECT dg, min(doc_id) AS first_id, count(*) AS copies, any_value(ws) AS ws FROM d WHERE dg IS NOT NULL GROUP BY dg
), s AS (
  SELECT DISTINCT dg, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT dg, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM u WHERE len(ws) > 0)
), z AS (SELECT dg, count(*) AS n FROM s GROUP BY dg),
p AS (SELECT a.dg AS a, b.dg AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.dg <> b.dg GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN z za ON za.dg = p.a JOIN z zb ON zb.dg = p.b WHERE 9 * p.c >= 4 * (za.n + zb.n)),
reach(a, m) AS (SELECT dg, dg FROM u UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.m),
cls AS (SELECT reach.a AS dg, min(u.first_id) AS class_id FROM reach JOIN u ON u.dg = reach.m GROUP BY 1),
k AS (SELECT l.a AS dg, sum(u.copies) AS links FROM l JOIN u ON u.dg = l.b GROUP BY 1)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, (coalesce(k.links, 0) + coalesce(u.copies, 1) - 1)::BIGINT AS n_links, coalesce(u.copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN u USING (dg) LEFT JOIN cls USING (dg) LEFT JOIN k USING (dg)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
ig AS (SELECT item_id, len(ws) AS n, i - 1 AS pos, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
dg AS (SELECT doc_id, len(ws) AS dn, i - 1 AS pos, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
w AS (SELECT DISTINCT dg.doc_id, ig.n, dn, greatest(0, least(dg.pos - ig.pos, dn - ig.n)) AS start FROM dg JOIN ig USING (g)),
wg AS (SELECT w.doc_id, w.n, w.start, least(w.n, w.dn) - 4 AS size, dg.g, count(*) AS c FROM w JOIN dg ON dg.doc_id = w.doc_id AND dg.pos BETWEEN w.start AND w.start + least(w.n, w.dn) - 5 GROUP BY ALL),
it AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
m AS (SELECT wg.doc_id, it.item_id, wg.n, wg.start, any_value(wg.size) AS size, sum(least(wg.c, it.c)) AS inter FROM wg JOIN it ON it.n = wg.n AND it.g = wg.g GROUP BY ALL),
r AS (SELECT *, inter / (size + n - 4 - inter) AS similarity FROM m WHERE inter >= 0.8 * (size + n - 4 - inter))
SELECT doc_id, item_id, start::INTEGER AS word_start, n::INTEGER AS n_words, similarity FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i, i AS hit FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
c AS (SELECT t.doc_id, t.i, t.word, max(r.hit) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(s.n, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_lm_score": op9_lm_score,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op4_decontaminate": OP4_SQL, "op6_url_filter": OP6_SQL, "op10_substring_dedup": OP10_SQL}
