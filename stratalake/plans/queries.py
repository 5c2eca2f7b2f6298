"""A query for each operator, with the same result in SQL."""

from __future__ import annotations

import datetime as dt
import decimal

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import transforms
from ..functions.expr import FALSE, TRUE, Bool, Compiler, Expr, Registry, and_, builtin, call, col, keep, lit, not_, or_
from ..operators import encodings, manifests, snapshots
from ..operators.schema import identity
from ..operators.log import Log
from ..operators.table import Table
from ..operators.txn import WRITE_SERIALIZABLE, ReadSet, conflict
from ..sources import avro, files
from ..streaming.feeds import append_stream, change_stream, windowed
from . import prune, stats
from .workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


DAY = dt.datetime(1998, 1, 1)
ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# -- scans and predicates --------------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(spark, d):
    return files.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


def _filter(name: str, table: str, columns: str, predicate: Expr, where: str) -> None:
    @query(f"SELECT {columns} FROM {table} WHERE {where}", name)
    def run(spark, d):
        return files.scan(spark, f"{d}/{table}.parquet", columns.split(", "), predicate)


_filter("filter_compare", "orders", ORDER, (col("o_orderdate") >= lit(DAY)) & (col("o_totalprice") > 100000.0) & (col("o_totalprice") <= 300000.0) & (col("o_custkey") < 1000) & (col("o_orderstatus") != "P") & (col("o_orderpriority") == "2-HIGH"), "o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 100000 AND o_totalprice <= 300000 AND o_custkey < 1000 AND o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH'")
_filter("filter_col_vs_col", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", (col("l_partkey") < col("l_suppkey")) | (col("l_discount") == col("l_tax")), "l_partkey < l_suppkey OR l_discount = l_tax")
_filter("filter_literal_left", "lineitem", "l_orderkey, l_linenumber, l_quantity", lit(45.0) < col("l_quantity"), "45 < l_quantity")
_filter("filter_starts_with", "part", "p_partkey, p_name", col("p_name").starts_with("red"), "starts_with(p_name, 'red')")
_filter("filter_not_starts_with", "part", "p_partkey, p_name", not_(col("p_name").starts_with("red")), "NOT starts_with(p_name, 'red')")
_filter("filter_in", "orders", "o_orderkey, o_orderpriority", col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("filter_not_in", "orders", "o_orderkey, o_orderpriority", col("o_orderpriority").not_in("1-URGENT", "2-HIGH"), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_filter("boolean_folding", "orders", "o_orderkey, o_totalprice", and_(TRUE, or_(FALSE, not_(not_(col("o_totalprice") > 200000.0))), not_(FALSE)), "o_totalprice > 200000")


def _nullable(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("st"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("pr"))


NULLABLE = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st, nullif(o_orderpriority, '5-LOW') AS pr FROM orders)"


@query(f"SELECT o_orderkey, st IS NOT DISTINCT FROM NULL AS is_null, st IS NOT DISTINCT FROM 'F' AS is_f, st IS NOT DISTINCT FROM pr AS same FROM {NULLABLE}")
def filter_null_safe_eq(spark, d):
    df = _nullable(spark, d)
    c = Compiler(df.schema).column
    return df.select("o_orderkey", c(col("st").same(None)).alias("is_null"), c(col("st").same("F")).alias("is_f"), c(col("st").same(col("pr"))).alias("same"))


@query(f"SELECT o_orderkey, st FROM {NULLABLE} WHERE st IS NULL OR pr IS NOT NULL")
def filter_null_checks(spark, d):
    return keep(_nullable(spark, d), col("st").is_null() | col("pr").is_not_null()).select("o_orderkey", "st")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN false ELSE isnan(v) END AS nan, CASE WHEN v IS NOT NULL THEN NOT isnan(v) END AS not_nan FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS v FROM lineitem)")
def filter_nan_checks(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN NULL ELSE l_tax END").alias("v"))
    c = Compiler(df.schema).column
    return df.select("l_orderkey", "l_linenumber", c(col("v").is_nan()).alias("nan"), c(col("v").is_not_nan()).alias("not_nan"))


@query(f"SELECT o_orderkey, st IN ('F', NULL) AS inside, st NOT IN ('F', NULL) AS outside, CASE WHEN st IS NOT NULL THEN false END AS nothing FROM {NULLABLE}")
def in_list_with_null(spark, d):
    df = _nullable(spark, d)
    c = Compiler(df.schema).column
    return df.select("o_orderkey", c(col("st").isin("F", None)).alias("inside"), c(col("st").not_in("F", None)).alias("outside"), c(col("st").isin()).alias("nothing"))


@query(f"SELECT o_orderkey, (a AND b) AS both, (a OR b) AS one, NOT a AS neither FROM (SELECT o_orderkey, st = 'F' AS a, pr = '2-HIGH' AS b FROM {NULLABLE})")
def kleene_and_or_not(spark, d):
    df = _nullable(spark, d)
    c, a, b = Compiler(df.schema).column, col("st") == "F", col("pr") == "2-HIGH"
    return df.select("o_orderkey", c(a & b).alias("both"), c(a | b).alias("one"), c(~a).alias("neither"))


@query("SELECT o_orderkey, o_totalprice > 150000 AND o_orderstatus = 'F' AS flag FROM orders")
def predicate_as_value(spark, d):
    df = read(spark, d, "orders")
    return df.select("o_orderkey", Compiler(df.schema).column((col("o_totalprice") > 150000.0) & (col("o_orderstatus") == "F")).alias("flag"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS up, year(o_orderdate)::INT AS yr, substring(o_orderpriority, 3, 4) AS sub, coalesce(nullif(o_orderstatus, 'P'), '?') AS st, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE month(o_orderdate) = 3")
def function_registry(spark, d):
    df = read(spark, d, "orders")
    c = Compiler(df.schema, builtin()).column
    own = {"up": call("upper", col("o_orderpriority")), "yr": call("year", col("o_orderdate")), "sub": call("substring", col("o_orderpriority"), 3, 4), "st": call("coalesce", call("nullif", col("o_orderstatus"), "P"), "?"), "size": call("case", col("o_totalprice") > 200000.0, "big", "small")}
    return keep(df, call("month", col("o_orderdate")) == 3, builtin()).select("o_orderkey", *[c(x).alias(n) for n, x in own.items()])


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount))::BIGINT AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def function_udf(spark, d):
    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    own = Registry()
    own.register("net", net, "double")
    df = read(spark, d, "lineitem")
    value = call("net", col("l_extendedprice"), col("l_discount"))
    out = df.select("l_orderkey", "l_linenumber", Compiler(df.schema, own).column(value).alias("v"))
    return out.where("v > 50000").select("l_orderkey", "l_linenumber", F.floor("v").alias("net"))


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(12,2))::VARCHAR AS price, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders")
def expr_target_type(spark, d):
    df = read(spark, d, "orders")
    c = Compiler(df.schema)
    return df.select("o_orderkey", c.column(col("o_totalprice"), T.DecimalType(12, 2)).cast("string").alias("price"), c.column(col("o_orderdate"), T.DateType()).cast("string").alias("day"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber = 3 AS int_long, l_linenumber > 2.5 AS int_double, l_linenumber >= 2.00 AS int_decimal, CAST(NULL AS BOOLEAN) AS int_string, l_shipdate >= DATE '1998-06-01' AS ts_date FROM lineitem")
def cross_type_compare(spark, d):
    df = read(spark, d, "lineitem")
    c = Compiler(df.schema).column
    n = col("l_linenumber")
    own = {"int_long": n == lit(3, "bigint"), "int_double": n > 2.5, "int_decimal": n >= decimal.Decimal("2.00"), "int_string": n == "3", "ts_date": col("l_shipdate") >= dt.date(1998, 6, 1)}
    return df.select("l_orderkey", "l_linenumber", *[c(x).alias(k) for k, x in own.items()])


@query("SELECT o_orderkey, s.price AS price, s.inner.status AS status, a[2] AS second, m['p'] AS p FROM (SELECT o_orderkey, {'price': o_totalprice, 'inner': {'status': o_orderstatus}} AS s, [o_orderstatus, o_orderpriority] AS a, MAP {'p': o_orderpriority} AS m FROM orders)")
def nested_project(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderstatus").alias("status")).alias("inner")).alias("s"), F.array("o_orderstatus", "o_orderpriority").alias("a"), F.create_map(F.lit("p"), "o_orderpriority").alias("m"))
    c = Compiler(df.schema).column
    return df.select("o_orderkey", c(col("s.price")).alias("price"), c(col("s.inner.status")).alias("status"), F.element_at("a", 2).alias("second"), F.element_at("m", "p").alias("p"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def variant_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


# -- statistics and pruning ------------------------------------------------------------------------------------------------------------
@query("SELECT c_mktsegment AS unit, count(*) AS num_records, min(c_acctbal) AS min_bal, max(c_acctbal) AS max_bal, min(c_name) AS min_name, max(c_name) AS max_name, count(*) - count(nullif(c_nationkey, 3)) AS nulls FROM customer GROUP BY 1")
def file_stats(spark, d):
    df = read(spark, d, "customer").withColumn("n", F.expr("nullif(c_nationkey, 3)"))
    s = stats.unit_stats(df, "c_mktsegment", ["c_acctbal", "c_name", "n"])
    return s.select("unit", "num_records", F.col("min.c_acctbal").alias("min_bal"), F.col("max.c_acctbal").alias("max_bal"), F.col("min.c_name").alias("min_name"), F.col("max.c_name").alias("max_name"), F.col("null_count.n").alias("nulls"))


ZONED = "(SELECT *, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000)::BIGINT AS zone, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS position FROM orders)"


def _zoned(spark, d, rows: int = 1000) -> DataFrame:
    return stats.zones(read(spark, d, "orders"), ["o_orderkey"], rows)


@query(f"WITH z AS {ZONED}, m AS (SELECT *, lag(o_custkey) OVER (PARTITION BY zone ORDER BY position) AS b FROM z) SELECT zone, count(*) AS num_records, min(o_custkey) AS min_value, max(o_custkey) AS max_value, sum(o_custkey)::BIGINT AS sum_value, count(*) - count(o_custkey) AS null_count, 0::BIGINT AS nan_count, min(o_custkey) = max(o_custkey) AS is_constant, count(*) FILTER (WHERE b > o_custkey) = 0 AS is_sorted, count(*) FILTER (WHERE b >= o_custkey) = 0 AS is_strict_sorted FROM m GROUP BY zone")
def zone_stats(spark, d):
    return stats.zone_stats(_zoned(spark, d), "o_custkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS num_records, count(DISTINCT {c}) AS n_distinct, min({c})::BIGINT AS min_value, max({c})::BIGINT AS max_value, count(*) - count({c}) AS null_count, count(DISTINCT {c}) <= 1 AS is_constant, ceil(log2(max({c}) - min({c}) + 1))::BIGINT AS bit_width FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_linenumber")))
def column_profile(spark, d):
    return stats.column_profile(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_values, count(DISTINCT {c}) <= 0.2 * count({c}) AS is_candidate FROM customer" for c in ("c_name", "c_mktsegment")))
def dictionary_candidates(spark, d):
    return stats.dictionary_candidates(read(spark, d, "customer"), ["c_name", "c_mktsegment"])


ZONE_KEYS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "flag", "p"]
ZONE_SQL = "WITH z AS (SELECT zone, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) - count(flag) AS fn, min(flag) AS flo, max(flag) AS fhi, min(p) AS plo, max(p) AS phi, count(*) - count(p) AS pn FROM (SELECT *, CASE WHEN zone % 3 = 1 THEN NULL WHEN zone % 3 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS flag, CASE WHEN zone % 4 = 0 THEN 'ab' || (o_orderkey % 7) WHEN zone % 4 = 1 THEN 'ac' ELSE o_orderpriority END AS p FROM " + ZONED + ") GROUP BY zone) SELECT zone, {} AS verdict FROM z"


def _zone_frame(spark, d) -> DataFrame:
    return _zoned(spark, d).withColumn("flag", F.expr("CASE WHEN zone % 3 = 1 THEN NULL WHEN zone % 3 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END")).withColumn("p", F.expr("CASE WHEN zone % 4 = 0 THEN concat('ab', o_orderkey % 7) WHEN zone % 4 = 1 THEN 'ac' ELSE o_orderpriority END"))


def _verdict(name: str, predicate: Expr, case: str) -> None:
    @query(ZONE_SQL.format(case), name)
    def run(spark, d):
        df = _zone_frame(spark, d)
        s = stats.unit_stats(df, "zone", ZONE_KEYS)
        return prune.verdicts(s, predicate, {f.name: f.dataType for f in df.schema.fields}).select(F.col("unit").alias("zone"), "verdict")


_verdict("prune_eq", col("o_orderkey") == 5500, "CASE WHEN 5500 < lo OR 5500 > hi THEN 0 WHEN lo = 5500 AND hi = 5500 THEN 2 ELSE 1 END")
_verdict("prune_ne", col("p") != "ac", "CASE WHEN plo = 'ac' AND phi = 'ac' THEN 0 WHEN ('ac' < plo OR 'ac' > phi) AND pn = 0 THEN 2 ELSE 1 END")
_verdict("prune_range", (col("o_orderkey") >= 3000) & (col("o_orderkey") < 7500), "least(CASE WHEN hi < 3000 THEN 0 WHEN lo >= 3000 THEN 2 ELSE 1 END, CASE WHEN lo >= 7500 THEN 0 WHEN hi < 7500 THEN 2 ELSE 1 END)")
_verdict("prune_in", col("o_orderkey").isin(10, 5500, 999999), "greatest(CASE WHEN 10 < lo OR 10 > hi THEN 0 ELSE 1 END, CASE WHEN 5500 < lo OR 5500 > hi THEN 0 ELSE 1 END, 0)")
_verdict("prune_null", col("flag").is_null(), "CASE WHEN fn = 0 THEN 0 WHEN fn = n THEN 2 ELSE 1 END")
_verdict("prune_null_safe", col("flag").same(None), "CASE WHEN fn = 0 THEN 0 WHEN fn = n THEN 2 ELSE 1 END")
_verdict("prune_all_null", col("flag") >= 0, "CASE WHEN fn = n THEN 0 WHEN flo >= 0 AND fn = 0 THEN 2 ELSE 1 END")
_verdict("prune_prefix", col("p").starts_with("ab"), "CASE WHEN phi < 'ab' OR (plo > 'ab' AND NOT starts_with(plo, 'ab')) THEN 0 WHEN starts_with(plo, 'ab') AND starts_with(phi, 'ab') THEN 2 ELSE 1 END")
_verdict("prune_boolean", or_(not_(col("o_orderkey") < 12000), (col("o_orderkey") == 17) & Bool(True)), "greatest(CASE WHEN hi < 12000 THEN 0 WHEN lo >= 12000 THEN 2 ELSE 1 END, CASE WHEN 17 < lo OR 17 > hi THEN 0 ELSE 1 END)")
_verdict("prune_literal_left", lit(5000) > col("o_orderkey"), "CASE WHEN lo >= 5000 THEN 0 WHEN hi < 5000 THEN 2 ELSE 1 END")
_verdict("prune_unknown", (col("o_orderkey") == col("o_custkey")) | (col("o_orderkey") < 0), "1")


#: Bytes of files read for each range of keys.
RANGE_BYTES = 8 << 20


def _ranged(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows of a scan in ranges of the keys: ``n``, or more if the scan reads more than ``n`` times `RANGE_BYTES`, so that tasks don't grow with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartitionByRange(max(n, -(-size // RANGE_BYTES)), *keys)


def _table(spark: SparkSession, df: DataFrame, name: str, n: int | None = None, keys: tuple[str, ...] = (), **more) -> Table:
    """A table with the rows, in ``n`` or more files of ranges of the keys."""
    t = Table.create(spark, new_folder(spark, name), df.schema, **more)
    t.append(_ranged(df, n, *keys) if n else df)
    return t


@query("SELECT o_orderstatus AS part, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS verdict FROM orders GROUP BY 1")
def prune_partition(spark, d):
    t = _table(spark, read(spark, d, "orders"), "part", 1, ("o_orderkey",), partition_by=["o_orderstatus"])
    return t.candidate_files(col("o_orderstatus") == "F").select(F.col("partitionValues")["o_orderstatus"].alias("part"), "verdict").distinct()


FLAGSHIP = and_(col("o_orderdate") >= lit(dt.datetime(1997, 3, 1)), col("o_orderdate") < lit(dt.datetime(1997, 9, 1)), col("o_totalprice") > 150000.0, col("o_orderstatus").isin("F", "O"))
FLAGSHIP_SQL = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-09-01' AND o_totalprice > 150000 AND o_orderstatus IN ('F', 'O')"


@query(FLAGSHIP_SQL)
def pruned_scan(spark, d):
    t = _table(spark, read(spark, d, "orders"), "pruned", 8, ("o_orderdate",))
    return t.scan(["o_orderkey", "o_totalprice"], FLAGSHIP)


@query(f"WITH z AS {ZONED}, s AS (SELECT zone, count(*) FILTER (WHERE o_orderkey BETWEEN 2500 AND 4200) AS m, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM z GROUP BY zone) SELECT count(*) AS files_total, count(*) FILTER (WHERE hi >= 2500 AND lo <= 4200) AS files_scanned, count(*) FILTER (WHERE hi < 2500 OR lo > 4200) AS files_skipped, sum(m)::BIGINT AS rows_matched FROM s")
def iceberg_plan(spark, d):
    df = _zoned(spark, d)
    p = (col("o_orderkey") >= 2500) & (col("o_orderkey") <= 4200)
    v = prune.verdicts(stats.unit_stats(df, "zone", ["o_orderkey"]), p, {"o_orderkey": T.LongType()})
    hit = keep(df, p).agg(F.count(F.lit(1)).alias("rows_matched"))
    return v.agg(F.count(F.lit(1)).alias("files_total"), F.count_if(F.col("verdict") > 0).alias("files_scanned"), F.count_if(F.col("verdict") == 0).alias("files_skipped")).crossJoin(hit)


@query(f"SELECT 'zone-' || zone AS path, n AS num_records, CASE WHEN lo >= 2500 AND hi <= 5200 THEN 2 ELSE 1 END AS verdict, CASE WHEN zone % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_deletes FROM (SELECT zone, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {ZONED} GROUP BY zone) WHERE hi >= 2500 AND lo <= 5200 AND zone <> 3")
def manifest_plan(spark, d):
    """Files of a snapshot that may hold a renamed column's range: zone 3 was removed, even zones have a file of positions, and of two files of equal rows only the later applies."""
    m = manifests.Manifests(spark, new_folder(spark, "manifests"))
    df = _zoned(spark, d)
    zone = F.concat(F.lit("zone-"), F.col("zone"))
    names = [m.add(manifests.data_entries(df.select("o_orderkey", zone.alias("_file")), "_file", {"o_orderkey": 1}, 1))]
    even = df.where("zone % 2 = 0").select(zone.alias("target")).distinct()
    names.append(m.add(even.select(F.concat(F.lit("positions-"), "target").alias("path"), F.lit(manifests.POSITIONS).alias("content"), F.lit(2).alias("sequence"), "target")))
    equal = spark.createDataFrame([("equal-1", manifests.EQUALITY, 1, False), ("equal-3", manifests.EQUALITY, 3, False), ("zone-3", manifests.DATA, 4, True)], "path string, content string, sequence long, removed boolean")
    names.append(m.add(equal))
    found = manifests.plan(m.entries(names), (col("key") >= 2500) & (col("key") <= 5200), {"key": T.LongType()}, {"key": 1})
    return found.select("path", "num_records", "verdict", F.size("deletes").cast("long").alias("n_deletes"))


@query(f"SELECT DISTINCT zone FROM {ZONED} WHERE o_custkey IN (77, 555, 1234)")
def bloom_candidates(spark, d):
    df, values = _zoned(spark, d), [77, 555, 1234]
    may = prune.bloom_units(df, "zone", "o_custkey", values).where("may_contain").select(F.col("unit").alias("zone"))
    return df.join(may, "zone", "left_semi").where(F.col("o_custkey").isin(values)).select("zone").distinct()


@query(f"SELECT o_custkey AS value, zone AS unit, position AS row_offset FROM {ZONED} WHERE o_custkey = 42")
def index_eq(spark, d):
    return prune.index_table(_zoned(spark, d), "o_custkey", "zone", "position").where("value = 42")


@query(f"SELECT o_custkey AS value, zone AS unit, position AS row_offset FROM {ZONED} WHERE o_custkey BETWEEN 40 AND 60")
def index_range(spark, d):
    return prune.index_table(_zoned(spark, d), "o_custkey", "zone", "position").where("value between 40 and 60")


@query(f"SELECT o_orderstatus AS value, count(DISTINCT zone) AS n_units, min(zone) AS first_unit FROM {ZONED} GROUP BY 1")
def bitmap_index(spark, d):
    return prune.bitmap_table(_zoned(spark, d), "o_orderstatus", "zone").select("value", F.size("units").cast("long").alias("n_units"), F.element_at("units", 1).alias("first_unit"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 9) AND o_orderkey < 9000")
def index_prune_scan(spark, d):
    df = _zoned(spark, d)
    p = col("o_custkey").isin(5, 9) & (col("o_orderkey") < 9000)
    units = prune.index_units({"o_custkey": prune.index_table(df, "o_custkey", "zone", "position")}, p)
    return keep(df.join(units, df.zone == units.unit, "left_semi"), p).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 1000")
def row_range_slice(spark, d):
    return _table(spark, read(spark, d, "orders"), "slice", 3, ("o_orderkey",)).row_range(1000, 250, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, (zone << 40) | (position - zone * 1000) AS row_id FROM {ZONED}")
def row_id_encode(spark, d):
    return _zoned(spark, d).select("o_orderkey", F.shiftleft("zone", 40).bitwiseOR(F.col("position") - F.col("zone") * 1000).alias("row_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def point_read_by_rowid(spark, d):
    t = _table(spark, read(spark, d, "orders"), "points", 4, ("o_orderkey",))
    ids = t.scan(["o_custkey"], row_ids=True).where("o_custkey = 7").select("row_id")
    return t.read_by_row_ids(ids).select("o_orderkey", "o_totalprice")


# -- table writes ----------------------------------------------------------------------------------------------------------------------
@query(f"SELECT {ORDER} FROM orders")
def append_table(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey % 3 = 0"), "append")
    t.append(o.where("o_orderkey % 3 <> 0"))
    return t.scan()


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey % 3 <> 0")
def overwrite_table(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey % 3 = 0"), "overwrite")
    t.overwrite(o.where("o_orderkey % 3 <> 0"))
    return t.scan()


PARTS = "SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 5000"


@query(f"SELECT {ORDER} FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' UNION ALL {PARTS})")
def static_partition_overwrite(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o, "static", partition_by=["o_orderstatus"])
    t.overwrite_partitions(o.where("o_orderstatus = 'F' and o_orderkey < 5000").withColumn("o_totalprice", F.col("o_totalprice") * 2), {"o_orderstatus": "F"})
    return t.scan()


@query(f"SELECT {ORDER} FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' UNION ALL {PARTS})")
def dynamic_partition_overwrite(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o, "dynamic", partition_by=["o_orderstatus"])
    t.dynamic_overwrite(o.where("o_orderstatus = 'F' and o_orderkey < 5000").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    return t.scan()


def _three(spark, d, name: str, **more) -> Table:
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey < 5000"), name, **more)
    t.append(o.where("o_orderkey between 5000 and 9999"))
    t.append(o.where("o_orderkey >= 10000"))
    return t


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey < 10000")
def time_travel_version(spark, d):
    return _three(spark, d, "travel").scan(version=2)


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey < 10000")
def time_travel_timestamp(spark, d):
    t = _three(spark, d, "travel")
    at = next(a["commitInfo"]["inCommitTimestamp"] for a in t.log.actions_of(2) if "commitInfo" in a)
    return t.scan(timestamp_ms=at)


@query("SELECT * FROM (VALUES (0::BIGINT, 'CREATE TABLE'), (1, 'WRITE'), (2, 'WRITE'), (3, 'WRITE'), (4, 'DELETE')) AS h(version, operation)")
def table_history(spark, d):
    t = _three(spark, d, "history")
    t.delete(col("o_orderkey") < 10)
    return t.history().select("version", "operation")


@query("SELECT path, version FROM (SELECT 'f' || (user_id % 50) AS path, event_id AS version, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def log_replay(spark, d):
    e = read(spark, d, "events")
    one, add = F.struct(F.concat(F.lit("f"), F.col("user_id") % 50).alias("path")), F.col("event_type") != "error"
    actions = e.select(F.when(add, one).alias("add"), F.when(~add, one).alias("remove"), F.col("event_id").alias("version"))
    return Log.active(actions).select("path", "version")


DELETED = (col("o_totalprice") > 250000.0) & (col("o_orderstatus") == "F")


@query(f"SELECT {ORDER} FROM orders WHERE (o_totalprice > 250000 AND o_orderstatus = 'F') IS NOT TRUE")
def delete_predicate(spark, d):
    t = _three(spark, d, "delete")
    t.delete(DELETED)
    return t.scan()


@query(f"SELECT {ORDER} FROM orders WHERE NOT (o_custkey < 200) AND NOT (o_orderkey % 5 = 0)")
def deletion_vector_union(spark, d):
    t = _three(spark, d, "vectors")
    t.delete(col("o_custkey") < 200)
    t.delete(F.col("o_orderkey") % 5 == 0)
    return t.scan()


@query("SELECT o_orderkey, CASE WHEN o_custkey < 300 THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_custkey < 300 THEN upper(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_predicate(spark, d):
    t = _three(spark, d, "update")
    t.update(col("o_custkey") < 300, {"o_totalprice": 0.0, "o_orderpriority": call("upper", col("o_orderpriority"))})
    return t.scan(["o_orderkey", "o_totalprice", "o_orderpriority"])


@query("SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_by_rowid(spark, d):
    t = _three(spark, d, "rowids")
    t.update_by_row_ids(t.scan(["o_custkey", "o_totalprice"], row_ids=True).where("o_custkey = 7").select("row_id", (F.col("o_totalprice") + 1).alias("o_totalprice")))
    return t.scan(["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey <> 7")
def delete_by_rowid(spark, d):
    t = _three(spark, d, "rowids")
    t.delete_by_row_ids(t.scan(["o_custkey"], row_ids=True).where("o_custkey = 7"))
    return t.scan(["o_orderkey"])


@query("SELECT o_orderkey, 'insert' AS change, CASE WHEN o_orderkey < 5000 THEN 1 WHEN o_orderkey < 10000 THEN 2 ELSE 3 END::BIGINT AS version FROM orders")
def cdf_insert_only(spark, d):
    return _three(spark, d, "feed").changes(1, 3).select("o_orderkey", F.col("_change_type").alias("change"), F.col("_commit_version").alias("version"))


@query("SELECT o_orderkey, o_totalprice, 'delete' AS change, 4::BIGINT AS version FROM orders WHERE o_custkey < 50 UNION ALL SELECT o_orderkey, o_totalprice, 'update_preimage', 5 FROM orders WHERE o_custkey BETWEEN 50 AND 99 UNION ALL SELECT o_orderkey, 1.0, 'update_postimage', 5 FROM orders WHERE o_custkey BETWEEN 50 AND 99")
def cdf_update_delete(spark, d):
    t = _three(spark, d, "feed", properties={"changeDataFeed": True})
    t.delete(col("o_custkey") < 50)
    t.update(col("o_custkey") < 100, {"o_totalprice": 1.0})
    return t.changes(4, 5).select("o_orderkey", "o_totalprice", F.col("_change_type").alias("change"), F.col("_commit_version").alias("version"))


@query("SELECT o_orderkey, 'delete' AS change FROM orders WHERE o_custkey BETWEEN 50 AND 99")
def cdf_inferred_deletes(spark, d):
    t = _three(spark, d, "feed")
    t.delete(col("o_custkey") < 50)
    t.delete(col("o_custkey") < 100)
    return t.changes(5, 5).select("o_orderkey", F.col("_change_type").alias("change"))


@query(f"SELECT {ORDER}, 1::BIGINT AS files, 0::BIGINT AS masked FROM orders WHERE o_custkey >= 100")
def compact_table(spark, d):
    t = _three(spark, d, "compact")
    t.delete(col("o_custkey") < 100)
    t.compact(whole=True)
    left = t.snapshot().files.agg(F.count(F.lit(1)).alias("files"), F.count("dv").alias("masked"))
    return t.scan().crossJoin(F.broadcast(left))


@query(f"SELECT {ORDER}, 1::BIGINT AS files_left, true AS some_gone FROM orders WHERE o_custkey >= 100")
def vacuum_keepset(spark, d):
    t = _three(spark, d, "vacuum")
    t.delete(col("o_custkey") < 50)
    t.compact(whole=True)
    t.delete(col("o_custkey") < 100)
    gone = t.vacuum(-1000)
    left = [p for p, *_ in t.log.store.walk("data") if p.endswith(".parquet")]
    return t.scan().withColumns({"files_left": F.lit(len(left)).cast("long"), "some_gone": F.lit(len(gone) > 0)})


@query(f"SELECT {ORDER} FROM orders")
def checkpoint_replay(spark, d):
    t = _three(spark, d, "checkpoint")
    t.compact_log(1, 2)
    t.checkpoint()
    for v in range(t.version):  # only the checkpoint knows these commits now
        t.log.store.delete(t.log.name(v))
    return Table.open(spark, t.path).scan()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 10000")
def restore_version(spark, d):
    t = _three(spark, d, "restore")
    t.delete(col("o_orderkey") < 100)
    t.restore(2)
    return t.scan(["o_orderkey", "o_totalprice"])


def _merged(spark, d, name: str, n: int = 3, **properties) -> Table:
    """Orders that are not pending, with open and pending ones merged into them at a price of -1."""
    o = read(spark, d, "orders")
    t = Table.create(spark, new_folder(spark, name), o.schema, properties=properties)
    own = o.where("o_orderstatus <> 'P'")
    t.append(_ranged(own, n, "o_orderkey").sortWithinPartitions("o_orderkey"))
    t.merge(o.where("o_orderstatus <> 'F'").withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"])
    return t


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -1.0 END AS o_totalprice FROM orders")
def merge_into(spark, d):
    return _merged(spark, d, "merge").scan(["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice, 'update_preimage' AS change FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, -1.0, 'update_postimage' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, -1.0, 'insert' FROM orders WHERE o_orderstatus = 'P'")
def cdf_merge(spark, d):
    t = _merged(spark, d, "cdf-merge", changeDataFeed="true")
    return t.changes(2, 2).select("o_orderkey", "o_totalprice", F.col("_change_type").alias("change"))


@query("WITH t AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS id FROM orders WHERE o_orderstatus <> 'P') SELECT o.o_orderkey, t.id AS kept_id, 1::BIGINT AS rows_of_id, o.o_orderstatus = 'P' AS is_new FROM orders o LEFT JOIN t USING (o_orderkey)")
def row_tracking_merge(spark, d):
    """Rows that were there keep their ids, new ones have ids beyond them, and no id comes twice."""
    t = _merged(spark, d, "merge-ids", 1, rowTracking="true")
    before = t.scan_with_stable_ids(1).agg(F.max("_row_id").alias("top"))
    rows = t.scan_with_stable_ids()
    times = rows.groupBy("_row_id").agg(F.count(F.lit(1)).alias("rows_of_id"))
    fresh = F.col("_row_id") > F.col("top")
    return rows.join(times, "_row_id").crossJoin(F.broadcast(before)).select("o_orderkey", F.when(~fresh, F.col("_row_id")).alias("kept_id"), "rows_of_id", fresh.alias("is_new"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey < 100 THEN 0.0 ELSE o_totalprice END AS o_totalprice, 2::BIGINT AS version FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey < 50)")
def transaction_row_level(spark, d):
    """An append, a delete and an update as one version."""
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderstatus <> 'P'"), "txn-rows", partition_by=["o_orderstatus"])
    own = t.transaction().append(o.where("o_orderstatus = 'P'")).delete((col("o_orderstatus") == "F") & (col("o_custkey") < 50))
    version = own.update((col("o_orderstatus") == "O") & (col("o_custkey") < 100), {"o_totalprice": 0.0}).commit()
    return t.scan(["o_orderkey", "o_totalprice"]).withColumn("version", F.lit(version).cast("long"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 5000")
def transaction_multi(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey < 5000"), "txn")
    t.transaction().append(o.where("o_orderkey >= 5000")).remove_files(col("o_orderkey") < 5000).commit()
    return t.scan(["o_orderkey"])


@query("SELECT o_orderkey FROM orders")
def staged_commit(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey < 5000"), "staged")
    t.commit_staged(t.stage(o.where("o_orderkey >= 5000")))
    return t.scan(["o_orderkey"])


# -- schema ----------------------------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, CASE WHEN o_orderkey < 5000 THEN NULL ELSE o_orderpriority END AS note FROM orders")
def schema_add_column(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey < 5000").select("o_orderkey", "o_totalprice"), "add")
    t.add_column("note", "string")
    t.append(o.where("o_orderkey >= 5000").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("note")))
    return t.scan(["o_orderkey", "note"])


@query("SELECT o_orderkey, o_totalprice AS price, CAST(NULL AS BIGINT) AS o_custkey FROM orders WHERE o_totalprice > 100000")
def schema_rename_drop(spark, d):
    t = _table(spark, read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "rename", mapping="name")
    t.rename_column("o_totalprice", "price")
    t.drop_column("o_custkey")
    t.add_column("o_custkey", "long")
    return t.scan(filter=col("price") > 100000.0)


@query("SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderkey >= 5000 THEN o_orderstatus END AS status FROM orders")
def schema_nested_field(spark, d):
    o = read(spark, d, "orders")
    t = _table(spark, o.where("o_orderkey < 5000").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price")).alias("s")), "nested", mapping="name")
    t.add_column("s.status", "string")
    t.rename_column("s.price", "amount")
    t.append(o.where("o_orderkey >= 5000").select("o_orderkey", F.struct(F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")).alias("s")))
    return t.scan().select("o_orderkey", "s.amount", "s.status")


@query("SELECT k::BIGINT AS k, v::DOUBLE AS v, d::TIMESTAMP AS d, p::VARCHAR AS p FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey < 5000 THEN (o_totalprice / 1000)::INT::DOUBLE ELSE o_totalprice END AS v, o_orderdate AS d, CAST((o_orderkey % 100) + 0.5 AS DECIMAL(12,2)) AS p FROM orders)")
def type_widen(spark, d):
    o = read(spark, d, "orders")
    old = o.where("o_orderkey < 5000").select(F.col("o_orderkey").cast("int").alias("k"), F.round(F.col("o_totalprice") / 1000).cast("int").alias("v"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 100 + F.lit(0.5)).cast("decimal(6,2)").alias("p"))
    t = _table(spark, old, "widen")
    for c, kind in (("k", "bigint"), ("v", "double"), ("d", "timestamp_ntz"), ("p", "decimal(12,2)")):
        t.widen_column(c, kind)
    t.append(o.where("o_orderkey >= 5000").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("d"), (F.col("o_orderkey") % 100 + F.lit(0.5)).cast("decimal(12,2)").alias("p")))
    return t.scan().withColumn("p", F.col("p").cast("string"))


@query("SELECT o_orderkey, (100 + 10 * (row_number() OVER (ORDER BY o_orderkey) - 1))::BIGINT AS id FROM orders")
def identity_column(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    t = Table.create(spark, new_folder(spark, "identity"), T.StructType([*o.schema.fields, identity("id", 100, 10)]))
    t.append(o.where("o_orderkey < 7000"), identity_order=["o_orderkey"])
    t.append(o.where("o_orderkey >= 7000"), identity_order=["o_orderkey"])
    return t.scan()


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_id, CASE WHEN o_custkey < 100 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def row_tracking(spark, d):
    o = read(spark, d, "orders")
    t = Table.create(spark, new_folder(spark, "tracking"), o.schema, properties={"rowTracking": True})
    t.append(_ranged(o, 1, "o_orderkey").sortWithinPartitions("o_orderkey"))
    t.update(col("o_custkey") < 100, {"o_totalprice": 0.0})
    return t.scan_with_stable_ids().select("o_orderkey", F.col("_row_id").alias("row_id"), "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0")
def check_constraint(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    t = Table.create(spark, new_folder(spark, "check"), o.schema, properties={"constraint.positive": "o_totalprice > 0"})
    try:
        t.append(o.withColumn("o_totalprice", F.lit(-1.0)))
    except Exception as refused:
        if "CHECK positive fails" not in str(refused):
            raise
    t.append(o)
    return t.scan()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def clustered_table(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    t = Table.create(spark, new_folder(spark, "clustered"), o.schema, clustering=["o_totalprice"])
    t.append(o)
    return t.scan()


TRANSFORMS: dict[str, tuple[Callable[[], Column], str]] = {
    "identity": (lambda: transforms.identity(F.col("o_custkey")), "o_custkey"),
    "void": (lambda: transforms.void(F.col("o_custkey"), T.LongType()), "CAST(NULL AS BIGINT)"),
    "truncate": (lambda: transforms.truncate(F.col("o_custkey"), 100, T.LongType()), "o_custkey - o_custkey % 100"),
    "year": (lambda: transforms.year(F.col("o_orderdate")), "(year(o_orderdate) - 1970)::INT"),
    "month": (lambda: transforms.month(F.col("o_orderdate")), "((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INT"),
    "day": (lambda: transforms.day(F.col("o_orderdate")), "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT"),
    "hour": (lambda: transforms.hour(F.col("o_orderdate")), "date_diff('hour', TIMESTAMP '1970-01-01', o_orderdate)::INT"),
}
for _name, (_make, _sql) in TRANSFORMS.items():

    @query(f"SELECT o_orderkey, {_sql} AS part FROM orders", f"partition_transform_{_name}")
    def _transform(spark, d, make=_make):
        return read(spark, d, "orders").select("o_orderkey", make().alias("part"))


@query(None)
def partition_transform_bucket(spark, d):
    return read(spark, d, "orders").select("o_orderkey", transforms.bucket(F.col("o_orderkey"), 16, T.LongType()).alias("part"))


@query("SELECT c_custkey, c_custkey::BIGINT AS id, c_acctbal AS balance, 'none' AS note, c_name AS name FROM customer")
def avro_resolution(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("id"), "c_acctbal", F.col("c_name").cast("binary").alias("name"), "c_custkey")
    out = {"type": "record", "name": "row", "fields": [{"name": "id", "type": "long"}, {"name": "balance", "aliases": ["c_acctbal"], "type": "double"}, {"name": "name", "type": "string"}, {"name": "note", "type": "string", "default": "none"}, {"name": "c_custkey", "type": "long"}]}
    wrote = {"type": "record", "name": "row", "fields": [{"name": "id", "type": "int"}, {"name": "c_acctbal", "type": "double"}, {"name": "name", "type": "bytes"}, {"name": "c_custkey", "type": "long"}]}
    store = avro.SchemaStore()
    store.register(wrote)
    return avro.decode_messages(avro.encode_messages(c, wrote), "message", store, out)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def avro_container(spark, d):
    path = new_folder(spark, "avro").removeprefix("file://")
    spark.dataSource.register(avro.AvroSource)
    read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey").write.format("stratalake_avro").mode("append").option("path", path).save()
    return avro.read_avro(spark, "file://" + path, columns=["c_custkey", "c_name", "c_acctbal"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def orc_scan(spark, d):
    path = new_folder(spark, "orc")
    files.write(read(spark, d, "lineitem"), path, "orc", bloom={"l_orderkey": 1000})
    return files.scan(spark, path, ["l_orderkey", "l_linenumber", "l_quantity"], col("l_quantity") > 40.0, "orc")


@query("SELECT count(*) AS num_rows FROM lineitem")
def parquet_metadata(spark, d):
    return files.footers(spark, f"{d}/lineitem.parquet").agg(F.sum("num_rows").alias("num_rows"))


@query("SELECT n_nationkey, n_name FROM nation")
def parquet_row_group(spark, d):
    return files.row_group(spark, f"{d}/nation.parquet", 0, ["n_nationkey", "n_name"])


# -- snapshots -------------------------------------------------------------------------------------------------------------------------
SNAPS = "(SELECT event_id AS snapshot_id, CASE WHEN event_id % 500 = 0 THEN NULL ELSE event_id - 1 END AS parent_id, ts FROM events)"


def _snaps(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("snapshot_id"), F.expr("CASE WHEN event_id % 500 = 0 THEN NULL ELSE event_id - 1 END").alias("parent_id"), "ts")


@query(f"SELECT snapshot_id FROM {SNAPS} WHERE ts < TIMESTAMP '2024-01-03' EXCEPT SELECT snapshot_id FROM (SELECT snapshot_id FROM {SNAPS} ORDER BY ts DESC, snapshot_id DESC LIMIT 900)")
def snapshot_expire(spark, d):
    return snapshots.expired(_snaps(spark, d), F.lit(dt.datetime(2024, 1, 3)), 900).select("snapshot_id")


@query(f"WITH RECURSIVE s AS {SNAPS}, l(snapshot_id, parent_id, depth) AS (SELECT snapshot_id, parent_id, 0 FROM s WHERE snapshot_id = 777 UNION ALL SELECT s.snapshot_id, s.parent_id, l.depth + 1 FROM l JOIN s ON s.snapshot_id = l.parent_id) SELECT snapshot_id, depth FROM l")
def snapshot_lineage(spark, d):
    """From 777 back to the head of its line, 277 steps."""
    return snapshots.lineage(_snaps(spark, d), 777)


@query("SELECT 'dev' AS ref, o_orderkey FROM orders WHERE o_orderkey < 10000 UNION ALL SELECT 'v1', o_orderkey FROM orders WHERE o_orderkey < 5000")
def refs_branch_tag(spark, d):
    t = _three(spark, d, "refs")
    m = snapshots.Metadata()
    for v in (1, 2, 3):
        m = m.commit(v)
    m = m.branch("dev", 1).tag("v1", 1)
    m = m.branch("two", 2).fast_forward("dev", "two")
    one = lambda ref: t.scan(["o_orderkey"], version=m.resolve(ref)).select(F.lit(ref).alias("ref"), "o_orderkey")
    return one("dev").unionByName(one("v1"))


# -- encodings -------------------------------------------------------------------------------------------------------------------------
@query("WITH m AS (SELECT l_suppkey, l_returnflag, row_number() OVER w AS place, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR row_number() OVER w = 1 AS fresh FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY l_suppkey ORDER BY place) AS run FROM m) SELECT l_suppkey, run::BIGINT AS run, any_value(l_returnflag) AS value, max(place)::BIGINT AS run_end FROM r GROUP BY 1, 2")
def runend_encode(spark, d):
    return encodings.run_end(read(spark, d, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], ["l_suppkey"])


@query("SELECT o_orderkey, o_custkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta, o_orderkey AS value FROM orders")
def delta_encode(spark, d):
    made = encodings.delta(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_orderkey"], ["o_custkey"])
    return encodings.undelta(made, ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "delta", F.col("value").cast("long").alias("value"))


@query(f"WITH z AS {ZONED} SELECT o_orderkey, zone, min(o_custkey) OVER w AS reference, ceil(log2(max(o_custkey) OVER w - min(o_custkey) OVER w + 1))::BIGINT AS bit_width, o_custkey - min(o_custkey) OVER w AS \"offset\" FROM z WINDOW w AS (PARTITION BY zone)")
def for_encode(spark, d):
    return encodings.frame_of_reference(_zoned(spark, d), "o_custkey", "zone").select("o_orderkey", "zone", "reference", "bit_width", "offset")


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def dict_encode(spark, d):
    return encodings.dictionary(read(spark, d, "orders"), "o_orderpriority")[1].select("o_orderkey", "code")


@query("WITH f AS (SELECT o_orderstatus AS fill FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT o_orderkey, o_orderstatus, fill FROM orders, f WHERE o_orderstatus IS DISTINCT FROM fill")
def sparse_encode(spark, d):
    return encodings.sparse(read(spark, d, "orders"), "o_orderstatus")[1].select("o_orderkey", "o_orderstatus", "fill")


@query("SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS days, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS seconds, (microsecond(ts) % 1000000)::BIGINT AS micros FROM events")
def datetime_parts(spark, d):
    return encodings.datetime_parts(read(spark, d, "events"), "ts").select("event_id", "days", "seconds", "micros")


# -- concurrency and streams -----------------------------------------------------------------------------------------------------------
CASES = {
    "metadata": ([], ReadSet(), [{"metaData": {}}], "metadataChanged"),
    "protocol": ([], ReadSet(), [{"protocol": {"a": 1}}], "protocolChanged"),
    "delete_delete": ([{"remove": {"path": "a"}}], ReadSet(), [{"remove": {"path": "a"}}], "concurrentDeleteDelete"),
    "delete_read": ([], ReadSet(files={"a"}), [{"remove": {"path": "a", "dataChange": True}}], "concurrentDeleteRead"),
    "compaction_read": ([], ReadSet(files={"a"}), [{"remove": {"path": "a", "dataChange": False}}], "none"),
    "append_read": ([], ReadSet(whole=True), [{"add": {"path": "b"}}], "concurrentAppend"),
    "blind_append_read": ([], ReadSet(whole=True), [{"commitInfo": {"isBlindAppend": True}}, {"add": {"path": "b"}}], "none"),
    "append_append": ([{"add": {"path": "c"}}], ReadSet(), [{"add": {"path": "b"}}], "none"),
    "same_writer": ([{"txn": {"appId": "x"}}], ReadSet(), [{"txn": {"appId": "x"}}], "concurrentTransaction"),
}
CASES["metadata"][2][0]["metaData"] = {"id": "1"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[3]}')" for k, v in CASES.items()) + ") AS c(case_name, verdict)")
def conflict_matrix(spark, d):
    return spark.createDataFrame([(k, conflict(own, seen, won, WRITE_SERIALIZABLE) or "none") for k, (own, seen, won, _) in CASES.items()], "case_name string, verdict string")


@query("SELECT event_id, user_id, event_type FROM events")
def txn_idempotent(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    t = Table.create(spark, new_folder(spark, "stream"), e.schema)
    staged = new_folder(spark, "source")
    e.repartition(3).write.parquet(staged)
    for _ in range(2):  # the second run delivers the same batches again under a new checkpoint
        source = spark.readStream.schema(e.schema).parquet(staged)
        append_stream(source, t, "app", new_folder(spark, "stream-checkpoint")).awaitTermination()
    return t.scan()


@query("SELECT o_orderkey, 'insert' AS change FROM orders UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_custkey < 50")
def cdf_stream(spark, d):
    t = _three(spark, d, "cdf-stream", properties={"changeDataFeed": True})
    t.delete(col("o_custkey") < 50)
    out = new_folder(spark, "cdf-out")
    put = lambda df, i: df.select("o_orderkey", F.col("_change_type").alias("change")).write.mode("append").parquet(out)
    change_stream(spark, t.path, put, new_folder(spark, "cdf-checkpoint"), 1).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    out = windowed(read(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return pruned_scan(spark, d)


