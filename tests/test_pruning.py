"""Verdicts from statistics never lose a row, and say ALWAYS only where all rows match."""


import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalake.functions.expr import Compiler, and_, col, lit, not_, or_
from stratalake.plans import prune, stats

ROWS = [
    (0, 1, 1.0, "abc", None), (0, 2, 2.0, "abd", None), (1, 5, float("nan"), "b", 1), (1, 5, float("nan"), "b", None), (2, None, None, None, None), (2, None, None, None, None), (3, 7, -1.0, "x" * 40, 3), (3, 7, 3.0, "x" * 41, 3),
    (4, -(2**31), float("inf"), "", 0), (4, 2**31 - 1, float("-inf"), "\U0001f600", 9), (5, 5, 0.0, "ab", 5),
]
SCHEMA = "u int, i int, f double, s string, n int"


def check(spark, predicates):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    s = stats.unit_stats(df, "u", ["i", "f", "s", "n"])
    c = Compiler(df.schema)
    true = df.groupBy("u").agg(*[F.count_if(c.column(p)).alias(f"t{k}") for k, p in enumerate(predicates)], F.count(F.lit(1)).alias("rows")).collect()
    pruner = prune.Pruner(prune.Stats(s.schema, kinds))
    got = {r["unit"]: r for r in s.select("unit", *[pruner.verdict(p).alias(f"v{k}") for k, p in enumerate(predicates)]).collect()}
    for r in true:
        for k, p in enumerate(predicates):
            v = got[r["u"]][f"v{k}"]
            assert v != prune.NEVER or r[f"t{k}"] == 0, (r["u"], p)
            assert v != prune.ALWAYS or r[f"t{k}"] == r["rows"], (r["u"], p)


def leaf():
    number = st.sampled_from([1, 2, 5, 7, None, -(2**31), 2**31 - 1])
    floats = st.sampled_from([1.0, 2.0, math.nan, math.inf, -1.0, None])
    texts = st.sampled_from(["abc", "ab", "b", "", "x" * 40, "x" * 32, None])
    out = []
    for name, vals in (("i", number), ("n", number), ("f", floats), ("s", texts)):
        c = col(name)
        for op in (lambda c, v: c == v, lambda c, v: c != v, lambda c, v: c < v, lambda c, v: c <= v, lambda c, v: c > v, lambda c, v: c >= v, lambda c, v: c.same(v), lambda c, v: lit(v) < c, lambda c, v: c.isin(v, v), lambda c, v: c.not_in(v)):
            out.append(vals.map(lambda v, c=c, op=op: op(c, v)))
        out += [st.just(c.is_null()), st.just(c.is_not_null()), st.just(c.isin()), st.just(c.not_in())]
    out += [st.sampled_from([col("s").starts_with(p) for p in ("a", "ab", "x" * 33, "")]), st.just(col("f").is_nan()), st.just(col("f").is_not_nan()), st.just(col("i") == col("n"))]
    return st.one_of(out)


TREES = st.recursive(leaf(), lambda x: st.one_of(x.map(not_), st.tuples(x, x).map(lambda p: and_(*p)), st.tuples(x, x).map(lambda p: or_(*p))), max_leaves=4)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=25, max_size=40))
def test_sound(spark, predicates):
    check(spark, predicates)


def test_known_verdicts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    s = stats.unit_stats(df, "u", ["i", "f", "s", "n"])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = lambda p: [r["verdict"] for r in prune.verdicts(s, p, kinds).orderBy("unit").collect()]
    assert got(col("i") == 5) == [0, 2, 0, 0, 1, 2]
    assert got(col("n").same(None)) == [2, 1, 2, 0, 0, 0]
    assert got(col("i") >= 0) == [2, 2, 0, 2, 1, 2]
    assert got(not_(col("i") < 5)) == [0, 2, 0, 2, 1, 2]
    assert got(col("s").starts_with("x" * 33)) == [0, 0, 0, 1, 1, 0]
    assert got(lit(1) == 2) == [0] * 6 if not isinstance(lit(1) == 2, bool) else True
    assert got(col("i") == col("n")) == [1] * 6


@pytest.mark.parametrize("values", [[1], [5, 7], [None], []])
def test_bloom_and_index(spark, values):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("o", F.col("u"))
    true = {r["u"] for r in df.where(F.col("i").isin([v for v in values if v is not None] or [-99])).select("u").distinct().collect()}
    may = {r["unit"] for r in prune.bloom_units(df, "u", "i", values).where("may_contain").collect()}
    assert true <= may and len(may) <= len(true) + 1
    units = prune.index_units({"i": prune.index_table(df, "i", "u", "o")}, col("i").isin(*values))
    assert {r["unit"] for r in units.collect()} == true


def test_index_logic(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("o", F.col("u"))
    index = {"i": prune.index_table(df, "i", "u", "o")}
    units = lambda p: None if (x := prune.index_units(index, p)) is None else sorted(r["unit"] for r in x.collect())
    assert units((col("i") == 5) & (col("f") > 0.0)) == [1, 5]
    assert units((col("i") == 5) | (col("f") > 0.0)) is None
    assert units((col("i") == 5) | (col("i") < 2)) == [0, 1, 4, 5]
    assert units(~(col("i") == 5)) is None


def test_zones(spark):
    df = spark.range(0, 2500).withColumn("x", F.col("id") % 7)
    z = stats.zones(df, ["id"], 1000)
    assert sorted(r["count"] for r in z.groupBy("zone").count().collect()) == [500, 1000, 1000]
    assert z.where(F.col("position") != F.col("id")).count() == 0
    assert [r["is_sorted"] for r in stats.zone_stats(z, "id").collect()] == [True] * 3
    assert not any(r["is_sorted"] for r in stats.zone_stats(z, "x").collect())


