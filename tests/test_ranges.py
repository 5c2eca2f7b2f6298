"""Tables of queries are written by more tasks where there is more input."""

import pytest
from pyspark.sql import functions as F

from stratalake.plans import queries
from stratalake.plans.stats import unit_stats


def orders(spark, path, n=4000):
    df = spark.range(0, n, 1, 1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 200).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") * 7 % 3 + 1).cast("int")).alias("o_orderstatus"), (F.col("id") + 0.5).alias("o_totalprice"), F.expr("timestamp_ntz'1997-01-01'").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    df.orderBy(F.hash("o_orderkey")).coalesce(1).write.parquet(f"{path}/orders.parquet")


@pytest.mark.parametrize("name", ["prune_partition", "row_tracking", "row_tracking_merge", "row_range_slice", "point_read_by_rowid"])
def test_no_file_holds_a_fixed_share(spark, tmp_path, monkeypatch, name):
    orders(spark, tmp_path)
    monkeypatch.setattr(queries, "RANGE_BYTES", 2000)
    made = []
    create = queries.Table.create
    monkeypatch.setattr(queries.Table, "create", lambda *a, **k: made.append(create(*a, **k)) or made[-1])
    rows = [r.asDict() for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    n = [r["n"] for r in made[0].snapshot(1).files.select(F.get_json_object("stats", "$.num_records").cast("long").alias("n")).collect()]
    assert len(n) >= 8 and max(n) < 1000
    if name == "prune_partition":
        assert sorted((r["part"], r["verdict"]) for r in rows) == [("F", 2), ("O", 0), ("P", 0)]
    elif name == "row_tracking":
        assert sorted((r["o_orderkey"], r["row_id"]) for r in rows) == [(i, i) for i in range(4000)]
    elif name == "row_tracking_merge":
        old = [i for i in range(4000) if i * 7 % 3 != 2]
        assert sorted((r["kept_id"], r["o_orderkey"]) for r in rows if not r["is_new"]) == list(enumerate(old))
        assert len(rows) == 4000 and {r["rows_of_id"] for r in rows} == {1}
    elif name == "row_range_slice":
        assert sorted(r["o_orderkey"] for r in rows) == list(range(1000, 1250))
    else:
        assert sorted(r["o_orderkey"] for r in rows) == list(range(7, 4000, 200))


def test_statistics_of_files_need_no_sort(spark):
    df = spark.range(10).select(F.lit("f").alias("_path"), F.col("id").cast("string").alias("s"))
    made = unit_stats(df, "_path")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert made.select("num_records", "min.s").first() == (10, "0")
