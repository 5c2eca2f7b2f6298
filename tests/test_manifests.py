"""Plans over manifests: bounds by field id, removed files, and the delete files that apply to each data file."""

from pyspark.sql import types as T

from stratalake.functions.expr import col, lit
from stratalake.operators.manifests import DATA, ENTRY, EQUALITY, POSITIONS, Manifests, data_entries, plan

LONG = {"k": T.LongType(), "v": T.LongType()}


def entry(path, content, sequence, partition=None, target=None, bounds=None, removed=False):
    low, high = ({1: str(b)} for b in bounds) if bounds else (None, None)
    return (path, content, removed, sequence, partition or {}, target, 10, low, high, {1: 0} if bounds else None, None, {1: True} if bounds else None)


def planned(entries, predicate, ids):
    return {r["path"]: (r["verdict"], r["deletes"]) for r in plan(entries, predicate, LONG, ids).collect()}


def test_deletes_apply_by_sequence_partition_and_target(spark):
    rows = [
        entry("a1", DATA, 1, {"p": "a"}), entry("a3", DATA, 3, {"p": "a"}), entry("b1", DATA, 1, {"p": "b"}), entry("n1", DATA, 1, {"p": None}),
        entry("pos-a", POSITIONS, 3, {"p": "a"}), entry("pos-b1", POSITIONS, 2, {"p": "b"}, "b1"), entry("eq-a", EQUALITY, 3, {"p": "a"}),
        entry("eq-all-1", EQUALITY, 1), entry("eq-all-2", EQUALITY, 2),
    ]
    found = planned(spark.createDataFrame(rows, ENTRY), col("k") > lit(0), {"k": 1})
    assert found == {"a1": (1, ["eq-a", "eq-all-2", "pos-a"]), "a3": (1, ["pos-a"]), "b1": (1, ["eq-all-2", "pos-b1"]), "n1": (1, ["eq-all-2"])}


def test_bounds_follow_field_ids(spark):
    rows = [entry("low", DATA, 1, bounds=(1, 9)), entry("mid", DATA, 1, bounds=(5, 15)), entry("high", DATA, 1, bounds=(11, 19)), entry("none", DATA, 1)]
    e = spark.createDataFrame(rows, ENTRY)
    assert planned(e, col("k") > lit(10), {"k": 1}) == {"mid": (1, []), "high": (2, []), "none": (1, [])}
    # The column under its new name has the bounds; a new column with another id, or with none, has no bounds.
    assert planned(e, col("v") > lit(10), {"v": 1}).keys() == {"mid", "high", "none"}
    assert planned(e, col("k") > lit(10), {"k": 2}).keys() == {"low", "mid", "high", "none"}
    assert planned(e, col("k") > lit(10), {}).keys() == {"low", "mid", "high", "none"}


def test_snapshots_are_lists_of_manifests(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 1), ("x", 2, None), ("y", 8, 8), (None, 3, 3)], "f string, k long, v long")
    m = Manifests(spark, f"file://{tmp_path}/m")
    first = m.add(data_entries(df.where("f is not null"), "f", {"k": 1, "v": 2}, 1))
    gone = m.add(spark.createDataFrame([entry("x", DATA, 2, removed=True)], ENTRY))
    assert planned(m.entries([first]), col("k") < lit(5), {"k": 1}) == {"x": (2, [])}
    assert planned(m.entries([first]), col("v") < lit(5), {"v": 2}) == {"x": (1, [])}
    assert {r["path"] for r in m.entries([first, gone]).collect()} == {"y"}
    assert m.entries([]).count() == 0 and planned(m.entries([]), col("k") < lit(5), {"k": 1}) == {}
