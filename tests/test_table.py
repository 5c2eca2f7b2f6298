"""Tables: writes, DML, feed, concurrency, evolution and maintenance."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.expr import col
from stratalake.operators.log import CommitConflict
from stratalake.operators.schema import can_promote, can_widen, identity
from stratalake.operators.snapshots import Catalog, Metadata, expired
from stratalake.operators.table import Table
from stratalake.operators.txn import ConcurrentModification, ReadSet, conflict


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def three(spark, path, **more):
    t = Table.create(spark, path, "id long, v string", **more)
    for i in range(3):
        t.append(spark.createDataFrame([(i * 100 + j, f"v{j}" if j else None) for j in range(10)], t.schema))
    return t


def test_round_trip_pruning_and_history(spark, path):
    t = three(spark, path)
    assert t.version == 3 and len(ids(t.scan())) == 30
    kept = t.candidate_files(col("id") >= 200).where("verdict > 0").count()
    assert kept < t.candidate_files().count()
    assert ids(t.scan(filter=col("id") >= 205)) == [205, 206, 207, 208, 209]
    assert ids(t.scan(version=1)) == list(range(10))
    assert [r["version"] for r in t.history().collect()] == [0, 1, 2, 3]
    assert Table.open(spark, path).version == 3
    with pytest.raises(FileNotFoundError):
        Table.open(spark, path + "-none")
    with pytest.raises(ValueError):
        t.scan(version=9)


def test_delete_keeps_null_rows_and_masks_add_up(spark, path):
    t = three(spark, path)
    assert t.delete(col("v") == "v1")[0] == 3
    assert len(ids(t.scan())) == 27
    assert t.delete(col("v") == "none") == (0, t.version)
    assert t.delete(col("id") < 100)[0] == 9
    assert t.delete(col("v") != "v5")[0] == 14
    assert ids(t.scan()) == [100, 105, 200, 205]
    assert t.compact() is not None and ids(t.scan()) == [100, 105, 200, 205]
    assert ids(t.scan(version=3)) == sorted(i * 100 + j for i in range(3) for j in range(10))
    t.vacuum(-1000)
    assert ids(t.scan()) == [100, 105, 200, 205]


def test_partial_delete_without_vectors_is_refused(spark, path):
    t = three(spark, path, properties={"deletionVectors": "false"})
    with pytest.raises(ValueError):
        t.delete(col("v") == "v1")


def test_feed_reconciles(spark, path):
    t = three(spark, path, properties={"changeDataFeed": True})
    t.update(col("id") == 5, {"v": "new"})
    t.delete(col("id") == 6)
    feed = t.changes(1, t.version)
    plus = feed.where("_change_type in ('insert', 'update_postimage')").select("id", "v")
    minus = feed.where("_change_type in ('delete', 'update_preimage')").select("id", "v")
    assert sorted(map(tuple, plus.exceptAll(minus).collect()), key=str) == sorted(map(tuple, t.scan().collect()), key=str)


def test_partitions(spark, path):
    t = Table.create(spark, path, "id long, region string", partition_by=["region"])
    t.append(spark.createDataFrame([(1, "us"), (2, "eu"), (3, None), (4, "a/b c%"), (5, "")], t.schema))
    assert ids(t.scan()) == [1, 2, 3, 4, 5]
    assert t.candidate_files(col("region") == "us").where("verdict > 0").count() == 1
    t.dynamic_overwrite(spark.createDataFrame([(10, "us"), (11, None), (12, "a/b c%")], t.schema))
    assert ids(t.scan()) == [2, 5, 10, 11, 12]
    with pytest.raises(Exception, match="outside of partition"):
        t.overwrite_partitions(spark.createDataFrame([(1, "eu")], t.schema), {"region": "us"})
    t.overwrite_partitions(spark.createDataFrame([(20, "us")], t.schema), {"region": "us"})
    assert ids(t.scan()) == [2, 5, 11, 12, 20]
    t.delete(col("region") == "a/b c%")
    assert ids(t.scan()) == [2, 5, 11, 20]
    with pytest.raises(ValueError):
        three(spark, path + "2").dynamic_overwrite(spark.createDataFrame([(1, "x")], "id long, v string"))


def test_concurrent_writers(spark, path):
    a = three(spark, path)
    b = Table.open(spark, path)
    reader = a.transaction().remove_files(col("id") < 100)
    assert b.append(spark.createDataFrame([(900, "z")], b.schema)) == 4
    reader.commit()  # a blind append is no conflict
    assert 900 in ids(a.refresh().scan()) and 5 not in ids(a.scan())
    one, two = a.transaction().remove_files((col("id") >= 100) & (col("id") < 200)), b.refresh().transaction().remove_files((col("id") >= 100) & (col("id") < 200))
    one.commit()
    with pytest.raises(ConcurrentModification) as e:
        two.commit()
    assert e.value.kind == "concurrentDeleteDelete"
    with pytest.raises(CommitConflict):
        a.log.write(3, [])


def test_conflict_rules():
    assert conflict([], ReadSet(whole=True), [{"commitInfo": {"isBlindAppend": True}}, {"add": {"path": "b"}}], "Serializable") == "concurrentAppend"
    assert conflict([], ReadSet(whole=True), [{"remove": {"path": "b", "dataChange": True}}], "SnapshotIsolation") is None


def test_idempotent_append(spark, path):
    t = three(spark, path)
    row = spark.createDataFrame([(900, "z")], t.schema)
    assert t.append(row, ("app", 1)) == 4 and t.append(row, ("app", 1)) == 4 and t.append(row, ("app", 2)) == 5


def test_evolution(spark, path):
    t = three(spark, path, mapping="name")
    t.rename_column("v", "w")
    t.add_column("v", "int")
    assert t.scan(["v"]).where("v is not null").count() == 0 and ids(t.scan(filter=col("w") == "v3")) == [3, 103, 203]
    t.drop_column("w")
    assert t.scan().columns == ["id", "v"]
    with pytest.raises(ValueError):
        t.add_column("id", "long")
    with pytest.raises(ValueError):
        t.add_column("n", "long", nullable=False)
    plain = three(spark, path + "2")
    with pytest.raises(ValueError):
        plain.rename_column("v", "w")
    with pytest.raises(ValueError):
        plain.widen_column("id", "int")
    with pytest.raises(ValueError):
        plain.append(spark.createDataFrame([(1, 2)], "id long, other int"))


def test_widening_rules():
    t = T._parse_datatype_string
    assert can_widen(t("int"), t("bigint")) and can_widen(t("float"), t("double")) and can_widen(t("decimal(5,2)"), t("decimal(7,3)")) and can_widen(t("int"), t("decimal(12,2)"))
    assert not can_widen(t("bigint"), t("double")) and not can_widen(t("decimal(5,2)"), t("decimal(5,3)")) and not can_widen(t("int"), t("decimal(10,2)"))
    assert can_promote(t("int"), t("bigint")) and not can_promote(t("int"), t("double")) and not can_promote(t("decimal(5,2)"), t("decimal(6,3)"))


def test_identity_and_tracking(spark, path):
    t = Table.create(spark, path, T.StructType([T.StructField("id", T.LongType()), identity("n", 1, 2)]), properties={"rowTracking": True})
    t.append(spark.range(3), identity_order=["id"])
    t.append(spark.range(3, 5), identity_order=["id"])
    assert [r["n"] for r in t.scan().orderBy("id").collect()] == [1, 3, 5, 7, 9]
    before = {r["id"]: r["_row_id"] for r in t.scan_with_stable_ids().collect()}
    t.update(col("id") == 1, {"n": 100})
    t.compact()
    assert {r["id"]: r["_row_id"] for r in t.scan_with_stable_ids().collect()} == before and len(set(before.values())) == 5


def test_constraints_and_append_only(spark, path):
    t = Table.create(spark, path, T.StructType([T.StructField("id", T.LongType(), False)]), properties={"constraint.small": "id < 10", "appendOnly": True})
    with pytest.raises(Exception, match="CHECK small fails"):
        t.append(spark.range(20))
    t.append(spark.range(5))
    with pytest.raises(ValueError):
        t.delete(col("id") == 1)
    with pytest.raises(Exception, match="NULL in id"):
        t.append(spark.createDataFrame([(None,)], "id long"))


def test_log_maintenance(spark, path):
    t = three(spark, path)
    for i in range(8):
        t.append(spark.createDataFrame([(1000 + i, "x")], t.schema))
    assert t.log.checkpoints() == [10]
    t.compact_log(2, 4)
    assert len(ids(Table.open(spark, path).scan())) == 38 and len(ids(Table.open(spark, path).scan(version=4))) == 31


def test_restore_merge_variant_empty(spark, path):
    t = three(spark, path)
    t.delete(col("id") < 100)
    t.restore(3)
    assert len(ids(t.scan())) == 30
    t.merge(spark.createDataFrame([(5, "m"), (999, "n")], t.schema), ["id"])
    assert {r["id"]: r["v"] for r in t.scan(filter=col("id").isin(5, 999)).collect()} == {5: "m", 999: "n"}
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(5, "m"), (5, "n")], t.schema), ["id"])
    v = Table.create(spark, path + "v", "id long, v variant")
    v.append(spark.sql("select 1L as id, parse_json('{\"a\": 7}') as v"))
    assert v.scan().select(F.variant_get("v", "$.a", "int")).first()[0] == 7
    assert Table.create(spark, path + "e", "id long").scan().count() == 0


def test_snapshot_metadata(spark, tmp_path):
    m = Metadata()
    for i in range(4):
        m = m.commit(1000 * (i + 1), added=(f"f{i}",))
    assert m.ancestors() == [4, 3, 2, 1] and m.files() == {"f0", "f1", "f2", "f3"} and m.as_of(2500) == 2
    dev = m.branch("dev", 2).commit(9000, added=("d",), branch="dev")
    assert dev.files(dev.resolve("dev")) == {"f0", "f1", "d"}
    assert dev.cherry_pick(5, 9999).files() == {"f0", "f1", "f2", "f3", "d"}
    assert m.rollback(2).current == 2
    with pytest.raises(ValueError):
        dev.publish("dev")
    assert [s.id for s in m.tag("keep", 1).expire(older_than_ms=3500).snapshots] == [1, 4]
    for catalog in (Catalog(), Catalog(spark, f"file://{tmp_path}/c")):
        catalog.create_namespace("a")
        catalog.create("a", "t", m)
        catalog.update("a", "t", dev)
        catalog.rename("a", "t", "u")
        assert catalog.load("a", "u") == dev and catalog.tables("a") == ["u"] and not catalog.exists("a", "t")
        with pytest.raises(ValueError):
            catalog.drop_namespace("a")
        catalog.drop("a", "u")
        catalog.drop_namespace("a")
        assert catalog.namespaces() == []


@pytest.mark.parametrize("last", [0, 7, 5000, 20_000])
def test_expiry_of_many_snapshots(spark, last):
    """All rows are ranked without one window over them, whatever their number."""
    rows = spark.range(10_000).select(F.col("id").alias("snapshot_id"), F.timestamp_seconds(F.col("id") * 7919 % 997).alias("ts"))
    out = expired(rows, F.timestamp_seconds(F.lit(600)), last)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(range(10_000), key=lambda i: (i * 7919 % 997, i), reverse=True)
    assert sorted(r["snapshot_id"] for r in out.collect()) == sorted(i for i in order[last:] if i * 7919 % 997 < 600)


def _ids(t):
    return sorted((r["id"], r["_row_id"]) for r in t.scan_with_stable_ids().collect())


def test_row_ids_are_given_at_commit(spark, path):
    """Merged, staged and concurrently appended rows have ids of their own, and rows that stay keep theirs."""
    one = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, value string").coalesce(1)
    t = Table.create(spark, path, "id long, value string", properties={"rowTracking": True})
    t.append(one(1, 2))
    before = dict(_ids(t))
    t.merge(one(2, 9, 10), ["id"])
    after = dict(_ids(t))
    assert after[1] == before[1] and after[2] == before[2] and len(set(after.values())) == 4
    t.transaction().append(one(20)).append(one(21)).commit()
    late = t.stage(one(30, 31))
    other = Table.open(spark, path)
    open_ = other.transaction().append(one(40))
    t.append(one(50))
    t.commit_staged(late)
    open_.commit()
    every = _ids(t.refresh())
    assert [i for i, _ in every] == [1, 2, 9, 10, 20, 21, 30, 31, 40, 50] and len({x for _, x in every}) == 10
    t.compact()
    assert _ids(t) == every


def test_identity_values_of_staged_rows_are_bound(spark, path):
    t = Table.create(spark, path, T.StructType([T.StructField("v", T.StringType()), identity("id", 1, 1)]))
    staged = t.stage(spark.createDataFrame([("a",)], "v string"))
    t.append(spark.createDataFrame([("b",)], "v string"))
    with pytest.raises(ConcurrentModification):
        t.commit_staged(staged)
    assert [(r["v"], r["id"]) for r in t.scan().collect()] == [("b", 1)]


def test_row_level_changes_in_a_transaction(spark, path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id long, value string")
    t = Table.create(spark, path, rows.schema, properties={"changeDataFeed": True})
    t.append(rows.repartitionByRange(2, "id"))
    v = t.transaction().delete(col("id") < 3).update(col("id") >= 15, {"value": "x"}).append(spark.createDataFrame([(99, "n")], rows.schema)).commit()
    assert v == 2 and {r["id"] for r in t.scan().collect()} == {*range(3, 20), 99} and t.scan(filter=col("value") == "x").count() == 5
    kinds = sorted((r["_change_type"], r["id"]) for r in t.changes(2, 2).collect())
    assert kinds == sorted([*[("delete", i) for i in range(3)], *[(k, i) for i in range(15, 20) for k in ("update_preimage", "update_postimage")], ("insert", 99)])
    with pytest.raises(ValueError, match="twice"):
        t.transaction().delete(col("id") == 4).delete(col("id") == 5)
    slow = t.transaction().delete(col("id") == 6)
    t.delete(col("id") == 7)
    with pytest.raises(ConcurrentModification):
        slow.commit()


def test_merge_reads_files_of_the_key_range_only(spark, path):
    rows = spark.createDataFrame([(i, "a") for i in range(100)], "id long, value string")
    t = Table.create(spark, path, rows.schema)
    t.append(rows.repartitionByRange(4, "id"))
    files = {r["path"] for r in t.snapshot().files.collect()}
    t.merge(spark.createDataFrame([(3, "b"), (None, "c"), (5, "d")], rows.schema), ["id"])
    assert len(files & {r["path"] for r in t.snapshot().files.collect()}) == 3
    assert sorted((r["id"], r["value"]) for r in t.scan(filter=col("value") != "a").collect() if r["id"]) == [(3, "b"), (5, "d")] and t.scan().count() == 101


def test_unknown_writer_features_are_refused(spark, path):
    t = Table.create(spark, path, "id long")
    t.log.write(1, [{"commitInfo": {"timestamp": 1, "inCommitTimestamp": 1 << 50, "operation": "UPGRADE"}}, {"protocol": {"minReaderVersion": 1, "minWriterVersion": 7, "readerFeatures": [], "writerFeatures": ["somethingNew"]}}])
    t = Table.open(spark, path)
    assert t.scan().count() == 0
    with pytest.raises(ValueError, match="somethingNew"):
        t.append(spark.range(3))


def test_lineage_of_any_length(spark):
    from stratalake.operators import snapshots

    rows = [(i, i - 1 if i else None) for i in range(700)] + [(1000, 1001), (1001, 1000), (2000, 5000)]
    frame = spark.createDataFrame(rows, "snapshot_id long, parent_id long")
    line = lambda start: sorted((r["depth"], r["snapshot_id"]) for r in snapshots.lineage(frame, start).collect())
    assert line(699) == [(i, 699 - i) for i in range(700)]
    assert line(1000) == [(0, 1000), (1, 1001)] and line(2000) == [(0, 2000)] and line(7777) == []


def test_whole_compaction_makes_one_file_of_any_size(spark, path):
    t = Table.create(spark, path, "id long, v string", properties={"rowTracking": True})
    for i in range(3):
        t.append(spark.range(i * 100, i * 100 + 100, 1, 4).select("id", F.concat(F.lit("v"), F.col("id") % 7).alias("v")))
    t.delete(col("id") < 10)
    before = sorted(map(tuple, t.scan_with_stable_ids().collect()))
    t.compact(small_bytes=1, target_bytes=1, most_files=2, whole=True)  # sizes and the most files of a plain compaction don't matter
    assert t.snapshot().files.select("dv").collect() == [(None,)]
    assert sorted(map(tuple, t.scan_with_stable_ids().collect())) == before and len(before) == 290
    assert ids(t.scan(filter=col("id") == 150)) == [150]


def test_whole_compaction_keeps_partitions_apart(spark, path):
    t = Table.create(spark, path, "id long, region string", partition_by=["region"])
    t.append(spark.createDataFrame([(i, r) for i, r in enumerate(("us", "a/b c%", None, "us", "a/b c%", None))], t.schema).repartition(3))
    t.append(spark.createDataFrame([(6, "us")], t.schema))
    t.compact(whole=True)
    assert t.snapshot().files.count() == 3 and ids(t.scan()) == list(range(7)) and ids(t.scan(filter=col("region") == "us")) == [0, 3, 6]
