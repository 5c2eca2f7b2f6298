"""Versioned tables: Parquet data files under a commit log, with time travel, DML, deletion masks, a change feed, schema evolution and maintenance."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import DEFAULT, Compiler, Expr, Registry, and_, col, lit
from ..plans.prune import NEVER, Pruner, Stats
from ..plans.stats import leaves, unit_stats, zones
from ..sources.files import concatenate
from .log import CHECKPOINT_EVERY, CommitConflict, Log, now_ms
from .schema import check_widening, drop_field, find_field, logical_type, physical_type, with_field
from .txn import WRITE_SERIALIZABLE, ConcurrentModification, ReadSet, conflict

ROW_ID, FEED_COLUMNS = "__row_id", ["_change_type", "_commit_version", "_commit_timestamp"]
READER, WRITER = 3, 7
#: Versions whose file lists a table object keeps.
KEPT = 4
#: Files of a version up to which their statistics are kept on the driver, so that planning a scan needs no job.
LOCAL_FILES = 20_000
FEATURES = {"deletionVectors", "columnMapping", "typeWidening", "rowTracking", "domainMetadata", "identityColumns", "changeDataFeed", "checkConstraints", "appendOnly", "inCommitTimestamp", "clustering", "variantType", "timestampNtz"}


@dataclass(frozen=True)
class Snapshot:
    """A table at a version."""

    version: int
    schema: T.StructType
    partition_by: list[str]
    properties: dict[str, str]
    domains: dict[str, str]
    transactions: dict[str, int]
    actions: DataFrame
    writer: tuple = (0, ())

    @cached_property
    def files(self) -> DataFrame:
        """Active files, replayed once for all reads of the version."""
        return Log.active(self.actions).persist()


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


class Table:
    """A table in a folder. Methods that change it commit one version; `scan` and the other readers are lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str, registry: Registry = DEFAULT, isolation: str = WRITE_SERIALIZABLE):
        self.spark, self.path, self.registry, self.isolation = spark, path, registry, isolation
        self.log = Log(spark, path)
        self._snapshots: dict[int, Snapshot] = {}
        self._parsed: dict[int, DataFrame] = {}
        self._held: list[DataFrame] = []

    # -- open and create ---------------------------------------------------------------------------------------------------------------
    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Iterable[str] = (), properties: dict[str, Any] | None = None, mapping: str = "none", clustering: Iterable[str] = ()) -> Table:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        partition_by, clustering = list(partition_by), list(clustering)
        if partition_by and clustering:
            raise ValueError("a table is partitioned or clustered, not both")
        for c in [*partition_by, *clustering]:
            if c not in schema.names:
                raise ValueError(f"no column {c!r}")
        if len(partition_by) == len(schema.names):
            raise ValueError("some column must not be a partition column")
        table, properties = cls(spark, path), {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (properties or {}).items()} | {"mapping": mapping}
        if mapping != "none":
            schema = logical_type(schema, fresh=True)
        actions = [{"protocol": {"minReaderVersion": READER, "minWriterVersion": WRITER, "readerFeatures": [], "writerFeatures": []}}, table._metadata(schema, partition_by, properties)]
        if clustering:
            actions.append({"domainMetadata": {"domain": "clustering", "configuration": json.dumps(clustering), "removed": False}})
        table._commit(actions, "CREATE TABLE", {}, -1, rebase=False)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, **more: Any) -> Table:
        table = cls(spark, path, **more)
        if table.log.latest() < 0:
            raise FileNotFoundError(f"no table at {path}")
        table.snapshot()
        return table

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: T.StructType | str, **more: Any) -> Table:
        if cls(spark, path).log.latest() >= 0:
            return cls.open(spark, path)
        return cls.create(spark, path, schema, **more)

    def refresh(self) -> Table:
        for version in list(self._snapshots):
            self._forget(version)
        return self

    def _forget(self, version: int) -> None:
        snap = self._snapshots.pop(version)
        self._parsed.pop(version, None)
        if "files" in snap.__dict__:
            snap.files.unpersist()

    @staticmethod
    def _metadata(schema: T.StructType, partition_by: list[str], properties: dict[str, str]) -> dict:
        return {"metaData": {"id": uuid.uuid4().hex, "name": None, "schemaString": schema.json(), "partitionColumns": partition_by, "configuration": properties, "createdTime": now_ms()}}

    @property
    def version(self) -> int:
        return self.log.latest()

    @property
    def schema(self) -> T.StructType:
        return self.snapshot().schema

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.log.latest() if version is None else version
        if version < 0 or version > self.log.latest():
            raise ValueError(f"no version {version}")
        if version not in self._snapshots:
            actions = self.log.actions(version)
            small = actions.where("metaData is not null or protocol is not null or domainMetadata is not null or txn is not null").select("version", "metaData", "protocol", "domainMetadata", "txn").orderBy("version").collect()
            meta = [r["metaData"] for r in small if r["metaData"]][-1]
            protocol = [r["protocol"] for r in small if r["protocol"]][-1]
            if protocol["minReaderVersion"] > READER or set(protocol["readerFeatures"] or ()) - FEATURES:
                raise ValueError(f"the table needs reader version {protocol['minReaderVersion']} and features {protocol['readerFeatures']}")
            domains: dict[str, str] = {}
            for r in small:
                if d := r["domainMetadata"]:
                    domains.pop(d["domain"], None) if d["removed"] else domains.update({d["domain"]: d["configuration"]})
            txns = {r["txn"]["appId"]: r["txn"]["version"] for r in small if r["txn"]}
            while len(self._snapshots) >= KEPT:
                self._forget(min(self._snapshots))
            self._snapshots[version] = Snapshot(version, T.StructType.fromJson(json.loads(meta["schemaString"])), list(meta["partitionColumns"] or []), dict(meta["configuration"] or {}), domains, txns, actions, (protocol["minWriterVersion"], tuple(protocol["writerFeatures"] or ())))
        return self._snapshots[version]

    def on(self, name: str, snap: Snapshot | None = None) -> bool:
        return (snap or self.snapshot()).properties.get(name, "false") == "true"

    # -- reads -------------------------------------------------------------------------------------------------------------------------
    def version_at(self, timestamp_ms: int) -> int:
        """The last version committed at or before a time."""
        rows = [(v, next(a["commitInfo"]["inCommitTimestamp"] for a in self.log.actions_of(v) if "commitInfo" in a)) for v in self.log.versions()]
        fit = [v for v, t in rows if t <= timestamp_ms]
        if not fit:
            raise ValueError("the table is younger than this time")
        return fit[-1]

    def _stats_type(self, snap: Snapshot) -> tuple[str, dict[str, T.DataType], dict[str, str]]:
        kinds = dict(leaves(physical_type(snap.schema)))
        names = dict(zip([n for n, _ in leaves(snap.schema)], kinds, strict=True))
        part = lambda of: "struct<" + ",".join(f"`{n}`:{of(t)}" for n, t in kinds.items()) + ">"
        own, long, flag = part(lambda t: t.simpleString()), part(lambda t: "bigint"), part(lambda t: "boolean")
        return f"struct<num_records:bigint,min:{own},max:{own},null_count:{long},nan_count:{long},exact:{flag}>", kinds, names

    def candidate_files(self, predicate: Expr | None = None, version: int | None = None) -> DataFrame:
        """Active files with ``verdict`` of the predicate from their statistics: 0 skip, 1 read and filter, 2 all rows match."""
        snap = self.snapshot(version)
        if predicate is None:
            return snap.files.withColumn("verdict", F.lit(2))
        _, kinds, names = self._stats_type(snap)
        parsed = self._with_stats(snap)
        types = {n: kinds[p] for n, p in names.items()}
        own = _Mapped(parsed.select("min", "max", "null_count", "nan_count", "exact", "num_records").schema, types, names)
        return parsed.withColumn("verdict", Pruner(own).verdict(predicate)).drop("_s", "num_records", "min", "max", "null_count", "nan_count", "exact")

    def _with_stats(self, snap: Snapshot) -> DataFrame:
        """Active files with parsed statistics, as local rows where the files are not too many."""
        if snap.version not in self._parsed:
            kind, kinds, _ = self._stats_type(snap)
            parsed = snap.files.select("*", F.from_json("stats", kind).alias("_s")).select("*", "_s.*")
            if kinds and snap.files.count() <= LOCAL_FILES:
                parsed = self.spark.createDataFrame(parsed.toArrow(), parsed.schema)
            self._parsed[snap.version] = parsed
        return self._parsed[snap.version]

    def _rows(self, snap: Snapshot, files: DataFrame | list, masks: bool = True) -> DataFrame:
        """Rows of files with ``_path``, ``_pos`` and ``_row_id``, without those that deletion masks hide."""
        found = files if isinstance(files, list) else files.select("path", "dv", "baseRowId").collect()
        physical = physical_type(snap.schema).add(ROW_ID, "long")
        if not found:
            return self.spark.createDataFrame([], T.StructType([*snap.schema.fields, T.StructField("_path", T.StringType()), T.StructField("_pos", T.LongType()), T.StructField("_row_id", T.LongType())]))
        root = self.log.store.uri
        raw = self.spark.read.schema(physical).parquet(*[f"{root}/{r['path']}" for r in found])
        at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        at = F.regexp_replace(at, "^file:/+", "file:/")
        prefix = root.replace("file:///", "file:/")
        rows = raw.select("*", F.substring(at, len(prefix) + 2, 1 << 20).alias("_path"), F.col("_metadata.row_index").alias("_pos"))
        bases = [(r["path"], r["baseRowId"]) for r in found if r["baseRowId"] is not None]
        if bases:
            rows = rows.join(F.broadcast(self.spark.createDataFrame(bases, "_path string, _base long")), "_path", "left")
        else:
            rows = rows.withColumn("_base", F.lit(None).cast("long"))
        rows = rows.select(*[_q(p.name).cast(f.dataType).alias(f.name) if p.dataType != f.dataType else _q(p.name).alias(f.name) for p, f in zip(physical.fields[:-1], snap.schema.fields, strict=True)], "_path", "_pos", F.coalesce(ROW_ID, F.col("_base") + F.col("_pos")).alias("_row_id"))
        masked = [(r["path"], r["dv"]) for r in found if r["dv"]]
        if masks and masked:
            rows = rows.join(self._mask(masked), ["_path", "_pos"], "left_anti")
        return rows

    def _mask(self, pairs: list[tuple[str, str]]) -> DataFrame:
        """``_path, _pos`` of the rows that the files' current masks hide."""
        own = self.spark.createDataFrame(pairs, "_path string, dv string")
        all_ = self.spark.read.schema("_path string, _pos long, dv string").parquet(*[f"{self.log.store.uri}/{d}" for d in sorted({d for _, d in pairs})])
        return all_.join(F.broadcast(own), ["_path", "dv"], "left_semi").select("_path", "_pos")

    def scan(self, columns: list[str] | None = None, filter: Expr | None = None, version: int | None = None, timestamp_ms: int | None = None, row_ids: bool = False) -> DataFrame:
        """Rows that match the filter, which also leaves out files that can't match. With ``row_ids``, ``row_id`` is the file's ordinal by path << 40 | position, valid in this snapshot only."""
        if timestamp_ms is not None:
            version = self.version_at(timestamp_ms)
        snap = self.snapshot(version)
        files = self.candidate_files(filter, snap.version)
        found = files.where(F.col("verdict") != NEVER).select("path", "dv", "baseRowId").collect()
        rows = self._rows(snap, found)
        if filter is not None:
            rows = rows.where(Compiler(snap.schema, self.registry).column(filter))
        names = [F.col(c) if "." in c else _q(c) for c in columns or snap.schema.names]
        if row_ids:
            order = sorted(r["path"] for r in snap.files.select("path").collect())
            ordinals = self.spark.createDataFrame([(p, i) for i, p in enumerate(order)] or [("", 0)], "_path string, _ordinal long")
            rows = rows.join(F.broadcast(ordinals), "_path")
            return rows.select(F.shiftleft("_ordinal", 40).bitwiseOR(F.col("_pos")).alias("row_id"), *names)
        return rows.select(*names)

    def scan_with_stable_ids(self, version: int | None = None) -> DataFrame:
        """Rows with ``_row_id``, which updates and compaction keep (row tracking)."""
        snap = self.snapshot(version)
        return self._rows(snap, snap.files).drop("_path", "_pos")

    def read_by_row_ids(self, ids: DataFrame) -> DataFrame:
        return self.scan(row_ids=True).join(ids.select("row_id").distinct(), "row_id", "left_semi")

    def row_range(self, offset: int, count: int, order: list[str], filter: Expr | None = None) -> DataFrame:
        """Rows offset to offset + count of the total order, after the filter."""
        return self.scan(filter=filter).orderBy(*order).offset(offset).limit(count)

    def history(self) -> DataFrame:
        """``version, timestamp, operation, operation_parameters``, oldest first."""
        root = self.log.store.uri
        rows = self.spark.read.schema("commitInfo struct<timestamp:long,operation:string,operationParameters:map<string,string>>").json([f"{root}/{Log.name(v)}" for v in self.log.versions()])
        return rows.where("commitInfo is not null").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("version"), F.col("commitInfo.timestamp").alias("timestamp"), F.col("commitInfo.operation").alias("operation"), F.col("commitInfo.operationParameters").alias("operation_parameters")).orderBy("version")

    # -- writes ------------------------------------------------------------------------------------------------------------------------
    def _commit(self, actions: list[dict], operation: str, parameters: dict, read_version: int, read: ReadSet | None = None, blind: bool = False, rebase: bool = True, attempts: int = 100) -> int:
        read, version = read or ReadSet(), read_version + 1
        snap = self.snapshot(read_version) if read_version >= 0 else None
        if snap and (snap.writer[0] > WRITER or set(snap.writer[1]) - FEATURES):
            raise ValueError(f"writing needs version {snap.writer[0]} and features {snap.writer[1]}")
        high = int(json.loads(snap.domains.get("rowTracking", '{"high": -1}'))["high"]) if snap and self.on("rowTracking", snap) else None
        given = actions
        for _ in range(attempts):
            actions = given if high is None else self._with_row_ids(given, high, version)
            before = 0
            if version > 0:
                before = next((a["commitInfo"]["inCommitTimestamp"] for a in self.log.actions_of(version - 1) if "commitInfo" in a), 0)
            now = now_ms()
            info = {"commitInfo": {"timestamp": now, "inCommitTimestamp": max(before + 1, now), "operation": operation, "operationParameters": {k: str(v) for k, v in parameters.items()}, "isBlindAppend": blind, "readVersion": read_version}}
            try:
                self.log.write(version, [info, *actions])
                break
            except CommitConflict:
                if not rebase:
                    raise ConcurrentModification("concurrentWrite", f"version {version} was taken") from None
                if kind := conflict(actions, read, self.log.actions_of(version), self.isolation):
                    raise ConcurrentModification(kind, f"version {version}") from None
                for a in self.log.actions_of(version):
                    if high is not None and (a.get("domainMetadata") or {}).get("domain") == "rowTracking":
                        high = int(json.loads(a["domainMetadata"]["configuration"])["high"])
                version += 1
        else:
            raise ConcurrentModification("tooManyAttempts")
        if version and version % CHECKPOINT_EVERY == 0:
            self.log.checkpoint(version)
        return version

    @staticmethod
    def _with_row_ids(actions: list[dict], high: int, version: int) -> list[dict]:
        """The actions of a commit with row ids for its new files, from the highest id of the version before: ids are given when the version is known, so no two commits and no two files share any."""
        out, start = [], high
        for a in actions:
            add = a.get("add")
            if add and add.get("baseRowId") is None:
                a = {"add": add | {"baseRowId": high + 1, "defaultRowCommitVersion": version}}
                high += json.loads(add["stats"])["num_records"]
            out.append(a)
        return out if high == start else [*out, {"domainMetadata": {"domain": "rowTracking", "configuration": json.dumps({"high": high}), "removed": False}}]

    def _aligned(self, df: DataFrame, snap: Snapshot, order: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
        """The rows in the table's schema, with defaults, generated and identity values, and constraints that raise; and the metadata that identity values move on."""
        extra = set(df.columns) - set(snap.schema.names) - {"_row_id"}
        if extra:
            raise ValueError(f"columns {sorted(extra)} are not in the table")
        identity = [f for f in snap.schema.fields if "identity.start" in f.metadata and f.name not in df.columns]
        actions: list[dict] = []
        if identity:
            df = zones(df, order or df.columns, 1, self._held).drop("zone")
            n, fields = df.count(), []
            for f in snap.schema.fields:
                if f in identity:
                    step, base = int(f.metadata["identity.step"]), f.metadata.get("identity.high")
                    first = int(f.metadata["identity.start"]) if base is None else int(base) + step
                    df = df.withColumn(f.name, (F.lit(first) + F.col("position") * step).cast(f.dataType))
                    f = T.StructField(f.name, f.dataType, f.nullable, f.metadata | ({"identity.high": first + (n - 1) * step} if n else {}))
                fields.append(f)
            df = df.drop("position")
            actions.append(self._metadata(T.StructType(fields), snap.partition_by, snap.properties))
        columns = []
        for f in snap.schema.fields:
            if f.name in df.columns:
                c = _q(f.name).cast(f.dataType)
            elif "generated" in f.metadata:
                c = F.expr(f.metadata["generated"]).cast(f.dataType)
            elif f.nullable:
                c = F.lit(None).cast(f.dataType)
            else:
                raise ValueError(f"column {f.name!r} must have values")
            if not f.nullable:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in {f.name}")).cast(f.dataType)).otherwise(c)
            columns.append(c.alias(f.name))
        out = df.select(*columns, *(["_row_id"] if "_row_id" in df.columns else []))
        for name, rule in snap.properties.items():
            if name.startswith("constraint."):
                first = out.columns[0]
                out = out.withColumn(first, F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.raise_error(F.lit(f"CHECK {name[11:]} fails")).cast(out.schema[first].dataType)).otherwise(_q(first)))
        return out, actions

    def _write(self, df: DataFrame, snap: Snapshot, data_change: bool = True, whole: bool = False) -> list[dict]:
        """Writes data files, with ``whole`` one of each partition, and returns their add actions, with statistics of every file."""
        physical = physical_type(snap.schema)
        columns = [_q(f.name).cast(p.dataType).alias(p.name) for f, p in zip(snap.schema.fields, physical.fields, strict=True)]
        tracked = "_row_id" in df.columns
        copies = [_q(c).alias(f"__part_{c}") for c in snap.partition_by]
        out = df.select(*columns, *([F.col("_row_id").alias(ROW_ID)] if tracked else []), *copies)
        if "clustering" in snap.domains:
            keys = [physical.fields[snap.schema.names.index(c)].name for c in json.loads(snap.domains["clustering"])]
            out = out.repartitionByRange(*[_q(k) for k in keys]).sortWithinPartitions(*[_q(k) for k in keys])
        folder = f"data/{uuid.uuid4().hex}"
        writer = out.write
        if copies:
            writer = writer.partitionBy(*[f"__part_{c}" for c in snap.partition_by])
        writer.parquet(f"{self.log.store.uri}/{folder}")
        while self._held:
            self._held.pop().unpersist()
        if whole:
            self._join(folder)
        return self._adds(folder, snap, data_change)

    def _join(self, folder: str) -> None:
        """Makes the files of each folder one."""
        parts: dict[str, list[str]] = {}
        for p in sorted(p for p, *_ in self.log.store.walk(folder) if p.endswith(".parquet")):
            parts.setdefault(p.rsplit("/", 1)[0], []).append(p)
        for at, names in parts.items():
            if len(names) > 1:
                concatenate(self.spark, [self.log.store.path(p) for p in names], self.log.store.path(f"{at}/whole-{uuid.uuid4().hex}.parquet"))
                for p in names:
                    self.log.store.delete(p)

    def _adds(self, folder: str, snap: Snapshot, data_change: bool) -> list[dict]:
        files = {p: (size, at) for p, size, at in self.log.store.walk(folder) if p.endswith(".parquet")}
        if not files:
            return []
        bare = [{"path": p, "dv": None, "baseRowId": None} for p in files]
        physical = T.StructType([T.StructField(p.name, p.dataType) for p in physical_type(snap.schema).fields])
        raw = self._rows(Snapshot(snap.version, physical, [], {}, {}, {}, snap.actions), bare)
        stats = unit_stats(raw.drop("_pos", "_row_id"), "_path", [n for n, _ in leaves(physical)])
        parts = {c: physical.names[snap.schema.names.index(c)] for c in snap.partition_by}
        made = stats.select("unit", "num_records", F.to_json(F.struct("num_records", "min", "max", "null_count", "nan_count", "exact")).alias("stats"), F.create_map(*[x for c, p in parts.items() for x in (F.lit(c), F.col("min").getField(p).cast("string"))] or [F.lit(""), F.lit("")]).alias("parts"))
        out = []
        for r in sorted(made.collect(), key=lambda r: r["unit"]):
            size, at = files[r["unit"]]
            out.append({"add": {"path": r["unit"], "partitionValues": {k: v for k, v in r["parts"].items() if k}, "size": size, "modificationTime": at, "dataChange": data_change, "stats": r["stats"]}})
        return out

    @staticmethod
    def _removes(rows: Iterable, data_change: bool = True) -> list[dict]:
        return [{"remove": {"path": r["path"], "dv": r["dv"], "deletionTimestamp": now_ms(), "dataChange": data_change, "partitionValues": dict(r["partitionValues"] or {})}} for r in rows]

    def append(self, df: DataFrame, transaction: tuple[str, int] | None = None, identity_order: list[str] | None = None, extra: Iterable[dict] = ()) -> int:
        """Adds rows. A transaction ``(application, version)`` that the table has seen already adds nothing."""
        snap = self.snapshot()
        actions = list(extra)
        if transaction:
            if snap.transactions.get(transaction[0], -1) >= transaction[1]:
                return snap.version
            actions.append({"txn": {"appId": transaction[0], "version": transaction[1], "lastUpdated": now_ms()}})
        rows, more = self._aligned(df, snap, identity_order)
        adds = self._write(rows, snap)
        return self._commit([*actions, *more, *adds], "WRITE", {"mode": "Append"}, snap.version, blind=True, rebase=not more)

    def _writable(self, snap: Snapshot) -> None:
        if self.on("appendOnly", snap):
            raise ValueError("the table is append-only")

    def _replace(self, df: DataFrame, gone: DataFrame, snap: Snapshot, mode: str, parameters: dict) -> int:
        self._writable(snap)
        rows, more = self._aligned(df, snap)
        old = gone.select("path", "dv", "partitionValues").collect()
        return self._commit([*more, *self._removes(old), *self._write(rows, snap)], "WRITE", {"mode": mode, **parameters}, snap.version, ReadSet(True), rebase=False)

    def overwrite(self, df: DataFrame) -> int:
        """Replaces all rows, in one attempt."""
        snap = self.snapshot()
        return self._replace(df, snap.files, snap, "Overwrite", {})

    def _of_partition(self, files: DataFrame, values: dict[str, Any]) -> DataFrame:
        for k, v in values.items():
            own = F.col("partitionValues").getItem(k)
            files = files.where(own.isNull() if v is None else own == F.lit(v).cast("string"))
        return files

    def overwrite_partitions(self, df: DataFrame, values: dict[str, Any]) -> int:
        """Replaces the rows of the named partition; rows outside of it are refused."""
        snap = self.snapshot()
        if set(values) - set(snap.partition_by):
            raise ValueError("not a partition column")
        for k, v in values.items():
            c = _q(k)
            df = df.withColumn(k, F.when(c.eqNullSafe(F.lit(v)), c).otherwise(F.raise_error(F.lit(f"row outside of partition {k}")).cast(df.schema[k].dataType)))
        return self._replace(df, self._of_partition(snap.files, values), snap, "OverwritePartitions", values)

    def dynamic_overwrite(self, df: DataFrame) -> int:
        """Replaces the partitions that the rows have values of."""
        snap = self.snapshot()
        if not snap.partition_by:
            raise ValueError("the table is not partitioned")
        kinds = {c: snap.schema[c].dataType for c in snap.partition_by}
        touched = df.select(*[_q(c).cast(t).cast("string").alias(c) for c, t in kinds.items()]).distinct()
        same = [F.col("partitionValues").getItem(c).eqNullSafe(touched[c]) for c in snap.partition_by]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        return self._replace(df, snap.files.join(touched, condition, "left_semi"), snap, "DynamicOverwrite", {})

    # -- delete and update -------------------------------------------------------------------------------------------------------------
    def _predicate(self, where: Expr | Column | Callable[[DataFrame], Column], snap: Snapshot, rows: DataFrame) -> Column:
        if isinstance(where, Expr):
            return Compiler(snap.schema, self.registry).column(where)
        return where if isinstance(where, Column) else where(rows)

    def _candidates(self, where: Any, snap: Snapshot) -> list:
        files = self.candidate_files(where if isinstance(where, Expr) else None, snap.version)
        return files.where(F.col("verdict") != NEVER).select("path", "dv", "baseRowId", "partitionValues", "stats", "size", "dvRows").collect()

    def _feed(self, rows: DataFrame, snap: Snapshot) -> list[dict]:
        """Writes change rows, with ``_change_type``, and returns their actions."""
        folder = f"_change_data/{uuid.uuid4().hex}"
        physical = physical_type(snap.schema)
        rows.select(*[_q(f.name).cast(p.dataType).alias(p.name) for f, p in zip(snap.schema.fields, physical.fields, strict=True)], "_change_type").write.parquet(f"{self.log.store.uri}/{folder}")
        return [{"cdc": {"path": p, "partitionValues": {}, "size": size}} for p, size, _ in self.log.store.walk(folder) if p.endswith(".parquet")]

    def delete(self, where: Expr | Column | Callable[[DataFrame], Column]) -> tuple[int, int]:
        """Deletes the rows for which the predicate is TRUE; returns their number and the version. Whole files go by metadata, parts of files by masks."""
        snap = self.snapshot()
        self._writable(snap)
        files = self._candidates(where, snap)
        rows = self._rows(snap, files)
        return self._change(snap, files, self._deleted(snap, files, rows.where(self._predicate(where, snap, rows))), "DELETE")

    def _change(self, snap: Snapshot, files: list, made: tuple[int, list[dict]], operation: str) -> tuple[int, int]:
        n, actions = made
        if not n:
            return 0, snap.version
        return n, self._commit(actions, operation, {}, snap.version, ReadSet(files={r["path"] for r in files}, matches=lambda add: True))

    def _deleted(self, snap: Snapshot, files: list, hit: DataFrame) -> tuple[int, list[dict]]:
        """The number of rows hit, and the actions that delete them."""
        counts = {r["_path"]: r["count"] for r in hit.groupBy("_path").count().collect()}
        if not counts:
            return 0, []
        touched = {r["path"]: r for r in files if r["path"] in counts}
        live = {p: json.loads(r["stats"])["num_records"] - (r["dvRows"] or 0) for p, r in touched.items()}
        partial = sorted(p for p in touched if counts[p] < live[p])
        actions = self._removes(touched.values())
        if partial:
            if snap.properties.get("deletionVectors", "true") == "false":
                raise ValueError("part of a file can be deleted with deletion vectors only")
            dv = f"_dv/{uuid.uuid4().hex}"
            new = hit.join(F.broadcast(self.spark.createDataFrame([(p,) for p in partial], "_path string")), "_path", "left_semi").select("_path", "_pos")
            old = [(p, touched[p]["dv"]) for p in partial if touched[p]["dv"]]
            if old:
                new = new.unionByName(self._mask(old))
            new.distinct().withColumn("dv", F.lit(dv)).write.parquet(f"{self.log.store.uri}/{dv}")
            for p in partial:
                r = touched[p]
                actions.append({"add": {"path": p, "partitionValues": dict(r["partitionValues"] or {}), "size": r["size"], "modificationTime": now_ms(), "dataChange": True, "stats": r["stats"], "dv": dv, "dvRows": (r["dvRows"] or 0) + counts[p], "baseRowId": r["baseRowId"]}})
        if self.on("changeDataFeed", snap):
            actions += self._feed(hit.withColumn("_change_type", F.lit("delete")), snap)
        return sum(counts.values()), actions

    def update(self, where: Expr | Column | Callable[[DataFrame], Column], values: dict[str, Expr | Column | Any]) -> tuple[int, int]:
        """Sets columns where the predicate is TRUE; files with such rows are written anew."""
        snap = self.snapshot()
        self._writable(snap)
        files = self._candidates(where, snap)
        return self._change(snap, files, self._updated(snap, files, *self._assigned(snap, files, where, values)), "UPDATE")

    def _assigned(self, snap: Snapshot, files: list, where: Any, values: dict[str, Any]) -> tuple[DataFrame, dict[str, Column]]:
        for c in values:
            if c not in snap.schema.names:
                raise ValueError(f"no column {c!r}")
        rows = self._rows(snap, files)
        hit = F.coalesce(self._predicate(where, snap, rows), F.lit(False))
        compiler = Compiler(snap.schema, self.registry)
        new = {c: (compiler.column(v) if isinstance(v, Expr) else v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()}
        return rows.withColumn("_hit", hit), new

    def _updated(self, snap: Snapshot, files: list, rows: DataFrame, new: dict[str, Column]) -> tuple[int, list[dict]]:
        """The number of rows hit, and the actions that write their files anew."""
        counts = {r["_path"]: r["count"] for r in rows.where("_hit").groupBy("_path").count().collect()}
        if not counts:
            return 0, []
        touched = [r for r in files if r["path"] in counts]
        own = rows.join(F.broadcast(self.spark.createDataFrame([(p,) for p in counts], "_path string")), "_path", "left_semi")
        after = own.select(*[F.when(F.col("_hit"), new[f.name].cast(f.dataType)).otherwise(_q(f.name)).alias(f.name) if f.name in new else _q(f.name) for f in snap.schema.fields], "_row_id", "_hit")
        written, _ = self._aligned(after.select(*snap.schema.names, "_row_id") if self.on("rowTracking", snap) else after.select(*snap.schema.names), snap)
        actions = [*self._removes(touched), *self._write(written, snap)]
        if self.on("changeDataFeed", snap):
            images = own.where("_hit").select(*snap.schema.names, F.lit("update_preimage").alias("_change_type")).unionByName(after.where("_hit").select(*snap.schema.names, F.lit("update_postimage").alias("_change_type")))
            actions += self._feed(images, snap)
        return sum(counts.values()), actions

    def _by_ids(self, snap: Snapshot, ids: DataFrame) -> tuple[list, DataFrame]:
        files = self._candidates(None, snap)
        order = sorted(r["path"] for r in files)
        ordinals = self.spark.createDataFrame([(p, i) for i, p in enumerate(order)] or [("", 0)], "_path string, _ordinal long")
        keyed = ids.withColumn("_ordinal", F.shiftright("row_id", 40)).withColumn("_pos", F.col("row_id").bitwiseAND(F.lit((1 << 40) - 1))).join(F.broadcast(ordinals), "_ordinal").drop("_ordinal", "row_id")
        return files, keyed

    def delete_by_row_ids(self, ids: DataFrame) -> tuple[int, int]:
        """Deletes rows by the transient ids of the current snapshot."""
        snap = self.snapshot()
        self._writable(snap)
        files, keyed = self._by_ids(snap, ids.select("row_id").distinct())
        return self._change(snap, files, self._deleted(snap, files, self._rows(snap, files).join(keyed, ["_path", "_pos"], "left_semi")), "DELETE BY ROW ID")

    def update_by_row_ids(self, values: DataFrame) -> tuple[int, int]:
        """Sets the columns of ``values`` in the rows of its ``row_id``; a NULL there leaves the old value."""
        snap = self.snapshot()
        self._writable(snap)
        files, keyed = self._by_ids(snap, values)
        names = [c for c in values.columns if c != "row_id"]
        rows = self._rows(snap, files).join(keyed.select("_path", "_pos", F.lit(True).alias("_hit"), *[_q(c).alias(f"_new_{c}") for c in names]), ["_path", "_pos"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        return self._change(snap, files, self._updated(snap, files, rows, {c: F.coalesce(_q(f"_new_{c}"), _q(c)) for c in names}), "UPDATE BY ROW ID")

    # -- change feed -------------------------------------------------------------------------------------------------------------------
    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Rows inserted, deleted and updated by the versions, from change files or from the files that commits add and remove. A version that is gone raises."""
        end = self.version if end is None else end
        snap, out = self.snapshot(end), None
        for v in range(start, end + 1):
            actions = self.log.actions_of(v)
            info = next(a["commitInfo"] for a in actions if "commitInfo" in a)
            for part in self._changes_of(snap, actions):
                part = part.select(*snap.schema.names, "_change_type", F.lit(v).cast("long").alias("_commit_version"), F.timestamp_millis(F.lit(info["inCommitTimestamp"])).alias("_commit_timestamp"))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], T.StructType([*snap.schema.fields, T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType())]))
        return out

    def _changes_of(self, snap: Snapshot, actions: list[dict]) -> list[DataFrame]:
        cdc = [a["cdc"]["path"] for a in actions if a.get("cdc")]
        if cdc:
            physical = physical_type(snap.schema)
            raw = self.spark.read.schema(physical.add("_change_type", "string")).parquet(*[f"{self.log.store.uri}/{p}" for p in cdc])
            return [raw.select(*[_q(p.name).cast(f.dataType).alias(f.name) for p, f in zip(physical.fields, snap.schema.fields, strict=False)], "_change_type")]
        row = lambda x: {"path": x["path"], "dv": x.get("dv"), "baseRowId": None}
        adds = {a["add"]["path"]: row(a["add"]) for a in actions if a.get("add") and a["add"].get("dataChange", True)}
        removes = {a["remove"]["path"]: row(a["remove"]) for a in actions if a.get("remove") and a["remove"].get("dataChange", True)}
        both, out = adds.keys() & removes.keys(), []
        if fresh := [r for p, r in adds.items() if p not in both]:
            out.append(self._rows(snap, fresh).withColumn("_change_type", F.lit("insert")))
        if gone := [r for p, r in removes.items() if p not in both]:
            out.append(self._rows(snap, gone).withColumn("_change_type", F.lit("delete")))
        if both:
            # A file that stays with a new mask has lost the rows that only the new mask hides.
            before = self._rows(snap, [removes[p] for p in sorted(both)])
            after = self._rows(snap, [adds[p] for p in sorted(both)]).select("_path", "_pos")
            out.append(before.join(after, ["_path", "_pos"], "left_anti").withColumn("_change_type", F.lit("delete")))
        return out

    # -- maintenance -------------------------------------------------------------------------------------------------------------------
    def compact(self, small_bytes: int = 32 << 20, target_bytes: int = 128 << 20, most_files: int = 100, masked: bool = True, whole: bool = False) -> int | None:
        """Rewrites small files, and with ``masked`` those with masks, into files near the target size; with ``whole`` all files of a partition into one, whatever the sizes. Rows stay the same. Returns the version, or None if there is nothing to do."""
        snap = self.snapshot()
        files = snap.files.select("path", "dv", "baseRowId", "partitionValues", "size").collect()
        groups: dict[tuple, list] = {}
        for r in sorted(files, key=lambda r: r["size"]):
            if whole or r["size"] < small_bytes or (masked and r["dv"]):
                groups.setdefault(tuple(sorted((r["partitionValues"] or {}).items(), key=str)), []).append(r)
        chosen = [r for g in groups.values() if len(g) >= 2 or g[0]["dv"] for r in g][: None if whole else most_files]
        if not chosen:
            return None
        rows = self._rows(snap, chosen)
        rows = rows.select(*snap.schema.names, *(["_row_id"] if self.on("rowTracking", snap) else []))
        if whole:  # written in parallel, then joined
            made = self._write(rows, snap, data_change=False, whole=True)
            return self._commit([*self._removes(chosen, False), *made], "OPTIMIZE", {}, snap.version, ReadSet(files={r["path"] for r in chosen}))
        n = max(1, -(-sum(r["size"] for r in chosen) // target_bytes))
        rows = rows.repartition(n, *[_q(c) for c in snap.partition_by]) if snap.partition_by else rows.coalesce(n)
        return self._commit([*self._removes(chosen, False), *self._write(rows, snap, data_change=False)], "OPTIMIZE", {}, snap.version, ReadSet(files={r["path"] for r in chosen}))

    def vacuum(self, retention_ms: int = 7 * 24 * 3600 * 1000, dry_run: bool = False) -> list[str]:
        """Deletes files that the current version doesn't need and that are older than the retention; returns them."""
        keep = set()
        for r in self.snapshot().files.select("path", "dv").collect():
            keep |= {r["path"], r["dv"]}
        cut = now_ms() - retention_ms
        gone = [p for folder in ("data", "_dv", "_change_data") for p, _, at in self.log.store.walk(folder) if p not in keep and p.rsplit("/", 1)[0] not in keep and at < cut]
        for p in [] if dry_run else gone:
            self.log.store.delete(p)
        return sorted(gone)

    def checkpoint(self) -> None:
        self.log.checkpoint(self.version)

    def compact_log(self, start: int, end: int) -> str:
        return self.log.compact(start, end)

    def restore(self, version: int) -> int:
        """Makes the files and schema of an earlier version current again."""
        snap, then = self.snapshot(), self.snapshot(version)
        old = {r["path"]: r for r in snap.files.collect()}
        new = {r["path"]: r for r in then.files.collect()}
        adds = [{"add": {k: v for k, v in r.asDict(recursive=True).items() if k != "version"} | {"dataChange": True}} for p, r in new.items() if p not in old or old[p]["dv"] != r["dv"]]
        removes = self._removes(r for p, r in old.items() if p not in new or new[p]["dv"] != r["dv"])
        return self._commit([self._metadata(then.schema, then.partition_by, then.properties), *removes, *adds], "RESTORE", {"version": version}, snap.version, ReadSet(True), rebase=False)

    def merge(self, source: DataFrame, on: list[str], update: bool = True, insert: bool = True) -> int:
        """Upserts rows by key; a key that comes twice in the source raises. Only files that may hold a key of the source's range are read; rows keep their stable ids."""
        snap = self.snapshot()
        self._writable(snap)
        source = source.persist()
        try:
            return self._merge(snap, source, on, update, insert)
        finally:
            source.unpersist()

    def _merge(self, snap: Snapshot, source: DataFrame, on: list[str], update: bool, insert: bool) -> int:
        if source.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError("the source has a key twice")
        bounds = source.agg(*[x for c in on for x in (F.min(_q(c)), F.max(_q(c)))]).first()
        ranges = [x for i, c in enumerate(on) if bounds[2 * i] is not None and bounds[2 * i] == bounds[2 * i] and bounds[2 * i + 1] == bounds[2 * i + 1] for x in (col(c) >= lit(bounds[2 * i]), col(c) <= lit(bounds[2 * i + 1]))]
        files = self._candidates(and_(*ranges) if ranges else None, snap)
        rows, marked = self._rows(snap, files), source.withColumn("_src", F.lit(True))
        names, feed = [c for c in source.columns if c not in on], self.on("changeDataFeed", snap)
        joined = rows.join(marked.select(*on, "_src", *[_q(c).alias(f"_new_{c}") for c in names]), on, "left")
        hit = {r["_path"] for r in joined.where("_src").select("_path").distinct().collect()} if update else set()
        touched = [r for r in files if r["path"] in hit]
        actions, images = self._removes(touched), []
        if touched:
            own = joined.join(F.broadcast(self.spark.createDataFrame([(p,) for p in sorted(hit)], "_path string")), "_path", "left_semi")
            kept = ["_row_id"] if self.on("rowTracking", snap) else []
            after = own.select(*[F.when(F.col("_src"), _q(f"_new_{f.name}").cast(f.dataType)).otherwise(_q(f.name)).alias(f.name) if f.name in names else _q(f.name) for f in snap.schema.fields], *kept, "_src")
            actions += self._write(self._aligned(after.drop("_src"), snap)[0], snap)
            images += [own.where("_src").select(*snap.schema.names, F.lit("update_preimage").alias("_change_type")), after.where("_src").select(*snap.schema.names, F.lit("update_postimage").alias("_change_type"))]
        if insert:
            fresh, more = self._aligned(source.join(rows.select(*on).distinct(), on, "left_anti"), snap)
            if feed and more:  # identity values are given once
                fresh = fresh.persist()
                self._held.append(fresh)
            actions += [*more, *self._write(fresh, snap)] if not feed else [*more, *self._feed_and_write(fresh, snap)]
        if feed and images:
            actions += self._feed(images[0].unionByName(images[1]), snap)
        return self._commit(actions, "MERGE", {}, snap.version, ReadSet(True), rebase=not any(a.get("metaData") for a in actions))

    def _feed_and_write(self, rows: DataFrame, snap: Snapshot) -> list[dict]:
        """Inserted rows as change rows and as data."""
        return [*self._feed(rows.withColumn("_change_type", F.lit("insert")), snap), *self._write(rows, snap)]

    # -- external writers --------------------------------------------------------------------------------------------------------------
    def stage(self, df: DataFrame) -> list[dict]:
        """Writes data files without committing them; `commit_staged` does, and gives row ids then. Identity values hold for the version that they were staged on only."""
        snap = self.snapshot()
        rows, more = self._aligned(df, snap)
        return [*more, *([{"staged": {"readVersion": snap.version}}] if more else []), *self._write(rows, snap)]

    def commit_staged(self, staged: list[dict], extra: Iterable[dict] = ()) -> int:
        bound = [a["staged"]["readVersion"] for a in staged if "staged" in a]
        actions = [a for a in staged if "staged" not in a]
        return self._commit([*actions, *extra], "WRITE", {"mode": "Append"}, bound[0] if bound else self.version, blind=True, rebase=not bound)

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- metadata ----------------------------------------------------------------------------------------------------------------------
    def _alter(self, schema: T.StructType | None = None, properties: dict[str, str] | None = None, operation: str = "ALTER TABLE") -> int:
        snap = self.snapshot()
        return self._commit([self._metadata(schema or snap.schema, snap.partition_by, properties or snap.properties)], operation, {}, snap.version, rebase=False)

    def set_properties(self, **values: Any) -> int:
        own = {k.replace("__", "."): str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
        return self._alter(properties=self.snapshot().properties | own)

    def set_domain(self, name: str, configuration: str | None) -> int:
        return self._commit([{"domainMetadata": {"domain": name, "configuration": configuration or "", "removed": configuration is None}}], "SET DOMAIN", {}, self.version)

    def add_column(self, name: str, kind: T.DataType | str, nullable: bool = True) -> int:
        """Adds a column, or with dots a field of a struct; rows written before have NULL there."""
        if not nullable:
            raise ValueError("a new column must be nullable")
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        field = T.StructField(name.split(".")[-1], kind)
        if self.snapshot().properties["mapping"] != "none":
            field = logical_type(T.StructType([field]), fresh=True).fields[0]
        return self._alter(with_field(self.schema, name, field))

    def _mapped(self) -> Snapshot:
        snap = self.snapshot()
        if snap.properties["mapping"] == "none":
            raise ValueError("renaming and dropping need column mapping")
        return snap

    def rename_column(self, old: str, new: str) -> int:
        snap = self._mapped()
        f = find_field(snap.schema, old)
        if old in snap.partition_by:
            raise ValueError("a partition column can't be renamed")
        return self._alter(with_field(snap.schema, old, T.StructField(new.split(".")[-1], f.dataType, f.nullable, f.metadata), replace=True))

    def drop_column(self, name: str) -> int:
        snap = self._mapped()
        if name in snap.partition_by or len(snap.schema.fields) == 1:
            raise ValueError("partition columns and the only column can't be dropped")
        return self._alter(drop_field(snap.schema, name))

    def widen_column(self, name: str, kind: T.DataType | str) -> int:
        """Changes a type to one that holds all values of the old; files stay as they are."""
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        f = find_field(self.schema, name)
        check_widening(f.dataType, kind)
        return self._alter(with_field(self.schema, name, T.StructField(f.name, kind, f.nullable, f.metadata), replace=True))


class _Mapped(Stats):
    """Statistics by physical names for predicates by logical ones."""

    def __init__(self, schema: T.StructType, types: dict[str, T.DataType], names: dict[str, str]):
        super().__init__(schema, types)
        self.names = names

    def known(self, name: str) -> bool:
        return name in self.names

    def low(self, name: str) -> Column:
        return super().low(self.names[name])

    def high(self, name: str) -> Column:
        return super().high(self.names[name])

    def nulls(self, name: str) -> Column:
        return super().nulls(self.names[name])

    def nans(self, name: str) -> Column:
        return super().nans(self.names[name])

    def exact(self, name: str) -> Column:
        return super().exact(self.names[name])


class Transaction:
    """Several appends, deletes and updates as one version; what they read is checked against commits that came in between. They all see the version that the transaction began on, so none may change a file that another changed."""

    def __init__(self, table: Table):
        self.table, self.snap = table, table.snapshot()
        self.actions: list[dict] = []
        self.read = ReadSet()
        self.rebase = True

    def append(self, df: DataFrame) -> Transaction:
        rows, more = self.table._aligned(df, self.snap)
        self.rebase = self.rebase and not more
        feed = self.table.on("changeDataFeed", self.snap)
        self.actions += [*more, *(self.table._feed_and_write if feed else self.table._write)(rows, self.snap)]
        return self

    def _row_level(self, files: list, made: tuple[int, list[dict]]) -> Transaction:
        before = {a["remove"]["path"] for a in self.actions if "remove" in a}
        if before & {a["remove"]["path"] for a in made[1] if "remove" in a}:
            raise ValueError("the transaction changes a file twice")
        self.read.files |= {r["path"] for r in files}
        self.read.matches = lambda add: True
        self.actions += made[1]
        return self

    def delete(self, where: Expr | Column | Callable[[DataFrame], Column]) -> Transaction:
        """Deletes the rows for which the predicate is TRUE."""
        self.table._writable(self.snap)
        files = self.table._candidates(where, self.snap)
        rows = self.table._rows(self.snap, files)
        return self._row_level(files, self.table._deleted(self.snap, files, rows.where(self.table._predicate(where, self.snap, rows))))

    def update(self, where: Expr | Column | Callable[[DataFrame], Column], values: dict[str, Expr | Column | Any]) -> Transaction:
        """Sets columns where the predicate is TRUE."""
        self.table._writable(self.snap)
        files = self.table._candidates(where, self.snap)
        return self._row_level(files, self.table._updated(self.snap, files, *self.table._assigned(self.snap, files, where, values)))

    def remove_files(self, where: Expr) -> Transaction:
        """Removes the files all of whose rows match; raises if a file matches in part."""
        files = self.table.candidate_files(where, self.snap.version).where(F.col("verdict") != NEVER).collect()
        if any(r["verdict"] == 1 for r in files):
            raise ValueError("a file matches in part")
        self.read.files |= {r["path"] for r in files}
        self.read.matches = lambda add: True
        self.actions += Table._removes(files)
        return self

    def commit(self) -> int:
        return self.table._commit(self.actions, "TRANSACTION", {}, self.snap.version, self.read, blind=not self.read.files, rebase=self.rebase)
