"""The commit log of a table: one NDJSON file of actions a version, put in place only if absent, replayed as a DataFrame."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One nullable struct for each kind of action.
ACTIONS = (
    "add struct<path:string,partitionValues:map<string,string>,size:long,modificationTime:long,dataChange:boolean,stats:string,dv:string,dvRows:long,baseRowId:long,defaultRowCommitVersion:long>,"
    "remove struct<path:string,dv:string,deletionTimestamp:long,dataChange:boolean,partitionValues:map<string,string>>,"
    "cdc struct<path:string,partitionValues:map<string,string>,size:long>,"
    "metaData struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:long>,"
    "protocol struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>,writerFeatures:array<string>>,"
    "txn struct<appId:string,version:long,lastUpdated:long>,"
    "domainMetadata struct<domain:string,configuration:string,removed:boolean>,"
    "commitInfo struct<timestamp:long,inCommitTimestamp:long,operation:string,operationParameters:map<string,string>,isBlindAppend:boolean,readVersion:long>"
)
CHECKPOINT_EVERY = 10


class CommitConflict(Exception):
    """Another writer took the version, or changed what this one read."""


class Store:
    """Files of a table through Hadoop's file systems, so that any scheme works."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"
        self.uri = self._fs.makeQualified(self._path(self.root)).toString()

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def list(self, name: str) -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def walk(self, name: str = "") -> list[tuple[str, int, int]]:
        """Files below a folder: path relative to the root, bytes, time of change in ms."""
        p = self._path(self.root + ("/" + name if name else ""))
        if not self._fs.exists(p):
            return []
        found, it, cut = [], self._fs.listFiles(p, True), len(self.uri.rstrip("/")) + 1
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString()[cut:], s.getLen(), s.getModificationTime()))
        return found

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Writes a whole file under a name that no one has, or returns False. Readers never see half of it."""
        target, draft = self.path(name), self.path(f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._local:
            local = lambda p: p.toUri().getPath()
            try:
                os.link(local(draft), local(target))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri()).rename(draft, target, options)
            return True
        except Exception:
            if self._fs.exists(target):
                self._fs.delete(draft, False)
                return False
            raise

    def put(self, name: str, text: str) -> None:
        out = self._fs.create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Log:
    """Versions of a table and their actions. Checkpoints and compacted ranges stand in for the commits that they hold."""

    FOLDER = "_log"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @staticmethod
    def name(version: int) -> str:
        return f"{Log.FOLDER}/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.store.list(self.FOLDER) if (m := re.fullmatch(r"(\d{20})\.json", n)))

    def latest(self) -> int:
        v = self.versions()
        return v[-1] if v else -1

    def actions_of(self, version: int) -> list[dict]:
        return [json.loads(x) for x in self.store.read(self.name(version)).splitlines() if x]

    def write(self, version: int, actions: list[dict]) -> None:
        if not self.store.put_if_absent(self.name(version), "".join(json.dumps(a, ensure_ascii=False) + "\n" for a in actions)):
            raise CommitConflict(f"version {version} exists")

    def checkpoints(self) -> list[int]:
        return sorted(int(m[1]) for n in self.store.list(self.FOLDER) if (m := re.fullmatch(r"(\d{20})\.checkpoint", n)) and self.store.exists(f"{self.FOLDER}/{n}/_SUCCESS"))

    def compacted(self) -> list[tuple[int, int]]:
        return sorted((int(m[1]), int(m[2])) for n in self.store.list(self.FOLDER) if (m := re.fullmatch(r"(\d{20})\.(\d{20})\.compacted\.json", n)))

    def actions(self, version: int) -> DataFrame:
        """All actions up to a version with ``version``, the latest of a checkpoint's or compacted range's commits for those it stands for."""
        start = max((c for c in self.checkpoints() if c <= version), default=-1)
        root = self.store.uri
        parts, at, names = [], start + 1, []
        ranges = {a: b for a, b in self.compacted()}
        while at <= version:
            if at in ranges and ranges[at] <= version:
                names.append(f"{root}/{self.FOLDER}/{at:020d}.{ranges[at]:020d}.compacted.json")
                at = ranges[at] + 1
            else:
                names.append(f"{root}/{self.name(at)}")
                at += 1
        if names:
            of_file = F.regexp_extract(F.col("_metadata.file_name"), r"^(?:\d{20}\.(?=\d{20}\.compacted))?(\d{20})\.", 1).cast("long")
            parts.append(self.spark.read.schema(ACTIONS).json(names).withColumn("version", of_file))
        if start >= 0:
            parts.append(self.spark.read.parquet(f"{root}/{self.FOLDER}/{start:020d}.checkpoint").withColumn("version", F.lit(start).cast("long")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    @staticmethod
    def active(actions: DataFrame) -> DataFrame:
        """Files whose last action is an add: ``path, partitionValues, size, …, version``. Within a commit an add goes after a remove of its path."""
        own = actions.where("add is not null or remove is not null").select(F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().cast("int").alias("is_add"), "add", "version")
        last = own.groupBy("path").agg(F.max_by(F.struct("is_add", "add", "version"), F.struct("version", "is_add")).alias("x")).where("x.is_add = 1")
        return last.select("x.add.*", F.col("x.version").alias("version"))

    @staticmethod
    def reconciled(actions: DataFrame) -> DataFrame:
        """The last action for each file, writer, domain, and of metadata and protocol: what a checkpoint holds."""
        keyed = actions.withColumn("_key", F.coalesce(F.concat(F.lit("f:"), F.coalesce("add.path", "remove.path")), F.concat(F.lit("t:"), F.col("txn.appId")), F.concat(F.lit("d:"), F.col("domainMetadata.domain")), F.when(F.col("metaData").isNotNull(), "m"), F.when(F.col("protocol").isNotNull(), "p")))
        keyed = keyed.where("_key is not null").withColumn("_add", F.col("add").isNotNull().cast("int"))
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("version"), F.desc("_add")))
        return keyed.withColumn("_r", rank).where("_r = 1").drop("_r", "_key", "_add")

    def checkpoint(self, version: int) -> None:
        kept = self.reconciled(self.actions(version)).drop("version", "cdc", "commitInfo")
        kept.coalesce(8).write.mode("overwrite").parquet(f"{self.store.uri}/{self.FOLDER}/{version:020d}.checkpoint")

    def compact(self, start: int, end: int) -> str:
        """Folds a range of commits into one file of their last actions."""
        root = self.store.uri
        rows = self.spark.read.schema(ACTIONS).json([f"{root}/{self.name(v)}" for v in range(start, end + 1)])
        rows = rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})", 1).cast("long"))
        lines = self.reconciled(rows).drop("version", "cdc", "commitInfo")
        name = f"{self.FOLDER}/{start:020d}.{end:020d}.compacted.json"
        self.store.put(name, "\n".join(lines.toJSON().toLocalIterator()) + "\n")
        return name


def now_ms() -> int:
    return int(time.time() * 1000)
