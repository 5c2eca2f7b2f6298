"""Manifests: stored entries of data and delete files with bounds by field id, and the plan of a scan over them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr
from ..plans.prune import NEVER, Pruner, Stats
from ..plans.stats import leaves, unit_stats

DATA, POSITIONS, EQUALITY = "data", "positions", "equality"
#: One row a file. ``target`` is the only data file that a file of positions is about, if it names one; bounds are casts to strings.
ENTRY = (
    "path string, content string, removed boolean, sequence long, partition map<string,string>, target string, num_records long,"
    "lower map<int,string>, upper map<int,string>, null_count map<int,long>, nan_count map<int,long>, exact map<int,boolean>"
)


class FieldStats(Stats):
    """Statistics of entries by field id, so that a renamed column keeps its bounds and a new one under an old name doesn't take them."""

    def __init__(self, types: dict[str, T.DataType], ids: dict[str, int]):
        self.types, self.ids = types, ids

    def known(self, name: str) -> bool:
        return name in self.ids and name in self.types

    def _at(self, kind: str, name: str) -> Column:
        return F.try_element_at(F.col(kind), F.lit(self.ids[name]))

    def low(self, name: str) -> Column:
        return self._at("lower", name).cast(self.types[name])

    def high(self, name: str) -> Column:
        return self._at("upper", name).cast(self.types[name])

    def nulls(self, name: str) -> Column:
        return self._at("null_count", name)

    def nans(self, name: str) -> Column:
        return self._at("nan_count", name)

    def exact(self, name: str) -> Column:
        return F.coalesce(self._at("exact", name), F.lit(False))


def data_entries(df: DataFrame, file: Column | str, ids: dict[str, int], sequence: int) -> DataFrame:
    """Entries of data files from their rows: ``file`` names each row's file, ``ids`` gives the columns with bounds their field ids."""
    kinds = dict(leaves(df.schema))
    names = [c for c in ids if c in kinds]
    s = unit_stats(df, file, names)
    by_id = lambda kind, to: F.map_from_arrays(F.array(*[F.lit(ids[c]) for c in names]), F.array(*[F.col(kind).getField(c).cast(to) for c in names]))
    return _entries(s.select(F.col("unit").cast("string").alias("path"), F.lit(DATA).alias("content"), F.lit(sequence).cast("long").alias("sequence"), "num_records", by_id("min", "string").alias("lower"), by_id("max", "string").alias("upper"), *[by_id(k, "long").alias(k) for k in ("null_count", "nan_count")], by_id("exact", "boolean").alias("exact")))


def _entries(df: DataFrame) -> DataFrame:
    """The rows in the columns of entries; those that are absent are null, ``removed`` false and ``partition`` empty."""
    kind = T._parse_datatype_string(ENTRY)
    absent = {"removed": F.lit(False), "partition": F.create_map().cast("map<string,string>")}
    return df.select(*[(F.coalesce(df[f.name], absent[f.name]) if f.name in absent else df[f.name]).cast(f.dataType).alias(f.name) if f.name in df.columns else absent.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


class Manifests:
    """Manifests in a folder, each a Parquet table of entries that never changes; a snapshot is a list of their names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, entries: DataFrame) -> str:
        name = f"manifest-{uuid.uuid4().hex}"
        _entries(entries).write.parquet(f"{self.root}/{name}")
        return name

    def entries(self, names: list[str]) -> DataFrame:
        """Live entries of a snapshot: for each path the last by sequence, and none if that one removes it (a removal goes after an entry of its sequence)."""
        if not names:
            return self.spark.createDataFrame([], ENTRY)
        raw = self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{n}" for n in names])
        last = raw.groupBy("path").agg(F.max_by(F.struct(*raw.columns), F.struct("sequence", "removed")).alias("x"))
        return last.select("x.*").where(~F.col("removed"))


def plan(entries: DataFrame, predicate: Expr, types: dict[str, T.DataType], ids: dict[str, int]) -> DataFrame:
    """``path, num_records, verdict, deletes`` of the data files that a scan reads: 1 read and filter, 2 all rows match.

    A file of positions applies to its target, or to the files of its partition, from its own sequence back; a file of equal rows to those of earlier
    sequences in its partition, or in all where it has none. Files of deletes are told apart by key before any join, so a data file meets its own only;
    their lists grow with the deletes that apply to it. Columns without a field id, and files without bounds, are read.
    """
    key = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    data = entries.where(F.col("content") == DATA).withColumn("verdict", Pruner(FieldStats(types, ids)).verdict(predicate)).where(F.col("verdict") != NEVER)
    data = data.select("path", "num_records", "verdict", "sequence", key("partition").alias("part"))
    other = entries.where(F.col("content") != DATA)
    scope = F.when(F.col("target").isNotNull(), F.concat(F.lit("f:"), "target")).when((F.col("content") == EQUALITY) & (F.size("partition") == 0), F.lit("all")).otherwise(F.concat(F.lit("p:"), key("partition")))
    # Equal rows go from files of earlier sequences only, so their last sequence is one less.
    deletes = other.select(F.col("path").alias("delete"), scope.alias("scope"), (F.col("sequence") - (F.col("content") == EQUALITY).cast("long")).alias("last"))
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("f:"), "path"), F.concat(F.lit("p:"), "part")))
    reach = data.select("path", "sequence", scopes.alias("scope")).join(deletes, "scope").where(F.col("sequence") <= F.col("last"))
    found = reach.groupBy("path").agg(F.array_sort(F.collect_set("delete")).alias("deletes"))
    return data.join(found, "path", "left").select("path", "num_records", "verdict", F.coalesce("deletes", F.array().cast("array<string>")).alias("deletes"))
