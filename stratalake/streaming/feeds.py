"""Streams into and out of tables: exactly-once appends, the change feed as a stream, windowed aggregates with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import Log
from ..operators.table import Table


def append_stream(source: DataFrame, table: Table, application: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends every micro-batch as one version; a batch that is delivered again is recognised by application and batch id."""

    def batch(df: DataFrame, batch_id: int) -> None:
        Table.open(df.sparkSession, table.path).append(df, transaction=(application, batch_id))

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_stream(spark: SparkSession, path: str, handle, checkpoint: str, start: int = 0) -> StreamingQuery:
    """Calls ``handle(changes, batch_id)`` with the change feed of the versions that came since the last batch, and ends when it has caught up.

    The stream reads the names of the commit files; the change rows of their versions are read as DataFrames.
    """
    files = spark.readStream.schema("value string").option("pathGlobFilter", "*[0-9].json").text(f"{path.rstrip('/')}/{Log.FOLDER}")
    versions = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})\.json$", 1).alias("v")).where("v <> ''")

    def batch(df: DataFrame, batch_id: int) -> None:
        own = sorted(int(r["v"]) for r in df.distinct().collect())
        own = [v for v in own if v >= start]
        if own:
            table = Table.open(df.sparkSession, path)
            out = table.changes(own[0], own[0])
            for v in own[1:]:
                out = out.unionByName(table.changes(v, v))
            handle(out, batch_id)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str = "10 minutes", gap: str | None = None) -> DataFrame:
    """Tumbling, sliding (``slide``) or session (``gap``) windows by keys; on a stream, rows later than the watermark are dropped."""
    stream = events.withWatermark(time, late)
    window = F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)
    return stream.groupBy(window.alias("window"), *keys).agg(*aggregates)


def distinct_within(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of a stream whose keys have not come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
