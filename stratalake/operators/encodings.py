"""Column encodings as relational operators: what each stores, and how it is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_end(df: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """Runs of equal values in order: ``partition…, run, value, run_end`` with the 1-based end."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("_at", F.row_number().over(w)).withColumn("_new", (~F.lag(column).over(w).eqNullSafe(F.col(column)) | (F.col("_at") == 1)).cast("int"))
    runs = marked.withColumn("run", F.sum("_new").over(w).cast("long"))
    return runs.groupBy(*partition, "run").agg(F.first(column).alias("value"), F.max("_at").cast("long").alias("run_end"))


def delta(df: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """The rows with ``delta``, the difference to the value before; a partition's first value is its own."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def undelta(df: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum("delta").over(w))


def frame_of_reference(df: DataFrame, column: str, unit: str) -> DataFrame:
    """The rows with the unit's ``reference``, the ``offset`` from it, and the ``bit_width`` of the unit's offsets."""
    low = df.groupBy(unit).agg(F.min(column).alias("reference"), F.ceil(F.log2(F.max(column) - F.min(column) + 1)).cast("long").alias("bit_width"))
    return df.join(low, unit).withColumn("offset", F.col(column) - F.col("reference"))


def dictionary(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Codes by order of value, from 0, and the rows with ``code``. Codes come from one sorted list of distinct values: for columns with few of them."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    coded = values.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return coded, df.join(coded, column, "left")


def sparse(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The most frequent value (ties: the smallest) as ``fill``, and the rows that differ from it."""
    fill = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("fill"))
    return fill, df.crossJoin(F.broadcast(fill)).where(~F.col(column).eqNullSafe(F.col("fill"))) if fill.columns else df


def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    """Days since 1970, seconds of the day, and microseconds of the second."""
    c = F.col(column)
    return df.withColumns({"days": F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")), "seconds": (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long"), "micros": F.date_format(c, "SSSSSS").cast("long")})


def bit_width(low: int, high: int) -> int:
    return (high - low).bit_length()
