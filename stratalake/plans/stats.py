"""Statistics of units (files, zones, row groups) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Characters of a string bound.
BOUND = 32


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths and types of the plain leaves, into structs at any depth."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{prefix}{f.name}.")
        elif isinstance(f.dataType, PLAIN):
            out.append((prefix + f.name, f.dataType))
    return out


def path(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def unit_stats(df: DataFrame, unit: Column | str, columns: list[str] | None = None, truncate: int | None = BOUND) -> DataFrame:
    """``unit, num_records`` and the structs ``min, max, null_count, nan_count, exact`` by leaf column, in one aggregation.

    Strings are cut to ``truncate`` characters: a cut lower bound is still a bound, a cut upper bound gets the largest code point behind it,
    and ``exact`` says that neither was cut. NaN counts as the largest number, as in Spark's order.
    """
    kinds = [(n, t) for n, t in leaves(df.schema) if columns is None or n in columns]
    # The set has one element; with it Spark hashes the units of a task, up to its threshold, where bounds of strings alone would make it sort all rows.
    aggs: list[Column] = [(F.count(F.lit(1)) * F.size(F.collect_set(F.lit(0)))).alias("num_records")]
    low, high, nulls, nans, exact = [], [], [], [], []
    for i, (n, t) in enumerate(kinds):
        c = path(n)
        aggs += [F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_h{i}"), F.count_if(c.isNull()).alias(f"_n{i}")]
        floats = isinstance(t, T.FloatType | T.DoubleType)
        if floats:
            aggs.append(F.count_if(F.isnan(c)).alias(f"_f{i}"))
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        if truncate and isinstance(t, T.StringType):
            exact.append(((F.length(a) <= truncate) & (F.length(b) <= truncate)).alias(n))
            a, b = F.substring(a, 1, truncate), F.when(F.length(b) > truncate, F.concat(F.substring(b, 1, truncate), F.lit("\U0010ffff"))).otherwise(b)
        else:
            exact.append(F.lit(True).alias(n))
        low.append(a.alias(n))
        high.append(b.alias(n))
        nulls.append(F.col(f"_n{i}").alias(n))
        nans.append((F.col(f"_f{i}") if floats else F.lit(0).cast("long")).alias(n))
    unit = F.col(unit) if isinstance(unit, str) else unit
    out = df.groupBy(unit.alias("unit")).agg(*aggs)
    return out.select("unit", "num_records", *[F.struct(*x).alias(n) for x, n in ((low, "min"), (high, "max"), (nulls, "null_count"), (nans, "nan_count"), (exact, "exact"))])


def zones(df: DataFrame, order: list[str], rows: int, held: list[DataFrame] | None = None) -> DataFrame:
    """The rows with ``zone`` and ``position``: runs of ``rows`` rows of a total order. Numbers come from counts of range partitions, so no task holds all rows. The ordered rows are persisted; ``held`` takes them, for a caller that lets them go."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.spark_partition_id().alias("_p")).persist()  # one set of range bounds for both uses
    if held is not None:
        held.append(ranged)
    within = Window.partitionBy("_p").orderBy(*order)
    counts = ranged.groupBy("_p").count()
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_b"))
    numbered = ranged.withColumn("_i", F.row_number().over(within)).join(F.broadcast(before), "_p")
    position = F.coalesce("_b", F.lit(0)) + F.col("_i") - 1
    return numbered.withColumn("position", position.cast("long")).withColumn("zone", F.floor(F.col("position") / rows).cast("long")).drop("_p", "_b", "_i")


def zone_stats(zoned: DataFrame, column: str, order: str = "position", zone: str = "zone") -> DataFrame:
    """Min, max, sum, nulls, NaNs, constancy and order of one column in every zone."""
    c, w = F.col(column), Window.partitionBy(zone).orderBy(order)
    marked = zoned.withColumn("_before", F.lag(c).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    falls = ~F.col("_first") & (F.col("_before") > c)
    ties = ~F.col("_first") & (F.col("_before") >= c)
    floats = isinstance(zoned.schema[column].dataType, T.FloatType | T.DoubleType)
    return marked.groupBy(zone).agg(
        F.count(F.lit(1)).alias("num_records"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.sum(c).alias("sum_value"), F.count_if(c.isNull()).alias("null_count"),
        (F.count_if(F.isnan(c)) if floats else F.lit(0).cast("long")).alias("nan_count"), (F.min(c).eqNullSafe(F.max(c)) & F.count_if(c.isNull()).isin(0)).alias("is_constant"), (F.count_if(falls) == 0).alias("is_sorted"), (F.count_if(ties) == 0).alias("is_strict_sorted"),
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each integer column: rows, distinct, min, max, constancy and the bits that values above the minimum need."""
    parts = []
    for c in columns:
        one = df.agg(F.count(F.lit(1)).alias("num_records"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("long").alias("min_value"), F.max(c).cast("long").alias("max_value"), F.count_if(F.col(c).isNull()).alias("null_count"))
        width = F.ceil(F.log2(F.col("max_value") - F.col("min_value") + 1)).cast("long")
        parts.append(one.select(F.lit(c).alias("column_name"), "*", (F.col("n_distinct") <= 1).alias("is_constant"), width.alias("bit_width")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dictionary_candidates(df: DataFrame, columns: list[str], share: float = 0.2) -> DataFrame:
    """Which columns have at most ``share`` distinct values for each value that is not null."""
    aggs = [a for c in columns for a in (F.count_distinct(c).alias(f"d_{c}"), F.count(c).alias(f"n_{c}"))]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"n_{c}").alias("n_values")) for c in columns])).alias("x")
    return one.select(rows).select("x.*").withColumn("is_candidate", F.col("n_distinct") <= share * F.col("n_values"))
