"""Verdicts of predicates from statistics: a column over a frame of unit statistics that says never, maybe or always."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import FLIP, And, Bool, Call, Compare, Expr, In, IsNaN, IsNull, Lit, Not, Or, Ref, StartsWith, family, literal_type

NEVER, MAYBE, ALWAYS = 0, 1, 2


class Stats:
    """Where the statistics of a column lie. The default reads the structs that `unit_stats` makes."""

    def __init__(self, schema: T.StructType, types: dict[str, T.DataType]):
        self.types = types
        self.have = {f.name: f.dataType for f in schema.fields}

    def known(self, name: str) -> bool:
        return name in self.types and "min" in self.have and name in self.have["min"].names

    def _of(self, kind: str, name: str, default: Column) -> Column:
        return F.col(kind).getField(name) if kind in self.have and name in self.have[kind].names else default

    def low(self, name: str) -> Column:
        return F.col("min").getField(name)

    def high(self, name: str) -> Column:
        return F.col("max").getField(name)

    def rows(self) -> Column:
        return F.col("num_records")

    def nulls(self, name: str) -> Column:
        return self._of("null_count", name, F.lit(None).cast("long"))

    def nans(self, name: str) -> Column:
        return self._of("nan_count", name, F.lit(None).cast("long"))

    def exact(self, name: str) -> Column:
        return self._of("exact", name, F.lit(False))


class Pruner:
    """Compiles predicates to verdicts. What statistics can't decide is MAYBE; bounds that are absent decide nothing.

    ALWAYS means every row is TRUE, NEVER that none is (FALSE or NULL), so a negated NEVER says nothing unless the comparison has no NULLs.
    """

    def __init__(self, stats: Stats):
        self.s = stats

    def verdict(self, x: Expr) -> Column:
        return F.coalesce(self._verdict(x, False), F.lit(MAYBE))

    def _when(self, never: Column, always: Column) -> Column:
        return F.when(F.coalesce(never, F.lit(False)), NEVER).when(F.coalesce(always, F.lit(False)), ALWAYS).otherwise(MAYBE)

    def _verdict(self, x: Expr, negated: bool) -> Column:
        if isinstance(x, Bool):
            return F.lit(ALWAYS if x.value != negated else NEVER)
        if isinstance(x, Not):
            return self._verdict(x.child, not negated)
        if isinstance(x, And | Or):
            parts = [F.coalesce(self._verdict(p, negated), F.lit(MAYBE)) for p in x.parts]
            both = isinstance(x, And) != negated
            return parts[0] if len(parts) == 1 else (F.least if both else F.greatest)(*parts)
        if isinstance(x, Compare):
            return self._compare(x, negated)
        if isinstance(x, StartsWith):
            return self._prefix(x, negated != x.negated)
        if isinstance(x, IsNull):
            return self._null(x, negated != x.negated)
        if isinstance(x, IsNaN):
            return self._nan(x, negated, x.negated)
        if isinstance(x, In):
            op, values = ("<>" if negated != x.negated else "="), x.values
            if not values:
                return self._constant_unless_null(x.child, op == "<>")
            parts = [F.coalesce(self._compare(Compare(op, x.child, v), False), F.lit(MAYBE)) for v in values]
            return parts[0] if len(parts) == 1 else (F.greatest if op == "=" else F.least)(*parts)
        return F.lit(MAYBE)

    def _constant_unless_null(self, x: Expr, value: bool) -> Column:
        if not value:
            return F.lit(NEVER)
        if isinstance(x, Ref) and self.s.known(x.name):
            return F.when(self.s.nulls(x.name) == 0, ALWAYS).otherwise(MAYBE)
        return F.lit(MAYBE)

    OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}

    def _compare(self, x: Compare, negated: bool) -> Column:
        left, right, op = x.left, x.right, x.op
        if isinstance(left, Lit) and isinstance(right, Ref):
            left, right, op = right, left, FLIP[op]
        if isinstance(left, Lit) and isinstance(right, Lit):
            return self._fold(left, right, op, negated)
        if not (isinstance(left, Ref) and isinstance(right, Lit)) or not self.s.known(left.name):
            return F.lit(MAYBE)
        name, v, kind = left.name, right, self.s.types[left.name]
        nulls, rows = self.s.nulls(name), self.s.rows()
        if v.value is None:
            if op != "<=>":
                return F.lit(NEVER)
            return self._when(nulls == (rows if negated else 0), nulls == (0 if negated else rows))
        if family(kind) != family(literal_type(v)):
            return F.lit(MAYBE)
        low, high, exact, value = self.s.low(name), self.s.high(name), self.s.exact(name), F.lit(v.value).cast(literal_type(v))
        full = nulls == 0
        same = (low == value) & (high == value) & exact
        outside = (value < low) | (value > high)
        if op == "<=>":
            empty = nulls == rows
            return self._when(same & full, outside | empty) if negated else self._when(outside | empty, same & full)
        # A negated comparison is NULL where the comparison is, so it is the opposite one.
        op = self.OPPOSITE[op] if negated else op
        never = {"=": outside, "<>": same, "<": low >= value, "<=": low > value, ">": high <= value, ">=": high < value}[op]
        always = {"=": same, "<>": outside, "<": high < value, "<=": high <= value, ">": low > value, ">=": low >= value}[op]
        return self._when(never | (nulls == rows), always & full)

    @staticmethod
    def _fold(left: Lit, right: Lit, op: str, negated: bool) -> Column:
        a, b = left.value, right.value
        if op == "<=>":
            return F.lit(ALWAYS if (a == b) != negated else NEVER)
        if a is None or b is None or family(literal_type(left)) != family(literal_type(right)):
            return F.lit(NEVER)
        holds = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return F.lit(ALWAYS if holds != negated else NEVER)

    def _prefix(self, x: StartsWith, negated: bool) -> Column:
        if not (isinstance(x.left, Ref) and isinstance(x.right, Lit) and self.s.known(x.left.name) and isinstance(x.right.value, str)) or not isinstance(self.s.types[x.left.name], T.StringType):
            return F.lit(MAYBE)
        name, p = x.left.name, F.lit(x.right.value)
        low, high, full, gone = self.s.low(name), self.s.high(name), self.s.nulls(name) == 0, self.s.nulls(name) == self.s.rows()
        above = (low > p) & ~F.startswith(low, p)  # every value lies behind the last with the prefix
        inside = F.startswith(low, p) & F.startswith(high, p) & self.s.exact(name)
        outside = (high < p) | above
        return self._when(inside | gone, outside & full) if negated else self._when(outside | gone, inside & full)

    def _null(self, x: IsNull, negated: bool) -> Column:
        if not isinstance(x.child, Ref) or not self.s.known(x.child.name):
            return F.lit(MAYBE)
        nulls, rows = self.s.nulls(x.child.name), self.s.rows()
        return self._when(nulls == rows, nulls == 0) if negated else self._when(nulls == 0, nulls == rows)

    def _nan(self, x: IsNaN, negated: bool, not_nan: bool) -> Column:
        if not isinstance(x.child, Ref) or not self.s.known(x.child.name):
            return F.lit(MAYBE)
        n, nulls, rows = self.s.nans(x.child.name), self.s.nulls(x.child.name), self.s.rows()
        if negated == not_nan:  # is NaN: false for NULL; the negation of "is not NaN" is NULL there
            return self._when(n == 0, n == rows)
        if not_nan:  # is not NaN: NULL for NULL
            return self._when((n + nulls) == rows, (n == 0) & (nulls == 0))
        return self._when(n == rows, n == 0)


def verdicts(stats: DataFrame, predicate: Expr, types: dict[str, T.DataType]) -> DataFrame:
    """The statistics with ``verdict``: 0 skip, 1 read and filter, 2 read without filtering."""
    return stats.withColumn("verdict", Pruner(Stats(stats.schema, types)).verdict(predicate))


def bloom_units(df: DataFrame, unit: Column | str, column: str, values: list, bits: int = 1 << 16, probes: int = 3) -> DataFrame:
    """``unit, may_contain`` from Bloom filters of a column by unit: sets of bit numbers, probed with the values. No unit that has a value is missed."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    slots = lambda c: [F.pmod(F.xxhash64(F.lit(i), c), F.lit(bits)) for i in range(probes)]
    kind = df.schema[column].dataType
    marked = df.where(F.col(column).isNotNull()).select(unit.alias("unit"), F.explode(F.array(*slots(F.col(column)))).alias("slot"))
    # One bitmap of 32,768 bits for each bucket, as Spark's own bitmap functions have it.
    maps = marked.groupBy("unit", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    own = maps.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("maps"))
    has = lambda slot: F.coalesce(F.getbit(F.conv(F.hex(F.substring(F.element_at("maps", F.bitmap_bucket_number(slot)), (F.bitmap_bit_position(slot) / 8).cast("int") + 1, 1)), 16, 10).cast("long"), F.bitmap_bit_position(slot) % 8) == 1, F.lit(False))
    tests = [reduce(lambda a, b: a & b, [has(s) for s in slots(F.lit(v).cast(kind))]) for v in values if v is not None]
    return own.select("unit", (reduce(lambda a, b: a | b, tests) if tests else F.lit(False)).alias("may_contain"))


def bloom_verdict(predicate: Expr, probe) -> Column:
    """Walks AND, OR and NOT over Equal and IN of one column with values; ``probe(name, values)`` is a boolean column. NULL values and other nodes decide nothing."""
    if isinstance(predicate, And | Or):
        parts = [bloom_verdict(p, probe) for p in predicate.parts]
        return (F.least if isinstance(predicate, And) else F.greatest)(*parts)
    if isinstance(predicate, In) and not predicate.negated and isinstance(predicate.child, Ref):
        values = [v.value for v in predicate.values if isinstance(v, Lit)]
        if not values:
            return F.lit(NEVER)
        return F.lit(MAYBE) if None in values else F.when(probe(predicate.child.name, values), MAYBE).otherwise(NEVER)
    if isinstance(predicate, Compare) and predicate.op in ("=", "<=>"):
        a, b = (predicate.left, predicate.right) if isinstance(predicate.left, Ref) else (predicate.right, predicate.left)
        if isinstance(a, Ref) and isinstance(b, Lit) and b.value is not None:
            return F.when(probe(a.name, [b.value]), MAYBE).otherwise(NEVER)
    return F.lit(MAYBE)


def index_table(df: DataFrame, column: str, unit: str, offset: str) -> DataFrame:
    """A value index ``value, unit, row_offset`` in order of value."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.col(unit).alias("unit"), F.col(offset).alias("row_offset")).repartitionByRange("value").sortWithinPartitions("value")


def bitmap_table(df: DataFrame, column: str, unit: str) -> DataFrame:
    """A bitmap index ``value, units``: the units that hold each value. Its lists are of units, not of rows."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.col(unit).alias("unit")).distinct().groupBy("value").agg(F.sort_array(F.collect_set("unit")).alias("units"))


def index_units(indices: dict[str, DataFrame], predicate: Expr) -> DataFrame | None:
    """Units that may match by the indices, or None if they can't tell: AND intersects what is known, OR needs all its parts known."""
    if isinstance(predicate, And):
        known = [u for u in (index_units(indices, p) for p in predicate.parts) if u is not None]
        return reduce(lambda a, b: a.intersect(b), known) if known else None
    if isinstance(predicate, Or):
        parts = [index_units(indices, p) for p in predicate.parts]
        return None if any(p is None for p in parts) else reduce(lambda a, b: a.union(b), parts).distinct()
    if isinstance(predicate, In) and not predicate.negated and isinstance(predicate.child, Ref) and predicate.child.name in indices:
        values = [v.value for v in predicate.values if isinstance(v, Lit) and v.value is not None]
        return indices[predicate.child.name].where(F.col("value").isin(values)).select("unit").distinct()
    if isinstance(predicate, Compare) and predicate.op not in ("<>", "<=>"):
        left, right, op = predicate.left, predicate.right, predicate.op
        if isinstance(left, Lit):
            left, right, op = right, left, FLIP[op]
        if isinstance(left, Ref) and isinstance(right, Lit) and left.name in indices and right.value is not None:
            c, v = F.col("value"), F.lit(right.value)
            return indices[left.name].where({"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]).select("unit").distinct()
    return None


__all__ = ["ALWAYS", "MAYBE", "NEVER", "Call", "Pruner", "Stats", "bitmap_table", "bloom_units", "bloom_verdict", "index_table", "index_units", "verdicts"]
