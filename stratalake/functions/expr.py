"""Predicates and expressions: a small tree, a factory that folds constants, and a compiler to Spark columns with SQL's three-valued logic."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expr:
    """A node; the operators of Python build comparisons and logic."""

    def __eq__(self, other):  # type: ignore[override]
        return compare("=", self, other)

    def __ne__(self, other):  # type: ignore[override]
        return compare("<>", self, other)

    def __lt__(self, other):
        return compare("<", self, other)

    def __le__(self, other):
        return compare("<=", self, other)

    def __gt__(self, other):
        return compare(">", self, other)

    def __ge__(self, other):
        return compare(">=", self, other)

    def __and__(self, other):
        return and_(self, other)

    def __or__(self, other):
        return or_(self, other)

    def __invert__(self):
        return not_(self)

    def __hash__(self):
        return id(self)

    def same(self, other):
        """Null-safe equality."""
        return compare("<=>", self, other)

    def starts_with(self, prefix):
        return StartsWith(self, as_expr(prefix))

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return IsNull(self, True)

    def is_nan(self):
        return IsNaN(self)

    def is_not_nan(self):
        return IsNaN(self, True)

    def isin(self, *values):
        return In(self, tuple(as_expr(v) for v in values))

    def not_in(self, *values):
        return In(self, tuple(as_expr(v) for v in values), True)


def _node(cls):
    return dataclass(frozen=True, eq=False)(cls)


@_node
class Ref(Expr):
    """A column by name; dots go into structs."""

    name: str


@_node
class Lit(Expr):
    value: Any
    type: T.DataType | str | None = None


@_node
class Call(Expr):
    """A function of the registry."""

    name: str
    args: tuple[Expr, ...]


@_node
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@_node
class StartsWith(Expr):
    left: Expr
    right: Expr
    negated: bool = False


@_node
class IsNull(Expr):
    child: Expr
    negated: bool = False


@_node
class IsNaN(Expr):
    child: Expr
    negated: bool = False


@_node
class In(Expr):
    child: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@_node
class And(Expr):
    parts: tuple[Expr, ...]


@_node
class Or(Expr):
    parts: tuple[Expr, ...]


@_node
class Not(Expr):
    child: Expr


@_node
class Bool(Expr):
    value: bool


TRUE, FALSE = Bool(True), Bool(False)


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def col(name: str) -> Ref:
    return Ref(name)


def lit(value: Any, type: T.DataType | str | None = None) -> Lit:
    return Lit(value, type)


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(as_expr(a) for a in args))


def compare(op: str, left: Any, right: Any) -> Compare:
    return Compare(op, as_expr(left), as_expr(right))


def and_(*parts: Expr) -> Expr:
    """Conjunction, flat and folded: TRUE vanishes, FALSE takes all; of nothing it is TRUE."""
    flat = [p for x in parts for p in (x.parts if isinstance(x, And) else (x,)) if p is not TRUE]
    if any(p is FALSE for p in flat):
        return FALSE
    return TRUE if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def or_(*parts: Expr) -> Expr:
    """Disjunction, flat and folded: FALSE vanishes, TRUE takes all; of nothing it is FALSE."""
    flat = [p for x in parts for p in (x.parts if isinstance(x, Or) else (x,)) if p is not FALSE]
    if any(p is TRUE for p in flat):
        return TRUE
    return FALSE if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def not_(x: Expr) -> Expr:
    """Negation, folded; a double one vanishes."""
    if isinstance(x, Bool):
        return FALSE if x.value else TRUE
    return x.child if isinstance(x, Not) else Not(x)


FLIP = {"=": "=", "<>": "<>", "<=>": "<=>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class Registry:
    """Functions by name, from columns to a column; a function that isn't registered can't be compiled."""

    def __init__(self):
        self._made: dict[str, tuple[Callable[..., Column], Callable[..., T.DataType] | T.DataType | None]] = {}

    def register(self, name: str, make: Callable[..., Column], returns: T.DataType | str | None = None) -> None:
        self._made[name.lower()] = make, T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._made

    def make(self, name: str, args: list[Column]) -> Column:
        if name not in self:
            raise KeyError(f"function {name!r} is not registered")
        return self._made[name.lower()][0](*args)

    def returns(self, name: str) -> T.DataType | None:
        return self._made[name.lower()][1] if name in self else None


def builtin() -> Registry:
    """A registry of the common scalar functions, all of them Spark's own."""
    r = Registry()
    string, integer = T.StringType(), T.IntegerType()
    for name in ("upper", "lower", "trim", "ltrim", "rtrim", "concat", "date_format", "substring", "replace", "reverse", "lpad", "rpad"):
        r.register(name, lambda *a, n=name: F.call_function(n, *a), string)
    for name in ("year", "month", "day", "hour", "minute", "second", "length", "dayofweek", "quarter"):
        r.register(name, lambda *a, n=name: F.call_function(n, *a), integer)
    for name in ("coalesce", "ifnull", "nullif", "abs", "round", "floor", "ceil", "greatest", "least", "mod", "power", "sqrt"):
        r.register(name, lambda *a, n=name: F.call_function(n, *a))
    r.register("if", lambda c, a, b: F.when(c, a).otherwise(b))
    r.register("case", lambda *a: reduce(lambda acc, i: acc.when(a[i], a[i + 1]), range(2, len(a) - 1, 2), F.when(a[0], a[1])).otherwise(a[-1] if len(a) % 2 else None))
    r.register("between", lambda x, a, b: x.between(a, b), T.BooleanType())
    r.register("like", lambda x, p: F.like(x, p), T.BooleanType())
    for name, op in (("add", lambda a, b: a + b), ("subtract", lambda a, b: a - b), ("multiply", lambda a, b: a * b), ("divide", lambda a, b: a / b), ("remainder", lambda a, b: a % b)):
        r.register(name, op)
    r.register("current_date", F.current_date, T.DateType())
    r.register("current_timestamp", F.current_timestamp, T.TimestampType())
    r.register("cast_long", lambda x: x.cast("long"), T.LongType())
    r.register("try_cast_int", lambda x: x.try_cast("int"), integer)
    return r


DEFAULT = builtin()


def literal_type(x: Lit) -> T.DataType:
    """Spark's type of a literal."""
    if x.type is not None:
        return T._parse_datatype_string(x.type) if isinstance(x.type, str) else x.type
    v = x.value
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        if -(2**31) <= v < 2**31:
            return T.IntegerType()
        return T.LongType() if -(2**63) <= v < 2**63 else T.DecimalType(38, 0)
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, decimal.Decimal):
        sign, digits, exponent = v.as_tuple()
        scale = max(0, -exponent)
        precision = max(len(digits) + max(0, exponent), scale, 1)
        if precision > 38:
            raise ValueError("decimals of more than 38 digits are refused, not rounded")
        return T.DecimalType(precision, scale)
    if isinstance(v, str | uuid.UUID):
        return T.StringType()
    if isinstance(v, bytes | bytearray):
        return T.BinaryType()
    if isinstance(v, dt.datetime):
        return T.TimestampType() if v.tzinfo else T.TimestampNTZType()
    if isinstance(v, dt.date):
        return T.DateType()
    if isinstance(v, dt.time):
        return T.LongType()
    raise TypeError(f"no literal of {type(v).__name__}")


def family(t: T.DataType | None) -> str | None:
    """Types of one family compare; None is a type that isn't known, "null" one that compares with all."""
    if t is None:
        return None
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return t.typeName().split("(")[0]


class Compiler:
    """Expressions to columns over a schema. Names are case-sensitive and must exist; operands of families that don't compare give NULL."""

    def __init__(self, schema: T.StructType, registry: Registry = DEFAULT, rename: Callable[[str], Column] | None = None):
        self.schema, self.registry = schema, registry
        self.rename = rename or (lambda name: F.col(".".join(f"`{p}`" for p in name.split("."))))

    def type_of(self, x: Expr) -> T.DataType | None:
        if isinstance(x, Ref):
            t: T.DataType = self.schema
            for part in x.name.split("."):
                found = [f for f in t.fields if f.name == part] if isinstance(t, T.StructType) else []
                if not found:
                    raise KeyError(f"no column {x.name!r}")
                t = found[0].dataType
            return t
        if isinstance(x, Lit):
            return literal_type(x)
        if isinstance(x, Call):
            return self.registry.returns(x.name)
        return T.BooleanType()

    def column(self, x: Expr, target: T.DataType | None = None) -> Column:
        """The column of an expression; with a target type, cast to it (decimals rescaled, dates to timestamps)."""
        out = self._column(x)
        return out if target is None else out.cast(target)

    def _comparable(self, *xs: Expr) -> bool:
        kinds = {family(self.type_of(x)) for x in xs} - {None, "null"}
        return len(kinds) <= 1

    def _column(self, x: Expr) -> Column:
        unknown = F.lit(None).cast("boolean")
        if isinstance(x, Ref):
            self.type_of(x)
            return self.rename(x.name)
        if isinstance(x, Lit):
            v = x.value
            if isinstance(v, dt.time):
                v = ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond
            elif isinstance(v, uuid.UUID):
                v = str(v)
            return F.lit(v).cast(literal_type(x))
        if isinstance(x, Call):
            return self.registry.make(x.name, [self._column(a) for a in x.args])
        if isinstance(x, Bool):
            return F.lit(x.value)
        if isinstance(x, Compare):
            if not self._comparable(x.left, x.right):
                if x.op == "<=>":
                    return self._column(x.left).isNull() & self._column(x.right).isNull()
                return unknown
            a, b = self._column(x.left), self._column(x.right)
            if x.op == "<=>":
                return a.eqNullSafe(b)
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]
        if isinstance(x, StartsWith):
            if not self._comparable(x.left, x.right):
                return unknown
            a, b = self._column(x.left), self._column(x.right)
            if family(self.type_of(x.left)) in ("string", None):
                out = F.startswith(a, b)
            else:
                out = F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
            return ~out if x.negated else out
        if isinstance(x, IsNull):
            a = self._column(x.child)
            return a.isNotNull() if x.negated else a.isNull()
        if isinstance(x, IsNaN):
            a, t = self._column(x.child), self.type_of(x.child)
            if t is not None and not isinstance(t, T.FloatType | T.DoubleType):
                return F.when(a.isNotNull(), F.lit(True)) if x.negated else F.lit(False)
            return F.when(a.isNotNull(), ~F.isnan(a)) if x.negated else F.coalesce(F.isnan(a), F.lit(False))
        if isinstance(x, In):
            a = self._column(x.child)
            if not x.values:
                return F.when(a.isNotNull(), F.lit(x.negated))
            fit = [v for v in x.values if self._comparable(x.child, v) and not (isinstance(v, Lit) and v.value is None)]
            out = a.isin(*[self._column(v) for v in fit]) if fit else F.when(a.isNotNull(), F.lit(False))
            if len(fit) < len(x.values):
                out = F.when(out, F.lit(True))
            return ~out if x.negated else out
        if isinstance(x, And):
            return reduce(lambda a, b: a & b, map(self._column, x.parts))
        if isinstance(x, Or):
            return reduce(lambda a, b: a | b, map(self._column, x.parts))
        if isinstance(x, Not):
            return ~self._column(x.child)
        raise TypeError(type(x).__name__)


def references(x: Expr) -> set[str]:
    """Names of the columns an expression reads."""
    if isinstance(x, Ref):
        return {x.name}
    children = [getattr(x, n) for n in ("left", "right", "child") if hasattr(x, n)]
    return set().union(*map(references, [*children, *getattr(x, "args", ()), *getattr(x, "parts", ()), *getattr(x, "values", ())])) if not isinstance(x, Lit) else set()


def keep(df, predicate: Expr, registry: Registry = DEFAULT):
    """Rows for which the predicate is TRUE."""
    return df.where(Compiler(df.schema, registry).column(predicate))
