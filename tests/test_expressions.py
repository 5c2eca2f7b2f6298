"""Predicates: folding, three-valued logic, types that don't compare."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import types as T

from stratalake.functions.expr import FALSE, TRUE, And, Compiler, Not, Registry, and_, call, col, lit, not_, or_, references


def values(spark, rows, schema, x):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(Compiler(df.schema).column(x)).collect()]


def test_folding():
    a, b = col("a") > 1, col("b") > 1
    assert and_() is TRUE and or_() is FALSE
    assert and_(a, FALSE) is FALSE and or_(a, TRUE) is TRUE
    assert and_(a, TRUE) is a and or_(FALSE, b) is b
    assert not_(not_(a)) is a and not_(TRUE) is FALSE
    assert len(and_(and_(a, b), a).parts) == 3
    assert isinstance(and_(a, b), And) and isinstance(~a, Not)
    assert references(or_(a, col("c.d").isin(1, 2))) == {"a", "c.d"}


@pytest.mark.parametrize(
    ("x", "want"),
    [
        (col("x") == 1, [True, False, None]), (col("x") != 1, [False, True, None]), (lit(1) < col("x"), [False, True, None]), (col("x").same(None), [False, False, True]), (col("x").same(1), [True, False, False]),
        (col("x").isin(1, None), [True, None, None]), (col("x").not_in(1, None), [False, None, None]), (col("x").isin(), [False, False, None]), (col("x").not_in(), [True, True, None]),
        (col("x").is_null(), [False, False, True]), (col("x").is_not_null(), [True, True, False]), (~(col("x") == 1), [False, True, None]), ((col("x") == 1) | (col("x") == 2), [True, True, None]),
        ((col("x") == 1) & lit(None, "boolean").same(None), [True, False, None]), (col("x") == "1", [None, None, None]), (col("x") == dt.date(2020, 1, 1), [None, None, None]), (col("x") == decimal.Decimal("1.0"), [True, False, None]),
        (col("x") > 2**40, [False, False, None]), (col("x").starts_with("1"), [None, None, None]), (col("x").is_nan(), [False, False, False]),
    ],
)
def test_three_valued(spark, x, want):
    assert values(spark, [(1,), (2,), (None,)], "x int", x) == want


def test_floats_strings_and_times(spark):
    rows = [(float("nan"),), (1.0,), (None,), (float("inf"),), (-0.0,)]
    assert values(spark, rows, "x double", col("x").is_nan()) == [True, False, False, False, False]
    assert values(spark, rows, "x double", col("x").is_not_nan()) == [False, True, None, True, True]
    assert values(spark, rows, "x double", col("x") == 0.0) == [False, False, None, False, True]
    assert values(spark, rows, "x double", col("x") > 1.0) == [True, False, None, True, False]
    assert values(spark, [("ab",), ("b",), (None,), ("",)], "x string", col("x").starts_with("a")) == [True, False, None, False]
    assert values(spark, [("ab",), (None,)], "x string", ~col("x").starts_with("a")) == [False, None]
    assert values(spark, [(dt.date(1969, 12, 31),), (dt.date(2020, 1, 2),)], "x date", col("x") < dt.datetime(2020, 1, 1)) == [True, False]


def test_names_functions_and_targets(spark):
    df = spark.createDataFrame([(1, "x")], "a int, B string")
    with pytest.raises(KeyError):
        Compiler(df.schema).column(col("b") == "x")
    with pytest.raises(KeyError):
        Compiler(df.schema, Registry()).column(call("upper", col("B")))
    assert df.select(Compiler(df.schema).column(call("upper", col("B")))).first()[0] == "X"
    assert df.select(Compiler(df.schema).column(col("a"), T.DecimalType(5, 2))).first()[0] == decimal.Decimal("1.00")
    with pytest.raises(ValueError):
        Compiler(df.schema).column(lit(decimal.Decimal("1" * 39)))
