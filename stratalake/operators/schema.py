"""Schema evolution: physical names, fields at any depth, type widening and reader-writer promotion."""

from __future__ import annotations

import uuid

from pyspark.sql import types as T

#: Integer and float types from narrow to wide, and what else each may become (fixed values).
WIDER = {
    "tinyint": {"smallint", "int", "bigint", "double"},
    "smallint": {"int", "bigint", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp_ntz"},
}
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}
#: Promotions between the types of a writer's and a reader's schema of messages (fixed values).
PROMOTIONS = {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}


def can_widen(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type is one of the new, read from files of the old."""
    if old == new:
        return True
    a, b = old.simpleString(), new.simpleString()
    if b in WIDER.get(a, ()):
        return True
    if isinstance(new, T.DecimalType):
        if isinstance(old, T.DecimalType):
            return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
        return a in DIGITS and new.precision - new.scale >= DIGITS[a]
    return False


def can_promote(old: T.DataType, new: T.DataType) -> bool:
    """The narrower rule of manifests: int to long, float to double, more digits at one scale, anything from unknown, date to timestamp."""
    if old == new or isinstance(old, T.NullType):
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale == old.scale and new.precision >= old.precision
    return (old.simpleString(), new.simpleString()) in {("int", "bigint"), ("float", "double"), ("date", "timestamp"), ("date", "timestamp_ntz")}


def check_widening(old: T.DataType, new: T.DataType) -> None:
    if not can_widen(old, new):
        raise ValueError(f"{old.simpleString()} can't become {new.simpleString()}")


def logical_type(schema: T.StructType, fresh: bool = False) -> T.StructType:
    """The schema with a physical name for every field that has none."""

    def field(f: T.StructField) -> T.StructField:
        kind = logical_type(f.dataType, fresh) if isinstance(f.dataType, T.StructType) else f.dataType
        have = f.metadata if "physicalName" in f.metadata else f.metadata | {"physicalName": f"c-{uuid.uuid4().hex}"}
        return T.StructField(f.name, kind, f.nullable, have)

    return T.StructType([field(f) for f in schema.fields])


def physical_type(schema: T.StructType) -> T.StructType:
    """The schema as files have it: physical names, all nullable."""

    def kind(t: T.DataType) -> T.DataType:
        return physical_type(t) if isinstance(t, T.StructType) else t

    return T.StructType([T.StructField(f.metadata.get("physicalName", f.name), kind(f.dataType), True) for f in schema.fields])


def find_field(schema: T.StructType, name: str) -> T.StructField:
    head, _, rest = name.partition(".")
    for f in schema.fields:
        if f.name == head:
            if not rest:
                return f
            if isinstance(f.dataType, T.StructType):
                return find_field(f.dataType, rest)
    raise KeyError(f"no column {name!r}")


def with_field(schema: T.StructType, name: str, field: T.StructField, replace: bool = False) -> T.StructType:
    """The schema with a field added at a path, or put in place of the one there."""
    head, _, rest = name.partition(".")
    fields, seen = [], False
    for f in schema.fields:
        if f.name == head and rest:
            f, seen = T.StructField(f.name, with_field(f.dataType, rest, field, replace), f.nullable, f.metadata), True
        elif f.name == head:
            if not replace:
                raise ValueError(f"column {name!r} exists")
            f, seen = field, True
        elif not rest and f.name == field.name:
            raise ValueError(f"column {field.name!r} exists")
        fields.append(f)
    if not seen:
        if rest or replace:
            raise KeyError(f"no column {name!r}")
        fields.append(field)
    return T.StructType(fields)


def drop_field(schema: T.StructType, name: str) -> T.StructType:
    head, _, rest = name.partition(".")
    find_field(schema, name)
    fields = []
    for f in schema.fields:
        if f.name != head:
            fields.append(f)
        elif rest:
            fields.append(T.StructField(f.name, drop_field(f.dataType, rest), f.nullable, f.metadata))
    return T.StructType(fields)


def identity(name: str, start: int = 1, step: int = 1) -> T.StructField:
    """A long column whose values the table makes."""
    if step == 0:
        raise ValueError("a step of 0 makes no new values")
    return T.StructField(name, T.LongType(), True, {"identity.start": start, "identity.step": step})
