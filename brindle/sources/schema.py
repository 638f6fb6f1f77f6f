"""Field types, their Spark types, and the sizes that the catalog reports."""

from __future__ import annotations

from pyspark.sql import types as T

from ..plans.ast import FieldDef

#: Type codes of the catalog.
CODES = {"int64": 1, "varchar": 2, "int8": 3}
SPARK = {"int64": T.LongType(), "varchar": T.StringType(), "int8": T.ByteType()}


def spark_schema(fields: list[FieldDef]) -> T.StructType:
    return T.StructType([T.StructField(f.name, SPARK[f.kind], True, {"length": f.length} if f.kind == "varchar" else {}) for f in fields])


def size_of(f: FieldDef) -> int:
    """Bytes in a slot: 8, 1, or a length word and 4 bytes a character."""
    return 8 if f.kind == "int64" else 1 if f.kind == "int8" else 4 + 4 * f.length


def slot_size(fields: list[FieldDef]) -> int:
    """One flag byte and the fields."""
    return 1 + sum(map(size_of, fields))


def offsets(fields: list[FieldDef]) -> dict[str, int]:
    out, at = {}, 1
    for f in fields:
        out[f.name] = at
        at += size_of(f)
    return out


def rendered(fields: list[FieldDef]) -> str:
    return ", ".join(map(str, fields))
