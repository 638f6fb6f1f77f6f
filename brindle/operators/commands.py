"""INSERT, UPDATE and DELETE as copy-on-write: checks, predicates and the rows of the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecuteError, FieldNotFound
from ..plans import ast
from ..plans.nodes import condition
from ..sources.schema import SPARK


def check_value(f: ast.FieldDef, value: ast.Const) -> None:
    """int64 takes any integer, int8 one from -127 to 127, varchar(n) a string of at most n characters."""
    ok = value.kind == f.kind or (f.kind == "int64" and value.kind == "int8")
    if not ok:
        raise ExecuteError(f"{f.name} is {f.kind}, the value {value.kind}")
    if f.kind == "varchar" and len(value.value) > f.length:
        raise ExecuteError(f"the value is longer than {f}")


def insert_row(fields: list[ast.FieldDef], stmt: ast.Insert) -> tuple:
    """The row; fields that the statement omits are 0 or empty."""
    if len(stmt.fields) != len(stmt.values):
        raise ExecuteError(f"{len(stmt.fields)} fields, {len(stmt.values)} values")
    known = {f.name: f for f in fields}
    for name, value in zip(stmt.fields, stmt.values, strict=True):
        if name not in known:
            raise FieldNotFound(f"{stmt.table}.{name}")
        check_value(known[name], value)
    given = dict(zip(stmt.fields, stmt.values, strict=True))
    return tuple(given[f.name].value if f.name in given else "" if f.kind == "varchar" else 0 for f in fields)


def matches(df: DataFrame, p: ast.Predicate) -> Column:
    """Never null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def find(name: str):
        if name not in kinds:
            raise FieldNotFound(name)
        return F.col(f"`{name}`"), kinds[name]

    c = condition(p, find)
    return F.lit(True) if c is None else F.coalesce(c, F.lit(False))


def deleted(df: DataFrame, stmt: ast.Delete) -> DataFrame:
    return df.where(~matches(df, stmt.where))


def check_sets(fields: list[ast.FieldDef], stmt: ast.Update) -> None:
    known = {f.name: f for f in fields}
    for name, value in stmt.sets:
        if name not in known:
            raise FieldNotFound(f"{stmt.table}.{name}")
        check_value(known[name], value)


def updated(df: DataFrame, fields: list[ast.FieldDef], stmt: ast.Update) -> DataFrame:
    known = {f.name: f for f in fields}
    hit, new = matches(df, stmt.where), dict(stmt.sets)  # of several values for a field the last counts
    return df.select(*[F.when(hit, F.lit(new[c].value).cast(SPARK[known[c].kind])).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])
