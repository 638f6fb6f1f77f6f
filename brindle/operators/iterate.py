"""Visiting rows, fields and values; a callback that returns true stops the visit."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row


def for_each(df: DataFrame, call: Callable[[Row], bool | None]) -> int:
    """Streams rows to the driver, a partition at a time; returns how many were visited."""
    n = 0
    for row in df.toLocalIterator():
        n += 1
        if call(row):
            break
    return n


def for_each_field(df: DataFrame, call: Callable[[str, Any], bool | None]) -> None:
    for f in df.schema.fields:
        if call(f.name, f.dataType):
            break


def for_each_value(df: DataFrame, row: Row, call: Callable[[str, Any, Any], bool | None]) -> None:
    for f, v in zip(df.schema.fields, row, strict=True):
        if call(f.name, f.dataType, v):
            break
