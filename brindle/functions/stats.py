"""Table statistics: rows, blocks and approximate distinct values, with the refresh rule of the cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Block size, and how often a table's statistics are fetched before they are computed anew.
BLOCK_SIZE, REFRESH_AFTER = 8192, 100
#: Logarithm of the sketches' size; their error is below 1 %.
SKETCH = 14


@dataclass(frozen=True)
class StatInfo:
    blocks: int
    records: int
    distinct: dict[str, int]

    def distinct_values(self, field: str) -> tuple[int, bool]:
        return self.distinct.get(field, 0), field in self.distinct

    def __str__(self) -> str:
        return f"blocks: {self.blocks}, records: {self.records}, distinct values: {', '.join(f'{k}: {self.distinct[k]}' for k in sorted(self.distinct))}"


def countable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def hashable(name: str, kind: T.DataType) -> Column:
    """The column as a type that sketches take: integers as they are, others as text."""
    c = F.col(f"`{name}`")
    return c.cast("long") if isinstance(kind, T.IntegralType) else c.cast("string")


def table_stats(df: DataFrame, slot: int, block_size: int = BLOCK_SIZE) -> StatInfo:
    """One pass: a count and a sketch per column."""
    names = [f.name for f in df.schema.fields if countable(f.dataType)]
    row = df.agg(F.count(F.lit(1)), *[F.hll_sketch_estimate(F.hll_sketch_agg(hashable(c, df.schema[c].dataType), SKETCH)) for c in names]).first()
    per = max(1, block_size // slot)
    return StatInfo(-(-row[0] // per), row[0], {c: n or 0 for c, n in zip(names, row[1:], strict=True)})


class StatCache:
    """Statistics of a table's versions, kept for REFRESH_AFTER fetches; they never affect rows."""

    def __init__(self):
        self._kept: dict[str, list] = {}

    def get(self, table: str, version, compute) -> StatInfo:
        """`version` names the rows: what it was computed for is no answer for others."""
        entry = self._kept.get(table)
        if entry is None or entry[0] != version or entry[2] >= REFRESH_AFTER:
            entry = self._kept[table] = [version, compute(), 0]
        entry[2] += 1
        return entry[1]

    def clear(self) -> None:
        self._kept.clear()
