"""Plan nodes: each knows its fields, costs and text, and builds a lazy DataFrame for Catalyst to optimise.

Every field has a column name of its own inside the plan, so equal names in two inputs never clash; a bare name means
the first field that bears it (a product's left input; an index join's right one).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldNotFound
from ..functions import cost
from ..functions.stats import StatInfo
from ..sources.catalog import Index
from . import ast

_ids = itertools.count()


@dataclass(frozen=True)
class Field:
    name: str
    kind: T.DataType
    column: str


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def equal(left: tuple[Column, T.DataType], right: tuple[Column, T.DataType]) -> Column:
    """Equality of comparable operands; a string never equals a number, which is no error."""
    (a, ka), (b, kb) = left, right
    if _number(ka) and _number(kb):
        return a == b
    return a == b if ka == kb else F.lit(False)


def condition(p: ast.Predicate, find: Callable[[str], tuple[Column, T.DataType]]) -> Column | None:
    """The predicate as a Column; none if it has no terms. An unknown field raises."""

    def side(x: ast.Expr) -> tuple[Column, T.DataType]:
        if isinstance(x, ast.Name):
            return find(x.name)
        return (F.lit(x.value), T.StringType()) if isinstance(x.value, str) else (F.lit(x.value), T.LongType())

    out = None
    for t in p.terms:
        c = equal(side(t.left), side(t.right))
        out = c if out is None else out & c
    return out


class Plan:
    fields: list[Field]

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def blocks(self) -> int:
        raise NotImplementedError

    def records(self) -> int:
        raise NotImplementedError

    def distinct(self, field: str) -> int:
        raise NotImplementedError

    def lookup(self) -> list[Field]:
        return self.fields

    def find(self, name: str) -> Field:
        for f in self.lookup():
            if f.name == name:
                return f
        raise FieldNotFound(name)

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def output(self) -> DataFrame:
        """The rows under the fields' own names."""
        return self.frame().select(*[F.col(f.column).alias(f.name) for f in self.fields])


class TablePlan(Plan):
    def __init__(self, name: str, df: DataFrame, stats: Callable[[], StatInfo]):
        self.name, self._df, self._stats = name, df, stats
        n = next(_ids)
        self.fields = [Field(f.name, f.dataType, f"c{n}_{i}") for i, f in enumerate(df.schema.fields)]

    def frame(self) -> DataFrame:
        return self._df.toDF(*[f.column for f in self.fields])

    def blocks(self) -> int:
        return self._stats().blocks

    def records(self) -> int:
        return self._stats().records

    def distinct(self, field: str) -> int:
        return self._stats().distinct_values(field)[0]

    def __str__(self) -> str:
        return f"scan table {self.name}"


class ProductPlan(Plan):
    def __init__(self, left: Plan, right: Plan):
        self.left, self.right = left, right
        self.fields = left.fields + right.fields

    def frame(self) -> DataFrame:
        # the dialect's only join form; equalities above make it a hash or merge join
        return self.left.frame().crossJoin(self.right.frame())

    def blocks(self) -> int:
        return cost.product_blocks(self.left.blocks(), self.left.records(), self.right.blocks())

    def records(self) -> int:
        return self.left.records() * self.right.records()

    def distinct(self, field: str) -> int:
        return (self.left if self.left.has(field) else self.right).distinct(field)

    def __str__(self) -> str:
        return f"join ({self.left}) to ({self.right})"


class SelectPlan(Plan):
    def __init__(self, plan: Plan, predicate: ast.Predicate):
        self.plan, self.predicate, self.fields = plan, predicate, plan.fields
        condition(predicate, self._side)  # an unknown field raises here

    def lookup(self) -> list[Field]:
        return self.plan.lookup()

    def _side(self, name: str) -> tuple[Column, T.DataType]:
        f = self.plan.find(name)
        return F.col(f.column), f.kind

    def frame(self) -> DataFrame:
        c = condition(self.predicate, self._side)
        return self.plan.frame() if c is None else self.plan.frame().where(c)

    def blocks(self) -> int:
        return self.plan.blocks()

    def records(self) -> int:
        return self.plan.records()

    def distinct(self, field: str) -> int:
        if self.predicate.equates_with_constant(field) is not None:
            return 1
        other = self.predicate.equates_with_field(field)
        return max(self.plan.distinct(field), self.plan.distinct(other)) if other else self.plan.distinct(field)

    def reduction_factor(self) -> int:
        """Product of the terms' selectivity divisors."""
        out = 1
        for t in self.predicate.terms:
            l, r = (self.plan.distinct(x.name) if isinstance(x, ast.Name) else None for x in (t.left, t.right))
            out *= cost.term_reduction(l, r, t.left == t.right)
        return min(out, cost.MOST)

    def __str__(self) -> str:
        return f"select from ({self.plan}) where {self.predicate if self.predicate.terms else 'true'}"


class ProjectPlan(Plan):
    """Unknown fields are dropped; a list of unknown fields only raises."""

    def __init__(self, plan: Plan, names: tuple[str, ...]):
        self.plan = plan
        self.fields = [plan.find(n) for n in names if plan.has(n)]
        if not self.fields:
            raise FieldNotFound(", ".join(names))

    def frame(self) -> DataFrame:
        return self.plan.frame().select(*dict.fromkeys(f.column for f in self.fields))

    def blocks(self) -> int:
        return self.plan.blocks()

    def records(self) -> int:
        return self.plan.records()

    def distinct(self, field: str) -> int:
        return self.plan.distinct(field)

    def __str__(self) -> str:
        return f"choose {', '.join(f.name for f in self.fields)} from ({self.plan})"


@dataclass(frozen=True)
class IndexInfo:
    """An index with its table's statistics."""

    index: Index
    of_table: Callable[[], StatInfo]
    per_block: int

    @property
    def stats(self) -> StatInfo:
        return self.of_table()

    def blocks(self) -> int:
        return cost.search_cost(self.index.kind, self.stats.blocks, self.per_block)

    def records(self) -> int:
        return self.stats.records // max(1, self.stats.distinct_values(self.index.field)[0])

    def distinct(self, field: str) -> int:
        return 1 if field != self.index.field else self.stats.distinct_values(field)[0]

    def __str__(self) -> str:
        return f"{self.index.name} on {self.index.table}({self.index.field}) using {self.index.kind}"


class IndexSelectPlan(Plan):
    """Rows of a table whose indexed field equals a constant; Parquet's statistics do the index's work."""

    def __init__(self, plan: TablePlan, info: IndexInfo, value: ast.Const):
        self.plan, self.info, self.value, self.fields = plan, info, value, plan.fields

    def frame(self) -> DataFrame:
        return SelectPlan(self.plan, ast.Predicate((ast.Term(ast.Name(self.info.index.field), self.value),))).frame()

    def blocks(self) -> int:
        return self.info.blocks() + self.records()

    def records(self) -> int:
        return self.info.records()

    def distinct(self, field: str) -> int:
        return self.info.distinct(field)

    def __str__(self) -> str:
        return f'index scan on "{self.info}"'


class IndexJoinPlan(Plan):
    """Left rows with the right rows whose indexed field equals a left field; equal names mean the right side's."""

    def __init__(self, left: Plan, right: TablePlan, info: IndexInfo, field: str):
        self.left, self.right, self.info, self.field = left, right, info, field
        self.fields = left.fields + right.fields
        left.find(field)

    def lookup(self) -> list[Field]:
        return self.right.fields + self.left.fields

    def frame(self) -> DataFrame:
        a, b = self.left.find(self.field), self.right.find(self.info.index.field)
        return self.left.frame().join(self.right.frame(), equal((F.col(a.column), a.kind), (F.col(b.column), b.kind)), "inner")

    def blocks(self) -> int:
        return cost.index_join_blocks(self.left.blocks(), self.left.records(), self.info.blocks(), self.records())

    def records(self) -> int:
        return self.left.records() * self.info.records()

    def distinct(self, field: str) -> int:
        return (self.right if self.right.has(field) else self.left).distinct(field)

    def __str__(self) -> str:
        return f'join ({self.left}) to ({self.right}) on index ("{self.info}")'
