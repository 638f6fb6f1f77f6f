"""Statements and their parts; str() gives the canonical text, which parses back to the same statement."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import escape


@dataclass(frozen=True)
class Const:
    """An integer or a string. Integers from -127 to 127 are of type int8, others int64."""

    value: int | str

    @property
    def kind(self) -> str:
        return "varchar" if isinstance(self.value, str) else "int8" if -127 <= self.value <= 127 else "int64"

    def __str__(self) -> str:
        return f"'{escape(self.value)}'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Name:
    """A field."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Placeholder:
    """`?` (by position) or `:name`."""

    name: str | None

    def __str__(self) -> str:
        return "?" if self.name is None else f":{self.name}"


Expr = Const | Name | Placeholder


@dataclass(frozen=True)
class Term:
    left: Expr
    right: Expr

    def fields(self) -> list[str]:
        return [x.name for x in (self.left, self.right) if isinstance(x, Name)]

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


@dataclass(frozen=True)
class Predicate:
    """A conjunction of equalities; without terms it is true."""

    terms: tuple[Term, ...] = ()

    def conjoin(self, other: Predicate) -> Predicate:
        return Predicate(self.terms + other.terms)

    def applies_to(self, fields: set[str]) -> bool:
        return all(f in fields for t in self.terms for f in t.fields())

    def sub_select(self, fields: set[str]) -> Predicate:
        """The terms that need no other fields."""
        return Predicate(tuple(t for t in self.terms if set(t.fields()) <= fields))

    def sub_join(self, left: set[str], right: set[str]) -> Predicate | None:
        """The terms that need fields of both; none if there are no such terms."""
        own = tuple(t for t in self.terms if set(t.fields()) <= left | right and not set(t.fields()) <= left and not set(t.fields()) <= right)
        return Predicate(own) if own else None

    def equates_with_constant(self, field: str) -> Const | None:
        for t in self.terms:
            for a, b in ((t.left, t.right), (t.right, t.left)):
                if a == Name(field) and isinstance(b, Const):
                    return b
        return None

    def equates_with_field(self, field: str) -> str | None:
        for t in self.terms:
            for a, b in ((t.left, t.right), (t.right, t.left)):
                if a == Name(field) and isinstance(b, Name):
                    return b.name
        return None

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))


def _where(p: Predicate) -> str:
    return f" where {p}" if p.terms else ""


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]
    tables: tuple[str, ...]
    where: Predicate = Predicate()

    def __str__(self) -> str:
        return f"select {', '.join(self.fields)} from {', '.join(self.tables)}{_where(self.where)}"


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"insert into {self.table} ({', '.join(self.fields)}) values ({', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate = Predicate()

    def __str__(self) -> str:
        return f"delete from {self.table}{_where(self.where)}"


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Predicate = Predicate()

    def __str__(self) -> str:
        return f"update {self.table} set {', '.join(f'{f} = {v}' for f, v in self.sets)}{_where(self.where)}"


@dataclass(frozen=True)
class FieldDef:
    name: str
    kind: str  # int8, int64, varchar
    length: int = 0

    def __str__(self) -> str:
        return f"{self.name} {self.kind}" + (f"({self.length})" if self.kind == "varchar" else "")


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[FieldDef, ...]

    def __str__(self) -> str:
        return f"create table {self.table} ({', '.join(map(str, self.fields))})"


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Select

    def __str__(self) -> str:
        return f"create view {self.view} as {self.query}"


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    fields: tuple[str, ...]
    kind: str = "hash"

    def __str__(self) -> str:
        return f"create index {self.index} on {self.table} ({', '.join(self.fields)}) using {self.kind}"


Statement = Select | Insert | Delete | Update | CreateTable | CreateView | CreateIndex
