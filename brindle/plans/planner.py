"""From a SELECT to a plan: views first, then tables; products left to right, one selection, one projection."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import ViewCycle
from . import ast
from .nodes import Plan, ProductPlan, ProjectPlan, SelectPlan, TablePlan
from .parser import parse_query


def plan(query: ast.Select, view: Callable[[str], str | None], table: Callable[[str], TablePlan], inside: tuple[str, ...] = ()) -> Plan:
    """view: a view's text or none; table: a table's plan. inside: the views that are being expanded."""

    def source(name: str) -> Plan:
        text = view(name)
        if text is None:
            return table(name)
        if name in inside:
            raise ViewCycle(" -> ".join([*inside, name]))
        return plan(parse_query(text), view, table, (*inside, name))

    out = source(query.tables[0])
    for name in query.tables[1:]:
        out = ProductPlan(out, source(name))
    return ProjectPlan(SelectPlan(out, query.where), query.fields)
