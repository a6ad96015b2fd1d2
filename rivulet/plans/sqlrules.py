"""Which delta rule a query in SQL text admits for a change of one of its tables.

The analyzed plan is followed from the root to the table's only occurrence.  On
that way rows are filtered, projected, joined, or gathered by keys:

* no gathering: the query is linear in the table, so its change is the query
  over the inserted rows less the query over the deleted ones;
* every gathering operator (GROUP BY, PARTITION BY, DISTINCT) holds some columns
  of the table unchanged among its keys: rows of one key value never meet those
  of another, so only the touched values are evaluated, new minus old;
* anything else (a limit, a null-padded side, a second occurrence, a subquery
  that reads the table, grouping sets, recursion): no rule.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Join types under which every result row comes from one row of that side.
KEEPS = {"left": {"Inner", "Cross", "LeftOuter", "LeftSemi", "LeftAnti"}, "right": {"Inner", "Cross", "RightOuter"}}
PASSING = {"SubqueryAlias", "Filter", "Sort", "Generate"}


class NoRule(Exception):
    pass


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _is_column(expr) -> bool:
    return _kind(expr) == "AttributeReference"


def _renamed(exprs, known: dict[int, str]) -> dict[int, str]:
    """Columns of the table that come out of a projection unchanged, by expression id."""
    out = {}
    for e in _items(exprs):
        source = e.child() if _kind(e) == "Alias" else e
        if _is_column(source) and source.exprId().id() in known:
            out[e.exprId().id()] = known[source.exprId().id()]
    return out


class _Way:
    """The way from the root to one table; keys: None while nothing gathers rows."""

    def __init__(self, table: str):
        self.table, self.keys = table.lower(), None

    def gather(self, own: set[str]) -> None:
        self.keys = own if self.keys is None else self.keys & own
        if not self.keys:
            raise NoRule

    def columns(self, node) -> dict[int, str] | None:
        """The table's columns that node's rows still hold, or None if the table is not below node."""
        kind = _kind(node)
        if kind == "View":
            if node.desc().identifier().table().lower() != self.table:
                return None
            return {a.exprId().id(): a.name() for a in _items(node.output())}
        below = [self.columns(c) for c in _items(node.children())]
        if all(b is None for b in below):
            return None
        if kind == "Join":
            side = "right" if below[0] is None else "left"
            if node.joinType().toString() not in KEEPS[side]:
                raise NoRule
            return below[0] if side == "left" else below[1]
        known = below[0]
        if kind in PASSING:
            return known
        if kind == "Project":
            return _renamed(node.projectList(), known)
        if kind == "Distinct":
            self.gather(set(known.values()))
            return known
        if kind in ("Aggregate", "Window"):
            by = node.groupingExpressions() if kind == "Aggregate" else node.partitionSpec()
            self.gather(set(_renamed_columns(by, known)))
            return _renamed(node.aggregateExpressions(), known) if kind == "Aggregate" else known
        raise NoRule


def _renamed_columns(exprs, known: dict[int, str]) -> list[str]:
    return [known[e.exprId().id()] for e in _items(exprs) if _is_column(e) and e.exprId().id() in known]


def way(query: DataFrame, table: str) -> list[str] | None:
    """[] if the query is linear in the table, its key columns if it can be kept by keys, None if neither."""
    plan = query._jdf.queryExecution().analyzed()
    text = plan.treeString()
    # The printed plan holds subqueries too, which the way below does not enter.
    if len(re.findall(rf"View \(`{re.escape(table)}`", text, re.IGNORECASE)) != 1 or "CTERelation" in text:
        return None
    found = _Way(table)
    try:
        if found.columns(plan) is None:
            return None
    except NoRule:
        return None
    return sorted(found.keys or ())
