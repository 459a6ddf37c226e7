"""Assembles oracle SQL: named fragments become WITH clauses in dependency order."""
from __future__ import annotations

import re

from suite.fixtures import VIEWS

FRAGMENTS: dict[str, str] = dict(VIEWS)


def fragment(name: str, sql: str) -> None:
    if name in FRAGMENTS:
        raise ValueError(f"fragment {name} defined twice")
    FRAGMENTS[name] = sql


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in FRAGMENTS if n in words]


def build(sql: str) -> str:
    """Prefix ``sql`` with every fragment it uses, directly or not."""
    order: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for n in _used(text):
            if n != me and n not in order:
                visit(FRAGMENTS[n], n)
                order.append(n)
    visit(sql, None)
    seen = list(dict.fromkeys(order))
    if not seen:
        return sql
    return "with " + ",\n".join(f"{n} as materialized ({FRAGMENTS[n]})" for n in seen) + "\n" + sql


def r(expr: str, n: int = 4) -> str:
    s = 10 ** n
    return f"(case when abs({expr}) < 1e11 then floor(({expr}) * {s}.0::double + 0.5::double) / {s}.0::double else {expr} end)"


def clip(expr: str, lo, hi) -> str:
    return f"(case when ({expr}) is not null then least(greatest(({expr}), {float(lo)}::double), {float(hi)}::double) end)"


def null_sum(*cols: str) -> str:
    total = " + ".join(f"coalesce({c}, 0.0::double)" for c in cols)
    return f"(case when coalesce({', '.join(cols)}) is not null then {total} end)"


def null_mean(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0.0::double)" for c in cols)
    n = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in cols)
    return f"(({total}) / nullif({n}, 0))"


def values(rows, cols: str) -> str:
    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return f"{v!r}::double"
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) as t({cols})"


def unpivot(source: str, ids: str, metrics: list[str]) -> str:
    """Long form including nulls, in plain UNION-free SQL."""
    names = ", ".join(f"'{m}'" for m in metrics)
    vals = ", ".join(f"cast({m} as double)" for m in metrics)
    return f"select {ids}, unnest([{names}]) as metric, unnest([{vals}]) as value from {source}"
