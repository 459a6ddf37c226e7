"""The numeric helpers of ``numeric`` as SQL text: a wide select of many derived columns is one
parsed expression each instead of hundreds of calls into the JVM."""
from __future__ import annotations


def half_up(e: str, digits: int) -> str:
    s = f"{10 ** digits}D"
    return f"(case when abs({e}) < 1e11D then floor(({e}) * {s} + 0.5D) / {s} else cast({e} as double) end)"


def clip(e: str, lo: float, hi: float) -> str:
    return f"(case when ({e}) is not null then least(greatest({e}, {float(lo)}D), {float(hi)}D) end)"


def mean(es: list[str]) -> str:
    """Mean of the present values, null when there is none."""
    total = " + ".join(f"coalesce({e}, 0D)" for e in es)
    n = " + ".join(f"(case when {e} is not null then 1 else 0 end)" for e in es)
    return f"(({total}) / nullif({n}, 0))"


def total(es: list[str]) -> str:
    """Sum of the present values, null when there is none."""
    return f"(case when coalesce({', '.join(es)}) is not null then {' + '.join(f'coalesce({e}, 0D)' for e in es)} end)"


def any_of(*conditions: str) -> str:
    """True when any condition is; an unknown condition counts as false."""
    return "(" + " or ".join(f"coalesce({c}, false)" for c in conditions) + ")"


def share_null(cols: list[str]) -> str:
    return "((" + " + ".join(f"int({c} is null)" for c in cols) + f") / {len(cols)}D)"
