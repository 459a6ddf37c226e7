"""Registered queries with their SQL oracles."""
from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every ``q_*`` module; returns (queries, oracles). Oracles are put together once all fragments are known."""
    from suite.oracle import build
    from suite.registry import ORACLES, QUERIES
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"suite.{mod}")
    return QUERIES, {name: build(sql) for name, sql in ORACLES.items()}
