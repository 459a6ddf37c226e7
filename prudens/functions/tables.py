"""Small literal tables. Built as VALUES relations so that Catalyst knows their size."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_table(spark: SparkSession, ddl: str, rows) -> DataFrame:
    """Driver-side configuration rows as a LocalRelation; ``ddl`` is ``"name type, ..."``."""
    cols = [c.strip().split(None, 1) for c in ddl.split(",")]
    if not rows:
        return spark.createDataFrame([], ddl)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast({n} as {t}) as {n}" for n, t in cols)
    return spark.sql(f"select {casts} from values {values} as t({', '.join(n for n, _ in cols)})")
