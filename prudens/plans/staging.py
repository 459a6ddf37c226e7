"""Shared intermediates of a run, written once.

Several operators read the same feature table with different columns; Spark would recompute it
for each (differently pruned exchanges are not reused). A staged table is written to the shared
folder named by ``spark.checkpoint.dir``: it survives lost executors, cuts the lineage, and its
readers prune columns again.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="prudens-"))
    if root is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back.

    A staged table is read from its files alone, so the shuffles of its write are given back as soon as it ends; it is
    compressed with zstd, since it stays until the run ends.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/prudens/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
