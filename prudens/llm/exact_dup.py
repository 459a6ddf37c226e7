"""Operator 11: exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step counts its key over all rows, combined before the shuffle, and only rows whose key occurs again go
on: a length that no other text has settles a text without hashing it, and a full hash is taken only of texts
whose length and first PREFIX characters occur together more than once. Equal means equal length and SHA-256.

Everything is DataFrame expressions. Rows find their group through ``lookup.attach``: groups with more than a
thousandth of all rows are broadcast, fewer than a thousand by their definition, and their rows are not moved.
What is written is one narrow table: id, full hash where one was needed, and what the caller wants carried.

Defined cases: null counts as empty, and all empty texts are one group. The row with the largest doc_id of a
group stays; null doc_ids are smaller than all others. Rows that repeat it are all marked ``kept``; ``dedup``
returns one of them. keep_id is null only where every doc_id of a group is. An empty table gives an empty
result. Further columns are ignored, whatever their names; ``dedup`` returns them untouched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudens.llm.common import Scratch
from prudens.llm.lookup import BROADCAST_ROWS, attach

PREFIX = 64


def classes(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False,
            carry: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``docs``: doc_id, keep_id, group_size, kept, and full_hash (null where none was needed).

    ``digest`` adds text_sha256 of every text; ``carry`` adds the whole input row as the struct ``row``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    rows = rows.withColumn("len", F.octet_length("text").cast("long"))
    many = F.count(F.lit(1))

    lengths = scratch.write(rows.groupBy("len").agg(many.alias("same_len")), "lengths")
    total = lengths.agg(F.sum("same_len")).first()[0] or 0
    rows = attach(rows, lengths.where("same_len > 1"), ["len"], "same_len", total, ["id"], broadcast_rows)

    head = F.xxhash64("len", F.substring("text", 1, prefix))
    rows = rows.withColumn("head", F.when(F.col("same_len").isNotNull(), head)).drop("same_len")
    heads = scratch.write(rows.where("head is not null").groupBy("head").agg(many.alias("same_head")).where("same_head > 1"), "heads")
    rows = attach(rows, heads, ["head"], "same_head", total, ["id"], broadcast_rows)

    full = F.sha2("text", 256)
    kept = ["id", *(["row"] if carry else [])]
    keyed = rows.select(*kept, F.when(F.col("same_head").isNotNull(), full).alias("full_hash"), *([full.alias("text_sha256")] if digest else []))
    keyed = scratch.write(keyed, "keyed")
    groups = keyed.where("full_hash is not null").groupBy("full_hash").agg(many.alias("n"), F.max("id").alias("keep")).where("n > 1")
    found = attach(keyed, scratch.write(groups, "groups"), ["full_hash"], "n", total, ["id"], broadcast_rows)
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"),
                        *[c for c in ("full_hash", "text_sha256", "row") if c in found.columns])


def dedup(docs: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """The input's rows and columns, one row of each group of equal texts."""
    found = classes(docs, scratch, carry=True, **how).where("kept")
    single = found.where("group_size = 1").select("row")
    one = found.where("group_size > 1").groupBy("full_hash").agg(F.first("row").alias("row")).select("row")
    return single.union(one).select("row.*")


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256)."""
    return classes(docs, scratch, digest=True).drop("full_hash")
