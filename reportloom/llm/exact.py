"""Exact dedup: groups by 128-bit content hash, then a comparison of bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import ROW, join_groups, stage_table


def normal_text(text: Column) -> Column:
    """``text`` without the characters 0x20 and 0x09 to 0x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _best(row: list[str], n: str = "group_size") -> list[Column]:
    """Rows of the group, and the doc_id (and row) with the most code points, then the smallest id."""
    first = F.struct(-F.col("_len"), F.col("doc_id").isNull(), F.col("doc_id"), *row)
    return [
        F.count(F.lit(1)).alias(n),
        F.min_by("doc_id", first).alias("keep_id"),
        *(F.min_by(r, first).alias("_keep_row") for r in row),
    ]


def exact_groups(docs: DataFrame, hashed=F.md5, by_row: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted; of equal texts the one with the
    most code points stays, then the smallest doc_id. A null text counts as empty, null doc_ids
    come last, and of rows that repeat the kept doc_id all but the first are dropped as well when
    their text is shorter (full copies of the kept row share its id and are marked kept).
    An empty table gives an empty result; other columns are not read. With ``by_row``, ``docs``
    and the result have the key of ``with_row_key``, and exactly one row of each group is kept.

    Only hashes are shuffled, but for groups of two and more: there the texts' smallest and
    largest form are found by pre-aggregation in each task, so a group as large as a third of
    the table sends one text per task. If they differ the hash has collided, and that group
    alone is grouped by the text itself. ``hashed`` can be replaced to test collisions.
    """
    body = normal_text(F.col("text"))
    row = [ROW] if by_row else []
    full = docs.select(
        *row,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_len"),
        body.alias("_body"),
    ).withColumn("_key", hashed("_body"))
    light = stage_table(
        full.select(*row, "doc_id", "_len", "_key", F.sha2("_body", 256).alias("text_sha256")), "hashes"
    )
    total = light.count()
    groups = stage_table(light.groupBy("_key").agg(*_best(row)), "groups")
    shared = groups.where("group_size > 1").select("_key")
    # Keys are 32 letters; up to this many are sent to the tasks, more are met by shuffle.
    if shared.count() <= 200_000:
        shared = F.broadcast(shared)
    collided = stage_table(
        full.join(shared, "_key", "left_semi")
        .groupBy("_key")
        .agg(F.min("_body").alias("low"), F.max("_body").alias("high"))
        .where("low <> high")
        .select("_key"),
        "collided",
    )
    wrong = collided.count()
    rows = light
    if wrong:
        # Compare whole texts where the hash says too much; the text digest names them after.
        fixed = (
            full.join(collided, "_key", "left_semi")
            .groupBy("_key", "_body")
            .agg(*_best(row))
            .select(F.sha2("_body", 256).alias("_key"), "group_size", "keep_id", *(["_keep_row"] if row else []))
        )
        groups = stage_table(groups.join(collided, "_key", "left_anti").unionByName(fixed, allowMissingColumns=True), "fixed")
        marked = collided.select(F.col("_key").alias("_bad"))
        rows = light.join(marked, light["_key"] == marked["_bad"], "left").select(
            *row, "doc_id", "_len", F.when(F.col("_bad").isNull(), F.col("_key")).otherwise(F.col("text_sha256")).alias("_key"), "text_sha256"
        )
    return join_groups(rows, groups, "_key", "group_size", total).select(
        *row,
        "doc_id",
        "keep_id",
        "group_size",
        (F.col(ROW) == F.col("_keep_row") if row else F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
