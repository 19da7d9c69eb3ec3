"""Keyed outputs and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.schemas import REQUIRED_TABLES


def formatted_reports(reports: DataFrame, order: list[str]) -> DataFrame:
    """(file_name, text): one row per file name, the last written text wins."""
    return reports.groupBy("file_name").agg(F.max_by("text", F.struct(*order)).alias("text"))


def missing_tables(spark: SparkSession, required=REQUIRED_TABLES, database: str | None = None) -> list[str]:
    prefix = f"{database}." if database else ""
    return sorted(name for name in required if not spark.catalog.tableExists(prefix + name))


def ensure_tables(
    spark: SparkSession,
    required: dict[str, str] = REQUIRED_TABLES,
    init: bool = False,
    database: str | None = None,
) -> None:
    """Create absent tables (``init``), else fail when one is missing."""
    missing = missing_tables(spark, required, database)
    if not init:
        if missing:
            raise LookupError(f"missing tables: {missing}; run once with init=True")
        return
    prefix = f"{database}." if database else ""
    for name in missing:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({required[name]}) USING parquet")


def save_bucketed(
    rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None, exchange: bool = True
) -> DataFrame:
    """``rows`` as the new table ``name`` in ``buckets`` files hashed by ``keys``; read back.

    Joins on ``keys`` read the buckets as they lie, so the functions of ``operators.merge`` move
    the updates only and never the stored rows. The result of such a join lies in buckets
    already: with ``exchange=False`` it is written as the next version without moving, and only
    rows added by a union make further files in their buckets. Choose ``buckets`` for the size the
    table will have; a table that meets this one should have the same number.
    """
    laid = rows.repartition(buckets, *keys) if exchange else rows
    writer = laid.write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)
