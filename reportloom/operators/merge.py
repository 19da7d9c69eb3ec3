"""Keeping tables current: insert-if-absent, upsert, replace, dedupe, key checks.

All return the new state of a table. A caller that stores tables as plain files writes the
result to a new path and swaps; nothing here overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is not there yet; existing rows stay as they are."""
    fresh = new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer per key. A plain aggregate, so copies combine before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    if sorted(order) == sorted(values):
        # The order is all there is: one copy of the values travels, not two.
        best = F.max(F.struct(*order)).alias("_v")
    else:
        best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def upsert(
    target: DataFrame, updates: DataFrame, keys: list[str], set_cols: list[str], order: list[str]
) -> DataFrame:
    """Insert new keys; for known keys overwrite ``set_cols`` (NULLs too), keep the rest."""
    latest = latest_per_key(updates, keys, order)
    new = latest.select(
        *keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in set_cols]
    )
    joined = target.join(new, keys, "full_outer")
    cols = [
        F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
        for c in target.columns
    ]
    return joined.select(*cols)


def upsert_reports(reports: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Last writer wins on four columns; ``pages`` keeps its value."""
    return upsert(
        reports, updates, ["report_id"], ["patient_id", "test_type", "report_date", "src_path"], order
    )


def replace_observations(old: DataFrame, new: DataFrame, key: str = "report_id") -> DataFrame:
    """New rows replace all old rows of their report; reports without new rows keep theirs."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dedupe_by_content_hash(files: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Files with a content not seen before, the first by ``order`` per content."""
    values = [c for c in files.columns if c != "sha256"]
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    fresh = files.groupBy("sha256").agg(first).join(known.select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", *[F.col(f"_v.{c}").alias(c) for c in values])


def first_last_seen(reports: DataFrame) -> DataFrame:
    return reports.groupBy("patient_id").agg(
        F.min("report_date").alias("min_date"), F.max("report_date").alias("max_date")
    )


def backfill_seen_dates(patients: DataFrame, reports: DataFrame) -> DataFrame:
    """first_seen / last_seen from report dates; patients without reports keep theirs.

    A patient with reports takes the aggregate even when it is NULL, as an update would.
    """
    seen = first_last_seen(reports).withColumn("_has", F.lit(True))
    joined = patients.join(seen, "patient_id", "left")
    return joined.withColumns(
        {
            "first_seen": F.when(F.col("_has"), F.col("min_date")).otherwise(F.col("first_seen")),
            "last_seen": F.when(F.col("_has"), F.col("max_date")).otherwise(F.col("last_seen")),
        }
    ).drop("min_date", "max_date", "_has")


def foreign_key_violations(child: DataFrame, parent: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    keys = parent.select(F.col(parent_key).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def cascade_delete(child: DataFrame, surviving: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Child rows that remain after their parents were deleted down to ``surviving``."""
    return child.join(surviving.select(F.col(parent_key).alias(column)), column, "left_semi")


def unprocessed(sources: DataFrame, outputs: list[DataFrame], key: str = "report_id") -> DataFrame:
    """Sources without an output in any of the given layouts."""
    rest = sources
    for done in outputs:
        rest = rest.join(done.select(key), key, "left_anti")
    return rest


def parse_cache_lookup(files: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """Files with ``cache_hit`` and the cached result (NULL on a miss)."""
    cached = cache.withColumn("_hit", F.lit(True))
    return files.join(cached, key, "left").withColumn(
        "cache_hit", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def retry_failed(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """Outcome per file after failed files were run again; the last attempt counts."""
    retried = second.join(first.where(~F.col("ok")).select(key), key, "left_semi")
    both = first.withColumn("attempt", F.lit(1)).unionByName(retried.withColumn("attempt", F.lit(2)))
    return latest_per_key(both, [key], ["attempt"])


def missing_keys(required: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct required rows that are not there (set difference)."""
    return required.subtract(have)
