"""Questions over patients and reports: counts, trends, scope, choice of a report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def half_open_date_range(rows: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    """``start <= column < end``; bare literals, so the scan can prune and push down."""
    return rows.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def report_scope(
    reports: DataFrame,
    patient_id: str,
    test_types: list[str] | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Reports of a patient, optionally of some test types and of a year or month."""
    scoped = reports.where(F.col("patient_id") == patient_id)
    if test_types:
        scoped = scoped.where(F.col("test_type").isin(*test_types))
    if year and month:
        end = dt.date(year + month // 12, month % 12 + 1, 1)
        return half_open_date_range(scoped, "report_date", dt.date(year, month, 1), end)
    if year:
        return half_open_date_range(scoped, "report_date", dt.date(year, 1, 1), dt.date(year + 1, 1, 1))
    if month:
        return scoped.where(F.month("report_date") == month)
    return scoped


def patients_with_reports(
    patients: DataFrame, reports: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Number of patients with a report in the range.

    Report rows shrink to distinct patients (map-side first) before they meet the patient
    table, so a patient with very many reports does not weigh on the join.
    """
    seen = half_open_date_range(reports, "report_date", start, end).select("patient_id").distinct()
    return seen.join(patients.select("patient_id"), "patient_id", "left_semi").agg(
        F.count(F.lit(1)).alias("total_patients")
    )


def patients_per_year(reports: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        reports.where("report_date IS NOT NULL")
        .groupBy(F.year("report_date").alias("year"))
        .agg(count(F.col("patient_id")).alias("patients"))
    )


def patient_bitmaps(reports: DataFrame, number: str = "patient_no", period: str = "month") -> DataFrame:
    """(period, bucket, bitmap): the patients of each period as bitmaps that merge exactly.

    ``number`` is a whole number per patient; a bitmap of 4 KiB holds 32,768 consecutive ones,
    so numbers should lie close. Periods whose patients are all NULL keep an empty bitmap.
    """
    no = F.col(number).cast("bigint")
    return (
        reports.where("report_date IS NOT NULL")
        .groupBy(F.trunc("report_date", period).alias("period"), F.bitmap_bucket_number(no).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(no)).alias("bitmap"))
    )


def roll_up_bitmaps(bitmaps: DataFrame, unit: str = "year") -> DataFrame:
    """The same bitmaps for longer periods, from those alone."""
    return bitmaps.groupBy(F.trunc("period", unit).alias("period"), "bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap")
    )


def patients_of_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """(period, patients): exact numbers of distinct patients."""
    return bitmaps.groupBy("period").agg(F.sum(F.bitmap_count("bitmap")).alias("patients"))


def patient_sketches(reports: DataFrame, key: str = "patient_id", period: str = "month", lg_k: int = 14) -> DataFrame:
    """(period, sketch): patients of each period for any kind of key.

    Sketches of at most 2**lg_k registers; the relative standard error is near 1 / sqrt(2**lg_k).
    """
    return (
        reports.where("report_date IS NOT NULL")
        .groupBy(F.trunc("report_date", period).alias("period"))
        .agg(F.hll_sketch_agg(key, lg_k).alias("sketch"))
    )


def roll_up_sketches(sketches: DataFrame, unit: str = "year") -> DataFrame:
    """The same sketches for longer periods, from those alone."""
    return sketches.groupBy(F.trunc("period", unit).alias("period")).agg(F.hll_union_agg("sketch").alias("sketch"))


def patients_of_sketches(sketches: DataFrame) -> DataFrame:
    """(period, patients): estimated numbers of distinct patients."""
    return sketches.select("period", F.hll_sketch_estimate("sketch").alias("patients"))


def last_report_date(reports: DataFrame, patient_id: str | None = None) -> DataFrame:
    """Last report date of one patient (one row, NULL if none) or of every patient."""
    last = F.max("report_date").alias("last_seen_date")
    if patient_id is not None:
        return reports.where(F.col("patient_id") == patient_id).agg(last)
    return reports.groupBy("patient_id").agg(last)


def report_trend(reports: DataFrame, patient_id: str, test_type: str) -> DataFrame:
    """Reports per date of one patient and test type, oldest first."""
    rows = reports.where((F.col("patient_id") == patient_id) & (F.col("test_type") == test_type))
    return (
        rows.groupBy("report_date")
        .agg(F.count_distinct("report_id").alias("report_count"))
        .orderBy(F.col("report_date").asc_nulls_last())
    )


def report_trends(reports: DataFrame) -> DataFrame:
    """``report_trend`` of all patients and test types at once."""
    return reports.groupBy("patient_id", "test_type", "report_date").agg(
        F.count_distinct("report_id").alias("report_count")
    )


def prefer_text_else_pdf(texts: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Both kinds in one table, marked by ``is_text`` for ``latest_report``."""
    return texts.withColumn("is_text", F.lit(True)).unionByName(
        pdfs.withColumn("is_text", F.lit(False)), allowMissingColumns=True
    )


def latest_report(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One report per key: parsed text before PDF, then newest date, then report id.

    ``max_by`` combines before the shuffle; a window would sort every report of a key.
    """
    # A NULL date sorts below every date, which is what "newest, undated last" asks for.
    values = [c for c in candidates.columns if c not in keys]
    order = F.struct("is_text", "report_date", F.col("report_id"))
    best = F.max_by(F.struct(*values), order).alias("_v")
    return candidates.groupBy(*keys).agg(best).select(
        *keys, *[F.col(f"_v.{c}").alias(c) for c in values]
    )


def scan_summary(files: DataFrame, already: DataFrame) -> DataFrame:
    """Files scanned, matched by name, processed, and already tracked by content.

    ``files`` has ``report_id`` (NULL when the name does not match), ``sha256`` and ``path``.
    Of several files with one content the first path counts as new.
    """
    per_content = (
        files.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("n_all"), F.count("report_id").alias("n"))
        .join(already.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left")
    )
    repeats = F.when(F.col("_known"), F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0)))

    def total(value) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return per_content.agg(
        total("n_all").alias("scanned"),
        total("n").alias("matched"),
        total("n").alias("processed"),
        total(repeats).alias("already_tracked"),
    )


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a batch: total, succeeded, failed, success rate in percent (0 when empty)."""
    ok = F.count_if(F.col("ok"))
    total = F.count(F.lit(1))
    rate = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(ok * 100.0, total))
    return outcomes.agg(
        total.alias("total_files"), ok.alias("successful"), (total - ok).alias("failed"), rate.alias("success_rate")
    )


def batch_errors(outcomes: DataFrame) -> DataFrame:
    """Failed paths with their messages, as rows."""
    return outcomes.where(~F.col("ok")).select("path", "error")


def knowledge_insert_summary(results: DataFrame) -> DataFrame:
    """Files per status, and a total row with a NULL status (``level`` tells them apart)."""
    level = F.when(F.grouping("status") == 1, "total").otherwise("status")
    return (
        results.rollup("status")
        .agg(
            level.alias("level"),
            F.count(F.lit(1)).alias("n_files"),
            F.count_if(F.col("status") == "success").alias("successful"),
        )
        .select("level", "status", "n_files", "successful")
    )


def parse_log_summary(log: DataFrame) -> DataFrame:
    """Per status: files, mean, longest and median duration."""
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.round(F.avg("duration_sec"), 6).alias("avg_sec"),
        F.max("duration_sec").alias("max_sec"),
        F.percentile_approx("duration_sec", 0.5).alias("median_sec"),
    )
