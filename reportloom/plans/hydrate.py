"""Report texts -> patients, reports, name evidence, observations, name index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from reportloom.functions import text as tx
from reportloom.operators import documents, merge, names, observations as obs
from reportloom.session import workspace


@dataclass(frozen=True)
class Store:
    """Current state of the record tables."""

    patients: DataFrame
    reports: DataFrame
    name_evidence: DataFrame
    observations: DataFrame


_KEYS = ["report_id", "patient_id", "test_type", "report_date", "src_path"]


PARTS = ("names", "observations")


def stage_reports(parsed: DataFrame, path: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Write what each report says (keys, and its name and value rows as asked) in one pass; read it back."""
    said = []
    if "names" in parts:
        said.append(tx.person_name(F.col("text")).alias("found"))
    if "observations" in parts:
        said.append(obs.observation_rows(F.col("text")).alias("rows"))
    rows = parsed.select(*_KEYS, *said)
    rows.write.mode("overwrite").parquet(path)
    return parsed.sparkSession.read.schema(rows.schema).parquet(path)


def hydrate(
    docs: DataFrame,
    store: Store,
    strict: bool = True,
    stage: str | None = None,
    parts: tuple[str, ...] = PARTS,
) -> tuple[Store, DataFrame | None]:
    """New table states and the name index for ``docs`` (report_id, path, text).

    The caller writes each state to a new path. The rows read from the texts are first written
    to ``stage`` (a new path in the shared folder unless given), so the texts are read once for
    all states and a lost task never re-reads them. ``parts`` says what is read from the texts:
    without "names", evidence and full names stay as they are and there is no index; without
    "observations", those stay.
    """
    parsed = documents.decompose_report_id(docs, strict=strict).withColumn("src_path", F.col("path"))
    rows = stage_reports(parsed, stage or workspace(docs.sparkSession, "hydrate"), parts)
    keyed = rows.select(*_KEYS)
    patients = merge.insert_if_absent(store.patients, keyed.select("patient_id"), ["patient_id"])
    reports = merge.upsert_reports(store.reports, keyed, ["src_path"])
    evidence, observations, index = store.name_evidence, store.observations, None
    if "names" in parts:
        found = rows.where("found IS NOT NULL").select(
            "patient_id", F.col("report_id").alias("source_report"), "found.name", "found.confidence"
        )
        evidence = merge.replace_observations(evidence, found, "source_report")
        patients = names.apply_canonical_name(patients, names.canonical_name(evidence))
        index = names.first_seen_name(found)
    if "observations" in parts:
        seen = rows.select("report_id", F.inline("rows"))
        observations = merge.replace_observations(observations, seen.withColumn("page", F.lit(None).cast("int")))
    return Store(patients, reports, evidence, observations), index


def bootstrap(files: DataFrame, store: Store, ingested: DataFrame, strict: bool = True, as_of: str | None = None):
    """PDF names -> (store, ingested files): parents, reports, content dedupe, seen dates.

    ``files`` has path, name, mtime, size_bytes, sha256. Files seen for the first time are
    marked with ``as_of`` as their ``ingested_at``.
    """
    parsed = documents.parse_report_filename(files, strict=strict).where("reject_reason IS NULL")
    keyed = parsed.withColumn("src_path", F.col("path"))
    patients = merge.insert_if_absent(store.patients, keyed.select("patient_id"), ["patient_id"])
    reports = merge.upsert_reports(store.reports, keyed.drop("name", "reject_reason"), ["src_path"])
    fresh = merge.dedupe_by_content_hash(
        keyed.select("sha256", "report_id", "patient_id", "src_path", "mtime", "size_bytes"),
        ingested, ["src_path"],
    )
    fresh = fresh.withColumn("ingested_at", F.lit(as_of).cast("timestamp"))
    tracked = ingested.unionByName(fresh, allowMissingColumns=True)
    dated = merge.backfill_seen_dates(patients, reports)
    return Store(dated, reports, store.name_evidence, store.observations), tracked
