"""Counts over a folder of parsed reports; set REPORTLOOM_CORPUS to run them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from reportloom.functions import labs
from reportloom.operators import documents, names, observations as obs

CORPUS = os.environ.get("REPORTLOOM_CORPUS")
pytestmark = pytest.mark.skipif(not CORPUS, reason="no report corpus given")


@pytest.fixture(scope="module")
def reports(spark):
    files = spark.read.text(CORPUS, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    df = files.select(stem.alias("report_id"), F.col("value").alias("text")).cache()
    yield df
    df.unpersist()


def test_ids(reports):
    keyed = documents.decompose_report_id(reports)
    assert (reports.count(), keyed.count()) == (4624, 4621)
    assert keyed.where("report_date IS NOT NULL").count() == 3704
    assert keyed.select("patient_id").distinct().count() == 1092


def test_names(reports):
    per = {r.confidence: r["count"] for r in names.extract_patient_name(reports).groupBy("confidence").count().collect()}
    assert per == {0.93: 1026 + 532, None: 3066}


def test_value_lines(reports):
    rows = obs.extract_observations(documents.decompose_report_id(reports))
    assert (rows.count(), rows.where("ref_range <> ''").count()) == (3329, 0)


def test_tables_and_flags(reports):
    rows = obs.table_observations(reports)
    assert rows.select("report_id").distinct().count() == 4085
    flagged = rows.withColumn("f", labs.flag_value(F.col("value"), F.col("ref_range"))).where("f IS NOT NULL AND status_code IS NOT NULL")
    differ = flagged.where("f <> status_code")
    assert (flagged.count() - differ.count(), differ.count()) == (23702, 355)


def test_cards(reports):
    assert obs.card_observations(reports).count() == 2819
