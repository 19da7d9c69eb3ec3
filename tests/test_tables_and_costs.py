"""Table maintenance, ledger and report questions on small fixtures."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reportloom.functions import content as ct
from reportloom.operators import costs, documents as docs, merge, reports
from reportloom.sinks import files as sink, tables as sink_tables


def test_file_names(spark):
    names = [
        "P101805_LFT_20241031_borderless.pdf", "P100027_Lipid_Profile_20251104_alternative.pdf",
        "P1_LFT_20241031.pdf", "P1_LFT_20240230_x.PDF",
    ]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    strict = {r.name: r for r in docs.parse_report_filename(rows).collect()}
    first = strict[names[0]]
    assert (first.patient_id, first.test_type, str(first.report_date), first.report_id) == (
        "P101805", "LFT", "2024-10-31", "P101805_LFT_20241031_borderless",
    )
    assert [strict[n].reject_reason for n in names[1:]] == ["no_match", "no_match", "bad_date"]
    loose = {r.name: (r.test_type, str(r.report_date)) for r in docs.parse_report_filename(rows, strict=False).collect()}
    assert loose[names[1]] == ("Lipid_Profile", "2025-11-04") and loose[names[2]] == ("LFT", "2024-10-31")


def test_report_ids(spark):
    ids = ["P100027_Lipid_Profile_20251104_alternative", "PA0651A_Inflammation_20241210", "p1_CBC_20240101"]
    rows = spark.createDataFrame([(i,) for i in ids], "report_id string")
    got = {r.report_id: (r.patient_id, r.test_type, r.report_date) for r in docs.decompose_report_id(rows).collect()}
    assert got == {ids[0]: ("P100027", "Lipid", None), ids[2]: ("p1", "CBC", dt.date(2024, 1, 1))}
    loose = docs.decompose_report_id(rows, strict=False).where("report_id LIKE '%Lipid%'").first()
    assert (loose.test_type, loose.report_date) == ("Lipid_Profile", dt.date(2025, 11, 4))


def test_replace_keeps_rows_of_reports_without_new_ones(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "report_id string, v int")
    new = spark.createDataFrame([("a", 3), ("a", 4)], "report_id string, v int")
    got = sorted(tuple(r) for r in merge.replace_observations(old, new).collect())
    assert got == [("a", 3), ("a", 4), ("b", 2)]
    none = merge.replace_observations(old, new.where("false"))
    assert sorted(tuple(r) for r in none.collect()) == [("a", 1), ("b", 2)]


def test_upsert_sets_nulls_and_keeps_pages(spark):
    ddl = "report_id string, patient_id string, test_type string, report_date date, src_path string, pages int"
    have = spark.createDataFrame([("r", "p", "A", dt.date(2024, 1, 1), "x", 7)], ddl)
    new = spark.createDataFrame([("r", "p", "B", None, "y", None), ("s", "q", "C", None, "z", None)], ddl)
    got = {r.report_id: tuple(r)[1:] for r in merge.upsert_reports(have, new, ["src_path"]).collect()}
    assert got == {"r": ("p", "B", None, "y", 7), "s": ("q", "C", None, "z", None)}


def test_seen_dates(spark):
    people = spark.createDataFrame(
        [("p", None, None, None), ("q", None, dt.date(2020, 1, 1), None)],
        "patient_id string, full_name string, first_seen date, last_seen date",
    )
    seen = spark.createDataFrame([("p", dt.date(2024, 1, 1)), ("p", None), ("p", dt.date(2025, 1, 1))], "patient_id string, report_date date")
    got = {r.patient_id: (r.first_seen, r.last_seen) for r in merge.backfill_seen_dates(people, seen).collect()}
    assert got == {"p": (dt.date(2024, 1, 1), dt.date(2025, 1, 1)), "q": (dt.date(2020, 1, 1), None)}


def usage(spark, rows):
    ddl = "timestamp timestamp, user_id string, session_id string, operation_type string, model_name string, input_tokens int, output_tokens int"
    return costs.calculate_cost(spark.createDataFrame(rows, ddl))


def test_costs(spark):
    at = dt.datetime(2024, 1, 31, 10)
    rows = [(at, "u", "s", "chat", m, 1000, 1000) for m in ("gpt-4o-mini", "GPT-4", "gpt-4-0613", None)]
    got = [(r.input_cost, r.output_cost, r.total_cost) for r in usage(spark, rows).collect()]
    d = Decimal
    assert got == [
        (d("0.000150"), d("0.000600"), d("0.000750")),
        (d("0.030000"), d("0.060000"), d("0.090000")),
        (d("0.001000"), d("0.002000"), d("0.003000")),
        (d("0.001000"), d("0.002000"), d("0.003000")),
    ]


def test_end_day_is_midnight(spark):
    rows = [(dt.datetime(2024, 1, 31, 10), "u", "s", "chat", "gpt-4", 1, 1), (dt.datetime(2024, 1, 31), "u", "s", "chat", "gpt-4", 1, 1)]
    got = costs.usage_filter(usage(spark, rows), user_id="", end_date="2024-01-31")
    assert [r.timestamp for r in got.collect()] == [dt.datetime(2024, 1, 31)]


def test_empty_ledger_gives_one_row(spark):
    row = costs.cost_summary(usage(spark, [])).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, None, None)
    assert [(r.level, r.requests) for r in costs.cost_rollup(usage(spark, [])).collect()] in ([("all", 0)], [])


def test_batch_summary(spark):
    none = spark.createDataFrame([], "path string, ok boolean, error string")
    assert tuple(reports.batch_summary(none).first()) == (0, 0, 0, 0.0)
    some = spark.createDataFrame([("a", True, None), ("b", False, "bad")], none.schema)
    assert tuple(reports.batch_summary(some).first()) == (2, 1, 1, 50.0)
    assert [tuple(r) for r in reports.batch_errors(some).collect()] == [("b", "bad")]


def test_latest_report_prefers_text(spark):
    ddl = "patient_id string, report_id string, report_date date"
    texts = spark.createDataFrame([("p", "a", dt.date(2020, 1, 1)), ("p", "b", None)], ddl)
    pdfs = spark.createDataFrame([("p", "c", dt.date(2024, 1, 1)), ("q", "d", None)], ddl)
    got = reports.latest_report(reports.prefer_text_else_pdf(texts, pdfs), ["patient_id"])
    assert {r.patient_id: r.report_id for r in got.collect()} == {"p": "a", "q": "d"}


def test_report_scope_by_month(spark):
    ddl = "patient_id string, report_id string, test_type string, report_date date"
    rows = spark.createDataFrame(
        [("p", "a", "LFT", dt.date(2024, 12, 31)), ("p", "b", "LFT", dt.date(2025, 1, 1)), ("p", "c", "CBC", dt.date(2024, 12, 1))], ddl
    )
    assert [r.report_id for r in reports.report_scope(rows, "p", ["LFT"], 2024, 12).collect()] == ["a"]
    assert sorted(r.report_id for r in reports.report_scope(rows, "p", month=12).collect()) == ["a", "c"]


@pytest.mark.parametrize(
    "question, stem",
    [
        ("How many total patients showed up in 2024", "sql_How_many_total_patients_showed_up_in_2024_"),
        ("in 2025?", "sql_in_2025_"),
    ],
)
def test_answer_stems(spark, question, stem):
    names = [spark.range(1).select(ct.answer_file_stem(F.lit(q)).alias("s")).first().s for q in (question, question + "!")]
    assert names[0][:-12] == names[1][:-12] == stem
    assert names[0] != names[1]


def test_answer_csv_and_audit(spark, tmp_path):
    path = sink.write_answer_csv(spark.range(3), "How many?", "SELECT id", str(tmp_path))
    assert path.rsplit("/", 1)[1].startswith("sql_How_many_")
    audit = spark.read.json(f"{tmp_path}/audit").first()
    assert (audit.question, audit.sql, audit.n_rows) == ("How many?", "SELECT id", 3)
    broken = spark.createDataFrame([("a\nb\nc",), ("d",)], "t string")
    other = sink.write_answer_csv(broken, "How many?!", "SELECT t", str(tmp_path))
    assert other != path
    rows = {r.question: r.n_rows for r in spark.read.json(f"{tmp_path}/audit").collect()}
    assert rows == {"How many?": 3, "How many?!": 2}


def test_ensure_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS store")
    with pytest.raises(LookupError):
        sink_tables.ensure_tables(spark, database="store")
    sink_tables.ensure_tables(spark, init=True, database="store")
    sink_tables.ensure_tables(spark, database="store")
    assert spark.table("store.observations").columns == ["report_id", "obs_no", "analyte", "value", "unit", "ref_range", "page"]


def test_upload_defaults_and_names(spark):
    rows = spark.createDataFrame([('{"patient_name":"","analytes":null}',), ("nonsense",), (None,)], "j string")
    got = [r.e for r in rows.select(ct.parse_entities_json(F.col("j"), "2025-02-09").alias("e")).collect()]
    assert [(e.patient_name, e.test_type, e.test_date, e.analytes) for e in got] == [("Unknown", "General", "2025-02-09", [])] * 3
    ids = spark.range(1).select(
        ct.generate_patient_id(F.lit("John Smith")).alias("a"), ct.generate_patient_id(F.lit("JOHN SMITH")).alias("b"),
        ct.generate_report_name(F.lit(None), F.lit("X Y"), F.lit("Lipid Profile"), F.lit("2025-02-09")).alias("n"),
    ).first()
    assert ids.a == ids.b and len(ids.a) == 7
    assert ids.n.endswith("_Lipid_Profile_20250209.md") and ids.n.startswith("P")
