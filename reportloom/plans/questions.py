"""Answering over records: one SELECT, or the right report for a person."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.functions import content as ct
from reportloom.operators import models, names, reports
from reportloom.sinks import files


def run_report_sql(
    spark: SparkSession, tables: dict[str, DataFrame], sql: str, question: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Result of one SELECT over the named tables; written with an audit row if asked."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    result = spark.sql(sql)
    if folder is not None:
        files.write_answer_csv(result, question or sql, sql, folder)
    return result


def report_for_question(
    questions: DataFrame,
    patients: DataFrame,
    texts: DataFrame,
    pdfs: DataFrame,
    max_words: int = ct.MAX_CONTEXT_WORDS,
) -> DataFrame:
    """(question_id, patient_id, report_id, report_text): the newest report of the person meant.

    ``questions`` has question_id, mention, test_type (NULL for any). Persons resolve once
    for all questions. Only the latest report per (person, type), and per person, takes part
    in the join, so a person with very many reports does not multiply.
    """
    who = names.resolve_patient_name(questions, patients).where("patient_id IS NOT NULL")
    wanted = who.select("question_id", "patient_id", "test_type")
    candidates = reports.prefer_text_else_pdf(texts, pdfs).drop("text")
    # Every report stands for its type and for any type, so one aggregation finds both.
    kinds = F.array(
        F.struct(F.lit(False).alias("any_type"), F.col("test_type").alias("asked")),
        F.struct(F.lit(True).alias("any_type"), F.lit(None).cast("string").alias("asked")),
    )
    twice = candidates.withColumn("_k", F.explode(kinds)).select("*", "_k.*").drop("_k", "test_type")
    latest = reports.latest_report(twice, ["patient_id", "any_type", "asked"]).select("patient_id", "any_type", "asked", "report_id")
    asked = wanted.select("question_id", F.col("patient_id").alias("_person"), F.col("test_type").alias("_type"))
    chosen = asked.join(
        latest,
        (F.col("_person") == F.col("patient_id"))
        & (F.col("_type").isNull() == F.col("any_type"))
        & F.col("_type").eqNullSafe(F.col("asked")),
    ).select("question_id", "patient_id", "report_id")
    # Only the chosen reports' texts are cut, not every text before the join.
    found = chosen.join(texts.select("report_id", "text"), "report_id", "left")
    return found.withColumn("report_text", ct.truncate_to_words(F.col("text"), max_words)).drop("text")


def answer_from_reports(chosen: DataFrame, questions: DataFrame, make_model: Callable) -> DataFrame:
    """Model answers from question and chosen report text."""
    asked = questions.join(chosen, "question_id").withColumn(
        "prompt", F.concat_ws("\n\n", F.col("question"), F.col("report_text"))
    )
    return models.apply_text_model(asked, make_model)


ENTITY_WINDOW = 4000


def window_answers(parsed: DataFrame, make_model: Callable, size: int = ENTITY_WINDOW) -> DataFrame:
    """(upload_id, _at, answer) of the model for every ``size`` characters of each text."""
    shape = '{"patient_name", "patient_id", "test_type", "test_date", "analytes": [{"name", "value", "unit", "range", "status"}]}'
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    parts = parsed.select("upload_id", "text", F.explode(starts).alias("_at"))
    prompt = F.concat(
        F.lit(f"Extract entities from this lab report as JSON {shape}:\n\n"), F.substr("text", F.col("_at") + 1, F.lit(size))
    )
    asked = parts.select("upload_id", "_at", prompt.alias("prompt"))
    return models.apply_text_model(asked, make_model).select("upload_id", "_at", "answer")


def merge_windows(answers: DataFrame, as_of: str) -> DataFrame:
    """(upload_id, e): one entities struct per upload from the answers of its windows.

    Analytes of all windows in text order; each field from the first window that has more than
    its default.
    """
    default = ct.parse_entities_json(F.lit("{}"), as_of)
    read = answers.select(
        "upload_id", "_at", F.inline(F.array(F.struct(ct.parse_entities_json(F.col("answer"), as_of).alias("e"), default.alias("d"))))
    )
    parts = read.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("_at", "e", "d"))).alias("p"))
    p = F.col("p")

    def field(name: str):
        said = F.filter(p, lambda x: x["e"][name].isNotNull() & ~x["e"][name].eqNullSafe(x["d"][name]))
        return F.coalesce(F.get(said, F.lit(0))["e"][name], F.get(p, F.lit(0))["d"][name]).alias(name)

    names = [f.name for f in read.schema["e"].dataType.fields]
    made = [
        F.flatten(F.transform(p, lambda x: F.coalesce(x["e"]["analytes"], F.array().cast(read.schema["e"].dataType["analytes"].dataType)))).alias(n)
        if n == "analytes"
        else field(n)
        for n in names
    ]
    return parts.select("upload_id", F.struct(*made).alias("e"))


def process_uploads(
    parsed: DataFrame, as_of: str, make_model: Callable | None = None, window: int = ENTITY_WINDOW
) -> DataFrame:
    """(file_name, text, entities) of uploads: entities, id, file name, formatted report.

    ``parsed`` has upload_id, text and either ``entities_json`` or a model to ask for it. The
    model sees the whole text in windows of ``window`` characters; their answers are merged.
    """
    if make_model is not None:
        merged = merge_windows(window_answers(parsed, make_model, window), as_of)
        read = parsed.select("upload_id", "text").join(merged, "upload_id")
        return _formatted(read)
    rows = parsed
    read = rows.select(
        "upload_id", "text", F.inline(F.array(F.struct(ct.parse_entities_json(F.col("entities_json"), as_of).alias("e"))))
    )
    return _formatted(read)


def _formatted(read: DataFrame) -> DataFrame:
    e = F.col("e")
    pid = F.coalesce(F.nullif(e["patient_id"], F.lit("")), ct.generate_patient_id(e["patient_name"]))
    filled = read.withColumn("e", e.withField("patient_id", pid))
    return filled.select(
        "upload_id",
        ct.generate_report_name(e["patient_id"], e["patient_name"], e["test_type"], e["test_date"]).alias("file_name"),
        ct.format_report_markdown(e, F.col("text")).alias("text"),
        e.alias("entities"),
    )
