"""Document rows: lines, ids, hashes, status, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import text as tx


def explode_lines(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("report_id",),
    max_chars: int | None = 200,
) -> DataFrame:
    """(keep..., line_no, line): stripped non-blank lines of at most ``max_chars``.

    ``line_no`` counts all lines of the text from 0, kept or not.
    """
    lines = F.transform(
        F.split(tx.plain_breaks(F.col(text_col)), "\n", -1),
        lambda s, i: F.struct(i.alias("line_no"), tx.strip(s).alias("line")),
    )

    def wanted(item: Column) -> Column:
        fits = F.lit(True) if max_chars is None else F.length(item["line"]) <= max_chars
        return (item["line"] != "") & fits

    return docs.select(*keep, F.inline(F.filter(lines, wanted)))


def document_id(text: Column, given: Column | None = None) -> Column:
    """The given id, else the MD5 of the content."""
    digest = F.md5(text)
    return digest if given is None else F.coalesce(given, digest)


def distinct_documents(docs: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """One row per content: id, first row by ``order``, and how many copies there were.

    Only ids and order columns take part in the aggregation; copies combine before the
    shuffle, so a content repeated a billion times costs one row per task.
    """
    keyed = docs.withColumn("document_id", document_id(F.col(text_col)))
    first = F.min(F.struct(*order)).alias("_first")
    return (
        keyed.groupBy("document_id")
        .agg(first, F.count(F.lit(1)).alias("n_copies"))
        .select("document_id", *[F.col(f"_first.{c}").alias(c) for c in order], "n_copies")
    )


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes (or of the UTF-8 form of a string)."""
    return F.sha2(content, 256)


def current_doc_status(states: DataFrame, key: str, status: str, at: list[str]) -> DataFrame:
    """Newest state of each document."""
    return states.groupBy(key).agg(F.max_by(status, F.struct(*at)).alias(status))


def parse_report_filename(files: DataFrame, name_col: str = "name", strict: bool = True) -> DataFrame:
    """patient_id, test_type, report_date, report_id and reject_reason from a PDF file name.

    ``strict`` accepts one-word test types with a style suffix only; otherwise the type is
    all words before the date and the suffix may be missing. An impossible date is a reject,
    not the end of the run.
    """
    pattern = (
        r"(?i)^(P\d+)_([^_]+)_(\d{8})_.*\.pdf$"
        if strict
        else r"(?i)^(P\d+)_(.+?)_(\d{8})(?:_.*)?\.pdf$"
    )
    name = F.col(name_col)
    hit = name.rlike(pattern)
    date = F.try_to_date(F.regexp_extract(name, pattern, 3), "yyyyMMdd")
    good = hit & date.isNotNull()
    return files.select(
        "*",
        F.when(good, F.regexp_extract(name, pattern, 1)).alias("patient_id"),
        F.when(good, F.regexp_extract(name, pattern, 2)).alias("test_type"),
        F.when(good, date).alias("report_date"),
        F.when(good, F.left(name, F.length(name) - 4)).alias("report_id"),
        F.when(~hit, "no_match").when(date.isNull(), "bad_date").alias("reject_reason"),
    )


def decompose_report_id(docs: DataFrame, id_col: str = "report_id", strict: bool = True) -> DataFrame:
    """patient_id, test_type, report_date from a report id; other ids drop out.

    ``strict`` takes the second word as type and the third as date, if it has 8 digits;
    otherwise the date is the first 8-digit word and the type all words before it.
    """
    rid = F.col(id_col)
    kept = docs.where(rid.rlike(r"(?i)^P\d+_"))
    patient = F.regexp_extract(rid, r"(?i)^(P\d+)_", 1)
    if strict:
        words = F.split(rid, "_", -1)
        kind, digits = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    else:
        full = r"^[^_]+_(.+?)_(\d{8})(?:_|$)"
        kind = F.coalesce(
            F.nullif(F.regexp_extract(rid, full, 1), F.lit("")), F.get(F.split(rid, "_", -1), F.lit(1))
        )
        digits = F.regexp_extract(rid, full, 2)
    date = F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd"))
    return kept.withColumns({"patient_id": patient, "test_type": kind, "report_date": date})
