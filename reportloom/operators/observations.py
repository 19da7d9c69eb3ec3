"""Measured values from report text: value lines, pipe tables, cards, header fields.

All readers work inside the document row and end in one generator, so nothing is shuffled and
expensive rules run once per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions import labs, text as tx
from reportloom.session import workspace

_TEXTS = 1000  # texts read at a time

_VALUE_ROW = re.compile(labs.VALUE_ROW, re.ASCII)
# Every match holds a blank before a digit; this cheap test spares prose the full rule.
_BLANK_DIGIT = re.compile(r"\s-?\d", re.ASCII)
_ROW_FIELDS = {"obs_no": pa.int32(), "analyte": pa.string(), "value": pa.string(), "unit": pa.string(), "ref_range": pa.string()}


def _value_rows(text: str, max_rows: int | None, max_line: int | None) -> list[tuple]:
    """(obs_no, analyte, value, unit, ref_range) of every line that holds a value."""
    rows = []
    # str.splitlines and str.strip know the line ends and blanks of ``functions.text``.
    for line in map(str.strip, text.splitlines()):
        if _BLANK_DIGIT.search(line) and (max_line is None or len(line) <= max_line):
            found = _VALUE_ROW.search(line)
            if found:
                analyte, value, unit, _, ref = found.groups("")
                if analyte.lower() not in labs.HEADER_WORDS:
                    rows.append((len(rows), analyte.strip(" "), value, unit, ref))
    return rows if max_rows is None else rows[:max_rows]


def observation_rows(text: Column, max_rows: int | None = None, max_line: int | None = None) -> Column:
    """Array of (obs_no, analyte, value, unit, ref_range): first value per line.

    ``obs_no`` numbers the rows of a document in text order. Every line and row counts unless
    ``max_line`` (characters) or ``max_rows`` is given.
    """

    @F.arrow_udf("array<struct<obs_no:int,analyte:string,value:string,unit:string,ref_range:string>>")
    def rows(texts: pa.Array) -> pa.Array:
        # In slices, so that the strings of a batch are not all held as Python objects.
        return pa.chunked_array([read(texts.slice(i, _TEXTS)) for i in range(0, len(texts), _TEXTS)], kind).combine_chunks()

    kind = pa.list_(pa.struct(list(_ROW_FIELDS.items())))

    def read(texts: pa.Array) -> pa.Array:
        found = [None if t is None else _value_rows(t, max_rows, max_line) for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(f) if f else 0 for f in found)])
        starts = pa.array(ends, pa.int32(), mask=np.array([*(f is None for f in found), False]))
        columns = zip(*(row for f in found if f for row in f), strict=True) if ends[-1] else [[]] * len(_ROW_FIELDS)
        fields = [pa.array(c, t) for c, t in zip(columns, _ROW_FIELDS.values(), strict=True)]
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(fields, names=list(_ROW_FIELDS)))

    # Python reads valid UTF-8 only.
    return rows(F.make_valid_utf8(text))


def extract_observations(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("report_id",),
    max_rows: int | None = None,
    max_line: int | None = None,
) -> DataFrame:
    """(keep..., obs_no, analyte, value, unit, ref_range); see ``observation_rows``."""
    return docs.select(*keep, F.inline(observation_rows(F.col(text_col), max_rows, max_line)))


def first_rows_per_report(
    rows: DataFrame, keys: list[str], order: list[str], n: int = 200
) -> DataFrame:
    """The first ``n`` rows of each report. A rank limit is pre-applied before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


# Column titles of the known table layouts.
_NAME_TITLES = ("test name", "test", "analyte")
_VALUE_TITLES = ("result", "value", "observed value")
_UNIT_TITLES = ("unit", "units")
_RANGE_TITLES = ("reference range", "reference", "range", "biological reference interval")
_STATUS_TITLES = ("status", "flag")
# Rows inside a table that are no measurement: person banners, range notes, labelled headings.
_NO_ANALYTE = (
    r"(?i)^(?:patient|name|dob|date of birth|age|gender|sex|ref(?:erence)?|test date|report date|collected|collection date"
    r"|specimen|accession|mrn|patient id|id)\b\W*(?::|$)|\b(?:dob|test date)\s*:|^\W*\d+ normal results|^lab results\b"
)


_FIELDS = (_NAME_TITLES, _VALUE_TITLES, _UNIT_TITLES, _RANGE_TITLES, _STATUS_TITLES)
_FIELD_OF = {title: field for field, titles in enumerate(_FIELDS) for title in titles}
_ENDS_IN_RANGE = re.compile(rf"{labs.RANGE}\s*\Z", re.ASCII)
_MARKS = " \t:|-"  # what a ``|---|`` line is made of


def _pipe_tables(text: str) -> list[list[str]]:
    """The stripped lines of every pipe table, without its ``|---|`` lines."""
    # str.splitlines and str.strip know the line ends and blanks of ``functions.text``.
    lines = [s for s in [line.strip() for line in text.splitlines() if "|" in line] if s[0] == "|" and len(s) > 2]
    starts, below = [], 0
    for i in [i for i, s in enumerate(lines) if s[1] in _MARKS and not s.strip(_MARKS)][::-1]:
        # A line of nothing but marks belongs to the ``|---|`` line below it.
        if i and ("-" in lines[i] or below == i + 1):
            starts.append(i - 1)
            below = i
    tables, end = [], len(lines)
    for start in starts:
        if end > start + 1:
            tables.append([s for s in lines[start:end] if "-" not in s or s.strip(_MARKS)])
        end = start
    return tables[::-1]


def _cells(line: str) -> list[str]:
    return list(map(str.strip, (line[1:-1] if line[-1] == "|" else line[1:]).split("|")))


def _layout(first: list[str]) -> tuple[bool, bool, list[int]]:
    """(first row is titles, a blank status is normal, places of name, value, unit, range, status or -1)."""
    at, titles = [-1] * 5, [c.lower() for c in first]
    for place, title in enumerate(titles):
        field = _FIELD_OF.get(title)
        if field is not None and titles.index(title) == place:
            at[field] = place
    if at[0] >= 0 and at[1] >= 0:
        return True, "flag" in titles, at
    if len(first) >= 5:
        return False, False, [0, 1, 2, 3, 4]
    if len(first) == 4:
        return False, False, [0, 1, -1, 2, 3] if _ENDS_IN_RANGE.search(first[2]) else [0, 1, 2, -1, 3]
    return False, False, [0, 1, -1, -1, 2]


def _table_cells(text: str, number: int, out: list[tuple]) -> None:
    """Add (number, table_no, row_no, name, value, unit, range, status, has_unit, blank_is_normal) per row with a name and a value."""
    for table_no, lines in enumerate(_pipe_tables(text)):
        if not lines:
            continue
        first = _cells(lines[0])
        has_titles, blank_is_normal, (name, value, unit, ref, status) = _layout(first)
        for row_no, line in enumerate(lines[1:] if has_titles else lines):
            cells = _cells(line)
            n = len(cells)
            if n > name and n > value and cells[name] and cells[value]:
                out.append((
                    number, table_no, row_no, cells[name], cells[value],
                    cells[unit] if 0 <= unit < n else None,
                    cells[ref] if 0 <= ref < n else None,
                    cells[status] if 0 <= status < n else None,
                    unit >= 0, blank_is_normal,
                ))


_CELL_FIELDS = {
    "table_no": pa.int32(), "row_no": pa.int32(), "analyte": pa.string(), "_value": pa.string(), "_unit": pa.string(),
    "_ref": pa.string(), "status": pa.string(), "_has_unit": pa.bool_(), "_blank_is_normal": pa.bool_(),
}
_CELL_TYPES = "table_no int, row_no int, analyte string, _value string, _unit string, _ref string, status string, _has_unit boolean, _blank_is_normal boolean"


def _cut_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over (keep..., text): the cells of all table rows, with the kept columns."""
    for batch in batches:
        for start in range(0, batch.num_rows, _TEXTS):
            part, found = batch.slice(start, _TEXTS), []
            for number, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                if text and "|" in text:
                    _table_cells(text, number, found)
            if found:
                numbers, *cells = zip(*found, strict=True)
                at = pa.array(numbers, pa.int32())
                kept = [c.take(at) for c in part.columns[:-1]]
                cut = [pa.array(c, t) for c, t in zip(cells, _CELL_FIELDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *cut], names=[*part.schema.names[:-1], *_CELL_FIELDS])


def table_observations(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """Rows of all pipe tables: (keep..., table_no, row_no, analyte, value, unit, ref_range,
    status, status_code, value_num).

    A table starts at the line before a ``|---|`` line; pipe lines before the first of these
    are no table. Its first row is a header when it has a name and a value title; otherwise it is
    data and the fields go by position. Banner, range and heading rows are left out. Values stay
    whole (``1,200``, ``<0.5``, words); ``value_num`` is NULL unless they are a number. A blank
    cell in a ``Flag`` column means normal.

    Tables are cut into cells a batch of texts at a time; the rules of the cells are plain columns.
    """
    kept = docs.select(*keep)
    # Python reads valid UTF-8 only.
    texts = docs.select(*keep, F.make_valid_utf8(F.col(text_col)).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    rows = texts.mapInArrow(_cut_tables, f"{fields}, {_CELL_TYPES}" if fields else _CELL_TYPES)
    # What is no measurement goes first: the other rules are dearer.
    rows = rows.where(~F.col("analyte").rlike(_NO_ANALYTE) & ~labs.is_header_word(F.col("analyte")))
    tail_range = rf"({labs.NUMBER}\s*-\s*{labs.NUMBER})\s*$"
    rows = rows.withColumns({"_number": labs.cell_value(F.col("_value")), "_tail": F.regexp_extract("_ref", tail_range, 1)})
    number, blank = F.col("_number") != "", F.lit("")
    rows = rows.select(
        *kept.columns,
        "table_no",
        "row_no",
        "analyte",
        F.when(number, F.col("_number")).otherwise(F.col("_value")).alias("value"),
        # Some unit and range cells both hold "unit low - high".
        F.when(F.col("_has_unit"), F.trim(F.regexp_replace("_unit", tail_range, "")))
        .when(number, F.trim(F.regexp_replace("_value", labs.CELL_VALUE, "")))
        .otherwise("")
        .alias("unit"),
        F.when(F.col("_tail") != "", F.col("_tail")).otherwise(F.coalesce("_ref", blank)).alias("ref_range"),
        F.coalesce("status", blank).alias("status"),
        F.coalesce(
            labs.normalize_status(F.col("status")), F.when(F.col("_blank_is_normal") & (F.col("status") == ""), "NORMAL")
        ).alias("status_code"),
    )
    return rows.withColumn("value_num", labs.cell_number(F.col("value")))


_STATUS_LINE = r"(?i)^(?:high|low|normal|borderline)$"
_REF_LINE = r"(?i)^ref:\s*"
# "LAST, FIRST | 10/10/2023" alone on a line or in front of a value.
_PERSON_PREFIX = r"^[^|,]+,[^|]*\|\s*\d{1,2}/\d{1,2}/\d{4}\s*"


def card_observations(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """Values laid out as cards: name, ``value unit``, ``Ref: a-b``, status on single lines.

    The status is the line after ``Ref:``; where it comes late, the k-th status belongs to
    the k-th card if there are as many statuses as cards, else it is NULL. A value in words or
    with a bound (``Negative``, ``<0.01``) stays as printed, with a NULL ``value_num``.
    """
    text = tx.plain_breaks(F.col(text_col))
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda s: F.regexp_replace(F.regexp_replace(tx.strip(s), r"^#+\s*", ""), _PERSON_PREFIX, ""),
    )
    lines = F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("![")))

    def cards(ln: Column) -> Column:
        statuses = F.filter(ln, lambda s: s.rlike(_STATUS_LINE))
        anchored = F.transform(
            ln,
            lambda s, i: F.when(
                s.rlike(_REF_LINE),
                F.struct(
                    F.get(ln, i - 2).alias("name"),
                    F.get(ln, i - 1).alias("val"),
                    F.regexp_replace(s, _REF_LINE, "").alias("ref"),
                    F.get(ln, i + 1).alias("nxt"),
                ),
            ),
        )
        hits = F.filter(anchored, lambda a: a.isNotNull())
        full = F.size(statuses) == F.size(hits)
        return F.transform(
            hits,
            lambda h, k: F.struct(
                k.alias("card_no"),
                h["name"].alias("analyte"),
                F.coalesce(F.nullif(labs.cell_value(h["val"]), F.lit("")), h["val"]).alias("value"),
                F.when(labs.cell_value(h["val"]) != "", F.trim(F.regexp_replace(h["val"], labs.CELL_VALUE, "")))
                .otherwise("")
                .alias("unit"),
                F.trim(h["ref"]).alias("ref_range"),
                F.when(h["nxt"].rlike(_STATUS_LINE), F.upper(h["nxt"]))
                .when(full, F.upper(F.get(statuses, k)))
                .alias("status"),
            ),
        )

    found = F.when(F.contains(F.lower(F.col(text_col)), F.lit("ref:")), tx.bind(lines, cards))
    rows = docs.select(*keep, F.inline(found)).where("value <> '' AND analyte IS NOT NULL")
    return rows.withColumn("value_num", labs.cell_number(F.col("value")))


def bar_observations(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """Values of reports whose cells stand one per line, without a table or ``Ref:`` lines.

    Either value by value (name, number, unit, status) or column by column (all names, all
    numbers, all units, all statuses). Statuses belong to the values in order if there are
    as many of them, else they are NULL.
    """
    lines = F.filter(
        F.transform(F.split(tx.plain_breaks(F.col(text_col)), "\n", -1), tx.strip),
        lambda s: (s != "") & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("![")),
    )

    def read(ln: Column) -> Column:
        statuses = F.filter(ln, lambda s: s.rlike(_STATUS_LINE))
        places = F.filter(
            F.transform(ln, lambda s, i: F.when(s.rlike(rf"^{labs.NUMBER}$"), i)), lambda i: i.isNotNull()
        )

        def rows(at: Column) -> Column:
            k, first = F.size(at), F.get(at, F.lit(0))
            by_column = (k > 1) & (F.get(at, k - 1) - first == k - 1)
            return F.transform(
                at,
                lambda i, j: F.struct(
                    j.alias("row_no"),
                    F.get(ln, F.when(by_column, first - k + j).otherwise(i - 1)).alias("analyte"),
                    F.get(ln, i).alias("value"),
                    F.get(ln, F.when(by_column, first + k + j).otherwise(i + 1)).alias("unit"),
                    F.when(F.size(statuses) == k, F.upper(F.get(statuses, j))).alias("status"),
                ),
            )

        other = F.exists(ln, lambda s: F.startswith(s, F.lit("|")) | s.rlike(_REF_LINE))
        return F.when(~other, tx.bind(places, rows))

    found = docs.select(*keep, F.inline(tx.bind(lines, read))).where("analyte IS NOT NULL")
    unit = F.when(F.col("unit").rlike(_STATUS_LINE), "").otherwise(F.coalesce("unit", F.lit("")))
    return found.withColumns({"unit": unit, "value_num": F.col("value").try_cast("double")})


_DATE = r"(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2}, \d{4})"
# Labels in report headers.
HEADER_LABELS = {
    "patient": r"(?im)^\W*(?:patient(?: name)?|name)\W*:\W*([A-Za-z][A-Za-z'\-., ]*)",
    "patient_id": r"(?i)\bID\W*:\W*(P\d+)",
    "dob": r"(?i)\b(?:DOB|Date of Birth)\W*:\W*" + _DATE,
    "gender": r"(?i)\bGender\W*:\W*([MF])\b",
    "panel": r"(?im)\bPanel\W*:[^\S\n]*([^\n]+)$",
    "collected": r"(?i)\b(?:Collected|Collection Date|Test Date)\W*:\W*" + _DATE,
    "report_date": r"(?i)\bReport Date\W*:\W*" + _DATE,
    "specimen": r"(?i)\bSpecimen(?: ID)?\W*:\W*(\w+)",
    "accession": r"(?i)\bAccession\W*:\W*(\w+)",
}
# One of these words, in lower case, is in every match: a cheap test that spares texts without the label the rule.
_LABEL_WORDS = {
    "patient": ("patient", "name"),
    "patient_id": ("id",),
    "dob": ("dob", "date of birth"),
    "gender": ("gender",),
    "panel": ("panel",),
    "collected": ("collected", "collection date", "test date"),
    "report_date": ("report date",),
    "specimen": ("specimen",),
    "accession": ("accession",),
}
# Several labels may share a line: a value ends where the next label begins.
_NEXT_LABEL = r"(?i)\s+(?:DOB|Date of Birth|Age|Gender|Sex|(?:Patient )?ID|MRN|Collected|Collection Date|(?:Test|Report) Date|Specimen(?: ID)?|Accession|Panel)\b(?:\W*:.*)?$"
_DATE_FIELDS = ("dob", "collected", "report_date")


def header_fields(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """One row per document with the labelled header values, NULL where absent.

    Every line counts, however long; only image lines are skipped.
    """
    text = tx.plain_breaks(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda s: ~F.startswith(tx.strip(s), F.lit("![")))

    def found(body: Column, low: Column) -> Column:
        """The raw values by label, each read once."""
        cols = []
        for name, pattern in HEADER_LABELS.items():
            there = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in _LABEL_WORDS[name]])
            cols.append(F.when(there, F.regexp_extract(body, pattern, 1)).alias(name))
        return F.struct(*cols)

    def ended(raw: Column) -> Column:
        cols = []
        for name in HEADER_LABELS:
            # The next label begins with a blank and a word: one-word values have none.
            value = F.when(raw[name].rlike(r"\s"), F.regexp_replace(raw[name], _NEXT_LABEL, "")).otherwise(raw[name])
            cols.append(F.nullif(F.trim(value), F.lit("")).alias(name))
        return F.struct(*cols)

    def fields(value: Column) -> Column:
        return F.struct(
            *[(labs.clean_date(value[n]) if n in _DATE_FIELDS else value[n]).alias(n) for n in HEADER_LABELS]
        )

    body = F.array_join(lines, "\n")
    raw = tx.bind(body, lambda b: tx.bind(F.lower(b), lambda low: found(b, low)))
    return docs.select(*keep, F.inline(F.array(tx.bind(tx.bind(raw, ended), fields))))


def analyte_trend(
    observations: DataFrame,
    keys: list[str],
    time_col: str,
    value_col: str,
    tie: list[str],
) -> DataFrame:
    """Each value with the previous one of the same keys (prev_value) and the change.

    Rows are written, range-partitioned by keys and time, sorted and written again with their
    places: a key that owns a third of all rows thus spreads evenly, whatever its times. The
    look-back runs inside a partition; the last row of each partition, one per partition however
    many rows there are, is carried to the first row of the next.
    """
    spark = observations.sparkSession
    order = [*keys, time_col, *tie]
    # A given number is not made smaller at run time: the sort uses all tasks.
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df: DataFrame, name: str) -> DataFrame:
        path = workspace(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # Finding range bounds reads the rows once more: from the copy, not from what made it.
    rows = written(observations, "trend-rows")
    laid = written(
        rows.repartitionByRange(runs, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "trend-order",
    ).withColumn("_run", F.shiftright("_at", 33))
    here = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value_col).alias("v"))
    inside = Window.partitionBy("_run").orderBy("_at")
    ends = laid.groupBy("_run").agg(F.max_by(here, "_at").alias("_end"))
    carry = ends.select("_run", F.lag("_end").over(Window.orderBy("_run")).alias("_carry"))
    looked = laid.withColumn("_prev", F.lag(here).over(inside)).join(F.broadcast(carry), "_run")
    before = F.coalesce("_prev", "_carry")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_before.k{i}").eqNullSafe(F.col(k))
    return (
        looked.withColumn("_before", before)
        .withColumn("prev_value", F.when(F.col("_before").isNotNull() & same, F.col("_before.v")))
        .withColumn("change", F.col(value_col) - F.col("prev_value"))
        .select(*observations.columns, "prev_value", "change")
    )
