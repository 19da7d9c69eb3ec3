"""Column rules for measured values, ranges, statuses, dates and test types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed value: the shape of a measured value in running text.
VALUE_ROW = (
    r"([A-Za-z][A-Za-z0-9 _/%\-]{1,40})\s+"
    r"(-?\d+(?:\.\d+)?)\s*"
    r"([A-Za-z/%µ\^\-]+)?"
    r"(?:\s*(\([HL]\)))?"
    r"(?:\s+(\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?))?"
)
# Words that show a line is a heading, not a measurement.
HEADER_WORDS = ("name", "patient", "value", "result", "reference")

NUMBER = r"-?\d+(?:\.\d+)?"
# The measured value at the start of a cell, whole: bounds and thousands marks belong to it, and
# a date or another number that runs on is none.
CELL_VALUE = r"^\s*([<>≤≥]?\s*-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(?![\d,.]*\d|\s*[/:]\s*\d)"
RANGE = rf"({NUMBER})\s*-\s*({NUMBER})"

# Printed status marks and the status they stand for.
STATUS_WORDS = {
    "HIGH": "HIGH",
    "H": "HIGH",
    "LOW": "LOW",
    "L": "LOW",
    "NORMAL": "NORMAL",
    "N": "NORMAL",
    "BORDERLINE": "BORDERLINE",
    "B": "BORDERLINE",
}

# Test classes by keyword, most specific first.
TEST_TYPES = (
    ("CMP", r"comprehensive metabolic|\bcmp\b"),
    ("RFT", r"kidney|\brenal\b|\brft\b"),
    ("LFT", r"liver|hepatic|\blft\b"),
    ("CBC", r"blood count|\bcbc\b"),
    ("Thyroid", r"thyroid|\bt3\b|\bt4\b|\btsh\b"),
    ("Lipid_Profile", r"cholesterol|lipid"),
    ("Diabetes", r"glucose|hba1c|diabetes"),
    ("Inflammation", r"\bcrp\b|\besr\b|inflammation"),
    ("Iron_Studies", r"ferritin|\biron\b"),
    ("Vitamin", r"vitamin|b12"),
)
OTHER_TEST_TYPE = "General"

# Date shapes found in reports.
DATE_FORMATS = ("MM/dd/yyyy", "yyyy-MM-dd", "MMMM d, yyyy")


def is_header_word(analyte: Column) -> Column:
    """True for heading words; test before stripping, as ``"name "`` is not one."""
    return F.lower(analyte).isin(*HEADER_WORDS)


def value_number(value: Column) -> Column:
    """Leading number of a cell as double, NULL when there is none."""
    return F.regexp_extract(value, rf"^\s*({NUMBER})", 1).try_cast("double")


def cell_value(cell: Column) -> Column:
    """Leading value of a cell as printed (``1,200``, ``<0.5``), empty if there is none."""
    return F.regexp_extract(cell, CELL_VALUE, 1)


def cell_number(value: Column) -> Column:
    """A printed value as double; NULL for bounds such as ``<0.5`` and for words."""
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def range_bound(ref_range: Column, upper: bool) -> Column:
    return F.regexp_extract(ref_range, RANGE, 2 if upper else 1).try_cast("double")


def flag_value(value: Column, ref_range: Column) -> Column:
    """LOW / NORMAL / HIGH against an inclusive ``low-high`` range; NULL if not numeric."""
    number = value.try_cast("double")
    low, high = range_bound(ref_range, False), range_bound(ref_range, True)
    return (
        F.when(number.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("string"))
        .when(number < low, "LOW")
        .when(number > high, "HIGH")
        .otherwise("NORMAL")
    )


def normalize_status(status: Column) -> Column:
    """One vocabulary for printed statuses; unknown or blank marks give NULL."""
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.try_element_at(words, F.upper(F.trim(status)))


def clean_date(text: Column) -> Column:
    """Date from any of the known shapes, NULL when none fits."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def normalize_test_type(description: Column) -> Column:
    """Test class of a free-text description; ``General`` when no keyword is there."""
    low = F.lower(description)
    start = F.when(F.lit(False), F.lit(""))
    return reduce(lambda c, t: c.when(low.rlike(t[1]), t[0]), TEST_TYPES, start).otherwise(
        OTHER_TEST_TYPE
    )
