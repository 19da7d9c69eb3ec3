"""Line, whitespace and person-name rules as column expressions, and for one text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Line ends and blank characters that text readers elsewhere treat as such; Java's own
# ``\s`` and SQL ``trim`` know fewer.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85  "
BLANKS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Words that end a person's name when one of them follows a blank.
TAIL_WORDS = ("mrn", "dob", "age", "sex", "id", "patient", "no", "number")

# The label shapes a name is read from.
_VALUE = r"([A-Za-z'\-\.\s,]+)"
NAME_PATTERN = r"(?i)^(?:patient\s*)?name\s*[:\-]\s*" + _VALUE
ALT_NAME_PATTERN = r"(?i)^(?:pt\.?\s*)?name\s*[:\-]\s*" + _VALUE + "$"
PATIENT_PATTERN = r"(?i)^patient\s*[:\-]\s*" + _VALUE + "$"
PIPE_CELL_PATTERN = r"(?i)\|\s*(?:patient\s*name|name|patient)\s*\|\s*" + _VALUE + r"\s*\|"
FIELD_PATTERN = r"(?i)^(?:patient\s*)?(first|last|middle|given|surname)\s*name\s*[:\-]\s*([A-Za-z'\-\.\s]+)"
# A label line without a value, alone and together with the line after it.
BARE_LABEL = r"(?imd)^[^\S\n]*(?:patient[^\S\n]*)?name[^\S\n]*[:\-]?[^\S\n]*$"
WRAPPED_LABEL = BARE_LABEL[:-1] + r"\n([^\n]+)$"

FIELD_CONFIDENCE = 0.98
LINE_CONFIDENCE = 0.93
LABEL_CONFIDENCE = 0.94

_TEXTS = 1000  # texts read at a time


def strip(col: Column) -> Column:
    """Trim every blank character, not just the space."""
    return F.trim(col, F.lit(BLANKS))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_breaks(text: Column) -> Column:
    """Text with every kind of line end as a newline."""
    # Plain byte searches first: texts with other line ends are rare, a regex scan is not cheap.
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in OTHER_BREAKS])
    plain = F.regexp_replace(text, "\r\n|[" + OTHER_BREAKS + "]", "\n")
    return F.when(other, plain).otherwise(text)


def split_lines(text: Column) -> Column:
    """All lines, stripped, blank ones kept."""
    return F.transform(F.split(plain_breaks(text), "\n", -1), strip)


def lines_of(text: Column) -> Column:
    """The non-blank stripped lines."""
    return F.filter(split_lines(text), lambda line: line != "")


def join_wrapped_labels(text: Column) -> Column:
    """Give a bare ``Name:`` line the following non-blank line as its value.

    A regex scan consumes both lines before it goes on, so in a run of bare labels only the
    first, third, ... take a value, and the last line of a document cannot.
    """
    return F.regexp_replace(F.array_join(lines_of(text), "\n"), WRAPPED_LABEL, "Name: $1")


def title_case_name(name: Column, hyphens: bool = False) -> Column:
    """Capitalise each word and each part after an apostrophe.

    Parts after a hyphen are lowered (``SMITH-JONES`` -> ``Smith-jones``), as in the data
    this must agree with; ``hyphens=True`` capitalises them as well.
    """

    def capital(piece: Column) -> Column:
        return F.concat(F.upper(F.left(piece, F.lit(1))), F.lower(F.substr(piece, F.lit(2))))

    def by(sep: str, inner):
        return lambda s: F.array_join(F.transform(F.split(s, sep, -1), inner), sep)

    word = by("'", by("-", capital)) if hyphens else by("'", capital)
    words = F.filter(F.split(strip(name), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def clean_tail(value: Column, whole_words: bool = False) -> Column:
    """Cut a value before the first following label word (``... DOB 01/02/1970``).

    The match is on the beginning of a word only (`` no`` also cuts ``JONES, NORA``);
    ``whole_words=True`` asks for the full word.
    """
    pattern = r"(?is)(?<=.) (?:" + "|".join(TAIL_WORDS) + ")" + (r"\b" if whole_words else "")
    return strip(F.regexp_replace(value, pattern + ".*$", ""))


def normalize_name(raw: Column, whole_words: bool = False, hyphens: bool = False) -> Column:
    """``LAST, FIRST M`` -> ``First M Last``; other names need two words, else NULL."""
    cleaned = F.trim(clean_tail(raw, whole_words), F.lit(" ,"))
    ordered = F.regexp_replace(cleaned, r"(?s)^([^,]*),\s*(\S.*)$", "$2 $1")
    return bind(
        ordered, lambda n: F.when(n.rlike(r"\S\s+\S"), title_case_name(n, hyphens))
    )


# The rules above for one text at a time: in nested lambdas of columns every step is interpreted and
# copied. str.splitlines and str.strip know the line ends and blanks named at the top.
_NAME, _ALT_NAME, _PATIENT, _PIPE_CELL, _FIELD, _BARE, _WRAPPED = (
    re.compile(p, re.ASCII)
    for p in (
        NAME_PATTERN, ALT_NAME_PATTERN, PATIENT_PATTERN, PIPE_CELL_PATTERN, FIELD_PATTERN,
        # Java's flag d: a newline is the only line end, as always here.
        BARE_LABEL.replace("(?imd)", "(?im)"), WRAPPED_LABEL.replace("(?imd)", "(?im)"),
    )
)
_TAIL = re.compile(r"(?is)(?<=.) (?:" + "|".join(TAIL_WORDS) + ").*$", re.ASCII)
_LAST_FIRST = re.compile(r"(?s)^([^,]*),\s*(\S.*)$", re.ASCII)
_TWO_WORDS = re.compile(r"\S\s+\S", re.ASCII)
_SPACE = re.compile(r"\s+", re.ASCII)


def _label_lines(text: str) -> list[str]:
    """The lines a name can be read from, wrapped labels joined with their values."""

    def labelled(some: str) -> list[str]:
        lines = zip(some.splitlines(), some.lower().splitlines(), strict=True)
        return [s.strip() for s, low in lines if "name" in low or "patient" in low]

    found = labelled(text)
    if not any(map(_BARE.search, found)):
        return found
    joined = "\n".join(s for s in map(str.strip, text.splitlines()) if s)
    return labelled(_WRAPPED.sub(r"Name: \1", joined))


def _title_case(name: str) -> str:
    """``title_case_name`` of one name."""
    words = [w for w in _SPACE.split(name.strip()) if w]
    return " ".join("'".join(p[:1].upper() + p[1:].lower() for p in w.split("'")) for w in words)


def _cleaned(value: str) -> str:
    """``clean_tail`` of one value, without commas around it."""
    return _TAIL.sub("", value).strip().strip(" ,")


def _normalized(raw: str) -> str | None:
    """``normalize_name`` of one value."""
    name = _LAST_FIRST.sub(r"\2 \1", _cleaned(raw))
    return _title_case(name) if _TWO_WORDS.search(name) else None


def _name_from_fields(lines: list[str]) -> str | None:
    """Name from separate first/middle/last label lines; the last of each kind counts."""
    pairs = [(m[1].lower(), _cleaned(m[2])) for m in map(_FIELD.search, lines) if m]
    pairs = [p for p in pairs if p[1]]
    if len(pairs) < 2:
        return None
    kind_of = {"given": "first", "surname": "last"}
    found = {kind_of.get(kind, kind): value for kind, value in pairs}
    if "first" not in found or "last" not in found:
        return None
    return _title_case(" ".join(found[k] for k in ("first", "middle", "last") if k in found))


def _name_from_lines(lines: list[str]) -> str | None:
    """First usable name from a table cell, ``Patient:`` or ``Name:`` line (whole line)."""
    for line in lines:
        for pattern in (_PIPE_CELL, _PATIENT, _ALT_NAME):
            found = pattern.search(line)
            name = _normalized(found[1]) if found else None
            if name is not None:
                return name
    return None


def _name_from_labels(lines: list[str]) -> str | None:
    """First usable name from a ``Name:`` line that goes on after the name."""
    names = (_normalized(m[1]) for m in map(_NAME.search, lines) if m)
    return next((n for n in names if n is not None), None)


def _person_name(text: str) -> tuple[str, float] | None:
    lines = _label_lines(text)
    if not lines:
        return None
    rules = ((_name_from_fields, FIELD_CONFIDENCE), (_name_from_lines, LINE_CONFIDENCE), (_name_from_labels, LABEL_CONFIDENCE))
    for rule, confidence in rules:
        name = rule(lines)
        if name is not None:
            return name, confidence
    return None


def person_name(text: Column) -> Column:
    """struct(name, confidence) by the best rule that yields a name, else NULL."""

    @F.arrow_udf("struct<name:string,confidence:double>")
    def named(texts: pa.Array) -> pa.Array:
        # In slices, so that the texts of a batch are not all held as Python objects.
        parts = (texts.slice(i, _TEXTS).to_pylist() for i in range(0, len(texts), _TEXTS))
        found = [t and _person_name(t) or None for part in parts for t in part]
        fields = [pa.array([f and f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64()))]
        none = pa.array([f is None for f in found], pa.bool_())
        return pa.StructArray.from_arrays(fields, names=["name", "confidence"], mask=none)

    # Python reads valid UTF-8 only.
    return named(F.make_valid_utf8(text))


def decode_ignoring_errors(content: Column) -> Column:
    """UTF-8 text of bytes, undecodable bytes dropped (a literal U+FFFD goes with them)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
