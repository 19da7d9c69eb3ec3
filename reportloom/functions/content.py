"""Content items, tokens, chunks and rendered texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions import text as tx
from reportloom.schemas import CONTENT_LIST_DDL, ENTITIES_DDL, MODAL_DDL

MAX_CONTEXT_WORDS = 2000
CHUNK_WORDS = 1200
CHUNK_OVERLAP = 100

MODAL_KINDS = ("image", "table", "equation")


def kind_of(item_type: Column) -> Column:
    """Item type; a missing one means text."""
    return F.coalesce(item_type, F.lit("text"))


def parse_content_list(json: Column) -> Column:
    """Content items of a JSON list; ``raw`` holds each item whole, with fields no schema knows.

    A caption or footnote given as one string counts as a list of one.
    """
    both = F.arrays_zip(F.from_json(json, CONTENT_LIST_DDL).alias("item"), F.from_json(json, "array<string>").alias("raw"))

    def item(z: Column) -> Column:
        out = z["item"].withField("raw", z["raw"])
        for name in ("image_caption", "image_footnote", "table_caption", "table_footnote"):
            single = F.get_json_object(z["raw"], f"$.{name}")
            out = out.withField(
                name, F.coalesce(z["item"][name], F.when(single.isNotNull() & ~F.startswith(single, F.lit("[")), F.array(single)))
            )
        return out

    return F.transform(both, item)


def separate_text(items: Column) -> Column:
    """Non-blank texts of the text items, joined by an empty line."""
    texts = F.filter(items, lambda i: (kind_of(i["type"]) == "text") & (tx.strip(i["text"]) != ""))
    return F.array_join(F.transform(texts, lambda i: i["text"]), "\n\n")


def separate_modal(items: Column) -> Column:
    """All items that are not text, in order."""
    return F.filter(items, lambda i: kind_of(i["type"]) != "text")


def route_content(
    item_type: Column, image: bool = True, table: bool = True, equation: bool = True, generic: bool = True
) -> Column:
    """Processor for an item type. A disabled processor gives NULL, never the generic one."""

    def on(enabled: bool, name: str) -> Column:
        return F.lit(name if enabled else None).cast("string")

    return (
        F.when(item_type == "image", on(image, "image"))
        .when(item_type == "table", on(table, "table"))
        .when(item_type == "equation", on(equation, "equation"))
        .otherwise(on(generic, "generic"))
    )


def format_context(item: Column, headers: bool = True, captions: bool = True) -> Column:
    """How an item reads inside a context: ``## Title``, text, ``[Image: caption]``.

    ``item`` is a struct column of content item fields.
    """
    kind = kind_of(item["type"])
    level = item["text_level"]
    text = item["text"]
    if headers:
        text = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    shown = F.when(kind == "text", text)
    if captions:
        for name, field in (("Image", "image_caption"), ("Table", "table_caption")):
            words = F.array_join(item[field], ", ")
            some = (kind == name.lower()) & (F.size(item[field]) > 0)
            shown = shown.when(some, F.concat(F.lit(f"[{name}: "), words, F.lit("]")))
    return F.nullif(tx.strip(shown), F.lit(""))


def n_words(text: Column) -> Column:
    """Blank-separated words; stands in for a model's token count."""
    trimmed = tx.strip(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def truncate_to_words(text: Column, max_words: int = MAX_CONTEXT_WORDS) -> Column:
    """Text of at most ``max_words`` words, line breaks kept.

    A longer text ends at its last full stop inside the limit, else at the last line end,
    else at the last word, and gets ``...`` appended.
    """

    def cut(words: Column) -> Column:
        head = tx.strip(F.array_join(F.slice(words, 1, max_words), ""))

        def end(h: Column) -> Column:
            def before(mark: str) -> Column:
                return F.left(h, F.length(h) - F.length(F.substring_index(h, mark, -1)))

            short = (
                F.when(F.contains(h, F.lit(".")), before("."))
                .when(F.contains(h, F.lit("\n")), tx.strip(before("\n")))
                .otherwise(h)
            )
            return F.concat(short, F.lit("..."))

        return F.when(F.size(words) > max_words, tx.bind(head, end)).otherwise(text)

    return tx.bind(F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0)), cut)


def chunk_text(
    text: Column,
    split_by: str | None = None,
    split_only: bool = False,
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP,
) -> Column:
    """Array of chunks.

    With ``split_by`` the text is cut there first, and pieces over ``size`` words are cut
    again unless ``split_only``. Longer pieces give windows of ``size`` words that start
    every ``size - overlap`` words. Blank pieces give nothing.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    pieces = F.split(text, _quote(split_by), -1) if split_by else F.array(text)
    pieces = F.filter(F.transform(pieces, tx.strip), lambda p: p != "")
    if split_by and split_only:
        return pieces

    def windows(piece: Column) -> Column:
        def cut(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(words), F.lit(size - overlap))
            many = F.transform(starts, lambda s: F.array_join(F.slice(words, s, F.lit(size)), " "))
            return F.when(F.size(words) > size, many).otherwise(F.array(piece))

        return tx.bind(F.split(piece, r"\s+"), cut)

    return F.flatten(F.transform(pieces, windows))


def _quote(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in literal)


# ---- uploads -------------------------------------------------------------------------


def generate_patient_id(name: Column) -> Column:
    """``P`` and six hex digits from the name, the same for any case."""
    return F.concat(F.lit("P"), F.upper(F.left(F.md5(F.lower(name)), F.lit(6))))


def generate_report_name(
    patient_id: Column, patient_name: Column, test_type: Column, test_date: Column
) -> Column:
    """``{id}_{type}_{yyyymmdd}.md``; the id comes from the name when it is missing."""
    pid = F.coalesce(F.nullif(patient_id, F.lit("")), generate_patient_id(patient_name))
    kind = F.replace(test_type, F.lit(" "), F.lit("_"))
    day = F.replace(test_date, F.lit("-"), F.lit(""))
    return F.concat(pid, F.lit("_"), kind, F.lit("_"), day, F.lit(".md"))


def parse_entities_json(json: Column, as_of: str) -> Column:
    """Upload entities with defaults for empty, missing or unreadable values.

    ``as_of`` (YYYY-MM-DD) stands for today, so a re-run gives the same rows.
    """
    parsed = F.from_json(json, ENTITIES_DDL, {"mode": "PERMISSIVE"})

    def fill(e: Column) -> Column:
        def default(field: str, value: str) -> Column:
            return F.coalesce(F.nullif(e[field], F.lit("")), F.lit(value)).alias(field)

        none = F.from_json(F.lit("[]"), ENTITIES_DDL[ENTITIES_DDL.index("array<") : -1])
        return F.struct(
            default("patient_name", "Unknown"),
            e["patient_id"].alias("patient_id"),
            default("test_type", "General"),
            default("test_date", as_of),
            F.coalesce(e["analytes"], none).alias("analytes"),
        )

    return tx.bind(parsed, fill)


def parse_modal_json(json: Column) -> Column:
    """struct(detailed_description, entity_info) from a model answer; NULL if unreadable."""
    parsed = F.from_json(json, MODAL_DDL, {"mode": "PERMISSIVE"})
    return F.when(parsed["detailed_description"].isNotNull(), parsed)


def format_report_markdown(entities: Column, original: Column) -> Column:
    """Report text: header block, value table (if there are values), original text.

    The layout is a fixed value.
    """
    pid = F.coalesce(F.nullif(entities["patient_id"], F.lit("")), F.lit("Not specified"))
    head = F.concat(
        F.lit("# Lab Report - "), entities["test_type"],
        F.lit("\n\n**Patient:** "), entities["patient_name"],
        F.lit("  \n**Patient ID:** "), pid,
        F.lit("  \n**Test Date:** "), entities["test_date"],
        F.lit("  \n**Test Type:** "), entities["test_type"],
        F.lit("\n\n---\n\n## Test Results\n\n"),
    )

    def row(a: Column) -> Column:
        cells = [("name", "Unknown"), ("value", "-"), ("unit", ""), ("range", "-"), ("status", "unknown")]
        parts = [F.coalesce(a[f], F.lit(d)) for f, d in cells]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |\n"))

    table = F.concat(
        F.lit("| Analyte | Value | Unit | Reference Range | Status |\n"),
        F.lit("|---------|-------|------|----------------|--------|\n"),
        F.array_join(F.transform(entities["analytes"], row), ""),
        F.lit("\n---\n\n"),
    )
    body = F.when(F.size(entities["analytes"]) > 0, table).otherwise(F.lit(""))
    return F.concat(head, body, F.lit("## Original Report Content\n\n"), original)


def answer_file_stem(question: Column, prefix: str = "sql_") -> Column:
    """File stem for an answer: leading words of the question joined by ``_`` and a hash of all of it.

    The hash keeps the answers of questions apart that begin alike or differ in signs only.
    """
    words = F.left(F.regexp_replace(question, "[^A-Za-z0-9]+", "_"), F.lit(80))
    return F.concat(F.lit(prefix), F.trim(words, F.lit("_")), F.lit("_"), F.left(F.sha2(question, 256), F.lit(12)))
