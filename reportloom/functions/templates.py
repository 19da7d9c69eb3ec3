"""Prompt and chunk texts for images, tables, equations and other content.

A template is plain text with ``{field}`` places. The prompts are our own wording around
the answer shape all of them share; pass ``templates`` to use others. The chunk shapes are
fixed formats.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_ANSWER_SHAPE = (
    'Answer with one JSON object: {"detailed_description": "<description>", "entity_info": '
    '{"entity_name": "{entity_name}", "entity_type": "{entity_type}", '
    '"summary": "<at most 100 words>"}}'
)

_FACTS = {
    "image": "Image path: {img_path}\nCaptions: {captions}\nFootnotes: {footnotes}",
    "table": "Image path: {img_path}\nCaption: {captions}\nBody: {table_body}\nFootnotes: {footnotes}",
    "equation": "Equation: {equation}\nFormat: {text_format}",
    "generic": "Content: {content}",
}

_TASKS = {
    "image": "Describe this image: layout, objects, people, text, colours, and how they relate.",
    "table": "Analyse this table: structure, columns, key figures, trends, and what they mean.",
    "equation": "Explain this equation: meaning, variables, operations, field and uses.",
    "generic": "Analyse this {entity_type} content: structure, key points, and how they relate.",
}


def _prompt(kind: str, with_context: bool) -> str:
    parts = [_TASKS[kind], _ANSWER_SHAPE]
    if with_context:
        parts.append("Relate it to the surrounding content:\n{context}")
    parts.append(_FACTS[kind])
    return "\n\n".join(parts)


PROMPTS = {
    (kind, with_context): _prompt(kind, with_context)
    for kind in _TASKS
    for with_context in (False, True)
}

# The shape of a stored chunk per content kind.
CHUNKS = {
    "image": (
        "\nImage Content Analysis:\nImage Path: {img_path}\nCaptions: {captions}\n"
        "Footnotes: {footnotes}\n\nVisual Analysis: {description}"
    ),
    "table": (
        "Table Analysis:\nImage Path: {img_path}\nCaption: {captions}\nStructure: {table_body}\n"
        "Footnotes: {footnotes}\n\nAnalysis: {description}"
    ),
    "equation": (
        "Mathematical Equation Analysis:\nEquation: {equation}\nFormat: {text_format}\n\n"
        "Mathematical Analysis: {description}"
    ),
    "generic": "{entity_type} Content Analysis:\nContent: {content}\n\nAnalysis: {description}",
}

# Our own wording for content attached to a question.
QUERY_PARTS = {
    "table": "Table: {captions}\n{table_body}",
    "equation": "Formula: {captions}\n{equation}",
    "generic": "{entity_type}: {content}",
}
QUERY_SUFFIX = "\n\nAnswer the question from the content above as well."


def fill(template: str, fields: dict[str, Column]) -> Column:
    """The template with each ``{field}`` replaced by its column (NULL as empty).

    One concatenation of literals and columns, so field values that look like a place are
    left alone.
    """
    parts = re.split(r"\{(" + "|".join(fields) + r")\}", template)
    cols = [
        F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 else F.lit(p)
        for i, p in enumerate(parts)
    ]
    return F.concat(*cols)


def item_fields(item: Column, entity_name: Column, context: Column, description: Column) -> dict[str, Column]:
    """Template fields of a content item struct."""
    kind = F.coalesce(item["type"], F.lit("text"))

    def joined(name: str) -> Column:
        words = F.when(kind == "table", item[f"table_{name}"]).otherwise(item[f"image_{name}"])
        return F.coalesce(F.nullif(F.array_join(words, ", "), F.lit("")), F.lit("None"))

    return {
        "entity_name": entity_name,
        "entity_type": kind,
        "img_path": item["img_path"],
        "captions": joined("caption"),
        "footnotes": joined("footnote"),
        "table_body": item["table_body"],
        "equation": F.coalesce(item["latex"], item["text"]),
        "text_format": item["text_format"],
        "text": item["text"],
        # Items of other kinds keep their meaning in fields of their own.
        "content": F.coalesce(item["raw"], item["text"]),
        "context": context,
        "description": description,
    }


def _by_kind(processor: Column, render) -> Column:
    out = F.when(processor == "image", render("image"))
    for kind in ("table", "equation", "generic"):
        out = out.when(processor == kind, render(kind))
    return out


def render_prompt(
    processor: Column, item: Column, entity_name: Column, context: Column, templates: dict | None = None
) -> Column:
    """Analysis prompt of an item; NULL where the item is not routed to a processor."""
    texts = {**PROMPTS, **(templates or {})}
    fields = item_fields(item, entity_name, context, F.lit(None))
    has_context = F.coalesce(context, F.lit("")) != ""
    return _by_kind(
        processor,
        lambda k: F.when(has_context, fill(texts[(k, True)], fields)).otherwise(fill(texts[(k, False)], fields)),
    )


def render_modal_chunk(processor: Column, item: Column, description: Column) -> Column:
    """Stored text of an analysed item."""
    fields = item_fields(item, F.lit(None), F.lit(None), description)
    return _by_kind(processor, lambda k: fill(CHUNKS[k], fields))


def render_query(question: Column, parts: Column) -> Column:
    """Question followed by its rendered content parts (an array) and a closing line."""
    joined = F.array_join(parts, "\n\n")
    return F.when(
        F.size(parts) > 0, F.concat(question, F.lit("\n\n"), joined, F.lit(QUERY_SUFFIX))
    ).otherwise(question)
