"""Content lists, context, chunks, prompts and upload records."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reportloom.functions import content as ct, templates as tm
from reportloom.operators import content as op, documents as docs
from reportloom.session import spread
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_I = f"WITH {tb.ITEMS_SQL}"


def _items(spark, sf_dir):
    return op.content_items(tb.content_lists(spark, sf_dir))


def _documents(spark, sf_dir):
    return spread(tb.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _truncated_sql(text: str, n: int) -> str:
    words = rf"regexp_extract_all({text}, '\S+\s*')"
    head = f"array_to_string(({words})[1:{n}], '')"
    return rf"""CASE WHEN len({words}) <= {n} THEN {text}
      WHEN contains({head}, '.') THEN regexp_extract({head}, '(?s)^(.*\.)', 1) || '...'
      WHEN contains(rtrim({head}, e' \n\t'), chr(10)) THEN trim(regexp_extract(trim({head}, e' \n\t'), '(?s)^(.*)\n', 1), e' \n\t') || '...'
      ELSE trim({head}, e' \n\t') || '...' END"""


@query(
    "separate_content",
    f"""{_I} SELECT doc_id,
  coalesce(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (coalesce(type, 'text') = 'text'), '') AS text_content,
  count(*) FILTER (coalesce(type, 'text') <> 'text') AS n_modal FROM items GROUP BY doc_id""",
)
def separate_content(spark, sf_dir):
    got = op.separate_content(tb.content_lists(spark, sf_dir))
    return got.select("doc_id", "text_content", F.size("multimodal").alias("n_modal"))


@query(
    "insert_content_list",
    f"""{_I} SELECT doc_id, pos, coalesce(type, '-') AS type, page_idx, coalesce(text_level, 0) AS text_level,
  CASE WHEN coalesce(type, 'text') = 'text' THEN md5(line) ELSE '-' END AS text_md5,
  CASE WHEN type = 'table' THEN md5(line) ELSE '-' END AS body_md5,
  CASE WHEN type = 'image' THEN 'img/' || pos || '.png' ELSE '-' END AS img_path FROM items""",
)
def insert_content_list(spark, sf_dir):
    dash = F.lit("-")
    return _items(spark, sf_dir).select(
        "doc_id", "pos", F.coalesce("type", dash).alias("type"), "page_idx",
        F.coalesce("text_level", F.lit(0)).alias("text_level"),
        F.coalesce(F.md5("text"), dash).alias("text_md5"),
        F.coalesce(F.md5("table_body"), dash).alias("body_md5"),
        F.coalesce("img_path", dash).alias("img_path"),
    )


@query(
    "read_content_list",
    f"""{_I} SELECT doc_id, pos, coalesce(type, '-') AS type, page_idx,
  CASE WHEN type = 'image' THEN '-' ELSE md5(line) END AS line_md5,
  CASE type WHEN 'image' THEN 'I' || pos || ', more' WHEN 'table' THEN 'T' || pos ELSE '' END AS captions FROM items""",
)
def read_content_list(spark, sf_dir):
    as_json = tb.content_lists(spark, sf_dir).select("doc_id", F.to_json("items").alias("json"))
    items = op.content_items(as_json.select("doc_id", ct.parse_content_list(F.col("json")).alias("items")))
    body = F.coalesce("text", "table_body", "latex")
    captions = F.array_join(F.coalesce("image_caption", "table_caption", F.array().cast("array<string>")), ", ")
    return items.select(
        "doc_id", "pos", F.coalesce("type", F.lit("-")).alias("type"), "page_idx",
        F.coalesce(F.md5(body), F.lit("-")).alias("line_md5"), captions.alias("captions"),
    )


@query(
    "content_type_distribution",
    f"{_I} SELECT type, count(*) AS n_items FROM items WHERE coalesce(type, 'text') <> 'text' GROUP BY type",
)
def content_type_distribution(spark, sf_dir):
    return op.content_type_distribution(_items(spark, sf_dir))


@query(
    "content_type_distribution_all",
    f"{_I} SELECT coalesce(type, 'unknown') AS type, count(*) AS n_items FROM items GROUP BY 1",
)
def content_type_distribution_all(spark, sf_dir):
    return op.content_type_distribution(_items(spark, sf_dir), multimodal_only=False)


@query(
    "route_content",
    f"""{_I} SELECT coalesce(CASE type WHEN 'image' THEN 'image' WHEN 'table' THEN NULL WHEN 'equation' THEN 'equation'
  ELSE 'generic' END, 'skipped') AS processor, count(*) AS n FROM items GROUP BY 1""",
)
def route_content(spark, sf_dir):
    processor = F.coalesce(ct.route_content(F.col("type"), table=False), F.lit("skipped"))
    return _items(spark, sf_dir).groupBy(processor.alias("processor")).agg(F.count(F.lit(1)).alias("n"))


@query("format_context", f"{_I} SELECT doc_id, pos, shown FROM shown WHERE shown IS NOT NULL")
def format_context(spark, sf_dir):
    fields = ("type", "text", "text_level", "image_caption", "table_caption")
    got = _items(spark, sf_dir).select("doc_id", "pos", ct.format_context(F.struct(*fields)).alias("shown"))
    return got.where("shown IS NOT NULL")


def _context_sql(near: str, types: str, n: int) -> str:
    return f"""{_I},
ctx AS (
  SELECT t.doc_id, t.pos, coalesce(string_agg(s.shown, chr(10) ORDER BY s.page_idx, s.pos), '') AS c
  FROM items t LEFT JOIN shown s ON s.doc_id = t.doc_id AND s.shown IS NOT NULL AND s.pos <> t.pos
    AND coalesce(s.type, 'text') IN ({types}) AND {near}
  WHERE coalesce(t.type, 'text') <> 'text' GROUP BY t.doc_id, t.pos)
SELECT doc_id, pos, {_truncated_sql('c', n)} AS context FROM ctx"""


@query("page_context", _context_sql("s.page_idx BETWEEN t.page_idx - 1 AND t.page_idx + 1", "'text'", 60))
def page_context(spark, sf_dir):
    return op.page_context(_items(spark, sf_dir), 1, 60)


_CHUNK_CONTEXT_SQL = _context_sql("s.pos BETWEEN t.pos - 2 AND t.pos + 2", "'text', 'image', 'table'", 40)


@query("chunk_context", _CHUNK_CONTEXT_SQL)
def chunk_context(spark, sf_dir):
    return op.chunk_context_of_lists(tb.content_lists(spark, sf_dir), "items", ("doc_id",), 2, 40, ("text", "image", "table"))


@query("chunk_context_by_position", _CHUNK_CONTEXT_SQL)
def chunk_context_by_position(spark, sf_dir):
    """The same from items that stand in rows of their own."""
    return op.chunk_context(_items(spark, sf_dir), 2, 40, ("text", "image", "table"))


@query("truncate_to_tokens", f"SELECT doc_id, {_truncated_sql('text', 100)} AS short FROM documents")
def truncate_to_tokens(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id", ct.truncate_to_words(F.col("text"), 100).alias("short")
    )


@query(
    "truncate_text",
    "SELECT doc_id, md5(substring(text, 1, 4000)) AS head, md5(right(text, 400)) AS tail FROM documents",
)
def truncate_text(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.substring("text", 1, 4000)).alias("head"), F.md5(F.right("text", F.lit(400))).alias("tail")
    )


_STRIP = r"e' \t\r\n 　'"
CHUNKS_SQL = rf"""pieces AS (
  SELECT {{key}}, p, trim(piece, {_STRIP}) AS piece FROM (
    SELECT {{key}}, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p
    FROM (SELECT {{key}}, {{split}} AS ps FROM {{source}}))),
words AS (SELECT *, string_split_regex(piece, '\s+') AS w FROM pieces WHERE piece <> ''),
starts AS (
  SELECT {{key}}, p, 1 AS s, piece AS chunk FROM words WHERE len(w) <= {{size}}
  UNION ALL
  SELECT {{key}}, p, s, array_to_string(w[s:s + {{size}} - 1], ' ')
  FROM (SELECT *, unnest(range(1, len(w) + 1, {{step}})) AS s FROM words WHERE len(w) > {{size}})),
chunks AS (
  SELECT {{key}}, CAST(row_number() OVER (PARTITION BY {{key}} ORDER BY p, s) - 1 AS INT) AS chunk_index, chunk,
         len(string_split_regex(chunk, '\s+')) AS n_words FROM starts)"""


def _chunks_sql(source="documents", key="doc_id", split="[text]", size=ct.CHUNK_WORDS, overlap=ct.CHUNK_OVERLAP) -> str:
    return CHUNKS_SQL.format(source=source, key=key, split=split, size=size, step=size - overlap)


@query("chunk_text", f"WITH {_chunks_sql(size=120, overlap=20)} SELECT * FROM chunks")
def chunk_text(spark, sf_dir):
    return op.chunk_documents(_documents(spark, sf_dir), size=120, overlap=20)


@query(
    "chunk_text_by_character",
    f"WITH {_chunks_sql(split='string_split(text, chr(10))', size=40, overlap=10)} SELECT * FROM chunks",
)
def chunk_text_by_character(spark, sf_dir):
    return op.chunk_documents(_documents(spark, sf_dir), split_by="\n", size=40, overlap=10)


@query("chunk_text_default", f"WITH {_chunks_sql()} SELECT doc_id, chunk_index, md5(chunk) AS chunk, n_words FROM chunks")
def chunk_text_default(spark, sf_dir):
    return op.chunk_documents(_documents(spark, sf_dir)).withColumn("chunk", F.md5("chunk"))


@query(
    "document_id",
    """SELECT md5(text) AS document_id, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1""",
)
def document_id(spark, sf_dir):
    return docs.distinct_documents(tb.table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", docs.content_hash(F.col("text")).alias("sha256"))


# ---- prompts -------------------------------------------------------------------------


def fill_sql(template: str, fields: dict[str, str]) -> str:
    parts = re.split(r"\{(" + "|".join(fields) + r")\}", template)
    out = [
        f"coalesce(CAST({fields[p]} AS VARCHAR), '')" if i % 2 else "'" + p.replace("'", "''") + "'"
        for i, p in enumerate(parts)
    ]
    return " || ".join(out)


_FIELDS = {
    "entity_name": "'item ' || pos",
    "entity_type": "coalesce(type, 'text')",
    "img_path": "CASE WHEN type = 'image' THEN 'img/' || pos || '.png' END",
    "captions": "CASE type WHEN 'image' THEN 'I' || pos || ', more' WHEN 'table' THEN 'T' || pos ELSE 'None' END",
    "footnotes": "'None'",
    "table_body": "CASE WHEN type = 'table' THEN line END",
    "equation": "CASE WHEN type = 'equation' OR coalesce(type, 'text') = 'text' THEN line END",
    "text_format": "CASE WHEN type = 'equation' THEN 'LaTeX' END",
    "text": "CASE WHEN coalesce(type, 'text') = 'text' THEN line END",
    "content": "CASE WHEN coalesce(type, 'text') = 'text' THEN line END",
    "context": "CASE WHEN pos % 2 = 0 THEN 'near ' || page_idx END",
    "description": "'about ' || pos",
}
_PROCESSOR = "CASE WHEN type IN ('image', 'table', 'equation') THEN type ELSE 'generic' END"


def _prompt_case() -> str:
    arms = [
        f"WHEN {_PROCESSOR} = '{kind}' AND (pos % 2 = 0) = {str(flag).lower()} THEN {fill_sql(text, _FIELDS)}"
        for (kind, flag), text in tm.PROMPTS.items()
    ]
    return "CASE " + "\n".join(arms) + " END"


@query("render_prompts", f"{_I} SELECT doc_id, pos, {_prompt_case()} AS prompt FROM items")
def render_prompts(spark, sf_dir):
    pos = F.col("pos").cast("string")
    context = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("near "), F.col("page_idx").cast("string")))
    items = _items(spark, sf_dir)
    item = F.struct(*[F.col(c) for c in items.columns if c not in ("doc_id", "pos")])
    prompt = tm.render_prompt(ct.route_content(F.col("type")), item, F.concat(F.lit("item "), pos), context)
    return items.select("doc_id", "pos", prompt.alias("prompt"))


def _chunk_case() -> str:
    arms = [f"WHEN {_PROCESSOR} = '{k}' THEN {fill_sql(t, _FIELDS)}" for k, t in tm.CHUNKS.items()]
    return "CASE " + "\n".join(arms) + " END"


@query("render_modal_chunks", f"{_I} SELECT doc_id, pos, {_chunk_case()} AS chunk FROM items")
def render_modal_chunks(spark, sf_dir):
    items = _items(spark, sf_dir)
    item = F.struct(*[F.col(c) for c in items.columns if c not in ("doc_id", "pos")])
    description = F.concat(F.lit("about "), F.col("pos").cast("string"))
    chunk = tm.render_modal_chunk(ct.route_content(F.col("type")), item, description)
    return items.select("doc_id", "pos", chunk.alias("chunk"))


@query(
    "generic_content_items",
    """SELECT p_partkey, u.pos::INT AS pos, u.chunk AS chunk FROM (SELECT p_partkey, unnest([
  {'pos': 0, 'chunk': 'chart Content Analysis:' || chr(10) || 'Content: {"type":"chart","chart_data":{"brand":"' || p_brand || '","size":' || p_size
    || '},"page_idx":3}' || chr(10) || chr(10) || 'Analysis: seen'},
  {'pos': 1, 'chunk': chr(10) || 'Image Content Analysis:' || chr(10) || 'Image Path: ' || chr(10) || 'Captions: ' || p_name || chr(10)
    || 'Footnotes: None' || chr(10) || chr(10) || 'Visual Analysis: seen'}]) AS u FROM part)""",
)
def generic_content_items(spark, sf_dir):
    """An unknown kind with fields of its own, and a caption given as one string."""
    chart = F.struct(
        F.lit("chart").alias("type"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("chart_data"),
        F.lit(3).alias("page_idx"),
    )
    image = F.struct(F.lit("image").alias("type"), F.col("p_name").alias("image_caption"))
    json = F.concat(F.lit("["), F.to_json(chart), F.lit(","), F.to_json(image), F.lit("]"))
    lists = tb.table(spark, sf_dir, "part").select("p_partkey", ct.parse_content_list(json).alias("items"))
    rows = lists.select("p_partkey", F.posexplode("items").alias("pos", "item"))
    chunk = tm.render_modal_chunk(ct.route_content(F.col("item.type")), F.col("item"), F.lit("seen"))
    return rows.select("p_partkey", "pos", chunk.alias("chunk"))


@query(
    "parse_modal_json",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'value ' || CAST(floor(value) AS BIGINT) ELSE '-' END AS description,
  CASE WHEN event_type <> 'error' THEN event_type ELSE '-' END AS entity_name,
  CASE WHEN event_type NOT IN ('error', 'view') THEN 'about ' || user_id ELSE '-' END AS summary FROM events""",
)
def parse_modal_json(spark, sf_dir):
    kind = F.col("event_type")
    info = F.struct(
        kind.alias("entity_name"), F.lit("image").alias("entity_type"),
        F.when(kind != "view", F.concat(F.lit("about "), F.col("user_id").cast("string"))).alias("summary"),
    )
    whole = F.to_json(
        F.struct(F.concat(F.lit("value "), F.floor("value").cast("string")).alias("detailed_description"), info.alias("entity_info"))
    )
    answer = F.when(kind == "error", F.concat(F.lit("Sorry: "), whole)).otherwise(whole)
    m = ct.parse_modal_json(answer)
    got = tb.table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    dash = F.lit("-")
    return got.select(
        "event_id", F.coalesce("m.detailed_description", dash).alias("description"),
        F.coalesce("m.entity_info.entity_name", dash).alias("entity_name"),
        F.coalesce("m.entity_info.summary", dash).alias("summary"),
    )


# ---- uploads -------------------------------------------------------------------------

_AS_OF = "2025-02-09"
UPLOADS_SQL = f"""uploads AS (
  SELECT c_custkey, c_custkey % 4 AS k,
    CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Unknown' WHEN 2 THEN c_name ELSE 'Unknown' END AS patient_name,
    CASE WHEN c_custkey % 4 = 0 THEN 'P' || c_custkey END AS patient_id,
    CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 2 THEN 'Lipid Profile' ELSE 'General' END AS test_type,
    CASE c_custkey % 4 WHEN 0 THEN '2024-03-0' || (1 + c_nationkey % 9) ELSE '{_AS_OF}' END AS test_date,
    c_nationkey, c_acctbal FROM customer)"""


def _uploads(spark, sf_dir):
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    day = F.concat(F.lit("2024-03-0"), (1 + F.col("c_nationkey") % 9).cast("string"))
    analytes = F.array(
        F.struct(F.lit("Iron").alias("name"), F.col("c_nationkey").cast("string").alias("value"), F.lit("ug/dL").alias("unit"),
                 F.lit("1-9").alias("range"), F.lit("high").alias("status")),
        F.struct(F.lit(None).alias("name"), F.lit("7").alias("value"), F.lit(None).alias("unit"), F.lit(None).alias("range"),
                 F.lit(None).alias("status")),
    )
    full = F.to_json(F.struct(F.col("c_name").alias("patient_name"), F.concat(F.lit("P"), key).alias("patient_id"),
                              F.col("c_mktsegment").alias("test_type"), day.alias("test_date"), analytes.alias("analytes")))
    empty = F.lit('{"patient_name":"","test_type":null,"analytes":null}')
    partial = F.to_json(F.struct(F.col("c_name").alias("patient_name"), F.lit("Lipid Profile").alias("test_type")))
    json = F.when(k == 0, full).when(k == 1, empty).when(k == 2, partial).otherwise(F.lit("not json"))
    rows = tb.table(spark, sf_dir, "customer").withColumn("json", json)
    return rows.select("c_custkey", F.inline(F.array(F.struct(ct.parse_entities_json(F.col("json"), _AS_OF).alias("entities")))))


@query(
    "parse_entities_json",
    f"""WITH {UPLOADS_SQL} SELECT c_custkey, patient_name, coalesce(patient_id, '-') AS patient_id, test_type, test_date,
  CASE WHEN k = 0 THEN 2 ELSE 0 END AS n_analytes FROM uploads""",
)
def parse_entities_json(spark, sf_dir):
    return _uploads(spark, sf_dir).select(
        "c_custkey", "entities.patient_name", F.coalesce("entities.patient_id", F.lit("-")).alias("patient_id"),
        "entities.test_type", "entities.test_date", F.size("entities.analytes").alias("n_analytes"),
    )


@query(
    "explode_analytes",
    f"""WITH {UPLOADS_SQL} SELECT c_custkey, 0 AS pos, 'Iron' AS name, CAST(c_nationkey AS VARCHAR) AS value, 'ug/dL' AS unit FROM uploads WHERE k = 0
UNION ALL SELECT c_custkey, 1, '-', '7', '-' FROM uploads WHERE k = 0
UNION ALL SELECT c_custkey, -1, '-', '-', '-' FROM uploads WHERE k > 0""",
)
def explode_analytes(spark, sf_dir):
    got = op.explode_analytes(_uploads(spark, sf_dir), keep=("c_custkey",))
    dash = F.lit("-")
    return got.select(
        "c_custkey", F.coalesce("pos", F.lit(-1)).alias("pos"),
        *[F.coalesce(c, dash).alias(c) for c in ("name", "value", "unit")],
    )


@query("generate_patient_id", "SELECT c_custkey, 'P' || upper(left(md5(lower(c_name)), 6)) AS patient_id FROM customer")
def generate_patient_id(spark, sf_dir):
    return tb.table(spark, sf_dir, "customer").select(
        "c_custkey", ct.generate_patient_id(F.upper("c_name")).alias("patient_id")
    )


_REPORT_NAME_SQL = """coalesce(patient_id, 'P' || upper(left(md5(lower(patient_name)), 6))) || '_' || replace(test_type, ' ', '_')
  || '_' || replace(test_date, '-', '') || '.md'"""


def _report_name():
    e = F.col("entities")
    return ct.generate_report_name(e["patient_id"], e["patient_name"], e["test_type"], e["test_date"])


@query("generate_report_name", f"WITH {UPLOADS_SQL} SELECT c_custkey, {_REPORT_NAME_SQL} AS file_name FROM uploads")
def generate_report_name(spark, sf_dir):
    return _uploads(spark, sf_dir).select("c_custkey", _report_name().alias("file_name"))


_MARKDOWN_SQL = """'# Lab Report - ' || test_type || repeat(chr(10), 2) || '**Patient:** ' || patient_name || '  ' || chr(10)
  || '**Patient ID:** ' || coalesce(patient_id, 'Not specified') || '  ' || chr(10) || '**Test Date:** ' || test_date || '  ' || chr(10)
  || '**Test Type:** ' || test_type || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || '## Test Results' || repeat(chr(10), 2)
  || CASE WHEN k = 0 THEN '| Analyte | Value | Unit | Reference Range | Status |' || chr(10)
       || '|---------|-------|------|----------------|--------|' || chr(10)
       || '| Iron | ' || c_nationkey || ' | ug/dL | 1-9 | high |' || chr(10) || '| Unknown | 7 |  | - | unknown |' || chr(10)
       || chr(10) || '---' || repeat(chr(10), 2) ELSE '' END
  || '## Original Report Content' || repeat(chr(10), 2) || 'original ' || c_custkey"""


def _markdown():
    original = F.concat(F.lit("original "), F.col("c_custkey").cast("string"))
    return ct.format_report_markdown(F.col("entities"), original)


@query("format_report_markdown", f"WITH {UPLOADS_SQL} SELECT c_custkey, {_MARKDOWN_SQL} AS text FROM uploads")
def format_report_markdown(spark, sf_dir):
    return _uploads(spark, sf_dir).select("c_custkey", _markdown().alias("text"))


@query(
    "write_formatted_reports",
    f"""WITH {UPLOADS_SQL}, files AS (SELECT c_custkey, {_REPORT_NAME_SQL} AS file_name, {_MARKDOWN_SQL} AS text FROM uploads)
SELECT file_name, arg_max(text, c_custkey) AS text FROM files GROUP BY file_name""",
)
def write_formatted_reports(spark, sf_dir):
    from reportloom.sinks.tables import formatted_reports

    files = _uploads(spark, sf_dir).select("c_custkey", _report_name().alias("file_name"), _markdown().alias("text"))
    return formatted_reports(files, ["c_custkey"])
