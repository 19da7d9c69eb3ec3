"""Rules over file paths and bytes, on paths and bytes derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.session import workspace
from reportloom.sinks import files as sink
from reportloom.sources import files as op
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_SUFFIXES = (".pdf", ".PNG", ".docx", ".md", ".exe", "", ".jpeg")
_PATHS_SQL = f"""files AS (
  SELECT doc_id, '/in/' || source || '/v1.2/' || doc_id || ([{", ".join(f"'{s}'" for s in _SUFFIXES)}])[CAST(doc_id % 7 AS INT) + 1] AS path,
         ([{", ".join(f"'{s.lower()}'" for s in _SUFFIXES)}])[CAST(doc_id % 7 AS INT) + 1] AS suffix, source, text, n_chars FROM documents)"""


def _paths(spark, sf_dir):
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("/v1.2/"), F.col("doc_id").cast("string"), suffix)
    return tb.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", "n_chars")


_FOLDER_SUFFIXES = (".pdf", ".PDF", ".md", ".exe")
_FOLDER_SQL = f"""files AS (
  SELECT 'D' || doc_id || ([{", ".join(f"'{s}'" for s in _FOLDER_SUFFIXES)}])[CAST(doc_id % 4 AS INT) + 1] AS name, strlen(text) + 1 AS size_bytes,
         text, doc_id FROM documents)"""


def _folder(spark, sf_dir):
    """Every document as a file in a new shared folder, a stray byte after its text."""
    suffix = F.get(F.array(*[F.lit(s) for s in _FOLDER_SUFFIXES]), (F.col("doc_id") % 4).cast("int"))
    rows = tb.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), suffix).alias("name"),
        F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))).alias("content"),
    )
    folder = workspace(spark, "files")
    sink.write_file_per_row(rows, folder)
    return folder


@query("scan_report_files", f"WITH {_FOLDER_SQL} SELECT name, size_bytes FROM files WHERE lower(name) LIKE '%.pdf'")
def scan_report_files(spark, sf_dir):
    return op.scan_report_files(spark, _folder(spark, sf_dir)).select("name", "size_bytes")


@query(
    "hash_report_files",
    f"WITH {_FOLDER_SQL} SELECT name, sha256(encode(text) || '\\xFF'::BLOB) AS sha256 FROM files WHERE lower(name) LIKE '%.pdf'",
)
def hash_report_files(spark, sf_dir):
    return op.hash_report_files(spark, _folder(spark, sf_dir)).select("name", "sha256")


@query(
    "list_files",
    f"""WITH {_FOLDER_SQL} SELECT name, lower(regexp_extract(name, '[.]\\w+$')) AS suffix, size_bytes AS length,
  CASE WHEN name LIKE '%.exe' THEN 'unsupported file type' ELSE '-' END AS reject_reason FROM files""",
)
def list_files(spark, sf_dir):
    listed = op.filter_supported_files(op.list_files(spark, [_folder(spark, sf_dir)]))
    return listed.select(
        op.file_name(F.col("path")).alias("name"), "suffix", "length", F.coalesce("reject_reason", F.lit("-")).alias("reject_reason")
    )


_NESTED_SQL = """source || '/' || coalesce(lang, '-') || '/' || (doc_id // 100 % 10) || '/D' || doc_id || '.md'"""


@query("list_nested_files", f"SELECT {_NESTED_SQL} AS name, strlen(text) AS length FROM documents")
def list_nested_files(spark, sf_dir):
    """Every document as a file three folders deep, found level by level."""
    below = F.concat_ws(
        "/", "source", F.coalesce("lang", F.lit("-")), F.expr("cast(doc_id div 100 % 10 as string)"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(".md")),
    )
    folder = workspace(spark, "files")
    rows = tb.table(spark, sf_dir, "documents").select(below.alias("name"), F.encode("text", "UTF-8").alias("content"))
    sink.write_file_per_row(rows, folder)
    return op.list_files(spark, [folder]).select(F.substring_index("path", "/", -4).alias("name"), "length")


@query("scan_parsed_folder", f"WITH {_FOLDER_SQL} SELECT 'D' || doc_id AS report_id, md5(text) AS text_md5 FROM files WHERE name LIKE '%.md'")
def scan_parsed_folder(spark, sf_dir):
    return op.scan_parsed_text(spark, _folder(spark, sf_dir)).select("report_id", F.md5("text").alias("text_md5"))


@query(
    "filter_supported_files",
    f"""WITH {_PATHS_SQL} SELECT doc_id, path, suffix,
  CASE WHEN suffix IN ('.exe', '') THEN 'unsupported file type' ELSE '-' END AS reject_reason FROM files""",
)
def filter_supported_files(spark, sf_dir):
    got = op.filter_supported_files(_paths(spark, sf_dir).select("doc_id", "path"))
    return got.withColumn("reject_reason", F.coalesce("reject_reason", F.lit("-")))


@query(
    "supported_extensions",
    f"""WITH {_PATHS_SQL} SELECT suffix, count(*) AS n_files FROM files WHERE suffix NOT IN ('.exe', '') GROUP BY suffix""",
)
def supported_extensions(spark, sf_dir):
    suffix = op.suffix_of(F.col("path"))
    kept = _paths(spark, sf_dir).where(suffix.isin(*op.supported_extensions()))
    return kept.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "validate_images",
    f"""WITH {_PATHS_SQL} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing'
  WHEN suffix NOT IN ('.png', '.jpeg') THEN 'unsupported image format' WHEN n_chars > 1000 THEN 'too large' ELSE '-' END AS reject_reason FROM files""",
)
def validate_images(spark, sf_dir):
    sized = _paths(spark, sf_dir).withColumn("length", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")))
    got = op.validate_images(sized, max_bytes=1000)
    return got.select("doc_id", F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"))


@query(
    "output_path_layout",
    f"WITH {_PATHS_SQL} SELECT doc_id, '/out/' || source || '/v1.2/' || doc_id AS folder FROM files",
)
def output_path_layout(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", op.output_path(F.col("path"), "/in", "/out/").alias("folder"))


@query(
    "read_image_files",
    f"""WITH {_PATHS_SQL} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE to_base64(encode(text)) END AS image_base64,
  CASE suffix WHEN '.png' THEN 'image/png' ELSE 'image/jpeg' END AS media_type FROM files""",
)
def read_image_files(spark, sf_dir):
    content = F.when(F.col("doc_id") % 11 != 0, F.encode("text", "UTF-8"))
    got = op.encode_images(_paths(spark, sf_dir).withColumn("content", content))
    return got.select("doc_id", "image_base64", "media_type")


@query(
    "read_text_with_fallback",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(chr(255) || regexp_replace(text, '[^\x20-\x7e\n]', '', 'g')) END AS text_md5,
  CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS encoding_used FROM documents""",
)
def read_text_with_fallback(spark, sf_dir):
    ascii_only = F.encode(F.regexp_replace("text", r"[^\x20-\x7e\n]", ""), "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FF")), ascii_only))
    files = tb.table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return op.decode_with_fallback(files).select("doc_id", F.md5("text").alias("text_md5"), "encoding_used")


@query(
    "scan_parsed_text",
    r"""SELECT doc_id, md5(text) AS text_md5 FROM documents""",
)
def scan_parsed_text(spark, sf_dir):
    """The decoding rule of the text scan: bytes with a stray 0xFF after every text."""
    from reportloom.functions.text import decode_ignoring_errors

    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE")))
    rows = tb.table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", F.md5(decode_ignoring_errors(F.col("content"))).alias("text_md5"))
