"""Files as DataFrames, and rules over file paths and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.functions import content as ct, text as tx
from reportloom.session import workspace

# Suffixes that can be parsed, by group.
SUFFIX_GROUPS = {
    "pdf": (".pdf",),
    "image": (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".gif", ".webp"),
    "office": (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"),
    "text": (".txt", ".md"),
}
SUPPORTED_SUFFIXES = tuple(s for group in SUFFIX_GROUPS.values() for s in group)

# Media types by suffix, and the one for everything else.
IMAGE_MEDIA_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".webp": "image/webp",
}
DEFAULT_MEDIA_TYPE = "image/jpeg"
MAX_IMAGE_BYTES = 50 * 1024 * 1024

# Encodings tried in order when bytes are not UTF-8.
FALLBACK_ENCODINGS = ("gbk", "latin-1", "cp1252")


def suffix_of(path: Column) -> Column:
    """Lower-case suffix with its dot, empty when there is none (or only a leading dot)."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def scan_report_files(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, name, mtime, size_bytes) of the report files right in a folder.

    Only metadata is selected, so file contents are not read. The reader leaves out
    zero-byte files; ``list_files`` shows them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path",
        file_name(F.col("path")).alias("name"),
        F.unix_seconds("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
    )


def hash_report_files(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """``scan_report_files`` with the SHA-256 of each content (reads the files)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path",
        file_name(F.col("path")).alias("name"),
        F.unix_seconds("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


# Parsed reports, by suffix in any case.
PARSED_TEXT = "*.{[mM][dD],[jJ][sS][oO][nN]}"


def scan_parsed_text(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, path, text) of the .md and .json files right in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PARSED_TEXT).load(folder)
    return files.select(
        file_stem(F.col("path")).alias("report_id"),
        "path",
        tx.decode_ignoring_errors(F.col("content")).alias("text"),
    )


# Rows of one listing frame.
LISTED_ROWS = 10_000


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each path itself, or what lies directly in it if it is a folder."""
    from pyarrow import fs

    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
    for frame in frames:
        for root in frame["root"]:
            store, inside = fs.FileSystem.from_uri(root)
            info = store.get_file_info(inside)
            found = [info]
            if info.type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(inside, recursive=False))
            scheme = root[: root.index(":") + 1] + "//" if "://" in root else ""
            for at in range(0, len(found), LISTED_ROWS):
                rows = [(i.path, kinds.get(i.type, "missing"), i.size, scheme + i.path) for i in found[at : at + LISTED_ROWS]]
                yield pd.DataFrame(rows, columns=["path", "kind", "length", "root"]).astype({"length": "Int64"})


def list_files(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """(path, kind, length) of files and of what is in folders, empty files included.

    ``kind`` is ``file``, or ``missing`` for a path that does not exist. Tasks do the listing, one
    level of folders per step: the folders found by a step are dealt to the tasks of the next, so
    a deep or uneven tree keeps all tasks busy and no task descends a tree alone. Steps are as
    many as the tree is deep; each is written to the shared folder. A path that both a folder and
    its parent lead to is listed once per given path.
    """
    schema = "path string, kind string, length bigint, root string"
    level = spark.createDataFrame([(p,) for p in paths], "root string")
    every = None
    while True:
        place = workspace(spark, "listing")
        level.mapInPandas(_listed, schema).write.parquet(place)
        found = spark.read.schema(schema).parquet(place)
        files = found.where("kind <> 'folder'").drop("root")
        every = files if every is None else every.unionByName(files)
        folders = found.where("kind = 'folder'").select("root")
        if not recursive or folders.isEmpty():
            return every
        level = folders.repartition(spark.sparkContext.defaultParallelism)


def supported_extensions(groups: dict = SUFFIX_GROUPS) -> tuple[str, ...]:
    return tuple(s for group in groups.values() for s in group)


def filter_supported_files(
    files: DataFrame, path_col: str = "path", suffixes: tuple[str, ...] = SUPPORTED_SUFFIXES
) -> DataFrame:
    """Files with ``suffix`` and ``reject_reason`` (NULL when the suffix is supported)."""
    suffix = suffix_of(F.col(path_col))
    reason = F.when(~suffix.isin(*suffixes), "unsupported file type")
    if "kind" in files.columns:
        reason = F.when(F.col("kind") == "missing", "path does not exist").otherwise(reason)
    return files.withColumns({"suffix": suffix, "reject_reason": reason})


def read_content_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, items) of JSON files that hold one content list each."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), ct.parse_content_list(F.col("value")).alias("items"))


def read_database_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A database table, read in ranges of ``partition_column`` when one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if bounds is None:
            raise ValueError("partition_column needs bounds")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=num_partitions,
        )
    return reader.load()


def decode_with_fallback(files: DataFrame, content: str = "content") -> DataFrame:
    """Add text and encoding_used: UTF-8, else the first fallback that accepts the bytes.

    Valid UTF-8 is decoded in the JVM; only the other rows' bytes travel to Python.
    """

    @F.pandas_udf("struct<text:string,encoding:string>")
    def decode(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for data in raw:
            found = (None, None)
            if data is not None:
                for name in FALLBACK_ENCODINGS:
                    try:
                        found = (bytes(data).decode(name), name)
                        break
                    except UnicodeDecodeError:
                        continue
            rows.append(found)
        return pd.DataFrame(rows, columns=["text", "encoding"])

    as_text = F.col(content).cast("string")
    valid = F.is_valid_utf8(as_text)
    other = decode(F.when(~valid, F.col(content)))
    staged = files.withColumn("_valid", valid).withColumn("_other", other)
    return staged.withColumns(
        {
            "text": F.when(F.col("_valid"), as_text).otherwise(F.col("_other.text")),
            "encoding_used": F.when(F.col("_valid"), "utf-8").otherwise(F.col("_other.encoding")),
        }
    ).drop("_valid", "_other")


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IMAGE_MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix_of(path)), F.lit(DEFAULT_MEDIA_TYPE))


def encode_images(files: DataFrame, path_col: str = "path", content: str = "content") -> DataFrame:
    """Add image_base64 (empty when there is no content) and media_type."""
    return files.withColumns(
        {
            # The SQL function may break lines; data URLs must not.
            "image_base64": F.coalesce(F.regexp_replace(F.base64(content), r"\s", ""), F.lit("")),
            "media_type": media_type(F.col(path_col)),
        }
    )


def validate_images(
    files: DataFrame, path_col: str = "path", size_col: str = "length", max_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """Add reject_reason: missing, unsupported format, or too large (NULL when fine)."""
    suffix = suffix_of(F.col(path_col))
    reason = (
        F.when(F.col(size_col).isNull(), "missing")
        .when(~suffix.isin(*SUFFIX_GROUPS["image"]), "unsupported image format")
        .when(F.col(size_col) > max_bytes, "too large")
    )
    return files.withColumn("reject_reason", reason)


def output_path(path: Column, source_root: str, output_root: str) -> Column:
    """Output folder of a file: the sub-folder below the source root mirrored, then the stem."""
    root = source_root.rstrip("/") + "/"
    inside = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(
        file_name(path)
    )
    folder = F.regexp_replace(inside, r"[^/]*$", "")
    return F.concat(F.lit(output_root.rstrip("/") + "/"), folder, file_stem(path))
