"""WARC fixity audit with Merkle trees over ordered ranges of offsets.

A replica of an archive is a table of records in files. Records are hashed once. A leaf covers a
fixed range of offsets in one file and hashes its records in order, each with offset, length and
digest; nodes cover neighbouring leaves up to one hash per file, and a tree over the files ends in
one root. Replicas are compared by their roots, and only below nodes that differ are children
looked at, down to offset ranges whose records are then aligned by place, digest and id.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.llm.common import join_groups, stage_table, with_rank
from reportloom.sinks.files import write_file_per_row

# Records of one archive file, children of one tree node, bytes of one leaf: each bounds what
# meets in a task.
FILE_RECORDS = 1024
FANOUT = 16
LEAF_BYTES = 1 << 16
# The record date where pages have none.
NO_DATE = "1970-01-01T00:00:00Z"
PLACE = ["page_id", "file", "offset", "length", "sha256"]
INDEX = "page_id long, file long, offset long, length long, sha256 string"


def record_bytes(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC response record as text: header lines, an empty line, the payload, two line ends."""
    text = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {NO_DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
        text,
        F.lit("\r\n\r\n"),
    )


def digest_columns(page_id: Column, url: Column, body: Column) -> list[Column]:
    """length and sha256 of the record."""
    record = record_bytes(page_id, url, body)
    return [F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256")]


def lay_out(records: DataFrame, *order: str) -> DataFrame:
    """``archive_index`` rows of records whose ``file`` is known, in ``order`` within each file."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.select("page_id", "file", (F.sum("length").over(before) - F.col("length")).alias("offset"), "length", "sha256")


def archive_index(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, file, offset, length, sha256) of the records of ``pages`` laid out in files.

    Records are ordered by page_id, url and hash; each file takes ``file_records`` of them, so
    running offsets are summed over one file at a time. Null columns count as empty, repeated rows
    are records of their own, an empty table has no records, other columns are not read. Whole
    texts are hashed, however long.
    """
    light = stage_table(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"),
            *digest_columns(F.col("page_id").cast("long"), F.col("url"), F.col("html")),
        ),
        "records",
    )
    ranked = with_rank(light, "page_id", "_url", "sha256")
    return lay_out(ranked.withColumn("file", F.floor(F.col("_rank") / file_records).cast("long")), "_rank")


def damaged_replica(pages: DataFrame, file_records: int = FILE_RECORDS) -> tuple[DataFrame, DataFrame]:
    """The archive of ``pages`` and a replica of it with six kinds of damage planted by page_id.

    Records stay in their files: some are changed in place, longer or shorter, some are lost or
    stand at the end of their file, and some files have records that the archive lacks. Pages
    without an id are copied well.
    """
    at, url, html = F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    hit = {kind: F.coalesce(at % step == rest, F.lit(False)) for kind, (step, rest) in DAMAGE.items()}
    other = (
        F.when(hit["changed"], F.concat(F.lit("#"), F.substring(html, 2, 1 << 30)))
        .when(hit["longer"], F.concat(html, F.lit("!")))
        .when(hit["shorter"], F.substring(html, 2, 1 << 30))
    )
    more = F.when(hit["added"], F.concat(F.lit("+"), html))
    light = stage_table(
        pages.select(
            at.alias("page_id"),
            F.coalesce(url.cast("string"), F.lit("")).alias("_url"),
            *digest_columns(at, url, html),
            F.when(other.isNotNull(), F.struct(*digest_columns(at, url, other))).alias("_other"),
            F.when(more.isNotNull(), F.struct(*digest_columns(-1 - at, url, more))).alias("_more"),
            hit["lost"].alias("_lost"),
            hit["moved"].alias("_moved"),
        ),
        "records",
    )
    ranked = stage_table(
        with_rank(light, "page_id", "_url", "sha256").withColumn("file", F.floor(F.col("_rank") / file_records).cast("long")), "ranked"
    )
    kept = ranked.where("NOT _lost").select(
        "page_id", "file", "_moved", "_rank", F.lit(0).alias("_after"),
        F.coalesce("_other.length", "length").alias("length"), F.coalesce("_other.sha256", "sha256").alias("sha256"),
    )
    added = ranked.where("_more IS NOT NULL").select(
        (-1 - F.col("page_id")).alias("page_id"), "file", F.lit(False).alias("_moved"), "_rank", F.lit(1).alias("_after"), "_more.length", "_more.sha256"
    )
    return lay_out(ranked, "_rank"), lay_out(kept.unionByName(added), "_moved", "_rank", "_after")


# Kind of damage -> (divisor, remainder) of the page_ids that ``damaged_replica`` hurts.
DAMAGE = {"changed": (97, 13), "longer": (223, 100), "shorter": (227, 150), "lost": (211, 40), "moved": (233, 60), "added": (229, 200)}


def _up(column: str, by: int) -> Column:
    """Floor of a long divided by ``by``, exact at every size."""
    return F.expr(f"({column} - pmod({column}, {by}L)) div {by}L")


def _height(low: int, high: int, fanout: int) -> int:
    """Levels above nodes ``low`` to ``high`` until at most ``fanout`` are left."""
    height = 0
    while high - low >= fanout:
        low, high, height = low // fanout, high // fanout, height + 1
    return height


def _leaf_of() -> Column:
    return _up("greatest(coalesce(offset, 0L), 0L)", LEAF_BYTES).alias("node")


def _children(level: DataFrame, file: Column, node: Column, place: str) -> DataFrame:
    """One node per (file, node): the hash of its children's places and hashes in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(place, "hash"))), lambda c: F.concat_ws(":", c[place].cast("string"), c["hash"]))
    grouped = level.groupBy(file.alias("_f"), node.alias("_n")).agg(F.sha2(F.array_join(rows, ","), 256).alias("hash"))
    return stage_table(grouped.select(F.col("_f").alias("file"), F.col("_n").alias("node"), "hash"), "nodes")


def parents(offset_height: int, file_height: int, fanout: int) -> list[tuple[Column, Column, str]]:
    """Per level from the leaves to the one below the root: (file, node) of a node's parent, and the
    column that tells the node's place among its siblings.

    First come the levels within files, then one node per file, then the levels over files, whose
    nodes all have file 0.
    """
    inside, zero = F.col("file"), F.lit(0).cast("long")
    return (
        [(inside, _up("node", fanout), "node")] * offset_height
        + [(inside, zero, "node"), (zero, _up("file", fanout), "file")]
        + [(zero, _up("node", fanout), "node")] * max(file_height - 1, 0)
        + [(zero, zero, "node")]
    )


def merkle_levels(records: DataFrame, above: list[tuple[Column, Column, str]]) -> list[DataFrame]:
    """Tree levels from the leaves to the root: (file, node, hash).

    A leaf hashes its records ordered by offset. Records that claim the same offset are first added
    up digest by digest in the tasks, so that a leaf holds at most ``LEAF_BYTES`` places however many
    rows an index has there; the offset, or that it is null, is in each digest. A node has at most
    ``fanout`` children.
    """
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("page_id", "offset", "length", "sha256")]
    digest = F.sha2(F.concat_ws(":", *marked), 256)
    words = [F.conv(F.substring("_d", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    spots = (
        records.select("file", _leaf_of(), F.expr("greatest(coalesce(offset, 0L), 0L)").alias("_at"), digest.alias("_d"))
        .groupBy("file", "node", "_at")
        .agg(F.count(F.lit(1)).alias("_c"), *(F.sum(w).alias(f"_s{i}") for i, w in enumerate(words)))
        .select("file", "node", "_at", F.sha2(F.concat_ws(":", "_c", *(f"_s{i}" for i in range(4))), 256).alias("hash"))
    )
    levels = [_children(spots, F.col("file"), F.col("node"), "_at")]
    for file, node, place in above:
        levels.append(_children(levels[-1], file, node, place))
    return levels


def differing_leaves(left: list[DataFrame], right: list[DataFrame], above: list[tuple[Column, Column, str]]) -> DataFrame:
    """(file, node) of the leaves in which two replicas differ.

    Roots are compared first; each lower level is joined for children of differing nodes only.
    """
    below = None
    for i in range(len(left) - 1, -1, -1):
        x, y = left[i], right[i]
        if below is not None:
            file, node, _ = above[i]
            x, y = (
                t.withColumns({"_file": file, "_node": node}).join(below, ["_file", "_node"], "left_semi").select("file", "node", "hash")
                for t in (x, y)
            )
        differ = stage_table(
            x.withColumnRenamed("hash", "left_hash")
            .join(y.withColumnRenamed("hash", "right_hash"), ["file", "node"], "full")
            .where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
            .select("file", "node"),
            "differ",
        )
        below = differ.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return differ


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of both sides (``_side``) plus ``_key`` of their ``keys`` and ``_copy``, their number
    among rows of one side and equal keys in order of place.

    Ranks and one minimum per key; a key with very many rows meets in no task.
    """
    key = F.sha2(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)), 256)
    ranked = with_rank(rows, "_side", *keys, "file", "offset").withColumn("_group", F.concat(F.col("_side").cast("string"), key))
    groups = stage_table(ranked.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_size")), "groups")
    joined = join_groups(ranked, groups, "_group", "_size", ranked.count())
    return stage_table(
        joined.select(*rows.columns, F.substring("_group", 2, 64).alias("_key"), (F.col("_rank") - F.col("_first")).alias("_copy")), "numbered"
    )


def _pairs(left: DataFrame, right: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of rows of equal ``keys``, copy by copy (other side's columns with _), and what is left of each side."""
    columns = left.columns
    other = [F.col(c).alias(f"_{c}") for c in columns]
    if left.isEmpty() or right.isEmpty():
        return left.select("*", *other).where("false"), left, right
    both = _numbered(left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1))), *keys)
    a, b = both.where("_side = 0"), both.where("_side = 1")
    on = ["_key", "_copy"]
    return (
        a.join(b.select(*on, *other), on).select(*columns, *(f"_{c}" for c in columns)),
        *(stage_table(x.join(y, on, "left_anti").select(columns), "rest") for x, y in ((a, b), (b, a))),
    )


def _same_rows(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that both sides have, and what is left of each side; copies are counted, not gathered."""
    columns = left.columns
    tagged = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    counted = stage_table(
        tagged.groupBy(columns).agg(F.count_if(F.col("_side") > 0).alias("_l"), F.count_if(F.col("_side") < 0).alias("_r")), "same"
    )

    def copies(n: Column) -> DataFrame:
        return counted.where(n > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_i")).drop("_i")

    return copies(F.least("_l", "_r")), copies(F.col("_l") - F.col("_r")), copies(F.col("_r") - F.col("_l"))


def fixity_audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per record: page_id, file, offset, length, sha256, replica_sha256, status, moved.

    ``left`` and ``right`` have the columns of ``archive_index``. status is ``ok`` (a record of the
    same page_id and hash is in ``right``), ``changed`` (another hash under the page_id, or a record
    that cannot be read at its place), ``missing`` (only in ``left``) or ``added`` (only in
    ``right``). moved tells that an intact record has another file, offset or length in ``right``;
    it is false for all others. Repeated records count copy by copy, those at the same place first;
    what remains of a page_id is paired in order of place. Place is that of ``left``, of added
    records that of ``right``. Rows with a null file are their own file (-1); null ids, offsets and
    lengths equal each other. A null sha256 is a record that could not be read, and never fine.
    Empty replicas give an empty result; other columns are not read.
    """
    left, right = (
        stage_table(
            t.select(*PLACE).withColumn("file", F.coalesce("file", F.lit(-1).cast("long"))).withColumn("sha256", F.coalesce("sha256", F.lit(""))),
            "replica",
        )
        for t in (left, right)
    )
    low, high, far = left.unionByName(right).agg(F.min("file"), F.max("file"), F.max("offset")).first()
    above = parents(_height(0, max(far or 0, 0) // LEAF_BYTES, fanout), _height(low or 0, high or 0, fanout), fanout)
    wrong = differing_leaves(*(merkle_levels(t, above) for t in (left, right)), above)
    placed = [t.select(*PLACE, _leaf_of()) for t in (left, right)]
    fine = placed[0].join(wrong, ["file", "node"], "left_anti")
    a, b = (stage_table(t.join(wrong, ["file", "node"], "left_semi").select(PLACE), "below") for t in placed)
    same, a, b = _same_rows(a, b)
    moved, a, b = _pairs(a, b, "page_id", "sha256")
    changed, a, b = _pairs(a, b, "page_id")
    # A record that could not be read has no id: it is what stands at its place in the other replica.
    unread, a, dark = _pairs(a, b.where("sha256 = ''"), "file", "offset")
    b = b.where("sha256 <> ''").unionByName(dark)
    reread, dark, b = _pairs(a.where("sha256 = ''"), b, "file", "offset")
    a = a.where("sha256 <> ''").unionByName(dark)
    none = F.lit(None).cast("string")

    def rows(part: DataFrame, sha: Column, replica: Column, status: str, elsewhere: bool = False) -> DataFrame:
        # A record that could not be read is never fine.
        bad = F.lit(status) if status != "ok" else F.when(F.col("sha256") == "", "changed").otherwise("ok")
        return part.select(
            *PLACE[:4], F.nullif(sha, F.lit("")).alias("sha256"), F.nullif(replica, F.lit("")).alias("replica_sha256"),
            bad.alias("status"), (F.lit(elsewhere) & (sha != "")).alias("moved"),
        )

    here, there = F.col("sha256"), F.col("_sha256")
    return (
        rows(fine, here, here, "ok")
        .unionByName(rows(same, here, here, "ok"))
        .unionByName(rows(moved, here, here, "ok", True))
        .unionByName(rows(changed.unionByName(unread).unionByName(reread), here, there, "changed"))
        .unionByName(rows(a, here, none, "missing"))
        .unionByName(rows(b, none, here, "added"))
    )


def _packed(pages: DataFrame, file_records: int) -> DataFrame:
    """(file, content): gzip members, one per record, in index order."""
    at = F.col("page_id").cast("long")
    laid = with_rank(pages.select(at.alias("page_id"), record_bytes(at, F.col("url"), F.col("html")).alias("record")), "page_id", "record")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(gzip.compress(r.encode("utf-8"), mtime=0) for r in part.sort_values("_rank")["record"])
        return pd.DataFrame({"file": part["file"][:1], "content": [data]})

    files = laid.withColumn("file", F.floor(F.col("_rank") / file_records).cast("long"))
    return files.groupBy("file").applyInPandas(pack, "file long, content binary")


def write_warc(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """``pages`` as a table (file, content) of gzip-compressed WARC files.

    Every row is a record, repeated ones and those of null columns too; an empty table has no
    files; other columns are not read. One task holds the ``file_records`` records of a file.
    """
    _packed(pages, file_records).write.parquet(folder)


def write_warc_files(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> int:
    """As ``write_warc``, but files ``<number>.warc.gz`` in a shared folder; returns their number."""
    named = _packed(pages, file_records).withColumn("name", F.concat(F.lpad(F.col("file").cast("string"), 9, "0"), F.lit(".warc.gz")))
    return write_file_per_row(named, folder)


_ID = re.compile(rb"WARC/1\.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n")
_FEED = 1 << 16


def _member(data: memoryview, place: int) -> tuple[bytes, int] | None:
    """The gzip member at ``place`` unpacked, and where the next begins; None if it is damaged."""
    unpack = zlib.decompressobj(31)
    parts, at = [], place
    try:
        while at < len(data) and not unpack.eof:
            parts.append(unpack.decompress(data[at : at + _FEED]))
            at += len(data[at : at + _FEED])
    except zlib.error:
        return None
    return (b"".join(parts), at - len(unpack.unused_data)) if unpack.eof else None


def members(number: int, data: bytes) -> Iterator[tuple]:
    """(page_id, file, offset, length, sha256) of each record of a file; see ``read_warc``."""
    view, at, place, broken = memoryview(data), 0, 0, -1
    while place < len(data):
        found = _member(view, place)
        if found is not None:
            record, place = found
            mark = _ID.match(record)
            yield int(mark[1]) if mark else None, number, at, len(record), hashlib.sha256(record).hexdigest()
            at += len(record)
            continue
        # Bytes of one damaged run are one row.
        if place != broken:
            yield None, number, at, None, None
        place = broken = data.find(b"\x1f\x8b\x08", place + 1) % (len(data) + 1)


def _index_files(numbered: Callable[[pd.DataFrame], pd.Series]) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, data in zip(numbered(frame), frame["content"], strict=True):
                rows = pd.DataFrame(members(number, bytes(data)), columns=PLACE)
                yield rows.astype({"page_id": "Int64", "length": "Int64"})

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, file, offset, length, sha256) of the records of files that ``write_warc`` made.

    Rows can be audited. page_id comes from the record's id. A member that cannot be unpacked is a
    row without id, length and hash, which adds nothing to the offsets after it; reading goes on at
    the next member that can. A file is in one task's memory, records one after another.
    """
    return spark.read.parquet(folder).mapInPandas(_index_files(lambda f: f["file"]), INDEX)


def read_warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_warc`` for files ``<number>.warc.gz`` in ``folder``; other names are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    named = files.where(F.col("path").rlike(r"/[0-9]+\.warc\.gz$"))
    return named.mapInPandas(_index_files(lambda f: f["path"].str.extract(r"([0-9]+)\.warc\.gz$")[0].astype("int64")), INDEX)
