"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut at quantiles, so every level holds about as many rows: numbers at approximate
ones, texts by the rows counted before them in the order of whole texts. The levels' place on the curve orders the rows, and the order is cut into runs of equal row counts.
Rows of a run are near in all dimensions at once, so filters on any of them skip files.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import ROW, stage_table, with_rank


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Curve position of each row of ``levels`` (rows x dimensions, ``bits`` bits each).

    From the highest bit down, the sub-cube a point lies in fixes how the axes below it are
    reflected (its low bit pattern is inverted) or exchanged with the first axis.
    """
    x = levels.astype(np.uint64).copy()
    n = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        top = np.uint64(1 << bit)
        low = top - np.uint64(1)
        for d in range(n):
            inside = (x[:, d] & top) != 0
            swap = np.where(inside, np.uint64(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, d] ^= swap
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.uint64)
    for bit in range(bits - 1, 0, -1):
        top = np.uint64(1 << bit)
        flip ^= np.where((x[:, n - 1] & top) != 0, top - np.uint64(1), np.uint64(0))
    x ^= flip[:, None]
    out = np.zeros(len(x), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << np.uint64(1)) | ((x[:, d] >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def text_levels(rows: DataFrame, column: str, levels: int, total: int) -> list[tuple[bytes, int]]:
    """(smallest text, level) of each used level; at most ``levels`` pairs reach the driver.

    A text's level is the share of rows before it in byte order, nulls first, times ``levels``:
    whole texts are compared, so any that differ may get different levels, and a text with many
    rows leaves its levels to itself. Rows are counted per text, the counts are summed up
    within range partitions, and only one sum per partition meets in a single window.
    """
    value = F.col(column)
    counts = rows.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    laid = stage_table(
        counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("run", F.spark_partition_id()), "values"
    )
    sums = laid.groupBy("run").agg(F.sum("n").alias("rows"))
    starts = sums.select(
        "run",
        (F.sum("rows").over(Window.orderBy(F.desc("run")))).alias("rest"),
    )
    inside = Window.partitionBy("run").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.lit(total) - F.col("rest") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    # One row per written partition: a bound that does not depend on the rows.
    found = (
        laid.join(F.broadcast(starts), "run")
        .select("v", before.alias("before"))
        .groupBy(F.expr(f"before * {levels} div {max(total, 1)}").alias("level"))
        .agg(F.min("v").alias("v"))
        .collect()
    )
    return sorted((r["v"].encode(), r["level"]) for r in found)


def _levels_of(values: pd.Series, starts: list[tuple[bytes, int]]) -> np.ndarray:
    """Level of each text under ``text_levels``; null is 0."""
    codes, texts = pd.factorize(values)
    first, level = [s for s, _ in starts], [0, *(n for _, n in starts)]
    known = [level[bisect.bisect_right(first, t.encode())] for t in texts]
    return np.array([*known, 0], np.uint64)[codes]


def curve_order(rows: DataFrame, dims: dict[str, Column], bits: int = 6, accuracy: int = 1000) -> DataFrame:
    """``rows`` plus ``_curve``, the Hilbert position of its quantised dimensions.

    Text dimensions are cut by ``text_levels``, others at quantiles of their numbers. A null
    dimension takes the lowest level. Cuts are at most 2**bits a dimension.
    """
    levels = 1 << bits
    names = [f"_dim{i}" for i in range(len(dims))]
    rows = rows.withColumns(dict(zip(names, dims.values(), strict=True)))
    texts = [n for n in names if rows.schema[n].dataType.typeName() == "string"]
    numbers = [n for n in names if n not in texts]
    rows = rows.withColumns({n: F.col(n).cast("double") for n in numbers})
    points = [i / levels for i in range(1, levels)]
    found = rows.agg(
        F.count(F.lit(1)).alias("_total"), *[F.percentile_approx(n, points, accuracy).alias(n) for n in numbers]
    ).first()
    cuts = {n: np.unique(np.array(found[n] or [], float)) for n in numbers}
    starts = {n: text_levels(rows, n, levels, found["_total"]) for n in texts}
    keep = [c for c in rows.columns if c not in names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.empty((len(frame), len(names)), np.uint64)
            for i, n in enumerate(names):
                if n in starts:
                    at[:, i] = _levels_of(frame[n], starts[n])
                    continue
                value = frame[n].to_numpy(float, na_value=-np.inf)
                at[:, i] = np.searchsorted(cuts[n], np.where(np.isnan(value), -np.inf, value), side="left")
            out = frame[keep].copy()
            out["_curve"] = hilbert_index(at, bits)
            yield out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    return rows.mapInPandas(run, ", ".join([*kinds, "_curve bigint"]))


def equal_runs(rows: DataFrame, shards: int, *order) -> DataFrame:
    """``rows`` plus shard and slot: the order cut into runs whose counts differ by one at most."""
    ranked = with_rank(rows, *order)
    total = ranked.count()
    # Whole numbers: shard s starts at the first rank r with r * shards >= s * total.
    return (
        ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"_rank - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))
        .drop("_rank")
    )


def shard_documents(docs: DataFrame, shards: int = 24, by_row: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Law ``rows``: counts of shards differ by at most one. ``size`` is the UTF-8 bytes of the
    text plus 8; a null text has no bytes and the checksum of the empty text. Dimensions are
    source, lang, size and doc_id; nulls in them go to the lowest level. Rows equal on the curve
    are ordered by doc_id and checksum, so ties and repeated rows need no group in one task.
    Whole sources and languages are compared, however long. Other columns are not read; an empty
    table gives an empty result. With ``by_row``, ``docs`` and the result have the key of
    ``with_row_key``.
    """
    row = [ROW] if by_row else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"),
        *row,
    )
    light = stage_table(light, "shard-rows")
    dims = {k: F.col(k) for k in ("_source", "_lang", "size", "doc_id")}
    rows = curve_order(light, dims).drop("_source", "_lang")
    return equal_runs(rows, shards, "_curve", "doc_id", "text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *row,
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Whole documents in one folder per shard, rows in slot order.

    ``placed`` is the result of ``shard_documents``. If it has the row key, rows meet their
    places by it and null and repeated ids are written once each; without it doc_id must be
    unique and not null. Columns of ``docs`` named shard or slot are replaced by the place. A
    folder is one task's work; choose the shard count to fit. An empty table writes no folder.
    """
    key = ROW if ROW in placed.columns else "doc_id"
    at = stage_table(placed.select(F.col(key).alias("_place_of"), "shard", "slot"), "places")
    (
        docs.drop("shard", "slot")
        .join(at, F.col(key) == F.col("_place_of"))
        .drop("_place_of", ROW)
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
