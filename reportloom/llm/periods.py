"""Periodic runs of words: stretches that repeat with a period, at least three times over.

Periods are taken by octave. For the octave from B, a document is cut by boundaries B words apart;
a run holds two periods or more of equal words at distance q, so it holds a boundary behind which
B words return at distance q. The tile around such a boundary is solved on its own: Z-functions to
the right and to the left of the boundary give, for every period of the octave, how far the words
at distance q agree. Tiles overlap, so the fragments of a run touch; rows meet per (document,
period) and are stitched to whole intervals. Work is n log n words, and no row holds more than
one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.text import bind
from reportloom.llm.common import small_batches, stage_table

LEAST_WORDS = 24
LEAST_PERIODS = 3
SMALL = 8  # periods below this share one octave; a run of them agrees over 17 words or more
PER_TILE = 16  # neighbouring boundaries that share a tile

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit names of pairs of names."""
    x = a * _M1 ^ (b + _M3) * _M2
    x ^= x >> np.uint64(31)
    x *= _M3
    x ^= x >> np.uint64(29)
    return x


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of the words; equal words have equal numbers, within this document."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(step, least period, greatest period) of the octaves that can hold a run in ``n`` words."""
    if n >= LEAST_WORDS:
        yield SMALL, 1, SMALL - 1
        step = SMALL
        while LEAST_PERIODS * step <= n:
            yield step, step, 2 * step - 1
            step *= 2


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(least period, first boundary, number of boundaries, start, words) of all tiles worth solving.

    A boundary is passed over only where no period of the octave has its next ``step`` words again
    at that distance; names are equal where words are, so no run is missed.
    """
    n, names, span = len(ids), ids.astype(np.uint64) + np.uint64(1), 1
    for step, low, high in octaves(n):
        while span < step:
            names, span = _names(names[:-span], names[span:]), span * 2
        padded = np.zeros(-(-len(names) // step) * step, np.uint64)
        padded[: len(names)] = names
        blocks = padded.reshape(-1, step)
        if low == 1:
            again = (blocks[:, 1:] == blocks[:, :1]).any(axis=1)
        else:
            again = (blocks[1:] == blocks[:-1, :1]).any(axis=1)
        hits = np.flatnonzero(again)
        if not len(hits):
            continue
        new = np.flatnonzero(np.diff(hits, prepend=-2) > 1)
        for first, end in zip(new, [*new[1:], len(hits)], strict=True):
            for at in range(first, end, PER_TILE):
                count = min(PER_TILE, end - at)
                k = int(hits[at])
                start = max(0, (k - 1) * step)
                yield low, k * step, count, start, ids[start : (k + count + 3) * step]


def _z(s: list[int], upto: int) -> list[int]:
    """Z-function: how far ``s[i:]`` agrees with ``s``, for i below ``upto``."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(low: int, boundary: int, count: int, start: int, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(period, from, to): words of the tile that equal the word one period on, around its boundaries."""
    step, high = (SMALL, SMALL - 1) if low == 1 else (low, 2 * low - 1)
    for c in range(boundary - start, boundary - start + count * step, step):
        right = words[c : c + 2 * step + high].tolist()
        ahead = _z(right, min(high + 1, len(right)))
        periods = [q for q in range(low, len(ahead)) if ahead[q] >= step]
        if not periods:
            continue
        back = words[max(0, c - step) : c][::-1].tolist()
        top = min(high, len(words) - c)
        joined = [*back, -1, *words[max(0, c - step) : c + top][::-1].tolist()]
        behind = _z(joined, len(back) + 2 + top - low)
        for q in periods:
            at = start + c
            yield q, at - behind[len(back) + 1 + top - q], at + min(ahead[q], 2 * step)


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))


def _cut(every_text: bool):
    """Task body over (_key, doc_id, text): a row per document, then one per tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column=2):
            rows: list[tuple] = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().split()
                found = list(tiles(word_ids(words)))
                plain = b" ".join(words)
                kept = plain.decode() if found or every_text else None
                rows.append((key, doc_id, hashlib.sha256(plain).hexdigest(), kept, bool(found), None, None, None, None, None))
                rows += [(key, None, None, None, None, *tile) for tile in found]
            yield _batch(rows, _CUT_FIELDS)

    return run


_CUT = (
    "_key bigint, doc_id bigint, digest string, plain string, tiled boolean, "
    "low int, at bigint, count int, start bigint, words array<int>"
)
_CUT_FIELDS = {
    "_key": pa.int64(), "doc_id": pa.int64(), "digest": pa.string(), "plain": pa.string(), "tiled": pa.bool_(),
    "low": pa.int32(), "at": pa.int64(), "count": pa.int32(), "start": pa.int64(), "words": pa.list_(pa.int32()),
}


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lows, ats, counts, starts = (batch.column(i).to_pylist() for i in range(5))
        words = batch.column(5)
        rows = [
            (keys[i], q, s, e)
            for i in range(batch.num_rows)
            for q, s, e in solve(lows[i], ats[i], counts[i], starts[i], words[i].values.to_numpy())
        ]
        columns = np.array(rows, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(columns[:, i]) for i in range(4)], names=["_key", "period", "s", "e"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(_key, start, length, period) of all runs from fragments (_key, period, s, e).

    A (document, period) has at most one fragment per boundary. A stretch found with several
    periods has the smallest: three periods are long enough for their greatest common divisor to be
    one too.
    """
    order = Window.partitionBy("_key", "period").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("s") <= reach, 0).otherwise(1)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = (
        fragments.withColumn("_new", new)
        .withColumn("_island", island)
        .groupBy("_key", "period", "_island")
        .agg(F.min("s").alias("start"), F.max("e").alias("_e"))
        .withColumn("length", F.col("_e") - F.col("start") + F.col("period"))
    )
    least = F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))
    return whole.where(F.col("length") >= least).groupBy("_key", "start", "length").agg(F.min("period").alias("period"))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without what runs (start, length, period) repeat after their first period."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length / period, compared exactly; the first of ties by start, period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over (doc_id, plain, runs)."""
    for batch in small_batches(batches):
        rows = []
        for doc_id, plain, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = sorted(((r["start"], r["length"], r["period"]) for r in found or []), key=lambda r: (r[0], r[2]))
            text = " ".join(collapse(plain.split(" "), runs))
            start, length, period = _greatest(runs) if runs else (None, None, None)
            milli = 1000 * length // period if runs else None
            listed = [{"start": r[0], "length": r[1], "period": r[2]} for r in runs]
            rows.append((doc_id, len(runs), start, length, period, milli, listed, text))
        yield _batch(rows, _FOUND_FIELDS)


_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_FOUND = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    f"runs array<{_RUN}>, collapsed string"
)
_FOUND_FIELDS = {
    **{c: pa.int64() for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")},
    "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])),
    "collapsed": pa.string(),
}


def _documents_with_runs(docs: DataFrame, every_text: bool) -> tuple[DataFrame, DataFrame]:
    """(documents without a tile as they were cut, all others described)."""
    keyed = docs.select(F.monotonically_increasing_id().alias("_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Written once, so the keys given above stay what they are.
    cut = stage_table(keyed.mapInArrow(_cut(every_text), _CUT), "tiles")
    dealt = cut.where("low IS NOT NULL").select("_key", "low", "at", "count", "start", "words").repartition("_key", "low", "at")
    fragments = dealt.mapInArrow(_solve_tiles, "_key bigint, period bigint, s bigint, e bigint")
    runs = stitch(fragments).groupBy("_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    tiled = cut.where("tiled").select("_key", "doc_id", "plain").join(runs, "_key", "left")
    return cut.where("NOT tiled"), tiled.select("doc_id", "plain", "runs").mapInArrow(_describe, _FOUND)


def collapse_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, its greatest run, ``runs`` and ``collapsed``, the text without repeats.

    A run is a maximal stretch of consecutive words (blanks are 0x20 and 0x09 to 0x0D) with smallest
    period q and at least ``max(24, 3 * q)`` words; a word goes if any run holds it after that run's
    first q words. The greatest run has the greatest exact length / period, then the smallest start,
    then period. Null and empty texts have no words, no runs and an empty text. Every row stands for
    itself, whatever its doc_id. Texts of any length are read whole; other columns are not read.
    """
    plain, found = _documents_with_runs(docs, every_text=True)
    none = [F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    bare = plain.select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *none, F.array().cast(f"array<{_RUN}>").alias("runs"),
        F.col("plain").alias("collapsed"),
    )
    return found.unionByName(bare)


def run_digests(docs: DataFrame) -> DataFrame:
    """``collapse_documents`` with digests of the run list and of the collapsed text in their place."""
    plain, found = _documents_with_runs(docs, every_text=False)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    head = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    none = [F.lit(None).cast("bigint").alias(c) for c in head[2:]]
    bare = plain.select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *none, F.sha2(F.lit(""), 256).alias("runs_sha256"),
        F.col("digest").alias("collapsed_sha256"),
    )
    digests = found.select(*head, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digests.unionByName(bare)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` where one text in ten is made periodic from some word on, by the crc32 of its doc_id.

    With h that unsigned crc32 and g = h div 10, texts of n > 0 words with h % 10 = 0 repeat, from
    word a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words that stand there. Null ids and empty
    texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n.cast("bigint") - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), bind(words, planted)).otherwise(F.col("text")))
