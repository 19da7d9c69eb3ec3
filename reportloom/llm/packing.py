"""Best-fit packing by minimum bin slack over the histogram of lengths.

Per bin, a subset-sum over the lengths still available, held as a bitset of reachable sums,
finds the fullest combination; among equally full ones the largest lengths are taken. As pieces
of one length are interchangeable, a combination is used as often as the counts allow and
removed at once. So the plan is made from at most ``size`` (length, count) rows, whatever the
number of pieces, and each piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from reportloom.llm.bpe import Remembered, tools
from reportloom.llm.common import small_batches, stage_table, with_rank

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# Chunks whose ids a worker remembers, unless the caller has memory for more; no result depends on it.
REMEMBERED_CHUNKS = 250_000
PLAN_SCHEMA = "length bigint, first bigint, last bigint, copies bigint, sequence bigint, offset bigint"


class PackedIds:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit numbers.

    White space never joins words, so a text is looked up by its white-space chunks; chunks not
    seen before are encoded in bulk, already split into words, and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bpe = tools(path)["bpe"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = [i for i, t in self.bpe.piece.items() if t.endswith("</w>")] + [*self.bpe.special.values()]
        self.is_end = np.zeros(max(self.bpe.piece) + 1, bool)
        self.is_end[ends] = True
        self.known = Remembered(None, REMEMBERED_CHUNKS)

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        split, lettered = self.bpe.split, self.bpe.lettered
        flat: list[str] = []
        counts = [0]
        for c in chunks:
            if c.isascii() and c.isalpha():
                flat.append(c.lower())
                counts.append(1)
            else:
                words = split(c)
                flat += map(lettered, words)
                counts.append(len(words))
        lines = [" ".join(flat[i : i + 1000]) for i in range(0, len(flat), 1000)]
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        joined = np.concatenate(ids) if ids else np.empty(0, "<u4")
        # The k-th word ends with the k-th id that ends a word.
        after = np.r_[0, np.flatnonzero(self.is_end[joined]) + 1] * 4
        at = after[np.cumsum(counts)].tolist()
        raw = joined.tobytes()
        return {c: raw[a:b] for c, a, b in zip(chunks, at, at[1:], strict=False)}

    def __call__(self, texts: list) -> list[bytes]:
        # Texts are held as numbers of their chunks: each chunk's string is kept once a call.
        number = defaultdict(count().__next__)
        numbered = [array("I", map(number.__getitem__, self.bpe.chunks(t or ""))) for t in texts]
        values = list(map(self.known.get, number))
        new = [c for c, v in zip(number, values, strict=True) if v is None]
        if new:
            older = self.known.older.get
            found = {c: v for c, v in zip(new, map(older, new), strict=True) if v is not None}
            found |= self.learn([c for c in new if c not in found])
            self.known.room(len(found))
            self.known.update(found)
            for c in new:
                values[number[c]] = found[c]
        return [b"".join(map(values.__getitem__, chunks)) for chunks in numbered]


_packers: dict[str, PackedIds] = {}


def packer(path: str, remembered: int = REMEMBERED_CHUNKS) -> PackedIds:
    """The encoder of ``path``, one per Python worker; what other operators remember is let go."""
    if path not in _packers:
        _packers[path] = PackedIds(path)
    _packers[path].known.most = remembered
    Remembered.keep_only(_packers[path].known)
    return _packers[path]


def cut_pieces(
    docs: DataFrame,
    vocab_path: str,
    size: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
    remembered: int = REMEMBERED_CHUNKS,
) -> DataFrame:
    """Token pieces of every document: ids of its text, then ``end_id``.

    Only documents longer than ``size`` are cut, into pieces of ``size`` tokens and a last one
    that may be shorter. A null text counts as empty and gives one piece with the end id alone.
    Null and repeated doc_ids are kept row by row; other columns are not read. ``with_ids``
    adds the ids themselves; without it only their checksum travels.
    """
    tail = end_id.to_bytes(4, "little")
    step = size * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packer(vocab_path, remembered)
        for batch in small_batches(batches):
            out: list[tuple] = []
            encoded = encode(batch.column(1).to_pylist())
            for doc, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                data += tail
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([memoryview(p).cast("I").tolist() for p in cols[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECE_SCHEMA + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths within ``capacity``: length -> copies."""
    within = (1 << capacity + 1) - 1
    reach = 1
    steps = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and length <= capacity:
            take = min(take, left)
            before = reach
            reach |= (before << length * take) & within
            if reach != before:
                steps.append((length, take, before))
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> Iterator[tuple]:
    """Rows of ``PLAN_SCHEMA``: ranks first..last-1 of a length go ``copies`` to a sequence."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    sequence = 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            first = used[length]
            used[length] += copies * times
            yield length, first, used[length], copies, sequence, offset
            offset += copies * length
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        sequence += times


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` plus sequence_id and offset; every sequence holds at most ``size`` tokens.

    ``pieces`` needs doc_id, piece and a length from 1 to ``size``; a hot length is no hot key,
    as places follow from ranks. Ties in length are broken by doc_id and piece. An empty table
    gives an empty result.
    """
    ranked = with_rank(pieces, "length", "doc_id", "piece")
    # At most `size` rows: one per length.
    by_length = ranked.groupBy("length").agg(
        F.count(F.lit(1)).alias("n"), F.min("_rank").alias("_from")
    )

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for frame in frames:
            counts |= dict(zip(frame["length"].tolist(), frame["n"].tolist(), strict=True))
        names = [c.split(" ")[0] for c in PLAN_SCHEMA.split(", ")]
        yield pd.DataFrame(list(plan_bins(counts, size)), columns=names)

    plan = stage_table(by_length.select("length", "n").coalesce(1).mapInPandas(make, PLAN_SCHEMA), "plan")
    places = (
        plan.withColumnRenamed("length", "_length")
        .withColumnRenamed("offset", "_offset")
        .join(by_length.select(F.col("length").alias("_length"), "_from"), "_length")
    )
    rank = F.col("_rank") - F.col("_from")
    nth = rank - F.col("first")
    return (
        # The plan's size depends on `size` alone.
        ranked.join(
            F.broadcast(places),
            (F.col("length") == F.col("_length")) & (rank >= F.col("first")) & (rank < F.col("last")),
        )
        .select(
            *pieces.columns,
            (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces that carry their ids.

    A group is one sequence, so at most ``size`` tokens meet.
    """
    part = F.struct("offset", "doc_id", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return held.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )


def pack_documents(
    docs: DataFrame, vocab_path: str, size: int = 4096, end_id: int = 1, remembered: int = REMEMBERED_CHUNKS
) -> DataFrame:
    """Pieces of all documents with their checksums, sequences and offsets."""
    # Written first: ordering reads its input twice, and texts should be encoded once.
    return pack(stage_table(cut_pieces(docs, vocab_path, size, end_id, remembered=remembered), "pieces"), size)
