"""Removal of bytes that lie in any string of ``threshold`` bytes which the corpus holds twice.

Distributed prefix doubling over a thinned set of positions. Names of strings of 8, 16, ... bytes
follow in each task from pairs of shorter names. A window is a string of ``threshold`` bytes; its
anchor is its smallest name of ``gram`` bytes, so equal windows have anchors with equal names at
equal places, and neighbouring windows mostly share one. Spark sorts (position, rank) pairs:

1. Anchors by name, then by the text that their windows cover. An anchor whose name stands alone
   can repeat nowhere. Anchors over equal text repeat with all their windows, and one of each such
   group stands for it from here on. What is left are the edges of repeats.
2. Blocks of neighbouring windows of these, cut at fixed distances from the anchor. The bytes that
   all windows of a block share are its core: blocks are ranked by the first ``2 * gram`` bytes of
   the core, then by (rank, name of the bytes that double the length) until a block is unique or
   its rank covers the core. Blocks with equal bytes around equal cores repeat whole.
3. Single windows of the other blocks, by core rank and the bytes that complete the threshold.

A position is unique where neither neighbour in the sorted order has its rank, so no group is ever
gathered, and rows are dealt by rank and place, so a hot string spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import ROW, small_batches, stage_table, with_row_key

THRESHOLD = 400
LEAST_THRESHOLD = 32
UNIT = 1 << 18  # bytes named at a time
PIECE = 1 << 19  # windows of one text named at a time
_PLACE = np.uint64((1 << 21) - 1)

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _pairs(names: np.ndarray, span: int) -> np.ndarray:
    """Names of the pairs (names[i], names[i + span])."""
    x = names[:-span] * _M1
    x ^= (names[span:] + _M3) * _M2
    x ^= x >> np.uint64(32)
    x *= _M1
    x ^= x >> np.uint64(29)
    return x


def gram_of(threshold: int) -> int:
    """The anchor length: the greatest power of two within a quarter of ``threshold``."""
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"threshold must be at least {LEAST_THRESHOLD}")
    return 1 << ((threshold // 4).bit_length() - 1)


def names_by_length(data: bytes, lengths: set[int]) -> dict[int, np.ndarray]:
    """Names of all strings of each wanted length (powers of two from 8), by place of their start."""
    n = len(data)
    words = np.empty(n - 7, np.uint64)
    for j in range(min(8, n - 7)):
        count = (n - 7 - j + 7) // 8
        words[j::8] = np.frombuffer(data, "<u8", count, j)
    out, span = {}, 8
    while True:
        if span in lengths:
            out[span] = words
        if span >= max(lengths) or len(words) <= span:
            return out
        words, span = _pairs(words, span), span * 2


def block_of(threshold: int) -> int:
    """Windows per block: the greatest power of two within a sixteenth of ``threshold``."""
    return 1 << ((threshold // 16).bit_length() - 1)


def doubling(threshold: int) -> list[tuple[int, int]]:
    """(length, offset) of the names that rank a core, round by round, up to its whole length."""
    span, core = 2 * gram_of(threshold), threshold - block_of(threshold) + 1
    rounds = [(span, 0)]
    while span < core:
        step = min(span, core - span)
        rounds.append((span, step))
        span += step
    return rounds


def _pieces(texts: list[bytes], threshold: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, start, bytes) of near ``UNIT`` bytes that hold every window once."""
    unit, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, len(text) - threshold + 1, PIECE):
            unit.append((number, start, text[start : start + PIECE + threshold - 1]))
            size += len(unit[-1][2])
            if size >= UNIT:
                yield unit
                unit, size = [], 0
    if unit:
        yield unit


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from minima to both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, anchor, its name, two halves of the covered text's hash)."""
    gram = gram_of(threshold)
    width = threshold - gram + 1
    for unit in _pieces(texts, threshold):
        data = b"".join(p[2] for p in unit)
        names = names_by_length(data, {gram})[gram]
        places = np.arange(len(names), dtype=np.uint64)
        # Ties go to the first place, wherever the window lies.
        at = _least((names & ~_PLACE) | places, width) & _PLACE
        sizes = np.array([len(p[2]) for p in unit])
        begins = np.cumsum(sizes) - sizes
        ends = begins + sizes - threshold + 1  # after the last window of each piece
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[begins] = True
        starts = np.flatnonzero(new)
        piece = np.searchsorted(begins, starts, "right") - 1
        starts, piece = starts[starts < ends[piece]], piece[starts < ends[piece]]
        stops = np.minimum(np.append(starts[1:], len(at)), ends[piece])
        view = memoryview(data)
        more = threshold - 1
        hashes = b"".join(
            hashlib.blake2b(view[s : e + more], digest_size=16).digest()
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True)
        )
        halves = np.frombuffer(hashes, np.int64).reshape(-1, 2)
        numbers = np.array([p[0] for p in unit])[piece]
        offsets = np.array([p[1] for p in unit])[piece] - begins[piece]
        mid = at[starts].astype(np.int64)
        yield numbers, starts + offsets, stops - starts, mid + offsets, names[mid].view(np.int64), halves[:, 0], halves[:, 1]


_ITEM = "_file bigint, _row bigint, at bigint, n bigint, mid bigint, name bigint, e1 bigint, e2 bigint"


def _cut_anchors(threshold: int):
    """Task body over (_file, _row, text): the anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column=2):
            file, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for number, *rest in anchors(texts, threshold):
                columns = [file[number], row[number], *rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_names_of(_ITEM))

    return run


def _names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _cut_blocks(threshold: int):
    """Task body over (_file, _row, text, parts): the blocks of the wanted windows.

    A block starts at byte ``at`` and has the windows ``low`` to ``high`` of its ``size``. ``flank`` holds
    the bytes before and after the core; the window at ``u`` needs those from ``u`` to ``u + size - 1``.
    """
    rounds, size = doubling(threshold), block_of(threshold)
    core, around = threshold - size + 1, 2 * (size - 1)
    places = np.concatenate([np.arange(size - 1), np.arange(threshold, threshold + size - 1)])

    def of_text(data: bytes, parts: pa.StructScalar) -> Iterator[tuple]:
        first, n, mid = (parts.values.field(f).to_numpy() for f in ("at", "n", "mid"))
        low_block, high_block = (mid - (first + n - 1)) // size, (mid - first) // size
        count = high_block - low_block + 1
        item = np.repeat(np.arange(len(first)), count)
        number = low_block[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        base = mid[item] - number * size - (size - 1)
        low, high = np.maximum(0, first[item] - base), np.minimum(size, (first + n)[item] - base)
        order = np.argsort(base, kind="stable")
        base, low, high = base[order], low[order], high[order]
        padded = np.zeros(len(data) + 2 * size, np.uint8)
        padded[size : size + len(data)] = np.frombuffer(data, np.uint8)
        begins = base + size - 1
        for start in range(0, len(data) - core + 1, PIECE):
            some = slice(*np.searchsorted(begins, [start, start + PIECE]))
            if some.start == some.stop:
                continue
            named = names_by_length(data[start : start + PIECE + core - 1], {length for length, _ in rounds})
            ranks = [named[length][begins[some] - start + offset].view(np.int64) for length, offset in rounds]
            yield base[some], low[some], high[some], padded[base[some][:, None] + size + places], ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column=2):
            for file, row, text, parts in zip(*batch.columns, strict=True):
                for base, low, high, flank, ranks in of_text(text.as_py().encode(), parts):
                    n = len(base)
                    ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * around)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(np.full(n, v.as_py()), pa.int64()) for v in (file, row)],
                            *[pa.array(c, pa.int64()) for c in (base, low, high)],
                            pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(flank.tobytes())]),
                            *[pa.array(c, pa.int64()) for c in ranks],
                        ],
                        names=[*_PLACE_NAMES, "low", "high", "flank", *_round_names(threshold)],
                    )

    return run


_PLACE_NAMES = ["_file", "_row", "at"]


def _round_names(threshold: int) -> list[str]:
    return [f"r{i}" for i in range(len(doubling(threshold)))]


def _flag(keys: list[str], groups: dict[str, int], drop_single: str | None):
    """Task body over one sorted partition: whether the rows around each row agree with it.

    The first and the last row cannot know both; they are marked and pass whatever they are.
    """

    def agree(table: pa.Table, count: int) -> np.ndarray:
        same = np.ones(max(table.num_rows - 1, 0), bool)
        for key in keys[:count]:
            column = table.column(key).to_numpy()
            same &= column[1:] == column[:-1]
        return same

    def flagged(table: pa.Table, begins: int, stops: int, left: bool, right: bool) -> pa.RecordBatch:
        """Rows ``begins`` to ``stops`` of ``table``, with one more row at each side that is there."""
        n = table.num_rows
        edge = np.zeros(n, np.int32)
        if left:
            edge[0] += 1
        if right:
            edge[-1] += 2
        flags, keep = {}, edge > 0
        for name, count in groups.items():
            same = agree(table, count)
            flags[f"{name}_before"] = np.concatenate([[False], same])
            flags[f"{name}_after"] = np.concatenate([same, [False]])
            if name == drop_single:
                keep |= flags[f"{name}_before"] | flags[f"{name}_after"]
        if drop_single is None:
            keep[:] = True
        keep[:begins] = False
        keep[stops:] = False
        for name, values in flags.items():
            table = table.append_column(name, pa.array(values))
        table = table.append_column("_edge", pa.array(edge)).filter(pa.array(keep))
        return table.combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            # The last row waits for the next one; the one before it is kept to compare with.
            first = seen == 0
            begins = 0 if first else 1
            if table.num_rows - 1 > begins:
                yield from flagged(table, begins, table.num_rows - 1, first, False).to_batches()
                rest, seen = table.slice(table.num_rows - 2), 1
            else:
                rest = table
        if rest is not None:
            yield from flagged(rest, 0 if seen == 0 else 1, rest.num_rows, seen == 0, True).to_batches()

    return run


def sorted_neighbours(
    rows: DataFrame, keys: list[str], tie: list[str], groups: dict[str, int], drop_single: str | None = None
) -> DataFrame:
    """``rows`` in sorted order with ``<group>_before`` and ``<group>_after``: the neighbour agrees.

    A group is a number of leading ``keys``. Rows are dealt by keys and ``tie``, so equal keys may lie in
    many partitions; only the first and last row of each partition are looked at a second time.
    With ``drop_single``, rows without an equal neighbour in that group are left out.
    """
    marks = [f"{g}_{side}" for g in groups for side in ("before", "after")]
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    schema = f"{fields}, {', '.join(f'{m} boolean' for m in marks)}, _edge int"
    order = [*keys, *tie]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_flag(keys, groups, drop_single), schema)
    laid = stage_table(laid, "sorted")
    # Two rows per partition at most, whatever the number of rows.
    around = Window.orderBy(*order)

    def same(count: int, there) -> Column:
        agree = F.lit(True)
        for key in keys[:count]:
            agree = agree & (F.col(key) == there(key).over(around))
        return F.coalesce(agree, F.lit(False))

    first, last = F.col("_edge").bitwiseAND(F.lit(1)) > 0, F.col("_edge").bitwiseAND(F.lit(2)) > 0
    fixed = {}
    for group, count in groups.items():
        fixed[f"{group}_before"] = F.when(first, same(count, F.lag)).otherwise(F.col(f"{group}_before"))
        fixed[f"{group}_after"] = F.when(last, same(count, F.lead)).otherwise(F.col(f"{group}_after"))
    borders = laid.where("_edge > 0").withColumns(fixed)
    every = laid.where("_edge = 0").unionByName(borders).drop("_edge")
    if drop_single:
        every = every.where(F.col(f"{drop_single}_before") | F.col(f"{drop_single}_after"))
    return every


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text") if ROW in docs.columns else docs
    key = [F.col(f"{ROW}.file").alias("_file"), F.col(f"{ROW}.at").alias("_row")]
    return with_row_key(own).select(*key, F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _ranks(*keys) -> dict[str, Column]:
    """A rank of 128 bits for rows that agree in ``keys``."""
    return {"p": F.xxhash64(*keys), "q": F.xxhash64(F.lit(1), *reversed(keys))}


def _told(rows: DataFrame, inner: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose cover another row has too, rows to look at more closely).

    Of rows with equal covers beside others of the same ``inner`` group, the outermost stand for all.
    """
    whole = F.col("cover_before") | F.col("cover_after")
    outer = (~F.col("cover_before") & F.col(f"{inner}_before")) | (~F.col("cover_after") & F.col(f"{inner}_after"))
    return rows.where(whole), rows.where(~whole | outer)


def repeated_windows(keyed: DataFrame, threshold: int) -> DataFrame:
    """(_file, _row, at, n): stretches of ``n`` windows from byte ``at`` on that start elsewhere too."""
    place, rounds = _PLACE_NAMES, _round_names(threshold)
    rows = keyed.select("_file", "_row", "text").where(F.octet_length("text") >= threshold)
    cut = stage_table(rows.mapInArrow(_cut_anchors(threshold), _ITEM), "anchors")
    near = sorted_neighbours(cut, ["name", "e1", "e2"], place, {"name": 1, "cover": 3}, drop_single="name")
    same_items, open_items = _told(near, "name")

    parts = open_items.groupBy("_file", "_row").agg(F.collect_list(F.struct("at", "n", "mid")).alias("parts"))
    wanted = rows.join(parts, ["_file", "_row"]).select("_file", "_row", "text", "parts")
    numbers = ", ".join(f"{c} bigint" for c in [*place, "low", "high"])
    schema = f"{numbers}, flank binary, {', '.join(f'{r} bigint' for r in rounds)}"
    blocks = stage_table(wanted.mapInArrow(_cut_blocks(threshold), schema), "blocks")
    ranked = []
    for name in rounds[:-1]:
        got = sorted_neighbours(blocks, [*ranked, name], place, {"core": len(ranked) + 1}, drop_single="core")
        blocks = got.withColumns(_ranks(*ranked, name)).drop(name, "core_before", "core_after")
        ranked = ["p", "q"]
    around = [F.col(c) for c in ("flank", "low", "high")]
    blocks = blocks.withColumns({"f1": F.xxhash64(*around), "f2": F.xxhash64(F.lit(1), *around)})
    keys = [*ranked, rounds[-1], "f1", "f2"]
    got = sorted_neighbours(blocks, keys, place, {"core": len(keys) - 2, "cover": len(keys)}, drop_single="core")
    same_blocks, open_blocks = _told(got, "core")

    u, size = F.col("_u").cast("int"), block_of(threshold)
    own = F.substring("flank", u + 1, F.lit(size - 1))
    windows = stage_table(
        open_blocks.select("*", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("_u"))
        .withColumns(_ranks(*ranked, rounds[-1], F.col("_u"), own))
        .select("_file", "_row", (F.col("at") + F.col("_u")).alias("at"), "p", "q"),
        "windows",
    )
    same_windows = sorted_neighbours(windows, ["p", "q"], place, {"window": 2}, drop_single="window")
    one = F.lit(1).cast("bigint").alias("n")
    return (
        same_items.select(*place, "n")
        .unionByName(same_blocks.select("_file", "_row", (F.col("at") + F.col("low")).alias("at"), (F.col("high") - F.col("low")).alias("n")))
        .unionByName(same_windows.select(*place, one))
    )


def _strip(threshold: int, digest: bool):
    """Task body over (doc_id, text, parts): what stays of each text, or its sha256."""
    as_result, kind = (lambda b: hashlib.sha256(b).hexdigest(), pa.string()) if digest else (bytes, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            doc_ids, counts, kept = batch.column(0).to_pylist(), [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text or "").encode()
                if not parts.is_valid:
                    counts.append((len(data), 0, 0))
                    kept.append(as_result(data))
                    continue
                at, n = (parts.values.field(f).to_numpy() for f in ("at", "n"))
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + n + threshold - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                counts.append((len(data), int(gone.sum()), runs))
                kept.append(as_result(np.frombuffer(data, np.uint8)[~gone].tobytes()))
            sizes = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), *sizes, pa.array(kept, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary: a cut may fall inside a character).

    A byte goes if a string of ``threshold`` bytes around it also starts anywhere else, in this text or
    another; strings are judged on the input, so every copy goes. With ``digest``, ``kept`` is the
    lower-case sha256 of what stays. Null and empty texts have no bytes and no spans; texts below the
    threshold stay whole. Every row counts for itself, whatever its doc_id, so equal rows are copies
    of one another. Texts of any length are read whole, named in pieces; other columns are not
    read. An empty table gives no rows.
    """
    gram_of(threshold)  # refuses thresholds that are too small
    keyed = _keyed(docs)
    place = ["_file", "_row"]
    found = repeated_windows(keyed, threshold).groupBy(*place).agg(F.collect_list(F.struct("at", "n")).alias("parts"))
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if digest else 'binary'}"
    return keyed.join(found, place, "left").select("doc_id", "text", "parts").mapInArrow(_strip(threshold, digest), schema)


def repeat_digests(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``remove_repeats`` with the sha256 of the bytes that stay as ``kept_sha256``."""
    return remove_repeats(docs, threshold, digest=True).withColumnRenamed("kept", "kept_sha256")
