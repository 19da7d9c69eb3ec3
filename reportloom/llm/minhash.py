"""Near-dedup of texts by BagMinHash signatures of word shingles.

A text is a bag of five-word shingles; the similarity of two bags is the sum of the smaller
counts over the sum of the larger ones. A shingle with count c covers the weights 0 to c, cut
into the shells [0,1), [1,2), [2,4), [4,8) ...; each shell emits a Poisson process with a rate
that grows with its width, points that lie above c are thinned out, and each point falls on one
register. A register keeps its first point, so two bags agree in a register with a probability
of exactly their weighted similarity, and a process ends as soon as it is later than all
registers of its text.

Registers in bands give buckets. Buckets name who is compared, by short sketches; linked
sketches form candidate clusters, within which whole bags are compared exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.bpe import Remembered
from reportloom.llm.common import ROW, ROW_TYPE, components, in_groups, join_groups, small_batches, stage_table

WORDS = 5
REGISTERS = 160
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
# Five deviations below 0.8 of 160 registers: a pair at 0.8 falls short once in 3 million.
SKETCH_MATCHES = 103
BUCKET_BLOCK = 512
CLUSTER_BLOCK = 256
# Rows of (id, key) that are sent to the tasks; more are met by shuffle.
SMALL_ROWS = 100_000

_word = re.compile(r"\w+").findall
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over whole arrays."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_hashes(chunk: str) -> bytes:
    return b"".join([hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest() for w in _word(chunk.lower())])


_chunks = Remembered(_chunk_hashes, 100_000)


def only_word_hashes() -> None:
    """Let go what other operators remember in this worker."""
    Remembered.keep_only(_chunks)


def word_hashes(text: str | None) -> bytes:
    """64-bit hashes of the lower-case words (runs of letters, digits and ``_``) in order."""
    return b"".join(map(_chunks.__getitem__, (text or "").split()))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out ^ words[i : n - width + 1 + i])
    return out


def bag_items(words: np.ndarray) -> np.ndarray:
    """The bag as a set: the k-th copy of a shingle is an item of its own. Sorted."""
    s = np.sort(shingles(words))
    if not len(s):
        return s
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
    return np.sort(mix(s + (at - first).astype(np.uint64) * _GOLD))


def signatures(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Register points (owners x REGISTERS) of bags given as distinct (owner, hash, count)."""
    m = REGISTERS
    first = np.full((owners, m), np.inf)
    point = np.zeros((owners, m), np.uint64)
    flat_first, flat_point = first.reshape(-1), point.reshape(-1)
    # Shell 0 covers [0,1), shell k covers [2**(k-1), 2**k).
    shells = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    element = np.repeat(np.arange(len(hashes)), shells)
    shell = np.arange(len(element)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, low, 1.0)
    seed = mix(hashes[element] ^ mix(shell.astype(np.uint64)))
    top = counts[element].astype(float)
    doc = owner[element]
    time = np.zeros(len(element))
    drawn = np.zeros(len(element), np.uint64)
    while len(seed):
        t = int(max(1, min(256, 65536 // len(seed))))
        step = np.arange(1, t + 1, dtype=np.uint64)
        a = mix(seed[:, None] ^ mix(drawn[:, None] + step))
        gap = -np.log((a >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
        x = time[:, None] + np.cumsum(gap / (m * width)[:, None], axis=1)
        b = mix(a)
        register = (((b & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        keep = x < first.max(axis=1)[doc][:, None]
        if (shell > 1).any():
            spot = low[:, None] + width[:, None] * (b >> np.uint64(40)).astype(float) * 2.0**-24
            keep &= spot < top[:, None]
        cell = (doc[:, None] * m + register)[keep]
        when = x[keep]
        np.minimum.at(flat_first, cell, when)
        won = flat_first[cell] == when
        flat_point[cell[won]] = mix(b[keep][won])
        time = x[:, -1]
        drawn = drawn + np.uint64(t)
        live = time < first.max(axis=1)[doc]
        seed, time, drawn, width, low, top, doc, shell = (
            z[live] for z in (seed, time, drawn, width, low, top, doc, shell)
        )
    return point


def sign_batch(texts: list) -> tuple[list, list, list, list]:
    """Per text: key of its word sequence, number of shingles, sketch bytes and band hashes.

    All four are None or empty for a text without words.
    """
    data = [word_hashes(t) for t in texts]
    keys, sizes = [], []
    parts, owner = [], []
    for i, raw in enumerate(data):
        s = shingles(np.frombuffer(raw, np.uint64))
        keys.append(hashlib.md5(raw).hexdigest() if raw else None)
        sizes.append(len(s))
        parts.append(s)
        owner.append(np.full(len(s), i, np.int64))
    all_hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owners = np.concatenate(owner) if owner else np.empty(0, np.int64)
    # Equal shingles of different texts must stay apart: the text's number goes into the key.
    own = all_hashes ^ mix(owners.astype(np.uint64))
    order = np.argsort(own)
    ranked = own[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(ranked)])
    at = order[starts]
    points = signatures(all_hashes[at], counts, owners[at], len(texts))
    sketch = (points & np.uint64(0xFF)).astype(np.uint8)
    bands = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(texts), axis=0)
    for r in range(BAND_ROWS):
        bands = mix(bands ^ points[:, r::BAND_ROWS])
    bands = bands.astype(np.int64)
    return (
        keys,
        sizes,
        [sketch[i].tobytes() if keys[i] else None for i in range(len(texts))],
        [bands[i] if keys[i] else None for i in range(len(texts))],
    )


SIGNED = "doc_id bigint, bag string, shingles bigint, sketch binary, bands array<bigint>"


def sign_documents(docs: DataFrame, row: Sequence[str] = ()) -> DataFrame:
    """(doc_id, bag, shingles, sketch, bands) and the columns ``row`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_word_hashes()
        for batch in small_batches(batches, 1_500_000, 2_000):
            keys, sizes, sketch, bands = sign_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sketch, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    *batch.columns[2:],
                ],
                names=["doc_id", "bag", "shingles", "sketch", "bands", *row],
            )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row)
    return picked.mapInArrow(run, ", ".join([SIGNED, *(f"{r} {ROW_TYPE}" for r in row)]))


def in_blocks(rows: DataFrame, key: str, size: str, node: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks that its block takes part in, as _lo and _hi.

    A key with more than ``block`` rows is cut into blocks by hash; a task sees two blocks at a
    time, and all pairs of blocks are covered.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    return (
        rows.withColumn("_n", blocks)
        .withColumn("_own", F.expr(f"cast(pmod(xxhash64({node}), _n) as int)"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .drop("_other", "_n")
    )


def _links(n: int, alike) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs for which ``alike(i, others)`` is true."""
    label = np.arange(n)
    for i in range(n - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(others):
            continue
        for j in others[alike(i, others)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, j


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Remembered.keep_only()
    for table in in_groups(batches, 3):
        n = table.num_rows
        if n < 2:
            continue
        bags = table.column("bag").to_pylist()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
        found = list(
            _links(n, lambda i, o, s=sketch: (s[o] == s[i]).sum(axis=1) >= SKETCH_MATCHES)
        )
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([bags[i] for i, _ in found]), pa.array([bags[j] for _, j in found])],
                names=["a", "b"],
            )


def overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from a 0/1 matrix in slices of bounded width."""
    n = len(items)
    joined = np.concatenate(items)
    who = np.repeat(np.arange(n), [len(x) for x in items])
    order = np.argsort(joined, kind="stable")
    joined, who = joined[order], who[order]
    new = np.r_[True, joined[1:] != joined[:-1]]
    column = np.cumsum(new) - 1
    held = np.bincount(column) > 1
    renamed = np.cumsum(held) - 1
    shared = held[column]
    column, who = renamed[column[shared]], who[shared]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(held.sum()), 8192):
        start, end = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((n, 8192), np.float32)
        part[who[start:end], column[start:end] - low] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _exact_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.keep_only()
        for table in in_groups(batches, 3):
            n = table.num_rows
            if n < 2:
                continue
            bags = table.column("bag").to_pylist()
            items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
            size = np.array([len(x) for x in items])
            shared = overlaps(items)
            union = size[:, None] + size[None, :] - shared
            alike = shared * 100 >= union * percent
            found = list(_links(n, lambda i, o, m=alike: m[i, o]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bags[i] for i, _ in found]), pa.array([bags[j] for _, j in found])],
                    names=["a", "b"],
                )

    return run


def near_classes(docs: DataFrame, percent: int = 80, by_row: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Documents whose shingle bags have a similarity of at least ``percent`` / 100 are linked;
    class_id is the smallest doc_id reachable by links. One row of a class is kept: that
    document, or one of its rows if the id repeats. A text without words (null, empty or signs
    only) is linked with nothing and kept. A null doc_id takes part like any other; a class of
    null ids alone has a null class_id. Equal word sequences collapse before anything else, so
    copies cost one row in all later steps. An empty table gives an empty result; other columns
    are not read. With ``by_row``, ``docs`` and the result have the key of ``with_row_key``, and
    exactly one row of each class is kept.
    """
    row = [ROW] if by_row else []
    signed = stage_table(sign_documents(docs, row), "signed")
    worded = signed.where(F.col("bag").isNotNull())
    light = (
        worded.groupBy("bag")
        .agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), *(F.min_by(r, F.struct(F.col("doc_id").isNull(), "doc_id", r)).alias(r) for r in row))
    )
    bags = stage_table(light, "bags")
    keyed = bags.select("bag", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stage_table(keyed.join(counts, "key"), "met")
    rows = in_blocks(met, "key", "size", "bag", BUCKET_BLOCK).join(bags.select("bag", "sketch"), "bag")
    pairs = (
        rows.select("key", "_lo", "_hi", "bag", "sketch")
        .repartition("key", "_lo", "_hi")
        .sortWithinPartitions("key", "_lo", "_hi")
        .mapInArrow(_sketch_links, "a string, b string")
    )
    clusters = stage_table(components(pairs), "clusters")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = stage_table(
        clusters.join(sizes, "component").join(bags.select(F.col("bag").alias("node"), "lead", *row), "node"), "members"
    )
    exact = stage_table(components(_compare_bags(docs, members, percent, row)), "exact")
    return _class_rows(signed, bags, exact, row)


def _compare_bags(docs: DataFrame, members: DataFrame, percent: int, row: Sequence[str] = ()) -> DataFrame:
    """Links between whole bags, compared within candidate clusters."""
    # A bag is read from its first row: by the row's key, else by its doc_id.
    key = row[0] if row else "doc_id"
    wanted = members.select(F.col(key if row else "lead").alias("_lead"), F.col("node").alias("_bag"), "component", "size")
    if wanted.count() <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select((F.col(key) if row else F.col(key).cast("long")).alias("_id"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_word_hashes()
        for batch in small_batches(batches, column=0):
            out: list[tuple] = []
            for text, bag, part, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = word_hashes(text)
                # A repeated doc_id may hold another text.
                if hashlib.md5(raw).hexdigest() == bag:
                    out.append((part, size, bag, bag_items(np.frombuffer(raw, np.uint64)).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())],
                names=["component", "size", "bag", "items"],
            )

    held = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_lead"))).select("_text", "_bag", "component", "size")
    items = stage_table(
        held.mapInArrow(run, "component string, size bigint, bag string, items binary").dropDuplicates(["bag"]), "items"
    )
    return (
        in_blocks(items, "component", "size", "bag", CLUSTER_BLOCK)
        .select("component", "_lo", "_hi", "bag", "items")
        .repartition("component", "_lo", "_hi")
        .sortWithinPartitions("component", "_lo", "_hi")
        .mapInArrow(_exact_links(percent), "a string, b string")
    )


def _class_rows(signed: DataFrame, bags: DataFrame, exact: DataFrame, row: Sequence[str] = ()) -> DataFrame:
    """Class of every document from the classes of bags."""
    named = bags.select("bag", "lead", "copies", *(F.col(r).alias("_first_row") for r in row)).join(exact.withColumnRenamed("node", "bag"), "bag", "left").select(
        "bag", "lead", "copies", *(["_first_row"] if row else []), F.coalesce("component", "bag").alias("_root")
    )
    roots = named.groupBy("_root").agg(
        F.min("lead").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.min_by("bag", F.struct(F.col("lead").isNull(), "lead", "bag")).alias("_first_bag"),
    )
    total = signed.count()
    of_bag = stage_table(
        named.join(roots, "_root").select("bag", "copies", "class_id", "class_size", (F.col("bag") == F.col("_first_bag")).alias("_leads"), *(["_first_row"] if row else [])),
        "classes",
    )
    rows = signed.select("doc_id", "bag", *row)
    first = F.col(row[0]) == F.col("_first_row") if row else F.col("doc_id").eqNullSafe(F.col("class_id"))
    classed = join_groups(rows.where(F.col("bag").isNotNull()), of_bag, "bag", "copies", total)
    alone = rows.where(F.col("bag").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), *row
    )
    return classed.select(
        "doc_id", "class_id", "class_size", (F.col("_leads") & first).alias("kept"), *row
    ).unionByName(alone)
