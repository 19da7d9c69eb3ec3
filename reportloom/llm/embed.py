"""Near-dedup of vectors by cosine, compared in tiles along principal components.

Vectors are scaled to length one and turned onto the principal axes of the whole table, so the
leading dimensions carry most of a product. A tile adds up the leading dimensions first; the
rest of each product is at most the product of both suffix norms, and a pair is left as soon as
its cosine cannot reach the threshold any more. Only what is left is computed to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import components, join_groups, stage_table

# Vectors of one block, fewer where they are long; a task compares two blocks at a time, in tiles of TILE x TILE pairs.
BLOCK = 4096
BLOCK_BYTES = 8_000_000
TILE = 1024
# Blocks of one file, which is what a task reads of either side at least.
FILE_BLOCKS = 4
# Leading axes that have a box around each block.
BOX = 8
# Slack of the pruning bound, far above rounding errors of a product of unit vectors.
SLACK = 1e-9


def _unit_rows(flat: np.ndarray, dims: np.ndarray, width: int) -> np.ndarray:
    """Rows of length one in double precision, padded with zeros to ``width``; ``flat`` has them end to end."""
    out = np.zeros((len(dims), width))
    out[np.arange(width) < dims[:, None]] = flat
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of all lists end to end, in their own precision, and the lists' lengths."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def principal_axes(sound: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, largest variance first.

    Each task adds up a width x width matrix; the driver gets their sum, whose size depends on
    the vectors' width alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit_rows(*_flat(batch.column(0)), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], names=["cell", "value"]
        )

    summed = sound.select("embedding").mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    moments = np.zeros(width * width)
    for row in summed.collect():
        moments[row["cell"]] = row["value"]
    moments = moments.reshape(width, width)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def _blocks(groups: DataFrame, axes: np.ndarray, total: int) -> DataFrame:
    """One row for each run of neighbours along the first axis: their vectors end to end, and a box around them.

    Components keep their own precision, and every vector is in one row; files have a few blocks.
    """
    width = len(axes)
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    own = dict(groups.dtypes)["embedding"]

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = _unit_rows(*_flat(batch.column(0)), width) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], names=[*batch.schema.names, "along"])

    def block(table: pa.Table) -> pa.RecordBatch:
        flat, dims = _flat(table.column("embedding").combine_chunks())
        turned = _unit_rows(flat, dims, width) @ axes[:, :BOX]
        values = [
            table.column("key").to_pylist(), table.column("n").to_pylist(), dims.tolist(), flat.tobytes(),
            turned.min(0).tolist(), turned.max(0).tolist(), int(dims.min()), int(dims.max()),
        ]
        kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        kinds += [pa.list_(pa.float64())] * 2 + [pa.int32()] * 2
        names = ["keys", "n", "dims", "raw", "low", "high", "least", "longest"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= most:
                yield block(held.slice(0, most))
                held = held.slice(most)
        if held is not None and held.num_rows:
            yield block(held)

    laid = groups.select("embedding", "key", "n").mapInArrow(first_axis, f"embedding {own}, key string, n bigint, along double")
    return (
        laid.withColumn("dim", F.size("embedding"))
        .repartitionByRange(-(-total // (most * FILE_BLOCKS)), "dim", "along", "key")
        .sortWithinPartitions("dim", "along", "key")
        .select("embedding", "key", "n")
        .mapInArrow(
            cut,
            "keys array<string>, n array<bigint>, dims array<int>, raw binary, "
            "low array<double>, high array<double>, least int, longest int",
        )
        .withColumn("block", F.monotonically_increasing_id())
    )


def _pairs(blocks: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """Each pair of blocks once, a block with itself too, but those that lie too far apart for any link.

    A task reads its blocks of both sides from the files, so no copy of a vector is shuffled or
    written. Of a pair's two orders the sum of the numbers picks one, which leaves tasks alike.
    """
    a, b = (blocks.select([F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("a", "b"))
    once = (F.col("a_block") <= F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 0)

    def apart(sum_, i):
        gap = F.greatest(
            F.lit(0.0),
            F.get("a_low", i) - F.get("b_high", i),
            F.get("b_low", i) - F.get("a_high", i),
        )
        return sum_ + gap * gap

    gaps = F.aggregate(F.array(*[F.lit(i) for i in range(min(BOX, len(axes)))]), F.lit(0.0), apart)
    near = (1 - gaps / 2 >= threshold - 2 * SLACK) & (F.col("a_least") <= F.col("b_longest")) & (F.col("b_least") <= F.col("a_longest"))
    return a.join(b.hint("shuffle_replicate_nl"), once & near)


def _tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs with a[i] . b[j] >= threshold."""
    width = a.shape[1]
    lead = max(1, min(width, max(8, width // 4)))
    # Boxes around both tiles in the leading dimensions: too far apart, no pair can reach.
    box = min(lead, BOX)
    gap = np.maximum(
        0,
        np.maximum(a[:, :box].min(0) - b[:, :box].max(0), b[:, :box].min(0) - a[:, :box].max(0)),
    )
    if 1 - (gap**2).sum() / 2 < threshold - SLACK:
        return np.empty(0, int), np.empty(0, int)
    # The norms of what is left as one more dimension: one product gives the bound.
    ends = [np.linalg.norm(x[:, lead:], axis=1) for x in (a, b)]
    most = np.column_stack([a[:, :lead], ends[0]]) @ np.column_stack([b[:, :lead], ends[1]]).T
    at = np.flatnonzero(most >= threshold - SLACK)
    if len(at) * 8 > most.size:
        return np.divmod(np.flatnonzero(a @ b.T >= threshold), len(b))
    i, j = np.divmod(at, len(b))
    done = most.reshape(-1)[at] - ends[0][i] * ends[1][j]
    while lead < width and len(i):
        end = min(width, 2 * lead)
        done = done + np.einsum("nd,nd->n", a[i, lead:end], b[j, lead:end])
        lead = end
        bound = done + np.linalg.norm(a[:, lead:], axis=1)[i] * np.linalg.norm(b[:, lead:], axis=1)[j]
        left = bound >= threshold - SLACK
        i, j, done = i[left], j[left], done[left]
    near = done >= threshold
    return i[near], j[near]


def _recheck(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs hold by the plain product of the unturned vectors."""
    out = np.empty(len(i), bool)
    for s in range(0, len(i), 65536):
        e = slice(s, s + 65536)
        out[e] = np.einsum("nd,nd->n", a[i[e]], b[j[e]]) >= threshold
    return out


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least place of each place's class, after the classes of ``a`` and ``b`` are one, pair by pair."""
    up, a, b = np.arange(len(label)), label[a], label[b]
    while True:
        low = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        up = up[up]
        if (up == before).all():
            return up[label]


def _block_links(axes: np.ndarray, threshold: float, kind: str):
    """Links of pairs of blocks, added up over all pairs of a task.

    A task hands on each of its vectors twice at most, with its number of links and with another of
    its class, however many links there are.
    """
    width = len(axes)

    def read(batch: pa.RecordBatch, row: int, side: str) -> tuple:
        raw, dims, n, number = (batch.column(f"{side}_{c}")[row] for c in ("raw", "dims", "n", "block"))
        dims = dims.values.to_numpy()
        unit = _unit_rows(np.frombuffer(raw.as_buffer(), kind), dims, width)
        return number.as_py(), unit, unit @ axes, dims, n.values.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        keys: list[pa.Array] = []
        links, label = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left: tuple = (None,)
        for batch in batches:
            for row in range(batch.num_rows):
                # The left block stays while the right ones pass.
                if batch.column("a_block")[row].as_py() != left[0]:
                    left = read(batch, row, "a")
                right = left if batch.column("b_block")[row].as_py() == left[0] else read(batch, row, "b")
                for side, block in (("a", left), ("b", right)):
                    if block[0] not in first:
                        first[block[0]] = len(label)
                        # A copy: a slice would hold on to the batch with all its vectors.
                        keys.append(pa.array(batch.column(f"{side}_keys")[row].as_py(), pa.string()))
                        links = np.append(links, np.zeros(len(keys[-1]), np.int64))
                        label = np.append(label, np.arange(len(label), len(links)))
                (lo, a, a_turned, a_dims, a_n), (hi, b, b_turned, b_dims, b_n) = left, right
                for s in range(0, len(a), TILE):
                    for t in range(s if lo == hi else 0, len(b), TILE):
                        # The bound keeps pairs a little below, the plain product decides.
                        i, j = _tile_links(a_turned[s : s + TILE], b_turned[t : t + TILE], threshold - SLACK)
                        i, j = i + s, j + t
                        fine = (a_dims[i] == b_dims[j]) & (i < j if lo == hi else True)
                        i, j = i[fine], j[fine]
                        held = _recheck(a, b, i, j, threshold)
                        i, j = i[held], j[held]
                        if not len(i):
                            continue
                        at, to = i + first[lo], j + first[hi]
                        np.add.at(links, at, b_n[j])
                        np.add.at(links, to, a_n[i])
                        label = _joined(label, at, to)
        if not keys:
            return
        names = pa.concat_arrays(keys)
        some, ends = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([names.take(pa.array(some)), names.take(pa.array(ends))]),
                pa.concat_arrays([pa.nulls(len(some), pa.string()), names.take(pa.array(label[ends]))]),
                pa.array(np.append(links[some], np.zeros(len(ends), np.int64))),
            ],
            names=["a", "b", "links"],
        )

    return run


def single(rows: DataFrame) -> DataFrame:
    """Result rows of vectors without links."""
    return rows.select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked if they have the same number of components and their cosine in
    double precision is at least ``threshold``. n_links counts other rows; component_id is the
    smallest vec_id reachable by links, itself included; kept says whether that is the vec_id.
    Null, empty and zero vectors and such with null or non-finite components link with nothing.
    Null vec_ids are kept as rows and count as links; a component of null ids alone has a null
    component_id and is not kept. An empty table gives an empty result; other columns are not
    read.

    Equal vectors become one with a weight before anything is compared. Blocks of the rest are
    cut along the first principal axis, and a task compares two blocks at a time, which it reads
    from files that have every vector once.
    """
    x = F.col("embedding")
    sound = (
        x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    # Floats stay floats where they are kept; all that is computed is in doubles.
    small = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(sound, x if small else x.cast("array<double>")).alias("embedding"),
    ).withColumn("key", F.md5(F.concat_ws(",", F.col("embedding").cast("array<double>").cast("array<string>"))))
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull(), F.col("key")))
    named = stage_table(rows.select("vec_id", "key", F.size("embedding").alias("dim")), "vectors")
    sound_rows = named.where(F.col("key").isNotNull())
    counted = stage_table(sound_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lead")), "counted")
    total = counted.count()
    if not total:
        return single(named)
    rows = rows.where(F.col("embedding").isNotNull())
    axes = principal_axes(rows, sound_rows.agg(F.max("dim")).first()[0])
    groups = rows.groupBy("key").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"))
    blocks = stage_table(_blocks(groups, axes, total), "blocks")
    found = stage_table(
        _pairs(blocks, axes, threshold).mapInArrow(
            _block_links(axes, threshold, "<f4" if small else "<f8"), "a string, b string, links bigint"
        ),
        "found",
    )
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = stage_table(components(found.where("b is not null")), "parts")
    roots = (
        counted
        .join(parts.withColumnRenamed("node", "key"), "key", "left")
        .join(counts.withColumnRenamed("a", "key"), "key", "left")
        .select("key", "n", "lead", F.coalesce("component", "key").alias("_root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = roots.groupBy("_root").agg(F.min("lead").alias("component_id"))
    result = stage_table(
        roots.join(least, "_root").select("key", "n", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links")), "roots"
    )
    linked = join_groups(sound_rows, result, "key", "n", named.count()).select(
        "vec_id",
        "n_links",
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return linked.unionByName(single(named.where(F.col("key").isNull())))
