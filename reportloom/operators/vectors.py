"""A stored index of vectors by cells, and exact top-k search that leaves cells out by proof.

Centroids are fitted on a bounded sample; every vector is assigned to its nearest one. A cell is a
cone: no vector in it is nearer to a query than the query's angle to the centroid less the cell's
widest angle. A query first visits the cells of best bound that hold ``k`` vectors; the score of its
k-th hit then rules out every cell whose bound is lower; in the rest, only what reaches that
score comes out. Results are those of a search through all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.operators.retrieval import COSINE_THRESHOLD, TOP_K, search_blocks
from reportloom.session import workspace

SAMPLE_ROWS = 20_000
MOST_CELLS = 1024
BLOCK_ROWS = 8192  # vectors of a cell that a task holds at a time, on average
ASKED_NUMBERS = 1 << 22  # numbers that a task hands on at a time for cells to visit
ROUNDS = 8
_SLACK = 2e-6  # scores have 6 decimals; angles are good to far less


@dataclass(frozen=True)
class Cells:
    """A unit centroid, the number of vectors and their widest angle per cell; small, sent to tasks."""

    centroids: np.ndarray
    sizes: np.ndarray
    widest: np.ndarray

    def blocks(self) -> Column:
        """Blocks per cell, by cell number."""
        return F.lit([int(b) for b in np.maximum(1, -(-self.sizes // BLOCK_ROWS))]).cast("array<int>")


@dataclass(frozen=True)
class VectorIndex:
    """``vectors`` (cell, block, id, vec: unit vectors) and their cells."""

    vectors: DataFrame
    cells: Cells


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: spherical k-means from evenly spaced rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        best = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, sample)
        norms = np.linalg.norm(sums, axis=1)
        moved = norms > 1e-9
        centroids = centroids.copy()
        centroids[moved] = sums[moved] / norms[moved, None]
    return centroids


def _directed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of vectors that have a direction: not null, finite, not all zero."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(vec.isNotNull() & finite)
        .where(F.exists("vec", lambda x: x != 0))
    )


def build_index(
    vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
    cells: int | None = None, sample_rows: int = SAMPLE_ROWS,
) -> VectorIndex:
    """Assign all ``vectors`` to cells and write them to ``path`` (a new one in the shared folder).

    The number of cells follows the square root of the rows up to ``MOST_CELLS``. At most
    ``sample_rows`` vectors, chosen by hash of their id, and one row per cell reach the driver.
    Vectors that are null, zero or not finite have no direction and are in no cell; all must
    have the same length.
    """
    spark = vectors.sparkSession
    given = _directed(vectors, id_col, vec_col)
    total = given.count()
    # Chosen among ids first: only the vectors of the sample are sorted out.
    picked = given.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toPandas()["vec"]
    wanted = cells or min(MOST_CELLS, max(1, int(np.sqrt(total) / 2)))
    centroids = fit_centroids(_unit_rows(np.stack(picked)), wanted) if len(picked) else np.zeros((0, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows = _unit_rows(np.stack(pdf["vec"].to_numpy()))
            near = rows @ centroids.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1.0, 1.0))
            yield pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle, "id": pdf["id"], "vec": list(rows)})

    path = path or workspace(spark, "vector-index")
    schema = "cell int, angle double, id bigint, vec array<double>"
    given.mapInPandas(assign, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    stats = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect()
    sizes, widest = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for row in stats:
        sizes[row["cell"]], widest[row["cell"]] = row["n"], row["widest"]
    found = Cells(centroids, sizes, widest)
    dealt = stored.withColumn("block", F.pmod(F.xxhash64("id"), F.get(found.blocks(), F.col("cell"))).cast("int"))
    return VectorIndex(dealt.drop("angle"), found)


def _bounds(cells: Cells, vecs: np.ndarray) -> np.ndarray:
    """(query, cell): no vector of the cell has a greater cosine; below -1 for empty cells."""
    angle = np.arccos(np.clip(vecs @ cells.centroids.T, -1.0, 1.0)) - cells.widest
    bound = np.cos(np.maximum(angle, 0.0)) + _SLACK
    bound[:, cells.sizes == 0] = -2.0
    return bound


def _first_cells(cells: Cells, bound: np.ndarray, k: int) -> np.ndarray:
    """(query, cell): the cells of best bound that together hold ``k`` vectors."""
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
    first = np.zeros(bound.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    return first & (bound > -2.0)


def _ask(cells: Cells, k: int, threshold: float, again: bool, most: int = ASKED_NUMBERS):
    """Task body over (query_id, vec[, floor]): a row for each cell to visit, as many queries at a time as fill ``most`` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            step = max(1, most // (len(cells.sizes) * len(pdf["vec"].iloc[0])))
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at : at + step]
                vecs = _unit_rows(np.stack(some["vec"].to_numpy()))
                bound = _bounds(cells, vecs)
                first = _first_cells(cells, bound, k)
                floor = np.maximum(some["floor"].to_numpy(), threshold) if again else np.full(len(vecs), float(threshold))
                visit = (~first if again else first) & (bound >= floor[:, None])
                q, c = np.nonzero(visit)
                if len(q):
                    yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[q], "cell": c.astype(np.int32), "floor": floor[q], "vec": [vecs[i] for i in q]})

    return run


def _asked(cells: Cells, queries: DataFrame, k: int, threshold: float, again: bool) -> DataFrame:
    """(query_id, cell, floor, vec): cells to visit, first or ``again`` after ``floor`` is known."""
    return queries.mapInPandas(_ask(cells, k, threshold, again), "query_id bigint, cell int, floor double, vec array<double>")


def _visit(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each query in each block of the cells it asks for."""
    # At most one row per cell.
    wanted = asked.select("cell").distinct()
    held = index.vectors.join(F.broadcast(wanted), "cell", "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.get(index.cells.blocks(), F.col("cell")) - 1))
    number = (F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("block")).alias("block")
    zero = F.lit(0).cast("bigint")
    kept = held.select(number, F.lit(0).alias("is_query"), zero.alias("query_id"), "id", F.lit(0.0).alias("floor"), "vec")
    sent = asked.withColumn("block", every)
    sent = sent.select(number, F.lit(1).alias("is_query"), "query_id", zero.alias("id"), "floor", "vec")
    return search_blocks(kept.unionByName(sent), k)


def index_top_k(
    index: VectorIndex, queries: DataFrame, k: int = TOP_K, threshold: float = COSINE_THRESHOLD,
    id_col: str = "vec_id", query_id: str = "query_id", query_vec: str = "embedding",
) -> DataFrame:
    """(query_id, id, score, rank): the exact cosine top ``k`` at or above ``threshold``.

    Scores have 6 decimals; equal ones rank by id. A query meets only the blocks of the cells that it
    visits, and a block has about ``BLOCK_ROWS`` vectors, however many are equal. Queries
    without a direction have no hits.
    """
    if not len(index.cells.centroids):
        none = f"query_id bigint, {id_col} bigint, score double, rank int"
        return queries.sparkSession.createDataFrame([], none)
    spark = queries.sparkSession
    given = _directed(queries, query_id, query_vec).withColumnRenamed("id", "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    path = workspace(spark, "first-hits")
    best(_visit(index, _asked(index.cells, given, k, threshold, False), k)).drop("rank").write.parquet(path)
    first = spark.read.schema("query_id bigint, id bigint, score double").parquet(path)
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    told = given.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(threshold)))
    more = _visit(index, _asked(index.cells, told, k, threshold, True), k)
    return best(first.unionByName(more)).select("query_id", F.col("id").alias(id_col), "score", "rank")


def cells_visited(
    index: VectorIndex, queries: DataFrame, found: DataFrame, k: int = TOP_K, threshold: float = COSINE_THRESHOLD,
    query_id: str = "query_id", query_vec: str = "embedding",
) -> DataFrame:
    """(query_id, n_cells, share of all vectors in them) that the search of ``found`` had to look at.

    Counts the first cells and those that the final k-th score leaves; the search itself knows only
    the k-th score of its first cells and may visit a few more.
    """
    given = _directed(queries, query_id, query_vec).withColumnRenamed("id", "query_id")
    kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    told = given.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(threshold)))
    both = _asked(index.cells, given, k, threshold, False).unionByName(_asked(index.cells, told, k, threshold, True))
    sizes = F.lit([int(n) for n in index.cells.sizes]).cast("array<bigint>")
    return both.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        (F.sum(F.get(sizes, F.col("cell"))) / float(max(index.cells.sizes.sum(), 1))).alias("share"),
    )
