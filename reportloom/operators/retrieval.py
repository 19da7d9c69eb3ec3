"""Vector search, hybrid candidates, entity merging, graph neighbourhood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.operators import models
from reportloom.session import workspace

COSINE_THRESHOLD = 0.2
TOP_K = 60
RESUMMARY_AT = 6
BLOCK_ROWS = 65_536  # vectors, and queries, that a task meets, on average
HIT_ROWS = 1 << 20  # hits that a task ranks, on average
_SUMMARY_PROMPT = "Write one description from these:\n"
SCORES = 1 << 21  # scores that a task makes at a time
HITS = 1 << 20  # hits that a task gathers before it hands them on


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _block_best(scores: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, vector row) of the k best scores of each query from its floor on, ties by vector id."""
    out_q, out_v = [], []
    for q, row in enumerate(scores):
        hits = np.flatnonzero(row >= floors[q])
        if len(hits) > k:
            # Scores as good as the k-th all stay in the draw, then ids decide.
            hits = hits[row[hits] >= np.partition(row[hits], -k)[-k]]
            hits = hits[np.lexsort((ids[hits], -row[hits]))[:k]]
        out_q.append(np.full(len(hits), q))
        out_v.append(hits)
    return np.concatenate(out_q), np.concatenate(out_v)


class _Hits:
    """The best ``k`` hits per query of a task so far; beyond ``most`` rows they are handed on."""

    def __init__(self, k: int, most: int):
        self.k, self.most = k, most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.floors: dict[int, float] = {}

    def floors_of(self, names: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """What a hit has to reach: a query with ``k`` hits needs no lower score."""
        return np.maximum(floors, [self.floors.get(n, -np.inf) for n in names.tolist()])

    def add(self, names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append((names, ids, scores))
        self.size += len(names)
        if self.size > self.most:
            self._cut()
            if self.size > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.size:
            self._cut()
            yield pd.DataFrame(dict(zip(("query_id", "id", "score"), self.parts[0], strict=True)))
        self.parts, self.size, self.floors = [], 0, {}

    def _cut(self) -> None:
        names, ids, scores = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, names))
        names, ids, scores = names[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        place = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
        last = place == self.k - 1
        self.floors = dict(zip(names[last].tolist(), scores[last].tolist(), strict=True))
        kept = place < self.k
        self.parts, self.size = [(names[kept], ids[kept], scores[kept])], int(kept.sum())


def _search(k: int, most: int = SCORES, hits: int = HITS):
    """Task body over rows (block, is_query, query_id, id, floor, vec), a block's vectors before its queries.

    A block's vectors are held as one matrix; queries pass by, as many at a time as give ``most``
    scores. Hits of all blocks of the task are cut to the best ``k`` per query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, ids = None, [], []
        matrix, known = np.zeros((0, 0)), np.zeros(0, np.int64)
        best = _Hits(k, hits)
        for pdf in batches:
            for (number, is_query), rows in pdf.groupby(["block", "is_query"], sort=True):
                if number != block:
                    block, parts, ids, matrix = number, [], [], np.zeros((0, 0))
                vecs = _unit(np.stack(rows["vec"].to_numpy()).astype(np.float64))
                if not is_query:
                    parts.append(vecs)
                    ids.append(rows["id"].to_numpy(np.int64))
                    continue
                if parts:
                    held = [matrix] if len(matrix) else []
                    matrix = np.concatenate([*held, *parts])
                    known = np.concatenate([*([known] if held else []), *ids])
                    parts, ids = [], []
                if not len(matrix):
                    continue
                names, floors = rows["query_id"].to_numpy(np.int64), rows["floor"].to_numpy(np.float64)
                step = max(1, most // len(matrix))
                for at in range(0, len(vecs), step):
                    some = names[at : at + step]
                    scores = np.round(vecs[at : at + step] @ matrix.T, 6)
                    q, v = _block_best(scores, known, k, best.floors_of(some, floors[at : at + step]))
                    if len(q):
                        yield from best.add(some[q], known[v], scores[q, v])
        yield from best.rest()

    return run


def vector_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    threshold: float = COSINE_THRESHOLD,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    blocks: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top ``k`` at or above ``threshold``.

    Scores have 6 decimals; equal ones rank by id. Vectors are hashed into ``blocks`` (unless given,
    two for each core or as many as shuffles have partitions, more beyond ``BLOCK_ROWS`` each by
    one count of the rows), queries into groups of ``BLOCK_ROWS``, and each block meets each group in a task of its
    own that keeps its best ``k`` per query, so neither all vectors nor all queries meet anywhere
    and no pair lists are shuffled. Hits are ranked in as many tasks as their number asks for.
    ``operators.vectors`` has an index for stores that are searched often.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_vectors, n_queries = vectors.count(), queries.count()
    # Two for each core: every further block hands on another ``k`` hits per query.
    least = min(partitions, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    n = blocks or max(least, -(-n_vectors // BLOCK_ROWS))
    groups = max(1, -(-n_queries // BLOCK_ROWS))
    vec = "array<double>"

    def from_on(first: Column, count: int, step: int) -> Column:
        return F.explode(F.sequence(first, first + (count - 1) * step, F.lit(step).cast("bigint")))

    held = vectors.where(F.col(vec_col).isNotNull()).select(
        from_on(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("bigint"), groups, n).alias("block"),
        F.lit(0).alias("is_query"),
        F.lit(0).cast("bigint").alias("query_id"),
        F.col(id_col).cast("bigint").alias("id"),
        F.lit(float(threshold)).alias("floor"),
        F.col(vec_col).cast(vec).alias("vec"),
    )
    asked = queries.where(F.col(query_vec).isNotNull()).select(
        from_on(F.pmod(F.xxhash64(query_id), F.lit(groups)).cast("bigint") * n, n, 1).alias("block"),
        F.lit(1).alias("is_query"),
        F.col(query_id).cast("bigint").alias("query_id"),
        F.lit(0).cast("bigint").alias("id"),
        F.lit(float(threshold)).alias("floor"),
        F.col(query_vec).cast(vec).alias("vec"),
    )
    found = search_blocks(held.unionByName(asked), k, n * groups).withColumnRenamed("id", id_col)
    # Dealt before they are ranked: no task sorts its hits on the way out.
    found = found.repartition(max(partitions, -(-n_queries * min(k * n, n_vectors) // HIT_ROWS)), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_blocks(rows: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, id, score) from rows (block, is_query, query_id, id, floor, vec).

    Of each block the best ``k`` of each query that reach its ``floor``. With ``blocks``, numbered
    from 0, each has a task of its own.
    """
    dealt = rows.repartitionById(blocks, F.col("block").cast("int")) if blocks else rows.repartition("block")
    found = dealt.sortWithinPartitions("block", "is_query")
    return found.mapInPandas(_search(k), "query_id bigint, id bigint, score double")


def hybrid_candidates(
    local: DataFrame, global_: DataFrame, mode: str = "hybrid", keys: tuple[str, ...] = ("id",)
) -> DataFrame:
    """(keys, score) of local (entity) and global (relation) hits; the better score counts."""
    parts = {"local": [local], "global": [global_], "hybrid": [local, global_]}[mode]
    both = reduce(DataFrame.unionByName, [p.select(*keys, "score") for p in parts])
    return both.groupBy(*keys).agg(F.max("score").alias("score"))


def merge_entities(mentions: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """Per name: mentions, distinct descriptions, one description, and whether to summarise.

    Descriptions are counted and the smallest is kept, not gathered: a name that holds a
    third of all mentions stays one small row. ``entity_descriptions`` lists them as rows.
    """
    distinct = entity_descriptions(mentions, name, description)
    return distinct.groupBy(name).agg(
        F.sum("n_mentions").alias("n_mentions"),
        F.count(F.lit(1)).alias("n_descriptions"),
        F.min(description).alias(description),
        (F.sum("n_mentions") >= RESUMMARY_AT).alias("needs_summary"),
    )


def entity_descriptions(mentions: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """Distinct (name, description) with the number of mentions."""
    return mentions.groupBy(name, description).agg(F.count(F.lit(1)).alias("n_mentions"))


def merge_relations(
    relations: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight", description: str = "description"
) -> DataFrame:
    """Undirected relations, one row per pair of ends: (src, dst, weight, n_mentions, n_descriptions, ...).

    The smaller end stands first, weights add up, and as in ``merge_entities`` descriptions are
    counted and the smallest is kept. Rows without an end drop out; a missing weight counts 1.
    """
    ends = [F.least(src, dst).alias(src), F.greatest(src, dst).alias(dst)]
    told = relations.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        *ends, F.coalesce(F.col(weight), F.lit(1)).alias(weight), description
    )
    distinct = told.groupBy(src, dst, description).agg(F.sum(weight).alias(weight), F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy(src, dst).agg(
        F.sum(weight).alias(weight),
        F.sum("_n").alias("n_mentions"),
        F.count(description).alias("n_descriptions"),
        F.min(description).alias(description),
        (F.sum("_n") >= RESUMMARY_AT).alias("needs_summary"),
    )


def summarise_descriptions(
    descriptions: DataFrame, keys: list[str], make_model: Callable, description: str = "description", most: int = 8,
) -> DataFrame:
    """(keys, description): the descriptions of each key drawn together by a model, ``most`` at a time.

    Level by level, groups of at most ``most`` texts become one prompt and one answer, until a key
    has one text; a single text is not sent. Texts are dealt to groups by slots of a bounded
    number of texts, so a key with a third of all rows fills many tasks. Every level is written, so
    an answer is asked for once even when an executor is lost later. Equal texts count once.
    """
    if most < 2:
        raise ValueError("most must be at least 2")
    spark = descriptions.sparkSession
    texts = descriptions.where(F.col(description).isNotNull()).select(*keys, description).distinct()
    schema = texts.schema
    while True:
        path = workspace(spark, "summaries")
        texts.write.parquet(path)
        texts = spark.read.schema(schema).parquet(path)
        sizes = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= 1:
            return texts
        numbered = texts.join(sizes, keys).withColumn(
            "_slot", F.pmod(F.xxhash64(description), F.expr(f"(_n + {64 * most - 1}) div {64 * most}"))
        )
        place = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(description)) - 1
        groups = numbered.withColumn("_group", F.floor(place / most)).groupBy(*keys, "_slot", "_group").agg(
            F.array_join(F.array_sort(F.collect_list(description)), "\n").alias("_joined"), F.count(F.lit(1)).alias("_n")
        )
        several = groups.withColumn("prompt", F.when(F.col("_n") > 1, F.concat(F.lit(_SUMMARY_PROMPT), "_joined")))
        answered = models.apply_text_model(several, make_model)
        texts = answered.select(*keys, F.coalesce("answer", "_joined").alias(description)).distinct()


def graph_neighbourhood(
    edges: DataFrame, seeds: DataFrame, max_nodes: int | None = None, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Seeds and the nodes one edge away: (node, hop, links), all or the first ``max_nodes``.

    Seeds come first, then nodes with more edges to seeds, then by name. Edges are
    undirected; parallel edges count each.
    """
    ids = seeds.select(F.col(seeds.columns[0]).alias("_seed")).distinct()
    forward = edges.join(ids, F.col(src) == F.col("_seed"), "left_semi").select(F.col(dst).alias("node"))
    backward = edges.join(ids, F.col(dst) == F.col("_seed"), "left_semi").select(F.col(src).alias("node"))
    links = forward.unionByName(backward).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    own = ids.select(F.col("_seed").alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("links"))
    around = links.select("node", F.lit(1).alias("hop"), "links")
    nodes = own.unionByName(around).groupBy("node").agg(F.min("hop").alias("hop"), F.max("links").alias("links"))
    return nodes if max_nodes is None else nodes.orderBy("hop", F.desc("links"), "node").limit(max_nodes)
