"""Merkle manifest of a table: one hash tree per key, one tree over their roots, a proof per row.

Rows are leaves in a gapless order per key. Per level a window puts the siblings of a node beside
it, as lag and lead columns of fixed offsets masked by the node's slot and the length of its run;
the first child of each run hashes the parent. Proofs come down the tree again: a node's path is
its own siblings before those of its parent. A run has at most ``FANOUT`` rows, so neither a window
nor a join ever meets more, however many rows one key holds; only hashes move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import join_groups, stage_table, with_rank

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of all fields: ``-`` for null, else UTF-8 length, ``:`` and the value."""

    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` (_k, _at, _n, digest, ...) plus _run, _left and _right: hashes of the run's others.

    The mask makes the result the same for windows of any whole number of runs; with one run
    each, the join with the parents needs no further exchange.
    """
    slot, at = F.col("_at") % fanout, F.col("_at")
    numbered = nodes.withColumn("_run", F.expr(f"_at div {fanout}"))
    order = Window.partitionBy("_k", "_run").orderBy("_at")
    left = [F.when(slot >= i, F.lag("digest", i).over(order)) for i in range(fanout - 1, 0, -1)]
    right = [
        F.when((slot + i < fanout) & (at + i < F.col("_n")), F.lead("digest", i).over(order)) for i in range(1, fanout)
    ]
    return numbered.withColumns({"_left": F.concat_ws("", *left), "_right": F.concat_ws("", *right)})


def build_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The written levels of all trees from ``leaves`` (_k, _at, _n, digest, ...) up to single nodes.

    A tree ends at the level where its ``_n`` is 1; it takes no part above.
    """
    levels = [leaves]
    most = leaves.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        first = with_siblings(levels[-1].where("_n > 1"), fanout).where(F.col("_at") % fanout == 0)
        parents = first.select(
            "_k",
            F.col("_run").alias("_at"),
            F.expr(f"(_n + {fanout - 1}) div {fanout}").alias("_n"),
            F.sha2(F.concat("_left", "digest", "_right"), 256).alias("digest"),
        )
        levels.append(stage_table(parents, "level"))
        most = -(-most // fanout)
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(_k, digest): the root of each tree."""
    tops = [level.where("_n = 1").select("_k", "digest") for level in levels]
    every = tops[0]
    for top in tops[1:]:
        every = every.unionByName(top)
    return every


def with_paths(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with ``path`` and the other columns of ``tops`` (_k, path, ...), one row per tree.

    ``path`` lists (left, right) sibling hashes from the leaf up, then what ``tops`` has above the
    tree's root. Levels above the leaves are written; a parent serves at most ``fanout`` nodes.
    """
    more = [c for c in tops.columns if c not in ("_k", "path")]
    parents = None
    for depth, level in reversed(list(enumerate(levels))):
        own = [c for c in level.columns if c not in ("_k", "_at", "_n")]
        got = level.where("_n = 1").join(tops, "_k").select("_k", "_at", *own, "path", *more)
        if parents is not None:
            above = parents.select("_k", F.col("_at").alias("_run"), F.col("path").alias("_above"), *more)
            path = F.concat(F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))), "_above")
            below = with_siblings(level.where("_n > 1"), fanout).join(above, ["_k", "_run"])
            got = got.unionByName(below.select("_k", "_at", *own, path.alias("path"), *more))
        parents = got if depth == 0 else stage_table(got, "paths")
    return parents


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda up, s: F.sha2(F.concat(s["left"], up, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings from the leaf up, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _numbered(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """``rows`` plus _k, _at (gapless place per key) and _n (rows per key), written."""
    ranked = with_rank(rows.withColumn("_k", key), "_k", *order)
    sizes = stage_table(
        ranked.groupBy("_k").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")), "sizes"
    )
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    placed = join_groups(ranked, sizes, "_k", "_n", total)
    return stage_table(placed.withColumn("_at", F.col("_rank") - F.col("_first")).drop("_rank", "_first"), "placed")


def merkle_manifest(leaves: DataFrame, key: str, order: str, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (key, order, digest, ...) plus subroot, root and path.

    Leaves of a key stand by ``order``, nulls first and ties by digest; keys by their bytes, null
    first. Empty tables give no rows. A key of one leaf has that leaf as its subroot.
    """
    # A null key sorts before the empty string, and none is lost in joins.
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    levels = build_levels(_numbered(leaves, name, order, "digest"), fanout)
    subroots = stage_table(tree_roots(levels).withColumnRenamed("_k", "_tree"), "subroots")
    upper = build_levels(_numbered(subroots, F.lit(""), "_tree"), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = tree_roots(upper).select("_k", none.alias("path"), F.col("digest").alias("root"))
    tops = with_paths(upper, top, fanout).select(
        F.col("_tree").alias("_k"), "path", F.col("digest").alias("subroot"), "root"
    )
    return with_paths(levels, stage_table(tops, "tops"), fanout).drop("_k", "_at")


def audit_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its place in the manifest, its proof, and whether it still verifies.

    Where 3 divides the unsigned crc32 of the decimal ``doc_id``, the row is tampered with: A to Z of
    its text are lower-cased, and ``folded_root`` is what the changed leaf gives with the recorded
    siblings. A null ``doc_id`` is never tampered with and stands first; a null field is hashed as
    ``-``, an empty one as ``0:``. Rows of the same ``doc_id`` stand by leaf hash, equal rows are
    leaves of their own. Texts of any length are hashed in place. Other columns are not read.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = stage_table(
        docs.select("lang", "doc_id", leaf_hash(fields).alias("digest"), F.when(hit, leaf_hash(changed)).alias("_now")),
        "leaves",
    )
    got = merkle_manifest(leaves, "lang", "doc_id").withColumn("folded_root", fold(F.coalesce("_now", "digest"), F.col("path")))
    return got.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
