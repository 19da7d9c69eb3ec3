"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.session import workspace

HOT_SHARE = 512


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut.

    The copy outlives any executor, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW = "_row_key"
ROW_TYPE = "struct<file:bigint,at:bigint>"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``ROW``, a key that no two rows share, whatever their columns hold.

    The key is the row's place in its Parquet file, so reading the same files again gives the
    same keys; anything but a plain scan of Parquet files is written first.
    """

    def keyed(scan: DataFrame) -> DataFrame:
        at = scan.metadataColumn("_metadata")
        return scan.select("*", F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")).alias(ROW))

    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.toString().strip().endswith(" parquet"):
        return keyed(docs)
    return keyed(stage_table(docs, "rows"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rank(df: DataFrame, *order) -> DataFrame:
    """``df`` plus ``_rank``, the gapless 0-based place in the whole order.

    Range partitions are sorted in tasks and written; a row's rank is its place within its
    partition plus the rows of the partitions before. Only one count per partition meets in
    a single window, however many rows there are.
    """
    laid = stage_table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "rank",
    ).withColumn("_run", F.shiftright("_at", 33))
    starts = (
        laid.groupBy("_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_run",
            (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_start"),
        )
    )
    # One row per written partition: a bound that does not depend on the rows.
    return laid.join(F.broadcast(starts), "_run").select(
        *df.columns,
        (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_rank"),
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key``, safe for hot keys.

    ``size`` is the number of ``rows`` per key and ``total`` their sum. Keys that hold at
    least a 512th of all rows are at most 512, so those groups are broadcast and their rows
    stay where they are; all other keys are joined by shuffle and are small by definition.
    """
    hot = F.col(size) * HOT_SHARE >= F.lit(total)
    few = F.broadcast(groups.where(hot))
    near = rows.join(few, key)
    far = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti").join(
        groups.where(~hot), key
    )
    return near.unionByName(far)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; component is its smallest reachable node.

    Alternates the two star steps of Kiveris et al. (2014): neighbours above a node are hung on
    the smallest neighbour, then neighbours below it. Every round is one pre-aggregated minimum
    and one join, written to the shared folder; links never meet in one place.
    """
    u, v = F.col("u"), F.col("v")
    now = stage_table(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    mark = _fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = stage_table(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    hung = now.select(u.alias("node"), v.alias("component"))
    return hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal values in the first ``keys`` columns, each as one table.

    For partitions that are sorted by those columns; a run may span batches.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for i in range(keys):
            column = table.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for start, end in zip(starts, starts[1:], strict=False):
            yield table.slice(start, end - start)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest


def small_batches(
    batches: Iterator[pa.RecordBatch], chars: int = 4_000_000, rows: int = 10_000, column: int = 1
) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the texts of one column stay near ``chars`` bytes."""
    for batch in batches:
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast("int64")).to_numpy()
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, min(start + rows, int(np.searchsorted(size, done + chars, side="right"))))
            yield batch.slice(start, end - start)
            start = end
