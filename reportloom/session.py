"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for the plans in this package to hold at scale. Shuffle partitions
# are a starting point only: adaptive execution coalesces small ones and splits skewed ones.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_bases: dict[str, str] = {}


def build_session(app_name: str = "reportloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings above; keyword names use ``_`` for ``.``-free keys only."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str = "work") -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local-master session may fall back to a temporary folder; on a cluster a folder
    of one machine would be lost with that machine, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_bases:
            _local_bases[app] = tempfile.mkdtemp(prefix="reportloom-")
        base = _local_bases[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is removed when the query ends.

    For writes, whose shuffles nobody reads again; a frame that is run twice would shuffle twice.
    """
    old = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, old)


def write_lean(df: DataFrame, path: str) -> None:
    """``df`` as Parquet files that are packed tightly; its shuffle files are removed with the write."""
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``workspace``, or one below it, that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many partitions as shuffles have.

    For rules that cost far more than moving a row (text reading, rendering). Dealt in turns, which
    sorts the rows first, or by the hash of the columns ``by``: cheaper, but rows equal in all of them
    stay together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
