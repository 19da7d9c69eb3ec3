"""Quality by hierarchical empirical Bayes: document evidence with site and path posteriors.

Boosted trees over dense features give each document a calibrated probability of being good.
Sites (host, and path within a host) have a rate of good documents of their own: labels where
they may be used, else the document probabilities, summed by group. A site's rate is a beta
posterior whose prior is the level above (global, then host), with a strength estimated from
how much sites differ beyond what their sizes explain, so sparse sites stay near the prior.
The score adds the path's log-odds against the global rate to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm import boost
from reportloom.llm.bpe import Remembered
from reportloom.llm.common import join_groups, small_batches, stage_table
from reportloom.llm.features import QUALITY_NAMES, ChunkFeatures, quality_row
from reportloom.llm.toxicity import TRAINING_ROWS, held_out, training_rows

# Prior strengths outside these bounds say too little or too much about single sites.
STRENGTH = (2.0, 10_000.0)


@dataclass
class DocumentModel:
    trees: boost.Boosted
    calibration: boost.Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(x))


def _rows(tool: ChunkFeatures, texts: list) -> np.ndarray:
    x = [quality_row(t or "", *tool.table(t)) for t in texts]
    return np.array(x, float).reshape(-1, len(QUALITY_NAMES))


def fit_documents(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DocumentModel:
    """Document classifier from at most ``bound`` labelled rows, calibrated across halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkFeatures({})
        for batch in small_batches(batches):
            x = _rows(tool, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "half", "x"]
            )

    rows = training_rows(docs, labels, "quality", bound).select("doc_id", "text", "y", "half")
    got = rows.mapInArrow(run, "y int, half int, x array<double>").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(QUALITY_NAMES))
    y = np.array([r["y"] for r in got], float)
    half = np.array([r["half"] for r in got], int)
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half == h] = boost.fit(x[half != h], y[half != h]).margin(x[half == h])
    if not len(y):
        # Nothing known: every document is as likely good as not.
        return DocumentModel(boost.Boosted(0.0, []), boost.Isotonic(np.array([0.0]), np.array([0.5])))
    return DocumentModel(boost.fit(x, y), boost.isotonic(margin, y))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(q / (1 - q))


def _strength(groups: DataFrame, mean: str) -> float:
    """Beta prior strength by the method of moments over groups of rows (n, good, ``mean``)."""
    n, rate, prior = F.col("n"), F.col("good") / F.col("n"), F.col(mean)
    row = groups.where("n >= 2").agg(
        F.sum(n * (rate - prior) * (rate - prior)).alias("spread"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum(n * prior * (1 - prior)).alias("scale"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    if not row["k"] or not row["scale"]:
        return STRENGTH[1]
    # Share of the rates' variance that is between groups; the strength is its odds against.
    between = max((row["spread"] - row["chance"]) / row["scale"], 1e-9)
    return float(np.clip((1 - between) / between, *STRENGTH))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(_host, _path, n, host_rate, path_rate) from rows of _host, _path and _good (0 to 1)."""
    paths = scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("good"))
    paths = stage_table(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    hosts = hosts.withColumn("prior", F.lit(float(rate)))
    s = _strength(hosts, "prior")
    hosts = hosts.select("_host", ((F.col("good") + s * rate) / (F.col("n") + s)).alias("host_rate"))
    named = stage_table(paths.join(hosts, "_host"), "hosts")
    s = _strength(named, "host_rate")
    return named.select(
        "_host",
        "_path",
        "n",
        F.lit(float(rate)).alias("global_rate"),
        "host_rate",
        ((F.col("good") + s * F.col("host_rate")) / (F.col("n") + s)).alias("path_rate"),
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    bound: int = TRAINING_ROWS,
) -> DataFrame:
    """(doc_id, held_out, doc_score, host_rate, path_rate, score, predicted, kept) per document.

    ``host`` and ``path`` default to source and lang, which are the site and its section in the
    documents table. Labels of held-out rows are used nowhere. Null host, path or text count as
    an empty one; null and repeated doc_ids are kept row by row, and a null one is never held
    out. An empty table gives an empty result; without labels every document score is 0.5. Other
    columns are not read.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit_documents(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkFeatures({})
        Remembered.keep_only(tool.rows)
        for batch in small_batches(batches):
            score = model.scores(_rows(tool, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(score)], names=["doc_id", "_host", "_path", "doc_score"]
            )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("_text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("_host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("_path"),
    )
    scored = stage_table(named.mapInArrow(run, "doc_id bigint, _host string, _path string, doc_score double"), "scored")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("_label"))
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("_label").alias("_label"))
    )
    rows = scored.join(known, "doc_id", "left").withColumn("_good", F.coalesce("_label", "doc_score"))
    sites = site_posteriors(rows).withColumn("_key", F.struct("_host", "_path")).drop("_host", "_path")
    keyed = scored.withColumn("_key", F.struct("_host", "_path")).drop("_host", "_path")
    joined = join_groups(keyed, stage_table(sites, "sites"), "_key", "n", scored.count())
    odds = _logit(F.col("doc_score")) + _logit(F.col("path_rate")) - _logit(F.col("global_rate"))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "doc_score",
        "host_rate",
        "path_rate",
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        (score >= 0.5).alias("kept"),
    )
