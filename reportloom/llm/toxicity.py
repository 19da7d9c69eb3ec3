"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words and word prefixes that stand in toxic training texts far more
often than in others. Trees are fitted on features under the lexicon of the other half of the
training rows, so a word counts for what it says about unseen texts; calibration uses margins
of trees of the other half as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm import boost
from reportloom.llm.bpe import Remembered
from reportloom.llm.common import ROW, ROW_TYPE, small_batches, stage_table
from reportloom.llm.features import PREFIXES, TOXIC_NAMES, ChunkFeatures, toxic_row

# Bound of fitting: labelled rows.
TRAINING_ROWS = 20_000

# A term enters the lexicon above these: log-odds, and normal score of its count in toxic texts.
MIN_ODDS = 2.0
MIN_SCORE = 5.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, y, half) of at most ``bound`` labelled documents, chosen by hash of the id.

    Only ids are sorted and sent to the tasks; the bound is the broadcast's. A document with
    several labels takes the largest, an id of several rows its largest text; held-out rows and
    null ids or labels are left out.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
        .withColumn("half", F.expr("cast(pmod(xxhash64(doc_id, 'half'), 2) as int)"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(stage_table(picked, "picked")), F.col("_id") == F.col("doc_id"))
    return found.groupBy("doc_id", "y", "half").agg(F.max("text").alias("text")).select("doc_id", "text", "y", "half")


def _beginnings(words: Column, n: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.lit("p:"), F.substring(w, 1, n)))


def _telling(a, b, toxic: int, other: int):
    """(log-odds, normal score) of a term in ``a`` toxic and ``b`` other texts; numbers or columns.

    The score is that of ``a`` against its share if labels did not matter.
    """
    log, root = (F.log, F.sqrt) if isinstance(a, Column) else (np.log, np.sqrt)
    odds = log((a + 0.5) / (toxic + 1)) - log((b + 0.5) / (other + 1))
    share = toxic / max(toxic + other, 1)
    return odds, (a - (a + b) * share) / (root((a + b) * share * (1 - share)) + 1e-12)


def term_counts(rows: DataFrame, toxic: dict[int, int], other: dict[int, int]) -> list:
    """Terms with the toxic and other texts they stand in, per half.

    All terms that ``lexicon`` takes from either half or from both are returned, and no others:
    their number is bounded by the texts of the bounded training rows alone.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    terms = F.array_distinct(
        F.concat(
            F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
            *(_beginnings(words, n) for n in PREFIXES),
        )
    )

    def number(y: int, half: int) -> Column:
        return F.count(F.when((F.col("y") == y) & (F.col("half") == half), 1)).alias(f"n{y}{half}")

    def taken(halves: tuple[int, ...]) -> Column:
        a, b = (sum((F.col(f"n{y}{h}") for h in halves), F.lit(0)) for y in (1, 0))
        odds, score = _telling(a, b, sum(toxic[h] for h in halves), sum(other[h] for h in halves))
        # Wider than the rule of ``lexicon`` by what two ways of rounding may differ.
        return (odds > MIN_ODDS - 1e-6) & (score > MIN_SCORE - 1e-6)

    return (
        rows.select(F.explode(terms).alias("term"), "y", "half")
        .groupBy("term")
        .agg(number(1, 0), number(1, 1), number(0, 0), number(0, 1))
        # A term far more common in toxic texts, seen there at least thrice.
        .where("n10 + n11 >= 3 AND (n10 + n11) * 2 >= n00 + n01")
        .where(taken((0,)) | taken((1,)) | taken((0, 1)))
        .collect()
    )


def lexicon(terms: list, toxic: dict[int, int], other: dict[int, int], halves: tuple[int, ...]) -> dict[str, float]:
    """term -> log-odds from the given halves, for terms too frequent in toxic texts by chance."""
    nt, nc = sum(toxic[h] for h in halves), sum(other[h] for h in halves)
    out = {}
    for row in terms:
        a = sum(row[f"n1{h}"] for h in halves)
        b = sum(row[f"n0{h}"] for h in halves)
        odds, score = _telling(a, b, nt, nc)
        if odds > MIN_ODDS and score > MIN_SCORE:
            out[row["term"]] = float(odds)
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: boost.Boosted
    calibration: boost.Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(x))


def _feature_frame(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """Features of training rows, each under the lexicon that its half names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [ChunkFeatures(x) for x in lexicons]
        for batch in small_batches(batches):
            ids, texts, y, half = (c.to_pylist() for c in batch.columns)
            x = [toxic_row(tools[h].table(t)[1]) for t, h in zip(texts, half, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(half, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "half", "x"]
            )

    return rows.select("doc_id", "text", "y", "half").mapInArrow(run, "y int, half int, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> ToxicityModel:
    """Model from at most ``bound`` labelled rows; without any it scores every text 0."""
    rows = stage_table(training_rows(docs, labels, "toxic", bound), "training")
    sums = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = {h: sums.get((1, h), 0) for h in (0, 1)}
    other = {h: sums.get((0, h), 0) for h in (0, 1)}
    terms = term_counts(rows, toxic, other)
    across = [lexicon(terms, toxic, other, (1,)), lexicon(terms, toxic, other, (0,))]
    got = _feature_frame(rows, across).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(TOXIC_NAMES))
    y = np.array([r["y"] for r in got], float)
    half = np.array([r["half"] for r in got], int)
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half == h] = boost.fit(x[half != h], y[half != h]).margin(x[half == h])
    return ToxicityModel(lexicon(terms, toxic, other, (0, 1)), boost.fit(x, y), boost.isotonic(margin, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, row: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, and its ``row``; see ``toxicity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkFeatures(model.lexicon)
        Remembered.keep_only(tool.rows)
        for batch in small_batches(batches):
            x = np.array([toxic_row(tool.table(t)[1]) for t in batch.column(1).to_pylist()]).reshape(-1, len(TOXIC_NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(x)), *batch.columns[2:]], names=["doc_id", "score", *row]
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    return picked.mapInArrow(run, ", ".join(["doc_id bigint, score double", *(f"{r} {ROW_TYPE}" for r in row)])).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *row,
    )


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS, by_row: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, trained on ``labels.toxic``.

    The whole text is read; null and empty texts get the score of a text without features. A
    null doc_id is scored and never held out; repeated rows are scored each. Labels, lang,
    source and doc_id are no inputs. An empty table gives an empty result; without labels every
    score is 0. Other columns are not read. With ``by_row``, ``docs`` and the result have the key
    of ``with_row_key``.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels, bound), [ROW] if by_row else [])
