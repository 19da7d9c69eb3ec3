"""A training corpus from ``documents``, in stages that are each written and read again.

Every stage reads whole texts of any length, takes null texts as empty, and decides row by row: a
null or repeated doc_id makes no two rows one. Ties go as the operator's docstring says. Columns it
does not read come through as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.common import ROW, read_table, stage_table, with_row_key
from reportloom.llm.exact import exact_groups
from reportloom.llm.minhash import near_classes
from reportloom.llm.packing import pack_documents
from reportloom.llm.pii import redact
from reportloom.llm.queries import VOCAB
from reportloom.llm.toxicity import toxicity

# Packing shares its workers with the other stages: fewer chunks than when it runs alone. No result depends on it.
REMEMBERED_CHUNKS = 60_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row key, and the free name that a column named like the key got."""
    free = ROW
    while free in docs.columns:
        free += "_"
    return with_row_key(docs.withColumnRenamed(ROW, free) if free != ROW else docs), free


def _without(keyed: DataFrame, free: str, gone: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``gone``; all columns as they were.

    Only keys are sorted out; texts move where keys are too many to broadcast.
    """
    kept = keyed.join(stage_table(gone.select(ROW), "gone"), ROW, "left_anti").drop(ROW)
    return kept.withColumnRenamed(free, ROW) if free != ROW else kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.5); repeated rows go or stay alike."""
    keyed, free = _keyed(docs)
    scored = toxicity(keyed, read_table(spark, sf_dir, "labels"), by_row=True)
    return _without(keyed, free, scored.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; rows without text are one group, of ties one row stays."""
    keyed, free = _keyed(docs)
    return _without(keyed, free, exact_groups(keyed, by_row=True).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies; texts without words are nobody's copy and stay."""
    keyed, free = _keyed(docs)
    return _without(keyed, free, near_classes(keyed, by_row=True).where("NOT kept"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a row without text is one id long."""
    return pack_documents(docs, VOCAB, remembered=REMEMBERED_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

# Scores and minimum bin slack are not expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
