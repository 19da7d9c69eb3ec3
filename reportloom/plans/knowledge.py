"""Documents and content items -> stored chunks with vectors; retrieval over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from reportloom.functions import content as ct, templates as tm
from reportloom.operators import content, documents, merge, models, retrieval
from reportloom.operators.vectors import VectorIndex, index_top_k
from reportloom.session import workspace
from reportloom.streaming import store


def insert_documents(
    docs: DataFrame,
    make_embedder: Callable,
    dim: int,
    key: str = "doc_id",
    text_col: str = "text",
    path_col: str = "file_path",
    **chunking,
) -> DataFrame:
    """(document_id, file_path, chunk_index, chunk, n_words, embedding), each content once.

    Copies are found on ids alone; the first by ``key`` keeps its text and path.
    """
    first = documents.distinct_documents(docs.select(key, text_col), text_col, [key])
    kept = docs.join(first.select("document_id", key), key)
    chunks = content.chunk_documents(kept, text_col, ("document_id", path_col), **chunking)
    return models.embed_texts(chunks, make_embedder, dim, "chunk")


def insert_into_store(
    docs: DataFrame,
    path: str,
    make_embedder: Callable,
    dim: int,
    key: str = "doc_id",
    text_col: str = "text",
    path_col: str = "file_path",
    buckets: int = store.BUCKETS,
    **chunking,
) -> None:
    """Add ``docs`` to the stored index below ``path``; ``stored_chunks`` reads it.

    Content that is stored already is neither cut nor embedded again, whoever brings it. A document
    that comes with another text under the same ``key`` then stands for that text only; chunks that
    no document stands for any more are not read, and serve again if their content returns. Of a
    key that comes twice the greatest content id counts. Running it again changes nothing: chunks
    are added before the documents that point to them, and stored ones stay where they are.
    """
    spark = docs.sparkSession
    named = docs.withColumn("document_id", documents.document_id(F.col(text_col)))
    # Ids alone decide, so no text is sorted or written here.
    staged = workspace(spark, "insert")
    merge.latest_per_key(named.select(key, "document_id", path_col), [key], ["document_id", path_col]).write.parquet(staged)
    new = spark.read.parquet(staged)
    first = new.groupBy("document_id").agg(F.min(key).alias(key))
    held = f"{path}/chunks"
    chunk_schema = "document_id string, chunk_index int, chunk string, n_words int, embedding array<float>"
    known = store.read_buckets(spark, held, T.StructType.fromDDL(chunk_schema)).select("document_id").distinct()
    wanted = first.join(known, "document_id", "left_anti")
    fresh = named.join(wanted, ["document_id", key], "left_semi").dropDuplicates(["document_id"])
    chunks = content.chunk_documents(fresh, text_col, ("document_id",), **chunking)
    embedded = models.embed_texts(chunks, make_embedder, dim, "chunk")
    embedded = embedded.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(chunk_schema)])
    # Known content is left out above, so no stored chunk is replaced.
    store.add_to_buckets(spark, held, embedded, "document_id", buckets)

    def latest(old: DataFrame, rows: DataFrame) -> DataFrame:
        return merge.upsert(old, rows, [key], ["document_id", path_col], ["document_id"])

    store.merge_buckets(spark, f"{path}/documents", new.select(key, "document_id", path_col), key, latest, buckets)


def stored_chunks(spark: SparkSession, path: str, key: str = "doc_id", path_col: str = "file_path") -> DataFrame:
    """(document_id, file_path, chunk_index, chunk, n_words, embedding) of all contents in use.

    A content has the path of its first document by ``key``.
    """
    first = F.min_by(path_col, key).alias(path_col)
    used = spark.read.parquet(f"{path}/documents").where(F.col(key).isNotNull()).groupBy("document_id").agg(first)
    return spark.read.parquet(f"{path}/chunks").drop("_bucket").join(used, "document_id")


def describe_items(
    items: DataFrame,
    make_model: Callable,
    mode: str = "page",
    window: int = 1,
    max_words: int = ct.MAX_CONTEXT_WORDS,
    enabled: dict | None = None,
) -> DataFrame:
    """(doc_id, pos, processor, entity_name, entity_type, description, summary, chunk).

    Every routed non-text item gets its surrounding context, a prompt, a model answer, and
    the text that is stored for it. An unreadable answer is kept whole as the description.
    """
    around = content.page_context if mode == "page" else content.chunk_context
    context = around(items, window, max_words)
    fields = [c for c in items.columns if c not in ("doc_id", "pos")]
    routed = (
        items.where(ct.kind_of(F.col("type")) != "text")
        .withColumn("processor", ct.route_content(F.col("type"), **(enabled or {})))
        .where("processor IS NOT NULL")
        .select("doc_id", "pos", "processor", F.struct(*fields).alias("item"))
    )
    name = F.concat_ws(" ", F.col("item.type"), F.col("pos").cast("string"))
    asked = routed.join(context, ["doc_id", "pos"]).withColumn("name", name)
    asked = asked.withColumn(
        "prompt", tm.render_prompt(F.col("processor"), F.col("item"), F.col("name"), F.col("context"))
    ).drop("context")
    answered = models.apply_text_model(asked, make_model).drop("prompt")
    read = answered.withColumn("m", ct.parse_modal_json(F.col("answer")))
    described = read.withColumn("description", F.coalesce("m.detailed_description", "answer"))
    return described.select(
        "doc_id",
        "pos",
        "processor",
        F.coalesce("m.entity_info.entity_name", "name").alias("entity_name"),
        F.coalesce("m.entity_info.entity_type", "item.type").alias("entity_type"),
        "description",
        F.col("m.entity_info.summary").alias("summary"),
        tm.render_modal_chunk(F.col("processor"), F.col("item"), F.col("description")).alias("chunk"),
    )


def insert_multimodal(
    items: DataFrame, make_model: Callable, make_embedder: Callable, dim: int, **how
) -> DataFrame:
    """``describe_items`` with a vector per stored text."""
    return models.embed_texts(describe_items(items, make_model, **how), make_embedder, dim, "chunk")


def retrieve(
    queries: DataFrame,
    entities: DataFrame | VectorIndex,
    relations: DataFrame | VectorIndex,
    mode: str = "hybrid",
    k: int = retrieval.TOP_K,
    threshold: float = retrieval.COSINE_THRESHOLD,
    chunks: DataFrame | VectorIndex | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): best ``k`` hits per query over entities and relations.

    With ``chunks`` their hits take part as well, in any mode. ``queries`` has (query_id,
    embedding); the others (vec_id, embedding), or are indexes of such. Ids must not repeat across
    the sides.
    """

    def hits(vectors: DataFrame | VectorIndex) -> DataFrame:
        search = index_top_k if isinstance(vectors, VectorIndex) else retrieval.vector_top_k
        found = search(vectors, queries, k, threshold)
        return found.select("query_id", F.col("vec_id").alias("id"), "score")

    keys = ("query_id", "id")
    if mode in ("local", "global"):
        side = hits(entities if mode == "local" else relations)
        both = retrieval.hybrid_candidates(side, side, mode, keys)
    else:
        both = retrieval.hybrid_candidates(hits(entities), hits(relations), mode, keys)
    if chunks is not None:
        both = both.unionByName(hits(chunks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
