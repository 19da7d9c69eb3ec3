"""Vector search, candidates, entities, graph, model hooks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from reportloom.operators import models as md, retrieval as op, vectors as vx
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_TOP_SQL = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE label = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2)
SELECT * FROM r WHERE rank <= {k}"""


def _queries(spark, sf_dir):
    return tb.table(spark, sf_dir, "embeddings").where("label = 0").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


@query("vector_top_k", _TOP_SQL.format(k=60))
def vector_top_k(spark, sf_dir):
    return op.vector_top_k(tb.table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir))


@query("vector_top_k_many_queries", _TOP_SQL.format(k=5))
def vector_top_k_many_queries(spark, sf_dir):
    """A short list per query, from more blocks than there are partitions."""
    return op.vector_top_k(tb.table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), k=5, blocks=31)


@query("vector_index_top_k", _TOP_SQL.format(k=60).replace("label = 0", "vec_id % 100 = 0"))
def vector_index_top_k(spark, sf_dir):
    """Every hundredth vector as a query, over an index of all vectors."""
    vectors = tb.table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vx.index_top_k(vx.build_index(vectors), asked)


@query(
    "hybrid_candidates",
    """SELECT id, max(score) AS score FROM (
  SELECT l_partkey AS id, l_discount AS score FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_partkey, l_tax FROM lineitem WHERE l_returnflag <> 'A') GROUP BY id""",
)
def hybrid_candidates(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    local = lines.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"))
    far = lines.where("l_returnflag <> 'A'").select(F.col("l_partkey").alias("id"), F.col("l_tax").alias("score"))
    return op.hybrid_candidates(local, far)


@query(
    "merge_entities",
    """SELECT p_name AS name, count(*) AS n_mentions, count(DISTINCT p_brand || p_type) AS n_descriptions,
  min(p_brand || p_type) AS description, count(*) >= 6 AS needs_summary FROM part GROUP BY p_name""",
)
def merge_entities(spark, sf_dir):
    mentions = tb.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.concat("p_brand", "p_type").alias("description")
    )
    return op.merge_entities(mentions)


@query(
    "merge_relations",
    """SELECT least('s' || l_suppkey, 'p' || l_partkey) AS src, greatest('s' || l_suppkey, 'p' || l_partkey) AS dst,
  CAST(sum(l_quantity) AS DOUBLE) AS weight, count(*) AS n_mentions, count(DISTINCT l_returnflag || l_linestatus) AS n_descriptions,
  min(l_returnflag || l_linestatus) AS description, count(*) >= 6 AS needs_summary FROM lineitem GROUP BY 1, 2""",
)
def merge_relations(spark, sf_dir):
    """Supplier-part relations, told from either end."""
    part, supplier = (F.concat(F.lit(c), F.col(k).cast("string")) for c, k in (("p", "l_partkey"), ("s", "l_suppkey")))
    turned = F.col("l_linenumber") % 2 == 0
    told = tb.table(spark, sf_dir, "lineitem").select(
        F.when(turned, part).otherwise(supplier).alias("src"), F.when(turned, supplier).otherwise(part).alias("dst"),
        F.col("l_quantity").cast("double").alias("weight"), F.concat("l_returnflag", "l_linestatus").alias("description"),
    )
    return op.merge_relations(told)


def _shortest_line_model():
    def model(prompt, **_):
        return min(prompt.split("\n")[1:], key=lambda line: (len(line.encode()), line.encode()))

    return model


@query(
    "summarise_descriptions",
    """SELECT p_type AS name, arg_min(d, (strlen(d), d)) AS description FROM (
  SELECT p_type, p_name || ' ' || p_partkey AS d FROM part) GROUP BY p_type""",
)
def summarise_descriptions(spark, sf_dir):
    """With a model that answers its shortest line, so the grouping does not show."""
    told = tb.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("name"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("description")
    )
    return op.summarise_descriptions(told, ["name"], _shortest_line_model)


_GRAPH_SQL = """WITH edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
seeds AS (SELECT 's' || s_suppkey AS seed FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size = 50),
hits AS (SELECT dst AS node FROM edges WHERE src IN (SELECT seed FROM seeds)
         UNION ALL SELECT src FROM edges WHERE dst IN (SELECT seed FROM seeds)),
nodes AS (SELECT node, min(hop) AS hop, max(links) AS links FROM (
  SELECT seed AS node, 0 AS hop, 0 AS links FROM seeds UNION ALL SELECT node, 1, count(*) FROM hits GROUP BY node) GROUP BY node)
SELECT node, hop, links FROM nodes"""


def _neighbourhood(spark, sf_dir, most=None):
    edges = tb.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )
    rich = tb.table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed")
    )
    large = tb.table(spark, sf_dir, "part").where("p_size = 50").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("seed")
    )
    return op.graph_neighbourhood(edges, rich.unionByName(large), max_nodes=most)


# ---- hooks with pure functions -------------------------------------------------------


def _counting_model():
    def model(prompt, system_prompt=None, history_messages=None, **_):
        return f"{system_prompt}:{len(prompt)}"

    return model


def _looking_model():
    def model(prompt, system_prompt=None, image_data=None, **_):
        return f"saw {len(image_data)} for {len(prompt)}"

    return model


def _measuring_embedder():
    def embed(texts):
        return [[len(t), t.count(" "), int(hashlib.md5(t.encode()).hexdigest()[:2], 16)] for t in texts]

    return embed


def _line_parser():
    def parse(path, content):
        text = bytes(content).decode()
        if len(text) % 5 == 0:
            raise ValueError(f"cannot read {path}")
        return [{"type": "text", "text": part, "page_idx": i} for i, part in enumerate(text.split("\n"))]

    return parse


@query("graph_neighbourhood", _GRAPH_SQL)
def graph_neighbourhood(spark, sf_dir):
    return _neighbourhood(spark, sf_dir)


@query("graph_neighbourhood_limited", _GRAPH_SQL + " ORDER BY hop, links DESC, node LIMIT 1000")
def graph_neighbourhood_limited(spark, sf_dir):
    """With the node limit of a retrieval setting."""
    return _neighbourhood(spark, sf_dir, 1000)


@query("apply_text_model", "SELECT doc_id, 'sys:' || length(text) AS answer FROM documents")
def apply_text_model(spark, sf_dir):
    prompts = tb.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return md.apply_text_model(prompts, _counting_model, system_prompt="sys").drop("prompt")


@query(
    "apply_vision_model",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'None:' || length(url)
  ELSE 'saw ' || length(to_base64(encode(html))) || ' for ' || length(url) END AS answer FROM pages""",
)
def apply_vision_model(spark, sf_dir):
    image = F.when(F.col("page_id") % 3 != 0, F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", ""))
    requests = tb.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("prompt"), image.alias("image_base64"))
    return md.apply_vision_model(requests, _looking_model, _counting_model).select("page_id", "answer")


@query(
    "embed_texts",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS e0, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS e1,
  CAST(('0x' || left(md5(text), 2)) AS INT)::DOUBLE AS e2 FROM documents""",
)
def embed_texts(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = md.embed_texts(rows, _measuring_embedder, 3)
    return got.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)])


@query(
    "parse_files",
    """SELECT 'doc/' || doc_id AS path, length(text) % 5 <> 0 AS ok,
  CASE WHEN length(text) % 5 = 0 THEN 'cannot read doc/' || doc_id ELSE '-' END AS error,
  CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN length(text) % 5 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n_blocks FROM documents""",
)
def parse_files(spark, sf_dir):
    files = tb.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    got = md.parse_files(files, _line_parser, wait_seconds=0)
    return got.select("path", "ok", F.coalesce("error", F.lit("-")).alias("error"), "attempts", "n_blocks")


@query(
    "cached_model_calls",
    """WITH cache AS (SELECT DISTINCT text FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN c.text IS NOT NULL THEN 'known' ELSE 'None:' || length(d.text) END AS answer, c.text IS NOT NULL AS from_cache
FROM documents d LEFT JOIN cache c ON d.text = c.text""",
)
def cached_model_calls(spark, sf_dir):
    requests = tb.table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("m").alias("model"), F.col("text").alias("prompt"))
    cache = md.with_call_key(requests.where("lang = 'en'")).select("call_key", F.lit("known").alias("answer")).distinct()
    got = md.cached_model_calls(requests.drop("lang"), cache, _counting_model)
    return got.select("doc_id", "answer", "from_cache")
