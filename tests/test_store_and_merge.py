from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import merge, retrieval
from reportloom.plans import knowledge as kn
from reportloom.streaming import store

DDL = "doc_id long, text string, file_path string"


def _embedder_without(*banned):
    def make():
        def embed(texts):
            for t in texts:
                assert not any(b in t for b in banned), t
            return [[len(t), 1.0] for t in texts]

        return embed

    return make


def _rows(frame):
    return sorted((r.document_id, r.file_path, r.chunk_index, r.chunk, r.n_words, tuple(r.embedding)) for r in frame.select(
        "document_id", "file_path", "chunk_index", "chunk", "n_words", "embedding").collect())


def test_store_equals_one_run_and_embeds_new_content_only(spark, tmp_path):
    path = str(tmp_path / "index")

    def insert(rows, *banned):
        kn.insert_into_store(spark.createDataFrame(rows, DDL), path, _embedder_without(*banned), 2, buckets=4, size=5, overlap=1)

    def once(rows):
        return _rows(kn.insert_documents(spark.createDataFrame(rows, DDL), _embedder_without(), 2, size=5, overlap=1))

    long = " ".join(f"word{i}" for i in range(23))
    first = [(1, "alpha one", "a"), (2, "alpha one", "b"), (3, long, "c"), (4, "", "d"), (5, "was here", "e")]
    insert(first)
    assert _rows(kn.stored_chunks(spark, path)) == once(first)
    # Known content is skipped whoever brings it; a changed document loses its old chunks.
    second = [(6, "alpha one", "f"), (3, long, "c"), (5, "is there", "e"), (7, "beta", "g")]
    insert(second, "alpha", "word")
    now = [*first[:4], *second[2:], (6, "alpha one", "f")]
    assert _rows(kn.stored_chunks(spark, path)) == once(now)
    # The first document of a content changes: the next one gives the path.
    insert([(1, "gamma", "a")], "alpha")
    now = [(1, "gamma", "a"), *now[1:]]
    assert _rows(kn.stored_chunks(spark, path)) == once(now)
    # Again, and content that comes back: nothing is embedded.
    insert(now, "")
    insert([(5, "was here", "e")], "")
    now = [r for r in now if r[0] != 5] + [(5, "was here", "e")]
    assert _rows(kn.stored_chunks(spark, path)) == once(now)
    insert([])
    assert _rows(kn.stored_chunks(spark, path)) == once(now)


def test_relations_are_undirected(spark):
    rows = [("a", "b", 1.0, "x"), ("b", "a", 2.0, "y"), ("b", "a", None, "y"), ("a", "c", 1.0, None), ("a", None, 9.0, "z"), ("d", "d", 1.5, "q")]
    rows += [("h", "i", 0.5, f"t{i % 3}") for i in range(6)]
    got = {(r.src, r.dst): tuple(r)[2:] for r in retrieval.merge_relations(spark.createDataFrame(rows, "src string, dst string, weight double, description string")).collect()}
    assert got == {
        ("a", "b"): (4.0, 3, 2, "x", False), ("a", "c"): (1.0, 1, 0, None, False),
        ("d", "d"): (1.5, 1, 1, "q", False), ("h", "i"): (3.0, 6, 3, "t0", True),
    }


def test_summaries_are_bounded_and_whole(spark):
    rnd = random.Random(2)
    rows = [("hot", f"t{rnd.randrange(10**9)}") for _ in range(700)] + [("one", "only"), ("two", "b"), ("two", "a"), ("two", "a"), ("none", None)]

    def adding():
        def model(prompt, **_):
            head, *lines = prompt.split("\n")
            assert head and 2 <= len(lines) <= 5
            # A summary that keeps its parts, to see that every text comes in exactly once.
            return "+".join(lines)

        return model

    told = spark.createDataFrame(rows, "name string, description string").repartition(7)
    got = {r.name: r.description for r in retrieval.summarise_descriptions(told, ["name"], adding, most=5).collect()}
    assert set(got) == {"hot", "one", "two"} and got["one"] == "only" and got["two"] == "a+b"
    assert sorted(got["hot"].split("+")) == sorted({d for n, d in rows if n == "hot"})
    assert retrieval.summarise_descriptions(told.where(F.lit(False)), ["name"], adding).count() == 0
    with pytest.raises(ValueError):
        retrieval.summarise_descriptions(told, ["name"], adding, most=1)


def test_new_content_moves_no_stored_chunk_and_files_stay_few(spark, tmp_path):
    path = str(tmp_path / "index")

    def insert(rows):
        kn.insert_into_store(spark.createDataFrame(rows, DDL), path, _embedder_without(), 2, buckets=2, size=5, overlap=1)

    def files():
        return {f for f in spark.read.parquet(f"{path}/chunks").inputFiles() if "_bucket=-1" not in f}

    insert([(i, f"first text {i}", "a") for i in range(20)])
    first = files()
    insert([(100 + i, f"second text {i}", "b") for i in range(20)])
    assert first and first < files()
    for n in range(store.FILES + 2):
        insert([(1000 * (n + 2) + i, f"more {n} text {i}", "c") for i in range(9)])
    assert len(files()) <= 2 * store.FILES
    got = kn.stored_chunks(spark, path)
    assert got.count() == got.select("document_id").distinct().count() == 40 + 9 * (store.FILES + 2)


def test_last_writer_of_whole_rows_travels_once(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "w"), ("a", None, "z"), (None, 1, None), (None, 1, "u"), ("b", None, None)], "k string, at int, text string")
    best = merge.latest_per_key(rows, ["k"], ["at", "text"])
    assert {tuple(r) for r in best.collect()} == {("a", 2, "w"), (None, 1, "u"), ("b", None, None)}
    assert "max_by" not in best._jdf.queryExecution().toString()
