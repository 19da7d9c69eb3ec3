from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reportloom.llm.common import ROW
from reportloom.llm.queries import ORACLES, QUERIES, VOCAB

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, bag string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abnhtesr") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    rows, toxic = [], {}
    for i in range(240):
        body = [rnd.choice(words) for _ in range(rnd.randrange(40, 90))]
        toxic[i] = i % 6 == 0
        if toxic[i]:
            for _ in range(3):
                body[rnd.randrange(len(body))] = "scumbag"
        rows.append((i, " ".join(body), "en", "s", 0, "x", "y"))
    by_id = {r[0]: r for r in rows}
    # Copies of document 1: exact but for white space, and one word changed.
    rows.append((300, "  " + by_id[1][1].replace(" ", "\n", 5), "en", "s", 0, "x", "y"))
    rows.append((301, by_id[1][1].rsplit(" ", 1)[0] + " ended", "en", "s", 0, "x", "y"))
    rows.append((302, by_id[2][1] + " write to a.b@mail.org or 4111 1111 1111 1111", "de", "s", 0, "x", "y"))
    rows += [(303, None, None, None, None, None, None), (304, "", "en", "s", 0, "x", "y"), by_id[5]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(t)) for i, t in toxic.items() if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, toxic


def test_stages_keep_what_they_should(spark, corpus):
    folder, rows, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r[0] for r in rows}
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, folder), name)
        assert docs.columns == columns
        by_stage[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in before if not toxic.get(i, False)}
    assert set(by_stage["toxicity"]) == clean
    exact = set(by_stage["exact_dedup"])
    # The copy with more code points stays; null and empty are one text.
    assert clean - exact == {1, 304}
    assert docs.count() == len(by_stage["personal_data"])
    near = set(by_stage["near_dedup"])
    assert exact - near == {301, 302} or exact - near == {300, 302}
    assert set(by_stage["personal_data"]) == near
    unchanged = [i for i in near if i < 240]
    assert all(by_stage["personal_data"][i]["text"] == by_stage["near_dedup"][i]["text"] for i in unchanged)


def test_run_packs_every_kept_document(spark, corpus):
    folder, _, _ = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, folder), "again")
    library = Tokenizer.from_file(VOCAB)
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got: dict = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want
    assert len({p["sequence_id"] for p in pieces}) == -(-sum(want.values()) // 4096)


def test_empty_table(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_row_with_null_and_repeated_ids(spark, corpus):
    folder, rows, _ = corpus
    clean = [r[1] for r in rows if r[0] in range(1, 60) and r[0] % 6]
    bad = [r[1] for r in rows if r[0] in range(0, 60, 6)]
    near = clean[0].rsplit(" ", 1)[0] + " ended"
    made = [
        # Null ids: three clean texts, a toxic one, a copy in other white space, a near copy.
        *((None, t) for t in (clean[0], clean[1], clean[2], bad[0], " " + clean[0].replace(" ", "\n", 3), near)),
        # One id over clean, toxic, copied and near texts, one of them a full copy.
        *((7, t) for t in (clean[3], clean[4], bad[1], "  " + clean[3], clean[4] + " ended", clean[3])),
        # An id of two rows, one of which is the copy of another id's text.
        (8, clean[5]), (8, clean[6]), (3, clean[6] + " "),
    ]
    # Rows to learn from.
    rest = [r for r in rows if r[0] in range(60, 240)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in made] + rest, COLUMNS)
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:3]:
        # A table that is no plain scan of files is taken as well as a written one.
        kept = stage(spark, kept if name == "toxicity" else corpus_pipeline.stage_table(kept, name), folder)
        assert kept.columns == frame.columns
        got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.where("doc_id IS NULL OR doc_id < 60").collect())
        if name == "toxicity":
            assert got == sorted((i or 0, t) for i, t in made if t not in bad)
        if name == "exact_dedup":
            assert len(got) == 9
            assert len({"".join(t.split()) for _, t in got}) == 9
    texts = ["".join(t.split()) for _, t in got]
    assert len(got) == 7
    for t in clean[:7]:
        assert sum(x.startswith("".join(t.rsplit(" ", 1)[0].split())) for x in texts) == 1
    assert sum(i == 0 for i, _ in got) == 3


def test_stages_take_columns_named_like_their_key(spark, corpus):
    folder, rows, _ = corpus
    frame = spark.createDataFrame(rows[:40], COLUMNS).withColumns(
        {ROW: F.col("doc_id"), ROW + "_": F.lit("kept"), "n": F.lit(1), "kept": F.lit(2), "keep_id": F.lit(3)}
    )
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        kept = stage(spark, frame, folder)
        assert set(kept.columns) == set(frame.columns)
        assert all(r[ROW] == r["doc_id"] and r[ROW + "_"] == "kept" for r in kept.collect())


def test_every_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]
