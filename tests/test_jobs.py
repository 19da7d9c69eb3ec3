"""Files, hooks, retrieval, plans and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.operators import models, retrieval
from reportloom.plans import hydrate as hy, knowledge, questions
from reportloom.schemas import CONTENT_ITEM_FIELDS, NAME_EVIDENCE, OBSERVATIONS, PATIENTS, REPORTS
from reportloom.session import spread, workspace
from reportloom.sources import files
from reportloom.streaming import jobs as st


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "P1_LFT_20240101_grid.pdf").write_bytes(b"one")
    (tmp_path / "P2_CBC_20240102_grid.PDF").write_bytes(b"two")
    (tmp_path / "P1_LFT_20240101_grid.md").write_bytes("Patient: LEE, ANN\r\nIron 5 mg é\n".encode() + b"\xff")
    (tmp_path / "note.json").write_text("Name: x")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.docx").write_bytes(b"x")
    (tmp_path / "sub" / "bad.exe").write_bytes(b"x")
    return str(tmp_path)


def test_scans(spark, folder):
    assert sorted((r.name, r.size_bytes) for r in files.scan_report_files(spark, folder).collect()) == [
        ("P1_LFT_20240101_grid.pdf", 3), ("P2_CBC_20240102_grid.PDF", 3),
    ]
    hashed = {r.name: r.sha256 for r in files.hash_report_files(spark, folder).collect()}
    assert hashed["P1_LFT_20240101_grid.pdf"] == hashlib.sha256(b"one").hexdigest()
    texts = {r.report_id: r.text for r in files.scan_parsed_text(spark, folder).collect()}
    assert texts == {"P1_LFT_20240101_grid": "Patient: LEE, ANN\r\nIron 5 mg é\n", "note": "Name: x"}


def test_metadata_scan_reads_no_content(spark, folder):
    plan = files.scan_report_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_supported_files(spark, folder):
    def kept(recursive):
        rows = files.filter_supported_files(files.list_files(spark, [folder], recursive)).where("reject_reason IS NULL")
        return sorted(r.path.rsplit("/", 1)[1] for r in rows.collect())

    assert "deep.docx" in kept(True) and "bad.exe" not in kept(True)
    assert "deep.docx" not in kept(False) and "empty.txt" in kept(False)
    gone = files.filter_supported_files(files.list_files(spark, [folder + "/no.pdf", folder + "/note.json"]))
    assert sorted(r.reject_reason for r in gone.collect()) == ["path does not exist", "unsupported file type"]


def test_encodings(spark):
    rows = [("a", "é€".encode()), ("b", "中文".encode("gbk")), ("c", b"\xff\x80abc"), ("d", b""), ("e", None)]
    got = {r.k: (r.text, r.encoding_used) for r in files.decode_with_fallback(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert got["a"] == ("é€", "utf-8") and got["b"] == ("中文", "gbk") and got["d"] == ("", "utf-8")
    assert got["c"] == (b"\xff\x80abc".decode("latin-1"), "latin-1") and got["e"][0] is None


def test_content_list_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"type": "text", "text": "x", "page_idx": 2}, {"type": "image", "image_caption": ["c"]}], indent=1))
    got = files.read_content_list(spark, str(tmp_path)).first().items
    assert [(i.type, i.text, i.page_idx, i.image_caption) for i in got] == [("text", "x", 2, None), ("image", None, None, ["c"])]


def test_output_paths(spark):
    rows = spark.createDataFrame([("/in/a/b.c.pdf",), ("/in/x.md",), ("/else/y.md",)], "p string")
    got = [r.o for r in rows.select(files.output_path(F.col("p"), "/in", "/out").alias("o")).collect()]
    assert got == ["/out/a/b.c", "/out/x", "/out/y"]


def test_parser_failures_are_rows(spark):
    def make():
        seen = {}

        def parse(path, content):
            seen[path] = seen.get(path, 0) + 1
            if path == "bad" or (path == "flaky" and seen[path] == 1):
                raise ValueError("x" * 500)
            return [{"type": "text", "text": bytes(content).decode()}] if content else []

        return parse

    rows = spark.createDataFrame([("good", b"hi"), ("bad", b""), ("flaky", b"yo"), ("empty", b"")], "path string, content binary")
    got = {r.path: r for r in models.parse_files(rows, make, wait_seconds=0).collect()}
    assert got["good"].ok and got["good"].items[0].text == "hi" and got["good"].attempts == 1
    assert not got["bad"].ok and got["bad"].error == "x" * 500 and got["bad"].attempts == 2
    assert got["flaky"].ok and got["flaky"].attempts == 2 and got["empty"].n_blocks == 0


def test_wrong_vector_size_fails(spark):
    with pytest.raises(Exception, match="embedding function"):
        models.embed_texts(spark.createDataFrame([("a",)], "text string"), lambda: lambda t: [[1.0]], 2).collect()


def test_model_sees_distinct_misses_only(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        def model(prompt, **_):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            return prompt.upper()

        return model

    asked = spark.createDataFrame([(i, "m", p) for i, p in enumerate(["a", "b", "a", "c", "a"])], "i int, model string, prompt string")
    cache = models.with_call_key(asked.where("prompt = 'b'")).select("call_key", F.lit("known").alias("answer"))
    got = {r.i: (r.answer, r.from_cache) for r in models.cached_model_calls(asked, cache, make).collect()}
    assert got == {0: ("A", False), 1: ("known", True), 2: ("A", False), 3: ("C", False), 4: ("A", False)}
    assert sorted(open(log).read().split()) == ["a", "c"]


def test_top_k_like_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[200:] = base[0]  # a third of all vectors are copies
    base[5] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id bigint, embedding array<float>").repartition(7)
    queries = vectors.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    unit = base.astype(float) / np.maximum(np.linalg.norm(base.astype(float), axis=1, keepdims=True), 1e-30)
    for blocks in (1, 5):
        got = {}
        for r in retrieval.vector_top_k(vectors, queries, 30, 0.2, blocks=blocks).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        for q in range(20):
            scores = np.round(unit @ unit[q], 6)
            want = sorted((-s, i) for i, s in enumerate(scores) if s >= 0.2)[:30]
            assert [got.get(q, {})[k + 1][0] for k in range(len(want))] == [i for _, i in want]
            assert len(got.get(q, {})) == len(want)
    assert retrieval.vector_top_k(vectors, queries.where("false")).count() == 0


def test_graph_limit_and_order(spark):
    edges = spark.createDataFrame([("s", "b"), ("s", "b"), ("a", "s"), ("c", "s"), ("x", "y"), ("s", "s")], "src string, dst string")
    seeds = spark.createDataFrame([("s",)], "id string")
    assert [(r.node, r.hop) for r in retrieval.graph_neighbourhood(edges, seeds, 3).collect()] == [("s", 0), ("b", 1), ("a", 1)]


def empty_store(spark):
    return hy.Store(*[spark.createDataFrame([], s) for s in (PATIENTS, REPORTS, NAME_EVIDENCE, OBSERVATIONS)])


def test_hydration_twice_gives_the_same(spark, folder):
    docs = files.scan_parsed_text(spark, folder)
    once, index = hy.hydrate(docs, empty_store(spark))
    twice, _ = hy.hydrate(docs, once)
    staged, _ = hy.hydrate(docs, empty_store(spark), stage=workspace(spark, "stage"))
    for state in (once, twice, staged):
        assert [(r.patient_id, r.full_name) for r in state.patients.collect()] == [("P1", "Ann Lee")]
        assert [(r.report_id, str(r.report_date)) for r in state.reports.collect()] == [("P1_LFT_20240101_grid", "2024-01-01")]
        assert state.name_evidence.count() == 1
        assert [(r.analyte, r.value, r.unit) for r in state.observations.collect()] == [("Iron", "5", "mg")]
    assert [tuple(r) for r in index.collect()] == [("P1", "Ann Lee")]


def test_bootstrap(spark, folder):
    known = spark.createDataFrame([], "sha256 string, report_id string, patient_id string, src_path string, mtime bigint, size_bytes bigint")
    store, tracked = hy.bootstrap(files.hash_report_files(spark, folder), empty_store(spark), known)
    assert sorted((r.patient_id, str(r.first_seen)) for r in store.patients.collect()) == [("P1", "2024-01-01"), ("P2", "2024-01-02")]
    again = hy.bootstrap(files.hash_report_files(spark, folder), store, tracked)[1]
    assert tracked.count() == again.count() == 2


def test_described_items(spark):
    fields = [f.split()[0] for f in CONTENT_ITEM_FIELDS.split(", ")]

    def row(pos, **f):
        return (1, pos, *[f.get(c) for c in fields])

    items = spark.createDataFrame(
        [row(0, type="text", text="before", page_idx=0), row(1, type="table", table_body="a|b", page_idx=0), row(2, type="image", img_path="i.png", image_caption=["cap"], page_idx=9)],
        f"doc_id bigint, pos int, {CONTENT_ITEM_FIELDS}",
    )

    def make():
        def model(prompt, **_):
            if "i.png" in prompt:
                return "plain words"
            assert "before" in prompt and "a|b" in prompt
            return json.dumps({"detailed_description": "D", "entity_info": {"entity_name": "N", "entity_type": "table", "summary": "S"}})

        return model

    got = {r.pos: r for r in knowledge.describe_items(items, make).collect()}
    assert (got[1].entity_name, got[1].description, got[1].summary) == ("N", "D", "S")
    assert got[1].chunk == "Table Analysis:\nImage Path: \nCaption: None\nStructure: a|b\nFootnotes: None\n\nAnalysis: D"
    assert (got[2].entity_name, got[2].description) == ("image 2", "plain words")
    only = knowledge.describe_items(items, make, enabled={"image": False}).collect()
    assert [r.pos for r in only] == [1]


def test_question_to_report(spark):
    people = spark.createDataFrame([("P1", "Mary Moore"), ("P2", "Ann Lee")], "patient_id string, full_name string")
    ddl = "patient_id string, report_id string, test_type string, report_date date"
    texts = spark.createDataFrame([("P1", "a", "LFT", dt.date(2024, 1, 1), "old"), ("P1", "b", "CBC", dt.date(2025, 1, 1), "new text")], ddl + ", text string")
    pdfs = spark.createDataFrame([("P2", "c", "LFT", dt.date(2024, 1, 1)), ("P1", "d", "LFT", dt.date(2025, 6, 1))], ddl)
    asked = spark.createDataFrame(
        [(1, "moore, mary", None, "q1"), (2, "Mary Moore", "LFT", "q2"), (3, "Ann Leo", None, "q3"), (4, "nobody here", None, "q4")],
        "question_id int, mention string, test_type string, question string",
    )
    chosen = questions.report_for_question(asked, people, texts, pdfs)
    assert {r.question_id: (r.report_id, r.report_text) for r in chosen.collect()} == {1: ("b", "new text"), 2: ("a", "old"), 3: ("c", None)}
    answers = questions.answer_from_reports(chosen, asked, lambda: lambda p, **_: p)
    assert {r.question_id: r.answer for r in answers.collect()} == {1: "q1\n\nnew text", 2: "q2\n\nold", 3: "q3"}


def test_workspace_follows_the_setting(spark):
    assert workspace(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8


# ---- streams -------------------------------------------------------------------------


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_daily_cost_stream_over_several_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    ddl = "timestamp timestamp, total_tokens int, total_cost decimal(10,6)"
    src = str(tmp_path / "in")
    from decimal import Decimal

    for part in range(4):
        rows = [(base + dt.timedelta(hours=7 * part + h), 10, Decimal("0.5")) for h in range(7)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    run(st.stream_daily_costs(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="3 days"))
    got = sorted((str(r.date), r.requests, r.tokens, r.cost_usd) for r in st.current_daily_costs(spark, str(tmp_path / "out")).collect())
    assert got == [("2024-01-01", 24, 240, 12.0), ("2024-01-02", 4, 40, 2.0)]
