"""Context windows, chunks, prompts and chat, against plain Python on small data."""

from __future__ import annotations

import datetime as dt
import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reportloom.functions import content as ct, templates as tm
from reportloom.operators import chat, content
from reportloom.schemas import CONTENT_ITEM_FIELDS

ITEM = [f.split()[0] for f in CONTENT_ITEM_FIELDS.split(", ")]


def items(spark, rows):
    """rows: (doc_id, pos, {fields})"""
    data = [(d, p, *[f.get(c) for c in ITEM]) for d, p, f in rows]
    return spark.createDataFrame(data, f"doc_id bigint, pos int, {CONTENT_ITEM_FIELDS}")


def cut(text, n):
    words = text.split()
    if len(words) <= n:
        return text
    end = 0
    for w in words[:n]:
        end = text.index(w, end) + len(w)
    head = text[:end]
    if "." in head:
        return head[: head.rindex(".") + 1] + "..."
    if "\n" in head:
        return head[: head.rindex("\n")].strip() + "..."
    return head + "..."


def test_truncation(spark):
    rows = ["one two", "a b. c d e f", "a b\nc d e", "a b c d e", "  a b c d"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(ct.truncate_to_words(F.col("t"), 3).alias("v"))
    assert [r.v for r in got.collect()] == [
        "one two", "a b....", "a b...", "a b c...", "a b c...",
    ]


def shown(f):
    kind = f.get("type") or "text"
    if kind == "text":
        text = ("#" * f["text_level"] + " " if f.get("text_level") else "") + f["text"]
    elif kind == "image" and f.get("image_caption"):
        text = "[Image: " + ", ".join(f["image_caption"]) + "]"
    else:
        return None
    return text.strip() or None


def test_contexts_like_brute_force(spark):
    rng = random.Random(7)
    rows = []
    # Document 0 has a page with far more items than one block of the running totals.
    for doc, n in ((0, 2600), (1, 40), (2, 9)):
        for pos in range(n):
            kind = rng.choice(["text", "text", None, "image", "table"]) if pos % 50 else "image"
            f = {"type": kind, "page_idx": 1 if doc == 0 and pos > 3 else pos // 6}
            if kind in (None, "text"):
                f["text"] = rng.choice(["", " ", "alpha beta", "gamma.", "one two three four"])
                f["text_level"] = rng.choice([None, 1, 2])
            elif kind == "image":
                f["image_caption"] = rng.choice([None, ["fig a", "b"], ["c " * 40]])
            rows.append((doc, pos, f))
    df = items(spark, rows)
    for types in (("text",), ("text", "image")):
        for mode, window, limit in (("page", 1, 12), ("chunk", 3, 9), ("page", 0, 30)):
            run = content.page_context if mode == "page" else content.chunk_context
            got = {(r.doc_id, r.pos): r.context for r in run(df, window, limit, types).collect()}
            targets = [(d, p, f) for d, p, f in rows if (f.get("type") or "text") != "text"]
            assert len(got) == len(targets)
            src = {}
            for d, p, f in rows:
                if (f.get("type") or "text") in types and shown(f):
                    src.setdefault(d, []).append((f["page_idx"], p, shown(f)))
            for d, p, f in targets:
                near = sorted(
                    (pg, q, s) for pg, q, s in src.get(d, []) if q != p
                    and (abs(pg - f["page_idx"]) <= window if mode == "page" else abs(q - p) <= window)
                )
                assert got[(d, p)] == cut("\n".join(s for _, _, s in near), limit), (d, p, types, mode)


def test_page_context_with_totals_on_the_limit(spark):
    rows = [
        (0, 0, {"type": "image", "page_idx": 0, "image_caption": ["one two"]}),
        (0, 1, {"type": "text", "page_idx": 0, "text": "x y z"}),
        (0, 2, {"type": "text", "page_idx": 0, "text": "w"}),
    ]
    got = content.page_context(items(spark, rows), 1, 3, ("text", "image")).collect()
    assert [r.context for r in got] == ["x y z..."]
    whole = content.page_context(items(spark, rows[:2]), 1, 3, ("text", "image")).collect()
    assert [r.context for r in whole] == ["x y z"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|", max_size=60), min_size=1, max_size=10), st.integers(1, 6), st.integers(0, 5))
def test_chunks_like_python(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)

    def split(piece):
        words = piece.split()
        if not words:
            return []
        if len(words) <= size:
            return [piece.strip()]
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", ct.chunk_text(F.col("t"), "|", size=size, overlap=overlap).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [[c for piece in t.split("|") for c in split(piece)] for t in texts]
    only = df.select("i", ct.chunk_text(F.col("t"), "|", split_only=True).alias("c")).orderBy("i").collect()
    assert [r.c for r in only] == [[p.strip() for p in t.split("|") if p.strip()] for t in texts]


def test_separate_and_route(spark):
    rows = items(spark, [(1, 0, {"type": "text", "text": "a"}), (1, 1, {"type": "text", "text": " "}), (1, 2, {"type": "table"}), (1, 3, {"text": "b"})])
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *ITEM))).alias("items"))
    got = content.separate_content(lists).first()
    assert got.text_content == "a\n\nb" and [m.type for m in got.multimodal] == ["table"]
    kinds = spark.createDataFrame([("chart",), ("table",), ("image",)], "t string")
    assert [r.p for r in kinds.select(ct.route_content(F.col("t"), table=False).alias("p")).collect()] == ["generic", None, "image"]
    assert {r.type: r.n_items for r in content.content_type_distribution(rows, False).collect()} == {"text": 2, "table": 1, "unknown": 1}


def test_template_fields_are_not_read_twice(spark):
    got = spark.range(1).select(tm.fill("<{a}|{b}|{\"x\": 1}>", {"a": F.lit("{b}"), "b": F.lit(None)}).alias("t")).first()
    assert got.t == "<{b}||{\"x\": 1}>"


def test_markdown_has_no_table_without_values(spark):
    rows = spark.createDataFrame([('{"patient_name":"A","analytes":[]}',)], "j string")
    got = rows.select(ct.format_report_markdown(ct.parse_entities_json(F.col("j"), "2025-01-01"), F.lit("raw")).alias("t")).first().t
    assert got.endswith("## Test Results\n\n## Original Report Content\n\nraw") and "**Patient ID:** Not specified  \n" in got


def test_payload_round_trip(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", f'say "{i}"', f"2024-01-01T00:00:{i:02}") for i in range(30)]
    msgs = spark.createDataFrame(rows, "session_id string, turn int, role string, content string, created_at string")
    payload = chat.context_payload(msgs, ["turn"])
    assert [m["content"] for m in json.loads(payload.first().payload)] == [f'say "{i}"' for i in range(10, 30)]
    back = chat.parse_context_payload(payload).orderBy("pos").collect()
    assert [(r.pos, r.content) for r in back][:2] == [(0, 'say "10"'), (1, 'say "11"')]


def test_history_text(spark):
    msgs = spark.createDataFrame(
        [("s", 0, "user", "How many?"), ("s", 1, "assistant", "Ten.")], "session_id string, turn int, role string, content string"
    )
    asked = spark.createDataFrame([("s", "in 2025?", "doc"), ("t", "alone", None)], "session_id string, question string, document string")
    got = {r.session_id: r.prompt for r in chat.render_history(asked, msgs, ["turn"]).collect()}
    assert got == {
        "s": "[Previous conversation]\nAssistant: Ten.\nUser: How many?\n\n\n[Current Question]\nin 2025?\n\n[Document Context]\ndoc",
        "t": "alone",
    }


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40000)), min_size=1, max_size=25),
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40000)), min_size=1, max_size=25, unique=True),
)
def test_attached_documents_like_brute_force(spark, asked, stored):
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    msgs = spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(asked)], "k string, ts timestamp, i int")
    ups = spark.createDataFrame([(k, at(s), f"d{j}") for j, (k, s) in enumerate(stored)], "k string, ts timestamp, doc string")
    got = {r.i: r.doc for r in chat.attach_uploaded_doc(msgs, ups, ["k"]).collect()}
    assert len(got) == len(asked)
    for i, (k, s) in enumerate(asked):
        alive = [(t, f"d{j}") for j, (kk, t) in enumerate(stored) if kk == k and t <= s < t + 3600]
        # Only the latest upload counts, and it is alive if any is.
        assert got[i] == (max(alive)[1] if alive else None)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60000), min_size=1, max_size=40))
def test_activity_like_brute_force(spark, seconds):
    base = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("u", base + dt.timedelta(seconds=s)) for s in seconds], "u string, ts timestamp")
    want, times = [], sorted(seconds)
    for s in times:
        if want and s < want[-1][1] + 3600:
            want[-1] = (want[-1][0], s, want[-1][2] + 1)
        else:
            want.append((s, s, 1))
    got = chat.session_activity(rows, "u").orderBy("session_start").collect()
    assert [((r.session_start - base).seconds, (r.session_end - base).total_seconds() - 3600, r.n_writes) for r in got] == [
        (a, float(b), n) for a, b, n in want
    ]
