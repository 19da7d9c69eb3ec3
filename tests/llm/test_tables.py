from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportloom.llm import boost, embed
from reportloom.llm.common import ROW, components, stage_table, with_rank, with_row_key
from reportloom.llm.embed import near_vectors
from reportloom.llm.quality import quality
from reportloom.llm.shards import _levels_of, hilbert_index, shard_documents, text_levels, write_shards
from reportloom.llm.toxicity import lexicon, term_counts, toxicity, training_rows
from reportloom.llm.warc import (
    LEAF_BYTES,
    archive_index,
    differing_leaves,
    fixity_audit,
    merkle_levels,
    parents,
    read_warc,
    read_warc_files,
    write_warc,
    write_warc_files,
)


def _parts(n, edges):
    label = list(range(n))
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_components_equal_brute_force(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(70 + i, 71 + i) for i in range(25)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    want = _parts(100, edges)
    assert got == {n: want[n] for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_is_gapless_with_ties(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "k int, i int").repartition(7)
    got = sorted((r["_rank"], r["k"]) for r in with_rank(rows, "k").collect())
    assert [r for r, _ in got] == list(range(500))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_near_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 12))
    x = np.concatenate([base + rnd.normal(size=base.shape) * s for s in (0, 0.1, 0.3, 0.5)] + [base[:1]] * 50)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, "x"), (n + 1, [0.0] * 12, "x"), (n + 2, [1.0] + [float("nan")] * 11, "x"), (n + 3, [None] * 12, "x")]
    rows += [(n + 4, [], "x"), (n + 5, [1.0, 2.0], "x"), (n + 6, [2.0, 4.0], "x"), (None, x[0].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    y = np.concatenate([x, x[:1]])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = _parts(n + 1, [(i, j) for i in range(n + 1) for j in range(i) if near[i, j]])
    got = near_vectors(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        i = n if r["vec_id"] is None else r["vec_id"]
        if r["vec_id"] is None or i < n:
            assert r["n_links"] == near[i].sum() - 1
            assert r["component_id"] == want[i]
            assert r["kept"] == (r["vec_id"] == want[i])
        elif i in (n + 5, n + 6):
            assert (r["n_links"], r["component_id"]) == (1, n + 5)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_of_many_blocks_move_no_copies(spark, monkeypatch, kind):
    """Blocks meet in tasks that read both from their files: no vector is shuffled or written for each block it meets."""
    staged = {}

    def keep(df, name):
        staged.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return stage_table(df, name)

    for name, value in (("stage_table", keep), ("BLOCK", 30), ("TILE", 8), ("FILE_BLOCKS", 2)):
        monkeypatch.setattr(embed, name, value, raising=False)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(150, 10))
    x = np.concatenate([base, base + rnd.normal(size=base.shape) * 0.15, base[:40]]).astype("f4" if kind == "float" else "f8")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(len(x), [3.0, 4.0]), (len(x) + 1, [6.0, 8.0])]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = _parts(len(x), [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == [(near[i].sum() - 1, want[i]) for i in range(len(x))]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (len(x), len(x) + 1)] == [(1, len(x))] * 2
    assert "Exchange" not in staged["found"]


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = hilbert_index(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(at)]
        assert (np.abs(np.diff(walk.astype(int), axis=0)).sum(1) == 1).all()


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")


def test_shards_are_equal_runs(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "é" * rnd.randrange(50), rnd.choice(["en", "de", None]), f"s{rnd.randrange(4)}", 0, "x") for i in range(331)]
    rows += [(None, None, None, None, None, None), (5, "dup", "en", "s0", 3, "x"), (5, "dup", "en", "s0", 3, "x")]
    placed = shard_documents(_documents(spark, rows)).collect()
    assert len(placed) == len(rows)
    by: dict = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    sizes = {r["doc_id"]: r["size"] for r in placed}
    assert sizes[None] == 8 and sizes[0] == len(rows[0][1].encode()) + 8
    assert shard_documents(_documents(spark, [])).count() == 0
    unique = _documents(spark, rows[:100]).drop("shard")
    write_shards(unique, shard_documents(unique), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_whole_sources_make_levels(spark, tmp_path):
    rnd = random.Random(5)
    long = "https://" + "x" * 5000
    names = [f"https://site{i}.org/é" for i in range(5)] + [long + "a", long + "b", "", None]
    held = [rnd.choices(names, [9, 3, 3, 3, 3, 2, 2, 1, 1])[0] for _ in range(2000)]
    rows = spark.createDataFrame([(s,) for s in held], "s string").repartition(5)
    starts = text_levels(rows, "s", 64, len(held))
    ordered = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    want = {s: ordered.index(s) * 64 // len(held) for s in names}
    got = dict(zip(names, _levels_of(pd.Series(names), starts), strict=True))
    assert got == want and got[None] == 0 and len(set(got.values())) >= 8
    assert text_levels(rows.where("false"), "s", 64, 0) == []
    assert _levels_of(pd.Series([None, "a"]), []).tolist() == [0, 0]

    # Placing the whole table plainly, by the same levels and curve, gives the same shards.
    docs = [(i, "t" * (i % 7), None, s, 0, "x") for i, s in enumerate(held)] + [(None, "n", "en", None, 0, "x"), (3, "r", "en", "", 0, "x")]
    frame = with_row_key(_documents(spark, docs))
    placed = shard_documents(frame, 8, by_row=True)
    ranked = sorted(placed.collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["shard"] for r in ranked] == [i * 8 // len(docs) for i in range(len(docs))]
    by_source: dict = {}
    for r in ranked:
        if r["doc_id"] is not None and r["text_crc32"] != zlib.crc32(b"r"):
            by_source.setdefault(held[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) < 8 for s in by_source.values())
    write_shards(frame, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(docs) and back.where("doc_id IS NULL").count() == 1
    assert ROW not in back.columns and back.where("doc_id = 3").count() == 2


def test_one_training_row_per_labelled_id_and_no_cap_on_terms(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i}") for i in range(400)] + [(i, f"again {i}") for i in range(400)] * 4 + [(1, None), (None, "n")],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 100).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 100
    assert all(r["text"] == f"text {r['doc_id']}" for r in rows)

    # Every term that the rule takes is found, however many there are.
    def word(n):
        return "q" + "".join(chr(97 + int(d)) for d in f"{n:06d}")

    bad = " ".join(word(i) for i in range(30_000))
    made = spark.createDataFrame([(bad, 1, i % 2) for i in range(40)] + [("plain words", 0, i % 2) for i in range(40)], "text string, y int, half int")
    sums = {0: 20, 1: 20}
    terms = term_counts(made, sums, sums)
    words = {r["term"] for r in terms if r["term"].startswith("w:")}
    assert words == {"w:" + word(i) for i in range(30_000)}
    for halves in ((0,), (1,), (0, 1)):
        got = lexicon(terms, sums, sums, halves)
        n = 20 * len(halves)
        taken = (n - n * 0.5) / (n * 0.25) ** 0.5 > 5
        assert (("w:" + word(7)) in got) == taken


def test_audit_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://h/{i % 7}", "<p>" + "x" * (i * 13 % 200)) for i in range(900)] + [(None, None, None), (3, "http://h/3", None), (3, "http://h/3", None)],
        "page_id long, url string, html string",
    )
    index = archive_index(pages, 64)
    assert index.count() == 903
    assert fixity_audit(index, index).where("status <> 'ok'").count() == 0
    hurt = pages.withColumn("html", F.when(F.col("page_id") % 100 == 7, F.concat(F.lit("#"), F.substring("html", 2, 9999))).otherwise(F.col("html")))
    audit = fixity_audit(index, archive_index(hurt, 64))
    assert audit.count() == 903
    assert {r["page_id"] for r in audit.where("status = 'changed'").collect()} == {7 + 100 * k for k in range(9)}
    short = index.where("NOT (file = 2 AND offset = (SELECT 0)) OR true").join(
        index.groupBy("file").agg(F.max("offset").alias("offset")).where("file = 2"), ["file", "offset"], "left_anti"
    )
    assert [r["status"] for r in fixity_audit(index, short).where("status <> 'ok'").collect()] == ["missing"]
    assert [r["status"] for r in fixity_audit(short, index).where("status <> 'ok'").collect()] == ["added"]
    assert fixity_audit(index.where("false"), index.where("false")).count() == 0
    write_warc(pages, str(tmp_path / "warc"), 64)
    read = {(r["file"], r["offset"], r["length"], r["sha256"]) for r in read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {s for *_, s in read} == {r["sha256"] for r in index.collect()}
    assert len(read) == 903


def test_audit_of_missing_added_longer_and_shorter_records(spark, tmp_path):
    texts = {i: "<p>" + "x" * (i * 13 % 200) for i in range(0, 900, 2)}
    other = {i: t for i, t in texts.items() if i not in (100, 500)} | {301: "new", 777: "new"}
    other[200] += "longer"
    other[600] = other[600][:-2]

    def index(pages):
        rows = [(i, f"http://h/{i % 7}", t) for i, t in pages.items()]
        rows += [(None, "n", "a"), (None, "n", "b" if pages is texts else "c"), (-5, "r", "same")] + [(-5, "r", "same")] * (pages is texts)
        return archive_index(spark.createDataFrame(rows, "page_id long, url string, html string"), 64)

    left, right = index(texts), index(other)
    got = fixity_audit(left, right).collect()
    wrong = [(r["page_id"], r["status"]) for r in got if r["status"] != "ok"]
    assert sorted(wrong, key=str) == sorted(
        [(100, "missing"), (500, "missing"), (301, "added"), (777, "added"), (200, "changed"), (600, "changed"), (None, "changed"), (-5, "missing")], key=str
    )
    assert len(got) == len(texts) + 4 + 2
    want = {(r["page_id"], r["file"], r["offset"], r["sha256"]) for r in left.collect()}
    assert {(r["page_id"], r["file"], r["offset"], r["sha256"]) for r in got if r["status"] != "added"} == want
    assert all((r["sha256"] == r["replica_sha256"]) == (r["status"] == "ok") for r in got)
    # A damaged member is a row, and the others are read.
    folder = str(tmp_path / "warc")
    write_warc(spark.createDataFrame([(i, "u", "y" * 50 + str(i)) for i in range(6)], "page_id long, url string, html string"), folder, 6)
    whole = [r["sha256"] for r in read_warc(spark, folder).orderBy("offset").collect()]
    data = spark.read.parquet(folder).first()["content"]
    third = [i for i in range(len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"][2]
    hurt = bytearray(data)
    hurt[third + 12] ^= 255
    spark.createDataFrame([(0, hurt)], "file long, content binary").write.parquet(f"{folder}-hurt")
    read = [r["sha256"] for r in read_warc(spark, f"{folder}-hurt").collect()]
    assert read == [*whole[:2], None, *whole[3:]]


def test_audit_tells_records_at_other_places(spark):
    rows = [(i, f"http://h/{i}", "x" * (500 + i)) for i in range(600)]
    index = archive_index(spark.createDataFrame(rows, "page_id long, url string, html string"), 64)
    extra = index.withColumn("note", F.lit("a")).withColumn("moved", F.lit(3))
    # Every place is wrong, and no content.
    wrong = index.selectExpr("page_id", "file + 7 AS file", "offset * 3 + 1 AS offset", "length + 2 AS length", "sha256")
    got = fixity_audit(extra, wrong).collect()
    assert len(got) == 600 and all(r["status"] == "ok" and r["moved"] for r in got)
    # Two records that change places are moved, and so is what lies between if lengths differ.
    ids = [r["page_id"] for r in index.where("file = 3").orderBy("offset").collect()]
    swap = {ids[5]: ids[6], ids[6]: ids[5]}
    order = sorted(range(600), key=lambda i: (i // 64, swap.get(i, i)))
    place, laid = {}, []
    length = {r["page_id"]: (r["length"], r["sha256"]) for r in index.collect()}
    for i in order:
        at = place.get(i // 64, 0)
        laid.append((i, i // 64, at, *length[i]))
        place[i // 64] = at + length[i][0]
    swapped = spark.createDataFrame(laid, "page_id long, file long, offset long, length long, sha256 string")
    audit = fixity_audit(index, swapped)
    assert {r["page_id"] for r in audit.where("moved").collect()} == {ids[5], ids[6]}
    assert audit.where("status <> 'ok'").count() == 0 and audit.count() == 600
    # Only the leaves of that place are descended to.
    above = parents(1, 1, 16)
    leaves = differing_leaves(*(merkle_levels(t, above) for t in (index, swapped)), above).collect()
    spots = {(3, r["offset"] // LEAF_BYTES) for r in laid_rows(laid, ids[5:7])}
    assert {(r["file"], r["node"]) for r in leaves} == spots


def laid_rows(laid, ids):
    return [{"offset": at} for i, _, at, *_ in laid if i in ids]


def test_audit_of_odd_indexes(spark):
    kind = "page_id long, file long, offset long, length long, sha256 string"
    far = 1 << 32
    rows = [(1, None, None, None, "a"), (1, None, None, None, "a"), (None, -far, -5, 3, "b"), (2, far, far, far, "c"), (3, 0, 0, 1, None)]
    rows += [(i, 1, 0, 4, f"d{i}") for i in range(300)]
    index = spark.createDataFrame(rows, kind)
    status = [(r["status"], r["moved"]) for r in fixity_audit(index, index).collect()]
    # A record that cannot be read is not fine, although the other replica has no more of it.
    assert len(status) == 305 and set(status) <= {("ok", False), ("changed", False)}
    other = [(1, None, None, None, "a"), (None, -far, -4, 3, "b"), (2, far, far, far, "x"), (3, 0, 0, 1, "e")] + rows[5:-1]
    wrong = fixity_audit(index, spark.createDataFrame(other, kind)).where("status <> 'ok' OR moved").collect()
    got = sorted(((r["page_id"], r["status"], r["moved"]) for r in wrong), key=str)
    assert got == sorted([(1, "missing", False), (None, "ok", True), (2, "changed", False), (3, "changed", False), (299, "missing", False)], key=str)


def test_audit_of_files_that_are_read(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "é" * (i % 50) + str(i)) for i in range(200)]
    rows += [(None, "x\r\nWARC-Record-ID: <urn:page:5>", "n"), (7, "http://h/7", None), (201, "long", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "replica")
    assert write_warc_files(pages, f"file://{folder}", 64) == 4
    index = archive_index(pages, 64)
    read = read_warc_files(spark, f"file://{folder}")
    assert sorted(map(str, read.select("page_id", "sha256").collect())) == sorted(map(str, index.select("page_id", "sha256").collect()))
    assert fixity_audit(read, read_warc_files(spark, f"file://{folder}")).where("status <> 'ok' OR moved").count() == 0
    path = sorted((tmp_path / "replica").glob("*.warc.gz"))[1]
    data = bytearray(path.read_bytes())
    fifth = [i for i in range(len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"][4]
    whole = read.where("file = 1").orderBy("offset").collect()
    data[fifth + 12] ^= 255
    other = tmp_path / "hurt"
    other.mkdir()
    for p in path.parent.glob("*.warc.gz"):
        (other / p.name).write_bytes(bytes(data) if p == path else p.read_bytes())
    wrong = fixity_audit(read, read_warc_files(spark, f"file://{other}"))
    assert [(r["page_id"], r["status"], r["replica_sha256"]) for r in wrong.where("status <> 'ok'").collect()] == [(whole[4]["page_id"], "changed", None)]
    # What follows in that file is whole; it is told as moved since the lost bytes add nothing.
    assert {r["page_id"] for r in wrong.where("moved").collect()} == {r["page_id"] for r in whole[5:]}


def test_boosting_learns_and_sql_agrees(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boost.fit(x[:2000], y[:2000])
    margin = model.margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[2000:2100]], "a double, b double, c double, d double")
    got = [r[0] for r in frame.select(F.expr(model.sql(list("abcd")))).collect()]
    assert np.allclose(got, margin[:100], atol=1e-6)
    sure = boost.isotonic(margin, y[2000:])
    assert (np.diff(sure(np.sort(margin))) >= 0).all()
    assert boost.fit(x[:0], y[:0]).margin(x[:2]).shape == (2,)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abnhtesr") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        body = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        toxic = i % 6 == 0
        good = i % 4 != 0
        if toxic:
            body[rnd.randrange(len(body))] = rnd.choice(["scumbag", "vilelords", "vileling", "vileness"])
        text = " ".join(body)
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", f"s{i % 3}", len(text), "x"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), int(toxic)))
    docs += [(None, None, None, None, None, None), (2000, "", "en", "s0", 0, "x"), (0, docs[0][1], "en", "s0", 0, "x")]
    labels += [(None, 1, 1), (3, None, None), labels[0]]
    return _documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels, rows = labelled
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels, rows = labelled
    got = quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    assert quality(docs.where("false"), labels).count() == 0
    assert {r["doc_score"] for r in quality(docs, labels.where("false")).collect()} == {0.5}
