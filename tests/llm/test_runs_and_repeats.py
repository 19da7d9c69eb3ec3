from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.llm import periods, repeats
from reportloom.llm.manifest import audit_documents, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- manifest ------------------------------------------------------------------------


def _framed(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(doc_id, text, lang, source, n_chars) -> str:
    return _h("".join(map(_framed, (doc_id, source, lang, n_chars, text))))


def _levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def _path(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        run = level[start : start + 8]
        yield "".join(run[: i - start]), "".join(run[i - start + 1 :])
        i //= 8


def _plain_manifest(rows):
    """doc rows -> the rows of the audit, as a sorted list."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs: dict = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r))):
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [_levels([_leaf(*r) for r in langs[x]]) for x in order]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for t, lang in enumerate(order):
        for i, row in enumerate(langs[lang]):
            path = [*_path(trees[t], i), *_path(top, t)]
            doc_id, text = row[0], row[1]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = text.translate(lower)
            folded = _leaf(doc_id, text, *row[2:])
            for a, b in path:
                folded = _h(a + folded + b)
            root = top[-1][0]
            out.append((doc_id, _leaf(*row), trees[t][-1][0], root, _h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def _audited(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("x")).withColumn("_at", F.lit(1))
    return sorted((tuple(r) for r in audit_documents(docs.repartition(5)).collect()), key=repr)


@pytest.mark.parametrize("n", [9, 600])
def test_manifest_equals_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(i * 7, f"Text {rnd.random()} Ä", rnd.choice(["en", "de"]), f"s{i % 5}", i) for i in range(n)]
    assert _audited(spark, rows) == _plain_manifest(rows)


def test_manifest_with_nulls_ties_and_many_keys(spark):
    rows = [(None, "A", None, None, None), (None, "B", None, "s", 1), (3, None, "", "s", None), (3, "", "", "s", 0)]
    rows += [(4, "same", "en", "s", 4)] * 11  # one doc_id, equal rows
    rows += [(i, "x" * 200_000 if i == 50 else "Ab", f"k{i % 70}", "s", i) for i in range(40, 200)]
    rows += [(9, "Q", "é", "s", 1), (9, "Q", "z", "s", 1), (9, "Q", "\U0001f600", "s", 1), (9, "Q", "￮", "s", 1)]
    assert _audited(spark, rows) == _plain_manifest(rows)
    assert _audited(spark, []) == []


def test_manifest_of_other_keys_and_fanout(spark):
    leaves = spark.range(50).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = merkle_manifest(leaves, "k", "i", fanout=2).collect()
    level = [_h(str(i)) for i in range(50)]
    while len(level) > 1:
        level = [_h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    assert {r["root"] for r in got} == {level[0]} == {r["subroot"] for r in got}
    assert len(got) == 50 and {len(r["path"]) for r in got} == {6}


# ---- periodic runs -------------------------------------------------------------------


def _plain_runs(words):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        j = 0
        while j + q < len(words):
            start = j
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - start + q
            if length >= max(24, 3 * q):
                best.setdefault((start, length), q)
            j += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def _plain_digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = _plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, milli, _h(listed), _h(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _periodic_texts():
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "one", " ".join(["a"] * 23), " ".join(["a"] * 24), "a\x0bb " * 12, "a\x1cb\xa0c " * 30]
    for n in (30, 100, 700):
        for letters in ("ab", "abc", "abcdefghij"):
            texts.append(" ".join(rnd.choice(letters) for _ in range(n)))
    for _ in range(60):
        n = rnd.randrange(20, 900)
        words = [f"w{rnd.randrange(2000)}" for _ in range(n)]
        for _ in range(rnd.randrange(1, 4)):  # runs beside, inside and across one another
            a, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 6))
            for i in range(a + p, min(n, a + rnd.randrange(2, 7) * p + rnd.randrange(30))):
                words[i] = words[i - p]
        texts.append("  ".join(words))
    fib = ["x", "x y"]
    while len(fib[-1].split()) < 1500:
        fib.append(f"{fib[-1]} {fib[-2]}")
    return [*texts, fib[-1], " ".join(["a b a b c"] * 300), "w " * 5000]


def test_runs_equal_brute_force(spark):
    texts = _periodic_texts()
    texts = [t for t in texts if t is None or len(t.split()) <= 2000]
    rows = [(i // 2 if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(0)).withColumn("n", F.lit("x"))
    got = sorted((tuple(r) for r in periods.run_digests(docs).collect()), key=repr)
    assert got == sorted((_plain_digests(*r) for r in rows), key=repr)
    texts_out = {(r["doc_id"], _h(r["collapsed"])) for r in periods.collapse_documents(docs).collect()}
    assert texts_out == {(r[0], r[-1]) for r in got}


def test_runs_of_long_text_and_empty_table(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(40_000)]
    text = " ".join(base + base[-9000:] * 3 + base[:50])
    r = periods.run_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 31_000, 36_000, 9000, 4000)
    all_one = periods.run_digests(spark.createDataFrame([(1, "w " * 50_000)], "doc_id long, text string")).first()
    assert tuple(all_one)[1:6] == (1, 0, 50_000, 1, 50_000_000)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.run_digests(empty).count() == 0 == periods.collapse_documents(empty).count()


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (10**12, None), (10**12 + 1, "")]
    got = {r["doc_id"]: r["text"] for r in periods.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            changed += 1
        assert got[doc_id] == text
    assert changed > 10


# ---- repeats -------------------------------------------------------------------------


def _plain_repeats(rows, threshold):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + threshold] for _, b in data for i in range(len(b) - threshold + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if seen[b[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def _repeating_rows(threshold):
    rnd = random.Random(threshold)

    def noise(n):
        return "".join(rnd.choice("abcdefgh éß\U0001f600") for _ in range(n))

    passages = [noise(rnd.randrange(threshold // 4, 4 * threshold)) for _ in range(12)]
    rows = [(None, None), (None, ""), (1, noise(threshold - 1)), (1, "a" * (threshold + 30)), (2, "ab" * threshold)]
    for i in range(80):
        text = noise(rnd.randrange(3 * threshold))
        for _ in range(rnd.randrange(3)):
            text += rnd.choice(passages)[rnd.randrange(9) :] + noise(rnd.randrange(threshold))
        rows.append((i // 2, text))
    rows += [(500, rows[40][1]), (500, rows[40][1]), (501, rows[50][1] + "x" + rows[50][1]), (502, passages[0][:-1])]
    return rows


@pytest.mark.parametrize("threshold", [32, 50, 100, 400])
def test_repeats_equal_brute_force(spark, threshold):
    rows = _repeating_rows(threshold)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row_key", F.lit(1)).withColumn("at", F.lit(2))
    got = sorted((tuple(r) for r in repeats.repeat_digests(docs.repartition(6), threshold).collect()), key=repr)
    assert got == _plain_repeats(rows, threshold)


def test_a_hot_passage_in_most_rows(spark):
    """One passage in two thirds of all rows, over more partitions than its sort keys have values."""
    rnd = random.Random(1)
    passage = "".join(rnd.choice("klmnop ") for _ in range(130))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(60)) + (passage if i % 3 else "")) for i in range(240)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = repeats.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted((tuple(r) for r in got), key=repr) == _plain_repeats(rows, 64)


def test_repeats_of_long_texts_and_empty_table(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(97, 123, 1_300_000, dtype=np.uint8).tobytes().decode()
    rows = [(1, base), (2, "x" * 700 + base[600_000:601_000] + "y" * 10), (3, "z" * 500)]
    got = {r["doc_id"]: tuple(r)[1:4] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1_300_000, 1000, 1), 2: (1710, 1700, 1), 3: (500, 500, 1)}
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 31)
