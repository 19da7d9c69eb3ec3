from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportloom.llm import bpe, packing, pii
from reportloom.llm.exact import exact_groups
from reportloom.llm.minhash import BANDS, bag_items, near_classes, shingles, signatures, word_hashes
from reportloom.llm.queries import VOCAB

SCHEMA = "doc_id long, text string, n_tokens int, score string, KEY string"
ODD = [
    None,
    "",
    "  \n\t ",
    "Aa aaaaaaaaaaaaaaaa hhhh 's It's we'll <|endoftext|>x <|startoftext|> <|ENDOFTEXT|>",
    "ΣΑΣ ΟΔΟΣ İstanbul ² ½ Ⅷ ٣٤ 漢字 é \x1c\x1d\x85 a　b",
    "< / w > </w></w> \U0001f600\U0001f468‍ naïve\x00\x07",
    "x" * 3000 + " " + "ab " * 5000,
]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, 7, "s", "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def made(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abnhtesr") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def test_encoding_equals_library(spark, library):
    rnd = random.Random(5)
    texts = ODD + made(60) + ["".join(chr(rnd.randrange(32, 0x3000)) for _ in range(80)) for _ in range(200)]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for row in bpe.encode_documents(frame(spark, texts), VOCAB).collect():
        assert row["ids"] == ids[row["doc_id"]]
        assert row["decoded"] == library.decode(row["ids"], skip_special_tokens=False)
    for row in bpe.encode_digests(frame(spark, texts), VOCAB).collect():
        want = ids[row["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(frame(spark, []), VOCAB).count() == 0


def test_the_packing_encoder_makes_no_call_per_chunk():
    """op8_pack: chunks of a batch are numbered without a Python call each."""
    encode = packing.PackedIds(VOCAB)
    texts = [" ".join(f"{a}{b}{c}" for b in "abcdefghij" for c in "abcdefghij") for a in "abcdefghij"]
    expected, calls = encode(texts), []
    encode.known.clear()

    def watch(frame, event, _):
        if event == "call" and frame.f_code.co_filename == packing.__file__:
            calls.append(frame.f_code.co_name)

    sys.setprofile(watch)
    try:
        again = encode(texts)
    finally:
        sys.setprofile(None)
    assert again == expected and len(calls) < 20


def test_packing_is_whole_and_dense(spark, library):
    texts = ODD + made(80) + ["long words here " * 4000]
    docs = frame(spark, texts + ["twice", "twice"], [*range(len(texts)), None, 5])
    pieces = packing.cut_pieces(docs, VOCAB, with_ids=True)
    packed = packing.pack(pieces)
    rows = packed.collect()
    whole: dict = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 4096
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole.setdefault(r["doc_id"], []).append((r["start"], r["piece"], r["ids"]))
    for i, text in enumerate(texts):
        if i == 5:
            continue
        parts = sorted(whole[i])
        assert [p[1] for p in parts] == list(range(len(parts)))
        got = [t for _, _, ids in parts for t in ids]
        assert got == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(len(p[2]) == 4096 for p in parts[:-1])
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by) == -(-total // 4096)
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert sum(map(len, joined.values())) == total
    assert packing.pack_documents(frame(spark, []), VOCAB).count() == 0


def test_fullest_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        cap = rnd.randrange(5, 40)
        counts = {rnd.randrange(1, cap + 1): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= cap}
        chosen = packing.fullest(counts, cap)
        assert sum(k * c for k, c in chosen.items()) == max(sums)
        assert all(c <= counts[k] for k, c in chosen.items())


def test_plan_takes_every_piece_once():
    rnd = random.Random(3)
    counts = {rnd.randrange(1, 200): rnd.randrange(1, 50) for _ in range(60)}
    seen = dict.fromkeys(counts, 0)
    for length, first, last, _, _, _ in packing.plan_bins(counts, 256):
        assert first == seen[length]
        seen[length] = last
    assert seen == counts


EXACT = [
    "a b",
    "ab",
    "a  b",
    None,
    "",
    " ",
    "x",
    "a\tb\n",
    "ab",
    "é",
]


@pytest.mark.parametrize("hashed", [F.md5, lambda c: (F.crc32(c) % 2).cast("string")])
def test_exact_groups_even_if_hashes_collide(spark, hashed):
    got = {r["doc_id"]: r for r in exact_groups(frame(spark, EXACT), hashed).collect()}
    groups: dict = {}
    for i, t in enumerate(EXACT):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(EXACT)
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert got[i]["keep_id"] == keep
            assert got[i]["group_size"] == len(members)
            assert got[i]["kept"] == (i == keep)
            assert got[i]["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def test_exact_groups_of_null_ids_and_empty_table(spark):
    rows = exact_groups(frame(spark, ["a", "a", "b"], [None, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["group_size"]) for r in rows if r["group_size"] == 2) == [
        (False, 3, 2),
        (True, 3, 2),
    ]
    assert exact_groups(frame(spark, [])).count() == 0


def _similarity(a, b):
    x, y = bag_items(np.frombuffer(word_hashes(a), np.uint64)), bag_items(np.frombuffer(word_hashes(b), np.uint64))
    m = len(np.intersect1d(x, y))
    return m / (len(x) + len(y) - m)


def test_registers_agree_as_often_as_bags_are_alike():
    rnd = np.random.default_rng(1)
    agree, truth = [], []
    for _ in range(60):
        hashes = rnd.integers(1, 1 << 62, 60, dtype=np.uint64)
        a, b = rnd.integers(0, 12, 60), rnd.integers(0, 12, 60)
        b = np.where(rnd.random(60) < 0.6, a, b)
        x, y = a > 0, b > 0
        points = signatures(
            np.r_[hashes[x], hashes[y]], np.r_[a[x], b[y]], np.r_[np.zeros(x.sum(), int), np.ones(y.sum(), int)], 2
        )
        agree.append((points[0] == points[1]).mean())
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(truth)) < 0.015
    assert np.abs(np.array(agree) - truth).max() < 0.2


def test_near_classes_equal_brute_force(spark):
    rnd = random.Random(9)
    base = [t.split() for t in made(12, 4) if len(t.split()) > 40]
    texts = []
    for words in base:
        for edits in (0, 1, 2, 3, 5):
            copy = list(words)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(["new", "words", "here", "go"])
            texts.append(" ".join(copy))
    texts += ["one two", "One, TWO!", "one two three", "", None, "!!!", texts[3], "go " * 60, "go " * 66, "go " * 90]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if word_hashes(texts[i]) and word_hashes(texts[j]) and _similarity(texts[i], texts[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = {i: min(j for j in range(len(texts)) if label[j] == label[i]) for i in range(len(texts))}
    got = {r["doc_id"]: r for r in near_classes(frame(spark, texts)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())
    assert near_classes(frame(spark, [])).count() == 0


def test_bands_and_shingles_have_their_sizes():
    words = np.frombuffer(word_hashes("a b c d e f"), np.uint64)
    assert len(words) == 6 and len(shingles(words)) == 2
    assert len(shingles(words[:3])) == 1 and len(shingles(words[:0])) == 0
    assert BANDS == 32


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text, re.A):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * 2 - 9 * (int(c) > 4) for c in digits[-2::-2]]
            check = (sum(map(int, digits[::-2])) + sum(odd)) % 10
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (check or not 13 <= len(digits) <= 19):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_plain_rules(spark):
    rnd = random.Random(4)
    texts = [
        None,
        "",
        "a@b.co_x@d.ef 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 é+1 (988) 555-2485\U0001f600 4111-1111-1111 1111",
        "1" * 50 + " " + "a" * 3000 + "@",
        "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
        " ".join(f"u{i}@m{i}.com {i}.{i % 300}.1.1 é" for i in range(1500)),
    ]
    texts += ["".join(rnd.choice("0123456789.@+- ()ab_é\n") for _ in range(80)) for _ in range(300)]
    for row in pii.find_personal_data(frame(spark, texts)).collect():
        want = _base(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in PLAIN:
            assert row[f"n_{kind}"] == sum(w.startswith(kind) for w in want)
        assert set(want) <= set(row["spans"].split(","))
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_redaction_keeps_columns_and_hides_spans(spark):
    docs = frame(spark, ["mail a.b@c.de now", None, "none", "1.2.3.4 or 4111111111111111"])
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert out[0]["text"] == "mail [EMAIL] now"
    assert out[1]["text"] is None
    assert out[2]["text"] == "none"
    assert out[3]["text"] == "[IP] or [CARD]"


def test_other_forms_of_personal_data_are_found_and_redacted(spark):
    planted = [
        ("phone", "0049 30 1234567"),
        ("phone", "(555) 123-4567"),
        ("ip", "1[.]2[.]3[.]4"),
        ("ip", "10(.)0(.)0(.)7"),
        ("email", "name (at) host (dot) com"),
        ("email", "a.b[at]host.co[dot]uk"),
    ]
    # Some counter-evidence per kind, and values that only look like a kind.
    false = ["300.1.2.3", "1[.]2[.]3[.]999", "+12 34567", "00 12 345 678", "(2020-01-15 10", "(1939-1945) 12", "five @ 10.30", "4111.1111.1111.1112"]
    texts = [f"word write u{i}@m{i % 9}.com and 10.0.{i % 250}.9 or +49 30 {1000000 + i} there" for i in range(400)]
    start = len(texts)
    texts += [f"so we write {v} here {k}" for k in range(8) for _, v in planted]
    end = len(texts)
    texts += [f"so we write {v} here" for v in false]
    texts += ["mail a.b@c.de. Then 5 @ noon. Then more"]
    docs = frame(spark, texts)
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find_personal_data(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i in range(start, end):
        kind, value = planted[(i - start) % len(planted)]
        assert f"{kind}:12:{12 + len(value)}" in spans[i]
        assert clean[i] == texts[i].replace(value, f"[{kind.upper()}]")
    for i in range(end, end + len(false)):
        assert clean[i] == texts[i]
    assert clean[len(texts) - 1] == "mail [EMAIL]. Then 5 @ noon. Then more"


def test_features_take_two_values(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("0123456789.@+-=/<( ab\n") for _ in range(200)) for _ in range(100)]
    texts += [f"call{'x' * k}+49 30 {10 ** k} ip {k}.{k}.{k}.{k} (a@b{k}.com)" for k in range(5, 12)]
    found = pii.candidates(frame(spark, texts).withColumn("_text", F.col("text")), ["doc_id"])
    rows = found.select(F.explode("_wide").alias("c")).select("c.f.*").distinct().collect()
    assert len(rows) > 3 and {v for r in rows for v in r} == {0, 1}
    assert 2 ** len(pii.FEATURES) * 2 * len(pii.KINDS) <= 1024


def test_vocabulary_path_is_a_parameter():
    assert os.path.exists(VOCAB)
