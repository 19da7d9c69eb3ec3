"""Bucketed tables, roll-ups, listings by level and partial hydration."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportloom.operators import content, merge, observations as obs, reports as op
from reportloom.plans import hydrate as hy
from reportloom.schemas import CONTENT_LIST_DDL, NAME_EVIDENCE, OBSERVATIONS, PATIENTS, REPORTS
from reportloom.sinks.files import write_file_per_row
from reportloom.sinks.tables import save_bucketed
from reportloom.sources import files


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _exchanged_below(df, table):
    """Whether the scan of ``table`` stands under an exchange in the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            if line.lstrip(" :+-*()0123456789").startswith("Exchange"):
                return True
    return False


def _reports(spark, ids, tag):
    rows = [(f"R{i}", f"P{i % 7}", tag, dt.date(2024, 1, 1 + i % 28), f"{tag}/{i}", i) for i in ids]
    return spark.createDataFrame(rows, REPORTS)


def test_updates_do_not_move_the_stored_table(spark, no_broadcast):
    have = _reports(spark, range(500), "old")
    target = save_bucketed(have, "b_reports", ["report_id"], 8)
    new = _reports(spark, range(400, 600), "new").union(_reports(spark, [450], "newer"))
    merged = merge.upsert_reports(target, new, ["src_path"])
    assert not _exchanged_below(merged, "b_reports") and _exchanged_below(merge.upsert_reports(target.repartition(5), new, ["src_path"]), "b_reports")
    plain = merge.upsert_reports(have, new, ["src_path"])
    assert sorted(merged.collect()) == sorted(plain.collect()) and merged.count() == 600
    later = save_bucketed(merged, "b_reports_2", ["report_id"], 8, exchange=False)
    assert sorted(later.collect()) == sorted(plain.collect())
    again = merge.upsert_reports(later, new, ["src_path"])
    assert not _exchanged_below(again, "b_reports_2") and sorted(again.collect()) == sorted(plain.collect())

    for state in (
        merge.replace_observations(target, new),
        merge.insert_if_absent(target, new, ["report_id"]),
        merge.unprocessed(target, [new]),
    ):
        assert not _exchanged_below(state, "b_reports")
    replaced = merge.replace_observations(target, new)
    kept = save_bucketed(replaced, "b_reports_3", ["report_id"], 8, exchange=False)
    assert sorted(kept.collect()) == sorted(merge.replace_observations(have, new).collect())
    with pytest.raises(Exception, match="already exists"):
        save_bucketed(have, "b_reports", ["report_id"], 8)


def test_content_known_in_a_bucketed_table_is_left_out(spark, no_broadcast):
    cols = "sha256 string, src_path string"
    known = save_bucketed(spark.createDataFrame([(f"h{i}", "x") for i in range(300)], cols), "b_known", ["sha256"], 8)
    files_ = spark.createDataFrame([(f"h{i}", f"p{i}") for i in range(250, 350)] * 2 + [(None, "n")], cols)
    fresh = merge.dedupe_by_content_hash(files_, known, ["src_path"])
    assert not _exchanged_below(fresh, "b_known")
    assert {r.src_path for r in fresh.collect()} == {f"p{i}" for i in range(300, 350)} | {"n"}


def test_roll_ups_equal_distinct_counts(spark):
    rnd = random.Random(2)
    numbers = [*range(-5, 400), 32_767, 32_768, 10**12, None]
    rows = [(rnd.choice(numbers), dt.date(2023, 1, 1) + dt.timedelta(rnd.randrange(900))) for _ in range(4000)]
    rows += [(None, dt.date(2030, 5, 5)), (3, None)]
    frame = spark.createDataFrame(rows, "patient_no long, report_date date")
    months = op.patient_bitmaps(frame)
    quarters = op.roll_up_bitmaps(months, "quarter")

    def want(start):
        by: dict = {}
        for n, d in rows:
            if d is not None:
                by.setdefault(start(d), set()).update([n] if n is not None else [])
        return {k: len(v) for k, v in by.items()}

    def got(maps):
        return {r.period: r.patients for r in op.patients_of_bitmaps(maps).collect()}

    assert got(months) == want(lambda d: d.replace(day=1))
    assert got(quarters) == want(lambda d: dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1))
    years = want(lambda d: dt.date(d.year, 1, 1))
    assert got(op.roll_up_bitmaps(quarters)) == got(op.roll_up_bitmaps(months)) == years and years[dt.date(2030, 1, 1)] == 0
    rough = op.patients_of_sketches(op.roll_up_sketches(op.patient_sketches(frame, "patient_no")))
    for r in rough.collect():
        assert abs(r.patients - years[r.period]) <= years[r.period] * 4 / 128
    assert op.patient_bitmaps(frame.where("false")).count() == 0


def test_listing_goes_down_level_by_level(spark, tmp_path, monkeypatch):
    names = [f"{'/'.join(f'd{j}' for j in range(i % 6))}/f{i}.md".lstrip("/") for i in range(120)]
    rows = spark.createDataFrame([(n, n.encode()) for n in names], "name string, content binary")
    root = str(tmp_path / "tree")
    assert write_file_per_row(rows, root) == 120
    (tmp_path / "tree" / "void").mkdir()
    (tmp_path / "tree" / "zero.txt").write_text("")
    got = {r.path: (r.kind, r.length) for r in files.list_files(spark, [root]).collect()}
    assert got == {f"{root}/{n}": ("file", len(n)) for n in names} | {f"{root}/zero.txt": ("file", 0)}
    flat = files.list_files(spark, [root], recursive=False).collect()
    assert {r.path for r in flat} == {f"{root}/{n}" for n in names if "/" not in n} | {f"{root}/zero.txt"}
    assert files.list_files(spark, [str(tmp_path / "tree" / "void")]).count() == 0
    both = files.list_files(spark, [f"file://{root}", f"{root}/gone"]).collect()
    assert len(both) == 122 and [r.path for r in both if r.kind == "missing"] == [f"{root}/gone"]
    # A large folder comes in frames of bounded size.
    monkeypatch.setattr(files, "LISTED_ROWS", 7)
    frames = list(files._listed(iter([pd.DataFrame({"root": [root]})])))
    assert max(len(f) for f in frames) <= 7 and sum(len(f) for f in frames) == 23


def test_parts_of_hydration_equal_the_whole(spark):
    text = "Patient Name: DOE, JANE\nHemoglobin 13.5 g/dL 12.0 - 15.5\n"
    docs = spark.createDataFrame(
        [(f"P{i}_CBC_2024010{i % 9 + 1}_grid", f"md/{i}", text if i % 3 else "nothing") for i in range(20)],
        "report_id string, path string, text string",
    )

    def store():
        return hy.Store(
            spark.createDataFrame([("P3", "old", None, None)], PATIENTS), spark.createDataFrame([], REPORTS),
            spark.createDataFrame([], NAME_EVIDENCE), spark.createDataFrame([], OBSERVATIONS),
        )

    whole, index = hy.hydrate(docs, store())
    named, same = hy.hydrate(docs, store(), parts=("names",))
    seen, none = hy.hydrate(docs, store(), parts=("observations",))
    keys, _ = hy.hydrate(docs, store(), parts=())

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(named.patients) == rows(whole.patients) and rows(same) == rows(index) and none is None
    assert rows(named.name_evidence) == rows(whole.name_evidence) and named.observations.count() == 0
    assert rows(seen.observations) == rows(whole.observations) and whole.observations.count() > 0
    assert seen.name_evidence.count() == 0
    for state in (named, seen, keys):
        assert rows(state.reports) == rows(whole.reports)
    assert {r.patient_id for r in keys.patients.collect()} == {r.patient_id for r in whole.patients.collect()}


def test_trend_equals_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    people = ["P1"] * 6 + ["P2", "P3", "P4", None]
    rows = [
        (rnd.choice(people), rnd.choice("ab"), rnd.choice([None, *range(40)]), i, rnd.choice([None, 1.5, 2.0, 7.25]))
        for i in range(3000)
    ]
    frame = spark.createDataFrame(rows, "p string, a string, t int, i int, v double").repartition(6)
    got = {r.i: (r.p, r.a, r.t, r.v, r.prev_value, r.change) for r in obs.analyte_trend(frame, ["p", "a"], "t", "v", ["i"]).collect()}
    want, last = {}, {}
    for p, a, t, i, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        prev = last.get((p, a))
        want[i] = (p, a, t, v, prev, None if prev is None or v is None else v - prev)
        last[p, a] = v
    assert got == want
    assert obs.analyte_trend(frame.where("false"), ["p", "a"], "t", "v", ["i"]).count() == 0


def test_context_in_the_row_equals_context_by_position(spark):
    rnd = random.Random(6)

    def item(kind):
        words = " ".join(rnd.choice(["one", "two.", "x\ny", ""]) for _ in range(rnd.randrange(9)))
        return (kind, words, rnd.choice([None, 0, 2]), 0, None, rnd.choice([None, [], ["c", "d"]]), None, None, ["t"], None, None, None, None)

    kinds = ["text", "text", "image", "table", "equation", None]
    docs = [(i, [item(rnd.choice(kinds)) for _ in range(rnd.randrange(30))]) for i in range(40)] + [(99, None), (98, [])]
    frame = spark.createDataFrame(docs, f"doc_id long, items {CONTENT_LIST_DDL}")
    rows = content.content_items(frame)
    for window, words, types in ((0, 5, ("text",)), (1, 5, ("text",)), (3, 12, ("text", "image", "table")), (50, 400, ("text",))):
        one = content.chunk_context_of_lists(frame, "items", ("doc_id",), window, words, types)
        two = content.chunk_context(rows, window, words, types)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_files_hold_their_bytes_whatever_their_name(spark, tmp_path):
    rows = spark.createDataFrame([("a.gz", bytearray(b"plain")), ("b/c.bz2", bytearray(b"")), ("d.txt", None)], "name string, content binary")
    assert write_file_per_row(rows, f"file://{tmp_path}") == 3
    assert [(tmp_path / n).read_bytes() for n in ("a.gz", "b/c.bz2", "d.txt")] == [b"plain", b"", b""]
