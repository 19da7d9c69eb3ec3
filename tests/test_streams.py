from __future__ import annotations

import datetime as dt
import itertools
import random

from pyspark.sql import Row, functions as F

from reportloom.operators import chat, merge
from reportloom.session import SHUFFLE_CLEANUP, passing_shuffles
from reportloom.streaming import context as live, jobs as st, store
from reportloom.suite import jobs as suite_jobs


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


# ---- ingest --------------------------------------------------------------------------


def _ingested(spark, out):
    rows = {n: st.current_rows(spark, f"{out}/{n}").collect() for n in ("reports", "name_evidence", "observations", "table_observations")}
    return {n: sorted(map(str, r)) for n, r in rows.items()}


def test_ingest_stream_replaces_per_report(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "P1_LFT_20240101_a.md").write_text("Patient: LEE, ANN\nIron 5 mg\nZinc 1 g")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go(checkpoint=cp):
        run(st.stream_ingest_reports(st.read_report_stream(spark, str(src), glob="*.{md,txt}"), out, checkpoint))

    go()
    (src / "P1_LFT_20240101_a.txt").write_bytes(b"Iron\xff 6 mg")
    (src / "P1_LFT_20240101_a.bin").write_bytes(b"Zinc 7 mg")
    (src / "P2_CBC_20240102_b.txt").write_text("nothing to read")
    go()
    got = st.current_rows(spark, f"{out}/observations").collect()
    assert [(r.report_id, r.analyte, r.value) for r in got] == [("P1_LFT_20240101_a", "Iron", "6")]
    # The new text names nobody, so the evidence of the old one stays.
    assert [r.name for r in st.current_rows(spark, f"{out}/name_evidence").collect()] == ["Ann Lee"]
    reports = st.current_rows(spark, f"{out}/reports").collect()
    assert sorted((r.patient_id, r.test_type) for r in reports) == [("P1", "LFT"), ("P2", "CBC")]
    before = _ingested(spark, out)
    go()
    assert _ingested(spark, out) == before


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rnd = random.Random(4)
    out = str(tmp_path / "out")
    ddl = "report_id string, v int, w int"
    state: dict = {}
    seen = []
    for number in range(5):
        rows = [(f"r{rnd.randrange(60)}", rnd.randrange(9), number) for _ in range(40)]
        new = spark.createDataFrame(rows, ddl)
        for key in {r[0] for r in rows}:
            state[key] = sorted(r for r in rows if r[0] == key)
        for _ in range(2 if number % 2 else 1):
            store.merge_buckets(spark, out, new, "report_id", merge.replace_observations, buckets=16)
        got: dict = {}
        for r in st.current_rows(spark, out).collect():
            got.setdefault(r.report_id, []).append(tuple(r))
        assert {k: sorted(v) for k, v in got.items()} == state
        seen.append(len(spark.read.parquet(out).inputFiles()))
    assert max(seen) <= 17  # with the empty one; files per bucket stay few, whatever the number of batches
    store.merge_buckets(spark, out, spark.createDataFrame([], ddl), "report_id", merge.replace_observations, 16)
    assert st.current_rows(spark, out).count() == sum(map(len, state.values()))


def test_untouched_buckets_are_not_written(spark, tmp_path):
    out = str(tmp_path / "out")
    many = spark.range(500).select(F.concat(F.lit("r"), "id").alias("report_id"), F.col("id").alias("v"))
    store.merge_buckets(spark, out, many, "report_id", merge.replace_observations, buckets=32)
    before = set(spark.read.parquet(out).inputFiles())
    store.merge_buckets(spark, out, many.where("v = 7").withColumn("v", F.lit(-7).cast("long")), "report_id", merge.replace_observations, 32)
    after = set(spark.read.parquet(out).inputFiles())
    assert len({f.split("_bucket=")[1].split("/")[0] for f in before ^ after}) == 1
    assert st.current_rows(spark, out).where("v < 0").count() == 1 and st.current_rows(spark, out).count() == 500


def test_buckets_merged_in_rounds_give_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROUND_BYTES", 2_000, raising=False)
    monkeypatch.setattr(store, "FILE_BYTES", 100, raising=False)
    written = []
    overwrite = store._overwrite
    monkeypatch.setattr(store, "_overwrite", lambda *a: written.append(1) or overwrite(*a))
    out = str(tmp_path / "out")
    key = F.concat(F.lit("r"), F.col("id") % 200)
    old = spark.range(600).select(F.when(F.col("id") % 200 != 0, key).alias("report_id"), F.col("id").alias("v"))
    new = spark.range(900, 1000).select(key.alias("report_id"), F.col("id").alias("v"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        for rows in (old, new, new):
            store.merge_buckets(spark, out, rows, "report_id", merge.replace_observations, buckets=8)
    finally:
        spark.conf.set(small, "true")
    want = [tuple(r) for r in merge.replace_observations(old, new).collect()]
    got = [tuple(r) for r in st.current_rows(spark, out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(written) > 3 * 2  # several rounds for each merge
    files = [f.split("_bucket=")[1].split("/")[0] for f in spark.read.parquet(out).inputFiles()]
    assert max(map(files.count, files)) > 1  # a bucket has several files, written by several tasks


def test_ingest_leaves_only_its_tables(spark, tmp_path, monkeypatch):
    """What a job stages is gone when it ends, and its own copy of the source but for the last batch."""
    numbers = itertools.count()
    for module in (suite_jobs, st, store):
        monkeypatch.setattr(module, "workspace", lambda _, name: f"{tmp_path}/{name}-{next(numbers)}")
    docs = spark.range(400).select(
        F.concat(F.lit("P"), "id", F.lit("_LFT_20240101_x")).alias("report_id"),
        F.concat(F.lit("Name: Ann Lee\nIron "), "id", F.lit(" mg")).alias("text"),
    )
    stream = suite_jobs._stream(spark, "", docs, docs.columns, repeated=True)
    staged = len(list(tmp_path.glob("stream-*/*.parquet")))
    out = f"{tmp_path}/ingest"
    run(st.stream_ingest_reports(stream, out, f"{tmp_path}/cp", buckets=4))
    assert st.current_rows(spark, f"{out}/name_evidence").count() == 400
    assert not [p for kind in ("dealt", "batch", "merge") for p in tmp_path.glob(f"{kind}-*/**/*.parquet")]
    assert len(list(tmp_path.glob("stream-*/*.parquet"))) < staged


def test_shuffles_pass_only_within_a_write(spark):
    old = spark.conf.get(SHUFFLE_CLEANUP)
    try:
        with passing_shuffles(spark):
            assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
            raise RuntimeError
    except RuntimeError:
        pass
    assert spark.conf.get(SHUFFLE_CLEANUP) == old


def test_an_ingest_batch_that_failed_is_merged_again(spark, tmp_path):
    """A crash after some tables: no marker, so the batch runs again from its start."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "report_id string, text string"
    docs = spark.createDataFrame([(f"P{i}_LFT_20240101_x", f"Name: Ann Lee\nIron {i} mg") for i in range(30)], ddl)
    docs.write.parquet(src)
    fail = [True]
    marked = store.mark_merged

    def breaking(*args):
        if fail.pop() if fail else False:
            raise RuntimeError("lost")
        marked(*args)

    store.mark_merged = breaking
    try:
        q = st.stream_ingest_reports(spark.readStream.schema(ddl).parquet(src), out, str(tmp_path / "cp"))
        try:
            q.awaitTermination()
        except Exception:
            pass
        assert not store.is_merged(spark, out, 0)
        run(st.stream_ingest_reports(spark.readStream.schema(ddl).parquet(src), out, str(tmp_path / "cp")))
    finally:
        store.mark_merged = marked
    assert store.is_merged(spark, out, 0)
    assert {n: len(r) for n, r in _ingested(spark, out).items()} == {"reports": 30, "name_evidence": 30, "observations": 30, "table_observations": 0}


# ---- context -------------------------------------------------------------------------

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DDL = "u int, id int, ts timestamp, role string, n bigint"


def _plain_context(rows, n, ttl):
    """(u, id, recency) by the rule on all rows at once."""
    as_of = max(r[2] for r in rows)
    by_user: dict = {}
    for r in set(rows):
        by_user.setdefault(r[0], []).append(r)
    out = []
    for u, mine in by_user.items():
        mine.sort(key=lambda r: (r[2], r[1]), reverse=True)
        if (as_of - mine[0][2]).total_seconds() >= ttl:
            continue
        newer = mine[0]
        for recency, r in enumerate(mine[:n], 1):
            if (newer[2] - r[2]).total_seconds() >= ttl:
                break
            out.append((u, r[1], recency, r[3], r[4]))
            newer = r
    return sorted(out)


def _shuffled(rnd, rows, disorder):
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.random() * disorder))


def _feed(spark, src, rows, size):
    for part in range(0, len(rows), size):
        spark.createDataFrame(rows[part : part + size], DDL).coalesce(1).write.mode("append").parquet(src)


def test_context_stream_equals_all_rows_at_once(spark, tmp_path):
    rnd = random.Random(6)
    src, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    rows = []
    for u in range(25):
        at = rnd.randrange(20_000)
        for i in range(rnd.randrange(1, 30)):
            rows.append((u, 1000 * u + i, BASE + dt.timedelta(seconds=at, microseconds=rnd.randrange(10**6)), f"r{i}", rnd.choice([None, 2**60 + i])))
            at += rnd.choice([5, 300, 899, 900, 4000])
    rows = _shuffled(rnd, rows, 1800)
    first, rest = rows[: len(rows) // 2], rows[len(rows) // 2 :]

    def go():
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
        return run(live.stream_context_window(stream, "u", "ts", "id", out, cp, n=5, ttl_seconds=900, late="1800 seconds"))

    def got():
        rows = live.current_context(spark, out, "u", 900).collect()
        return sorted((r.u, r.id, r.recency, r.role, r.n) for r in rows)

    _feed(spark, src, first + first[-20:], 60)
    assert len({p["batchId"] for p in go().recentProgress}) >= 4
    assert got() == _plain_context(first, 5, 900)
    # Restarted from its checkpoint, with rows that came before among the new ones.
    _feed(spark, src, first[-10:] + rest + rest[-15:], 60)
    q = go()
    assert got() == _plain_context(rows, 5, 900)
    written = spark.read.parquet(out)
    assert written.where("recency = 0").count() > 0  # sessions ended by their timers
    # State holds live sessions only, and a batch writes only what it touched.
    kept = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    assert kept
    per_batch = [r["n"] for r in written.groupBy("batch_id").agg(F.count_distinct("u").alias("n")).collect()]
    assert min(per_batch) < 25


def test_context_bridged_by_a_late_message(spark, tmp_path):
    """Two messages a pause apart become one session when a late one falls between them."""
    src, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))

    def m(id_, seconds, u=1):
        return (u, id_, BASE + dt.timedelta(seconds=seconds), "r", 1)

    _feed(spark, src, [m(1, 0), m(3, 1500), m(9, 1400, 2)], 1)
    _feed(spark, src, [m(2, 800), (None, 5, BASE, "r", 1), (1, None, BASE, "r", 1), (1, 6, None, "r", 1)], 4)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
    run(live.stream_context_window(stream, "u", "ts", "id", out, cp, n=5, ttl_seconds=900, late="1 hour"))
    got = sorted((r.u, r.id, r.recency) for r in live.current_context(spark, out, "u", 900).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (1, 3, 1), (2, 9, 1)]
    assert chat.CONTEXT_MESSAGES == 20


class _Calls:
    """A state store that counts its calls: one value, one set of timers."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class _Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_session_costs_two_calls_to_its_state_a_batch():
    """one value read and written; the timer is moved on when it fires, not with each batch."""
    state = _Calls()
    processor = live.RecentMessages(3, 1_000_000, "int", "u")
    processor.init(state)
    for batch in range(10):
        rows = [Row(u=1, m_at=None, m_us=batch * 500_000 + i, m_id=2 * batch + i, m_body=f"b{2 * batch + i}") for i in range(2)]
        (out,) = processor.handleInputRows((1,), iter(rows), _Watermark(0))
        assert out["_bodies"] == [f"b{i}" for i in range(2 * batch + 1, max(2 * batch - 2, -1), -1)]
    assert state.calls == 2 * 10 + 1 and state.timers == [1001]
    assert list(processor.handleExpiredTimer((1,), _Watermark(1001), None)) == []
    assert state.timers == [1001, 5501]
    (ended,) = processor.handleExpiredTimer((1,), _Watermark(5501), None)
    assert ended["_bodies"] is None and ended["_last"] == 4_500_001 and state.value is None
