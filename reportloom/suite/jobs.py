"""Whole jobs: hydration, knowledge insert, retrieval, questions, sinks, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reportloom.functions import content as ct, templates as tm
from reportloom.operators import chat, costs, names, vectors as vx
from reportloom.plans import hydrate as hy, knowledge as kn, questions as qn
from reportloom.session import discard, passing_shuffles, workspace
from reportloom.sinks import files as sink
from reportloom.streaming import context as live, jobs as st
from reportloom.suite import chat as chat_suite, content as content_suite, costs as costs_suite
from reportloom.suite import names as names_suite, observations as obs_suite, retrieval as retrieval_suite
from reportloom.suite import tables as tb
from reportloom.suite.registry import query


# ---- hydration -----------------------------------------------------------------------


def _store(spark, sf_dir):
    """Record tables before the run: customers as patients, orders as reports."""
    people = tb.patients(spark, sf_dir).withColumn("full_name", F.concat(F.lit("old "), "patient_id"))
    no_evidence = spark.createDataFrame([], "patient_id string, source_report string, name string, confidence double")
    old = tb.reports(spark, sf_dir).select(
        "report_id", F.lit(0).alias("obs_no"), F.lit("old").alias("analyte"), F.lit("1").alias("value"),
        F.lit("").alias("unit"), F.lit("").alias("ref_range"), F.lit(None).cast("int").alias("page"),
    )
    return hy.Store(people, tb.reports(spark, sf_dir), no_evidence, old)


def _hydrated(spark, sf_dir, parts, stage=None):
    docs = tb.report_texts(spark, sf_dir).select("report_id", F.concat(F.lit("md/"), "report_id").alias("path"), "text")
    return hy.hydrate(docs, _store(spark, sf_dir), stage=stage, parts=parts)


@query(
    "hydrate_patients",
    f"""{names_suite._CANONICAL},
ids AS (SELECT 'P' || c_custkey AS patient_id FROM customer UNION SELECT patient_id FROM report_texts)
SELECT i.patient_id, coalesce(c.full_name, 'old ' || i.patient_id) AS full_name FROM ids i LEFT JOIN canonical c USING (patient_id)""",
)
def hydrate_patients(spark, sf_dir):
    return _hydrated(spark, sf_dir, ("names",))[0].patients.select("patient_id", "full_name")


@query(
    "hydrate_reports",
    f"""WITH {tb.REPORT_TEXTS_SQL}, {tb.REPORTS_SQL}
SELECT report_id, patient_id, test_type, strftime(report_date, '%Y-%m-%d') AS report_date, src_path FROM reports
UNION ALL SELECT DISTINCT report_id, patient_id, string_split(report_id, '_')[2],
  strftime(strptime(string_split(report_id, '_')[3], '%Y%m%d'), '%Y-%m-%d'), 'md/' || report_id FROM report_texts""",
)
def hydrate_reports(spark, sf_dir):
    got = _hydrated(spark, sf_dir, ())[0].reports.drop("pages")
    return got.withColumn("report_date", F.date_format("report_date", "yyyy-MM-dd"))


@query(
    "hydrate_observations",
    f"""{obs_suite.REPORT_OBSERVATIONS_SQL}
UNION ALL SELECT 'R' || o_orderkey, 0, 'old', '1', '', '' FROM orders""",
)
def hydrate_observations(spark, sf_dir):
    """From the staged table: the texts are read once, whatever is derived."""
    state, _ = _hydrated(spark, sf_dir, ("observations",), workspace(spark, "hydrate"))
    return state.observations.drop("page")


@query(
    "bootstrap_reports",
    """WITH files AS (
  SELECT 'P' || (doc_id % 50) || '_LFT_2024010' || (1 + doc_id % 9) || '_d' || doc_id || CASE WHEN doc_id % 10 = 9 THEN '.txt' ELSE '.pdf' END AS name,
         doc_id, sha256(text) AS sha256 FROM documents),
ok AS (SELECT * FROM files WHERE name LIKE '%.pdf'),
new AS (SELECT sha256, min('in/' || name) AS src_path FROM ok GROUP BY sha256)
SELECT sha256, src_path, regexp_extract(src_path, 'in/(P[0-9]+)_', 1) AS patient_id, replace(substr(src_path, 4), '.pdf', '') AS report_id FROM new""",
)
def bootstrap_reports(spark, sf_dir):
    key = F.col("doc_id")
    name = F.concat(
        F.lit("P"), (key % 50).cast("string"), F.lit("_LFT_2024010"), (1 + key % 9).cast("string"), F.lit("_d"),
        key.cast("string"), F.when(key % 10 == 9, ".txt").otherwise(".pdf"),
    )
    files = tb.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), F.lit(0).cast("bigint").alias("mtime"),
        F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
    )
    none = spark.createDataFrame([], "sha256 string, report_id string, patient_id string, src_path string, mtime bigint, size_bytes bigint")
    return hy.bootstrap(files, _store(spark, sf_dir), none)[1].select("sha256", "src_path", "patient_id", "report_id")


# ---- knowledge -----------------------------------------------------------------------

_FIRST_DOCS = "(SELECT md5(text) AS document_id, min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY 1)"


@query(
    "insert_documents",
    f"""WITH {content_suite._chunks_sql(_FIRST_DOCS, 'document_id', size=200, overlap=40)}
SELECT c.document_id, 'docs/' || d.doc_id AS file_path, chunk_index, md5(chunk) AS chunk, n_words,
  CAST(length(chunk) AS DOUBLE) AS e0 FROM chunks c JOIN {_FIRST_DOCS} d USING (document_id)""",
)
def insert_documents(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"), "text"
    )
    got = kn.insert_documents(docs, retrieval_suite._measuring_embedder, 3, size=200, overlap=40)
    return got.select(
        "document_id", "file_path", "chunk_index", F.md5("chunk").alias("chunk"), "n_words",
        F.get("embedding", F.lit(0)).cast("double").alias("e0"),
    )


@query(
    "insert_into_store",
    f"""WITH {content_suite._chunks_sql(_FIRST_DOCS, 'document_id', size=200, overlap=40)}
SELECT c.document_id, 'docs/' || d.doc_id AS file_path, chunk_index, md5(chunk) AS chunk, n_words,
  CAST(length(chunk) AS DOUBLE) AS e0 FROM chunks c JOIN {_FIRST_DOCS} d USING (document_id)""",
)
def insert_into_store(spark, sf_dir):
    """Two runs that overlap: two thirds of the documents, some with an older text, then all of them."""
    path = workspace(spark, "index")
    docs = tb.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"), "text"
    )
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text"))
    for run in (docs.where("doc_id % 3 <> 0").withColumn("text", old), docs):
        kn.insert_into_store(run, path, retrieval_suite._measuring_embedder, 3, buckets=16, size=200, overlap=40)
    return kn.stored_chunks(spark, path).select(
        "document_id", "file_path", "chunk_index", F.md5("chunk").alias("chunk"), "n_words",
        F.get("embedding", F.lit(0)).cast("double").alias("e0"),
    )


def _describing_model():
    def model(prompt, **_):
        if len(prompt) % 7 == 0:
            return "no JSON"
        info = {"entity_name": f"E{len(prompt)}", "entity_type": "thing", "summary": "s"}
        return json.dumps({"detailed_description": f"{len(prompt)} characters", "entity_info": info})

    return model


@query("insert_multimodal")
def insert_multimodal(spark, sf_dir):
    """Its prompts, contexts and chunks each have their own SQL-checked query."""
    items = content_suite._items(spark, sf_dir)
    got = kn.insert_multimodal(items, _describing_model, retrieval_suite._measuring_embedder, 3, max_words=60)
    return got.select("doc_id", "pos", "processor", "entity_name", "description", F.md5("chunk").alias("chunk"))


@query(
    "retrieve_with_chunks",
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE label = 0),
s AS (SELECT query_id, vec_id AS id, label % 3 AS side, round(list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])), 6) AS score
      FROM q, embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.1) WHERE rn <= 10),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM top)
SELECT * FROM r WHERE rank <= 10""",
)
def retrieve_with_chunks(spark, sf_dir):
    """Entities, relations and chunks together, the entities as a stored index."""
    vectors = tb.table(spark, sf_dir, "embeddings")
    sides = [vectors.where(f"label % 3 = {i}") for i in range(3)]
    return kn.retrieve(retrieval_suite._queries(spark, sf_dir), vx.build_index(sides[0]), sides[1], k=10, threshold=0.1, chunks=sides[2])


@query(
    "render_query",
    """SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Table: ' || p_brand
  || CASE WHEN p_size % 3 = 2 THEN chr(10) || chr(10) || 'Equation: ' || p_type ELSE '' END
  || chr(10) || chr(10) || 'Answer the question from the content above as well.' END AS query_text FROM part""",
)
def render_query(spark, sf_dir):
    """A question with no, one or two content parts."""
    parts = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(
        F.col("p_size") % 3 == 1, F.array(F.concat(F.lit("Table: "), "p_brand"))
    ).otherwise(F.array(F.concat(F.lit("Table: "), "p_brand"), F.concat(F.lit("Equation: "), "p_type")))
    return tb.table(spark, sf_dir, "part").select("p_partkey", tm.render_query(F.col("p_name"), parts).alias("query_text"))


@query(
    "retrieve",
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE label = 0),
s AS (SELECT query_id, vec_id AS id, label % 2 AS side, round(list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])), 6) AS score
      FROM q, embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.1) WHERE rn <= 10),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM top)
SELECT * FROM r WHERE rank <= 10""",
)
def retrieve(spark, sf_dir):
    vectors = tb.table(spark, sf_dir, "embeddings")
    return kn.retrieve(
        retrieval_suite._queries(spark, sf_dir), vectors.where("label % 2 = 0"), vectors.where("label % 2 = 1"),
        k=10, threshold=0.1,
    )


# ---- questions -----------------------------------------------------------------------


@query(
    "run_report_sql",
    f"""WITH {tb.PATIENTS_SQL}, {tb.REPORTS_SQL}
SELECT CAST(year(report_date) AS INT) AS y, count(DISTINCT patients.patient_id) AS total_patients
FROM patients JOIN reports ON patients.patient_id = reports.patient_id GROUP BY 1""",
)
def run_report_sql(spark, sf_dir):
    tables = {"patients": tb.patients(spark, sf_dir), "reports": tb.reports(spark, sf_dir)}
    return qn.run_report_sql(
        spark, tables,
        "SELECT year(report_date) AS y, count(DISTINCT patients.patient_id) AS total_patients "
        "FROM patients JOIN reports ON patients.patient_id = reports.patient_id GROUP BY 1",
    )


@query(
    "report_for_question",
    f"""WITH {tb.REPORTS_SQL},
cand AS (SELECT *, test_type IN ('1-URGENT', '5-LOW') AS is_text FROM reports),
q AS (SELECT s_suppkey AS question_id, 'P' || s_suppkey AS patient_id,
             CASE s_nationkey % 3 WHEN 0 THEN '2-HIGH' WHEN 1 THEN '1-URGENT' END AS test_type FROM supplier),
hit AS (SELECT question_id, q.patient_id, report_id, is_text, row_number() OVER (PARTITION BY question_id
          ORDER BY is_text DESC, report_date DESC, report_id DESC) AS rn
        FROM q JOIN cand c ON q.patient_id = c.patient_id AND (q.test_type IS NULL OR q.test_type = c.test_type))
SELECT question_id, patient_id, report_id, CASE WHEN is_text THEN 'text of ' || report_id || '...' ELSE '-' END AS report_text FROM hit WHERE rn = 1""",
)
def report_for_question(spark, sf_dir):
    digits = F.substring_index("s_name", "#", -1)
    kind = F.col("s_nationkey") % 3
    asked = tb.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("question_id"), F.concat(F.lit("CUSTOMER#"), digits).alias("mention"),
        F.when(kind == 0, "2-HIGH").when(kind == 1, "1-URGENT").alias("test_type"),
    )
    people = tb.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"), F.col("c_name").alias("full_name")
    )
    rows = tb.reports(spark, sf_dir).drop("src_path", "pages")
    is_text = F.col("test_type").isin("1-URGENT", "5-LOW")
    text = F.concat(F.lit("text of "), "report_id", F.lit(" and more"))
    got = qn.report_for_question(asked, people, rows.where(is_text).withColumn("text", text), rows.where(~is_text), 3)
    return got.withColumn("report_text", F.coalesce("report_text", F.lit("-")))


@query(
    "process_uploads",
    f"""WITH {content_suite.UPLOADS_SQL},
ided AS (SELECT * REPLACE (coalesce(patient_id, 'P' || upper(left(md5(lower(patient_name)), 6))) AS patient_id) FROM uploads)
SELECT c_custkey AS upload_id, {content_suite._REPORT_NAME_SQL} AS file_name, {content_suite._MARKDOWN_SQL} AS text FROM ided""",
)
def process_uploads(spark, sf_dir):
    rows = content_suite._uploads(spark, sf_dir).select(
        F.col("c_custkey").alias("upload_id"),
        F.concat(F.lit("original "), F.col("c_custkey").cast("string")).alias("text"),
        F.to_json("entities").alias("entities_json"),
    )
    return qn.process_uploads(rows, content_suite._AS_OF).select("upload_id", "file_name", "text")


# ---- sinks: written, then read back --------------------------------------------------


@query("write_name_index", f"{names_suite._CANONICAL} SELECT patient_id, full_name AS name FROM canonical")
def write_name_index(spark, sf_dir):
    path = workspace(spark, "name-index")
    sink.write_name_index(names.canonical_name(names.name_evidence(tb.report_texts(spark, sf_dir))), path)
    return spark.read.schema("patient_id string, name string").json(path)


@query(
    "write_parse_log",
    """SELECT CAST(event_id AS VARCHAR) AS report_id, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS return_code, floor(value) + 0.25 AS duration_sec,
  CASE WHEN event_type = 'error' THEN right(repeat('x', 400) || event_id, 400) ELSE '-' END AS stderr_tail FROM events""",
)
def write_parse_log(spark, sf_dir):
    path = workspace(spark, "parse-log")
    kind = F.col("event_type")
    key = F.col("event_id").cast("string")
    outcomes = tb.table(spark, sf_dir, "events").select(
        F.concat_ws("/", kind, F.concat(key, F.lit(".pdf"))).alias("path"), (kind != "error").alias("ok"),
        F.when(kind == "error", F.concat(F.repeat(F.lit("x"), F.lit(400)), key)).alias("error"),
        (F.floor("value") + 0.25).alias("duration_sec"), F.col("ts").cast("string").alias("start_time"),
        F.col("ts").cast("string").alias("end_time"), F.lit("t").alias("thread_name"), F.lit(1).cast("bigint").alias("thread_id"),
    )
    sink.write_parse_log(outcomes, path)
    from reportloom.schemas import PARSE_LOG

    log = spark.read.option("header", True).schema(PARSE_LOG).csv(path)
    return log.select("report_id", "status", "return_code", "duration_sec", F.coalesce("stderr_tail", F.lit("-")).alias("stderr_tail"))


@query(
    "write_usage_jsonl",
    f"""{costs_suite._U} SELECT strftime(timestamp, '%Y-%m-%d') AS date, user_id, count(*) AS n, sum(total_tokens) AS tokens,
  CAST(sum(total_cost) AS DOUBLE) AS cost FROM usage GROUP BY ALL""",
)
def write_usage_jsonl(spark, sf_dir):
    path = workspace(spark, "usage-log")
    sink.write_usage_jsonl(tb.usage(spark, sf_dir), path)
    log = spark.read.schema(
        "user_id string, tokens struct<total:bigint>, costs struct<total_cost:decimal(10,6)>, date date"
    ).json(path)
    return log.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens.total").alias("tokens"), F.sum("costs.total_cost").cast("double").alias("cost")
    )


@query(
    "write_usage_entries",
    f"""{costs_suite._U} SELECT user_id, CASE WHEN event_id % 10 <> 0 THEN event_id ELSE -1 END AS id,
  CASE WHEN event_id % 10 = 0 THEN 'failed ' || event_id ELSE '-' END AS error,
  CASE WHEN event_id % 10 <> 0 THEN operation_type ELSE '-' END AS operation_type, input_tokens::BIGINT AS input_tokens,
  CASE WHEN event_id % 10 <> 0 THEN total_tokens::BIGINT ELSE -1 END AS total_tokens,
  '{{"event":' || event_id || '}}' AS metadata FROM usage""",
)
def write_usage_entries(spark, sf_dir):
    """Entries with id and metadata, one in ten in the error form."""
    path = workspace(spark, "usage-entries")
    key = F.col("event_id")
    ledger = tb.usage(spark, sf_dir).withColumns({
        "id": key,
        "error": F.when(key % 10 == 0, F.concat(F.lit("failed "), key.cast("string"))),
        "metadata": F.to_json(F.struct(key.alias("event"))),
    })
    sink.write_usage_jsonl(ledger, path)
    log = spark.read.schema(
        "id bigint, error string, user_id string, operation_type string, tokens struct<input:bigint,total:bigint>, metadata string"
    ).json(path)
    dash = F.lit("-")
    return log.select(
        "user_id", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("error", dash).alias("error"),
        F.coalesce("operation_type", dash).alias("operation_type"), F.col("tokens.input").alias("input_tokens"),
        F.coalesce("tokens.total", F.lit(-1)).alias("total_tokens"), "metadata",
    )


@query(
    "write_answer_csv",
    f"""WITH {tb.REPORTS_SQL} SELECT test_type, count(*) AS n FROM reports GROUP BY 1""",
)
def write_answer_csv(spark, sf_dir):
    folder = workspace(spark, "answers")
    result = tb.reports(spark, sf_dir).groupBy("test_type").agg(F.count(F.lit(1)).alias("n"))
    path = sink.write_answer_csv(result, "How many reports per type?", "SELECT ...", folder)
    return spark.read.option("header", True).schema("test_type string, n bigint").csv(path)


# ---- streams -------------------------------------------------------------------------


_BATCHES = 4


def _stream(spark, sf_dir, name, keep, at=None, shaken=0, repeated=False):
    """A table, by name or itself, as a stream of four batches: by time ``at``, or by hash without one.

    ``shaken`` seconds of disorder: rows are dealt by their time moved by up to half of that in
    either direction, so batches overlap in time and no row is later than ``shaken``. With
    ``repeated``, one row in eight comes twice, one half of these again in the next batch.
    """
    rows = (tb.table(spark, sf_dir, name) if isinstance(name, str) else name).select(*keep)
    if at is None:
        batch = F.pmod(F.xxhash64(keep[0]), F.lit(_BATCHES))
    else:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        first, last = rows.agg(F.min(micros), F.max(micros)).first()
        moved = micros + (F.pmod(F.xxhash64(*keep), F.lit(1000)) / 1000 - 0.5) * shaken * 1_000_000
        batch = F.floor((moved - F.lit(first)) * _BATCHES / F.lit(last - first + 1))
        batch = F.least(F.greatest(batch, F.lit(0)), F.lit(_BATCHES - 1))
    folder, files = workspace(spark, "stream"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_batch", batch)
    if repeated:
        again = F.pmod(F.xxhash64(F.lit("again"), *keep), F.lit(16))
        later = F.least(F.col("_batch") + (again == 0).cast("int"), F.lit(_BATCHES - 1))
        both = F.when(again < 2, F.array("_batch", later)).otherwise(F.array("_batch"))
        dealt = dealt.select(*keep, F.explode(both).alias("_batch"))
    staged = workspace(spark, "dealt")
    with passing_shuffles(spark):
        dealt.write.option("compression", "zstd").partitionBy("_batch").parquet(staged)
        dealt = spark.read.schema(dealt.schema).parquet(staged)
        # One append per batch: the file source takes files in the order of their times.
        for i in range(_BATCHES):
            one = dealt.where(F.col("_batch") == i).drop("_batch").repartition(files)
            one.write.mode("append").option("compression", "zstd").parquet(folder)
            discard(spark, f"{staged}/_batch={i}")
    # Files go once their batch is done: the folder is this stream's own.
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("cleanSource", "delete")
    return stream.parquet(folder)


def _finish(started) -> int:
    """Wait for all available data; the id of the last batch."""
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return max((p["batchId"] for p in started.recentProgress), default=0)


@query("stream_ingest_reports", f"WITH {obs_suite.OBSERVATIONS_SQL} SELECT * FROM observations")
def stream_ingest_reports(spark, sf_dir):
    """Four batches, one document in eight twice, merged into the stored observations."""
    path = workspace(spark, "ingest")
    docs = _stream(spark, sf_dir, "documents", ["doc_id", "text"], repeated=True).select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("report_id"), "text"
    )
    _finish(st.stream_ingest_reports(docs, path, f"{path}/checkpoint", buckets=16))
    return st.current_rows(spark, f"{path}/observations")


@query("stream_ingest_names", f"{names_suite._EVIDENCE} SELECT patient_id, source_report, name, confidence FROM evidence")
def stream_ingest_names(spark, sf_dir):
    """Reports with ids of persons: the stored name evidence after four batches with repeats."""
    path = workspace(spark, "ingest")
    texts = tb.report_texts(spark, sf_dir).select("report_id", "text")
    _finish(st.stream_ingest_reports(_stream(spark, sf_dir, texts, texts.columns, repeated=True), path, f"{path}/checkpoint", buckets=16))
    return st.current_rows(spark, f"{path}/name_evidence")


@query("stream_daily_costs", costs_suite.DAILY_SQL)
def stream_daily_costs(spark, sf_dir):
    path = workspace(spark, "daily")
    events = _stream(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"], "ts", 7200)
    _finish(st.stream_daily_costs(costs.calculate_cost(tb.calls_of(events)), f"{path}/out", f"{path}/checkpoint"))
    got = st.current_daily_costs(spark, f"{path}/out")
    return got.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "stream_session_activity",
    f"""SELECT * FROM ({chat_suite.SESSION_ACTIVITY_SQL})
WHERE session_end <= (SELECT strftime(max(ts) - INTERVAL 7200 SECOND, '%Y-%m-%d %H:%M:%S.%f') FROM events)""",
)
def stream_session_activity(spark, sf_dir):
    path = workspace(spark, "activity")
    _finish(st.stream_session_activity(
        _stream(spark, sf_dir, "events", ["user_id", "ts"], "ts", 7200), "user_id", f"{path}/out", f"{path}/checkpoint", "7200 seconds"
    ))
    got = spark.read.schema("user_id bigint, session_start timestamp, session_end timestamp, n_writes bigint").parquet(f"{path}/out")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return got.withColumns({c: F.date_format(c, fmt) for c in ("session_start", "session_end")})


@query(
    "stream_context_window",
    """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newer, max(ts) OVER (PARTITION BY user_id) AS last,
  (SELECT max(ts) FROM events) AS as_of FROM events),
c AS (SELECT *, sum(CASE WHEN newer >= ts + INTERVAL 3600 SECOND THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY recency ROWS UNBOUNDED PRECEDING) AS cuts FROM r)
SELECT user_id, event_id, recency FROM c WHERE recency <= 20 AND cuts = 0 AND last + INTERVAL 3600 SECOND > as_of""",
)
def stream_context_window(spark, sf_dir):
    """Four batches that overlap by up to two hours, with repeated rows."""
    path = workspace(spark, "context")
    messages = _stream(spark, sf_dir, "events", ["user_id", "event_id", "ts"], "ts", 7200, repeated=True)
    _finish(live.stream_context_window(
        messages, "user_id", "ts", "event_id", f"{path}/out", f"{path}/checkpoint", late="7200 seconds"
    ))
    return live.current_context(spark, f"{path}/out", "user_id").select("user_id", "event_id", "recency")
