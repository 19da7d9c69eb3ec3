"""Table maintenance and questions over patients and reports."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from reportloom.operators import documents as docs, merge, reports as op
from reportloom.schemas import REQUIRED_TABLES
from reportloom.session import workspace
from reportloom.sinks import tables as sink
from reportloom.sinks.tables import save_bucketed
from reportloom.suite import tables as tb
from reportloom.suite.registry import ORACLES, query

_R = f"WITH {tb.REPORTS_SQL}"
_PR = f"WITH {tb.PATIENTS_SQL}, {tb.REPORTS_SQL}"


def _day(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


# ---- file names and ids --------------------------------------------------------------

_NAMES_SQL = """
names AS (
  SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN 'P' || o_custkey || '_LFT_' || strftime(o_orderdate, '%Y%m%d') || '_grid.pdf'
    WHEN 1 THEN 'p' || o_custkey || '_CBC_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.PDF'
    WHEN 2 THEN 'P' || o_custkey || '_Lipid_Profile_' || strftime(o_orderdate, '%Y%m%d') || '_quest.pdf'
    WHEN 3 THEN 'P' || o_custkey || '_CMP_' || strftime(o_orderdate, '%Y') || '0230_grid.pdf'
    ELSE 'P' || o_custkey || '_LFT_' || strftime(o_orderdate, '%Y%m%d') || '.pdf' END AS name,
    o_custkey, o_orderdate
  FROM orders)"""


def _names(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    kind = key % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("P"), cust, F.lit("_LFT_"), day, F.lit("_grid.pdf")))
        .when(kind == 1, F.concat(F.lit("p"), cust, F.lit("_CBC_"), day, F.lit("_"), key.cast("string"), F.lit(".PDF")))
        .when(kind == 2, F.concat(F.lit("P"), cust, F.lit("_Lipid_Profile_"), day, F.lit("_quest.pdf")))
        .when(kind == 3, F.concat(F.lit("P"), cust, F.lit("_CMP_"), F.date_format("o_orderdate", "yyyy"), F.lit("0230_grid.pdf")))
        .otherwise(F.concat(F.lit("P"), cust, F.lit("_LFT_"), day, F.lit(".pdf")))
    )
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


@query(
    "parse_report_filename",
    f"""WITH {_NAMES_SQL}
SELECT o_orderkey, name, CASE WHEN k < 2 THEN left(name, 1) || o_custkey END AS patient_id,
  CASE k WHEN 0 THEN 'LFT' WHEN 1 THEN 'CBC' END AS test_type,
  CASE WHEN k < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS report_date,
  CASE WHEN k < 2 THEN left(name, length(name) - 4) END AS report_id,
  CASE WHEN k = 3 THEN 'bad_date' WHEN k IN (2, 4) THEN 'no_match' END AS reject_reason
FROM (SELECT *, o_orderkey % 5 AS k FROM names)""",
)
def parse_report_filename(spark, sf_dir):
    return _day(docs.parse_report_filename(_names(spark, sf_dir)), "report_date")


@query(
    "parse_report_filename_any_type",
    f"""WITH {_NAMES_SQL}
SELECT o_orderkey, name, CASE WHEN k <> 3 THEN left(name, 1) || o_custkey END AS patient_id,
  CASE k WHEN 0 THEN 'LFT' WHEN 1 THEN 'CBC' WHEN 2 THEN 'Lipid_Profile' WHEN 4 THEN 'LFT' END AS test_type,
  CASE WHEN k <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS report_date,
  CASE WHEN k <> 3 THEN left(name, length(name) - 4) END AS report_id,
  CASE WHEN k = 3 THEN 'bad_date' END AS reject_reason
FROM (SELECT *, o_orderkey % 5 AS k FROM names)""",
)
def parse_report_filename_any_type(spark, sf_dir):
    return _day(docs.parse_report_filename(_names(spark, sf_dir), strict=False), "report_date")


@query(
    "decompose_report_id",
    f"""WITH {_NAMES_SQL}
SELECT o_orderkey, left(name, 1) || o_custkey AS patient_id, string_split(name, '_')[2] AS test_type,
  CASE WHEN k IN (0, 1) THEN strftime(o_orderdate, '%Y-%m-%d') END AS report_date
FROM (SELECT *, o_orderkey % 5 AS k FROM names)""",
)
def decompose_report_id(spark, sf_dir):
    got = docs.decompose_report_id(_names(spark, sf_dir), "name")
    return _day(got, "report_date").drop("name")


# ---- maintenance ---------------------------------------------------------------------


@query(
    "first_last_seen",
    f"""{_R} SELECT patient_id, strftime(min(report_date), '%Y-%m-%d') AS min_date,
  strftime(max(report_date), '%Y-%m-%d') AS max_date FROM reports GROUP BY patient_id""",
)
def first_last_seen(spark, sf_dir):
    return _day(merge.first_last_seen(tb.reports(spark, sf_dir)), "min_date", "max_date")


@query(
    "backfill_seen_dates",
    f"""{_PR}
SELECT p.patient_id, p.full_name, strftime(min(report_date), '%Y-%m-%d') AS first_seen,
  strftime(max(report_date), '%Y-%m-%d') AS last_seen
FROM patients p LEFT JOIN reports r USING (patient_id) GROUP BY ALL""",
)
def backfill_seen_dates(spark, sf_dir):
    filled = merge.backfill_seen_dates(tb.patients(spark, sf_dir), tb.reports(spark, sf_dir))
    return _day(filled, "first_seen", "last_seen")


@query(
    "insert_if_absent",
    """SELECT 'P' || c_custkey AS patient_id, c_name AS full_name FROM customer
UNION ALL SELECT DISTINCT 'P' || l_partkey, CAST(NULL AS VARCHAR) FROM lineitem
WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def insert_if_absent(spark, sf_dir):
    def pid(c):
        return F.concat(F.lit("P"), F.col(c).cast("string")).alias("patient_id")

    have = tb.table(spark, sf_dir, "customer").select(pid("c_custkey"), F.col("c_name").alias("full_name"))
    new = tb.table(spark, sf_dir, "lineitem").select(pid("l_partkey"))
    return merge.insert_if_absent(have, new, ["patient_id"])


_UPDATE_ORDER = ["report_date", "src_path", "l_extendedprice", "l_linenumber"]


def _report_updates(spark, sf_dir):
    """A report per order line, up to three lines on one."""
    return tb.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("R"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).cast("string")).alias("report_id"),
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("patient_id"),
        F.col("l_returnflag").alias("test_type"),
        F.col("l_shipdate").cast("date").alias("report_date"),
        F.concat(F.lit("new/"), F.col("l_partkey").cast("string")).alias("src_path"),
        "l_extendedprice", "l_linenumber",
    )


@query(
    "upsert_reports",
    f"""{_R},
updates AS (
  SELECT 'R' || (l_orderkey + l_linenumber % 3) AS report_id, 'P' || l_suppkey AS patient_id, l_returnflag AS test_type,
         CAST(l_shipdate AS DATE) AS report_date, 'new/' || l_partkey AS src_path, l_extendedprice, l_linenumber
  FROM lineitem),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id
    ORDER BY report_date DESC, src_path DESC, l_extendedprice DESC, l_linenumber DESC) AS rn FROM updates) WHERE rn = 1),
pages AS (SELECT *, length(src_path) AS n_pages FROM reports)
SELECT coalesce(u.report_id, r.report_id) AS report_id, coalesce(u.patient_id, r.patient_id) AS patient_id,
  coalesce(u.test_type, r.test_type) AS test_type,
  strftime(coalesce(u.report_date, r.report_date), '%Y-%m-%d') AS report_date,
  coalesce(u.src_path, r.src_path) AS src_path, coalesce(r.n_pages, -1) AS pages
FROM pages r FULL OUTER JOIN latest u ON r.report_id = u.report_id""",
)
def upsert_reports(spark, sf_dir):
    have = tb.reports(spark, sf_dir).withColumn("pages", F.length("src_path"))
    merged = merge.upsert_reports(have, _report_updates(spark, sf_dir), _UPDATE_ORDER)
    return _day(merged.withColumn("pages", F.coalesce("pages", F.lit(-1))), "report_date")


@query("upsert_stored_reports", ORACLES["upsert_reports"])
def upsert_stored_reports(spark, sf_dir):
    """The same against a bucketed table, whose rows stay where they are; the new version is read back."""
    have = tb.reports(spark, sf_dir).withColumn("pages", F.length("src_path"))
    stored, later = (f"reports_{uuid.uuid4().hex}" for _ in range(2))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = save_bucketed(have, stored, ["report_id"], buckets, workspace(spark, stored))
    merged = merge.upsert_reports(target, _report_updates(spark, sf_dir), _UPDATE_ORDER)
    # Rows of the join lie in their buckets already.
    done = save_bucketed(merged, later, ["report_id"], buckets, workspace(spark, later), exchange=False)
    return _day(done.withColumn("pages", F.coalesce("pages", F.lit(-1))), "report_date")


@query(
    "replace_stored_observations",
    """WITH old AS (SELECT 'R' || o_orderkey AS report_id, 'total' AS analyte, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS value FROM orders),
new AS (SELECT 'R' || (l_orderkey * 2) AS report_id, 'Q' || l_partkey AS analyte, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem)
SELECT report_id, analyte, value, count(*) AS n FROM (
  SELECT * FROM old WHERE report_id NOT IN (SELECT report_id FROM new) UNION ALL SELECT * FROM new) GROUP BY ALL""",
)
def replace_stored_observations(spark, sf_dir):
    """Every order line as a new value of the report of twice its number, against a bucketed table."""

    def rid(c):
        return F.concat(F.lit("R"), c.cast("string")).alias("report_id")

    total = F.floor("o_totalprice").cast("string")
    old = tb.table(spark, sf_dir, "orders").select(rid(F.col("o_orderkey")), F.lit("total").alias("analyte"), total.alias("value"))
    new = tb.table(spark, sf_dir, "lineitem").select(
        rid(F.col("l_orderkey") * 2),
        F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("analyte"),
        F.col("l_quantity").cast("bigint").cast("string").alias("value"),
    )
    name = f"observations_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = merge.replace_observations(save_bucketed(old, name, ["report_id"], buckets, workspace(spark, name)), new)
    return merged.groupBy("report_id", "analyte", "value").agg(F.count(F.lit(1)).alias("n"))


_CREATED_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{field.split()[0]}' AS column_name, '{field.split()[1]}' AS data_type, "
    + (f"count({field.split()[0]}) AS filled FROM {table}" if table in ("patients", "reports") else "0")
    for table, fields in REQUIRED_TABLES.items()
    for field in fields.split(", ")
)


@query("ensure_tables", f"{_PR} {_CREATED_SQL}")
def ensure_tables(spark, sf_dir):
    """Tables made in a fresh database, filled, and read back column by column from the catalog."""
    database = f"records_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{workspace(spark, database)}'")
    if sink.missing_tables(spark, database=database) != sorted(REQUIRED_TABLES):
        raise AssertionError("a fresh database has tables")
    sink.ensure_tables(spark, init=True, database=database)
    tb.patients(spark, sf_dir).write.insertInto(f"{database}.patients")
    tb.reports(spark, sf_dir).write.insertInto(f"{database}.reports")
    sink.ensure_tables(spark, database=database)
    columns = [(t, c.name, c.dataType) for t in REQUIRED_TABLES for c in spark.catalog.listColumns(f"{database}.{t}")]
    known = spark.createDataFrame(columns, "table_name string, column_name string, data_type string")
    filled = None
    for name in REQUIRED_TABLES:
        table = spark.table(f"{database}.{name}")
        counts = F.create_map(*[x for c in table.columns for x in (F.lit(c), F.count(c))])
        one = table.agg(counts.alias("m")).select(F.lit(name).alias("table_name"), F.explode("m").alias("column_name", "filled"))
        filled = one if filled is None else filled.unionByName(one)
    return known.join(filled, ["table_name", "column_name"], "left")


@query(
    "replace_observations",
    """WITH old AS (SELECT 'R' || o_orderkey AS report_id, 'total' AS analyte, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS value FROM orders),
new AS (SELECT 'R' || l_orderkey AS report_id, 'Q' || l_partkey AS analyte, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value
        FROM lineitem WHERE l_returnflag = 'R')
SELECT report_id, analyte, value, count(*) AS n FROM (
  SELECT * FROM old WHERE report_id NOT IN (SELECT report_id FROM new) UNION ALL SELECT * FROM new) GROUP BY ALL""",
)
def replace_observations(spark, sf_dir):
    def rid(c):
        return F.concat(F.lit("R"), F.col(c).cast("string")).alias("report_id")

    total = F.floor("o_totalprice").cast("string")
    old = tb.table(spark, sf_dir, "orders").select(rid("o_orderkey"), F.lit("total").alias("analyte"), total.alias("value"))
    new = tb.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        rid("l_orderkey"),
        F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("analyte"),
        F.col("l_quantity").cast("bigint").cast("string").alias("value"),
    )
    merged = merge.replace_observations(old, new)
    return merged.groupBy("report_id", "analyte", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_by_content_hash",
    """WITH files AS (SELECT sha256(text) AS sha256, source || '/' || doc_id AS src_path, doc_id, lang FROM documents),
known AS (SELECT DISTINCT sha256 FROM files WHERE lang = 'de')
SELECT sha256, min(src_path) AS src_path, arg_min(doc_id, src_path) AS doc_id FROM files
WHERE sha256 NOT IN (SELECT sha256 FROM known) GROUP BY sha256""",
)
def dedupe_by_content_hash(spark, sf_dir):
    files = tb.table(spark, sf_dir, "documents").select(
        docs.content_hash(F.col("text")).alias("sha256"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("src_path"), "doc_id", "lang",
    )
    known = files.where("lang = 'de'").select("sha256")
    return merge.dedupe_by_content_hash(files.drop("lang"), known, ["src_path"])


@query(
    "foreign_key_violations",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def foreign_key_violations(spark, sf_dir):
    child = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merge.foreign_key_violations(child, tb.table(spark, sf_dir, "customer"), "l_partkey", "c_custkey")


@query(
    "cascade_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""",
)
def cascade_delete(spark, sf_dir):
    child = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    surviving = tb.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return merge.cascade_delete(child, surviving, "l_orderkey", "o_orderkey")


@query(
    "unprocessed_reports",
    """SELECT o_orderkey AS report_id FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""",
)
def unprocessed_reports(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "report_id")
    source = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    return merge.unprocessed(source, [lines.where("l_returnflag = 'A'"), lines.where("l_linestatus = 'F'")])


@query(
    "parse_cache_lookup",
    """WITH cache AS (SELECT md5(text) AS content_hash, min(n_chars) AS n_blocks FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT doc_id, n_blocks IS NOT NULL AS cache_hit, coalesce(n_blocks, -1) AS n_blocks
FROM documents LEFT JOIN cache ON content_hash = md5(text)""",
)
def parse_cache_lookup(spark, sf_dir):
    files = tb.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("content_hash"))
    cache = files.where("lang = 'en'").groupBy("content_hash").agg(F.min("n_chars").alias("n_blocks"))
    found = merge.parse_cache_lookup(files.select("doc_id", "content_hash"), cache)
    return found.select("doc_id", "cache_hit", F.coalesce("n_blocks", F.lit(-1)).alias("n_blocks"))


@query(
    "retry_failed",
    """SELECT 'f' || event_id AS path, CASE WHEN event_type = 'error' THEN value < 50 ELSE true END AS ok,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS attempt FROM events""",
)
def retry_failed(spark, sf_dir):
    path = F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path")
    events = tb.table(spark, sf_dir, "events")
    first = events.select(path, (F.col("event_type") != "error").alias("ok"))
    second = events.select(path, (F.col("value") < 50).alias("ok"))
    return merge.retry_failed(first, second)


@query("missing_tables", "SELECT p_partkey AS id FROM part EXCEPT SELECT o_custkey FROM orders")
def missing_tables(spark, sf_dir):
    required = tb.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return merge.missing_keys(required, tb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


# ---- questions -----------------------------------------------------------------------


@query(
    "patients_with_reports",
    f"""{_PR} SELECT count(DISTINCT patients.patient_id) AS total_patients
FROM patients JOIN reports ON patients.patient_id = reports.patient_id
WHERE report_date >= DATE '1997-01-01' AND report_date < DATE '1998-01-01'""",
)
def patients_with_reports(spark, sf_dir):
    return op.patients_with_reports(
        tb.patients(spark, sf_dir), tb.reports(spark, sf_dir), dt.date(1997, 1, 1), dt.date(1998, 1, 1)
    )


@query(
    "half_open_date_range",
    f"""{_R} SELECT report_id, strftime(report_date, '%Y-%m-%d') AS report_date FROM reports
WHERE report_date >= DATE '1996-02-01' AND report_date < DATE '1996-03-01'""",
)
def half_open_date_range(spark, sf_dir):
    got = op.half_open_date_range(tb.reports(spark, sf_dir), "report_date", dt.date(1996, 2, 1), dt.date(1996, 3, 1))
    return _day(got.select("report_id", "report_date"), "report_date")


@query(
    "report_scope",
    f"""{_R} SELECT report_id, strftime(report_date, '%Y-%m-%d') AS report_date FROM reports
WHERE patient_id = 'P7' AND test_type IN ('1-URGENT', '2-HIGH', '5-LOW') AND year(report_date) = 1997""",
)
def report_scope(spark, sf_dir):
    got = op.report_scope(tb.reports(spark, sf_dir), "P7", ["1-URGENT", "2-HIGH", "5-LOW"], year=1997)
    return _day(got.select("report_id", "report_date"), "report_date")


@query(
    "patients_per_year",
    f"{_R} SELECT CAST(year(report_date) AS INT) AS year, count(DISTINCT patient_id) AS patients FROM reports GROUP BY 1",
)
def patients_per_year(spark, sf_dir):
    return op.patients_per_year(tb.reports(spark, sf_dir))


def _stored(spark, rows, name):
    """``rows`` written once, as a roll-up that is kept between runs."""
    path = workspace(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "patients_rolled_up",
    f"""{_R}, units AS (SELECT unnest(['month', 'quarter', 'year']) AS unit)
SELECT unit, strftime(date_trunc(unit, report_date), '%Y-%m-%d') AS period, count(DISTINCT patient_id) AS patients
FROM reports, units WHERE report_date IS NOT NULL GROUP BY 1, 2""",
)
def patients_rolled_up(spark, sf_dir):
    """Months from the reports; quarters and years from the months' bitmaps alone."""
    numbered = tb.reports(spark, sf_dir).withColumn("patient_no", F.expr("cast(substring(patient_id, 2) as bigint)"))
    months = _stored(spark, op.patient_bitmaps(numbered), "months")
    quarters = op.roll_up_bitmaps(months, "quarter")
    every = None
    for unit, maps in (("month", months), ("quarter", quarters), ("year", op.roll_up_bitmaps(quarters, "year"))):
        counted = _day(op.patients_of_bitmaps(maps).withColumn("unit", F.lit(unit)), "period")
        every = counted if every is None else every.unionByName(counted)
    return every


@query(
    "patients_rolled_up_approximately",
    f"""{_R} SELECT CAST(year(report_date) AS INT) AS year, true AS near FROM reports WHERE report_date IS NOT NULL GROUP BY 1""",
)
def patients_rolled_up_approximately(spark, sf_dir):
    """Years from the months' sketches; ``near`` if within four standard errors of the exact number."""
    rows = tb.reports(spark, sf_dir)
    months = _stored(spark, op.patient_sketches(rows), "sketches")
    rough = op.patients_of_sketches(op.roll_up_sketches(months)).select(F.year("period").alias("year"), F.col("patients").alias("rough"))
    exact = op.patients_per_year(rows)
    return exact.join(rough, "year", "left").select(
        "year", (F.abs(F.col("rough") - F.col("patients")) <= F.col("patients") * 4 / 128).alias("near")
    )


@query(
    "last_report_date",
    f"{_R} SELECT patient_id, strftime(max(report_date), '%Y-%m-%d') AS last_seen_date FROM reports GROUP BY 1",
)
def last_report_date(spark, sf_dir):
    return _day(op.last_report_date(tb.reports(spark, sf_dir)), "last_seen_date")


@query(
    "report_trend",
    f"""{_R} SELECT strftime(report_date, '%Y-%m-%d') AS report_date, count(DISTINCT report_id) AS report_count
FROM reports WHERE patient_id = 'P7' AND test_type = '1-URGENT' GROUP BY 1""",
)
def report_trend(spark, sf_dir):
    return _day(op.report_trend(tb.reports(spark, sf_dir), "P7", "1-URGENT"), "report_date")


@query(
    "report_trends",
    f"""{_R} SELECT patient_id, test_type, strftime(report_date, '%Y-%m-%d') AS report_date,
  count(DISTINCT report_id) AS report_count FROM reports GROUP BY 1, 2, 3""",
)
def report_trends(spark, sf_dir):
    return _day(op.report_trends(tb.reports(spark, sf_dir)), "report_date")


def _candidates(spark, sf_dir):
    rows = tb.reports(spark, sf_dir).drop("src_path", "pages").withColumn(
        "report_date", F.when(F.col("test_type") != "5-LOW", F.col("report_date"))
    )
    is_text = F.col("test_type").isin("1-URGENT", "5-LOW")
    return op.prefer_text_else_pdf(rows.where(is_text), rows.where(~is_text))


_CANDIDATES_SQL = f"""{_R}, candidates AS (
  SELECT report_id, patient_id, test_type, CASE WHEN test_type <> '5-LOW' THEN report_date END AS report_date,
         test_type IN ('1-URGENT', '5-LOW') AS is_text FROM reports)"""


@query(
    "prefer_text_else_pdf",
    f"{_CANDIDATES_SQL} SELECT is_text, test_type, count(*) AS n, count(report_date) AS dated FROM candidates GROUP BY 1, 2",
)
def prefer_text_else_pdf(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("is_text", "test_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("report_date").alias("dated")
    )


@query(
    "latest_report",
    f"""{_CANDIDATES_SQL}
SELECT patient_id, report_id, test_type, strftime(report_date, '%Y-%m-%d') AS report_date, is_text FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id
    ORDER BY is_text DESC, report_date DESC NULLS LAST, report_id DESC) AS rn FROM candidates) WHERE rn = 1""",
)
def latest_report(spark, sf_dir):
    return _day(op.latest_report(_candidates(spark, sf_dir), ["patient_id"]), "report_date")


@query(
    "scan_summary",
    """WITH files AS (SELECT sha256(text) AS sha256, CASE WHEN lang <> 'fr' THEN doc_id END AS report_id, source FROM documents),
known AS (SELECT DISTINCT sha256 FROM files WHERE source = 'src1'),
m AS (SELECT f.sha256, count(*) AS n, any_value(k.sha256) AS k FROM files f LEFT JOIN known k USING (sha256)
      WHERE report_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM files) AS scanned, CAST(sum(n) AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS processed,
  CAST(sum(CASE WHEN k IS NOT NULL THEN n ELSE n - 1 END) AS BIGINT) AS already_tracked FROM m""",
)
def scan_summary(spark, sf_dir):
    files = tb.table(spark, sf_dir, "documents").select(
        docs.content_hash(F.col("text")).alias("sha256"),
        F.when(F.col("lang") != "fr", F.col("doc_id")).alias("report_id"), "source",
    )
    known = files.where("source = 'src1'").select("sha256").distinct()
    return op.scan_summary(files.drop("source"), known)


def _outcomes(spark, sf_dir):
    return tb.table(spark, sf_dir, "events").select(
        F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("error"),
        (F.col("value") / 100).alias("seconds"), "event_id",
    )


@query(
    "batch_summary",
    """SELECT count(*) AS total_files, count(*) FILTER (event_type <> 'error') AS successful,
  count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*) AS success_rate FROM events""",
)
def batch_summary(spark, sf_dir):
    return op.batch_summary(_outcomes(spark, sf_dir))


@query(
    "batch_errors",
    """SELECT event_type || '/' || event_id AS path, 'value ' || CAST(floor(value) AS BIGINT) AS error
FROM events WHERE event_type = 'error'""",
)
def batch_errors(spark, sf_dir):
    return op.batch_errors(_outcomes(spark, sf_dir))


@query(
    "knowledge_insert_summary",
    """WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped'
                              ELSE 'success' END AS status FROM events)
SELECT 'status' AS level, status, count(*) AS n_files, count(*) FILTER (status = 'success') AS successful FROM r GROUP BY status
UNION ALL SELECT 'total', NULL, count(*), count(*) FILTER (status = 'success') FROM r""",
)
def knowledge_insert_summary(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("success")
    return op.knowledge_insert_summary(tb.table(spark, sf_dir, "events").select(status.alias("status")))


@query(
    "parse_log_summary",
    """SELECT CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status, count(*) AS n_files,
  round(avg(CAST(round(value) AS INT)), 6) AS avg_sec, max(round(value)) AS max_sec,
  quantile_disc(round(value), 0.5) AS median_sec FROM events GROUP BY 1""",
)
def parse_log_summary(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "fail").otherwise("ok")
    log = tb.table(spark, sf_dir, "events").select(status.alias("status"), F.round("value").alias("duration_sec"))
    return op.parse_log_summary(log)


@query(
    "current_doc_status",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id""",
)
def current_doc_status(spark, sf_dir):
    states = tb.table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    return docs.current_doc_status(states, "user_id", "status", ["ts", "event_id"])
