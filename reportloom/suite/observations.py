"""Observation readers and value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import labs
from reportloom.operators import observations as op
from reportloom.session import spread
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_V = labs.VALUE_ROW

DOC_LINES_SQL = r"""
doc_lines AS (
  SELECT doc_id, line_no, trim(line, e' \t\r 　') AS line
  FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line,
               generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS line_no
        FROM documents)
)"""

OBSERVATIONS_SQL = f"""{DOC_LINES_SQL},
hits AS (
  SELECT doc_id, line_no, regexp_extract(line, '{_V}', ['a', 'v', 'u', 'f', 'r']) AS m
  FROM doc_lines WHERE regexp_matches(line, '{_V}')),
obs AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS obs_no,
         trim(m.a) AS analyte, m.v AS value, m.u AS unit, m.r AS ref_range
  FROM hits WHERE lower(m.a) NOT IN ('name', 'patient', 'value', 'result', 'reference')),
observations AS (SELECT 'D' || doc_id AS report_id, obs_no, analyte, value, unit, ref_range FROM obs)"""

LIMITED_SQL = OBSERVATIONS_SQL.replace("WHERE regexp_matches", "WHERE length(line) <= 200 AND regexp_matches").replace(
    "FROM obs)", "FROM obs WHERE obs_no < 200)"
)


def documents(spark, sf_dir):
    return spread(tb.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("report_id"), "text"
    )


@query("extract_observations", f"WITH {OBSERVATIONS_SQL} SELECT * FROM observations")
def extract_observations(spark, sf_dir):
    return op.extract_observations(documents(spark, sf_dir))


@query("extract_observations_limited", f"WITH {LIMITED_SQL} SELECT * FROM observations")
def extract_observations_limited(spark, sf_dir):
    """With both limits of the known loader: lines up to 200 characters, 200 rows a report."""
    return op.extract_observations(documents(spark, sf_dir), max_rows=200, max_line=200)


REPORT_OBSERVATIONS_SQL = f"""WITH {tb.REPORT_TEXTS_SQL},
rows AS (
  SELECT report_id, unnest(list_filter([
      {{'n': 0, 'analyte': 'Quantity', 'value': regexp_extract(text, 'Quantity (\\d+[.]5)', 1),
        'unit': 'kg', 'ref_range': regexp_extract(text, 'kg (\\d+ - \\d+)', 1)}},
      {{'n': 1, 'analyte': 'Batch', 'value': regexp_extract(text, 'Batch (\\d+)', 1), 'unit': '', 'ref_range': ''}}
    ], lambda x: x.value <> '')) AS o, text FROM report_texts)
SELECT report_id,
       o.n + (CASE WHEN regexp_matches(text, '^Name: \\w+ \\w+ 42') OR regexp_matches(text, ' DOB 01') THEN 1 ELSE 0 END) AS obs_no,
       o.analyte AS analyte, o.value AS value, o.unit AS unit, o.ref_range AS ref_range
FROM rows
UNION ALL
SELECT report_id, 0, regexp_extract(text, '^Name: (\\w+ \\w+) 42', 1), '42', '', ''
FROM report_texts WHERE regexp_matches(text, '^Name: \\w+ \\w+ 42')
UNION ALL
SELECT report_id, 0, regexp_extract(text, 'Last Name: (\\w+ DOB) 01', 1), '01', '/', ''
FROM report_texts WHERE regexp_matches(text, ' DOB 01')"""


@query("extract_report_observations", REPORT_OBSERVATIONS_SQL)
def extract_report_observations(spark, sf_dir):
    return op.extract_observations(tb.report_texts(spark, sf_dir))


@query(
    "explode_lines",
    f"""WITH {DOC_LINES_SQL}
SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars
FROM doc_lines WHERE line <> '' AND length(line) <= 200 GROUP BY doc_id""",
)
def explode_lines(spark, sf_dir):
    from reportloom.operators.documents import explode_lines as lines

    return (
        lines(tb.table(spark, sf_dir, "documents"), keep=("doc_id",))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    )


@query(
    "header_stop_filter",
    """SELECT event_type, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'view' THEN 'Value' WHEN 'error' THEN 'RESULT' WHEN 'click' THEN 'name '
              ELSE event_type END AS analyte, event_type FROM events)
WHERE lower(analyte) NOT IN ('name', 'patient', 'value', 'result', 'reference') GROUP BY event_type""",
)
def header_stop_filter(spark, sf_dir):
    kind = F.col("event_type")
    analyte = F.when(kind == "view", "Value").when(kind == "error", "RESULT").when(kind == "click", "name ").otherwise(kind)
    return (
        tb.table(spark, sf_dir, "events")
        .where(~labs.is_header_word(analyte))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "first_200_per_report",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem)
WHERE rn <= 200""",
)
def first_200_per_report(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return op.first_rows_per_report(
        tb.table(spark, sf_dir, "lineitem").select("l_suppkey", *order), ["l_suppkey"], order
    ).drop("l_extendedprice")


@query(
    "table_observations",
    f"""WITH {tb.REPORT_TEXTS_SQL},
cells AS (
  SELECT report_id, regexp_extract(text, '(?m)^\\| (Brand[^|]*) \\| (\\d+) \\| mg/dL \\| (\\d+-\\d+) \\| (\\w+) \\|$',
                                   ['a', 'v', 'r', 's']) AS m FROM report_texts)
SELECT report_id, 0 AS table_no, 0 AS row_no, m.a AS analyte, m.v AS value,
       'mg/dL' AS unit, m.r AS ref_range, m.s AS status, CAST(m.v AS DOUBLE) AS value_num,
       CASE m.s WHEN 'B' THEN 'BORDERLINE' ELSE 'HIGH' END AS status_code
FROM cells""",
)
def table_observations(spark, sf_dir):
    return op.table_observations(tb.report_texts(spark, sf_dir))


# Layouts of real reports: a banner inside the table, thousands marks, bounds, words, a range note.
_LAYOUTS_SQL = """
SELECT 'R' || o_orderkey AS report_id, o_custkey,
  substr(CAST(1000 + o_custkey % 9000 AS VARCHAR), 1, 1) || ',' || substr(CAST(1000 + o_custkey % 9000 AS VARCHAR), 2) AS big FROM orders"""


@query(
    "table_layouts",
    f"""WITH t AS ({_LAYOUTS_SQL})
SELECT report_id, 0 AS table_no, u.row_no::INT AS row_no, u.analyte AS analyte, u.value AS value, u.unit AS unit, u.ref AS ref_range,
  u.status AS status, u.num AS value_num, u.code AS status_code
FROM (SELECT report_id, unnest([
  {{'row_no': 2, 'analyte': 'Platelets', 'value': big, 'unit': '/uL', 'ref': '150-450', 'status': 'HIGH', 'num': CAST(replace(big, ',', '') AS DOUBLE), 'code': 'HIGH'}},
  {{'row_no': 3, 'analyte': 'TSH', 'value': '<0.01', 'unit': 'uIU/mL', 'ref': '0.4-4', 'status': 'L', 'num': NULL, 'code': 'LOW'}},
  {{'row_no': 5, 'analyte': 'HBsAg', 'value': 'Negative', 'unit': '', 'ref': '', 'status': '', 'num': NULL, 'code': NULL}},
  {{'row_no': 6, 'analyte': 'Iron', 'value': CAST(o_custkey AS VARCHAR) || '.25', 'unit': 'ug/dL', 'ref': '60 - 170', 'status': 'N',
    'num': CAST(CAST(o_custkey AS VARCHAR) || '.25' AS DOUBLE), 'code': 'NORMAL'}}]) AS u FROM t)""",
)
def table_layouts(spark, sf_dir):
    orders = spread(tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    digits = (F.lit(1000) + F.col("o_custkey") % 9000).cast("string")
    big = F.concat(F.substring(digits, 1, 1), F.lit(","), F.substring(digits, 2, 3))
    text = F.concat(
        F.lit("| stray | 5 |\n\n| Test | Result | Unit | Reference | Status |\n|---|---|---|---|---|\n"),
        F.lit("| PATIENT: DOE, JANE TEST DATE: 01/02/2024 | DOB: 01/02/1970 | AGE: 68 | | |\n| DOB | 01/02/1970 | | | |\n"),
        F.lit("| Platelets | "), big, F.lit(" | /uL | 150-450 | HIGH |\n| TSH | <0.01 | uIU/mL | 0.4-4 | L |\n"),
        F.lit("| Ref: 30-100 | 5 | | | |\n| HBsAg | Negative | | | |\n| Iron | "), F.col("o_custkey").cast("string"),
        F.lit(".25 | ug/dL | 60 - 170 | N |\n"), F.repeat(F.lit("a long line after the table "), 20),
    )
    return op.table_observations(orders.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report_id"), text.alias("text")))


@query(
    "card_layouts",
    f"""WITH t AS ({_LAYOUTS_SQL})
SELECT report_id, 0 AS card_no, 'Platelets' AS analyte, big AS value, '/uL' AS unit, '150-450' AS ref_range, 'HIGH' AS status,
  CAST(replace(big, ',', '') AS DOUBLE) AS value_num FROM t
UNION ALL SELECT report_id, 1, 'TSH', '<0.01', 'uIU/mL', '0.4-4', 'LOW', NULL FROM t
UNION ALL SELECT report_id, 2, 'HBsAg', 'Negative', '', 'Negative', 'NORMAL', NULL FROM t""",
)
def card_layouts(spark, sf_dir):
    orders = spread(tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    digits = (F.lit(1000) + F.col("o_custkey") % 9000).cast("string")
    text = F.concat(
        F.lit("Lab Results\n\n## Platelets\n"), F.substring(digits, 1, 1), F.lit(","), F.substring(digits, 2, 3),
        F.lit(" /uL\nRef: 150-450\nHIGH\nTSH\n<0.01 uIU/mL\nRef: 0.4-4\nLow\nHBsAg\nNegative\nRef: Negative\nNormal\n"),
    )
    return op.card_observations(orders.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report_id"), text.alias("text")))


@query(
    "header_in_one_line",
    """SELECT 'R' || o_orderkey AS report_id, 'SMITH, JOHN' AS patient, 'P' || o_custkey AS patient_id, '1970-01-02' AS dob,
  'M' AS gender, CAST(NULL AS VARCHAR) AS panel, strftime(o_orderdate, '%Y-%m-%d') AS collected, CAST(NULL AS VARCHAR) AS report_date,
  CAST(NULL AS VARCHAR) AS specimen, CAST(o_orderkey AS VARCHAR) AS accession FROM orders""",
)
def header_in_one_line(spark, sf_dir):
    """All labels on one line of far more than 200 characters."""
    orders = spread(tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    text = F.concat(
        F.lit("Patient: SMITH, JOHN DOB: 01/02/1970 Gender: M ID: P"), F.col("o_custkey").cast("string"), F.repeat(F.lit(" . . ."), 60),
        F.lit(" Collected: "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" Accession: "), F.col("o_orderkey").cast("string"),
    )
    got = op.header_fields(orders.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report_id"), text.alias("text")))
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("dob", "collected", "report_date")})


_CARD_SQL = """
cards AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, l_returnflag
  FROM lineitem)"""


@query(
    "card_observations",
    f"""WITH {_CARD_SQL}
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS report_id, 0 AS card_no, 'Part ' || l_partkey AS analyte,
       CAST(q AS VARCHAR) AS value, 'mg/dL' AS unit, '10-30' AS ref_range,
       CASE WHEN q < 10 THEN 'LOW' WHEN q > 30 THEN 'HIGH' ELSE 'NORMAL' END AS status, CAST(q AS DOUBLE) AS value_num
FROM cards
UNION ALL
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey, 1, 'Supplier', '-' || (l_suppkey + 1), '%', '1 - 2',
       CASE WHEN l_returnflag = 'R' THEN 'LOW' END, CAST(-l_suppkey - 1 AS DOUBLE) FROM cards""",
)
def card_observations(spark, sf_dir):
    needed = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    lines = spread(tb.table(spark, sf_dir, "lineitem").select(*needed))
    q = F.col("l_quantity").cast("int")
    status = F.when(q < 10, "LOW").when(q > 30, "HIGH").otherwise("NORMAL")
    text = F.concat(
        F.lit("Lab Results Summary\n\n## Part "), F.col("l_partkey").cast("string"),
        F.lit("\n\nMILLER, ANN | 10/10/2023\n\n"), q.cast("string"), F.lit(" mg/dL\n\nRef: 10-30\n\n"), status,
        F.lit("\n\nSupplier\n\nLEE, BO | 1/2/2023 -"), (F.col("l_suppkey") + 1).cast("string"), F.lit(" %\nRef: 1 - 2\n"),
        F.when(F.col("l_returnflag") == "R", "note\nlow\n").otherwise("note\n"),
    )
    report = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return op.card_observations(lines.select(report.alias("report_id"), text.alias("text")))


@query(
    "bar_observations",
    """SELECT 'R' || o_orderkey AS report_id, 0 AS row_no, 'Iron' AS analyte, CAST(o_custkey AS VARCHAR) AS value, 'ug/dL' AS unit,
       CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE '-' END AS status, CAST(o_custkey AS DOUBLE) AS value_num FROM orders
UNION ALL SELECT 'R' || o_orderkey, 1, 'Vitamin D, 25', '-' || (o_orderkey + 1), 'ng/mL',
       CASE WHEN o_orderkey % 3 = 0 THEN 'NORMAL' ELSE '-' END, CAST(-o_orderkey - 1 AS DOUBLE) FROM orders""",
)
def bar_observations(spark, sf_dir):
    orders = spread(tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    one, two = F.col("o_custkey").cast("string"), F.concat(F.lit("-"), (F.col("o_orderkey") + 1).cast("string"))
    marked = F.col("o_orderkey") % 3 == 0
    high, normal = F.when(marked, "\nHIGH").otherwise(""), F.when(marked, "\nNORMAL").otherwise("")
    rows = F.concat(F.lit("## X\n\nIron\n\n"), one, F.lit("\nug/dL"), high, F.lit("\nVitamin D, 25\n"), two, F.lit("\nng/mL"), normal)
    columns = F.concat(F.lit("## X\nIron\n\nVitamin D, 25\n"), one, F.lit("\n"), two, F.lit("\nug/dL\nng/mL"), high, normal, F.lit("\n![Image](x)"))
    text = F.when(F.col("o_orderkey") % 2 == 0, rows).otherwise(columns)
    report = F.concat(F.lit("R"), F.col("o_orderkey").cast("string"))
    got = op.bar_observations(orders.select(report.alias("report_id"), text.alias("text")))
    return got.withColumn("status", F.coalesce("status", F.lit("-")))


@query(
    "header_fields",
    """SELECT 'R' || o_orderkey AS report_id, 'LEE, ANN' AS patient, 'P' || o_custkey AS patient_id,
       strftime(o_orderdate, '%Y-%m-%d') AS dob, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       o_orderpriority AS panel, strftime(o_orderdate, '%Y-%m-%d') AS collected,
       CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS report_date,
       'SP' || o_custkey AS specimen, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS accession
FROM orders""",
)
def header_fields(spark, sf_dir):
    orders = spread(tb.table(spark, sf_dir, "orders"))
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("## Patient Information\n\n**Patient:** LEE, ANN\nDOB: "), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit("  Age: 25\nGender: "), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("M"),
        F.lit("    Patient ID: P"), cust, F.lit("\nTest Panel: "), "o_orderpriority",
        F.lit("\nCollection Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\nReport Date: "), F.date_format("o_orderdate", "MMMM d, yyyy"))).otherwise(""),
        F.lit("\nSpecimen ID: SP"), cust,
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("    Accession: "), key)).otherwise(""),
    )
    got = op.header_fields(orders.select(F.concat(F.lit("R"), key).alias("report_id"), text.alias("text")))
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("dob", "collected", "report_date")}
    return got.withColumns(dates)


@query(
    "flag_value",
    """SELECT l_returnflag, flag, count(*) AS n FROM (
  SELECT l_returnflag, CASE WHEN l_linestatus = 'X' THEN NULL WHEN l_quantity < 10 THEN 'LOW'
                            WHEN l_quantity > 30.5 THEN 'HIGH' ELSE 'NORMAL' END AS flag FROM lineitem)
GROUP BY l_returnflag, flag""",
)
def flag_value(spark, sf_dir):
    flag = labs.flag_value(F.col("l_quantity").cast("string"), F.lit("10 - 30.5"))
    return tb.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_test_type",
    """SELECT p_type, p_brand, count(*) AS n, CASE p_type WHEN 'ECONOMY' THEN 'RFT' WHEN 'SMALL' THEN 'Lipid_Profile'
   WHEN 'STANDARD' THEN 'Thyroid' ELSE 'General' END AS test_type
FROM part GROUP BY p_type, p_brand""",
)
def normalize_test_type(spark, sf_dir):
    kind = F.col("p_type")
    said = (
        F.when(kind == "ECONOMY", "Kidney function")
        .when(kind == "SMALL", "total CHOLESTEROL")
        .when(kind == "STANDARD", "serum TSH level")
        .otherwise(kind)
    )
    typed = tb.table(spark, sf_dir, "part").withColumn("test_type", labs.normalize_test_type(said))
    return typed.groupBy("p_type", "p_brand", "test_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""",
)
def clean_date(spark, sf_dir):
    shape = F.col("o_orderkey") % 4
    text = (
        F.when(shape == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(shape == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(shape == 2, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    return tb.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(labs.clean_date(text), "yyyy-MM-dd").alias("d")
    )


@query(
    "analyte_trend",
    """SELECT 'P' || o_custkey AS patient_id, l_orderkey, l_linenumber, l_partkey, l_quantity AS value_num,
  lag(l_quantity) OVER w AS prev_value, l_quantity - lag(l_quantity) OVER w AS change
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)""",
)
def analyte_trend(spark, sf_dir):
    lines, orders = tb.table(spark, sf_dir, "lineitem"), tb.table(spark, sf_dir, "orders")
    obs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("patient_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice",
        F.col("l_quantity").alias("value_num"),
    )
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return op.analyte_trend(obs, ["patient_id"], "l_shipdate", "value_num", tie).drop("l_shipdate", "l_extendedprice")
