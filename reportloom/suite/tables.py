"""How the given tables stand in for the record tables.

Each binding has a Spark form and the same thing as SQL, so a query and its check start
from equal rows. All of them read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- report texts -------------------------------------------------------------------

REPORT_TEXTS_SQL = """
report_texts AS (
  SELECT 'P' || l_suppkey AS patient_id,
         'P' || l_suppkey || '_' || p_type || '_' || strftime(l_shipdate, '%Y%m%d') || '_o'
           || l_orderkey || '_' || l_linenumber AS report_id,
         CASE l_linenumber
           WHEN 1 THEN 'Name: ' || p_name
           WHEN 2 THEN 'Name: ' || upper(p_name) || ' 42'
           WHEN 3 THEN '| Patient | ' || upper(split_part(p_name, ' ', 2)) || ', '
                       || split_part(p_name, ' ', 1) || ' |'
           WHEN 4 THEN 'First Name: ' || split_part(p_name, ' ', 1) || chr(10)
                       || 'Last Name: ' || split_part(p_name, ' ', 2) || ' DOB 01/02/1970'
           WHEN 5 THEN 'Name:' || chr(10) || p_name
           WHEN 6 THEN 'Patient - ' || p_name
           ELSE 'Ordered part ' || p_name END
         || chr(10) || chr(10) || 'Quantity ' || CAST(l_quantity AS INT) || '.5 kg '
         || CAST(p_size AS INT) || ' - ' || CAST(p_size + 20 AS INT)
         || chr(10) || '| Test | Result | Unit | Reference | Status |'
         || chr(10) || '|------|--------|------|-----------|--------|'
         || chr(10) || '| ' || p_brand || ' | ' || CAST(l_quantity AS INT) || ' | mg/dL | '
         || p_size || '-' || (p_size + 20) || ' | '
         || CASE WHEN l_returnflag = 'R' THEN 'HIGH' ELSE 'B' END || ' |'
         || chr(10) || 'Batch ' || l_suppkey AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short report per order line: name line, value line, pipe table."""
    needed = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
    lines = spread(table(spark, sf_dir, "lineitem").select(*needed), *needed)
    parts = table(spark, sf_dir, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    number = F.col("l_linenumber")
    head = (
        F.when(number == 1, F.concat(F.lit("Name: "), "p_name"))
        .when(number == 2, F.concat(F.lit("Name: "), F.upper("p_name"), F.lit(" 42")))
        .when(number == 3, F.concat(F.lit("| Patient | "), F.upper(last), F.lit(", "), first, F.lit(" |")))
        .when(
            number == 4,
            F.concat(F.lit("First Name: "), first, F.lit("\nLast Name: "), last, F.lit(" DOB 01/02/1970")),
        )
        .when(number == 5, F.concat(F.lit("Name:\n"), "p_name"))
        .when(number == 6, F.concat(F.lit("Patient - "), "p_name"))
        .otherwise(F.concat(F.lit("Ordered part "), "p_name"))
    )
    quantity = F.col("l_quantity").cast("int").cast("string")
    low, high = F.col("p_size").cast("string"), (F.col("p_size") + 20).cast("string")
    status = F.when(F.col("l_returnflag") == "R", "HIGH").otherwise("B")
    text = F.concat(
        head, F.lit("\n\nQuantity "), quantity, F.lit(".5 kg "), low, F.lit(" - "), high,
        F.lit("\n| Test | Result | Unit | Reference | Status |"),
        F.lit("\n|------|--------|------|-----------|--------|"),
        F.lit("\n| "), "p_brand", F.lit(" | "), quantity, F.lit(" | mg/dL | "),
        low, F.lit("-"), high, F.lit(" | "), status, F.lit(" |"),
        F.lit("\nBatch "), F.col("l_suppkey").cast("string"),
    )
    patient = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))
    report = F.concat_ws(
        "_", patient, "p_type", F.date_format("l_shipdate", "yyyyMMdd"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), number.cast("string"),
    )
    return joined.select(patient.alias("patient_id"), report.alias("report_id"), text.alias("text"))


# The evidence rules restated line by line, for checking.
EVIDENCE_SQL = REPORT_TEXTS_SQL + r""",
evidence AS (
  SELECT patient_id, report_id AS source_report, nm AS raw,
         array_to_string(list_transform(string_split(nm, ' '),
           lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name,
         confidence
  FROM (
    SELECT patient_id, report_id,
      CASE
        WHEN regexp_matches(text, '^First Name: ') THEN
          regexp_extract(text, 'First Name: (\w+)', 1) || ' ' || regexp_extract(text, 'Last Name: (\w+)', 1)
        WHEN regexp_matches(text, '^\| Patient') THEN
          regexp_extract(text, '^\| Patient \| (\w+), (\w+)', 2) || ' ' ||
          regexp_extract(text, '^\| Patient \| (\w+), (\w+)', 1)
        WHEN regexp_matches(text, '^Patient - ') THEN regexp_extract(text, '^Patient - (\w+ \w+)', 1)
        WHEN regexp_matches(text, '^Name:') THEN regexp_extract(text, '^Name:\s+(\w+ [A-Za-z]+)', 1)
      END AS nm,
      CASE
        WHEN regexp_matches(text, '^First Name: ') THEN 0.98
        WHEN regexp_matches(text, '^Name: \w+ \w+ 42') THEN 0.94
        ELSE 0.93 END::DOUBLE AS confidence
    FROM report_texts)
  WHERE nm IS NOT NULL
)"""

# ---- record tables ------------------------------------------------------------------

PATIENTS_SQL = """
patients AS (
  SELECT 'P' || c_custkey AS patient_id, CAST(NULL AS VARCHAR) AS full_name,
         CAST(NULL AS DATE) AS first_seen, CAST(NULL AS DATE) AS last_seen
  FROM customer
)"""

REPORTS_SQL = """
reports AS (
  SELECT 'R' || o_orderkey AS report_id, 'P' || o_custkey AS patient_id,
         o_orderpriority AS test_type, CAST(o_orderdate AS DATE) AS report_date,
         'in/' || o_orderkey || '.pdf' AS src_path, CAST(NULL AS INT) AS pages
  FROM orders
)"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.lit(None).cast("string").alias("full_name"),
        F.lit(None).cast("date").alias("first_seen"),
        F.lit(None).cast("date").alias("last_seen"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report_id"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("patient_id"),
        F.col("o_orderpriority").alias("test_type"),
        F.col("o_orderdate").cast("date").alias("report_date"),
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("src_path"),
        F.lit(None).cast("int").alias("pages"),
    )

# ---- usage ledger -------------------------------------------------------------------

# Model names, one unknown among them.
_MODELS = (
    "gpt-4", "gpt-4-turbo", "gpt-4-turbo-preview", "gpt-4o", "gpt-4o-mini", "gpt-3.5-turbo",
    "gpt-3.5-turbo-16k", "claude-3-opus", "claude-3-sonnet", "claude-3-haiku",
    "claude-3-5-sonnet", "GPT-4O", "other",
)

# Dollars per 1,000 input and output tokens.
_PRICES_SQL = """
prices(model, pin, pout) AS (VALUES
  ('gpt-4', 0.03, 0.06), ('gpt-4-turbo', 0.01, 0.03), ('gpt-4-turbo-preview', 0.01, 0.03),
  ('gpt-4o', 0.005, 0.015), ('gpt-4o-mini', 0.00015, 0.0006), ('gpt-3.5-turbo', 0.0005, 0.0015),
  ('gpt-3.5-turbo-16k', 0.003, 0.004), ('claude-3-opus', 0.015, 0.075), ('claude-3-sonnet', 0.003, 0.015),
  ('claude-3-haiku', 0.00025, 0.00125), ('claude-3-5-sonnet', 0.003, 0.015))"""

USAGE_SQL = f"""{_PRICES_SQL},
calls AS (
  SELECT event_id, ts AS timestamp, 'u' || user_id AS user_id,
         'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_type AS operation_type,
         ([{", ".join(f"'{m}'" for m in _MODELS)}])[CAST(event_id % 13 AS INT) + 1] AS model_name,
         CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) * 10 AS input_tokens,
         CAST(floor(value) AS INT) AS output_tokens
  FROM events),
usage AS (
  SELECT c.*, input_tokens + output_tokens AS total_tokens,
         CAST(coalesce(pin, 0.001) AS DECIMAL(10,6)) AS input_price,
         CAST(coalesce(pout, 0.002) AS DECIMAL(10,6)) AS output_price,
         CAST(input_tokens::DECIMAL(12,0) * coalesce(pin, 0.001)::DECIMAL(10,6) * 0.001::DECIMAL(4,3) AS DECIMAL(10,6)) AS input_cost,
         CAST(output_tokens::DECIMAL(12,0) * coalesce(pout, 0.002)::DECIMAL(10,6) * 0.001::DECIMAL(4,3) AS DECIMAL(10,6)) AS output_cost,
         CAST(input_tokens::DECIMAL(12,0) * coalesce(pin, 0.001)::DECIMAL(10,6) * 0.001::DECIMAL(4,3)
            + output_tokens::DECIMAL(12,0) * coalesce(pout, 0.002)::DECIMAL(10,6) * 0.001::DECIMAL(4,3) AS DECIMAL(10,6)) AS total_cost
  FROM calls c LEFT JOIN prices p ON p.model = lower(c.model_name))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """Model calls: events with a model name and token counts."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    models = F.array(*[F.lit(m) for m in _MODELS])
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        user.alias("user_id"),
        F.concat_ws("-", user, F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("event_type").alias("operation_type"),
        F.get(models, (F.col("event_id") % len(_MODELS)).cast("int")).alias("model_name"),
        (F.get_json_object("props", "$.k").cast("int") * 10).alias("input_tokens"),
        F.floor("value").cast("int").alias("output_tokens"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reportloom.operators.costs import calculate_cost

    return calculate_cost(calls(spark, sf_dir))

# ---- chat ----------------------------------------------------------------------------

CHAT_SQL = """
messages AS (
  SELECT conv_id AS session_id, turn, role, text AS content,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INT)), '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM conversations),
sessions AS (
  SELECT conv_id AS session_id, 'u' || (conv_id % 7) AS user_id,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(max(turn) AS INT)) AS updated_at
  FROM conversations GROUP BY conv_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("MINUTE", F.col("turn"), F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = F.timestamp_add("MINUTE", F.col("last"), F.lit("2024-01-01").cast("timestamp"))
    return per.select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"),
        at.alias("updated_at"),
    )


# ---- content items -------------------------------------------------------------------

ITEMS_SQL = r"""
raw_lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM documents)),
item_lines AS (
  SELECT doc_id, trim(line, e' \t\r 　') AS line,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS i
  FROM raw_lines WHERE trim(line, e' \t\r 　') <> ''),
items AS (
  SELECT doc_id, i AS pos, i // 5 AS page_idx,
         CASE WHEN i % 7 = 3 THEN 'table' WHEN i % 7 = 5 THEN 'image' WHEN i % 11 = 6 THEN 'equation'
              WHEN i % 13 = 8 THEN NULL ELSE 'text' END AS type,
         line, CASE WHEN i % 10 = 0 THEN 1 + i % 3 END AS text_level
  FROM item_lines),
shown AS (
  SELECT doc_id, pos, page_idx, type,
         CASE WHEN coalesce(type, 'text') = 'text' THEN
                CASE WHEN text_level > 0 THEN repeat('#', text_level) || ' ' || line ELSE line END
              WHEN type = 'image' THEN '[Image: I' || pos || ', more]'
              WHEN type = 'table' THEN '[Table: T' || pos || ']' END AS shown
  FROM items)"""


def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, items): the lines of a document as a content list."""
    from reportloom.functions.text import lines_of

    def item(line, i):
        kind = (
            F.when(i % 7 == 3, "table").when(i % 7 == 5, "image").when(i % 11 == 6, "equation")
            .when(i % 13 == 8, F.lit(None)).otherwise("text")
        )
        number = i.cast("string")
        is_text = kind.isNull() | (kind == "text")
        none = F.lit(None)
        strings = "array<string>"
        return F.struct(
            kind.alias("type"),
            F.when(is_text, line).alias("text"),
            F.when(i % 10 == 0, 1 + i % 3).alias("text_level"),
            F.floor(i / 5).cast("int").alias("page_idx"),
            F.when(kind == "image", F.concat(F.lit("img/"), number, F.lit(".png"))).alias("img_path"),
            F.when(kind == "image", F.array(F.concat(F.lit("I"), number), F.lit("more"))).alias("image_caption"),
            none.cast(strings).alias("image_footnote"),
            F.when(kind == "table", line).alias("table_body"),
            F.when(kind == "table", F.array(F.concat(F.lit("T"), number))).alias("table_caption"),
            none.cast(strings).alias("table_footnote"),
            F.when(kind == "equation", line).alias("latex"),
            F.when(kind == "equation", F.lit("LaTeX")).alias("text_format"),
            none.cast("string").alias("raw"),
        )

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.transform(lines_of(F.col("text")), item).alias("items")
    )
