"""Name extraction, canonical names, fuzzy resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import text as tx
from reportloom.operators import names as op
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_EVIDENCE = f"WITH {tb.EVIDENCE_SQL}"


@query(
    "extract_patient_name",
    f"""{_EVIDENCE}
SELECT r.report_id, e.name, e.confidence
FROM report_texts r LEFT JOIN evidence e ON e.source_report = r.report_id""",
)
def extract_patient_name(spark, sf_dir):
    return op.extract_patient_name(tb.report_texts(spark, sf_dir))


@query("name_evidence", f"{_EVIDENCE} SELECT patient_id, source_report, name, confidence FROM evidence")
def name_evidence(spark, sf_dir):
    return op.name_evidence(tb.report_texts(spark, sf_dir))


@query(
    "name_candidates",
    f"""{_EVIDENCE}
SELECT patient_id, name, max(confidence) AS max_conf, count(*) AS freq
FROM evidence GROUP BY patient_id, name""",
)
def name_candidates(spark, sf_dir):
    return op.name_candidates(op.name_evidence(tb.report_texts(spark, sf_dir)))


_CANONICAL = f"""{_EVIDENCE},
cand AS (SELECT patient_id, name, max(confidence) AS max_conf, count(*) AS freq
         FROM evidence GROUP BY patient_id, name),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY patient_id
             ORDER BY max_conf DESC, freq DESC, name ASC) AS rnk FROM cand),
canonical AS (SELECT patient_id, name AS full_name, max_conf, freq FROM ranked WHERE rnk = 1)"""


@query("canonical_name", f"{_CANONICAL} SELECT * FROM canonical")
def canonical_name(spark, sf_dir):
    return op.canonical_name(op.name_evidence(tb.report_texts(spark, sf_dir)))


@query(
    "first_seen_name",
    f"{_EVIDENCE} SELECT patient_id, arg_min(name, source_report) AS full_name FROM evidence GROUP BY patient_id",
)
def first_seen_name(spark, sf_dir):
    return op.first_seen_name(op.name_evidence(tb.report_texts(spark, sf_dir)))


@query(
    "apply_canonical_name",
    f"""{_CANONICAL},
people AS (SELECT 'P' || c_custkey AS patient_id, c_name AS full_name FROM customer)
SELECT p.patient_id, coalesce(c.full_name, p.full_name) AS full_name
FROM people p LEFT JOIN canonical c USING (patient_id)""",
)
def apply_canonical_name(spark, sf_dir):
    people = tb.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.col("c_name").alias("full_name"),
    )
    names = op.canonical_name(op.name_evidence(tb.report_texts(spark, sf_dir)))
    return op.apply_canonical_name(people, names)


@query(
    "first_rule_wins",
    f"""{_EVIDENCE}
SELECT patient_id, name, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id
    ORDER BY confidence DESC, source_report) AS rn FROM evidence)
WHERE rn = 1""",
)
def first_rule_wins(spark, sf_dir):
    hits = op.name_evidence(tb.report_texts(spark, sf_dir)).withColumn("step", -F.col("confidence"))
    return op.first_rule_wins(hits, ["patient_id"], ["name", "confidence"], ["step", "source_report"])


@query(
    "join_wrapped_labels",
    r"""WITH labelled AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'user' THEN 'Name:' ELSE 'turn ' || turn END AS line
  FROM conversations),
runs AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, line = 'Name:' ORDER BY turn) AS grp,
                lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM labelled),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, line = 'Name:', grp ORDER BY turn) AS k FROM runs),
taken AS (SELECT *, line = 'Name:' AND k % 2 = 1 AND nxt IS NOT NULL AS takes FROM marked),
kept AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY conv_id ORDER BY turn), false) AS eaten FROM taken)
SELECT conv_id, string_agg(CASE WHEN takes THEN 'Name: ' || nxt ELSE line END, '|' ORDER BY turn) AS lines
FROM kept WHERE NOT eaten GROUP BY conv_id""",
)
def join_wrapped_labels(spark, sf_dir):
    line = F.when(F.col("role") == "user", "Name:").otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return (
        tb.table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.transform(ordered, lambda s: s["line"]).alias("_lines"))
        .select("conv_id", F.replace(tx.join_wrapped_labels(F.array_join("_lines", "\n")), F.lit("\n"), F.lit("|")).alias("lines"))
    )


@query(
    "title_case_name",
    r"""SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '),
  lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '''') AS name
FROM (SELECT p_partkey, replace(p_name, ' ', ' ') AS p_name FROM part)""",
)
def title_case_name(spark, sf_dir):
    name = F.replace(F.upper("p_name"), F.lit(" "), F.lit("'"))
    return tb.table(spark, sf_dir, "part").select("p_partkey", tx.title_case_name(name).alias("name"))


@query(
    "clean_tail",
    r"""SELECT doc_id, trim(regexp_replace(line, '(?is)^(.+?) (?:mrn|dob|age|sex|id|patient|no|number).*$', '\1')) AS value
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents)""",
)
def clean_tail(spark, sf_dir):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.clean_tail(line).alias("value"))


@query(
    "normalize_name",
    r"""WITH raw AS (
  SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN upper(c_mktsegment) || ', ' || upper(s_name_part) || ' DOB 1/1'
                                         WHEN 1 THEN lower(c_mktsegment) || '  ' || s_name_part
                                         ELSE c_mktsegment END AS raw, c_mktsegment, s_name_part, c_nationkey
  FROM (SELECT *, chr(97 + CAST(c_nationkey AS INT)) || 'x' AS s_name_part FROM customer))
SELECT c_custkey,
  CASE WHEN c_nationkey % 3 = 2 THEN NULL
       WHEN c_nationkey % 3 = 0 THEN upper(left(s_name_part, 1)) || 'x ' || left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2))
       ELSE left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2)) || ' ' || upper(left(s_name_part, 1)) || 'x' END AS name
FROM raw""",
)
def normalize_name(spark, sf_dir):
    kind = F.col("c_nationkey") % 3
    part = F.concat(F.char(F.lit(97) + F.col("c_nationkey")), F.lit("x"))
    raw = (
        F.when(kind == 0, F.concat(F.upper("c_mktsegment"), F.lit(", "), F.upper(part), F.lit(" DOB 1/1")))
        .when(kind == 1, F.concat(F.lower("c_mktsegment"), F.lit("  "), part))
        .otherwise(F.col("c_mktsegment"))
    )
    return tb.table(spark, sf_dir, "customer").select("c_custkey", tx.normalize_name(raw).alias("name"))


@query(
    "resolve_patient_name",
    r"""WITH known AS (SELECT 'P' || c_custkey AS patient_id, lower(c_name) AS k FROM customer),
mention AS (
  SELECT s_suppkey, replace(s_name, 'Supplier#', 'Customer#') || '7' AS mention FROM supplier),
pairs AS (
  SELECT s_suppkey, patient_id, levenshtein(lower(mention), k) AS d FROM mention, known
  WHERE levenshtein(lower(mention), k) <= 2),
best AS (SELECT s_suppkey, patient_id, d, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, patient_id) AS rn FROM pairs)
SELECT m.s_suppkey, m.mention, b.patient_id, CAST(b.d AS INT) AS distance
FROM mention m LEFT JOIN best b ON b.s_suppkey = m.s_suppkey AND b.rn = 1""",
)
def resolve_patient_name(spark, sf_dir):
    people = tb.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.col("c_name").alias("full_name"),
    )
    mention = F.concat(F.replace("s_name", F.lit("Supplier#"), F.lit("Customer#")), F.lit("7"))
    mentions = tb.table(spark, sf_dir, "supplier").select("s_suppkey", mention.alias("mention"))
    return op.resolve_patient_name(mentions, people)


_TYPO_SQL = r"""
      CASE c_custkey % 5
        WHEN 0 THEN last || ', ' || first
        WHEN 1 THEN 'Z' || substr(first, 2) || ' ' || last
        WHEN 2 THEN last || ' Q' || first
        WHEN 3 THEN substr(first, 2) || ' ' || last
        ELSE upper(first) || ' ' || substr(last, 1, 2) || 'x' || substr(last, 4) END AS mention"""


@query(
    "resolve_swapped_and_misspelled",
    rf"""WITH c AS (
  SELECT c_custkey, 'P' || c_custkey AS patient_id, lower(c_mktsegment) AS first, 'k' || md5(c_custkey::VARCHAR) AS last FROM customer),
mention AS (SELECT c_custkey, {_TYPO_SQL} FROM c)
SELECT c_custkey, mention, 'P' || c_custkey AS patient_id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END::INT AS distance FROM mention""",
)
def resolve_swapped_and_misspelled(spark, sf_dir):
    """Swapped words, and one letter replaced, added or lost at the start of a word or inside.

    Last names are long hashes, so the one person within two edits is the one meant.
    """
    people = tb.table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("first"), F.concat(F.lit("k"), F.md5(F.col("c_custkey").cast("string"))).alias("last")
    )
    kind, first, last = F.col("c_custkey") % 5, F.col("first"), F.col("last")
    mention = (
        F.when(kind == 0, F.concat(last, F.lit(", "), first))
        .when(kind == 1, F.concat(F.lit("Z"), F.substring(first, 2, 99), F.lit(" "), last))
        .when(kind == 2, F.concat(last, F.lit(" Q"), first))
        .when(kind == 3, F.concat(F.substring(first, 2, 99), F.lit(" "), last))
        .otherwise(F.concat(F.upper(first), F.lit(" "), F.substring(last, 1, 2), F.lit("x"), F.substring(last, 4, 99)))
    )
    known = people.select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"), F.concat_ws(" ", first, last).alias("full_name")
    )
    return op.resolve_patient_name(people.select("c_custkey", mention.alias("mention")), known)
