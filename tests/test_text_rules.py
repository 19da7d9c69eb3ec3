"""Literal cases for the name, line and value rules."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reportloom.functions import labs, text as tx
from reportloom.operators import names, observations as obs


def values(spark, texts, rule):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, want",
    [("wILson", "Wilson"), ("o'neil-smith", "O'Neil-smith"), ("SMITH-JONES", "Smith-jones"), ("  ann   LEE ", "Ann Lee")],
)
def test_title_case(spark, raw, want):
    assert values(spark, [raw], tx.title_case_name) == [want]


def test_title_case_with_hyphens(spark):
    assert values(spark, ["SMITH-JONES o'neil"], lambda c: tx.title_case_name(c, hyphens=True)) == ["Smith-Jones O'Neil"]


def test_clean_tail(spark):
    got = values(spark, ["Mary Moore DOB 01/02/1970", "JONES, NORA", "Ann Lee sex F dob 1", "no one"], tx.clean_tail)
    assert got == ["Mary Moore", "JONES,", "Ann Lee", "no one"]
    assert values(spark, ["JONES, NORA"], lambda c: tx.clean_tail(c, whole_words=True)) == ["JONES, NORA"]


def test_normalize_name(spark):
    got = values(spark, ["LOPEZ, LISA M", "mary ann moore", "Cher", "JONES, NORA", "LEE,"], tx.normalize_name)
    assert got == ["Lisa M Lopez", "Mary Ann Moore", None, None, None]


NAME_CASES = [
    ("First Name: ann\nLast Name: lee", ("Ann Lee", 0.98)),
    ("First Name: ann\nGiven name: bea\nMiddle Name: x\nSurname Name: lee", ("Bea X Lee", 0.98)),
    ("Name: WHITE, WILLIAM", ("William White", 0.93)),
    ("Name: WHITE, WILLIAM 42", ("William White", 0.94)),
    ("Name:\n\nLEE, ANN", ("Ann Lee", 0.93)),
    ("Name:\nName:\nLEE, ANN", None),
    ("x | Patient Name | DOE, JANE | y", ("Jane Doe", 0.93)),
    ("Patient: LOPEZ, LISA\rother", ("Lisa Lopez", 0.93)),
    ("Name: Cher\nPatient: LEE, ANN", ("Ann Lee", 0.93)),
    ("nothing here", None),
    ("", None),
    ("Last Name: lee", None),
    ("name - ann lee\x0bmore", ("Ann Lee", 0.93)),
]


def test_person_name(spark):
    got = values(spark, [t for t, _ in NAME_CASES], tx.person_name)
    assert [None if g is None else tuple(g) for g in got] == [w for _, w in NAME_CASES]


def test_wrapped_labels_take_every_other_line(spark):
    got = values(spark, ["Name:\nLEE, ANN", "Name:\nName:\nLEE, ANN", "a\nName:"], tx.join_wrapped_labels)
    assert got == ["Name: LEE, ANN", "Name: Name:\nLEE, ANN", "a\nName:"]


def _joined_by_loop(lines):
    label = re.compile(r"^(?:patient\s*)?name\s*[:\-]?\s*$", re.I)
    out, i = [], 0
    while i < len(lines):
        if label.match(lines[i]) and i + 1 < len(lines):
            out.append("Name: " + lines[i + 1])
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Name:", "patient name", "LEE, ANN", "x", "NAME -"]), min_size=1, max_size=9), min_size=1, max_size=20))
def test_wrapped_labels_like_a_loop(spark, docs):
    got = values(spark, ["\n".join(d) for d in docs], tx.join_wrapped_labels)
    assert got == ["\n".join(_joined_by_loop(d)) for d in docs]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x1d\x1e\x85  　\xa0", max_size=12), min_size=1, max_size=20))
def test_lines_like_splitlines(spark, texts):
    got = values(spark, texts, tx.lines_of)
    assert got == [[s.strip() for s in t.splitlines() if s.strip()] for t in texts]


def observed(spark, text):
    rows = obs.extract_observations(spark.createDataFrame([("r", text)], "report_id string, text string"))
    return [tuple(r)[2:] for r in rows.orderBy("obs_no").collect()]


def test_observations(spark):
    assert observed(spark, "Creatinine 1.01 mg/dL 0.6 - 1.3") == [("Creatinine", "1.01", "mg/dL", "0.6 - 1.3")]
    assert observed(spark, "T3 110 ng/dL") == [("T3", "110", "ng/dL", "")]
    assert observed(spark, "| Albumin | 3.24 | g/dL |") == []
    assert observed(spark, "San Jose, CA 58689") == [("CA", "58689", "", "")]
    assert observed(spark, "Result 5\nFe -2.5 (H) 1 - 3") == [("Fe", "-2.5", "", "1 - 3")]
    assert [r[1:3] for r in observed(spark, "- " * 190 + " Iron 5 mg/d")] == [("5", "mg/d")]


def test_observations_have_limits_on_request_only(spark):
    text = "\n".join(f"Iron x{i} {i}" for i in range(300))
    rows = observed(spark, text)
    assert len(rows) == 300 and rows[-1][1] == "299"
    docs = spark.createDataFrame([("r", text + "\n" + "- " * 190 + " Iron 5 mg")], "report_id string, text string")
    assert obs.extract_observations(docs).count() == 301
    assert obs.extract_observations(docs, max_rows=200).count() == 200
    assert obs.extract_observations(docs, max_line=200).count() == 300


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="Ab %-.()HL/0159 µ", max_size=30), min_size=1, max_size=40))
def test_observations_like_regex(spark, lines):
    rule = re.compile(labs.VALUE_ROW)
    want = []
    for line in lines:
        m = rule.search(line.strip())
        if m and m.group(1).lower() not in labs.HEADER_WORDS:
            want.append((m.group(1).strip(), m.group(2), m.group(3) or "", m.group(5) or ""))
    assert observed(spark, "\n".join(lines)) == want


def test_flag_and_dates(spark):
    got = spark.createDataFrame(
        [("5", "1-9"), ("9", "1 - 9"), ("9.1", "1-9"), ("0.5", "1-9"), ("x", "1-9"), ("5", "")], "v string, r string"
    ).select(labs.flag_value(F.col("v"), F.col("r")).alias("f")).collect()
    assert [r.f for r in got] == ["NORMAL", "NORMAL", "HIGH", "LOW", None, None]
    dates = values(spark, ["11/18/2025", "2025-11-18", "November 18, 2025", "18.11.2025"], labs.clean_date)
    assert [str(d) for d in dates] == ["2025-11-18"] * 3 + ["None"]


LAYOUTS = {
    "titled": "| Test Name | Result | Units | Reference Range | Status |\n|---|---|---|---|---|\n| eGFR | 94 | mL/min/1.73m2 90 - 120 | mL/min/1.73m2 90 - 120 | LOW |",
    "no_titles_4": "| Albumin | 3.2 g/dL | 3.5-5.5 | L |\n|---|---|---|---|\n| Iron | 9 % | 1-9 | NORMAL |",
    "no_range": "| LDL | 154.7 | mg/dL | HIGH |\n|---|---|---|---|",
    "flag": "| Test | Result | Unit | Reference Range | Flag |\n|---|---|---|---|---|\n| A | 1 | x | 1-2 |   |\n| B | POSITIVE | | | H |",
    "two": "| Test | Value | Range | Status |\n|--|--|--|--|\n| A | 5.7 mg | 7-9 | LOW |\n\ntext\n\n| Test | Value | Range | Status |\n|--|--|--|--|\n| B | -1 | 2-3 | LOW |",
}


def test_table_layouts(spark):
    docs = spark.createDataFrame(list(LAYOUTS.items()), "report_id string, text string")
    rows = obs.table_observations(docs).orderBy("report_id", "table_no", "row_no").collect()
    got = [(r.report_id, r.analyte, r.value, r.unit, r.ref_range, r.status_code) for r in rows]
    assert got == [
        ("flag", "A", "1", "x", "1-2", "NORMAL"),
        ("flag", "B", "POSITIVE", "", "", "HIGH"),
        ("no_range", "LDL", "154.7", "mg/dL", "", "HIGH"),
        ("no_titles_4", "Albumin", "3.2", "g/dL", "3.5-5.5", "LOW"),
        ("no_titles_4", "Iron", "9", "%", "1-9", "NORMAL"),
        ("titled", "eGFR", "94", "mL/min/1.73m2", "90 - 120", "LOW"),
        ("two", "A", "5.7", "mg", "7-9", "LOW"),
        ("two", "B", "-1", "", "2-3", "LOW"),
    ]


def test_cards_with_late_status(spark):
    text = "## Iron\n\nLEE, ANN | 10/10/2023\n\n17.3 mg/dL\n\nRef: 7-20\n\nZinc\n\n2 %\nRef: 1-3\nLOW\nNORMAL"
    rows = obs.card_observations(spark.createDataFrame([("r", text)], "report_id string, text string")).collect()
    assert [(r.analyte, r.value, r.unit, r.ref_range, r.status) for r in rows] == [
        ("Iron", "17.3", "mg/dL", "7-20", "LOW"),
        ("Zinc", "2", "%", "1-3", "LOW"),
    ]


def test_bars_by_row_and_by_column(spark):
    texts = {
        "a": "## Inflammation\n\nC-Reactive Protein\n\n1.48\n\nmg/L\n\nNORMAL\n\nESR\n11.3\nmm/hr\nHIGH",
        "b": "## Iron\nIron\nFerritin\n105.0\n233\nug/dL\nng/mL\n![Image](x)",
        "c": "Iron\n5\nRef: 1-2",
        "d": "| Iron | 5 |",
        "e": "",
    }
    rows = obs.bar_observations(spark.createDataFrame(list(texts.items()), "report_id string, text string"))
    got = [(r.report_id, r.analyte, r.value, r.unit, r.status) for r in rows.orderBy("report_id", "row_no").collect()]
    assert got == [
        ("a", "C-Reactive Protein", "1.48", "mg/L", "NORMAL"),
        ("a", "ESR", "11.3", "mm/hr", "HIGH"),
        ("b", "Iron", "105.0", "ug/dL", None),
        ("b", "Ferritin", "233", "ng/mL", None),
    ]


def test_canonical_name_order(spark):
    rows = [("p", f"r{i}", "Ann Lee", 0.93) for i in range(3)] + [("p", "r9", "Anne Lee", 0.94)]
    rows += [("q", "a", "B B", 0.93), ("q", "b", "C C", 0.93), ("q", "c", "C C", 0.93)]
    rows += [("s", "b", "Zoe A", 0.93), ("s", "c", "Amy A", 0.93)]
    ev = spark.createDataFrame(rows, "patient_id string, source_report string, name string, confidence double")
    assert {r.patient_id: r.full_name for r in names.canonical_name(ev).collect()} == {"p": "Anne Lee", "q": "C C", "s": "Amy A"}
    assert {r.patient_id: r.full_name for r in names.first_seen_name(ev).collect()} == {"p": "Ann Lee", "q": "B B", "s": "Zoe A"}


def _edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.text(alphabet="abc ", min_size=1, max_size=7), min_size=1, max_size=12),
    st.lists(st.text(alphabet="abc ", min_size=1, max_size=7), min_size=1, max_size=12),
)
def test_fuzzy_names_like_brute_force(spark, mentions, known):
    def words(s):
        return [w for w in re.split(r"[\s,]+", s.lower()) if w]

    def known_forms(s):
        return {" ".join(words(s)), " ".join(sorted(words(s)))}

    def orders(s):
        w = words(s)
        turned = {" ".join(v[i:] + v[:i]) for v in (w, w[::-1]) for i in range(len(w))}
        return turned | {" ".join(sorted(w))}

    people = spark.createDataFrame([(f"P{i:02}", n) for i, n in enumerate(known)], "patient_id string, full_name string")
    asked = spark.createDataFrame(list(enumerate(mentions)), "i int, mention string")
    got = {r.i: (r.patient_id, r.distance) for r in names.resolve_patient_name(asked, people).collect()}
    for i, mention in enumerate(mentions):
        options = [
            (min(_edit(a, b) for a in orders(mention) for b in known_forms(n)), f"P{j:02}") for j, n in enumerate(known)
        ] if words(mention) else []
        near = [o for o in options if o[0] <= 2]
        want = (min(near)[1], min(near)[0]) if near else (None, None)
        assert got[i] == want, (mention, known)


def test_swapped_words_resolve(spark):
    people = spark.createDataFrame([("P1", "Mary Moore"), ("P2", "Ann Lee")], "patient_id string, full_name string")
    asked = spark.createDataFrame([(1, "MOORE, MARY"), (2, "lee anm"), (3, "nobody")], "i int, mention string")
    got = {r.i: (r.patient_id, r.distance) for r in names.resolve_patient_name(asked, people).collect()}
    assert got == {1: ("P1", 0), 2: ("P2", 1), 3: (None, None)}


def test_spread_hashes_of_names_are_not_broadcast(spark):
    people = spark.createDataFrame([("P1", "Mary Moore"), ("P2", "Ann Lee"), ("P3", None)], "patient_id string, full_name string")
    asked = spark.createDataFrame([(1, "mary moore"), (2, "ann leee"), (3, "an ee"), (3, "an ee"), (4, None), (5, "")], "i int, mention string")
    found = names.resolve_patient_name(asked, people)
    rows = sorted(((r.i, r.patient_id, r.distance) for r in found.collect()), key=str)
    assert rows == [(1, "P1", 0), (2, "P2", 1), (3, "P2", 2), (3, "P2", 2), (4, None, None), (5, None, None)]
    near = names._nearest(asked.selectExpr("mention AS _key", "mention AS _order"), people.selectExpr("full_name AS known_key", "patient_id"), 2)
    near.collect()
    for df in (found, near):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "_h#" in x]
        assert joins and not any("Broadcast" in x for x in joins)


def test_every_header_label_passes_its_cheap_test(spark):
    from reportloom.operators import observations as obs

    body = "Patient NAME : LEE, ANN Gender: f\npatient iD: P7\nDATE OF BIRTH: 01/02/1970\nTEST Date: 2024-02-03\nPANEL: Iron Age: 3\nREPORT DATE: May 4, 2024\nspecimen ID: S1 ACCESSION: A1"
    rows = obs.header_fields(spark.createDataFrame([("a", body), ("b", "nothing here"), ("c", None)], "report_id string, text string"))
    got = {r[0]: [None if x is None else str(x) for x in r[1:]] for r in rows.collect()}
    assert got["a"] == ["LEE, ANN", "P7", "1970-01-02", "f", "Iron", "2024-02-03", "2024-05-04", "S1", "A1"]
    assert got["b"] == got["c"] == [None] * 9
    assert set(obs._LABEL_WORDS) == set(obs.HEADER_LABELS)


def test_tables_are_cut_once_and_cell_rules_are_plain_columns(spark):
    """The cell rules ran in nested lambdas, interpreted and copied at every level."""
    text = "| A | B |\n| : |\n|---|\n| Iron | 7 |\n| | 3 |\n| TSH | <0.5 uIU/mL | 0.4 - 4 |\n|Test|Result|Flag|\n|-|-|-|\n|x|1,200||"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no table")], "report_id int, text string")
    got = obs.table_observations(docs)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in got.orderBy("table_no", "row_no").collect()]
    assert rows == [
        (1, 0, 1, "Iron", "7", "", "", "", None, 7.0),
        (1, 0, 3, "TSH", "<0.5", "uIU/mL", "", "0.4 - 4", None, None),
        (1, 1, 0, "x", "1,200", "", "", "", "NORMAL", 1200.0),
    ]


ODD_TEXTS = [
    None, "", "no label 4", "Name:\r\nLEE, ANN DOB 3\nIron 4.5 µg 1 - 2", "name: x\n\nTSH\t-3 (L) 0.4-4 5 6",
    "First Name: ann\nGiven Name: Bo\nSurname Name: O'NEIL-LEE\nResult 5", "| Patient | LEE, ANN |\x85Name: Bo Ray 42 Zinc\xa04 Zinc 5",
]


def test_value_lines_run_once_per_text(spark):
    """The line rules ran in nested lambdas, interpreted and copied at every level."""
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "report_id int, text string")
    got = obs.extract_observations(docs)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.orderBy("report_id", "obs_no").collect()] == [
        (2, 0, "no label", "4", "", ""),
        (3, 0, "ANN DOB", "3", "", ""),
        (3, 1, "Iron", "4.5", "µg", "1 - 2"),
        (4, 0, "TSH", "-3", "", "0.4-4"),
        (6, 0, "Bo Ray", "42", "", ""),
        (6, 1, "Zinc", "5", "", ""),
    ]


def test_name_rules_run_once_per_text(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "report_id int, text string")
    got = names.extract_patient_name(docs)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.orderBy("report_id").collect()] == [
        (0, None, None), (1, None, None), (2, None, None), (3, "Ann Lee", 0.94), (4, None, None),
        (5, "Bo O'Neil-lee", 0.98), (6, "Ann Lee", 0.93),
    ]


def test_names_are_staged_as_plain_columns(spark, tmp_path):
    from reportloom.plans import hydrate as hy

    parsed = spark.createDataFrame(
        [("r", "P1", "CBC", None, "in/r", "Name: LEE, ANN\nIron 4 mg"), ("s", "P2", "CBC", None, "in/s", None)],
        "report_id string, patient_id string, test_type string, report_date date, src_path string, text string",
    )
    rows = hy.stage_reports(parsed, str(tmp_path / "all")).orderBy("report_id").collect()
    assert tuple(rows[0].found) == ("Ann Lee", 0.93) and rows[1].found is None
    assert [tuple(r) for r in rows[0].rows] == [(0, "Iron", "4", "mg", "")] and rows[1].rows is None
    assert "lambda" not in parsed.select(tx.person_name(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_report_texts_are_dealt_without_a_sort(spark, tmp_path):
    """Dealing order lines in turns sorted all of them first."""
    from reportloom.suite import tables as tb

    spark.sql(
        "SELECT id AS l_suppkey, id AS l_orderkey, 1 AS l_linenumber, id % 2 AS l_partkey, 3.0D AS l_quantity, 'R' AS l_returnflag,"
        " timestamp '2024-01-02' AS l_shipdate FROM range(4)"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT id AS p_partkey, 'a b' AS p_name, 'B' AS p_brand, 'T' AS p_type, 5 AS p_size FROM range(2)").write.parquet(
        str(tmp_path / "part.parquet")
    )
    texts = tb.report_texts(spark, str(tmp_path))
    assert "RoundRobinPartitioning" not in texts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.report_id for r in texts.collect()) == [f"P{i}_T_20240102_o{i}_1" for i in range(4)]
