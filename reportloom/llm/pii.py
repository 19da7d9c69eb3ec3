"""Personal data: high-recall candidates, boosted trees over format and context, thresholds.

Four base rules (fixed patterns and checks) give spans that always stay. Wider generators
propose further spans of the same kinds, which may overlap base spans and each other: written-out
addresses, numbers with other separators, dotted groups. A candidate is true if the base rule
holds for all of it, and false only on counter-evidence in its normal form (signs written plainly,
separators removed): a failed check sum, a part over 255, a wrong number of digits, a date, a last
label that is no name. All others are open. Trees are fitted on what is decided, with features of
the surroundings alone, so that the form of a value tells them nothing and what they learn carries
over to open candidates; a calibrated threshold per kind selects among these.

Only SQL functions touch rows: candidates are arrays inside a row, the trees a CASE expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm import boost
from reportloom.llm.common import stage_table

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that a failed start is not tried again inside the same run of
# characters and nothing is matched recursively; they find what the plain forms find.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider forms of the same kinds. A plain dot with a blank only behind it ends a sentence, unless a
# common top level follows.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]++(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s\.\s?|\.(?:\s(?=(?:com|org|net|edu|gov|info)\b))?)[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+(?![0-9])",
    "card": r"(?:(?<![0-9])|\G)[0-9]{4}[\x20._/-]{0,2}[0-9]{4,6}[\x20._/-]{0,2}[0-9]{4,5}[\x20._/-]{0,2}[0-9]{0,4}(?![0-9])",
    "phone": r"(?:(?<![0-9+])|\G)(?:\+|00|\()[0-9][\x20()./0-9-]{6,22}[0-9](?![0-9])",
}
# Marks that tell whether a text can hold a kind at all: one cheap search before the patterns.
MARK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
WIDE_MARK = {
    "email": r"@|\(at\)|\[at\]|\{at\}",
    "ip": r"[0-9](?:\.|\[\.\]|\(\.\))[0-9]",
    "card": r"[0-9]{4}[\x20._/-]{0,2}[0-9]{4}",
    "phone": r"(?:\+|00|\()[0-9]",
}
# Words before a value that name its kind; fixed values.
CUE = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)[^A-Za-z]{0,3}$",
    "ip": r"(?i)(?:\bip|host|server|addr(?:ess)?|from)[^A-Za-z]{0,3}$",
    "card": r"(?i)(?:card|visa|karte|carte|tarjeta|pay(?:ment)?)[^A-Za-z]{0,3}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|telefon|tél)[^A-Za-z]{0,3}$",
}
CONTEXT = 16
FEATURES = ("cue", "letter_before", "letter_after", "number_near", "link_before", "bracket_before", "ends")

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
RUN = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _found(text: Column, pattern: str, mark: str) -> Column:
    """All matches with place (code points, end exclusive), value and the characters around.

    Places are running sums over the lengths of matches and of the text between them, summed in
    runs of ``RUN``, so a text with very many matches costs little more than its length.
    """

    def places(t: Column) -> Column:
        values = t["values"]
        sums = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(values) / RUN).cast("int")),
            lambda b: _total(F.slice(t["sizes"], b * RUN + 1, F.lit(RUN))),
        )

        def one(value: Column, k: Column, heads: Column) -> Column:
            block = F.floor(k / RUN).cast("int")
            start = (
                F.get(heads, block)
                + _total(F.slice(t["sizes"], block * RUN + 1, k - block * RUN))
                + F.length(F.get(t["gaps"], k))
            )
            return F.struct(
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                value.alias("value"),
                F.right(F.get(t["gaps"], k), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(t["gaps"], k + 1), F.lit(CONTEXT)).alias("after"),
            )

        heads = _let(sums, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b))))
        return _let(heads, lambda h: F.transform(values, lambda v, k: one(v, k, h)))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = _let(
        F.struct(values.alias("values"), gaps.alias("gaps")),
        lambda t: F.struct(
            t["values"].alias("values"),
            t["gaps"].alias("gaps"),
            F.transform(t["values"], lambda v, k: F.length(v) + F.length(F.get(t["gaps"], k))).alias("sizes"),
        ),
    )
    found = F.when(F.size(values) > 0, _let(sizes, places))
    return F.when(text.rlike(mark), F.coalesce(found, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of at most 19 digits holds."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    return _total(F.transform(numbers, lambda n, i: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check that a match of the base pattern must pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        # Leading zeros do not count; four digits are enough to see that a part is too large.
        return F.forall(
            F.split(value, r"\."),
            lambda p: F.concat(F.lit("0"), F.substring(F.regexp_replace(p, "^0+", ""), 1, 4)).cast("int") <= 255,
        )
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _plain(kind: str, value: Column) -> Column:
    """``value`` with written-out signs as plain ones; a phone number without its leading 00 or bracket."""
    if kind == "email":
        at = F.regexp_replace(value, r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?", "@")
        return F.regexp_replace(at, r"\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"[\[\]()]", "")
    if kind == "phone":
        return F.regexp_replace(value, r"^(?:\+|00|\()", "")
    return value


# Days and spans of years, which have as many digits as phone numbers.
DATE = (
    r"^\(?(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}"
    r"|(?:1[0-9]|20)[0-9]{2}\x20?[/-]\x20?(?:1[0-9]|20)[0-9]{2})(?![0-9])"
)


def refuted(kind: str, value: Column) -> Column:
    """Whether something besides its form speaks against a candidate that the base rule leaves open."""
    plain = _plain(kind, value)
    if kind == "email":
        return ~plain.rlike(r"\.(?:[A-Za-z]{2,}|xn--[A-Za-z0-9-]+)$")
    if kind == "phone":
        # A number in brackets lacks its country code.
        least = F.when(F.substring(value, 1, 1) == "(", 8).otherwise(9)
        return ~F.length(_digits(plain)).between(least, F.lit(15)) | value.rlike(DATE)
    return ~valid(kind, plain)


def _features(kind: str, m: Column) -> Column:
    """Surroundings of a candidate, each 0 or 1; nothing of its form or of the check of its kind."""
    before, after = m["before"], m["after"]
    marks = {
        "cue": before.rlike(CUE[kind]),
        "letter_before": before.rlike(r"[\p{L}_]$"),
        "letter_after": after.rlike(r"^[\p{L}_]"),
        "number_near": before.rlike(r"[0-9][^\p{L}]{0,3}$") | after.rlike(r"^[^\p{L}]{0,3}[0-9]"),
        "link_before": before.rlike(r"[=/#&?-]$"),
        "bracket_before": before.rlike(r"[<\[({\"']$"),
        "ends": after.rlike(r"^(?:$|\s|[.,;:!?)\]}>\"'])"),
    }
    return F.struct(*(marks[f].cast("int").alias(f) for f in FEATURES))


def _code(kind: int, m: Column) -> Column:
    """Kind, start and end in one number that sorts as they do."""
    place = F.shiftleft(m["start"].cast("bigint"), 30).bitwiseOR(m["end"].cast("bigint"))
    return place.bitwiseOR(F.lit(kind << 60))


def _base_codes(i: int, found: Column) -> Column:
    return F.transform(F.filter(found, lambda m: valid(KINDS[i], m["value"])), lambda m: _code(i, m))


def _judged(i: int, found: Column) -> Column:
    """Candidates of kind ``i`` with features and their truth: 1, 0 (refuted) or -1 (open)."""
    kind = KINDS[i]

    def one(m: Column) -> Column:
        whole = m["value"].rlike(f"^(?:{BASE[kind]})$")
        truth = F.when(whole & valid(kind, m["value"]), 1).when(refuted(kind, m["value"]), 0).otherwise(-1)
        return F.struct(
            F.lit(i).alias("kind"), _code(i, m).alias("code"), truth.alias("truth"), _features(kind, m).alias("f")
        )

    return F.transform(found, one)


def _of_kind(codes: str, i: int) -> Column:
    return F.size(F.filter(codes, lambda c: F.shiftright(c, 60) == i)).cast("long")


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus base (codes of base spans) and wide (array of candidates)."""
    text = F.col("_text")
    base, wide = [], []
    for i, kind in enumerate(KINDS):
        base.append(_base_codes(i, _found(text, BASE[kind], MARK[kind])))
        more = _found(text, WIDE[kind], WIDE_MARK[kind])
        wide.append(_judged(i, more))
    full = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return full.select(*keep, F.array_sort(F.concat(*base)).alias("_base"), F.concat(*wide).alias("_wide"))


def fit_thresholds(found: DataFrame, precision: float = 0.9) -> dict[int, tuple[str, float]]:
    """kind -> (SQL of the margin over ``c.f``, least margin whose calibrated share reaches ``precision``).

    All candidates count: they are summed up by kind, truth and features. Each feature is 0 or 1,
    so that table has at most 1,024 rows, all of which go to the driver.
    """
    table = (
        found.select(F.explode("_wide").alias("c"))
        .where("c.truth >= 0")
        .groupBy("c.kind", *[f"c.f.{f}" for f in FEATURES], "c.truth")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *FEATURES, "truth", "kind")
        .collect()
    )
    out = {}
    for i in range(len(KINDS)):
        rows = [r for r in table if r["kind"] == i]
        if not rows:
            continue
        x = np.array([[r[f] for f in FEATURES] for r in rows], float)
        y = np.array([r["truth"] for r in rows], float)
        w = np.array([r["n"] for r in rows], float)
        model = boost.fit(x, y, w, trees=20, depth=3)
        margin = model.margin(x)
        sure = boost.isotonic(margin, y, w)(margin) >= precision
        if sure.any():
            out[i] = (model.sql([f"c.f.{f}" for f in FEATURES]), float(margin[sure].min()))
    return out


def _with_spans(found: DataFrame, rules: dict[int, tuple[str, float]]) -> DataFrame:
    """``_spans``: base codes and the codes of selected candidates, sorted, each once."""
    picks = [f"(c.kind = {i} AND {margin} >= {least - 1e-9!r}D)" for i, (margin, least) in rules.items()]
    if not picks:
        return found.withColumn("_spans", F.col("_base"))
    chosen = F.expr(f"transform(filter(_wide, c -> c.truth <> 0 AND ({' OR '.join(picks)})), c -> c.code)")
    return found.withColumn("_spans", F.array_sort(F.array_distinct(F.concat("_base", chosen))))


def _parts(code: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << 30) - 1)
    return (
        F.shiftright(code, 60).cast("int"),
        F.shiftright(code, 30).bitwiseAND(low).cast("int"),
        code.bitwiseAND(low).cast("int"),
    )


def _written(codes: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))

    def one(code: Column) -> Column:
        kind, start, end = _parts(code)
        return F.concat(F.get(names, kind), F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"))

    return F.array_join(F.transform(codes, one), ",")


def find_personal_data(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.

    Counts and base_sha256 are of base spans; spans lists these and the added ones as
    kind:start:end in code points, end exclusive. A null text counts as empty; null and repeated
    doc_ids are kept row by row; whole texts are read. An empty table gives an empty result, and
    without candidates nothing is added. Other columns are not read.
    """
    found = stage_table(
        candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "candidates"
    )
    counts = [_of_kind("_base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return _with_spans(found, fit_thresholds(found, precision)).select(
        "doc_id", *counts, F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    All columns and rows are kept; n_chars, if there is one, follows the text. A null text stays
    null.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = [c.lower() for c in columns].index("text")
    full = named.withColumn("text", F.col(f"_c{at}"))
    found = stage_table(candidates(full, [f"_c{i}" for i in range(len(columns))]), "redact")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def spot(code: Column) -> Column:
        kind, start, end = _parts(code)
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))

    text = F.coalesce(F.col(f"_c{at}").cast("string"), F.lit(""))
    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, m: Column) -> Column:
        inside = m["start"] < acc["at"]
        cut = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        return F.struct(
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], cut, F.get(names, m["kind"]))).alias("out"),
            F.greatest(acc["at"], m["end"]).alias("at"),
        )

    clean = F.aggregate(
        F.array_sort(F.transform("_spans", spot)),
        begun,
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    done = _with_spans(found, fit_thresholds(found, precision)).withColumn(
        "_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col(f"_c{at}"))
    )
    out = []
    for i, c in enumerate(columns):
        if i == at:
            out.append(F.col("_clean").alias(c))
        elif c.lower() == "n_chars":
            kind = docs.schema[i].dataType
            out.append(F.when(F.size("_spans") > 0, F.length("_clean").cast(kind)).otherwise(F.col(f"_c{i}")).alias(c))
        else:
            out.append(F.col(f"_c{i}").alias(c))
    return done.select(*out)
