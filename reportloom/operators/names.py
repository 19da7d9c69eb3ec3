"""Person names: evidence per report, one canonical name per person, fuzzy resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import text as tx
from reportloom.session import spread, workspace


def _staged(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder, for plans that read them more than once."""
    path = workspace(rows.sparkSession, "names")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def extract_patient_name(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("report_id",)
) -> DataFrame:
    """(keep..., name, confidence) for every document; NULLs where no rule applies.

    The rules work on the line array inside the row, so a document is never spread over rows
    and nothing is shuffled. A generator holds the rules: unlike a projected column it is
    not repeated in every later filter or field access.
    """
    return docs.select(*keep, F.inline(F.array(tx.person_name(F.col(text_col)))))


def name_evidence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Evidence rows keyed by (patient_id, source_report); documents without a name drop out."""
    some = F.filter(F.array(tx.person_name(F.col(text_col))), lambda n: n.isNotNull())
    return docs.select("patient_id", F.col("report_id").alias("source_report"), F.inline(some))


def name_candidates(evidence: DataFrame) -> DataFrame:
    """Per (patient, name): best confidence and number of reports that say so."""
    return evidence.groupBy("patient_id", "name").agg(
        F.max("confidence").alias("max_conf"), F.count(F.lit(1)).alias("freq")
    )


def canonical_name(evidence: DataFrame) -> DataFrame:
    """One name per patient: confidence, then frequency, then alphabet.

    Both steps are plain aggregates with map-side combine, so a patient that owns a large
    share of the evidence costs one small partial row per task.
    """
    order = F.struct(-F.col("max_conf"), -F.col("freq"), F.col("name"))
    best = F.min_by(F.struct("name", "max_conf", "freq"), order).alias("b")
    return (
        name_candidates(evidence)
        .groupBy("patient_id")
        .agg(best)
        .select(
            "patient_id",
            F.col("b.name").alias("full_name"),
            F.col("b.max_conf").alias("max_conf"),
            F.col("b.freq").alias("freq"),
        )
    )


def first_seen_name(evidence: DataFrame, order_col: str = "source_report") -> DataFrame:
    """The name found first in file order (what the name index file holds)."""
    return evidence.groupBy("patient_id").agg(F.min_by("name", order_col).alias("full_name"))


def apply_canonical_name(patients: DataFrame, canonical: DataFrame) -> DataFrame:
    """Set full_name where a canonical name exists; other patients keep theirs."""
    new = canonical.select("patient_id", F.col("full_name").alias("_new"))
    return patients.join(new, "patient_id", "left").withColumn(
        "full_name", F.coalesce("_new", "full_name")
    ).drop("_new")


def first_rule_wins(
    hits: DataFrame, keys: list[str], values: list[str], order: list[str]
) -> DataFrame:
    """Best-first cascade over rule hits: the values of the smallest ``order`` per key."""
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_b")
    return hits.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values])


def name_key(name: Column) -> Column:
    """Lower-case words in sorted order: blind to case and word order."""
    words = F.filter(F.split(F.lower(tx.strip(name)), r"[\s,]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _deletions(key: Column) -> Column:
    """All strings with exactly one character less."""
    return F.transform(
        F.sequence(F.lit(1), F.length(key)),
        lambda i: F.concat(F.left(key, i - 1), F.substr(key, i + 1)),
    )


def deletion_keys(key: Column, edits: int = 2) -> Column:
    """Hashes of the string and of every string with up to ``edits`` (one or two) characters deleted.

    Two strings within edit distance ``edits`` always share one of these, so an equi join on
    them finds every such pair.
    """
    some = F.when(F.length(key) > 0, _deletions(key)).otherwise(F.array())
    if edits == 1:
        every = F.concat(F.array(key), some)
    else:
        two = F.flatten(
            F.transform(F.array_distinct(some), lambda s: F.when(F.length(s) > 0, _deletions(s)).otherwise(F.array()))
        )
        every = F.concat(F.array(key), some, two)
    return F.array_distinct(F.transform(F.array_distinct(every), lambda s: F.xxhash64(s)))


def _third(key: Column, size: Column, number: Column, shift: Column) -> Column:
    """Hash of the characters of ``key`` where the ``number``-th third of a string of ``size`` stands."""
    start = F.floor(number * size / 3).cast("int")
    end = F.floor((number + 1) * size / 3).cast("int")
    return F.xxhash64(size, number, F.substr(key, F.greatest(start + shift, F.lit(0)) + 1, end - start))


def _thirds(key: Column) -> Column:
    """Hashes of the three thirds of a string."""
    return F.transform(F.array(*map(F.lit, range(3))), lambda n: _third(key, F.length(key), n, F.lit(0)))


def _thirds_near(key: Column) -> Column:
    """Hashes of all thirds that a string within two edits of ``key`` may share with it.

    Two edits leave one third of a string as it is, and move it by at most two places.
    """
    sizes = F.transform(F.array(*map(F.lit, range(-2, 3))), lambda d: F.length(key) + d)
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n in range(3) for d in range(-2, 3)])
    each = F.transform(
        F.filter(sizes, lambda z: z >= 0), lambda z: F.transform(places, lambda p: _third(key, z, p["n"], p["d"]))
    )
    return F.array_distinct(F.flatten(each))


def _plain_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(tx.strip(name)), r"[\s,]+"), lambda w: w != "")


def word_orders(name: Column) -> Column:
    """The lower-case name in other word orders: sorted, and all rotations of both directions.

    For up to three words these are all orders.
    """

    def turned(words: Column) -> Column:
        n = F.size(words)
        return F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.array_join(F.concat(F.slice(words, i, n), F.slice(words, F.lit(1), i - 1)), " "),
        )

    words = _plain_words(name)
    both = F.concat(tx.bind(words, turned), tx.bind(F.reverse(words), turned), F.array(name_key(name)))
    return F.when(F.size(words) > 0, F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def _nearest(asked: DataFrame, spelled: DataFrame, edits: int) -> DataFrame:
    """(_key, patient_id, distance) of keys that have a known name within ``edits`` of one of their orders.

    Both sides are spread over their hashes, many times the rows the optimizer sees before it:
    the join must not be a broadcast, and the few rows before it must not stay in few tasks.
    """
    left = spread(asked).select("_key", "_order", F.explode(deletion_keys(F.col("_order"), edits)).alias("_h"))
    right = spread(spelled).select("known_key", "patient_id", F.explode(deletion_keys(F.col("known_key"), edits)).alias("_h"))
    return (
        left.join(right.hint("merge"), "_h")
        .select("_key", "patient_id", F.levenshtein("_order", "known_key", edits).alias("distance"))
        .where("distance >= 0")
        .groupBy("_key")
        .agg(F.min(F.struct("distance", "patient_id")).alias("_m"))
        .select("_key", F.col("_m.patient_id").alias("patient_id"), F.col("_m.distance").alias("distance"))
    )


def resolve_patient_name(
    mentions: DataFrame,
    patients: DataFrame,
    mention_col: str = "mention",
    max_distance: int = 2,
) -> DataFrame:
    """Map each mentioned name to the closest known person (patient_id, distance).

    Word order and case do not matter: the distance is the smallest between the mention in any
    of its ``word_orders`` and the known name as it is or sorted, so a typo counts once wherever
    it stands. Up to ``max_distance`` (at most 2) edits
    are accepted. Nearest first, then smallest patient_id; no match gives NULLs.

    Exact keys are settled by an equi join, then those one edit away by some twenty to fifty hashes a
    name. Only keys still open meet on the hashes of two deletions, some hundred a name, and
    only with known names that share a third with one of them. A hash stands for nearly the whole
    string, so no block holds all names, whatever prefix or sound they share. Copies of a name
    collapse to one key first. What is open after one edit is written once to the shared folder.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance must be 0, 1 or 2")
    people = patients.where("full_name IS NOT NULL").select(
        "patient_id",
        name_key(F.col("full_name")).alias("sorted_key"),
        F.array_join(_plain_words(F.col("full_name")), " ").alias("known_key"),
    )
    known = people.groupBy("sorted_key").agg(F.min("patient_id").alias("patient_id"))
    spelled = (
        people.select("patient_id", F.explode(F.array_distinct(F.array("known_key", "sorted_key"))).alias("known_key"))
        .groupBy("known_key")
        .agg(F.min("patient_id").alias("patient_id"))
    )
    keyed = mentions.withColumn("_key", F.array_join(_plain_words(F.col(mention_col)), " "))
    keys = keyed.select("_key").where("_key <> ''").distinct()
    exact = (
        keys.withColumn("sorted_key", name_key(F.col("_key")))
        .join(known, "sorted_key", "left")
        .select("_key", "patient_id", F.when(F.col("patient_id").isNotNull(), 0).alias("distance"))
    )
    if max_distance == 0:
        return keyed.join(exact, "_key", "left").drop("_key")
    orders = F.explode(word_orders(F.col("_key"))).alias("_order")
    settled = _staged(exact)
    asked = settled.where("patient_id IS NULL").select("_key", orders)
    found = settled.where("patient_id IS NOT NULL")
    near = _nearest(asked, spelled, 1)
    if max_distance == 2:
        near = _staged(near)
        left = asked.join(near, "_key", "left_anti")
        thirds = left.select(F.explode(_thirds_near(F.col("_order"))).alias("_t")).distinct()
        like = (
            spelled.select("known_key", "patient_id", F.explode(_thirds(F.col("known_key"))).alias("_t"))
            .join(thirds.hint("merge"), "_t", "left_semi")
            .groupBy("known_key")
            .agg(F.min("patient_id").alias("patient_id"))
        )
        found = found.unionByName(_nearest(left, like, 2))
    return keyed.join(found.unionByName(near), "_key", "left").drop("_key")
