"""Content items: rows, routing, surrounding context, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions import content as ct, text as tx


def separate_content(docs: DataFrame, items: str = "items", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., text_content, multimodal) from a content list column; no shuffle."""
    return docs.select(
        *keep,
        ct.separate_text(F.col(items)).alias("text_content"),
        ct.separate_modal(F.col(items)).alias("multimodal"),
    )


def content_items(docs: DataFrame, items: str = "items", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per item: (keep..., pos, item fields...)."""
    # Exploding a bare column makes the optimizer add size and null filters on it; where the
    # list is itself computed, those would compute it again below. A slice hides it.
    whole = F.slice(items, 1, 2**31 - 1)
    return docs.select(*keep, F.posexplode(whole).alias("pos", "_item")).select(*keep, "pos", "_item.*")


def content_type_distribution(items: DataFrame, multimodal_only: bool = True) -> DataFrame:
    """Items per type. Over all items a missing type shows as ``unknown``; among multimodal
    ones it cannot occur, as it counts as text."""
    if multimodal_only:
        kept = items.where(ct.kind_of(F.col("type")) != "text").select("type")
    else:
        kept = items.select(F.coalesce("type", F.lit("unknown")).alias("type"))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n_items"))


def _sources(items: DataFrame, types: tuple[str, ...], headers: bool, captions: bool) -> DataFrame:
    kind = ct.kind_of(F.col("type"))
    fields = ("type", "text", "text_level", "image_caption", "table_caption")
    shown = ct.format_context(F.struct(*fields), headers, captions)
    return (
        items.where(kind.isin(*types))
        .select("doc_id", "pos", "page_idx", shown.alias("shown"))
        .where("shown IS NOT NULL")
    )


def _targets(items: DataFrame) -> DataFrame:
    return items.where(ct.kind_of(F.col("type")) != "text").select("doc_id", "pos", "page_idx")


def _joined(context: Column, max_words: int) -> Column:
    return ct.truncate_to_words(F.array_join(context, "\n"), max_words)


def page_context(
    items: DataFrame,
    window: int = 1,
    max_words: int = ct.MAX_CONTEXT_WORDS,
    types: tuple[str, ...] = ("text",),
    headers: bool = True,
    captions: bool = True,
) -> DataFrame:
    """(doc_id, pos, context) for every non-text item: what stands within ``window`` pages.

    The item itself is left out; order is page, then position. The context is cut to
    ``max_words``, so of each page only the leading items are gathered, up to one past
    2 x ``max_words`` words (twice, because the item left out may be among them; one past,
    because a cut shows only if something follows): lists stay bounded however many items a
    page has, and the result is the same as from the whole page.
    """
    src = _sources(items, types, headers, captions)
    page = Window.partitionBy("doc_id", "page_idx").orderBy("pos")
    # Each item has a word at least. The rank limit is applied before the shuffle, so a page with
    # very many items sends few rows a task; totals and lists then stay in the same partition.
    near = 2 * max_words + 1
    cut = src.withColumn("_n", F.row_number().over(page)).where(F.col("_n") <= near)
    words = F.least(ct.n_words(F.col("shown")), F.lit(max_words + 1))
    before = F.coalesce(F.sum(words).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = cut.withColumn("_before", before).where(F.col("_before") <= 2 * max_words)
    pages = lead.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("_items"))
    around = (
        pages.withColumn("_page", F.explode(F.sequence(F.col("page_idx") - window, F.col("page_idx") + window)))
        .groupBy("doc_id", F.col("_page").alias("_at"))
        .agg(F.array_sort(F.collect_list(F.struct("page_idx", "_items"))).alias("_pages"))
        .select("doc_id", F.col("_at").alias("page_idx"), F.flatten(F.transform("_pages", lambda p: p["_items"])).alias("_all"))
    )
    own = F.col("pos")
    others = F.transform(F.filter("_all", lambda i: i["pos"] != own), lambda i: i["shown"])
    return _targets(items).join(around, ["doc_id", "page_idx"], "left").select(
        "doc_id", "pos", F.coalesce(_joined(others, max_words), F.lit("")).alias("context")
    )


def chunk_context(
    items: DataFrame,
    window: int = 1,
    max_words: int = ct.MAX_CONTEXT_WORDS,
    types: tuple[str, ...] = ("text",),
    headers: bool = True,
    captions: bool = True,
) -> DataFrame:
    """(doc_id, pos, context) for every non-text item: the ``window`` items on either side.

    Neighbours are addressed by (doc_id, pos), so work spreads by position, not by document.
    """
    src = _sources(items, types, headers, captions).select(
        "doc_id", F.col("pos").alias("_from"), "shown",
        F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos"),
    ).where("pos <> _from")
    targets = _targets(items).select("doc_id", "pos")
    near = (
        targets.join(src, ["doc_id", "pos"])
        .groupBy("doc_id", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("_from", "shown"))).alias("_near"))
    )
    others = F.transform("_near", lambda i: i["shown"])
    return targets.join(near, ["doc_id", "pos"], "left").select(
        "doc_id", "pos", F.coalesce(_joined(others, max_words), F.lit("")).alias("context")
    )


def chunk_context_of_lists(
    docs: DataFrame,
    items: str = "items",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = 1,
    max_words: int = ct.MAX_CONTEXT_WORDS,
    types: tuple[str, ...] = ("text",),
    headers: bool = True,
    captions: bool = True,
) -> DataFrame:
    """(keep..., pos, context) like ``chunk_context``, from rows that hold whole content lists.

    Every item is rendered once and neighbours are slices of the row's own list, so the lists are
    read once and nothing is shuffled or joined; work grows with items times ``window``.
    """

    def shown_of(item: Column) -> Column:
        return F.when(ct.kind_of(item["type"]).isin(*types), ct.format_context(item, headers, captions))

    def contexts(whole: Column) -> Column:
        kinds = F.transform(whole, lambda item, i: F.struct(i.alias("pos"), ct.kind_of(item["type"]).alias("kind")))
        targets = F.transform(F.filter(kinds, lambda k: k["kind"] != "text"), lambda k: k["pos"])

        def around(shown: Column) -> Column:
            def one(pos: Column) -> Column:
                before = F.least(pos, F.lit(window))
                near = F.concat(F.slice(shown, pos - before + 1, before), F.slice(shown, pos + 2, F.lit(window)))
                return F.struct(pos.alias("pos"), _joined(near, max_words).alias("context"))

            return F.transform(targets, one)

        return tx.bind(F.transform(whole, shown_of), around)

    return docs.select(*keep, F.inline(tx.bind(F.col(items), contexts)))


def chunk_documents(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), **how
) -> DataFrame:
    """(keep..., chunk_index, chunk, n_words); ``how`` goes to ``chunk_text``."""
    chunks = ct.chunk_text(F.col(text_col), **how)
    rows = docs.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk"))
    return rows.withColumn("n_words", ct.n_words(F.col("chunk")))


def explode_analytes(uploads: DataFrame, entities: str = "entities", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per analyte of an upload; uploads without any keep one row of NULLs."""
    return uploads.select(
        *keep, F.posexplode_outer(f"{entities}.analytes").alias("pos", "_a")
    ).select(*keep, "pos", "_a.*")
