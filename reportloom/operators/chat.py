"""Chat sessions: recent context, payloads, attached documents, activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

CONTEXT_MESSAGES = 20
CONTEXT_TTL_SECONDS = 3600

PAYLOAD_DDL = "array<struct<role:string,content:string,created_at:string>>"


def _micros(at) -> Column:
    """Microseconds since 1970; zone-less timestamps are read in the session zone."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def session_messages(sessions: DataFrame, messages: DataFrame, user_id=None) -> DataFrame:
    """Messages of all sessions, or of one user's, with the owner."""
    own = sessions if user_id is None else sessions.where(F.col("user_id") == user_id)
    return messages.join(own.select("session_id", "user_id"), "session_id")


def sessions_newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("updated_at").desc_nulls_last(), F.col("session_id").asc())


def default_session(sessions: DataFrame) -> DataFrame:
    """The newest session of each user (what a client opens first)."""
    # The smallest id among equals, to agree with the ordering above.
    newest = F.min_by("session_id", F.struct(-_micros("updated_at"), F.col("session_id")))
    return sessions.groupBy("user_id").agg(newest.alias("session_id"))


def last_n_messages(
    messages: DataFrame, order: list[str], n: int = CONTEXT_MESSAGES, session: str = "session_id"
) -> DataFrame:
    """The ``n`` newest messages of each session, with ``recency`` 1 for the newest.

    The rank limit is applied map-side first, so of a huge session each task sends at most
    ``n`` rows.
    """
    newest = Window.partitionBy(session).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return messages.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def context_payload(
    messages: DataFrame, order: list[str], n: int = CONTEXT_MESSAGES, session: str = "session_id"
) -> DataFrame:
    """(session, payload): JSON array of the last ``n`` messages, oldest first.

    Each list holds at most ``n`` messages, so collecting it is bounded.
    """
    recent = last_n_messages(messages, order, n, session)
    item = F.struct((-F.col("recency")).alias("at"), "role", "content", "created_at")
    ordered = F.array_sort(F.collect_list(item))
    plain = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("created_at")))
    return recent.groupBy(session).agg(F.to_json(plain).alias("payload"))


def parse_context_payload(payloads: DataFrame, session: str = "session_id") -> DataFrame:
    """The messages back from their payloads, ``pos`` from 0."""
    items = F.from_json("payload", PAYLOAD_DDL)
    return payloads.select(session, F.posexplode(items).alias("pos", "m")).select(session, "pos", "m.*")


def render_history(
    questions: DataFrame,
    messages: DataFrame,
    order: list[str],
    n: int = CONTEXT_MESSAGES,
    session: str = "session_id",
) -> DataFrame:
    """Question text with the previous turns in front, newest first.

    ``questions`` holds (session, question) and optionally ``document``, the text of an
    attached file. Without earlier messages the question stands alone.
    """
    recent = last_n_messages(messages, order, n, session)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("content"))
    items = F.array_sort(F.collect_list(F.struct("recency", line.alias("line"))))
    turns = recent.groupBy(session).agg(
        F.array_join(F.transform(items, lambda m: m["line"]), "\n").alias("_turns")
    )
    question = F.col("question")
    if "document" in questions.columns:
        attached = F.concat(F.lit("\n\n[Document Context]\n"), F.col("document"))
        question = F.concat(question, F.coalesce(attached, F.lit("")))
    with_turns = F.concat(
        F.lit("[Previous conversation]\n"), F.col("_turns"), F.lit("\n\n\n[Current Question]\n"), question
    )
    return (
        questions.join(turns, session, "left")
        .withColumn("prompt", F.coalesce(with_turns, question))
        .drop("_turns")
    )


def attach_uploaded_doc(
    messages: DataFrame,
    uploads: DataFrame,
    keys: list[str],
    at: str = "ts",
    doc: str = "doc",
    tie: str | None = None,
    ttl_seconds: int = CONTEXT_TTL_SECONDS,
) -> DataFrame:
    """Each message with the latest upload of the same keys that is still alive.

    An upload at ``t`` serves messages in ``[t, t + ttl)``; a later upload replaces it.
    Time is cut into slots of one TTL, so only a message's own slot and the one before can
    hold its upload: rows meet per (keys, slot), never per whole session, and no
    message-upload pairs are formed. ``tie`` orders uploads of the same instant.
    """
    micros = ttl_seconds * 1_000_000
    slot = F.floor(_micros(at) / micros)
    tie_col = F.col(tie) if tie else F.lit(0)
    value = F.struct(F.col(at).alias("at"), F.col(doc).alias("doc"))
    up = uploads.select(
        *keys, slot.alias("_slot"), _micros(at).alias("_us"), tie_col.alias("_tie"), value.alias("_up")
    )
    none = F.lit(None)
    stored = up.select(*keys, "_slot", "_us", F.lit(1).alias("_kind"), "_tie", "_up", none.alias("_msg"))
    before = (
        up.groupBy(*keys, (F.col("_slot") + 1).alias("_slot"))
        .agg(F.max_by("_up", F.struct("_us", "_tie")).alias("_up"))
        .select(
            *keys, "_slot", (F.col("_slot") * micros).alias("_us"), F.lit(0).alias("_kind"),
            none.alias("_tie"), "_up", none.alias("_msg"),
        )
    )
    cols = [c for c in messages.columns if c not in keys]
    asked = messages.select(
        *keys, slot.alias("_slot"), _micros(at).alias("_us"), F.lit(2).alias("_kind"), none.alias("_tie"),
        none.alias("_up"), F.struct(*cols).alias("_msg"),
    )
    order = Window.partitionBy(*keys, "_slot").orderBy("_us", "_kind", "_tie")
    latest = F.last("_up", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = asked.unionByName(stored).unionByName(before).withColumn("_latest", latest)
    alive = F.col("_us") < _micros("_latest.at") + micros
    return rows.where("_kind = 2").select(
        *keys,
        *[F.col(f"_msg.{c}").alias(c) for c in cols],
        F.when(alive, F.col("_latest.doc")).alias(doc),
        F.when(alive, F.col("_latest.at")).alias("cached_at"),
    )


def active_sessions(
    writes: DataFrame, as_of: dt.datetime, at: str = "ts", session: str = "session_id",
    ttl_seconds: int = CONTEXT_TTL_SECONDS,
) -> DataFrame:
    """Number of sessions whose cache entry is alive at ``as_of``."""
    since = as_of - dt.timedelta(seconds=ttl_seconds)
    kind = writes.schema[at].dataType  # literals of the same type push down to the scan
    after, until = (F.lit(t).cast("timestamp_ntz").cast(kind) for t in (since, as_of))
    live = writes.where((F.col(at) > after) & (F.col(at) <= until))
    return live.agg(F.count_distinct(session).alias("active_sessions"))


def session_activity(
    writes: DataFrame, key: str, at: str = "ts", ttl_seconds: int = CONTEXT_TTL_SECONDS
) -> DataFrame:
    """Live periods per key: (key, session_start, session_end, n_writes).

    A period ends ``ttl`` after its last write. Two writes in one TTL-sized slot always
    belong together, so rows first fold to one per (key, slot); only those few summaries
    are put in order per key, however many writes a key has.
    """
    micros = ttl_seconds * 1_000_000
    slots = writes.groupBy(key, F.floor(_micros(at) / micros).alias("_slot")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(key).orderBy("_slot")
    gap = _micros("_first") - _micros(F.lag("_last").over(order))
    starts = slots.withColumn("_new", F.when(gap.isNull() | (gap >= micros), 1).otherwise(0))
    numbered = starts.withColumn(
        "_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(key, "_no").agg(
        F.min("_first").alias("session_start"),
        (F.max("_last") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("session_end"),
        F.sum("_n").alias("n_writes"),
    ).drop("_no")
