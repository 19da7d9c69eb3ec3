"""Chat session queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reportloom.operators import chat as op
from reportloom.suite import tables as tb
from reportloom.suite.registry import query

_C = f"WITH {tb.CHAT_SQL}"
_US = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    "session_messages",
    f"{_C} SELECT session_id, user_id, turn, role, length(content) AS n FROM messages JOIN sessions USING (session_id) WHERE user_id = 'u3'",
)
def session_messages(spark, sf_dir):
    got = op.session_messages(tb.sessions(spark, sf_dir), tb.messages(spark, sf_dir), "u3")
    return got.select("session_id", "user_id", "turn", "role", F.length("content").alias("n"))


@query(
    "sessions_newest_first",
    f"{_C} SELECT session_id, user_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM sessions ORDER BY updated_at DESC, session_id",
)
def sessions_newest_first(spark, sf_dir):
    got = op.sessions_newest_first(tb.sessions(spark, sf_dir))
    return got.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "default_session",
    f"{_C} SELECT user_id, arg_max(session_id, (updated_at, -session_id)) AS session_id FROM sessions GROUP BY user_id",
)
def default_session(spark, sf_dir):
    return op.default_session(tb.sessions(spark, sf_dir))


_LAST = """recent AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS recency FROM messages)"""


@query(
    "last_n_messages",
    f"{_C}, {_LAST} SELECT session_id, turn, role, content, recency FROM recent WHERE recency <= 3",
)
def last_n_messages(spark, sf_dir):
    return op.last_n_messages(tb.messages(spark, sf_dir).drop("created_at"), ["turn"], 3)


@query(
    "last_n_events",
    """SELECT user_id, event_id, recency FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events)
WHERE recency <= 20""",
)
def last_n_events(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return op.last_n_messages(events, ["ts", "event_id"], session="user_id").drop("ts")


@query(
    "context_payload",
    f"""{_C}, {_LAST} SELECT session_id,
  to_json(list({{'role': role, 'content': content, 'created_at': created_at}} ORDER BY turn)) AS payload
FROM recent WHERE recency <= 4 GROUP BY session_id""",
)
def context_payload(spark, sf_dir):
    return op.context_payload(tb.messages(spark, sf_dir), ["turn"], 4)


@query(
    "parse_context_payload",
    f"""{_C}, {_LAST} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pos,
  role, content, created_at FROM recent WHERE recency <= 20""",
)
def parse_context_payload(spark, sf_dir):
    return op.parse_context_payload(op.context_payload(tb.messages(spark, sf_dir), ["turn"]))


@query(
    "render_history",
    f"""{_C}, {_LAST},
turns AS (SELECT session_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || content, chr(10) ORDER BY recency) AS t
          FROM recent WHERE recency <= 6 GROUP BY session_id),
q AS (SELECT DISTINCT conv_id AS session_id, 'what about ' || conv_id AS question,
             CASE WHEN conv_id % 3 = 0 THEN 'Doc ' || conv_id END AS document FROM conversations
      UNION ALL SELECT -p_partkey - 1, 'alone', NULL FROM part)
SELECT q.session_id, CASE WHEN t IS NULL THEN question ELSE
  '[Previous conversation]' || chr(10) || t || repeat(chr(10), 3) || '[Current Question]' || chr(10) || question
  || coalesce(chr(10) || chr(10) || '[Document Context]' || chr(10) || document, '') END AS prompt
FROM q LEFT JOIN turns USING (session_id)""",
)
def render_history(spark, sf_dir):
    key = F.col("session_id").cast("string")
    known = tb.messages(spark, sf_dir).select("session_id").distinct().select(
        "session_id", F.concat(F.lit("what about "), key).alias("question"),
        F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("Doc "), key)).alias("document"),
    )
    alone = tb.table(spark, sf_dir, "part").select(
        (-F.col("p_partkey") - 1).alias("session_id"), F.lit("alone").alias("question"),
        F.lit(None).cast("string").alias("document"),
    )
    got = op.render_history(known.unionByName(alone), tb.messages(spark, sf_dir), ["turn"], 6)
    return got.select("session_id", "prompt")


@query(
    "attach_uploaded_doc",
    """WITH up AS (SELECT user_id, ts AS cached_at, event_id AS doc FROM events WHERE event_type IN ('purchase', 'signup')),
msg AS (SELECT user_id, ts, event_id FROM events WHERE event_type NOT IN ('purchase', 'signup')),
pairs AS (SELECT m.event_id, u.doc, u.cached_at, row_number() OVER (PARTITION BY m.event_id ORDER BY u.cached_at DESC, u.doc DESC) AS rn
          FROM msg m JOIN up u ON m.user_id = u.user_id AND u.cached_at <= m.ts AND m.ts < u.cached_at + INTERVAL 3600 SECOND)
SELECT m.event_id, coalesce(p.doc, -1) AS doc, coalesce(strftime(p.cached_at, '%Y-%m-%d %H:%M:%S.%f'), '-') AS cached_at
FROM msg m LEFT JOIN pairs p ON m.event_id = p.event_id AND rn = 1""",
)
def attach_uploaded_doc(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    is_upload = F.col("event_type").isin("purchase", "signup")
    uploads = events.where(is_upload).select("user_id", "ts", F.col("event_id").alias("doc"))
    msgs = events.where(~is_upload).drop("event_type")
    got = op.attach_uploaded_doc(msgs, uploads, ["user_id"], tie="doc")
    return got.select(
        "event_id", F.coalesce("doc", F.lit(-1)).alias("doc"),
        F.coalesce(F.date_format("cached_at", _US), F.lit("-")).alias("cached_at"),
    )


@query(
    "active_sessions",
    """SELECT count(DISTINCT user_id) AS active_sessions FROM events
WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'""",
)
def active_sessions(spark, sf_dir):
    return op.active_sessions(tb.table(spark, sf_dir, "events"), dt.datetime(2024, 1, 15, 12), session="user_id")


SESSION_ACTIVITY_SQL = """WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 3600 SECOND THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n_writes
FROM n GROUP BY user_id, no"""


@query("session_activity", SESSION_ACTIVITY_SQL)
def session_activity(spark, sf_dir):
    got = op.session_activity(tb.table(spark, sf_dir, "events"), "user_id")
    return got.withColumns({c: F.date_format(c, _US) for c in ("session_start", "session_end")})
