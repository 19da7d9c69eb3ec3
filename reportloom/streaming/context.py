"""Live chat context as keyed state.

A session's newest messages are a list in the state store; a timer ends the session when the
watermark passes its expiry. A batch emits only the sessions it touched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reportloom.operators import chat
from reportloom.streaming.store import batch_writer, newest_rows, start

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


class RecentMessages(StatefulProcessor):
    """The ``n`` newest messages of a session.

    The list is not cut at pauses: a late message may still bridge one. What is emitted is: the
    newest messages up to the first pause of the TTL or longer. A message that has left the list
    cannot come back, as later ones only add to those before it, so a repeated id changes nothing.
    """

    def __init__(self, n: int, ttl_micros: int, id_type: str, key_name: str):
        self.n, self.ttl, self.id_type, self.key_name = n, ttl_micros, id_type, key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value of plain lists: reading or writing it is one call to the store, however many messages it has.
        self.recent = handle.getValueState("recent", f"us array<bigint>, id array<{self.id_type}>, body array<string>")

    def _held(self) -> list[tuple]:
        held = self.recent.get()
        return list(zip(*held, strict=True)) if held else []

    def _newest(self, held: dict) -> list[tuple]:
        return sorted(held.values(), key=lambda m: (m[0], m[1]), reverse=True)[: self.n]

    def _end(self, newest: list[tuple]) -> int:
        return -(-(newest[0][0] + self.ttl) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._held()
        held = {m[1]: m for m in before}
        for row in rows:
            message = row[2:]  # m_us, m_id, m_body
            known = held.get(message[1])
            if known is None or message[0] > known[0]:
                held[message[1]] = message
            if len(held) > 8 * self.n:
                held = {m[1]: m for m in self._newest(held)}
        newest = self._newest(held)
        if newest == before:
            return
        self.recent.update(tuple(map(list, zip(*newest, strict=True))))
        # A session has one timer: it is set when the session begins, and moved on when it fires too early.
        if not before:
            self.handle.registerTimer(self._end(newest))
        gaps = (newer[0] - older[0] for newer, older in zip(newest, newest[1:], strict=False))
        cut = next((i for i, gap in enumerate(gaps, 1) if gap >= self.ttl), len(newest))
        yield self._row(key, newest[0][0], [m[2] for m in newest[:cut]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if not held:
            return
        end = self._end(held)
        if end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
            return
        self.recent.clear()
        yield self._row(key, held[0][0], None)

    def close(self) -> None:
        pass

    def _row(self, key, last: int, bodies: list | None) -> Row:
        """One row per session, its messages newest first; none tells that the session has ended."""
        return Row(**{self.key_name: key[0], "_last": last, "_bodies": bodies})


def stream_context_window(
    messages: DataFrame, session: str, at: str, message_id: str, path: str, checkpoint: str,
    n: int = chat.CONTEXT_MESSAGES, ttl_seconds: int = chat.CONTEXT_TTL_SECONDS, late: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Messages -> the live context of every session, as changes per batch under ``path``.

    State holds at most ``n`` messages per session and goes when the watermark, ``late`` behind the
    newest message, has passed the session's expiry; a message that late starts a new session
    anyway. Repeated message ids count once. Rows without session, id or time are left out.
    """
    spark = messages.sparkSession
    types = dict(messages.dtypes)
    body = [c for c in messages.columns if c != session]
    given = messages.where(F.col(session).isNotNull() & F.col(message_id).isNotNull() & F.col(at).isNotNull()).select(
        session,
        F.col(at).cast("timestamp").alias("m_at"),  # names must not start with an underscore here
        chat._micros(at).alias("m_us"),
        F.col(message_id).alias("m_id"),
        F.to_json(F.struct(*body), _TIMES).alias("m_body"),
    )
    processor = RecentMessages(n, ttl_seconds * 1_000_000, types[message_id], session)
    changes = given.withWatermark("m_at", late).groupBy(session).transformWithState(
        processor,
        outputStructType=f"{session} {types[session]}, _last bigint, _bodies array<string>",
        outputMode="Update",
        timeMode="EventTime",
    )
    fields = ", ".join(f"{c} {types[c]}" for c in body)
    each = changes.select(session, "_last", F.posexplode_outer("_bodies").alias("_at", "_body"))
    rows = each.withColumn("_m", F.from_json("_body", fields, _TIMES)).select(
        session, *[F.col(f"_m.{c}").alias(c) for c in body], F.coalesce(F.col("_at") + 1, F.lit(0)).alias("recency"), "_last"
    )
    setting = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        return start(rows, batch_writer(path), checkpoint, "update", available_now)
    finally:
        spark.conf.set(setting, old)


def current_context(spark: SparkSession, path: str, session: str, ttl_seconds: int = chat.CONTEXT_TTL_SECONDS) -> DataFrame:
    """The context rows of all sessions that are alive at the newest message seen."""
    rows = newest_rows(spark.read.parquet(path), session)
    as_of: Column = rows.agg(F.max("_last")).scalar()
    return rows.where((F.col("recency") > 0) & (F.col("_last") + ttl_seconds * 1_000_000 > as_of)).drop("_last")
