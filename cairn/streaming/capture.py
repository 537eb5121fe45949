"""Session events as a stream: sessions once, observations appended, whatever the batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from cairn.functions import text as X
from cairn.operators.store import Store

EVENT = "event string, session_id string, ide string, cwd string, room string, content string, prompt string, tool string, result string, ts timestamp"
KINDS = ("session_start", "prompt_submit", "tool_use", "ai_response", "session_end")


def source(spark: SparkSession, path: str) -> DataFrame:
    """JSON event files as a stream; broken lines become rows of nulls, which are left out."""
    return spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").json(path).filter(F.col("event").isin(*KINDS) & F.col("session_id").isNotNull())


def kind() -> Column:
    return F.when(F.col("event") == "prompt_submit", "prompt").when(F.col("event") == "tool_use", "tool_use").when(F.col("event") == "ai_response", "response")


def content() -> Column:
    tool = F.concat(F.coalesce("tool", F.lit("")), F.lit(": "), F.coalesce("result", F.lit("")))
    return F.when(F.col("event") == "tool_use", tool).otherwise(F.coalesce("content", "prompt", F.lit("")))


def sessions(events: DataFrame) -> DataFrame:
    """One row a session: its first event gives the fields, a session_end its end."""
    first = F.min_by(F.struct("ide", "cwd", "room"), "ts")
    ended = F.max(F.when(F.col("event") == "session_end", F.col("ts")))
    rows = events.groupBy(F.col("session_id").alias("id")).agg(first.alias("f"), F.min("ts").alias("started_at"), ended.alias("ended_at"))
    return rows.select("id", "f.ide", "f.cwd", "f.room", "started_at", "ended_at", F.lit(None).cast("string").alias("metadata"))


def observations(events: DataFrame, intensity: str = "full", private: bool = False) -> DataFrame:
    """What was said or done, compressed; cleaned of secrets first only with ``private``."""
    rows = events.withColumn("kind", kind()).filter("kind is not null").withColumn("content", content())
    if private:
        rows = rows.withColumn("content", X.preprocess("content")["text"])
    key = F.sha2(F.concat_ws("\u0001", "session_id", "event", F.col("ts").cast("string"), "content"), 256)
    return rows.select(key.alias("id"), "session_id", "kind", "content", X.compress("content", intensity).alias("compressed"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("metadata"))


#: Session ids of a micro-batch whose stored rows are looked up by key; more are joined.
LOOKED_UP = 1 << 12
#: Seconds after which sessions that say nothing are no longer held as state.
IDLE = 86_400
_CHANGED = "id string, ide string, cwd string, room string, started long, ended long"


class Sessions(StatefulProcessor):
    """The earliest event and the end of each session; gives a row whenever one of them changes, and forgets a session that is idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "ide string, cwd string, room string, started long, ended long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.known.get()  # one call each way for a session, to read and to keep
        had, due = (None, None) if held is None else (tuple(held[:5]), held[5])
        now, last = had, 0
        for row in rows:
            at = row["at"]
            if now is None or (at is not None and (now[3] is None or at < now[3])):
                now = (row["ide"], row["cwd"], row["room"], at, None if now is None else now[4])
            if at is None:
                continue  # tells that the session is there, and nothing else
            last = max(last, at // 1000)
            if row["event"] == "session_end" and (now[4] is None or at > now[4]):
                now = (*now[:4], at)
        idle = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if idle != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(idle)
        if now != had or idle != due:
            self.known.update((*now, idle))
        if now != had:
            yield Row(id=key[0], ide=now[0], cwd=now[1], room=now[2], started=now[3], ended=now[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def changed_sessions(events: DataFrame, delay: str = "1 hour", idle: int = IDLE) -> DataFrame:
    """A row of a stream's session whenever its earliest event or its end changes; events later than the delay are left out."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("session_id", "event", "ide", "cwd", "room", F.unix_micros("ts").alias("at"), "ts").withWatermark("ts", delay)
    changed = rows.groupBy("session_id").transformWithState(Sessions(1000 * idle), _CHANGED, "Update", "EventTime")
    return changed.select("id", "ide", "cwd", "room", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("ended_at"))


def merge_sessions(store: Store, changed: DataFrame) -> None:
    """Takes rows of sessions into the store: of what is stored and what comes the earlier start, with its fields, and the later end."""
    ids = [r["id"] for r in changed.select("id").distinct().limit(LOOKED_UP + 1).collect()]
    if not ids:
        return
    mine = F.struct("started_at", "ide", "cwd", "room")

    def made(known: DataFrame) -> DataFrame:
        known = known.select(*changed.columns).join(changed.select("id").distinct(), "id", "left_semi")
        every = known.withColumn("_new", F.lit(1)).unionByName(changed.withColumn("_new", F.lit(2)))
        one = every.groupBy("id").agg(F.min_by(mine, F.struct(F.col("started_at"), "_new")).alias("f"), F.max("ended_at").alias("ended_at"))
        return one.select("id", "f.*", "ended_at")

    store.change("sessions", made, among=ids if len(ids) <= LOOKED_UP else None)


class Capture:
    """The two queries of a capture."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self) -> None:
        for q in self.queries:
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def capture(store: Store, events: DataFrame, checkpoint: str, intensity: str = "full", delay: str = "1 hour", idle: int = IDLE) -> Capture:
    """Starts queries that keep sessions and observations; a batch that is run again adds nothing.

    What a batch costs follows its events: sessions that it changes are looked up by key, others are not read.
    """

    def keep(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                store.upsert("observations", observations(batch.dropDuplicates(), intensity))
        finally:
            batch.unpersist()

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            merge_sessions(store, batch)
        finally:
            batch.unpersist()

    start = lambda rows, how, name, mode: rows.writeStream.foreachBatch(how).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return Capture(start(changed_sessions(events, delay, idle), merge, "sessions", "update"), start(events, keep, "observations", "append"))


def distinct_sessions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each session within the watermark, for streams that need no table of sessions."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id"])
