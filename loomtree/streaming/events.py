"""Events as a stream of JSON lines: emit, read, count, deduplicate, window, sessionize, and maintain indices.

The batch and the streaming form of each aggregate are one function: it takes a DataFrame, streaming or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "id string, type string, node_id long, session_id string, agent_id string, timestamp timestamp, trace_id string, data map<string,string>"
TYPES_H = ("memory_stored", "memory_deleted", "session_created", "session_updated", "query_performed")
TYPES_E = tuple(t.replace("_", ".", 1) for t in TYPES_H)


def _event(kind: str, data: Column | None = None, node: Column | None = None, session: Column | None = None, agent: Column | None = None, trace: Column | None = None, at: Column | None = None, key: Column | None = None) -> list[Column]:
    null = lambda t: F.lit(None).cast(t)
    return [
        (F.uuid() if key is None else key).alias("id"),
        F.lit(kind).alias("type"),
        (null("long") if node is None else node).alias("node_id"),
        (null("string") if session is None else session).alias("session_id"),
        (null("string") if agent is None else agent).alias("agent_id"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        (null("string") if trace is None else trace).alias("trace_id"),
        (F.create_map().cast("map<string,string>") if data is None else data).alias("data"),
    ]


def stored(nodes: DataFrame, **more) -> DataFrame:
    data = F.create_map(F.lit("level"), F.col("level").cast("string"))
    return nodes.select(*_event("memory_stored", data, F.col("node_id"), F.col("session_id"), F.col("agent_id"), **more))


def deleted(nodes: DataFrame, **more) -> DataFrame:
    return nodes.select(*_event("memory_deleted", None, F.col("node_id"), **more))


def session_created(sessions: DataFrame, **more) -> DataFrame:
    return sessions.select(*_event("session_created", None, None, F.col("session_id"), F.col("agent_id"), **more))


def session_updated(sessions: DataFrame, **more) -> DataFrame:
    return sessions.select(*_event("session_updated", None, None, F.col("session_id"), **more))


def query_performed(queries: DataFrame, **more) -> DataFrame:
    """queries: query, results, latency_us."""
    data = F.create_map(*(x for c in ("query", "results", "latency_us") for x in (F.lit(c), F.col(c).cast("string"))))
    return queries.select(*_event("query_performed", data, **more))


def with_trace(events: DataFrame, trace_id: str | None = None) -> DataFrame:
    return events.withColumn("trace_id", F.coalesce("trace_id", F.lit(trace_id) if trace_id else F.uuid()))


def write(events: DataFrame, folder: str) -> None:
    """Append as JSON lines, one folder a day (rotation)."""
    events.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", day date").json(folder).drop("day")


def read_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA + ", day date").option("maxFilesPerTrigger", per_trigger).json(folder).drop("day")


def write_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Emitter:
    """Subscribers get every batch; emitting can be switched off; flush waits for what has arrived."""

    def __init__(self, events: DataFrame, checkpoint: str | None = None):
        self.events, self.checkpoint, self.enabled, self.query = events, checkpoint, True, None
        self.subscribers: dict[int, Callable[[DataFrame, int], None]] = {}
        self._next = 0

    def subscribe(self, call: Callable[[DataFrame, int], None]) -> int:
        self._next += 1
        self.subscribers[self._next] = call
        return self._next

    def unsubscribe(self, number: int) -> None:
        self.subscribers.pop(number, None)

    def _deliver(self, batch: DataFrame, epoch: int) -> None:
        if self.enabled:
            batch.persist()
            for call in list(self.subscribers.values()):
                call(batch, epoch)
            batch.unpersist()

    def start(self, **trigger) -> StreamingQuery:
        writer = self.events.writeStream.foreachBatch(self._deliver)
        if self.checkpoint:
            writer = writer.option("checkpointLocation", self.checkpoint)
        self.query = writer.trigger(**(trigger or {"availableNow": True})).start()
        return self.query

    def flush(self) -> None:
        self.query.processAllAvailable()

    def stop(self) -> None:
        self.query.stop()


# Aggregates, batch or streaming.


def source_events(raw: DataFrame) -> DataFrame:
    """The fixture's events as (id, type, user_id, timestamp, value, data)."""
    return raw.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), "user_id", F.col("ts").cast("timestamp").alias("timestamp"), "value", F.from_json("props", "map<string,string>").alias("data"))


def count_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width, step)).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("timestamp", late).groupBy("user_id", F.session_window("timestamp", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each id once: within the watermark on a stream, anywhere in a table."""
    if events.isStreaming:
        return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])
    return events.dropDuplicates(["id"])


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there into an in-memory table, and give that (tests and small results)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def index_stream(nodes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Postings kept up to date: each batch of nodes is tokenised and written under its batch number, so a replayed batch overwrites itself."""
    from ..operators.fulltext import build_postings

    def add(batch: DataFrame, epoch: int) -> None:
        build_postings(batch).write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return nodes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
