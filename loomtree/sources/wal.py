"""Write-ahead log: entries (sequence, op, ts, payload, crc32) as rows of an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("NODE_INSERT", "NODE_UPDATE", "NODE_DELETE", "EMBEDDING_SET", "SESSION_UPDATE", "CHECKPOINT")


def entries(rows: DataFrame) -> DataFrame:
    """rows (sequence, op, ts, payload) with the checksum of the payload."""
    return rows.withColumn("crc32", F.crc32("payload"))


def sound_prefix(log: DataFrame) -> DataFrame:
    """Entries before the first whose checksum fails or payload is missing."""
    bad = F.col("payload").isNull() | ~F.col("crc32").eqNullSafe(F.crc32("payload"))
    first = log.agg(F.min(F.when(bad, F.col("sequence"))).alias("first_bad"))
    return log.crossJoin(F.broadcast(first)).filter(F.col("first_bad").isNull() | (F.col("sequence") < F.col("first_bad"))).drop("first_bad")


def replay(log: DataFrame, from_sequence: int = 0) -> DataFrame:
    return sound_prefix(log).filter((F.col("sequence") > from_sequence) & (F.col("op") != "CHECKPOINT")).orderBy("sequence")


def since_checkpoint(log: DataFrame) -> DataFrame:
    last = log.agg(F.coalesce(F.max(F.when(F.col("op") == "CHECKPOINT", F.col("sequence"))), F.lit(0)).alias("last"))
    return sound_prefix(log).crossJoin(F.broadcast(last)).filter((F.col("sequence") > F.col("last")) & (F.col("op") != "CHECKPOINT")).drop("last")


def needs_checkpoint(log: DataFrame, most_bytes: int) -> bool:
    size = since_checkpoint(log).agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
    return size >= most_bytes


def state(log: DataFrame, key: str = "$.id") -> DataFrame:
    """key, op, payload: the last entry of each key, deleted keys left out."""
    keyed = replay(log).withColumn("key", F.get_json_object("payload", key))
    last = keyed.groupBy("key").agg(F.max_by(F.struct("op", "payload"), "sequence").alias("r"))
    return last.select("key", "r.*").filter("op <> 'NODE_DELETE'")
