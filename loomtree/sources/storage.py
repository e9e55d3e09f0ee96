"""Tables on disk: partitioned Parquet with snapshots, append, latest-wins compaction and statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree import latest

KEYS = {"nodes": ["node_id"], "embeddings": ["level", "node_id"], "sessions": ["session_id"], "postings": ["token", "node_id"]}
PARTITIONS = {"nodes": ["level"], "embeddings": ["level"]}


class Store:
    """A folder of tables. A write makes a new version of a table's part list; rows are never changed in place.

    nodes and embeddings are partitioned by level, so a search on some levels reads these only. Deletes are tombstone rows (deleted =
    true); a read keeps the row with the largest sequence_num of each key and drops tombstones. compact() rewrites a table that way to a
    new version, and readers of the old one go on undisturbed. Each version lists the files that went into it: rows that were appended
    to an older version meanwhile are in none of these, and are read beside the new one until the next compaction takes them in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, table: str, version: int | None = None) -> str:
        return f"{self.path}/{table}/v{self.version(table) if version is None else version}"

    def version(self, table: str) -> int:
        try:
            return self.spark.read.json(f"{self.path}/{table}-versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def _files(self, folder: str) -> list[str]:
        try:
            return self.spark.read.parquet(folder).inputFiles()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []

    def _late(self, table: str, version: int) -> dict[str, list[str]]:
        """Files of older versions that no compaction has read, by folder."""
        if not version:
            return {}
        taken = {r["file"] for r in self.spark.read.json(f"{self.path}/{table}-versions").select(F.explode("files").alias("file")).distinct().collect()}
        found = {f"{self.path}/{table}/v{v}": [] for v in range(version)}
        for folder in found:
            found[folder] = [f for f in self._files(folder) if f not in taken]
        return {k: v for k, v in found.items() if v}

    def append(self, table: str, rows: DataFrame, deleted: bool = False, version: int | None = None) -> None:
        """rows need sequence_num. One call is one job: its files appear when the job is committed, by Spark's committer."""
        out = rows.withColumn("deleted", F.lit(deleted))
        writer = out.write.mode("append")
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.parquet(self._folder(table, version))

    def log(self, table: str) -> DataFrame:
        version = self.version(table)
        out = self.spark.read.parquet(self._folder(table, version))
        for folder, files in self._late(table, version).items():
            out = out.unionByName(self.spark.read.option("basePath", folder).schema(out.schema).parquet(*files))
        return out

    def _live(self, rows: DataFrame, table: str) -> DataFrame:
        key = F.struct(*KEYS[table])
        newest = rows.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*rows.columns), "sequence_num").alias("r")).select("r.*")
        return newest.filter(~F.col("deleted")).drop("deleted")

    def read(self, table: str) -> DataFrame:
        return self._live(self.log(table), table)

    def compact(self, table: str, files: int = 1) -> None:
        """A new version that holds the live rows only."""
        new, rows = self.version(table) + 1, self.log(table)
        taken = rows.inputFiles()
        writer = self._live(rows, table).withColumn("deleted", F.lit(False)).coalesce(files).write
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.parquet(f"{self.path}/{table}/v{new}")
        self.spark.createDataFrame([(new, taken)], "version int, files array<string>").coalesce(1).write.mode("append").json(f"{self.path}/{table}-versions")

    def snapshot(self, table: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/v{version}")

    def stats(self, table: str) -> DataFrame:
        return self.log(table).agg(F.count("*").alias("rows"), F.count_if("deleted").alias("tombstones"), F.max("sequence_num").alias("last_sequence"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; rows that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_wins(rows: DataFrame, key: str, order: str = "sequence_num") -> DataFrame:
    return latest(rows, key, order)
