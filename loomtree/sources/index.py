"""A keyword index on disk: postings sorted by token, and document lengths, kept under the fingerprint of the files they were made from."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import fulltext


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset, on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtree-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or folder: names, sizes and times of what is in it."""
    fs, at = _file_system(spark, path)
    found = sorted(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in fs.listStatus(at))
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def stored(spark: SparkSession, source: str, docs: Callable[[], DataFrame], name: str = "index") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of the documents that docs makes from the files at source; built once, and again when these change.

    Postings are dealt by ranges of (token, node_id), so a token that a third of all documents have is several files, and are sorted: a
    filter on tokens reads the row groups that have them. A build is written aside and renamed, so a half-written one is never read.
    """
    path = f"{shared_folder(spark)}/{name}-{fingerprint(spark, source)}"
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        aside = f"{path}-{uuid.uuid4().hex}"
        postings = fulltext.build_postings(docs())
        postings.repartitionByRange("token", "node_id").sortWithinPartitions("token", "node_id").write.parquet(f"{aside}/postings")
        fulltext.doc_stats(spark.read.parquet(f"{aside}/postings")).write.parquet(f"{aside}/lengths")
        if not fs.rename(_file_system(spark, aside)[1], at) and not fs.exists(at):
            raise OSError(f"{aside} can't be renamed to {path}")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
