"""A quality classifier on document statistics: random Fourier features, ridge regression, isotonic calibration.

Each text becomes some twenty statistics (shares of character classes, lengths, repetition), standardised by the table's means and
deviations. cos(x W + b) with W normal approximates a Gaussian kernel, so ridge regression on these features is kernel ridge
regression at a fixed cost. Tasks sum their rows' normal equations, sums are added up in a shuffle, and the driver solves one system
of `features` unknowns, whatever the input. It is fit on about `most` labelled rows if there are more, drawn by the ids' hashes, so that
what the tasks send doesn't grow with the input. Two folds score each other for calibration: their scores, counted in bins, are made
monotone by pooling adjacent violators; the model that scores is fit on both. A thousandth of the raw score breaks the calibrated
score's ties.

Labels are learnt only from rows where crc32(doc_id as text) mod 3 is not 1. Only the text enters a score.

Defined results: a null text is an empty one and has a score; with no labels to learn from all scores are 0.5; labels that are null or
of unknown ids are ignored; a null id has no label; rows with repeated ids keep their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, lean, materialize, only
from .statistics import CLASSES, COMMON, Document, class_counts, word_table

_TABLE = word_table()
BINS, RANGE = 2000, (-1.0, 2.0)


def statistics(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    doc, classes = Document(d, o), class_counts(d, o)
    chars, n = np.maximum(classes.sum(1), 1), np.maximum(doc.n_words, 1)
    lines, copies = doc.lines()
    share = lambda name: classes[:, CLASSES.index(name)] / chars
    columns = [np.log1p(np.diff(o)), np.log1p(doc.n_words), *(share(c) for c in CLASSES), doc.word_chars() / n, doc.distinct() / n, doc.doubled() / n, doc.repeated(3) / n, doc.repeated(2) / n, copies / np.maximum(lines, 1), np.log1p(doc.n_words / np.maximum(lines, 1)), doc.common(_TABLE, len(COMMON)).sum(1) / n, np.log1p(doc.symbols())]
    return np.column_stack(columns)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.column_stack([np.cos(z) * np.sqrt(2 / self.w.shape[1]), np.ones(len(x))])


def model(mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int) -> Model:
    rng = np.random.Generator(np.random.PCG64(seed))
    w = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
    return Model(mean, scale, w, rng.uniform(0, 2 * np.pi, features))


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: for each bin the fitted share of ones; empty bins take from their neighbours."""
    at = np.flatnonzero(total)
    if not len(at):
        return np.full(len(total), 0.5)
    stack: list[list[float]] = []
    for i in at:
        stack.append([ones[i], total[i], 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a = stack.pop()
            stack[-1] = [x + y for x, y in zip(stack[-1], a, strict=True)]
    fitted = np.concatenate([np.full(int(k), s / n) for s, n, k in stack])
    return np.interp(np.arange(len(total)), at, fitted)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS, 0, BINS - 1).astype(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = binary(batch.column("text"))
        for lo, hi, d, o in blocks(data, at):
            x = statistics(d, o)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "x"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of equal fold and i."""
    sums: dict = {}
    for batch in batches:
        for key, row in zip(zip(batch.column("fold").to_pylist(), batch.column("i").to_pylist(), strict=True), _matrix(batch.column("row"), len(batch)) if len(batch) else [], strict=True):
            sums[key] = sums[key] + row if key in sums else row.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["fold", "i", "row"])


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, width: float = 1.0, ridge: float = 0.1, seed: int = 5, most: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. labels: doc_id and the named column of 0 and 1. most: labelled rows to fit on."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    found = materialize(texts.mapInArrow(lean(_emit), f"doc_id {kind}, x array<double>"), "statistics")
    wide = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    moments = found.agg(*(f(F.col("x")[i]) for i in range(wide) for f in (F.avg, F.stddev_pop))).first()
    mean, scale = (np.array([v or 0.0 for v in moments[i::2]]) for i in (0, 1))
    own = model(mean, np.where(scale > 1e-9, scale, 1.0), features, width, seed)
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    truth = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL AND labelled IS NOT NULL")
    train = found.join(truth.withColumn("fold", F.pmod(F.crc32(F.col("labelled").cast("string")), F.lit(3)).cast("int")).filter("fold <> 1"), F.col("doc_id") == F.col("labelled")).select("fold", "x", "y")
    train = materialize(train, "train")
    if (n := train.count()) > most:
        train = train.filter(F.pmod(F.xxhash64("x"), F.lit(-(-n // most))) == 0)
    train = train.coalesce(1 + min(n, most) // 20_000)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            z = own.lift(_matrix(batch.column("x"), len(batch)))
            zy = np.column_stack([z, np.asarray(batch.column("y"))])
            folds = np.asarray(batch.column("fold"))
            for f in (0, 2):
                sums[f] = sums.get(f, 0) + z[folds == f].T @ zy[folds == f]
        for f, g in sums.items():
            n = len(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (n + 1)), pa.array(g.ravel()))], ["fold", "i", "row"])

    schema = "fold int, i int, row array<double>"
    rows = train.mapInArrow(lean(equations), schema).repartition("i").mapInArrow(lean(_sum_rows), schema).collect()
    sums = np.zeros((3, features + 1, features + 2))
    for r in rows:
        sums[r["fold"], r["i"]] = r["row"]
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-6
    solve = lambda g: np.linalg.solve(g[:, :-1] + penalty, g[:, -1])
    both, cross = solve(sums[0] + sums[2]), {0: solve(sums[2]), 2: solve(sums[0])}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z, folds = own.lift(_matrix(batch.column("x"), len(batch))), np.asarray(batch.column("fold"))
                raw = np.where(folds == 0, z @ cross[0], z @ cross[2])
                yield pa.RecordBatch.from_arrays([pa.array(_bin(raw)), batch.column("y")], ["bin", "y"])

    total, ones = np.zeros(BINS), np.zeros(BINS)
    for r in train.mapInArrow(lean(binned), "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect():
        total[r["bin"]], ones[r["bin"]] = r["n"], r["s"]
    fitted = isotonic(total, ones)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = own.lift(_matrix(batch.column("x"), len(batch))) @ both if len(batch) else np.zeros(0)
            score = 0.999 * fitted[_bin(raw)] + 0.001 * np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]), 0, 1) if total.any() else np.full(len(raw), 0.5)
            yield batch.drop_columns(["x"]).append_column("score", pa.array(score))

    out = found.mapInArrow(lean(scored), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
