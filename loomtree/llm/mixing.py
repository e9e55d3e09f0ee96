"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, up to `epochs` times over. A copy's virtual finish time is the source's
cumulative words through it over the source's target; here the copy counts with its middle, so that a source ends within half a
document of its share. All copies are then sorted by that time over all sources and taken until the total budget is reached.

DataFrame functions only. Cumulative sums run in two levels, so that no source, however large, is one task's: totals of 1/parts-th
slices of a source's shuffle, and running sums inside a slice. The sorted order is cut likewise: copies are dealt
to ranges of virtual time, 1/4096-th of a unit and 1/4096-th of that. Ranges before the cut are taken whole and those after it not at
all, so only the range with the cut is sorted copy by copy: the truncation of the global range sort, without moving the copies.

Targets: water-filling. With weights w, caps c = epochs x size and total T, targets are min(c, level x w) with the level that makes
them sum to T, which is what resharing the excess by weight until no source is above its cap comes to.

Defined results: a null text has size 0 and is never taken; a null source is a source, the last one; rows with null or repeated ids
keep their rows; an empty table gives no rows; other columns are ignored. The shuffle depends on (seed, doc_id, text) only, whatever
the input's order, so reruns agree; rows equal in id and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small

SLICES = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of words: places where a word starts. Counts in one pass without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> and target. A row per source; sources are few, one task orders them."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(whole))
    # The level if this source and all that fill later are not capped.
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("ends", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("level", F.first(F.when(F.col("ends"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _shuffle(seed: int, text: Column) -> Column:
    """A number of 60 bits by which a source's documents are shuffled."""
    keys = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))
    return F.conv(F.substring(F.md5(keys), 1, 15), 16, 10).cast("long")


def _last(copies: DataFrame, bin_: Column, before: int, budget: int):
    """Of the bins in order, the last that begins under the budget: its number and the words before it (counted on from `before`)."""
    bins = copies.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("n"))
    bins = bins.withColumn("before", F.lit(before) + F.sum("n").over(Window.orderBy("bin")) - F.col("n"))
    return bins.filter(F.col("before") < budget).agg(F.max(F.struct("bin", "before"))).first()[0]


def mix_sources(docs: DataFrame, epochs: int = 3, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, parts: int = 256) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies and taken (size x copies) of every row of docs."""
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words(docs["text"]).alias("size"), _shuffle(seed, docs["text"]).alias("h"))
    sized = sized.withColumn("slice", F.floor(F.shiftright("h", 28) * parts / 2**32).cast("int"))
    sized = materialize(sized, "sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, weights)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")
    starts = sized.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("before", before)
    starts = starts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("source").alias("s"), F.col("slice").alias("p"), "before", "source_size", "target")
    own = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    queued = sized.withColumn("own", own).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p")))
    queued = queued.withColumn("end", F.col("before") + F.col("own")).select("doc_id", "source", "text_hash", "size", "source_size", "target", "end")
    queued = materialize(queued, "queued")

    def time(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("end") - F.col("size") / 2) / F.col("target")

    budget = queued.agg(F.sum("size")).first()[0] or 0
    fine = lambda t: F.floor(F.least(t, F.lit(4.0)) * SLICES * SLICES)
    copies = queued.filter("size > 0").select("size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "source_size", "end", "target")
    copies = copies.select("size", time(F.col("epoch")).alias("time")).withColumn("bin", fine(F.col("time")))
    if budget:
        coarse, words = _last(copies, F.floor(F.col("bin") / SLICES), 0, budget)
        last, words = _last(copies.filter(F.floor(F.col("bin") / SLICES) == coarse), F.col("bin"), words, budget)
        through = F.lit(words) + F.sum("size").over(Window.orderBy("time", "size").rowsBetween(Window.unboundedPreceding, 0))
        edge = copies.filter(F.col("bin") == last).withColumn("through", through).filter(F.col("through") - F.col("size") / 2 <= budget)
        end = edge.agg(F.max("time")).first()[0]
        inside = lambda t: (fine(t) < last) | (t <= (-1.0 if end is None else end))
        taken = sum((F.when(inside(time(F.lit(e))), 1).otherwise(0) for e in range(epochs)), F.lit(0))
        taken = F.when(F.col("size") > 0, taken).otherwise(0)
    else:
        taken = F.lit(0)
    queued = queued.withColumn("copies", taken.cast("int"))
    return queued.select("doc_id", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **more) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies. Rows equal in id and text all get the most that one of them has."""
    copies = mix_sources(docs, **more).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("mixed_copies")).filter("mixed_copies > 0")
    copies = copies.select(F.col("doc_id").alias("mixed_id"), F.col("text_hash").alias("mixed_hash"), "mixed_copies")
    copies = small(materialize(copies, "copies"))
    both = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("mixed_id")) & (F.xxhash64(docs["text"]) == F.col("mixed_hash")))
    return both.withColumn("mixed_copies", F.explode(F.sequence(F.lit(1), F.col("mixed_copies")))).select(*(docs[c] for c in docs.columns))
