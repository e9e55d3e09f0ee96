"""Sharding by sampled splitters.

Records are laid out by key and cut into shards of near equal bytes. The key is the text's hash, so that equal texts lie together and
go to one shard; only a text whose copies exceed a shard is an overfull range, and subdivided by the records' own hashes. Every key is an
atom. A sample of atoms drawn by size (an atom's chance grows with its bytes) gives quantiles as splitters, which deal the atoms to
ranges of about equal bytes; a range with over `most` atoms is subdivided evenly, as keys are hashes. Ranges are summed, and running sums
inside ranges give each atom its place in bytes and rows among all; the shard is the one that has that place. So what the sample is
decides only how even the work is, not the result.

Atoms of over an eighth of a shard, of which there are eight times as many as shards at most, would make shards uneven where they fall
on a border. They are placed first, the largest first, each into the shard with least so far; the others fill what is left of each shard.

DataFrame functions only. Law: bytes (sizes near equal).

Defined results: a null text has the size of an empty one; rows with null or repeated ids keep their rows, and copies of a text without
ids to tell them apart are divided by their number; an empty table gives no rows; other columns are ignored. Slots number a shard's
records by key, doc_id and copies of one another in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

OVERHEAD = 16


def _hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def _level(loads: list[int], rest: int) -> list[float]:
    """What each shard still takes of the rest, so that shards come as near to equal as the loads let them."""
    level = 0.0
    for k, load in enumerate(sorted(loads)):
        if k and load * k - sum(sorted(loads)[:k]) >= rest:
            break
        level = (rest + sum(sorted(loads)[: k + 1])) / (k + 1)
    return [max(0.0, level - x) for x in loads]


def _place(units: list[tuple[int, int, int, int]], shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """units: (bytes, high, number, rows). The shard of each (high, number), the largest first into the emptiest; and the shards' bytes."""
    loads, to = [0] * shards, {}
    for size, high, number, _ in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
        to[high, number] = s = loads.index(min(loads))
        loads[s] += size
    return to, loads


def shard(docs: DataFrame, shards: int = 40, ranges: int = 1024, large: float = 0.125, most: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row of docs. large: atoms of that much of a shard are placed one by one."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _hash32(text).alias("high"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(total / shards, 1.0)
    texts = rows.groupBy("high").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    big = [tuple(r) for r in texts.filter(F.col("bytes") > large * share).select("high", "bytes", "n").collect()]
    spark = docs.sparkSession
    listed = F.broadcast(spark.createDataFrame([(h, b > share) for h, b, _ in big], "high long, heavy boolean"))
    marked = rows.join(listed, "high", "left")
    # Rows of a heavy text, numbered among those with one id in two levels, so that copies without ids have numbers too.
    deal = F.pmod(F.xxhash64("row"), F.lit(256))
    heavy = marked.filter("heavy").withColumn("deal", deal)
    before = heavy.groupBy("high", "doc_id", "deal").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("high", "doc_id").orderBy("deal")) - F.col("n")).withColumnRenamed("doc_id", "d").drop("n")
    own = F.row_number().over(Window.partitionBy("high", "doc_id", "deal").orderBy("row")) - 1
    numbered = heavy.withColumn("own", own).join(before, ["high", "deal"]).filter(F.col("doc_id").eqNullSafe(F.col("d"))).withColumn("copy", F.col("before") + F.col("own"))
    low = _hash32(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")))
    # Records that are large by themselves are units, and of those there are as few as of large texts.
    single = Window.partitionBy("high", "single").orderBy("doc_id", "copy")
    numbered = numbered.withColumn("single", F.col("size") > large * share).select("doc_id", "size", "text_crc32", "high", "copy", "single", low.alias("low"))
    alone = numbered.filter("single").withColumn("unit", F.row_number().over(single).cast("long")).withColumn("low", F.lit(0).cast("long"))
    loose = numbered.filter("NOT single").withColumn("unit", F.lit(-1).cast("long"))
    columns = ["doc_id", "size", "text_crc32", "high", "low", "unit"]
    rest = marked.filter("heavy IS NULL OR NOT heavy").withColumn("low", F.lit(0).cast("long")).withColumn("unit", F.when(F.col("heavy").isNull(), -1).otherwise(0).cast("long"))
    keyed = rest.select(columns).unionByName(alone.select(columns)).unionByName(loose.select(columns))
    keyed = keyed.withColumn("key", F.col("high") * 2**31 + F.floor(F.col("low") / 2)).drop("low")
    keyed = materialize(keyed, "keyed")
    units = [tuple(r) for r in keyed.filter("unit >= 0").groupBy("high", "unit").agg(F.sum("size").alias("b"), F.count("*").alias("n")).select("b", "high", "unit", "n").collect()]
    to, loads = _place(units, shards)
    room = _level(loads, total - sum(loads))
    bounds = [sum(room[: s + 1]) for s in range(shards - 1)]
    atoms = keyed.filter("unit < 0").groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # Each atom is drawn with a chance of its bytes over the step; so about 8 x ranges are, whatever the input.
    step = max(total / (8 * ranges), 1.0)
    drawn = atoms.filter(F.pmod(F.xxhash64("key"), F.lit(2**31)) / 2**31 < F.col("bytes") / step).select("key")
    splitters = [int(x) for x in (drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100_000)).first()[0] or [])]
    splitters = sorted(set(splitters))
    # Two steps of about the square root of the splitters each: first among every `wide`th one, then among those after it.
    wide = max(1, int(len(splitters) ** 0.5))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    fine = F.array(longs([]), *[longs(splitters[i + 1 : i + wide]) for i in range(0, len(splitters), wide)])
    block = F.size(F.filter(longs(splitters[::wide]), lambda x: x <= F.col("key")))
    ranged = atoms.withColumn("block", block)
    inner = F.size(F.filter(F.element_at(fine, F.col("block") + 1), lambda x: x <= F.col("key")))
    ranged = ranged.withColumn("range", F.col("block") * wide + inner).drop("block")
    ranged = materialize(ranged, "atoms")
    spans = ranged.groupBy("range").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.count("*").alias("atoms"))
    spans = F.broadcast(spans.select("range", "k0", "k1", F.floor(F.col("atoms") / most + 1).alias("parts")))
    part = F.least(F.floor((F.col("key") - F.col("k0")) / (F.col("k1") - F.col("k0") + 1) * F.col("parts")), F.col("parts") - 1)
    ranged = ranged.join(spans, "range").withColumn("part", part).drop("k0", "k1", "parts")
    order = Window.orderBy("range", "part")
    sums = ranged.groupBy("range", "part").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    sums = sums.select("range", "part", (F.sum("b").over(order) - F.col("b")).alias("b0"), (F.sum("r").over(order) - F.col("r")).alias("r0"))
    inside = Window.partitionBy("range", "part").orderBy("key")
    placed = ranged.withColumn("b", F.sum("bytes").over(inside) - F.col("bytes")).withColumn("r", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(sums), ["range", "part"])
    middle = F.col("b0") + F.col("b") + F.col("bytes") / 2
    at = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x <= middle))
    placed = placed.select("key", "n", (F.col("r0") + F.col("r")).alias("rank"), at.alias("shard"))
    placed = materialize(placed, "placed")
    first = {r["shard"]: (r["first"], r["n"]) for r in placed.groupBy("shard").agg(F.min("rank").alias("first"), F.sum("n").alias("n")).collect()}
    firsts = F.broadcast(spark.createDataFrame([(s, f) for s, (f, _) in first.items()], "shard int, first long"))
    starts = placed.join(firsts, "shard").select("key", "shard", (F.col("rank") - F.col("first")).alias("start"))
    # Units follow what fills their shard.
    filled, after = {s: n for s, (_, n) in first.items()}, []
    for _, high, number, n in sorted(units, key=lambda u: (u[1], u[2])):
        s = to[high, number]
        after.append((high, number, s, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + n
    after = F.broadcast(spark.createDataFrame(after, "high long, unit long, shard int, start long"))
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "size", "text_crc32")) - 1
    loose = keyed.filter("unit < 0").withColumn("own", number("key")).join(starts, "key")
    whole = keyed.filter("unit >= 0").withColumn("own", number("high", "unit")).join(after, ["high", "unit"])
    both = loose.drop("key").unionByName(whole.drop("key"))
    return both.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
