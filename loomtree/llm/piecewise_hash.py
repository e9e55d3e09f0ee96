"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes sets boundaries: one block size b makes a boundary where the hash is b - 1 modulo b, so that
boundaries move with the text around them and an edit changes the chunks it touches only. Each chunk's hash becomes one of 64
characters; the characters in order are a signature. A fingerprint is "b:signature at b:signature at 2b", b the smallest of 3, 6, 12,
... that makes 64 chunks or fewer on average. Signatures cover the whole text and are not cut; a periodic text that meets boundaries
so often that its signature passes 256 characters takes the next block size, again and again.

Likeness of two fingerprints: at a block size that both have (equal ones, or one twice the other), one less Levenshtein distance over
the longer signature's length; the larger of the two values if both sizes are shared. Signatures over eight characters that share no
four in a row count as unlike. Equal fingerprints have likeness 1, fingerprints without a common block size 0.

Defined results: a null text is an empty one, with fingerprint "3::"; two empty texts are alike (1). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, blocks, lean, materialize, mix, only, prefix_hashes, span_hashes

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST, CHUNKS, CONTEXT, MOST = 3, 64, 7, 256


def _rolling(data: np.ndarray) -> np.ndarray:
    """Of each place: a hash of the seven bytes that end there (fewer at the start)."""
    h, x = np.zeros(len(data), np.uint64), data.astype(np.uint64) + np.uint64(1)
    for i in range(min(CONTEXT, len(data))):
        h[i:] += x[: len(data) - i] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) % 2**64)
    return mix(h) >> np.uint64(20)


def fingerprints(texts: list[bytes], least: int = 0) -> list[str]:
    """Of many texts at once; texts are laid one after another with seven zero bytes between, so that contexts don't meet."""
    if not texts:
        return []
    gap = bytes(CONTEXT)
    data = np.frombuffer(gap + b"".join(x + gap for x in texts), np.uint8)
    n = np.array([len(x) for x in texts])
    begin = np.cumsum(n + CONTEXT) - n
    rows = np.repeat(np.arange(len(texts)), n)
    places = np.arange(len(rows)) - (np.cumsum(n) - n)[rows] + begin[rows]
    roll, prefix = _rolling(data)[places], prefix_hashes(data)
    power = np.full(len(texts), least, np.int64)
    while ((LEAST << power) * CHUNKS < n).any():
        power += (LEAST << power) * CHUNKS < n
    parts = []
    for more in (0, 1):
        size = (LEAST << (power + more)).astype(np.uint64)[rows]
        cut = np.flatnonzero(roll % size == size - np.uint64(1))
        # Chunks end at boundaries and at the text's end.
        last = (np.cumsum(n) - 1)[n > 0]
        ends = np.union1d(cut, last)
        row = rows[ends]
        first = np.ones(len(ends), bool)
        first[1:] = row[1:] != row[:-1]
        start = np.where(first, begin[row], np.concatenate([[0], places[ends[:-1]] + 1]))
        chars = ALPHABET[(span_hashes(prefix, start, places[ends] + 1) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        parts.append([chars[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    found = [f"{LEAST << p}:{a}:{b}" for p, a, b in zip(power.tolist(), *parts, strict=True)]
    for i, signature in enumerate(parts[0]):
        if len(signature) > MOST:
            found[i] = fingerprints([texts[i]], int(power[i]) + 1)[0]
    return found


def _share(a: Column, b: Column) -> Column:
    """Likeness of two signatures of one block size."""
    longer = F.greatest(F.length(a), F.length(b))
    near = 1 - F.levenshtein(a, b) / longer
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 3), lambda i: F.substring(s, i, 4))
    common = F.when(F.least(F.length(a), F.length(b)) < 4, False).otherwise(F.arrays_overlap(grams(a), grams(b)))
    return F.when(longer == 0, 1.0).when(a == b, 1.0).when((longer > 8) & ~common, 0.0).otherwise(near)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprint columns."""
    size, one, two = (lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("long")), (lambda x: F.split_part(x, F.lit(":"), F.lit(2))), (lambda x: F.split_part(x, F.lit(":"), F.lit(3)))
    return (
        F.when(a == b, 1.0)
        .when(size(a) == size(b), F.greatest(_share(one(a), one(b)), _share(two(a), two(b))))
        .when(size(a) == 2 * size(b), _share(one(a), two(b)))
        .when(2 * size(a) == size(b), _share(two(a), one(b)))
        .otherwise(0.0)
    )


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = binary(batch.column("text"))
        found: list[str] = []
        for _, _, d, o in blocks(data, at):
            raw = d.tobytes()
            found += fingerprints([raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)])
        yield batch.drop_columns(["text"]).append_column("fingerprint", pa.array(found, pa.string()))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""
    kind = dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(lean(_emit), f"doc_id {kind}, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: each text is edited with the next one. The first text and the last row are also given as they are."""
    import hashlib

    from pyspark import TaskContext

    names = ["part", "role", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text"]
    kinds = [pa.int32(), pa.string(), None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    part = TaskContext.get().partitionId()

    def give(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k or kind) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    held = kind = None
    for batch in batches:
        if not len(batch):
            continue
        kind = batch.schema.field("doc_id").type
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        data, at = binary(texts)
        for lo, hi, _, _ in blocks(data, at):
            own = texts.slice(lo, hi - lo).to_pylist()
            prints = fingerprints([x.encode() for x in own])
            if held is None:
                yield give([(part, "first", ids[lo], len(own[0]), None, prints[0], None, None, own[0])], kind)
            else:
                own, prints, keys = [held[1], *own], [held[2], *prints], [held[0], *ids[lo:hi]]
            if held is None:
                keys = ids[lo:hi]
            changed = [_edited(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]
            raw = [x.encode() for x in changed]
            rows = [(part, "done", k, len(t), hashlib.sha256(r).hexdigest(), f, e, g, None) for k, t, r, f, e, g in zip(keys, own, raw, prints, fingerprints(raw), prints[1:], strict=False)]
            if rows:
                yield give(rows, kind)
            held = (keys[-1], own[-1], prints[-1])
    if held is not None:
        yield give([(part, "last", held[0], len(held[1]), None, held[2], None, None, held[1])], kind)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the text and fingerprint of the first row of the next one."""
    import hashlib

    for batch in batches:
        raw = [_edited(a, b).encode() for a, b in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
        columns = [batch.column(x) for x in ("doc_id", "n_chars")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), batch.column("fingerprint"), pa.array(fingerprints(raw), pa.string()), batch.column("next_fingerprint")], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])


def with_edited_neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of every row of docs.

    A text's edited form has its last half (floor of half its code points) replaced by the start of the next text, by ascending doc_id
    (nulls first, equal ids by a hash of the text); the last one's next is the first. Texts are range-sorted once; a task edits the rows of its own
    range, and only each range's first and last rows meet in a second step, two rows a partition whatever the input.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ranged = texts.repartitionByRange(partitions, "doc_id", "h") if partitions else texts.repartitionByRange("doc_id", "h")
    schema = f"part int, role string, doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
    found = materialize(ranged.sortWithinPartitions("doc_id", "h").select("doc_id", "text").mapInArrow(lean(_beside), schema), "beside")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    heads = found.filter("role = 'first'").select(F.col("part").alias("p"), F.col("text").alias("t"), F.col("fingerprint").alias("f"))
    order = Window.orderBy("p")
    after = heads.select((F.lead("p").over(order)).alias("to"), "p")
    least = heads.agg(F.min("p").alias("p0"))
    tails = found.filter("role = 'last'").drop("next_fingerprint").join(after, F.col("part") == F.col("p")).drop("p").crossJoin(F.broadcast(least))
    tails = tails.withColumn("to", F.coalesce("to", "p0")).join(heads, F.col("to") == F.col("p"))
    tails = tails.select("doc_id", "n_chars", "fingerprint", "text", F.col("t").alias("following"), F.col("f").alias("next_fingerprint"))
    ends = tails.mapInArrow(lean(_ends), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return found.filter("role = 'done'").select(*columns).unionByName(ends)
