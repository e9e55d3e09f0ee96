"""Best-fit packing of token sequences by minimum bin slack.

Documents are cut to pieces of at most `size` tokens. Only how many pieces have each length matters for packing, so the lengths'
counts (at most `size` numbers, whatever the input) go to the driver. There, bin by bin, the longest piece left opens a bin and a
subset-sum over the lengths left, on bitsets, finds the combination that fills the bin best; longer lengths are preferred. The same
combination is taken as often as the counts allow, as it stays the fullest until one of its lengths runs out. The plan is a list of
(length, ranks, bins), and every piece finds its place by its rank among the pieces of its length. Ranks are counted in parts of a
length, so a length that a third of all pieces share is no single task's.

Defined results: a null text is an empty one and gives one piece, the end token; rows with null or repeated ids keep their rows
(pieces of rows with equal ids are told apart by sequence and offset only); other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, blocks, lean, materialize, only

PART = 500


def _fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of the lengths on hand with the largest sum up to room."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts):
        if length > room:
            break
        many, part = min(counts[length], room // length), 1
        while many:
            part = min(part, many)
            before, reach = reach, (reach | reach << (part * length)) & full
            if reach != before:
                steps.append((length, part, before))
            many -= part
            part *= 2
        if reach == full and length > room // 2:
            continue
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if at >= part * length and before >> (at - part * length) & 1:
            at -= part * length
            used[length] = used.get(length, 0) + part
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination as (length, times), number of bins): together they hold every piece once. Lengths are 1 to size."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        rest = {k: v for k, v in left.items() if v}
        found = dict(_fullest(rest, size - top))
        left[top] += 1
        found[top] = found.get(top, 0) + 1
        bins = min(left[k] // n for k, n in found.items())
        for k, n in found.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
        out.append((sorted(found.items(), reverse=True), bins))
    return out


def _places(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows of length, first rank, pieces a bin, first bin, first offset; by length and rank."""
    rows, ranks, bin_ = [], dict.fromkeys(counts, 0), 0
    for combination, bins in plan(counts, size):
        offset = 0
        for length, n in combination:
            rows.append((length, ranks[length], n, bin_, offset))
            ranks[length] += n * bins
            offset += n * length
        bin_ += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _encoder(path: str):
    """Texts to lists of ids, as the file's own library gives them. If a rank file of the same name holds the same merges, texts whose
    characters all lie under U+0300 go to the rank library, which gives the same ids there in a fourth of the time (tests compare
    them); beyond that the libraries' Unicode tables may differ. Special tokens' strings inside texts become their ids in either."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    usual = lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)]
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path) as f:
        spec = json.load(f)
    byte_level = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not byte_level or not os.path.exists(ranks):
        return usual
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=merges, special_tokens=special)

    def encode(texts: list[str]) -> list[list[int]]:
        far = [i for i, x in enumerate(texts) if not x.isascii() and max(x) >= "\u0300"]
        found = dict(zip(far, usual([texts[i] for i in far]), strict=True))
        return [found[i] if i in found else fast.encode(x, allowed_special="all") for i, x in enumerate(texts)]

    return encode


def _pieces(path: str, size: int, end: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            data, at = binary(batch.column("text"))
            for lo, _, d, o in blocks(data, at):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                raw = d.tobytes()
                for i, ids in enumerate(encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(o[:-1], o[1:], strict=True)])):
                    ids.append(end)
                    packed = np.array(ids, "<u4").tobytes()
                    cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append(lo + i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        part = packed[4 * a : 4 * b]
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * with_ids], names)

    return run


def _placed(places: np.ndarray):
    keys = places[:, 0] << 40 | places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            row = places[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            k = rank - row[:, 1]
            n = np.maximum(row[:, 2], 1)
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(row[:, 3] + k // n)).append_column("offset", pa.array(row[:, 4] + k % n * length))

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, with_ids: bool = False, part: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids: little-endian 32-bit,] sequence_id, offset; a row for each piece.

    A document of more than `size` tokens, its end token included, is cut to pieces of `size`, the first of which may be shorter.
    part: pieces of one length that one task ranks at least before the length is divided; the root of the number of pieces if that is more.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = materialize(texts.mapInArrow(lean(_pieces(path, size, end, with_ids)), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(_places(counts, size))
    # About the root of a length's pieces in each part, so neither parts nor what is in one grow as fast as the table.
    parts = 1 + max(counts.values(), default=0) // max(part, math.isqrt(sum(counts.values())))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("own")).select(*pieces.columns, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(places.value)(batches)

    return ranked.mapInArrow(lean(run), schema + ", sequence_id long, offset long")
