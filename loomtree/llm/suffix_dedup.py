"""Repeated strings by a depth-limited radix sort of suffixes.

A suffix is what begins at one token of a text and goes on to its end; tokens are bytes, or words (then white space between words
doesn't matter). Two suffixes share a string of `depth` tokens exactly if a most-significant-digit radix sort, stopped after `depth`
tokens, leaves them in one group. The passes:

1. The digit of the first pass is chosen by content: of the grams (`gram` tokens) inside a suffix's first `depth` tokens the one with
   the smallest hash, leftmost in ties. Equal strings choose equal grams at equal places, so suffixes that choose different grams part
   here. Neighbouring suffixes mostly choose the same gram and travel as one run: about depth/2 suffixes a row, and more in periodic
   texts, whose grams are equal from period to period. A gram chosen at one place only ends here.
2. Runs of one gram that are equal in their whole length (copies, and the inside of shared passages) are repeated in all their windows.
   One of them stays to be compared with the other runs of the gram; a gram with one kind of run ends here.
3. Runs that are left get the bytes of their suffixes from the text, are dealt by gram, and each group is sorted further on digits of
   depth/2 tokens, suffix by suffix. A suffix alone in its group drops out after each pass.
4. What still has company after the last digit is compared byte by byte, and is a repeated window if equal. Windows are merged to spans
   per document.

Digits are sorted by their 64-bit hashes, as only equality matters; step 4 makes sure of it. Grams with over `hot` kinds of runs don't go
to one task: their runs are sliced to an eighth, by distance from the gram, and keyed by the tokens that all suffixes of a slice contain;
then step 2 follows again, and so on down to single suffixes. Runs that are equal in their whole length count as equal by 128 bits (key
and whole by hash) without a look at the bytes.

Defined results: a null text is an empty one; documents are told apart by (doc_id, text), so null or repeated ids and repeated rows
work (equal rows are copies of each other); texts under `depth` tokens are kept whole; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, binary, blocks, discard, lean, materialize, mix, only, prefix_hashes, small, span_hashes, words

#: Tokens of a gram, at most.
GRAM = {"bytes": 48, "words": 8}
_PLACE = 22
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with one space between words: bytes, and words' starts and ends, rows' first words; and each word's start and end in data."""
    starts, ends, first = words(data, at)
    size = ends - starts + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    solid = np.repeat(starts - to, size) + np.arange(len(out))
    inside = solid < np.repeat(ends, size)
    out[inside] = data[solid[inside]]
    return out, to, to + size - 1, first, np.column_stack([starts, ends])


def _tokens(data: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, tokens' starts and ends, rows' first tokens."""
    if unit == "words":
        return _spaced(data, at)[:4]
    places = np.arange(len(data))
    return data, places, places + 1, at


def _pieces(data: np.ndarray, at: np.ndarray, depth: int, unit: str):
    """Blocks of rows; a row over a block comes in pieces that overlap by depth - 1 tokens. Gives first row, offset in it (in tokens), and
    bytes, tokens' starts and ends, rows' first tokens."""
    for lo, hi, d, o in blocks(data, at):
        if hi - lo > 1 or len(d) <= 2 * BLOCK:
            yield lo, 0, *_tokens(d, o, unit)
        elif unit == "bytes":
            for p in range(0, max(1, len(d) - depth + 1), BLOCK):
                piece = d[p : p + BLOCK + depth - 1]
                yield lo, p, *_tokens(piece, np.array([0, len(piece)]), unit)
        else:
            d, starts, ends, _ = _tokens(d, o, unit)
            for p in range(0, max(1, len(starts) - depth + 1), BLOCK // 8):
                q = min(len(starts), p + BLOCK // 8 + depth - 1)
                if p < q:
                    yield lo, p, d[starts[p] : ends[q - 1]], starts[p:q] - starts[p], ends[p:q] - starts[p], np.array([0, q - p])


def _suffixes(first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of every suffix of at least depth tokens."""
    inside = np.maximum(np.diff(first) - depth + 1, 0)
    rows = np.repeat(np.arange(len(inside)), inside)
    return rows, np.arange(len(rows)) - (np.cumsum(inside) - inside)[rows] + first[:-1][rows]


def _chosen(h: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The place that each suffix chooses, and hashes of the grams at all places."""
    width = depth - gram + 1
    grams = span_hashes(h, begin[: len(begin) - gram + 1], end[gram - 1 :])
    low = np.uint64((1 << _PLACE) - 1)
    keys = np.full(-(-len(grams) // width) * width, np.uint64(2**64 - 1))
    keys[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    square = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[starts], ahead[starts + width - 1]) & low).astype(np.int64), grams


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, depth: int, gram: int):
    """Of rows of tokens: row, first suffix, number of suffixes, gram hash, number of places chosen and hash of the whole run, of each
    run of suffixes whose chosen grams are equal. Mostly that is one place; in a periodic text a run goes on from period to period."""
    rows, starts = _suffixes(first, depth)
    if not len(rows):
        return None
    h = prefix_hashes(data)
    chosen, grams = _chosen(h, begin, end, starts, depth, gram)
    picked = grams[chosen]
    i = np.flatnonzero(_changes(picked, rows))
    last = starts[np.append(i[1:], len(rows)) - 1]
    whole = span_hashes(h, begin[starts[i]], end[last + depth - 1])
    return rows[i], starts[i] - first[:-1][rows[i]], np.diff(np.append(i, len(rows))), picked[i].view(np.int64), np.add.reduceat(_changes(chosen, rows).astype(np.int64), i), whole.view(np.int64)


def _emit_runs(depth: int, gram: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary(batch.column("text"))
            for lo, skipped, *rest in _pieces(data, at, depth, unit):
                if (found := _runs(*rest, depth, gram)) is None:
                    continue
                rows, starts, counts, keys, times, whole = found
                take = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(starts + skipped), pa.array(counts), pa.array(times), pa.array(whole)], ["key", "doc_id", "text_hash", "start", "n", "times", "whole"])

    return run


def _emit_chunks(depth: int, unit: str):
    """The bytes of each run's suffixes, through the last one's depth; words with one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary(batch.column("text"))
            lists = batch.column("runs")
            flat = lists.flatten()
            offsets = np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)
            for lo, hi, d, o in blocks(data, at):
                own = flat.slice(offsets[lo], offsets[hi] - offsets[lo])
                if not len(own):
                    continue
                d, starts, ends, first = _tokens(d, o, unit)
                rows = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                key, start, n, kinds = (np.asarray(own.field(x)) for x in ("key", "start", "n", "kinds"))
                begin = starts[first[:-1][rows] + start]
                end = ends[first[:-1][rows] + start + n + depth - 2]
                sizes = np.cumsum(end - begin)
                for part in np.split(np.arange(len(rows)), np.searchsorted(sizes, np.arange(4 * BLOCK, sizes[-1], 4 * BLOCK))):
                    if len(part):
                        chunks = pa.array([d[a:b].tobytes() for a, b in zip(begin[part], end[part], strict=True)], pa.binary())
                        take = pa.array(rows[part] + lo)
                        yield pa.RecordBatch.from_arrays([pa.array(key[part]), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(start[part]), pa.array(kinds[part]), chunks], ["key", "doc_id", "text_hash", "start", "kinds", "chunk"])

    return run


def _digits(data: np.ndarray, at: np.ndarray, depth: int, unit: str) -> tuple[np.ndarray, ...]:
    """Of every suffix in the chunks: its chunk, its place in it in tokens, its first and last + 1 byte, and its two digits."""
    d, begin, end, first = _tokens(data, at, unit)
    rows, starts = _suffixes(first, depth)
    h = prefix_hashes(d)
    half = depth // 2
    a, b, c, e = begin[starts], end[starts + half - 1], begin[starts + half], end[starts + depth - 1]
    # Chunks have single spaces, so places in them are those in the chunk's own bytes but for what _tokens adds between chunks.
    shift = at[:-1][rows] - begin[first[:-1]][rows]
    return rows, starts - first[:-1][rows], a + shift, e + shift, span_hashes(h, a, b), span_hashes(h, c, e)


def _blockwise(data: np.ndarray, at: np.ndarray, depth: int, unit: str) -> list[np.ndarray]:
    parts = [(r + lo, p, a + at[lo], e + at[lo], x, y) for lo, _, d, o in blocks(data, at) for r, p, a, e, x, y in [_digits(d, o, depth, unit)]]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size]. Neighbours at one distance are compared as one string."""
    order = np.lexsort((a, b - a))
    x, y, n = a[order], b[order], size[order]
    new = np.ones(len(x), bool)
    # Ends never fall inside a distance's run of neighbours, so a string goes from the first start to the last end.
    new[1:] = (y - x)[1:] != (y - x)[:-1]
    new[1:] |= x[1:] > (x + n)[:-1]
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(x)) - 1
    length = x[last] + n[last] - x[i]
    out = np.ones(len(x), bool)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(np.cumsum(length[at:]), 4 * BLOCK)) + at)
        total = np.cumsum(length[at:to])
        step = np.arange(total[-1]) - np.repeat(total - length[at:to], length[at:to])
        same = data[np.repeat(x[i[at:to]], length[at:to]) + step] == data[np.repeat(y[i[at:to]], length[at:to]) + step]
        if not same.all():
            for k in np.unique(np.searchsorted(total, np.flatnonzero(~same), side="right")) + at:
                for j in range(i[k], last[k] + 1):
                    out[order[j]] = bool((data[x[j] : x[j] + n[j]] == data[y[j] : y[j] + n[j]]).all())
        at = to
    return out


def _company(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal ones together, and whether each but the first in it equals the one before."""
    order = np.argsort(c, kind="stable")
    s = c[order]
    return order, s[1:] == s[:-1]


def _either(same: np.ndarray) -> np.ndarray:
    """Which ones equal one beside them."""
    return np.append(same, False) | np.append(False, same)


def _repeated(keys: np.ndarray, data: np.ndarray, at: np.ndarray, depth: int, unit: str):
    """Of whole groups of chunks: chunk, first and last + 1 suffix (counted in the chunk) of each run of suffixes with company."""
    rows, place, begin, end, *digits = _blockwise(data, at, depth, unit)
    group, left = mix(keys.view(np.uint64))[rows], np.arange(len(rows))
    for digit in digits:
        c = mix(group * _SALT + digit[left])
        order, same = _company(c)
        keep = np.sort(order[_either(same)[: len(order)]])
        left, group = left[keep], c[keep]
    if len(left):
        order, same = _company(group)
        a, b = left[order[:-1]][same], left[order[1:]][same]
        size = end - begin
        equal = _alike(data, begin[a], begin[b], np.minimum(size[a], size[b])) & (size[a] == size[b])
        if not equal.all():
            # Hashes met by chance: those groups by their bytes.
            odd = set(group[order[:-1]][same][~equal].tolist())
            seen: dict[tuple, list[int]] = {}
            for i in np.flatnonzero(np.isin(group, np.array(list(odd), np.uint64))).tolist():
                w = left[i]
                seen.setdefault((int(keys[rows[w]]), data[begin[w] : end[w]].tobytes()), []).append(i)
            left = np.delete(left, [x[0] for x in seen.values() if len(x) == 1])
    if not len(left):
        return None
    r, s = rows[left], place[left]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1] + 1) | (r[1:] != r[:-1])
    i = np.flatnonzero(new)
    return r[i], s[i], s[np.append(i[1:], len(left)) - 1] + 1


def _emit_spans(depth: int, unit: str):
    """Batches come sorted by key; a group may reach over batches."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = binary(batch.column("chunk"))
        keys = np.asarray(batch.column("key"))
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        lo = 0
        while lo < len(keys):
            fit = ends[(ends > lo) & (at[ends] <= at[lo] + BLOCK)]
            hi = int(fit[-1] if len(fit) else ends[ends > lo][0])
            found = _repeated(keys[lo:hi], data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], depth, unit)
            if found is not None:
                rows, a, b = found
                take = pa.array(rows + lo)
                start = np.asarray(batch.column("start").take(take))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(start + a), pa.array(start + b - 1 + depth)], ["doc_id", "text_hash", "lo", "hi"])
            lo = hi

    def join(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.asarray(batch.column("key"))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and np.asarray(held[-1].column("key"))[-1] != keys[0]):
                yield from work(join([*held, batch.slice(0, cut)] if cut else held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(join(held))

    return run


def _emit_slices(depth: int, gram: int, unit: str, width: int):
    """For hot grams: runs of at most `width` suffixes at equal distances from their gram, keyed by the tokens that all of these contain.

    Where a run is met again in its own chunk, as in periodic texts, one stands for all; rows without a key then have their suffixes, those
    of neighbours together, which are repeated.
    """
    most = depth - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary(batch.column("chunk"))
            keys = np.asarray(batch.column("key")).view(np.uint64)
            for lo, _, x, o in blocks(data, at):
                d, begin, end, first = _tokens(x, o, unit)
                rows, starts = _suffixes(first, depth)
                h = prefix_hashes(d)
                chosen, _ = _chosen(h, begin, end, starts, depth, gram)
                part = (starts - chosen + most) // width
                i = np.flatnonzero(_changes(rows, chosen, part))
                n = np.diff(np.append(i, len(rows)))
                a, z = chosen[i] - most + np.minimum((part[i] + 1) * width - 1, most), chosen[i] - most + part[i] * width + depth
                core = mix(span_hashes(h, begin[a], end[z - 1]) ^ mix(keys[rows[i] + lo] + part[i].astype(np.uint64)))
                a, z = begin[starts[i]], end[starts[i] + n + depth - 2]
                whole = span_hashes(h, a, z)
                own = rows[i]
                _, one, which, times = np.unique(mix(mix(core ^ mix(whole)) + n.astype(np.uint64)) ^ mix(own.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
                again = times[which] > 1
                # Of each stretch of runs that are met again: its first run, and its last.
                head = np.flatnonzero(again & np.append(True, ~again[:-1] | (own[1:] != own[:-1])))
                tail = np.flatnonzero(again & np.append(~again[1:] | (own[1:] != own[:-1]), True))
                one = np.sort(one)
                take = pa.array(np.concatenate([own[one], own[head]]) + lo)
                start = np.asarray(batch.column("start").take(take)) + (starts[i] - first[:-1][own])[np.concatenate([one, head])]
                size = np.concatenate([n[one], starts[i][tail] + n[tail] - starts[i][head]])
                void = np.arange(len(one) + len(head)) >= len(one)
                pad = np.zeros(len(head), np.int64)
                chunks = pa.array([d[p:q].tobytes() for p, q in zip(a[one], z[one], strict=True)] + [None] * len(head), pa.binary())
                columns = [pa.array(np.append(core[one].view(np.int64), pad), mask=void), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(start), pa.array(size), pa.array(np.append(whole[one].view(np.int64), pad))]
                yield pa.RecordBatch.from_arrays([*columns, chunks], ["key", "doc_id", "text_hash", "start", "n", "whole", "chunk"])

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    i = np.flatnonzero(new)
    return lo[i], hi[np.append(i[1:], len(lo)) - 1]


def _emit_kept(carry: tuple[str, ...], as_text: bool, unit: str):
    """Cuts the merged spans out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary(batch.column("text"))
            kept, removed, merged = [], [], []
            for i, spans in enumerate(batch.column("spans")):
                text, cuts = data[at[i] : at[i + 1]], []
                if spans.is_valid and len(spans.values):
                    a, b = _merged(np.asarray(spans.values.field("lo")), np.asarray(spans.values.field("hi")))
                    if unit == "words":
                        starts, ends, _ = words(text, np.array([0, len(text)]))
                        a, b = starts[a], ends[b - 1]
                    cuts = [{"lo": int(x), "hi": int(y)} for x, y in zip(a, b, strict=True)]
                    inner = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(text)]])
                    kept.append(b"".join(text[x:y].tobytes() for x, y in inner.reshape(-1, 2)))
                else:
                    kept.append(text.tobytes())
                removed.append(sum(c["hi"] - c["lo"] for c in cuts))
                merged.append(cuts)
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array([k.decode("utf-8", "ignore") for k in kept] if as_text else kept, pa.string() if as_text else pa.binary()), *map(batch.column, carry)], ["doc_id", "text_hash", "n_bytes", "n_removed", "spans", "kept", *carry])

    return run


def _own(lists: DataFrame) -> DataFrame:
    """lists with its keys renamed, to be joined with texts."""
    return lists.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})


def _equal() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))


def _with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts that have a row of lists, with it. Texts that have none don't move if the list of those that do is small."""
    keys = small(_own(lists.select("doc_id", "text_hash")))
    return texts.join(keys, _equal(), "left_semi").join(_own(lists).hint("merge"), _equal()).drop("d", "h")


def _texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return only(docs, "doc_id", "text", *carry).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"), *carry)


def _collapsed(runs: DataFrame, depth: int, more: str) -> tuple[DataFrame, DataFrame]:
    """(spans, asked): runs that equal another as a whole are repeated in all their windows; asked has place and kinds of one run of each
    kind, of the keys that are to be looked at further."""
    kinds = materialize(runs.groupBy("key", "whole", "n").agg(F.count("*").alias("copies"), F.min("place").alias("place")), "kinds")
    copied = small(kinds.filter("copies > 1").select("key", "whole", "n"))
    spans = runs.join(copied, ["key", "whole", "n"]).select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + depth).alias("hi"))
    asked = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("copies").alias("copies")).filter(more).select("key", "kinds")
    return spans, materialize(kinds.join(small(materialize(asked, "asked")), "key").select("place", "kinds"), "places")


def repeated_spans(docs: DataFrame, depth: int = 400, unit: str = "bytes", gram: int | None = None, hot: int = 256) -> DataFrame:
    """doc_id, text_hash, lo, hi (in tokens) of repeated strings of `depth` tokens and more; spans of a document may overlap."""
    gram = max(1, min(gram or GRAM[unit], depth // 2))
    kind = dict(docs.dtypes)["doc_id"]
    texts = _texts(docs)
    runs = texts.filter(F.octet_length("text") >= depth).mapInArrow(lean(_emit_runs(depth, gram, unit)), f"key long, doc_id {kind}, text_hash long, start long, n long, times long, whole long")
    runs = materialize(runs, "runs")
    often = materialize(runs.groupBy("key").agg(F.sum("times").alias("m")).filter("m > 1").select("key"), "often")
    shared = materialize(runs.join(small(often), "key").withColumn("place", F.monotonically_increasing_id()), "shared")
    discard(runs, often)
    # A gram with one kind of run is done, unless that is one run that has the gram at several places.
    spans, asked = _collapsed(shared, depth, "kinds > 1 OR copies = 1")
    per_doc = shared.join(small(asked), "place").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "start", "n", "kinds")).alias("runs"))
    chunks = _with(texts, materialize(per_doc, "asked")).mapInArrow(lean(_emit_chunks(depth, unit)), f"key long, doc_id {kind}, text_hash long, start long, kinds long, chunk binary")
    chunks = materialize(chunks, "chunks")
    few, width = chunks.filter(F.col("kinds") <= hot), depth - gram
    while width > 1 and not (many := chunks.filter(F.col("kinds") > hot)).isEmpty():
        # Down to single suffixes, where a key has one kind of run.
        width = max(1, width // 8)
        pieces = many.mapInArrow(lean(_emit_slices(depth, gram, unit, width)), f"key long, doc_id {kind}, text_hash long, start long, n long, whole long, chunk binary")
        pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
        found = pieces.filter("key IS NULL").select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + depth).alias("hi"))
        pieces = pieces.filter("key IS NOT NULL")
        more, asked = _collapsed(pieces, depth, "kinds > 1")
        chunks = materialize(pieces.join(small(asked), "place").select(chunks.columns), "chunks")
        spans, few = spans.unionByName(more).unionByName(found), few.unionByName(chunks.filter(F.col("kinds") <= hot))
    few = few.repartition("key").sortWithinPartitions("key").select("key", "doc_id", "text_hash", "start", "chunk")
    return spans.unionByName(few.mapInArrow(lean(_emit_spans(depth, unit)), f"doc_id {kind}, text_hash long, lo long, hi long"))


def covered(docs: DataFrame, depth: int, unit: str, **more) -> DataFrame:
    """doc_id, text_hash, n_covered: tokens in repeated strings of `depth` tokens and more, of the documents that have some."""
    spans = repeated_spans(docs, depth, unit, **more).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(a["end"], x["lo"]))).alias("n"), F.greatest(a["end"], x["hi"]).alias("end"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return spans.select("doc_id", "text_hash", F.aggregate("spans", none, step)["n"].alias("n_covered"))


def remove_repeats(docs: DataFrame, depth: int = 400, carry: tuple[str, ...] = (), as_text: bool = False, unit: str = "bytes", **more) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_bytes, n_removed, spans (merged, in bytes), kept (the bytes outside them; or with
    as_text a string, without the halves of characters that a span cuts) and the columns of docs named in carry.

    Spans are judged on the input: every copy of a repeated string goes, the first one too. depth counts tokens: bytes, or words.
    """
    kinds = dict(docs.dtypes)
    texts, spans = _texts(docs, carry), repeated_spans(docs, depth, unit, **more)
    cuts = materialize(spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "cuts")
    whole = texts.join(small(_own(cuts.select("doc_id", "text_hash"))), _equal(), "left_anti").withColumn("spans", F.lit(None).cast("array<struct<lo:long,hi:long>>"))
    both = whole.unionByName(_with(texts, cuts))
    schema = f"doc_id {kinds['doc_id']}, text_hash long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept {'string' if as_text else 'binary'}"
    return both.mapInArrow(lean(_emit_kept(carry, as_text, unit)), schema + "".join(f", `{c}` {kinds[c]}" for c in carry))
