"""Near duplicates by order MinHash, verified by banded alignment.

A document is its sequence of words; its k-mers are runs of two words, each labelled with its occurrence number, so that a repeated
k-mer counts as often as it occurs. A sketch draws the `length` labelled k-mers with the smallest hashes (two in texts of up to
`FEW` words) and keeps them in text order; documents that agree in one sketch are candidates. Two documents are near duplicates if their edit
similarity, one less the words to insert, delete or replace over the words of the longer, is 0.8 or more; a banded alignment of the whole
word sequences decides, on 32-bit word hashes.

Runs of two words instead of five, as an edit changes two of them at most: near duplicates have at least 0.6 of them in common however
the edits lie, while edits in every fifth word leave no run of five. In `CORPUS` three runs must agree, so strangers share few sketches. Pairs of up
to `SHORT` words are found without chance: both have a common subsequence of all words but the edits, and each text gives all its own as
buckets.

How groups are kept small: documents with equal word sequences are one representative from the start. Of each bucket (documents with
one sketch) all are aligned with one of them, the leader, `stars` times with another leader: a large group of near copies costs one
alignment per member and bucket. The first leaders are those that meet most others in all their buckets, as such lie in the middle of
their group. Documents that links have joined already, by whatever way, are not compared again. Where classes are
still apart (documents that share a passage and no more), small buckets are compared pair by pair. In larger ones a pair is compared
if it shares a rare token: of two documents with similarity 0.8 each has one of the words they share among its 0.2 n + 1 rarest, and one
of the runs of two words they share among its 0.4 n + 1 rarest, whatever order of rarity is used (prefix filtering). Either filter loses
nothing; the one that leaves fewer pairs is taken. Pairs whose words, counted in bits, already differ too much are not compared. So nothing
is dropped or capped. Classes are the connected components of
the links.

Defined results: a null text is an empty one; all texts without words form one class; texts of one word have it as
their only k-mer; rows with null or repeated ids keep their rows; class_id is the smallest id in the class (null if all are null);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, lean, materialize, mix, only, prefix_hashes, small, span_hashes, words
from .components import components

K, SIMILAR = 2, 0.8

#: Pairs of texts of up to so many words are found by common subsequences. Texts of up to FEW words draw sketches of two k-mers, FEW_TIMES
#: of them. Buckets of up to WHOLE documents are compared pair by pair.
SHORT, FEW, FEW_TIMES, WHOLE = 14, 40, 40, 16

#: For corpora of many strangers: three k-mers to a sketch, so that fewer meet by chance, and more sketches.
CORPUS = {"sketches": 64, "length": 3}

#: Bits of a document, by which pairs of up to about a thousand words are ruled out before their sequences are fetched.
BITS = 2048

#: Bytes of sequences in which tokens are counted to order them by rarity.
SAMPLE = 16 << 20

#: Cells of one row over all pairs, and words of padded sequences, that are aligned at a time.
CELLS, PADDED = 16384, 1 << 20


def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(71)).integers(1, 2**64, (n, 2), dtype=np.uint64) | np.uint64(1)


def _kmers(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of rows of words, and each row's first k-mer. A row of 1 to k - 1 words has one k-mer."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    rows = np.repeat(np.arange(len(n)), many)
    starts = np.arange(at[-1]) - at[:-1][rows] + first[:-1][rows]
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    size = np.minimum(n, k)[rows]
    for j in range(k):
        step = padded[starts + j]
        if (n < k).any():
            step = np.where(j < size, step, np.uint64(0))
        out = out * np.uint64(0x9E3779B97F4A7C15) + step
    return mix(out + size.astype(np.uint64)), at


def _labelled(kmers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each k-mer with the number of its earlier occurrences in its row."""
    key = mix(kmers ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    if len(begin) == len(s):
        return mix(kmers)
    count = np.empty(len(s), np.uint64)
    count[order] = (np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))).astype(np.uint64)
    return mix(kmers + count * np.uint64(0xD6E8FEB86659FD93))


def order_sketches(kmers: np.ndarray, at: np.ndarray, sketches: int, length: int, salt: int = 0) -> np.ndarray:
    """rows x sketches; rows must have k-mers. Rows with fewer k-mers than length take all they have."""
    many = np.diff(at)
    label = _labelled(kmers, np.repeat(np.arange(len(many)), many))
    # The place in the low bits: the minimum of a row says where it is.
    low = np.uint64((1 << int(len(kmers)).bit_length()) - 1)
    place = np.arange(len(kmers), dtype=np.uint64)
    ends = np.append(kmers, np.uint64(0))
    out = np.empty((len(many), sketches), np.uint64)
    for i, (a, b) in enumerate(_seeds(sketches)):
        h = (label ^ b) * a & ~low | place
        places = np.full((len(many), length), len(kmers), np.int64)
        for j in range(length):
            fresh = many > j
            hit = (np.minimum.reduceat(h, at[:-1])[fresh] & low).astype(np.int64)
            places[fresh, j] = hit
            h[hit] = np.uint64(2**64 - 1)
        places.sort(axis=1)
        x = np.full(len(many), i + 1 + salt, np.uint64)
        for j in range(length):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + ends[places[:, j]])
        out[:, i] = x
    return out


def subsequences(h: np.ndarray, first: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the subsequences that a pair of up to SHORT words has in common if it is near: for the words m of the longer, those
    of m less the edits allowed. Hashes contain m, so texts meet only where the longer has m words."""
    n = np.diff(first)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for m in range(1, SHORT + 1):
        size = m - int((1 - similar) * m + 1e-9)
        for words_ in range(max(size, 1), m + 1 if size < m else 0):
            hit = np.flatnonzero(n == words_)
            if len(hit):
                taken = np.array(list(combinations(range(words_), size)), np.int64).reshape(-1, size)
                x = np.full((len(hit), len(taken)), m + 1000, np.uint64)
                for j in range(size):
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[first[hit][:, None] + taken[:, j]])
                rows.append(np.repeat(hit, len(taken)))
                found.append(x.ravel())
    return np.concatenate(rows), np.concatenate(found)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, at)
    return span_hashes(prefix_hashes(data), starts, ends), first


def _rows_of(kmers: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of some rows, and each one's first."""
    many = (at[1:] - at[:-1])[rows]
    ends = np.concatenate([[0], np.cumsum(many)])
    return kmers[np.arange(ends[-1]) - np.repeat(ends[:-1] - at[:-1][rows], many)], ends


def all_buckets(h: np.ndarray, first: np.ndarray, sketches: int, length: int, k: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of rows of words, by row: subsequences of short texts, sketches of two k-mers up to FEW words, of `length` beyond.

    A pair belongs to the way for its longer text; the shorter has `similar` times as many words at least, so a row near a limit takes
    part in two ways.
    """
    n = np.diff(first)
    kmers, at = _kmers(h, first, k)
    rows, found = (list(x) for x in zip(subsequences(h, first, similar), strict=True))
    ways = ((n >= similar * (SHORT + 1)) & (n <= FEW), FEW_TIMES, min(2, length), 0), (n >= similar * (FEW + 1), sketches, length, 1 << 20)
    for inside, times, size, salt in ways:
        hit = np.flatnonzero(inside)
        if len(hit):
            found.append(order_sketches(*_rows_of(kmers, at, hit), times, size, salt).ravel())
            rows.append(np.repeat(hit, times))
    row, bucket = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((bucket, row))
    row, bucket = row[order], bucket[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    return row[new], bucket[new]


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, at)
    return span_hashes(prefix_hashes(data), starts, ends), first


def _emit_sketches(sketches: int, length: int, k: int, similar: float):
    """Two 64-bit digests of the word sequence, the number of words, and the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary(batch.column("text"))
            for lo, hi, d, o in blocks(data, at):
                h, first = _word_hashes(d, o)
                n = np.diff(first)
                place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
                digest = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + mix(place * np.uint64(2) + np.uint64(salt))))])
                    digest.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                row, bucket = all_buckets(h, first, sketches, length, k, similar)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("row_key").slice(lo, hi - lo), *map(pa.array, digest), pa.array(n.astype(np.int64)), lists], ["doc_id", "row_key", "d1", "d2", "n_words", "sketches"])

    return run


def _parities(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x words of BITS: each labelled word flips one of a row's bits. So two rows differ in no more bits than labelled words, which
    is twice the edit distance less the difference of their lengths at most."""
    n = np.diff(first)
    place = np.repeat(np.arange(len(n)) * BITS, n) + (label % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=len(n) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, BITS), axis=1).view(np.int64)


def _emit_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as 32-bit hashes of its words, and its bits."""
    for batch in batches:
        data, at = binary(batch.column("text"))
        for lo, hi, d, o in blocks(data, at):
            h, first = _word_hashes(d, o)
            short = (h >> np.uint64(32)).astype("<u4")
            bits = _parities(_labelled(mix(short.astype(np.uint64)), np.repeat(np.arange(hi - lo), np.diff(first))), first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo), pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), lists], ["rep", "seq", "bits"])


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind (1: words, 2: runs of two), first row, words of each row, and row and hash of each token, labelled with its occurrence number."""
    data, at = binary(column)
    for lo, _, d, o in blocks(data, at):
        h, first = mix(np.frombuffer(d.tobytes(), "<u4").astype(np.uint64)), o // 4
        for kind in (1, 2):
            tokens, from_ = _kmers(h, first, kind)
            rows = np.repeat(np.arange(len(first) - 1), np.diff(from_))
            yield kind, lo, np.diff(first), rows, _labelled(tokens, rows) + np.uint64(kind)


def _rarest_places(kind: int, n: np.ndarray, rows: np.ndarray, label: np.ndarray, known: np.ndarray, often: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the n words of each row the rarest 0.2 n + 1, of its runs of two words the rarest 0.4 n + 1: their indexes and places."""
    at = np.minimum(np.searchsorted(known, label), max(len(known) - 1, 0))
    count = np.where(known[at] == label, often[at], 0) if len(known) else np.zeros(len(label), np.int64)
    order = np.lexsort((label, count, rows))
    many = np.bincount(rows, minlength=len(n))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    inside = place < (np.floor(kind * (1 - similar) * n + 1e-9).astype(np.int64) + 1)[rows]
    return order[inside], place[inside]


def _emit_rarest(wanted: int, known: np.ndarray, often: np.ndarray, similar: float, shared: np.ndarray | None):
    """The rarest tokens of one kind of each sequence; of these only what is in shared, where that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, lo, n, rows, label in _tokens(batch.column("seq")):
                if kind == wanted:
                    hit, place = _rarest_places(kind, n, rows, label, known, often, similar)
                    if shared is not None:
                        met = np.isin(label[hit], shared)
                        hit, place = hit[met], place[met]
                    yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(rows[hit] + lo)), pa.array(label[hit].view(np.int64)), pa.array(place)], ["rep", "token", "place"])

    return run


def _bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the edit distance: of what the longer has, what the other has not."""
    both = np.concatenate([x, y])
    side = np.ones(len(both), np.int32)
    side[len(x) :] = -1
    order = np.argsort(both, kind="stable")
    s = both[order]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    surplus = np.add.reduceat(side[order], at) if len(s) else side
    return int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of pairs, all at once, inside a band around the diagonal; band + 1 if it is larger."""
    n, m = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    wide, p = 2 * band + 1, len(pairs)
    a = np.zeros((p, max(int(n.max()), 1)), np.uint32)
    b = np.zeros((p, int(m.max()) + int(n.max()) + 2 * wide), np.uint32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y
    inf = np.int32(1 << 28)
    ramp = np.arange(wide, dtype=np.int32)
    # Cell k of row i is column i + k - band.
    d = np.where(ramp >= band, ramp - band, inf).astype(np.int32) + np.zeros((p, 1), np.int32)
    out = np.full(p, band + 1, np.int64)
    inside = np.abs(m - n) <= band
    live = np.flatnonzero(inside)
    a, b, n, m, d = a[live], b[live], n[live], m[live], d[live]
    for i in range(int(n.max(initial=-1)) + 1):
        if i:
            new = d + (a[:, i - 1 : i] != b[:, i - 1 : i - 1 + wide])
            np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
            if i <= band:
                new[:, : band - i] = inf
                new[:, band - i] = i
            d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        hit = np.flatnonzero(n == i)
        if len(hit):
            out[live[hit]] = np.minimum(d[hit, m[hit] - i + band], band + 1)
        if i % 8 == 7:
            # Pairs that are done, or over the band in the whole row and so for good, leave.
            stay = np.flatnonzero((d.min(axis=1) <= band) & (n > i))
            if not len(stay):
                break
            if 2 * len(stay) <= len(live):
                live, a, b, n, m, d = live[stay], a[stay], b[stay], n[stay], m[stay], d[stay]
    return out


def edit_similar(left: list[np.ndarray], right: list[np.ndarray], similar: float) -> np.ndarray:
    """Whether pairs of sequences have that edit similarity. Equal ends are cut off, pairs that even as bags differ too much are done;
    the others are aligned in a band that doubles until the distance fits or the limit is reached."""
    out = np.zeros(len(left), bool)
    open_: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        most = int((1 - similar) * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) > most:
            continue
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        start = int(differ[0]) if len(differ) else n
        x, y = x[start:], y[start:]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        end = int(differ[0]) if len(differ) else n
        x, y = x[: len(x) - end], y[: len(y) - end]
        if not len(x) or not len(y):
            out[i] = max(len(x), len(y)) <= most
        elif (least := _bag_distance(x, y)) <= most:
            open_.append((i, most, x, y, least))
    band = 16
    while open_:
        open_.sort(key=lambda o: len(o[2]))
        later = [o for o in open_ if o[4] > band]
        open_ = [o for o in open_ if o[4] <= band]
        left_, at = [], 0
        while at < len(open_):
            # As many pairs of about one length as keep a row of cells, and the padded sequences, small.
            part = open_[at : at + max(1, CELLS // (2 * band + 1))]
            padded = np.array([len(o[2]) for o in part]) * np.arange(1, len(part) + 1)
            part = part[: max(1, int(np.searchsorted(padded, PADDED // 2, side="right")))]
            at += len(part)
            for o, d in zip(part, _aligned([(o[2], o[3]) for o in part], band), strict=True):
                if d <= band or band >= o[1]:
                    out[o[0]] = d <= o[1] and d <= band
                else:
                    left_.append(o)
        open_, band = left_ + later, band * 2
    return out


def _emit_near(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                data, at = binary(batch.column(name))
                sides.append([data[a:b].view("<u4") for a, b in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("rep"), pa.array(edit_similar(*sides, similar), pa.bool_())], ["leader", "rep", "near"])

    return run


def _apart(rows: DataFrame, key: str, similar: float) -> DataFrame:
    """Pairs (leader, rep, m, n) of rows with equal keys, of different classes, that their lengths and bits let be near. The class with
    most rows of a key isn't joined with itself."""
    most = rows.groupBy(key, "class").agg(F.count("*").alias("k")).groupBy(key).agg(F.max(F.struct("k", "class")).alias("most"), F.count("*").alias("classes"))
    most = materialize(most.filter("classes > 1").select(key, F.col("most.class").alias("usual")), "apart")
    rows = rows.join(small(most), key)
    listed = [c for c in ("tokens", "place") if c in rows.columns]
    few = rows.filter("class <> usual").select(key, F.col("rep").alias("leader"), F.col("class").alias("c"), F.col("n_words").alias("m"), F.col("bits").alias("own"), *(F.col(c).alias(f"own_{c}") for c in listed))
    rest = rows.select(key, "rep", "usual", F.col("class").alias("d"), F.col("n_words").alias("n"), "bits", *listed)
    most = (1 - similar) * F.greatest("m", "n") + 1e-9
    differ = sum((F.bit_count(F.col("own")[i].bitwiseXOR(F.col("bits")[i])) for i in range(BITS // 64)), F.lit(0))
    fits = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("usual")) | (F.col("leader") < F.col("rep"))) & (F.abs(F.col("m") - F.col("n")) <= most)
    fits &= differ + F.abs(F.col("m") - F.col("n")) <= 2 * most
    if listed:  # a pair meets at the first token that both have, and not at each
        fits &= ~F.arrays_overlap(F.slice("own_tokens", 1, F.col("own_place")), F.slice("tokens", 1, F.col("place")))
    return few.join(rest, key).filter(fits).select("leader", "rep", "m", "n")


def _sampled(sample: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], dict[int, float]]:
    """Of sequences with their classes: tokens that occur more than once and how often; and by kind, which of the rarest tokens are met in
    more classes than one, and the sum of squares of how many documents have these."""
    seqs, classes = sample["seq"].combine_chunks(), np.asarray(sample["class"])
    found = [label for *_, label in _tokens(seqs)]
    known, often = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
    known, often = known[often > 1], often[often > 1]
    labels: dict[int, list] = {1: [], 2: []}
    for kind, lo, n, rows, label in _tokens(seqs):
        hit, _ = _rarest_places(kind, n, rows, label, known, often, similar)
        labels[kind].append((label[hit], classes[rows[hit] + lo]))
    shared, cost = {}, {}
    for kind, parts in labels.items():
        token = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.uint64)])
        own = np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        one, at, n = np.unique(token, return_index=True, return_counts=True)
        mixed = own[at] != own[at + n - 1] if len(one) else np.zeros(0, bool)
        shared[kind], cost[kind] = one[mixed], float((n[mixed].astype(float) ** 2).sum())
    return known, often, shared, cost


def _rarest(rows: DataFrame, sequences: DataFrame, similar: float) -> DataFrame:
    """rows by key, one for each of the document's rarest tokens that others have there too: near pairs share one at least.

    Any order of tokens will do for that, as long as it is one for all; here they are counted in about `SAMPLE` bytes of sequences.
    Words or runs of two are taken, whichever makes fewer pairs there. Where these are all sequences, tokens that one class has alone
    are known, and aren't sent.
    """
    own = materialize(sequences.select("rep", "seq").join(small(rows.select("rep", "class")), "rep"), "large")
    parts = 1 + own.agg(F.sum(F.octet_length("seq"))).first()[0] // SAMPLE
    known, often, shared, cost = _sampled(own.filter(F.pmod(F.xxhash64("rep"), F.lit(parts)) == 0).select("seq", "class").toArrow(), similar)
    # Near pairs share tokens of either kind, so one kind is enough.
    kind = min(cost, key=cost.get)
    emit = _emit_rarest(kind, known, often, similar, shared[kind] if parts == 1 else None)
    rare = materialize(own.select("rep", "seq").repartition("rep").mapInArrow(lean(emit), "rep long, token long, place long"), "rarest")
    mixed = rare.join(small(rows.select("rep", "class")), "rep").groupBy("token").agg(F.min("class").alias("c"), F.max("class").alias("d")).filter("c <> d")
    keyed = rare.join(small(materialize(mixed.select("token"), "mixed")), "token")
    lists = keyed.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("listed"))
    lists = lists.join(rows, "rep").select("rep", "class", "n_words", "bits", F.col("listed.token").alias("tokens"))
    # One after another, the rarest first: posexplode keeps the tokens beside each.
    return lists.select("rep", "class", "n_words", "bits", "tokens", F.posexplode("tokens").alias("place", "key"))


def near_classes(docs: DataFrame, similar: float = SIMILAR, k: int = K, sketches: int = 40, length: int = 2, stars: int = 2) -> DataFrame:
    """doc_id, row_key (hash of id and text), n_words, class_id and class_size for every row of docs, and whether it is the one to keep.

    keep marks one row of each class, or more if rows are equal in id and text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    sketched = texts.mapInArrow(lean(_emit_sketches(sketches, length, k, similar)), f"doc_id {kind}, row_key long, d1 long, d2 long, n_words long, sketches array<long>")
    # rep, 64 bits of the word sequence, names all documents with that sequence; row tells rows apart.
    sketched = sketched.select("doc_id", "row_key", "n_words", F.xxhash64("d1", "d2").alias("rep"), F.monotonically_increasing_id().alias("row"), "sketches")
    sketched = materialize(sketched, "sketches")
    # One row stands for each rep; the others are few, or a shuffle join takes them out.
    firsts = sketched.groupBy("rep").agg(F.min("row").alias("row"), F.count("*").alias("n")).filter("n > 1")
    firsts = small(materialize(firsts.select("rep", F.col("row").alias("first")), "firsts"))
    unique = sketched.join(firsts, "rep", "left").filter("first IS NULL OR row = first")
    exploded = unique.filter("n_words > 0").select("rep", F.explode("sketches").alias("bucket"))
    # What one document has alone in a bucket needs no further look.
    crowded = exploded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("a"), F.max("rep").alias("b")).filter("size > 1")
    crowded = materialize(crowded, "crowded")
    pairs = crowded.filter("size = 2").select("a", "b").distinct()
    rows = materialize(exploded.join(small(crowded.filter("size > 2").select("bucket", "size")), "bucket").select("bucket", "rep", "size"), "buckets")
    # How many others a document meets, over all its buckets: the first leaders are those that meet most, which lie in the middle.
    central = materialize(rows.groupBy("rep").agg(F.sum("size").alias("met")), "central")
    # Of buckets with the same documents one is enough.
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep", F.lit("a"))).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit("b"))).alias("y"))
    several = several.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    rows = materialize(rows.select("bucket", "rep").join(small(materialize(several, "several")), "bucket", "left_semi"), "rows")
    pairs = materialize(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).union(rows.select("rep")).distinct()
    needed = materialize(unique.join(small(materialize(needed, "reps")), "rep", "left_semi").select("rep", "row_key", "n_words"), "needed")
    n_needed = needed.count()
    sequences = texts.select("row_key", "text").join(small(needed.drop("n_words")), "row_key").select("rep", "text").mapInArrow(lean(_emit_sequences), "rep long, seq binary, bits array<long>")
    sequences = materialize(sequences, "sequences")
    if sequences.count() > n_needed:  # rows that are equal in id and text
        sequences = materialize(sequences.groupBy("rep").agg(F.max("seq").alias("seq"), F.max("bits").alias("bits")), "sequences")
    label = needed.join(small(central), "rep", "left").select("rep", F.col("rep").alias("class"), "n_words", F.coalesce("met", F.lit(0)).alias("met"))
    label = materialize(label, "label")
    done = None
    # Lengths alone rule a pair out.
    fits = F.least("m", "n") >= F.greatest("m", "n") * similar - 1e-9
    for level in range(stars + 1):
        rows = rows.join(small(label), "rep")
        first = F.lit(0) if level else -F.col("met")
        mixed = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("c"), F.max("class").alias("d"), F.min(F.struct(first.alias("first"), F.xxhash64("rep", F.lit(level)).alias("h"), "rep", "class", "n_words")).alias("leader"))
        mixed = mixed.filter("c <> d").select("bucket", "size", F.col("leader.rep").alias("leader"), F.col("leader.class").alias("c"), F.col("leader.n_words").alias("m"))
        rows = materialize(rows.join(small(materialize(mixed, "mixed")), "bucket"), "crowded")
        if level and rows.isEmpty():
            break
        if level < stars:
            led = rows.filter(F.col("c") != F.col("class")).select("leader", "rep", "m", F.col("n_words").alias("n"))
            if not level:
                side = lambda x, n: label.select(F.col("rep").alias(x), F.col("n_words").alias(n))
                led = led.unionByName(pairs.join(small(side("a", "m")), "a").join(small(side("b", "n")), "b").select(F.col("a").alias("leader"), F.col("b").alias("rep"), "m", "n"))
        else:
            rows = rows.select("bucket", "rep", "class", "n_words", "size")
            bits = sequences.join(small(rows.select("rep").distinct()), "rep", "left_semi").select("rep", "bits")
            rows = materialize(rows.join(bits, "rep"), "left")
            led = _apart(rows.filter(F.col("size") <= WHOLE), "bucket", similar)
            large = rows.filter(F.col("size") > WHOLE)
            if not large.isEmpty():
                large = materialize(large.drop("bucket", "size").dropDuplicates(["rep"]), "large")
                led = led.unionByName(_apart(materialize(_rarest(large, sequences, similar), "keyed"), "key", similar))
        led = led.filter(fits).select(F.least("leader", "rep").alias("leader"), F.greatest("leader", "rep").alias("rep")).distinct()
        asked = materialize(led if done is None else led.join(done, ["leader", "rep"], "left_anti"), "asked")
        done = asked if done is None else done.unionByName(asked)
        x = sequences.select(F.col("rep").alias("leader"), F.col("seq").alias("x"))
        both = asked.join(x, "leader").join(sequences.select("rep", F.col("seq").alias("y")), "rep")
        near = materialize(both.select("leader", "rep", "x", "y").mapInArrow(lean(_emit_near(similar)), "leader long, rep long, near boolean").filter("near"), "near")
        if not near.isEmpty():
            c = label.select(F.col("rep").alias("leader"), F.col("class").alias("a"))
            d = label.select("rep", F.col("class").alias("b"))
            merged = components(near.join(small(c), "leader").join(small(d), "rep").select("a", "b")).withColumnRenamed("node", "class")
            label = materialize(label.join(small(merged), "class", "left").select("rep", F.coalesce("component", "class").alias("class"), "n_words", "met"), "label")
        rows = rows.select("bucket", "rep")
    label = label.select("rep", F.col("class").alias("component"))
    sizes = sketched.groupBy("rep").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least"))
    base = materialize(sizes.join(small(label), "rep", "left").select("rep", "n", "least", F.coalesce("component", "rep").alias("component")), "base")
    # Most classes are one rep; only the others meet again.
    joined = base.join(small(label.select("component").distinct()), "component", "left_semi")
    classes = joined.groupBy("component").agg(F.sum("n").alias("class_size"), F.min("least").alias("first"))
    base = base.join(small(materialize(classes, "classes")), "component", "left").select("rep", F.coalesce("class_size", "n").alias("class_size"), F.coalesce("first", "least").alias("least"))
    base = base.select("rep", "class_size", F.col("least.doc_id").alias("class_id"), F.col("least.row_key").alias("kept"))
    rows = sketched.select("doc_id", "row_key", "n_words", "rep")
    return rows.join(base, "rep").select("doc_id", "row_key", "n_words", "class_id", "class_size", (F.col("row_key") == F.col("kept")).alias("keep"))


def without_near_copies(docs: DataFrame, **more) -> DataFrame:
    """docs with one document of each class: the one with the smallest id."""
    classes = near_classes(docs, **more)
    counts = materialize(classes.groupBy("row_key").agg(F.count("*").alias("n"), F.first("keep").alias("keep")).filter("n > 1 OR NOT keep"), "counts")
    out = docs.withColumn("near_dedup_key", F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))))
    gone = counts.filter("NOT keep").select(F.col("row_key").alias("near_dedup_key"))
    out = out.join(small(gone), "near_dedup_key", "left_anti")
    if not counts.filter("keep").isEmpty():  # rows that are equal in id and text
        out = out.dropDuplicates(["near_dedup_key"])
    return out.select(*docs.columns)
