"""Token counts through a cache of digests.

Content is normalised (null to empty, runs of ASCII white space to one space where the tokenizer drops white space) and digested with
SHA-256; the key is that digest and the tokenizer version's digest (its file, and how it is called). Stored counts are joined to the
keys; of the misses each distinct content is encoded once and its count appended to the cache. Copies inside a task are dropped before
the shuffle, so content that a third of all rows share is sent once a task at most.

Where white space always separates tokens and is dropped (white_space_splits), a text's count is the sum of its words' counts, so a task
encodes each distinct word once and keeps its count, up to `WORDS` words. Under a tokenizer of the make of word_bpe_49k.json (`_quick`),
most words' merges are done for all of them at once in numpy; tests hold these counts against the library's. All other words go to the
library.

Defined results: a null text is an empty one and has no tokens; rows with null or repeated ids keep their rows; other columns are
ignored. The cache only grows; two runs that append the same key at once leave equal rows, which reading collapses.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, binary, blocks, lean, materialize, shared_folder, small, whole_texts

WORDS = 400_000
CACHE = "version string, digest binary, n_tokens long"
#: Bytes of text whose words are looked up at a time, and the longest word that is merged in numpy, a round for each of its merges.
TEXT, LONGEST = 1 << 20, 64
#: The make of tokenizer that `_quick` knows. Characters below `LATIN` keep their form under NFC.
LATIN = 0x300
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def version(path: str, white_space_splits: bool) -> str:
    """Digest of the tokenizer's file and of the way it is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|add_special_tokens=False|white_space_splits={white_space_splits}".encode()).hexdigest()


def _counter(path: str):
    """A function from texts to token counts. Loaded where it runs; the files are part of the environment on every machine."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


class _Merges:
    """Byte pair merges of many pieces at once: in each round, every piece's lowest pair, the leftmost of equals, becomes one symbol."""

    NONE = np.int64(1 << 30)

    def __init__(self, model: dict):
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        vocab, pairs = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.base = np.array([vocab[char[i % 256] + "</w>" * (i > 255)] for i in range(512)])  # of a byte, and of a piece's last byte + 256
        self.many, self.made = max(vocab.values()) + 1, np.array([vocab[a + b] for a, b in pairs])
        key = np.array([vocab[a] * self.many + vocab[b] for a, b in pairs])
        self.rank = np.argsort(key)
        self.key = key[self.rank]
        if not (self.key[1:] > self.key[:-1]).all():
            raise ValueError("a pair has two ranks")
        self.first = self.ranks(np.repeat(self.base[:256], 512), np.tile(self.base, 256))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.many + b
        i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[i] == k, self.rank[i], self.NONE)

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of the pieces of data, which start there and fill it."""
        out = np.diff(starts, append=len(data))
        piece = np.repeat(np.arange(len(starts)), out)
        last = np.zeros(len(data), bool)
        last[np.append(starts[1:], len(data)) - 1] = True
        code = data + np.where(last, 256, 0)
        symbol, rank = self.base[code], np.full(len(data), self.NONE)
        rank[:-1] = np.where(last[:-1], self.NONE, self.first[np.where(last[:-1], 0, code[:-1] * 512) + code[1:]])
        while len(starts):
            best = np.minimum.reduceat(rank << np.int64(32) | np.arange(len(rank)), starts)
            live = best >> np.int64(32) < self.NONE
            at = best[live] & np.int64((1 << 32) - 1)
            out[piece[at]] -= 1
            symbol[at] = self.made[rank[at]]
            keep = np.repeat(live, np.diff(starts, append=len(rank)))
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbol, rank, piece = symbol[keep], rank[keep], piece[keep]
            for i in (at, at[at > 0] - 1):
                inside = i[:-1] if len(i) and i[-1] == len(piece) - 1 else i
                rank[i] = self.NONE
                inside = inside[piece[inside] == piece[inside + 1]]
                rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
        return out


def _quick(path: str, count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """count for words. Under the make of tokenizer that is known here, words of characters below `LATIN` are cut to runs of letters,
    single digits and runs of others, and merged in numpy; words with an apostrophe, a special token or over `LONGEST` characters, and
    all words under any other tokenizer, are left to count."""
    if not path.endswith(".json"):
        return count
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = made["model"]
    known = made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    if not known or made.get("post_processor") is not None or {k: v for k, v in model.items() if k not in ("vocab", "merges")} != MERGES:
        return count
    try:
        merges = _Merges(model)
    except (KeyError, ValueError):  # a byte without a symbol, or pairs that aren't plain
        return count
    kinds = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(LATIN)], np.int8)
    kinds[10] = 0  # between words
    special = re.compile("|".join(["'", rf"[^\x00-{chr(LATIN - 1)}]", *(re.escape(t["content"].lower()) for t in made["added_tokens"])]))

    def run(words: list[str]) -> list[int]:
        lower = [w.lower() for w in words]
        plain = [0 < len(w) <= LONGEST and special.search(w) is None for w in lower]
        joined = "\n".join([w for w, p in zip(lower, plain, strict=True) if p])
        rest = iter(count([w for w, p in zip(words, plain, strict=True) if not p]))
        if not joined:
            return list(rest)
        data = np.frombuffer(joined.encode(), np.uint8).astype(np.int64)
        kind = kinds[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        opens = (np.diff(kind, prepend=0) != 0) | (kind == 2)
        lead = data & 0xC0 != 0x80
        char = np.cumsum(lead) - 1
        inside = (kind != 0)[char]
        starts = np.flatnonzero((lead & opens[char])[inside])
        word = np.cumsum(data == 10)[inside][starts]
        found = iter(np.bincount(word, merges.counts(data[inside], starts), int((kind == 0).sum()) + 1).astype(np.int64).tolist())
        return [next(found if p else rest) for p in plain]

    return run


def _by_words(count, of_words=None):
    """count, on distinct words, which of_words counts if given. Python's split also cuts at four separators that are no white space to
    the tokenizer; texts with these are counted whole."""
    known: dict[str, int] = {}
    of_words = of_words or count

    def run(texts: list[str]) -> list[int]:
        odd = [i for i, t in enumerate(texts) if not t.isprintable() and any(c in t for c in "\x1c\x1d\x1e\x1f")]
        rows = [t.split() for t in texts]
        if len(known) > WORDS:
            known.clear()
        new = list({w for r in rows for w in r}.difference(known))
        known.update(zip(new, of_words(new), strict=True))
        out = [sum(map(known.__getitem__, r)) for r in rows]
        for i, n in zip(odd, count([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest is new in this task, which keeps the digests of its own partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, x in enumerate(batch.column("digest").to_pylist()):
            if x not in seen:
                seen.add(x)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encode(path: str, white_space_splits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _counter(path), set()
        if white_space_splits:
            count = _by_words(count, _quick(path, count))
        for batch in batches:
            digests, texts = batch.column("digest").to_pylist(), batch.column("content")
            fresh = []
            for i, x in enumerate(digests):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            data, at = binary(texts.take(pa.array(fresh, pa.int64())).cast(pa.binary()))
            counts: list[int] = []
            for _, _, d, o in blocks(data, at, TEXT if white_space_splits else BLOCK):
                counts += count([d[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(o[:-1], o[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in fresh], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, cache: str | None = None, white_space_splits: bool = False) -> DataFrame:
    """doc_id, n_bytes, digest (of the normalised content) and n_tokens of every row of docs.

    path: a tokenizer file, .json or .model, that every machine has there. cache: a folder that all machines share; by default one in the
    session's shared folder that is named after the tokenizer's version, so later calls find it. white_space_splits: only for tokenizers that drop white space and never join what it separates.
    """
    spark = docs.sparkSession
    known = version(path, white_space_splits)
    cache = cache or f"{shared_folder(spark)}/token-cache-{known[:16]}"
    text = F.coalesce(docs["text"], F.lit(""))
    content = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if white_space_splits else text
    keyed = whole_texts(docs).select(docs["doc_id"], F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("content", 256)))

    def stored() -> DataFrame:
        try:
            rows = spark.read.schema(CACHE).parquet(cache)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], CACHE)
        return rows.filter(F.col("version") == known).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    before = stored()
    rows = keyed.select("digest", "content").mapInArrow(lean(_first_seen), "digest binary, content string")
    misses = rows.join(before.select("digest"), "digest", "left_anti").repartition("digest")
    new = misses.mapInArrow(lean(_encode(path, white_space_splits)), "digest binary, n_tokens long")
    new.select(F.lit(known).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Written first, so that the join's two sides are plain and a content that many rows share can be split.
    counts = small(materialize(stored(), "counts"), 200_000)
    return keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "digest", "n_tokens")
