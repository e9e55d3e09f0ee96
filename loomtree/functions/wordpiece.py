"""WordPiece encoding: white space and punctuation split, lower case, greedy longest match, ## continuation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNK, CLS, SEP = 0, 100, 101, 102
MAX_WORDS, MAX_PIECES = 256, 32
_SPLIT = re.compile(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")


def pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    out, at = [], 0
    while at < len(word) and len(out) < MAX_PIECES:
        for end in range(len(word), at, -1):
            found = vocabulary.get(("##" if at else "") + word[at:end])
            if found is not None:
                out.append(found)
                at = end
                break
        else:
            return [UNK]
    return out


def encode(text: str, vocabulary: dict[str, int], max_length: int = 512) -> list[int]:
    """Ids with CLS and SEP. Without a vocabulary every byte is unknown."""
    if vocabulary:
        ids = [i for w in _SPLIT.findall(text.lower())[:MAX_WORDS] for i in pieces(w, vocabulary)]
    else:
        ids = [UNK] * len(text.encode())
    return [CLS, *ids[: max_length - 2], SEP]


def encode_batch(texts: list[str], vocabulary: dict[str, int], max_length: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [encode(t, vocabulary, max_length) for t in texts]
    wide = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), wide), PAD, np.int64), np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return ids, mask, np.zeros_like(ids)


def load_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {w.rstrip("\n"): i for i, w in enumerate(f)}


def encoded(text: Column, vocabulary: dict[str, int], max_length: int = 512) -> Column:
    """struct(input_ids, attention_mask, token_type_ids, length), padded to max_length."""

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>, token_type_ids array<int>, length int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [encode(t, vocabulary, max_length) for t in part.fillna("")]
            pad = [max_length - len(r) for r in rows]
            yield pd.DataFrame({
                "input_ids": [r + [PAD] * p for r, p in zip(rows, pad, strict=True)],
                "attention_mask": [[1] * len(r) + [0] * p for r, p in zip(rows, pad, strict=True)],
                "token_type_ids": [[0] * max_length for _ in rows],
                "length": [len(r) for r in rows],
            })

    return run(text)
