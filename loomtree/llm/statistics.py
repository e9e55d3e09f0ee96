"""Counts per document, of whole batches at a time: words, lines, characters by class, and common words."""

from __future__ import annotations

import numpy as np

from .common import mix, prefix_hashes, span_hashes, words

#: Classes of a byte; a code point counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "exclaim", "symbol", "other", "accented", "rest")
SYMBOLS = b"#*$%&|<>"

#: Common words of the references' languages: fixed values, public knowledge. Any other word is "other".
COMMON = tuple(
    dict.fromkeys(
        (
            "the of and to in is it that for was on are as with be at by or an from this not have has had a "
            "der die das und ist ein eine zu den von mit für auf sich nicht im dem des als auch es an er "
            "le la les de des et un une du que qui en est pour dans ce il ne sur se pas au plus par "
            "el los las y que del se por con para una su al lo como más o pero sus le"
        ).split()
    )
)


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.int64)
    for name, values in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32, 9, 11, 12, 13)), ("newline", (10,)), ("stop", b".?"), ("comma", b",;:"), ("exclaim", b"!"), ("symbol", SYMBOLS), ("accented", range(0xC3, 0xC5)), ("rest", (0xC2, *range(0xC5, 0x100)))):
        out[list(values)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)  # continuation bytes
    return out


_CLASS = _class_table()


def class_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x classes."""
    n, wide = len(at) - 1, len(CLASSES) + 1
    rows = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(rows * wide + _CLASS[data], minlength=n * wide).reshape(n, wide)[:, : len(CLASSES)]


def word_table(words_: tuple[str, ...] = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, sorted, and the words' numbers."""
    raw = [w.encode() for w in words_]
    at = np.cumsum([0, *map(len, raw)])
    h = span_hashes(prefix_hashes(np.frombuffer(b"".join(raw), np.uint8)), at[:-1], at[1:])
    order = np.argsort(h)
    return h[order], order


class Document:
    """Words and lines of rows of bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        self.starts, self.ends, self.first = words(data, at)
        self.prefix = prefix_hashes(data)
        self.hashes = span_hashes(self.prefix, self.starts, self.ends)
        self.n_words = np.diff(self.first)
        self.rows = np.repeat(np.arange(self.n), self.n_words)

    def word_chars(self) -> np.ndarray:
        lead = ((self.data & 0xC0) != 0x80).astype(np.int64)
        c = np.concatenate([[0], np.cumsum(lead)])
        return np.bincount(self.rows, c[self.ends] - c[self.starts], self.n).astype(np.int64)

    def symbols(self) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(np.isin(self.data, list(SYMBOLS)))])
        return c[self.at[1:]] - c[self.at[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and how many of them equal an earlier one."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.at[:-1], breaks + 1)
        rows = np.searchsorted(self.at, starts, side="right") - 1
        ok = (starts < len(self.data)) & (rows < self.n)
        starts, rows = starts[ok], rows[ok]
        ends = np.minimum(np.append(breaks, len(self.data))[np.searchsorted(breaks, starts)], self.at[rows + 1])
        full = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends, rows = starts[full], ends[full], rows[full]
        key = mix(span_hashes(self.prefix, starts, ends) ^ mix(rows.astype(np.uint64) + np.uint64(1)))
        _, one = np.unique(key, return_index=True)
        n = np.bincount(rows, minlength=self.n)
        return n, n - np.bincount(rows[one], minlength=self.n)

    def repeated(self, size: int = 3) -> np.ndarray:
        """Words in runs of `size` words that the row has twice or more."""
        if len(self.hashes) < size:
            return np.zeros(self.n, np.int64)
        m = len(self.hashes) - size + 1
        key = np.zeros(m, np.uint64)
        for i in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + self.hashes[i : i + m])
        key = mix(key ^ mix(self.rows[:m].astype(np.uint64) + np.uint64(1)))
        whole = self.rows[:m] == self.rows[size - 1 :]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        # A run that reaches into the next row is no run; its key may not count for others.
        counts = np.bincount(inverse, whole, len(counts))
        twice = whole & (counts[inverse] > 1)
        marked = np.zeros(len(self.hashes), bool)
        for i in range(size):
            marked[i : i + m] |= twice
        return np.bincount(self.rows, marked, self.n).astype(np.int64)

    def distinct(self) -> np.ndarray:
        key = mix(self.hashes ^ mix(self.rows.astype(np.uint64) + np.uint64(1)))
        _, one = np.unique(key, return_index=True)
        return np.bincount(self.rows[one], minlength=self.n)

    def doubled(self) -> np.ndarray:
        """Words equal to the word before."""
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.rows[1:] == self.rows[:-1])
        return np.bincount(self.rows, same, self.n).astype(np.int64)

    def common(self, table: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """rows x n common words; matches whole words as they stand, with stops and commas at their end cut off."""
        stop = np.isin(self.data[np.maximum(self.ends - 1, 0)], list(b".,"))
        h = np.where(stop & (self.ends - self.starts > 1), span_hashes(self.prefix, self.starts, self.ends - (stop & (self.ends - self.starts > 1))), self.hashes)
        place = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        hit = table[0][place] == h
        return np.bincount(self.rows[hit] * n + table[1][place[hit]], minlength=self.n * n).reshape(self.n, n)
