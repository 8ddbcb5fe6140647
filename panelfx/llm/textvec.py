"""Texts of a batch as flat numpy arrays: words, their hashes, and per-document slices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_POW = np.ones(1, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        grown = np.full(max(n, 256), _PRIME, dtype=np.uint64)
        grown[0] = 1
        _POW = np.multiply.accumulate(grown)
    return _POW[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit words over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """``bytes_``: the documents joined, one space after each; the other arrays have a row a word."""

    bytes_: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, the number of its first word (n_docs + 1 entries)


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    length = end - start
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_end, start, side="right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    if len(start):
        at = np.flatnonzero(~space)
        place = at - np.repeat(start, length)
        powers = _powers(int(length.max()))
        ends = np.concatenate(([0], np.cumsum(length)[:-1]))
        h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * powers[place], ends)
        h = mix(h)
    else:
        h = np.empty(0, dtype=np.uint64)
    return Words(b, start, length, doc, h, first)


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """A column of texts in runs of about ``most`` bytes (one document at least), null as empty."""
    at, held, size = 0, [], 0
    for k, t in enumerate(column):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= most:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def per_doc_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``x`` (rows: words) by document; zero for a document without words."""
    total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]
