"""Character streams of many texts at once, for the character n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .common import release_memory

#: Characters worked on at once; bounds a worker's memory besides its Arrow batch and one longest text.
GROUP_CHARS = 1 << 18
#: One odd 64-bit multiplier for each place of an n-gram, from the golden ratio by repeated multiplication.
_GOLDEN = 0x9E3779B97F4A7C15
PLACES = np.array([pow(_GOLDEN, k + 1, 1 << 64) | 1 for k in range(8)], dtype=np.uint64)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class Stream:
    """Lower-cased letters of the texts; a run of other characters is one 0, and `order` - 1 zeros lead each text.

    code: uint64 a place; scored: places that count; doc: their text's number."""

    def __init__(self, texts: list[str], order: int):
        lead = "\n" * (order - 1)
        texts = [t.lower() for t in texts]
        point = np.frombuffer("".join([x for t in texts for x in (lead, t, "\n")]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter((len(t) + order for t in texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(size) - size
        alpha = letters()[point]
        after = np.zeros_like(alpha)
        after[1:] = alpha[:-1]
        keep = alpha | after  # a letter, or the first of a run of others
        for k in range(order - 1):
            keep[first + k] = True
        code = np.where(alpha, point, np.uint32(0))[keep].astype(np.uint64)
        scored = (alpha | after)[keep]
        owner = np.repeat(np.arange(len(texts)), np.add.reduceat(keep, first) if len(texts) else 0)
        self.code, self.scored, self.texts = code, np.flatnonzero(scored), len(texts)
        self.doc = owner[self.scored]

    def hashes(self, n: int, skip: int = 0) -> np.ndarray:
        """Of the n-gram that ends at each scored place; skip=1: of its first n - 1 characters."""
        out = np.zeros(len(self.scored), dtype=np.uint64)
        for k in range(skip, n):
            out += self.code[self.scored - k] * PLACES[k]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum by text of a value (or a row of values) for each scored place."""
        if values.ndim == 1:
            return np.bincount(self.doc, weights=values, minlength=self.texts)
        return np.stack([np.bincount(self.doc, weights=values[:, j], minlength=self.texts) for j in range(values.shape[1])], axis=1)


def groups(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about GROUP_CHARS characters in all; null is the empty text."""
    for batch in batches:
        at, n, column = 0, batch.num_rows, batch.column(text_at)
        while at < n:
            begin, chars, texts = at, 0, []
            while at < n and (chars < GROUP_CHARS or not texts):
                texts.append(column[at].as_py() or "")
                chars += len(texts[-1])
                at += 1
            yield batch.slice(begin, at - begin), texts
    release_memory()
