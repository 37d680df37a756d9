"""Neighbouring words of texts, counted by key."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa


def counted(texts: list[str], word: re.Pattern, n: int) -> Counter:
    own: Counter = Counter()
    for t in texts:
        words = word.findall(t)
        own.update(zip(*(words[i:] for i in range(n))))
    return own


def over(word: str, n: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (key, texts): key, gram, n."""
    pattern = re.compile(word)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                found = [counted(t, pattern, n) for t in part.column(1).to_pylist()]
                key = part.column(0).take(pa.array([i for i, c in enumerate(found) for _ in range(len(c))], pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array([" ".join(g) for c in found for g in c], pa.string()), pa.array([k for c in found for k in c.values()], pa.int64())], schema=schema)

    return each
