from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from textmend.llm import chunk_fingerprint as cf


def weights(text: str) -> Counter:
    data = text.encode()
    ends, _ = cf.boundaries(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    out: Counter = Counter()
    for b, e in zip([0, *ends[:-1]], ends, strict=True):
        out[data[b:e]] += int(e - b)
    return out


def brute_force(a: str, b: str) -> float:
    x, y = weights(a), weights(b)
    return (x & y).total() / min(x.total(), y.total())


def test_weights_of_long_repetitive_texts(spark):
    rnd = random.Random(2)
    other = "".join(rnd.choices("abcdefghij klmnop", k=400_000))
    texts = ["a" * 400_000, other, "one line again and again, " * 20_000, other[::-1], "short", ""]
    rows = cf.edit_probe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, following = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        changed = cf.edited(text, following)
        if text and following:
            assert r.near_edited == pytest.approx(brute_force(text, changed), abs=1e-12)
            assert r.near_next == pytest.approx(brute_force(text, following), abs=1e-12)
        for fingerprint, t in ((r.fingerprint, text), (r.edited_fingerprint, changed)):
            own = cf.decode(fingerprint)
            assert own[:, 1].sum() == len(t.encode()) and cf.encode(own) == fingerprint and (np.diff(own[:, 0].astype(np.int64)) > 0).all()
    assert abs(next(r.near_edited for r in rows if r.doc_id == 0) - 0.5) < 0.01


def test_awkward_rows(spark, awkward, nothing):
    """Every row has its own; equal texts have equal fingerprints; an empty table has none."""
    rows = cf.edit_probe(awkward).collect()
    assert len(rows) == awkward.count()
    same = [r.fingerprint for r in rows if r.doc_id == 1]
    assert len(same) == 2 and len(set(same)) == 1
    texts = {d: t for d, t in awkward.select("doc_id", "text").collect()}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id] or "") and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert cf.edit_probe(nothing).count() == 0
