from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import AWKWARD
from textmend.llm import _chunks, substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)]
    passage = [rnd.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            cut = rnd.randint(0, 6)
            w[at:at] = passage[cut : 40 - rnd.randint(0, 6)]
        if i % 10 == 0:
            w = (["same"] * rnd.randint(30, 80)) + w
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    return rows + rows[:5]


def test_windows_as_by_brute_force(spark, monkeypatch):
    rows = rows_of(120, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, sd.repeats(df).collect()), key=str)
    assert got == brute(rows, 35)


def test_awkward(spark, awkward, nothing):
    got = sorted(map(tuple, sd.repeats(awkward).collect()), key=str)
    assert got == brute([(d, t) for d, t, _ in AWKWARD], 35)
    assert sd.repeats(nothing).count() == 0
    out = sd.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] is None and texts[3] == "" and texts[6] == "" and texts[8] == AWKWARD[9][1] and texts[1] == "the same words here"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=50))
def test_values_round_trip(values):
    v = np.unique(np.array(values, np.uint64))
    assert _chunks.undeltas(_chunks.deltas(v)).tolist() == v.tolist()
    assert _chunks.undeltas(_chunks.unpack(_chunks.pack(v=_chunks.deltas(v)))["v"]).tolist() == v.tolist()
    assert _chunks.widen(_chunks.narrow(v)).tolist() == v.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=4), st.text("abc", max_size=20))
def test_matching_statistics(passages, text):
    got = sd.SuffixAutomaton([list(p) for p in passages]).matching(list(text))
    for i, n in enumerate(got):
        want = max(k for k in range(i + 2) if k == 0 or any(text[i + 1 - k : i + 1] in p for p in passages))
        assert n == want


def test_remove_passages(spark):
    ref = spark.createDataFrame([(" ".join(f"r{i}" for i in range(50)),), (None,)], "text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(f"r{i}" for i in range(5, 45)) + " b"), (2, "r1 r2 r3"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in sd.remove_passages(docs, ref, shard_words=10).collect()}
    assert got == {1: ("a b", 40), 2: ("r1 r2 r3", 0), 3: ("", 0)}


def test_a_large_reference_is_refused(spark, monkeypatch):
    monkeypatch.setattr(sd, "REFERENCE_BYTES", 3)
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    with pytest.raises(ValueError):
        sd.remove_passages(df, df)
