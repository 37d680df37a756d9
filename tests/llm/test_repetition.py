from __future__ import annotations

import random
import re

import pytest

from tests.llm.conftest import AWKWARD
from textmend.llm import repetition as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    """Places inside windows of n words that are found twice or more, by comparing the windows themselves."""
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, words))
    dup = {n: sum(len(words[i]) for i in covered(words, n)) for n in rp.NGRAMS}
    repeat, line_chars = len(covered(words, 8)), sum(len(w) for x in again for w in WORD.findall(x))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and 100 * line_chars <= rp.LINE_PERCENT * chars and all(100 * dup[n] <= most * chars for n, most in rp.NGRAMS.items())
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(again), repeat, failed, kept, line_chars, *dup.values())


def test_as_by_brute_force(spark, awkward):
    rnd = random.Random(8)
    texts = [t for _, t, _ in AWKWARD if len(t or "") < 30_000]
    for _ in range(150):
        vocab = [f"w{i}é" for i in range(rnd.choice([3, 30, 500]))]
        part = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 12))]
        texts.append(rnd.choice(["\n", "\n\n", " \n"]).join(rnd.choices(part, k=rnd.randint(1, 20))))
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in rp.quality(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len({g[6] for g in got.values()}) == 2
    stay = rp.kept_documents(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {i for i, g in got.items() if g[6]}


def test_awkward_rows(spark, awkward, nothing):
    rows = rp.quality(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r.kept for r in rows if r.n_words == 0)
    assert rp.quality(nothing).count() == 0 and rp.kept_documents(nothing).count() == 0
    assert rp.kept_documents(awkward).columns == awkward.columns
