from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD
from textmend.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows, percent=60):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                near[i].append(j)
                near[j].append(i)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            todo, seen = [i], {i}
            while todo:
                for k in near[todo.pop()]:
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
            ids = [rows[k][0] for k in seen if rows[k][0] is not None]
            for k in seen:
                comp[k] = (min(ids) if ids else None,)
    return sorted(((d, len(s), len(m), c[0]) for (d, _), s, m, c in zip(rows, sets, near, comp)), key=str)


def rows_of(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    rows, base = [], []
    for i in range(n):
        if base and rnd.random() < 0.6:
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, max(1, len(w) // 4))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 8, 40, 150]))]
        base.append(w)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [2048, 4])
def test_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = rows_of(200, 5) + [(500, ""), (501, None), (502, "Alone"), (503, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jj.similar(df).collect()), key=str) == brute(rows)


def test_a_cluster_of_near_copies_is_not_sent_as_pairs(spark, monkeypatch):
    """Candidate links are few however large a cluster is, and all of its links are counted."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randint(1, 12)):
            w[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i + 1000, t) for i, t in rows_of(60, 8)]
    sent, by_part = [], jj._chunks.by_part

    def seen(blobs, parts, fn, schema):
        if fn.__name__ == "linked":
            sent.append(sum(len(jj._chunks.unpack(r.data)["a"]) for r in blobs.select("data").collect()))
        return by_part(blobs, parts, fn, schema)

    monkeypatch.setattr(jj._chunks, "by_part", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jj.similar(df).collect()), key=str) == brute(rows)
    assert len(sent) == 1 and sent[0] < 5000


def test_pieces_of_candidate_links(spark, monkeypatch):
    """The same links, whether candidates are sent at once or in small pieces, and blocks are cut by their shingles."""
    monkeypatch.setattr(jj, "PAIRS", 50)
    monkeypatch.setattr(jj, "HELD", 150)
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 200)
    rows = rows_of(80, 21)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jj.similar(df).collect()), key=str) == brute(rows)


def test_bands():
    """Near copies agree on a band, other sets don't, and small sets have none."""
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 2**48, 500, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rnd.permutation(base)[:480], rnd.integers(0, 2**48, 10, dtype=np.uint64)])) for _ in range(6)]
    sets += [np.sort(rnd.integers(0, 2**48, n, dtype=np.uint64)) for n in (500, 500, 3, 1)] + [np.zeros(0, np.uint64)]
    got = jj.bands(np.concatenate(sets), np.array([len(s) for s in sets]))
    agree = [[bool(((a == b) & (a > 0)).any()) for b in got] for a in got]
    assert all(all(x[:6]) for x in agree[:6]) and not any(any(x[6:]) for x in agree[:6])
    assert not agree[6][7] and (got[8:] == 0).all()


@pytest.mark.parametrize("parts", [48, 7])
def test_parts_whose_edges_are_no_round_numbers(spark, monkeypatch, parts):
    """A shingle's size classes stay together, so one that two sets of neighbouring classes share isn't taken for unique."""
    monkeypatch.setattr(jj._chunks, "parts_for", lambda spark, values: parts)
    rows = rows_of(150, 11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jj.similar(df).collect()), key=str) == brute(rows)
    keys = np.sort(np.random.default_rng(3).integers(0, 2**43, 5000, dtype=np.uint64) << np.uint64(5))
    keys = np.sort(np.concatenate([keys, keys | np.uint64(7), keys | np.uint64(31)]))
    at = jj._chunks.cuts(keys, parts, 48)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()
    assert all(keys[a - 1] >> np.uint64(5) != keys[a] >> np.uint64(5) for a in at[1:-1] if 0 < a < len(keys))


def test_awkward(spark, awkward, nothing):
    assert sorted(map(tuple, jj.similar(awkward).collect()), key=str) == brute([(d, t) for d, t, _ in AWKWARD])
    assert jj.similar(nothing).count() == 0
    kept = jj.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1


def test_search_in_a_group():
    rnd = random.Random(2)
    base = [rnd.getrandbits(48) for _ in range(300)]
    group = []
    for _ in range(60):
        s = {x for x in base if rnd.random() < 0.85} | {rnd.getrandbits(48) for _ in range(rnd.randint(0, 80))}
        group.append(np.array(sorted(s), np.uint64))
    a, b = jj.alike(group, None)
    want = {(i, j) for j in range(60) for i in range(j) if 100 * (o := len(np.intersect1d(group[i], group[j]))) >= 60 * (len(group[i]) + len(group[j]) - o)}
    assert set(zip(a.tolist(), b.tolist())) == want and 0 < len(want) < 60 * 59 // 2


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, rnd.randint(101, 130)) for _ in range(20)] + [(300, 300)]
    got = {r.id: r.comp for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[b] for a, b in edges if a == 100} == {100} and 300 not in got


def test_candidate_links_of_a_part_are_summed_range_by_range():
    """Pipeline, F1: a part's links are not all widened at once, however many they are, and none is lost."""
    rnd = np.random.default_rng(8)
    blobs = []
    for _ in range(20):
        a = np.sort(rnd.integers(0, 40_000, 100_000)) + (7 << 24)
        b, c = rnd.integers(0, 30, 100_000), rnd.integers(1, 4, 100_000)
        a, b, c, m = jj._summed(a, a + 1 + b, c, np.full(100_000, 9))
        blobs.append({"a": np.diff(a, prepend=0), "f": (b >> 24).astype(np.uint32), "r": (b & 0xFFFFFF).astype(np.uint32), "c": c.astype(np.uint32), "m": m.astype(np.uint32)})
    every = [np.concatenate([np.cumsum(d["a"]) for d in blobs]), *(np.concatenate([d[x] for d in blobs]).astype(np.int64) for x in "frcm")]
    a, b, c, need = jj._summed(every[0], (every[1] << 24) | every[2], every[3], every[4])
    want = set(zip(a[c >= need].tolist(), b[c >= need].tolist(), strict=True))
    n = len(every[0])
    del every, a, b, c, need
    for held in (1000, 100_000, 10**7):
        got = [x for a, b in jj._reached([dict(d) for d in blobs], held) for x in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(want) > 0 and set(got) == want
    tracemalloc.start()
    found = sum(len(a) for a, _ in jj._reached(blobs, 100_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all at once took over 100 bytes a link
    assert found == len(want) and peak < 25 * n
    assert not list(jj._reached([]))
