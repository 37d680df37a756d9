from __future__ import annotations

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute as brute_similar
from tests.llm.test_substring_dedup import brute as brute_repeats
from textmend.llm import repetition

import numpy as np

SF = "/root/testdata/sf0.001"


def test_stages_as_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    at = docs
    for name, stage in cp.STAGES[:-1]:
        before = at.collect()
        at = cp.stored(stage(spark, at, SF), name)
        assert at.schema.names == docs.schema.names
        got[name] = (before, at.collect())
    before, after = got["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {r.doc_id for r in before if not any(c.isalpha() for c in r.text)} 
    before, after = got["quality_rules"]
    for r in before:
        data = np.frombuffer(r.text.encode(), np.uint8)
        assert bool(repetition.measures(data, np.array([0, len(data)]))["kept"][0]) == (r in after)
    before, after = got["jaccard_join"]
    one = {c for *_, c in brute_similar([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(one)
    before, after = got["substring_dedup"]
    want = {d: k for d, _, k, _ in brute_repeats([(r.doc_id, r.text) for r in before], 35)}
    n = {r.doc_id: len(r.text.split()) for r in before}
    assert {r.doc_id: n[r.doc_id] - len(r.text.split()) for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    pieces = cp.packed(spark, at, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in after}


def test_awkward_rows_and_an_empty_table(spark, awkward, nothing):
    """Nulls, empty texts, repeated rows and other columns pass through all stages; the columns stay what they are."""
    docs = awkward
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, SF), name)
        assert docs.columns == awkward.columns
    assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(60)), "en") for i in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = plain.limit(0)
    for name, stage in cp.STAGES[1:-1]:
        none = cp.stored(stage(spark, none, SF), name)
    assert none.count() == 0 and cp.STAGES[-1][1](spark, none, SF).count() == 0
    assert cp.STAGES[0][1](spark, nothing, SF).count() == 0


def test_a_large_cluster_costs_near_duplicates_few_candidate_links(spark, monkeypatch):
    """Of a cluster of near copies one stays, and its pairs are not held as candidates."""
    rows = []
    for i in range(200):
        w = [f"w{j}" for j in range(200)]
        for k in range(5):
            w[(37 * i + 41 * k) % 200] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "en"))
    rows += [(500 + i, " ".join(f"z{i}q{j}" for j in range(50)), "en") for i in range(5)]
    sent, by_part = [], cp.jaccard_join._chunks.by_part

    def seen(blobs, parts, fn, schema):
        if fn.__name__ == "linked":
            sent.append(sum(len(cp.jaccard_join._chunks.unpack(r.data)["a"]) for r in blobs.select("data").collect()))
        return by_part(blobs, parts, fn, schema)

    monkeypatch.setattr(cp.jaccard_join._chunks, "by_part", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()) == [0, 500, 501, 502, 503, 504]
    assert len(sent) == 1 and sent[0] < 2000
