from __future__ import annotations

import zlib

from textmend.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = li.identify(docs, li.learn(docs)).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    wrong = [(r, lang[r.doc_id]) for r in held if r.lang_pred != lang[r.doc_id][0]]
    print(len(held), len(wrong), [(r.lang_pred, round(r.score, 3), v[0], v[1][:80]) for r, v in wrong[:10]])
    print(sorted((round(r.score, 3), lang[r.doc_id][1][:60]) for r in rows)[:12])
    assert len(wrong) < 0.03 * len(held)


def test_awkward(spark, awkward, nothing):
    model = li.learn(awkward)
    rows = li.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {2, 3, 4} <= und and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "und"}
    kept = li.identified(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert li.identify(nothing, li.learn(nothing)).count() == 0
    assert {r.lang_pred for r in li.identify(awkward, li.Model()).collect()} == {"und"}
