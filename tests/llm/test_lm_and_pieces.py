from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.conftest import AWKWARD
from textmend.llm import lm_score as lm
from textmend.llm import piece_lattice as pl

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_gradient():
    rng = np.random.default_rng(1)
    flat = lm.start() + rng.normal(0, 0.1, lm._SIZE).astype(np.float32)
    ids = rng.integers(0, lm._IDS, 50)
    ctx = lm.contexts(ids, np.repeat([0, 1], 25))
    assert (ctx[24, lm.SIDE :] == lm._IDS).all() and (ctx[25, : lm.SIDE] == lm._IDS).all() and ctx[10, 0] == ids[9] and ctx[10, lm.SIDE] == ids[11]
    loss = lambda v: -lm.log_probability(lm.split(v), ctx, ids).mean()
    big = flat.astype(np.float64)
    grad = lm.gradient(big, ctx, ids)
    at = 0
    for name, shape in lm._SHAPES.items():
        n = int(np.prod(shape))
        # places that the batch touches, of every array
        own = at + np.flatnonzero(grad[at : at + n])
        at += n
        assert len(own), name
        for k in rng.choice(own, 4):
            a, b = big.copy(), big.copy()
            a[k] += 1e-6
            b[k] -= 1e-6
            assert grad[k] == pytest.approx((loss(a) - loss(b)) / 2e-6, rel=1e-3, abs=1e-8), name
    untouched = np.setdiff1d(np.arange(lm._IDS), ctx)[0]
    assert not grad[untouched * lm.WIDTH : (untouched + 1) * lm.WIDTH].any()


def test_words_in_their_order_score_better(spark):
    rnd = random.Random(4)
    docs = []
    for i in range(400):
        w = []
        for _ in range(40):
            a = rnd.randrange(20)
            w += [f"a{a}", f"b{a}", f"c{a}"]
        docs.append((i, " ".join(w)))
    shuffled = [(1000 + i, " ".join(rnd.sample(t.split(), len(t.split())))) for i, t in docs[:40]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    hashes = lm.learn_vocabulary(df)
    net = lm.train(df, hashes)
    both = spark.createDataFrame(docs[:40] + shuffled, "doc_id long, text string")
    got = {r.doc_id: r.per_word for r in lm.score(both, hashes, net).collect()}
    assert np.mean([got[i] for i in range(40)]) > np.mean([got[1000 + i] for i in range(40)]) + 0.5


def test_bucket_words_are_charged_their_share_of_the_bucket(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("known words", k=5) + [f"r{int(rnd.paretovariate(0.4)) % 3000}" for _ in range(200)]) for _ in range(60)] + ["", "known w", "r1 r1 r1", "junk"]
    hashes = lm._words.Words(*lm._words.raw(lm._words.texts_of(pa.array(["k n o w"])))).hash
    net = lm.start()
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), hashes, net).collect()}
    hashed, scores = [], []
    for _, _, w, ids, ctx in lm._coded(pa.array(texts), lm.Vocabulary(hashes)):
        scores = np.bincount(w.row, lm.log_probability(lm.split(net), ctx, ids), len(texts))
        hashed = [(r, h, i) for r, h, i in zip(w.row.tolist(), w.hash.tolist(), ids.tolist(), strict=True) if i >= lm.KNOWN]
    of_word, of_bucket = Counter(h for _, h, _ in hashed), Counter(i for _, _, i in hashed)
    assert max(of_bucket.values()) > max(of_word.values()) > 1
    for r, h, i in hashed:
        scores[r] += np.log(of_word[h] / of_bucket[i])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_words == len(t.split()) and got[i].score == pytest.approx(scores[i], rel=1e-6)


def test_scores_of_awkward_rows(spark, awkward, nothing):
    rows = lm.score(awkward).collect()
    assert len(rows) == awkward.count() and all(r.score <= 0 and np.isfinite(r.score) for r in rows)
    assert all(r.score == 0 and r.per_word is None for r in rows if r.doc_id in (2, 3, 4))
    assert lm.score(nothing).count() == 0


def test_lattice_as_by_brute_force_and_back(spark, awkward, nothing):
    p = pl.Pieces(MODEL)
    rows = pl.encode(awkward, MODEL).collect()
    want = sorted((str(d), [i for w in pl.escaped(t or "") for i in p.viterbi(w)]) for d, t, _ in AWKWARD)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert all(r.exact and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pl.decode(pl.encode(awkward, MODEL), MODEL).collect()}
    assert all(back[d] == (t or "") for d, t, _ in AWKWARD)
    assert pl.encode(nothing, MODEL).count() == 0


def test_ids_are_the_librarys(spark):
    import sentencepiece

    rnd = random.Random(3)
    letters = "abcdeéinorst  \u2581\n😀"
    texts = [t for _, t, _ in AWKWARD] + ["".join(rnd.choices(letters, k=rnd.randrange(1, 200))) for _ in range(100)] + ["unbelievable internationalisation of the lowercased tokenizers"]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pl.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(texts[r.doc_id] or ""), texts[r.doc_id]


def test_odd_texts_round_trip(spark):
    """U+0000 is a character like any other; a text that holds the sign for a space can't come back exactly, and is told so."""
    texts = ["a\x00b \x00 c", "a\u2581b", "\u2581", "x" * 200 + " y", "", None, "two  spaces ", "\n\ttab\x1f"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in pl.encode(df, MODEL).collect()}
    back = {r.doc_id: r.text for r in pl.decode(pl.encode(df, MODEL), MODEL).collect()}
    for i, t in enumerate(texts):
        assert rows[i].exact == ("\u2581" not in (t or "")) and (not rows[i].exact or back[i] == (t or ""))
    assert pl.encode(df.limit(0), MODEL).count() == 0


def test_words_are_joined_many_at_once_without_an_exchange(spark):
    """op7: ids are the relational lattice's and the library's, a word that comes again is not solved again, and no row is shuffled."""
    import sentencepiece

    rnd, m = random.Random(9), pl.Merging(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(rnd.choices("abdeéilnorstu  \nก的.\x00" + pl.SIGN, k=rnd.randrange(200))) for _ in range(300)] + ["z" * 500 + " z", "a" * 23 + " " + "a" * 24, ""]
    words = sorted({w for t in texts for w in pl.escaped(t) if len(w) <= pl.LONGEST})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(2)
    folded = {r.word: [j for i in r.ids for j in ([i] if i >= 0 else m.pieces.of_char(chr(-1 - i)))] for r in pl.lattice(df, m.pieces).collect()}
    # few slots: words are driven out, the table is emptied, and ids stay right
    m.kept = pl._kept.Kept(16, np.dtype("<u4"))
    for part in (texts, texts[::-1], texts[:50]):
        flat, counts, exact = m.encode(part)
        ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert ids == [lib.encode(t) for t in part] and exact.tolist() == [pl.SIGN not in t for t in part]
    assert all(x == [j for w in pl.escaped(t) for j in folded[w]] for t, x in zip(part, ids, strict=True) if max(map(len, pl.escaped(t)), default=0) <= pl.LONGEST)
    again, solved = pl.Merging(MODEL), []
    inner = again.ranked.ids
    again.ranked.ids = lambda data, start, size: (solved.append(len(start)), inner(data, start, size))[1]
    for _ in range(3):
        again.encode([" ".join(f"w{i}" for i in range(500))] * 2)
    assert sum(solved) < 600
    plan = pl.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), MODEL)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_the_relational_lattice_gives_the_same_rows(spark, awkward):
    """The way of unigram models, with a BPE model."""
    rows = [sorted(map(str, f(awkward, MODEL).collect())) for f in (pl.encode_lattice, pl.encode_arrays)]
    assert rows[0] == rows[1] and len(rows[0]) == len(AWKWARD)
