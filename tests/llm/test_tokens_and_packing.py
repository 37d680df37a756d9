from __future__ import annotations

import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from textmend.llm import _bpe, packing, token_store
from textmend.llm.queries import BYTE_BPE

T = Tokenizer.from_file(BYTE_BPE)


def ids_of(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab 's\n\t  \x1c\x85é1.<|>€😀", "  ", "<|endoftext|>"]), max_size=40).map("".join))
def test_cutting_at_spaces_gives_the_ids_of_the_whole(text):
    e = _bpe.encoder(BYTE_BPE)
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == T.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_without_offsets():
    """Only the call that leaves offsets out is needed, and it gives the library's ids."""

    class WithoutOffsets:
        encode_batch_fast = T.encode_batch_fast

    e = _bpe.Encoder(BYTE_BPE)
    e.tokenizer = WithoutOffsets()
    texts = [t or "" for _, t, _ in AWKWARD] + [" ".join(f"w{i}'s é{i}" for i in range(3000))]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [T.encode(t, add_special_tokens=False).ids for t in texts]


LETTERS = [*"abcdefghijklmnoprstuvwxyzAEé", "\u00df", "\u0436", "\u7684", "\u0639"]


def test_merging_many_words_at_once_gives_the_ids_of_the_library():
    e, rnd = _bpe.Encoder(BYTE_BPE), random.Random(5)
    words = sorted({"".join(rnd.choices(LETTERS, k=rnd.randint(1, _bpe.LONGEST))) for _ in range(3000)} | {"a" * n for n in range(1, 41)}, key=len)
    got = e._letters(words)
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [x.ids for x in T.encode_batch([" " + w for w in words], add_special_tokens=False)]


def test_words_that_differ_in_their_ending_are_merged_once():
    """op1: the library gets the first word of a text and the endings, and not every word with every ending."""
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return T.encode_batch_fast(texts, **more)

    e, rnd = _bpe.Encoder(BYTE_BPE), random.Random(6)
    e.tokenizer = Counting()
    words = ["".join(rnd.choices(LETTERS, k=9)) for _ in range(2000)]
    text = "x " + " ".join(w + t for w in words for t in ("", ".", ",\n", "'s", "\u0e01", "_1"))
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == T.encode(text, add_special_tokens=False).ids
    # words before a letter outside the known ones go to the library whole
    assert sum(map(len, given)) < 2000 * 11 + 100


def test_kept_words_are_bounded():
    """op8: a process that meets ever new words keeps less than 100 MB of them, and its ids stay right."""
    e = _bpe.Encoder(BYTE_BPE)
    for k in range(9):
        e.encode(["x " + " ".join("".join(chr(97 + (n // 26**d) % 26) for d in range(5)) for n in range(k * 50_000, (k + 1) * 50_000))])
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(w) + sys.getsizeof(x) for w, x in d.items()) for d in (e.words, e.tails))
    assert len(e.words) <= 400_000 and size < 100_000_000
    text = "x zzzzz aaaaa, zzzzz.\n again"
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == T.encode(text, add_special_tokens=False).ids


ODD = [*"abzZé \n\t's'trevmd.,|-(0129\x00\x1c\x7f\x85\xa0 😀ก́ſßжǅ的ー가٠²ªº×÷­", "  ", "\n\n", " \n", "\n ", "'ll ", "'re", "\r\n", " a", " b ", "foo", "a" * 23, "<|endoftext|>", "\ufeff", "\u200b", "\u3000"]


def test_segments_give_the_ids_of_the_whole_with_few_slots():
    """op1, op8: wherever a text is cut, and with segments that drive each other out, its ids are the library's."""
    e, rnd = _bpe.Encoder(BYTE_BPE, 256), random.Random(7)
    for n in [20] * 100 + [500, 20]:
        texts = ["".join(rnd.choices(ODD, k=rnd.randrange(60))) for _ in range(n)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x.ids for x in T.encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(e.words) + len(e.tails) <= 256


def test_words_that_begin_a_line_are_merged_as_others():
    """op1, op8: of words after a line feed or a bracket the library gets nothing, and nothing of a text that came before."""
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return T.encode_batch_fast(texts, **more)

    e, rnd = _bpe.Encoder(BYTE_BPE), random.Random(8)
    e.tokenizer = Counting()
    words = ["".join(rnd.choices("abcdeinorst", k=9)) for _ in range(2000)]
    text = "".join(w + rnd.choice([".\n", ", ", " (", ")\n", " "]) for w in words)
    want = T.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == want
    assert sum(map(len, given)) < 100
    given.clear()
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == want and not "".join(given)


def test_store_round_trip(spark, awkward):
    store = token_store.write_tokens(awkward, BYTE_BPE, shard_documents=4)
    rows = store.read().collect()
    want = sorted(((-(2**63) if d is None else d), ids_of(t)) for d, t, _ in AWKWARD)
    got = sorted(((-(2**63) if r.doc_id is None else r.doc_id), np.frombuffer(r.ids, "<u2").tolist()) for r in rows)
    assert got == want
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _, _ in AWKWARD), key=lambda d: -(2**63) if d is None else d)
    at = 0
    for r in rows:
        assert r.start == at and r.ids_crc32 == crc(np.frombuffer(r.ids, "<u2"))
        at += r.n_tokens
    shard = store.manifest.orderBy("shard").first()
    one = token_store.read_document(shard.path, store.folder, store.digest, shard.documents - 1)
    assert one.tolist() == np.frombuffer(rows[shard.documents - 1].ids, "<u2").tolist()
    with pytest.raises(ValueError):
        token_store.read_document(shard.path, store.folder, "0" * 64, 0)


def test_store_of_nothing(spark, nothing):
    assert token_store.write_tokens(nothing, BYTE_BPE).read().count() == 0


def test_dictionary_is_trained_and_helps(spark):
    rnd = random.Random(1)
    words = [f"w{i}ord" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=60))) for i in range(600)], "doc_id long, text string")
    store = token_store.write_tokens(docs, BYTE_BPE, shard_documents=200)
    assert token_store.read_dictionary(store.folder, store.digest) is not None
    assert store.summary().count() == 600


def check_packing(rows, docs, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 2 and r.ids_crc32 == crc(np.frombuffer(r.ids, "<u2"))
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= length
    for d, texts in docs.items():
        want = sorted(ids_of(t) for t in texts)
        starts = sorted(r.start for r in by_doc[d])
        assert sum(r.length for r in by_doc[d]) == sum(map(len, want))
        if len(want) == 1:
            pieces = sorted(by_doc[d], key=lambda r: r.start)
            assert np.concatenate([np.frombuffer(r.ids, "<u2") for r in pieces]).tolist() == want[0]
            assert starts == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()] and {r.doc_tokens for r in pieces} == {len(want[0])}
    return by_seq


def test_packing(spark, awkward):
    docs = defaultdict(list)
    for d, t, _ in AWKWARD:
        docs[d].append(t)
    for group in (3, 8192):
        check_packing(packing.pack_documents(awkward, BYTE_BPE, length=64, group=group).collect(), docs, 64)


def test_packing_with_few_kept_segments(spark):
    """op8: pieces hold the library's ids, whatever was kept, and the process keeps no more than it is told to."""
    rnd = random.Random(11)
    docs = {i: ["".join(rnd.choices(ODD, k=rnd.randrange(300)))] for i in range(60)}
    df = spark.createDataFrame([(i, t[0]) for i, t in docs.items()], "doc_id long, text string").repartition(3)
    check_packing(packing.pack_documents(df, BYTE_BPE, length=64, kept_words=128).collect(), docs, 64)
    e = _bpe.encoder(BYTE_BPE, 128)
    e.encode([t[0] for t in docs.values()])
    assert len(e.kept.items()) <= 128 and e.kept.rows.nbytes + e.kept.pool.nbytes < 10_000


def test_packing_of_nothing(spark, nothing):
    assert packing.pack_documents(nothing, BYTE_BPE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_first_fit_and_gaps(lengths):
    bins = packing.first_fit_decreasing(lengths, 64)
    slow: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b in slow:
            if sum(lengths[j] for j in b) + lengths[i] <= 64:
                b.append(i)
                break
        else:
            slow.append([i])
    assert bins == slow
    filled = packing.pack(lengths, 64)
    assert sum(sum(e - s for _, s, e in b) < 64 for b in filled) <= 1
    parts = defaultdict(list)
    for b in filled:
        for i, s, e in b:
            parts[i].append((s, e))
    for i, n in enumerate(lengths):
        at = 0
        for s, e in sorted(parts[i]):
            assert s == at and e > s
            at = e
        assert at == n


def test_padding_rule():
    assert [packing.padding(n) for n in (1, 512, 1000, 1024)] == [0, 0, 24, 0]
