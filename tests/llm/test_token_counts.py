from __future__ import annotations

import importlib
import pkgutil

import numpy as np
import pytest
from tokenizers import Tokenizer

import textmend.llm
from tests.llm.conftest import AWKWARD
from textmend.llm import token_counts as tc
from textmend.llm.queries import BYTE_BPE

T = Tokenizer.from_file(BYTE_BPE)


def test_every_module_can_be_imported():
    for m in pkgutil.iter_modules(textmend.llm.__path__):
        importlib.import_module(f"textmend.llm.{m.name}")


def spans(text):
    """Byte spans of the library's tokens, from their spelling of one character a byte."""
    at, out = 0, []
    for i in T.encode(text, add_special_tokens=False).ids:
        n = len(T.id_to_token(i))
        out.append((at, at + n))
        at += n
    assert at == len(text.encode())
    return out


def brute(text, bounds, rule):
    """(tokens, crossing) of each section [a, b) by comparing every token with every section."""
    got = [[0, 0] for _ in bounds]
    for s, e in spans(text):
        share = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
        touched = [k for k, n in enumerate(share) if n]
        k = touched[0] if rule == "start" else share.index(max(share))
        got[k][0] += 1
        got[k][1] += len(touched) > 1
    return [tuple(g) for g in got]


def line_bounds(text):
    at, out = 0, []
    for part in text.encode().splitlines(keepends=True) if "\r" not in text else [p + b"\n" for p in text.encode().split(b"\n")]:
        out.append((at, at + len(part)))
        at += len(part)
    return out or [(0, 0)]


TEXTS = [t for _, t, _ in AWKWARD] + ["\n", "\n\n\n", "a\n\n\nb\n\nc \n \n", "no end\n", "x\n\n<|endoftext|>\n\ny", "\n\n  \n\n tail", "é\n😀\n\n\n\nß"]


@pytest.mark.parametrize("rule", ["most", "start"])
def test_lines_as_by_brute_force(spark, rule):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, section string, n_tokens int").repartition(3)
    rows = tc.section_counts(df, BYTE_BPE, rule=rule).orderBy("doc_id", "section").collect()
    for i, t in enumerate(TEXTS):
        own = [r for r in rows if r.doc_id == i]
        bounds = [(r.start, r.start + r.length) for r in own]
        if "\x1c" not in (t or "") and "\x85" not in (t or ""):
            assert bounds == line_bounds((t or "").replace("\r", " "))
        assert [(r.n_tokens, r.n_crossing) for r in own] == brute(t or "", bounds, rule)
    assert any(r.n_crossing for r in rows)


def test_awkward_rows(spark, awkward, nothing):
    rows = tc.section_counts(awkward, BYTE_BPE).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in rows}) == sorted({(d is None, d or 0) for d, _, _ in AWKWARD})
    assert sum(r.n_tokens for r in rows) == sum(len(spans(t or "")) for _, t, _ in AWKWARD)
    assert tc.section_counts(nothing, BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        tc.section_counts(awkward, BYTE_BPE, rule="other")


def test_blank_sections(spark):
    text = "one\ntwo\n\n\nthree\n\nfour\n\n"
    r = tc.section_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE_BPE, sections=tc.blank_sections).orderBy("section").collect()
    assert [text[x.start : x.start + x.length] for x in r] == ["one\ntwo\n\n\n", "three\n\n", "four\n\n"]
    assert [(x.n_tokens, x.n_crossing) for x in r] == brute(text, [(x.start, x.start + x.length) for x in r], "most")


def test_fields(spark):
    rows = [("a", "Hello ", "world\n\n", None), ("b", None, "", "x"), ("c", "é", "\n", "\n\n tail")]
    got = tc.field_counts(spark.createDataFrame(rows, "k string, f string, g string, h string"), ["f", "g", "h"], BYTE_BPE, "k").collect()
    for k, *fields in rows:
        fields = [f or "" for f in fields]
        sizes = [len(f.encode()) + (i < 2) for i, f in enumerate(fields)]
        at = np.append(0, np.cumsum(sizes)).tolist()
        want = brute("\n".join(fields), list(zip(at, at[1:])), "most")
        assert [(r.n_tokens, r.n_crossing) for r in got if r.key == k] == want
