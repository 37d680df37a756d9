"""Matching blocks as ``difflib`` finds them, in less time than all pairs of equal items take."""

from __future__ import annotations

import difflib
import random
import time

from textmend.kernels import compare
from textmend.kernels.matching import Matcher


def test_as_difflib():
    rnd = random.Random(7)
    for k in range(600):
        letters = "ab" if k % 3 == 0 else "abcdefg "
        a = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        b = "".join(rnd.choices(letters, k=rnd.randint(0, 60))) if k % 2 else "".join(c for c in a.replace("a", "ba") if rnd.random() > 0.1)
        for x, y in ((a, b), (a.split(), b.split()), (list(map(ord, a)), list(map(ord, b)))):
            own, want = Matcher(x, y), difflib.SequenceMatcher(None, x, y, autojunk=False)
            assert own.get_matching_blocks() == [tuple(m) for m in want.get_matching_blocks()]
            assert own.get_opcodes() == want.get_opcodes() and own.ratio() == want.ratio()


def test_many_items():
    a = list(range(70_000))
    assert Matcher(a, a[1:]).get_matching_blocks() == [(1, 0, 69_999), (70_000, 69_999, 0)]


def test_time():
    """A text of 4,000 characters with changes took seconds."""
    rnd = random.Random(3)
    a = " ".join("".join(rnd.choices("etaoin", k=4)) for _ in range(800))
    begin = time.process_time()
    compare.operations(a[:3900], a[:3900].replace(" t", "-T").replace("en", ""))
    own = time.process_time() - begin
    begin = time.process_time()
    difflib.SequenceMatcher(None, a[:3900], a[:3900].replace(" t", "-T").replace("en", ""), autojunk=False).get_opcodes()
    assert own < (time.process_time() - begin) / 3
