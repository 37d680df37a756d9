from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textmend.functions import text as X
from textmend.operators import vocabulary
from textmend.plans import repair
from textmend.sources import texts
from textmend.streaming.repair import read_texts, write_repaired


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (X.fold_simple, "ﻣﺮﺣﺒﺎ", "مرحبا"),
        (X.expand_deferred, "ﻻ", "لا"),
        (X.expand_deferred, "ﹹ", "ُ"),
        (X.sanitize, "[أ­ج]", "[أ-ج]"),
        (X.sanitize, "١٬٠٠٠", "١٬٠٠٠"),
        (X.fold_simple, "ـﻪـ", "ه"),
        (X.repair_lam_alef, "االنترنيت", "الانترنيت"),
        (X.fold_homoglyphs, "ایران", "ايران"),
        (X.fix_order, "abc", "abc"),
        (X.fix_order, "(ب ا", "ا ب)"),
        (X.relocate_dots, "عام .2024", "عام 2024."),
        (X.glyph_text, "uni06450631", "مر"),
        (X.glyph_text, "cid1234", None),
        (X.glyph_text, "u0645.fina", "م"),
        (X.recover_utf8, "Ã©", "é"),
        (X.recover_utf8, "é", None),
    ],
)
def test_expressions(spark, fn, given, want):
    assert one(spark, fn, given) == want


def test_text_without_arabic_comes_back_as_it_is(spark):
    rows = ["plain, text…", "", None, "a (b) 12.5"]
    out = repair.repair(spark.createDataFrame([(r,) for r in rows], "text string")).collect()
    assert [r.repaired for r in out] == rows and not any(r.changed for r in out)


def test_patch_is_guarded(spark):
    df = spark.createDataFrame([("abcXdef", "abcYYdef"), ("", "x"), ("same", "same"), ("aa", "a")], "a string, b string")
    out = df.select("a", "b", repair.patch(F.col("a"), F.col("b")).alias("p")).select("a", repair.reverted(F.col("b"), F.col("p")).alias("back"), repair.reverted(F.lit("other"), F.col("p")).alias("wrong")).collect()
    assert all(r.a == r.back and r.wrong is None for r in out)


def test_near_words_as_by_brute_force(spark):
    a, b = ["kitten", "cat", "a", "bat", "cats", "cat"], ["mitten", "cat", "ca", "cart", "b", "tac"]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row2 = [i]
            for j, e in enumerate(y, 1):
                row2.append(min(row[j] + 1, row2[-1] + 1, row[j - 1] + (c != e)))
            row = row2
        return row[-1]

    got = vocabulary.near_words(spark.createDataFrame([(w,) for w in a], "word string"), spark.createDataFrame([(w,) for w in b], "word string"))
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in a for y in b if distance(x, y) == 1}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ﻣﺮﺣﺒﺎ", encoding="utf-8")
    write_repaired(read_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.repaired for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["مرحبا"]
    assert texts.read(spark, str(tmp_path / "in")).count() == 1
    with pytest.raises(ValueError):
        texts.write_texts(spark.range(1).select(F.lit("x")), "a/", "a")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.n == r.recovered for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_utf8_read_as_cp1252_is_recovered(spark):
    """Some bytes are letters in CP1252, five are none and stay as they are."""
    texts = ["سلام", "م", "فهرس ٍ", "naïve – “quoted” €", "日本語", "😀"]
    wrong = ["".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode()) for t in texts]
    assert wrong[0] == "Ø³Ù„Ø§Ù…"
    assert [one(spark, X.recover_utf8, w) for w in wrong] == texts
    for clean in ("سلام", "fine…", "é – è", "Ù\u0085Ù…"):
        assert one(spark, X.recover_utf8, clean) is None
