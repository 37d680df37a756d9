from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from textmend.functions import arrow, spacing
from textmend.functions import text as X
from textmend.kernels import compare, direction, encoding
from textmend.operators import context, evaluate, layout, noise, rag
from textmend.operators import vocabulary as V
from textmend.plans import documents, repair
from textmend.sources import texts


def each(spark, fn, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("ابحرم", "مرحبا"),
        ("2024 ماع", "عام 2024"),
        (".اًيناث", "ثانياً."),
        ("v1.2.3 رادصإلا", "الإصدار v1.2.3"),
        ("%5.3 ةبسن", "نسبة 3.5%"),
    ],
)
def test_turned_lines(line, want):
    assert direction.turn_line(line).replace("اً", "ًا") == want.replace("اً", "ًا")


def test_order_helpers():
    assert direction.clusters("َب") == ["بَ"] and direction.clusters(" َب") == [" ", "بَ"]
    assert direction.marks_in_order("ٌّ") == "ٌّ"
    assert direction.ascending_pages("مرجع (ص. 140-125)") == "مرجع (ص. 125-140)"
    assert direction.mend_parens("الصافي )-USD 1,250.00(") == "الصافي (-USD 1,250.00)"
    assert direction.relocate_dots("يتم في عام .2024") == "يتم في عام 2024."
    assert direction.is_solid("13-7-2024") and direction.is_solid("a@b.com") and not direction.is_solid("hello")


def misread(t, page="cp1252"):
    return "".join(bytes([b]).decode(page) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t)


def test_misread_bytes(spark):
    assert encoding.recover("Ø§Ù„Ø³Ù„Ø§Ù…") == ("السلام", "full-utf8")
    assert encoding.recover("Ø§Ù„Ù…ÙCustomer Report") == ("المCustomer Report", "hybrid-window")
    assert encoding.recover(misread("كلام طويل".encode("cp1256")))[1] == "full-legacy"
    for clean in ("café résumé naïve", "plain", "", "مرحبا", "Øresund"):
        assert encoding.recover(clean) is None or clean == "Øresund"
    given = ["Ø§Ù„Ø³Ù„Ø§Ù…", "Ø§Ù„Ù…ÙCustomer Report", misread("كلام طويل".encode("cp1256")), "café résumé", "مرحبا", ""]
    got = each(spark, lambda c: X.recovery(c), given)
    assert [g and (g.text, g.how) for g in got] == [encoding.recover(g) for g in given]


WORD = re.compile(f"((?:[ء-ي]{spacing.MARK}*)+)|(\\s+)|.", re.S)


def collapsed(text):
    """Word by word: what the fragment rule says, for texts of unmarked words and single blanks."""
    words = text.split(" ")
    out = words[0]
    for i, right in enumerate(words[1:]):
        left = words[i]
        r = right[:6]
        glue = 1 <= len(left) <= 3 and left not in spacing.KEPT and r not in spacing.KEPT and not right.startswith("ال")
        glue = glue and not (len(left) == 1 and left in spacing.SINGLE)
        glue = glue and (left in spacing.ARTICLES or len(right) <= 2) and not (len(left) <= 2 and len(r) > 2)
        out += ("" if glue else " ") + right
    return out


def test_midword_blanks_as_word_by_word(spark):
    rnd = random.Random(3)
    letters = "ابتمنلرسدكحعقف"
    rows = [" ".join(rnd.choice([*spacing.KEPT, "الع", "وال", "بال", "العلم"]) if rnd.random() < 0.3 else "".join(rnd.choices(letters, k=rnd.randint(1, 5))) for _ in range(8)) for _ in range(300)]
    rows = [r for r in rows if "ة" not in r]
    assert each(spark, spacing.collapse_midword, rows) == [collapsed(r) for r in rows]
    assert each(spark, spacing.collapse_midword, ["مو ضع", "مقدم ة", "في السجن", "plain a b", "عاد ي"]) == [collapsed("مو ضع"), "مقدمة", "في السجن", "plain a b", "عادي"]


def test_closed_confusions(spark):
    given = ["زيارة املتاحف", "هذالاسؤال", "غري ذلك", "مغري", "كامل السراج", "كثريًا وكبري", "plain"]
    got = each(spark, spacing.confusions, given)
    assert [g.text for g in got] == ["زيارة المتاحف", "هذاالسؤال", "غير ذلك", "مغري", "كامل السراج", "كثيرًا وكبير", "plain"]
    assert (got[0].al_meem_fixes, got[5].ye_reh_fixes, got[6].ye_reh_fixes) == (1, 2, 0)
    assert each(spark, lambda c: spacing.punctuation_spaces(spacing.particle_spaces(c)), ["كماأن", "منالعصور", "المادة(17)", "كلمة ،جديدة", "سليمانبنعبدالملك"]) == ["كما أن", "من العصور", "المادة (17)", "كلمة، جديدة", "سليمان بن عبد الملك"]


def test_ladder(spark):
    shaped, mixed = "ﻣﺮﺣﺒﺎ ﺑﺎﻟﻌﺎﻟﻢ", "هذه المدرسة الكبيرة في القرية الجميلة\nةليمج ةملك هذه ةسردملا"
    rows = [(shaped, 1), (shaped[::-1], 2), (None, 3), ("", 4), ("plain text 1.2", 5), ("Ø§Ù„Ø³Ù„Ø§Ù…", 6), ("ﺔﺳﺭﺪﻤﻟﺍ", 7), ("المجالت", 8), ("االنترنيت", 9)]
    df = spark.createDataFrame(rows, "text string, stages int")
    got = {r.repaired: r for r in repair.repair(df, how=repair.Ladder(audit="summary")).collect()}
    assert set(got) == {"مرحبا بالعالم", None, "", "plain text 1.2", "السلام", "المدرسة", "المجلات", "الانترنيت"}
    assert got["المدرسة"].stages == ["diagnose", "normalize", "reorder"] and got["المدرسة"].diagnosis.joining > 0
    assert got[""].confidence == 0.0 and got["plain text 1.2"].stages == ["diagnose"] and not got["plain text 1.2"].changed
    assert [s.rule for s in got["المجلات"].audit.steps] == ["LAM_ALEF_TRANSPOSITION"]
    again = repair.repair(spark.createDataFrame([(t,) for t in got if t], "text string")).collect()
    assert not any(r.changed for r in again)
    one = repair.repair(spark.createDataFrame([(mixed,)], "text string"), how=repair.Ladder(rescue_lines=True, spacing=False)).first()
    assert one.repaired == "هذه المدرسة الكبيرة في القرية الجميلة\nالمدرسة هذه كلمة جميلة" and "reorder" in one.stages
    with pytest.raises(ValueError):
        repair.Ladder(confidence_mode="x")
    with pytest.raises(ValueError):
        repair.Ladder(thresholds={"x": 1})


def test_document_words(spark):
    rows = [(1, 0, "قرأت المقامات هنا"), (1, 1, "هذه التفاصيل والسجالت"), (1, 2, "فتح السجلات"), (2, 0, "والسجالت")]
    df = spark.createDataFrame(rows, "doc_id long, line int, text string")
    got = {(r.doc_id, r.line): r.repaired for r in repair.repair_blocks(df, "doc_id", how=repair.Ladder(core_lexicon=False, spacing=False, reorder=False)).collect()}
    assert got[1, 2] == "فتح السجلات" and got[2, 0] == "والسجالت"
    swaps = {r.broken: r.fixed for r in V.lexicon_swaps(spark.createDataFrame([("المجلات",), ("أفعالهم",), ("أفعلاهم",)], "word string")).collect()}
    assert swaps == {"المجالت": "المجلات"}


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_and_patches(spark):
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 12))) for _ in range(2))
        assert compare.distance(a, b) == slow_distance(a, b)
    pairs = [("abcXdef", "abcYYdef"), ("", "x"), ("same", "same"), ("a\nb\nc", "a\nc\nd"), ("😀a", "a😀"), ("x" * 3000 + "\n" + "y" * 3000, "x" * 3000 + "z\n" + "y" * 2999)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("o", arrow.operations("a", "b"))
    df = df.withColumn("p", repair.full_patch(F.col("a"), F.col("b"), F.col("o")))
    for r in df.select("a", "b", repair.applied(F.col("a"), F.col("p")).alias("x"), repair.undone(F.col("b"), F.col("p")).alias("y"), repair.undone(F.lit("?"), F.col("p")).alias("z")).collect():
        assert r.x == r.b and r.y == r.a and r.z is None


def test_metrics(spark):
    df = spark.createDataFrame([(1, "بَيت كبير", "بَيت كبير"), (2, "بَيت", "بيَت"), (3, "a b c", "a x c"), (4, "", "x")], "id int, r string, h string")
    got = {r.id: r for r in evaluate.audited(evaluate.rates(df, "r", "h"), "r", "h").collect()}
    assert got[1].cer == got[1].wer == 0 and got[1].mcs_score == got[1].dbr_score == 1.0
    assert got[2].attachment_accuracy == 0.0 and got[3].wer == pytest.approx(1 / 3) and got[4].cer == 0
    worst = evaluate.worst_lines(spark.createDataFrame([(1, "ab\ncd\n\nef", "ab\ncx\nxf")], "id int, r string, h string"), "id", "r", "h").collect()
    assert [(r.line, r.cer) for r in worst] == [(3, 0.5), (2, 0.5)]


def test_layout(spark):
    rows = [(1, 10.0 * i, 100.0 + 0.3 * i, 10.0, c) for i, c in enumerate("abc")] + [(1, 10.0 * i, 130.0, 10.0, c) for i, c in enumerate("de")]
    g = spark.createDataFrame(rows, "doc_id long, x double, y double, size double, ch string")
    assert sorted((r.ch, r.row) for r in layout.lines_of(g).collect()) == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1)]
    cells = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "d"), (1, 1, 2, "e"), (1, 2, 0, "f"), (1, 2, 1, "g"), (1, 3, 0, "z")]
    t = layout.tables(spark.createDataFrame(cells, "doc_id long, line int, cell int, text string")).collect()
    assert [(r.first, r.last, r.n_cols, r.rows) for r in t] == [(0, 2, 2, [["a", "b"], ["c", "d"], ["f", "g"]])]
    marks = [(1, 0.0, 0.0, "ب", 10.0, 1), (1, 10.0, 0.0, "ت", 10.0, 2), (1, 9.0, 0.5, "َ", 10.0, 3), (1, 9.2, 0.4, "ّ", 10.0, 4)]
    got = layout.attach_marks(spark.createDataFrame(marks, "doc_id long, x double, y double, ch string, size double, seq long")).orderBy("seq").collect()
    assert [r.ch for r in got] == ["ب", "تَّ"]


def test_pages_and_documents(spark):
    rows = [(1, p, 9.0 * i, 100.0 + 22.0 * k, 11.0, 100 * k + i + 1, c) for p in (1, 2) for k, line in enumerate(["ﺔﺳﺭﺪﻤﻟﺍ", "abc 12"]) for i, c in enumerate(line)]
    g = spark.createDataFrame(rows, "doc_id long, page int, x double, y double, size double, seq long, ch string")
    own = documents.extract(g)
    doc = documents.with_footer(documents.documents(own)).first()
    assert doc.pages == 2 and doc.max_columns == 1 and "المدرسة" in doc.text and doc.title and doc.markdown.endswith("-->\n")
    profile = documents.corruption_profile(own).first()
    assert profile.pages_total == 2 and profile.pages_content_repaired == 2
    t = documents.fix_tables(spark.createDataFrame([(1, [["ﻣﺮﺣﺒﺎ", "OK"], ["x"]])], "id int, rows array<array<string>>"), "id").first()
    assert t.rows == [["مرحبا", "OK"], ["x"]]


def test_chunks(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    lines = ["Chapter 1", "some words, that end.", "more words here, too.", "", "after a blank line.", "Section 2", "the last one."]
    rows = [(1, i // 5, i, t, 11.0, (0.0, 20.0 * i, 100.0, 20.0 * i + 11)) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, f"doc_id long, page int, ord int, text string, size double, bbox {box}")
    got = rag.chunks(df).orderBy("page", "bbox.y0").collect()
    assert [(r.role, r.text, r.parents) for r in got] == [
        ("heading", "Chapter 1", []),
        ("paragraph", "some words, that end.\nmore words here, too.", ["Chapter 1"]),
        ("paragraph", "after a blank line.", ["Chapter 1"]),
        ("heading", "Section 2", ["Chapter 1"]),
        ("paragraph", "the last one.", ["Chapter 1", "Section 2"]),
    ]
    with pytest.raises(ValueError):
        rag.chunks(df, most=0)


def test_context(spark):
    sound = "ذهب الطالب الى المدرسة صباحا " * 4
    df = spark.createDataFrame([(1, sound + "ذهب الطالب الى المدرسه صباحا"), (2, "نص اخر قصير"), (3, None)], "doc_id long, t string")
    got = {r.doc_id: r for r in context.repair(df).collect()}
    assert got[1].accepted == 1 and got[1].repaired == sound + "ذهب الطالب الى المدرسة صباحا"
    assert got[2].repaired == "نص اخر قصير" and got[3].repaired is None


def test_sources(spark):
    assert texts.get_reader("glyphs").name == "glyphs" and texts.get_reader("auto").pages
    with pytest.raises(KeyError):
        texts.get_reader("nothing")
    with pytest.raises(TypeError):
        texts.blocks(spark, [3])
    assert [r.text for r in texts.blocks(spark, ["a", ("i", "b"), {"text": "c"}]).collect()] == ["a", "b", "c"]
    assert [texts.exit_code(confidence=0.4), texts.exit_code(cer=0.05), texts.exit_code(failed=True), texts.exit_code(0.9, 0.0)] == [2, 3, 1, 0]
    s = spark.createDataFrame([(1, p, "X", [0.7, 0.7, 0.7], [1.0, 1.0], 8.0, (0.0, 0.0, 5.0, 5.0)) for p in (1, 2)] + [(1, 1, "body", [0.0, 0.0, 0.0], [1.0, 0.0], 11.0, (0.0, 0.0, 5.0, 5.0))], "doc_id long, page int, text string, color array<double>, dir array<double>, size double, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.text for r in noise.kept(s).collect()] == ["body"]


def test_command_line(spark, tmp_path, capsys):
    from textmend import cli

    run = lambda *argv, given=None: cli.run(spark, cli.parser().parse_args(argv), given)
    assert run("text", given="ﻣﺮﺣﺒﺎ") == 0 and capsys.readouterr().out == "مرحبا\n"
    assert run("blocks", given="ﻣﺮﺣﺒﺎ\nplain") == 0 and capsys.readouterr().out == "مرحبا\nplain\n"
    for name, text in (("a", "one two"), ("b", "one twx")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert run("eval", str(tmp_path / "a"), str(tmp_path / "b"), "--scientific") == 3 and '"wer": 0.5' in capsys.readouterr().out
    assert run("diagnose", str(tmp_path / "a"), "--json") == 0 and '"none"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["diagnose", "x", "--pages", "-1"])
