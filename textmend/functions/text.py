"""Text rewrites and detectors as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import direction
from . import arrow
from . import tables as T


def _chars(c: Column) -> Column:
    return F.split(c, "")


def translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, *T.flat(table))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def count_of(c: Column, members: str) -> Column:
    """How many of the characters are in the class: what is left when all others are cut."""
    return F.length(F.regexp_replace(c, f"[^{members}]+", "")).cast("long")


def fold_spaces(c: Column) -> Column:
    return F.translate(c, T.SPACES, " " * len(T.SPACES))


def fold_thousands(c: Column) -> Column:
    """The thousands separator is a comma unless a digit stands on both sides."""
    return F.regexp_replace(c, f"(?<![{T.DIGITS}]){T.THOUSANDS}|{T.THOUSANDS}(?![{T.DIGITS}])", T.COMMA)


#: Code points that NFC can't change, wherever they stand.
_STABLE = "\\x00-\\u02ff\\u0600-\\u060f\\u061b-\\u064a\\u0660-\\u066f\\u0671-\\u06d3\\u2002-\\u20cf\\ue000-\\uf8ff\\ufb50-\\ufdff\\ufe10-\\ufffd"


def uncomposed(c: Column) -> Column:
    """The text if it holds something that NFC could change, else null."""
    return F.when(c.rlike(f"[^{_STABLE}]"), c)


def compose(c: Column) -> Column:
    """NFC; the kernel sees only texts that hold something it could change."""
    return F.coalesce(arrow.nfc(uncomposed(c)), c)


def sanitize(c: Column, soft_hyphen: str | None = "-", collapse: bool = False, spaces: bool = True, separators: bool = True, replacement: bool = True, nfc: bool = True, zero_width: bool = True) -> Column:
    """Extraction hygiene: spaces, soft hyphens, separators, replacement characters, zero width, composition."""
    out = fold_spaces(c) if spaces else c
    if soft_hyphen is not None:
        out = F.replace(out, F.lit(T.SOFT_HYPHEN), F.lit(soft_hyphen))
    out = F.when(out.contains(T.THOUSANDS), fold_thousands(out)).otherwise(out) if separators else out
    out = F.translate(out, (T.BAD if replacement else "") + (T.ZERO_WIDTH if zero_width else ""), "")
    out = F.regexp_replace(out, r"[^\S\n\r]+", " ") if collapse else out
    return compose(out) if nfc else out


def fold_simple(c: Column) -> Column:
    """Forms that stand for one letter, after the tatweel beside any form has gone."""
    bare = F.regexp_replace(c, f"(?<=[{T.FORMS}]){T.TATWEEL}|{T.TATWEEL}(?=[{T.FORMS}])", "")
    return translate(bare, T.SIMPLE)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def expand_deferred(c: Column) -> Column:
    """Ligatures and mark forms, by table; texts without any are left alone. The lam-alef ligatures need no table."""
    usual = [x for x in T.DEFERRED if "\ufef5" <= x <= "\ufefc"]
    rare = {k: v for k, v in T.DEFERRED.items() if k not in usual}
    own = F.create_map(*[F.lit(x) for kv in rare.items() for x in kv])

    def others(t: Column) -> Column:
        whole = F.array_join(F.transform(_chars(t), lambda x: F.when(x.rlike(f"[{T.FORMS}]"), F.coalesce(own[x], x)).otherwise(x)), "")
        # a range: a class of hundreds of single characters is tested one by one
        return F.when(t.rlike(f"[{T.FORMS}]"), whole).otherwise(t)

    return let(reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(T.DEFERRED[k])), usual, c), others)


def fold_punctuation(c: Column) -> Column:
    many = [(k, v) for k, v in T.PUNCTUATION.items() if len(v) > 1]
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), many, translate(c, T.PUNCTUATION))


def fold_homoglyphs(c: Column) -> Column:
    return translate(c, T.HOMOGLYPHS)


def unify(c: Column, alef: bool = True, taa: bool = False, maqsura: bool = False, diacritics: bool = True) -> Column:
    """Opt-in unifications: alef variants, teh marbuta to heh, alef maqsura to yeh, no diacritics."""
    a = ("آأإٱ" if alef else "") + ("ة" if taa else "") + ("ى" if maqsura else "")
    b = ("ا" * 4 if alef else "") + ("ه" if taa else "") + ("ي" if maqsura else "")
    return F.translate(c, a + (T.MARKS if diacritics else ""), b)


def mirror(c: Column) -> Column:
    return translate(c, T.MIRROR)


def reverse_line(c: Column) -> Column:
    """A visual line in logical order without any island: clusters (a letter and its marks) reversed, brackets mirrored."""
    return mirror(F.array_join(F.reverse(F.regexp_extract_all(c, F.lit(r"([\s\S]\p{Mn}*)"), F.lit(1))), ""))


#: Needs the islands, marks and brackets weighed one by one: anything that runs from left to right, has marks or dots.
_ODD = r"[0-9A-Za-z٠-٩۰-۹À-ɏ\p{Mn}\u06e5\u06e6.()]"


def fix_order(c: Column, how: direction.Turning = direction.Turning()) -> Column:
    """Every line turned. Lines of plain letters are reversed here; texts with islands, marks or dots go to the kernel."""
    return F.coalesce(arrow.turned(how)(odd_order(c, how)), plain_order(c))


def odd_order(c: Column, how: direction.Turning = direction.Turning()) -> Column:
    """The text if it needs the kernel to be turned, else null."""
    return c if how != direction.Turning() else F.when(c.rlike(_ODD), c)


def plain_order(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), reverse_line), "\n")


def order_marks(c: Column) -> Column:
    """Shadda before the other marks of a letter."""
    return F.when(c.rlike("[\\p{Mn}&&[^\u0651]]\u0651"), F.aggregate(F.sequence(F.lit(1), F.lit(4)), c, lambda x, _: F.regexp_replace(x, "([\\p{Mn}&&[^\u0651]]+)(\u0651+)", "$2$1"))).otherwise(c)


def relocate_dots(c: Column) -> Column:
    """A dot before a year or number ends the sentence behind it; repeated dots are one."""
    digit = "\\p{Nd}"
    word = "(?![\\p{L}\\p{N}_])"
    out = F.regexp_replace(c, f"(?<![{digit}.])\\.({digit}{{4}}){word}", "$1.")
    out = F.regexp_replace(out, f"(?<=[\\s{T.ARABIC}])\\.({digit}{{2,}}){word}", "$1.")
    return F.when(c.contains("."), F.regexp_replace(out, "\\.{2,}", ".")).otherwise(c)


def lam_alef_decisive(c: Column) -> Column:
    return count(c, f"[{T.ALEFS}][{T.ALEFS}]{T.LAM}")


def lam_alef_ambiguous(c: Column) -> Column:
    return count(c, f"(?<=[؀-ۿ])[{T.ALEFS}]{T.LAM}(?=[؀-ۿ])")


def repair_lam_alef(c: Column, passes: int = 8) -> Column:
    """alef alef lam is alef lam alef: never a word's beginning otherwise. Repeated while anything is found."""
    found = f"([{T.ALEFS}])([{T.ALEFS}])({T.LAM})"
    return F.when(c.rlike(found), F.aggregate(F.sequence(F.lit(1), F.lit(passes)), c, lambda t, _: F.when(t.rlike(found), F.regexp_replace(t, found, "$1$3$2")).otherwise(t))).otherwise(c)


def swap_known(c: Column, swaps: Column) -> Column:
    """Words that a map (broken to fixed) knows are replaced; only texts with an ambiguous lam-alef are cut into words."""
    word = "\u0621-\u06d3"
    parts = F.regexp_extract_all(c, F.lit(f"([{word}]+|[^{word}]+)"), F.lit(1))
    return F.when(lam_alef_ambiguous_in(c) & (F.size(swaps) > 0), F.array_join(F.transform(parts, lambda w: F.coalesce(swaps[w], w)), "")).otherwise(c)


def lam_alef_ambiguous_in(c: Column) -> Column:
    return c.rlike(f"(?<=[\u0600-\u06ff])[{T.ALEFS}]{T.LAM}(?=[\u0600-\u06ff])")


def is_suspect(word: Column) -> Column:
    """Whether a word holds alef-lam where no article can be: a candidate for a lam-alef that was turned."""
    return word.rlike(f"(?<!^)(?<!^[وفبكل])(?<=[\u0600-\u06ff])[{T.ALEFS}]{T.LAM}(?=[\u0600-\u06ff])")


def suspects(c: Column) -> Column:
    """Distinct suspect words in order."""
    found = F.regexp_extract_all(c, F.lit("([\u0621-\u06d3]+)"), F.lit(1))
    return F.when(lam_alef_ambiguous_in(c), F.array_sort(F.array_distinct(F.filter(found, is_suspect)))).otherwise(F.array().cast("array<string>"))


def punctuation_spacing(c: Column) -> Column:
    """No space before, one after, Arabic punctuation between Arabic letters."""
    marks, letter = "،؛؟", "[ء-ي]"
    out = F.regexp_replace(c, f"(?<={letter}) +(?=[{marks}])", "")
    return F.regexp_replace(out, f"([{marks}])(?={letter})", "$1 ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([{T.ARABIC}{T.FORMS}]+)"), F.lit(1))


def ratios(c: Column) -> Column:
    """Struct of arabic (letters and forms), and the shares of forms, private-use characters and tatweel."""
    n = F.length(c)
    private = f"{T.PRIVATE}\\x{{f0000}}-\\x{{ffffd}}\\x{{100000}}-\\x{{10fffd}}"

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of).otherwise(0.0)

    def measured(own: Column) -> Column:
        arabic = F.length(own)
        return F.struct(arabic.cast("long").alias("arabic"), share(count_of(own, T.FORMS), arabic).alias("pf_ratio"), share(F.when(c.rlike(f"[{private}]"), count_of(c, private)).otherwise(0), n).alias("pua_ratio"), share(n - F.length(F.replace(c, F.lit(T.TATWEEL), F.lit(""))), n).alias("tatweel_ratio"))

    return let(F.regexp_replace(c, f"[^{T.ARABIC}{T.FORMS}]+", ""), measured)


def artifacts(c: Column) -> dict[str, Column]:
    return {
        "nbsp_like": count(c, f"[{T.SPACES}]"),
        "soft_hyphen": count(c, T.SOFT_HYPHEN),
        "thousands_as_comma": count(c, f"(?<![{T.DIGITS}]){T.THOUSANDS}|{T.THOUSANDS}(?![{T.DIGITS}])"),
        "replacement": count(c, T.BAD),
        "spacing_diacritic_pf": count(c, "[ﹰ-ﹿ]"),
        "zero_width": count(c, f"[{T.ZERO_WIDTH}]"),
    }


def joining_tally(c: Column) -> Column:
    """Struct of pairs and wrong ones: a form joins the next one exactly if that joins back; in a logical order all do."""
    return arrow.joining_tally(c)


WEIGHTS = (0.5, 0.35, 0.15)


def signals(c: Column, shaped: Column | None = None) -> Column:
    """Struct of final_only and article (of the folded text) and joining (of the text as it was shaped); null without evidence."""
    return arrow.signals(c, c if shaped is None else shaped)


def vote(s: Column) -> Column:
    """Mean of the signals there are, weighted .50, .35 and .15: above 0 the order is visual."""
    parts = list(zip((s["final_only"], s["joining"], s["article"]), WEIGHTS, strict=True))
    weight = reduce(lambda x, y: x + y, (F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts))
    total = reduce(lambda x, y: x + y, (F.coalesce(v * w, F.lit(0.0)) for v, w in parts))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def order_score(c: Column, shaped: Column | None = None) -> Column:
    return let(signals(c, shaped), vote)


def turned_terminators(c: Column) -> Column:
    """Struct of how many lines of 12 code points or more begin and end with a sentence's end."""
    own = F.filter(F.transform(F.split(c, "\r\n|[\n\r]"), F.trim), lambda x: F.length(x) >= 12)
    return let(own, lambda x: F.struct(F.size(F.filter(x, lambda y: y.rlike("^[.؟!؛]"))).alias("starts"), F.size(F.filter(x, lambda y: y.rlike("[.؟!؛]$"))).alias("ends")))


def glyph_text(name: Column) -> Column:
    """The text a glyph name tells: uniXXXX..., uXXXX to uXXXXXX; a suffix after a dot is dropped; cidN, gN and the like tell nothing."""
    base = F.regexp_extract(name, r"^([^.]*)", 1)
    hexes = F.when(base.rlike("^uni([0-9A-Fa-f]{4})+$"), F.regexp_extract_all(F.substring(base, 4, 1 << 20), F.lit("([0-9A-Fa-f]{4})"), F.lit(1))).when(base.rlike("^u[0-9A-Fa-f]{4,6}$"), F.array(F.substring(base, 2, 6)))
    codes = F.filter(F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("long")), lambda v: (v <= 0x10FFFF) & ~v.between(0xD800, 0xDFFF))
    # UTF-32 bytes are the code points themselves
    text = F.decode(F.unhex(F.array_join(F.transform(codes, lambda v: F.lpad(F.hex(v), 8, "0")), "")), "UTF-32")
    return F.when(F.size(codes) > 0, text)


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def confidence(chars: Column) -> Column:
    """Of a text in which nothing is found: .30 to .90, by its length."""
    return F.round(0.30 + 0.60 * F.least(F.lit(1.0), chars / 300.0), 3)


def recover_utf8(c: Column) -> Column:
    """UTF-8 bytes that were read as CP1252 or Latin-1; null where they are none, and where signs of both are mixed."""
    mixed = c.rlike(f"[{''.join(T.CP1252)}]") & c.rlike(f"[{''.join(T.CP1252.values())}]")

    def recovered(t: Column) -> Column:
        odd = t.rlike("[^\\x00-\\u00ff]") | ~t.rlike("[\\u0080-\\u00ff]")
        return F.when(~odd, F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string")))

    return F.when(~mixed, let(translate(c, T.CP1252), recovered))


def recover_legacy(c: Column) -> Column:
    """CP1256 or ISO-8859-6 bytes that were read as CP1252 or Latin-1: the reading with more Arabic, the former of equal ones.

    It must gain three Arabic letters, and half of what isn't blank must be Arabic. A text whose capitals stand as they
    do in Latin is left alone (``encoding.cased_as_latin``).
    """
    outside = f"[^\\x00-\\x{{ff}}{''.join(T.CP1252)}]"
    before = count_of(c, T.ARABIC)

    def reading(table: dict[str, str]) -> Column:
        one = {k: v for k, v in table.items() if v}
        gone = "".join(k for k, v in table.items() if not v)
        own = F.translate(c, "".join(one), "".join(one.values()))
        return F.when(~c.rlike(f"[{gone}]"), own) if gone else own

    def judged(own: Column) -> Column:
        gain, seen = count_of(own, T.ARABIC) - before, F.length(F.regexp_replace(own, "\\s+", ""))
        return F.when((gain >= 3) & (seen >= 3) & (2 * count_of(own, T.ARABIC) >= seen), gain).otherwise(0)

    def best(s: Column) -> Column:
        a, b = judged(s["a"]), F.coalesce(judged(s["b"]), F.lit(0))
        return F.when(b > a, s["b"]).when(a > 0, s["a"])

    latin = c.rlike("[A-Za-z]") & ~c.rlike("[à-öø-ÿ][À-ÖØ-Þ]")
    return F.when(c.rlike("[\\x{80}-\\x{ff}]") & ~c.rlike(outside) & ~latin, let(F.struct(reading(T.CP1256).alias("a"), reading(T.ISO_8859_6).alias("b")), best))


def recovery(c: Column, windows: Column | None = None) -> Column:
    """Struct (text, how) of a text whose bytes were misread, null if it wasn't: whole as UTF-8 or a legacy page, else in windows."""
    more = lambda t: count_of(t, T.ARABIC) > count_of(c, T.ARABIC)

    def chosen(s: Column) -> Column:
        return F.when(more(s["utf8"]), F.struct(s["utf8"].alias("text"), F.lit("full-utf8").alias("how"))).when(s["legacy"].isNotNull(), F.struct(s["legacy"].alias("text"), F.lit("full-legacy").alias("how")))

    whole = F.when(c.rlike("[\\x{80}-\\x{ff}]"), let(F.struct(recover_utf8(c).alias("utf8"), recover_legacy(c).alias("legacy")), chosen))
    if windows is None:
        windows = arrow.recovered(misread(c))
    return F.coalesce(whole, F.when(windows["text"].isNotNull(), windows))


def misread(c: Column) -> Column:
    """The text if the kernel could recover it in windows, else null: it sees only texts with a lead byte's character."""
    return F.when(c.rlike("[ØÙÚÛ]"), c)


def normalize(c: Column, forms: bool = True, simple_only: bool = False, tatweel: bool = True, zero_width: bool = True, homoglyphs: bool = True, pf_tatweel: bool = True, nfc: bool = True, diacritics: bool = False, alef: bool = False, taa: bool = False, maqsura: bool = False) -> Column:
    """The layers of normalisation that are asked for, in their order."""
    if forms:
        c = fold_punctuation(fold_simple(c) if pf_tatweel else translate(c, T.SIMPLE))
        c = c if simple_only else expand_deferred(c)
    c = F.translate(c, (T.TATWEEL if tatweel else "") + (T.ZERO_WIDTH if zero_width else ""), "")
    c = unify(c, alef, taa, maqsura, diacritics)
    c = fold_homoglyphs(c) if homoglyphs else c
    return compose(c) if nfc else c


def markdown_table(rows: Column) -> Column:
    """A table (array of arrays) with a rule below its first row; ragged rows are filled, bars escaped."""

    def drawn(own: Column) -> Column:
        n = F.array_max(F.transform(own, F.size))
        filled = F.transform(own, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        lines = F.transform(filled, markdown_row)
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")

    return F.when(F.size(rows) > 0, let(rows, drawn)).otherwise("")
