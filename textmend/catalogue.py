"""Registered queries over the driver's tables and the SQL that checks them.

Every query reads a whole table; Arabic and damaged texts are derived from it by ``translate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import tables as T
from .functions import text as X
from .kernels import pages
from .kernels.direction import Turning
from .operators import derive as D
from .operators import evaluate, layout, metrics, vocabulary
from .plans import repair
from .sources.texts import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_AR = f"ar AS (SELECT doc_id, lang, translate(lower(coalesce(text, '')), '{D.LATIN}', '{D.LETTERS}') AS t FROM documents)"
_PF = f"translate(t, '{''.join(T.ISOLATED)}', '{''.join(T.ISOLATED.values())}')"
_NOISE = f"'{T.ZERO_WIDTH[0]}' || translate(t, ' ,.', '{T.NBSP}{T.THOUSANDS}{T.SOFT_HYPHEN}')"
_LA, _AL = T.LAM + "ا", "ا" + T.LAM
_WORDS = "regexp_extract_all(t, '[ء-ۓ]{3,}')"
_TOKENS = f"regexp_extract_all(t, '[{T.ARABIC}]+')"


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def _ar(spark: SparkSession, d: str) -> DataFrame:
    return D.arabic(_docs(spark, d).select("doc_id", "lang", "text")).drop("text")


def _ar_as_stored(spark: SparkSession, d: str) -> DataFrame:
    """``_ar`` where its files are, for what moves texts to their document anyway."""
    return D.arabic(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).drop("text")


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


# text rewrites


@_query(f"WITH {_AR} SELECT doc_id, t AS out FROM ar")
def fold_simple_forms(spark, d):
    return _ar(spark, d).select("doc_id", X.fold_simple(D.with_forms(F.col("t"))).alias("out"))


@_query(f"WITH {_AR} SELECT doc_id, t AS out, length(replace(t, '{_LA}', '.')) AS n_before FROM ar")
def expand_ligatures(spark, d):
    broken = D.with_ligatures(F.col("t"))
    return _ar(spark, d).select("doc_id", X.expand_deferred(broken).alias("out"), F.length(broken).cast("long").alias("n_before"))


@_query(f"WITH {_AR}, x AS (SELECT doc_id, translate(t, '.,', '-{T.THOUSANDS}') AS t FROM ar), m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([{T.DIGITS}]){T.THOUSANDS}([{T.DIGITS}])', '\\1\x01\\2', 'g'), '([{T.DIGITS}]){T.THOUSANDS}([{T.DIGITS}])', '\\1\x01\\2', 'g') AS t FROM x) SELECT doc_id, replace(replace(t, '{T.THOUSANDS}', '{T.COMMA}'), '\x01', '{T.THOUSANDS}') AS out FROM m")
def sanitize(spark, d):
    return _ar(spark, d).select("doc_id", X.sanitize(D.with_noise(F.col("t"))).alias("out"))


@_query(f"WITH {_AR} SELECT doc_id, t AS out FROM ar")
def fold_homoglyphs(spark, d):
    return _ar(spark, d).select("doc_id", X.fold_homoglyphs(D.with_homoglyphs(F.col("t"))).alias("out"))


@_query(f"WITH {_AR} SELECT doc_id, translate(t, 'آأإةى', 'اااهي') AS out FROM ar")
def unify_letters(spark, d):
    return _ar(spark, d).select("doc_id", X.unify(F.col("t"), taa=True, maqsura=True).alias("out"))


@_query(f"SELECT doc_id, translate(coalesce(text, ''), '{''.join(T.MIRROR)}', '{''.join(T.MIRROR.values())}') AS out FROM documents")
def mirror_brackets(spark, d):
    return _docs(spark, d).select("doc_id", X.mirror(F.coalesce("text", F.lit(""))).alias("out"))


_LINES = "array_to_string(list_transform(string_split(t, chr(10)), lambda l: {}), chr(10))"


@_query(f"WITH {_AR} SELECT doc_id, {_LINES.format(f"translate(reverse(l), '{''.join(T.MIRROR)}', '{''.join(T.MIRROR.values())}')")} AS out FROM ar")
def reverse_lines(spark, d):
    """Lines of whole texts, digits and punctuation included, reversed and mirrored without any regard for islands."""
    return _ar(spark, d).select("doc_id", X.fix_order(F.col("t"), Turning(protect_islands=False, page_ranges=False, parens=False, dots=False)).alias("out"))


@_query()
def turned_islands(spark, d):
    """No SQL: islands are weighed one by one; tested against examples and properties."""
    return _ar(spark, d).select("doc_id", X.fix_order(D.visual(F.col("t"))).alias("out"))


@_query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^0-9.])\\.([0-9]{4})\\b', '\\1\\2.', 'g'), '([\\s])\\.([0-9]{2,})\\b', '\\1\\2.', 'g'), '[.]{2,}', '.', 'g') AS out FROM (SELECT doc_id, replace(text, ' 1', ' .1') AS text FROM documents)")
def relocated_dots(spark, d):
    """Dots put before numbers that begin with 1, and moved behind them."""
    return _docs(spark, d).select("doc_id", X.relocate_dots(F.replace(F.coalesce("text", F.lit("")), F.lit(" 1"), F.lit(" .1"))).alias("out"))


@_query(f"WITH {_AR}, x AS (SELECT doc_id, replace(t, ' ', 'آ') AS t FROM ar) SELECT doc_id, " + "regexp_replace(" * 8 + "t" + f", '([{T.ALEFS}])([{T.ALEFS}])({T.LAM})', '\\1\\3\\2', 'g')" * 8 + " AS out FROM x")
def repair_lam_alef(spark, d):
    return _ar(spark, d).select("doc_id", X.repair_lam_alef(F.replace("t", F.lit(" "), F.lit("آ"))).alias("out"))


@_query(f"WITH {_AR}, x AS (SELECT doc_id, translate(t, ',;?', '،؛؟') AS t FROM ar), y AS (SELECT doc_id, regexp_replace(t, '([ء-ي]) +([،؛؟])', '\\1\\2', 'g') AS t FROM x) SELECT doc_id, regexp_replace(t, '([،؛؟])([ء-ي])', '\\1 \\2', 'g') AS out FROM y")
def punctuation_spacing(spark, d):
    return _ar(spark, d).select("doc_id", X.punctuation_spacing(F.translate("t", ",;?", "،؛؟")).alias("out"))


@_query("SELECT doc_id, coalesce(text, '') AS out FROM documents WHERE regexp_matches(coalesce(text, ''), '[\x80-ÿ]') AND NOT regexp_matches(text, '[^\\x00-ÿ]')")
def recover_mojibake(spark, d):
    """UTF-8 bytes of Latin-1 texts read as Latin-1 and as CP1252, and recovered from both; null where the two differ."""
    text = F.coalesce("text", F.lit(""))
    wrong = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    own = _docs(spark, d).where(text.rlike("[\\u0080-\\u00ff]") & ~text.rlike("[^\\x00-\\u00ff]"))
    latin, windows = X.recover_utf8(wrong), X.recover_utf8(X.translate(wrong, {b: c for c, b in T.CP1252.items()}))
    return own.select("doc_id", F.when(latin == windows, latin).alias("out"))


# detectors


@_query(f"WITH {_AR}, x AS (SELECT doc_id, {_PF} || 'ـ' || chr(57344) AS t FROM ar), n AS (SELECT doc_id, {_n('t', f'[{T.ARABIC}]')} AS a, {_n('t', f'[{T.FORMS}]')} AS f, t FROM x) SELECT doc_id, (a + f)::BIGINT AS arabic, round(f / (a + f), 9) AS pf_ratio, round(1 / length(t), 9) AS pua_ratio, round(1 / length(t), 9) AS tatweel_ratio FROM n")
def damage_ratios(spark, d):
    damaged = F.concat(D.with_forms(F.col("t")), F.lit(T.TATWEEL + "\ue000"))
    own = _ar(spark, d).select("doc_id", damaged.alias("t")).select("doc_id", X.ratios(F.col("t")).alias("r"))
    return own.select("doc_id", "r.arabic", *(F.round(f"r.{k}", 9).alias(k) for k in ("pf_ratio", "pua_ratio", "tatweel_ratio")))


_ARTIFACTS = f"{_NOISE} || translate(t, 'اب', '{T.BAD}ﹰ')"


@_query(f"WITH {_AR}, x AS (SELECT doc_id, {_ARTIFACTS} AS t FROM ar), s AS (SELECT doc_id, t, length(m) - length(replace(m, '{T.THOUSANDS}', '')) AS th FROM (SELECT doc_id, t, regexp_replace(regexp_replace(t, '([{T.DIGITS}]){T.THOUSANDS}([{T.DIGITS}])', '\\1\x01\\2', 'g'), '([{T.DIGITS}]){T.THOUSANDS}([{T.DIGITS}])', '\\1\x01\\2', 'g') AS m FROM x)) SELECT doc_id, {_n('t', f'[{T.SPACES}]')} AS nbsp_like, {_n('t', T.SOFT_HYPHEN)} AS soft_hyphen, th::BIGINT AS thousands_as_comma, {_n('t', T.BAD)} AS replacement, {_n('t', 'ﹰ')} AS spacing_diacritic_pf, {_n('t', f'[{T.ZERO_WIDTH}]')} AS zero_width FROM s")
def artifact_counts(spark, d):
    """All six kinds of extraction artifacts, in texts that hold all of them."""
    noisy = F.concat(D.with_noise(F.col("t")), F.translate("t", "اب", T.BAD + "ﹰ"))
    own = _ar(spark, d).select("doc_id", noisy.alias("t"))
    return own.select("doc_id", *(v.alias(k) for k, v in X.artifacts(F.col("t")).items()))


def _signal(least: int, a: str, b: str) -> str:
    own = f"list_filter(w, lambda x: length(x) >= {least})"
    return f"len(list_filter({own}, lambda x: regexp_matches(x, '{a}'))) AS x, len(list_filter({own}, lambda x: regexp_matches(x, '{b}'))) AS y"


def _vote(source: str, joining: str) -> str:
    """CTEs of the vote over ``source`` (doc_id, t) given joining (doc_id, joining)."""
    return f"""k AS (SELECT doc_id, {_TOKENS} AS w FROM {source}),
f AS (SELECT doc_id, {_signal(2, f'^[{T.FINAL_ONLY}]', f'[{T.FINAL_ONLY}]$')} FROM k),
g AS (SELECT doc_id, {_signal(4, _LA + '$', '^' + _AL)} FROM k),
s AS (SELECT f.doc_id, CASE WHEN f.x + f.y > 0 THEN (f.x - f.y) / (f.x + f.y) END AS final_only, j.joining, CASE WHEN g.x + g.y > 0 THEN (g.x - g.y) / (g.x + g.y) END AS article FROM f JOIN g USING (doc_id) LEFT JOIN {joining} j USING (doc_id)),
v AS (SELECT *, coalesce((coalesce(final_only * .5::DOUBLE, 0) + coalesce(joining * .35::DOUBLE, 0) + coalesce(article * .15::DOUBLE, 0)) / nullif(CASE WHEN final_only IS NULL THEN 0 ELSE .5::DOUBLE END + CASE WHEN joining IS NULL THEN 0 ELSE .35::DOUBLE END + CASE WHEN article IS NULL THEN 0 ELSE .15::DOUBLE END, 0), 0)::DOUBLE AS score FROM s)"""


def _tr(x: str, kind: str) -> str:
    return f"translate({x}, '{''.join(D.form_table(kind))}', '{''.join(D.form_table(kind).values())}')"


_IN = "(a[{i}] IS NOT NULL AND a[{i}] <> '' AND contains('{letters}', a[{i}]))"
_BACK = _IN.format(i="i - 1", letters=D.DUAL) + " AND i > 1 AND " + _IN.format(i="i", letters=D.JOINED)
_ON = _IN.format(i="i", letters=D.DUAL) + " AND i < len(a) AND " + _IN.format(i="i + 1", letters=D.JOINED)
_SHAPED = f"array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN {_BACK} AND {_ON} THEN {_tr('a[i]', 'M')} WHEN {_BACK} THEN {_tr('a[i]', 'F')} WHEN {_ON} THEN {_tr('a[i]', 'I')} ELSE {_tr('a[i]', 'S')} END), '')"
_CLASSES = "VALUES " + ", ".join(f"('{f}', '{k}')" for f, k in T.JOINING.items() if f in {x for y in D.FORMS.values() for x in y.values()})
_JOIN = f"""chars AS (SELECT doc_id, i, a[i] AS ch FROM (SELECT doc_id, string_split(t, '') AS a FROM sh), unnest(range(1, len(a) + 1)) AS r(i)),
tok AS (SELECT doc_id, i, ch, sum(CASE WHEN regexp_matches(ch, '[{T.ARABIC}{T.FORMS}]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS w FROM chars),
cls(ch, c) AS ({_CLASSES}),
lagged AS (SELECT doc_id, c, lag(c) OVER (PARTITION BY doc_id, w ORDER BY i) AS p FROM tok JOIN cls USING (ch)),
jt AS (SELECT doc_id, count(*) AS pairs, count_if((p IN ('I', 'M')) <> (c IN ('M', 'F'))) AS wrong FROM lagged WHERE p IS NOT NULL GROUP BY doc_id),
j AS (SELECT doc_id, CASE WHEN wrong > 0 THEN least(1, .6::DOUBLE + .4::DOUBLE * wrong / pairs) ELSE -1 END::DOUBLE AS joining FROM jt)"""


@_query(f"WITH {_AR}, sh AS (SELECT doc_id, CASE WHEN lang = 'en' THEN reverse(u) ELSE u END AS t FROM (SELECT doc_id, lang, {_SHAPED} AS u FROM (SELECT doc_id, lang, string_split(t, '') AS a FROM ar))), src AS (SELECT doc_id, CASE WHEN lang = 'en' THEN reverse(t) ELSE t END AS t FROM ar), {_JOIN}, {_vote('src', 'j')} SELECT doc_id, round(final_only, 6) AS final_only, round(joining, 6) AS joining, round(article, 6) AS article, round(score, 6) AS order_score FROM v")
def order_vote(spark, d):
    """All three signals over shaped texts; those of one language are stored backwards."""
    u = D.shaped(F.col("t"))
    own = _ar(spark, d).select("doc_id", F.when(F.col("lang") == "en", F.reverse(u)).otherwise(u).alias("v"))
    own = own.select("doc_id", X.signals(X.fold_simple(F.col("v")), F.col("v")).alias("s"))
    return own.select("doc_id", *(F.round(f"s.{k}", 6).alias(k) for k in ("final_only", "joining", "article")), F.round(X.vote(F.col("s")), 6).alias("order_score"))


@_query(f"WITH {_AR}, sh AS (SELECT doc_id, {_SHAPED} AS t FROM (SELECT doc_id, string_split(t, '') AS a FROM ar)), {_JOIN} SELECT doc_id, coalesce(pairs, 0)::BIGINT AS pairs, 0::BIGINT AS wrong FROM ar LEFT JOIN jt USING (doc_id)")
def joining_identity(spark, d):
    """Of shaped texts in their logical order no pair is wrong."""
    return _ar(spark, d).select("doc_id", X.joining_tally(D.shaped(F.col("t"))).alias("j")).select("doc_id", "j.pairs", "j.wrong")


@_query(f"WITH {_AR} SELECT doc_id, {_n('t', f'[{T.ALEFS}][{T.ALEFS}]{T.LAM}')} AS decisive FROM ar")
def lam_alef_counts(spark, d):
    return _ar(spark, d).select("doc_id", X.lam_alef_decisive(F.col("t")).alias("decisive"))


_DAMAGE = {
    "plain": ("t", lambda t: t),
    "empty": ("' '", lambda t: F.lit(" ")),
    "forms": (_PF, D.with_forms),
    "private": ("replace(t, ' ', chr(57344))", lambda t: F.replace(t, F.lit(" "), F.lit("\ue000"))),
    "tatweel": ("replace(t, 'ا', 'اـ')", lambda t: F.replace(t, F.lit("ا"), F.lit("اـ"))),
    "lam_alef": ("replace(t, ' ', 'ااا')", lambda t: F.replace(t, F.lit(" "), F.lit("ااا"))),
}
_DAMAGED = "dm AS (" + " UNION ALL ".join(f"SELECT doc_id AS d, '{k}' AS kind, {v[0]} AS t, {'t' if k == 'forms' else v[0]} AS folded FROM ar" for k, v in _DAMAGE.items()) + "), sh AS (SELECT d || kind AS doc_id, * FROM dm), src AS (SELECT doc_id, folded AS t FROM sh)"


@_query(f"""WITH {_AR}, {_DAMAGED}, j AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[{T.FORMS}][{T.FORMS}]') THEN -1::DOUBLE END AS joining FROM sh), {_vote('src', 'j')},
n AS (SELECT sh.*, v.score, {_n('t', f'[{T.ARABIC}]')} AS a, {_n('t', f'[{T.FORMS}]')} AS f, length(t) AS n FROM sh JOIN v USING (doc_id)),
m AS (SELECT d, kind, n, CASE WHEN a + f >= 8 THEN round(score, 6) ELSE 0 END AS score, a + f > 0 AND f / (a + f) > .02 AS pf, n > 0 AND {_n('t', chr(0xe000))} / n > .01 AS pua, regexp_matches(t, '[{T.ALEFS}][{T.ALEFS}]{T.LAM}') AS la, n > 0 AND {_n('t', T.TATWEEL)} / n > .005 AS tw, trim(t, ' ') = '' AS nothing FROM n),
w AS (SELECT *, list_filter([CASE WHEN pf THEN 'presentation_forms' END, CASE WHEN pua THEN 'broken_cmap' END, CASE WHEN la THEN 'lam_alef_transposed' END, CASE WHEN tw THEN 'tatweel_noise' END, CASE WHEN score > .3 THEN 'visual_order' END], lambda x: x IS NOT NULL) AS l FROM m)
SELECT d AS doc_id, kind, CASE WHEN nothing THEN 'no_text_layer' WHEN len(l) = 0 THEN 'none' ELSE array_to_string(l, ',') END AS defects, CASE WHEN nothing THEN 1 WHEN len(l) = 0 THEN round(.3 + .6 * least(1.0, n / 300.0), 3) WHEN list_contains(l, 'visual_order') THEN round(least(1, abs(score)), 3) ELSE 1 END::DOUBLE AS confidence FROM w""")
def diagnose_damage(spark, d):
    """Every text in six states; each defect fires, and so does the early exit of an empty text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), fn(F.col("t")).alias("x")) for k, (_, fn) in _DAMAGE.items()])
    own = _ar(spark, d).select("doc_id", F.inline(kinds)).select("doc_id", "kind", repair.diagnosis(F.col("x")).alias("g"))
    return own.select("doc_id", "kind", F.array_join("g.defects", ",").alias("defects"), "g.confidence")


@_query("SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'no_text_layer' ELSE 'none' END AS defects, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 1 ELSE round(.3 + .6 * least(1.0, length(coalesce(text, '')) / 300.0), 3) END::DOUBLE AS confidence FROM documents")
def diagnose_untouched(spark, d):
    own = _docs(spark, d).select("doc_id", repair.diagnosis(F.coalesce("text", F.lit(""))).alias("g"))
    return own.select("doc_id", F.array_join("g.defects", ",").alias("defects"), "g.confidence")


@_query("SELECT count(*) AS n, 0::BIGINT AS n_changed FROM documents")
def false_repairs(spark, d):
    """Text without Arabic must come back byte for byte."""
    return repair.repair(_docs(spark, d).select("text")).agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("long")).alias("n_changed"))


#: Text that the ladder gives back as it is when nothing was damaged: no decisive lam-alef, nothing that hygiene takes.
_SOUND = f"NOT regexp_matches(t, '[{T.ALEFS}][{T.ALEFS}]{T.LAM}|[{T.SPACES}{T.SOFT_HYPHEN}{T.THOUSANDS}{T.BAD}{T.ZERO_WIDTH}{T.TATWEEL}ﹰ-ﹿ{''.join(T.HOMOGLYPHS)}]')"


def _damaged(t):
    return F.array(
        F.struct(F.lit("forms").alias("damage"), D.with_forms(t).alias("x")),
        F.struct(F.lit("homoglyphs").alias("damage"), D.with_homoglyphs(t).alias("x")),
        F.struct(F.lit("ligatures").alias("damage"), D.with_ligatures(t).alias("x")),
        F.struct(F.lit("spaces").alias("damage"), F.replace(t, F.lit(" "), F.lit(T.NBSP)).alias("x")),
        F.struct(F.lit("all").alias("damage"), D.with_forms(D.with_ligatures(D.with_homoglyphs(F.replace(t, F.lit(" "), F.lit(T.NBSP))))).alias("x")),
    )


@_query(f"WITH {_AR}, k AS (SELECT unnest(['forms', 'homoglyphs', 'ligatures', 'spaces', 'all']) AS damage) SELECT damage, lang, count(*) AS n, count_if({_SOUND}) AS recovered FROM ar, k GROUP BY ALL")
def repair_recovery(spark, d):
    """Texts damaged in five ways and repaired: how many of each language come out exactly as they were before the damage.

    Steps that may change a sound text of invented words (turning by vote, blanks, closed lists) are left out; a text in
    which the ladder would rightly change something that isn't the damage can't come back.
    """
    how = repair.Ladder(reorder=False, spacing=False, confusions=False, core_lexicon=False)
    own = _ar(spark, d).select("lang", "t", F.inline(_damaged(F.col("t"))))
    fixed = repair.repair(own, "x", how)
    return fixed.groupBy("damage", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("repaired") == F.col("t")).alias("recovered"))


@_query()
def repair_ladder(spark, d):
    """No SQL: the whole ladder over shaped texts that were stored backwards, with its stages, confidence and audit."""
    own = _ar(spark, d).select("doc_id", D.visual(D.shaped(D.with_homoglyphs(F.col("t")))).alias("x"))
    return repair.repair(own, "x", repair.Ladder(audit="summary")).select("doc_id", "repaired", F.array_join("stages", ",").alias("stages"), "confidence", F.transform("audit.steps", lambda s: s["rule"]).alias("rules"))


@_query(f"WITH {_AR} SELECT doc_id, sha256(t) AS new_sha256, true AS reverted FROM ar")
def patch_round_trip(spark, d):
    own = _ar(spark, d).withColumn("damaged", D.with_ligatures(F.col("t"))).withColumn("p", repair.patch(F.col("damaged"), F.col("t")))
    return own.select("doc_id", F.col("p.new_sha256").alias("new_sha256"), (repair.reverted(F.col("t"), F.col("p")) == F.col("damaged")).alias("reverted"))


# vocabulary


@_query(f"WITH {_AR}, w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM ar) SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL")
def word_counts(spark, d):
    return vocabulary.word_counts(_ar(spark, d))


def _ngram_sql(n: int) -> str:
    return f"WITH {_AR}, w AS (SELECT doc_id, {_WORDS} AS w FROM ar), g AS (SELECT doc_id, array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM w, unnest(range(1, len(w) - {n - 2})) AS r(i)) SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL"


@_query(_ngram_sql(2))
def bigram_counts(spark, d):
    return vocabulary.ngrams(_ar_as_stored(spark, d), 2)


@_query(_ngram_sql(3))
def trigram_counts(spark, d):
    return vocabulary.ngrams(_ar_as_stored(spark, d), 3)


@_query(f"WITH {_AR}, p AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS t, (generate_subscripts(string_split(t, chr(10) || chr(10)), 1) - 1)::INT AS para FROM ar), w AS (SELECT doc_id, para, unnest(regexp_extract_all(t, '[ء-يٱ-ۓ]+')) AS word FROM p) SELECT doc_id, para, word, count(*) AS n FROM w GROUP BY ALL")
def paragraph_counts(spark, d):
    return vocabulary.paragraph_counts(_ar(spark, d))


@_query(f"WITH {_AR}, w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM ar) SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3")
def document_vocabulary(spark, d):
    return vocabulary.vocabulary(vocabulary.word_counts(_ar(spark, d)))


_GRAMS = f"{_AR}, w AS (SELECT unnest({_WORDS}) AS word FROM ar), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), p AS (SELECT word, '^' || word || '$' AS p, n FROM c), e AS (SELECT word, substring(p, i, 3) AS gram, n FROM p, unnest(range(1, greatest(length(p) - 1, 2))) AS r(i)), g AS (SELECT gram, sum(n)::BIGINT AS n FROM e GROUP BY gram)"


@_query(f"WITH {_GRAMS} SELECT gram, n FROM g")
def char_trigrams(spark, d):
    return vocabulary.char_grams(vocabulary.word_counts(_ar(spark, d)), 3)


@_query(f"WITH {_GRAMS} SELECT e.word, round(avg(ln((g.n + 1) / (SELECT sum(n) + count(*) FROM g))), 6) AS score FROM e JOIN g USING (gram) GROUP BY e.word")
def word_likelihood(spark, d):
    counts = vocabulary.word_counts(_ar(spark, d))
    return vocabulary.likelihood(counts, vocabulary.char_grams(counts, 3), 3)


@_query(f"WITH {_AR}, w AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM ar), x AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM (SELECT replace(t, '{_LA}', '{_AL}') AS t FROM ar)), s AS (SELECT word AS fixed, i, substring(word, 1, i - 2) || substring(word, i, 1) || '{T.LAM}' || substring(word, i + 1) AS broken FROM w, unnest(range(3, length(word))) AS r(i) WHERE regexp_matches(substring(word, i - 1, 2), '^{T.LAM}[{T.ALEFS}]$')), u AS (SELECT broken, fixed FROM s QUALIFY row_number() OVER (PARTITION BY broken ORDER BY i, encode(fixed)) = 1) SELECT x.word, u.fixed FROM x JOIN u ON x.word = u.broken WHERE x.word NOT IN (SELECT word FROM w)")
def lexicon_repairs(spark, d):
    own = _ar(spark, d)
    return vocabulary.lexicon_repairs(vocabulary.tokens(own.select("doc_id", D.with_broken_lam_alef(F.col("t")).alias("t"))), vocabulary.tokens(own))


@_query()
def near_words(spark, d):
    """No SQL: all pairs of whole tables are too many there; tested against brute force."""
    def words(table):
        return spark.read.parquet(f"{d}/{table}.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word"))

    return vocabulary.near_words(words("conversations"), words("benchmark"))


@_query(f"WITH {_AR}, w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM ar), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER v AS rank, n - coalesce(lead(n) OVER v, 0) AS margin FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY n DESC, encode(word) DESC)) SELECT doc_id, word, n, rank::INT AS rank, margin FROM r WHERE rank <= 5")
def ranked_words(spark, d):
    return vocabulary.ranked(vocabulary.word_counts(_ar(spark, d)), "doc_id", "n", "word").where("rank <= 5")


# aggregates and metrics


@_query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, min(length(text)) AS least FROM conversations GROUP BY conv_id")
def joined_pages(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    pages = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n").alias("text"), F.min(F.length("text")).cast("long").alias("least"))


def _codes() -> str:
    """Every character as the sign of its family, one class after the other."""
    f = {b: k.replace("\\x{", "\\x{") for b, k in metrics.families().items()}
    x = "replace(replace(t, chr(13), chr(10)), chr(10), chr(10))"
    for sign, own in ((0xE010, f["W"]), (0xE011, f["R"]), (0xE012, f["AN"]), (0xE013, f["EN"]), (0xE014, metrics.MARK), (0xE015, "\\p{L}\\p{Mc}\\p{Nl}")):
        own = own if sign != 0xE010 else own
        x = f"regexp_replace({x}, '[{own}]', {'chr(' + str(sign) + ')'}, 'g')" if sign != 0xE010 else f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '[{own}]', chr({sign}), 'g')), chr(10))"
    return f"regexp_replace({x}, '[^\\x{{e010}}-\\x{{e015}}\\n]', chr({0xE016}), 'g')"


_FAMILIES = (("W", 0xE010), ("R", 0xE011), ("AN", 0xE012), ("EN", 0xE013), ("M", 0xE014), ("L", 0xE015), ("N", 0xE016))


@_query(f"WITH {_AR}, c AS (SELECT doc_id, {_codes()} AS c FROM ar), h AS (SELECT doc_id, unnest([{', '.join(repr(b) for b, _ in _FAMILIES)}]) AS bucket, unnest([{', '.join(f'len(regexp_extract_all(c, chr({k}) || chr(43)))' for _, k in _FAMILIES)}]) AS n FROM c) SELECT doc_id, bucket, n FROM h WHERE n > 0")
def direction_runs(spark, d):
    return metrics.run_histogram(_ar(spark, d))


@_query("WITH h AS (" + SQL["direction_runs"] + "), p AS (SELECT doc_id, n, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM h), e AS (SELECT doc_id, sum(n)::BIGINT AS n_runs, count(*) AS k, abs(sum(p * log2(p))) AS h FROM p GROUP BY doc_id) SELECT doc_id, n_runs, round(h, 4) AS entropy_bits, CASE WHEN k > 1 THEN round(h / log2(k), 4) ELSE 0 END AS normalized FROM e")
def direction_entropy(spark, d):
    return metrics.entropy(metrics.run_histogram(_ar(spark, d)))


#: The damage is in ASCII letters, of which every engine's edit distance counts one a letter.
_CONV = "c AS (SELECT conv_id, turn, text AS t FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, t, replace(t, 'on', 'no') AS b FROM c), r AS (SELECT conv_id, turn, CASE WHEN length(t) > 0 THEN levenshtein(t, b) / length(t) ELSE 0 END AS cer FROM x)"


def _rates(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    return c.select("conv_id", "turn", metrics.error_rate(F.col("text"), F.replace("text", F.lit("on"), F.lit("no"))).alias("cer"))


@_query(f"WITH {_CONV} SELECT conv_id, count(*) AS n, round(avg(cer), 6) AS mean_cer, round(max(cer), 6) AS worst FROM r GROUP BY conv_id")
def error_rates(spark, d):
    return _rates(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.max("cer"), 6).alias("worst"))


@_query(f"WITH {_CONV}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cer DESC, turn DESC) AS rank FROM r) SELECT conv_id, turn, round(cer, 6) AS cer, rank::INT AS rank FROM k WHERE rank <= 3")
def worst_lines(spark, d):
    return metrics.worst(_rates(spark, d), "conv_id", [F.desc("cer"), F.desc("turn")]).withColumn("cer", F.round("cer", 6))


@_query(f"WITH {_AR} SELECT lang, round(sum({_n('t', 'ی')}) / greatest(sum({_n('t', '[ء-ۓ]')}), 1), 6) AS drift, count(*) AS n FROM (SELECT lang, translate(t, 'ي', 'ی') AS t FROM ar) GROUP BY lang")
def homoglyph_drift(spark, d):
    t = F.translate("t", "ي", "ی")
    return _ar(spark, d).groupBy("lang").agg(F.round(F.sum(X.count_of(t, "".join(T.HOMOGLYPHS))) / F.greatest(F.sum(X.count_of(t, "ء-ۓ")), F.lit(1)), 6).alias("drift"), F.count("*").alias("n"))


# layout

_GLYPHS = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, line::INT AS line, 9.0::DOUBLE * (i - 1) AS x, 22.0::DOUBLE * line AS y, 11.0::DOUBLE AS size, s[i] AS ch FROM l, unnest(range(1, length(s) + 1)) AS r(i) WHERE s[i] NOT IN (' ', chr(9), chr(13)))"


def _glyphs(spark, d):
    return layout.glyphs(_docs(spark, d).select("doc_id", "text"))


def _pages(spark, d):
    return layout.paged(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


@_query(f"WITH {_GLYPHS} SELECT doc_id, line, min(x) AS x0, max(x) AS x1, median(y) AS y, count(*) AS n FROM g GROUP BY doc_id, line")
def line_extents(spark, d):
    return layout.extents(_glyphs(spark, d))


_GAPS = f"{_GLYPHS}, a AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id, line ORDER BY x) AS gap FROM g), b AS (SELECT *, sum(CASE WHEN gap > 2.2 * size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS cell FROM a)"


@_query(f"WITH {_GAPS} SELECT doc_id, line, cell, min(x) AS x0, max(x) AS x1, count(*) AS n, string_agg(ch, '' ORDER BY x) AS text FROM b GROUP BY doc_id, line, cell")
def line_cells(spark, d):
    return layout.over_pages(_pages(spark, d), pages.cells, "line int, cell long, x0 double, x1 double, n long, text string")


@_query(f"WITH {_GLYPHS}, e AS (SELECT doc_id, line, median(y) AS y FROM g GROUP BY ALL), h AS (SELECT *, max(y) OVER (PARTITION BY doc_id) AS hh FROM e) SELECT doc_id, line, CASE WHEN hh = 0 THEN 'body' WHEN y <= .08::DOUBLE * hh THEN 'header' WHEN y >= (1 - .08::DOUBLE) * hh THEN 'footer' ELSE 'body' END AS role FROM h")
def page_bands(spark, d):
    return layout.bands(layout.extents(_glyphs(spark, d))).select("doc_id", "line", "role")


@_query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, line, len(string_split(s, '|')) AS n_cells FROM l), i AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM c WHERE n_cells >= 2), k AS (SELECT doc_id, run, n_cells, count(*) AS k, min(line) AS f, max(line) AS l FROM i GROUP BY ALL), r AS (SELECT doc_id, min(f) AS first, max(l) AS last, sum(k)::BIGINT AS n_lines, arg_max(n_cells, k * 1000000 - f)::INT AS n_cols FROM k GROUP BY doc_id, run) SELECT * FROM r WHERE n_lines >= 3")
def table_runs(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return layout.table_runs(lines.select("doc_id", "line", F.size(F.split("s", "\\|")).alias("n_cells")))


@_query("SELECT c_custkey, '| ' || replace(c_name, '|', '\\|') || ' | ' || c_custkey::VARCHAR || ' |' AS md FROM customer")
def markdown_rows(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.markdown_row(F.array("c_name", F.col("c_custkey").cast("string"))).alias("md"))


@_query("SELECT DISTINCT chr(cp) AS ch, chr(cp) AS out FROM (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents WHERE text IS NOT NULL) WHERE cp > 32")
def glyph_names(spark, d):
    """Every character of the documents as a glyph name and back."""
    ch = _docs(spark, d).select(F.explode(F.split("text", "")).alias("ch")).where("ch > ' '").distinct()
    name = F.concat(F.lit("u"), F.lpad(F.hex(F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("long")), 4, "0"), F.lit(".alt"))
    return ch.select("ch", X.glyph_text(name).alias("out"))
