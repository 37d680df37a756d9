"""Language identification by hierarchical discrimination.

A text's features are counts of hashed byte n-grams (1 to 3, of the text with
A-Z lowered), square-rooted and scaled to length one.  First a family of
languages is predicted, by one linear support vector machine per pair of
families; then, among the family's languages, one machine per pair decides, and
the language with most won pairs (of equal numbers the larger sum of margins)
is the prediction.  The score is the product of both levels' confidence.

Machines minimise the squared hinge loss with an L2 penalty, by accelerated
gradient steps in numpy on the driver, over a bounded sample of labelled rows:
at most ``SAMPLE`` of each language and ``TOTAL`` in all, chosen by a hash of the
id.  Rows whose crc32(doc_id) modulo 4 is 2 are never learned from.  Counting
the labels covers all rows; prediction covers every whole text.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing could be learned; a null ``doc_id`` is neither learned from nor
held out; a language without relatives is a family of its own; repeated rows
get their rows; other columns are ignored (``identified`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import documents, mapped

DIMENSIONS = 4096
SAMPLE, TOTAL = 500, 8000
PENALTY, STEPS = 1e-4, 300
HELD_OUT = 2
#: Families of closely related languages; any other language is a family by itself.
FAMILIES = {
    "germanic": "de nl en af sv da no nb nn is",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr ne pa gu",
    "turkic": "tr az kk uz",
    "uralic": "fi et hu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_ROWS = 1000


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``DIMENSIONS`` for every text of at most ``_ROWS``."""
    n = len(at) - 1
    out = np.zeros(n * DIMENSIONS)
    row = np.repeat(np.arange(n) * DIMENSIONS, np.diff(at))
    b = _words.lower_ascii(data).astype(np.uint32)
    h = b * _MULTIPLIERS[0]
    for k in range(3):
        if k:
            h = h[:-1] * np.uint32(31) + b[k:] * _MULTIPLIERS[k]
        own = row[k:]
        inside = own == row[: len(own)]
        out += np.bincount((own + ((h >> np.uint32(9)) % np.uint32(DIMENSIONS)).astype(np.int64))[inside], minlength=len(out))
    x = np.sqrt(out.reshape(n, DIMENSIONS)).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-9)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias that separate y = 1 from y = -1; both sides weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v = w
    step = 1 / (2 * 2 + PENALTY)
    for t in range(STEPS):
        loss = np.maximum(0, 1 - y * (x @ v)) * share
        new = v - step * (-2 * (x.T @ (loss * y)) + PENALTY * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """Machines by pair: of families, and of languages within each family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, confidence) among names, by one machine per pair."""
        n, k = len(x), len(names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        wins, margin, against = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for i, j in combinations(range(k), 2):
            w = self.machines[names[i], names[j]]
            m = x @ w[:-1] + w[-1]
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            margin[:, i] += m
            margin[:, j] -= m
            against[:, i] = np.minimum(against[:, i], m)
            against[:, j] = np.minimum(against[:, j], -m)
        best = np.argmax(wins + np.tanh(margin / k) / 4, axis=1)
        least = against[np.arange(n), best]
        return best, 1 / (1 + np.exp(-4 * least))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, score = self._vote(x, self.families)
        out = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            own = np.flatnonzero(fam == f)
            if len(own):
                best, s = self._vote(x[own], self.languages[name])
                out[own] = np.array(self.languages[name], dtype=object)[best]
                score[own] = score[own] * s
        return out.tolist(), score


def train(x: np.ndarray, langs: list[str]) -> Model:
    model = Model()
    if len(langs) == 0:
        return model
    lang = np.array(langs)
    fam = np.array([family_of(v) for v in langs])
    model.families = sorted(set(fam.tolist()))
    for a, b in combinations(model.families, 2):
        own = (fam == a) | (fam == b)
        model.machines[a, b] = _fit(x[own], np.where(fam[own] == a, 1, -1).astype(np.float32))
    for f in model.families:
        names = model.languages[f] = sorted(set(lang[fam == f].tolist()))
        for a, b in combinations(names, 2):
            own = (lang == a) | (lang == b)
            model.machines[a, b] = _fit(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32))
    return model


def _parts(column: pa.Array):
    for i, j, data, at in _words.slices(column):
        for u in range(0, j - i, _ROWS):
            v = min(j - i, u + _ROWS)
            yield i + u, i + v, data[at[u] : at[v]], at[u : v + 1] - at[u]


def learn(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """A model from documents with a language, without those held out; see the module for the bound."""
    labelled = docs.select(F.col("doc_id").cast("string").alias("k"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(f"lang is not null and k is not null and crc32(cast(k as binary)) % 4 != {HELD_OUT}")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    each = max(1, min(sample, total // len(counts)))
    # hashes below a language's share: about ``each`` rows, wherever they lie
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).where("text is not null")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        langs, keys = batch.column("lang").to_pylist(), batch.column("k").to_pylist()
        letter = _letters(batch.column("text")).to_pylist()
        for i, j, data, at in _parts(batch.column("text")):
            x = features(data, at).astype(np.float16)
            own = [r for r in range(i, j) if letter[r]]
            yield {"k": [keys[r] for r in own], "lang": [langs[r] for r in own], "x": [x[r - i].tobytes() for r in own]}

    rows = sorted(map(tuple, mapped(chosen, run, "k string, lang string, x binary").collect()))
    x = np.array([np.frombuffer(r[2], np.float16) for r in rows], dtype=np.float32).reshape(len(rows), DIMENSIONS)
    return train(x, [r[1] for r in rows])


def _letters(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)


def _predicted(column: pa.Array, model: Model) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    letter = _letters(column).to_numpy(zero_copy_only=False)
    for i, j, data, at in _parts(column):
        if not model.families:
            yield i, j, ["und"] * (j - i), np.zeros(j - i)
            continue
        langs, score = model.predict(features(data, at))
        yield i, j, [v if ok else "und" for v, ok in zip(langs, letter[i:j].tolist(), strict=True)], np.where(letter[i:j], score, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights for each pair of languages
    held = F.coalesce(F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % 4 = {HELD_OUT}"), F.lit(False)).alias("held_out")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, j, langs, score in _predicted(batch.column("text"), shared.value):
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "held_out": batch.column("held_out").slice(i, j - i), "lang_pred": langs, "score": score}

    return mapped(documents(docs, held), run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all columns, that have a language with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, langs, score in _predicted(batch.column(text), shared.value):
                yield batch.slice(i, j - i).filter(pa.array([v != "und" and s >= least for v, s in zip(langs, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
