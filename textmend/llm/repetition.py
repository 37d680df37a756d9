"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

Rolling hashes (64-bit, read off prefix sums in numpy) of every n-gram of words
of several lengths find what a text repeats of itself; the words that repeated
n-grams cover, and the words of repeated lines, are counted in characters.

A text fails the base rule with fewer than 20 words, or when words in repeated
8-word windows are more than 30 % of its words.  It is kept when it passes the
base rule and the repeated lines, and the repeated n-grams of every length,
hold no more than their share of its characters.

Cases: a null text has no words and fails; so does an empty one; repeated rows
each get their own row; other columns are ignored (``kept_documents`` keeps them).
Lines are split at ``\\n``; lines without a word never count.  Nothing is
compared across documents, so there is no shuffle and no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words
from ._common import documents, mapped

MIN_WORDS, BASE_N, BASE_PERCENT = 20, 8, 30
#: Most percent of a text's characters in repeated n-grams (the first included), by n, and in repeated lines.
NGRAMS, LINE_PERCENT = {5: 40, 10: 30, 16: 25}, 30
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _by_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        return np.zeros(len(keys), dtype=bool)
    i = np.searchsorted(twice, keys)
    i[i == len(twice)] = 0
    return twice[i] == keys


def covered(words: _words.Words, n: int) -> np.ndarray:
    """Mask of the words inside n-word windows found twice or more in their own row."""
    h, start = _words.windows(words.hash, words.first, n)
    with np.errstate(over="ignore"):
        key = _words.mix(h + words.row[start].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    twice = start[repeated(key)]
    delta = np.zeros(len(words.start) + 1, dtype=np.int32)
    delta[twice] += 1
    np.subtract.at(delta, twice + n, 1)
    return np.cumsum(delta[:-1]) > 0


def measures(data: np.ndarray, at: np.ndarray, ngrams: dict[int, int] = NGRAMS, line_percent: int = LINE_PERCENT) -> dict[str, np.ndarray]:
    """All columns but doc_id for the rows whose bytes are ``data[at[i]:at[i + 1]]``."""
    w = _words.Words(data, at)
    rows = len(at) - 1
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_START[data] & w.inside, out=chars[1:])
    word_chars = chars[at[1:]] - chars[at[:-1]]
    out = {"n_words": w.count.astype(np.int64), "word_chars": word_chars, "n_symbols": _by_row(_SYMBOL[data], at)}

    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], breaks + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(at, begin, side="right") - 1
    # a line ends at its \n or with its row
    stop = np.append(breaks, len(data))[np.searchsorted(breaks, begin)]
    stop = np.minimum(stop, at[row + 1])
    line_chars = chars[stop] - chars[begin]
    has = line_chars > 0
    begin, stop, row, line_chars = begin[has], stop[has], row[has], line_chars[has]
    with np.errstate(over="ignore"):
        key = _words.mix(_words.span_hash(w.prefix, begin, stop) + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(row[again], minlength=rows).astype(np.int64)
    out["n_repeat_words"] = np.bincount(w.row[covered(w, BASE_N)], minlength=rows).astype(np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    out["dup_line_chars"] = np.bincount(row[again], weights=line_chars[again], minlength=rows).astype(np.int64)
    kept = ~out["base_failed"] & (100 * out["dup_line_chars"] <= line_percent * word_chars)
    each = chars[w.end] - chars[w.start]
    for n, most in ngrams.items():
        c = covered(w, n)
        dup = np.bincount(w.row[c], weights=each[c], minlength=rows).astype(np.int64)
        out[f"dup_chars_{n}"] = dup
        kept &= 100 * dup <= most * word_chars
    out["kept"] = kept
    return out


def quality(docs: DataFrame, ngrams: dict[int, int] = NGRAMS, line_percent: int = LINE_PERCENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the coverage columns."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long" + "".join(f", dup_chars_{n} long" for n in ngrams)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, j, data, at in _words.slices(batch.column("text")):
            yield {"doc_id": batch.column("doc_id").slice(i, j - i)} | measures(data, at, ngrams, line_percent)

    return mapped(documents(docs), run, schema)


def kept_documents(docs: DataFrame, ngrams: dict[int, int] = NGRAMS, line_percent: int = LINE_PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in _words.slices(batch.column(text)):
                yield batch.slice(i, j - i).filter(pa.array(measures(data, at, ngrams, line_percent)["kept"]))

    return docs.mapInArrow(run, docs.schema)
