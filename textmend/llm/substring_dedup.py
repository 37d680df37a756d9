"""Substring dedup: words inside windows of words that occur more than once are removed.

A window is ``window`` consecutive words of one document; it is repeated when
the same word sequence starts anywhere else, in the same document too.  All
words under repeated windows go; windows are judged on the input.

How: (1) of the k-gram hashes in a window the least is its anchor; equal
windows have equal anchors, and about a tenth of the positions are anchors, so
anchors are counted over all documents first; (2) windows whose anchor occurs
twice are hashed (64 bits) and counted over all documents; (3) each file of
documents gets back which of its windows occur twice, and drops what they
cover.  Every count is combined per file before it is sent, so a passage that
a third of all documents share costs one value per file.

``SuffixAutomaton`` and ``remove_passages`` are the form with broadcast automata:
a reference of bounded size in shards, against which documents are streamed
for matching statistics.  The README tells why the corpus itself, whose size
has no bound, isn't such a reference.

Cases: a null text has no words; an empty one none; repeated rows repeat each
other's windows; other columns are ignored by ``repeats`` and kept by
``without_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks, _words
from ._common import NO_ID, documents, mapped

WINDOW, GRAM = 35, 16
#: Words of a reference that are broadcast at once, and characters of a reference at most.
SHARD_WORDS, REFERENCE_BYTES = 200_000, 64_000_000


def _slide(values: np.ndarray, n: int, fn) -> np.ndarray:
    """fn over every run of n values, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = fn(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchored:
    """Words of some rows; windows that lie in one row, each with its anchor's hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.words = w = _words.Words(data, at)
        total = len(w.start)
        self.window = window
        n = window - gram + 1
        ok = np.zeros(total + 1, dtype=bool)
        long = w.count >= window
        if total < window or not long.any():
            self.start, self.anchor, self.grams = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        delta = np.zeros(total + 1, np.int8)
        delta[w.first[:-1][long]] += 1
        np.subtract.at(delta, w.first[1:][long] - window + 1, 1)
        ok = np.cumsum(delta[:total], dtype=np.int8) > 0
        self.prefix = _words.prefix_hash(w.hash)
        g = np.arange(total - gram + 1)
        self.grams = _words.span_hash(self.prefix, g, g + gram)
        least = _slide(self.grams, n, np.minimum)
        self.start = np.flatnonzero(ok[: len(least)])
        self.anchor = least[self.start]
        self.n = n

    def anchors(self) -> np.ndarray:
        """Hash of every position that is the anchor of a window of its row."""
        if len(self.start) == 0:
            return np.zeros(0, np.uint64)
        value = np.zeros(len(self.grams) + self.n - 1, np.uint64)
        value[self.start + self.n - 1] = self.anchor
        # a position is an anchor if the greatest of the minima over it is its own hash
        most = _slide(value, self.n, np.maximum)
        return self.grams[most == self.grams]

    def hashes(self, start: np.ndarray) -> np.ndarray:
        return _words.span_hash(self.prefix, start, start + self.window)


def _flags(runs: np.ndarray, known: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Whether each value, looked up among the known ones, occurs twice; runs of equal values are looked up once."""
    if len(runs) == 0:
        return np.zeros(0, dtype=bool)
    new = np.ones(len(runs), dtype=bool)
    new[1:] = runs[1:] != runs[:-1]
    begin = np.flatnonzero(new)
    found = twice[np.searchsorted(known, runs[begin])]
    return np.repeat(found, np.diff(np.append(begin, len(runs))))


def _store(docs: DataFrame, keep_rows: bool) -> tuple[DataFrame, int, int]:
    """Files of documents with their distinct anchors; the manifest, the number of files and of anchors."""
    text = docs.columns.index("text")

    def chunk(batches: list[pa.RecordBatch]) -> tuple[dict, int]:
        found = []
        texts = pa.concat_arrays([_words.texts_of(b.column(text)) for b in batches])
        for _, _, data, at in _words.slices(texts):
            found.append(Anchored(data, at).anchors())
        v, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        data, at = _words.raw(texts)
        out = {"text": data, "at": at, "v": v, "c": np.minimum(c, 255).astype(np.uint8)}
        if keep_rows:
            rest = pa.Table.from_batches(batches).drop_columns(["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            out["rest"] = np.frombuffer(sink.getvalue(), np.uint8)
            out["null"] = np.concatenate([b.column(text).is_null().to_numpy(zero_copy_only=False) for b in batches])
        else:
            out["doc_id"] = np.concatenate([_chunks.ids_of(b.column("doc_id")) for b in batches])
        return out, len(v)

    manifest = _chunks.write(docs, chunk, "substrings")
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    return manifest, files, total


def _slices(f: dict):
    column = pa.LargeStringArray.from_buffers(len(f["at"]) - 1, pa.py_buffer(f["at"].tobytes()), pa.py_buffer(f["text"]))
    return _words.slices(column)


def _resolved(docs: DataFrame, keep_rows: bool, fn, schema: str, window: int) -> DataFrame:
    manifest, files, total = _store(docs, keep_rows)
    spark = docs.sparkSession
    parts = _chunks.parts_for(spark, 2 * total)

    def anchors(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        yield _chunks.value_blobs(file, f["v"], f["c"], parts, 64)

    def candidates(f: dict, twice: np.ndarray):
        """(first row, end row, words, starts of windows whose anchor occurs twice, their hashes) by slice."""
        for i, j, data, at in _slices(f):
            a = Anchored(data, at, window)
            start = a.start[_flags(a.anchor, f["v"], twice)]
            yield i, j, a, start, a.hashes(start) if len(start) else np.zeros(0, np.uint64)

    def windows(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        twice = _chunks.levels(blobs) > 0
        bits = np.packbits(twice)
        found = [h for *_, h in candidates(f, twice)]
        v, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        out = _chunks.value_blobs(file, v, c, parts, 64)
        # what the file's last task needs besides the counts goes to it directly
        yield {k: list(out[k]) + [e] for k, e in (("part", parts + (file >> 12) % parts), ("file", file), ("data", _chunks.pack(bits=bits, v=_chunks.deltas(v))))}

    schema_blob = _chunks.BLOB
    seen = _chunks.tally(_chunks.by_file(manifest, files, None, anchors, schema_blob), parts)
    found = _chunks.by_file(manifest, files, seen, windows, schema_blob)

    def last(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        own = _chunks.unpack(blobs.pop(parts))
        twice = np.unpackbits(own["bits"])[: len(f["v"])].astype(bool)
        v, again = _chunks.undeltas(own["v"]), _chunks.levels(blobs) > 0
        for i, j, a, start, h in candidates(f, twice):
            hit = start[again[np.searchsorted(v, h)]] if len(start) else start
            delta = np.zeros(len(a.words.start) + 1, np.int32)
            delta[hit] += 1
            np.subtract.at(delta, hit + window, 1)
            yield from fn(f, i, j, a.words, np.cumsum(delta[:-1]) > 0)

    return _chunks.by_file(manifest, files, _tally_and_pass(found, parts), last, schema)


def _tally_and_pass(blobs: DataFrame, parts: int) -> DataFrame:
    """As ``_chunks.tally``, and the blobs of as many parts beyond them as they are: one shuffle for both."""

    def fn(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
        return _pass(parts, files, data) if part >= parts else _chunks.counted(part, files, data)

    return _chunks.by_part(blobs, 2 * parts, fn, _chunks.INFO)


def _pass(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
    n = len(files)
    yield {"file": files, "part": [part] * n, "data": [_chunks.pack(**d) for d in data], "x": [None] * n, "y": [None] * n}


def _join(words: _words.Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all rows, each followed by one space, and where each row begins."""
    start, end = words.start[kept], words.end[kept]
    size = end - start + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    source = np.arange(total) + np.repeat(start - (stop - size), size)
    out = np.append(words.data, 32).astype(np.uint8)[source]
    out[stop - 1] = 32
    count = np.bincount(words.row[kept], minlength=len(words.count))
    return out.tobytes(), np.append(0, stop)[np.append(0, np.cumsum(count))]


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row."""

    def out(f: dict, i: int, j: int, words: _words.Words, gone: np.ndarray) -> Iterator[dict]:
        text, at = _join(words, ~gone)
        view = memoryview(text)
        ids = f["doc_id"][i:j]
        yield {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "n_words": words.count.astype(np.int64),
            "n_removed": np.bincount(words.row[gone], minlength=j - i).astype(np.int64),
            "kept_sha256": [hashlib.sha256(view[b : max(b, e - 1)]).hexdigest() for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
        }

    return _resolved(documents(docs), False, out, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the removed words, and the white space after each, cut out of ``text``; other rows unchanged."""
    names = docs.columns
    rest = [c for c in names if c != "text"]

    def out(f: dict, i: int, j: int, words: _words.Words, gone: np.ndarray) -> Iterator[dict]:
        data, at = words.data, words.at
        nxt = np.append(words.start[1:], len(data))
        stop = np.minimum(nxt, at[words.row + 1])
        delta = np.zeros(len(data) + 1, np.int32)
        np.add.at(delta, words.start[gone], 1)
        np.subtract.at(delta, stop[gone], 1)
        keep = np.cumsum(delta[:-1]) == 0
        size = np.append(0, np.cumsum(keep))[at]
        texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(size.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())
        null = f["null"][i:j]
        if null.any():
            texts = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), texts)
        if "table" not in f:
            with pa.ipc.open_stream(pa.py_buffer(f["rest"])) as r:
                f["table"] = r.read_all().combine_chunks()
        own = f["table"].slice(i, j - i)
        yield {"text": texts} | {c: own.column(c).combine_chunks() for c in rest}

    return _resolved(docs, True, out, docs.schema, window)


class SuffixAutomaton:
    """Of a sequence of words: states with transitions, link and length; a separator word keeps passages apart."""

    def __init__(self, passages: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for passage in passages:
            last = 0
            for word in passage:
                last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        link[q] = c
        return c

    def matching(self, words: list) -> list[int]:
        """For every word, how many words ending there occur in a row in one passage."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                n = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def _shards(reference: list[str], shard_words: int) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in reference:
        words = split(text)
        if held and n + len(words) > shard_words:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def split(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = _words.Words(data, np.array([0, len(data)]), hashes=False)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def remove_passages(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text without maximal spans of ``window`` or more words that lie in one text of ``reference``, n_removed.

    The reference's texts are broadcast, and refused above ``REFERENCE_BYTES``; each task builds the automaton of a
    shard, streams its documents' matching statistics, and goes on to the next.  Kept words are joined by one space.
    """
    spark = docs.sparkSession
    size = reference.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > REFERENCE_BYTES:
        raise ValueError(f"the reference has {size} bytes; {REFERENCE_BYTES} can be broadcast: use repeats over the union")
    texts = spark.sparkContext.broadcast([r[0] for r in reference.where("text is not null").select("text").distinct().collect()])
    built: list[SuffixAutomaton] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not built:
            built.extend(SuffixAutomaton(s) for s in _shards(texts.value, shard_words))
        rows = [split(t) for t in batch.column("text").to_pylist()]
        out, removed = [], []
        for words in rows:
            gone = np.zeros(len(words) + 1, np.int32)
            for automaton in built:
                for i, n in enumerate(automaton.matching(words)):
                    if n >= window:
                        gone[i - n + 1] += 1
                        gone[i + 1] -= 1
            mask = np.cumsum(gone[:-1]) > 0
            out.append(b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m).decode())
            removed.append(int(mask.sum()))
        yield {"doc_id": batch.column("doc_id"), "text": out, "n_removed": removed}

    return mapped(documents(docs), run, "doc_id long, text string, n_removed long")
