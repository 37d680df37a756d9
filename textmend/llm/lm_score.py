"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every word is predicted from ``SIDE`` words on its left and right, never from
itself; the document's score is the sum of the conditional log-probabilities.

Vocabulary: the ``KNOWN`` most frequent words of the whole corpus, and
``BUCKETS`` hash buckets for all others.  The network has an embedding for every
id, one hidden layer, and a factored softmax: a word's class first, then the word within
the class, given the class; both are normalised, so probabilities are exact.
A word of a bucket is charged one level more, its share of the bucket's words.  The
counts for that are of all documents that are scored and of every word: files of
scored documents send their distinct bucket words to ranges of hash values, which
send back how often each occurs in all files, so this table grows with the input and no task holds it.
The network itself, and its ``KNOWN`` words, do not grow.

Training covers every word of every document once: each task trains on its own
rows from the same start (fitted on ``WARM`` documents chosen by hash) and
the tasks' networks are averaged by their numbers of words, block by block in
parallel, so neither the driver nor a task gathers more than one network's size.

Cases: a null or empty text has no words and score 0; repeated rows get the
same score; ``per_word`` is null without words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks, _words
from ._common import NO_ID, arrow_schema, documents, record

KNOWN, BUCKETS, CLASS = 3840, 256, 64
SIDE, WIDTH, HIDDEN = 2, 8, 32
BATCH, RATE = 1024, 0.05
#: Documents of the first fit, and how much of each is read for it.
WARM, WARM_CHARS = 256, 20_000
BLOCKS = 16
_IDS = KNOWN + BUCKETS
_SHAPES = {"e": (_IDS + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "u": (HIDDEN, CLASS), "p": (CLASS,), "c": (CLASS, HIDDEN), "v": (HIDDEN, CLASS), "q": (CLASS,)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one network's arrays."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start() -> np.ndarray:
    rng = np.random.default_rng(5)
    flat = np.zeros(_SIZE, np.float32)
    for name, a in split(flat).items():
        if a.ndim == 2:
            a[:] = rng.normal(0, 0.3 if name == "e" else a.shape[0] ** -0.5, a.shape)
    return flat


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """``hashes`` of the known words, the most frequent first."""
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = (KNOWN + (h % np.uint64(BUCKETS))).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            known = self.sorted[at] == h
            out[known] = self.order[at[known]]
        return out


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ids left and right of every word; ``_IDS`` beyond its document."""
    out = np.full((len(ids), 2 * SIDE), _IDS)
    for k in range(1, SIDE + 1):
        same = row[k:] == row[:-k]
        out[k:, k - 1] = np.where(same, ids[:-k], _IDS)
        out[:-k, SIDE + k - 1] = np.where(same, ids[k:], _IDS)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def forward(m: dict, ctx: np.ndarray, ids: np.ndarray) -> tuple:
    n = len(ids)
    x = m["e"][ctx].reshape(n, -1)
    h = np.tanh(x @ m["w"] + m["b"])
    hi, lo = ids // CLASS, ids % CLASS
    first = _softmax(h @ m["u"] + m["p"])
    g = h + m["c"][hi]
    second = _softmax(g @ m["v"] + m["q"])
    return x, h, g, hi, lo, first, second


def log_probability(m: dict, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    *_, hi, lo, first, second = forward(m, ctx, ids)
    r = np.arange(len(ids))
    return np.log(np.maximum(first[r, hi], 1e-30)).astype(np.float64) + np.log(np.maximum(second[r, lo], 1e-30))


def _by_id(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(ids, values[:, k], n) for k in range(values.shape[1])], axis=1)


def gradient(flat: np.ndarray, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability of ``ids``."""
    m, n = split(flat), len(ids)
    x, h, g, hi, lo, d1, d2 = forward(m, ctx, ids)
    r = np.arange(n)
    d1[r, hi] -= 1
    d2[r, lo] -= 1
    grad = np.empty(_SIZE, flat.dtype)
    o = split(grad)
    dg = d2 @ m["v"].T
    dh = (d1 @ m["u"].T + dg) * (1 - h * h)
    o["v"][:], o["q"][:] = g.T @ d2, d2.sum(0)
    o["u"][:], o["p"][:] = h.T @ d1, d1.sum(0)
    o["c"][:] = _by_id(hi, dg, CLASS)
    o["w"][:], o["b"][:] = x.T @ dh, dh.sum(0)
    dx = (dh @ m["w"].T).reshape(-1, WIDTH)
    o["e"][:] = _by_id(ctx.ravel(), dx, _IDS + 1)
    grad /= n
    return grad


class Trainer:
    """Adagrad over batches of words."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.square = np.full(_SIZE, 1e-7, np.float32)
        self.words = 0

    def step(self, ctx: np.ndarray, ids: np.ndarray) -> None:
        grad = gradient(self.flat, ctx, ids)
        self.square += grad * grad
        self.flat -= RATE * grad / np.sqrt(self.square)
        self.words += len(ids)

    def train(self, ctx: np.ndarray, ids: np.ndarray) -> None:
        for i in range(0, len(ids), BATCH):
            self.step(ctx[i : i + BATCH], ids[i : i + BATCH])


def _coded(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple]:
    for i, j, data, at in _words.slices(column):
        w = _words.Words(data, at)
        ids = vocabulary.ids(w.hash)
        yield i, j, w, ids, contexts(ids, w.row)


def learn_vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of all documents; counted per task before they are shuffled."""

    schema = arrow_schema("h long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return record({"h": v.view(np.int64), "n": c.astype(np.int64)}, schema)

        for b in batches:
            for _, _, data, at in _words.slices(b.column("text")):
                held.append(_words.Words(data, at).hash)
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    top = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(KNOWN)
    return np.array([r[0] for r in top.collect()], dtype=np.int64).view(np.uint64)


def train(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """One network, the average of what all tasks learn from their rows."""
    spark, vocabulary = docs.sparkSession, Vocabulary(hashes)
    own = docs.where("text is not null").select("text", F.xxhash64("doc_id", F.crc32("text"), F.lit(17)).alias("h"))
    # hashes only are ordered; then the beginnings of that many texts are read
    last = own.select("h").orderBy("h").limit(WARM).agg(F.max("h")).first()[0]
    warm = [r[0] for r in own.where(F.col("h") <= F.lit(last)).select(F.substring("text", 1, WARM_CHARS)).limit(WARM).collect()] if last is not None else []
    first = Trainer(start())
    for *_, ids, ctx in _coded(pa.array(sorted(warm), pa.string()), vocabulary):
        first.train(ctx, ids)
    shared = spark.sparkContext.broadcast((first.flat, hashes))  # one network's size
    schema = arrow_schema("block int, words long, data binary")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, known = shared.value
        t, v = Trainer(flat), Vocabulary(known)
        for b in batches:
            for *_, ids, ctx in _coded(b.column("text"), v):
                t.train(ctx, ids)
        if t.words:
            parts = np.array_split(t.flat, BLOCKS)
            yield record({"block": list(range(BLOCKS)), "words": [t.words] * BLOCKS, "data": [p.tobytes() for p in parts]}, schema)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, block = None, 0, 0
        for b in batches:
            for block, n, data in zip(*(b.column(c).to_pylist() for c in ("block", "words", "data")), strict=True):
                a = np.frombuffer(data, np.float32).astype(np.float64) * n
                total = a if total is None else total + a
                words += n
        if words:
            yield record({"block": [block], "words": [words], "data": [(total / words).astype(np.float32).tobytes()]}, schema)

    learned = docs.select("text").mapInArrow(local, "block int, words long, data binary").repartitionById(BLOCKS, F.col("block")).sortWithinPartitions("words", "data").mapInArrow(average, "block int, words long, data binary").collect()
    if not learned:
        return first.flat
    return np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(learned)])


def score(docs: DataFrame, hashes: np.ndarray | None = None, network: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, score (sum of log-probabilities), per_word of every row."""
    docs = documents(docs)
    if hashes is None:
        hashes = learn_vocabulary(docs)
    if network is None:
        network = train(docs, hashes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((network, hashes))

    def chunk(batches: list[pa.RecordBatch]) -> tuple[dict, int]:
        flat, known = shared.value
        m, v = split(flat), Vocabulary(known)
        n, total, row, rare = [], [], [], []
        for i, j, w, ids, ctx in _coded(pa.concat_arrays([_words.texts_of(b.column("text")) for b in batches]), v):
            logp = np.concatenate([log_probability(m, ctx[a : a + BATCH], ids[a : a + BATCH]) for a in range(0, len(ids), BATCH)]) if len(ids) else np.zeros(0)
            total.append(np.bincount(w.row, logp, j - i))
            n.append(w.count.astype(np.int64))
            row.append((w.row[ids >= KNOWN] + i).astype(np.uint32))
            rare.append(w.hash[ids >= KNOWN])
        h, which, count = np.unique(np.concatenate(rare), return_inverse=True, return_counts=True)
        doc_id = np.concatenate([_chunks.ids_of(b.column("doc_id")) for b in batches])
        return {"doc_id": doc_id, "n": np.concatenate(n), "score": np.concatenate(total), "row": np.concatenate(row), "which": which.astype(np.uint32), "h": h, "count": count.astype(np.uint32)}, len(h)

    manifest = _chunks.write(docs, chunk, "scores")
    files, distinct = manifest.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    parts = _chunks.parts_for(spark, distinct)

    def totals(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        yield {"bucket": list(range(BUCKETS)), "n": np.bincount((f["h"] % np.uint64(BUCKETS)).astype(np.int64), f["count"], BUCKETS).astype(np.int64)}

    of_bucket = np.ones(BUCKETS)
    for r in _chunks.by_file(manifest, files, None, totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        of_bucket[r.bucket] = max(r.n, 1)

    def listed(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        h, n, at = f["h"], f["count"], _chunks.cuts(f["h"], parts, 64)
        use = [p for p in range(parts) if at[p] < at[p + 1]]
        yield {"part": use, "file": [file] * len(use), "data": [_chunks.pack(v=_chunks.deltas(h[at[p] : at[p + 1]]), c=n[at[p] : at[p + 1]]) for p in use]}

    def summed(part, own, data) -> Iterator[dict]:
        values = [_chunks.undeltas(d["v"]) for d in data]
        _, which = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(which, np.concatenate([d["c"] for d in data]))[which].astype(np.uint64)
        at, k = np.cumsum([0, *map(len, values)]), len(own)
        yield {"file": own, "part": [part] * k, "data": [_chunks.pack(n=n[at[i] : at[i + 1]]) for i in range(k)], "x": [None] * k, "y": [None] * k}

    info = _chunks.by_part(_chunks.by_file(manifest, files, None, listed, _chunks.BLOB), parts, summed, _chunks.INFO)

    def put(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        n = np.concatenate([np.zeros(0, np.uint64), *(_chunks.unpack(blobs[p])["n"] for p in sorted(blobs))])
        within = np.log(n.astype(np.float64)) - np.log(of_bucket[(f["h"] % np.uint64(BUCKETS)).astype(np.int64)])
        d, words = f["doc_id"], f["n"]
        total = f["score"] + np.bincount(f["row"], within[f["which"]], len(d))
        yield {"doc_id": pa.array(d, mask=d == NO_ID), "n_words": words, "score": total, "per_word": pa.array(total / np.maximum(words, 1), mask=words == 0)}

    return _chunks.by_file(manifest, files, info, put, "doc_id long, n_words long, score double, per_word double")
