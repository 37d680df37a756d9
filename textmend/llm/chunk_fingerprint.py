"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; its low bits choose boundaries, with
normalised chunking: after ``LEAST`` bytes a boundary needs ``STRICT`` zero
bits, from ``NORMAL`` bytes on only ``LOOSE``, and ``MOST`` bytes end a chunk
anyway.  Boundaries depend on the bytes around them, so an insertion or a cut
moves only the chunks it touches.  A fingerprint is the set of chunk digests
(40 bits) with their lengths in bytes as weights.  The likeness of two
fingerprints is containment: the weight they share over the smaller weight.

Fingerprints are strings: base64 of 9-byte entries (digest 5, weight 4) in
ascending order, a repeated chunk with the bytes of all its occurrences: no text of Spark has 4 GB.
An empty text has the empty fingerprint; two empty ones have likeness 1, an
empty and another 0.  Null texts are empty.  Equal texts have equal fingerprints.

``with_successors`` pairs each document with the next by ``doc_id`` without a
global sort in one task: ranges of ids are found from the id column alone, the
first document of each range is also sent to the range before it, and each
range streams in order with one document of memory.  Null ids come first, rows
that repeat an id are ordered by a hash of their text.  Texts cross the network
once, compressed; only needed columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import NO_ID, arrow_schema, documents, mapped, record, shard_of, shards

LEAST, NORMAL, MOST = 16, 48, 256
STRICT, LOOSE = np.uint32((1 << 6) - 1), np.uint32((1 << 4) - 1)
#: Documents of a range.
RANGE_DOCUMENTS = 4_000
_GEAR = np.random.default_rng(0xC4A2).integers(0, 2**32, 256, dtype=np.uint32)
DIGEST, WEIGHT = 5, 4
ENTRY = DIGEST + WEIGHT


def gear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash after every byte, of the up to 16 bytes before it in its row, in its top bits."""
    h = _GEAR[data]
    # each doubling adds the window before; a byte 32 places back has been shifted out
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    # the first bytes of a row would see the row before
    begin = at[:-1][np.diff(at) > 0]
    ends = at[1:][np.diff(at) > 0]
    short = begin > 0
    for b, e in zip(begin[short].tolist(), ends[short].tolist(), strict=True):
        g = _GEAR[data[b : min(e, b + 15)]].copy()
        for k in (1, 2, 4, 8):
            g[k:] += g[:-k] << np.uint32(k)
        h[b : b + len(g)] = g
    return h


def boundaries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and for each row the number of chunks."""
    h = gear(data, at) >> np.uint32(16)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    where = (loose + 1).tolist()
    first = np.searchsorted(loose, at).tolist()
    ends: list[int] = []
    add = ends.append
    counts = []
    for r, (b, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        had = len(ends)
        for k in range(first[r], first[r + 1]):
            p = where[k]
            n = p - b
            while n > MOST:
                b += MOST
                add(b)
                n = p - b
            if n >= NORMAL or n >= LEAST and strict[k]:
                b = p
                add(p)
        while e - b > MOST:
            b += MOST
            add(b)
        if b < e:
            add(e)
        counts.append(len(ends) - had)
    return np.array(ends, dtype=np.int64), np.array(counts, dtype=np.int64)


def entries(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the digests of its distinct chunks, ascending, and their weights: two columns."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _words.SLICE_BYTES):
            size += len(texts[j])
            j += 1
        out += _entries(texts[i:j])
        i = j
    return out


def _entries(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    if len(data) == 0:
        return [np.zeros((0, 2), np.uint64) for _ in texts]
    ends, counts = boundaries(data, at)
    starts = np.append(0, ends[:-1])
    digest = _words.span_hash(_words.prefix_hash(_words._TABLE[data]), starts, ends) >> np.uint64(24)
    row = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((digest, row))
    digest, row, length = digest[order], row[order], (ends - starts)[order]
    new = np.ones(len(digest), dtype=bool)
    new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    value = np.stack([digest[begin], np.add.reduceat(length, begin).astype(np.uint64)], axis=1)
    return np.split(value, np.searchsorted(row[begin], np.arange(1, len(texts))))


def encode(values: np.ndarray) -> str:
    raw = np.ascontiguousarray(values).astype(">u8").view(np.uint8).reshape(-1, 2, 8)
    return base64.b64encode(np.concatenate([raw[:, 0, 8 - DIGEST :], raw[:, 1, 8 - WEIGHT :]], axis=1).tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, ENTRY)
    full = np.zeros((len(raw), 2, 8), np.uint8)
    full[:, 0, 8 - DIGEST :], full[:, 1, 8 - WEIGHT :] = raw[:, :DIGEST], raw[:, DIGEST:]
    return full.view(">u8").astype(np.uint64).reshape(-1, 2)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Shared weight over the smaller weight; the smaller weight counts for a chunk that both have."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    digest, weight = np.concatenate([a, b]).T
    order = np.argsort(digest, kind="stable")
    digest, weight = digest[order], weight[order]
    same = digest[1:] == digest[:-1]
    shared = int(np.minimum(weight[1:], weight[:-1])[same].sum())
    return shared / min(int(a[:, 1].sum()), int(b[:, 1].sum()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "fingerprint": [encode(v) for v in entries(texts)]}

    return mapped(documents(docs), run, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame, fn, schema: str, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """``fn(ids, texts, next_texts) -> columns`` over all documents, each with the text of the next by id; the last's is the first."""
    docs = documents(docs)
    bounds = shards(docs, range_documents)
    key = F.coalesce("doc_id", F.lit(NO_ID))
    shard = shard_of(key, bounds)
    # the least id of each range: one row per range
    heads = dict(docs.select(key.alias("k"), shard.alias("s")).groupBy("s").agg(F.min("k")).collect())
    used = sorted(heads)
    before = {heads[s]: used[i - 1] for i, s in enumerate(used)}
    if not used:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = docs.sparkSession.sparkContext.broadcast(before)  # one entry per range
    arrow = arrow_schema(schema)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids, tie = b.column("k").to_pylist(), b.column("tie").to_pylist()
            rows: list = []
            for k, t, s, text in zip(ids, tie, b.column("s").to_pylist(), b.column("text").to_pylist(), strict=True):
                z = compress((text or "").encode())
                rows.append((s, False, k, t, z))
                if k in ranges.value:
                    rows.append((ranges.value[k], True, k, t, z))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["s", "guest", "k", "tie", "z"]) if rows else pa.RecordBatch.from_pydict({"s": pa.array([], pa.int32()), "guest": pa.array([], pa.bool_()), "k": pa.array([], pa.int64()), "tie": pa.array([], pa.int64()), "z": pa.array([], pa.binary())})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int, str]] = []
        size, over = 0, False

        def out(last: list[str]) -> pa.RecordBatch:
            texts = [t for _, t in held]
            n = len(texts) - 1 + len(last)
            return record(fn([None if k == NO_ID else k for k, _ in held[:n]], texts[:n], (texts + last)[1 : n + 1]), arrow)

        for b in batches:
            for guest, k, z in zip(*(b.column(c).to_pylist() for c in ("guest", "k", "z")), strict=True):
                if over:
                    continue
                held.append((k, expand(z).decode()))
                size += len(held[-1][1])
                over = guest
                if size > 1_000_000 and len(held) > 1 or over:
                    yield out([])
                    held, size = held[-1:], len(held[-1][1])
    moved = docs.select(key.alias("k"), F.xxhash64("text").alias("tie"), shard.alias("s"), "text").mapInArrow(squeeze, "s int, guest boolean, k long, tie long, z binary")
    return moved.repartitionById(len(bounds) + 1, F.col("s")).sortWithinPartitions("guest", "k", "tie", "z").mapInArrow(stream, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def edit_probe(docs: DataFrame, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document."""

    def run(ids: list, texts: list[str], following: list[str]) -> dict:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        raw = [t.encode() for t in texts]
        own = entries([*raw, following[-1].encode()])
        edits = entries(e := [c.encode() for c in changed])
        return {
            "doc_id": ids,
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in e],
            "fingerprint": [encode(v) for v in own[:-1]],
            "edited_fingerprint": [encode(v) for v in edits],
            "near_edited": [containment(a, b) for a, b in zip(own, edits, strict=False)],
            "near_next": [containment(a, b) for a, b in zip(own, own[1:], strict=False)],
        }

    return with_successors(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", range_documents)
