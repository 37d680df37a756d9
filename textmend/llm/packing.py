"""Packing token pieces into sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids (end id included) are cut into full pieces of the sequence
length and one remainder.  Full pieces are sequences by themselves.  Remainders
go to groups by a hash, and each group is packed alone: pieces by decreasing
length, each into the first bin that still has room, which a tournament tree
over the bins' free space finds in logarithmic time.  What first-fit leaves
free is filled by cutting the pieces of the emptiest bins, so that a group ends
with at most one sequence that is not full.  Sequences are padded to the
length, except at a power of two, which is a length of its own.

Cases: a null text is an empty one (the end id alone); repeated rows and ids
are packed each; an empty table gives no piece; other columns are ignored.

Rows that are the same go to a group for each partition that they come from, so no
group is hot.

Scale: one shuffle, of the remainders' ids (less than a sequence for each
document) and of a row for each full piece.  Groups are runs of at most
``group`` pieces of a partition in hash order, so their memory is bounded
whatever the keys are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._common import arrow_schema, documents, partitions, record, trim

LENGTH = 1024
#: Pieces that are packed together.
GROUP = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class TournamentTree:
    """Bins by index with the largest free space of every subtree, to find the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """The lowest bin with ``need`` free, or -1."""
        free, i = self.free, 1
        if free[1] < need:
            return -1
        while i < self.size:
            i *= 2
            if free[i] < need:
                i += 1
        return i - self.size

    def take(self, b: int, amount: int) -> None:
        free, i = self.free, b + self.size
        free[i] -= amount
        i //= 2
        while i:
            m = max(free[2 * i], free[2 * i + 1])
            if free[i] == m:
                break
            free[i] = m
            i //= 2


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree = TournamentTree(len(lengths), capacity)
    bins: list[list[int]] = []
    for i in order:
        b = tree.first(lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        tree.take(b, lengths[i])
    return bins


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, begin, end): first-fit decreasing, then gaps filled by cutting the emptiest bins' pieces."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
    fill = [sum(e - s for _, s, e in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        a, z = order[lo], order[hi]
        room = capacity - fill[a]
        if room == 0:
            lo += 1
            continue
        i, s, e = bins[z].pop()
        n = min(room, e - s)
        bins[a].append((i, s, s + n))
        if s + n < e:
            bins[z].append((i, s + n, e))
        fill[a] += n
        fill[z] -= n
        if fill[z] == 0:
            hi -= 1
    return [bins[b] for b in order if fill[b]]


def padding(fill: int, length: int = LENGTH) -> int:
    """Pad ids of a sequence with ``fill`` ids."""
    return 0 if fill & (fill - 1) == 0 else length - fill


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, group: int = GROUP, seed: int = 7, with_ids: bool = True, kept_words: int = _bpe.KEPT_WORDS) -> DataFrame:
    """A row per piece (a process keeps the ids of at most ``kept_words`` segments of texts): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, its ids."""
    parts = partitions(docs.sparkSession)
    docs = documents(docs).select("doc_id", "text", F.xxhash64("doc_id", F.crc32("text"), F.spark_partition_id(), F.lit(seed)).alias("h"))
    cut = "h long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    cut_schema = arrow_schema(cut)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _bpe.encoder(tokenizer, kept_words)
        w = e.dtype.itemsize
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            hashes, doc_ids = b.column("h").to_pylist(), b.column("doc_id").to_pylist()
            for first, texts in _bpe.groups([t or "" for t in b.column("text").to_pylist()]):
                out: dict = {f.name: [] for f in cut_schema}
                add = [out[f.name].append for f in cut_schema]
                for k, ids in enumerate(e.encode(texts), first):
                    ids += end
                    n = len(ids) // w
                    for s in range(0, n, length):
                        piece = ids[s * w : (s + length) * w]
                        m = len(piece) // w
                        full = m == length
                        row = (hashes[k], doc_ids[k], s, m, n, zlib.crc32(np.frombuffer(piece, e.dtype).astype("<u4").tobytes()) if full else None, piece if with_ids or not full else None)
                        for f, x in zip(add, row, strict=True):
                            f(x)
                yield record(out, cut_schema)
        trim()

    ddl = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    schema = arrow_schema(ddl)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _bpe.encoder(tokenizer, kept_words).dtype
        w, next_id, waiting = dtype.itemsize, None, []

        def packed() -> dict:
            nonlocal next_id
            out: dict = {f.name: [] for f in schema}
            for seq in pack([r[2] for r in waiting], length):
                offset = 0
                for i, s, e in seq:
                    doc_id, start, _, total, ids = waiting[i]
                    piece = ids[s * w : e * w]
                    emit(out, (doc_id, start + s, e - s, zlib.crc32(np.frombuffer(piece, dtype).astype("<u4").tobytes()), total, next_id, offset, piece))
                    offset += e - s
                next_id += 1
            waiting.clear()
            return out

        def emit(out: dict, row: tuple) -> None:
            for f, x in zip(schema, row, strict=False):
                out[f.name].append(x)

        for b in batches:
            if b.num_rows and next_id is None:
                next_id = b.column("p")[0].as_py() << 40
            c = b.to_pydict()
            out: dict = {f.name: [] for f in schema}
            for doc_id, start, m, total, crc, ids in zip(c["doc_id"], c["start"], c["length"], c["doc_tokens"], c["crc"], c["ids"], strict=True):
                if crc is not None:
                    emit(out, (doc_id, start, m, crc, total, next_id, 0, ids))
                    next_id += 1
                else:
                    waiting.append((doc_id, start, m, total, ids))
                    if len(waiting) == group:
                        yield record(packed(), schema)
            yield record(out, schema)
        if waiting:
            yield record(packed(), schema)
        trim()

    spread = docs.mapInArrow(pieces, cut).withColumn("p", F.pmod("h", F.lit(parts)).cast("int"))
    # ties of the order are rows that are the same, so that a repeated attempt packs alike
    return spread.repartitionById(parts, F.col("p")).sortWithinPartitions("h", "doc_id", "start", "ids").mapInArrow(fill, ddl)
