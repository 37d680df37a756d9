"""N-gram Jaccard join: documents whose sets of word shingles are at least ``percent`` % alike.

Words are lower-cased in A-Z; a document's set holds its distinct ``n``-word
shingles (48-bit hashes), of a shorter text the whole sequence, of an empty one
nothing.  Documents with equal sets are one class, and only one of them, its
representative, takes part in the search.

How: (1) sets are written to files, classes are formed by two 64-bit sums over
each set; (2) every shingle's document frequency, combined per file, is counted
over all representatives, in all and in the sets near enough in size (classes
of sizes a factor 1 / t apart, and their neighbours): a shingle that no other
such set has is never sent; (3) sets that agree on a band of least hashes are
one node: their links needn't be searched for, as they are brought together
anyway, and a cluster of near copies costs a list one entry and not a pair for
every two of its sets; (4) in the order of rising frequency the first
``n - ceil(t * n) + l`` shingles of a set are its prefix, where ``l`` is
``1 + n // EXTRA``: alike sets share ``l`` of them, so lists of the prefixes'
shingles by node, a length filter, and a count over all lists leave few
candidate links between nodes, and lose none: two nodes share all that two of
their sets do; (5) documents that candidate links connect are brought
together, and there a T-occurrence search with DivideSkip finds the sets that
reach the overlap: short inverted lists are merged and counted, the long ones
are only probed by binary search for what the short ones left; (6) links are
counted by class sizes and components follow from spanning links.

Groups are bounded: a connected group of more than ``BLOCK`` sets, or of more
than ``BLOCK_SHINGLES`` shingles, is searched in pairs of blocks, whose links
are counted set by set and never held; candidate links are sent on in pieces of
``HELD``.  All steps are exact; nothing is capped.

Cases: a null text is an empty one, linked with nothing and a component by
itself; repeated rows are one class and count each other; a null ``doc_id`` is
returned as null and is no component's least id unless it is alone; other
columns are ignored by ``similar`` and kept by ``one_of_each``; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks, _words
from ._common import NO_ID, documents, partitions, stored

PERCENT, SHINGLE = 60, 2
#: A prefix is longer by one shingle for so many of the set, and that many more must be shared.
EXTRA = 32
#: Sets, and their shingles, that are searched together.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Pairs of a list, and candidate links of a task, that are held at once.
PAIRS, HELD = 500_000, 1_500_000
#: Bands of so many least hashes (at most 64 hashes in all), and how many of a band's a set must have.
BANDS, BAND, LEAST = 8, 8, 4
#: DivideSkip's weight of merging against probing.
MU = 0.05
_SALT = np.uint64(0xA5A5_1234_9E37_79B9)


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of a set of n with any set alike: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def size_class(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Classes of sizes: alike sets are in the same or in neighbouring ones."""
    ratio = max(Fraction(100, percent), Fraction(3, 2))
    edges, edge = [], Fraction(1)
    while len(edges) < 32:
        edges.append(math.ceil(edge))
        edge *= ratio
    return np.searchsorted(np.array(edges), n, side="right").astype(np.uint64) - np.uint64(1)


def _keys(h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """43 bits of a shingle's hash and its set's size class: what frequencies are counted by."""
    return (h & ~np.uint64(31)) | cls


def _frequent(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
    """For each key, in its order: the binary logarithm of the shingle's frequency, plus 32 if a set of near size has it too."""
    values = [_chunks.undeltas(d["v"]) for d in data]
    every = np.concatenate(values)
    counts = np.concatenate([d["c"] for d in data]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    key, own = s[begin], np.add.reduceat(counts[order], begin)
    shingle, cls = key >> np.uint64(5), (key & np.uint64(31)).astype(np.int64)
    first = np.ones(len(key), dtype=bool)
    first[1:] = shingle[1:] != shingle[:-1]
    at = np.flatnonzero(first)
    total = np.repeat(np.add.reduceat(own, at), np.diff(np.append(at, len(key))))
    near = own.copy()
    beside = np.flatnonzero(~first[1:] & (cls[1:] == cls[:-1] + 1))
    near[beside + 1] += own[beside]
    near[beside] += own[beside + 1]
    level = np.log2(total).astype(np.uint8) | ((near > 1).astype(np.uint8) << 5)
    out = np.empty(len(s), np.uint8)
    out[order] = np.repeat(level, np.diff(np.append(begin, len(s))))
    ends = np.cumsum([0, *map(len, values)])
    n = len(files)
    yield {"file": files, "part": [part] * n, "data": [_chunks.pack(q=out[ends[i] : ends[i + 1]]) for i in range(n)], "x": [None] * n, "y": [None] * n}


def sets(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ascending 48-bit shingle hashes by row, how many each row has)."""
    w = _words.Words(_words.lower_ascii(data), at)
    h, start = _words.windows(w.hash, w.first, n)
    row = w.row[start]
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(few):
        prefix = _words.prefix_hash(w.hash)
        h = np.append(h, _words.span_hash(prefix, w.first[few], w.first[few] + w.count[few]))
        row = np.append(row, few)
    out, counts = [], []
    for r in range(0, len(at) - 1, 60_000):
        own = (row >= r) & (row < r + 60_000) if len(at) > 60_001 else slice(None)
        key = np.unique(((row[own] - r).astype(np.uint64) << np.uint64(48)) | (h[own] >> np.uint64(16)))
        out.append(key & np.uint64((1 << 48) - 1))
        counts.append(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=min(60_000, len(at) - 1 - r)))
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def signature(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each row's mixed hashes."""
    out = []
    for salt in (np.uint64(0), _SALT):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(_words.mix(hashes ^ salt), out=total[1:])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each set ``BANDS`` hashes of the least shingles of ``BAND`` classes (by their low bits); 0 where it has fewer than ``LEAST``."""
    n, row = len(size), np.repeat(np.arange(len(size), dtype=np.uint32), size)
    low = (hashes & np.uint64(63)).astype(np.uint8)
    out = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        have = np.zeros(n, np.int64)
        for k in range(BAND * b, BAND * (b + 1)):
            at = np.flatnonzero(low == k)
            r = row[at]
            first = np.ones(len(at), dtype=bool)
            first[1:] = r[1:] != r[:-1]
            own = r[first]
            out[own, b] += _words.mix(hashes[at[first]] ^ _SALT)
            have[own] += 1
        out[have < LEAST, b] = 0
    return out


class Forest:
    """Union-find over numbers; ``edges`` is a spanning star of each group of two or more."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, a: int) -> int:
        parent = self.parent
        r = a
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(a, a)) != r and a != r:
            parent[a] = r
            a = p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            lo, hi = min(a, b), max(a, b)
            self.parent[hi] = lo
            self.parent.setdefault(lo, lo)

    def edges(self) -> tuple[list[int], list[int]]:
        out = [(a, self.root(a)) for a in self.parent if self.root(a) != a]
        return [a for a, _ in out], [r for _, r in out]


def alike(group: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets that are alike; with ``side``, only pairs of different sides."""
    found = [(ok, np.full(len(ok), i)) for i, ok in links(group, side, percent)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(group: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the sets before i that are alike) for sets i that have some; with ``side``, only those of another side.

    T-occurrence by DivideSkip: a set's shingles name inverted lists over the group. The longest L of them, with
    L = T / (MU * log2(longest) + 1), are set aside; the others are merged and counted, those that reach T - L
    are probed in the long lists by binary search, and the exact overlap decides.
    """
    size = np.array([len(s) for s in group])
    every = np.concatenate(group)
    owner = np.repeat(np.arange(len(group)), size)
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(every))
    length = np.diff(first)
    lists_of = np.empty(len(every), np.int64)
    lists_of[order] = number
    at = np.append(0, np.cumsum(size))
    postings = number * len(group) + owner  # ascending: one binary search probes any list
    del every, new, order, number
    for i in range(len(group)):
        own = lists_of[at[i] : at[i + 1]]
        n = length[own]
        own, n = own[n > 1], n[n > 1]
        need = int(least_overlap(int(size[i]), percent))
        if len(own) < need:
            continue
        aside = min(int(need / (MU * np.log2(n.max()) + 1)), need - 1)
        if aside:
            by_length = np.argsort(n, kind="stable")
            short, long = own[by_length[: len(own) - aside]], own[by_length[len(own) - aside :]]
        else:
            short, long = own, own[:0]
        n = length[short]
        stop = np.cumsum(n)
        merged = owner[np.arange(stop[-1]) + np.repeat(first[short] - (stop - n), n)]
        count = np.bincount(merged, minlength=len(group))
        # both sides find a pair: the later one keeps it
        found = np.flatnonzero(count[:i] >= need - aside)
        if side is not None:
            found = found[side[found] != side[i]]
        # overlap >= t * (a + b) / (1 + t) needs sizes within a factor t
        found = found[(100 * size[found] >= percent * size[i]) & (percent * size[found] <= 100 * size[i])]
        if len(found) == 0:
            continue
        overlap = count[found]
        step = max(1, PAIRS // len(found))
        for k in range(0, len(long), step):
            probe = (long[k : k + step, None] * len(group) + found[None, :]).ravel()
            where = np.searchsorted(postings, probe)
            where[where == len(postings)] = 0
            overlap = overlap + (postings[where] == probe).reshape(-1, len(found)).sum(axis=0)
        ok = found[100 * overlap >= percent * (size[i] + size[found] - overlap)]
        if len(ok):
            yield i, ok


def components(edges: DataFrame) -> DataFrame:
    """id, comp (least id reachable) of every id in ``edges`` (a, b): alternating large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a"))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    e = edges.select("a", "b").where("a != b").distinct()
    seen = None
    while True:
        e = stored(star(star(e, True), False), "components")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())


def _store(docs: DataFrame, n: int, keep_rows: bool) -> tuple[DataFrame, int, int]:
    text, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def chunk(batches: list[pa.RecordBatch]) -> tuple[dict, int]:
        hashes, counts = [], []
        for b in batches:
            for _, _, data, at in _words.slices(b.column(text)):
                h, c = sets(data, at, n)
                hashes.append(h)
                counts.append(c)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        s, t = signature(h, np.append(0, np.cumsum(size)))
        out = {"h": _chunks.narrow(h), "size": size.astype(np.uint32), "s": s, "t": t, "bands": bands(h, size).ravel()}
        if keep_rows:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(batches)
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_table(whole)
            out["rows"] = np.frombuffer(sink.getvalue(), np.uint8)
        ids = [_chunks.ids_of(b.column(key).cast(pa.int64())) for b in batches]
        return out | {"doc_id": np.concatenate(ids)}, len(h)

    manifest = _chunks.write(docs, chunk, "shingles")
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    return manifest, files, total


def _as_info(rows: DataFrame, file: str, x: str, y: str) -> DataFrame:
    return rows.selectExpr(f"{file} as file", "-2 as part", "cast(null as binary) as data", f"cast({x} as long) as x", f"cast({y} as long) as y")


def _search(manifest: DataFrame, files: int, total: int, percent: int) -> DataFrame:
    """idx (of each row), doc_id, n_shingles, n_similar, component_id."""
    spark = manifest.sparkSession
    parts = _chunks.parts_for(spark, total)

    def member(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        k = len(f["doc_id"])
        yield {"idx": file * _chunks.ROWS + np.arange(k), "doc_id": pa.array(f["doc_id"], mask=f["doc_id"] == NO_ID), "n": f["size"].astype(np.int64), "s": f["s"], "t": f["t"]}

    members = stored(_chunks.by_file(manifest, files, None, member, "idx long, doc_id long, n long, s long, t long"), "members")
    classes = stored(members.where("n > 0").groupBy("s", "t", "n").agg(F.min("idx").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
    reps = _as_info(classes, f"shiftright(rep, 24)", f"rep & {_chunks.ROWS - 1}", "copies")

    def banded(file, path, blobs, x, y) -> Iterator[dict]:
        """Of every band (values by part), which rows have it."""
        rows = np.sort(x)
        v = _chunks.load(path)["bands"].reshape(-1, BANDS)[rows].ravel()
        row = np.repeat(rows, BANDS)[v > 0].astype(np.uint32)
        v = v[v > 0]
        order = np.argsort(v, kind="stable")
        v, row = v[order], row[order]
        at = _chunks.cuts(v, parts, 64)
        on = [p for p in range(parts) if at[p] < at[p + 1]]
        yield {"part": on, "file": [file] * len(on), "data": [_chunks.pack(v=_chunks.deltas(v[at[p] : at[p + 1]]), i=row[at[p] : at[p + 1]]) for p in on]}

    def agreed(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
        v = np.concatenate([_chunks.undeltas(d["v"]) for d in data])
        i = np.concatenate([f * _chunks.ROWS + d["i"].astype(np.int64) for f, d in zip(files, data, strict=True)])
        order = np.lexsort((i, v))
        v, i = v[order], i[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = v[1:] != v[:-1]
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        forest = Forest()
        for a, b in zip(i[~new].tolist(), least[~new].tolist(), strict=True):
            forest.join(a, b)
        a, b = forest.edges()
        yield {"a": a, "b": b}

    nodes = stored(components(_chunks.by_part(_chunks.by_file(manifest, files, reps, banded, _chunks.BLOB), parts, agreed, "a long, b long")), "nodes")
    by_node = classes.select("rep").join(nodes.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("node"))
    by_node = _as_info(by_node, "shiftright(rep, 24)", f"rep & {_chunks.ROWS - 1}", "node")

    def own_sets(path: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = _chunks.load(path)
        size = f["size"].astype(np.int64)
        mask = np.zeros(len(size), dtype=bool)
        mask[rows] = True
        return _chunks.widen(f["h"].reshape(-1, 6)[np.repeat(mask, size)].ravel()), size[mask]

    def frequencies(file, path, blobs, x, y) -> Iterator[dict]:
        h, size = own_sets(path, x)
        v, c = np.unique(_keys(h, np.repeat(size_class(size, percent), size)), return_counts=True)
        yield _chunks.value_blobs(file, v, c, parts, 48)

    known = _chunks.by_part(_chunks.by_file(manifest, files, reps, frequencies, _chunks.BLOB), parts, _frequent, _chunks.INFO)

    def prefixes(file, path, blobs, x, y) -> Iterator[dict]:
        order = np.argsort(x)
        rows, node = x[order], y[order]
        h, size = own_sets(path, rows)
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        v, number = np.unique(_keys(h, size_class(size, percent)[row]), return_inverse=True)
        known = _chunks.levels(blobs)[number] if len(v) else np.zeros(0, np.uint8)
        del v, number
        order = np.lexsort((h, known & 31, row))
        h, near = h[order], known[order] > 31
        del order, known
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        longest = size - least_overlap(size, percent) + 1 + size // EXTRA
        use = (place < longest[row]) & near
        h, row = h[use], row[use]
        h, i, lo, hi = _by_node(h, node[row], size[row], size[row])
        at = _chunks.cuts(h, parts, 48)
        # a node is named by its least set
        f, r = (i >> 24).astype(np.uint32), (i & (_chunks.ROWS - 1)).astype(np.uint32)
        lo, more = lo.astype(np.uint32), (hi - lo).astype(np.uint32)
        on = [p for p in range(parts) if at[p] < at[p + 1]]
        yield {"part": on, "file": [file] * len(on), "data": [_chunks.pack(h=_chunks.deltas(h[(s := slice(at[p], at[p + 1]))]), f=f[s], r=r[s], n=lo[s], m=more[s]) for p in on]}

    lists = _chunks.by_file(manifest, files, by_node.union(known), prefixes, _chunks.BLOB)

    def shared(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
        """Links from the lists of a range of shingles: (a, b, how many they share here, how many they must)."""
        h = np.concatenate([_chunks.undeltas(d["h"]) for d in data])
        f, r, lo, more = (np.concatenate([d[c] for d in data]).astype(np.int64) for c in "frnm")
        h, i, lo, hi = _by_node(h, (f << 24) | r, lo, lo + more)
        order = np.lexsort((lo, h))
        h, i, lo, hi = h[order], i[order], lo[order], hi[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        end = np.append(np.flatnonzero(new)[1:], len(h))[np.cumsum(new) - 1]
        # partners follow in the list, as long as their sets aren't too large
        code = (np.cumsum(new) << 32) + lo
        last = np.minimum(end, np.searchsorted(code, (code >> 32 << 32) + hi * 100 // percent, side="right"))
        partners = last - np.arange(len(h)) - 1
        del code, last, end, new
        edge = np.append(0, np.cumsum(partners))

        def sent(a: np.ndarray, b: np.ndarray, c: np.ndarray, need: np.ndarray) -> dict:
            to = (_words.mix(a.astype(np.uint64) ^ _words.mix(b.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            a, b, c, need, to = a[order], b[order], c[order], need[order], to[order]
            at = np.searchsorted(to, np.arange(parts + 1))
            on = [p for p in range(parts) if at[p] < at[p + 1]]
            return {"part": on, "file": [part] * len(on), "data": [_chunks.pack(a=np.diff(a[(s := slice(at[p], at[p + 1]))], prepend=0), f=(b[s] >> 24).astype(np.uint32), r=(b[s] & (_chunks.ROWS - 1)).astype(np.uint32), c=c[s].astype(np.uint32), m=need[s].astype(np.uint32)) for p in on]}

        held: list[tuple] = []
        u = 0
        while u < len(h):
            v = max(u + 1, int(np.searchsorted(edge, edge[u] + PAIRS, side="right")) - 1)
            m = partners[u:v]
            a = np.repeat(np.arange(u, v), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(edge[u:v] - edge[u], m)
            u = v
            held.append(_summed(np.minimum(i[a], i[b]), np.maximum(i[a], i[b]), np.ones(len(a), np.int64), 1 + lo[a] // EXTRA))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD // 2:
                    yield sent(*held.pop())
        if held:
            yield sent(*_summed(*(np.concatenate(c) for c in zip(*held, strict=True))))

    def linked(part: int, _, data: list[dict]) -> Iterator[dict]:
        forest = Forest()
        for a, b in _reached(data):
            for s, t in zip(a.tolist(), b.tolist(), strict=True):
                forest.join(s, t)
        s, t = forest.edges()
        yield {"a": s, "b": t}

    candidates = stored(_chunks.by_part(_chunks.by_part(lists, parts, shared, _chunks.BLOB), parts, linked, "a long, b long"), "candidates")
    groups = stored(components(candidates.union(nodes.select("id", "comp"))), "groups")
    groups = groups.join(classes.select(F.col("rep").alias("id"), "copies", "n"), "id")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = groups.join(sizes, "comp").select("id", "comp", "copies", blocks.alias("k"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    placed = stored(placed, "placed")

    def gather(file, path, blobs, x, y) -> Iterator[dict]:
        f = _chunks.load(path)
        at = np.append(0, np.cumsum(f["size"].astype(np.int64)))
        h = f["h"].reshape(-1, 6)
        yield {"id": file * _chunks.ROWS + x, "h": [h[at[r] : at[r + 1]].tobytes() for r in x.tolist()]}

    wanted = _as_info(placed, "shiftright(id, 24)", f"id & {_chunks.ROWS - 1}", "copies")
    # files without a wanted set have nothing to give, and rows come grouped by file
    taken = _chunks.by_file(manifest, files, wanted, gather, "id long, h binary")
    pairs = F.when(F.col("k") == 1, F.array(F.struct(F.lit(0).alias("u"), F.lit(0).alias("v")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("block", j).alias("u"), F.greatest("block", j).alias("v")))
    )
    tasks = max(parts, partitions(spark))
    spread = placed.join(taken, "id").select("id", "comp", "copies", "block", F.explode(pairs).alias("g"), "h").select("id", "comp", "copies", "block", "g.u", "g.v", "h").repartition(tasks, "comp", "u", "v").sortWithinPartitions("comp", "u", "v", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        schema = pa.schema([("id", pa.int64()), ("similar", pa.int64()), ("a", pa.int64())])

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            ids = np.array([r[0] for r in held])
            copies = np.array([r[1] for r in held])
            side = np.array([r[2] for r in held]) if at[1] != at[2] else None
            similar, least = np.zeros(len(held), np.int64), ids.copy()
            for i, ok in links([_chunks.widen(np.frombuffer(r[3], np.uint8)) for r in held], side, percent):
                similar[i] += copies[ok].sum()
                similar[ok] += copies[i]
                # a component goes by its least id
                joined = np.unique(np.append(least[ok], least[i]))
                if len(joined) > 1:
                    least[np.isin(least, joined)] = joined[0]
            on = np.flatnonzero(similar > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(similar[on]), pa.array(least[on])], schema=schema)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("comp", "u", "v", "id", "copies", "block", "h")), strict=True):
                if r[:3] != at:
                    yield from done()
                    held, at = [], r[:3]
                held.append(r[3:])
        yield from done()

    found = stored(spread.mapInArrow(verify, "id long, similar long, a long"), "links")
    comps = components(found.select("a", F.col("id").alias("b")))
    linked_classes = classes.join(found.groupBy("id").agg(F.sum("similar").alias("similar")).withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = linked_classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("rep").alias("first"))
    full = linked_classes.join(least, "comp").select("s", "t", "n", (F.coalesce("similar", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), "component_id")
    return members.join(full, ["s", "t", "n"], "left").select("idx", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _by_node(h: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """A node's entries for a shingle made one, with its least and largest size, in the order of shingles."""
    if len(h) == 0:
        return h, node, lo, hi
    order = np.lexsort((node, h))
    h, node, lo, hi = h[order], node[order], lo[order], hi[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(new)
    return h[at], node[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def _summed(a: np.ndarray, b: np.ndarray, c: np.ndarray, need: np.ndarray) -> tuple:
    """Equal (a, b) made one, with the sum of c and the least need."""
    if len(a) == 0:
        return a, b, c, need
    order = np.lexsort((b, a))
    a, b, c, need = a[order], b[order], c[order], need[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(c, at), np.minimum.reduceat(need, at)


def _reached(data: list[dict], held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate links (a, b) that share as much as they must, over all blobs of a part.

    How many links a part gets grows with the lists, faster than the input, so they stay in the blobs' narrow
    columns and only those of a range of a, about ``held``, are widened and summed up at a time.
    """
    total = 0
    for d in data:
        # ascending within a blob
        d["a"] = np.cumsum(d["a"])
        total += len(d["a"])
    if total == 0:
        return
    # edges between ranges: every so many links of each blob, weighed by how many they stand for
    step = max(1, held // (8 * len(data)))
    marks = np.concatenate([d["a"][step - 1 :: step] for d in data])
    marks.sort()
    edges = np.unique(marks[max(1, held // step) - 1 :: max(1, held // step)])
    begin = [0] * len(data)
    for edge in [*edges.tolist(), None]:
        end = [len(d["a"]) if edge is None else int(np.searchsorted(d["a"], edge, side="right")) for d in data]
        part = [(d, slice(i, j)) for d, i, j in zip(data, begin, end, strict=True) if i < j]
        begin = end
        if part:
            a = np.concatenate([d["a"][s] for d, s in part])
            f, r, c, need = (np.concatenate([d[x][s] for d, s in part]).astype(np.int64) for x in "frcm")
            a, b, c, need = _summed(a, (f << 24) | r, c, need)
            ok = c >= need
            yield a[ok], b[ok]


def similar(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, n_similar (other documents linked directly), component_id (least doc_id reachable)."""
    manifest, files, total = _store(documents(docs), n, keep_rows=False)
    return _search(manifest, files, total, percent).drop("idx")


def one_of_each(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all columns, of which none is linked, and one row (of the least id) of each component."""
    manifest, files, total = _store(docs, n, keep_rows=True)
    found = _search(manifest, files, total, percent)
    # rows without a word are no group: each stays
    one = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True)), "idx")).alias("m")).where("component_id is not null").select(F.col("m.idx").alias("idx"))
    # without an id, a row stands for its group by its place
    rest = found.where("n_shingles = 0 or component_id is null").select("idx")
    keep = _as_info(one.union(rest), "shiftright(idx, 24)", f"idx & {_chunks.ROWS - 1}", "0")

    names = docs.columns

    def rows(file, path, blobs, x, y) -> Iterator[dict]:
        if len(x):
            with pa.ipc.open_stream(pa.py_buffer(_chunks.load(path)["rows"])) as r:
                table = r.read_all()
            for batch in table.take(pa.array(np.sort(x))).combine_chunks().to_batches():
                yield {c: batch.column(c) for c in names}

    return _chunks.by_file(manifest, files, keep, rows, docs.schema)
