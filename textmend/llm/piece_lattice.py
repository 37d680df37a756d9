"""SentencePiece encoding and decoding over a lattice of pieces.

A text becomes words as the model's normaliser escapes it: spaces turn into
the sign U+2581, one more stands before the text, and a word is a run of
signs with what follows them.  No piece reaches over a word's end.  The lattice has
an edge for every substring of a word that is a piece; a fold over it finds the path
that the model's kind asks for.

For kind BPE scores are only ranks: the fold joins neighbouring parts of a word by the
best-ranked edge, leftmost first, until none is left.  It runs where the texts are read, for
thousands of distinct words at once over arrays (``Ranked``): edges are looked up by the
numbers of the two parts that they join.  A process keeps the ids of some words
(``_kept``).  Nothing is shuffled.

For kind unigram the path is the one with the largest sum of scores (Viterbi).  Substrings up to
the longest piece are exploded and equi-joined to the piece table, grouped by word and
folded with higher-order functions (``lattice``, which takes BPE models, too; the query took
3719 CPU seconds a GB through it, and 229 over arrays).  Documents are then kept as files of word numbers with the file's distinct words; a
word is solved once for each file that holds it, so no word, however common, is a hot key.

Code points without a piece become byte pieces.

``decode`` turns ids into the text again, exactly: this is the round trip that the query checks.

Ids of a BPE model are the sentencepiece library's own; for that no piece may reach over a
word's end, and models with user-defined or unused pieces are refused.

Cases: a null or empty text has no ids; words longer than ``LONGEST`` (bytes of BPE's, else code
points) take the same steps in Python one by one, and so do words with a code point that several byte pieces
spell; repeated rows get their rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe, _chunks, _kept, _words
from ._common import NO_ID, arrow_schema, documents, mapped

SIGN = "▁"
#: At most 61: a word's boundaries are bits of a long.
LONGEST = 60
#: Words of a partition whose edges are grouped.
GROUPED = 24_000
#: Pieces that are broadcast at most.
PIECES = 1 << 18
UNKNOWN = -1e6
#: Words whose ids a process keeps, and characters of texts that it takes at once, about.
KEPT_WORDS, GROUP_CHARS = 400_000, 1_000_000
WORD = re.compile(f"{SIGN}+[^{SIGN}]*")


class Pieces:
    """A model's pieces with scores, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        if n > PIECES:
            raise ValueError(f"{n} pieces; {PIECES} can be broadcast")
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.table = {p.id_to_piece(i): (i, p.get_score(i)) for i in normal}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.back = {i: s.encode() for s, (i, _) in self.table.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.table))
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        #: Whether scores are ranks of merges.
        self.ranked = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        kinds = {x.type for x in model.pieces}
        if self.ranked and kinds & {proto.ModelProto.SentencePiece.USER_DEFINED, proto.ModelProto.SentencePiece.UNUSED}:
            raise ValueError("a BPE model with user-defined or unused pieces")
        if self.ranked and any(re.search(f"[^{SIGN}]{SIGN}", s) for s in self.table):
            raise ValueError("a BPE model with pieces over a word's end")
        self.unknown = p.unk_id()

    def of_char(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def viterbi(self, word: str) -> list[int]:
        """Ids of a word as the fold of ``lattice`` finds them."""
        return self.merged(word) if self.ranked else self.summed(word)

    def merged(self, word: str) -> list[int]:
        part, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]

        def pair(a: int, b: int) -> list[tuple]:
            got = self.table.get(part[a] + part[b]) if a >= 0 and b >= 0 else None
            return [(-got[1], a, b, len(part[a]) + len(part[b]))] if got else []

        heap = [x for i in range(n - 1) for x in pair(i, i + 1)]
        heapify(heap)
        while heap:
            _, a, b, size = heappop(heap)
            # one of the two has been merged since
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            for x in pair(before[a], a) + pair(a, after[a]):
                heappush(heap, x)
        return [i for s in part if s for i in ([self.table[s][0]] if s in self.table else self.of_char(s))]

    def summed(self, word: str) -> list[int]:
        best: list[tuple] = [(0.0, 0, 0)]
        for e in range(1, len(word) + 1):
            found = []
            for s in range(max(0, e - self.longest), e):
                got = self.table.get(word[s:e]) or ((-1, UNKNOWN) if s == e - 1 else None)
                if got:
                    found.append((best[s][0] + got[1], s, got[0]))
            best.append(max(found))
        out, e = [], len(word)
        while e:
            _, s, i = best[e]
            out = (self.of_char(word[s:e]) if i < 0 else [i]) + out if len(word) <= LONGEST else out + (self.of_char(word[s:e])[::-1] if i < 0 else [i])
            e = s
        return out if len(word) <= LONGEST else out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.back.__getitem__, ids)).decode().replace(SIGN, " ")[1:]


def escaped(text: str) -> list[str]:
    return WORD.findall(SIGN + text.replace(" ", SIGN)) if text else []


def lattice(words: DataFrame, pieces: Pieces, keys: list[str] = []) -> DataFrame:
    """(keys,) word, ids of words (partitioned by the keys' first, or the word) of at most ``LONGEST`` code points; -1 - c stands for a code point c without a piece."""
    spark = words.sparkSession
    table = spark.createDataFrame([(s, i, float(v)) for s, (i, v) in pieces.table.items()], "piece string, id int, score double")
    n = F.length("word")
    spans = words.select(*keys, "word", F.explode(F.sequence(F.lit(1), n)).alias("s")).select(*keys, "word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s") + 1))).alias("k"))
    edges = spans.select(*keys, "word", "s", "k", F.substring("word", F.col("s"), F.col("k")).alias("piece")).join(F.broadcast(table), "piece", "left").where("id is not null or k = 1")
    if pieces.ranked:
        return merges(edges, keys)
    edge = F.struct((F.col("s") + F.col("k") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(UNKNOWN)).alias("v"))
    grouped = edges.groupBy(*keys, "word").agg(F.collect_list(edge).alias("edges"))
    state = "array<struct<v:double,s:int,id:int>>"

    def step(best, e):
        ending = F.filter("edges", lambda x: x["e"] == e)
        return F.concat(best, F.array(F.array_max(F.transform(ending, lambda x: F.struct((best[x["s"]]["v"] + x["v"]).alias("v"), x["s"].alias("s"), x["id"].alias("id"))))))

    begin = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("s"), F.lit(0).alias("id"))).cast(state)
    best = F.aggregate(F.sequence(F.lit(1), n), begin, step)
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda w, _: F.when(w["at"] > 0, F.struct(F.col("best")[w["at"]]["s"].alias("at"), F.concat(F.array(F.col("best")[w["at"]]["id"]), w["ids"]).alias("ids"))).otherwise(w),
        lambda w: w["ids"],
    )
    return grouped.select(*keys, "word", "edges").withColumn("best", best).select(*keys, "word", walk.alias("ids"))


def merges(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys,) word, ids by merging in the order of ranks; a set bit i of the fold's state is a boundary before code point i."""
    ends, inner = F.expr("shiftleft(1L, s - 1) + shiftleft(1L, s + k - 1)"), F.expr("shiftleft(1L, s + k - 1) - shiftleft(1L, s)")
    edge = F.struct((-F.coalesce("score", F.lit(UNKNOWN))).alias("rank"), "s", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), ends.alias("ends"), inner.alias("inner"))
    grouped = edges.groupBy(*keys, "word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    def step(bits, _):
        joins = F.filter("edges", lambda x: (bits.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(bits.bitwiseAND(x["inner"])) == 1))
        return F.coalesce(bits.bitwiseAND(F.bitwise_not(F.get(joins, F.lit(0))["inner"])), bits)

    bits = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.expr("shiftleft(1L, length(word) + 1) - 1"), step)
    left = F.filter("edges", lambda x: (F.col("bits").bitwiseAND(x["ends"]) == x["ends"]) & (F.col("bits").bitwiseAND(x["inner"]) == 0))
    path = F.array_sort(F.transform(left, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    return grouped.withColumn("bits", bits).select(*keys, "word", F.transform(path, lambda x: x["id"]).alias("ids"))


class Ranked:
    """The fold of ``merges`` for many words at once, over arrays: joins of neighbouring parts are looked up as numbers of pairs."""

    NONE = np.int64(2**62)
    #: A code point that is in no piece and takes more than one byte.
    UNKNOWN = 0

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # code points that one byte spells are parts that nothing joins, unless a piece holds them
        single = {chr(b): pieces.of_char(chr(b))[0] for b in range(128) if b != 32}
        names = sorted(set(pieces.table).union(single, *pieces.table))
        #: Numbers of parts: of pieces and of the code points that they hold.
        part = {s: i for i, s in enumerate(names, 1)}
        self.id = np.array([-1] + [pieces.table[s][0] if s in pieces.table else single.get(s, -1) for s in names], np.int64)
        self.char = np.zeros(0x110000, np.int32)
        for s, i in part.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[32] = part.get(SIGN, self.UNKNOWN)
        self.base = len(names) + 1
        score = {s: v for s, (_, v) in pieces.table.items()}
        rank = {v: i for i, v in enumerate(sorted({-v for v in score.values()}))}
        pairs = [(part[s[:k]] * self.base + part[s[k:]], rank[-v], part[s]) for s, v in score.items() for k in range(1, len(s)) if s[:k] in part and s[k:] in part]
        code, order, result = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        # open addressing: a look-up takes as many steps as the fullest run of slots is long
        self.bits = max(4, int(4 * len(code)).bit_length())
        self.code, self.rank, self.result = np.full(1 << self.bits, -1), np.full(1 << self.bits, self.NONE >> 32), np.zeros(1 << self.bits, np.int64)
        left, self.steps = np.arange(len(code)), 0
        while len(left):
            at = self.slot(code[left], self.steps)
            free = left[self.code[at] < 0]
            at = at[self.code[at] < 0]
            self.code[at] = code[free]
            won = self.code[at] == code[free]
            self.rank[at[won]], self.result[at[won]] = order[free[won]], result[free[won]]
            left = np.setdiff1d(left, free[won])
            self.steps += 1

    def slot(self, code: np.ndarray, step: int) -> np.ndarray:
        h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and slot of each pair's piece, in one number."""
        code = a * self.base + b
        at = self.slot(code, 0)
        for step in range(1, self.steps):
            odd = np.flatnonzero((self.code[at] != code) & (self.code[at] >= 0))
            if len(odd) == 0:
                break
            at[odd] = self.slot(code[odd], step)
        return np.where(self.code[at] == code, at, -1)

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) of spans of UTF-8 with spaces for signs."""
        short = np.flatnonzero(size <= LONGEST)
        short = short[np.argsort(size[short], kind="stable")]
        found = [self._merged(data, start[x], size[x]) for x in (short[i : i + 4096] for i in range(0, len(short), 4096))]
        flat, counts = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1)]
        at = np.zeros(len(start), np.int64)
        count = np.zeros(len(start), np.int64)
        at[short], count[short] = np.cumsum(counts) - counts, counts
        # longer words and those with a code point that several bytes spell
        spelled = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(flat < 0, out=spelled[1:])
        rest = np.flatnonzero((size > LONGEST) | (spelled[at + count] > spelled[at]))
        more, end = [], len(flat)
        for w, a, n in zip(rest.tolist(), start[rest].tolist(), size[rest].tolist(), strict=True):
            more += (own := self.pieces.merged(data[a : a + n].tobytes().decode().replace(" ", SIGN)))
            at[w], count[w] = end, len(own)
            end += len(own)
        flat = np.concatenate([flat, np.array(more, np.int64)])
        return flat[_kept.spread(at, count)], count

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids``, with -1 for code points without a piece."""
        raw = data[_kept.spread(start, size)]
        starts = (raw & 0xC0) != 0x80
        chars = np.add.reduceat(starts, np.cumsum(size) - size, dtype=np.int64)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        part = self.char[points].astype(np.int64)
        begin = np.cumsum(chars) - chars
        total = len(part)
        cells = np.arange(total)
        # no pair reaches over a word's end: cell ``total`` stands for it
        cells = np.append(cells, total)
        after, before = cells + 1, cells - 1
        after[begin + chars - 1] = after[total] = total
        before[begin] = total
        part = np.append(part, self.UNKNOWN)
        slot = self.joined(part, part[after])
        key = np.where(slot >= 0, (self.rank[slot] << 32) | cells, self.NONE)
        live = np.ones(total, bool)
        while True:
            least = np.minimum.reduceat(key[:-1], begin)
            going = least < self.NONE
            if not going.any():
                break
            at = least[going] & 0xFFFF_FFFF
            gone = after[at]
            part[at] = self.result[slot[at]]
            live[gone] = False
            key[gone] = self.NONE
            after[at] = then = after[gone]
            before[then] = at
            before[total] = total
            for a, b in ((at, then), (before[at], at)):
                slot[a] = s = self.joined(part[a], part[b])
                key[a] = np.where(s >= 0, (self.rank[s] << 32) | a, self.NONE)
            key[total] = self.NONE
        return self.id[part[:-1][live]], np.add.reduceat(live, begin, dtype=np.int64)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), exact (whether decoding gives the text again), ids (binary)."""
    return encode_arrays(docs, model) if Pieces(model).ranked else encode_lattice(docs, model)


class Merging:
    """A process's solver for a BPE model, with the words that it keeps."""

    def __init__(self, model: str):
        self.pieces = Pieces(model)
        self.ranked, self.kept = Ranked(self.pieces), _kept.Kept(KEPT_WORDS, np.dtype("<u4"))
        back = [self.pieces.back.get(i, b"").replace(SIGN.encode(), b" ") for i in range(max(self.pieces.back, default=0) + 1)]
        self.size = np.array([len(b) for b in back], np.int64)
        self.begin, self.back = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(back), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, whether decoding them gives the text again)."""
        # a sign of the text's own can't be told from a space afterwards
        odd = np.array([SIGN in t for t in texts], bool)
        raw = [(" " + t.replace(SIGN, " ")).encode() if t else b"" for t in texts]
        rows = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw) + bytes(_kept.PAD), np.uint8)
        total = int(rows.sum())
        space = data[:total] == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        row_at = np.cumsum(rows) - rows
        cut[row_at[rows > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], total)[: len(start)]
        flat, counts = self.kept.ids(data, start, end, lambda w: self.ranked.ids(data, start[w], (end - start)[w]))
        ends = np.append(0, np.cumsum(counts))
        first = np.searchsorted(start, np.append(row_at, total))
        at = ends[first]
        widths = self.size[flat]
        spelled = np.append(0, np.cumsum(widths))[at]
        exact = ~odd & (np.diff(spelled) == rows)
        text = self.back[_kept.spread(self.begin[flat], widths)]
        if len(text) == total and np.array_equal(spelled[1:], np.cumsum(rows)):
            wrong = np.flatnonzero(text != data[:total])
            exact[np.searchsorted(np.cumsum(rows), wrong, side="right")] = False
        else:
            for r in np.flatnonzero(exact).tolist():
                exact[r] = np.array_equal(text[spelled[r] : spelled[r + 1]], data[row_at[r] : row_at[r] + rows[r]])
        return flat, np.diff(at), exact


_merging: dict[str, Merging] = {}


def encode_arrays(docs: DataFrame, model: str) -> DataFrame:
    """``encode`` for models of kind BPE: where the texts are read, and without an exchange."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if model not in _merging:
            _merging[model] = Merging(model)
        m = _merging[model]
        for i, texts in _bpe.groups([t or "" for t in batch.column("text").to_pylist()], GROUP_CHARS):
            flat, counts, exact = m.encode(texts)
            data = flat.astype("<u4").tobytes()
            at = (4 * np.append(0, np.cumsum(counts))).tolist()
            ids = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
            yield {"doc_id": batch.column("doc_id").slice(i, len(texts)), "n_ids": counts, "ids_crc32": [zlib.crc32(x) for x in ids], "exact": exact, "ids": ids}

    return mapped(documents(docs), run, "doc_id long, n_ids long, ids_crc32 long, exact boolean, ids binary")


def encode_lattice(docs: DataFrame, model: str) -> DataFrame:
    """``encode`` through files and the lattice of their distinct words."""
    spark, docs = docs.sparkSession, documents(docs)

    def chunk(batches: list[pa.RecordBatch]) -> tuple[dict, int]:
        texts = pa.concat_arrays([_words.texts_of(b.column("text")) for b in batches]).to_pylist()
        number: dict[str, int] = {}
        order: list[int] = []
        count, odd = [], []
        for t in texts:
            own = escaped(t)
            count.append(len(own))
            order += [number.setdefault(w, len(number)) for w in own]
            # a sign of the text's own can't be told from a space afterwards
            odd.append(SIGN in t)
        words = sorted(number, key=lambda w: (len(w), w))
        place = np.empty(len(words), np.int64)
        place[[number[w] for w in words]] = np.arange(len(words))
        raw = [w.encode() for w in words]
        check = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)
        index = place[np.array(order, np.int64)] if order else np.zeros(0, np.int64)
        # three bytes a word: their planes compress better apart
        planes = {f"i{k}": (index >> (8 * k) & 255).astype(np.uint8) for k in range(4)}
        return {
            "doc_id": np.concatenate([_chunks.ids_of(b.column("doc_id")) for b in batches]),
            "count": np.array(count, np.uint32),
            "odd": np.array(odd, np.bool_),
            "check": check,
            "words": np.frombuffer(b"".join(raw), np.uint8),
            "size": np.array([len(r) for r in raw], np.uint32),
        } | planes, len(words)

    manifest = _chunks.write(docs, chunk, "pieces")
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    pieces = Pieces(model)

    def words_of(f: dict) -> list[str]:
        at, data = np.append(0, np.cumsum(f["size"].astype(np.int64))).tolist(), f["words"].tobytes()
        return [data[s:e].decode() for s, e in zip(at, at[1:], strict=False)]

    def listed(file, path, blobs, x, y) -> Iterator[dict]:
        words = words_of(_chunks.load(path))
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield {"file": [file] * len(part), "i": np.arange(i, i + len(part)), "word": part}

    # a partition holds words of one file, few enough that their edges are grouped in memory
    per = max(1, -(-total // max(1, files) // GROUPED))
    held = _chunks.by_file(manifest, files, None, listed, "file long, i int, word string")
    spread = held.withColumn("p", F.expr(f"cast(pmod((file >> 12) + 7919 * (file & 4095), {max(1, files)}) * {per} + i % {per} as int)"))
    rows = spread.repartitionById(max(1, files) * per, F.col("p"))
    solved = lattice(rows.where(F.length("word") <= LONGEST), pieces, ["p", "file", "i"])
    arrow = arrow_schema(_chunks.INFO)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), None
        out: dict[int, tuple[list, list]] = {}
        for b in batches:
            for file, i, word, ids in zip(*(b.column(c).to_pylist() for c in ("file", "i", "word", "ids")), strict=True):
                if min(ids) < 0:
                    # code points without a piece are spelled in bytes
                    own = own or Pieces(model)
                    ids = own.viterbi(word)
                where, found = out.setdefault(file, ([], []))
                where.append(i)
                found.append(ids)
        k = len(out)
        data = []
        for where, found in out.values():
            order = np.argsort(where)
            flat = np.array([y for j in order.tolist() for y in found[j]], np.uint32)
            data.append(_chunks.pack(w=np.diff(np.array(where, np.int64)[order], prepend=0).astype(np.uint32), n=np.array([len(found[j]) for j in order.tolist()], np.uint16), i=flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([part] * k, pa.int32()), pa.array(data, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=arrow)

    info = solved.select("file", "i", "word", "ids").mapInArrow(send, _chunks.INFO)

    def put(file, path, blobs, x, y) -> Iterator[dict]:
        f, own = _chunks.load(path), Pieces(model)
        words = words_of(f)
        ids: list[bytes | None] = [None] * len(words)
        for data in blobs.values():
            b = _chunks.unpack(data)
            at = np.append(0, np.cumsum(b["n"].astype(np.int64))) * 4
            raw = b["i"].astype("<u4").tobytes()
            for w, s, e in zip(np.cumsum(b["w"].astype(np.int64)).tolist(), at.tolist(), at[1:].tolist(), strict=False):
                ids[w] = raw[s:e]
        for w, known in enumerate(ids):
            if known is None:
                # longer than the lattice's state
                ids[w] = np.array(own.viterbi(words[w]), "<u4").tobytes()
        back = [b"".join(map(own.back.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in ids]
        index = sum(f[f"i{k}"].astype(np.int64) << (8 * k) for k in range(4))
        at = np.append(0, np.cumsum(f["count"].astype(np.int64))).tolist()
        for a in range(0, len(at) - 1, 1000):
            z = min(len(at) - 1, a + 1000)
            out, exact = [], []
            for r in range(a, z):
                own_words = index[at[r] : at[r + 1]].tolist()
                out.append(b"".join(map(ids.__getitem__, own_words)))
                text = b"".join(map(back.__getitem__, own_words)).decode().replace(SIGN, " ")[1:]
                exact.append(not f["odd"][r] and xxhash.xxh64_intdigest(text.encode()) == f["check"][r])
            d = f["doc_id"][a:z]
            yield {"doc_id": pa.array(d, mask=d == NO_ID), "n_ids": [len(i) // 4 for i in out], "ids_crc32": [zlib.crc32(i) for i in out], "exact": exact, "ids": out}

    return _chunks.by_file(manifest, files, info, put, "doc_id long, n_ids long, ids_crc32 long, exact boolean, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of ids (binary, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model)
        for b in batches:
            texts = [p.decode(np.frombuffer(i, "<u4").tolist()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
