"""Token ids of whole texts with the tokenizers library's results, distinct segments encoded once while they are kept.

Byte-level BPE never merges across the pre-tokens of its pattern. A text may therefore be cut
where a pre-token begins whatever stands around it, and the ids of its segments joined are the
ids of the text. Segments begin

- at a space before a letter or a visible character of ASCII,
- at a run of letters after a visible character of ASCII that is no letter and no apostrophe (which
  may begin a contraction), after a line feed behind a visible one, and at the text's start,
- after such a run, and after one that a space leads, where no letter outside the known ones follows.

Runs of letters, a space before them included, are pre-tokens; many are merged at once
(``Merges``). Other segments are encoded by the library. Both are looked up by their bytes (``_kept``).
The cut is used for tokenizers of exactly that kind; any other encodes texts whole, and so
are texts that hold the content of an added token (it becomes that token, as the
library does by default).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import _kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct segments kept per process, some 48 bytes each.
KEPT_WORDS = 400_000
#: Bytes of a run of letters that is merged with others; a round of merges costs all of them, so longer ones are left to the library.
LONGEST = 40
#: Characters of texts that are cut at once, about.
GROUP_CHARS = 1_000_000
#: Letters by any version of Unicode, first and last of each range.
_RANGES = "AZ az \u00aa\u00aa \u00b5\u00b5 \u00ba\u00ba \u00c0\u00d6 \u00d8\u00f6 \u00f8\u02af \u0400\u0481 \u048a\u0523 \u05d0\u05ea \u0621\u063a \u0641\u064a \u3041\u3096 \u30a1\u30fa \u4e00\u9fa5 \uac00\ud7a3"
_LETTER = np.zeros(0x10000, bool)
for _r in _RANGES.split():
    _LETTER[ord(_r[0]) : ord(_r[1]) + 1] = True
#: A byte between texts, which UTF-8 never has.
BETWEEN = 0xFF
_ASCII = np.append(_LETTER[:128], np.zeros(128, bool))
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
#: Bytes after which a run of letters is a pre-token of its own.
_APART = _VISIBLE & ~_ASCII
_APART[ord("'")] = False
_APART[BETWEEN] = True
_STARTS = _VISIBLE.copy()
_STARTS[BETWEEN] = True


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether it is a run of letters) of the segments of texts with ``BETWEEN`` before, between and after them."""
    letter = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    two = lead[data[lead] < 0xE0]
    two = two[_LETTER[(data[two] & 31).astype(np.int64) << 6 | data[two + 1] & 63]]
    letter[two] = letter[two + 1] = True
    three = lead[(data[lead] >= 0xE0) & (data[lead] < 0xF0)]
    three = three[_LETTER[(data[three] & 15).astype(np.int64) << 12 | (data[three + 1] & 63).astype(np.int64) << 6 | data[three + 2] & 63]]
    letter[three] = letter[three + 1] = letter[three + 2] = True
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    before, after = data[begin - 1], data[end]
    spaced = before == 32
    apart = _APART[before]
    line = np.flatnonzero(before == 10)
    apart[line] = _STARTS[data[begin[line] - 2]]
    own = (spaced | apart) & ((after < 128) | (after == BETWEEN))
    begin, end = (begin - spaced)[own], end[own]
    mark = np.zeros(len(data) + 1, bool)
    mark[begin] = mark[end] = True
    space = np.flatnonzero(data == 32)
    mark[space[_VISIBLE[data[space + 1]] | letter[space + 1]]] = True
    between = np.flatnonzero(data == BETWEEN)
    mark[between] = mark[between + 1] = True
    run = np.zeros(len(data) + 1, bool)
    run[begin] = True
    start = np.flatnonzero(mark)
    start, end = start[:-1], start[1:]
    real = data[start] != BETWEEN
    start, end = start[real], end[real]
    return start, end, run[start]


class Merges:
    """Byte-pair encoding of many pre-tokens at once: in each round every one takes its leftmost pair of least rank."""

    NONE = np.int64(2**62)

    def __init__(self, model: dict):
        vocab, plain = model["vocab"], [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.end = max(vocab.values()) + 1
        self.first = np.array([vocab[spelled[b]] for b in range(256)], dtype=np.int64)
        self.first[10] = self.end
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocab[a] * (self.end + 1) + vocab[b] for a, b in pairs], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.code, rank = np.unique(code[::-1], return_index=True)
        # of a pair that is listed twice the later rank counts, as in the library
        self.rank = len(code) - 1 - rank

    @classmethod
    def of(cls, model: dict) -> Merges | None:
        """None for models with more than plain merges."""
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        return None if odd or not model.get("merges") else cls(model)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * (self.end + 1) + b
        at = np.searchsorted(self.code, code)
        at[at == len(self.code)] = 0
        return np.where(self.code[at] == code, self.rank[at], self.NONE >> 32)

    def ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, how many each has) of bytes with a line feed after each, and nowhere else."""
        token, cells = self.first[data], np.arange(len(data))
        stop = np.flatnonzero(data == 10)
        begin = np.append(0, stop[:-1] + 1)
        after, before, live = cells + 1, cells - 1, data != 10
        # a cell's pair with the next one: rank, then place
        key = np.full(len(data), self.NONE)
        key[:-1] = (self.ranks(token[:-1], token[1:]) << 32) | cells[:-1]
        while True:
            least = np.minimum.reduceat(key, begin)
            least = least[least < self.NONE]
            if len(least) == 0:
                break
            at = least & 0xFFFF_FFFF
            gone = after[at]
            token[at] = self.result[least >> 32]
            live[gone] = False
            key[gone] = self.NONE
            after[at] = then = after[gone]
            before[then] = at
            key[at] = (self.ranks(token[at], token[then]) << 32) | at
            # the first cell of all has none before it
            at = at[at > 0]
            prior = before[at]
            key[prior] = (self.ranks(token[prior], token[at]) << 32) | prior
        return token[live], np.add.reduceat(live, begin, dtype=np.int64)


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and (spec.get("model") or {}).get("type") == "BPE" and all(t.get("special") for t in spec.get("added_tokens") or [])
        self.merges = Merges.of(spec["model"]) if self.cuts else None
        #: Contents of added tokens, which are found before anything is cut: texts that hold one are encoded whole.
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.kept = _kept.Kept(kept, self.dtype)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each token: byte-level vocabularies spell one character per byte.
        self.width = np.zeros(size, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        for token, i in added.items():
            self.width[i] = len(token.encode())

    @property
    def words(self) -> dict[bytes, bytes]:
        """Segments after a space that are kept, with their ids."""
        return {s: ids for s, ids in self.kept.items().items() if s[0] == 32}

    @property
    def tails(self) -> dict[bytes, bytes]:
        """Other segments that are kept."""
        return {s: ids for s, ids in self.kept.items().items() if s[0] != 32}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs of letters, how many each has); runs are sorted by size."""
        found = []
        for i in range(0, len(start), 4096):
            s, n = start[i : i + 4096], size[i : i + 4096]
            ends = np.cumsum(n + 1)
            at = _kept.spread(s, n + 1)
            lined = data[at]
            lined[ends - 1] = 10
            found.append(self.merges.ids(lined))
        return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))

    def _solved(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many each has)."""
        size = end - start
        merged = run & (size <= LONGEST) if self.merges else np.zeros(len(run), bool)
        letters, others = np.flatnonzero(merged), np.flatnonzero(~merged)
        letters = letters[np.argsort(size[letters], kind="stable")]
        flat, counts = self._merged(data, start[letters], size[letters])
        raw = data.data
        rest = self._encode([str(raw[s:e], "utf-8") for s, e in zip(start[others].tolist(), end[others].tolist(), strict=True)])
        n = np.array([len(x) // self.dtype.itemsize for x in rest], np.int64)
        count, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        count[letters], count[others] = counts, n
        at[letters], at[others] = np.cumsum(counts) - counts, len(flat) + np.cumsum(n) - n
        return np.concatenate([flat.astype(self.dtype), np.frombuffer(b"".join(rest), self.dtype)])[_kept.spread(at, count)], count

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters alone after a space, which is one pre-token; ``words`` are sorted by length."""
        raw = [b" " + w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat, counts = self._merged(np.frombuffer(b"".join(raw) + b" ", np.uint8), np.cumsum(size) - size, size)
        data, at = flat.astype(self.dtype).tobytes(), [0, *(np.cumsum(counts) * self.dtype.itemsize).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), for tokenizers that cut and texts without an added token."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\xff" + b"\xff".join(raw) + b"\xff" + bytes(_kept.PAD), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        start, end, run = segments(data[: -_kept.PAD])
        flat, counts = self.kept.ids(data, start, end, lambda w: self._solved(data, start[w], end[w], run[w]))
        # a text begins behind the byte before it
        edge = np.append(0, np.cumsum(size + 1)) + 1
        return flat, np.diff(np.append(0, np.cumsum(counts))[np.searchsorted(start, edge)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if not self.cuts:
            return self._encode(texts)
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.added.search(t)] if self.added else []
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None] if whole else range(len(texts))
        at = 0
        for _, part in groups([texts[i] for i in rest] if whole else texts, GROUP_CHARS):
            flat, counts = self.flat(part)
            data, edge = flat.tobytes(), (self.dtype.itemsize * np.append(0, np.cumsum(counts))).tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                out[rest[at]] = data[a:b]
                at += 1
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> Encoder:
    """The process's encoder for a tokenizer file that keeps so many words."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def groups(texts: list[str], size: int = 2_000_000):
    """(first, texts) of runs of texts with about ``size`` characters."""
    i, n = 0, len(texts)
    while i < n:
        j, chars = i, 0
        while j < n and (j == i or chars + len(texts[j]) <= size):
            chars += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j
