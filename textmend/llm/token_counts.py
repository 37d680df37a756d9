"""Token counts by offset-mapped attribution.

A whole document is encoded once; the byte span of every token follows from the
widths of its ids (byte-level tokens spell their bytes), and an interval join
of sorted token spans with sorted section spans attributes tokens to sections.
Sections partition the text in order.  A token that crosses a boundary is
allocated by the rule: to the section that holds most of its bytes, of equal
shares the first (``rule="most"``), or to the section of its first byte
(``rule="start"``).  Every token is counted in exactly one section, so the
sections' counts add up to the document's.

Sections of ``line_sections``: the lines of the text, each with its ``\\n``;
``blank_sections`` ends a section only at a run of two or more ``\\n``.

Cases: a null or empty text has one section, empty, with no tokens; a text
that ends in ``\\n`` has no section after it; repeated rows get their rows each;
other columns are ignored.  Both sides of the join are one row's, so nothing is
shuffled and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bpe
from ._common import arrow_schema, documents, mapped, record

SCHEMA = "doc_id long, section long, start long, length long, n_tokens long, n_crossing long"


def line_sections(data: np.ndarray) -> np.ndarray:
    """Ascending starts of the sections in a text's bytes; the first is 0."""
    s = np.append(0, np.flatnonzero(data == 10) + 1)
    return s[: max(1, np.searchsorted(s, len(data)))]


def blank_sections(data: np.ndarray) -> np.ndarray:
    n = data == 10
    after = np.flatnonzero(n[1:] & n[:-1]) + 2 if len(data) > 1 else np.zeros(0, np.int64)
    after = after[after < len(data)]
    return np.append(0, after[~n[after]])


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) by a join of sorted intervals."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1
    crossing = last > first
    if rule == "start" or not crossing.any():
        return first, crossing
    own = first.copy()
    edge = np.append(sections, np.iinfo(np.int64).max)
    for t in np.flatnonzero(crossing).tolist():
        k = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[t], edge[k + 1]) - np.maximum(starts[t], edge[k])
        own[t] = k[np.argmax(share)]
    return own, crossing


def section_counts(docs: DataFrame, tokenizer: str, sections: Callable[[np.ndarray], np.ndarray] = line_sections, rule: str = "most") -> DataFrame:
    """doc_id, section (from 0), start and length (bytes), n_tokens, n_crossing (of them, those that cross a boundary)."""
    if rule not in ("most", "start"):
        raise ValueError(f"no such rule: {rule}")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        e = _bpe.encoder(tokenizer)
        if not e.cuts:
            raise ValueError("widths of ids are known for byte-level tokenizers without a normaliser only")
        doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else None
        listed = batch.column("doc_id").to_pylist() if doc_ids is None else None
        for first, texts in _bpe.groups([t or "" for t in batch.column("text").to_pylist()]):
            coded = e.encode(texts)
            counts = np.array([len(x) // e.dtype.itemsize for x in coded])
            raws = [t.encode() for t in texts]
            sizes = np.array([len(r) for r in raws])
            # one run over all rows: spans are offsets into the joined bytes
            data = np.frombuffer(b"".join(raws), np.uint8)
            at = np.append(0, np.cumsum(sizes))
            ends = np.cumsum(e.width[np.frombuffer(b"".join(coded), e.dtype)])
            if len(ends) and ends[-1] != len(data) or not np.array_equal(np.append(0, ends)[np.append(0, np.cumsum(counts))], at):
                raise ValueError("token widths and text lengths differ")
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            cuts = [sections(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = np.array([len(c) for c in cuts])
            row = np.repeat(np.arange(len(texts)), n)
            begin = np.concatenate(cuts) + at[row]
            base = np.append(0, np.cumsum(n))
            stop = np.append(begin[1:], len(data))
            # rows with no bytes share their start with the next row: the join must skip their sections
            real = sizes[row] > 0
            own, crossing = attribute(starts, ends, begin[real], rule)
            index = np.flatnonzero(real)[own] if len(own) else own
            size = len(begin)
            ids = doc_ids[first + row] if doc_ids is not None else pa.array([listed[first + r] for r in row.tolist()], pa.int64())
            yield {
                "doc_id": ids,
                "section": np.arange(size) - base[row],
                "start": begin - at[row],
                "length": np.minimum(stop, at[row + 1]) - begin,
                "n_tokens": np.bincount(index, minlength=size).astype(np.int64),
                "n_crossing": np.bincount(index[crossing], minlength=size).astype(np.int64),
            }

    return mapped(documents(docs), run, SCHEMA)


def field_counts(df: DataFrame, fields: list[str], tokenizer: str, key: str, joiner: str = "\n", rule: str = "most") -> DataFrame:
    """Token counts of string columns: their texts are joined in order, encoded once, and attributed by span.

    Returns ``key`` (as string), ``field``, ``n_tokens``, ``n_crossing``; a joiner belongs to the field before it; null fields are empty.
    """
    ddl = "key string, field string, n_tokens long, n_crossing long"
    schema = arrow_schema(ddl)
    table = df.selectExpr(f"cast(`{key}` as string) as key", *(f"cast(`{f}` as string) as f{i}" for i, f in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _bpe.encoder(tokenizer)
        for b in batches:
            out: dict = {f.name: [] for f in schema}
            columns = [[x or "" for x in b.column(f"f{i}").to_pylist()] for i in range(len(fields))]
            texts = [joiner.join(r) for r in zip(*columns, strict=True)]
            for key_value, parts, coded in zip(b.column("key").to_pylist(), zip(*columns, strict=True), e.encode(texts), strict=True):
                sizes = [len(p.encode()) + len(joiner.encode()) * (i < len(fields) - 1) for i, p in enumerate(parts)]
                spans = np.append(0, np.cumsum(sizes)[:-1])
                ends = np.cumsum(e.width[np.frombuffer(coded, e.dtype)])
                starts = np.append(0, ends[:-1]) if len(ends) else ends
                real = np.flatnonzero(np.array(sizes) > 0)
                own, crossing = attribute(starts, ends, spans[real], rule) if len(real) else (np.zeros(0, int), np.zeros(0, bool))
                index = real[own] if len(real) else own
                out["key"] += [key_value] * len(fields)
                out["field"] += fields
                out["n_tokens"] += np.bincount(index, minlength=len(fields)).tolist()
                out["n_crossing"] += np.bincount(index[crossing], minlength=len(fields)).tolist()
            yield record(out, schema)

    return table.mapInArrow(run, ddl)
