"""Files of document chunks in the shared folder, and exchanges between files and hash partitions.

An operator that compares all documents with each other reads them once into
files of a bounded size (``write``), then alternates two kinds of tasks: one
per file (``by_file``) and one per range of hash values (``by_part``).  What
they exchange are blobs of sorted arrays, so that a shuffle moves bytes and not
rows.  Values that repeat within a file are combined before they are sent, so
no value, however common, reaches a task more often than there are files.

A task writes its file under a name of its own attempt; only the manifest, which
Spark commits, tells which files count.  A lost executor costs a repeated task.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import arrow_schema, partitions, record, shared_path, trim

#: Bytes of text of a file, about.
CHUNK_BYTES = 32_000_000
#: Values that a task of ``by_part`` gets, about.
PART_VALUES = 2_000_000
MANIFEST = "file long, path string, rows long, total long"
#: A document's number is its file's number times this, plus its row there.
ROWS = 1 << 24
BLOB = "part int, file long, data binary"
INFO = "file long, part int, data binary, x long, y long"


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed where that helps."""
    meta, parts = [], []
    z = zstandard.ZstdCompressor(level=1)
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        small = z.compress(raw)
        use = len(small) < 0.95 * len(raw)
        parts.append(small if use else raw)
        meta.append((name, a.dtype.str, len(parts[-1]), use))
    head = json.dumps(meta).encode()
    return struct.pack("<I", len(head)) + head + b"".join(parts)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    at, out, z = 4 + n, {}, zstandard.ZstdDecompressor()
    for name, dtype, size, used in json.loads(bytes(data[4 : 4 + n])):
        raw = memoryview(data)[at : at + size]
        out[name] = np.frombuffer(z.decompress(raw) if used else raw, dtype)
        at += size
    return out


def deltas(values: np.ndarray) -> np.ndarray:
    """Ascending values as differences, in 32 bits where they fit."""
    d = np.diff(values, prepend=values.dtype.type(0))
    if len(d) and d[1:].max(initial=0) < 2**32:
        return np.concatenate([d[:1].view(np.uint32), d[1:].astype(np.uint32)])
    return d


def undeltas(d: np.ndarray) -> np.ndarray:
    if d.dtype == np.uint32 and len(d):
        d = np.concatenate([d[:2].view(np.uint64), d[2:].astype(np.uint64)])
    return np.cumsum(d, dtype=np.uint64)


def narrow(values: np.ndarray) -> np.ndarray:
    """The low six of each value's eight bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def widen(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def ids_of(column: pa.Array) -> np.ndarray:
    from ._common import NO_ID

    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def write(docs: DataFrame, fn: Callable[[list[pa.RecordBatch]], tuple[dict, int]], what: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Files of about ``size`` bytes of text; ``fn`` gives a chunk's arrays and a total. Returns the manifest.

    ``docs`` has a column text; a chunk holds whole rows, at most 2**24 of them.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, what)
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{at}/data", recursive=True)
    schema, text = arrow_schema(MANIFEST), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        fs, at = pafs.FileSystem.from_uri(folder)

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            payload, total = fn(held)
            name = f"data/{task:06d}-{k}-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(pack(**payload))
            return record({"file": [(task << 12) | k], "path": [f"{folder}/{name}"], "rows": [sum(b.num_rows for b in held)], "total": [total]}, schema)

        held: list[pa.RecordBatch] = []
        got = rows = 0
        for b in batches:
            for i, j, data, _ in _words.slices(b.column(text)):
                for u in range(i, j, ROWS // 2):
                    v = min(j, u + ROWS // 2)
                    if held and (got + len(data) > size or rows + v - u > ROWS):
                        yield flush(held)
                        held, got, rows, k = [], 0, 0, k + 1
                    held.append(b.slice(u, v - u))
                    rows += v - u
                    got += len(data) if u == i else 0
        if held:
            yield flush(held)
        held = []
        trim()

    path = f"{folder}/manifest"
    docs.mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def load(path: str) -> dict[str, np.ndarray]:
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(p) as f:
        return unpack(f.read())


def by_file(manifest: DataFrame, tasks: int, info: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
    """``fn(file, path, blobs by part, x and y of the rows without a blob) -> dicts of columns`` for every file."""
    own = manifest.selectExpr("file", "-1 as part", "cast(path as binary) as data", "cast(null as long) as x", "cast(null as long) as y")
    rows = own if info is None else own.union(info.select("file", "part", "data", "x", "y"))
    spread = rows.withColumn("p", F.expr(f"cast(pmod((file >> 12) + 7919 * (file & 4095), {max(1, tasks)}) as int)"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, blobs, xs, ys = None, None, {}, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if file is not None:
                x = np.concatenate(xs) if xs else np.zeros(0, np.int64)
                y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
                for out in fn(file, path, blobs, x, y):
                    yield record(out, arrow)

        for b in batches:
            files = b.column("file").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if files[i] != file:
                    yield from done()
                    trim()
                    file, path, blobs, xs, ys = int(files[i]), None, {}, [], []
                part = b.column("part").slice(i, j - i).to_numpy()
                plain = part == -2
                if plain.any():
                    xs.append(b.column("x").slice(i, j - i).filter(pa.array(plain)).to_numpy())
                    ys.append(b.column("y").slice(i, j - i).filter(pa.array(plain)).to_numpy())
                for k in np.flatnonzero(~plain).tolist():
                    data = b.column("data")[i + k].as_py()
                    if part[k] == -1:
                        path = data.decode()
                    else:
                        blobs[int(part[k])] = data
        yield from done()
        trim()

    return spread.repartitionById(max(1, tasks), F.col("p")).sortWithinPartitions("file", "part").select("file", "part", "data", "x", "y").mapInArrow(run, schema)


def by_part(blobs: DataFrame, parts: int, fn: Callable, schema: str) -> DataFrame:
    """``fn(part, files, arrays of their blobs) -> dicts of columns`` for every range of hash values."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, data, part = [], [], 0
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
                files += b.column("file").to_pylist()
                data += [unpack(x) for x in b.column("data").to_pylist()]
        if files:
            for out in fn(part, files, data):
                yield record(out, arrow)
        files = data = None
        trim()

    return blobs.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def parts_for(spark, values: int) -> int:
    """How many ranges of hash values: as many as the session's partitions, more for more values."""
    return max(partitions(spark), math.ceil(values / PART_VALUES))


def cuts(values: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where in ascending values of ``bits`` bits each part begins, and their end.

    Edges are multiples of 32, so that values that differ in their low five bits only share a part.
    """
    edges = np.array([(p << bits) // parts & ~31 for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def value_blobs(file: int, values: np.ndarray, counts: np.ndarray, parts: int, bits: int) -> dict:
    """Rows of ``BLOB`` with a file's distinct ascending values and how often each occurs there."""
    at = cuts(values, parts, bits)
    use = [p for p in range(parts) if at[p] < at[p + 1]]
    small = np.minimum(counts, 255).astype(np.uint8)
    return {"part": use, "file": [file] * len(use), "data": [pack(v=deltas(values[at[p] : at[p + 1]]), c=small[at[p] : at[p + 1]]) for p in use]}


def counted(part: int, files: list[int], data: list[dict]) -> Iterator[dict]:
    """For each value of a part's blobs, in its order, the binary logarithm of how often it occurs in all files."""
    values = [undeltas(d["v"]) for d in data]
    all_values = np.concatenate(values)
    counts = np.concatenate([d["c"] for d in data]).astype(np.int64)
    order = np.argsort(all_values, kind="stable")
    s = all_values[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    level = np.log2(np.add.reduceat(counts[order], begin)).astype(np.uint8)
    out = np.empty(len(s), np.uint8)
    out[order] = np.repeat(level, np.diff(np.append(begin, len(s))))
    at = np.cumsum([0, *map(len, values)])
    n = len(files)
    yield {"file": files, "part": [part] * n, "data": [pack(q=out[at[i] : at[i + 1]]) for i in range(n)], "x": [None] * n, "y": [None] * n}


def tally(blobs: DataFrame, parts: int) -> DataFrame:
    """Rows of ``INFO`` with what ``counted`` gives for the values of every file."""
    return by_part(blobs, parts, counted, INFO)


def levels(blobs: dict[int, bytes]) -> np.ndarray:
    """What ``tally`` gave back for a file's distinct values, in their order."""
    got = [unpack(blobs[p])["q"] for p in sorted(blobs)]
    return np.concatenate(got) if got else np.zeros(0, np.uint8)
