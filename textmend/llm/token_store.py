"""Token ids in binary shards: every document its own frame under one shared dictionary.

``write_tokens`` encodes whole texts, appends the end id, compresses the ids of
each document alone with a zstandard dictionary trained on serialised id arrays
and writes shards in ascending ``doc_id`` order.  A shard is::

    magic "TIDS1\\n", id width (1 byte), SHA-256 of the dictionary (32 bytes)
    frames, one after another
    index: per document doc_id int64, id count uint64, end offset of its frame uint64
    documents uint64, offset of the index uint64, magic

so one document is read with its index entry and one ranged read.  The
dictionary lies beside the shards as ``<sha256>.zdict``; a reader refuses a
shard whose hash it does not have.

Cases: a null text is an empty one and holds the end id alone; a null
``doc_id`` comes first; rows that repeat a ``doc_id`` are kept, ordered by a
hash of their text; an empty table gives no shard; other columns are ignored.

Scale: texts are encoded where they are scanned and only compressed frames are
shuffled, to ranges of ids found from the id column alone.  Tasks write under a
name of their own attempt and only the manifest, committed by Spark, names the
shards that count, so a lost executor or a repeated attempt leaves no trace in
the result.  The dictionary is trained on ``sample`` documents chosen by hash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _bpe
from ._common import NO_ID, arrow_schema, documents, record, shard_of, shared_path, shards

MAGIC = b"TIDS1\n"
HEAD = len(MAGIC) + 1 + 32
INDEX = np.dtype([("doc_id", "<i8"), ("count", "<u8"), ("end", "<u8")])
#: Documents whose serialised ids train the dictionary, and the dictionary's size.
SAMPLE, DICTIONARY_BYTES = 1024, 65_536
#: Documents of a shard.
SHARD_DOCUMENTS = 20_000
LEVEL = 3


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the documents with the lowest id hashes; empty where they are too few to train one."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    wanted = [r[0] for r in ids.collect()]
    if not wanted:
        return b""

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _bpe.encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            for _, texts in _bpe.groups([t or "" for t in b.column(0).to_pylist()]):
                # a document longer than the window of a dictionary can't add to it
                yield pa.RecordBatch.from_pydict({"ids": pa.array([(x + end)[: 2 * size] for x in e.encode(texts)], pa.binary())})

    samples = sorted(r[0] for r in docs.where(F.col("doc_id").isin(wanted)).select("text").mapInArrow(serialised, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, [bytes(s) for s in samples], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


@dataclass
class TokenStore:
    """A written store: its folder, dictionary hash and manifest (shard, path, documents, ids before it)."""

    spark: SparkSession
    folder: str
    digest: str
    manifest: DataFrame

    def read(self) -> DataFrame:
        """Every document from the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian)."""
        return self._scan(with_ids=True)

    def summary(self) -> DataFrame:
        """As ``read`` without the ids."""
        return self._scan(with_ids=False)

    def _scan(self, with_ids: bool) -> DataFrame:
        ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        schema, folder, digest = arrow_schema(ddl), self.folder, self.digest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                    for rows in read_shard(path, folder, digest, with_ids):
                        n = np.asarray(rows["n_tokens"], dtype=np.int64)
                        rows["start"] = before + np.cumsum(n) - n
                        before += int(n.sum())
                        yield record(rows, schema)

        tasks = max(1, min(self.manifest.count(), 100_000))
        return self.manifest.select("shard", "path", "before").repartitionByRange(tasks, "shard").mapInArrow(run, ddl)


def read_dictionary(folder: str, digest: str) -> zstandard.ZstdCompressionDict | None:
    fs, path = _open(f"{folder}/{digest}.zdict")
    with fs.open_input_file(path) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary {digest} in {folder} is damaged")
    return zstandard.ZstdCompressionDict(data) if data else None


def _index(f, digest: str) -> tuple[np.ndarray, np.dtype]:
    head = f.read_at(HEAD, 0)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :].hex() != digest:
        raise ValueError("no shard of this store: magic or dictionary hash differs")
    size = f.size()
    tail = f.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
    n, at = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
    index = np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX)
    return index, np.dtype(f"<u{head[len(MAGIC)]}")


def read_document(path: str, folder: str, digest: str, position: int) -> np.ndarray:
    """Ids of one document of a shard, by its position in the index; reads only its frame."""
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        index, dtype = _index(f, digest)
        begin = int(index["end"][position - 1]) if position else HEAD
        frame = f.read_at(int(index["end"][position]) - begin, begin)
    d = read_dictionary(folder, digest)
    data = zstandard.ZstdDecompressor(**({"dict_data": d} if d else {})).decompress(frame)
    return np.frombuffer(data, dtype)


def read_shard(path: str, folder: str, digest: str, with_ids: bool, chunk: int = 1000) -> Iterator[dict]:
    d = read_dictionary(folder, digest)
    decompress = zstandard.ZstdDecompressor(**({"dict_data": d} if d else {})).decompress
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        index, dtype = _index(f, digest)
        begin = HEAD
        for i in range(0, len(index), chunk):
            rows = index[i : i + chunk]
            block = memoryview(f.read_at(int(rows["end"][-1]) - begin, begin))
            at, crc, ids = 0, [], []
            for count, end in zip(rows["count"].tolist(), rows["end"].tolist(), strict=True):
                data = decompress(block[at : end - begin])
                if len(data) != count * dtype.itemsize:
                    raise ValueError(f"{path}: a document has another length than its index says")
                crc.append(zlib.crc32(np.frombuffer(data, dtype).astype("<u4").tobytes()))
                if with_ids:
                    ids.append(data)
                at = end - begin
            begin = int(rows["end"][-1])
            out = {"doc_id": pa.array([None if x == NO_ID else x for x in rows["doc_id"].tolist()], pa.int64()), "n_tokens": rows["count"].astype(np.int64), "ids_crc32": crc}
            yield out | ({"ids": ids} if with_ids else {})


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, sample: int = SAMPLE, shard_documents: int = SHARD_DOCUMENTS) -> TokenStore:
    """Write ``docs`` (doc_id, text) as a token store; see the module for format and cases."""
    spark, docs = docs.sparkSession, documents(docs)
    folder = folder or shared_path(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer, end_id, sample)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{digest}.zdict") as f:
        f.write(dictionary)
    bounds = shards(docs, shard_documents)
    key = F.coalesce("doc_id", F.lit(NO_ID))
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _bpe.encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **({"dict_data": d} if d else {})).compress
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, part in _bpe.groups(texts):
                ids = [x + end for x in e.encode(part)]
                cut = b.slice(i, len(part))
                yield pa.RecordBatch.from_arrays([cut.column("shard"), cut.column("k"), cut.column("tie"), pa.array([len(x) // e.dtype.itemsize for x in ids], pa.int64()), pa.array([compress(x) for x in ids], pa.binary())], names=["shard", "k", "tie", "n", "frame"])

    coded = docs.select(shard_of(key, bounds).alias("shard"), key.alias("k"), F.xxhash64("text").alias("tie"), "text").mapInArrow(frames, "shard int, k long, tie long, n long, frame binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        out, index, shard, pos, path = None, [], 0, HEAD, ""
        for b in batches:
            if b.num_rows == 0:
                continue
            if out is None:
                shard = b.column("shard")[0].as_py()
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tids"
                out = fs.open_output_stream(f"{at}/{path.rpartition('/')[2]}")
                out.write(MAGIC + bytes([_bpe.encoder(tokenizer).dtype.itemsize]) + bytes.fromhex(digest))
            data = b.column("frame").to_pylist()
            sizes = np.array([len(x) for x in data], dtype=np.uint64)
            rows = np.zeros(b.num_rows, INDEX)
            rows["doc_id"], rows["count"] = b.column("k").to_numpy(), b.column("n").to_numpy()
            rows["end"] = pos + np.cumsum(sizes)
            pos = int(rows["end"][-1])
            out.write(b"".join(data))
            index.append(rows)
        if out is not None:
            all_rows = np.concatenate(index)
            out.write(all_rows.tobytes())
            out.write(np.array([len(all_rows), pos], "<u8").tobytes() + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(all_rows)], pa.int64()), pa.array([int(all_rows["count"].sum())], pa.int64())], names=["shard", "path", "documents", "ids"])

    ordered = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("k", "tie", "frame")
    ordered.mapInArrow(write, "shard int, path string, documents long, ids long").write.parquet(f"{folder}/manifest")
    # one row per shard: a running sum over them is small however large the store is
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    manifest = spark.read.schema("shard int, path string, documents long, ids long").parquet(f"{folder}/manifest").select("shard", "path", "documents", "ids", before)
    return TokenStore(spark, folder, digest, manifest)
