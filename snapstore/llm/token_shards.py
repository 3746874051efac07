"""Token ids in binary shard files: one zstandard frame a document, one dictionary for all of them.

Layout of a data set (a folder): ``dictionary`` (the zstandard dictionary, trained on serialised id arrays of a
bounded sample), one ``shard-<n>`` file for each range of document ids, in ascending order, and the table
``manifest`` with one row a shard, which names its file.  A shard is

    magic | hash of the dictionary (32 bytes) | frames ... | index | places of the index | magic

and its index holds, for each document, the id, the place and length of its frame, and the ids before it in the
shard, so a document is read with two short reads.  Each attempt of a task writes a file of its own name; the manifest
holds the files of the attempts that Spark has committed, and all others are deleted at the end.  Nothing is renamed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import memo_of
from .workspace import batches, lean, new_path, ship

MAGIC = b"TIDSHRD1"
_INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("start", "<u8"), ("n", "<u4")])
_FOOT = struct.Struct("<QQ8s")


def open_store(uri: str):
    """A pyarrow file system and the path in it; local paths, and any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes.

    Where the library finds too little to train on, the samples' own last bytes are the dictionary (a raw-content
    dictionary, as zstandard takes it); of no samples at all it is four zero bytes.
    """
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or bytes(4)


def _codec(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


class ShardWriter:
    """Writes one shard; ``close`` returns the number of documents and of ids."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        self.store, path = open_store(uri)
        self.store.create_dir(path, recursive=True)
        self.out = self.store.open_output_stream(f"{path}/{name}")
        self.pack = _codec(dictionary)[0]
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at, self.ids, self.index = len(MAGIC) + 32, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray, width: str) -> None:
        frame = self.pack.compress(ids.astype(width).tobytes())
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), self.ids, len(ids)))
        self.at, self.ids = self.at + len(frame), self.ids + len(ids)

    def close(self) -> tuple[int, int]:
        index = np.array(self.index, dtype=_INDEX)
        self.out.write(index.tobytes() + _FOOT.pack(self.at, len(index), MAGIC))
        self.out.close()
        return len(index), self.ids


class ShardReader:
    """Reads single documents (``get``) or all of them in order (``scan``), without loading the shard."""

    def __init__(self, uri: str, name: str, width: str = "<u2"):
        store, path = open_store(uri)
        with store.open_input_file(f"{path}/dictionary") as f:
            dictionary = f.read()
        self.file, self.width = store.open_input_file(f"{path}/{name}"), width
        end = self.file.size()
        at, n, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, end - _FOOT.size))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a shard")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(n * _INDEX.itemsize, at), dtype=_INDEX)
        self.unpack = _codec(dictionary)[1]

    def ids(self, k: int) -> np.ndarray:
        entry = self.index[k]
        return np.frombuffer(self.unpack.decompress(self.file.read_at(int(entry["length"]), int(entry["offset"]))), dtype=self.width)

    def get(self, doc_id: int) -> np.ndarray:
        nulls = int(self.index["is_null"].sum())  # they come first
        k = nulls + int(np.searchsorted(self.index["doc_id"][nulls:], doc_id))
        if k == len(self.index) or self.index[k]["doc_id"] != doc_id:
            raise KeyError(doc_id)
        return self.ids(k)

    def scan(self):
        for k, entry in enumerate(self.index):
            yield None if entry["is_null"] else int(entry["doc_id"]), int(entry["start"]), self.ids(k)


_MANIFEST = "shard long, file string, first long, docs long, ids long"


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, target: str | None = None, end_id: int = 0, shard_bytes: int = 16 << 20, sample_docs: int = 512, sample_bytes: int = 8 << 20, dictionary_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode every text whole, append ``end_id``, write shards in ascending id order; returns the folder.

    The dictionary learns from at most ``sample_docs`` documents (smallest hash of the id) and ``sample_bytes``
    bytes; every document is written with it.  Null texts count as empty (the end id alone); rows with a null id
    come first; repeated ids are written each, in the order of their texts; an empty table gives a data set without
    shards; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    target = target or new_path(spark, "token_shards")
    path = tokenizer_path
    width = "<u2" if len(memo_of(path).tokenizer.get_vocab()) <= 1 << 16 else "<u4"
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def encoded(source):
        memo = memo_of(path)
        for batch in batches(source, "text"):
            ids = memo.encode_all(batch.column("text").to_pylist())
            yield batch.column("id").to_pylist(), [np.frombuffer(b + end_id.to_bytes(4, "little"), "<u4") for b in ids]

    def sampled(source):
        for _, ids in encoded(source):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(width).tobytes() for x in ids], pa.binary())], ["ids"])

    n_rows, n_bytes = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chosen = slim.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_docs) if n_rows > sample_docs else slim.select("id")
    chosen_ids = [r[0] for r in chosen.distinct().collect()]
    rows = slim.where(F.col("id").isin([i for i in chosen_ids if i is not None])).mapInArrow(lean(sampled), "ids binary").limit(sample_docs)
    samples, held = [], 0
    for r in rows.toLocalIterator():
        samples.append(bytes(r["ids"]))
        held += len(samples[-1])
        if held >= sample_bytes:
            break
    dictionary = train_dictionary(samples, dictionary_bytes)
    store, folder = open_store(target)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/dictionary") as f:
        f.write(dictionary)

    def write(source):
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}"
        for ids, arrays in encoded(source):
            writer = writer or ShardWriter(target, name, dictionary)
            for doc_id, array in zip(ids, arrays, strict=True):
                writer.add(doc_id, array, width)
        if writer:
            n, total = writer.close()
            first = None if writer.index[0][1] else writer.index[0][0]
            own = ((shard, pa.int64()), (name, pa.string()), (first, pa.int64()), (n, pa.int64()), (total, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in own], ["shard", "file", "first", "docs", "ids"])

    parts = max(1, -(-n_bytes // shard_bytes), min(spark.sparkContext.defaultParallelism, n_rows // 256))
    ordered = slim.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(lean(write), _MANIFEST).write.mode("overwrite").parquet(f"{target}/parts")
    # one row a shard; ranges of ids don't overlap, so the first id orders them
    before = F.coalesce(F.sum("ids").over(Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = spark.read.schema(_MANIFEST).parquet(f"{target}/parts").withColumn("start", before).withColumn("width", F.lit(width))
    manifest.write.mode("overwrite").parquet(f"{target}/manifest")
    committed = {r["file"] for r in spark.read.parquet(f"{target}/manifest").select("file").collect()}
    from pyarrow import fs

    for left in store.get_file_info(fs.FileSelector(folder)):
        if left.base_name.startswith("shard-") and left.base_name not in committed:
            store.delete_file(left.path)
    return target


def _shards(spark: SparkSession, target: str) -> DataFrame:
    """One row a shard, one shard a task, as far as hashing deals them out evenly."""
    ship(spark)
    manifest = spark.read.schema(f"{_MANIFEST}, start long, width string").parquet(f"{target}/manifest")
    return manifest.repartitionByRange(max(1, manifest.count()), "shard")


def _documents(target: str, source, row_of, most: int = 1 << 20):
    """Lists of ``row_of(doc_id, start, ids)`` of all documents of the shards, of about ``most`` bytes of ids each."""
    for batch in source:
        for shard in batch.to_pylist():
            rows, held = [], 0
            for doc_id, start, ids in ShardReader(target, shard["file"], shard["width"]).scan():
                rows.append(row_of(doc_id, shard["start"] + start, ids.astype("<u4")))
                held += 4 * len(ids)
                if held >= most:
                    yield rows
                    rows, held = [], 0
            if rows:
                yield rows


def read_token_shards(spark: SparkSession, target: str) -> DataFrame:
    """Every document of a data set, read back: ``doc_id``, ``start`` (ids before it), ``ids`` (little-endian unsigned 32
    bit).  Null and repeated ids come back as they were written; a data set without shards gives no rows; a shard that
    was written with another dictionary is an error."""

    def read(source):
        for rows in _documents(target, source, lambda d, s, ids: (d, s, ids.tobytes())):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "ids"])

    return _shards(spark, target).mapInArrow(lean(read), "doc_id long, start long, ids binary")


def shard_digests(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from its shard, in one Python stage; rows as
    ``read_token_shards`` gives them."""

    def read(source):
        for rows in _documents(target, source, lambda d, s, ids: (d, s, len(ids), zlib.crc32(ids.tobytes()))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _shards(spark, target).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
