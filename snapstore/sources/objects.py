"""Objects as bytes: decoding payloads, and import and export of zlib-compressed object files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commits import parse_commit
from ..functions.hashing import deflate, inflate, object_path
from ..plans.lineage import ship


def header_kind(payload: Column) -> Column:
    return F.substring_index(F.decode(F.substring(payload, 1, 16), "ISO-8859-1"), " ", 1)


def body_of(payload: Column) -> Column:
    """The bytes after the first NUL; a payload without one is an error."""
    at = F.instr(F.decode(payload, "ISO-8859-1"), "\x00")
    return F.when(at > 0, F.substring(payload, at + 1, F.octet_length(payload))).otherwise(F.raise_error(F.lit("object without a header")).cast("binary"))


def decode_blobs(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type") == "blob").select("hash", body_of(F.col("payload")).alias("content"))


def decode_commits(objects: DataFrame) -> DataFrame:
    text = F.decode(body_of(F.col("payload")), "UTF-8")
    return objects.where(F.col("type") == "commit").select("hash", parse_commit(text).alias("c")).select("hash", "c.*")


def _entries(payload: bytes) -> Iterator[tuple[str, str, str]]:
    at = payload.index(b"\x00") + 1
    while at < len(payload):
        space = payload.find(b" ", at)
        nul = payload.find(b"\x00", space)
        if space < 0 or nul < 0 or nul + 33 > len(payload):
            return  # malformed rest: what came before counts
        yield payload[at:space].decode(), payload[space + 1 : nul].decode("utf-8", "surrogateescape"), payload[nul + 1 : nul + 33].hex()
        at = nul + 33


def decode_trees(objects: DataFrame) -> DataFrame:
    """Tree objects as ``tree_entries``; binary records have no built-in reader, so this is an Arrow function."""

    ship(objects.sparkSession)

    def run(source):
        for batch in source:
            rows = [(h, k, m, n, x, m == "040000") for h, p in zip(batch.column("hash").to_pylist(), batch.column("payload").to_pylist(), strict=True) for k, (m, n, x) in enumerate(_entries(p))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["tree_hash", "pos", "mode", "name", "hash", "is_subtree"])

    return objects.where(F.col("type") == "tree").select("hash", "payload").mapInArrow(run, "tree_hash string, pos int, mode string, name string, hash string, is_subtree boolean")


def export_objects(objects: DataFrame) -> DataFrame:
    """``object_path`` and the zlib stream of each object."""
    ship(objects.sparkSession)
    return objects.select(object_path(F.col("hash")).alias("object_path"), deflate(F.col("payload")).alias("stream"))


def import_objects(files: DataFrame) -> DataFrame:
    """``object_path``, ``stream`` -> objects."""
    ship(files.sparkSession)
    rows = files.select(F.regexp_replace("object_path", "/", "").alias("hash"), inflate(F.col("stream")).alias("payload"))
    return rows.select("hash", header_kind(F.col("payload")).alias("type"), F.octet_length(body_of(F.col("payload"))).cast("bigint").alias("size"), "payload")
