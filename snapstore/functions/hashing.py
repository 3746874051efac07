"""Object identities as column expressions: SHA-256 over a header and the body's bytes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _nul() -> Column:
    return F.unhex(F.lit("00"))


def binary(c: Column) -> Column:
    """Text as UTF-8 bytes; bytes as they are."""
    return c.cast("binary")


def payload(kind: str, body: Column) -> Column:
    """``<kind> <length in bytes>`` NUL body."""
    body = binary(body)
    return F.concat(binary(F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string"))), _nul(), body)


def object_hash(kind: str, body: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of an object; null for a null body."""
    return F.sha2(payload(kind, body), 256)


def blob_hash(content: Column) -> Column:
    return object_hash("blob", content)


def entry_hex(mode: Column, name: Column, hash_: Column) -> Column:
    """A tree entry's bytes, as upper-case hexadecimal text: mode, space, name, NUL, the 32 raw hash bytes."""
    return F.concat(F.hex(binary(F.concat(mode, F.lit(" "), name))), F.lit("00"), F.upper(hash_))


def checked_unhex(c: Column) -> Column:
    """Bytes of hexadecimal text; odd length or a bad digit is an error."""
    return F.when(c.isNull(), None).when((F.length(c) % 2 == 0) & F.unhex(c).isNotNull(), F.unhex(c)).otherwise(F.raise_error(F.concat(F.lit("not hexadecimal: "), c)).cast("binary"))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def object_path(hash_: Column) -> Column:
    """Where an object of this hash lies: two characters, slash, the rest; null for hashes shorter than two."""
    return F.when(F.length(hash_) >= 2, F.concat_ws("/", F.substring(hash_, 1, 2), hash_.substr(F.lit(3), F.length(hash_))))


@F.pandas_udf(T.BinaryType())
def deflate(content: pd.Series) -> pd.Series:
    """zlib stream at the default level; Spark has no built-in for it.  Used for byte-level export only."""
    return content.map(lambda b: None if b is None else zlib.compress(bytes(b)))


@F.pandas_udf(T.BinaryType())
def inflate(stream: pd.Series) -> pd.Series:
    """The bytes of a zlib stream, in steps of 32 KiB; a damaged or cut stream is an error."""

    def one(b):
        if b is None:
            return None
        reader, out = zlib.decompressobj(), []
        for k in range(0, len(b), 32768):
            out.append(reader.decompress(bytes(b[k : k + 32768])))
        out.append(reader.flush())
        if not reader.eof:
            raise ValueError("the zlib stream is cut off")
        return b"".join(out)

    return stream.map(one)
