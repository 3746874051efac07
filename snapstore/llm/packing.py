"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are dealt to groups by a seeded hash of the id; each group is packed by itself, so packing needs one
shuffle (of the texts) and a task never holds more than one group.  A document longer than a sequence gives full
sequences and one remainder; remainders are placed first-fit in decreasing order.  At the end of a group the
least filled sequences are taken apart and their ids fill the gaps of the others (``fill_gaps``), so a group pads
one sequence at most, up to what its ids leave over.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import memo_of
from .workspace import batches, lean, ship


class CapacityTree:
    """A tournament tree: each match is won by the larger free capacity; first fit goes down from the root."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.free = [capacity] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """The leftmost bin with ``length`` free; it is taken.  -1 if there is none."""
        free = self.free
        if free[1] < length:
            return -1
        node = 1
        while node < self.size:
            node *= 2
            if free[node] < length:
                node += 1
        found = node - self.size
        free[node] -= length
        while node > 1:
            node //= 2
            winner = max(free[2 * node], free[2 * node + 1])
            if free[node] == winner:
                break
            free[node] = winner
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin; items in decreasing length, ties in the order given."""
    tree, bins = CapacityTree(len(lengths), capacity), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.first_fit(lengths[k])
        while len(bins) <= found:
            bins.append([])
        bins[found].append(k)
    return bins


def pack_group(lengths: list[int], capacity: int, fill_gaps: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); every id of every document lies in one piece."""
    out, rest = [], []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append([(d, k * capacity, capacity)])
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([p[2] for p in rest], capacity)]
    if fill_gaps and bins:
        full = lambda b: sum(p[2] for p in b)
        bins.sort(key=full, reverse=True)
        least = -(-sum(map(full, bins)) // capacity)
        loose = [p for b in bins[least:] for p in b]
        bins = bins[:least]
        for b in bins:
            gap = capacity - full(b)
            while gap and loose:
                d, start, n = loose.pop()
                b.append((d, start, min(gap, n)))
                if n > gap:
                    loose.append((d, start + gap, n - gap))
                gap -= min(gap, n)
    return out + bins


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, group_docs: int = 512, group_ids: int = 1 << 21, seed: int = 7, fill_gaps: bool = True, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32`` (of the piece's ids), ``doc_tokens``, ``sequence_id``,
    ``offset``, and with ``keep_ids`` the ``ids`` themselves.

    Every text is encoded whole and gets ``end_id``; null texts count as empty (the end id alone).  Groups have
    about ``group_docs`` documents by a seeded hash of id and text; a group that repeated rows or long texts make larger
    is cut at 2 x ``group_docs`` documents or ``group_ids`` ids, so memory is bounded by both (and by one document).
    Rows with a null id are packed like others; repeated rows are packed each; an empty table gives an empty result;
    other columns are not read.  Encoding, packing and digests are one Python stage: a task has one worker.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer_path
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n, n_bytes = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // group_docs))
    grouped = slim.withColumn("grp", F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(groups)))
    parts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // (16 << 20)), 1)
    dealt = grouped.repartition(min(groups, parts), "grp").sortWithinPartitions("grp", "id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    kinds = [*[pa.int64()] * 7, *([pa.binary()] if keep_ids else [])]

    def pack(source):
        memo, current, base, held, held_ids = memo_of(path), None, 0, [], 0

        def leave() -> Iterable[pa.RecordBatch]:
            nonlocal base, held_ids
            sequences = pack_group([len(x[1]) // 4 for x in held], capacity, fill_gaps)
            rows = []
            for k, pieces in enumerate(sequences):
                at = 0
                for d, start, n in pieces:
                    doc_id, ids = held[d]
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(own), len(ids) // 4, (current << 32) + base + k, at, *([own] if keep_ids else [])))
                    at += n
            base += len(sequences)
            held.clear()
            held_ids = 0
            for k in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names)

        for batch in batches(source, "text"):
            encoded = memo.encode_all(batch.column("text").to_pylist())
            for group, doc_id, ids in zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist(), encoded, strict=True):
                if group != current or len(held) >= 2 * group_docs or held_ids >= group_ids:
                    if held:
                        yield from leave()
                    if group != current:
                        current, base = group, 0
                held.append((doc_id, ids + end_id.to_bytes(4, "little")))
                held_ids += len(ids) // 4 + 1
        if held:
            yield from leave()

    packed = dealt.mapInArrow(lean(pack), ", ".join(f"{c} long" for c in names[:7]) + ", ids binary" * keep_ids)
    return packed.withColumnRenamed("doc_id", id_col)


def ids_of(piece: bytes) -> list[int]:
    """The ids of a piece's bytes."""
    return array("I", piece).tolist() if piece else np.array([], dtype="u4").tolist()
