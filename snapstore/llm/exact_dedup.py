"""Exact de-duplication by Patricia-trie owners.

Texts are dealt out by length and content hash to ``cells``; each cell has one compressed radix trie over whole byte
strings, so shared beginnings are stored once.  A terminal node stores the owner (smallest or largest id), the number
of copies and the keys of the rows that wait for it.

1. *Local pass* (no shuffle): each input task inserts its texts; every row leaves at once with the key of its
   terminal, so of any number of equal texts in a task one representative goes on.           [scratch table]
2. *Global pass*: representatives only, dealt out by cell and sorted by cell and text, meet in the same kind of
   trie; its terminals name the owner of the whole group.
3. Every document looks its owner up through its representative.

Equality is decided by walking whole byte strings, never by the hash.  When a task holds ``memory`` bytes of nodes,
the heaviest subtrees are spilled until half is left, and the others stay.  In the local pass a spilled subtree's
terminals leave as representatives (a text that comes again gets another one; the global pass merges them).  In the
global pass rows come sorted, so every subtree beside the path of the last text is complete: it leaves with its
owners, and what stays is bounded by ``memory`` and one text.  The spill medium is the tasks' own output, never a local
file.  A group that holds a third of all rows sends a few rows per input task to the global pass.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, lower_ascii, materialise, ship

#: Estimated bytes of a node without its label, and of one waiting key.
NODE_BYTES, KEY_BYTES = 320, 40


class Node:
    """An edge label, the children by their first byte, and the terminal's state if a string ends here (``rows``)."""

    __slots__ = ("children", "copies", "label", "owner", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies, self.rows = label, {}, None, 0, None

    def held(self) -> int:
        return NODE_BYTES + len(self.label) + KEY_BYTES * len(self.rows or ())


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two byte strings."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


class Tries:
    """One compressed radix trie per cell, with spill by subtree; ``held`` estimates the bytes of all nodes."""

    def __init__(self):
        self.roots: dict[int, Node] = {}
        self.held = 0

    def terminal(self, cell: int, key: bytes) -> Node:
        """The node at which ``key`` ends, made if there is none; a new terminal has no waiting rows yet."""
        node, at = self.roots.get(cell), 0
        if node is None:
            node = self.roots[cell] = Node(b"")
            self.held += node.held()
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += child.held()
            elif not key.startswith(child.label, at):
                same = common_length(child.label, key[at : at + len(child.label)])
                upper, child.label = Node(child.label[:same]), child.label[same:]
                upper.children[child.label[0]] = child
                node.children[upper.label[0]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + len(child.label)
        return node

    def wait(self, node: Node, row: int) -> None:
        """``row`` waits at a terminal for its owner."""
        node.rows = node.rows or []
        node.rows.append(row)
        self.held += KEY_BYTES

    def spill(self, target: int, last: tuple[int, bytes] | None = None) -> Iterator[tuple[int, bytes, Node]]:
        """Detach the heaviest subtrees until ``target`` bytes are left, and give (cell, string, terminal) of each.

        A subtree of more than ``target`` bytes is opened rather than taken whole; nodes on the path to ``last`` stay.
        """
        weights, stay = self._weights(), self._path(*last) if last else set()
        heap = [(-weights[id(root)], k, cell, b"", None, root) for k, (cell, root) in enumerate(self.roots.items())]
        heapq.heapify(heap)
        pushed = len(heap)
        while heap and self.held > target:
            weight, _, cell, before, parent, node = heapq.heappop(heap)
            if id(node) in stay or (-weight > target and node.children):
                for child in node.children.values():
                    pushed += 1
                    heapq.heappush(heap, (-weights[id(child)], pushed, cell, before + node.label, node, child))
                continue
            if parent is None:
                del self.roots[cell]
            else:
                del parent.children[node.label[0]]
            self.held += weight
            yield from _terminals(cell, before, node)

    def drain(self) -> Iterator[tuple[int, bytes, Node]]:
        """All cells, strings and terminals; nothing is left."""
        roots, self.roots, self.held = self.roots, {}, 0
        for cell, root in roots.items():
            yield from _terminals(cell, b"", root)

    def _path(self, cell: int, key: bytes) -> set[int]:
        node, at, seen = self.roots[cell], 0, set()
        while node is not None:
            seen.add(id(node))
            at += len(node.label)
            node = node.children.get(key[at]) if at < len(key) else None
        return seen

    def _weights(self) -> dict[int, int]:
        nodes = list(self.roots.values())
        for node in nodes:  # grows while it is read: parents come before their children
            nodes.extend(node.children.values())
        weights: dict[int, int] = {}
        for node in reversed(nodes):
            weights[id(node)] = node.held() + sum(weights[id(c)] for c in node.children.values())
        return weights


def _terminals(cell: int, before: bytes, node: Node) -> Iterator[tuple[int, bytes, Node]]:
    stack = [(before, node)]
    while stack:
        before, node = stack.pop()
        text = before + node.label
        if node.rows is not None:
            yield cell, text, node
        stack.extend((text, child) for child in node.children.values())


def _record_batches(rows, kinds: dict, size) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``, cut at 2000 rows or 1 MB of what ``size`` gives."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) == 2000 or weight >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", content_hash: Column | None = None, cells: int | None = None, memory: int = 48 << 20) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text).

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty.  Of equal texts the
    row with the smallest (or largest) id stays.  A null id never owns a group that has another id (it sorts last);
    in a group of null ids only, ``keep_id`` is null and all of them are marked kept.  Rows that repeat an id and
    its text count each in ``group_size``, and all of them are kept if the id owns its group.  Empty table: empty
    result.  Other columns are not read.  ``content_hash`` (of column ``norm``) may replace the hash, for tests;
    ``cells`` is by default eight times the session's shuffle partitions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    ship(spark)
    pick = min if keep == "smallest" else max
    cells = cells or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def better(a, b):
        return b if a is None else a if b is None else pick(a, b)

    # the key of a terminal is the task and a number in it, as the scratch table is written once
    keyed = docs.select(docs[id_col].cast("long").alias("id"), lower_ascii(F.coalesce(docs[text_col], F.lit(""))).alias("norm"))
    dealt = F.pmod(F.xxhash64(F.octet_length("norm"), F.xxhash64("norm") if content_hash is None else content_hash), F.lit(cells))
    keyed = keyed.select("id", "norm", dealt.cast("long").alias("cell"), F.spark_partition_id().alias("task"))

    def local(source):
        tries, made, task = Tries(), 0, 0
        kinds = {"id": pa.int64(), "rep": pa.int64(), "cell": pa.int64(), "best": pa.int64(), "copies": pa.int64(), "norm": pa.binary()}

        def leave(terminals):
            return _record_batches(((None, node.rows[0], cell, node.owner, node.copies, text) for cell, text, node in terminals), kinds, lambda r: len(r[5]))

        for batch in batches(source, "norm"):
            task = batch.column("task")[0].as_py()
            reps = []
            for ident, cell, text in zip(batch.column("id").to_pylist(), batch.column("cell").to_pylist(), batch.column("norm").cast(pa.binary()).to_pylist(), strict=True):
                node = tries.terminal(cell, text)
                if node.rows is None:
                    tries.wait(node, (task << 36) + made)
                    made += 1
                node.owner, node.copies = better(node.owner, ident), node.copies + 1
                reps.append(node.rows[0])
            nothing = [pa.nulls(len(reps), t) for t in list(kinds.values())[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(reps, pa.int64()), *nothing], list(kinds))
            if tries.held >= memory:
                yield from leave(tries.spill(memory // 2))
        yield from leave(tries.drain())

    members = materialise(keyed.mapInArrow(lean(local), "id long, rep long, cell long, best long, copies long, norm binary"), "exact_dedup")

    def globally(source):
        tries = Tries()
        kinds = {"rep": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "sha": pa.string()}

        def leave(terminals):
            for _, text, node in terminals:
                sha = hashlib.sha256(text).hexdigest()
                yield from ((rep, node.owner, node.copies, sha) for rep in node.rows)

        for batch in batches(source, "norm"):
            for rep, cell, best, copies, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "cell", "best", "copies", "norm")), strict=True):
                node = tries.terminal(cell, text)
                tries.wait(node, rep)
                node.owner, node.copies = better(node.owner, best), node.copies + copies
            if tries.held >= memory:
                yield from _record_batches(leave(tries.spill(memory // 2, (cell, text))), kinds, len)
        yield from _record_batches(leave(tries.drain()), kinds, len)

    # rows of a text have no copies, representatives have
    reps = members.where("copies IS NOT NULL").select("rep", "cell", "best", "copies", "norm")
    owned = reps.repartition("cell").sortWithinPartitions("cell", "norm").mapInArrow(lean(globally), "rep long, keep_id long, group_size long, sha string")
    found = members.where("copies IS NULL").select("id", "rep").join(owned, "rep")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
