"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (deterministic, one look-ahead):

    conversation := turn*
    turn         := "### " role ": " body "\\n</turn>\\n"
    role         := "System" | "User" | "Assistant" | "Tool" | "@" percent-encoded text
    body         := characters in which every control string has a backslash before it
    control      := "### " role ":" | "</turn>"

A backslash run before a control string belongs to the escape: escaping adds one backslash to the run, parsing takes
one away, so any text comes back.  Text without control strings is left as it is.  Every turn is rendered, parsed
again, and compared with its source; content that does not come back is escaped, span by span, until it does.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, ship

#: Roles with a name of their own in the template.
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_ROLE_OF = {v: k for k, v in ROLE_NAMES.items()}
END = "\n</turn>\n"
_ROLE = r"(?:System|User|Assistant|Tool|@[A-Za-z0-9_.~%-]*)"
_HEADER = re.compile(rf"### ({_ROLE}): ")
_CONTROL = re.compile(rf"(\\*)(### {_ROLE}:|</turn>)")


class GrammarError(ValueError):
    """The text is not a sentence of the grammar."""


def header(role: str) -> str:
    return f"### {ROLE_NAMES.get(role) or '@' + quote(role, safe='')}: "


def parse(text: str, start: int = 0):
    """Turns from ``start`` on: (role, unescaped text, first and last place of the body in ``text``)."""
    at = start
    while at < len(text):
        head = _HEADER.match(text, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        first = look = head.end()
        while True:
            hit = _CONTROL.search(text, look)
            if not hit:
                raise GrammarError(f"the turn at {at} has no end")
            if not hit[1] and hit[2] == "</turn>" and hit.start() > first and text[hit.start() - 1] == "\n" and text[hit.end() : hit.end() + 1] == "\n":
                break
            if not hit[1]:
                raise GrammarError(f"a control string stands at {hit.start()} without an escape")
            look = hit.end()
        last = hit.start() - 1
        role = _ROLE_OF[head[1]] if head[1] in _ROLE_OF else unquote(head[1][1:])
        yield role, _CONTROL.sub(lambda m: m[1][1:] + m[2], text[first:last]), first, last
        at = hit.end() + 1


def escape_at(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with a backslash put before each of the spans."""
    out, at = [], 0
    for a, _ in spans:
        out += [text[at:a], "\\"]
        at = a
    return "".join(out) + text[at:]


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and how many escape rounds it took; parsing it gives (role, text)."""
    body, rounds = text, 0
    while True:
        rendered = header(role) + body + END
        try:
            back = [(r, t) for r, t, _, _ in parse(rendered)]
        except GrammarError:
            back = []
        if back == [(role, text)]:
            return rendered, rounds
        spans = [m.span() for m in _CONTROL.finditer(text)]
        if rounds or not spans:
            raise GrammarError("a turn does not come back")
        body, rounds = escape_at(text, spans), rounds + 1


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), part_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations in parts: ``conv_id``, ``part``, ``whole``, ``formatted``, ``spans`` (first and last
    place, in code points, of each body under the loss mask), ``roles`` and ``escaped`` (turns that needed an escape).

    A conversation is the concatenation of its parts in the order of ``part``, which ascends but may leave gaps; most
    have one.  ``whole`` says that a part is known to be all of its conversation.  Whole turns fill a part up to
    ``part_chars``, and turns are dealt to tasks by ranges of (conversation, turn), so a conversation of any length is
    written by many tasks with bounded memory; only rows of the same turn stay together.  Rows go by conversation and
    turn (nulls first, ties by role and text); null role or text counts as empty; repeated rows are turns each; rows
    with a null conversation form one conversation; an empty table gives an empty result; other columns are not read.
    """
    ship(turns.sparkSession)
    slim = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    ordered = slim.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string()), pa.int64()]
    names = ["conv_id", "part", "whole", "formatted", "spans", "roles", "escaped"]

    def run(source):
        # parts of later tasks follow those of earlier ones, as ranges do
        state, pieces, size, spans, roles, escaped, part, edge = None, [], 0, [], [], 0, TaskContext.get().partitionId() << 32, True

        def leave(whole):
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((state[0], part, whole, "".join(pieces), spans, roles, escaped), kinds, strict=True)], names)

        for batch in batches(source, "text", 1 << 20):
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if state is None or conv != state[0] or size >= part_chars:
                    if state is not None:
                        ends = conv != state[0]
                        yield leave(ends and not edge)
                        part, edge = part + 1, not ends
                    state, pieces, size, spans, roles, escaped = (conv,), [], 0, [], [], 0
                rendered, rounds = render_turn(role, text)
                if role in loss_roles:
                    first = size + len(header(role))
                    spans.append({"first": first, "last": size + len(rendered) - len(END)})
                pieces.append(rendered)
                roles.append(role)
                size, escaped = size + len(rendered), escaped + (rounds > 0)
        if state is not None:
            yield leave(False)

    return ordered.mapInArrow(lean(run), "conv_id long, part long, whole boolean, formatted string, spans array<struct<first long, last long>>, roles array<string>, escaped long")


_COUNTS = ("n_turns", "loss_chars", "formatted_chars", "escaped_turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted parts alone, in whatever order they come.

    Parts are parsed where they lie.  A whole conversation is digested there; of the others the bytes to digest go by
    conversation and part, as SHA-256 takes them in order: they are streamed, a part at a time.
    """
    kinds = [pa.int64(), pa.int64(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string(), pa.binary(), pa.binary()]
    names = ["conv_id", "part", *_COUNTS, "turns_sha256", "loss_sha256", "turns", "loss"]

    def parsed(source):
        for batch in source:
            rows = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = [f"{role}\n{body}\n" for role, body, _, _ in parse(text)]
                loss = [_CONTROL.sub(lambda m: m[1][1:] + m[2], text[span["first"] : span["last"]]) for span in r["spans"]]
                both = ["".join(x).encode("utf-8", "surrogatepass") for x in (turns, loss)]
                digests = [hashlib.sha256(x).hexdigest() for x in both] if r["whole"] else [None, None]
                rows.append((r["conv_id"], r["part"], len(turns), sum(map(len, loss)), len(text), r["escaped"], *digests, *([None, None] if r["whole"] else both)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def merged(source):
        conv, counts, hashes = None, None, None

        def done():
            return {"conv_id": conv, **counts, "turns_sha256": hashes[0].hexdigest(), "loss_sha256": hashes[1].hexdigest()}

        for batch in source:
            out = []
            for r in batch.to_pylist():
                if counts is not None and r["conv_id"] != conv:
                    out.append(done())
                    counts = None
                if r["turns"] is None:
                    out.append({c: r[c] for c in slim.names})
                    continue
                if counts is None:
                    conv, counts, hashes = r["conv_id"], dict.fromkeys(_COUNTS, 0), (hashlib.sha256(), hashlib.sha256())
                hashes[0].update(r["turns"])
                hashes[1].update(r["loss"])
                for c in _COUNTS:
                    counts[c] += r[c]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=slim)
        if counts is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=slim)

    slim = pa.schema([(n, k) for n, k in zip(names, kinds, strict=True) if n not in ("part", "turns", "loss")])
    numbers = "conv_id long, {}n_turns long, loss_chars long, formatted_chars long, escaped_turns long, turns_sha256 string, loss_sha256 string"
    parts = formatted.mapInArrow(lean(parsed), numbers.format("part long, ") + ", turns binary, loss binary")
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digests = in_order.mapInArrow(lean(merged), numbers.format(""))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns")


def probe_conversation(spark) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn that both hold control strings and escapes."""
    says = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
