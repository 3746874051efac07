"""Commit text: writing, reading, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SIGNATURE
from .hashing import object_hash


def signature_text(who: Column) -> Column:
    """``name email> ts tz``: the opening bracket is missing in the format, and the bytes are hashed."""
    return F.concat(who["name"], F.lit(" "), who["email"], F.lit("> "), who["ts"].cast("string"), F.lit(" "), who["tz"])


def commit_text(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """The body of a commit; empty parents are left out."""
    lines = F.array_join(F.transform(F.filter(parents, lambda p: p != ""), lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), "")
    return F.concat(F.lit("tree "), tree, F.lit("\n"), lines, F.lit("author "), signature_text(author), F.lit("\ncommitter "), signature_text(committer), F.lit("\n\n"), message, F.lit("\n"))


def commit_hash(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    return object_hash("commit", commit_text(tree, parents, author, committer, message))


def parse_signature(line: Column) -> Column:
    """``Name <email> ts tz``; without both brackets in order the whole line is the name, ts 0, the rest empty."""
    lt, gt = F.instr(line, "<"), F.instr(line, ">")
    rest = F.split(F.btrim(line.substr(gt + 1, F.length(line)), F.lit(" ")), r"\s+")
    good = F.struct(
        F.rtrim(line.substr(F.lit(1), lt - 1)).alias("name"), line.substr(lt + 1, gt - lt - 1).alias("email"),
        F.coalesce(F.try_element_at(rest, F.lit(1)).try_cast("bigint"), F.lit(0).cast("bigint")).alias("ts"), F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit("")).alias("tz"),
    )
    plain = F.struct(line.alias("name"), F.lit("").alias("email"), F.lit(0).cast("bigint").alias("ts"), F.lit("").alias("tz"))
    return F.when((lt > 0) & (gt > lt), good.cast(SIGNATURE)).otherwise(plain.cast(SIGNATURE))


def parse_commit(text: Column) -> Column:
    """tree, parents, author, committer, message of a commit's body; trailing line feeds of the message go."""
    at = F.instr(text, "\n\n")
    head = F.split(F.when(at > 0, text.substr(F.lit(1), at - 1)).otherwise(text), "\n")
    message = F.when(at > 0, F.regexp_replace(text.substr(at + 2, F.length(text)), r"\n+$", "")).otherwise(F.lit(""))
    field = lambda key: F.transform(F.filter(head, lambda x: F.startswith(x, F.lit(f"{key} "))), lambda x: x.substr(F.lit(len(key) + 2), F.length(x)))
    first = lambda key: F.coalesce(F.try_element_at(field(key), F.lit(1)), F.lit(""))
    return F.struct(first("tree").alias("tree"), field("parent").alias("parents"), parse_signature(first("author")).alias("author"), parse_signature(first("committer")).alias("committer"), message.alias("message"))


def tree_pointer(text: Column) -> Column:
    """The first ``tree `` to the end of its line; empty if there is none."""
    return F.regexp_extract(text, r"tree ([^\n]*)", 1)


def normalize_head(target: Column) -> Column:
    """What a HEAD file says after a switch: hashes (40 characters or more) and ``ref: `` stay, names become refs."""
    return (
        F.when(F.startswith(target, F.lit("ref: ")), target).when(F.startswith(target, F.lit("refs/")), F.concat(F.lit("ref: "), target))
        .when(F.length(target) < 40, F.concat(F.lit("ref: refs/heads/"), target)).otherwise(target)
    )


def branch_of(target: Column) -> Column:
    """The full branch name of a symbolic HEAD; null if HEAD is a hash."""
    return F.when(F.startswith(target, F.lit("ref: ")), F.regexp_replace(target.substr(F.lit(6), F.length(target)), "^refs/heads/", ""))
