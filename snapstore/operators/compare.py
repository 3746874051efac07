"""Comparisons of snapshots: status, checkout delta, missing objects, push negotiation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _say(section: str, kind, path="path"):
    return [F.lit(section).alias("section"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(path).alias("path")]


def staged(index: DataFrame, head: DataFrame) -> DataFrame:
    """Index paths that the last snapshot lacks or has with another hash; paths only in it are not reported."""
    joined = index.select("path", "hash").join(head.select("path", F.col("hash").alias("was")), "path", "left")
    kind = F.when(F.col("was").isNull(), F.lit("new file")).otherwise(F.lit("modified"))
    return joined.where(F.col("was").isNull() | (F.col("was") != F.col("hash"))).select(*_say("staged", kind))


def against_worktree(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Modified, deleted and untracked in one full outer join; ``disk`` has ``path`` and ``hash`` (null: unreadable)."""
    i = index.select("path", F.col("hash").alias("i_hash"), F.lit(True).alias("in_index"))
    d = disk.select("path", F.col("hash").alias("d_hash"), F.lit(True).alias("on_disk"))
    both = i.join(d, "path", "full")
    kind = F.when(F.col("in_index").isNull(), F.lit("untracked")).when(F.col("on_disk").isNull(), F.lit("deleted")).when(F.col("i_hash") != F.col("d_hash"), F.lit("modified"))
    section = F.when(F.col("in_index").isNull(), F.lit("untracked")).otherwise(F.lit("unstaged"))
    return both.select(section.alias("section"), kind.alias("kind"), "path").where(F.col("kind").isNotNull())


def modified(index: DataFrame, disk: DataFrame) -> DataFrame:
    return index.select("path", "hash").join(disk.select("path", F.col("hash").alias("d")), "path").where(F.col("d") != F.col("hash")).select(*_say("unstaged", "modified"))


def deleted(index: DataFrame, disk: DataFrame) -> DataFrame:
    return index.join(disk.select("path"), "path", "left_anti").select(*_say("unstaged", "deleted"))


def untracked(index: DataFrame, disk: DataFrame) -> DataFrame:
    return disk.join(index.select("path"), "path", "left_anti").select(*_say("untracked", "untracked"))


def status(index: DataFrame, head: DataFrame, disk: DataFrame) -> DataFrame:
    """All changes: ``section`` (staged, unstaged, untracked), ``kind``, ``path``."""
    return staged(index, head).unionByName(against_worktree(index, disk))


#: The closing line by which sections have rows.
FOOTERS = {
    "clean": "Nothing to commit, working tree clean",
    "untracked": "Nothing added to commit but untracked files present",
    "unstaged": "No changes added to commit",
    "staged": "",
}


def footer(changes: DataFrame) -> DataFrame:
    """One row: counts of the sections and the closing line's key."""
    n = lambda s: F.count_if(F.col("section") == s).cast("bigint")
    counted = changes.agg(n("staged").alias("n_staged"), n("unstaged").alias("n_unstaged"), n("untracked").alias("n_untracked"))
    key = F.when(F.col("n_staged") > 0, "staged").when(F.col("n_untracked") > 0, "untracked").when(F.col("n_unstaged") > 0, "unstaged").otherwise("clean")
    return counted.withColumn("footer", key)


def checkout_delta(current: DataFrame, target: DataFrame) -> DataFrame:
    """What a switch does: current paths missing in the target are removed, every target path is written."""
    c = current.select("path", F.lit(True).alias("in_current"))
    both = c.join(target.select("path", "hash"), "path", "full")
    return both.select("path", F.when(F.col("hash").isNull(), F.lit("remove")).otherwise(F.lit("write")).alias("action"), "hash")


def missing_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct hashes that a snapshot needs and the store lacks; checked before anything is touched."""
    return wanted.select("hash").distinct().join(objects.select("hash"), "hash", "left_anti")


def negotiate_stub(requested: DataFrame) -> DataFrame:
    """As the service answers today: every requested chunk, duplicates too."""
    return requested.select("sha256")


def negotiate(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """As it is meant (an extension): requested chunks that are not stored."""
    return requested.select("sha256").join(stored.select("sha256"), "sha256", "left_anti")
