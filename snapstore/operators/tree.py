"""Merkle trees: building them from an index, and expanding them to a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import entry_hex, object_hash, payload
from ..functions.paths import ancestors, depth, name, parent
from ..plans.lineage import cut
from ..schema import DIR_MODE, FILE_MODE


def drop_conflicts(index: DataFrame) -> DataFrame:
    """Where a path is a file and also a folder of another path, the deeper path is lost."""
    index = index.select("path", "hash")
    above = index.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    files = above.select("above").distinct().join(index.select(F.col("path").alias("above")), "above", "left_semi")
    return index.join(above.join(files, "above", "left_semi").select("path"), "path", "left_anti")


def _level(entries: DataFrame) -> DataFrame:
    """Folders of one depth from their entries (dir, mode, name, hash): ``dir``, ``body_hex``, ``hash``."""
    body = F.expr("listagg(entry, '') WITHIN GROUP (ORDER BY name)")
    folded = entries.select("dir", "name", entry_hex(F.col("mode"), F.col("name"), F.col("hash")).alias("entry")).groupBy("dir").agg(body.alias("body_hex"))
    return folded.withColumn("hash", object_hash("tree", F.unhex("body_hex")))


def build_tree(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, trees): all tree entries, and all trees (``dir``, ``body_hex``, ``hash``; the root's dir is empty).

    The index is computed once and cut; then one aggregation a depth, the deepest first, each cut too, so a level reads
    what the one below has written, and the plan stays as small whatever the depth.  Entries are ordered by the bytes of
    the bare name; files always have mode 100644, whatever the index says.  An empty index has no trees.
    """
    files = drop_conflicts(cut(index.select("path", "hash")))
    files = cut(files.select(parent(F.col("path")).alias("dir"), name(F.col("path")).alias("name"), "hash", depth(F.col("path")).alias("depth")))
    all_entries, all_trees, below = None, None, None
    for level in range(files.agg(F.max("depth")).first()[0] or 1, 0, -1):
        own = files.where(F.col("depth") == level).select("dir", F.lit(FILE_MODE).alias("mode"), "name", "hash")
        if below is not None:
            folders = below.select(parent(F.col("dir")).alias("dir"), F.lit(DIR_MODE).alias("mode"), name(F.col("dir")).alias("name"), "hash")
            own = own.unionByName(folders)
        below = cut(_level(own))
        here = own.join(below.select("dir", F.col("hash").alias("tree_hash")), "dir").select("dir", "tree_hash", "mode", "name", "hash", (F.col("mode") == DIR_MODE).alias("is_subtree"))
        all_entries = here if all_entries is None else all_entries.unionByName(here)
        all_trees = below if all_trees is None else all_trees.unionByName(below)
    return all_entries, all_trees


def tree_entries(entries: DataFrame) -> DataFrame:
    """Entries by distinct tree, with their place in it; equal folders share one tree."""
    from pyspark.sql import Window

    one = entries.groupBy("tree_hash").agg(F.min("dir").alias("dir"))
    pos = F.row_number().over(Window.partitionBy("tree_hash").orderBy("name")) - 1
    return entries.join(one, ["tree_hash", "dir"], "left_semi").select("tree_hash", pos.cast("int").alias("pos"), "mode", "name", "hash", "is_subtree")


def tree_objects(trees: DataFrame) -> DataFrame:
    body = F.unhex("body_hex")
    return trees.dropDuplicates(["hash"]).select("hash", F.lit("tree").alias("type"), F.octet_length(body).cast("bigint").alias("size"), payload("tree", body).alias("payload"))


def expand(entries: DataFrame, roots: DataFrame, strict: bool = False) -> DataFrame:
    """Files below the roots (``root``): ``root``, ``path``, ``hash``.  One join a depth.

    An unreadable subtree is left out; with ``strict`` it is an error.
    """
    frontier = roots.select("root", F.lit("").alias("prefix"), F.col("root").alias("at"))
    e = entries.select("tree_hash", "name", "hash", "is_subtree")
    out = None
    while True:
        step = frontier.join(e, F.col("at") == F.col("tree_hash"), "left" if strict else "inner")
        if strict:
            step = step.withColumn("name", F.when(F.col("tree_hash").isNull(), F.raise_error(F.concat(F.lit("missing tree "), F.col("at"))).cast("string")).otherwise(F.col("name")))
        step = cut(step.select("root", F.concat("prefix", "name").alias("path"), "hash", "is_subtree"))
        files = step.where(~F.col("is_subtree")).select("root", "path", "hash")
        out = files if out is None else out.unionByName(files)
        frontier = step.where("is_subtree").select("root", F.concat("path", F.lit("/")).alias("prefix"), F.col("hash").alias("at"))
        if frontier.isEmpty():
            return out


def restore(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Snapshot files with their contents; a missing blob is an error."""
    joined = files.join(blobs.select(F.col("hash"), "content", F.lit(True).alias("__found")), "hash", "left")
    content = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("missing blob "), F.col("hash"))).cast("binary")).otherwise(F.col("content"))
    return joined.select("path", "hash", content.alias("content"))
