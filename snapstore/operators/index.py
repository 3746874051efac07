"""The staging index: candidates, upsert, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import blob_hash
from ..functions.paths import is_ignored, normalize
from ..schema import FILE_MODE
from ..sources.lines import last_wins


def candidates(worktree: DataFrame, keep_content: bool = False) -> DataFrame:
    """Normalised paths of files that are not ignored, with their blob ids; contents are dropped early unless kept."""
    rows = worktree.select(normalize(F.col("path")).alias("path"), F.col("content"))
    return rows.where(~is_ignored(F.col("path")) & F.col("content").isNotNull()).select("path", blob_hash(F.col("content")).alias("hash"), F.lit(FILE_MODE).alias("mode"), *(["content"] if keep_content else []))


def add_delta(found: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates that are new or have another hash than the index."""
    return found.join(index.select("path", "hash"), ["path", "hash"], "left_anti")


def upsert(index: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates replace rows of their path; all other rows stay, also those of files that are gone."""
    kept = index.join(found.select("path"), "path", "left_anti")
    return kept.select("path", "hash", "mode").unionByName(found.select("path", "hash", "mode"))


def remove(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select("path"), "path", "left_anti")


def dedup_blobs(blobs: DataFrame) -> DataFrame:
    """One row a content; combines before the shuffle."""
    return blobs.dropDuplicates(["hash"])


__all__ = ["add_delta", "candidates", "dedup_blobs", "last_wins", "remove", "upsert"]
