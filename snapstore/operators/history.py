"""History: hash chains of commits, and the first-parent walk."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.commits import commit_text
from ..functions.hashing import binary
from ..plans.lineage import cut, ship


def commit_objects(commits: DataFrame) -> DataFrame:
    """Commit rows as objects."""
    from ..functions.hashing import payload

    text = commit_text(F.col("tree"), F.col("parents"), F.col("author"), F.col("committer"), F.col("message"))
    return commits.select("hash", F.lit("commit").alias("type"), F.octet_length(binary(text)).cast("bigint").alias("size"), payload("commit", text).alias("payload"))


def chain(commits: DataFrame, branch: str = "branch", pos: str = "pos") -> DataFrame:
    """Hash chains: each commit's parent is the one before it on its branch.

    ``commits`` has the branch, the place on it, tree, author, committer, message.  A hash needs its parent's, so a
    branch is one ordered walk; branches are dealt out by key, sorted by place, and streamed with constant memory,
    whatever their length.  The texts come from column expressions; only the chained digest is in Python.
    """
    text = lambda parents: commit_text(F.col("tree"), parents, F.col("author"), F.col("committer"), F.col("message"))
    ship(commits.sparkSession)
    rows = commits.select(F.col(branch).alias("branch"), F.col(pos).cast("bigint").alias("pos"), binary(text(F.array().cast("array<string>"))).alias("first"), F.octet_length(F.col("tree")).alias("cut"))
    dealt = rows.repartition("branch").sortWithinPartitions("branch", "pos")
    kind = rows.schema["branch"].dataType.simpleString()

    def run(source):
        at, last = object(), ""
        for batch in source:
            hashes, parents, sizes = [], [], []
            for b, body, tree in zip(batch.column("branch").to_pylist(), batch.column("first").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                if b != at:
                    at, last = b, ""
                if last:  # the parent line follows the tree line
                    k = 5 + tree + 1
                    body = body[:k] + f"parent {last}\n".encode() + body[k:]
                parents.append(last)
                sizes.append(len(body))
                last = hashlib.sha256(f"commit {len(body)}\0".encode() + body).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column("branch"), batch.column("pos"), pa.array(hashes, pa.string()), pa.array(parents, pa.string()), pa.array(sizes, pa.int64())], ["branch", "pos", "hash", "parent", "size"])

    return dealt.mapInArrow(run, f"branch {kind}, pos bigint, hash string, parent string, size bigint")


def first_parent_log(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """All commits on the first-parent path of each tip: ``tip``, ``depth`` (0 at the tip), ``hash``, ``found``.

    Pointer doubling: after round k the paths are known up to 2^k commits, so a history of n commits takes log n
    joins.  A commit that is missing ends its path with ``found`` false; a path that comes back to itself ends there.
    """
    jump = cut(commits.select("hash", F.expr("try_element_at(filter(parents, p -> p <> ''), 1)").alias("to")).dropDuplicates(["hash"]))
    known = jump.select("hash")
    reached = cut(tips.select(F.col("hash").alias("tip"), F.lit(0).cast("bigint").alias("depth"), F.col("hash")).where("hash IS NOT NULL AND hash <> ''").distinct())
    out, step = reached, 1
    while True:
        more = out.join(jump, "hash").where("to IS NOT NULL").select("tip", (F.col("depth") + F.lit(step)).alias("depth"), F.col("to").alias("hash"))
        more = cut(more.join(out.select("tip", "hash"), ["tip", "hash"], "left_anti").select("tip", "depth", "hash"))
        if more.isEmpty():
            break
        out = out.unionByName(more)
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.hash")).select(F.col("a.hash").alias("hash"), F.col("b.to").alias("to")))
        step *= 2
    return out.join(known.withColumn("found", F.lit(True)), "hash", "left").select("tip", "depth", "hash", F.coalesce("found", F.lit(False)).alias("found"))
