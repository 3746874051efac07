"""A repository as versioned Parquet tables, and its commands.

``objects`` and ``tree_entries`` and ``commits`` are add-only: rows that are already there are left out by an anti
join, and appends are new files.  Small keyed tables (index, refs, HEAD, config) are written as a new version and then
published by one atomic rename of a pointer file, so a reader never sees half a table.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import commits as C
from ..functions.hashing import binary, blob_hash, payload
from ..functions.paths import STORE
from ..operators import compare, history, refs, tree
from ..operators import index as idx
from ..sources.worktree import read_worktree
from .lineage import cut

ADD_ONLY = {"objects": S.OBJECTS, "tree_entries": S.TREE_ENTRIES, "commits": S.COMMITS}
KEYED = {"index": S.INDEX, "refs": S.REFS, "head": S.HEAD, "config": S.CONFIG}


class RepositoryError(RuntimeError):
    """What a command prints before it exits with 1."""


class Repository:
    """The store of one working tree.  Methods return DataFrames or short values; ``cli`` prints them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.home = spark, os.path.abspath(root), os.path.join(os.path.abspath(root), STORE)

    # tables

    def exists(self) -> bool:
        return os.path.isdir(self.home)

    def _need(self) -> None:
        if not self.exists():
            raise RepositoryError("not a repository")

    def read(self, name: str) -> DataFrame:
        if name in KEYED:
            pointer = Path(self.home, f"{name}.json")
            path = json.loads(pointer.read_text())["version"] if pointer.exists() else None
            return self.spark.read.schema(KEYED[name]).parquet(f"{self.home}/{name}/{path}") if path else self.spark.createDataFrame([], KEYED[name])
        path = Path(self.home, name)
        return self.spark.read.schema(ADD_ONLY[name]).parquet(str(path)) if any(path.glob("*.parquet")) else self.spark.createDataFrame([], ADD_ONLY[name])

    def publish(self, name: str, df: DataFrame) -> None:
        """A new version of a keyed table, then the pointer."""
        version = uuid.uuid4().hex
        df.select(*KEYED[name].names).write.parquet(f"{self.home}/{name}/{version}")
        pointer = Path(self.home, f".{name}-{version}")
        pointer.write_text(json.dumps({"version": version}))
        os.replace(pointer, Path(self.home, f"{name}.json"))

    def append(self, name: str, df: DataFrame, key: str) -> None:
        """Rows whose key is not stored yet; equal rows of the batch are stored once."""
        new = df.select(*ADD_ONLY[name].names).join(self.read(name).select(key).distinct(), key, "left_anti").select(*ADD_ONLY[name].names)
        if name == "objects":
            new = new.dropDuplicates([key])
        new.write.mode("append").parquet(f"{self.home}/{name}")

    # commands

    def init(self) -> None:
        if self.exists():
            raise RepositoryError("Repository already exists.")
        for name in (*ADD_ONLY, *KEYED):
            os.makedirs(f"{self.home}/{name}")
        self.publish("head", self.spark.createDataFrame([(f"ref: refs/heads/{S.DEFAULT_BRANCH}", True)], S.HEAD))
        self.publish("config", self.spark.createDataFrame([("core.repositoryformatversion", "0")], S.CONFIG))
        self.publish("index", self.spark.createDataFrame([], S.INDEX))

    def add(self, targets: list[str]) -> list[str]:
        """Stage files and folders; returns warnings.  Missing targets are reported and skipped."""
        self._need()
        said, found = [], []
        for t in targets:
            full = os.path.join(self.root, t)
            if os.path.isdir(full) or os.path.isfile(full):
                found.append(t)
            else:
                said.append(f"Warning: Skipping unsupported path: {t}" if os.path.exists(full) else f"Error: Path does not exist: {t}")
        if not found:
            return said or ["Nothing specified, nothing added."]
        # files are read and hashed once: what the index names is what is stored, even if a file changes meanwhile
        work = cut(idx.candidates(read_worktree(self.spark, self.root, found), keep_content=True))
        new = idx.add_delta(work.select("path", "hash", "mode"), self.read("index")).select("path", "hash", F.lit(S.FILE_MODE).alias("mode"))
        blobs = work.select("hash", F.lit("blob").alias("type"), F.octet_length("content").cast("bigint").alias("size"), payload("blob", F.col("content")).alias("payload"))
        self.append("objects", blobs.join(new.select("hash").distinct(), "hash", "left_semi"), "hash")
        self.publish("index", idx.upsert(self.read("index"), new))
        return said

    def hash_object(self, path: str) -> str:
        """The blob id of a file, which is stored too."""
        full = os.path.join(self.root, path)
        if not os.path.isfile(full):
            raise RepositoryError(f"not a regular file: {path}")
        with open(full, "rb") as f:
            df = self.spark.createDataFrame([(f.read(),)], "content binary")
        row = df.select(blob_hash(F.col("content")).alias("hash"), F.lit("blob").alias("type"), F.octet_length("content").cast("bigint").alias("size"), payload("blob", F.col("content")).alias("payload"))
        if self.exists():
            self.append("objects", row, "hash")
        return row.first()["hash"]

    def tip(self) -> tuple[str | None, str | None]:
        """(branch, commit) of HEAD."""
        row = refs.resolve_head(self.read("head"), self.read("refs")).first()
        return (row["branch"], row["commit_hash"]) if row else (None, None)

    def snapshot(self, commit_hash: str | None, strict: bool = False) -> DataFrame:
        """Files of a commit: ``path``, ``hash``."""
        roots = self.read("commits").where(F.col("hash") == F.lit(commit_hash)).select(F.col("tree").alias("root")).distinct()
        if commit_hash is None or roots.isEmpty():
            return self.spark.createDataFrame([], S.SNAPSHOT)
        return tree.expand(self.read("tree_entries"), roots, strict).select("path", "hash")

    def status(self) -> DataFrame:
        self._need()
        work = read_worktree(self.spark, self.root)
        disk = work.select("path", F.when(F.col("content").isNotNull(), blob_hash(F.col("content"))).alias("hash"))
        return compare.status(self.read("index"), self.snapshot(self.tip()[1]), disk)

    def commit(self, message: str, now: int | None = None) -> str:
        """Fold the index to trees, write the commit, move the branch; returns the commit's id."""
        index = self.read("index") if self.exists() else None
        if index is None or index.isEmpty():
            raise RepositoryError("Nothing to commit.")
        entries, trees = tree.build_tree(index)
        root = trees.where("dir = ''").first()["hash"]
        branch, parent = self.tip()
        if branch is None:
            raise RepositoryError("HEAD is not on a branch.")
        self.append("objects", tree.tree_objects(trees), "hash")
        self.append("tree_entries", tree.tree_entries(entries), "tree_hash")
        who = self.author(int(time.time()) if now is None else now)
        row = self.spark.createDataFrame([(None, root, [parent] if parent else [], who, who, message)], S.COMMITS)
        text = C.commit_text(F.col("tree"), F.col("parents"), F.col("author"), F.col("committer"), F.col("message"))
        row = row.withColumn("hash", F.sha2(payload("commit", text), 256))
        made = row.first()["hash"]
        self.append("objects", row.select("hash", F.lit("commit").alias("type"), F.octet_length(binary(text)).cast("bigint").alias("size"), payload("commit", text).alias("payload")), "hash")
        self.append("commits", row, "hash")
        self.publish("refs", refs.set_ref(self.read("refs"), branch, made))
        return made

    def author(self, now: int) -> tuple[str, str, int, str]:
        values = {r["key"]: r["value"] for r in refs.config_list(self.read("config")).collect()}
        return values["user.name"], values["user.email"], now, "+0000"

    def log(self) -> DataFrame:
        """Commits from the tip, newest first, with ``depth`` and ``found``."""
        self._need()
        tips = self.spark.createDataFrame([(self.tip()[1],)], "hash string")
        walked = history.first_parent_log(self.read("commits"), tips)
        return walked.join(self.read("commits").dropDuplicates(["hash"]), "hash", "left").orderBy("depth")

    def config_get(self, key: str) -> str:
        self._need()
        row = self.read("config").where(F.col("key") == key).first()
        if row is None or not row["value"]:
            raise RepositoryError(f"error: key '{key}' not set.")
        return row["value"]

    def config_set(self, key: str, value: str) -> None:
        self._need()
        kept = self.read("config").where(F.col("key") != key)
        self.publish("config", kept.unionByName(self.spark.createDataFrame([(key, value)], S.CONFIG)))

    def config_list(self) -> DataFrame:
        self._need()
        return refs.config_list(self.read("config"))

    def branch_create(self, name: str) -> None:
        self._need()
        row = refs.branch_create(self.read("refs"), self.read("head"), self.spark.createDataFrame([(name,)], "name string")).first()
        if row["outcome"] != "created":
            raise RepositoryError(f"Branch '{name}' already exists." if row["outcome"] == "exists" else "No current commit found.")
        self.publish("refs", refs.set_ref(self.read("refs"), name, row["commit_hash"]))

    def branch_list(self) -> DataFrame:
        self._need()
        return refs.branch_list(self.read("refs"), self.read("head"))

    def checkout(self, branch: str, refresh_index: bool = False) -> DataFrame:
        """Switch the working tree to a branch; everything it needs is checked before a file is touched.

        The index stays as it is unless ``refresh_index``.
        """
        self._need()
        row = self.read("refs").where(F.col("name") == branch).first()
        if row is None:
            raise RepositoryError(f"Error: Branch '{branch}' does not exist.")
        target = self.snapshot(row["commit_hash"], strict=True)
        if not compare.missing_objects(target, self.read("objects")).isEmpty():
            raise RepositoryError("Checkout error: objects are missing.")
        delta = compare.checkout_delta(self.snapshot(self.tip()[1], strict=True), target)
        write_files(delta, self.read("objects"), self.root)
        self.publish("head", refs.set_head(self.spark.createDataFrame([(branch,)], "target string")).select(F.col("head").alias("target"), F.lit(True).alias("is_symbolic")))
        if refresh_index:
            self.publish("index", target.withColumn("mode", F.lit(S.FILE_MODE)))
        return delta


def write_files(delta: DataFrame, stored: DataFrame, root: str) -> None:
    """Remove and write files in the tasks; each file goes to a name of its own first and is then renamed."""
    from ..sources.objects import decode_blobs

    removed = delta.where("action = 'remove'").select("path", F.lit(None).cast("binary").alias("content"))
    written = tree.restore(delta.where("action = 'write'").select("path", "hash"), decode_blobs(stored)).select("path", "content")

    def apply(rows):
        for r in rows:
            full = os.path.join(root, r["path"])
            if r["content"] is None:
                if os.path.isfile(full):
                    os.remove(full)
                continue
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, full)

    removed.foreachPartition(apply)
    written.foreachPartition(apply)


__all__ = ["Repository", "RepositoryError", "write_files"]
