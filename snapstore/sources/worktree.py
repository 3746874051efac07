"""The ``worktree`` data source: every regular file below the given paths, hidden and empty ones too.

``binaryFile`` leaves out names that start with ``.`` or ``_``, and empty files, so files are walked here.  The plan
lists names only; contents are read by the tasks, one file at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import IGNORED, STORE, ignores
from ..plans.lineage import ship


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WorktreeReader(DataSourceReader):
    def __init__(self, root: str, targets: list[str], slice_bytes: int):
        self.root, self.targets, self.slice_bytes = root, targets, slice_bytes

    def _walk(self, target: str) -> Iterator[tuple[str, str]]:
        full = os.path.join(self.root, target)
        shown = target.removeprefix("./")
        if not os.path.isdir(full):
            if os.path.isfile(full) and not ignores(shown):
                yield full, shown
            return
        prefix = "" if shown in ("", ".") else shown.rstrip("/") + "/"
        for top, dirs, files in os.walk(full):
            inside = os.path.relpath(top, full)
            at = prefix + ("" if inside == "." else inside.replace(os.sep, "/") + "/")
            dirs[:] = sorted(d for d in dirs if not any(x in f"{at}{d}/" for x in (*IGNORED, STORE)))
            for f in sorted(files):
                if os.path.isfile(os.path.join(top, f)) and not ignores(at + f):
                    yield os.path.join(top, f), at + f

    def partitions(self) -> list[InputPartition]:
        out, files, held, seen = [], [], 0, set()
        for target in self.targets:
            for full, path in self._walk(target):
                if path in seen:
                    continue
                seen.add(path)
                files.append((full, path))
                held += os.path.getsize(full) + 4096
                if held >= self.slice_bytes:
                    out.append(_Slice(files))
                    files, held = [], 0
        return [*out, _Slice(files)] if files or not out else out

    def read(self, partition: InputPartition):
        for full, path in partition.files:
            try:
                with open(full, "rb") as f:
                    content = f.read()
                yield path, len(content), content
            except OSError:  # unreadable: the row stays, without content
                yield path, None, None


class WorktreeSource(DataSource):
    """Options: ``path`` (the root), ``targets`` (lines; default the root), ``sliceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return "path STRING, length BIGINT, content BINARY"

    def reader(self, schema) -> WorktreeReader:
        return WorktreeReader(self.options.get("path", "."), self.options.get("targets", ".").split("\n"), int(self.options.get("slicebytes", self.options.get("sliceBytes", 64 << 20))))


def read_worktree(spark: SparkSession, root: str, targets: list[str] | None = None) -> DataFrame:
    """``path``, ``length``, ``content`` (null if unreadable) of the files below ``root`` that are not ignored."""
    ship(spark)
    spark.dataSource.register(WorktreeSource)
    return spark.read.format("worktree").option("targets", "\n".join(targets or ["."])).load(root)
