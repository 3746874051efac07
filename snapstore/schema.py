"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _B, _L, _I, _F = T.StringType(), T.BinaryType(), T.LongType(), T.IntegerType(), T.BooleanType()

SIGNATURE = _of(name=_S, email=_S, ts=_L, tz=_S)
WORKTREE = _of(path=_S, length=_L, content=_B)
INDEX = _of(path=_S, hash=_S, mode=_S)
OBJECTS = _of(hash=_S, type=_S, size=_L, payload=_B)
TREE_ENTRIES = _of(tree_hash=_S, pos=_I, mode=_S, name=_S, hash=_S, is_subtree=_F)
COMMITS = _of(hash=_S, tree=_S, parents=T.ArrayType(_S), author=SIGNATURE, committer=SIGNATURE, message=_S)
REFS = _of(name=_S, commit_hash=_S)
HEAD = _of(target=_S, is_symbolic=_F)
CONFIG = _of(key=_S, value=_S)
SNAPSHOT = _of(path=_S, hash=_S)
CHUNKS = _of(chunks=T.ArrayType(_of(sha256=_S)))

FILE_MODE, DIR_MODE = "100644", "040000"
DEFAULT_BRANCH = "main"
DEFAULT_CONFIG = {"user.name": "Unknown User", "user.email": "unknown@example.com"}
