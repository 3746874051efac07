"""Paths: normal forms, the ignore rule, parts and ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path that holds one of these anywhere is ignored.
IGNORED = (".aigit", "build/", ".git", ".vscode/", "vcpkg/")
#: This store's own folder.
STORE = ".snapstore"


def normalize(path: Column) -> Column:
    """One leading ``./`` is cut."""
    return F.regexp_replace(path, r"^\./", "")


def normalize_for_status(path: Column) -> Column:
    """Back slashes become slashes, one leading ``./`` and trailing CR, LF and spaces are cut."""
    return F.regexp_replace(normalize(F.translate(path, "\\", "/")), r"[\r\n ]+$", "")


def is_ignored(path: Column, literals: tuple[str, ...] = IGNORED) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(x)) for x in literals))


def ignores(path: str) -> bool:
    """``is_ignored`` for the file scan, with the store's own folder."""
    return any(x in path for x in (*IGNORED, STORE))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def name(path: Column) -> Column:
    """The text after the last slash."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The text before the last slash; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """All proper ancestors, the nearest to the top first, without the top itself."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
