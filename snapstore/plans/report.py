"""Rendering: the text of status, log, branches, and JSON answers, from result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compare import FOOTERS

_LABEL = {"new file": "new file:   ", "modified": "modified:   ", "deleted": "deleted:    "}


def render_status(changes: DataFrame, branch: str) -> str:
    """Sections in order, paths in byte order; the closing line by what is there."""
    rows = sorted(changes.collect(), key=lambda r: (r["kind"] == "deleted", r["path"].encode()))
    out = [f"On branch {branch}\n\n"]
    for section, title in (("staged", "Changes to be committed:"), ("unstaged", "Changes not staged for commit:"), ("untracked", "Untracked files:")):
        own = sorted([r for r in rows if r["section"] == section], key=lambda r: r["path"].encode()) if section == "staged" else [r for r in rows if r["section"] == section]
        if own:
            out.append(title + "\n" + "".join(f"\t{_LABEL.get(r['kind'], '')}{r['path']}\n" for r in own) + "\n")
    has = {r["section"] for r in rows}
    key = "staged" if "staged" in has else "untracked" if "untracked" in has else "unstaged" if has else "clean"
    return "".join(out) + (FOOTERS[key] + "\n" if FOOTERS[key] else "")


def render_commit(row) -> str:
    """One commit of the log.  The stored signature lacks its opening bracket, so it reads back as one name."""
    lines = [f"Commit: {row['hash']}", f"Tree: {row['tree']}", *(f"Parent: {p}" for p in row["parents"] if p)]
    for label, who in (("Author", row["author"]), ("Committer", row["committer"])):
        lines.append(f"{label}: {who['name']} {who['email']}> {who['ts']} {who['tz']}")
    return "\n".join([*lines, "", "Message:", row["message"].rstrip("\n"), "", ""])


def render_branches(branches: DataFrame) -> str:
    return "".join(f"{'* ' if r['is_current'] else '  '}{r['name']}\n" for r in branches.orderBy("name").collect())


def json_answer(missing: Column) -> Column:
    """The answer of a push negotiation: missing chunks and (none yet) upload addresses."""
    return F.to_json(F.struct(missing.alias("missing_chunks"), F.create_map().cast("map<string,string>").alias("upload_urls")))


HEALTH = {"status": "ok", "service": "snapstore"}
