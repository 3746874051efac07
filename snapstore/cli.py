"""Command line: ``python -m snapstore.cli <command> [<args>]`` in the working tree."""

from __future__ import annotations

import sys

from .plans import report
from .plans.store import Repository, RepositoryError

USAGE = """Usage: snapstore <command> [<args>]

Available commands:
 init                      create an empty repository
 add <path>...             stage files and folders
 status                    compare working tree, index and last snapshot
 commit [-m] <message>     store the index as a snapshot
 hash-object <file>        print a file's blob id and store it
 log                       first-parent history of the branch
 config [--list | -l | <key> [<value>]]
 branch [<name>]           list branches, or create one
 checkout <branch>         switch the working tree
"""


def run(args: list[str], repo: Repository, out=None, err=None) -> int:
    """One command; returns the exit code."""
    say = lambda x: print(x, end="" if x.endswith("\n") else "\n", file=out or sys.stdout)
    fail = lambda x: print(x, file=err or sys.stderr) or 1
    if not args:
        say(USAGE)
        return 1
    command, rest = args[0], args[1:]
    try:
        if command == "init":
            repo.init()
            say(f"Initialized empty repository in {repo.home}")
        elif command == "add":
            for x in repo.add(rest):
                fail(x)
        elif command == "status":
            say(report.render_status(repo.status(), repo.tip()[0] or "(no branch)"))
        elif command == "commit":
            words = rest[1:] if rest[:1] == ["-m"] else rest
            if not words:
                return fail("Error: Commit message required.")
            made = repo.commit(words[0])
            say(f"Commit created successfully.\nCommit: {made}")
        elif command == "hash-object":
            if not rest:
                return fail("Error: 'hash-object' requires a valid filename parameter.")
            say(repo.hash_object(rest[0]))
        elif command == "log":
            for row in repo.log().toLocalIterator():
                if not row["found"]:
                    return fail(f"missing object {row['hash']}")
                say(report.render_commit(row))
        elif command == "config":
            if not rest or rest[0] in ("--list", "-l"):
                for r in sorted(repo.config_list().collect(), key=lambda r: r["key"], reverse=True):
                    say(f"{r['key']} = {r['value']}")
            elif len(rest) == 1:
                say(repo.config_get(rest[0]))
            else:
                repo.config_set(rest[0], rest[1])
                say(f"Set {rest[0]} = {rest[1]}")
        elif command == "branch":
            if not rest:
                say(report.render_branches(repo.branch_list()) or "No branches found.")
            elif len(rest) > 1:
                say("Usage: snapstore branch <branch-name>")
            else:
                repo.branch_create(rest[0])
                say(f"Created branch '{rest[0]}'")
        elif command == "checkout":
            if len(rest) != 1:
                return fail("Usage: snapstore checkout <branch-name>")
            repo.checkout(rest[0])
            say(f"Checked out branch '{rest[0]}'.")
        else:
            return fail(f"Error: Command '{command}' not recognized.")
    except RepositoryError as e:
        return fail(str(e))
    return 0


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("snapstore").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(sys.argv[1:], Repository(spark, "."))


if __name__ == "__main__":
    sys.exit(main())
