"""Snapshot operators against hashlib and plain Python, and the edge cases of FIXTURES.md."""

import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from snapstore import cli
from snapstore.functions import commits as C
from snapstore.functions import hashing as H
from snapstore.functions import paths as P
from snapstore.operators import compare, history, index, refs, tree
from snapstore.plans.store import Repository, RepositoryError
from snapstore.sources import lines, objects
from snapstore.sources.worktree import read_worktree


def obj(kind, body):
    return hashlib.sha256(f"{kind} {len(body)}\0".encode() + body).hexdigest()


def plain_tree(files):
    """(root hash, surviving paths) by recursion."""
    paths = {p: h for p, h in files.items() if not any("/".join(p.split("/")[:k]) in files for k in range(1, p.count("/") + 1))}

    def fold(prefix):
        names = sorted({p[len(prefix) :].split("/")[0] for p in paths if p.startswith(prefix)}, key=str.encode)
        body = b""
        for n in names:
            full = prefix + n
            mode, h = ("100644", paths[full]) if full in paths else ("040000", fold(full + "/"))
            body += f"{mode} {n}\0".encode() + bytes.fromhex(h)
        return obj("tree", body)

    return fold(""), paths


FILES = {"a": "1", "a/b": "2", "c/d/e": "3", "c-x": "4", "é/ü.txt": "5", "c/d/f/g": "6", "C": "7"}
HASHES = {p: obj("blob", t.encode()) for p, t in FILES.items()}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, hash string")


def test_blob_ids(spark):
    texts = ["", "é", "x" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(H.blob_hash(F.col("t"))).collect()
    assert [r[0] for r in got] == [obj("blob", t.encode()) for t in texts]
    assert spark.range(1).select(H.blob_hash(F.lit(None).cast("string"))).first()[0] is None


def test_tree_equals_recursion_and_ignores_row_order(spark):
    root, kept = plain_tree(HASHES)
    for df in (frame(spark, HASHES), frame(spark, dict(reversed(HASHES.items()))).repartition(3)):
        entries, trees = tree.build_tree(df)
        assert trees.where("dir = ''").first()["hash"] == root
    got = tree.expand(tree.tree_entries(entries), spark.createDataFrame([(root,)], "root string"))
    assert {r["path"]: r["hash"] for r in got.collect()} == kept
    decoded = objects.decode_trees(tree.tree_objects(trees)).orderBy("tree_hash", "pos").collect()
    assert decoded == tree.tree_entries(entries).orderBy("tree_hash", "pos").collect()


def test_deep_tree_is_cut(spark):
    deep = {"/".join(f"d{k}" for k in range(9)) + "/f": HASHES["a"]}
    entries, trees = tree.build_tree(frame(spark, deep))
    assert trees.where("dir = ''").first()["hash"] == plain_tree(deep)[0]


@pytest.mark.parametrize("levels", range(1, 13, 3))
def test_no_file_is_too_deep(spark, levels):
    files = {"/".join([*(f"d{k}" for k in range(n)), f"f{n}"]): HASHES["a"] for n in range(levels)}
    root, kept = plain_tree(files)
    entries, trees = tree.build_tree(frame(spark, files))
    assert trees.where("dir = ''").first()["hash"] == root and len(kept) == levels
    got = tree.expand(tree.tree_entries(entries), spark.createDataFrame([(root,)], "root string"))
    assert {r["path"] for r in got.collect()} == set(files)


def test_tree_reads_its_index_once(spark, tmp_path):
    frame(spark, HASHES).write.parquet(str(tmp_path / "t"))
    entries, trees = tree.build_tree(spark.read.parquet(str(tmp_path / "t")))
    for df in (entries, trees):
        assert "FileScan" not in df._jdf.queryExecution().toString()


def test_log_ends_on_a_cycle(spark):
    df = spark.createDataFrame([(f"c{k}", [f"c{(k + 1) % 5}"]) for k in range(5)], "hash string, parents array<string>")
    got = history.first_parent_log(df, spark.createDataFrame([("c3",)], "hash string")).collect()
    assert sorted((r["depth"], r["hash"]) for r in got) == [(0, "c3"), (1, "c4"), (2, "c0"), (3, "c1"), (4, "c2")]


def test_expand_missing_subtree(spark):
    root, _ = plain_tree(HASHES)
    entries, _ = tree.build_tree(frame(spark, HASHES))
    stored = tree.tree_entries(entries.where("dir <> 'c/d'"))
    roots = spark.createDataFrame([(root,)], "root string")
    assert {r["path"] for r in tree.expand(stored, roots).collect()} == {"a", "c-x", "C", "é/ü.txt"}
    with pytest.raises(Exception, match="missing tree"):
        tree.expand(stored, roots, strict=True).collect()


def test_commit_text_and_hash(spark):
    who = F.struct(F.lit("N").alias("name"), F.lit("e@x").alias("email"), F.lit(17).cast("bigint").alias("ts"), F.lit("+0000").alias("tz"))
    for parents in ([], [""], ["p" * 64], ["p" * 64, "q" * 64]):
        array = F.array(*[F.lit(p) for p in parents]).cast("array<string>")
        got = spark.range(1).select(C.commit_hash(F.lit("t"), array, who, who, F.lit("msg\n\né"))).first()[0]
        body = "tree t\n" + "".join(f"parent {p}\n" for p in parents if p) + "author N e@x> 17 +0000\ncommitter N e@x> 17 +0000\n\nmsg\n\né\n"
        assert got == obj("commit", body.encode())


@pytest.mark.parametrize(
    ("line", "expected"),
    [("N e> 17 +0000", ("N e> 17 +0000", "", 0, "")), ("Ann  <a@x.y> 17 +0000", ("Ann", "a@x.y", 17, "+0000")), ("A <b> soon", ("A", "b", 0, "")), ("> <", ("> <", "", 0, "")), ("", ("", "", 0, "")), ("<>", ("", "", 0, ""))],
)
def test_signature(spark, line, expected):
    assert tuple(spark.range(1).select(C.parse_signature(F.lit(line)).alias("s")).first()["s"]) == expected


def test_commit_decode_keeps_inner_blank_lines(spark):
    text = "tree T\nparent P\nauthor A <a> 5 +0100\ncommitter B\n\n\na\n\nb\n\n"
    c = spark.range(1).select(C.parse_commit(F.lit(text)).alias("c")).first()["c"]
    assert (c["tree"], c["parents"], c["author"]["ts"], c["committer"]["name"], c["message"]) == ("T", ["P"], 5, "B", "\na\n\nb")


@pytest.mark.parametrize(("target", "expected"), [("main", "ref: refs/heads/main"), ("refs/heads/x", "ref: refs/heads/x"), ("ref: refs/heads/x", "ref: refs/heads/x"), ("a" * 64, "a" * 64)])
def test_head_normal_form(spark, target, expected):
    assert spark.range(1).select(C.normalize_head(F.lit(target))).first()[0] == expected


def test_paths(spark):
    rows = [".gitignore", "x.github/y", "rebuild/x", "vcpkg/p", "build", "vcpkg.json", ".vscode", "src/a"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").where(~P.is_ignored(F.col("p"))).collect()
    assert {r[0] for r in got} == {"build", "vcpkg.json", ".vscode", "src/a"}
    assert [r[0] for r in spark.createDataFrame([("./a",), ("././a",)], "p string").select(P.normalize(F.col("p"))).collect()] == ["a", "./a"]


def test_hex(spark):
    assert spark.range(1).select(H.checked_unhex(F.lit("00ff"))).first()[0] == b"\x00\xff"
    with pytest.raises(Exception, match="not hexadecimal"):
        spark.range(1).select(H.checked_unhex(F.lit("abc"))).collect()


def test_zlib(spark):
    df = spark.createDataFrame([(b"",), (b"x" * 100000,)], "b binary")
    rows = df.select("b", H.deflate(F.col("b")).alias("z")).withColumn("back", H.inflate(F.col("z"))).collect()
    assert all(r["back"] == r["b"] and zlib.decompress(r["z"]) == r["b"] for r in rows)
    with pytest.raises(Exception, match="cut off|Error"):
        spark.createDataFrame([(zlib.compress(b"abc" * 100)[:-6],)], "z binary").select(H.inflate(F.col("z"))).collect()


def numbered(spark, text):
    return spark.createDataFrame(list(enumerate(text)), "line_no long, line string")


def test_index_lines(spark):
    got = lines.parse_index(numbered(spark, ["100644 h1 dir/b c.txt", "100644 h", "", "100644 h2 a", "100755  h3\ta "])).collect()
    assert {(r["path"], r["hash"], r["mode"]) for r in got} == {("dir/b", "h1", "100644"), ("a", "h3", "100755")}


def test_config_lines(spark):
    got = lines.parse_config(numbered(spark, ["top = 1", "[user]", "name = A=B", "# c", "; c", "", "none", "name=Z", "[x]", " empty ="])).collect()
    assert {r["key"]: r["value"] for r in got} == {"top": "1", "user.name": "Z", "x.empty": ""}


def test_config_defaults(spark):
    config = spark.createDataFrame([("user.email", "")], "key string, value string")
    assert {r["key"]: r["value"] for r in refs.config_list(config).collect()} == {"user.name": "Unknown User", "user.email": ""}


def test_request(spark):
    bodies = ['{"chunks": [{"sha256": "a"}, {"sha256": "a"}]}', '{"chunks": {}}', "{}", "no json", None, '{"chunks": []}']
    got = lines.parse_request(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [r["valid"] for r in got] == [True, False, False, False, False, True]
    assert [c["sha256"] for c in got[0]["chunks"]] == ["a", "a"]


def test_status_kinds(spark):
    head, idx_ = frame(spark, {"same": "1", "mod": "1", "gone": "1"}), frame(spark, {"same": "1", "mod": "2", "new": "3", "lost": "4", "bad": "5"})
    disk = frame(spark, {"same": "1", "mod": "9", "new": "3", "other": "6", "bad": None})
    got = {(r["section"], r["kind"], r["path"]) for r in compare.status(idx_, head, disk).collect()}
    staged = {("staged", "modified", "mod"), ("staged", "new file", "new"), ("staged", "new file", "lost"), ("staged", "new file", "bad")}
    assert got == staged | {("unstaged", "modified", "mod"), ("unstaged", "deleted", "lost"), ("untracked", "untracked", "other")}
    assert compare.footer(compare.status(idx_, head, disk)).first()["footer"] == "staged"
    assert compare.footer(compare.status(head, head, head)).first()["footer"] == "clean"


def test_upsert_keeps_rows_that_are_gone(spark):
    old = frame(spark, {"a": "1", "b": "2"}).withColumn("mode", F.lit("100644"))
    new = frame(spark, {"b": "3", "c": "4"}).withColumn("mode", F.lit("100644"))
    assert {r["path"]: r["hash"] for r in index.upsert(old, new).collect()} == {"a": "1", "b": "3", "c": "4"}


def test_long_first_parent_walk(spark):
    commits = [(f"c{k}", [f"c{k - 1}" if k else ""]) for k in range(150)] + [("m", ["c149", "other"]), ("broken", ["nowhere"])]
    df = spark.createDataFrame(commits, "hash string, parents array<string>")
    got = history.first_parent_log(df, spark.createDataFrame([("m",), ("broken",), ("",), (None,)], "hash string")).collect()
    walk = sorted((r["depth"], r["hash"]) for r in got if r["tip"] == "m")
    assert walk == [(0, "m"), *((k + 1, f"c{149 - k}") for k in range(150))]
    assert sorted((r["depth"], r["hash"], r["found"]) for r in got if r["tip"] == "broken") == [(0, "broken", True), (1, "nowhere", False)]


def test_chain_equals_hashlib(spark):
    who = F.struct(F.lit("N").alias("name"), F.lit("e").alias("email"), F.lit(1).cast("bigint").alias("ts"), F.lit("+0000").alias("tz"))
    rows = [(b, p, f"tree{b}{p}", f"message {p}\né") for b in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "branch long, pos long, tree string, message string").withColumn("author", who).withColumn("committer", who).repartition(3)
    last = {}
    expected = {}
    for b, p, t, m in rows:
        parent = f"parent {last[b]}\n" if b in last else ""
        last[b] = obj("commit", f"tree {t}\n{parent}author N e> 1 +0000\ncommitter N e> 1 +0000\n\n{m}\n".encode())
        expected[b, p] = last[b]
    assert {(r["branch"], r["pos"]): r["hash"] for r in history.chain(df).collect()} == expected


@pytest.fixture
def work(spark, tmp_path):
    for name, text in {".env": "e", "_u.py": "u", ".hid/z": "z", "empty": "", "a/b/c.txt": "c", ".gitignore": "i", "build/o": "o", "x/rebuild/y": "y", "build.txt": "b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_worktree_scan(spark, work):
    (work / "link").symlink_to(work / "empty")
    got = {r["path"]: r["length"] for r in read_worktree(spark, str(work)).collect()}
    assert got == {".env": 1, "_u.py": 1, ".hid/z": 1, "empty": 0, "a/b/c.txt": 1, "build.txt": 1, "link": 0}
    assert [r["path"] for r in read_worktree(spark, str(work), ["./a", "a/b/c.txt", "build/o"]).collect()] == ["a/b/c.txt"]


def test_commands(spark, work):
    repo = Repository(spark, str(work))

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.run(list(args), repo, out, err), out.getvalue(), err.getvalue()

    assert run()[0] == 1 and run("nonsense")[0] == 1 and run("status")[0] == 1 and run("commit", "x") == (1, "", "Nothing to commit.\n")
    assert run("init")[0] == 0 and run("init")[0] == 1
    assert run("log") == (0, "", "") and run("branch", "dev")[2] == "No current commit found.\n"
    assert "Untracked files:" in run("status")[1]
    assert run("add", "missing")[2] == "Error: Path does not exist: missing\n"
    assert run("add", ".")[0] == 0
    assert "new file:   a/b/c.txt" in run("status")[1]
    assert run("commit")[0] == 1 and run("commit", "-m", "first")[0] == 0
    assert run("status")[1].endswith("working tree clean\n")
    files = {r["path"]: r["hash"] for r in repo.read("index").collect()}
    assert repo.read("commits").first()["tree"] == plain_tree(files)[0]
    before = repo.read("objects").count()
    assert run("add", ".")[0] == 0 and repo.read("objects").count() == before
    assert run("hash-object", "empty")[1].strip() == obj("blob", b"") and run("hash-object", "nope")[0] == 1
    assert run("config", "user.name", "Ann")[0] == 0 and run("config", "user.name")[1] == "Ann\n" and run("config", "no.key")[0] == 1
    assert run("config", "--list")[1] == "user.name = Ann\nuser.email = unknown@example.com\n"
    assert run("branch", "dev")[0] == 0 and run("branch", "dev")[0] == 1 and run("branch")[1] == "  dev\n* main\n"
    (work / "a/b/c.txt").write_text("changed")
    (work / "new.txt").write_text("n")
    os.remove(work / "empty")
    text = run("status")[1]
    assert "modified:   a/b/c.txt" in text and "deleted:    empty" in text and "\tnew.txt" in text
    assert run("add", "a", "new.txt")[0] == 0 and run("commit", "second")[0] == 0
    log = run("log")[1]
    assert log.index("second") < log.index("first") and "Author: Ann unknown@example.com> " in log and log.count("Parent: ") == 1
    assert {r["path"] for r in repo.snapshot(repo.tip()[1]).collect()} >= {"empty", "new.txt"}
    assert run("checkout", "nope")[0] == 1 and run("checkout", "dev")[0] == 0
    assert (work / "a/b/c.txt").read_text() == "c" and not (work / "new.txt").exists() and (work / "empty").read_text() == ""
    assert "modified:   a/b/c.txt" in run("status")[1]
    assert run("branch")[1] == "* dev\n  main\n"
    repo.checkout("main", refresh_index=True)
    assert (work / "new.txt").read_text() == "n"
    stored = repo.read("objects")
    files = objects.export_objects(stored)
    assert objects.import_objects(files).orderBy("hash").collect() == stored.orderBy("hash").collect()
    assert objects.decode_commits(stored).count() == 2
    repo.read("objects").where("type <> 'blob'").write.parquet(f"{repo.home}/less")
    os.rename(f"{repo.home}/objects", f"{repo.home}/old")
    os.rename(f"{repo.home}/less", f"{repo.home}/objects")
    with pytest.raises(RepositoryError, match="missing"):
        repo.checkout("dev")
