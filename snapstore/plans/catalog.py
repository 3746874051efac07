"""The snapshot queries over the test tables, each with its SQL where SQL can express it.

Adapters (the same in both): the working tree is ``documents`` with path ``source/lang/d<doc_id>.txt``; the last
snapshot, the index and the disk are parts of it, with some hashes altered; commits are ``conversations`` with one
branch a conversation; configuration lines come from ``events``.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import commits as C
from ..functions import hashing as H
from ..functions import paths as P
from ..operators import compare, history, index, refs, tree
from ..schema import DEFAULT_CONFIG, FILE_MODE
from ..sources import lines, objects
from ..sources.worktree import read_worktree
from . import report
from .lineage import cut, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(spark, sf_dir) -> DataFrame:
    """doc_id, path, hash: texts are hashed in the scan's stage and go no further."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), H.blob_hash(F.col("text")).alias("hash"))


def _head(w):
    return w.where("doc_id % 3 <> 0").select("path", "hash")


def _altered(tag: str):
    return F.sha2(F.concat(F.lit(tag), "hash").cast("binary"), 256)


def _index(w):
    return w.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, _altered("index:")).otherwise(F.col("hash")).alias("hash"), F.lit(FILE_MODE).alias("mode"), "doc_id")


def _disk(w):
    i = _index(w).where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, _altered("disk:")).otherwise(F.col("hash")).alias("hash"))
    return i.unionByName(w.where("doc_id % 7 = 0").select("path", "hash"))


def _commits(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    who = F.struct(F.lit(DEFAULT_CONFIG["user.name"]).alias("name"), F.lit(DEFAULT_CONFIG["user.email"]).alias("email"), (F.lit(1700000000) + F.col("turn")).cast("bigint").alias("ts"), F.lit("+0000").alias("tz"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint")
    return c.select(F.col("conv_id").alias("branch"), pos.alias("pos"), H.blob_hash(F.col("text")).alias("tree"), who.alias("author"), who.alias("committer"), F.col("text").alias("message"))


def _chained(spark, sf_dir) -> DataFrame:
    return history.chain(_commits(spark, sf_dir))


def _refs(spark, sf_dir) -> DataFrame:
    c = _chained(spark, sf_dir)
    return c.groupBy("branch").agg(F.max_by("hash", "pos").alias("commit_hash")).select(F.concat(F.lit("b"), F.col("branch").cast("string")).alias("name"), "commit_hash")


def _one_head(spark) -> DataFrame:
    return spark.createDataFrame([("ref: refs/heads/b3", True)], "target string, is_symbolic boolean")


# -- blobs ------------------------------------------------------------------------------------------------------


def blob_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("size"), H.blob_hash(F.col("text")).alias("hash"))


def blob_dedup(spark, sf_dir):
    """Distinct contents with their number of copies and the bytes they would take without sharing."""
    b = blob_hash(spark, sf_dir)
    return b.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.sum("size").cast("bigint").alias("bytes"))


def object_path(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", H.object_path(F.col("hash")).alias("object_path"))


def object_get(spark, sf_dir):
    """Look-up by key: every third key is one that the store lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", H.blob_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))
    stored = index.dedup_blobs(d).select("hash", "size", F.lit(True).alias("found"))
    keys = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, _altered("absent:")).otherwise(F.col("hash")).alias("hash"))
    return keys.join(stored, "hash", "left").select("doc_id", "hash", F.coalesce("size", F.lit(-1).cast("bigint")).alias("size"), F.coalesce("found", F.lit(False)).alias("found"))


def hex_roundtrip(spark, sf_dir):
    return hashed(spark, sf_dir).select("doc_id", H.hex_lower(H.checked_unhex(F.col("hash"))).alias("hash"), F.octet_length(F.unhex("hash")).cast("bigint").alias("n_bytes"))


def blob_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = d.select("doc_id", H.payload("blob", F.col("text")).alias("payload"))
    return made.select("doc_id", objects.header_kind(F.col("payload")).alias("kind"), F.octet_length(objects.body_of(F.col("payload"))).cast("bigint").alias("size"), F.sha2(objects.body_of(F.col("payload")), 256).alias("content_sha256"))


# -- paths and lines --------------------------------------------------------------------------------------------

_PREFIXES = ["src/", ".git/", "x.github/", "rebuild/", "build-", ".vscode/", "vcpkg/", "vcpkg.", "./"]


def _odd_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pick = F.element_at(F.array(*[F.lit(x) for x in _PREFIXES]), (F.col("doc_id") % len(_PREFIXES) + 1).cast("int"))
    return d.select("doc_id", F.concat(pick, "source", F.lit("/"), "lang").alias("path"))


def ignore_filter(spark, sf_dir):
    p = _odd_paths(spark, sf_dir)
    return p.where(~P.is_ignored(F.col("path"))).select("doc_id", "path")


def normalize_path(spark, sf_dir):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("././")).otherwise(F.lit("./")), "source", F.lit("\\"), "lang", F.when(F.col("doc_id") % 3 == 0, F.lit(" \r\n")).otherwise(F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return d.select("doc_id", P.normalize(F.col("raw")).alias("for_add"), P.normalize_for_status(F.col("raw")).alias("for_status"))


def path_parts(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return w.select("doc_id", P.parent(F.col("path")).alias("dir"), P.name(F.col("path")).alias("name"), P.depth(F.col("path")).cast("bigint").alias("depth"), F.array_join(P.ancestors(F.col("path")), "|").alias("ancestors"))


def _index_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gap = F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.lit(" "))
    tail = F.when(F.col("event_id") % 6 == 0, F.lit(" tail x")).otherwise(F.lit(""))
    path = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), F.col("user_id").cast("string"), tail))
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.lit(" 100644"), gap, F.sha2(F.col("event_id").cast("string").cast("binary"), 256), gap, path).alias("line"))


def index_parse(spark, sf_dir):
    return lines.parse_index(_index_lines(spark, sf_dir))


def index_upsert(spark, sf_dir):
    w = cut(hashed(spark, sf_dir))
    return index.upsert(_index(w).drop("doc_id"), _candidates(w))


def _candidates(w):
    return w.where("doc_id % 2 = 0").select("path", "hash", F.lit(FILE_MODE).alias("mode"))


def add_delta(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return index.add_delta(_candidates(w), _index(w)).select("path", "hash")


def index_remove(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return index.remove(_index(w).drop("doc_id"), w.where("doc_id % 4 = 0"))


def worktree_candidates(spark, sf_dir):
    """The ingest path on a table in place of a folder: ignore rule, normal form, blob id."""
    p = _odd_paths(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")
    return index.candidates(p.select(F.concat("path", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "content"))


# -- status -----------------------------------------------------------------------------------------------------


def status_staged(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.staged(_index(w), _head(w))


def status_modified(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.modified(_index(w), _disk(w))


def status_deleted(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.deleted(_index(w), _disk(w)).select("section", "kind", "path")


def status_untracked(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.untracked(_index(w), _disk(w)).select("section", "kind", "path")


def status_all(spark, sf_dir):
    w = cut(hashed(spark, sf_dir))  # used five times: texts are read and hashed once
    return compare.status(_index(w), _head(w), _disk(w))


def status_footer(spark, sf_dir):
    return compare.footer(status_all(spark, sf_dir))


# -- trees ------------------------------------------------------------------------------------------------------


def tree_leaf_hash(spark, sf_dir):
    """Trees of the folders that hold files only."""
    w = hashed(spark, sf_dir)
    _, trees = tree.build_tree(w)
    return trees.where(P.depth(F.col("dir")) == 2).select("dir", "hash")


def tree_nested_root(spark, sf_dir):
    _, trees = tree.build_tree(hashed(spark, sf_dir))
    return trees.where("dir = ''").select("hash")


def tree_entries(spark, sf_dir):
    entries, _ = tree.build_tree(hashed(spark, sf_dir))
    return tree.tree_entries(entries)


def tree_expand(spark, sf_dir):
    """The root's files after building: the round trip of a snapshot."""
    entries = cut(tree.build_tree(hashed(spark, sf_dir))[0])
    root = entries.where("dir = ''").select(F.col("tree_hash").alias("root")).distinct()
    return tree.expand(cut(tree.tree_entries(entries)), root).select("path", "hash")


def _clashing(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return w.select("path", "hash").unionByName(w.where("doc_id % 10 = 0").select(F.concat("path", F.lit("/x/"), F.col("doc_id").cast("string")).alias("path"), "hash"))


def tree_conflict_drop(spark, sf_dir):
    return tree.drop_conflicts(_clashing(spark, sf_dir))


def restore_blobs(spark, sf_dir):
    """Files of a snapshot with the size of what is written."""
    w = hashed(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    blobs = d.select(H.blob_hash(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("content")).dropDuplicates(["hash"])
    return tree.restore(_head(w), blobs).select("path", "hash", F.octet_length("content").cast("bigint").alias("size"))


# -- history ----------------------------------------------------------------------------------------------------


def commit_chain(spark, sf_dir):
    return _chained(spark, sf_dir).select("branch", "pos", "hash", "parent")


def commit_payload_size(spark, sf_dir):
    c = _commits(spark, sf_dir)
    text = C.commit_text(F.col("tree"), F.array(F.lit("")), F.col("author"), F.col("committer"), F.col("message"))
    return c.select("branch", "pos", F.octet_length(text).cast("bigint").alias("size"), H.object_hash("commit", text).alias("root_hash"))


def _stored_commits(spark, sf_dir):
    return _chained(spark, sf_dir).select("hash", F.array("parent").alias("parents"))


def log_first_parent(spark, sf_dir):
    c = _stored_commits(spark, sf_dir)
    return history.first_parent_log(c, _refs(spark, sf_dir).select(F.col("commit_hash").alias("hash"))).select("tip", "depth", "hash")


def commit_decode(spark, sf_dir):
    c = _commits(spark, sf_dir)
    text = C.commit_text(F.col("tree"), F.array(F.lit("p1"), F.lit("p2")), F.col("author"), F.col("committer"), F.concat("message", F.lit("\n\n")))
    parsed = c.select("branch", "pos", C.parse_commit(text).alias("c"))
    return parsed.select("branch", "pos", "c.tree", F.array_join("c.parents", ",").alias("parents"), F.col("c.author.name").alias("author"), F.col("c.author.ts").alias("ts"), F.sha2(F.col("c.message").cast("binary"), 256).alias("message_sha256"))


def commit_tree_pointer(spark, sf_dir):
    c = _commits(spark, sf_dir)
    text = C.commit_text(F.col("tree"), F.array().cast("array<string>"), F.col("author"), F.col("committer"), F.col("message"))
    return c.select("branch", "pos", C.tree_pointer(text).alias("tree"))


def signature_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    tail = F.concat(F.lit("> "), F.when(i % 5 == 0, F.lit("soon")).otherwise((i + 1700000000).cast("string")), F.lit(" +0000"))
    line = F.concat("c_name", F.lit(" "), F.when(i % 3 == 0, F.lit("")).otherwise(F.lit("<")), F.lit("c"), i.cast("string"), F.lit("@x.y"), tail)
    s = c.select(F.col("c_custkey").alias("id"), C.parse_signature(line).alias("s"))
    return s.select("id", "s.name", "s.email", "s.ts", "s.tz")


def merge_first_parent(spark, sf_dir):
    """Commits with two parents: the first non-empty one counts."""
    c = _chained(spark, sf_dir)
    return c.select("hash", F.try_element_at(F.filter(F.array("parent", F.lit("other")), lambda p: p != ""), F.lit(1)).alias("first_parent"))


# -- refs and configuration -------------------------------------------------------------------------------------


def resolve_head(spark, sf_dir):
    return refs.resolve_head(_one_head(spark), _refs(spark, sf_dir))


def branch_list(spark, sf_dir):
    return refs.branch_list(_refs(spark, sf_dir), _one_head(spark))


def branch_create(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), (F.col("n_nationkey") * 5).cast("string")).alias("name"))
    names = names.unionByName(table(spark, sf_dir, "region").select(F.lower("r_name").alias("name")))
    return refs.branch_create(_refs(spark, sf_dir), _one_head(spark), names)


def set_head_normalize(spark, sf_dir):
    r = _refs(spark, sf_dir)
    targets = r.select(F.col("name").alias("target")).unionByName(r.select(F.concat(F.lit("refs/heads/"), "name").alias("target"))).unionByName(r.select(F.concat(F.lit("ref: refs/heads/"), "name").alias("target"))).unionByName(r.select(F.col("commit_hash").alias("target")))
    return refs.set_head(targets)


def _config_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 8
    line = (
        F.when(k == 0, F.concat(F.lit(" ["), "event_type", F.lit("]"))).when(k == 1, F.lit("# comment = x")).when(k == 2, F.lit("")).when(k == 3, F.lit("no value")).when(k == 4, F.lit("; other = y"))
        .otherwise(F.concat(F.lit("\t"), F.lit("key"), (F.col("user_id") % 50).cast("string"), F.lit(" = a="), F.col("event_id").cast("string"), F.lit(" ")))
    )
    return e.select((F.col("event_id") % 16).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


def config_parse(spark, sf_dir):
    return lines.parse_config(_config_lines(spark, sf_dir), "file")


def config_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat("event_type", F.lit("."), F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return lines.last_wins(rows, ["key"], "seq")


def config_get_default(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    config = n.select(F.when(F.col("n_nationkey") == 0, "user.email").otherwise(F.concat(F.lit("k."), F.col("n_nationkey").cast("string"))).alias("key"), F.when(F.col("n_nationkey") == 0, "").otherwise(F.col("n_name")).alias("value"))
    keys = n.select(F.concat(F.lit("k."), (F.col("n_nationkey") * 2).cast("string")).alias("key")).unionByName(spark.createDataFrame([("user.name",), ("user.email",)], "key string"))
    return refs.config_get(config, keys)


def resolve_head_tree(spark, sf_dir):
    """HEAD -> branch -> commit -> tree, over all commits."""
    c = _commits(spark, sf_dir).select("branch", "pos", "tree").join(_chained(spark, sf_dir).select("branch", "pos", "hash"), ["branch", "pos"])
    return refs.resolve_head(_one_head(spark), _refs(spark, sf_dir), c)


def index_format(spark, sf_dir):
    """Index rows as the lines of the index file, in byte order of the path."""
    return lines.format_index(_index(hashed(spark, sf_dir)))


def config_format(spark, sf_dir):
    """Settings as the lines of the configuration file, in byte order of the key."""
    return lines.format_config(config_last_wins(spark, sf_dir))


def negotiate_answer(spark, sf_dir):
    """JSON answers, one a request of one chunk; stored chunks are not asked for."""
    asked, stored = _chunks(hashed(spark, sf_dir))
    missing = compare.negotiate(asked, stored)
    return missing.select("sha256", report.json_answer(F.array("sha256")).alias("answer"))


def health(spark, sf_dir):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in report.HEALTH.items()])


def config_list(spark, sf_dir):
    config = table(spark, sf_dir, "nation").where("n_nationkey = 1").select(F.lit("user.name").alias("key"), F.col("n_name").alias("value"))
    return refs.config_list(config)


# -- checkout and negotiation -----------------------------------------------------------------------------------


def checkout_delta(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.checkout_delta(_head(w), w.where("doc_id % 4 <> 1").select("path", "hash"))


def checkout_missing_objects(spark, sf_dir):
    w = hashed(spark, sf_dir)
    return compare.missing_objects(_index(w), w)


def _chunks(w):
    return w.select(F.col("hash").alias("sha256")), w.where("doc_id % 4 = 0").select(F.col("hash").alias("sha256"))


def negotiate_stub(spark, sf_dir):
    return compare.negotiate_stub(_chunks(hashed(spark, sf_dir))[0])


def negotiate(spark, sf_dir):
    return compare.negotiate(*_chunks(hashed(spark, sf_dir)))


def negotiate_request(spark, sf_dir):
    """JSON request bodies: validation, and the chunks that are asked for."""
    w = hashed(spark, sf_dir)
    chunk = F.concat(F.lit('{"sha256": "'), "hash", F.lit('"}'))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"chunks": ['), chunk, F.lit(", "), chunk, F.lit("]}"))).when(F.col("doc_id") % 3 == 1, F.lit('{"chunks": "x"}')).otherwise(F.lit("{}"))
    parsed = lines.parse_request(w.select("doc_id", body.alias("body")))
    return parsed.select("doc_id", "valid", F.array_join(F.transform("chunks", lambda c: c["sha256"]), ",").alias("asked")).select("doc_id", "valid", F.when(F.col("valid"), F.col("asked")).otherwise("").alias("asked"))


# -- bytes and files ------------------------------------------------------------------------------------------


def zlib_roundtrip(spark, sf_dir):
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", H.payload("blob", F.col("text")).alias("payload")).withColumn("stream", H.deflate(F.col("payload")))
    back = d.select("doc_id", F.octet_length("payload").cast("bigint").alias("size"), H.inflate(F.col("stream")).alias("back"))
    return back.select("doc_id", "size", F.sha2("back", 256).alias("hash"))


def tree_decode(spark, sf_dir):
    """Tree objects written as bytes and read back as entries."""
    _, trees = tree.build_tree(hashed(spark, sf_dir))
    return objects.decode_trees(tree.tree_objects(trees))


def worktree_scan(spark, sf_dir):
    """The file source over a small folder with hidden, empty and ignored files."""
    root = Path(tempfile.mkdtemp(prefix="snapstore-scan-"))
    for name, text in {".env": "e", "_u.py": "u", ".hid/z": "z", "empty": "", "a/b/c.txt": "c", ".gitignore": "i", "build/o": "o", "x/rebuild/y": "y", "build.txt": "b"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return index.candidates(read_worktree(spark, str(root)))


_ALL = (
    blob_hash, blob_dedup, object_path, object_get, hex_roundtrip, blob_decode, ignore_filter, normalize_path, path_parts, index_parse, index_upsert, add_delta, index_remove, worktree_candidates,
    status_staged, status_modified, status_deleted, status_untracked, status_all, status_footer, tree_leaf_hash, tree_nested_root, tree_entries, tree_expand, tree_conflict_drop, restore_blobs,
    commit_chain, commit_payload_size, log_first_parent, commit_decode, commit_tree_pointer, signature_parse, merge_first_parent, resolve_head, branch_list, branch_create, set_head_normalize,
    config_parse, config_last_wins, config_get_default, config_list, resolve_head_tree, index_format, config_format, negotiate_answer, health, checkout_delta, checkout_missing_objects, negotiate_stub, negotiate, negotiate_request, zlib_roundtrip, tree_decode, worktree_scan,
)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    from .oracles import ORACLES

    return dict(ORACLES)
