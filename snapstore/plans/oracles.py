"""DuckDB SQL for the snapshot queries, over the same tables and adapters."""

from __future__ import annotations


def _obj(kind: str, body: str) -> str:
    """SHA-256 of an object with this body (a blob expression)."""
    return f"sha256(encode('{kind} ' || CAST(octet_length({body}) AS VARCHAR)) || '\\x00'::BLOB || {body})"


_BLOB = _obj("blob", "encode(text)")
_W = f"w AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, {_BLOB} AS hash FROM documents)"
_PARTS = f"""{_W},
    head AS (SELECT path, hash FROM w WHERE doc_id % 3 <> 0),
    idx AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256('index:' || hash) ELSE hash END AS hash, '100644' AS mode, doc_id FROM w WHERE doc_id % 7 <> 0),
    disk AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256('disk:' || hash) ELSE hash END AS hash FROM idx WHERE doc_id % 13 <> 0
             UNION ALL SELECT path, hash FROM w WHERE doc_id % 7 = 0)"""
_STAGED = "SELECT 'staged' AS section, CASE WHEN head.hash IS NULL THEN 'new file' ELSE 'modified' END AS kind, idx.path AS path FROM idx LEFT JOIN head USING (path) WHERE head.hash IS NULL OR head.hash <> idx.hash"
_MODIFIED = "SELECT 'unstaged' AS section, 'modified' AS kind, idx.path AS path FROM idx JOIN disk USING (path) WHERE disk.hash <> idx.hash"
_DELETED = "SELECT 'unstaged' AS section, 'deleted' AS kind, path FROM idx WHERE path NOT IN (SELECT path FROM disk)"
_UNTRACKED = "SELECT 'untracked' AS section, 'untracked' AS kind, path FROM disk WHERE path NOT IN (SELECT path FROM idx)"
_ALL = f"{_STAGED} UNION ALL {_MODIFIED} UNION ALL {_DELETED} UNION ALL {_UNTRACKED}"


def _tree(name_hash_rows: str, mode: str) -> str:
    body = f"unhex(string_agg(hex(encode('{mode} ' || name)) || '00' || upper(hash), '' ORDER BY name))"
    return f"SELECT dir, {body} AS body FROM ({name_hash_rows}) GROUP BY dir"


_TREES = f"""{_W},
    leaf AS (SELECT dir, {_obj("tree", "body")} AS hash FROM ({_tree("SELECT source || '/' || lang AS dir, 'd' || doc_id || '.txt' AS name, hash FROM w JOIN documents USING (doc_id)", "100644")})),
    mid AS (SELECT dir, {_obj("tree", "body")} AS hash FROM ({_tree("SELECT split_part(dir, '/', 1) AS dir, split_part(dir, '/', 2) AS name, hash FROM leaf", "040000")})),
    root AS (SELECT {_obj("tree", "body")} AS hash FROM ({_tree("SELECT '' AS dir, dir AS name, hash FROM mid", "040000")}))"""

_ODD = """p AS (SELECT doc_id, (['src/', '.git/', 'x.github/', 'rebuild/', 'build-', '.vscode/', 'vcpkg/', 'vcpkg.', './'])[doc_id % 9 + 1] || source || '/' || lang AS path, text FROM documents),
    kept AS (SELECT * FROM p WHERE NOT (contains(path, '.aigit') OR contains(path, 'build/') OR contains(path, '.git') OR contains(path, '.vscode/') OR contains(path, 'vcpkg/')))"""
_WHO = "'Unknown User unknown@example.com> ' || (1700000000 + turn) || ' +0000'"
_TAIL = f"'author ' || {_WHO} || chr(10) || 'committer ' || {_WHO} || chr(10) || chr(10) || text || chr(10)"
_COMMITS = f"""c AS (SELECT conv_id AS branch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, {_BLOB} AS tree, {_TAIL} AS tail, text, turn FROM conversations)"""
_TEXT = "encode('tree ' || c.tree || chr(10) || c.tail)"
_NEXT = "encode('tree ' || c.tree || chr(10) || 'parent ' || chain.hash || chr(10) || c.tail)"
_CHAIN = f"""{_COMMITS},
    chain AS (SELECT branch, pos, {_obj("commit", _TEXT)} AS hash, '' AS parent FROM c WHERE pos = 1
              UNION ALL SELECT c.branch, c.pos, {_obj("commit", _NEXT)}, chain.hash FROM chain JOIN c ON c.branch = chain.branch AND c.pos = chain.pos + 1)"""
_REFS = f"{_CHAIN}, refs AS (SELECT 'b' || branch AS name, arg_max(hash, pos) AS commit_hash FROM chain GROUP BY branch)"
_HEAD_NAME = "substr(target, 1, 5) = 'ref: '"
_RAW = "CASE WHEN doc_id % 2 = 0 THEN '././' ELSE './' END || source || chr(92) || lang || CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(13) || chr(10) ELSE '' END"

ORACLES = {
    "blob_hash": f"SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, {_BLOB} AS hash FROM documents",
    "blob_dedup": f"SELECT {_BLOB} AS hash, count(*) AS copies, min(doc_id) AS first_doc, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "object_path": f"WITH {_W} SELECT doc_id, substr(hash, 1, 2) || '/' || substr(hash, 3) AS object_path FROM w",
    "object_get": f"""WITH {_W} SELECT w.doc_id, CASE WHEN w.doc_id % 3 = 0 THEN sha256('absent:' || hash) ELSE hash END AS hash,
        CASE WHEN w.doc_id % 3 <> 0 THEN CAST(octet_length(encode(text)) AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS size, w.doc_id % 3 <> 0 AS found FROM w JOIN documents d ON d.doc_id = w.doc_id""",
    "hex_roundtrip": f"WITH {_W} SELECT doc_id, hash, CAST(octet_length(unhex(hash)) AS BIGINT) AS n_bytes FROM w",
    "blob_decode": "SELECT doc_id, 'blob' AS kind, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS content_sha256 FROM documents",
    "ignore_filter": f"WITH {_ODD} SELECT doc_id, path FROM kept",
    "normalize_path": f"""SELECT doc_id, regexp_replace(raw, '^\\./', '') AS for_add, regexp_replace(regexp_replace(replace(raw, chr(92), '/'), '^\\./', ''), '[\\r\\n ]+$', '') AS for_status
        FROM (SELECT doc_id, {_RAW} AS raw FROM documents)""",
    "path_parts": "SELECT doc_id, source || '/' || lang AS dir, 'd' || doc_id || '.txt' AS name, CAST(3 AS BIGINT) AS depth, source || '|' || source || '/' || lang AS ancestors FROM documents",
    "index_parse": """WITH l AS (SELECT event_id AS line_no, ' 100644' || g || sha256(CAST(event_id AS VARCHAR)) || g || CASE WHEN event_id % 9 = 0 THEN '' ELSE 'f' || user_id || CASE WHEN event_id % 6 = 0 THEN ' tail x' ELSE '' END END AS line
            FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' ' END AS g FROM events)),
        t AS (SELECT line_no, regexp_split_to_array(trim(line), '\\s+') AS t FROM l)
        SELECT t[3] AS path, arg_max(t[2], line_no) AS hash, arg_max(t[1], line_no) AS mode FROM t WHERE len(t) >= 3 GROUP BY t[3]""",
    "index_upsert": f"""WITH {_PARTS}, cand AS (SELECT path, hash, '100644' AS mode FROM w WHERE doc_id % 2 = 0)
        SELECT path, hash, mode FROM idx WHERE path NOT IN (SELECT path FROM cand) UNION ALL SELECT path, hash, mode FROM cand""",
    "add_delta": f"WITH {_PARTS} SELECT w.path, w.hash FROM w LEFT JOIN idx USING (path) WHERE w.doc_id % 2 = 0 AND (idx.hash IS NULL OR idx.hash <> w.hash)",
    "index_remove": f"WITH {_PARTS} SELECT path, hash, mode FROM idx WHERE doc_id % 4 <> 0",
    "worktree_candidates": f"WITH {_ODD} SELECT regexp_replace(path || '/' || doc_id, '^\\./', '') AS path, {_BLOB} AS hash, '100644' AS mode FROM kept",
    "status_staged": f"WITH {_PARTS} {_STAGED}",
    "status_modified": f"WITH {_PARTS} {_MODIFIED}",
    "status_deleted": f"WITH {_PARTS} {_DELETED}",
    "status_untracked": f"WITH {_PARTS} {_UNTRACKED}",
    "status_all": f"WITH {_PARTS} {_ALL}",
    "status_footer": f"""WITH {_PARTS} SELECT n_staged, n_unstaged, n_untracked, CASE WHEN n_staged > 0 THEN 'staged' WHEN n_untracked > 0 THEN 'untracked' WHEN n_unstaged > 0 THEN 'unstaged' ELSE 'clean' END AS footer
        FROM (SELECT count(*) FILTER (section = 'staged') AS n_staged, count(*) FILTER (section = 'unstaged') AS n_unstaged, count(*) FILTER (section = 'untracked') AS n_untracked FROM ({_ALL}))""",
    "tree_leaf_hash": f"WITH {_TREES} SELECT dir, hash FROM leaf",
    "tree_nested_root": f"WITH {_TREES} SELECT hash FROM root",
    "tree_entries": f"""WITH {_TREES}, e AS (
            SELECT leaf.hash AS tree_hash, dir, '100644' AS mode, 'd' || doc_id || '.txt' AS name, w.hash AS hash, false AS is_subtree FROM w JOIN documents USING (doc_id) JOIN leaf ON dir = source || '/' || lang
            UNION ALL SELECT mid.hash, mid.dir, '040000', split_part(leaf.dir, '/', 2), leaf.hash, true FROM leaf JOIN mid ON mid.dir = split_part(leaf.dir, '/', 1)
            UNION ALL SELECT root.hash, '', '040000', mid.dir, mid.hash, true FROM mid, root),
        one AS (SELECT tree_hash, min(dir) AS dir FROM e GROUP BY tree_hash)
        SELECT tree_hash, CAST(row_number() OVER (PARTITION BY tree_hash ORDER BY name) - 1 AS INTEGER) AS pos, mode, name, hash, is_subtree FROM e JOIN one USING (tree_hash, dir)""",
    "tree_expand": f"WITH {_W} SELECT path, hash FROM w",
    "tree_conflict_drop": f"WITH {_W} SELECT path, hash FROM w",
    "restore_blobs": f"WITH {_PARTS} SELECT head.path, head.hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM head JOIN w USING (path) JOIN documents USING (doc_id)",
    "commit_chain": f"WITH RECURSIVE {_CHAIN} SELECT branch, pos, hash, parent FROM chain",
    "commit_payload_size": f"WITH {_COMMITS} SELECT branch, pos, CAST(octet_length({_TEXT}) AS BIGINT) AS size, {_obj('commit', _TEXT)} AS root_hash FROM c",
    "log_first_parent": f"WITH RECURSIVE {_REFS} SELECT commit_hash AS tip, max(pos) OVER (PARTITION BY branch) - pos AS depth, hash FROM chain JOIN refs ON name = 'b' || branch",
    "commit_decode": f"""WITH {_COMMITS} SELECT branch, pos, tree, 'p1,p2' AS parents, {_WHO} AS author, CAST(0 AS BIGINT) AS ts, sha256(rtrim(text, chr(10))) AS message_sha256 FROM c""",
    "commit_tree_pointer": f"WITH {_COMMITS} SELECT branch, pos, tree FROM c",
    "signature_parse": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' c' || c_custkey || '@x.y> ' || CASE WHEN c_custkey % 5 = 0 THEN 'soon' ELSE CAST(c_custkey + 1700000000 AS VARCHAR) END || ' +0000' ELSE rtrim(c_name) END AS name,
            CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_custkey || '@x.y' END AS email, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE c_custkey + 1700000000 END AS ts,
            CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+0000' END AS tz FROM customer""",
    "merge_first_parent": f"WITH RECURSIVE {_CHAIN} SELECT hash, CASE WHEN parent = '' THEN 'other' ELSE parent END AS first_parent FROM chain",
    "resolve_head": f"WITH RECURSIVE {_REFS} SELECT 'b3' AS branch, (SELECT commit_hash FROM refs WHERE name = 'b3') AS commit_hash",
    "resolve_head_tree": f"""WITH RECURSIVE {_REFS}, tip AS (SELECT commit_hash FROM refs WHERE name = 'b3')
        SELECT 'b3' AS branch, (SELECT commit_hash FROM tip) AS commit_hash, (SELECT c.tree FROM c JOIN chain ON chain.branch = c.branch AND chain.pos = c.pos WHERE chain.hash = (SELECT commit_hash FROM tip)) AS tree""",
    "index_format": f"WITH {_PARTS} SELECT mode || ' ' || hash || ' ' || path AS line FROM idx",
    "config_format": "SELECT event_type || '.' || user_id || ' = ' || arg_max(CAST(event_id AS VARCHAR), event_id) AS line FROM events GROUP BY event_type, user_id",
    "negotiate_answer": f"""WITH {_W} SELECT hash AS sha256, '{{"missing_chunks":["' || hash || '"],"upload_urls":{{}}}}' AS answer FROM w WHERE hash NOT IN (SELECT hash FROM w WHERE doc_id % 4 = 0)""",
    "health": "SELECT 'ok' AS status, 'snapstore' AS service",
    "zlib_roundtrip": f"SELECT doc_id, CAST(octet_length(encode('blob ' || octet_length(encode(text)))) + 1 + octet_length(encode(text)) AS BIGINT) AS size, {_BLOB} AS hash FROM documents",
    "branch_list": f"WITH RECURSIVE {_REFS} SELECT name, name = 'b3' AS is_current FROM refs",
    "branch_create": f"""WITH RECURSIVE {_REFS}, asked AS (SELECT 'b' || (n_nationkey * 5) AS name FROM nation UNION ALL SELECT lower(r_name) FROM region)
        SELECT name, outcome, CASE WHEN outcome = 'created' THEN tip END AS commit_hash FROM (
            SELECT asked.name, tip, CASE WHEN refs.name IS NOT NULL THEN 'exists' WHEN tip IS NULL THEN 'no commit' ELSE 'created' END AS outcome
            FROM asked LEFT JOIN refs USING (name), (SELECT max(commit_hash) AS tip FROM refs WHERE name = 'b3'))""",
    "set_head_normalize": f"""WITH RECURSIVE {_REFS}, t AS (SELECT name AS target FROM refs UNION ALL SELECT 'refs/heads/' || name FROM refs UNION ALL SELECT 'ref: refs/heads/' || name FROM refs UNION ALL SELECT commit_hash FROM refs)
        SELECT target, CASE WHEN {_HEAD_NAME} THEN target WHEN substr(target, 1, 5) = 'refs/' THEN 'ref: ' || target WHEN length(target) < 40 THEN 'ref: refs/heads/' || target ELSE target END AS head FROM t""",
    "config_parse": """WITH l AS (SELECT event_id % 16 AS file, event_id AS line_no, event_id % 8 AS k, event_type, 'key' || (user_id % 50) AS key, 'a=' || event_id AS value FROM events),
        s AS (SELECT *, last_value(CASE WHEN k = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS section FROM l),
        kv AS (SELECT file, line_no, CASE WHEN section IS NULL THEN key ELSE section || '.' || key END AS key, value FROM s WHERE k > 4)
        SELECT file, key, arg_max(value, line_no) AS value FROM kv GROUP BY file, key""",
    "config_last_wins": "SELECT event_type || '.' || user_id AS key, arg_max(CAST(event_id AS VARCHAR), event_id) AS value FROM events GROUP BY 1",
    "config_get_default": """WITH config AS (SELECT CASE WHEN n_nationkey = 0 THEN 'user.email' ELSE 'k.' || n_nationkey END AS key, CASE WHEN n_nationkey = 0 THEN '' ELSE n_name END AS value FROM nation),
        keys AS (SELECT 'k.' || (n_nationkey * 2) AS key FROM nation UNION ALL SELECT 'user.name' UNION ALL SELECT 'user.email')
        SELECT key, CASE WHEN config.key IS NOT NULL THEN value WHEN keys.key = 'user.name' THEN 'Unknown User' WHEN keys.key = 'user.email' THEN 'unknown@example.com' END AS value FROM keys LEFT JOIN config USING (key)""",
    "config_list": "SELECT 'user.name' AS key, n_name AS value FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'user.email', 'unknown@example.com'",
    "checkout_delta": f"""WITH {_PARTS}, target AS (SELECT path, hash FROM w WHERE doc_id % 4 <> 1)
        SELECT coalesce(target.path, head.path) AS path, CASE WHEN target.path IS NULL THEN 'remove' ELSE 'write' END AS action, target.hash AS hash FROM head FULL JOIN target ON head.path = target.path""",
    "checkout_missing_objects": f"WITH {_PARTS} SELECT DISTINCT hash FROM idx WHERE hash NOT IN (SELECT hash FROM w)",
    "negotiate_stub": f"WITH {_W} SELECT hash AS sha256 FROM w",
    "negotiate": f"WITH {_W} SELECT hash AS sha256 FROM w WHERE hash NOT IN (SELECT hash FROM w WHERE doc_id % 4 = 0)",
    "negotiate_request": f"WITH {_W} SELECT doc_id, doc_id % 3 = 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN hash || ',' || hash ELSE '' END AS asked FROM w",
}
ORACLES["tree_decode"] = ORACLES["tree_entries"]  # what is decoded is what was folded
