"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, line_dedup, lm_scoring, near_dedup, packing, token_counts, token_shards, toxicity

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(chat.probe_conversation(spark))))


def op3_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "contaminated", "n_items", "item_ids", "coverage", "slots")


def op4_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("cleaned", 256).alias("text_sha256"))


def op5_lm_scoring(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return lm_scoring.score_documents(docs, public_tokenizers.path(PIECES), train=F.crc32(docs["doc_id"].cast("string")) % 5 != 1)


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op8_token_shards(spark, sf_dir):
    target = token_shards.write_token_shards(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_shards.shard_digests(spark, target)


def op9_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(toxicity.may_learn(F.col("doc_id"))))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score_toxicity(docs, model).select("row.doc_id", held_out.alias("held_out"), "score", "predicted", F.col("evidence.doc_id").alias("evidence_ids"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep_ids=False)


def queries():
    return {f.__name__: f for f in (op1_near_dedup, op2_chat_format, op3_decontamination, op4_line_dedup, op5_lm_scoring, op6_token_counts, op7_exact_dedup, op8_token_shards, op9_toxicity, op10_packing)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql():
    return {
        "op1_near_dedup": f"""
            WITH RECURSIVE words AS (
                SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
            grams AS (
                SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                                    WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS g FROM words),
            sets AS (SELECT doc_id, len(g) AS n, hash(list_sort(g)) AS k, g FROM grams),
            classes AS (SELECT k, n, min(doc_id) AS node FROM sets WHERE n > 0 GROUP BY k, n),
            items AS (SELECT s.doc_id AS node, s.n, unnest(s.g) AS s FROM sets s JOIN classes c ON s.doc_id = c.node),
            rare AS (SELECT s, count(*) AS f FROM items GROUP BY s HAVING count(*) > 1),
            ordered AS (SELECT node, n, s, row_number() OVER (PARTITION BY node ORDER BY coalesce(f, 1), s) AS p FROM items LEFT JOIN rare USING (s)),
            prefixes AS (SELECT node, n, s FROM ordered WHERE p <= n - ceil(0.8 * n) + 1),
            candidates AS (
                SELECT DISTINCT x.node AS a, y.node AS b FROM prefixes x JOIN prefixes y
                ON x.s = y.s AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
            common AS (SELECT a, b, count(*) AS c FROM candidates JOIN items x ON x.node = a JOIN items y ON y.node = b AND y.s = x.s GROUP BY a, b),
            links AS (
                SELECT a, b FROM common JOIN classes x ON x.node = a JOIN classes y ON y.node = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
            edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach AS (SELECT node AS a, node AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
            comps AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a)
            SELECT doc_id, n AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept
            FROM sets LEFT JOIN (SELECT k, n, comp FROM classes JOIN comps USING (node)) USING (k, n)""",
        "op4_line_dedup": """
            WITH lines AS (
                SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines),
            shared AS (
                SELECT t, min((doc_id, pos)) AS first FROM keyed WHERE regexp_matches(t, '^[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]')
                GROUP BY t HAVING count(DISTINCT source) >= 5),
            marked AS (SELECT doc_id, pos, line, first IS NOT NULL AND first <> (doc_id, pos) AS gone FROM keyed LEFT JOIN shared USING (t))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
            FROM marked GROUP BY doc_id""",
        "op7_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    }
