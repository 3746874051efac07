"""Each query over the smallest tables: its contract's columns and rows, and its SQL where there is one."""

import duckdb
import pytest

from snapstore.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op2_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_decontamination": ["doc_id", "contaminated"],
    "op4_line_dedup": ["doc_id", "n_lines", "n_removed", "text_sha256"],
    "op5_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = found.toPandas()
    if name == "op2_chat_format":
        assert sorted(rows.conv_id) == sorted(x for (x,) in duck.sql("SELECT DISTINCT conv_id FROM conversations UNION SELECT -7").fetchall())
    elif name == "op10_packing":
        assert set(rows.doc_id) == {x for (x,) in duck.sql("SELECT doc_id FROM documents").fetchall()}
        assert (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()
    else:
        assert sorted(rows.doc_id) == sorted(x for (x,) in duck.sql("SELECT doc_id FROM documents").fetchall())
    if name in queries.oracle_sql():
        plain = duck.sql(queries.oracle_sql()[name]).df()
        columns = sorted(plain.columns)
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (rows, plain))
        assert a.equals(b)
