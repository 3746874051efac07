import os
import random

import public_tokenizers
import pytest

import corpus_pipeline
from snapstore.llm import bpe

from .test_text_operators import QUESTIONS, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = toxic_rows(300)
    rng = random.Random(1)
    docs = [(k, t, "en", f"s{k % 7}", len(t)) for k, t in rows]
    for k in range(7):  # one near copy on each site, and a boilerplate line
        words = rows[1][1].split()
        words[k] = "changed"
        docs.append((1000 + k, " ".join(words), "en", f"s{k}", 1))
        docs.append((2000 + k, f"a line on all the sites\nown words {k} {rng.random()}", "en", f"s{k}", 1))
    docs.append((3000, f"before {QUESTIONS[0][1]} after", "en", "s1", 1))
    docs += [(None, None, None, None, None), (4000, "", "en", None, 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(QUESTIONS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic, lined, near, clean = kept
    assert 7 not in toxic and 1 in toxic and None in toxic and 4000 in toxic
    assert "a line on all" in lined[2000]["text"] and all("a line on all" not in lined[2000 + k]["text"] for k in range(1, 7))
    assert lined[2001]["n_chars"] == len(lined[2001]["text"])
    assert 1 in near and not any(1000 + k in near for k in range(7)) and None in near
    assert 3000 in near and 3000 not in clean and 1 in clean


def test_run_packs_what_is_kept(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    path = public_tokenizers.path(corpus_pipeline.TOKENIZER)
    text = dict(toxic_rows(300)[0])[1]
    ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"]))
    assert ids == bpe.UnitMemo(path).encode_all([text])[0] + bytes(4)
    assert not {7, 3000, 1003} & {r["doc_id"] for r in rows}
    assert os.path.isdir(folder)
