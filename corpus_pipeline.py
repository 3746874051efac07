"""The corpus pipeline: toxicity, line de-duplication, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from snapstore.llm import decontaminate, line_dedup, near_dedup, packing, toxicity, workspace

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from ``labels`` of the rows that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where(toxicity.may_learn(F.col("doc_id"))))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select("row.*")


def cut_boilerplate(spark, docs, sf_dir):
    """Lines that many sites share are cut, but for their first occurrence; a document of nothing else goes."""
    found = line_dedup.line_dedup(docs)
    left = found.where((F.col("n_removed") == 0) | (F.btrim("cleaned", F.lit(line_dedup.WHITE + "\n")) != ""))
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = F.when(changed, F.col("cleaned")).otherwise(own)
        elif c == "n_chars":
            own = F.when(changed, F.length("cleaned").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return left.select(*columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays (five words, 0.8 or more)."""
    gone = near_dedup.near_dedup(docs, shingle_words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where(~F.col("contaminated")).select("row.*")


def pack(spark, docs, sf_dir):
    """Sequences of at most 1024 ids: one row a piece, with its ids and their digests."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_boilerplate), ("MinHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_contaminated), ("packing", pack)]

#: Classification, similarity groups and token ids are beyond SQL; tests check examples of each stage, not whole results.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = workspace.materialise(stage(spark, docs, sf_dir), "pipeline")
        workspace.release("toxicity", "line_dedup", "near_dedup", "decontaminate")
    return STAGES[-1][1](spark, docs, sf_dir)
