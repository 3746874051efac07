"""Line de-duplication by distinct-site spread: lines that many sites share are boilerplate.

1. Lines are keyed by two 64-bit hashes.  A partial aggregation of the smallest and the largest site hash tells
   which lines have more than one site; only their occurrences go on, as a scratch table.
2. A HyperLogLog sketch of the sites of each line is merged by aggregation; its estimate decides lines that are
   clearly over or under the threshold.
3. Lines near the threshold get an exact distinct count.
4. Of a boilerplate line the first occurrence (smallest id, then place) stays, so no content is lost; all
   others are cut out of their documents.

Aggregations combine before the shuffle and joins are sort-merge joins whose hot partitions Spark splits, so a line
in a third of all documents is no bottleneck.  Nothing is broadcast by hint.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

#: ASCII white space inside a line.
WHITE = " \t\r\x0b\x0c"


def line_dedup(docs: DataFrame, min_sites: int = 5, min_words: int = 2, keep_first: bool = True, lg_k: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Columns ``row`` (the document's own), ``cleaned``, ``n_lines``, ``n_removed``; one row per input row.

    Lines are equal when they are identical after cutting white space at both ends; lines of fewer than
    ``min_words`` words are never boilerplate.  A line is boilerplate from ``min_sites`` distinct sites on; a null
    site is no site.  A null text counts as empty (one empty line); rows with a null id take part like others;
    rows that repeat id and text share their decision; an empty table gives an empty result.
    """
    if min_sites < 2:
        raise ValueError("min_sites is 2 at least")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    text = F.coalesce(docs[text_col], F.lit(""))
    split = lambda c: F.split(c, "\n", -1)
    lines = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), docs[site_col].cast("string").alias("site"), F.posexplode(split(text)).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(WHITE))
    enough = trimmed.rlike(r"^([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (min_words - 1))
    lines = lines.where(enough).select("id", "th", "site", "pos", F.xxhash64(trimmed).alias("k1"), F.xxhash64(F.lit(1), trimmed).alias("k2"))
    site_hash = F.when(F.col("site").isNotNull(), F.xxhash64("site"))
    spread = lines.groupBy("k1", "k2").agg(F.min(site_hash).alias("low"), F.max(site_hash).alias("high")).where("low < high").select("k1", "k2")
    shared = materialise(lines.join(spread, ["k1", "k2"], "left_semi"), "line_dedup")

    band = max(2, math.ceil(4 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    # one aggregation that combines before the shuffle: the sketch, and the first occurrence
    occurrence = F.struct(F.col("id").isNull().alias("last"), "id", "th", "pos")
    sketched = shared.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(occurrence).alias("f"))
    sketched = materialise(sketched, "line_dedup")
    clear = sketched.where(F.col("sites") > min_sites + band).select("k1", "k2", "f")
    near = sketched.where(F.col("sites").between(min_sites - band, min_sites + band)).select("k1", "k2", "f")
    # distinct (line, site) pairs first, so a line's occurrences never meet in one task
    pairs = shared.where(F.col("site").isNotNull()).select("k1", "k2", "site").distinct().join(near, ["k1", "k2"])
    exact = pairs.groupBy("k1", "k2", "f").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("k1", "k2", "f")
    boilerplate = clear.unionByName(exact)

    hits = shared.join(boilerplate, ["k1", "k2"]).select("id", "th", "pos", "f")
    if keep_first:
        hits = hits.where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("pos") == F.col("f.pos"))))
    cuts = hits.groupBy(F.col("id").alias("cut_id"), F.col("th").alias("cut_th")).agg(F.collect_set("pos").alias("cut"))

    keyed = docs.select(row, docs[id_col].alias("id"), text.alias("own_text"), F.xxhash64(text).alias("th"))
    # a merge join at every size: the cuts grow with the corpus
    joined = keyed.join(cuts.hint("merge"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("th") == F.col("cut_th")), "left")
    # the lines are split once a row, and the places kept are found by one hash set
    lined = joined.withColumn("lines", split(F.col("own_text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return lined.select(
        "row", F.when(F.col("cut").isNull(), F.col("own_text")).otherwise(kept).alias("cleaned"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).cast("long").alias("n_removed"),
    )
