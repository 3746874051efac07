"""Line formats: index, config, and the request body of a push negotiation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import trim
from ..schema import CHUNKS


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the one with the largest ``order``; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return out.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def parse_index(lines: DataFrame) -> DataFrame:
    """``line_no``, ``line`` -> ``path``, ``hash``, ``mode``.  Three white-space tokens; further tokens are dropped, so
    a path ends at its first space; lines of fewer tokens are dropped; the last line of a path wins."""
    tokens = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    rows = lines.select("line_no", tokens.alias("t")).where(F.size("t") >= 3)
    return last_wins(rows.select("line_no", F.col("t")[2].alias("path"), F.col("t")[1].alias("hash"), F.col("t")[0].alias("mode")), ["path"], "line_no")


def format_index(index: DataFrame) -> DataFrame:
    """Index rows as lines, in byte order of the path."""
    return index.orderBy("path").select(F.concat_ws(" ", "mode", "hash", "path").alias("line"))


def parse_config(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """``line_no``, ``line`` (and a file column) -> ``key``, ``value``.

    Comments (``#``, ``;``), blank lines and lines without ``=`` are dropped; the first ``=`` splits; a section opened
    before prefixes the key; the last value wins.  Sections need the order of one file's lines, and no more.
    """
    part = [file_col] if file_col else []
    order = Window.partitionBy(*part).orderBy("line_no") if part else Window.partitionBy(F.lit(0)).orderBy("line_no")
    text = trim(F.col("line"))
    opened = F.when(F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")), text.substr(F.lit(2), F.length(text) - 2))
    rows = lines.select(*part, "line_no", text.alias("line"), opened.alias("opened")).where((F.col("line") != "") & ~F.substring("line", 1, 1).isin("#", ";"))
    rows = rows.withColumn("section", F.last("opened", ignorenulls=True).over(order)).where(F.col("opened").isNull() & F.contains("line", F.lit("=")))
    at = F.instr("line", "=")
    key = trim(F.col("line").substr(F.lit(1), at - 1))
    value = trim(F.col("line").substr(at + 1, F.length("line")))
    full = F.when(F.coalesce("section", F.lit("")) != "", F.concat("section", F.lit("."), key)).otherwise(key)
    return last_wins(rows.select(*part, "line_no", full.alias("key"), value.alias("value")), [*part, "key"], "line_no")


def format_config(config: DataFrame) -> DataFrame:
    """Flat ``key = value`` lines in byte order of the key."""
    return config.orderBy("key").select(F.concat(F.col("key"), F.lit(" = "), F.col("value")).alias("line"))


def parse_request(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """JSON bodies with their ``chunks``; ``valid`` is false where ``chunks`` is no array."""
    parsed = F.from_json(F.col(body_col), CHUNKS)
    is_array = F.startswith(F.ltrim(F.get_json_object(body_col, "$.chunks")), F.lit("["))
    return bodies.withColumn("chunks", parsed["chunks"]).withColumn("valid", F.coalesce(is_array, F.lit(False)) & F.col("chunks").isNotNull())
