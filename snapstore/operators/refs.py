"""HEAD, branches and configuration: small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.commits import branch_of, normalize_head
from ..schema import DEFAULT_CONFIG


def resolve_head(head: DataFrame, refs: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """``branch``, ``commit_hash`` (and ``tree``) that HEAD points to; both null where nothing is there yet.

    A HEAD that is a hash has no branch and, as for the commands, no commit.
    """
    named = head.select(F.rtrim(F.regexp_replace("target", r"[\r\n]+$", "")).alias("target")).select(branch_of(F.col("target")).alias("branch"))
    out = named.join(refs.select(F.col("name").alias("branch"), "commit_hash"), "branch", "left")
    if commits is not None:
        out = out.join(commits.select(F.col("hash").alias("commit_hash"), "tree"), "commit_hash", "left").select("branch", "commit_hash", "tree")
    return out


def short_name(c):
    return F.substring_index(c, "/", -1)


def branch_list(refs: DataFrame, head: DataFrame) -> DataFrame:
    """``name`` and ``is_current``; HEAD is one row (of more, the largest target counts)."""
    one = head.agg(F.max(short_name(F.col("target"))).alias("__current"))  # one row, whatever HEAD holds
    return refs.crossJoin(one).select("name", F.coalesce(F.col("name") == F.col("__current"), F.lit(False)).alias("is_current"))


def branch_create(refs: DataFrame, head: DataFrame, names: DataFrame) -> DataFrame:
    """Requested names with the outcome: ``created``, ``exists``, or ``no commit``, and the commit they get."""
    tip = resolve_head(head, refs).agg(F.max("commit_hash").alias("tip"))  # one row
    asked = names.select("name").join(refs.select("name", F.lit(True).alias("known")), "name", "left").crossJoin(tip)
    outcome = F.when(F.col("known"), "exists").when(F.coalesce("tip", F.lit("")) == "", "no commit").otherwise("created")
    return asked.select("name", outcome.alias("outcome"), F.when(outcome == "created", F.col("tip")).alias("commit_hash"))


def set_ref(refs: DataFrame, name: str, commit_hash: str) -> DataFrame:
    row = refs.sparkSession.createDataFrame([(name, commit_hash)], refs.schema)
    return refs.where(F.col("name") != name).unionByName(row)


def set_head(targets: DataFrame) -> DataFrame:
    return targets.select("target", normalize_head(F.col("target")).alias("head"))


def config_get(config: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of keys; a key that is absent has its default, one that is set to empty stays empty."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULT_CONFIG.items() for x in kv])
    joined = keys.select("key").join(config.select("key", "value", F.lit(True).alias("set")), "key", "left")
    return joined.select("key", F.when(F.col("set"), F.col("value")).otherwise(F.try_element_at(defaults, F.col("key"))).alias("value"))


def config_list(config: DataFrame) -> DataFrame:
    """Author name and mail only, with defaults, as the command lists them."""
    keys = config.sparkSession.createDataFrame([(k,) for k in DEFAULT_CONFIG], "key string")
    return config_get(config, keys)
