"""Exact dedup by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copy_key, keep_rows, remove, saved, saved_at, small

#: A chunk ends after `edge`, or after MAX characters; it has MIN at least unless the text ends.
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: About one place in 500 in Latin prose, and sentence ends of other scripts.
EDGE = r"(?:[bgkpvwzBGKPVWZ][iou][bcdfgm]|[。！？؟।])"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def chunks(text: Column) -> Column:
    """The text cut at places that depend on the characters around them alone."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{EDGE}|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and copy_key for each row of docs (doc_id, text; others ignored).

    Texts are equal when identical after white space [\\x20\\x09-\\x0D] goes; null counts as empty. The row with the most
    code points stays, then the smallest doc_id (a null id is the largest), then the smallest hash of the text; of rows
    equal in all of these the first one written stays. An empty table gives an empty one.

    Each text is cut into content-defined chunks in one scan. A chunk's identifier is its 64-bit hash, verified: all
    chunks of the hash are compared, and a text with a chunk whose hash stands for several is also told apart by its
    SHA-256. Texts are equal when their ordered identifiers are. Chunks move once and copies of a chunk are reduced to
    one before they do, so neither long texts nor large groups gather in a task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("points"), copy_key(text).alias("copy_key"), normalised(text).alias("n"))
    rows = rows.withColumn("chunk", chunks(F.col("n")))
    # first table: recipes, which have no text
    recipes = rows.select("doc_id", "points", "copy_key", F.sha2(F.col("n").cast("binary"), 256).alias("text_sha256"), F.transform("chunk", lambda c: F.xxhash64(c)).alias("recipe"), F.monotonically_increasing_id().alias("uid"))
    recipes, _ = saved_at(recipes, "recipes")
    # second: hashes that stand for several chunks; only hashes seen twice have anything to compare
    ids = recipes.select(F.explode("recipe").alias("id")).groupBy("id").count().where("count > 1").select("id")
    ids, at = saved_at(ids, "repeated")
    pieces = rows.select(F.explode("chunk").alias("chunk")).withColumn("id", F.xxhash64("chunk"))
    pieces = pieces.join(small(ids, ids.count()), "id", "left_semi")
    clash = pieces.groupBy("id", "chunk").count().groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id")
    clash, clash_at = saved_at(clash, "clashes")
    key = F.lit("")
    if n := clash.count():
        of = recipes.select("uid", F.explode("recipe").alias("id")).join(small(clash, n), "id", "left_semi").select("uid").distinct().withColumn("clashes", F.lit(True))
        recipes = saved(recipes.join(of, "uid", "left"), "recipes")
        key = F.when(F.col("clashes"), F.col("text_sha256")).otherwise("")
    recipes = recipes.withColumn("apart", key)
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("copy_key").alias("keep_key"), F.col("uid").alias("keep_uid"))
    groups = recipes.groupBy("recipe", "apart").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    # a group is known by its least uid from here on; the join's left side may be skewed, which Spark splits
    groups = groups.select("recipe", "apart", "best.keep_id", "best.keep_uid", "group_size")
    joined = recipes.join(groups, ["recipe", "apart"])
    out = joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "copy_key")
    remove(spark, at, clash_at)
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; of rows equal in doc_id and text, one stays if they stay."""
    return keep_rows(docs, exact_groups(docs))
