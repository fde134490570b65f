"""Line dedup by the spread of a line over distinct sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, remove, saved_at, small

#: Sites from which a line is boilerplate; log2 of the sketch's registers; width of the band with exact counts, in
#: standard errors of the sketch (1.04 / sqrt(registers) each).
MIN_SITES, LG_K, BAND = 10, 11, 5


def line_key(line: Column) -> Column:
    """A line as it is compared: without spaces, tabs and carriage returns around it."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes (h) of lines (h, site) that occur on at least min_sites distinct sites; null is not a site.

    Each hash has a HyperLogLog sketch of its sites; sketches merge in partial aggregation, so a line on every page
    costs a task one sketch. Estimates within BAND standard errors of the threshold (and a site at least) are replaced by
    exact distinct counts.
    """
    spread = lines.where("site is not null").groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    error = max(1.0, BAND * 1.04 / math.sqrt(1 << lg_k) * min_sites)
    spread = spread.where(F.col("sites") >= min_sites - error)
    spread, at = saved_at(spread, "spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= error).select("h")
    exact = lines.where("site is not null").join(small(near, near.count()), "h", "left_semi").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= min_sites)
    out, _ = saved_at(spread.where(F.col("sites") > min_sites + error).select("h").unionByName(exact.select("h")), "boilerplate")
    remove(lines.sparkSession, at)
    return out


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with lines found on min_sites or more distinct sites taken out of every text; adds n_lines and n_removed.

    Lines end at \\n; each is compared without the spaces, tabs and carriage returns around it, and blank lines are never
    boilerplate. Kept lines stay as they were, joined by \\n. Null texts stay null with 0 lines, empty ones have one
    line; repeated rows count their site once; a null site counts for no line, but its texts are cleaned too; an empty
    table gives an empty one. Existing columns named n_lines or n_removed are replaced.
    """
    p, text = fresh(docs, "b_"), F.col("text").cast("string")
    split = F.split(text, "\n", -1)
    hashes = F.transform(F.filter(F.transform(split, line_key), lambda x: x != ""), lambda x: F.xxhash64(x))
    lines = docs.select(F.explode(F.array_distinct(hashes)).alias("h"), F.col(site).cast("string").alias("site"))
    bad = boilerplate(lines, min_sites, lg_k)
    # which hashes go from which text; texts are known by doc_id and hash, and only those that lose lines are listed
    keys = docs.select(F.col("doc_id").cast("long").alias(f"{p}id"), F.xxhash64(text).alias(f"{p}key"), F.explode(F.array_distinct(hashes)).alias("h"))
    gone = keys.join(small(bad, bad.count()), "h", "left_semi").groupBy(f"{p}id", f"{p}key").agg(F.collect_set("h").alias(f"{p}gone"))
    gone, _ = saved_at(gone, "gone")
    out = docs.drop("n_lines", "n_removed").withColumn(f"{p}hash", F.xxhash64(text))
    # a listed text may lose many lines, so the limit is on the hashes
    weight = gone.agg(F.coalesce(F.sum(F.size(f"{p}gone") + 4), F.lit(0))).first()[0]
    out = out.join(small(gone, weight), F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}key")), "left")
    kept = F.filter(split, lambda x: (line_key(x) == "") | ~F.array_contains(f"{p}gone", F.xxhash64(line_key(x))))
    whole = F.col(f"{p}gone").isNull()
    n = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(n)
    removed = F.when(whole, F.lit(0).cast("long")).otherwise(n - F.size(kept))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.when(whole, text).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in names], n.alias("n_lines"), removed.alias("n_removed"))
