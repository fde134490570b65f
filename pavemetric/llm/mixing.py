"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small

#: A mean above this is the sum of so many equal means below it, each drawn by itself; terms of a draw's table.
MEAN_STEP, TERMS = 8.0, 64
#: Target share of each source, as a power of its share in the corpus.
TEMPERATURE = 0.5


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by colons; null counts as an empty string."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(N <= k) for k from 0 to TERMS - 1, by the recurrence of the terms."""
    step = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), step, lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")), lambda s: s["c"])


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = "mix", temperature: float = TEMPERATURE, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs, each replicated a Poisson number of times, dealt over all tasks in random order.

    A source's mean repetition rate is its target rows / its rows. Target shares are `weights` (normalised; sources that
    are not in it get none), or else a power of the corpus shares; `total` rows are aimed at, by default as many as there
    are. The number of copies is the inverse of the Poisson distribution at a uniform number hashed from seed and
    doc_id, so a row keeps it whatever the order or the tasks. Adds copy (from 0), copies and shuffle_key to `columns`
    (all by default). Rows with the same doc_id have the same number of copies; null sources and ids are values like
    any other; empty texts stay; a source named with a weight but without rows gets none; an empty table gives an empty
    one. Columns named copy, copies or shuffle_key are replaced.
    """
    p = fresh(docs, "m_")
    columns = [c for c in columns or docs.columns if c not in ("copy", "copies", "shuffle_key")]
    counts = docs.groupBy(F.col("source").alias(f"{p}source")).agg(F.count("*").alias(f"{p}rows"))
    if weights is None:
        share = F.pow(F.col(f"{p}rows").cast("double"), F.lit(temperature))
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(f"{p}source")], F.lit(0.0)).cast("double")
    counts = counts.withColumn(f"{p}share", share)
    sums = counts.agg(F.sum(f"{p}rows").alias("rows"), F.sum(f"{p}share").alias("shares"), F.count("*").alias("n")).first()
    if not sums["rows"] or not sums["shares"]:
        return docs.select(*columns, F.lit(0).alias("copy"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("shuffle_key")).where("false")
    rate = F.col(f"{p}share") * F.lit(float(total if total is not None else sums["rows"])) / F.lit(float(sums["shares"])) / F.col(f"{p}rows")
    rates = counts.select(f"{p}source", rate.alias(f"{p}rate")).withColumn(f"{p}draws", F.greatest(F.lit(1), F.ceil(F.col(f"{p}rate") / MEAN_STEP))).withColumn(f"{p}table", poisson_table(F.col(f"{p}rate") / F.col(f"{p}draws")))
    mixed = docs.select(*columns, *([] if "source" in columns else ["source"]), *([] if "doc_id" in columns else ["doc_id"]))
    mixed = mixed.join(small(rates, sums["n"], 100_000), mixed["source"].eqNullSafe(rates[f"{p}source"]))
    draw = lambda j: F.size(F.filter(f"{p}table", lambda c: c <= uniform(F.lit(seed), F.col("doc_id"), j)))
    mixed = mixed.withColumn("copies", F.aggregate(F.sequence(F.lit(1), F.col(f"{p}draws").cast("int")), F.lit(0), lambda n, j: n + draw(j))).where("copies > 0")
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mixed = mixed.withColumn("shuffle_key", (uniform(F.lit(f"{seed} order"), F.col("doc_id"), F.col("copy")) * float(1 << 52)).cast("long"))
    # a random key, so each task gets a random share of the rows in random order
    return mixed.select(*columns, "copy", "copies", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
