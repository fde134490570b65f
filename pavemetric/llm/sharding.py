"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_of_text, remove, saved_at, small

#: Points of each shard on the ring; rows that one ranking task holds.
VIRTUAL_NODES, CELL_ROWS = 64, 500_000
RING = 1 << 60


def position(text: str) -> int:
    """Place on the ring: the first 15 hexadecimal digits of MD5."""
    return int(md5(text.encode()).hexdigest()[:15], 16)


def ring_position(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def ring(shards: int, nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[list[int]]]:
    """Ends of the arcs in ascending order, and for each arc all shards in the order met going clockwise from it."""
    points = sorted((position(f"shard {s} node {v}"), s) for s in range(shards) for v in range(nodes))
    owners = [s for _, s in points]
    preferences = [list(dict.fromkeys(owners[i:] + owners[:i])) for i in range(len(points))]
    return [p for p, _ in points], preferences


def bounded_plan(counts: dict[int, int], preferences: list[list[int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of an arc's keys go to which shard.

    In turn, all keys that have no shard yet ask the next one clockwise, and a shard takes as many as it has room for,
    the arcs taking their share in clockwise order from the shard's number; the rest continue.
    """
    room, used, placed, left = list(capacity), [0] * len(capacity), dict.fromkeys(counts, 0), dict(counts)
    plan = []
    for turn in range(len(capacity)):
        asking: dict[int, list[int]] = {}
        for arc in sorted(a for a, n in left.items() if n):
            asking.setdefault(preferences[arc][turn], []).append(arc)
        for shard, arcs in sorted(asking.items()):
            total, free, before = sum(left[a] for a in arcs), room[shard], 0
            if not free:
                continue
            take = min(total, free)
            for arc in arcs:
                # cumulative shares, so that they sum to what is taken
                share = (before + left[arc]) * take // total - before * take // total
                before += left[arc]
                if share:
                    plan.append((arc, placed[arc], placed[arc] + share, shard, used[shard]))
                    placed[arc] += share
                    used[shard] += share
                    room[shard] -= share
            for arc in arcs:
                left[arc] = counts[arc] - placed[arc]
    return plan


def shard_by_rows(docs: DataFrame, shards: int = 16, nodes: int = VIRTUAL_NODES, cell_rows: int = CELL_ROWS, slack: int = 0) -> DataFrame:
    """Each row's shard and its slot in the shard: doc_id, size, text_crc32, shard, slot.

    Rows lie on the ring by their doc_id; a shard takes at most its bound, rows / shards rounded (plus `slack`), and keys
    overflowing a full shard continue clockwise. With slack 0 the counts of any two shards differ by at most one.

    A row's rank in its arc is its place in the order of position, doc_id, text hash and size, however the rows are
    partitioned: they are dealt to tasks by ranges of that order, about cell_rows to a task, and numbered there; rows equal
    in all of these are dealt by a scan number too, and are the same in any order. Only counts of the shards * nodes arcs
    and of the tasks come to the driver. Null ids share the place of the word null, null texts have size 1; equal rows get
    different slots; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc32_of_text(text).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"))
    ends, preferences = ring(shards, nodes)
    arc = F.lit(len(ends)) - F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda n, e: n + F.when(F.col("at") <= e, 1).otherwise(0))
    arc = F.when(arc == len(ends), 0).otherwise(arc)  # beyond the last point the ring begins anew
    rows, rows_at = saved_at(rows.withColumn("at", ring_position(F.col("doc_id"))).withColumn("arc", arc), "sharding")
    total = rows.count()
    order = ["arc", "at", "doc_id", "text_crc32", "size", "uid"]
    number = F.monotonically_increasing_id()
    ranked = rows.repartitionByRange(max(1, -(-total // cell_rows)), *order).sortWithinPartitions(*order)
    # the upper bits of the number are the task's, the lower ones count its rows
    ranked = ranked.withColumn("task", F.shiftright(number, 33)).withColumn("rank", number.bitwiseAND(F.lit((1 << 33) - 1)))
    ranked, _ = saved_at(ranked.drop("uid", "at"), "ranked")
    remove(spark, rows_at)
    cells = ranked.groupBy("arc", "task").agg(F.count("*").alias("count"), F.min("rank").alias("first"))
    # a row for each arc and task with rows: in an arc, a task's ranks follow those of the tasks before it
    cells = cells.select("arc", "task", (F.sum("count").over(Window.partitionBy("arc").orderBy("task")) - F.col("count") - F.col("first")).alias("base"), "count")
    cells, _ = saved_at(cells, "cells")
    counts = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    capacity = [total // shards + (s < total % shards) + slack for s in range(shards)]
    plan = json.dumps([dict(zip(("p_arc", "first", "end", "shard", "slot0"), x, strict=True)) for x in bounded_plan(counts, preferences, capacity)])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<p_arc:int,first:long,end:long,shard:int,slot0:long>>")))
    ranked = ranked.join(small(cells.drop("count"), cells.count()), ["arc", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    # at most a row for each arc and shard, both parameters
    out = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
