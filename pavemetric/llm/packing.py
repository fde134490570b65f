"""Best-fit packing of documents into token sequences, certified partition by partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, null_id, plain_id, remove, saved_at
from .tokens import encoder

PIECES = "uid long, doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, part long, bin long, offset long, fill long, bins long, bound long"
#: Documents that one packing task holds.
PART_ROWS = 25_000
#: Pieces that a task passes on at once.
ROWS = 4_096


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Bins that no packing can go below: the largest bound that a family of dual feasible functions gives.

    f_k sends a size above capacity-k to the whole bin, one below k to nothing, others to themselves; u_m rounds
    (m+1)x/capacity down to m-ths of a bin. Each maps any feasible bin to at most one bin, as does u_m after f_k.
    times: how often each length occurs, if not once.
    """
    count = np.bincount(lengths, times, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = 0
    for k in range(capacity // 2 + 1):
        f = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int(count @ f) // capacity))
        if k % 16 == 0:
            for m in (2, 3, 4, 5):
                q, rest = np.divmod((m + 1) * f, capacity)
                u = np.where(rest == 0, m * f, q * capacity)  # in units of bin / (m * capacity)
                best = max(best, -(-int(count @ u) // (m * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths in descending order. Bin and offset of each, and the fill of each bin.

    Open bins are held by remaining room, with a bit mask of the rooms that have any, so an item takes constant time.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, n = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    left: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
            left.append(0)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - size
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, capacity - np.array(left, np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, spaced: bool = True, added: bool = False) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut so that all pieces but the first have `capacity` ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        from pyspark import TaskContext

        give_back_memory()
        encode, uid = encoder(tokenizer, end_id, spaced, added).stream, TaskContext.get().partitionId() << 36
        columns = ["uid", "doc_id", "no_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows = []
            for doc_id, no_id, ids in zip(batch["doc_id"], batch["no_id"], encode(batch["text"].tolist()), strict=True):
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1
                    rows.append((uid, doc_id, no_id, k, at, size, crc32(ids[4 * at : 4 * (at + size)])))
                    at, k, uid = at + size, k + 1, uid + 1
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return docs.select(*plain_id(), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def pack(items: DataFrame, capacity: int = 1024, part_rows: int = PART_ROWS, exchange: bool = True) -> DataFrame:
    """items (uid, doc_id, no_id, piece, start, length, ids_crc32), lengths 1 to capacity, uid unique. Adds sequence_id, offset.

    Each partition of about part_rows open pieces is packed by best fit decreasing and certified if its bins meet its
    lower bound. Partitions with gaps pool what lies in their unfilled bins, deal it anew and pack it again, until all are
    certified or a round saves no bin. Then, if there are more bins than the bound for all pieces together, partitions that
    can't do better alone pool their unfilled bins too, again as long as that saves bins. Filled bins stay. A piece of
    `capacity` is a sequence of its own. Also added are part_bins and part_bound: the bins of the partition where the piece
    was packed last, and the fewest that any packing of that partition's pieces has. An empty table gives an empty one;
    equal lengths are ordered by uid.
    """
    spark, ours = items.sparkSession, items.columns

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=lower_bound(lengths, capacity))

    def packed(rows: DataFrame, number: int, k: int) -> tuple[DataFrame, str]:
        parts = max(1, round(number / part_rows))
        dealt = rows.select(*ours, F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)).alias("part"))
        tasks = max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return saved_at(dealt.repartition(tasks, "part").groupBy("part").applyInPandas(fit, PACKED), "packing")

    def placed(rows: DataFrame, k: int) -> DataFrame:
        # 15 bits for the round, 28 for the partition, 20 for the bin
        number = (F.lit(k << 48).cast("long") + F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id")
        return rows.select(*ours, number, "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))

    opened = items.where(F.col("length") < capacity)
    histogram = opened.groupBy("length").count().collect()  # capacity - 1 rows at most
    times = np.array([r["count"] for r in histogram], np.int64)
    number, fewest = int(times.sum()), lower_bound(np.array([r["length"] for r in histogram], np.int64), capacity, times)
    one, zero = (F.lit(n).cast("long") for n in (1, 0))
    done = items.where(F.col("length") >= capacity).select(*ours, (-1 - F.col("uid")).alias("sequence_id"), zero.alias("offset"), one.alias("part_bins"), one.alias("part_bound"))
    now, _ = packed(opened, number, 0)
    # offset 0 is the first item of each bin, so its rows count bins
    k, closed, alone = 1, 0, True
    while exchange:
        total = closed + now.where("offset = 0").count()
        pooled = F.col("fill") < capacity
        if alone:
            pooled = pooled & (F.col("bins") > F.col("bound"))
        number, old = now.where(pooled).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        again, at = packed(now.where(pooled), number, k) if old and total > fewest else (None, None)
        if again is None or again.where("offset = 0").count() >= old:
            if at:
                remove(spark, at)
            if total <= fewest or not alone:
                break
            alone = False
            continue
        done = done.unionByName(placed(now.where(~pooled), k - 1))
        now, closed, k = again, total - old, k + 1
    return done.unionByName(placed(now, k))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, spaced: bool = True, added: bool = False) -> DataFrame:
    """Documents (doc_id, text, other columns ignored) as packed pieces.

    Null or empty text: the end id alone. Repeated rows and null ids: packed like any other row. No rows: no pieces.
    """
    items, _ = saved_at(pieces(docs, tokenizer, end_id, capacity, spaced, added), "pieces")
    packed = pack(items, capacity)
    return packed.select(null_id(), *[c for c in packed.columns if c not in ("uid", "doc_id", "no_id")])
