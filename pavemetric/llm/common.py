"""Shared folder, scratch tables, files reachable from executors, and components of a distributed graph."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above so many rows a side is joined by shuffle instead of broadcast (ids and a few longs: about 64 MB).
BROADCAST_ROWS = 1_000_000
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SHARED)
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        folder = LOCAL_SHARED
    return folder.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which clean() deletes."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Deletes all scratch tables and files of this driver. For callers who have read or written the results they want."""
    remove(spark, *_made)
    _made.clear()


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it again."""
    return saved_at(df, name, compression)[0]


def saved_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables whose contents have been copied on."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(left: DataFrame, right: DataFrame, key: str, counted: DataFrame, how: str = "inner", rows: int | None = None, per: int = 2_000) -> DataFrame:
    """left joined with right, which has one row for each key and, if `rows` of it are few, is broadcast.

    Else keys with more than `per` rows in `counted` (left, or a settled table with the same keys) are dealt over several
    tasks by a salt, the row of right being copied for each.
    """
    if rows is not None and rows <= BROADCAST_ROWS // 4:
        return left.join(F.broadcast(right), key, how)
    hot = counted.groupBy(key).count().where(F.col("count") > per).select(key, F.ceil(F.col("count") / per).cast("int").alias("s_cuts"))
    hot, _ = saved_at(hot, "hot-keys")
    n = hot.count()
    if not n:
        return left.join(right, key, how)
    hot = small(hot, n)
    salt = F.when(F.col("s_cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("s_cuts"))).cast("int")
    dealt = left.join(hot, key, "left").withColumn("s_salt", salt).drop("s_cuts")
    copies = right.join(hot, key, "left").withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.coalesce("s_cuts", F.lit(1)) - 1))).drop("s_cuts")
    return dealt.join(copies, [key, "s_salt"], how).drop("s_salt")


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for a URI or a local path. Runs on executors."""
    from pyarrow import fs

    if not re.match(r"\w+:", uri):
        return fs.LocalFileSystem(), uri
    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m[1]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def write_new(folder: str, name: str, suffix: str, data: bytes) -> str:
    """Writes a file under a name that no other attempt of the task has, and returns its address."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def ranges_of(uri: str) -> Callable[[int, int], bytes]:
    """A function that reads so many bytes of a file from a place in it."""
    store, path = filesystem(uri)
    file = store.open_input_file(path)
    return lambda at, size: file.read_at(size, at)


def give_back_memory() -> None:
    """Returns what a Python worker has freed to the system. Workers are reused, so a stage would sit on the last one's heap."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def plain_id(name: str = "doc_id") -> list[Column]:
    """The id without nulls, and no_id where it was null: pandas holds longs with nulls as floats, which lose digits."""
    c = F.col(name).cast("long")
    return [F.coalesce(c, F.lit(0)).alias(name), c.isNull().alias("no_id")]


def null_id(name: str = "doc_id") -> Column:
    return F.when(~F.col("no_id"), F.col(name)).alias(name)


def crc32_of_text(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) with a and b of one orderable type.

    Returns (node, root) with the smallest node of each component as root, for every node that has an edge to another.
    Alternates large-star and small-star steps (Kiveris et al. 2014); each round is a written table, hot nodes are
    pre-aggregated, and no component is ever gathered in one task.
    """
    spark = edges.sparkSession
    now, at = saved_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    for _ in range(rounds):
        # large star: each node links its larger neighbours to its smallest neighbour or itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        after = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after, path = saved_at(after, name)
        mark = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        remove(spark, at)
        at, now = path, after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def fresh(df: DataFrame, prefix: str) -> str:
    """A prefix that no column of df has (names are compared without case)."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def copy_key(text: Column) -> Column:
    """With doc_id, what a row of documents is known by."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, copy_key) isn't kept; of equal rows that are kept, one stays.

    decisions (doc_id, copy_key, kept) has a row for each row of docs that may go. Only the keys of rows that go or
    repeat are gathered; their side is broadcast if its counted rows are few, else both sides are shuffled.
    """
    p = fresh(docs, "k_")
    marks = decisions.groupBy(F.col("doc_id").alias(f"{p}id"), F.col("copy_key").alias(f"{p}key")).agg(F.max("kept").alias(f"{p}kept"), F.count("*").alias(f"{p}rows"))
    marks, _ = saved_at(marks.where(f"not {p}kept or {p}rows > 1"), "marks")
    n, repeated = marks.agg(F.count("*"), F.count_if(f"{p}kept")).first()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}key"))
    joined = docs.withColumn(f"{p}hash", copy_key(F.col("text"))).join(small(marks, n), same, "left")
    out = joined.where(f"{p}rows is null").select(*docs.columns)
    if repeated:
        out = out.unionByName(joined.where(f"{p}kept").dropDuplicates([f"{p}id", f"{p}key"]).select(*docs.columns))
    return out
