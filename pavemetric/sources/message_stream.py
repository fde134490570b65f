"""A stream of files of length-delimited vehicle messages, as fixes; what can't be read is set aside and counted (SRC5, P10, P11, X1-X3)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import decode, read_varint

FIXES = "file string, fault string, seq long, source_id long, vehicle_id long, time_ms long, lon double, lat double, convert_to_local boolean"
NAMES = [c.split()[0] for c in FIXES.split(", ")]
#: Kinds of faults: a message that can't be read, and a file that ends within one.
DAMAGED, CUT_OFF = "damaged", "cut off"


def messages_of(data: bytes) -> Iterator[bytes | None]:
    """Messages that each follow their size as a varint; None for what is left where a file ends within one."""
    at = 0
    while at < len(data):
        try:
            size, at = read_varint(data, at)
        except IndexError:
            size = -1
        if size < 0 or at + size > len(data):
            yield None
            return
        yield data[at : at + size]
        at += size


def rows_of(file: str, data: bytes) -> Iterator[tuple]:
    """FIXES of a file's envelopes; seq counts its fixes in their order. A message that can't be read is one row with its fault."""
    seq = 0
    for body in messages_of(data):
        if body is None:
            yield (file, CUT_OFF, *[None] * 7)
            return
        try:
            envelope = decode("VehicleMessageEnvelope", body)
            found = [(envelope["source_id"], m["vehicle_id"], p["timestamp"], p["lon"], p["lat"]) for m in envelope["messages"] for p in m["locations"]]
        except (IndexError, ValueError, TypeError, struct.error, RecursionError):
            yield (file, DAMAGED, *[None] * 7)
            continue
        for source, vehicle, time, lon, lat in found:
            yield (file, None, seq, source, vehicle, time, lon, lat, None)
            seq += 1


def fixes_of_files(files: DataFrame, rows: int = 10_000) -> DataFrame:
    """FIXES of files (path, content), read message by message; `rows` are passed on at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(some: list[tuple]) -> pd.DataFrame:
            whole = {"seq": "Int64", "source_id": "Int64", "vehicle_id": "Int64", "time_ms": "Int64", "lon": "float64", "lat": "float64"}
            return pd.DataFrame(some, columns=NAMES, dtype=object).astype(whole)

        for batch in batches:
            some: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for r in rows_of(path, bytes(content)):
                    some.append(r)
                    if len(some) == rows:
                        yield frame(some)
                        some = []
            if some:
                yield frame(some)

    return files.select("path", "content").mapInPandas(run, FIXES)


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """FIXES of the message files of a folder as a stream, so many files per micro-batch.

    Each file is read once, by the micro-batch that first lists it, whatever is stopped and started again. How many fixes and how
    many faults a micro-batch had is in its progress (see counted).
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pb").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return fixes_of_files(files).observe("messages", F.count_if(F.col("fault").isNull()).alias("fixes"), F.count_if(F.col("fault").isNotNull()).alias("faults"))


def fixes_of(rows: DataFrame) -> DataFrame:
    """The fixes among FIXES, as matching.speed_samples and a stream of samples take them."""
    return rows.where("fault is null").drop("fault", "file", "source_id")


def faults_of(rows: DataFrame) -> DataFrame:
    """file and fault of what couldn't be read."""
    return rows.where("fault is not null").select("file", "fault")


def counted(query) -> tuple[int, int]:  # noqa: ANN001
    """Fixes and faults of the micro-batches that a query still knows."""
    found = [p.observedMetrics["messages"] for p in query.recentProgress if "messages" in p.observedMetrics]
    return sum(r["fixes"] for r in found), sum(r["faults"] for r in found)
