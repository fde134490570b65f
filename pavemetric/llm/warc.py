"""WARC archives (ISO 28500) with per-record Zstandard frames and an embedded dictionary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_id, read_file, saved_at, scratch, small, write_new

#: Head of the skippable frame that holds the dictionary, as the draft for zstd-compressed WARC files has it.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records a dictionary is built from at most, bytes of the dictionary, bytes of payload in one archive.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 64 << 20
LEVEL, WARC_DATE = 3, "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of sampled records from which an archive builds its own dictionary; pages and characters of each for the shared one.
OWN_BYTES, SHARED_ROWS, SHARED_CHARS = 1 << 20, 500, 8_192
READ = "row long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that has the headers of the response without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Record-Row: {row}", f"WARC-Target-URI: {url}", f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    else:
        http += payload
    return ("\r\n".join([*lines, f"Content-Length: {len(http)}"]) + "\r\n\r\n").encode() + http + b"\r\n\r\n"


def trained(sample: list[bytes]) -> bytes | None:
    """A dictionary built from records, or None where they are too few or too small for one."""
    import zstandard

    size = sum(map(len, sample))
    if len(sample) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), sample, level=LEVEL, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], shared: bytes | None = None) -> bytes:
    """A skippable frame with a dictionary, then each record as a frame of its own.

    The dictionary is built from the records, or the shared one where they are too few or too small. Without either: no leading
    frame, records compressed without one.
    """
    import zstandard

    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        if size + len(r) <= SAMPLE_BYTES:
            sample.append(r)
            size += len(r)
    raw = (trained(sample) if size >= OWN_BYTES or shared is None else None) or shared
    lead = b"" if raw is None else DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    dictionary = None if raw is None else zstandard.ZstdCompressionDict(raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return lead + b"".join(map(packer.compress, records))


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    import zstandard

    dictionary = None
    if data[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        end = 8 + int.from_bytes(data[4:8], "little")
        raw = data[8:end]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw)
        data = data[end:]
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data:
        frame = reader.decompressobj()
        yield frame.decompress(data)
        data = frame.unused_data


def parse(rec: bytes) -> dict[str, str | bytes]:
    """Headers by lower-case name; block: the HTTP message."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    out: dict[str, str | bytes] = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    out["block"] = rest[: int(out["content-length"])]
    return out


def deduplicated(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id (no_id: null), url, html, digest and whether it is a revisit of the smallest page_id with the payload (refers)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("long_enough", F.octet_length("html") >= min_bytes)
    first = rows.where("long_enough").groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("f_rows")).where("f_rows > 1").drop("f_rows")
    first, _ = saved_at(first, "payloads")
    return rows.join(small(first, first.count()), F.col("long_enough") & (F.col("digest") == F.col("f_digest")), "left").select(*plain_id("page_id"), "url", "html", "digest", F.coalesce("first_id", F.lit(0)).alias("refers"), (F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))).alias("revisit"))


def shared_dictionary(pages: DataFrame, rows: int = SHARED_ROWS, chars: int = SHARED_CHARS) -> bytes | None:
    """A dictionary from the beginnings of a bounded sample of pages, for archives that are too small for one of their own.

    The sample: of the `rows` smallest hashes of page_id and url one page each, `chars` characters of it.
    """
    key = F.xxhash64("page_id", "url")
    # hashes alone find the bound, so that tasks send no texts but those of the sample
    least = pages.select(key.alias("key")).orderBy("key").limit(rows).collect()
    if not least:
        return None
    start = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, chars)
    some = pages.where(key <= least[-1]["key"]).groupBy(key.alias("key")).agg(F.min(F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), start.alias("html"))).alias("p")).orderBy("key").select("p.*").collect()
    return trained([record(r["page_id"], i, r["url"], r["html"].encode(), "0" * 64, None, False) for i, r in enumerate(some)])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into folder; returns the written list (path, records).

    Of payloads that are equal and have at least min_bytes, the one with the smallest page_id is a response (all of them,
    if that page_id repeats), the others are revisits of it. A task writes one archive for each ARCHIVE_BYTES of
    payload, with a dictionary of its own or, if it is small, the shared one. Names are new in every attempt of a task, and only archives of attempts that succeed are listed.
    """

    shared = shared_dictionary(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, written, row = TaskContext.get().partitionId(), 0, 0
        records: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal written, size
            path = write_new(folder, f"part-{task:06d}-{written:04d}", ".warc.zst", archive(records, shared))
            out = pd.DataFrame({"path": [path], "records": [len(records)]})
            written, size = written + 1, 0
            records.clear()
            return out

        for batch in batches:
            for page_id, no_id, url, html, digest, refers, revisit in batch[["page_id", "no_id", "url", "html", "digest", "refers", "revisit"]].itertuples(index=False, name=None):
                payload = html.encode()
                records.append(record(None if no_id else page_id, task << 32 | row, url, payload, digest, refers, revisit))
                row, size = row + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    listed, _ = saved_at(deduplicated(pages, min_bytes).mapInPandas(run, "path string, records long"), "archives")
    return listed


def read_archives(listed: DataFrame) -> DataFrame:
    """Rows of the records in the listed archives; a payload's length and digest are checked where it is stored."""
    spark = listed.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        def number(uri: str) -> int | None:
            return int(uri[len("<urn:page:") : -1]) if uri[len("<urn:page:") : -1] else None

        for batch in batches:
            for path in batch["path"]:
                rows: list[tuple] = []
                for r in map(parse, records_of(read_file(path))):
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    n = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
                    digest = r["warc-payload-digest"].removeprefix("sha256:")
                    revisit = r["warc-type"] == "revisit"
                    if not revisit and (len(body) != n or sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {r['warc-record-id']} in {path} is damaged")
                    rows.append((int(r["warc-record-row"]), number(r["warc-record-id"]), n, digest, r["warc-type"], number(r["warc-refers-to"]) if revisit else None))
                out = pd.DataFrame(rows, columns=["row", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
                yield out.astype({"row": "int64", "page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "path").mapInPandas(run, READ)


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html; others ignored) written as archives and read back, a row per record.

    Null html: an empty payload; null url: urn:none; null page_id: a record without a number, larger than any other.
    Equal rows: a record each. An empty table: no archive, no rows.
    """
    spark = pages.sparkSession
    return read_archives(write_archives(pages, folder or scratch(spark, "warc"), min_bytes)).drop("row")
