"""Token ids in files of interleaved static rANS blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back_memory, plain_id, ranges_of, saved, scratch, small, write_new
from .tokens import encoder

MAGIC = b"RANSTOK1"
#: Frequencies of a file sum to 2**SCALE; states lie in [LOW, LOW * 2**32).
SCALE, LOW = 20, 1 << 31
#: Interleaved states of a block; ids from which a block and a file end with a document; bytes of text of one writing task.
LANES, BLOCK, FILE_IDS, TASK_BYTES = 4096, 1 << 18, 1 << 22, 16 << 20
#: Columns of the block index at the head of a file: the checkpoints from which a block, with whole documents, decodes alone.
CHECKPOINT = np.dtype([("first_id", "<u8"), ("first_doc", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("words", "<u8"), ("at", "<u8"), ("crc", "<u4"), ("ids_crc", "<u4")])
#: Entries of the encoder's memo in a writing worker, which holds little else.
MEMO_ENTRIES = 1_200_000
LISTED = "task long, file long, path string, blocks long, docs long, ids long"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2**SCALE, every id that occurs keeping 1 at least."""
    total, seen = int(counts.sum()), np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.uint64)
    if not total:
        return freq
    share = np.maximum(1, (counts[seen].astype(np.float64) * ((1 << SCALE) / total)).astype(np.int64))
    over = int(share.sum()) - (1 << SCALE)
    order = np.argsort(-share, kind="stable")
    if over < 0:
        share[order[0]] -= over
    for i in order if over > 0 else ():
        cut = min(over, int(share[i]) - 1, max(1, int(share[i]) // 2))
        share[i] -= cut
        over -= cut
        if not over:
            break
    if over > 0:
        raise ValueError("more distinct ids than the frequency table has room for")
    freq[seen] = share
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """32-bit words: the states of all lanes, then what decoding reads, in its order. Id i lies in lane i % LANES."""
    lanes = min(LANES, len(ids))
    state, out = np.full(lanes, LOW, np.uint64), []
    rows = -(-len(ids) // lanes)
    limit = np.uint64(LOW >> SCALE << 32)
    for r in range(rows - 1, -1, -1):
        part = ids[r * lanes : (r + 1) * lanes]
        f, c, x = freq[part], cum[part], state[: len(part)]
        full = x >= limit * f
        if full.any():
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + c
    return np.concatenate([state.view(np.uint32), *out[::-1]])


def decode_block(words: np.ndarray, n: int, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    lanes = min(LANES, n)
    state, at = words[: 2 * lanes].copy().view(np.uint64), 2 * lanes
    ids, mask = np.empty(n, np.uint32), np.uint64((1 << SCALE) - 1)
    for r in range(-(-n // lanes)):
        size = min(lanes, n - r * lanes)
        x = state[:size]
        slot = x & mask
        part = slots[slot]
        ids[r * lanes : r * lanes + size] = part
        x = freq[part] * (x >> np.uint64(SCALE)) + slot - cum[part]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
            at += len(low)
        state[:size] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block of ids is damaged")
    return ids


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Magic; sizes; compressed document list and frequency table; checkpoints; checksum of the head; blocks."""
    counts = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, np.int64)
    freq = frequencies(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    ends = np.cumsum(lengths)
    blocks, index, at, doc, first = [], [], 0, 0, 0
    while doc < len(lengths):
        # whole documents, up to the first that reaches the size of a block
        after = min(int(np.searchsorted(ends, first + block, "left")) + 1, len(lengths))
        part = ids[first : int(ends[after - 1])]
        raw = encode_block(part, freq, cum).astype("<u4").tobytes() if len(part) else b""
        index.append((first, doc, after - doc, len(part), len(raw) // 4, at, zlib.crc32(raw), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(raw)
        at, doc, first = at + len(raw), after, first + len(part)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = b"".join([nulls.tobytes(), np.diff(numbers, prepend=np.int64(0)).astype("<i8").tobytes(), np.asarray(lengths).astype("<u4").tobytes(), freq.astype("<u4").tobytes()])
    head = zlib.compress(head, 6)
    table = np.array(index, CHECKPOINT).tobytes()
    sizes = np.array([len(doc_ids), len(freq), len(head), len(index), zlib.crc32(head + table)], "<u8").tobytes()
    return b"".join([MAGIC, sizes, head, table, *blocks])


class TokenFile:
    """A file of pack_file. Opening it reads the head; any block is read and decoded by itself from its checkpoint."""

    def __init__(self, read: Callable[[int, int], bytes]):
        """read(at, size): bytes of the file."""
        lead = read(0, 48)
        if lead[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, symbols, head_size, n, crc = np.frombuffer(lead, "<u8", 5, 8).tolist()
        data = read(48, head_size + n * CHECKPOINT.itemsize)
        if zlib.crc32(data) != crc:
            raise ValueError("the head of a token file is damaged")
        self.index = np.frombuffer(data, CHECKPOINT, n, head_size)
        self.read, self.body = read, 48 + len(data)
        head = zlib.decompress(data[:head_size])
        nulls = np.frombuffer(head, np.uint8, docs)
        numbers = np.cumsum(np.frombuffer(head, "<i8", docs, docs))
        self.doc_ids = [None if z else int(d) for z, d in zip(nulls, numbers, strict=True)]
        self.lengths = np.frombuffer(head, "<u4", docs, 9 * docs).astype(np.int64)
        self.freq = np.frombuffer(head, "<u4", symbols, 13 * docs).astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(symbols, dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda at, size: data[at : at + size])

    def block(self, k: int) -> np.ndarray:
        b = self.index[k]
        raw = self.read(self.body + int(b["at"]), 4 * int(b["words"]))
        if zlib.crc32(raw) != b["crc"]:
            raise ValueError("a block of a token file is damaged")
        n = int(b["ids"])
        ids = decode_block(np.frombuffer(raw, "<u4").astype(np.uint32), n, self.freq, self.cum, self.slots) if n else np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != b["ids_crc"]:
            raise ValueError("ids of a token file are damaged")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.index))]) if len(self.index) else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, spaced: bool = False, task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS, added: bool = False) -> DataFrame:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order; returns the list (task, file, path, blocks, docs, ids).

    Rows are dealt to tasks by ranges of doc_id (null first), then a hash of the text, then a scan number, so that an id or
    a row that repeats without end is cut too; a task sorts its range, encodes it and writes a file for each file_ids ids.
    A file's frequency table is shared by all its blocks. Names are new in every attempt of a task, and only files of
    attempts that succeed are listed.
    """
    text = F.col("text").cast("string")
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16), F.lit(0))).first()[0]
    order = [F.col("no_id").desc(), F.col("doc_id"), F.col("salt"), F.col("uid")]
    rows = docs.select(*plain_id(), text.alias("text"), F.xxhash64(text).alias("salt"), F.monotonically_increasing_id().alias("uid"))
    dealt = rows.repartitionByRange(max(1, -(-size // task_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "no_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        give_back_memory()
        encode, task, file = encoder(tokenizer, end_id, spaced, added, MEMO_ENTRIES).encode, TaskContext.get().partitionId(), 0
        numbers: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal file, held
            data = pack_file(numbers, np.array([len(x) for x in parts]), np.concatenate(parts))
            path = write_new(folder, f"tokens-{task:06d}-{file:06d}", ".rans", data)
            blocks = int(np.frombuffer(data, "<u8", 5, 8)[3])
            out = pd.DataFrame({"task": [task], "file": [file], "path": [path], "blocks": [blocks], "docs": [len(numbers)], "ids": [held]})
            file, held = file + 1, 0
            numbers.clear()
            parts.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                for doc_id, no_id, raw in zip(some["doc_id"].tolist(), some["no_id"].tolist(), encode(some["text"].tolist()), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    numbers.append(None if no_id else doc_id)
                    parts.append(ids)
                    held += len(ids)
                    if held >= file_ids:
                        yield flush()
        if numbers:
            yield flush()

    return saved(dealt.mapInPandas(run, LISTED), "tokens")


def read_tokens(listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the listed files, each block decoded by itself."""
    spark = listed.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, opened = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.path != path:
                    path, opened = row.path, TokenFile(ranges_of(row.path))
                b = opened.index[row.block]
                first, docs = int(b["first_doc"]), int(b["docs"])
                raw, ends = opened.block(row.block).astype("<u4").tobytes(), np.cumsum(opened.lengths[first : first + docs])
                starts = ends - opened.lengths[first : first + docs]
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(opened.doc_ids[first : first + docs], "Int64"), "start": row.before + int(b["first_id"]) + starts, "n_tokens": ends - starts, "ids_crc32": crc})

    # ids before a task's files: a row for each task, then the files of a task in their order
    tasks = listed.groupBy("task").agg(F.sum("ids").alias("ids")).select("task", (F.sum("ids").over(Window.orderBy("task")) - F.col("ids")).alias("earlier"))
    inside = F.sum("ids").over(Window.partitionBy("task").orderBy("file")) - F.col("ids")
    files = listed.withColumn("inside", inside).join(small(tasks, listed.count()), "task")
    blocks = files.select("path", (F.col("earlier") + F.col("inside")).alias("before"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    return blocks.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block").sortWithinPartitions("path", "block").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, spaced: bool = False, folder: str | None = None, task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS, added: bool = False) -> DataFrame:
    """docs (doc_id, text; others ignored) written as token files and read back.

    Null or empty text: the end id alone. Null ids come before all others. Rows with the same doc_id are ordered by a hash
    of their texts. An empty table: no files, no rows.
    """
    return read_tokens(write_tokens(docs, folder or scratch(docs.sparkSession, "tokens"), tokenizer, end_id, spaced, task_bytes, file_ids, added))
