"""Length-delimited messages as files: a data source with commit, and its reader by ranges (SNK6, SNK7)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .exchange import delimited, varint_of
from .files import filesystem

#: Bytes after which a range of a file ends, so that a large file is read by several tasks.
RANGE_BYTES = 16 << 20
LIST = "_list.json"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its file (none without messages), how many messages, where ranges of whole messages end."""

    name: str | None
    messages: int
    ends: list[int]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class MessageFiles(DataSource):
    """Option path: a folder. Rows have one binary column, message."""

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return "message binary"

    def writer(self, schema, overwrite: bool) -> MessageWriter:  # noqa: ANN001
        return MessageWriter(self.options["path"], overwrite, int(self.options.get("rangebytes", RANGE_BYTES)))

    def reader(self, schema) -> MessageReader:  # noqa: ANN001
        return MessageReader(self.options["path"])


class MessageWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; files count once the list names them, which is written last.

    Overwriting puts a new list in place of the old one and deletes its files then; appending adds to it. A task that fails
    deletes its file, and so does a write that is given up with those of its tasks that had finished.
    """

    def __init__(self, path: str, overwrite: bool, range_bytes: int):
        self.path, self.overwrite, self.range_bytes = path, overwrite, range_bytes

    def write(self, iterator: Iterator) -> Written:
        store, folder = filesystem(self.path)
        name, n, at, ends, out = f"part-{uuid.uuid4().hex}.pb", 0, 0, [], None
        try:
            for batch in iterator:
                for m in batch.column(0):
                    if not m.is_valid:
                        continue
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    body = m.as_py()
                    head = varint_of(len(body))
                    out.write(head)
                    out.write(body)
                    n, at = n + 1, at + len(head) + len(body)
                    if at - (ends[-1] if ends else 0) >= self.range_bytes:
                        ends.append(at)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{folder}/{name}")
            raise
        if out is None:
            return Written(None, 0, [])
        out.close()
        return Written(name, n, ends if ends and ends[-1] == at else [*ends, at])

    def commit(self, messages: list) -> None:
        store, folder = filesystem(self.path)
        old = listed(self.path)
        new = [{"file": m.name, "messages": m.messages, "ends": m.ends} for m in messages if m and m.name]
        store.create_dir(folder, recursive=True)
        # written aside and moved, so that a reader finds the old list or the new one
        aside = f"{folder}/{LIST}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside, compression=None) as out:
            out.write(json.dumps(new if self.overwrite else old + new).encode())
        store.move(aside, f"{folder}/{LIST}")
        for f in old if self.overwrite else []:
            store.delete_file(f"{folder}/{f['file']}")

    def abort(self, messages: list) -> None:
        store, folder = filesystem(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{folder}/{m.name}")


class MessageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        found = listed(self.path)
        return [Range(f"{self.path}/{f['file']}", start, end) for f in found for start, end in zip([0, *f["ends"]], f["ends"], strict=False)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.end > partition.start:
            store, path = filesystem(partition.file)
            with store.open_input_file(path) as f:
                for m in delimited(f.read_at(partition.end - partition.start, partition.start)):
                    yield (m,)


def listed(path: str) -> list[dict]:
    """The files of a folder that count: a row for each task that wrote messages."""
    from pyarrow import fs

    store, folder = filesystem(path)
    if store.get_file_info(f"{folder}/{LIST}").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{folder}/{LIST}", compression=None) as f:
        return json.loads(f.read())


def write(messages: DataFrame, path: str, mode: str = "overwrite", range_bytes: int = RANGE_BYTES) -> None:
    """Writes encoded messages (message) as files under a folder, one for each task that has any."""
    messages.sparkSession.dataSource.register(MessageFiles)
    messages.select("message").write.format("message_files").option("path", path).option("rangeBytes", range_bytes).mode(mode).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The messages of the files that a folder lists, one task for each range of a file."""
    spark.dataSource.register(MessageFiles)
    return spark.read.format("message_files").option("path", path).load()
