"""Media columns: MPEG transport streams (ISO/IEC 13818-1) as binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_id, plain_id, saved

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: Packets of a full access unit, access units between random-access points, 90 kHz ticks of one.
UNIT_PACKETS, RANDOM_ACCESS_EVERY, TICKS = 44, 8, 3600
#: The first packet of a unit has a clock reference in front (8 bytes), and the unit a header with a time stamp (14).
UNIT_BYTES = (PACKET - 4 - 8) + (UNIT_PACKETS - 1) * (PACKET - 4) - 14
STAMPS = 1 << 33
INDEX = "array<struct<pts:long,start:long,length:long,random_access:boolean>>"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4)


PAT = _section(0x00, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
PMT = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2) + bytes([0x10 | counter & 15]) + b"\x00" + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    pts %= STAMPS
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


HEADS = [[bytes([SYNC]) + (start << 14 | DATA_PID).to_bytes(2) + bytes([field << 5 | 0x10 | c]) for c in range(16)] for start in (0, 1) for field in (0, 1)]


def mux(payload: bytes) -> bytes:
    """The payload as one private elementary stream, UNIT_BYTES to an access unit with its time stamp.

    Program tables go before every random-access point, which is every RANDOM_ACCESS_EVERY-th unit; each unit's first
    packet has a clock reference and, at such a point, the random-access indicator. No payload: the tables alone.
    """
    out, counter = [], 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        random_access = unit % RANDOM_ACCESS_EVERY == 0
        if random_access:
            k = unit // RANDOM_ACCESS_EVERY
            out += (_table_packet(PAT_PID, PAT, k), _table_packet(PMT_PID, PMT, k))
        data = payload[at : at + UNIT_BYTES]
        if not data:
            break
        pts = unit * TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2) + b"\x84\x80\x05" + _stamp(pts) + data
        clock = (pts % STAMPS << 15 | 0x7E00).to_bytes(6)
        field, first, done = bytes([0x50 if random_access else 0x10]) + clock, True, 0
        while done < len(pes):
            room = PACKET - 4 - (1 + len(field) if first else 0)
            short = room - min(room, len(pes) - done)
            if first or short:
                flags = field if first else (b"\x00" if short > 1 else b"")
                pad = short - (0 if first else 1 + len(flags))
                out += (HEADS[2 * first + 1][counter & 15], bytes([len(flags) + pad]), flags, b"\xff" * pad)
            else:
                out.append(HEADS[0][counter & 15])
            out.append(pes[done : done + room - short])
            done, counter, first = done + room - short, counter + 1, False
    return b"".join(out)


class Demuxed:
    """What a transport stream holds: payload, access units (pts, start, length, random_access), and what was wrong."""

    def __init__(self, stream: bytes):
        self.packets, self.lost, self.errors, self.tables = len(stream) // PACKET, 0, 0, 0
        self.units: list[tuple[int, int, int, bool]] = []
        programs: dict[int, int] = {}
        streams: dict[int, int] = {}
        counters: dict[int, int] = {}
        parts: list[bytes] = []
        marks: list[tuple[int, bool]] = []  # first part of each unit, and whether it can be entered there
        self.errors += len(stream) % PACKET != 0
        for at in range(0, self.packets * PACKET, PACKET):
            b1, b2, b3 = stream[at + 1], stream[at + 2], stream[at + 3]
            if stream[at] != SYNC or b1 & 0x80:
                self.errors += 1
                continue
            pid, start, begin, enter, jump = (b1 & 0x1F) << 8 | b2, b1 & 0x40, at + 4, False, False
            if b3 & 0x20:
                size = stream[begin]
                if size:
                    enter, jump = bool(stream[begin + 1] & 0x40), bool(stream[begin + 1] & 0x80)
                begin += 1 + size
            if not b3 & 0x10:
                continue
            seen = counters.get(pid)
            if seen is not None and not jump and b3 & 15 != seen + 1 & 15:
                if b3 & 15 == seen:
                    continue  # a packet sent twice
                self.lost += 1
            counters[pid] = b3 & 15
            if pid in streams:
                if start:
                    marks.append((len(parts), enter))
                if marks:
                    parts.append(stream[begin : at + PACKET])
            elif pid == PAT_PID or pid in programs:
                self._table(stream[begin : at + PACKET], pid, programs, streams)
        payload, place = [], 0
        for i, (first, enter) in enumerate(marks):
            pes = b"".join(parts[first : marks[i + 1][0] if i + 1 < len(marks) else len(parts)])
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (int.from_bytes(pes[4:6]) or len(pes) - 6) != len(pes) - 6:
                self.errors += 1
                continue
            s = pes[9:14]
            pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1 if pes[7] & 0x80 else -1
            data = pes[9 + pes[8] :]
            self.units.append((pts, place, len(data), enter))
            payload.append(data)
            place += len(data)
        self.payload = b"".join(payload)

    def _table(self, data: bytes, pid: int, programs: dict[int, int], streams: dict[int, int]) -> None:
        section = data[1 + data[0] :]
        size = 3 + (int.from_bytes(section[1:3]) & 0xFFF)
        if size > len(section) or section_crc(section[:size]):
            self.errors += 1
            return
        self.tables += 1
        if pid == PAT_PID:
            for i in range(8, size - 4, 4):
                programs[int.from_bytes(section[i + 2 : i + 4]) & 0x1FFF] = int.from_bytes(section[i : i + 2])
        else:
            i = 12 + (int.from_bytes(section[10:12]) & 0xFFF)
            while i < size - 4:
                streams[int.from_bytes(section[i + 1 : i + 3]) & 0x1FFF] = section[i]
                i += 5 + (int.from_bytes(section[i + 3 : i + 5]) & 0xFFF)

    @property
    def feature(self) -> str:
        stamps = [u[0] for u in self.units]
        return f"ts packets={self.packets} tables={self.tables} units={len(self.units)} entry={sum(u[3] for u in self.units)} pts={stamps[0] if stamps else '-'}..{stamps[-1] if stamps else '-'} lost={self.lost} errors={self.errors}"


def to_media(docs: DataFrame, block: int = 192) -> DataFrame:
    """doc_id (no_id: null), n_bytes, payload_bytes and the media column: the text in UTF-8 (null: empty), padded by spaces to a positive multiple of block, as a transport stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch["text"]]
            padded = [r.ljust(max(block, -(-len(r) // block) * block), b" ") for r in raw]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "n_bytes": [len(r) for r in raw], "payload_bytes": [len(p) for p in padded], "media": [mux(p) for p in padded]})

    return docs.select(*plain_id(), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, no_id boolean, n_bytes long, payload_bytes long, media binary")


def read_media(media: DataFrame, index: bool = True) -> DataFrame:
    """What the media column holds: digests, a feature string, and (index) time stamps with random-access points.

    Null or empty media: no payload. Bytes that are no stream: what can be parsed, with errors counted in the feature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256
        from zlib import crc32

        for batch in batches:
            rows = []
            for doc_id, no_id, n, stream in zip(batch["doc_id"], batch["no_id"], batch["n_bytes"], batch["media"], strict=True):
                stream = bytes(stream or b"")
                d = Demuxed(stream)
                rows.append((doc_id, no_id, n, len(d.payload), sha256(d.payload).hexdigest(), crc32(d.payload[-16:]), len(stream), sha256(stream).hexdigest(), d.feature, d.units if index else None))
            names = ["doc_id", "no_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_units"]
            out = pd.DataFrame(rows, columns=names)
            if index:
                keys = ("pts", "start", "length", "random_access")
                out["access_units"] = [[dict(zip(keys, u, strict=True)) for u in units] for units in out["access_units"]]
            yield out if index else out.drop(columns="access_units")

    schema = "doc_id long, no_id boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = media.mapInPandas(run, schema + (f", access_units {INDEX}" if index else ""))
    return out.select(null_id(), *[c for c in out.columns if c not in ("doc_id", "no_id")])


def media_columns(docs: DataFrame, index: bool = True) -> DataFrame:
    """Texts of docs stored as transport streams in a written table, and read back from it.

    Null text: empty, hence one block of spaces. Equal texts have equal values; repeated rows and null ids pass through;
    other columns are ignored; an empty table gives an empty one. Memory: one Arrow batch and its streams.
    """
    return read_media(saved(to_media(docs), "media"), index)
