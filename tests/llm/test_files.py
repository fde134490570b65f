"""WARC archives, transport streams and token files: round trips and damage."""

import os
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from pavemetric.llm import media, rans, registry, warc
from pavemetric.llm.common import ranges_of, read_file, scratch, write_new
from pavemetric.llm.registry import tokenizer


@pytest.mark.parametrize("size", [0, 1, 161, 162, 163, 176, 346, 347, 8073, 8074, 8075, 64592, 64597, 200_001])
def test_stream_round_trip(size):
    payload = os.urandom(size)
    stream = media.mux(payload)
    out = media.Demuxed(stream)
    assert len(stream) % 188 == 0 and out.payload == payload and not out.lost and not out.errors
    assert [u[0] for u in out.units] == [k * media.TICKS for k in range(len(out.units))]
    assert [u[3] for u in out.units] == [k % media.RANDOM_ACCESS_EVERY == 0 for k in range(len(out.units))]
    assert sum(u[2] for u in out.units) == size


def test_stream_bytes_by_a_plain_parser():
    """The tables and the first packets of a stream, written out; and a reader that knows only packet and header layouts."""
    stream = media.mux(bytes(range(256)) * 4)
    assert stream[:21].hex() == "474000100000b00d0001c100000001f0002ab104b2"
    assert stream[21:188] == b"\xff" * 167
    assert stream[188:214].hex() == "475000100002b0120001c10000e100f00006e100f000be7fa052"
    # payload start on PID 0x100, adaptation field with random access and clock, then a private stream with PTS 0
    assert stream[376:407].hex() == "474100300750000000007e00" + "000001bd0408848005" + "2100010001" + "0001020304"
    out, counters = b"", []
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47 and len(packet) == 188
        if (packet[1] & 31) << 8 | packet[2] == 0x100:
            counters.append(packet[3] & 15)
            out += packet[4 + (1 + packet[4] if packet[3] & 32 else 0) :]
    assert counters == [k % 16 for k in range(len(counters))]
    assert out[:3] == b"\x00\x00\x01" and int.from_bytes(out[4:6]) == len(out) - 6 and out[9 + out[8] :] == bytes(range(256)) * 4


def test_lost_repeated_and_damaged_packets():
    stream = media.mux(os.urandom(30_000))
    assert media.Demuxed(stream[: 188 * 10] + stream[188 * 11 :]).lost == 1
    again = media.Demuxed(stream[: 188 * 11] + stream[188 * 10 : 188 * 11] + stream[188 * 11 :])
    assert not again.lost and again.payload == media.Demuxed(stream).payload
    broken = bytearray(stream)
    broken[8] ^= 1
    assert media.Demuxed(bytes(broken)).errors
    assert media.Demuxed(b"not a stream").payload == b""


def test_media_columns(docs, rows):
    out = {}
    for r in media.media_columns(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert any(r.n_bytes == len(raw) and r.payload_bytes == len(padded) and r.payload_sha256 == sha256(padded).hexdigest() and r.tail_crc32 == crc32(padded[-16:]) and r.media_sha256 == sha256(media.mux(padded)).hexdigest() for r in out[i])
    assert sum(map(len, out.values())) == len(rows)


def test_media_query_has_the_access_units(spark):
    for r in registry.op4_media_columns(spark, "/root/testdata/sf0.001").collect():
        units = r.access_units
        assert [u.pts for u in units] == [k * media.TICKS for k in range(len(units))] and units
        assert [u.random_access for u in units] == [k % media.RANDOM_ACCESS_EVERY == 0 for k in range(len(units))]
        assert [u.start for u in units] == [k * media.UNIT_BYTES for k in range(len(units))]
        assert sum(u.length for u in units) == r.payload_bytes


def test_small_archives_share_a_dictionary(spark):
    html = "<html><head><title>page {0}</title></head><body><p>some shared words and tags</p><p>{0}</p></body></html>"
    rows = [(i, f"http://h/{i}", None if i == 5 else html.format(i * 7919) + "é" * (i % 9)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(24)
    listed = warc.write_archives(pages, scratch(spark, "warc-small")).collect()
    data = [read_file(r.path) for r in listed]
    assert len(data) > 12 and all(d[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little") for d in data)
    assert len({d[: 8 + int.from_bytes(d[4:8], "little")] for d in data}) == 1
    assert sorted(int(warc.parse(r)["warc-record-id"][10:-1]) for d in data for r in warc.records_of(d)) == list(range(120))
    assert warc.shared_dictionary(pages.limit(3)) is None and warc.shared_dictionary(pages) == warc.shared_dictionary(pages.repartition(3))


def test_archive_has_dictionary_and_frames():
    import zstandard

    records = [warc.record(i, i, f"http://x/{i}", (b"<p>some shared words and tags</p>" * 20) + os.urandom(8), "d", None, False) for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    assert list(warc.records_of(data)) == records
    assert len(data) < len(b"".join(zstandard.ZstdCompressor().compress(r) for r in records)) + 70_000
    few = warc.archive(records[:2])
    assert few[:4] == b"\x28\xb5\x2f\xfd" and list(warc.records_of(few)) == records[:2]


def test_archives(spark):
    page = "<html>" + "x" * 100
    data = [(5, "http://a", page), (3, "http://b", page), (9, None, page), (1, "http://c d\n", "short"), (2, "http://e", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", page), (None, "u", "alone" * 50), (3, "http://b", page), ((1 << 60) + 1, "u", page)]
    out = warc.archived(spark.createDataFrame([(*d, "x") for d in data], "page_id long, url string, html string, digest string")).collect()
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        same = [j for j, _, g in data if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= 100 and bool(same) and i != min(same)
        want.append((repr(i), len(raw), sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_files_are_whole(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 60) for i in range(60)], "page_id long, url string, html string")
    listed = warc.write_archives(pages, scratch(spark, "warc-test"))
    records = [r for row in listed.collect() for r in warc.records_of(read_file(row.path))]
    assert len(records) == 60 == sum(r.records for r in listed.collect())
    assert {warc.parse(r)["warc-target-uri"] for r in records} == {f"http://h/{i}" for i in range(60)}


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 20_000, (1 << 20) + 3])
def test_token_file_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_408).astype(np.uint32)
    lengths = np.array([n // 2, n - n // 2])
    f = rans.TokenFile.of(rans.pack_file([None, (1 << 60) + 3], lengths, ids, 4096))
    assert (f.ids() == ids).all() and f.doc_ids == [None, (1 << 60) + 3] and f.lengths.tolist() == lengths.tolist()
    if len(f.index) > 1:
        assert (f.block(1) == ids[n // 2 :]).all() and f.index["docs"].tolist() == [1, 1]


def test_damage_is_found():
    data = rans.pack_file([1], np.array([5000]), np.arange(5000, dtype=np.uint32) % 77)
    for at in (60, len(data) - 9):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(Exception):  # noqa: B017
            rans.TokenFile.of(bytes(broken)).ids()


def test_frequencies():
    for counts in ([1], [1, 0, 5], [10**9] + [1] * 49_000, [1] * 49_408, [3, 10**12]):
        f = rans.frequencies(np.array(counts))
        assert f.sum() == 1 << rans.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


@pytest.mark.parametrize(("task_bytes", "file_ids"), [(3000, 500), (1 << 24, 1 << 22)])
def test_token_files(docs, rows, task_bytes, file_ids):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = rans.token_files(docs, path, task_bytes=task_bytes, file_ids=file_ids, added=True).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, _ in rows]
    want = sorted((-1 if i is None else i, len(x) // 4, crc32(x)) for (i, _, _), x in zip(rows, ids, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    place, last = 0, -1
    for r in sorted(out, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == place and (-1 if r.doc_id is None else r.doc_id) >= last
        place, last = place + r.n_tokens, -1 if r.doc_id is None else r.doc_id


def test_hot_id_is_split(spark):
    docs = spark.createDataFrame([(5 if i % 3 else i, f"text {i % 4}") for i in range(3000)], "doc_id long, text string")
    listed = rans.write_tokens(docs, scratch(spark, "tokens-test"), tokenizer("word_bpe_49k.json"), task_bytes=6_000)
    assert listed.count() > 8 and max(r.docs for r in listed.collect()) < 1000
    assert rans.read_tokens(listed).count() == 3000


def test_blocks_are_read_alone(spark):
    docs = spark.createDataFrame([(i, "some words here " * 50) for i in range(300)], "doc_id long, text string")
    listed = rans.write_tokens(docs, scratch(spark, "tokens-test"), tokenizer("word_bpe_49k.json"), task_bytes=1 << 24)
    path = listed.first().path
    asked = []
    read = ranges_of(path)
    f = rans.TokenFile(lambda at, size: asked.append((at, size)) or read(at, size))
    assert len(f.block(0)) == int(f.index[0]["ids"]) and len(asked) == 3 and asked[2] == (f.body, 4 * int(f.index[0]["words"]))


def test_attempts_never_share_files(spark):
    """A task that writes its files and then fails is repeated; what the first attempt wrote is not listed."""
    first = write_new("file:///tmp/write-new-test", "part-0", ".x", b"a")
    second = write_new("file:///tmp/write-new-test", "part-0", ".x", b"b")
    assert first != second and read_file(first) == b"a" and read_file(second) == b"b"
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 60) for i in range(40)], "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "warc-twice")
    # the same table written twice, as two attempts of each task would, with rows in another order
    a, b = warc.write_archives(pages, folder), warc.write_archives(pages.repartition(5), folder)
    for listed in (a, b):
        out = warc.read_archives(listed)
        assert sorted(r.page_id for r in out.collect()) == list(range(40))
    assert not {r.path for r in a.collect()} & {r.path for r in b.collect()}


def test_no_documents(empty):
    assert rans.token_files(empty, tokenizer("word_bpe_49k.json")).count() == 0
    assert media.media_columns(empty).count() == 0
