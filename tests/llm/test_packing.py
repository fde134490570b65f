import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavemetric.llm import packing, tokens
from pavemetric.llm.registry import tokenizer
from pavemetric.llm.tokens import Encoder

CASES = ["", None, " a b", "a  b", "a\n b \nc d", "x ", "́a b", "it's 's 'sa  \n\n b", "a\n\n b\tc", "<|endoftext|> x", "a  b", "É É́", "end. Next, \"x.\" ... a.,b", "1.5 2,3 ². x_.", "tail\n", "\n head", ".", " .", "a \x00 b", "İstanbul 你好", "word.\nNext\nline, \n"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, spaced, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(name))
    library.encode_special_tokens = True
    encoder = Encoder(tokenizer(name), 2, spaced)
    texts = CASES + [t for _, t, _ in rows]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_equal_library(name, spaced, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(name))
    encoder = Encoder(tokenizer(name), 2, spaced, added=True)
    texts = [*CASES, "a <|endoftext|> b", "a<|startoftext|>b <|endoftext|>", "A <|ENDOFTEXT|> <| endoftext |>", "<|endof text|>", *[t for _, t, _ in rows]]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


def test_queries_know_added_tokens(spark, tmp_path):
    from zlib import crc32

    from tokenizers import Tokenizer

    import corpus_pipeline
    from pavemetric.llm import registry

    text = "a <|endoftext|> b <|startoftext|>"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, out in (("byte_bpe_50k.json", registry.op1_best_fit_packing(spark, str(tmp_path))), ("word_bpe_49k.json", registry.op8_token_files(spark, str(tmp_path))), ("byte_bpe_50k.json", corpus_pipeline.packed(spark, docs, ""))):
        ids = [*Tokenizer.from_file(tokenizer(name)).encode(text, add_special_tokens=False).ids, 2]
        assert out.first().ids_crc32 == crc32(np.array(ids, "<u4").tobytes())


def test_random_texts_equal_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choices(" \n.,ab'sE1_!\téß ", weights=[6, 1, 1, 1, 5, 5, 1, 2, 1, 1, 1, 1, 0.3, 2, 1, 0.2], k=rng.randint(0, 40))) for _ in range(3000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        library = Tokenizer.from_file(tokenizer(name))
        encoder = Encoder(tokenizer(name), 2, spaced)
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist()[:-1] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_units_at_edges_equal_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BYTES", 300)
    monkeypatch.setattr(tokens, "SLICE", 7)
    rng = random.Random(11)
    parts = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u202f\u3000\ufeff\x00", *"abstE01'.,!<|>_-", *"éñ²½ª\u0301你。\U0001f600", "'s", "'ll", " 're", "  ", " a", "\n\n", " \n", "endoftext", "<|endoftext|>"]
    texts = [None, "", *["".join(rng.choices(parts, weights=[rng.random() ** 4 for _ in parts], k=rng.randint(0, 60))) for _ in range(3000)]]
    for added in (True, False):
        library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
        library.encode_special_tokens = not added
        encoder = Encoder(tokenizer("byte_bpe_50k.json"), 2, True, added, 500)
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_library_gets_many_units_in_a_call(monkeypatch):
    encoder = Encoder(tokenizer("byte_bpe_50k.json"), 2, True)
    ids, calls = encoder._ids, []
    monkeypatch.setattr(encoder, "_ids", lambda text: calls.append(text) or ids(text))
    # each first word, and each word at the start of a line, is a unit without a space
    texts = [f"First{'x' * (i % 40)}{i} word\nLine{i} ends." for i in range(1000)]
    out = encoder.encode(texts)
    assert len(calls) < 50
    assert all(a == ids(t).tobytes() + b"\2\0\0\0" for a, t in zip(out, texts, strict=True))


def fewest(lengths: list[int], capacity: int) -> int:
    """Fewest bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= lengths[i]}:
            k = bins.index(room)
            go(i + 1, [*bins[:k], room - lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_bound_and_fit_against_search():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 16, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        bins, offsets, fill = packing.best_fit_decreasing(np.array(lengths), capacity)
        least = fewest(lengths, capacity)
        assert packing.lower_bound(np.array(lengths), capacity) <= least <= len(fill)
        assert fill.max() <= capacity
        for b in range(len(fill)):
            spans = sorted((o, s) for o, s, x in zip(offsets, lengths, bins, strict=True) if x == b)
            assert [o for o, _ in spans] == list(np.cumsum([0, *[s for _, s in spans]])[:-1])


def check(out, rows, name="byte_bpe_50k.json"):
    encoder = Encoder(tokenizer(name), 2, True)
    by_text = {t: ids for t, ids in zip([t for _, t, _ in rows], encoder.encode([t for _, t, _ in rows]), strict=True)}
    want = sorted((-1 if i is None else i, p, s, min(1024, n - s), crc32(x[4 * s : 4 * e])) for i, t, _ in rows for x in [by_text[t]] for n in [len(x) // 4] for p, (s, e) in enumerate(cuts(n)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.ids_crc32) for r in out)
    assert got == sorted((i, p, s, c) for i, p, s, _, c in want)
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 1024
    return len(spans)


def cuts(n: int) -> list[tuple[int, int]]:
    first = (n - 1) % 1024 + 1
    return [(0, first), *[(s, s + 1024) for s in range(first, n, 1024)]]


def test_documents(docs, rows):
    out = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json")).collect()
    sequences = check(out, rows)
    opened = np.array(sorted((r.length for r in out if r.length < 1024), reverse=True))
    full = len(out) - len(opened)
    assert packing.lower_bound(opened, 1024) + full <= sequences <= len(packing.best_fit_decreasing(opened, 1024)[2]) + full


def test_partitions_exchange(spark):
    rng = random.Random(1)
    data = [(i, i, False, 0, 0, rng.choice([rng.randint(1, 60), rng.randint(300, 700)]), 0) for i in range(2000)]
    items = spark.createDataFrame(data, packing.PIECES)
    many = packing.pack(items, part_rows=40)
    alone = packing.pack(items, part_rows=40, exchange=False)
    count = lambda d: d.select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.array([d[5] for d in data]), 1024)
    assert bound <= count(many) <= count(alone)
    fills = many.groupBy("sequence_id").agg(F.sum("length").alias("f"), F.max(F.col("offset") + F.col("length")).alias("e"), F.count("*").alias("n"))
    assert fills.where("f <> e or f > 1024").count() == 0
    assert many.count() == 2000
    assert many.where("part_bins < part_bound").count() == 0


def test_exchange_reaches_the_bound(spark):
    # pairs of 600 and 424 fill a sequence, but partitions have more of one than of the other
    items = spark.createDataFrame([(i, i, False, 0, 0, 600 if i % 2 else 424, 0) for i in range(2000)], packing.PIECES)
    count = lambda d: d.select("sequence_id").distinct().count()
    assert count(packing.pack(items, part_rows=40)) <= 1005 < count(packing.pack(items, part_rows=40, exchange=False))
    assert count(packing.pack(items, part_rows=3000)) == 1000


def test_certificates(spark):
    halves = [(i, i, False, 0, 0, 512, 0) for i in range(400)]
    out = packing.pack(spark.createDataFrame(halves, packing.PIECES), part_rows=50)
    parts = out.groupBy("part_bins", "part_bound").count().collect()
    assert out.select("sequence_id").distinct().count() == 200 and sum(r["count"] for r in parts) == 400
    assert all(r.part_bins == r.part_bound for r in out.collect())


def test_no_documents(empty):
    assert packing.pack_documents(empty, tokenizer("byte_bpe_50k.json")).count() == 0
