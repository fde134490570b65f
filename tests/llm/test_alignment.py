"""Alignment of two tokenizers against a plain walk over their tokens."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from pavemetric.llm import alignment, registry

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(registry.tokenizer(A)), sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer(B))
    a.encode_special_tokens = True
    values = alignment.byte_values()

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    def tokens(text):
        """Ids and ends of both sides, or nothing."""
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(values[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        same = b"".join(parts_a) == f" {text}".encode() == b"".join(parts_b)
        return (ids_a, ends(parts_a), ids_b, ends(parts_b)) if same and text else None

    def rows(docs):
        out, count = [], Counter()
        for i, text in docs:
            found = tokens(text) if text else None
            if not found:
                out.append((i, 0, 0, 0, [], ""))
                continue
            ids_a, ends_a, ids_b, ends_b = found
            links = [(x, y) for x, e in zip(ids_a, ends_a, strict=True) for y, f in zip(ids_b, ends_b, strict=True) if e == f] if len(ids_a) < 300 else [(x, dict(zip(ends_b, ids_b, strict=True))[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in set(ends_b)]
            count.update(links)
            said, low = [], 0
            for e in sorted({*ends_a} & {*ends_b}):
                said.append("|".join(",".join(str(t) for t, f in zip(ids, ends, strict=True) if low < f <= e) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
                low = e
            out.append((i, len(ids_a), len(ids_b), len(said), links, ";".join(said)))
        best = Counter()
        for (_, y), n in count.items():
            best[y] = max(best[y], n)
        return sorted(repr((i, n, m, g, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha256(s.encode()).hexdigest() if s else "")) for i, n, m, g, ls, s in out)

    return rows


HARD = ["a▁b", "  two  spaces ", "x\x00y", "　", "ﬁne", "<s> </s> <unk>", "<0x41><|endoftext|>", "a\r\n\tb", " ", "\n", "naïve café", "日本語のテキスト", "👩‍👩‍👧", "word " * 900, "q" * 700]


@pytest.mark.parametrize(("block", "salt"), [(2 << 20, 64 << 20), (4_000, 500)])
def test_alignment(spark, docs, rows, plain, block, salt):
    short = [(i, t[:1500] if t else t) for i, t, _ in rows] + [(300 + i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in short], "doc_id long, text string, block int, stripe string, uid int").repartition(3)
    out = alignment.aligned(df, registry.tokenizer(A), registry.tokenizer(B), block, salt)
    assert sorted(repr(tuple(r)) for r in out.select(*COLUMNS).collect()) == plain(short)


def test_query_on_the_whole_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    want = [(r.doc_id, r.text) for r in registry.table(spark, folder, "documents").select("doc_id", "text").collect() if len(r.text or "") < 2000]
    out = registry.QUERIES["op11_cross_tokenizer_alignment"](spark, folder)
    assert out.count() == registry.table(spark, folder, "documents").count()
    few = alignment.aligned(spark.createDataFrame(want, "doc_id long, text string"), registry.tokenizer(A), registry.tokenizer(B))
    assert sorted(repr(tuple(r)) for r in few.select(*COLUMNS).collect()) == plain(want)


def test_empty_table(spark, empty):
    assert alignment.aligned(empty, registry.tokenizer(A), registry.tokenizer(B)).collect() == []


def test_tokens_without_bytes_link_with_all_that_end_there():
    ends_a, ends_b = np.array([1, 3, 3, 5]), np.array([2, 3, 5, 5])
    at_a, at_b = np.flatnonzero(np.isin(ends_a, ends_b)), np.flatnonzero(np.isin(ends_b, ends_a))
    assert alignment.last_of(at_a, ends_a).tolist() == [2, 3] and alignment.last_of(at_b, ends_b).tolist() == [1, 3]
    assert sorted(zip(*(x.tolist() for x in alignment.crossed(at_a, at_b, ends_a, ends_b)), strict=True)) == [(1, 1), (2, 1), (3, 2), (3, 3)]


def test_best_partners(spark):
    path_a, path_b = registry.tokenizer(A), registry.tokenizer(B)
    ids_a, ids_b = alignment.byte_level(path_a)[0].ids, alignment.pieces(path_b)[0].ids
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "the end")], "doc_id long, text string")
    _, links, _ = alignment.align(df, path_a, path_b)
    best = {r.b: (r.a, r["count"]) for r in alignment.best_partners(alignment.count_pairs(links, ids_a), ids_a, ids_b).collect()}
    the_a, the_b = alignment.byte_level(path_a)[1].library.token_to_id("Ġthe"), alignment.pieces(path_b)[1].piece_to_id("▁the")
    assert best[the_b] == (the_a, 3)
