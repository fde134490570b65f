"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how well their ids go together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, null_id, plain_id, remove, saved_at
from .tokens import encoder

#: UTF-8 bytes of texts that are tokenized and aligned together (a longer text alone).
BLOCK_BYTES = 2 << 20
#: Texts that the libraries get in one call.
TEXTS = 64
#: Ids of side B in one stripe at most, whose dense block has a row for each and a column for each id of side A.
STRIPE_IDS = 64
#: Cells of a stripe that one row carries, and bytes of links that one task scores beside one another.
CELLS, SALT_BYTES = 65_536, 64 << 20
DOCS = "uid long, doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = "block long, docs int, stripe int, pairs binary, times binary, where_ binary, of binary, repeats binary"
CELL = "stripe int, codes binary, counts binary"
SCORES = "block long, docs int, at binary, best binary, sums binary"


class Side:
    """Ids of one tokenizer, the bytes of its tokens, and how long these are."""

    def __init__(self, tokens: list[bytes]):
        import pyarrow as pa

        self.tokens = pa.array(tokens, pa.binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.ids = len(tokens)

    def joined(self, ids: np.ndarray) -> bytes:
        return contents(self.tokens.take(ids))[0].tobytes()


def contents(taken) -> tuple[memoryview, np.ndarray]:  # noqa: ANN001
    """The bytes of an Arrow array of binaries end to end, and where each one starts and the last one ends."""
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    data = memoryview(taken.buffers()[2] or b"")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, others for 256 and up."""
    itself = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def byte_level(path: str) -> tuple[Side, object]:
    """Side A and its encoder, once for each Python worker."""
    e = encoder(path, 0, spaced=True)
    values = byte_values()
    vocabulary = e.library.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
    return Side(tokens), e


@cache
def pieces(path: str) -> tuple[Side, object]:
    """Side B and its processor, once for each Python worker."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    return Side([plain(i) for i in range(p.get_piece_size())]), p


@cache
def labels(ids_a: int, ids_b: int):  # noqa: ANN201
    """Decimal ids with what follows them, as an Arrow array: ids of A with a comma, with a bar, ids of B with a comma, with a semicolon, bare."""
    import pyarrow as pa

    return pa.array([f"{i}{end}".encode() for ids, ends in ((ids_a, ",|"), (ids_b, [",", ";", ""])) for end in ends for i in range(ids)], pa.binary())


class Aligned:
    """Texts aligned together: ids of both sides end to end, the document of each, and the places where tokens end together."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        self.texts = texts
        (self.side_a, library_a), (self.side_b, library_b) = byte_level(path_a), pieces(path_b)
        raw = [f" {t}".encode() if t else b"" for t in texts]
        some = [i for i, r in enumerate(raw) if r]
        ids_a, ids_b = [np.zeros(0, np.uint32)] * len(texts), [np.zeros(0, np.uint32)] * len(texts)
        for at in range(0, len(some), TEXTS):
            part = some[at : at + TEXTS]
            for i, a, b in zip(part, library_a.stream([f" {texts[i]}" for i in part]), library_b.encode([texts[i] for i in part], num_threads=1), strict=True):
                a, b = np.frombuffer(a, np.uint32)[:-1], np.array(b, np.uint32)  # noqa: PLW2901  (without the end id)
                if self.side_a.joined(a) == raw[i] == self.side_b.joined(b):
                    ids_a[i], ids_b[i] = a, b
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.side_a.lengths[self.a]), np.cumsum(self.side_b.lengths[self.b])
        # a token of no bytes ends where the one before it does
        self.at_a = np.flatnonzero(np.isin(ends_a, ends_b))
        self.at_b = np.flatnonzero(np.isin(ends_b, ends_a))
        self.cut_a, self.cut_b = last_of(self.at_a, ends_a), last_of(self.at_b, ends_b)
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.doc_of_cut = self.doc_a[self.cut_a]
        self.link_a, self.link_b = crossed(self.at_a, self.at_b, ends_a, ends_b)

    def groups_sha256(self) -> list[str]:
        """Digest of the groups' ids of each text, '' for one without tokens."""
        from hashlib import sha256

        if not len(self.cut_a):
            return [""] * len(self.texts)
        ids_a, ids_b = self.side_a.ids, self.side_b.ids
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        # in the order of the string: the A ids of a group, then its B ids
        size_a, size_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        which = np.empty(len(self.a) + len(self.b), np.int64)
        label_a = self.a.astype(np.int64)
        label_a[self.cut_a] += ids_a
        which[np.arange(len(self.a)) + before_b[group_a]] = label_a
        label_b = self.b.astype(np.int64) + 2 * ids_a
        last = np.append(self.doc_of_cut[1:] != self.doc_of_cut[:-1], True)
        label_b[self.cut_b] += np.where(last, 2 * ids_b, ids_b)
        which[np.arange(len(self.b)) + (before_a + size_a)[group_b]] = label_b
        data, offsets = contents(labels(ids_a, ids_b).take(which))
        ends = offsets[np.cumsum(self.n_a + self.n_b)].tolist()
        return [sha256(data[a:b]).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends, strict=False)]


def last_of(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the tokens `at` with one end the last one."""
    return at[np.append(ends[at[1:]] != ends[at[:-1]], True)] if len(at) else at


def crossed(at_a: np.ndarray, at_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens of `at_a` and `at_b` with one end. Where no token is without bytes, each end has one pair."""
    if len(at_a) == len(at_b) and np.array_equal(ends_a[at_a], ends_b[at_b]) and (np.diff(ends_a[at_a]) > 0).all():
        return at_a, at_b
    low, high = np.searchsorted(ends_b[at_b], ends_a[at_a], "left"), np.searchsorted(ends_b[at_b], ends_a[at_a], "right")
    n = high - low
    place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(at_a, n), at_b[place]


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Counts of each document; links by block of documents and stripe of B ids; where both lie, as one written table.

    pairs and times: the distinct id pairs of the block in the stripe (code: row of the stripe's block times ids of A, plus the A id)
    and how often they link in it; where_, of, repeats: places in the block of documents, place among the pairs, and links.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def cut() -> Iterator[pd.DataFrame]:
            uids, doc_ids, no_ids, texts = zip(*held, strict=True)
            al = Aligned(list(texts), path_a, path_b)
            links = np.bincount(al.doc_a[al.link_a], minlength=len(texts))
            groups = np.bincount(al.doc_of_cut, minlength=len(texts))
            yield pd.DataFrame({"uid": uids, "doc_id": doc_ids, "no_id": no_ids, "n_a": al.n_a, "n_b": al.n_b, "n_groups": groups, "n_links": links, "groups_sha256": al.groups_sha256()})
            rows = list(stripes(al))
            yield pd.DataFrame([(uids[0], len(texts), *r) for r in rows], columns=[c.split()[0] for c in LINKS.split(", ")])

        for batch in batches:
            for uid, doc_id, no_id, text in zip(batch["uid"], batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                n = len((text or "").encode())
                if held and size + n > block_bytes:
                    yield from padded(cut())
                    held, size = [], 0
                held.append((uid, doc_id, no_id, text))
                size += n
        if held:
            yield from padded(cut())
        give_back_memory()

    both = [c.split()[0] for c in f"{DOCS}, {LINKS}".split(", ")]

    def padded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({c: f[c] if c in f else pd.Series([None] * len(f), dtype=object) for c in both})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *plain_id(), F.col("text").cast("string").alias("text"))
    table, at = saved_at(rows.mapInPandas(run, f"{DOCS}, {LINKS}"), "aligned")
    pick = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return table.where("uid is not null").select(*pick(DOCS)), table.where("stripe is not null").select(*pick(LINKS)), at


def stripe_count(ids_b: int) -> int:
    """Stripes that B ids are dealt over in turn, so that ids near each other, which are about as frequent, lie in different ones."""
    return -(-ids_b // STRIPE_IDS)


def stripes(al: Aligned) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """stripe, pairs, times, where_, of, repeats of the links of texts aligned together."""
    count = stripe_count(al.side_b.ids)
    row, dealt = np.divmod(al.b[al.link_b].astype(np.int64), count)
    code = (dealt * STRIPE_IDS + row) * al.side_a.ids + al.a[al.link_a]
    pairs, which, times = np.unique(code, return_inverse=True, return_counts=True)
    doc = al.doc_a[al.link_a]
    # links of one document and pair are one; which * docs + doc sorts by pair, so by stripe
    cell, repeats = np.unique(which * len(al.texts) + doc, return_counts=True)
    of, where = np.divmod(cell, len(al.texts))
    width = STRIPE_IDS * al.side_a.ids
    stripe = pairs // width
    edges = np.flatnonzero(np.diff(stripe, prepend=-1, append=-1))
    for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        low, high = np.searchsorted(of, [p, q])
        yield int(stripe[p]), *(x.astype(np.int32).tobytes() for x in (pairs[p:q] - stripe[p] * width, times[p:q], where[low:high], of[low:high] - p, repeats[low:high]))


def count_pairs(links: DataFrame, ids_a: int) -> DataFrame:
    """(stripe, codes, counts): how often each id pair links in the corpus, from links dealt by stripe.

    A task adds its blocks' pairs, which each block has counted already, into the dense matrix of one stripe at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense, now = None, -1

        def cells() -> Iterator[pd.DataFrame]:
            codes = np.flatnonzero(dense)
            for i in range(0, len(codes), CELLS):
                some = codes[i : i + CELLS]
                yield pd.DataFrame({"stripe": [now], "codes": [some.astype(np.int32).tobytes()], "counts": [dense[some].tobytes()]})

        for batch in batches:
            for stripe, pairs, times in batch[["stripe", "pairs", "times"]].itertuples(index=False, name=None):
                if stripe != now:
                    if dense is not None:
                        yield from cells()
                    dense, now = np.zeros(STRIPE_IDS * ids_a, np.int64), stripe
                np.add.at(dense, np.frombuffer(bytes(pairs), np.int32), np.frombuffer(bytes(times), np.int32))
        if dense is not None:
            yield from cells()

    return links.select("stripe", "pairs", "times").repartition("stripe").sortWithinPartitions("stripe").mapInPandas(run, CELL)


def score_links(links: DataFrame, cells: DataFrame, ids_a: int, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """(block, docs, at, best, sums): of documents of a block, their links with the B id's highest count, and the counts added up.

    Links meet the counts of their stripe in one task, which has the stripe's dense matrix and its rows' highest counts. Stripes
    with more than salt_bytes of links are dealt over several tasks, the counts being copied for each.
    """
    # a row for each stripe: bounded by the vocabulary
    cuts = links.groupBy("stripe").agg(F.ceil(F.sum(F.length("where_") + F.length("of") + F.length("repeats")) / salt_bytes).cast("int").alias("cuts"))
    cuts = F.broadcast(saved_at(cuts, "stripe-sizes")[0])
    dealt = links.drop("times").join(cuts, "stripe").withColumn("salt", F.pmod(F.xxhash64("block"), "cuts").cast("int"))
    copies = cells.withColumns({"block": F.lit(-1).cast("long"), "docs": F.lit(0)}).join(cuts, "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = dealt.unionByName(copies, allowMissingColumns=True).drop("cuts").repartition("stripe", "salt")
    rows = rows.sortWithinPartitions("stripe", "salt", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense, best, now = np.zeros(0, np.int64), None, -1
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.stripe, r.salt) != now:
                    dense, best, now = np.zeros(STRIPE_IDS * ids_a, np.int64), None, (r.stripe, r.salt)
                if r.block < 0:
                    np.add.at(dense, np.frombuffer(bytes(r.codes), np.int32), np.frombuffer(bytes(r.counts), np.int64))
                    continue
                if best is None:
                    best = dense.reshape(STRIPE_IDS, ids_a).max(1)
                pairs, where, of, repeats = (np.frombuffer(bytes(x), np.int32) for x in (r.pairs, r.where_, r.of, r.repeats))
                count = dense[pairs]
                high = count == best[pairs // ids_a]
                at, place = np.unique(where, return_inverse=True)
                n, s = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                np.add.at(n, place, np.where(high[of], repeats, 0))
                np.add.at(s, place, count[of] * repeats)
                out.append((int(r.block), int(r.docs), at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), s.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])

    return rows.mapInPandas(run, SCORES)


def add_scores(scores: DataFrame) -> DataFrame:
    """(uid, n_best, count_sum) of the documents of each block, added up over the stripes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, s = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        frame = lambda: pd.DataFrame({"uid": now + np.arange(len(n)), "n_best": n, "count_sum": s})
        for batch in batches:
            for block, docs, at, best, sums in batch.itertuples(index=False, name=None):
                if block != now:
                    if len(n):
                        yield frame()
                    now, n, s = block, np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                place = np.frombuffer(bytes(at), np.int32)
                n[place] += np.frombuffer(bytes(best), np.int32)
                s[place] += np.frombuffer(bytes(sums), np.int64)
        if len(n):
            yield frame()

    return scores.repartition("block").sortWithinPartitions("block").mapInPandas(run, "uid long, n_best long, count_sum long")


def aligned(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text; others ignored).

    A encodes space and text by a byte-level file of the tokenizers library, B the text by a sentencepiece model; strings of special
    tokens are plain text. Texts that are null, empty or not told again by the tokens' bytes have no tokens: zeros and ''. Repeated
    rows each count; null ids pass through; an empty table gives an empty one.

    Texts are tokenized once. Links are dealt by stripes of B ids, in blocks of documents; counts and scores are made in a stripe's
    dense matrix. Memory: one block's arrays, or one stripe's matrix (STRIPE_IDS rows of all A ids). The written tables:
    links by block (about the size of the texts), counts by stripe (one cell for each distinct pair).
    """
    ids_a = byte_level(path_a)[0].ids
    counts, links, at = align(docs, path_a, path_b, block_bytes)
    cells, cells_at = saved_at(count_pairs(links, ids_a), "pair-counts")
    scored = add_scores(score_links(links, cells, ids_a, salt_bytes))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = counts.join(scored, "uid", "left").select(null_id(), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    out, _ = saved_at(joined, "alignment")
    remove(docs.sparkSession, at, cells_at)
    return out


def best_partners(cells: DataFrame, ids_a: int, ids_b: int) -> DataFrame:
    """(b, a, count): for each B id of count_pairs' table the A ids that it links with most often, ties included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stripe, codes, counts in batch.itertuples(index=False, name=None):
                row, a = np.divmod(np.frombuffer(bytes(codes), np.int32), ids_a)
                yield pd.DataFrame({"b": row * stripe_count(ids_b) + stripe, "a": a, "count": np.frombuffer(bytes(counts), np.int64)})

    pairs = cells.mapInPandas(run, "b int, a int, count long")
    top = pairs.groupBy("b").agg(F.max("count").alias("count"))
    return pairs.join(top, ["b", "count"]).select("b", "a", "count")
