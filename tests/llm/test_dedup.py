"""Exact and near copies, lines, against plain versions."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavemetric.llm import common, exact_dedup, line_dedup, ngram_join

LARGE = 1 << 62


def key(i):
    return LARGE if i is None else i


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), key(i), i))
    want = sorted((key(i), key(min(g)[2]), len(g), sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, i in g)
    out = exact_dedup.exact_groups(docs).collect()
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_drop_copies(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0d]", "", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t, _ in rows})


def test_clashing_chunk_hashes(docs, rows, monkeypatch):
    """With a hash that maps everything to one of two values, texts are still told apart."""

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) % 2)
    out = exact_dedup.exact_groups(docs).collect()
    monkeypatch.undo()
    groups = {re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t, _ in rows}
    assert sum(r.kept for r in out) == len(groups)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: LARGE)
    for k, (i, _, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], key(i))
    return sorted((key(i), len(s), least[root(k)]) for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_components(docs, rows):
    out = ngram_join.ngram_components(docs).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in out) == plain_components(rows)


@pytest.mark.parametrize("star", [2, 8])
def test_hot_grams_are_starred_and_split(docs, rows, monkeypatch, star):
    monkeypatch.setattr(ngram_join, "STAR", star)
    monkeypatch.setattr(ngram_join, "SPLIT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "SCREEN_DOCS", 10)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common.spread_join, "__defaults__", ("inner", None, 4))
    out = ngram_join.ngram_components(docs).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in out) == plain_components(rows)


@pytest.mark.parametrize("seed", range(3))
def test_links_against_all_pairs(spark, monkeypatch, seed):
    """Groups of texts at all similarities, of which many lie near the threshold, and chains that no single hub reaches."""
    monkeypatch.setattr(ngram_join, "STAR", 4)
    monkeypatch.setattr(ngram_join, "SPLIT", 10)
    rng, data = random.Random(seed), []
    for group in range(4):
        text = [f"{group}w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 90))]
        for i in range(60):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            copy = copy[rng.randint(0, 4) :] + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(0, 4))]
            if i % 10 == 0:
                text = copy
            data.append((len(data), " ".join(copy), "s"))
    out = ngram_join.ngram_components(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)).collect()
    want = plain_components(data)
    assert 4 < len({c for _, _, c in want}) < len(data)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want


def test_suffix_filter_keeps_similar_sets(spark):
    """Pairs at and below the threshold, of 1 to 2,000 grams, counts cut off as for very long texts among them."""
    rng, data = np.random.default_rng(5), []
    for i in range(300):
        n = int(rng.integers(1, 2000 if i % 3 else 20))
        shared = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = (np.unique(np.append(shared, rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        most = 10 if i % 2 else 32767
        counts = [np.minimum(np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=64), most).tolist() for x in (a, b)]
        data.append((*counts, len(a), len(b), 100 * both >= 80 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(data, "sa array<smallint>, sb array<smallint>, na int, nb int, similar boolean")
    fits = df.select("similar", ngram_join.slices_fit(*map(F.col, ("sa", "sb", "na", "nb"))).alias("fits")).collect()
    assert all(r.fits for r in fits if r.similar) and any(r.similar for r in fits)
    assert not all(r.fits for r in fits)


def test_drop_near_copies(docs, rows):
    out = ngram_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    plain = plain_components(rows)
    linked = {c for _, n, c in plain if n}
    assert out.count() == len(linked) + sum(n == 0 for _, n, _ in plain)


def test_line_dedup(docs, rows):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r") and s is not None:
                sites[line.strip(" \t\r")].add(s)
    bad = {line for line, s in sites.items() if len(s) >= 10}
    assert bad
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if x.strip(" \t\r") not in bad]
        want.append((key(i), len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    out = line_dedup.drop_boilerplate(docs)
    assert sorted(map(repr, ((key(r.doc_id), r.n_lines, r.n_removed, r.text) for r in out.collect()))) == sorted(map(repr, want))


def test_spread_near_the_threshold(spark):
    data = [(line, f"site {s}") for line in range(40) for s in range(80 + line)]
    lines = spark.createDataFrame(data, "h long, site string")
    assert {r.h for r in line_dedup.boilerplate(lines, min_sites=100, lg_k=8).collect()} == set(range(20, 40))


def test_no_documents(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.drop_near_copies(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
