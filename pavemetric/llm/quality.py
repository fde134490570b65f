"""Quality classifier: a generalised additive model with pairwise interactions, boosted in turn over its features."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, the ones with the least hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Bins of a feature and of each side of a pair; passes over the features and over the pairs; pairs; learning rate.
BINS, PAIR_BINS, PASSES, PAIR_PASSES, PAIRS, RATE = 64, 12, 120, 60, 8, 0.15
ACCEPT = 0.7
#: Buckets that words are hashed into, each with its share of a text's words as an input.
BUCKETS = 32
NAMES = ["log_chars", "log_words", "upper", "digit", "symbol", "stop", "space", "newline", "non_ascii", "word_chars", "distinct", "repeated", "short_words", "long_words", "capital_words", "marked_words", "top_word", *[f"bucket_{i}" for i in range(BUCKETS)]]


def _classes() -> np.ndarray:
    """Class of each byte: 1 upper, 2 lower, 3 digit, 4 symbol, 5 sentence end or comma, 6 space, 7 newline, 8 not ASCII."""
    table = np.full(256, 4, np.int64)
    for i in range(256):
        c = chr(i)
        table[i] = 8 if i > 127 else 7 if c == "\n" else 6 if c.isspace() else 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 5 if c in ".,;:?" else 4
    return table


CLASSES = _classes()
#: For the hash of a word: a number for each byte, the same for a letter in either case, none for blanks; a factor by place.
_numbers = np.random.default_rng(20).integers(1, 1 << 62, 256 + 16, np.uint64)
BYTES, PLACES = np.where((CLASSES == 6) | (CLASSES == 7), np.uint64(0), _numbers[[ord(chr(i).lower()) if i < 128 else i for i in range(256)]]), _numbers[256:] | np.uint64(1)


def word_buckets(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of the words in each bucket, by a hash of the bytes of each word; starts of the words in raw."""
    raw, starts = raw[starts[0] :], starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    sums = np.add.reduceat(BYTES[raw] * PLACES[place & 15], starts)
    return np.bincount((sums >> np.uint64(32)).astype(np.int64) % BUCKETS, minlength=BUCKETS) / len(starts)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each whole text; null and empty texts have zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        kinds = CLASSES[raw]
        count = np.bincount(kinds, minlength=10)
        words = text.split()
        n, letters = len(words), max(1, count[1] + count[2] + count[8])
        blank = np.flatnonzero((kinds == 6) | (kinds == 7))
        sizes = np.diff(blank, prepend=-1, append=len(raw)) - 1
        sizes = sizes[sizes > 0]
        row = out[i]
        row[:2] = np.log1p(len(text)), np.log1p(n)
        row[2], row[3] = count[1] / letters, count[3] / len(raw)
        row[4:9] = count[[4, 5, 6, 7, 8]] / len(raw)
        if n:
            starts = np.concatenate([[0], blank + 1])
            starts = starts[starts < len(raw)]
            row[9] = sizes.mean()
            row[10] = len(set(words)) / n ** 0.75
            row[11] = sum(map(eq, words, words[1:])) / n
            row[12], row[13] = (sizes <= 3).mean(), (sizes >= 12).mean()
            row[14] = (kinds[starts] == 1).mean()
            ends = np.concatenate([blank, [len(raw)]]) - 1
            row[15] = (kinds[ends[ends >= 0]] == 4).mean()
            row[16] = _share_of_most(words)
            row[17:] = word_buckets(raw, starts[(kinds[starts] != 6) & (kinds[starts] != 7)])
    return out


def _share_of_most(words: list[str]) -> float:
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return max(seen.values()) / len(words)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Values of the bins by a tree on their order: the best split of any leaf, until there are `leaves`."""
    cuts, gs, hs = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-6, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = np.arange(a + 1, b)
            k = k[(hs[k] - hs[a] >= least) & (hs[b] - hs[k] >= least)]
            if len(k):
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                best = max(best, (float(gain.max()), int(k[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AdditiveModel:
    """intercept + sum of a table per feature + sum of a table per pair of features, all looked up by bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(rate / (1 - rate)))
        self.edges = [self._edges(c, BINS) for c in x.T]
        self.coarse = [self._edges(c, PAIR_BINS) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if len(np.unique(y)) < 2:
            return
        margin = np.full(len(y), self.intercept)
        bins = self._bins(x, self.edges)
        for _ in range(PASSES):
            for b, table in zip(bins, self.tables, strict=True):
                p = _sigmoid(margin)
                step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), 4)
                table += step
                margin += step[b]
        bins = self._bins(x, self.coarse)
        p = _sigmoid(margin)
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            cell = bins[i] * shape[1] + bins[j]
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g**2 / (h + 5)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_PASSES):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                p = _sigmoid(margin)
                cell = bins[i] * table.shape[1] + bins[j]
                g = np.bincount(cell, y - p, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                # a cut on one side, then a tree on the other side of each part
                rows = _tree(g.sum(1), h.sum(1), 2)
                step = np.empty(table.shape)
                for value in np.unique(rows):
                    part = rows == value
                    step[part] = _tree(g[part].sum(0), h[part].sum(0), 2)
                table += RATE * step
                margin += RATE * step[bins[i], bins[j]]

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            out += table[b]
        bins = self._bins(x, self.coarse)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[i], bins[j]]
        return _sigmoid(out)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text, modulo 4, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """A model of labels.quality by the texts of at most sample_rows labelled rows outside the held-out fold.

    Rows without a label of 0 or 1, and ids without a text, are left out; of several labels of an id the least counts, and
    of several texts one. No such rows, or one class only: the model is a constant.
    """
    mine = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    mine = mine.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").alias("quality"))
    mine = mine.orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = features(batch["text"].tolist())
            yield pd.DataFrame({"l_id": batch["l_id"], "quality": batch["quality"], "x": list(x)})

    # sample_rows bounds this side
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(mine), F.col("id") == F.col("l_id")).select("l_id", "quality", "text")
    rows = rows.mapInPandas(run, "l_id long, quality int, x array<double>").groupBy("l_id").agg(F.min(F.struct("quality", "x")).alias("r")).collect()
    rows.sort(key=lambda r: r["l_id"])
    x = np.array([r["r"]["x"] for r in rows]).reshape(len(rows), len(NAMES))
    return AdditiveModel(x, np.array([r["r"]["quality"] for r in rows], float))


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with score and predicted; null and empty texts are scored too. Existing columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    text = F.col("text").cast("string")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(features(texts.tolist())))

    return docs.select(*columns, score(text).alias("score")).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; only the text counts in a score."""
    model = fit(docs, labels, sample_rows)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_rejected(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs that the classifier accepts (columns named score or predicted are those of the classifier)."""
    return scored(docs, fit(docs, labels, sample_rows)).where("predicted = 1").select(*docs.columns)
