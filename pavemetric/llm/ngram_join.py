"""Self-join of documents by the Jaccard similarity of their word n-grams.

Rare-first prefix filtering. With the grams of every document in one order, two documents of similarity t share a gram
among the first n - ceil(t n) + 1 of each, n being the number of a document's grams. The order is by document frequency,
so the grams of a prefix are rare and few documents meet in them.

1. screen: counting all grams of all documents is most of the work, and nearly all of them occur once. So a longer prefix
   in hash order is counted first: documents of similarity t share l grams among the first n - ceil(t n) + l in any
   order. Documents with fewer grams than that in common with any others have no partner and go no further. Nothing
   is lost by this.
2. Documents with equal gram sets become one class. Document frequencies over the classes that are left give the
   rare-first order, and each class its prefix; a class with more than n - ceil(t n) grams of its own has no partner.
3. Classes are joined on the grams of their prefixes. A gram that many classes have would join all their pairs, so there
   stars come first: each class is verified against a hub of the gram, and classes that links connect get one label. Rounds
   of stars go on while they bring in a quarter of the classes outside of a gram's largest label. Then every pair of
   classes that share a prefix gram and differ in label is formed, gram by gram, hot grams dealt over several tasks; length,
   positional and suffix filters (the last on the counts of 64 slices of the hash order) in the join, before a pair is made;
   the positional one again on the places of all grams that a pair shares; and one verification for each pair.
4. Components of the links give each document the smallest id it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, copy_key, give_back_memory, keep_rows, null_id, plain_id, remove, saved_at, small, spread_join

WORDS, PERCENT = 5, 80
#: Documents whose prefixes one screening task counts; classes of a block of the frequency count; words that a worker
#: remembers the hashes of.
SCREEN_DOCS, BLOCK_DOCS, MEMO_WORDS = 5_000, 1_000, 250_000
#: Classes of a gram from which stars come first, and from which its pairs are formed in several tasks; hubs that a class
#: tries in a round; slices of the hash order that the suffix filter compares.
STAR, SPLIT, HUBS, SLICES = 16, 2_000, 3, 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
MANY = np.uint64(0xFFFFFFFFFFFFFFFF)


def least_overlap(n: int) -> int:
    """Grams that a document of n grams shares with any partner, at least."""
    return -(-PERCENT * n // 100)


def prefix_size(n: int) -> int:
    return n - least_overlap(n) + 1


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * MIX[1]
    z = (z ^ z >> np.uint64(27)) * MIX[2]
    return z ^ z >> np.uint64(31)


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memo: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        from xxhash import xxh64_intdigest

        out = []
        for text in texts:
            # bytes.lower() and bytes.split() know ASCII only: A-Z, and white space [\x20\x09-\x0D]
            words = (text or "").encode().lower().split()
            n = len(words)
            if not n:
                out.append(np.empty(0, np.uint64))
                continue
            memo = self.memo
            if len(memo) > MEMO_WORDS:
                memo.clear()
            try:
                h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
            except KeyError:
                for w in words:
                    if w not in memo:
                        memo[w] = xxh64_intdigest(w)
                h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
            k = min(n, self.words)
            z = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                z = mixed(z * MIX[0] + h[i : n - k + 1 + i])
            out.append(np.unique(z))
        return out


def class_key(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def grouped(pdf: pd.DataFrame, column: str, dtype: type = np.uint64) -> np.ndarray:
    parts = [np.frombuffer(b, dtype) for b in pdf[column]]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def screened(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, str]:
    """uid, doc_id, copy_key, n, cls and hits: how many grams of a longer hash-order prefix others share."""
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // SCREEN_DOCS)
    schema = "slice int, uid long, doc_id long, no_id boolean, copy_key long, n int, cls binary, hits int, grams binary, owners binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shingler, uid = Shingler(words), TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                sets = shingler.sets(part["text"].tolist())
                n = np.array([len(s) for s in sets])
                keys = [class_key(s) for s in sets]
                heads = [s[: prefix_size(len(s)) + len(s) // 20] for s in sets]
                own = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
                grams = np.concatenate(heads) if heads else np.empty(0, np.uint64)
                order = np.argsort(grams, kind="stable")
                grams, own = grams[order], own[order]
                starts, sizes = _runs(grams)
                # grams that meet here are counted here and go on without an owner, so a frequent gram goes on once
                hits = np.bincount(own[np.repeat(sizes > 1, sizes)], minlength=len(sets))
                owners = np.where(sizes > 1, MANY, (uid + own[starts]).astype(np.uint64))
                grams = grams[starts]
                rng = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(rng, np.arange(ranges + 1))
                held = np.flatnonzero(np.diff(cuts))
                rows = [(int(r), 0, 0, False, 0, 0, None, 0, grams[cuts[r] : cuts[r + 1]].tobytes(), owners[cuts[r] : cuts[r + 1]].tobytes()) for r in held]
                rows += [((uid + i) % ranges, uid + i, d, z, k, int(n[i]), keys[i] if n[i] else None, int(hits[i]), None, None) for i, (d, z, k) in enumerate(part[["doc_id", "no_id", "copy_key"]].itertuples(index=False, name=None))]
                uid += len(sets)
                yield pd.DataFrame(rows, columns=names)
        shingler.memo.clear()
        give_back_memory()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = pdf["grams"].notna()
        grams, owners = grouped(pdf[blobs], "grams"), grouped(pdf[blobs], "owners")
        order = np.argsort(grams, kind="stable")
        _, sizes = _runs(grams[order])
        owners = owners[order][np.repeat(sizes > 1, sizes)]
        uid, hits = np.unique(owners[owners != MANY], return_counts=True)
        rest = {"doc_id": 0, "no_id": False, "copy_key": np.iinfo(np.int64).min, "n": 0, "cls": None, "seen": False}
        found = pd.DataFrame({"uid": uid.astype(np.int64), "hits": hits}).assign(**rest)
        return pd.concat([pdf.loc[~blobs, ["uid", "hits", "doc_id", "no_id", "copy_key", "n", "cls"]].assign(seen=True), found])

    rows = docs.select(*plain_id(), F.col("text").cast("string").alias("text"), copy_key(F.col("text")).alias("copy_key"))
    met = rows.mapInPandas(count, schema).groupBy("slice").applyInPandas(meet, "uid long, hits int, doc_id long, no_id boolean, copy_key long, n int, cls binary, seen boolean")
    row = F.max_by(F.struct(null_id(), "copy_key", "n", "cls"), "seen").alias("row")
    summed = met.groupBy("uid").agg(row, F.sum("hits").alias("hits"))
    return saved_at(summed.select("uid", "row.*", "hits"), "screen")


def prefixes(sets: DataFrame, blocks: int) -> DataFrame:
    """cid, n, alone, gram, place: the grams of each class's rare-first prefix that other classes have too.

    alone: how many grams only this class has.
    """
    ranges = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 4)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, counts = np.unique(grouped(pdf.drop_duplicates("cid"), "grams"), return_counts=True)
        rng = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(rng, np.arange(ranges + 1))
        counts = counts.astype(np.uint32)
        return pd.DataFrame([(int(r), int(pdf["block"].iloc[0]), grams[cuts[r] : cuts[r + 1]].tobytes(), counts[cuts[r] : cuts[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(cuts))], columns=["slice", "block", "grams", "counts"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, counts = grouped(pdf, "grams"), grouped(pdf, "counts", np.uint32).astype(np.int64)
        block = np.repeat(pdf["block"].to_numpy(), [len(b) // 8 for b in pdf["grams"]])
        order = np.argsort(grams, kind="stable")
        grams, counts, block = grams[order], counts[order], block[order]
        starts, sizes = _runs(grams)
        df = np.repeat(np.add.reduceat(counts, starts), sizes) if len(starts) else counts
        grams, df, block = grams[df > 1], df[df > 1], block[df > 1]
        order = np.argsort(block, kind="stable")
        grams, df, block = grams[order], df[order].astype(np.uint32), block[order]
        starts, sizes = _runs(block)
        return pd.DataFrame([(int(block[a]), grams[a : a + k].tobytes(), df[a : a + k].tobytes()) for a, k in zip(starts, sizes, strict=True)], columns=["block", "grams", "df"])

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shared, df = grouped(right, "grams"), grouped(right, "df", np.uint32)
        o = np.argsort(shared)
        shared, df = shared[o], df[o]
        out = []
        for cid, n, raw in left.drop_duplicates("cid")[["cid", "n", "grams"]].itertuples(index=False, name=None):
            grams = np.frombuffer(raw, np.uint64)
            at = np.searchsorted(shared, grams)
            common = at < len(shared)
            common[common] = shared[at[common]] == grams[common]
            mine, d = grams[common], df[at[common]]
            alone, size = n - len(mine), prefix_size(n)
            if alone >= size:
                continue
            first = np.lexsort((mine, d))[: size - alone]
            out.append(pd.DataFrame({"cid": cid, "n": n, "alone": alone, "gram": mine[first].view(np.int64), "place": alone + np.arange(len(first))}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "n": [], "alone": [], "gram": [], "place": []})

    counted = sets.groupBy("block").applyInPandas(local, "slice int, block int, grams binary, counts binary")
    counted = counted.groupBy("slice").applyInPandas(total, "block int, grams binary, df binary")
    return sets.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(order, "cid long, n int, alone int, gram long, place int")


def lengths_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def overlap_needed(a: Column, b: Column) -> Column:
    return F.ceil(PERCENT * (a + b) / F.lit(100.0 + PERCENT))


def slices_fit(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """Suffix filter: slices' counts differ by no more in all than two similar sets may."""
    apart = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    return apart <= na + nb - 2 * overlap_needed(na, nb)


class Verifier:
    """Links among pairs of classes, each pair looked at once."""

    def __init__(self, sets: DataFrame):
        self.sets, self.links, self.tested, self.paths = sets, None, None, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        out, path = saved_at(df, name)
        self.paths.append(path)
        return out

    def new(self, pairs: DataFrame) -> DataFrame:
        """pairs without those that were verified before."""
        return pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")

    def verify(self, pairs: DataFrame, sifted: bool = False) -> None:
        """pairs (a, b, na, nb), a < b, distinct: the suffix filter by slices unless they passed it, then the sets themselves."""
        pairs = self.kept(self.new(pairs), "pairs")
        met = self.kept(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "met")
        # of the sets only those that occur are moved
        sets = self.kept(self.sets.join(small(met, met.count()), "cid", "left_semi").select("cid", "grams", "slices"), "met-sets")
        both = near = pairs
        if not sifted:
            for side in "ab":
                both = spread_join(both, sets.select(F.col("cid").alias(side), F.col("slices").alias(f"s{side}")), side, pairs)
            both = near = self.kept(both.where(slices_fit(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"))).drop("sa", "sb"), "near-pairs")
        for side in "ab":
            both = spread_join(both, sets.select(F.col("cid").alias(side), F.col("grams").alias(f"g{side}")), side, near)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for x, y in zip(batch["ga"], batch["gb"], strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
                yield batch.loc[keep, ["a", "b"]]
            give_back_memory()

        links = self.kept(both.select("a", "b", "ga", "gb").mapInPandas(run, "a long, b long"), "links")
        self.links = links if self.links is None else self.links.unionByName(links)
        pairs = pairs.select("a", "b")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)

    def labels(self) -> DataFrame:
        """cid and label, the least class that links reach, of classes with links."""
        return self.kept(components(self.links, "labels").select(F.col("node").alias("cid"), F.col("root").alias("label")), "labels")


def verified_links(postings: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Links (a, b) among the classes of postings (cid, n, alone, gram, place) that connect all pairs of similarity PERCENT or more."""
    check = Verifier(sets)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    shared = check.kept(postings.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "grams")
    known = shared.count()
    met = check.kept(spread_join(postings, shared, "gram", postings, rows=known), "meetings")
    # stars: classes whose lengths fit fall into one band, or into neighbouring ones
    hot = met.where(F.col("k") > STAR).select("cid", "n", "alone", F.explode(F.array(band, band + 1)).alias("band"), "gram").select("cid", "n", "alone", F.xxhash64("gram", "band").alias("meeting"))
    hot, labels, outside, turn = check.kept(hot, "hot"), None, None, 0
    while True:
        named = labelled(hot, labels)
        # of near copies those with the fewest grams of their own are most like the others; later rounds try further ones
        chance = F.xxhash64("cid", "meeting", F.lit(turn))
        near = F.col("alone") * (1 + F.pmod(chance, F.lit(1000)) / 500) if turn else F.col("alone")
        hub = F.min(F.struct(near.alias("near"), (chance if turn else F.col("cid")).alias("chance"), "cid", "n")).alias("hub")
        groups = named.groupBy("meeting", "label").agg(F.count("*").alias("c"), hub)
        top = groups.groupBy("meeting").agg(F.max(F.struct("c", (-F.col("hub.near")).alias("near"), (-F.col("label")).alias("least"), "hub")).alias("top"), F.sum("c").alias("k")).where(F.col("k") > F.greatest(F.lit(STAR), F.col("top.c")))
        top = check.kept(top.select("meeting", (-F.col("top.least")).alias("major"), F.col("top.hub.cid").alias("hub"), F.col("top.hub.n").alias("hub_n"), (F.col("k") - F.col("top.c")).alias("left")), "hubs")
        meetings, left = top.agg(F.count("*"), F.coalesce(F.sum("left"), F.lit(0))).first()
        if not left or (outside is not None and 4 * left > 3 * outside):
            break
        outside, turn = left, turn + 1
        rays = spread_join(named, top, "meeting", hot, rows=meetings).where((F.col("label") != F.col("major")) & (F.col("cid") != F.col("hub")) & lengths_fit(F.col("n"), F.col("hub_n")))
        pairs = rays.groupBy(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"), "cid").agg(F.count("*").alias("times"), F.any_value(F.when(F.col("cid") < F.col("hub"), F.col("n")).otherwise(F.col("hub_n"))).alias("na"), F.any_value(F.when(F.col("cid") < F.col("hub"), F.col("hub_n")).otherwise(F.col("n"))).alias("nb"))
        # the hubs that a class shares most with; what this leaves out is joined below
        best = check.new(pairs).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "a", "b", "na", "nb")), False), 1, HUBS).alias("best"))
        check.verify(best.select(F.inline("best")).select("a", "b", "na", "nb").distinct())
        labels = check.labels()
    # all pairs that share a prefix gram and differ in label
    named = labelled(met, labels)
    top = named.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("gram", F.col("top.label").alias("major"))
    top = check.kept(top, "majors")
    named = spread_join(named, top, "gram", met, rows=top.count()).withColumn("minor", F.col("label") != F.col("major")).withColumn("cuts", F.ceil(F.col("k") / SPLIT).cast("int"))
    named = check.kept(named.join(sets.select("cid", "slices"), "cid"), "named")
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("cid", "n", "alone", "place", "label", "minor", "slices")]
    left = named.where("minor").select("gram", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), *side("x"))
    right = named.select("gram", F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int").alias("cut"), *side("y"))
    # positional filter on one shared gram: what may be shared before it (grams of one class alone come first), and from it on
    most = F.least(F.col("x_place") - F.col("x_alone"), F.col("y_place") - F.col("y_alone")) + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    fits = lengths_fit(F.col("x_n"), F.col("y_n")) & (most >= overlap_needed(F.col("x_n"), F.col("y_n")))
    both = left.join(right, ["gram", "cut"]).where((F.col("x_label") != F.col("y_label")) & (~F.col("y_minor") | (F.col("x_cid") < F.col("y_cid"))) & fits & slices_fit(F.col("x_slices"), F.col("y_slices"), F.col("x_n"), F.col("y_n")))
    swap = F.col("x_cid") > F.col("y_cid")
    ordered = lambda c: (F.when(swap, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")), F.when(swap, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")))
    both = both.select(*[c.alias(f"{p}{q}") for q in ("cid", "n", "place") for p, c in zip("ab", ordered(q), strict=True)])
    pairs = both.groupBy(F.col("acid").alias("a"), F.col("bcid").alias("b"), F.col("an").alias("na"), F.col("bn").alias("nb")).agg(F.count("*").alias("shared"), *[f(f"{p}place").alias(f"{p}{g}") for p in "ab" for g, f in (("first", F.min), ("last", F.max))])
    # and on all of them: nothing before the first, and what may follow the last one
    least = overlap_needed(F.col("na"), F.col("nb"))
    rest = F.least(F.col("na") - F.col("alast"), F.col("nb") - F.col("blast")) - 1
    pairs = pairs.where((F.least(F.col("na") - F.col("afirst"), F.col("nb") - F.col("bfirst")) >= least) & (F.col("shared") + rest >= least))
    check.verify(pairs.select("a", "b", "na", "nb"), sifted=True)
    return check.links, check.paths


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (cid, ...) with the label of their class, which is its own id where it has none."""
    if labels is None:
        return rows.withColumn("label", F.col("cid"))
    named = rows.join(small(labels, labels.count()), "cid", "left")
    return named.withColumn("label", F.coalesce("label", "cid"))


def ngram_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, copy_key and kept for every row of docs (doc_id, text; others ignored).

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case. A text of fewer words than an n-gram has one gram, all
    its words; a null text or one without words has none and is linked with nothing. component_id is the smallest
    doc_id linked directly or not; ids that are null count as the largest, and stay null where there is no other. kept marks
    the row of a component with that id (of several, the one with the least hash of its text, and rows equal to it). An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows, rows_at = screened(docs, words)
    classes = rows.where((F.col("n") > 0) & (F.col("hits") > F.floor(F.col("n") / 25))).groupBy("cls").agg(F.min_by("doc_id", F.struct("doc_id", "copy_key")).alias("c_id"), F.min_by("copy_key", F.struct("doc_id", "copy_key")).alias("c_key"))
    classes, classes_at = saved_at(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    number = classes.count()
    blocks = max(1, number // BLOCK_DOCS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = shingler.sets(batch["text"].tolist())
            # a count cut off at the most that a short holds only weakens the filter
            slices = [np.minimum(np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=SLICES), 32767).astype(np.int16) for x in sets]
            yield pd.DataFrame({"cid": batch["cid"], "n": [len(x) for x in sets], "grams": [x.tobytes() for x in sets], "slices": slices})
        shingler.memo.clear()
        give_back_memory()

    # texts of the classes' first documents; with few classes this is one scan, with many a shuffle of the texts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), copy_key(F.col("text")).alias("copy_key"))
    texts = texts.join(small(classes.drop("cls"), number), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("copy_key") == F.col("c_key"))).select("cid", "text")
    sets = texts.mapInPandas(cut, "cid long, n int, grams binary, slices array<smallint>").dropDuplicates(["cid"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int"))
    sets, sets_at = saved_at(sets, "sets")
    postings, postings_at = saved_at(prefixes(sets, blocks), "prefixes")

    links, paths = verified_links(postings, sets)
    groups = components(links, "near")

    # labels by class, then by component; a class's documents may be a third of all, which skew joins split
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy_key")
    least = rows.where("n > 0").groupBy("cls").agg(F.min(first).alias("least"))
    linked_classes = classes.select("cls", "cid").join(groups.select(F.col("node").alias("cid"), "root"), "cid").select("cls", "root")
    rooted = least.join(linked_classes, "cls")
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    rooted = rooted.join(best, "root").select("cls", "best")
    label = F.coalesce("best", "least")
    labels, _ = saved_at(least.join(rooted, "cls", "left").select(F.col("cls").alias("l_cls"), label["doc_id"].alias("l_id"), label["copy_key"].alias("l_key")), "labels")
    remove(spark, classes_at, sets_at, postings_at, *paths)
    out = rows.join(labels, F.col("cls") == F.col("l_cls"), "left")
    alone = F.col("l_cls").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("copy_key") == F.col("l_key")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("l_id")).alias("component_id"), "copy_key", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row of each component; rows without words all stay."""
    return keep_rows(docs, ngram_components(docs, words).where("n_shingles > 0"))
