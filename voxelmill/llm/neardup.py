"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

Texts are sets of shingles of `WIDTH` words (a text of fewer words is one shingle, a text without words has
none), weighted (1 + ln tf) * (3 + idf) / 4, where idf = ln(N / df) / ln(RARE), at most 1: a shingle of every
document weighs three quarters of a rare one. Document frequencies are exact for all shingles in more
than 1 / RARE of the documents; others have idf 1, so the table that tasks get has at most RARE times the mean
number of shingles of a document.

Improved consistent weighted sampling draws BANDS * ROWS samples of a text; texts that agree on all ROWS
samples of a band share a bucket. Within a bucket texts are compared with its hubs, first with the member
that shares most buckets, then, where they are still apart, with all members of buckets of up to `HUBS` + 1
texts and with the best of each of `HUBS` random parts of larger ones: a number of pairs that is linear in
the bucket's size. What is then still apart in a large bucket is compared member with member, in blocks of
texts, but for pairs of one component: all pairs of a bucket are tried or known to be of one class, whatever
`HUBS` is. Large buckets with the same first hub, of which there is at most one a band, are compared as one family.
Pairs whose samples
agree too seldom for the threshold are left out, the others are verified by the weighted Jaccard
similarity of their whole texts. Classes are the connected components of verified pairs and exact copies.

Exact copies are one text from the start. Null texts are empty, and all texts that are empty or equal
are copies. Null ids come after others, repeated rows are copies of each other. A class has the smallest
id of its documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graph import connected
from .common import BLOCK, Scratch, blocks, hashable, map_text, quoted, small_batches, utf8
from .words import Powers, hashed_words, mix, shingles

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
RARE = 256
HUBS = 8
#: Partners of a hub whose pairs meet its text in one task.
PARTNERS = 256
#: Members of a bucket, and bytes of their texts, that are compared at a time with as many others.
SIDE = 512
SIDE_BYTES = 4 << 20
#: Documents of a block in which shingles are counted at least, while shingles fit in memory.
COUNTED = 2048
#: Bytes of text that a task counts shingles of, about.
COUNTED_BYTES = 1 << 27
#: Standard deviations below the threshold that the share of agreeing samples may be.
SLACK = 4.0
SLOTS = 4096


def shingle_sets(data: np.ndarray, off: np.ndarray, pw: Powers, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes and their counts, for each row."""
    hashed, at = shingles(*hashed_words(data, off, pw), width, pw)
    edge = np.searchsorted(at, np.arange(len(off)))
    return [np.unique(hashed[a:z], return_counts=True) for a, z in zip(edge[:-1], edge[1:], strict=True)]


class Weights:
    """TF-IDF weights from the shingles that are frequent."""

    def __init__(self, shingle: np.ndarray, df: np.ndarray, n: int) -> None:
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        idf = np.minimum(np.log(np.maximum(n, 1) / np.maximum(df[order], 1)) / np.log(RARE), 1)
        self.factor = (3 + np.maximum(idf, 0)) / 4

    def of(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1 + np.log(tf)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            w = np.where(self.shingle[at] == shingle, w * self.factor[at], w)
        return w


class Sampler:
    """Improved consistent weighted sampling; the draws of a shingle come from tables by bits of its hash."""

    def __init__(self, samples: int, seed: int) -> None:
        self.samples, self.seed, self.r = samples, seed, None

    def load(self) -> None:
        rng = np.random.default_rng(self.seed)
        shape = (SLOTS, self.samples)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.logc = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.unit = self.r * (1 - self.beta)  # for weight 1, where t is 0

    def __reduce__(self):
        return (type(self), (self.samples, self.seed))

    def sample(self, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The samples of a weighted set that isn't empty, as 32-bit numbers."""
        if self.r is None:
            self.load()
        best, chosen, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        for lo in range(0, len(shingle), 4096):
            h, w = shingle[lo : lo + 4096], weight[lo : lo + 4096]
            i, j = (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)
            loga = self.logc[j] - self.unit[i]
            other = np.flatnonzero(w != 1)
            t = np.zeros((0, self.samples), np.float32)
            if len(other):
                r, beta = self.r[i[other]], self.beta[i[other]]
                t = np.floor(np.log(w[other]).astype(np.float32)[:, None] / r + beta)
                loga[other] = self.logc[j[other]] - r * (t - beta) - r
            at = loga.argmin(0)
            low = loga[at, np.arange(self.samples)]
            place = np.full(len(h), -1)
            place[other] = np.arange(len(other))
            now = np.where(place[at] >= 0, t[np.maximum(place[at], 0), np.arange(self.samples)] if len(other) else 0, 0).astype(np.int64)
            less = low < best
            best[less], chosen[less], level[less] = low[less], h[at[less]], now[less]
        return (mix(chosen + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    less = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(less / (a[1].sum() + b[1].sum() - less))


def frequent_shingles(texts: DataFrame, n: int, width: int, n_bytes: int = 0) -> Weights:
    """Exact document frequencies of all shingles in more than 1 / RARE of the n rows of `texts` (text).

    The first pass gathers, of each block of rows, the shingles in at least 1 / (2 * RARE) of it, by how much
    they pass that. A shingle in 1 / RARE of all rows passes it by n / (2 * RARE) rows or more in sum, whatever
    the blocks; Spark sums, and of what passes, at most 2 * RARE times the mean number of shingles of a
    document, the second pass counts all rows.
    """
    pw = Powers()
    small_batches(texts.sparkSession)
    few = texts.coalesce(max(1, n // COUNTED, n_bytes // COUNTED_BYTES))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent(part: list[np.ndarray]) -> pa.RecordBatch:
            s, df = np.unique(np.concatenate(part), return_counts=True) if part else (np.zeros(0, np.uint64), np.zeros(0, int))
            over = 2 * RARE * df - len(part)
            return pa.RecordBatch.from_arrays([pa.array(s[over >= 0].view(np.int64)), pa.array(over[over >= 0])], names=["s", "over"])

        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off, BLOCK):
                held += [s for s, _ in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], pw, width)]
                if len(held) >= 2 * COUNTED:
                    yield frequent(held[:COUNTED])
                    held = held[COUNTED:]
                elif sum(map(len, held)) > 1 << 23:
                    yield frequent(held)
                    held = []
        yield frequent(held)

    found = few.mapInArrow(candidates, "s long, over long").groupBy("s").agg(F.sum("over").alias("over")).where(F.col("over") >= n).select("s").toArrow().column("s").to_numpy()
    if not len(found):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n)
    wanted = np.sort(found.view(np.uint64))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off, BLOCK):
                for s, _ in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], pw, width):
                    at = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
                    total[at[wanted[at] == s]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    got = few.mapInArrow(counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= n / RARE).toArrow()
    return Weights(wanted[got.column("k").to_numpy()], got.column("n").to_numpy(), n)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, width: int, threshold: float) -> DataFrame:
    """(a, b): the pairs (th, hub) of text keys whose texts have at least the threshold's similarity.

    A hub's partners are dealt into parts of about PARTNERS, each of which gets the hub's text.
    """
    pw = Powers()
    small_batches(pairs.sparkSession)
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    hub_texts = parts.join(texts.select(F.col("th").alias("hub"), F.col("text").alias("text_b")), "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("th"), F.col("parts")).cast("int")).drop("parts")
    met = dealt.join(texts.select("th", F.col("text").alias("text_a")), "th").join(hub_texts.drop("parts"), ["hub", "part"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sides = [[(s, weights.of(s, tf)) for s, tf in shingle_sets(*utf8(part.column(c)), pw, width)] for c in ("text_a", "text_b")]
                near = np.array([weighted_jaccard(x, y) >= threshold for x, y in zip(*sides, strict=True)], bool)
                yield pa.RecordBatch.from_arrays([part.column("th"), part.column("hub")], names=["a", "b"]).filter(pa.array(near))

    return met.select("th", "hub", "text_a", "text_b").mapInArrow(check, "a string, b string")


def links_apart(known: DataFrame, sigs: DataFrame, texts: DataFrame, weights: Weights, width: int, threshold: float, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): the pairs of members of a family with other labels whose texts have at least the threshold's similarity.

    known (family, th, label). Members are dealt into blocks of about SIDE, or of SIDE_BYTES of text, by hash;
    those of a label with more into blocks of their own, which don't meet each other. Blocks meet, not rows: a
    text goes with its block, and only links come out.
    """
    long = known.join(texts.select("th", F.octet_length("text").alias("bytes")), "th")
    sizes = long.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    few = (F.col("n") < SIDE) & (F.col("bytes") < SIDE_BYTES)
    rest = sizes.where(few).groupBy("family").agg(F.sum("n").alias("m"), F.sum("bytes").alias("m_bytes"))
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / SIDE, F.col(size) / SIDE_BYTES, F.lit(1.0)))
    # part: the label of blocks of one label, empty for blocks of several.
    dealt = sizes.join(rest, "family", "left").select("family", "label", F.when(few, "").otherwise(F.col("label")).alias("part"), F.when(few, parts("m", "m_bytes")).otherwise(parts("n", "bytes")).alias("parts"))
    placed = known.join(dealt, ["family", "label"]).withColumn("block", F.pmod(F.xxhash64("th"), F.col("parts"))).join(sigs, "th").join(texts, "th")
    each = ["th", "label", "sig", "text"]
    name = ["family", "part", "block"]
    held = scratch.cut(placed.groupBy(*name).agg(F.collect_list(F.struct(*each)).alias("x")).select(*name, *[F.col(f"x.{c}").alias(c) for c in each]))
    side = lambda s: [F.col("family"), *[F.col(c).alias(f"{c}_{s}") for c in ("part", "block")]]
    ordered = (F.col("part_a") < F.col("part_b")) | ((F.col("part_a") == F.col("part_b")) & (F.col("part_a") == "") & (F.col("block_a") <= F.col("block_b")))
    met = held.select(*side("a")).join(held.select(*side("b")), "family").where(ordered)
    for s in "ab":
        met = met.join(held.select(*side(s), *[F.col(c).alias(f"{c}_{s}") for c in each]), ["family", f"part_{s}", f"block_{s}"])
    pw = Powers()
    small_batches(known.sparkSession)

    def weighted(text: pa.Array, used: np.ndarray) -> dict:
        used = np.unique(used)
        return {k: (s, weights.of(s, tf)) for k, (s, tf) in zip(used.tolist(), shingle_sets(*utf8(text.take(pa.array(used))), pw, width), strict=True)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                th_a, label_a, sig_a, text_a, th_b, label_b, sig_b, text_b = [c[k].values for c in batch.columns]
                a, b = (x.flatten().to_numpy().reshape(len(x), -1) for x in (sig_a, sig_b))
                same = np.zeros((len(a), len(b)), np.int32)
                for x, y in zip(a.T, b.T, strict=True):
                    same += x[:, None] == y
                i, j = np.nonzero(same >= least * a.shape[1])
                label_a, label_b = (np.array(x.to_pylist(), object) for x in (label_a, label_b))
                other = label_a[i] != label_b[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                sets_a, sets_b = weighted(text_a, i), weighted(text_b, j)
                near = np.array([weighted_jaccard(sets_a[x], sets_b[y]) >= threshold for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([th_a.take(pa.array(i[near])), th_b.take(pa.array(j[near]))], names=["a", "b"])

    return met.select(*[f"{c}_{s}" for s in "ab" for c in each]).mapInArrow(meet, "a string, b string").distinct()


def text_classes(docs: DataFrame, id_col: str, text: str, width: int, threshold: float, bands: int, rows: int, seed: int, hubs_of: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """(id, th) of every document, th telling texts apart, and (node, label) of the texts with links."""
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.md5(F.col("text").cast("binary")))
    sized = scratch.cut(whole.select("id", "th", F.octet_length("text").cast("long").alias("bytes")))
    count = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    slim = sized.drop("bytes")
    weights = frequent_shingles(whole.select("text"), count["n"], width, count["bytes"])
    pw, sampler, samples = Powers(), Sampler(bands * rows, seed), bands * rows

    def sign(data: np.ndarray, off: np.ndarray) -> list:
        return [[sampler.sample(s, weights.of(s, tf)).tolist() if len(s) else None for s, tf in shingle_sets(data, off, pw, width)]]

    signed = map_text(whole, ["th"], "text", sign, [T.StructField("sig", T.ArrayType(T.IntegerType()))])
    signed = scratch.cut(signed.where("sig is not null").dropDuplicates(["th"]))
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("sig", k * rows + 1, rows)) for k in range(bands)])
    buckets = signed.select("th", F.posexplode(keys).alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.cut(buckets.join(shared, "key"))
    score = members.groupBy("th").agg(F.sum("size").alias("score"))
    scored = members.join(score, "th").select("key", "size", "th", F.struct("score", "th").alias("s"))
    # The first hub scores most; the others are all members of small buckets, the best of each random part of large ones.
    first_hub = scored.groupBy("key").agg(F.max("s").alias("s")).select("key", F.col("s.th").alias("hub"), F.lit(1).alias("rank"))
    small = scored.where(F.col("size") <= hubs_of + 1).select("key", F.col("th").alias("hub"), F.lit(2).alias("rank"))
    large = scored.where(F.col("size") > hubs_of + 1).groupBy("key", F.pmod(F.xxhash64("th"), F.lit(hubs_of))).agg(F.max("s").alias("s")).select("key", F.col("s.th").alias("hub"), F.lit(2).alias("rank"))
    hubs = scratch.cut(first_hub.unionByName(small).unionByName(large))
    # Texts of members only, from one row of each: rows of a text are told apart by their ids before they are moved.
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(" "), F.col("th")).alias("name")
    first = members.select("th").distinct().join(slim.groupBy("th").agg(F.min("id").alias("id")), "th").select(name)
    texts = scratch.cut(whole.select(name, "th", "text").join(first, "name", "left_semi").dropDuplicates(["th"]).select("th", "text"))
    least = threshold - SLACK * (threshold * (1 - threshold) / samples) ** 0.5
    sigs = signed.join(members.select("th").distinct(), "th", "left_semi")

    def links(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy(F.least("th", "hub").alias("a"), F.greatest("th", "hub").alias("b")).agg(F.max("hub").alias("hub"))
        once = once.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("th"), "hub")
        agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
        near = once.join(sigs.select("th", F.col("sig").alias("sig_a")), "th").join(sigs.select(F.col("th").alias("hub"), F.col("sig").alias("sig_b")), "hub").where(agree >= least * samples)
        return verified(scratch.cut(near.select("th", "hub")), texts, weights, width, threshold)

    pairs = members.join(hubs.where("rank = 1"), "key").where("th <> hub")
    one = scratch.cut(links(pairs))
    labels = connected(one)
    known = members.join(labels, F.col("th") == F.col("node"), "left").select("key", "th", F.coalesce("label", "th").alias("label"))
    # Buckets whose members are not all in one component meet their other hubs.
    apart = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_hubs = hubs.where("rank = 2").join(apart, "key").join(labels, F.col("hub") == F.col("node"), "left").select("key", "hub", F.coalesce("label", "hub").alias("hub_label"))
    more = known.join(open_hubs, "key").where(F.col("label") != F.col("hub_label"))
    two = scratch.cut(links(more).unionByName(one))
    labels = connected(two)
    # Large buckets whose members are still not all in one component: all pairs of two components.
    known = members.where(F.col("size") > hubs_of + 1).join(labels, F.col("th") == F.col("node"), "left").select("key", "th", F.coalesce("label", "th").alias("label"))
    apart = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    families = hubs.where("rank = 1").join(apart, "key").select("key", F.col("hub").alias("family"))
    still = scratch.cut(known.join(families, "key").select("family", "th", "label").distinct())
    if not still.isEmpty():
        three = scratch.cut(links_apart(still, sigs, texts, weights, width, threshold, least, scratch))
        labels = labels if three.isEmpty() else connected(two.unionByName(three))
    scratch.keep(sized)
    return slim, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = 3, hubs: int = HUBS) -> DataFrame:
    """(id, class_id, n_copies) of every document; class_id is the smallest id in its class, n_copies counts equal texts.

    `hubs` shifts work between the rounds; the classes don't depend on it.
    """
    slim, labels = text_classes(docs, id_col, text, width, threshold, bands, rows, seed, hubs)
    nodes = slim.groupBy("th").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"))
    nodes = nodes.join(labels, F.col("th") == F.col("node"), "left").withColumn("label", F.coalesce("label", "th"))
    least = nodes.groupBy("label").agg(F.min("first").alias("class_id"))
    classes = nodes.join(least, "label").select("th", "class_id", "n_copies")
    return slim.join(classes, "th").select(F.col("id").alias(id_col), "class_id", "n_copies")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = 3, hubs: int = HUBS) -> DataFrame:
    """One document of each class, that with the smallest id (then text hash), with all its columns.

    Of rows with the same id and text one stays, by a hash of their other columns, but for maps.
    """
    slim, labels = text_classes(docs, id_col, text, width, threshold, bands, rows, seed, hubs)
    name = lambda key, th: F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(" "), th)
    nodes = slim.groupBy("th").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    nodes = nodes.join(labels, F.col("th") == F.col("node"), "left").withColumn("label", F.coalesce("label", "th"))
    kept = nodes.groupBy("label").agg(F.min("first").alias("first")).select(name(F.col("first.id"), F.col("first.th")).alias("name"))
    named = docs.select(name(quoted(id_col), F.md5(F.coalesce(quoted(text), F.lit("")).cast("binary"))).alias("name"), F.struct("*").alias("row"), F.xxhash64(*hashable(docs)).alias("hash"))
    return named.join(kept, "name", "left_semi").groupBy("name").agg(F.min_by("row", "hash").alias("row")).select("row.*")


def neardup_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
