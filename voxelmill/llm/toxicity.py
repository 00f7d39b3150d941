"""Toxicity: a factorization machine over hashed terms of whole documents.

The terms of a document are the set of its words and of their prefixes of four to eight bytes, hashed.
The score is the logistic of w0 + sum of w + sum over pairs of <v_i, v_j>, so pairs of terms that are
toxic only together, such as an insult with a mention of a group, weigh beyond their sums.

Of the sample's hundred thousands of terms the machine gets those that tell something alone, by their share of
label 1, and those that tell something in pairs: what a machine of the first kind misjudges is searched for
pairs of terms whose share of label 1 together is far from the mean, however balanced each is alone.

Repeated ids of documents are scored each by its own text; of repeated ids in the sample the greatest text
counts. Only the id and the text are read, so other columns may have any name.
Nulls and texts without words have no terms and get the logistic of w0. Terms of other documents never
count. Equal texts get equal scores. An empty table gives an empty result; without labels of both
kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, filter_text, held_out, labelled_sample, map_text
from .words import PIECE, Powers, mix, pieces, prefix_sums, span_hash, word_spans

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)


def terms(data: np.ndarray, off: np.ndarray, pw: Powers, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) without repeats, by row: the hashed terms, or their slots (above 0) if given."""
    if len(off) == 2 and len(data) > 2 * PIECE:
        every = np.unique(np.concatenate([terms_of(data[a:z], np.array([0, z - a]), pw, slot)[1] for a, z in pieces(data)]))
        return np.zeros(len(every), np.int64), every
    return terms_of(data, off, pw, slot)


def terms_of(data: np.ndarray, off: np.ndarray, pw: Powers, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    b, s, e, row = word_spans(data, off)
    h = prefix_sums(b, pw)
    each = [span_hash(h, s, e, pw)]
    rows = [row]
    for k, n in enumerate(PREFIXES):
        long = np.flatnonzero(e - s >= n)
        each.append(mix(span_hash(h, s[long], s[long] + n, pw) + np.uint64(k + 1)))
        rows.append(row[long])
    term = (np.concatenate(each) >> np.uint64(64 - BITS)).astype(np.int64)
    rows = np.concatenate(rows)
    if slot is not None:
        term = slot[term].astype(np.int64)
        rows, term = rows[term > 0], term[term > 0]
    pair = np.unique((rows << BITS) | term)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    chosen: np.ndarray  # the hashed terms that have weights
    w0: float
    w: np.ndarray  # (1 + terms), the first unused
    v: np.ndarray  # (1 + terms, factors)
    pw: Powers = field(default_factory=Powers)
    slot: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"slot": None}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.slot is None:
            self.slot = np.zeros(1 << BITS, np.int32)
            self.slot[self.chosen] = np.arange(1, len(self.chosen) + 1)
        row, term = terms(data, off, self.pw, self.slot)
        return 1 / (1 + np.exp(-np.clip(machine(self.w0, self.w, self.v, row, term, len(off) - 1)[0], -30, 30)))


def machine(w0: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value for each of n rows, and their sums of factors."""
    sums = np.stack([np.bincount(row, v[term, k], n) for k in range(v.shape[1])], 1)
    squares = np.bincount(row, (v[term] ** 2).sum(1), n)
    return w0 + np.bincount(row, w[term], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def telling(df, pos, p, z: float):
    """Whether a share of label 1 differs from the mean p by `z` deviations, of numbers or of columns."""
    return (pos - df * p) ** 2 >= z * z * df * p * (1 - p)


#: Counts of pairs, and cells of documents and terms, that a task holds at a time.
PAIRS = 1 << 22


def choose_pairs(spark: SparkSession, row: np.ndarray, term: np.ndarray, y: np.ndarray, names: np.ndarray, least_df: int, z: float) -> np.ndarray:
    """Those of `names` that are in a telling pair: one in `least_df` documents whose share of label 1 differs from the mean by `z` deviations.

    Tasks count the pairs of a block of the names with all others each, over documents that have one of the block, so what a
    task holds doesn't grow with the number of names or documents, but for the documents' terms.
    """
    n, p = len(names), float(y.mean())
    width = max(1, PAIRS // n)
    column, one = np.searchsorted(names, term).astype(np.int32), y == 1
    row = row.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo in (v for batch in batches for v in batch.column(0).to_pylist()):
            own = np.unique(row[(column >= lo) & (column < lo + width)])
            both, toxic = np.zeros((2, min(width, n - lo), n), np.float32)
            for k in range(0, len(own), width):
                some = own[k : k + width]
                place = np.searchsorted(some, row)
                at = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == row)
                has = np.zeros((len(some), n), np.float32)
                has[place[at], column[at]] = 1
                both += has[:, lo : lo + width].T @ has
                toxic += has[one[some], lo : lo + width].T @ has[one[some]]
            far = (both >= least_df) & telling(both, toxic, p, z)
            far[np.arange(len(far)), lo + np.arange(len(far))] = False  # a term with itself
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(far.any(0)))], names=["told"])

    blocks = spark.range(0, n, width, max(1, min(64, -(-n // width))))
    told = blocks.mapInArrow(run, "told long").distinct().toArrow().column("told").to_numpy()
    return names[np.sort(told)]


def fit_machine(row: np.ndarray, term: np.ndarray, y: np.ndarray, prior: float, factors: int, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss, with soft thresholds on w and decay on v. term: slots from 1."""
    rng = np.random.default_rng(seed)
    size = int(term.max(initial=0)) + 1
    w0, w, v = float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.02, (size, factors))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, factors), 1e-8)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    start = np.searchsorted(row, np.arange(len(y) + 1))
    rate, l1, l2 = 0.3, 1e-5, 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 128):
            pick = order[lo : lo + 128]
            many = start[pick + 1] - start[pick]
            t = term[np.concatenate([np.arange(start[i], start[i + 1]) for i in pick])]
            r = np.repeat(np.arange(len(pick)), many)
            value, sums = machine(w0, w, v, r, t, len(pick))
            g = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            g0 += g.sum() ** 2
            w0 -= rate * g.sum() / np.sqrt(g0)
            used, back = np.unique(t, return_inverse=True)
            d = np.bincount(back, g[r], len(used))
            gw[used] += d * d
            step = rate / np.sqrt(gw[used])
            u = w[used] - step * d
            w[used] = np.sign(u) * np.maximum(np.abs(u) - step * l1, 0)
            each = g[r][:, None] * (sums[r] - v[t])
            dv = np.stack([np.bincount(back, each[:, k], len(used)) for k in range(factors)], 1) + l2 * v[used]
            gv[used] += dv * dv
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return w0, w, v


def fit_terms(row: np.ndarray, term: np.ndarray, y: np.ndarray, chosen: np.ndarray, prior: float, factors: int, epochs: int, seed: int) -> ToxicityModel:
    """A machine of the chosen terms."""
    slot = np.zeros(1 << BITS, np.int32)
    slot[chosen] = np.arange(1, len(chosen) + 1)
    own = slot[term].astype(np.int64)
    rows, own = row[own > 0], own[own > 0]
    again = np.lexsort((own, rows))
    w0, w, v = fit_machine(rows[again].astype(np.int64), own[again], y, prior, factors, epochs, seed)
    more = len(chosen) + 1 - len(w)
    return ToxicityModel(chosen, w0, np.r_[w, np.zeros(more)], np.r_[v, np.zeros((more, factors))])


def sets_of(every: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and labels of the sample (__id, y, t) in order of ids, and (row, term) of those of its terms that are wanted."""
    often = np.zeros(1 << BITS, bool)
    often[wanted] = True

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            flat = lists.flatten().to_numpy()
            kept, row = often[flat], np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ends = np.r_[0, np.cumsum(np.bincount(row[kept], minlength=len(lists)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept]))], names=["__id", "y", "t"])

    found = every.mapInArrow(thinned, every.schema).toArrow()
    lists, ids = found.column("t").combine_chunks(), found.column("__id").to_numpy()
    order = np.argsort(ids, kind="stable")  # so that reruns fit the same
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return ids[order], found.column("y").to_numpy().astype(float)[order], np.repeat(place, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn, per_class: int = 4000, factors: int = 4, least_df: int = 3, z: float = 3.5, epochs: int = 12, seed: int = 11, least_pair: int = 8, pair_share: float = 0.02, pair_z: float = 6.0
) -> ToxicityModel:
    """Learns from at most `per_class` documents of either label that satisfy `learn`.

    Their terms stay in a table; the driver gets those that tell something alone (in `least_df` documents, by `z`
    deviations), then, to search for pairs, those that are in `least_pair` of the misjudged documents of one label and in
    `pair_share` of them. Pairs are telling by `pair_z` deviations over the whole sample. The share of label 1
    among all of `labels` that satisfy `learn` is the prior of the scores.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", learn, per_class, seed)
    pw = Powers()

    def sets(d: np.ndarray, o: np.ndarray) -> list:
        row, term = terms(d, o, pw)
        return [np.split(term.astype(np.int32), np.searchsorted(row, np.arange(1, len(o) - 1)))]

    every = scratch.cut(map_text(sample, ["__id", "y"], "text", sets, [T.StructField("t", T.ArrayType(T.IntegerType()))]))
    n = {r["y"]: r["count"] for r in every.groupBy("y").count().collect()}
    if len(n) < 2:
        return ToxicityModel(np.zeros(0, np.int64), 0.0, np.zeros(1), np.zeros((1, factors)))
    prior = min(max(labels.where(learn & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0], 1e-3), 1 - 1e-3)
    counted = every.select("y", F.explode("t").alias("t")).groupBy("t").agg(F.count("*").cast("double").alias("df"), F.sum("y").alias("pos"))
    alone = counted.where((F.col("df") >= least_df) & telling(F.col("df"), F.col("pos"), n[1] / (n[0] + n[1]), z))
    chosen = np.sort(alone.select("t").toArrow().column("t").to_numpy().astype(np.int64))
    ids, y, row, term = sets_of(every, chosen)
    model = fit_terms(row, term, y, chosen, prior, factors, epochs, seed)
    missed = (y == 1) != (machine(model.w0, model.w, model.v, row, np.searchsorted(chosen, term) + 1, len(y))[0] > 0)
    if missed.any():
        lost = spark.createDataFrame([(i.item() if isinstance(i, np.generic) else i,) for i in ids[missed]], T.StructType([every.schema["__id"]]))
        least = F.when(F.col("y") == 1, max(least_pair, pair_share * (missed & (y == 1)).sum())).otherwise(max(least_pair, pair_share * (missed & (y == 0)).sum()))
        common = every.join(F.broadcast(lost), "__id").select("y", F.explode("t").alias("t")).groupBy("y", "t").count().where(F.col("count") >= least)
        names = np.unique(common.select("t").toArrow().column("t").to_numpy().astype(np.int64))
        more = np.union1d(chosen, choose_pairs(spark, *sets_of(every, names)[2:], y, names, least_pair, pair_z)) if len(names) else chosen
        if len(more) > len(chosen):
            _, _, row, term = sets_of(every, more)
            model = fit_terms(row, term, y, more, prior, factors, epochs, seed)
    scratch.keep()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 of every whole text."""
    return map_text(docs, [id_col], text, lambda d, o: [model.score(d, o)], [T.StructField("score", T.DoubleType())])


def filter_toxicity(docs: DataFrame, model: ToxicityModel, below: float = 0.7, text: str = "text") -> DataFrame:
    """The documents whose score is less than `below`, with all their columns."""
    return filter_text(docs, text, lambda d, o: model.score(d, o) < below)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    scored = score_toxicity(docs, fit_toxicity(docs, labels, ~held_out(key, 3, 1)))
    return scored.select("doc_id", held_out(key, 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
