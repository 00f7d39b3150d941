"""Quality classifier: a byte-level convolutional network in numpy over whole documents.

Learned filters run over overlapping chunks that cover the document from its first to its last byte.
Each filter is max-pooled within a chunk; the pooled values are averaged and maximised over the chunks
of a document and a logistic layer combines them into one probability.

The filters are learned from all chunks of the labelled sample's documents, each document weighing the same
whatever its length: shards of the sample are passed over in tasks, and the driver averages the filters that
they come to after each pass. The driver gets the parameters and a few numbers a document, no text.

Nulls and empty texts are one chunk of padding and get that chunk's probability. Equal texts get equal
scores, and so do repeated rows and ids; of repeated ids in the sample the greatest text counts. Only the id
and the text are read, so other columns may have any name; filters keep all columns. An empty table gives an
empty result; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, filter_text, held_out, labelled_sample, map_text, small_batches, utf8

CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 4, 16
PAD = 256
#: Bytes of text that one call of the kernel deals with at a time.
BLOCK = 1 << 17
#: Shards that the sample is learned in, whatever the cluster; chunks of a step; chunks that are shuffled at a time.
SHARDS, STEP, HELD = 4, 64, 4096
#: Bytes of the sample that a shard has at most, about; a sample of long texts has more shards.
SHARD_BYTES = 1 << 26


@dataclass
class QualityModel:
    embed: np.ndarray  # (257, EMBED), the last row for padding
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    head: np.ndarray  # of the mean and the maximum over chunks
    head_bias: float

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, filter): the largest activation in chunks of CHUNK byte codes."""
        return np.maximum((unfold(self.embed[chunks]) @ self.filters).max(1) + self.bias, 0)

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(document, 2 * FILTERS): mean and maximum of the pooled activations over all chunks."""
        out = np.empty((len(off) - 1, 2 * FILTERS), np.float32)
        start, stop, first = chunk_spans(off)
        top = np.concatenate([self.pooled(codes_of(data, start[i : i + 512], stop[i : i + 512])) for i in range(0, len(start), 512)])
        count = np.diff(np.append(first, len(start)))[:, None]
        out[:, :FILTERS] = np.add.reduceat(top, first, axis=0) / count
        out[:, FILTERS:] = np.maximum.reduceat(top, first, axis=0)
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip((self.features(data, off).astype(float) * self.head).sum(1) + self.head_bias, -30, 30)))


def unfold(vectors: np.ndarray) -> np.ndarray:
    """(chunk, position, WIDTH * EMBED) windows of (chunk, CHUNK, EMBED) vectors."""
    n, (a, b, c) = len(vectors), vectors.strides
    steps = (CHUNK - WIDTH) // STRIDE + 1
    seen = np.lib.stride_tricks.as_strided(vectors, (n, steps, WIDTH * EMBED), (a, b * STRIDE, c))
    return np.ascontiguousarray(seen)


def chunk_spans(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all chunks of all documents the first byte and the end of the document, and each document's first chunk."""
    length, step = np.diff(off), CHUNK - OVERLAP
    count = np.maximum(1, -(-(length - OVERLAP) // step))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    doc = np.repeat(np.arange(len(length)), count)
    return off[:-1][doc] + (np.arange(len(doc)) - first[doc]) * step, off[1:][doc], first


def codes_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(chunk, CHUNK) byte codes, padded after the document's end."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < stop[:, None]
    codes = np.full(at.shape, PAD, np.int16)
    codes[inside] = data[at[inside]]
    return codes


def cropped(chunks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chunks cut to a few words: what short documents look like, of which a sample has few."""
    keep = rng.integers(14, 97, len(chunks))
    return np.where(np.arange(CHUNK) < keep[:, None], chunks, PAD).astype(chunks.dtype)


def fresh(seed: int) -> dict[str, np.ndarray]:
    """Parameters to begin with, and Adam's moments of each."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (257, EMBED)), "filters": rng.normal(0, 0.25, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return p | {f"{m}_{k}": np.zeros_like(v) for m in "mv" for k, v in p.items()}


def step(p: dict[str, np.ndarray], codes: np.ndarray, y: np.ndarray, weight: np.ndarray, t: int, rate: float) -> None:
    """One step of Adam on the logistic loss of weighted chunks."""
    n = len(y)
    windows = unfold(p["embed"][codes])
    z = windows @ p["filters"]
    where = z.argmax(1)
    top = np.take_along_axis(z, where[:, None, :], 1)[:, 0] + p["bias"]
    h = np.maximum(top, 0)
    g = ((1 / (1 + np.exp(-np.clip(h @ p["out"] + p["c"], -30, 30))) - y) * weight / n).astype(np.float32)
    dh = np.outer(g, p["out"]) * (top > 0)
    won = np.take_along_axis(windows, where[:, :, None], 1)  # (n, FILTERS, WIDTH * EMBED)
    back = (dh[:, :, None] * p["filters"].T[None]).reshape(n, FILTERS, WIDTH, EMBED)
    used = codes[np.arange(n)[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
    de = np.zeros_like(p["embed"])
    np.add.at(de, used.ravel(), back.reshape(-1, EMBED))
    for k, d in {"embed": de, "filters": np.einsum("nf,nfk->kf", dh, won), "bias": dh.sum(0), "out": h.T @ g, "c": np.array([g.sum()])}.items():
        p[f"m_{k}"] = (0.9 * p[f"m_{k}"] + 0.1 * d).astype(np.float32)
        p[f"v_{k}"] = (0.99 * p[f"v_{k}"] + 0.01 * d * d).astype(np.float32)
        p[k] = (p[k] - rate * (p[f"m_{k}"] / (1 - 0.9**t)) / (np.sqrt(p[f"v_{k}"] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def samples(batches: Iterator[pa.RecordBatch], weights: tuple[float, float], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole documents (id, y, text) and of a crop of each, with labels and weights, HELD or so at a time, shuffled."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        labels = batch.column("y").to_numpy()
        data, off = utf8(batch.column("text"))
        for i, j in blocks(off, BLOCK):
            start, stop, first = chunk_spans(off[i : j + 1])
            count = np.diff(np.append(first, len(start)))
            y, w = np.repeat(labels[i:j], count), np.repeat(1 / count, count)
            for lo in range(0, len(start), HELD):
                held.append((codes_of(data, start[lo : lo + HELD], stop[lo : lo + HELD]), y[lo : lo + HELD], w[lo : lo + HELD]))
                if sum(len(x[1]) for x in held) >= HELD:
                    yield shuffled(held, weights, rng)
                    held = []
            held.append((cropped(codes_of(data, start[first], stop[first]), rng), labels[i:j], np.full(j - i, 1 / 6)))
    if held:
        yield shuffled(held, weights, rng)


def shuffled(held: list[tuple[np.ndarray, ...]], weights: tuple[float, float], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, y, w = (np.concatenate(x) for x in zip(*held, strict=True))
    order = rng.permutation(len(y))
    return codes[order], y[order], (w * np.asarray(weights)[y])[order]


def fit_filters(sample: DataFrame, weights: tuple[float, float], epochs: int, seed: int, rate: float = 0.01) -> QualityModel:
    """Filters that tell chunks of label 1 from those of label 0.

    sample (id, y, text), dealt into shards. In each pass every shard goes on from the same parameters; those
    that they come to are averaged by their documents.
    """
    p, t = fresh(seed), 0
    for epoch in range(epochs):

        def learn(batches: Iterator[pa.RecordBatch], p: dict = p, t: int = t, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            total, own = 0.0, dict(p)
            for codes, y, w in samples(batches, weights, rng):
                total += float(w.sum())
                for lo in range(0, len(y), STEP):
                    t += 1
                    step(own, codes[lo : lo + STEP], y[lo : lo + STEP], w[lo : lo + STEP], t, rate * (1 - epoch / epochs))
            flat = np.concatenate([v.ravel() for v in own.values()]) if total else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([t], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], names=["total", "t", "p"])

        rows = [r for r in sample.mapInArrow(learn, "total double, t long, p array<float>").collect() if r["total"]]
        rows.sort(key=lambda r: (r["total"], r["p"][:8]))  # so that sums don't depend on who is first
        mean, t = np.average([r["p"] for r in rows], axis=0, weights=[r["total"] for r in rows]).astype(np.float32), max(r["t"] for r in rows)
        edge = np.cumsum([0] + [v.size for v in p.values()])
        p = {k: mean[a:z].reshape(v.shape) for (k, v), a, z in zip(p.items(), edge[:-1], edge[1:], strict=True)}
    return QualityModel(p["embed"], p["filters"], p["bias"], np.zeros(2 * FILTERS), 0.0)


def fit_head(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A logistic layer over standardised features, by Newton's method."""
    mean, dev = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(min(steps, 25)):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (q * (1 - q))[:, None]).T @ z / len(z) + decay * np.eye(len(w))
        w -= np.linalg.solve(hess, z.T @ (q - y) / len(z) + decay * w)
    return w[:-1] / dev, float(w[-1] - (w[:-1] / dev) @ mean)


def fit_quality(docs: DataFrame, labels: DataFrame, learn, per_class: int = 2500, epochs: int = 10, seed: int = 7) -> QualityModel:
    """Learns from all of at most `per_class` documents of either label that satisfy `learn`.

    The driver gets the parameters and 3 * FILTERS numbers of each of those documents, whatever their length.
    """
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    table = scratch.cut(labelled_sample(docs, labels, "quality", learn, per_class, seed))
    size = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - OVERLAP) / (CHUNK - OVERLAP)))
    known = {r["y"]: r for r in table.groupBy("y").agg(F.count("*").alias("docs"), F.sum(size + 1).alias("chunks"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if len(known) < 2:
        return QualityModel(np.zeros((257, EMBED), np.float32), np.zeros((WIDTH * EMBED, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)
    docs_of, chunks = [known[c]["docs"] for c in (0, 1)], known[0]["chunks"] + known[1]["chunks"]
    # Either label weighs half, and a chunk one on average.
    weights = tuple(0.5 * chunks / n / (1 + 1 / 6) for n in docs_of)
    parts = max(SHARDS, -(-sum(r["bytes"] for r in known.values()) // SHARD_BYTES))
    shards = table.repartition(parts, "__id").sortWithinPartitions("__id").persist(StorageLevel.DISK_ONLY)
    model = fit_filters(shards, weights, epochs, seed)

    def wide(data: np.ndarray, off: np.ndarray) -> list:
        start, stop, first = chunk_spans(off)
        short = cropped(codes_of(data, start[first], stop[first]), np.random.default_rng([seed, len(data)]))
        return [model.features(data, off).tolist(), model.pooled(short).tolist()]

    numbers = T.ArrayType(T.FloatType())
    rows = sorted(map_text(shards, ["__id", "y"], "text", wide, [T.StructField("x", numbers), T.StructField("short", numbers)], BLOCK).collect(), key=lambda r: r["__id"])
    shards.unpersist()
    scratch.keep()
    x = np.array([r["x"] for r in rows] + [r["short"] * 2 for r in rows], float)
    model.head, model.head_bias = fit_head(x, np.array([r["y"] for r in rows] * 2, float))
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 of every whole text."""
    return map_text(docs, [id_col], text, lambda d, o: [model.score(d, o)], [T.StructField("score", T.DoubleType())], BLOCK)


def filter_quality(docs: DataFrame, model: QualityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score is `least` or more, with all their columns."""
    return filter_text(docs, text, lambda d, o: model.score(d, o) >= least, BLOCK)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    scored = score_quality(docs, fit_quality(docs, labels, ~held_out(key, 5, 0)))
    return scored.select("doc_id", held_out(key, 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
