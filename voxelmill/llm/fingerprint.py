"""Document fingerprints by locally consistent parsing.

Level by level a text is cut into phrases: runs of equal symbols are one symbol, deterministic coin
tossing gives neighbours small different labels, and a phrase starts wherever a label is smaller than
both its neighbours. A phrase's name is a hash of its symbols, and the names are the next level's text.
Where a phrase starts depends on a few symbols around it only, so equal substrings have the same names
inside, whatever their offset. The fingerprint is the `SIZE` smallest hashes of the names of levels
`FIRST` to `LAST`, and the likeness of two fingerprints is the estimate of the Jaccard similarity of
their sets of names, exact where both are smaller.

Null texts are empty; the fingerprint of an empty text is empty and its likeness is 1 to an empty one and
0 to others. Equal texts have equal fingerprints. Ids are integers or strings, which sort by code points; null ids come
first, rows of one id go by a hash of their texts, then by them, and equal rows follow each other. Only the id and
the text are read, so other columns may have any name. An empty table gives an empty result, an only
document is its own next one. Texts longer than BLOCK are parsed piece by piece with what the next piece needs to know, which
gives the same names, so a text of any length takes its own bytes and those of parsing one piece.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_text, quoted
from .words import Powers, mix, span_hash

FIRST, LAST, SIZE = 2, 6, 64
#: Rounds of coin tossing that bring any 64-bit symbols down to labels below 6.
TOSSES = 4
#: Symbols before a phrase's start that later labels depend on: one for each round, and the left neighbour.
CONTEXT = TOSSES + 1
#: Code points that are parsed at a time.
BLOCK = 1 << 18


def toss(label: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from the one before it, plus that bit; at starts, its bit 0."""
    before = np.empty_like(label)
    before[1:] = label[:-1]
    before[start] = label[start] ^ np.uint64(1)
    differ = label ^ before
    place = np.minimum(np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)), 63).astype(np.uint64)
    return (place << np.uint64(1)) | ((label >> place) & np.uint64(1))


def named(symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs as symbols: one alone is itself, a longer run a hash of symbol and length."""
    s = symbol.copy()
    long = length > 1
    s[long] = mix(s[long] + length[long] * np.uint64(0xD6E8FEB86659FD93))
    return s


def minima(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a symbol's label is below both its neighbours'; never at the first and the last symbol."""
    label = s
    for _ in range(TOSSES):
        label = toss(label, start)
    label = label.astype(np.uint8)
    low = np.zeros(len(s), bool)
    low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    return low


def names(s: np.ndarray, at: np.ndarray, end: np.ndarray, pw: Powers) -> np.ndarray:
    """Hashes of the symbols from each of `at` to its `end`, wherever they stand."""
    up, _ = pw.get(len(s) + 1)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s) * up[: len(s)], out=sums[1:])
    return span_hash(sums, at, end, pw)


def parse(symbol: np.ndarray, first: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of texts end to end, and each text's first phrase. first: each text's first symbol."""
    begin = np.ones(len(symbol), bool)
    begin[1:] = symbol[1:] != symbol[:-1]
    begin[first] = True
    run = np.flatnonzero(begin)
    s = named(symbol[run], np.diff(np.append(run, len(symbol))).astype(np.uint64))
    start = np.searchsorted(run, first)
    low = minima(s, start)
    low[start[1:] - 1] = False  # a text's last symbol has no right neighbour
    low[start] = True
    at = np.flatnonzero(low)
    return names(s, at, np.append(at[1:], len(s)), pw), np.searchsorted(at, start)


class Level:
    """A level of one text that comes in pieces; the names are those that `parse` gives of the whole text.

    What waits for the next piece is the run that may go on, and from the last phrase's start on the symbols
    with those CONTEXT before it that the labels after it depend on. Phrases have less than a dozen symbols.
    """

    def __init__(self, pw: Powers) -> None:
        self.pw = pw
        self.value = self.length = self.s = np.zeros(0, np.uint64)
        self.at = 0

    def feed(self, symbol: np.ndarray, last: bool = False) -> np.ndarray:
        """Names of the phrases that end in this piece, or with `last` of all that are left."""
        begin = np.ones(len(symbol), bool)
        begin[1:] = symbol[1:] != symbol[:-1]
        run = np.flatnonzero(begin)
        value, length = symbol[run], np.diff(np.append(run, len(symbol))).astype(np.uint64)
        if len(value) and len(self.value) and value[0] == self.value[0]:
            length[0] += self.length[0]
        else:
            value, length = np.concatenate([self.value, value]), np.concatenate([self.length, length])
        done = len(value) if last else max(0, len(value) - 1)
        self.value, self.length = value[done:], length[done:]
        s = np.concatenate([self.s, named(value[:done], length[:done])])
        if not len(s):
            return s
        low = minima(s, np.zeros(1, np.int64))
        low[: self.at] = False
        low[self.at] = True
        at = np.flatnonzero(low)
        edge = np.append(at, len(s)) if last else at
        keep = max(0, int(at[-1]) - CONTEXT)
        self.s, self.at = s[keep:].copy(), int(at[-1]) - keep
        return names(s, edge[:-1], edge[1:], self.pw)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashes(symbol: np.ndarray, level: int) -> np.ndarray:
    """The 32 bits of each name of a level that fingerprints are made of."""
    return mix(symbol + np.uint64(level)) >> np.uint64(32)


def long_fingerprint(pieces: Iterable[str], pw: Powers) -> np.ndarray:
    """The fingerprint of one text in pieces: memory is that of a piece, whatever the text's length."""
    levels = [Level(pw) for _ in range(LAST)]
    kept = np.zeros(0, np.uint64)
    for piece in itertools.chain(pieces, [None]):
        symbol = code_points(piece or "")
        for number, level in enumerate(levels, 1):
            symbol = level.feed(symbol, last=piece is None)
            if number >= FIRST:
                kept = np.union1d(kept, hashes(symbol, number))[:SIZE]
    return kept.astype(np.uint32)


def fingerprints(texts: list[str], pw: Powers) -> list[np.ndarray]:
    """The sorted 32-bit hashes that make up each text's fingerprint; all texts are parsed at once."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    symbol = code_points("".join(texts[k] for k in full))
    first = np.r_[0, np.cumsum([len(texts[k]) for k in full])[:-1]].astype(np.int64)
    keys = []
    for level in range(1, LAST + 1):
        symbol, first = parse(symbol, first, pw)
        if level >= FIRST:
            row = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(first, len(symbol))))
            keys.append((row << np.uint64(32)) | hashes(symbol, level))
    key = np.unique(np.concatenate(keys))
    edge = np.searchsorted(key, np.arange(len(full) + 1, dtype=np.uint64) << np.uint64(32))
    for k, a, z in zip(full, edge[:-1], edge[1:], strict=True):
        out[k] = key[a : min(z, a + SIZE)].astype(np.uint32)
    return out


#: A text, or one put together, as stretches of texts: (text, how much of its start).
Starts = Sequence[tuple[str, int]]


def pieces_of(parts: Starts) -> Iterator[str]:
    for text, n in parts:
        for i in range(0, n, BLOCK):
            yield text[i : min(n, i + BLOCK)]


def prints_of(texts: Sequence[Starts], pw: Powers) -> list[np.ndarray]:
    """Fingerprints of texts made of starts: short ones in blocks, those longer than BLOCK piece by piece."""
    out: list = [None] * len(texts)
    block, size = [], 0

    def flush() -> None:
        for k, f in zip(block, fingerprints(["".join(pieces_of(texts[k])) for k in block], pw), strict=True):
            out[k] = f
        block.clear()

    for k, parts in enumerate(texts):
        n = sum(n for _, n in parts)
        if n > BLOCK:
            out[k] = long_fingerprint(pieces_of(parts), pw)
            continue
        if size + n > BLOCK:
            flush()
            size = 0
        block.append(k)
        size += n
    flush()
    return out


def sha256(parts: Starts) -> str:
    made = hashlib.sha256()
    for piece in pieces_of(parts):
        made.update(piece.encode("utf-8", "surrogatepass"))
    return made.hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the sets of names behind two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    own, other = set(a.tolist()), set(b.tolist())
    union = sorted(own | other)
    if max(len(a), len(b)) >= SIZE:
        union = union[:SIZE]
    common = own & other
    return sum(x in common for x in union) / len(union)


def shown(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text, eight hex digits for each hash."""
    pw = Powers()

    def kernel(data: np.ndarray, off: np.ndarray) -> list:
        if len(data) > BLOCK:  # one text, see `blocks`
            pieces = (data[i : i + BLOCK].tobytes() for i in range(0, len(data), BLOCK))
            return [[shown(long_fingerprint(codecs.iterdecode(pieces, "utf-8", "replace"), pw))]]
        whole = data.tobytes()
        return [[shown(f) for f in fingerprints([whole[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1], off[1:], strict=True)], pw)]]

    return map_text(docs, [id_col], text, kernel, [T.StructField("fingerprint", T.StringType())], BLOCK)


#: Sampled rows of each range that ranges are cut by.
SAMPLED = 64


def neighbours(docs: DataFrame, id_col: str, text: str, parts: int) -> DataFrame:
    """(id, text, ahead) dealt by ranges of (id, hash of the text) and sorted within them, so that each row's next one follows it.

    Each range ends with the first row of the next range, or of all rows after the last one; there
    `ahead` is true. Ranges are cut by about SAMPLED rows for each, those whose hashes are below a share; equal rows count once.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType | T.StringType):
        raise TypeError("ids are integers or strings")
    texts = isinstance(kind, T.StringType)
    none = "" if texts else -(1 << 63)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.coalesce(F.col("id"), F.lit(none)) if texts else F.coalesce(F.col("id").cast("long"), F.lit(none))
    share = min(1.0, SAMPLED * parts / max(1, docs.count()))
    picked = rows.select(key.alias("k"), "h").where(F.pmod(F.xxhash64("k", "h"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().collect() if parts > 1 else []
    at = sorted(((r["k"].encode() if texts else r["k"]), r["h"]) for r in picked)
    cuts = sorted({at[k * len(at) // parts] for k in range(1, parts)}) if at else []
    cut_ids, cut_hashes = np.array([c for c, _ in cuts], object if texts else np.int64), [h for _, h in cuts]

    @F.pandas_udf(T.IntegerType())
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = np.array([x.encode() for x in ids], object) if texts else ids.to_numpy()
        low, high = (np.searchsorted(cut_ids, own, side) for side in ("left", "right"))
        for k in np.flatnonzero(low < high):  # an id that cuts: its rows go by their hashes
            low[k] = bisect.bisect_right(cut_hashes, hashes.iloc[k], low[k], high[k])
        return pd.Series(low.astype(np.int32))

    rows = rows.withColumn("part", place(key, "h"))
    # Of each range the least id (null before others) and hash, then the least text with them: one row a range.
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "h")).alias("least"))
    heads = rows.join(F.broadcast(least), "part").where(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h")))
    heads = heads.groupBy("part").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.min("text").alias("text"))
    have = sorted(r["part"] for r in least.select("part").collect())
    before = {p: have[k - 1] for k, p in enumerate(have)}  # the first range's head follows the last range
    follows = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    heads = heads.select("id", "text", "h", follows[F.col("part")].alias("part"))
    both = rows.withColumn("ahead", F.lit(False)).unionByName(heads.withColumn("ahead", F.lit(True)))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", "id", "h", "text")


def edited_query(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the next document's start."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pw = Powers()
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of the first len(ids) texts, each followed by its next."""
        n = len(ids)
        whole = [[(t, len(t))] for t in texts]
        edited = [[(t, len(t) - len(t) // 4), (ahead, min(len(t) // 4, len(ahead)))] for t, ahead in zip(texts, texts[1:], strict=False)]
        own, new = prints_of(whole, pw), prints_of(edited, pw)
        columns = [
            ids, [len(t) for t in texts[:n]], [sha256(parts) for parts in edited], [shown(f) for f in own[:n]], [shown(f) for f in new],
            [likeness(a, b) for a, b in zip(own, new, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for key, t, ahead in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
                texts.append(t)
                size += len(t)
                if ahead or size > BLOCK:
                    if ids:
                        yield made(ids, texts)
                    ids, texts, size = ([], [], 0) if ahead else ([], [t], len(t))
                if not ahead:
                    ids.append(key)

    return neighbours(docs, id_col, text, parts).select("id", "text", "ahead").mapInArrow(run, schema)
