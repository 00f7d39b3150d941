"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of the test items.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lowered. A window is `window` consecutive words
of an item, or all words of an item that has fewer. The automaton holds every window with a blank at
either end; one pass over a document's normalised text finds all occurrences, whose words are mapped
back to code points of the original.

Windows are made and brought together on Spark, each once with the ids of all items that hold it. What the driver
and a task hold is one automaton that takes about `most_bytes` of memory. A benchmark within that, as nearly
all are, is one automaton. A larger one is dealt by the windows' hashes into parts of that size, which pass
over the texts one after another; the hits of all parts are joined by text, so none is dropped.

Null texts and texts without words have no hits. Items without words have no windows. Items with a null id
are one more item: their words are hit and they count, but they have no id to list. Of repeated rows each gets
its own result; repeated item ids count once. Other columns aren't read, those of `remove_leaks` stay as they
are. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, filter_text, map_text

WINDOW = 10
#: Bytes of memory of one automaton, and about how many a byte of a window takes in it.
MOST_BYTES, NODE = 1 << 27, 40
#: Every byte to its lowered word byte or, between words, a blank.
NORMAL = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ITEMS = T.StructField("items", T.ArrayType(T.StringType()))


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(NORMAL).split())


class Automaton:
    """The windows of some items; built anew where it is unpickled."""

    def __init__(self, windows: dict[str, list[str | None]]) -> None:
        self.windows = windows  # " w1 ... wn " to the ids of its items
        self.machine = None

    def __reduce__(self):
        return (type(self), (self.windows,))

    def occurrences(self, text: str) -> Iterator[tuple[int, str]]:
        """(last position, window) of every occurrence in a normalised text with a blank at either end."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for w in self.windows:
                self.machine.add_word(w, w)
            self.machine.make_automaton()
        return self.machine.iter(text) if self.windows else iter(())


def windows_of(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(w, items): each window once, with the sorted ids of its items, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised(t.encode()).decode().split(" ")
                last = max(1, len(words) - window + 1) if words[0] else 0
                for lo in range(0, last, 4096):
                    made = [f" {' '.join(words[k : k + window])} " for k in range(lo, min(lo + 4096, last))]
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([name] * len(made), pa.string())], names=["w", "item"])

    known = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    found = known.mapInArrow(run, "w string, item string").groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("none"))
    return found.select("w", F.when(F.col("none"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.col("items")).alias("items"))


def automata(windows: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[Automaton]:
    """The automaton of all windows or, where they pass `most_bytes`, one of each part of them, one at a time."""
    size = F.octet_length("w") * NODE + 64 + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    parts = -(-(windows.agg(F.sum(size)).first()[0] or 0) // most_bytes)
    for k in range(max(1, parts)):
        own = windows.where(F.pmod(F.xxhash64("w"), F.lit(max(1, parts))) == k).toArrow()
        yield Automaton(dict(zip(own.column("w").to_pylist(), own.column("items").to_pylist(), strict=True)))


def hits(machine: Automaton, text: bytes) -> tuple[int, np.ndarray, set[str | None]]:
    """Number of words, the numbers of hit words in order, and the ids of the items found."""
    norm = normalised(text)
    if not norm:
        return 0, np.zeros(0, np.int64), set()
    padded = f" {norm.decode('utf-8', 'replace')} "
    n = norm.count(b" ") + 1
    found = list(machine.occurrences(padded))
    if not found:
        return n, np.zeros(0, np.int64), set()
    blank = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
    inside = np.zeros(n + 1, np.int64)
    for end, w in found:
        last = int(np.searchsorted(blank, end))  # words before the closing blank
        inside[last - (w.count(" ") - 1)] += 1
        inside[last] -= 1
    return n, np.flatnonzero(np.cumsum(inside[:-1]) > 0), {i for w in {w for _, w in found} for i in machine.windows[w]}


def listed(items: set[str | None]) -> list[str | None]:
    return sorted(i for i in items if i is not None) + [None] * (None in items)


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code-point spans of runs of hit words in the original text."""
    if not len(hit):
        return []
    b = np.frombuffer(text.translate(NORMAL), np.uint8)
    word = np.r_[False, b != 32, False]
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    point = np.cumsum(np.r_[0, (np.frombuffer(text, np.uint8) & 0xC0) != 0x80])
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [{"start": int(point[start[a]]), "end": int(point[end[z]])} for a, z in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]


def rows_of(data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
    for a, z in zip(off[:-1], off[1:], strict=True):
        yield data[a:z].tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every document: item ids sorted as strings, spans in the original text."""
    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]
    spans = T.StructField("spans", T.ArrayType(SPAN))
    windows = Scratch(docs.sparkSession).cut(windows_of(benchmark, window))
    machines = automata(windows, most_bytes)
    first, second = next(machines), next(machines, None)
    if second is None:

        def whole(data: np.ndarray, off: np.ndarray) -> list:
            rows = []
            for t in rows_of(data, off):
                n, hit, items = hits(first, t)
                rows.append((n, len(hit), listed(items), original_spans(t, hit)))
            return list(zip(*rows, strict=True))

        return map_text(docs, [id_col], text, whole, [*counts, ITEMS, spans])

    # Each text once, by its digest; each part's pass gives the hit words and items of those with hits.
    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("th"), F.col(text).alias("text"))
    passes = []
    for machine in (first, second, *machines):

        def part(data: np.ndarray, off: np.ndarray, machine: Automaton = machine) -> list:
            rows = [hits(machine, t)[1:] for t in rows_of(data, off)]
            return [[hit.tolist() for hit, _ in rows], [listed(items) for _, items in rows]]

        made = map_text(texts, ["th"], "text", part, [T.StructField("hit", T.ArrayType(T.LongType())), ITEMS]).where("size(hit) > 0").dropDuplicates(["th"])
        passes.append(Scratch(docs.sparkSession).cut(made))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("th").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # The spans of a text need its words' places again.
    own = docs.select(F.col(id_col), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("th"), F.col(text).alias("text")).join(merged, "th", "left")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                t = (row.column("text")[0].as_py() or "").encode()
                hit = np.array(sorted(row.column("hit")[0].as_py() or []), np.int64)
                norm = normalised(t)
                made = [pa.array([norm.count(b" ") + 1 if norm else 0], pa.int64()), pa.array([len(hit)], pa.int64()), pa.array([row.column("items")[0].as_py() or []], pa.list_(pa.string()))]
                at = pa.array([original_spans(t, hit)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([row.column(0), *made, at], names=[id_col, "n_words", "n_hit", "items", "spans"])

    return own.select(id_col, "text", "hit", "items").mapInArrow(placed, T.StructType([docs.schema[id_col], *counts, ITEMS, spans]))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents without any occurrence of a window, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    machines = automata(scratch.cut(windows_of(benchmark, window)), most_bytes)
    machine, kept = next(machines), docs
    while machine is not None:

        def keeps(data: np.ndarray, off: np.ndarray, machine: Automaton = machine) -> list[bool]:
            return [not len(hits(machine, t)[1]) for t in rows_of(data, off)]

        kept, machine = filter_text(kept, text, keeps), next(machines, None)
        if machine is not None:  # so that no task holds two automata
            kept = scratch.cut(kept)
    return kept


def decontaminate_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs, benchmark)
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: windows of items and of documents as word lists, joined on equality.
DECONTAMINATE_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)
), found AS (SELECT doc_id, k, n, item FROM places JOIN windows USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
leaked AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN leaked USING (doc_id)
"""
