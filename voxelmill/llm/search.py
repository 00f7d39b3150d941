"""Ranked lexical search of many items in all documents, by a threshold-seeded join.

Terms are the words of `decontaminate`: runs of ASCII letters, digits and all beyond ASCII, A-Z lowered. N documents have
terms, L of them with repeats; a document has n, tf of one term; df documents hold a term. A term weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), a document's length m = 10 + (90 n N) div L, and a document scores the sum over an
item's terms of w * ((10**9 tf) div (1000 tf + 8 m)), in 64-bit integers.

1. One pass over the texts leaves a row a document: n, and tf of the terms that some item has (`forward`).
2. Of each term are counted df and its `k` largest quotients. They are kept in tasks, then by a ranked window: the largest bounds
   what the term can add, the k-th times w is a score that k documents reach, so it bounds the k-th score of every item
   with the term from below. The largest of these seeds an item's threshold.
3. An item's terms go by their bounds. Those whose bounds together stay below the threshold are pruned: a document with no other term
   of the item can't be among its k. Documents with one meet the item; those whose score of the terms left and the pruned
   bounds together reach the threshold are candidates, and only these are scored exactly by all terms. Within a task the
   threshold rises with the k-th best score so far. Tasks give k rows an item, a ranked window the k of all.

What tasks hold is a part of the items of about `most_pairs` pairs of item and term; more items are more parts, each of
which passes over all documents, so none is dropped. An item's terms are not split.

Texts are read whole, long ones piece by piece. Null texts and those without terms are no documents and are no item's; items without terms have
no rows. Rows of one item id are one item with all their terms; null is an id. Repeated documents are ranked each on its own.
Equal scores go by ascending document id, null last; ids are integers or strings. Scores of 0 don't count. Other columns aren't
read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, map_text, quoted
from .decontaminate import NORMAL
from .words import pieces

#: Pairs of item and term that tasks hold at a time, and scores of documents and items.
MOST_PAIRS, SCORES = 1 << 17, 1 << 21
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COUNTS = [T.StructField("n", T.LongType()), T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))]


def terms_of(data: np.ndarray) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    for a, z in pieces(data):
        yield data[a:z].tobytes().translate(NORMAL).split()


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term) of all items, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(1)):
                for words in terms_of(np.frombuffer(t.as_py().encode(), np.uint8)):
                    found = [w.decode("utf-8", "replace") for w in dict.fromkeys(words)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(found)), pa.array(found, pa.string())], names=["item", "term"])

    schema = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("term", T.StringType())])
    return items.select(quoted(item).alias("item"), quoted(text).alias("text")).where("text is not null").mapInArrow(run, schema).distinct()


def forward(docs: DataFrame, terms: list[str], id_col: str, text: str) -> DataFrame:
    """(id, n, t, tf) of documents with terms: how many it has, and numbers and frequencies of those that are asked for."""
    numbers = {t.encode(): k for k, t in enumerate(terms)}

    def kernel(data: np.ndarray, off: np.ndarray) -> list:
        rows = []
        for a, z in zip(off[:-1], off[1:], strict=True):
            n, found = 0, []
            for words in terms_of(data[a:z]):
                n += len(words)
                found.append(np.array([t for t in map(numbers.get, words) if t is not None], np.int32))
            rows.append((n, *np.unique(np.concatenate(found or [np.zeros(0, np.int32)]), return_counts=True)))
        return list(zip(*rows, strict=True))

    return map_text(docs, [id_col], text, kernel, COUNTS).where("n > 0").select(quoted(id_col).alias("id"), "n", "t", "tf")


def quotients(batch: pa.RecordBatch, documents: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and quotient of every posting of a batch of `forward`."""
    at = batch.column("t").offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    t, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("t", "tf"))
    m = 10 + 90 * batch.column("n").to_numpy() * documents // words
    return row, t, 1_000_000_000 * tf // (1000 * tf + 8 * m[row])


def best(key: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key in the given order, the major key first, grouped by key."""
    at = np.lexsort((*reversed(order), key))
    own = key[at]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return at[np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k]


def bounds(rows: DataFrame, documents: int, words: int, n_terms: int, k: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """df, largest and k-th largest quotient (0 if fewer) of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, t, g = np.zeros(n_terms, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, own, q = quotients(batch, documents, words)
            df += np.bincount(own, minlength=n_terms)
            t, g = np.r_[t, own], np.r_[g, q]
            kept = best(t, -g, k=k)
            t, g = t[kept], g[kept]
        lead = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(g), pa.array(np.where(lead, df[t], 0))], names=["t", "g", "df"])

    parts = scratch.cut(rows.mapInArrow(run, "t long, g long, df long"))
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("t").orderBy(F.desc("g")))).where(F.col("r") <= k)
    found = ranked.groupBy("t").agg(F.max("g").alias("top"), F.max(F.when(F.col("r") == k, F.col("g"))).alias("kth")).join(parts.groupBy("t").agg(F.sum("df").alias("df")), "t").toArrow()
    df, top, kth = np.zeros((3, n_terms), np.int64)
    at = found.column("t").to_numpy()
    df[at], top[at], kth[at] = (found.column(c).fill_null(0).to_numpy() for c in ("df", "top", "kth"))
    return df, top, kth


class Plan:
    """Which terms of which items find documents, and what the others can add."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, top: np.ndarray, kth: np.ndarray) -> None:
        at = np.lexsort((term, (weight * top)[term], item))
        item, term = item[at], term[at]
        bound = (weight * top)[term]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        self.weight, self.items = weight, len(first)
        self.threshold = np.maximum.reduceat((weight * kth)[term], first)
        upto = np.cumsum(bound)
        upto -= np.repeat(upto[first] - bound[first], np.diff(np.r_[first, len(item)]))
        pruned = upto < self.threshold[item]
        self.slack = np.bincount(item, np.where(pruned, bound, 0), self.items).astype(np.int64)
        self.finding, self.adding = (self.by_term(item[x], term[x], len(weight)) for x in (~pruned, pruned))

    @staticmethod
    def by_term(item: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(term, kind="stable")
        return np.r_[0, np.cumsum(np.bincount(term, minlength=n))], item[at]


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(item, rank, id, score) of each item's k highest-scoring documents."""
    scratch = Scratch(docs.sparkSession)
    pairs = scratch.cut(item_terms(items, item, item_text))
    parts = max(1, -(-pairs.count() // most_pairs))
    found = None
    for part in range(parts):
        own = ranked_part(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow(), k, id_col, text, pairs.schema["item"].dataType)
        found = own if found is None else found.unionByName(own)
    scratch.drop(pairs)
    return found.select(F.col("item").alias(item), "rank", F.col("id").alias(id_col), "score")


def ranked_part(docs: DataFrame, pairs: pa.Table, k: int, id_col: str, text: str, item_type: T.DataType) -> DataFrame:
    """(item, rank, id, score) of the items of one part."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType | T.StringType):
        raise TypeError("ids are integers or strings")
    schema = T.StructType([T.StructField("item", item_type), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    if not pairs.num_rows:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    scratch = Scratch(spark)
    terms = pairs.column("term").combine_chunks().dictionary_encode()
    names = pairs.column("item").combine_chunks().dictionary_encode("encode")
    rows = scratch.cut(forward(docs, terms.dictionary.to_pylist(), id_col, text))
    documents, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, top, kth = bounds(rows, documents, words, len(terms.dictionary), k, scratch)
    weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    plan = Plan(names.indices.to_numpy(), terms.indices.to_numpy(), weight, top, kth)
    found = scratch.cut(rows.mapInArrow(ranker(plan, names.dictionary, documents, words, k, schema), schema))
    scratch.keep(found)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranker(plan: Plan, names: pa.Array, documents: int, words: int, k: int, schema: T.StructType):
    """A task's work on rows of `forward`: the k best documents of each item among them."""
    id_type = to_arrow_type(schema["id"].dataType)

    def add(score: np.ndarray, row: np.ndarray, t: np.ndarray, value: np.ndarray, by_term: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds the postings' values (grouped by term) to the items of their terms."""
        start, own = by_term
        cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else []
        for a, z in zip(cuts, np.r_[cuts[1:], len(t)].astype(np.int64) if len(t) else [], strict=True):
            at = own[start[t[a]] : start[t[a] + 1]]
            if len(at):
                score[row[a:z, None], at] += value[a:z, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = plan.threshold.copy()
        # The best so far: item, score, whether the id is null, and the id.
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64 if pa.types.is_integer(id_type) else object))
        size = max(1, SCORES // plan.items)
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                row, t, g = quotients(part, documents, words)
                order = np.argsort(t, kind="stable")
                row, t, value = row[order], t[order], (plan.weight[t] * g)[order]
                score = np.zeros((part.num_rows, plan.items), np.int64)
                add(score, row, t, value, plan.finding)
                candidate = (score > 0) & (score + plan.slack >= need)
                there = candidate.any(axis=1)
                score = score[there]  # only candidates' rows are scored by all terms
                of = there[row]
                add(score, (np.cumsum(there) - 1)[row[of]], t[of], value[of], plan.adding)
                at, item = np.nonzero(candidate[there] & (score >= need))
                if not len(at):
                    continue
                ids = part.column("id").take(pa.array(np.flatnonzero(there)[at]))
                none = ids.is_null().to_numpy(zero_copy_only=False)
                plain = ids.cast(pa.int64()).fill_null(0).to_numpy() if held[3].dtype == np.int64 else np.array(ids.fill_null("").to_pylist(), object)
                every = [np.concatenate(c) for c in zip(held, (item, score[at, item], none, plain), strict=True)]
                by_id = every[3] if every[3].dtype == np.int64 else np.unique(every[3], return_inverse=True)[1]
                kept = best(every[0], -every[1], every[2], by_id, k=k)
                held = tuple(c[kept] for c in every)
                last = np.r_[held[0][1:] != held[0][:-1], True] & (np.bincount(held[0], minlength=plan.items)[held[0]] == k)
                need[held[0][last]] = np.maximum(need[held[0][last]], held[1][last])
        ids = pa.array([None if n else x for n, x in zip(held[2], held[3].tolist(), strict=True)], id_type)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(held[0])), ids, pa.array(held[1])], names=schema.names)

    return run


def search_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark).select("item_id", "rank", "doc_id", "score")


#: DuckDB: all postings of the items' terms, scored and ranked.
SEARCH_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents
), sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
every AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM postings, every GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), every GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
