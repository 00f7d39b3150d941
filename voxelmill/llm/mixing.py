"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 1, 2, 3 and again; together they take a share of the words
of all sources. A source's target stops at `most` times its words and what is over goes to the others by
weight, until none is above. Every document of a source has the same expected number of copies, target
over size. Documents are laid end to end, by size, their expected copies are summed up from a random
offset of the source, and a document is emitted once for each integer that its stretch crosses: so it
has the expected number rounded down or up, and a source's words come near its target.

Sums run over cells of a source (its size class, split at random into about the root of its number of
documents), so neither a source nor a size is ever sorted in one task; offsets and order come from
hashes of a seed, so reruns agree.

Null texts and those without words have size 0 and are laid out as the others. Repeated rows are
documents of their own, in an order that doesn't matter as they are equal (but for maps, which have no hash, in
rows that differ in them only). Columns may have any name and type; all stay as they are. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hashable, quoted

MOST = 3.0
#: Sources whose plan is broadcast; that of more meets the documents by a shuffle.
MANY = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], share: float = 1.0, most: float = MOST) -> dict[str | None, float]:
    """The words that each source shall give, from the sources' sizes."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: 1 + k % 3 for k, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * size[s]}
        for s in over or free:
            out[s] = most * size[s] if over else unit * weight[s]
            left -= out[s]
        free = free - over if over else set()
    return out


def lay_out(rows: DataFrame, share: float, most: float, seed: int) -> DataFrame:
    """`rows` (source, size, order, ...) with source_size, target and copies.

    What comes to the driver is one row for each source, as the weights go round by the sources' order; it goes to all tasks if that is at most MANY rows.
    """
    rows = rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")), "class": F.floor(4 * F.log2(F.col("size") + 1)).cast("int")})
    by_source = rows.groupBy(F.col("source").cast("string").alias("s"), "key").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    goal = targets([(r["s"], r["n"]) for r in by_source], share, most)
    plan = rows.sparkSession.createDataFrame(
        [(r["key"], r["n"], r["docs"], float(goal[r["s"]]), goal[r["s"]] / r["n"] if r["n"] else 0.0) for r in by_source],
        "key string, source_size long, docs long, target double, rate double",
    )
    rows = rows.join(F.broadcast(plan) if len(by_source) <= MANY else plan, "key").withColumn("salt", F.pmod(F.shiftright("order", 20), F.ceil(F.sqrt("docs") / 8)))
    cell = ["key", "class", "salt"]
    before = F.sum("n").over(W.partitionBy("key").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(*cell).orderBy("size", "order"))).join(cells, cell)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rank = F.col("before") + F.col("place")
    crossed = F.floor(F.col("rate") * rank + offset) - F.floor(F.col("rate") * (rank - 1) + offset)
    return ranked.withColumn("copies", F.least(F.greatest(crossed, F.lit(0)), F.ceil("rate")).cast("long"))


def sized(docs: DataFrame, source: str, text: str, seed: int) -> list[Column]:
    """Source, size and order of rows; the order is of all columns that Spark can hash."""
    return [quoted(source).alias("source"), F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), *hashable(docs)).alias("order")]


def mix_plan(docs: DataFrame, keep: list[str], share: float = 1.0, most: float = MOST, source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """(keep, source, size, source_size, target, copies) of every document; texts are read once and not moved."""
    slim = docs.select(F.struct(*[quoted(c) for c in keep]).alias("kept"), *sized(docs.select(*[quoted(c) for c in keep], quoted(source)), source, text, seed))
    return lay_out(cut(slim), share, most, seed).select("kept.*", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, share: float = 1.0, most: float = MOST, source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as it is taken."""
    named = docs.select(F.struct("*").alias("row"), *sized(docs, source, text, seed))
    taken = lay_out(cut(named), share, most, seed).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixing_query(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs, ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
