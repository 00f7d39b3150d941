"""Merkle manifest of a dataset: a hash of every row, a tree over the rows of each group, a tree over the groups.

H is lowercase hex SHA-256 of its inputs end to end, digests as hex text. A leaf is H of a row's fields, each
`-` if null, else its UTF-8 byte count, `:` and its value. Of each group the leaves ascend by the order column;
while there are several nodes, every `fanout` consecutive ones become one. What remains is the group's subroot, and
the subroots, null group first and then bytewise, give the root in the same way.

Levels are DataFrames: rows are ranged over tasks by group and order, numbered by `row_number` in each range
plus the rows of ranges before, floor-divided by the fanout, and grouped into sorted arrays of children. So no group
meets in one task, whatever its share of the rows. Then joins go down from the root, level by level: each takes the
siblings of a node and appends what its parent has, so of all rows one join only moves what leaves need. A row's `path`
is that: what stands left and right of its node on every level; `fold` goes up from any leaf.

Null fields count as `-`. Rows whose order column is null come first; rows with the same order go by their
leaves, and equal rows are equal leaves. A lone row is its own subroot, a lone group's subroot the root. Texts are
hashed whole. Other columns aren't read, so they may have any name. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, quoted

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """H of a row's fields; lengths before the values keep fields apart."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof(path: Column) -> Column:
    """H of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def indexed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` (key, at, hash, ...) with i, the place of each row among its key's, and n, how many the key has.

    Rows are ranged by all three, so a key's rows lie in consecutive ranges; what a range must add is the count of
    the key's rows in ranges before it. Keys meet in one task as one row a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.cut(rows.repartitionByRange(parts, "key", "at", "hash").withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("key")
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("key", "part", before.alias("before"), F.sum("c").over(own).alias("n"))
    place = F.row_number().over(W.partitionBy("key", "part").orderBy("at", "hash"))
    made = ranged.withColumn("place", place).join(counts, ["key", "part"]).withColumn("i", F.col("before") + F.col("place") - 1)
    out = scratch.cut(made.drop("part", "place", "before", "at"))
    scratch.drop(ranged)
    return out


def levels(nodes: DataFrame, fanout: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """The groups of children (key, p, kids, hash) of each level, and the nodes of each that are alone and so tops of their trees."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, groups = [nodes.where("n = 1")], []
    while most > 1:
        payload = [c for c in nodes.columns if c not in ("key", "n", "i")]
        made = nodes.where("n > 1").groupBy("key", "n", F.floor(F.col("i") / fanout).cast("long").alias("p"))
        made = made.agg(F.sort_array(F.collect_list(F.struct("i", *payload))).alias("kids"))
        groups.append(scratch.cut(made.withColumn("hash", digest(F.array_join("kids.hash", "")))))
        nodes = groups[-1].select("key", F.ceil(F.col("n") / fanout).alias("n"), F.col("p").alias("i"), "hash")
        tops.append(nodes.where("n = 1"))
        most = -(-most // fanout)
    return groups, tops


def descend(groups: list[DataFrame], tops: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The nodes of the lowest level with path, subroot and root.

    above: (key, path, subroot, root) of each key's top; without it tops are the root themselves.
    """

    def of_top(top: DataFrame) -> DataFrame:
        if above is None:
            return top.withColumns({"path": F.expr(EMPTY_PATH), "subroot": F.col("hash"), "root": F.col("hash")}).drop("n")
        return top.drop("n").join(above, "key")

    at = of_top(tops[-1])
    for made, top in zip(reversed(groups), reversed(tops[:-1]), strict=True):
        parent = at.select("key", F.col("i").alias("p"), "path", "subroot", "root")
        each = made.drop("n", "hash").join(parent, ["key", "p"]).select("*", F.posexplode("kids").alias("j", "kid"))
        step = F.struct(F.array_join(F.slice("kids.hash", F.lit(1), F.col("j")), "").alias("left"), F.array_join(F.slice("kids.hash", F.col("j") + 2, F.size("kids")), "").alias("right"))
        below = each.select("key", "kid.*", F.concat(F.array(step), "path").alias("path"), "subroot", "root")
        at = below.unionByName(of_top(top))
    return at


def dataset_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT, carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(order, leaf, path, subroot, root) of every row, and what `carry` makes of its columns."""
    scratch = Scratch(docs.sparkSession)
    # Null groups sort before all others, also before the empty string.
    key = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    extra = {f"carried{k}": c for k, c in enumerate((carry or {}).values())}
    own = docs.select(key.alias("key"), quoted(order).alias("at"), leaf_of([quoted(f) for f in fields]).alias("hash"), quoted(order).alias("id"), *[c.alias(n) for n, c in extra.items()])
    hashed = scratch.cut(own)  # ranging reads its rows twice; texts are read once
    leaves = indexed(hashed, scratch)
    scratch.drop(hashed)
    groups, tops = levels(leaves, fanout, scratch)
    subroots = tops[0].select("key", "hash")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("key", "hash"))
    # The tree over the groups has one key; what ranks its nodes are the groups' own keys.
    above = indexed(subroots.select(F.lit("").alias("key"), F.col("key").alias("at"), "hash", F.col("key").alias("of")), scratch)
    of_roots = descend(*levels(above, fanout, scratch), None).select(F.col("of").alias("key"), "path", F.col("hash").alias("subroot"), "root")
    found = descend(groups, tops, scratch.cut(of_roots))
    return found.select(F.col("id").alias(order), F.col("hash").alias("leaf"), "path", "subroot", "root", *[F.col(n).alias(m) for n, m in zip(extra, carry or {}, strict=True)])


def manifest_query(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and which of them a third with lowered texts would fail."""
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = leaf_of([touched if f == "text" else F.col(f) for f in FIELDS])
    found = dataset_manifest(docs, carry={"tampered": tampered})
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("tampered")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(field_sql(text if f == "text" else f) for f in FIELDS) + ")"


#: DuckDB: both trees and the way up from every leaf as recursive tables; crc32 bit by bit.
MANIFEST_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
      lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, key, {leaf_sql("text")} AS leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN {leaf_sql("low")} ELSE {leaf_sql("text")} END AS tampered FROM docs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM leaves
), nodes(k, key, n, i, hash) AS (
  SELECT 0, key, n, i, leaf FROM placed
  UNION ALL SELECT k + 1, key, (n + {FANOUT - 1}) // {FANOUT}, i // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY k, key, n, i // {FANOUT}
), tops AS (SELECT key, k AS height, hash AS subroot, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(k, n, i, hash) AS (
  SELECT 0, n, i, subroot FROM tops
  UNION ALL SELECT k + 1, (n + {FANOUT - 1}) // {FANOUT}, i // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY k, n, i // {FANOUT}
), steps AS (
  SELECT a.k, a.key, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.k = b.k AND a.key = b.key AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT t.height + a.k, t.key, 0, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), ''), coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '')
  FROM tops t JOIN upper a ON a.i = t.i // CAST(pow({FANOUT}, a.k) AS BIGINT) JOIN upper b ON a.k = b.k AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY t.height, t.key, a.k, a.i
), climb(k, key, i, spot, proof, node) AS (
  SELECT 0, key, i, i, '', tampered FROM placed
  UNION ALL SELECT c.k + 1, c.key, c.i, c.spot // {FANOUT}, c.proof || l || r, sha256(l || node || r) FROM climb c JOIN steps s ON c.k = s.k AND c.key = s.key AND c.spot = s.i
), folded AS (SELECT key, i, max_by(proof, k) AS proof, max_by(node, k) AS node FROM climb GROUP BY key, i)
SELECT doc_id, leaf, subroot, (SELECT hash FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT hash FROM upper WHERE n = 1) AS verified
FROM placed p JOIN folded f ON p.key = f.key AND p.i = f.i JOIN tops t ON t.key = p.key
"""
