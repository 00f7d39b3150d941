"""Whole queries that SQL can't express against plain versions, row by row and without vectors, batches or shuffles."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import language, quality, queries, toxicity
from voxelmill.llm.common import held_out, read
from voxelmill.llm.words import BASE

BIG = "/root/testdata/sf0.01"
FULL = (1 << 64) - 1


def crc_is(key, mod, rest):
    return zlib.crc32(str(key).encode()) % mod == rest


def documents(spark):
    return {r["doc_id"]: r for r in read(spark, BIG, "documents").collect()}


def mixed(h):
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & FULL
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & FULL
    return h ^ h >> 33


def poly(symbols):
    out = 0
    for x in reversed(symbols):
        out = (out * BASE + x) & FULL
    return mixed(out)


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text or "")
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)


def test_toxicity(spark):
    docs, key = read(spark, BIG, "documents"), F.col("doc_id")
    model = toxicity.fit_toxicity(docs, read(spark, BIG, "labels"), ~held_out(key, 3, 1))
    place = {t: k for k, t in enumerate(model.chosen.tolist(), 1)}
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, BIG).collect()}
    rows = documents(spark)
    assert set(got) == set(rows) and len(place) > 10
    for k, r in rows.items():
        terms = set()
        for w in {w.encode() for w in words(r["text"])}:
            terms.add(poly([b + 1 for b in w]) >> 44)
            terms |= {mixed((poly([b + 1 for b in w[:n]]) + j) & FULL) >> 44 for j, n in enumerate((4, 5, 6, 7, 8), 1) if len(w) >= n}
        own = sorted(place[t] for t in terms if t in place)
        value = model.w0 + sum(model.w[i] for i in own) + sum(float(model.v[a] @ model.v[b]) for n, a in enumerate(own) for b in own[:n])
        score = 1 / (1 + np.exp(-min(max(value, -30), 30)))
        assert got[k]["score"] == pytest.approx(score, abs=1e-9) and got[k]["predicted"] == int(got[k]["score"] >= 0.7) and got[k]["held_out"] == crc_is(k, 3, 1)


@pytest.mark.parametrize("together", [0, 1])
def test_pairs_of_terms_that_tell_nothing_alone(spark, together):
    """Toxic with one of two words but not both, or with both or neither: each word is balanced."""
    rng, rows = np.random.default_rng(5), []
    for k in range(1200):
        a, b = rng.integers(0, 2, 2)
        own = [f"w{x}" for x in rng.zipf(1.3, 40) % 5000] + ["insult"] * a + ["group"] * b
        rows.append((k, " ".join(rng.permutation(own)), int((a == b) == together)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    args = docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") < 800
    right = lambda model: docs.where("doc_id >= 800").join(toxicity.score_toxicity(docs, model), "doc_id").where((F.col("score") > 0.5).cast("int") == F.col("toxic")).count() / 400
    assert right(toxicity.fit_toxicity(*args)) > 0.98
    assert right(toxicity.fit_toxicity(*args, least_pair=10**9)) < 0.75  # single terms don't do


def test_quality(spark):
    docs, key = read(spark, BIG, "documents"), F.col("doc_id")
    model = quality.fit_quality(docs, read(spark, BIG, "labels"), ~held_out(key, 5, 0))
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, BIG).collect()}
    rows = documents(spark)
    assert set(got) == set(rows)
    for k, r in rows.items():
        text = (r["text"] or "").encode()
        tops, lo = [], 0
        while True:
            chunk = list(text[lo : lo + 256])
            chunk += [256] * (256 - len(chunk))
            seen = [np.concatenate([model.embed[b] for b in chunk[p : p + 8]]) @ model.filters for p in range(0, 249, 2)]
            tops.append(np.maximum(np.max(seen, 0) + model.bias, 0))
            lo += 224
            if lo >= len(text) - 32:
                break
        value = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) @ model.head + model.head_bias
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-value)), abs=2e-4) and got[k]["predicted"] == int(got[k]["score"] >= 0.3) and got[k]["held_out"] == crc_is(k, 5, 0)


def test_language(spark):
    docs, key = read(spark, BIG, "documents"), F.col("doc_id")
    model = language.fit_language(docs, ~held_out(key, 4, 2))
    got = {r["doc_id"]: r for r in queries.op5_language(spark, BIG).collect()}
    rows = documents(spark)
    assert set(got) == set(rows)
    small = lambda c: c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c
    for k, r in rows.items():
        best, back, sizes = None, [], []
        for word in re.findall(r"[^\W\d_]+", r["text"] or ""):  # the documents have Latin letters only
            c = [0, *(small(ord(x)) + 2 for x in word), 0]
            e = np.zeros(len(model.langs))
            for a, b, d in zip(c, c[1:], c[2:], strict=False):
                h = (a * 0x85EBCA6B ^ b * 0xC2B2AE35 ^ d * 0x27D4EB2F) & 0xFFFFFFFF
                h ^= h >> 15
                e += model.logp[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 17]
            sizes.append(len(word))
            if best is None:
                best = e
                continue
            move = best[:, None] - language.SWITCH * (1 - np.eye(len(best)))
            back.append(move.argmax(0))
            best = move.max(0) + e
        if best is None:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
            continue
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        letters = np.bincount(path[::-1], sizes, len(model.langs))
        assert got[k]["held_out"] == crc_is(k, 4, 2)
        assert got[k]["score"] == pytest.approx(letters.max() / letters.sum(), abs=0.02) and letters[model.langs.index(got[k]["lang_pred"])] >= letters.max() - 0.02 * letters.sum()


def test_mixing(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r for r in read(spark, sf, "documents").select("doc_id", "text", "source").collect()}
    got = queries.op6_mixing(spark, sf).collect()
    assert len(got) == len(docs) == len({r["doc_id"] for r in got})
    size = {k: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for k, r in docs.items()}
    whole = {}
    for k, r in docs.items():
        whole[r["source"]] = whole.get(r["source"], 0) + size[k]
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    target, left, free = {}, float(sum(whole.values())), {s: 1 + k % 3 for k, s in enumerate(order)}
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * whole[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 3.0 * whole[s]
        left -= sum(target[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    taken = {}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], whole[s]) and r["target"] == pytest.approx(target[s])
        rate = target[s] / whole[s]
        assert r["taken"] in (int(rate) * r["size"], int(np.ceil(rate)) * r["size"]) and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in order)


def phrases(symbols):
    """Names of one text's phrases by locally consistent parsing."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    own = [x if n == 1 else mixed((x + n * 0xD6E8FEB86659FD93) & FULL) for x, n in runs]
    label = own
    for _ in range(4):
        new = []
        for k, x in enumerate(label):
            differ = x ^ (label[k - 1] if k else x ^ 1)
            place = min((differ & -differ).bit_length() - 1, 63) if differ else 63
            new.append(place << 1 | x >> place & 1)
        label = new
    label = [x & 255 for x in label]
    at = [0, *[k for k in range(1, len(own) - 1) if label[k] < label[k - 1] and label[k] < label[k + 1]], len(own)]
    return [poly([mixed(x) for x in own[a:z]]) for a, z in zip(at, at[1:], strict=False)]


@functools.cache
def print_of(text):
    symbols, found = [ord(c) for c in text], set()
    for level in range(1, 7):
        symbols = phrases(symbols) if symbols else []
        if level >= 2:
            found |= {mixed((x + level) & FULL) >> 32 for x in symbols}
    return sorted(found)[:64]


def near(a, b):
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})[:64] if max(len(a), len(b)) >= 64 else sorted({*a, *b})
    return len({*a} & {*b} & {*union}) / len(union)


def test_fingerprint(spark):
    """Every row of the whole query: lengths and digests at sf0.01, fingerprints and likeness too."""
    rows = sorted(documents(spark).values(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op7_fingerprint(spark, BIG).collect()}
    assert len(got) == len(rows)
    prints = {}
    for r in rows:
        prints.setdefault(r["text"] or "", None)
    for r, ahead in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = r["text"] or "", ahead["text"] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        mine = got[r["doc_id"]]
        assert mine["n_chars"] == len(text) and mine["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new = print_of(text), print_of(edited)
        assert mine["fingerprint"] == "".join(f"{x:08x}" for x in own) and mine["edited_fingerprint"] == "".join(f"{x:08x}" for x in new)
        assert mine["near_edited"] == pytest.approx(near(own, new))
        assert mine["near_next"] == pytest.approx(near(own, print_of(after)))


def test_pipeline_decides_as_its_operators(spark, tmp_path):
    """Nulls, repeated rows, a further column of a clashing name, and every document's way through the stages."""
    import corpus_pipeline
    from voxelmill.llm import decontaminate, mixing, neardup

    docs = read(spark, BIG, "documents")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.orderBy("doc_id").limit(4).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.orderBy("doc_id").limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    every = docs.unionByName(odd).withColumn("class_id", F.lit("own")).withColumn("a.b", F.create_map(F.lit("k"), F.col("lang")))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, BIG, name).write.parquet(f"{tmp_path}/{name}.parquet")
    at = read(spark, str(tmp_path), "documents")
    model = quality.fit_quality(at, read(spark, BIG, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    good = {(r["doc_id"], r["text"]) for r in at.join(quality.score_quality(at, model).where("score >= 0.3").distinct(), "doc_id", "left_semi").select("doc_id", "text").collect()}
    kept, seen = at, []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert kept.columns == at.columns
        seen.append([(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()])
    assert {k for k in seen[0] if k[0] is not None and k[1]} <= good
    assert len(seen[2]) == len(set(seen[2])) == neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/language.parquet")).select("class_id").distinct().count()
    leaks = decontaminate.find_leaks(spark.read.parquet(f"{tmp_path}/near_duplicates.parquet"), read(spark, BIG, "benchmark"))
    assert {k for k, _ in seen[3]} == {r["doc_id"] for r in leaks.where("n_hit = 0").collect()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(spark.read.parquet(f"{tmp_path}/decontamination.parquet"), ["doc_id"]).collect()}
    assert set(k for k, _ in seen[4]) <= set(copies) and max(copies.values()) <= 3
    none = corpus_pipeline.STAGES[0][1](spark, at.where("false"), str(tmp_path))
    assert none.count() == 0
