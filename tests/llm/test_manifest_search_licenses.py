"""Merkle manifests, ranked search and license scans against plain versions, whole tables and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from voxelmill.llm import licenses, manifest, queries, search
from voxelmill.llm.common import read
from voxelmill.llm.templates import PHRASES, TEMPLATES

BIG = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", ["op11_search", "op12_manifest"])
def test_whole_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{BIG}/{table}.parquet')")
    found = queries.queries()[name](spark, BIG)
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(found.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(rows.fetchall())


# Manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(hashes, fanout):
    """The top of a tree and, of each leaf, what stands left and right of its node on every level."""
    nodes, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            lo = p // fanout * fanout
            paths[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + fanout])))
            at[k] = p // fanout
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """{(id, leaf): (subroot, root, path)} of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, h(*map(shown, r)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    root, above = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above, strict=True):
        for (_, _, leaf, key), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            out.append((key, leaf, trees[g][0], root, tuple(path + up)))
    return out


ODD = [
    (3, "a", "en", 1, "One"), (1, None, None, None, None), (None, "b", "en", 2, "two words"), (2, "a", "", 0, ""), (2, "a", "", 0, ""), (5, "ä:-", "ü", 3, "Ünï 12:-\nx"), (7, "a", "en", 1, "\U0001f600" * 3000),
    *[(k, "s", "de", k, f"Text {k % 3}") for k in range(40, 20, -1)], *[(k, "s", f"l{k}", k, "x") for k in range(100, 111)],
]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_of_odd_rows(spark, fanout):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([(*r, "k", "h", 1) for r in ODD], schema + ", key string, hash string, n int").repartition(5)
    got = manifest.dataset_manifest(docs, fanout=fanout).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in got) == Counter(plain_manifest(ODD, fanout))
    assert len({r["root"] for r in got}) == 1


def test_manifest_query_finds_tampered_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    got = manifest.manifest_query(spark.createDataFrame(ODD, schema)).collect()
    paths = {(k, leaf): path for k, leaf, _, _, path in plain_manifest(ODD, 8)}
    text = {(r[0], h(*map(shown, r))): r for r in ODD}
    assert len(got) == len(ODD)
    for r in got:
        row, path = text[r["doc_id"], r["leaf"]], paths[r["doc_id"], r["leaf"]]
        touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        node = h(*map(shown, (*row[:4], row[4].translate(LOWER) if touched and row[4] is not None else row[4])))
        for left, right in path:
            node = h(left, node, right)
        assert r["folded_root"] == node and r["verified"] == (node == r["root"]) and r["proof_sha256"] == h(*[a + b for a, b in path])
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_no_rows_one_row_and_one_group(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest_query(spark.createDataFrame([], schema)).collect() == []
    (one,) = manifest.dataset_manifest(spark.createDataFrame(ODD[:1], schema)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    same = [(k, "a", "en", 1, "x") for k in range(9)]
    got = manifest.dataset_manifest(spark.createDataFrame(same, schema)).collect()
    assert {r["subroot"] for r in got} == {r["root"] for r in got} == {plain_manifest(same, 8)[0][3]}
    assert {len(r["path"]) for r in got} == {2}


# Search


def plain_search(docs, items, k=10):
    counts = [(key, Counter(words(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    terms = defaultdict(set)
    for item, t in items:
        terms[item] |= set(words(t))
    out = []
    for item, own in terms.items():
        rows = []
        for key, c, n in counts:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score:
                rows.append((-score, key is None, key or type(key)(0 if isinstance(key, int) else "") if key is not None else 0, key, score))
        for rank, (*_, key, score) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1):
            out.append((item, rank, key, score))
    return Counter(out)


def got_search(found):
    return Counter((r[0], r[1], r[2], r[3]) for r in found.collect())


@pytest.mark.parametrize(("most", "k"), [(1 << 17, 10), (60, 3), (1, 1)])
def test_search_is_brute_force(spark, most, k):
    """Copies tie by the hundred, a third of all rows hold one word, and long, empty and null texts are among them."""
    rng = np.random.default_rng(3)
    pool = [f"w{x}" for x in range(400)]
    docs = [(i, " ".join(pool[x % 400] for x in rng.zipf(1.3, int(rng.integers(1, 60))))) for i in range(300)]
    docs += [(1000 - i, "Hot w1 w2; w350 ÄÖ") for i in range(150)] + [(2000, None), (2001, ""), (2002, " .,-"), (2003, "W7 " * 50000 + "é8"), (5, "w3 w3 w390"), (5, "w3 w3 w390")]
    items = [(i, " ".join(rng.choice(pool, 12))) for i in range(12)] + [(50, "hot W350 äö ÄÖ"), (51, None), (52, "?"), (53, "unheard"), (3, "w390 w7 é8"), (None, "w1"), (50, "hot W350 äö ÄÖ")]
    found = search.search(spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, t string, score int").repartition(7), spark.createDataFrame(items, "item_id int, text string"), k=k, most_pairs=most)
    want = plain_search(docs, [x for x in items if x[1] is not None], k)
    assert got_search(found) == want and len(want) > 12


def test_search_with_other_ids(spark):
    docs, items = [("b", "x y"), ("a", "x y"), (None, "x y"), ("é", "x"), ("z", "y y")], [("i", "x y")]
    found = search.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), k=4)
    ranked = [r["doc_id"] for r in found.orderBy("rank").collect()]
    assert ranked[:3] == ["a", "b", None] and len(ranked) == 4
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(none, spark.createDataFrame(items, "item_id string, text string")).collect() == []
    assert search.search(none, spark.createDataFrame([], "item_id string, text string")).columns == ["item_id", "rank", "doc_id", "score"]


def test_thresholds_prune(spark):
    """Terms that all documents hold don't find any where a rare term's k-th score is above all that they add."""
    docs = [(k, "common words of all " * 3 + (f"rare{k % 20}" if k < 400 else "")) for k in range(4000)]
    rows = search.forward(spark.createDataFrame(docs, "doc_id long, text string"), ["common", "words", "rare7"], "doc_id", "text")
    n, total = rows.count(), rows.agg({"n": "sum"}).first()[0]
    df, top, kth = search.bounds(rows, n, total, 3, 10, search.Scratch(spark))
    assert df.tolist() == [4000, 4000, 20] and (top >= kth).all() and (kth > 0).all()
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    plan = search.Plan(np.array([0, 0, 0]), np.array([0, 1, 2]), weight, top, kth)
    assert plan.finding[1].tolist() == [0] and plan.finding[0].tolist() == [0, 0, 0, 1] and plan.adding[0][-1] == 2


# Licenses


def plain_base(text):
    own, places = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(own) - len(p) + 1) if own[k : k + len(p)] == p]
    return len(own), places


def test_licenses_of_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, BIG, "documents").collect()}
    got = queries.op13_licenses(spark, BIG).collect()
    assert len(got) == len(docs)
    own = {"mit": "mit", "gpl": "gpl-3.0", "apache": "apache-2.0", "cc-by": "cc-by-nc-4.0"}
    seen = set()
    for r in got:
        n, places = plain_base(docs[r["doc_id"]])
        at, labels = [k for k, _ in places], {x for _, x in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(labels | {own[x] for x in labels}))
        assert r["score"] == 1.0 if places else r["score"] < 0.75
        seen |= labels
    assert seen == set(own)


def stretches(own, templates):
    """The longest stretch up to each word that stands in some template, by trying all."""
    every = {tuple(t[a:z]) for t in templates for a in range(len(t)) for z in range(a + 1, len(t) + 1)}
    return [max((n for n in range(k + 2) if n == 0 or tuple(own[k + 1 - n : k + 1]) in every)) for k in range(len(own))]


def test_automaton_holds_matching_statistics():
    rng = np.random.default_rng(11)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abcd"
        made = [[letters[x] for x in rng.integers(0, len(letters), int(rng.integers(1, 12)))] for _ in range(4)]
        text = [("abcdz")[x] for x in rng.integers(0, 5, 40)]
        a = licenses.Automaton([("t", " ".join(t)) for t in made], {" ".join(made[0][:2]): "p"})
        state = size = 0
        for k, want in enumerate(stretches(text, made)):
            c = a.number.get(text[k].encode(), 0)
            while state and c not in a.next[state]:
                state = a.link[state]
                size = a.length[state]
            state, size = (a.next[state][c], size + 1) if c in a.next[state] else (0, 0)
            assert size == want
            if size >= licenses.LONG:
                stretch = text[k + 1 - size : k + 1]
                assert sorted(set(a.ends[state])) == sorted((i, e) for i, t in enumerate(made) for e in range(size, len(t) + 1) if t[e - size : e] == stretch)
        p, n, places, *_ = made[0][:2], *licenses.scan(a, np.frombuffer(" ".join(text).encode(), np.uint8))
        assert n == len(text) and [x["word"] for x in places] == [k for k in range(len(text) - len(p) + 1) if text[k : k + len(p)] == p]


def scanned(text, templates=TEMPLATES):
    return licenses.scan(licenses.Automaton(templates, PHRASES), np.frombuffer(text.encode(), np.uint8))


def test_spans_survive_edits_and_clean_texts_have_none():
    body = dict(TEMPLATES)["zlib"]
    own = words(body)
    lead = "once upon a time there were words of no license at all "
    *_, spans, score = scanned(lead + body + " and so on")
    assert [(s["label"], s["first_word"], s["last_word"], s["covered"]) for s in spans] == [("zlib", 12, 12 + len(own) - 1, 1.0)] and score == 1.0
    edited = [w if k % 17 else "changed" for k, w in enumerate(own)]
    edited[30:30] = ["put", "in", "between"]
    *_, spans, score = scanned(lead + " ".join(edited))
    assert [s["label"] for s in spans] == ["zlib"] and 0.75 <= score < 1 and spans[0]["covered"] == score
    *_, spans, score = scanned(" ".join(own[: len(own) // 2]))
    assert not spans and 0.4 < score < 0.6
    *_, spans, score = scanned(lead + "without any of the software in this and that " * 50)
    assert not spans and score < 0.2
    *_, spans, _ = scanned(f"{body} {lead * 3} {body}")
    assert [s["label"] for s in spans] == ["zlib"] * 2 and spans[0]["last_word"] < spans[1]["first_word"]


def test_every_template_is_found_whole():
    for label, text in TEMPLATES:
        n, places, spans, score = scanned(f"Preface here. {text} The end.")
        assert label in {s["label"] for s in spans if s["covered"] == 1.0 and s["first_word"] == 2} and score == 1.0


def test_licenses_of_odd_rows(spark, monkeypatch):
    long = "the quick brown fox " * 300000 + "GNU General Public License " + "x" * 2000000 + " MIT-License"
    rows = [(1, None), (2, ""), (3, " .\n"), (4, long), (5, "cc by cc by CC,BY"), (5, "cc by cc by CC,BY"), (None, "mit license Mit_LICENSE")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, `a.b` string")
    got = {r["doc_id"]: r for r in licenses.license_query(docs).collect()}
    assert [(got[k]["n_words"], got[k]["n_base"], got[k]["score"], got[k]["labels"], got[k]["first_word"]) for k in (1, 2, 3)] == [(0, 0, 0.0, "", None)] * 3
    assert (got[4]["n_words"], got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (1200007, 2, 1200000, 1200005) and got[4]["base_labels"] == "gpl,mit"
    assert got[5]["n_base"] == 3 and got[5]["last_word"] == 4 and got[None]["n_base"] == 1
    assert licenses.license_query(docs.where("false")).collect() == []
    assert licenses.scan_licenses(docs, [], {}).where("size(spans) + size(places) > 0").count() == 0
    monkeypatch.setattr(licenses, "MOST_WORDS", 5)
    with pytest.raises(ValueError, match="at a time"):
        licenses.Automaton([("t", "a b c d e f")], {})
