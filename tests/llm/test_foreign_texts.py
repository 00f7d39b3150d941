"""Heads, scripts and benchmarks as others make them: odd ids, marks in words, and an automaton within its bound."""

import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from voxelmill.llm import language, toxicity, warc


def test_odd_page_ids_stop_nothing_and_equal_payloads_are_revisits(spark, tmp_path):
    def record(url, page, body=b"same"):
        own = b"HTTP/1.0 200 OK\nX-Page-Id: %s\n\n%s" % (page, body)
        return warc.url_record(1, "a.arc", url, "20010203040506", own) + b"\n"

    (tmp_path / "in").mkdir()
    odd = [b"\xb2", b"99999999999999999999", b"-99999999999999999999", b"1 2", b"", "٣".encode()]
    (tmp_path / "in" / "a.arc").write_bytes(warc.version_block(1, "a.arc") + b"".join(record(f"http://h/{k}", x) for k, x in enumerate(odd)))
    (tmp_path / "in" / "b.arc").write_bytes(warc.version_block(1, "b.arc") + record("http://h/7", b"12", b"other") + record("http://h/8", b"7", b"other") + record("http://h/9", b"?", b"other"))
    assert warc.convert_arc(spark, f"{tmp_path}/in", f"{tmp_path}/out", compress=False).count() == 0
    got = warc.read_warc(spark, f"{tmp_path}/out").collect()
    same = [r for r in got if r["payload_digest"] == warc.base32_sha1(b"same")]
    assert sorted(r["record_type"] for r in same) == ["response"] + ["revisit"] * 5 and {r["page_id"] for r in same} == {None}
    first = next(r["record_id"] for r in same if r["record_type"] == "response")
    assert {r["refers_record"] for r in same if r["record_type"] == "revisit"} == {first}
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in got if r not in same) == [(0, "revisit"), (7, "response"), (12, "revisit")]
    assert [warc.number(x) for x in ("12", "-7", "9223372036854775807", "9223372036854775808", "", None, "1_0")] == [12, -7, (1 << 63) - 1, None, None, None, None]


def spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    w = language.words_of(data, np.array([0, len(data)]), language.Tables())
    return [text[a : a + n] for a, n in zip(w.start.tolist(), w.length.tolist(), strict=True)]


def test_marks_are_part_of_words():
    assert spans("किताब हिन्दी में") == ["किताब", "हिन्दी", "में"]
    assert spans("café au lait") == ["café", "au", "lait"] and spans("́abc ि") == ["abc"]
    assert spans("มาก ที่สุด") == ["มาก", "ที่สุด"] and spans("क्‍ष x") == ["क्‍ष", "x"]
    data = "abcि".encode()
    both = language.words_of(np.frombuffer(data + "िक".encode(), np.uint8), np.array([0, len(data), len(data) + 6]), language.Tables())
    assert both.length.tolist() == [4, 1] and both.row.tolist() == [0, 1]  # a text's first mark has no letter before it


def test_languages_of_one_script_that_differ_in_signs(spark):
    rng = np.random.default_rng(4)
    letters, signs = [chr(c) for c in range(0x915, 0x930)], {"one": "ाि", "two": "ीु"}

    def text(lang, k):
        return " ".join("".join(letters[x] + signs[lang][x % 2] for x in rng.integers(0, len(letters), 4)) for _ in range(k))

    rows = [(k, text(("one", "two")[k % 2], 40), ("one", "two")[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.col("doc_id") < 120)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs.where("doc_id >= 120"), model).collect()}
    assert all(got[k] == lang for k, _, lang in rows if k >= 120)


def test_an_automaton_takes_what_it_is_counted_for():
    """Windows that are counted as 64 MB take no more memory than that, measured in a process of its own."""
    code = """
import resource, random
from voxelmill.llm import decontaminate as D
random.seed(1)
words = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(3, 12))) for _ in range(20000)]
windows, size = {}, 0
while size < 64 << 20:
    w = " " + " ".join(random.choice(words) for _ in range(10)) + " "
    windows[w] = ["1"]
    size += len(w) * D.NODE + 64 + 17
a = D.Automaton(windows)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
list(a.occurrences(" x "))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 64 << 10


def test_pairs_don_t_depend_on_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    has = rng.random((400, 90)) < 0.2
    y = ((has[:, 3] & has[:, 50]) | (rng.random(400) < 0.05)).astype(float)
    row, term = np.nonzero(has)
    names = np.arange(90) * 7 + 1
    both = has.T.astype(float) @ has
    toxic = has[y == 1].T.astype(float) @ has[y == 1]
    far = (both >= 8) & toxicity.telling(both, toxic, y.mean(), 6.0)
    np.fill_diagonal(far, False)
    want = names[far.any(0)]
    for cells in (1 << 22, 90 * 7, 1):
        monkeypatch.setattr(toxicity, "PAIRS", cells)
        assert toxicity.choose_pairs(spark, row, names[term], y, names, 8, 6.0).tolist() == want.tolist()
    assert {names[3], names[50]} <= set(want.tolist())
