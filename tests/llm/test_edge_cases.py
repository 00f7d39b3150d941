"""Every operator over nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from voxelmill.llm import chat, decontaminate, fingerprint, language, mixing, neardup, quality, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, class_id string, spans string"
LONG = "the quick brown fox jumps over a lazy dog while idle cats watch " * 4000
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0), (4, LONG, "en", "a", 1), (5, "der hund und die katze sind nicht hier", "de", "b", 1),
    (5, "der hund und die katze sind nicht hier", "de", "b", 1), (None, "le chat est sur la table avec des amis", "fr", None, 1), (7, "12 34 !!", None, "c", 1), (8, "the cat sat on the mat and looked at the moon", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def by_text(docs, found, column):
    """Distinct values of a column for each text."""
    out = {}
    for r in docs.select("doc_id", "text").distinct().join(found, "doc_id").collect():
        out.setdefault(r["text"] or "", set()).add(r[column])
    return out


@pytest.mark.parametrize(("fit", "score"), [(quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)])
def test_classifiers(spark, docs, none, labels, fit, score):
    model = fit(docs, labels, F.lit(True))
    rows = score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(len(v) == 1 for v in by_text(docs, score(docs, model), "score").values())
    assert score(none, model).collect() == []
    unlearned = fit(none, labels, F.lit(True))
    assert {r["score"] for r in score(docs, unlearned).collect()} == {0.5}


def test_filters_keep_all_columns(docs, labels):
    model = quality.fit_quality(docs, labels, F.lit(True))
    kept = quality.filter_quality(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.filter_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True)), 1.1).count() == len(ROWS)
    assert mixing.mix(docs).columns == docs.columns


def test_language(docs, none):
    model = language.fit_language(docs, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify_language(docs, model).collect()}
    assert {(2, "und"), (3, "und"), (7, "und"), (1, "en"), (5, "de"), (None, "fr")} <= got
    assert language.filter_language(docs, model).count() == len(ROWS) - 3
    assert language.identify_language(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify_language(docs, language.fit_language(none, F.lit(True))).collect()} == {"und"}


def test_mixing(docs, none):
    plan = mixing.mix_plan(docs, ["doc_id"]).collect()
    assert len(plan) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in plan)
    assert {r["size"] for r in plan if r["doc_id"] in (2, 3)} == {0}
    assert mixing.mix_plan(none, ["doc_id"]).count() == 0 and mixing.mix(none).count() == 0


def test_near_duplicates(docs, none):
    got = {(r["doc_id"], r["class_id"], r["n_copies"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1, 2), (8, 1, 2), (2, 2, 2), (3, 2, 2), (4, 4, 1), (5, 5, 2), (None, None, 1), (7, 7, 1)}
    kept = neardup.first_of_classes(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "7", "None"] and kept.columns == docs.columns
    assert neardup.near_duplicates(none).count() == 0 and neardup.first_of_classes(none).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "Sat on the MAT"), (2, None), (3, "!!"), (None, "the cat"), (1, "Sat on the MAT"), (4, "34")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[1] == (11, 6, ["1", None]) and got[2] == (0, 0, []) and got[7] == (2, 1, ["4"]) and got[3] == (0, 0, [])
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.remove_leaks(docs, bench.where("false")).count() == len(ROWS)


def test_fingerprint(docs, none):
    rows = {r["doc_id"]: r for r in fingerprint.edited_query(docs).collect()}
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == "" and rows[2]["near_next"] == 1.0
    assert rows[1]["fingerprint"] == rows[8]["fingerprint"] != ""
    assert fingerprint.edited_query(docs).count() == len(ROWS) and fingerprint.edited_query(none).count() == 0
    one = fingerprint.edited_query(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0  # the only document is its own next one


def test_fingerprint_of_any_ids(spark, docs):
    """Integers of other widths, strings, and one id for a third of the rows: each row's next one is the next by id, hash and text."""
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_query(known).collect()}
    for kind in ("int", "short"):
        assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_query(known.withColumn("doc_id", F.col("doc_id").cast(kind))).collect()} == want
    assert {r["key"]: r["edited_sha256"] for r in fingerprint.edited_query(known.select(F.concat(F.lit("k"), "doc_id").alias("key"), "text"), "key").collect()} == {f"k{k}": v for k, v in want.items()}
    hot = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.xxhash64(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("h"))
    rows = hot.orderBy("doc_id", "h").collect()
    import hashlib

    plain = sorted((a["doc_id"], hashlib.sha256((a["text"][: len(a["text"]) - len(a["text"]) // 4] + b["text"][: len(a["text"]) // 4]).encode()).hexdigest()) for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in fingerprint.edited_query(hot).collect()) == plain
    with pytest.raises(TypeError):
        fingerprint.edited_query(known.withColumn("doc_id", F.col("doc_id").cast("double")))


def test_odd_columns(spark):
    """Maps, dots and the operators' own names among the columns."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of the text number "), (F.col("id") % 20).cast("string")).alias("text"), F.lit("s").alias("source"), F.create_map(F.lit("k"), "id").alias("m"), F.lit(1).alias("a.b"), F.lit(2).alias("key"), F.lit(3).alias("size"), F.lit(4).alias("copies"), F.lit(5).alias("name"), F.lit(6).alias("row"))
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == 40
    kept = neardup.first_of_classes(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_archives(spark):
    pages = spark.createDataFrame([(3, "http://a/ b", "x\r\n\r\nWARC/1.1\r\n"), (1, None, "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "é"), (2, "u", None), (5, "u", ""), (5, "u", ""), (6, "u", LONG)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_query(pages).collect())
    assert got == [(0, 2, "response", None), (1, 15, "response", None), (2, 0, "response", None), (3, 15, "revisit", 1), (5, 0, "revisit", 2), (5, 0, "revisit", 2), (6, len(LONG), "response", None)]
    assert warc.archive_query(pages.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, "http://User@A.Example.com:80/x", "2024-01-05"), (2, "nonsense", "2024-01-05"), (3, None, "2024-01-05"), (4, "http://a.example.com", None), (1, "http://b.a.example.com./", "2024-02-05"), (1, "http://b.a.example.com./", "2024-02-05")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on")).withColumn("action", F.lit("own"))
    entries = [("example.com", "2024-01-01", "block"), ("a.example.com", "2024-02-01", "allow"), ("a.example.com", "2024-02-01", "remove"), (None, "2024-01-01", "block"), ("a.example.com", None, "block"), ("x.org", "2024-01-01", "odd")]
    dated = spark.createDataFrame(entries, "pattern string, listed_on string, action string").withColumn("listed_on", F.to_date("listed_on"))
    got = sorted((r["page_id"], r["action"], r["pattern"] or "") for r in urls.judge(captures, dated).collect())
    assert got == [(1, "allow", "a.example.com"), (1, "allow", "a.example.com"), (1, "block", "example.com"), (2, "none", ""), (3, "none", ""), (4, "none", "")]
    assert urls.judge(captures.where("false"), dated).count() == 0
    assert {r["action"] for r in urls.judge(captures, dated.where("false")).collect()} == {"none"}
    address = captures.limit(1).withColumn("url", F.lit("http://1.2.3.4/x"))
    assert urls.judge(address, dated.limit(1).withColumn("pattern", F.lit("3.4"))).first()["action"] == "none" and urls.judge(address, dated.limit(1).withColumn("pattern", F.lit("1.2.3.4"))).first()["action"] == "block"
    kept = urls.filter_urls(captures, dated)
    assert kept.columns == captures.columns and kept.count() == 5


def test_chat(spark):
    said = [(1, 0, "user", "a&<b> [x] &amp; <|im_end|>\n"), (1, 1, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (3, None, "odd\nrole", "é"), (None, 0, "user", ""), (4, 0, "assistant", LONG)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("own"))
    back = chat.format_turns(chat.to_turns(chat.as_records(turns))).select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["loss"]) for r in back.collect()}
    assert got[1] == ([("user", "a&<b> [x] &amp; <|im_end|>\n"), ("assistant", "")], "") and got[2] == ([("", "x")] * 2, "")
    assert got[3] == ([("odd\nrole", "é")], "") and got[None] == ([("user", "")], "") and got[4][1] == LONG
    assert chat.chat_query(turns.where("false")).count() == 1  # conversation -7
