"""The screening engine's functions and operators on small tables of our own."""

import datetime as dt
import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ranking, relational
from corvane.plans import catalogue
from corvane.sources import harvest, records
from corvane.streaming import events as stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normalise_joins_hyphens_and_squeezes(spark):
    assert value(spark, T.normalise(F.lit(" micro-\nscope  at \t work "))) == "microscope at work"


def test_sentences_split_before_capitals_only(spark):
    assert value(spark, T.sentences(F.lit("One. Two e.g. three! Four (5) ok? (Six)"))) == ["One.", "Two e.g. three!", "Four (5) ok?", "(Six)"]


def test_evidence_keeps_the_sentence_that_crosses_the_limit(spark):
    found = F.array(*(F.lit(x) for x in ["a" * 6, "a" * 6, "b" * 6, "c" * 6]))
    assert value(spark, T.evidence(found, most=9, chars=10)) == ["a" * 6, "b" * 6]
    assert value(spark, T.evidence(found, most=1)) == ["a" * 6]


def test_article_check_order(spark):
    of = lambda s: value(spark, T.article_check(F.lit(s)))
    cases = ["", " \n ", "Subscribe to access " + "word " * 400, "short", "1 " * 900, "word " * 400, "word  \n" * 700]
    assert [of(x).reason for x in cases] == ["empty", "too_short", "access_page", "too_short", "low_text_density", "", ""]
    assert of("word " * 3000).quality == "high" and of("word  \n " * 1500).quality == "medium" and not of(None).ok


def test_doi_forms(spark):
    cases = {
        "https://doi.org/10.1234/AB.": "10.1234/ab", "10.1/x": "", "10.5555/a(b)c)": "10.5555/a(b)c", "10.1000/a+b%2Fc": "10.1000/a+b/c", "50% 10.1000/z": "10.1000/z", "10.1000/x[1]]])": "10.1000/x[1]",
        "10.1000/x(1)]": "10.1000/x(1)", "urn:doi:10.1000/Q/epdf/pdf": "10.1000/q", "<10.1000/a>": "10.1000/a", "10.1000/((a))))": "10.1000/((a))",
    }
    assert {k: value(spark, T.doi(F.lit(k))) for k in cases} == cases and value(spark, T.doi(F.lit(None).cast("string"))) == ""


def test_wilson_bounds(spark):
    low, high = T.wilson(F.lit(36.0), F.lit(40))
    assert round(value(spark, low), 2) == 0.77 and round(value(spark, high), 2) == 0.96
    assert value(spark, T.wilson(F.lit(0.0), F.lit(0))[1]) == 0


def test_name_key_folds_accents(spark):
    cases = {"Zoë Ångström": "angstrom|z", "O'Neil, Tim": "oneil|t", "de la Cruz, José": "delacruz|j", "Müller-Weiß Éva": "eva|m", "Ольга": "|", "ﬁnn Šafařík": "safarik|f", "": "|", "Madonna": "madonna|"}
    assert {k: value(spark, T.name_key(F.lit(k))) for k in cases} == cases


def test_chunks_end_at_their_size(spark):
    assert value(spark, T.chunk_pack(F.array(F.lit("aaaa"), F.lit("bbbb"), F.lit("cc")), 8)) == ["aaaa bbbb", "cc"]


def test_upsert_takes_the_first_present_value(spark):
    one = spark.createDataFrame([("k", "", "s1")], "id string, name string, source string")
    two = spark.createDataFrame([("k", "n", "s2"), ("l", None, "s2")], "id string, name string, source string")
    assert sorted((r.id, r.name, r.sources) for r in relational.upsert([one, two], "id", ["name"]).collect()) == [("k", "n", "s1; s2"), ("l", None, "s2")]


def test_interval_join_bounds(spark):
    a = spark.createDataFrame([(1, 2010)], "k int, y int")
    b = spark.createDataFrame([(1, y) for y in (2006, 2007, 2011, 2012)], "k int, b int")
    assert sorted(r.b for r in relational.within(a, b, "k", "y", "b", 1, 3).collect()) == [2007, 2011]


def test_logistic_regression_equals_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 0.4).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(60)], "id long, v array<double>, y double")
    got = np.array([r.margin for r in ranking.logistic_margin(df).orderBy("id").collect()])
    w, z = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum()))), np.column_stack((x, np.ones(60)))
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0]), z.T @ (w * (p - y)) + np.append(b[:3], 0))
    assert np.abs(got - z @ b).max() < 1e-3
    one = df.withColumn("y", F.when(F.col("id") < 5, 1.0))
    assert {r.margin for r in ranking.logistic_margin(one).collect()} == {0.0} and {r.margin for r in ranking.logistic_margin(df.withColumn("y", F.lit(None).cast("double"))).collect()} == {0.0}


@pytest.mark.parametrize("block_bytes", [1 << 20, 32])
def test_neighbour_scores_equal_plain(spark, block_bytes, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[50] = x[3] + 1e-6  # a version of row 3, of another year
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    year, confirmed = np.arange(60) % 4, np.arange(60) % 3 != 1
    df = spark.createDataFrame([(i, int(year[i]), x[i].tolist()) for i in range(60)], "id long, year int, v array<double>")
    known = df.filter("id % 3 <> 1").select(F.col("id").alias("known"), F.col("year").alias("known_year"), F.col("v").alias("u"))
    pairs = {(r.id, r.known): r.cosine for r in ranking.similar(df, known, 5, block_bytes=block_bytes).collect()}
    for i in range(60):
        usual = sorted((j for j in range(60) if confirmed[j] and year[j] != year[i]), key=lambda j: (-(x[i] @ x[j]), j))[:5]
        assert sorted(j for a, j in pairs if a == i) == sorted(usual)
    gone = {(r.year, r.known) for r in ranking.near_versions(df, known).collect()}
    assert (int(year[3]), 50) in gone and all(any(year[i] == y and x[i] @ x[j] > 0.97 for i in range(60)) for y, j in gone)
    got = {r.id: r.score for r in ranking.neighbour_scores(df, known).collect()}
    for i in range(60):
        best = sorted((-(x[i] @ x[j]) for j in range(60) if confirmed[j] and year[j] != year[i] and (year[i], j) not in gone))[:5]
        assert abs(got[i] + sum(best) / 5) < 1e-9


def test_embedded_papers_equal_plain(spark):
    embed = ranking.hashed_embedder(16)
    df = spark.createDataFrame([("a", ["one two three", "four"]), ("b", []), ("c", None), ("d", ["five six"])], "doi string, chunks array<string>")
    got = {r.doi: r for r in ranking.embed_papers(df, embed, batch=1).collect()}
    v = embed(["one two three", "four"]).mean(0)
    assert sorted(got) == ["a", "d"] and np.allclose(got["a"].vector, v / np.linalg.norm(v), atol=1e-6) and got["a"].chunk_text == "one two three four"
    held = spark.createDataFrame([("a", [1.0], "kept"), ("z", [1.0], "gone")], "doi string, vector array<float>, chunk_text string")
    again = {r.doi: r.chunk_text for r in ranking.refresh_store(held, df, embed).collect()}
    assert again == {"a": "kept", "d": "five six"}
    assert ranking.store_name("2024", "org/model x|cpu") == "2024__org-model-x-cpu-" + hashlib.sha1(b"org/model x|cpu").hexdigest()[:8]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, dt.datetime(2024, 1, 1 + i % 3, i % 24), "a" if i % 2 else "b", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = stream.daily_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, stream.daily_counts(batch).collect()))
    assert stream.distinct_events(batch).count() == 7


def test_upserts_survive_restarts_and_late_rows(spark, tmp_path):
    held, source = str(tmp_path / "held"), tmp_path / "in"
    kind = "user_id long, ts timestamp, note string"
    day = lambda n: dt.datetime(2024, 1, n)

    def batch(name, rows, checkpoint):
        spark.createDataFrame(rows, kind).write.parquet(str(source / name))
        q = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(source)).writeStream.foreachBatch(stream.upsert_sink(held, "user_id", "ts")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.user_id: r.note for r in stream.held_rows(spark, held).collect()}

    assert stream.held_rows(spark, held) is None
    assert batch("one", [(1, day(2), "a"), (2, day(1), "b"), (1, day(1), "early")], "c1") == {1: "a", 2: "b"}
    assert batch("two", [(1, day(1), "late"), (2, day(5), "c"), (3, day(1), "d")], "c1") == {1: "a", 2: "c", 3: "d"}
    assert batch("three", [(4, day(1), "e")], "c2") == {1: "a", 2: "c", 3: "d", 4: "e"}  # a new checkpoint reads everything again


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    path = str(tmp_path / "held")
    sink = stream.upsert_sink(path, "k", "v", keep=2, buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, note string")
    read = lambda: {r.k: (r.v, r.note) for r in stream.held_rows(spark, path).collect()}
    folders = lambda g: {p.name for p in (tmp_path / "held" / f"generation-{g}").glob("bucket=*")}
    sink(rows(*((f"k{i}", 1, "first") for i in range(200)), (None, 1, "no key")), 0)
    assert len(folders(0)) == 8
    sink(rows(("k5", 2, "second"), ("k6", 0, "late")), 1)
    assert 1 <= len(folders(1)) <= 2 and read() == {**{f"k{i}": (1, "first") for i in range(200)}, None: (1, "no key"), "k5": (2, "second")}
    sink(rows(), 2)  # nothing to do
    sink(rows(("k5", 2, "second"), ("k6", 0, "late")), 1)  # given again
    assert read()["k5"] == (2, "second") and len(read()) == 201
    for n in range(4):
        sink(rows(*((f"k{i}", 3 + n, "all") for i in range(200)), (None, 3 + n, "all")), 3 + n)
    assert read() == {**{f"k{i}": (6, "all") for i in range(200)}, None: (6, "all")}
    assert len(list((tmp_path / "held").glob("manifest-*"))) == 2 and len(list((tmp_path / "held").glob("generation-*"))) == 2
    # a batch that broke off before its manifest doesn't count, and the next one takes its place
    (tmp_path / "held" / "generation-7").mkdir()
    (tmp_path / "held" / "generation-7" / "_SUCCESS").write_text("")
    assert read()["k1"] == (6, "all")
    sink(rows(("k1", 9, "new")), 9)
    assert read()["k1"] == (9, "new") and read()["k2"] == (6, "all")


def test_readers_and_year_partitions(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doi": "doi:10.1234/A", "title": "t", "year": 2020}\n{"title": "no doi"}\n')
    got = records.read_candidates(spark, str(tmp_path / "c.jsonl"))
    assert [r.doi for r in got.collect()] == ["10.1234/a"]
    (tmp_path / "o.xml").write_text("<r><record><title>T</title><creator>B</creator><creator>A</creator><identifier>http://files/1</identifier><identifier>10.1234/q</identifier></record></r>")
    rows = harvest.oai_records(spark, str(tmp_path / "o.xml"), "http://files/").collect()
    assert [(r.doi, r.title, r.authors, r.files) for r in rows] == [("10.1234/q", "T", ["A", "B"], ["http://files/1"])]
    assert value(spark, harvest.resumption_token(F.lit("<a><resumptionToken c='1'> t&amp;1 </resumptionToken></a>"))) == "t&amp;1" and value(spark, harvest.resumption_token(F.lit("<a/>"))) is None
    records.write_by_year(spark.createDataFrame([(1, 2020), (2, 2021)], "a int, year int"), str(tmp_path / "y"))
    records.write_by_year(spark.createDataFrame([(3, 2021)], "a int, year int"), str(tmp_path / "y"))
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "y")).collect()) == [1, 3]


def test_every_title_is_compared(spark):
    rng = np.random.default_rng(13)
    words = ["alpha", "beta", "gamma", "delta", "Äther", "zeta1", "iota", "ab", "kappa", "lambda"]
    draw = lambda n: " ".join(rng.choice(words, n))
    texts = [*((i, draw(rng.integers(1, 9))) for i in range(60)), (60, None), (61, ""), (62, "-"), (None, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "alpha beta gamma"), (63, "x" * 30000 + " alpha beta gamma")]
    items = [*((i, draw(rng.integers(1, 9))) for i in range(40)), (40, None), (41, ""), (42, "delta delta iota"), (42, "delta delta iota")]
    d, t = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    long_words = lambda x: re.findall(r"[a-z0-9]{4,}", x.lower())
    want = []
    for i, x in texts:
        body = set(long_words((x or "")[:30000]))
        for j, y in items:
            w = long_words(y or "")
            if x and y is not None and (len(w) < 3 or sum(v in body for v in w) >= 0.5 * len(w)):
                want.append((i or -1, j))
    for sizes in ({}, {"pass_rows": 7, "block": 3, "rows": 4}):
        got = sorted((r.doc_id or -1, r.item_id) for r in relational.every_title(d, t, **sizes).collect())
        assert got == sorted(want)


def test_titles_of_all_items_are_in_the_registered_query(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "gamma delta kappa") for i in (9, 10, 199)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.item_id for r in catalogue.QUERIES["text_matches_title"](spark, str(tmp_path)).collect()) == [9, 10, 199]


def test_whole_texts_are_redacted(spark, tmp_path):
    texts = [(1, " a@b.org " + "x " * 5000 + "c.d@e.fi end "), (2, None), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.redacted for r in catalogue.QUERIES["redact_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: "[email] " + "x " * 5000 + "[email] end", 2: None, 3: ""}


def test_page_text_leaves_cut_references_and_hard_blanks_as_the_sql_does(spark):
    import duckdb

    from corvane.plans.registry import ORACLES, QUERIES

    pages = ["<title>a&&&amp</title><p>x</p>", "<p>R&ampD &lt b&gt; &notit; &amp;lt; &nbsp;</p>", "&nbsp;a<p>b&nbsp;</p>\n&nbsp;\n&copy;&#39;", "&amp", "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").toPandas()
    con = duckdb.connect()
    con.register("pages", rows)
    want = dict(con.sql(ORACLES["html_to_text"]).fetchall())
    got = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").select("page_id", T.page_text(F.col("html")))
    assert QUERIES["html_to_text"] and dict(map(tuple, got.collect())) == want


def test_contacts_are_dealt_over_the_cores_and_matches_carry_their_text(spark):
    from corvane.plans.review import contact_extract

    if os.path.isdir("/root/testdata/sf0.001"):
        rows = contact_extract(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(rows) >= spark.sparkContext.defaultParallelism
    got = value(spark, T.matches(F.lit("ab1cd22"), "[0-9]+"))
    assert [tuple(x) for x in got] == [(2, 3, "1"), (5, 7, "22")] and value(spark, T.matches(F.lit("none"), "[0-9]+")) == [] and value(spark, T.matches(F.lit(None).cast("string"), "x")) is None


def test_words_of_an_article_are_counted_to_the_last_that_matters(spark):
    for n in (T.ARTICLE_WORDS - 1, T.ARTICLE_WORDS):
        text = "ab 1 " * 300 + "word, " * n
        assert value(spark, T.article_check(F.lit(text)))["reason"] == ("low_text_density" if n < T.ARTICLE_WORDS else "")
    assert value(spark, F.lit("ab 1 " * 40000 + "word, " * 199).rlike(T.MANY_WORDS)) is False
