"""Stores of texts and vectors: replacement, pruned look-ups, runs that go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ranking
from corvane.operators.vector_store import VectorStore
from corvane.sources.text_store import TextStore, bucket_of


def rows_of(df):
    return {r.doi: (r.text, r.source) for r in df.collect()}


def test_the_later_text_replaces_the_earlier(spark, tmp_path):
    store = TextStore(spark, f"file://{tmp_path}/texts", 8)
    assert store.texts().collect() == [] and store.look_up(spark.createDataFrame([("a",)], "doi string")).collect() == []
    kind = "doi string, text string, source string, note int"
    store.store(spark.createDataFrame([("a", "one", "x", 1), ("b", "two", "x", 1), (None, "lost", "x", 1), ("c", "three", "x", 1), ("c", "three", "x", 2)], kind))
    store.store(spark.createDataFrame([("b", "new", "y")], "doi string, text string, source string"))
    store.store(spark.createDataFrame([("d", None)], "doi string, text string"))
    want = {"a": ("one", "x"), "b": ("new", "y"), "c": ("three", "x"), "d": (None, None)}
    assert rows_of(store.texts()) == want
    assert rows_of(store.look_up(spark.createDataFrame([("b",), ("b",), ("zz",), (None,), ("d",)], "doi string"))) == {"b": ("new", "y"), "d": (None, None)}
    store.compact()
    assert store.generations() == [3] and rows_of(store.texts()) == want


def test_a_look_up_reads_its_buckets_alone(spark, tmp_path):
    store = TextStore(spark, f"file://{tmp_path}/texts", 64)
    store.store(spark.range(3000).select(F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), F.lit("t").alias("text")))
    wanted = spark.range(10).select(F.concat(F.lit("10.1/"), (F.col("id") * 7).cast("string")).alias("doi"))
    found = store.look_up(wanted)
    buckets = {r.b for r in wanted.select(bucket_of(F.col("doi"), 64).alias("b")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 10 and len(buckets) <= 10 and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = store.rows().filter(F.col("bucket").isin(*buckets)).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in files}) == len(buckets)


def test_a_half_written_generation_does_not_count(spark, tmp_path):
    store = TextStore(spark, f"file://{tmp_path}/texts", 4)
    store.store(spark.createDataFrame([("a", "one")], "doi string, text string"))
    (tmp_path / "texts" / "generation=1" / "bucket=0").mkdir(parents=True)
    assert store.generations() == [0] and rows_of(store.texts()) == {"a": ("one", None)}
    store.store(spark.createDataFrame([("a", "two")], "doi string, text string"))
    assert store.generations() == [0, 1] and rows_of(store.texts()) == {"a": ("two", None)}


def test_an_interrupted_build_goes_on(spark, tmp_path):
    log = str(tmp_path / "log")
    made = ranking.hashed_embedder(8)

    def embed(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return made(texts)

    papers = spark.createDataFrame([(f"d{i}", [f"text of {i}", "more words"]) for i in range(40)] + [("none", []), ("null", None)], "doi string, chunks array<string>")
    store = VectorStore(spark, f"file://{tmp_path}/vectors")

    def stop(done, of):
        if done == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.build(papers, embed, 10, stop)
    first = [t for t in open(log).read().splitlines() if t.startswith("text")]
    assert store.batches() == [0, 1] and 0 < len(first) < 40 and store.vectors(papers).count() == len(first)
    store.build(papers, embed, 10)
    every = [t for t in open(log).read().splitlines() if t.startswith("text")]
    assert sorted(every) == sorted(f"text of {i}" for i in range(40))  # each paper once over both runs
    assert store.build(papers, embed, 10) == 0
    got = {r.doi: r.vector for r in store.vectors(papers).collect()}
    v = made(["text of 3", "more words"]).mean(0)
    assert len(got) == 40 and np.allclose(got["d3"], v / np.linalg.norm(v), atol=1e-6)


def test_a_failure_in_a_task_loses_no_batch(spark, tmp_path):
    flag = tmp_path / "fixed"
    made = ranking.hashed_embedder(4)

    def embed(texts):
        if any("17" in t for t in texts) and not flag.exists():
            raise RuntimeError("no memory")
        return made(texts)

    papers = spark.createDataFrame([(f"d{i}", [f"text {i}"]) for i in range(30)], "doi string, chunks array<string>")
    store = VectorStore(spark, f"file://{tmp_path}/vectors")
    with pytest.raises(Exception, match="no memory"):
        store.build(papers, embed, 5)
    before = store.batches()
    flag.touch()
    store.build(papers, embed, 5)
    assert store.vectors(papers).count() == 30 and store.batches()[: len(before)] == before
    fewer = papers.filter("doi < 'd2'")
    assert store.vectors(fewer).count() == fewer.count()
    store.compact(fewer)
    assert len(store.batches()) == 1 and store.held().count() == fewer.count()
