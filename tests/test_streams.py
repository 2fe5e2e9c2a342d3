"""Streams that stop and go on: the log of a sweep, and markers that expire."""

import datetime as dt
from itertools import count

import pytest
from pyspark.sql import functions as F

from corvane.operators import screening
from corvane.plans import streamed, sweep
from corvane.sources import records
from corvane.streaming import retries, sweep_log
from tests.test_screening import RULES

KIND = "doi string, text string"
THANKS = "We thank the Example Imaging Core."


def screen(batch):
    best = batch.groupBy("doi").agg(F.max("text").alias("text"))
    return screening.screen(best, RULES).select("doi", "category", "has_text")


def deliver(spark, folder, number, rows):
    """One delivery is one file; streams take files by their time, so a later one comes later."""
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/answers/{number}")


DELIVERIES = [[("a", None), ("b", THANKS), ("c", None)], [("a", THANKS), ("b", None)], [("a", None), ("d", "Nothing."), ("c", " ")], [("c", None), ("d", THANKS)]]


def in_force(spark, folder):
    return {r.doi: (r.category, r.seq) for r in records.latest_screened(sweep_log.logged(spark, f"{folder}/log")).collect()}


def test_a_stream_that_fails_and_goes_on_gives_what_batches_give(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for k, rows in enumerate(DELIVERIES):
        deliver(spark, folder, k, rows)
    calls = count()

    def failing(batch):
        if next(calls) == 2:
            raise RuntimeError("a lost executor")
        return screen(batch)

    answers = lambda: sweep_log.arriving(spark, f"{folder}/answers", KIND, 1)
    with pytest.raises(Exception, match="a lost executor"):
        sweep_log.run(answers(), f"{folder}/log", failing)
    assert in_force(spark, folder) == {"a": ("A", 1), "b": ("A", 0), "c": ("N", 0)}
    sweep_log.run(answers(), f"{folder}/log", failing)
    assert in_force(spark, folder) == {"a": ("A", 1), "b": ("A", 0), "c": ("N", 3), "d": ("A", 3)}
    # what a batch adds doesn't depend on how often it is tried: given again, it replaces itself
    before = sorted(map(tuple, sweep_log.logged(spark, f"{folder}/log").collect()))
    sweep_log.sink(f"{folder}/log", screen)(spark.createDataFrame(DELIVERIES[3], KIND), 3)
    assert sorted(map(tuple, sweep_log.logged(spark, f"{folder}/log").collect())) == before
    # and nothing new means nothing added
    sweep_log.run(answers(), f"{folder}/log", failing)
    assert sorted(map(tuple, sweep_log.logged(spark, f"{folder}/log").collect())) == before
    # the whole log in one batch has the same papers and categories
    whole = screen(spark.createDataFrame([r for rows in DELIVERIES for r in rows], KIND)).collect()
    assert {r.doi: r.category for r in whole if r.doi != "d"} == {d: c for d, (c, _) in in_force(spark, folder).items() if d != "d"}


def test_there_is_no_log_before_the_first_batch(spark, tmp_path):
    assert sweep_log.logged(spark, f"file://{tmp_path}/none") is None


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


SEARCHES = [[("a", False, 0), ("b", False, 5), ("c", False, 10), ("c", True, 12), ("e", False, 1), ("e", False, 33), (None, False, 3), ("f", False, None), ("g", False, 2), ("g", True, 2)], [("b", True, 35), ("d", False, 36), ("h", None, 36)], [("z", True, 70)]]


def plain_due(rows, mark, days=30):
    """Markers that ended before anything newer was heard, by plain Python."""
    heard = {}
    for doi, found, day in rows:
        if doi is not None and day is not None:
            heard.setdefault(doi, {})[day] = heard.get(doi, {}).get(day, False) or bool(found)
    out = []
    for doi, searches in heard.items():
        days_ = sorted(searches)
        for day, after in zip(days_, [*days_[1:], None]):
            if not searches[day] and (after > day + days if after is not None else day + days <= mark):
                out.append((doi, at(day + days)))
    return sorted(out)


@pytest.mark.parametrize("together", [False, True])
def test_markers_expire_in_event_time(spark, tmp_path, together):
    folder, kind = f"file://{tmp_path}", "doi string, found boolean, at timestamp"
    retries.with_timers(spark)
    deliveries = [[r for rows in SEARCHES for r in rows]] if together else SEARCHES
    for rows in deliveries:
        spark.createDataFrame([(d, f, None if x is None else at(x)) for d, f, x in rows], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(kind).parquet(f"{folder}/in")
        q = retries.due_again(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.doi, r.due) for r in spark.read.schema("doi string, due timestamp").parquet(f"{folder}/out").collect())
    assert got == plain_due([r for rows in SEARCHES for r in rows], 69) and ("a", at(30)) in got and ("e", at(31)) in got and not any(d in ("b", "c", "g") for d, _ in got)
    # the same papers as a batch question at the end: due or never marked
    latest = spark.createDataFrame([("a", at(0)), ("d", at(36)), ("e", at(33)), ("h", at(36))], "doi string, at timestamp")
    again = {r.doi for r in records.to_retry(latest.select("doi"), latest, F.lit(at(69))).collect()}
    assert again == {d for d, _ in got}


def test_late_news_of_a_vain_search_marks_no_found_paper(spark, tmp_path):
    """Rows within the watermark's delay count at their time, and no Python sees them."""
    folder, kind = f"file://{tmp_path}", "doi string, found boolean, at timestamp"
    retries.with_timers(spark)
    for rows in ([("a", True, 12.0), ("b", False, 12.0)], [("a", False, 11.5), ("b", True, 11.5)], [("z", True, 70.0)]):
        spark.createDataFrame([(d, f, at(x)) for d, f, x in rows], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        due = retries.due_again(spark.readStream.schema(kind).parquet(f"{folder}/in"))
        assert "Python" not in due._jdf.queryExecution().analyzed().toString()
        due.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.schema("doi string, due timestamp").parquet(f"{folder}/out").collect()] == [("b", at(42))]


def test_answers_are_screened_without_a_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(streamed.sweep_log, "run", lambda answers, path, screen: seen.append(screen(answers)._jdf.queryExecution().analyzed().toString()))
    monkeypatch.setattr(streamed.sweep_log, "logged", lambda *_: spark.createDataFrame([], "doi string, category string, has_text boolean, seq long"))
    streamed.sweep_log_stream(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("Join" in plan for plan in seen)


# ---- a sweep with held texts


def test_held_texts_spare_a_search_or_stand_in(spark):
    article = "We thank the Example Imaging Core. " + "Words of an article that goes on and on without end. " * 60
    papers = spark.createDataFrame([(d, "Words of an article") for d in ("whole", "part", "failed", "none", "had")], "doi string, title string")
    candidates = papers.selectExpr("doi", "title", "2020 AS year", "'A1' AS type", "array('118') AS fields", "array('A, B') AS local_authors", "array('x') AS units", "array('repo') AS sources")
    held = spark.createDataFrame([("whole", article + "Held.", "full", "crossref_fulltext"), ("part", article + "Part.", "partial", "europepmc"), ("failed", "Thank you.", None, "openalex_oa")], "doi string, text string, scope string, source string")
    offers = spark.createDataFrame([(d, "crossref_fulltext", 0, article + "New.", "u", "l", "v") for d in ("whole", "part")], "doi string, source string, pos int, text string, url string, license string, version string")
    got = {r.doi: r for r in sweep.texts_of(papers, held, offers).collect()}
    assert {d: (r.text and r.text[-5:], r.is_new) for d, r in got.items()} == {"whole": ("Held.", False), "part": (" New.", True), "failed": (" you.", False), "none": (None, False), "had": (None, False)}
    assert got["part"].license == "l" and got["failed"].source == "openalex_oa" and got["whole"].url is None
    log = spark.createDataFrame([("had", 0, True), ("had", 1, False), ("none", 0, False)], "doi string, seq long, has_text boolean")
    past = spark.createDataFrame([], "local_authors array<string>, year int")
    public, _, texts = sweep.sweep(candidates, log, held, offers, past, RULES)
    rows = {r.doi: (r.category, r.has_text, r.text_source) for r in public.collect()}
    assert rows == {"whole": ("A", True, "crossref_fulltext"), "part": ("A", True, "crossref_fulltext"), "failed": ("G", True, "openalex_oa"), "none": ("N", False, None)} and [r.doi for r in texts.collect()] == ["part"]
