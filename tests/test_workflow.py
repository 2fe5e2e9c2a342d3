"""A year from vectors to tables, and the small readers and formats around it."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import papers, ranking, reports, sheets
from corvane.plans import registry, workflow
from corvane.sources import harvest, records
from tests.test_screening import RULES, screened


def store(spark, ids, rng, centre):
    rows = []
    for i in ids:
        v = rng.normal(size=6) * 0.2 + centre
        rows.append((f"10.1/{i}", (v / np.linalg.norm(v)).tolist(), f"{'cells imaged' if centre[0] else 'survey of prices'} paper {i}"))
    return spark.createDataFrame(rows, "doi string, vector array<double>, chunk_text string")


def test_a_year_is_ranked_by_what_other_years_teach(spark):
    rng = np.random.default_rng(2)
    a, b = np.eye(6)[0] * 2, np.eye(6)[1] * 2
    own = store(spark, [f"g{i}" for i in range(5)], rng, a).unionByName(store(spark, [f"b{i}" for i in range(5)], rng, b))
    known = store(spark, [f"k{i}" for i in range(12)], rng, a)
    others = store(spark, [f"o{i}" for i in range(12)], rng, b).unionByName(store(spark, ["flagged", "rejected"], rng, b))
    screened_ = spark.createDataFrame([("10.1/g0", 2020, "report", "A", 3, "t"), ("10.1/flagged", 2019, "check", "B", 0, "t"), ("10.1/rejected", 2019, "check", "B", 0, "t")], "doi string, year int, priority string, category string, microscopy_terms int, title string")
    confirmed = known.select("doi", F.lit(2018).alias("year")).unionByName(spark.createDataFrame([("10.1/g1", 2020)], "doi string, year int"))
    decisions = spark.createDataFrame([("10.1/g2", 2020, "yes"), ("10.1/rejected", 2019, "no")], "doi string, year int, verdict string")
    ranked = workflow.prepare(2020, own, known, others, screened_, confirmed, decisions, F.lit("stamp"))
    rows = {r.id: r for r in ranked.collect()}
    assert sorted(r.embedding_rank for r in rows.values()) == list(range(1, 11)) and all(rows[f"10.1/g{i}"].embedding_rank <= 5 for i in range(5))
    assert all(rows[f"10.1/g{i}"].tfidf_rank <= 5 and rows[f"10.1/g{i}"].tfidf > rows[f"10.1/b{i}"].tfidf for i in range(5))
    assert rows["10.1/g1"].listed and rows["10.1/g2"].listed and rows["10.1/g0"].flagged and not rows["10.1/g3"].listed and rows["10.1/g3"].rules_version == "stamp"
    hits = ranking.top_hits(ranked, ("embedding", "tfidf", "microscopy_terms"), (5, 10)).collect()
    assert {r.n: (r.embedding, r.tfidf, r.new) for r in hits} == {5: (2, 2, 2), 10: (2, 2, 7)}
    assert workflow.format_hits(hits, 2, 10).splitlines()[0] == "10 papers ranked, 2 of them confirmed"
    alone = workflow.prepare(2020, own, known, others.limit(0), screened_, confirmed, decisions, F.lit("stamp"))
    assert {r.id for r in alone.filter("embedding_rank <= 5").collect()} == {f"10.1/g{i}" for i in range(5)}


def test_the_tables_of_a_year(spark):
    text = "We thank the Example Imaging Core for its STEDY 5. Correspondence: ann@lab.org."
    got = screened(spark, {"doi": "10.1/new", "text": text, "title": "New one", "year": 2020}, {"doi": "10.1/old", "text": "Nothing.", "title": "Old one", "year": 2020})
    rows = spark.createDataFrame([(r.doi, r.title, "J", r.year, r.priority, r.category, r.score_reasons, r.acknowledgement, r.evidence, r.has_text) for r in got.values()], "doi string, title string, journal string, year int, priority string, category string, score_reasons array<string>, acknowledgement array<string>, evidence array<string>, has_text boolean")
    confirmed = spark.createDataFrame([("10.1/old", 2020, "Old one"), ("10.1/lost", 2020, "Lost")], "doi string, year int, title string")
    ranked = spark.createDataFrame([("10.1/like", 2020, 1), ("10.1/new", 2020, 2)], "id string, year int, embedding_rank int")
    previous = spark.createDataFrame([("10.1/NEW", "Yes", "x", "", 1), ("10.1/gone", "likely", "", "n", 2)], "doi string, verdict string, reason string, note string, pos long")
    texts = spark.createDataFrame([("10.1/new", text), ("10.1/old", "Nothing.")], "doi string, text string")
    contacts = spark.createDataFrame([("10.1/new", [("Ann", "ann@lab.org")])], "doi string, contacts array<struct<name:string,email:string>>")
    universe = rows.select("doi")
    tables, lines = workflow.collect(2020, rows, confirmed, ranked, previous, texts, contacts, universe, RULES)
    listed = [(r.why, r.doi, r.acknowledges_facility, r.verdict) for r in tables["validate"].orderBy("listing", "doi").collect()]
    assert listed == [("new: acknowledges the facility", "10.1/new", "yes", "yes"), ("reads like facility papers (rank 1)", "10.1/like", "unknown (no full text)", ""), ("earlier verdict (no longer a candidate)", "10.1/gone", "unknown (no full text)", "likely")]
    people = [(r.email, r.status, r.dois) for r in tables["contacts"].orderBy("place").collect()]
    assert people == [("ann@lab.org", "confirmed", "10.1/new"), ("", "confirmed", "10.1/lost"), ("", "confirmed", "10.1/old"), ("", "likely", "10.1/gone")]
    missed = {r.doi: r.why_missed for r in tables["search_misses"].collect()}
    assert missed == {"10.1/old": "text found, ranked low (category G)", "10.1/lost": "not among the year's candidates (institutional sources, Europe PMC)"} and [r.line for r in lines.collect()] == ["10.1/new 2020"]


def test_feedback_is_told_in_words(spark):
    rows = [(2020, "d1", "reads like facility papers (rank 7)", 7, "yes", ""), (2020, "d2", "new: acknowledges the facility", None, "no", ""), (2020, "d3", "new: acknowledges the facility", None, "yes", "")]
    text = workflow.feedback(spark.createDataFrame(rows, "year int, doi string, why string, embedding_rank int, verdict string, reason string"))
    assert "Verdicts by why a paper was shown\nshown because  verdicts  yes  likely  no  share of yes\n" in text and "  1-50         1    1" in text
    assert "acknowledges       1  (no reason given)" in text and "2020      7   d1" in text and workflow.feedback(spark.createDataFrame([], "year int, doi string, why string, embedding_rank int, verdict string, reason string")) == "No verdicts yet"


def test_recall_is_told_in_words(spark):
    kind = "doi string, year int"
    counts = reports.with_interval(reports.recall(spark.createDataFrame([("a", 2020), ("b", 2020)], kind), spark.createDataFrame([("a", 2020, "report", True), ("c", 2021, "check", True)], kind + ", priority string, has_text boolean"), spark.createDataFrame([("a", 2020)], kind)))
    lines = reports.format_recall(counts.collect()).splitlines()
    assert len(lines) == 4 and lines[2].split()[:5] == ["2020", "2", "1", "50", "%"] and lines[3].split()[:4] == ["2021", "0", "0", "-"]


def test_filed_papers_are_checked_file_by_file(spark, tmp_path):
    files = {
        "2020": ['{"doi": "10.1234/b", "source": "staff"}', '{"doi": "10.1234/a", "source": "a.b@c.org"}', '{"doi": "10.1234/A"}', '{"title": "no doi"}', ""], "2021": ['{"doi": "10.1234/a", "source": "staff", "note": null}', '{"doi": "10.1234/new"}'],
        "2022": ['{"doi": "10.1234/x"', '{"doi": "10.1234/a"}'], "2023": ['{"doi": "10.1234/a"}', '["10.1234/a"]'], "drafts": ['{"doi": "10.1234/a"}', "{"],
    }
    for year, lines in files.items():
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "part-0.json").write_text("\n".join(lines))
    known = spark.createDataFrame([("10.1234/a",), ("10.1234/b",)], "doi string")
    got = papers.check_papers(papers.filed_lines(spark, str(tmp_path)), known, known)
    shape = "the DOI is missing or not in its short lower-case form"
    assert sorted(map(tuple, got.na.fill("").collect())) == sorted([
        ("2020", "", "DOIs are out of order"), ("2022", "", "lines of the file are no JSON"), ("2023", "", "the file holds more than entries"), ("drafts", "", "the file's name is no year"), ("2020", "10.1234/A", shape), ("2020", "", shape),
        ("2020", "10.1234/a", "an e-mail address is in it"), ("2021", "10.1234/a", "stands in 2020 and in 2021"), ("2021", "10.1234/a", "has fields that aren't public: note"), ("2021", "10.1234/new", "new, and nothing tells who confirmed it"), ("2021", "10.1234/new", "new, and no registry knows its DOI"),
    ])


def test_texts_of_pdfs_and_markers(spark):
    files = spark.createDataFrame([(1, 0, b"<html>"), (1, 1, b"%PDF-blank"), (1, 2, b"%PDF-good"), (2, 0, b"%PDF-bad"), (3, 0, None)], "id long, pos int, content binary")
    read = lambda c: {b"%PDF-blank": " \n", b"%PDF-good": "text"}.get(bytes(c))
    assert [tuple(r) for r in records.pdf_texts(files, read).collect()] == [(1, "text")]
    now = dt.datetime(2024, 5, 31)
    marks = spark.createDataFrame([("a", dt.datetime(2024, 5, 20)), ("b", dt.datetime(2024, 4, 1))], "doi string, at timestamp")
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "doi string")
    assert sorted(r.doi for r in records.to_retry(papers, marks, F.lit(now)).collect()) == ["b", "c"]


def test_filed_papers_are_read_back(spark, tmp_path):
    path = str(tmp_path / "papers")
    records.write_papers(spark.createDataFrame([("10.1234/B", "t", 2020), ("nothing", "t", 2021)], "doi string, title string, year int"), path)
    assert [(r.doi, r.year) for r in records.read_papers(spark, path).collect()] == [("10.1234/b", 2020)] and records.read_papers(spark, str(tmp_path / "none")).count() == 0


def test_searches_that_fail_or_are_cut(spark):
    assert harvest.acknowledgement_query(["A"], ["1"], 2020, "Town") == '((ACK_FUND:"A" OR METHODS:"A") AND (ACK_FUND:Town OR METHODS:Town OR AFF:Town)) OR ACK_FUND:"1"'.join(["(", ") AND PUB_YEAR:2020"])
    pages = spark.createDataFrame([(1, "*", '{"nextCursorMark": "x", "resultList": {"result": [{"doi": "10.1234/a"}]}}')], "page int, cursor string, answer string")
    assert harvest.search_hits(pages, 2020, 1).first().discovery_truncated and not harvest.search_hits(pages, 2020, 2).first().discovery_truncated
    broken = spark.createDataFrame([(1, "*", "<html>")], "page int, cursor string, answer string")
    try:
        harvest.search_hits(broken, 2020).collect()
        raise AssertionError("an answer that can't be read must be an error")
    except Exception as e:
        assert "cut short" in str(e)


def test_queries_have_sql_or_a_reason():
    from corvane.plans import catalogue, harvested, ranked, review, streamed  # noqa: F401  they register their queries

    assert set(registry.QUERIES) - set(registry.ORACLES) == {"logreg_rank", "embedded_papers", "tfidf_logreg"}


def test_a_website_files_new_papers_and_moves_none(spark):
    page = lambda *dois: " ".join(f'<a href="https://doi.org/{d}">x</a>' for d in dois)
    pages = spark.createDataFrame([(2021, page("10.1234/A", "10.1234/held")), (2020, page("10.1234/a", "10.1234/a", "10.1234/unknown")), (2019, None), (2018, "")], "year int, html string")
    filed = spark.createDataFrame([("10.1234/held", 2010, "staff"), ("10.1234/other", 2011, "staff")], "doi string, year int, source string")
    known = spark.createDataFrame([("10.1234/a", "2019", "T"), ("10.1234/held", "2021", "H")], "doi string, issued_year string, title string")
    after, statuses = papers.import_website(pages, filed, known, "2024-01-01")
    assert sorted((r.doi, r.year, r.source, r.title, r.added) for r in after.collect()) == [("10.1234/a", 2020, "website", "T", "2024-01-01"), ("10.1234/held", 2010, "staff", None, None), ("10.1234/other", 2011, "staff", None, None)]
    assert sorted((r.doi, r.status) for r in statuses.collect()) == [("10.1234/a", "added"), ("10.1234/held", "already"), ("10.1234/unknown", "unknown doi")]
    again, told = papers.import_website(pages, after, known, "2025-01-01")
    assert again.count() == 3 and {r.status for r in told.collect()} == {"already", "unknown doi"}
    assert papers.import_website(pages.limit(0), filed, known, "2024-01-01")[0].count() == 2


def test_the_private_sheet_has_the_public_columns_and_its_own_order(spark):
    empty = [(k, None) for k in ("local_email", "other_local_imaging")]
    row = lambda doi, category, score, priority: {"doi": doi, "category": category, "score": score, "priority": priority, "title": "t", **dict(empty)}
    words = "array<string>"
    kind = f"doi string, category string, score int, priority string, title string, local_email boolean, other_local_imaging boolean, score_reasons {words}, local_authors {words}, instruments_strong {words}, instruments_weak {words}, techniques_specialist {words}, microscopy_terms int, fingerprints map<string,{words}>, credited_elsewhere {words}, acknowledgement {words}, affiliation_only {words}, evidence {words}"
    rows = spark.createDataFrame([row("a", "A", 10, "report"), row("b", "G", 1, "low"), row("c", "G", 1, "low"), row("d", "G", None, None), row("e", "B", 4, "low")], kind)
    private = spark.createDataFrame([("b", 7, "check", ["+3 x", "+3 y"]), ("c", 2, "low", ["+1 x"]), ("e", 14, "report", ["+10 x"])], "doi string, score int, priority string, reasons array<string>")
    listed, users = spark.createDataFrame([("d",), ("d",)], "doi string"), spark.createDataFrame([("a",), ("a",)], "doi string")
    public = sheets.review_rows(rows, listed)
    sheet = sheets.private_review(rows, private, listed, users)
    assert sheet.columns == ["private_priority", "private_score", "private_reasons", "known_user_match", *public.columns]
    got = sheet.orderBy("review_place").collect()
    assert [(r.doi, r.private_priority, r.private_score, r.private_reasons, r.known_user_match, r.score, r.confirmed) for r in got] == [("e", "report", 14, "+10 x", False, 4, False), ("a", "report", 10, "", True, 10, False), ("b", "check", 7, "+3 x; +3 y", False, 1, False), ("d", None, 0, "", False, None, True)]
    assert [r.doi for r in public.orderBy("review_place").collect()] == ["a", "e", "d"]
