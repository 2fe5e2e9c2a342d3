"""Paged services as data sources, over openers of our own."""

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from corvane.sources import harvest, services


def asked(url):
    return {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(url).query).items()}


def logged(log):
    """The requests so far, from the file that openers write to in tasks."""
    return [asked(u) for u in log.read_text().split()] if log.exists() else []


def repository(log, pages=3, broken=()):
    """A DSpace of two items a page; each year has ``pages`` pages."""

    def ask(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        q = asked(url)
        year, page = int(q["query"].split(":")[1].split(" ")[0]), int(q["page"])
        if page in broken:
            return broken[page]
        field = lambda *v: [{"value": x} for x in v]
        items = [{"_embedded": {"indexableObject": {"uuid": f"u{page}-{k}", "metadata": {"dc.relation.doi": field(f"10.1234/{year}.{page}.{k}"), "dc.title": field("T é"), "dc.okm.discipline": field("222 Physics")}}}} for k in range(2)]
        return json.dumps({"_embedded": {"searchResult": {"page": {"totalPages": pages}, "_embedded": {"objects": items}}}}).encode()

    return ask


def test_a_repository_is_read_page_by_page_and_the_year_is_pushed(spark, tmp_path):
    log = tmp_path / "log"
    table = services.answers(spark, services.Dspace("https://repo.example/api"), repository(str(log)))
    df = table.filter("year = 2021")
    assert df.rdd.getNumPartitions() == 3 and "2021" in df._jdf.queryExecution().toString()
    rows = df.collect()
    assert sorted((r.year, r.page, r.cut) for r in rows) == [(2021, 0, False), (2021, 1, False), (2021, 2, False)]
    assert {q["query"] for q in logged(log)} == {"dc.year.issued:2021 AND dc.relation.doi:[* TO *]"} and {q["page"] for q in logged(log)} == {"0", "1", "2"}


def test_years_come_from_any_filter_that_names_them(spark, tmp_path):
    table = services.answers(spark, services.Dspace("https://repo.example/api"), repository(str(tmp_path / "log"), 1))
    assert sorted(r.year for r in table.filter("year IN (2020, 2022, 2023) AND year <> 2022 AND page = 0").collect()) == [2020, 2023]
    assert table.filter("year = 2020 AND year = 2021").collect() == []
    with pytest.raises(Exception, match="which year"):
        table.filter("year > 2020").collect()


def test_candidates_of_a_repository(spark, tmp_path):
    rows = services.candidates(spark, services.Dspace("https://repo.example/api"), [2020, 2021], repository(str(tmp_path / "log"))).collect()
    assert {r.doi: r.year for r in rows} == {f"10.1234/{y}.{p}.{k}": y for y in (2020, 2021) for p in range(3) for k in range(2)}
    assert rows[0].title == "T é" and rows[0].fields == ["222"] and rows[0].base_url == "https://repo.example/api"


@pytest.mark.parametrize("answer", [None, b"<html>", b"[]", b'{"_embedded": {}}'])
def test_a_page_that_fails_is_an_error(spark, tmp_path, answer):
    with pytest.raises(Exception, match="no answer|no JSON|lists nothing"):
        services.candidates(spark, services.Dspace("https://repo.example/api"), [2020], repository(str(tmp_path / "log"), broken={2: answer})).collect()


RECORD = '<record><header><identifier>oai:x:{i}</identifier></header><metadata><oai_dc:dc xmlns:oai_dc="o" xmlns:dc="d"><dc:title> Title {i} &amp; more </dc:title><dc:creator>Person, {i}</dc:creator>{ids}</oai_dc:dc></metadata></record>'


def oai(log, last):
    """Answers of two records; ``last`` maps a token to what follows its answer."""

    def ask(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        q = asked(url)
        n = int(q.get("resumptionToken", "t 0").split()[1])
        records = "".join(RECORD.format(i=i, ids=f"<dc:identifier>https://doi.org/10.1234/A{i // 3}</dc:identifier><dc:identifier>http://portal/files/{i}</dc:identifier>") for i in (2 * n, 2 * n + 1))
        token = last.get(n, "")
        if token is None or token == "broken":
            return None if token is None else b"<OAI-PMH><record>"
        return f'<?xml version="1.0" encoding="UTF-8"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{records}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>'.encode()

    return ask


def test_tokens_are_followed_to_the_end(spark, tmp_path):
    log = tmp_path / "log"
    service = services.Oai("http://portal/ws/oai")
    rows = {r.doi: r for r in services.candidates(spark, service, [2022], oai(str(log), {0: "t 1", 1: "t 2"}), file_prefix="http://portal/files/").collect()}
    assert {d: (r.title, r.year, len(r.files)) for d, r in rows.items()} == {"10.1234/a0": ("Title 0 & more", 2022, 3), "10.1234/a1": ("Title 3 & more", 2022, 3)} and rows["10.1234/a1"].authors == ["Person, 3", "Person, 4", "Person, 5"]
    assert [q.get("resumptionToken", q.get("set")) for q in logged(log)] == ["publications:year2022", "t 1", "t 2"]


@pytest.mark.parametrize(("last", "message"), [({0: "t 1", 1: None}, "no answer to page 1"), ({0: "t 1", 1: "broken"}, "no XML"), ({0: "t 1", 1: "t 1"}, "leads back")])
def test_a_walk_that_fails_is_an_error(spark, tmp_path, last, message):
    with pytest.raises(Exception, match=message):
        services.answers(spark, services.Oai("http://portal/ws/oai"), oai(str(tmp_path / "log"), last)).filter("year = 2022").collect()


def search(url):
    """Cursor answers: three pages of one hit in even years, an empty first page in odd ones."""
    q = asked(url)
    year = int(q["query"].rsplit(":", 1)[1])
    at = 0 if q["cursorMark"] == "*" else int(q["cursorMark"])
    hits = [] if year % 2 else [{"doi": f"10.1234/H{at}", "title": "t", "source": "PPR", "id": f"PPR{at}"}]
    return json.dumps({"nextCursorMark": str(min(at + 1, 2)), "resultList": {"result": hits}}).encode()


def test_cursors_are_followed_and_a_cut_is_marked(spark):
    service = services.EuropePmc("https://search.example", ("Core",), "Town", max_pages=20)
    rows = services.candidates(spark, service, [2020, 2021], search).collect()
    assert sorted((r.doi, r.year, r.epmc_id, r.discovery_truncated) for r in rows) == [(f"10.1234/h{k}", 2020, f"PPR{k}", False) for k in range(3)]
    cut = services.candidates(spark, services.EuropePmc("https://search.example", ("Core",), "Town", max_pages=2), [2020], search).collect()
    assert sorted((r.doi, r.discovery_truncated) for r in cut) == [("10.1234/h0", True), ("10.1234/h1", True)]
    with pytest.raises(Exception, match="holds no results"):
        services.candidates(spark, service, [2020], lambda url: b'{"error": "busy"}').collect()


def test_a_fetcher_tells_what_became_of_a_request():
    waits, told = [], iter([(429, b"wait", {}), OSError("line"), (200, b"{", {"Content-Type": "text/x"}, "http://final")])

    def opener(url, timeout):
        got = next(told)
        if isinstance(got, Exception):
            raise got
        return got

    ask = harvest.Fetcher(opener=opener, sleep=waits.append)
    got = ask.answer("http://Host.Example/x")
    assert (got.body, got.status, got.url, got.content_type, got.error) == (b"{", 200, "http://final", "text/x", "") and waits == [10.0, 2.0]
    told = iter([(404, b"", {})])
    assert ask.answer("http://host.example/y").error == "status 404"
    told = iter([(200, b"{", {})])
    assert ask.json("http://host.example/z") is None
    told = iter([(429, b"daily Budget is used up", {})])
    assert ask("http://HOST.example/z") is None and ask.exhausted == {"host.example"} and ask.answer("http://host.example/z").error == "host.example asked for patience"


def test_batches_hold_no_more_than_they_should(spark):
    got = harvest.batches_of(spark.range(3000).select(F.concat(F.lit("10.1234/"), (F.col("id") % 2999).cast("string")).alias("doi")), 20).collect()
    sizes = [r.query.count("DOI:") for r in got]
    assert max(sizes) == 20 and sum(sizes) == 2999 and len({r.batch for r in got}) == len(got) < 160
