"""Queries of harvesting: services' answers, made from the tables as JSON, read back as records; candidates; texts; logs; bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import papers as filing
from corvane.plans.registry import PAPERS_SQL, papers, query, read, shared_folder
from corvane.sources import harvest, records
from corvane.sources.text_store import TextStore


def _values(*cs: Column) -> Column:
    return F.filter(F.array(*(F.struct(c.alias("value")) for c in cs)), lambda x: x["value"].isNotNull())


def _item(spark: SparkSession, d: str) -> DataFrame:
    """Parts as DSpace search answers of ten items."""
    i, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    meta = F.struct(
        _values(F.when(i % 3 == 0, "none"), F.when(i % 3 == 1, F.concat(F.lit("https://doi.org/10.1234/A"), key))).alias("dc.relation.doi"), _values(F.when(i % 3 != 2, F.concat(F.lit("doi:10.1234/b"), key))).alias("dc.identifier.doi"), _values(F.col("p_name")).alias("dc.title"),
        _values(F.lit("J")).alias("dc.relation.ispartofjournal"), _values(F.lit("A1")).alias("dc.okm.type"), _values(F.lit("222 Physics"), F.lit("1182 Biology"), F.lit("222 Other")).alias("dc.okm.discipline"),
        _values(F.concat(F.lit("Dataimport, "), key), F.concat(F.lit("Person, "), key)).alias("dc.okm.affiliatedauthor"), _values(F.concat(F.lit("fi=x|en="), F.col("p_brand"), F.lit("|"))).alias("dc.contributor.organization"),
    )
    item = F.struct(F.struct(F.struct(key.alias("uuid"), meta.alias("metadata")).alias("indexableObject")).alias("_embedded"))
    rows = read(spark, d, "part").select(F.floor(i / 10).alias("page"), i.alias("i"), item.alias("o"))
    pages = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x.o).alias("objects"))
    answer = F.struct(F.struct(F.struct(F.struct(F.col("objects")).alias("_embedded")).alias("searchResult")).alias("_embedded"))
    return pages.select(F.to_json(answer).alias("answer"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN '10.1234/b' || p_partkey WHEN 1 THEN '10.1234/a' || p_partkey ELSE '' END AS doi, p_name AS title, 'J' AS journal, 2020 AS year, 'A1' AS type, '1182, 222' AS fields, 'Person, ' || p_partkey AS authors, p_brand AS units, p_partkey::VARCHAR AS uuid FROM part""")
def dspace_records(spark: SparkSession, d: str) -> DataFrame:
    rows = harvest.dspace_items(_item(spark, d), 2020)
    joined = [F.array_join(c, ", ").alias(n) for c, n in (("fields", "fields"), ("local_authors", "authors"), ("units", "units"))]
    return rows.select("doi", "title", "journal", "year", "type", *joined, "uuid")


@query("SELECT s_suppkey AS id, s_name || ' full' AS text FROM supplier WHERE s_suppkey % 3 <> 0")
def repository_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first text of each item that isn't blank."""
    s = read(spark, d, "supplier")
    i = F.col("s_suppkey")
    rows = F.array(F.struct(F.lit("ORIGINAL").alias("bundle"), F.lit(0).alias("pos"), F.lit("pdf").alias("text")), F.struct(F.lit("TEXT").alias("bundle"), F.lit(1).alias("pos"), F.lit(" \n ").alias("text")), F.struct(F.when(i % 3 == 0, "THUMBNAIL").otherwise("TEXT").alias("bundle"), F.lit(2).alias("pos"), F.concat("s_name", F.lit(" full")).alias("text")), F.struct(F.when(i % 3 == 0, "LICENSE").otherwise("TEXT").alias("bundle"), F.lit(3).alias("pos"), F.lit("later").alias("text")))
    return harvest.dspace_text(s.select(i.alias("id"), F.explode(rows).alias("r")).select("id", "r.*"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Customers as answers of a search, fifty hits a page."""
    i, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    hit = F.struct(key.alias("id"), F.when(i % 4 == 0, "PPR").otherwise("MED").alias("source"), F.when(i % 6 != 5, F.concat(F.lit("10.1234/C"), (i % 900).cast("string"))).alias("doi"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journalTitle"), key.alias("pmid"), F.when(i % 3 == 0, F.concat(F.lit("PMC"), key)).alias("pmcid"), F.when(i % 2 == 0, "Y").otherwise("N").alias("inEPMC"))
    rows = read(spark, d, "customer").select((F.floor((i - 1) / 50) + 1).alias("page"), i.alias("i"), hit.alias("h"))
    pages = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x.h).alias("result"))
    answer = F.struct(F.concat(F.lit("c"), (F.col("page") + 1).cast("string")).alias("nextCursorMark"), F.struct("result").alias("resultList"))
    return pages.select("page", F.concat(F.lit("c"), F.col("page").cast("string")).alias("cursor"), F.to_json(answer).alias("answer"))


@query("""SELECT '10.1234/c' || (c_custkey % 900) AS doi, c_name AS title, c_mktsegment AS journal, CASE WHEN c_custkey % 3 = 0 THEN 'PMC' || c_custkey END AS pmcid, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR END AS epmc_id, 2021 AS year,
  (SELECT max(c_custkey) FROM customer) > 950 AS discovery_truncated FROM customer WHERE c_custkey % 6 <> 5""")
def search_records(spark: SparkSession, d: str) -> DataFrame:
    return harvest.search_hits(_hits(spark, d), 2021, 20)


@query("""WITH h AS (SELECT '10.1234/c' || (c_custkey % 900) AS doi, c_custkey, c_custkey % 3 = 0 AS pmc FROM customer WHERE c_custkey % 6 <> 5 AND c_custkey % 900 < 300), b AS (SELECT doi, arg_max(c_custkey, {'a': pmc, 'b': c_custkey::VARCHAR}) AS k FROM h GROUP BY doi)
  SELECT doi, k::VARCHAR AS pmid, CASE WHEN k % 3 = 0 THEN 'PMC' || k ELSE '' END AS pmcid, CASE WHEN k % 4 = 0 THEN k::VARCHAR ELSE '' END AS europepmc_id, k % 2 = 0 AS open_full_text FROM b""")
def identifier_records(spark: SparkSession, d: str) -> DataFrame:
    """Of several records of a DOI, one with a PMC id."""
    wanted = spark.range(300).select(F.concat(F.lit("10.1234/c"), F.col("id").cast("string")).alias("doi"))
    return harvest.epmc_records(_hits(spark, d), wanted)


def _works(spark: SparkSession, d: str) -> DataFrame:
    """Parts as Crossref answers; every seventh isn't known."""
    i, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    date = lambda *parts: F.struct(F.array(F.array(*parts)).alias("date-parts"))
    year, month = (2000 + i % 20).cast("int"), (1 + i % 12).cast("int")
    entry = lambda url, kind, use: F.struct(url.alias("URL"), F.lit(kind).alias("content-type"), F.lit(use).alias("intended-application"))
    at = lambda n: F.concat(F.lit(f"https://x/{n}/"), key)
    message = F.struct(
        F.array(F.concat(F.lit("The <i>"), F.col("p_name"), F.lit("</i>  &amp; more"))).alias("title"), F.array(F.col("p_brand")).alias("container-title"), F.lit("P").alias("publisher"), F.lit("journal-article").alias("type"), F.concat(F.lit(" https://y/"), key).alias("URL"),
        date(year, month).alias("issued"), F.when(i % 2 == 0, date(year, month, (1 + i % 28).cast("int"))).alias("published-online"), date(year).alias("published-print"), F.array(F.struct(F.lit("Ada").alias("given"), F.concat(F.lit("L"), key).alias("family")), F.struct(F.lit("Group").alias("given"), F.lit(None).cast("string").alias("family"))).alias("author"),
        F.array(entry(at(1), "application/pdf", "similarity-checking"), entry(at(2), "text/xml", "text-mining"), entry(at(2), "application/PDF", "syndication"), entry(at(3), "unspecified", ""), entry(at(4), "text/html", "")).alias("link"),
    )
    return read(spark, d, "part").select(F.concat(F.lit("10.1234/p"), key).alias("doi"), F.when(i % 7 != 0, F.to_json(F.struct(message.alias("message")))).otherwise("{}").alias("answer"))


@query("""SELECT '10.1234/p' || p_partkey AS doi, 'The ' || p_name || ' & more' AS title, p_brand AS journal, CASE WHEN p_partkey % 2 = 0 THEN (2000 + p_partkey % 20) || '-' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') ELSE (2000 + p_partkey % 20)::VARCHAR END AS published,
  (2000 + p_partkey % 20)::VARCHAR AS issued_year, 'journal-article' AS type, CASE WHEN p_partkey <= 10 THEN 'pm' || p_partkey ELSE '' END AS pmid, '' AS pmcid, '' AS europepmc_id FROM part WHERE p_partkey % 7 <> 0""")
def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Crossref's metadata with Europe PMC's identifiers."""
    epmc = spark.range(1, 11).select(F.concat(F.lit("10.1234/p"), F.col("id").cast("string")).alias("doi"), F.concat(F.lit("pm"), F.col("id").cast("string")).alias("pmid"), F.lit("").alias("pmcid"), F.lit("").alias("europepmc_id"))
    return harvest.paper_metadata(_works(spark, d), epmc)


@query("""SELECT '10.1234/p' || p_partkey AS doi, k - 1 AS pos, 'https://x/' || (CASE k WHEN 1 THEN 2 ELSE 4 END) || '/' || p_partkey AS url, CASE k WHEN 1 THEN 'text/xml' ELSE 'text/html' END AS content_type, CASE k WHEN 1 THEN 'text-mining' END AS intended_application FROM part, (VALUES (1), (2)) AS v(k) WHERE p_partkey % 7 <> 0""")
def full_text_links(spark: SparkSession, d: str) -> DataFrame:
    return harvest.text_links(_works(spark, d))


@query("SELECT '10.1234/p' || p_partkey AS doi, 'https://y/' || p_partkey AS url, 'Ada L' || p_partkey AS authors FROM part WHERE p_partkey % 7 <> 0")
def landing_and_authors(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators.contacts import author_names

    names = F.array_join(author_names(harvest.work(F.col("answer"))["author"]), ", ")
    return _works(spark, d).select("doi", harvest.landing_url(F.col("answer")).alias("url"), names.alias("authors")).filter("url IS NOT NULL")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS i, 'https://oa/' || (l_partkey % 5) AS url, CASE l_linestatus WHEN 'O' THEN 'publishedVersion' ELSE CASE WHEN l_quantity > 25 THEN 'acceptedVersion' ELSE 'unknown' END END AS version FROM lineitem WHERE l_returnflag <> 'R'),
f AS (SELECT l_orderkey, url, arg_min(version, {'i': i, 'v': version}) AS version FROM l GROUP BY ALL) SELECT '10.1234/o' || l_orderkey AS doi, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE version WHEN 'publishedVersion' THEN 3 WHEN 'acceptedVersion' THEN 2 ELSE 0 END DESC, url) - 1)::INTEGER AS pos, url, version FROM f""")
def open_access_locations(spark: SparkSession, d: str) -> DataFrame:
    """Open PDFs of each work, the published version first."""
    version = F.when(F.col("l_linestatus") == "O", "publishedVersion").when(F.col("l_quantity") > 25, "acceptedVersion").otherwise("unknown")
    place = F.struct(F.concat(F.lit("https://oa/"), (F.col("l_partkey") % 5).cast("string")).alias("pdf_url"), (F.col("l_returnflag") != "R").alias("is_oa"), F.lit("cc").alias("license"), version.alias("version"), F.lit("").alias("landing_page_url"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", place.alias("p")))), lambda x: x.p).alias("locations"))
    answers = rows.select(F.concat(F.lit("10.1234/o"), F.col("l_orderkey").cast("string")).alias("doi"), F.to_json(F.struct(F.array(F.struct("locations")).alias("results"))).alias("answer"))
    return harvest.oa_locations(answers).select("doi", "pos", "url", "version")


@query("SELECT '10.1234/w' || (o_orderkey % 300) AS doi, min(year(o_orderdate))::INTEGER AS year FROM orders GROUP BY 1")
def website_papers(spark: SparkSession, d: str) -> DataFrame:
    """DOIs on pages by year; one on several keeps the first."""
    return harvest.website_dois(_website(spark, d))


def _website(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a facility's publication pages, some for each year."""
    cell = F.concat(F.lit('<a href="https://doi.org/10.1234/W'), (F.col("o_orderkey") % 300).cast("string"), F.lit('">x</a>'))
    pages = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"), cell.alias("c")).groupBy("year", F.pmod(F.xxhash64("c"), F.lit(16)).alias("part"))
    return pages.agg(F.array_join(F.collect_set("c"), "\n").alias("html"))


@query("""WITH site AS (SELECT o_orderkey % 300 AS i, min(year(o_orderdate))::INTEGER AS year FROM orders GROUP BY 1), held AS (SELECT n_nationkey AS i, 1990 AS year FROM nation)
SELECT '10.1234/w' || coalesce(h.i, s.i) AS doi, coalesce(h.year, s.year)::INTEGER AS year, CASE WHEN h.i IS NULL THEN 'website' END AS source FROM held h FULL JOIN site s ON s.i = h.i WHERE h.i IS NOT NULL OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = s.i)""")
def website_import(spark: SparkSession, d: str) -> DataFrame:
    """Filed papers after a website is taken in: filed ones stay in their year, unknown ones aren't filed."""
    name = lambda c: F.concat(F.lit("10.1234/w"), F.col(c).cast("string")).alias("doi")
    held = read(spark, d, "nation").select(name("n_nationkey"), F.lit(1990).alias("year"))
    known = read(spark, d, "customer").select(name("c_custkey"), F.lit("2001").alias("issued_year"))
    return filing.import_website(_website(spark, d), held, known, "2024-01-01")[0].select("doi", F.col("year").cast("int").alias("year"), "source")


def _oai_pages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as OAI-PMH answers, a page for each nation: some share a DOI, some have two."""
    i, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    cell = lambda tag, x: F.concat(F.lit(f"<dc:{tag}>"), x, F.lit(f"</dc:{tag}>"))
    ids = F.concat(cell("identifier", F.concat(F.lit("https://doi.org/10.1234/S"), (i % 40).cast("string"))), F.when(i % 7 == 0, cell("identifier", F.concat(F.lit("10.1234/t"), key))).otherwise(""), cell("identifier", F.concat(F.lit("http://portal/files/"), key)))
    record = F.concat(F.lit("<record><header><identifier>oai:x</identifier></header><metadata><oai_dc:dc>"), F.when(i % 5 != 0, cell("title", F.concat(F.lit(" "), F.col("s_name"), F.lit(" &amp; co ")))).otherwise(""), cell("creator", F.concat(F.lit("Person, "), (i % 3).cast("string"))), ids, F.lit("</oai_dc:dc></metadata></record>"))
    pages = read(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), i.alias("i"), record.alias("r")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x.r), "").alias("rs"))
    start, end = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/" xmlns:oai_dc="o" xmlns:dc="d"><ListRecords>', "</ListRecords></OAI-PMH>"
    return pages.select(F.lit(2022).alias("year"), "page", F.concat(F.lit(start), "rs", F.lit(end)).alias("answer"))


@query("""WITH r AS (SELECT s_nationkey AS page, s_suppkey AS i, CASE WHEN s_suppkey % 5 <> 0 THEN s_name || ' & co' ELSE '' END AS title, 'Person, ' || (s_suppkey % 3) AS author, 'http://portal/files/' || s_suppkey AS file, unnest(CASE WHEN s_suppkey % 7 = 0 THEN ['10.1234/s' || (s_suppkey % 40), '10.1234/t' || s_suppkey] ELSE ['10.1234/s' || (s_suppkey % 40)] END) AS doi FROM supplier)
SELECT doi, arg_min(title, {'p': page, 'i': i}) AS title, array_to_string(list_sort(list(DISTINCT file)), ' ') AS files, array_to_string(list_sort(list(DISTINCT author)), ' ') AS authors, 2022 AS year FROM r GROUP BY doi""")
def oai_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of OAI-PMH answers by DOI."""
    rows = harvest.oai_items(_oai_pages(spark, d), "http://portal/files/")
    return rows.select("doi", "title", F.array_join("files", " ").alias("files"), F.array_join("authors", " ").alias("authors"), "year")


# ---- candidates, texts, logs -------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT doi, CASE WHEN doc_id % 3 = 0 THEN '' ELSE title END AS title, fields FROM papers WHERE doc_id % 2 = 0 AND (len(fields) = 0 OR len(list_filter(fields, lambda f: f[1] IN ('1', '2', '3', '4'))) > 0)),
b AS (SELECT doi, 'from b ' || doc_id AS title, 'PMC' || doc_id AS pmcid FROM papers WHERE doc_id % 5 < 2)
SELECT coalesce(a.doi, b.doi) AS doi, coalesce(nullif(a.title, ''), nullif(b.title, '')) AS title, coalesce(array_to_string(a.fields, ','), '') AS fields, CASE WHEN a.doi IS NULL THEN 'europepmc_ack' WHEN b.doi IS NULL THEN 'repo' ELSE 'repo; europepmc_ack' END AS sources, b.pmcid FROM a FULL JOIN b ON a.doi = b.doi""")
def candidate_universe(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a repository (science only) and of a search, merged; the search's identifiers count."""
    p = papers(spark, d)
    a = p.filter("doc_id % 2 = 0").select("doi", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("title")).alias("title"), "fields", F.lit("old").alias("pmcid"))
    b = p.filter("doc_id % 5 < 2").select("doi", F.concat(F.lit("from b "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.lit(None).cast("string").alias("epmc_id"))
    rows = records.with_identifiers(records.universe([("repo", a.drop("pmcid"), True), ("europepmc_ack", b.drop("epmc_id"), False)], harvest.is_science(F.col("fields"))), b)
    return rows.select("doi", "title", F.coalesce(F.array_join("fields", ","), F.lit("")).alias("fields"), F.array_join("sources", "; ").alias("sources"), "pmcid")


@query(f"""WITH {PAPERS_SQL} SELECT doi, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'new ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 4 = 0 AND doc_id % 12 <> 0 THEN 1900 ELSE year END AS year FROM papers""")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Fresh metadata replaces what is held, where it says something."""
    p, i = papers(spark, d), F.col("doc_id")
    fresh = p.filter("doc_id % 4 = 0").select("doi", F.when(i % 8 == 0, "").otherwise(F.concat(F.lit("new "), i.cast("string"))).alias("title"), F.when(i % 12 == 0, 0).otherwise(1900).alias("year"))
    return records.overlaid(p.select("doi", "title", "year"), fresh)


_LOG = "log AS (SELECT user_id AS doi, event_id AS seq, event_type <> 'error' AS has_text, event_type FROM events)"


@query(f"WITH {_LOG} SELECT doi, seq, event_type FROM log WHERE doi % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY doi ORDER BY has_text DESC, seq DESC) = 1")
def rows_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each paper, none without text after one with; only of the universe."""
    log = read(spark, d, "events").select(F.col("user_id").alias("doi"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("has_text"), "event_type")
    kept = log.select("doi").distinct().filter("doi % 7 <> 3")
    return records.latest_screened(log, kept).select("doi", "seq", "event_type")


_STATE = f"""{PAPERS_SQL}, st AS (SELECT doi, doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN NULL ELSE 'other' END AS scope, CASE WHEN doc_id % 5 = 0 THEN 'web' ELSE 'utupub' END AS source,
  trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM papers), ok AS (SELECT *, length(t) >= 1500 AND len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) >= 200 AS article FROM st)"""


@query(f"WITH {_STATE} SELECT doi FROM ok WHERE NOT (doc_id % 3 <> 0 AND article AND coalesce(scope, '') <> 'partial' AND (coalesce(scope, '') = 'full' OR source = 'utupub'))")
def papers_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose text isn't there for good: the latest row has none, or what is held isn't reusable."""
    p, i = papers(spark, d), F.col("doc_id")
    log = p.select("doi", F.lit(1).alias("seq"), F.lit(True).alias("has_text")).unionByName(p.filter("doc_id % 3 = 0").select("doi", F.lit(2).alias("seq"), F.lit(False).alias("has_text")))
    texts = p.select("doi", "text", F.when(i % 4 == 0, "full").when(i % 4 == 1, "partial").when(i % 4 == 3, "other").alias("scope"), F.when(i % 5 == 0, "web").otherwise("utupub").alias("source"))
    return records.to_do(p.select("doi"), log, texts)


@query(f"""WITH {_STATE} SELECT doi, CASE WHEN alien THEN 'utupub' WHEN article AND doc_id % 3 = 0 THEN 'utupub' WHEN article AND doc_id % 3 = 1 THEN 'europepmc' WHEN article THEN 'crossref_fulltext' END AS source,
  CASE WHEN alien THEN 'first' WHEN NOT article THEN NULL WHEN doc_id % 3 = 2 THEN 'second' ELSE 'first' END AS url
  FROM (SELECT *, doc_id % 3 = 1 AND len(regexp_extract_all(lower(coalesce(text[1:60], '')), '[a-z0-9]{{4,}}')) < 3 AS alien FROM ok)""")
def resolved_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each paper's first usable text: a repository's if it can be the paper's own, else Europe PMC's, else a download."""
    p, i = papers(spark, d), F.col("doc_id")
    offer = lambda source, pos, text, url: F.struct(F.lit(source).alias("source"), F.lit(pos).alias("pos"), text.alias("text"), F.lit(url).alias("url"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("version"))
    text, blank = F.col("text"), F.lit(" \n ")
    alien = F.lit("Quite another text altogether. " * 200)
    offers = F.array(
        offer("utupub", 0, F.when(i % 3 == 0, text).otherwise(F.when(i % 3 == 1, alien).otherwise(blank)), "first"), offer("europepmc", 0, F.when(i % 3 == 1, text).otherwise(blank), "first"),
        offer("crossref_fulltext", 0, F.lit("Access denied"), "first"), offer("crossref_fulltext", 1, F.when(i % 3 == 2, text).otherwise(blank), "second"), offer("unheard_of", 0, alien, "never"),
    )
    rows = p.select("doi", F.explode(offers).alias("o")).select("doi", "o.*")
    return records.resolve_texts(p.select("doi", "title"), rows).select("doi", "source", "url")


@query("""
WITH u AS (SELECT s_suppkey, 'L' || s_suppkey AS last, 'F' || (s_suppkey % 7) AS first, 'g' || (s_suppkey % 10) AS grp, CASE WHEN s_suppkey % 10 < 5 THEN ['Head' || (s_suppkey % 10) || ', A'] ELSE ['Head' || (s_suppkey % 10) || ', A', 'Second' || (s_suppkey % 10) || ', B'] END AS heads FROM supplier),
t AS (SELECT o_orderkey, 'L' || (o_custkey % 50) AS last, 'F' || (o_custkey % 3) AS first, 'g' || (o_custkey % 12) AS grp, o_orderstatus, o_orderdate::DATE::VARCHAR AS day, CASE o_custkey % 3 WHEN 0 THEN 'scope-a' WHEN 1 THEN 'scope-b' ELSE 'old laser' END AS inst FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT last || ', ' || first AS group_leader, inst AS instrument, day AS date FROM t UNION SELECT h, inst, day FROM t JOIN (SELECT DISTINCT grp, unnest(heads) AS h FROM u) USING (grp) UNION SELECT last || ', ' || first, '', '2024-05-06' FROM u UNION SELECT unnest(heads), '', '2024-05-06' FROM u)
SELECT * FROM r""")
def booking_import(spark: SparkSession, d: str) -> DataFrame:
    """A booking system's export as bookings: trainings for trainees and heads of their groups, latest uses for users and heads."""
    i, g = F.col("s_suppkey"), (F.col("s_suppkey") % 10).cast("string")
    heads = F.concat(F.lit("Head"), g, F.lit(", A"))
    users = read(spark, d, "supplier").select(F.concat(F.lit("F"), (i % 7).cast("string")).alias("first_name"), F.concat(F.lit("L"), i.cast("string")).alias("last_name"), F.concat(F.lit("g"), g).alias("group"), heads.alias("one"), F.concat(F.lit("Second"), g, F.lit(", B")).alias("two"), F.lit("2024-05-06 10:00").alias("latest_use"))
    # heads are a list with commas between: surname and given name are joined by another sign in the export
    users = users.withColumn("heads", F.when(F.substring("group", 2, 1).cast("int") < 5, F.replace("one", F.lit(", "), F.lit("¸ "))).otherwise(F.concat_ws(",", F.replace("one", F.lit(", "), F.lit("¸ ")), F.replace("two", F.lit(", "), F.lit("¸ "))))).drop("one", "two")
    c = F.col("o_custkey")
    resource = F.when(c % 3 == 0, "The Scope-A in room 1").when(c % 3 == 1, "SCOPE B").otherwise(" Old laser ")
    trainings = read(spark, d, "orders").select(F.concat(F.lit("F"), (c % 3).cast("string")).alias("first_name"), F.concat(F.lit("L"), (c % 50).cast("string")).alias("last_name"), F.concat(F.lit("g"), (c % 12).cast("string")).alias("group"), F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Open").alias("status"), F.col("o_orderdate").alias("created"), resource.alias("resource"))
    rows = records.import_bookings(users, trainings, [("scope-a", "scope-a"), ("scope b", "scope-b")])
    return rows.withColumn("group_leader", F.replace("group_leader", F.lit("¸ "), F.lit(", ")))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS trainings, count(*)::BIGINT AS users, count(DISTINCT s_suppkey % 10)::BIGINT AS groups, 2::BIGINT AS booking_rows, 2::BIGINT AS people FROM supplier""")
def booking_counts(spark: SparkSession, d: str) -> DataFrame:
    users = read(spark, d, "supplier").select((F.col("s_suppkey") % 10).cast("string").alias("group"))
    bookings = spark.createDataFrame([("A, B", "x", "2020"), ("C, D", "x", "2020")], "group_leader string, instrument string, date string")
    return records.booking_counts(users, read(spark, d, "orders").filter("o_orderstatus = 'F'"), bookings)


@query("""WITH t AS (SELECT '10.1234/s' || doc_id AS doi, CASE WHEN doc_id % 3 = 0 THEN 'later' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 1 OR doc_id % 3 = 0)
SELECT doi, source, md5(text) AS text_md5 FROM t WHERE doi IN (SELECT '10.1234/s' || doc_id FROM labels WHERE quality = 1)""")
def stored_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored in two goes, the second replacing a third of the first, then looked up for confirmed papers."""
    doi = lambda c: F.concat(F.lit("10.1234/s"), c.cast("string"))
    rows = read(spark, d, "documents").select("doc_id", doi(F.col("doc_id")).alias("doi"), "source", "text")
    store = TextStore(spark, shared_folder(spark, "texts"), 32)
    store.store(rows.filter("doc_id % 4 <> 1"))
    store.store(rows.filter("doc_id % 3 = 0").select("doi", F.lit("later").alias("source"), F.concat("text", F.lit(" again")).alias("text")))
    wanted = read(spark, d, "labels").filter("quality = 1").select(doi(F.col("doc_id")).alias("doi"))
    return store.look_up(wanted).select("doi", "source", F.md5("text").alias("text_md5"))


@query("SELECT c_custkey AS doi FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 30 DAYS)")
def texts_to_retry(spark: SparkSession, d: str) -> DataFrame:
    """Papers that weren't looked for in vain in the last thirty days."""
    markers = read(spark, d, "orders").select(F.col("o_custkey").alias("doi"), F.col("o_orderdate").alias("at"))
    return records.to_retry(read(spark, d, "customer").select(F.col("c_custkey").alias("doi")), markers, F.lit("1998-06-01").cast("timestamp"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM benchmark")
def full_text_answers(spark: SparkSession, d: str) -> DataFrame:
    """Text of full-text answers in XML."""
    body = F.concat(F.lit("<article><p>"), F.replace("text", F.lit(" "), F.lit("</p> <p>")), F.lit("</p></article>"))
    return read(spark, d, "benchmark").select("item_id", T.normalise(harvest.xml_text(body)).alias("text"))
