"""Publication records of four services, read from the JSON and XML they answer with, as tables.

Answers are staged as files or columns by whoever fetches them (``Fetcher`` holds the rules of doing so); what is done
with them is DataFrame work. Column functions take an answer as a string; readers take a folder of answers.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corvane.functions.text import blank, doi, present

_DOI = r"10\.[0-9]{4,9}/[^\s<>\"']+"
_FIELD = "array<struct<value:string>>"
#: First digits of science fields, how placeholder authors begin, how OA versions are preferred.
SCIENCE_FIELDS = ("1", "2", "3", "4")
PLACEHOLDERS = "^(dataimport|data import)"
VERSIONS = {"publishedVersion": 3, "acceptedVersion": 2, "submittedVersion": 1}


def is_science(fields: Column) -> Column:
    """Whether a record has no field of science, or one of the sciences."""
    return (F.coalesce(F.size(fields), F.lit(0)) <= 0) | F.exists(fields, lambda f: F.substring(f, 1, 1).isin(*SCIENCE_FIELDS))


def clean_authors(names: Column) -> Column:
    """Without entries that aren't people."""
    return F.filter(names, lambda n: ~F.lower(n).rlike(PLACEHOLDERS))


# ---- DSpace ----------------------------------------------------------------------------------------------------


def dspace_items(pages: DataFrame, year: int | Column, doi_fields: tuple[str, ...] = ("dc.relation.doi", "dc.identifier.doi"), base_url: str = "") -> DataFrame:
    """Candidates of search pages (answer): one row an item, its DOI the first that is one among ``doi_fields``, empty if none is."""
    names = [*dict.fromkeys([*doi_fields, "dc.title", "dc.relation.ispartofjournal", "dc.okm.type", "dc.okm.discipline", "dc.okm.affiliatedauthor", "dc.contributor.organization"])]
    meta = ",".join(f"`{n}`:{_FIELD}" for n in names)
    kind = f"struct<_embedded:struct<searchResult:struct<_embedded:struct<objects:array<struct<_embedded:struct<indexableObject:struct<uuid:string,metadata:struct<{meta}>>>>>>>>>"
    item = F.from_json("answer", kind)["_embedded"]["searchResult"]["_embedded"]["objects"]
    rows = pages.select(F.lit(year).alias("year"), F.explode(item).alias("o")).select("year", F.col("o._embedded.indexableObject").alias("it"))
    values = lambda n: F.coalesce(F.transform(F.col("it.metadata").getField(n), lambda v: v["value"]), F.array().cast("array<string>"))
    first = lambda n: F.coalesce(F.get(values(n), F.lit(0)), F.lit(""))
    dois = F.filter(F.transform(F.concat(*(values(n) for n in doi_fields)), doi), lambda d: d != "")
    return rows.select(
        F.coalesce(F.get(dois, F.lit(0)), F.lit("")).alias("doi"), first("dc.title").alias("title"), first("dc.relation.ispartofjournal").alias("journal"), "year", first("dc.okm.type").alias("type"),
        F.array_sort(F.array_distinct(F.transform(values("dc.okm.discipline"), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)))).alias("fields"), clean_authors(values("dc.okm.affiliatedauthor")).alias("local_authors"),
        F.transform(values("dc.contributor.organization"), lambda u: F.regexp_replace(u, r"^fi=[^|]*\|en=|\|$", "")).alias("units"), F.col("it.uuid").alias("uuid"), F.lit(base_url).alias("base_url"),
    )


def dspace_text(bundles: DataFrame) -> DataFrame:
    """(id, text): the first text of each item's TEXT bundles that isn't blank; ``bundles`` (id, bundle, pos, text)."""
    rows = bundles.filter((F.col("bundle") == "TEXT") & ~blank(F.col("text")))
    return rows.groupBy("id").agg(F.min_by("text", "pos").alias("text"))


# ---- OAI-PMH ---------------------------------------------------------------------------------------------------


_RECORD = "struct<header:struct<identifier:array<string>>,metadata:struct<dc:struct<title:array<string>,creator:array<string>,identifier:array<string>>>,title:array<string>,creator:array<string>,identifier:array<string>>"
_XML = {"ignoreNamespace": "true", "mode": "FAILFAST"}


def oai_records(spark: SparkSession, path: str, file_prefix: str = "") -> DataFrame:
    """(doi, title, files, authors) of the OAI-PMH answers in a folder, see ``oai_items``."""
    raw = spark.read.format("xml").options(**_XML).option("rowTag", "record").schema(StructType.fromDDL(f"r {_RECORD}")["r"].dataType).load(path)
    return _oai(raw.select(F.monotonically_increasing_id().alias("pos"), F.struct("*").alias("r")), file_prefix).drop("year")


def oai_items(pages: DataFrame, file_prefix: str = "") -> DataFrame:
    """(doi, title, files, authors, year) of OAI-PMH answers (year, page, answer): a row for each DOI of a record's identifiers; the first title wins, files and authors are gathered.

    A record with several DOIs counts for each; identifiers that begin with ``file_prefix`` are files. An answer that
    isn't XML is an error.
    """
    told = F.from_xml("answer", f"ListRecords struct<record:array<{_RECORD}>>", _XML)
    rows = pages.select("year", "page", F.posexplode(told["ListRecords"]["record"]).alias("i", "r"))
    return _oai(rows.select("year", F.struct("year", "page", "i").alias("pos"), "r"), file_prefix)


def _oai(records: DataFrame, file_prefix: str) -> DataFrame:
    """Records (pos, r) by DOI."""
    none = F.array().cast("array<string>")
    pick = lambda n: F.filter(F.transform(F.concat(F.coalesce(F.col(f"r.metadata.dc.{n}"), none), F.coalesce(F.col(f"r.{n}"), none)), lambda v: F.trim(v)), lambda x: x != "")
    year = F.col("year") if "year" in records.columns else F.lit(None).cast("int")
    rows = records.select("pos", year.alias("year"), pick("title").alias("title"), pick("creator").alias("creators"), F.concat(pick("identifier"), F.coalesce("r.header.identifier", none)).alias("ids"))
    dois = F.array_distinct(F.transform(F.regexp_extract_all(F.array_join("ids", "\n"), F.lit(_DOI), F.lit(0)), doi))
    files = F.filter("ids", lambda x: x.startswith(file_prefix)) if file_prefix else none
    rows = rows.withColumn("files", files).select("pos", "year", "title", "creators", "files", F.explode(dois).alias("doi")).filter("doi <> ''")
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    title = F.min_by(F.coalesce(F.get("title", F.lit(0)), F.lit("")), "pos")
    return rows.groupBy("doi").agg(title.alias("title"), gathered("files").alias("files"), gathered("creators").alias("authors"), F.min("year").alias("year"))


def resumption_token(answer: Column) -> Column:
    """Where an OAI answer goes on; null at the end."""
    return F.nullif(F.trim(F.regexp_extract(answer, r"(?s)<(?:\w+:)?resumptionToken[^>]*>([^<]*)<", 1)), F.lit(""))


# ---- Europe PMC ------------------------------------------------------------------------------------------------

_HIT = "struct<id:string,source:string,doi:string,title:string,journalTitle:string,pmid:string,pmcid:string,inEPMC:string>"
_SEARCH = f"struct<nextCursorMark:string,resultList:struct<result:array<{_HIT}>>>"


def acknowledgement_query(names: Iterable[str], grants: Iterable[str], year: int, place: str) -> str:
    """The search for papers that thank a facility, by its names near a place, or by grant numbers."""
    told = " OR ".join(f'ACK_FUND:"{n}" OR METHODS:"{n}"' for n in names)
    query = f"(({told}) AND (ACK_FUND:{place} OR METHODS:{place} OR AFF:{place}))"
    query += "".join(f' OR ACK_FUND:"{g}"' for g in grants)
    return f"({query}) AND PUB_YEAR:{year}"


def search_hits(pages: DataFrame, year: int | Column, max_pages: int = 20) -> DataFrame:
    """Candidates of search pages (page, cursor, answer). An answer that can't be read is an error, since papers would be lost unseen; a search cut at ``max_pages`` marks its rows.

    A year's search is told to be cut by its pages' ``cut``, where they have it, else by the last page's cursor.
    """
    parsed = pages.withColumn("y", F.lit(year)).withColumn("a", F.from_json("answer", _SEARCH))
    told = F.when(F.col("a.resultList").isNull(), F.raise_error(F.lit("the search failed on a page: its results would be cut short"))).otherwise(F.col("a.resultList.result"))
    goes_on = F.col("cut") if "cut" in pages.columns else (F.col("page") >= max_pages) & (F.col("a.nextCursorMark") != F.coalesce("cursor", F.lit(""))) & (F.size("a.resultList.result") > 0)
    cut = parsed.groupBy("y").agg(F.coalesce(F.bool_or(goes_on), F.lit(False)).alias("discovery_truncated"))  # a row a year
    rows = parsed.select("y", "page", F.posexplode(told).alias("i", "h")).filter(present(F.col("h.doi"))).join(cut, "y")
    return rows.select(
        doi(F.col("h.doi")).alias("doi"), F.coalesce("h.title", F.lit("")).alias("title"), F.coalesce("h.journalTitle", F.lit("")).alias("journal"), F.col("h.pmcid").alias("pmcid"),
        F.when(F.col("h.source") == "PPR", F.col("h.id")).alias("epmc_id"), F.col("y").alias("year"), "discovery_truncated",
    ).filter("doi <> ''")


def epmc_records(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doi, pmid, pmcid, europepmc_id, open_full_text) of the wanted DOIs (doi); of several records one with a PMC id."""
    hits = pages.select(F.explode(F.from_json("answer", _SEARCH)["resultList"]["result"]).alias("h")).select(F.lower(F.coalesce("h.doi", F.lit(""))).alias("doi"), "h")
    best = hits.join(wanted.select("doi").distinct(), "doi", "left_semi").groupBy("doi").agg(F.max_by("h", F.struct(present(F.col("h.pmcid")), F.col("h.id"))).alias("h"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return best.select("doi", text("h.pmid").alias("pmid"), text("h.pmcid").alias("pmcid"), F.when(F.col("h.source") == "PPR", F.col("h.id")).otherwise("").alias("europepmc_id"), F.coalesce(F.col("h.inEPMC") == "Y", F.lit(False)).alias("open_full_text"))


def batches_of(dois: DataFrame, size: int = 20) -> DataFrame:
    """(batch, query): DOIs in batches for one question each, ``size`` at most.

    DOIs are dealt to groups of about 64 batches by a hash, and cut within these, so that no task numbers all of them.
    """
    group = F.pmod(F.xxhash64("doi"), F.lit(max(1, -(-dois.count() // (64 * size)))))
    numbered = dois.select("doi").distinct().withColumn("g", group).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("doi")) - 1)
    asked = numbered.groupBy("g", F.floor(F.col("k") / size).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doi")), lambda d: F.concat(F.lit('DOI:"'), d, F.lit('"'))), " OR ").alias("query"))
    return asked.select(F.concat_ws("-", "g", "k").alias("batch"), "query")


def xml_text(answer: Column) -> Column:
    """Text of a full-text answer: tags go, references are decoded."""
    from corvane.functions.text import unescape

    return unescape(F.regexp_replace(answer, r"<[^>]+>", " "))


# ---- Crossref and OpenAlex -------------------------------------------------------------------------------------

_DATE = "struct<`date-parts`:array<array<int>>>"
_WORK = (
    "struct<title:array<string>,`container-title`:array<string>,publisher:string,type:string,URL:string,issued:" + _DATE + ",`published-online`:" + _DATE + ",`published-print`:" + _DATE
    + ",author:array<struct<given:string,family:string>>,license:array<struct<URL:string>>,link:array<struct<URL:string,`content-type`:string,`intended-application`:string>>>"
)


def work(answer: Column) -> Column:
    """A Crossref record from its answer; null for an unknown DOI."""
    return F.from_json(answer, f"struct<message:{_WORK}>")["message"]


def plain_title(title: Column) -> Column:
    """A title without markup, single spaces."""
    from corvane.functions.text import unescape

    return F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(title, F.lit("")), r"<[^>]+>", "")), r"(?U)\s+", " "))


def date_of(parts: Column) -> Column:
    """"2025", "2025-03" or "2025-03-07", as far as it is told."""
    p = F.filter(F.get(parts["date-parts"], F.lit(0)), lambda x: x.isNotNull() & (x != 0))
    told = F.transform(p, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")))
    return F.coalesce(F.when(F.coalesce(F.get(F.get(parts["date-parts"], F.lit(0)), F.lit(0)), F.lit(0)) != 0, F.array_join(told, "-")), F.lit(""))


def bibliographic(works: DataFrame) -> DataFrame:
    """Public metadata of Crossref records (doi, answer); DOIs that aren't known are left out."""
    rows = works.withColumn("m", work(F.col("answer"))).filter("m IS NOT NULL")
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return rows.select(
        "doi", plain_title(first(F.col("m.title"))).alias("title"), first(F.col("m.`container-title`")).alias("journal"), F.coalesce("m.publisher", F.lit("")).alias("publisher"), F.coalesce("m.type", F.lit("")).alias("type"),
        F.substring(date_of(F.col("m.issued")), 1, 4).alias("issued_year"), date_of(F.col("m.`published-online`")).alias("published_online"), date_of(F.col("m.`published-print`")).alias("published_print"),
        F.coalesce(F.size("m.author"), F.lit(0)).alias("n_authors"), F.coalesce(F.get("m.license", F.lit(0))["URL"], F.lit("")).alias("license"),
    ).withColumn("n_authors", F.greatest("n_authors", F.lit(0)))


def paper_metadata(works: DataFrame, epmc: DataFrame) -> DataFrame:
    """What is filed of a paper: Crossref's metadata with Europe PMC's identifiers."""
    b = bibliographic(works)
    rows = b.select("doi", "title", "journal", F.coalesce(F.nullif("published_online", F.lit("")), F.nullif("published_print", F.lit("")), F.lit("")).alias("published"), "issued_year", "type")
    return rows.join(epmc.select("doi", "pmid", "pmcid", "europepmc_id"), "doi", "left").na.fill("", ["pmid", "pmcid", "europepmc_id"])


def text_links(works: DataFrame) -> DataFrame:
    """(doi, pos, url, content_type, intended_application): full-text links of a record, each address once, in order; those for similarity checks and other kinds of files are left out."""
    links = F.transform(work(F.col("answer"))["link"], lambda x: F.struct(F.trim(F.coalesce(x["URL"], F.lit(""))).alias("url"), F.lower(F.coalesce(x["content-type"], F.lit(""))).alias("kind"), F.lower(F.coalesce(x["intended-application"], F.lit(""))).alias("use")))
    good = F.filter(links, lambda x: (x.url != "") & (x.use != "similarity-checking") & x.kind.rlike("pdf|xml|html|text"))
    rows = works.withColumn("good", good)
    once = F.filter("good", lambda x, i: ~F.exists(F.slice("good", F.lit(1), i), lambda o: o.url == x.url))
    return rows.select("doi", F.posexplode(once).alias("pos", "x")).select("doi", "pos", "x.url", F.col("x.kind").alias("content_type"), F.nullif("x.use", F.lit("")).alias("intended_application"))


def landing_url(answer: Column) -> Column:
    """Where a record's publisher page is."""
    return F.nullif(F.trim(work(answer)["URL"]), F.lit(""))


def oa_locations(answers: DataFrame) -> DataFrame:
    """(doi, pos, url, license, version, landing_page_url): open PDFs of OpenAlex answers (doi, answer), the published version first, then by address."""
    kind = "struct<results:array<struct<locations:array<struct<pdf_url:string,is_oa:boolean,license:string,version:string,landing_page_url:string>>>>>"
    found = F.get(F.from_json("answer", kind)["results"], F.lit(0))["locations"]
    rows = answers.select("doi", F.posexplode(found).alias("i", "x")).select("doi", "i", F.trim("x.pdf_url").alias("url"), "x.license", "x.version", "x.landing_page_url", "x.is_oa").filter(present(F.col("url")) & F.col("is_oa"))
    first = rows.groupBy("doi", "url").agg(F.min_by(F.struct("license", "version", "landing_page_url"), "i").alias("x"))
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in VERSIONS.items() for v in p)), F.col("x.version")), F.lit(0))
    listed = first.groupBy("doi").agg(F.array_sort(F.collect_list(F.struct((-rank).alias("rank"), "url", "x"))).alias("l"))
    return listed.select("doi", F.posexplode("l").alias("pos", "o")).select("doi", "pos", "o.url", "o.x.*")


def website_dois(pages: DataFrame) -> DataFrame:
    """(doi, year) of a facility's publication pages (year, html): a DOI in two years keeps the first."""
    found = F.regexp_extract_all("html", F.lit(r"doi\.org/(10\.[^\"\s<>]+)"), F.lit(1))
    return pages.select("year", F.explode(found).alias("raw")).select(doi(F.col("raw")).alias("doi"), "year").filter("doi <> ''").groupBy("doi").agg(F.min("year").alias("year"))


# ---- fetching --------------------------------------------------------------------------------------------------


@dataclass
class Answer:
    """What became of a request: the body, null if there is none, and why."""

    body: bytes | None
    status: int = 0
    url: str = ""
    content_type: str = ""
    error: str = ""


@dataclass
class Fetcher:
    """How services are asked: three tries, longer and longer waits, no second try for what isn't there, no more questions to a host that asks for long patience.

    ``opener`` and ``sleep`` can be replaced. Called with an address, it gives the body; ``answer`` also tells the rest.
    """

    tries: int = 3
    longest_wait: float = 120.0
    opener: Callable[[str, float], tuple] | None = None
    sleep: Callable[[float], None] = time.sleep
    exhausted: set[str] = field(default_factory=set)

    #: Answers that another try won't change, and seconds to wait after one that asks for patience but not how much.
    FINAL = (401, 403, 404, 410)
    PATIENCE = (10.0, 20.0, 30.0)

    def __call__(self, url: str, timeout: float = 60.0) -> bytes | None:
        """The body of an answer, null if there is none to be had."""
        return self.answer(url, timeout).body

    def answer(self, url: str, timeout: float = 60.0) -> Answer:
        """The last answer to up to ``tries`` requests."""
        host = (urllib.parse.urlsplit(url).hostname or "").lower()
        if host in self.exhausted:
            return Answer(None, url=url, error=f"{host} asked for patience")
        last = Answer(None, url=url, error="not asked")
        for k in range(self.tries):
            try:
                status, body, headers, *final = (self.opener or _open)(url, timeout)
            except (OSError, urllib.error.URLError) as e:
                last, wait = Answer(None, url=url, error=f"{type(e).__name__}: {e}"), 2.0**k
            else:
                told = {k.lower(): v for k, v in headers.items()}
                fine = 200 <= status < 300
                last = Answer(body if fine else None, status, final[0] if final else url, told.get("content-type", ""), "" if fine else f"status {status}")
                if fine or status in self.FINAL:
                    return last
                wait = 2.0**k
                if status == 429:
                    after = told.get("retry-after", "")
                    wait = float(after) if after.isdigit() else self.PATIENCE[min(k, len(self.PATIENCE) - 1)]
                    if b"budget" in body.lower() or wait > self.longest_wait:
                        self.exhausted.add(host)
                        return last
            if k + 1 < self.tries:
                self.sleep(wait)
        return last

    def json(self, url: str) -> dict | None:
        """An answer read as JSON; null if there is none, or it isn't JSON."""
        body = self(url)
        try:
            return json.loads(body) if body else None
        except ValueError:
            return None


def _open(url: str, timeout: float) -> tuple[int, bytes, dict[str, str], str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "corvane"}), timeout=timeout) as r:
            return r.status, r.read(), dict(r.headers), r.url
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers), url
