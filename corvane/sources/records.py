"""Readers and writers: harvested records, private inputs, texts, screened rows, review tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import text as T

CANDIDATE = "doi string, title string, journal string, year int, type string, fields array<string>, authors array<string>, sources array<string>"
#: Sources whose texts were whole before their scope was noted.
TRUSTED = ("utupub", "abo", "europepmc", "crossref_fulltext", "openalex_oa")
#: What fills gaps of a candidate and what a later harvest replaces.
META_KEYS = ("title", "journal", "year", "type", "fields", "local_authors", "units", "sources")


def present_value(c: Column, kind: str) -> Column:
    """Whether a value counts as one: not null, empty or 0."""
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c.cast("string") != "") & ((c != 0) if kind in ("int", "bigint", "double") else F.lit(True))


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType, kind: str = "parquet") -> DataFrame:
    """A table, or one without rows where there is none yet."""
    try:
        df = spark.read.schema(schema).format(kind).load(path)
        df.schema  # noqa: B018
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records as JSON lines, with a cleaned DOI; records without one are dropped."""
    return spark.read.schema(CANDIDATE).json(path).withColumn("doi", T.doi(F.col("doi"))).filter("doi <> ''")


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    """(key, year, instrument) of bookings as CSV (group_leader, instrument, date); rows need a leader and a year."""
    raw = spark.read.option("header", True).csv(path)
    year = F.regexp_extract(F.trim("date"), r"^(\d{4})", 1)
    rows = raw.filter(T.present(F.trim("group_leader")) & (year != ""))
    return rows.select(T.name_key(F.trim("group_leader")).alias("key"), year.cast("int").alias("year"), F.lower(F.trim(F.coalesce("instrument", F.lit("")))).alias("instrument"))


def read_staff(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a staff list as CSV (name)."""
    return spark.read.option("header", True).csv(path).filter(T.present(F.col("name"))).select(T.name_key(F.col("name")).alias("key")).distinct()


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Filed papers (``write_papers``), with ``year`` from their folders and DOIs cleaned; rows without one go."""
    kind = "doi string, title string, journal string, published string, type string, pmid string, pmcid string, europepmc_id string, source string, added string, year int"
    return read_or_empty(spark, path, kind, "json").withColumn("doi", T.doi(F.col("doi"))).filter("doi <> ''")


def resource_id(resource: Column, mapping: list[tuple[str, str]]) -> Column:
    """The instrument of the first name part that a resource's name holds; else the name itself."""
    plain = F.lower(F.trim(F.coalesce(resource, F.lit(""))))
    out = plain
    for part, instrument in reversed(mapping):
        out = F.when(F.contains(plain, F.lit(part.lower())), F.lit(instrument)).otherwise(out)
    return out


def import_bookings(users: DataFrame, trainings: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """(group_leader, instrument, date), distinct, of a booking system's export.

    Each completed training counts for the trainee and the heads of the trainee's group, each user's latest use for the
    user and the heads. ``users`` (first_name, last_name, group, heads, latest_use), ``trainings`` (first_name,
    last_name, group, status, created, resource).
    """
    person = F.concat(F.trim(F.coalesce("last_name", F.lit(""))), F.lit(", "), F.trim(F.coalesce("first_name", F.lit(""))))
    heads = F.filter(F.transform(F.split(F.coalesce("heads", F.lit("")), ","), lambda v: F.trim(v)), lambda h: h != "")
    by_group = users.filter(T.present(F.col("group"))).select("group", F.explode(heads).alias("head")).distinct()
    day = lambda c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 10)
    done = trainings.filter("status = 'Completed'").select(person.alias("who"), "group", resource_id(F.col("resource"), mapping).alias("instrument"), day("created").alias("date"))
    used = users.select(F.explode(F.concat(F.array(person), heads)).alias("group_leader"), F.lit("").alias("instrument"), day("latest_use").alias("date"))
    trained = done.select(F.col("who").alias("group_leader"), "instrument", "date")
    led = done.join(by_group, "group").select(F.col("head").alias("group_leader"), "instrument", "date")
    return trained.unionByName(led).unionByName(used).distinct()


def booking_counts(users: DataFrame, trainings: DataFrame, bookings: DataFrame) -> DataFrame:
    """One row: trainings, users, groups with heads, booking rows, people."""
    counts = [trainings.agg(F.count("*").alias("trainings")), users.agg(F.count("*").alias("users"), F.count_distinct(F.nullif("group", F.lit(""))).alias("groups")), bookings.agg(F.count("*").alias("booking_rows"), F.count_distinct("group_leader").alias("people"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


# ---- candidates --------------------------------------------------------------------------------------------------


def universe(sources: list[tuple[str, DataFrame, bool]], science: Column | None = None) -> DataFrame:
    """Candidates of all sources (name, rows, whether only science counts), merged by DOI: the first present value of each field, and the sources in order."""
    rows = None
    for k, (name, df, gated) in enumerate(sources):
        part = df.filter("doi <> ''")
        part = part.filter(science) if gated and science is not None else part
        part = part.withColumns({"_order": F.lit(k), "_source": F.lit(name)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    fields = [f for f in rows.schema if f.name not in ("doi", "_order", "_source", "sources")]
    first = [F.min_by(f.name, F.when(present_value(F.col(f.name), f.dataType.simpleString()), F.col("_order"))).alias(f.name) for f in fields]
    named = F.transform(F.array_sort(F.collect_set(F.struct("_order", "_source"))), lambda s: s["_source"])
    return rows.groupBy("doi").agg(*first, F.array_distinct(named).alias("sources"))


def with_identifiers(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates whose PMC and preprint ids are those of the search, where it has them."""
    new = hits.groupBy("doi").agg(F.max("pmcid").alias("_pmcid"), F.max("epmc_id").alias("_epmc"))
    held = [F.col(c) if c in candidates.columns else F.lit(None).cast("string") for c in ("pmcid", "epmc_id")]
    return candidates.join(new, "doi", "left").withColumns({"pmcid": F.coalesce("_pmcid", held[0]), "epmc_id": F.coalesce("_epmc", held[1])}).drop("_pmcid", "_epmc")


def overlaid(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows whose metadata is replaced by what a later harvest has."""
    own = [c for c in META_KEYS if c in rows.columns and c in fresh.columns]
    kinds = {f.name: f.dataType.simpleString() for f in fresh.schema}
    new = fresh.select("doi", *(F.col(c).alias(f"_{c}") for c in own))
    return rows.join(new, "doi", "left").withColumns({c: F.when(present_value(F.col(f"_{c}"), kinds[c]), F.col(f"_{c}")).otherwise(F.col(c)) for c in own}).drop(*(f"_{c}" for c in own))


# ---- texts -------------------------------------------------------------------------------------------------------


def usable(text: Column, doi_: Column, title: Column) -> Column:
    """Whether a repository's text is an article, and this paper's."""
    return ~T.blank(text) & T.article_check(text).ok & T.matches_paper(text, doi_, title)


def resolve_texts(papers: DataFrame, offers: DataFrame) -> DataFrame:
    """(doi, text, source, url, license, version): each paper's first usable text.

    ``offers`` (doi, source, pos, text, url, license, version): what sources have; they are tried in the order of
    ORDER, then by ``pos``. Repositories' texts must be the paper's own; downloads must be articles.
    """
    rank = F.coalesce(F.array_position(F.lit(list(TRUSTED)), F.col("source")).cast("int"), F.lit(0))
    rows = offers.join(papers.select("doi", "title"), "doi").withColumn("rank", rank).filter("rank > 0")
    from_repository = F.col("rank") <= 3
    good = F.when(from_repository, usable(F.col("text"), F.col("doi"), F.col("title"))).otherwise(~T.blank(F.col("text")) & T.article_check(F.col("text")).ok)
    best = rows.filter(good).groupBy("doi").agg(F.min_by(F.struct("text", "source", "url", "license", "version"), F.struct("rank", "pos")).alias("t"))
    return papers.select("doi").join(best, "doi", "left").select("doi", "t.*")


def pdf_texts(files: DataFrame, read: Callable[[bytes], str | None]) -> DataFrame:
    """(id, text): the text of each paper's first file that is a PDF and has text; ``files`` (id, pos, content).

    ``read`` turns a PDF into text, null if it can't; it is called in tasks, for files that begin as PDFs do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [read(c) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "pos", "text"])

    kind = files.schema["id"].dataType.simpleString()
    pdfs = files.filter(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("id", F.col("pos").cast("long"), "content")
    found = pdfs.mapInArrow(run, f"id {kind}, pos long, text string").filter(~T.blank(F.col("text")))
    return found.groupBy("id").agg(F.min_by("text", "pos").alias("text"))


def to_retry(papers: DataFrame, markers: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Papers (doi) worth another look for a text: without a marker (doi, at) that none was found in the last ``days``."""
    recent = markers.filter(F.col("at") > now - F.expr(f"INTERVAL {int(days)} DAYS")).select("doi")
    return papers.join(recent, "doi", "left_anti")


def reusable(text: Column, scope: Column, source: Column) -> Column:
    """Whether a held text spares another look: an article, not a part, and whole for sure or from a trusted source."""
    whole = (scope == "full") | (scope.isNull() & source.isin(*TRUSTED)) | (~scope.isin("full", "partial") & source.isin(*TRUSTED))
    return F.coalesce(T.present(text), F.lit(False)) & T.article_check(text).ok & F.coalesce(scope != "partial", F.lit(True)) & F.coalesce(whole, F.lit(False))


def store_texts(df: DataFrame, path: str) -> None:
    """Append (year, doi, text, source, url, license, version, scope), by year; Spark's commit leaves no half-written file."""
    df.write.mode("append").option("compression", "zstd").partitionBy("year").parquet(path)


# ---- screened rows -----------------------------------------------------------------------------------------------


def latest_screened(log: DataFrame, universe_: DataFrame | None = None) -> DataFrame:
    """The rows in force of a log (doi, seq, has_text, ...): the latest, but none without text after one with; only DOIs of the universe, if there is one."""
    best = log.groupBy("doi").agg(F.max_by(F.struct(*log.columns), F.struct("has_text", "seq")).alias("r")).select("r.*")
    return best if universe_ is None else best.join(universe_.select("doi"), "doi", "left_semi")


def completed(log: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doi): papers whose latest row has text, and whose held text (doi, text, scope, source) is reusable, where texts are given."""
    done = log.groupBy("doi").agg(F.max_by("has_text", "seq").alias("has_text")).filter("has_text").select("doi")
    return done if texts is None else done.join(texts.filter(reusable(F.col("text"), F.col("scope"), F.col("source"))).select("doi"), "doi", "left_semi")


def to_do(candidates: DataFrame, log: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates that aren't completed, by DOI; the first ``limit``."""
    rest = candidates.join(completed(log, texts), "doi", "left_anti")
    return rest if limit is None else rest.orderBy("doi").limit(limit)


def append_screened(df: DataFrame, path: str) -> None:
    """Append to the log, as JSON lines by year."""
    df.write.mode("append").partitionBy("year").json(path)


# ---- writing -----------------------------------------------------------------------------------------------------


def write_by_year(df: DataFrame, path: str) -> None:
    """Replace the years that ``df`` holds and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_papers(papers: DataFrame, path: str) -> None:
    """Rewrite the files of confirmed papers: a folder a year, one row a DOI, sorted by it; years without papers have none."""
    once = papers.groupBy("doi").agg(F.max_by(F.struct(*papers.columns), F.col("year")).alias("p")).select("p.*")
    once.repartition("year").sortWithinPartitions("year", "doi").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("year").json(path, ignoreNullFields=True)


def write_table(df: DataFrame, columns: tuple[str, ...], path: str, order: list[Column | str] = ()) -> None:
    """A table to work with as one CSV file of just these columns, with a header; such tables are small by nature."""
    (df.orderBy(*order) if order else df).select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def years(spark: SparkSession, path: str) -> list[int]:
    """The years a table by year holds, from its folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removeprefix("year=")) for n in names if n.startswith("year=") and n.removeprefix("year=").isdigit())
