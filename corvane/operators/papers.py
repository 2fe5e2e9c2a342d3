"""Confirmed papers: reading pasted DOIs, filing them, checking the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import doi, present
from corvane.sources.harvest import website_dois

#: The public fields of a filed paper, and what DOIs and years look like in pasted text.
FIELDS = ("doi", "title", "journal", "published", "type", "pmid", "pmcid", "europepmc_id", "source", "added")
_DOI = r"(?i)10\.[0-9]{4,9}/[^\s,;<>\"']+"
_YEAR = r"(?U)^\s+((?:19[89]|20[0-9])[0-9])\b"
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+"


def parse_dois(lines: DataFrame) -> DataFrame:
    """(pos, k, line, doi, year) of ``lines`` (pos, line): a row for each DOI, one without DOI for a line that holds none.

    A year counts only right after its DOI. What follows four spaces and # is an earlier note; comments and blank lines go.
    """
    line = F.split("line", "    #").getItem(0)
    rows = lines.withColumn("line", line).filter(present(F.trim("line"))).filter(~F.ltrim("line").startswith("#"))
    found, rest = F.regexp_extract_all("line", F.lit(_DOI), F.lit(0)), F.split("line", _DOI, -1)
    hits = F.transform(found, lambda d, i: F.struct(i.alias("k"), d.alias("raw"), F.regexp_extract(F.element_at(rest, i + 2), _YEAR, 1).alias("after")))
    rows = rows.select("pos", "line", F.explode_outer(hits).alias("h"))
    return rows.select("pos", F.coalesce("h.k", F.lit(0)).alias("k"), "line", F.nullif(doi(F.col("h.raw")), F.lit("")).alias("doi"), F.nullif(F.col("h.after"), F.lit("")).cast("int").alias("year"))


def file_papers(parsed: DataFrame, filed: DataFrame, metadata: DataFrame, allow_moves: bool = True) -> DataFrame:
    """(pos, k, doi, year, status, filed_year) of each pasted DOI (pos, k, doi, year), in their order.

    ``filed`` (doi, year): what is filed already. ``metadata`` (doi, issued_year): what is known of DOIs; one without a
    row isn't known. A DOI is added at its first line that tells a year, or whose metadata does; it then is filed like
    any other: it moves where a later line gives another year, if moves are allowed. Other statuses: already, unknown
    doi, no year, and dropped for lines without a DOI.
    """
    order = Window.partitionBy("doi").orderBy("pos", "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = parsed.filter("doi IS NOT NULL").join(filed.select("doi", F.col("year").alias("held")), "doi", "left").join(metadata.select("doi", "issued_year", F.lit(True).alias("known")), "doi", "left")
    told = F.coalesce(F.col("year"), F.col("issued_year").cast("int"))
    can = F.col("held").isNull() & F.col("known").isNotNull() & told.isNotNull()
    rows = rows.withColumn("can", can).withColumn("made", F.coalesce(F.max("can").over(before), F.lit(False)))
    adds = F.col("can") & ~F.col("made")
    stands = F.col("held").isNotNull() | F.col("made")
    # the year a paper stands under after each line: that of its filing, then of each line that moves it
    rows = rows.withColumn("sets", F.when(adds, told).when(stands & F.lit(allow_moves), F.col("year")))
    now = F.coalesce(F.last("sets", ignorenulls=True).over(before), F.col("held"))
    status = (
        F.when(adds, "added").when(stands & F.lit(allow_moves) & F.col("year").isNotNull() & (F.col("year") != now), "moved").when(stands, "already")
        .when(F.col("known").isNull(), "unknown doi").otherwise("no year")
    )
    rows = rows.withColumns({"status": status, "filed_year": F.coalesce("sets", now)})
    dropped = parsed.filter("doi IS NULL").select("pos", "k", "doi", "year", F.lit("dropped").alias("status"), F.lit(None).cast("int").alias("filed_year"))
    return rows.select("pos", "k", "doi", "year", "status", "filed_year").unionByName(dropped)


def leftover(statuses: DataFrame) -> DataFrame:
    """(pos, k, note): the lines to hand back, with what is wrong; only DOI and year are repeated."""
    notes = {"unknown doi": "no registry knows this DOI", "no year": "which year? write it behind the DOI"}
    note = F.coalesce(*(F.when(F.col("status") == s, F.lit(f"    # {t}")) for s, t in notes.items()))
    return statuses.filter(F.col("status").isin(*notes)).select("pos", "k", F.concat(F.concat_ws(" ", "doi", F.col("year").cast("string")), note).alias("note"))


def filed_after(filed: DataFrame, statuses: DataFrame, metadata: DataFrame, source: str, today: str) -> DataFrame:
    """The filed papers with what was added and moved."""
    last = statuses.filter("status IN ('added', 'moved')").groupBy("doi").agg(F.max_by("filed_year", F.struct("pos", "k")).alias("new_year"), F.max(F.col("status") == "added").alias("is_new"))
    kept = filed.join(last.filter("NOT is_new").select("doi", "new_year"), "doi", "left").withColumn("year", F.coalesce("new_year", "year")).drop("new_year")
    new = metadata.join(last.filter("is_new").select("doi", F.col("new_year").alias("year")), "doi").drop("issued_year").withColumns({"source": F.lit(source), "added": F.lit(today)})
    return kept.unionByName(new, allowMissingColumns=True)


def import_website(pages: DataFrame, filed: DataFrame, metadata: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """A facility's publication pages (year, html) taken in: the filed papers after it, and each DOI's status as ``file_papers`` tells it.

    A DOI on pages of several years counts under the first. Papers that are filed already stay in their year, whatever
    the pages say. DOIs that ``metadata`` (doi, issued_year, and any fields) lacks aren't filed.
    """
    found = website_dois(pages)
    parsed = found.select(F.col("year").alias("pos"), F.col("doi").alias("k"), "doi", F.col("year").cast("int").alias("year"))
    statuses = file_papers(parsed, filed, metadata, allow_moves=False)
    return filed_after(filed, statuses, metadata, "website", today), statuses.select("doi", "year", "status", "filed_year")


def filed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of filed papers as ``records.write_papers`` leaves them, read as plain lines so that broken ones are seen: ``file`` is the year of the folder."""
    folder = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]*$", 1)
    return spark.read.text(path, recursiveFileLookup=True).select(F.regexp_replace(folder, "^year=", "").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def check_papers(lines: DataFrame, known: DataFrame, resolving: DataFrame) -> DataFrame:
    """(file, doi, problem) of filed papers (file, pos, line): all that is wrong, with a null DOI for what is wrong with a whole file.

    A line is a JSON object of a paper's fields. Files not named by a year, with lines that can't be read or that are no
    objects, are named once and their entries aren't looked at, nor counted as filed; so is one whose DOIs are out of
    order, but its entries are. ``known`` (doi): what was filed before. ``resolving`` (doi): DOIs that registries know.
    """
    entry = F.from_json("line", "map<string,string>")
    rows = lines.filter(present(F.trim("line"))).select("file", "pos", entry.alias("e"), F.expr("try_parse_json(line)").isNotNull().alias("parsed"))
    rows = rows.withColumn("doi", F.coalesce(F.col("e").getItem("doi"), F.lit("")))
    rows = rows.withColumn("previous", F.lag("doi").over(Window.partitionBy("file").orderBy("pos")))
    files = rows.groupBy("file").agg(F.bool_or(~F.col("parsed")).alias("broken"), F.bool_or(F.col("parsed") & F.col("e").isNull()).alias("mixed"), F.bool_or(F.col("previous") > F.col("doi")).alias("unsorted"))
    unusable = F.when(~F.col("file").rlike("^[0-9]+$"), "the file's name is no year").when(F.col("broken"), "lines of the file are no JSON").when(F.col("mixed"), "the file holds more than entries")
    files = files.withColumn("unusable", unusable)
    of_files = files.select("file", F.lit(None).cast("string").alias("doi"), F.coalesce("unusable", F.when(F.col("unsorted"), "DOIs are out of order")).alias("problem")).filter("problem IS NOT NULL")
    rows = rows.join(files.filter("unusable IS NULL").select("file"), "file")
    right = (F.col("doi") != "") & (doi(F.col("doi")) == F.col("doi"))
    good = rows.filter(right)
    shapes = rows.filter(~right).select("file", "doi", F.lit("the DOI is missing or not in its short lower-case form").alias("problem"))
    good = good.withColumn("earlier", F.lag("file").over(Window.partitionBy("doi").orderBy("file", "pos")))
    good = good.join(known.select("doi", F.lit(False).alias("is_new")).distinct(), "doi", "left").join(resolving.select("doi", F.lit(True).alias("resolves")).distinct(), "doi", "left")
    private = F.array_sort(F.array_except(F.map_keys("e"), F.lit(list(FIELDS))))
    new = F.col("is_new").isNull()
    tests: list[Column] = [
        F.when(F.col("earlier").isNotNull(), F.concat(F.lit("stands in "), "earlier", F.lit(" and in "), "file")),
        F.when(F.size(private) > 0, F.concat(F.lit("has fields that aren't public: "), F.array_join(private, ", "))),
        F.when(F.exists(F.map_values("e"), lambda v: F.coalesce(v.rlike(_MAIL), F.lit(False))), F.lit("an e-mail address is in it")),
        F.when(new & ~F.coalesce(present(F.col("e").getItem("source")), F.lit(False)), F.lit("new, and nothing tells who confirmed it")),
        F.when(new & F.col("resolves").isNull(), F.lit("new, and no registry knows its DOI")),
    ]
    return of_files.unionByName(shapes).unionByName(good.select("file", "doi", F.explode(F.array_compact(F.array(*tests))).alias("problem")))
