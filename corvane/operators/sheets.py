"""The tables people work with: what to validate, whom to write to, what the search missed; and the verdicts they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.operators.contacts import contact_rows
from corvane.rules import CATEGORIES, FLAGGED, LEADS, Rules, java_pattern

#: Verdicts, why a paper is listed, the tables' columns.
VERDICTS = ("yes", "likely", "no")
WHY_ACK = "new: acknowledges the facility"
WHY_INSTRUMENT = "new: facility instrument, no acknowledgement"
WHY_SIMILAR = "reads like facility papers"
WHY_EARLIER = "earlier verdict (no longer a candidate)"
VALIDATE_COLUMNS = ("why", "doi", "link", "title", "journal", "acknowledges_facility", "evidence", "priority", "embedding_rank", "verdict", "reason", "note")
CONTACT_COLUMNS = ("name", "email", "status", "papers", "dois", "titles", "acknowledges_facility", "grant_cited")
MISSES_COLUMNS = ("doi", "link", "title", "why_missed", "priority", "category", "score_reasons")
_FAR = 10**9


def link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def clean_verdict(verdict: Column) -> Column:
    """Trimmed, lower case; anything that isn't a verdict is an error, never guessed."""
    v = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    return F.when(v.isin("", *VERDICTS), v).otherwise(F.raise_error(F.concat(F.lit("verdict "), v, F.lit(" is not one of " + ", ".join(VERDICTS)))))


def verdicts(previous: DataFrame) -> DataFrame:
    """(doi, verdict, reason, note) of an earlier table's rows that hold any of the three; the last row of a DOI counts."""
    clean = previous.select(F.lower(F.trim("doi")).alias("doi"), clean_verdict(F.col("verdict")).alias("verdict"), *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("reason", "note")), "pos")
    told = clean.filter("doi <> '' AND (verdict <> '' OR reason <> '' OR note <> '')")
    return told.groupBy("doi").agg(F.max_by(F.struct("verdict", "reason", "note"), "pos").alias("v")).select("doi", "v.*")


def set_verdict(table: DataFrame, doi: str, verdict: str, reason: str = "", note: str = "") -> DataFrame:
    """The table with one decision in its first row of that DOI; an empty verdict clears it. A DOI that isn't listed is an error."""
    verdict = verdict.strip().lower()
    if verdict and verdict not in VERDICTS:
        raise ValueError(f"verdict {verdict!r} is not one of {', '.join(VERDICTS)}")
    same = F.lower(F.trim("doi")) == doi.strip().lower()
    first = table.filter(same).agg(F.min("pos")).first()[0]
    if first is None:
        raise ValueError(f"{doi} is not in the table")
    at = F.col("pos") == first
    return table.withColumns({c: F.when(at, F.lit(v)).otherwise(F.col(c)) for c, v in (("verdict", verdict), ("reason", reason), ("note", note))})


def decisions(tables: DataFrame) -> DataFrame:
    """(year, doi, why, embedding_rank, verdict, reason, note) of all rows with a verdict."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    return tables.withColumn("verdict", v).filter("verdict <> ''").select("year", F.lower(F.trim("doi")).alias("doi"), "why", "embedding_rank", "verdict", "reason", "note")


def pending(table: DataFrame, revisit: tuple[str, ...] = ()) -> DataFrame:
    """Rows still to decide, and those whose verdict is to be given again."""
    again = {v.strip().lower() for v in revisit}
    if again - set(VERDICTS):
        raise ValueError(f"revisit: {', '.join(sorted(again - set(VERDICTS)))} is not one of {', '.join(VERDICTS)}")
    return table.filter(T.present(F.col("doi"))).filter(F.lower(F.trim(F.coalesce("verdict", F.lit("")))).isin("", *again))


def candidates(screened: DataFrame, confirmed: DataFrame, ranked: DataFrame, kept: DataFrame, top: int = 200) -> DataFrame:
    """(listing, why, doi, embedding_rank) of a year's papers to check, most likely first: acknowledged, instrument named, much alike, earlier verdicts.

    ``confirmed``, ``kept`` (doi), ``ranked`` (doi, rank). Each group is ordered by rank, those without one last.
    """
    new = screened.join(confirmed.select("doi"), "doi", "left_anti")
    flagged = new.filter(F.col("priority").isin(*FLAGGED)).select("doi", F.when(F.col("priority") == "report", 1).otherwise(2).alias("listing"))
    every_flag = screened.filter(F.col("priority").isin(*FLAGGED)).select("doi")
    alike = ranked.join(confirmed.select("doi"), "doi", "left_anti").join(every_flag, "doi", "left_anti").orderBy("rank", "doi").limit(top)
    listed = flagged.unionByName(alike.select("doi", F.lit(3).alias("listing")))
    earlier = kept.select("doi").join(listed.select("doi"), "doi", "left_anti").join(confirmed.select("doi"), "doi", "left_anti").select("doi", F.lit(4).alias("listing"))
    rows = listed.unionByName(earlier).join(ranked.select("doi", F.col("rank").alias("embedding_rank")), "doi", "left")
    g = F.col("listing")
    why = F.when(g == 1, WHY_ACK).when(g == 2, WHY_INSTRUMENT).when(g == 3, F.concat(F.lit(f"{WHY_SIMILAR} (rank "), F.col("embedding_rank").cast("string"), F.lit(")"))).otherwise(WHY_EARLIER)
    return rows.select("listing", why.alias("why"), "doi", "embedding_rank")


def in_order(rows: DataFrame) -> DataFrame:
    """``candidates`` in the order to read them."""
    return rows.orderBy("listing", F.coalesce("embedding_rank", F.lit(_FAR)), "doi")


def acknowledges(has_text: Column, acknowledgement: Column, text: Column, r: Rules) -> Column:
    """yes, no or unknown: by the screening, or for papers outside it by their text."""
    own = F.when(T.normalise(text).rlike(java_pattern(r.acknowledgement)), "yes").otherwise("no")
    return F.when(F.coalesce(has_text, F.lit(False)), F.when(F.size(acknowledgement) > 0, "yes").otherwise("no")).when(~F.coalesce(T.present(text), F.lit(False)), "unknown (no full text)").otherwise(own)


def grant_cited(text: Column, r: Rules) -> Column:
    """yes, no, unknown without text, and nothing where no grant is named in the rules."""
    if not r.grants:
        return F.lit("")
    pattern = r"(?U)\b(" + "|".join(map(T.quoted, r.grants)) + r")\b"
    return F.when(~F.coalesce(T.present(text), F.lit(False)), "unknown").when(text.rlike(pattern), "yes").otherwise("no")


def validate_table(listed: DataFrame, screened: DataFrame, kept: DataFrame, texts: DataFrame, r: Rules) -> DataFrame:
    """The table to validate: VALIDATE_COLUMNS and ``listing``, for ``in_order``."""
    rows = listed.join(screened.select("doi", "title", "journal", "priority", "score_reasons", "acknowledgement", "evidence", "has_text"), "doi", "left").join(kept, "doi", "left").join(texts.select("doi", F.col("text").alias("full")), "doi", "left")
    shown = F.substring(F.array_join(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("score_reasons", "acknowledgement", "evidence"))), " | "), 1, 1500)
    made = {"link": link(F.col("doi")), "acknowledges_facility": acknowledges(F.col("has_text"), F.col("acknowledgement"), F.col("full"), r), "evidence": shown}
    rows = rows.withColumns(made)
    return rows.select("listing", *(F.coalesce(F.col(c), F.lit("")).alias(c) if c != "embedding_rank" else F.col(c) for c in VALIDATE_COLUMNS))


def facility_papers(confirmed: DataFrame, kept: DataFrame, screened: DataFrame, texts: DataFrame, contacts: DataFrame, r: Rules) -> DataFrame:
    """(doi, title, status, acknowledges_facility, grant_cited, contacts) of confirmed papers (doi, title) and of those judged yes or likely."""
    judged = kept.filter("verdict IN ('yes', 'likely')").select("doi", "verdict")
    rows = confirmed.select("doi", F.col("title").alias("filed_title"), F.lit(True).alias("filed")).join(judged, "doi", "full_outer")
    rows = rows.join(screened.select("doi", "title", "has_text", "acknowledgement"), "doi", "left").join(texts.select("doi", F.col("text").alias("full")), "doi", "left").join(contacts.select("doi", "contacts"), "doi", "left")
    status = F.when(F.col("filed").isNull() & (F.col("verdict") == "likely"), "likely").otherwise("confirmed")
    title = F.coalesce(F.nullif("filed_title", F.lit("")), "title", F.lit(""))
    none = F.array().cast("array<struct<name:string,email:string>>")
    return rows.select("doi", title.alias("title"), status.alias("status"), acknowledges(F.col("has_text"), F.col("acknowledgement"), F.col("full"), r).alias("acknowledges_facility"), grant_cited(F.col("full"), r).alias("grant_cited"), F.coalesce("contacts", none).alias("contacts"))


def why_missed(in_universe: Column, has_text: Column, priority: Column, category: Column) -> Column:
    """Why the search didn't flag a confirmed paper."""
    found = F.format_string("text found, ranked %s (category %s)", F.coalesce(F.nullif(priority, F.lit("")), F.lit("low")), category)
    return F.when(~in_universe | has_text.isNull(), "not among the year's candidates (institutional sources, Europe PMC)").when(~has_text, "no full text").otherwise(found)


def search_misses(confirmed: DataFrame, screened: DataFrame, universe: DataFrame) -> DataFrame:
    """MISSES_COLUMNS of the confirmed papers that weren't flagged."""
    rows = confirmed.select("doi", F.col("title").alias("filed_title")).join(screened.select("doi", "title", "priority", "category", "has_text", "score_reasons"), "doi", "left")
    rows = rows.join(universe.select("doi", F.lit(True).alias("listed")).distinct(), "doi", "left").filter(~F.coalesce(F.col("priority").isin(*FLAGGED), F.lit(False)))
    why = why_missed(F.coalesce("listed", F.lit(False)), F.col("has_text"), F.col("priority"), F.col("category"))
    return rows.select("doi", link(F.col("doi")).alias("link"), F.coalesce(F.nullif("filed_title", F.lit("")), "title", F.lit("")).alias("title"), why.alias("why_missed"), F.coalesce("priority", F.lit("")).alias("priority"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce(F.array_join("score_reasons", "; "), F.lit("")).alias("score_reasons"))


def build(screened: DataFrame, confirmed: DataFrame, ranked: DataFrame, previous: DataFrame, texts: DataFrame, contacts: DataFrame, universe: DataFrame, year: int, r: Rules, top: int = 200) -> tuple[dict[str, DataFrame], DataFrame]:
    """The three tables of a year, and (line): the new "yes" papers to file, as "doi year".

    ``confirmed`` (doi, year, title): all confirmed papers; ``previous``: the earlier table to validate, with ``pos``.
    Contacts are looked up for facility papers only.
    """
    kept = verdicts(previous)
    own = confirmed.filter(F.col("year") == year)
    open_ = kept.join(confirmed.select("doi"), "doi", "left_anti")
    listed = candidates(screened, confirmed, ranked, kept, top)
    papers = facility_papers(own, open_, screened, texts, contacts, r)
    tables = {"validate": validate_table(listed, screened, kept, texts, r), "contacts": contact_rows(papers), "search_misses": search_misses(own, screened, universe)}
    return tables, open_.filter("verdict = 'yes'").select(F.format_string("%s %s", "doi", F.lit(str(year))).alias("line"))


def _with_listed(screened: DataFrame, listed: DataFrame) -> DataFrame:
    rows = screened.join(listed.select("doi", F.lit(True).alias("confirmed")).distinct(), "doi", "left")
    return rows.withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def _public_columns() -> list[Column]:
    """The public review sheet's columns, in order."""
    joined = lambda c, by="; ": F.coalesce(F.array_join(F.col(c), by), F.lit(""))
    prints = F.array_join(F.transform(F.map_entries("fingerprints"), lambda e: F.concat(e.key, F.lit(": "), F.array_join(e.value, ", "))), "; ")
    meaning = F.element_at(F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair)), F.col("category"))
    thanks = F.when(F.size("acknowledgement") > 0, F.col("acknowledgement")).otherwise(F.col("affiliation_only"))
    cut = lambda c, n: F.coalesce(F.substring(c, 1, n), F.lit(""))
    return [
        "priority", "score", joined("score_reasons").alias("score_reasons"), "category", meaning.alias("category_meaning"), "confirmed", "doi", "title", joined("local_authors").alias("local_authors"), "local_email",
        joined("instruments_strong").alias("instruments_strong"), joined("instruments_weak").alias("instruments_weak"), joined("techniques_specialist").alias("techniques_specialist"), "microscopy_terms", cut(prints, 400).alias("fingerprint"),
        cut(F.array_join("credited_elsewhere", " | "), 400).alias("credited_elsewhere"), "other_local_imaging", cut(F.array_join(thanks, " | "), 800).alias("acknowledgement"), cut(F.array_join("evidence", " | "), 2500).alias("evidence"),
    ]


def _place(score: Column) -> Column:
    return F.struct((-F.coalesce(score, F.lit(0))).alias("score"), F.col("category"), F.col("doi")).alias("review_place")


def review_rows(screened: DataFrame, listed: DataFrame) -> DataFrame:
    """The public review sheet: leads and confirmed papers (doi), flat, with ``review_place`` to order by."""
    rows = _with_listed(screened, listed).filter(F.col("category").isin(*LEADS) | F.col("confirmed"))
    return rows.select(*_public_columns(), _place(F.col("score")))


def private_review(screened: DataFrame, private: DataFrame, listed: DataFrame, users: DataFrame) -> DataFrame:
    """The private sheet: what bookings and staff lists (``private``: doi, score, priority, reasons) and known users (doi) add, before the public columns.

    ``review_place`` orders it by the private score. Kept apart from the public sheet, which shows nothing of these.
    """
    more = private.select("doi", F.col("score").alias("_score"), F.col("priority").alias("_priority"), F.col("reasons").alias("_reasons"))
    rows = _with_listed(screened, listed).join(more, "doi", "left").join(users.select("doi", F.lit(True).alias("_user")).distinct(), "doi", "left")
    rows = rows.filter(F.col("category").isin(*LEADS) | F.col("confirmed") | F.col("_priority").isin(*FLAGGED))
    score = F.coalesce("_score", "score", F.lit(0))
    own = (F.coalesce("_priority", "priority").alias("private_priority"), score.alias("private_score"), F.coalesce(F.array_join("_reasons", "; "), F.lit("")).alias("private_reasons"), F.coalesce("_user", F.lit(False)).alias("known_user_match"))
    return rows.select(*own, *_public_columns(), _place(score))


def match_users(papers: DataFrame, users: DataFrame) -> DataFrame:
    """(doi, user): users (user) whose surname and initial are those of an author of ``papers`` (doi, local_authors)."""
    own = papers.select("doi", F.explode("local_authors").alias("author")).withColumn("key", T.name_key(F.col("author")))
    keyed = users.withColumn("key", T.name_key(F.col("user"))).filter(F.col("key").rlike(r"^.+\|.$"))
    return own.join(keyed, "key").select("doi", "user").distinct()


def paper_links(doi: Column, open_copy: Column, pmcid: Column, preprint: Column) -> Column:
    """array<struct<label, url>>: the published version and open copies, each address once."""
    entry = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    told = lambda c, prefix: F.when(T.present(c), F.concat(F.lit(prefix), c))
    rows = F.array(entry("published version (DOI)", link(doi)), entry("open copy", F.nullif(open_copy, F.lit(""))), entry("Europe PMC full text", told(pmcid, "https://europepmc.org/article/PMC/")), entry("Europe PMC preprint", told(preprint, "https://europepmc.org/article/PPR/")))
    rows = F.filter(rows, lambda x: x.url.isNotNull())
    return F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda o: o.url == x.url))


def escaped(c: Column) -> Column:
    """Text as it can stand in a page; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(reference))
    return out


def card(table: DataFrame) -> DataFrame:
    """(doi, card): a row of the table to validate as a piece of a page, with where the paper can be read (``links``)."""
    places = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a href="'), escaped(x.url), F.lit('">'), escaped(x.label), F.lit("</a>"))), " &nbsp;·&nbsp; ")
    rank = F.when(F.col("embedding_rank").isNotNull(), F.concat(F.lit(" · embedding rank "), F.col("embedding_rank").cast("string"))).otherwise("")
    now = F.when(T.present(F.col("verdict")), F.concat(F.lit(" · <b>now: "), escaped(F.col("verdict")), F.lit("</b>"))).otherwise("")
    parts = (F.lit("<div><b>"), escaped(F.col("title")), F.lit("</b><br>"), escaped(F.col("why")), rank, now, F.lit("<br><i>"), escaped(F.col("journal")), F.lit("</i> · "), escaped(F.col("doi")), F.lit("<br>"), places, F.lit("<br><small>"), escaped(F.substring("evidence", 1, 600)), F.lit("</small></div>"))
    return table.select("doi", F.concat(*parts).alias("card"))


def issue_link(repo: str, facility: str, dois: Column) -> Column:
    """A link that opens a new issue with the facility and the DOIs filled in."""
    base = repo.removesuffix(".git").rstrip("/")
    return F.concat(F.lit(f"{base}/issues/new?template=add-papers.yml&facility="), F.url_encode(F.lit(facility)), F.lit("&dois="), F.url_encode(dois))


def ranked_in_group(listed: DataFrame) -> DataFrame:
    """``candidates`` with ``place``: their number within each group."""
    w = Window.partitionBy("listing").orderBy(F.coalesce("embedding_rank", F.lit(_FAR)), "doi")
    return listed.withColumn("place", F.row_number().over(w))
