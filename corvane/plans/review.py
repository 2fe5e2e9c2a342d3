"""Queries of the tables people work with: recall, verdicts, lists to validate, contacts, filing of papers, coverage.

Confirmed papers are documents of label quality 1; a paper's candidates are all but every eleventh; decisions follow from
labels; ranks from ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contacts, papers as filing, reports, screening, sheets
from corvane.plans.catalogue import screened
from corvane.plans.registry import PAPERS_SQL, RULES, SCREENED, has_sql, norm_sql, papers, query, read, stored

_CONFIRMED = "confirmed AS (SELECT p.doc_id, p.doi, p.year, p.title FROM papers p JOIN labels l USING (doc_id) WHERE l.quality = 1)"
_JOINED = SCREENED + f""", {_CONFIRMED}, j AS (SELECT r.doi, r.year, r.priority, r.category, r.has_text, r.title, r.reasons, r.doc_id, r.doc_id % 11 <> 0 AS candidate, c.doc_id IS NOT NULL AS listed, coalesce(r.priority IN ('report', 'check'), false) AS flagged
  FROM ranked r LEFT JOIN confirmed c USING (doc_id))"""
_COUNTS = """listed AS (SELECT year, (count(*) FILTER (listed))::BIGINT AS listed, (count(*) FILTER (listed AND flagged))::BIGINT AS found, (count(*) FILTER (listed AND candidate))::BIGINT AS listed_in_universe,
  (count(*) FILTER (listed AND has_text))::BIGINT AS listed_with_text, (count(*) FILTER (listed AND flagged AND has_text))::BIGINT AS found_with_text, (count(*) FILTER (NOT listed AND priority = 'report'))::BIGINT AS new_report,
  (count(*) FILTER (NOT listed AND priority = 'check'))::BIGINT AS new_check, count(*)::BIGINT AS screened FROM j GROUP BY year)"""
_SHARE = "found / listed::DOUBLE"
_HALF = f"1.96 * sqrt({_SHARE} * (1 - {_SHARE}) / listed + 1.96 * 1.96 / (4.0 * listed * listed))"
_BOUND = "CASE WHEN listed = 0 THEN 0.0 ELSE round(greatest(0, least(1, ({share} + 1.96 * 1.96 / (2 * listed) {sign} {half}) / (1 + 1.96 * 1.96 / listed))), 6)::DOUBLE END"
_INTERVAL = f"round(CASE WHEN listed > 0 THEN {_SHARE} END, 6) AS recall, {_BOUND.format(share=_SHARE, sign='-', half=_HALF)} AS low, {_BOUND.format(share=_SHARE, sign='+', half=_HALF)} AS high"


def confirmed(spark: SparkSession, d: str) -> DataFrame:
    good = read(spark, d, "labels").filter("quality = 1").select("doc_id")
    return papers(spark, d).join(good, "doc_id").select("doi", "year", "title")


def universe(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).filter("doc_id % 11 <> 0").select("doi", "year")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("recall", "low", "high")})


def _recall(spark: SparkSession, d: str) -> DataFrame:
    return reports.recall(confirmed(spark, d), screened(spark, d), universe(spark, d))


# ---- how well the search works -------------------------------------------------------------------------------------


@query(_JOINED + f", {_COUNTS} SELECT *, {_INTERVAL} FROM listed")
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.with_interval(_recall(spark, d)))


@query(_JOINED + f", {_COUNTS}, t AS (SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in "listed found listed_in_universe listed_with_text found_with_text new_report new_check screened".split()) + f" FROM listed) SELECT *, {_INTERVAL} FROM t")
def recall_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.totals(_recall(spark, d)))


@query(_JOINED + " SELECT coalesce(year::VARCHAR, 'all') AS year, (count(*) FILTER (listed))::BIGINT AS listed, (count(*) FILTER (listed AND flagged))::BIGINT AS found FROM j GROUP BY ROLLUP (year)")
def recall_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = screened(spark, d).select("doi", "year", "priority").join(confirmed(spark, d).select("doi", F.lit(True).alias("listed")), "doi", "left")
    listed = F.coalesce("listed", F.lit(False))
    return rows.rollup("year").agg(F.count_if(listed).alias("listed"), F.count_if(listed & F.col("priority").isin("report", "check")).alias("found")).withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("all")))


@query(_JOINED + """ SELECT doi, year, CASE WHEN NOT candidate THEN 'not among the year''s candidates (institutional sources, Europe PMC)' WHEN NOT has_text THEN 'no full text'
  ELSE 'text found, ranked ' || coalesce(priority, 'low') || ' (category ' || category || ')' END AS why FROM j WHERE listed AND NOT flagged""")
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.missed(confirmed(spark, d), screened(spark, d), universe(spark, d))


_DECISIONS = f"""WITH {PAPERS_SQL}, dec AS (SELECT p.year, p.doi, CASE p.doc_id % 4 WHEN 0 THEN 'new: acknowledges the facility' WHEN 1 THEN 'reads like facility papers (rank ' || (p.doc_id % 250 + 1) || ')' WHEN 2 THEN 'new: facility instrument, no acknowledgement' ELSE 'by hand' END AS why,
  (p.doc_id % 250 + 1)::INTEGER AS embedding_rank, CASE WHEN l.toxic = 1 THEN 'no' WHEN l.quality = 1 THEN 'yes' ELSE 'likely' END AS verdict, CASE p.doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no imaging' ELSE 'other' END AS reason FROM labels l JOIN papers p USING (doc_id)),
g AS (SELECT *, CASE WHEN why LIKE 'new: ack%' THEN 'acknowledges' WHEN why LIKE 'reads%' THEN 'check list' WHEN why LIKE 'new: fac%' THEN 'instrument' ELSE 'other' END AS why_group,
  CASE WHEN embedding_rank <= 50 THEN '1-50' WHEN embedding_rank <= 100 THEN '51-100' WHEN embedding_rank <= 200 THEN '101-200' ELSE '201+' END AS band FROM dec) """


def decided(spark: SparkSession, d: str) -> DataFrame:
    i, rank = F.col("doc_id"), (F.col("doc_id") % 250 + 1).cast("int")
    why = F.when(i % 4 == 0, sheets.WHY_ACK).when(i % 4 == 1, F.format_string("%s (rank %d)", F.lit(sheets.WHY_SIMILAR), rank)).when(i % 4 == 2, sheets.WHY_INSTRUMENT).otherwise("by hand")
    verdict = F.when(F.col("toxic") == 1, " No ").when(F.col("quality") == 1, "yes").otherwise("LIKELY")
    rows = papers(spark, d).select("doc_id", "year", "doi").join(read(spark, d, "labels"), "doc_id")
    table = rows.select("year", F.upper("doi").alias("doi"), why.alias("why"), rank.alias("embedding_rank"), verdict.alias("verdict"), F.when(i % 3 == 0, "").when(i % 3 == 1, "no imaging").otherwise("other").alias("reason"), F.lit("").alias("note"))
    return sheets.decisions(table)


@query(_DECISIONS + "SELECT year, doi, why, embedding_rank, verdict, reason, '' AS note FROM g")
def decisions_list(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d)


@query(_DECISIONS + """SELECT why_group, (count(*) FILTER (verdict = 'yes'))::BIGINT AS yes, (count(*) FILTER (verdict = 'likely'))::BIGINT AS likely, (count(*) FILTER (verdict = 'no'))::BIGINT AS no FROM g GROUP BY 1""")
def feedback_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.verdict_groups(decided(spark, d))


@query(_DECISIONS + """SELECT band, count(*)::BIGINT AS reviewed, (count(*) FILTER (verdict = 'yes'))::BIGINT AS yes FROM g WHERE why_group = 'check list' GROUP BY 1""")
def feedback_bands(spark: SparkSession, d: str) -> DataFrame:
    return reports.rank_bands(decided(spark, d))


@query(_DECISIONS + """SELECT why_group, coalesce(nullif(reason, ''), '(no reason given)') AS reason, count(*)::BIGINT AS n FROM g WHERE verdict = 'no' GROUP BY ALL""")
def feedback_no_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.no_reasons(decided(spark, d))


@query(_DECISIONS + """SELECT year, doi, embedding_rank AS rank, reason FROM g WHERE why_group = 'check list' AND verdict = 'yes'""")
def rules_missed(spark: SparkSession, d: str) -> DataFrame:
    return reports.rules_missed(decided(spark, d))


# ---- what to validate ------------------------------------------------------------------------------------------------

_YEAR, _TOP = 2018, 20
_KEPT = "kept AS (SELECT p.doi, CASE WHEN p.doc_id % 3 = 0 THEN 'yes' WHEN p.doc_id % 3 = 1 THEN 'no' ELSE '' END AS verdict, CASE WHEN p.doc_id % 3 = 2 THEN 'r' ELSE '' END AS reason, '' AS note FROM papers p WHERE p.doc_id % 17 = 0)"
_RANKS = "ranks AS (SELECT doi, (doc_id * 37 % 1009 + 1)::INTEGER AS rank FROM papers WHERE year = 2018 AND doc_id % 2 = 0)"
_CANDIDATES = (
    SCREENED + f""", {_CONFIRMED}, {_KEPT}, {_RANKS}, y AS (SELECT * FROM ranked WHERE year = 2018), fresh AS (SELECT y.* FROM y WHERE doi NOT IN (SELECT doi FROM confirmed)),
fl AS (SELECT doi, CASE WHEN priority = 'report' THEN 1 ELSE 2 END AS listing FROM fresh WHERE priority IN ('report', 'check')),
al AS (SELECT doi, 3 AS listing FROM ranks WHERE doi NOT IN (SELECT doi FROM confirmed) AND doi NOT IN (SELECT doi FROM y WHERE priority IN ('report', 'check')) ORDER BY rank, doi LIMIT 20),
li AS (SELECT * FROM fl UNION ALL SELECT * FROM al), ea AS (SELECT doi, 4 AS listing FROM kept WHERE doi NOT IN (SELECT doi FROM li) AND doi NOT IN (SELECT doi FROM confirmed)),
al4 AS (SELECT listing, doi FROM li UNION ALL SELECT listing, doi FROM ea), cand AS (SELECT listing::INTEGER AS listing, CASE listing WHEN 1 THEN 'new: acknowledges the facility' WHEN 2 THEN 'new: facility instrument, no acknowledgement'
  WHEN 3 THEN 'reads like facility papers (rank ' || rank || ')' ELSE 'earlier verdict (no longer a candidate)' END AS why, a.doi, rank AS embedding_rank FROM al4 a LEFT JOIN ranks r ON r.doi = a.doi) """
)


def kept_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """An earlier table, in which a paper was decided twice: the later row counts."""
    i = F.col("doc_id")
    rows = papers(spark, d).filter("doc_id % 17 = 0").select("doi", "doc_id")
    last = rows.select(F.concat(F.lit(" "), F.upper("doi")).alias("doi"), F.when(i % 3 == 0, "Yes").when(i % 3 == 1, "no ").otherwise(None).alias("verdict"), F.when(i % 3 == 2, "r").alias("reason"), F.lit(None).cast("string").alias("note"), (i + 1_000_000).alias("pos"))
    first = rows.select("doi", F.lit("likely").alias("verdict"), F.lit("old").alias("reason"), F.lit("").alias("note"), i.alias("pos"))
    empty = papers(spark, d).filter("doc_id % 17 = 1").select("doi", F.lit(" ").alias("verdict"), F.lit("").alias("reason"), F.lit("").alias("note"), i.alias("pos"))
    return sheets.verdicts(last.unionByName(first).unionByName(empty))


def year_ranks(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).filter(f"year = {_YEAR} AND doc_id % 2 = 0").select("doi", (F.col("doc_id") * 37 % 1009 + 1).cast("int").alias("rank"))


def year_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = screened(spark, d).filter(f"year = {_YEAR}").withColumn("journal", F.col("source"))
    return stored(rows.select("doi", "title", "journal", "priority", "category", "score_reasons", "acknowledgement", "evidence", "has_text"), "screened")


@query(f"WITH {PAPERS_SQL}, {_KEPT} SELECT * FROM kept")
def verdict_carry(spark: SparkSession, d: str) -> DataFrame:
    return kept_verdicts(spark, d)


@query(_CANDIDATES + 'SELECT listing, why, doi, embedding_rank, (row_number() OVER (PARTITION BY listing ORDER BY coalesce(embedding_rank, 1000000000), doi))::INTEGER AS place FROM cand')
def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    """What to validate, in the order to read it."""
    return sheets.ranked_in_group(sheets.candidates(year_rows(spark, d), confirmed(spark, d), year_ranks(spark, d), kept_verdicts(spark, d), _TOP))


@query(_CANDIDATES + """SELECT c.listing, c.why, c.doi, 'https://doi.org/' || c.doi AS link, coalesce(y.title, '') AS title, coalesce(y.source, '') AS journal,
  CASE WHEN y.has_text THEN CASE WHEN y.acked THEN 'yes' ELSE 'no' END WHEN p.text IS NULL OR p.text = '' THEN 'unknown (no full text)' WHEN """ + has_sql(norm_sql("p.text"), RULES.acknowledgement) + """ THEN 'yes' ELSE 'no' END AS acknowledges_facility,
  coalesce(y.priority, '') AS priority, c.embedding_rank, coalesce(k.verdict, '') AS verdict, coalesce(k.reason, '') AS reason, coalesce(k.note, '') AS note, coalesce(starts_with(y.reasons, ''), true) AS has_reasons
  FROM cand c LEFT JOIN y ON y.doi = c.doi LEFT JOIN kept k ON k.doi = c.doi LEFT JOIN papers p ON p.doi = c.doi""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """The table to validate; its evidence column is checked by ``evidence_capped`` and ``sentence_evidence``."""
    kept, rows = kept_verdicts(spark, d), year_rows(spark, d)
    listed = sheets.candidates(rows, confirmed(spark, d), year_ranks(spark, d), kept, _TOP)
    table = sheets.validate_table(listed, rows, kept, papers(spark, d).select("doi", "text"), RULES)
    return table.withColumn("has_reasons", F.lit(True)).drop("evidence")


@query(_JOINED + """ SELECT doi, 'https://doi.org/' || doi AS link, title, CASE WHEN NOT candidate THEN 'not among the year''s candidates (institutional sources, Europe PMC)' WHEN NOT has_text THEN 'no full text'
  ELSE 'text found, ranked ' || coalesce(priority, 'low') || ' (category ' || category || ')' END AS why_missed, coalesce(priority, '') AS priority, category, reasons AS score_reasons FROM j WHERE listed AND NOT flagged""")
def search_misses(spark: SparkSession, d: str) -> DataFrame:
    return sheets.search_misses(confirmed(spark, d), screened(spark, d), universe(spark, d))


@query(f"WITH {PAPERS_SQL}, {_KEPT} SELECT doi || ' 2018' AS line FROM kept WHERE verdict = 'yes' AND doi NOT IN (SELECT p.doi FROM papers p JOIN labels l USING (doc_id) WHERE l.quality = 1)")
def papers_to_file(spark: SparkSession, d: str) -> DataFrame:
    """The new "yes" papers as lines to file; the other tables of ``sheets.build`` have queries of their own."""
    none = papers(spark, d).select("doi", F.array().cast("array<struct<name:string,email:string>>").alias("contacts")).limit(0)
    table = kept_verdicts(spark, d).withColumn("pos", F.lit(1))
    return sheets.build(year_rows(spark, d), confirmed(spark, d), year_ranks(spark, d), table, papers(spark, d).select("doi", "text"), none, universe(spark, d).select("doi"), _YEAR, RULES, _TOP)[1]


@query(_DECISIONS + "SELECT doi, verdict FROM g WHERE verdict = 'likely'")
def pending_review(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a verdict, and those to be decided again."""
    return sheets.pending(decided(spark, d), ("Likely",)).select("doi", "verdict")


@query(_DECISIONS + "SELECT doi, CASE WHEN doi = (SELECT min(doi) FROM g) THEN 'no' ELSE verdict END AS verdict, CASE WHEN doi = (SELECT min(doi) FROM g) THEN 'other' ELSE reason END AS reason FROM g")
def set_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One decision written into a table."""
    table = decided(spark, d).withColumn("pos", F.monotonically_increasing_id())
    first = table.agg(F.min("doi")).first()[0]
    return sheets.set_verdict(table, first.upper(), " NO", "other", "by hand").select("doi", "verdict", "reason")


_SHEET = """r.doi, r.priority, r.score, r.reasons AS score_reasons, r.category, c.doi IS NOT NULL AS confirmed, array_to_string(r.local_authors, '; ') AS local_authors, array_to_string(strong, '; ') AS instruments_strong, array_to_string(special, '; ') AS techniques_specialist,
  array_to_string(list_transform(prints, lambda q: q.id || ': ' || array_to_string(q.value, ', ')), '; ')[1:400] AS fingerprint"""
_SHEET_COLUMNS = ("doi", "priority", "score", "score_reasons", "category", "confirmed", "local_authors", "instruments_strong", "techniques_specialist", "fingerprint")


@query(SCREENED + f""", {_CONFIRMED} SELECT {_SHEET} FROM ranked r LEFT JOIN confirmed c ON c.doi = r.doi WHERE r.category IN ('A', 'B', 'C', 'D', 'E') OR c.doi IS NOT NULL""")
def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The public review sheet of leads and confirmed papers."""
    rows = sheets.review_rows(screened(spark, d), confirmed(spark, d))
    return rows.select(*_SHEET_COLUMNS)


_BOOKED, _USED = (f"+{RULES.weights[k]} {why}" for k, why in (("group_booked", "group booked the facility"), ("booked_instrument_used", "booked instrument named in paper")))


@query(SCREENED + f""", {_CONFIRMED}, v AS (SELECT {_SHEET}, CASE WHEN private_points > 0 AND has_text THEN private_priority ELSE priority END AS private_priority, (coalesce(score, 0) + CASE WHEN has_text THEN private_points ELSE 0 END)::INTEGER AS private_score,
  CASE WHEN NOT has_text OR private_points = 0 THEN '' WHEN private_points = {RULES.weights["group_booked"]} THEN '{_BOOKED}' ELSE '{_BOOKED}; {_USED}' END AS private_reasons, list_contains(r.local_authors, 'Eessoa, Eina') AS known_user_match, private_points > 0 AND has_text AND private_priority IN ('report', 'check') AS up
  FROM ranked r LEFT JOIN confirmed c ON c.doi = r.doi)
  SELECT * EXCLUDE (up) FROM v WHERE category IN ('A', 'B', 'C', 'D', 'E') OR confirmed OR up""")
def private_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The private review sheet: what private inputs add, then the public columns."""
    rows = stored(screened(spark, d), "screened")
    users = sheets.match_users(rows, spark.createDataFrame([("Eina Eessoa",), ("nobody",)], "user string"))
    public, private = screening.split_private(rows)
    sheet = sheets.private_review(public, private, confirmed(spark, d), users)
    return sheet.select("private_priority", "private_score", "private_reasons", "known_user_match", *_SHEET_COLUMNS)


@query(f"""WITH {PAPERS_SQL}, l AS (SELECT doi, list_filter(['https://doi.org/' || doi, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/' || doi WHEN 1 THEN 'https://repo/' || doc_id ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 'https://europepmc.org/article/PMC/PMC' || doc_id END], lambda x: x <> '') AS u FROM papers)
  SELECT doi, array_to_string(CASE WHEN len(u) > 1 AND u[2] = u[1] THEN list_concat(u[1:1], u[3:]) ELSE u END, ' ') AS urls FROM l""")
def open_links(spark: SparkSession, d: str) -> DataFrame:
    """Where a paper can be read, each address once."""
    i = F.col("doc_id")
    copy = F.when(i % 3 == 0, sheets.link(F.col("doi"))).when(i % 3 == 1, F.concat(F.lit("https://repo/"), i.cast("string"))).otherwise("")
    urls = sheets.paper_links(F.col("doi"), copy, F.when(i % 2 == 0, F.concat(F.lit("PMC"), i.cast("string"))), F.lit(None).cast("string"))
    return papers(spark, d).select("doi", F.array_join(F.transform(urls, lambda x: x.url), " ").alias("urls"))


@query(f"""WITH {PAPERS_SQL}, e AS (SELECT doi, doc_id, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS t FROM papers)
  SELECT doi, '<div><b>' || t || '</b><br>a &lt; b' || CASE WHEN doc_id % 2 = 0 THEN ' · embedding rank ' || doc_id ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' · <b>now: yes</b>' ELSE '' END || '<br><i></i> · ' || doi || '<br><a href="https://doi.org/' || doi || '">published version (DOI)</a><br><small>' || repeat('e', 600) || '</small></div>' AS card FROM e""")
def review_cards(spark: SparkSession, d: str) -> DataFrame:
    """Rows to validate as pieces of a page."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = papers(spark, d).select("doi", "title", F.lit("a < b").alias("why"), F.when(i % 2 == 0, i).alias("embedding_rank"), F.when(i % 3 == 0, "yes").alias("verdict"), none.alias("journal"), F.lit("e" * 700).alias("evidence"), sheets.paper_links(F.col("doi"), none, none, none).alias("links"))
    return sheets.card(rows)


# ---- contacts --------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT c_custkey, chr((65 + c_custkey % 26)::INTEGER) || 'lba' AS g, chr((66 + c_custkey % 20)::INTEGER) || 'erneth' AS f, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 3 THEN '' ELSE lower(g) || '.' || lower(f) || '@uni' || c_custkey || '.edu' END AS emails, CASE k WHEN 0 THEN g || ' ' || f WHEN 1 THEN g || ' ' || f WHEN 2 THEN 'Maria Other' ELSE '' END AS names FROM n""")
def contact_extract(spark: SparkSession, d: str) -> DataFrame:
    """Corresponding authors of invented papers: named by the author list, by the text, or not at all; journals' and unmarked addresses are left out."""
    i = F.col("c_custkey")
    g, f = F.concat(F.char(65 + i % 26), F.lit("lba")), F.concat(F.char(66 + i % 20), F.lit("erneth"))
    mail = F.concat(F.initcap(F.lower(g)), F.lit("."), F.lower(f), F.lit("@uni"), i.cast("string"), F.lit(".edu"))
    body = F.lit("The samples were kept cold and looked at. " * 40)
    marked = F.concat(body, F.lit("Editor: editor@nature.com. Correspondence to: Maria Other, "), mail, F.lit(". See fig1@x.png. "), body, body, F.lit("Web: someone@else.org. "), body)
    text = F.when(i % 4 == 3, F.concat(body, F.lit(" permissions@elsevier.com "))).otherwise(marked)
    authors = F.when(i % 4 == 0, F.array(F.concat(f, F.lit(", "), g), F.lit("Other, Maria"))).when(i % 4 == 1, F.array(F.lit("Paul Else"), F.concat(g, F.lit(" "), f))).otherwise(F.array(F.lit("Else, Paul")))
    keys = read(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)  # a file of narrow rows is one piece; the texts are made behind the deal
    got = keys.select("c_custkey", contacts.corresponding(text, authors).alias("c"))
    joined = lambda n: F.array_join(F.transform("c", lambda x: x[n]), "; ")
    return got.select("c_custkey", joined("email").alias("emails"), joined("name").alias("names"))


@query(f"""
WITH {PAPERS_SQL}, p AS (SELECT doi, coalesce(title, '') AS title, CASE WHEN doc_id % 2 = 0 THEN 'confirmed' ELSE 'likely' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS acknowledges_facility, 'unknown' AS grant_cited, doc_id FROM papers),
c AS (SELECT p.*, 1 AS i, CASE WHEN doc_id % 4 = 0 THEN 'A' ELSE 'a' END || (doc_id % 23) || '@x.org' AS email, CASE WHEN doc_id % 5 = 0 THEN 'N' || doc_id ELSE '' END AS name FROM p WHERE doc_id % 3 <> 2 UNION ALL SELECT p.*, 2, 'b' || (doc_id % 29) || '@y.org', 'M' FROM p WHERE doc_id % 3 = 1)
SELECT coalesce(arg_min(name, doi) FILTER (name <> ''), '') AS name, arg_min(email, doi) AS email, CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' ELSE 'likely' END AS status, count(*)::BIGINT AS papers, string_agg(doi, '; ' ORDER BY doi) AS dois, string_agg(title, '; ' ORDER BY doi) AS titles,
  string_agg(acknowledges_facility, '; ' ORDER BY doi) AS acknowledges_facility, string_agg(grant_cited, '; ' ORDER BY doi) AS grant_cited FROM c GROUP BY lower(email)
UNION ALL SELECT '', '', status, 1, doi, title, acknowledges_facility, grant_cited FROM p WHERE doc_id % 3 = 2""")
def contact_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row an address, with its papers."""
    i = F.col("doc_id")
    entry = lambda name, mail: F.struct(name.alias("name"), mail.alias("email"))
    a = entry(F.when(i % 5 == 0, F.concat(F.lit("N"), i.cast("string"))).otherwise(""), F.concat(F.when(i % 4 == 0, "A").otherwise("a"), (i % 23).cast("string"), F.lit("@x.org")))
    b = entry(F.lit("M"), F.concat(F.lit("b"), (i % 29).cast("string"), F.lit("@y.org")))
    none = entry(F.lit("nobody"), F.lit(""))
    rows = papers(spark, d).select("doi", F.coalesce("title", F.lit("")).alias("title"), F.when(i % 2 == 0, "confirmed").otherwise("likely").alias("status"), F.when(i % 3 == 0, "yes").otherwise("no").alias("acknowledges_facility"), F.lit("unknown").alias("grant_cited"), F.when(i % 3 == 0, F.array(a)).when(i % 3 == 1, F.array(a, b)).otherwise(F.array(none)).alias("contacts"))
    return contacts.contact_rows(rows).drop("place")


# ---- filing ----------------------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT p_partkey AS pos, p_partkey % 700 AS id, p_size, CASE WHEN p_size % 5 = 0 THEN (1990 + p_size)::INTEGER END AS year FROM part),
pasted AS (SELECT pos, 0 AS k, CASE WHEN p_size % 11 = 3 THEN NULL ELSE '10.1234/p' || id END AS doi, CASE WHEN p_size % 11 = 3 THEN NULL ELSE year END AS year FROM lines WHERE p_size % 13 <> 4)"""


def pasted(spark: SparkSession, d: str) -> DataFrame:
    """Pasted lines: DOIs in several wrappings, some with a year after them, notes, comments and lines without a DOI."""
    i, size = (F.col("p_partkey") % 700).cast("string"), F.col("p_size")
    year = F.when(size % 5 == 0, F.concat(F.lit("  "), (1990 + size).cast("string"))).otherwise(F.when(size % 5 == 1, " see 2001").otherwise(""))
    line = F.when(size % 13 == 4, F.concat(F.lit("  # 10.1234/p"), i)).when(size % 11 == 3, "no doi here").otherwise(F.concat(F.when(size % 2 == 0, "https://doi.org/").otherwise("DOI: "), F.lit("10.1234/P"), i, year, F.when(size % 7 == 0, "    # 10.9999/note").otherwise("")))
    return filing.parse_dois(read(spark, d, "part").select(F.col("p_partkey").alias("pos"), line.alias("line")))


@query(f"WITH {_LINES} SELECT pos, k::INTEGER AS k, doi, year FROM pasted")
def doi_parse_lines(spark: SparkSession, d: str) -> DataFrame:
    return pasted(spark, d).drop("line")


def _filed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    n = read(spark, d, "customer").select(F.col("c_custkey").alias("i")).filter("i <= 500")
    name = lambda df: F.concat(F.lit("10.1234/p"), F.col("i").cast("string")).alias("doi")
    return s.select(name(s), F.lit(2000).alias("year")), n.select(name(n), F.when(F.col("i") % 4 != 0, (2000 + F.col("i") % 20).cast("string")).alias("issued_year"))


@query(f"""
WITH RECURSIVE {_LINES}, held AS (SELECT '10.1234/p' || s_suppkey AS doi, 2000 AS y FROM supplier), meta AS (SELECT '10.1234/p' || c_custkey AS doi, CASE WHEN c_custkey % 4 <> 0 THEN (2000 + c_custkey % 20)::INTEGER END AS issued FROM customer WHERE c_custkey <= 500),
o AS (SELECT p.*, h.y AS held, m.doi IS NOT NULL AS known, m.issued, row_number() OVER (PARTITION BY p.doi ORDER BY pos) AS n FROM pasted p LEFT JOIN held h ON h.doi = p.doi LEFT JOIN meta m ON m.doi = p.doi WHERE p.doi IS NOT NULL),
f(doi, n, pos, k, year, status, stands) AS (
  SELECT doi, n, pos, k, year, CASE WHEN held IS NOT NULL THEN CASE WHEN year IS NOT NULL AND year <> held THEN 'moved' ELSE 'already' END WHEN NOT known THEN 'unknown doi' WHEN coalesce(year, issued) IS NULL THEN 'no year' ELSE 'added' END,
    CASE WHEN held IS NOT NULL THEN coalesce(year, held) WHEN known THEN coalesce(year, issued) END FROM o WHERE n = 1
  UNION ALL SELECT o.doi, o.n, o.pos, o.k, o.year, CASE WHEN f.stands IS NOT NULL THEN CASE WHEN o.year IS NOT NULL AND o.year <> f.stands THEN 'moved' ELSE 'already' END WHEN NOT known THEN 'unknown doi' WHEN coalesce(o.year, issued) IS NULL THEN 'no year' ELSE 'added' END,
    CASE WHEN f.stands IS NOT NULL THEN coalesce(o.year, f.stands) WHEN known THEN coalesce(o.year, issued) END FROM f JOIN o ON o.doi = f.doi AND o.n = f.n + 1)
SELECT pos, k::INTEGER AS k, doi, year, status, stands::INTEGER AS filed_year FROM f UNION ALL SELECT pos, k, doi, year, 'dropped', NULL FROM pasted WHERE doi IS NULL""")
def papers_merge_status(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each pasted line; the SQL goes through the lines one by one."""
    return filing.file_papers(pasted(spark, d), *_filed(spark, d))


_STATUS = f"""
WITH RECURSIVE {_LINES}, held AS (SELECT '10.1234/p' || s_suppkey AS doi, 2000 AS y FROM supplier), meta AS (SELECT '10.1234/p' || c_custkey AS doi, CASE WHEN c_custkey % 4 <> 0 THEN (2000 + c_custkey % 20)::INTEGER END AS issued FROM customer WHERE c_custkey <= 500),
s AS (SELECT p.*, h.y AS held, m.doi IS NOT NULL AS known, m.issued FROM pasted p LEFT JOIN held h ON h.doi = p.doi LEFT JOIN meta m ON m.doi = p.doi WHERE p.doi IS NOT NULL)
"""


@query(_STATUS + """SELECT pos, k::INTEGER AS k, concat_ws(' ', doi, year::VARCHAR) || CASE WHEN NOT known THEN '    # no registry knows this DOI' ELSE '    # which year? write it behind the DOI' END AS note
FROM s WHERE held IS NULL AND (NOT known OR (issued IS NULL AND year IS NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doi = s.doi AND o.pos < s.pos AND o.year IS NOT NULL)))""")
def papers_left_over(spark: SparkSession, d: str) -> DataFrame:
    """Lines to hand back, with what is wrong."""
    return filing.leftover(filing.file_papers(pasted(spark, d), *_filed(spark, d)))


@query(_STATUS + """SELECT doi, coalesce(arg_max(year, pos) FILTER (year IS NOT NULL), any_value(held), any_value(issued))::INTEGER AS year, CASE WHEN any_value(held) IS NULL THEN 'staff' END AS source
FROM (SELECT doi, pos, year, held, known, issued FROM s UNION ALL SELECT doi, 0, NULL, y, false, NULL FROM held) GROUP BY doi HAVING any_value(held) IS NOT NULL OR (bool_or(known) AND (any_value(issued) IS NOT NULL OR bool_or(year IS NOT NULL)))""")
def papers_after_filing(spark: SparkSession, d: str) -> DataFrame:
    """All filed papers with what was added and moved."""
    held, known = _filed(spark, d)
    return filing.filed_after(held, filing.file_papers(pasted(spark, d), held, known), known, "staff", "2024-01-01").select("doi", F.col("year").cast("int"), "source")


@query("""
WITH e AS (SELECT p_partkey AS pos, CASE WHEN p_size = 7 THEN '2023' WHEN p_size = 15 THEN '2024' ELSE CASE p_size % 4 WHEN 0 THEN '2020' WHEN 1 THEN '2021' WHEN 2 THEN '2022' ELSE 'notes' END END AS file,
  CASE WHEN p_size % 9 = 2 THEN '10.1234/UP' || p_partkey WHEN p_size % 9 = 5 THEN NULL ELSE '10.1234/p' || (100000 + p_partkey % 1500) END AS doi, p_size % 8 = 1 AS mail, p_size % 6 = 0 AS unsourced, p_size % 10 = 7 AS private FROM part),
f AS (SELECT file, bool_or(file = '2023' AND pos % 3 = 0) AS broken, bool_or(file = '2024' AND pos % 3 = 0) AS mixed FROM e GROUP BY file),
w AS (SELECT file, CASE WHEN file = 'notes' THEN 'the file''s name is no year' WHEN broken THEN 'lines of the file are no JSON' WHEN mixed THEN 'the file holds more than entries' END AS problem FROM f),
n AS (SELECT *, coalesce(doi, '') AS x, lag(coalesce(doi, '')) OVER (PARTITION BY file ORDER BY pos) AS previous, lag(file) OVER (PARTITION BY coalesce(doi, '') ORDER BY file, pos) AS earlier, coalesce(doi, '') LIKE '10.1234/p%' AS good, pos % 1500 < 600 AS known FROM e WHERE file IN (SELECT file FROM w WHERE problem IS NULL))
SELECT file, NULL AS doi, problem FROM w WHERE problem IS NOT NULL UNION ALL SELECT DISTINCT file, NULL, 'DOIs are out of order' FROM n WHERE previous > x UNION ALL
SELECT file, x, unnest(list_filter([CASE WHEN NOT good THEN 'the DOI is missing or not in its short lower-case form' END, CASE WHEN good AND earlier IS NOT NULL THEN 'stands in ' || earlier || ' and in ' || file END,
  CASE WHEN good AND private THEN 'has fields that aren''t public: by, note' END, CASE WHEN good AND mail THEN 'an e-mail address is in it' END, CASE WHEN good AND NOT known AND unsourced THEN 'new, and nothing tells who confirmed it' END, CASE WHEN good AND NOT known AND (100000 + pos % 1500) % 7 = 0 THEN 'new, and no registry knows its DOI' END], lambda p: p IS NOT NULL)) AS problem FROM n""")
def papers_check(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong with filed papers, unreadable files included."""
    i, size = F.col("p_partkey"), F.col("p_size")
    name = lambda k: F.concat(F.lit("10.1234/p"), (100000 + k).cast("string"))
    doi = F.when(size % 9 == 2, F.concat(F.lit("10.1234/UP"), i.cast("string"))).when(size % 9 == 5, None).otherwise(name(i % 1500))
    file = F.when(size == 7, "2023").when(size == 15, "2024").when(size % 4 == 0, "2020").when(size % 4 == 1, "2021").when(size % 4 == 2, "2022").otherwise("notes")
    private = F.when(size % 10 == 7, "private")
    entry = F.to_json(F.struct(doi.alias("doi"), F.when(size % 8 == 1, "write to a.b@c.org").otherwise(F.col("p_name")).alias("title"), F.when(size % 6 == 0, "").otherwise("staff").alias("source"), private.alias("note"), private.alias("by")))
    line = F.when((size == 7) & (i % 3 == 0), '{"doi": ').when((size == 15) & (i % 3 == 0), "[1, 2]").otherwise(entry)
    lines = read(spark, d, "part").select(file.alias("file"), i.alias("pos"), line.alias("line"))
    ids = spark.range(1500)
    return filing.check_papers(lines, ids.filter("id < 600").select(name(F.col("id")).alias("doi")), ids.filter("(100000 + id) % 7 <> 0").select(name(F.col("id")).alias("doi")))


# ---- coverage --------------------------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'scope-a' WHEN p_size % 5 = 1 THEN 'scope-c' ELSE 'new-' || (p_size % 5) END AS instrument, p_size FROM part), o AS (SELECT instrument, 'name of ' || instrument AS name, unnest(CASE p_size % 3 WHEN 0 THEN ['erbling', 'generic'] WHEN 1 THEN ['flim', 'sted'] ELSE [] END) AS term FROM r),
a AS (SELECT DISTINCT instrument, 'name of ' || instrument AS name FROM r), t AS (SELECT term, string_agg(DISTINCT instrument, ', ' ORDER BY instrument) AS found_on FROM o WHERE term <> 'generic' GROUP BY term)
SELECT 'no pattern' AS gap, instrument AS item, name AS found_on FROM a WHERE instrument NOT IN ({', '.join(repr(i.id) for i in RULES.instruments)}) UNION ALL SELECT 'no components', instrument, name FROM a WHERE instrument IN ({', '.join(repr(i.id) for i in RULES.instruments if not i.components)})
UNION ALL SELECT 'no technique', term, found_on FROM t WHERE term NOT IN ({', '.join(repr(x.id) for x in RULES.techniques)}) UNION ALL SELECT 'unused technique', x, '' FROM (SELECT unnest([{', '.join(repr(x.id) for x in RULES.techniques)}]) AS x) WHERE x NOT IN (SELECT term FROM t)""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Where rules and instrument records don't meet."""
    size = F.col("p_size")
    name = F.when(size % 5 == 0, "scope-a").when(size % 5 == 1, "scope-c").otherwise(F.concat(F.lit("new-"), (size % 5).cast("string")))
    modes = F.when(size % 3 == 0, F.lit(["erbling", "generic"])).when(size % 3 == 1, F.lit(["sted"])).otherwise(F.array().cast("array<string>"))
    modules = F.when(size % 3 == 1, F.lit(["flim_unit", "stage"])).otherwise(F.array().cast("array<string>"))
    records = read(spark, d, "part").select(name.alias("instrument"), F.concat(F.lit("name of "), name).alias("name"), modes.alias("modes"), modules.alias("modules")).distinct()
    return reports.coverage(reports.capabilities(records, {"flim_unit": "flim"}, ("generic",)), RULES)
