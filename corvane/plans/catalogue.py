"""The screening engine's queries: texts, screening, merges and joins, streams.

The driver's tables stand in for the engine's: documents for papers, ``labels.quality`` for the confirmed set, labels of
embeddings for years of vectors. ``review``, ``harvested`` and ``ranked`` register the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.operators import relational, reports, screening
from corvane.plans.registry import MAIL, NORM, ORACLES, PAPERS_SQL, PARTS, QUERIES, RULES, SCREENED, has_sql, papers, query, read, redact_sql
from corvane.rules import java_pattern
from corvane.streaming import events as stream

__all__ = ["ORACLES", "QUERIES"]


# ---- texts -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {NORM} AS clean FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, unnest({PARTS}) AS sentence, generate_subscripts({PARTS}, 1)::INTEGER AS pos FROM documents")
def sentence_list(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every text, with its place."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(T.normalise(F.col("text")))).alias("p", "sentence")).select("doc_id", "sentence", (F.col("p") + 1).alias("pos"))


@query(f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def redact_emails(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sentences: masked and cut to a sentence's length."""
    return read(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(f"SELECT doc_id, regexp_replace(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{MAIL}', '[email]', 'g') AS redacted FROM documents")
def redact_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.redact(F.col("text"), None).alias("redacted"))


_COMPACT = rf"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, {_COMPACT} AS t FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(lower(t), '{'|'.join(T.ACCESS_MARKERS)}') AND length(t) < 10000 THEN 'access_page' WHEN length(t) < 1500 THEN 'too_short'
  WHEN len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) < 200 THEN 'low_text_density' ELSE '' END AS reason, CASE WHEN reason <> '' THEN '' WHEN length(t) >= 10000 THEN 'high' ELSE 'medium' END AS quality FROM c""")
def article_check(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.article_check(F.col("text")).alias("v")).select("doc_id", "v.reason", "v.quality")


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text[1:30000]), '[a-z0-9]{4,}')) AS there FROM documents WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{4,}') AS wanted FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, unnest(wanted) AS word FROM b), h AS (SELECT doc_id, unnest(there) AS word FROM t), hits AS (SELECT doc_id, item_id, count(*) AS n FROM w JOIN h USING (word) GROUP BY ALL)
SELECT doc_id, item_id FROM hits JOIN b USING (item_id) WHERE len(wanted) >= 3 AND n >= 0.5 * len(wanted) UNION ALL SELECT doc_id, item_id FROM t, b WHERE len(wanted) < 3""")
def text_matches_title(spark: SparkSession, d: str) -> DataFrame:
    """Every document with every benchmark item that its text could be titled by."""
    return relational.every_title(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", "text"))


@query(rf"""
WITH {PAPERS_SQL}, t AS (SELECT doc_id, text, doi, lower(text[1:30000]) AS body, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{{4,}}') AS wanted FROM papers)
SELECT doc_id, coalesce(text <> '' AND (contains(regexp_replace(lower(text), '\s+', '', 'g'), lower(doi)) OR len(wanted) < 3 OR len(list_filter(wanted, lambda w: list_contains(regexp_extract_all(body, '[a-z0-9]{{4,}}'), w))) >= 0.5 * len(wanted)), false) AS ok FROM t""")
def text_is_the_papers(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("doc_id", T.matches_paper(F.col("text"), F.col("doi"), F.col("title")).alias("ok"))


_REFS = "x"
for _ref, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "''"), ("&amp;", "&")):
    _REFS = f"replace({_REFS}, '{_ref}', '{_char}')"


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM a), c AS (SELECT page_id, {_REFS} AS x FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS page_text FROM c""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.page_text(F.col("html")).alias("page_text"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)
SELECT page_id, url, min(i)::INTEGER AS first_at, count(*)::BIGINT AS times FROM l GROUP BY page_id, url""")
def link_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page, each once, where it stands first."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = read(spark, d, "pages").select("page_id", F.posexplode(links).alias("i", "url"))
    return rows.groupBy("page_id", "url").agg((F.min("i") + 1).alias("first_at"), F.count("*").alias("times"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.)?', ''), '[?#].*$', ''), '(/|\.html)$', '') AS clean_url FROM pages")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.|m\.)?", ""), r"[?#].*$", "")
    return read(spark, d, "pages").select("page_id", F.regexp_replace(u, r"(/|\.html)$", "").alias("clean_url"))


#: DOIs don't occur in the tables: parts come as rows, wrapped in ways that both sides must undo.
_WRAPS = ["https://doi.org/10.%s/AB.{k}", "doi:10.%s/x(1)y).{k}", "see 10.%s/a%%2F{k}b,", "<10.%s/q{k}?ref=1>", "10.%s/zz{k}/full", "10.%s/s{k}+2#top", "<a>10.%s/abc&amp;x{k}</a>", "no doi %s {k}", "10.%s/w[{k}]]", "URN:DOI:10.%s/v{k}/epdf/pdf"]


def _wrapped(kind: Column, prefix: Column, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, w in enumerate(_WRAPS):
        a, b = w.replace("%%", chr(1)).split("%s")
        b, c = b.split("{k}")
        out = F.when(kind == i, F.concat(F.lit(a.replace(chr(1), "%")), prefix, F.lit(b.replace(chr(1), "%")), key, F.lit(c.replace(chr(1), "%")))).otherwise(out)
    return out


def _wrapped_sql() -> str:
    cases = []
    for i, w in enumerate(_WRAPS):
        a, b = w.replace("%%", chr(1)).split("%s")
        b, c = b.split("{k}")
        cases.append(f"WHEN {i} THEN '{a.replace(chr(1), '%')}' || prefix || '{b.replace(chr(1), '%')}' || p_partkey || '{c.replace(chr(1), '%')}'")
    return "CASE p_partkey % 10 " + " ".join(cases) + " END"


@query(rf"""
WITH r AS (SELECT p_partkey, {_wrapped_sql()} AS raw FROM (SELECT p_partkey, (1000 + p_partkey % 9000)::VARCHAR AS prefix FROM part)),
a AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(trim(replace(raw, '%2F', '/')), '^(?i)(urn:doi:|doi:\s*)', ''), '^(?i)https?://(dx\.)?doi\.org/', ''), '10\.[0-9]{{4,9}}/\S+') AS m FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(m, '[<>"'']+$', '')), '([?#]|&amp;|&lt;|<).*$', ''), '/(full|abstract|pdf|epdf|html)(/pdf)?$', ''), '[.,;:]+$', '') AS c FROM a),
d AS (SELECT *, CASE WHEN len(string_split(c, ')')) > len(string_split(c, '(')) AND c LIKE '%)' THEN c[1:length(c) - 1] ELSE c END AS e FROM b)
SELECT p_partkey, raw, CASE WHEN len(string_split(e, ']')) > len(string_split(e, '[')) AND e LIKE '%]' THEN e[1:length(e) - 1] ELSE e END AS clean FROM d""")
def doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", (1000 + F.col("p_partkey") % 9000).cast("string").alias("prefix"))
    raw = part.select("p_partkey", _wrapped(F.col("p_partkey") % 10, F.col("prefix"), F.col("p_partkey").cast("string")).alias("raw"))
    return raw.withColumn("clean", T.doi(F.col("raw")))


_GIVEN, _FAMILY = ["Éva", "Åke", "Zoë", "Ólafur", "anna", "J.-P."], ["Ängström", "O'Neil", "Müller-Weiß", "Çelik", "de la Cruz", "Nuñez"]


@query(rf"""
WITH n AS (SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN g || ' ' || f || chr((65 + c_custkey % 26)::INTEGER) ELSE f || chr((65 + c_custkey % 26)::INTEGER) || ', ' || g END AS name
  FROM (SELECT c_custkey, {_GIVEN!r}[(c_custkey % 6) + 1] AS g, {[f.replace("'", "''") for f in _FAMILY]!r}[((c_custkey // 6) % 6) + 1] AS f FROM customer)),
p AS (SELECT c_custkey, name, lower(strip_accents(name)) AS x FROM n)
SELECT c_custkey, name, regexp_replace(CASE WHEN contains(x, ',') THEN split_part(x, ',', 1) ELSE string_split(x, ' ')[-1] END, '[^a-z]', '', 'g') || '|' || left(regexp_replace(CASE WHEN contains(x, ',') THEN split_part(x, ',', 2) ELSE regexp_replace(x, '\S*$', '') END, '[^a-z]', '', 'g'), 1) AS name_key FROM p""".replace('"O', "'O").replace('l"', "l'"))
def name_key(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    pick = lambda names, k: F.element_at(F.lit(names), (k % 6 + 1).cast("int"))
    g, f, letter = pick(_GIVEN, i), pick(_FAMILY, F.floor(i / 6)), F.char(65 + i % 26)
    name = F.when(i % 2 == 0, F.concat(g, F.lit(" "), f, letter)).otherwise(F.concat(f, letter, F.lit(", "), g))
    return read(spark, d, "customer").select("c_custkey", name.alias("name")).withColumn("name_key", T.name_key(F.col("name")))


# ---- screening ---------------------------------------------------------------------------------------------------


def screened(spark: SparkSession, d: str) -> DataFrame:
    """All papers, screened by the synthetic rules."""
    return screening.screen(papers(spark, d), RULES)


@query(SCREENED + "SELECT doc_id, category, has_text FROM ranked")
def category_cascade(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("doc_id", "category", "has_text")


@query(SCREENED + "SELECT r.category, count(*)::BIGINT AS papers, (count(*) FILTER (has_text))::BIGINT AS with_text, (count(*) FILTER (l.quality = 1))::BIGINT AS on_list FROM ranked r LEFT JOIN labels l USING (doc_id) GROUP BY r.category")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    listed = read(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("doi"))
    rows = screened(spark, d).select(F.col("doc_id").alias("doi"), "category", "has_text")
    return reports.category_counts(rows, listed).select("category", "papers", "with_text", "on_list")


@query(SCREENED + "SELECT doc_id, score, reasons FROM ranked")
def score_reasons(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("doc_id", "score", F.array_join("score_reasons", "; ").alias("reasons"))


@query(SCREENED + "SELECT doc_id, priority FROM ranked")
def priority(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("doc_id", "priority")


@query(SCREENED + "SELECT doc_id, (score + private_points)::INTEGER AS private_score, private_priority FROM ranked WHERE private_points > 0 AND has_text")
def private_view(spark: SparkSession, d: str) -> DataFrame:
    """What bookings add: a second score that never touches the public one."""
    return screening.private_rows(papers(spark, d), RULES).select("doc_id", F.col("private.score").alias("private_score"), F.col("private.priority").alias("private_priority"))


def _first_sql(name: str, n: int) -> str:
    return f"array_to_string(list_transform({name}[1:{n}], lambda s: {redact_sql('s')}), ' | ')"


@query(SCREENED + f"SELECT doc_id, {_first_sql('acks', 3)} AS acknowledgement, {_first_sql('affiliations', 2)} AS affiliation_only, {_first_sql('credits', 3)} AS credited_elsewhere, {_first_sql('aways', 2)} AS named_elsewhere, flowing AND NOT acked AS flowing_only, here FROM ranked")
def sentence_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the sentences of each paper are evidence of."""
    joined = lambda c: F.array_join(c, " | ")
    rows = screened(spark, d)
    return rows.select("doc_id", joined("acknowledgement").alias("acknowledgement"), joined("affiliation_only").alias("affiliation_only"), joined("credited_elsewhere").alias("credited_elsewhere"), joined("instrument_named_elsewhere").alias("named_elsewhere"), F.col("flowing_software_only").alias("flowing_only"), F.col("instrument_named_locally").alias("here"))


@query(SCREENED + "SELECT doc_id, array_to_string(strong, ', ') AS strong, array_to_string(weak, ', ') AS weak, array_to_string(special, ', ') AS special, micro::INTEGER AS micro, network, other_local, local_email FROM ranked")
def instrument_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = screened(spark, d)
    listed = [F.array_join(c, ", ").alias(n) for c, n in (("instruments_strong", "strong"), ("instruments_weak", "weak"), ("techniques_specialist", "special"))]
    return rows.select("doc_id", *listed, F.col("microscopy_terms").alias("micro"), F.col("network_named").alias("network"), F.col("other_local_imaging").alias("other_local"), "local_email")


@query(SCREENED + ", t AS (SELECT doc_id, unnest(counts) AS c FROM ranked) SELECT doc_id, c.id AS technique, c.n::INTEGER AS n FROM t")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("doc_id", F.explode_outer("techniques").alias("technique", "n")).filter("technique IS NOT NULL")


@query(SCREENED + ", t AS (SELECT doc_id, unnest(prints) AS q FROM ranked) SELECT doc_id, q.id AS instrument, array_to_string(q.value, '; ') AS parts FROM t")
def component_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return screened(spark, d).select("doc_id", F.explode_outer("fingerprints").alias("instrument", "v")).filter("instrument IS NOT NULL").select("doc_id", "instrument", F.array_join("v", "; ").alias("parts"))


@query(rf"""
WITH RECURSIVE e AS (SELECT doc_id, list_transform(list_filter({PARTS}, lambda s: {has_sql('s', '(?:' + RULES.evidence + ')')}), lambda s: {redact_sql('s')}) AS found FROM documents),
p AS (SELECT doc_id, s, min(i) AS i FROM (SELECT doc_id, unnest(found) AS s, generate_subscripts(found, 1) AS i FROM e) GROUP BY doc_id, s),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT d.doc_id, coalesce(string_agg(s, ' | ' ORDER BY k), '') AS evidence FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id AND k <= 14 AND before < 3500 GROUP BY d.doc_id""")
def evidence_capped(spark: SparkSession, d: str) -> DataFrame:
    found = screening.sentences_with(T.sentences(T.normalise(F.col("text"))), RULES.evidence)
    return read(spark, d, "documents").select("doc_id", F.array_join(T.evidence(found), " | ").alias("evidence"))


@query(SCREENED + f", dims AS (SELECT unnest({[dict(technique=t.id, vocab=t.vocab, strength=t.strength) for t in RULES.techniques]!r}) AS t), hits AS (SELECT doc_id, category, unnest(counts).id AS technique FROM ranked WHERE has_text)"
       " SELECT t.technique, t.vocab, t.strength, count(h.doc_id)::BIGINT AS papers, (count(*) FILTER (h.category = 'A'))::BIGINT AS acknowledging_facility, (count(*) FILTER (l.quality = 1))::BIGINT AS confirmed, (count(*) FILTER (h.category IN ('A', 'B', 'C', 'D', 'E')))::BIGINT AS leads"
       " FROM dims LEFT JOIN hits h ON h.technique = t.technique LEFT JOIN labels l ON l.doc_id = h.doc_id GROUP BY ALL")  # fmt: skip
def technique_table(spark: SparkSession, d: str) -> DataFrame:
    listed = read(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("doi"))
    return reports.technique_counts(screened(spark, d).select(F.col("doc_id").alias("doi"), "has_text", "category", "techniques"), listed, RULES)


def _chunks_sql(parts: str) -> str:
    return f"""list_reduce(list_prepend(chr(2), {parts}), lambda a, s: CASE WHEN length(string_split(a, chr(2))[-1]) + CASE WHEN string_split(a, chr(2))[-1] = '' THEN 0 ELSE 1 END + length(s) >= 500
   THEN a || CASE WHEN string_split(a, chr(2))[-1] = '' THEN '' ELSE ' ' END || s || chr(2) ELSE a || CASE WHEN string_split(a, chr(2))[-1] = '' THEN '' ELSE ' ' END || s END)"""


@query(rf"""
WITH p AS (SELECT doc_id, {PARTS} AS parts FROM documents), f AS (SELECT doc_id, list_filter(string_split({_chunks_sql('parts')}, chr(2)), lambda x: x <> '') AS c FROM p)
SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1)::INTEGER AS pos FROM f""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_pack(T.sentences(T.normalise(F.col("text"))))).alias("p", "chunk"))
    return rows.select("doc_id", "chunk", (F.col("p") + 1).alias("pos"))


@query(rf"""
WITH p AS (SELECT doc_id, list_filter({PARTS}, lambda s: NOT {has_sql('s', RULES.facility_terms)}) AS parts FROM documents), f AS (SELECT doc_id, list_filter(string_split({_chunks_sql('parts')}, chr(2)), lambda x: x <> '') AS c FROM p WHERE len(parts) > 0),
u AS (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS i FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(chunk, '{RULES.imaging}', 0, 'i')) DESC, i) AS k FROM u)
SELECT doc_id, chunk[1:600] AS chunk, k::INTEGER AS pos FROM r WHERE k <= 6""")
def chunk_top6(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each paper that say most about imaging, without sentences that name the facility."""
    best = T.imaging_chunks(F.col("text"), java_pattern(RULES.facility_terms), java_pattern(RULES.imaging))
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(best).alias("p", "chunk"))
    return rows.select("doc_id", "chunk", (F.col("p") + 1).alias("pos"))


@query(f"""
WITH {PAPERS_SQL}, own AS (SELECT doi, year, unnest(local_authors) AS author FROM papers), past AS (SELECT year, unnest(local_authors) AS author FROM papers WHERE doc_id % 4 = 0)
SELECT p.doi, p.doi IN (SELECT o.doi FROM own o JOIN past h ON o.author = h.author AND o.year <> h.year) AS repeat_user FROM papers p""")
def repeat_user_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with an author of an acknowledging paper of another year; every fourth paper acknowledges."""
    own = papers(spark, d).select("doc_id", "doi", "year", "local_authors")
    return screening.with_history(own, own.filter("doc_id % 4 = 0")).select("doi", "repeat_user")


@query(f"""
WITH {PAPERS_SQL}, own AS (SELECT doi, year, unnest(local_authors) AS author FROM papers), keyed AS (SELECT doi, year, lower(split_part(author, ',', 1)) || '|' || lower(split_part(author, ', ', 2)[1]) AS key FROM own),
b AS (SELECT DISTINCT lower(chr((65 + c_custkey % 20)::INTEGER)) || 'essoa|' || chr((97 + c_custkey % 5)::INTEGER) AS key, (2010 + c_custkey % 9)::INTEGER AS year, 'scope-' || chr((97 + c_custkey % 3)::INTEGER) AS instrument FROM customer)
SELECT doi, count(*)::BIGINT AS n, string_agg(DISTINCT b.instrument, ', ' ORDER BY b.instrument) AS instruments FROM (SELECT DISTINCT k.doi, b.year, b.instrument FROM keyed k JOIN b ON k.key = b.key AND k.year - b.year BETWEEN -1 AND 3) b GROUP BY doi""")
def booking_matches(spark: SparkSession, d: str) -> DataFrame:
    """Bookings of each paper's authors in the years that count."""
    i = F.col("c_custkey")
    bookings = read(spark, d, "customer").select(F.concat(F.lower(F.char(65 + i % 20)), F.lit("essoa|"), F.char(97 + i % 5)).alias("key"), (2010 + i % 9).cast("int").alias("year"), F.concat(F.lit("scope-"), F.char(97 + i % 3)).alias("instrument"))
    rows = screening.with_bookings(papers(spark, d).select("doi", "year", "local_authors"), bookings).filter("bookings IS NOT NULL")
    return rows.select("doi", F.size("bookings").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform("bookings", lambda b: b.instrument))), ", ").alias("instruments"))


# ---- merges and joins --------------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT s_nationkey AS nation, 0 AS o, 'supplier' AS source, min(s_name) AS name, '' AS segment FROM supplier GROUP BY 1
  UNION ALL SELECT c_nationkey, 1, 'customer', min(c_name), min(c_mktsegment) FROM customer GROUP BY 1)
SELECT nation, arg_min(name, o) FILTER (name <> '') AS name, arg_min(segment, o) FILTER (segment <> '') AS segment, string_agg(source, '; ' ORDER BY o) AS sources FROM u GROUP BY nation""")
def candidate_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_name").alias("name")).withColumns({"segment": F.lit(""), "source": F.lit("supplier")})
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_name").alias("name"), F.min("c_mktsegment").alias("segment")).withColumn("source", F.lit("customer"))
    return relational.upsert([s, c], "nation", ["name", "segment"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error') DESC, ts DESC, event_id DESC) = 1")
def latest_text_wins(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(read(spark, d, "events"), "user_id", F.desc(F.col("event_type") != "error"), F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_plain(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("event_id", F.struct("ts", "event_id"))
    return read(spark, d, "events").groupBy("user_id").agg(best.alias("event_id"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def universe_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def todo_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT o_orderkey, count(*)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE year(o_orderdate) - year(l_shipdate) BETWEEN -1 AND 3 GROUP BY o_orderkey""")
def booking_range_join(spark: SparkSession, d: str) -> DataFrame:
    left = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    right = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("booked"))
    return relational.within(left, right, "o_orderkey", "year", "booked", 1, 3).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT a.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'P' AND year(a.o_orderdate) <> year(b.o_orderdate)")
def repeat_user(spark: SparkSession, d: str) -> DataFrame:
    """A customer's years with such orders are few: they are gathered per customer before the join, so no pair of orders is made."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    years = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return o.join(years, "o_custkey").filter("lo <> y OR hi <> y").select("o_orderkey")


@query("""SELECT d.doc_id, CASE WHEN length(d.text) >= 1500 THEN 'text' WHEN p.page_id IS NOT NULL THEN 'page' WHEN b.item_id IS NOT NULL THEN 'item' ELSE 'none' END AS text_source
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def priority_coalesce(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", (F.length("text") >= 1500).alias("good"))
    p = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("page"))
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("item"))
    out = docs.join(p, "doc_id", "left").join(b, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("good"), "text").when(F.col("page"), "page").when(F.col("item"), "item").otherwise("none").alias("text_source"))


# ---- streaming extension -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_daily_window(spark: SparkSession, d: str) -> DataFrame:
    return stream.daily_counts(read(spark, d, "events"))


@query("SELECT event_id, arg_min(event_type, ts) AS event_type, min(ts) AS ts FROM events GROUP BY event_id")
def events_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of the rows of each event."""
    first = F.min_by(F.struct("event_type", "ts"), "ts").alias("e")
    return read(spark, d, "events").groupBy("event_id").agg(first).select("event_id", "e.event_type", "e.ts")
