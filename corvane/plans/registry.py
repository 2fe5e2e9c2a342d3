"""Queries by name and the SQL they are checked against; what several of them read."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.storage import shared_folder, stored  # noqa: F401  the queries take them from here
from corvane.rules import NEVER, load_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES_FILE = Path(__file__).resolve().parent.parent / "profiles" / "synthetic.json"
RULES = load_rules(RULES_FILE)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table. Long texts in fewer pieces than there are cores are dealt over these first; a piece is a file or row group at least, so only small tables are."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files are fewer and so small that no partition is full."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores or len(df.inputFiles()) >= cores else df.repartition(cores)


# ---- documents as papers: what the tables lack follows from the id by rules that SQL can state too ------------------

DOI_SQL = "CASE doc_id % 10 WHEN 0 THEN '10.5281/z' WHEN 1 THEN '10.1101/p' ELSE '10.1234/d' END || doc_id"
_A = "((doc_id * 7 + k * 11) % 40)"
AUTHORS_SQL = f"list_transform(range(0, doc_id % 5), lambda k: chr((65 + {_A} % 20)::INTEGER) || 'esso' || chr((97 + {_A} // 20)::INTEGER) || ', ' || chr((65 + {_A} % 5)::INTEGER) || 'ina')"
PAPERS_SQL = f"""papers AS (SELECT doc_id, {DOI_SQL} AS doi, text, text[1:60] AS title, source, CASE WHEN doc_id % 13 = 0 THEN 'A2 review' ELSE 'A1 article' END AS type, (2015 + doc_id % 6)::INTEGER AS year,
  CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['1182', '222'] WHEN 2 THEN ['222'] ELSE ['513'] END AS fields, [source] AS units, {AUTHORS_SQL} AS local_authors,
  CASE doc_id % 3 WHEN 0 THEN ['repo'] WHEN 1 THEN ['portal'] ELSE ['repo', 'europepmc_ack'] END AS sources, doc_id % 9 = 0 AS repeat_user, doc_id % 7 = 0 AS booked FROM documents)"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as papers: DOI, title, type, year, fields, units, authors, sources."""
    i = F.col("doc_id")
    prefix = F.when(i % 10 == 0, "10.5281/z").when(i % 10 == 1, "10.1101/p").otherwise("10.1234/d")
    fields = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.lit(["1182", "222"])).when(i % 4 == 2, F.lit(["222"])).otherwise(F.lit(["513"]))
    n = lambda k: F.pmod(i * 7 + k * 11, F.lit(40))
    letter = lambda base, x: F.char(F.lit(base) + x)
    author = lambda k: F.concat(letter(65, n(k) % 20), F.lit("esso"), letter(97, F.floor(n(k) / 20)), F.lit(", "), letter(65, n(k) % 5), F.lit("ina"))
    authors = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (i % 5) - 1), author))
    sources = F.when(i % 3 == 0, F.lit(["repo"])).when(i % 3 == 1, F.lit(["portal"])).otherwise(F.lit(["repo", "europepmc_ack"]))
    return read(spark, d, "documents").select(
        "doc_id", F.concat(prefix, i.cast("string")).alias("doi"), "text", F.substring("text", 1, 60).alias("title"), "source", F.when(i % 13 == 0, "A2 review").otherwise("A1 article").alias("type"),
        (2015 + i % 6).cast("int").alias("year"), fields.alias("fields"), F.array("source").alias("units"), authors.alias("local_authors"), sources.alias("sources"), (i % 9 == 0).alias("repeat_user"),
        F.when(i % 7 == 0, F.array(F.struct((2014 + i % 6).cast("int").alias("year"), F.lit("scope").alias("instrument")))).otherwise(F.array().cast("array<struct<year:int,instrument:string>>")).alias("bookings"),
    )


# ---- SQL fragments -----------------------------------------------------------------------------------------------

_WHITE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '([\p{{L}}\p{{N}}_])[-\x{{00AD}}]{_WHITE}+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '{_WHITE}+', ' ', 'g'))"


def parts_sql(clean: str) -> str:
    return rf"string_split(regexp_replace({clean}, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


NORM = norm_sql("text")
PARTS = parts_sql(NORM)
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+"


def redact_sql(x: str) -> str:
    return f"regexp_replace(trim({x}), '{MAIL}', '[email]', 'g')[1:600]"


def has_sql(x: str, pattern: str) -> str:
    return "false" if pattern == NEVER else f"regexp_matches({x}, '{pattern}', 'i')"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}', 0, 'i'))"


def cue_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{c}')" for c in RULES.cues) + ")"


def _prints_sql() -> str:
    """(doc_id, id, value): components near mentions, one relation an instrument."""
    out = []
    for i in RULES.instruments:
        if i.components:
            found = ", ".join(f"arg_min(nullif(regexp_extract(w, '{c}', 0, 'i'), ''), k) FILTER (regexp_extract(w, '{c}', 0, 'i') <> '')" for c in i.components)
            keep = f"WHERE NOT {has_sql('w', i.exclude)}" if i.exclude else ""
            out.append(f"""SELECT doc_id, '{i.id}' AS id, list_sort(list_filter([{found}], lambda x: x IS NOT NULL)) AS value FROM (
  SELECT doc_id, k, clean[greatest(s - {RULES.window}, 0) + 1:least(s + m + {RULES.window}, length(clean))] AS w FROM (
    SELECT doc_id, clean, k, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s, length(f[k]) AS m FROM (
      SELECT doc_id, clean, g, f, unnest(range(1, len(f) + 1)) AS k FROM (SELECT doc_id, clean, string_split_regex(clean, '(?i){i.pattern}') AS g, regexp_extract_all(clean, '{i.pattern}', 0, 'i') AS f FROM base)))) {keep} GROUP BY doc_id""")
    return " UNION ALL ".join(out)


def _screened_sql() -> str:
    r, w = RULES, RULES.weights
    own = {i.id: f"({has_sql('s', i.pattern)}" + (f" AND NOT {has_sql('s', i.exclude)})" if i.exclude else ")") for i in r.instruments}
    strong = " OR ".join(own[i.id] for i in r.instruments if i.strength == "strong") or "false"
    base_strong = ", ".join(f"'{i.id}'" for i in r.instruments if i.strength == "strong")
    special = ", ".join(f"'{t.id}'" for t in r.techniques if t.strength == "specialist")
    counted = ", ".join(f"{{'id': '{t.id}', 'n': {count_sql('clean', t.pattern)}}}" for t in r.techniques)
    term = lambda test, key, why=None: f"{{'p': CASE WHEN {test} THEN {w[key]} ELSE 0 END, 'w': {why or repr(key.replace('_', ' '))}}}"
    starts = lambda prefixes: "(" + (" OR ".join(f"starts_with(doi, '{p}')" for p in prefixes) or "false") + ")"
    alone = f"len(local_authors) = 1 AND NOT list_has_any(sources, {list(r.incomplete_authors)!r})"
    field = " OR ".join(f"starts_with(f, '{p}')" for p in r.fields)
    terms = ", ".join([
        term("acked", "acknowledgement"), term("len(strong) > 0", "strong_instrument", "'instrument: ' || array_to_string(strong, ', ')"), f"{{'p': least(best * {w['component']}, {w['component_max']}), 'w': best || ' instrument component(s)'}}",
        f"{{'p': least(len(special) * {w['specialist_technique']}, {w['specialist_technique_max']}), 'w': 'technique: ' || array_to_string(special, ', ')}}", term("local_email", "local_email", f"'{'/'.join(r.domains)} e-mail'"),
        term("here", r.near_place), term("len(local_authors) >= 3", "many_local_authors", f"len(local_authors) || ' {r.authors_name} authors'"), term(f"len(list_filter(units, lambda u: {has_sql('u', r.units)})) > 0", "life_science_unit"),
        term("repeat_user", "repeat_user", "'repeat facility user group'"), term("NOT acked AND len(credits) > 0", "credited_elsewhere"), term("NOT acked AND len(aways) > 0", "instrument_named_elsewhere"), term(f"NOT acked AND {alone}", "single_local_author"),
        term(f"NOT acked AND len(fields) > 0 AND len(list_filter(fields, lambda f: {field})) = 0", "non_life_science_field"), term(f"NOT acked AND (starts_with(type, 'A2') OR {has_sql(chr(99) + 'oalesce(title, ' + repr('') + ')', r.review_title)})", "review"),
        term(starts(r.preprints), "preprint"), term(starts(r.datasets), "not_a_paper", "'dataset, not a paper'"),
    ])
    booked = f"booked AND (len(strong) + len(weak) > 0 OR len(special) > 0) AND micro >= {r.enough} AND (acked OR NOT (len(credits) > 0 OR len(aways) > 0 OR {alone}))"
    private = f"CASE WHEN {booked} THEN {w['group_booked']} ELSE 0 END + CASE WHEN {booked} AND len(list_filter(list_concat(strong, weak), lambda i: contains(lower(i), 'scope'))) > 0 THEN {w['booked_instrument_used']} ELSE 0 END"
    rank = lambda x: f"CASE WHEN NOT has_text THEN CASE WHEN list_contains(sources, 'europepmc_ack') THEN 'check' END WHEN {starts(r.datasets)} THEN 'low' WHEN {x} >= {w['report']} AND acked THEN 'report' WHEN {x} >= {w['check']} THEN 'check' ELSE 'low' END"
    return f"""
WITH {PAPERS_SQL},
base0 AS MATERIALIZED (SELECT *, {norm_sql("coalesce(text, '')")} AS clean FROM papers), base AS MATERIALIZED (SELECT *, {parts_sql('clean')} AS parts FROM base0),
sent AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM base),
told AS (SELECT doc_id, i, s, {has_sql('s', r.acknowledgement)} AS a, {has_sql('s', r.flowing)} AS f, ({has_sql('s', r.affiliation)} OR {has_sql('s', r.postal)}) AND NOT {cue_sql('s')} AS af,
  NOT {has_sql('s', r.not_light)} AND ({has_sql('s', r.other_facilities)} OR ({has_sql('s', r.generic_facility)} AND {cue_sql('s')})) AS e, ({strong}) AS st, {has_sql('s', r.places)} AS place, length(s) < 400 AND {has_sql('s', r.other_institution)} AS other,
  list_filter([{', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in own.items())}], lambda x: x IS NOT NULL) AS inst FROM sent),
seen AS (SELECT doc_id, coalesce(list(s ORDER BY i) FILTER (a AND NOT f AND NOT af), []) AS acks, coalesce(list(s ORDER BY i) FILTER (a AND NOT f AND af), []) AS affiliations, bool_or(a AND f) AS flowing, coalesce(list(s ORDER BY i) FILTER (e AND NOT a), []) AS credits,
  coalesce(list(s ORDER BY i) FILTER (st AND NOT place AND other), []) AS aways, bool_or(st AND place) AS here, list_distinct(flatten(list(inst))) AS found FROM told GROUP BY doc_id),
prints AS MATERIALIZED ({_prints_sql()}),
fp AS (SELECT doc_id, list({{'id': id, 'value': value}} ORDER BY id) AS prints FROM prints WHERE len(value) > 0 GROUP BY doc_id),
facts AS (SELECT b.*, clean <> '' AS has_text, n.* EXCLUDE (doc_id), coalesce(fp.prints, []) AS prints, {count_sql('clean', r.microscopy)} AS micro, list_filter([{counted}], lambda t: t.n > 0) AS counts, {has_sql('clean', r.network)} AS network,
  {has_sql('clean', r.other_local)} AS other_local, {has_sql('clean', '[a-zA-Z0-9_.-]+@(' + '|'.join(x.replace('.', '[.]') for x in r.domains) + ')' + chr(92) + 'b')} AS local_email FROM base b JOIN seen n USING (doc_id) LEFT JOIN fp USING (doc_id)),
kinds AS (SELECT *, len(acks) > 0 AS acked, list_sort(list_filter(found, lambda x: list_contains([{base_strong}], x) OR list_contains(list_transform(list_filter(prints, lambda q: len(q.value) >= 2), lambda q: q.id), x))) AS strong,
  list_sort(list_filter(list_transform(counts, lambda t: t.id), lambda x: list_contains([{special}], x))) AS special, coalesce(list_max(list_transform(list_filter(prints, lambda q: list_contains(found, q.id)), lambda q: len(q.value))), 0) AS best FROM facts),
split_ AS (SELECT *, list_sort(list_filter(found, lambda x: NOT list_contains(strong, x))) AS weak FROM kinds),
points AS (SELECT *, list_filter([{terms}], lambda t: t.p <> 0) AS terms, {private} AS private_points,
  CASE WHEN NOT has_text THEN 'N' WHEN acked THEN 'A' WHEN len(strong) > 0 THEN 'B' WHEN len(special) > 0 AND list_has_any(sources, {list(r.local_sources)!r}) AND micro >= {r.enough} THEN 'C' WHEN len(affiliations) > 0 THEN 'D'
    WHEN micro >= {r.enough} AND network THEN 'E' WHEN micro >= {r.enough} THEN 'F' ELSE 'G' END AS category FROM split_),
summed AS (SELECT *, CASE WHEN has_text THEN coalesce(list_sum(list_transform(terms, lambda t: t.p)), 0)::INTEGER WHEN list_contains(sources, 'europepmc_ack') THEN {w['check']} END AS score FROM points),
ranked AS (SELECT *, {rank('score')} AS priority, {rank('(score + private_points)')} AS private_priority,
  CASE WHEN NOT has_text THEN CASE WHEN list_contains(sources, 'europepmc_ack') THEN 'Europe PMC acknowledgement match; full text unavailable' ELSE '' END
    ELSE array_to_string(list_concat(list_transform(terms, lambda t: CASE WHEN t.p > 0 THEN '+' ELSE '' END || t.p || ' ' || t.w), CASE WHEN acked AND micro = 0 AND {has_sql('clean', r.cytometry)} THEN ['cytometry only (no microscopy in the text)'] ELSE [] END), '; ') END AS reasons FROM summed)
"""


SCREENED = _screened_sql()
