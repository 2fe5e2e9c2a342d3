"""Rule screening of papers: sentence evidence, fingerprints, category, additive score with reasons, priority.

``screen`` needs the columns ``doi`` and ``text``; what else is known of a paper (``META``) is used where the column is
there and counts as unknown where it isn't. Plain strings that a rule's matches need are looked for first, in the text and
in each sentence, and only where one stands is the pattern tried; sentences that no rule cares for are left out by one
pattern before the others look at them. Everything is a column expression; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.rules import LEADS, NEVER, Rules, any_of, java_pattern, literals

#: Columns that may be known of a paper, and their types. ``bookings``: those of its authors; ``author_keys``: name keys.
META = {
    "title": "string", "type": "string", "year": "int", "fields": "array<string>", "units": "array<string>", "local_authors": "array<string>", "sources": "array<string>",
    "repeat_user": "boolean", "local": "boolean", "bookings": "array<struct<year:int,instrument:string>>",
}
_WORDS = "array<string>"
#: A paper's year less a booking's, from and to, for the booking to count.
BOOKED = (-1, 3)


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern stands in the text, in any case; never for a pattern that matches nothing."""
    return F.lit(False) if pattern == NEVER else text.rlike(java_pattern(pattern))


def folded(text: Column) -> Column:
    """Lower case, with the letters beyond ASCII that patterns take for ASCII ones as these: what ``may`` looks at."""
    for other, letter in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
        text = F.replace(text, F.lit(other), F.lit(letter))
    return F.lower(text)


def may(low: Column, pattern: str) -> Column:
    """Whether a pattern can match a ``folded`` text at all: a plain search for strings that its matches need spares most texts the pattern."""
    if pattern == NEVER:
        return F.lit(False)
    needed = literals(pattern)
    return F.lit(True) if needed is None else reduce(or_, (F.contains(low, F.lit(x)) for x in needed))


def sentences_with(parts: Column, pattern: str) -> Column:
    """The sentences that a pattern matches in; each is folded once."""
    return F.filter(parts, lambda s: T.let(folded(s), lambda low: may(low, pattern)) & has(s, pattern))


def cue(s: Column, r: Rules) -> Column:
    """Whether a sentence thanks or credits: it holds a cue, also as part of a word."""
    return F.lower(s).rlike("|".join(f"\\Q{c}\\E" for c in r.cues))


def named(s: Column, pattern: str, exclude: str | None) -> Column:
    """Whether an instrument is named, and not in a context that rules it out."""
    return has(s, pattern) & ~has(s, exclude) if exclude else has(s, pattern)


def staff_pattern(names: tuple[str, ...] | list[str]) -> str:
    """Names as they stand in thanks: an initial or given name, then the surname. ``names``: "Surname, Given"."""
    out = []
    for n in names:
        last, _, first = (x.strip() for x in n.partition(","))
        if last:
            out.append(rf"\b{T.quoted(first[:1])}\w*\.?\s+{T.quoted(last)}\b" if first else rf"\b{T.quoted(last)}\b")
    return any_of(out)


def classified(s: Column, r: Rules, staff: str) -> Column:
    """What one sentence is evidence of."""
    ack, thanks = has(s, r.acknowledgement), cue(s, r)
    flowing, affiliated = has(s, r.flowing), (has(s, r.affiliation) | has(s, r.postal)) & ~thanks
    own = [named(s, i.pattern, i.exclude) for i in r.instruments]
    strong = F.lit(False)
    for i, hit in zip(r.instruments, own, strict=True):
        strong = strong | hit if i.strength == "strong" else strong
    elsewhere = ~ack & ~has(s, r.not_light) & (has(s, r.other_facilities) | (has(s, r.generic_facility) & thanks))
    place = has(s, r.places)
    return F.struct(
        s.alias("s"),
        F.when(ack & flowing, "flowing").when(ack & affiliated, "affiliation").when(ack, "acknowledgement").alias("credit"),
        elsewhere.alias("elsewhere"),
        (strong & place).alias("here"),
        (strong & ~place & (F.length(s) < 400) & has(s, r.other_institution)).alias("away"),
        F.filter(F.array(*(F.when(hit, F.lit(i.id)) for i, hit in zip(r.instruments, own, strict=True))), lambda x: x.isNotNull()).alias("instruments"),
        (thanks & (s.rlike(staff) if staff != NEVER else F.lit(False))).alias("staff"),
    )


def fingerprint_of(text: Column, pattern: str, exclude: str | None, components: tuple[str, ...], reach: int) -> Column:
    """What was found of each component near a mention, sorted: one find a component, the first in text order."""
    near = windows_around(text, java_pattern(pattern), reach)
    if exclude:
        near = F.filter(near, lambda w: ~has(w, exclude))

    def found(windows: Column) -> Column:
        first = lambda p: F.get(F.filter(F.transform(windows, lambda w: F.regexp_extract(w, java_pattern(p), 0)), lambda x: x != ""), F.lit(0))
        return F.array_sort(F.array_compact(F.array(*(first(p) for p in components))))

    return T.let(near, found)


def windows_around(text: Column, pattern: str, reach: int) -> Column:
    """The text within ``reach`` characters of each match of ``pattern``."""
    return F.transform(T.spans(text, pattern), lambda x: T.between(text, x.s - reach, x.e + reach))


def with_meta(papers: DataFrame) -> DataFrame:
    """``papers`` with all of META; what isn't known is null."""
    missing = {c: F.lit(None).cast(kind) for c, kind in META.items() if c not in papers.columns}
    return papers.withColumns(missing) if missing else papers


def screen(papers: DataFrame, r: Rules, private_staff: tuple[str, ...] = ()) -> DataFrame:
    """``papers`` with everything their texts are evidence of, category, score, priority and reasons.

    Papers without text are category N; those that a search for acknowledgements found are to be checked all the same.
    ``private_staff`` (name keys "surname|initial") and bookings change ``private`` only, never the public score.
    """
    staff = staff_pattern(r.staff)
    hidden = any_of([rf"(?i:\b{T.quoted(k.split('|')[1])}\w*\.?\s+{T.quoted(k.split('|')[0])}\b)" for k in private_staff if all(k.split("|"))])
    wanted = any_of([p for p in (r.acknowledgement, r.other_facilities, r.generic_facility, *(i.pattern for i in r.instruments)) if p != NEVER])
    clean = T.normalise(F.coalesce("text", F.lit("")))
    rows = with_meta(papers).withColumn("clean", clean).withColumns({"low": folded(F.col("clean")), "parts": T.sentences(F.col("clean"))})
    none = lambda kind: F.array().cast(f"array<{kind}>")
    if staff != NEVER or hidden != NEVER:  # a name is case-sensitive in thanks, so its sentences are found by the cues
        told = F.filter("parts", lambda s: has(s, wanted) | cue(s, r))
    else:
        told = F.when(may(F.col("low"), wanted), sentences_with(F.col("parts"), wanted)).otherwise(none("string"))
    rows = rows.withColumn("told", F.transform(told, lambda s: classified(s, r, staff)))
    having = lambda test: F.transform(F.filter("told", test), lambda x: x.s)
    seen = lambda p: may(F.col("low"), p)
    number = lambda p: F.when(seen(p), F.regexp_count("clean", F.lit(java_pattern(p)))).otherwise(0)
    prints = [F.struct(F.lit(i.id).alias("key"), F.when(seen(i.pattern), fingerprint_of(F.col("clean"), i.pattern, i.exclude, i.components, r.window)).otherwise(none("string")).alias("value")) for i in r.instruments if i.components]
    counts = [F.struct(F.lit(t.id).alias("key"), number(t.pattern).alias("value")) for t in r.techniques]
    pairs = lambda xs, kind: F.filter(F.array(*xs), lambda x: F.size(x.value) > 0 if kind == _WORDS else x.value > 0) if xs else F.array().cast(f"array<struct<key:string,value:{kind}>>")
    rows = rows.withColumns({
        "has_text": F.col("clean") != "",
        "acks": having(lambda x: x.credit.eqNullSafe("acknowledgement")),
        "affiliations": having(lambda x: x.credit.eqNullSafe("affiliation")),
        "flowing": F.exists("told", lambda x: x.credit.eqNullSafe("flowing")),
        "credits": having(lambda x: x.elsewhere),
        "aways": having(lambda x: x.away),
        "instrument_named_locally": F.exists("told", lambda x: x.here),
        "staff_thanked": F.exists("told", lambda x: x.staff),
        "private_thanked": F.exists("parts", lambda s: cue(s, r) & s.rlike(hidden)) if hidden != NEVER else F.lit(False),
        "found": F.array_distinct(F.flatten(F.transform("told", lambda x: x.instruments))),
        "prints": pairs(prints, _WORDS),
        "counts": pairs(counts, "int"),
        "microscopy_terms": number(r.microscopy),
        "network_named": seen(r.network) & has(F.col("clean"), r.network),
        "other_local_imaging": seen(r.other_local) & has(F.col("clean"), r.other_local),
        "local_email": F.contains("clean", F.lit("@")) & has(F.col("clean"), r.email),
    })
    strong = F.lit([i.id for i in r.instruments if i.strength == "strong"] or [""])
    special = F.lit([t.id for t in r.techniques if t.strength == "specialist"] or [""])
    # a common model counts as distinctive once two of its own components stand beside it
    promoted = F.transform(F.filter("prints", lambda x: F.size(x.value) >= 2), lambda x: x.key)
    is_strong = lambda x: F.array_contains(strong, x) | F.array_contains(promoted, x)
    rows = rows.withColumns({
        "instruments_strong": F.array_sort(F.filter("found", is_strong)),
        "instruments_weak": F.array_sort(F.filter("found", lambda x: ~is_strong(x))),
        "techniques": F.map_from_entries("counts"),
        "techniques_specialist": F.array_sort(F.filter(F.transform("counts", lambda x: x.key), lambda k: F.array_contains(special, k))),
        "fingerprints": F.map_from_entries("prints"),
        "best": F.coalesce(F.array_max(F.transform(F.filter("prints", lambda x: F.array_contains("found", x.key)), lambda x: F.size(x.value))), F.lit(0)),
        "acked": F.size("acks") > 0,
        "cytometry_only": (F.size("acks") > 0) & (F.col("microscopy_terms") == 0) & has(F.col("clean"), r.cytometry),
        "flowing_software_only": F.col("flowing") & (F.size("acks") == 0),
    })
    many = F.col("microscopy_terms") >= r.enough
    local = F.coalesce("local", F.lit(True)) if not r.local_sources else F.coalesce("local", F.arrays_overlap("sources", F.lit(list(r.local_sources))), F.lit(True))
    category = (
        F.when(~F.col("has_text"), "N").when(F.col("acked"), "A").when(F.size("instruments_strong") > 0, "B").when((F.size("techniques_specialist") > 0) & local & many, "C")
        .when(F.size("affiliations") > 0, "D").when(many & F.col("network_named"), "E").when(many, "F").otherwise("G")
    )
    return scored(rows.withColumn("category", category), r, private_staff)


def reason(points: Column, why: Column) -> Column:
    """A term of the score; terms of no points are left out later."""
    return F.struct(points.cast("int").alias("points"), why.alias("why"))


def scored(rows: DataFrame, r: Rules, private_staff: tuple[str, ...]) -> DataFrame:
    """The score's terms in their order, what they add up to, and the evidence of leads."""
    w = r.weights
    term = lambda test, key, why=None: reason(F.when(F.coalesce(test, F.lit(False)), F.lit(w.get(key, 0))).otherwise(0), F.lit(key.replace("_", " ")) if why is None else why)
    authors, fields = F.coalesce("local_authors", F.array().cast(_WORDS)), F.coalesce("fields", F.array().cast(_WORDS))
    sources, doi = F.coalesce("sources", F.array().cast(_WORDS)), F.coalesce("doi", F.lit(""))
    starts = lambda c, prefixes: c.rlike("^(" + "|".join(f"\\Q{p}\\E" for p in prefixes) + ")") if prefixes else F.lit(False)
    alone = (F.size(authors) == 1) & (~F.arrays_overlap(sources, F.lit(list(r.incomplete_authors))) if r.incomplete_authors else F.lit(True))
    away, credited, acked = F.size("aways") > 0, F.size("credits") > 0, F.col("acked")
    n_special = F.size("techniques_specialist")
    dataset = starts(doi, r.datasets)
    review = F.coalesce(F.col("type").startswith("A2"), F.lit(False)) | has(F.coalesce("title", F.lit("")), r.review_title)
    terms = F.array(
        term(acked, "acknowledgement"),
        term(F.size("instruments_strong") > 0, "strong_instrument", F.concat(F.lit("instrument: "), F.array_join("instruments_strong", ", "))),
        reason(F.least(F.col("best") * w["component"], F.lit(w["component_max"])), F.concat(F.col("best").cast("string"), F.lit(" instrument component(s)"))),
        reason(F.least(n_special * w["specialist_technique"], F.lit(w["specialist_technique_max"])), F.concat(F.lit("technique: "), F.array_join("techniques_specialist", ", "))),
        term(F.col("local_email"), "local_email", F.lit("/".join(r.domains) + " e-mail")),
        term(F.col("instrument_named_locally"), r.near_place),
        term(F.size(authors) >= 3, "many_local_authors", F.concat(F.size(authors).cast("string"), F.lit(f" {r.authors_name} authors"))),
        term(F.exists("units", lambda u: has(u, r.units)), "life_science_unit"),
        term(F.col("repeat_user"), "repeat_user", F.lit("repeat facility user group")),
        term(F.col("staff_thanked"), "staff_thanked", F.lit("facility staff thanked")),
        term(~acked & credited, "credited_elsewhere"),
        term(~acked & away, "instrument_named_elsewhere"),
        term(~acked & alone, "single_local_author"),
        term(~acked & (F.size(fields) > 0) & ~F.exists(fields, lambda f: starts(f, r.fields)), "non_life_science_field"),
        term(~acked & review, "review"),
        term(starts(doi, r.preprints), "preprint"),
        term(dataset, "not_a_paper", F.lit("dataset, not a paper")),
    )
    counted = lambda ts: F.filter(ts, lambda t: t.points != 0)
    total = lambda ts: F.aggregate(ts, F.lit(0), lambda a, t: a + t.points)
    said = lambda ts: F.transform(ts, lambda t: F.concat(F.when(t.points > 0, "+").otherwise(""), t.points.cast("string"), F.lit(" "), t.why))

    def rank(points: Column) -> Column:
        return F.when(dataset, "low").when((points >= w["report"]) & acked, "report").when(points >= w["check"], "check").otherwise("low")

    keys = F.lit(sorted({*private_staff})) if private_staff else None
    is_staff = F.exists(authors, lambda a: F.array_contains(keys, T.name_key(a))) if private_staff else F.lit(False)
    if r.staff:
        is_staff = is_staff | F.exists(authors, lambda a: F.array_contains(F.array(*(T.name_key(F.lit(n)) for n in r.staff)), T.name_key(a)))
    in_time = F.filter("bookings", lambda b: (F.col("year") - b.year).between(*BOOKED))
    instruments = F.transform(F.concat("instruments_strong", "instruments_weak"), F.lower)
    same = F.exists(in_time, lambda b: (b.instrument != "") & F.exists(instruments, lambda i: F.contains(i, F.lower(b.instrument)) | F.contains(F.lower(b.instrument), i)))
    # a booking only corroborates: the paper names an instrument or a technique itself, and nothing speaks for imaging elsewhere
    booked = (F.size(in_time) > 0) & ((F.size(instruments) > 0) | (n_special > 0)) & (F.col("microscopy_terms") >= r.enough) & (acked | ~(credited | away | alone))
    private = F.array(
        term(is_staff, "staff_author", F.lit("facility staff among authors")),
        term(F.col("private_thanked") & ~F.col("staff_thanked"), "staff_thanked", F.lit("facility staff thanked")),
        term(booked, "group_booked", F.lit("group booked the facility")),
        term(booked & same, "booked_instrument_used", F.lit("booked instrument named in paper")),
    )
    rows = rows.withColumns({"terms": counted(terms), "private_terms": counted(private)})
    score = F.when(F.col("has_text"), total(F.col("terms")))
    searched = ~F.col("has_text") & F.array_contains(sources, "europepmc_ack")
    reasons = said(F.col("terms"))
    reasons = F.when(F.col("cytometry_only"), F.array_append(reasons, F.lit("cytometry only (no microscopy in the text)"))).otherwise(reasons)
    more = F.coalesce(score, F.lit(0)) + total(F.col("private_terms"))
    rows = rows.withColumns({
        "score": F.when(searched, F.lit(w["check"])).otherwise(score),
        "priority": F.when(searched, "check").when(F.col("has_text"), rank(total(F.col("terms")))),
        "score_reasons": F.when(searched, F.array(F.lit("Europe PMC acknowledgement match; full text unavailable"))).when(F.col("has_text"), reasons).otherwise(F.array().cast(_WORDS)),
        "private": F.when(F.col("has_text") & (F.size("private_terms") > 0), F.struct(more.alias("score"), rank(more).alias("priority"), said(F.col("private_terms")).alias("reasons"))),
        "evidence": F.when(F.col("category").isin(*LEADS), T.evidence(sentences_with(F.col("parts"), r.evidence))).otherwise(F.array().cast(_WORDS)),
    })
    short = lambda c, n: F.transform(F.slice(c, 1, n), lambda s: T.redact(s))
    rows = rows.withColumns({"acknowledgement": short("acks", 3), "affiliation_only": short("affiliations", 2), "credited_elsewhere": short("credits", 3), "instrument_named_elsewhere": short("aways", 2)})
    return rows.drop("clean", "parts", "told", "found", "prints", "counts", "best", "acked", "acks", "affiliations", "flowing", "credits", "aways", "private_thanked", "terms", "private_terms")


def with_private(screened: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``private`` of the rows that private inputs say something about.

    A filter on a column that is worked out is moved down to the texts, and what it is made of written out for each use;
    behind a generator it stays where it is, and the column is worked out once.
    """
    return screened.select(*columns, F.explode_outer(F.array("private")).alias("private")).filter("private IS NOT NULL")


def private_rows(papers: DataFrame, r: Rules, private_staff: tuple[str, ...] = ()) -> DataFrame:
    """(doi, private) of the rows of ``screen`` that have it, with the columns of ``papers``. Without staff only bookings in time can make a difference, so that other papers needn't be screened."""
    if not private_staff and not r.staff:
        papers = with_meta(papers)
        papers = papers.filter(F.exists("bookings", lambda b: (F.col("year") - b.year).between(*BOOKED)))
    return with_private(screen(papers, r, private_staff), *papers.columns)


def split_private(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The public rows, and (doi, score, priority, reasons) of those that private inputs say something about."""
    return screened.drop("private"), with_private(screened, "doi").select("doi", "private.*")


def with_history(papers: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """``papers`` (doi, year, local_authors) with ``repeat_user``: an author of an acknowledging paper of another year.

    Years of an author are summed up first as the least and the largest, so no pair of papers is ever made.
    """
    years = acknowledged.select(F.explode("local_authors").alias("author"), "year").groupBy("author").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    own = papers.select("doi", "year", F.explode("local_authors").alias("author"))
    users = own.join(years, "author").filter("lo <> year OR hi <> year").select("doi").distinct().withColumn("repeat_user", F.lit(True))
    return papers.join(users, "doi", "left").withColumn("repeat_user", F.coalesce("repeat_user", F.lit(False)))


def with_bookings(papers: DataFrame, bookings: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """``papers`` with the distinct bookings (key, year, instrument) of their authors that lie in the years that count."""
    own = papers.select("doi", F.col("year").alias("paper_year"), F.explode("local_authors").alias("author")).withColumn("key", T.name_key(F.col("author")))
    pairs = own.join(bookings.distinct(), "key").filter(F.col("paper_year") - F.col("year") >= -before).filter(F.col("paper_year") - F.col("year") <= after)
    booked = pairs.groupBy("doi").agg(F.collect_set(F.struct(F.col("year").cast("int").alias("year"), F.col("instrument").alias("instrument"))).alias("bookings"))
    return papers.join(booked, "doi", "left")
