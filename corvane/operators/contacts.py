"""Corresponding authors: the mail addresses of a paper that stand nearest to a marker of correspondence, and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# What addresses, markers and names look like, and which addresses aren't authors'.
EMAIL = r"(?<![\p{L}\p{N}_.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
MARKER = r"(?i:correspond|to whom|e-?mail|contact)|✉|\*\s*(?=[A-Z])"
NOT_PERSONAL = (
    r"(?i)^(permissions?|info|editor|editorial|office|support|help|noreply|no-reply|reprints?|journals?|admin|contact|enquiries|service|submissions?|press|orders|subscriptions?|datasharing|data)@|"
    r"@(\w+\.)*(elsevier|wiley|springer(nature)?|nature|plos|cell|frontiersin|mdpi|biorxiv|medrxiv|acs|rsc|tandf|sagepub|oup|bmj|biomedcentral|cshl|embo|aaas|iop|pnas|thieme|karger)\.(com|org|net)$"
)
FILE_ENDING = r"(?i)\.(png|jpe?g|gif|svg|tiff?|webp|pdf|docx?|xlsx?|zip)$"
NAME_AFTER = r"(?U)(?i:correspond\w*(?:\s+authors?)?(?:\s+to)?|to whom correspondence[^:]{0,40}|contact)\s*[:：]?\s*((?:[A-ZÅÄÖÉÜØ][\w'’-]*\.?\s+){1,3}[A-ZÅÄÖÉÜØ][\w'’-]+)"
NOT_A_NAME = r"(?iU)\b(author|authors|e-?mail|address|department|university|institute|faculty|school|hospital|centre|center|laboratory|lab|division|unit|tel|phone|fax)\b"
REACH, NEAR, FRONT, LIMIT = 250, 120, 0.15, 3

_HIT = "struct<score:int,s:int,email:string,before:string>"


def _last(pattern: str, text: Column) -> Column:
    """The first group of the last match, empty if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def name_for(email: Column, authors: Column) -> Column:
    """The author whose name is in an address: by family and given name, or by a family name that no other author has; empty if none is."""
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")

    def split(name: Column) -> Column:
        comma = F.contains(name, F.lit(","))
        family = F.when(comma, F.substring_index(name, ",", 1)).otherwise(F.regexp_extract(name, r"(\S*)$", 1))
        given = F.when(comma, F.regexp_extract(name, "(?s),(.*)$", 1)).otherwise(F.regexp_replace(name, r"\s*\S*$", ""))
        return F.struct(F.trim(family).alias("family"), F.trim(given).alias("given"), letters(T.fold(family)).alias("fam"), letters(T.fold(given)).alias("giv"))

    def judged(local: Column, x: Column) -> Column:
        at, first = F.instr(local, x.fam), F.substring(x.giv, 1, 1)
        rest = F.trim(F.concat(F.substring(local, F.lit(1), at - 1), F.lit(" "), F.substring(local, at + F.length(x.fam), F.length(local))))
        strong = (x.giv != "") & (F.contains(local, x.giv) | rest.startswith(first) | local.startswith(first))
        score = F.when((F.length(x.fam) >= 3) & F.contains(local, x.fam), F.when(strong, 3).otherwise(2)).otherwise(0)
        return F.struct(score.alias("score"), x.fam.alias("family"), F.trim(F.concat_ws(" ", x.given, x.family)).alias("name"))

    def best_of(found: Column) -> Column:
        best = F.array_max(found)
        alike = F.size(F.filter(found, lambda x: x.family == F.array_max(found).family))
        return F.when((F.size(found) == 0) | ((best.score == 2) & (alike > 1)), "").otherwise(best["name"])

    clean = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda n: split(F.trim(F.regexp_replace(n, r"(?U)\s+", " "))))
    return T.let(letters(T.fold(F.split(email, "@").getItem(0))), lambda local: T.let(F.filter(F.transform(clean, lambda x: judged(local, x)), lambda x: x.score > 0), best_of))


def _hits(clean: Column) -> Column:
    """The addresses of a text that may be authors', with how near to a marker each stands and what stands before it."""
    found = F.transform(T.matches(clean, EMAIL), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.rtrim(x.m, F.lit(".")).alias("email")))
    own = F.filter(found, lambda x: ~x.email.rlike(NOT_PERSONAL) & ~x.email.rlike(FILE_ENDING))
    start = F.struct(F.lit(-(10**9)).alias("end"), F.lit(False).alias("marked"), F.array().cast(f"array<{_HIT}>").alias("hits"))

    def step(a: Column, x: Column) -> Column:
        def told(before: Column) -> Column:
            return T.let(before.rlike(MARKER) | (a.marked & (x.s - a.end < NEAR)), lambda marked: F.struct(x.e.alias("end"), marked.alias("marked"), F.array_append(a.hits, F.struct(
                (F.when(marked, 3).otherwise(0) + F.when(x.s < F.length(clean) * FRONT, 1).otherwise(0)).alias("score"), x.s.alias("s"), F.lower(x.email).alias("email"), before.alias("before"))).alias("hits")))

        return T.let(T.between(clean, F.greatest(x.s - REACH, a.end), x.s), told)

    return F.aggregate(own, start, step, lambda a: a.hits)


def corresponding(text: Column, authors: Column, limit: int = LIMIT) -> Column:
    """array<struct<name, email>>: the likely corresponding authors, in text order.

    Addresses that follow a marker, or another such address closely, come before others, and so do those near the
    front; only the best kind is given. No name is given twice.
    """

    def named(h: Column) -> Column:
        told = T.let(F.trim(_last(NAME_AFTER, h.before)), lambda t: F.when(t.rlike(NOT_A_NAME), "").otherwise(t))
        return F.struct(T.let(name_for(h.email, authors), lambda n: F.when(n != "", n).otherwise(told)).alias("name"), h.email.alias("email"))

    best = lambda hits: F.filter(hits, lambda h: h.score == F.array_max(F.transform(hits, lambda o: o.score)))
    first = lambda xs: F.slice(F.filter(xs, lambda h, i: ~F.exists(F.slice(xs, F.lit(1), i), lambda o: o.email == h.email)), 1, limit)
    once = lambda xs: F.transform(xs, lambda c, i: F.struct(F.when(F.exists(F.slice(xs, F.lit(1), i), lambda o: o["name"] == c["name"]), "").otherwise(c["name"]).alias("name"), c.email.alias("email")))
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return T.let(clean, lambda t: T.let(_hits(t), lambda hits: T.let(best(hits), lambda xs: T.let(F.transform(first(xs), named), once))))


def author_names(work: Column) -> Column:
    """"Given Family" of the authors (array<struct<given, family>>) that have a family name."""
    return F.transform(F.filter(work, lambda a: T.present(a["family"])), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), a["family"]))


def contact_rows(papers: DataFrame) -> DataFrame:
    """One row an address of ``papers`` (doi, title, status, acknowledges_facility, grant_cited, contacts); a paper without any has its own.

    An address keeps its first spelling and its first name by DOI; its papers are listed by DOI. It is confirmed if one
    of its papers is. ``place`` is the order to read the rows in: addresses first, confirmed before likely.
    """
    has = F.filter("contacts", lambda c: T.present(c["email"]))
    rows = papers.withColumn("own", has)
    each = rows.select("doi", "title", "status", "acknowledges_facility", "grant_cited", F.posexplode("own").alias("i", "c"))
    order = F.struct("doi", "i")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doi", "i", F.coalesce(F.col(c), F.lit("")).alias("v")))), lambda x: x.v), "; ")
    people = each.withColumn("email", F.col("c.email")).groupBy(F.lower("email").alias("key")).agg(
        F.coalesce(F.min_by("c.name", F.when(T.present(F.col("c.name")), order)), F.lit("")).alias("name"), F.min_by("email", order).alias("email"),
        F.when(F.max(F.col("status") == "confirmed"), "confirmed").otherwise("likely").alias("status"), F.count("*").alias("papers"),
        listed("doi").alias("dois"), listed("title").alias("titles"), listed("acknowledges_facility").alias("acknowledges_facility"), listed("grant_cited").alias("grant_cited"),
    )
    none = rows.filter(F.size("own") == 0).select(F.lit("").alias("key"), F.lit("").alias("name"), F.lit("").alias("email"), "status", F.lit(1).cast("long").alias("papers"), F.col("doi").alias("dois"), F.col("title").alias("titles"), "acknowledges_facility", "grant_cited")
    place = F.struct((F.col("key") == "").alias("no_email"), (F.col("status") != "confirmed").alias("likely"), F.col("key"), F.col("dois"))
    return people.unionByName(none).withColumn("place", place).drop("key")
