"""Counts that say how well the search works: by category and technique, recall of confirmed papers, what verdicts teach."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corvane.functions.text import wilson
from corvane.operators.sheets import why_missed
from corvane.rules import CATEGORIES, FLAGGED, LEADS, Rules

#: Why a paper was listed, by how the reason begins; ranks that are counted together.
GROUPS = {"acknowledges": "new: acknowledges", "instrument": "new: facility instrument", "check list": "reads like", "earlier": "earlier verdict"}
BANDS = ((1, 50), (51, 100), (101, 200), (201, None))


def category_counts(screened: DataFrame, listed: DataFrame) -> DataFrame:
    """(category, meaning, papers, with_text, on_list) of the categories that occur; ``listed`` (doi)."""
    rows = screened.join(listed.select("doi", F.lit(True).alias("on")).distinct(), "doi", "left")
    meaning = F.element_at(F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p)), F.col("category"))
    return rows.groupBy("category").agg(F.count("*").alias("papers"), F.count_if("has_text").alias("with_text"), F.count_if("on").alias("on_list")).withColumn("meaning", meaning)


def missing(screened: DataFrame, listed: DataFrame) -> DataFrame:
    """(doi): confirmed papers that aren't among the candidates."""
    return listed.select("doi").distinct().join(screened.select("doi"), "doi", "left_anti")


def technique_counts(screened: DataFrame, listed: DataFrame, r: Rules) -> DataFrame:
    """One row a technique of the rules, found or not: papers that name it, and how many of these acknowledge, are confirmed, are leads."""
    spark = screened.sparkSession
    dims = spark.createDataFrame([(t.id, t.vocab, t.strength) for t in r.techniques], "technique string, vocab string, strength string")
    rows = screened.filter("has_text").join(listed.select("doi", F.lit(True).alias("on")).distinct(), "doi", "left").select("category", "on", F.explode(F.map_keys("techniques")).alias("technique"))
    counts = rows.groupBy("technique").agg(F.count("*").alias("papers"), F.count_if(F.col("category") == "A").alias("acknowledging_facility"), F.count_if("on").alias("confirmed"), F.count_if(F.col("category").isin(*LEADS)).alias("leads"))
    return dims.join(F.broadcast(counts), "technique", "left").na.fill(0)


def recall(confirmed: DataFrame, screened: DataFrame, universe: DataFrame) -> DataFrame:
    """One row a year: confirmed papers (doi, year) found by the search, with text, missed, and what is new.

    ``screened`` (doi, year, priority, has_text), ``universe`` (doi, year): a year's candidates.
    """
    rows = confirmed.select("doi", "year", F.lit(True).alias("listed")).join(screened.select("doi", "year", "priority", "has_text"), ["doi", "year"], "full_outer")
    rows = rows.join(universe.select("doi", "year", F.lit(True).alias("candidate")).distinct(), ["doi", "year"], "left")
    flagged, listed = F.coalesce(F.col("priority").isin(*FLAGGED), F.lit(False)), F.coalesce("listed", F.lit(False))
    with_text = F.coalesce("has_text", F.lit(False))
    counts = {
        "listed": listed, "found": listed & flagged, "listed_in_universe": listed & F.coalesce("candidate", F.lit(False)), "listed_with_text": listed & with_text, "found_with_text": listed & flagged & with_text,
        "new_report": ~listed & (F.col("priority") == "report"), "new_check": ~listed & (F.col("priority") == "check"), "screened": F.col("has_text").isNotNull(),
    }
    return rows.withColumns({f"is_{k}": c for k, c in counts.items()}).groupBy("year").agg(*(F.count_if(F.col(f"is_{k}")).alias(k) for k in counts))


def with_interval(counts: DataFrame) -> DataFrame:
    """``recall`` with the share found and its 95 % interval; without confirmed papers there is no share."""
    low, high = wilson(F.col("found").cast("double"), F.col("listed"))
    return counts.withColumns({"recall": F.when(F.col("listed") > 0, F.col("found") / F.nullif("listed", F.lit(0))), "low": low, "high": high})


def totals(counts: DataFrame) -> DataFrame:
    """``recall`` summed over all years, with the pooled interval."""
    return with_interval(counts.agg(*(F.sum(c).alias(c) for c in counts.columns if c != "year")))


def missed(confirmed: DataFrame, screened: DataFrame, universe: DataFrame) -> DataFrame:
    """(doi, year, why) of confirmed papers that weren't flagged."""
    rows = confirmed.select("doi", "year").join(screened.select("doi", "year", "priority", "has_text", "category"), ["doi", "year"], "left")
    rows = rows.join(universe.select("doi", "year", F.lit(True).alias("candidate")).distinct(), ["doi", "year"], "left").filter(~F.coalesce(F.col("priority").isin(*FLAGGED), F.lit(False)))
    return rows.select("doi", "year", why_missed(F.coalesce("candidate", F.lit(False)), F.col("has_text"), F.col("priority"), F.col("category")).alias("why"))


def group_of(why: Column) -> Column:
    """Why a paper was listed, in a word."""
    out = F.lit("other")
    for name, begin in reversed(GROUPS.items()):
        out = F.when(why.startswith(begin), name).otherwise(out)
    return out


def band_of(rank: Column) -> Column:
    """The band of a rank."""
    out = F.lit(None).cast("string")
    for low, high in reversed(BANDS):
        out = F.when(rank >= low if high is None else rank.between(low, high), f"{low}+" if high is None else f"{low}-{high}").otherwise(out)
    return out


def verdict_groups(decisions: DataFrame) -> DataFrame:
    """(why_group, yes, likely, no): how right each reason to list a paper was."""
    return decisions.withColumn("why_group", group_of(F.col("why"))).groupBy("why_group").pivot("verdict", ["yes", "likely", "no"]).agg(F.count("doi")).na.fill(0)


def rank_bands(decisions: DataFrame) -> DataFrame:
    """(band, reviewed, yes) of the check list: how far down it is worth reading."""
    rows = decisions.filter(group_of(F.col("why")) == "check list").withColumn("band", band_of(F.col("embedding_rank"))).filter("band IS NOT NULL")
    return rows.groupBy("band").agg(F.count("*").alias("reviewed"), F.count_if(F.col("verdict") == "yes").alias("yes"))


def no_reasons(decisions: DataFrame) -> DataFrame:
    """(why_group, reason, n) of the papers judged "no": which rule to mend first."""
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("(no reason given)"))
    return decisions.filter("verdict = 'no'").groupBy(group_of(F.col("why")).alias("why_group"), reason.alias("reason")).agg(F.count("*").alias("n"))


def rules_missed(decisions: DataFrame) -> DataFrame:
    """(year, doi, rank, reason) of check-list papers judged "yes": the rules didn't flag them."""
    return decisions.filter((group_of(F.col("why")) == "check list") & (F.col("verdict") == "yes") & F.col("embedding_rank").isNotNull()).select("year", "doi", F.col("embedding_rank").alias("rank"), "reason")


def capabilities(records: DataFrame, modules: dict[str, str], ignore: tuple[str, ...]) -> DataFrame:
    """(instrument, name, term) of instrument records (instrument, name, modes array, modules array): what each can do; an instrument without terms has one row with null."""
    known = F.create_map(*(F.lit(x) for p in modules.items() for x in p)) if modules else F.create_map().cast("map<string,string>")
    by_module = F.transform(F.filter("modules", lambda m: F.array_contains(F.map_keys(known), m)), lambda m: F.element_at(known, m))
    terms = F.array_distinct(F.concat(F.coalesce("modes", F.array().cast("array<string>")), F.coalesce(by_module, F.array().cast("array<string>"))))
    return records.select("instrument", "name", F.explode_outer(F.array_except(terms, F.lit(list(ignore) or [""]))).alias("term"))


def coverage(offered: DataFrame, r: Rules) -> DataFrame:
    """(gap, item, found_on): instruments without a pattern or without components, terms without a pattern and where they are offered, patterns that no instrument needs."""
    spark = offered.sparkSession
    techniques = spark.createDataFrame([(t.id,) for t in r.techniques], "term string")
    patterns = spark.createDataFrame([(i.id, bool(i.components)) for i in r.instruments], "instrument string, has_components boolean")
    active = offered.select("instrument", "name").distinct()
    no_pattern = active.join(F.broadcast(patterns), "instrument", "left_anti").select(F.lit("no pattern").alias("gap"), F.col("instrument").alias("item"), F.col("name").alias("found_on"))
    no_parts = active.join(F.broadcast(patterns.filter("NOT has_components")), "instrument", "left_semi").select(F.lit("no components").alias("gap"), F.col("instrument").alias("item"), F.col("name").alias("found_on"))
    terms = offered.filter("term IS NOT NULL").groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("instrument")), ", ").alias("found_on"))
    no_technique = terms.join(F.broadcast(techniques), "term", "left_anti").select(F.lit("no technique").alias("gap"), F.col("term").alias("item"), "found_on")
    unused = techniques.join(terms, "term", "left_anti").select(F.lit("unused technique").alias("gap"), F.col("term").alias("item"), F.lit("").alias("found_on"))
    return no_pattern.unionByName(no_parts).unionByName(no_technique).unionByName(unused)


def as_text(title: str, rows: list, **columns: Callable[[Row], object]) -> list[str]:
    """A small collected table as aligned lines: a title, a head, a line a row; nothing where there are no rows."""
    if not rows:
        return []
    cells = [[c.replace("_", " ") for c in columns]] + [[str(f(r)) for f in columns.values()] for r in rows]
    width = [max(map(len, column)) for column in zip(*cells)]
    return [title, *("  ".join(x.rjust(n) for x, n in zip(line, width)) for line in cells)]


def share(part: int, whole: int) -> str:
    """A share in percent, or a dash of nothing."""
    return f"{100 * part / whole:.0f} %" if whole else "-"


def format_recall(rows: list) -> str:
    """``with_interval``'s rows, collected: a line a year, so few."""
    within = lambda r: f"{100 * r.low:.0f} to {100 * r.high:.0f} %" if r.listed else "-"
    return "\n".join(as_text(
        "Confirmed papers that the rules found, by year", sorted(rows, key=lambda r: r.year), year=lambda r: r.year, confirmed=lambda r: r.listed, found=lambda r: r.found, recall=lambda r: share(r.found, r.listed), likely_range=within,
        confirmed_with_text=lambda r: r.listed_with_text, found_with_text=lambda r: r.found_with_text, new_to_report=lambda r: r.new_report, new_to_check=lambda r: r.new_check,
    ))


def format_feedback(groups: list, bands: list, reasons: list, found: list) -> str:
    """What verdicts say of the rules and the ranking: four small tables, collected."""
    n = lambda g: g.yes + g.likely + g.no
    tables = (
        as_text("Verdicts by why a paper was shown", groups, shown_because=lambda g: g.why_group, verdicts=n, yes=lambda g: g.yes, likely=lambda g: g.likely, no=lambda g: g.no, share_of_yes=lambda g: share(g.yes, n(g))),
        as_text("Check list: how far down it still pays", sorted(bands, key=lambda b: int(re.match(r"\d+", b.band)[0])), places=lambda b: b.band, verdicts=lambda b: b.reviewed, yes=lambda b: b.yes),
        as_text("Reasons for no", sorted(reasons, key=lambda r: (r.why_group, -r.n, r.reason)), shown_because=lambda r: r.why_group, papers=lambda r: r.n, reason=lambda r: r.reason),
        as_text("Papers that no rule found", sorted(found, key=lambda m: (m.year, m.rank)), year=lambda m: m.year, place=lambda m: m.rank, doi=lambda m: m.doi, reason=lambda m: m.reason),
    )
    return "\n".join("\n".join(t) for t in tables if t) or "No verdicts yet"
