"""What is done with a year once it is screened: rank it, make its tables, take in verdicts, learn from them for other years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import ranking, reports, sheets
from corvane.plans import sweep
from corvane.rules import Rules


def known_papers(confirmed: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doi, year): confirmed papers, and those judged "yes" that aren't filed yet."""
    new = decisions.filter("verdict = 'yes'").select("doi", "year").join(confirmed.select("doi"), "doi", "left_anti")
    return confirmed.select("doi", "year").unionByName(new).distinct()


def rejected(decisions: DataFrame) -> DataFrame:
    """(doi): papers judged "no"; they are learnt from even where the rules flagged them."""
    return decisions.filter("verdict = 'no'").select("doi").distinct()


def prepare(year: int, store: DataFrame, known_store: DataFrame, others: DataFrame, screened: DataFrame, confirmed: DataFrame, decisions: DataFrame, stamp: Column, stop: tuple[str, ...] = ()) -> DataFrame:
    """The check list of a year: its papers (``store``: doi, vector, chunk_text) scored by what confirmed papers of other years and rejected ones teach, by vectors and by words.

    ``known_store`` and ``others`` (doi, vector, chunk_text): known papers and those of other years. Versions of a paper
    of the year teach nothing. ``stop``: words that don't count. Without chunk_text, papers score 0 by words.
    """
    known = known_papers(confirmed, decisions)
    flagged = screened.filter(f"year <> {int(year)} AND priority IN ('report', 'check')").select("doi")
    pos, neg = ranking.training_sets(year, known, store, others, flagged, rejected(decisions))
    vector = F.transform("vector", lambda x: x.cast("double"))
    rows = store.select(F.col("doi").alias("id"), F.lit(year).alias("year"), vector.alias("v"))
    good, bad = known_store.join(pos, "doi", "left_semi"), others.join(neg, "doi", "left_semi")
    held = good.select(F.col("doi").alias("known"), F.lit(-1).alias("known_year"), vector.alias("u"))
    scores = ranking.year_scores(rows, held, bad.select(vector.alias("v"))).withColumnRenamed("score", "embedding")
    if "chunk_text" in store.columns:
        taught = good.join(ranking.near_versions(rows, held).select(F.col("known").alias("doi")), "doi", "left_anti").select(F.col("doi").alias("known"), F.lit(-1).alias("known_year"), F.col("chunk_text").alias("text"))
        by_words = ranking.tfidf_scores(store.select(F.col("doi").alias("id"), F.lit(year).alias("year"), F.col("chunk_text").alias("text")), taught, bad.select(F.col("chunk_text").alias("text")), stop)
        scores = scores.join(by_words.withColumnRenamed("score", "tfidf"), "id")
    else:
        scores = scores.withColumn("tfidf", F.lit(0.0))
    return sweep.rank(scores.select(F.lit(year).alias("year"), "id", "embedding", "tfidf"), screened.filter(F.col("year") == year), known, stamp)


def collect(year: int, screened: DataFrame, confirmed: DataFrame, ranked: DataFrame, previous: DataFrame, texts: DataFrame, contacts: DataFrame, universe: DataFrame, r: Rules, top: int = 200) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a year with the verdicts given so far, and the lines of papers to file."""
    ranks = ranked.filter(F.col("year") == year).select(F.col("id").alias("doi"), F.col("embedding_rank").alias("rank"))
    return sheets.build(screened.filter(F.col("year") == year), confirmed, ranks, previous, texts, contacts, universe, year, r, top)


def feedback(decisions: DataFrame) -> str:
    """What the verdicts say about rules and ranking, to read; its tables are small by nature."""
    tables = (reports.verdict_groups(decisions), reports.rank_bands(decisions), reports.no_reasons(decisions), reports.rules_missed(decisions))
    return reports.format_feedback(*(t.collect() for t in tables))


def format_hits(rows: list, listed: int, papers: int) -> str:
    """``ranking.top_hits`` of a year, collected, as lines to read."""
    lines = [f"{papers} papers ranked, {listed} of them confirmed", f"  {'':10}{'embedding':>10}{'tfidf':>8}{'terms':>8}{'to check':>10}"]
    lines += [f"  top {r.n:<6}{r.embedding:>10}{r.tfidf:>8}{r.microscopy_terms:>8}{r.new:>10}" for r in sorted(rows, key=lambda r: r.n)]
    return "\n".join(lines)
