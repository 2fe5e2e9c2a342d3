"""A year's work from candidates to ranked lists: collect, find texts, screen, screen again, rank, build the tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ranking, screening, sheets
from corvane.rules import FLAGGED, Rules
from corvane.sources import harvest, records


def collect(institutional: list[tuple[str, DataFrame]], hits: DataFrame, r: Rules) -> DataFrame:
    """A year's candidates: the institutional sources in the rules' order, then what a search for acknowledgements found, with its identifiers."""
    gates = {s["name"]: bool(s.get("science_fields_only")) for s in r.sources}
    science_only = r.raw.get("institutional_fields", "science") != "all"
    listed = [(name, df, science_only and gates.get(name, False)) for name, df in institutional] + [("europepmc_ack", hits, False)]
    return records.with_identifiers(records.universe(listed, harvest.is_science(F.col("fields"))), hits)


def texts_of(papers: DataFrame, held: DataFrame, offers: DataFrame) -> DataFrame:
    """(doi, text, source, url, license, version, is_new) of ``papers``, a row each: a held text that spares another look, else the first usable offer, else what is held all the same.

    ``held`` (doi, text, scope, source) has a row a DOI at most; ``offers`` as for ``records.resolve_texts``. Texts that
    come from an offer are new.
    """
    own = held.select("doi", F.col("text").alias("held"), F.col("source").alias("held_source"), records.reusable(F.col("text"), F.col("scope"), F.col("source")).alias("enough"))
    known = papers.select("doi").join(own, "doi", "left")
    found = records.resolve_texts(papers.join(own.filter("enough").select("doi"), "doi", "left_anti"), offers)
    rows = known.join(found, "doi", "left").withColumn("is_new", T.present(F.col("text")))
    other = lambda c, h: F.when(F.col("is_new"), F.col(c)).when(T.present(F.col("held")), F.col(h))
    kept = [F.when(F.col("is_new"), F.col(c)).alias(c) for c in ("url", "license", "version")]
    return rows.select("doi", other("text", "held").alias("text"), other("source", "held_source").alias("source"), *kept, F.coalesce("is_new", F.lit(False)).alias("is_new"))


def sweep(candidates: DataFrame, log: DataFrame, held: DataFrame, offers: DataFrame, acknowledged: DataFrame, r: Rules, bookings: DataFrame | None = None, staff: tuple[str, ...] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(screened rows to append, private rows, texts to store) of the candidates that aren't done yet.

    A paper without any text is left alone if the log has a row with text of it.
    """
    todo = records.to_do(candidates, log, held, limit)
    texts = texts_of(todo, held, offers)
    had = log.filter("has_text").select("doi").distinct().withColumn("_had", F.lit(True))
    rows = todo.join(texts.select("doi", "text", F.col("source").alias("text_source")), "doi", "left").join(had, "doi", "left").filter("text IS NOT NULL OR _had IS NULL").drop("_had")
    public, private = screening.split_private(screening.screen(with_people(rows, acknowledged, bookings), r, staff))
    return public.drop("text"), private, texts.filter("is_new").drop("is_new")


def with_people(rows: DataFrame, acknowledged: DataFrame, bookings: DataFrame | None) -> DataFrame:
    """Rows with what is known of their authors: earlier acknowledging papers, and bookings where there are any."""
    rows = rows.withColumn("local_authors", harvest.clean_authors("local_authors"))
    rows = screening.with_history(rows, acknowledged)
    return rows if bookings is None else screening.with_bookings(rows, bookings)


def rescreen(rows: DataFrame, texts: DataFrame, acknowledged: DataFrame, r: Rules, fresh: DataFrame | None = None, bookings: DataFrame | None = None, staff: tuple[str, ...] = ()) -> DataFrame:
    """Rows screened again by their held texts (doi, text) and fresh metadata; rows without a held text stay as they were.

    A text that turns out to be another paper's counts as none.
    """
    rows = records.overlaid(rows, fresh) if fresh is not None else rows
    keep = [c for c in ("doi", *records.META_KEYS, "text_source") if c in rows.columns]
    again = rows.join(texts.select("doi", "text"), "doi").select(*keep, F.when(T.matches_paper(F.col("text"), F.col("doi"), F.col("title")), F.col("text")).otherwise("").alias("text"))
    done = screening.screen(with_people(again, acknowledged, bookings), r, staff).drop("text")
    return done.unionByName(rows.join(texts.select("doi"), "doi", "left_anti"), allowMissingColumns=True)


def chunked(papers: DataFrame, r: Rules) -> DataFrame:
    """(doi, chunks): the chunks of each paper that say most about imaging, without the facility's name."""
    from corvane.rules import java_pattern

    return papers.filter(T.present(F.col("text"))).select("doi", T.imaging_chunks(F.col("text"), java_pattern(r.facility_terms), java_pattern(r.imaging)).alias("chunks"))


def rank(scores: DataFrame, screened: DataFrame, confirmed: DataFrame, stamp: Column) -> DataFrame:
    """The check lists: ``scores`` (year, id, embedding, tfidf) ranked three ways, with what the rules say; (id) of screened rows is their doi."""
    rows = scores.join(screened.select(F.col("doi").alias("id"), "title", "priority", "category", "microscopy_terms"), "id", "left")
    rows = rows.join(confirmed.select(F.col("doi").alias("id"), "year", F.lit(True).alias("listed")).distinct(), ["id", "year"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = rows.withColumn("flagged", F.coalesce(F.col("priority").isin(*FLAGGED), F.lit(False)))
    ranked = ranking.ranks(rows, "embedding", "tfidf", "microscopy_terms")
    return ranked.withColumns({"link": sheets.link(F.col("id").cast("string")), "embedding": F.round("embedding", 4), "tfidf": F.round("tfidf", 4), "rules_version": stamp})


def embed_store(held: DataFrame, papers: DataFrame, r: Rules, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """A vector store brought up to date with ``papers`` (doi, text)."""
    return ranking.refresh_store(held, chunked(papers, r), embed)
