"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits (bytes beyond ASCII count as letters), A-Z lower-cased. Seeds are windows of
``min_match`` tokens, hashed as in Karp-Rabin; the seeds that a document shares with a test item are joined and run
on along their diagonals to maximal matches. The longest match is marked as a tile again and again, what overlaps
earlier tiles being cut to its unmarked rest, until none of ``min_match`` tokens is left. An item whose tokens are
covered to ``threshold`` or more contaminates the document, in whatever order its parts stand.

Test items are a stated query set: they are read in blocks of bounded size, each broadcast and held against all
documents; documents are never shuffled. Null or empty texts, and items of fewer than ``min_match`` tokens, match
nothing. Repeated documents or items give repeated rows; null ids stay null. Hits of a document and an item are worked
on HITS at a time, so that repetitive ones need bounded memory. Empty tables give no rows, or drop none. Further columns
of the documents don't reach a result; ``drop_contaminated`` keeps them all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LETTERS, flat_bytes, grouped, mix64, small_batches, table, word_hashes

BLOCK_BYTES, HITS = 16 << 20, 1 << 21


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` tokens."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
    return mix64(out)


def _joined(diagonal: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (diagonal, first, last item position) with those that follow each other on a diagonal made one."""
    order = np.lexsort((first, diagonal))
    d, a, z = diagonal[order], first[order], last[order]
    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != z[:-1] + 1)))
    return d[starts], a[starts], z[np.append(starts[1:], len(d)) - 1]


def maximal_matches(hits: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple[int, int, int]]:
    """(length, item position, document position) of maximal matches from seed hits (document positions, item positions), given part by part."""
    parts = [_joined(doc_at - item_at, item_at, item_at) for doc_at, item_at in hits]
    d, a, z = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return list(zip((z - a + size).tolist(), a.tolist(), (a + d).tolist(), strict=True))


def tile(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item position, document position) of maximal matches, longest first; ties by item, then document position."""
    heap = [(-n, t, d) for n, t, d in matches]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    tiles = []
    while heap:
        n, t, d = heapq.heappop(heap)
        n = -n
        free = [t + k not in in_item and d + k not in in_doc for k in range(n)]
        if all(free):
            tiles.append((n, t, d))
            in_item.update(range(t, t + n))
            in_doc.update(range(d, d + n))
            continue
        k = 0
        while k < n:  # the unmarked pieces compete anew
            e = k
            while e < n and free[e]:
                e += 1
            if e - k >= size:
                heapq.heappush(heap, (-(e - k), t + k, d + k))
            k = e + 1
    return tiles


class Items:
    """A block of test items with its seeds."""

    def __init__(self, ids: list, texts: list[bytes | None], size: int) -> None:
        self.ids, self.size = ids, size
        h, counts = word_hashes(*flat_bytes(pa.array(texts, pa.binary())), ~LETTERS)
        self.tokens = counts.tolist()
        seeds, item, at = [], [], []
        end = 0
        for i, n in enumerate(self.tokens):
            end += n
            w = windows(h[end - n : end], size)
            seeds.append(w)
            item += [i] * len(w)
            at += range(len(w))
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], np.array(item, np.int64)[order], np.array(at, np.int64)[order]
        # the seeds of each item by themselves, in order
        own = np.argsort(self.item, kind="stable")
        cuts = np.searchsorted(self.item[own], np.arange(len(ids) + 1))
        self.own = [(self.seed[own[a:b]], self.at[own[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def touched(self, seeds: np.ndarray) -> np.ndarray:
        """The items that hold one of some distinct seeds."""
        lo, hi = np.searchsorted(self.seed, seeds), np.searchsorted(self.seed, seeds, side="right")
        n = hi - lo
        return np.unique(self.item[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])

    def hits(self, i: int, at: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document positions, item positions) of the hits with item ``i`` of the windows ``seeds`` that stand ``at`` places, HITS or so at a time."""
        seed, place = self.own[i]
        lo, hi = np.searchsorted(seed, seeds), np.searchsorted(seed, seeds, side="right")
        n = hi - lo
        some = np.flatnonzero(n)
        part = np.cumsum(n[some]) // HITS
        for k in np.split(some, np.flatnonzero(np.diff(part)) + 1):
            yield np.repeat(at[k], n[k]), place[np.repeat(lo[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(int(n[k].sum()))]

    def matches(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of the rows that cover an item to ``threshold``."""
        if not len(self.seed):
            return
        h, counts = word_hashes(data, offsets, ~LETTERS)
        w = windows(h, self.size)
        k = np.searchsorted(self.seed, w)
        hit = np.flatnonzero((k < len(self.seed)) & (self.seed[np.minimum(k, len(self.seed) - 1)] == w))
        ends = np.cumsum(counts)
        row = np.searchsorted(ends, hit, side="right")
        inside = hit + self.size <= ends[row]  # the window lies in one row
        hit, row = hit[inside], row[inside]
        if not len(row):
            return
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(row)), strict=True):
            r = int(row[a])
            at, seeds = hit[a:b] - (ends[r] - counts[r]), w[hit[a:b]]
            known = np.unique(seeds)
            for i in self.touched(known).tolist():
                # an upper bound of what tiles can cover, from the item's positions that any seed touches
                seed, place = self.own[i]
                shared = place[np.isin(seed, known)]
                covered = np.zeros(self.tokens[i] + 1, np.int64)
                np.add.at(covered, shared, 1)
                np.add.at(covered, shared + self.size, -1)
                if (np.cumsum(covered)[:-1] > 0).sum() < threshold * self.tokens[i]:
                    continue
                tiles = tile(maximal_matches(self.hits(i, at, seeds), self.size), self.size)
                if sum(t[0] for t in tiles) >= threshold * self.tokens[i]:
                    yield r, i, tiles


def blocks(benchmark: DataFrame, size: int) -> Iterator[Items]:
    """The test items in blocks of about BLOCK_BYTES, by a hash of their ids."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("b")).filter("b IS NOT NULL")
    total = items.agg(F.sum(F.length("b"))).first()[0] or 0
    parts = 1 + total // BLOCK_BYTES
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "b"), F.lit(parts)) == k).toArrow()
        yield Items(rows.column("item_id").to_pylist(), rows.column("b").to_pylist(), size)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.6) -> DataFrame:
    """One row per document and test item that it contains: doc_id, item_id, n_tiles, n_covered, n_tokens, coverage."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("b"))
    out = None
    for block in blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for t in grouped(batches):
                ids = t.column("doc_id").to_pylist()
                found = [(ids[r], items.ids[i], len(tiles), sum(x[0] for x in tiles), items.tokens[i]) for r, i, tiles in items.matches(*flat_bytes(t.column("b")), threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "n_tiles", "n_covered", "n_tokens"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, n_tiles long, n_covered long, n_tokens long")
        out = part if out is None else out.unionAll(part)
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.6) -> DataFrame:
    """``docs`` without contaminated documents; a filter in place, once per block of test items."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for block in blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches):
                clean = np.ones(t.num_rows, dtype=bool)
                for r, _, _ in shared.value.matches(*flat_bytes(t.column(at).cast(pa.binary())), threshold):
                    clean[r] = False
                yield from t.filter(pa.array(clean)).combine_chunks().to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of ``benchmark``, with the passage."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
