"""Upserts, latest-row rules, interval joins, per-group bests and fuzzy keys, as DataFrame operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import TITLE_PREFIX, TITLE_SHARE, long_words, present


def upsert(sources: list[DataFrame], key: str, fields: list[str], name: str = "source") -> DataFrame:
    """Merge sources, first one first: the first present value of each field, and the sources' names in order.

    One map-side combined aggregation on the key; no join, however many sources.
    """
    rows = None
    for k, df in enumerate(sources):
        part = df.select(key, name, *fields).withColumn("_order", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    first = lambda c: F.min_by(c, F.when(present(F.col(c).cast("string")), F.col("_order"))).alias(c)
    order = F.array_sort(F.collect_set(F.struct("_order", name)))
    return rows.groupBy(key).agg(*(first(c) for c in fields), F.array_join(F.array_distinct(F.transform(order, lambda s: s[name])), "; ").alias("sources"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key; the limit by rank is applied before the shuffle too."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def within(left: DataFrame, right: DataFrame, key: str, at: str, of: str, before: int, after: int) -> DataFrame:
    """Equi-join on ``key`` with -before <= left.at - right.of <= after: a hash or merge join with a residual range."""
    return left.join(right, key).filter(F.col(at) - F.col(of) >= -before).filter(F.col(at) - F.col(of) <= after)


def best_matches(left: DataFrame, right: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """At most ``n`` partners for each left key."""
    w = Window.partitionBy(key).orderBy(*order)
    return left.join(right, key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def every_title(docs: DataFrame, titles: DataFrame, share: float = TITLE_SHARE, prefix: int = TITLE_PREFIX, pass_rows: int = 4096, block: int = 256, rows: int = 500) -> DataFrame:
    """(doc_id, item_id): each row of ``docs`` (doc_id, text) with each row of ``titles`` (item_id, text) that ``matches_paper`` accepts as its title.

    All titles are compared: ``pass_rows`` of them are broadcast for one pass over the texts, and in a pass texts and
    titles meet as matrices of words, ``rows`` by ``block``.
    """
    spark = docs.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((docs, "doc_id"), (titles, "item_id")))
    there = docs.filter(present(F.col("text"))).select("doc_id", F.array_distinct(long_words(F.substring("text", 1, prefix))).alias("there"))
    wanted = titles.filter("text IS NOT NULL").select("item_id", long_words(F.col("text")).alias("wanted"))
    passes = max(1, -(-wanted.count() // pass_rows))
    out = None
    for k in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toArrow()
        shared = spark.sparkContext.broadcast((part.column("item_id").combine_chunks(), part.column("wanted").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, lists = shared.value
            blocks = []
            for at in range(0, len(lists), block):
                counts = [Counter(w) for w in lists[at : at + block]]
                known = pa.array(sorted(set().union(*counts)), pa.string())
                place = {w: i for i, w in enumerate(known.to_pylist())}
                m = np.zeros((len(known), len(counts)), np.float32)
                for j, c in enumerate(counts):
                    for w, n in c.items():
                        m[place[w], j] = n
                size = m.sum(0)
                blocks.append((at, known, m, np.where(size < 3, 0, share * size)))
            for whole in batches:
                for a in range(0, whole.num_rows, rows):
                    b = whole.slice(a, rows)
                    words, row = b.column(1).flatten(), pc.list_parent_indices(b.column(1)).to_numpy()
                    for at, known, m, least in blocks:
                        code = pc.index_in(words, value_set=known)
                        hit = code.is_valid().to_numpy(zero_copy_only=False)
                        x = np.zeros((b.num_rows, len(known)), np.float32)
                        x[row[hit], code.fill_null(0).to_numpy()[hit]] = 1
                        i, j = np.nonzero(x @ m >= least)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), items.take(pa.array(at + j))], ["doc_id", "item_id"])

        found = there.mapInArrow(run, kinds)
        out = found if out is None else out.unionAll(found)
    return out
