"""How quality filters interact: what each removes at each place of every order, and its Shapley share.

Each document gets a mask of the filters it fails, by built-in functions. Documents are counted by part, mask and
label, so that all later work is on at most 2**k cells a part. The k! orders are then visited by single swaps of
neighbours (plain changes): a swap alters the steps at its two places alone, so only these two are summed anew from
the cells; the other steps keep their figures. What a filter removes is added up along the walk, which is its Shapley
value times k!.

A text is a copy if a smaller doc_id anywhere in the table holds the same text. Texts stand by their SHA-256. All copies
of a text share its other failures, so groups of copies are counted by part and label first, and only these counts are
held against the smallest id of the group: no task gets the rows of a group of copies.

Null texts are empty, a null source is the part ''. A document without an id is never a copy and makes none. Repeated
documents count each; rows that repeat the smallest id of a text are no copies. Several label rows of a document count
as good, or toxic, if any of them says so. An empty table has no parts and gives no rows. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, table

WORD = r"[^\x20\x09-\x0D]+"
#: Parts whose orders a task holds at once.
PARTS = 256


def quality_filters(text: Column, words: Column) -> dict[str, Column]:
    """What makes a document fail, by filter: too short, too repetitive, too many capitals, odd signs."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, copy_key, mask): bit i of the mask is the i-th filter; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(quality_filters(F.col("text"), F.col("words")).values())), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("copy_key"), mask.cast("int").alias("mask"))


def mask_cells(failed: DataFrame, labels: DataFrame, copy_bit: int, ws: Workspace) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, copies included."""
    any_ = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(any_("quality").alias("good"), any_("toxic").alias("bad"))
    one = failed.join(marks, "doc_id", "left").select("doc_id", "copy_key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    alike = ["copy_key", "part", "mask", "good", "bad"]
    rows = one.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))  # within a group each id stands once
    groups = rows.groupBy(*alike).agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"))
    groups = ws.save(groups, "groups")
    least = groups.groupBy("copy_key").agg(F.min("first.doc_id").alias("least"))
    passing = F.col("unnumbered") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.join(least, "copy_key").select("part", "good", "bad", F.explode(F.array(F.struct("mask", passing.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << copy_bit).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.filter(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), n).otherwise(0)).alias("toxic"))


def swaps(k: int) -> Iterator[int]:
    """Places i, one after the other: exchanging i and i + 1 visits all k! orders, each once."""
    order, way = list(range(k)), [-1] * k
    while True:
        movable = [x for i, x in enumerate(order) if 0 <= i + way[x] < k and order[i + way[x]] < x]
        if not movable:
            return
        top = max(movable)
        i = order.index(top)
        j = i + way[top]
        order[i], order[j] = order[j], order[i]
        way = [-w if x > top else w for x, w in enumerate(way)]
        yield min(i, j)


def walk(cells: np.ndarray, k: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """All orders of k filters over ``cells`` (part, mask, figures); the first figure counts documents.

    Returns the orders, what each step removes (part, order, step, figures), and the documents that each filter removes
    over all orders (part, filter).
    """
    masks = np.arange(1 << k)

    def removed(before: int, own: int) -> np.ndarray:
        return cells[:, (masks & before == 0) & (masks >> own & 1 == 1)].sum(1)

    order, orders, seen = list(range(k)), [], []
    before = [(1 << i) - 1 for i in range(k)]  # the filters ahead of each step
    steps = [removed(before[i], order[i]) for i in range(k)]
    total = np.zeros((len(cells), k), np.int64)
    places = swaps(k)
    while True:
        orders.append(list(order))
        seen.append(np.stack(steps, 1))
        for i, f in enumerate(order):
            total[:, f] += steps[i][:, 0]
        at = next(places, None)
        if at is None:
            return orders, np.stack(seen, 1), total
        order[at], order[at + 1] = order[at + 1], order[at]
        before[at + 1] = before[at] | 1 << order[at]
        for i in (at, at + 1):
            steps[i] = removed(before[i], order[i])


def audit(cells: DataFrame, names: str) -> DataFrame:
    """Every order of the filters ``names`` by part, step by step."""
    k = len(names)
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**k entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PARTS):
                some = batch.slice(begin, PARTS)
                held = np.zeros((some.num_rows, 1 << k, 3), np.int64)
                for p, entries in enumerate(some.column("cells").to_pylist()):
                    for e in entries:
                        held[p, e["mask"]] = e["n"], e["good"], e["toxic"]
                orders, gone, total = walk(held, k)
                own = np.array(orders)
                masks = np.arange(1 << k)
                fails = np.stack([held[:, masks >> f & 1 == 1, 0].sum(1) for f in range(k)], 1)
                removed = gone[..., 0]
                columns = {
                    "kept": held[..., 0].sum(1)[:, None, None] - removed.cumsum(2), "removed": removed, "redundant": fails[:, own] - removed, "unique_fails": held[:, 1 << np.arange(k), 0][:, own],
                    "good_lost": gone[..., 1], "toxic_lost": gone[..., 2], "shapley": total[:, own],
                }
                n, each = some.num_rows, len(orders) * k
                spelled = pa.array(["".join(names[f] for f in o) for o in orders for _ in range(k)])
                yield pa.RecordBatch.from_arrays([
                    some.column("part").take(pa.array(np.repeat(np.arange(n), each))), spelled.take(pa.array(np.tile(np.arange(each), n))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders))),
                    *(pa.array(c.reshape(-1)) for c in columns.values()),
                ], ["part", "filter_order", "step", *columns])

    return listed.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by source."""
    ws = Workspace(spark, "audit")
    cells = mask_cells(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), 4, ws)
    return audit(cells, "ABCDE")


OP11_SQL = r"""
WITH RECURSIVE base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
masks AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM base),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, letters WHERE NOT contains(o, f)),
steps AS (SELECT o, s.step, l.f, l.bit, coalesce((SELECT sum(bit) FROM letters x WHERE contains(o[1:s.step - 1], x.f)), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s, letters l WHERE length(o) = 5 AND l.f = o[s.step]),
counted AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM steps, cells GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
