"""Recall of the neighbour search against brute force and held-out accuracy of toxicity, on tables small enough for one machine.

python -m corvane.llm.measure FOLDER...
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table
from corvane.llm.neighbours import op9_neighbours
from corvane.llm.toxicity import op3_toxicity


def neighbour_recall(spark: SparkSession, folder: str, k: int = 20) -> tuple[int, int, float]:
    """(vectors, queries, share of the true ``k`` nearest found); every vector is compared with every query."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding").toArrow()
    listed = [(i, v) for i, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in listed]), np.array([v for _, v in listed], float)
    found: dict[int, set[int]] = {}
    for r in op9_neighbours(spark, folder).select("query_id", "vec_id").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]].tolist())
        hits, total = hits + len(best & found.get(ids[q], set())), total + len(best)
    return len(ids), len(found), hits / max(total, 1)


def toxicity_held_out(scored: DataFrame, labels: DataFrame) -> tuple[int, int, int, int]:
    """(toxic documents found, toxic documents, clean documents flagged, clean documents) among labelled ones that training didn't see."""
    rows = scored.filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id")
    return tuple(rows.agg(*(F.count_if(F.expr(e)) for e in ("toxic = 1 AND predicted = 1", "toxic = 1", "toxic = 0 AND predicted = 1", "toxic = 0"))).first())


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        print(folder, "neighbours: %d vectors, %d queries, recall %.3f" % neighbour_recall(spark, folder))
        print(folder, "toxicity, held out: %d of %d toxic found, %d of %d clean flagged" % toxicity_held_out(op3_toxicity(spark, folder), table(spark, folder, "labels")))
    spark.stop()


if __name__ == "__main__":
    main()
