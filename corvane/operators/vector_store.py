"""Vectors of papers, built in batches that are committed one by one: an interrupted run goes on behind the last one.

A store is a folder of ``batch=<n>`` tables (doi, vector, chunk_text), one for a model (``ranking.store_name``); a batch
counts once Spark has committed it, so the folder is its own manifest. Papers that are gone leave the store when it is read
and are removed when it is next compacted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.ranking import embed_papers
from corvane.operators.storage import finished, remove, stored

SCHEMA = "doi string, vector array<float>, chunk_text string, batch int"


class VectorStore:
    """The vectors of one model."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        return finished(self.spark, self.path, "batch=")

    def held(self) -> DataFrame:
        """(doi, vector, chunk_text): all that is held, the latest of a DOI."""
        found = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(StructType.fromDDL(SCHEMA)).option("basePath", self.path).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("doi").agg(F.max_by(F.struct("vector", "chunk_text"), "batch").alias("r")).select("doi", "r.*")

    def vectors(self, papers: DataFrame) -> DataFrame:
        """The vectors of papers (doi) that are still wanted and were made from a text."""
        return self.held().filter("chunk_text <> ''").join(papers.select("doi").distinct(), "doi", "left_semi")

    def build(self, papers: DataFrame, embed: Callable[[list[str]], np.ndarray], size: int = 100_000, progress: Callable[[int, int], None] | None = None) -> int:
        """Embed the papers (doi, chunks) that aren't held, about ``size`` at a time; how many batches it took."""
        todo = stored(papers.filter("size(chunks) > 0").select("doi", "chunks").join(self.vectors(papers).select("doi"), "doi", "left_anti"), "to-embed")
        parts = -(-todo.count() // size)
        number = max(self.batches(), default=-1) + 1
        for k in range(parts):
            part = todo.filter(F.pmod(F.xxhash64("doi"), F.lit(parts)) == k)
            embed_papers(part, embed).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={number + k}")
            if progress:
                progress(k + 1, parts)
        return parts

    def compact(self, papers: DataFrame) -> None:
        """One batch of just the wanted vectors instead of many."""
        old = self.batches()
        if old:
            self.vectors(papers).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={old[-1] + 1}")
            for b in old:
                remove(self.spark, f"{self.path}/batch={b}")
