"""The log of a sweep as a stream: answers arrive, are screened batch by batch, and each batch is appended exactly once.

The log is a folder: ``rows/batch=<n>`` holds what batch n added, ``progress`` is the stream's checkpoint, so both are
kept or lost together. A batch is written whole to its own folder, replacing what an earlier try left there; what it
adds depends on earlier batches alone, so that trying again gives the same rows. A paper that already has a row with
text gets none without: late texts upgrade a paper, and nothing downgrades it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def logged(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of a log with ``seq``, the batch that added them; None before there are any."""
    try:
        rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").withColumnRenamed("batch", "seq")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    rows = rows.withColumn("seq", F.col("seq").cast("long"))
    return rows if before is None else rows.filter(F.col("seq") < before)


def sink(path: str, screen: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; ``screen`` turns a batch of answers into rows with doi and has_text, one a paper."""

    def write(batch: DataFrame, number: int) -> None:
        rows = screen(batch)
        held = logged(batch.sparkSession, path, number) if number else None
        if held is not None:
            have = held.filter("has_text").select("doi").distinct().withColumn("_have", F.lit(True))
            rows = rows.join(have, "doi", "left").filter("has_text OR _have IS NULL").drop("_have")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/batch={number}")

    return write


def run(answers: DataFrame, path: str, screen: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Work off all answers that are there and stop; the next call goes on behind them, also after a failure."""
    query = answers.writeStream.foreachBatch(sink(path, screen)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def arriving(spark: SparkSession, path: str, schema: str | StructType, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, ``files`` a batch at most."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
