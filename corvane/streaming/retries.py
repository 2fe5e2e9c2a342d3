"""When to look again for a text: a marker of a vain search is a session window of its paper, and expires in event time.

Rows (doi, found, at) tell of searches. A search in vain marks its paper for ``days``; the paper is due for another look
when these are over and nothing newer was heard of it, whether found or not. What comes out doesn't depend on how rows are
cut into batches, as long as they arrive in order of time, give or take the watermark's delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def due_again(searches: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(doi, due): papers of a stream (doi, found, at) whose marker has expired, as soon as the watermark passes its end.

    Searches that follow each other within ``days`` are one session; it ends as the last one's marker does. Of two searches
    at once the one that found something counts.
    """
    rows = searches.select(F.col("doi").cast("string").alias("doi"), F.coalesce("found", F.lit(False)).alias("found"), F.timestamp_millis(F.unix_millis("at")).alias("at")).filter("doi IS NOT NULL AND at IS NOT NULL")
    sessions = rows.withWatermark("at", late).groupBy("doi", F.session_window("at", f"{24 * days} hours").alias("s"))  # hours: a day may have 23
    last = sessions.agg(F.max(F.struct("at", "found")).alias("last"))
    return last.filter(~F.col("last.found")).select("doi", F.col("s.end").alias("due"))


def with_timers(spark: SparkSession) -> None:
    """Keep the state on disk: there is an open session for each paper, too many for an executor's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
