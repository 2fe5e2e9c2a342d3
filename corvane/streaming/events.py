"""Event streams: windowed counts, deduplication and upserts with late data, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.storage import finished, remove


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and mean value per day and type; on a stream, days close once the watermark has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    out = w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of rows with the same event_id; state is dropped after the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def _manifest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, int]]:
    """Number of the last manifest (-1: none), how many buckets there are, and which generation holds each bucket with rows."""
    found = finished(spark, path, "manifest-")
    if not found:
        return -1, 0, {}
    rows = spark.read.parquet(f"{path}/manifest-{found[-1]}").collect()  # a row a bucket at most
    return found[-1], rows[0].buckets if rows else 0, {r.bucket: r.generation for r in rows}


def _rows_in(spark: SparkSession, path: str, where: dict[int, int], buckets: list[int]) -> DataFrame | None:
    folders = [f"{path}/generation-{where[b]}/bucket={b}" for b in buckets if b in where]
    return spark.read.parquet(*folders) if folders else None


def held_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``upsert_sink`` holds; None before the first row."""
    _, _, where = _manifest(spark, path)
    return _rows_in(spark, path, where, sorted(where))


def upsert_sink(path: str, key: str, order: str, keep: int = 2, buckets: int = 64):
    """A foreachBatch function: each batch replaces the rows of its keys unless the held row is later by ``order``.

    Rows are held in buckets by a hash of their key. A batch rewrites the buckets of its keys alone, as a new generation;
    then a manifest says which generation holds which bucket, so a failure in between leaves the last one in force.
    What none of the last ``keep`` manifests names is removed. A batch that is given again changes nothing. A new
    checkpoint goes on from the rows that are held. The first batch fixes the number of buckets.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last, fixed, where = _manifest(spark, path)
        count = fixed or buckets
        bucket = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
        batch = batch.persist()
        try:
            touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
            if not touched:
                return
            held = _rows_in(spark, path, where, touched)
            rows = batch if held is None else held.unionByName(batch)
            best = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
            best.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/generation-{last + 1}")
        finally:
            batch.unpersist()
        now = where | dict.fromkeys(touched, last + 1)
        spark.createDataFrame([(b, g, count) for b, g in now.items()], "bucket int, generation int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{last + 1}")
        if keep:
            _sweep(spark, path, keep)

    return write


def _sweep(spark: SparkSession, path: str, keep: int) -> None:
    """Remove manifests but the last ``keep``, and generations that none of these name."""
    manifests = finished(spark, path, "manifest-")
    for old in manifests[:-keep]:
        remove(spark, f"{path}/manifest-{old}")
    named = {r.generation for m in manifests[-keep:] for r in spark.read.parquet(f"{path}/manifest-{m}").select("generation").distinct().collect()}
    for g in finished(spark, path, "generation-"):
        if g not in named:
            remove(spark, f"{path}/generation-{g}")
