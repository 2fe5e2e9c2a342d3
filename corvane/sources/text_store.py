"""Full texts by DOI: stored in generations of buckets, replaced by DOI, looked up without reading the rest.

Each call of ``store`` writes one generation, a folder of buckets by a hash of the DOI; it counts once Spark has
committed it. Of several rows of a DOI the one of the latest generation is in force. A look-up reads only the buckets its
DOIs fall into. ``compact`` gathers what is in force in a new generation before it removes the old ones, so a reader
finds every text at any moment, and one that is interrupted can be called again. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators.storage import finished, remove

FIELDS = "doi string, text string, source string, url string, license string, version string, scope string"


def bucket_of(doi: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doi), F.lit(buckets)).cast("int")


class TextStore:
    """Texts in a folder of a shared file system; ``buckets`` stays the same for as long as the folder lives."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def generations(self) -> list[int]:
        return finished(self.spark, self.path, "generation=")

    def store(self, texts: DataFrame) -> None:
        """Put in texts (doi and any of FIELDS); they replace what is held of their DOIs. Of several rows of a DOI the one with the greatest text stays; rows without a DOI are left out."""
        columns = StructType.fromDDL(FIELDS)
        rows = texts.filter("doi IS NOT NULL").select(*((F.col(f.name) if f.name in texts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns))
        names = [f.name for f in columns if f.name != "doi"]
        once = rows.groupBy("doi").agg(F.max(F.struct(*names)).alias("r")).select("doi", "r.*")
        self._write(once)

    def _write(self, rows: DataFrame) -> int:
        number = max(self.generations(), default=-1) + 1
        dealt = rows.withColumn("bucket", bucket_of(F.col("doi"), self.buckets)).repartition("bucket")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/generation={number}")
        return number

    def rows(self) -> DataFrame:
        """All rows of all generations, with ``generation`` and ``bucket``."""
        schema = StructType.fromDDL(f"{FIELDS}, generation int, bucket int")
        found = [f"{self.path}/generation={g}" for g in self.generations()]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        """What is in force, one row a DOI."""
        return self._latest(self.rows())

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """The texts of wanted DOIs (doi), read from their buckets alone; DOIs without a text have no row."""
        buckets = sorted(r.b for r in wanted.select(bucket_of(F.col("doi"), self.buckets).alias("b")).distinct().collect() if r.b is not None)  # at most as many as there are buckets
        found = self.rows().filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return self._latest(found.join(wanted.select("doi").distinct(), "doi", "left_semi"))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        names = [f.name for f in StructType.fromDDL(FIELDS) if f.name != "doi"]
        return rows.groupBy("doi").agg(F.max_by(F.struct(*names), "generation").alias("r")).select("doi", "r.*")

    def compact(self) -> None:
        """One generation instead of many."""
        old = self.generations()
        if len(old) > 1:
            self._write(self.texts())
            for g in old:
                remove(self.spark, f"{self.path}/generation={g}")
