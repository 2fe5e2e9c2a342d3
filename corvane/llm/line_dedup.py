"""Line deduplication with levelled sorted runs of line hashes; DataFrame operations only.

``LineRuns`` keeps, per line hash, how many documents hold the line and the largest id among them. Each batch is
reduced to one row a hash and merge-anti-joined with the runs: only hashes that no run holds become its own run, of
level 0, so runs never share a hash. The hashes that a run does hold go to a side table of repeats, which is small,
since most lines stand in one document. When a level has ``fanout`` runs they are merged into one of the next level, so
a hash is rewritten O(log batches) times and a lookup meets O(log batches) runs. Runs are tables bucketed and sorted by
the hash: lookups and merges exchange the batch and no run. Hashes are 128 bits (two 64-bit hashes with different
seeds).

A line's key is the line without white space at both ends, A-Z lower-cased. Null and empty texts are one empty
line. Null ids count no document and lose every line that is dropped elsewhere. Rows with the same doc_id are one
document; equal rows get equal results. Tables without rows give no rows. Columns of the documents named ``n_lines``,
``n_dropped`` or as the kept text are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, ascii_lower, table, unused

#: Batches that the corpus is added in; a document's rows are all in one batch.
BATCHES = 4
#: Lines of the corpus for each bucket of a run.
BUCKET_LINES = 500_000
_BLANK = "\t\n\x0b\f\r "
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The key of a line."""
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def text_lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text hash, position, h1, h2) of every line whose key has ``min_chars`` code points."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = keyed.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("corvane"), "key").alias("h2"))


class LineRuns:
    """A levelled index of line hashes with document counts."""

    def __init__(self, workspace: Workspace, buckets: int, fanout: int = 2) -> None:
        self.ws, self.spark, self.buckets, self.fanout = workspace, workspace.spark, buckets, fanout
        self.levels: dict[int, list[str]] = {}
        self.repeats: list[DataFrame] = []
        self.name, self.made = f"corvane_lines_{uuid.uuid4().hex[:12]}", 0
        self.tables: set[str] = set()  # all that stand in the catalog, finished or not

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        self.tables.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd").option("path", f"{self.ws.root}/{name}")
        writer.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.ws.drop(name)
        self.tables.discard(name)

    def runs(self) -> list[DataFrame]:
        """All runs, of which no two hold the same hash."""
        return [self.spark.table(name) for level in sorted(self.levels) for name in self.levels[level]]

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc_id, h1, h2)."""
        own = lines.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        own = self._write(own.repartition(self.buckets, *HASH))  # a bucket a task, so a file a bucket
        runs = self.runs()
        if runs:
            batch = self.spark.table(own)
            fresh, held = batch, None
            for run in runs:
                fresh = fresh.join(run.hint("merge"), HASH, "left_anti")
                found = batch.join(run.hint("merge"), HASH, "left_semi")
                held = found if held is None else held.unionAll(found)
            self.repeats.append(self.ws.save(held, f"repeats-{self.made}"))
            name = self._write(fresh)
            self._drop(own)
            own = name
        self.levels.setdefault(0, []).append(own)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels.pop(level)
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = _merge(merged, self.spark.table(name))
            self.levels[level] = []
            self.levels.setdefault(level + 1, []).append(self._write(merged))
            for name in names:
                self._drop(name)
            level += 1

    def common(self, min_docs: int) -> DataFrame | None:
        """(h1, h2, last_doc) of the hashes that ``min_docs`` documents or more hold."""
        again = None
        for df in self.repeats:
            again = df if again is None else again.unionAll(df)
        out = None
        if again is not None:
            again = again.groupBy(*HASH).agg(F.sum("n_docs").alias("more_docs"), F.max("last_doc").alias("later_doc"))
            again = self.ws.save(again, "repeated")
        for run in self.runs():
            if again is not None:
                run = run.join(again, HASH, "left").select(*HASH, (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later_doc").alias("last_doc"))
            found = run.filter(F.col("n_docs") >= min_docs).select(*HASH, "last_doc")
            out = found if out is None else out.unionAll(found)
        return out

    def close(self) -> None:
        """Remove the runs, also those that a failure left half made."""
        self.levels.clear()
        for name in sorted(self.tables):
            self._drop(name)


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: a merge of both sides bucket by bucket, in which no hash meets its like."""
    value = lambda df, side: df.select(*HASH, F.struct("n_docs", "last_doc").alias(side))
    both = value(a, "x").join(value(b, "y").hint("merge"), HASH, "full_outer").withColumn("v", F.coalesce("x", "y"))
    return both.select(*HASH, "v.n_docs", "v.last_doc")


def dropped_lines(docs: DataFrame, ws: Workspace, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(doc_id, text_hash, dropped): the sorted positions of the lines that each document loses; only documents that lose some."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(batches)).cast("int")
    # sorted by part: a filter by it reads a part of each file
    lines = ws.save(line_table(docs, min_chars).withColumn("part", part).sortWithinPartitions("part"), "lines")
    runs = LineRuns(ws, min(50_000, max(8, -(-lines.count() // BUCKET_LINES))))
    try:
        for k in range(batches):
            runs.add(lines.filter(F.col("part") == k))
        common = ws.save(runs.common(min_docs), "common")
    finally:
        runs.close()
    # both sides are plain exchanges, so a line that a third of all documents holds is split by AQE
    gone = lines.select("doc_id", "text_hash", "pos", "h1", "h2").join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = ws.save(gone.select("doc_id", "text_hash", "pos"), "gone")
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, text_name: str = "kept_text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and the kept text (``text_name``).

    Lines whose key has ``min_chars`` code points or more and is held by ``min_docs`` documents or more stay only
    in the largest doc_id that holds them.
    """
    ws = Workspace(docs.sparkSession, "lines")
    gone = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ws, min_chars, min_docs, batches)
    gone = ws.save(gone, "dropped")
    ws.keep("dropped")  # all that the result reads
    at, hash_, places_, own = (unused(n, docs) for n in ("gone_id", "gone_hash", "gone", "text_hash"))
    gone = gone.select(F.col("doc_id").alias(at), F.col("text_hash").alias(hash_), F.col("dropped").alias(places_))
    hashed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.col(own) == F.col(hash_))
    joined = hashed.join(gone.hint("shuffle_hash"), match, "left")
    lines = text_lines(F.col("text").cast("string"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places_))
    kept = F.when(F.col(places_).isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    made = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(places_), F.lit(0)).cast("long"), text_name: kept}
    return joined.select(*(F.col(c) for c in docs.columns if c.lower() not in {n.lower() for n in made}), *(c.alias(n) for n, c in made.items()))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that 5 documents or more hold stay in the largest doc_id only."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_doc AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
