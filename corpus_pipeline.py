"""A corpus from raw documents to token ids, in five stages.

Toxic documents go; lines that many documents share stay once; one document of each group of near-duplicates
stays; documents that hold benchmark passages go; what is left is encoded, decoded and handed on with its ids.
Each stage but the last returns the columns of ``documents``. ``run`` writes each stage as Parquet to the shared
folder and reads it again, so that a lost executor costs the stage it worked on and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import encode_documents
from corvane.llm.chat import tokenizer_file
from corvane.llm.common import Workspace, table, unused
from corvane.llm.decontaminate import drop_contaminated
from corvane.llm.line_dedup import dedup_lines
from corvane.llm.minhash import keep_one
from corvane.llm.toxicity import drop_toxic

#: Stages that learn from labels cannot be put in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in a later one; n_chars follows the text. Columns keep their values whatever their names."""
    own = {c: unused(f"own_{c}", docs) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    name = unused("kept", docs)
    kept = dedup_lines(docs.withColumnsRenamed(own), text_name=name)
    text = F.when(F.col("text").isNull() & (F.col("n_dropped") == 0), F.col("text")).otherwise(F.col(name))
    named = {c: F.col(n) for c, n in own.items()} | {"text": text}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(F.col("n_dropped") > 0, F.length(name).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*(named[c].alias(c) if c in named else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and hashes of the ids and of the text they decode to."""
    return encode_documents(docs, tokenizer_file())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
