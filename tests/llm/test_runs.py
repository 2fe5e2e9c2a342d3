"""Runs of line hashes leave nothing behind, whatever happens."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import line_dedup
from corvane.llm.common import Workspace


def held(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("corvane_lines_")]


@pytest.mark.parametrize("at", [1, 2, 4])
def test_a_failure_leaves_no_table_behind(spark, monkeypatch, at):
    docs = spark.createDataFrame([(i, f"a line that is long enough to be counted as one {i % 3}") for i in range(30)], "doc_id long, text string")
    real, calls = line_dedup.LineRuns._write, []

    def failing(self, df):
        calls.append(1)
        if len(calls) == at:
            df = df.withColumn("n_docs", F.raise_error(F.lit("a lost disk")).cast("long"))
        return real(self, df)

    monkeypatch.setattr(line_dedup.LineRuns, "_write", failing)
    with pytest.raises(Exception, match="a lost disk"):
        line_dedup.dropped_lines(docs, Workspace(spark, "test"), 40, 5, 4)
    assert held(spark) == []
    monkeypatch.setattr(line_dedup.LineRuns, "_write", real)
    assert line_dedup.dropped_lines(docs, Workspace(spark, "test"), 40, 5, 4).count() == 27 and held(spark) == []
