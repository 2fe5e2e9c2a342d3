"""Language identification, words first: known words by their log frequency in each language, unseen words by ever shorter character n-grams.

All training texts are counted, by built-in functions: words by language, and from these counts the n-grams of 1 to 5
characters of the words between boundary marks. An entry (a word, or an n-gram of one length) is known if some language
has it at least twice and with at least a 2**-18 share of all its words, or of its n-grams of that length: a language
has at most 2**18 known entries of a kind, however large the corpus, so the model is bounded by the number of languages
and the driver may hold it. A known entry keeps its counts in all languages.

A document adds up, over its words, the log frequency of the word in each language; a word that isn't known counts the
mean log frequency of its known 5-grams, or if it has none of its known 4-grams, and so on down to single characters;
one without any known n-gram says nothing. With the log of each language's share of training documents this gives the
prediction and its posterior probability, the score. Ties go to the smaller name.

A word is a letter with the letters and marks after it, lower-cased, in pieces of 64 characters. Null texts and texts
without a letter are `und` with score 0, and so is everything where nothing can be learned. Empty strings are languages
like others; null ones teach nothing. Repeated documents count, and come back, each. An empty table gives no rows.
Further columns don't matter; lang, source and doc_id never reach a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, grouped, id_remainder, small_batches, table

WORD = r"\p{L}[\p{L}\p{M}]{0,63}"
LONGEST = 5
SHARE = 2.0**-18
#: Added to every count.
SMOOTH = 0.5
BATCH = 1 << 22


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORD), F.lit(0))


def counted(texts: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, n, entry, c): how often each word (n = 0) and n-gram stands in a language; ``texts`` has lang and words."""
    words = ws.save(texts.select("lang", F.explode("words").alias("entry")).groupBy("lang", "entry").agg(F.count("*").alias("c")), "words")
    marked = F.concat(F.lit("<"), F.col("entry"), F.lit(">"))
    # a word of m characters has m + 2 with its marks, and so m + 3 - n grams of length n
    places = F.expr(f"flatten(transform(sequence(1, least({LONGEST}, length(entry) + 2)), n -> transform(sequence(1, length(entry) + 3 - n), k -> struct(n, k))))")
    grams = words.select("lang", "c", marked.alias("m"), F.explode(places).alias("at")).select("lang", F.col("at.n").alias("n"), F.expr("substring(m, at.k, at.n)").alias("entry"), "c").filter("entry NOT IN ('<', '>')")
    summed = grams.groupBy("lang", "n", "entry").agg(F.sum("c").alias("c"))
    return ws.save(words.select("lang", F.lit(0).alias("n"), "entry", "c").unionAll(summed), "entries")


@dataclass
class Model:
    """Known entries of each length with their counts by language, and the totals of each language."""

    langs: list[str]
    prior: np.ndarray  # log share of training documents
    entries: list[pa.Array]  # by length; 0: words
    starts: list[np.ndarray]  # where the counts of an entry begin
    lang: list[np.ndarray]
    extra: list[np.ndarray]  # log((c + s) / s): what a count adds to the log frequency of an unseen entry
    floor: list[np.ndarray]  # by language: log frequency of an unseen entry

    def frequencies(self, n: int, at: np.ndarray) -> np.ndarray:
        """Log frequency by language of the entries ``at`` of length n."""
        out = np.tile(self.floor[n], (len(at), 1))
        size = self.starts[n][at + 1] - self.starts[n][at]
        row = np.repeat(np.arange(len(at)), size)
        where = np.repeat(self.starts[n][at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[row, self.lang[n][where]] += self.extra[n][where]
        return out

    def evidence(self, words: pa.Array) -> np.ndarray:
        """What each of some distinct words says of each language."""
        out = np.zeros((len(words), len(self.langs)))
        at = _places(words, self.entries[0])
        known = at >= 0
        out[known] = self.frequencies(0, at[known])
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            marked = [f"<{w}>" for w in words.take(pa.array(left)).to_pylist()]
            counts = np.array([max(len(w) + 1 - n, 0) for w in marked])
            at = _places(pa.array([w[k : k + n] for w in marked for k in range(len(w) + 1 - n)], pa.string()), self.entries[n])
            row = np.repeat(np.arange(len(left)), counts)[at >= 0]
            found = np.bincount(row, minlength=len(left))
            f = self.frequencies(n, at[at >= 0])
            for k in range(len(self.langs)):
                out[left, k] = np.bincount(row, f[:, k], len(left)) / np.maximum(found, 1)
            left = left[found == 0]
        return out


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


def train(docs: DataFrame) -> Model | None:
    """Count all rows of ``docs`` (text, lang); None if they teach nothing."""
    ws = Workspace(docs.sparkSession, "language")
    try:
        texts = docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), words_of(F.col("text")).alias("words"))
        entries = counted(texts, ws)
        totals = ws.save(entries.groupBy("lang", "n").agg(F.sum("c").alias("total")), "totals")
        known = F.max((F.col("c") >= 2) & (F.col("c") >= F.col("total") * SHARE))
        held = entries.join(totals, ["lang", "n"]).groupBy("n", "entry").agg(F.collect_list(F.struct("lang", "c")).alias("counts"), known.alias("known")).filter("known").drop("known").toArrow()
        sums = totals.toArrow().to_pylist()
        rows = {r["lang"]: r["rows"] for r in docs.filter("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("rows")).toArrow().to_pylist()}
    finally:
        ws.keep()
    return assemble(held, sums, rows)


def assemble(held: pa.Table, sums: list[dict], rows: dict[str, int]) -> Model | None:
    """The model of known entries (n, entry, counts), totals (lang, n, total) and training documents by language."""
    langs = sorted({s["lang"] for s in sums if s["n"] == 0})
    if not langs or not held.num_rows:
        return None
    number = {x: k for k, x in enumerate(langs)}
    share = np.array([rows[x] for x in langs], float)
    model = Model(langs, np.log(share / share.sum()), [], [], [], [], [])
    for n in range(LONGEST + 1):
        some = held.filter(pc.equal(held.column("n"), n)).combine_chunks()
        counts = pa.concat_arrays(some.column("counts").chunks) if some.num_rows else pa.array([], held.schema.field("counts").type)
        flat = counts.flatten()
        names = flat.field("lang").dictionary_encode()
        which = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)
        total = np.zeros(len(langs))
        for s in sums:
            if s["n"] == n:
                total[number[s["lang"]]] = s["total"]
        c = flat.field("c").to_numpy(zero_copy_only=False).astype(float)
        model.entries.append(pa.concat_arrays(some.column("entry").chunks) if some.num_rows else pa.array([], pa.string()))
        model.starts.append(np.concatenate([[0], np.cumsum(pc.list_value_length(counts).to_numpy(zero_copy_only=False))]).astype(np.int64))
        model.lang.append(which[names.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64))
        model.extra.append(np.log((c + SMOOTH) / SMOOTH))
        model.floor.append(np.log(SMOOTH / (total + SMOOTH * (some.num_rows + 1))))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.langs, "und"])
        for t in grouped(batches, BATCH):
            lists = t.column("words").combine_chunks()
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            said = model.evidence(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(t.num_rows), length)
            z = model.prior + np.stack([np.bincount(row, said[:, k], t.num_rows) for k in range(len(model.langs))], 1)
            best = z.argmax(1)
            score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
            best[length == 0] = len(model.langs)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), names.take(pa.array(best)), pa.array(np.where(length == 0, 0.0, score))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(id_remainder(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return predict(docs, model).select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
