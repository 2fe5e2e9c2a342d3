"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is toxic if one of its sentences is: P(doc) = 1 - prod(1 - p(sentence)), p a logistic score of the
sentence's words and word beginnings. Only document labels exist, so the gradient of the noisy-or assigns the
blame to sentences; afterwards the sentences with high p are the offending ones. The model is fitted on a bounded
sample of labelled rows (``max_positive`` and ``max_negative``, 12,000 texts at most, chosen by a hash of the id).
Tasks count in how many documents of each class a feature stands and read the sentences that hold one of the few
features that tell the classes apart; the driver gets these counts and features, and no texts. Scoring covers every
whole text.

Empty and null texts have no sentence and score 0. Where no label is usable, every score is close to 0. Several label
rows of one document count as toxic if any is; repeated documents are scored each by itself, and the sample takes one
row of each id, the one with the least hash of its text. Empty tables give no rows. Further columns of the documents
don't reach a score; ``drop_toxic`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import _BASE, _BYTE, _LOWER, LETTERS, Workspace, flat_bytes, grouped, id_remainder, mix64, small_batches, table

BITS = 20
#: Bytes of text that a worker reads at once.
BATCH = 1 << 20
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 63]] = True  # newline ! . ?


@dataclass
class Sentences:
    """Features of the sentences of some rows; words are in order, ``word_sentence`` never falls."""

    features: np.ndarray  # one row a word: its own feature and that of each beginning it has, else -1
    word_sentence: np.ndarray
    row: np.ndarray  # of each sentence
    start: np.ndarray  # of each sentence, in bytes of the row
    end: np.ndarray


def featurize(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Split all rows into sentences and hash their words and word beginnings."""
    none = np.zeros(0, np.int64)
    inside = LETTERS[data]
    start = inside.copy()
    first = offsets[:-1][np.diff(offsets) > 0]
    if len(data):
        start[1:] &= ~inside[:-1]
        start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return Sentences(np.zeros((0, len(BEGINNINGS) + 1), np.int32), none, none, none, none)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:] = _END[data]
    cut[first] = True
    part = np.cumsum(cut[:-1])[starts]
    new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sentence = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1
    letters = _LOWER[data[inside]]
    at = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.cumsum(_BYTE[letters] * powers[place])
    before = np.where(at > 0, sums[at - 1], 0).astype(np.uint64)
    features = np.full((len(starts), len(BEGINNINGS) + 1), -1, np.int32)
    shift = np.uint64(64 - BITS)
    features[:, 0] = (mix64(sums[at + lengths - 1] - before) >> shift).astype(np.int32)
    for j, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(lengths > n)
        features[longer, j] = (mix64(sums[at[longer] + n - 1] - before[longer] + np.uint64(n)) >> shift).astype(np.int32)
    row = np.searchsorted(offsets, starts[new], side="right") - 1
    last = np.append(new[1:], len(starts)) - 1
    return Sentences(features, sentence, row, starts[new] - offsets[row], starts[last] + lengths[last] - offsets[row])


@dataclass
class Model:
    """Weights by feature; a sentence's score is logistic(bias + the sum of its words' largest weights)."""

    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        if not len(s.row):
            return np.zeros(0)
        padded = np.append(self.weights, 0.0)
        words = padded[s.features].sum(1)
        z = self.bias + np.bincount(s.word_sentence, words, len(s.row))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - p) by row; 0 for rows without sentences."""
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


@dataclass
class Sample:
    """What is left of labelled texts for training: for each, its label and how many sentences hold no chosen feature; for the others, the features."""

    label: np.ndarray  # of each document
    plain: np.ndarray  # of each document
    row: np.ndarray  # the document of each sentence that holds chosen features
    feature: np.ndarray  # one entry a chosen feature in a sentence
    sentence: np.ndarray


def choose(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> tuple[np.ndarray, np.ndarray]:
    """Features that more toxic documents hold than chance explains, and how many times likelier they are in these."""
    share = (pos / n_pos) / ((neg + 0.5) / n_neg)
    usual = (neg + 1) * (n_pos / n_neg)  # what toxic documents would hold if they were like clean ones
    chosen = np.flatnonzero((pos >= 2) & (share > 3) & (pos - usual > 2 * np.sqrt(usual + 0.5)))
    return chosen, share[chosen]


def fit(s: Sample, start: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and the bias, by gradient of the noisy-or likelihood (Adam, ridge)."""
    n_rows, n_sent = len(s.label), len(s.row)
    # the sentences of a document without chosen features are alike: one entry stands for all of them
    row, times = np.append(s.row, np.arange(n_rows)), np.append(np.ones(n_sent), s.plain)
    w, b = np.log(start) * 0.2, -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(b + np.append(np.bincount(s.sentence, w[s.feature], n_sent), np.zeros(n_rows)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        doc = np.clip(-np.expm1(np.bincount(row, times * np.log1p(-np.minimum(p, 1 - 1e-12)), n_rows)), 1e-9, 1 - 1e-9)
        # d loss / d z: p for a clean document, -p (1 - P) / P for a toxic one
        g = times * np.where(s.label[row] > 0, -p * ((1 - doc) / doc)[row], p) / n_rows
        gw = np.bincount(s.feature, g[s.sentence], len(w)) + 2e-6 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-9)
        b = b - 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    return w, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> DataFrame:
    """(doc_id, b, y) of labelled rows: at most so many ids of each class, the smallest by a hash of the id, one row an id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter(id_remainder(F.col("doc_id"), 3) != 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("y = 1").orderBy(*order).limit(max_positive).unionAll(known.filter("y = 0").orderBy(*order).limit(max_negative))
    small = docs.sparkSession.createDataFrame(sorted(map(tuple, chosen.collect())), "doc_id long, y int")
    # 12,000 ids at most: a broadcast of that bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("b")).join(F.broadcast(small), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("b"), F.length("b"))
    return rows.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_negative: int = 8000) -> Model:
    """Fit on labelled rows of ``docs``; the result depends on the texts and labels alone."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "toxicity")
    try:
        return _trained(ws.save(labelled_sample(docs, labels, max_positive, max_negative), "sample"))
    finally:
        ws.keep()


def _trained(rows: DataFrame) -> Model:
    """The model of a sample (doc_id, b, y)."""
    n_pos, n_all = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    weights = np.zeros(1 << BITS)
    if n_pos in (0, n_all):
        return Model(weights, -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, all_ = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for t in grouped(batches, BATCH):
            s, y = featurize(*flat_bytes(t.column("b"))), t.column("y").to_numpy()
            held = np.unique(s.features.astype(np.int64) * t.num_rows + s.row[s.word_sentence][:, None])
            held = held[held >= 0]
            all_ += np.bincount(held // t.num_rows, minlength=1 << BITS).astype(np.int32)
            pos += np.bincount(held // t.num_rows, y[held % t.num_rows], 1 << BITS).astype(np.int32)
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(pos[some]), pa.array(all_[some])], ["feature", "pos", "n"])

    held = rows.mapInArrow(count, "feature int, pos int, n int").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter("pos >= 2").toArrow()
    pos, neg, at = np.zeros(1 << BITS), np.zeros(1 << BITS), held.column("feature").to_numpy()
    pos[at] = held.column("pos").to_numpy()
    neg[at] = held.column("n").to_numpy() - pos[at]
    chosen, start = choose(pos, neg, float(n_pos), float(n_all - n_pos))
    if not len(chosen):
        return Model(weights, float(np.log(n_pos / (n_all - n_pos))) - 3)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full((1 << BITS) + 1, -1, np.int32)
        index[chosen] = np.arange(len(chosen))
        for t in grouped(batches, BATCH):
            s = featurize(*flat_bytes(t.column("b")))
            kept = index[s.features]
            word, column = np.nonzero(kept >= 0)
            sentence = s.word_sentence[word]
            row = s.row[sentence]
            cuts = np.append(0, np.cumsum(np.bincount(row, minlength=t.num_rows))).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("y").combine_chunks(), pa.array(np.bincount(s.row, minlength=t.num_rows).astype(np.int32)), listed(sentence), listed(kept[word, column])], ["doc_id", "y", "n", "sentence", "feature"])

    read = rows.mapInArrow(keep, "doc_id long, y int, n int, sentence array<int>, feature array<int>").toArrow().sort_by("doc_id").combine_chunks()
    sentence, feature = (read.column(c).combine_chunks() for c in ("sentence", "feature"))
    row = np.repeat(np.arange(len(sentence)), np.diff(sentence.offsets.to_numpy()))
    flat = sentence.flatten().to_numpy()
    new = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])) if len(flat) else np.zeros(0, dtype=bool)
    plain = read.column("n").to_numpy() - np.bincount(row[new], minlength=len(sentence))
    w, bias = fit(Sample(read.column("y").to_numpy(), plain, row[new], feature.flatten().to_numpy(), np.cumsum(new) - 1), start)
    weights[chosen] = w
    return Model(weights, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences, n_offending (sentences with p of 0.5 or more), and the worst sentence's place in code points."""
    small_batches(docs.sparkSession)
    nonzero = np.flatnonzero(model.weights)
    packed = (nonzero, model.weights[nonzero], model.bias)  # the few features kept: of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[packed[0]] = packed[1]
        own = Model(weights, packed[2])
        for t in grouped(batches, BATCH):
            data, offsets = flat_bytes(t.column("b"))
            s, n = featurize(data, offsets), t.num_rows
            p = own.sentence_scores(s)
            score = np.clip(noisy_or(p, s.row, n), 0.0, 1.0)
            worst = np.full(n, -1)
            order = np.lexsort((-s.start, p, s.row))
            worst[s.row[order]] = order  # the last of each row: highest p, first such
            begin, end = [], []
            for i, k in enumerate(worst):
                if k < 0 or p[k] < 0.5:
                    begin.append(None)
                    end.append(None)
                else:
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    begin.append(len(raw[: s.start[k]].decode("utf-8", "ignore")))
                    end.append(len(raw[: s.end[k]].decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").combine_chunks(), pa.array(score), pa.array(np.bincount(s.row, minlength=n).astype(np.int64)), pa.array(np.bincount(s.row, p >= 0.5, n).astype(np.int64)), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_end"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("b")).mapInArrow(run, "doc_id long, score double, n_sentences long, n_offending long, worst_start long, worst_end long")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from those whose crc32 remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; a filter in place, no join and no shuffle of texts."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    nonzero = np.flatnonzero(model.weights)
    packed = (nonzero, model.weights[nonzero], model.bias)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[packed[0]] = packed[1]
        own = Model(weights, packed[2])
        for t in grouped(batches, BATCH):
            data, offsets = flat_bytes(t.column(at).cast(pa.binary()))
            s = featurize(data, offsets)
            clean = noisy_or(own.sentence_scores(s), s.row, t.num_rows) < threshold
            yield from t.filter(pa.array(clean)).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)
