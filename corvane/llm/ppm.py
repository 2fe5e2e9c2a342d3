"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to five bytes with counts, trained once over all training texts. A byte
is coded in the longest context the trie holds; if it was never seen there, an escape is coded (method D: half a
count for each distinct byte seen, taken from the bytes' own counts) and the next shorter context is tried, without the bytes that longer contexts
have seen (symbol exclusion); below the empty context the remaining bytes are equally likely. A text's score is
the sum of log10 probabilities of its lower-cased bytes and of an end symbol (the byte 0xFF, which UTF-8 lacks).

All (context, byte) pairs of the training texts count, however rare. The six-byte grams stay a distributed table; a
gram seen in training is coded in its own five-byte context, so its log probability needs no other pair. Those of a
2**-22 share or more (at most 2**22) are broadcast, and scoring looks up each distinct gram of a batch once. The
others, rare or unseen, are kept by row: their distinct grams meet the training grams that end in the same three
context bytes, where a trie of these and of all shorter contexts (at most 2**24 pairs, in text far fewer) gives their
probabilities, which are joined to the rows by a shuffle; a gram that many rows ask for is broadcast instead. Since a
shorter context has seen whatever a longer one has, exclusions are sums over pairs and can be worked out once per
context. Beside it stands a base score: add-one unigrams over words. Words of a 2**-18 share or more (at most 2**18)
are broadcast; the others are joined by a shuffle, so no word is hot in it.

Nulls are empty texts: one end token. Without training texts every byte costs log10(256) and the base score is
log10(1) a token. Equal rows are scored each by itself. Null ids count as remainder 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import _LOWER, Workspace, flat_bytes, grouped, id_remainder, small_batches, table

ORDER = 5
#: Rows scored at once; a gram's code and its row must fit one 63-bit number.
ROWS_AT_ONCE = 1 << 14
TRIE_BITS, WORD_BITS = 22, 18
#: Levels that every worker holds whole; longer contexts are dealt out by their last ``SHORT`` bytes.
SHORT = 3
#: Training and asked grams from which tries of longer contexts are made at once, and the share of asked places from which a gram is broadcast.
PAIRS, ASKED_BITS = 300_000, 16
#: Bytes of text that a worker counts or scores at once, and distinct grams it holds while it counts.
BATCH, HELD = 2 << 20, 2_000_000
END = 0xFF


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (five bytes of context, then the byte) of all places of all rows, each row ending in END, and each row's number of places."""
    counts = np.diff(offsets) + 1
    padded = np.full(int(counts.sum()) + ORDER * len(counts), END, np.uint8)
    first = np.cumsum(counts + ORDER) - counts  # each row's first byte
    if len(data):
        place = np.arange(len(data)) + np.repeat(first - offsets[:-1], counts - 1)
        padded[place] = _LOWER[data]
    code = np.zeros(len(padded) - ORDER, np.int64)
    for j in range(ORDER + 1):
        code <<= 8
        code |= padded[j : len(padded) - ORDER + j]
    keep = np.ones(len(code), dtype=bool)
    for j in range(ORDER):  # places whose byte is padding
        keep[first[1:] - ORDER + j - ORDER] = False
    return code[keep], counts


def runs(code: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts or summed weights."""
    if weight is None:
        code = np.sort(code)
    else:
        order = np.argsort(code, kind="stable")
        code, weight = code[order], weight[order]
    if not len(code):
        return code, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[at], np.diff(np.append(at, len(code))) if weight is None else np.add.reduceat(weight, at)


class Trie:
    """Log10 probabilities of bytes after contexts. ``levels[k]``: codes of k context bytes and a byte, ascending, and counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.codes = [np.asarray(c, np.int64) for c, _ in levels]
        self.log_count, self.contexts, self.escape, self.start_escape, self.total = [], [], [], [], []
        summed, distinct = [], []
        for codes, (_, n) in zip(self.codes, levels, strict=True):
            n = np.asarray(n, np.float64)
            at = np.flatnonzero(np.append(True, (codes[1:] >> 8) != (codes[:-1] >> 8))) if len(codes) else np.zeros(0, np.int64)
            self.contexts.append(codes[at] >> 8)
            summed.append(np.add.reduceat(n, at) if len(at) else n)
            distinct.append(np.diff(np.append(at, len(codes))).astype(np.float64))
            self.log_count.append(np.log10(n - 0.5))
            with np.errstate(divide="ignore"):
                self.start_escape.append(np.log10(distinct[-1] / 2 / summed[-1]))
                self.total.append(np.log10(summed[-1]))
        # per context of length k + 1: escape and total of its suffix without the bytes the context has seen
        self.rest_total, self.rest_escape = [], []
        for k in range(len(levels) - 1):
            longer, mask = self.codes[k + 1], (1 << 8 * (k + 1)) - 1
            seen = np.asarray(levels[k][1], np.float64)[np.searchsorted(self.codes[k], longer & mask)]
            at = np.flatnonzero(np.append(True, (longer[1:] >> 8) != (longer[:-1] >> 8))) if len(longer) else np.zeros(0, np.int64)
            own = np.searchsorted(self.contexts[k], self.contexts[k + 1] & (mask >> 8))
            t = summed[k][own] - (np.add.reduceat(seen, at) if len(at) else seen)
            d = distinct[k][own] - distinct[k + 1]
            some = d > 0
            self.rest_total.append(np.log10(np.where(some, t, 1.0)))
            self.rest_escape.append(np.where(some, np.log10(np.where(some, d / 2, 1.0)) - self.rest_total[-1], 0.0))
        self.unseen = -np.log10(max(256 - len(self.codes[0]), 1)) if levels else -np.log10(256)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each code after the bytes before it."""
        out = np.zeros(len(code))
        started = np.zeros(len(code), dtype=bool)
        open_ = np.arange(len(code))  # codes whose byte isn't coded yet
        above = np.zeros(len(code), np.int64)  # the context one byte longer, where coding has started
        for k in range(len(self.codes) - 1, -1, -1):
            if not len(open_):
                break
            c = code[open_] & ((1 << 8 * (k + 1)) - 1)
            if not len(self.codes[k]):
                continue
            ctx = np.minimum(np.searchsorted(self.contexts[k], c >> 8), len(self.contexts[k]) - 1)
            has = self.contexts[k][ctx] == c >> 8
            at = np.minimum(np.searchsorted(self.codes[k], c), len(self.codes[k]) - 1)
            found = has & (self.codes[k][at] == c)
            was = started[open_]
            rest = above[open_]
            if k < len(self.codes) - 1 and len(self.rest_total[k]):
                rest = np.where(was, rest, 0)
                total, escape = np.where(was, self.rest_total[k][rest], self.total[k][ctx]), np.where(was, self.rest_escape[k][rest], self.start_escape[k][ctx])
            else:
                total, escape = self.total[k][ctx], self.start_escape[k][ctx]
            out[open_[found]] += self.log_count[k][at[found]] - total[found]
            missed = has & ~found
            out[open_[missed]] += escape[missed]
            started[open_[has]] = True
            above[open_[has]] = ctx[has]
            open_ = open_[~found]
        out[open_] += self.unseen
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log10 probability of each row's text."""
        rows = len(offsets) - 1
        if rows > ROWS_AT_ONCE:
            cuts = range(0, rows, ROWS_AT_ONCE)
            return np.concatenate([self.scores(data[offsets[a] : offsets[min(a + ROWS_AT_ONCE, rows)]], offsets[a : a + ROWS_AT_ONCE + 1] - offsets[a]) for a in cuts])
        if not rows:
            return np.zeros(0)
        code, counts = grams(data, offsets)
        bits = max(1, (rows - 1).bit_length())
        key = np.sort(code << bits | np.repeat(np.arange(rows), counts))
        gram = key >> bits
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        logs = np.repeat(self.log_probability(gram[at]), np.diff(np.append(at, len(gram))))
        return np.bincount(key & ((1 << bits) - 1), logs, rows)


def look_up(known: np.ndarray, logs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's sum over the grams in ``known`` (ascending) and how many other distinct grams it has; these, row by row, and their counts."""
    rows = len(offsets) - 1
    if rows > ROWS_AT_ONCE:
        cuts = range(0, rows, ROWS_AT_ONCE)
        parts = [look_up(known, logs, data[offsets[a] : offsets[min(a + ROWS_AT_ONCE, rows)]], offsets[a : a + ROWS_AT_ONCE + 1] - offsets[a]) for a in cuts]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    code, counts = grams(data, offsets)
    bits = max(1, (rows - 1).bit_length())
    key = np.sort(code << bits | np.repeat(np.arange(rows), counts))
    gram = key >> bits
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    times = np.diff(np.append(at, len(gram)))
    if len(known):
        place = np.minimum(np.searchsorted(known, gram[at]), len(known) - 1)
        found = known[place] == gram[at]
        own = np.where(found, logs[place], 0.0)
    else:
        found, own = np.zeros(len(at), dtype=bool), np.zeros(len(at))
    row = key & ((1 << bits) - 1)
    sums = np.bincount(row, np.repeat(own, times), rows)
    rest, n = runs(key[np.repeat(~found, times)])
    row = rest & ((1 << bits) - 1)
    order = np.argsort(row, kind="stable")
    return sums, np.bincount(row, minlength=rows), (rest >> bits)[order], n[order]


def _by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Join batches, ordered by the context's last ``SHORT`` bytes, to tables of about ``PAIRS`` rows that part no suffix."""
    held: list[pa.RecordBatch] = []
    rows, limit = 0, PAIRS
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held)
            suffix = t.column("suffix").to_numpy()
            cut = int(np.searchsorted(suffix, suffix[-1]))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            rows -= cut
            limit = max(PAIRS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (the empty one is the end) and of grams."""
    words: Counter[bytes] = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def out_words() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], ["word", "gram", "n"])

    def merge() -> None:
        parts[:] = [runs(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]

    for t in grouped(batches, BATCH):
        data, offsets = flat_bytes(t.column("b"))
        parts.append(runs(grams(data, offsets)[0]))
        if sum(len(c) for c, _ in parts) > HELD:
            merge()
        for b in t.column("b").to_pylist():
            if b:
                words.update(b.lower().split())
        words[b""] += t.num_rows
        if len(words) > 500_000:
            yield out_words()
            words.clear()
        if parts and len(parts[0][0]) > HELD:
            yield _gram_batch(*parts.pop(0))
    if words:
        yield out_words()
    if parts:
        merge()
        yield _gram_batch(*parts[0])


def _gram_batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.array(code), pa.array(n.astype(np.int64))], ["word", "gram", "n"])


class Trained:
    """What training leaves: word and gram counts as tables, frequent words, frequent grams and the short contexts."""

    def __init__(self, texts: DataFrame, ws: Workspace) -> None:
        counted = ws.save(texts.select("b").mapInArrow(_count, "word binary, gram long, n long"), "counted")
        self.words = ws.save(counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
        self.total, self.distinct = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        least = max(1, -(-self.total // (1 << WORD_BITS)))
        self.frequent_from = least
        common = self.words.filter((F.col("c") >= least) | (F.col("word") == F.lit(b""))).toArrow()
        self.common = dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist(), strict=True))
        self.grams = ws.save(counted.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        ws.drop("counted")
        size = self.grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = max(1, -(-size // (1 << TRIE_BITS)))
        total = F.sum("n").over(Window.partitionBy(F.shiftright("gram", 8)))
        log = F.log10(F.col("n") - 0.5) - F.log10("total")
        often = self.grams.withColumn("total", total).filter(F.col("n") >= least).select("gram", log.alias("log")).toArrow()
        gram, log = (often.column(c).to_numpy() for c in ("gram", "log"))
        order = np.argsort(gram)
        self.frequent = gram[order], log[order]
        masks = F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code")) for k in range(SHORT)))
        short = self.grams.select(F.explode(masks).alias("g"), "n").groupBy("g.k", "g.code").agg(F.sum("n").alias("n")).toArrow()
        k, code, n = (short.column(c).to_numpy() for c in ("k", "code", "n"))
        self.short = []
        for j in range(SHORT if size else 0):
            own = k == j
            order = np.argsort(code[own])
            self.short.append((code[own][order], n[own][order]))

    def logs(self, asked: DataFrame) -> DataFrame:
        """(gram, log, places): log10 probabilities, from all training counts, of the distinct grams of ``asked`` (gram, places)."""
        shared = asked.sparkSession.sparkContext.broadcast(self.short)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _by_suffix(batches):
                gram, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
                seen = n > 0
                if seen.all():
                    continue
                longer = [runs(gram[seen] & ((1 << 8 * (k + 1)) - 1), n[seen]) for k in range(SHORT, ORDER + 1)]
                trie = Trie([*shared.value, *longer] if shared.value else [])
                own = gram[~seen]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(trie.log_probability(own)), pa.array(t.column("places").to_numpy()[~seen])], ["gram", "log", "places"])

        none = F.lit(0).cast("long")
        both = self.grams.select("gram", "n", none.alias("places")).unionByName(asked.select("gram", none.alias("n"), "places"))
        both = both.withColumn("suffix", F.shiftright("gram", 8).bitwiseAND((1 << 8 * SHORT) - 1))
        return both.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(run, "gram long, log double, places long")


def score(docs: DataFrame, training: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of ``docs`` (doc_id, text) by a model of the texts of ``training``.

    ``extra`` names further columns of ``docs`` to carry along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "ppm")
    extra = extra or []
    model = Trained(training.select(F.col("text").cast("string").cast("binary").alias("b")), ws)
    shared = spark.sparkContext.broadcast((model.common, *model.frequent))  # at most 2**18 words and 2**22 grams
    denominator = float(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known_grams, logs_ = shared.value
        for t in grouped(batches, BATCH):
            raw = t.column("b").to_pylist()
            words: list[bytes] = []
            counts = []
            for b in raw:
                own = b.lower().split() if b else []
                own.append(b"")
                words += own
                counts.append(len(own))
            coded = pa.array(words, pa.binary()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            c = np.array([common.get(w, 0) for w in distinct], np.int64)
            is_common = np.array([w in common or not w for w in distinct], dtype=bool)
            code = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(raw)), counts)
            here = is_common[code]
            logs = np.log10((c + 1) / denominator)
            base = np.bincount(row[here], logs[code[here]], len(raw))
            known = np.bincount(row[here], (c > 0)[code[here]], len(raw)).astype(np.int64)
            rest = np.flatnonzero(~here)
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[rest], minlength=len(raw)))).astype(np.int32)), coded.dictionary.take(pa.array(code[rest])))
            sums, others, gram, n = look_up(known_grams, logs_, *flat_bytes(t.column("b")))
            grams_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(others)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(gram), pa.array(n.astype(np.int32))], ["gram", "n"]))
            carried = [t.column(n).combine_chunks() for n in ("doc_id", *extra)]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(np.array(counts, np.int64)), pa.array(known), pa.array(base), pa.array(sums), rare, grams_], ["doc_id", *extra, "n_tokens", "known", "base", "common_score", "rare", "grams"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*extra).schema) if extra else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.col("text").cast("string").cast("binary").alias("b"))
    scored = rows.mapInArrow(run, f"doc_id long, {kinds}n_tokens long, known long, base double, common_score double, rare array<binary>, grams array<struct<gram: bigint, n: int>>")
    scored = ws.save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words below the broadcast share: a document's are shuffled by word, then summed by row
    tokens = scored.select("row", F.explode("rare").alias("word"))
    counts = model.words.filter(F.col("c") < model.frequent_from)
    joined = tokens.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("row").agg(F.sum(F.log10((c + 1) / F.lit(denominator))).alias("rare_base"), F.sum((c > 0).cast("long")).alias("rare_known"))
    # so are the grams below the broadcast share
    places = scored.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.n")
    logs = ws.save(model.logs(places.groupBy("gram").agg(F.count("*").alias("places"))), "logs")
    many = (logs.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0] >> ASKED_BITS) + 1
    hot = F.broadcast(logs.filter(F.col("places") >= many).select("gram", "log"))
    cold = logs.filter(F.col("places") < many).select("gram", "log")
    found = places.join(hot, "gram").unionByName(places.join(hot.select("gram"), "gram", "left_anti").join(cold, "gram"))
    gram_sums = found.groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("rare_score"))
    out = scored.drop("rare", "grams").join(sums, "row", "left").join(gram_sums, "row", "left")
    return out.select(
        "doc_id", *extra, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from those whose crc32 remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score(docs, docs.filter("NOT held_out"), ["held_out"])
