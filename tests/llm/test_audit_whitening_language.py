"""Filter audit, whitening and language identification against plain Python, on small and on odd tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corvane.llm import filter_audit, language, queries, whitening
from corvane.llm.common import Workspace, crc_remainder

FOLDER = "/root/testdata/sf0.001"


# ---- filter audit


def plain_audit(docs, labels):
    """(part, order, step) -> figures, by applying the filters to lists of documents."""
    good, bad = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        return {f for f, x in own.items() if x}

    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((i, fails(i, t or "")))
    found = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                out, gone_before = [r for r in left if f in r[1]], sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + out
                shapley[f] += len(out)
                found[part, "".join(order), step] = [len(left), len(out), gone_before, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in out), sum(r[0] in bad for r in out)]
        for (p, order, step), figures in found.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return found


def test_swaps_visit_every_order_once():
    for k in (1, 2, 3, 5):
        order = list(range(k))
        seen = [tuple(order)]
        for i in filter_audit.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == math.factorial(k)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(5)
    many = lambda n, size: " ".join(f"w{rng.randint(0, size)}" for _ in range(n))
    pool = [many(250, 900), many(300, 20), many(30, 90), "AB" * 40, "x | y", many(220, 800) + " $", "", None, "é\x0bÀ b", "W" * 90_000]
    docs = [(i, rng.choice(pool), rng.choice(["web", "web", "web", "news", "", None])) for i in range(90)]
    docs += [(3, pool[0], "web"), (3, pool[0], "web"), (None, pool[0], "web"), (None, pool[0], None), (-5, pool[1], "late"), (200, pool[1], "late")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(60), 7, 7, None]]
    return docs, labels


def test_audit_equals_plain_filters(spark, audited, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    docs, labels = audited
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cells = filter_audit.mask_cells(filter_audit.failures(frame), marks, 4, Workspace(spark, "test"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(cells, "ABCDE").collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_cells(filter_audit.failures(frame), marks, 4, Workspace(spark, "test")), "ABCDE").collect() == []


def test_audit_works_out_words_once(spark):
    plan = filter_audit.failures(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(filter_audit.WORD) == 1


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = con.execute(queries.oracle_sql()["op11_filter_audit"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, filter_audit.op11_filter_audit(spark, FOLDER).select(*names).collect())) == sorted(want.fetchall())


# ---- whitening


def plain_whitening(vectors):
    """(x, n, S, V) of usable vectors, with Python's integers for the sums."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c - s // n) - (s % n) / n for c, s in zip(r, sums)] for r in fit])
    return x, n, sums, centred.T @ centred / n


def check_whitening(rows, vectors, d):
    """``rows`` (vec_id, ...) hold what the contract says of ``vectors`` (vec_id, vector)."""
    x, n, sums, v = plain_whitening([c for _, c in vectors])
    e, u = np.linalg.eigh(v)
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r.vec_id][r.component] = r
    k = min(16, d)
    for (i, _), own in zip(vectors, x):
        got = by_id[i]
        assert sorted(got) == list(range(1, k + 1))
        exact = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        for c, r in got.items():
            assert r.n == n and r.deviation == (exact if exact < 1 << 63 else None)
            assert abs(r.explained - e[-c] / v.trace()) <= 1e-4 * r.explained + 1e-15 and r.identity_error <= 1e-4
            if e[-c] > 1e-9 * v.trace():
                want = (np.array([c - s / n for c, s in zip(own, sums)]) @ u[:, -c]) / math.sqrt(e[-c])
                assert abs(abs(r.whitened) - abs(want)) < 1e-6 * (1 + abs(want))
            else:
                assert r.whitened == 0.0


def test_whitening_equals_plain_arithmetic(spark):
    d = 5
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, d)) * [3, 2, 1, 0.5, 4]
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    good += [(1000, good[0][1]), (1001, good[0][1]), (1002, good[1][1])]
    odd = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (2004, [1e300] * 5), (2005, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in [*good, *odd]], "vec_id long, embedding array<double>, component int")
    rows = whitening.whiten(frame, Workspace(spark, "test")).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good}
    check_whitening(rows, good, d)
    signs = {r.vec_id: r.whitened for r in rows if r.component == 1}
    assert signs[1000] == signs[0] and signs[1002] == signs[1]


def test_whitening_by_several_aggregations(spark, monkeypatch):
    rng = np.random.default_rng(4)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 20)))]
    frame = spark.createDataFrame(good, "vec_id long, embedding array<float>")
    good = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    monkeypatch.setattr(whitening, "PAIRS", 37)
    check_whitening(whitening.whiten(frame, Workspace(spark, "test")).collect(), good, 20)


def test_whitening_of_degenerate_tables(spark):
    ws = lambda: Workspace(spark, "test")
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema), ws()).collect() == []
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema), ws()).collect()
    assert len(rows) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in rows)
    # two lengths, a line, and deviations beyond a long
    line = [(i, [float(i), float(i), 0.0]) for i in range(9)]
    wide = [(100 + i, [float(i * 2**50)]) for i in range(4)]
    rows = whitening.whiten(spark.createDataFrame([*line, *wide], schema), ws()).collect()
    check_whitening([r for r in rows if r.vec_id < 100], line, 3)
    check_whitening([r for r in rows if r.vec_id >= 100], wide, 1)
    assert any(r.deviation is None for r in rows)


def test_op12_on_a_given_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check_whitening(whitening.op12_whitening(spark, FOLDER).collect(), [(r.vec_id, list(r.embedding)) for r in table.collect()], 64)


def test_pairs_are_one_aggregation(spark):
    seen = []
    frame = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "a double, b double")
    real = type(frame).selectExpr
    try:
        type(frame).selectExpr = lambda self, *e: seen.append(e) or real(self, *e)
        v = whitening.covariance(frame, ["a", "b"], [2.5, 55 / 6])
    finally:
        type(frame).selectExpr = real
    assert np.allclose(v, np.cov([range(6), [i * i for i in range(6)]], bias=True)) and [e for e in seen if "sum(" in e[0]] == [("sum(c0 * c0)", "sum(c0 * c1)", "sum(c1 * c1)", "count(*)")]


# ---- language


def plain_words(t):
    return regex.findall(r"\p{L}[\p{L}\p{M}]{0,63}", (t or "").lower())


def plain_language(train, texts):
    """Prediction and score of each text, by dictionaries."""
    counts, docs = defaultdict(Counter), Counter()  # (n, entry) -> lang -> count
    for t, lang in train:
        if lang is not None:
            docs[lang] += 1
            for w in plain_words(t):
                counts[0, w][lang] += 1
                m = f"<{w}>"
                for n in range(1, 6):
                    for g in (m[k : k + n] for k in range(len(m) - n + 1)):
                        if g not in "<>":
                            counts[n, g][lang] += 1
    total = Counter()
    for (n, _), c in counts.items():
        for lang, x in c.items():
            total[n, lang] += x
    known = {k: c for k, c in counts.items() if any(x >= 2 and x >= total[k[0], lang] / 2**18 for lang, x in c.items())}
    size = Counter(n for n, _ in known)
    langs = sorted(lang for n, lang in total if n == 0)
    if not langs or not known:
        return [("und", 0.0)] * len(texts)
    log = lambda k, lang: math.log((known[k][lang] + 0.5) / (total[k[0], lang] + 0.5 * (size[k[0]] + 1)))

    def said(w, lang):
        if (0, w) in known:
            return log((0, w), lang)
        m = f"<{w}>"
        for n in range(5, 0, -1):
            grams = [(n, m[k : k + n]) for k in range(len(m) - n + 1)]
            if any(g in known for g in grams):
                return np.mean([log(g, lang) for g in grams if g in known])
        return 0.0

    out = []
    for t in texts:
        w = plain_words(t)
        z = np.array([math.log(docs[x] / sum(docs[y] for y in langs)) + sum(said(v, x) for v in w) for x in langs])
        out.append((langs[int(z.argmax())], float(1 / np.exp(z - z.max()).sum())) if w else ("und", 0.0))
    return out


def test_language_equals_plain_backoff(spark):
    rng = random.Random(9)
    pools = {"aa": "kalo mira tesu volan épi", "bb": "strong thing wether épi ghost", "": "ζητα ωμεγα mira", "cc": "ouvé queaux mira Île"}
    say = lambda lang, n: " ".join(rng.choice(pools[lang].split()) + rng.choice(["", "", "s", "ing", "aux", "İ"]) for _ in range(n))
    train = [(say(x, rng.randint(0, 30)), x) for x in rng.choices(list(pools), [6, 3, 1, 2], k=60)] + [(None, "aa"), ("12 34", "dd"), ("no language", None), ("été x² " + "z" * 300, "cc")]
    texts = [say(x, rng.randint(1, 6)) for x in rng.choices(list(pools), k=80)] + [None, "", " 12 ² % ", "kalomira strongish", "日本語", "q", "z" * 5000, "mira " * 3000, "kalo", "kalo"]
    frame = spark.createDataFrame([(t, x, 0.5) for t, x in train], "text string, lang string, score double")
    model = language.train(frame)
    asked = spark.createDataFrame([(i, t, "zz", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language.predict(asked, model).collect()}
    for i, (lang, score) in enumerate(plain_language(train, texts)):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9, (texts[i], got[i], lang, score)
    assert got[80].lang_pred == got[82].lang_pred == "und" and "dd" not in model.langs


def test_language_without_lessons(spark):
    frame = spark.createDataFrame([(1, "some text", None), (None, None, None)], "doc_id long, text string, lang string")
    assert language.train(frame) is None and {(r.lang_pred, r.score) for r in language.predict(frame, None).collect()} == {("und", 0.0)}
    assert language.predict(frame.limit(0), None).collect() == []


def test_rare_entries_are_unseen(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARE", 0.2)
    model = language.train(spark.createDataFrame([("often " * 8 + "rarely rarely", "aa"), ("other " * 5, "bb")], "text string, lang string"))
    assert set(model.entries[0].to_pylist()) == {"often", "rarely", "other"} and model.prior.tolist() == [math.log(0.5)] * 2
    monkeypatch.setattr(language, "SHARE", 0.3)
    model = language.train(spark.createDataFrame([("often " * 8 + "rarely rarely", "aa"), ("other " * 5, "bb")], "text string, lang string"))
    assert set(model.entries[0].to_pylist()) == {"often", "other"}


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    got = language.op13_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (crc_remainder(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99 and all((r.lang_pred == "und") == (not plain_words(r.text)) for r in got)
