"""Operators against brute force, odd inputs of every operator, and the pipeline."""

import hashlib
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, chat, decontaminate, html_text, line_dedup, minhash, neighbours, pii, ppm, queries, toxicity
from corvane.llm.common import Workspace, flat_bytes, grouped, unused

FOLDER = "/root/testdata/sf0.001"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


# ---- decontamination against a plain tiling


def plain_tiles(doc, item, least):
    """Greedy tiling as it is told: again and again the longest unmarked common run, leftmost in the item, then in the text."""
    in_doc, in_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while t + n < len(item) and d + n < len(doc) and item[t + n] == doc[d + n] and t + n not in in_item and d + n not in in_doc:
                    n += 1
                if n > best[0]:
                    best = (n, t, d)
        n, t, d = best
        if n < least:
            return covered
        in_item.update(range(t, t + n))
        in_doc.update(range(d, d + n))
        covered += n


@pytest.mark.parametrize("hits", [decontaminate.HITS, 7])
def test_contaminated_documents_equal_plain_tiling(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(21)
    items = [words(rng, rng.randint(2, 16), 9).split() for _ in range(8)] + [["same"] * 9]
    texts = []
    for _ in range(40):
        body = words(rng, rng.randint(0, 14), 9).split()
        own = rng.choice(items)
        cut = rng.randint(0, len(own))
        texts.append(rng.choice([body, body + own[cut:] + own[:cut], own[cut:] + body + own[:cut], ["same"] * rng.randint(3, 30)]))
    docs = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in decontaminate.contaminated(docs, bench, 3, 0.6).collect()}
    want = {(i, j): plain_tiles(d, t, 3) for i, d in enumerate(texts) for j, t in enumerate(items) if len(t) >= 3}
    assert got == {k: n for k, n in want.items() if n >= 0.6 * len(items[k[1]])} and got
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, 3, 0.6).collect()}
    assert left == set(range(40)) - {i for i, _ in got}


# ---- toxicity against its definition


def test_scores_are_the_noisy_or_of_sentences(spark):
    rng = np.random.default_rng(5)
    weights = np.zeros(1 << toxicity.BITS)
    texts = ["Fine words here. vile word! more\nvile vile.", "nothing. at all", "", "vileness vile? no"]
    for w in ("vile", "word", "nothing"):
        s = toxicity.featurize(*flat_bytes(pa.array([w.encode()], pa.binary())))
        weights[s.features[0, 0]] = rng.normal() + (3 if w == "vile" else 0)
    model = toxicity.Model(weights, -1.5)
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    for i, t in enumerate(texts):
        parts = [p for p in t.replace("\n", ".").replace("!", ".").replace("?", ".").split(".") if p.strip()]
        p = [model.sentence_scores(toxicity.featurize(*flat_bytes(pa.array([x.encode()], pa.binary()))))[0] for x in parts]
        assert abs(got[i].score - (1 - np.prod([1 - x for x in p]))) < 1e-9 and got[i].n_sentences == len(parts)
    assert got[9].score == got[2].score == 0


def test_held_out_documents_are_told_apart(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the driver's tables")
    d = "/root/testdata/sf0.01"
    scored = toxicity.op3_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = scored.select("predicted", "toxic").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.03


def test_without_usable_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)], [(1, None)], [(77, 1), (78, 0)]):
        model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r.score < 0.01 for r in toxicity.score_documents(df, model).collect())


# ---- personal data: what labelers and the classifier decide


def labelled_lines(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def number(begin, n, good):
        while True:
            x = begin + digits(n - len(begin))
            if pii.luhn(x) == good:
                return x

    group = lambda x, by: by.join(x[i : i + 4] for i in range(0, 16, 4))
    name = f"{rng.choice(['anna', 'bob', 'carl'])}{rng.randint(1, 99)}"
    good = [
        f"mail {name} (at) corp{rng.randint(1, 9)} (dot) com", f"write to {name} [at] web.de", f"contact {name} at site dot org", f"host 2001:db8:{rng.randint(1, 9)}::{rng.randint(1, 9999):x}", f"server {rng.randint(1, 250)}[.]{rng.randint(1, 250)}[.]3[.]9",
        "card " + group(number("4", 16, True), "/"), "visa " + group(number("4", 16, True), "."), f"phone 020 7946 0{digits(3)}", f"tel. (0)30 {digits(4)} {digits(3)}", f"mobile 06 {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
    ]
    bad = [f"ratio {rng.randint(1, 9)} @ {rng.randint(1, 9)}.{rng.randint(10, 99)}", "price 3 (at) 4.50", f"time {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"version 3.{rng.randint(300, 900)}.{rng.randint(1, 9)}.77", f"order {number('9', 16, False)}", f"serial {number('0', 16, False)}", f"isbn 978 {digits(1)} {digits(4)} {digits(4)} {digits(1)}"]
    base = [f"a{rng.randint(1, 9)}@b.com tel +44 20 {digits(4)} {digits(4)} ip 10.0.{rng.randint(0, 9)}.1 card {number('4', 16, True)} end"]
    return good, bad, base


def test_the_classifier_accepts_and_rejects(spark):
    rng, rows = random.Random(4), []
    for _ in range(60):
        for kind, lines in zip(("good", "bad", "base"), labelled_lines(rng), strict=True):
            rows += [(len(rows) + k, f"word {x} word", kind) for k, x in enumerate(lines)]
    df = spark.createDataFrame([*rows, (-1, None, "none"), (-2, "", "none"), (None, "a@b.com", "none")], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    found = {k: [got[i] for i, _, kind in rows if kind == k] for k in ("good", "bad", "base")}
    assert np.mean([r.n_added > 0 for r in found["good"]]) >= 0.95 and np.mean([r.n_added > 0 for r in found["bad"]]) <= 0.02
    assert all(r.n_candidates for r in found["bad"]) and all(r.n_email == r.n_ip == r.n_card == r.n_phone == 1 for r in found["base"])
    assert got[-1].spans == got[-2].spans == "" and got[None].n_email == 1


def test_a_saved_model_judges_alike_in_any_table(spark, tmp_path):
    rng, rows = random.Random(8), []
    for _ in range(30):
        rows += [(len(rows) + k, f"word {x} word") for k, x in enumerate(x for lines in labelled_lines(rng) for x in lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ws = Workspace(spark, "test")
    scanned = pii.scan(df, ws)
    fitted = pii.fit(scanned)
    fitted.write(spark, str(tmp_path / "model"))
    model = pii.SpanModel.read(spark, str(tmp_path / "model"))
    whole = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert {r.doc_id: r.spans for r in pii.find_pii(df, model=model).collect()} == whole
    few = [r for r in rows if r[0] % 17 == 3]  # too few to learn from
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(few, "doc_id long, text string"), model=model).collect()}
    assert got == {i: whole[i] for i, _ in few}
    # what labelers say of a candidate follows from the saved rates as EM left it
    votes = scanned.selectExpr("explode(found) AS c").groupBy("c.kind", "c.votes", "c.is_base").count().collect()
    posterior = pii.fit_labelers([(r.kind, r.votes, r.is_base, r["count"]) for r in votes])[2]
    assert all(abs(model.posterior(k, v) - p) < 1e-9 for (k, v, is_base), p in posterior.items() if not is_base) and any(not b for _, _, b in posterior)
    assert pii.SpanModel({}, {}, {}).probability(0, "1") == pii.SpanModel({}, {}, {}).posterior(0, "1") == 0.0
    nothing = pii.fit(pii.scan(df.limit(0), Workspace(spark, "none")))
    nothing.write(spark, str(tmp_path / "nothing"))
    assert pii.find_pii(df, model=pii.SpanModel.read(spark, str(tmp_path / "nothing"))).agg({"n_added": "sum"}).first()[0] == 0


def test_no_candidate_touches_a_base_span():
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "b.c", "@", ".", "1", "255", "4111", " ", "-", "+1", "(", ")", "4111111111111111", "10.0.0.1", "x@y.zz", " (at) ", "::", "2001:db8::1", " dot ", " at "]) for _ in range(rng.randint(0, 16)))
        base = pii.base_spans(t)
        own = pii.candidates(t, base)
        assert [c[:3] for c in own if c[5]] == [(k, s, e) for s, k, e in base]
        assert not any(s < be and bs < e for k, s, e, _, _, is_base in own if not is_base for bs, _, be in base), t
    long = "1 " * 100_000 + "a." * 100_000 + "@" * 1000
    assert pii.candidates(long, pii.base_spans(long)) is not None


# ---- HTML


STORY = "<h1>Title of the story here</h1>" + "".join(f"<p>The story goes on in paragraph {i} with a good many words in it, as stories do, until its end comes near.</p>" for i in range(5))
LENGTH = len(html_text.main_text(f"<article>{STORY}</article>", html_text.train()))


@pytest.mark.parametrize("page", [
    f'<nav><a href=x>Home</a></nav><div class="content has-sidebar">{STORY}</div><footer>end</footer>', f'<article class="post comments-open">{STORY}</article>', f'<main class="no-sidebar">{STORY}</main>', f'<div id="social-history">{STORY}</div><footer>c</footer>',
    f"<form id=aspnet><nav><a href=x>Home</a></nav><div>{STORY}</div><div class=sidebar><p>Some words at the side</p></div><footer>(c) all rights</footer></form>", f"<form><article>{STORY}</article><aside>Hello there reader</aside></form>", f"<div><a title=don't>x</a></div><article>{STORY}</article>",
    f"<article>{STORY}</article><section id=comments>" + "<p>I think that this is a great article and I have much to say about it.</p>" * 40 + "</section>", f"<div>{STORY}</div><div class=comments>" + "<p>I think that this is a great article and I have much to say.</p>" * 40 + "</div>",
    f'<article>{STORY}</article><article class="comment"><p>I think that this is a great article and so on.</p></article>', "<nav>" + "<b>" * 205 + f"<a href=x>h</a></nav><article>{STORY}</article>", f'<article>{STORY}</article><div title="a > b" class="ad">Buy this now or never, all of you</div>', f"<!--><article>{STORY}</article>",
])
def test_names_never_veto_the_article(page):
    assert len(html_text.main_text(page, html_text.train())) == LENGTH


def test_very_long_pages_are_read_in_time():
    tree = html_text.train()
    page = "<article>" + "<p>Some words of a very long article that never ends, it seems.</p>" * 20_000 + "</article>" + "<div><b>" * 20_000 + "<a" * 20_000 + ' "' * 20_000
    assert len(html_text.main_text(page, tree)) > 1_000_000
    assert html_text.main_text("&lt;&#x41;&amp;amp;" * 3, tree) == "<A&amp;" * 3


# ---- neighbours


def test_the_forest_opens_few_cells_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    forest = neighbours.Forest(x, float(np.linalg.norm(x, axis=1).max()))
    share = neighbours.calibrate(forest, x, 20, 0.95)
    cells = forest.cells(x)
    forest.sizes = np.bincount(cells.ravel(), minlength=forest.offsets[-1]).astype(float)
    opened = [np.isin(cells, c).any(1).mean() for c in forest.visit(x[:100], share)]
    assert forest.depth >= 4 and np.mean(opened) < 0.35
    far = np.concatenate([t.distances(forest.lift_queries(x[:5])) for t in forest.trees], axis=1)
    for i, c in enumerate(forest.visit(x[:5], share)):  # the queue opens cells by distance
        assert (np.diff(far[i][c]) >= -1e-9).all() and len(set(c)) == len(c)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "QUERIES", 64)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        total = 0.0
        for a, b in zip(x[q], x[found[0][1]], strict=True):
            total += a * b
        assert found[0][2] == total and [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def test_best_entries_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, size=(400, 6)).astype(float), rng.integers(-2, 3, size=(9, 6)).astype(float)  # many ties
    cells = rng.integers(0, 12, size=(400, 2))
    opened = [rng.choice(12, 5, replace=False) for _ in q]
    out = []
    for size in (400, 37, 1):
        best = neighbours.Best(np.arange(9), q, opened, 12, 7)
        for at in range(0, 400, size):
            best.add(np.arange(at, min(at + size, 400)), v[at : at + size], cells[at : at + size])
        t = best.out()
        out.append(sorted(zip(*(t.column(i).to_pylist() for i in range(3)), strict=True)))
    assert out[0] == out[1] == out[2]
    for i in range(9):
        seen = np.flatnonzero(np.isin(cells, opened[i]).any(1))
        want = sorted(seen, key=lambda j: (-(v[j] @ q[i]), j))[:7]
        assert sorted(want) == [e for r, e, _ in out[0] if r == i]


# ---- lines


def test_runs_hold_each_hash_once(spark):
    rng, batches = random.Random(8), []
    runs = line_dedup.LineRuns(Workspace(spark, "t"), 4)
    for _ in range(5):
        rows = [(rng.randint(0, 40), rng.randint(0, 30), 7) for _ in range(60)]
        batches.append(rows)
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long").select((F.col("doc_id") + 100 * len(batches)).alias("doc_id"), "h1", "h2"))
    held = [r.h1 for run in runs.runs() for r in run.collect()]
    assert len(held) == len(set(held)) == len({h for b in batches for _, h, _ in b})
    count = {}
    for k, b in enumerate(batches, 1):
        for d, h, _ in b:
            count.setdefault(h, set()).add(d + 100 * k)
    got = {r.h1: r.last_doc for r in runs.common(6).collect()}
    assert got == {h: max(v) for h, v in count.items() if len(v) >= 6} and got
    plan = runs.runs()[0].join(runs.runs()[-1].hint("merge"), line_dedup.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


# ---- chat


def test_a_conversation_is_one_row_however_long(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|end|> of many words", "x") for i in range(40)] + [(2, 0, "user", "", "x"), (2, 0, "user", "", "x"), (3, 0, "assistant", "y" * 300_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df, chat.tokenizer_file()).collect()}
    tokenizer = chat.load_tokenizer(chat.tokenizer_file())
    assert len(got) == 3 and got[1].ids == tokenizer.encode(got[1].formatted, add_special_tokens=False).ids and len(got[1].loss_mask) == len(got[1].ids)
    assert [t for _, t in chat.parse(got[1].formatted)] == [r[3] for r in rows[:40]] and not any(got[2].loss_mask) and len(chat.parse(got[2].formatted)) == 2
    digests = {r.conv_id: r for r in chat.chat_digests(df, chat.tokenizer_file()).collect()}
    assert digests[1].formatted_chars == len(got[1].formatted) and digests[3].loss_chars == 300_000


# ---- tokenizer files


def test_unknown_tokenizer_settings_are_refused():
    with open(chat.tokenizer_file(), encoding="utf-8") as f:
        raw = json.load(f)
    bpe.Vocabulary(raw)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": None}, {"added_tokens": [{**raw["added_tokens"][0], "lstrip": True}]}, {"model": {**raw["model"], "dropout": 0.1}}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary({**raw, **change})


def test_words_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 2)
    monkeypatch.setattr(bpe, "BATCH", 10)
    df = spark.createDataFrame([(i, "aa bb cc dd" if i % 2 else "aa ee") for i in range(20)], "doc_id long, text string").repartition(7)
    with open(chat.tokenizer_file(), encoding="utf-8") as f:
        v = bpe.Vocabulary(json.load(f))
    assert sorted(bpe.frequent_words(df, v)) == sorted(w.encode() for w in ("aa", " bb", " cc", " dd", " ee"))


# ---- every operator on odd tables


def odd(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, _gone int, _gone_id int, _kept string, n_chars long, score double")


ODD = [(1, None, "a", 1, 1, "k", 0, 0.5), (2, "", "a", 1, 1, "k", 0, 0.5), (None, "x y z", "a", None, 1, None, None, None), (3, "same words in a row of them", None, 1, 1, "k", 27, 0.5), (3, "same words in a row of them", None, 1, 1, "k", 27, 0.5), (4, "z " * 150_000, "a", 1, 1, "k", 300_000, 0.5)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_operator_takes_odd_rows(spark, rows):
    df, n = odd(spark, rows), len(rows)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "same words in a row of them"), (None, None)], "item_id long, text string")
    assert pii.find_pii(df).count() == n and minhash.near_duplicates(df.select("doc_id", "text")).count() == n and ppm.score(df, df).count() == n
    assert toxicity.score_documents(df, toxicity.train(df, labels)).count() == n and bpe.encode_documents(df, chat.tokenizer_file()).count() == n
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    lines = line_dedup.dedup_lines(df)
    assert lines.count() == n and lines.columns.count("n_lines") == 1 and set(df.columns) <= set(lines.columns)
    assert decontaminate.contaminated(df, bench).count() == (2 if rows else 0) and decontaminate.drop_contaminated(df, bench).count() == (n - 2 if rows else 0)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == n
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == n
    chats = spark.createDataFrame([(1, 0, "user", "x", 2)] * (2 if rows else 0), "conv_id long, turn long, role string, text string, n_turns int")
    assert [r.n_turns for r in chat.chat_digests(chats, chat.tokenizer_file()).collect()] == ([2] if rows else [])
    pages = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>" * 5000, "t")][: 3 if rows else 0], "page_id long, url string, html string, text string")
    assert html_text.extract(pages).count() == (3 if rows else 0)


def test_names_that_are_free(spark):
    df = odd(spark, [])
    assert unused("gone", df) == "__gone" and unused("text", df) == "_text" and unused("GONE", df) == "__GONE"


def test_long_texts_are_tables_of_their_own():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 3000, 5, 5, 9000)])], ["t"])
    parts = list(grouped([batch, batch.slice(0, 0)], 2000))
    assert pa.concat_tables(parts).column("t").to_pylist() == batch.column(0).to_pylist() and len(parts) > 1


# ---- the pipeline


def test_the_pipeline_keeps_what_it_should(spark, tmp_path):
    rng = random.Random(17)
    d = str(tmp_path)
    story = lambda k, n=80: " ".join(f"s{k}w{rng.randint(0, 300)}" for _ in range(n))
    boiler = "this notice stands in many documents and is kept in the last of them only"
    passage = story("bench", 40)
    texts = {i: story(i) for i in range(300)}
    for i in range(60):
        texts[i] += ". That is vilestuff indeed."
    for i in range(100, 107):
        texts[i] += "\n" + boiler
    texts[201] = texts[200]
    texts[203] = texts[202] + " one more word"
    texts[210] += " " + passage
    texts[211] = "\n".join([" ".join(passage.split()[20:]), story(211), " ".join(passage.split()[:20])])
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, "en", "s", 0), (901, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = corpus_pipeline.toxicity(spark, docs, d)
    lined = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, left, d).collect()}
    assert lined[106].text.endswith(boiler) and not any(boiler in lined[i].text for i in range(100, 106)) and lined[100].n_chars == len(lined[100].text) and lined[900].text is None
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == (set(range(60, 300)) | {900, 901}) - {201, 203, 210, 211}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(chat.tokenizer_file())
    for i in (60, 105, 106, 202, 900):
        ids = library.encode(lined[i].text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns and stage(spark, docs.limit(0), d).count() == 0


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage at all anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = odd(spark, [(*r[:2], "own", *r[3:]) for r in ODD]).withColumn("n_dropped", F.lit(77))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and {(r.n_lines, r.n_dropped) for r in out.collect()} == {("own", 77)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_every_query_runs_on_the_smallest_tables(spark):
    n = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in queries.queries().items():
        rows = query(spark, FOLDER).count()
        assert rows == (n["documents"] if name in ("op1_pii", "op3_toxicity", "op5_ppm", "op6_minhash", "op7_line_dedup", "op8_bpe") else n["pages"] if name == "op10_html" else rows)
