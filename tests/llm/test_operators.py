"""The training-data operators against plain Python, on small tables of our own."""

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, decontaminate, html_text, line_dedup, minhash, neighbours, pii, ppm, toxicity
from corvane.llm.common import Workspace, flat_bytes
from corvane.llm.components import connected_components

DOCS = "doc_id long, text string, score double"  # a column whose name clashes with results
ODD = [(900, None, 1.0), (901, "", 1.0), (None, "no id", 1.0), (902, "x" * 200_000, 1.0), (903, " \n\t ", 1.0), (904, "same row", 1.0), (904, "same row", 1.0)]


def docs(spark, texts, odd=True):
    return spark.createDataFrame([*((i, t, 0.0) for i, t in enumerate(texts)), *(ODD if odd else [])], DOCS)


def text(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n))


# ---- personal data


def brute_base(t):
    found = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m.group())
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                found.append((m.start(), pii.KINDS.index(k), m.end()))
    return sorted(found)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b.c", "@", ".", "1", "255", "4111", " ", "-", "+1", "(", ")", "é", "4111111111111111", "10.0.0.1", "x@y.zz"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_adds_spans_and_keeps_base_ones(spark):
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, ["é me@a.example.com, tel. 0044 20 7946 0000 x", "mail bob (at) example (dot) com now", "ip 10.0.0.1"])).collect()}
    assert got[0].n_email == 1 and got[0].spans.startswith("email:2:18") and got[2].spans == "ip:3:11" and got[900].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(b"email:2:18").hexdigest()


# ---- toxicity


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 30) + ". " + text(rng, 5) + (" vilestuff" if i % 4 == 0 else "") + ". " + text(rng, 9), 0.0) for i in range(400)]
    frame = spark.createDataFrame([*rows, *ODD], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(frame, model).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(400)) and got[903].score == 0 and got[None].score < 0.7
    at = rows[0][1].index("vilestuff")
    assert got[0].worst_start <= at < got[0].worst_end and got[0].n_offending == 1
    assert toxicity.drop_toxic(frame, labels).columns == ["doc_id", "text", "score"]


# ---- chat


@pytest.mark.parametrize("t", ["", "<|", "<\\|end|>", "a<|end|><|turn|>assistant<|text|>", "</s>[INST] ok", "é<\\\\|x"])
def test_escapes_are_undone(t):
    assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    formatted, _ = chat.render([("user", t), ("assistant", t)])
    assert chat.parse(formatted) == [("user", t), ("assistant", t)]


def test_loss_covers_each_assistant_text_once(spark):
    rows = [(1, 1, "assistant", " né<|end|>\n\n", 0), (1, 0, "user", "hi", 0), (2, 0, "user", None, 0), (None, 0, None, "x", 0), (3, 0, "assistant", "a\n", 0), (3, 1, "assistant", "\nb", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.chat_digests(df, chat.tokenizer_file()).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(" né<|end|>\n\n".encode()).hexdigest() and got[3].loss_sha256 == hashlib.sha256(b"a\n\nb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\n né<|end|>\n\n\n".encode()).hexdigest() and got[2].loss_chars == 0 and len(got) == 4


# ---- PPM


def test_ppm_equals_plain_ppm():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcab ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    code, n = ppm.runs(ppm.grams(*flat_bytes(pa.array([*texts, None], pa.binary())))[0])
    trie = ppm.Trie([ppm.runs(code & ((1 << 8 * (k + 1)) - 1), n) for k in range(ppm.ORDER + 1)])
    counts = {}
    for t in [*texts, b""]:
        s = b"\xff" * ppm.ORDER + t + b"\xff"
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                h = counts.setdefault(s[i - k : i], {})
                h[s[i]] = h.get(s[i], 0) + 1

    def plain(context, byte):
        p, gone = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            left = {b: c for b, c in counts.get(context[len(context) - k :], {}).items() if b not in gone}
            if left:
                if byte in left:
                    return p * (left[byte] - 0.5) / sum(left.values())
                p *= len(left) / 2 / sum(left.values())
                gone |= set(left)
        return p / (256 - len(gone))

    for t in (b"abcab xyz", b"", b"cab ab", "zé".encode()):
        s = b"\xff" * ppm.ORDER + t + b"\xff"
        want = sum(np.log10(plain(s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))
        assert abs(trie.scores(*flat_bytes(pa.array([t], pa.binary())))[0] - want) < 1e-9
    assert abs(sum(plain(b"  abc", b) for b in range(256)) - 1) < 1e-9


def test_ppm_base_score(spark):
    frame = docs(spark, ["a b a", "A c", "b\tb"])
    got = {(r.doc_id, r.n_tokens): r for r in ppm.score(frame, frame.filter("doc_id < 2")).collect()}
    # training: a b a end, a c end: N 7, V 4
    want = np.log10(2 / 12) * 2 + np.log10(3 / 12)
    assert abs(got[2, 3].base_score - want) < 1e-9 and got[2, 3].n_known == 3 and got[2, 3].train_tokens == 7 and got[900, 1].n_known == 1


@pytest.mark.parametrize("bits", [22, 4])
def test_ppm_counts_rare_pairs_whatever_the_broadcast_share(spark, monkeypatch, bits):
    monkeypatch.setattr(ppm, "TRIE_BITS", bits)
    monkeypatch.setattr(ppm, "ASKED_BITS", 6, raising=False)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcab é") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    frame = docs(spark, texts)
    got = {r.doc_id: r.score for r in ppm.score(frame, frame.filter("doc_id % 7 <> 2 OR doc_id IS NULL")).collect()}
    train = [t.encode() for i, t in enumerate(texts) if i % 7 != 2] + [(t or "").encode() for i, t, _ in ODD if i is None or i % 7 != 2]
    code, n = ppm.runs(ppm.grams(*flat_bytes(pa.array(train, pa.binary())))[0])
    trie = ppm.Trie([ppm.runs(code & ((1 << 8 * (k + 1)) - 1), n) for k in range(ppm.ORDER + 1)])
    for i, t in [*enumerate(texts), *((i, t or "") for i, t, _ in ODD)]:
        assert abs(got[i] - trie.scores(*flat_bytes(pa.array([t.encode()], pa.binary())))[0]) < 1e-6 * max(1, abs(got[i])), i


def test_ppm_without_training_texts(spark):
    frame = docs(spark, ["abc", ""], odd=False)
    got = {r.doc_id: r.score for r in ppm.score(frame, frame.limit(0)).collect()}
    assert abs(got[0] + 4 * np.log10(256)) < 1e-9 and abs(got[1] + np.log10(256)) < 1e-9


# ---- near-duplicates


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = text(rng, 60).split()
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(60)] = "new%d" % rng.randint(0, 99)
            texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "one two", "One  two", "three"]
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.encode().lower().split()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root and [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert got[900].kept and got[900].n_shingles == 0 and got[None].kept


def test_members_outside_the_head_s_component_are_linked(spark):
    rng = random.Random(4)
    a = text(rng, 80).split()
    b = a[:66] + text(rng, 14).split()  # head, too far from both others
    c, d = a[:54] + text(rng, 26).split(), None
    d = c[:79] + ["last"]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, [" ".join(x) for x in (b, c, d)], odd=False)).collect()}
    assert got[1] == got[2]


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for p in links for x in p}
    for _ in range(60):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()))
    assert all(got.get(x, x) == r for x, r in root.items())


# ---- lines


def test_line_dedup_equals_plain(spark):
    rng = random.Random(7)
    pool = ["%s line %d" % ("long " * 8, i) for i in range(6)] + ["short"]
    texts = ["\n".join(rng.choice([" \t", ""]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randint(1, 8))) for _ in range(30)] + ["a\n\n", "\r\n"]
    key = lambda s: s.strip(" \t\n\x0b\f\r").lower()
    holders = {}
    for i, t in enumerate(texts):
        for s in t.split("\n"):
            if len(key(s)) >= 40:
                holders.setdefault(key(s), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kept = [s for s in t.split("\n") if gone.get(key(s), i) == i]
        assert (got[i].kept_text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept))
    assert got[900].n_lines == 1 and got[900].kept_text == ""


def test_line_dedup_plan_has_no_python(spark):
    out = line_dedup.dedup_lines(docs(spark, ["a"]))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


# ---- decontamination


def test_tiles_catch_reordered_passages(spark):
    rng = random.Random(8)
    item = text(rng, 40).split()
    near = item[20:] + ["and", "then"] + item[:20]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    frame = docs(spark, [text(rng, 50) + " " + " ".join(near).upper(), text(rng, 90), " ".join(item[:10]) + " " + text(rng, 60)])
    got = decontaminate.contaminated(frame, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in got] == [(0, 1, 2, 40)]
    assert 0 not in [r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()]


def test_greedy_tiling_takes_the_longest_first():
    assert decontaminate.tile([(6, 0, 0), (8, 4, 20)], 3) == [(8, 4, 20), (4, 0, 0)]


# ---- BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = chat.tokenizer_file()
    library = Tokenizer.from_file(path)
    texts = ["It's  a test,\n\n  of 123 words<|endoftext|> and é ü 漢字 \x1c\xa0x " * 3, "I'll don't", " ", "\n\t \n"]
    got = {r.doc_id: r for r in bpe.encode_documents(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[900].n_tokens == 0


def test_lexicon_finds_its_words_and_no_others():
    rng = random.Random(9)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [k, k + 1][: 1 + k % 2] for k in range(300)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    asked = [*words, b"", b"zzz", b"abcabcabca"]
    found = lexicon.find(*flat_bytes(pa.array(asked, pa.binary())))
    assert [lexicon.ids[lexicon.offsets[k] : lexicon.offsets[k + 1]].tolist() if k >= 0 else None for k in found] == [words.get(w) for w in asked]


def test_both_mergers_agree():
    with open(chat.tokenizer_file(), encoding="utf-8") as f:
        v = bpe.Vocabulary(json.load(f))
    rng = random.Random(10)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdehilnorst ") for _ in range(rng.randint(1, 14)))
        assert v.merge(w) == list(v.merger()(w))


# ---- neighbours


def test_neighbours_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, x[i].tolist()) for i in range(700)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] * 4), (1080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits, d = 0, x.astype(float)
    for q, ids in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -np.round(s, 12)))[:20]
        hits += len(set(want) & set(ids))
    assert len(got) == 35 and hits >= 0.9 * 20 * 35 and set(got[100]) == set(range(101, 121))
    few = df.filter("vec_id IN (0, 1, 2)")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 2 and neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [2, 25])
def test_repeated_rows_hide_no_equal_neighbours(spark, times):
    x = np.random.default_rng(12).normal(size=(120, 8))
    x[20:61] = x[20] * 9
    rows = [(i, x[i].tolist()) for i in range(120) for _ in range(times if i == 20 else 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id IN (20, 40)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 20] == list(range(21, 41)) and [r.vec_id for r in got if r.query_id == 40] == list(range(20, 40))


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(14)
    x = {**{i: rng.normal(size=8) for i in range(60)}, **{i: rng.normal(size=5) for i in range(60, 90)}, 90: rng.normal(size=9)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0 OR vec_id = 90")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 20, 40, 60, 80):
        assert got[q] == sorted((i for i in x if len(x[i]) == len(x[q]) and i != q), key=lambda i: -(x[i] @ x[q]))[:20]
    assert 90 not in got


# ---- HTML


def test_main_text_drops_what_is_not_the_article(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><article><header><h1>A &amp; B</h1></header>
    <p><b>First   paragraph,<br>bold <p>second<!-- no --> one &eacute;<div class="share-bar">Share this</div></p><script>var t="</p>";</script></article>
    <section id="comments"><p>A very long reader comment that looks like the text of the article itself, as they do</p></section><form><p>Name</p></form><footer>end</footer>"""
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "u", "<p", 0)], "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == "A & B\n\nFirst paragraph, bold\n\nsecond one é" and got[1].n_chars == len(got[1].text) and got[2].text == ""


@pytest.mark.parametrize("n", [1, 199, 200, 5000])
def test_regions_end_below_any_number_of_unclosed_elements(n):
    words = "<p>the body of the story goes on and on</p>"
    r = html_text.read_page(f"<nav>{'<font>x<br>' * n}</nav>{words}")
    assert r.blocks[-1].outer == 0 and r.blocks[0].outer
    r = html_text.read_page(f"<article>{words}{'<b>x<br>' * n}</article><div>a comment</div>")
    assert r.holds[0] and r.blocks[0].in_article and not r.blocks[-1].in_article


def test_tree_learns_its_table():
    rows = [tuple(map(float, line.split())) for line in html_text.LABELLED.strip().splitlines()]
    tree = html_text.train()
    assert sum(tree(r[:-1]) == bool(r[-1]) for r in rows) >= 0.97 * len(rows)


def test_empty_tables(spark):
    none = docs(spark, [], odd=False).limit(0)
    assert minhash.near_duplicates(none).count() == line_dedup.dedup_lines(none).count() == pii.find_pii(none).count() == ppm.score(none, none).count() == 0
    assert bpe.encode_documents(none, chat.tokenizer_file()).count() == 0
