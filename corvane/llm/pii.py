"""Personal data: labelers vote on candidate spans, EM weighs them, a final classifier decides.

Base spans are those of four fixed patterns. Candidate spans come from wider ones: written-out and spaced mail addresses,
IPv6 and defanged addresses, cards in other groupings, national phone numbers, and what has a base shape but fails its
test. Each candidate gets the votes of six labelers, two of each sort: patterns (its parts and its form), gazetteers
(domains, address blocks, issuers, dialling codes; and what else such a thing may be) and context (a cue before it that
speaks for it, one that speaks against it). Votes of all documents are counted by pattern of votes, so what EM reads has
a proven bound: kinds x 3**labelers rows. EM (Dawid and Skene's model with two classes) gives each labeler's
reliability; its posteriors train a logistic classifier for each kind over shape features, again from counts of distinct
feature rows. Candidates that it accepts are added; base spans always stay, and no candidate touches one.

Nulls and empty texts have no spans. Repeated rows are scored each by itself; null ids stay null. Empty tables give no
rows. Offsets are code points. Every text is read in time proportional to its length, but for sorting its spans.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, grouped, small_batches, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that never look at a character twice.
_MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What the labelers know.
_MAIL_DOMAINS = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "gmx.de", "web.de", "orange.fr", "proton.me", "example.com", "example.net", "example.org")
_TOP_LEVEL = frozenset("com net org edu gov info biz io de fr es uk eu me at ch it nl be pl pt se fi no dk cz ie us ca au jp in br".split())
_DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "971", "972")
_CUES = {
    "email": re.compile(r"e-?mail|mail|contact|courriel|correo|write to|address|reach", re.I),
    "ip": re.compile(r"\bip\b|ipv[46]|host|server|address|adresse|client|from|ping|addr|login", re.I),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|master|amex|credit|pay|cc\b", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobile|cell|handy|tél|tel[eé]fono|telefon|whatsapp|ring|sms", re.I),
}
_AGAINST = re.compile(r"version|\bv\.?\s?$|order|invoice|isbn|issn|serial|build|release|ticket|\bno\.|number of|#\s*$|time|clock|total|price|\bid\b|ratio|score|code|ref\b|dated?\b", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}")

# Wider shapes, for candidates; none of them looks at a character more than a few times.
_AT = re.compile(r"[ \t]?(?:@|[(\[{<][ \t]?(?:at|@)[ \t]?[)\]}>])[ \t]?", re.I)
_DOMAIN = re.compile(r"[\w-]++(?:[ \t]?(?:\.|[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>])[ \t]?[\w-]++)+", re.I)
_SPOKEN = re.compile(r"(?<![\w.%+-])[\w.%+-]++ at [\w-]++(?: dot [\w-]++)++", re.I)
_DOT = re.compile(r"[ \t]?[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>][ \t]?|[ \t]?\.[ \t]?| dot ", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ \t]?[\[(]?\.[\])]?[ \t]?[0-9]{1,3}){3}(?![0-9])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ \t().\/–-]{0,2}[0-9])++(?![0-9A-Za-z])")
_HINT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]| dot |[0-9]|::", re.I)
N_VOTES = 6


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    free = 0
    if "@" in text:
        for m in _MAIL_TAIL.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _MAIL_CHARS:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _domain(span: str) -> tuple[str, str]:
    """Local part and domain of a mail candidate, written plainly."""
    at = _AT.search(span) or re.search(" at ", span, re.I)
    return span[: at.start()], _DOT.sub(".", span[at.end() :]).lower()


def _address(span: str):
    """The address that an IP candidate spells, or None."""
    plain = re.sub(r"[\s\[\]()]", "", span)
    try:
        return ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in plain.split(".")) if ":" not in plain else plain)
    except ValueError:
        return None


def _issuer(digits: str) -> bool:
    """Whether a card number begins and is as long as an issuer's."""
    two, four, n = int(digits[:2]), int(digits[:4]), len(digits)
    return (digits[0] == "4" and n in (16, 19)) or ((51 <= two <= 55 or 2221 <= four <= 2720) and n == 16) or (two in (34, 37) and n == 15) or (two in (36, 38, 30) and n == 14) or (two in (35, 60, 62, 64, 65) and 16 <= n <= 19)


def votes_of(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """Votes of the six labelers (two patterns, two gazetteers, two contexts): 1 for, 0 against, 2 abstains."""
    context = (1 if _CUES[kind].search(before) else 2, 0 if _AGAINST.search(before) else 2)
    digits, groups = _digits(span), [len(g) for g in re.findall("[0-9]+", span)]
    if kind == "email":
        local, domain = _domain(span)
        labels = domain.split(".")
        return int(all(labels) and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24), int(any(c.isalpha() for c in local) and len(local) <= 64 and ".." not in local), int(labels[-1] in _TOP_LEVEL), 1 if domain in _MAIL_DOMAINS else 2, *context
    if kind == "ip":
        address = _address(span)
        clock = all(len(p) <= 2 and p.isdigit() for p in span.split(":")) and ":" in span
        return int(address is not None), int(not clock and len(span) > 4), 2 if address is None else int(not (address.is_multicast or address.is_unspecified)), 0 if clock or re.match(r"[\s.]*[0-9]", after) else 2, *context
    if kind == "card":
        regular = groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or len(groups) == 1
        return int(luhn(digits)), int(regular), int(_issuer(digits)), 0 if len(set(digits)) < 3 or _DATE.search(span) else 2, *context
    number = digits[2:] if span.startswith("00") else digits
    abroad = span.startswith(("+", "00"))
    known = number.startswith(_DIALLING) if abroad else digits[0] == "0" or span.startswith("(") or (len(digits) == 10 and groups == [3, 3, 4])
    return int(9 <= len(number) <= 15), int(len(groups) >= 2 and max(groups) <= 8 and len({c for c in span if not c.isdigit() and c not in "+()"}) <= 2), int(known), 0 if _DATE.search(span) or re.search(r"97[89]", digits[:3]) else 2, *context


def features_of(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """Small whole numbers that describe a candidate; their distinct rows are few: at most 4 * 2**8 a kind."""
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    if kind == "email":
        local, domain = _domain(span)
        last = domain.rpartition(".")[2]
        own = (int(last.isalpha()), int(last in _TOP_LEVEL), int(any(c.isalpha() for c in local)), int("@" in span))
    elif kind == "ip":
        address = _address(span)
        own = (int(address is not None), int(":" in span), int(all(len(p) <= 2 and p.isdigit() for p in re.split("[:.]", span))), int("[" in span or "(" in span))
    elif kind == "card":
        own = (int(luhn(digits)), int(_issuer(digits)), int(len({len(g) for g in groups[:-1]}) <= 1), int(len(digits) == 16))
    else:
        own = (int(span.startswith(("+", "00"))), int(span.startswith(("0", "("))), int(9 <= len(digits) <= 15), int(bool(_DATE.search(span)) or digits[:3] in ("978", "979")))
    return (*own, min(3, len(groups) - 1) if groups else 0, int(bool(_CUES[kind].search(before))), int(bool(_AGAINST.search(before))), int(after[:1].isalnum() or before[-1:].isalnum()), int(any(c.isspace() for c in span)))


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind number, start, end) of candidates by wider shapes, in no order."""
    free = 0
    for m in _AT.finditer(text):
        start, domain = m.start(), _DOMAIN.match(text, m.end())
        while domain and start > free and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if domain and start < m.start():
            yield 0, start, domain.end()
            free = domain.end()
    if " dot " in text.lower():
        for m in _SPOKEN.finditer(text):
            yield 0, m.start(), m.end()
    if ":" in text:
        for m in _IPV6.finditer(text):
            if len(m.group().strip(":")) > 1:
                yield 1, m.start(), m.end()
    for pattern in (_DEFANGED, _IP):
        for m in pattern.finditer(text):
            yield 1, m.start(), m.end()
    for m in _NUMBER.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and not m.group().startswith(("+", "(")):
            yield 2, m.start(), m.end()
        if 9 <= len(digits) <= 15 and (m.group()[0] in "+(0" or len(re.findall("[0-9]+", m.group())) > 1):
            yield 3, m.start(), m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...], tuple[int, ...], bool]]:
    """(kind number, start, end, votes, features, whether it is a base span) of base spans and of wider ones that touch none; of each kind the leftmost that don't overlap."""
    found, last = [(k, s, e, True) for s, k, e in base], {}
    starts, reach = [s for s, _, _ in base], []  # how far base spans reach that start no later
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))
    for k, s, e in sorted(set(_wider(text)), key=lambda x: (x[1], -x[2])):
        at = bisect.bisect_left(starts, e)  # base spans before it start left of its end
        if (at and reach[at - 1] > s) or s < last.get(k, 0):
            continue
        last[k] = e
        found.append((k, s, e, False))
    out = []
    for k, s, e, is_base in found:
        before, after, span = text[max(0, s - 40) : s], text[e : e + 2], text[s:e]
        out.append((k, s, e, votes_of(KINDS[k], span, before, after), features_of(KINDS[k], span, before, after), is_base))
    return out


_SCAN_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    "found array<struct<kind:int,start:int,end:int,votes:string,features:string,is_base:boolean>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    cand = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string()), ("is_base", pa.bool_())])
    for t in grouped(batches):
        ids, counts, hashes, bases, founds = t.column(0).combine_chunks(), [[] for _ in KINDS], [], [], []
        for text in t.column(1).to_pylist():
            base = base_spans(text) if text and _HINT.search(text) else []
            for k in range(4):
                counts[k].append(sum(n == k for _, n, _ in base))
            hashes.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            founds.append([{"kind": k, "start": s, "end": e, "votes": "".join(map(str, v)), "features": "".join(map(str, f)), "is_base": b} for k, s, e, v, f, b in (candidates(text, base) if text and _HINT.search(text) else [])])
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(bases, pa.list_(span)), pa.array(founds, pa.list_(cand))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"])


@dataclass(frozen=True)
class SpanModel:
    """What fitting learns, by kind: how labelers vote in either class, and the final classifier's weights.

    ``prior`` is the share of personal data among candidates; ``rates`` holds for each class (no, yes) and labeler how
    often it votes against, for, and abstains; ``weights`` begin with the intercept. A saved model judges the same text
    alike in every table; kinds that it never saw have nothing added.
    """

    prior: dict[int, float]
    rates: dict[int, np.ndarray]  # (2, labelers, 3)
    weights: dict[int, np.ndarray]

    def posterior(self, kind: int, votes: str) -> float:
        """How likely a candidate with these votes is personal data, as the labelers see it."""
        if kind not in self.prior:
            return 0.0
        own = [int(v) for v in votes]
        like = [np.log(p) + sum(np.log(self.rates[kind][c, j, v]) for j, v in enumerate(own)) for c, p in enumerate((1 - self.prior[kind], self.prior[kind]))]
        return float(1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30))))

    def probability(self, kind: int, features: str) -> float:
        """The classifier's probability of a row of features, seen in fitting or not."""
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.array([1.0, *map(int, features)]) @ self.weights[kind], -30, 30))))

    def write(self, spark: SparkSession, path: str) -> None:
        """Save as a small table (kind, prior, rates, weights)."""
        rows = [(k, self.prior[k], self.rates[k].ravel().tolist(), self.weights[k].tolist()) for k in sorted(self.prior)]
        spark.createDataFrame(rows, _MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> SpanModel:
        """A model as ``write`` left it."""
        rows = spark.read.schema(_MODEL_SCHEMA).parquet(path).collect()  # a row a kind
        return SpanModel({r.kind: r.prior for r in rows}, {r.kind: np.array(r.rates).reshape(2, -1, 3) for r in rows}, {r.kind: np.array(r.weights) for r in rows})


_MODEL_SCHEMA = "kind int, prior double, rates array<double>, weights array<double>"


def fit_labelers(rows: list[tuple[int, str, bool, int]], rounds: int = 50) -> tuple[dict[int, float], dict[int, np.ndarray], dict[tuple[int, str, bool], float]]:
    """EM over counted vote patterns (kind, votes, whether base, count): each kind's prior and rates of votes, and the posterior that a candidate with these votes is personal data.

    Two classes per kind; each labeler has its own rate of votes for, against and abstentions in each class. Base spans
    are personal data by definition: they stay in their class and show what labelers say of it.
    """
    priors: dict[int, float] = {}
    rates: dict[int, np.ndarray] = {}
    out: dict[tuple[int, str, bool], float] = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(v, b, n) for k, v, b, n in sorted(rows) if k == kind]
        n, base = np.array([c for _, _, c in own], float), np.array([b for _, b, _ in own])
        votes = np.array([[int(c) for c in v] for v, _, _ in own])
        post = np.where(base, 1.0, np.clip(0.5 + ((votes == 1).sum(1) - (votes == 0).sum(1)) / votes.shape[1], 0.05, 0.95))
        rate = np.empty((2, votes.shape[1], 3))
        for _ in range(rounds):
            prior = (0.5 + (n * post).sum()) / (1 + n.sum())
            like = np.empty((2, len(own)))
            for c, w in enumerate((n * (1 - post), n * post)):
                like[c] = np.log(prior if c else 1 - prior)
                for j in range(votes.shape[1]):
                    # one pseudo-count; a labeler is taken to be right rather than wrong
                    seen = np.array([w[votes[:, j] == v].sum() + (1.5 if v == c else 0.5) for v in range(3)])
                    rate[c, j] = seen / seen.sum()
                    like[c] += np.log(rate[c, j])[votes[:, j]]
            post = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30))))
        priors[kind], rates[kind] = float(prior), rate
        out |= {(kind, v, bool(b)): float(p) for (v, b, _), p in zip(own, post, strict=True)}
    return priors, rates, out


def fit_classifier(rows: list[tuple[int, str, float, float]], rounds: int = 25) -> dict[int, np.ndarray]:
    """Logistic regression (Newton, ridge) for each kind from (kind, features, posterior mass, count): weights by kind, the intercept first."""
    out: dict[int, np.ndarray] = {}
    for kind in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == kind)
        x = np.array([[1.0, *map(int, f)] for _, f, _, _ in own])
        n, y = np.array([r[3] for r in own], float), np.array([r[2] for r in own])
        w, scale = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (scale * (y / n - p)) - 1e-3 * w
            hess = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            w += np.linalg.solve(hess, grad)
        out[kind] = w
    return out


def scan(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Base spans and candidates with votes and features of every whole text (doc_id, text), written once: no text is in the result."""
    small_batches(docs.sparkSession)
    return ws.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, _SCAN_SCHEMA), "scan")


def _candidate_rows(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features", "c.is_base")


def fit(scanned: DataFrame) -> SpanModel:
    """Reliabilities by EM and the classifier trained on its posteriors, from counts over all candidates of ``scan``."""
    flat = _candidate_rows(scanned)
    by_votes = flat.groupBy("kind", "votes", "is_base").agg(F.count("*").alias("n")).collect()  # at most 2 * 4 * 3**6 rows
    prior, rates, posterior = fit_labelers([(r.kind, r.votes, r.is_base, r.n) for r in by_votes])
    weighed = scanned.sparkSession.createDataFrame([(*k, p) for k, p in posterior.items()] or [(-1, "", False, 0.0)], "kind int, votes string, is_base boolean, p double")
    mass = flat.groupBy("kind", "votes", "is_base", "features").agg(F.count("*").alias("n")).join(F.broadcast(weighed), ["kind", "votes", "is_base"])
    by_features = mass.groupBy("kind", "features").agg(F.sum(F.col("n") * F.col("p")).alias("m"), F.sum("n").alias("n")).collect()  # at most 4 * 4 * 2**8 rows
    return SpanModel(prior, rates, fit_classifier([(r.kind, r.features, r.m, r.n) for r in by_features]))


def find_pii(docs: DataFrame, threshold: float = 0.9, workspace: Workspace | None = None, model: SpanModel | None = None) -> DataFrame:
    """Personal data of ``docs`` (doc_id, text): base counts and hash, base and all spans in text form, candidates and how many of them were added.

    ``model`` is one that ``fit`` gave, here or elsewhere; without one it is fitted to these documents.
    """
    scanned = scan(docs, workspace or Workspace(docs.sparkSession, "pii"))
    model = model or fit(scanned)
    rows = _candidate_rows(scanned).filter("NOT is_base").select("kind", "features").distinct().collect()  # at most 4 * 4 * 2**8 rows
    accepted = sorted(f"{r.kind}{r.features}" for r in rows if model.probability(r.kind, r.features) >= threshold)
    name = F.array(*(F.lit(k) for k in KINDS))
    added = F.filter("found", lambda c: ~c.is_base & F.concat(c.kind.cast("string"), c.features).isin(accepted) if accepted else F.lit(False))
    spans = F.array_sort(F.concat("base", F.transform(added, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))))
    return scanned.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256",
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",").alias("spans"),
        F.size(added).cast("long").alias("n_added"), F.size(F.filter("found", lambda c: ~c.is_base)).cast("long").alias("n_candidates"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return find_pii(table(spark, sf_dir, "documents"))
