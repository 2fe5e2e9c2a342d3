"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``<|turn|>role<|text|>text<|end|>`` per turn, encoded once with offsets, and
the tokens that carry loss are found by intersecting the sorted spans of assistant texts with the sorted token
spans by binary search. The three markers are added tokens of the tokenizer, so a token never crosses the edge
of a text. Inside roles and texts every ``<|`` becomes ``<\\|`` (and a backslash is added where some already stand
between ``<`` and ``|``), which is undone exactly.

Rows of a conversation are ordered by turn (nulls first), then role and text. Null role or text: empty; rows
with a null conv_id form one conversation; repeated rows are turns like others. Conversations are streamed from sorted
partitions: a very long one is encoded in pieces cut at turns, which added tokens make equal to encoding it whole, so
digests need bounded memory; a formatted conversation is one row, however long. Tables without rows give no rows.
Further columns, whatever their names, don't reach the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
PIECE = 1 << 20


def escape(text: str) -> str:
    """Make control strings in ``text`` harmless."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _SHUT.sub(r"<\1|", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the (start, end) spans of its assistant texts, in order."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def mask_of(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint ``spans``; both are (start, end) rows in order."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), dtype=bool)
    k = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")  # the first span that ends after the token starts
    inside = k < len(spans)
    inside[inside] = spans[k[inside], 0] < tokens[inside, 1]
    return inside & (tokens[:, 1] > tokens[:, 0])


def masked_text(text: str, tokens: np.ndarray, mask: np.ndarray) -> str:
    """The text under masked tokens; tokens that share a character count it once."""
    own = tokens[mask]
    if not len(own):
        return ""
    start = np.maximum(own[:, 0], np.append(0, np.maximum.accumulate(own[:, 1])[:-1]))  # what earlier tokens cover is theirs
    more = own[:, 1] > start
    start, end = start[more], own[more, 1]
    first = np.flatnonzero(np.append(True, start[1:] != end[:-1])) if len(start) else np.zeros(0, int)
    last = np.append(first[1:], len(start)) - 1
    return "".join(text[a:b] for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


def load_tokenizer(path: str):
    """The tokenizer at ``path`` with the template's markers as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return t


class _Digest:
    """What one conversation's output gives, read back piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars, self.tokens, self.loss_tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0

    def add(self, text: str, spans: np.ndarray, tokenizer) -> None:
        e = tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        mask = mask_of(offsets, spans)
        under = unescape(masked_text(text, offsets, mask))
        for role, body in parse(text):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
        self.loss.update(under.encode())
        self.loss_chars += len(under)
        self.chars += len(text)
        self.tokens += len(offsets)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens


_DIGEST_NAMES = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")


def _ordered(rows: DataFrame) -> DataFrame:
    """Whole conversations in order within partitions; the sort spills, nothing is collected."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
    """(conv_id, turns, whether the conversation ends) in pieces of about PIECE characters."""
    have, current, turns, size = False, None, [], 0
    for batch in batches:
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if have and c != current:
                yield current, turns, True
                turns, size = [], 0
            elif size > PIECE:
                yield current, turns, False
                turns, size = [], 0
            have, current = True, c
            turns.append((role, text))
            size += len(text)
    if have:
        yield current, turns, True


def format_chats(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation: conv_id, formatted, token ids, loss mask by token."""
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        parts: list[str] = []
        ids: list[np.ndarray] = []
        masks: list[np.ndarray] = []
        for c, turns, ends in _conversations(batches):
            text, spans = render(turns)
            e = tokenizer.encode(text, add_special_tokens=False)
            parts.append(text)
            ids.append(np.array(e.ids, np.int32))
            masks.append(mask_of(np.array(e.offsets, np.int64).reshape(-1, 2), spans))
            if ends:
                listed = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.array(np.concatenate(x))) for x in (ids, masks)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array(["".join(parts)]), *listed], ["conv_id", "formatted", "ids", "loss_mask"])
                parts, ids, masks = [], [], []

    return _ordered(conversations).mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>")


def chat_digests(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """What is read back from each formatted, encoded and masked conversation."""
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        ids, rows, digest = [], [], _Digest()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in _DIGEST_NAMES]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", *_DIGEST_NAMES])

        for c, turns, ends in _conversations(batches):
            digest.add(*render(turns), tokenizer)
            if ends:
                ids.append(c)
                rows.append(digest.row())
                digest = _Digest()
            if len(rows) >= 1000:
                yield out()
                ids, rows = [], []
        if rows:
            yield out()

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -1 with control strings of another template in its texts."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra), tokenizer_file()).drop("n_tokens", "n_loss_tokens")


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), escaped AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
