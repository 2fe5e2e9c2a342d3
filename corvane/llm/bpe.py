"""BPE encoding and decoding through a minimal acyclic transducer.

Texts are cut at the tokenizer's added tokens and split into words by the byte-level pattern. All words are counted
over all texts; those of 64 bytes or less that make up a 2**-18 share of the corpus or more (so at most 2**18 of them)
are compiled, with their ids, into a minimal acyclic automaton with shared suffixes: numbers on its arcs add up to a
word's index, and the index gives its ids. The automaton is one file, made in the shared folder, that Spark hands to the
executors and that they map into memory; the distinct words of a batch walk it side by side. Words it lacks are merged
pair by pair, lowest rank first.

Only tokenizer files of the kind this module re-creates are taken: byte-level BPE without normalizer, dropout, unknown
token or prefix space, whose added tokens match as they are written. Others are refused, not encoded differently.

Null texts are empty: no tokens. Empty tables give no rows; repeated rows are encoded each by itself. Further columns
of the documents don't reach the result, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, flat_bytes, grouped, small_batches, table

# Fixed value: the splitting pattern of byte-level BPE.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A word is frequent if its share of the corpus is 2**-LEXICON_BITS or more.
LEXICON_BITS = 18
#: Bytes of a frequent word at most, distinct words that a task counts at once, and bytes of text that it works on at once.
LONGEST, HELD, BATCH = 64, 300_000, 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refuse_unknown(raw: dict) -> None:
    """Raise ValueError for settings of a tokenizers file that would give other ids than this module's."""
    model = raw["model"]
    steps = [raw.get("pre_tokenizer"), raw.get("decoder")]
    wrong = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": raw.get("normalizer") is not None,
        "pre_tokenizer": steps[0] is None or steps[0].get("type") != "ByteLevel" or steps[0].get("add_prefix_space", False) or not steps[0].get("use_regex", True),
        "decoder": steps[1] is None or steps[1].get("type") != "ByteLevel",
        "merging": any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get(k) for t in raw.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")) or any(not t["content"] for t in raw.get("added_tokens", [])),
    }
    if any(wrong.values()):
        raise ValueError(f"this tokenizer file has settings that are not supported: {', '.join(k for k, v in wrong.items() if v)}")


class Splitter:
    """Cuts a text at added tokens and into words; small enough to be handed to every task."""

    def __init__(self, added: list[str]) -> None:
        self.added = tuple(sorted(added, key=lambda s: (-len(s), s)))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if added else None

    def __reduce__(self):
        return Splitter, (list(self.added),)

    def __call__(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order."""
        if self.cut is None or not any(s in text for s in self.added):
            return _SPLIT.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else _SPLIT.findall(part)
        return out


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, raw: dict) -> None:
        refuse_unknown(raw)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in raw["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for b, i in self.ids.items():
            self.tokens[i] = b
        for s, i in self.added.items():
            self.tokens[i] = s.encode()
        self.split = Splitter(list(self.added))
        # where ids follow the merges, the id of the merged token is its rank, and a compiled merger can be used
        place = [self.ids[a + b] for a, b in self.ranks]
        self.by_id = place == sorted(place) and len(set(place)) == len(place) and all(self.ids[bytes([b])] < place[0] for b in range(256)) if place else False
        self._merger = None

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: join the neighbours with the lowest rank, leftmost first, until none can be joined."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [self.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranked)
            if least == 1 << 60:
                break
            joined, i = [], 0
            while i < len(parts):
                if i < len(ranked) and ranked[i] == least and (parts[i], parts[i + 1]) in self.ranks:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return [self.ids[p] for p in parts]

    def merger(self):
        """The fastest exact merging function for this vocabulary."""
        if not self.by_id:
            return self.merge
        if self._merger is None:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._core_bpe
            self._merger = core.encode_single_piece
        return self._merger


# ---- the automaton --------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> np.ndarray:
    """A minimal acyclic automaton of ``words`` with their ids, as one array of whole numbers.

    Words are added in order; when the next word leaves a branch, the branch's states are replaced, from the end
    up, by equal states that exist already. Layout: five lengths, then arcs (state * 256 + byte, ascending), their
    targets and numbers, final states, and the ids of word k between two offsets.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, child) of the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (final[child], *arcs[child].items())
            if key in known:
                arcs[parent][byte] = known[key]
                if child == len(arcs) - 1:
                    arcs.pop()
                    final.pop()
            else:
                known[key] = child

    last, ordered = b"", sorted(words)
    for word in ordered:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else 0
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # how many words end at or below each state
        s = stack[-1]
        todo = [c for c in arcs[s].values() if c not in below]
        if todo:
            stack += todo
        else:
            below[s] = final[s] + sum(below[c] for c in arcs[s].values())
            stack.pop()
    number = {s: i for i, s in enumerate(sorted(below))}
    keys, targets, outputs = [], [], []
    for s in sorted(below):
        skipped = int(final[s])
        for byte, child in sorted(arcs[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[child])
            outputs.append(skipped)
            skipped += below[child]
    ids = [words[w] for w in ordered]
    offsets = np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64)) if ids else np.zeros(1, np.int64)
    flat = np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    head = [len(keys), len(number), len(ids), len(flat), max(map(len, words), default=0)]
    return np.concatenate([np.array(x, np.int64) for x in (head, keys, targets, outputs, [final[s] for s in sorted(below)], offsets, flat)])


class Lexicon:
    """A compiled lexicon, walked by many words at once."""

    def __init__(self, raw: np.ndarray) -> None:
        a, s, w, n, self.longest = (int(x) for x in raw[:5])
        self.n_states, cuts = s, np.cumsum([5, a, a, a, s, w + 1, n])
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = (raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The index of each row's word, -1 where the lexicon lacks it."""
        lengths = np.diff(offsets)
        out = np.full(len(lengths), -1, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(self.keys):
            return out
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for p in range(self.longest):
            done = lengths[live] == p
            if done.any():
                ends = done & (self.final[state] == 1)
                out[live[ends]] = total[ends]
                live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
            key = state * 256 + data[offsets[live] + p]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            live, state, total = live[ok], self.targets[k[ok]], total[ok] + self.outputs[k[ok]]
        ends = self.final[state] == 1
        out[live[ends]] = total[ends]
        return out


def encode_words(distinct: pa.Array, lexicon: Lexicon, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after another, and how many each has."""
    data, offsets = flat_bytes(distinct.cast(pa.binary()))
    index = lexicon.find(data, offsets)
    lengths, starts = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    hit = np.flatnonzero(index >= 0)
    lengths[hit] = lexicon.offsets[index[hit] + 1] - lexicon.offsets[index[hit]]
    listed = lexicon.ids[spread(lexicon.offsets[index[hit]], lengths[hit])]  # only the ids in use leave the file
    starts[hit] = np.cumsum(lengths[hit]) - lengths[hit]
    merge, more, raw = vocabulary.merger(), [], data.tobytes()
    at = len(listed)
    miss = np.flatnonzero(index < 0)
    special = {s.encode(): [i] for s, i in vocabulary.added.items()}
    for k, a, b in zip(miss.tolist(), offsets[miss].tolist(), offsets[miss + 1].tolist(), strict=True):
        word = raw[a:b]
        ids = special.get(word) or merge(word)
        starts[k], lengths[k] = at + len(more), len(ids)
        more += ids
    pool = np.concatenate((listed, np.array(more, np.int64)))
    return pool[spread(starts, lengths)], lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def encode_texts(texts: list[str | None], lexicon: Lexicon, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the offsets of each."""
    words, counts = [], []
    for text in texts:
        own = vocabulary.split(text) if text else []
        words += own
        counts.append(len(own))
    if not words:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    coded = pa.array(words, pa.string()).dictionary_encode()
    ids, lengths = encode_words(coded.dictionary, lexicon, vocabulary)
    code = coded.indices.to_numpy()
    per_word = lengths[code]
    starts = (np.cumsum(lengths) - lengths)[code]
    ends = np.append(0, np.cumsum(per_word))
    return ids[spread(starts, per_word)], ends[np.append(0, np.cumsum(counts))]


def frequent_words(docs: DataFrame, vocabulary: Vocabulary) -> dict[bytes, list[int]]:
    """The corpus's frequent words with their ids; at most 2**LEXICON_BITS. Counts are exact: tasks add up their own, Spark the rest."""
    split = vocabulary.split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.encode() for w in counts]
            return pa.RecordBatch.from_arrays([pa.array([w if len(w) <= LONGEST else None for w in words], pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for t in grouped(batches, BATCH):
            for text in t.column(0).to_pylist():
                if text:
                    counts.update(split(text))
            if len(counts) > HELD:  # bounded memory
                yield out()
                counts.clear()
        if counts:
            yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ws = Workspace(docs.sparkSession, "bpe")
    counted = ws.save(counted, "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counted.filter(F.col("word").isNotNull() & (F.col("n") >= max(2, -(-total // (1 << LEXICON_BITS))))).toArrow()
    ws.keep()
    merge, special = vocabulary.merger(), {s.encode() for s in vocabulary.added}
    return {w: merge(w) for w in rows.column("word").to_pylist() if w not in special}


class Codec:
    """The lexicon and vocabulary of one task; it goes with the task, since workers live on."""

    def __init__(self, raw_vocabulary: str, lexicon_name: str) -> None:
        self.vocabulary = Vocabulary(json.loads(raw_vocabulary))
        if self.vocabulary.by_id:
            self.vocabulary.merger()
            self.vocabulary.ranks = {}  # the compiled merger has its own
        self.lexicon = Lexicon(np.load(SparkFiles.get(lexicon_name), mmap_mode="r"))


def share_file(spark: SparkSession, path: str, content: np.ndarray) -> str:
    """Write an array to ``path`` in the shared folder and have Spark hand it to every executor, also later ones; its name there."""
    held = io.BytesIO()
    np.save(held, content)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for at in range(0, len(held.getbuffer()), 1 << 20):
            out.write(bytes(held.getbuffer()[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256 of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    vocabulary = Vocabulary(json.loads(raw))
    compiled = compile_lexicon(frequent_words(docs, vocabulary))
    name = share_file(spark, f"{Workspace(spark, 'bpe').root}/lexicon-{uuid.uuid4().hex}.npy", compiled)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, name)
        tokens = codec.vocabulary.tokens
        shown = [str(i) for i in range(len(tokens))]
        for t in grouped(batches, BATCH):
            ids, offsets = encode_texts(t.column("text").to_pylist(), codec.lexicon, codec.vocabulary)
            first, second = [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                own = ids[a:b].tolist()
                first.append(hashlib.sha256(",".join(map(shown.__getitem__, own)).encode()).hexdigest())
                second.append(hashlib.sha256(b"".join(map(tokens.__getitem__, own)).decode("utf-8", "replace").encode()).hexdigest())
            columns = [t.column("doc_id").combine_chunks(), pa.array(np.diff(offsets))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first), pa.array(second)], ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    from corvane.llm.chat import tokenizer_file

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)
