"""Near-duplicate documents: circulant MinHash, banding, exact verification, components.

Words are runs of non-blank bytes, A-Z lower-cased; a document's set is its distinct shingles of five words (or
its whole sequence, if shorter). Circulant MinHash uses two permutations only: sigma places a shingle on a circle
of 2**32 points, and coordinate k of the signature is the minimum of pi over the places shifted by k. Fifty bands
of five coordinates give the candidates: a pair of similarity 0.75 shares no band with probability 1.3e-6.

Equal sets are one class before anything is compared, so exact copies, however many, cost one row. In each bucket
the members are compared with the smallest one (a star, not all pairs); confirmed links are joined into
components, and in buckets that then still hold several components the members outside the largest one are held
against all others by their sketches, inside tasks. A pair that shares several buckets is asked about in the first of
them only, and members that have a likely partner are compared with it. Every link is confirmed with full shingle
sets. Nothing about documents or links is collected to the driver.

Documents without words, null texts included, are linked with nothing; rows with a null doc_id too, their
component is null and they are kept. Rows with equal doc_id are one node: what any of their texts is linked with. Sets
are compared as 64-bit hashes of shingles. Tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, flat_bytes, grouped, mix64, small_batches, table, unused, word_hashes
from corvane.llm.components import connected_components

SHINGLE, BANDS, ROWS = 5, 50, 5
#: A sketch is the low byte of each coordinate. 250 independent ones agree in a share of 0.15 less than the similarity
#: with probability under 1e-7; circulant ones vary less than independent ones.
SLACK = 0.15
#: Members, and shingles of members, of a bucket that a task holds from each side at once; larger buckets are dealt out.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, one after another, and how many each row has."""
    h, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    out = []
    if len(h) >= words:
        mixed = np.zeros(len(h) - words + 1, np.uint64)
        for j in range(words):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - words + 1 + j]
        mixed = mix64(mixed)
    for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            own = np.sort(mixed[e - n : e - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            short = np.uint64(n)
            for x in h[e - n : e]:
                short = mix64(np.array([short], np.uint64) ^ x)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def signatures(shingles: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each row with shingles; rows x coordinates of 32 bits."""
    place = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # sigma
    starts = (np.cumsum(counts) - counts).astype(np.int64)
    out = np.empty((len(counts), coordinates), np.uint32)
    # in slices that fit a core's cache
    edges = np.flatnonzero(np.diff(np.append(-1, np.cumsum(counts) // 32768)))
    for a, b in zip(edges, np.append(edges[1:], len(counts)), strict=True):
        own = place[starts[a] : starts[b - 1] + counts[b - 1]]
        at, x, y = starts[a:b] - starts[a], np.empty_like(own), np.empty_like(own)
        for k in range(coordinates):
            np.add(own, np.uint32(k), out=x)  # the circular shift
            _pi(x, y)
            out[a:b, k] = np.minimum.reduceat(x, at)
    return out


def _pi(x: np.ndarray, y: np.ndarray) -> None:
    """A fixed permutation of 32-bit words, in place."""
    x *= np.uint32(0x9E3779B1)
    np.right_shift(x, np.uint32(15), out=y)
    x ^= y
    x *= np.uint32(0x85EBCA77)
    np.right_shift(x, np.uint32(13), out=y)
    x ^= y
    x *= np.uint32(0xC2B2AE3D)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band."""
    out = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        out = mix64(out.ravel()).reshape(out.shape) ^ signature[:, j :: rows][:, :bands].astype(np.uint64)
    return mix64(out.ravel() + np.tile(np.arange(bands, dtype=np.uint64), len(signature))).reshape(out.shape)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, d1, d2, bands, sketch): d1 and d2 name the set."""
    for t in grouped(batches):
        shingles, counts = shingle_sets(*flat_bytes(t.column("b")))
        full = np.flatnonzero(counts)
        d1, d2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        bands, sketch = np.zeros((0, BANDS), np.uint64), np.zeros(0, np.uint8)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            d1[full] = np.add.reduceat(mix64(shingles), starts).view(np.int64)
            d2[full] = np.bitwise_xor.reduceat(mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93)), starts).view(np.int64)
            signature = signatures(shingles, counts[full], BANDS * ROWS)
            bands, sketch = band_hashes(signature, BANDS, ROWS), signature.astype(np.uint8).ravel()
        lengths = np.where(counts > 0, BANDS, 0)
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(bands.view(np.int64).ravel()))
        cuts = np.append(0, np.cumsum(lengths * ROWS)).astype(np.int32)
        sketches = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(sketch)])
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(counts), pa.array(d1), pa.array(d2), listed, sketches], ["doc_id", "n", "d1", "d2", "bands", "sketch"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            sets = []
            for name in ("text_a", "text_b"):
                s, n = shingle_sets(*flat_bytes(t.column(name)))
                sets.append(np.split(s, np.cumsum(n)[:-1]))
            keep = []
            for x, y in zip(*sets, strict=True):
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield from t.select(["a", "b"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("b").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("b").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("b"))
    signed = ws.save(texts.mapInArrow(_sign, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary"), "signed")
    linked = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = ws.save(linked.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # one row stands for each class, so that one copy's bands and text are used
    own = linked.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    own = ws.save(own.select("doc_id", "n", "bands", "sketch"), "own")
    members = own.select("doc_id", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = members.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.min_by("n", "doc_id").alias("head_n"), F.count("*").alias("size")).filter("size > 1")
    heads = ws.save(heads, "heads")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    first = members.join(heads, "bucket").filter("doc_id <> head").filter(fits(F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = ws.save(first, "pairs-1")
    # only members of buckets that somebody shares go on; texts move once, and only those of candidates are kept
    members = ws.save(members.join(heads.select("bucket"), "bucket", "left_semi"), "members")
    wanted = ws.save(members.select("doc_id").distinct(), "wanted")
    held = ws.save(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    links = ws.save(_confirm(first, held, percent), "links-1")
    found = ws.save(connected_components(links, ws, "cc-1"), "components-1")
    more = ws.save(_across(members, own.select("doc_id", "sketch"), held, found, ws, percent), "links-2")
    if not more.isEmpty():
        stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = ws.save(connected_components(stars.unionAll(more), ws, "cc-2"), "components-2")
    by_set = ws.save(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id")), "by-set")
    ws.keep("signed", "by-set")  # all that the result reads
    # rows without words have nothing to look up: they don't meet in one task
    out = signed.select("doc_id", "n", "d1", "d2").filter("n > 0").join(by_set, ["d1", "d2", "n"], "left").select("doc_id", "n", "component_id")
    out = out.unionByName(signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by group, in tables of whole groups of about one batch."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        edges = _edges(held)
        if len(edges) > 1:  # the last group may go on in the next batch
            yield held.slice(0, int(edges[-1]))
            held = held.slice(int(edges[-1]))
    if held is not None and held.num_rows:
        yield held


def _edges(t: pa.Table) -> np.ndarray:
    """Where the groups of a table start."""
    cols = [t.column(c).to_numpy() for c in ("bucket", "x_block", "y_block")]
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))) if t.num_rows else np.zeros(0, int)


def _likely(t: pa.Table, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in t[a:b] of pairs across components, few by many, whose sketches don't rule out the similarity and that share no earlier bucket."""
    part, band = t.slice(a, b - a), t.column("band")[a].as_py()
    sketch = flat_bytes(part.column("sketch"))[0].reshape(b - a, -1)
    n, component, few, many = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n", "component", "few", "many"))
    x, y = np.flatnonzero(few), np.flatnonzero(many)
    step, left, right = max(1, (1 << 22) // (len(y) * sketch.shape[1] + 1)), [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(x), step):
        own = x[at : at + step]
        same = (sketch[own][:, None, :] == sketch[y][None, :, :]).mean(2)
        small, large = np.minimum(n[own][:, None], n[y][None, :]), np.maximum(n[own][:, None], n[y][None, :])
        i, j = np.nonzero((same >= percent / 100 - SLACK) & (component[own][:, None] != component[y][None, :]) & (100 * small >= percent * large))
        alike = (sketch[own[i]] == sketch[y[j]]).reshape(len(i), sketch.shape[1] // ROWS, ROWS).all(2)[:, :band].any(1)  # asked about there
        left.append(own[i[~alike]])
        right.append(y[j[~alike]])
    return np.concatenate(left), np.concatenate(right)


def _hopeful(percent: int):
    """The rows of each group that have a likely partner in it: never more than came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            edges, keep = _edges(t), np.zeros(t.num_rows, dtype=bool)
            for a, b in zip(edges, np.append(edges[1:], t.num_rows), strict=True):
                for side in _likely(t, a, b, percent):
                    keep[a + side] = True
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _linked(percent: int):
    """Links of each group, confirmed with full sets; one link for each member and component it meets is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            edges = _edges(t)
            s, counts = shingle_sets(*flat_bytes(t.column("b")))
            sets, doc, component = np.split(s, np.cumsum(counts)[:-1]), t.column("doc_id").to_numpy(), t.column("component").to_numpy()
            found: set[tuple[int, int]] = set()
            for a, b in zip(edges, np.append(edges[1:], t.num_rows), strict=True):
                joined: set[tuple[int, int]] = set()
                for i, j in zip(*_likely(t, a, b, percent), strict=True):
                    i, j = a + i, a + j
                    pair = (min(component[i], component[j]), max(component[i], component[j]))
                    if pair in joined:  # these components are linked already
                        continue
                    both = np.concatenate((sets[i], sets[j]))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        joined.add(pair)
                        found.add((min(doc[i], doc[j]), max(doc[i], doc[j])))
            if found:
                rows = np.array(sorted(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    return run


def _dealt(named: DataFrame, ws: Workspace) -> DataFrame:
    """Members (bucket, band, doc_id, n, component) of buckets that hold several components, dealt into cells: those outside a bucket's largest component, the few, as x, and all as y.

    Either side is cut by its own size into parts of at most BLOCK members or BLOCK_SHINGLES shingles on average; a
    member goes to the cells of its part with each part of the other side. So beside one outsider each member moves once.
    """
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("part"), F.sum("n").alias("size"))
    largest = F.struct("part", "component")
    sizes = sizes.groupBy("bucket").agg(F.max_by("component", largest).alias("main"), F.sum("part").alias("all"), F.sum("size").alias("all_size"), F.max("part").alias("most"), F.max_by("size", largest).alias("most_size"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = sizes.select("bucket", "main", parts(F.col("all") - F.col("most"), F.col("all_size") - F.col("most_size")).alias("xs"), parts(F.col("all"), F.col("all_size")).alias("ys"))
    rows = named.join(ws.save(sizes, "main"), "bucket").withColumn("few", F.col("component") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    cells = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    as_x = F.when(F.col("few"), cells("ys", lambda k: F.struct(place("xs").alias("x_block"), k.alias("y_block")))).otherwise(F.array().cast("array<struct<x_block:int,y_block:int>>"))
    as_y = cells("xs", lambda k: F.struct(k.alias("x_block"), place("ys").alias("y_block")))
    rows = rows.select("bucket", "band", "doc_id", "n", "component", "few", place("xs").alias("x"), place("ys").alias("y"), F.explode(F.array_distinct(F.concat(as_x, as_y))).alias("cell"))
    return rows.select("bucket", "band", "cell.x_block", "cell.y_block", "doc_id", "n", "component", (F.col("few") & (F.col("cell.x_block") == F.col("x"))).alias("few"), (F.col("cell.y_block") == F.col("y")).alias("many"))


def _across(members: DataFrame, sketches: DataFrame, texts: DataFrame, found: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """Links between different components of a bucket: members outside the largest one against all others.

    Large buckets are worked on in cells (``_dealt``). A first pass finds the members with a likely partner; only their
    texts are brought together, and pairs stay inside tasks.
    """
    named = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    named = ws.save(named, "named")
    open_ = ws.save(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket"), "open")
    rows = _dealt(ws.save(named.join(open_, "bucket"), "open-members"), ws)
    rows = rows.join(sketches, "doc_id").select("bucket", "band", "x_block", "y_block", "doc_id", "n", "component", "few", "many", "sketch")
    keys = ["bucket", "x_block", "y_block"]
    kinds = "bucket long, band int, x_block int, y_block int, doc_id long, n long, component long, few boolean, many boolean, sketch binary"
    hopeful = ws.save(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_hopeful(percent), kinds), "hopeful")
    told = hopeful.join(texts, "doc_id").select("bucket", "band", "x_block", "y_block", "doc_id", "n", "component", "few", "many", "sketch", "b")
    return told.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(percent), "a long, b long").distinct()


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id."""
    name = unused("gone", docs)
    verdict = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    gone = Workspace(docs.sparkSession, "minhash-gone").save(verdict, "gone")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), reps AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), items AS (SELECT rep, n, unnest(s) AS x FROM reps),
hot AS (SELECT x FROM items GROUP BY x HAVING count(*) > 1),
shared AS (
  SELECT p.rep AS a, q.rep AS b, any_value(p.n) + any_value(q.n) AS total, count(*) AS c
  FROM items p JOIN hot USING (x) JOIN items q ON p.x = q.x AND p.rep < q.rep AND 100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n) GROUP BY p.rep, q.rep
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (total - c)),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
by_set AS (SELECT r.s, coalesce(t.root, r.rep) AS root FROM reps r LEFT JOIN roots t ON t.node = r.rep)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(b.root, d.doc_id) AS component_id, d.doc_id = coalesce(b.root, d.doc_id) AS kept
FROM sets d LEFT JOIN by_set b ON list_sort(d.s) = b.s
"""
