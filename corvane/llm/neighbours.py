"""Approximate nearest neighbours by inner product: a forest of random-projection trees with a shared queue.

Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm, which turns the largest inner product
into the smallest angle. Trees split at the median of the projection on the difference of two random vectors, down to
``LEAF`` vectors; they are fitted on at most ``SAMPLE`` vectors (65,536, chosen by a hash of the id). Every vector is
then indexed: one cell per tree. A query keeps one queue over all trees, of subtrees by the squares of the margins it
crosses to reach them, and opens the nearest until the opened cells hold its share of all cells' entries. That share is
set on the driver: the least with which queries of the sample reach ``recall`` (0.95) against brute force in the sample.

Queries are the stated set: blocks of at most about ``QUERIES`` of them meet all vectors in ``SPLITS`` streams. A stream
holds its block and each query's best 21 so far, so that what leaves a task is 21 rows a query, however many cells it has
opened; a vector is scored for the queries that opened one of its cells. Kept scores are sums in double precision, term
after term, so they don't depend on how rows are batched.

Equal vectors are one entry, so copies, however many, don't crowd a cell; of each entry the 21 smallest ids are
enough for 20 neighbours. Vectors that are null, zero or hold null or non-finite components take no part. Vectors of
each length have a forest of their own and are searched by the queries of that length. Repeated ids are one vector each
by value, so repeated rows count once. An empty table gives no rows; fewer candidates than asked for give them all. Ties
go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import Workspace, small_batches, table

TREES, LEAF, SAMPLE = 8, 32, 1 << 16
#: Queries that meet all vectors at once, in how many streams, and how many vectors of a stream are scored at once.
QUERIES, SPLITS, ROWS = 4096, 8, 1024


class Tree:
    """Splits in arrays: node i has direction[i], threshold[i] and two children; negative children are cells."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        self.direction: list[np.ndarray] | np.ndarray = []
        self.threshold: list[float] | np.ndarray = []
        self.child: list[list[int]] = []
        self.cells = 0
        self.root = self._grow(x, np.arange(len(x)), depth, rng)
        self.direction, self.threshold = np.array(self.direction).reshape(-1, x.shape[1]), np.array(self.threshold)

    def _cell(self) -> int:
        self.cells += 1
        return -self.cells

    def _grow(self, x: np.ndarray, own: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if not depth or len(own) < 2:
            return self._cell()
        a, b = rng.choice(own, 2, replace=False)
        w = x[a] - x[b]
        norm = np.linalg.norm(w)
        if norm == 0:
            return self._cell()
        p = x[own] @ (w / norm)
        t = float(np.median(p))
        low = p <= t
        if low.all():
            low = p < t
        if low.all() or not low.any():
            return self._cell()
        node = len(self.direction)
        self.direction.append(w / norm)
        self.threshold.append(t)
        self.child.append([0, 0])
        self.child[node] = [self._grow(x, own[low], depth - 1, rng), self._grow(x, own[~low], depth - 1, rng)]
        return node

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.full(len(x), self.root)
        if not len(self.child):
            return -at - 1
        child = np.array(self.child)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            at[inner] = child[k, (np.einsum("ij,ij->i", x[inner], self.direction[k]) > self.threshold[k]).astype(int)]
        return -at - 1

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Rows x cells: the squares of the margins between each row and each cell, summed."""
        out = np.zeros((len(q), self.cells))
        above = {self.root: np.zeros(len(q))} if self.child else {}
        sides = q @ self.direction.T - self.threshold
        for node in range(len(self.child)):  # parents come first
            far, s = above.pop(node), sides[:, node]
            for child, wrong in zip(self.child[node], (s > 0, s <= 0), strict=True):
                cost = far + np.where(wrong, s * s, 0.0)
                if child >= 0:
                    above[child] = cost
                else:
                    out[:, -child - 1] = cost
        return out


class Forest:
    """Trees, the augmenting norm, and how many vectors each cell holds."""

    def __init__(self, x: np.ndarray, norm: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.norm = norm
        y = self.lift(x)
        self.depth = max(0, int(np.log2(max(len(x), 1) / LEAF)))
        self.trees = [Tree(y, self.depth, rng) for _ in range(TREES)]
        self.offsets = np.append(0, np.cumsum([t.cells for t in self.trees])).astype(int)
        self.sizes = np.zeros(int(self.offsets[-1]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all norms equal."""
        return np.column_stack((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))))

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        """Queries of the common norm; they have no missing norm to fill."""
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        return np.column_stack((np.where(norm > 0, q / np.where(norm > 0, norm, 1) * self.norm, q), np.zeros(len(q))))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees: the cells of vectors, numbered through all trees."""
        y = self.lift(x)
        return np.column_stack([t.cell_of(y) + o for t, o in zip(self.trees, self.offsets, strict=False)])

    def visit(self, q: np.ndarray, share: float) -> list[list[int]]:
        """Cells to search for each query, nearest subtrees first over all trees, until they hold ``share`` of all entries."""
        want, out = share * self.sizes.sum(), []
        lifted = self.lift_queries(q)
        sides = [(lifted @ t.direction.T - t.threshold).tolist() for t in self.trees]
        children, sizes, offsets = [t.child for t in self.trees], self.sizes.tolist(), self.offsets.tolist()
        for i in range(len(q)):
            heap = [(0.0, t, tree.root) for t, tree in enumerate(self.trees)]
            have, opened = 0.0, []
            while heap and (have < want or not opened):
                far, t, node = heapq.heappop(heap)
                child, side = children[t], sides[t][i]
                while node >= 0:
                    s = side[node]
                    near = s > 0
                    heapq.heappush(heap, (far + s * s, t, child[node][not near]))
                    node = child[node][near]
                opened.append(offsets[t] - node - 1)
                have += sizes[opened[-1]]
            out.append(opened)
        return out


def calibrate(forest: Forest, x: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
    """The least share of entries with which queries of the sample find ``recall`` of their ``k`` nearest in the sample."""
    if len(x) <= 2 * k:
        return 1.0
    cells = forest.cells(x)
    sizes = np.bincount(cells.ravel(), minlength=forest.offsets[-1]).astype(float)
    need = []
    for q in np.array_split(np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int), 20):  # a few at a time, for the driver's memory
        scores = x[q] @ x.T
        scores[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(scores, len(x) - k, axis=1)[:, len(x) - k :]
        lifted = forest.lift_queries(x[q])
        far = np.concatenate([t.distances(lifted) for t in forest.trees], axis=1)
        for i, row in enumerate(best):
            order = np.argsort(far[i], kind="stable")
            before = np.empty(len(order))
            before[order] = np.cumsum(sizes[order]) - sizes[order]  # entries that are opened before each cell
            need.append(before[cells[row]].min(1))
    needed = float(np.quantile(np.concatenate(need), recall, method="higher"))
    return min(1.0, (needed + 0.5) / sizes.sum())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The best ``most`` entries so far of each query of a block, by exact score, then entry."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, opened: list[np.ndarray], cells: int, most: int) -> None:
        self.ids, self.q, self.most = ids, q, most
        self.opened = np.zeros((cells, len(ids)), dtype=bool)
        for i, c in enumerate(opened):
            self.opened[c, i] = True
        self.norms = np.linalg.norm(q, axis=1)
        self.worst = np.full(len(ids), -np.inf)
        self.row, self.entry, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, entry: np.ndarray, v: np.ndarray, cells: np.ndarray) -> None:
        """Score vectors for the queries that opened one of their cells."""
        mask = self.opened[cells[:, 0]]
        for t in range(1, cells.shape[1]):
            mask |= self.opened[cells[:, t]]
        asked = np.flatnonzero(mask.any(0))
        if not len(asked):
            return
        rough = np.where(mask[:, asked], v @ self.q[asked].T, -np.inf)
        # what rounding can make of equal sums: rough scores only rule out
        slack = 1e-10 * self.norms[asked] * np.linalg.norm(v, axis=1).max()
        least = self.worst[asked]
        if len(v) > self.most:
            least = np.maximum(least, -np.partition(-rough, self.most - 1, axis=0)[self.most - 1])
        j, i = np.nonzero((rough >= least - slack) & (rough > -np.inf))
        if not len(j):
            return
        row, exact = asked[i], np.zeros(len(j))
        for d in range(v.shape[1]):
            exact += self.q[row, d] * v[j, d]
        touched = np.zeros(len(self.ids), dtype=bool)
        touched[row] = True
        old = touched[self.row]
        row, new, exact = np.concatenate((self.row[old], row)), np.concatenate((self.entry[old], entry[j])), np.concatenate((self.score[old], exact))
        order = np.lexsort((new, -exact, row))
        row, new, exact = row[order], new[order], exact[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = rank == self.most - 1
        self.worst[row[last]] = exact[last]
        keep = rank < self.most
        self.row, self.entry, self.score = np.concatenate((self.row[~old], row[keep])), np.concatenate((self.entry[~old], new[keep])), np.concatenate((self.score[~old], exact[keep]))

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.entry), pa.array(self.score)], ["query_id", "entry", "score"])


def _compare(cells: int, most: int):
    """Rows sorted by slot, queries before vectors: each slot's best pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, waiting, best = None, [], None
        for b in batches:
            slots, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1]))) if b.num_rows else []
            for a, z in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if slots[a] != slot:
                    if best is not None:
                        yield best.out()
                    slot, waiting, best = slots[a], [], None
                part = b.slice(a, z - a)
                if kinds[a] == 0:
                    waiting.append((part.column(2).to_numpy(), _matrix(part.column(3)), [np.asarray(x.values) for x in part.column(4)]))
                    continue
                if best is None and waiting:
                    best = Best(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), [c for w in waiting for c in w[2]], cells, most)
                    waiting = []
                for at in range(0, part.num_rows if best is not None else 0, ROWS):
                    some = part.slice(at, ROWS)
                    best.add(some.column(2).to_numpy(), _matrix(some.column(3)), some.column(4).flatten().to_numpy().reshape(some.num_rows, -1))
        if best is not None:
            yield best.out()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each of ``queries`` (vec_id, embedding) among ``vectors``, itself excluded."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    own, asked = clean(vectors), clean(queries)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = own.groupBy(F.size("v").alias("length")).count().join(asked.select(F.size("v").alias("length")).distinct(), "length", "left_semi").collect()
    for found in [_nearest(own.filter(F.size("v") == r.length), asked.filter(F.size("v") == r.length), k, recall) for r in lengths]:
        out = found if len(lengths) == 1 else out.unionAll(found)
    return out


def _nearest(own: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    """``nearest`` for clean vectors (vec_id, v) of one length."""
    spark = own.sparkSession
    ws = Workspace(spark, "ann")
    hashed = lambda df: df.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # the smallest ids of equal vectors, each once however often its row is repeated; both limits are applied before their shuffles too
    single = lambda df: df.withColumn("m", F.row_number().over(Window.partitionBy("h1", "h2", "vec_id").orderBy("vec_id"))).filter("m = 1")
    few = single(hashed(own)).withColumn("m", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("m") <= k + 1)
    members = ws.save(few, "members")
    entries = members.filter("m = 1").select(F.col("vec_id").alias("entry"), "v")
    norm = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks())
    forest = Forest(x, float(norm))
    share = calibrate(forest, x, k, recall)
    del sample, x
    index = spark.sparkContext.broadcast(forest)  # of a size bound by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = index.value.cells(_matrix(b.column(1)))
                listed = pa.ListArray.from_arrays(pa.array((np.arange(len(cells) + 1) * cells.shape[1]).astype(np.int32)), pa.array(cells.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed], ["id", "v", "cells"])

    kinds = "id long, v array<double>, cells array<int>"
    placed = ws.save(entries.mapInArrow(place, kinds), "placed")
    for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # cells are bounded by the sample
        forest.sizes[r.cell] = r["count"]
    sized = spark.sparkContext.broadcast(forest)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                cells = sized.value.visit(_matrix(part.column(1)), share)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.list_(pa.int32()))], ["id", "v", "cells"])

    # few bytes but much work a row: as many tasks as a shuffle has, however small they are
    spread = single(hashed(asked)).select(F.col("vec_id").alias("id"), "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    visits = ws.save(spread.mapInArrow(search, kinds), "visits")
    blocks = -(-visits.count() // QUERIES) or 1
    row = lambda df, kind, block, split: df.select((block * SPLITS + split).alias("slot"), F.lit(kind).alias("kind"), "id", "v", "cells")
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = row(visits.withColumn("split", every(SPLITS)), 0, part(blocks), F.col("split"))
    right = row(placed.withColumn("block", every(blocks)), 1, F.col("block"), part(SPLITS))
    slots = left.unionByName(right).repartitionById(blocks * SPLITS, F.col("slot")).sortWithinPartitions("slot", "kind", F.element_at("cells", 1))
    found = slots.mapInArrow(_compare(int(forest.offsets[-1]), k + 1), "query_id long, entry long, score double")
    found = found.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id")
    found = found.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "entry"))).filter(F.col("r") <= k + 1).drop("r")
    ids = members.select("vec_id", "h1", "h2").join(members.filter("m = 1").select("h1", "h2", F.col("vec_id").alias("entry")), ["h1", "h2"]).select("entry", "vec_id")
    out = found.join(ids, "entry").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
