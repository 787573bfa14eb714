"""Approximate nearest neighbours by balanced posting lists (operator 5).

A sample of at most SAMPLE vectors is cut in two by 2-means, always the largest part next, until parts hold about
LIST vectors of the whole table each: balanced clusters, whose centroids (at most LISTS_MOST) go to all tasks. Centroids
are searched by best-first search in a graph that joins each to its nearest ones. A vector is listed in its nearest
cluster and, when it lies near a boundary, in up to COPIES clusters whose distance is within BOUNDARY of the nearest.
A query searches the graph for a bounded number of centroids and reads those lists whose distance is within a ratio of
the nearest one. Both bounds are calibrated on sampled queries so that RECALL of their true neighbours in the sample lie
in lists that are read; recall against brute force, and how much is read for it, are in the README. A query whose lists
don't hold k others for certain searches on with a larger bound, so it gets k if there are so many. Lists are dealt to
cells of at most about BLOCK vectors and BLOCK queries, each task gives the best k of each query over its cells, and a
query's best k over the tasks are its result. Vectors of another length than the commonest have one list for each length, which all
queries of that length read: their neighbours are exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
no part; vectors are only compared with those of their length; a query never finds its own row, but finds equal vectors
and other rows of its id; rows that repeat an id are rows of their own, as queries (each has its own k) and as what is
found; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.near_vectors import matrix, runs, unit, usable
from shoebox.llm.tables import materialize

SAMPLE, LIST, LISTS_MOST, DEGREE, AT_ONCE = 20_000, 64, 4_096, 16, 8
COPIES, BOUNDARY, RECALL, BLOCK, PROBES_LEAST, HELD = 2, 1.15, 0.945, 2_048, 8, 500_000


def balanced_centroids(x: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Unit centroids of `count` parts, made by cutting the largest part in two until there are enough."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < count:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        ends = x[rng.choice(own, 2, replace=False)]
        for _ in range(8):
            lean = x[own] @ (ends[0] - ends[1])
            near = lean >= np.median(lean)  # halves, so that no part runs empty
            if near.all():
                near[: len(near) // 2] = False
            ends = np.stack([x[own[near]].sum(0), x[own[~near]].sum(0)])
            ends /= np.maximum(np.linalg.norm(ends, axis=1, keepdims=True), 1e-12)
        parts += [own[near], own[~near]]
    c = np.stack([x[p].sum(0) for p in parts])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class CentroidGraph:
    """Best-first search over centroids, many queries at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        near = centroids @ centroids.T
        np.fill_diagonal(near, -np.inf)
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        self.next = np.argsort(-near, axis=1, kind="stable")[:, :degree] if degree else np.zeros((n, 0), np.int64)
        # a ring through all centroids keeps the graph in one piece
        self.next = np.concatenate((self.next, ((np.arange(n) + 1) % n)[:, None]), axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))

    def search(self, u: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best centroids found for each row of u, best first, and their distances.

        Of the `width` best met so far those not opened yet are opened, AT_ONCE at a time, until none is left.
        """
        n, rows = len(self.centroids), np.arange(len(u))[:, None]
        width = min(width, n)
        seen = np.zeros((len(u), n), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(u), 1))
        score = u @ self.centroids[self.entries].T
        closed = np.zeros(ids.shape, bool)
        while not closed.all():
            ranked = np.where(closed, -np.inf, score)
            some = min(AT_ONCE, ids.shape[1])
            pick = np.argpartition(-ranked, some - 1, axis=1)[:, :some]
            live = ~closed[rows, pick]
            closed[rows, pick] = True
            # what is not live opens an entry again, which has nothing new
            around = np.where(live[:, :, None], self.next[ids[rows, pick]], self.entries[0]).reshape(len(u), -1)
            around.sort(axis=1)
            fresh = ~seen[rows, around]
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            seen[rows, around] = True
            r, c = np.nonzero(fresh)
            new = np.full(around.shape, -np.inf)
            new[r, c] = np.einsum("nd,nd->n", u[r], self.centroids[around[r, c]])
            ids, score, closed = np.concatenate((ids, around), 1), np.concatenate((score, new), 1), np.concatenate((closed, ~fresh), 1)
            if ids.shape[1] > width:
                best = np.argpartition(-score, width - 1, axis=1)[:, :width]
                ids, score, closed = ids[rows, best], score[rows, best], closed[rows, best]
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = ids[rows, order], score[rows, order]
        return ids, np.where(np.isfinite(score), np.sqrt(np.maximum(2 - 2 * score, 1e-12)), np.inf)

    def lists(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of vectors: (row, list) pairs."""
        ids, far = self.search(u, max(16, 4 * COPIES))
        keep = far <= BOUNDARY * far[:, :1]
        keep[:, 0], keep[:, COPIES:] = True, False
        row, column = np.nonzero(keep)
        return row, ids[row, column]

    def probes(self, u: np.ndarray, ratio: float, width: int, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists that queries read: (row, list) pairs. Where near lists are short, further ones follow until they
        hold k others for certain, a vector being in COPIES lists at most: the search's width grows for those queries."""
        rows, out = np.arange(len(u)), []
        while len(rows):
            ids, far = self.search(u[rows], width)
            held = np.cumsum(np.where(np.isfinite(far), sizes[ids], 0), axis=1)
            keep = (far <= ratio * far[:, :1]) | (held - sizes[ids] < COPIES * (k + 1))
            keep[:, :PROBES_LEAST] = True
            done = (held[:, -1] >= COPIES * (k + 1)) | (width >= len(self.centroids))
            row, column = np.nonzero(keep & np.isfinite(far) & done[:, None])
            out.append((rows[row], ids[row, column]))
            rows, width = rows[~done], 2 * width
        return np.concatenate([np.zeros(0, np.int64), *(r for r, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(i for _, i in out)])


def calibrate(graph: CentroidGraph, sample: np.ndarray, k: int) -> tuple[float, int]:
    """The ratio and the width at which RECALL of sampled queries' true neighbours in the sample lie in a list that is
    read."""
    step = max(1, len(sample) // 256)
    queries, k = sample[::step], min(k, len(sample) - 1)
    if k < 1:
        return 1.0, PROBES_LEAST
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(0, len(sample), step)] = -np.inf
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    of: dict[int, list[int]] = {}
    for at in range(0, len(sample), 1_000):  # as few rows at a time as in a task
        row, lists = graph.lists(sample[at : at + 1_000])
        for r, c in zip(row.tolist(), lists.tolist()):
            of.setdefault(at + r, []).append(c)
    far = np.sqrt(np.maximum(2 - 2 * queries @ graph.centroids.T, 1e-12))
    place = np.argsort(np.argsort(far, axis=1), axis=1)  # how many lists are nearer
    found = [(far[q, of[v]].min() / far[q].min(), place[q, of[v]].min()) for q, vs in enumerate(true) for v in vs]
    # each bound may lose half of what may be lost
    ratio, width = (np.quantile([f[i] for f in found], (1 + RECALL) / 2, method="higher") for i in range(2))
    return float(ratio) + 1e-9, int(width) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each query row by cosine, nearest first."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = rows.where(F.col("id").isNotNull() & usable("vector"))
    common = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    n = common["count"]
    good = materialize(good.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "posting-vectors")
    usual, others = good.where(F.col("dim") == common.dim), good.where(F.col("dim") != common.dim)
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 11) / F.lit(float(2**53))
    drawn = usual.where(chance * n < SAMPLE).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).select("vector").toArrow()
    drawn = drawn if len(drawn) else usual.limit(1).select("vector").toArrow()
    sample = unit(matrix(drawn.column("vector").combine_chunks()))
    graph = CentroidGraph(balanced_centroids(sample, int(min(max(1, n // LIST), LISTS_MOST, max(1, len(sample) // 4)))))
    ratio, width = calibrate(graph, sample, k)
    sent = spark.sparkContext.broadcast(graph)

    def dealt(lists_of, asks: bool):
        """Rows (list, asks, row, id, unit) for the lists that `lists_of` names."""

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                    u, own, ids = unit(matrix(batch.column("vector"))), batch.column("row").to_numpy(), batch.column("id").to_numpy()
                    row, lists = lists_of(u)
                    packed = [x.tobytes() for x in u]
                    yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.full(len(row), asks)), pa.array(own[row]), pa.array(ids[row]), pa.array([packed[i] for i in row], pa.binary())], ["list", "asks", "row", "id", "unit"])

        return rows_of

    def of_length(asks: bool):
        """Rows (list, asks, row, id, unit) for the one list of each uncommon length; such lists are numbered below 0."""

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    packed = pa.array([x.tobytes() for x in unit(matrix(part.column("vector")))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), -int(d))), pa.array(np.full(len(part), asks)), part.column("row"), part.column("id"), packed], ["list", "asks", "row", "id", "unit"])

        return rows_of

    schema = "list long, asks boolean, row long, id long, unit binary"
    vectors_of = usual.select("row", "id", "vector").mapInArrow(dealt(lambda u: sent.value.lists(u), False), schema)
    vectors_of = materialize(vectors_of.unionByName(others.select("row", "id", "vector", "dim").mapInArrow(of_length(False), schema)), "posting-vectors-of")
    counts = np.zeros(len(graph.centroids), np.int64)
    for r in vectors_of.where("list >= 0").groupBy("list").count().collect():  # at most LISTS_MOST lists
        counts[r.list] = r["count"]
    asked = usual.where("asks").select("row", "id", "vector").mapInArrow(dealt(lambda u: sent.value.probes(u, ratio, width, counts, k), True), schema)
    asked = asked.unionByName(others.where("asks").select("row", "id", "vector", "dim").mapInArrow(of_length(True), schema))
    listed = vectors_of.unionByName(materialize(asked, "posting-queries-of"))
    sizes = listed.groupBy("list").agg(F.ceil(F.count_if(~F.col("asks")) / BLOCK).cast("int").alias("v"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("q"))
    sizes = materialize(sizes.where("v > 0 and q > 0"), "posting-sizes")
    own = F.pmod(F.xxhash64("row"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("v"))).cast("int")
    cells = listed.join(sizes, "list").select("list", "asks", "row", "id", "unit", own.alias("own"), F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("v")).otherwise(F.col("q")) - 1)).alias("other"))
    cells = cells.select("list", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("v"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("q"), "asks", "row", "id", "unit")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({name: pa.array([], pa.float64() if name == "score" else pa.int64()) for name in FOUND})
        for table, starts in runs(batches, 3):
            held = pa.concat_tables([held, pa.Table.from_batches([_best(table, starts, k)])])
            if len(held) > HELD:  # of the cells of a task only a query's best go on
                held = _first(held, k)
                if len(held) > HELD // 2:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        yield from _first(held, k).to_batches()

    found = cells.repartition("list", "v", "q").sortWithinPartitions("list", "v", "q").mapInArrow(best, "query_row long, query_id long, row long, id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = materialize(found.groupBy("query_row", "query_id", "row", "id").agg(F.max("score").alias("score")), "posting-found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: What a cell has found: rows by their number and id.
FOUND = ("query_row", "query_id", "row", "id", "score")


def _first(found: pa.Table, k: int) -> pa.Table:
    """Each query's best k of what a task's cells have found; a vector in several lists counts once."""
    q, rows, ids, score = (found.column(c).to_numpy() for c in ("query_row", "row", "id", "score"))
    order = np.lexsort((rows, ids, -score, q))
    q, rows = q[order], rows[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (rows[1:] != rows[:-1])  # a vector's scores in two lists are equal, so they lie side by side
    order, q = order[fresh], q[fresh]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return found.take(pa.array(order[place < k]))


def _best(table: pa.Table, starts: np.ndarray, k: int) -> pa.RecordBatch:
    asks, numbers, ids = np.asarray(table.column("asks")), table.column("row").to_numpy(), table.column("id").to_numpy()
    units = table.column("unit").to_pylist()
    out: list[tuple[int, int, int, int, float]] = []
    for at, end in zip(starts[:-1], starts[1:]):
        ask = np.flatnonzero(asks[at:end])
        have = np.flatnonzero(~asks[at:end])
        if not len(ask) or not len(have):
            continue
        u = np.stack([np.frombuffer(x, np.float64) for x in units[at:end]])
        own, rows, names = u[have], numbers[at + have], ids[at + have]
        for some in (ask[i : i + 256] for i in range(0, len(ask), 256)):
            near = u[some] @ own.T
            near[numbers[at + some][:, None] == rows[None]] = -np.inf
            count = min(k, len(have))
            floor = -np.partition(-near, count - 1, axis=1)[:, count - 1]
            for q, scores, least in zip(some, near, floor):
                # scores of all that may be among the best, summed the same way wherever they stand, so that ties hold
                may = np.flatnonzero((scores >= least - 1e-9) & np.isfinite(scores))
                exact = (own[may] * u[q]).sum(1)
                for i in np.lexsort((rows[may], names[may], -exact))[:k]:
                    out.append((int(numbers[at + q]), int(ids[at + q]), int(rows[may[i]]), int(names[may[i]]), float(exact[i])))
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.float64() if name == "score" else pa.int64()) for i, name in enumerate(FOUND)], list(FOUND))
