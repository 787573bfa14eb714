"""A stored inverted file of vectors: Parquet in cells by nearest centroid, read cell by cell with filters inside.

A bounded sample of vectors is cut into cells by k-means on the sphere; every row lies in the cell of its nearest
centroid, as a partition of the table, with all its columns. A search ranks the centroids and reads cells in that order:
partition pruning leaves the other cells' files alone, and filters stand on the scan. How many cells hold what share of
the rows nearest to a query is measured on the sample when the index is built; a search reads on, round by round, until
it has read as many as that curve asks for at the share of rows that its filters let through, and has k rows. An exact
search reads on until no unread cell can hold a nearer row: a cell's rows lie within an angle of its centroid.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, are not indexed; vectors of
another length than the commonest lie in one cell for each length, which queries of that length read whole; a query of a
length that no row has finds nothing; rows that repeat an id are rows of their own; ties go to the smaller id.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.functions import vector as vec

#: Vectors that centroids are fitted to, cells at most, k-means rounds, sampled queries of the curve, and the share of the
#: nearest rows that a search is to find.
SAMPLE, CELLS_MOST, ROUNDS, ASKED, RECALL = 20_000, 4_096, 8, 256, 0.97


def fit_centroids(x: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of the unit rows of `x` by k-means; an empty part takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        near = x @ centroids.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=count) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def probe_curve(x: np.ndarray, centroids: np.ndarray) -> list[tuple[float, int]]:
    """(share, cells): so many nearest cells hold RECALL of the rows nearest to a query that make up that share of all,
    measured on sampled queries."""
    asked = x[:: max(1, len(x) // ASKED)]
    own, near = (x @ centroids.T).argmax(1), asked @ x.T
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each cell, for each query
    order = np.argsort(-near, axis=1)
    at = np.take_along_axis(place, own[order], axis=1)  # of the i-th nearest row's cell
    out, count = [], min(10, len(x))
    while True:
        out.append((count / len(x), int(np.quantile(at[:, :count], RECALL, method="higher")) + 1))
        if count == len(x):
            return out
        count = min(2 * count, len(x))


@dataclass(frozen=True)
class Found:
    """`hits`: the k nearest (all columns of the index, and score), nearest first; what was read for them."""

    hits: DataFrame
    cells_read: int
    cells: int
    rows_read: int


class VectorIndex:
    """An index in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        version = spark.read.schema("version string").json(f"{self.path}/current").first()["version"]
        self.at = f"{self.path}/{version}"
        facts = spark.read.parquet(f"{self.at}/facts").first()
        self.id_col, self.vector_col, self.dim, self.curve = facts.id_col, facts.vector_col, facts.dim, [(r.share, r.cells) for r in facts.curve]
        self.schema = T.StructType.fromJson(json.loads(facts["schema"]))
        cells = spark.read.parquet(f"{self.at}/centroids").orderBy("cell").toArrow()  # at most CELLS_MOST, and one for each other length
        self.cells, self.sizes, self.reach = (cells.column(c).to_numpy() for c in ("cell", "n", "reach"))
        self.centroids = np.array([c if c is not None else [0.0] * self.dim for c in cells.column("centroid").to_pylist()], float).reshape(len(self.cells), self.dim)

    @staticmethod
    def build(rows: DataFrame, path: str, id_col: str, vector_col: str, cells: int | None = None) -> VectorIndex:
        """Write an index of `rows` below `path` and point to it; searches that are under way keep the one they read."""
        spark, version = rows.sparkSession, uuid.uuid4().hex
        at = f"{path.rstrip('/')}/{version}"
        finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
        good = rows.where(F.coalesce(finite, F.lit(False)))
        common = good.groupBy(F.size(vector_col).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        n, dim = (common["count"], common.dim) if common else (0, 0)
        usual = good.where(F.size(vector_col) == dim)
        chance = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(5)), 11) / F.lit(float(2**53))
        drawn = usual.where(chance * n < SAMPLE * 1.05).select(vector_col).limit(SAMPLE).toArrow() if n else None
        drawn = usual.limit(1).select(vector_col).toArrow() if n and not len(drawn) else drawn
        x = _unit(np.array(drawn.column(0).to_pylist(), float)) if n else np.zeros((0, 0))
        count = min(cells or max(1, round(math.sqrt(n))), CELLS_MOST, max(1, len(x)))
        centroids = fit_centroids(x, count) if n else np.zeros((0, 0))
        curve = probe_curve(x, centroids) if n else []
        sent = spark.sparkContext.broadcast(centroids)

        def place(*columns: pa.Array) -> pa.Array:
            vectors = columns[0]
            sizes = vectors.value_lengths().to_numpy()
            own, cos = -sizes.astype(np.int64), np.ones(len(sizes))
            usual = np.flatnonzero(sizes == dim)
            if len(usual):
                near = _unit(vectors.take(pa.array(usual)).flatten().to_numpy().astype(float).reshape(-1, dim)) @ sent.value.T
                own[usual], cos[usual] = near.argmax(1), near.max(1)
            return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(cos)], ["cell", "cos"])

        placed = good.withColumn("index_at", F.arrow_udf(place, "cell int, cos double")(F.col(vector_col).cast("array<double>")))
        placed = placed.select(*rows.columns, F.col("index_at.cos").alias("index_cos"), F.col("index_at.cell").alias("index_cell"))
        # a cell's rows go together, and a cell that is too large for one task to several
        placed.hint("rebalance", "index_cell").write.partitionBy("index_cell").parquet(f"{at}/cells")
        table = spark.read.schema(placed.schema).parquet(f"{at}/cells")
        known = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>")
        sizes = table.groupBy(F.col("index_cell").alias("cell")).agg(F.count("*").alias("n"), F.min("index_cos").alias("reach"))
        sizes.join(known, "cell", "left").write.parquet(f"{at}/centroids")
        spark.createDataFrame([(id_col, vector_col, dim, curve, placed.schema.json())], "id_col string, vector_col string, dim int, curve array<struct<share:double,cells:int>>, schema string").write.parquet(f"{at}/facts")
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")
        return VectorIndex(spark, path)

    def table(self, *cells: int) -> DataFrame:
        """The rows of these cells: a scan of their files alone."""
        return self.spark.read.schema(self.schema).parquet(f"{self.at}/cells").where(F.col("index_cell").isin(*cells))

    def search(self, query: list[float], k: int, where: Column | None = None, within: DataFrame | None = None, exact: bool = False) -> Found:
        """The k rows of largest cosine that `where` holds for and whose id is in `within`, a frame with the id column."""
        asked = np.asarray(query, float)
        length = float(np.linalg.norm(asked))
        usable = length > 0 and bool(np.isfinite(asked).all())
        if usable and len(asked) == self.dim:
            cos = self.centroids @ (asked / length)
            order = np.lexsort((self.cells, -cos))
            order = order[self.cells[order] >= 0]
        else:
            cos, order = np.zeros(len(self.cells)), np.flatnonzero((self.cells == -len(asked)) & usable)
        # the least angle that a cell's rows can have to the query
        least = np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - np.arccos(np.clip(self.reach, -1, 1)))
        bound = np.cos(least) + 1e-9
        best: list = []
        read = rows_read = passed = 0
        total = int(self.sizes[order].sum())
        columns = [c for c in self.schema.names if c not in ("index_cos", "index_cell")]
        goal = self._probes(k / max(1, total))
        while read < len(order):
            some = order[read : max(read + 1, min(goal, len(order)))]
            rows = self.table(*self.cells[some].tolist())
            rows = rows.where(where) if where is not None else rows
            rows = rows.join(within.select(self.id_col), self.id_col, "left_semi") if within is not None else rows
            seen = Observation()
            scored = rows.select(*columns, (vec.dot(self.vector_col, vec.literal((asked / length).tolist())) / F.sqrt(vec.dot(self.vector_col, self.vector_col))).alias("score"))
            first = scored.observe(seen, F.count("*").alias("n")).orderBy(F.desc("score"), self.id_col).limit(k).collect()  # k rows
            read, rows_read, passed = read + len(some), rows_read + int(self.sizes[some].sum()), passed + seen.get["n"]
            best = sorted([*best, *first], key=lambda r: (-r.score, r[self.id_col]))[:k]
            if exact:
                left = order[read:]
                if len(best) == k and (not len(left) or bound[left].max() < best[-1].score):
                    break
                goal = 2 * read if len(best) < k else max(read + 1, read + int((bound[left] >= best[-1].score).nonzero()[0].max(initial=0)) + 1)
            else:
                # of the rows let through as of all rows, the k nearest make up this share
                share = k / max(1.0, passed / max(1, rows_read) * total)
                goal = self._probes(share) if passed >= k else 2 * read
                if passed >= k and read >= goal:
                    break
        return Found(self.spark.createDataFrame(best, T.StructType([*(self.schema[c] for c in columns), T.StructField("score", T.DoubleType())])), read, len(order), rows_read)

    def _probes(self, share: float) -> int:
        return next((cells for s, cells in self.curve if s >= share), len(self.cells))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)

