"""Near-duplicate vectors by a pivot-permutation index (operator 1).

A sample of the vectors serves as pivots. Each vector is described by its PREFIX nearest pivots, and is listed in the
inverted list of each pair of them; two vectors that share a list share at least two pivots. The pairs of each list
are verified by cosine in double precision. Lists of more than BLOCK vectors are dealt to blocks, and every two blocks
meet in a cell of their own, so no task holds a list as a whole. A pair is counted in one list only, that of the two
smallest pivots it shares, so counts need no list of pairs; for components a cell puts out a spanning forest.
Equal vectors of one label are one class from the start and count with their number.

The number of pivots follows the square root of the number of vectors, within PIVOTS; they are sent to all tasks. Of
pivots whose cosine is over APART only the first stays: a large group of near copies would draw many pivots, and which of
them are nearest to a member would be noise. So members of such a group share its pivot, and their pairs all meet: work
grows with the square of the group, as do the links counted. The index is approximate in that two linked vectors may
share fewer than two pivots; recall against all pairs is in the README. No link below the threshold is found.

Defined cases: a null label, and a vector that is null, empty, zero or holds null or non-finite components, links with
nothing; vectors of different lengths link with nothing; a row without id gets no component and links nothing; rows
that repeat an id are vectors of their own, each with its own result; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.components import connected_components
from shoebox.llm.tables import discard, materialize

PREFIX, PIVOTS, BLOCK, APART = 5, (64, 2_048), 1_024, 0.9


def usable(vector: str) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def apart(rows: np.ndarray) -> np.ndarray:
    """The rows of length one whose cosine to no earlier row that stays is over APART."""
    kept: list[int] = []
    for i in range(len(rows)):
        if not kept or (rows[kept] @ rows[i]).max() <= APART:
            kept.append(i)
    return rows[kept]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    good, alone = rows.where(takes_part), rows.where(~takes_part).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    # a class has a number of its own, as rows that repeat an id may be of several; it is written once and then stays
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("vector")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    class_of = materialize(good.join(classes, ["label", "vector"]).select("id", "rep"), "vector-class-of")
    n = classes.count()
    wanted = int(min(max(2 * n**0.5, PIVOTS[0]), PIVOTS[1]))
    dims = [r.dim for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()]
    pivots = {d: apart(unit(np.array([r.vector for r in classes.where(F.col("dim") == d).orderBy(F.xxhash64("least", "label"), "least").limit(wanted).collect()]))) for d in dims}
    sent = spark.sparkContext.broadcast(pivots)  # at most 64 * 2,048 vectors, one length of vector as a rule

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("dim"))
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                u = unit(matrix(part.column("vector")))
                nearest = sent.value.get(int(d), u[:1])
                k = min(PREFIX, len(nearest))
                first = np.sort(np.argpartition(-(u @ nearest.T), k - 1, axis=1)[:, :k], axis=1)
                i, j = np.triu_indices(k, 1) if k > 1 else (np.array([0]), np.array([0]))
                lists = (first[:, i] * 4096 + first[:, j]) * 65536 + int(d)
                packed = [u[r].tobytes() for r in range(len(u))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("rep"), part.column("copies"), pa.array(packed, pa.binary()), pa.array(list(first.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(lists.astype(np.int64)), pa.list_(pa.int64()))],
                    ["label", "rep", "copies", "unit", "prefix", "lists"],
                )

    kind = dict(classes.dtypes)["label"]
    index = materialize(classes.select("label", "rep", "copies", "dim", "vector").mapInArrow(describe, f"label {kind}, rep long, copies long, unit binary, prefix array<int>, lists array<bigint>"), "pivot-index")
    listed = index.select("label", "rep", F.explode("lists").alias("list"))
    sizes = materialize(listed.groupBy("label", "list").agg(F.count("*").alias("n")).where("n > 1").select("label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "pivot-lists")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = listed.join(sizes, ["label", "list"]).select("rep", "label", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("rep", F.xxhash64("label").alias("h"), "list", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), "block")
    cells = cells.join(index.select("rep", "copies", "unit", "prefix"), "rep").select("h", "list", "c1", "c2", "block", "rep", "copies", "unit", "prefix")
    grouped = cells.repartition("h", "list", "c1", "c2").sortWithinPartitions("h", "list", "c1", "c2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, 4):
            yield _links(table, starts, threshold)

    found = materialize(grouped.mapInArrow(verify, "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    rated = classes.select("rep", "least", "copies").join(links, "rep", "left").join(components, "rep", "left")
    rated = materialize(rated.select("rep", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "vector-rated")
    least = rated.groupBy("component").agg(F.min("least").alias("least"))
    named = materialize(rated.drop("least").join(least, "component").select("rep", "links", F.col("least").alias("component")), "vector-result")
    discard(classes, index, sizes, found, rated)
    out = class_of.join(named, "rep").select("id", "links", "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows equal in the first `keys` columns, with the runs' borders; runs may cross batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        columns = [table.column(i).to_numpy() for i in range(keys)]
        starts = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
        rest = table.slice(int(starts[-1]))
        if len(starts) > 1:
            yield table, starts
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def _links(table: pa.Table, starts: np.ndarray, threshold: float) -> pa.RecordBatch:
    """For each cell and class with links that are this list's to count: their number and a root in a forest."""
    lists, c1, c2, block, rep, copies = (table.column(i).to_numpy() for i in range(1, 7))
    units, prefix = table.column("unit").to_pylist(), table.column("prefix").to_pylist()
    out = [np.zeros((0, 3), np.int64)]
    for at, end in zip(starts[:-1], starts[1:]):
        own = block[at:end]
        left, right = np.flatnonzero(own == c1[at]), np.flatnonzero(own == c2[at])
        if not len(left) or not len(right) or end - at < 2:
            continue
        u = np.stack([np.frombuffer(x, np.float64) for x in units[at:end]])
        near = u[left] @ u[right].T >= threshold
        # a pair is this list's if it shares no other pivot below the second of the list's own
        first = np.array(prefix[at:end])
        p, q = lists[at] // 65536 // 4096, lists[at] // 65536 % 4096
        earlier = (first < q) & (first != p)
        names, place = np.unique(first[earlier], return_inverse=True)
        if len(names):
            has = np.zeros((end - at, len(names)), np.float32)
            has[np.nonzero(earlier)[0], place] = 1
            near &= has[left] @ has[right].T == 0
        linked = np.zeros((end - at, end - at), bool)
        linked[np.ix_(left, right)] = near
        linked |= linked.T
        np.fill_diagonal(linked, False)
        held = np.flatnonzero(linked.any(1))
        if len(held):
            linked, ids = linked[np.ix_(held, held)], rep[at:end][held]
            out.append(np.stack((ids, linked @ copies[at:end][held], ids[roots(linked)]), axis=1))
    got = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(3)], ["rep", "links", "root"])


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its component."""
    root = np.full(len(linked), -1)
    for at in range(len(linked)):
        if root[at] < 0:
            front = seen = np.arange(len(linked)) == at
            while front.any():
                front = linked[front].any(0) & ~seen
                seen = seen | front
            root[seen] = at
    return root
