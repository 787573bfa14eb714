"""Duplicate groups, similarity graphs and what is measured of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from shoebox.operators.aggregate import best_id
from shoebox.session import ensure_checkpoint_dir


def hex64(c: Column | str) -> Column:
    """Sixteen hexadecimal digits as a signed number."""
    return F.conv(c, 16, -10).cast("bigint")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hashes; 64 if either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hamming_pairs(rows: DataFrame, id_col: str, hash_col: str, most: int = 1) -> DataFrame:
    """(a, b, bits) of different hashes at most `most` bits apart, by pigeonhole: one of most + 1 bands is equal.

    The bands are the join key, so only rows that share one meet. Equal hashes are one row, under their least id.
    """
    one = rows.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    width = 64 // (most + 1)
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("part")) for i in range(most + 1)])
    keyed = one.select("id", "h", F.explode(bands).alias("key")).select("id", "h", "key.*")
    left, right = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "band", "part"), keyed.select(F.col("id").alias("b"), F.col("h").alias("hb"), "band", "part")
    near = left.join(right, ["band", "part"]).where("a < b").withColumn("bits", hamming("ha", "hb")).where(F.col("bits") <= most)
    return near.select("a", "b", "bits").distinct()


def equal_groups(rows: DataFrame, key: Column, id_col: str, score: Column) -> DataFrame:
    """(key, size, best_id) of keys held by several rows; the best has the highest score, then the least id."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("size"), best_id(id_col, score).alias("best_id")).where("size > 1")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a, b): the least node reachable, of whatever type.

    Each round every node passes to that of itself and its neighbours which comes first in an order drawn anew, and the
    edges are drawn between what their ends passed to. So rounds work on ever fewer edges, in a chain in order of its ids
    too; then the rounds' steps are put together, from the last and smallest on. Each round is checkpointed, so that
    lineage stays short and lost executors cost one round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a is not null or b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("e")).select("e.*")
        turn = F.xxhash64("next", F.lit(len(steps)))
        first = ends.groupBy("node").agg(F.min_by("next", turn).alias("next"), F.min(turn).alias("turn"))
        moves = F.col("turn") < F.xxhash64("node", F.lit(len(steps)))
        steps.append(first.select("node", F.when(moves, F.col("next")).otherwise(F.col("node")).alias("next")).checkpoint())
        to = steps[-1].where("next <> node")  # what stays needs no look-up
        for end in "ab":
            edges = edges.join(to.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("next", end)).drop("next")
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    found = steps.pop()
    while steps:
        last = found.where("next <> node").select(F.col("node").alias("next"), F.col("next").alias("last"))
        found = steps.pop().join(last, "next", "left").select("node", F.coalesce("last", "next").alias("next")).checkpoint()
    least = found.groupBy("next").agg(F.min("node").alias("component"))
    return found.join(least, "next").select("node", "component")


#: Bytes of query vectors and of what is found for them, which are sent to all tasks or held by each, beyond which queries
#: are dealt to blocks; numbers of a block of queries, of a block of rows, and products, that a task holds at once; numbers
#: of rows that a task reads block by block.
SENT, NUMBERS, ROWS, CELLS, READ = 16 << 20, 2 << 20, 1 << 19, 1_000_000, 128 << 20


def directed(vector: str) -> Column:
    """Whether a vector can be compared: it has components, and all of them are finite."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def nearest_to_queries(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the exact k nearest rows of each stated query by dot product of unit vectors.

    Queries of at most SENT bytes go to all tasks, which read the rows where they are. More queries are dealt to blocks of
    NUMBERS (or so many queries), one for each core at least, and each meets all rows, in tasks of READ numbers (or so many
    rows). Either way a task compares its queries with one block of ROWS numbers after another by matrix products of CELLS,
    keeps the k best so far of each and passes these on at its end; so what it holds depends on neither table, and what it
    passes on not on the rows that it reads. Products that can be among the k best are summed once more in the order of the
    components, as SQL does, and ties go by least id. A query doesn't find its own row. Ids that are null, and vectors that
    are null or empty or hold null or non-finite components, find nothing and are not found; vectors are compared with
    those of their length.
    """
    single = rows.schema[vector_col].dataType == queries.schema[vector_col].dataType == ArrayType(FloatType(), rows.schema[vector_col].dataType.containsNull)
    kept = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")  # products are of doubles
    rows, queries = (df.where(directed(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), kept.alias("vector")) for df in (rows, queries))
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    size = _size(queries)
    held, numbers, cells = size.x + 3 * k * size.n, ROWS, CELLS  # a found row is an id, a number of its query and a score
    if held * 8 <= SENT:
        sent = rows.sparkSession.sparkContext.broadcast(by_length(queries.toArrow()))  # its size was checked

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _best(sent.value, blocks_of(batches, numbers), k, cells)

        near = rows.mapInArrow(best, schema)
    else:
        others = _size(rows)
        n_queries = max(-(-size.n // query_block) if query_block else -(-held // NUMBERS), rows.sparkSession.sparkContext.defaultParallelism)
        n_rows = max(1, -(-others.n // row_block) if row_block else -(-others.x // READ))

        def dealt(df: DataFrame, asks: bool) -> DataFrame:
            own, other = (n_queries, n_rows) if asks else (n_rows, n_queries)
            block, met = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
            met = df.select("id", "vector", block.alias("own"), met.alias("other"))
            return met.select("id", "vector", (F.col("own" if asks else "other") * n_rows + F.col("other" if asks else "own")).alias("block"), F.lit(not asks).alias("found"))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, met in groupby(_runs(batches), itemgetter(0)):
                asked, first = [], []
                for _, found, batch in met:
                    if found:
                        first.append(batch)
                        break
                    asked.append(batch)
                if asked and first:
                    have = chain(first, (batch for _, _, batch in met))
                    yield from _best(by_length(pa.Table.from_batches(asked)), blocks_of(have, numbers), k, cells)

        both = dealt(queries, True).unionByName(dealt(rows, False))
        near = both.repartitionById(n_queries * n_rows, "block").sortWithinPartitions("block", "found").mapInArrow(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _size(vectors: DataFrame) -> Row:
    return vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("x")).first()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, found, rows) of sorted rows, cut where either changes."""
    for batch in batches:
        block, found = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "found"))
        ends = [*(np.flatnonzero((np.diff(block) != 0) | (found[1:] != found[:-1])) + 1).tolist(), len(block)]
        for at, end in zip([0, *ends], ends, strict=False):
            if end > at:
                yield int(block[at]), bool(found[at]), batch.slice(at, end - at)


def blocks_of(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[pa.Table]:
    """A task's rows with a column `vector` in tables of about so many numbers."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += len(batch.column("vector").flatten())
        if held >= numbers:
            yield pa.Table.from_batches(some)
            some, held = [], 0
    if some:
        yield pa.Table.from_batches(some)


def by_length(table: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """The ids and the matrix of a table's vectors (id, vector), for each length that they have."""
    table = table.combine_chunks()
    vectors, ids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("vector"), table.column("id")))
    sizes = vectors.value_lengths().to_numpy() if len(vectors) else np.zeros(0, np.int64)
    flat = vectors.flatten().to_numpy()
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        whole = len(at) == len(sizes)
        out[d] = (ids, flat.reshape(-1, d)) if whole else (ids.take(pa.array(at)), flat[starts[at][:, None] + np.arange(d)])
    return out


def _best(asked: dict[int, tuple[pa.Array, np.ndarray]], blocks: Iterator[pa.Table], k: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The k best of all blocks for each query of a block, in a batch for each length."""
    found: dict[int, pa.Table] = {}
    least = {d: np.full(len(names), -np.inf) for d, (names, _) in asked.items()}  # each query's k-th best so far
    for table in blocks:
        for d, (ids, have) in by_length(table).items():
            more = list(_block_best(*asked[d], *_few_copies(ids, have, k), k, cells, least[d])) if d in asked else []
            if more:
                both = pa.concat_tables([*([found[d]] if d in found else []), pa.Table.from_batches(more)]).combine_chunks()
                at, scores = both.column("place").to_numpy(), both.column("score").to_numpy()
                kept, last = _first(at, scores, _ranks(both.column("id")), k)
                found[d], least[d][at[last]] = both.take(pa.array(kept)), scores[last]
    for table in found.values():
        yield from table.select(["query_id", "id", "score"]).combine_chunks().to_batches()


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids of whatever type, equal ones for equal ids."""
    return pc.rank(ids, tiebreaker="dense").to_numpy()


def _first(query: np.ndarray, scores: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each query's k first are by score, then id, and where its k-th is if it has so many."""
    order = np.lexsort((ranks, -scores, query))
    of = query[order]
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return order[place < k], order[place == k - 1]


def _few_copies(ids: pa.Array, have: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """A block's rows but those of equal vectors that no query has among its k best: k + 1 lesser ids or k rows of the
    same id, which tie with them, come first."""
    have = np.ascontiguousarray(have)
    bits = have.view(np.uint32).astype(np.uint64)
    sums = bits @ np.random.default_rng(0).integers(1, 2**63, bits.shape[1], np.uint64)
    if len(np.unique(sums)) == len(sums):
        return ids, have
    _, vector = np.unique(have.view(np.dtype((np.void, have.itemsize * have.shape[1]))).ravel(), return_inverse=True)
    ranks = _ranks(ids)
    order = np.lexsort((ranks, vector))
    vector, ranks = vector[order], ranks[order]
    new_vector = np.concatenate(([True], vector[1:] != vector[:-1]))
    new_id = new_vector | np.concatenate(([True], ranks[1:] != ranks[:-1]))
    id_number, at = np.cumsum(new_id), np.arange(len(order))
    before = id_number - np.maximum.accumulate(np.where(new_vector, id_number, 0))
    kept = order[(before <= k) & (at - np.maximum.accumulate(np.where(new_id, at, 0)) < k)]
    kept.sort()
    return ids.take(pa.array(kept)), have[kept]


def _block_best(names: pa.Array, asked: np.ndarray, ids: pa.Array, have: np.ndarray, k: int, cells: int, least: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The k best of a block of rows for each query of a block, of those that reach `least`, some queries at a time.

    Products of single numbers, with slack for their error, tell which rows can be among them; scores are sums of doubles.
    """
    count, d = min(k, len(ids)), asked.shape[1]
    lengths, longest = (np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float)) for x in (asked, have))
    reach = lengths * longest.max(initial=0.0)
    kind = np.float32 if asked.dtype == have.dtype == np.float32 and reach.max(initial=0.0) < 1e38 else np.float64
    asked, have = asked.astype(kind, copy=False), have.astype(kind, copy=False)
    slack = 2 * (d + 2) * np.finfo(kind).eps * reach + d * 1e-37  # sums in another order, and what underflows, differ by less
    # ids, of whatever type, are compared by their numbers
    numbers = pa.concat_arrays([names, ids.cast(names.type)]).dictionary_encode().indices.to_numpy()
    ranks, step, part = _ranks(ids), max(1, cells // max(1, len(ids))), max(1, cells // d)
    for at in range(0, len(names) if count else 0, step):
        own, some, less = (x[at : at + step] for x in (numbers[: len(names)], asked, slack))
        near = some @ have.T
        near[own[:, None] == numbers[None, len(names) :]] = -np.inf
        floor = np.full(len(some), -np.inf) if least is None else least[at : at + step] - less
        many = np.isneginf(floor)
        if not many.any():
            hits = np.flatnonzero(near >= floor.astype(kind)[:, None])
            many = np.bincount(hits // len(ids), minlength=len(some)) > 4 * k
        if many.any():
            floor[many] = np.maximum(floor[many], np.partition(near[many], len(ids) - count, axis=1)[:, len(ids) - count] - less[many])
            hits = np.flatnonzero(near >= floor.astype(kind)[:, None])
        i, j = np.divmod(hits[np.isfinite(near.ravel()[hits])], len(ids))
        if len(i):
            parts = [slice(p, p + part) for p in range(0, len(i), part)]
            scores = np.concatenate([np.add.accumulate(some[i[p]].astype(float) * have[j[p]], axis=1)[:, -1] for p in parts])
            kept, _ = _first(i, scores, ranks[j], k)
            place = pa.array(i[kept] + at)
            yield pa.RecordBatch.from_arrays([place, names.take(place).cast(ids.type), ids.take(pa.array(j[kept])), pa.array(scores[kept])], ["place", "query_id", "id", "score"])


def purity(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """In one row, from counts of (cluster, truth): clustered rows, their purity, completeness and share of all rows,
    and pairwise precision, recall and F1 in closed form."""
    table = rows.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    clusters = table.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    truths = table.where(F.col(cluster).isNotNull()).groupBy(truth).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    both = table.where(F.col(cluster).isNotNull()).agg(F.sum(pairs).alias("same_both"))
    one = clusters.agg(F.sum("n").alias("clustered"), F.sum("most").alias("pure"), F.sum(pairs).alias("same_cluster"))
    two = truths.agg(F.sum("most").alias("complete"), F.sum(pairs).alias("same_truth"))
    total = table.agg(F.sum("n").alias("total"))
    row = one.crossJoin(two).crossJoin(both).crossJoin(total)  # one row each
    precision, recall = F.try_divide("same_both", "same_cluster"), F.try_divide("same_both", "same_truth")
    return row.select(
        "clustered", F.try_divide("pure", "clustered").alias("purity"), F.try_divide("complete", "clustered").alias("completeness"), F.try_divide("clustered", "total").alias("coverage"),
        precision.alias("pair_precision"), recall.alias("pair_recall"), F.try_divide(2 * precision * recall, precision + recall).alias("pair_f1"),
    )


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts and precision, recall, F1 of a 0/1 prediction, in one row; unlabelled rows are left out."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    row = rows.where(F.col(actual).isNotNull()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return row.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def carry_labels(members: DataFrame, new: str, old: str, share: float = 0.5) -> DataFrame:
    """(new, label): a new cluster takes over the old label that at least `share` of its members had.

    Of several clusters that claim an old label the largest gets it (then the least); others get none (null).
    """
    table = members.groupBy(new, old).agg(F.count("*").alias("n"))
    sizes = members.groupBy(new).agg(F.count("*").alias("size"))
    claims = table.where(F.col(old).isNotNull()).join(sizes, new).where(F.col("n") >= share * F.col("size"))
    claims = claims.groupBy(new).agg(best_id(old, "n").alias(old), F.first("size").alias("size"))
    winners = claims.groupBy(old).agg(best_id(new, "size").alias(new))
    return sizes.join(winners, new, "left").select(new, F.col(old).alias("label"))


def near_duplicates(neighbours: DataFrame, rows: DataFrame, id_col: str, hash_col: str | None, score: Column, cosine: float = 0.95, bits: int = 10) -> DataFrame:
    """(id, group, size, is_best): groups of rows joined by near neighbours (query_id, id, score) that are alike.

    Alike: a score of `cosine` or more and, with a hash column, at most `bits` differing bits (null differs in all).
    Groups are connected components; the best has the highest `score`, then the least id.
    """
    near = neighbours.where(F.col("score") >= cosine).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).distinct()
    if hash_col:
        hashes = rows.select(F.col(id_col).alias("a"), F.col(hash_col).alias("ha"))
        near = near.join(hashes, "a").join(hashes.select(F.col("a").alias("b"), F.col("ha").alias("hb")), "b").where(hamming("ha", "hb") <= bits)
    found = components(near.select("a", "b")).select(F.col("node").alias(id_col), F.col("component").alias("group"))
    rated = found.join(rows.select(id_col, score.alias("group_score")), id_col)
    best = rated.groupBy("group").agg(F.count("*").alias("size"), best_id(id_col, "group_score").alias("best"))
    return rated.join(best, "group").select(id_col, "group", "size", (F.col(id_col) == F.col("best")).alias("is_best"))


def stratified(rows: DataFrame, stratum: str, id_col: str, each: int, seed: int = 0) -> DataFrame:
    """At most `each` rows of every stratum, null being one, drawn by a hash of the id: the same at every run."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= each).drop("draw")


def near_misses(pairs: DataFrame, flagged: float, low: float, high: float, score: str, keys: list[str], each: int, seed: int = 0) -> DataFrame:
    """Half of the rows from pairs that are flagged as alike, half from those that nearly were, drawn by a hash."""
    kind = F.when(F.col(score) >= flagged, "flagged").when(F.col(score).between(low, high), "near_miss")
    w = Window.partitionBy("kind").orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return pairs.withColumn("kind", kind).where("kind is not null").withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= each).drop("draw")
