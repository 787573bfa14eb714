"""Many searches in one plan: what `Engine.search` gives for each request, for a table of requests at once.

Requests share what they can. Every distinct filter is a number; one scan of the photos evaluates all their predicates
and leaves, for each photo, the numbers it passes. Query vectors go to all tasks (their size is checked, and beyond it
requests are worked in several plans), which read embeddings once and multiply a block of rows with all queries, masked
by the filters' numbers. Words meet tokens by an equi-join. Signals are then one table (query, signal, id, rank), fused
and paged by windows of bounded groups: no signal has more rows of a query than its pool. Requests whose filters leave
nothing are searched again together without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions import text, vector
from shoebox.operators import groups
from shoebox.plans import filters as flt

if TYPE_CHECKING:
    from shoebox.plans.search import Engine, SearchRequest

#: Numbers in the query vectors of one plan, and distinct filters in it; products that a task holds at once.
NUMBERS, FILTERS, CELLS = 4 << 20, 128, 1_000_000
SIGNALS = ("clip", "caption", "keyword", "ocr", "recency")


def search_many(engine: Engine, requests: dict[str, SearchRequest]) -> DataFrame:
    """(query, rank, id, score, best, fell_back) of every request's page."""
    rows = None
    for some in _plans(requests):
        found = _pages(engine, some)
        narrow = [name for name, r in some.items() if not r.filters.is_empty() and not r.liked]
        if narrow:
            found = engine.keep(found)
            have = {r.query for r in found.where(F.col("query").isin(*narrow)).select("query").distinct().collect()}  # names of requests
            again = {name: replace(some[name], filters=flt.SearchFilters()) for name in narrow if name not in have}
            if again:
                found = found.unionByName(_pages(engine, again).withColumn("fell_back", F.lit(True)))
        rows = found if rows is None else rows.unionByName(found)
    return rows if rows is not None else engine.catalog.spark.createDataFrame([], "query string, rank int, id string, score double, best int, fell_back boolean")


def _plans(requests: dict[str, SearchRequest]) -> Iterator[dict[str, SearchRequest]]:
    """The requests in parts of at most NUMBERS numbers and FILTERS distinct filters."""
    some: dict[str, SearchRequest] = {}
    numbers, kinds = 0, set()
    for name, r in requests.items():
        more = len(r.query_vector or ()) + len(r.caption_vector or ()) + 1
        if some and (numbers + more > NUMBERS or len(kinds | {_own(r)}) > FILTERS):
            yield some
            some, numbers, kinds = {}, 0, set()
        some[name] = r
        numbers, kinds = numbers + more, kinds | {_own(r)}
    if some:
        yield some


def _own(r: SearchRequest) -> flt.SearchFilters:
    """A request's filters with what it dislikes, which is left out as `exclude_ids` are."""
    return replace(r.filters, exclude_ids=tuple(sorted({*r.filters.exclude_ids, *r.disliked})))


def passing(engine: Engine, kinds: list[flt.SearchFilters]) -> DataFrame:
    """(id, taken_at, source_video_id, passes): for each photo the numbers of the filters that it passes, if any."""
    c = engine.catalog
    photos = c["photos"].where("media_type = 'image' and error is null")
    plain = [i for i, f in enumerate(kinds) if not f.people and not f.album_id]
    tests = [F.when(flt.both(flt.predicates(f)), F.lit(i)) for i, f in enumerate(kinds) if i in plain]
    rows = photos.select("id", "taken_at", "source_video_id", (F.array_compact(F.array(*tests)) if tests else F.array()).cast("array<int>").alias("passes"))
    joined = [flt.apply(photos, f, c["faces"] if f.people else None, c["people"] if f.people else None, c["album_photos"] if f.album_id else None).select("id", F.lit(i).alias("number")) for i, f in enumerate(kinds) if i not in plain]
    if joined:
        also = reduce(DataFrame.unionByName, joined).groupBy("id").agg(F.collect_set("number").alias("also"))  # at most FILTERS numbers
        rows = rows.join(also, "id", "left").withColumn("passes", F.concat("passes", F.coalesce("also", F.expr("cast(array() as array<int>)")))).drop("also")
    return rows.where(F.size("passes") > 0)


def _pages(engine: Engine, requests: dict[str, SearchRequest]) -> DataFrame:
    from shoebox.plans.search import pool_size

    c, spark = engine.catalog, engine.catalog.spark
    kinds = list(dict.fromkeys(_own(r) for r in requests.values()))
    number = {f: i for i, f in enumerate(kinds)}
    allowed = passing(engine, kinds)
    weights = {name: {**engine.weights, **r.weights, "recency": 1.0} for name, r in requests.items()}
    ids = tuple(sorted({i for r in requests.values() for i in (*r.liked, *r.disliked)}))
    known = _stored(engine, ids, {r.model for r in requests.values()}) if ids else {}

    asked: dict[str, dict[str, list]] = {"clip": {}, "caption": {}}
    used: dict[str, set[str]] = {name: set() for name in requests}
    for name, r in requests.items():
        query = list(r.query_vector) if r.query_vector else None
        if query or r.liked:
            liked, disliked = ([known[i, r.model] for i in some if (i, r.model) in known] for some in (r.liked, r.disliked))
            moved = vector.rocchio(query, liked, disliked) if liked or disliked else query
            if moved is not None:
                asked["clip"].setdefault(r.model, []).append((name, moved, number[_own(r)], pool_size(r)))
            used[name].add("clip")
        if r.caption_vector:
            asked["caption"].setdefault(r.caption_model, []).append((name, list(r.caption_vector), number[_own(r)], pool_size(r)))
            used[name].add("caption")
    words = [(name, r.words, number[_own(r)], pool_size(r)) for name, r in requests.items() if r.words.strip()]
    signals: list[DataFrame] = []
    for model, queries in asked["clip"].items():
        own = c["image_embeddings"].where(F.col("model") == model).select(F.col("photo_id").alias("id"), F.col("embedding").alias("vector"))
        signals.append(_cut(_nearest(own.join(allowed.select("id", "passes"), "id"), queries), queries, [F.desc("score"), F.col("id")]).withColumn("signal", F.lit("clip")))
    for model, queries in asked["caption"].items():
        own = c["captions"].where(F.col("caption_embedding").isNotNull() & (F.col("embed_model") == model)).select(F.col("photo_id").alias("id"), F.col("caption_embedding").alias("vector"))
        first = _cut(_nearest(own.join(allowed.select("id", "passes"), "id"), queries), queries, [F.desc("score"), F.col("id")])
        best = first.groupBy("query", "id").agg(F.max("score").alias("score"))  # a photo's captions become one after the cut
        signals.append(_cut(best, queries, [F.desc("score"), F.col("id")]).withColumn("signal", F.lit("caption")))
    if words:
        table = spark.createDataFrame([(n, w, f) for n, w, f, _ in words], "query string, words string, filter int")
        wanted = table.select("query", "filter", F.explode(F.array_distinct(text.tokens("words"))).alias("token"))
        for n in {r.query for r in wanted.select("query").distinct().collect()}:  # names of requests
            used[n].update(("keyword", "ocr"))
        keyed = c["photos"].select("id", F.explode(text.tokens(F.array_join("keywords", " "))).alias("token"), F.lit(0.5).alias("weight"))
        said = c["captions"].select(F.col("photo_id").alias("id"), F.explode("tokens").alias("token"), F.lit(1.0).alias("weight"))
        seen = c["ocr_text"].select(F.col("photo_id").alias("id"), F.explode("tokens").alias("token"), F.lit(1.0).alias("weight"))
        for signal, tokens in (("keyword", said.unionByName(keyed)), ("ocr", seen)):
            hits = tokens.join(wanted, "token").groupBy("query", "filter", "id").agg(F.sum("weight").alias("score"))
            hits = hits.join(allowed.select("id", "passes"), "id").where(F.array_contains("passes", F.col("filter"))).select("query", "id", "score")
            signals.append(_cut(hits, words, [F.desc("score"), F.col("id")]).withColumn("signal", F.lit(signal)))
    newest = [(n, None, number[_own(r)], pool_size(r)) for n, r in requests.items() if not used[n]]
    if newest:
        most = max(n for *_, n in newest)
        wanted_by = spark.createDataFrame([(n, f) for n, _, f, _ in newest], "query string, filter int")
        of_filter = allowed.select("id", "taken_at", F.explode("passes").alias("filter")).where(F.col("filter").isin(*{f for _, _, f, _ in newest}))
        order = [F.desc_nulls_last("taken_at"), F.col("id")]
        first = of_filter.withColumn("place", F.row_number().over(Window.partitionBy("filter").orderBy(*order))).where(F.col("place") <= most)
        rows = first.join(wanted_by, "filter").select("query", "id", (-F.col("place")).cast("double").alias("score"))
        signals.append(_cut(rows, newest, [F.desc("score"), F.col("id")]).withColumn("signal", F.lit("recency")))

    facts = spark.createDataFrame(
        [(n, float(r.rrf_k), (r.k + r.offset) * 3, r.offset, r.k, {s: float(weights[n].get(s, 1.0)) for s in SIGNALS}) for n, r in requests.items()],
        "query string, rrf_k double, most int, skip int, page int, weights map<string,double>",
    )
    if not signals:
        return facts.select("query", F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("best"), F.lit(False).alias("fell_back")).limit(0)
    ranked = reduce(DataFrame.unionByName, [s.select("query", "signal", "id", "rank") for s in signals]).join(facts, "query")
    ranked = ranked.withColumn("weight", F.col("weights")[F.col("signal")]).where(F.col("weight") > 0)
    parts = [F.coalesce(F.max(F.when(F.col("signal") == s, F.col("weight") / (F.col("rrf_k") + F.col("rank")))), F.lit(0.0)) for s in SIGNALS]
    fused = ranked.groupBy("query", "id").agg(reduce(lambda a, b: a + b, parts).alias("score"), F.min("rank").alias("best"))
    order = [F.desc("score"), F.col("best"), F.col("id")]
    own = Window.partitionBy("query").orderBy(*order)
    first = fused.withColumn("place", F.row_number().over(own)).join(facts.select("query", "most", "skip", "page"), "query").where(F.col("place") <= F.col("most"))
    shown = first.join(c["photos"].select("id", "source_video_id"), "id")
    one = Window.partitionBy("query", F.coalesce("source_video_id", "id")).orderBy(*order)
    shown = shown.withColumn("turn", F.row_number().over(one)).where("turn = 1").withColumn("place", F.row_number().over(own))
    shown = shown.where((F.col("place") > F.col("skip")) & (F.col("place") <= F.col("skip") + F.col("page")))
    return shown.select("query", (F.col("place") - F.col("skip")).alias("rank"), "id", "score", "best", F.lit(False).alias("fell_back"))


def _stored(engine: Engine, ids: tuple[str, ...], models: set[str]) -> dict[tuple[str, str], list[float]]:
    """The vectors of all photos that some request likes or dislikes, in one look."""
    found = engine.catalog["image_embeddings"].where(F.col("model").isin(*models) & F.col("photo_id").isin(*ids))
    return {(r.photo_id, r.model): r.embedding for r in found.select("photo_id", "model", "embedding").collect()}


def _cut(rows: DataFrame, queries: list[tuple], order: list[Column]) -> DataFrame:
    """`rows` (query, id, score) with their rank, each query's pool of them."""
    pools = rows.sparkSession.createDataFrame([(q[0], q[3]) for q in queries], "query string, pool int")
    most = max(q[3] for q in queries)
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= most)
    return first.join(pools, "query").where(F.col("rank") <= F.col("pool")).drop("pool")


def _nearest(rows: DataFrame, queries: list[tuple]) -> DataFrame:
    """(query, id, score): of `rows` (id, vector, passes) each block's best for each query, with what ties with them."""
    most, cells, numbers = max(q[3] for q in queries), CELLS, groups.NUMBERS
    by: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        by.setdefault(len(q[1]), []).append(i)
    blocks = {d: (pa.array([queries[i][0] for i in own], pa.string()), np.array([queries[i][1] for i in own], float), np.array([queries[i][2] for i in own])) for d, own in by.items()}
    sent = rows.sparkSession.sparkContext.broadcast((blocks, max(q[2] for q in queries) + 1))  # at most NUMBERS numbers

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for have in groups.blocks_of(batches, numbers):
            yield from _best(*sent.value, have.combine_chunks(), most, cells)

    return rows.mapInArrow(best, "query string, id string, score double")


def _best(blocks: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]], filters: int, have: pa.Table, most: int, cells: int) -> Iterator[pa.RecordBatch]:
    """A block's best `most` rows for each query, some queries at a time, so that no task holds all queries' pools."""
    vectors, passes, ids = (have.column(c).chunk(0) for c in ("vector", "passes", "id"))
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    may = np.zeros((len(sizes), filters), bool)
    number = passes.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), passes.value_lengths().to_numpy())
    may[row[number < filters], number[number < filters]] = True
    for d, (names, asked, kind) in blocks.items():
        at = np.flatnonzero(sizes == d)
        if not len(at):
            continue
        rows = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        count, allowed, own = min(most, len(at)), may[at].T, ids.take(pa.array(at))
        step = max(1, cells // max(len(at), 4 * most))
        for first in range(0, len(names), step):
            near = np.where(allowed[kind[first : first + step]], np.round(asked[first : first + step] @ rows.T, 12), -np.inf)
            near[~np.isfinite(near)] = -np.inf
            floor = np.partition(near, len(at) - count, axis=1)[:, len(at) - count, None]
            i, j = np.nonzero((near >= floor) & np.isfinite(near))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i + first)), own.take(pa.array(j)), pa.array(near[i, j])], ["query", "id", "score"])
