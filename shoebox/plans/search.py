"""Hybrid search: filters inside every signal, fusion of ranks, hydration of the page, fallback without filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import text, vector
from shoebox.operators.ranking import collapse, keyword_signal, ranked, rrf
from shoebox.plans import filters as flt
from shoebox.plans.batch import search_many
from shoebox.schema import Catalog
from shoebox.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class SearchRequest:
    """What is asked: words and a query vector (from any encoder), filters, feedback, a page, weights by signal."""

    words: str = ""
    query_vector: tuple[float, ...] | None = None
    caption_vector: tuple[float, ...] | None = None
    filters: flt.SearchFilters = field(default_factory=flt.SearchFilters)
    liked: tuple[str, ...] = ()
    disliked: tuple[str, ...] = ()
    model: str = "default"
    caption_model: str = "default"
    approximate: bool = False
    k: int = 20
    offset: int = 0
    weights: dict[str, float] = field(default_factory=dict)
    rrf_k: int = 60


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    signals: tuple[str, ...]
    fell_back: bool


def pool_size(request: SearchRequest) -> int:
    return max(200, (request.k + request.offset) * 4)


class Engine:
    """Searches one catalogue. Each signal is a lazy frame that filters before it ranks."""

    def __init__(self, catalog: Catalog, weights: dict[str, float] | None = None, weights_file: str | None = None):
        """Weights of signals come from here, over them from a file of tuned ones ({"weights": ...}), over them from a
        request."""
        self.catalog, self.weights = catalog, dict(weights or {})
        if weights_file:
            rows = catalog.spark.read.schema("weights map<string, double>").option("multiLine", "true").json(weights_file)
            self.weights |= (rows.first() or {"weights": None})["weights"] or {}

    def candidates(self, request: SearchRequest, frames: bool = True) -> DataFrame:
        """Photos that pass the base predicate, the filters and the exclusions; `frames` says whether frames of videos
        are among them, as for search, or not, as for counts."""
        c = self.catalog
        photos = c["photos"].where("media_type = 'image' and error is null")
        photos = photos if frames else photos.where(~F.coalesce("is_video_frame", F.lit(False)))
        needs = request.filters
        rows = flt.apply(photos, needs, c["faces"] if needs.people else None, c["people"] if needs.people else None, c["album_photos"] if needs.album_id else None)
        return rows.where(~F.col("id").isin(*request.disliked)) if request.disliked else rows

    def _vectors(self, ids: tuple[str, ...], model: str) -> list[list[float]]:
        if not ids:
            return []
        found = self.catalog["image_embeddings"].where((F.col("model") == model) & F.col("photo_id").isin(*ids))
        return [r.embedding for r in found.select("embedding").collect()]  # the ids of one request

    def signals(self, request: SearchRequest) -> dict[str, DataFrame]:
        """(id, rank) for each signal that the request can use."""
        c, n, ids = self.catalog, pool_size(request), self.candidates(request).select("id")
        out: dict[str, DataFrame] = {}
        query = list(request.query_vector) if request.query_vector else None
        if query or request.liked:
            moved = vector.rocchio(query, self._vectors(request.liked, request.model), self._vectors(request.disliked, request.model)) if request.liked or request.disliked else query
            own = c["image_embeddings"].where(F.col("model") == request.model).withColumnRenamed("photo_id", "id").join(ids, "id")
            if request.approximate:
                scored = vector.top_k_by_codes(own, "embedding", "codes", moved, n, "id")
            else:
                scored = own.select("id", vector.dot("embedding", vector.literal(moved)).alias("score"))
            out["clip"] = ranked(scored, "id", [F.desc("score"), F.col("id")], n)
        if request.caption_vector:
            own = c["captions"].where(F.col("caption_embedding").isNotNull() & (F.col("embed_model") == request.caption_model)).select(F.col("photo_id").alias("id"), "caption_embedding").join(ids, "id")
            scored = own.select("id", vector.dot("caption_embedding", vector.literal(list(request.caption_vector))).alias("score"))
            first = scored.orderBy(F.desc("score"), "id").limit(n)  # the cut comes before a photo's captions become one
            out["caption"] = ranked(first.groupBy("id").agg(F.max("score").alias("score")), "id", [F.desc("score"), F.col("id")], n)
        wanted = self._tokens(request.words)
        if wanted:
            captions = c["captions"].select(F.col("photo_id").alias("id"), text.occurrences(F.col("tokens"), wanted).alias("hits"))
            keywords = c["photos"].select("id", text.occurrences(text.tokens(F.array_join("keywords", " ")), wanted).alias("hits"))
            both = [(captions.join(ids, "id"), 1.0), (keywords.join(ids, "id"), 0.5)]
            out["keyword"] = ranked(keyword_signal(both, n), "id", [F.desc("score"), F.col("id")], n)
            ocr = c["ocr_text"].select(F.col("photo_id").alias("id"), text.occurrences(F.col("tokens"), wanted).alias("score")).where("score > 0").join(ids, "id")
            out["ocr"] = ranked(ocr, "id", [F.desc("score"), F.col("id")], n)
        if not out:
            out["recency"] = ranked(self.candidates(request).select("id", "taken_at"), "id", [F.desc_nulls_last("taken_at"), F.col("id")], n)
        return out

    def _tokens(self, words: str) -> list[str]:
        if not words.strip():
            return []
        return list(dict.fromkeys(self.catalog.spark.range(1).select(text.tokens(F.lit(words)).alias("t")).first().t))

    def hydrate(self, fused: DataFrame, request: SearchRequest) -> DataFrame:
        """The page: one row for a video's frames, the newest caption, the parent's path. Wide columns join last."""
        c, most = self.catalog, (request.k + request.offset) * 3
        order = [F.desc("score"), F.col("best"), F.col("id")]
        first = fused.orderBy(*order).limit(most)
        photos = c["photos"]
        rows = F.broadcast(first).join(photos, "id")  # `most` ids
        rows = collapse(rows, F.coalesce("source_video_id", "id"), order)
        shown = rows.orderBy(*order).offset(request.offset).limit(request.k)
        # parents and captions of the page's ids alone: k rows meet the scans
        videos = F.broadcast(shown.select(F.col("source_video_id").alias("id")).where("id is not null").distinct())
        parents = photos.join(videos, "id", "left_semi").select(F.col("id").alias("source_video_id"), F.col("path").alias("source_path"))
        captions = c["captions"].where("caption is not null").select(F.col("photo_id").alias("id"), "caption", "created_at").join(F.broadcast(shown.select("id")), "id", "left_semi")
        caption = captions.groupBy("id").agg(F.max_by("caption", F.struct("created_at", "caption")).alias("caption"))
        return shown.join(F.broadcast(parents), "source_video_id", "left").join(F.broadcast(caption), "id", "left").orderBy(*order)

    def available(self, model: str = "default", caption_model: str = "default") -> tuple[str, ...]:
        """The signals whose tables hold anything: one row of each is looked at."""
        c = self.catalog
        looks = {
            "clip": c["image_embeddings"].where(F.col("model") == model), "caption": c["captions"].where(F.col("caption_embedding").isNotNull() & (F.col("embed_model") == caption_model)),
            "keyword": c["captions"].where("size(tokens) > 0"), "ocr": c["ocr_text"].where("size(tokens) > 0"),
        }
        return tuple(name for name, rows in looks.items() if not rows.isEmpty())

    def search(self, request: SearchRequest) -> SearchResult:
        """The hits; when filters leave nothing, the same request without any, and a flag that says so."""
        signals = self.signals(request)
        weights = {**self.weights, **request.weights, "recency": 1.0}
        hits = self.hydrate(rrf(signals, weights, request.rrf_k), request)
        if request.filters.is_empty() or request.liked:
            return SearchResult(hits, tuple(signals), False)
        page = hits.collect()  # at most k rows: worked out once, for the look whether there are any and for the caller
        if page:
            return SearchResult(self.catalog.spark.createDataFrame(page, hits.schema), tuple(signals), False)
        again = SearchRequest(**{**request.__dict__, "filters": flt.SearchFilters()})
        found = self.search(again)
        return SearchResult(found.hits, found.signals, True)

    def search_many(self, requests: dict[str, SearchRequest]) -> DataFrame:
        """(query, rank, id, score, best, fell_back) of every named request's page, all requests in one plan."""
        return search_many(self, requests)

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as a table in the checkpoint folder, worked out once."""
        ensure_checkpoint_dir(self.catalog.spark)
        return df.checkpoint()

    def similar(self, photo_id: str, model: str = "default", k: int = 20) -> SearchResult:
        """Photos like a stored one, which is left out; no other signal takes part."""
        own = self._vectors((photo_id,), model)
        if not own:  # nothing is like a photo that has no vector
            return SearchResult(self.hydrate(rrf({"clip": self.catalog["photos"].select("id", F.lit(1).alias("rank")).limit(0)}, {}), SearchRequest(k=k)), (), False)
        request = SearchRequest(query_vector=tuple(own[0]), disliked=(), model=model, k=k, filters=flt.SearchFilters(exclude_ids=(photo_id,)))
        signals = {"clip": self.signals(request)["clip"]}
        return SearchResult(self.hydrate(rrf(signals, {}), request), ("clip",), False)
