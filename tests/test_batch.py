from dataclasses import replace
from datetime import date

import numpy as np
import pyarrow as pa
import pytest

from shoebox.operators import ranking
from shoebox.plans import batch
from shoebox.plans import filters as flt
from shoebox.plans.search import Engine, SearchRequest
from tests.library import build


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(build(spark, str(tmp_path_factory.mktemp("library"))), weights={"caption": 0.5})


V, W = (1.0, 0.0, 0.0), (0.2, 0.9, 0.1)
REQUESTS = {
    "words": SearchRequest(words="blue boats"),
    "vector": SearchRequest(query_vector=V, k=3),
    "both": SearchRequest(words="line boats", query_vector=W, caption_vector=(1.0, 0.2), k=4, weights={"clip": 2.0}),
    "place": SearchRequest(words="blue", query_vector=V, filters=flt.SearchFilters(place="Lisbon")),
    "dates": SearchRequest(query_vector=W, filters=flt.SearchFilters(date_from=date(2017, 1, 1), date_to=date(2018, 12, 31))),
    "people": SearchRequest(query_vector=V, filters=flt.SearchFilters(people=("noor",))),
    "album": SearchRequest(filters=flt.SearchFilters(album_id="walk")),
    "newest": SearchRequest(k=2),
    "newest page": SearchRequest(k=2, offset=2),
    "nothing": SearchRequest(words="boats", filters=flt.SearchFilters(place="Nowhere")),
    "nothing new": SearchRequest(filters=flt.SearchFilters(place="Nowhere"), k=3),
    "liked": SearchRequest(query_vector=V, liked=("canal",), disliked=("tram",)),
    "other model": SearchRequest(caption_vector=(1.0, 0.0), caption_model="other"),
    "unheard": SearchRequest(words="zeppelin", query_vector=None),
    "stop": SearchRequest(words="the of"),
    "no weight": SearchRequest(query_vector=V, words="boats", weights={"clip": 0.0}),
}


def alone(engine, requests):
    out = {}
    for name, r in requests.items():
        result = engine.search(r)
        out[name] = [(i + 1, h.id, round(h.score, 12), h.best, result.fell_back) for i, h in enumerate(result.hits.collect())]
    return {name: rows for name, rows in out.items() if rows}


def together(engine, requests):
    out = {}
    for r in engine.search_many(requests).orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r["rank"], r.id, round(r.score, 12), r.best, r.fell_back))
    return out


def test_many_are_as_one_by_one(engine):
    assert together(engine, REQUESTS) == alone(engine, REQUESTS)


def test_more_requests_than_one_plan_takes(engine, monkeypatch):
    few = {n: REQUESTS[n] for n in ("vector", "place", "newest", "nothing")}
    whole = together(engine, few)
    monkeypatch.setattr(batch, "FILTERS", 1)
    assert len(list(batch._plans(few))) == 4 and together(engine, few) == whole
    assert engine.search_many({}).collect() == []


def test_frames_of_a_video_are_one_hit_and_copies_tie(engine):
    frames = {"frames": SearchRequest(filters=flt.SearchFilters(media="video"))}
    assert together(engine, frames) == alone(engine, frames) == {"frames": [(1, "frame", round(1 / 61, 12), 1, False)]}


def test_scores_of_many(engine, spark):
    asked = {n: replace(REQUESTS[n], k=10) for n in ("vector", "words", "unheard")}
    judged = spark.createDataFrame([("vector", "ferry", 1), ("words", "tram", 2), ("unheard", "gate", 1)], "query string, id string, grade int")
    got = {r.query: r for r in ranking.recall_precision_mrr_ndcg(engine.search_many(asked).select("query", "id", "rank"), judged).collect()}
    assert got["vector"].mrr == 1.0 and 0 < got["words"].mrr <= 1 and got["unheard"].mrr == 0.0


def test_a_photo_without_a_vector_is_like_nothing(engine):
    assert engine.similar("nobody").hits.collect() == []


def test_a_task_passes_on_the_best_some_queries_at_a_time():
    rng = np.random.default_rng(5)
    rows, asked, kind = rng.normal(size=(40, 4)), rng.normal(size=(30, 4)), np.arange(30) % 2
    have = pa.table({"id": [f"r{i}" for i in range(40)], "vector": pa.array(rows.tolist(), pa.list_(pa.float64())), "passes": pa.array([[i % 2] for i in range(40)], pa.list_(pa.int32()))})
    parts = list(batch._best({4: (pa.array([f"q{i}" for i in range(30)]), asked, kind)}, 2, have, 5, 200))
    assert len(parts) == 6 and max(p.num_rows for p in parts) <= 5 * 5
    got = {(r["query"], r["id"]) for p in parts for r in p.to_pylist()}
    assert got == {(f"q{i}", f"r{j}") for i in range(30) for j in sorted(range(i % 2, 40, 2), key=lambda j: -(asked[i] @ rows[j]))[:5]}
