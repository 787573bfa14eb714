import json
from datetime import date

import pytest

from shoebox.plans import filters as flt
from shoebox.plans.search import Engine, SearchRequest
from shoebox.plans.tools import Tools
from tests.library import build


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(build(spark, str(tmp_path_factory.mktemp("library"))))


def found(engine, **kind):
    f = flt.SearchFilters(**kind)
    return {r.id for r in engine.candidates(SearchRequest(filters=f), frames=False).collect()}


@pytest.mark.parametrize(
    "kind, expected",
    [
        ({"place": " nairobi "}, {"lanterns"}),
        ({"place": "PORTUGAL"}, {"ferry", "tram"}),
        ({"date_from": date(2017, 1, 1), "date_to": date(2017, 12, 31)}, {"canal", "bread"}),
        ({"date_to": date(2016, 1, 31)}, {"gate"}),
        ({"lens": "35mm"}, {"ferry", "tram", "gate"}),
        ({"lens": "da16"}, {"bread"}),
        ({"iso_min": 6400}, {"lanterns"}),
        ({"focal_min": 0.0, "focal_max": 28.0}, {"lanterns"}),
        ({"months": (3, 10, 99)}, {"ferry", "tram", "lanterns"}),
        ({"years": (2017,)}, {"canal", "bread"}),
        ({"near": (38.71, -9.14), "radius_km": 5.0}, {"ferry", "tram"}),
        ({"camera": "pentax"}, {"ferry", "tram", "bread", "gate"}),
        ({"people": ("noor",)}, {"ferry", "tram"}),
        ({"people": ("NOORI", "ivo")}, {"ferry"}),
        ({"keywords": ("blue", "water")}, {"ferry", "canal"}),
        ({"album_id": "walk"}, {"canal"}),
        ({"orientation": "square"}, set()),
        ({"exclude_ids": ("ferry",), "place": "lisbon"}, {"tram"}),
    ],
)
def test_filters(engine, kind, expected):
    assert found(engine, **kind) == expected


def test_frames_are_searched_but_not_counted(engine):
    ask = SearchRequest(filters=flt.SearchFilters(media="video"))
    assert [r.id for r in engine.candidates(ask).collect()] == ["frame"] and engine.candidates(ask, frames=False).count() == 0


def test_recency_when_nothing_is_wanted(engine):
    result = engine.search(SearchRequest(filters=flt.SearchFilters(place="Lisbon")))
    assert result.signals == ("recency",) and [r.id for r in result.hits.collect()] == ["tram", "ferry"]


def test_words_and_vectors_are_fused(engine):
    result = engine.search(SearchRequest(words="blue boats", query_vector=(1.0, 0.0, 0.0), k=3))
    assert set(result.signals) == {"clip", "keyword", "ocr"}
    hits = result.hits.collect()
    assert [r.id for r in hits][:2] == ["ferry", "tram"] and hits[1].caption == "a blue ticket machine"


def test_approximate_search_finds_the_same(engine):
    ask = {"query_vector": (0.6, 0.0, 0.8), "k": 3}
    exact, near = (engine.search(SearchRequest(approximate=a, **ask)).hits.select("id", "score").collect() for a in (False, True))
    assert exact == near


def test_captions_of_one_model_alone_are_compared(engine):
    ask = SearchRequest(caption_vector=(1.0, 0.0), k=1)
    assert [r.id for r in engine.search(ask).hits.collect()] == ["ferry"]
    assert engine.available() == ("clip", "caption", "keyword", "ocr") and "caption" not in engine.available(caption_model="none")


def test_stop_words_alone_rank_nothing(engine):
    assert engine.search(SearchRequest(words="the of and")).signals == ("recency",)


def test_fallback_drops_filters_and_says_so(engine):
    result = engine.search(SearchRequest(words="evening", filters=flt.SearchFilters(place="nowhere")))
    assert result.fell_back and [r.id for r in result.hits.collect()] == ["lanterns"]


def test_pages_meet(engine):
    ask = {"query_vector": (1.0, 0.2, 0.1)}
    six = [r.id for r in engine.search(SearchRequest(k=6, **ask)).hits.collect()]
    assert len(six) == 6 and [r.id for r in engine.search(SearchRequest(k=2, offset=2, **ask)).hits.collect()] == six[2:4]


def test_feedback_moves_the_query_and_excludes_what_is_disliked(engine):
    result = engine.search(SearchRequest(query_vector=(1.0, 0.0, 0.0), liked=("canal",), disliked=("ferry",)))
    ids = [r.id for r in result.hits.collect()]
    assert "ferry" not in ids and "canal" in ids


def test_weights_come_from_a_file_below_those_of_a_request(engine, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"weights": {"clip": 0.0, "keyword": 1.0}}))
    own = Engine(engine.catalog, weights_file=str(tmp_path / "w.json"))
    ask = {"words": "evening", "query_vector": (1.0, 0.0, 0.0)}
    assert [r.id for r in own.search(SearchRequest(**ask)).hits.collect()] == ["lanterns"]
    assert len(own.search(SearchRequest(weights={"clip": 1.0}, **ask)).hits.collect()) == 6


def test_merged_filters_and_chips():
    base, own = flt.SearchFilters(place="Ghent", iso_min=100), flt.SearchFilters(iso_min=0)
    assert base.merged(own) == flt.SearchFilters(place="Ghent", iso_min=0)
    assert flt.SearchFilters().is_empty() and not own.is_empty()
    assert base.chips() == [{"field": "place", "value": "Ghent"}, {"field": "iso_min", "value": 100}]


def test_similar_leaves_itself_out(engine):
    ids = [r.id for r in engine.similar("ferry", k=3).hits.collect()]
    assert ids[0] == "tram" and "ferry" not in ids


def test_tools_check_arguments_and_ground_citations(engine):
    tools = Tools(engine)
    assert tools.run("count_by", {"dimension": "city", "filters": {"years": (2019,)}}) == {"groups": [("Lisbon", 2), ("Nairobi", 1)], "total": 3}
    assert "error" in tools.run("drop", {}) and "error" in tools.run("count_by", {"dimension": "x'; --"}) and "error" in tools.run("newest", {"filters": {"sql": "1"}})
    assert tools.run("first_last", {"filters": {"place": "Lisbon"}})["total"] == 2
    assert tools.run("newest", {"filters": {"place": "Lisbon"}, "limit": 1}) == {"ids": ["tram"]}
    assert tools.run("count_by", {"dimension": "camera"})["total"] == 6
    assert tools.grounded(["tram", "lanterns", "tram", "ferry"]) == ["tram", "ferry"]
