"""Structured filters as Catalyst predicates and semi-joins. All filters given hold together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres per degree, and how far apart sides may be in a square picture.
KM_PER_DEGREE, SQUARE, LEAN = 111.32, 0.05, 1.05


@dataclass(frozen=True)
class SearchFilters:
    date_from: date | None = None
    date_to: date | None = None
    months: tuple[int, ...] = ()
    years: tuple[int, ...] = ()
    place: str | None = None
    near: tuple[float, float] | None = None
    radius_km: float = 25.0
    camera: str | None = None
    lens: str | None = None
    people: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    album_id: str | None = None
    focal_min: float | None = None
    focal_max: float | None = None
    aperture_min: float | None = None
    aperture_max: float | None = None
    iso_min: int | None = None
    iso_max: int | None = None
    media: str | None = None
    orientation: str | None = None
    exclude_ids: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "months", tuple(sorted({m for m in self.months if 1 <= m <= 12})))

    def given(self) -> dict:
        """The filters that say something; a radius alone doesn't."""
        return {f.name: v for f in fields(self) if f.name != "radius_km" and (v := getattr(self, f.name)) not in (None, (), "")}

    def is_empty(self) -> bool:
        return not self.given()

    def chips(self) -> list[dict]:
        """What is asked for, field by field, for a reader to see and edit."""
        return [{"field": name, "value": value} for name, value in self.given().items()]

    def merged(self, explicit: SearchFilters) -> SearchFilters:
        """These filters with those that `explicit` gives in their place."""
        own = explicit.given()
        return replace(self, **own, **({"radius_km": explicit.radius_km} if "near" in own else {}))


def date_range(c: Column, start: date | None = None, end: date | None = None) -> Column:
    """From midnight of `start` through the whole day `end`."""
    parts = [c >= F.lit(start).cast("timestamp_ntz")] * (start is not None)
    parts += [c < F.lit(end + timedelta(days=1)).cast("timestamp_ntz")] * (end is not None)
    return both(parts)


def place_is(value: str, *columns: str) -> Column:
    """Equality without regard to case in any of the columns."""
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)) == value.strip().lower() for c in columns])


def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Equirectangular distance, for short ranges."""
    north = (lat - lat0) * KM_PER_DEGREE
    east = (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(F.lit(lat0)))
    return F.sqrt(north * north + east * east)


def near(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float = 25.0) -> Column:
    """Within the radius; a plain range of latitudes comes first, which scans can use to skip row groups."""
    degrees = radius_km / KM_PER_DEGREE * 1.000001
    return lat.between(lat0 - degrees, lat0 + degrees) & (distance_km(lat, lon, lat0, lon0) <= radius_km)


def lens_is(c: Column, value: str) -> Column:
    """A prime ("50mm") matches that focal length alone and not a zoom that ends in it; else a part of the name."""
    prime = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*mm\s*", value, re.IGNORECASE)
    if prime:
        return c.rlike(rf"(?i)(^|[^0-9.\-]){re.escape(prime[1])}(\.0)?\s?mm")
    return F.lower(F.replace(c, F.lit(" "), F.lit(""))).contains(value.lower().replace(" ", ""))


def between(c: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds, each where given; 0 is a bound."""
    return both([c >= low] * (low is not None) + [c <= high] * (high is not None))


def any_keyword(c: Column, words: tuple[str, ...]) -> Column:
    wanted = [w.lower() for w in words]
    return F.exists(c, lambda w: F.lower(w).isin(wanted))


def oriented(width: Column, height: Column, kind: str) -> Column:
    return {
        "landscape": width > LEAN * height,
        "portrait": height > LEAN * width,
        "square": F.abs(width - height) <= SQUARE * F.greatest(width, height),
    }[kind]


def under_root(path: Column, roots: tuple[str, ...]) -> Column:
    """A path that is one of the roots or lies below it; none without roots."""
    return reduce(lambda a, b: a | b, [(path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def predicates(f: SearchFilters) -> list[Column]:
    """Predicates on the photo table alone, in terms of its own columns."""
    out: list[Column] = []
    if f.date_from or f.date_to:
        out.append(date_range(F.col("taken_at"), f.date_from, f.date_to))
    if f.months:
        out.append(F.month("taken_at").isin(*f.months))
    if f.years:
        out.append(F.year("taken_at").isin(*f.years))
    if f.place:
        out.append(place_is(f.place, "place_name", "admin1", "country"))
    if f.near:
        out.append(near(F.col("lat"), F.col("lon"), *f.near, f.radius_km))
    if f.camera:
        out.append(F.lower("camera").contains(f.camera.lower()))
    if f.lens:
        out.append(lens_is(F.col("lens"), f.lens))
    for name, column in (("focal", "focal_length"), ("aperture", "aperture"), ("iso", "iso")):
        low, high = getattr(f, f"{name}_min"), getattr(f, f"{name}_max")
        if low is not None or high is not None:
            out.append(between(F.col(column), low, high))
    if f.media:
        out.append(F.col("is_video_frame") if f.media == "video" else ~F.col("is_video_frame"))
    if f.orientation:
        out.append(oriented(F.col("width"), F.col("height"), f.orientation))
    if f.keywords:
        out.append(any_keyword(F.col("keywords"), f.keywords))
    if f.exclude_ids:
        out.append(~F.col("id").isin(*f.exclude_ids))
    return out


def with_all(rows: DataFrame, key: str, members: DataFrame, member_key: str, matches: list[Column]) -> DataFrame:
    """Rows for which `members` has, for every one of the predicates, a row that meets it: a semi-join for each."""
    for match in matches:
        rows = rows.join(members.where(match).select(F.col(member_key).alias(key)), key, "left_semi")
    return rows


def apply(photos: DataFrame, f: SearchFilters, faces: DataFrame | None = None, people: DataFrame | None = None, album_photos: DataFrame | None = None) -> DataFrame:
    """The photos that meet all filters."""
    rows = photos.where(both(predicates(f)))
    if f.people:
        named = faces.join(people, "cluster_id").select("photo_id", "name", "aliases")
        matches = [_called(p) for p in f.people]
        rows = with_all(rows, "id", named, "photo_id", matches)
    if f.album_id:
        rows = rows.join(album_photos.where(F.col("album_id") == f.album_id).select(F.col("photo_id").alias("id")), "id", "left_semi")
    return rows


def _called(person: str) -> Column:
    return F.coalesce((F.lower("name") == person.lower()) | F.exists("aliases", lambda a: F.lower(a) == person.lower()), F.lit(False))
