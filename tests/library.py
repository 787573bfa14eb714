"""A small invented library with known answers, written as a catalogue."""

from __future__ import annotations

from datetime import datetime

from shoebox.functions.text import tokens
from shoebox.functions.vector import codes
from shoebox.schema import Catalog, schema_of

PHOTOS = [
    # id, taken, position, place, camera, lens, focal length, sensitivity, keywords
    ("ferry", datetime(2019, 3, 4, 7, 15), (38.71, -9.14), ("Lisbon", "Lisboa", "Portugal"), "Pentax K-3", "HD DA 35mm F2.4 AL", 35.0, 200, ["boat", "Blue"]),
    ("tram", datetime(2019, 3, 9, 16, 40), (38.73, -9.13), ("Lisbon", "Lisboa", "Portugal"), "Pentax K-3", "HD DA 35mm F2.4 AL", 35.0, 200, ["rails"]),
    ("lanterns", datetime(2019, 10, 21, 20, 5), (-1.29, 36.82), ("Nairobi", "Nairobi County", "Kenya"), "Leica Q2", None, 28.0, 6400, ["evening"]),
    ("canal", datetime(2017, 5, 30, 13, 0), (51.05, 3.72), ("Ghent", "East Flanders", "Belgium"), "Olympus E-M1", "M.Zuiko 45mm F1.8", 45.0, 200, ["water"]),
    ("bread", datetime(2017, 11, 2, 6, 30), None, None, "Pentax K-3", "DA 16-35mm F4", 30.0, 200, ["kitchen"]),
    ("gate", datetime(2016, 1, 31, 15, 45), None, None, "Pentax K-3", "HD DA 35mm F2.4 AL", 35.0, 200, []),
]
CAPTIONS = [("ferry", "a blue boat crossing the river"), ("tram", "a blue ticket machine"), ("lanterns", "a street in the evening"), ("canal", "boats moored along the water")]
VECTORS = {"ferry": [1.0, 0.0, 0.1], "tram": [0.9, 0.1, 0.0], "lanterns": [0.0, 1.0, 0.0], "canal": [0.0, 0.3, 1.0], "bread": [0.3, 0.3, 0.3], "gate": [0.1, 0.1, 0.1]}
#: Caption vectors of two models; those of the second would rank the other way round.
CAPTION_VECTORS = [("ferry", "default", [1.0, 0.0]), ("canal", "default", [0.0, 1.0]), ("ferry", "other", [0.0, 1.0]), ("canal", "other", [1.0, 0.0])]


def build(spark, root: str) -> Catalog:
    catalog = Catalog(spark, root)
    names = schema_of("photos").fieldNames()
    known = []
    for name, at, position, place, camera, lens, focal, iso, keywords in PHOTOS:
        known.append(
            {
                "id": name, "path": f"/pictures/{name}.jpg", "file_hash": name, "taken_at": at, "camera": camera, "lens": lens, "focal_length": focal, "aperture": 2.4, "iso": iso, "width": 600, "height": 400,
                "keywords": keywords, "media_type": "image", "is_video_frame": False,
                **dict(zip(("lat", "lon"), position or ())), **dict(zip(("place_name", "admin1", "country"), place or ())),
            }
        )
    clip = {"id": "clip", "path": "/pictures/clip.mp4", "media_type": "video", "is_video_frame": False, "keywords": []}
    frame = {"id": "frame", "path": "/pictures/clip.mp4#t=1.00", "media_type": "image", "is_video_frame": True, "source_video_id": "clip", "taken_at": datetime(2018, 1, 1), "camera": "Phone", "keywords": []}
    broken = {"id": "broken", "path": "/pictures/broken.jpg", "media_type": "image", "error": "unreadable", "is_video_frame": False, "keywords": []}
    rows = [tuple(row.get(n) for n in names) for row in [*known, clip, frame, broken]]
    catalog.write("photos", spark.createDataFrame(rows, schema_of("photos")))
    vectors = spark.createDataFrame([(i, "default", v, None) for i, v in VECTORS.items()], schema_of("image_embeddings"))
    catalog.write("image_embeddings", vectors.withColumn("codes", codes("embedding")))
    captions = spark.createDataFrame([(i, "m", c, None, None, None, None) for i, c in CAPTIONS] + [(i, m, None, m, v, None, None) for i, m, v in CAPTION_VECTORS], schema_of("captions"))
    catalog.write("captions", captions.withColumn("tokens", tokens("caption")))
    catalog.write("ocr_text", spark.createDataFrame([("tram", "LINE TWELVE", 0.9, True, ["line", "twelv"])], schema_of("ocr_text")))
    catalog.write("faces", spark.createDataFrame([("f1", "ferry", None, 0.9, None, 1, False), ("f2", "ferry", None, 0.8, None, 2, False), ("f3", "tram", None, 0.8, None, 1, False)], schema_of("faces")))
    catalog.write("people", spark.createDataFrame([(1, "Noor", ["Noori"], False), (2, "Ivo", [], False)], schema_of("people")))
    catalog.write("album_photos", spark.createDataFrame([("walk", "canal")], schema_of("album_photos")))
    return catalog
