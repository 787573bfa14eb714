"""Schemas of the collection's tables, and the catalogue that reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shoebox.sources.swap import put_in_place


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: DDL of each table; vectors are arrays, stemmed text is an array of tokens with repeats.
TABLES = {
    "photos": "id string, path string, file_hash string, size_bytes bigint, mtime double, media_type string, format string, taken_at timestamp_ntz, tz_offset_min int, lat double, lon double, place_name string, admin1 string, country string, camera string, lens string, focal_length float, focal_length_35mm float, aperture float, exposure_s float, iso int, width int, height int, orientation int, keywords array<string>, is_video_frame boolean, source_video_id string, frame_ts float, duration_s float, thumb_path string, phash string, sharpness float, indexed_at timestamp_ntz, error string",
    "image_embeddings": "photo_id string, model string, embedding array<float>, codes array<tinyint>",
    "captions": "photo_id string, model string, caption string, embed_model string, caption_embedding array<float>, tokens array<string>, created_at timestamp_ntz",
    "ocr_text": "photo_id string, text string, gate_score float, ran_ocr boolean, tokens array<string>",
    "faces": "id string, photo_id string, bbox array<int>, det_score float, embedding array<float>, cluster_id int, manual boolean",
    "people": "cluster_id int, name string, aliases array<string>, hidden boolean",
    "albums": "id string, title string, summary string, start_at timestamp_ntz, end_at timestamp_ntz, centroid_lat double, centroid_lon double, cover_photo_id string, auto boolean",
    "album_photos": "album_id string, photo_id string",
    "photo_groups": "kind string, group_id string, photo_id string, is_best boolean",
    "feedback": "id bigint, query string, photo_id string, label tinyint, created_at timestamp_ntz",
    "imports": "file_hash string, source_path string, dest_path string, status string, imported_at timestamp_ntz",
    "eval_queries": "id string, query string, category string, split string, relevant array<string>, grades map<string,int>",
}


def schema_of(table: str) -> T.StructType:
    """The StructType of one of TABLES; needs a running session to parse."""
    return _struct(TABLES[table])


@dataclass(frozen=True)
class Catalog:
    """Tables kept as Parquet below one root, in any store that Spark reads."""

    spark: SparkSession
    root: str

    def __getitem__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/{table}.parquet")

    def typed(self, table: str) -> DataFrame:
        """A table of TABLES with its declared schema, so that reading needs no look at the files."""
        return self.spark.read.schema(schema_of(table)).parquet(f"{self.root.rstrip('/')}/{table}.parquet")

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """Put `df` in the place of a table or, with `partition_by`, of those of its partitions that `df` has rows of.

        A whole table is written beside the old one, which `df` may read, and then put in its place (`put_in_place`). With
        `partition_by`, `df` must not read the table itself: Spark would delete what it has still to read.
        """
        path = f"{self.root.rstrip('/')}/{table}.parquet"
        if partition_by:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
        else:
            df.write.mode("overwrite").parquet(f"{path}.new")
            put_in_place(self.spark, f"{path}.new", path)
