"""A pipeline over `documents`; each stage is written as Parquet and read again as the next one's input.

Quality classifier, line de-duplication, near-duplicate removal, mixing of sources, BPE encoding and decoding.
Defined cases: see each operator; a document whose lines all recur elsewhere goes with its last line; of a group of
near duplicates the one of smallest id stays, and of rows that repeat an id the one of least text; rows without an id stay until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import jaccard_join, line_templates, mixture, quality
from shoebox.llm.bpe import ByteBPE
from shoebox.llm.queries import held_out, tokenizer_path
from shoebox.llm.tables import collecting, discard, materialize, read_table, short_batches, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Equal texts of one site are judged alike, so a digest of both and the id tell the rejected rows; texts are not written along.
    """
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    judged = ("text", "source", "lang")
    digest = F.xxhash64(*judged, *[F.col(c).isNull() for c in judged])
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).cast("long").alias("row_id"), digest.alias("row_digest"))
    with collecting() as made:
        scored = quality.score_quality(keyed, labels, carry=("row_id", "row_digest"))
        rejected = materialize(scored.where("not quality_keep").select("row_id", "row_digest").distinct(), "quality-rejected")
    discard(*(table for table in made if table is not rejected))
    return without(keyed, rejected, ["row_id", "row_digest"]).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur from two different texts on go, and documents of which nothing is left."""
    left = line_templates.drop_recurring_lines(docs.select(*COLUMNS), min_texts=2)
    return left.where((F.col("lines_dropped") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    with collecting() as made:
        groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
        gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "dedup-gone")
    discard(*(table for table in made if table is not gone))
    stay = without(docs.where("doc_id is not null"), gone, ["doc_id"])
    several = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "dedup-several")
    if not several.isEmpty():  # of an id's rows the one of least text stays, which was the one compared
        least = F.min(F.struct(F.col("text").isNull().alias("none"), "text", "lang", "source", "n_chars")).alias("least")
        one = stay.join(several, "doc_id").groupBy("doc_id").agg(least).select("doc_id", *[f"least.{c}" for c in COLUMNS[1:]])
        stay = stay.join(several, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)
    return stay.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch of the mix."""
    return mixture.mix(docs.select(*COLUMNS), entropy_fraction=0.5, max_repeats=4.0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to."""
    short_batches(spark)
    bpe = ByteBPE(spark, tokenizer_path("byte_bpe_50k.json"))
    coded = docs.select("doc_id", "lang", "source", bpe.round_trip("text").alias("bpe"))
    return coded.select("doc_id", "lang", "source", F.size("bpe.ids").cast("long").alias("n_tokens"), "bpe.ids", F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL has no trained classifier and no BPE encoder: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again for the next. When a stage's result is
    written, its own tables and the result before it go."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before, *(table for table in made if table is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
