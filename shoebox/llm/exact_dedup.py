"""Exact de-duplication by content-defined chunk recipes (operator 13). DataFrame functions only.

Runs of white space count as one space. A normalised text is cut into chunks after words that their own hash names
(words of ANCHOR_LENGTH characters or more, one in ANCHORS of them), and a chunk of over LONGEST characters into pieces
of that length, so equal passages in different documents give equal chunks. A chunk's identifier is its 64-bit hash.
Identifiers are verified: the distinct chunks are brought together once, by content, and a hash that two of them share
is told apart by a number for each content. So texts are equal exactly if their ordered lists of identifiers, their
recipes, are. From there on only recipes move: they are grouped, and rows meet the groups of two rows or more.

Defined cases: a null text counts as the empty text; of a group the row of smallest id stays, rows without an id come
last, and of rows that repeat id and text one stays; rows that repeat an id with other texts are rows of their own; an
empty table gives an empty result; of the other columns only those named in `carry` are read, and output columns whose
name such a column has get a "_" more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize, unused

SPACE = r"[\x20\x09-\x0D]+"
ANCHORS, ANCHOR_LENGTH, LONGEST = 32, 5, 4_096


def _marked(text: Column) -> Column:
    """The normalised text with a line feed, which it cannot hold itself, where a chunk ends."""
    ends = lambda w: (F.length(w) >= ANCHOR_LENGTH) & (F.xxhash64(w) % ANCHORS == 0)
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE)
    return F.array_join(F.transform(words, lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w)), " ")


def _chunks(marked: Column) -> Column:
    cut = lambda c: F.when(F.length(c) <= LONGEST, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0)))
    return F.flatten(F.transform(F.split(marked, "\n"), cut))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), bits: int = 64) -> DataFrame:
    """Every row of `docs`: id, the carried columns, keep_id, group_size, kept, text_sha256. `bits`: of a chunk's hash."""
    carried = {c: f"carried_{i}" for i, c in enumerate(carry)}
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    marked = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(as_) for c, as_ in carried.items()], _marked(F.col(text_col)).alias("marked"))

    contents = marked.select(F.explode(_chunks(F.col("marked"))).alias("chunk")).select(hashed("chunk").alias("hash"), "chunk").distinct()
    shared = materialize(contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-shared")
    tell_apart = not shared.isEmpty()

    chunks = _chunks(F.col("marked"))
    rows = materialize(
        marked.select(
            "id", *carried.values(), F.monotonically_increasing_id().alias("row"), F.sha2(F.replace("marked", F.lit("\n"), F.lit("")), 256).alias("sha"),
            F.transform(chunks, hashed).alias("recipe"), *([chunks.alias("chunks")] if tell_apart else []),
        ),
        "chunk-recipes",
    )
    key, made = ["recipe"], [shared, rows]
    if tell_apart:
        number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
        others = contents.join(shared, "hash").select("hash", "chunk", number.alias("number")).where("number > 1")
        held = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("hash", hashed("chunk")).join(others, ["hash", "chunk"])
        held = held.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "number"))).alias("numbers"))
        rows = materialize(rows.drop("chunks").join(held, "row", "left").withColumn("numbers", F.coalesce("numbers", F.expr("cast(array() as array<struct<at:int,number:int>>)"))), "chunk-numbers")
        key, made = [*key, "numbers"], [*made, rows]

    groups = rows.groupBy(*key).agg(F.count("*").alias("size"), F.min("id").alias("keep"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("stays"))
    groups = materialize(groups.where("size > 1"), "chunk-groups")
    keep_id, size, kept, sha = unused(docs.select(id_col, *carry), "keep_id", "group_size", "kept", "text_sha256")
    out = rows.join(groups, key, "left").select(
        F.col("id").alias(id_col), *[F.col(as_).alias(c) for c, as_ in carried.items()],
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias(keep_id),
        F.coalesce("size", F.lit(1)).cast("long").alias(size), F.coalesce(F.col("row") == F.col("stays"), F.lit(True)).alias(kept), F.col("sha").alias(sha),
    )
    result = materialize(out, "chunk-result")
    discard(groups, *made)
    return result
