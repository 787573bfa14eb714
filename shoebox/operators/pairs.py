"""Training pairs and what keeps them apart from the evaluation set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.text import hash_bucket, words
from shoebox.operators.timeline import seconds_between

#: Bytes of judged texts' words that are sent to all tasks.
SENT = 32 << 20


def same_scene(rows: DataFrame, anchors: DataFrame, camera: str, at: str, id_col: str, minutes: float = 10.0) -> DataFrame:
    """(anchor_id, id): rows of the anchor's camera (null equals null) within `minutes` of it, itself left out.

    Time is cut into slots of that length; rows meet only the anchors of their own and the neighbouring slots, so a
    camera with very many rows is spread over its slots.
    """
    width = int(minutes * 60)
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (width * 1_000_000))
    left = anchors.select(F.col(id_col).alias("anchor_id"), F.col(camera).alias("anchor_camera"), F.col(at).alias("anchor_at"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    right = rows.select(F.col(id_col).alias("id"), F.col(camera).alias("camera"), F.col(at).alias("at"), slot.alias("slot"))
    met = left.join(right, (left.slot == right.slot) & F.col("anchor_camera").eqNullSafe(F.col("camera")))
    gap = F.abs(seconds_between(F.col("at"), F.col("anchor_at")))
    return met.where((gap <= width) & (F.col("anchor_id") != F.col("id"))).select("anchor_id", "id")


def group_neighbours(groups: DataFrame, anchors: DataFrame, group: str, id_col: str) -> DataFrame:
    """Ids that share a group with an anchor: a semi-join on the groups, not all pairs in them."""
    held = groups.join(anchors.select(id_col), id_col, "left_semi").select(group).distinct()
    return groups.join(held, group, "left_semi").select(id_col).distinct()


def sentences(text: Column | str) -> Column:
    """Trimmed sentences of a text."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def normal(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def leaked(rows: DataFrame, id_col: str, text_col: str, judged: DataFrame, judged_id: str, judged_text: str, least_words: int = 4) -> DataFrame:
    """(id, judged_id): rows that share a normalised sentence of at least so many words with a judged text."""

    def said(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        each = df.select(F.col(key).alias(name), F.explode(sentences(text)).alias("s")).select(name, normal(F.col("s")).alias("s"))
        return each.where(F.size(F.split("s", " ")) >= least_words).distinct()

    return said(rows, id_col, text_col, "id").join(said(judged, judged_id, judged_text, "judged_id"), "s").select("id", "judged_id").distinct()


def split_by_hash(text: Column, test_share: float, names: tuple[str, str] = ("test", "dev")) -> Column:
    """A split that a key keeps for ever: by its sha1 modulo 1000."""
    return F.when(hash_bucket(text) < int(test_share * 1000), names[0]).otherwise(names[1])


#: Keywords that say nothing about a picture, and openings of captions that say nothing either.
GENERIC_KEYWORDS = ("photo", "photos", "image", "picked", "rejected", "edited", "export", "places", "people")
OPENING = r"(?i)^(the|this) (image|photo|picture) (shows|is|depicts|features) "


def caption_sentences(caption: Column | str, most: int = 2, least_words: int = 3) -> Column:
    """The first sentences of a caption that have so many words, without openings that say nothing."""
    long = F.filter(sentences(caption), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= least_words)
    return F.slice(F.transform(long, lambda s: F.regexp_replace(s, OPENING, "")), 1, most)


def keyword_text(keywords: Column | str, most: int = 4) -> Column:
    """"a photo of ..." from the first keywords that say something; null without any."""
    told = F.filter(keywords, lambda k: ~F.lower(k).isin(*GENERIC_KEYWORDS) & (F.length(k) > 1))
    return F.when(F.size(told) > 0, F.concat(F.lit("a photo of "), F.array_join(F.slice(told, 1, most), ", ")))


def alike_texts(rows: DataFrame, key: str, text: str, judged: DataFrame, judged_text: str, least: float) -> DataFrame:
    """Keys of rows whose text equals a judged one or has a word-set Jaccard of `least` or more with it.

    Rows and judged texts meet by prefix filtering: with a judged text's words in order of how rare they are among the
    judged texts, a set that is so alike has one of the first n - ceil(least * n) + 1 of them. Rows meet these by words,
    and sizes too far apart don't. Where the judged words are of a checked size they go to all tasks, so rows are read
    where they are and only keys are shuffled. Otherwise words are shuffled with a row's number, not with its text: the
    sets meet the pairs that are left.
    """
    mine = rows.select(F.col(key).alias("key"), F.array_distinct(words(text)).alias("w"))
    theirs = judged.select(F.array_distinct(words(judged_text)).alias("v")).distinct()
    often = theirs.select(F.explode("v").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held = theirs.select("v", F.explode("v").alias("word")).join(often, "word")
    sets = held.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
    kept = F.size("o") - F.ceil(F.size("o") * F.lit(least)) + 1
    prefixes = sets.select("v", F.explode(F.slice(F.col("o"), F.lit(1), kept.cast("int"))["word"]).alias("word"))
    near = (F.size("v") >= F.lit(least) * F.size("w")) & (F.size("w") >= F.lit(least) * F.size("v"))
    alike = F.size(F.array_intersect("w", "v")) >= F.lit(least) * F.size(F.array_union("w", "v"))
    size = prefixes.agg(F.coalesce(F.sum(F.size("v") * 24 + F.octet_length(F.array_join("v", ""))), F.lit(0)).alias("x")).first().x
    if size <= SENT:
        met = mine.select("key", "w", F.explode("w").alias("word")).join(F.broadcast(prefixes), "word").where(near)  # its size was checked
    else:
        mine, theirs = mine.withColumn("row", F.xxhash64("key", "w")), prefixes.withColumn("set", F.xxhash64("v"))
        pairs = mine.select("row", F.explode("w").alias("word")).join(theirs.select("set", "word"), "word").select("row", "set").distinct()
        met = pairs.join(mine, "row").join(theirs.select("set", "v").distinct(), "set").where(near)
    return met.where(alike).select("key").distinct().withColumnRenamed("key", key)


def excluded(photos: DataFrame, judged: DataFrame, groups: DataFrame, minutes: float = 10.0) -> DataFrame:
    """(id, why): judged photos, those that share a group of copies or a burst with one, and those of its scene; each
    photo once, with the first of these reasons."""
    own = judged.select("id").distinct()
    near = group_neighbours(groups.select(F.struct("kind", "group_id").alias("g"), F.col("photo_id").alias("id")), own, "g", "id")
    scene = same_scene(photos, photos.where("taken_at is not null").join(own, "id", "left_semi"), "camera", "taken_at", "id", minutes).select("id")
    why = own.withColumn("n", F.lit(0)).unionByName(near.withColumn("n", F.lit(1))).unionByName(scene.withColumn("n", F.lit(2)))
    return why.groupBy("id").agg(F.min("n").alias("n")).select("id", F.element_at(F.array(F.lit("judged"), F.lit("group"), F.lit("scene")), F.col("n") + 1).alias("why"))


def training_pairs(photos: DataFrame, captions: DataFrame, feedback: DataFrame, groups: DataFrame, judged: DataFrame, judged_queries: DataFrame, val_share: float = 0.05, alike: float = 0.6) -> DataFrame:
    """(id, text, source, split): texts for photos, from captions, keywords and liked results of queries.

    Nothing of `excluded` is used, nor a query that equals a judged one or is much like it. The split is by the day a
    photo was taken (by its id, if that isn't known), so pictures of one day are on one side.
    """
    use = photos.where("media_type = 'image' and thumb_path is not null and error is null")
    use = use.join(excluded(photos, judged, groups).select("id"), "id", "left_anti").select("id", "taken_at", "keywords")
    told = captions.select(F.col("photo_id").alias("id"), F.explode(caption_sentences("caption")).alias("text"), F.lit("caption").alias("source"))
    named = use.select("id", keyword_text("keywords").alias("text"), F.lit("keywords").alias("source")).where("text is not null")
    liked = feedback.where("label = 1").select(F.col("photo_id").alias("id"), F.col("query").alias("text"))
    asked = liked.select("text").distinct()
    seen = asked.withColumn("norm", normal(F.col("text"))).join(judged_queries.select(normal(F.col("query")).alias("norm")).distinct(), "norm", "left_semi").select("text")
    seen = seen.unionByName(alike_texts(asked, "text", "text", judged_queries, "query", alike)).distinct()
    liked = liked.join(seen, "text", "left_anti").select("id", "text", F.lit("feedback").alias("source"))
    pairs = told.unionByName(named).unionByName(liked).join(use.select("id", "taken_at"), "id")
    split = split_by_hash(F.coalesce(F.to_date("taken_at").cast("string"), F.col("id").cast("string")), val_share, ("val", "train"))
    return pairs.select("id", "text", "source", split.alias("split"))
