"""Nearest spelling in a vocabulary, as a join: shared q-grams name candidates, matching blocks decide."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def block_ratio(option: pd.Series, word: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks by the letters of both."""
    return pd.Series([SequenceMatcher(None, o, w).ratio() for o, w in zip(option, word)], dtype="float64")


def _grams(word: Column, q: int) -> Column:
    """The q-grams of a word; one that repeats is told apart by its turn."""
    length = F.greatest(F.length(word) - (q - 1), F.lit(0))
    each = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.substring(word, i, F.lit(q)))
    each = F.slice(each, F.lit(1), length)
    numbered = F.transform(each, lambda g, i: F.concat(g, F.size(F.filter(F.slice(each, F.lit(1), i), lambda h: h == g)).cast("string")))
    return numbered


def candidates(words: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """(word, option) of all pairs that can reach a ratio of `cutoff`, from tables of distinct (word) and (option).

    Blocks of m letters in words of t letters together hold at least m - (t - 2m) - 1 pairs of letters that stand side by
    side in both. A ratio of c makes that (1.5c - 1)t - 1, and t is at least 2 / (2 - c) of either length; so two words
    share one of their rarest pairs of letters, as many as each can lack of those and one more. Words too short for that
    meet by single letters. Rarity is counted over the vocabulary.
    """
    rate = max(0.0, 1.5 * cutoff - 1) * 2 / (2 - cutoff)
    short = math.floor(1 / rate) if rate > 0 else 2**31 - 1  # words of up to so many letters may share no pair of letters
    meets_short = min(2**31 - 1, math.floor(short * (2 - cutoff) / cutoff + 1e-9))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        text, n = F.col(name), F.length(name)
        pairs = F.when(n > short, F.transform(_grams(text, 2), lambda g: F.concat(F.lit("2"), g))).otherwise(F.array().cast("array<string>"))
        letters = F.when(n <= meets_short, F.transform(_grams(text, 1), lambda g: F.concat(F.lit("1"), g))).otherwise(F.array().cast("array<string>"))
        return df.select(name, F.explode(F.concat(pairs, letters)).alias("gram"))

    left, right = keyed(words, "word"), keyed(vocabulary, "option")
    often = right.groupBy("gram").agg(F.count("*").alias("often"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(name, F.col("gram").startswith("2")).orderBy("often", "gram")
        shared = F.greatest(F.ceil(F.length(name) * F.lit(rate) - 1 - 1e-9), F.lit(1))
        turn = df.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("turn", F.row_number().over(w))
        return turn.where(F.col("gram").startswith("1") | (F.col("turn") <= F.length(name) - shared)).select(name, "gram")

    met = rarest(left, "word").join(rarest(right, "option"), "gram").select("word", "option").distinct()
    most = 2 * F.least(F.length("word"), F.length("option")) / (F.length("word") + F.length("option"))
    common = F.size(F.array_intersect(_grams(F.col("word"), 1), _grams(F.col("option"), 1)))
    return met.where((most >= cutoff) & (2 * common / (F.length("word") + F.length("option")) >= cutoff))


def closest(rows: DataFrame, word_col: str, vocabulary: DataFrame, option_col: str, cutoff: float = 0.85) -> DataFrame:
    """(word, match, score) of each distinct word: the option of highest ratio from `cutoff` on, compared in lower case,
    ties to the greater; an option that is the word itself has 1. Without one both are null. Of options that differ in
    case only the greatest stands. Null and empty words and options take no part.
    """
    words = rows.select(F.col(word_col).alias("word")).where("word <> ''").distinct().withColumn("low", F.lower("word"))
    options = vocabulary.where(F.col(option_col) != "").groupBy(F.lower(option_col).alias("option")).agg(F.max(option_col).alias("match"))
    pairs = candidates(words.select(F.col("low").alias("word")).distinct(), options.select("option"), cutoff)
    scored = pairs.withColumn("score", block_ratio("option", "word")).where(F.col("score") >= cutoff)
    best = scored.groupBy(F.col("word").alias("low")).agg(F.max(F.struct("score", "option")).alias("best")).select("low", "best.score", "best.option")
    return words.join(best, "low", "left").join(options, "option", "left").select("word", "match", "score")
