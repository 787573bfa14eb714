"""English text for ranking: tokens, stop words, light stemming, OR-matching; all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for a search.
STOP_WORDS = ("a", "about", "after", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "up", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "you", "your")


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def stem(word: Column) -> Column:
    """A light English stem: plural, -ed and -ing endings of words with enough before them."""
    plural = F.when(word.endswith("sses"), word.substr(F.lit(1), F.length(word) - 2)).when(word.rlike(r"..ies$"), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("i"))).when(word.rlike(r"..[^su]s$"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)
    return F.regexp_replace(F.regexp_replace(plural, r"^(.*[aeiouy].*[^aeiouy])(ed|ing)$", "$1"), r"^(..+)y$", "$1i")


def tokens(text: Column | str) -> Column:
    """Stemmed words without stop words; repeats are kept."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS)), stem)


def occurrences(haystack: Column, wanted: list[str]) -> Column:
    """How many tokens are among the wanted ones: the rank of an OR-query."""
    return F.size(F.filter(haystack, lambda t: t.isin(*wanted)))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def hash_bucket(text: Column | str, buckets: int = 1000) -> Column:
    """sha1 as a whole number modulo `buckets`, folded in chunks of eight hexadecimal digits."""
    digest = F.sha1(text)
    out = F.lit(0).cast("bigint")
    for i in range(5):
        out = (out * (2**32 % buckets) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")) % buckets
    return out
