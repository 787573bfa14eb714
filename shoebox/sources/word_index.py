"""A stored inverted index of words: Parquet in buckets by word, so that a query reads its own words' buckets alone.

A posting is (bucket, word, field, id, n): `n` times a word stands in a row's field. A dictionary, in buckets by stem, says
which words a stem has: stems are made once for each distinct word, and postings, which are many more, meet no other table
when they are written. Inside of a bucket files are sorted by word, and the scan gets the words as a pushed filter, so
that most row groups of a bucket are skipped too. A query is an OR of its words' stems, stop words left out: every
occurrence of any of them satisfies it alone, so that the cover density of a row is proportional to its number of
occurrences, weighted by field.

Defined cases: null and empty texts have no postings; a query of stop words only finds nothing; rows that repeat an id
are one row with all their words; a new version of an index is written beside the old one before a pointer file moves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoebox.functions.english import english_stem, let
from shoebox.functions.text import STOP_WORDS, words


#: Words of a query's stems that a scan gets as a filter.
FORMS = 1_000


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def counted(said: Column) -> Column:
    """(word, n) of each distinct word of an array, in its order; one sort, so that long texts take no square of time."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, turn: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, turn + 1), F.size(s)) - i).cast("bigint").alias("n"))))

    return F.when(F.size(said) > 0, let(F.array_sort(said), runs))


def postings(rows: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(word, field, id, n) of the columns named in `fields` (field: text column), over whole texts and without a shuffle;
    rows that repeat an id have postings of their own."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("text")) for f, c in fields.items()]))
    said = rows.select(F.col(id_col).alias("id"), each.alias("x")).where("id is not null").select("id", "x.field", F.explode(counted(words("x.text"))).alias("p"))
    return said.select("p.word", "field", "id", "p.n").where(~F.col("word").isin(*STOP_WORDS))


class WordIndex:
    """An index in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = spark.read.schema("version string, buckets int, id_type string").json(f"{self.path}/current").first()
        self.buckets, self.at = facts.buckets, f"{self.path}/{facts.version}"
        self.schema = f"word string, field string, id {facts.id_type}, n bigint, bucket int"

    @staticmethod
    def build(rows: DataFrame, path: str, id_col: str, fields: dict[str, str], buckets: int = 64, parts: int = 8) -> WordIndex:
        """Write an index of `rows` below `path` and point to it; searches that are under way keep the one they read.

        Each bucket's rows are dealt to `parts` by id, so that a frequent word is no one task's: more parts for more rows.
        """
        spark, version = rows.sparkSession, uuid.uuid4().hex
        at = f"{path.rstrip('/')}/{version}"
        found = postings(rows, id_col, fields).withColumn("bucket", bucket_of(F.col("word"), buckets))
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "word", "field", "id").write.partitionBy("bucket").parquet(f"{at}/postings")
        known = spark.read.schema(found.schema).parquet(f"{at}/postings").select("word").distinct()
        stems = known.select("word", english_stem(F.col("word")).alias("token")).withColumn("bucket", bucket_of(F.col("token"), buckets))
        stems.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{at}/words")
        facts = [(version, buckets, rows.schema[id_col].dataType.simpleString())]
        spark.createDataFrame(facts, "version string, buckets int, id_type string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")
        return WordIndex(spark, path)

    def tokens(self, text: str) -> list[str]:
        """The distinct stems of a query."""
        said = F.filter(words(F.lit(text)), lambda w: ~w.isin(*STOP_WORDS))
        return sorted(self.spark.range(1).select(F.array_distinct(F.transform(said, english_stem)).alias("t")).first().t)

    def _read(self, part: str, schema: str, wanted: DataFrame) -> DataFrame:
        """A stored table's buckets that `wanted`, a frame with buckets, names; their numbers are at most `buckets`."""
        named = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        return self.spark.read.schema(schema).parquet(f"{self.at}/{part}").where(F.col("bucket").isin(*named))

    def forms(self, tokens: list[str]) -> DataFrame:
        """(word, token, bucket) of the words that have one of these stems; `bucket` is that of the word's postings."""
        asked = self.spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("bucket", bucket_of(F.col("token"), self.buckets))
        found = self._read("words", "word string, token string, bucket int", asked).where(F.col("token").isin(*tokens))
        return found.select("word", "token", bucket_of(F.col("word"), self.buckets).alias("bucket"))

    def table(self, tokens: list[str]) -> DataFrame:
        """The postings of these stems: a scan of their words' buckets alone. Up to FORMS words are a filter of the scan."""
        forms = self.forms(tokens)
        some = [r.word for r in forms.select("word").limit(FORMS + 1).collect()]
        rows = self._read("postings", self.schema, forms)
        return rows.where(F.col("word").isin(*some)) if len(some) <= FORMS else rows.join(forms.select("bucket", "word"), ["bucket", "word"], "left_semi")

    def hits(self, text: str) -> DataFrame:
        """(id, field, hits) of all rows that hold a word of the query."""
        return self.table(self.tokens(text)).groupBy("id", "field").agg(F.sum("n").alias("hits"))

    def search(self, text: str, k: int, weights: dict[str, float] | None = None, within: DataFrame | None = None) -> DataFrame:
        """(id, score): the k rows of most occurrences, weighted by field (1 where none is given), ties to the smaller id.
        `within`, a frame with a column id, says which rows take part."""
        hits = self.hits(text)
        hits = hits.join(within.select("id"), "id", "left_semi") if within is not None else hits
        return hits.groupBy("id").agg(F.sum(F.col("hits") * self._weight(weights)).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def search_many(self, queries: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
        """(query, rank, id, score) of every row (query, words), in one plan: stems meet words, and words postings, by
        equi-joins, and each task passes on a query's k best only. Of the index no bucket is read that no query
        has a word of."""
        said = queries.select("query", F.explode(words("words")).alias("asked")).where(~F.col("asked").isin(*STOP_WORDS)).distinct()
        asked = said.select("query", english_stem(F.col("asked")).alias("token")).distinct().withColumn("bucket", bucket_of(F.col("token"), self.buckets))
        known = self._read("words", "word string, token string, bucket int", asked)
        forms = known.join(asked, ["bucket", "token"]).select("query", "word", bucket_of(F.col("word"), self.buckets).alias("bucket"))
        found = self._read("postings", self.schema, forms).join(forms, ["bucket", "word"])
        found = found.groupBy("query", "id").agg(F.sum(F.col("n") * self._weight(weights)).alias("score")).where("score > 0")
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    @staticmethod
    def _weight(weights: dict[str, float] | None) -> Column:
        if not weights:
            return F.lit(1.0)
        table = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
        return F.coalesce(F.try_element_at(table, F.col("field")), F.lit(1.0))
