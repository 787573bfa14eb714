"""Line de-duplication by a log-template tree (operator 7). DataFrame functions only.

Every line is parsed to a fixed depth: its token count, its first DEPTH tokens, and below that leaf the template its
remaining tokens give once variable fields are generalised. Runs of digits are always a variable field. In lines of at
least CLASSES * 3 tokens any other field may vary too: the positions are dealt to CLASSES classes, and for each class
there is a template that keeps the tokens of that class and lets all others vary, so lines that differ in fewer
classes than there are still meet in one. A template is recurring if lines of `min_texts` or more different texts have
it. A line with a recurring template is dropped from every document but the first (smallest id) that holds the template.

Defined cases: lines end at "\\n" alone; a line without tokens is never dropped; exact copies of a text count as one
text, so they alone make no template recur; rows with equal id and text share their fate; a null id comes after all
others; a null text stays null and an empty one empty; a text whose lines all go becomes empty. An empty table gives
an empty result. Other columns are carried through untouched; lines_n or lines_dropped, if taken, get a "_" more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize, unused

DEPTH, CLASSES, MIN_TEXTS = 3, 3, 2


def _templates(depth: int, classes: int) -> Column:
    """Keys of the templates of a line, from its tokens (column `tokens`, digits generalised)."""
    count = F.size("tokens")
    leaf = [count, F.slice("tokens", 1, depth)]
    whole = F.xxhash64(F.lit(-1), count, F.col("tokens"))

    def part(c: int) -> Column:
        return F.xxhash64(F.lit(c), *leaf, F.filter("tokens", lambda _, i: i % classes == c))

    parts = [part(c) for c in range(classes)]
    return F.when(count >= classes * 3, F.array(whole, *parts)).otherwise(F.array(whole))


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, depth: int = DEPTH, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with recurring lines taken out of the text, and the counts lines_n and lines_dropped."""
    key_text, key_id, gone_at, n, dropped = unused(docs, "lines_text", "lines_id", "lines_gone", "lines_n", "lines_dropped")
    keyed = docs.withColumns({key_text: F.xxhash64(text_col, F.length(text_col)), key_id: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))})
    line = keyed.select(F.col(key_id).alias("id"), F.col(key_text).alias("text"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace("line", r"[\s\x0B]+", " "), r"[0-9]+", "0")), " ")
    lines = materialize(
        line.where(F.col("line").rlike(r"\S")).select("id", "text", "at", tokens.alias("tokens")).select("id", "text", "at", _templates(depth, classes).alias("templates")),
        "line-templates",
    )
    held = lines.select("id", "text", "at", F.explode("templates").alias("template"))
    # one row for each template and text before texts are counted: a template in a third of all texts stays spread out
    pairs = held.groupBy("template", "text").agg(F.min("id").alias("first"))
    recurring = materialize(
        pairs.groupBy("template").agg(F.count("*").alias("texts"), F.min("first").alias("first")).where(F.col("texts") >= min_texts).select("template", "first"),
        "line-recurring",
    )
    gone = held.join(recurring, "template").where(F.col("id") != F.col("first")).groupBy(F.col("id").alias(key_id), F.col("text").alias(key_text)).agg(F.collect_set("at").alias(gone_at))
    gone = materialize(gone, "line-drops")
    discard(lines, recurring)
    split = F.split(text_col, "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(gone_at, i)), "\n")
    return keyed.join(gone, [key_id, key_text], "left").select(
        *[F.when(F.col(gone_at).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).alias(n),
        F.coalesce(F.size(gone_at), F.lit(0)).alias(dropped),
    )
