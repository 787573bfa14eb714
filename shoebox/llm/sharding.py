"""Sharding by sampled splitters (operator 10). DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, place in the table), so equal texts lie side by side. A sample of
these keys, drawn half by size and half by row, gives quantile boundaries of many fine ranges; a text that fills several
ranges is cut between its rows, so no range is overfull, not even where a third of all rows share text and id. Exact byte
sums of the fine ranges place each range on a line of all bytes, a window inside each fine range places each row, and a
shard is a stretch of that line. Ranges only deal out the work: a row's shard follows from the order and the sizes.

Defined cases: a null text counts as the empty text (size 1) and is one group with it; null or repeated ids are
ordinary rows, told apart by their place in the table as it was read; an empty table gives an empty result; columns
other than the id and the text are not read. A group of equal texts stays in one shard unless it holds more than 1/64 of
a shard's bytes, when it may be cut.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize

#: Fine ranges are the square of a number within FANOUT, so that they hold about RANGE_ROWS rows; the sample holds about
#: SAMPLE_PER_RANGE keys for each.
FANOUT, RANGE_ROWS, SAMPLE_PER_RANGE = (32, 128), 20_000, 16


def _longs(values: list[int]) -> Column:
    """A bounded list of numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _splitters(sample: list[tuple[int, int, int, int]], ranges: int) -> list[tuple[int, int, int]]:
    """Quantile boundaries of a sorted sample of keys with their numbers.

    A boundary falls before all rows of its text, so that small groups stay whole, except where one text fills
    several ranges: its second and further boundaries cut between its rows.
    """
    ends = list(accumulate(n for *_, n in sample))
    picked = [sample[bisect_right(ends, ends[-1] * i // ranges)][:3] for i in range(1, ranges)] if sample else []
    out: list[tuple[int, int, int]] = []
    for i, at in enumerate(picked):
        out.append(at if i and picked[i - 1][0] == at[0] else (at[0], -1, -1))
    return sorted(set(out))


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below the row's key, by a search in two steps of about as many comparisons."""
    if not splitters:
        return F.lit(0)
    step = ceil(sqrt(len(splitters)))

    def count(keys: list[Column]) -> Column:
        triples = F.arrays_zip(*[k.alias(n) for k, n in zip(keys, "kts")])
        below = lambda s: (s["k"] < F.col("key")) | ((s["k"] == F.col("key")) & ((s["t"] < F.col("tie")) | ((s["t"] == F.col("tie")) & (s["s"] <= F.col("salt")))))
        return F.size(F.filter(triples, below))

    head = count([_longs([s[i] for s in splitters[::step]]) for i in range(3)])
    start = F.greatest(head - 1, F.lit(0)) * step
    inner = count([F.slice(_longs([s[i] for s in splitters]), start + 1, F.lit(step)) for i in range(3)])
    return F.when(head == 0, F.lit(0)).otherwise(start + inner)


def _digest(c: Column) -> Column:
    """The first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to `n_shards` shards of nearly equal bytes; see the module's docstring.

    Returns id, size (UTF-8 bytes + 1), text_crc32, shard and slot (gapless from 0 inside the shard). A shard's bytes
    differ from the mean by at most its two border rows or groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            _digest(text).alias("key"),
            F.coalesce(_digest(F.col(id_col).cast("string")), F.lit(0)).alias("tie"),
            F.monotonically_increasing_id().alias("salt"),
        ),
        "shard-keys",
    )
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_rows, total = max(n_rows, 1), max(total, 1)
    ranges = min(max(ceil(sqrt(n_rows / RANGE_ROWS)), FANOUT[0]), FANOUT[1]) ** 2
    want = ranges * SAMPLE_PER_RANGE
    # by a hash of its key a row is drawn with a chance that follows its size and its being a row: about `want` at any size
    chance = F.shiftrightunsigned(F.xxhash64("key", "tie", "salt", F.lit(11)), 11) / F.lit(float(2**53))
    drawn = rows.where(chance < (F.col("size") / F.lit(float(total)) + 1.0 / n_rows) * (want / 2)).groupBy("key", "tie", "salt").agg(F.count("*").alias("n"))
    splitters = _splitters(sorted(tuple(r) for r in drawn.toLocalIterator()), ranges)  # about `want` rows

    # a range's head is the text that its splitter falls before or cuts: only it can be in several ranges
    ranged = rows.withColumn("range", _range_of(splitters).cast("int"))
    heads = [-1, *(s[0] for s in splitters)]
    is_head = F.col("key") == F.element_at(_longs(heads), F.col("range") + 1)
    sums = {r.range: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum(F.when(is_head, F.col("size"))).alias("h")).collect()}  # at most `ranges` rows
    bytes_before, rows_before, head_start, head_bytes = [0], [0], [], {}
    for i, key in enumerate(heads):
        own = sums.get(i)
        head_start.append(head_start[-1] if i and heads[i - 1] == key else bytes_before[i])
        head_bytes[key] = head_bytes.get(key, 0) + ((own.h or 0) if own else 0)
        bytes_before.append(bytes_before[i] + (own.b if own else 0))
        rows_before.append(rows_before[i] + (own.n if own else 0))

    def of_range(values: list[int]) -> Column:
        return F.element_at(_longs(values), F.col("range") + 1)

    order = Window.partitionBy("range").orderBy("key", "tie", "salt")
    same = Window.partitionBy("range", "key")
    placed = (
        ranged.withColumn("end", of_range(bytes_before) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", of_range(rows_before) + F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.when(is_head, of_range([head_bytes[k] for k in heads])).otherwise(F.sum("size").over(same)))
        .withColumn("group_start", F.when(is_head, of_range(head_start)).otherwise(F.min(F.col("end") - F.col("size")).over(same)))
    )
    small = F.col("group_bytes") * (n_shards * 64) <= total
    middle = F.when(small, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / total)).cast("int")
    dealt = materialize(placed.select("id", "size", "text_crc32", shard.alias("shard"), "place"), "shard-places")
    discard(rows)
    starts = {r.shard: r.place for r in dealt.groupBy("shard").agg(F.min("place").alias("place")).collect()}  # n_shards rows
    start = F.element_at(_longs([starts.get(i, 0) for i in range(n_shards)]), F.col("shard") + 1)
    return dealt.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))
