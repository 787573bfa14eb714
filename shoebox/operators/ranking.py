"""Ranked signals and how they are fused, pooled, collapsed and scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, id_col: str, order: list[Column], n: int) -> DataFrame:
    """(id, rank) of the first n rows, 1-based. The cut comes first, so that only n rows meet to be numbered."""
    first = rows.orderBy(*order).limit(n)
    return first.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(signals: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (id, rank) signals: (id, score, best).

    A weight of 0 or less drops a signal, a missing one counts as 1. Sums go in the signals' order. Sorted by score,
    best single rank, then the id as text.
    """
    used = {s: df for s, df in signals.items() if weights.get(s, 1.0) > 0}
    if not used:
        any_signal = next(iter(signals.values()))
        return any_signal.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("best")).limit(0)
    renamed = [df.select("id", F.col("rank").alias(f"rank_{s}")) for s, df in used.items()]
    joined = reduce(lambda a, b: a.join(b, "id", "full_outer"), renamed)
    parts = [F.coalesce(F.lit(float(weights.get(s, 1.0))) / (k + F.col(f"rank_{s}")), F.lit(0.0)) for s in used]
    ranks = [F.coalesce(f"rank_{s}", F.lit(2**31 - 1)) for s in used]
    best = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    return joined.select("id", reduce(lambda a, b: a + b, parts).alias("score"), best.alias("best")).orderBy(F.desc("score"), "best", F.col("id").cast("string"))


def pooled(systems: dict[str, DataFrame]) -> DataFrame:
    """Candidates of several rankings: (id, best, found_by), found_by a map from system to rank."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("id", "rank", F.lit(s).alias("system")) for s, df in systems.items()])
    return rows.groupBy("id").agg(F.min("rank").alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", "rank")))).alias("found_by"))


def collapse(rows: DataFrame, parent: Column, order: list[Column]) -> DataFrame:
    """The first row of each parent; a row without a parent stands for itself by its own key in `parent`."""
    w = Window.partitionBy("collapse_parent").orderBy(*order)
    return rows.withColumn("collapse_parent", parent).withColumn("collapse_rank", F.row_number().over(w)).where("collapse_rank = 1").drop("collapse_parent", "collapse_rank")


def keyword_signal(sources: list[tuple[DataFrame, float]], n: int) -> DataFrame:
    """Top n of weighted occurrence counts summed over sources of (id, hits)."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.where("hits > 0").select("id", (F.col("hits") * F.lit(float(w))).alias("score")) for df, w in sources])
    return rows.groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(n)


def recall_precision_mrr_ndcg(ranking: DataFrame, judged: DataFrame, k: int = 10, cutoff: int = 100) -> DataFrame:
    """Metrics of rankings (query, id, rank) under judgements (query, id, grade > 0): one row for each judged query.

    recall is null for a query without relevant ids; precision divides by k even if there are fewer results; a
    relevant id ranked twice counts twice.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = Window.partitionBy("query").orderBy(F.desc("grade"), "id")
    ideal = judged.withColumn("place", F.row_number().over(place)).groupBy("query").agg(
        F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal")
    )
    hits = ranking.join(judged.where("grade > 0"), ["query", "id"]).groupBy("query").agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min(F.when(F.col("rank") <= cutoff, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    got = F.coalesce("hits", F.lit(0))
    return ideal.join(hits, "query", "left").select(
        "query", F.try_divide(got, "relevant").alias("recall"), (got / k).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"),
    )


def mean_by(scores: DataFrame, group: str, metric: str) -> DataFrame:
    """The mean of a metric by group; nulls and NaN are skipped in the mean and counted in n."""
    value = F.when(~F.isnan(metric), F.col(metric))
    return scores.groupBy(group).agg(F.avg(value).alias(f"mean_{metric}"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float], slack: float = 4e-4, small: int = 20_000) -> DataFrame:
    """(group, one column for each name in `wanted`): exact percentiles with linear interpolation; nulls don't count.

    Approximate percentiles a little below and above each wanted one bracket its place; the rows below a bracket are
    counted, and only those inside it, counted by value, are put in order: about 2 * slack of a group's rows. Groups of at
    most `small` rows, where a thousandth says nothing, have all their rows inside.
    """
    known = rows.select(F.col(group).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    near = [F.percentile_approx("v", [max(p - slack, 0.0), min(p + slack, 1.0)], 10_000).alias(f"b{i}") for i, p in enumerate(wanted.values())]
    bounds = known.groupBy(F.col("k").alias("g")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *near)

    def bracket(i: int, p: float) -> Column:
        few, b = F.col("n") <= small, F.col(f"b{i}")
        return F.struct(F.lit(i).alias("i"), F.when(few, F.col("lo")).otherwise(b[0]).alias("lo"), F.when(few, F.col("hi")).otherwise(b[1]).alias("hi"), (F.lit(p) * (F.col("n") - 1)).alias("at"))

    asked = bounds.select("g", F.array(*[bracket(i, p) for i, p in enumerate(wanted.values())]).alias("asked"))
    met = known.join(asked, F.col("k").eqNullSafe(F.col("g"))).select("g", "v", F.explode("asked").alias("a")).where("v <= a.hi")
    # what lies below a bracket is one row of a count, under no value
    inside = met.select("g", "a", F.when(F.col("v") >= F.col("a.lo"), F.col("v")).alias("v")).groupBy("g", "a", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "a").orderBy(F.asc_nulls_first("v"))
    placed = inside.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("v").over(order))
    at, low = F.col("a.at"), F.floor("a.at")
    held = placed.where((F.col("end") > low) & (F.col("end") - F.col("n") <= low))
    # the next place has the same value, or it is the first of the next one
    found = held.withColumn("x", F.col("v") + (at - low) * F.when(F.col("end") > low + 1, F.lit(0.0)).otherwise(F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))))
    return found.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("a.i") == i, F.col("x"))).alias(n) for i, n in enumerate(wanted)])


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 judgements, in one row."""
    row = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb")
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return row.select("n", "agree", F.try_divide(F.col("agree") - chance, 1 - chance).alias("kappa"))


def compare_runs(before: DataFrame, after: DataFrame, metric: str) -> DataFrame:
    """(query, before, after, change) of two runs' per-query scores, the worst change first; a query may be in one only."""
    old, new = (df.select("query", F.col(metric).alias(n)) for df, n in ((before, "before"), (after, "after")))
    return old.join(new, "query", "full_outer").withColumn("change", F.col("after") - F.col("before")).orderBy(F.asc_nulls_last("change"), "query")


def by_system(scores: DataFrame, system: str, category: str, metric: str, categories: list[str]) -> DataFrame:
    """A table of means: a row for each system, a column for each category."""
    return scores.groupBy(system).pivot(category, categories).agg(F.avg(F.when(~F.isnan(metric), F.col(metric))))


def facts(rows: DataFrame, group: Column) -> DataFrame:
    """The most frequent group and its count, if it leads the second: an answer that can be asked for. At most one row."""
    top = rows.groupBy(group.alias("answer")).agg(F.count("*").alias("n")).where("answer is not null").orderBy(F.desc("n"), "answer").limit(2)
    return top.agg(F.max_by("answer", "n").alias("answer"), F.max("n").alias("n"), F.min("n").alias("second"), F.count("*").alias("groups")).where("groups = 1 or n > second").select("answer", "n")
