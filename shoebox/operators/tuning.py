"""Choosing fusion weights, and statistics of per-query scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.functions.text import hash_bucket


def fuse_grid(signals: dict[str, DataFrame], grid: dict[str, list[float]], k: int = 60) -> DataFrame:
    """(query, setting, id, rank) for every combination of weights; signals are (query, id, rank).

    Rankings are joined once; the settings, a few hundred rows, are then put against each ranked id.
    """
    names = list(signals)
    joined = reduce(lambda a, b: a.join(b, ["query", "id"], "full_outer"), [df.select("query", "id", F.col("rank").alias(f"rank_{s}")) for s, df in signals.items()])
    settings = reduce(lambda a, s: [{**x, s: w} for x in a for w in grid[s]], names, [{}])
    options = F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(float(x[s])).alias(f"w_{s}") for s in names]) for i, x in enumerate(settings)])
    rows = joined.withColumn("o", F.explode(options)).select("query", "id", *[f"rank_{s}" for s in names], "o.*")
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"w_{s}") / (k + F.col(f"rank_{s}")), F.lit(0.0)) for s in names])
    w = Window.partitionBy("query", "setting").orderBy(F.desc(F.round("score", 12)), F.col("id").cast("string"))
    return rows.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).select("query", "setting", *[f"w_{s}" for s in names], "id", "rank")


#: The weights that are tried for each signal but the first, which keeps 1.
GRID = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)


def _mean_by_setting(scores: DataFrame, weights: list[str], metric: str, by: list[str]) -> DataFrame:
    """Means by setting; a query without a metric doesn't count."""
    return scores.groupBy(*by, "setting", *weights).agg(F.avg(metric).alias("mean"))


def best_setting(means: DataFrame, weights: list[str], by: list[str]) -> DataFrame:
    """The setting of the highest mean, to six digits; of equal ones that with the least weights, then the first."""
    total = sum((F.col(w) for w in weights), F.lit(0.0))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("mean", 6)), total, "setting")
    return means.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def tune(signals: dict[str, DataFrame], judged: DataFrame, pinned: str, metric: str = "ndcg", folds: int = 5, k: int = 60, grid: tuple[float, ...] = GRID) -> DataFrame:
    """One row: the weights of the best setting (w_*), its mean over all queries, the cross-validated mean of the way it
    was found, and the means of equal weights and of the pinned signal alone.

    `judged` is (query, id, grade). A query's fold is its hash's. For each fold the best setting of the other queries is
    taken, and its scores on the fold's own queries make up the cross-validated mean.
    """
    from shoebox.operators.ranking import recall_precision_mrr_ndcg

    names = [f"w_{s}" for s in signals]
    fused = fuse_grid(signals, {s: [1.0] if s == pinned else list(grid) for s in signals}, k).where("rank <= 100")
    settings = fused.select("setting", *names).distinct()
    # a query with a setting is a query to the metrics
    asked = judged.select("query").distinct().crossJoin(F.broadcast(settings))  # a few hundred settings
    both = lambda df: df.withColumn("query", F.struct("query", "setting"))
    scores = recall_precision_mrr_ndcg(both(fused), both(judged.join(asked, "query")))
    scores = scores.select("query.query", "query.setting", F.when(~F.isnan(metric), F.col(metric)).alias(metric)).join(F.broadcast(settings), "setting")
    scores = scores.withColumn("fold", hash_bucket(F.col("query").cast("string"), folds))
    # means without a fold, from sums with all and of the fold
    part = scores.groupBy("fold", "setting", *names).agg(F.sum(metric).alias("s"), F.count(metric).alias("n"))
    whole = part.groupBy("setting").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    without = part.join(whole, "setting").withColumn("mean", F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))
    chosen = best_setting(without, names, ["fold"])
    cross = chosen.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("cross_validated"))
    means = _mean_by_setting(scores, names, metric, [])
    best = best_setting(means, names, []).select(*names, F.col("mean").alias("in_sample"))
    equal = means.where(F.array(*names) == F.array(*[F.lit(1.0) for _ in names])).agg(F.max("mean").alias("equal_weights"))
    alone = means.where(F.array(*names) == F.array(*[F.lit(float(s == pinned)) for s in signals])).agg(F.max("mean").alias("pinned_alone"))
    return best.crossJoin(cross).crossJoin(equal).crossJoin(alone)  # one row each


#: Upper bounds of a thousandth of how often a Poisson number of mean 1 is at most 0, 1, 2 ...
POISSON = (368, 736, 920, 981, 996, 999)


def resampled(scores: DataFrame, key: str, metrics: list[str], rounds: int) -> DataFrame:
    """(round, mean of each metric) over bootstrap rounds: in each a row counts as often as a Poisson number of mean 1
    says, which its key and the round give by a hash. Rows stay spread; a round is a sum."""
    each = scores.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = hash_bucket(F.concat(F.col(key).cast("string"), F.lit("|"), F.col("round").cast("string")))
    count = F.size(F.filter(F.array(*[F.lit(x) for x in POISSON]), lambda x: x <= drawn))
    each = each.withColumn("times", count)
    return each.groupBy("round").agg(*[F.try_divide(F.sum(F.col(m) * F.col("times")), F.sum(F.when(F.col(m).isNotNull(), F.col("times")))).alias(m) for m in metrics])


def _known(scores: DataFrame, metrics: list[str]) -> DataFrame:
    return scores.select(*[c for c in scores.columns if c not in metrics], *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics])


def bootstrap_mean(scores: DataFrame, key: str, metric: str, rounds: int = 2000) -> DataFrame:
    """(low, high): a 95 % interval of the mean of per-query scores; nulls and NaN don't count."""
    rows = resampled(_known(scores, [metric]), key, [metric], rounds)  # `rounds` rows
    return rows.agg(*[F.percentile(metric, p).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))])


def paired_p(scores: DataFrame, key: str, a: str, b: str, rounds: int = 5000) -> DataFrame:
    """(p): how often a bootstrap of the differences b - a has a mean of 0 or less: b is not better than a on the same
    queries. Null for fewer than two queries that have both."""
    known = _known(scores, [a, b]).select(key, (F.col(b) - F.col(a)).alias("d")).where("d is not null")
    rows = resampled(known, key, ["d"], rounds)
    n = known.agg(F.count("*").alias("n"))
    return rows.agg(F.avg((F.col("d") <= 0).cast("double")).alias("p")).crossJoin(n).select(F.when(F.col("n") >= 2, F.col("p")).alias("p"))  # one row each
