"""Mixing sources to target weights by temperature (operator 2). DataFrame functions only.

Source shares p of all tokens become weights p^t / sum(p^t). The exponent t is bisected until the weights' entropy
meets a target between the natural entropy and that of equal weights, and again until no source repeats more often
than a limit allows; the larger exponent (nearer to the natural shares) holds for both. One aggregate over the sources
looks at GRID exponents of both intervals at once, so each pass halves an interval several times. Each source's token budget is
then realised as permutations of its blocks: whole permutations for whole epochs and the head of one more for the rest.

Defined cases: a token is a run of characters that are not white space; a null text has none. A null source is a
source of its own. A source without tokens has weight 0 and no place in the mix. Rows without tokens go along with
their block. Repeated rows are rows like any other. An empty table gives an empty mix. Columns that are
here already keep their names and values; a mix_* column whose name is taken gets a "_" more. No row is capped or sampled
apart from what the weights ask for.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize, unused

#: Exponents in one pass, and passes: (GRID + 1) ** PASSES parts of the interval.
GRID, PASSES = 63, 7


def token_count(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")).cast("long")


def _digest(*parts) -> Column:
    """The first 60 bits of an MD5 of values as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def _sums(shares: DataFrame, exponents: set[float]) -> dict:
    """For each exponent t the sums over all sources that entropy and repetition follow from, in one small job."""
    at = shares.withColumn("t", F.explode(F.array(*[F.lit(t) for t in sorted(exponents)])))
    power = F.pow("p", F.col("t"))
    rows = at.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("p")).alias("r"))
    return {r.t: r for r in rows.collect()}  # as many rows as exponents


def temperature(shares: DataFrame, entropy_fraction: float | None, max_repeats: float | None, budget_ratio: float) -> float:
    """The least exponent in [0, 1] for the shares (column p) that meets what is asked for; 1.0 without sources."""
    found = _sums(shares, {0.0, 1.0})
    if not found:
        return 1.0

    def entropy(s) -> float:
        return log(s.z) - s.t * s.l / s.z

    meets = []
    if entropy_fraction is not None:
        target = entropy(found[1.0]) + entropy_fraction * (entropy(found[0.0]) - entropy(found[1.0]))
        meets.append(lambda s: entropy(s) <= target + 1e-12)
    if max_repeats is not None:
        # at t = 1 every source repeats budget_ratio times, the least that any exponent can reach for its largest
        limit = max(max_repeats, budget_ratio)
        meets.append(lambda s: s.r / s.z * budget_ratio <= limit * (1 + 1e-12))
    # what 0 doesn't meet is met from some exponent in (low, high] on
    ends = [(0.0, 1.0) for m in meets if not m(found[0.0])]
    meets = [m for m in meets if not m(found[0.0])]
    for _ in range(PASSES if ends else 0):
        grids = [[low + (high - low) * i / (GRID + 1) for i in range(1, GRID + 1)] for low, high in ends]
        found = _sums(shares, set().union(*grids))
        for i, (m, grid) in enumerate(zip(meets, grids)):
            steps = [ends[i][0], *grid, ends[i][1]]
            first = next((j for j, t in enumerate(grid, 1) if m(found[t])), GRID + 1)
            ends[i] = steps[first - 1], steps[first]
    return max([0.0, *(high for _, high in ends)])


def mix(docs: DataFrame, entropy_fraction: float | None = 0.5, max_repeats: float | None = 4.0, budget_ratio: float = 1.0, blocks: int = 256, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document and epoch in the mix: the columns of `docs`, then mix_* columns.

    mix_tokens, mix_weight (the source's weight), mix_repeats (its budget over its tokens), mix_epoch (from 0),
    mix_block, mix_position (in [0, 1): sorted by it, every stretch of the stream has about the target weights).
    The budget is budget_ratio times all tokens; a source's share of it is met within half a block.
    """
    source, block, *names = unused(docs, "mix_source", "mix_block", "mix_tokens", "mix_weight", "mix_repeats", "mix_epoch", "mix_position")
    tokens, weight, repeats, epoch, position = names
    keyed = docs.withColumns(
        {
            source: F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")),
            tokens: token_count(text_col),
            block: F.pmod(_digest(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(str(seed))), F.lit(blocks)).cast("int"),
        }
    )
    # a block is as many of a source's rows as its hash gives: at most sources * blocks rows from here on
    dealt = keyed.select(F.col(source).alias("source"), F.col(block).alias("block"), F.col(tokens).alias("tokens"))
    dealt = materialize(dealt.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = dealt.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).where("source_tokens > 0")
    total = dealt.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = materialize(sources.withColumn("p", F.col("source_tokens") / F.lit(float(max(total, 1)))), "mix-shares")
    t = temperature(shares, entropy_fraction, max_repeats, budget_ratio)
    z = shares.agg(F.coalesce(F.sum(F.pow("p", F.lit(t))), F.lit(1.0))).first()[0]
    weighted = shares.withColumn("weight", F.pow("p", F.lit(t)) / z).withColumn("repeats", F.col("weight") * (total * budget_ratio) / F.col("source_tokens"))
    epochs = weighted.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1)))
    shuffled = Window.partitionBy("source", "epoch").orderBy(_digest("source", F.col("block").cast("string"), F.col("epoch").cast("string"), F.lit(str(seed))), "block")
    plan = (
        dealt.join(epochs, "source")
        .withColumn("before", F.sum("tokens").over(shuffled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .where((F.col("epoch") + (F.col("before") + F.col("tokens") / 2) / F.col("source_tokens")) < F.col("repeats"))
        .select(
            F.col("source").alias(source), F.col("block").alias(block), F.col("epoch").alias(epoch), F.col("weight").alias(weight), F.col("repeats").alias(repeats),
            ((F.col("epoch") + F.col("before") / F.col("source_tokens")) / F.col("repeats")).alias(position),
        )
    )
    plan = materialize(plan, "mix-plan")
    discard(dealt, shares)
    return keyed.join(plan, [source, block]).select(*docs.columns, tokens, weight, repeats, epoch, block, position)
