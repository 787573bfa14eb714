"""Quality classifier with hierarchical empirical Bayes (operator 6). DataFrame functions only.

A document's evidence is a weighted sum of log-likelihood ratios of its binned features, counted over labelled training
rows; the weights are those of a logistic regression on the ratios with both classes of equal weight, as features overlap.
The first feature is lexical: a document's distinct words are hashed to PLACES places, each with the log-ratio of how
many good and bad documents have it, and the mean over the words of what speaks against the document is binned; the words are
learned from one half of the training rows and the bins from the other. The others are shares of upper-case letters, symbols, repeated and distinct
words: none that just follows a text's length. With the labels' prior evidence gives a first probability of quality.
Sums of these over every host, and over every path of a host, are shrunk by empirical Bayes: a host's mean toward the
global mean, a path's mean toward its host's, each as if it had seen `strength` more rows, where the strengths are
fitted to the spread of the means (method of moments). The path's posterior mean, without the document's own share,
then takes the prior's place.

About `max_train` labelled documents, half of each class (those of least hash of their id), teach words and bins. Texts
are then worked through once: evidence is written beside the columns that are carried, and sites are summed from there.

Defined cases: a null text counts as the empty text; a null host or path is one of its own; null labels and labels
without an id teach nothing, of several labels of one id the least counts; without labels of both classes all evidence
is 0 and every document is kept; a site of one document gets its prior; whole texts are read; repeated rows are rows;
an empty table gives an empty result. Columns that are there already keep their names and values; a quality_* column
whose name is taken gets a "_" more.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize, unused

BINS, PLACES, MAX_TRAIN = 24, 1 << 14, 20_000
#: Partitions of the rows that fit the weights.
FIT_PARTS = 8
#: Documents that smooth a word's ratio, the ratio beyond which a word says no more, and words that say nothing added to
#: each text, as a few words are little evidence.
SMOOTH, AGAINST, FEW = 4.0, 4.0, 20
#: Patterns whose matches are counted.
UPPER, SYMBOL, WORD, AGAIN = r"\p{Lu}", r"[|*%#&$!@^~_=<>{}\\]", r"\S+", r"(?<!\S)(\S++)(?=\s\1(?!\S))"
FEATURES = ("words", "upper", "symbol", "again", "distinct")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def word_places(text_col: str) -> Column:
    """The places of a text's distinct words."""
    return F.transform(F.array_distinct(F.split(F.lower(_text(text_col)), " ")), lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int"))


def _numbers(values: list[float], kind: str = "double") -> Column:
    """A bounded list of numbers as one constant array."""
    return F.split(F.lit(",".join(f"{v:.4g}" for v in values)), ",").cast(f"array<{kind}>")


def bins(text_col: str, ratios: list[float]) -> dict[str, Column]:
    """A small whole number for each feature; `ratios` are the log-ratios of the places of words."""
    text = _text(text_col)
    chars, words = F.greatest(F.length(text), F.lit(1)), F.regexp_count(text, F.lit(WORD))
    some = F.greatest(words, F.lit(1))

    def share(x: Column) -> Column:
        """Fine bins for small shares: 0 has its own, then steps on a square-root scale."""
        return F.ceil(F.sqrt(F.least(x, F.lit(1.0))) * (BINS - 1)).cast("int")

    against = F.aggregate(
        word_places(text_col), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, p: F.struct((a["s"] + F.element_at(_numbers([min(max(-r, 0.0), AGAINST) / AGAINST for r in ratios]), p + 1)).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / (a["n"] + FEW),
    )
    return {
        "words": share(against),
        "upper": share(F.regexp_count(text, F.lit(UPPER)) / chars),
        "symbol": share(F.regexp_count(text, F.lit(SYMBOL)) / chars),
        "again": share(F.regexp_count(text, F.lit(AGAIN)) / some),
        "distinct": share(F.size(F.array_distinct(F.split(text, " "))) / some),
    }


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> tuple[float, list[float], dict[str, list[float]], float]:
    """The share of good labels, the log-ratios of the places of words, the weighted ones of each feature's bins, and
    what is added to their sum."""
    ratios, tables = [0.0] * PLACES, {n: [0.0] * (BINS + 1) for n in FEATURES}
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
    marks = materialize(marks, "quality-labels")
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes
    if len(sizes) < 2:
        discard(marks)
        return 0.5, ratios, tables, 0.0
    draw = F.xxhash64("id", F.lit(6))
    chance = F.shiftrightunsigned(draw, 11) / F.lit(float(2**53))
    drawn = marks.where(chance * F.when(F.col("label") == 1, sizes[1]).otherwise(sizes[0]) < max_train / 2).select("id", "label", (draw % 2 == 0).alias("for_words"))
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")  # about max_train rows
    taught = materialize(taught.drop("id"), "quality-train")
    sizes_of = {(r.for_words, r.label): r.n for r in taught.groupBy("for_words", "label").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes_of.get((True, 1), 0), sizes_of.get((True, 0), 0)
    if good and bad:
        held = taught.where("for_words").select("label", F.explode(F.array_distinct(word_places("text"))).alias("place"))
        for r in held.groupBy("place").agg(F.count_if(F.col("label") == 1).alias("g"), F.count_if(F.col("label") == 0).alias("b")).collect():  # PLACES rows
            # SMOOTH more documents with every place, good and bad as all are: a place not met says nothing
            ratios[r.place] = log((r.g + SMOOTH * good / (good + bad)) / good) - log((r.b + SMOOTH * bad / (good + bad)) / bad)
    binned = materialize(taught.select("label", "for_words", *[c.alias(n) for n, c in bins("text", ratios).items()]), "quality-bins")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in FEATURES])).alias("x")
    counted = binned.select("label", "for_words", each).where("x.feature <> 'words' or not for_words").groupBy("x.feature", "x.bin")
    rows = counted.agg(F.count_if(F.col("label") == 1).alias("g"), F.count_if(F.col("label") == 0).alias("b")).collect()  # at most features * bins
    for name in FEATURES:
        own = [r for r in rows if r.feature == name]
        g, b = sum(r.g for r in own), sum(r.b for r in own)
        for r in own if g and b else []:
            tables[name][r.bin] = log((1 + r.g) / (BINS + 1 + g)) - log((1 + r.b) / (BINS + 1 + b))
    weight = F.when(F.col("label") == 1, 1.0 / max(1, sum(n for (_, y), n in sizes_of.items() if y))).otherwise(1.0 / max(1, sum(n for (_, y), n in sizes_of.items() if not y)))
    rows = binned.select(F.col("label").cast("double"), weight.alias("weight"), array_to_vector(F.array(*[F.element_at(_numbers(tables[n]), F.col(n) + 1) for n in FEATURES])).alias("features"))
    offset = 0.0
    if len({y for _, y in sizes_of}) == 2:
        fitted = LogisticRegression(maxIter=50, regParam=1e-4, standardization=False, weightCol="weight").fit(rows.repartition(FIT_PARTS))
        tables = {n: [w * x for x in tables[n]] for n, w in zip(FEATURES, fitted.coefficients.toArray().tolist())}
        offset = float(fitted.intercept)
    discard(marks, taught, binned)
    return sizes[1] / (sizes[0] + sizes[1]), ratios, tables, offset


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: str, n: str, around: str) -> float:
    """The number of rows a prior is worth: the beta-binomial's, by the moments of the sites' means."""
    m = F.col(around)
    row = sites.agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - m, 2)).alias("spread"), F.sum(m * (1 - m)).alias("within"), F.sum(F.col(n) * m * (1 - m)).alias("total"), F.count("*").alias("k")
    ).first()
    if not row.k or row.k < 2 or not row.total:
        return 100.0
    # spread = within + (total - within) * rho  for an intra-site correlation rho; strength = 1 / rho - 1
    rho = (row.spread - row.within) / max(row.total - row.within, 1e-9)
    return float(min(max(1 / max(rho, 1e-6) - 1, 1.0), 1e6))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
    threshold: float = 0.5, max_train: int = MAX_TRAIN, carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns `carry` of `docs` (all, if None) with quality_evidence, quality_prior (its path's posterior mean),
    quality (a probability) and quality_keep.

    `labels` holds the training rows only (id, label 0 or 1).
    """
    carried = docs.columns if carry is None else list(carry)
    prior, ratios, tables, offset = learn(docs, labels, id_col, text_col, label_col, max_train)
    evidence, prior_of, rated, keep, host, path = unused(docs, "quality_evidence", "quality_prior", "quality", "quality_keep", "quality_host", "quality_path")
    found = bins(text_col, ratios)
    terms = [F.element_at(_numbers(tables[n]), found[n] + 1) for n in FEATURES]
    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(a) for c, a in ((host_col, host), (path_col, path))]
    # never null, and known to be: else Spark infers a filter that works it out a second time
    seen = docs.select(*carried, *site, F.coalesce(reduce(lambda a, b: a + b, terms, F.lit(offset)), F.lit(0.0)).alias(evidence))
    seen = materialize(seen, "quality-evidence")

    def first(e: Column) -> Column:
        return 1 / (1 + F.exp(-(e + _logit(F.lit(prior)))))

    soft = seen.select(F.col(host).alias("host"), F.col(path).alias("path"), first(F.col(evidence)).alias("p"))
    paths = materialize(soft.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5))).first()[0]
    hosts = materialize(hosts.withColumn("global", F.lit(total)).withColumn("mean", F.col("host_s") / F.col("host_n")), "quality-hosts")
    strength = _strength(hosts, "mean", "host_n", "global")
    nested = paths.join(hosts.select("host", ((F.col("host_s") + strength * total) / (F.col("host_n") + strength)).alias("host_mean")), "host")
    nested = materialize(nested.withColumn("mean", F.col("s") / F.col("n")), "quality-sites")
    path_strength = _strength(nested, "mean", "n", "host_mean")
    discard(paths, hosts)

    sites = nested.select(F.col("host").alias(host), F.col("path").alias(path), F.struct("n", "s", "host_mean").alias(keep))
    met = seen.join(sites, [host, path], "left")
    # the site's posterior mean as it would be without this document
    own = (F.col(keep)["s"] - first(F.col(evidence)) + path_strength * F.col(keep)["host_mean"]) / (F.col(keep)["n"] - 1 + path_strength)
    met = met.withColumn(prior_of, own).withColumn(rated, 1 / (1 + F.exp(-(F.col(evidence) + _logit(F.col(prior_of))))))
    return met.select(*carried, evidence, prior_of, rated, (F.col(rated) >= threshold).alias(keep))
