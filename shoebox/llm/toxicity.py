"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 3).

Texts are lower-cased (A-Z) and their UTF-8 bytes cut into n-grams of ORDERS, hashed to 2**BITS places; a text's
features are the places present in it. Over all labelled training texts each place's log-count ratio is
log((1 + p) / (2 + P)) - log((1 + q) / (2 + Q)) with p of P toxic and q of Q other texts that have it. The FEATURES
places of largest evidence (the ratio's size times the square root of the texts with the place) have a weight of their
own, with the ratio as the value where present; all other places share one weight, with the mean of their ratios as its
value. In training this mean leaves the text's own counts out, as else rare n-grams would name the text's label. A
logistic regression with an L2 penalty is fitted to these.

Defined cases: a null text counts as the empty text, which has no features and gets the intercept's score; a null
label, or a label without an id or its document, teaches nothing; of several labels of one id the largest counts; with
one class only every score is the share of that class; whole texts are read for training and scoring; repeated rows
score alike; columns other than the text, and in training the id, are not read. About `max_train` texts, half of each
class (those of least hash of their id, weighted to stand for their class), are used to fit the regression; the
log-count ratios come from all labelled training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tables import discard, materialize

ORDERS, BITS, FEATURES, MAX_TRAIN = (4, 5, 6), 20, 4_096, 10_000
#: Partitions of the rows that fit the regression: their gradients go to the driver in each of its steps.
FIT_PARTS = 8
PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def places(text: bytes) -> np.ndarray:
    """The distinct places of a text's n-grams; a text of any length is read in overlapping pieces."""
    found = []
    for at in range(0, max(1, len(text)), PIECE):
        data = _LOWER[np.frombuffer(text[at : at + PIECE + max(ORDERS) - 1], np.uint8)].astype(np.uint32)
        for order in ORDERS:
            if len(data) >= order:
                h = np.full(len(data) - order + 1, 2166136261 + order, np.uint32)
                for i in range(order):
                    h = (h ^ data[i : len(data) - order + 1 + i]) * np.uint32(16777619)
                    h ^= h >> np.uint32(15)
                found.append(h >> np.uint32(32 - BITS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts of each class that have each place."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            counts[label][places((text.as_py() or "").encode())] += 1
    for label in (0, 1):
        at = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), label)), pa.array(counts[label][at])], ["place", "label", "n"])


def log_ratio(p, q, toxic: float, other: float) -> np.ndarray:
    """Of places that p of `toxic` and q of `other` texts have."""
    return np.log((1 + p) / (2 + toxic)) - np.log((1 + q) / (2 + other))


class ToxicityModel:
    """A weight for each place: places of their own add theirs where present, all others the mean of theirs."""

    def __init__(self, own: np.ndarray, rest: np.ndarray, intercept: float):
        self.own, self.rest, self.intercept = own, rest, intercept

    def score(self, docs: DataFrame, text_col: str = "text"):
        """A column: the probability of the toxic class."""
        sent = docs.sparkSession.sparkContext.broadcast((self.own.astype(np.float32), self.rest.astype(np.float32), self.intercept))  # 2 * 4 * 2**BITS bytes

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own, rest, intercept = sent.value
            for batch in batches:
                z = []
                for text in batch:
                    at = places((text.as_py() or "").encode())
                    others = rest[at]
                    z.append(intercept + own[at].sum(dtype=np.float64) + others.sum(dtype=np.float64) / max(1, np.count_nonzero(others)))
                yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

        return F.arrow_udf(score, "double")(F.col(text_col).cast("string"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from the documents that `labels` marks; both are the training rows only."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    taught = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(marks.hint("merge"), "id"), "toxicity-train")
    sizes = {r.label: r.n for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes
    if len(sizes) < 2:
        discard(taught)
        return ToxicityModel(np.zeros(1 << BITS), np.zeros(1 << BITS), 500.0 if sizes.get(1) else -500.0)
    counted = taught.select("text", "label").mapInArrow(_count, "place long, label long, n long").groupBy("place").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q")
    )
    held = counted.select("place", F.col("p").cast("int"), F.col("q").cast("int")).toArrow()  # at most 2**BITS places
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = held.column("place").to_numpy()
    p[at], q[at] = held.column("p").to_numpy(), held.column("q").to_numpy()
    ratios = np.where(p + q > 0, log_ratio(p, q, sizes[1], sizes[0]), 0.0)
    index = np.lexsort((np.arange(len(ratios)), -np.abs(ratios) * np.sqrt(p + q)))[:FEATURES]
    index = index[p[index] + q[index] > 0]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[index] = np.arange(len(index))
    sent = docs.sparkSession.sparkContext.broadcast((slot, ratios[index], p.astype(np.int32), q.astype(np.int32)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, own, p, q = sent.value
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                found = places((text.as_py() or "").encode())
                at = slot[found]
                others = found[at < 0]
                others = others[p[others] + q[others] > 1]  # other texts have it too
                row = np.zeros(len(own) + 1)
                row[at[at >= 0]] = own[at[at >= 0]]
                row[-1] = log_ratio(p[others] - label, q[others] - (1 - label), sizes[1] - label, sizes[0] - (1 - label)).sum() / max(1, len(others))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["label", "values"])

    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) / F.lit(float(2**53))
    size = F.when(F.col("label") == 1, F.lit(sizes[1])).otherwise(F.lit(sizes[0]))
    drawn = taught.where(chance * size < max_train / 2).select("text", "label")
    weight = F.greatest(F.lit(1.0), F.when(F.col("label") == 1, F.lit(sizes[1])).otherwise(F.lit(sizes[0])) / (max_train / 2))
    rows = materialize(drawn.mapInArrow(features, "label double, values array<double>"), "toxicity-features")
    few = rows.repartition(FIT_PARTS).select("label", weight.alias("weight"), array_to_vector("values").alias("features"))
    fitted = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False, weightCol="weight").fit(few)
    discard(taught, rows)
    weights = fitted.coefficients.toArray()
    own = np.zeros(1 << BITS)
    own[index] = weights[:-1] * ratios[index]
    return ToxicityModel(own, np.where(slot < 0, weights[-1] * ratios, 0.0), float(fitted.intercept))
