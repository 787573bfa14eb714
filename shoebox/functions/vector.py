"""Vectors held as arrays: products, ranking against one query vector, feedback, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, summed in order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(rows: DataFrame, vector_col: str, query: Column, k: int, id_col: str) -> DataFrame:
    """The k rows of largest product with the query; Spark keeps k for each task and merges. Ties go to the smaller id."""
    return rows.select(id_col, dot(vector_col, query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def codes(vector: Column | str) -> Column:
    """A vector of components within [-1, 1] as whole numbers of one byte each: a quarter of the bytes to scan."""
    return F.transform(vector, lambda x: F.round(x * 127).cast("tinyint"))


def top_k_by_codes(rows: DataFrame, vector_col: str, codes_col: str, query: list[float], k: int, id_col: str, pool: int = 10) -> DataFrame:
    """The k rows of largest product, from the pool * k rows that are best by their codes: a scan of the codes alone,
    then of the vectors of that pool. Approximate: a row that the rounding puts behind the pool is missed."""
    rough = top_k(rows, codes_col, literal([round(x * 127) for x in query]), pool * k, id_col)
    own = rows.select(id_col, vector_col).join(F.broadcast(rough.select(id_col)), id_col)  # pool * k ids
    return top_k(own, vector_col, literal(query), k, id_col)


def rocchio(query: list[float] | None, positive: list[list[float]], negative: list[list[float]], alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.25) -> list[float]:
    """The query moved towards liked and away from disliked vectors, of length one."""
    import numpy as np

    size = len(query or (positive + negative)[0])
    out = alpha * np.asarray(query if query is not None else np.zeros(size), float)
    for vectors, weight in ((positive, beta), (negative, -gamma)):
        if vectors:
            out = out + weight * np.mean(np.asarray(vectors, float), axis=0)
    length = float(np.linalg.norm(out))
    return (out / length if length else out).tolist()


def centroid(rows: DataFrame, vector_col: str) -> DataFrame:
    """The mean vector of all rows, by position; one row of an array."""
    parts = rows.select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def softmax_share(vector: Column | str, positive: list[Column], negative: list[Column], scale: float = 100.0) -> Column:
    """The share of a softmax over scaled products that falls to the positive prompts."""
    scores = [dot(vector, p) * scale for p in positive + negative]
    most = F.greatest(*scores)
    weights = [F.exp(s - most) for s in scores]

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = out + x
        return out

    return total(weights[: len(positive)]) / total(weights)


def hashed_words(text: Column | str, size: int = 64) -> Column:
    """A deterministic embedding without a model: words counted at places given by their md5 (the whole of it, as a
    number modulo `size`), of length one."""

    def place_of(w: Column) -> Column:
        digest, out = F.md5(w), F.lit(0).cast("bigint")
        for i in range(4):
            out = (out * (2**32 % size) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")) % size
        return out.cast("int")

    place = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), place_of)
    counts = F.aggregate(place, F.array_repeat(F.lit(0.0), size), lambda acc, p: F.transform(acc, lambda x, i: x + (i == p).cast("double")))

    def scaled(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(c, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))

    # bound to a lambda's variable, the counts are worked out once and not for each use
    return F.transform(F.array(counts), scaled)[0]
