"""Where models plug in: encoders of texts or bytes, loaded once for each Python worker, fed by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list], list[list[float]]]


@dataclass(frozen=True)
class Model:
    """What is kept of a model: the name that its vectors are stored under, their length, how it is loaded on a worker,
    and what it wants before a query or a document."""

    name: str
    dim: int
    load: Callable[[], Encoder]
    query_prefix: str = ""
    document_prefix: str = ""


class Registry:
    """Models by name, so that vectors of several can lie in one table and be compared."""

    def __init__(self, *models: Model):
        self.models = {m.name: m for m in models}

    def add(self, model: Model) -> None:
        if model.name in self.models:
            raise ValueError(f"there is a model {model.name} already")
        self.models[model.name] = model

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise KeyError(f"no model {name}; known: {sorted(self.models)}")
        return self.models[name]

    def documents(self, text: Column | str, name: str) -> Column:
        """Vectors of documents; one of another length than the model's is null."""
        return self._of(text, self[name], self[name].document_prefix)

    def queries(self, text: Column | str, name: str) -> Column:
        return self._of(text, self[name], self[name].query_prefix)

    def _of(self, text: Column | str, model: Model, prefix: str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        vector = encode(F.concat(F.lit(prefix), text), model.name, model.load)
        return F.when(F.size(vector) == model.dim, vector)

_loaded: dict[str, Encoder] = {}


def encode(column: Column | str, name: str, load: Callable[[], Encoder]) -> Column:
    """array<float> vectors of a column. `load` makes the encoder on the worker, at its first batch; a null value or
    one that the encoder has no vector for gives null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _loaded:
            _loaded[name] = load()
        for values in batches:
            known = values.notna()
            out = pd.Series([None] * len(values), index=values.index, dtype=object)
            if known.any():
                out[known] = pd.Series(_loaded[name](values[known].tolist()), index=values.index[known])
            yield out

    return run(column)


def fill_pending(rows: DataFrame, key: str, column: str, derived: DataFrame, model: str, load: Callable[[], Encoder]) -> DataFrame:
    """Vectors for the rows that `derived` (photo_id, model, embedding) lacks under this model: only they are encoded."""
    done = derived.where(F.col("model") == model).select(F.col("photo_id").alias(key))
    todo = rows.join(done, key, "left_anti")
    return todo.select(F.col(key).alias("photo_id"), F.lit(model).alias("model"), encode(column, model, load).alias("embedding"))
