"""A pluggable embedder as an iterator pandas UDF: the model is loaded once for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[float]]]


def embedder(load: Callable[[], Model], batch: int = 16) -> Callable[[Column], Column]:
    """A function from a text column to an array<double> column. load() gives the model; it is called with at most batch texts, in order, and must give as many vectors."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in texts:
            out: list = []
            values = s.tolist()
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                got = model(part)
                if len(got) != len(part):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(part)} texts")
                out += [None if v is None else np.asarray(v, np.float64) for v in got]
            yield pd.Series(out, index=s.index, dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda c: F.pandas_udf(run, "array<double>")(c)
