"""The boundary to models that run outside the engine: texts in, a table of scores or texts out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list[str]], list[float]]


def stand_in(kind: str) -> Scorer:
    """A deterministic score from the text's md5, for tests."""
    return lambda texts: [int(hashlib.md5(f"{kind}:{t}".encode()).hexdigest()[:8], 16) % 10_000 / 10_000 for t in texts]


def scored(df: DataFrame, id_col: str, text_col: str, kind: str, factory: Callable[[], Scorer]) -> DataFrame:
    """(kind, id, score): each partition makes one scorer and feeds it batch by batch. Null texts have null scores."""
    rows = df.selectExpr(f"cast(`{id_col}` as string) as id", f"`{text_col}` as text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for b in batches:
            has = b["text"].notna()
            out = pd.Series([None] * len(b), index=b.index, dtype="float64")
            out[has] = score(b["text"][has].tolist())
            yield pd.DataFrame({"kind": kind, "id": b["id"], "score": out})

    return rows.mapInPandas(run, "kind string, id string, score double")
