"""Scorers of pairs: heuristic, plugged-in pair scorers, and blends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PairScorer = Callable[[list[tuple[str, str]]], np.ndarray]

HEURISTIC = 0.85


def heuristic_match(features: DataFrame, threshold: float = HEURISTIC) -> DataFrame:
    """(s1_id, target_id, composite_score) of pairs whose composite score is at least the threshold; targets can be used more than once."""
    return features.where(F.col("composite_score") >= threshold).select("s1_id", "target_id", "composite_score")


def to_probability(scores: np.ndarray, output: str) -> np.ndarray:
    """From a scorer's output: "prob" as it is; "logit" by the sigmoid, of two columns by softmax, of more by the first's sigmoid."""
    if output == "prob":
        return scores.reshape(len(scores))
    if output != "logit":
        raise ValueError(f"output must be prob or logit, not {output!r}")
    scores = scores.reshape(len(scores), -1)
    logit = scores[:, 1] - scores[:, 0] if scores.shape[1] == 2 else scores[:, 0]
    return 1 / (1 + np.exp(-logit))


def rerank(pairs: DataFrame, load: Callable[[], PairScorer | None], output: str = "logit", batch: int = 64) -> DataFrame:
    """(s1_id, target_id, p) of pairs with text1 and text2 by any scorer of lists of text pairs.

    load runs once in each task; if it returns None every pair has 0.5. What the
    scorer's numbers are is said by output, never guessed from a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            texts = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            p = [np.zeros(0)]
            for a in range(0, len(texts), batch):
                some = texts[a : a + batch]
                p.append(np.full(len(some), 0.5) if model is None else to_probability(np.asarray(model(some), np.float64), output))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(np.concatenate(p))], ["s1_id", "target_id", "p"])

    return pairs.select("s1_id", "target_id", "text1", "text2").mapInArrow(run, "s1_id string, target_id string, p double")


def warm_up(load: Callable[[], PairScorer | None], output: str = "logit") -> np.ndarray:
    """Probabilities of two made-up pairs, to see that a scorer works before a job starts."""
    model = load()
    pairs = [("Business: a | Address: b", "Business: a | Address: b"), ("Business: a | Address: b", "Business: c | Address: d")]
    return np.full(2, 0.5) if model is None else to_probability(np.asarray(model(pairs), np.float64), output)


def blend(weights: dict[str, float]) -> Column:
    """The mean of columns by weights that are scaled to 1 over those given."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w / total) * F.col(name)
    return out
