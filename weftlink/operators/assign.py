"""From scored pairs to matches: each target to one entity, one to one, and thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink import schema
from weftlink.sources import tables

THRESHOLD = 0.70
#: 0.40, 0.42, ... 0.90.
GRID = tuple(round(0.40 + 0.02 * i, 2) for i in range(26))


def target_winners(scored: DataFrame) -> DataFrame:
    """(s1_id, target_id, p): of each target its best entity, ties to the smaller id. The same for every threshold."""
    order = Window.partitionBy("target_id").orderBy(F.desc("p"), "s1_id")
    return scored.select("s1_id", "target_id", "p").withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def injective(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(s1_id, target_id, p): pairs of at least the threshold with each target used once; an entity can have several.

    Giving targets away in falling order of score is the same as each target
    choosing its best entity, since only targets are used up. Pairs below the
    threshold are dropped before the shuffle.
    """
    return target_winners(scored.where(F.col("p") >= threshold))


def threshold_sweep(scored: DataFrame, truth: DataFrame, spine: DataFrame, grid: tuple[float, ...] = GRID, beta: float = schema.BETA) -> DataFrame:
    """Macro scores of the injective matching at each threshold of the grid, from one pass over the pairs.

    Winners don't depend on the threshold, so each pair is counted in the
    thresholds up to its score; only entities times the grid are ever rows.
    """
    from weftlink.operators import metrics

    hits = target_winners(scored).join(truth.select("s1_id", "target_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "target_id"], "left")
    steps = F.array(*[F.lit(float(t)) for t in grid])
    counted = hits.withColumn("threshold", F.explode(F.filter(steps, lambda t: t <= F.col("p")))).groupBy("s1_id", "threshold").agg(F.count("*").alias("np"), F.count("hit").alias("tp"))
    true = truth.distinct().groupBy("s1_id").agg(F.count("*").alias("nt"))
    per = spine.select("s1_id").distinct().join(true, "s1_id", "left").select("s1_id", F.coalesce("nt", F.lit(0)).alias("nt"), F.explode(steps).alias("threshold"))
    per = per.join(counted, ["s1_id", "threshold"], "left").na.fill(0, ["np", "tp"])
    return metrics.macro(metrics.with_scores(per, beta), ["threshold"])


def best_threshold(sweep: DataFrame) -> float:
    """The lowest threshold with the highest macro F; the default if there is none above 0."""
    top = sweep.where(F.col("macro_f") > 0).orderBy(F.desc("macro_f"), "threshold").select("threshold").first()
    return float(top[0]) if top else THRESHOLD


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of a matrix with no more rows than columns, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], at, least, way, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = of[at]
            now = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = now < least[1:]
            least[1:][better], way[1:][better] = now[better], at
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
            if of[at] == 0:
                break
        while at:
            of[at], at = of[way[at]], way[at]
    return [(int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j]]


def _solve(frames: Iterator[pd.DataFrame] | pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = frames.groupby(["s1_id", "target_id"], as_index=False)["p"].max()
    rows, cols = sorted(pdf.s1_id.unique()), sorted(pdf.target_id.unique())
    gain = np.zeros((len(rows), len(cols)))
    p = pdf.p.clip(1e-6, 1 - 1e-6).to_numpy()
    i, j = np.searchsorted(rows, pdf.s1_id), np.searchsorted(cols, pdf.target_id)
    gain[i, j] = np.maximum(np.log(p / (1 - p)) - np.log(threshold / (1 - threshold)), 0)
    exact = np.zeros_like(gain)
    exact[i, j] = pdf.p
    found = hungarian(-gain) if len(rows) <= len(cols) else [(a, b) for b, a in hungarian(-gain.T)]
    kept = [(rows[a], cols[b], exact[a, b]) for a, b in found if gain[a, b] > 0]
    return pd.DataFrame(kept, columns=["s1_id", "target_id", "p"])


def one_to_one(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(s1_id, target_id, p): the one-to-one matching with the largest sum of log odds above the threshold.

    Entities and targets fall into connected components of pairs above the
    threshold; each is solved by itself. A component is a matrix in one task:
    raise the threshold, or cap candidates, if components grow large.
    """
    kept = scored.where(F.col("p") > threshold).select("s1_id", "target_id", "p")
    label = components(kept.select(F.col("s1_id").alias("a"), F.col("target_id").alias("b")))
    grouped = kept.join(label.withColumnRenamed("id", "s1_id"), "s1_id")
    return grouped.groupBy("component").applyInPandas(lambda pdf: _solve(pdf, threshold), "s1_id string, target_id string, p double")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id that it is connected with, by rounds of the least label of
    neighbours and of that label's own label."""
    links = edges.union(edges.select("b", "a")).distinct()
    tables.use_checkpoints(edges.sparkSession)
    links = links.checkpoint()
    label = links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    for _ in range(rounds):
        near = links.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.alias("x").join(step.select(F.col("id").alias("via"), F.col("component").alias("far")), F.col("x.component") == F.col("via"), "left")
        moved = jump.select("x.id", "old", F.coalesce(F.least("x.component", "far"), "x.component").alias("component"))
        moved = moved.checkpoint()
        label = moved.select("id", "component")
        if not moved.where("old != component").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
