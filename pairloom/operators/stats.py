"""Thresholds, rates, ROC, intervals and paired tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def p95(c: Column) -> Column:
    """Linear interpolation."""
    return F.percentile(c, F.lit(0.95))


def tau_higher(scores: DataFrame, score: str, fpr: float) -> DataFrame:
    """(tau): the (1 - fpr) quantile, the higher of two neighbours. By rank over counted scores: no list of
    all scores is collected."""
    by = scores.where(F.col(score).isNotNull()).groupBy(score).count()
    upto = F.sum("count").over(Window.orderBy(score))
    n = F.sum("count").over(Window.partitionBy())
    need = F.ceil(F.lit(1 - fpr) * (n - 1)) + 1
    return by.withColumns({"_u": upto, "_need": need}).where("_u >= _need").agg(F.min(score).alias("tau"))


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """by + (n_pos, n_neg, auroc): ties averaged, null with one class only. Ranks run over distinct scores, which are
    pre-aggregated, so the window handles counts."""
    c = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(positive).cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(score)
    below = F.coalesce(F.sum(F.col("_n") - F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = c.withColumn("_w", F.col("_p") * (below + (F.col("_n") - F.col("_p")) / 2))
    out = won.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"), F.sum("_w").alias("_w"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg")))).drop("_w")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0, 0 for n = 0."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda s: F.when(n > 0, (mid + s * half) / (1 + z2 / n)).otherwise(F.lit(0.0))
    return bound(-1), bound(1)


def classification(df: DataFrame, by: list[str], score: str, positive: str, at: float = 0.5) -> DataFrame:
    """by + (tp, fp, fn, tn, precision, recall, f1, fpr), score >= at counts as positive; empty denominators give 0."""
    said, is_ = F.col(score) >= at, F.col(positive) == 1
    out = df.groupBy(*by).agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"), F.count_if(~said & ~is_).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": div(F.col("fp"), F.col("fp") + F.col("tn"))})
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_summary(df: DataFrame, by: list[str], score: str, tau: float) -> DataFrame:
    s = F.col(score)
    q = lambda p: F.percentile(s, F.lit(p))
    return df.where(s.isNotNull()).groupBy(*by).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.max(s).alias("max"), F.count_if(s == 0).alias("zeros"), F.count_if(s >= tau).alias("detected"), (1 - rate(s >= tau)).alias("passed"))


def paired(df: DataFrame, by: list[str], before: str, after: str, tau: float) -> DataFrame:
    """by + paired statistics: deltas, signs and the 2 x 2 of score >= tau."""
    a, b, d = F.col(before), F.col(after), F.col(after) - F.col(before)
    x = df.where(a.isNotNull() & b.isNotNull())
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.percentile(d, F.lit(0.5)).alias("median_delta"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("tied"), F.count_if((a >= tau) & (b >= tau)).alias("both"), F.count_if((a >= tau) & (b < tau)).alias("cleared"), F.count_if((a < tau) & (b >= tau)).alias("raised"), F.count_if((a < tau) & (b < tau)).alias("neither"))


def bootstrap_mean(df: DataFrame, by: str, value: str, seed: int = 42, samples: int = 50_000, chunk: int = 2_000) -> DataFrame:
    """by + (mean, low, high): 95 % interval of the mean over resamples.

    Values are counted first; a resample draws counts of distinct values (multinomial), so a group's size
    doesn't matter, only its number of distinct values, rounded to 1e-6."""
    counted = df.where(F.col(value).isNotNull()).withColumn("_v", F.round(F.col(value), 6)).groupBy(by, "_v").count()
    kind = df.schema[by].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_v")
        v, n = p["_v"].to_numpy(), p["count"].to_numpy()
        total, rng, means = int(n.sum()), np.random.default_rng(seed), []
        for a in range(0, samples, chunk):
            means.append(rng.multinomial(total, n / total, min(chunk, samples - a)) @ v / total)
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame({by: [p[by].iloc[0]], "mean": [float((v * n).sum() / total)], "low": [low], "high": [high]})

    return counted.groupBy(by).applyInPandas(run, f"`{by}` {kind}, mean double, low double, high double")


def quality_gate(df: DataFrame, by: list[str], ratio: Column, bad: Column, cos: Column, acute: Column) -> DataFrame:
    """by + (n, ratio, bad, cos, acute, reasons, passed): median length ratio, contaminated outputs, mean cosine, percent
    of acute collapse, the rules that fail and whether none does. A missing cosine fails nothing."""
    x = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile(ratio, F.lit(0.5)).alias("ratio"), F.count_if(bad).alias("bad"), F.avg(cos).alias("cos"), (100 * rate(acute)).alias("acute"))
    rules = {"length": ~F.col("ratio").between(0.65, 1.35), "contaminated": F.col("bad") > F.greatest(F.lit(1), F.round(0.05 * F.col("n"))), "meaning": F.col("cos") < 0.85, "collapse": F.col("acute") > 5}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return x.withColumn("_r", reasons).withColumns({"reasons": F.array_join("_r", "; "), "passed": F.size("_r") == 0}).drop("_r")


def tau_higher_by(df: DataFrame, by: list[str], score: str, fpr: float) -> DataFrame:
    """by + (tau): tau_higher() for each group, over counted scores."""
    c = df.where(F.col(score).isNotNull()).groupBy(*by, score).count()
    w = Window.partitionBy(*by)
    c = c.withColumns({"_u": F.sum("count").over(w.orderBy(score)), "_n": F.sum("count").over(w)})
    return c.where(F.col("_u") >= F.ceil(F.lit(1 - fpr) * (F.col("_n") - 1)) + 1).groupBy(*by).agg(F.min(score).alias("tau"))


def detector_gate(df: DataFrame, by: list[str], human: str, ai: str, tau: str, fpr_max: float = 0.08, tpr_min: float = 0.80) -> DataFrame:
    """by + (tau, fpr, tpr, collapsed)."""
    out = df.groupBy(*by).agg(F.first(tau).alias("tau"), rate(F.col(human) > F.col(tau)).alias("fpr"), rate(F.col(ai) > F.col(tau)).alias("tpr"))
    return out.withColumn("collapsed", (F.col("fpr") > fpr_max) | (F.col("tpr") < tpr_min))


def mean_abs_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """df + (distance): mean of |value - mean| / (population deviation + 1e-8) over columns."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[(F.stddev_pop(c) + 1e-8).alias(f"_s_{c}") for c in columns])  # one row
    z = [F.abs((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns]
    return df.crossJoin(F.broadcast(s)).withColumn("distance", sum(z[1:], z[0]) / len(columns)).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])
