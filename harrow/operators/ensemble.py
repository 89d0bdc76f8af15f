"""Selection rules, ensembles and benchmark scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators import inference, metrics
from harrow.operators.staging import staged
from harrow.operators.windows import zscore


def seed_average(pred: DataFrame, keys: list[str], score: str) -> DataFrame:
    """K4: mean prediction over seeds."""
    return pred.groupBy(*keys).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("n_seeds"))


def stack_sums(pred: DataFrame, group: str, entity: str, value: str, scores: list[str]) -> DataFrame:
    """K1: averages over groups of the within-group correlations c (score, value) and S (score, score): a few numbers."""
    d = pred.withColumns({f"__{s}": zscore(s, group, sample=False) for s in [*scores, value]})
    per = d.groupBy(group).agg(
        *(F.avg(F.col(f"__{s}") * F.col(f"__{value}")).alias(f"c_{s}") for s in scores),
        *(F.avg(F.col(f"__{a}") * F.col(f"__{b}")).alias(f"s_{a}_{b}") for i, a in enumerate(scores) for b in scores[i:]))
    return per.agg(*(F.avg(c).alias(c) for c in per.columns if c != group))


def stack_weights(sums: dict[str, float], scores: list[str], ridge: float = 0.05) -> dict[str, float]:
    """K1: non-negative weights from the averaged sums (k x k, on the driver); equal weights if none is positive."""
    k = len(scores)
    s = np.array([[sums.get(f"s_{a}_{b}", sums.get(f"s_{b}_{a}")) for b in scores] for a in scores], float) + ridge * np.eye(k)
    c = np.array([sums[f"c_{a}"] for a in scores], float)
    w = np.zeros(k)
    for _ in range(2000):  # coordinate descent; S is positive definite
        before = w.copy()
        for i in range(k):
            w[i] = max(0.0, (c[i] - s[i] @ w + s[i, i] * w[i]) / s[i, i])
        if np.abs(w - before).max() < 1e-12:
            break
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    return dict(zip(scores, w.tolist()))


def apply_rules(pred: DataFrame, group: str, keys: list[str], weights: DataFrame) -> DataFrame:
    """K2: each rule's score: weighted sum of standardised method scores. ``pred``: keys, method, score; ``weights``: rule, method, weight."""
    z = pred.withColumn("__z", F.coalesce(zscore("score", group, "method", sample=False), F.lit(0.0)))
    return z.join(F.broadcast(weights), "method").groupBy("rule", *keys).agg(F.sum(F.col("__z") * F.col("weight")).alias("score"))


def library_members(pred: DataFrame, members: DataFrame) -> DataFrame:
    """K3: predictions of the methods in each library."""
    return pred.join(F.broadcast(members), "method")


def similarity_average(groups: DataFrame, values: DataFrame, group: str, station: str, state: str, entity: str, score: str, base: float = 0.1) -> DataFrame:
    """K5: for each group, entity scores of the other groups averaged with weights base + 2 for the same station + 2 for the same state."""
    a = groups.select(F.col(group).alias("to_group"), F.col(station).alias("__s"), F.col(state).alias("__t"))
    b = values.join(groups.select(group, station, state), group)
    j = b.join(F.broadcast(a), F.col(group) != F.col("to_group"))  # groups to predict: a short list
    w = F.lit(base) + 2 * (F.col(station) == F.col("__s")).cast("double") + 2 * (F.col(state) == F.col("__t")).cast("double")
    return j.groupBy("to_group", entity).agg((F.sum(w * F.col(score)) / F.sum(w)).alias("score"))


def choose_setting(curve: DataFrame, audit: DataFrame, unit: str, setting: str, value: str) -> DataFrame:
    """K6: for each unit the setting that is best on its own curve, its value on the audit curve, and whether it lies at the grid's edge."""
    best = metrics.best_setting(curve, [unit], setting, value)
    edge = curve.groupBy(unit).agg(F.min(setting).alias("__lo"), F.max(setting).alias("__hi"))
    return best.select(unit, setting).join(audit, [unit, setting]).join(edge, unit).withColumn("at_edge", (F.col(setting) == F.col("__lo")) | (F.col(setting) == F.col("__hi"))).drop("__lo", "__hi")


def year_effects(diffs: DataFrame, dataset: str, period: str, group: str, diff: str = "diff", b: int = 2000, seed="k7", over: tuple[str, ...] = ()) -> DataFrame:
    """K7: mean difference and bootstrap SE by dataset and period (and ``over``, each with its own floor), SEs floored."""
    e = inference.bootstrap_mean(diffs, [*over, dataset, period], group, diff, b, seed, [dataset, period])
    return inference.floor_se(e.select(*over, dataset, period, "d", F.coalesce("se", F.lit(0.0)).alias("se"), "n_env"), dataset, over=over)


def check_submission(sub: DataFrame, required: list[str], keys: list[str], known: DataFrame, dataset: str) -> DataFrame:
    """K8: one row of findings: missing columns, duplicate keys, unknown datasets, rows without prediction."""
    missing = [c for c in required if c not in sub.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    dup = sub.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    unknown = sub.join(F.broadcast(known), dataset, "left_anti").agg(F.countDistinct(dataset).alias("unknown_datasets"))
    empty = sub.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred").isNull()).alias("empty_predictions"))
    return empty.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(unknown))  # one row each


def score_submission(pred: DataFrame, dataset: str, period: str, group: str, entity: str, value: str, one: str, other: str, least: int = 25, b: int = 2000, seed: str = "k8") -> DataFrame:
    """K8: the benchmark's report: per-group metric differences, period effects, floored SEs, pooling, threshold, verdict.

    One shuffle by group for the metrics and one by metric and period for the bootstrap of all of them; the rest are rows by the dozen.
    Metrics by group and period effects are written once, as what follows reads them many times.
    """
    both = pred.unpivot([dataset, period, group, entity, value], [one, other], "method", "score")
    per = staged(metrics.group_metrics(both, ["method", dataset, period, group], entity, value, "score", least), "submission-metrics")
    long = per.unpivot(["method", dataset, period, group], ["spearman", "sel_diff"], "metric", "v")
    diff = metrics.contrast(long, ["metric", dataset, period, group], "method", one, other, "v")
    effects = staged(year_effects(staged(diff, "submission-differences"), dataset, period, group, "diff", b, F.concat(F.lit(seed), "metric"), ("metric",)), "submission-effects")
    cells = pred.filter(F.col(value).isNotNull()).groupBy(dataset).agg(F.count(F.lit(1)).alias("n_cells"))
    pooled = inference.dersimonian_laird(effects, ["metric", dataset]).join(cells, dataset)
    rows = pooled.select("metric", dataset, "k", "est", "pooled_se", "lo", "hi", "tau2", inference.resolution(F.col("n_cells")).alias("resolution"))
    return rows.withColumn("verdict", inference.verdict(F.col("est"), F.col("lo"), F.col("hi"), F.col("resolution")))


def scrambled(df: DataFrame, period: str, from_period: int, value: str, *key: Column) -> DataFrame:
    """Values of late periods replaced by hash noise; a leakage-free job must not notice."""
    noise = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn(value, F.when(F.col(period) >= from_period, noise).otherwise(F.col(value)))


def same_output(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How two runs' outputs compare: rows on one side, correlation, largest difference."""
    j = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    return j.agg(F.count_if(F.col("__a").isNull() != F.col("__b").isNull()).alias("unmatched"), metrics.pearson("__a", "__b").alias("r"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest that does not depend on row order: count and sum of row digests."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))), 1, 10), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))


def reconcile(expected: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Printed numbers against computed ones at the printed decimals. ``expected``: key, printed, decimals."""
    j = expected.join(computed.select(key, "computed"), key, "left")
    agrees = F.abs(F.col("computed") - F.col("printed")) <= 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + 1e-9
    return j.withColumn("status", F.when(F.col("printed").isNull(), "SKIP").when(F.col("computed").isNull(), "UNCHECKED").when(agrees, "PASS").otherwise("FAIL"))


def compare_verdicts(primary: DataFrame, sensitivity: DataFrame, key: list[str]) -> DataFrame:
    """Two verdict tables side by side with change flags."""
    s = sensitivity.select(*key, F.col("est").alias("est_s"), F.col("verdict").alias("verdict_s"))
    j = primary.select(*key, "est", "verdict").join(s, key, "full_outer")
    return j.withColumn("changed", ~F.col("verdict").eqNullSafe(F.col("verdict_s")))
