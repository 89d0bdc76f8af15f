"""Reports and audits composed of operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators import ensemble, features, inference, joins, metrics
from harrow.operators.staging import staged


def group_mean_correlation(groups: DataFrame, group: str, value: str, one: str, other: str, b: int, seed: str) -> DataFrame:
    """I8: bootstrap of the difference of two correlations across group means: mean, SE, one-sided p."""
    def difference(x: list, p):
        v, a, c = (k[p] for k in x)
        return [inference.correlations(v, a) - inference.correlations(v, c)]

    per = inference.drawn(groups.withColumn("__s", F.lit("all")), ["__s"], group, [value, one, other], b, seed, difference, "__d double")
    return per.agg(F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("se"), ((1 + F.count_if(F.col("__d") <= 0)) / (b + 1)).alias("p_one_sided"))


def shared_draws(table: DataFrame, stratum: str, unit: str, contrasts: list[str], b: int, seed: str) -> DataFrame:
    """Several contrasts under the same draws of units: SEs and the correlations of their bootstrap means."""
    def averages(x: list, p):
        return [np.nansum(c[p], axis=1) / np.where(n := np.count_nonzero(~np.isnan(c[p]), axis=1), n, np.nan) for c in x]

    means = inference.drawn(table, [stratum], unit, contrasts, b, seed, averages, ", ".join(f"{c} double" for c in contrasts))
    pairs = [(a, c) for i, a in enumerate(contrasts) for c in contrasts[i + 1 :]]
    return means.groupBy(stratum).agg(*(F.stddev_samp(c).alias(f"se_{c}") for c in contrasts), *(metrics.pearson(a, c).alias(f"r_{a}_{c}") for a, c in pairs))


def scope_report(pred: DataFrame, scope: str, period: str, group: str, entity: str, value: str, one: str, other: str, least: int, b: int, seed: str) -> DataFrame:
    """Pooled rank-correlation contrasts by scope."""
    both = pred.unpivot([scope, period, group, entity, value], [one, other], "method", "score")
    per = metrics.spearman(both, ["method", scope, period, group], entity, value, "score").filter(F.col("n") >= least)
    per = staged(per, "scope-ranks")  # each side of the contrasts reads it
    diff = staged(metrics.contrast(per, [scope, period, group], "method", one, other, "spearman"), "scope-contrasts")  # read for means, draws and floors
    return inference.dersimonian_laird(ensemble.year_effects(diff, scope, period, group, "diff", b, seed), [scope])


def search_audit(series: DataFrame, response: DataFrame, train: Column, group: str, k: str, value: str, y: str, starts: list[int], lengths: list[int]) -> DataFrame:
    """A window chosen on the training groups against one chosen on the test groups themselves, both valued on the test groups."""
    inside = features.window_search(series.filter(train), response.filter(train), group, k, value, y, starts, lengths).withColumnRenamed("r", "train_r").drop("n")
    outside = features.window_search(series.filter(~train), response.filter(~train), group, k, value, y, starts, lengths).withColumnRenamed("r", "test_r").drop("n")
    j = inside.join(outside, ["start", "length"])
    pick = lambda c: F.min(F.struct((-F.abs(c)).alias("o"), F.col("start"), F.col("length"), F.abs(F.col("test_r")).alias("v")))["v"]
    return j.agg(F.count(F.lit(1)).alias("windows"), pick(F.col("train_r")).alias("nested_r"), pick(F.col("test_r")).alias("leaky_r"))


def kernel_average(gram: DataFrame, known: DataFrame, entity: str, y: str) -> DataFrame:
    """J24 for scores by similarity: kernel-weighted average of known values; ``gram`` has (i, j, k) with all wanted i."""
    j = gram.join(known.select(F.col(entity).alias("j"), F.col(y).alias("__y")), "j")
    return j.groupBy(F.col("i").alias(entity)).agg((F.sum(F.col("k") * F.col("__y")) / (F.sum(F.abs("k")) + 1e-9)).alias("score"))


def window_contrasts(daily: DataFrame, windows: DataFrame, group: str, order: str, cum: str, value: str) -> DataFrame:
    """a group's window mean minus the mean over all groups' days of that window."""
    w = joins.grid(daily.select(group).distinct(), windows)
    s = joins.window_sums(daily, w, group, order, cum, value)
    every = Window.partitionBy("window")
    return s.withColumn("delta", F.col("mean") - F.sum("total").over(every) / F.sum("days").over(every))
