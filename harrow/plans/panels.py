"""Composed jobs: panels by target period, tables and reports. Each is one lazy chain of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators import ensemble, inference, metrics, models
from harrow.operators.windows import center, zscore


def forward_panel(cells: DataFrame, features: DataFrame, group: str, entity: str, period: str, value: str, columns: list[str], targets: list[int], penalty: float) -> DataFrame:
    """For each target period a two-stage ridge fitted on earlier periods only; scores for the target's cells.

    A target is a fit of its own (p x p numbers reach the driver); the union is one table without observed values.
    """
    out = None
    for y in targets:
        path = models.two_stage(cells.filter(F.col(period) < y), features, group, entity, value, columns, (penalty,))
        now = cells.filter(F.col(period) == y).select(group, entity, period).join(features, entity)
        p = models.predict_path(now, path, columns).select(group, entity, period, "score")
        out = p if out is None else out.unionByName(p)
    return out


def fold_panel(folds: DataFrame, features: DataFrame, group: str, entity: str, value: str, columns: list[str], k: int, penalty: float) -> DataFrame:
    """Scores of each fold's entities from the other folds."""
    out = None
    for f in range(k):
        path = models.two_stage(folds.filter(F.col("fold") != f), features, group, entity, value, columns, (penalty,))
        p = models.predict_path(folds.filter(F.col("fold") == f).select(group, entity, "fold").join(features, entity), path, columns).select(group, entity, "fold", "score")
        out = p if out is None else out.unionByName(p)
    return out


def method_summary(per_group: DataFrame, method: str, period: str, metric: str) -> DataFrame:
    """Mean of each method over periods of period means, with the spread between periods."""
    per = per_group.groupBy(method, period).agg(F.avg(metric).alias("m"))
    return per.groupBy(method).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("periods"))


def population_contrast(cells: DataFrame, pred: DataFrame, entity: str, period: str, group: str, value: str, one: str, other: str, b: int, seed: str) -> DataFrame:
    """Rank correlations with means across groups, their difference, and its SE over drawn entities.

    A period's entities grow with the table, so neither ranks nor draws of a period are worked out in one task. Entities
    without a mean or one of the scores take no part. Tables of a row an entity are joined by sorting, whatever Spark takes
    them for: none is gathered in the driver.
    """
    means = cells.groupBy(period, entity).agg(F.round(F.avg(value), 6).alias("mean"), F.countDistinct(group).alias("groups")).filter("groups >= 2")
    scores = pred.groupBy(period, entity).agg(F.round(F.avg(one), 6).alias(one), F.round(F.avg(other), 6).alias(other))  # rounded, so that ties are ties
    d = inference.placed(means.join(scores.hint("merge"), [period, entity]).dropna(subset=["mean", one, other]), [period], entity, ["mean", one, other])
    r = d.groupBy(period).agg(metrics.pearson("__r0", "__r1").alias("r_one"), metrics.pearson("__r0", "__r2").alias("r_other"))
    se = inference.rank_difference_of_many(d, [period], b, seed).select(period, "se")
    return r.join(se, period).withColumn("diff", F.col("r_one") - F.col("r_other"))


def unit_effects(diffs: DataFrame, traits: list[str], unit: list[str], diff: str) -> DataFrame:
    """Differences averaged over traits first, then by unit."""
    return diffs.groupBy(*unit, *traits).agg(F.avg(diff).alias("__d")).groupBy(*unit).agg(F.avg("__d").alias("d"), F.count(F.lit(1)).alias("n"))


def sensitivity(ye: DataFrame, dataset: str, variants: dict[str, bool]) -> DataFrame:
    """The pooled estimate under each floor variant (name -> floor zeros only), side by side."""
    out = None
    for name, zero_only in variants.items():
        p = inference.dersimonian_laird(inference.floor_se(ye, dataset, zero_only=zero_only), [dataset]).select(F.lit(name).alias("variant"), dataset, "est", "pooled_se", "k")
        out = p if out is None else out.unionByName(p)
    return out


def seeds(units: DataFrame, by: list[str], unit: str, value: str, b: int, names: list[str]) -> DataFrame:
    """Bootstrap SEs under several seeds, all in one pass: lowest and highest."""
    many = units.select(*by, unit, value).withColumn("__seed", F.explode(F.array(*(F.lit(s) for s in names))))
    d = inference.bootstrap_mean(many, [*by, "__seed"], unit, value, b, F.col("__seed"), by)
    return d.groupBy(*by).agg(F.min("se").alias("lowest"), F.max("se").alias("highest"), F.count(F.lit(1)).alias("seeds"))


def unit_variants(cells: DataFrame, subgroup: DataFrame, group: str, entity: str, value: str) -> DataFrame:
    """Cells under three unit definitions: as they are, centred within subgroup, and subgroup as the unit."""
    c = cells.join(subgroup, entity)
    base = c.select(F.lit("group").alias("variant"), F.col(group).alias("unit"), entity, F.col(value).alias("value"))
    inner = c.select(F.lit("centred").alias("variant"), F.col(group).alias("unit"), entity, center(value, group, "subgroup").alias("value"))
    split = c.select(F.lit("subgroup").alias("variant"), F.concat_ws("#", group, "subgroup").alias("unit"), entity, F.col(value).alias("value"))
    return base.unionByName(inner).unionByName(split)


def covariate_fill(df: DataFrame, train: Column, location: str, columns: list[str]) -> DataFrame:
    """location mean, else median, of the training side; then standardised by its mean and SD; with a flag for all missing."""
    t = df.filter(train)
    own = t.groupBy(location).agg(*(F.avg(c).alias(f"__l_{c}") for c in columns))
    med = t.agg(*(F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in columns))
    x = df.withColumn("missing", F.coalesce(*(F.col(c) for c in columns)).isNull().cast("int")).join(own, location, "left").crossJoin(F.broadcast(med))
    x = x.withColumns({c: F.coalesce(F.col(c), F.col(f"__l_{c}"), F.col(f"__m_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in "lm"))
    s = x.filter(train).agg(*(F.avg(c).alias(f"__a_{c}") for c in columns), *(F.stddev_samp(c).alias(f"__s_{c}") for c in columns))
    x = x.crossJoin(F.broadcast(s))
    return x.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in "as"))


def standardised_ridge(train: DataFrame, group: str, columns: list[str], target: str, penalty: float):
    """The ridge on values standardised within groups."""
    z = train.withColumn(target, zscore(target, group, sample=False)).filter(F.col(target).isNotNull())
    return models.ridge_path(z, group, columns, target, (penalty,))


def interaction_columns(df: DataFrame, a: list[str], b: list[str]) -> tuple[DataFrame, list[str]]:
    """Products of two sets of columns as new columns."""
    new = {f"{x}__{y}": F.col(x) * F.col(y) for x in a for y in b}
    return df.withColumns(new), [*a, *new]


def package(cells: DataFrame, pred: DataFrame, dataset: str, period: str, group: str) -> DataFrame:
    """One JSON text a dataset: its target periods, their groups and its methods."""
    groups = cells.groupBy(dataset, period).agg(F.sort_array(F.collect_set(group)).alias("groups"))
    g = groups.groupBy(dataset).agg(F.sort_array(F.collect_list(F.struct(period, "groups"))).alias("periods"))
    m = pred.groupBy(dataset).agg(F.sort_array(F.collect_set("method")).alias("methods"))
    return g.join(m, dataset).select(dataset, F.to_json(F.struct("periods", "methods")).alias("definition"))


def verdict_changes(primary: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """K23 over verdict tables with est, lo, hi and resolution."""
    v = lambda d: d.withColumn("verdict", inference.verdict(F.col("est"), F.col("lo"), F.col("hi"), F.col("resolution")))
    return ensemble.compare_verdicts(v(primary), v(other), key)


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """O2: the first k rows of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= k).drop("__k")
