"""Metrics of predictions within groups. What is undefined is null and drops out of means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.windows import center, dealt, rank_key


def pearson(x: Column | str, y: Column | str) -> Column:
    """M1 as an aggregate: null if either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def k_of(share: float, n: Column) -> Column:
    """Number selected: share of n, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(share) * n).cast("int"))


def ranked(pred: DataFrame, by: list[str], entity: str, value: str, score: str) -> DataFrame:
    """Mid-ranks (``__rv``, ``__rs``, the largest first) and stable places (``__pv``, ``__ps``) of value and score within groups.

    One shuffle, and one sort for each of the two columns: places, ranks and ties follow the same order.
    """
    d = pred.filter(F.col(value).isNotNull() & F.col(score).isNotNull())
    d = d.select(*dict.fromkeys([*by, entity, value, score]), rank_key(value, 9).alias("__kv"), rank_key(score, 9).alias("__ks"))
    d = dealt(d, pred.count(), *by)  # a written table's footers count it
    for c in "vs":
        order = Window.partitionBy(*by).orderBy(F.col(f"__k{c}").desc())
        ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        d = d.withColumn(f"__p{c}", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(f"__k{c}").desc(), entity))).withColumn(f"__r{c}", F.rank().over(order) + (ties - 1) / 2)
    return d


def spearman(pred: DataFrame, by: list[str], entity: str, value: str, score: str) -> DataFrame:
    """M2."""
    return ranked(pred, by, entity, value, score).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("__rv", "__rs").alias("spearman"))


def group_metrics(pred: DataFrame, by: list[str], entity: str, value: str, score: str, least: int = 25, share: float = 0.1) -> DataFrame:
    """M1-M7 in one pass over the ranked rows: a row for each group of at least ``least``."""
    d = ranked(pred, by, entity, value, score)
    w = Window.partitionBy(*by)
    d = d.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", k_of(share, F.col("__n"))).withColumn("__gain", F.col(value) - F.min(value).over(w))
    ps, pv, k = F.col("__ps"), F.col("__pv"), F.col("__k")
    dcg = F.sum(F.when(ps <= k, F.col("__gain") / F.log2(ps + 1.0)))
    ideal = F.sum(F.when(pv <= k, F.col("__gain") / F.log2(pv + 1.0)))
    err = F.col(score) - F.col(value)
    out = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(value, score).alias("pearson"), pearson("__rv", "__rs").alias("spearman"),
        F.try_divide(F.avg(F.when(ps <= k, F.col(value))) - F.avg(value), F.stddev_samp(value)).alias("sel_diff"),
        (F.count_if((ps <= k) & (pv <= k)) / F.max(k)).alias("hit_rate"), F.try_divide(dcg, ideal).alias("ndcg"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"), F.try_divide(F.covar_pop(score, value), F.var_pop(score)).alias("slope"))
    return out.filter(F.col("n") >= least)


def long_table(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """M8: a row for each group and metric."""
    return wide.unpivot([*by, "n"], metrics, "metric", "result")


def pooled_pearson(pred: DataFrame, by: list[str], value: str, score: str) -> DataFrame:
    """M9."""
    return pred.groupBy(*by).agg(pearson(value, score).alias("pooled_r"), F.count(F.lit(1)).alias("n"))


def mean_metric(per_group: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean over the groups where it is defined."""
    return per_group.groupBy(*by).agg(F.avg(metric).alias(metric), F.count(metric).alias("n_groups"))


def mean_pearson_of_many(pred: DataFrame, group: str, value: str, scores: list[str]) -> DataFrame:
    """Mean within-group correlation of each of several score columns."""
    long = pred.unpivot([group, value], scores, "setting", "score")
    return mean_metric(long.groupBy("setting", group).agg(pearson(value, "score").alias("r")), ["setting"], "r")


def centred_mse(pred: DataFrame, by: list[str], value: str, score: str) -> DataFrame:
    """Mean squared difference of group-centred values and scores."""
    d = pred.withColumn("__d", center(value, *by) - center(score, *by))
    return d.groupBy(*by).agg(F.avg(F.col("__d") * F.col("__d")).alias("msed"))


def huber(residual: Column, d: float) -> Column:
    """M13."""
    a = F.abs(residual)
    return F.when(a <= d, a * a / 2).otherwise(d * (a - d / 2))


def decomposition(pred: DataFrame, group: str, value: str, score: str) -> DataFrame:
    """The pooled correlation's parts: between and within groups, and the share of each side's variance between."""
    w = Window.partitionBy(group)
    d = pred.withColumns({"__mv": F.avg(value).over(w), "__ms": F.avg(score).over(w)})
    d = d.withColumns({"__dv": F.col(value) - F.col("__mv"), "__ds": F.col(score) - F.col("__ms")})
    return d.agg(pearson(value, score).alias("pooled_r"), pearson("__mv", "__ms").alias("between_r"), pearson("__dv", "__ds").alias("within_r"),
                 F.try_divide(F.var_pop("__mv"), F.var_pop(value)).alias("value_between"), F.try_divide(F.var_pop("__ms"), F.var_pop(score)).alias("score_between"))


def best_setting(curve: DataFrame, by: list[str], setting: str, criterion: str, largest: bool = True) -> DataFrame:
    """The setting with the best criterion; nulls never win, the smallest setting wins ties."""
    c = -F.col(criterion) if largest else F.col(criterion)
    d = curve.filter(F.col(criterion).isNotNull())
    return d.groupBy(*by).agg(F.min(F.struct(c.alias("c"), F.col(setting).alias("s"), F.col(criterion).alias("v"))).alias("x")).select(*by, F.col("x.s").alias(setting), F.col("x.v").alias(criterion))


def with_scopes(pred: DataFrame, is_new: str) -> DataFrame:
    """Each row under its scopes: all, and new or old."""
    return pred.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(F.col(is_new), "new").otherwise("old"))))


def contrast(per_group: DataFrame, on: list[str], method: str, one: str, other: str, metric: str) -> DataFrame:
    """One method's metric minus another's, by group; where both are defined."""
    a = per_group.filter(F.col(method) == one).select(*on, F.col(metric).alias("__a"))
    b = per_group.filter(F.col(method) == other).select(*on, F.col(metric).alias("__b"))
    return a.join(b, on).filter("__a is not null and __b is not null").select(*on, (F.col("__a") - F.col("__b")).alias("diff"))


def agreement(pred: DataFrame, by: list[str], entity: str, one: str, other: str) -> DataFrame:
    """Rank correlation of two scores by group, then median and minimum."""
    per = spearman(pred, by, entity, one, other)
    return per.agg(F.percentile("spearman", F.lit(0.5)).alias("median"), F.min("spearman").alias("lowest"), F.count("spearman").alias("n_groups"))
