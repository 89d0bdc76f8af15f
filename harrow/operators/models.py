"""Linear models from sufficient statistics.

Spark adds up cross-products; what reaches the driver is p x p for p features, or a grid, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.aggs import gram_sums
from harrow.operators.staging import staged
from harrow.operators.windows import center, dealt


def centred(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns minus their group's mean: group effects are fitted by this."""
    return df.withColumns({c: center(c, group) for c in columns})


def normal_equations(df: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of centred columns: one row from Spark."""
    r = gram_sums(df, [], columns, target).first()
    a = np.array([[r[f"p_{x}_{y}"] if f"p_{x}_{y}" in r else r[f"p_{y}_{x}"] for y in columns] for x in columns], float)
    b = np.array([r[f"p_{x}_{target}"] for x in columns], float)
    return a, b, float(r[f"p_{target}_{target}"]), int(r["n"])


def ridge_path(train: DataFrame, group: str, columns: list[str], target: str, relative: tuple[float, ...]) -> dict[float, np.ndarray]:
    """Ridge coefficients on group-centred columns for penalties relative to the mean eigenvalue; one eigendecomposition."""
    a, b, _, _ = normal_equations(centred(train, group, [*columns, target]), columns, target)
    w, v = np.linalg.eigh(a)
    return {lam: v @ ((v.T @ b) / (w + lam * w.mean())) for lam in relative}


def predict_path(df: DataFrame, path: dict[float, np.ndarray], columns: list[str]) -> DataFrame:
    """A row for each input row and penalty: (setting, score)."""
    def dot(coef: np.ndarray) -> Column:
        out = F.lit(0.0)
        for c, w in zip(columns, coef.tolist()):
            out = out + F.col(c) * F.lit(w)
        return out

    each = F.array(*(F.struct(F.lit(float(lam)).alias("setting"), dot(coef).alias("score")) for lam, coef in path.items()))
    return df.withColumn("__x", F.explode(each)).select(*df.columns, "__x.*")


def spectrum(df: DataFrame, group: str, columns: list[str], target: str) -> tuple[DataFrame, float, int]:
    """Eigenvalues and squared rotated cross-products (d, c2) of group-centred columns, the residual sum and its degrees."""
    a, b, yy, n = normal_equations(centred(df, group, [*columns, target]), columns, target)
    groups = df.select(group).distinct().count()
    w, v = np.linalg.eigh(a)
    rows = [(float(max(x, 0.0)), float(y)) for x, y in zip(w, (v.T @ b) ** 2)]
    return df.sparkSession.createDataFrame(rows, "d double, c2 double"), yy, n - groups


def reml_grid(spec: DataFrame, yy: float, degrees: int, deltas: list[float]) -> DataFrame:
    """Restricted log-likelihood of variance ratios: the spectrum, a row an eigenvalue, times the grid.

    delta is the feature variance over the residual variance; profile over the residual variance.
    """
    grid = spec.sparkSession.createDataFrame([(float(x),) for x in deltas], "delta double")
    x = spec.crossJoin(F.broadcast(grid))
    s = x.groupBy("delta").agg(F.sum(F.log(1 + F.col("delta") * F.col("d"))).alias("logs"), F.sum(F.col("delta") * F.col("c2") / (1 + F.col("delta") * F.col("d"))).alias("fit"))
    rss = F.lit(yy) - F.col("fit")
    return s.select("delta", (-0.5 * (F.lit(float(degrees)) * F.log(rss / degrees) + F.col("logs"))).alias("loglik"), (rss / degrees).alias("sigma2"))


def best_delta(grid: DataFrame) -> DataFrame:
    """The ratio with the largest likelihood, and whether it lies at the grid's edge."""
    edge = grid.agg(F.min("delta").alias("__lo"), F.max("delta").alias("__hi"))
    best = grid.agg(F.min(F.struct((-F.col("loglik")).alias("l"), F.col("delta").alias("delta"), F.col("sigma2").alias("sigma2"))).alias("x")).select("x.delta", "x.sigma2", (-F.col("x.l")).alias("loglik"))
    return best.crossJoin(F.broadcast(edge)).withColumn("at_edge", (F.col("delta") == F.col("__lo")) | (F.col("delta") == F.col("__hi"))).drop("__lo", "__hi")


def group_blup(cells: DataFrame, features: DataFrame, group: str, entity: str, target: str, columns: list[str], delta: float) -> tuple[DataFrame, np.ndarray]:
    """Cell-level model with group fixed effects and random feature effects of a given ratio; entity scores for all of ``features``.

    Group centring of the features is done on the cells, so each cell counts once in the cross-products.
    """
    rows = cells.select(group, entity, target).join(features, entity)
    a, b, _, _ = normal_equations(centred(rows, group, [*columns, target]), columns, target)
    coef = np.linalg.solve(a + np.eye(len(columns)) / delta, b)
    return predict_path(features, {0.0: coef}, columns).drop("setting"), coef


def two_stage(cells: DataFrame, features: DataFrame, group: str, entity: str, target: str, columns: list[str], relative: tuple[float, ...]) -> dict[float, np.ndarray]:
    """Entity means of group-centred values first, then one ridge over entities."""
    means = cells.withColumn("__c", center(target, group)).groupBy(entity).agg(F.avg("__c").alias(target))
    return ridge_path(means.join(features, entity).withColumn("__all", F.lit(1)), "__all", columns, target, relative)


def group_means_or_ridge(groups: DataFrame, observed: DataFrame, group: str, columns: list[str], target: str, penalty: float) -> DataFrame:
    """A group's observed mean, else a ridge on its covariates fitted on the groups with one."""
    known = groups.join(observed.groupBy(group).agg(F.avg(target).alias("__m")), group, "left")
    train = known.filter(F.col("__m").isNotNull()).withColumn("__all", F.lit(1))
    m = train.agg(*(F.avg(c).alias(c) for c in [*columns, "__m"])).first()
    coef = ridge_path(train, "__all", columns, "__m", (penalty,))[penalty]
    guess = F.lit(m["__m"])
    for c, w in zip(columns, coef.tolist()):
        guess = guess + (F.col(c) - m[c]) * w
    return known.select(group, F.coalesce("__m", guess).alias("mean"), F.col("__m").isNotNull().alias("observed"))


def residual_weights(cells: DataFrame, group: str, value: str, score: str, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Residual SD of each group over the median one, clipped, as a weight."""
    r = cells.withColumn("__r", center(value, group) - center(score, group)).groupBy(group).agg(F.stddev_samp("__r").alias("sd"))
    med = r.agg(F.percentile("sd", F.lit(0.5)).alias("__med"))
    ratio = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.try_divide("sd", "__med"), F.lit(1.0))))
    return r.crossJoin(F.broadcast(med)).select(group, "sd", (1 / (ratio * ratio)).alias("weight"))


def active_locations(cells: DataFrame, location: str, period: str, periods: int = 2, rows: int = 50) -> DataFrame:
    """Locations with enough periods and cells for an effect of their own."""
    return cells.groupBy(location).agg(F.countDistinct(period).alias("periods"), F.count(F.lit(1)).alias("cells")).filter((F.col("periods") >= periods) & (F.col("cells") >= rows))


def em_one_way(cells: DataFrame, key: list[str], value: str, rounds: int = 20) -> tuple[DataFrame, float, float]:
    """One-way random effect by EM on (n, sum, sum of squares) of each key; a round is one aggregate of that table.

    Returns shrunken means n u / (n + s2e / s2u), and both variances after a fixed number of rounds.
    """
    t = staged(cells.groupBy(*key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")), "em-sums")
    total = t.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k")).first()
    u = e = total["q"] / total["n"] / 2
    for _ in range(rounds):
        post = F.col("s") / (F.col("n") + e / u)
        var = e / (F.col("n") + e / u)
        r = t.agg(F.sum(post * post + var).alias("u"), F.sum(F.col("q") - 2 * post * F.col("s") + F.col("n") * (post * post + var)).alias("e")).first()
        u, e = r["u"] / total["k"], r["e"] / total["n"]
    return t.select(*key, "n", (F.col("s") / (F.col("n") + e / u)).alias("effect")), u, e


def within_group_ols(df: DataFrame, group: str, y: str, x: list[str]) -> dict[str, float]:
    """Least squares without intercept on group-centred columns, two to five of them."""
    a, b, _, _ = normal_equations(centred(df, group, [*x, y]), x, y)
    return dict(zip(x, np.linalg.lstsq(a, b, rcond=None)[0].tolist()))


def simple_ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept; null where x does not vary."""
    slope = F.try_divide(F.covar_pop(y, x), F.var_pop(x))
    return df.groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def count_weighted(cells: DataFrame, entity: str, group: str, value: str) -> DataFrame:
    """One row an entity: mean of centred values and number of cells as weight."""
    return cells.withColumn("__c", center(value, group)).groupBy(entity).agg(F.avg("__c").alias(value), F.count(F.lit(1)).alias("weight"))


def adjusted_means(plots: DataFrame, group: str, entity: str, rep: str, value: str) -> DataFrame:
    """Entity means adjusted for replicate effects, exact where replicates are complete: value minus its replicate's deviation from the group mean. ``plots``: as read, so that files' footers count them."""
    plots = dealt(plots.select(group, entity, rep, value), plots.count(), group)
    d = plots.withColumn("__adj", F.col(value) - F.avg(value).over(Window.partitionBy(group, rep)) + F.avg(value).over(Window.partitionBy(group)))
    return d.groupBy(group, entity).agg(F.avg("__adj").alias("adjusted"), F.count(F.lit(1)).alias("n"))
