"""Models in stages and over nested folds.

Ridges of all folds come from one pass: moments by fold are added up once, and the fit that leaves folds out subtracts
theirs. What reaches the driver is features x features for each fold or variant, whose number is checked. Tree models
are Spark ML's; the cells stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.blocks import _square, centred_moments, dot, moments, sum_arrays
from harrow.operators.learners import assembled, sampled_boosting, weighted
from harrow.operators.metrics import mean_metric, pearson
from harrow.operators.staging import staged

#: Folds or variants whose moments reach the driver.
MOST_FOLDS = 200


def _gathered(m: DataFrame, key: str, array: str) -> dict:
    rows = m.select(key, array).limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} values of {key}")
    return {r[key]: _square(r[array]) for r in rows}


def ridge_without(total: np.ndarray, left_out: Iterable[np.ndarray], relative: Iterable[float]) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept for each penalty, from raw moments of (1, x.., y) less those of the folds left out."""
    m = total - sum(left_out, np.zeros_like(total))
    if m[0, 0] < 0.5:
        raise ValueError("no cells are left to fit on")
    mean = m[0] / m[0, 0]
    c = m - np.outer(m[0], m[0]) / m[0, 0]
    d, v = np.linalg.eigh(c[1:-1, 1:-1])
    b = v.T @ c[1:-1, -1]
    out = []
    for lam in relative:
        coef = v @ (b / (np.maximum(d, 0) + max(lam * d.mean(), 1e-12)))
        out.append((coef, float(mean[-1] - coef @ mean[1:-1])))
    return out


def _fits(rows: list[tuple], df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __c, __a): a row of coefficients and intercepts for each tuple of keys."""
    kinds = ", ".join(f"`{k}` {df.schema[k.removeprefix('__other_')].dataType.simpleString()}" for k in keys)
    return df.sparkSession.createDataFrame(rows, f"{kinds}, __c array<array<double>>, __a array<double>")


def _path(fits: list[tuple[np.ndarray, float]]) -> tuple[list, list]:
    return [c.tolist() for c, _ in fits], [a for _, a in fits]


def path_scores(x: str) -> Column:
    """An array with one score for each row of coefficients ``__c`` and intercept ``__a``."""
    return F.zip_with("__c", "__a", lambda c, a: dot(F.col(x), c) + a)


def group_correlations(scored: DataFrame, by: list[str], y: str, scores: Column, n: int) -> DataFrame:
    """(by, setting, r): correlation of ``y`` with each of ``n`` scores, all in one aggregate: rows are not repeated by setting."""
    d = scored.select(*by, F.col(y).alias("__y"), scores.alias("__s"))
    per = d.groupBy(*by).agg(F.array(*(pearson(F.col("__y"), F.col("__s")[i]) for i in range(n))).alias("__r"))
    return per.select(*by, F.posexplode("__r").alias("setting", "r"))


def best_by_folds(scored: DataFrame, fold: str, group: str, y: str, scores: str, n: int) -> tuple[int, DataFrame]:
    """Place of the score (of ``n``) that is best by the mean over folds of the mean within-group correlation, and the curve (fold, setting, r)."""
    per = group_correlations(scored, [fold, group], y, F.col(scores), n)
    curve = staged(mean_metric(per, [fold, "setting"], "r").select(fold, "setting", "r"), "fold-curve")
    mean = curve.groupBy("setting").agg(F.avg("r").alias("r")).filter("r is not null").orderBy(F.col("r").desc(), "setting").first()
    return (mean["setting"] if mean else 0), curve


def boosted(train: DataFrame, columns: list[str], target: str, rounds: int, depth: int = 4, step: float = 0.1, seed: int = 1):
    """Trees that take all rows are fitted on distinct features, weighted; for those that take a share of the rows see ``learners.sampled_boosting``."""
    gbt = GBTRegressor(featuresCol="features", labelCol=target, weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return gbt.fit(assembled(weighted(train, columns, target), columns))


def staged_scores(model, df: DataFrame, columns: list[str], every: int, out: str = "staged") -> DataFrame:
    """Boosted scores after every ``every`` trees, an array: each tree is applied once and sums go on from stage to stage."""
    d, sums, names, last = assembled(df, columns), F.lit(0.0), [], len(model.trees)
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
        d = tree.setFeaturesCol("features").setPredictionCol("__tree").transform(d)
        sums = sums + F.col("__tree") * float(weight)
        d = d.withColumn(f"__sum{i}", sums).drop("__tree")
        sums = F.col(f"__sum{i}")
        if i % every == 0 or i == last:
            names.append(f"__sum{i}")
    return d.withColumn(out, F.array(*names)).select(*df.columns, out)


def residual_boosting(
    train: DataFrame, test: DataFrame, fold: str, group: str, y: str, x: str, columns: list[str], relative: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0), rounds: int = 100,
    every: int = 10, depth: int = 4, step: float = 0.1,
) -> tuple[DataFrame, dict]:
    """Ridge on the array ``x``, then boosting on ``columns`` of what it leaves; ``test`` with stage1 and score.

    Penalty: best over the held-out folds. Residuals are cross-fitted: a row's comes from the ridge without its fold; while
    a fold is held out to choose the number of trees, from the ridge without its own and the held-out fold. Every ridge is
    a subtraction of moments. Trees are scored stage by stage on the held-out folds.
    """
    train = staged(train, "boosting-train")
    m = _gathered(moments(train, [fold], x, y), fold, "m")
    if len(m) < 3:
        raise ValueError("nested folds take at least three")
    total, keys = sum(m.values()), list(m)
    paths = _fits([(k, *_path(ridge_without(total, [m[k]], relative))) for k in keys], train, [fold])
    held = train.join(F.broadcast(paths), fold).withColumn("__scores", path_scores(x)).drop("__c", "__a")
    setting, curve = best_by_folds(held, fold, group, y, "__scores", len(relative))
    held = staged(held.withColumn("__stage1", F.col("__scores")[setting]).drop("__scores"), "boosting-held")
    at = (relative[setting],)
    both = _fits([(u, v, *_path(ridge_without(total, [m[u], m[v]], at))) for u in keys for v in keys if u != v], train, [fold, f"__other_{fold}"])
    nested = []
    for v in keys:
        without = held.filter(F.col(fold) != v).join(F.broadcast(both.filter(F.col(f"__other_{fold}") == v)), fold)
        without = without.withColumn("__r", F.col(y) - path_scores(x)[0]).drop("__c", "__a", f"__other_{fold}")
        model = boosted(without, columns, "__r", rounds, depth, step)
        on = staged_scores(model, held.filter(F.col(fold) == v), columns, every)
        nested.append(on.select(fold, group, y, F.transform("staged", lambda s: s + F.col("__stage1")).alias("__scores")))
    every_fold = nested[0]
    for n in nested[1:]:
        every_fold = every_fold.unionByName(n)
    stage, tree_curve = best_by_folds(staged(every_fold, "boosting-nested"), fold, group, y, "__scores", -(-rounds // every))
    final = boosted(held.withColumn("__r", F.col(y) - F.col("__stage1")), columns, "__r", rounds, depth, step)
    coef, a = ridge_without(total, [], at)[0]
    out = staged_scores(final, test.withColumn("stage1", dot(F.col(x), coef) + F.lit(a)), columns, every)
    out = out.withColumn("score", F.col("stage1") + F.col("staged")[stage]).drop("staged")
    return out, {"penalty": at[0], "trees": min((stage + 1) * every, rounds), "curve": curve, "tree_curve": tree_curve}


# ---- J26, J27: penalty chosen on the last training period, for many variants of the features at once


def scaled_moments(m: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """Moments of (1, x.., factor * x.., y) from those of (1, x.., y): a factor that is one number for each row of ``m`` needs no pass over the cells."""

    def run(batches):
        for b in batches:
            out = []
            for array, f in zip(b["m"], b[factor]):
                one = _square(array)
                p = np.eye(len(one))
                p = np.vstack([p[:-1], f * p[1:-1], p[-1:]])
                out.append((p @ one @ p.T).ravel())
            frame = b[keys].copy()
            frame["m"] = out
            yield frame

    kinds = [f"`{k}` {m.schema[k].dataType.simpleString()}" for k in keys]
    return m.select(*keys, factor, "m").filter(F.col(factor).isNotNull()).mapInPandas(run, ", ".join([*kinds, "m array<double>"]))


def forward_variants(cells: DataFrame, variant: str, group: str, period: str, y: str, x: str, target: int, relative: tuple[float, ...], m: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ridge with group effects for each variant of the features; penalty chosen on the last period before ``target`` by a fit on the earlier ones, then a refit.

    ``cells`` has a row for each cell and variant: a base model, anchors, controls with shuffled or true anchors. One pass
    gives the moments of all variants and periods, one job scores all variants and penalties. Nothing of ``target`` or
    later enters a fit. Returns the target period's rows with ``score``, and (variant, penalty, validation). ``m``: the moments
    (variant, group, period, m) of all cells, where the caller has them; then only the last two periods' cells are read.
    """
    past = (cells if m is None else m).filter(F.col(period) < target)
    last = past.agg(F.max(period)).first()[0]
    if last is None:
        raise ValueError(f"no period before {target}")
    by = centred_moments(moments(past, [variant, group, period], x, y) if m is None else past, [variant, group, period])
    by = staged(by.withColumn("__inner", F.col(period) < last), "variants-moments")
    inner, outer = (_gathered(sum_arrays(m, [variant], "c"), variant, "c") for m in (by.filter("__inner"), by))

    def paths(c: np.ndarray) -> list[np.ndarray]:
        d, v = np.linalg.eigh(c[:-1, :-1])
        return [v @ ((v.T @ c[:-1, -1]) / (np.maximum(d, 0) + max(lam * d.mean(), 1e-12))) for lam in relative]

    if set(inner) != set(outer):
        raise ValueError("a variant has no cells before the validation period")
    zero = [0.0] * len(relative)
    fits = _fits([(k, [c.tolist() for c in paths(m)], zero) for k, m in inner.items()], cells, [variant])
    check = cells.filter(F.col(period) == last).join(F.broadcast(fits), variant)
    curve = mean_metric(group_correlations(check, [variant, group], y, path_scores(x), len(relative)), [variant, "setting"], "r")
    curve = staged(curve.filter("r is not null"), "variants-curve")
    w = Window.partitionBy(variant).orderBy(F.col("r").desc(), "setting")
    best = curve.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(variant, "setting", "r")
    chosen = {r[variant]: r["setting"] for r in best.collect()}
    refits = [(k, [paths(m)[chosen.get(k, 0)].tolist()], [0.0]) for k, m in outer.items()]
    out = cells.filter(F.col(period) == target).join(F.broadcast(_fits(refits, cells, [variant])), variant).withColumn("score", path_scores(x)[0]).drop("__c", "__a")
    grid = F.array(*(F.lit(float(r)) for r in relative))
    return out, best.select(variant, grid[F.col("setting")].alias("penalty"), F.col("r").alias("validation"))


# ---- J28: boosting on features and lags


def with_lags(cells: DataFrame, history: DataFrame, place: str, period: str, value: str, lags: int = 2) -> tuple[DataFrame, list[str]]:
    """The place's mean value of each of the last ``lags`` periods as columns lag1.., the mean over places where it has none."""
    means = staged(history.groupBy(place, period).agg(F.avg(value).alias("__v"), F.sum(value).alias("__s"), F.count(value).alias("__n")), "lag-means")
    every = means.groupBy(period).agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("__e"))
    names = []
    for k in range(1, lags + 1):
        earlier = means.select(place, (F.col(period) + k).alias(period), F.col("__v"))
        overall = every.select((F.col(period) + k).alias(period), F.col("__e"))
        cells = cells.join(earlier, [place, period], "left").join(F.broadcast(overall), period, "left")
        cells = cells.withColumn(f"lag{k}", F.coalesce("__v", "__e", F.lit(0.0))).drop("__v", "__e")
        names.append(f"lag{k}")
    return cells, names


def averaged_boosting(
    train: DataFrame, test: DataFrame, columns: list[str], y: str, seeds: Iterable[int], rounds: int = 100, depth: int = 3, step: float = 0.1, rate: float = 0.7, out: str = "boosted", keys: list[str] | None = None,
) -> DataFrame:
    """Mean prediction of boosted models that differ in their seed; all grow in the same passes. ``keys`` name a row, for the bags."""
    return sampled_boosting(train, test, columns, y, seeds, rounds, depth, step, rate, keys, out=out).select(*test.columns, out)


def on_identical_folds(cells: DataFrame, fold: str, folds: Iterable, methods: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Every method on the same folds: (columns of cells, method, score). A method takes the other folds' rows and the fold's, and returns the latter with ``score``."""
    cells, out = staged(cells, "identical-folds"), None
    for f in folds:
        for name, method in methods.items():
            got = method(cells.filter(F.col(fold) != f), cells.filter(F.col(fold) == f)).select(*cells.columns, F.lit(name).alias("method"), "score")
            out = got if out is None else out.unionByName(got)
    return out


# ---- K25, K26


def external_folds(cells: DataFrame, folds: list[tuple[str, Column, Column]], run: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> DataFrame:
    """``run(train, test)`` for each (key, train rows, test rows), written record by record under ``path``; a key that is already there is kept.

    A fold whose train and test rows overlap is refused.
    """
    spark = cells.sparkSession
    jvm = spark.sparkContext._jvm
    out = None
    for key, train, test in folds:
        if not cells.filter(train & test).isEmpty():
            raise ValueError(f"fold {key}: train and test overlap")
        at = f"{path.rstrip('/')}/fold={key}"
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            run(cells.filter(train), cells.filter(test)).write.mode("overwrite").parquet(at)
        got = spark.read.parquet(at).withColumn("fold", F.lit(key))
        out = got if out is None else out.unionByName(got)
    return out


def selected_per_group(curve: DataFrame, audit: DataFrame, fold: str, model: str, inner: str, setting: str, group: str, r: str, first_inner: DataFrame) -> DataFrame:
    """(fold, model, protocol, setting, group, r): the audit's values at the setting that each protocol chooses.

    P1: best on one inner fold, named in ``first_inner`` (fold, inner); P2: best on the audit groups themselves (an upper
    bound, not a forecast); P3: best by the mean over inner folds. ``curve``: fold, model, inner, setting, r; ``audit``:
    fold, model, setting, group, r. Undefined values never win; ties go to the smallest setting.
    """
    by = [fold, model]

    def best(c: DataFrame, protocol: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col("__r").desc(), setting)
        c = c.filter("__r is not null").withColumn("__k", F.row_number().over(w)).filter("__k = 1")
        return c.select(*by, setting, F.lit(protocol).alias("protocol"))

    one = best(curve.join(F.broadcast(first_inner), [fold, inner], "left_semi").select(*by, setting, F.col(r).alias("__r")), "P1")
    two = best(audit.groupBy(*by, setting).agg(F.avg(r).alias("__r")), "P2")
    three = best(curve.groupBy(*by, setting).agg(F.avg(r).alias("__r")), "P3")
    return audit.join(one.unionByName(two).unionByName(three), [*by, setting]).select(*by, "protocol", setting, group, r)
