"""Feature transforms and kernels on long tables. Everything fitted comes from the training side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_scaler(train: DataFrame, feature: str, value: str) -> DataFrame:
    """mode (the lowest on ties), mean and SD after imputing it; an SD under 1e-6 counts as 1."""
    n = train.filter(F.col(value).isNotNull()).groupBy(feature, value).agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy(feature).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))["v"].alias("fill"))
    x = train.join(F.broadcast(mode), feature).withColumn("__x", F.coalesce(F.col(value), F.col("fill")).cast("double"))
    return x.groupBy(feature, "fill").agg(F.avg("__x").alias("mean"), F.when(F.stddev_pop("__x") < 1e-6, 1.0).otherwise(F.stddev_pop("__x")).alias("sd"))


def mean_scaler(train: DataFrame, feature: str, value: str) -> DataFrame:
    """mean as fill, and SD after imputing it; constant features are dropped."""
    w = Window.partitionBy(feature)
    x = train.withColumn("fill", F.avg(value).over(w)).withColumn("__x", F.coalesce(F.col(value).cast("double"), F.col("fill")))
    return x.groupBy(feature).agg(F.first("fill").alias("fill"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("sd")).filter(F.col("sd") > 1e-9)


def weighted_scaler(train: DataFrame, counts: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """moments with each entity weighted by its number of records."""
    x = train.join(counts.select(entity, F.col("n").alias("__w")), entity).filter(F.col(value).isNotNull())
    w, v = F.col("__w"), F.col(value).cast("double")
    m = x.groupBy(feature).agg((F.sum(w * v) / F.sum(w)).alias("fill"), (F.sum(w * v * v) / F.sum(w)).alias("__m2"))
    return m.select(feature, "fill", F.col("fill").alias("mean"), F.sqrt(F.greatest(F.col("__m2") - F.col("fill") * F.col("fill"), F.lit(0.0))).alias("sd")).filter(F.col("sd") > 1e-9)


def scale(df: DataFrame, scaler: DataFrame, feature: str, value: str, out: str = "z") -> DataFrame:
    """Applies a scaler: fill, subtract the mean, divide by the SD. A scaler has a row for each feature."""
    d = df.join(scaler, feature)
    return d.withColumn(out, (F.coalesce(F.col(value).cast("double"), F.col("fill")) - F.col("mean")) / F.col("sd")).drop("fill", "mean", "sd")


def gram(z: DataFrame, entity: str, feature: str, value: str = "z") -> DataFrame:
    """inner products of entities that share features, (i, j, k) with i <= j. Zeros need not be stored."""
    a = z.select(F.col(entity).alias("i"), feature, F.col(value).alias("x"))
    b = z.select(F.col(entity).alias("j"), feature, F.col(value).alias("y"))
    return a.join(b, feature).filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("k"))


def vanraden_arrays(dosage: DataFrame, x: str) -> tuple[DataFrame, float]:
    """F8: dosages of each entity, an array, less twice the features' frequencies, and the sum of 2 p (1 - p) that divides products of them."""
    p = [r["p"] for r in dosage.select(F.posexplode(x).alias("i", "d")).groupBy("i").agg((F.avg("d") / 2).alias("p")).orderBy("i").collect()]  # one a feature
    twice = F.array(*(F.lit(2.0 * q) for q in p))
    return dosage.withColumn(x, F.zip_with(x, twice, lambda d, q: d - q)), sum(2 * q * (1 - q) for q in p)


def arc_cosine(kij: Column, kii: Column, kjj: Column) -> Column:
    """arc-cosine kernel of order 1 from inner products; the cosine is clipped to [-1, 1]."""
    norm = F.sqrt(kii * kjj)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(kij, norm)))
    t = F.acos(c)
    return norm / F.lit(3.141592653589793) * (F.sin(t) + (F.lit(3.141592653589793) - t) * F.cos(t))


def mixed_correlation(r: DataFrame, rho: float) -> DataFrame:
    """(1 - rho) I + rho R."""
    return r.withColumn("k", F.when(F.col("i") == F.col("j"), F.lit(1.0 - rho) + rho * F.col("k")).otherwise(rho * F.col("k")))


def growing_degrees(tmax: Column, tmin: Column, base: float, cap: float) -> Column:
    """growing-degree days with both temperatures held between base and cap."""
    hold = lambda x: F.least(F.greatest(x, F.lit(base)), F.lit(cap))
    return (hold(tmax) + hold(tmin)) / 2 - base


def vapour_deficit(temperature: Column, humidity: Column) -> Column:
    """vapour pressure deficit (Tetens)."""
    return 0.6108 * F.exp(17.27 * temperature / (temperature + 237.3)) * (1 - humidity / 100)


def season_windows(daily: DataFrame, anchors: DataFrame, windows: DataFrame, group: str, order: str, cum: str, values: list[str]) -> DataFrame:
    """means over thermal-time windows around an anchor, from prefix sums at the window's first and last day.

    Prefix sums make each window two lookups instead of a pass over its days. ``windows``: (window, lo, hi) relative to
    the anchor on the running series; complete if the series runs past the window's end.
    """
    w = Window.partitionBy(group).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumns({"__prev": F.lag(cum, 1, 0.0).over(w), "__k": F.row_number().over(w), **{f"__p_{v}": F.sum(v).over(run) for v in values}})
    d = d.withColumns({f"__q_{v}": F.col(f"__p_{v}") - F.col(v) for v in values})
    a = anchors.crossJoin(F.broadcast(windows)).select(group, "window", (F.col("anchor") + F.col("lo")).alias("__lo"), (F.col("anchor") + F.col("hi")).alias("__hi"))
    j = d.join(a, group).filter((F.col(cum) > F.col("__lo")) & (F.col("__prev") < F.col("__hi")))
    ends = j.groupBy(group, "window").agg(
        F.min(F.struct("__k", *(f"__q_{v}" for v in values))).alias("f"), F.max(F.struct("__k", *(f"__p_{v}" for v in values))).alias("l"), (F.max(cum) >= F.first("__hi")).alias("complete"))
    days = F.col("l.__k") - F.col("f.__k") + 1
    return ends.select(group, "window", days.cast("long").alias("days"), *(((F.col(f"l.__p_{v}") - F.col(f"f.__q_{v}")) / days).alias(f"mean_{v}") for v in values), "complete")


def window_search(series: DataFrame, response: DataFrame, group: str, k: str, value: str, y: str, starts: list[int], lengths: list[int]) -> DataFrame:
    """correlation of window means with a response for each start and length, best absolute value first.

    Windows come from differences of prefix sums, one lookup at each end.
    """
    spark = series.sparkSession
    prefix = series.select(group, k, F.sum(value).over(Window.partitionBy(group).orderBy(k)).alias("__s"))
    grid = spark.createDataFrame([(s, n) for s in starts for n in lengths], "start int, length int")
    at_end = prefix.select(group, F.col(k).alias("__e"), F.col("__s").alias("__se"))
    at_start = prefix.select(group, (F.col(k) + 1).alias("start"), F.col("__s").alias("__ss"))
    c = response.select(group, y).crossJoin(F.broadcast(grid)).withColumn("__e", F.col("start") + F.col("length") - 1)
    c = c.join(at_end, [group, "__e"]).join(at_start, [group, "start"], "left")
    c = c.withColumn("__x", (F.col("__se") - F.coalesce("__ss", F.lit(0.0))) / F.col("length"))
    r = F.try_divide(F.covar_pop("__x", y), F.stddev_pop("__x") * F.stddev_pop(y))
    return c.groupBy("start", "length").agg(r.alias("r"), F.count(F.lit(1)).alias("n"))


def maf_filter(dosage: DataFrame, feature: str, value: str, least: float = 0.05) -> DataFrame:
    """Features whose minor allele is frequent enough, with frequency and call rate."""
    af = F.avg(value) / 2
    return dosage.groupBy(feature).agg(af.alias("af"), F.avg(F.col(value).isNotNull().cast("double")).alias("call_rate")).filter(F.least(F.col("af"), 1 - F.col("af")) >= least)


def flip_to(reference: DataFrame, dosage: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """Features turned to 2 - x where that agrees better with the reference."""
    r = reference.select(entity, feature, F.col(value).alias("__r"))
    j = dosage.join(r, [entity, feature])
    flag = j.groupBy(feature).agg((F.count_if(2 - F.col(value) == F.col("__r")) > F.count_if(F.col(value) == F.col("__r"))).alias("flip"))
    return dosage.join(F.broadcast(flag), feature, "left").withColumn(value, F.when(F.col("flip"), 2 - F.col(value)).otherwise(F.col(value)))


def hybrid_dosage(pairs: DataFrame, dosage: DataFrame, a: str, b: str, entity: str, feature: str, value: str) -> DataFrame:
    """Half the sum of two parents' dosages, rounded half to even; null if either is missing."""
    da = dosage.select(F.col(entity).alias(a), feature, F.col(value).alias("__a"))
    db = dosage.select(F.col(entity).alias(b), feature, F.col(value).alias("__b"))
    return pairs.join(da, a).join(db, [b, feature]).withColumn(value, F.bround((F.col("__a") + F.col("__b")) / 2).cast("int")).drop("__a", "__b")
