"""Splits, masks and sampling. Random order is md5 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*key) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key)))


def balanced_groups(df: DataFrame, key: str, k: int, seed: str, within: list[str] | None = None) -> DataFrame:
    """Distinct keys dealt to k groups of equal size, in hash order."""
    within = within or []
    keys = df.select(*within, key).distinct()
    w = Window.partitionBy(*within).orderBy(hash_order(seed, F.col(key)), key)
    return keys.withColumn("fold", (F.row_number().over(w) - 1) % k)


def grouped_folds(cells: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """K folds by key: test is the fold's own group, validation the next one, the rest trains."""
    dealt = balanced_groups(cells, key, k, seed).withColumnRenamed("fold", "part")
    d = cells.join(dealt, key).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("part") == F.col("fold"), "test").when(F.col("part") == (F.col("fold") + 1) % k, "val").otherwise("train")
    return d.withColumn("role", role).drop("part")


def two_way_folds(cells: DataFrame, a: str, b: str, k: int, seed: str) -> DataFrame:
    """S3: both keys unseen in test: cells that share one key with the test side are dropped."""
    pa = balanced_groups(cells, a, k, seed + "a").withColumnRenamed("fold", "__a")
    pb = balanced_groups(cells, b, k, seed + "b").withColumnRenamed("fold", "__b")
    d = cells.join(pa, a).join(pb, b).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ta, tb = F.col("__a") == F.col("fold"), F.col("__b") == F.col("fold")
    va, vb = F.col("__a") == (F.col("fold") + 1) % k, F.col("__b") == (F.col("fold") + 1) % k
    role = F.when(ta & tb, "test").when(va & vb, "val").when(ta | tb | va | vb, "drop").otherwise("train")
    return d.withColumn("role", role).drop("__a", "__b")


def forward_splits(cells: DataFrame, scenarios: DataFrame, period: str) -> DataFrame:
    """Roles by period for each scenario (scenario, train_end, val_period, refit_end, test_period)."""
    p = F.col(period)
    role = F.when(p <= F.col("train_end"), "train").when(p == F.col("val_period"), "val").when(p == F.col("test_period"), "test").when(p <= F.col("refit_end"), "refit_extra").otherwise("drop")
    return cells.crossJoin(F.broadcast(scenarios)).withColumn("role", role).drop("train_end", "val_period", "refit_end", "test_period")


def fit_rows(cells: DataFrame, split: DataFrame, on: list[str], fold: int, roles: tuple[str, ...]) -> DataFrame:
    """The rows of a fold that have one of the roles."""
    return cells.join(split.filter((F.col("fold") == fold) & F.col("role").isin(*roles)).select(*on), on, "left_semi")


def history_folds(hist: DataFrame, entity: str, target: str, k: int, seed: str) -> DataFrame:
    """Leave-entities-out folds of each target's history."""
    return hist.join(balanced_groups(hist, entity, k, seed, [target]), [target, entity])


def stratified_folds(cells: DataFrame, group: str, entity: str, k: int, seed: str) -> DataFrame:
    """Fold numbers that are balanced inside each group."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, F.col(group), F.col(entity)), entity)
    return cells.withColumn("fold", (F.row_number().over(w) - 1) % k)


def sparse_mask(cells: DataFrame, group: str, entity: str, share: float, seed: str) -> DataFrame:
    """For each entity about ``share`` of its groups observed: at least one, at most all but one (all of one).

    The entity's groups stand in a hashed ring; it observes its quota from a start that moves on from entity to entity
    by hash rank, which balances the groups without filling them one after the other.
    """
    own = Window.partitionBy(entity)
    order = hash_order(seed, F.col(group))
    d = cells.withColumns({"__n": F.count(F.lit(1)).over(own), "__p": F.row_number().over(own.orderBy(order, group)) - 1})
    quota = F.when(F.col("__n") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.floor(share * F.col("__n") + 0.5).cast("int"), F.col("__n").cast("int") - 1)))
    start = F.conv(F.substring(hash_order(seed + "s", F.col(entity)), 1, 8), 16, 10).cast("long") % F.col("__n")
    return d.withColumn("observed", F.pmod(F.col("__p") - start, F.col("__n")) < quota).drop("__n", "__p")


def leave_out_folds(cells: DataFrame, key: str) -> DataFrame:
    """A fold for each value of a key: its rows test, all others train. Keys are few: periods or locations."""
    folds = cells.select(F.col(key).alias("left_out")).distinct()
    return cells.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(key) == F.col("left_out"), "test").otherwise("train"))


def split_summary(split: DataFrame, by: list[str], entity: str) -> DataFrame:
    """Rows and entities by role."""
    return split.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("entities"))


def hash_sample(df: DataFrame, key: str, share: float, seed: str, always: DataFrame | None = None) -> DataFrame:
    """Rows of about a share of the keys, by hash, and of all keys in ``always``."""
    h = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    chosen = h < int(share * 4294967296)
    if always is None:
        return df.filter(chosen)
    must = always.select(F.col(key)).distinct().withColumn("__must", F.lit(True))
    return df.join(must, key, "left").filter(chosen | F.col("__must").isNotNull()).drop("__must")
