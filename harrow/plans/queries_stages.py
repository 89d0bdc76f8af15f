"""Queries of staged models and nested folds, over whole tables. ``tests/test_stages.py`` holds those without SQL against dense solves and planted effects."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.operators import blocks, metrics, stages
from harrow.operators.staging import stage_dir, staged
from harrow.plans.declare import query
from harrow.plans.queries_blocks import FEATURES, TARGET, markers, trials
from harrow.plans.queries_core import corr_sql

RELATIVE = (0.001, 0.01, 0.1, 1.0, 10.0)
COLUMNS = [f"f{i}" for i in range(FEATURES)]


def wide_cells(t, cells=None):
    """Trial cells up to the target year (or ``cells``) with features as array and as columns, centred values and an inner fold by place."""
    d = trials(t).filter(F.col("period") <= TARGET) if cells is None else cells
    d = staged(d.join(markers(t), "entity").filter(F.size("x") == FEATURES), "stage-cells")
    mean = staged(d.groupBy("group_id").agg(F.avg("value").alias("__mean")), "stage-means")
    d = d.join(F.broadcast(mean), "group_id").withColumn("y", F.col("value") - F.col("__mean")).drop("__mean")
    return d.select("*", (F.col("place") % 3).cast("int").alias("fold"), *(F.coalesce(F.col("x")[i], F.lit(0.0)).alias(c) for i, c in enumerate(COLUMNS)))


@query("j20_residual_boosting")
def _(t):
    d = wide_cells(t)
    out, _ = stages.residual_boosting(d.filter(F.col("period") < TARGET), d.filter(F.col("period") == TARGET), "fold", "group_id", "y", "x", COLUMNS, RELATIVE, rounds=20, every=5)
    return out.select("group_id", "entity", F.round("stage1", 4).alias("stage1"), F.round("score", 4).alias("score"))


@query("j26_reaction_norm_variants")
def _(t):
    """Features times a group covariate: none, the true one of each group, one shuffled over groups, and one of the places' past."""
    d = wide_cells(t).select("group_id", "place", "period", "entity", "y", "x")
    quantity = t.table("lineitem").join(t.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("place"), F.year("l_shipdate").alias("period")).agg(F.avg("l_quantity").alias("q"))
    quantity = staged(quantity.filter(F.col("period") <= TARGET), "variants-covariate")
    past = quantity.filter(F.col("period") < TARGET).groupBy("place").agg(F.avg("q").alias("p"))
    mixed = quantity.select("place", "period", F.first("q").over(Window.partitionBy("period").orderBy(F.md5(F.concat_ws("|", F.lit("j26"), "place", "period"))).rowsBetween(-1, -1)).alias("s"))
    cov = quantity.join(past, "place", "left").join(mixed, ["place", "period"]).withColumns({"s": F.coalesce("s", "q"), "p": F.coalesce("p", "q")})
    cov = staged(cov, "variants-by-group")
    factors = F.array(*(F.struct(F.lit(n).alias("variant"), f.alias("f")) for n, f in (("base", F.lit(0.0)), ("true", F.col("q") - 25.0), ("shuffled", F.col("s") - 25.0), ("past", F.col("p") - 25.0))))
    each = cov.select("place", "period", F.explode(factors).alias("v")).select("place", "period", "v.*")
    m = stages.moments(d, ["group_id", "place", "period"], "x", "y").join(F.broadcast(each), ["place", "period"])  # a row a group and variant
    m = staged(stages.scaled_moments(m, ["variant", "group_id", "period"], "f"), "variants-raw")
    long = d.join(F.broadcast(each), ["place", "period"]).select("variant", "group_id", "period", "entity", "y", F.concat("x", F.transform("x", lambda v: v * F.col("f"))).alias("z"))
    out, best = stages.forward_variants(long, "variant", "group_id", "period", "y", "z", TARGET, RELATIVE, m)
    return out.join(best, "variant").select("variant", "group_id", "entity", "penalty", F.round("validation", 5).alias("validation"), F.round("score", 4).alias("score"))


@query("j27_penalty_on_validation")
def _(t):
    d = wide_cells(t).select("group_id", "period", "entity", "y", "x", F.lit("one").alias("variant"))
    out, best = stages.forward_variants(d, "variant", "group_id", "period", "y", "x", TARGET, RELATIVE)
    return out.join(best, "variant").select("group_id", "entity", "penalty", F.round("score", 4).alias("score"))


@query("j28_boosting_with_lags")
def _(t):
    past = staged(trials(t).filter(F.col("period").between(TARGET - 4, TARGET - 1)), "lag-trials")  # the two years to fit and score, and those their lags are of
    d, lags = stages.with_lags(wide_cells(t, past.filter(F.col("period") >= TARGET - 2)), past, "place", "period", "value")
    columns = [*COLUMNS, *lags]

    def boosting(train, test):
        return stages.averaged_boosting(train, test, columns, "y", (1, 2), rounds=15, out="score", keys=["group_id", "entity"])

    def ridge(train, test):
        a, b, yy, degrees = blocks.total(blocks.centred_moments(blocks.moments(train, ["group_id"], "x", "y"), ["group_id"]))
        return test.withColumn("score", blocks.dot(F.col("x"), blocks.dense_reml(a, b, yy, degrees)["coef"]))

    d = d.withColumn("part", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("j28"), "entity")), 1, 4), 16, 10).cast("int") % 2)
    out = stages.on_identical_folds(d, "part", (0, 1), {"boosting": boosting, "ridge": ridge})
    return out.select("method", "part", "group_id", "entity", F.round("score", 4).alias("score"))


@query("k25_external_folds")
def _(t):
    d = wide_cells(t)
    folds = [(f"EXT_{y}", F.col("period") < y, F.col("period") == y) for y in (TARGET - 1, TARGET)]

    def run(train, test):
        long = train.unionByName(test).withColumn("variant", F.lit("ridge"))
        target = test.agg(F.max("period")).first()[0]
        return stages.forward_variants(long, "variant", "group_id", "period", "y", "x", target, RELATIVE)[0].select("group_id", "entity", "y", "score")

    out = stages.external_folds(d, folds, run, f"{stage_dir(t.spark)}/external-{uuid.uuid4().hex}")
    return out.select("fold", "group_id", "entity", F.round("y", 4).alias("y"), F.round("score", 4).alias("score"))


K26_SETTINGS = "SELECT period, location, group_id, value, 1 AS setting, score_a AS s FROM pred UNION ALL SELECT period, location, group_id, value, 2, score_a + score_b FROM pred UNION ALL SELECT period, location, group_id, value, 3, score_b FROM pred"


@query("k26_selected_per_group", f"""WITH u AS ({K26_SETTINGS}), g AS (SELECT period, group_id, any_value(location) AS location, setting, round({corr_sql('value', 's')}, 6) AS r FROM u GROUP BY period, group_id, setting),
cu AS (SELECT f.fold, g.location % 2 AS inner_fold, setting, round(avg(r), 9) AS r FROM g JOIN (SELECT unnest([1998, 1999])::INT AS fold) f ON g.period < f.fold GROUP BY ALL), au AS (SELECT period AS fold, group_id, setting, r FROM g WHERE period IN (1998, 1999)),
c AS (SELECT 'P1' AS protocol, fold, setting, r AS c FROM cu WHERE inner_fold = 1 UNION ALL SELECT 'P2', fold, setting, round(avg(r), 9) FROM au GROUP BY fold, setting UNION ALL SELECT 'P3', fold, setting, round(avg(r), 9) FROM cu GROUP BY fold, setting),
b AS (SELECT protocol, fold, setting FROM (SELECT *, row_number() OVER (PARTITION BY protocol, fold ORDER BY c DESC, setting) AS k FROM c WHERE c IS NOT NULL) WHERE k = 1) SELECT fold, protocol, setting, group_id, r FROM b JOIN au USING (fold, setting)""")
def _(t):
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("setting"), s.alias("s")) for i, s in enumerate((F.col("score_a"), F.col("score_a") + F.col("score_b"), F.col("score_b")), 1))))
    g = t.pred.select("period", "location", "group_id", "value", each.alias("x")).select("period", "location", "group_id", "value", "x.*")
    g = staged(g.groupBy("period", "location", "group_id", "setting").agg(F.round(metrics.pearson("value", "s"), 6).alias("r")), "selected")
    folds = t.spark.createDataFrame([(1998, 1), (1999, 1)], "fold int, inner int")
    model = F.lit("mix").alias("model")
    curve = g.join(F.broadcast(folds.select("fold")), F.col("period") < F.col("fold")).groupBy("fold", (F.col("location") % 2).cast("int").alias("inner"), "setting").agg(F.round(F.avg("r"), 9).alias("r")).select("*", model)
    audit = g.filter("period in (1998, 1999)").select(F.col("period").alias("fold"), "group_id", "setting", "r", model)
    return stages.selected_per_group(curve, audit, "fold", "model", "inner", "setting", "group_id", "r", folds).drop("model")
