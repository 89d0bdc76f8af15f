"""Queries of block, interaction, kernel and neighbour models, over whole tables.

Those without SQL need an iterative or spectral solve; ``tests/test_blocks.py`` and ``tests/test_wide.py`` hold them against dense solves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import blocks, kernels, nearest
from harrow.operators.staging import staged
from harrow.plans.declare import query
from harrow.plans.testbed import r6

#: Features of a part: six base-3 digits of its number as dosages, its size, its brand's number.
FEATURES = 8
TARGET = 1999
C2 = (0.0, 0.1, 0.3, 0.5, 1.0, 2.0)


def markers(t) -> DataFrame:
    """(entity, x): features of every part."""
    key = F.col("p_partkey")
    digits = [(F.floor(key / 3**i) % 3).cast("double") for i in range(6)]
    return t.table("part").select(key.alias("entity"), F.array(*digits, F.col("p_size") / 25.0, F.regexp_extract("p_brand", r"(\d+)", 1).cast("double") / 10.0).alias("x"))


def trials(t) -> DataFrame:
    """(group_id, place, period, entity, value): mean root price of every part by nation and year; nothing is left out.

    Prices hold no effect of a part's features, so one is added: of two dosages everywhere, of one by place, and a product.
    """
    place = t.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("place"))
    d = t.table("lineitem").join(place, "l_suppkey").select("place", F.year("l_shipdate").alias("period"), F.col("l_partkey").alias("entity"), (F.sqrt(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10).alias("value"))
    digit = lambda i: F.floor(F.col("entity") / 3**i) % 3
    effect = 1.5 * digit(0) - digit(1) + 2.0 * digit(2) * (F.col("place") % 3 - 1) + 1.2 * (digit(3) - 1) * (digit(4) - 1)
    d = d.groupBy("place", "period", "entity").agg(F.avg("value").alias("value")).withColumn("value", F.col("value") + effect)
    return d.withColumn("group_id", F.concat_ws("_", "place", "period"))


def observed():
    """Half of the target year's cells, by hash: what a sparse trial has seen."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("sparse"), "group_id", "entity")), 1, 4), 16, 10).cast("int") % 2 == 0


def seen_cells(t) -> tuple[DataFrame, DataFrame]:
    """Cells to fit on, with features: all earlier years and the observed half of the target year; and the other half, to be scored."""
    d = staged(trials(t).filter(F.col("period") <= TARGET).join(markers(t), "entity").withColumn("seen", (F.col("period") < TARGET) | observed()), "block-cells")
    return d.filter("seen"), d.filter("not seen")


@query("j15_group_effects")
def _(t):
    fit_on, score = seen_cells(t)
    own = [0, 1, 2, 3]
    groups = staged(blocks.centred_moments(blocks.moments(fit_on, ["group_id", "period"], "x", "value"), ["group_id", "period"]), "block-groups")
    target = groups.filter(F.col("period") == TARGET)  # effects of the target year's groups
    fit = blocks.arrow_fit(groups, target, own, C2)
    effects = staged(blocks.arrow_effects(target, "group_id", own, fit), "block-effects")
    main = blocks.arrow_fit(groups, target, own, [0.0])
    out = blocks.arrow_scores(score, "x", "group_id", own, main, effects.limit(0), "m0")
    out = blocks.arrow_scores(out, "x", "group_id", own, fit, effects, "m1")
    if fit["c2"] > 0:
        entities = fit_on.select("entity", "x").distinct().select(F.lit(0).alias("all"), "x", F.lit(0.0).alias("y"))
        spread = blocks.total(blocks.centred_moments(blocks.moments(entities, ["all"], "x", "y"), ["all"]))[0]
        joint, correlated = blocks.kronecker_fit(fit["parts"], target, "group_id", own, effects, spread[:4, :4], fit["c2"], [0.25, 0.5, 0.75, 1.0])
        out = blocks.arrow_scores(out, "x", "group_id", own, joint, correlated, "m2")
    else:
        out = out.withColumn("m2", F.col("m1"))
    return out.select("group_id", "entity", *(F.round(c, 4).alias(c) for c in ("m0", "m1", "m2")))


@query("j14_location_effects")
def _(t):
    d = staged(trials(t).filter(F.col("period") <= TARGET).join(markers(t), "entity"), "location-cells")
    past = d.filter(F.col("period") < TARGET)
    own = list(range(FEATURES))
    groups = staged(blocks.centred_moments(blocks.moments(past, ["group_id", "place", "period"], "x", "value"), ["group_id", "place", "period"]), "location-groups")
    active = groups.groupBy("place").agg(F.countDistinct("period").alias("periods"), F.sum("n").alias("cells")).filter("periods >= 2 and cells >= 50").select("place")
    places = staged(blocks.sum_arrays(groups.join(active, "place", "left_semi"), ["place"], "c"), "location-blocks")
    fit = blocks.arrow_fit(groups, places, own, C2)
    out = blocks.arrow_scores(d.filter(F.col("period") == TARGET), "x", "place", own, fit, blocks.arrow_effects(places, "place", own, fit), "score")
    return out.select("group_id", "entity", F.round("score", 4).alias("score"))


@query("j8_interaction_ridge")
def _(t):
    d = staged(trials(t).filter(F.col("period") <= TARGET).join(markers(t), "entity"), "interaction-cells")
    covariates = t.table("lineitem").join(t.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat_ws("_", "s_nationkey", F.year("l_shipdate")).alias("group_id")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x"), F.avg("l_discount").alias("d"))
    covariates = staged(covariates.select("group_id", F.array(F.col("q") - 25.0, (F.col("x") - 0.04) * 1000, (F.col("d") - 0.05) * 1000).alias("e")), "interaction-covariates")
    own, ratios, relative = [0, 1, 2, 6], (0.1, 1.0, 10.0, 100.0), (0.001, 0.01, 0.1, 1.0, 10.0)
    groups = staged(blocks.centred_moments(blocks.moments(d.filter(F.col("period") < TARGET), ["group_id", "period"], "x", "value"), ["group_id", "period"]), "interaction-groups")

    def paths(before: int, at: list | None = None) -> dict:
        system = blocks.interaction_system(groups.filter(F.col("period") < before), covariates, "group_id", own, "e")
        found = blocks.interaction_paths(system, FEATURES, ratios, relative)
        return found if at is None else {k: found[k] for k in at}

    inner = paths(TARGET - 1)
    best, _ = blocks.choose_path(blocks.interaction_scores(d.filter(F.col("period") == TARGET - 1), covariates, "group_id", "x", own, "e", inner), "group_id", "value", inner)
    out = blocks.interaction_scores(d.filter(F.col("period") == TARGET), covariates, "group_id", "x", own, "e", paths(TARGET, [best]))
    return out.select("group_id", "entity", F.lit(best[0]).alias("ratio"), F.lit(best[1]).alias("penalty"), F.round(F.col("scores")[0], 4).alias("score"))


@query("j9_backfitted_effects")
def _(t):
    fit_on, score = seen_cells(t)
    main, effects, _ = blocks.backfit(blocks.moments(fit_on, ["group_id"], "x", "value"), "group_id", 0.1, 1.0, tolerance=1e-6)
    out = blocks.arrow_scores(score, "x", "group_id", list(range(FEATURES)), {"main": main}, effects, "score")
    return out.select("group_id", "entity", F.round("score", 4).alias("score"))


@query("j24_kernel_cells")
def _(t):
    d = trials(t)
    scores, _ = kernels.kernel_cell_model(staged(d.filter(F.col("period") < TARGET), "kernel-cells"), markers(t), "group_id", "entity", "value", "x", m=128)
    return scores.select("entity", F.round("score", 4).alias("score"))


F10_SQL = """
SELECT entity, landmark, round(CASE WHEN entity = landmark THEN nt * nl ELSE nt * nl / pi() * (sin(acos(c)) + (pi() - acos(c)) * c) END, 6) AS k FROM (
  SELECT e.vec_id AS entity, l.vec_id AS landmark, sqrt(e.q / s.scale) AS nt, sqrt(l.q / s.scale) AS nl, greatest(-1, least(1, list_dot_product(e.v, l.v) / sqrt(e.q * l.q))) AS c
  FROM e, l, s)"""


@query("f10_kernel_embedding", f"""WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS q FROM embeddings),
s AS (SELECT avg(q) AS scale FROM e), l AS MATERIALIZED (SELECT * FROM e ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 32) {F10_SQL}""")
def _(t):
    e = t.table("embeddings").select(F.col("vec_id").alias("entity"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    marks = kernels.choose_landmarks(e, "entity", "x", 32)
    phi = staged(marks.embed(e, "entity", "x"), "embedding")
    some = phi.join(F.broadcast(e.select("entity").orderBy(F.md5(F.col("entity").cast("string")), "entity").limit(32)), "entity", "left_semi")
    of_marks = some.select(F.col("entity").alias("landmark"), F.col("phi").alias("__l"))
    return phi.crossJoin(F.broadcast(of_marks)).select("entity", "landmark", r6(blocks.dot(F.col("phi"), F.col("__l"))).alias("k"))  # 32 rows


@query("f6_truncated_svd")
def _(t):
    e = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    values, vectors = kernels.truncated_svd(e, "x", 8, over=16, power=8)
    return e.select("vec_id", *(r6(blocks.dot(F.col("x"), v)).alias(f"u{i + 1}") for i, v in enumerate(vectors.T)), *(F.lit(round(float(s), 6)).alias(f"s{i + 1}") for i, s in enumerate(values)))


@query("j6_nearest_neighbours", """
WITH d AS (SELECT q.vec_id AS entity, e.vec_id AS t, e.label::DOUBLE AS y, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS d
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT entity, round(avg(y), 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, t) AS k FROM d) WHERE k <= 10 GROUP BY entity""")
def _(t):
    e = t.table("embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"))
    return nearest.nearest_mean(e, e.filter("entity % 100 = 0"), "entity", "x", "y", 10).withColumn("predicted", r6("predicted"))


@query("f16_mahalanobis")
def _(t):
    e = t.table("embeddings").select("vec_id", F.col("embedding").alias("x"))
    return nearest.mahalanobis(e, e.filter("vec_id % 100 = 0"), "vec_id", "x", 5).withColumn("distance", r6("distance"))
