"""Queries of the linear models on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import metrics, models
from harrow.plans.declare import query
from harrow.plans.queries_core import corr_sql
from harrow.plans.testbed import r6

CENTRED_PRED = """pc AS (SELECT *, value - avg(value) OVER w AS y, score_a - avg(score_a) OVER w AS a, score_b - avg(score_b) OVER w AS b FROM pred WINDOW w AS (PARTITION BY group_id)),
ne AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*) AS n, count(DISTINCT group_id) AS g FROM pc WHERE period < 1999)"""


@query("j1_ridge_path", f"""WITH {CENTRED_PRED}, l AS (SELECT unnest([0.0, 0.1, 1.0])::DOUBLE AS setting),
co AS (SELECT setting, ((bb + setting * (aa + bb) / 2) * ay - ab * by_) / det AS ca, ((aa + setting * (aa + bb) / 2) * by_ - ab * ay) / det AS cb FROM (SELECT *, (aa + setting * (aa + bb) / 2) * (bb + setting * (aa + bb) / 2) - ab * ab AS det FROM ne, l))
SELECT setting, group_id, entity, round(ca * score_a + cb * score_b, 5) AS score FROM pred, co WHERE period = 1999""")
def _(t):
    path = models.ridge_path(t.pred.filter("period < 1999"), "group_id", ["score_a", "score_b"], "value", (0.0, 0.1, 1.0))
    d = models.predict_path(t.pred.filter("period = 1999"), path, ["score_a", "score_b"])
    return d.select("setting", "group_id", "entity", F.round("score", 5).alias("score"))


@query("j1_m11_penalty_choice", f"""WITH {CENTRED_PRED}, l AS (SELECT unnest([0.0, 0.1, 1.0])::DOUBLE AS setting),
co AS (SELECT setting, ((bb + setting * (aa + bb) / 2) * ay - ab * by_) / det AS ca, ((aa + setting * (aa + bb) / 2) * by_ - ab * ay) / det AS cb FROM (SELECT *, (aa + setting * (aa + bb) / 2) * (bb + setting * (aa + bb) / 2) - ab * ab AS det FROM ne, l)),
p AS (SELECT setting, group_id, value, ca * score_a + cb * score_b AS s FROM pred, co WHERE period = 1999), g AS (SELECT setting, group_id, {corr_sql('value', 's')} AS r FROM p GROUP BY ALL) SELECT setting, round(avg(r), 5) AS r, count(r) AS n_groups FROM g GROUP BY setting""")
def _(t):
    path = models.ridge_path(t.pred.filter("period < 1999"), "group_id", ["score_a", "score_b"], "value", (0.0, 0.1, 1.0))
    d = models.predict_path(t.pred.filter("period = 1999"), path, ["score_a", "score_b"]).groupBy("setting", "group_id").agg(metrics.pearson("value", "score").alias("r"))
    return metrics.mean_metric(d, ["setting"], "r").withColumn("r", F.round("r", 5))


@query("j2_reml_grid", f"""WITH {CENTRED_PRED}, e AS (SELECT yy, n - g AS df, unnest([(aa + bb + sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2, (aa + bb - sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2]) AS d, aa, ab, bb, ay, by_ FROM ne),
v AS (SELECT yy, df, greatest(d, 0) AS d, power((ab * ay + (d - aa) * by_), 2) / (ab * ab + (d - aa) * (d - aa)) AS c2 FROM e), gr AS (SELECT unnest([0.00001, 0.0001, 0.001, 0.01])::DOUBLE AS delta),
s AS (SELECT delta, any_value(yy) AS yy, any_value(df) AS df, sum(ln(1 + delta * d)) AS logs, sum(delta * c2 / (1 + delta * d)) AS fit FROM v, gr GROUP BY delta)
SELECT delta, round(-0.5 * (df * ln((yy - fit) / df) + logs), 3) AS loglik, round((yy - fit) / df, 5) AS sigma2 FROM s""")
def _(t):
    spec, yy, degrees = models.spectrum(t.pred.filter("period < 1999"), "group_id", ["score_a", "score_b"], "value")
    g = models.reml_grid(spec, yy, degrees, [1e-5, 1e-4, 1e-3, 1e-2])
    return g.select("delta", F.round("loglik", 3).alias("loglik"), F.round("sigma2", 5).alias("sigma2"))


@query("j3_group_blup", """
WITH p AS (SELECT p_partkey AS entity, p_size::DOUBLE AS f1, (p_retailprice / 100)::DOUBLE AS f2 FROM part), c AS (SELECT value - avg(value) OVER w AS y, f1 - avg(f1) OVER w AS a, f2 - avg(f2) OVER w AS b FROM cells JOIN p USING (entity) WHERE period < 1998 WINDOW w AS (PARTITION BY group_id)),
n AS (SELECT sum(a * a) + 100 AS aa, sum(a * b) AS ab, sum(b * b) + 100 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM c)
SELECT entity, round((bb * ay - ab * by_) / (aa * bb - ab * ab) * f1 + (aa * by_ - ab * ay) / (aa * bb - ab * ab) * f2, 5) AS score FROM p, n""")
def _(t):
    p = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("f1"), (F.col("p_retailprice") / 100).alias("f2"))
    score, _ = models.group_blup(t.cells.filter("period < 1998"), p, "group_id", "entity", "value", ["f1", "f2"], 0.01)
    return score.select("entity", F.round("score", 5).alias("score"))


@query("j4_two_stage", """
WITH p AS (SELECT p_partkey AS entity, p_size::DOUBLE AS f1, (p_retailprice / 100)::DOUBLE AS f2 FROM part), m AS (SELECT entity, avg(value - gm) AS y FROM (SELECT *, avg(value) OVER (PARTITION BY group_id) AS gm FROM cells WHERE period < 1998) GROUP BY entity),
c AS (SELECT y - avg(y) OVER () AS y, f1 - avg(f1) OVER () AS a, f2 - avg(f2) OVER () AS b FROM m JOIN p USING (entity)), n AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM c), q AS (SELECT *, 0.1 * (aa + bb) / 2 AS l FROM n)
SELECT entity, round(((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) * f1 + ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab) * f2, 5) AS score FROM p, q""")
def _(t):
    p = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("f1"), (F.col("p_retailprice") / 100).alias("f2"))
    path = models.two_stage(t.cells.filter("period < 1998"), p, "group_id", "entity", "value", ["f1", "f2"], (0.1,))
    return models.predict_path(p, path, ["f1", "f2"]).select("entity", F.round("score", 5).alias("score"))


@query("j11_group_means", """
WITH g AS (SELECT group_id, avg(quantity) AS q, any_value(period)::DOUBLE AS p FROM plots GROUP BY group_id), o AS (SELECT group_id, avg(value) AS m FROM cells WHERE location % 3 > 0 GROUP BY group_id), k AS (SELECT g.*, m FROM g LEFT JOIN o USING (group_id)),
mm AS (SELECT avg(q) AS mq, avg(p) AS mp, avg(m) AS my FROM k WHERE m IS NOT NULL), n AS (SELECT sum((q - mq) * (q - mq)) AS aa, sum((q - mq) * (p - mp)) AS ab, sum((p - mp) * (p - mp)) AS bb, sum((q - mq) * (m - my)) AS ay, sum((p - mp) * (m - my)) AS by_ FROM k, mm WHERE m IS NOT NULL),
l AS (SELECT *, 0.5 * (aa + bb) / 2 AS l FROM n)
SELECT group_id, round(coalesce(m, my + (q - mq) * ((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) + (p - mp) * ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab)), 5) AS mean, m IS NOT NULL AS observed FROM k, mm, l""")
def _(t):
    g = t.plots.groupBy("group_id").agg(F.avg("quantity").alias("q"), F.first("period").cast("double").alias("p"))
    d = models.group_means_or_ridge(g, t.cells.filter("location % 3 > 0"), "group_id", ["q", "p"], "value", 0.5)
    return d.select("group_id", F.round("mean", 5).alias("mean"), "observed")


@query("j13_residual_weights", """
WITH r AS (SELECT group_id, stddev_samp(d) AS sd FROM (SELECT group_id, value - avg(value) OVER w - (score_a - avg(score_a) OVER w) AS d FROM pred WINDOW w AS (PARTITION BY group_id)) GROUP BY group_id), m AS (SELECT quantile_cont(sd, 0.5) AS med FROM r)
SELECT group_id, round(sd, 6) AS sd, round(1 / power(greatest(0.5, least(2, coalesce(sd / nullif(med, 0), 1))), 2), 6) AS weight FROM r, m""")
def _(t):
    return models.residual_weights(t.pred, "group_id", "value", "score_a").select("group_id", r6("sd").alias("sd"), r6("weight").alias("weight"))


@query("j14_active_locations", "SELECT location, count(DISTINCT period) AS periods, count(*) AS cells FROM cells GROUP BY location HAVING count(DISTINCT period) >= 2 AND count(*) >= 50")
def _(t):
    return models.active_locations(t.cells, "location", "period")



@query("j16_em_one_way", """
WITH RECURSIVE tt AS (SELECT location, entity, count(cv) AS n, sum(cv) AS s, sum(cv * cv) AS q FROM centred GROUP BY ALL),
em(k, u, e) AS (SELECT 0, (SELECT sum(q) / sum(n) / 2 FROM tt), (SELECT sum(q) / sum(n) / 2 FROM tt) UNION ALL
  SELECT any_value(em.k) + 1, avg(power(s / (n + e / u), 2) + e / (n + e / u)), sum(q - 2 * s / (n + e / u) * s + n * (power(s / (n + e / u), 2) + e / (n + e / u))) / sum(n) FROM em, tt WHERE em.k < 20 HAVING count(*) > 0)
SELECT location, entity, n, round(s / (n + e / u), 5) AS effect FROM tt, em WHERE k = 20""")
def _(t):
    d, _, _ = models.em_one_way(t.centred, ["location", "entity"], "cv")
    return d.select("location", "entity", "n", F.round("effect", 5).alias("effect"))


@query("j17_within_group_ols", f"""WITH {CENTRED_PRED}, al AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM pc)
SELECT round((bb * ay - ab * by_) / (aa * bb - ab * ab), 5) AS score_a, round((aa * by_ - ab * ay) / (aa * bb - ab * ab), 5) AS score_b FROM al""")
def _(t):
    w = models.within_group_ols(t.pred, "group_id", "value", ["score_a", "score_b"])
    return t.spark.createDataFrame([(round(w["score_a"], 5), round(w["score_b"], 5))], "score_a double, score_b double")


@query("j18_simple_ols", """
SELECT group_id, round(CASE WHEN var_pop(score_a) > 0 THEN covar_pop(value, score_a) / var_pop(score_a) END, 5) AS slope,
  round(CASE WHEN var_pop(score_a) > 0 THEN avg(value) - covar_pop(value, score_a) / var_pop(score_a) * avg(score_a) END, 5) AS intercept FROM pred GROUP BY group_id""")
def _(t):
    return models.simple_ols(t.pred, ["group_id"], "value", "score_a").select("group_id", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("j19_count_weighted", "SELECT entity, round(avg(value - m), 6) AS value, count(*) AS weight FROM (SELECT *, avg(value) OVER (PARTITION BY group_id) AS m FROM cells) GROUP BY entity")
def _(t):
    return models.count_weighted(t.cells, "entity", "group_id", "value").withColumn("value", r6("value"))


@query("j22_adjusted_means", """
SELECT group_id, entity, round(avg(value - rm + gm), 6) AS adjusted, count(*) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY group_id, rep) AS rm, avg(value) OVER (PARTITION BY group_id) AS gm FROM plots) GROUP BY ALL""")
def _(t):
    return models.adjusted_means(t.plots, "group_id", "entity", "rep", "value").withColumn("adjusted", r6("adjusted"))
