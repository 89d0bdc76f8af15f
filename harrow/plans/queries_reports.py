"""Queries of reports, audits and kernel models on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import ensemble, metrics, models, nearest, windows
from harrow.plans import reports
from harrow.plans.declare import query
from harrow.plans.queries_core import RANKED, corr_sql
from harrow.plans.queries_more import B, DIFFS_SQL, boot_sql, diffs, dosage_arrays, md5_sql
from harrow.plans.testbed import r6


@query("i8_group_mean_correlation", f"""WITH g AS (SELECT 'all' AS s, group_id, round(avg(value), 6) AS v, round(avg(score_a), 6) AS a, round(avg(score_b), 6) AS b FROM pred GROUP BY group_id),
n AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS n FROM g), d AS (SELECT rep, {md5_sql("'i8'", "'all'", 'rep', 'i')} % n AS i FROM n, unnest(range({B})) AS q(rep)),
r AS (SELECT rep, {corr_sql('v', 'a')} - {corr_sql('v', 'b')} AS d FROM d JOIN n USING (i) GROUP BY rep) SELECT round(avg(d), 5) AS mean, round(stddev_samp(d), 5) AS se, round((1 + count(*) FILTER (d <= 0)) / {B + 1}.0::DOUBLE, 6) AS p_one_sided FROM r""")
def _(t):
    g = t.pred.groupBy("group_id").agg(*(r6(F.avg(c)).alias(n) for c, n in (("value", "v"), ("score_a", "a"), ("score_b", "b"))))
    d = reports.group_mean_correlation(g, "group_id", "v", "a", "b", B, "i8")
    return d.select(F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"), r6("p_one_sided").alias("p_one_sided"))


@query("k12_shared_draws", f"""WITH {RANKED}, pg AS (SELECT period, group_id, {corr_sql('rv', 'rs')} AS a, {corr_sql('rv', 'rb')} AS b FROM r GROUP BY ALL), x AS (SELECT period, group_id, round(a - b, 6) AS c1, round(a, 6) AS c2 FROM pg WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM x), d AS (SELECT period, rep, {md5_sql("'k12'", 'period', 'rep', 'i')} % n AS i FROM n, unnest(range({B})) AS q(rep)),
m AS (SELECT period, rep, avg(c1) AS m1, avg(c2) AS m2 FROM d JOIN n USING (period, i) GROUP BY ALL) SELECT period, round(stddev_samp(m1), 6) AS se_c1, round(stddev_samp(m2), 6) AS se_c2, round({corr_sql('m1', 'm2')}, 5) AS r FROM m GROUP BY period""")
def _(t):
    a = metrics.spearman(t.pred, ["period", "group_id"], "entity", "value", "score_a").select("period", "group_id", F.col("spearman").alias("a"))
    b = metrics.spearman(t.pred, ["period", "group_id"], "entity", "value", "score_b").select("period", "group_id", F.col("spearman").alias("b"))
    x = a.join(b, ["period", "group_id"]).filter("a is not null and b is not null").select("period", "group_id", r6(F.col("a") - F.col("b")).alias("c1"), r6("a").alias("c2"))
    d = reports.shared_draws(x, "period", "group_id", ["c1", "c2"], B, "k12")
    return d.select("period", r6("se_c1").alias("se_c1"), r6("se_c2").alias("se_c2"), F.round("r_c1_c2", 5).alias("r"))


@query("k21_scope_report", f"""WITH sc AS (SELECT *, 'all' AS scope FROM pred UNION ALL SELECT *, 'old' FROM pred WHERE NOT is_new),
k AS (SELECT scope, period, group_id, rank() OVER (PARTITION BY scope, group_id ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY scope, group_id, round(value, 9)) - 1) / 2.0::DOUBLE AS rv,
  rank() OVER (PARTITION BY scope, group_id ORDER BY round(score_a, 9)) + (count(*) OVER (PARTITION BY scope, group_id, round(score_a, 9)) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY scope, group_id ORDER BY round(score_b, 9)) + (count(*) OVER (PARTITION BY scope, group_id, round(score_b, 9)) - 1) / 2.0::DOUBLE AS rb FROM sc),
d AS (SELECT scope, period, group_id, {corr_sql('rv', 'ra')} - {corr_sql('rv', 'rb')} AS diff FROM k GROUP BY ALL HAVING count(*) >= 10), n AS (SELECT *, row_number() OVER (PARTITION BY scope, period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY scope, period) AS n FROM d WHERE diff IS NOT NULL),
b AS (SELECT scope, period, rep, {md5_sql("'k21'", 'scope', 'period', 'rep', 'i')} % n AS i FROM n, unnest(range({B})) AS q(rep)), m AS (SELECT scope, period, rep, avg(diff) AS m FROM b JOIN n USING (scope, period, i) GROUP BY ALL),
se AS (SELECT scope, period, coalesce(stddev_samp(m), 0) AS se FROM m GROUP BY ALL), ye AS (SELECT scope, period, avg(diff) AS d, any_value(se) AS se FROM n JOIN se USING (scope, period) GROUP BY ALL),
po AS (SELECT scope, quantile_cont(se, 0.5) FILTER (se > 1e-12) AS med FROM ye GROUP BY scope), al AS (SELECT quantile_cont(se, 0.5) FILTER (se > 1e-12) AS allmed FROM ye), fl AS (SELECT scope, d, greatest(se, coalesce(med, allmed)) AS se FROM ye JOIN po USING (scope), al),
xw AS (SELECT *, 1 / (se * se) AS w FROM fl WHERE se > 0), mu AS (SELECT scope, sum(w * d) / sum(w) AS mu FROM xw GROUP BY scope), qq AS (SELECT scope, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * (d - mu) * (d - mu)) AS q FROM xw JOIN mu USING (scope) GROUP BY scope),
t2 AS (SELECT scope, CASE WHEN k > 1 THEN greatest(0, coalesce((q - (k - 1)) / nullif(sw - sww / sw, 0), 0)) ELSE 0 END AS tau2 FROM qq)
SELECT scope, count(*) AS k, round(sum(d / (se * se + tau2)) / sum(1 / (se * se + tau2)), 6) AS est, round(sqrt(1 / sum(1 / (se * se + tau2))), 6) AS pooled_se FROM xw JOIN t2 USING (scope) GROUP BY scope""")
def _(t):
    p = t.pred.withColumn("scope", F.explode(F.when(F.col("is_new"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("old")))))
    d = reports.scope_report(p, "scope", "period", "group_id", "entity", "value", "score_a", "score_b", 10, B, "k21")
    return d.select("scope", "k", r6("est").alias("est"), r6("pooled_se").alias("pooled_se"))


@query("k22_search_audit", f"""
WITH s AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY day) AS k, v_max FROM daily), y AS (SELECT group_id, avg(v_min) AS y FROM daily GROUP BY group_id), g AS (SELECT * FROM (VALUES (1, 3), (1, 6), (5, 3), (5, 6), (9, 3), (9, 6)) AS v(start, length)),
c AS (SELECT group_id < 10 AS inside, start, length, s.group_id, avg(v_max) AS x, any_value(y) AS y FROM g JOIN s ON k BETWEEN start AND start + length - 1 JOIN y USING (group_id) GROUP BY ALL HAVING count(*) = length),
r AS (SELECT inside, start, length, abs({corr_sql('x', 'y')}) AS r FROM c GROUP BY ALL), j AS (SELECT a.start, a.length, a.r AS train_r, b.r AS test_r FROM r a JOIN r b USING (start, length) WHERE a.inside AND NOT b.inside)
SELECT count(*) AS windows, round((SELECT test_r FROM j ORDER BY train_r DESC, start, length LIMIT 1), 5) AS nested_r, round((SELECT test_r FROM j ORDER BY test_r DESC, start, length LIMIT 1), 5) AS leaky_r FROM j""")
def _(t):
    s = t.daily.withColumn("k", F.row_number().over(windows.Window.partitionBy("group_id").orderBy("day")))
    y = t.daily.groupBy("group_id").agg(F.avg("v_min").alias("y"))
    d = reports.search_audit(s, y, F.col("group_id") < 10, "group_id", "k", "v_max", "y", [1, 5, 9], [3, 6])
    return d.select("windows", F.round("nested_r", 5).alias("nested_r"), F.round("leaky_r", 5).alias("leaky_r"))


@query("k24_derived_numbers", """
SELECT 'cells' AS key, count(*)::DOUBLE AS computed FROM cells UNION ALL SELECT 'difference', round((SELECT avg(value) FROM cells WHERE period = 1999) - (SELECT avg(value) FROM cells WHERE period = 1998), 6) UNION ALL
SELECT 'positive', (SELECT count(*) FROM (SELECT group_id FROM pred GROUP BY group_id HAVING avg(score_a) > 0))::DOUBLE""")
def _(t):
    n = t.cells.agg(F.count(F.lit(1)).cast("double").alias("computed")).select(F.lit("cells").alias("key"), "computed")
    d = t.cells.agg((F.avg(F.when(F.col("period") == 1999, F.col("value"))) - F.avg(F.when(F.col("period") == 1998, F.col("value")))).alias("computed")).select(F.lit("difference").alias("key"), r6("computed").alias("computed"))
    p = t.pred.groupBy("group_id").agg(F.avg("score_a").alias("a")).agg(F.count_if(F.col("a") > 0).cast("double").alias("computed")).select(F.lit("positive").alias("key"), "computed")
    return n.unionByName(d).unionByName(p)


@query("k13_year_features", f"""WITH {DIFFS_SQL}, y AS (SELECT period, avg(diff) AS d FROM df GROUP BY period), f AS (SELECT period, count(DISTINCT group_id)::DOUBLE AS n_groups, avg(value) AS level FROM cells GROUP BY period)
SELECT round({corr_sql('d', 'n_groups')}, 4) AS r_groups, round({corr_sql('d', 'level')}, 4) AS r_level, count(*) AS periods FROM y JOIN f USING (period)""")
def _(t):
    y = diffs(t).groupBy("period").agg(F.avg("diff").alias("d"))
    f = t.cells.groupBy("period").agg(F.countDistinct("group_id").cast("double").alias("n_groups"), F.avg("value").alias("level"))
    return y.join(f, "period").agg(F.round(metrics.pearson("d", "n_groups"), 4).alias("r_groups"), F.round(metrics.pearson("d", "level"), 4).alias("r_level"), F.count(F.lit(1)).alias("periods"))


@query("j23_pooled_main_effect", """
WITH p AS (SELECT p_partkey AS entity, p_size::DOUBLE AS f1 FROM part), m AS (SELECT entity, avg(value - gm) AS y FROM (SELECT *, avg(value) OVER (PARTITION BY group_id) AS gm FROM cells) GROUP BY entity),
c AS (SELECT y - avg(y) OVER () AS y, f1 - avg(f1) OVER () AS a FROM m JOIN p USING (entity)), n AS (SELECT sum(a * y) / (sum(a * a) * 1.5) AS b FROM c) SELECT entity, round(b * f1, 5) AS score FROM p, n""")
def _(t):
    p = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("f1"))
    path = models.two_stage(t.cells, p, "group_id", "entity", "value", ["f1"], (0.5,))
    return models.predict_path(p, path, ["f1"]).select("entity", F.round("score", 5).alias("score"))


@query("j25_secondary_trait", """
WITH p AS (SELECT p_partkey AS entity, p_size::DOUBLE AS f1 FROM part), s AS (SELECT group_id, entity, avg(quantity) AS v FROM plots WHERE period < 1998 GROUP BY ALL), c AS (SELECT v - avg(v) OVER w AS y, f1 - avg(f1) OVER w AS a FROM s JOIN p USING (entity) WINDOW w AS (PARTITION BY group_id)),
n AS (SELECT sum(a * y) / (sum(a * a) + 50) AS b FROM c) SELECT entity, round(b * f1, 5) AS score FROM p, n""")
def _(t):
    p = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("f1"))
    s = t.plots.filter("period < 1998").groupBy("group_id", "entity").agg(F.avg("quantity").alias("v"))
    score, _ = models.group_blup(s, p, "group_id", "entity", "v", ["f1"], 0.02)
    return score.select("entity", F.round("score", 5).alias("score"))


@query("j24_kernel_scores", """
WITH v AS MATERIALIZED (SELECT entity, list((dosage - 1)::DOUBLE ORDER BY feature) AS x FROM feats GROUP BY entity), y AS (SELECT entity, avg(cv) AS y FROM centred GROUP BY entity),
g AS (SELECT a.entity, list_dot_product(a.x, b.x) / 64 AS k, y.y FROM v a, v b JOIN y ON y.entity = b.entity WHERE a.entity % 100 = 0) SELECT entity, round(sum(k * y) / (sum(abs(k)) + 1e-9), 5) AS score FROM g GROUP BY entity""")
def _(t):
    x = dosage_arrays(t).withColumn("x", F.transform("x", lambda v: v - 1))
    g = nearest.inner_products(x, x.filter("entity % 100 = 0"), "entity", "x").withColumn("k", F.col("k") / 64)
    y = t.centred.groupBy("entity").agg(F.avg("cv").alias("y"))
    return reports.kernel_average(g, y, "entity", "y").withColumn("score", F.round("score", 5))


@query("f14_window_contrasts", """
WITH d AS (SELECT *, sum(n) OVER (PARTITION BY group_id ORDER BY day) AS cum, sum(n) OVER (PARTITION BY group_id ORDER BY day) - n AS prev FROM daily), m AS (SELECT group_id, avg(v_max) AS own FROM d WHERE cum > 20 AND prev < 80 GROUP BY group_id), g AS (SELECT avg(v_max) AS al FROM d WHERE cum > 20 AND prev < 80)
SELECT group_id, round(own - al, 5) AS delta FROM m, g""")
def _(t):
    d = t.daily.withColumn("cum", F.sum("n").over(windows.Window.partitionBy("group_id").orderBy("day")).cast("double"))
    few = t.spark.createDataFrame([("w", 20, 80)], "window string, lo int, hi int")
    return reports.window_contrasts(d, few, "group_id", "day", "cum", "v_max").select("group_id", F.round("delta", 5).alias("delta"))


@query("f17_maturity_target", "SELECT entity, round(avg(cum), 5) AS target, count(*) AS n FROM (SELECT c.entity, c.group_id, sum(c.value) OVER (PARTITION BY c.location, c.entity ORDER BY c.period) AS cum FROM cells c) GROUP BY entity")
def _(t):
    c = t.cells.withColumn("cum", F.sum("value").over(windows.Window.partitionBy("location", "entity").orderBy("period")))
    return ensemble.seed_average(c, ["entity"], "cum").select("entity", F.round("cum", 5).alias("target"), F.col("n_seeds").alias("n"))


@query("k7_year_effects", f"""WITH {DIFFS_SQL}, du AS (SELECT 'set' AS dataset, period, group_id, diff FROM df), {boot_sql('du', 'dataset, period', 'group_id', 'diff', 'k7')},
s AS (SELECT dataset, period, coalesce(stddev_samp(m), 0) AS se FROM bm GROUP BY ALL), d AS (SELECT dataset, period, avg(diff) AS d, count(*) AS n_env FROM du GROUP BY ALL), p AS (SELECT quantile_cont(se, 0.5) FILTER (se > 1e-12) AS med FROM s)
SELECT dataset, period, round(d, 6) AS d, n_env, round(greatest(se, med), 6) AS se, se <= 1e-12 AS se_zero FROM d JOIN s USING (dataset, period), p""")
def _(t):
    d = ensemble.year_effects(diffs(t).withColumn("dataset", F.lit("set")), "dataset", "period", "group_id")
    return d.select("dataset", "period", r6("d").alias("d"), "n_env", r6("se").alias("se"), "se_zero")


@query("o1_sorted_output", "SELECT location, row_number() OVER (PARTITION BY location ORDER BY period, group_id, entity) AS place, group_id, entity FROM cells")
def _(t):
    order = windows.Window.partitionBy("location").orderBy("period", "group_id", "entity")
    return t.cells.select("location", F.row_number().over(order).cast("long").alias("place"), "group_id", "entity").orderBy("location", "place")
