"""Queries of the window, metric, aggregation and join operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import aggs, joins, metrics, windows
from harrow.plans.declare import query
from harrow.plans.testbed import r6

# Windows


@query("w1_center", "SELECT group_id, entity, round(value - avg(value) OVER (PARTITION BY group_id), 6) AS centred FROM cells")
def _(t):
    return t.cells.select("group_id", "entity", r6(windows.center("value", "group_id")).alias("centred"))


@query("w2_zscore", """
SELECT group_id, entity, CASE WHEN count(*) OVER w >= 20 AND stddev_samp(value) OVER w > 0
  THEN round(greatest(-2, least(2, (value - avg(value) OVER w) / stddev_samp(value) OVER w)), 6) END AS z
FROM cells WINDOW w AS (PARTITION BY group_id)""")
def _(t):
    return t.cells.select("group_id", "entity", r6(windows.zscore("value", "group_id", least=20, clip=2.0)).alias("z"))


@query("w3_midrank", """
SELECT group_id, entity, rep, rank() OVER (PARTITION BY group_id ORDER BY quantity) + (count(*) OVER (PARTITION BY group_id, quantity) - 1) / 2.0::DOUBLE AS midrank
FROM plots""")
def _(t):
    return t.plots.select("group_id", "entity", "rep", windows.midrank("quantity", "group_id").alias("midrank"))


@query("w4_topk", """
SELECT group_id, entity, place FROM (SELECT group_id, entity, row_number() OVER (PARTITION BY group_id ORDER BY round(score_a, 9) DESC, entity) AS place FROM pred) WHERE place <= 5""")
def _(t):
    return t.pred.select("group_id", "entity", windows.top_rank("score_a", "entity", "group_id").alias("place")).filter("place <= 5")


@query("w5_running", """
SELECT group_id, day, round(sum(v_avg) OVER w, 6) AS cum, round(coalesce(sum(v_avg) OVER (PARTITION BY group_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS prev
FROM daily WINDOW w AS (PARTITION BY group_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    return t.daily.select("group_id", "day", r6(windows.running("v_avg", "day", "group_id")).alias("cum"), r6(windows.running("v_avg", "day", "group_id", exclusive=True)).alias("prev"))


@query("w6_kth", """
SELECT g.group_id, g.k, c.cum FROM (SELECT DISTINCT group_id, group_id + 3 AS k FROM daily) g LEFT JOIN (
  SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY day) AS k, round(sum(v_avg) OVER (PARTITION BY group_id ORDER BY day), 6) AS cum FROM daily) c
ON c.group_id = g.group_id AND c.k = g.k""")
def _(t):
    series = t.daily.select("group_id", "day", r6(windows.running("v_avg", "day", "group_id")).alias("cum"))
    wanted = t.daily.select("group_id", (F.col("group_id") + 3).alias("k")).distinct()
    return windows.kth(series, wanted, "k", "cum", "day", "group_id")


@query("w7_fill_gaps", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY day) AS i FROM gaps),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY group_id ORDER BY i) AS ia,
  min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY group_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM n)
SELECT k.group_id, k.day, k.v, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN k.i - k.ia <= 3 THEN a.v + (b.v - a.v) * ((k.i - k.ia)::DOUBLE / (k.ib - k.ia)) END, 6) AS filled
FROM k LEFT JOIN n a ON a.group_id = k.group_id AND a.i = k.ia LEFT JOIN n b ON b.group_id = k.group_id AND b.i = k.ib""", ("v",))
def _(t):
    return windows.fill_gaps(t.gaps, "v", "day", "group_id").withColumn("filled", r6("filled"))


@query("w8_tertile", """
SELECT group_id, entity, CASE WHEN r = 1 THEN 1 ELSE ceil(3 * (r - 1) / (n - 1)::DOUBLE) END::INT AS bucket
FROM (SELECT group_id, entity, row_number() OVER (PARTITION BY group_id ORDER BY value, entity) AS r, count(*) OVER (PARTITION BY group_id) AS n FROM cells)""")
def _(t):
    return t.cells.select("group_id", "entity", windows.tertile("value", "entity", "group_id").alias("bucket"))


@query("w9_count_earlier", """
WITH s AS (SELECT location, period, count(DISTINCT entity) AS n FROM cells GROUP BY ALL)
SELECT location, period, n, coalesce(sum((n >= 30)::INT) OVER (PARTITION BY location ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM s""")
def _(t):
    s = t.cells.groupBy("location", "period").agg(F.countDistinct("entity").alias("n"))
    return s.withColumn("earlier", windows.count_earlier(F.col("n") >= 30, "period", "location"))


@query("w10_lags", """
WITH s AS (SELECT location, period, round(avg(value), 6) AS m FROM cells GROUP BY ALL)
SELECT s.location, s.period, s.m, a.m AS m_lag1, b.m AS m_lag2 FROM s LEFT JOIN s a ON a.location = s.location AND a.period = s.period - 1
LEFT JOIN s b ON b.location = s.location AND b.period = s.period - 2""")
def _(t):
    return windows.lags(t.cells.groupBy("location", "period").agg(r6(F.avg("value")).alias("m")), "m", "period", "location")


@query("w11_shuffled", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY entity) AS rn FROM cells),
b AS (SELECT group_id, value, row_number() OVER (PARTITION BY group_id ORDER BY md5('s1|' || group_id || '|' || entity), entity) AS rn FROM cells)
SELECT a.group_id, a.entity, a.value, b.value AS value_shuffled FROM a JOIN b USING (group_id, rn)""", ("value", "value_shuffled"))
def _(t):
    return windows.shuffled(t.cells, "value", "entity", "group_id", "s1").select("group_id", "entity", "value", "value_shuffled")


@query("w12_null_days", """
WITH f AS (SELECT *, min(CASE WHEN v IS NULL THEN day END) OVER (PARTITION BY group_id) AS first FROM gaps)
SELECT group_id, month(day)::INT AS month, min(first) AS first_missing, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (first IS NULL OR day < first) AS n_cumulative FROM f GROUP BY ALL""")
def _(t):
    return windows.null_days(t.gaps, "v", "day", "group_id")


# Metrics

RANKED = """
r AS (
  SELECT p.*, rank() OVER (PARTITION BY group_id ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY group_id, round(value, 9)) - 1) / 2.0::DOUBLE AS rv,
    rank() OVER (PARTITION BY group_id ORDER BY round(score_a, 9)) + (count(*) OVER (PARTITION BY group_id, round(score_a, 9)) - 1) / 2.0::DOUBLE AS rs,
    rank() OVER (PARTITION BY group_id ORDER BY round(score_b, 9)) + (count(*) OVER (PARTITION BY group_id, round(score_b, 9)) - 1) / 2.0::DOUBLE AS rb,
    row_number() OVER (PARTITION BY group_id ORDER BY round(value, 9) DESC, entity) AS pv, row_number() OVER (PARTITION BY group_id ORDER BY round(score_a, 9) DESC, entity) AS ps,
    count(*) OVER (PARTITION BY group_id) AS n, greatest(1, round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY group_id), 0)::INT) AS k,
    value - min(value) OVER (PARTITION BY group_id) AS gain
  FROM pred p
)"""
CORR = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


def corr_sql(a: str, b: str) -> str:
    return CORR.format(a, b)


@query("m2_spearman", f"WITH {RANKED} SELECT group_id, count(*) AS n, round({corr_sql('rv', 'rs')}, 6) AS spearman FROM r GROUP BY group_id")
def _(t):
    return metrics.spearman(t.pred, ["group_id"], "entity", "value", "score_a").withColumn("spearman", r6("spearman"))


METRICS_SQL = f"""
SELECT group_id, count(*) AS n, round({corr_sql('value', 'score_a')}, 6) AS pearson, round({corr_sql('rv', 'rs')}, 6) AS spearman,
  round((avg(value) FILTER (ps <= k) - avg(value)) / stddev_samp(value), 6) AS sel_diff, round(count(*) FILTER (ps <= k AND pv <= k) / max(k)::DOUBLE, 6) AS hit_rate,
  round(sum(gain / log2(ps + 1.0)) FILTER (ps <= k) / sum(gain / log2(pv + 1.0)) FILTER (pv <= k), 6) AS ndcg,
  round(sqrt(avg((score_a - value) * (score_a - value))), 6) AS rmse, round(avg(score_a - value), 6) AS bias,
  round(CASE WHEN var_pop(score_a) > 0 THEN covar_pop(score_a, value) / var_pop(score_a) END, 6) AS slope
FROM r GROUP BY group_id HAVING count(*) >= 25"""


def _metrics(t):
    m = metrics.group_metrics(t.pred, ["group_id"], "entity", "value", "score_a")
    return m.select("group_id", "n", *(r6(c).alias(c) for c in m.columns[2:]))


@query("m1_m7_group_metrics", f"WITH {RANKED} {METRICS_SQL}")
def _(t):
    return _metrics(t)


@query("m8_long_table", f"""WITH {RANKED}, m AS ({METRICS_SQL})
SELECT group_id, n, 'pearson' AS metric, pearson AS result FROM m UNION ALL SELECT group_id, n, 'sel_diff', sel_diff FROM m UNION ALL SELECT group_id, n, 'ndcg', ndcg FROM m""")
def _(t):
    return metrics.long_table(_metrics(t).select("group_id", "n", "pearson", "sel_diff", "ndcg"), ["group_id"], ["pearson", "sel_diff", "ndcg"])


@query("m9_pooled_pearson", f"SELECT period, round({corr_sql('value', 'score_a')}, 6) AS pooled_r, count(*) AS n FROM pred GROUP BY period")
def _(t):
    return metrics.pooled_pearson(t.pred, ["period"], "value", "score_a").withColumn("pooled_r", r6("pooled_r"))


@query("m10_mean_metric", f"""WITH {RANKED}, s AS (SELECT period, group_id, {corr_sql('rv', 'rs')} AS s FROM r GROUP BY ALL HAVING count(*) >= 10)
SELECT period, round(avg(s), 6) AS spearman, count(s) AS n_groups FROM s GROUP BY period""")
def _(t):
    per = metrics.spearman(t.pred, ["period", "group_id"], "entity", "value", "score_a").filter("n >= 10")
    return metrics.mean_metric(per, ["period"], "spearman").withColumn("spearman", r6("spearman"))


@query("m11_mean_pearson_of_many", f"""
WITH u AS (SELECT group_id, value, 'score_a' AS setting, score_a AS s FROM pred UNION ALL SELECT group_id, value, 'score_b', score_b FROM pred),
g AS (SELECT setting, group_id, {corr_sql('value', 's')} AS r FROM u GROUP BY ALL) SELECT setting, round(avg(r), 6) AS r, count(r) AS n_groups FROM g GROUP BY setting""")
def _(t):
    return metrics.mean_pearson_of_many(t.pred, "group_id", "value", ["score_a", "score_b"]).withColumn("r", r6("r"))


@query("m12_centred_mse", """
WITH d AS (SELECT period, value - avg(value) OVER w - (score_a - avg(score_a) OVER w) AS d FROM pred WINDOW w AS (PARTITION BY group_id))
SELECT period, round(avg(d * d), 6) AS msed FROM d GROUP BY period""")
def _(t):
    d = t.pred.withColumn("d", windows.center("value", "group_id") - windows.center("score_a", "group_id"))
    return d.groupBy("period").agg(r6(F.avg(F.col("d") * F.col("d"))).alias("msed"))


@query("m13_huber", "SELECT period, round(avg(CASE WHEN abs(value - score_a) <= 5 THEN (value - score_a) * (value - score_a) / 2 ELSE 5 * (abs(value - score_a) - 2.5) END), 6) AS loss FROM pred GROUP BY period")
def _(t):
    return t.pred.groupBy("period").agg(r6(F.avg(metrics.huber(F.col("value") - F.col("score_a"), 5.0))).alias("loss"))


@query("m14_decomposition", f"""
WITH d AS (SELECT *, avg(value) OVER w AS mv, avg(score_a) OVER w AS ms, value - avg(value) OVER w AS dv, score_a - avg(score_a) OVER w AS ds FROM pred WINDOW w AS (PARTITION BY group_id))
SELECT round({corr_sql('value', 'score_a')}, 6) AS pooled_r, round({corr_sql('mv', 'ms')}, 6) AS between_r, round({corr_sql('dv', 'ds')}, 6) AS within_r,
  round(var_pop(mv) / var_pop(value), 6) AS value_between, round(var_pop(ms) / var_pop(score_a), 6) AS score_between FROM d""")
def _(t):
    d = metrics.decomposition(t.pred, "group_id", "value", "score_a")
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("m15_best_setting", f"""
WITH u AS (SELECT period, group_id, value, 1 AS setting, score_a AS s FROM pred UNION ALL SELECT period, group_id, value, 2, score_b FROM pred UNION ALL SELECT period, group_id, value, 3, score_a + score_b FROM pred),
g AS (SELECT period, setting, round({corr_sql('value', 's')}, 6) AS r FROM u GROUP BY ALL)
SELECT period, setting, r FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY r DESC, setting) AS k FROM g WHERE r IS NOT NULL) WHERE k = 1""")
def _(t):
    u = t.pred.select("period", "value", F.explode(F.array(*(F.struct(F.lit(i).alias("setting"), s.alias("s")) for i, s in enumerate((F.col("score_a"), F.col("score_b"), F.col("score_a") + F.col("score_b")), 1)))).alias("x"))
    curve = u.select("period", "value", "x.*").groupBy("period", "setting").agg(r6(metrics.pearson("value", "s")).alias("r"))
    return metrics.best_setting(curve, ["period"], "setting", "r")


@query("m16_scopes", f"""
WITH s AS (SELECT *, 'all' AS scope FROM pred UNION ALL SELECT *, CASE WHEN is_new THEN 'new' ELSE 'old' END FROM pred),
r AS (SELECT scope, period, group_id, rank() OVER (PARTITION BY scope, group_id ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY scope, group_id, round(value, 9)) - 1) / 2.0::DOUBLE AS rv,
  rank() OVER (PARTITION BY scope, group_id ORDER BY round(score_a, 9)) + (count(*) OVER (PARTITION BY scope, group_id, round(score_a, 9)) - 1) / 2.0::DOUBLE AS rs FROM s),
g AS (SELECT scope, period, group_id, {corr_sql('rv', 'rs')} AS r FROM r GROUP BY ALL HAVING count(*) >= 5)
SELECT scope, period, round(avg(r), 6) AS spearman, count(r) AS n_groups FROM g GROUP BY ALL""")
def _(t):
    per = metrics.spearman(metrics.with_scopes(t.pred, "is_new"), ["scope", "period", "group_id"], "entity", "value", "score_a").filter("n >= 5")
    return metrics.mean_metric(per, ["scope", "period"], "spearman").withColumn("spearman", r6("spearman"))


@query("m17_contrast", f"""WITH {RANKED}, g AS (SELECT period, group_id, {corr_sql('rv', 'rs')} AS a, {corr_sql('rv', 'rb')} AS b FROM r GROUP BY ALL)
SELECT period, group_id, round(a - b, 6) AS diff FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    both = t.pred.unpivot(["period", "group_id", "entity", "value"], ["score_a", "score_b"], "method", "score")
    per = metrics.spearman(both, ["method", "period", "group_id"], "entity", "value", "score")
    return metrics.contrast(per, ["period", "group_id"], "method", "score_a", "score_b", "spearman").withColumn("diff", r6("diff"))


@query("m18_agreement", f"""WITH {RANKED}, g AS (SELECT group_id, {corr_sql('rs', 'rb')} AS r FROM r GROUP BY ALL)
SELECT round(quantile_cont(r, 0.5), 6) AS median, round(min(r), 6) AS lowest, count(r) AS n_groups FROM g""")
def _(t):
    d = metrics.agreement(t.pred, ["group_id"], "entity", "score_a", "score_b")
    return d.select(r6("median").alias("median"), r6("lowest").alias("lowest"), "n_groups")


# Aggregations


@query("d1_cell_means", "SELECT group_id, entity, value, n_plots FROM cells", ("value",))
def _(t):
    return t.cells.select("group_id", "entity", "value", "n_plots")


@query("d2_stage1", "SELECT entity, round(avg(cv), 6) AS mean, count(*) AS n FROM centred GROUP BY entity")
def _(t):
    return aggs.stage1(t.centred, "entity", "cv").withColumn("mean", r6("mean"))


@query("d3_scorable", "SELECT group_id, count(DISTINCT entity) AS n_entities FROM cells GROUP BY group_id HAVING count(DISTINCT entity) >= 25")
def _(t):
    return aggs.scorable(t.cells, ["group_id"], "entity", 25)


@query("d4_first_period", "SELECT entity, min(period) AS first_period FROM cells GROUP BY entity")
def _(t):
    return aggs.first_period(t.cells, "entity", "period")


@query("d5_qualifying_periods", """
WITH rules AS (SELECT * FROM (VALUES ('main', 25, 5, 2, 0.5::DOUBLE), ('relaxed', 10, 3, 1, 0.2::DOUBLE)) AS v("rule", min_n, min_groups, min_prior, new_share)),
s AS (SELECT period, group_id, count(DISTINCT entity) AS n FROM cells GROUP BY ALL),
p AS (SELECT "rule", period, count(*) FILTER (n >= min_n) AS groups, any_value(min_groups) AS mg, any_value(min_prior) AS mp, any_value(new_share) AS ns FROM s, rules GROUP BY ALL),
f AS (SELECT entity, min(period) AS fp FROM cells GROUP BY entity),
n AS (SELECT period, avg((fp = period)::INT::DOUBLE) AS share_new FROM (SELECT DISTINCT period, entity FROM cells) JOIN f USING (entity) GROUP BY period),
q AS (SELECT p.*, share_new, coalesce(sum((groups >= mg)::INT) OVER (PARTITION BY "rule" ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM p JOIN n USING (period))
SELECT "rule", period, groups, round(share_new, 6) AS share_new, prior, groups >= mg AND prior >= mp AND share_new >= ns AS qualifies FROM q""")
def _(t):
    rules = t.spark.createDataFrame([("main", 25, 5, 2, 0.5), ("relaxed", 10, 3, 1, 0.2)], "rule string, min_n int, min_groups int, min_prior int, new_share double")
    d = aggs.qualifying_periods(t.cells, "group_id", "entity", "period", rules)
    return d.select("rule", "period", "groups", r6("share_new").alias("share_new"), "prior", "qualifies")


@query("d6_other_trait", "SELECT l_suppkey AS location, l_partkey AS entity, round(avg(l_quantity), 6) AS l_quantity, count(*) AS n_plots FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL")
def _(t):
    d = aggs.other_trait(t.table("lineitem").select("l_returnflag", "l_quantity", F.col("l_suppkey").alias("location"), F.col("l_partkey").alias("entity")), "l_returnflag", "l_quantity", "A", ("A", "N"), ["location", "entity"])
    return d.withColumn("l_quantity", r6("l_quantity"))


@query("d7_old_entity_targets", """
WITH f AS (SELECT entity, min(period) AS fp FROM cells GROUP BY entity), o AS (SELECT c.* FROM cells c JOIN f USING (entity) WHERE c.period = 1998 AND fp < 1998),
g AS (SELECT group_id FROM o GROUP BY group_id HAVING count(DISTINCT entity) >= 10)
SELECT entity, group_id, value FROM o WHERE group_id IN (SELECT group_id FROM g) AND (SELECT count(*) FROM g) >= 5""", ("value",))
def _(t):
    return aggs.old_entity_targets(t.cells, 1998, "group_id", "entity", "period", 10, 5).select("entity", "group_id", "value")


@query("d8_report", """
SELECT count(*) AS n_plots, count(DISTINCT group_id) AS n_groups, count(DISTINCT entity) AS n_entities, count(*) FILTER (quantity > 25) AS n_large, round(avg(value), 6) AS mean_value,
  min(period) AS first_period, max(period) AS last_period FROM plots""")
def _(t):
    return t.plots.agg(F.count(F.lit(1)).alias("n_plots"), F.countDistinct("group_id").alias("n_groups"), F.countDistinct("entity").alias("n_entities"), F.count_if(F.col("quantity") > 25).alias("n_large"),
                       r6(F.avg("value")).alias("mean_value"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query("d9_weighted_mean", f"""WITH {RANKED}, g AS (SELECT period, group_id, count(*) AS n, {corr_sql('rv', 'rs')} AS s FROM r GROUP BY ALL)
SELECT period, round(sum(s * n) / sum(n) FILTER (s IS NOT NULL), 6) AS spearman, count(s) AS n_defined FROM g GROUP BY period""")
def _(t):
    per = metrics.spearman(t.pred, ["period", "group_id"], "entity", "value", "score_a")
    return aggs.weighted_mean(per, ["period"], "spearman", F.col("n")).withColumn("spearman", r6("spearman"))


@query("d10_novelty", """
SELECT round(avg((h.entity IS NULL)::INT::DOUBLE), 6) AS novelty FROM (SELECT DISTINCT entity FROM cells WHERE period = 1998) n LEFT JOIN (SELECT DISTINCT entity FROM cells WHERE period < 1998) h USING (entity)""")
def _(t):
    return aggs.novelty(t.cells.filter("period = 1998"), t.cells.filter("period < 1998"), "entity").withColumn("novelty", r6("novelty"))


@query("d12_describe", """
SELECT period, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75
FROM cells GROUP BY period""")
def _(t):
    d = aggs.describe(t.cells, ["period"], "value")
    return d.select("period", "n", *(r6(c).alias(c) for c in d.columns[2:]))


@query("d13_cross_tab", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return aggs.cross_tab(t.table("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("d14_at_extreme", "SELECT group_id, entity AS worst FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY value, entity) AS k FROM cells) WHERE k = 1")
def _(t):
    return aggs.at_extreme(t.cells.withColumn("worst", F.col("entity")), "group_id", "value", "worst", "entity", largest=False)


@query("d15_between_share", """
WITH b AS (SELECT c.group_id, c.value, avg(c.value) OVER (PARTITION BY c.group_id, p.p_brand) AS m FROM cells c JOIN part p ON p.p_partkey = c.entity)
SELECT group_id, CASE WHEN var_pop(value) > 0 THEN round(var_pop(m) / var_pop(value), 6) END AS between_share FROM b GROUP BY group_id""")
def _(t):
    c = t.cells.join(t.table("part").select(F.col("p_partkey").alias("entity"), "p_brand"), "entity")
    return aggs.between_share(c, "group_id", "p_brand", "value").withColumn("between_share", r6("between_share"))


@query("d16_pooled_ranges", """
WITH g AS (SELECT * FROM (VALUES ('all', 1997), ('all', 1998), ('all', 1999), ('late', 1998), ('late', 1999)) AS v("range", period))
SELECT "range", count(*) AS n, round(avg(value), 6) AS mean FROM pred JOIN g USING (period) GROUP BY "range" """)
def _(t):
    ranges = t.spark.createDataFrame([("all", 1997), ("all", 1998), ("all", 1999), ("late", 1998), ("late", 1999)], "range string, period int")
    return aggs.pooled_ranges(t.pred, ranges, "period", [F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")])


@query("d17_leave_one_out", "SELECT o.period AS left_out, count(*) AS n, round(avg(p.value), 6) AS mean FROM pred p JOIN (SELECT DISTINCT period FROM pred) o ON p.period <> o.period GROUP BY ALL")
def _(t):
    return aggs.leave_one_out(t.pred, "period", [F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")])


@query("d18_others_mean", "SELECT group_id, entity, round((sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), 6) AS others FROM cells WINDOW w AS (PARTITION BY period, entity)")
def _(t):
    return t.cells.select("group_id", "entity", r6(aggs.others_mean("value", "period", "entity")).alias("others"))


@query("d19_excluding_mean", """
WITH k AS (SELECT *, CASE WHEN location % 2 = 0 THEN 'even' || period ELSE group_id END AS comp FROM centred)
SELECT a.group_id, a.entity, a.period, round(coalesce((SELECT avg(b.cv) FROM k b WHERE b.period = a.period AND b.entity = a.entity AND b.comp <> a.comp), 0), 6) AS others FROM k a""")
def _(t):
    comp = t.cells.select("group_id", "location", "period").distinct().filter("location % 2 = 0").select("group_id", F.concat(F.lit("even"), F.col("period").cast("string")).alias("component"))
    return aggs.excluding_mean(t.centred, t.cells, comp, "group_id", "entity", "period", "cv").withColumn("others", r6("others"))


@query("d20_all_mean", """
SELECT group_id, entity, round(coalesce(a, 0), 6) AS all_mean FROM (SELECT period, group_id, entity, avg(cv) FILTER (period < 1997) OVER (PARTITION BY entity) AS a FROM centred) WHERE period = 1997""")
def _(t):
    d = aggs.entity_mean_or_zero(t.cells.filter("period = 1997"), t.centred.filter("period < 1997"), ["entity"], "cv")
    return d.select("group_id", "entity", r6("all_mean").alias("all_mean"))


@query("d21_pair_correlations", f"""
SELECT a.group_id AS a, b.group_id AS b, a.period AS a_period, b.period AS b_period, count(*) AS shared, round({corr_sql('a.value', 'b.value')}, 6) AS r
FROM cells a JOIN cells b ON a.entity = b.entity AND a.group_id < b.group_id GROUP BY ALL HAVING count(*) >= 5""")
def _(t):
    return aggs.pair_correlations(t.cells, "group_id", "entity", "value", ["period"], 5).withColumn("r", r6("r"))


@query("d22_seen_shares", """
WITH x AS (SELECT c.*, p.p_brand AS p1, p.p_type AS p2 FROM cells c JOIN part p ON p.p_partkey = c.entity), k AS (SELECT p1 AS p FROM x WHERE period < 1997 UNION SELECT p2 FROM x WHERE period < 1997)
SELECT group_id, round(avg((p1 IN (SELECT p FROM k) AND p2 IN (SELECT p FROM k))::INT::DOUBLE), 6) AS all_seen, round(avg((p1 IN (SELECT p FROM k) OR p2 IN (SELECT p FROM k))::INT::DOUBLE), 6) AS any_seen
FROM x WHERE period = 1997 GROUP BY group_id""")
def _(t):
    x = t.cells.join(t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("p1"), F.col("p_type").alias("p2")), "entity")
    d = aggs.seen_shares(x.filter("period = 1997"), x.filter("period < 1997"), "group_id", ["p1", "p2"])
    return d.select("group_id", r6("all_seen").alias("all_seen"), r6("any_seen").alias("any_seen"))


@query("d23_calendar", """
SELECT l_suppkey, min(l_shipdate::DATE) AS first_day, max(l_shipdate::DATE) AS last_day, ('1970-01-01'::DATE + floor(quantile_cont((l_shipdate::DATE - '1970-01-01'::DATE)::DOUBLE, 0.5))::INT)::DATE AS median_day
FROM lineitem GROUP BY l_suppkey""")
def _(t):
    return aggs.calendar(t.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")), "l_suppkey", "day")


@query("d24_next_period_set", """
SELECT a.group_id, b.group_id AS next_group, count(DISTINCT a.entity) AS shared FROM cells a JOIN cells b ON a.location = b.location AND a.entity = b.entity AND b.period = a.period + 1 GROUP BY ALL HAVING count(DISTINCT a.entity) >= 3""")
def _(t):
    return aggs.next_period_set(t.cells, "group_id", "location", "entity", "period", 3)


GRAM_SQL = """g AS (SELECT period, count(*) AS n, sum(score_a) AS s_score_a, sum(score_b) AS s_score_b, sum(value) AS s_value, sum(score_a * score_a) AS p_score_a_score_a, sum(score_a * score_b) AS p_score_a_score_b,
  sum(score_a * value) AS p_score_a_value, sum(score_b * score_b) AS p_score_b_score_b, sum(score_b * value) AS p_score_b_value, sum(value * value) AS p_value_value FROM pred GROUP BY period)"""
GRAM = ["s_score_a", "s_score_b", "s_value", "p_score_a_score_a", "p_score_a_score_b", "p_score_a_value", "p_score_b_score_b", "p_score_b_value", "p_value_value"]


@query("d25_gram_sums", f"WITH {GRAM_SQL} SELECT period, n, {', '.join(f'round({c}, 3) AS {c}' for c in GRAM)} FROM g")
def _(t):
    return aggs.gram_sums(t.pred, ["period"], ["score_a", "score_b"], "value").select("period", "n", *(F.round(c, 3).alias(c) for c in GRAM))


@query("d25_without_group", f"WITH {GRAM_SQL} SELECT period, (sum(n) OVER () - n)::BIGINT AS n, {', '.join(f'round(sum({c}) OVER () - {c}, 3) AS {c}' for c in GRAM)} FROM g")
def _(t):
    return aggs.without_group(aggs.gram_sums(t.pred, ["period"], ["score_a", "score_b"], "value"), "period").select("period", "n", *(F.round(c, 3).alias(c) for c in GRAM))


@query("d26_incidence_weights", """
WITH c AS (SELECT group_id, entity, 1.0::DOUBLE / count(*) OVER (PARTITION BY group_id) AS w FROM (SELECT DISTINCT group_id, entity FROM cells))
SELECT a.entity AS i, b.entity AS j, round(sum(CASE WHEN a.entity = b.entity THEN 1.0::DOUBLE ELSE 0 END) - sum(a.w), 6) AS weight FROM c a JOIN c b USING (group_id) WHERE a.entity <= b.entity GROUP BY ALL""")
def _(t):
    return aggs.incidence_weights(t.cells, "group_id", "entity", 6)


@query("d27_detectable", """
WITH p AS (SELECT period, avg(value) AS m, stddev_samp(value) AS s FROM cells GROUP BY period)
SELECT round(avg(s), 6) AS sd_within, round(stddev_samp(m), 6) AS sd_between, count(*) AS periods, round(2.8 * stddev_samp(m) / sqrt(count(*)), 6) AS mde FROM p""")
def _(t):
    d = aggs.detectable(t.cells, "group_id", "period", "value")
    return d.select(r6("sd_within").alias("sd_within"), r6("sd_between").alias("sd_between"), "periods", r6("mde").alias("mde"))


@query("d30_population_means", "SELECT period, entity, round(avg(value), 6) AS mean, count(DISTINCT group_id) AS n_groups FROM cells GROUP BY ALL HAVING count(DISTINCT group_id) >= 2")
def _(t):
    return aggs.population_means(t.cells, ["period", "entity"], "group_id", "value").withColumn("mean", r6("mean"))


@query("d31_append_period", """
WITH u AS (SELECT group_id, entity, period, value FROM cells WHERE period < 2000 UNION ALL SELECT group_id, entity, period, value FROM cells WHERE period >= 1999)
SELECT *, count(*) OVER (PARTITION BY group_id, entity) > 1 AS duplicate FROM u""", ("value",))
def _(t):
    c = t.cells.select("group_id", "entity", "period", "value")
    return aggs.append_period(c.filter("period < 2000"), c.filter("period >= 1999"), ["group_id", "entity"])


@query("d33_value_or", """
SELECT group_id, entity, round(score_a, 6) AS value_out FROM pred UNION ALL SELECT group_id, entity, round(value, 6) FROM cells WHERE period NOT IN (1997, 1998, 1999) OR entity NOT IN (SELECT p_partkey FROM part)""")
def _(t):
    adjusted = t.pred.select("group_id", "entity", F.col("score_a").alias("adj"))
    raw = t.cells.withColumn("adj", F.col("value"))
    return aggs.value_or(adjusted, raw, ["group_id", "entity"], "adj", "value_out").select("group_id", "entity", r6("value_out").alias("value_out"))


@query("d34_centred_records", """
SELECT group_id, entity, round(value - m, 6) AS centred FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM cells WINDOW w AS (PARTITION BY group_id)) WHERE n >= 30""")
def _(t):
    return aggs.centred_records(t.cells, "group_id", "value").select("group_id", "entity", r6("centred").alias("centred"))


# Joins


@query("c1_keep", "SELECT group_id, entity, value FROM cells WHERE entity IN (SELECT p_partkey FROM part WHERE p_size > 25)", ("value",))
def _(t):
    return joins.keep(t.cells, t.table("part").filter("p_size > 25").select(F.col("p_partkey").alias("entity")), ["entity"]).select("group_id", "entity", "value")


@query("c2_drop", "SELECT group_id, entity, value FROM cells WHERE period = 1998 AND entity NOT IN (SELECT entity FROM cells WHERE period < 1998)", ("value",))
def _(t):
    return joins.drop(t.cells.filter("period = 1998"), t.cells.filter("period < 1998"), ["entity"]).select("group_id", "entity", "value")


@query("c4_coverage", """
SELECT c.period, count(*) AS wanted, round(avg((p.score_a IS NOT NULL)::INT::DOUBLE), 6) AS coverage FROM cells c LEFT JOIN pred p ON p.group_id = c.group_id AND p.entity = c.entity GROUP BY c.period""")
def _(t):
    return joins.coverage(t.cells, t.pred, ["group_id", "entity"], "score_a", ["period"]).withColumn("coverage", r6("coverage"))


@query("c5_release_diff", """
WITH o AS (SELECT group_id, entity, value AS v FROM cells WHERE period < 1999), n AS (SELECT group_id, entity, round(value * CASE WHEN entity % 7 = 0 THEN 1.01 ELSE 1 END, 6) AS w FROM cells WHERE period > 1995)
SELECT count(*) FILTER (w IS NULL) AS only_old, count(*) FILTER (v IS NULL) AS only_new, count(*) FILTER (v IS NOT NULL AND w IS NOT NULL) AS in_both, count(*) FILTER (v = w) AS equal, round(max(abs(v - w)), 6) AS max_abs_diff
FROM o FULL JOIN n USING (group_id, entity)""")
def _(t):
    new = t.cells.filter("period > 1995").withColumn("value", r6(F.col("value") * F.when(F.col("entity") % 7 == 0, 1.01).otherwise(1.0)))
    return joins.release_diff(t.cells.filter("period < 1999"), new, ["group_id", "entity"], "value").withColumn("max_abs_diff", r6("max_abs_diff"))


@query("c6_history", "SELECT target, count(*) AS n, count(DISTINCT entity) AS entities, max(period) AS last FROM hist GROUP BY target")
def _(t):
    return t.hist.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.max("period").alias("last"))


@query("c7_last_before", """
SELECT o.o_orderkey, o.o_custkey, p.o_orderdate AS d_before, p.o_totalprice AS price_before FROM orders o LEFT JOIN LATERAL (
  SELECT o_orderdate, o_totalprice FROM (SELECT o_custkey, o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY ALL) q
  WHERE q.o_custkey = o.o_custkey AND q.o_orderdate < o.o_orderdate ORDER BY o_orderdate DESC LIMIT 1) p ON true""")
def _(t):
    o = t.table("orders")
    before = o.groupBy("o_custkey", F.col("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    return joins.last_before(o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at")), before, "o_custkey", "at", "d", "price").drop("at")


@query("c7_nearest", """
WITH p AS (SELECT DISTINCT period FROM cells) SELECT target, period AS nearest FROM (SELECT target, period, row_number() OVER (PARTITION BY target ORDER BY abs(target - period), period) AS k FROM targets, p WHERE period <> target) WHERE k = 1""")
def _(t):
    return joins.nearest(t.targets, t.cells, "target", "period")


@query("c8_window_sums", """
WITH d AS (SELECT group_id, day, v_max, sum(n) OVER (PARTITION BY group_id ORDER BY day) AS cum, sum(n) OVER (PARTITION BY group_id ORDER BY day) - n AS prev FROM daily), w AS (SELECT * FROM (VALUES ('a', 10, 60), ('b', 50, 150), ('c', 100, 200)) AS v("window", lo, hi))
SELECT group_id, "window", count(*) AS days, round(sum(v_max), 6) AS total, round(avg(v_max), 6) AS mean FROM d, w WHERE cum > lo AND prev < hi GROUP BY ALL""")
def _(t):
    d = t.daily.withColumn("cum", F.sum("n").over(windows.Window.partitionBy("group_id").orderBy("day")).cast("double"))
    few = t.spark.createDataFrame([("a", 10, 60), ("b", 50, 150), ("c", 100, 200)], "window string, lo int, hi int")
    w = joins.grid(t.daily.select("group_id").distinct(), few)
    s = joins.window_sums(d, w, "group_id", "day", "cum", "v_max")
    return s.select("group_id", "window", "days", r6("total").alias("total"), r6("mean").alias("mean"))


@query("c9_fallback", """
WITH own AS (SELECT location, entity, avg(value) AS v FROM cells WHERE period < 1997 GROUP BY ALL), loc AS (SELECT location, avg(value) AS v FROM cells WHERE period < 1997 AND location % 3 > 0 GROUP BY ALL), al AS (SELECT avg(value) AS v FROM cells WHERE period < 1997)
SELECT c.group_id, c.entity, round(coalesce(own.v, loc.v, al.v), 6) AS guess FROM cells c LEFT JOIN own USING (location, entity) LEFT JOIN loc USING (location), al WHERE c.period = 1997""")
def _(t):
    h = t.cells.filter("period < 1997")
    levels = [(h.groupBy("location", "entity").agg(F.avg("value").alias("v")), ["location", "entity"], "v"),
              (h.filter("location % 3 > 0").groupBy("location").agg(F.avg("value").alias("v")), ["location"], "v"), (h.agg(F.avg("value").alias("v")), [], "v")]
    return joins.fallback(t.cells.filter("period = 1997"), levels, "guess").select("group_id", "entity", r6("guess").alias("guess"))


@query("c10_shared_content", """
WITH q AS (SELECT DISTINCT period, group_id, quantity::INT AS q, entity % 40 AS e FROM plots), n AS (SELECT period, group_id, count(*) AS n FROM q GROUP BY ALL)
SELECT a.period, a.group_id AS a, b.group_id AS b, count(*) AS shared, round(count(*) / least(any_value(na.n), any_value(nb.n))::DOUBLE, 6) AS share
FROM q a JOIN q b ON a.period = b.period AND a.q = b.q AND a.e = b.e AND a.group_id < b.group_id JOIN n na ON na.group_id = a.group_id JOIN n nb ON nb.group_id = b.group_id GROUP BY ALL HAVING count(*) >= 6""")
def _(t):
    q = t.plots.select("period", "group_id", F.col("quantity").cast("int").alias("q"), (F.col("entity") % 40).alias("e"))
    return joins.shared_content(q, "group_id", ["period"], "e", "q", 6, digits=6)


@query("c11_exclusion_groups", """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + 3) % 100 AS b FROM lineitem), l AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT u, u FROM l UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def _(t):
    s = F.col("l_suppkey")
    return joins.exclusion_groups(t.table("lineitem").select(s.alias("a"), ((s * 7 + 3) % 100).alias("b")).distinct())


@query("c12_resolve_alias", """
WITH n AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'alt ' || p_brand ELSE 'none ' || p_brand END AS name FROM part), k AS (SELECT DISTINCT p_brand AS id FROM part)
SELECT name, coalesce(a.id, b.id, c.id) AS matched, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'case' WHEN c.id IS NOT NULL THEN 'alias' ELSE 'none' END AS match_kind
FROM n LEFT JOIN k a ON a.id = name LEFT JOIN k b ON upper(b.id) = upper(name) LEFT JOIN k c ON 'alt ' || c.id = name""")
def _(t):
    p = t.table("part")
    b, m = F.col("p_brand"), F.col("p_size") % 4
    names = p.select(F.when(m == 0, b).when(m == 1, F.lower(b)).when(m == 2, F.concat(F.lit("alt "), b)).otherwise(F.concat(F.lit("none "), b)).alias("name")).distinct()
    known = p.select(b.alias("id"), F.concat(F.lit("alt "), b).alias("alt")).distinct()
    return joins.resolve_alias(names, known, "name", "id", "alt").select("name", "matched", "match_kind")


@query("c13_common_cells", """
WITH m AS (SELECT group_id, entity, 'a' AS method FROM pred UNION ALL SELECT group_id, entity, 'b' FROM pred WHERE entity % 3 > 0)
SELECT * FROM m WHERE (group_id, entity) IN (SELECT (group_id, entity) FROM m GROUP BY group_id, entity HAVING count(DISTINCT method) = 2)""")
def _(t):
    m = t.pred.select("group_id", "entity", F.lit("a").alias("method")).unionByName(t.pred.filter("entity % 3 > 0").select("group_id", "entity", F.lit("b").alias("method")))
    return joins.common_cells(m, ["group_id", "entity"], "method", 2).select("group_id", "entity", "method")


@query("c15_concordance", """
SELECT entity, count(*) FILTER (d IS NOT NULL) AS shared, round(avg((dosage = d)::INT::DOUBLE) FILTER (d IS NOT NULL), 6) AS agreement, 0::BIGINT AS recovered FROM feats GROUP BY entity""")
def _(t):
    return joins.concordance(t.feats.select("entity", "feature", F.col("dosage").alias("v")), t.feats.select("entity", "feature", F.col("d").alias("v")), "entity", "feature", "v").withColumn("agreement", r6("agreement"))


@query("c16_modal", """
WITH n AS (SELECT location, quantity::INT AS q, count(*) AS n FROM plots GROUP BY ALL)
SELECT location, q, n FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, q) AS k FROM n) WHERE k = 1""")
def _(t):
    return joins.modal(t.plots.select("location", F.col("quantity").cast("int").alias("q")), "location", "q")


@query("c17_bind_late", "SELECT group_id, entity, round(score_a, 6) AS score_a, round(value, 6) AS value FROM pred")
def _(t):
    return joins.bind_late(t.pred.drop("value"), t.cells, ["group_id", "entity"], "value").select("group_id", "entity", r6("score_a").alias("score_a"), r6("value").alias("value"))
