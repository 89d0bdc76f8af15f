"""Queries of inference, splits, features, ensembles, cleaning and sources on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import clean
from harrow.operators import blocks, ensemble, features, inference, metrics, nearest, splits, windows
from harrow.operators.staging import staged
from harrow.plans.declare import query
from harrow.plans.queries_core import RANKED, corr_sql
from harrow.plans.testbed import r6
from harrow.sources import genotypes

B = 2000  # replicates of the resampling queries
MD5 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def md5_sql(*parts: str) -> str:
    return MD5.format("concat_ws('|', " + ", ".join(parts) + ")")


# Contrasts by group: what the inference operators take
DIFFS_SQL = f"""{RANKED}, pg AS (SELECT period, location, group_id, {corr_sql('rv', 'rs')} AS a, {corr_sql('rv', 'rb')} AS b FROM r GROUP BY ALL HAVING count(*) >= 25),
df AS (SELECT period, location, group_id, round(a - b, 6) AS diff FROM pg WHERE a IS NOT NULL AND b IS NOT NULL)"""


def diffs(t):
    both = t.pred.unpivot(["period", "location", "group_id", "entity", "value"], ["score_a", "score_b"], "method", "score")
    per = metrics.spearman(both, ["method", "period", "location", "group_id"], "entity", "value", "score").filter("n >= 25")
    return staged(metrics.contrast(staged(per, "per-group"), ["period", "location", "group_id"], "method", "score_a", "score_b", "spearman").withColumn("diff", r6("diff")), "diffs")


def boot_sql(src: str, strata: str, unit: str, value: str, seed: str, b: int = B, pre: str = "") -> str:
    """CTEs {pre}bn (numbered), {pre}bm (replicate means) of a bootstrap over units within strata."""
    return f"""{pre}bn AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {strata}) AS n FROM {src}),
{pre}bd AS (SELECT {strata}, rep, {md5_sql(f"'{seed}'", strata, 'rep', 'i')} % n AS pick FROM {pre}bn, unnest(range({b})) AS q(rep)),
{pre}bm AS (SELECT {strata}, rep, avg({value}) AS m FROM {pre}bd JOIN (SELECT {strata}, i AS pick, {value} FROM {pre}bn) USING ({strata}, pick) GROUP BY ALL)"""


@query("i1_bootstrap_mean", f"""WITH {DIFFS_SQL}, {boot_sql('df', 'period', 'group_id', 'diff', 'i1')},
s AS (SELECT period, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY period), d AS (SELECT period, avg(diff) AS d, count(*) AS n_env FROM df GROUP BY period)
SELECT period, round(d, 6) AS d, n_env, round(se, 6) AS se, round(lo, 6) AS lo, round(hi, 6) AS hi FROM d JOIN s USING (period)""")
def _(t):
    d = inference.bootstrap_mean(diffs(t), ["period"], "group_id", "diff", B, "i1")
    return d.select("period", "n_env", *(r6(c).alias(c) for c in ("d", "se", "lo", "hi")))


@query("i3_clustered_bootstrap", f"""WITH {DIFFS_SQL}, c AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT period FROM df)),
dr AS (SELECT rep, a.c AS slot, {md5_sql("'i3'", 'rep', 'a.c')} % a.k AS pick FROM c a, unnest(range({B})) AS q(rep)), dp AS (SELECT rep, slot, period FROM dr JOIN c ON c.c = dr.pick),
u AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM df),
pk AS (SELECT dp.rep, dp.period, {md5_sql("'i3'", 'dp.rep', 'dp.slot', 'u.i')} % u.n AS i FROM dp JOIN u USING (period)), m AS (SELECT rep, avg(diff) AS m FROM pk JOIN u USING (period, i) GROUP BY rep)
SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS se, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(t):
    d = inference.clustered_bootstrap(diffs(t), "period", "group_id", "diff", B, "i3")
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("i4_stratified_mean", f"""WITH {DIFFS_SQL}, bn AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM df),
bd AS (SELECT period, rep, {md5_sql("'i4'", 'period', 'rep', 'i')} % n AS i FROM bn, unnest(range({B})) AS q(rep)), m AS (SELECT rep, avg(diff) AS m FROM bd JOIN bn USING (period, i) GROUP BY rep)
SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS se, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(t):
    d = inference.stratified_mean(diffs(t), "period", "group_id", "diff", B, "i4")
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("i2_two_level_bootstrap", f"""WITH {DIFFS_SQL},
u AS (SELECT location, period, avg(diff) AS v FROM df GROUP BY ALL),
g AS (SELECT location, row_number() OVER (ORDER BY location) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT location FROM u)), s AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM u)),
wg AS (SELECT rep, location, count(*) AS wl FROM (SELECT rep, {md5_sql("'i2'", "'location'", 'rep', 'i')} % n AS i FROM g, unnest(range({B})) AS q(rep)) JOIN g USING (i) GROUP BY ALL),
ws AS (SELECT rep, period, count(*) AS wp FROM (SELECT rep, {md5_sql("'i2'", "'period'", 'rep', 'i')} % n AS i FROM s, unnest(range({B})) AS q(rep)) JOIN s USING (i) GROUP BY ALL),
m AS (SELECT rep, sum(v * wl * wp) / sum(wl * wp) AS m FROM u JOIN wg USING (location) JOIN ws USING (period, rep) GROUP BY rep), p AS (SELECT period, avg(v) AS s FROM u GROUP BY period)
SELECT round(stddev_samp(m), 6) AS se, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT round(stddev_samp(s), 6) FROM p) AS seed_sd,
  (SELECT round(greatest(avg((s > 0)::INT::DOUBLE), avg((s < 0)::INT::DOUBLE)), 6) FROM p) AS same_sign FROM m""")
def _(t):
    u = diffs(t).groupBy("location", "period").agg(F.avg("diff").alias("v"))
    d = inference.two_level_bootstrap(u, "location", "period", "v", B, "i2")
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("i6_rank_difference", f"""WITH bn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY entity) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM pred),
bd AS (SELECT group_id, rep, i AS slot, {md5_sql("'i6'", 'group_id', 'rep', 'i')} % n AS i FROM bn, unnest(range(200)) AS q(rep)), x AS (SELECT group_id, rep, value, score_a, score_b FROM bd JOIN bn USING (group_id, i)),
k AS (SELECT group_id, rep, rank() OVER (PARTITION BY group_id, rep ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY group_id, rep, round(value, 9)) - 1) / 2.0::DOUBLE AS v,
  rank() OVER (PARTITION BY group_id, rep ORDER BY round(score_a, 9)) + (count(*) OVER (PARTITION BY group_id, rep, round(score_a, 9)) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY group_id, rep ORDER BY round(score_b, 9)) + (count(*) OVER (PARTITION BY group_id, rep, round(score_b, 9)) - 1) / 2.0::DOUBLE AS b FROM x),
d AS (SELECT group_id, rep, {corr_sql('v', 'a')} - {corr_sql('v', 'b')} AS d FROM k GROUP BY ALL) SELECT group_id, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS se FROM d GROUP BY group_id""")
def _(t):
    d = inference.bootstrap_rank_difference(t.pred, ["group_id"], "entity", "value", "score_a", "score_b", 200, "i6")
    return d.select("group_id", r6("mean").alias("mean"), r6("se").alias("se"))


@query("i7_pooled_r_bootstrap", f"""WITH mo AS (SELECT 'all' AS s, group_id, count(*) AS n, sum(value) AS sx, sum(score_a) AS sy, sum(value * value) AS sxx, sum(score_a * score_a) AS syy, sum(value * score_a) AS sxy FROM pred GROUP BY group_id),
bn AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS cnt FROM mo), bd AS (SELECT rep, {md5_sql("'i7'", "'all'", 'rep', 'i')} % cnt AS i FROM bn, unnest(range({B})) AS q(rep)),
c AS (SELECT rep, sum(sxy) - sum(sx) * sum(sy) / sum(n) AS cov, sum(sxx) - sum(sx) * sum(sx) / sum(n) AS vx, sum(syy) - sum(sy) * sum(sy) / sum(n) AS vy FROM bd JOIN bn USING (i) GROUP BY rep),
r AS (SELECT CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN cov / sqrt(vx * vy) END AS r FROM c) SELECT round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS se, round((1 + count(*) FILTER (r <= 0)) / {B + 1}.0::DOUBLE, 6) AS p_one_sided FROM r""")
def _(t):
    d = inference.pooled_r_bootstrap(t.pred, "group_id", "value", "score_a", B, "i7")
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("i9_permutation_test", f"""WITH k AS (SELECT location, period, group_id, diff, n_e, rank() OVER (PARTITION BY period ORDER BY round(diff, 9)) + (count(*) OVER (PARTITION BY period, round(diff, 9)) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY period ORDER BY n_e) + (count(*) OVER (PARTITION BY period, n_e) - 1) / 2.0::DOUBLE AS ry, row_number() OVER (PARTITION BY period ORDER BY group_id) AS rn
  FROM (SELECT location, period, group_id, avg(score_a) AS diff, count(*) AS n_e FROM pred GROUP BY ALL)),
o AS (SELECT rep, period, ry AS py, row_number() OVER (PARTITION BY rep, period ORDER BY md5(concat_ws('|', 'i9', rep, period, group_id)), group_id) AS rn FROM k, unnest(range({B})) AS q(rep)),
p AS (SELECT rep, {corr_sql('rx', 'py')} AS r FROM o JOIN k USING (period, rn) GROUP BY rep), tr AS (SELECT {corr_sql('rx', 'ry')} AS r FROM k)
SELECT round(any_value(tr.r), 6) AS r, round((1 + count(*) FILTER (abs(p.r) >= abs(tr.r) - 1e-12)) / {B + 1}.0::DOUBLE, 6) AS p FROM p, tr""")
def _(t):
    g = t.pred.groupBy("period", "group_id").agg(r6(F.avg("score_a")).alias("diff"), F.count(F.lit(1)).alias("n_e"))
    return inference.permutation_test(g, "period", "group_id", "diff", "n_e", B, "i9").select(r6("r").alias("r"), r6("p").alias("p"))


LONG_SQL = f"""{RANKED}, lg AS (SELECT period, group_id, {corr_sql('rv', 'rs')} AS a, {corr_sql('rv', 'rb')} AS b FROM r GROUP BY ALL), lm AS (SELECT group_id, 'a' AS method, round(a, 6) AS v FROM lg WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT group_id, 'b', round(b, 6) FROM lg WHERE a IS NOT NULL AND b IS NOT NULL)"""


def long_scores(t):
    a = metrics.spearman(t.pred, ["group_id"], "entity", "value", "score_a").select("group_id", r6("spearman").alias("a"))
    b = metrics.spearman(t.pred, ["group_id"], "entity", "value", "score_b").select("group_id", r6("spearman").alias("b"))
    return a.join(b, "group_id").filter("a is not null and b is not null").unpivot(["group_id"], ["a", "b"], "method", "v")


@query("i10_cross_fitted_best", f"""WITH {LONG_SQL}, h AS (SELECT rep, {md5_sql("'i10'", 'rep', 'group_id')} % 2 AS half, method, avg(v) AS m FROM lm, unnest(range(200)) AS q(rep) GROUP BY ALL),
b AS (SELECT rep, 1 - half AS half, method FROM (SELECT *, row_number() OVER (PARTITION BY rep, half ORDER BY round(m, 9) DESC, method) AS k FROM h) WHERE k = 1) SELECT round(avg(m), 6) AS value, count(*) AS n FROM b JOIN h USING (rep, half, method)""")
def _(t):
    return inference.cross_fitted_best(long_scores(t), "group_id", "method", "v", 200, "i10").select(r6("value").alias("value"), "n")


@query("i11_expected_maximum", f"""WITH {LONG_SQL}, c AS (SELECT group_id, method, v - avg(v) OVER (PARTITION BY method) AS c FROM lm), u AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM lm)),
w AS (SELECT rep, group_id, count(*) AS w FROM (SELECT rep, {md5_sql("'i11'", "'all'", 'rep', 'i')} % n AS i FROM u, unnest(range({B})) AS q(rep)) JOIN u USING (i) GROUP BY ALL),
m AS (SELECT rep, method, sum(c * w) / sum(w) AS m FROM c JOIN w USING (group_id) GROUP BY ALL) SELECT round(avg(x), 6) AS null_max FROM (SELECT rep, max(m) AS x FROM m GROUP BY rep)""")
def _(t):
    return inference.expected_maximum(long_scores(t), "group_id", "method", "v", B, "i11").select(r6("null_max").alias("null_max"))


# Period effects by region: datasets of the pooling operators
YE_SQL = f"""{DIFFS_SQL}, ye AS (SELECT 'set' || (location % 4) AS dataset, period, round(avg(diff), 6) AS d, CASE WHEN location % 4 = 3 OR count(*) < 2 THEN 0 ELSE round(coalesce(stddev_samp(diff) / sqrt(count(*)), 0), 6) END AS se, count(*) AS n_env FROM df GROUP BY location % 4, period),
pos AS (SELECT dataset, quantile_cont(se, 0.5) FILTER (se > 1e-12) AS med FROM ye GROUP BY dataset), alls AS (SELECT quantile_cont(se, 0.5) FILTER (se > 1e-12) AS med FROM ye),
fl AS (SELECT ye.dataset, period, d, n_env, se <= 1e-12 AS se_zero, coalesce(greatest(se, coalesce(pos.med, alls.med)), se) AS se FROM ye JOIN pos USING (dataset), alls)"""
DL_SQL = """xw AS (SELECT *, 1 / (se * se) AS w FROM fl WHERE se > 0), mu AS (SELECT dataset, sum(w * d) / sum(w) AS mu FROM xw GROUP BY dataset),
qq AS (SELECT dataset, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * (d - mu) * (d - mu)) AS q FROM xw JOIN mu USING (dataset) GROUP BY dataset),
t2 AS (SELECT dataset, k, q, CASE WHEN k > 1 THEN greatest(0, coalesce((q - (k - 1)) / nullif(sw - sww / sw, 0), 0)) ELSE 0 END AS tau2 FROM qq),
wx AS (SELECT dataset, d, k, q, tau2, 1 / (se * se + tau2) AS ws FROM xw JOIN t2 USING (dataset)),
dl AS (SELECT dataset, count(*) AS k, sum(ws * d) / sum(ws) AS est, sqrt(1 / sum(ws)) AS pooled_se, any_value(tau2) AS tau2, any_value(q) AS q, max(ws) / sum(ws) AS largest_share FROM wx GROUP BY dataset)"""


def year_table(t):
    d = diffs(t).withColumn("dataset", F.concat(F.lit("set"), (F.col("location") % 4).cast("string")))
    se = F.when((F.col("dataset") == "set3") | (F.col("n_env") < 2), 0.0).otherwise(r6(F.coalesce(F.try_divide(F.col("__s"), F.sqrt("n_env")), F.lit(0.0))))
    return staged(d.groupBy("dataset", "period").agg(r6(F.avg("diff")).alias("d"), F.stddev_samp("diff").alias("__s"), F.count(F.lit(1)).alias("n_env")).withColumn("se", se).drop("__s"), "year-table")


@query("i12_floor_se", f"WITH {YE_SQL} SELECT dataset, period, d, n_env, se_zero, round(se, 6) AS se FROM fl")
def _(t):
    return inference.floor_se(year_table(t), "dataset").withColumn("se", r6("se"))


@query("i13_zero_only", f"""WITH {YE_SQL} SELECT ye.dataset, period, d, n_env, se <= 1e-12 AS se_zero, round(CASE WHEN se <= 1e-12 THEN coalesce(pos.med, alls.med, se) ELSE se END, 6) AS se FROM ye JOIN pos USING (dataset), alls""")
def _(t):
    return inference.floor_se(year_table(t), "dataset", zero_only=True).withColumn("se", r6("se"))


@query("i14_dersimonian_laird", f"""WITH {YE_SQL}, {DL_SQL} SELECT dataset, k, round(est, 6) AS est, round(pooled_se, 6) AS pooled_se, round(tau2, 6) AS tau2, round(q, 6) AS q, round(largest_share, 6) AS largest_share,
round(est - 1.959963984540054 * pooled_se, 6) AS lo, round(est + 1.959963984540054 * pooled_se, 6) AS hi, round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END, 6) AS i2 FROM dl""")
def _(t):
    d = inference.dersimonian_laird(inference.floor_se(year_table(t), "dataset"), ["dataset"])
    return d.select("dataset", "k", *(r6(c).alias(c) for c in ("est", "pooled_se", "tau2", "q", "largest_share", "lo", "hi", "i2")))


@query("i15_hartung_knapp", f"""WITH {YE_SQL}, {DL_SQL}, tq AS (SELECT * FROM (VALUES (2, {inference.t_quantile(0.975, 1)}), (3, {inference.t_quantile(0.975, 2)}), (4, {inference.t_quantile(0.975, 3)})) AS v(k, tv)),
hk AS (SELECT wx.dataset, any_value(dl.k) AS k, any_value(est) AS est, sqrt(sum(ws * (d - est) * (d - est)) / nullif((any_value(dl.k) - 1) * sum(ws), 0)) AS hk_se FROM wx JOIN dl USING (dataset) GROUP BY wx.dataset)
SELECT dataset, hk.k, round(est, 6) AS est, round(hk_se, 6) AS hk_se, round(est - tv * hk_se, 5) AS lo, round(est + tv * hk_se, 5) AS hi FROM hk LEFT JOIN tq ON tq.k = hk.k""")
def _(t):
    d = inference.hartung_knapp(inference.floor_se(year_table(t), "dataset"), ["dataset"])
    return d.select("dataset", "k", r6("est").alias("est"), r6("hk_se").alias("hk_se"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@query("i16_i17_verdict", f"""WITH {YE_SQL}, {DL_SQL}, v AS (SELECT dataset, est, est - 1.959963984540054 * pooled_se AS lo, est + 1.959963984540054 * pooled_se AS hi, 3 / sqrt((SELECT count(*) FROM pred)) AS res FROM dl)
SELECT dataset, round(res, 6) AS resolution, CASE WHEN lo > 0 OR hi < 0 THEN (CASE WHEN abs(est) >= res THEN 'resolved' ELSE 'detectable' END) || (CASE WHEN est > 0 THEN ' gain' ELSE ' loss' END) ELSE 'tied' END AS verdict FROM v""")
def _(t):
    n = t.pred.agg(F.count(F.lit(1)).alias("n_cells"))
    d = inference.dersimonian_laird(inference.floor_se(year_table(t), "dataset"), ["dataset"]).crossJoin(F.broadcast(n)).withColumn("resolution", inference.resolution(F.col("n_cells")))
    return d.select("dataset", r6("resolution").alias("resolution"), inference.verdict(F.col("est"), F.col("lo"), F.col("hi"), F.col("resolution")).alias("verdict"))


@query("i18_holm", """
WITH p AS (SELECT location % 5 AS fam, group_id, round(1 / (1 + abs(sum(cv)) + 20.0 * abs(avg(cv))), 6) AS p FROM centred WHERE period = 1998 AND entity % 3 = 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, group_id) AS i, count(*) OVER (PARTITION BY fam) AS m FROM p)
SELECT fam, group_id, p, round(0.05 / (m - i + 1), 9) AS level, round(least(1, max((m - i + 1) * p) OVER w), 6) AS p_holm, min((p <= 0.05 / (m - i + 1))::INT) OVER w = 1 AS rejected FROM o WINDOW w AS (PARTITION BY fam ORDER BY p, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    p = t.centred.filter("period = 1998 and entity % 3 = 0").groupBy((F.col("location") % 5).alias("fam"), "group_id").agg(r6(1 / (1 + F.abs(F.sum("cv")) + 20.0 * F.abs(F.avg("cv")))).alias("p"))
    d = inference.holm(p, ["fam"], "p", "group_id")
    return d.select("fam", "group_id", "p", F.round("level", 9).alias("level"), r6("p_holm").alias("p_holm"), "rejected")


@query("i19_minimum_detectable", f"""WITH {YE_SQL}, {DL_SQL} SELECT dataset, round(2 * 1.959963984540054 * pooled_se / (2 * 1.959963984540054) * (1.959963984540054 + 0.8416212335729143), 6) AS mde FROM dl""")
def _(t):
    d = inference.dersimonian_laird(inference.floor_se(year_table(t), "dataset"), ["dataset"])
    return d.select("dataset", r6(inference.minimum_detectable(F.col("lo"), F.col("hi"))).alias("mde"))


@query("i21_size_ratio", "WITH n AS (SELECT period, group_id, count(*)::DOUBLE AS n FROM cells GROUP BY ALL) SELECT period, round(sqrt(sum(n) * sum(1 / n)) / count(*), 6) AS ratio FROM n GROUP BY period")
def _(t):
    n = t.cells.groupBy("period", "group_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy("period").agg(r6(inference.size_ratio("n")).alias("ratio"))


@query("i22_sign_test", f"""WITH {DIFFS_SQL}, s AS (SELECT period, count(*) FILTER (diff > 0) AS pos, count(*) AS n FROM df GROUP BY period)
SELECT period, pos, n, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM unnest(range(pos, n + 1)) AS q(k)), 6) AS p FROM s""")
def _(t):
    s = diffs(t).groupBy("period").agg(F.count_if(F.col("diff") > 0).alias("pos"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("p", r6(inference.sign_test(F.col("pos"), F.col("n"))))


@query("i24_all_hold", "SELECT location, bool_and(value > 20) AS holds, count(*) AS settings FROM cells GROUP BY location")
def _(t):
    return inference.all_hold(t.cells, ["location"], F.col("value") > 20)


@query("k8_scorer", f"""WITH {RANKED}, pd AS (SELECT *, 'set' || (location % 3) AS dataset FROM r),
pg AS (SELECT dataset, period, group_id, {corr_sql('rv', 'rs')} - {corr_sql('rv', 'rb')} AS sp,
  (avg(value) FILTER (ps <= k) - avg(value) FILTER (pb <= k)) / stddev_samp(value) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score_b, 9) DESC, entity) AS pb FROM pd) GROUP BY ALL HAVING count(*) >= 25),
d AS (SELECT 'spearman' AS metric, dataset, period, group_id, sp AS diff FROM pg WHERE sp IS NOT NULL UNION ALL SELECT 'sel_diff', dataset, period, group_id, sd FROM pg WHERE sd IS NOT NULL),
bn AS (SELECT *, row_number() OVER (PARTITION BY metric, dataset, period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY metric, dataset, period) AS n FROM d),
bd AS (SELECT metric, dataset, period, rep, {md5_sql("'k8' || metric", 'dataset', 'period', 'rep', 'i')} % n AS i FROM bn, unnest(range({B})) AS q(rep)),
bm AS (SELECT metric, dataset, period, rep, avg(diff) AS m FROM bd JOIN bn USING (metric, dataset, period, i) GROUP BY ALL), bs AS (SELECT metric, dataset, period, coalesce(stddev_samp(m), 0) AS se FROM bm GROUP BY ALL),
ye AS (SELECT metric, dataset, period, avg(diff) AS d, any_value(se) AS se FROM d JOIN bs USING (metric, dataset, period) GROUP BY ALL),
pos AS (SELECT metric, dataset, quantile_cont(se, 0.5) FILTER (se > 1e-12) AS med FROM ye GROUP BY ALL), alls AS (SELECT metric, quantile_cont(se, 0.5) FILTER (se > 1e-12) AS allmed FROM ye GROUP BY ALL),
fl AS (SELECT metric, dataset, period, d, greatest(se, coalesce(med, allmed)) AS se FROM ye JOIN pos USING (metric, dataset) JOIN alls USING (metric)),
xw AS (SELECT *, 1 / (se * se) AS w FROM fl WHERE se > 0), mu AS (SELECT metric, dataset, sum(w * d) / sum(w) AS mu FROM xw GROUP BY ALL),
qq AS (SELECT metric, dataset, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * (d - mu) * (d - mu)) AS q FROM xw JOIN mu USING (metric, dataset) GROUP BY ALL),
t2 AS (SELECT metric, dataset, CASE WHEN k > 1 THEN greatest(0, coalesce((q - (k - 1)) / nullif(sw - sww / sw, 0), 0)) ELSE 0 END AS tau2 FROM qq),
dl AS (SELECT metric, dataset, count(*) AS k, sum(d / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS est, sqrt(1 / sum(1 / (se * se + tau2))) AS pse, any_value(tau2) AS tau2 FROM xw JOIN t2 USING (metric, dataset) GROUP BY ALL),
v AS (SELECT *, est - 1.959963984540054 * pse AS lo, est + 1.959963984540054 * pse AS hi, 3 / sqrt((SELECT count(*) FROM pd WHERE pd.dataset = dl.dataset)) AS res FROM dl)
SELECT metric, dataset, k, round(est, 6) AS est, round(pse, 6) AS pooled_se, round(lo, 6) AS lo, round(hi, 6) AS hi, round(tau2, 6) AS tau2, round(res, 6) AS resolution,
  CASE WHEN lo > 0 OR hi < 0 THEN (CASE WHEN abs(est) >= res THEN 'resolved' ELSE 'detectable' END) || (CASE WHEN est > 0 THEN ' gain' ELSE ' loss' END) ELSE 'tied' END AS verdict FROM v""")
def k8_scorer(t):
    p = t.pred.withColumn("dataset", F.concat(F.lit("set"), (F.col("location") % 3).cast("string")))
    d = ensemble.score_submission(p, "dataset", "period", "group_id", "entity", "value", "score_a", "score_b", b=B)
    return d.select("metric", "dataset", "k", *(r6(c).alias(c) for c in ("est", "pooled_se", "lo", "hi", "tau2", "resolution")), "verdict")


# Splits


@query("s1_balanced_groups", "SELECT entity, (row_number() OVER (ORDER BY md5('s1|' || entity), entity) - 1) % 5 AS fold FROM (SELECT DISTINCT entity FROM cells)")
def _(t):
    return splits.balanced_groups(t.cells, "entity", 5, "s1")


@query("s2_grouped_folds", """
WITH g AS (SELECT entity, (row_number() OVER (ORDER BY md5('s2|' || entity), entity) - 1) % 5 AS part FROM (SELECT DISTINCT entity FROM cells))
SELECT group_id, entity, fold::INT AS fold, CASE WHEN part = fold THEN 'test' WHEN part = (fold + 1) % 5 THEN 'val' ELSE 'train' END AS role FROM cells JOIN g USING (entity), unnest(range(5)) AS q(fold)""")
def _(t):
    return splits.grouped_folds(t.cells, "entity", 5, "s2").select("group_id", "entity", "fold", "role")


@query("s3_two_way_folds", """
WITH a AS (SELECT entity, (row_number() OVER (ORDER BY md5('s3a|' || entity), entity) - 1) % 4 AS a FROM (SELECT DISTINCT entity FROM cells)), b AS (SELECT location, (row_number() OVER (ORDER BY md5('s3b|' || location), location) - 1) % 4 AS b FROM (SELECT DISTINCT location FROM cells)),
r AS (SELECT fold, CASE WHEN a = fold AND b = fold THEN 'test' WHEN a = (fold + 1) % 4 AND b = (fold + 1) % 4 THEN 'val' WHEN a IN (fold, (fold + 1) % 4) OR b IN (fold, (fold + 1) % 4) THEN 'drop' ELSE 'train' END AS role FROM cells JOIN a USING (entity) JOIN b USING (location), unnest(range(4)) AS q(fold))
SELECT fold::INT AS fold, role, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    return splits.two_way_folds(t.cells, "entity", "location", 4, "s3").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("s4_s10_forward_splits", """
WITH s AS (SELECT * FROM (VALUES ('f97', 1995, 1996, 1996, 1997), ('f99', 1996, 1997, 1998, 1999)) AS v(scenario, te, vp, re, tp)),
r AS (SELECT scenario, entity, CASE WHEN period <= te THEN 'train' WHEN period = vp THEN 'val' WHEN period = tp THEN 'test' WHEN period <= re THEN 'refit_extra' ELSE 'drop' END AS role FROM cells, s) SELECT scenario, role, count(*) AS n, count(DISTINCT entity) AS entities FROM r GROUP BY ALL""")
def _(t):
    s = t.spark.createDataFrame([("f97", 1995, 1996, 1996, 1997), ("f99", 1996, 1997, 1998, 1999)], "scenario string, train_end int, val_period int, refit_end int, test_period int")
    return splits.split_summary(splits.forward_splits(t.cells, s, "period"), ["scenario"], "entity")


@query("s6_history_folds", """
WITH g AS (SELECT target, entity, (row_number() OVER (PARTITION BY target ORDER BY md5('s6|' || entity), entity) - 1) % 5 AS fold FROM (SELECT DISTINCT target, entity FROM hist)) SELECT target, fold, count(*) AS n, count(DISTINCT entity) AS entities FROM hist JOIN g USING (target, entity) GROUP BY ALL""")
def _(t):
    return splits.history_folds(t.hist, "entity", "target", 5, "s6").groupBy("target", "fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"))


@query("s7_stratified_folds", "SELECT group_id, entity, (row_number() OVER (PARTITION BY group_id ORDER BY md5('s7|' || group_id || '|' || entity), entity) - 1) % 5 AS fold FROM cells")
def _(t):
    return splits.stratified_folds(t.cells, "group_id", "entity", 5, "s7").select("group_id", "entity", "fold")


@query("s8_sparse_mask", f"""
WITH c AS (SELECT * FROM cells WHERE period = 1998), o AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER (PARTITION BY entity ORDER BY md5('s8|' || group_id), group_id) - 1 AS p, {md5_sql("'s8s'", 'entity')} AS h FROM c)
SELECT group_id, entity, ((p - h % n) % n + n) % n < CASE WHEN n = 1 THEN 1 ELSE greatest(1, least(floor(0.5 * n + 0.5), n - 1)) END AS observed FROM o""")
def _(t):
    return splits.sparse_mask(t.cells.filter("period = 1998"), "group_id", "entity", 0.5, "s8").select("group_id", "entity", "observed")


@query("s9_leave_out_folds", "SELECT o.period AS left_out, CASE WHEN c.period = o.period THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM cells c, (SELECT DISTINCT period FROM cells) o GROUP BY ALL")
def _(t):
    return splits.leave_out_folds(t.cells, "period").groupBy("left_out", "role").agg(F.count(F.lit(1)).alias("n"))


@query("s11_hash_sample", f"SELECT group_id, entity FROM cells WHERE {md5_sql(chr(39) + 's11' + chr(39), 'entity')} < 2576980377 OR entity IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def _(t):
    return splits.hash_sample(t.cells, "entity", 0.6, "s11", t.table("part").filter("p_size = 1").select(F.col("p_partkey").alias("entity"))).select("group_id", "entity")


# Features


@query("f1_mode_scaler", """
WITH tr AS (SELECT * FROM feats), n AS (SELECT feature, d, count(*) AS n FROM tr WHERE d IS NOT NULL GROUP BY ALL), m AS (SELECT feature, d AS fill FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, d) AS k FROM n) WHERE k = 1)
SELECT feature, fill, round(avg(coalesce(d, fill)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(d, fill)) < 1e-6 THEN 1 ELSE stddev_pop(coalesce(d, fill)) END, 6) AS sd FROM tr JOIN m USING (feature) GROUP BY ALL""")
def _(t):
    s = features.mode_scaler(t.feats, "feature", "d")
    return s.select("feature", "fill", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("f2_mean_scaled", """
WITH s AS (SELECT feature, avg(d) AS m FROM feats WHERE entity % 5 <> 0 GROUP BY feature), v AS (SELECT feature, m, stddev_pop(coalesce(d, m)) AS sd FROM feats JOIN s USING (feature) WHERE entity % 5 <> 0 GROUP BY ALL HAVING stddev_pop(coalesce(d, m)) > 1e-9)
SELECT entity, feature, round((coalesce(d, m) - m) / sd, 6) AS z FROM feats JOIN v USING (feature)""")
def _(t):
    s = features.mean_scaler(t.feats.filter("entity % 5 <> 0"), "feature", "d")
    return features.scale(t.feats, s, "feature", "d").select("entity", "feature", r6("z").alias("z"))


@query("f3_weighted_scaler", """
WITH c AS (SELECT entity, count(*)::DOUBLE AS w FROM cells GROUP BY entity), x AS (SELECT feature, d::DOUBLE AS d, w FROM feats JOIN c USING (entity) WHERE d IS NOT NULL), m AS (SELECT feature, sum(w * d) / sum(w) AS mean, sum(w * d * d) / sum(w) AS m2 FROM x GROUP BY feature)
SELECT feature, round(mean, 6) AS mean, round(sqrt(greatest(m2 - mean * mean, 0)), 6) AS sd FROM m WHERE sqrt(greatest(m2 - mean * mean, 0)) > 1e-9""")
def _(t):
    s = features.weighted_scaler(t.feats, t.cells.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", "feature", "d")
    return s.select("feature", r6("mean").alias("mean"), r6("sd").alias("sd"))


VECTORS_SQL = "v AS MATERIALIZED (SELECT entity, list(dosage::DOUBLE ORDER BY feature) AS x FROM feats GROUP BY entity)"


def dosage_arrays(t):
    return staged(t.feats.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.col("dosage").cast("double").alias("d")))), lambda s: s["d"]).alias("x")), "dosage-arrays")


@query("f7_gram", f"WITH {VECTORS_SQL} SELECT a.entity AS i, b.entity AS j, list_dot_product(a.x, b.x) AS k FROM v a, v b WHERE a.entity % 100 = 0")
def _(t):
    x = dosage_arrays(t)
    return nearest.inner_products(x, x.filter("entity % 100 = 0"), "entity", "x")


@query("f8_f9_kernels", f"""
WITH p AS (SELECT feature, avg(dosage) / 2 AS p FROM feats GROUP BY feature), c AS (SELECT sum(2 * p * (1 - p)) AS c FROM p), v AS MATERIALIZED (SELECT entity, list(dosage - 2 * p ORDER BY feature) AS x FROM feats JOIN p USING (feature) GROUP BY entity),
g AS (SELECT a.entity AS i, b.entity AS j, list_dot_product(a.x, b.x) / c AS k, sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) / c AS norm FROM v a, v b, c WHERE a.entity % 100 = 0), h AS (SELECT *, greatest(-1, least(1, k / norm)) AS c FROM g)
SELECT i, j, round(k, 5) AS vanraden, round(norm / pi() * (sin(acos(c)) + (pi() - acos(c)) * cos(acos(c))), 4) AS arc FROM h""")
def _(t):
    x, scale = features.vanraden_arrays(dosage_arrays(t), "x")
    x = staged(x.withColumn("d", blocks.dot(F.col("x"), F.col("x"))), "centred-arrays")
    g = nearest.inner_products(x, x.filter("entity % 100 = 0"), "entity", "x").join(x.select(F.col("entity").alias("i"), F.col("d").alias("di")), "i").join(x.select(F.col("entity").alias("j"), F.col("d").alias("dj")), "j")
    k, di, dj = (F.col(c) / scale for c in ("k", "di", "dj"))
    return g.select("i", "j", F.round(k, 5).alias("vanraden"), F.round(features.arc_cosine(k, di, dj), 4).alias("arc"))


@query("f11_mixed_correlation", f"WITH {VECTORS_SQL} SELECT a.entity AS i, b.entity AS j, round(CASE WHEN a.entity = b.entity THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE * list_dot_product(a.x, b.x), 6) AS k FROM v a, v b WHERE a.entity % 100 = 0")
def _(t):
    x = dosage_arrays(t)
    return features.mixed_correlation(nearest.inner_products(x, x.filter("entity % 100 = 0"), "entity", "x"), 0.4).withColumn("k", r6("k"))


@query("f12_weather", """
SELECT group_id, day, round((least(greatest(v_max / 10, 10), 30) + least(greatest(v_min / 10, 10), 30)) / 2 - 10, 6) AS gdd, round(0.6108 * exp(17.27 * (v_avg / 10) / (v_avg / 10 + 237.3)) * (1 - 40 / 100.0::DOUBLE), 6) AS vpd FROM daily""")
def _(t):
    return t.daily.select("group_id", "day", r6(features.growing_degrees(F.col("v_max") / 10, F.col("v_min") / 10, 10.0, 30.0)).alias("gdd"), r6(features.vapour_deficit(F.col("v_avg") / 10, F.lit(40.0))).alias("vpd"))


@query("f13_season_windows", """
WITH d AS (SELECT *, sum(n) OVER (PARTITION BY group_id ORDER BY day) AS cum, sum(n) OVER (PARTITION BY group_id ORDER BY day) - n AS prev FROM daily), a AS (SELECT group_id, sum(n) / 3.0::DOUBLE AS anchor FROM daily GROUP BY group_id), w AS (SELECT * FROM (VALUES ('pre', -30.0::DOUBLE, 0.0::DOUBLE), ('post', 0, 40)) AS v("window", lo, hi))
SELECT group_id, "window", count(*) AS days, round(avg(v_max), 5) AS mean_v_max, round(avg(v_min), 5) AS mean_v_min, max(cum) >= any_value(anchor + hi) AS complete FROM d JOIN a USING (group_id), w WHERE cum > anchor + lo AND prev < anchor + hi GROUP BY ALL""")
def _(t):
    d = t.daily.withColumn("cum", F.sum("n").over(windows.Window.partitionBy("group_id").orderBy("day")).cast("double"))
    a = t.daily.groupBy("group_id").agg((F.sum("n") / 3.0).alias("anchor"))
    w = t.spark.createDataFrame([("pre", -30.0, 0.0), ("post", 0.0, 40.0)], "window string, lo double, hi double")
    s = features.season_windows(d, a, w, "group_id", "day", "cum", ["v_max", "v_min"])
    return s.select("group_id", "window", "days", F.round("mean_v_max", 5).alias("mean_v_max"), F.round("mean_v_min", 5).alias("mean_v_min"), "complete")


@query("f15_window_search", f"""
WITH s AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY day) AS k, v_max FROM daily), y AS (SELECT group_id, avg(v_min) AS y FROM daily GROUP BY group_id), g AS (SELECT * FROM (VALUES (1, 3), (1, 6), (5, 3), (5, 6), (9, 3), (9, 6)) AS v(start, length)),
c AS (SELECT start, length, s.group_id, avg(v_max) AS x, any_value(y) AS y FROM g JOIN s ON k BETWEEN start AND start + length - 1 JOIN y USING (group_id) GROUP BY ALL HAVING count(*) = length) SELECT start, length, round({corr_sql('x', 'y')}, 5) AS r, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    s = t.daily.withColumn("k", F.row_number().over(windows.Window.partitionBy("group_id").orderBy("day")))
    y = t.daily.groupBy("group_id").agg(F.avg("v_min").alias("y"))
    return features.window_search(s, y, "group_id", "k", "v_max", "y", [1, 5, 9], [3, 6]).withColumn("r", F.round("r", 5))


# Ensembles


@query("k1_stack_sums", """
WITH z AS (SELECT group_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS zv, (score_a - avg(score_a) OVER w) / nullif(stddev_pop(score_a) OVER w, 0) AS za, (score_b - avg(score_b) OVER w) / nullif(stddev_pop(score_b) OVER w, 0) AS zb FROM pred WINDOW w AS (PARTITION BY group_id)),
g AS (SELECT group_id, avg(za * zv) AS ca, avg(zb * zv) AS cb, avg(za * za) AS saa, avg(za * zb) AS sab, avg(zb * zb) AS sbb FROM z GROUP BY group_id)
SELECT round(avg(ca), 6) AS c_score_a, round(avg(cb), 6) AS c_score_b, round(avg(saa), 6) AS s_score_a_score_a, round(avg(sab), 6) AS s_score_a_score_b, round(avg(sbb), 6) AS s_score_b_score_b FROM g""")
def _(t):
    d = ensemble.stack_sums(t.pred, "group_id", "entity", "value", ["score_a", "score_b"])
    return d.select(*(r6(c).alias(c) for c in d.columns))


@query("k2_rules", """
WITH z AS (SELECT group_id, entity, coalesce((score_a - avg(score_a) OVER w) / nullif(stddev_pop(score_a) OVER w, 0), 0) AS za, coalesce((score_b - avg(score_b) OVER w) / nullif(stddev_pop(score_b) OVER w, 0), 0) AS zb FROM pred WINDOW w AS (PARTITION BY group_id))
SELECT 'equal' AS "rule", group_id, entity, round(0.5 * za + 0.5 * zb, 6) AS score FROM z UNION ALL SELECT 'first', group_id, entity, round(za, 6) FROM z""")
def _(t):
    p = t.pred.unpivot(["group_id", "entity"], ["score_a", "score_b"], "method", "score")
    w = t.spark.createDataFrame([("equal", "score_a", 0.5), ("equal", "score_b", 0.5), ("first", "score_a", 1.0)], "rule string, method string, weight double")
    return ensemble.apply_rules(p, "group_id", ["group_id", "entity"], w).withColumn("score", r6("score"))


@query("k4_seed_average", "SELECT group_id, entity, round(avg(value), 6) AS value, count(*) AS n_seeds FROM plots GROUP BY ALL")
def _(t):
    return ensemble.seed_average(t.plots, ["group_id", "entity"], "value").withColumn("value", r6("value"))


@query("k5_similarity_average", """
WITH g AS (SELECT DISTINCT group_id, location % 10 AS station, location % 4 AS state FROM cells WHERE period = 1998 AND location < 40), v AS (SELECT c.group_id, c.entity, c.value FROM cells c WHERE period = 1998 AND location < 40)
SELECT a.group_id AS to_group, v.entity, round(sum((0.1::DOUBLE + 2 * (b.station = a.station)::INT + 2 * (b.state = a.state)::INT) * v.value) / sum(0.1::DOUBLE + 2 * (b.station = a.station)::INT + 2 * (b.state = a.state)::INT), 6) AS score
FROM g a JOIN g b ON a.group_id <> b.group_id JOIN v ON v.group_id = b.group_id GROUP BY ALL""")
def _(t):
    c = t.cells.filter("period = 1998 and location < 40")
    g = c.select("group_id", (F.col("location") % 10).alias("station"), (F.col("location") % 4).alias("state")).distinct()
    return ensemble.similarity_average(g, c.select("group_id", "entity", "value"), "group_id", "station", "state", "entity", "value").withColumn("score", r6("score"))


@query("k8_check_submission", """
WITH s AS (SELECT 'set' || (location % 3) AS dataset, group_id, entity, CASE WHEN entity % 50 > 0 THEN score_a END AS pred FROM pred UNION ALL SELECT 'set0', group_id, entity, score_b FROM pred WHERE entity % 40 = 1 AND location % 3 = 0)
SELECT count(*) AS rows, count(*) FILTER (pred IS NULL) AS empty_predictions, (SELECT count(*) FROM (SELECT dataset, group_id, entity FROM s GROUP BY ALL HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(DISTINCT dataset) FROM s WHERE dataset NOT IN ('set0', 'set1')) AS unknown_datasets FROM s""")
def _(t):
    a = t.pred.select(F.concat(F.lit("set"), (F.col("location") % 3).cast("string")).alias("dataset"), "group_id", "entity", F.when(F.col("entity") % 50 > 0, F.col("score_a")).alias("pred"))
    b = t.pred.filter("entity % 40 = 1 and location % 3 = 0").select(F.lit("set0").alias("dataset"), "group_id", "entity", F.col("score_b").alias("pred"))
    known = t.spark.createDataFrame([("set0",), ("set1",)], "dataset string")
    return ensemble.check_submission(a.unionByName(b), ["dataset", "group_id", "entity", "pred"], ["dataset", "group_id", "entity"], known, "dataset")


@query("k15_scramble_audit", "SELECT 0::BIGINT AS unmatched, 1.0::DOUBLE AS r, 0.0::DOUBLE AS max_abs_diff")
def _(t):
    def job(cells):
        c = cells.withColumn("cv", r6(windows.center("value", "group_id")))
        return c.filter("period < 1998").groupBy("entity").agg(r6(F.avg("cv")).alias("score"))

    noisy = ensemble.scrambled(t.cells, "period", 1998, "value", F.col("group_id"), F.col("entity"))
    d = ensemble.same_output(job(t.cells), job(noisy), ["entity"], "score")
    return d.select("unmatched", r6("r").alias("r"), "max_abs_diff")


@query("k16_fingerprint", """
SELECT count(*) AS n, sum(('0x' || substr(md5(group_id || '|' || entity || '|' || n_plots), 1, 10))::BIGINT)::VARCHAR AS digest FROM cells""")
def _(t):
    return ensemble.fingerprint(t.cells, ["group_id", "entity", "n_plots"])


@query("k17_same_output", f"SELECT 0::BIGINT AS unmatched, round({corr_sql('score_a', 'score_b')}, 6) AS r, round(max(abs(score_a - score_b)), 6) AS max_abs_diff FROM pred")
def _(t):
    d = ensemble.same_output(t.pred, t.pred.select("group_id", "entity", F.col("score_b").alias("score_a")), ["group_id", "entity"], "score_a")
    return d.select("unmatched", r6("r").alias("r"), r6("max_abs_diff").alias("max_abs_diff"))


@query("k18_reconcile", """
WITH c AS (SELECT 'p' || period AS key, avg(value) AS computed FROM cells GROUP BY period), e AS (SELECT key, CASE WHEN key = 'p1996' THEN NULL WHEN key = 'p1997' THEN round(computed, 2) + 1 ELSE round(computed, 2) END AS printed, 2 AS decimals FROM c UNION ALL SELECT 'none', 1.0, 2)
SELECT e.key, round(printed, 2) AS printed, CASE WHEN printed IS NULL THEN 'SKIP' WHEN computed IS NULL THEN 'UNCHECKED' WHEN abs(computed - printed) <= 0.005 + 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM e LEFT JOIN c USING (key)""")
def _(t):
    c = t.cells.groupBy(F.concat(F.lit("p"), F.col("period").cast("string")).alias("key")).agg(F.avg("value").alias("computed"))
    shown = F.round("computed", 2)
    e = c.select("key", F.when(F.col("key") == "p1996", None).when(F.col("key") == "p1997", shown + 1).otherwise(shown).alias("printed"), F.lit(2).alias("decimals"))
    e = e.unionByName(t.spark.createDataFrame([("none", 1.0, 2)], "key string, printed double, decimals int"))
    return ensemble.reconcile(e, c, "key").select("key", F.round("printed", 2).alias("printed"), "status")


# Cleaning


@query("b1_number", "SELECT p_partkey, try_cast(CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_size || '.5' END AS DOUBLE) AS x FROM part")
def _(t):
    p = t.table("part")
    text = F.when(F.col("p_partkey") % 7 == 0, "n/a").when(F.col("p_partkey") % 11 == 99, "NaN").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return p.select("p_partkey", clean.number(text).alias("x"))


@query("b2_b8_keys", r"""
SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS norm, regexp_replace(regexp_replace(upper(regexp_replace(p_name, '\([^)]*\)|\s+', '', 'g')), '[^A-Z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS line,
  try_cast(nullif(regexp_extract(p_brand, '#(\d+)', 1), '') AS INT) AS code FROM part""")
def _(t):
    return t.table("part").select("p_partkey", clean.norm_key(F.col("p_name")).alias("norm"), clean.line_key(F.col("p_name")).alias("line"), clean.code_number(F.col("p_brand"), r"#(\d+)").alias("code"))


@query("b3_b4_split", """
SELECT DISTINCT group_id, regexp_extract(group_id, '^(.*)_[^_]*$', 1) AS loc, split_part(group_id, '_', 2)::INT AS per, l_suppkey || '/' || period AS ped, l_suppkey || '' AS p1, period || '' AS p2 FROM (SELECT DISTINCT group_id, location AS l_suppkey, period FROM cells)""")
def _(t):
    c = t.cells.select("group_id", F.concat_ws("/", "location", "period").alias("ped")).distinct()
    one, two = clean.parents(F.col("ped"))
    return c.select("group_id", clean.location_of(F.col("group_id")).alias("loc"), clean.period_of(F.col("group_id")).alias("per"), "ped", one.alias("p1"), two.alias("p2"))


@query("b5_rollup", "SELECT DISTINCT c.group_id, n.n_name AS nation, r.r_name AS region FROM cells c JOIN supplier s ON s.s_suppkey = c.location JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def _(t):
    n = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return t.cells.select("group_id", "location").distinct().join(s, F.col("location") == F.col("s_suppkey")).select("group_id", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("b10_b12_dates", """
SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_totalprice BETWEEN 50000 AND 200000 THEN o_totalprice END AS price, (NOT o_totalprice BETWEEN 50000 AND 200000)::INT AS nothing FROM orders""")
def _(t):
    o = t.table("orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    d = o.select("o_orderkey", clean.any_date(text, "yyyyMMdd", "MM/dd/yyyy").alias("day"), clean.in_range(F.col("o_totalprice"), 50000, 200000).alias("price"))
    return d.withColumn("nothing", clean.all_null(["price"]))


@query("b13_recovered_dosage", "SELECT entity, feature, CASE WHEN (entity + feature) % 9 = 0 THEN NULL ELSE dosage END AS got FROM feats")
def _(t):
    v = F.when((F.col("entity") + F.col("feature")) % 9 == 0, 0.3).otherwise(F.col("dosage") / 2.0)
    return t.feats.select("entity", "feature", clean.recovered_dosage(v).alias("got"))


@query("b14_hybrid_dosage", """
WITH p AS (SELECT DISTINCT entity AS a, (entity * 7 + 5) % (SELECT count(*) FROM embeddings) AS b FROM feats) SELECT p.a, p.b, x.feature, round_even((x.d + y.d) / 2.0::DOUBLE, 0)::INT AS d FROM p JOIN feats x ON x.entity = p.a JOIN feats y ON y.entity = p.b AND y.feature = x.feature""")
def _(t):
    pairs = t.feats.select(F.col("entity").alias("a"), ((F.col("entity") * 7 + 5) % t.table("embeddings").count()).alias("b")).distinct()
    return features.hybrid_dosage(pairs, t.feats.select("entity", "feature", "d"), "a", "b", "entity", "feature", "d").select("a", "b", "feature", "d")


@query("b15_flip", """
WITH x AS (SELECT entity, feature, CASE WHEN feature % 3 = 0 THEN 2 - dosage ELSE dosage END AS v FROM feats), f AS (SELECT x.feature, count(*) FILTER (2 - v = dosage) > count(*) FILTER (v = dosage) AS flip FROM x JOIN feats USING (entity, feature) GROUP BY x.feature)
SELECT entity, feature, CASE WHEN flip THEN 2 - v ELSE v END AS v FROM x JOIN f USING (feature)""")
def _(t):
    x = t.feats.select("entity", "feature", F.when(F.col("feature") % 3 == 0, 2 - F.col("dosage")).otherwise(F.col("dosage")).alias("v"))
    return features.flip_to(t.feats.select("entity", "feature", F.col("dosage").alias("v")), x, "entity", "feature", "v").select("entity", "feature", "v")


@query("b17_b18_reshape", "SELECT group_id, entity, round(value, 6) AS value, round(score_a, 6) AS score_a FROM pred WHERE value IS NOT NULL")
def _(t):
    long = clean.melt(t.pred, ["group_id", "entity"], ["value", "score_a"])
    return clean.widen(long, ["group_id", "entity"], "variable", "value", ["value", "score_a"]).select("group_id", "entity", r6("value").alias("value"), r6("score_a").alias("score_a"))


@query("b19_maf", "SELECT feature, round(avg(d) / 2, 6) AS af, round(avg((d IS NOT NULL)::INT::DOUBLE), 6) AS call_rate FROM feats GROUP BY feature HAVING least(avg(d) / 2, 1 - avg(d) / 2) >= 0.05")
def _(t):
    return features.maf_filter(t.feats, "feature", "d").select("feature", r6("af").alias("af"), r6("call_rate").alias("call_rate"))


@query("b20_b22_bins", """
SELECT s_suppkey, round(floor(s_acctbal / 1.2) * 1.2, 6) AS bin, [s_suppkey * 1.0::DOUBLE * s_nationkey, s_suppkey * 2.0::DOUBLE, s_nationkey * 1.0::DOUBLE * s_nationkey, s_nationkey * 2.0::DOUBLE]::VARCHAR AS cross FROM supplier""")
def _(t):
    s = t.table("supplier")
    a, b = F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")), F.array(F.col("s_nationkey").cast("double"), F.lit(2.0))
    x = clean.interactions(a, b)
    return s.select("s_suppkey", r6(clean.grid_bin(F.col("s_acctbal"), 1.2)).alias("bin"), F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ", "), F.lit("]")).alias("cross"))


# Sources


@query("a1_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_quantity").filter("l_quantity >= 49")


@query("a3_a4_guards", "SELECT l_orderkey, l_linenumber, true AS has FROM lineitem WHERE l_quantity < 3")
def _(t):
    x = genotypes.whitelisted(t.table("lineitem").filter("l_quantity < 3"), ["l_orderkey", "l_linenumber", "l_quantity"], ["l_extendedprice"])
    return genotypes.presence_only(x, ["l_orderkey", "l_linenumber"], "l_quantity")


@query("a9_json", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE event_id < 2000")
def _(t):
    e = t.table("events").filter("event_id < 2000").select("event_id", F.concat(F.lit('{"v": {"20240101": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-999")), F.lit("}}")).alias("text"))
    return genotypes.daily_json(e, "text", ["event_id"]).select("event_id", "value")


@query("a18_missing_units", "SELECT l.location, p.period FROM (SELECT DISTINCT location FROM cells) l, (SELECT DISTINCT period FROM cells) p WHERE (l.location, p.period) NOT IN (SELECT (location, period) FROM cells WHERE n_plots > 1)")
def _(t):
    grid = t.cells.select("location").distinct().crossJoin(F.broadcast(t.cells.select("period").distinct()))
    return genotypes.missing_units(grid, t.cells.filter("n_plots > 1"), ["location", "period"])


@query("a20_replace_slice", """
WITH n AS (SELECT group_id, entity, period, -value AS value FROM cells) SELECT group_id, entity, period, value FROM cells WHERE period <> 1999 UNION ALL SELECT * FROM n WHERE (group_id, entity) IN (SELECT (group_id, entity) FROM cells WHERE period = 1999)""", ("value",))
def _(t):
    c = t.cells.select("group_id", "entity", "period", "value")
    return genotypes.replace_slice(c, c.withColumn("value", -F.col("value")), F.col("period") == 1999, ["group_id", "entity"])


# Sets


@query("o5_set_operations", "(SELECT entity FROM cells WHERE period = 1997 INTERSECT SELECT entity FROM cells WHERE period = 1998) EXCEPT SELECT entity FROM cells WHERE period = 1999")
def _(t):
    of = lambda y: t.cells.filter(F.col("period") == y).select("entity")
    return of(1997).intersect(of(1998)).subtract(of(1999))


@query("o6_duplicates", "SELECT group_id, entity, count(*) AS n FROM plots GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return t.plots.groupBy("group_id", "entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
