"""Queries of composed jobs and learners on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import aggs, ensemble, inference, joins, learners, metrics, models, splits
from harrow.operators.staging import staged
from harrow.operators.windows import center
from harrow.plans import panels
from harrow.plans.declare import query
from harrow.plans.queries_core import RANKED, corr_sql
from harrow.plans.queries_more import B, DIFFS_SQL, DL_SQL, YE_SQL, diffs, md5_sql, year_table
from harrow.plans.testbed import r6

PART = "p AS (SELECT p_partkey AS entity, p_size::DOUBLE AS f1, (p_retailprice / 100)::DOUBLE AS f2 FROM part)"


def part(t):
    return t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("f1"), (F.col("p_retailprice") / 100).alias("f2"))


def two_stage_sql(name: str, where: str, penalty: float, source: str = "cells") -> str:
    """CTEs that end in {name}(f1, f2 coefficients ca, cb)."""
    return f"""{name}m AS (SELECT entity, avg(value - gm) AS y FROM (SELECT *, avg(value) OVER (PARTITION BY group_id) AS gm FROM {source} WHERE {where}) GROUP BY entity),
{name}c AS (SELECT y - avg(y) OVER () AS y, f1 - avg(f1) OVER () AS a, f2 - avg(f2) OVER () AS b FROM {name}m JOIN p USING (entity)),
{name}n AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, {penalty}::DOUBLE * (sum(a * a) + sum(b * b)) / 2 AS l FROM {name}c),
{name} AS (SELECT ((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) AS ca, ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab) AS cb FROM {name}n)"""


@query("k19_forward_panel", f"""WITH {PART}, {two_stage_sql('ya', 'period < 1998', 0.1)}, {two_stage_sql('yb', 'period < 1999', 0.1)}
SELECT group_id, entity, period, round(ca * f1 + cb * f2, 5) AS score FROM cells JOIN p USING (entity), ya WHERE period = 1998 UNION ALL SELECT group_id, entity, period, round(ca * f1 + cb * f2, 5) FROM cells JOIN p USING (entity), yb WHERE period = 1999""")
def _(t):
    d = panels.forward_panel(t.cells, part(t), "group_id", "entity", "period", "value", ["f1", "f2"], [1998, 1999], 0.1)
    return d.withColumn("score", F.round("score", 5))


@query("k20_fold_panel", f"""WITH {PART}, fo AS (SELECT entity, (row_number() OVER (ORDER BY md5('k20|' || entity), entity) - 1) % 2 AS fold FROM (SELECT DISTINCT entity FROM cells WHERE period < 1998)),
fc AS (SELECT c.*, fold FROM cells c JOIN fo USING (entity) WHERE period < 1998), {two_stage_sql('za', 'fold <> 0', 0.1, 'fc')}, {two_stage_sql('zb', 'fold <> 1', 0.1, 'fc')}
SELECT group_id, entity, fold, round(ca * f1 + cb * f2, 5) AS score FROM fc JOIN p USING (entity), za WHERE fold = 0 UNION ALL SELECT group_id, entity, fold, round(ca * f1 + cb * f2, 5) FROM fc JOIN p USING (entity), zb WHERE fold = 1""")
def _(t):
    h = t.cells.filter("period < 1998")
    f = h.join(splits.balanced_groups(h, "entity", 2, "k20"), "entity")
    return panels.fold_panel(f, part(t), "group_id", "entity", "value", ["f1", "f2"], 2, 0.1).withColumn("score", F.round("score", 5))


@query("k9_k10_method_summary", f"""WITH {RANKED}, g AS (SELECT period, group_id, {corr_sql('rv', 'rs')} AS a, {corr_sql('rv', 'rb')} AS b FROM r GROUP BY ALL),
u AS (SELECT 'score_a' AS method, period, avg(a) AS m FROM g GROUP BY period UNION ALL SELECT 'score_b', period, avg(b) FROM g GROUP BY period) SELECT method, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(m) AS periods FROM u GROUP BY method""")
def _(t):
    both = t.pred.unpivot(["period", "group_id", "entity", "value"], ["score_a", "score_b"], "method", "score")
    d = panels.method_summary(metrics.spearman(both, ["method", "period", "group_id"], "entity", "value", "score"), "method", "period", "spearman")
    return d.select("method", r6("mean").alias("mean"), r6("sd").alias("sd"), "periods")


K11 = """m AS (SELECT period, entity, round(avg(value), 6) AS mean FROM cells GROUP BY ALL HAVING count(DISTINCT group_id) >= 2), s AS (SELECT period, entity, round(avg(score_a), 6) AS a, round(avg(score_b), 6) AS b FROM pred GROUP BY ALL),
d AS (SELECT * FROM m JOIN s USING (period, entity)), k AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY round(mean, 9)) + (count(*) OVER (PARTITION BY period, round(mean, 9)) - 1) / 2.0::DOUBLE AS rm,
rank() OVER (PARTITION BY period ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY period, round(a, 9)) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY period ORDER BY round(b, 9)) + (count(*) OVER (PARTITION BY period, round(b, 9)) - 1) / 2.0::DOUBLE AS rb FROM d)"""


@query("k11_population_contrast", f"WITH {K11} SELECT period, round({corr_sql('rm', 'ra')}, 4) AS r_one, round({corr_sql('rm', 'rb')}, 4) AS r_other, true AS has_se FROM k GROUP BY period")
def _(t):
    d = panels.population_contrast(t.cells, t.pred, "entity", "period", "group_id", "value", "score_a", "score_b", 10, "k11")
    return d.select("period", F.round("r_one", 4).alias("r_one"), F.round("r_other", 4).alias("r_other"), (F.col("se") > 0).alias("has_se"))


@query("k14_unit_effects", f"WITH {DIFFS_SQL}, a AS (SELECT period, location % 5 AS trait, avg(diff) AS d FROM df GROUP BY ALL) SELECT period, round(avg(d), 6) AS d, count(*) AS n FROM a GROUP BY period")
def _(t):
    return panels.unit_effects(diffs(t).withColumn("trait", F.col("location") % 5), ["trait"], ["period"], "diff").withColumn("d", r6("d"))


@query("i20_sensitivity", f"""WITH {YE_SQL}, {DL_SQL} SELECT 'all' AS variant, dataset, round(est, 6) AS est, round(pooled_se, 6) AS pooled_se, k FROM dl""")
def _(t):
    d = panels.sensitivity(year_table(t), "dataset", {"all": False, "zeros": True}).filter("variant = 'all'")
    return d.select("variant", "dataset", r6("est").alias("est"), r6("pooled_se").alias("pooled_se"), "k")


SEEDS = [f"s{k}" for k in range(20)]


@query("i23_seeds", f"""WITH {DIFFS_SQL}, bn AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY group_id) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM df),
bd AS (SELECT seed, period, rep, {md5_sql("'s' || seed", 'period', 'rep', 'i')} % n AS i FROM bn, unnest(range({B})) AS q(rep), unnest(range(20)) AS s(seed)), bm AS (SELECT seed, period, rep, avg(diff) AS m FROM bd JOIN bn USING (period, i) GROUP BY ALL),
u AS (SELECT seed, period, stddev_samp(m) AS se FROM bm GROUP BY ALL) SELECT period, round(min(se), 6) AS lowest, round(max(se), 6) AS highest, count(*) AS seeds FROM u GROUP BY period""")
def _(t):
    d = panels.seeds(diffs(t), ["period"], "group_id", "diff", B, SEEDS)
    return d.select("period", r6("lowest").alias("lowest"), r6("highest").alias("highest"), "seeds")


@query("i25_positive_periods", f"WITH {DIFFS_SQL}, y AS (SELECT period, avg(diff) AS d FROM df GROUP BY period) SELECT round(avg(d), 6) AS d, count(*) FILTER (d > 0) AS positive, count(*) AS periods FROM y")
def _(t):
    return diffs(t).groupBy("period").agg(F.avg("diff").alias("d")).agg(r6(F.avg("d")).alias("d"), F.count_if(F.col("d") > 0).alias("positive"), F.count(F.lit(1)).alias("periods"))


@query("d29_unit_variants", """
WITH c AS (SELECT c.*, p_brand AS b FROM cells c JOIN part ON p_partkey = entity)
SELECT 'group' AS variant, group_id AS unit, entity, round(value, 6) AS value FROM c UNION ALL SELECT 'centred', group_id, entity, round(value - avg(value) OVER (PARTITION BY group_id, b), 6) FROM c UNION ALL SELECT 'subgroup', group_id || '#' || b, entity, round(value, 6) FROM c""")
def _(t):
    s = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("subgroup"))
    return panels.unit_variants(t.cells, s, "group_id", "entity", "value").withColumn("value", r6("value"))


@query("d11_weighted_correlations", f"""
WITH c AS (SELECT a.period AS pa, b.period AS pb, count(*) AS n, {corr_sql('a.value', 'b.value')} AS r FROM cells a JOIN cells b ON a.entity = b.entity AND a.group_id < b.group_id GROUP BY a.group_id, b.group_id, a.period, b.period HAVING count(*) >= 5)
SELECT CASE WHEN pa = pb THEN 'same' ELSE 'other' END AS class, round(sum(r * (n - 3)) / sum(n - 3) FILTER (r IS NOT NULL), 6) AS r, count(r) AS n_defined FROM c GROUP BY ALL""")
def _(t):
    c = aggs.pair_correlations(t.cells, "group_id", "entity", "value", ["period"], 5)
    c = c.withColumn("class", F.when(F.col("a_period") == F.col("b_period"), "same").otherwise("other"))
    return aggs.weighted_mean(c, ["class"], "r", F.col("shared") - 3).withColumn("r", r6("r"))


@query("d28_reference_predictor", """
WITH u AS (SELECT target, location, p_brand AS brand, cv, NULL AS group_id, NULL AS entity FROM hist JOIN part ON p_partkey = entity UNION ALL SELECT period, location, p_brand, NULL, group_id, entity FROM cells JOIN part ON p_partkey = entity WHERE period IN (1997, 1998, 1999)),
m AS (SELECT group_id, entity, coalesce(avg(cv) OVER (PARTITION BY target, location, brand), avg(cv) OVER (PARTITION BY target, brand), 0) AS g FROM u) SELECT group_id, entity, round(g, 6) AS guess FROM m WHERE group_id IS NOT NULL""")
def _(t):
    brand = t.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("brand"))
    h = t.hist.join(brand, "entity")
    levels = [(h.groupBy(F.col("target").alias("period"), "location", "brand").agg(F.avg("cv").alias("m")), ["period", "location", "brand"], "m"),
              (h.groupBy(F.col("target").alias("period"), "brand").agg(F.avg("cv").alias("m")), ["period", "brand"], "m")]
    d = joins.fallback(t.cells.filter("period in (1997, 1998, 1999)").join(brand, "entity"), levels, "guess")
    return d.select("group_id", "entity", r6(F.coalesce("guess", F.lit(0.0))).alias("guess"))


@query("d32_distinct_cells_over_traits", "SELECT count(DISTINCT (l_suppkey, l_partkey)) AS n_cells, count(DISTINCT l_returnflag) AS traits FROM lineitem WHERE l_quantity > 10")
def _(t):
    return t.table("lineitem").filter("l_quantity > 10").agg(F.countDistinct("l_suppkey", "l_partkey").alias("n_cells"), F.countDistinct("l_returnflag").alias("traits"))


@query("f4_covariate_fill", """
WITH g0 AS (SELECT location, period, avg(quantity) AS q, avg(value) AS v FROM plots GROUP BY location, period), g AS (SELECT location, period, CASE WHEN (location + period) % 4 <> 0 THEN q END AS q, CASE WHEN location % 6 <> 0 THEN v END AS v FROM g0), l AS (SELECT location, avg(q) AS lq, avg(v) AS lv FROM g WHERE period < 1998 GROUP BY location),
m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(v, 0.5) AS mv FROM g WHERE period < 1998), x AS (SELECT g.location, period, (q IS NULL AND v IS NULL)::INT AS missing, coalesce(q, lq, mq, 0) AS q, coalesce(v, lv, mv, 0) AS v FROM g LEFT JOIN l USING (location), m),
s AS (SELECT avg(q) AS aq, stddev_samp(q) AS sq, avg(v) AS av, stddev_samp(v) AS sv FROM x WHERE period < 1998) SELECT location, period, missing, round((q - aq) / sq, 5) AS q, round((v - av) / sv, 5) AS v FROM x, s""")
def _(t):
    g = t.plots.groupBy("location", "period").agg(F.avg("quantity").alias("q"), F.avg("value").alias("v"))
    g = g.withColumns({"q": F.when((F.col("location") + F.col("period")) % 4 != 0, F.col("q")), "v": F.when(F.col("location") % 6 != 0, F.col("v"))})
    d = panels.covariate_fill(g, F.col("period") < 1998, "location", ["q", "v"])
    return d.select("location", "period", "missing", F.round("q", 5).alias("q"), F.round("v", 5).alias("v"))


@query("f5_principal_components")
def _(t):
    e = t.table("embeddings").select("vec_id", *(F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(64)))
    d = learners.principal_components(e, e, [f"x{i}" for i in range(64)], 8)
    return d.select("vec_id", *(r6(f"pc{i + 1}").alias(f"pc{i + 1}") for i in range(8)))


@query("j5_forest_and_boosting")
def _(t):
    d = t.pred.withColumn("y", center("value", "group_id"))
    train, test = staged(d.filter("period < 1999"), "forest-train"), d.filter("period = 1999")
    f = learners.forest(train, test, ["score_a", "score_b", "location"], "y", trees=300).withColumnRenamed("prediction", "forest")
    b = learners.boosting(train, f, ["score_a", "score_b", "location"], "y", rounds=60).withColumnRenamed("prediction", "boosting")
    return b.select("group_id", "entity", r6("forest").alias("forest"), r6("boosting").alias("boosting"))


@query("j7_interaction_ridge", """
WITH c AS (SELECT group_id, value - avg(value) OVER w AS y, score_a - avg(score_a) OVER w AS a, score_a * (location % 7) - avg(score_a * (location % 7)) OVER w AS b FROM pred WINDOW w AS (PARTITION BY group_id)), n AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, 0.1 * (sum(a * a) + sum(b * b)) / 2 AS l FROM c),
o AS (SELECT ((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) AS ca, ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab) AS cb FROM n) SELECT group_id, entity, round(ca * score_a + cb * score_a * (location % 7), 5) AS score FROM pred, o""")
def _(t):
    d, cols = panels.interaction_columns(t.pred.withColumn("e", (F.col("location") % 7).cast("double")), ["score_a"], ["e"])
    path = models.ridge_path(d, "group_id", cols, "value", (0.1,))
    return models.predict_path(d, path, cols).select("group_id", "entity", F.round("score", 5).alias("score"))


@query("j10_standardised_ridge", """
WITH z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS zv FROM pred WINDOW w AS (PARTITION BY group_id)), c AS (SELECT zv - avg(zv) OVER w AS y, score_a - avg(score_a) OVER w AS a FROM z WHERE zv IS NOT NULL WINDOW w AS (PARTITION BY group_id)),
n AS (SELECT sum(a * a) AS aa, sum(a * y) AS ay FROM c) SELECT group_id, entity, round(ay / (1.1 * aa) * score_a, 5) AS score FROM pred, n""")
def _(t):
    path = panels.standardised_ridge(t.pred, "group_id", ["score_a"], "value", 0.1)
    return models.predict_path(t.pred, path, ["score_a"]).select("group_id", "entity", F.round("score", 5).alias("score"))


@query("k3_library_members", "SELECT 'all' AS library, 'score_a' AS method, count(*) AS n FROM pred UNION ALL SELECT 'all', 'score_b', count(*) FROM pred UNION ALL SELECT 'one', 'score_a', count(*) FROM pred")
def _(t):
    p = t.pred.unpivot(["group_id", "entity"], ["score_a", "score_b"], "method", "score")
    m = t.spark.createDataFrame([("all", "score_a"), ("all", "score_b"), ("one", "score_a")], "library string, method string")
    return ensemble.library_members(p, m).groupBy("library", "method").agg(F.count(F.lit(1)).alias("n"))


@query("k6_choose_setting", f"""
WITH u AS (SELECT period, group_id, value, 1 AS setting, score_a AS s FROM pred UNION ALL SELECT period, group_id, value, 2, score_a + score_b FROM pred UNION ALL SELECT period, group_id, value, 3, score_b FROM pred), g AS (SELECT period, setting, round({corr_sql('value', 's')}, 6) AS r FROM u GROUP BY ALL),
b AS (SELECT period, setting FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY r DESC, setting) AS k FROM g WHERE r IS NOT NULL) WHERE k = 1) SELECT period, setting, r, setting IN (1, 3) AS at_edge FROM b JOIN g USING (period, setting)""")
def _(t):
    u = t.pred.select("period", "value", F.explode(F.array(*(F.struct(F.lit(i).alias("setting"), s.alias("s")) for i, s in enumerate((F.col("score_a"), F.col("score_a") + F.col("score_b"), F.col("score_b")), 1)))).alias("x"))
    curve = u.select("period", "value", "x.*").groupBy("period", "setting").agg(r6(metrics.pearson("value", "s")).alias("r"))
    return ensemble.choose_setting(curve, curve, "period", "setting", "r")


@query("k23_verdict_changes", f"""WITH {YE_SQL}, {DL_SQL} SELECT dataset, false AS changed FROM dl""")
def _(t):
    d = inference.dersimonian_laird(inference.floor_se(year_table(t), "dataset"), ["dataset"]).withColumn("resolution", F.lit(0.01))
    return panels.verdict_changes(d, d, ["dataset"]).select("dataset", "changed")


@query("s5_fit_rows", """
WITH g AS (SELECT entity, (row_number() OVER (ORDER BY md5('s5|' || entity), entity) - 1) % 5 AS part FROM (SELECT DISTINCT entity FROM cells)) SELECT group_id, entity FROM cells JOIN g USING (entity) WHERE part NOT IN (0, 1)""")
def _(t):
    c = t.cells
    s = splits.grouped_folds(t.cells, "entity", 5, "s5").select("group_id", "entity", "fold", "role")
    return splits.fit_rows(c, s, ["group_id", "entity"], 0, ("train",)).select("group_id", "entity")


@query("a15_package", """
WITH d AS (SELECT 'set' || (location % 3) AS dataset, period, group_id FROM cells), g AS (SELECT dataset, period, list_sort(list(DISTINCT group_id)) AS gs FROM d GROUP BY ALL)
SELECT dataset, '{"periods":[' || string_agg('{"period":' || period || ',"groups":["' || array_to_string(gs, '","') || '"]}', ',' ORDER BY period) || '],"methods":["a","b"]}' AS definition FROM g GROUP BY dataset""")
def _(t):
    c = t.cells.select(F.concat(F.lit("set"), (F.col("location") % 3).cast("string")).alias("dataset"), "period", "group_id")
    p = c.select("dataset").distinct().withColumn("method", F.explode(F.array(F.lit("b"), F.lit("a"))))
    return panels.package(c, p, "dataset", "period", "group_id")


@query("o2_top_rows", "SELECT location, group_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY value DESC, group_id, entity) AS k FROM cells) WHERE k <= 3")
def _(t):
    return panels.top_rows(t.cells, ["location"], [F.col("value").desc(), F.col("group_id"), F.col("entity")], 3).select("location", "group_id", "entity")


@query("o4_union_by_name", "SELECT group_id, round(value, 6) AS value, NULL::DOUBLE AS score_a FROM cells WHERE period = 1995 UNION ALL SELECT group_id, round(value, 6), round(score_a, 6) FROM pred WHERE period = 1997")
def _(t):
    return t.cells.filter("period = 1995").select("group_id", r6("value").alias("value")).unionByName(
        t.pred.filter("period = 1997").select("group_id", r6("value").alias("value"), r6("score_a").alias("score_a")), allowMissingColumns=True)
