"""Queries of the further operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import extra, models
from harrow.plans.declare import query
from harrow.plans.queries_core import corr_sql
from harrow.plans.queries_models import CENTRED_PRED
from harrow.plans.queries_more import md5_sql
from harrow.plans.testbed import r6


@query("b23_one_hot", "SELECT p_partkey, (p_size % 3 = 0)::INT::DOUBLE AS part_0, (p_size % 3 = 1)::INT::DOUBLE AS part_1 FROM part")
def _(t):
    p = t.table("part").select("p_partkey", (F.col("p_size") % 3).alias("part"))
    return extra.one_hot(p, "part", [0, 1]).drop("part")


@query("j21_block_ridge", f"""WITH {CENTRED_PRED}, s AS (SELECT 0 AS setting, 0.1::DOUBLE AS pa, 1.0::DOUBLE AS pb UNION ALL SELECT 1, 1.0, 0.0), d AS (SELECT setting, aa * (1 + pa) AS xa, bb * (1 + pb) AS xb, ab, ay, by_ FROM ne, s)
SELECT setting, round((xb * ay - ab * by_) / (xa * xb - ab * ab), 5) AS c_a, round((xa * by_ - ab * ay) / (xa * xb - ab * ab), 5) AS c_b FROM d""")
def _(t):
    c = extra.block_ridge(t.pred.filter("period < 1999"), "group_id", "value", {"a": ["score_a"], "b": ["score_b"]}, [{"a": 0.1, "b": 1.0}, {"a": 1.0, "b": 0.0}])
    return t.spark.createDataFrame([(i, round(float(x[0]), 5), round(float(x[1]), 5)) for i, x in enumerate(c)], "setting int, c_a double, c_b double")


@query("j12_mixed_reml", f"""WITH {CENTRED_PRED}, e AS (SELECT yy, n - g AS df, (aa + bb) / 2 AS mean, unnest([(aa + bb + sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2, (aa + bb - sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2]) AS d, aa, ab, bb, ay, by_ FROM ne),
v AS (SELECT yy, df, mean, greatest(d, 0) AS d, power((ab * ay + (d - aa) * by_), 2) / (ab * ab + (d - aa) * (d - aa)) AS c2 FROM e), g AS (SELECT unnest([0.0001, 0.001])::DOUBLE AS delta), w AS (SELECT unnest([0.0, 0.5])::DOUBLE AS mix),
m AS (SELECT mix, delta, yy, df, (1 - mix) * d + mix * mean AS n, c2 * ((1 - mix) * d + mix * mean) / greatest(d, 1e-12) AS c FROM v, g, w),
s AS (SELECT mix, delta, any_value(yy) AS yy, any_value(df) AS df, sum(ln(1 + delta * n)) AS logs, sum(delta * c / (1 + delta * n)) AS fit FROM m GROUP BY mix, delta)
SELECT mix, delta, round(-0.5 * (df * ln((yy - fit) / df) + logs), 3) AS loglik FROM s""")
def _(t):
    spec, yy, degrees = models.spectrum(t.pred.filter("period < 1999"), "group_id", ["score_a", "score_b"], "value")
    return extra.mixed_reml(spec, yy, degrees, [0.0, 0.5], [1e-4, 1e-3]).select("mix", "delta", F.round("loglik", 3).alias("loglik"))


@query("i5_two_way_bootstrap", f"""WITH p AS (SELECT * FROM pred), e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM p)), g AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM p)),
me AS (SELECT rep, entity, count(*) AS m FROM (SELECT rep, {md5_sql("'i5'", "'entity'", 'rep', 'i')} % n AS i FROM e, unnest(range(40)) AS q(rep)) JOIN e USING (i) GROUP BY ALL), mg AS (SELECT rep, group_id, count(*) AS m FROM (SELECT rep, {md5_sql("'i5'", "'group_id'", 'rep', 'i')} % n AS i FROM g, unnest(range(40)) AS q(rep)) JOIN g USING (i) GROUP BY ALL),
x AS (SELECT rep, group_id, value, score_a, score_b, unnest(range(m)) AS again FROM p JOIN me USING (entity)),
k AS (SELECT rep, group_id, rank() OVER (PARTITION BY rep, group_id ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY rep, group_id, round(value, 9)) - 1) / 2.0::DOUBLE AS v, rank() OVER (PARTITION BY rep, group_id ORDER BY round(score_a, 9)) + (count(*) OVER (PARTITION BY rep, group_id, round(score_a, 9)) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY rep, group_id ORDER BY round(score_b, 9)) + (count(*) OVER (PARTITION BY rep, group_id, round(score_b, 9)) - 1) / 2.0::DOUBLE AS b FROM x),
d AS (SELECT rep, group_id, {corr_sql('v', 'a')} - {corr_sql('v', 'b')} AS d FROM k GROUP BY ALL), r AS (SELECT rep, sum(d * m) / sum(m) AS x FROM d JOIN mg USING (rep, group_id) WHERE d IS NOT NULL GROUP BY rep) SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS se FROM r""")
def _(t):
    d = extra.two_way_bootstrap(t.pred, "group_id", "entity", "value", "score_a", "score_b", 40, "i5")
    return d.select(r6("mean").alias("mean"), r6("se").alias("se"))
