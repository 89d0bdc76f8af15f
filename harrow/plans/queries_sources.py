"""Queries of sources and sinks: a given table is written in a format, scanned back by the operator, and compared with the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import clean
from harrow.operators.staging import stage_dir
from harrow.plans.declare import query
from harrow.plans.testbed import r6
from harrow.sources import build, genotypes


def folder(t, name: str) -> str:
    return f"{stage_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("a2_delimited", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 <> 0 THEN l_quantity::DOUBLE END AS quantity, CASE WHEN l_partkey % 50 = 1 THEN NULL ELSE round(l_extendedprice, 2)::DOUBLE END AS price FROM lineitem""")
def _(t):
    raw = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 50 == 0, "NA").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_partkey") % 50 == 1, "Inf").otherwise(F.format_string("%.2f", "l_extendedprice")).alias("price"))
    raw.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(at := folder(t, "delimited"))
    d = genotypes.delimited(t.spark, at, "l_orderkey long, l_linenumber long, l_partkey long, quantity string, price string", "\t", 8)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", clean.number(F.col("quantity")).alias("quantity"), clean.number(F.col("price")).alias("price"))


def _call(value, entity, site):
    """0/0, 0/1, 1|1 or ./. by the size of a component."""
    d = F.when(value > 0.06, "1|1").when(value > -0.06, "0/1").otherwise("0/0")
    return F.when((entity + site) % 11 == 0, "./.").otherwise(d)


def _vcf_text(t) -> str:
    """The vectors' components as sites of a VCF text; a site with number divisible by 5 has two alternatives."""
    e = t.table("embeddings").select("vec_id", F.posexplode("embedding").alias("site", "v"))
    cells = e.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.concat(_call(F.col("v"), F.col("vec_id"), F.col("site")), F.lit(":7")).alias("c")))).alias("cells"))
    alt = F.when(F.col("site") % 5 == 0, "C,G").otherwise("T")
    fixed = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("site") % 3).cast("string")), (F.col("site") * 100).cast("string"), F.concat(F.lit("m"), "site"), F.lit("A"), alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"))
    body = cells.select(F.lit(1).alias("part"), F.concat_ws("\t", fixed, F.concat_ws("\t", F.transform("cells", lambda c: c["c"]))).alias("value"))
    ids = t.table("embeddings").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    head = ids.select(F.lit(0).alias("part"), F.concat_ws("\t", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"), F.concat_ws("\t", F.transform("ids", lambda i: i.cast("string")))).alias("value"))
    meta = t.spark.createDataFrame([(0, "##fileformat=VCFv4.2")], "part int, value string")
    meta.unionByName(head).unionByName(body).select("value").write.text(at := folder(t, "vcf"))
    return at


VCF_SQL = """SELECT 'chr' || (i % 3) AS chrom, (i * 100)::BIGINT AS pos, 'A' AS ref, CASE WHEN i % 5 = 0 THEN 'C,G' ELSE 'T' END AS alt, vec_id::VARCHAR AS entity,
  CASE WHEN (vec_id + i) % 11 <> 0 THEN (CASE WHEN embedding[i + 1] > 0.06::DOUBLE THEN 2 WHEN embedding[i + 1] > -0.06::DOUBLE THEN 1 ELSE 0 END) END AS dosage FROM embeddings, unnest(range(64)) AS r(i)"""


@query("a5_vcf", VCF_SQL)
def _(t):
    return genotypes.vcf(t.spark, _vcf_text(t))


@query("a6_vcf_wanted", f"SELECT * FROM ({VCF_SQL}) WHERE pos % 200 = 0 AND alt = 'T'")
def _(t):
    wanted = t.spark.range(32).select(F.concat(F.lit("chr"), ((F.col("id") * 2) % 3).cast("string")).alias("chrom"), (F.col("id") * 200).alias("pos"))
    return genotypes.vcf(t.spark, _vcf_text(t), wanted)


@query("a7_hapmap", """
SELECT vec_id AS feature, 's' || i AS entity, CASE WHEN (vec_id + i) % 13 = 0 THEN NULL WHEN embedding[i + 1] > 0.06::DOUBLE THEN 2 WHEN embedding[i + 1] > -0.06::DOUBLE THEN 1 ELSE 0 END AS dosage FROM embeddings, unnest(range(64)) AS r(i)""")
def _(t):
    names = [f"s{i}" for i in range(64)]
    v = lambda i: F.element_at("embedding", i + 1)
    letter = lambda i: F.when((F.col("vec_id") + i) % 13 == 0, "N").when(v(i) > 0.06, "G").when(v(i) > -0.06, F.when(F.col("vec_id") % 2 == 0, "R").otherwise("K")).otherwise("A")
    raw = t.table("embeddings").select(F.col("vec_id").alias("rs"), F.lit("A/G").alias("alleles"), *(letter(i).alias(n) for i, n in enumerate(names)))
    raw.write.option("header", True).option("sep", "\t").csv(at := folder(t, "hapmap"))
    d = genotypes.delimited(t.spark, at, ", ".join(["rs long", "alleles string", *(f"{n} string" for n in names)]), "\t")
    return genotypes.hapmap(d, "rs", "alleles", names)


@query("a8_square_matrix", """
WITH c AS (SELECT n.n_nationkey AS a, cu.c_nationkey AS b, count(*) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n.n_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer cu ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, coalesce(k, 0)::DOUBLE AS k FROM nation x CROSS JOIN nation y LEFT JOIN c ON c.a = x.n_nationkey AND c.b = y.n_nationkey)
SELECT 'NATION' || p.a AS i, 'NATION' || p.b AS j, (p.k + q.k) / 2 AS k FROM g p JOIN g q ON p.a = q.b AND p.b = q.a""")
def _(t):
    keys = [f"nation-{i}." for i in range(25)]  # the nations there are
    d = t.table("lineitem").join(t.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = d.groupBy("s_nationkey").pivot("c_nationkey", list(range(25))).count()
    wide = t.table("nation").select(F.col("n_nationkey").alias("s_nationkey")).join(wide, "s_nationkey", "left")
    raw = wide.select(F.concat(F.lit("nation-"), "s_nationkey", F.lit(".")).alias("row"), *(F.coalesce(F.col(str(i)), F.lit(0)).cast("string").alias(k.rstrip(".")) for i, k in enumerate(keys)))
    raw.write.option("header", True).csv(at := folder(t, "matrix"))
    back = genotypes.delimited(t.spark, at, ", ".join(["row string", *(f"`{k.rstrip('.')}` double" for k in keys)]))
    return genotypes.square_matrix(back, "row", [k.rstrip(".") for k in keys], clean.norm_key)


@query("a10_benchmark_definition", "SELECT DISTINCT 'set' || (location % 4) AS dataset, period, group_id AS \"group\" FROM cells WHERE period IN (1997, 1998, 1999)")
def _(t):
    c = t.cells.filter("period in (1997, 1998, 1999)").select(F.concat(F.lit("set"), (F.col("location") % 4).cast("string")).alias("dataset"), F.col("period").cast("string").alias("p"), "group_id").distinct()
    per = c.groupBy("dataset", "p").agg(F.collect_list("group_id").alias("g")).groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("p", "g"))).alias("e"))
    per.select(F.to_json(F.map_from_arrays(F.array("dataset"), F.array(F.struct(F.lit(25).alias("min_genotypes"), F.col("e").alias("scorable_environments"))))).alias("value")).write.text(at := folder(t, "definition"))
    return genotypes.benchmark_definition(t.spark.read.text(at), "value")


@query("a11_keyed_files", "SELECT year(l_shipdate)::INT AS period, l_returnflag AS flag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ALL")
def _(t):
    d = t.table("lineitem").select("l_quantity", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag"))
    d.write.partitionBy("year", "flag").parquet(at := folder(t, "keyed"))
    back = genotypes.keyed_by_name(t.spark.read.parquet(f"{at}/*/*/*.parquet"), r"year=(\d+)/flag=(\w)/", ["period", "flag"])
    return back.groupBy(F.col("period").cast("int").alias("period"), "flag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("a14_prediction_sink", """
SELECT 'set' || (location % 3) AS dataset, 'one' AS method, group_id, entity, round(score_a, 6) AS score FROM pred UNION ALL SELECT 'set' || (location % 3), 'two', group_id, entity, round(CASE WHEN location % 3 = 1 THEN -score_b ELSE score_b END, 6) + 0.0 FROM pred""")
def _(t):
    p = t.pred.withColumn("dataset", F.concat(F.lit("set"), (F.col("location") % 3).cast("string")))
    long = p.select("dataset", "group_id", "entity", F.explode(F.create_map(F.lit("one"), F.col("score_a"), F.lit("two"), F.col("score_b"))).alias("method", "score"))
    genotypes.write_predictions(long, at := folder(t, "predictions"))
    genotypes.write_predictions(long.filter("dataset = 'set1' and method = 'two'").withColumn("score", -F.col("score")), at)  # only this folder is replaced
    return t.spark.read.parquet(at).select("dataset", "method", "group_id", "entity", (r6("score") + 0.0).alias("score"))


@query("a16_manifest")
def _(t):
    return genotypes.manifest(t.spark, t.sf_dir)


@query("a17_resumed_units", "SELECT period, location % 4 AS part, count(*) AS n, round(sum(score_a), 4) + 0.0 AS total FROM pred GROUP BY ALL")
def _(t):
    p = t.pred.withColumn("part", F.col("location") % 4)
    expected = p.select("period", "part").distinct()
    at = folder(t, "units")
    p.join(expected.filter("part < 2"), ["period", "part"], "left_semi").write.partitionBy("period", "part").parquet(at)  # an interrupted run
    left = genotypes.missing_units(expected, t.spark.read.parquet(at), ["period", "part"])
    p.join(left, ["period", "part"], "left_semi").write.mode("append").partitionBy("period", "part").parquet(at)
    d = t.spark.read.parquet(at).groupBy("period", F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("score_a").alias("total"))
    return d.withColumn("total", F.round("total", 4) + 0.0)


@query("a19_forward_input", """
SELECT 'cells' AS name, period, count(*) AS n, round(sum(value), 3) AS total FROM cells WHERE period < 1998 GROUP BY period UNION ALL SELECT 'plots', period, count(*), round(sum(value), 3) FROM plots WHERE period < 1998 GROUP BY period""")
def _(t):
    out = None
    for name, df in genotypes.before_period({"cells": t.cells, "plots": t.plots}, "period", 1998).items():
        df.write.parquet(at := folder(t, f"forward-{name}"))
        d = t.spark.read.parquet(at).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.lit(name).alias("name"), "period", "n", "total")
        out = d if out is None else out.unionByName(d)
    return out


SPECS = [
    build.SourceSpec("lines", "l_suppkey", "year(l_shipdate)", "concat('P', l_partkey)", "l_extendedprice / l_quantity", "l_returnflag <> 'R'"),
    build.SourceSpec("orders", "o_orderpriority", "year(o_orderdate)", "o_custkey", "case when o_orderstatus = 'P' then 'pending' else cast(o_totalprice as string) end"),
    build.SourceSpec("events", "event_type", "year(ts)", "concat(user_id, '@', date_format(ts, 'MM'))", "-value"),
    build.SourceSpec("texts", "concat(lang, '/', source)", "2000", "md5(cast(doc_id as string))", "length(text)"),
    build.SourceSpec("turns", "role", "2001", "conv_id", "length(text)", "turn > 0"),
    build.SourceSpec("vectors", "label", "2002", "vec_id", "embedding[0]"),
]
CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, ({place})::VARCHAR || '_' || ({period})::INT AS group_id, ({place})::VARCHAR AS place, ({period})::INT AS period, ({entity})::VARCHAR AS entity, avg({value}) AS value, count(*) AS n_plots FROM {table} WHERE {keep} GROUP BY ALL"
    for name, table, place, period, entity, value, keep in (
        ("lines", "lineitem", "l_suppkey", "year(l_shipdate)", "'P' || l_partkey", "l_extendedprice / l_quantity", "l_returnflag <> 'R' AND l_partkey % 3 <> 0"),
        ("orders", "orders", "o_orderpriority", "year(o_orderdate)", "o_custkey", "o_totalprice", "o_orderstatus <> 'P'"),
        ("events", "events", "event_type", "year(ts)", "user_id || '@' || strftime(ts, '%m')", "-value", "value IS NOT NULL"),
        ("texts", "documents", "lang || '/' || source", "2000", "md5(doc_id::VARCHAR)", "length(text)::DOUBLE", "lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL"),
        ("turns", "conversations", "role", "2001", "conv_id", "length(text)::DOUBLE", "turn > 0 AND text IS NOT NULL AND role IS NOT NULL"),
        ("vectors", "embeddings", "label", "2002", "vec_id", "embedding[1]::DOUBLE", "label IS NOT NULL")))


def _tables(t) -> dict[str, DataFrame]:
    return {"lines": t.table("lineitem"), "orders": t.table("orders"), "events": t.table("events"), "texts": t.table("documents"), "turns": t.table("conversations"), "vectors": t.table("embeddings")}


@query("a12_source_specs", CELLS_SQL, rounded=("value",))
def _(t):
    known = {"lines": t.table("part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("entity"))}
    return build.load(_tables(t), SPECS, known)


@query("a13_raw_build", """
WITH p AS (SELECT *, p_partkey % 4 <> 0 AS has FROM (SELECT l_suppkey AS place, year(l_shipdate)::INT AS period, l_suppkey || '_' || year(l_shipdate) AS g, l_partkey, l_extendedprice AS y FROM lineitem) JOIN part ON p_partkey = l_partkey),
c AS (SELECT g, period, l_partkey, avg(y) AS y FROM p WHERE has GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM c GROUP BY g), e AS (SELECT place || '_' || period AS g, CASE WHEN place % 7 = 0 THEN NULL ELSE 1 END AS q FROM (SELECT DISTINCT place, period FROM p)),
dl AS (SELECT DISTINCT g, l_partkey % 10 AS d FROM p), f AS (SELECT p_partkey, i, CASE WHEN (p_partkey + i) % 9 <> 0 THEN 1 END AS dosage FROM part, unnest(range(6)) AS r(i) WHERE p_partkey % 4 <> 0)
SELECT key, value::DOUBLE AS value FROM (SELECT 'plots_in_source' AS key, (SELECT count(*) FROM lineitem) AS value UNION ALL SELECT 'plots_finite', (SELECT count(*) FROM p) UNION ALL SELECT 'plots_dropped_no_features', (SELECT count(*) FROM p WHERE NOT has)
UNION ALL SELECT 'entities_without_features', (SELECT count(DISTINCT l_partkey) FROM p WHERE NOT has) UNION ALL SELECT 'cells', (SELECT count(*) FROM c) UNION ALL SELECT 'entities', (SELECT count(DISTINCT l_partkey) FROM c) UNION ALL SELECT 'periods', (SELECT count(DISTINCT period) FROM c)
UNION ALL SELECT 'groups', (SELECT count(*) FROM n) UNION ALL SELECT 'groups_below_least', (SELECT count(*) FROM n WHERE n < 25) UNION ALL SELECT 'entities_per_group_median', (SELECT quantile_cont(n, 0.5) FROM n)
UNION ALL SELECT 'groups_with_covariates', (SELECT count(*) FROM e WHERE g IN (SELECT g FROM n)) UNION ALL SELECT 'groups_all_missing', (SELECT count(*) FROM e WHERE q IS NULL AND g IN (SELECT g FROM n)) UNION ALL SELECT 'daily_rows', (SELECT count(*) FROM dl WHERE g IN (SELECT g FROM n))
UNION ALL SELECT 'dosages', (SELECT count(*) FROM f) UNION ALL SELECT 'missing_rate', (SELECT avg((dosage IS NULL)::INT) FROM f))""", rounded=("value",))
def _(t):
    lines = t.table("lineitem")
    spec = build.SourceSpec("lines", "l_suppkey", "year(l_shipdate)", "l_partkey", "l_extendedprice")
    features = t.table("part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("feature")).withColumn(
        "dosage", F.when((F.col("entity") + F.col("feature")) % 9 != 0, F.floor(F.col("entity") / F.pow(F.lit(3.0), "feature")) % 3))
    group = F.concat_ws("_", "l_suppkey", F.year("l_shipdate")).alias("group_id")
    covariates = lines.groupBy(group, F.col("l_suppkey")).agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b")).select("group_id", *(F.when(F.col("l_suppkey") % 7 != 0, F.col(c)).alias(c) for c in "ab"))
    daily = lines.select(group, (F.col("l_partkey") % 10).alias("day")).distinct()
    return build.raw_build(lines, spec, features, covariates, daily, folder(t, "build"))
