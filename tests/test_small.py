"""Hand-made cases: ties, constant groups, nulls, gaps, text formats, leakage."""

import math
import re

import pytest
from pyspark.sql import functions as F

from harrow.functions import clean
from harrow.operators import aggs, ensemble, inference, joins, metrics, splits, windows
from harrow.plans import reports
from harrow.sources import genotypes


def test_rank_metrics_with_ties_and_constants(spark):
    rows = [("g", i, float(i // 2), float(i)) for i in range(30)] + [("flat", i, float(i), 1.0) for i in range(30)] + [("two", 0, 1.0, 2.0), ("two", 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, e int, v double, s double")
    got = {r["g"]: r for r in metrics.group_metrics(df, ["g"], "e", "v", "s").collect()}
    assert set(got) == {"g", "flat"}
    assert got["flat"]["pearson"] is None and got["flat"]["spearman"] is None and got["flat"]["slope"] is None
    assert got["g"]["spearman"] > 0.99 and math.isclose(got["g"]["hit_rate"], 2 / 3)


def test_monotone_change_keeps_rank_metrics(spark):
    df = spark.range(40).select(F.lit("g").alias("g"), F.col("id").alias("e"), ((F.col("id") * 17) % 41).cast("double").alias("v"), ((F.col("id") * 23) % 43).cast("double").alias("s"))
    a = metrics.spearman(df, ["g"], "e", "v", "s").first()["spearman"]
    b = metrics.spearman(df.withColumn("s", F.exp(F.col("s") / 10)), ["g"], "e", "v", "s").first()["spearman"]
    c = metrics.spearman(df.withColumn("s", -F.col("s")), ["g"], "e", "v", "s").first()["spearman"]
    assert math.isclose(a, b, abs_tol=1e-12) and math.isclose(a, -c, abs_tol=1e-12)


def test_null_scores_come_last(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 2, 1.0), ("g", 3, 2.0)], "g string, e int, s double")
    assert [r["e"] for r in df.withColumn("p", windows.top_rank("s", "e", "g")).orderBy("p").collect()] == [3, 2, 1]


def test_gap_fill_is_inside_and_limited(spark):
    v = [None, 1.0, None, None, None, 5.0, None, None, None, None, 10.0, None]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, d int, v double")
    got = [r["filled"] for r in windows.fill_gaps(df, "v", "d", "g").orderBy("d").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, None, 10.0, None]


def test_pooling_of_one_period_and_of_equal_ones(spark):
    ye = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.5), ("b", 1.0, 0.5), ("c", None, 0.5)], "dataset string, d double, se double")
    got = {r["dataset"]: r for r in inference.dersimonian_laird(ye, ["dataset"]).collect()}
    assert got["a"]["k"] == 1 and got["a"]["tau2"] == 0 and math.isclose(got["a"]["pooled_se"], 0.5)
    assert math.isclose(got["b"]["pooled_se"], 0.5 / math.sqrt(2)) and "c" not in got
    hk = {r["dataset"]: r for r in inference.hartung_knapp(ye, ["dataset"]).collect()}
    assert hk["a"]["hk_se"] is None and hk["b"]["hk_se"] == 0


def test_se_floor_and_zero_only(spark):
    ye = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("a", 0.0), ("z", 0.0)], "dataset string, se double")
    floored = sorted(round(r["se"], 6) for r in inference.floor_se(ye, "dataset").filter("dataset = 'a'").collect())
    assert floored == [0.2, 0.2, 0.3]
    zero = sorted(round(r["se"], 6) for r in inference.floor_se(ye, "dataset", zero_only=True).collect())
    assert zero == [0.1, 0.2, 0.2, 0.3]


def test_t_quantiles():
    assert math.isclose(inference.t_quantile(0.975, 1), 12.7062, rel_tol=1e-3)
    assert math.isclose(inference.t_quantile(0.975, 10), 2.2281, rel_tol=1e-3)


def test_holm_stops_at_first_failure(spark):
    df = spark.createDataFrame([("f", "a", 0.001), ("f", "b", 0.04), ("f", "c", 0.02), ("f", "d", 0.5)], "f string, t string, p double")
    got = {r["t"]: (r["rejected"], round(r["p_holm"], 6)) for r in inference.holm(df, ["f"], "p", "t").collect()}
    assert got == {"a": (True, 0.004), "c": (False, 0.06), "b": (False, 0.08), "d": (False, 0.5)}


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in joins.exclusion_groups(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_mask_quota(spark):
    cells = spark.range(20).select(F.col("id").alias("e")).crossJoin(spark.range(6).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("g")))
    m = splits.sparse_mask(cells, "g", "e", 0.5, "s")
    assert {r["n"] for r in m.groupBy("e").agg(F.count_if("observed").alias("n")).collect()} == {3}
    one = splits.sparse_mask(cells.filter("g = 'g0'"), "g", "e", 0.5, "s")
    assert one.filter("not observed").count() == 0


def test_two_way_folds_share_no_key(spark):
    cells = spark.range(12).select(F.col("id").alias("a")).crossJoin(spark.range(12).select(F.col("id").alias("b")))
    s = splits.two_way_folds(cells, "a", "b", 4, "x").filter("fold = 0")
    test, train = s.filter("role = 'test'"), s.filter("role = 'train'")
    assert test.count() > 0 and train.join(test.select("a"), "a", "left_semi").count() == 0 and train.join(test.select("b"), "b", "left_semi").count() == 0


def test_as_of_is_strictly_before(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 6), ("n", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 1, 1.0), ("k", 5, 5.0)], "k string, w int, v double")
    got = {(r["k"], r["t"]): r["v_before"] for r in joins.last_before(left, right, "k", "t", "w", "v").collect()}
    assert got == {("k", 1): None, ("k", 5): 1.0, ("k", 6): 5.0, ("n", 3): None}


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\n1\t10\t.\tA\tG\t.\t.\t.\tDP:GT\t3:0/1\t4:1|1\t5:./.\n1\t20\t.\tA\tG,T\t.\t.\t.\tGT\t0/0\t0/2\t1/1\n"
    p = tmp_path / "x.vcf"
    p.write_text(text)
    got = {(r["pos"], r["entity"]): r["dosage"] for r in genotypes.vcf(spark, str(p)).collect()}
    assert got == {(10, "A"): 1, (10, "B"): 2, (10, "C"): None, (20, "A"): 0, (20, "B"): None, (20, "C"): 2}
    wanted = spark.createDataFrame([("1", 10), ("1", 20)], "chrom string, pos long")
    assert {r["pos"] for r in genotypes.vcf(spark, str(p), wanted).collect()} == {10}


def test_hapmap_and_square_matrix(spark):
    h = spark.createDataFrame([("m1", "A/G", "A", "R", "G", "N")], "rs string, alleles string, x string, y string, z string, w string")
    assert {r["entity"]: r["dosage"] for r in genotypes.hapmap(h, "rs", "alleles", ["x", "y", "z", "w"]).collect()} == {"x": 0, "y": 1, "z": 2, "w": None}
    m = spark.createDataFrame([("a-1", 1.0, 0.2), ("b-1", 0.4, 1.0)], "row string, `a 1` double, `b 1` double")
    got = {(r["i"], r["j"]): round(r["k"], 6) for r in genotypes.square_matrix(m, "row", ["a 1", "b 1"], clean.norm_key).collect()}
    assert got[("A1", "B1")] == 0.3 == got[("B1", "A1")]


def test_json_sources(spark):
    t = spark.createDataFrame([("g", '{"T2M": {"20240101": 1.5, "20240102": -999.0}}')], "g string, j string")
    assert {str(r["day"]): r["value"] for r in genotypes.daily_json(t, "j", ["g"]).collect()} == {"2024-01-01": 1.5, "2024-01-02": None}
    b = spark.createDataFrame([('{"D": {"min_genotypes": 25, "target_years": [2020], "scorable_environments": {"2020": ["a", "b"]}, "methods": ["m"]}}',)], "j string")
    assert {(r["dataset"], r["period"], r["group"]) for r in genotypes.benchmark_definition(b, "j").collect()} == {("D", 2020, "a"), ("D", 2020, "b")}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("d1", "m", 1.0), ("d2", "m", 2.0)], "dataset string, method string, pred double")
    genotypes.write_predictions(df, str(tmp_path / "p"))
    genotypes.write_predictions(df.filter("dataset = 'd1'").withColumn("pred", F.lit(9.0)), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert {(r["dataset"], r["pred"]) for r in back.collect()} == {("d1", 9.0), ("d2", 2.0)}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "yield_2020_f1_s2.csv").write_text("a,b\n1,2\n")
    assert genotypes.manifest(spark, str(tmp_path / "f")).first()["bytes"] == 8
    keyed = genotypes.keyed_by_name(genotypes.delimited(spark, str(tmp_path / "f"), "a int, b int"), r"([a-z]+)_(\d{4})_f(\d+)_s(\d)", ["method", "period", "fold", "seed"])
    assert tuple(keyed.first())[2:] == ("yield", "2020", "1", "2")


def test_refusals(spark):
    df = spark.createDataFrame([(1, 2.0)], "e int, value double")
    with pytest.raises(ValueError):
        joins.bind_late(df, df, ["e"], "value")
    with pytest.raises(ValueError):
        aggs.other_trait(df, "e", "value", "x", ("y",), ["e"])
    with pytest.raises(ValueError):
        genotypes.whitelisted(df, ["e"], ["e"])
    with pytest.raises(ValueError):
        ensemble.check_submission(df, ["pred"], ["e"], df, "e")


def test_stack_weights_match_direct_minimum():
    sums = {"c_a": 0.5, "c_b": 0.2, "s_a_a": 1.0, "s_a_b": 0.3, "s_b_b": 1.0}
    w = ensemble.stack_weights(sums, ["a", "b"], ridge=0.0)
    x, y = (0.5 - 0.3 * 0.2) / 0.91, (0.2 - 0.3 * 0.5) / 0.91
    assert math.isclose(w["a"], x / (x + y), rel_tol=1e-6)
    assert ensemble.stack_weights({**sums, "c_a": -1.0, "c_b": -1.0}, ["a", "b"]) == {"a": 0.5, "b": 0.5}


def test_null_columns_go(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k int, a double, b double")
    assert clean.without_null_columns(df, ["k"]).columns == ["k", "a"]
    assert clean.matching(df, "^[ab]$") == ["a", "b"]


def test_draws_by_the_array_are_md5_draws():
    import hashlib

    from harrow.operators.draws import Tails, heads

    for prefix, first, last, n, start in (("i6|9_1997", 0, 120, 30, 0), ("k8spearman|set|1999", 95, 105, 1100, 0), ("i5|entity", 0, 3, 40, 990), ("p" * 60, 0, 2, 5, 0)):
        want = [[int(hashlib.md5(f"{prefix}|{r}|{s}".encode()).hexdigest()[:8], 16) for s in range(start, start + n)] for r in range(first, last)]
        assert heads(prefix, first, last, n, start).tolist() == want
    ends = [f"1997|{i * 37 % 500}_1997é" for i in range(500)]
    assert Tails(ends).order("i9|12|").tolist() == sorted(range(500), key=lambda i: (hashlib.md5(f"i9|12|{ends[i]}".encode()).hexdigest(), i))


def test_correlations_by_replicate_take_nulls_as_the_metric_does(spark):
    import numpy as np

    nan = float("nan")
    x, y = np.array([[1.0, 2.0, nan, 4.0, 4.0], [3.0] * 5]), np.array([[2.0, nan, 1.0, 5.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]])
    rows = [(r, None if x[r, i] != x[r, i] else float(x[r, i]), None if y[r, i] != y[r, i] else float(y[r, i])) for r in range(2) for i in range(5)]
    want = [r["r"] for r in spark.createDataFrame(rows, "g int, x double, y double").groupBy("g").agg(metrics.pearson("x", "y").alias("r")).orderBy("g").collect()]
    got = inference.correlations(x, y)
    assert math.isclose(got[0], want[0], rel_tol=1e-12) and want[1] is None and np.isnan(got[1])


def test_sign_test_of_many_signs(spark):
    d = spark.createDataFrame([(100_000, 200_000), (0, 7), (3, 4), (5, 5), (0, 0)], "pos long, n long")
    got = [r["p"] for r in d.select(inference.sign_test(F.col("pos"), F.col("n")).alias("p")).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-7) for a, b in zip(got, [0.5 + math.comb(200_000, 100_000) / 2**200_001, 1.0, 5 / 16, 1 / 32, 1.0]))


def test_two_way_draws_are_numbered_by_ranges(spark):
    from harrow.operators import extra

    keys = spark.range(1000).select((F.col("id") * 7919 % 1009).cast("string").alias("k"))
    got = {r["k"]: r["i"] for r in extra.numbered(keys, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(str(j * 7919 % 1009) for j in range(1000)))}
    assert sum(len(r["in"]) for r in extra.drawn_in(keys, "k", 3, "s", together=64).collect()) == 3000


def test_pairs_are_counted_where_their_first_is(spark):
    import re

    from harrow.operators import aggs

    rows = [(f"g{g}", e, float(g * e % 7)) for g in range(12) for e in range(40) if (g * 5 + e * 3) % 4 < 2] + [("g1", 3, 9.0), ("g2", None, 1.0), (None, 3, 1.0)]
    c = spark.createDataFrame(rows, "g string, e int, v double")
    a, b = c.selectExpr("g a", "e", "v x"), c.selectExpr("g b", "e", "v y")
    want = {(r["a"], r["b"]): r["n"] for r in a.join(b, "e").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8").collect()}
    assert {(r["a"], r["b"]): r["shared"] for r in aggs.pair_correlations(c, "g", "e", "v", [], 8).collect()} == want and want
    w = aggs.incidence_weights(c.dropna(), "g", "e")
    assert not re.search(r"hashpartitioning\(i#\d+L?, j#", w._jdf.queryExecution().toString())


def test_incidence_weights_go_by_ranges(spark):
    import numpy as np

    x = np.array([-(2**62), -5, 0, 1, 127, 128, 20_000, 2**40, 2**62, 3, 300], np.int64)
    data, ends = aggs._steps(x, np.array([0, 9]))
    got = aggs._lists(x[[0, 9]], [data[ends[0] : ends[8]].tobytes(), data[ends[9] :].tobytes()])
    assert (got[0] == x).all() and list(got[1]) == [9, 2]
    assert list(aggs._half_up(np.array([-1 / 128, 1 / 640, 0.1234564, -2.5e-7]), 6)) == [-0.007813, 0.001563, 0.123456, 0.0]
    rows = [(f"g{g}", e * e - 30) for g in range(25) for e in range(60) if (g * 5 + e * 3 + g * e) % 5 < 2] + [("g1", 3), ("g1", 3), (None, 3)]
    d = spark.createDataFrame(rows, "g string, e int")
    c = d.filter("g IS NOT NULL").distinct().withColumn("w", 1 / F.count(F.lit(1)).over(windows.Window.partitionBy("g")))
    want = c.selectExpr("g", "e i", "w").join(c.selectExpr("g", "e j"), "g").filter("i <= j").groupBy("i", "j").agg((F.sum((F.col("i") == F.col("j")).cast("int")) - F.sum("w")).alias("w"))
    want = {(r["i"], r["j"]): r["w"] for r in want.collect()}
    for most, chunk in ((8_000_000, 2_000_000), (300, 50), (1, 1)):
        w = aggs.incidence_weights(d, "g", "e", None, most, chunk)
        got = w.collect()
        assert len(got) == len(want) and all(math.isclose(want[r["i"], r["j"]], r["weight"], abs_tol=1e-9) for r in got)
        assert not re.search("Generate explode", w._jdf.queryExecution().toString())  # pairs are no rows before they are summed
    text = aggs.incidence_weights(d.withColumn("e", F.format_string("e%05d", F.col("e") + 100)), "g", "e", 6, 300, 50).collect()
    assert {(int(r["i"][1:]) - 100, int(r["j"][1:]) - 100): r["weight"] for r in text} == {k: r["weight"] for k, r in (((r["i"], r["j"]), r) for r in aggs.incidence_weights(d, "g", "e", 6).collect())}


def test_tables_by_entity_are_not_gathered_in_the_driver(spark, monkeypatch):
    from harrow.plans import testbed
    from tests.conftest import DATA

    d = spark.range(100_001).select((F.col("id") % 2).alias("p"), F.col("id").alias("v"))
    out = d.join(windows.places(d, ["p"], "v"), ["p", "v"]).agg(F.sum("n_before").alias("s"))
    assert out.first()["s"] == 50_000 * 50_001 // 2 + 49_999 * 50_000 // 2
    out.collect()
    assert re.search(r"SortMergeJoin \[p#\d+L, v#", out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    monkeypatch.setattr(testbed, "staged", lambda df, label: df)
    plan = testbed.Testbed(spark, DATA).pred._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[(target#\d+, )?entity#", plan) and len(re.findall(r"SortMergeJoin \[(?:\w+#\d+, )?entity#", plan)) >= 3


def test_shared_content_by_blocks(spark):
    rows = [(p, f"g{g}", (g * 7 + k * k) % 23, k % 5) for p in (1, 2) for g in range(p * 100, p * 100 + 30) for k in range(12)]
    d = spark.createDataFrame(rows, "p int, g string, e int, v int").distinct()
    x, y = d.selectExpr("p", "g a", "e", "v"), d.selectExpr("p", "g b", "e", "v")
    want = {(r["a"], r["b"]): r["n"] for r in x.join(y, ["p", "e", "v"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").collect()}
    for block in (4, 1000):
        got = joins.shared_content(d, "g", ["p"], "e", "v", 3, block=block).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["shared"] for r in got} == want


def test_shared_content_is_sent_out_as_it_is_counted(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = ([np.unique(np.concatenate([rng.integers(0, 40, 25), rng.integers(40, 3000, 20)])) for _ in range(n)] for n in (37, 1100))
    want = np.array([[len(np.intersect1d(a, b)) for b in y] for a in x])
    flat = lambda t: (np.repeat(np.arange(len(t)), [len(v) for v in t]), np.concatenate(t))
    for width, dense in ((4_096, 1e-3), (16, 1e-3), (4_096, 0.0), (4_096, 2.0)):
        got = np.concatenate([c for _, c in joins._counts_in_common(flat(x), flat(y), len(x), len(y), tile=10, width=width, dense=dense)])
        assert (got == want).all(), (width, dense)
    rows = [(1, "a", e, None) for e in range(122)] + [(1, "a", e, e) for e in range(6)] + [(1, "b", e, 5) for e in range(200)] + [(2, "c", 1, 1), (None, "d", 5, 5), (1, None, 5, 5), (1, "b", 5, 5)]
    d = spark.createDataFrame(rows, "p int, g string, e int, v int")
    out = joins.shared_content(d, "g", ["p"], "e", "v", digits=6)
    assert [tuple(r) for r in out.collect()] == [(1, "a", "b", 1, 0.007813)]  # 1 / 128: half a unit of the last digit goes up
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroup" not in plan


def test_inner_products_come_in_blocks_of_a_million_at_most():
    import inspect

    from harrow.operators import nearest

    p = inspect.signature(nearest.inner_products).parameters
    assert p["row_block"].default * p["query_block"].default <= 2**20


def test_quantiles_come_from_places_in_ranges(spark):
    from harrow.operators import aggs

    rows = [("a", float(i * 37 % 101)) for i in range(500)] + [("b", 1.0)] + [("c", None)] * 3 + [(None, float(i)) for i in range(4)] + [("d", float(i // 50)) for i in range(103)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = aggs.describe(d, ["g"], "v")
    assert "percentile" not in got._jdf.queryExecution().toString()
    want = d.groupBy("g").agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(s)).alias(f"q{int(100 * s)}") for s in (0.25, 0.5, 0.75)))
    assert {r["g"]: (r["n"], r["q25"], r["q50"], r["q75"]) for r in got.collect()} == {r["g"]: (r["n"], r["q25"], r["q50"], r["q75"]) for r in want.collect()}


def test_ranks_sort_once_a_column(spark):
    rows = [(f"g{i % 3}", i, float(i * 7 % 11), float(i * 5 % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, e int, v double, s double")
    d = metrics.ranked(df, ["g"], "e", "v", "s")
    assert str(d._jdf.queryExecution().executedPlan().toString()).count("Sort [") == 2
    for r in d.collect():
        for key, rank, place in (("v", "__rv", "__pv"), ("s", "__rs", "__ps")):
            own = [(-x["v" if key == "v" else "s"], x["e"]) for x in (dict(zip("gevs", q)) for q in rows) if x["g"] == r["g"]]
            assert r[place] == 1 + sum(o < (-r[key], r["e"]) for o in own)
            assert r[rank] == 1 + sum(o[0] < -r[key] for o in own) + (sum(o[0] == -r[key] for o in own) - 1) / 2
    one = df.withColumn("m", windows.midrank("v", "g"))
    assert str(one._jdf.queryExecution().executedPlan().toString()).count("Sort [") == 1


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("g"), "id")
    d = windows.dealt(df, 1000, "g", most=20)
    assert d.rdd.getNumPartitions() >= 50 and d.select("g", F.spark_partition_id().alias("p")).distinct().count() == 100
    assert windows.dealt(df, 1000, "g") is df


def test_scope_report_ranks_once(spark):
    rows = [("all", p, f"{p}_{g}", e, float(e * 7 % 13), float(e * 5 % 11), float(e * (g + p) % 17)) for p in (1, 2) for g in range(4) for e in range(15)]
    df = spark.createDataFrame(rows, "scope string, period int, grp string, e int, v double, a double, b double")
    d = reports.scope_report(df, "scope", "period", "grp", "e", "v", "a", "b", 10, 50, "t")
    assert "Expand" not in d._jdf.queryExecution().executedPlan().toString() and d.count() == 1


def test_rank_difference_of_groups_over_many_tasks(spark):
    """The same draws and ranks as where a group is in one task, with ties, and with blocks and ranges much smaller than a group."""
    import numpy as np

    g = np.random.Generator(np.random.PCG64(4))
    rows = [(p, e, float(round(v, 1)), float(round(v + g.normal(), 1)), float(e % 5)) for p, n in ((1, 3000), (2, 700), (3, 2)) for e, v in zip(g.permutation(9000)[:n].tolist(), g.normal(size=n))]
    d = spark.createDataFrame(rows, "period int, entity long, v double, a double, b double")
    at = inference.placed(d, ["period"], "entity", ["v", "a", "b"], most=500)
    got = {r["period"]: r for r in inference.rank_difference_of_many(at, ["period"], 7, "t", together=4, most=500, block=256, chunk=1000).collect()}
    want = {r["period"]: r for r in inference.bootstrap_rank_difference(d, ["period"], "entity", "v", "a", "b", 7, "t").collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for p in (1, 2):
        assert abs(got[p]["mean"] - want[p]["mean"]) < 1e-9 and abs(got[p]["se"] - want[p]["se"]) < 1e-9 and want[p]["se"] > 0
    assert at.groupBy("period").agg(F.max("__u").alias("u"), F.max("__n").alias("n")).filter("u <> n - 1").isEmpty()
