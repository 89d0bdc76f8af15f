"""Staged models and nested folds against explicit fits; queries without SQL against numpy; nothing leaks from scored cells."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import stages
from harrow.plans import queries_blocks, registry
from tests.conftest import DATA


def nonlinear(spark, n=600, seed=1):
    g = np.random.Generator(np.random.PCG64(seed))
    x = g.normal(size=(n, 3))
    y = x @ [1.0, -0.5, 0.2] + 2.0 * (x[:, 0] > 0.3) * (x[:, 1] > 0) + 0.3 * g.normal(size=n)
    rows = [(i, int(i % 4), f"g{i % 20}", float(y[i]), x[i].tolist(), *x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, fold int, grp string, y double, x array<double>, f0 double, f1 double, f2 double"), x, y


def dense_ridge(x, y, lam):
    c, mean = x - x.mean(0), y.mean()
    a = c.T @ c
    coef = np.linalg.solve(a + lam * np.trace(a) / len(a) * np.eye(len(a)), c.T @ (y - mean))
    return coef, mean - coef @ x.mean(0)


def test_ridges_by_subtraction(spark):
    d, x, y = nonlinear(spark)
    m = stages._gathered(stages.moments(d, ["fold"], "x", "y"), "fold", "m")
    fold = np.arange(len(y)) % 4
    for out in ([], [1], [0, 3]):
        keep = ~np.isin(fold, out)
        for lam, (coef, a) in zip((0.01, 1.0), stages.ridge_without(sum(m.values()), [m[k] for k in out], (0.01, 1.0))):
            want = dense_ridge(x[keep], y[keep], lam)
            assert np.allclose(coef, want[0]) and abs(a - want[1]) < 1e-9
    with pytest.raises(ValueError):
        stages.ridge_without(sum(m.values()), m.values(), (1.0,))


def test_staged_scores_end_where_the_model_does(spark):
    d, _, _ = nonlinear(spark, 200)
    model = stages.boosted(d, ["f0", "f1"], "y", 7, 2)
    got = stages.staged_scores(model, d, ["f0", "f1"], 3).orderBy("id").collect()
    want = model.transform(stages.assembled(d, ["f0", "f1"])).orderBy("id").collect()
    assert len(got[0]["staged"]) == 3 and all(abs(a["staged"][-1] - b["prediction"]) < 1e-9 for a, b in zip(got, want))


def test_boosting_of_equal_features_is_that_of_all_rows(spark):
    rows = [(float(i % 3), float(i // 3 % 5), float((i * 37) % 101) / 10 + 3.0 * (i % 3 == 1) * (i // 3 % 5 > 2)) for i in range(900)]
    d = spark.createDataFrame(rows, "f0 double, f1 double, y double")
    few = stages.weighted(d, ["f0", "f1"], "y")
    assert few.count() == 15 and few.agg(F.sum("__w")).first()[0] == 900
    model = stages.boosted(d, ["f0", "f1"], "y", 6, 3, 0.3)
    plain = stages.GBTRegressor(featuresCol="features", labelCol="y", maxIter=6, maxDepth=3, stepSize=0.3, seed=1).fit(stages.assembled(d, ["f0", "f1"]))
    every = stages.assembled(few, ["f0", "f1"])
    a, b = (sorted((r["f0"], r["f1"], r["prediction"]) for r in m.transform(every).collect()) for m in (model, plain))
    assert np.allclose(a, b)


def test_correlations_of_all_settings_in_one_aggregate(spark):
    d, _, y = nonlinear(spark, 200)
    got = stages.group_correlations(d, ["grp"], "y", F.array("f0", "f1", F.lit(1.0)), 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # settings are spread over groups, not over rows
    long = d.select("grp", "y", F.posexplode(F.array("f0", "f1", F.lit(1.0))).alias("setting", "s"))
    want = {(r["grp"], r["setting"]): r["r"] for r in long.groupBy("grp", "setting").agg(stages.pearson("y", "s").alias("r")).collect()}
    rows = got.collect()
    assert len(rows) == 60 and all(r["r"] is None if r["setting"] == 2 else abs(r["r"] - want[r["grp"], r["setting"]]) < 1e-12 for r in rows)


def test_residual_boosting(spark):
    d, x, y = nonlinear(spark)
    train, test = d.filter("id < 480"), d.filter("id >= 480")
    out, chosen = stages.residual_boosting(train, test, "fold", "grp", "y", "x", ["f0", "f1", "f2"], (0.001, 10.0), rounds=12, every=4, depth=3, step=0.3)
    rows = sorted(tuple(r) for r in out.select("id", "y", "stage1", "score").collect())
    coef, a = dense_ridge(x[:480], y[:480], chosen["penalty"])
    assert len(rows) == 120 and np.allclose([r[2] for r in rows], x[480:] @ coef + a)
    error = [np.mean([(r[1] - r[i]) ** 2 for r in rows]) for i in (2, 3)]
    assert chosen["penalty"] == 0.001 and error[1] < 0.6 * error[0] and chosen["trees"] in (4, 8, 12)
    curve = {(r["fold"], r["setting"]): r["r"] for r in chosen["curve"].collect()}
    fold = np.arange(480) % 4
    for k in range(4):
        coef, a = dense_ridge(x[:480][fold != k], y[:480][fold != k], 10.0)
        s, own = x[:480] @ coef + a, [i for i in range(480) if i % 4 == k]
        by = [np.corrcoef(s[[i for i in own if i % 20 == g]], y[[i for i in own if i % 20 == g]])[0, 1] for g in range(20) if any(i % 20 == g for i in own)]
        assert abs(curve[k, 1] - np.mean(by)) < 1e-9
    with pytest.raises(ValueError):
        stages.residual_boosting(train.filter("fold < 2"), test, "fold", "grp", "y", "x", ["f0"])


def test_forward_variants(spark):
    g = np.random.Generator(np.random.PCG64(4))
    rows, dense = [], []
    for period in (1, 2, 3, 4, 5):
        for group in range(3):
            for i in range(15):
                x = g.normal(size=4)
                y = float(x @ [1, 2, 0, 0] + group + 0.1 * g.normal())
                for name, z in (("full", x), ("half", x * [1, 0, 1, 1])):
                    rows.append((name, f"{group}_{period}", period, y, z.tolist()))
                dense.append((f"{group}_{period}", period, y, x))
    d = spark.createDataFrame(rows, "variant string, grp string, period int, y double, x array<double>")
    out, best = stages.forward_variants(d, "variant", "grp", "period", "y", "x", 4, (0.001, 1.0, 100.0))
    choice = {r["variant"]: r for r in best.collect()}
    got = out.collect()
    assert {r["period"] for r in got} == {4} and choice["full"]["validation"] > choice["half"]["validation"]
    past = [r for r in dense if r[1] < 4]
    x, y, names = np.array([r[3] for r in past]), np.array([r[2] for r in past]), [r[0] for r in past]
    for n in set(names):
        at = [i for i, m in enumerate(names) if m == n]
        x[at] -= x[at].mean(0)
        y[at] -= y[at].mean()
    a = x.T @ x
    coef = np.linalg.solve(a + choice["full"]["penalty"] * np.trace(a) / 4 * np.eye(4), x.T @ y)
    assert all(abs(r["score"] - np.dot(r["x"], coef)) < 1e-6 for r in got if r["variant"] == "full")
    later = d.withColumn("y", F.when(F.col("period") >= 4, F.lit(1e6)).otherwise(F.col("y")))
    again, _ = stages.forward_variants(later, "variant", "grp", "period", "y", "x", 4, (0.001, 1.0, 100.0))
    assert sorted(round(r["score"], 8) for r in again.collect()) == sorted(round(r["score"], 8) for r in got)


def test_moments_of_scaled_features(spark):
    d, _, _ = nonlinear(spark, 200)
    d = d.withColumn("f", F.length("grp") - 1.5)
    m = stages.moments(d, ["grp", "f"], "x", "y")
    got = {r["grp"]: r["m"] for r in stages.scaled_moments(m, ["grp"], "f").collect()}
    full = stages.moments(d.withColumn("z", F.concat("x", F.transform("x", lambda v: v * F.col("f")))), ["grp"], "z", "y")
    want = {r["grp"]: r["m"] for r in full.collect()}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)


def test_lags(spark):
    history = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 6.0), ("b", 2, 8.0)], "place string, period int, v double")
    cells = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9)], "place string, period int")
    got, names = stages.with_lags(cells, history, "place", "period", "v")
    assert names == ["lag1", "lag2"] and sorted(tuple(r) for r in got.select("place", *names).collect()) == [("a", 6.0, 3.0), ("b", 8.0, 3.0), ("c", 0.0, 0.0)]


def test_averaged_boosting_on_identical_folds(spark):
    d, _, _ = nonlinear(spark, 300)
    calls = []

    def boosting(train, test):
        calls.append({r["fold"] for r in train.select("fold").distinct().collect()} & {r["fold"] for r in test.select("fold").distinct().collect()})
        return stages.averaged_boosting(train, test, ["f0", "f1", "f2"], "y", (1, 2), rounds=5, out="score")

    got = stages.on_identical_folds(d, "fold", (0, 1), {"boosting": boosting, "mean": lambda train, test: test.withColumn("score", F.lit(0.0))}).collect()
    assert calls == [set(), set()] and {m: len([r for r in got if r["method"] == m]) for m in ("boosting", "mean")} == {"boosting": 150, "mean": 150}
    own = [r for r in got if r["method"] == "boosting"]
    assert np.corrcoef([r["y"] for r in own], [r["score"] for r in own])[0, 1] > 0.6


def test_sampled_boosting_is_spark_mls_and_its_passes_do_not_grow_with_seeds(spark):
    """With all rows in every bag the trees are Spark ML's own; with 70 % scores are near those of Spark ML's, and reruns agree in any partitioning."""
    from pyspark.ml.regression import GBTRegressor

    from harrow.operators import learners

    g = np.random.Generator(np.random.PCG64(7))
    n = 4000
    x = np.c_[g.integers(0, 30, n), g.integers(0, 9, n), g.integers(0, 5, n), np.ones(n)] / 2.0
    y = x[:, 0] + 4.0 * (x[:, 1] > 2) * (x[:, 2] > 1) + g.normal(size=n)
    c = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, y double").cache()
    f = learners.assembled(d, c)
    scores = lambda out, name: out.orderBy("id").toPandas()[name].to_numpy()
    plain = lambda rate, seed: scores(GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=seed, subsamplingRate=rate).fit(f).transform(f).select("id", "prediction"), "prediction")
    whole = learners.sampled_boosting(d, d, c, "y", [1], 4, 3, 0.1, 1.0, block=1000)
    assert np.abs(scores(whole, "prediction") - plain(1.0, 1)).max() < 1e-9
    jobs = []

    def own(frame, seeds):
        spark.sparkContext.setJobGroup(f"boosting-{len(jobs)}", "")
        out = stages.averaged_boosting(frame, d, c, "y", seeds, rounds=4, keys=["id"])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{len(jobs)}")))
        return scores(out, "boosted")

    one, again, three, other = own(d, (1,)), own(d.repartition(7, "y"), (1,)), own(d, (1, 2, 3)), own(d, (2,))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[2] and np.abs(one - again).max() < 1e-9 and np.abs(one - other).max() > 1e-3
    a, b = plain(0.7, 1), plain(0.7, 2)
    assert np.abs(one - a).mean() < 2 * np.abs(a - b).mean() and np.abs(three - one).max() > 1e-3
    kept = [learners._kept(np.arange(20_000, dtype=np.uint64), 1, tree, 0.7) for tree in (0, 1)]
    assert all(abs(k.mean() - 0.7) < 0.02 for k in kept) and abs((kept[0] & kept[1]).mean() - 0.49) < 0.02
    gaps = d.withColumn("a", F.when(F.col("id") > 99, F.col("a")))
    assert learners.sampled_boosting(gaps, gaps, c, "y", [1], 2, 3, 0.1, 0.7).count() == n - 100
    with pytest.raises(Exception, match="a number in every row"):
        own(d.withColumn("y", F.when(F.col("id") != 7, F.col("y"))), (1,))
    with pytest.raises(ValueError, match="no rows"):
        own(d.filter("id < 0"), (1,))


def test_bin_edges_of_all_columns(spark):
    from harrow.operators import learners

    rows = [(float(i % 7) if i % 5 else None, float(i), 3.0, float("nan") if i % 3 else -0.0) for i in range(2000)]
    got = learners.bin_edges(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), ["a", "b", "c", "d"])
    assert got["a"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and got["c"] == got["d"] == []
    assert len(got["b"]) == 31 and all(abs(e - 2000 * k / 32) < 5 for k, e in enumerate(got["b"], 1))


def test_wide_cells_are_centred_without_sorting_groups(spark):
    from harrow.plans import queries_stages, testbed

    d = queries_stages.wide_cells(testbed.Testbed(spark, DATA))
    assert "Window" not in d._jdf.queryExecution().executedPlan().toString()
    assert max(abs(r["m"]) for r in d.groupBy("group_id").agg(F.avg("y").alias("m")).collect()) < 1e-9


def test_external_folds_resume_and_refuse(spark, tmp_path):
    d, _, _ = nonlinear(spark, 80)
    calls = []

    def run(train, test):
        calls.append((train.count(), test.count()))
        return test.select("id", F.lit(float(len(calls))).alias("score"))

    folds = [("one", F.col("fold") < 2, F.col("fold") == 2), ("two", F.col("fold") < 3, F.col("fold") == 3)]
    first = stages.external_folds(d, folds[:1], run, f"file://{tmp_path}/x")
    assert first.count() == 20 and calls == [(40, 20)]
    both = stages.external_folds(d, folds, run, f"file://{tmp_path}/x")
    assert calls == [(40, 20), (60, 20)] and sorted({(r["fold"], r["score"]) for r in both.collect()}) == [("one", 1.0), ("two", 2.0)]
    with pytest.raises(ValueError):
        stages.external_folds(d, [("bad", F.col("fold") < 3, F.col("fold") == 2)], run, f"file://{tmp_path}/y")


def test_selected_per_group(spark):
    curve = spark.createDataFrame([("f", "m", 1, 10, 0.5), ("f", "m", 1, 20, 0.4), ("f", "m", 2, 10, 0.1), ("f", "m", 2, 20, 0.6), ("f", "m", 1, 30, None)], "fold string, model string, inner int, setting int, r double")
    audit = spark.createDataFrame([("f", "m", s, g, r) for s, g, r in ((10, "a", 0.1), (10, "b", 0.3), (20, "a", 0.9), (20, "b", -0.8), (30, "a", 0.2), (30, "b", 0.4))], "fold string, model string, setting int, grp string, r double")
    first = spark.createDataFrame([("f", 1)], "fold string, inner int")
    got = {(r["protocol"], r["grp"]): (r["setting"], r["r"]) for r in stages.selected_per_group(curve, audit, "fold", "model", "inner", "setting", "grp", "r", first).collect()}
    assert got == {("P1", "a"): (10, 0.1), ("P1", "b"): (10, 0.3), ("P2", "a"): (30, 0.2), ("P2", "b"): (30, 0.4), ("P3", "a"): (20, 0.9), ("P3", "b"): (20, -0.8)}


# ---- queries without SQL


def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


def test_f5_and_f6_queries(spark):
    ids, x = vectors(spark)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    sign = lambda v: v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
    got = {r["vec_id"]: list(r)[1:] for r in registry.queries()["f5_principal_components"](spark, DATA).collect()}
    assert np.abs(np.array([got[i] for i in ids]) - x @ sign(vt[:8].T) + x.mean(0) @ sign(vt[:8].T)).max() < 1e-5
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    rows = registry.queries()["f6_truncated_svd"](spark, DATA).collect()
    assert len(rows) == len(ids) and np.allclose([rows[0][f"s{i}"] for i in range(1, 9)], s[:8], rtol=2e-3)
    u = np.array([[r[f"u{i}"] for i in range(1, 4)] for r in sorted(rows)])
    assert np.allclose(np.sqrt((u**2).sum(0)), s[:3], rtol=1e-3)


def test_f16_query(spark):
    ids, x = vectors(spark)
    cov = np.cov(x.T)
    root = np.linalg.cholesky(np.linalg.inv(cov + 1e-3 * np.diag(np.diag(cov))))
    z = x @ root
    got = {r["vec_id"]: r["distance"] for r in registry.queries()["f16_mahalanobis"](spark, DATA).collect()}
    assert set(got) == {i for i in ids if i % 100 == 0}
    for i, d in got.items():
        own = np.sort(np.sqrt(((z - z[ids.index(i)]) ** 2).sum(1)))[1:6]
        assert abs(own.mean() - d) < 1e-5


def test_j5_query(spark):
    rows = registry.queries()["j5_forest_and_boosting"](spark, DATA).collect()
    assert len(rows) > 100 and all(r["forest"] is not None and r["boosting"] is not None for r in rows) and len({r["boosting"] for r in rows}) > 20


def test_learners_on_bins_are_those_on_rows(spark, monkeypatch):
    """Boosting on at most 32 values is Spark ML's own; the forest's scores are near those of Spark ML's; neither fits on rows."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from harrow.operators import learners

    g = np.random.Generator(np.random.PCG64(5))
    n = 6000
    x = np.c_[g.integers(0, 12, n), g.integers(0, 9, n), g.integers(0, 5, n)] / 2.0
    y = x[:, 0] + 2.0 * (x[:, 1] > 2) * (x[:, 2] > 1) + g.normal(size=n)
    d = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double").cache()
    sizes, kept = [], learners.weighted
    monkeypatch.setattr(learners, "weighted", lambda *a: sizes.append((out := kept(*a)).count()) or out)
    got = {r["id"]: r["prediction"] for r in learners.boosting(d, d, ["a", "b", "c"], "y", rounds=5).collect()}
    f = learners.assembled(d, ["a", "b", "c"])
    want = {r["id"]: r["prediction"] for r in GBTRegressor(labelCol="y", maxIter=5, maxDepth=4, stepSize=0.06, seed=1).fit(f).transform(f).collect()}
    assert len(sizes) == 1 and sizes[0] <= 12 * 9 * 5 and len(got) == n and max(abs(got[i] - want[i]) for i in want) < 1e-9
    rf = lambda seed: RandomForestRegressor(labelCol="y", numTrees=60, minInstancesPerNode=3, seed=seed).fit(f).transform(f).orderBy("id").select("prediction").toPandas()["prediction"].to_numpy()
    own = [learners.forest(d, d, ["a", "b", "c"], "y", 60, seed).orderBy("id").toPandas()["prediction"].to_numpy() for seed in (1, 1, 2)]
    a, b = rf(1), rf(2)
    assert np.array_equal(own[0], own[1]) and len(own[0]) == n
    assert np.abs(own[0] - a).mean() < 2 * np.abs(a - b).mean() and np.corrcoef(own[0], a)[0, 1] > 0.99
    bags = learners.bagged(learners._in_cells(*learners.binned(d, ["a", "b", "c"], learners.bin_edges(d, ["a", "b", "c"])), 32), "y", 25, 3, most=5).toPandas()
    assert set(bags["__batch"]) == {0, 1, 2} and abs(sum(map(sum, bags["__k"])) / (25 * n) - 1) < 0.02


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """The tables with the prices of all cells that are scored, and of later years, replaced."""
    d = tmp_path_factory.mktemp("changed")
    for name in os.listdir(DATA):
        if name != "lineitem.parquet":
            os.symlink(f"{DATA}/{name}", d / name)
    place = spark.read.parquet(f"{DATA}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("place"))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    year = F.year("l_shipdate")
    keyed = lines.join(place, "l_suppkey").withColumns({"group_id": F.concat_ws("_", "place", year), "entity": F.col("l_partkey")})
    scored = (year > queries_blocks.TARGET) | ((year == queries_blocks.TARGET) & ~queries_blocks.observed())
    keyed.withColumn("l_extendedprice", F.when(scored, 1e7 * F.rand(1)).otherwise(F.col("l_extendedprice"))).select(lines.columns).write.parquet(f"file://{d}/sparse")
    forward = lines.withColumn("l_extendedprice", F.when(year >= queries_blocks.TARGET, 1e7 * F.rand(2)).otherwise(F.col("l_extendedprice")))
    forward.write.parquet(f"file://{d}/forward")
    out = {}
    for kind in ("sparse", "forward"):
        out[kind] = tmp_path_factory.mktemp(kind)
        for name in os.listdir(DATA):
            os.symlink(d / kind if name == "lineitem.parquet" else f"{DATA}/{name}", out[kind] / name)
    yield out
    shutil.rmtree(d, ignore_errors=True)


@pytest.mark.parametrize("name, kind", [("j15_group_effects", "sparse"), ("j9_backfitted_effects", "sparse"), ("j14_location_effects", "forward"), ("j8_interaction_ridge", "forward"), ("j24_kernel_cells", "forward"), ("j27_penalty_on_validation", "forward")])
def test_scored_cells_do_not_leak(spark, changed, name, kind):
    a = sorted(tuple(r) for r in registry.queries()[name](spark, DATA).collect())
    b = sorted(tuple(r) for r in registry.queries()[name](spark, str(changed[kind])).collect())
    assert len(a) == len(b) > 50 and all(p[:2] == q[:2] or isinstance(p[1], float) for p, q in zip(a, b))
    assert all(abs(x - y) < 2e-3 for p, q in zip(a, b) for x, y in zip(p, q) if isinstance(x, float))
    assert max(abs(x) for p in a for x in p if isinstance(x, float)) > 0.05


def test_manifest_query(spark):
    import hashlib

    got = {r["file"]: (r["bytes"], r["sha256"]) for r in registry.queries()["a16_manifest"](spark, DATA).collect()}
    want = {n: open(f"{DATA}/{n}", "rb").read() for n in os.listdir(DATA)}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}


def test_manifest_of_files_longer_than_a_piece(spark, tmp_path):
    import hashlib

    from harrow.sources import genotypes

    g = np.random.Generator(np.random.PCG64(3))
    sizes = {"one": 1, "at": 1000, "over": 1001, "pieces": 4 * 4096, "odd": 5 * 4096 + 777, "prime [1], {2}": 40_009, "more.parquet": 70_001, "packed.gz": 5000}
    want = {}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(b := g.bytes(n))
        want[name] = (n, hashlib.sha256(b).hexdigest())
    d = genotypes.manifest(spark, f"file://{tmp_path}", 1000, ((4096, 256), (512, 256), (256, 1)))
    assert {r["file"]: (r["bytes"], r["sha256"]) for r in d.collect()} == want
