"""Learners of Spark ML on long feature tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.staging import staged

#: Bins of a feature: Spark ML's own number.
BINS = 32


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def weighted(train: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(columns, target, __w): rows of equal features as one, with their mean and number, written once.

    A split by squared error cannot part such rows, and what is left of them after a tree differs by the same amount, so
    boosting on all rows fits the same trees on means weighted by numbers; the work grows with the distinct features.
    """
    mean = F.when(F.count(target) == F.count(F.lit(1)), F.avg(target))  # a null target is Spark ML's to refuse, as in rows
    return staged(train.groupBy(*columns).agg(mean.alias(target), F.count(F.lit(1)).cast("double").alias("__w")), "boosting-weighted")


def bin_edges(train: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Lower ends of each column's bins but the first: its values where there are at most ``bins``, else quantiles of all rows.

    One pass finds the values of all columns (a task keeps ``bins`` + 1 of each at most), one the quantiles of those with more.
    """
    d = train.select(*(F.col(c).cast("double").alias(c) for c in columns))

    def run(frames):
        seen = [np.empty(0)] * len(columns)
        for t in frames:
            for j, c in enumerate(columns):
                if len(seen[j]) <= bins:
                    v = t[c].to_numpy()
                    seen[j] = np.unique(np.concatenate([seen[j], v[~np.isnan(v)] + 0.0]))[: bins + 1]
        yield pd.DataFrame({"c": np.repeat(np.arange(len(columns)), [len(v) for v in seen]), "v": np.concatenate(seen)})

    values = d.mapInPandas(run, "c int, v double").groupBy("c").agg(F.sort_array(F.collect_set("v")).alias("v"))
    found = {columns[r["c"]]: r["v"] for r in values.select("c", F.slice("v", 1, bins + 1).alias("v")).collect()}
    wide = [c for c in columns if len(found.get(c, ())) > bins]
    quantiles = dict(zip(wide, d.approxQuantile(wide, [k / bins for k in range(1, bins)], 1 / (32 * bins)))) if wide else {}
    return {c: sorted(set(quantiles[c])) if c in quantiles else list(found.get(c, ()))[1:] for c in columns}


def binned(df: DataFrame, columns: list[str], edges: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """``df`` with the number of each column's bin; rows without one of the numbers are skipped, as ``assembled`` skips them."""
    names = [f"__bin_{c}" for c in columns]
    d = df.select("*", *(F.col(c).cast("double").alias(f"__d_{c}") for c in columns)).dropna(subset=[f"__d_{c}" for c in columns])
    splits = [[-np.inf, *edges[c], np.inf] for c in columns]
    wide = [c for c, s in zip(columns, splits) if len(s) > 2]
    if wide:
        d = Bucketizer(splitsArray=[s for s in splits if len(s) > 2], inputCols=[f"__d_{c}" for c in wide], outputCols=[f"__bin_{c}" for c in wide]).transform(d)
    d = d.withColumns({f"__bin_{c}": F.col(f"__bin_{c}") + 0.0 if c in wide else F.lit(0.0) for c in columns})  # as numbers: Bucketizer calls them categories
    return d.drop(*(f"__d_{c}" for c in columns)), names


def _in_cells(d: DataFrame, names: list[str], bins: int) -> DataFrame:
    return d.withColumn("__cell", sum((F.col(n).cast("long") * bins**i for i, n in enumerate(names)), F.lit(0).cast("long")))


def bagged(d: DataFrame, target: str, trees: int, seed: int, together: int = 10, most: int = 1_000_000) -> DataFrame:
    """(__cell, __batch, __k, __s): for each tree how often the cell's rows are drawn (Poisson with mean 1, each row by itself) and their target's total.

    What a tree by squared error needs of its bag, so that trees are fitted on cells and not on rows. Trees stand ``together``
    in a batch's arrays; cells of more than ``most`` rows are dealt to several tasks.
    """
    rows = d.select("__cell", F.col(target).cast("double").alias("__y"))
    share = rows.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("__of"))
    rows = rows.join(share, "__cell").withColumn("__salt", F.pmod(F.xxhash64("__y"), "__of")).drop("__of")
    rows = rows.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__cell", "__salt").sortWithinPartitions("__cell", "__salt", "__y")
    batches = [(b, min(together, trees - b * together)) for b in range(-(-trees // together))]

    def out(key, k, s):
        return {"__cell": [key[0]] * len(batches), "__batch": [b for b, _ in batches], "__k": np.split(k, range(together, trees, together)), "__s": np.split(s, range(together, trees, together))}

    def run(frames):
        at, k, s, g = None, None, None, None
        for t in frames:
            for key, part in t.groupby(["__cell", "__salt"], sort=False)["__y"]:
                if key != at:
                    if at is not None:
                        yield pd.DataFrame(out(at, k, s))
                    at, k, s, g = key, np.zeros(trees), np.zeros(trees), np.random.Generator(np.random.PCG64([seed, *map(int, key)]))
                y = part.to_numpy()
                drawn = g.poisson(1.0, (len(y), trees))
                k, s = k + drawn.sum(0), s + y @ drawn
        if at is not None:
            yield pd.DataFrame(out(at, k, s))

    return rows.mapInPandas(run, "__cell long, __batch int, __k array<double>, __s array<double>")


def _tree(x: np.ndarray, w: np.ndarray, s: np.ndarray, bins: int, depth: int, least: int, tried: int, g: np.random.Generator) -> np.ndarray:
    """(feature or -1, last bin to the left, value) of each node, children of i at 2i + 1 and 2i + 2, from weights and totals by cell."""
    out = np.full((2 ** (depth + 1) - 1, 3), -1.0)
    node, live = np.zeros(len(x), np.int64), w > 0
    x, w, s, node = x[live], w[live], s[live], node[live]
    for level in range(depth + 1):
        n, first = 2**level, 2**level - 1
        tw, ts = (np.bincount(node, v, n) for v in (w, s))
        out[first : first + n, 2] = np.divide(ts, tw, out=np.zeros(n), where=tw > 0)
        if level == depth or not len(x):
            break
        may = np.argsort(g.random((n, x.shape[1])), 1) < tried
        best, feature, at = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        for j in range(x.shape[1]):
            lw, ls = (np.bincount(node * bins + x[:, j], v, n * bins).reshape(n, bins).cumsum(1)[:, :-1] for v in (w, s))
            rw, rs = tw[:, None] - lw, ts[:, None] - ls
            ok = (lw >= least) & (rw >= least) & may[:, [j]]
            gain = np.where(ok, ls**2 / np.maximum(lw, 1) + rs**2 / np.maximum(rw, 1) - (ts**2 / np.maximum(tw, 1))[:, None], 0.0)
            k = gain.argmax(1)
            better = gain[np.arange(n), k] > np.maximum(best, 1e-12)
            best, feature, at = np.where(better, gain[np.arange(n), k], best), np.where(better, j, feature), np.where(better, k, at)
        out[first : first + n, 0], out[first : first + n, 1] = feature, at
        f = feature[node]
        keep = f >= 0
        x, w, s, node, f = x[keep], w[keep], s[keep], node[keep], f[keep]
        node = 2 * node + (x[np.arange(len(x)), f] > at[node])
    return out


def _leaves(tree: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = tree[at, 0].astype(np.int64)
        at = np.where(f < 0, at, 2 * at + 1 + (x[rows, f] > tree[at, 1]))
    return tree[at, 2]


def forest(train: DataFrame, test: DataFrame, columns: list[str], target: str, trees: int = 300, seed: int = 1, depth: int = 5, least: int = 3, bins: int = BINS) -> DataFrame:
    """Random forest; adds ``prediction``.

    As Spark ML's (bins of each feature, Poisson bags of rows, a third of the features tried at a node), but one pass over the
    rows draws the bags of all trees and sums them by cell of bins, and trees grow on cells: the passes do not grow with trees.
    """
    edges, p, tried = bin_edges(train, columns, bins), len(columns), -(-len(columns) // 3)
    d, names = binned(train, columns, edges)
    sums = bagged(_in_cells(d, names, bins), target, trees, seed)

    def grown(key, t):
        cells, of = np.unique(t["__cell"].to_numpy(), return_inverse=True)
        k, s = (np.stack(t[c].to_list()) for c in ("__k", "__s"))
        w, y = (np.zeros((len(cells), k.shape[1])) for _ in range(2))
        np.add.at(w, of, k), np.add.at(y, of, s)
        x = cells[:, None] // bins ** np.arange(p) % bins
        made = [_tree(x, w[:, i], y[:, i], bins, depth, least, tried, np.random.Generator(np.random.PCG64([seed, int(key[0]), i]))) for i in range(k.shape[1])]
        return pd.DataFrame({"tree": [m.ravel() for m in made]})

    model = [np.array(r["tree"]).reshape(-1, 3) for r in sums.groupBy("__batch").applyInPandas(grown, "tree array<double>").collect()]
    now = staged(_in_cells(binned(test, columns, edges)[0], names, bins).drop(*names), "forest-test")

    def scored(frames):
        for t in frames:
            x = t["__cell"].to_numpy()[:, None] // bins ** np.arange(p) % bins
            yield t.assign(prediction=sum(_leaves(m, x, depth) for m in model) / len(model))

    cells = now.select("__cell").distinct().mapInPandas(scored, "__cell long, prediction double")
    return now.join(cells, "__cell").drop("__cell")


def boosting(train: DataFrame, test: DataFrame, columns: list[str], target: str, rounds: int = 300, depth: int = 4, step: float = 0.06, seed: int = 1, bins: int = BINS) -> DataFrame:
    """Gradient boosting; adds ``prediction``. Spark ML's trees see bins of features, so they are fitted on rows by bins, weighted; its bins are of a sample, these of all rows."""
    edges = bin_edges(train, columns, bins)
    d, names = binned(train, columns, edges)
    gbt = GBTRegressor(featuresCol="features", labelCol=target, weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxBins=bins)
    model = gbt.fit(assembled(weighted(d, names, target), names))
    return model.transform(assembled(binned(test, columns, edges)[0], names)).drop("features", *names)

def _places(tree: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place among the nodes of a level; rows of a node without a split go left. ``x``: (features, rows)."""
    at = np.zeros(x.shape[1], np.uint16)
    for level in range(levels):
        right = np.zeros(x.shape[1], bool)
        for i, (f, last, _) in enumerate(tree[2**level - 1 : 2 ** (level + 1) - 1]):
            if f >= 0:
                right |= (at == i) & (x[int(f)] > int(last))
        at = 2 * at + right
    return at


def _kept(h: np.ndarray, seed: int, tree: int, rate: float) -> np.ndarray:
    """Which rows a tree takes: ``rate`` of them, by a mix of the row's number, the seed and the tree's (splitmix64)."""
    start = int(np.random.SeedSequence([seed % 2**64, tree]).generate_state(1, np.uint64)[0])
    z = h ^ np.uint64(start)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < np.uint64(int(rate * 2**53))


def _split(tree: np.ndarray, level: int, w: np.ndarray, s: np.ndarray) -> None:
    """Best splits of a level by squared error, from weights and totals (nodes, features, bins); values go down to all nodes below."""
    n, first = 2**level, 2**level - 1
    lw, ls = w.cumsum(2)[:, :, :-1], s.cumsum(2)[:, :, :-1]
    tw, ts = w[:, 0].sum(1), s[:, 0].sum(1)
    if level == 0:
        tree[:, 2] = ts[0] / tw[0] if tw[0] else 0.0
    rw, rs = tw[:, None, None] - lw, ts[:, None, None] - ls
    whole = ts**2 / np.maximum(tw, 1)
    gain = np.where((lw >= 1) & (rw >= 1), ls**2 / np.maximum(lw, 1) + rs**2 / np.maximum(rw, 1) - whole[:, None, None], 0.0).reshape(n, -1)
    best = gain.max(1)
    for i in np.flatnonzero(best > 1e-12 * whole):
        if level and tree[(first + i - 1) // 2, 0] < 0:
            continue  # below a leaf
        k = int((gain[i] >= best[i] * (1 - 1e-9)).argmax())  # ties in exact arithmetic do not go by the order of sums
        f, b = divmod(k, w.shape[2] - 1)
        tree[first + i, :2] = f, b
        for side, value in enumerate((ls[i, f, b] / lw[i, f, b], rs[i, f, b] / rw[i, f, b])):
            lo = hi = 2 * (first + i) + 1 + side
            while lo < len(tree):
                tree[lo : hi + 1, 2] = value
                lo, hi = 2 * lo + 1, 2 * hi + 2


def _sum_of_trees(model: list[tuple[np.ndarray, float]], x: np.ndarray, depth: int) -> np.ndarray:
    """The sum of a model's trees."""
    out = np.zeros(x.shape[1])
    for tree, weight in model:
        out += (weight * tree[2**depth - 1 :, 2])[_places(tree, x, depth)]
    return out


def _in_bins(values: list, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, np.asarray(v, float), "right").astype(np.uint8) for v, e in zip(values, edges)])


def sampled_boosting(
    train: DataFrame, test: DataFrame, columns: list[str], target: str, seeds: Iterable[int], rounds: int, depth: int, step: float, rate: float, keys: list[str] | None = None, bins: int = BINS,
    out: str = "prediction", block: int = 65_536,
) -> DataFrame:
    """Mean of gradient boostings whose trees take a share ``rate`` of the rows each; one for each seed; adds ``out``.

    The method is that of Spark ML's GBTRegressor: bins of each feature, squared error, the first tree in full, a row in a
    tree's bag by itself. Rows are written once as blocks of arrays (a byte a feature, the target, a number to draw by). A
    level of a tree is one pass over the blocks for all seeds at once: a task adds up weights and residuals by node,
    feature and bin, and these sums, whose size does not depend on the rows, are all that leaves it. What trees so far
    predict is worked out anew in a pass and not kept by row. ``keys`` name a row, so that reruns draw the same bags; rows
    with equal keys are drawn together. Without them rows are drawn by their place. ``train`` is read three times.
    """
    seeds, p = list(seeds), len(columns)
    if not (2 <= bins <= 256 and 1 <= depth <= 15 and 0 < rate <= 1 and rounds >= 1 and seeds):
        raise ValueError("2 to 256 bins, depth 1 to 15, a rate over 0 up to 1, at least one round and seed")
    number = F.xxhash64(*keys) if keys else F.xxhash64(F.monotonically_increasing_id())
    train = train.select(*columns, target, number.alias("__h")).dropna(subset=columns)
    found = bin_edges(train, columns, bins)
    edges = [np.array(found[c], float) for c in columns]

    def packed(x, y, h):
        return pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "h": [h.tobytes()]})

    def blocks(frames):
        held, n = [], 0
        for t in frames:
            y = t["__y"].to_numpy(float)
            if not np.isfinite(y).all():
                raise ValueError(f"{target} has to be a number in every row to fit on")
            held.append((_in_bins([t[f"__c{j}"] for j in range(p)], edges), y, t["__h"].to_numpy(np.int64)))
            n += len(y)
            if n >= block:
                yield packed(*(np.concatenate(a, -1) for a in zip(*held)))
                held, n = [], 0
        if n:
            yield packed(*(np.concatenate(a, -1) for a in zip(*held)))

    rows = train.select(*(F.col(c).cast("double").alias(f"__c{j}") for j, c in enumerate(columns)), F.col(target).cast("double").alias("__y"), "__h")
    rows = staged(rows.mapInPandas(blocks, "x binary, y binary, h binary"), "boosting-blocks")
    sizes, together = [len(e) + 1 for e in edges], [[]]
    for j in range(p):  # features counted by one number: a pass counts as often as there are sets of them
        if together[-1] and np.prod([sizes[i] for i in together[-1]]) * sizes[j] > 2048:
            together.append([])
        together[-1].append(j)

    def sums(models, trees, level):
        nodes, m = 2**level, len(models[0])

        def run(frames):
            total = np.zeros((len(seeds), 2, nodes, p, bins))
            for t in frames:
                for x, y, h in zip(t["x"], t["y"], t["h"]):
                    x, y, h = np.frombuffer(x, np.uint8).reshape(p, -1), np.frombuffer(y), np.frombuffer(h, np.uint64)
                    codes = []
                    for own in together:
                        code = np.zeros(len(y), np.int64)
                        for j in own:
                            code = code * sizes[j] + x[j]
                        codes.append(code)
                    for k, seed in enumerate(seeds):
                        r = 2 * (y - _sum_of_trees(models[k], x, depth)) if m else y
                        at = _places(trees[k], x, level).astype(np.int64)
                        if rate < 1:
                            at[~_kept(h, seed, m, rate)] = nodes
                        for own, code in zip(together, codes):
                            shape = [sizes[j] for j in own]
                            n = int(np.prod(shape))
                            of = at * n + code
                            for i, weights in enumerate((None, r)):
                                got = np.bincount(of, weights, (nodes + 1) * n)[: nodes * n].reshape(nodes, *shape)
                                for a, j in enumerate(own):
                                    total[k, i, :, j, : sizes[j]] += got.sum(tuple(b + 1 for b in range(len(own)) if b != a))
            yield pd.DataFrame({"sums": [total.tobytes()]})

        parts = [np.frombuffer(r["sums"]) for r in rows.mapInPandas(run, "sums binary").collect()]
        return np.sum(parts, axis=0).reshape(len(seeds), 2, nodes, p, bins)

    if rows.isEmpty():
        raise ValueError("no rows are left to fit on")
    models = [[] for _ in seeds]
    for m in range(rounds):
        trees = [np.tile([-1.0, -1.0, 0.0], (2 ** (depth + 1) - 1, 1)) for _ in seeds]
        for level in range(depth):
            if level and all((t[2 ** (level - 1) - 1 : 2**level - 1, 0] < 0).all() for t in trees):
                break
            for tree, (w, s) in zip(trees, sums(models, trees, level)):
                _split(tree, level, w, s)
        for model, tree in zip(models, trees):
            model.append((tree, step if m else 1.0))

    @F.pandas_udf("double")
    def scored(*values: pd.Series) -> pd.Series:
        x = _in_bins(values, edges)
        return pd.Series(sum(_sum_of_trees(m, x, depth) for m in models) / len(models))

    return test.dropna(subset=columns).withColumn(out, scored(*(F.col(c).cast("double") for c in columns)))


def principal_components(train: DataFrame, every: DataFrame, columns: list[str], k: int) -> DataFrame:
    """components fitted on centred training rows; all rows projected, as columns pc1..pck. Each component's largest loading is positive."""
    m = train.agg(*(F.avg(c).alias(c) for c in columns)).first()
    mid = lambda d: assembled(d.select("*", *(F.expr(f"`{c}` - {m[c]!r}D").alias(f"__{c}") for c in columns)), [f"__{c}" for c in columns])
    model = PCA(k=k, inputCol="features", outputCol="__pc").fit(mid(train))
    loads = model.pc.toArray()
    sign = np.where(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])] < 0, -1.0, 1.0)
    out = model.transform(mid(every)).withColumn("__pc", vector_to_array("__pc"))
    return out.select(*every.columns, *((F.col("__pc")[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)))
