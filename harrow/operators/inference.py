"""Resampling, pooling and verdicts. Random choices are md5 ranks: any engine draws the same."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.draws import Tails, heads, picks
from harrow.operators.metrics import pearson
from harrow.operators.staging import staged
from harrow.operators.windows import midrank, places, rank_key, totals_before


def draw(n: Column, *key) -> Column:
    """An index below n from the md5 of the key."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % n


def reps(df: DataFrame, b: int) -> DataFrame:
    """Each row with each replicate number."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))


def once(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def by_replicate(packed: DataFrame, keys: list[str], b: int, work: Callable, out: str, per: int = 50, most: int = 200_000) -> DataFrame:
    """(keys, rep, out..): ``work(row, first, last)`` for each row of ``packed``, ``per`` replicates a task's row, so that few rows are dealt to many tasks.

    ``work`` gives an array by replicate for each column of ``out`` (a DDL text); NaN is null.
    """
    names = [c.split()[0] for c in out.split(", ")]
    chunks = packed.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // per))))
    chunks = chunks.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__c")

    def run(batches):
        for t in batches:
            for at in range(0, len(t), max(1, most // per)):
                part = t.iloc[at : at + max(1, most // per)]
                spans = [(c * per, min((c + 1) * per, b)) for c in part["__c"]]
                got = [work(row, *span) for row, span in zip(part.to_dict("records"), spans)]
                frame = part[keys].loc[part.index.repeat([z - a for a, z in spans])].reset_index(drop=True)
                frame["rep"] = np.concatenate([np.arange(a, z) for a, z in spans])
                for i, name in enumerate(names):
                    frame[name] = np.concatenate([g[i] for g in got])
                yield frame

    types = [f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys]
    return chunks.mapInPandas(run, ", ".join([*types, "rep int", out]))


def packed_units(units: DataFrame, strata: list[str], unit: str, columns: list[str], seed: str | Column, key: list[str] | None = None) -> DataFrame:
    """(strata, __p, columns): a row for each stratum: its draws' prefix (seed and ``key``, else the strata) and its columns as arrays of numbers in the order of ``unit``."""
    x = units.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))))).alias("__u"))
    names = [F.col(s).cast("string") for s in (strata if key is None else key)]
    prefix = F.concat_ws("|", F.lit(seed) if isinstance(seed, str) else seed, *names)
    return x.select(*strata, prefix.alias("__p"), *(F.col("__u")[f"c{i}"].alias(c) for i, c in enumerate(columns)))


def drawn(units: DataFrame, strata: list[str], unit: str, columns: list[str], b: int, seed: str | Column, statistic: Callable, out: str, key: list[str] | None = None) -> DataFrame:
    """(strata, rep, out..) of resampled strata: for each stratum of n units and each replicate n draws with replacement.

    A stratum's units (groups or entities of a trial, not records) are arrays, and replicates pick from them by the md5 of
    prefix, replicate and place: there is no join of draws, and only numbers by stratum and replicate leave a task.
    ``statistic(columns, places)``: an array by replicate for each column of ``out``; places are (replicates, n).
    """

    def work(row, first: int, last: int):
        x = [np.asarray(row[c], float) for c in columns]
        parts = [statistic(x, p) for _, p in picks(row["__p"], first, last, len(x[0]))]
        return [np.concatenate(p) for p in zip(*parts)]

    return by_replicate(packed_units(units, strata, unit, columns, seed, key), strata, b, work, out)


def bootstrap_sums(units: DataFrame, strata: list[str], unit: str, value: str, b: int, seed: str | Column, key: list[str] | None = None) -> DataFrame:
    """(strata, rep, s, n): sum and number of the drawn values of each replicate, summed where they are drawn."""
    sums = lambda x, p: (x[0][p].sum(1), np.full(len(p), p.shape[1]))
    return drawn(units.filter(F.col(value).isNotNull()), strata, unit, [value], b, seed, sums, "s double, n long", key)


def correlations(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """M1 by row, as ``metrics.pearson``: pairs with NaN take no part, NaN where either side does not vary; ``w``: how often each pair stands."""
    w = np.ones(x.shape) if w is None else w

    def moment(a, b, ok):
        a, b, k = (np.where(ok, v, 0.0) for v in (a, b, w))
        n = np.maximum(k.sum(1, keepdims=True), 1e-300)
        da, db = (np.where(ok, v - (k * v).sum(1, keepdims=True) / n, 0.0) for v in (a, b))
        return (k * da * db).sum(1) / n[:, 0]

    def varies(a):
        there = ~np.isnan(a) & (w > 0)
        return np.where(there, a, -np.inf).max(1) > np.where(there, a, np.inf).min(1)

    ox, oy = ~np.isnan(x), ~np.isnan(y)
    r = moment(x, y, ox & oy) / np.sqrt(np.maximum(moment(x, x, ox) * moment(y, y, oy), 1e-300))
    return np.where(varies(x) & varies(y) & (np.where(ox & oy, w, 0).sum(1) > 0), r, np.nan)


class Ranked:
    """Mid-ranks of one column in resamples of its units: sorted once, then ranks follow from how often each unit is drawn."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")  # NaN last
        s = keys[self.order]
        self.first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
        self.code = np.empty(len(s), np.int64)
        self.code[self.order] = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(s)]))
        self.null = np.isnan(keys)

    def ranks(self, w: np.ndarray) -> np.ndarray:
        """``w``: (replicates, units) numbers of draws."""
        of_key = np.add.reduceat(w[:, self.order], self.first, axis=1)
        rank = (of_key.cumsum(1) - of_key + (of_key + 1) / 2.0)[:, self.code]
        rank[:, self.null] = np.nan
        return rank


def rank_difference(keys: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Rank correlation of the first column with the second less that with the third, by replicate."""
    v, a, c = (k.ranks(w) for k in keys)
    return correlations(v, a, w) - correlations(v, c, w)


def times_drawn(p: np.ndarray) -> np.ndarray:
    """(replicates, n): how often each unit stands among the places drawn."""
    n = p.shape[1]
    return np.bincount((p + np.arange(len(p))[:, None] * n).ravel(), minlength=p.size).reshape(p.shape)


def bootstrap_mean(units: DataFrame, by: list[str], unit: str, value: str, b: int = 2000, seed: str | Column = "boot", key: list[str] | None = None) -> DataFrame:
    """Mean, bootstrap SE and 95 % interval of the mean over units."""
    d = units.filter(F.col(value).isNotNull()).select(*by, unit, value)
    means = bootstrap_sums(d, by, unit, value, b, seed, key).withColumn("__m", F.col("s") / F.col("n"))
    spread = means.groupBy(*by).agg(F.stddev_samp("__m").alias("se"), F.percentile("__m", F.lit(0.025)).alias("lo"), F.percentile("__m", F.lit(0.975)).alias("hi"))
    return d.groupBy(*by).agg(F.avg(value).alias("d"), F.count(F.lit(1)).alias("n_env")).join(spread, by)


def clustered_bootstrap(units: DataFrame, cluster: str, unit: str, value: str, b: int, seed: str) -> DataFrame:
    """Periods are drawn first, then the units inside each drawn period; SE and interval of the mean.

    The units of all periods are one row of nested arrays, dealt to tasks by replicate.
    """
    per = units.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).cast("double").alias("v")))).alias("u"))
    packed = per.agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("k"), F.col("u.v").alias("v"))))["v"].alias("v")).filter(F.size("v") > 0)

    def work(row, first: int, last: int):
        x = [np.asarray(v, float) for v in row["v"]]
        s, n = np.zeros(last - first), np.zeros(last - first)
        for rep in range(first, last):
            for slot, at in enumerate(next(picks(seed, rep, rep + 1, len(x)))[1][0]):
                got = x[at][next(picks(f"{seed}|{rep}", slot, slot + 1, len(x[at])))[1][0]]
                s[rep - first] += np.nansum(got)
                n[rep - first] += np.count_nonzero(~np.isnan(got))
        return s, n

    means = by_replicate(packed, [], b, work, "s double, n double").select(F.try_divide("s", "n").alias("__m"))
    return means.agg(F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("se"), F.percentile("__m", F.lit(0.025)).alias("lo"), F.percentile("__m", F.lit(0.975)).alias("hi"))


def stratified_mean(units: DataFrame, stratum: str, unit: str, value: str, b: int, seed: str) -> DataFrame:
    """I4: units are drawn within strata; mean over all drawn units."""
    means = bootstrap_sums(units, [stratum], unit, value, b, seed).groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("__m"))
    return means.agg(F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("se"), F.percentile("__m", F.lit(0.025)).alias("lo"), F.percentile("__m", F.lit(0.975)).alias("hi"))


def two_level_bootstrap(units: DataFrame, group: str, seed_col: str, value: str, b: int, seed: str) -> DataFrame:
    """Groups and seeds are drawn independently; the statistic is the mean over drawn groups x drawn seeds.

    The table of groups x seeds is one row of arrays, dealt to tasks by replicate.
    """
    def numbered(c: str) -> DataFrame:
        k = units.select(c).distinct()
        return k.withColumns({"__i": F.row_number().over(Window.orderBy(c)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy())})

    g, s = numbered(group), numbered(seed_col)
    one, other = g.select(group, F.col("__i").alias("i"), F.col("__n").alias("of_g")), s.select(seed_col, F.col("__i").alias("j"), F.col("__n").alias("of_s"))
    cells = units.select(group, seed_col, F.col(value).cast("double").alias("v")).join(one, group).join(other, seed_col)
    packed = cells.groupBy("of_g", "of_s").agg(F.collect_list(F.struct("i", "j", F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("x")).select("of_g", "of_s", *(F.col("x")[c].alias(c) for c in "ijv"))

    def work(row, first: int, last: int):
        i, j, v = (np.asarray(row[c]) for c in "ijv")
        known, top, low = ~np.isnan(v), np.zeros(last - first), np.zeros(last - first)
        for rep in range(first, last):
            of_g, of_s = (np.bincount(next(picks(f"{seed}|{c}", rep, rep + 1, n))[1][0], minlength=n) for c, n in ((group, row["of_g"]), (seed_col, row["of_s"])))
            w = of_g[i] * of_s[j]
            top[rep - first], low[rep - first] = (v[known] * w[known]).sum(), w.sum()
        return np.where(low > 0, top / np.maximum(low, 1), np.nan), low

    means = by_replicate(packed, ["of_g", "of_s"], b, work, "__m double, w double")
    per_seed = units.groupBy(seed_col).agg(F.avg(value).alias("__s"))
    signs = per_seed.agg(F.stddev_samp("__s").alias("seed_sd"), F.greatest(F.avg((F.col("__s") > 0).cast("double")), F.avg((F.col("__s") < 0).cast("double"))).alias("same_sign"))
    return means.agg(F.stddev_samp("__m").alias("se"), F.percentile("__m", F.lit(0.025)).alias("lo"), F.percentile("__m", F.lit(0.975)).alias("hi")).crossJoin(F.broadcast(signs))


def bootstrap_rank_difference(rows: DataFrame, by: list[str], entity: str, value: str, one: str, other: str, b: int, seed: str) -> DataFrame:
    """Entities are drawn within each group; SE of the difference of two rank correlations, ranks taken anew in each replicate."""
    keyed = rows.select(*by, entity, *(rank_key(c, 9).alias(f"__{i}") for i, c in enumerate((value, one, other))))

    def work(row, first: int, last: int):
        keys = [Ranked(np.asarray(row[f"__{i}"], float)) for i in range(3)]
        return [np.concatenate([rank_difference(keys, times_drawn(p)) for _, p in picks(row["__p"], first, last, len(keys[0].code), 32_768)])]

    per = by_replicate(packed_units(keyed, by, entity, ["__0", "__1", "__2"], seed), by, b, work, "__d double", 200)
    return per.groupBy(*by).agg(F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("se"))


def placed(rows: DataFrame, by: list[str], entity: str, columns: list[str], most: int = 500_000) -> DataFrame:
    """(by, __n, __u, __k0.., __r0..): the group's size, a row's place by ``entity``, and for each column how many rows hold less and the mid-rank; written once."""
    d = staged(rows.select(*by, F.col(entity).alias("__e"), *(rank_key(c, 9).alias(f"__v{i}") for i, c in enumerate(columns))), "rank-rows")
    out = d.join(places(d, by, "__e", most).select(*by, "__e", F.col("n_before").alias("__u")), [*by, "__e"])
    for i in range(len(columns)):
        at = places(d, by, f"__v{i}", most).select(*by, f"__v{i}", F.col("n_before").alias(f"__k{i}"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"__r{i}"))
        out = out.join(at, [*by, f"__v{i}"])
    out = out.join(d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    return staged(out.drop("__e", *(f"__v{i}" for i in range(len(columns)))), "rank-places")


def times_drawn_of_many(sizes: DataFrame, by: list[str], seed: str, first: int, last: int, block: int = 65_536, chunk: int = 1 << 20) -> DataFrame:
    """(by, __u, __w): how often each place below ``__n`` is drawn in replicates first .. last - 1; places not drawn have no row.

    A task works out the draws of one replicate in ``chunk`` slots and deals them as arrays to ``block`` places each.
    """
    prefix = F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in by)).alias("__p")
    slots = sizes.select(*by, "__n", prefix, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))).alias("__c"))
    slots = slots.withColumn("__rep", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    keys = ", ".join(f"`{k}` {sizes.schema[k].dataType.simpleString()}" for k in by)

    def draws(batches):
        for t in batches:
            for i, (p, n, c, rep) in enumerate(zip(t["__p"], t["__n"], t["__c"], t["__rep"])):
                end = min((c + 1) * chunk, n)
                at = np.sort(np.concatenate([heads(p, rep, rep + 1, min(262_144, end - s), s)[0] % np.uint32(n) for s in range(c * chunk, end, 262_144)]))
                of, starts = np.unique(at // np.uint32(block), return_index=True)
                frame = t[by].loc[t.index[[i] * len(of)]].reset_index(drop=True)
                frame["__block"], frame["__rep"] = of.astype(np.int64), rep
                frame["__at"] = [x.tobytes() for x in np.split((at % np.uint32(block)).astype(np.uint32), starts[1:])]
                yield frame

    def counted(key, t):
        w = np.zeros((block, last - first), np.int32)
        for rep, at in zip(t["__rep"], t["__at"]):
            w[:, rep - first] += np.bincount(np.frombuffer(at, np.uint32), minlength=block).astype(np.int32)
        found = np.flatnonzero(w.any(1))
        frame = t[by].loc[t.index[[0] * len(found)]].reset_index(drop=True)
        frame["__u"], frame["__w"] = found + int(key[-1]) * block, list(w[found])
        return frame

    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = slots.repartition(tasks, *by, "__c", "__rep").mapInPandas(draws, f"{keys}, __block long, __rep int, __at binary")
    return drawn.groupBy(*by, "__block").applyInPandas(counted, f"{keys}, __u long, __w array<int>")


def rank_difference_of_many(d: DataFrame, by: list[str], b: int, seed: str, together: int = 20, most: int = 500_000, **sizes: int) -> DataFrame:
    """I6 for groups that grow with the table: (by, mean, se) from ``placed`` rows of a value and two scores; the draws are those of ``bootstrap_rank_difference``.

    Ranks in a resample follow from totals of draws by key, dealt by ranges; no group's rows or draws meet in one task.
    ``together``: replicates in one pass.
    """
    n, per = d.select(*by, "__n").distinct(), None
    for first in range(0, b, together):
        last = min(b, first + together)
        w = staged(d.select(*by, "__n", "__u", "__k0", "__k1", "__k2").join(times_drawn_of_many(n, by, seed, first, last, **sizes).hint("merge"), [*by, "__u"]), "rank-weights")
        x = w
        for i in range(3):
            names = [f"s{j}" for j in range(last - first)]
            s = w.groupBy(*by, "__n", f"__k{i}").agg(*(F.sum(F.col("__w")[j]).alias(c) for j, c in enumerate(names)))
            s = totals_before(s, by, f"__k{i}", names, most)  # less the mean rank, which is that of all n draws
            ranks = F.array(*(F.col(f"{c}_before") + (F.col(c) - F.col("__n")) / 2 for c in names))
            x = x.join(s.select(*by, f"__k{i}", ranks.alias(f"__x{i}")), [*by, f"__k{i}"])
        x = x.select(*by, F.posexplode(F.arrays_zip("__w", "__x0", "__x1", "__x2")).alias("__rep", "z")).select(*by, "__rep", "z.*")
        total = lambda p, q: F.sum(F.col("__w") * F.col(f"__x{p}") * F.col(f"__x{q}"))
        r = [F.try_divide(total(0, i), F.sqrt(total(0, 0) * total(i, i))) for i in (1, 2)]
        x = x.groupBy(*by, "__rep").agg((r[0] - r[1]).alias("__d"))
        per = x if per is None else per.unionByName(x)
    return per.groupBy(*by).agg(F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("se"))


def moments(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Additive moments of two columns."""
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def r_of_moments() -> Column:
    """Correlation from summed moments, as an aggregate."""
    n = F.sum("n")
    cov = F.sum("sxy") - F.sum("sx") * F.sum("sy") / n
    vx, vy = F.sum("sxx") - F.sum("sx") * F.sum("sx") / n, F.sum("syy") - F.sum("sy") * F.sum("sy") / n
    return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx * vy)))


def pooled_r_bootstrap(pred: DataFrame, group: str, value: str, score: str, b: int, seed: str) -> DataFrame:
    """SE of the pooled correlation over drawn groups; rows enter once, as their group's moments."""
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    sums = lambda x, p: [c[p].sum(1) for c in x]
    per = drawn(moments(pred, [group], value, score).withColumn("__s", F.lit("all")), ["__s"], group, names, b, seed, sums, ", ".join(f"{c} double" for c in names))
    per = per.groupBy("rep").agg(r_of_moments().alias("__r"))
    return per.agg(F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("se"), ((1 + F.count_if(F.col("__r") <= 0)) / (b + 1)).alias("p_one_sided"))


def permutation_test(df: DataFrame, stratum: str, tie: str, x: str, y: str, b: int, seed: str) -> DataFrame:
    """Rank correlation and its permutation p-value, y dealt anew within strata in each replicate.

    A stratum is one array in the order of ``tie``; a replicate sorts its ends of messages by md5 and sums products. Only
    sums by stratum and replicate leave a task.
    """
    d = df.select(stratum, tie, x, y).withColumns({"__rx": midrank(x, stratum), "__ry": midrank(y, stratum)})
    ends = F.concat_ws("|", F.col(stratum).cast("string"), F.col(tie).cast("string")).alias("end")
    packed = moments(d, [stratum], "__rx", "__ry").join(d.groupBy(stratum).agg(F.sort_array(F.collect_list(F.struct(tie, ends, "__rx", "__ry"))).alias("__u")), stratum)
    names = ["n", "sx", "sy", "sxx", "syy"]

    def work(row, first: int, last: int):
        tails, rx, ry = Tails(list(row["end"])), np.asarray(row["__rx"], float), np.asarray(row["__ry"], float)
        sxy = [np.nansum(rx * ry[tails.order(f"{seed}|{rep}|")]) for rep in range(first, last)]
        return [*(np.full(last - first, float(row[c])) for c in names), np.array(sxy)]

    packed = packed.select(stratum, *names, *(F.col("__u")[c].alias(c) for c in ("end", "__rx", "__ry")))
    per = by_replicate(packed, [stratum], b, work, ", ".join(f"{c} double" for c in [*names, "sxy"])).groupBy("rep").agg(r_of_moments().alias("__r"))
    true = d.agg(pearson("__rx", "__ry").alias("r"))
    return per.crossJoin(F.broadcast(true)).groupBy("r").agg(((1 + F.count_if(F.abs("__r") >= F.abs("r") - 1e-12)) / (b + 1)).alias("p"))


def cross_fitted_best(table: DataFrame, unit: str, method: str, value: str, splits: int, seed: str) -> DataFrame:
    """The method that is best on one half of the units is valued on the other half; both ways, mean over splits."""
    d = reps(table, splits).withColumn("__half", draw(F.lit(2), seed, F.col("rep"), F.col(unit)))
    per = d.groupBy("rep", "__half", method).agg(F.avg(value).alias("__m"))
    best = per.groupBy("rep", "__half").agg(F.min(F.struct((-F.round("__m", 9)).alias("v"), F.col(method).alias("m")))["m"].alias(method)).withColumn("__half", 1 - F.col("__half"))
    return best.join(per, ["rep", "__half", method]).agg(F.avg("__m").alias("value"), F.count(F.lit(1)).alias("n"))


def expected_maximum(table: DataFrame, unit: str, method: str, value: str, b: int, seed: str) -> DataFrame:
    """Expected largest method mean if no method differed from zero: centred by method, units drawn jointly.

    A method's values are one row of arrays with the numbers of their units, dealt to tasks by replicate.
    """
    c = table.withColumn("__c", (F.col(value) - F.avg(value).over(Window.partitionBy(method))).cast("double"))
    units = table.select(unit).distinct()
    units = units.select(unit, (F.row_number().over(Window.orderBy(unit)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))
    packed = c.join(units, unit).groupBy(method, "of").agg(F.collect_list(F.struct("i", F.coalesce("__c", F.lit(float("nan"))).alias("c"))).alias("x")).select(method, "of", *(F.col("x")[k].alias(k) for k in "ic"))

    def work(row, first: int, last: int):
        i, c, out = np.asarray(row["i"]), np.asarray(row["c"]), []
        for rep in range(first, last):
            w = np.bincount(next(picks(f"{seed}|all", rep, rep + 1, row["of"]))[1][0], minlength=row["of"])[i]
            out.append(np.nansum(c * w) / w.sum() if w.sum() else np.nan)
        return [np.array(out)]

    means = by_replicate(packed, [method, "of"], b, work, "__m double")
    return means.groupBy("rep").agg(F.max("__m").alias("__x")).agg(F.avg("__x").alias("null_max"))


def floor_se(ye: DataFrame, dataset: str, se: str = "se", zero_only: bool = False, over: tuple[str, ...] = ()) -> DataFrame:
    """SE not below the dataset's median positive SE, else the overall one (of each ``over``). I13 (``zero_only``): only SEs of zero are raised."""
    positive = F.when(F.col(se) > 1e-12, F.col(se))
    own = F.percentile(positive, F.lit(0.5)).over(Window.partitionBy(*over, dataset))
    every = ye.groupBy(*over).agg(F.percentile(positive, F.lit(0.5)).alias("__every"))
    d = ye.withColumn("__own", own)
    d = d.join(F.broadcast(every), list(over)) if over else d.crossJoin(F.broadcast(every))  # one row for each of ``over``
    low = F.coalesce("__own", "__every")
    new = F.when(F.col(se) <= 1e-12, low).otherwise(F.col(se)) if zero_only else F.greatest(F.col(se), low)
    return d.withColumns({"se_zero": F.col(se) <= 1e-12, se: F.coalesce(new, F.col(se))}).drop("__own", "__every")


def dersimonian_laird(ye: DataFrame, by: list[str], d: str = "d", se: str = "se", z: float = 1.959963984540054) -> DataFrame:
    """Random-effects pooling: estimate, SE, interval, tau2, Q, I2, k; one study gives its own estimate."""
    w = 1 / (F.col(se) * F.col(se))
    x = ye.filter(F.col(d).isNotNull() & (F.col(se) > 0)).withColumn("__w", w)
    part = Window.partitionBy(*by)
    mu = F.sum(F.col("__w") * F.col(d)).over(part) / F.sum("__w").over(part)
    x = x.withColumn("__mu", mu)
    s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("__w")).alias("sww"),
                           F.sum(F.col("__w") * (F.col(d) - F.col("__mu")) * (F.col(d) - F.col("__mu"))).alias("q"))
    c = F.col("sw") - F.try_divide(F.col("sww"), F.col("sw"))
    tau2 = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), c), F.lit(0.0)))).otherwise(0.0)
    s = s.withColumn("tau2", tau2).select(*by, "k", "q", "tau2")
    on = [F.col(f"x.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    j = x.alias("x").join(s.alias("s"), on).select("x.*", F.col("s.tau2").alias("tau2"), F.col("s.q").alias("q"))
    ws = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    out = j.withColumn("__ws", ws).groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), (F.sum(F.col("__ws") * F.col(d)) / F.sum("__ws")).alias("est"), F.sqrt(1 / F.sum("__ws")).alias("pooled_se"),
        F.first("tau2").alias("tau2"), F.first("q").alias("q"), (F.max("__ws") / F.sum("__ws")).alias("largest_share"))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0)
    return out.withColumns({"lo": F.col("est") - z * F.col("pooled_se"), "hi": F.col("est") + z * F.col("pooled_se"), "i2": i2})


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection on Simpson's rule; for the few degrees of freedom of a report."""
    from math import exp, lgamma, pi, sqrt

    c = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)

    def cdf(x: float) -> float:
        n = 2000
        h = x / n
        f = lambda u: c * (1 + u * u / df) ** (-(df + 1) / 2)
        return 0.5 + h / 3 * (f(0) + f(x) + 4 * sum(f((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2)))

    lo, hi = 0.0, 2000.0 if df < 3 else 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def hartung_knapp(ye: DataFrame, by: list[str], most_k: int = 60, d: str = "d", se: str = "se") -> DataFrame:
    """The random-effects estimate with the Hartung-Knapp SE and a t interval; null for one study."""
    pooled = dersimonian_laird(ye, by, d, se)
    spark = ye.sparkSession
    ts = spark.createDataFrame([(k, t_quantile(0.975, k - 1)) for k in range(2, most_k + 1)], "k long, t double")
    x = ye.filter(F.col(d).isNotNull() & (F.col(se) > 0)).alias("x")
    p = pooled.alias("p")
    on = [F.col(f"x.{b}").eqNullSafe(F.col(f"p.{b}")) for b in by]
    j = x.join(p, on).select(*(F.col(f"p.{b}").alias(b) for b in by), F.col(f"x.{d}").alias("d"), (1 / (F.col(f"x.{se}") * F.col(f"x.{se}") + F.col("p.tau2"))).alias("ws"), "p.est", "p.k")
    s = j.groupBy(*by).agg(F.first("est").alias("est"), F.first("k").alias("k"), F.sqrt(F.try_divide(F.sum(F.col("ws") * (F.col("d") - F.col("est")) * (F.col("d") - F.col("est"))), (F.first("k") - 1) * F.sum("ws"))).alias("hk_se"))
    return s.join(F.broadcast(ts), "k", "left").withColumns({"lo": F.col("est") - F.col("t") * F.col("hk_se"), "hi": F.col("est") + F.col("t") * F.col("hk_se")}).drop("t")


def resolution(n: Column, c: float = 3.0) -> Column:
    """I16: threshold c / sqrt(N)."""
    return F.try_divide(F.lit(c), F.sqrt(n.cast("double")))


def verdict(est: Column, lo: Column, hi: Column, threshold: Column) -> Column:
    """Resolved if the interval excludes zero and the estimate reaches the threshold; detectable if only the former; else tied."""
    excludes = (lo > 0) | (hi < 0)
    size = F.when(F.abs(est) >= threshold, F.lit("resolved")).otherwise(F.lit("detectable"))
    return F.when(lo.isNull() | hi.isNull(), "undefined").when(excludes, F.concat(size, F.when(est > 0, " gain").otherwise(" loss"))).otherwise("tied")


def holm(df: DataFrame, by: list[str], p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Level of each test, adjusted p and rejection, stopping at the first test that stays."""
    w = Window.partitionBy(*by)
    order = w.orderBy(p, tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"__i": F.row_number().over(order), "__m": F.count(F.lit(1)).over(w)})
    d = d.withColumn("level", alpha / (F.col("__m") - F.col("__i") + 1))
    d = d.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(so_far)))
    return d.withColumn("rejected", F.min((F.col(p) <= F.col("level")).cast("int")).over(so_far) == 1).drop("__i", "__m")


def minimum_detectable(lo: Column, hi: Column, power: float = 0.8, level: float = 0.95) -> Column:
    """Smallest effect one would see with this power, from the width of an interval."""
    n = NormalDist()
    za, zb = n.inv_cdf(0.5 + level / 2), n.inv_cdf(power)
    return (hi - lo) / (2 * za) * (za + zb)


def size_ratio(n: str) -> Column:
    """Loss of resolution by unequal group sizes: sqrt(N * sum(1 / n)) / E, as an aggregate."""
    return F.sqrt(F.sum(n) * F.sum(1.0 / F.col(n))) / F.count(F.lit(1))


def sign_test(positive: Column, n: Column) -> Column:
    """One-sided binomial tail P(X >= positive) for n fair signs, in logs: each term follows from the one before, with two logs."""
    n, k = n.cast("double"), positive.cast("int")
    half = F.log(F.lit(2.0))
    start = F.struct(F.lit(0.0).alias("s"), (-n * half).alias("t"))  # the term of 0
    step = lambda a, i: once(a["t"] + F.log(n - i + 1) - F.log(i.cast("double")), lambda t: F.struct((a["s"] + F.when(i >= k, F.exp(t)).otherwise(0.0)).alias("s"), t.alias("t")))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1.0)).cast("int")), start, step)["s"]
    return F.when(n == 0, F.lit(1.0)).otherwise(tail + F.when(k <= 0, F.exp(-n * half)).otherwise(0.0))


def all_hold(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """A decision that must hold in every setting."""
    return df.groupBy(*by).agg(F.bool_and(condition).alias("holds"), F.count(F.lit(1)).alias("settings"))
