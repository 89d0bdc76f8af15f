"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, StructField, StructType

from harrow.operators.joins import numbered
from harrow.operators.staging import staged
from harrow.operators.windows import totals_before


def cell_means(plots: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and number of plots of each cell."""
    return plots.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_plots"))


def stage1(centred: DataFrame, entity: str, value: str) -> DataFrame:
    """Entity means of group-centred values."""
    return centred.groupBy(entity).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def scorable(cells: DataFrame, group: list[str], entity: str, least: int) -> DataFrame:
    """D3: groups with at least ``least`` distinct entities."""
    return cells.groupBy(*group).agg(F.countDistinct(entity).alias("n_entities")).filter(F.col("n_entities") >= least)


def first_period(cells: DataFrame, entity: str, period: str) -> DataFrame:
    """The first period of each entity."""
    return cells.groupBy(entity).agg(F.min(period).alias("first_period"))


def qualifying_periods(cells: DataFrame, group: str, entity: str, period: str, rules: DataFrame) -> DataFrame:
    """For each rule (rule, min_n, min_groups, min_prior, new_share): the periods, their counts and whether they qualify.

    A period is big if ``min_groups`` groups have ``min_n`` entities; it qualifies if it is big, ``min_prior`` earlier
    ones are, and at least ``new_share`` of its entities are new.
    """
    sizes = cells.groupBy(period, group).agg(F.countDistinct(entity).alias("n"))
    rules = F.broadcast(rules)  # a few rows
    per = sizes.crossJoin(rules).groupBy("rule", period).agg(F.count_if(F.col("n") >= F.col("min_n")).alias("groups"), F.first("min_groups").alias("min_groups"),
                                                             F.first("min_prior").alias("min_prior"), F.first("new_share").alias("need"))
    new = cells.select(period, entity).distinct().join(first_period(cells, entity, period), entity).groupBy(period).agg(
        F.avg((F.col("first_period") == F.col(period)).cast("double")).alias("share_new"))
    big = (F.col("groups") >= F.col("min_groups")).cast("int")
    before = Window.partitionBy("rule").orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    d = per.join(new, period).withColumn("prior", F.coalesce(F.sum(big).over(before), F.lit(0)))
    return d.withColumn("qualifies", (big == 1) & (F.col("prior") >= F.col("min_prior")) & (F.col("share_new") >= F.col("need"))).drop("min_groups", "min_prior", "need")


def other_trait(records: DataFrame, trait: str, value: str, wanted: str, allowed: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Cell means of another trait; one that is not on the list is refused."""
    if wanted not in allowed:
        raise ValueError(f"trait {wanted} is not allowed")
    return cell_means(records.filter(F.col(trait) == wanted), keys, value)


def old_entity_targets(cells: DataFrame, period_value: int, group: str, entity: str, period: str, least: int, least_groups: int) -> DataFrame:
    """Old entities' cells of a period in groups with ``least`` of them; empty below ``least_groups`` groups."""
    old = cells.join(first_period(cells, entity, period), entity).filter((F.col(period) == period_value) & (F.col("first_period") < period_value))
    groups = scorable(old, [group], entity, least)
    enough = groups.agg((F.count(F.lit(1)) >= least_groups).alias("enough"))
    return old.join(groups, group, "left_semi").crossJoin(F.broadcast(enough)).filter("enough").drop("enough", "first_period")


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """Weighted mean of defined values."""
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(value), F.count(value).alias("n_defined"))


def novelty(part: DataFrame, reference: DataFrame, entity: str) -> DataFrame:
    """Share of a part's distinct entities that the reference does not have."""
    seen = reference.select(F.col(entity)).distinct().withColumn("__seen", F.lit(True))
    return part.select(entity).distinct().join(seen, entity, "left").agg(F.avg(F.col("__seen").isNull().cast("double")).alias("novelty"))


def describe(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sd and exact quantiles.

    A quantile lies between two places in its group's order: rows are dealt by ranges of (group, value), and a row's place is
    its place in its range and the rows of the group in ranges before. No group is held or sorted as a whole.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.select(*by, value), "described-rows")  # read twice: once for the ranges' borders
    d = staged(rows.repartitionByRange(spread, *by, value).withColumn("__b", F.spark_partition_id()), "described")
    stats = d.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    known = d.filter(F.col(value).isNotNull())
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = known.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    ranges = ranges.withColumns({"__before": F.coalesce(F.sum("__c").over(before), F.lit(0)), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    at = [(F.col("__n") - 1) * F.lit(s) for s in shares]
    placed = known.withColumn("__p", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(value)) - 1)
    placed = placed.alias("d").join(ranges.alias("r"), [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "__b")]).select(
        *(F.col(f"d.{c}").alias(c) for c in by), F.col(f"d.{value}").alias("__v"), (F.col("__p") + F.col("__before")).alias("__p"), "__n")
    ends = [(f(q).cast("long"), f"__{i}{e}") for i, q in enumerate(at) for e, f in (("lo", F.floor), ("hi", F.ceil))]
    wanted = placed.groupBy(*by, "__n").agg(*(F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(name) for p, name in ends))
    quantiles = wanted.select(*by, *((F.col(f"__{i}lo") + (F.col(f"__{i}hi") - F.col(f"__{i}lo")) * (q - F.floor(q))).alias(f"q{int(100 * s)}") for i, (q, s) in enumerate(zip(at, shares))))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    return stats.alias("s").join(quantiles.alias("q"), same, "left").select("s.*", *(f"q.q{int(100 * s)}" for s in shares))


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with a column for each listed value."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def at_extreme(df: DataFrame, group: str, value: str, wanted: str, tie: str, largest: bool = True) -> DataFrame:
    """``wanted`` of the row with the extreme value; the smallest ``tie`` on ties."""
    v = F.col(value) if not largest else -F.col(value)
    return df.groupBy(group).agg(F.min(F.struct(v.alias("v"), F.col(tie).alias("t"), F.col(wanted).alias("w")))["w"].alias(wanted))


def between_share(df: DataFrame, group: str, subgroup: str, value: str) -> DataFrame:
    """Share of a group's variance that lies between subgroup means."""
    mean = F.avg(value).over(Window.partitionBy(group, subgroup))
    return df.withColumn("__m", mean).groupBy(group).agg(F.try_divide(F.var_pop("__m"), F.var_pop(value)).alias("between_share"))


def pooled_ranges(df: DataFrame, ranges: DataFrame, on: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates over overlapping ranges: ``ranges`` (range, key) says which keys belong to each."""
    return df.join(F.broadcast(ranges), on).groupBy("range").agg(*aggregates)


def leave_one_out(df: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates without each key in turn. Keys are few: datasets, traits, periods."""
    out = df.select(F.col(key).alias("left_out")).distinct()
    return df.join(F.broadcast(out), F.col(key) != F.col("left_out")).groupBy("left_out").agg(*aggregates)


def others_mean(value: str, *group: str) -> Column:
    """Mean of the group's other rows; null if there are none."""
    w = Window.partitionBy(*group)
    return F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1)


def excluding_mean(z: DataFrame, cells: DataFrame, components: DataFrame, group: str, entity: str, period: str, value: str) -> DataFrame:
    """For each cell the mean of the entity's values in the period's other groups, own component left out; 0 if none.

    Sums by entity and by entity and component are subtracted, so no pairs of groups are made.
    """
    zc = z.join(components, group, "left").withColumn("component", F.coalesce("component", F.col(group)))
    every = zc.groupBy(period, entity).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    own = zc.groupBy(period, entity, "component").agg(F.sum(value).alias("os"), F.count(value).alias("on_"))
    c = cells.select(group, entity, period).join(components, group, "left").withColumn("component", F.coalesce("component", F.col(group)))
    j = c.join(every, [period, entity], "left").join(own, [period, entity, "component"], "left")
    rest = F.coalesce("n", F.lit(0)) - F.coalesce("on_", F.lit(0))
    mean = F.when(rest > 0, F.try_divide(F.coalesce("s", F.lit(0.0)) - F.coalesce("os", F.lit(0.0)), rest)).otherwise(0.0)
    return j.select(group, entity, period, mean.alias("others"))


def entity_mean_or_zero(cells: DataFrame, z: DataFrame, on: list[str], value: str) -> DataFrame:
    """Mean over all groups, 0 for entities without values."""
    return cells.join(z.groupBy(*on).agg(F.avg(value).alias("all_mean")), on, "left").withColumn("all_mean", F.coalesce("all_mean", F.lit(0.0)))


def pair_correlations(cells: DataFrame, group: str, entity: str, value: str, extra: list[str], least: int) -> DataFrame:
    """Correlation of each pair of groups over shared entities; ``extra`` group attributes come as a_x and b_x.

    Most pairs share too few entities, and are counted first, as numbers: an entity's groups are one array, each group takes
    the part after itself to its own partition, and pairs are counted there. Only pairs with ``least`` meet their values.
    """
    cells = staged(cells.select(group, entity, value, *extra), "pair-records")
    c = staged(cells.join(numbered(cells, group).withColumnRenamed("i", "__g"), group), "pair-cells")
    lists = c.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.sort_array(F.collect_list(F.col("__g").cast("int"))).alias("__all"))
    ahead = lists.select("__all", F.posexplode("__all").alias("__at", "a")).select("a", F.slice("__all", F.col("__at") + 2, F.size("__all")).alias("__b"))
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-c.count() // 100_000))
    pairs = ahead.filter(F.size("__b") > 0).repartition(parts, "a").select("a", F.explode("__b").alias("b")).filter("a <> b")
    found = staged(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("a", "b"), "pairs")
    x = c.select(F.col("__g").cast("int").alias("a"), F.col(group).alias("__a"), entity, F.col(value).alias("x"), *(F.col(e).alias(f"a_{e}") for e in extra))
    y = c.select(F.col("__g").cast("int").alias("b"), F.col(group).alias("__b"), entity, F.col(value).alias("y"), *(F.col(e).alias(f"b_{e}") for e in extra))
    j = found.join(x, "a").join(y, ["b", entity]).drop("a", "b").withColumnsRenamed({"__a": "a", "__b": "b"})
    by = ["a", "b", *(f"{s}_{e}" for e in extra for s in "ab")]
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("shared"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r")).filter(F.col("shared") >= least)


def seen_shares(now: DataFrame, before: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """Share of rows whose parents (columns ``parts``) are all, or any, among those of earlier rows."""
    known = before.select(F.explode(F.array(*parts)).alias("__p")).distinct()
    j = now
    flags = []
    for i, p in enumerate(parts):
        j = j.join(known.withColumnRenamed("__p", f"__k{i}"), F.col(p) == F.col(f"__k{i}"), "left")
        flags.append(F.col(f"__k{i}").isNotNull())
    every, any_ = flags[0], flags[0]
    for f in flags[1:]:
        every, any_ = every & f, any_ | f
    return j.groupBy(by).agg(F.avg(every.cast("double")).alias("all_seen"), F.avg(any_.cast("double")).alias("any_seen"))


def calendar(df: DataFrame, group: str, day: str) -> DataFrame:
    """First, median and last day of each group."""
    d = F.unix_date(day)
    return df.groupBy(group).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.date_from_unix_date(F.floor(F.percentile(d, F.lit(0.5))).cast("int")).alias("median_day"))


def next_period_set(cells: DataFrame, group: str, location: str, entity: str, period: str, least: int) -> DataFrame:
    """Groups of the next period that share at least ``least`` entities with this one at the same location."""
    nxt = cells.select(location, entity, (F.col(period) - 1).alias(period), F.col(group).alias("next_group"))
    return cells.select(group, location, entity, period).join(nxt, [location, entity, period]).groupBy(group, "next_group").agg(
        F.countDistinct(entity).alias("shared")).filter(F.col("shared") >= least)


def gram_sums(wide: DataFrame, by: list[str], columns: list[str], target: str) -> DataFrame:
    """Normal-equation sums by group for a few columns: n, sums, cross-products with each other and the target."""
    names = [*columns, target]
    sums = [F.sum(c).alias(f"s_{c}") for c in names]
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)


def without_group(sums: DataFrame, by: str) -> DataFrame:
    """Total minus each group's sums; the total is one row, broadcast to the groups."""
    names = [c for c in sums.columns if c != by]
    total = sums.agg(*(F.sum(c).alias(f"__all_{c}") for c in names))
    return sums.crossJoin(F.broadcast(total)).select(by, *((F.col(f"__all_{c}") - F.col(c)).alias(c) for c in names))


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round``: decimals of the shortest text of a number, halves away from 0."""
    y = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(y + 0.5) / 10.0**digits, x)
    near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
    values, at = np.unique(x[near], return_inverse=True)  # few: those near a half
    unit = Decimal(1).scaleb(-digits)
    out[near] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[at] if len(near) else out[near]
    return out + 0.0


def _steps(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between ascending numbers in 7 bits a byte, low bits first, 128 added but for the last: (bytes, where each step ends)."""
    step = np.diff(flat.view(np.uint64), prepend=flat[:1].view(np.uint64))
    step[starts] = 0
    n = np.ones(len(step), np.int64)
    for k in range(1, 10):
        n += step >= np.uint64(1 << 7 * k)
    ends = np.cumsum(n)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(n.max()):
        sel = np.flatnonzero(n > k)
        out[ends[sel] - n[sel] + k] = ((step[sel] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(n[sel] - 1 > k, 128, 0).astype(np.uint8)
    return out, ends


def _lists(first: np.ndarray, tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_steps`` wrote, after the first number of each list: (numbers of all lists, lengths)."""
    raw = np.frombuffer(b"".join(tails), np.uint8)
    last = np.flatnonzero(raw < 128)
    length = np.diff(np.searchsorted(last, np.cumsum([0, *map(len, tails)]))) + 1
    at = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    step = (raw[at] & 127).astype(np.uint64)
    more, k = np.flatnonzero(raw[at] >= 128), 1
    while len(more):
        byte = raw[at[more] + k]
        step[more] |= (byte & 127).astype(np.uint64) << np.uint64(7 * k)
        more, k = more[byte >= 128], k + 1
    x, start = np.empty(length.sum(), np.uint64), np.cumsum(length) - length
    is_first = np.zeros(len(x), bool)
    is_first[start] = True
    x[start], x[~is_first] = first.view(np.uint64), step
    total = np.cumsum(x)
    return (total - np.repeat(total[start] - x[start], length)).view(np.int64), length


def _weights(first: np.ndarray, own: np.ndarray, n: np.ndarray, tails: list[bytes], chunk: int):
    """Yields (i, j, weight) of the pairs of each list's first ``own`` entities with what follows; ``chunk`` pairs at a time, those of one i together."""
    x, length = _lists(first, tails)
    row = np.repeat(np.arange(len(first)), own)
    p = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    at = (np.cumsum(length) - length)[row] + p
    order = np.argsort(x[at], kind="stable")
    at, many, size = at[order], (length[row] - p)[order], n[row][order]
    i = x[at]
    upto, cuts = np.cumsum(many), np.flatnonzero(np.diff(i)) + 1
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - many[lo] + chunk)))
        k = np.searchsorted(cuts, hi)
        hi = int(cuts[k]) if k < len(cuts) else len(i)
        m = many[lo:hi]
        j = x[np.repeat(at[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        firsts, code = np.unique(i[lo:hi], return_inverse=True)
        least = j.min()
        span, bits = int(j.max() - least).bit_length(), int(size[lo:hi].max()).bit_length()
        if len(firsts).bit_length() + span + bits > 62:
            seconds, j = np.unique(j, return_inverse=True)
            span = len(seconds).bit_length()
        else:
            seconds, j = None, j - least
        key = ((np.repeat(code, m) << span | j) << bits) | np.repeat(size[lo:hi], m)
        key.sort()
        pair = key >> bits
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sums = np.add.reduceat(1.0 / (key & ((1 << bits) - 1)), start)
        of, found = firsts[pair[start] >> span], pair[start] & ((1 << span) - 1)
        found = found + least if seconds is None else seconds[found]
        yield of, found, np.where(of == found, np.diff(np.append(start, len(key))), 0) - sums
        lo = hi


def incidence_weights(cells: DataFrame, group: str, entity: str, digits: int | None = None, most: int = 8_000_000, chunk: int = 2_000_000) -> DataFrame:
    """Off-diagonal weights -sum over groups of 1 / n_g between entities that share groups, and diagonals n_e - sum 1 / n_g, rounded to ``digits``.

    Entities are cut into ranges of some ``most`` pairs. A group's entities, ascending, go once to each range that holds some
    of them, from the first of these on and as steps of a byte or two, and a range's pairs are summed where they meet: what
    is shuffled grows with groups x ranges met, not with pairs.
    """
    if not isinstance(cells.schema[entity].dataType, IntegralType):
        ids = staged(numbered(cells.select(F.col(entity).alias("__e")), "__e"), "incidence-ids")
        c = cells.select(F.col(group).alias("__g"), F.col(entity).alias("__e")).join(ids, "__e")
        w = incidence_weights(c, "__g", "i", digits, most, chunk)
        name = lambda k: ids.select(F.col("i").alias(k), F.col("__e").alias(f"__{k}"))
        return w.join(name("i"), "i").join(name("j"), "j").select(F.col("__i").alias("i"), F.col("__j").alias("j"), "weight")
    lists = staged(cells.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_set(F.col(entity).cast("long"))).alias("__all")).filter(F.size("__all") > 0).select("__all"), "incidence")
    loads = lists.select(F.size("__all").alias("__n"), F.posexplode("__all").alias("__at", "i")).groupBy("i").agg(F.sum(F.col("__n") - F.col("__at")).alias("pairs"))
    before = totals_before(staged(loads, "incidence-loads"), [], "i", ["pairs"])
    firsts = sorted(r["i"] for r in before.groupBy(F.floor(F.col("pairs_before") / most)).agg(F.min("i").alias("i")).collect())  # a number a range
    cuts = np.array(firsts[1:], np.int64)

    def split(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat, size = b.column(0).flatten().to_numpy(), pc.list_value_length(b.column(0)).to_numpy().astype(np.int64)
            stop = np.cumsum(size)
            of = np.searchsorted(cuts, flat, side="right")
            new = np.append(True, of[1:] != of[:-1])
            new[stop - size] = True
            run = np.flatnonzero(new)
            row = np.searchsorted(stop, run, side="right")
            data, ends = _steps(flat, stop - size)
            data, s, e = data.tobytes(), ends[run], ends[stop[row] - 1]
            own, bytes_ = np.diff(np.append(run, len(flat))), np.cumsum(e - s)
            lo = 0
            while lo < len(run):
                hi = max(lo + 1, min(lo + 50_000, int(np.searchsorted(bytes_, bytes_[lo] + 16_000_000))))
                yield pa.RecordBatch.from_arrays([pa.array(of[run[lo:hi]].astype(np.int64)), pa.array(flat[run[lo:hi]]), pa.array(own[lo:hi]), pa.array(size[row[lo:hi]]),
                                                  pa.array([data[x:y] for x, y in zip(s[lo:hi], e[lo:hi])], pa.binary())], names=["__r", "__first", "__own", "__n", "__tail"])
                lo = hi

    kind = cells.schema[entity].dataType
    schema = StructType([StructField("i", kind, False), StructField("j", kind, False), StructField("weight", DoubleType(), False)])
    arrow = {1: pa.int8(), 2: pa.int16(), 4: pa.int32(), 8: pa.int64()}[{"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        for i, j, w in _weights(*(t[c].to_numpy() for c in ("__first", "__own", "__n")), t["__tail"].to_pylist(), chunk):
            w = w if digits is None else _half_up(w, digits)
            for lo in range(0, len(i), 262_144):
                part = slice(lo, lo + 262_144)
                yield pa.RecordBatch.from_arrays([pa.array(i[part]).cast(arrow), pa.array(j[part]).cast(arrow), pa.array(w[part])], names=["i", "j", "weight"])

    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(firsts), 20_000))
    sent = lists.mapInArrow(split, "__r long, __first long, __own long, __n long, __tail binary")
    return sent.repartition(parts, "__r").groupBy("__r").applyInArrow(count, schema)


def detectable(df: DataFrame, group: str, period: str, value: str) -> DataFrame:
    """Spread within and between periods of group means, and 2.8 standard errors as the effect one could see."""
    per = df.groupBy(period).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    return per.agg(F.avg("s").alias("sd_within"), F.stddev_samp("m").alias("sd_between"), F.count(F.lit(1)).alias("periods"),
                   (2.8 * F.try_divide(F.stddev_samp("m"), F.sqrt(F.count(F.lit(1))))).alias("mde"))


def population_means(cells: DataFrame, by: list[str], group: str, value: str, least: int = 2) -> DataFrame:
    """Means across groups of entities that stand in at least ``least``."""
    return cells.groupBy(*by).agg(F.avg(value).alias("mean"), F.countDistinct(group).alias("n_groups")).filter(F.col("n_groups") >= least)


def append_period(cells: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """The union by name, with a flag on keys that stand twice."""
    both = cells.unionByName(extra, allowMissingColumns=True)
    return both.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def value_or(adjusted: DataFrame, raw: DataFrame, on: list[str], value: str, out: str) -> DataFrame:
    """The adjusted value, else the raw one."""
    return raw.join(adjusted.select(*on, F.col(value).alias("__adj")), on, "left").withColumn(out, F.coalesce("__adj", F.col(value))).drop("__adj")


def centred_records(cells: DataFrame, group: str, value: str, least: int = 30) -> DataFrame:
    """Group-centred records of groups with at least ``least``."""
    w = Window.partitionBy(group)
    n = cells.withColumn("__n", F.count(value).over(w)).withColumn("centred", F.col(value) - F.avg(value).over(w))
    return n.filter(F.col("__n") >= least).drop("__n")
