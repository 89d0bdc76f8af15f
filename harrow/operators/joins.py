"""Join operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from harrow.operators.staging import staged


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """(key, i): distinct keys numbered from 0 in their order: by ranges, then inside each; no task sees all of them."""
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = staged(keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(ranges, key).withColumn("__b", F.spark_partition_id()), "numbered")
    before = k.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return k.join(F.broadcast(before.drop("n")), "__b").select(key, (F.col("__before") + place).alias("i"))  # a row a range


def keep(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys.select(*on), on, "left_semi")


def drop(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(*on), on, "left_anti")


def coverage(wanted: DataFrame, given: DataFrame, on: list[str], value: str, by: list[str]) -> DataFrame:
    """C4: share of the wanted rows that have a value, by group of rows."""
    return wanted.join(given.select(*on, value), on, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("wanted"), F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))


def release_diff(old: DataFrame, new: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison of two releases of a table: rows on one side only, equal values, largest difference."""
    o = old.select(*on, F.col(value).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*on, F.col(value).alias("__new"), F.lit(True).alias("__in_new"))
    j = o.join(n, on, "full_outer")
    both = F.col("__in_old").isNotNull() & F.col("__in_new").isNotNull()
    return j.agg(
        F.count_if(F.col("__in_new").isNull()).alias("only_old"), F.count_if(F.col("__in_old").isNull()).alias("only_new"), F.count_if(both).alias("in_both"),
        F.count_if(both & F.col("__old").eqNullSafe(F.col("__new"))).alias("equal"), F.max(F.abs(F.col("__old") - F.col("__new"))).alias("max_abs_diff"))


def history(targets: DataFrame, cells: DataFrame, target: str, period: str) -> DataFrame:
    """For each target period the rows of earlier periods. Targets are a short list and are sent to all tasks."""
    return cells.join(F.broadcast(targets), F.col(period) < F.col(target))


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str) -> DataFrame:
    """As-of: the value of the latest ``when`` before ``at`` for the same key; null if none.

    Both sides go through one shuffle on the key and a window that carries the last value forward: linear in the rows,
    where a join on the inequality would meet all pairs of a key.
    """
    l_ = left.select(*left.columns, F.lit(0).alias("__side"), F.col(at).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[when].dataType).alias("__w"))
    r_ = right.select(key, F.lit(1).alias("__side"), F.col(when).alias("__t"), F.col(value).alias("__v"), F.col(when).alias("__w"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("__side") == 1, F.struct(F.col("__w").alias("w"), F.col("__v").alias("v"))), True).over(w)
    return both.withColumn("__got", seen).filter("__side = 0").select(*left.columns, F.col("__got.w").alias(f"{when}_before"), F.col("__got.v").alias(f"{value}_before"))


def nearest(targets: DataFrame, choices: DataFrame, target: str, period: str) -> DataFrame:
    """The period nearest to each target, the lower one on ties. Both are short lists of periods."""
    j = targets.select(target).distinct().join(F.broadcast(choices.select(period).distinct()), F.col(target) != F.col(period))
    return j.groupBy(target).agg(F.min(F.struct(F.abs(F.col(target) - F.col(period)).alias("d"), F.col(period).alias("p")))["p"].alias("nearest"))


def window_sums(daily: DataFrame, windows: DataFrame, group: str, order: str, cum: str, value: str) -> DataFrame:
    """Count, sum and mean of a value over windows on a running series: days with cum > lo and exclusive prefix < hi.

    ``windows``: (group, window, lo, hi), a few for each group, so the join's output follows the days times windows.
    """
    prev = F.lag(cum, 1, 0.0).over(Window.partitionBy(group).orderBy(order))
    d = daily.withColumn("__prev", prev)
    j = d.join(windows, group).filter((F.col(cum) > F.col("lo")) & (F.col("__prev") < F.col("hi")))
    return j.groupBy(group, "window").agg(F.count(F.lit(1)).alias("days"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def fallback(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """The first value found in a list of (table, keys, value column), most specific first; tables without keys are one row."""
    found = []
    for i, (table, on, value) in enumerate(levels):
        name = f"__level{i}"
        t = table.select(*on, F.col(value).alias(name))
        df = df.join(t, on, "left") if on else df.crossJoin(F.broadcast(t))  # one row
        found.append(F.col(name))
    return df.withColumn(out, F.coalesce(*found)).drop(*(f"__level{i}" for i in range(len(levels))))


def _joint_codes(columns: list[pa.Array]) -> np.ndarray:
    """Rows of some columns as numbers from 0; equal rows have equal numbers."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if pa.types.is_floating(c.type):
            c = pc.add(c, pa.scalar(0, c.type))  # -0.0 is 0.0, as in a join
        c = c.dictionary_encode()
        codes = np.unique(codes * max(1, len(c.dictionary)) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes


def _counts_in_common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], nx: int, ny: int, tile: int = 512, width: int = 4_096, dense: float = 1e-3):
    """Yields (first row, counts of (rows, ny)): how many codes each row of x shares with each row of y; a side is (rows, codes), no pair twice.

    Codes of many rows on both sides are counted by a product of matrices, up to three rows of y in one number (sums below
    2**24 are exact in single precision); the other codes by their few pairs of rows.
    """
    sizes = max(int(x[1].max(initial=-1)), int(y[1].max(initial=-1))) + 1
    of_x, of_y = (np.bincount(s[1], minlength=sizes) for s in (x, y))
    many = of_x * of_y > dense * nx * ny
    few = (of_x > 0) & (of_y > 0) & ~many
    place = np.cumsum(many) - 1
    sides = []
    for (row, code), of in ((x, of_x), (y, of_y)):
        m, f = many[code], few[code]
        order = np.argsort(row[m], kind="stable") if of is of_x else slice(None)
        sides.append((row[m][order], place[code[m]][order], row[f], code[f]))
    (xr, xp, xfr, xfc), (yr, yp, yfr, yfc) = sides
    bits = max(1, int(min(np.bincount(xr, minlength=1).max(initial=0), np.bincount(yr, minlength=1).max(initial=0), width)).bit_length())
    packs = max(1, min(3, 24 // bits))
    columns = -(-ny // packs)
    order = np.argsort(yfc, kind="stable")
    yfr, ends = yfr[order], np.cumsum(np.bincount(yfc, minlength=sizes))
    order = np.argsort(xfr, kind="stable")
    xfr, xfc = xfr[order], xfc[order]
    n_many = int(many.sum())
    held = -1
    for lo in range(0, nx, tile):
        hi = min(nx, lo + tile)
        counts = np.zeros((hi - lo, columns * packs), np.int32)
        s, e = np.searchsorted(xr, [lo, hi])
        for at in range(0, n_many, width):
            w = min(width, n_many - at)
            if held != at:
                packed, held = np.zeros((w, columns), np.float32), at
                for k in range(packs):
                    sel = (yp >= at) & (yp < at + w) & (yr // columns == k)
                    packed[yp[sel] - at, yr[sel] - k * columns] += np.float32(1 << bits * k)
            m = np.zeros((hi - lo, w), np.float32)
            sel = (xp[s:e] >= at) & (xp[s:e] < at + w)
            m[xr[s:e][sel] - lo, xp[s:e][sel] - at] = 1
            found = (m @ packed).astype(np.int32)
            for k in range(packs):
                counts[:, k * columns : (k + 1) * columns] += (found >> bits * k) & ((1 << bits) - 1)
        counts = counts[:, :ny]
        s, e = np.searchsorted(xfr, [lo, hi])
        while s < e:  # some million pairs at a time
            lens = of_y[xfc[s:e]]
            to = s + max(1, int(np.searchsorted(np.cumsum(lens), 4_000_000)))
            to, lens = min(to, e), lens[: to - s]
            upto = np.cumsum(lens)
            at = np.repeat(ends[xfc[s:to]] - upto, lens) + np.arange(upto[-1])
            counts += np.bincount(np.repeat((xfr[s:to] - lo) * ny, lens) + yfr[at], minlength=(hi - lo) * ny).reshape(counts.shape).astype(np.int32)
            s = to
        yield lo, counts


def shared_content(rows: DataFrame, group: str, within: list[str], entity: str, value: str, least: int = 1, block: int = 4_096, digits: int | None = None) -> DataFrame:
    """Pairs of groups of the same ``within`` that share distinct (entity, value) rows: number shared and share of the smaller,
    rounded to ``digits``. Rows without entity or value are shared with none, but count in a group's size.

    Nearly all pairs of groups may share something, so pairs are not shuffled: groups, each with its content as one array,
    are dealt to blocks, and a task counts a pair of blocks and sends out its rows as it goes, some 260,000 at a time.
    """
    packed = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*within, group])).groupBy(*within, group).agg(F.collect_set(F.struct(F.col(entity).alias("e"), F.col(value).alias("v"))).alias("__c"))
    packed = packed.withColumn("n", F.size("__c").cast("long")).withColumn("__c", F.filter("__c", lambda x: x["e"].isNotNull() & x["v"].isNotNull()))
    packed = staged(packed.select(*within, group, "n", F.col("__c")["e"].alias("__e"), F.col("__c")["v"].alias("__v")), "contents")
    block = max(1, min(block, int(2_000_000 // (packed.agg(F.avg("n")).first()[0] or 1))))  # a block's content is bounded too
    blocks = staged(packed.groupBy(*within).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks")), "content-blocks")
    pairs = int(blocks.agg(F.sum(F.col("__blocks") * (F.col("__blocks") + 1.0) / 2)).first()[0] or 1)
    k, j = F.col("__k"), F.col("__other")
    dealt = packed.join(blocks, within).withColumn("__k", F.pmod(F.xxhash64(group), F.col("__blocks")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    keys = [*within, "__i", "__j"]
    dealt = dealt.select(*within, F.least(k, j).alias("__i"), F.greatest(k, j).alias("__j"), (k > j).alias("__right"), F.col(group).alias("__g"), "n", "__e", "__v")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs, 10_000))
    types = {c: rows.schema[c].dataType for c in [*within, group]}
    fields = [*((c, types[c]) for c in within), ("a", types[group]), ("b", types[group]), ("shared", LongType()), ("share", DoubleType())]
    schema = StructType([StructField(c, t, False) for c, t in fields])  # billions of rows: no looking for nulls
    scale = 2.0 * 10.0 ** (digits or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        same = t["__i"][0].as_py() == t["__j"][0].as_py()
        t = t.take(pc.sort_indices(t["__g"]))
        names, t = t["__g"].combine_chunks(), t.combine_chunks()
        lists = t["__e"].combine_chunks()
        row = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        code = _joint_codes([lists.flatten(), t["__v"].combine_chunks().flatten()])
        n, right = t["n"].to_numpy(), t["__right"].to_numpy()
        ranks = [np.arange(len(t))] * 2 if same else [np.flatnonzero(~right), np.flatnonzero(right)]
        if not len(ranks[0]) or not len(ranks[1]):
            return
        place, sides = np.zeros(len(t), np.int64), []
        for r in ranks:
            place[r] = np.arange(len(r))
            mine = slice(None) if same else right[row] == (r is ranks[1])
            sides.append((place[row[mine]], code[mine]))
        (rx, ry), ny = ranks, len(ranks[1])
        for lo, counts in _counts_in_common(*sides, len(rx), ny):
            step = max(1, 262_144 // ny)
            for at in range(0, len(counts), step):
                c = counts[at : at + step]
                found = c >= least
                if same:  # a block with itself: each pair once
                    found &= np.arange(lo + at, lo + at + len(c))[:, None] < np.arange(ny)
                per = np.count_nonzero(found, 1)
                flat = np.flatnonzero(found)
                if not len(flat):
                    continue
                i = np.repeat(np.arange(len(c)), per)
                shared, j = c.ravel()[flat].astype(np.int64), flat - i * ny
                x, y = rx[lo + at + i], ry[j]
                smaller = np.minimum(n[x], n[y])
                # half up in whole numbers, so that no tie hangs on the last bits of a quotient
                share = shared / smaller if digits is None else np.floor((scale * shared + smaller) / (2 * smaller)) / 10.0**digits
                yield pa.RecordBatch.from_arrays([*(pa.repeat(t[w][0], len(flat)) for w in within), names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))),
                                                  pa.array(shared), pa.array(share)], names=[*within, "a", "b", "shared", "share"])

    return dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)


def exclusion_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """C11: connected components of flagged pairs: (node, component), component the smallest node reachable.

    Smallest labels spread over the links, and along the labels themselves, until nothing changes. Each round is cut
    from its lineage by a written table.
    """
    links = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    cut = lambda df, k: staged(df, f"components-{k}")
    links = cut(links, 0)
    labels = cut(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), 1)
    for k in range(2, 200):
        near = links.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("root"))
        new = cut(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("root", "c")).alias("component")), k)
        if new.join(labels.withColumnRenamed("component", "before"), "node").filter("component <> before").isEmpty():
            return new
        labels = new
    return labels


def resolve_alias(names: DataFrame, known: DataFrame, name: str, key: str, alias: str) -> DataFrame:
    """Key by exact name, else by name without case, else by alternative name; with the kind of match."""
    exact = known.select(F.col(key).alias("__exact")).distinct()
    folded = known.groupBy(F.upper(key).alias("__fold")).agg(F.min(key).alias("__folded"))
    other = known.filter(F.col(alias).isNotNull()).groupBy(F.col(alias).alias("__alias")).agg(F.min(key).alias("__other"))
    j = names.join(exact, F.col(name) == F.col("__exact"), "left").join(folded, F.upper(name) == F.col("__fold"), "left").join(other, F.col(name) == F.col("__alias"), "left")
    kind = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__folded").isNotNull(), "case").when(F.col("__other").isNotNull(), "alias").otherwise("none")
    return j.withColumn("match_kind", kind).withColumn("matched", F.coalesce("__exact", "__folded", "__other")).drop("__exact", "__fold", "__folded", "__alias", "__other")


def common_cells(pred: DataFrame, key: list[str], method: str, methods: int) -> DataFrame:
    """Rows whose key every method covers."""
    full = pred.groupBy(*key).agg(F.countDistinct(method).alias("__m")).filter(F.col("__m") == methods).select(*key)
    return pred.join(full, key, "left_semi")


def grid(*frames: DataFrame) -> DataFrame:
    """C14: all combinations; every frame but the first is a short list of settings."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def concordance(one: DataFrame, two: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """Agreement of two dosage tables by entity: shared calls, agreement, calls only one side has."""
    a = one.select(entity, feature, F.col(value).alias("__a"))
    b = two.select(entity, feature, F.col(value).alias("__b"))
    j = a.join(b, [entity, feature])
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.groupBy(entity).agg(
        F.count_if(both).alias("shared"), F.avg(F.when(both, (F.col("__a") == F.col("__b")).cast("double"))).alias("agreement"),
        F.count_if(F.col("__a").isNull() & F.col("__b").isNotNull()).alias("recovered"))


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on ties."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(key, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def bind_late(panel: DataFrame, observed: DataFrame, on: list[str], value: str) -> DataFrame:
    """C17: observed values joined to predictions at the end; a panel that already carries them is refused."""
    if value in panel.columns:
        raise ValueError(f"the panel carries {value}")
    return panel.join(observed.select(*on, value), on, "left")
