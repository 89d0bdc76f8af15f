"""Window operators: all within a group, none over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.staging import staged


def _w(*group: str):
    return Window.partitionBy(*group)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dealt(df: DataFrame, rows: int, *by: str, most: int = 500_000) -> DataFrame:
    """``df`` dealt by keys to tasks of some ``most`` of its ``rows``. Left to the shuffle's partitions, what a task sorts grows with the table."""
    n = -(-rows // most)
    return df if n < 2 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *by)


def center(value: Column | str, *group: str) -> Column:
    """Value minus its group's mean."""
    return _c(value) - F.avg(_c(value)).over(_w(*group))


def zscore(value: Column | str, *group: str, sample: bool = True, least: int = 1, clip: float | None = None) -> Column:
    """Standardised within the group; null below ``least`` records or without spread; clipped on request."""
    v, w = _c(value), _w(*group)
    sd = (F.stddev_samp(v) if sample else F.stddev_pop(v)).over(w)
    z = F.when((F.count(v).over(w) >= least) & (sd > 0), F.try_divide(v - F.avg(v).over(w), sd))
    return z if clip is None else F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip))))


def rank_key(value: Column | str, digits: int | None) -> Column:
    """What ranks go by: the value to ``digits`` decimals. Two means that are equal in exact arithmetic may differ in their
    last bits by the order of their sums; ranked as they stand, such ties would fall out differently from run to run."""
    return _c(value) if digits is None else F.round(_c(value), digits)


def totals_before(df: DataFrame, by: list[str], order: str, columns: list[str], most: int = 500_000) -> DataFrame:
    """``df`` with ``{c}_before``: each column's total over the rows before in the group; ``order`` is unique there.

    For groups that grow with the table: rows are dealt by ranges of (group, order), some ``most`` a task, and what
    lies before is what lies before in the range and the totals of the ranges before. No group is sorted as a whole.
    What has more than 100,000 rows is marked for joins that sort, as Spark takes some compact files for small and gathers them in the driver.
    """
    n = df.count()
    d = staged(df.repartitionByRange(max(1, -(-n // most)), *by, order).withColumn("__b", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*by, "__b").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    ranges = ranges.select(*by, "__b", *(F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__t_{c}") for c in columns))
    d = d.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in columns)).join(F.broadcast(ranges), [*by, "__b"])  # a row a range
    d = d.select(*df.columns, *((F.col(f"__i_{c}") + F.col(f"__t_{c}")).alias(f"{c}_before") for c in columns))
    return d if n <= 100_000 else d.hint("merge")


def places(df: DataFrame, by: list[str], key: str, most: int = 500_000) -> DataFrame:
    """(by, key, n, n_before): how many rows hold each key and how many a smaller one."""
    return totals_before(df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n")), by, key, ["n"], most)


def midrank(value: Column | str, *group: str, digits: int | None = 9) -> Column:
    """Average rank by ``rank_key``; ties share the mean of their places. Nulls have no rank."""
    v = rank_key(value, digits)
    w = _w(*group).orderBy(v.asc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # in the order of the ranks: no second sort
    return F.when(v.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def top_rank(score: Column | str, tie: str, *group: str, digits: int | None = 9) -> Column:
    """Place by descending score (``rank_key``), ties by ``tie``, null scores last."""
    return F.row_number().over(_w(*group).orderBy(rank_key(score, digits).desc_nulls_last(), F.col(tie)))


def running(value: Column | str, order: str, *group: str, exclusive: bool = False) -> Column:
    """Running sum, or the sum of what comes before."""
    s = F.sum(_c(value)).over(_w(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    return F.coalesce(s, F.lit(0.0)) if exclusive else s


def kth(series: DataFrame, wanted: DataFrame, k: str, value: str, order: str, group: str) -> DataFrame:
    """The k-th value of a running series for each row of ``wanted`` (group, k); null where there are fewer."""
    numbered = series.withColumn("__k", F.row_number().over(_w(group).orderBy(order))).select(F.col(group), F.col("__k").alias(k), value)
    return wanted.join(numbered, [group, k], "left")


def fill_gaps(df: DataFrame, value: str, order: str, group: str, most: int = 3, out: str = "filled") -> DataFrame:
    """Linear interpolation over rows, inside the series only, of the first ``most`` rows of each gap."""
    back = _w(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("__n", F.row_number().over(_w(group).orderBy(order)))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(value).alias("v")))
    d = d.withColumn("__a", F.last(known, True).over(back)).withColumn("__b", F.first(known, True).over(ahead))
    share = (F.col("__n") - F.col("__a.n")) / (F.col("__b.n") - F.col("__a.n"))
    guess = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share
    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__n") - F.col("__a.n") <= most)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(inside, guess)).drop("__n", "__a", "__b")


def tertile(value: Column | str, tie: str, *group: str, parts: int = 3) -> Column:
    """Quantile buckets of unique ranks: bucket j holds ranks r with (r - 1) / (n - 1) in (j / parts, (j + 1) / parts]."""
    w = _w(*group)
    r = F.row_number().over(w.orderBy(_c(value), F.col(tie)))
    n = F.count(F.lit(1)).over(w)
    return F.when(r == 1, 1).otherwise(F.ceil(parts * (r - 1) / (n - 1))).cast("int")


def count_earlier(flag: Column | str, order: str, *group: str) -> Column:
    """How many earlier rows carry the flag."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(_c(flag).cast("int")).over(w), F.lit(0)).cast("long")


def lags(df: DataFrame, value: str, order: str, group: str, upto: int = 2) -> DataFrame:
    """The values ``k`` periods before, by period number and not by row."""
    out = df
    for k in range(1, upto + 1):
        before = df.select(F.col(group), (F.col(order) + k).alias(order), F.col(value).alias(f"{value}_lag{k}"))
        out = out.join(before, [group, order], "left")
    return out


def shuffled(df: DataFrame, value: str, tie: str, group: str, seed: str) -> DataFrame:
    """The group's values dealt anew among its rows, by hash order."""
    own = df.withColumn("__rn", F.row_number().over(_w(group).orderBy(tie)))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col(tie).cast("string")))
    dealt = df.select(group, value, order.alias("__o"), tie).withColumn("__rn", F.row_number().over(_w(group).orderBy("__o", tie)))
    return own.join(dealt.select(group, "__rn", F.col(value).alias(f"{value}_shuffled")), [group, "__rn"]).drop("__rn")


def null_days(df: DataFrame, value: str, day: str, group: str) -> DataFrame:
    """First day without value, days without by month, and how many days a null-propagating running sum reaches."""
    missing = F.col(value).isNull()
    first = F.min(F.when(missing, F.col(day))).over(_w(group))
    d = df.withColumn("__first", first)
    return d.groupBy(group, F.month(day).alias("month")).agg(
        F.min("__first").alias("first_missing"), F.count_if(missing).alias("n_missing"),
        F.count_if(F.col("__first").isNull() | (F.col(day) < F.col("__first"))).alias("n_cumulative"))
