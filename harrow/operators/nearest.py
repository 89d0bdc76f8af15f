"""Nearest rows by distance: a query set against all rows, in blocks.

Queries and rows are dealt by hash to blocks of bounded size; a pair of blocks is one group of a cogroup and gives each
query's k nearest of the block. Neither side is broadcast or collected, and what is shuffled after is k rows for each query
and block. Rows with null features or a null component take no part; a row is not its own neighbour; ties go by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.blocks import centred_moments, moments
from harrow.operators.kernels import _stack, known


def _closest(k: int, turn: np.ndarray | None, step: int = 256):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            q, x, own, key = _stack(queries["x"]), _stack(rows["x"]), queries["key"].to_numpy(), rows["key"].to_numpy()
            if turn is not None:
                q, x = q @ turn, x @ turn
            square = (x * x).sum(1)
            for at in range(0, len(q), step):
                a = q[at : at + step]
                near = square - 2 * (a @ x.T)
                near[own[at : at + step, None] == key[None]] = np.inf
                most = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                slack = 1e-9 * (1 + (a * a).sum(1) + square.max())
                i, j = np.nonzero((near <= (most + slack)[:, None]) & np.isfinite(near))
                exact = np.round(((a[i] - x[j]) ** 2).sum(1), 9)
                sort = np.lexsort((key[j], exact, i))
                i, j, exact = i[sort], j[sort], exact[sort]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"key": own[at + i[first]], "other": key[j[first]], "square": exact[first]}))
        return pd.concat(out) if out else pd.DataFrame({"key": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "square": np.zeros(0)})

    return run


def _in_blocks(rows: DataFrame, queries: DataFrame, key: str, x: str, work, schema: str, row_block: int, query_block: int) -> DataFrame:
    """``work`` on every pair of a block of queries and a block of rows, both as (key, x)."""

    def plain(t: DataFrame) -> DataFrame:
        return known(t, x).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: v.cast("double")).alias("x"))

    rows, queries = plain(rows), plain(queries)
    n, m = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))
    dealt = lambda t, own, a, other, b: t.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(a)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    left, right = dealt(queries, "of_queries", m, "of_rows", n), dealt(rows, "of_rows", n, "of_queries", m)
    fresh = lambda t: t.select(*(F.col(c).alias(c) for c in ("of_queries", "of_rows", "key", "x")))  # noqa: E731  both sides may come from one table
    return fresh(left).groupBy("of_queries", "of_rows").cogroup(fresh(right).groupBy("of_queries", "of_rows")).applyInPandas(work, schema)


def nearest(rows: DataFrame, queries: DataFrame, key: str, x: str, k: int, turn: np.ndarray | None = None, row_block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """(key, other, square, place): the k nearest of ``rows`` for each of ``queries`` by squared distance to 9 decimals, after ``turn`` if given. Keys are whole numbers."""
    near = _in_blocks(rows, queries, key, x, _closest(k, turn), "key long, other long, square double", row_block, query_block)
    w = Window.partitionBy("key").orderBy("square", "other")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).withColumnRenamed("key", key)


def inner_products(rows: DataFrame, queries: DataFrame, key: str, x: str, row_block: int = 2_048, query_block: int = 512) -> DataFrame:
    """(i, j, k): inner products of each of ``queries`` with all of ``rows``: the kernel's rows of a query set, block by block.

    A pair of blocks gives at most some 1 million rows at once (25 MB in a worker, and copies of them), whatever the tables' sizes; hashing
    makes blocks a few per cent larger or smaller.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "k": np.zeros(0)})
        k = _stack(a["x"]) @ _stack(b["x"]).T
        return pd.DataFrame({"i": np.repeat(a["key"].to_numpy(), len(b)), "j": np.tile(b["key"].to_numpy(), len(a)), "k": k.ravel()})

    return _in_blocks(rows, queries, key, x, run, "i long, j long, k double", row_block, query_block)


def nearest_mean(rows: DataFrame, queries: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """Mean response of the k nearest rows."""
    near = nearest(rows, queries, key, x, k)
    of = rows.select(F.col(key).cast("long").alias("other"), F.col(y).alias("__y"))
    return near.join(of, "other").groupBy(key).agg(F.avg("__y").alias("predicted"))


def mahalanobis(rows: DataFrame, queries: DataFrame, key: str, x: str, k: int, ridge: float = 1e-3) -> DataFrame:
    """F16: mean Mahalanobis distance to the k nearest rows; the covariance, features x features, is one row from Spark."""
    one = moments(known(rows, x).select(F.lit(0).alias("all"), F.transform(x, lambda v: v.cast("double")).alias("x"), F.lit(0.0).alias("y")), ["all"], "x", "y")
    got = centred_moments(one, ["all"]).first()
    if got is None:
        raise ValueError("no row with known features")
    side = int(round(len(got["c"]) ** 0.5))
    cov = np.array(got["c"]).reshape(side, side)[:-1, :-1] / max(got["n"] - 1, 1)
    cov = cov + ridge * np.diag(np.maximum(np.diag(cov), 1e-12))
    near = nearest(rows, queries, key, x, k, np.linalg.cholesky(np.linalg.inv(cov)))  # distance^2 = |root' (x - y)|^2
    return near.groupBy(key).agg(F.avg(F.sqrt("square")).alias("distance"))
