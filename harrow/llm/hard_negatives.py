"""Hard-negative mining by a secondary-sort shuffle.

For each anchor the nearest rows of its label are its positives; for each positive, the negatives are the first rows of
other labels whose score lies in a window just under the positive's. Components are scaled and floored to whole numbers,
so scores are exact integers and ties are ties.

1. Blocks: anchors and rows are dealt by hash to blocks of bounded size, and each pair of blocks is one group of a
   cogroup. The first pass gives each anchor's best rows of its own label in the block; the best of all blocks are the
   positives. The second pass knows their scores, so a block gives only the first negatives of each window: nothing
   beyond these can be among the first of the whole table. Pairs never leave a block otherwise.
2. Secondary sort: positives and negatives get keys (anchor, descending score, kind, id, row), are dealt by anchor and
   sorted by ``repartitionAndSortWithinPartitions``. One pass streams them: a positive opens a window, and each negative
   that follows is given to the open windows that it falls into, until they have enough. An anchor is never held:
   memory is the open windows, as many as an anchor has positives. At equal score positives come first, as a window
   includes its positive's score.

How it scales. The query set against all rows, in blocks: products grow as anchors x rows, shuffled rows as anchors x
row blocks. Neither anchors nor rows are broadcast or collected. A label or a vector that a third of all rows share
changes no block, as blocks are dealt by row.

Defined cases: rows with a null vec_id, null label, null vector or a null or non-finite component take no part; vectors
of different lengths are not scored with each other, empty ones score 0; rows that share a vec_id each take part for
themselves, as anchors too, and ties between them go by row; an anchor without positives gives nothing, a positive
with a negative score has an empty window; products beyond 64-bit integers raise an error; an empty table gives an empty
result; other columns are left out of the work.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import arrow_rows, partitions, read, staged

#: Products of whole numbers are exact in doubles below this.
EXACT = 2**53


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(id, label, vec, dim): components times ``scale``, floored, as bytes of doubles; rows that can't take part are left out."""

    def run(batches):
        for b in batches:
            out = []
            for i, label, v in zip(b["id"], b["label"], b["embedding"]):
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                if np.isfinite(x).all():
                    out.append((i, label, np.floor(scale * x).tobytes(), len(x)))
            yield pd.DataFrame(out, columns=["id", "label", "vec", "dim"])

    there = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "embedding").dropna()
    return there.mapInPandas(run, "id long, label string, vec binary, dim int")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, as int64; an error where one does not fit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], object).reshape(len(a), len(b))
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**62:
        raise OverflowError("inner products of these vectors do not fit into 64-bit integers")
    return exact.astype(np.int64)


def first_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row, highest first, ties to the smaller column."""
    n = scores.shape[1]
    if n > 4 * k and int(np.abs(scores).max(initial=0)) < 2**62 // n:
        key = scores * n - np.arange(n)
        some = np.argpartition(-key, k, axis=1)[:, :k]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(key, some, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _matrix(vec: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), dim)


def _by_length(anchors: pd.DataFrame, rows: pd.DataFrame, keys: list[str]):
    """Anchors and rows that share ``keys`` and so are scored; rows in order of id, then row."""
    inside = dict(list(rows.groupby(keys, sort=False)))
    for key, some in anchors.groupby(keys, sort=False):
        if key in inside:
            yield some, inside[key].sort_values(["id", "row"])


def best_of_label(count: int, step: int = 128):
    """The work on a pair of blocks in the first pass: each anchor's first ``count`` rows of its label."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for some, own in _by_length(anchors, rows, ["dim", "label"]):
            dim = int(own["dim"].iloc[0])
            a, x, row, ids = _matrix(some["vec"], dim), _matrix(own["vec"], dim), own["row"].to_numpy(), own["id"].to_numpy()
            for at in range(0, len(a), step):
                s = products(a[at : at + step], x)
                best = first_columns(s, count + 1)  # one more, as the anchor itself may be among them
                who = np.repeat(np.arange(len(s)), best.shape[1])
                best = best.ravel()
                anchor = some["row"].to_numpy()[at + who]
                keep = anchor != row[best]
                out.append(pd.DataFrame({"anchor": anchor, "row": row[best], "id": ids[best], "score": s[who, best]})[keep])
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "row": [], "id": [], "score": []}, dtype=np.int64)

    return run


def first_of_windows(count: int, low: int, high: int, step: int = 128):
    """The work on a pair of blocks in the second pass: the first ``count`` rows of other labels in each window of each anchor."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for some, own in _by_length(anchors, rows, ["dim"]):
            dim = int(own["dim"].iloc[0])
            a, x, row, ids = _matrix(some["vec"], dim), _matrix(own["vec"], dim), own["row"].to_numpy(), own["id"].to_numpy()
            codes, names = pd.factorize(pd.concat([some["label"], own["label"]]))
            mine, theirs = codes[: len(a)], codes[len(a) :]
            for at in range(0, len(a), step):
                scores = products(a[at : at + step], x)
                for i, s in enumerate(scores, at):
                    tops = sorted({int(p) for p in some["scores"].iloc[i] if p >= 0}, reverse=True)
                    if not tops:
                        continue
                    floors = [-(-low * p // 100) for p in tops]  # whole scores from here up, to high * p // 100
                    near = np.flatnonzero((s >= floors[-1]) & (s <= high * tops[0] // 100) & (theirs != mine[i]))
                    near = near[np.argsort(-s[near], kind="stable")]
                    down, taken = -s[near], np.zeros(len(near), bool)
                    for p, least in zip(tops, floors):
                        begin = np.searchsorted(down, -(high * p // 100))
                        taken[begin : min(begin + count, np.searchsorted(down, -least, side="right"))] = True
                    near = near[taken]
                    out.append(pd.DataFrame({"anchor": some["row"].iloc[i], "row": row[near], "id": ids[near], "score": s[near]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "row": [], "id": [], "score": []}, dtype=np.int64)

    return run


def in_blocks(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, work) -> DataFrame:
    """``work`` on every pair of a block of anchors and a block of rows."""
    keys = ["of_anchors", "of_rows"]

    def dealt(t: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        t = t.select([F.col(c).alias(c) for c in t.columns])  # columns of its own: both sides come from one table
        return t.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(anchors, "of_anchors", anchor_blocks, "of_rows", row_blocks)
    right = dealt(rows, "of_rows", row_blocks, "of_anchors", anchor_blocks)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "anchor long, row long, id long, score long")


def stream_windows(keyed, negatives: int, low: int, high: int):
    """Results of rows that come sorted by (anchor, descending score, kind, id, row); kind 0 opens a window, kind 1 may fall into open ones."""
    anchor, windows = None, []
    for (of, down, kind, id, _), anchor_id in keyed:
        if of != anchor:
            anchor, windows = of, []
        score = -down
        if kind == 0:
            windows.append([id, score, 0])
            continue
        for w in windows:
            if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], id, w[1], score
        # a window that is full or lies above stays in the list: there are as many as the anchor has positives


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    row_block: int = 16_384, anchor_block: int = 4_096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, label, embedding).

    ``anchor``: condition on ``id``, the row's vec_id. Windows: low * positive <= 100 * negative <= high * positive, high at most 100.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows lie under their positive: 0 <= low <= high <= 100")
    spark = vectors.sparkSession
    with arrow_rows(spark, 5000, "16m"):
        rows = staged(whole_vectors(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")  # written, so the numbers stay
        anchors = rows.filter(anchor)
        n, m = rows.count(), anchors.count()
        row_blocks, anchor_blocks = max(-(-n // row_block), min(8, -(-n // 512)), 1), max(-(-m // anchor_block), 1)
        near = in_blocks(anchors, rows, anchor_blocks, row_blocks, best_of_label(positives))
        first = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
        best = near.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= positives).drop("no")
        best = staged(best, "negatives-positives")
        scores = best.groupBy("anchor").agg(F.collect_set("score").alias("scores"))  # an anchor has ``positives`` at most
        opened = anchors.join(scores.withColumnRenamed("anchor", "row"), "row")
        windows = in_blocks(opened, rows, anchor_blocks, row_blocks, first_of_windows(negatives, low, high))
        both = best.select("*", F.lit(0).alias("kind")).unionByName(windows.select("*", F.lit(1).alias("kind")))
        names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        both = staged(both.join(names, "anchor").select("anchor", "score", "kind", "id", "row", "anchor_id"), "negatives-keys")
    keyed = both.rdd.map(lambda r: ((r[0], -r[1], r[2], r[3], r[4]), r[5]))
    ordered = keyed.repartitionAndSortWithinPartitions(partitions(spark), lambda key: zlib.crc32(b"%d" % key[0]))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(ordered.mapPartitions(lambda keyed: stream_windows(keyed, negatives, low, high)), schema)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)
