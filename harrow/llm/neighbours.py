"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

1. Centroids: a sample of at most ``16 x lists`` rows, chosen by hash, is halved again and again at the median along the
   axis of a 2-means, until there are as many parts as lists; equal parts make balanced lists. Their means are linked in a graph
   (nearest ones, and a few at random to keep it whole). Both are bounded: ``most_lists`` centroids at most.
2. Posting lists: every row goes to the list of its nearest centroid and, if it lies near a boundary, also to those up
   to ``boundary`` times as far. Rows and queries find their centroids by a search of the graph that goes on from every
   centroid met within the ratio wanted.
3. Search: a query reads the lists whose centroid is at most ``ratio`` times as far as the nearest one. ``ratio`` is
   calibrated: for ``calibrate`` queries the true neighbours are found by comparing with all rows, and the ratio is the
   least that reaches the share ``recall`` of them. Inner products are put in terms of distance by one more component
   that makes all rows equally long, and by scaling queries to that length.
4. A list and its queries meet in a cogroup and are scored there in double precision, with equal vectors scored once; each query's
   best k of a list leave the task as one row. Lists and queries beyond a block's size are dealt to blocks.
   One sorted pass merges a query's rows, holding k at a time.

How it scales. Each row is shuffled once for each list it is in (1 to 2 on average), each query once for each list it
reads. Where vectors have no structure, as random ones, no index prunes much and the calibrated ratio lets queries read
most lists: the recall is kept, not the speed. With structure few lists are read.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows without vec_id, take
no part, as queries either; vectors of different lengths are not compared (one index a length); rows that share a vec_id each
take part, a query's own row alone is left out, and their ties go by row; fewer than k candidates are all returned; an
empty table gives an empty result; other columns are left out of the work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.near_dup import _grouped
from harrow.llm.shared import arrow_rows, partitions, read, staged

HITS = "query long, query_id long, rows binary, ids binary, scores binary"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec, dim, norm) of the rows that take part; vec has the components' bytes in the column's own precision."""
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["id"], b["embedding"]):
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    out.append((i, x.astype(kind).tobytes(), len(x), float(np.sqrt(dots(x[None], x[None])[0]))))
            yield pd.DataFrame(out, columns=["id", "vec", "dim", "norm"])

    there = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").dropna()
    return there.mapInPandas(run, "id long, vec binary, dim int, norm double")


def matrix(vec: pd.Series, dim: int) -> np.ndarray:
    data = b"".join(vec)
    kind = np.float32 if len(data) == 4 * dim * len(vec) else np.float64
    return np.frombuffer(data, kind).reshape(len(vec), dim).astype(np.float64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with the same row of b; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1)


class Index:
    """Centroids, the graph that links them, and the length that rows are brought to. Its size is bounded by the number of lists."""

    def __init__(self, sample: np.ndarray, lists: int, length: float, degree: int = 12, seed: int = 1):
        self.length = length
        x = self.rows(sample)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centroids = balanced_means(x, min(lists, len(x)), rng)
        k = len(self.centroids)
        self.half = (self.centroids**2).sum(1) / 2
        near = np.empty((k, min(degree, k - 1)), np.int32)
        for at in range(0, k, 256):
            d = self.half[None] - self.centroids[at : at + 256] @ self.centroids.T
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near[at : at + 256] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[at : at + 256]
        onward = (np.arange(k)[:, None] + 1) % k  # parts come in order of the halving; this alone links all
        self.graph = np.concatenate([near, onward, rng.integers(0, k, (k, 3))], axis=1).astype(np.int32)
        self.entries = np.unique(np.linspace(0, k - 1, max(1, int(np.sqrt(k)))).astype(np.int64))  # spread out, by the same order

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.length**2 - dots(x, x), 0))[:, None]], axis=1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q * (self.length / np.sqrt(dots(q, q)))[:, None], np.zeros((len(q), 1))], axis=1)

    def search(self, points: np.ndarray, ratio: float, beam: int = 8) -> np.ndarray:
        """Distances, (points, centroids), of the centroids that the search of the graph meets; others infinite.

        It starts from the entries and goes on from each centroid that is within ``ratio`` of the nearest one met, and from the ``beam`` nearest.
        """
        n, k = len(points), len(self.centroids)
        square = (points**2).sum(1)
        dist, done = np.full((n, k), np.inf), np.zeros((n, k), bool)

        def meet(i: np.ndarray, c: np.ndarray) -> None:
            d = square[i] + 2 * (self.half[c] - np.einsum("ij,ij->i", points[i], self.centroids[c]))
            dist[i, c] = np.sqrt(np.maximum(d, 0))

        meet(np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n))
        at = min(beam, k) - 1
        while True:
            bound = np.maximum(dist.min(1) * ratio, np.partition(dist, at, axis=1)[:, at])
            bound[~np.isfinite(bound)] = np.finfo(float).max
            i, c = np.nonzero((dist <= bound[:, None]) & ~done)
            if not len(i):
                return dist
            done[i, c] = True
            new = np.zeros((n, k), bool)
            new[i[:, None], self.graph[c]] = True
            meet(*np.nonzero(new & np.isinf(dist)))


def balanced_means(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Means of ``parts`` equal parts of the rows of x: halved at the median along the axis of a 2-means, over and over."""
    done, todo = [], [(np.arange(len(x)), parts)]
    while todo:
        at, k = todo.pop()
        if k == 1:
            done.append(x[at].mean(0))
            continue
        own = x[at]
        a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
        for _ in range(4):
            side = ((own - a) ** 2).sum(1) <= ((own - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = own[side].mean(0), own[~side].mean(0)
        order = at[np.argsort(own @ (b - a), kind="stable")]
        cut = len(at) * (k // 2) // k
        todo += [(order[cut:], k - k // 2), (order[:cut], k // 2)]
    return np.array(done)


def lists_of(t: DataFrame, index: Index, ratio: float, queries: bool, step: int = 256) -> DataFrame:
    """The rows of ``t`` once for each list whose centroid is within ``ratio`` of their nearest one: column ``list``."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), *t.schema.fields])

    def run(batches):
        for b in batches:
            x = matrix(b["vec"], int(b["dim"].iloc[0])) if len(b) else None
            for at in range(0, len(b), step):
                dist = index.search(index.queries(x[at : at + step]) if queries else index.rows(x[at : at + step]), ratio)
                i, c = np.nonzero(dist <= dist.min(1)[:, None] * ratio)
                out = b.iloc[at + i].copy()
                out.insert(0, "list", c.astype(np.int32))
                yield out

    return t.mapInPandas(run, schema)


def best_rows(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 256):
    """(position of the query, position of the row, score): each query's best k of the rows of x, best first. ``own``: the queries' rows."""
    order = np.lexsort((rows, ids))
    x, ids, rows = x[order], ids[order], rows[order]
    _, first, which = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    members, begin = np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which))])
    some = np.minimum(np.diff(begin), k + 1)  # of equal vectors: the first k and one in place of the query's own row
    once, slack = x[first], 1e-12 * x.shape[1]
    for at in range(0, len(q), step):
        a = q[at : at + step]
        s = a @ once.T
        if s.shape[1] > k + 1:
            floor = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            floor = floor - slack * np.abs(a).max(1) * np.abs(once).max()
            i, c = np.nonzero(s >= floor[:, None])
        else:
            i, c = (v.ravel() for v in np.indices(s.shape))
        exact = dots(a[i], once[c])
        n = some[c]
        place = members[np.repeat(begin[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        i, exact = np.repeat(i, n), np.repeat(exact, n)
        keep = own[at + i] != rows[place]
        i, exact, place = i[keep], exact[keep], place[keep]
        sort = np.lexsort((rows[place], ids[place], -exact, i))
        i, exact, place = i[sort], exact[sort], place[sort]
        no = np.arange(len(i)) - np.searchsorted(i, i)
        yield at + i[no < k], order[place[no < k]], exact[no < k]


def _packed(i: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    """One row for each query; i: positions in ``queries``, ascending."""
    at, cut = np.unique(i, return_index=True)
    split = lambda v: [p.tobytes() for p in np.split(v, cut[1:])] if len(at) else []
    return pd.DataFrame({"query": queries[at], "query_id": query_ids[at], "rows": split(rows), "ids": split(ids), "scores": split(scores)})


def in_lists(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = np.zeros(0, np.int64)
        if not len(queries) or not len(rows):
            return _packed(empty, empty, empty, empty, empty, np.zeros(0))
        dim = int(rows["dim"].iloc[0])
        ids, row, own, own_id = (v.to_numpy() for v in (rows["id"], rows["row"], queries["row"], queries["id"]))
        out = [_packed(i, own, own_id, row[j], ids[j], s) for i, j, s in best_rows(matrix(queries["vec"], dim), own, matrix(rows["vec"], dim), ids, row, k)]
        return pd.concat(out)

    return run


def merged(batches, k: int):
    """Each query's best k of all its rows; the batches are sorted by query."""
    for g in _grouped(batches, ["query"]):
        n = g["ids"].map(len).to_numpy() // 8
        query, query_id = np.repeat(g["query"].to_numpy(), n), np.repeat(g["query_id"].to_numpy(), n)
        row, ids = (np.frombuffer(b"".join(g[c]), np.int64) for c in ("rows", "ids"))
        score = np.frombuffer(b"".join(g["scores"]), np.float64)
        sort = np.lexsort((row, ids, -score, query))
        query, query_id, row, ids, score = (v[sort] for v in (query, query_id, row, ids, score))
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])  # a row that is in several lists has the same score in each
        query, query_id, ids, score = query[new], query_id[new], ids[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        at = rank <= k
        yield pd.DataFrame({"query_id": query_id[at], "rank": rank[at].astype(np.int32), "vec_id": ids[at], "score": score[at]})


def true_neighbours(rows: DataFrame, queries: pd.DataFrame, dim: int, k: int) -> DataFrame:
    """(query, row): the best k of all rows for each of a bounded number of queries."""
    q, own, own_id = matrix(queries["vec"], dim), queries["row"].to_numpy(), queries["id"].to_numpy()

    def run(batches):
        held = None  # the best k so far of this task
        for b in batches:
            if not len(b):
                continue
            row, ids = b["row"].to_numpy(), b["id"].to_numpy()
            new = [pd.DataFrame({"at": i, "query": own[i], "row": row[j], "id": ids[j], "score": s}) for i, j, s in best_rows(q, own, matrix(b["vec"], dim), ids, row, k)]
            held = pd.concat([held, *new] if held is not None else new).sort_values(["at", "score", "id", "row"], ascending=[True, False, True, True])
            held = held[held.groupby("at").cumcount() < k]
        if held is not None:
            yield held[["query", "row", "id", "score"]]

    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row")
    best = rows.select("row", "id", "vec").mapInPandas(run, "query long, row long, id long, score double")
    return best.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= k).select("query", "row")


def calibrated(index: Index, rows: DataFrame, postings: DataFrame, queries: pd.DataFrame, dim: int, k: int, recall: float) -> float:
    """The least ratio at which the lists read hold the share ``recall`` of the true neighbours of the queries."""
    true = true_neighbours(rows, queries, dim, k)  # k rows for each query: bounded
    where = postings.select("row", "list").join(F.broadcast(true), "row").select("query", "row", "list").toPandas()
    place = dict(zip(queries["row"], range(len(queries))))
    dist = np.concatenate([index.search(index.queries(matrix(queries["vec"].iloc[i : i + 64], dim)), np.inf) for i in range(0, len(queries), 64)])
    ratio = dist / np.maximum(dist.min(1), np.finfo(float).tiny)[:, None]
    where["ratio"] = ratio[where["query"].map(place).to_numpy(np.int64), where["list"].to_numpy()]
    found = np.sort(where.groupby(["query", "row"])["ratio"].min().to_numpy())
    return min(float(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) * (1 + 1e-9), 1e12) if len(found) else 1.0


def nearest(
    vectors: DataFrame, query: Column, k: int = 20, rows_per_list: int = 512, most_lists: int = 16_384, boundary: float = 1.01, recall: float = 0.96,
    calibrate: int = 128, ratio: float | None = None, block: int = 8_192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of (vec_id, embedding) where ``query``, a condition on ``id``, holds."""
    spark = vectors.sparkSession
    result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with arrow_rows(spark, 5000, "8m"):
        every = staged(valid_vectors(vectors).select(F.monotonically_increasing_id().alias("row"), "*"), "neighbours-rows")  # written, so the numbers stay
        for dim, n, length in every.groupBy("dim").agg(F.count(F.lit(1)), F.max("norm")).orderBy("dim").collect():
            rows = every.filter(F.col("dim") == dim).select("row", "id", "vec", "dim")
            asked = rows.filter(query)
            lists = int(min(most_lists, max(4, round(n / rows_per_list))))
            by_hash = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            sample = rows.filter(by_hash < 16 * lists / n).sort("row").limit(32 * lists).toPandas()
            known = asked.orderBy(F.xxhash64("row")).limit(calibrate).toPandas()
            if not len(known):
                continue
            if not len(sample):
                sample = known
            index = Index(matrix(sample["vec"], dim), lists, length)
            postings = staged(lists_of(rows, index, boundary, queries=False), "neighbours-lists")
            reach = ratio or calibrated(index, rows, postings, known, dim, k, recall)
            reading = staged(lists_of(asked, index, reach, queries=True), "neighbours-reading")

            def dealt(t: DataFrame, own: str, other: str, blocks: DataFrame) -> DataFrame:
                t = t.join(F.broadcast(blocks), "list")
                t = t.select([F.col(c).alias(c) for c in t.columns])  # columns of its own: both sides are joined with one table
                return t.withColumn(f"{own}_no", F.pmod(F.xxhash64("row"), F.col(own)).cast("int")).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

            sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("of_rows"))
            loads = reading.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("of_queries"))
            blocks = staged(sizes.join(loads, "list"), "neighbours-blocks")  # a row a list: ``most_lists`` at most
            keys = ["list", "of_rows_no", "of_queries_no"]
            left, right = dealt(reading, "of_queries", "of_rows", blocks), dealt(postings, "of_rows", "of_queries", blocks)
            hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(in_lists(k), HITS)
            hits = staged(hits, "neighbours-hits").repartition(partitions(spark), "query").sortWithinPartitions("query")
            result = result.unionByName(hits.mapInPandas(lambda batches: merged(batches, k), result.schema))
    return result


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
