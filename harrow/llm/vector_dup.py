"""Embedding near-dedup by lattice hashing.

1. Equal vectors become one class with a count, by aggregation with map-side combine.
2. Each table projects a vector to one or more blocks of 8 dimensions with Gaussian weights and decodes each to the
   nearest point of the E8 lattice, scaled by ``scale``; in each block the ``probes`` next nearest lattice points are
   probed too. Vectors that share the cells of all blocks of a table meet in a bucket; their cosines are checked there in
   double precision. A bucket gives a spanning forest of its links, never its pairs; connected components follow.
3. All vectors of a component meet in one task, or in pairs of blocks if there are many, and each one's links are
   counted there by matrix products. Counts leave the task, pairs do not.

``design`` chooses blocks, scale, probes and the number of tables from the number of vectors: a pair at the threshold
is missed by all tables with probability 1 - ``recall`` (found by simulation: projections of such a pair are Gaussian),
and among such choices the work for a vector, its cells and the unrelated vectors met in them, is the least. So cells
get finer as vectors get more, and buckets do not grow with the table. No bucket is capped. Recall against brute force
is measured in ``tests/llm``.

Defined cases: a vector that is null, empty or zero or holds null or non-finite components links with nothing, is its
own component and kept; vectors of different dimensions do not link; rows without vec_id are kept, linked with nothing;
rows that share a vec_id are one node: equal vectors of one id count once, its different vectors are in one component,
and n_links counts for each row the other ids' vectors that its own vector links with; labels and other columns are left
out of the work.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.components import block_pairs, blocks_of, components, ties
from harrow.llm.near_dup import _grouped, bounds, forest
from harrow.llm.shared import arrow_rows, partitions, read, staged
from harrow.llm.words import mix


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of the E8 lattice (rows of 8), doubled so that all coordinates are whole."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], 2 * a, 2 * b)


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: +-1 at two places, and all +-1/2 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        if m.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if m >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


def _points(x: np.ndarray, probes: int) -> np.ndarray:
    """Hashes, (n, 1 + probes), of the nearest lattice point of each row and the next nearest around it."""
    around = _minimal_vectors()
    at = e8(x)
    gain = (x - at / 2) @ around.T  # nearer neighbours have the larger product: all are equally long
    best = np.argpartition(-gain, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
    points = np.concatenate([at[:, None], at[:, None] + 2 * around[best]], axis=1)
    weights = mix(np.arange(8, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    return mix((np.rint(points).astype(np.int64).view(np.uint64) * weights).sum(-1))


def cells(vectors: np.ndarray, tables: int, scale: float, probes: int, blocks: int = 1) -> np.ndarray:
    """Bucket keys, (n, tables * (1 + probes) ** blocks), of unit vectors."""
    n, dim = vectors.shape
    wide = (1 + probes) ** blocks
    keys = np.empty((n, tables * wide), np.uint64)
    for t in range(tables):
        g = np.random.Generator(np.random.PCG64(1_000_003 * dim + t)).standard_normal((dim, 8 * blocks))
        x = vectors @ g / scale
        key = np.full((n, 1), mix(np.array([t * 65536 + dim], np.uint64))[0])
        for j in range(blocks):
            key = mix(key[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + _points(x[:, 8 * j : 8 * j + 8], probes)[:, None]).reshape(n, -1)
        keys[:, t * wide : (t + 1) * wide] = key
    return keys


@lru_cache
def _chance(cosine: float, scale: float, probes: int) -> float:
    """Share of pairs at ``cosine`` that have a cell of one block in common, from 4,000 simulated pairs."""
    g = np.random.Generator(np.random.PCG64(8))
    x, z = g.standard_normal((2, 4000, 8))
    a, b = _points(x / scale, probes), _points((cosine * x + math.sqrt(1 - cosine * cosine) * z) / scale, probes)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def design(n: int, cosine: float = 0.95, recall: float = 0.995) -> dict:
    """Tables, scale, probes and blocks for ``n`` vectors. A cell costs about as much as ten vectors met in one."""
    best = None
    for scale in (2.0, 1.4, 1.2, 1.0, 0.85, 0.7):
        for probes in (0, 1, 3):
            near = _chance(cosine, scale, probes)
            met = (1 + probes) ** 2 * (scale / (2 * math.sqrt(math.pi))) ** 8  # of an unrelated vector: the sum of squares of a Gaussian's cells
            for blocks in (1, 2, 3, 4):
                hit = min(near**blocks, 0.999)
                tables = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit > 0.01 else 10_000
                cost = tables * ((1 + probes) ** blocks + 0.1 * n * met**blocks)
                if best is None or cost < best[0]:
                    best = cost, {"tables": tables, "scale": scale, "probes": probes, "blocks": blocks}
    return best[1]


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, d1, d2, vec): the vector as doubles scaled to length 1 in ``vec``, its digest in d1, d2; nulls if it links with nothing."""

    def run(batches):
        for b in batches:
            out = []
            for v in b["embedding"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not np.abs(x).max() > 0:
                    out.append((None, None, None))
                    continue
                d = np.frombuffer(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest(), np.int64)
                x = x / np.abs(x).max()
                out.append((d[0], d[1], (x / np.sqrt((x * x).sum())).tobytes()))
            frame = pd.DataFrame(out, columns=["d1", "d2", "vec"])
            frame.insert(0, "vec_id", b["vec_id"].astype("Int64"))
            yield frame.astype({"d1": "Int64", "d2": "Int64"})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "vec_id long, d1 long, d2 long, vec binary")


def _same_length(vecs: pd.Series):
    """(positions, matrix) for each length of vector."""
    size = vecs.map(len).to_numpy()
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, np.frombuffer(b"".join(vecs.iloc[at]), np.float64).reshape(len(at), -1)


def lattice_links(classes: DataFrame, cosine: float, lattice: dict, block: int = 8192) -> DataFrame:
    """Spanning forests (a, b) of the links inside each bucket. ``classes``: node, vec; ``lattice``: see ``design``."""
    spark = classes.sparkSession

    def hashed(batches):
        for b in batches:
            for at, x in _same_length(b["vec"]):
                keys = cells(x, **lattice)
                yield pd.DataFrame({"bucket": keys.view(np.int64).ravel(), "node": np.repeat(b["node"].to_numpy()[at], keys.shape[1])})

    members = staged(classes.mapInPandas(hashed, "bucket long, node long"), "vectors-cells")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(sizes, "bucket").join(classes.select("node", "vec"), "node")
    keys = ["bucket", "block_a", "block_b"]
    dealt = block_pairs(shared, blocks_of(F.col("n"), block), "node").select(*keys, "node", "vec")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for g in _grouped(batches, keys):
            cut, ids, a, b = bounds(g, keys), g["node"].to_numpy(), [], []
            x = np.frombuffer(b"".join(g["vec"]), np.float64)
            width = g["vec"].map(len).to_numpy() // 8
            begin = np.concatenate([[0], np.cumsum(width)])
            for lo, hi in zip(cut[:-1], cut[1:]):
                own = x[begin[lo] : begin[hi]].reshape(hi - lo, -1)  # a bucket key includes the dimension
                p, q = forest(hi - lo, lambda i, others, own=own: own[others] @ own[i] >= cosine, ids[lo:hi])
                a.extend(p)
                b.extend(q)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}).drop_duplicates()

    return dealt.mapInPandas(run, "a long, b long")


def count_links(members: DataFrame, cosine: float, block: int = 4096) -> DataFrame:
    """(node, links) with the number of vectors of other classes linked to each class. ``members``: cluster, node, n, vec."""
    spark = members.sparkSession
    load = members.groupBy("cluster").agg(blocks_of(F.count(F.lit(1)), block).alias("blocks"))
    keys = ["cluster", "block_a", "block_b"]
    dealt = block_pairs(members.join(load, "cluster"), F.col("blocks"), "node").select(*keys, "block", "node", "n", "vec")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for g in _grouped(batches, keys):
            cut, out = bounds(g, keys), []
            for lo, hi in zip(cut[:-1], cut[1:]):
                part = g.iloc[lo:hi]
                x = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(hi - lo, -1)
                n, ids = part["n"].to_numpy(), part["node"].to_numpy()
                first = (part["block"] == part["block_a"]).to_numpy()
                one, two = np.flatnonzero(first), np.flatnonzero(~first)
                same = part["block_a"].iloc[0] == part["block_b"].iloc[0]
                right = one if same else two
                for at in range(0, len(one), 1024):
                    rows = one[at : at + 1024]
                    near = x[rows] @ x[right].T >= cosine
                    if same:
                        near[rows[:, None] == right[None]] = False
                    out.append((ids[rows], near @ n[right]))
                    if not same:
                        out.append((ids[right], near.T @ n[rows]))
            yield pd.DataFrame({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]).astype(np.int64)})

    return dealt.mapInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def vector_duplicates(vectors: DataFrame, cosine: float = 0.95, lattice: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding). ``lattice``: by ``design`` where None."""
    with arrow_rows(vectors.sparkSession, 5000):
        every = staged(clean(vectors), "vectors-clean")
        once = every.filter("d1 is not null and vec_id is not null").select("vec_id", "d1", "d2").distinct()
        number = once.groupBy("d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
        vecs = every.filter("d1 is not null and vec_id is not null").groupBy("d1", "d2").agg(F.first("vec").alias("vec"))
        classes = staged(number.join(vecs, ["d1", "d2"]).select(F.monotonically_increasing_id().alias("node"), "*"), "vectors-classes")  # written, so the numbers stay
        links = staged(lattice_links(classes.select("node", "vec"), cosine, lattice or design(classes.count(), cosine)), "vectors-links")
        found = staged(components(links, "vectors-components").withColumnRenamed("component", "cluster"), "vectors-found")
        counted = staged(count_links(classes.join(found, "node").select("cluster", "node", "n", "vec"), cosine), "vectors-counted")
    shared = ties(every, classes, "vec_id", "vectors")
    if shared:
        found = staged(components(links.unionByName(shared[1]), "vectors-tied").withColumnRenamed("component", "cluster"), "vectors-found-tied")
    named = classes.select("node", "d1", "d2", "n", "vec_id").join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    low = named.groupBy("cluster").agg(F.min("vec_id").alias("component_id"))
    named = named.drop("vec_id").join(low, "cluster").join(counted, "node", "left").select(
        "node", "d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = every.select("vec_id", "d1", "d2").join(named.drop("node"), ["d1", "d2"], "left").select("vec_id", "n_links", "component_id")
    if shared:
        of_id = shared[0].join(named.select("node", "component_id"), "node").groupBy("vec_id").agg(F.min("component_id").alias("tied"))
        out = out.join(of_id, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "tied"))
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
