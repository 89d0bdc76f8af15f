"""MinHash near-dedup with odd sketches.

Documents are sets of distinct 5-word shingles (A-Z lower-cased); two are linked from a Jaccard similarity of 0.75.

1. One pass over the texts writes, for each document, an exact digest of its set, ``bands`` keys of ``rows`` MinHash
   values each, and an odd sketch: each of the bands x rows samples flips one bit of a bitmap. Two sketches' XOR
   population count estimates how many samples differ, precisely where few do.
2. Documents with equal sets become one class by aggregation with map-side combine, so copies cost nothing later.
3. Classes that share a band key are candidates. In a bucket, odd sketches are compared in place; a pair stays a
   candidate if its estimate is at least ``floor`` (0.5: six standard deviations below 0.75). A bucket gives a
   spanning forest of its candidates, never its pairs, and of that only links between members that share no key of an
   earlier band: the bucket of that key connects the others. Connected components make candidate clusters.
4. The texts of each cluster (those of candidates only) are compared on full sets. A cluster that fits one block is
   compared whole in one task. A larger one is dealt to blocks at random, and a few of its members, the pivots, go to all
   of them: what belongs together mostly comes together there. Its members outside the largest component found are then
   compared with all its members, in pairs of blocks; what is in one component already needs no more. So a large group
   of copies costs one pass over its texts, and only loose clusters cost more. Tasks give spanning forests; their
   components are the result.

A pair at 0.75 shares no band key with probability (1 - 0.75^4)^30 = 1.1e-5; more similar pairs are far safer, and
what shares a cluster is compared even so. No bucket, partner list or candidate list is capped.

Defined cases: no text or no words: empty set, linked with nothing, kept; fewer than 5 words: the whole sequence is the
one shingle; rows that share a doc_id are one node in ``near_duplicates`` (all their sets' links are its links), and
each a node of its own in ``groups``; rows without doc_id are kept and linked with nothing; other columns are left out
of the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.components import block_pairs, blocks_of, components, ties
from harrow.llm.shared import WORD, arrow_rows, lean, partitions, read, staged
from harrow.llm.words import Words, chunks, mix

ODD_BITS = 512


def shingle_sets(texts: list, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], lower=True)
        runs = words.runs(k)
        for d in range(hi - lo):
            a, b = words.first[d], words.first[d + 1]
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                own = words.hash[a:b] ^ mix(np.arange(b - a, dtype=np.uint64) + np.uint64(b - a) * np.uint64(16))  # place and number count
                yield mix(own.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, n = bands, rows, bands * rows
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
        self.a, self.b = (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)
        self.index = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))

    def samples(self, s: np.ndarray) -> np.ndarray:
        h = (s >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for at in range(0, len(h), 2048):
            x = h[at : at + 2048, None] ^ self.b
            x *= self.a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(out, x.min(0), out=out)
        return out

    def sketch(self, s: np.ndarray) -> tuple[list, bytes]:
        m = self.samples(s).astype(np.uint64)
        keyed = mix(m ^ self.index)
        band = keyed.reshape(self.bands, self.rows)
        keys = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + band[:, j])
        bits = np.zeros(ODD_BITS, np.uint8)
        np.bitwise_xor.at(bits, (keyed % np.uint64(ODD_BITS)).astype(np.int64), 1)
        return keys.view(np.int64), np.packbits(bits).tobytes()


def estimates(one: np.ndarray, many: np.ndarray, samples: int) -> np.ndarray:
    """Similarity estimates from odd sketches (uint64 words)."""
    z = np.bitwise_count(many ^ one).sum(-1, dtype=np.int64)
    fill = np.minimum(2.0 * z / ODD_BITS, 1 - 1e-9)
    return 1 + ODD_BITS * np.log1p(-fill) / (4.0 * samples)


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups, some at a time, of batches that are sorted by ``keys``."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(b) - int(last[::-1].argmin()) if not last.all() else 0
        rest = b.iloc[cut:]
        if cut:
            yield b.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Starts of the groups and the end."""
    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def trees(n: int, row) -> Iterator[tuple[list, list]]:
    """Members of each component and each one's parent in a spanning tree (the root's is itself). ``row(i, others)`` says which of ``others`` i is linked to."""
    left = np.arange(n)
    while len(left):
        stack, members, parents = [left[0]], [left[0]], [left[0]]
        left = left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = row(i, left)
            found = left[hit]
            left = left[~hit]
            stack.extend(found)
            members.extend(found)
            parents.extend([i] * len(found))
        yield members, parents


def forest(n: int, row, ids: np.ndarray) -> tuple[list, list]:
    """Links from each member to the smallest id of its component."""
    a, b = [], []
    for members, _ in trees(n, row):
        if len(members) > 1:
            own = ids[members]
            a.extend(own)
            b.extend([own.min()] * len(own))
    return a, b


def met_before(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two lists of earlier bands' keys share one."""
    m = min(len(x), len(y))
    return bool((x[:m] == y[:m]).any())


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th, a hash of the text, tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame, bands: int = 30, rows: int = 4, k: int = 5) -> DataFrame:
    def run(batches):
        sketcher = Sketcher(bands, rows)
        for b in batches:
            out = []
            for s in shingle_sets(b["text"].tolist(), k):
                if len(s):
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    out.append((len(s), digest[0], digest[1], *sketcher.sketch(s)))
                else:
                    out.append((0, None, None, None, None))
            frame = pd.DataFrame(out, columns=["n_shingles", "d1", "d2", "keys", "odd"]).astype({"d1": "Int64", "d2": "Int64"})
            frame.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            frame.insert(1, "th", b["th"])
            yield frame

    return keyed(docs).mapInPandas(lean(run), "doc_id long, th long, n_shingles long, d1 long, d2 long, keys array<long>, odd binary")


def candidate_links(classes: DataFrame, bands: int = 30, rows: int = 4, floor: float = 0.5, block: int = 8192) -> DataFrame:
    """Links (a, b) that connect what the candidates of all buckets connect. ``classes``: node, keys, odd.

    A link of a bucket's spanning forest is left out if its ends also share a key of an earlier band, or a block where
    the bucket is compared in pairs of blocks: that bucket, or that block with itself, connects them.
    """
    spark, samples = classes.sparkSession, bands * rows
    members = classes.select("node", F.posexplode("keys").alias("band", "key"))
    members = members.select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(sizes, "bucket").join(classes.select("node", "odd", "keys"), "node").withColumn("before", F.expr("slice(keys, 1, band)")).drop("keys")
    dealt = block_pairs(shared, blocks_of(F.col("n"), block), "node")
    keys = ["bucket", "block_a", "block_b"]
    dealt = dealt.select(*keys, "block", "node", "odd", "before").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for g in _grouped(batches, keys):
            cut, ids, before = bounds(g, keys), g["node"].to_numpy(), g["before"].to_numpy()
            block, cross = g["block"].to_numpy(), (g["block_a"] != g["block_b"]).to_numpy()
            odd = np.frombuffer(b"".join(g["odd"]), np.uint64).reshape(len(g), -1)
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            near = two[estimates(odd[two], odd[two + 1], samples) >= floor] if len(two) else two
            a, b = list(near), list(near + 1)
            for lo, hi in zip(cut[:-1][size > 2], cut[1:][size > 2]):
                o = odd[lo:hi]
                for members, parents in trees(hi - lo, lambda i, others, o=o: estimates(o[i], o[others], samples) >= floor):
                    a.extend(lo + np.array(members[1:], np.int64))
                    b.extend(lo + np.array(parents[1:], np.int64))
            new = [(i, j) for i, j in zip(a, b) if not (cross[i] and block[i] == block[j]) and not met_before(before[i], before[j])]
            pair = ids[np.array(new, np.int64).reshape(-1, 2)]
            yield pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1]})

    return dealt.mapInPandas(lean(run), "a long, b long")


def linked(i: int, others: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, postings: tuple, share: int) -> np.ndarray:
    """Which of ``others`` have 100 * intersection >= share * union with set i."""
    member, start, place = postings
    mine = place[i]
    n = start[mine + 1] - start[mine]
    ends = np.cumsum(n)
    rows = member[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[mine] - (ends - n), n)]
    both = np.bincount(rows, minlength=len(sets))[others]
    return 100 * both >= share * (sizes[i] + sizes[others] - both)


def set_links(dealt: DataFrame, keys: list[str], k: int, share: int) -> DataFrame:
    """Spanning forests (cluster, a, b) of the links among the texts of each group. ``dealt``: keys (cluster first), node, text."""
    dealt = dealt.select(*keys, "node", "text").repartition(partitions(dealt.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for g in _grouped(batches, keys):
            g = g.drop_duplicates([*keys, "node"])
            cut, ids, cluster = bounds(g, keys), g["node"].to_numpy(), g[keys[0]].to_numpy()
            a, b, of = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo < 2:
                    continue
                own = list(shingle_sets(g["text"].iloc[lo:hi].tolist(), k))
                sizes = np.array([len(s) for s in own])
                value, place = np.unique(np.concatenate(own), return_inverse=True)
                member = np.repeat(np.arange(hi - lo), sizes)
                order = np.argsort(place, kind="stable")
                start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(value)))])
                postings = member[order], start, np.split(place, np.cumsum(sizes)[:-1])
                x, y = forest(hi - lo, lambda i, others: linked(i, others, own, sizes, postings, share), ids[lo:hi])
                a.extend(x)
                b.extend(y)
                of.extend([cluster[lo]] * len(x))
            yield pd.DataFrame({"cluster": np.array(of, np.int64), "a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.mapInPandas(lean(run), "cluster long, a long, b long")


def exact_links(texts: DataFrame, nodes: DataFrame, k: int = 5, share: int = 75, block_shingles: int = 500_000, block: int = 512) -> DataFrame:
    """Links (a, b) with the components of all links inside each cluster. ``texts``: cluster, node, text; ``nodes``: cluster, node, n_shingles."""
    load = nodes.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.sum("n_shingles") / block_shingles), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    sized = texts.join(load, "cluster")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < F.greatest(F.col("n") / F.col("blocks") / 16, F.lit(1)))
    last = F.col("blocks") - 1
    to = F.when(pivot, F.sequence(F.lit(0), last)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    first = staged(set_links(sized.withColumn("block", F.explode(to)), ["cluster", "block"], k, share), "near-links")
    large = staged(load.filter("blocks > 1"), "near-large")
    if large.isEmpty():
        return first.select("a", "b")
    found = components(first.join(large, "cluster", "left_semi"), "near-parts")
    part = nodes.join(large.select("cluster"), "cluster", "left_semi").join(found, "node", "left").select("cluster", "node", "n_shingles", F.coalesce("component", "node").alias("part"))
    each = part.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    main = each.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.sum("shingles").alias("all_shingles"), F.max("n").alias("most"))
    loose = part.join(main.filter("most < all"), "cluster").filter("part <> main")
    deal = loose.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / (block_shingles / 2)), F.ceil(F.count(F.lit(1)) / (block / 2))).cast("int").alias("lefts"),
        F.first(F.greatest(F.ceil(F.col("all_shingles") / (block_shingles / 2)), F.ceil(F.col("all") / (block / 2))).cast("int")).alias("rights"))
    deal = staged(deal, "near-loose")
    rows = texts.select("cluster", "node", "text").join(deal, "cluster")
    left, right = F.pmod(F.xxhash64("node", F.lit(11)), F.col("lefts")).cast("int"), F.pmod(F.xxhash64("node", F.lit(13)), F.col("rights")).cast("int")
    one = rows.join(loose.select("node"), "node", "left_semi").select("cluster", "node", "text", left.alias("left"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"))
    two = rows.select("cluster", "node", "text", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), right.alias("right"))
    more = staged(set_links(one.unionByName(two), ["cluster", "left", "right"], k, share), "near-more-links")
    return first.unionByName(more).select("a", "b")


class Groups:
    """The rows of documents with their set's digest (``rows``: doc_id, th, n_shingles, d1, d2), the distinct sets
    (``classes``: node, doc_id, th, d1, d2, n_shingles; doc_id and th are the smallest that have it) and ``links`` (a, b) between their nodes.
    """

    def __init__(self, rows: DataFrame, classes: DataFrame, links: DataFrame):
        self.rows, self.classes, self.links = rows, classes, links

    def named(self, tied: DataFrame | None = None) -> DataFrame:
        """``classes`` with ``component``, a node, from the links and from ``tied`` (a, b)."""
        links = self.links if tied is None else self.links.unionByName(tied)
        found = components(links, "near-components")
        return self.classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def groups(docs: DataFrame, bands: int = 30, rows: int = 4, k: int = 5, share: int = 75, floor: float = 0.5) -> Groups:
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        every = staged(sketches(docs, bands, rows, k), "near-sketches")
        whole = F.struct("doc_id", "th", "n_shingles", "keys", "odd")
        distinct = every.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min_by(whole, F.struct("doc_id", "th")).alias("x"))
        classes = staged(distinct.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "x.*"), "near-classes")  # written, so the numbers stay
        with arrow_rows(spark, 20_000):
            maybe = staged(candidate_links(classes, bands, rows, floor), "near-candidates")
        clusters = components(maybe, "near-clusters").withColumnRenamed("component", "cluster")
        wanted = clusters.join(classes.select("node", "doc_id", "th", "n_shingles"), "node")
        texts = staged(keyed(docs).join(wanted, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("cluster", "node", "text"), "near-texts")
        links = exact_links(texts, wanted.select("cluster", "node", "n_shingles"), k, share)
    return Groups(every.drop("keys", "odd"), classes.drop("keys", "odd"), links)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text)."""
    found = groups(docs, **how)
    shared = ties(found.rows, found.classes, "doc_id", "near")
    named = staged(found.named(shared and shared[1]).select("node", "d1", "d2", "doc_id", "component"), "near-named")
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(low, "component")
    out = found.rows.join(named.select("d1", "d2", "component_id"), ["d1", "d2"], "left").select("doc_id", "n_shingles", "component_id")
    if shared:
        of_id = shared[0].join(named.select("node", "component_id"), "node").groupBy("doc_id").agg(F.min("component_id").alias("tied"))
        out = out.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "tied")).drop("tied")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(component_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: the one with the smallest doc_id (and hash of the text), once.

    Each row is judged by its own text, whatever rows share its doc_id. Rows without words or doc_id all stay.
    """
    found = groups(docs, **how)
    stay = found.named().groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("__doc"), F.col("x.th").alias("__th"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__th"))
    judged = F.col("__doc").isNotNull() & F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    once = rows.filter(judged).join(stay, ["__doc", "__th"], "left_semi").dropDuplicates(["__doc", "__th"])
    return once.select("row.*").unionByName(rows.filter(~judged).select("row.*"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), e AS MATERIALIZED (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, doc_id FROM n
), r AS (
  WITH RECURSIVE t(u, v) AS (SELECT u, v FROM e UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u)
  SELECT u AS doc_id, min(v) AS component_id FROM t GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""
