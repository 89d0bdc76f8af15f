"""Importance resampling, hard negatives and nearest neighbours against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import hard_negatives, importance, neighbours, registry
from tests.conftest import DATA


def brute_resample(docs, targets, percent=25, least=20, buckets=10_000):
    lower = {c: c + 32 for c in range(65, 91)}

    def parts(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return w, [zlib.crc32(f.encode()) % buckets for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in parts(text)[1]:
            s[b] += 1
    for text in targets:
        for b in parts(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        w, f = parts(text)
        weight = sum(gain[b] for b in f) // max(1, len(f))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for no, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = no
    return sorted(tuple(r[:5]) for r in rows if r[0] is not None), sorted(r[1:5] for r in rows if r[0] is None)


def test_importance_query_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = registry.queries()["op11_importance_resampling"](spark, DATA)
    assert [d for _, d in got.dtypes] == ["bigint"] * 5
    assert sorted(tuple(r) for r in got.collect()) == brute_resample(docs, targets)[0]


def test_importance_edge_cases(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcXYZ01é漢") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " \n\t", "one", "A-b_c", "x" * 500 + " y", "É é z", " ".join(word() for _ in range(3000))]
    texts += [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[20]), (3, texts[21]), (None, texts[22])] + [(200 + i, texts[30]) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "rank", "may", "n", "bucket")}).repartition(3)
    target = spark.createDataFrame([(t,) for t in texts[10:20]] + [(None,)], "text string")
    want, nulls = brute_resample(docs, texts[10:20])
    for piece in (2_000_000, 50):
        monkeypatch.setattr(importance, "PIECE", piece)
        for batch in [t.encode() if t is not None else None for t in texts], [b"A" * 300 + b" b"]:
            found = [sorted(zip(d.tolist(), b.tolist())) for d, b, _ in importance.features(batch, 10_000)]
            merged = sorted(x for f in found for x in f)
            if piece == 2_000_000:
                whole = {len(batch): merged} if batch[0] is None else {**whole, len(batch): merged}
            assert merged == whole[len(batch)]
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    got = importance.resample(df, target).select(*columns).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == want and [list(r)[1:] for r in got if r[0] is None] == nulls
    none = importance.resample(df.limit(0), target)
    assert none.count() == 0 and importance.resample(df, target.limit(0)).count() == len(docs)
    unique = df.filter("doc_id > 3")
    drawn = importance.resampled(unique, target)
    assert drawn.columns == df.columns and drawn.count() == importance.resample(unique, target).filter("rank is not null").count() > 0


def test_crc_matrix():
    rows = np.random.Generator(np.random.PCG64(1)).integers(0, 256, (50, 17)).astype(np.uint8)
    assert importance.crc_matrix(rows).tolist() == [zlib.crc32(bytes(r)) for r in rows]
    assert importance.crc_matrix(np.zeros((2, 0), np.uint8)).tolist() == [0, 0]


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    """rows: (vec_id, label, vector); results as a sorted list."""
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (a, label, v) in enumerate(ok):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, b) for m, (i, b, w) in enumerate(ok) if m != n and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, pid, rank, nid, -p, -s) for rank, (s, nid, _) in enumerate(near, 1)]
    return sorted(out)


def test_negatives_query_by_brute_force(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = registry.queries()["op12_hard_negatives"](spark, DATA)
    assert [d for _, d in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0) and got


@pytest.mark.parametrize("blocks", [{}, {"row_block": 40, "anchor_block": 5}])
def test_negatives_edge_cases(spark, blocks):
    g = np.random.Generator(np.random.PCG64(6))
    base = g.normal(size=(6, 8))
    rows = [(i, i % 4, [float(np.float32(x)) for x in np.rint(4 * (base[i % 6] + 0.3 * g.normal(size=8))) / 8]) for i in range(300)]  # many ties
    rows += [(1000 + i, i % 5, rows[10][2]) for i in range(100)] + [(10, 2, rows[10][2]), (10, 1, rows[11][2])]  # a hot vector, shared ids
    rows += [(400, None, rows[0][2]), (410, 1, None), (420, 1, [None, 1.0]), (430, 1, [math.nan] * 8), (440, 1, [math.inf] * 8), (450, 1, []), (460, 2, []), (470, 2, []), (480, 3, [0.0] * 8), (490, 1, [1.0]), (None, 1, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("row", "score", "kind", "anchor", "id", "vec")}).repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, **blocks)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, high=120)


def test_large_components_stay_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**20, 2.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 3, 2**60 + 2]]
    assert hard_negatives.first_columns(np.array([[2**60 + 2, 2**60 + 3, 5, 2**60 + 3]]), 2).tolist() == [[1, 3]]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def brute_nearest(rows, is_query, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for n, (q, v) in enumerate(ok):
        if is_query(q):
            scored = sorted((-float((v * w).sum()), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v))
            out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(tuple(r) for r in df.collect()):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_neighbours_query_recall(spark):
    for d, least in ((DATA, 0.93), ("/root/testdata/sf0.1", 0.93)):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
        df = registry.queries()["op13_neighbours"](spark, d)
        assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "double"]
        got, hit = found(df), 0
        assert set(got) == set(want)
        vec = {i: np.array(v, float) for i, v in rows}
        for q, own in got.items():
            assert [r[0] for r in own] == list(range(1, 21))
            assert [(-r[2], r[1]) for r in own] == sorted((-r[2], r[1]) for r in own) and q not in {r[1] for r in own}
            assert all(abs((vec[q] * vec[i]).sum() - s) < 1e-12 for _, i, s in own)
            hit += len({r[1] for r in own} & {i for i, _ in want[q][0]})
        assert hit >= least * 20 * len(want), hit / 20 / len(want)


def test_structure_is_pruned_and_kept(spark):
    """Vectors in groups and of unequal length: high recall with a few of the lists read."""
    g = np.random.Generator(np.random.PCG64(7))
    base = g.normal(size=(60, 24))
    x = (base[g.integers(0, 60, 3000)] + 0.2 * g.normal(size=(3000, 24))) * g.uniform(0.8, 1.2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(df, F.col("id") % 20 == 0, k=10, rows_per_list=64, recall=0.96))
    want = brute_nearest(rows, lambda i: i % 20 == 0, 10)
    hit = sum(len({r[1] for r in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert hit >= 0.93 * 10 * len(want)
    length = float(np.sqrt((x**2).sum(1).max()))
    index = neighbours.Index(x, 600, length)
    points = index.rows(x)
    true = np.sqrt(((points[:, None] - index.centroids[None]) ** 2).sum(2))
    met = index.search(points, 1.0)
    assert np.mean(met.argmin(1) == true.argmin(1)) > 0.95 and np.isfinite(met).mean() < 0.4
    few = neighbours.Index(x, 47, length)
    sizes = np.bincount(few.search(points, 1.0).argmin(1), minlength=47)
    assert len(few.centroids) == 47 and sizes.max() < 6 * sizes.mean()
    near = few.search(few.queries(x), np.inf)
    best = np.array([near[q, few.search(points[[i for i, _ in want[q][0]]], 1.0).argmin(1)].max() for q in want])
    assert np.mean(near[list(want)] <= np.quantile(best / near[list(want)].min(1), 0.9) * near[list(want)].min(1)[:, None]) < 0.5  # few lists hold the neighbours


@pytest.mark.parametrize("block", [8192, 20])
def test_neighbours_edge_cases(spark, block):
    g = np.random.Generator(np.random.PCG64(8))
    rows = [(i, [float(x) for x in np.rint(2 * g.normal(size=6))]) for i in range(200)]  # many ties
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(20, rows[3][1]), (20, rows[20][1])]
    rows += [(300, None), (320, [0.0] * 6), (340, [math.nan] * 6), (360, []), (380, [None] + [1.0] * 5), (400, [1.0, 2.0]), (420, [3.0, 1.0]), (440, [math.inf] * 6), (None, rows[1][1]), (460, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("row", "list", "query", "norm", "id", "vec")}).repartition(4)
    got = neighbours.nearest(df, F.col("id") % 20 == 0, k=20, ratio=1e9, block=block)
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    flat = sorted((q, rank, i, round(s, 9)) for q, lists in want.items() for own in lists for rank, (i, s) in enumerate(own, 1))
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == flat
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    calibrated = neighbours.nearest(df, F.col("id") % 20 == 0, k=20, rows_per_list=16)
    assert {r["query_id"] for r in calibrated.collect()} == {q for q, lists in want.items() if any(lists)}
