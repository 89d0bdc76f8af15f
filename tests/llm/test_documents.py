"""Operators on documents: edge cases, brute force, SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import fingerprint, line_dedup, mixing, near_dup, packing, registry, substring_dedup, toxicity
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, PASSAGE), (5, "head words here " + PASSAGE + " tail words here"), (6, PASSAGE), (6, PASSAGE),
    (7, LONG), (8, "Nd, " * 300), (9, "A line that repeats\n  a LINE that repeats \nother line of text\nshort"), (10, "a line that repeats\nshort\n\nother line of text"),
    (None, "a text without an id " + PASSAGE), (11, "One two three four five six seven eight nine ten"), (12, "one two three four five six seven eight nine TEN"),
    (13, "one two three four five six seven eight nine eleven"), (14, "one two THREE"), (15, "É à ñ 中文 字 \x00 \x1c end"),
]
CLASH = ["bucket", "size", "pos", "key", "words", "row", "hash", "start", "line", "rank", "n", "h1", "th", "copies", "cls"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 2}" if k % 5 else None, "en", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_mixing", "op8_near_dup", "op10_line_dedup"])
def test_query_and_sql_agree(agree, name):
    assert agree(name, registry.queries()[name], registry.oracle_sql()[name])


def brute_kept(texts, window):
    seqs = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in seqs for i in range(len(w) - window + 1))
    out = []
    for w in seqs:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(spark, docs, hot):
    marks = substring_dedup.repeated_windows(docs, hot=hot, shard_words=3000)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove(docs, marks).collect())
    want = sorted((i is not None, i, *k) for (i, _), k in zip(TEXTS, brute_kept([t for _, t in TEXTS], 35)))
    assert got == want


def test_hot_windows_are_indexed_once(spark, monkeypatch):
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = [" ".join(f"a{d}x{i}" for i in range(20)) + f" {passage} " + " ".join(f"b{d}x{i}" for i in range(20)) for d in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, search = [], substring_dedup.search

    def watched(shards, window):
        seen.extend(bytes(r["words"]) for r in shards.select("words").collect())
        return search(shards, window)

    monkeypatch.setattr(substring_dedup, "search", watched)
    got = [(r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove(df, substring_dedup.repeated_windows(df, hot=50)).orderBy("doc_id").collect()]
    assert got == brute_kept(texts, 35) and all(g[1] == 40 for g in got)
    inside = [x for x in seen if x.decode() in passage]
    assert len(inside) == len(set(inside)) == 6


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_random_words(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        parts = [rng.choices("abc", k=rng.randint(0, 30))]
        if texts and rng.random() < 0.7:
            w = words(rng.choice(texts))
            if w:
                at = rng.randrange(len(w))
                parts.append(w[at : at + rng.randint(5, 40)])
        parts.append(rng.choices("abcdefgh", k=rng.randint(0, 20)))
        texts.append(" ".join(x for p in parts for x in p))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove(df, substring_dedup.repeated_windows(df, window=9, k=3, hot=20, shard_words=200), 9).orderBy("doc_id").collect()]
    assert got == brute_kept(texts, 9)


def test_line_dedup(docs):
    got = {r["row"]["doc_id"]: r for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert got[9]["kept"][:2] == ["A line that repeats", "  a LINE that repeats "] and got[9]["n_lines"] == 4
    assert got[10]["kept"] == ["short", ""]
    assert got[0]["kept"] == [""] and got[1]["n_lines"] == 1 and got[6]["kept"] == []
    assert got[4]["kept"] == [PASSAGE] and got[10]["row"]["bucket"] == "clash"


def test_line_dedup_of_long_documents(spark):
    lines = [f"line number {i:05d}" for i in range(1000)]
    df = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join(lines[::3]))], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["kept"] for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert got[1] == lines[::3] and got[2] == [x for i, x in enumerate(lines) if i % 3]


def test_line_dedup_of_shared_ids_and_long_blanks(spark):
    blanks = "x" + " " * 100_000 + "y"
    df = spark.createDataFrame([(7, "an old line here\nfirst line of seven"), (7, "second line of seven\nan old line here"), (3, "an old line here\n" + blanks), (9, "\t" + blanks + "\r")], "doc_id long, text string")
    got = sorted((r["row"]["doc_id"], r["kept"]) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect())
    assert got == [(3, ["an old line here", blanks]), (7, ["first line of seven"]), (7, ["second line of seven"]), (9, [])]


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    sets = {i: shingles(t) for i, t in TEXTS if i is not None}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = union_find(max(ids) + 1, links)
    for i in ids:
        smallest = min(j for j in ids if comp[j] == comp[i])
        assert got[i, len(sets[i])] == (smallest, i == smallest), i
    assert got[None, len(shingles(TEXTS[12][1]))] == (None, True)


def test_near_duplicates_of_many_edits_and_small_blocks(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    comp = union_find(150, [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    want = [min(j for j in range(150) if comp[j] == comp[i]) for i in range(150)]
    got = [r["component_id"] for r in near_dup.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == want and 1 < len(set(want)) < 150
    every = near_dup.sketches(df).selectExpr("doc_id as node", "keys", "odd", "n_shingles")
    assert near_dup.candidate_links(every, block=16).count() > 0
    every = df.selectExpr("0L as cluster", "doc_id as node", "text", "100 as n_shingles")
    links = near_dup.exact_links(every.drop("n_shingles"), every.drop("text"), block=16)
    again = union_find(150, [(r["a"], r["b"]) for r in links.collect()])
    assert [min(j for j in range(150) if again[j] == again[i]) for i in range(150)] == want


def test_candidates_of_large_buckets_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n, changed in ((300, 18), (70, 12), (2, 0), (45, None)):  # groups of near sketches, a pair, and sketches near to none
        base = rng.integers(0, near_dup.ODD_BITS, 120)
        for _ in range(n):
            own = rng.integers(0, near_dup.ODD_BITS, 120) if changed is None else base.copy()
            at = rng.choice(120, changed or 0, replace=False)
            own[at] = rng.integers(0, near_dup.ODD_BITS, len(at))
            bits = np.zeros(near_dup.ODD_BITS, np.uint8)
            np.bitwise_xor.at(bits, own, 1)
            rows.append(np.packbits(bits).tobytes())
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    sets = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    near = np.array([near_dup.estimates(sets[i], sets, 120) >= 0.5 for i in range(len(rows))])
    want = union_find(len(rows), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    classes = spark.createDataFrame([(i, [1, 2 + i % 2], r) for i, r in enumerate(rows)], "node long, keys array<long>, odd binary")
    links = [(r["a"], r["b"]) for r in near_dup.candidate_links(classes).collect()]
    assert all(want[a] == want[b] for a, b in links)
    got = union_find(len(rows), links)
    first = lambda comp: [comp.index(c) for c in comp]
    assert first(list(got)) == first(list(want))
    assert len(set(got)) > 40


def test_candidate_links_over_bands_are_few_and_connect_all(spark):
    rng = np.random.default_rng(8)
    n, bands = 400, 6
    keys = rng.integers(0, 3, (n, bands))  # buckets of about 130, compared in pairs of blocks
    keys[:40] += 10 + rng.integers(0, 30, (40, bands))  # and small ones, pairs among them
    base = rng.integers(0, near_dup.ODD_BITS, (4, 24))  # four groups of near sketches
    rows = []
    for i in range(n):
        own = base[i % 4].copy()
        own[rng.choice(24, 2, replace=False)] = rng.integers(0, near_dup.ODD_BITS, 2)
        bits = np.zeros(near_dup.ODD_BITS, np.uint8)
        np.bitwise_xor.at(bits, own, 1)
        rows.append(np.packbits(bits).tobytes())
    sets = np.frombuffer(b"".join(rows), np.uint64).reshape(n, -1)
    near = np.array([near_dup.estimates(sets[i], sets, bands * 4) >= 0.5 for i in range(n)])
    share = (keys[:, None] == keys[None]).any(-1)
    want = union_find(n, [(int(a), int(b)) for a, b in np.argwhere(near & share) if a < b])
    classes = spark.createDataFrame([(i, [int(x) for x in keys[i]], rows[i]) for i in range(n)], "node long, keys array<long>, odd binary")
    links = [(r["a"], r["b"]) for r in near_dup.candidate_links(classes, bands=bands, block=32).collect()]
    assert all(near[a, b] and share[a, b] for a, b in links)
    assert len({frozenset(x) for x in links}) == len(links) < (near & share).sum() / 10  # that sum counts each pair twice
    got = union_find(n, links)
    first = lambda comp: [comp.index(c) for c in comp]
    assert first(list(got)) == first(list(want)) and 4 <= len(set(got)) < n


def test_near_duplicates_of_shared_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    df = spark.createDataFrame([(1, one), (3, two), (7, one + " end"), (7, two + " end"), (7, None), (5, three), (5, three), (5, "other words of five here alone"), (None, one)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(0, 36, None, True), (1, 36, 1, True), (3, 36, 1, False), (5, 2, 5, True), (5, 36, 5, True), (5, 36, 5, True), (7, 0, 1, False), (7, 37, 1, False), (7, 37, 1, False)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.without_near_duplicates(df.withColumn("row", F.lit("clash"))).collect())
    assert kept == sorted([(0, one), (1, one), (3, two), (5, three), (5, "other words of five here alone"), (7, "")])


def test_mixing(docs):
    m = mixing.mix(docs).collect()
    per = {}
    for r in m:
        p = per.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        p[1] += r["copies"] * r["size"]
        assert r["copies"] <= 2
    assert abs(sum(p[0] for p in per.values()) - 1.5 * sum(p[2] for p in per.values())) < 1e-6
    assert all(p[0] <= 2 * p[2] + 1e-9 for p in per.values())
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in m) == Counter((r["doc_id"], r["copies"]) for r in again)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in m)


def test_mixing_comes_near_its_targets(spark):
    m = registry.queries()["op4_mixing"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in m.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= max(0.05 * r["target"], r["most"])


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    bins, of = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
        if i != 6:
            assert sorted(of[i]) == want, i
        else:
            assert sorted(of[i]) == sorted(want * 2)
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 2048)


def test_packing_plans_are_valid_and_tight():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 2048): rng.randint(1, 300) for _ in range(rng.randint(1, 300))}
        for groups, part in ((24, 2), (20, 4)):
            n, runs = packing._plan(dict(counts), 2048, groups, 2048 // part)
            room, used = {}, {}
            for length, rank, m, each, first, offset in runs:
                for i in range(m):
                    room.setdefault(first + i // each, []).append((offset + i % each * length, length))
                    used.setdefault(length, set()).add(rank + i)
            assert {k: len(v) for k, v in used.items()} == counts and len(room) == n
            for v in room.values():
                at = 0
                for offset, length in sorted(v):
                    assert offset == at
                    at += length
                assert at <= 2048
        best = packing.plan(counts)[0]
        bound = max(-(-sum(k * v for k, v in counts.items()) // 2048), sum(v for k, v in counts.items() if k > 1024))
        assert best <= 1.23 * bound + 1


def test_packed_sequences(spark, docs):
    cut = packing.pieces(docs.filter("doc_id in (3, 4, 5)"), with_ids=True)
    packed = packing.pack(cut)
    s = packing.sequences(packed).collect()
    assert len(s) == 1 and len(s[0]["ids"]) == packed.agg(F.sum("length")).first()[0]


def test_fingerprints(spark, docs):
    d = docs.filter("doc_id is not null and doc_id <> 6")
    rows = {r["doc_id"]: r for r in fingerprint.with_next(d, ranges=5).collect()}
    ids = sorted(rows)
    texts = dict(TEXTS)
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        assert rows[i]["next_text"] == texts[j], i
    a = [f"paragraph {i}" for i in range(200)]
    pairs = [("\n".join(a), "\n".join(a[:150])), ("\n".join(a), "\n".join(a)), ("", ""), ("x", ""), ("\n".join(a), "\n".join(f"q{i}" for i in range(90)))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string")
    df = df.select("i", fingerprint.digests(F.col("l")).alias("own"), fingerprint.digests(F.col("r")).alias("other"))
    got = fingerprint.differing(df, "own", {"d": "other"}).orderBy("i").collect()
    for r in got:
        assert sorted(r["d"]) == sorted(set(r["own"]) ^ set(r["other"])), r["i"]
    assert got[1]["d"] == [] and len(got[0]["d"]) == 50


def test_fingerprints_of_long_texts_that_differ_much(spark):
    import time

    def run(n):
        a, b = [f"line {i}" for i in range(n)], [f"line {i}" for i in range(n // 2, n + n // 2)]
        df = spark.createDataFrame([(1, "\n".join(a), "\n".join(b)), (2, "x", "y")], "i int, l string, r string")
        df = df.select("i", fingerprint.digests(F.col("l")).alias("own"), fingerprint.digests(F.col("r")).alias("other"))
        began = time.time()
        got = {r["i"]: r for r in fingerprint.differing(df, "own", {"d": "other"}).collect()}
        for r in got.values():
            assert sorted(r["d"]) == sorted(set(r["own"]) ^ set(r["other"]))
        assert len(got) == 2 and len(got[1]["d"]) == 2 * (n // 2) + 2  # the beginnings differ too
        return time.time() - began

    run(300)
    assert run(16_000) < 4 * run(4_000) + 5
    empty = spark.createDataFrame([], "i int, own array<long>, other array<long>")
    assert fingerprint.differing(empty, "own", {"d": "other"}).count() == 0


def cut_by_content(text, words):
    """Runs of words, each with the white space behind it, that end where a word's hash is divisible by ``words``."""
    import xxhash

    out, run = [], ""
    for token in re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", text):
        run += token
        h = xxhash.xxh64(token.encode(), seed=42).intdigest()
        if words == 1 or (h - (1 << 64) if h >> 63 else h) % words == 0:
            out, run = [*out, run], ""
    return [*out, run] if run else out


def parts_of(text):
    """The paragraphs of a text: lines, those of 512 characters or more cut by content to 64 words on average; up to 1,024
    characters by content to 8 words, up to 256 to single words; those of both sides within a factor of 1.25 of a limit; and the first 64 characters."""
    text = text or ""
    n, out = len(text), set()
    if n > 128:
        out.add("head:" + text[:64])
    if 0 < n <= 256 * 1.25:
        out.update("1:" + p for p in cut_by_content(text, 1))
    if 256 / 1.25 < n <= 1024 * 1.25:
        out.update("8:" + p for p in cut_by_content(text, 8))
    if n > 1024 / 1.25:
        for line in text.split("\n"):
            out.update([line] if len(line) < 512 else cut_by_content(line, 64))
    return out


def test_fingerprint_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in registry.queries()["op6_fingerprint"](spark, DATA).collect()}
    assert len(got) == len(docs)
    by_print, higher, whole = {}, 0, 0
    for k, d in enumerate(docs):
        n = len(d["text"])
        edited = d["text"][: n - n // 2] + docs[(k + 1) % len(docs)]["text"][: n // 2]
        r = got[d["doc_id"]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [parts_of(t) for t in (d["text"], edited, docs[(k + 1) % len(docs)]["text"])]
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert abs(r[name] - (len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1)) < 1e-9
        if n >= 50 and edited != d["text"]:
            assert r["near_edited"] > 0
            higher += r["near_edited"] > r["near_next"]
            whole += 1
        by_print.setdefault(d["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_print.values())
    assert sum(r["near_edited"] for r in got.values()) > 5 * sum(r["near_next"] for r in got.values()) and higher >= 0.99 * whole > 100


def test_short_and_shifted_texts_keep_a_likeness(spark):
    words = "the quick brown fox jumps over the lazy dog while seven grey geese watch from a low stone wall near the river".split()
    one = " ".join(words)
    long = " ".join(f"{w}{i}" for i in range(40) for w in words)
    pairs = [(one, one[: len(one) // 2] + "x" * 50), (long, "a " + long), (long[:1000], long[:1100]), (one, "nothing in common at all between these")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string")
    got = [r["like"] for r in df.select("i", fingerprint.digests(F.col("l")).alias("a"), fingerprint.digests(F.col("r")).alias("b")).select("i", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("like")).orderBy("i").collect()]
    assert got[0] > 0.2 and got[1] > 0.7 and got[2] > 0.5 and got[3] < 0.15, got


def test_restored_words():
    import numpy as np

    counts = np.zeros(28**3, np.int64)
    for w in "idiot stupid trash loser clown moron scum pathetic people letter address".split():
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for x in zip(c, c[1:], c[2:]):
            counts[(x[0] * 28 + x[1]) * 28 + x[2]] += 50
    r = toxicity.Restorer(counts)
    for hidden, plain in {"1d10t": "idiot", "$tupid": "stupid", "tr@sh": "trash", "l.o.s.e.r": "loser", "clooown": "clown", "m0-r0-n": "moron", "people": "people", "address": "address", "the&&&": "the"}.items():
        assert r.words(hidden) == [plain], hidden
    assert r.words("2024") == [] and r.words("") == []
    assert "i·d·i·o·t" in toxicity.tokens("you i d i o t !")


def test_long_tokens_are_restored():
    import numpy as np

    plain = "people letter address idiot stupid trash loser clown moron".split()
    counts = np.zeros(28**3, np.int64)
    for w in plain:
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for x in zip(c, c[1:], c[2:]):
            counts[(x[0] * 28 + x[1]) * 28 + x[2]] += 50
    of = toxicity.Featurizer(counts)
    assert {"stupid", "moron", "people"} <= of("  ".join(" ".join(w) for w in plain))
    assert of("st" + "u" * 100 + "pid") >= {"stupid"} and of("l" + "." * 70 + "oser") >= {"loser"}
    assert all(len(t) <= toxicity.PIECE for t in of.store)
    r = of.restorer
    assert r.restore("1d10t-" * 400).replace(" ", "") == "idiot" * 400


def test_toxicity_on_held_out_labels(spark):
    got = registry.queries()["op7_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    p, q = m.score[m.toxic == 1].to_numpy(), m.score[m.toxic == 0].to_numpy()
    auc = ((p[:, None] > q[None]).mean() + 0.5 * (p[:, None] == q[None]).mean())
    assert auc > 0.85 and (q >= 0.3).mean() < 0.05


def test_viterbi_finds_the_cheapest_path():
    """Every path through short lattices, priced one by one."""
    import itertools

    g = random.Random(3)
    words = [g.choice(["stupid", "idiot", "house", "garden", "moron", "letter"]) for _ in range(3000)]
    counts = np.zeros(toxicity.N**3, np.int64)
    c = toxicity.letter_class(np.array([ord(x) for x in "  " + " ".join(words) + " "]))
    np.add.at(counts, (c[:-2] * toxicity.N + c[1:-1]) * toxicity.N + c[2:], 1)
    r = toxicity.Restorer(counts)
    for word in ("stup1d", "1d10t", "m.o.r.o.n", "stuuupid", "h0use", "g@rd3n", "l3tt3r", "a1", "x--y", "sstt"):
        best = None
        for ways in itertools.product(*r.lattice(word)):
            text, total, x, y = "", 0.0, 0, 0
            for way, price in ways:
                total += price
                for ch in way:
                    z = r.code(ch)
                    total, x, y = total + r.cost[x][y][z], y, z
                text += way
            total += r.cost[x][y][0]
            best = min(best or (math.inf, ""), (total, text))
        got = r.restore(word)
        assert got == best[1] or abs(priced(r, word, got) - best[0]) < 1e-9, (word, got, best)
    assert r.restore("stup1d") == "stupid" and r.restore("1d10t") == "idiot" and r.restore("m.o.r.o.n") == "moron"


def priced(r, word, text):
    """The least cost of a path through the word's lattice that spells ``text``."""
    import itertools

    out = math.inf
    for ways in itertools.product(*r.lattice(word)):
        if "".join(w for w, _ in ways) == text:
            total, x, y = sum(p for _, p in ways), 0, 0
            for ch in text:
                z = r.code(ch)
                total, x, y = total + r.cost[x][y][z], y, z
            out = min(out, total + r.cost[x][y][0])
    return out


def test_decoding_finds_planted_disguises(spark):
    """Toxic words in plain letters are learnt; held-out texts hold them disguised. With and without the decode."""
    g = random.Random(4)
    plain = ["".join(g.choice("bcdfglmnprst") + g.choice("aeiou") for _ in range(g.randint(2, 4))) for _ in range(300)]
    bad = ["dunderhead", "nincompoop", "blockhead", "simpleton", "halfwit"]
    disguise = [lambda w: w.replace("e", "3").replace("o", "0").replace("i", "1"), lambda w: ".".join(w), lambda w: w[:2] + w[2] * 4 + w[3:], lambda w: " ".join(w), lambda w: w.replace("a", "@").replace("l", "|")]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [g.choice(plain) for _ in range(40)]
        if toxic:
            for _ in range(2):
                w = g.choice(bad)
                words[g.randrange(40)] = g.choice(disguise)(w) if held(i) else w
        else:
            words[g.randrange(40)] = g.choice(disguise)(g.choice(plain))  # clean texts have odd tokens too
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    with_it, without = toxicity.Featurizer(model.counts, model.vocabulary), toxicity.Featurizer(model.counts, model.vocabulary)
    without.restorer.words = toxicity.LETTERS.findall
    share = lambda of, want: np.mean([1 / (1 + math.exp(-model.logit(of(t)))) >= 0.3 for (i, t), (_, y) in zip(rows, labels) if held(i) and y == want])
    assert share(with_it, 1) > 0.9 and share(without, 1) < 0.7 and share(with_it, 0) < 0.05, [share(o, y) for o in (with_it, without) for y in (0, 1)]
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).select("row.doc_id", "toxic_score").collect()}
    for i, text in rows[:200]:  # the score, term by term
        names = {f for t in toxicity.tokens(text) for f in toxicity.features(with_it.restorer.words(t))} & set(model.vocabulary)
        at = [model.vocabulary.index(f) for f in names]
        z = model.intercept + sum(model.weights[k] for k in at) + (model.lead * max(model.strength[k] for k in at) if at else 0)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_edges(spark, docs):
    docs = docs.withColumns({"toxic_score": F.lit("clash"), "row": F.lit(1)})
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert all(r["toxic_score"] < 1e-6 for r in toxicity.score(docs, toxicity.learn(docs, none)).collect())
    assert toxicity.score(docs, toxicity.learn(docs, one)).count() == len(TEXTS)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert substring_dedup.remove(none, substring_dedup.repeated_windows(none)).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert fingerprint.with_next(none).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "near_dup", "mixing", "packing"]
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert docs.columns == before.columns, name
        if name == "line_dedup":
            want = before.count()
            assert docs.count() == want and docs.filter("n_chars <> char_length(text)").count() == before.filter("n_chars <> char_length(text)").count()
        if name == "near_dup":
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
            again = near_dup.near_duplicates(docs)
            assert again.filter("not kept").count() == 0
    last = c.STAGES[-1][1](spark, docs, DATA)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


ROWS = [
    (1, "One line that is here twice\nfirst words of the document"), (2, "one LINE that is here twice\nsecond words of the document"), (3, None), (4, ""),
    (7, " ".join(f"x{i}" for i in range(50))), (7, " ".join(f"y{i}" for i in range(50))), (8, " ".join(f"x{i}" for i in range(50)) + " more"),
    (9, " ".join(f"y{i}" for i in range(50))), (None, " ".join(f"x{i}" for i in range(50))),
]


def test_pipeline_stages_against_brute_force(spark):
    """Rows that share an id, null texts and ids, extra columns with the names that stages use inside."""
    import corpus_pipeline as c

    df = spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in ROWS], "doc_id long, text string, source string, lang string, n_chars long")
    df = df.withColumns({x: F.lit("clash") for x in ("kept", "n_lines", "row", "toxic_score", "words", "component", "n", "th", "copies")})
    stages = dict(c.STAGES)
    texts = lambda d: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in d.collect())
    same = lambda rows: sorted((i is not None, i or 0, t or "") for i, t in rows)
    clean = stages["toxicity"](spark, df, DATA)
    assert texts(clean) == same(ROWS) and clean.columns == df.columns
    lines = stages["line_dedup"](spark, clean, DATA)
    want, seen = [], {}
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").lower()
            if len(key) < 10 or seen.setdefault(key, i) == i:
                kept.append(line)
        want.append((i, "\n".join(kept)))
    assert texts(lines) == same(want) and lines.filter("text is not null and n_chars <> char_length(text)").count() == 0
    near = stages["near_dup"](spark, clean, DATA)
    assert texts(near) == same([r for r in ROWS if r[0] not in (8, 9)])
    mixed = stages["mixing"](spark, near, DATA)
    taken = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    words_of = sum(len(words(t)) * n for (_, t), n in taken.items())
    size = sum(len(words(r["text"])) for r in near.collect())
    assert mixed.columns == df.columns and set(taken) <= {(r["doc_id"], r["text"]) for r in near.collect()} and max(taken.values()) <= 2
    assert abs(words_of - 1.5 * size) <= max(len(words(t)) for _, t in ROWS)
    packed = stages["packing"](spark, mixed, DATA)
    assert packed.count() == sum(taken.values())
    empty = df.limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
