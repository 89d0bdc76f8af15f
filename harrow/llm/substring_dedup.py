"""Substring dedup: words covered by a window of ``window`` words whose sequence also starts anywhere else.

1. A pass over the texts cuts each document's windows into segments: runs of consecutive windows with the same anchor
   occurrence, the first k-gram of least hash in the window. Equal windows have equal anchors wherever they stand. Only hashes leave
   this pass (anchor, digest of the segment's words, place).
2. Anchors that occur once cannot hold a repeated window; that ends most segments by counting hashes. Of the others,
   segments with equal words are represented by one, with its number of copies.
3. The words of those representatives are fetched and dealt to shards by anchor. An anchor whose distinct segments hold
   more than ``hot`` words, a quarter of a shard by default, would make a hot shard: its segments are cut into single
   windows, equal ones are merged by digest, with their copies added up before the shuffle, and one representative each is
   dealt by window hash; its decision is joined back to all of them. So every pair of equal windows meets in one shard, and
   no shard grows with a passage's popularity. Occurrences alone do not make an anchor hot: copies are one segment.
4. Each shard builds a compressed FM-index (wavelet tree) of its segments and streams them through it: backward search
   with parent intervals gives matching statistics, and windows with a match of ``window`` words in two places or more
   are repeated. All decisions come from here.
5. Decisions go back to all copies of a segment as 64-bit maps, are gathered by document, and the words go.

Defined cases: null and empty texts have no words; documents shorter than the window lose nothing; rows that repeat
another row whole are repeats of each other; null doc_ids are allowed; other columns are left out of the work.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.fm_index import FMIndex
from harrow.llm.shared import arrow_rows, read, staged
from harrow.llm.words import Words, chunks, mix, powers, sliding_argmin

MOST = 60  # windows of a segment: they fit the bits of a long
_B = 0xD1342543DE82EF95
_BASE, _INVERSE = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))


def segments(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """text, start (word in the text), windows, anchor and digest of each segment of the texts of ``words``."""
    n = len(words)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = words.runs(k)
    low = sliding_argmin(grams, window - k + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(np.arange(n) + window <= words.first[text + 1])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    anchor = low[at]  # the place, not the value: equal windows that follow each other have different ones
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[at[1:]] != text[at[:-1]])
    place = np.arange(len(at))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST == 0
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    start = at[begin]
    end = start + windows + window - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * powers(_BASE, n), dtype=np.uint64)])
    digest = mix((sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start] + windows.astype(np.uint64))
    return text[start], start - words.first[text[start]], windows, grams[anchor[begin]], digest


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def scan(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, th, start, windows, anchor, seg) of the segments; th tells rows of one doc_id apart."""

    def run(batches):
        for b in batches:
            texts, ids, th = b["text"].tolist(), b["doc_id"].astype("Int64"), b["th"].to_numpy()
            for lo, hi in chunks(texts):
                t, start, windows, anchor, seg = segments(Words(texts[lo:hi]), window, k)
                yield pd.DataFrame({"doc_id": ids.iloc[lo + t].array, "th": th[lo + t], "start": start.astype(np.int32), "windows": windows.astype(np.int32),
                                    "anchor": anchor.view(np.int64), "seg": seg.view(np.int64)})

    return _keyed(docs).mapInPandas(run, "doc_id long, th long, start int, windows int, anchor long, seg long")


def fetch(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, hot, copies, words) of the wanted segments."""

    def run(batches):
        for b in batches:
            out = []
            texts = b["text"].tolist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                for d in range(lo, hi):
                    base = w.first[d - lo]
                    for x in b["wanted"].iloc[d]:
                        i, j = base + x["start"], base + x["start"] + x["windows"] + window - 1
                        out.append((x["anchor"], x["seg"], x["hot"], x["copies"], w.text(i, j)))
            yield pd.DataFrame(out, columns=["anchor", "seg", "hot", "copies", "words"])

    return texts.mapInPandas(run, "anchor long, seg long, hot boolean, copies long, words binary")


def single_windows(segments: DataFrame, window: int) -> DataFrame:
    """(key, rest, anchor, seg, shift, copies) of each window of the segments; key and rest are the digest of its words."""

    def run(batches):
        for b in batches:
            out = []
            for anchor, seg, copies, text in zip(b["anchor"], b["seg"], b["copies"], b["words"]):
                words = text.split()
                for s in range(len(words) - window + 1):
                    key, rest = struct.unpack("<qq", hashlib.blake2b(b" ".join(words[s : s + window]), digest_size=16).digest())
                    out.append((key, rest, anchor, seg, s, copies))
            yield pd.DataFrame(out, columns=["key", "rest", "anchor", "seg", "shift", "copies"])

    return segments.select("anchor", "seg", "copies", "words").mapInPandas(run, "key long, rest long, anchor long, seg long, shift int, copies long")


def one_each(windows: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """(shard, anchor, seg, hot, copies, words): a representative of equal windows with all their copies; their digest stands for anchor and seg.

    Tasks add up their own windows before the shuffle. A window with one copy in all is left out.
    """
    most = windows.groupBy("key", "rest").agg(F.sum("copies").alias("n"), F.min(F.struct("anchor", "seg", "shift")).alias("x")).filter("n > 1")
    chosen = most.select("key", "rest", "n", "x.*").groupBy("anchor", "seg").agg(F.collect_list(F.struct("shift", "key", "rest", "n")).alias("chosen"))  # MOST at most

    def run(batches):
        for b in batches:
            out = []
            for text, chosen in zip(b["words"], b["chosen"]):
                words = text.split()
                out.extend((x["key"], x["key"], x["rest"], True, x["n"], b" ".join(words[x["shift"] : x["shift"] + window])) for x in chosen)
            yield pd.DataFrame(out, columns=["shard", "anchor", "seg", "hot", "copies", "words"])

    return segments.join(chosen, ["anchor", "seg"]).select("words", "chosen").mapInPandas(run, "shard long, anchor long, seg long, hot boolean, copies long, words binary")


def search(shards: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, hot, bits) of the repeated windows; one task is one shard."""

    def run(batches):
        frames = list(batches)
        if not frames:
            return
        g = pd.concat(frames, ignore_index=True)
        if not len(g):
            return
        w = Words([x.decode("utf-8", "replace") for x in g["words"]])
        size = np.diff(w.first)
        ids = np.unique(w.hash, return_inverse=True)[1].astype(np.int64) + 1
        first = w.first[:-1] + np.arange(len(g))  # one separator after each text
        tokens = np.zeros(len(ids) + len(g), np.int64)
        weight = np.zeros(len(tokens), np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(g)), size)
        tokens[place] = ids
        weight[place] = np.repeat(np.minimum(g["copies"].to_numpy(), 2), size)
        match = FMIndex(tokens, weight, window).matching_statistics(tokens, first, size)
        hit = np.flatnonzero(match >= window)
        row = np.searchsorted(first, hit, side="right") - 1
        bit = np.int64(1) << (hit - first[row])
        out = pd.DataFrame({"anchor": g["anchor"].to_numpy()[row], "seg": g["seg"].to_numpy()[row], "hot": g["hot"].to_numpy()[row], "bits": bit})
        yield out.groupby(["anchor", "seg", "hot"], as_index=False)["bits"].sum()

    return shards.mapInPandas(run, "anchor long, seg long, hot boolean, bits long")


def repeated_windows(docs: DataFrame, window: int = 35, k: int = 8, hot: int = 100_000, shard_words: int = 400_000) -> DataFrame:
    """(doc_id, th, marks): for each document with repeated windows, pairs (start, bits) of word positions."""
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        found = staged(scan(docs, window, k), "substring-segments")
        counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
        maybe = staged(found.join(counts, "anchor"), "substring-maybe")
        one = maybe.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "th", "start", "windows")).alias("x"), F.count(F.lit(1)).alias("copies"))
        one = staged(one.select("anchor", "seg", "copies", "x.*"), "substring-representatives")
        words = one.groupBy("anchor").agg(F.sum(F.col("windows") + window - 1).alias("n"))
        large = staged(words.filter(F.col("n") > hot).select("anchor", F.lit(True).alias("hot")), "substring-hot")  # all words / hot rows at most; Spark broadcasts it only if small
        one = one.join(large, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        total, n_hot = one.agg(F.sum(F.when(~F.col("hot"), F.col("windows") + window - 1)), F.count_if("hot")).first()
        wanted = one.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "seg", "copies", "hot")).alias("wanted"))
        d, w = _keyed(docs).alias("d"), wanted.alias("w")
        texts = d.join(w, (F.col("d.th") == F.col("w.th")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.text", "w.wanted")
        fetched, total = fetch(texts, window), total or 0
        if n_hot:
            fetched = staged(fetched, "substring-fetched")
        shards = fetched.filter("not hot").select(F.col("anchor").alias("shard"), "anchor", "seg", "hot", "copies", "words")
        with arrow_rows(spark, 5000):
            if n_hot:
                windows = staged(single_windows(fetched.filter("hot"), window), "substring-windows")
                singles = staged(one_each(windows, fetched.filter("hot"), window), "substring-singles")
                total += window * singles.count()
                shards = shards.unionByName(singles)
            bits = staged(search(shards.repartition(int(total // shard_words) + 1, "shard"), window), "substring-bits")
        found = bits.filter("not hot").select("anchor", "seg", "bits")
        if n_hot:
            again = bits.filter("hot").select(F.col("anchor").alias("key"), F.col("seg").alias("rest"))
            found = found.unionByName(windows.join(again, ["key", "rest"]).select("anchor", "seg", F.expr("shiftleft(1L, shift)").alias("bits")))
        bits = found.groupBy("anchor", "seg").agg(F.bit_or("bits").alias("bits"))
        marks = maybe.join(bits, ["anchor", "seg"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))
        return staged(marks, "substring-marks")


def covered(n: int, marks, window: int) -> np.ndarray:
    """Which of n words the marked windows cover."""
    step = np.zeros(n + 1, np.int64)
    if marks is not None and len(marks):
        start = np.array([m["start"] for m in marks], np.int64)
        bits = np.array([m["bits"] for m in marks], np.int64)
        row, shift = np.nonzero(bits[:, None] >> np.arange(MOST) & 1)
        at = start[row] + shift
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def remove(docs: DataFrame, marks: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the remaining words joined by one space."""

    def run(batches):
        for b in batches:
            out = []
            for doc, text, m in zip(b["doc_id"].astype("Int64"), b["text"], b["marks"]):
                words = (text or "").encode("utf-8", "replace").split()
                gone = covered(len(words), m, window)
                out.append((doc, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["kept"] = [k.decode() for k in frame["kept"]]
            yield frame

    d, m = _keyed(docs).alias("d"), marks.alias("m")
    joined = d.join(m, (F.col("d.th") == F.col("m.th")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select("d.doc_id", "d.text", "m.marks")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    with arrow_rows(spark, 500):
        kept = remove(docs, repeated_windows(docs))
        return staged(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "substring-result")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p
), r AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r
), n AS (
  SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(n.gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n.gone IS NULL THEN w.w ELSE list_filter(w.w, lambda x, j: NOT list_contains(n.gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""
