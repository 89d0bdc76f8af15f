"""Target-distribution importance resampling on hashed word n-grams.

A feature is a run of 1 or 2 words joined by one space; its bucket is the CRC-32 of its bytes modulo ``buckets``. A
document's weight is the mean log ratio of its buckets' shares in the target texts and in all documents; a Gumbel
number by hash of the document is added, and the highest scores are drawn, which samples without replacement in
proportion to exp(weight).

CRCs: the distinct features of a batch of texts are grouped by length into two-dimensional uint8 arrays, a row a
feature; all CRCs of an array are updated together, column by column, and go back to the places of the features.
Features of over ``WIDE`` bytes, which are few and would make as many steps as they have bytes, are taken one by one.

How it scales. Two passes over the texts, both without a shuffle of texts or features: the first adds up counts by
bucket inside each task (at most ``buckets`` rows leave it), the second needs the table of gains, ``buckets`` numbers
whatever the input, and returns four numbers a document. Texts are worked on in pieces of bounded size, cut between
words. Ranks come from counts by score: scores are whole numbers within some 10^5 values, so the running sum sees that
many rows at most, and the Gumbel number spreads documents of equal weight over thousands of scores.

Defined cases: null or wordless text has no feature and weight 0; documents of fewer than ``least_words`` words are
never drawn; a null doc_id is hashed as the empty text and comes last among ties; rows that share a doc_id are ranked
each for itself, ties by n_features; an empty table of documents gives an empty result; an empty target has T = 0 and
all its counts 0; other columns are left out of the work.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import arrow_rows, read, staged

#: Bytes of words as they are, A-Z lower-cased; all else to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Features longer than this are not put into an array.
WIDE = 128
#: Bytes of text worked on at a time.
PIECE = 2_000_000


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_TABLE = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional uint8 array, all updated column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_of_words(words: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of the features ``words[first]``, or ``words[first] + b' ' + words[second]`` where second is not -1."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)  # every word has a space behind it
    two = second >= 0
    head = size[first]
    length = head + np.where(two, 1 + size[second], 0)
    out = np.empty(len(first), np.uint32)
    order = np.argsort(length, kind="stable")
    lengths, cut = np.unique(length[order], return_index=True)
    for n, at in zip(lengths.tolist(), np.split(order, cut[1:])):
        if n > WIDE:
            out[at] = [zlib.crc32(words[i] if j < 0 else words[i] + b" " + words[j]) for i, j in zip(first[at].tolist(), second[at].tolist())]
            continue
        place = np.arange(n)
        from_first = begin[first[at], None] + place
        from_second = (begin[second[at]] - head[at] - 1)[:, None] + place
        out[at] = crc_matrix(data[np.where(place <= head[at, None], from_first, from_second)])
    return out


def _pieces(texts: list[bytes | None]):
    """Lists of (number of the text, its words, whether the first is only carried over from the piece before), of bounded size."""
    found, load = [], 0
    for d, text in enumerate(texts):
        data, at, carried = (text or b"").translate(WORD_BYTES), 0, None
        while at < len(data):
            end = min(len(data), at + PIECE - load)
            if end < len(data):
                end = data.rfind(b" ", at, end) + 1 or (data.find(b" ", end) + 1 or len(data))  # a word is never cut
            words = data[at:end].split()
            if words:
                found.append((d, [carried, *words] if carried else words, bool(carried)))
                carried = words[-1]
            load, at = load + end - at, end
            if load >= PIECE or at < len(data):  # a text has one entry in a piece
                yield found
                found, load = [], 0
    if found:
        yield found


def features(texts: list[bytes | None], buckets: int):
    """(number of the text, bucket, words) of the features of texts: arrays, a piece at a time; words[d] is text d's number of words in the piece."""
    for piece in _pieces(texts):
        every = [w for _, words, _ in piece for w in words]
        distinct = list(dict.fromkeys(every))
        number = dict(zip(distinct, range(len(distinct))))
        ids = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        counts = np.array([len(words) for _, words, _ in piece])
        doc = np.repeat(np.array([d for d, _, _ in piece]), counts)
        new = np.ones(len(ids), bool)
        new[(np.cumsum(counts) - counts)[[c for _, _, c in piece]]] = False
        same = np.flatnonzero(doc[1:] == doc[:-1])
        pairs, where = np.unique(ids[same] * len(distinct) + ids[same + 1], return_inverse=True)
        one = np.arange(len(distinct))
        crc = crc_of_words(distinct, np.concatenate([one, pairs // len(distinct)]), np.concatenate([np.full(len(one), -1), pairs % len(distinct)]))
        bucket = (crc % np.uint32(buckets)).astype(np.int64)
        yield (np.concatenate([doc[new], doc[same]]), np.concatenate([bucket[ids[new]], bucket[len(one) + where]]), np.bincount(doc[new], minlength=len(texts)))


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over the features of all texts."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0).to_pylist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(column).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket. Gathers one row a bucket, ``buckets`` at most, from either table."""

    def counted(t: DataFrame) -> np.ndarray:
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(t, buckets=buckets).collect():
            n[r["bucket"]] = r["n"]
        return n

    s, t = counted(docs).tolist(), counted(target).tolist()
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of (doc_id, text)."""
    buckets, schema = len(gains), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def run(batches):
        for b in batches:
            n = b.num_rows
            words, number, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, bucket, w in features(b.column(1).to_pylist(), buckets):
                words += w
                number += np.bincount(doc, minlength=n)
                total += np.rint(np.bincount(doc, weights=gains[bucket].astype(np.float64), minlength=n)).astype(np.int64)  # whole numbers under 2^53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(number), pa.array(total // np.maximum(number, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def with_rank(rows: DataFrame, drawn: int) -> DataFrame:
    """Adds ``rank``: 1.. for the ``drawn`` highest scores of the rows where ``may`` holds, ties to the smaller doc_id, else null. Read twice."""
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a score: some 10^5 at most
    by_score = rows.filter("may").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = by_score.select("score", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above")).filter(F.col("above") < drawn)
    above = staged(above, "importance-scores")
    cut = above.agg(F.min("score")).first()[0]
    never = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.select("*", never)
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    high = F.col("may") & (F.col("score") >= cut)
    best = rows.filter(high).join(above, "score").withColumn("rank", F.col("above") + F.row_number().over(inside))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")
    return best.unionByName(rows.filter(~high).select("*", never))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: str = "7") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text); rank is null where it is not drawn. ``target``: text."""
    with arrow_rows(docs.sparkSession, 2000):
        gains = bucket_gains(docs.select("text"), target.select("text"), buckets)
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
        rows = weigh(docs, gains).withColumns({"score": F.col("weight") + gumbel, "may": F.col("n_words") >= least_words})
        rows = staged(rows, "importance-rows")
    number = rows.filter("may").count()
    return with_rank(rows, percent * number // 100).drop("may")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns; doc_id has to tell its rows apart."""
    drawn = resample(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(drawn, docs["doc_id"] == F.col("__drawn"), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
