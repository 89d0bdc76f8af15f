"""Line dedup on whole tables, in DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Of every key of at least
``min_chars`` code points all lines go but those of the smallest document that holds it. The operator returns, for
each document, a compressed bitmap of the lines to keep; ``apply_bitmaps`` turns bitmaps into text where one wants it.

How it scales. One pass over the texts writes (hash, document, text, position) of each line; both the ordering and the
marking read that narrow table. Each map task first reduces its lines to one row for a hash and salt (``salts`` of
them, by document), so that a line that a third of all documents hold reaches the ordering step as at most ``salts``
rows. That step range-partitions by hash, sorts by document and position within a hash, and streams the first
occurrence. Keys held by one document end there.

Defined cases: a null or empty text is one empty line; an empty table gives an empty result; rows that share a doc_id
count as one document when keys are compared, and each has a bitmap of its own text (``th`` tells them apart); a null
doc_id is a document of its own kind, ordered before all others; other columns are left out of the work, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import ascii_lower, partitions, read, staged

SPACES = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of each line whose key is long enough; h1 and h2 are 128 bits of the key, th is a hash of the text."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(split).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "doc_id", "th", "pos")


def first_occurrences(hashed: DataFrame, salts: int = 16) -> DataFrame:
    """(h1, h2, first_doc, first_pos) of the keys that two documents or more hold."""
    has_null = F.max(F.col("doc_id").isNull())
    local = hashed.groupBy("h1", "h2", F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), has_null.alias("none"),
        F.min_by("pos", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).alias("pos"))
    ranged = local.repartitionByRange(partitions(hashed.sparkSession), "h1", "h2")
    first = F.when(~F.col("none"), F.col("low"))
    by_place = Window.partitionBy("h1", "h2").orderBy(first.asc_nulls_first(), "pos")
    key_rows = Window.partitionBy("h1", "h2")
    return (
        ranged.withColumn("n", F.row_number().over(by_place)).withColumn("last", F.max("high").over(key_rows))
        .filter((F.col("n") == 1) & ~first.eqNullSafe(F.col("last")))
        .select("h1", "h2", first.alias("first_doc"), F.col("pos").alias("first_pos"))
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int = 16) -> DataFrame:
    """For each row with dropped lines, by (doc_id, th): ``words``, a map from position div 64 to the 64 bits of dropped lines.

    Blocks of 64 lines that stay whole have no entry: that is the compression. A line is kept if its bit is 0.
    """
    hashed = staged(line_hashes(docs, min_chars), "line-hashes")
    dropped = hashed.join(first_occurrences(hashed, salts), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    word = (F.col("pos") / 64).cast("int").alias("word")
    bits = dropped.groupBy("doc_id", "th", word).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_lines(text: Column, words: Column) -> Column:
    """The lines whose bit is 0, as an array."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    keep = F.filter(lines, lambda _, i: F.getbit(F.coalesce(F.try_element_at(words, (i / 64).cast("int")), F.lit(0).cast("long")), i % 64) == 0)
    return F.when(words.isNull(), lines).otherwise(keep)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` as a struct ``row`` with ``kept`` (array of lines) and ``n_lines``: no input column can clash."""
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "words")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__own"))
    joined = rows.join(marks, (F.col("__own") == F.col("__th")) & F.col("__id").eqNullSafe(F.col("__doc")), "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    return joined.select("row", kept_lines(F.col("row.text"), F.col("words")).alias("kept"), F.size(lines).cast("long").alias("n_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select(
        "row.doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
