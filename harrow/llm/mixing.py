"""Mixing sources to target weights by systematic sampling.

Targets: the sources share ``share`` of all words by weight; none gets more than ``max_repeats`` times its own words,
and what it cannot take is shared again by weight among the others (water filling, closed form over sorted ratios).

Sampling: within a source a document's expected copies are target / source size, the same for all. Documents are
ranked by size class, then bucket, then size; the prefix sum of expected copies at rank r is r times the rate. One
offset in [0, 1) from a hash of seed and source is added, and a document is emitted once for each integer boundary that
its step crosses: floor(rate * rank + u) - floor(rate * (rank - 1) + u) copies, that is the rate rounded down or up.
Ranking by size makes each size class lose or gain less than one copy, so the words taken come near the target.

How it scales. No sort of a whole source: ranks come from counts by (source, size class, hash bucket) plus a row number
inside each such cell. The number of buckets grows with the rows, so that a hot source, or one hot size in it, is split
into cells of bounded size. Reruns agree: nothing is drawn, all is hashed.

Defined cases: null text has size 0; a null source is a source, last in order; an empty table gives an empty result;
rows that share a doc_id are ranked by size and a hash of the text and taken independently.
A source of size 0 has target 0 and its documents no copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import WORD, buckets_for, hash_bucket, hash_fraction, read, staged

WEIGHTS = (5, 2, 1)


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """``target`` for each row of (source, source_size); one row a source, so the windows see sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("no") - 1) % len(weights)) + 1).cast("double")
    t = per_source.withColumn("no", F.row_number().over(order)).withColumn("weight", w)
    t = t.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    # Sources in ascending cap / weight: the first ones are capped. Level when all before this one are capped:
    before = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("no"), F.col("level").alias("level")))).over(everything)
    level = first["level"]
    return t.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0, buckets: int | None = None, seed: str = "mix", carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of (doc_id, text, source); ``carry``: the whole row as struct ``row`` too."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    buckets = buckets or buckets_for(docs.count())
    d = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("th"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    cls = F.when(F.col("size") < 16, F.col("size")).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 16)).cast("int")
    d = d.withColumn("cls", cls).withColumn("bucket", hash_bucket(buckets, F.lit(seed), F.col("doc_id")))
    cell = ["source", "cls", "bucket"]
    counts = staged(d.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")  # read three times
    per_source = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(per_source, weights, share, max_repeats)
    before = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)  # some 400 classes a source
    classes = counts.groupBy("source", "cls").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    classes = classes.select(F.col("source").alias("__of"), F.col("cls").alias("__in"), "base")
    earlier = Window.partitionBy("source", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = cells.join(classes, cells["source"].eqNullSafe(F.col("__of")) & (cells["cls"] == F.col("__in")))
    t, c = targets.alias("t"), cells.select(*cell, (F.col("base") + F.col("inside")).alias("offset")).alias("c")
    rates = c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("__source"), F.col("c.cls").alias("__cls"), F.col("c.bucket").alias("__bucket"), "offset", "source_size", "target")
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id", "th")
    d = d.withColumn("rn", F.row_number().over(inside))
    d = d.join(rates, d["source"].eqNullSafe(F.col("__source")) & (d["cls"] == F.col("__cls")) & (d["bucket"] == F.col("__bucket")))
    rank = (F.col("offset") + F.col("rn")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = hash_fraction(F.lit(seed), F.coalesce("source", F.lit("\x00")))
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return d.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", *["row"] * carry)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture: the rows of ``docs``, all columns, each as often as it is taken."""
    m = mix(docs, carry=True, **how).filter("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), c AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE floor(log2(size::DOUBLE) * 16) END::INT AS cls,
    (('0x' || substr(md5('mix|' || doc_id), 1, 8))::BIGINT % (SELECT greatest(64, ceil(count(*) / 50000.0)::BIGINT) FROM d))::INT AS bucket
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM d GROUP BY source
), w AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, (cap / weight, no)) FROM l WHERE level * weight <= cap)) AS target FROM l
), r AS (
  SELECT c.*, t.source_size, t.target, row_number() OVER (PARTITION BY c.source ORDER BY cls, bucket, size, doc_id)::DOUBLE AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(c.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
