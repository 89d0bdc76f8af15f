"""The test tables in the roles of the library: plots, cells, predictions, daily series, features."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import aggs
from harrow.operators.joins import history
from harrow.operators.staging import staged
from harrow.operators.windows import center

TARGETS = (1997, 1998, 1999)

# Values are roots, and nothing is rounded before a query's own output: a mean of rounded numbers often ends in exactly
# half a unit of the last digit kept, which two engines may round apart.

BASE = """
plots AS (
  SELECT location, period, location || '_' || period AS group_id, entity, rep, value, quantity FROM (
    SELECT l_suppkey AS location, greatest(year(l_shipdate), 1995 + l_partkey % 5)::INT AS period, l_partkey AS entity,
           l_linenumber AS rep, sqrt(l_extendedprice * (1 - l_discount)) / 10 AS value, l_quantity AS quantity FROM lineitem)
), cells AS MATERIALIZED (
  SELECT group_id, location, period, entity, avg(value) AS value, count(*) AS n_plots FROM plots GROUP BY ALL
), centred AS MATERIALIZED (
  SELECT *, value - avg(value) OVER (PARTITION BY group_id) AS cv FROM cells
), targets AS (
  SELECT unnest([1997, 1998, 1999])::INT AS target
), hist AS (
  SELECT t.target, c.* FROM targets t JOIN centred c ON c.period < t.target
), ent AS (
  SELECT target, entity, avg(cv) AS a FROM hist GROUP BY ALL
), brand AS (
  SELECT h.target, p.p_brand AS brand, avg(h.cv) AS b FROM hist h JOIN part p ON p.p_partkey = h.entity GROUP BY ALL
), pred AS MATERIALIZED (
  SELECT c.group_id, c.location, c.period, c.entity, c.value, e.a IS NULL AS is_new, coalesce(e.a, b.b, 0) AS score_a, coalesce(b.b, 0) AS score_b
  FROM cells c JOIN targets t ON c.period = t.target JOIN part p ON p.p_partkey = c.entity
  LEFT JOIN ent e ON e.target = c.period AND e.entity = c.entity LEFT JOIN brand b ON b.target = c.period AND b.brand = p.p_brand
), daily AS (
  SELECT user_id % 20 AS group_id, ts::DATE AS day, avg(value) AS v_avg, round(max(value), 6) AS v_max, round(min(value), 6) AS v_min, count(*) AS n
  FROM events GROUP BY ALL
), gaps AS (
  SELECT group_id, day, CASE WHEN (group_id * 7 + day(day)) % 9 < 3 OR (group_id + day(day)) % 13 < 2 THEN NULL ELSE v_avg END AS v FROM daily
), feats AS (
  SELECT vec_id AS entity, i AS feature, floor(((vec_id * 31 + i * 17) % 97) / 33.0)::INT AS dosage,
         CASE WHEN (vec_id + i) % 11 = 0 THEN NULL ELSE (CASE WHEN embedding[i] > 0.06 THEN 2 WHEN embedding[i] > -0.06 THEN 1 ELSE 0 END) END AS d
  FROM embeddings, unnest(range(1, 65)) AS r(i)
)"""


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


class Testbed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def plots(self) -> DataFrame:
        """All line items; those before a part's release count in the year of the release, so that new entities come in every year."""
        period = F.greatest(F.year("l_shipdate"), (1995 + F.col("l_partkey") % 5).cast("int"))
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("location"), period.alias("period"), F.concat_ws("_", "l_suppkey", period).alias("group_id"), F.col("l_partkey").alias("entity"),
            F.col("l_linenumber").alias("rep"), (F.sqrt(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10).alias("value"), F.col("l_quantity").alias("quantity"))

    @cached_property
    def cells(self) -> DataFrame:
        return aggs.cell_means(self.plots, ["group_id", "location", "period", "entity"], "value")

    @cached_property
    def centred(self) -> DataFrame:
        return self.cells.withColumn("cv", center("value", "group_id"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.spark.createDataFrame([(y,) for y in TARGETS], "target int")

    @cached_property
    def hist(self) -> DataFrame:
        return history(self.targets, self.centred, "target", "period")

    @cached_property
    def pred(self) -> DataFrame:
        """Written once for a query: whatever uses it several times scans the trial records once.

        Parts grow with the table: they are joined by sorting, not gathered in the driver, and with sums by entity, not with all records.
        """
        part = self.table("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("brand")).hint("merge")
        per = self.hist.groupBy("target", "entity").agg(F.sum("cv").alias("s"), F.count("cv").alias("n"))
        ent = per.select("target", "entity", F.try_divide("s", "n").alias("a")).hint("merge")
        brand = per.join(part, "entity").groupBy("target", "brand").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("b"))
        now = self.cells.join(F.broadcast(self.targets), F.col("period") == F.col("target")).join(part, "entity")
        return staged(now.join(ent, ["target", "entity"], "left").join(brand, ["target", "brand"], "left").select(
            "group_id", "location", "period", "entity", "value", F.col("a").isNull().alias("is_new"),
            F.coalesce("a", "b", F.lit(0.0)).alias("score_a"), F.coalesce("b", F.lit(0.0)).alias("score_b")), "pred")

    @cached_property
    def daily(self) -> DataFrame:
        return self.table("events").groupBy((F.col("user_id") % 20).alias("group_id"), F.to_date("ts").alias("day")).agg(
            F.avg("value").alias("v_avg"), r6(F.max("value")).alias("v_max"), r6(F.min("value")).alias("v_min"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def gaps(self) -> DataFrame:
        """The daily series with days taken out by a fixed rule."""
        gone = ((F.col("group_id") * 7 + F.dayofmonth("day")) % 9 < 3) | ((F.col("group_id") + F.dayofmonth("day")) % 13 < 2)
        return self.daily.select("group_id", "day", F.when(~gone, F.col("v_avg")).alias("v"))

    @cached_property
    def feats(self) -> DataFrame:
        """Long features: entity, feature, dosage (complete) and d (0, 1, 2 or null) for the 64 components of all vectors."""
        x = self.table("embeddings").select(F.col("vec_id").alias("entity"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long"))).alias("feature"), "embedding")
        e = F.element_at("embedding", F.col("feature").cast("int")).cast("double")
        d = F.when(e > 0.06, 2).when(e > -0.06, 1).otherwise(0)
        return x.select("entity", "feature", F.floor(((F.col("entity") * 31 + F.col("feature") * 17) % 97) / F.lit(33.0)).cast("int").alias("dosage"),
                        F.when((F.col("entity") + F.col("feature")) % 11 != 0, d).alias("d"))
