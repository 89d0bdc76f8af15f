"""Declared sources to one cell schema and the raw build with its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.clean import number
from harrow.operators.staging import staged

#: The schema that every source ends in.
CELLS = ["dataset", "group_id", "place", "period", "entity", "value", "n_plots"]


@dataclass(frozen=True)
class SourceSpec:
    """How a source's records become cells: SQL expressions over its columns.

    ``place``, ``period``, ``entity`` and ``value`` are expressions; ``keep`` is a condition on the raw record. A record
    without a place, a period, an entity or a finite number as value is left out. Group keys are place and period.
    """

    name: str
    place: str
    period: str
    entity: str
    value: str
    keep: str = "true"


def records(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Single records under the common names, values as they stand after coercion to finite numbers."""
    d = raw.filter(F.expr(spec.keep)).select(
        F.lit(spec.name).alias("dataset"), F.expr(spec.place).cast("string").alias("place"), F.expr(spec.period).cast("int").alias("period"),
        F.expr(spec.entity).cast("string").alias("entity"), number(F.expr(spec.value)).alias("value"))
    d = d.filter(F.col("place").isNotNull() & F.col("period").isNotNull() & F.col("entity").isNotNull() & F.col("value").isNotNull())
    return d.withColumn("group_id", F.concat_ws("_", "place", "period"))


def cells(records: DataFrame) -> DataFrame:
    """One row a (dataset, group, entity): mean value and number of records."""
    keys = ["dataset", "group_id", "place", "period", "entity"]
    return records.groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_plots")).select(*CELLS)


def load(tables: dict[str, DataFrame], specs: list[SourceSpec], entities: dict[str, DataFrame] | None = None) -> DataFrame:
    """All sources in one cell table. ``tables``: raw table by source name; ``entities``: for a source that has features, its (entity) with any."""
    out = None
    for spec in specs:
        d = records(tables[spec.name], spec)
        if entities and spec.name in entities:
            d = d.join(entities[spec.name].select(F.col("entity").cast("string").alias("entity")).distinct(), "entity", "left_semi")
        c = cells(d)
        out = c if out is None else out.unionByName(c)
    return out


def raw_build(raw: DataFrame, spec: SourceSpec, features: DataFrame, covariates: DataFrame, daily: DataFrame, out: str, least: int = 25) -> DataFrame:
    """One job from raw tables to five sinks under ``out`` (plots, cells, features, covariates, daily) and a report (key, value).

    Plots are cleaned once and written; cells and the report are worked out from what was written. Plots of entities without
    features are dropped and counted; covariates and daily rows are kept for groups with cells; a row of covariates that are
    all null is flagged ``missing``. ``features``: entity, feature, dosage; ``covariates``: group_id and numbers; ``daily``: group_id and series.
    """
    known = staged(features.select(F.col("entity").cast("string").alias("entity")).distinct(), "build-entities")
    every = staged(records(raw, spec).join(known.withColumn("has", F.lit(True)), "entity", "left"), "build-records")
    plots = staged(every.filter("has").drop("has"), "plots", f"{out}/plots")
    table = staged(cells(plots), "cells", f"{out}/cells")
    groups = staged(table.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "build-groups")
    numbers = [c for c in covariates.columns if c != "group_id"]
    flagged = covariates.withColumn("missing", F.coalesce(*numbers).isNull().cast("int")).join(groups.select("group_id"), "group_id", "left_semi")
    flagged = staged(flagged, "covariates", f"{out}/covariates")
    kept_daily = staged(daily.join(groups.select("group_id"), "group_id", "left_semi"), "daily", f"{out}/daily")
    dosages = staged(features, "features", f"{out}/features")
    one = lambda df, *sums: df.agg(*sums)
    counts = [
        one(raw, F.count(F.lit(1)).alias("plots_in_source")),
        one(every, F.count(F.lit(1)).alias("plots_finite"), F.count_if(F.col("has").isNull()).alias("plots_dropped_no_features"), F.countDistinct(F.when(F.col("has").isNull(), F.col("entity"))).alias("entities_without_features")),
        one(table, F.count(F.lit(1)).alias("cells"), F.countDistinct("entity").alias("entities"), F.countDistinct("period").alias("periods")),
        one(groups, F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") < least).alias("groups_below_least"), F.percentile("n", F.lit(0.5)).alias("entities_per_group_median")),
        one(flagged, F.count(F.lit(1)).alias("groups_with_covariates"), F.coalesce(F.sum("missing"), F.lit(0)).alias("groups_all_missing")),
        one(kept_daily, F.count(F.lit(1)).alias("daily_rows")),
        one(dosages, F.count(F.lit(1)).alias("dosages"), F.avg(F.col("dosage").isNull().cast("double")).alias("missing_rate")),
    ]
    report = None
    for c in counts:
        d = c.select(F.lit("r").alias("r"), *(F.col(n).cast("double").alias(n) for n in c.columns)).unpivot("r", c.columns, "key", "value").select("key", "value")
        report = d if report is None else report.unionByName(d)
    return staged(report, "report", f"{out}/report")
