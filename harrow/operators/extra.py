"""Further operators: one-hot columns, block penalties, mixed spectra, two-way resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.draws import heads
from harrow.operators.inference import Ranked, rank_difference
from harrow.operators.joins import numbered
from harrow.operators.models import centred, normal_equations, reml_grid
from harrow.operators.staging import staged
from harrow.operators.windows import rank_key


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """An indicator column for each listed value; unlisted values have none."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def block_ridge(train: DataFrame, group: str, target: str, blocks: dict[str, list[str]], penalties: list[dict[str, float]]) -> list[np.ndarray]:
    """Ridge with a penalty for each block of columns, relative to the block's mean diagonal; cross-products once for all settings."""
    columns = [c for b in blocks.values() for c in b]
    a, b, _, _ = normal_equations(centred(train, group, [*columns, target]), columns, target)
    at = {name: [columns.index(c) for c in cols] for name, cols in blocks.items()}
    out = []
    for p in penalties:
        d = np.zeros(len(columns))
        for name, i in at.items():
            d[i] = p[name] * np.diag(a)[i].mean()
        out.append(np.linalg.solve(a + np.diag(d), b))
    return out


def mixed_reml(spec: DataFrame, yy: float, degrees: int, mixes: list[float], deltas: list[float]) -> DataFrame:
    """Restricted likelihood over a grid of kernel mixes (1 - w) K + w c I and variance ratios; c is the mean eigenvalue.

    The eigenvectors do not change with w, so every mix is a rescaled spectrum. The direction's cross-product is scaled
    with its eigenvalue, as the feature columns would be.
    """
    mean = spec.agg(F.avg("d").alias("__c"))
    out = None
    for w in mixes:
        s = spec.crossJoin(F.broadcast(mean)).withColumn("__n", (1 - w) * F.col("d") + w * F.col("__c"))
        s = s.select(F.col("__n").alias("d"), (F.col("c2") * F.col("__n") / F.greatest("d", F.lit(1e-12))).alias("c2"))
        g = reml_grid(s, yy, degrees, deltas).withColumn("mix", F.lit(float(w)))
        out = g if out is None else out.unionByName(g)
    return out


def two_way_bootstrap(rows: DataFrame, group: str, entity: str, value: str, one: str, other: str, b: int, seed: str) -> DataFrame:
    """SE of the mean difference of two rank correlations when groups and entities are drawn; an entity drawn twice is a tie.

    Entities and groups get the list of the replicates that draw them, once for each time. A group's rows with these lists
    are one row of arrays; ranks in a replicate follow from how often each row stands in it, so that no row is repeated.
    """
    d = rows.select(group, entity, *(rank_key(c, 9).cast("double").alias(n) for c, n in ((value, "v"), (one, "a"), (other, "c"))))
    d = d.join(drawn_in(rows, entity, b, seed).hint("merge"), entity).withColumnRenamed("in", "__in")
    packed = d.groupBy(group).agg(F.collect_list(F.struct("v", "a", "c", "__in")).alias("__u")).select(group, *(F.col("__u")[c].alias(c) for c in ("v", "a", "c", "__in")))

    def run(batches):
        for t in batches:
            for at in range(0, len(t), 1000):
                part, out = t.iloc[at : at + 1000], []
                for row in part[["v", "a", "c", "__in"]].to_dict("records"):
                    w = np.zeros((b, len(row["v"])), np.int64)
                    np.add.at(w, (np.concatenate(row["__in"]).astype(int), np.repeat(np.arange(len(row["v"])), [len(x) for x in row["__in"]])), 1)
                    out.append(rank_difference([Ranked(np.asarray(row[c], float)) for c in ("v", "a", "c")], w))
                yield pd.DataFrame({group: part[group].repeat(b).to_numpy(), "rep": np.tile(np.arange(b), len(part)), "__d": np.concatenate(out)})

    per = packed.mapInPandas(run, f"`{group}` {rows.schema[group].dataType.simpleString()}, rep int, __d double").filter("__d is not null")
    of = drawn_in(rows, group, b, seed).select(group, F.explode("in").alias("rep")).groupBy(group, "rep").agg(F.count(F.lit(1)).alias("w"))
    per = per.join(of.hint("merge"), [group, "rep"])
    return per.groupBy("rep").agg((F.sum(F.col("__d") * F.col("w")) / F.sum("w")).alias("__x")).agg(F.avg("__x").alias("mean"), F.stddev_samp("__x").alias("se"))


def drawn_in(rows: DataFrame, key: str, b: int, seed: str, together: int = 16_384) -> DataFrame:
    """(key, in): for each distinct key that is drawn the replicates that draw it, once for each time: as many draws as keys in each of ``b``."""
    k = staged(numbered(rows, key), "numbered-keys")
    n, spark = k.count(), rows.sparkSession

    def run(batches):
        for t in batches:
            for at in t["id"] * together:
                size = min(together, n - at)
                got = heads(f"{seed}|{key}", 0, b, size, int(at)) % np.uint32(n)
                yield pd.DataFrame({"i": got.ravel().astype(np.int64), "rep": np.repeat(np.arange(b), size)})

    chunks = -(-n // together)
    draws = spark.range(0, chunks, 1, max(1, min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(run, "i long, rep int")
    return draws.groupBy("i").agg(F.collect_list("rep").alias("in")).hint("merge").join(k, "i").select(key, "in")
