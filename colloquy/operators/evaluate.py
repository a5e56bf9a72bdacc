"""Precision at K, confusion counts, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.relational import numbered

#: T2. The grid of K. Fixed values.
KS = list(range(5, 50, 5))


def precision_at_k(scored: DataFrame, keys: list[str], user: str = "user_id", ks: list[int] | None = None) -> DataFrame:
    """A15, W1, T2, M15, B3. Precision of the K best-scored rows of each key, for all K in one pass: rows are ranked once
    (ties by user), then summed under each K. The divisor is K, or the key's rows where there are fewer."""
    ks = ks or KS
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("prob").desc(), F.col(user)))
    per = scored.withColumn("rank", rank).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when((F.col("rank") <= k) & (F.col("label") > 0), 1).otherwise(0)).alias(f"hits_{k}") for k in ks))
    rows = per.select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(k).alias("K"), F.col(f"hits_{k}").alias("hits")) for k in ks))).alias("x"))
    return rows.select(*keys, "x.K", (F.col("x.hits") / F.least(F.col("x.K"), F.col("n"))).alias("precision"))


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A14. Counts, precision and recall per key of label and predicted (positive above 0); null where undefined."""
    yes, said = F.col("label") > 0, F.col("predicted") > 0
    out = rows.groupBy(*keys).agg(*(F.sum(x.cast("bigint")).alias(n) for n, x in (("tp", yes & said), ("fp", ~yes & said), ("fn", yes & ~said), ("tn", ~yes & ~said))))
    return out.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def mean_precision(results: DataFrame, keys: list[str], runs: int | None = 5) -> DataFrame:
    """A16. Mean over runs: a fixed divisor, or the rows that are there if runs is None."""
    total = F.sum("precision") / F.lit(float(runs)) if runs else F.avg("precision")
    return results.groupBy(*keys).agg(total.alias("precision"))


def histogram(results: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 40), bins: int = 5, grid: float = 0.05) -> DataFrame:
    """A17. Counts of precision in equal bins from 0 to the maximum rounded up to the grid, per K; the last bin is closed."""
    limit = results.where(F.col("K").isin(*ks)).agg((F.ceil(F.max("precision") / F.lit(grid)).cast("double") * F.lit(grid)).alias("top"))
    placed = results.where(F.col("K").isin(*ks)).crossJoin(F.broadcast(limit))  # one row
    number = F.least(F.lit(bins - 1), F.floor(F.col("precision") / (F.col("top") / F.lit(bins))))
    return placed.withColumn("bin", F.when(F.col("top") > 0, number).otherwise(0).cast("int")).groupBy("K", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"))


def series(results: DataFrame, ks: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """A21, T6. Precision in descending order with its place, per K: the points of a line plot."""
    return numbered(results.where(F.col("K").isin(*ks)), ["K"], [F.col("precision").desc(), F.col("topic_id").asc()], "place")
