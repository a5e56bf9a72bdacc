"""Joins, set operations, deduplication and ranking over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """W2. Of rows with equal keys the first by the order."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", at).where("_rank = 1").drop("_rank")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W3. Of rows with equal keys the last by the order."""
    return first_wins(rows, keys, [F.col(c).desc() for c in order])


def ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """W4. The place of each row within its key, from 1."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """W4 for a few keys with many rows each: the place of each row within its key, from 1, without a key in one task.

    Rows are sorted by range over keys and order, and numbered within a range; a range's offset is the sum of a table with a row for
    each range and key.
    """
    from colloquy.plans.lineage import saved

    placed = saved(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*keys, "_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order))
    return placed.withColumn("_at", at).join(starts, [*keys, "_part"]).withColumn(name, (F.col("_start") + F.col("_at")).cast("int")).select(*rows.columns, name)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """W1, T2. The first k rows of each key, with their rank; the order should be total."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def add_title(untitled: DataFrame, titles: DataFrame, key: str, order: list[str]) -> DataFrame:
    """J1. Give rows the last title of their key; rows without one are dropped. The engine broadcasts the titles if they are small."""
    return untitled.join(last_wins(titles, [key], order).select(key, "title"), key)


def of_known(rows: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """J2, J4. Rows whose key is known."""
    return rows.join(known, key, "left_semi")


def not_yet(wanted: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """J10. Rows whose key isn't done yet; repeats are kept."""
    return wanted.join(done, key, "left_anti")


def known_everywhere(users: DataFrame, sources: list[DataFrame], key: str = "user_id") -> DataFrame:
    """J11. Users that all sources have."""
    return reduce(lambda left, right: left.join(right, key, "left_semi"), sources, users)


def missing_counts(users: DataFrame, sources: dict[str, DataFrame], key: str = "user_id") -> DataFrame:
    """J11. How many users each source lacks, in one row per source."""
    counts = [users.join(s, key, "left_anti").agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("missing")) for name, s in sources.items()]
    return reduce(DataFrame.unionByName, counts)


def with_children(parents: DataFrame, children: DataFrame, key: str, id_col: str, user_col: str) -> DataFrame:
    """J3, A4. Parents with the distinct ids and users of their children, as sorted arrays, empty where there are none."""
    sets = children.groupBy(key).agg(F.sort_array(F.collect_set(id_col)).alias("comment_set"), F.sort_array(F.collect_set(user_col)).alias("user_set"))
    joined = parents.join(sets, key, "left")
    for name in ("comment_set", "user_set"):
        joined = joined.withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(sets.schema[name].dataType.elementType))))
    return joined


def union_users(*frames: DataFrame) -> DataFrame:
    """U1. Distinct rows of all frames."""
    return reduce(DataFrame.union, frames).distinct()


def subset_report(part: DataFrame, whole: DataFrame) -> DataFrame:
    """U4. One row: rows of part that whole lacks, both counts, whether part is a proper subset."""
    a, b = part.distinct(), whole.distinct()
    missing = a.join(b, a.columns, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    sizes = a.agg(F.count(F.lit(1)).alias("part_size")).crossJoin(b.agg(F.count(F.lit(1)).alias("whole_size")))
    return sizes.crossJoin(missing).withColumn("proper_subset", (F.col("missing") == 0) & (F.col("part_size") < F.col("whole_size")))


def keyed_union(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """U7. Union in which the first source that has a key wins."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return first_wins(reduce(DataFrame.unionByName, ranked), keys, ["source_rank", *order])


def resolve_quotes(replies: DataFrame, earlier: DataFrame, same: list[str], order: str) -> DataFrame:
    """J9. For each reply the first earlier row that agrees in `same` (author, text without newlines, thread), or null.

    Both frames have an id and the order column. If any earlier row agrees, the first is the first of all rows that agree, so
    one row for each group is joined and copies are never paired.
    """
    first = earlier.groupBy(*same).agg(F.min_by("id", order).alias("quoted_id"), F.min(order).alias("_first"))
    joined = replies.select(*same, F.col("id").alias("reply_id"), F.col(order).alias("_at")).join(first, same, "left")
    return joined.select("reply_id", F.when(F.col("_first") < F.col("_at"), F.col("quoted_id")).alias("quoted_id"))


def totals(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """A20. Rows loaded, rows beyond the first of their key, keys of `known` that weren't found."""
    loaded = rows.agg(F.count(F.lit(1)).alias("loaded"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicates"))
    return loaded.crossJoin(known.select(key).distinct().join(rows, key, "left_anti").agg(F.count(F.lit(1)).alias("not_found")))
