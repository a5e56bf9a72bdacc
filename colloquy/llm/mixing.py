"""Mixing sources to target weights: hash-random keys, distributed prefix sums, an exact cut per source.

Every document gets a pseudo-random key. Within a source, the documents in key order form one long run of words; a source's
budget is a number of whole epochs over that run plus a leading part of one more, cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, running, saved, with_group, without

RESULTS = ["size", "source_size", "target", "taken"]

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: No source and no document is repeated more often.
MOST = 3


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add size, the number of words of the text (0 for null)."""
    return without(docs, RESULTS).withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of sources given as (_cq_source, source, source_size), which has a row for each source.

    A target is min(most x size, level x weight), where the level makes the targets add up to all words: what sources
    above their limit can't take is shared out again by weight. Sorted by limit over weight, the sources below their
    limit are a suffix, and the level is the largest (words left) / (weight left) that its own source can take. Both sorts are by
    range, so sources may be as many as hosts; two sums and the level reach the driver.
    """
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"_cq_rank": F.lit(1)})
    named = ranked.withColumn("_cq_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_cq_rank", F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("_cq_limit", F.col("source_size") * most).withColumn("_cq_ratio", F.col("_cq_limit") / F.col("_cq_weight"))
    order = [F.col("_cq_ratio").asc(), F.col("source").asc_nulls_last()]
    named = running(named, order, {"_cq_limits": F.col("_cq_limit"), "_cq_weights": F.col("_cq_weight")})
    size, weight = named.agg(F.sum("source_size"), F.sum("_cq_weight")).first()
    level = (F.lit(size) - F.col("_cq_limits")) / (F.lit(weight) - F.col("_cq_weights"))
    level = named.agg(F.max(F.when(level <= F.col("_cq_ratio"), level))).first()[0] if size else 0.0
    return named.select("_cq_source", "source_size", F.least(F.col("_cq_limit").cast("double"), F.lit(float(level or 0.0)) * F.col("_cq_weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, small: int = 1 << 16) -> DataFrame:
    """All rows of docs with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    Sources in code point order (null is a source, the last) weigh `weights` in turn and share all words; no target exceeds
    `most` times its source. taken adds up to floor(target) in every source and is at most most x size. Rows with equal id
    and size are interchangeable; the order depends on id and seed alone, so reruns agree. Empty texts are taken 0 times.
    Input columns named like a result are replaced; an empty table gives an empty result. docs may already carry size from
    sized() (and then needs no text column).

    A source is cut by the leading digits of its keys into 4,096 ranges. The ranges' prefix sums tell in which of them a source's
    budget ends: rows of ranges before it are taken once more, rows of ranges after it are not, and neither shuffle. Only the
    rows of that one range are sorted, for the exact cut. The table of sources is broadcast up to `small` rows, else joined by source,
    a source with a third of all rows over slices.
    """
    rows = docs if text_col not in docs.columns and "size" in docs.columns else sized(docs, text_col)
    columns = rows.columns
    rows = rows.withColumn("_cq_source", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))
    rows = rows.withColumn("_cq_key", F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))).withColumn("_cq_range", F.substring("_cq_key", 1, 3))
    ranges = saved(rows.groupBy("_cq_source", "_cq_range").agg(F.sum("size").alias("_cq_words")))
    named = F.when(F.col("_cq_source") != "", F.expr("substring(_cq_source, 2)"))
    goal = targets(ranges.groupBy("_cq_source").agg(F.sum("_cq_words").alias("source_size")).withColumn("source", named), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    goal = goal.withColumn("_cq_epochs", epochs).withColumn("_cq_rest", F.floor("target") - F.col("_cq_epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("_cq_words").over(W.partitionBy("_cq_source").orderBy("_cq_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The first range that holds more than what is left of the budget before it.
    ends = ranges.withColumn("_cq_start", before).join(goal.select("_cq_source", "_cq_rest"), "_cq_source").where(F.col("_cq_start") + F.col("_cq_words") > F.col("_cq_rest"))
    ends = ends.groupBy("_cq_source").agg(F.min(F.struct(F.col("_cq_range").alias("_cq_end"), "_cq_start")).alias("x")).select("_cq_source", "x.*")
    goal = saved(goal.join(ends, "_cq_source", "left"))
    told = rows.join(F.broadcast(goal), "_cq_source") if goal.count() <= small else with_group(rows, ["_cq_source"], [id_col], [], goal)
    epoch, inside = F.col("_cq_epochs") * F.col("size"), F.col("_cq_range").eqNullSafe(F.col("_cq_end"))
    plain = told.where(~inside).withColumn("taken", epoch + F.when(F.col("_cq_range") < F.col("_cq_end"), F.col("size")).otherwise(0))
    inner = W.partitionBy("_cq_source", "_cq_range").orderBy("_cq_key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_cq_rest") - F.col("_cq_start") - F.coalesce(F.sum("size").over(inner), F.lit(0))
    cut = told.where(inside).withColumn("taken", epoch + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    results = [*columns, "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return plain.select(*results).unionByName(cut.select(*results))


def mixed_rows(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each row once for every whole repeat it is taken, and once with its leading words, joined by
    single spaces, for a part.

    A row that isn't taken has no place in the mix. Whole repeats keep the text unchanged.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    # The words of each copy; 0 is all of them.
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), 0), F.lit(1), F.col("_cq_part")), " ")
    staged = mixed.withColumn("_cq_part", F.explode(copies))
    return staged.withColumn(text_col, F.when(F.col("_cq_part") > 0, cut).otherwise(F.col(text_col))).drop("_cq_part")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    skinny = saved(sized(docs).select("doc_id", "source", "size"))
    return mix(skinny).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':7') AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, (3 * source_size)::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM r),
g AS (
  SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT max(lev) FROM l WHERE lev <= ratio), 0) * w) AS target FROM l),
p AS (
  SELECT d.*, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS e
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, floor(target)::BIGINT - e * source_size - a)))::BIGINT AS taken FROM p
"""
