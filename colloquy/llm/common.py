"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups are spread over so many tasks at most; the set of salts fits one bigint mask.
SALTS = 64

#: ASCII letters, for folding that leaves every other character alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Make sure checkpoint() has a folder: the one the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary one that ends with it; on a cluster, whose executors share no local
    folder, that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return spark


def short_batches(frame: DataFrame, rows: int = 1000) -> DataFrame:
    """Return the frame, with its session set to hand Python at most so many rows at once.

    The default of 10,000 rows is meant for numbers; as many long texts would be gigabytes. A smaller setting is left alone.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return frame


def gathered(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Batches of narrow rows, put together to so many rows or more (but for the last)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def saved(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors cost no recomputation of what came before."""
    ready(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder, for what is wide and read more than once.

    Unlike a checkpoint it is compressed and read by column. The table is removed when the session ends (with the folder, if the
    driver is lost before).
    """
    spark = ready(frame.sparkSession)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    frame.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(frame.schema).parquet(path.toString())


def without(frame: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns whose names an operator is about to use (its results and everything starting with _cq_)."""
    taken = {n.lower() for n in names}
    return frame.drop(*[c for c in frame.columns if c.lower() in taken or c.lower().startswith("_cq_")])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text a character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_group(rows: DataFrame, keys: list[str], spread: list[str], aggregates: list[Column], table: DataFrame | None = None, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Add aggregates over each key's rows to those rows, without gathering a hot key in one task.

    The aggregates are combined map-side. Each row belongs to one of SALTS slices by a hash of `spread`; a group's result
    is repeated for the slices that the group really has (a bit mask kept while aggregating), and the join is on key and
    slice. A group with one row is repeated once, a group with a third of all rows at most SALTS times. Keys must not be null.
    `table`, if given, has a row for each key, and its columns are added too; how="left" keeps rows whose key it lacks. The same rows
    with fewer columns may be `counted` in place of `rows`. The result has one more column, _cq_slice.
    """
    slices = lambda frame: frame.withColumn("_cq_slice", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    sliced = slices(rows)
    groups = (sliced if counted is None else slices(counted)).groupBy(*keys).agg(*aggregates, F.expr("bit_or(shiftleft(1L, _cq_slice))").alias("_cq_mask"))
    groups = groups if table is None else groups.join(table, keys, how)
    groups = groups.withColumn("_cq_slice", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(_cq_mask, i) = 1)")))
    return sliced.join(groups.drop("_cq_mask"), [*keys, "_cq_slice"])


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add sums over all rows before a row in a total order. Rows are sorted by range and summed within a range; the ranges' offsets are
    sums of a table with a row for each partition, which is broadcast."""
    placed = saved(rows.repartitionByRange(*order).withColumn("_cq_part", F.spark_partition_id()))
    parts = placed.groupBy("_cq_part").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    earlier = W.orderBy("_cq_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("_cq_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_cq_offset_{n}") for n in sums))
    within = W.partitionBy("_cq_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), "_cq_part")
    return joined.select(*rows.columns, *((F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"_cq_offset_{n}")).alias(n) for n, x in sums.items()))


def dealt(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on keys with one more column, _cq_slice, to join on as well: a key's rows on the right are dealt over slices
    by a hash of `spread`, those on the left (which lack these columns) are repeated for the slices that the key has. Left rows without a
    key on the right are dropped."""
    right = right.withColumn("_cq_slice", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    masks = right.groupBy(*keys).agg(F.expr("bit_or(shiftleft(1L, _cq_slice))").alias("_cq_mask"))
    slices = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(_cq_mask, i) = 1)"))
    return left.join(masks, keys).withColumn("_cq_slice", slices).drop("_cq_mask"), right


def bit_words(hits: DataFrame, bit_col: str) -> DataFrame:
    """A bitmap of the bits (0, 1, 2, ...) in a column: its 64-bit words that aren't zero, as (_cq_word, _cq_set)."""
    return hits.groupBy(F.expr(f"shiftright({bit_col}, 6)").alias("_cq_word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit_col} & 63 as int)))").alias("_cq_set"))


def in_bitmap(rows: DataFrame, words: DataFrame, bits: list[Column], name: str) -> DataFrame:
    """Add a boolean: whether all the given bits of a row are set in the bitmap, which is broadcast and must be bounded."""
    probed, found = rows, F.lit(True)
    for i, bit in enumerate(bits):
        part = F.broadcast(words.select(F.col("_cq_word").alias(f"_cq_word{i}"), F.col("_cq_set").alias(f"_cq_set{i}")))
        probed = probed.withColumn(f"_cq_bit{i}", bit).join(part, F.expr(f"shiftright(_cq_bit{i}, 6) = _cq_word{i}"), "left")
        found = found & F.expr(f"coalesce(getbit(_cq_set{i}, cast(_cq_bit{i} & 63 as int)), 0) = 1")
    return probed.withColumn(name, found).select(*rows.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a graph given as edges (a, b) of bigint: one row (node, root) for every node of an edge.

    Alternating large-star and small-star rounds keep a set of pairs (child, smaller node); each round hooks neighbours to
    the smallest node seen, so the number of rounds grows with the logarithm of the longest path. All rounds are shuffles on
    nodes; hubs are spread by with_group. Only one row of counts per round reaches the driver.
    """
    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))"))).first())

    pairs = saved(tidy(edges))
    before = mark(pairs)
    while before[0]:
        both = pairs.union(pairs.select("b", "a"))
        large = with_group(both, ["a"], ["b"], [F.min("b").alias("_cq_low")]).where("b > a")
        pairs = large.select(F.col("b").alias("a"), F.least("a", "_cq_low").alias("b")).distinct()
        small = with_group(pairs, ["a"], ["b"], [F.min("b").alias("_cq_low")])
        pairs = saved(tidy(small.select("b", F.col("_cq_low").alias("a")).union(small.select(F.col("a").alias("b"), F.col("_cq_low").alias("a")))))
        after = mark(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
