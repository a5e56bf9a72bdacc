"""Exact dedup: two-pass Bloom filtering.

Pass 1 puts every text hash into a blocked Bloom filter: one 64-bit word for a row, and a few bits of it. The filter is built as an
aggregate by word, combined map-side, which keeps what is needed to tell bits hit twice from bits hit once. Pass 2 probes each
row: one with a bit that no other row hit is alone and passes straight through; only the other rows shuffle, by the SHA-256 of
their text. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, saved, with_group, without

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add text_sha256, over the text with A-Z lower-cased (null counts as empty)."""
    return without(docs, RESULTS).withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))


@dataclass
class Filter:
    """The words (_cq_word, _cq_set) of a Bloom filter that hold a bit hit twice or more, cut to bits that may be; how many words
    and bits a row it was built for; and whether the table is small enough to be broadcast."""

    words: DataFrame
    size: int
    hashes: int
    small: bool

    def hit(self, rows: DataFrame) -> DataFrame:
        return _hit(rows, self.size, self.hashes)


def _hit(rows: DataFrame, size: int, hashes: int) -> DataFrame:
    """Add the number of a row's word and the mask of its bits there."""
    at = F.xxhash64("text_sha256", F.lit(1))
    bits = " | ".join(f"shiftleft(1L, cast(shiftright(_cq_at, {6 * i}) & 63 as int))" for i in range(hashes))
    return rows.withColumn("_cq_word", F.pmod(F.xxhash64("text_sha256"), F.lit(size))).withColumn("_cq_at", at).withColumn("_cq_mask", F.expr(bits)).drop("_cq_at")


def bloom(rows: DataFrame, bits_per_row: int = 16, hashes: int = 2, most: int = 1 << 21) -> Filter:
    """Pass 1 over rows with text_sha256. The filter grows with the rows, so it never fills up; up to `most` words are broadcast
    (some 40 bytes each in memory)."""
    size = max(1, rows.count() * bits_per_row // 64)
    # Of a word: all bits, those hit an odd number of times, and how often its bits were hit.
    sums = _hit(rows, size, hashes).groupBy("_cq_word").agg(F.expr("bit_or(_cq_mask)").alias("a"), F.expr("bit_xor(_cq_mask)").alias("o"), F.expr("sum(bit_count(_cq_mask))").alias("n"))
    # Where the hits beyond the first are as many as the bits hit evenly, those bits were hit twice and the others once;
    # where they are more, any bit may have been hit again.
    kept = "if(n - bit_count(a) = bit_count(a & ~o), a & ~o, a)"
    words = saved(sums.where("n > bit_count(a)").select("_cq_word", F.expr(kept).alias("_cq_set")))
    return Filter(words, size, hashes, words.count() <= most)


def probe(rows: DataFrame, built: Filter, id_col: str) -> DataFrame:
    """Pass 2. Add _cq_again: whether all of a row's bits may have been hit by another row as well.

    A filter that is too large to be broadcast is probed by word: rows are dealt by their word, those of a common one over slices.
    """
    hit = built.hit(rows)
    if built.small:
        found = hit.join(F.broadcast(built.words), "_cq_word", "left")
    else:
        found = with_group(hit, ["_cq_word"], [id_col], [], built.words, "left")
    return found.select(*rows.columns, F.coalesce((F.col("_cq_set").bitwiseAND(F.col("_cq_mask"))) == F.col("_cq_mask"), F.lit(False)).alias("_cq_again"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digested: bool = False, built: Filter | None = None, narrow: DataFrame | None = None) -> DataFrame:
    """All rows of docs with keep_id, group_size, kept and text_sha256.

    Of equal texts (A-Z folded, null as empty) the row with the largest id stays; null ids rank lowest, and of rows that tie
    on the largest id exactly one is kept. group_size counts rows. Input columns named like a result are replaced; an
    empty table gives an empty result. docs may already carry text_sha256 from digests(): say so, or leave the text column out.
    What was made of the same rows may be given: the filter that bloom() built, and the ids and digests that were kept.

    Rows shuffle whole where they may be repeated. Where the filter is beyond its broadcast bound (from some twenty million rows on),
    all rows shuffle once by word, and repeated ones a second time: reduce wide rows to id and digest first.
    """
    rows = docs if digested or text_col not in docs.columns and "text_sha256" in docs.columns else digests(docs, text_col)
    if narrow is None:
        narrow = rows if set(rows.columns) <= {id_col, "text_sha256"} else saved(rows.select(id_col, "text_sha256"))
    built = built or bloom(narrow)
    probed = probe(rows, built, id_col)
    alone = probed.where(~F.col("_cq_again")).select(*rows.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    groups = with_group(probed.where("_cq_again"), ["text_sha256"], [id_col], [F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")], counted=probe(narrow, built, id_col).where("_cq_again"))
    # Equal ids share a slice, so rows that tie on the largest id meet in this window, which needs no further shuffle.
    order = F.row_number().over(W.partitionBy("text_sha256", "_cq_slice").orderBy(F.col(id_col).desc_nulls_last()))
    groups = groups.withColumn("_cq_order", order).withColumn("kept", (F.col("_cq_order") == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(groups.select(*alone.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    skinny = saved(digests(docs).select("doc_id", "text_sha256"))
    return exact_dedup(skinny).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
