"""Document fingerprints: SimHash with signed votes, and search by permuted block tables.

A text's terms are its pairs of neighbouring words. Each term's 128-bit hash votes, with the term's weight, for the bits that it
has set and against the others; a fingerprint bit is 1 where the votes in favour win. To find all fingerprints within a
radius, each is filed under radius + 1 keys, one for each of as many blocks of bits that are rotated to the front; of two
fingerprints within the radius, at least one block is equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import dealt, short_batches, with_group, written

BITS = 128


def fingerprint(texts: list[str]) -> np.ndarray:
    """Fingerprints, 16 bytes each, of texts.

    Words are split at ASCII white space, with A-Z lower-cased; a text of one word has that word as its term, one without words
    has fingerprint 0. A pair weighs 2, or 1 if both words together have 7 bytes or fewer (such pairs say little).
    """
    from xxhash import xxh3_128_digest

    out, hashes, weights, sizes = np.zeros((len(texts), BITS // 8), np.uint8), [], [], []

    def vote(first: int) -> None:
        if hashes:
            size, weight = np.array(sizes), np.array(weights, np.uint8)
            full = np.flatnonzero(size)
            starts = np.cumsum(size[full]) - size[full]
            bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, BITS)
            bits *= weight[:, None]
            on = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > np.add.reduceat(weight, starts, dtype=np.int32)[:, None]
            out[first + full] = np.packbits(on, axis=1)
        hashes.clear(), weights.clear(), sizes.clear()

    first = 0
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        terms = [a + b" " + b for a, b in zip(words, words[1:], strict=False)] or words
        hashes += map(xxh3_128_digest, terms)
        weights += [2 if len(t) > 8 else 1 for t in terms]
        sizes.append(len(terms))
        if len(hashes) > 50_000:
            vote(first)
            first = i + 1
    vote(first)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of differing bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


DIGEST = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digests(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> pd.DataFrame:
    new = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    changed = fingerprint(new)
    return pd.DataFrame({
        "doc_id": pd.Series(ids, dtype=object), "n_chars": pd.Series([len(t) for t in texts], dtype="int64"), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [p.tobytes().hex() for p in prints], "edited_fingerprint": [p.tobytes().hex() for p in changed],
        "near_edited": likeness(prints, changed), "near_next": likeness(prints, next_prints),
    })


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger id, after the last one the first; null ids come first, and rows with equal
    ids follow the hash of their text, then the text. Null text counts as empty; a single document is its own next; an empty
    table gives an empty result; other columns are passed over.

    Documents are range-partitioned by id once and walked in order with one document in hand. Each partition's first and last
    document meet their neighbours in a second small step, so texts are shuffled once and never gathered.
    """
    kind = docs.schema[id_col].dataType
    # Whole numbers with nulls among them would reach pandas as floats, so Python gets whole numbers as text.
    shown = "string" if isinstance(kind, T.IntegralType) else kind.simpleString()
    columns = DIGEST.format(id=shown) + ", part int, edge string, text string"
    rows = short_batches(docs).select(F.col(id_col).alias("_cq_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_cq_text")).withColumn("_cq_hash", F.xxhash64("_cq_text"))
    order = [F.col("_cq_id").asc_nulls_first(), F.col("_cq_hash"), F.col("_cq_text")]
    placed = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select(F.col("_cq_id").cast(shown), "_cq_text")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({c: frame[c] if c in frame else pd.Series([None] * len(frame), dtype=object) for c in names})

        def edge(i, text: str, kind: str) -> pd.DataFrame:
            return whole(pd.DataFrame({"doc_id": pd.Series([i], dtype=object), "part": part, "edge": kind, "text": [text]}))

        for batch in batches:
            for k in range(0, len(batch), 500):
                ids, texts = batch["_cq_id"].tolist()[k : k + 500], batch["_cq_text"].tolist()[k : k + 500]
                prints = fingerprint(texts)
                if held is None:
                    yield edge(None, texts[0], "first")
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
                held = ids[-1], texts[-1], prints[-1:]
                if len(ids) > 1:
                    yield whole(_digests(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]))
        if held is not None:
            yield edge(held[0], held[1], "last")

    names = [c.split()[0] for c in columns.split(", ")]
    walked = written(placed.mapInPandas(follow, columns))
    done = walked.where("edge is null").drop("part", "edge", "text")
    firsts = walked.where("edge = 'first'").select(F.col("part").alias("_cq_next"), F.col("text").alias("following"))
    lasts = walked.where("edge = 'last'").select("part", "doc_id", "text")
    # Two rows a partition at most, and only their numbers meet in one place.
    parts = firsts.select(F.col("_cq_next").alias("part"))
    ring = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.first("part").over(W.orderBy("part"))).alias("_cq_next"))
    ends = lasts.join(ring, "part").join(firsts, "_cq_next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, following, ids = batch["text"].tolist(), batch["following"].tolist(), batch["doc_id"].tolist()
            yield _digests(ids, texts, fingerprint(texts), following, fingerprint(following))

    return done.unionByName(ends.mapInPandas(finish, DIGEST.format(id=shown))).withColumn("doc_id", F.col("doc_id").cast(kind))


def _edges(radius: int) -> list[int]:
    digits, count = BITS // 4, radius + 1
    if not 0 <= radius < digits:
        raise ValueError(f"radius must be from 0 to {digits - 1}")
    return [digits * i // count for i in range(count + 1)]


def block_tables(prints: DataFrame, radius: int, print_col: str = "fingerprint") -> DataFrame:
    """Add table (0 to radius) and key, the block of hex digits that the table's permutation brings to the front; radius + 1
    rows for each fingerprint. Blocks are whole hex digits, so radius is below BITS / 4."""
    edges = _edges(radius)
    keys = [F.struct(F.lit(i).alias("table"), F.substring(print_col, a + 1, b - a).alias("key")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return prints.withColumn("_cq_key", F.explode(F.array(*keys))).select("*", "_cq_key.*").drop("_cq_key")


def search(index: DataFrame, queries: DataFrame, radius: int = 3, print_col: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Pairs (query, match, distance) of distinct fingerprints (hex) in queries and index at `radius` bits or fewer, each once.

    Both sides are made distinct first, so copies cost nothing (with `keep`, columns of index, it has to be distinct already, and they are
    in the result); null fingerprints are passed over. A pair is found in the first table whose blocks are equal, and
    distances are part of the join's condition, so other candidates are never rows. A block that many fingerprints share is dealt
    over slices.
    """
    words = lambda c: [F.conv(F.substring(c, i + 1, 8), 16, 10).cast("long") for i in range(0, BITS // 4, 8)]
    found = index.select(F.col(print_col).alias("match"), *(keep or [])).where("match is not null")
    left = block_tables(queries.select(F.col(print_col).alias("query")).where("query is not null").distinct(), radius, "query")
    left, right = dealt(left, block_tables(found if keep else found.distinct(), radius, "match"), ["table", "key"], ["match"])
    left = left.withColumn("_cq_q", F.array(*words("query"))).withColumnsRenamed({"table": "_cq_table", "key": "_cq_key", "_cq_slice": "_cq_part"})
    right = right.withColumn("_cq_m", F.array(*words("match")))
    distance = sum(F.bit_count(F.col("_cq_q")[i].bitwiseXOR(F.col("_cq_m")[i])) for i in range(BITS // 32))
    edges = _edges(radius)
    earlier = F.lit(False)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        earlier = earlier | ((F.col("table") > i) & (F.substring("query", a + 1, b - a) == F.substring("match", a + 1, b - a)))
    same = (F.col("_cq_table") == F.col("table")) & (F.col("_cq_key") == F.col("key")) & (F.col("_cq_part") == F.col("_cq_slice"))
    return left.join(right, same & (distance <= radius) & ~earlier).select("query", "match", distance.alias("distance"), *(keep or []))


def count_near(digests: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """Add near_docs: for rows whose id is divisible by `every`, how many other rows' fingerprints are within the radius; null for others.
    Pairs are counted where they are found, so only a count for each query and task is shuffled."""
    sizes = digests.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_cq_n"))
    asked = digests.where(F.col("doc_id") % every == 0)
    near = search(sizes, asked, radius, keep=["_cq_n"]).groupBy(F.col("query").alias("fingerprint")).agg((F.sum("_cq_n") - 1).alias("near_docs"))
    counted = with_group(asked, ["fingerprint"], ["doc_id"], [], near)
    rest = digests.where(F.coalesce(F.col("doc_id") % every != 0, F.lit(True)))
    return counted.select(*digests.columns, "near_docs").unionByName(rest.withColumn("near_docs", F.lit(None).cast("long")))


def query(spark, sf_dir: str) -> DataFrame:
    digests = written(fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return count_near(digests)
