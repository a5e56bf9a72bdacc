"""Packing: power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many of the longest as fit, then the binary
digits of the rest. A piece is a sequence of its own, in the bucket of its length, so no sequence crosses documents and
none is padded.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import saved, short_batches, without

RESULTS = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

#: Encodings of words are kept in two generations of up to this many for each worker; the memory is some 50 MB at most.
KEPT_WORDS = 100_000

_encoders: dict[str, Encoder] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, by way of the ids of their words.

    Only for tokenizers that split at white space and drop it, then letters from digits and from other characters, as the
    default does: its normaliser, its pre-tokeniser and its special tokens never act across ASCII white space, so a text's ids
    are those of its words in a row. Runs of plain letters, and ASCII punctuation after them, are parts of their own and go straight
    to the tokenizer's model; every other word goes through the whole tokenizer. Plain letters are those up to U+024F that
    lower-case to one such letter (which no normaliser changes), so that the model knows the bytes of all of them.
    """

    #: Punctuation that is parted from the letters before it. An apostrophe is not: with letters it can be a contraction.
    TAIL = b".,!?;:%$#*&|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # How the model's vocabulary writes the bytes of each plain letter's lower case.
        self.shown = {}
        for c in map(chr, range(0x41, 0x250)):
            low = c.lower()
            if c.isalpha() and len(low) == 1 and low.isalpha() and low < "\u0250" and all(unicodedata.is_normalized("NFC", x) for x in (c, low)):
                self.shown[ord(c)] = "".join(x for x, _ in written.pre_tokenize_str(low))
        self.plain = frozenset(map(chr, self.shown))

    def part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        if self.plain.issuperset(text):
            return _packed([t.id for t in self.model.tokenize(text.translate(self.shown))])
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        """The ids of a word met for the first time, or not lately; those of the latest words are remembered."""
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(self.TAIL)
            if core and core != word and self.plain.issuperset(core.decode("utf-8", "replace")):
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = self.part(word)
        self[word] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        # Of bytes: A-Z, which the tokenizer lower-cases itself but for its special tokens, and ASCII white space only.
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document, longest first."""
    lengths = [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if tokens % longest >> b & 1]
    return list(zip(np.cumsum([0, *lengths]).tolist(), lengths, strict=False))


def pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", longest: int = 4096, end: int = 2) -> DataFrame:
    """One row per piece: the columns of docs but for the text, then start, length, ids (little-endian uint32) and doc_tokens.

    A document's ids are its tokens and then `end`; null and empty texts have that one id. Input columns named like a result
    are replaced; repeated rows are documents of their own; an empty table gives an empty result.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    plain = without(short_batches(docs), RESULTS)
    kept = [c for c in plain.columns if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, others = batch.column(text_col), batch.select(kept)
            for i in range(0, batch.num_rows, 200):
                row, start, length, total, ids = [], [], [], [], []
                for j, text in enumerate(texts[i : i + 200].to_pylist()):
                    coded = encode((text or "").encode()) + last
                    for s, k in cuts(len(coded) // 4, longest):
                        row.append(i + j)
                        start.append(s)
                        length.append(k)
                        ids.append(coded[4 * s : 4 * (s + k)])
                        total.append(len(coded) // 4)
                columns = others.take(pa.array(row, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], [*kept, "start", "length", "ids", "doc_tokens"])

    schema = T.StructType([*(plain.schema[c] for c in kept), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])
    return plain.mapInArrow(cut, schema)


def sequences(cut: DataFrame, order: list[str], chunks: int = 256) -> DataFrame:
    """Add sequence_id and offset to pieces: shorter buckets first, ids without gaps from 0, one sequence for each piece.

    Within a bucket pieces are ordered by a hash of `order`, which should tell pieces apart; pieces equal in it are
    interchangeable. A bucket is numbered in `chunks` parts, whose offsets come from a table of (buckets x chunks) counts at
    most: that bound holds for what is broadcast.
    """
    cut = saved(cut.withColumn("_cq_at", F.xxhash64(*order)))
    cut = cut.withColumn("_cq_chunk", F.pmod("_cq_at", F.lit(chunks)).cast("int"))
    counts = cut.groupBy("length", "_cq_chunk").agg(F.count(F.lit(1)).alias("_cq_rows"))
    before = F.sum("_cq_rows").over(W.orderBy("length", "_cq_chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "_cq_chunk", F.coalesce(before, F.lit(0)).alias("_cq_start"))
    at = F.row_number().over(W.partitionBy("length", "_cq_chunk").orderBy("_cq_at", *order))
    numbered = cut.withColumn("_cq_row", at).join(F.broadcast(starts), ["length", "_cq_chunk"])
    return numbered.withColumn("sequence_id", F.col("_cq_start") + F.col("_cq_row") - 1).withColumn("offset", F.lit(0).cast("long")).drop("_cq_at", "_cq_chunk", "_cq_row", "_cq_start")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 4096, end: int = 2) -> DataFrame:
    """Pieces with their token ids and their sequences; see pieces() and sequences()."""
    return sequences(pieces(docs, tokenizer, text_col, longest, end), [id_col, "start", "length", "doc_tokens", "ids"])


def unpack(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The token ids of each document again, as an array: pieces joined in order. Ids must be unique."""
    @F.pandas_udf("array<long>")
    def numbers(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.frombuffer(x, "<u4").astype(np.int64))

    rows = packed.withColumn("_cq_ids", numbers("ids"))
    return rows.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "_cq_ids"))), lambda x: x["_cq_ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pack documents and return each piece with a checksum in place of its ids; only the checksums are shuffled."""
    cut = pieces(docs.select("doc_id", "text"), tokenizer or default_tokenizer())
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return sequences(cut, ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["Encoder", "cuts", "digest", "pack", "pieces", "query", "sequences", "unpack"]
