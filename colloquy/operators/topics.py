"""Online variational LDA over tables: vocabulary and topic weights are rows by token, never on the driver.

The steps are those of Hoffman, Blei and Bach (2010) with the settings of Spark ML: mini-batches of a twentieth of the documents, offset
1,024, decay 0.51, weights drawn from Gamma(100, 1/100), document concentrations fitted. What Spark draws by partition follows from hashes
here, so results don't depend on how rows are dealt. A document is inferred in a block of BLOCK, beside the weights of the block's words.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from colloquy.plans.lineage import scratch, written

#: Documents that are inferred at once.
BLOCK = 2048
#: A batch's share of the documents, in millionths; offset and decay of the step size; change of a document's topics that ends its inference.
SHARE, OFFSET, DECAY, CHANGE = 50_000, 1024, 0.51, 1e-3


class _Stored:
    """Saved as models are: write().overwrite().save(path)."""

    def write(self):
        return self

    def overwrite(self):
        return self


@dataclass
class Vocabulary(_Stored):
    """Known tokens (token, df)."""

    vocabulary: DataFrame

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> Vocabulary:
        return Vocabulary(_active().read.parquet(path))


@dataclass
class Topics(_Stored):
    """Weights of each token in each topic (token, w0, w1, ...), their sums by topic, and the document concentrations."""

    weights: DataFrame
    totals: list[float]
    alpha: list[float]

    def vocabSize(self) -> int:
        return self.weights.count()

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.weights.sparkSession.createDataFrame([(self.totals, self.alpha)], "totals array<double>, alpha array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/topics")

    @staticmethod
    def load(path: str) -> Topics:
        spark = _active()
        row = spark.read.parquet(f"{path}/topics").first()
        return Topics(spark.read.parquet(f"{path}/weights"), list(row.totals), list(row.alpha))


def _active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session")
    return spark


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        low = x < 6
        out = out - np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        low = x < 6
        out = out + np.where(low, 1 / (x * x), 0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def _expectation(gamma: np.ndarray) -> np.ndarray:
    return digamma(gamma) - digamma(gamma.sum(axis=-1, keepdims=True))


def infer(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topics of documents (gamma), and the sums of counts by word and topic. Document d has the words ids[starts[d]:starts[d + 1]], one at
    least. Each document runs until its own topics change by less than CHANGE, whatever others there are."""
    n, k = len(starts) - 1, beta.shape[1]
    gamma, going, lengths = np.ones((n, k)), np.arange(n), np.diff(starts)
    b, c, first, of = beta[ids], counts.astype(float), starts[:-1], np.repeat(np.arange(n), lengths)
    last, theta = gamma, np.exp(_expectation(gamma))
    while len(going):
        ratio = c / (np.einsum("ij,ij->i", theta[of], b) + 1e-100)
        now = alpha + theta * np.add.reduceat(ratio[:, None] * b, first, axis=0)
        theta, moved = np.exp(_expectation(now)), np.abs(now - last).mean(axis=1) > CHANGE
        gamma[going], last = now, now
        if not moved.all():
            stays = moved[of]
            going, last, theta, b, c = going[moved], now[moved], theta[moved], b[stays], c[stays]
            size = lengths[going]
            first, of = np.cumsum(size) - size, np.repeat(np.arange(len(going)), size)
    of, theta = np.repeat(np.arange(n), lengths), np.exp(_expectation(gamma))
    b = beta[ids]
    ratio = counts / (np.einsum("ij,ij->i", theta[of], b) + 1e-100)
    sums = np.stack([np.bincount(ids, theta[of, j] * ratio, len(beta)) for j in range(k)], axis=1) * beta
    return gamma, sums


def _bags(texts: pa.ChunkedArray, words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known words of token lists in JSON: ids, counts and starts of the documents that have any, and which ones these are."""
    lists = [json.loads(t) if t else [] for t in texts.to_pylist()]
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    found = pc.fill_null(pc.index_in(pa.array(chain.from_iterable(lists), pa.string()), value_set=words.combine_chunks()), -1).to_numpy(zero_copy_only=False)
    pairs, counts = np.unique((of * (len(words) + 1) + found)[found >= 0], return_counts=True)
    docs, ids = np.divmod(pairs, len(words) + 1)
    some, starts = np.unique(docs, return_index=True)
    return ids, counts, np.append(starts, len(docs)), some


def _beta(words: pa.Table, k: int, totals: list[float]) -> np.ndarray:
    return np.exp(digamma(np.stack([words[f"w{j}"].to_numpy() for j in range(k)], axis=1)) - digamma(np.array(totals)))


def _first(k: int, seed: int) -> list[Column]:
    """A token's first weights: Gamma(100, 1/100) by Wilson and Hilferty from normal values of its hash."""
    u = lambda n: (F.shiftrightunsigned(F.xxhash64("token", F.lit(seed), F.lit(n)), 11).cast("double") + 0.5) / float(1 << 53)
    normal = lambda j: F.sqrt(-2 * F.ln(u(2 * j))) * F.cos(2 * math.pi * u(2 * j + 1))
    return [F.pow(1 - 1 / 900 + normal(j) / 30, F.lit(3.0)) for j in range(k)]


def _document(frame: DataFrame, tokens: str) -> Column:
    """A number that tells documents apart, from all their columns but the tokens, if there are others."""
    return F.xxhash64(*([c for c in frame.columns if c != tokens] or [tokens]))


def _beside(docs: DataFrame, weights: DataFrame, n: int):
    """Blocks of documents (_doc, _tokens, ...), each with the weights of its words."""
    dealt = docs.withColumn("_block", F.pmod(F.col("_doc"), F.lit(max(1, math.ceil(n / BLOCK)))))
    words = dealt.select(F.col("_block").alias("_at"), F.explode(F.from_json("_tokens", "array<string>")).alias("token")).distinct().join(weights, "token")
    return dealt.groupBy("_block").cogroup(words.groupBy("_at"))


def train(docs: DataFrame, words: DataFrame, k: int, passes: int, seed: int, tokens: str = "tokens") -> Topics:
    """One job a pass over its batch. Words that no batch had follow from their first weights, so only the others are kept: a pass adds its
    sums to those of the passes before, and the whole table of weights is written once."""
    n, names = docs.count(), [f"s{j}" for j in range(k)]
    first = words.select("token", *(x.alias(f"f{j}") for j, x in enumerate(_first(k, seed))))
    size, *totals = words.agg(F.count(F.lit(1)), *(F.sum(x) for x in _first(k, seed))).first()
    totals, alpha, eta = np.array([x or 0.0 for x in totals]), np.full(k, 1 / k), 1 / k
    drawn = F.filter(F.array(*(F.lit(i) for i in range(1, passes + 1))), lambda i: F.pmod(F.xxhash64("_doc", i, F.lit(seed)), F.lit(1_000_000)) < SHARE)
    path = scratch(docs.sparkSession)
    numbered = docs.withColumn("_doc", _document(docs, tokens)).withColumn("_pass", F.explode(drawn))
    numbered.select("_doc", "_pass", F.to_json(tokens).alias("_tokens")).write.partitionBy("_pass").parquet(path)
    batches = docs.sparkSession.read.schema("_doc long, _tokens string, _pass int").parquet(path)
    sums, kept, base = None, 1.0, 0.0
    for i in range(1, passes + 1):
        rate = (OFFSET + i) ** -DECAY
        now = first if sums is None else first.join(sums, "token", "left").na.fill(0.0, names)
        weights = now.select("token", *((F.col(f"f{j}") * kept + base + (0.0 if sums is None else F.col(f"s{j}"))).alias(f"w{j}") for j in range(k)))
        step = _step(k, totals.tolist(), alpha.tolist())
        new = _beside(batches.where(F.col("_pass") == i).drop("_pass"), weights, n * SHARE // 1_000_000).applyInArrow(step, f"kind int, token string, n long, {', '.join(f'{s} double' for s in names)}")
        scale = F.when(F.col("kind") == 0, rate * n / math.ceil(n * SHARE / 1_000_000)).otherwise(1.0)
        new = new.select("kind", "token", "n", *((F.col(s) * scale).alias(s) for s in names))
        if sums is not None:
            new = new.unionByName(sums.select(F.lit(0).alias("kind"), "token", F.lit(0).cast("long").alias("n"), *((F.col(s) * (1 - rate)).alias(s) for s in names)))
        table = written(new.groupBy("kind", "token").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)))
        said = {r.kind: r for r in table.where("kind > 0").collect()}
        if not said:  # no document with known words in this batch
            continue
        sums, kept, base = table.where("kind = 0").select("token", *names), kept * (1 - rate), base * (1 - rate) + rate * eta
        totals = (1 - rate) * totals + rate * (np.array([said[2][s] for s in names]) * n / math.ceil(n * SHARE / 1_000_000) + size * eta)
        alpha = _concentration(alpha, np.array([said[1][s] for s in names]) / said[1].n, said[1].n, rate)
    now = first if sums is None else first.join(sums, "token", "left").na.fill(0.0, names)
    weights = now.select("token", *((F.col(f"f{j}") * kept + base + (0.0 if sums is None else F.col(f"s{j}"))).alias(f"w{j}") for j in range(k)))
    return Topics(written(weights), totals.tolist(), alpha.tolist())


def _step(k: int, totals: list[float], alpha: list[float]):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Sums by word (kind 0), of the expected log topics of documents (1), and of all words (2)."""
        kinds, tokens, n, rows = np.zeros(0, "int32"), [], np.zeros(0, "int64"), np.zeros((0, k))
        if len(words):
            beta = _beta(words, k, totals)
            ids, counts, starts, some = _bags(docs["_tokens"], words["token"])
            gamma, sums = infer(ids, counts, starts, beta, np.array(alpha))
            rows = np.vstack([sums, _expectation(gamma).sum(axis=0), sums.sum(axis=0)])
            kinds, tokens = np.array([0] * len(words) + [1, 2], "int32"), [*words["token"].to_pylist(), None, None]
            n = np.where(kinds == 1, len(some), 0)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "token": pa.array(tokens, pa.string()), "n": pa.array(n, pa.int64()), **{f"s{j}": pa.array(rows[:, j], pa.float64()) for j in range(k)}})

    return run


def _concentration(alpha: np.ndarray, mean: np.ndarray, n: int, rate: float) -> np.ndarray:
    """A Newton step of the document concentrations, unless it leaves the positive ones."""
    gradient = n * (mean - _expectation(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - rate * (gradient - b) / q
    return new if (new > 0).all() else alpha


def distribution(docs: DataFrame, model: Topics, k: int, tokens: str = "tokens") -> DataFrame:
    """Documents with their topics."""
    totals, alpha = model.totals, model.alpha

    def run(part: pa.Table, words: pa.Table) -> pa.Table:
        topics = np.full((len(part), k), 1 / k)
        if len(words):
            ids, counts, starts, some = _bags(part["_tokens"], words["token"])
            gamma, _ = infer(ids, counts, starts, _beta(words, k, totals), np.array(alpha))
            topics[some] = gamma / gamma.sum(axis=1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(topics.ravel(), pa.float64()))
        return part.drop_columns(["_doc", "_block"]).append_column("topics", lists)

    others = [c for c in docs.columns if c != tokens]
    given = docs.withColumn("_doc", _document(docs, tokens)).select(*others, F.to_json(tokens).alias("_tokens"), "_doc")
    schema = given.drop("_doc").schema.add("topics", ArrayType(DoubleType()))
    out = _beside(given, model.weights, docs.count()).applyInArrow(run, schema)
    return out.withColumn(tokens, F.from_json("_tokens", "array<string>")).select(*docs.columns, "topics")
