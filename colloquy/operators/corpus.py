"""Corpora, dictionaries and topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import remove_urls
from colloquy.operators import topics
from colloquy.plans.lineage import written


def corpus(groups: DataFrame, threads: DataFrame, comments: DataFrame | None = None, group_key: str = "0") -> DataFrame:
    """A11, A12. (doc_key, text): title + content (+ each comment in order) of every thread, and the group's description under
    its own key. URLs are taken out of each part first (B11)."""
    head = threads.select(F.col("topic_id").alias("doc_key"), F.concat_ws(" ", remove_urls(F.coalesce("title", F.lit(""))), remove_urls(F.coalesce("content", F.lit("")))).alias("text"))
    if comments is not None:
        said = comments.groupBy(F.col("topic_id").alias("doc_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pubdate", "comment_id", F.coalesce(remove_urls("content"), F.lit("")).alias("x")))), lambda c: c["x"]), " ").alias("said"))
        head = head.join(said, "doc_key", "left").select("doc_key", F.concat_ws(" ", "text", "said").alias("text"))
    return groups.select(F.lit(group_key).alias("doc_key"), remove_urls("description").alias("text")).unionByName(head)


def doc_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A8. Documents that have each token. Order by df descending, then token."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bag_of_words(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """A9, M2."""
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def dictionary(docs: DataFrame, tokens: str = "tokens", least: int = 1, most: float = 0.8) -> DataFrame:
    """M1. Tokens in `least` documents or more and in at most that share of all."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return doc_frequency(docs, tokens).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n"))).select("token", "df")


def fit_vectors(docs: DataFrame, tokens: str = "tokens", least: float = 1.0, most: float = 0.8) -> topics.Vocabulary:
    """M1, M2. The whole vocabulary, as a table. Bounds below 1 are shares of the documents, others are numbers of them."""
    n = docs.count()
    low, high = (x if x >= 1 else x * n for x in (least, most))
    return topics.Vocabulary(written(doc_frequency(docs, tokens).where((F.col("df") >= low) & (F.col("df") <= high))))


def train_topics(docs: DataFrame, vectors: topics.Vocabulary, k: int, max_iter: int = 20, seed: int = 42) -> topics.Topics:
    """M3. Online variational LDA."""
    return topics.train(docs, vectors.vocabulary, k, max_iter, seed)


def topic_distribution(docs: DataFrame, vectors: topics.Vocabulary, model: topics.Topics, k: int) -> DataFrame:
    """M4. Add topics, k probabilities; a document without known words gets 1/k for each. The model's weights have a row for each token of
    vectors."""
    return topics.distribution(docs, model, k)


def topic_terms(vectors: topics.Vocabulary, model: topics.Topics, n: int = 10) -> DataFrame:
    """M5, T5. The n heaviest terms of each topic; of equal ones the first by name."""
    one = [F.struct(F.lit(j).alias("topic"), (F.col(f"w{j}") / total).alias("weight")) for j, total in enumerate(model.totals)]
    rows = model.weights.select(F.col("token").alias("term"), F.explode(F.array(*one)).alias("t")).select("t.topic", "term", "t.weight")
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", (F.col("rank") - 1).alias("rank"), "term", "weight")


def interest_text(comments: DataFrame, threads: DataFrame, authored: bool = False) -> DataFrame:
    """J5, B13. A user's text: the texts of the threads that they commented on, each once, in thread order (with their own
    threads too if authored)."""
    pairs = comments.select("user_id", "topic_id")
    if authored:
        pairs = pairs.union(threads.select("user_id", "topic_id"))
    texts = threads.select("topic_id", F.concat_ws(" ", "title", "content").alias("text"))
    joined = pairs.distinct().join(texts, "topic_id")
    return joined.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "text"))), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_topics"))


def interest_bags(comments: DataFrame, threads: DataFrame, tokens: str = "tokens") -> DataFrame:
    """J5, M2. A user's bag of words (user_id, token, tf) over the threads that they commented on, each once. A user's text is never
    one row: counts are summed map-side by user and token."""
    bags = bag_of_words(threads, "topic_id", tokens)
    pairs = comments.select("user_id", "topic_id").distinct()
    return pairs.join(bags, "topic_id").groupBy("user_id", "token").agg(F.sum("tf").alias("tf"))


def token_summary(docs: DataFrame, stop_words: list[str], raw: str = "raw", tokens: str = "tokens") -> DataFrame:
    """A22. One row: documents, tokens before and after filtering, how many of them were stop words, documents without tokens."""
    stops = F.size(F.filter(raw, lambda t: t.isin(*stop_words))) if stop_words else F.lit(0)
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(raw).cast("bigint")).alias("raw_tokens"), F.sum(F.size(tokens).cast("bigint")).alias("kept_tokens"),
        F.sum(stops.cast("bigint")).alias("stop_tokens"), F.sum((F.size(tokens) == 0).cast("bigint")).alias("empty_documents"),
    )


def save_dictionary(words: DataFrame, path: str) -> None:
    """S18. A dictionary (token, df) as Parquet, with its ids: the order of tokens."""
    words.select("token", "df").write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S18."""
    return spark.read.schema("token string, df bigint").parquet(path)


def save_bags(bags: DataFrame, path: str) -> None:
    """S18. A corpus as (doc_key, token, tf) rows: the coordinates of a sparse matrix."""
    bags.write.mode("overwrite").parquet(path)


def load_vectors(path: str) -> topics.Vocabulary:
    """S18. A fitted vocabulary, as save_model() wrote it."""
    return topics.Vocabulary.load(path)


def load_topics(path: str) -> topics.Topics:
    """S18. A fitted topic model, as save_model() wrote it."""
    return topics.Topics.load(path)
