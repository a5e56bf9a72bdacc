"""The whole study: split threads, count behaviour, build the graph and interests, sample candidates, learn, evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import segment, tokens
from colloquy.operators import behavior, corpus, evaluate, graph, instances, learn, relational
from colloquy.plans.lineage import saved


def split(threads: DataFrame, comments: DataFrame, windows: dict | None = None, least: int = 5) -> DataFrame:
    """Threads with split, comment_ids and commenters: the dataset layout."""
    w = windows or behavior.STUDY
    kept = behavior.split_commenters(threads, comments, w["train"], w["test"], w["comments_until"], least)
    said = comments.where(behavior.in_window(F.col("pubdate"), w["train"][0], w["comments_until"]))
    full = relational.with_children(kept.drop("comment_ids"), said, "topic_id", "comment_id", "user_id")
    return full.withColumnsRenamed({"comment_set": "comment_ids", "user_set": "commenters"})


def interest(threads: DataFrame, comments: DataFrame, groups: DataFrame, k: int, max_iter: int, seed: int, stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, interest) and (topic_id, interest): topic distributions of users' and threads' texts. One tokenizer for both."""
    tokenised = lambda d: d.withColumn("tokens", tokens(segment("text"), stop_words))
    docs = tokenised(corpus.corpus(groups, threads, comments))
    vectors = corpus.fit_vectors(docs)
    model = corpus.train_topics(docs, vectors, k, max_iter, seed)
    users = corpus.topic_distribution(tokenised(corpus.interest_text(comments, threads)), vectors, model, k)
    topics = corpus.topic_distribution(tokenised(threads.select("topic_id", F.concat_ws(" ", "title", "content").alias("text"))), vectors, model, k)
    return users.select("user_id", F.col("topics").alias("interest")), topics.select("topic_id", F.col("topics").alias("interest"))


def funnel(steps: dict[str, DataFrame]) -> DataFrame:
    """A13. Rows at each step, one row per step."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n") for i, (name, d) in enumerate(steps.items())])


def build(dataset: DataFrame, users: DataFrame, behaviour: DataFrame, edges: DataFrame, user_interest: DataFrame, thread_interest: DataFrame, site: str, image_host: str, ratio: int = 10, runs: int = 5, seed: int = 1, least: int = 5) -> DataFrame:
    """M10. Instances of all runs, keyed by (run, split, topic_id, user_id); a run is a seed."""
    pairs = dataset.select("topic_id", F.col("user_id").alias("creator_id"), F.explode("commenters").alias("user_id"))
    true = saved(instances.usable_threads(pairs, users, least))
    degrees, mutual = saved(graph.degrees(edges)), saved(graph.mutual_following(edges))
    content = instances.content_features(dataset, site, image_host)
    out = []
    for run in range(runs):
        drawn = instances.candidates(true, users, ratio, seed + run)
        out.append(instances.instances(drawn, content, behaviour, degrees, edges, mutual, user_interest, thread_interest).withColumn("run", F.lit(run)))
    return reduce(DataFrame.unionByName, out).join(dataset.select("topic_id", "split"), "topic_id")


def evaluate_runs(rows: DataFrame, ratio: int, cost: float = 1.0) -> DataFrame:
    """M15, B2. For each run: scale by the training rows, fit, score the test rows, precision at every K. Scores stay on their
    (topic, user) key throughout."""
    out = []
    for run in [r[0] for r in rows.select("run").distinct().orderBy("run").collect()]:
        one = saved(rows.where(F.col("run") == run))
        train = one.where("split = 'train'")
        model = learn.fit_logistic(learn.min_max(train, instances.FEATURES), instances.FEATURES, cost)
        scored = learn.predict(model, learn.min_max(one.where("split = 'test'"), instances.FEATURES, train), instances.FEATURES)
        out.append(evaluate.precision_at_k(scored, ["topic_id"]).withColumn("run", F.lit(run)).withColumn("R", F.lit(ratio)))
    return reduce(DataFrame.unionByName, out)
