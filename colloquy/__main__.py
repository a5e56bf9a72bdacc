"""Command line: python -m colloquy COMMAND ... runs one stage of the study over files.

Inputs are the delimited text tables (or Parquet where a stage's own output is read); outputs are Parquet folders, or text where
the layout is the result.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import tokens
from colloquy.functions.urls import positive
from colloquy.operators import behavior, corpus, evaluate, graph, html, instances, learn
from colloquy.plans import study
from colloquy.plans.lineage import saved
from colloquy.sources import text as S


def _tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, threads and comments of a study's folder; records that do not parse are left out."""
    return S.read_groups(spark, f"{base}/groups")[0], S.read_threads(spark, f"{base}/topics")[0], S.read_comments(spark, f"{base}/comments")[0]


def _write(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def crawl(spark, a) -> None:
    """Pages within a depth of a start URL, over pages that were fetched before."""
    pages = spark.read.parquet(a.pages)
    links = html.links(pages).select(F.col("url").alias("src"), F.col("target").alias("dst"))
    near = graph.bfs(links, spark.createDataFrame([(a.url,)], "node string"), positive(a.depth))
    found = pages.join(near, pages.url == near.node, "left_semi")
    _write(found if a.key is None else found.where(html.has_keyword("html", a.key)), a.out)


def topic_crawler(spark, a) -> None:
    pages = spark.read.parquet(a.pages)
    _write(html.extract_groups(pages, "url"), f"{a.out}/groups")
    _write(html.extract_topics(pages, "url"), f"{a.out}/topics")


def comment_crawler(spark, a) -> None:
    _write(html.extract_comments(spark.read.parquet(a.pages), "url"), a.out)


def prepare_train_test(spark, a) -> None:
    _, threads, comments = _tables(spark, a.base)
    _write(study.split(threads, comments), a.out)


def _users(dataset: DataFrame) -> DataFrame:
    return behavior.commenters(dataset).union(dataset.select("user_id")).distinct()


def gen_user_behavior(spark, a) -> None:
    _, threads, comments = _tables(spark, a.base)
    counts = behavior.behaviour(_users(spark.read.parquet(a.dataset)), threads, comments, *behavior.STUDY["train"])
    _write(behavior.active(counts), a.out)


def gen_user_interest(spark, a) -> None:
    groups, threads, comments = _tables(spark, a.base)
    users, topics = study.interest(threads, comments, groups, a.topics, a.passes, a.seed)
    _write(users, f"{a.out}/users")
    _write(topics, f"{a.out}/topics")


def user(spark, a) -> None:
    """Follow edges from paged lists (user_id, page, neighbours)."""
    _write(S.union_pages(spark.read.parquet(a.pages)), a.out)


def prepare_corpus(spark, a) -> None:
    groups, threads, comments = _tables(spark, a.base)
    _write(corpus.corpus(groups, threads, comments if a.comments else None, a.group), a.out)


def train_lda(spark, a) -> None:
    docs = saved(spark.read.parquet(a.corpus).withColumn("tokens", tokens("text")))
    vectors = corpus.fit_vectors(docs)
    S.save_model(vectors, f"{a.out}/vectors")
    corpus.save_dictionary(corpus.dictionary(docs), f"{a.out}/dictionary")
    model = corpus.train_topics(docs, vectors, positive(a.topics), positive(a.passes), a.seed)
    S.save_model(model, f"{a.out}/topics")
    _write(corpus.topic_terms(vectors, model), f"{a.out}/terms")


def gen_instance(spark, a) -> None:
    dataset, read = spark.read.parquet(a.dataset), spark.read.parquet
    counts = read(a.behaviour)
    rows = study.build(dataset, counts.select("user_id"), counts, read(a.edges), read(f"{a.interest}/users"), read(f"{a.interest}/topics"), a.site, a.images, a.ratio, a.runs, a.seed)
    _write(rows, a.out)


def svm_training(spark, a) -> None:
    """Fit on the training rows of one run, score its test rows; bagged for unbalanced labels."""
    rows = saved(spark.read.parquet(a.instances).where(F.col("run") == a.run))
    train, names = rows.where("split = 'train'"), instances.FEATURES
    test = learn.min_max(rows.where("split = 'test'"), names, train)
    scaled = learn.min_max(train, names)
    if a.bagged:
        scored = learn.predict_bagged(learn.fit_bagged(scaled, names, ["topic_id", "user_id"], cost=a.cost), test, names, ["topic_id", "user_id"])
    else:
        scored = learn.predict(learn.fit_logistic(scaled, names, a.cost), test, names)
    _write(scored.select("topic_id", "user_id", "label", "prob"), a.out)


def prediction_statics(spark, a) -> None:
    at = evaluate.precision_at_k(spark.read.parquet(a.scores), ["topic_id"])
    at.withColumn("R", F.lit(a.ratio)).withColumn("run", F.lit(a.run)).write.mode("append").partitionBy("R", "run", "K").parquet(a.out)


def draw_precision(spark, a) -> None:
    """The data of the charts: mean precision over runs per topic and K, its histogram, and its points in order."""
    mean = saved(evaluate.mean_precision(S.scan_results(spark, a.results, R=a.ratio), ["topic_id", "K"], a.runs))
    _write(mean, f"{a.out}/mean")
    _write(evaluate.histogram(mean), f"{a.out}/histogram")
    _write(evaluate.series(mean), f"{a.out}/series")


def remove_line_feed(spark, a) -> None:
    S.normalise(spark, a.source, a.out)


def buildtree(spark, a) -> None:
    _, _, comments = _tables(spark, a.base)
    edges, lost = graph.comment_tree(comments)
    _write(edges, f"{a.out}/edges")
    _write(lost, f"{a.out}/missing")


#: Commands: the function, then its options as (name, type, default); a default of ... is required.
COMMANDS = {
    "main": (crawl, [("url", str, ...), ("pages", str, ...), ("depth", int, 2), ("key", str, None)]),
    "topic_crawler": (topic_crawler, [("pages", str, ...)]),
    "comment_crawler": (comment_crawler, [("pages", str, ...)]),
    "prepare_train_test": (prepare_train_test, [("base", str, ...)]),
    "gen_user_behavior": (gen_user_behavior, [("base", str, ...), ("dataset", str, ...)]),
    "gen_user_interest": (gen_user_interest, [("base", str, ...), ("topics", int, 30), ("passes", int, 20), ("seed", int, 42)]),
    "user": (user, [("pages", str, ...)]),
    "prepare_corpus": (prepare_corpus, [("base", str, ...), ("group", str, "0"), ("comments", bool, False)]),
    "train_lda": (train_lda, [("corpus", str, ...), ("topics", int, ...), ("passes", int, ...), ("seed", int, 42)]),
    "gen_instance": (gen_instance, [("dataset", str, ...), ("behaviour", str, ...), ("edges", str, ...), ("interest", str, ...), ("site", str, ...), ("images", str, ...), ("ratio", int, 10), ("runs", int, 5), ("seed", int, 1)]),
    "svm_training": (svm_training, [("instances", str, ...), ("run", int, 0), ("cost", float, 1.0), ("bagged", bool, False)]),
    "prediction_statics": (prediction_statics, [("scores", str, ...), ("ratio", int, 10), ("run", int, 0)]),
    "draw_precision": (draw_precision, [("results", str, ...), ("ratio", int, 10), ("runs", int, 5)]),
    "remove_line_feed": (remove_line_feed, [("source", str, ...)]),
    "buildtree": (buildtree, [("base", str, ...)]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        one = commands.add_parser(name, help=run.__doc__)
        for option, kind, default in [*options, ("out", str, ...)]:
            if kind is bool:
                one.add_argument(f"--{option}", action="store_true")
            else:
                one.add_argument(f"--{option}", type=kind, required=default is ..., default=None if default is ... else default)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command][0](SparkSession.builder.appName(f"colloquy {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
