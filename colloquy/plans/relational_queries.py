"""Queries over threads (orders), comments (lineitem), users (supplier, customer), behaviour (events) and the follow graph, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import in_window
from colloquy.operators import behavior, evaluate, graph, instances, learn, relational
from colloquy.sources import text as text_sources

TRAIN, TEST, UNTIL = ("1995-01-01", "1999-01-01"), ("1999-01-01", "2002-01-01"), "2002-06-01"
SITE, IMAGES = "www.example.com", "img.example.com"


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def threads(spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("topic_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("pubdate"))


def comments(spark, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("topic_id"), F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").alias("pubdate"))


def users(spark, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))


def edges(spark, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def split_commenters(spark, sf):
    return behavior.split_commenters(threads(spark, sf), comments(spark, sf), TRAIN, TEST, UNTIL).select("topic_id", "split", "n_commenters")


SPLIT = f"""
t AS (SELECT o_orderkey AS topic_id, o_custkey AS user_id, CASE WHEN o_orderdate >= '{TRAIN[0]}' AND o_orderdate < '{TRAIN[1]}' THEN 'train' WHEN o_orderdate >= '{TEST[0]}' AND o_orderdate < '{TEST[1]}' THEN 'test' END AS split FROM orders),
c AS (SELECT l_orderkey AS topic_id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_shipdate >= '{TRAIN[0]}' AND l_shipdate < '{UNTIL}' GROUP BY 1),
s AS (SELECT t.topic_id, t.split, coalesce(c.n, 0) AS n_commenters FROM t LEFT JOIN c USING (topic_id) WHERE split IS NOT NULL AND (split = 'train' OR coalesce(c.n, 0) >= 5))"""


def split_totals(spark, sf):
    return behavior.split_totals(split_commenters(spark, sf))


def behaviour_counts(spark, sf, start="2024-01-05", end="2024-01-20"):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("pubdate"))
    return behavior.behaviour(e.select("user_id"), e.where("event_type = 'signup'"), e.where("event_type = 'click'"), start, end)


def _behaviour_sql(start, end):
    return f"SELECT user_id, count(*) FILTER (event_type = 'click' AND ts >= '{start}' AND ts < '{end}') AS num_comments, count(*) FILTER (event_type = 'signup' AND ts >= '{start}' AND ts < '{end}') AS num_topics FROM events GROUP BY user_id"


def active_users(spark, sf):
    return behavior.active(behaviour_counts(spark, sf, "2024-01-10", "2024-01-11"))


def mutual_following(spark, sf):
    return graph.mutual_following(edges(spark, sf))


def degree_stats(spark, sf):
    d = graph.degrees(edges(spark, sf))
    known = d.select(F.when(F.col("following") > 0, F.col("following")).otherwise(-1).alias("following"), F.when(F.col("followers") > 0, F.col("followers")).otherwise(-1).alias("followers"))
    stats = graph.graph_stats(known, edges(spark, sf))
    return stats.select("users", "edges", "following_unset", "followers_unset", *(F.round(c, 6).alias(c) for c in ("following_mean", "followers_mean", "following_mean_known", "followers_mean_known")), F.round("density", 9).alias("density"))


def is_following(spark, sf):
    pairs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))).alias("dst"))
    return graph.is_following(pairs, edges(spark, sf))


def _keys(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def union_users(spark, sf):
    return relational.union_users(*_keys(spark, sf))


def intersect_users(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


def except_users(spark, sf):
    a, b = _keys(spark, sf)
    return b.subtract(a)


def subset_check(spark, sf):
    return relational.subset_report(*_keys(spark, sf))


def anti_threads(spark, sf):
    return relational.not_yet(threads(spark, sf), comments(spark, sf), "topic_id").select("topic_id")


def semi_comments(spark, sf):
    kept = threads(spark, sf).where(in_window(F.col("pubdate"), *TRAIN))
    return relational.of_known(comments(spark, sf), kept, "topic_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def keyed_union(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return relational.keyed_union([a, b], ["uid"], ["name"])


def last_wins(spark, sf):
    return relational.last_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def add_title(spark, sf):
    titles = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("title"))
    return relational.add_title(threads(spark, sf), titles, "user_id", ["title"]).select("topic_id", "user_id", "title")


def topk_per_thread(spark, sf):
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))]
    return relational.top_k(table(spark, sf, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "rank")


def _scored(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("user_id"), F.col("value").alias("prob"), (F.col("event_type") == "purchase").cast("int").alias("label"))


def precision(spark, sf):
    return evaluate.precision_at_k(_scored(spark, sf), ["topic_id"]).withColumn("precision", F.round("precision", 6))


PRECISION = """
r AS (SELECT user_id AS topic_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY user_id) AS n, (event_type = 'purchase')::INT AS hit FROM events),
k AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS "K"),
p AS (SELECT topic_id, "K", sum(CASE WHEN rk <= "K" THEN hit ELSE 0 END) / least("K", max(n))::DOUBLE AS precision FROM r, k GROUP BY topic_id, "K")"""


def mean_precision(spark, sf):
    return evaluate.mean_precision(evaluate.precision_at_k(_scored(spark, sf), ["topic_id"]), ["K"], None).withColumn("precision", F.round("precision", 6))


def histogram(spark, sf):
    return evaluate.histogram(evaluate.precision_at_k(_scored(spark, sf), ["topic_id"])).withColumn("top", F.round("top", 6))


def precision_series(spark, sf):
    return evaluate.series(evaluate.precision_at_k(_scored(spark, sf), ["topic_id"])).withColumn("precision", F.round("precision", 6))


def confusion(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") >= 1500, 1).otherwise(-1).alias("predicted"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return evaluate.confusion(rows, ["lang"]).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def _true(spark, sf):
    pairs = comments(spark, sf).select("topic_id", "user_id").join(threads(spark, sf).select("topic_id", F.col("user_id").alias("creator_id")), "topic_id")
    return instances.usable_threads(pairs, users(spark, sf))


TRUE = """
u AS (SELECT s_suppkey AS user_id FROM supplier),
tp AS (SELECT DISTINCT l_orderkey AS topic_id, o_custkey AS creator_id, l_suppkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey AND o_custkey IN (SELECT user_id FROM u) AND l_suppkey IN (SELECT user_id FROM u)),
tr AS (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n_true FROM tp QUALIFY count(*) OVER (PARTITION BY topic_id) >= 5),
nu AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '-42'), user_id) - 1 AS spot FROM u),
pn AS (SELECT n_users, (SELECT min(x) FROM range(2, 1000000) t(x) WHERE x >= n_users AND x < n_users + 400 AND NOT EXISTS (SELECT 1 FROM range(2, 2000) d(y) WHERE y * y <= x AND x % y = 0)) AS p FROM (SELECT count(*) AS n_users FROM u)),
th AS (
  SELECT DISTINCT topic_id, creator_id, n_true, n_users, p, ('0x' || substr(md5(topic_id || '-42'), 1, 15))::BIGINT % (p - 1) + 1 AS a, ('0x' || substr(md5(topic_id || '-42'), 16, 15))::BIGINT % p AS b
  FROM tr, pn),
ca AS (SELECT topic_id, creator_id, n_true, n_users, step, (a * step + b) % p AS spot FROM th, LATERAL (SELECT unnest(range(least(n_true * 10 + p - n_users, p))) AS step)),
ot AS (
  SELECT ca.topic_id, creator_id, nu.user_id, n_true, n_users, row_number() OVER (PARTITION BY ca.topic_id ORDER BY step) AS place
  FROM ca JOIN nu USING (spot) ANTI JOIN tr ON tr.topic_id = ca.topic_id AND tr.user_id = nu.user_id),
dr AS (
  SELECT topic_id, creator_id, user_id, 1 AS label FROM tr
  UNION ALL SELECT topic_id, creator_id, user_id, 0 FROM ot WHERE n_true * 10 >= n_users OR place <= 9 * n_true)"""


def candidates(spark, sf):
    return instances.candidates(_true(spark, sf), users(spark, sf), 10, 42)


def _content(spark, sf):
    o = table(spark, sf, "orders")
    image = F.when(F.col("o_orderstatus") == "F", "http://img.example.com/a.jpg").otherwise("http://www.example.com/b")
    title = F.concat(F.repeat(F.lit("订"), F.pmod("o_orderkey", F.lit(7)).cast("int")), F.col("o_orderpriority"))
    text = F.concat(F.repeat(F.lit("内容 "), F.pmod("o_custkey", F.lit(5)).cast("int")), image, F.when(F.pmod("o_orderkey", F.lit(3)) == 0, " http://other.example.org/x").otherwise(""), F.lit(" 好"))
    return instances.content_features(o.select(F.col("o_orderkey").alias("topic_id"), title.alias("title"), text.alias("content")), SITE, IMAGES)


CONTENT = """
co AS (SELECT o_orderkey AS topic_id, o_orderkey % 7 AS title_chars, 2 * (o_custkey % 5) + 1 AS content_chars, (o_orderstatus = 'F')::BIGINT AS images, (o_orderstatus = 'F' OR o_orderkey % 3 = 0)::BIGINT AS external_link FROM orders),
ed AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
fo AS (SELECT src AS node, count(*) AS n FROM ed GROUP BY 1),
fe AS (SELECT dst AS node, count(*) AS n FROM ed GROUP BY 1),
nt AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1999-01-01' GROUP BY 1),
nc AS (SELECT l_suppkey AS user_id, count(*) AS n FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1999-01-01' GROUP BY 1)"""


def _behaviour(spark, sf):
    return behavior.behaviour(union_users(spark, sf), threads(spark, sf), comments(spark, sf), *TRAIN)


def binary_features(spark, sf):
    rows = threads(spark, sf).select("topic_id", F.col("user_id").alias("creator_id"))
    return instances.thread_instances(rows, _behaviour(spark, sf), graph.degrees(edges(spark, sf)), _content(spark, sf)).select("topic_id", "creator_id", *instances.FEATURES[:8])


def _interest(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("interest"))


def instance_features(spark, sf):
    e, v = edges(spark, sf), _interest(spark, sf)
    rows = instances.instances(candidates(spark, sf), _content(spark, sf), _behaviour(spark, sf), graph.degrees(e), e, graph.mutual_following(e), v.withColumnRenamed("vec_id", "user_id"), v.withColumnRenamed("vec_id", "topic_id"))
    return rows.withColumn("thread_distance", F.round("thread_distance", 6)).withColumn("creator_distance", F.round("creator_distance", 6))


INSTANCES = f"""WITH {TRUE}, {CONTENT},
mu AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM ed x JOIN ed y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2)
SELECT dr.topic_id, dr.creator_id, dr.user_id, dr.label, title_chars, content_chars, images, external_link,
  coalesce(nt1.n, 0) AS creator_topics, coalesce(nc1.n, 0) AS creator_comments, coalesce(fo1.n, 0) AS creator_following, coalesce(fe1.n, 0) AS creator_followers,
  coalesce(nt2.n, 0) AS user_topics, coalesce(nc2.n, 0) AS user_comments,
  round(coalesce(list_distance(eu.embedding::DOUBLE[], et.embedding::DOUBLE[]), 0), 6) AS thread_distance, round(coalesce(list_distance(eu.embedding::DOUBLE[], ec.embedding::DOUBLE[]), 0), 6) AS creator_distance,
  coalesce(fo2.n, 0) AS user_following, coalesce(fe2.n, 0) AS user_followers, (ff.src IS NOT NULL)::INT AS follows_creator, coalesce(mu.n, 0) AS mutual
FROM dr JOIN co USING (topic_id)
LEFT JOIN nt nt1 ON nt1.user_id = dr.creator_id LEFT JOIN nc nc1 ON nc1.user_id = dr.creator_id LEFT JOIN fo fo1 ON fo1.node = dr.creator_id LEFT JOIN fe fe1 ON fe1.node = dr.creator_id
LEFT JOIN nt nt2 ON nt2.user_id = dr.user_id LEFT JOIN nc nc2 ON nc2.user_id = dr.user_id LEFT JOIN fo fo2 ON fo2.node = dr.user_id LEFT JOIN fe fe2 ON fe2.node = dr.user_id
LEFT JOIN embeddings eu ON eu.vec_id = dr.user_id LEFT JOIN embeddings et ON et.vec_id = dr.topic_id LEFT JOIN embeddings ec ON ec.vec_id = dr.creator_id
LEFT JOIN ed ff ON ff.src = dr.user_id AND ff.dst = dr.creator_id
LEFT JOIN mu ON mu.a = least(dr.user_id, dr.creator_id) AND mu.b = greatest(dr.user_id, dr.creator_id)"""


def bfs(spark, sf):
    return graph.bfs(edges(spark, sf), spark.range(1).toDF("node"), 5)


def minmax(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"), F.max(F.lit(1.0)).alias("constant"))
    return learn.min_max(rows.withColumn("n", F.col("n").cast("double")), ["quantity", "n", "constant"]).select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("quantity", "n", "constant")))


def ensemble(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.pmod("l_partkey", F.lit(5)).alias("model"), (F.col("l_discount") * 10).alias("prob"))
    return learn.ensemble_mean(rows, ["l_orderkey"]).select("l_orderkey", F.round("prob", 6).alias("prob"), F.when(F.round("prob", 6) >= 0.5, 1).otherwise(-1).alias("predicted"))


def label_ratio(spark, sf):
    return learn.label_counts(table(spark, sf, "labels"), "toxic")


def quote_match(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang", F.regexp_replace("text", "\n", "").alias("words"))
    found = relational.resolve_quotes(docs, docs, ["lang", "words"], "doc_id")
    return found.select("reply_id", F.coalesce("quoted_id", F.lit(-1)).alias("quoted_id"))


def quote_counts(spark, sf):
    found = quote_match(spark, sf)
    return found.agg(F.count(F.lit(1)).alias("replies"), F.count(F.when(F.col("quoted_id") >= 0, 1)).alias("resolved"))


def pages_complete(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "role", (F.col("turn") + 1).alias("page"))
    every = behavior.complete(turns, "conv_id", "page").withColumn("kind", F.lit("all"))
    return every.unionByName(behavior.complete(turns.where("role = 'user'"), "conv_id", "page").withColumn("kind", F.lit("user"))).select("kind", "conv_id", "n_pages", "complete")


def comment_distribution(spark, sf):
    return behavior.comment_distribution(threads(spark, sf), comments(spark, sf))


def missing_sources(spark, sf):
    u = _keys(spark, sf)[1]
    return relational.missing_counts(u, {"threads": threads(spark, sf), "events": table(spark, sf, "events"), "suppliers": users(spark, sf)})


def known_everywhere(spark, sf):
    u = _keys(spark, sf)[1]
    return relational.known_everywhere(u, [threads(spark, sf), table(spark, sf, "events"), users(spark, sf)])


def load_totals(spark, sf):
    return relational.totals(comments(spark, sf), threads(spark, sf), "topic_id")


def fold_sizes(spark, sf):
    rows = learn.bagging_folds(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), ["doc_id"], 5)
    return rows.groupBy(F.coalesce("fold", F.lit(-1)).alias("fold"), "label").agg(F.count(F.lit(1)).alias("n"))


def mean_precision_fixed(spark, sf):
    """Five runs: the rows of a topic by event number; a topic without a run in five still divides by five."""
    runs = _scored(spark, sf).withColumn("run", F.pmod("user_id", F.lit(5)))
    return evaluate.mean_precision(evaluate.precision_at_k(runs, ["topic_id", "run"]), ["topic_id", "K"]).withColumn("precision", F.round("precision", 6))


def commenter_sets(spark, sf):
    rows = relational.with_children(threads(spark, sf).select("topic_id"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("topic_id"), "l_partkey", "l_suppkey"), "topic_id", "l_partkey", "l_suppkey")
    return rows.select("topic_id", F.array_join(F.transform("comment_set", lambda x: x.cast("string")), ",").alias("comment_ids"), F.array_join(F.transform("user_set", lambda x: x.cast("string")), ",").alias("commenters"))


def dataset_users(spark, sf):
    sets = relational.with_children(threads(spark, sf).where(in_window(F.col("pubdate"), *TEST)).select("topic_id"), comments(spark, sf).withColumn("user_id", F.col("user_id").cast("string")), "topic_id", "topic_id", "user_id")
    blank = sets.withColumn("commenters", F.when(F.size("user_set") == 0, F.array(F.lit(""))).otherwise(F.col("user_set")))
    return behavior.commenters(blank)


def surrogate_index(spark, sf):
    return instances.surrogate_index(_keys(spark, sf)[1], 42)


def thread_labels(spark, sf):
    return instances.thread_label(threads(spark, sf), comments(spark, sf)).select("topic_id", "label")


def pair_labels(spark, sf):
    asked = threads(spark, sf).select("topic_id", F.pmod("topic_id", F.lit(9)).alias("user_id"))
    return instances.pair_label(asked, comments(spark, sf)).select("topic_id", "user_id", "label")


def group_filter(spark, sf):
    said = table(spark, sf, "customer").select(F.col("c_custkey").alias("comment_id"), F.col("c_mktsegment").alias("group_id"))
    return behavior.of_group(said, "BUILDING").select("comment_id")


def limit_pages(spark, sf):
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("topic_id"), (F.col("l_linenumber") - 1).alias("page"), "l_partkey")
    return behavior.limit_pages(pages, 60).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def paged_lists(spark, sf):
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("user_id"), (F.col("l_linenumber") - 1).alias("page")).agg(F.sort_array(F.collect_set("l_partkey")).alias("neighbours"))
    return text_sources.union_pages(pages, 50)


QUERIES = {
    "q01_split_commenters": split_commenters, "q02_split_totals": split_totals, "q03_behavior_counts": behaviour_counts, "q04_active_users": active_users,
    "q05_mutual_following": mutual_following, "q06_degree": degree_stats, "q07_is_following": is_following, "q08_union_users": union_users,
    "q09_intersect": intersect_users, "q10_except": except_users, "q11_subset_check": subset_check, "q12_anti_threads": anti_threads,
    "q13_semi_comments": semi_comments, "q14_keyed_union_first_wins": keyed_union, "q15_last_wins": last_wins, "q16_add_title": add_title,
    "q17_topk_per_thread": topk_per_thread, "q18_precision_at_k": precision, "q19_mean_precision": mean_precision, "q20_histogram": histogram,
    "q20b_precision_series": precision_series, "q21_confusion": confusion, "q22_candidates": candidates, "q23_binary_features": binary_features,
    "q24_instances": instance_features, "q39_bfs": bfs, "q40_minmax": minmax, "q41_ensemble_mean": ensemble, "q41b_label_ratio": label_ratio,
    "q42_quote_match": quote_match, "q42b_quote_counts": quote_counts, "q43_pages_complete": pages_complete, "q45_comment_distribution": comment_distribution,
    "q53_missing_sources": missing_sources, "q54_known_everywhere": known_everywhere, "q55_load_totals": load_totals, "q56_bagging_folds": fold_sizes,
    "q19b_mean_precision_of_runs": mean_precision_fixed, "q59_commenter_sets": commenter_sets, "q60_dataset_users": dataset_users, "q61_surrogate_index": surrogate_index,
    "q62_thread_labels": thread_labels, "q62b_pair_labels": pair_labels, "q63_group_filter": group_filter, "q64_limit_pages": limit_pages, "q65_paged_lists": paged_lists,
}

ORACLES = {
    "q01_split_commenters": f"WITH {SPLIT} SELECT * FROM s",
    "q02_split_totals": f"WITH {SPLIT} SELECT split, count(*) AS n_topics, sum(n_commenters)::BIGINT AS n_commenters FROM s GROUP BY split",
    "q03_behavior_counts": _behaviour_sql("2024-01-05", "2024-01-20"),
    "q04_active_users": f"SELECT * FROM ({_behaviour_sql('2024-01-10', '2024-01-11')}) WHERE NOT (num_topics = 0 AND num_comments < 2)",
    "q05_mutual_following": "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM e x JOIN e y ON x.d = y.d AND x.s < y.s GROUP BY 1, 2",
    "q06_degree": """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem),
d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT d, 0, 1 FROM e) GROUP BY node)
SELECT count(*) AS users, (SELECT count(*) FROM e) AS edges, count(*) FILTER (o = 0) AS following_unset, count(*) FILTER (i = 0) AS followers_unset,
 round(avg(CASE WHEN o > 0 THEN o ELSE -1 END), 6) AS following_mean, round(avg(CASE WHEN i > 0 THEN i ELSE -1 END), 6) AS followers_mean,
 round(avg(o) FILTER (o > 0), 6) AS following_mean_known, round(avg(i) FILTER (i > 0), 6) AS followers_mean_known,
 round((SELECT count(*) FROM e)::DOUBLE / (count(*)::DOUBLE * count(*)), 9) AS density FROM d""",
    "q07_is_following": "WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT s_suppkey AS src, n_nationkey::BIGINT AS dst, (e.src IS NOT NULL)::INT AS is_following FROM supplier CROSS JOIN nation LEFT JOIN e ON e.src = s_suppkey AND e.dst = n_nationkey",
    "q08_union_users": "SELECT s_suppkey AS user_id FROM supplier UNION SELECT c_custkey FROM customer",
    "q09_intersect": "SELECT s_suppkey AS user_id FROM supplier INTERSECT SELECT c_custkey FROM customer",
    "q10_except": "SELECT c_custkey AS user_id FROM customer EXCEPT SELECT s_suppkey FROM supplier",
    "q11_subset_check": "WITH x AS (SELECT (SELECT count(DISTINCT s_suppkey) FROM supplier) AS part_size, (SELECT count(DISTINCT c_custkey) FROM customer) AS whole_size, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)) AS missing) SELECT *, missing = 0 AND part_size < whole_size AS proper_subset FROM x",
    "q12_anti_threads": "SELECT o_orderkey AS topic_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "q13_semi_comments": f"SELECT l_suppkey AS user_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= '{TRAIN[0]}' AND o_orderdate < '{TRAIN[1]}') GROUP BY 1",
    "q14_keyed_union_first_wins": "SELECT uid, name, source_rank FROM (SELECT s_suppkey AS uid, s_name AS name, 0 AS source_rank FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY source_rank, name) = 1",
    "q15_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "q16_add_title": "SELECT o_orderkey AS topic_id, o_custkey AS user_id, title FROM orders JOIN (SELECT c_custkey, max(c_name) AS title FROM customer GROUP BY 1) ON c_custkey = o_custkey",
    "q17_topk_per_thread": "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 3",
    "q18_precision_at_k": f'WITH {PRECISION} SELECT topic_id, "K", round(precision, 6) AS precision FROM p',
    "q19_mean_precision": f'WITH {PRECISION} SELECT "K", round(avg(precision), 6) AS precision FROM p GROUP BY "K"',
    "q20_histogram": f"""WITH {PRECISION}, h AS (SELECT "K", precision FROM p WHERE "K" IN (10, 20, 30, 40)), t AS (SELECT ceil(max(precision) / 0.05::DOUBLE) * 0.05::DOUBLE AS top FROM h)
SELECT "K", CASE WHEN top > 0 THEN least(4, floor(precision / (top / 5))) ELSE 0 END::INT AS bin, count(*) AS n, round(max(top), 6) AS top FROM h, t GROUP BY 1, 2""",
    "q20b_precision_series": f'WITH {PRECISION} SELECT topic_id, "K", round(precision, 6) AS precision, row_number() OVER (PARTITION BY "K" ORDER BY precision DESC, topic_id)::INT AS place FROM p WHERE "K" IN (5, 10, 15)',
    "q21_confusion": """WITH r AS (SELECT lang, quality > 0 AS yes, n_chars >= 1500 AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (yes AND said) AS tp, count(*) FILTER (NOT yes AND said) AS fp, count(*) FILTER (yes AND NOT said) AS fn, count(*) FILTER (NOT yes AND NOT said) AS tn FROM r GROUP BY lang)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "q22_candidates": f"WITH {TRUE} SELECT * FROM dr",
    "q23_binary_features": f"""WITH {CONTENT} SELECT o_orderkey AS topic_id, o_custkey AS creator_id, title_chars, content_chars, images, external_link, coalesce(nt.n, 0) AS creator_topics, coalesce(nc.n, 0) AS creator_comments, coalesce(fo.n, 0) AS creator_following, coalesce(fe.n, 0) AS creator_followers
FROM orders JOIN co ON co.topic_id = o_orderkey LEFT JOIN nt ON nt.user_id = o_custkey LEFT JOIN nc ON nc.user_id = o_custkey LEFT JOIN fo ON fo.node = o_custkey LEFT JOIN fe ON fe.node = o_custkey""",
    "q24_instances": INSTANCES,
    "q39_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), b AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 5)
SELECT node, min(depth) AS depth FROM b GROUP BY node""",
    "q40_minmax": """WITH r AS (SELECT l_suppkey, sum(l_quantity) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()), 6) AS quantity, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS n, 0.0::DOUBLE AS constant FROM r""",
    "q41_ensemble_mean": "SELECT l_orderkey, round(avg(l_discount * 10), 6) AS prob, CASE WHEN round(avg(l_discount * 10), 6) >= 0.5 THEN 1 ELSE -1 END AS predicted FROM lineitem GROUP BY 1",
    "q41b_label_ratio": "SELECT count(*) FILTER (toxic > 0) AS positives, count(*) FILTER (toxic <= 0) AS negatives, greatest(1, count(*) FILTER (toxic <= 0) // greatest(count(*) FILTER (toxic > 0), 1)) AS ratio FROM labels",
    "q42_quote_match": r"""WITH d AS (SELECT doc_id, lang, replace(text, chr(10), '') AS w FROM documents), f AS (SELECT lang, w, min(doc_id) AS first FROM d GROUP BY 1, 2)
SELECT doc_id AS reply_id, CASE WHEN first < doc_id THEN first ELSE -1 END AS quoted_id FROM d JOIN f USING (lang, w)""",
    "q42b_quote_counts": r"""WITH d AS (SELECT doc_id, lang, replace(text, chr(10), '') AS w FROM documents), f AS (SELECT lang, w, min(doc_id) AS first FROM d GROUP BY 1, 2)
SELECT count(*) AS replies, count(*) FILTER (first < doc_id) AS resolved FROM d JOIN f USING (lang, w)""",
    "q43_pages_complete": """SELECT 'all' AS kind, conv_id, count(DISTINCT turn) AS n_pages, count(DISTINCT turn) >= max(turn) + 1 AS complete FROM conversations GROUP BY conv_id
UNION ALL SELECT 'user', conv_id, count(DISTINCT turn), count(DISTINCT turn) >= max(turn) + 1 FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "q45_comment_distribution": "WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n_comments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT n_comments, count(*) AS n_threads FROM c GROUP BY 1",
    "q53_missing_sources": """SELECT 'threads' AS source, count(*) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'events', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT 'suppliers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "q54_known_everywhere": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events) AND c_custkey IN (SELECT s_suppkey FROM supplier)",
    "q56_bagging_folds": "SELECT CASE WHEN toxic <= 0 THEN (('0x' || substr(md5(doc_id || '-1'), 1, 15))::BIGINT % 5)::INT ELSE -1 END AS fold, toxic AS label, count(*) AS n FROM labels GROUP BY 1, 2",
    "q19b_mean_precision_of_runs": """WITH r AS (SELECT user_id AS topic_id, event_id % 5 AS run, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY user_id, event_id % 5) AS n, (event_type = 'purchase')::INT AS hit FROM events),
k AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45]) AS "K"),
p AS (SELECT topic_id, run, "K", sum(CASE WHEN rk <= "K" THEN hit ELSE 0 END) / least("K", max(n))::DOUBLE AS precision FROM r, k GROUP BY topic_id, run, "K")
SELECT topic_id, "K", round(sum(precision) / 5.0::DOUBLE, 6) AS precision FROM p GROUP BY topic_id, "K\"""",
    "q59_commenter_sets": """WITH p AS (SELECT l_orderkey AS k, string_agg(x::VARCHAR, ',' ORDER BY x) AS c FROM (SELECT DISTINCT l_orderkey, l_partkey AS x FROM lineitem) GROUP BY 1),
s AS (SELECT l_orderkey AS k, string_agg(x::VARCHAR, ',' ORDER BY x) AS c FROM (SELECT DISTINCT l_orderkey, l_suppkey AS x FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS topic_id, coalesce(p.c, '') AS comment_ids, coalesce(s.c, '') AS commenters FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""",
    "q60_dataset_users": f"SELECT DISTINCT l_suppkey::VARCHAR AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= '{TEST[0]}' AND o_orderdate < '{TEST[1]}'",
    "q61_surrogate_index": "SELECT c_custkey AS user_id, row_number() OVER (ORDER BY md5(c_custkey || '-42'), c_custkey) - 1 AS index FROM (SELECT DISTINCT c_custkey FROM customer)",
    "q62_thread_labels": "SELECT o_orderkey AS topic_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey <> o_custkey) THEN 1 ELSE -1 END AS label FROM orders",
    "q62b_pair_labels": "SELECT o_orderkey AS topic_id, o_orderkey % 9 AS user_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_orderkey % 9) THEN 1 ELSE -1 END AS label FROM orders",
    "q63_group_filter": "SELECT c_custkey AS comment_id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "q64_limit_pages": "SELECT l_orderkey AS topic_id, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem WHERE (l_linenumber - 1) * 25 < 60 GROUP BY 1",
    "q65_paged_lists": """WITH g AS (SELECT l_suppkey AS src, l_linenumber AS page, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT src, min(page) FILTER (n < 50) AS last FROM g GROUP BY 1)
SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem JOIN s ON s.src = l_suppkey WHERE last IS NULL OR l_linenumber <= last""",
    "q55_load_totals": "SELECT (SELECT count(*) FROM lineitem) AS loaded, (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS duplicates, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS not_found",
}
