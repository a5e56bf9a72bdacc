"""Queries that write a layout to files and read it back, scalar functions over whole tables, and streams, with SQL over what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text, urls
from colloquy.operators import graph, relational
from colloquy.plans.lineage import scratch
from colloquy.plans.relational_queries import table
from colloquy.sources import text as S
from colloquy.streaming import files

DAY = "yyyy-MM-dd HH:mm:ss"


def _orders(spark, sf):
    """Orders as thread records, all text. Content has line ends, and spaces around them."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("topic_id"), F.col("o_orderstatus").alias("group_id"), F.col("o_custkey").cast("string").alias("user_id"), F.date_format("o_orderdate", DAY).alias("pubdate"),
        F.concat(F.lit("title "), "o_orderpriority").alias("title"), F.concat(F.col("o_orderpriority"), F.lit(" \n  of "), F.col("o_custkey").cast("string")).alias("content"),
        F.concat_ws(",", F.col("o_custkey").cast("string"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "x"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "")).alias("comment_list"),
    )


def _read(frame):
    return frame.select("topic_id", "group_id", "user_id", F.date_format("pubdate", DAY).alias("pubdate"), "title", "content", F.concat_ws(",", "comment_ids").alias("comment_ids"))


def thread_files(spark, sf):
    """Records of seven and of six fields, some with a trailing comma, and bad ones."""
    path = scratch(spark)
    rows = _orders(spark, sf).withColumn("content", text.remove_newlines("content", " "))
    S.write_lines(rows.where("user_id % 2 = 0"), path, ["topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list"])
    S.write_lines(rows.where("user_id % 2 = 1"), path, ["topic_id", "group_id", "user_id", "pubdate", "title", F.concat(F.lit(" \t"), "content")], mode="append")
    S.write_lines(rows.where("topic_id % 100 = 7"), path, ["topic_id", "title"], mode="append")
    S.write_lines(rows.where("topic_id % 100 = 8"), path, ["topic_id", "group_id", "user_id", F.lit("no date"), "title", "content"], mode="append")
    good, bad = S.read_threads(spark, path)
    return _read(good).withColumn("content", text.strip("content")).withColumn("reason", F.lit("")).unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).cast("string").alias("topic_id")).select("topic_id", "reason"), allowMissingColumns=True)


def multiline_files(spark, sf):
    """Records that end in a line of their own; their lines are stripped and joined."""
    path = scratch(spark)
    S.write_lines(_orders(spark, sf), path, ["topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list"], end=True)
    return _read(S.read_threads(spark, path, multiline=True)[0]).select("topic_id", "title", "content", "comment_ids")


def normalised_files(spark, sf):
    """S3: the same records, one a line, their lines joined by a space."""
    path = scratch(spark)
    S.write_lines(_orders(spark, sf), f"{path}/raw", ["topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list"], end=True)
    S.normalise(spark, f"{path}/raw", f"{path}/lines")
    return _read(S.read_threads(spark, f"{path}/lines")[0]).select("topic_id", "title", "content", "comment_ids")


def dataset_files(spark, sf):
    """The dataset layout, with commenters."""
    path = scratch(spark)
    rows = _orders(spark, sf).withColumn("content", text.remove_newlines("content", " "))
    S.write_lines(rows, path, ["topic_id", "group_id", "user_id", "pubdate", "title", "content", "comment_list", F.concat(F.lit("u"), F.col("user_id"), F.lit(",v"))])
    return S.read_threads(spark, path, "dataset")[0].select("topic_id", "group_id", F.concat_ws("|", "commenters").alias("commenters"))


def comment_files(spark, sf):
    path = scratch(spark)
    l = table(spark, sf, "lineitem").select(F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("comment_id"), "*")
    fields = ["comment_id", "l_returnflag", "l_orderkey", "l_suppkey", F.date_format("l_shipdate", DAY), F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string")).otherwise(" "), F.concat(F.lit("of "), F.col("l_linestatus"))]
    S.write_lines(l, path, fields)
    found = S.scan_comments(spark, path)
    return found.select(F.when(F.col("reason").isNull(), F.col("comment_id")).otherwise("bad").alias("comment_id"), "group_id", "topic_id", "user_id", F.date_format("pubdate", DAY).alias("pubdate"), F.when(F.col("reason").isNull(), F.coalesce("ref_comment_id", F.lit("-"))).alias("ref_comment_id"), "content")


def group_files(spark, sf):
    path = scratch(spark)
    S.write_lines(table(spark, sf, "nation"), path, ["n_nationkey", "n_regionkey", F.lit("2012-01-01 00:00:00"), "n_name", F.lit("1,,2,")])
    groups, _ = S.read_groups(spark, path)
    stored = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("group_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(",,x")).alias("topic_list"))
    return groups.select("group_id", "user_id", "description", F.explode("topic_ids").alias("topic_id")).unionByName(S.topic_list(stored, "BUILDING"), allowMissingColumns=True)


def list_files(spark, sf):
    """One value a line, blank ones dropped, or kept."""
    path = scratch(spark)
    S.write_lines(table(spark, sf, "customer"), path, [F.when(F.pmod("c_custkey", F.lit(5)) == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")))])
    return S.read_list(spark, path, "value").select("value").union(S.read_list(spark, path, "value", keep_blank=True).where("value = ''").select("value"))


def adjacency_files(spark, sf):
    """Lists in both layouts, as edges between known users."""
    path = scratch(spark)
    lists = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.concat_ws(",", F.sort_array(F.collect_set(F.col("l_partkey").cast("string")))).alias("x"))
    S.write_lines(lists.where("l_suppkey % 2 = 0"), f"{path}/following", ["l_suppkey", "x"])
    lists.where("l_suppkey % 2 = 1").select(F.concat(F.col("l_suppkey").cast("string"), F.lit(" "), "x", F.lit(",")).alias("value")).write.text(f"{path}/followers")
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return graph.follow_edges(S.read_adjacency(spark, f"{path}/following"), S.read_adjacency(spark, f"{path}/followers"), known)


def mutual_files(spark, sf):
    path = scratch(spark)
    l = table(spark, sf, "lineitem")
    l.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_linenumber"))).alias("value")).write.text(path)
    return S.read_mutual(spark, path)


def prediction_files(spark, sf):
    """Two sets of files with the probabilities in either order, as their headers say."""
    path = scratch(spark)
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "1").otherwise("-1").alias("y"), F.format_string("%.6f", F.col("value") / 100).alias("p"), F.format_string("%.6f", 1 - F.col("value") / 100).alias("n"), "event_id")
    for name, fields, rows in (("a", {"labels": "y", "1": "p", "-1": "n"}, e.where("event_id % 2 = 0")), ("b", {"labels": "y", "-1": "n", "1": "p"}, e.where("event_id % 2 = 1"))):
        S.write_predictions(rows, f"{path}/{name}", fields)
    return S.read_predictions(spark, f"{path}/*").groupBy("label", F.round("prob", 6).alias("prob")).agg(F.count(F.lit(1)).alias("n"))


def instance_files(spark, sf):
    """S10, F18."""
    path = scratch(spark)
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), "l_quantity", "l_discount", "l_linenumber")
    S.write_instances(rows, path, ["l_quantity", "l_discount", "l_linenumber"])
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def topic_index_files(spark, sf):
    """S12."""
    path = scratch(spark)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("topic_id")).agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("true_users"), F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("candidates"))
    S.write_topic_index(rows, path)
    return S.read_topic_index(spark, path).select("topic_id", F.concat_ws(",", "true_users").alias("true_users"), F.size("candidates").alias("n_candidates"))


def result_files(spark, sf):
    """Stored by R, run and K, and read for one K."""
    path = scratch(spark)
    rows = table(spark, sf, "events").select(F.lit(10).alias("R"), F.pmod("event_id", F.lit(5)).cast("int").alias("run"), (F.pmod("user_id", F.lit(3)) * 5 + 5).cast("int").alias("K"), F.col("event_id").alias("topic_id"), (F.col("value") / 100).alias("precision"))
    S.write_results(rows, path)
    return S.scan_results(spark, path, R=10, K=10).select("run", "topic_id", F.round("precision", 6).alias("precision"))


def segmented_files(spark, sf):
    """Without the surrogate id, one column cut into words by a callable, line ends flattened."""
    path = scratch(spark)
    rows = _orders(spark, sf).select(F.col("topic_id").cast("long").alias("id"), "title", "content")
    S.export_segmented(rows, path, "title", text.segmenter(lambda t: t.replace("-", " - ").split()), ["id"])
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def exported_topics(spark, sf):
    """Threads of a group that are in a list, each once; W2."""
    path = scratch(spark)
    rows = _orders(spark, sf).select("topic_id", "group_id", "user_id", F.to_timestamp("pubdate").alias("pubdate"), "title", F.lit("c").alias("content"), F.array("user_id").alias("comment_ids"), F.lit("f").alias("file"), F.lit(1).alias("position"))
    again = rows.withColumn("position", F.lit(2)).withColumn("title", F.lit("later"))
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("topic_id"))
    S.export_topics(rows.union(again), "F", wanted.union(wanted), path)
    return spark.read.text(path)


def edge_files(spark, sf):
    """G3."""
    path = scratch(spark)
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    S.write_lines(edges, path, ["src", "dst"])
    return S.lines(spark, path).select(text.split_fields("value")[0].alias("src"), text.split_fields("value")[1].alias("dst"))


def structure_files(spark, sf):
    """Structure lines of two and four fields; others are bad."""
    c = table(spark, sf, "conversations")
    node = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    value = F.when(F.col("turn") == 0, F.concat_ws(" ", node(F.col("turn")), "role")).when(F.col("turn") == 3, F.concat_ws("  ", node(F.col("turn")), "role", F.lit("odd"))).otherwise(F.concat_ws(" ", node(F.col("turn")), "role", node(F.col("turn") - 1), F.lit("other")))
    good, bad = graph.structure_rows(c.select(value.alias("value")))
    return good.select("comment_id", "user_id", F.coalesce("ref_comment_id", F.lit("-")).alias("ref_comment_id")).unionByName(bad.select(F.lit("bad").alias("comment_id"), F.lit("-").alias("user_id"), F.col("value").alias("ref_comment_id")))


def streamed_pages(spark, sf):
    """Files as a stream, few at a time, appended once each; a second run of the stream adds nothing."""
    path = scratch(spark)
    table(spark, sf, "events").select("event_id", "user_id").repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        stream = files.read_pages(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, 2)
        files.append(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def scalars(spark, sf):
    """F12, F15, F16, F17, P6, P15, and what does not parse."""
    o = table(spark, sf, "orders")
    shown = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or 2001-13-40 "), F.col("o_orderpriority"))
    number = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("\n")))
    return o.select(
        "o_orderkey", F.date_format(text.first_date(shown), "yyyy-MM-dd").alias("first"), urls.start_url(F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.lit("a.example")).otherwise(F.lit("https://b.example"))).alias("start"),
        F.coalesce(text.to_number(number, "bigint"), F.lit(-1)).alias("number"), text.format_time("o_orderdate", DAY).alias("shown"), text.in_window("o_orderdate").alias("always"),
        text.not_blank(F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("  ")).otherwise(F.col("o_orderstatus"))).alias("filled"), text.fixed(F.col("o_totalprice") / 7, 2).alias("price"),
    )


def ordinals(spark, sf):
    """W4."""
    return relational.ordinal(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


def declared_counts(spark, sf):
    """A5: lengths of lists, -1 for users without one."""
    lists = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_list("o_orderkey").alias("neighbours"))
    return graph.declared_counts(lists, table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), "following")


QUERIES = {
    "q70_thread_files": thread_files, "q70b_multiline_files": multiline_files, "q70c_normalised_files": normalised_files, "q70d_dataset_files": dataset_files, "q71_comment_files": comment_files,
    "q72_group_files": group_files, "q73_list_files": list_files, "q74_adjacency_files": adjacency_files, "q75_mutual_files": mutual_files, "q76_prediction_files": prediction_files,
    "q77_instance_files": instance_files, "q78_topic_index_files": topic_index_files, "q79_result_files": result_files, "q80_segmented_files": segmented_files, "q81_exported_topics": exported_topics,
    "q82_edge_files": edge_files, "q83_structure_files": structure_files, "q84_streamed_pages": streamed_pages, "q85_scalars": scalars, "q86_ordinals": ordinals, "q87_declared_counts": declared_counts,
}

_O = """o AS (SELECT o_orderkey::VARCHAR AS topic_id, o_orderstatus AS group_id, o_custkey::VARCHAR AS user_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS pubdate, 'title ' || o_orderpriority AS title,
 o_orderpriority AS p, o_custkey AS c, o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ',x' ELSE '' END AS comment_ids, o_orderkey AS k FROM orders)"""

ORACLES = {
    "q70_thread_files": f"""WITH {_O} SELECT topic_id, group_id, user_id, pubdate, title, p || '    of ' || c AS content, CASE WHEN c % 2 = 0 THEN comment_ids ELSE '' END AS comment_ids, '' AS reason FROM o
UNION ALL SELECT count(*)::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, 'fields: 2' FROM o WHERE k % 100 = 7 UNION ALL SELECT count(*)::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, 'date: no date' FROM o WHERE k % 100 = 8""",
    "q70b_multiline_files": f"WITH {_O} SELECT topic_id, title, p || 'of ' || c AS content, comment_ids FROM o",
    "q70c_normalised_files": f"WITH {_O} SELECT topic_id, title, p || ' of ' || c AS content, comment_ids FROM o",
    "q70d_dataset_files": f"WITH {_O} SELECT topic_id, group_id, 'u' || c || '|v' AS commenters FROM o",
    "q71_comment_files": "SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS comment_id, l_returnflag AS group_id, l_orderkey::VARCHAR AS topic_id, l_suppkey::VARCHAR AS user_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS pubdate, CASE WHEN l_linenumber > 1 THEN l_partkey::VARCHAR ELSE '-' END AS ref_comment_id, 'of ' || l_linestatus AS content FROM lineitem",
    "q72_group_files": "SELECT n_nationkey::VARCHAR AS group_id, n_regionkey::VARCHAR AS user_id, n_name AS description, t AS topic_id FROM nation, (SELECT unnest(['1', '2']) AS t) UNION ALL SELECT NULL, NULL, NULL, t FROM (SELECT unnest([c_custkey::VARCHAR, 'x']) AS t FROM customer WHERE c_mktsegment = 'BUILDING')",
    "q73_list_files": "SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS value FROM customer",
    "q74_adjacency_files": "SELECT DISTINCT a::VARCHAR AS src, b::VARCHAR AS dst FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 2 = 1) WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)",
    "q75_mutual_files": "SELECT least(l_suppkey::VARCHAR, l_partkey::VARCHAR) AS a, greatest(l_suppkey::VARCHAR, l_partkey::VARCHAR) AS b, l_linenumber::BIGINT AS n FROM lineitem",
    "q76_prediction_files": "SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS label, round(printf('%.6f', value / 100)::DOUBLE, 6) AS prob, count(*) AS n FROM events GROUP BY 1, 2",
    "q77_instance_files": "SELECT CASE WHEN l_returnflag = 'R' THEN '+1' ELSE '-1' END || printf(' 1:%.6f 2:%.6f 3:%.6f', l_quantity, l_discount, l_linenumber::DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "q78_topic_index_files": "SELECT l_orderkey::VARCHAR AS topic_id, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS true_users, count(DISTINCT l_partkey)::INT AS n_candidates FROM lineitem GROUP BY 1",
    "q79_result_files": "SELECT (event_id % 5)::INT AS run, event_id AS topic_id, round(value / 100, 6) AS precision FROM events WHERE user_id % 3 = 1",
    "q80_segmented_files": "SELECT 'title ' || replace(o_orderpriority, '-', ' - ') || '[=]' || o_orderpriority || ' of ' || o_custkey AS value, count(*) AS n FROM orders GROUP BY 1",
    "q81_exported_topics": "SELECT o_orderkey || '[=]F[=]' || o_custkey || '[=]' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '[=]title ' || o_orderpriority || '[=]c[=]' || o_custkey AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT c_custkey FROM customer)",
    "q82_edge_files": "SELECT DISTINCT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem",
    "q83_structure_files": "SELECT CASE WHEN turn = 3 THEN 'bad' ELSE conv_id || ':' || turn END AS comment_id, CASE WHEN turn = 3 THEN '-' ELSE role END AS user_id, CASE WHEN turn = 0 THEN '-' WHEN turn = 3 THEN conv_id || ':3  ' || role || '  odd' ELSE conv_id || ':' || (turn - 1) END AS ref_comment_id FROM conversations",
    "q84_streamed_pages": "SELECT event_id, user_id FROM events",
    "q85_scalars": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first, CASE WHEN o_orderkey % 2 = 0 THEN 'http://a.example' ELSE 'https://b.example' END AS start, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS number,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, true AS always, o_orderkey % 3 <> 0 AS filled, round(o_totalprice / 7, 2) AS price FROM orders""",
    "q86_ordinals": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS ordinal FROM lineitem",
    "q87_declared_counts": "SELECT c_custkey AS user_id, coalesce(n, -1) AS following FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
}
