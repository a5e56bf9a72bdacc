"""Text layouts: round trips, rejects, repairs."""

from pyspark.sql import functions as F

from colloquy.functions.text import segment
from colloquy.sources import text as S


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


TABLE = "t1[=]g1[=]alice[=]2012-08-01 00:00:00[=]标题 one[=]正文 http://x.example/a[=]c1,c2,\n\nt2[=]g1[=]bob[=]2012-09-01 10:00:00[=]two[=]text\nbad[=]row\nt3[=]g1[=]bob[=]not a date[=]x[=]y[=]c3\n"


def test_threads_table_layout(spark, tmp_path):
    good, bad = S.read_threads(spark, put(tmp_path, "t", TABLE))
    rows = {r.topic_id: r for r in good.collect()}
    assert set(rows) == {"t1", "t2"} and rows["t1"].comment_ids == ["c1", "c2"] and rows["t2"].comment_ids == []
    assert sorted(r.reason for r in bad.collect()) == ["date: not a date", "fields: 2"]


def test_layout_is_named_by_the_caller(spark, tmp_path):
    path = put(tmp_path, "c", "t1[=]g1[=]alice[=]a title[=]2012-08-01 00:00:00[=]body\n")
    good, _ = S.read_threads(spark, path, "crawl")
    assert [(r.title, str(r.pubdate)) for r in good.collect()] == [("a title", "2012-08-01 00:00:00")]
    wrong, bad = S.read_threads(spark, path, "untitled")
    assert wrong.count() == 0 and bad.count() == 1
    untitled, _ = S.read_threads(spark, put(tmp_path, "u", "t1[=]g1[=]a[=]2012-08-01 00:00:00[=]body[=]c1,\n"), "untitled")
    assert [(r.title, r.comment_ids) for r in untitled.collect()] == [("", ["c1"])]
    dataset, _ = S.read_threads(spark, put(tmp_path, "d", "t1[=]g1[=]a[=]2012-08-01 00:00:00[=]x[=]body[=]c1[=]u1,u2\n"), "dataset")
    assert dataset.first().commenters == ["u1", "u2"]


def test_multiline_records_and_normaliser(spark, tmp_path):
    raw = put(tmp_path, "m", "a[=]first \nsecond\n[*ROWEND*]\nb[=]x\n[*ROWEND*]\n")
    assert [r.value for r in S.records(spark, raw).orderBy("position").collect()] == ["a[=]firstsecond", "b[=]x"]
    S.normalise(spark, raw, str(tmp_path / "n"))
    assert sorted(r.value for r in S.lines(spark, str(tmp_path / "n")).collect()) == ["a[=]first second", "b[=]x"]


def test_comments_lists_adjacency_mutual(spark, tmp_path):
    good, bad = S.read_comments(spark, put(tmp_path, "c", "c1[=]g[=]t1[=]bob[=]2012-08-02 10:00:00[=][=]first\nc2[=]g[=]t1[=]carol[=]2012-08-02 11:00:00[=]c1[=]quoting\nx\n"))
    assert [(r.comment_id, r.ref_comment_id) for r in good.orderBy("comment_id").collect()] == [("c1", None), ("c2", "c1")] and bad.count() == 1
    ids = put(tmp_path, "i", "\n1\n2\n 1 \n")
    assert S.read_list(spark, ids, "topic_id").count() == 3 and S.read_list(spark, ids, keep_blank=True).count() == 4
    adjacency = put(tmp_path, "a", "bob[=]alice,carol\ndave[=]\nerin x,y,\n")
    rows = {r.user_id: r.neighbours for r in S.read_adjacency(spark, adjacency).collect()}
    assert rows == {"bob": ["alice", "carol"], "dave": [], "erin": ["x", "y"]}
    assert {r.user_id: r.neighbours for r in S.read_adjacency(spark, adjacency, True).collect()}["dave"] == [""]
    assert [tuple(r) for r in S.read_mutual(spark, put(tmp_path, "mu", "b a 2\nc d 1\n")).orderBy("a").collect()] == [("a", "b", 2), ("c", "d", 1)]


def test_groups_predictions_index(spark, tmp_path):
    groups, _ = S.read_groups(spark, put(tmp_path, "g", "g1[=]alice[=]2012-01-01 00:00:00[=]about[=]t1,t2,\n"))
    assert groups.first().topic_ids == ["t1", "t2"]
    for head, want in (("labels 1 -1", [0.9, 0.2]), ("labels -1 1", [0.1, 0.8])):
        path = put(tmp_path, head.replace(" ", ""), f"{head}\n1 0.9 0.1\n-1 0.2 0.8\n")
        assert [r.prob for r in S.read_predictions(spark, path).orderBy("position").collect()] == want
    S.write_topic_index(spark.createDataFrame([("t1", ["a"], ["a", "b"])], "topic_id string, true_users array<string>, candidates array<string>"), str(tmp_path / "x"))
    assert S.read_topic_index(spark, str(tmp_path / "x")).first().candidates == ["a", "b"]


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0, 0.5), (-1, 0.0, 1.0)], "label int, f1 double, f2 double")
    S.write_instances(frame, str(tmp_path / "svm"), ["f1", "f2"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "svm")).collect()) == ["+1 1:2.000000 2:0.500000", "-1 1:0.000000 2:1.000000"]
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    S.write_lines(rows, str(tmp_path / "w"), ["k", "v"])
    S.write_lines(rows, str(tmp_path / "w"), ["k", "v"], mode="append")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "w")).collect()) == ["a[=]x", "a[=]x", "b[=]", "b[=]"]
    S.write_lines(rows, str(tmp_path / "e"), ["k", "v"], end=True)
    assert sorted(r.value for r in S.records(spark, str(tmp_path / "e")).collect()) == ["a[=]x", "b[=]"]
    S.export_segmented(spark.createDataFrame([(7, "今天天", "a\nb")], "id int, title string, body string"), str(tmp_path / "s"), "title", segment, ["id"])
    assert spark.read.text(str(tmp_path / "s")).first().value == "今天 天天[=]a b"
    S.write_results(spark.createDataFrame([(10, 0, 5, "t", 0.5), (10, 1, 5, "t", 1.0)], "R int, run int, K int, topic_id string, precision double"), str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).where("run = 1 and K = 5")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(run" in back._jdf.queryExecution().executedPlan().toString()


def test_export_topics_and_topic_list(spark, tmp_path):
    good, _ = S.read_threads(spark, put(tmp_path, "t", TABLE + "t1[=]g1[=]zed[=]2012-08-01 00:00:00[=]again[=]x[=]\n"))
    S.export_topics(good, "g1", spark.createDataFrame([("t1",), ("t1",)], "topic_id string"), str(tmp_path / "o"))
    assert [r.value.split("[=]")[2] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["alice"]
    stored = spark.createDataFrame([("g1", "t1,,t2,"), ("g2", "t9")], "group_id string, topic_list string")
    assert [r.topic_id for r in S.topic_list(stored, "g1").collect()] == ["t1", "t2"]
    assert good.select(F.max("position")).first()[0] is not None


def test_stored_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS colloquy_test LOCATION '{tmp_path}/db'")
    try:
        S.create_tables(spark, "colloquy_test")
        S.create_tables(spark, "colloquy_test")
        pages = spark.createDataFrame([("http://a.example/", "k", "<p>x"), ("http://b.example/", None, None)], "url string, keyword string, page_source string").withColumn("extra", F.lit(1))
        S.insert_rows(pages, "webpage", "colloquy_test")
        S.insert_rows(pages.limit(1), "webpage", "colloquy_test")
        assert S.scan_table(spark, "webpage", "colloquy_test").count() == 3
        found = S.look_up(spark, "webpage", "url", "http://a.example/", "colloquy_test")
        assert [r.page_source for r in found.collect()] == ["<p>x", "<p>x"]
        assert "PushedFilters: [IsNotNull(url), EqualTo(url,http://a.example/)]" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.sql("DROP DATABASE colloquy_test CASCADE")


def test_results_are_read_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([(10, r, k, t, 0.5) for r in range(2) for k in (5, 10) for t in range(3)], "R int, run int, K int, topic_id long, precision double")
    S.write_results(rows, str(tmp_path / "r"))
    found = S.scan_results(spark, str(tmp_path / "r"), run=1, K=5)
    assert found.count() == 3 and S.scan_results(spark, str(tmp_path / "r")).count() == 12
    assert "PartitionFilters: [isnotnull(run" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_stream_at_intervals(spark, tmp_path):
    import time

    from colloquy.streaming import files

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = files.read_pages(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    running = files.append(stream, str(tmp_path / "out"), str(tmp_path / "state"), "1 second")
    try:
        end = time.time() + 60
        while time.time() < end and sum(p.numInputRows for p in running.recentProgress) < 30:
            time.sleep(0.5)
        rates = [p.numInputRows for p in running.recentProgress if p.numInputRows]
    finally:
        running.stop()
    assert rates == [10, 10, 10] and spark.read.parquet(str(tmp_path / "out")).distinct().count() == 30


def test_q76_prediction_files_are_written_and_read_by_all_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).selectExpr("if(id % 2 = 0, '1', '-1') as y", "format_string('%.6f', id / 100) as p", "format_string('%.6f', 1 - id / 100) as n")
    S.write_predictions(rows, f"{tmp_path}/a", {"labels": "y", "1": "p", "-1": "n"})
    S.write_predictions(rows, f"{tmp_path}/b", {"labels": "y", "-1": "n", "1": "p"})
    parts = sorted((tmp_path / "b").glob("part-*"))
    assert len(parts) == 4 and all(p.read_text().splitlines()[0] == "labels -1 1" for p in parts)
    got = S.read_predictions(spark, f"{tmp_path}/*")
    assert sorted((r.label, r.prob) for r in got.collect()) == sorted((1 if i % 2 == 0 else -1, i / 100) for i in range(40) for _ in "ab")
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_q71_comment_files_are_read_once(spark, tmp_path):
    (tmp_path / "c").write_text("\t1[=]g[=]t[=]u[=] 2012-08-01 00:00:00 [=] [=]x\x0b\n\n2[=]g[=]t[=]u[=]2012-08-01 00:00:01[=]1[=]y\nbad[=]row\n3[=]g[=]t[=]u[=]no date[=]1[=]z\n")
    path = str(tmp_path / "c")
    found = S.scan_comments(spark, path)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    good, bad = S.read_comments(spark, path)
    assert sorted(map(tuple, found.where("reason is null").drop("reason").collect())) == sorted(map(tuple, good.collect()))
    assert sorted((r.comment_id, r.reason) for r in found.where("reason is not null").collect()) == [(None, r.reason) for r in bad.orderBy("reason").collect()] == [(None, "date: no date"), (None, "fields: 2")]
    assert [r.content for r in good.orderBy("comment_id").collect()] == ["x", "y"] and good.where("ref_comment_id is null").count() == 1
