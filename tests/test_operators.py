"""Relational, behaviour, graph, page, corpus, instance, learning, evaluation and streaming operators on hand-made rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import behavior, corpus, evaluate, graph, html, instances, learn, relational, topics
from colloquy.plans import study
from colloquy.streaming import files


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_split_needs_five_commenters_in_test_only(spark):
    threads = spark.createDataFrame([(t, "a", f"2012-{m}-01") for t, m in (("r4", "08"), ("s4", "12"), ("s5", "12"), ("out", "07"))], "topic_id string, user_id string, d string").withColumn("pubdate", F.to_timestamp("d"))
    said = [(t, f"u{i}", "2012-12-15") for t, n in (("r4", 4), ("s4", 4), ("s5", 5)) for i in range(n)] + [("s4", "late", "2013-03-01"), ("s5", "u0", "2012-12-15")]
    comments = spark.createDataFrame(said, "topic_id string, user_id string, d string").withColumn("pubdate", F.to_timestamp("d"))
    w = behavior.STUDY
    got = behavior.split_commenters(threads, comments, w["train"], w["test"], w["comments_until"])
    assert rows(got, "topic_id", "split", "n_commenters") == [("r4", "train", 4), ("s5", "test", 5)]


def test_activity(spark):
    counts = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 2, 0), ("d", 0, 1)], "user_id string, num_comments long, num_topics long")
    assert rows(behavior.active(counts), "user_id") == [("c",), ("d",)]


def test_wins_and_unions(spark):
    data = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("m", 3, "z")], "key string, position int, v string")
    assert rows(relational.first_wins(data, ["key"], ["position"]), "v") == [("x",), ("z",)] and rows(relational.last_wins(data, ["key"], ["position"]), "v") == [("y",), ("z",)]
    other = spark.createDataFrame([("k", 0, "new"), ("n", 0, "n")], "key string, position int, v string")
    assert rows(relational.keyed_union([data, other], ["key"], ["position"]), "key", "v") == [("k", "x"), ("m", "z"), ("n", "n")]
    report = relational.subset_report(data.select("key"), data.select("key").union(other.select("key"))).first()
    assert report.proper_subset and not relational.subset_report(data.select("key"), data.select("key")).first().proper_subset
    assert rows(relational.ordinal(data, [], ["position"]), "ordinal") == [(1,), (2,), (3,)]


def test_quotes(spark):
    said = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "a", "t"), (4, "a", "u")], "id long, who string, text string").withColumn("at", F.col("id"))
    assert {r.reply_id: r.quoted_id for r in relational.resolve_quotes(said, said, ["who", "text"], "at").collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_graph(spark):
    users = spark.createDataFrame([(u,) for u in "abc"], "user_id string")
    following = spark.createDataFrame([("a", ["b", "x"]), ("c", [])], "user_id string, neighbours array<string>")
    followers = spark.createDataFrame([("b", ["a", "c"])], "user_id string, neighbours array<string>")
    edges = graph.follow_edges(following, followers, users)
    assert rows(edges, "src", "dst") == [("a", "b"), ("c", "b")]
    assert rows(graph.declared_counts(following, users, "n"), "user_id", "n") == [("a", 2), ("b", -1), ("c", 0)]
    for hot in (2000, 1):
        assert rows(graph.mutual_following(edges.union(edges), hot=hot), "a", "b", "n") == [("a", "c", 1)]
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src long, dst long")
    assert rows(graph.bfs(links, spark.createDataFrame([(0,)], "n long"), 3), "node", "depth") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    nodes = spark.createDataFrame([("t", "c1", None), ("t", "c2", "c1"), ("t", "c3", "zz")], "topic_id string, comment_id string, ref_comment_id string")
    tree, lost = graph.comment_tree(nodes)
    assert rows(lost, "comment_id", "missing") == [("c3", "zz")]
    assert ("c2", "root_t", 2) in rows(graph.depths(tree.select("child", "parent")), "node", "root", "depth")
    chain = spark.createDataFrame([(str(i + 1), str(i)) for i in range(70)], "child string, parent string")
    assert max(r.depth for r in graph.depths(chain).collect()) == 70
    good, bad = graph.structure_rows(spark.createDataFrame([("c u",), ("c u r v",), ("c u r",)], "value string"))
    assert good.count() == 2 and bad.count() == 1


TOPIC = """<html><body><div id="wrapper"><div id="content"><h1>Short...</h1><table class="infobox"><tr><td class="tablecc"><b>Full</b> title &amp; more</td></tr></table>
<div class="topic-doc"><h3><span class="from"><a href="http://www.example.com/people/bob/">Bob</a></span><span class="color-green">2012-08-01 10:00:00</span></h3></div>
<div class="topic-content"><p>one</p><div class="topic-figure cc"><img src="http://img/x.jpg"></div><p>two</p></div>
<div class="paginator"><a href="?start=100">2</a><a href="?start=200">3</a></div>
<ul id="comments"><li data-cid="7"><div class="reply-doc content"><div class="bg-img-green"><h4><a href="http://www.example.com/people/eve/">Eve</a><span class="pubtime">2012-08-02 10:00:00</span></h4></div>
<div class="reply-quote"><span class="all">one</span><span class="pubdate"><a href="http://www.example.com/people/bob/">Bob</a></span></div><p>agreed</p></div></li></ul></div></div><script>var x="<h1>no</h1>"</script></body></html>"""


def test_pages(spark):
    page = spark.createDataFrame([(1, "http://www.example.com/group/topic/1/", TOPIC), (2, "http://www.example.com/", None)], "page_id long, url string, html string")
    assert page.select(html.title("html").alias("t")).first().t == "Full title & more"
    topic = {r.page_id: r for r in html.extract_topics(page).collect()}
    assert (topic[1].user_id, topic[1].pubdate, topic[1].n_pages) == ("bob", "2012-08-01 10:00:00", 3) and "http://img/x.jpg" in topic[1].content and topic[2].n_pages == 1
    comment = html.extract_comments(page).collect()
    assert [(c.comment_id, c.user_id, c.content, c.quote_text, c.quote_user_id) for c in comment] == [("7", "eve", "agreed", "one", "bob")]
    group = spark.createDataFrame([(1, '<title>G</title><div class="infobox"><div class="bd"><p>since 2011-05-06 <a href="http://www.example.com/people/zoe/">z</a></p>about</div></div><td><img alt="x"></td><tr><td><span><img alt="[置顶]"></span><a href="http://www.example.com/group/topic/55/">t</a></td></tr>')], "page_id long, html string")
    g = html.extract_groups(group).first()
    assert (g.title, g.user_id, g.pubdate, g.sticky_topic_ids) == ("G", "zoe", "2011-05-06", ["55"])
    assert {r.target for r in html.links(page.where("page_id = 1")).collect()} >= {"http://www.example.com/group/topic/1/?start=100"}


def _follows(spark):
    pairs = sorted({(a, (a * a + b * b * 7) % 40) for a in range(30) for b in range(12)})
    want = {(a, b): n for a in range(30) for b in range(a + 1, 30) if (n := len({d for s, d in pairs if s == a} & {d for s, d in pairs if s == b}))}
    return spark.createDataFrame(pairs, "src long, dst long"), want


def test_q05_mutual_following_takes_tasks_by_its_pairs(spark, monkeypatch):
    edges, want = _follows(spark)
    monkeypatch.setattr(graph, "PAIRS", 100, raising=False)
    for hot in (2, 2000):
        got = graph.mutual_following(edges, hot=hot, salts=3)
        assert {(r.a, r.b): r.n for r in got.collect()} == want
        assert got.rdd.getNumPartitions() >= sum(want.values()) // 100 > 4


def test_q24_instances_pairs_are_not_shuffled_one_by_one(spark):
    edges, _ = _follows(spark)
    plan = graph.mutual_following(edges)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(a#" in x and ", b#" in x]


#: References without a semicolon stay; in a script nothing is decoded.
CUT = "a &amp;&lt;&notit; &copy; x&&amp"
SHOWN = "a &<&notit; \u00a9 x&&amp"


def test_q32_title_leaves_references_without_a_semicolon(spark):
    assert spark.createDataFrame([(f"<h1>{CUT}</h1>",)], "html string").select(html.title("html").alias("t")).first().t == SHOWN


def test_q50_html_extract_leaves_references_without_a_semicolon(spark):
    page = spark.createDataFrame([(1, f'<title>{CUT}</title><div class="topic-doc"><span class="from"><a href="http://www.example.com/people/a&amp;b&copy/">{CUT}</a></span></div>')], "page_id long, html string")
    assert html.extract_groups(page).first().title == SHOWN
    topic = html.extract_topics(page).first()
    assert (topic.user_id, topic.user_name) == ("a&b&copy", SHOWN)
    assert html.parse("<script>&amp &amp;</script>").children[0].children == ["&amp &amp;"]


def test_topics(spark):
    docs = spark.createDataFrame([(i, (["cat", "dog"] if i % 2 else ["sun", "moon"]) * 5) for i in range(20)] + [(99, ["unknown"]), (98, [])], "doc_id long, tokens array<string>")
    vectors = corpus.fit_vectors(docs.where("doc_id < 50"))
    model = corpus.train_topics(docs, vectors, 4, 5)
    got = {r.doc_id: r.topics for r in corpus.topic_distribution(docs, vectors, model, 4).collect()}
    assert all(np.isclose(sum(t), 1) for t in got.values()) and got[99] == got[98] == [0.25] * 4
    assert corpus.topic_terms(vectors, model, 2).count() == 8


def test_q46_lda_keeps_its_vocabulary_in_tables(spark):
    words = {0: ["cat", "dog", "fish"], 1: ["sun", "moon", "star"]}
    docs = spark.createDataFrame([(i, [words[i % 2][(i // 2 + j) % 3] for j in range(40)]) for i in range(400)], "doc_id long, tokens array<string>")
    found = []
    for parts in (1, 7):
        dealt = docs.repartition(parts)
        vectors = corpus.fit_vectors(dealt)
        model = corpus.train_topics(dealt, vectors, 2, 6)
        assert {r.token for r in vectors.vocabulary.collect()} == {r.token for r in model.weights.collect()} == {*words[0], *words[1]}
        # The sums kept beside the weights are theirs.
        assert np.allclose(model.weights.selectExpr("sum(w0)", "sum(w1)").first(), model.totals)
        found.append({(r.topic, r.term): r.weight for r in corpus.topic_terms(vectors, model, 3).collect()})
        if parts == 1:
            assert {frozenset(t for k, t in found[0] if k == topic) for topic in (0, 1)} == {frozenset(w) for w in words.values()}
    assert found[0].keys() == found[1].keys() and np.allclose([*found[0].values()], [found[1][k] for k in found[0]])


def test_q46b_topic_interest_of_documents_together_and_alone(spark):
    rng = np.random.default_rng(1)
    beta, alpha = rng.random((30, 3)), np.array([0.2, 0.5, 0.3])
    bags = [np.unique(rng.integers(0, 30, n), return_counts=True) for n in (1, 5, 40, 3)]
    starts = np.cumsum([0, *(len(i) for i, _ in bags)])
    gamma, sums = topics.infer(np.concatenate([i for i, _ in bags]), np.concatenate([c for _, c in bags]), starts, beta, alpha)
    alone = [topics.infer(i, c, np.array([0, len(i)]), beta, alpha) for i, c in bags]
    assert np.allclose(gamma, np.vstack([g for g, _ in alone])) and np.allclose(sums, sum(s for _, s in alone))
    # Every word of a document goes to some topic.
    assert np.allclose(gamma.sum(axis=1), [c.sum() + 1 for _, c in bags]) and np.isclose(sums.sum(), sum(c.sum() for _, c in bags))
    assert np.allclose(topics.digamma([0.5, 1, 10]), [-1.9635100260214235, -0.5772156649015329, 2.251752589066721]) and np.allclose(topics.trigamma([1, 10]), [1.6449340668482264, 0.10516633568168575])


def test_candidates_and_instances(spark):
    users = spark.createDataFrame([(i,) for i in range(40)], "user_id long")
    pairs = spark.createDataFrame([(1, 0, i) for i in range(0, 7)] + [(2, 1, i) for i in range(2, 6)] + [(3, 99, i) for i in range(2, 9)] + [(4, 3, i) for i in range(10, 30)], "topic_id long, creator_id long, user_id long")
    true = instances.usable_threads(pairs, users)
    assert rows(true.groupBy("topic_id").count(), "topic_id", "count") == [(1, 6), (4, 20)]
    drawn = instances.candidates(true, users, 3, 1)
    assert rows(drawn.groupBy("topic_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")), "topic_id", "p", "n") == [(1, 6, 18), (4, 20, 40)]
    assert rows(drawn, "topic_id", "user_id", "label") == rows(instances.candidates(true, users.repartition(7), 3, 1), "topic_id", "user_id", "label")
    many = spark.range(30_000).withColumnRenamed("id", "user_id")
    one = many.where("user_id < 1000").selectExpr("1L topic_id", "29999L creator_id", "user_id")
    drawn = instances.candidates(instances.usable_threads(one, many), many, 9, 1)
    assert drawn.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("d")).orderBy("label").collect() == [(0, 8000, 8000), (1, 1000, 1000)]
    with pytest.raises(ValueError):
        instances.candidates(true, users, 1, 1)


def test_scaling_and_learning(spark):
    data = spark.createDataFrame([(i, float(i % 7), 3.0, 1 if i % 7 > 3 else -1) for i in range(70)], "id long, x double, c double, label int")
    scaled = learn.min_max(data, ["x", "c"])
    assert scaled.agg(F.min("x"), F.max("x"), F.max("c")).first()[:] == (0.0, 1.0, 0.0)
    # There is no intercept, and a constant feature gets no weight, so the features are centred.
    centred = data.withColumn("x", F.col("x") - 3.5)
    model = learn.fit_logistic(centred, ["x"], 1000.0)
    assert learn.predict(model, centred, ["x"]).where("(prob >= 0.5) <> (label > 0)").count() == 0
    rare = data.withColumn("x", F.col("x") - 5.5).withColumn("label", F.when(F.col("id") % 7 == 6, 1).otherwise(-1))
    models = learn.fit_bagged(rare, ["x"], ["id"], cost=1000.0)
    assert len(models) == 6 and learn.predict_bagged(models, rare, ["x"], ["id"]).where("label <> predicted").count() == 0


def test_precision(spark):
    scored = spark.createDataFrame([("t", u, 0.5, l) for u, l in (("a", 1), ("b", 0), ("c", 1))] + [("w", f"u{i:02}", 1 - i / 100, int(i < 5)) for i in range(12)], "topic_id string, user_id string, prob double, label int")
    got = {(r.topic_id, r.K): r.precision for r in evaluate.precision_at_k(scored, ["topic_id"]).collect()}
    assert got[("t", 5)] == pytest.approx(2 / 3) and got[("w", 5)] == 1.0 and got[("w", 10)] == 0.5 and got[("w", 45)] == pytest.approx(5 / 12)
    c = evaluate.confusion(spark.createDataFrame([("x", 1, -1), ("y", 1, 1), ("y", -1, 1)], "k string, label int, predicted int"), ["k"])
    assert {r.k: (r.precision, r.recall) for r in c.collect()} == {"x": (None, 0.0), "y": (0.5, 1.0)}


def test_whole_study(spark):
    r = np.random.default_rng(0)
    threads = spark.createDataFrame([(f"t{i}", "g", f"u{i % 12}", f"2012-{'09' if i < 12 else '12'}-02 00:00:00", "title cat", "body dog", None) for i in range(18)], "topic_id string, group_id string, user_id string, d string, title string, content string, comment_ids array<string>").withColumn("pubdate", F.to_timestamp("d"))
    said = [(f"c{i}-{u}", "g", f"t{i}", f"u{u}", f"2012-{'09' if i < 12 else '12'}-10 00:00:00", None, "said cat") for i in range(18) for u in r.choice(30, 9, replace=False)]
    comments = spark.createDataFrame(said, "comment_id string, group_id string, topic_id string, user_id string, d string, ref_comment_id string, content string").withColumn("pubdate", F.to_timestamp("d"))
    users = comments.select("user_id").distinct()
    dataset = study.split(threads, comments)
    groups = spark.createDataFrame([("about",)], "description string")
    ui, ti = study.interest(threads, comments, groups, 2, 2, 1)
    edges = spark.createDataFrame([(f"u{i}", f"u{(i * 7 + 1) % 30}") for i in range(30)], "src string, dst string")
    built = study.build(dataset, users, behavior.behaviour(users, threads, comments), edges, ui, ti, "www.example.com", "img.example.com", ratio=2, runs=2)
    result = study.evaluate_runs(built, 2)
    assert set(built.columns) >= {"run", "split", *instances.FEATURES}
    assert result.where("precision < 0 or precision > 1").count() == 0 and rows(result.select("run").distinct(), "run") == [(0,), (1,)]


def test_streams(spark, tmp_path):
    schema = "id long, at timestamp, kind string"
    for part in range(2):
        spark.createDataFrame([(part * 10 + i, None, "k") for i in range(3)], "id long, x string, kind string").select("id", F.to_timestamp(F.concat(F.lit("2024-01-01 00:0"), F.col("id") % 10)).alias("at"), "kind").write.mode("append").parquet(str(tmp_path / "in"))
        stream = files.read_pages(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        files.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6  # each page once, over two runs
    events = spark.read.parquet(str(tmp_path / "in"))
    assert files.windowed_counts(events, "at", ["kind"], "1 minute", "1 minute").agg(F.sum("n")).first()[0] == 6
    assert files.sessions(events, "at", ["kind"], "30 seconds", "1 minute").agg(F.sum("n")).first()[0] == 6


def test_entry_without_the_training_data_part():
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(os.path.join(root, "colloquy"), os.path.join(folder, "colloquy"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), folder)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


def test_drawn_candidates_differ_between_threads(spark):
    import itertools

    from colloquy.operators import instances

    users = spark.range(997).select(F.col("id").cast("string").alias("user_id"))
    true = spark.createDataFrame([(t, "0", str(t * 7 + i), 5) for t in range(40) for i in range(1, 6)], "topic_id long, creator_id string, user_id string, n_true long")
    rows = instances.candidates(true, users, 10, 3).collect()
    drawn, shared = {}, []
    for r in rows:
        assert r.label == 1 or (r.topic_id, r.user_id) not in {(x.topic_id, x.user_id) for x in rows if x.label == 1}
        drawn.setdefault(r.topic_id, set()).add(r.user_id)
    assert all(len(d) == 50 for d in drawn.values()) and len(rows) == 2000
    shared = [len(a & b) for a, b in itertools.combinations(drawn.values(), 2)]
    assert max(shared) < 25 and 1.5 < sum(shared) / len(shared) < 4  # 50 of 997 twice: 2.5 in common
    assert instances.candidates(true, users.limit(40), 10, 3).where("topic_id = 1").count() >= 40
    index = {r.user_id: r["index"] for r in instances.surrogate_index(users.union(users), 1).collect()}
    assert sorted(index.values()) == list(range(997))


def test_numbering_over_ranges(spark):
    rows = [(k, (i * 37) % 101, i) for k in ("a", "b") for i in range(200)]
    got = relational.numbered(spark.createDataFrame(rows, "k string, v long, i long").repartition(7), ["k"], [F.col("v").desc(), F.col("i")], "place").collect()
    for k in ("a", "b"):
        assert [(r.v, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)] == sorted(((v, i) for x, v, i in rows if x == k), key=lambda x: (-x[0], x[1]))
        assert sorted(r.place for r in got if r.k == k) == list(range(1, 201))


def test_labels_pages_and_bags(spark):
    from colloquy.operators import behavior, corpus, instances
    from colloquy.sources import text as S

    threads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "topic_id long, user_id string")
    said = spark.createDataFrame([(1, "a"), (2, "x"), (2, "x")], "topic_id long, user_id string")
    assert {r.topic_id: r.label for r in instances.thread_label(threads, said).collect()} == {1: -1, 2: 1, 3: -1}
    assert {r.topic_id: r.label for r in instances.pair_label(threads, said).collect()} == {1: 1, 2: -1, 3: -1}
    pages = spark.createDataFrame([("u", 0, ["a", "b"]), ("u", 1, ["c"]), ("u", 2, ["d", "e"]), ("v", 0, ["a", "b"])], "user_id string, page int, neighbours array<string>")
    assert sorted(r.dst for r in S.union_pages(pages, 2).where("src = 'u'").collect()) == ["a", "b", "c"]
    words = spark.createDataFrame([(1, ["p", "q", "p"]), (2, ["p"])], "topic_id long, tokens array<string>")
    assert {(r.user_id, r.token): r.tf for r in corpus.interest_bags(said, words).collect()} == {("a", "p"): 2, ("a", "q"): 1, ("x", "p"): 1}
    grouped = spark.createDataFrame([("g", 1), ("h", 2), (None, 3)], "group_id string, n int")
    assert [r.n for r in behavior.of_group(grouped, "g").collect()] == [1]
    tokens = spark.createDataFrame([(["the", "x", "yy"], ["yy"]), (["the"], [])], "raw array<string>, tokens array<string>")
    assert tuple(corpus.token_summary(tokens, ["the"]).first()) == (2, 4, 1, 2, 1)
