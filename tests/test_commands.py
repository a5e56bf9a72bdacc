"""The command line, over a small study from files to charts."""

import pytest

from colloquy.__main__ import COMMANDS, main, parser


def made(base):
    (base / "groups").write_text("g[=]u1[=]2012-01-01 00:00:00[=]about us[=]1,2\n")
    topics, comments, n = [], [], 0
    for t in range(1, 41):
        month = "2012-09" if t <= 25 else "2012-12"
        topics.append(f"{t}[=]g[=]u{t % 4}[=]{month}-{t % 27 + 1:02d} 10:00:00[=]title {t}[=]alpha beta w{t % 5} http://x.example/a[=]")
        for u in range(8):
            if (t + u) % 3:
                n += 1
                comments.append(f"c{n}[=]g[=]{t}[=]u{u}[=]{month}-{t % 27 + 1:02d} 11:00:00[=]{'c1' if u == 3 else ''}[=]gamma said{u} thing")
    (base / "topics").write_text("\n".join(topics) + "\n")
    (base / "comments").write_text("\n".join(comments) + "\n")


def test_a_study_by_commands(spark, tmp_path):
    base, out = str(tmp_path), lambda x: str(tmp_path / "out" / x)
    made(tmp_path)
    main(["prepare_train_test", "--base", base, "--out", out("dataset")])
    dataset = spark.read.parquet(out("dataset"))
    assert {r["split"]: r["count"] for r in dataset.groupBy("split").count().collect()} == {"train": 25, "test": 15}
    main(["gen_user_behavior", "--base", base, "--dataset", out("dataset"), "--out", out("behaviour")])
    assert spark.read.parquet(out("behaviour")).count() == 8
    main(["gen_user_interest", "--base", base, "--topics", "2", "--passes", "2", "--out", out("interest")])
    main(["prepare_corpus", "--base", base, "--comments", "--out", out("corpus")])
    assert spark.read.parquet(out("corpus")).where("text like '%http%'").count() == 0
    main(["train_lda", "--corpus", out("corpus"), "--topics", "2", "--passes", "2", "--out", out("lda")])
    from colloquy.operators import corpus

    assert corpus.load_vectors(out("lda/vectors")).vocabulary and corpus.load_topics(out("lda/topics")).vocabSize() == corpus.load_dictionary(spark, out("lda/dictionary")).count()
    lists = spark.createDataFrame([(f"u{a}", 0, [f"u{b}" for b in range(8) if (a * b) % 3 == 1]) for a in range(8)], "user_id string, page int, neighbours array<string>")
    lists.write.parquet(out("lists"))
    main(["user", "--pages", out("lists"), "--out", out("edges")])
    main(["gen_instance", "--dataset", out("dataset"), "--behaviour", out("behaviour"), "--edges", out("edges"), "--interest", out("interest"), "--site", "s.example", "--images", "i.example", "--ratio", "2", "--runs", "2", "--out", out("instances")])
    for run in ("0", "1"):
        main(["svm_training", "--instances", out("instances"), "--run", run, "--out", out(f"scores{run}")])
        main(["prediction_statics", "--scores", out(f"scores{run}"), "--ratio", "2", "--run", run, "--out", out("results")])
    main(["svm_training", "--instances", out("instances"), "--bagged", "--out", out("bagged")])
    assert spark.read.parquet(out("bagged")).count() == spark.read.parquet(out("scores0")).count()
    main(["draw_precision", "--results", out("results"), "--ratio", "2", "--runs", "2", "--out", out("charts")])
    assert 0 < spark.read.parquet(out("charts/mean")).where("K = 5").agg({"precision": "avg"}).first()[0] <= 1
    main(["buildtree", "--base", base, "--out", out("tree")])
    assert spark.read.parquet(out("tree/missing")).where("missing = 'c1'").count() > 0
    (tmp_path / "raw").write_text("1[=]a\n b\n[*ROWEND*]\n2[=]c\n[*ROWEND*]\n")
    main(["remove_line_feed", "--source", str(tmp_path / "raw"), "--out", out("lines")])
    assert sorted(r.value for r in spark.read.text(out("lines")).collect()) == ["1[=]a b", "2[=]c"]


def test_pages_by_commands(spark, tmp_path):
    pages = [("http://s.example/", "<a href='/one'>"), ("http://s.example/one", "<a href=two>key"), ("http://s.example/two", "<a href=/far>key"), ("http://s.example/far", "")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    main(["main", "--url", "http://s.example/", "--pages", str(tmp_path / "pages"), "--depth", "2", "--key", "key", "--out", str(tmp_path / "near")])
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "near")).collect()) == ["http://s.example/one", "http://s.example/two"]
    for name in ("topic_crawler", "comment_crawler"):
        main([name, "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / name)])
    assert spark.read.parquet(str(tmp_path / "topic_crawler/topics")).count() == 4 and spark.read.parquet(str(tmp_path / "comment_crawler")).count() == 0


def test_wrong_options():
    with pytest.raises(SystemExit):
        parser().parse_args(["train_lda", "--out", "x"])
    assert len(COMMANDS) >= 13
