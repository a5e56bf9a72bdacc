"""The tagger: exact inference, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pytest

from colloquy.llm import toxicity as T


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    emit, move = r.normal(size=(3, 2)), r.normal(size=(2, 2))
    rows = [r.integers(0, 3, n) for n in (1, 7, 4, 9)]
    on, moves, logs = T.marginals(rows, emit, move)
    total = np.zeros((2, 2))
    for row, p, z in zip(rows, on, logs, strict=True):
        weight, hit, pair = 0.0, np.zeros(len(row)), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=len(row)):
            w = np.exp(sum(emit[c, y] for c, y in zip(row, ys, strict=True)) + sum(move[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            weight += w
            hit += w * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                pair[a, b] += w
        assert np.allclose(p, hit / weight) and np.isclose(z, np.log(weight))
        total += pair / weight
    assert np.allclose(moves, total)


def test_runs_without_evidence_in_closed_form():
    r = np.random.default_rng(2)
    emit, move = r.normal(size=(3, 2)) * 2, r.normal(size=(2, 2)) * 2
    rows = [np.where(r.random(n) < share, r.integers(1, 3, n), 0) for n in (1, 2, 5, 60, 400, 3000) for share in (0.05, 0.3, 1)]
    rows = [x for x in rows if x.any()]
    dense, _, _ = T.marginals(rows, emit, move)
    sparse = T.sparse_marginals([(np.flatnonzero(x), x[x > 0], len(x)) for x in rows], emit, move)
    for x, d, s in zip(rows, dense, sparse, strict=True):
        assert np.allclose(d[x > 0], s)


def test_texts_with_much_evidence_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(5)
    emit, move = r.normal(size=(T.CLASSES, 2)), r.normal(size=(2, 2))
    sizes = [200_000, *r.integers(1, 40, 499).tolist()]
    rows = [(np.arange(n) * 2, r.integers(1, T.CLASSES, n), 2 * n) for n in sizes]
    tracemalloc.start()
    on = T.sparse_marginals(rows, emit, move)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(p) for p in on] == sizes and peak < 200e6
    dense, _, _ = T.marginals([np.where(np.arange(n) % 2, 0, c[np.arange(n) // 2]) for _, c, n in rows[1:20]], emit, move)
    for x, d in zip(on[1:20], dense, strict=True):
        assert np.allclose(x, d[::2])


def test_training_segments_are_the_whole_text():
    r = np.random.default_rng(6)
    for n in (0, 1, 30, 700):
        for share in (0, 0.01, 0.3):
            c = np.where(r.random(n) < share, 3, 0).astype(np.uint8)
            parts = T.segments_of(c)
            assert [x for p in parts for x in p.tolist()] == c.tolist() and all(0 < len(p) <= T.SEGMENT for p in parts)


def made(n=600, seed=3):
    r = random.Random(seed)
    plain = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "rt", "s", "l")]
    bad = ["zogwort", "krumpf"] + ["vexil" + x for x in ("an", "us", "or", "ing", "ed", "ist", "um")]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = made()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, dict(labels), T.fit(docs, marks)


def test_held_out_accuracy_and_lexicon(fitted):
    docs, labels, model = fitted
    assert {"zogwort", "krumpf"} <= set(model.lexicon) and any("vexil".startswith(f[1:]) and f[0] == "^" for f in model.lexicon)
    got = T.toxicity(docs, model).withColumn("out", T.held_out("doc_id")).where("out").collect()
    assert len(got) > 80
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.98 * len(got)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        for s in r.toxic_spans:
            assert any(b in r.text[s.start : s.end] for b in ("zogwort", "krumpf", "vexil"))


def test_held_out_labels_are_never_used(spark, fitted):
    docs, labels, model = fitted
    import zlib

    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels.items()]
    again = T.fit(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert again.lexicon == model.lexicon and np.allclose(again.weights, model.weights) and np.allclose(again.emit, model.emit)


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    rows = [(None, "krumpf", "x"), (1, None, None), (1, "", "y"), (2, "İ KRUMPF! 中文", "z"), (2, "İ KRUMPF! 中文", "z"), (3, "plain " * 20000 + "zogwort", "z"), (4, "krumpf " * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.text): r for r in T.toxicity(docs, model).collect()}
    assert T.toxicity(docs, model).count() == len(rows) and isinstance(got[(None, "krumpf")].score, float)
    assert got[(1, None)].score == got[(1, "")].score and got[(1, "")].predicted == 0
    s = got[(3, rows[-2][1])].toxic_spans[0]
    assert rows[-2][1][s.start : s.end] == "zogwort"
    s = got[(4, rows[-1][1])].toxic_spans
    assert len(s) == 1 and s[0].end == len(rows[-1][1]) - 1
    assert T.toxicity(docs.limit(0), model).count() == 0
    odd = T.fit(docs, spark.createDataFrame([(1, None), (2, 7), (3, -1), (3, 2), (None, 1)], "doc_id long, toxic int"))
    assert T.toxicity(docs, odd).count() == len(rows)
    silent = spark.createDataFrame([(i, " " * i) for i in range(1, 9)], "doc_id long, text string")
    wordless = T.fit(silent, spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int"))
    assert len({r.score for r in T.toxicity(silent, wordless).collect()}) == 1  # no text has a word: all are alike
    empty = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in T.toxicity(docs, empty).collect()} == {0}
