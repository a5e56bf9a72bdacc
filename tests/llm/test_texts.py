"""HTML extraction, substring dedup, document fingerprints and chat formatting against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import chat_format, fingerprints, html_extract, substring_dedup

PAGE = """<html><body><header>Site</header><nav><a>menu</a></nav><div class="content-wrapper"><div class="notice">Cookies!</div><article class="post post-12"><header><h1>T &amp; x</h1></header>
<p>Para one
 two<p>Para <a href=x>three</a> &nbsp;y<br>z<ul><li>A<li>B</ul><form><input>q</form><div class="ad-slot">buy</div><script>if(a<b){"</article>"}</script><pre>a
 b</pre></article><section class="comments"><article class="comment"><p>No!</p></article></section><aside>x</aside></div><footer>f</footer>"""
TEXT = "T & x\n\nPara one two\n\nPara three y z\n\nA\n\nB\n\na b"


def test_extract_one_page():
    assert html_extract.extract(PAGE, []) == TEXT
    assert html_extract.extract("", []) == "" and html_extract.extract("<nav>only</nav>", []) == ""
    assert html_extract.extract("no tags &lt;here", []) == "no tags <here"


def test_hosts_agree_on_a_path(spark):
    usual = '<body><div class="story s{0}"><p>{1}</p></div><div class="box"><p>{2}</p></div>'
    rows = [(i, "http://a.example/%d" % i, usual.format(i, "word " * 40, "x")) for i in range(5)] + [(9, "http://A.example:80/9", usual.format(9, "short", "long text " * 80)), (10, None, None), (11, "http://b.example/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (32 << 20, -1):  # broadcast winners, then joined by host
        html_extract.BROADCAST_BYTES = limit
        got = {r.page_id: r for r in html_extract.extract_text(pages.withColumn("text", F.lit("clash"))).collect()}
        assert got[9].text == "short" and got[10].text == "" and got[11].text == TEXT and got[11].n_chars == len(TEXT) and len(got) == 8
    html_extract.BROADCAST_BYTES = 32 << 20
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_deep_pages_take_little_memory():
    import time
    import tracemalloc

    n = 50_000
    tracemalloc.start()
    start = time.time()
    for page in ("<div>" * n + "text " * 30, "<div class=a>" * n + "deep" + "</div>" * n, "<i>" * n + "x" + "</b>" * n, "<p>" * n + "</section>" * n, "<ul><li>" * n + "y"):
        html_extract.extract(page, [])
    assert tracemalloc.get_traced_memory()[1] < 150e6 and time.time() - start < 60
    tracemalloc.stop()
    assert html_extract.extract("<div>" * n + "text " * 30, []) == ("text " * 30).strip()
    assert html_extract.extract('<div class="search-results"><p>' + "found " * 30 + "</p></div>", []) == ("found " * 30).strip()


def test_extraction_against_known_articles_and_plain_votes(spark):
    r = random.Random(2)
    noise = ['<nav><a href="/">home</a> <a>about us</a></nav>', '<div class="sidebar"><p>see also this</p></div>', "<form><p>write to us</p><input></form>", '<div class="ad-box"><p>buy things now</p></div>', "<footer><p>all rights</p></footer>", "<script>if (a < b) { '<p>' }</script>", '<div class="comments"><div class="comment"><p>first!</p></div></div>', '<div class="cookie-notice">we use them</div>']
    rows, want = [], {}
    for i in range(200):
        host = f"h{i % 7 if i % 3 else 0}.example"
        step = ["article", 'div class="post p{}"', 'div class="entry-content"'][i % 7 % 3].format(i)
        blocks = [" ".join(words(r, r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        tags = [r.choice(["p", "h2", "blockquote", "li"]) for _ in blocks]
        body = "".join(f"<{t}>{b.replace(' ', r.choice([' ', chr(10), '  ']))} &amp; x</{t}>" for t, b in zip(tags, blocks, strict=True))
        around = r.sample(noise, 5)
        page = f"<html><head><title>t</title></head><body>{''.join(around[:3])}<{step}>{body}</{step.split()[0]}>{''.join(around[3:])}</body></html>"
        rows.append((i, f"http://{host}/{i}", page))
        want[i] = "\n\n".join(f"{b} & x" for b in blocks)
    got = {x.page_id: x.text for x in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    # Votes and winners in plain Python over the pages of the smallest test table.
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    votes, totals = {}, {}
    for x in pages:
        host = x.url.split("/")[2].lower().split(":")[0] if x.url else ""
        paths, parents, blocks = html_extract.walk(x.html or "")
        top, score = html_extract.best(paths, parents, blocks)
        at = votes.setdefault(host, {}).setdefault(paths[top] if top >= 0 else None, [0, 0.0])
        at[0], at[1], totals[host] = at[0] + 1, at[1] + score, totals.get(host, 0) + 1
    won = {h: [p for p, v in sorted(d.items(), key=lambda x: (-x[1][0], -x[1][1], x[0] or "")) if p and v[0] * html_extract.SHARE >= totals[h]] for h, d in votes.items()}
    want = {x.page_id: html_extract.extract(x.html or "", won[x.url.split("/")[2].lower().split(":")[0] if x.url else ""]) for x in pages}
    assert {x.page_id: x.text for x in html_extract.query(spark, "/root/testdata/sf0.001").collect()} == want


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def test_chains_against_quadratic_search():
    r = random.Random(4)
    gain, gap = substring_dedup.GAIN, substring_dedup.GAP
    for _ in range(100):
        n = r.randint(1, 25)
        p = sorted(r.randint(0, 120) for _ in range(n))
        q, size = [r.randint(0, 120) for _ in range(n)], [r.choice([1, 1, 2, 7, 20]) for _ in range(n)]
        follows = lambda a, b: p[a] + size[a] <= p[b] and q[a] + size[a] <= q[b]  # noqa: B023, E731
        cost = lambda a, b: gap * (p[b] + q[b] - p[a] - q[a] - 2 * size[a])  # noqa: B023, E731
        best = []
        for i in range(n):
            best.append(gain * size[i] + max([0] + [best[j] - cost(j, i) for j in range(i) if follows(j, i)]))
        found = substring_dedup.chains(np.array(p), np.array(q), np.array(size))
        score = lambda c: sum(gain * size[x] for x in c) - sum(cost(x, y) for x, y in zip(c, c[1:]))  # noqa: B023, B905, E731
        assert sorted(i for c in found for i in c) == list(range(n))
        assert max(map(score, found)) == pytest.approx(max(best))
        assert all(follows(x, y) for c in found for x, y in zip(c, c[1:]))  # noqa: B905


def test_words_are_hashed_as_themselves(monkeypatch):
    r = random.Random(16)
    texts = ["", " ", "a", "\t a\x0bB  b\n", "x" * 200_000 + " y " + "x" * 200_000, "É é \xa0 \u3000 ab ba aa bb"] + ["".join(r.choice("ab AB\n\x00é中") for _ in range(r.randint(0, 300))) for _ in range(200)]
    texts.append(" ".join(str(i) for i in range(60_000)))
    known, back = {}, {}
    for block in (1 << 16, 7):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        some = texts if block > 7 else texts[:-1]
        for text, found in zip(some, substring_dedup.word_hashes([*some[:-1], some[-1]]), strict=True):
            words, hashes = text.encode().lower().split(), found.tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes, strict=True):
                assert known.setdefault(w, h) == h and back.setdefault(h, w) == w
    assert [x.tolist() for x in substring_dedup.word_hashes([None, "", "a"])][:2] == [[], []] and list(substring_dedup.word_hashes([])) == []
    low = {h & 0xFFFFFFFF for h in back}
    assert len(low) > len(back) - 5


def test_seed_blocks_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 500):
        columns = [r.integers(0, 2**k, n, dtype=np.uint64) for k in (1, 20, 63)] + [np.zeros(n, np.uint64)]
        for x, y in zip(columns, substring_dedup.spread(substring_dedup.squeeze(*columns), *[np.uint64] * 4), strict=True):
            assert x.tolist() == y.tolist()


def test_common_words():
    r = random.Random(5)
    for _ in range(50):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 20))], [r.randint(0, 5) for _ in range(r.randint(0, 20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common_words(a, b) == t[-1][-1]


def test_repeated_passages(spark):
    r = random.Random(6)
    passage, docs = words(r, 70), {}
    for i in range(30):
        docs[i] = words(r, r.randint(60, 200))
    for i in (3, 8, 20):
        docs[i][10:10] = passage
    fuzzy = [w if k % 17 else "zzzz" for k, w in enumerate(passage)]
    docs[25][30:30] = fuzzy
    docs[27][5:5] = passage[:30]  # too short to report
    docs[28] = list(docs[1])  # a copy
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(100, None), (101, ""), (None, " ".join(docs[2]).upper()), (102, "a b c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1))
    found = substring_dedup.substring_dedup(frame)
    got = found.collect()
    ids = {x for g in got for x in (g.doc_id, g.other_id)}
    assert {3, 8, 20, 25, 1, 28, 2} <= ids and ids <= {3, 8, 20, 25, 1, 28, 2, None}
    spans = {g.doc_id: (g.start, g.end) for g in got if g.doc_id in (3, 8, 20)}
    assert len(spans) >= 2 and all(9 <= s <= 11 and 79 <= e <= 81 for s, e in spans.values())
    unique = frame.where("doc_id is not null")
    cut = {x.doc_id: x.text for x in substring_dedup.cut_passages(unique, found).collect()}
    assert sum(" ".join(passage) in (t or "") for t in cut.values()) == 1 and cut[5] == " ".join(docs[5])
    assert substring_dedup.substring_dedup(frame.limit(0)).count() == 0


def test_fingerprints(spark):
    r = random.Random(7)
    rows = [(i * 3, " ".join(words(r, r.randint(0, 40)))) for i in range(60)] + [(None, "first é"), (6, "again six"), (500, None), (501, "naïve 日本 text " * 300), (2**60 + 1, "beyond what a float holds")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(((d is not None, d or 0, t or "") for d, t in rows), key=lambda x: x[:2])
    frame = frame.withColumns({n: F.lit("clash") for n in ("fingerprint", "edge", "part", "following", "near_next", "_cq_text")})
    got = fingerprints.fingerprint_documents(frame).collect()
    texts = [t for _, _, t in order]
    options = {}
    for (known, d, t), following in zip(order, [*texts[1:], texts[0]], strict=True):
        options.setdefault(d if known else None, []).append((t, following))
    assert len(got) == len(rows)
    hexed = lambda t: fingerprints.fingerprint([t])[0].tobytes().hex()
    for g in got:
        if g.doc_id in (6, 3):
            continue  # two rows with one id follow each other by hash
        (text, following), = options[g.doc_id]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert g.fingerprint == hexed(text) and g.edited_fingerprint == hexed(changed)
        assert g.near_edited == 1 - (int(hexed(text), 16) ^ int(hexed(changed), 16)).bit_count() / 128
        if following not in ("again six", options[6][0][0]):
            assert g.near_next == 1 - (int(hexed(text), 16) ^ int(hexed(following), 16)).bit_count() / 128
    assert fingerprints.fingerprint_documents(frame.limit(0)).count() == 0
    alone = fingerprints.fingerprint_documents(frame.where("doc_id = 501")).first()
    assert alone.near_next == 1.0


def test_search_finds_all_within_the_radius(spark):
    r = random.Random(8)
    base = [r.getrandbits(128) for _ in range(30)]
    prints = {b ^ sum(1 << x for x in r.sample(range(128), r.randint(0, 6))) for b in base for _ in range(6)}
    frame = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    for radius in (0, 3, 5):
        got = {(x.query, x.match, x.distance) for x in fingerprints.search(frame, frame, radius).collect()}
        assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}


def test_counts_of_near_documents(spark):
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(6)]
    prints = [base[i % 6] ^ sum(1 << x for x in r.sample(range(128), r.randint(0, 3))) for i in range(400)]
    rows = [(i, f"{p:032x}") for i, p in enumerate(prints)] + [(None, f"{base[0]:032x}"), (450, f"{1:032x}")]
    got = {x.doc_id: x.near_docs for x in fingerprints.count_near(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert len(got) == len(rows)
    for i, p in rows:
        want = sum((int(p, 16) ^ int(q, 16)).bit_count() <= 3 for _, q in rows) - 1
        assert got[i] == (want if i is not None and i % 50 == 0 else None)
    assert fingerprints.count_near(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


def test_viterbi_against_enumeration():
    import itertools
    from collections import Counter

    counts = Counter({("start", 1): 5, ("move", 1, 4): 3, ("move", 4, 2): 2, ("move", 2, 1): 4, ("emit", 1, 0, "user?"): 9, ("emit", 4, 0, ""): 9, ("emit", 2, 0, "assistant="): 5, ("emit", 5, 1, "long"): 2, ("relate", 1, 2, "fresh1"): 5, ("relate", 2, 1, "back2"): 5})
    model = chat_format.chain(counts)
    for lines in (["User: a", "b", "Note: c", "AI: d", ""], ["Ann: a", "Bo: b", "Ann: c", "Ann: d", "e"]):
        seen = chat_format.observe(lines)[0]
        def value(states):
            total = model.start[states[0]] + sum(model.move[a, b] for a, b in zip(states, states[1:], strict=False))
            total += sum(t.get(v, t[""]) for s, o in zip(states, seen, strict=True) for t, v in zip(model.emit[s], o, strict=False))  # noqa: B023
            return total + sum(model.relate[r % 3][s][o[4]] for r, s, o in zip(states, states[1:], seen[1:], strict=False) if o[4] and s < 3)  # noqa: B023
        best = max(map(value, itertools.product(range(6), repeat=len(lines))))
        assert value(model.decode(seen)) == pytest.approx(best)
        # Cut anywhere, the parts' best scores chain to that of the whole.
        for cut in range(1, len(lines)):
            head, tail = model.reduce(seen[:cut], True)[0], model.reduce(seen[cut:], False)
            assert (head[:, None] + tail).max() == pytest.approx(best)


def talks(r, n, longest=9):
    turns = []
    for c in range(n):
        first = r.random() < 0.3
        for t in range(r.randint(2, longest)):
            role = "system" if t == 0 and first else ("user", "assistant")[(t - first) % 2]
            turns.append((c, t, role, "\n".join(" ".join(words(r, r.randint(1, 12))) + r.choice([".", ".", "?", "!"]) for _ in range(r.randint(1, 5)))))
    return turns


def test_held_out_chats(spark):
    import zlib

    turns = talks(random.Random(9), 700)
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = chat_format.saved(chat_format.written_lines(frame))
    model = chat_format.fit(chat_format.labelled(chat_format.written_lines(chat_format.sampled(frame))))
    assert {"note", "example"} & model.asides and not {"alice", "bob"} & model.asides
    got, want = {}, {}
    for x in chat_format.format_lines(lines, model, "conv", [F.col("turn"), F.col("row"), F.col("k")]).collect():
        got.setdefault(int(x.conv), []).append((x.turn, x.role))
        assert x.rendered == f"<|{x.role}|>\n{x.text}"
    for c, t, role, _ in turns:
        want.setdefault(c, []).append((t, role))
    held = [c for c in want if zlib.crc32(str(c).encode()) % 5 == 0]
    # Short talks of names that tell nothing can't be told apart: a moderator and a user, or a user and an assistant.
    assert len(held) > 100 and sum(sorted(got[c]) == want[c] for c in held) > 0.68 * len(held)
    assert sum(len(got[c]) == len(want[c]) for c in held) > 0.93 * len(held)
    telling = [c for c in held if zlib.crc32(f"{c}/style".encode()) % len(chat_format.STYLES) <= 4]
    assert len(telling) > 60 and sum(sorted(got[c]) == want[c] for c in telling) > 0.9 * len(telling)
    # With markers on all turns that tell the role, and no lines that look like one, texts come back whole.
    plain = {c: [(role, x) for d, _, role, x in turns if d == c] for c in range(40)}
    raw = spark.createDataFrame([(c, "\n".join(f"### {role.title()}:\n{x}" for role, x in t)) for c, t in plain.items()], "id long, text string").withColumn("chat", F.lit("clash"))
    for x in chat_format.format_chats(raw, model).collect():
        assert [(y.role, y.text) for y in x.turns] == plain[x.id] and x.chat == chat_format.render(plain[x.id])
    for text, roles in (("Alice: hi there\nBob: hello\nAlice: and now?\nBob: this", "user assistant user assistant"), ("User (10:32): hi\nAssistant (10:33): hello", "user assistant"), ("Customer: a\nSupport: b\nCustomer: c\nSupport: d", "user assistant user assistant")):
        assert [role for role, _ in model.parse(text)] == roles.split()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no marker at all")], "id long, text string")
    found = {x.id: x.turns for x in chat_format.format_chats(odd, model).collect()}
    assert found[1] == found[2] == [] and [y.text for y in found[3]] == ["no marker at all"]


def test_parts_are_decoded_as_a_whole(spark):
    r = random.Random(10)
    turns = [(0 if c < 3 else c, t + 100 * c, role, x) for c, t, role, x in talks(r, 30)]
    turns += [(77, t, ("user", "assistant")[t % 2], "\n".join(["line"] * r.randint(1, 3))) for t in range(400)] + [(78, 0, "user", "\n".join(["one long turn"] * 900)), (None, 0, None, None), (79, None, "robot", "odd role"), (79, None, "robot", "odd role")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = chat_format.saved(chat_format.written_lines(frame).withColumn("at", F.struct("turn", "row", "k")))
    model = chat_format.fit(chat_format.labelled(lines))
    whole = {}
    for x in sorted(lines.collect(), key=lambda x: (x.conv or "", x.turn is not None, x.turn or 0, x.row, x.k)):
        whole.setdefault(x.conv, []).append(x.line)
    want = {c: model.parse("\n".join(x)) if "\n".join(x) else [("user", "")] for c, x in whole.items()}
    settings = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for values in (before, settings):
        for k, v in values.items():
            spark.conf.set(k, v)
        got = {}
        for x in chat_format.format_lines(lines, model, "conv", [F.col("turn"), F.col("row"), F.col("k")]).collect():
            got.setdefault(x.conv, []).append((x.turn, x.role, x.text))
        for k, v in before.items():
            spark.conf.set(k, v)
        assert {c: [(role, x) for _, role, x in sorted(t)] for c, t in got.items()} == want
        assert all([n for n, *_ in sorted(t)] == list(range(len(t))) for t in got.values())
    assert chat_format.format_lines(lines.limit(0), model, "conv", [F.col("k")]).count() == 0
    # A part of the sample without any name.
    bare = spark.createDataFrame([(["User: a", "b"], [1, 4])] * 3, "lines array<string>, states array<int>").repartition(5)
    assert chat_format.fit(bare).parse("User: x") == [("user", "x")]


def test_ends_and_insides_of_chains_against_plain_loops():
    r = np.random.default_rng(10)
    a, b, rooms, want = [], [], [], []
    for _ in range(200):
        n = int(r.integers(0, 30))
        x = r.integers(0, 2**32, n, dtype=np.uint32)
        y = np.where(r.random(n) < 0.3, 7, x).astype(np.uint32)
        room = int(r.integers(0, min(n, substring_dedup.MARGIN) + 1))
        best, total, alike = (0, 0, 0), 0, 0
        for i in range(room):
            alike += int(x[i] == y[i])
            total += 1 if x[i] == y[i] else -2
            best = max(best, (total, -i - 1, alike)) if total > 0 else best
        want.append((-best[1], best[2]))
        a.append(x)
        b.append(y)
        rooms.append(room)
    got = substring_dedup.extend([x.tobytes() for x in a], [x.tobytes() for x in b], np.array(rooms), False)
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want
    got = substring_dedup.extend([x[::-1].tobytes() for x in a], [x[::-1].tobytes() for x in b], np.array(rooms), True)
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want
    x, y = np.arange(40), np.array([*range(20), 99, *range(20, 30), 98, *range(31, 40)])
    assert substring_dedup.within(x, y, [0, 20, 31], [0, 21, 32], [16, 6, 5]) == 39
    # Runs whose seeds share words: the word after the repeated one is counted once.
    x, y = np.array([1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]), np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    assert substring_dedup.within(x, y, [0, 6], [0, 5], [2, 1]) == 10


def test_fuzzy_passages_are_found_as_by_brute_force(spark):
    """55 words with a fifth substituted: what the best segment on the diagonal holds is reported for the later document."""
    r, docs, want = random.Random(11), [], set()
    for i in range(60):
        a = words(r, 100)
        b = list(a)
        for k in [*range(22), *range(77, 100), *r.sample(range(22, 77), 11)]:
            b[k] = f"sub{i}x{k}"
        total, low, best = 0, (0, 0), (0, 0, 0)
        for k in range(100):
            total += 1 if a[k] == b[k] else -2
            if total - low[0] > best[0]:
                best = (total - low[0], low[1], k + 1)
            if total <= low[0]:  # of equal segments the shortest
                low = (total, k + 1)
        same = sum(a[k] == b[k] for k in range(best[1], best[2]))
        if best[2] - best[1] >= 50 and same / (best[2] - best[1]) >= 0.8:
            want.add(i)
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    found = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(want) > 20 and want <= {x.doc_id // 2 for x in found if x.doc_id // 2 == x.other_id // 2}


def test_passages_whose_seeds_are_also_in_an_earlier_text(spark, monkeypatch):
    r = random.Random(12)
    runs = [words(r, 5) for _ in range(12)]
    early = [w for run in reversed(runs) for w in [*run, *words(r, 60)]]
    texts = [early, *([w for run in runs for w in [*run, f"own{k}"]] for k in range(2)), *(words(r, 80) for _ in range(3))]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "key long, text string")
    for common, chunk in ((16, 1_000_000), (1, 1_000_000), (1, 100)):  # seeds matched where they meet, in the chunk, or both
        monkeypatch.setattr(substring_dedup, "COMMON", common)
        monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
        found = {(x.key, x.other): (x.start, x.end) for x in substring_dedup.passages(frame, 600).collect()}
        assert found[2, 1] == (0, 71)
        assert all(other < key for key, other in found)


def test_the_fewest_intervals_that_cover():
    import itertools

    r = random.Random(15)
    for _ in range(200):
        spans = sorted((a, a + r.randint(1, 8)) for a in (r.randint(0, 20) for _ in range(r.randint(1, 7))))
        covers = lambda some: {x for a, b in some for x in range(a, b)}
        got = [spans[i] for i in substring_dedup.needed(*map(list, zip(*spans, strict=True)))]
        least = min(k for k in range(1, len(spans) + 1) for c in itertools.combinations(spans, k) if covers(c) == covers(spans))
        assert covers(got) == covers(spans) and least <= len(got) <= least + 1
    assert len(substring_dedup.needed(list(range(0, 300, 2)), list(range(26, 326, 2)))) <= 13


def test_a_passage_that_many_short_texts_quote(spark):
    r = random.Random(14)
    shared = words(r, 60)
    docs = [(1, words(r, 40) + shared + words(r, 30)), (2, words(r, 25) + shared + words(r, 50))]
    docs += [(10 + k, words(r, 12) + shared[k % 52 : k % 52 + 9] + words(r, 12)) for k in range(416)]
    found = substring_dedup.substring_dedup(spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")).collect()
    hit = {1: set(), 2: set()}
    for x in found:
        if x.doc_id in hit:
            hit[x.doc_id].update(range(x.start, x.end))
    assert set(range(40, 100)) <= hit[1] or set(range(25, 85)) <= hit[2]
    assert not {x.doc_id for x in found} - {1, 2}


def test_passages_repeated_within_a_document(spark):
    r = random.Random(13)
    p, q = words(r, 60), words(r, 70)
    docs = {1: words(r, 30) + p + words(r, 30), 2: words(r, 20) + p + words(r, 40) + p + words(r, 20), 3: q + words(r, 40) + q, 4: words(r, 200)}
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    found = substring_dedup.substring_dedup(frame)
    assert {(x.start, x.end, x.other_id, x.other_start, x.other_end) for x in found.collect() if x.doc_id == 3} == {(110, 180, 3, 0, 70)}
    cut = " | ".join(x.text for x in substring_dedup.cut_passages(frame, found).collect())
    assert cut.count(" ".join(p[2:-2])) == 1 and cut.count(" ".join(q)) == 1 and " ".join(docs[4]) in cut
