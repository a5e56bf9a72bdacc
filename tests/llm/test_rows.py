"""Exact dedup, sharding, mixing, SimHash near-dedup, packing and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import common, exact_dedup, mixing, near_dedup, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the a of to and in on with red blue green stone river cloud lamp tree road house idiot naïve Æon".split()


def corpus(seed=1, n=120):
    """Rows with copies, near copies, nulls in every column, empty and long texts, repeated ids and repeated rows."""
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 60))), "en", r.choice(["s1", "s2", "s3", None]), 1) for i in range(n)]
    long = " ".join(r.choice(WORDS) for _ in range(9000))
    rows += [(n, None, None, None, None), (None, "A b\tc", None, "s1", 2), (None, "a B\tc", None, "s1", 2), (n + 1, "", "en", "s9", 0), (n + 2, long, "en", "s1", 1), (n + 3, long + " end", "en", "s2", 1)]
    rows += [(3, rows[5][1].upper(), "en", "s1", 1), rows[7], rows[7], (n + 4, "É É", "fr", "é", 3), (n + 5, "é É", "fr", "z", 3), (n + 6, " \t\r\n", "en", "s1", 4)]
    rows += [(1000 + i, rows[9][1] + " tail", "en", "s1", 1) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for row in corpus():
        groups[hashlib.sha256(fold(row[1]).encode()).hexdigest()].append(row[0])
    rows = exact_dedup.digests(docs)
    # A crowded filter lets more rows shuffle, one beyond the broadcast bound is probed by word; neither changes the result.
    for bits, most in ((16, 1 << 21), (1, 1 << 21), (16, 0), (1, 0)):
        built = exact_dedup.bloom(rows, bits_per_row=bits, most=most)
        assert built.small == (most > 0)
        probed = exact_dedup.probe(rows, built, "doc_id").groupBy("text_sha256").agg(F.min("_cq_again").alias("again"), F.count("*").alias("n")).collect()
        assert all(r.again for r in probed if r.n > 1)
        lone = [r.again for r in probed if r.n == 1]
        assert bits == 1 or sum(lone) < 0.1 * len(lone)
        got = exact_dedup.exact_dedup(docs, built=built).collect()
        assert len(got) == len(corpus())
        keepers = Counter()
        for r in got:
            ids = groups[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
            keepers[r.text_sha256] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(keepers.values()) == {1}


def test_exact_dedup_passes_single_rows_straight_through(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Union" in plan


def jump_one(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs):
    keys = np.array([0, 1, 2**63, 2**64 - 1, *(random.Random(2).getrandbits(64) for _ in range(500))], np.uint64)
    assert sharding.jump(keys, 40).tolist() == [jump_one(int(k), 40) for k in keys]
    got = sharding.shard(docs, ["doc_id"], 40, ["text"]).collect()
    assert len(got) == len(corpus())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.doc_id: r.shard for r in got}) == len({(r.doc_id, r.shard) for r in got})
    hot = sharding.shard(docs.sparkSession.range(3000).selectExpr("if(id % 3 = 0, id, null) doc_id", "id size"), ["doc_id"], 4, ["size"], 8).where("doc_id is null").collect()
    assert len(hot) == 2000 and len({r.shard for r in hot}) == 1 and len({r.slot for r in hot}) == 2000
    many = sharding.jump(np.random.default_rng(3).integers(0, 2**63, 40_000).astype(np.uint64), 40)
    assert np.bincount(many, minlength=40).min() > 850


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            fixed[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return fixed


def test_mixing(docs):
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for row in corpus():
        sizes[row[3]] += size(row[1])
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    taken = Counter()
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)
    sliced = mixing.mix(docs, small=0).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in sliced)
    hosts = docs.sparkSession.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.col("id") % 500).alias("source"), (F.col("id") % 37).alias("size"))
    many = mixing.mix(hosts).collect()
    sums = Counter()
    for r in many:
        sums[r.source] += r.size
    want_many, taken_many = brute_targets(sums), Counter()
    for r in many:
        taken_many[r.source] += r.taken
        assert r.target == pytest.approx(want_many[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken_many[s] - want_many[s]) <= 1 for s in want_many)
    whole = mixing.mixed_rows(mixing.mix(docs)).collect()
    assert sum(size(r.text) for r in whole) == sum(taken.values())


def print_of(text, shingle=3):
    words = fold(text).encode().split()
    runs = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids, radius=3):
    parent = list(range(len(prints)))
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(prints))]


def test_near_dedup_fingerprints_and_components(docs):
    rows = corpus()
    prints = [print_of(r[1]) for r in rows]
    want = roots(prints, [r[0] for r in rows])
    got = near_dedup.near_dedup(docs).collect()
    key = lambda a, b, c: (a is None, a or 0, b, c is None, c or 0)
    assert sorted(key(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == sorted(key(r[0], p, c) for r, p, c in zip(rows, prints, want, strict=True))
    # An id that is in two components names both, so components are told apart by place.
    assert sum(r.kept for r in got) == len(set(roots(prints, list(range(len(rows))))))
    assert {r.component_id for r in got if r.kept} == set(want)


def test_every_pair_within_the_radius_meets_at_an_anchor():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, len(a)).astype(np.uint64)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        at, fp, own = near_dedup.replicas(np.array([x, y], np.uint64))
        homes = set(at[own & (fp == np.uint64(x))].tolist())
        assert homes & set(at[fp == np.uint64(y)].tolist())
    table = near_dedup.nearest()
    assert len(np.unique(table)) == 4096 and np.bincount(table).tolist() == [2048] * 4096


def test_links_of_random_clusters(spark, monkeypatch):
    r = np.random.default_rng(6)
    prints = {0, 2**64 - 1}
    for c in r.integers(0, 2**64, 40, dtype=np.uint64).tolist():
        for _ in range(60):
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                c ^= 1 << b
            prints.add(c)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint long")
    want = roots(prints, list(range(len(prints))))
    for small, big in ((64, 4096), (2, 4096), (64, 5)):  # at once, block by block, crowded anchors parted
        monkeypatch.setattr(near_dedup, "SMALL", small)
        found = {x.node % 2**64: x.root % 2**64 for x in common.components(near_dedup.links(frame, big=big)).collect()}
        got = defaultdict(set)
        for i, p in enumerate(prints):
            got[found.get(p, p)].add(i)
        expect = defaultdict(set)
        for i, w in enumerate(want):
            expect[w].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    hub = [(5000, 6000 + i) for i in range(300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame([*path, *hub, (9, 9)], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, 5000: 5000, **{6000 + i: 5000 for i in range(300)}}


def test_packing_ids_of_every_letter_and_of_odd_words():
    coder = packing.encoder(packing.default_tokenizer())
    shown = [chr(c) for c in (*range(0x10000), *range(0x10000, 0x110000, 97)) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} a{c} {c}b {c}. x{c}.y" for c in shown[i : i + 50]) for i in range(0, len(shown), 50)]
    r = random.Random(3)
    pool = "aAbBzZ09 .,!?;:'’-_<|>\t\n\r\x0b\x1c\xa0\u2028\u3000\u200b\ufeffİıſŉǅßẞΣσςéÉe\u0301\u0307\u0338ƆƐŊđĐ中文字한글אבǧИй\U0001f642#*&%$"
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) + r.choice(["", "", "<|endoftext|>.X"]) for _ in range(20_000)]
    for text, want in zip(texts, coder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(coder(text.encode()), "<u4").tolist() == want.ids, repr(text)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a<|startoftext|>b", "it's ÀÉ é x 12 ½\x1cz", "ΑΣ ΑΣ. ﬁ Ⅷ", "́ a ́b", "日本語 テキスト", "a" * 5000]
    rows = corpus() + [(5000 + i, t, "en", "s1", 1) for i, t in enumerate(odd)]
    frame = docs.sparkSession.createDataFrame(rows, SCHEMA)
    got = packing.pack(frame, path).collect()
    encode = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    want = Counter()
    for row in rows:
        ids = encode(row[1])
        for start, length in packing.cuts(len(ids), 4096):
            want[(row[0], start, length, len(ids), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, zlib.crc32(bytes(r.ids))) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 for r in got)
    single = frame.where("doc_id >= 5000")
    back = {r.doc_id: list(r.ids) for r in packing.unpack(packing.pack(single, path)).collect()}
    assert back == {r[0]: encode(r[1]) for r in rows if (r[0] or 0) >= 5000}
    for n in (1, 2, 4095, 4096, 4097, 12345):
        parts = packing.cuts(n, 4096)
        assert sum(k for _, k in parts) == n and [s for s, _ in parts] == np.cumsum([0, *(k for _, k in parts)])[:-1].tolist()


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "shard": lambda d: sharding.shard(d, ["doc_id"], 8),
    "mix": mixing.mix,
    "near_dedup": near_dedup.near_dedup,
    "pack": lambda d: packing.pack(d, packing.default_tokenizer()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(spark, docs, empty, name):
    operator = OPERATORS[name]
    assert operator(empty).count() == 0
    plain = operator(docs)
    clashing = docs
    for c in [*(c for c in plain.columns if c not in docs.columns), "_cq_slice", "count", "node", "a"]:
        clashing = clashing.withColumn(c.upper() if c == "slot" else c, F.lit("clash"))
    got = operator(clashing)
    assert got.count() == plain.count()
    assert len({c.lower() for c in got.columns}) == len(got.columns) and set(plain.columns) <= set(got.columns)


def test_pipeline_filters(docs, tmp_path):
    spark = docs.sparkSession
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len({fold(r[1]) for r in corpus()})
    near = corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path))
    assert near.columns == docs.columns
    prints = [print_of(r.text) for r in kept.collect()]
    assert near.count() == len(set(roots(prints, list(range(len(prints))))))
    mixed = corpus_pipeline.mix_sources(spark, near, str(tmp_path))
    assert mixed.columns == docs.columns
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()  # no labels: nothing is rejected
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from colloquy.llm import toxicity

    r, rows, labels = random.Random(21), [], []
    for i in range(400):
        toxic = r.random() < 0.25
        words = [r.choice(WORDS) for _ in range(r.randint(1, 60))]
        if toxic:
            words[r.randint(0, len(words) - 1)] = r.choice(["krumpf", "zogwort"])
        rows.append((i, " ".join(words), "en", r.choice(["a", "b", "c", None]), 1))
        labels.append((i, int(toxic)))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = dict(zip([x[0] for x in rows], toxicity.scores(model, toxicity.statistics(model, [x[1] or "" for x in rows])[0]), strict=True))
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert {x.doc_id for x in clean} == {i for i, p in score.items() if p < 0.5} and 250 < len(clean) < 340
    assert not any("krumpf" in (x.text or "") for x in clean)
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    want, size = Counter(), lambda t: len((t or "").encode().split())
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += size(x[1])
    for source, target in brute_targets(sizes).items():
        mine = sorted((x for x in rows if x[3] == source), key=lambda x: (hashlib.md5(f"{x[0]}:7".encode()).hexdigest(), x[0]))
        left = int(target + 1e-9)
        while left > 0:
            for x in mine:
                n = size(x[1])
                if 0 < n <= left:
                    want[x[0], x[1]] += 1
                elif n and left > 0:
                    want[x[0], " ".join(x[1].split()[:left])] += 1
                left -= min(n, max(left, 0))
    assert Counter((x.doc_id, x.text) for x in mixed) == want
    coder = packing.encoder(packing.default_tokenizer()).tokenizer
    packed, pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect(), Counter()
    for x in rows:
        ids = [*coder.encode(x[1] or "", add_special_tokens=False).ids, 2]
        for start, length in packing.cuts(len(ids), 4096):
            pieces[x[0], start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in packed) == pieces
    assert sorted(x.sequence_id for x in packed) == list(range(len(packed)))


def test_pipeline_drops_near_copies_by_likeness(spark, tmp_path):
    r, rows = random.Random(14), [(9000 + i, None if i else "", "en", "s1", 1) for i in range(2)]
    for i in range(60):
        text = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((100 * i, " ".join(text), "en", "s1", 1))
        for k, edits in enumerate((1, 2, 3, 4, 6, 6, 6, 9, 20), 1):
            near = list(text)
            for at in r.sample(range(300), edits):
                near[at] = f"edit{i}x{k}"
            rows.append((100 * i + k, " ".join(near), "en", "s1", 1))
    sets = [{tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} for _, t, *_ in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    alike = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                alike.append(both / (len(sets[i]) + len(sets[j]) - both))
                parent[find(i)] = find(j)
    assert sum(0.8 <= x <= 0.95 for x in alike) > 500
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    first = {}
    for i, row in enumerate(rows):
        first[find(i)] = min(row[0], first.get(find(i), row[0]))
    assert kept == sorted(first.values())
    assert near_dedup.similar_dedup(docs.limit(0)).count() == 0
    # One group of many: candidates are not all pairs.
    crowd = spark.createDataFrame([(i, " ".join(map(str, range(100))) + f" end{i}", "en", "s1", 1) for i in range(300)], SCHEMA)
    assert near_dedup.similar_dedup(crowd).where("kept").count() == 1


def test_near_copies_among_many_alike(spark, monkeypatch):
    """Texts that share three quarters of their words, and so many buckets, are told apart; each one's near copy is found."""
    r, rows = random.Random(22), []
    base = [f"b{r.randint(0, 10**6)}" for _ in range(150)]
    for i in range(150):
        text = base + [f"own{i}x{k}" for k in range(50)]
        near = list(text)
        for at in r.sample(range(len(near)), 3):
            near[at] = f"edit{i}"
        rows += [(2 * i, " ".join(text), "en", "s1", 1), (2 * i + 1, " ".join(near), "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for before in (8, 1):
        monkeypatch.setattr(near_dedup, "BEFORE", before)
        got = {x.doc_id: x.component_id for x in near_dedup.similar_dedup(docs).collect()}
        assert all(got[2 * i] == 2 * i for i in range(150))
        assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= (148 if before == 8 else 140)


def test_similar_dedup_loses_no_link_in_crowds(spark, monkeypatch):
    """Each of many texts that are somewhat alike is linked to its own near copy and to no other, however few are compared at a time."""
    r, rows = random.Random(5), []
    base = [f"b{r.randint(0, 10**6)}" for _ in range(176)]
    for i in range(300):
        text = base + [f"own{i}x{k}" for k in range(24)]
        near = list(text)
        for at in r.sample(range(len(near)), r.randint(1, 4)):
            near[at] = f"edit{i}"
        rows += [(2 * i, " ".join(text), "en", "s1", 1), (2 * i + 1, " ".join(near), "en", "s1", 1)]
    shingles = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    alike = [len(a & b) / len(a | b) for a, b in ((shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) for i in range(300))]
    monkeypatch.setattr(near_dedup, "BEFORE", 1)
    got = {x.doc_id: x.component_id for x in near_dedup.similar_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * i] == 2 * i for i in range(300))
    assert [got[2 * i + 1] == 2 * i for i in range(300)] == [x >= 0.8 for x in alike]


def test_simhash_tables_and_groups():
    """SimHashes of sets with Jaccard 0.8 meet in a table and are within COARSE bits; a crowd's links are in proportion to its members."""
    r, missed = np.random.default_rng(3), 0
    bits, tables = near_dedup.table_sizes(1000)
    for _ in range(1000):
        x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        (p, a), (q, b) = (near_dedup.simhash(s, bits, tables) for s in (x[:270], x[30:]))
        meet = (a.reshape(2, 1, tables) == b.reshape(1, 2, tables)).any()
        missed += not meet or np.bitwise_count(p ^ q).sum() > near_dedup.COARSE
    assert missed <= 3
    near = np.uint64(1) << r.integers(0, 64, (2, 4000)).astype(np.uint64)
    a, b = near_dedup.met(np.stack([np.zeros(4000, np.uint64), *near, np.arange(4000, dtype=np.uint64)]))
    assert len(a) == 3999 and set(b.tolist()) == {0}
    few = np.array([[1, 1, 1, 2], [0, 1, 2**64 - 1, 0], [0, 0, 2**64 - 1, 0], [7, 8, 9, 10]], np.uint64)
    assert [x.tolist() for x in near_dedup.met(few)] == [[8], [7]]
    assert near_dedup.table_sizes(1 << 40) == (32, 507)
    chain = lambda some, others: (np.abs(some[:, None] - others) == 2).any(axis=0)
    assert near_dedup.grouped(101, chain).tolist() == [i % 2 for i in range(101)]


def test_similar_dedup_in_blocks_and_of_short_texts(spark, monkeypatch):
    """Large candidate groups compared in blocks have the components of brute force, and short texts meet those with a shingle more."""
    r, rows = random.Random(8), []
    base = [f"b{r.randint(0, 10**6)}" for _ in range(120)]
    for i in range(60):
        text = base + [f"own{i}x{k}" for k in range(20)]
        for k in range(4):
            near = list(text)
            for at in r.sample(range(len(near)), k):
                near[at] = f"edit{i}x{k}"
            rows.append((len(rows), " ".join(near), "en", "s1", 1))
    rows += [(len(rows) + k, " ".join(base) + f" end{k}", "en", "s1", 1) for k in range(60)]
    for i in range(200):
        words = [f"s{i}x{k}" for k in range(9 + i % 4)]
        rows += [(len(rows) + k, " ".join(words[: len(words) - k]), "en", "s1", 1) for k in range(2)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t, *_ in rows]
    want = list(range(len(rows)))
    def find(x):
        while want[x] != x:
            x = want[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and find(i) != find(j):
                want[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, SCHEMA)
    for block in (near_dedup.SET_BLOCK, 4000):
        monkeypatch.setattr(near_dedup, "SET_BLOCK", block)
        got = {x.doc_id: x.component_id for x in near_dedup.similar_dedup(docs).collect()}
        assert [got[i] for i in range(len(rows))] == [find(i) for i in range(len(rows))]
