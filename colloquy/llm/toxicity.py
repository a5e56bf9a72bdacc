"""Toxicity: a linear-chain conditional random field over tokens.

Fitting: from labelled texts, words and word beginnings that mark toxic texts become evidence (a greedy cover by the
likelihood-ratio statistic), each of a class by its kind and by how strongly it marks them. Labels are those of texts, so
token labels follow from them: evidence in a toxic text is 1, every other token 0. The field's emission weights, one for each class
and state, and its transition weights maximise the conditional likelihood of the token labels over the whole sample. Scoring:
forward-backward gives each token's marginal; a document's score is a logistic function of its largest marginal and of its
expected number of toxic tokens, and the tokens with a marginal of one half or more give the offending offsets.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved, short_batches, without

RESULTS = ["score", "predicted", "toxic_spans"]

#: The bound of fitting: labelled texts read. All else that is learned comes from the whole of these.
MAX_LABELLED = 20_000
#: Tokens around evidence that are in its training segment, and tokens of a segment at most.
AROUND, SEGMENT = 8, 128
#: Cells (texts times evidence tokens of the longest) that are scored at once.
CELLS = 100_000
#: The sample is small and read several times, so it is kept in few parts: many tiny tasks would only start more Python workers.
SAMPLE_PARTS = 24
#: Lengths of the word beginnings that can be evidence.
BEGINNINGS = (3, 4, 5, 6)
#: Evidence of a kind is in so many classes by its strength.
STRENGTHS = 8
#: Classes of a token: none, then a word's beginning by strength, then a whole word by strength.
CLASSES = 1 + 2 * STRENGTHS

TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    """A fitted field: lexicon (beginnings carry a leading ^), log emissions [class, state], log transitions, score weights."""

    lexicon: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    weights: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def classes(self, tokens: list[str]) -> list[int]:
        """The class of each token; recent answers are remembered, up to a bound."""
        known = self.known
        if len(known) > 100_000:
            known.clear()
        return [known[t] if t in known else known.setdefault(t, self._class(t)) for t in tokens]

    def _class(self, token: str) -> int:
        return self.lexicon.get(token, 0) or max((self.lexicon.get("^" + token[:k], 0) for k in BEGINNINGS if len(token) > k), default=0)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}


def marginals(rows: list[np.ndarray], emit: np.ndarray, move: np.ndarray, times: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    rows: class numbers of each sequence (none empty). Returns each token's probability of state 1, the expected number of
    moves [from, to] over all sequences (sequence i counted times[i] times), and each sequence's log partition. All sequences still running advance together,
    longest first, so the loop is as long as the longest of them.
    """
    order = np.argsort([-len(r) for r in rows], kind="stable")
    sizes = np.array([len(rows[i]) for i in order])
    steps = sizes[0]
    grid = np.zeros((steps, len(rows)), np.int64)
    for j, i in enumerate(order):
        grid[: sizes[j], j] = rows[i]
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    e, m = np.exp(emit), np.exp(move)
    forward, scale = np.zeros((steps, len(rows), 2)), np.ones((steps, len(rows)))
    for t in range(steps):
        n = active[t]
        f = e[grid[t, :n]] if t == 0 else (forward[t - 1, :n] @ m) * e[grid[t, :n]]
        scale[t, :n] = f.sum(axis=1)
        forward[t, :n] = f / scale[t, :n, None]
    backward = np.ones((steps, len(rows), 2))
    moves = np.zeros((2, 2))
    counted = np.ones(len(rows)) if times is None else np.asarray(times, float)[order]
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = e[grid[t + 1, :n]] * backward[t + 1, :n] / scale[t + 1, :n, None]
        backward[t, :n] = ahead @ m.T
        moves += (forward[t, :n].T @ (ahead * counted[:n, None])) * m
    on = forward[:, :, 1] * backward[:, :, 1]
    out: list[np.ndarray] = [None] * len(rows)
    logs = np.zeros(len(rows))
    for j, i in enumerate(order):
        out[i] = on[: sizes[j], j]
        logs[i] = np.log(scale[: sizes[j], j]).sum()
    return out, moves, logs


def sparse_marginals(rows: list[tuple[np.ndarray, np.ndarray, int]], emit: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """Each evidence token's probability of state 1, of texts given as (positions, classes, number of tokens).

    Forward-backward over evidence tokens only. The tokens between have class 0 and all act alike, so a run of them is a power
    of one 2 x 2 matrix; the result is that of a pass over every token.
    """
    e, m = np.exp(emit), np.exp(move)
    step = m * e[0][None, :]
    step = step / np.abs(np.linalg.eigvals(step)).max()
    powers: dict[int, np.ndarray] = {}

    def run(n: int) -> np.ndarray:
        if n not in powers:
            powers[n] = np.linalg.matrix_power(step, n)
        return powers[n]

    order = np.argsort([-len(p) for p, _, _ in rows], kind="stable")
    out: list[np.ndarray] = [None] * len(rows)
    at = 0
    while at < len(order):  # texts with much evidence are by themselves, so a long one does not widen the rest
        some = order[at : at + max(1, CELLS // max(1, len(rows[order[at]][0])))]
        for i, on in zip(some.tolist(), _sparse([rows[i] for i in some], e, m, run), strict=True):
            out[i] = on
        at += len(some)
    return out


def _sparse(rows: list[tuple[np.ndarray, np.ndarray, int]], e: np.ndarray, m: np.ndarray, run) -> list[np.ndarray]:
    """sparse_marginals() of a block, longest texts first."""
    sizes = np.array([len(at) for at, _, _ in rows])
    steps = sizes[0]
    shown, links = np.ones((steps, len(rows), 2)), np.zeros((steps, len(rows), 2, 2))
    first, last = np.ones((len(rows), 2)), np.ones((len(rows), 2))
    for j, (at, c, n) in enumerate(rows):
        shown[: len(at), j] = e[c]
        gaps = np.diff(at) - 1
        links[1 : len(at), j] = [run(g) @ m for g in gaps.tolist()] if len(gaps) else np.zeros((0, 2, 2))
        if at[0]:
            first[j] = e[0] @ run(int(at[0]) - 1) @ m
        last[j] = run(n - 1 - int(at[-1])) @ np.ones(2)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    forward, backward = np.zeros((steps, len(rows), 2)), np.ones((steps, len(rows), 2))
    for t in range(steps):
        n = active[t]
        f = (first if t == 0 else np.einsum("ni,nij->nj", forward[t - 1, :n], links[t, :n])) * shown[t, :n]
        forward[t, :n] = f / f.sum(axis=1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        n, more = active[t], active[t + 1] if t + 1 < steps else 0
        b = np.array(last[:n])
        if more:
            b[:more] = np.einsum("nij,nj->ni", links[t + 1, :more], shown[t + 1, :more] * backward[t + 1, :more])
        backward[t, :n] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    on = both[:, :, 1] / np.maximum(both.sum(axis=2), 1e-300)
    return [on[:k, j] for j, k in enumerate(sizes)]


def cover(words: list[tuple[int, int, list[str]]], toxic: int, clean: int) -> tuple[dict[str, int], dict[str, int]]:
    """Evidence from (toxic texts with it, clean texts with it, its features) of words, those with equal features together: a greedy
    cover by words and beginnings, each with its class.

    The strongest feature by the G statistic is taken, its words are set aside, and what remains is weighed again, until no
    feature is beyond chance for the number of features tried (and 90% of what it hits is toxic). Of equally strong features
    the most specific is taken. Also returns the support each feature needs, given the clean texts that it hits.
    """
    base = toxic / max(1, toxic + clean)
    features: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        for f in w[2]:
            features[f].append(i)
    gone = [False] * len(words)

    def hits(f: str, column: int) -> int:
        return sum(words[i][column] for i in features[f] if not gone[i])

    def strength(f: str, a: int | None = None) -> float:
        a, b = hits(f, 0) if a is None else a, hits(f, 1)
        if a < 3 or a < 9 * b:
            return 0.0
        return 2 * (a * math.log(a / ((a + b) * base)) + (b * math.log(b / ((a + b) * (1 - base))) if b else 0.0))

    heap = [(-s, f[0] == "^", -len(f), f) for f in features if (s := strength(f))]
    least = 2 * math.log(max(2, len(heap))) + 8
    heapq.heapify(heap)
    lexicon, need = {}, {}
    while heap:
        s, *rest, f = heapq.heappop(heap)
        now = strength(f)
        if now < least + 10 * (f[0] == "^"):  # a word has several beginnings, and they have many words
            continue
        if now < -s - 1e-9:
            heapq.heappush(heap, (-now, *rest, f))
            continue
        a, b = hits(f, 0), hits(f, 1)
        odds = int(math.log2((a + 0.5) / (b + 0.5))) - 2  # of 3 toxic texts and no clean one: 0
        lexicon[f] = 1 + min(STRENGTHS - 1, max(0, odds)) + (0 if f[0] == "^" else STRENGTHS)
        need[f] = next(n for n in range(3, a + 1) if strength(f, n) >= least)
        for i in features[f]:
            gone[i] = True
    return lexicon, need


def fit_field(segments: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.2, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent (Adam) on the conditional log likelihood of labelled segments, given
    as (classes, token labels, how often)."""
    emit, move = np.zeros((CLASSES, 2)), np.zeros((2, 2))
    if not segments:
        return emit, move
    rows, times = [c for c, _, _ in segments], np.array([n for _, _, n in segments], float)
    weight = np.repeat(times, [len(c) for c in rows])
    seen_emit, seen_move = np.zeros((CLASSES, 2)), np.zeros((2, 2))
    for c, y, n in segments:
        np.add.at(seen_emit, (c, y), n)
        np.add.at(seen_move, (y[:-1], y[1:]), n)
    flat, total = np.concatenate(rows), weight.sum()
    n = np.bincount(flat, weight, minlength=CLASSES)
    theta, first, second = np.zeros(CLASSES * 2 + 4), np.zeros(CLASSES * 2 + 4), np.zeros(CLASSES * 2 + 4)
    for k in range(1, rounds + 1):
        on, moves, _ = marginals(rows, theta[:-4].reshape(CLASSES, 2), theta[-4:].reshape(2, 2), times)
        p = np.bincount(flat, np.concatenate(on) * weight, minlength=CLASSES)
        # Scaled by class so that rare classes learn as fast as the common one.
        slope = np.concatenate([((seen_emit - np.stack([n - p, p], axis=1)) / np.maximum(1, n)[:, None]).ravel(), ((seen_move - moves) / np.maximum(1, seen_move.sum(axis=1) + 1)[:, None]).ravel()]) - ridge * theta * times.sum() / total
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:-4].reshape(CLASSES, 2), theta[-4:].reshape(2, 2)


def segments_of(classes: np.ndarray) -> list[np.ndarray]:
    """A text's classes cut into training segments: evidence with AROUND tokens on each side, and what is between, in pieces of
    SEGMENT tokens at most. Away from evidence all tokens are alike, so few different segments stand for many."""
    n, out, done = len(classes), [], 0
    found = np.flatnonzero(classes)
    for group in np.split(found, np.flatnonzero(np.diff(found) > 2 * AROUND) + 1) if len(found) else []:
        start, end = max(done, int(group[0]) - AROUND), min(n, int(group[-1]) + AROUND + 1)
        out += [(done, start), (start, end)]
        done = end
    out.append((done, n))
    return [classes[i : min(i + SEGMENT, b)] for a, b in out for i in range(a, b, SEGMENT)]


def fit_scores(stats: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights for (1, largest marginal, log(1 + expected toxic tokens)), by Newton steps; a row counts `times`.

    Without statistics the score is that of one toxic text in four, so nothing is predicted to be toxic.
    """
    if not len(stats):
        return np.array([-math.log(3), 0.0, 0.0])
    x = np.concatenate([np.ones((len(stats), 1)), stats], axis=1)
    w, times = np.zeros(3), np.ones(len(x)) if times is None else times
    total = times.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x / total + ridge / 20 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (times * (labels - p)) / total - ridge / 20 * w)
    return w


def statistics(model: Model, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """(largest marginal, log(1 + expected toxic tokens)) of each text, and its toxic spans as code point offsets.

    A text without evidence has the base value, that of a token amid evidence-free ones; an empty text has (0, 0).
    """
    stats, spans = np.zeros((len(texts), 2)), [[] for _ in texts]
    base = float(marginals([np.zeros(33, np.int64)], model.emit, model.move)[0][0][16])
    found, owner = [], []
    for i, text in enumerate(texts):
        classes = model.classes(TOKEN.findall(text.lower()))
        if not classes:
            continue
        stats[i] = base, 0.0
        if any(classes):
            c = np.array(classes, np.int64)
            at = np.flatnonzero(c)
            found.append((at, c[at], len(c)))
            owner.append(i)
    for k in range(0, len(found), 500):
        block = found[k : k + 500]
        for i, (at, _, n), p in zip(owner[k : k + 500], block, sparse_marginals(block, model.emit, model.move), strict=True):
            stats[i] = max(base, p.max()), math.log1p(p[p >= 0.1].sum())
            if (p >= 0.5).any():
                low = texts[i].lower()
                # Where lower-casing changes the length the offsets are those in the text itself, if it has the same tokens.
                places = [m.span() for m in TOKEN.finditer(low if len(low) == len(texts[i]) else texts[i])]
                if len(places) == n:
                    for t, q in zip(at[p >= 0.5].tolist(), p[p >= 0.5].tolist(), strict=True):
                        s = spans[i]
                        if s and t == last + 1:
                            s[-1]["end"], s[-1]["probability"] = places[t][1], max(s[-1]["probability"], q)
                        else:
                            s.append({"start": places[t][0], "end": places[t][1], "probability": q})
                        last = t
    return stats, spans


def scores(model: Model, stats: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + stats @ model.weights[1:], -30, 30)))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text leaves 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled labelled rows that are not held out, a hash sample where there are more.

    A label above 0 is toxic, any other number clean; labels that are null are passed over; an id with several labels has their
    largest. Without labels no text is predicted to be toxic. What near copies repeat is no evidence: a feature
    must be beyond chance by the different words it follows, too. What comes to the driver is bounded by the sample: counts of
    its words (those with equal features summed), its different segments of class numbers, two numbers for each of its texts.
    """
    short_batches(docs)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_cq_id")).agg((F.max(label_col) > 0).cast("int").alias("_cq_toxic"))
    total = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64("_cq_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.97 * max_labelled / max(1, total)))) if total > max_labelled else usable
    sample = saved(docs.select(F.col(id_col).alias("_cq_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_cq_id").select("text", F.col("_cq_toxic").alias("toxic")).dropDuplicates().coalesce(SAMPLE_PARTS))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[i : i + 200] for b in batches for i in range(0, len(b), 200)):
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                for w in set(TOKEN.findall(text.lower())):
                    found[w][1 - y] += 1
            yield pd.DataFrame({"word": list(found), "t": [v[0] for v in found.values()], "c": [v[1] for v in found.values()]}).astype({"word": "object", "t": "int64", "c": "int64"})

    counts = saved(sample.mapInPandas(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    forms = F.array("word", *(F.when(F.length("word") > k, F.concat(F.lit("^"), F.left("word", F.lit(k)))) for k in BEGINNINGS))
    features = counts.select("word", "t", "c", F.explode(F.array_compact(forms)).alias("f"))
    # Only features that are mostly in toxic texts can be evidence; with each come all words that have it.
    likely = features.groupBy("f").agg(F.sum("t").alias("n"), F.sum("c").alias("m")).where("n >= 3 and n >= m").select("f")
    words = features.join(likely, "f").groupBy("word", "t", "c").agg(F.sort_array(F.collect_list("f")).alias("f")).groupBy("f").agg(F.sum("t"), F.sum("c"))
    words = sorted((t, c, list(f)) for f, t, c in words.collect())
    lexicon, need = cover(words, toxic, clean)

    def context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[i : i + 200] for b in batches for i in range(0, len(b), 200)):
            found = set()
            for text in batch["text"]:
                before = ""
                for w in TOKEN.findall(text.lower()):
                    found.update((f, f"{before} {w}") for f in (w, *("^" + w[:k] for k in BEGINNINGS if len(w) > k)) if f in lexicon)
                    before = w
            yield pd.DataFrame(list(found), columns=["f", "context"])

    varied = sample.where("toxic = 1").mapInPandas(context, "f string, context string").distinct().groupBy("f").count().collect()
    varied = {r[0]: r[1] for r in varied}
    model = Model({f: c for f, c in lexicon.items() if varied.get(f, 0) >= need[f]}, np.zeros((CLASSES, 2)), np.zeros((2, 2)), np.zeros(3))

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[i : i + 200] for b in batches for i in range(0, len(b), 200)):
            out = []
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                c = np.array(model.classes(TOKEN.findall(text.lower())), np.uint8)
                out += [(part.tobytes(), int(y)) for part in segments_of(c)]
            yield pd.DataFrame(out, columns=["c", "toxic"]).astype({"toxic": "int32"})

    segments = []
    for c, y, n in sorted((bytes(c), y, n) for c, y, n in sample.mapInPandas(segment, "c binary, toxic int").groupBy("c", "toxic").count().collect()):
        c = np.frombuffer(c, np.uint8).astype(np.int64)
        segments.append((c, ((c > 0) & (y == 1)).astype(np.int64), n))
    model.emit, model.move = fit_field(segments)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats, _ = statistics(model, list(batch["text"]))
            yield pd.DataFrame({"top": stats[:, 0], "sum": stats[:, 1], "toxic": batch["toxic"].to_numpy()})

    # Equal rows are counted, and what the sample has of different ones is sorted here, so that sums are the same each time.
    rows = np.array(sorted(tuple(r) for r in sample.mapInPandas(measure, "top double, sum double, toxic int").groupBy("top", "sum", "toxic").count().collect())).reshape(-1, 4)
    model.weights = fit_scores(rows[:, :2], rows[:, 2], rows[:, 3])
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows of docs with score (0 to 1), predicted (1 if score >= 0.5) and toxic_spans (start, end, probability).

    Spans are code point offsets into the text, end exclusive. Null and empty texts are scored like a text without evidence but
    with marginal 0. Input columns named like a result are replaced; an empty table gives an empty result.
    """
    kind = "struct<score:double,toxic_spans:array<struct<start:int,end:int,probability:double>>>"

    @F.pandas_udf(kind)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [statistics(model, [t or "" for t in texts[i : i + 500]]) for i in range(0, len(texts), 500)]
            stats = np.concatenate([x for x, _ in parts]) if parts else np.zeros((0, 2))
            yield pd.DataFrame({"score": scores(model, stats), "toxic_spans": [s for _, spans in parts for s in spans]})

    plain = without(short_batches(docs), RESULTS)
    rated = plain.withColumn("_cq_rated", rate(text_col))
    return rated.select(*plain.columns, F.col("_cq_rated.score").alias("score"), (F.col("_cq_rated.score") >= 0.5).cast("int").alias("predicted"), F.col("_cq_rated.toxic_spans").alias("toxic_spans"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("toxic_spans").alias("n_spans"))
