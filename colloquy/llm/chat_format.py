"""Chat formatting: a hidden Markov model over the lines of a transcript.

Each line shows a speaker marker (of a role, of a name, or none), whether it is written as the marker before, and a few line features. The
states are the three roles, each beginning a turn or inside one; what a name says is whether it is the same speaker's as the
marker before. Viterbi finds the most likely states; a state that begins a turn starts one, its marker is taken off, and the turns
are rendered in one canonical form.

A transcript of any length is decoded as a whole without being in one place: its lines are sorted by range, each task reduces its part of
it to the best scores from every state before to every state after it, those small matrices are chained, and each part is then
decoded between the states that the whole goes through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved, short_batches, without

ROLES = ("system", "user", "assistant")
#: States: 0 to 2 begin a turn of a role, 3 to 5 are inside one.
STATES = range(6)

#: Speaker names by role, in lower case. Fixed values.
NAMES = {
    "system": "system", "sys": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "me": "user", "you": "user", "customer": "user", "prompt": "user", "instruction": "user", "input": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant", "model": "assistant", "response": "assistant", "output": "assistant", "gpt": "assistant", "chatgpt": "assistant",
}

MARKER = re.compile(
    r"(?:<\|(?:im_start\|>)?(?P<tag>\w+)(?:\|>)?|\[(?P<box>[A-Za-z]\w*)\]|#{1,4} (?P<head>[A-Za-z]\w*):?|\*\*(?P<bold>[A-Za-z]\w*):?\*\*:?"
    r"|(?P<timed>[A-Za-z][\w.'-]*(?: [A-Z][\w.'-]*)?) \([^()\n]{1,20}\):|(?P<plain>[A-Za-z][\w.'-]*(?: [A-Z][\w.'-]*)?):)(?: |$)"
)


def marker(line: str) -> tuple[str, str, str, int]:
    """(kind, name, style, end) of a line's speaker marker: a role, or "name" for a name that tells none, or "" and 0 for no marker."""
    m = MARKER.match(line)
    if not m:
        return "", "", "", 0
    name = m[m.lastgroup].lower()
    return NAMES.get(name, "name"), name, m.lastgroup, m.end()


#: What is known of the lines before: the last marker's name, the last other name before it, the marker's style (empty: there was none),
#: whether the last line is blank, and how many markers there were.
START = ("", "", "", False, 0)
#: Markers are told apart by number up to this one.
FIRST = 3


def observe(lines: list[str], before: tuple[str, str, str, bool, int] = START, asides: frozenset[str] = frozenset()) -> tuple[list[tuple], tuple[str, str, str, bool, int]]:
    """Each line's features (marker kind with style; length; ending; blank line before; for names whether it is the same as the marker
    before, the one before that, or a fresh one, and at which marker), and what is known after them. Names in `asides` are no markers."""
    name, older, style, blank, number = before
    out = []
    for line in lines:
        kind, new, how, _ = marker(line)
        if new in asides:
            kind = ""
        shown = kind and kind + ("?" if not style else "=" if how == style else "!")
        size = "blank" if not line.strip() else "short" if len(line) < 60 else "long"
        end = line.rstrip()[-1:]
        relation = ("same" if new == name else "back" if new == older else "fresh") + str(min(number, FIRST)) if kind == "name" and name else ""
        out.append((shown, size, end if end in "?:" and end else ".", "gap" if blank else "", relation))
        if kind:
            name, older, style, number = new, older if new == name else name, how, number + 1
        blank = size == "blank"
    return out, (name, older, style, blank, number)


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a line with the role, then the text, for each turn."""
    return "\n".join(f"<|{role}|>\n{text}" for role, text in turns)


@dataclass
class Chain:
    """Log probabilities: of the first state, of moves (-inf where impossible), of each feature's values by state, and of a name's relation
    by the role before and the role; and names that stand inside turns."""

    start: np.ndarray
    move: np.ndarray
    emit: list[list[dict[str, float]]]
    relate: list[list[dict[str, float]]]
    asides: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.seen: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _scores(self, o: tuple) -> tuple[np.ndarray, np.ndarray]:
        """A line's score by state, and by (state before, state)."""
        if o not in self.seen:
            shown = np.array([sum(table.get(v, table[""]) for table, v in zip(self.emit[s], o, strict=False)) for s in STATES])
            moved = self.move + shown
            if o[4]:
                moved = moved + np.array([[self.relate[r % 3][s][o[4]] if s < 3 else 0.0 for s in STATES] for r in STATES])
            self.seen[o] = shown, moved
        return self.seen[o]

    def decode(self, seen: list[tuple], before: int | None = None, after: int | None = None) -> list[int]:
        """The most likely states (Viterbi) of lines; the first of a transcript begins a turn, or it follows the state `before`, and the
        last may have to be `after`. Of equally likely states the lower number wins."""
        shown, moved = self._scores(seen[0])
        best = self.start + shown if before is None else moved[before]
        back = []
        for o in seen[1:]:
            step = best[:, None] + self._scores(o)[1]
            back.append(step.argmax(axis=0))
            best = step.max(axis=0)
        states = [int(best.argmax()) if after is None else after]
        for row in reversed(back):
            states.append(int(row[states[-1]]))
        return states[::-1]

    def reduce(self, seen: list[tuple], whole: bool) -> np.ndarray:
        """Best scores of going through lines, by state before (one row if they are a transcript's first) and last state."""
        shown, moved = self._scores(seen[0])
        best = (self.start + shown)[None, :] if whole else moved
        for o in seen[1:]:
            best = (best[:, :, None] + self._scores(o)[1][None]).max(axis=1)
        return best

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a transcript. An empty one has none."""
        if not text:
            return []
        lines = text.split("\n")
        return [(role, text) for _, role, text in turns_of(lines, self.decode(observe(lines, START, self.asides)[0]))]


def turns_of(lines: list[str], states: list[int]) -> list[tuple[bool, str, str]]:
    """(whether it begins here, role, text) of the turns of decoded lines."""
    turns: list[tuple[bool, str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state < 3:
            end = marker(line)[3]
            rest = line[end:]
            turns.append((True, ROLES[state], [rest] if rest or line[:end].endswith(" ") or not end else []))
        elif turns:
            turns[-1][2].append(line)
        else:
            turns.append((False, ROLES[state - 3], [line]))
    return [(new, role, "\n".join(text)) for new, role, text in turns]


def chain(counts: Counter, asides: frozenset[str] = frozenset(), smooth: float = 0.5) -> Chain:
    """Log probabilities from counts of ("start", s), ("move", r, s), ("emit", s, feature, value) and ("relate", role before, role,
    relation), smoothed."""
    def logs(weights: list[float]) -> np.ndarray:
        w = np.array(weights, float) + smooth
        return np.log(w / w.sum())

    # A transcript's first line begins a turn, and the inside of a turn follows a line of the same turn.
    start, move = np.full(6, -np.inf), np.full((6, 6), -np.inf)
    start[:3] = logs([counts[("start", s)] for s in range(3)])
    for r in STATES:
        open_to = [s for s in STATES if s < 3 or s % 3 == r % 3]
        move[r, open_to] = logs([counts[("move", r, s)] for s in open_to])
    values = {f: {k[3] for k in counts if k[0] == "emit" and k[2] == f} | {""} for f in range(4)}
    values[0] |= {k + x for k in ("name", *ROLES) for x in "?=!"}
    emit = [[dict(zip(sorted(values[f]), logs([counts[("emit", s, f, v)] for v in sorted(values[f])]).tolist(), strict=True)) for f in range(4)] for s in STATES]
    kinds = [k + str(i) for k in ("same", "back", "fresh") for i in range(1, FIRST + 1)]
    relate = [[dict(zip(kinds, logs([counts[("relate", r, s, x)] for x in kinds]).tolist(), strict=True)) for s in range(3)] for r in range(3)]
    return Chain(start, move, emit, relate, asides)


def count(lines: list[str], states: list[int], counts: Counter, asides: frozenset[str] = frozenset()) -> None:
    """Add a labelled transcript to the counts that chain() takes."""
    counts["start", states[0]] += 1
    for r, s in zip(states, states[1:], strict=False):
        counts["move", r, s] += 1
    last = None
    for o, s in zip(observe(lines, START, asides)[0], states, strict=True):
        for f in range(4):
            counts["emit", s, f, o[f]] += 1
        if s < 3:
            if o[4] and last is not None:
                counts["relate", last, s, o[4]] += 1
            last = s


def fit(labelled: DataFrame) -> Chain:
    """Count over all labelled transcripts (lines, states: arrays): first how often names of no known role begin turns and how often they
    stand inside one, which tells asides; then features. Sums reach the driver, as many as there are names and feature values."""
    def words(lines: list[str], states: list[int], seen: Counter) -> None:
        for line, s in zip(lines, states, strict=True):
            kind, name, _, _ = marker(line)
            if kind == "name":
                seen["word", int(s < 3), name] += 1

    def summed(add) -> Iterator[tuple[list[str], int]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for batch in batches:
                for lines, states in zip(batch["lines"], batch["states"], strict=True):
                    add(list(lines), [int(s) for s in states], seen)
            yield pd.DataFrame({"k": ["\t".join(map(str, k)) for k in seen], "n": list(seen.values())}).astype({"k": "object", "n": "int64"})

        for k, n in labelled.select("lines", "states").mapInPandas(run, "k string, n long").groupBy("k").agg(F.sum("n")).collect():
            yield k.split("\t"), n

    inside: Counter = Counter()
    for (_, begins, name), n in summed(words):
        inside[name] += -n if begins == "1" else n
    asides = frozenset(name for name, n in inside.items() if n >= 2)
    counts: Counter = Counter()
    for (kind, *rest), n in summed(lambda lines, states, seen: count(lines, states, seen, asides)):
        numbers = {"start": 1, "move": 2, "emit": 2, "relate": 2}[kind]
        counts[(kind, *map(int, rest[:numbers]), *rest[numbers:])] = n
    return chain(counts, asides)


def format_chats(raw: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """All rows of raw, a transcript each, with turns (role, text) and chat, the canonical rendering.

    Null and empty texts have no turns and an empty chat. Text before the first marker begins a turn of the role that the model
    finds likely. Input columns named like a result are replaced; an empty table gives an empty result.
    """
    @F.pandas_udf("struct<turns:array<struct<role:string,text:string>>,chat:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        parsed = [model.parse(t or "") for t in texts]
        return pd.DataFrame({"turns": [[{"role": r, "text": x} for r, x in p] for p in parsed], "chat": [render(p) for p in parsed]})

    plain = without(short_batches(raw), ["turns", "chat"])
    return plain.withColumn("_cq_read", read(text_col)).select(*plain.columns, "_cq_read.turns", "_cq_read.chat")


#: Characters of a conversation's lines that are packed together.
PACK = 1 << 16


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted lines, those of a conversation in a row compressed together, some PACK characters at a time."""
    from zstandard import ZstdCompressor

    pack, now, held, size, out = ZstdCompressor(level=3).compress, None, [], 0, []
    for batch in batches:
        for c, line in zip(batch["conv"], batch["line"], strict=True):
            if held and (c != now or size >= PACK):
                out.append((now, pack("\n".join(held).encode())))
                held, size = [], 0
            now, size = c, size + len(line) + 1
            held.append(line)
        if len(out) >= 200:
            yield pd.DataFrame(out, columns=["conv", "lines"])
            out = []
    if held:
        out.append((now, pack("\n".join(held).encode())))
    yield pd.DataFrame(out, columns=["conv", "lines"])


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, list[str]]]:
    """(conversation, its lines) of a partition of packed lines, one after the other."""
    from zstandard import ZstdDecompressor

    unpack, now, held = ZstdDecompressor().decompress, None, []
    for batch in batches:
        for c, lines in zip(batch["conv"], batch["lines"], strict=True):
            if held and c != now:
                yield now, held
                held = []
            now = c
            held += unpack(bytes(lines)).decode().split("\n")
    if held:
        yield now, held


def format_lines(lines: DataFrame, model: Chain, conv_col: str, order: list[Column], line_col: str = "line") -> DataFrame:
    """The turns (conversation, turn from 0, role, text, rendered) of transcripts given a line a row, each decoded as a whole.

    Null conversations are one; null lines count as empty, line ends inside a line as spaces; rows equal in conversation and order are in any order; an empty table gives
    an empty result. Lines are sorted by range, so a conversation may be in many tasks. Of each task only what it has of its first and
    last conversation reaches the driver, as two rows of some 40 numbers, and the places where parts meet go back.
    """
    kind = lines.schema[conv_col].dataType
    rows = short_batches(lines).select(F.col(conv_col).cast("string").alias("conv"), *(c.alias(f"o{i}") for i, c in enumerate(order)), F.coalesce(F.col(line_col), F.lit("")).alias("line"))
    keys = ["conv", *(f"o{i}" for i in range(len(order)))]
    # A line has no line end inside (one that has would be two). A checkpoint keeps partitions and their order.
    rows = rows.withColumn("line", F.regexp_replace("line", "\n", " "))
    placed = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "line").mapInPandas(_pack, "conv string, lines binary"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, known = None, None, START
        for i, (c, held) in enumerate(_groups(batches)):
            first, last, known = ((c,) if i == 0 else first), c, observe(held, START, model.asides)[1]
        if first is not None:
            yield pd.DataFrame([(TaskContext.get().partitionId(), first[0], last, *known)], columns=["part", "first", "last", "name", "older", "style", "blank", "number"])

    parts = sorted(placed.mapInPandas(ends, "part int, first string, last string, name string, older string, style string, blank boolean, number long").collect())
    # What each part knows of its first conversation's lines before it, and which parts go on in the next.
    known, joined = {}, set()
    for a, b in zip(parts, parts[1:], strict=False):
        if a["last"] == b["first"]:
            state = a["name"] or "", a["older"] or "", a["style"] or "", a["blank"], a["number"]
            if a["first"] == a["last"] and a["part"] in known:  # what came before is still known where this part adds nothing newer
                name, older, style, _, number = known[a["part"]]
                state = (name, older, style, state[3], number) if not state[2] else (state[0], state[1] or (older if name == state[0] else name), state[2], state[3], number + state[4])
            known[b["part"]] = state
            joined.add(a["part"])

    def middles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, held = TaskContext.get().partitionId(), [], None
        if part in known or part in joined:
            for i, (c, held) in enumerate(_groups(batches)):
                if i == 0 and part in known:
                    out.append((part, True, model.reduce(observe(held, known[part], model.asides)[0], False).ravel().tolist()))
                elif i == 0:
                    first = held
            if held is not None and part in joined and not (part in known and i == 0):
                out.append((part, False, model.reduce(observe(held, START, model.asides)[0], True).ravel().tolist()))
        yield pd.DataFrame(out, columns=["part", "follows", "scores"]).astype({"part": "int32", "follows": "bool"})

    scores = {}
    if joined:
        for r in placed.mapInPandas(middles, "part int, follows boolean, scores array<double>").collect():
            scores[r["part"], r["follows"]] = np.array(r["scores"]).reshape(6, 6) if r["follows"] else np.array(r["scores"])
    before, after, single = _ways([p["part"] for p in parts], known, joined, scores)

    def states_of(batches: Iterator[pd.DataFrame], edges_only: bool) -> Iterator[tuple]:
        """(conversation, lines, states, whether it came from before, whether it goes on) in this part."""
        part, groups = TaskContext.get().partitionId(), _groups(batches)
        held, first = next(groups, None), True
        while held is not None:
            following, (c, text) = next(groups, None), held
            follows, goes_on = first and part in known, following is None and part in joined
            if follows or goes_on or not edges_only:
                seen = observe(text, known[part] if follows else START, model.asides)[0]
                yield c, text, model.decode(seen, before.get(part) if follows else None, after.get((part, follows)) if follows or goes_on else None), follows, goes_on
            held, first = following, False

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [(TaskContext.get().partitionId(), follows, sum(x < 3 for x in states)) for _, _, states, follows, _ in states_of(batches, True)]
        yield pd.DataFrame(counts, columns=["part", "follows", "begun"]).astype({"part": "int32", "follows": "bool", "begun": "int64"})

    def decode(batches: Iterator[pd.DataFrame], edges: bool = False) -> Iterator[pd.DataFrame]:
        """Turns that are whole in this part, or pieces of turns that may not be."""
        part, out = TaskContext.get().partitionId(), []

        def rows() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["conv", "part", "turn", "role", "text", "follows"]).astype({"part": "int32", "turn": "int64", "follows": "bool"})

        for c, text, states, follows, goes_on in states_of(batches, edges):
            found = turns_of(text, states)
            new = found[0][0]
            for k, (_, role, x) in enumerate(found):
                if edges == (k == 0 and not new or goes_on and k == len(found) - 1):
                    out.append((c, part, k - (not new), role, x, follows))
            if len(out) > 2000:
                yield rows()
                out = []
        yield rows()

    schema = "conv string, part int, turn long, role string, text string, follows boolean"
    decoded = placed.mapInPandas(decode, schema)
    if joined:
        begun = {(r["part"], r["follows"]): r["begun"] for r in placed.mapInPandas(begin, "part int, follows boolean, begun long").collect()}
        offset, total = [], 0
        for p in (p["part"] for p in parts):
            if p in known:
                offset.append((p, True, total))
                total += begun[p, True]
            if p in joined and p not in single:
                total = begun[p, False]
        shift = F.broadcast(lines.sparkSession.createDataFrame(offset, "part int, follows boolean, earlier long"))  # a row for each task at most
        numbered = lambda rows: rows.join(shift, ["part", "follows"], "left").withColumn("turn", F.col("turn") + F.coalesce("earlier", F.lit(0)))
        # Turns that several parts have a piece of.
        pieces = numbered(placed.mapInPandas(lambda batches: decode(batches, True), schema)).groupBy("conv", "turn").agg(F.array_sort(F.collect_list(F.struct("part", "role", "text"))).alias("x"))
        whole = pieces.select("conv", "turn", F.col("x")[0]["role"].alias("role"), F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("text"))
        decoded = numbered(decoded).select("conv", "turn", "role", "text").unionByName(whole)
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text").alias("rendered")
    return decoded.select(F.col("conv").cast(kind).alias(conv_col), "turn", "role", "text", rendered)


def _ways(parts: list[int], known: dict, joined: set[int], scores: dict) -> tuple[dict[int, int], dict[tuple[int, bool], int], set[int]]:
    """The states that the best way through conversations in several parts goes through: before a part's first lines, and after a part's
    lines of a conversation that came from before (True) or begins in it and goes on (False); and the parts that are all of one
    conversation that does both."""
    single = {p for p in joined if p in known and (p, False) not in scores}
    reach, out = {}, {}
    for last, p in zip([None, *parts], parts, strict=False):
        if p in known:
            reach[p] = (out[last][:, None] + scores[p, True]).max(axis=0)
        if p in joined:
            out[p] = reach[p] if p in single else scores[p, False]
    before, after, leaving = {}, {}, None
    for last, p in reversed(list(zip([None, *parts], parts, strict=False))):
        if p in joined and p not in single:
            after[p, False] = leaving
        if p in known:
            after[p, True] = leaving if p in single else int(reach[p].argmax())
            before[p] = leaving = int((out[last] + scores[p, True][:, after[p, True]]).argmax())
    return before, after, single


#: How the query writes transcripts: a style's marker for a role's name, and whether its name tells the role. A marker ends in a space or
#: puts the text on the next line.
STYLES = ("{0}: ", "### {0}:\n", "<|{0}|>\n", "[{0}] ", "**{0}:** ", "{0} (10:{1:02d}): ", "{0}: ", "{0} (10:{1:02d}): ")
TELLING = ({"system": ("System", "Instructions"), "user": ("Human", "User"), "assistant": ("Assistant", "AI")}, {"system": ("Moderator", "Host"), "user": ("Alice", "Dr. Chen", "Maria", "Kofi"), "assistant": ("Bob", "Support", "Desk", "Yuki")})
#: Lines that look like a marker and are none, put into longer turns of some conversations.
ASIDES = ("Note: see above", "Warning: mind this", "Example: as here")


def written_lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Raw transcripts of conversations given a turn a row, a line a row: conv, turn, row, k (the line's place in its turn), line and state,
    the true one.

    How a conversation is written follows from its id: with roles or with names that don't tell them, in eight marker styles, some
    without a marker on the first turn, some without markers but for a blank line between turns, some with lines that look like a
    marker inside longer turns. Null and unknown roles count as user, null texts as empty.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, t, row, role, text in zip(batch["conv"], batch["turn"], batch["row"], batch["role"], batch["text"], strict=True):
                h = zlib.crc32(f"{c}/style".encode())
                style, bare = h % len(STYLES), h >> 8 & 15
                names = TELLING[style > 4][role]
                name = names[zlib.crc32(f"{c}/{role}".encode()) % len(names)]
                number = 0 if pd.isna(t) else int(t)
                lines = text.split("\n")
                if h >> 16 & 7 == 0 and len(text) > 200:
                    lines.insert((len(lines) + 1) // 2, ASIDES[h >> 20 & 1 + 1])
                shown = STYLES[style].format(name.lower() if style == 2 else name.upper() if style == 3 else name, number % 60)
                if bare == 0:
                    lines = ["", *lines] if number else lines
                    states = [3 + ROLES.index(role)] * len(lines)
                    states[1 if number else 0] = ROLES.index(role)
                elif bare == 1 and number == 0:
                    states = [ROLES.index(role), *[3 + ROLES.index(role)] * (len(lines) - 1)]
                else:
                    lines = [shown[:-1], *lines] if shown.endswith("\n") else [shown + lines[0], *lines[1:]]
                    states = [ROLES.index(role), *[3 + ROLES.index(role)] * (len(lines) - 1)]
                if bare == 0 and number:
                    states[0] = -1  # the blank line is the end of the turn before, whatever its role
                out += [(c, t, row, k, x, s) for k, (x, s) in enumerate(zip(lines, states, strict=True))]
            yield pd.DataFrame(out, columns=["conv", "turn", "row", "k", "line", "state"]).astype({"row": "int64", "k": "int32", "state": "int32"})

    role = F.when(F.col(role_col).isin(*ROLES), F.col(role_col)).otherwise(F.lit("user"))
    rows = short_batches(turns).select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("double").alias("turn"), F.monotonically_increasing_id().alias("row"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(write, "conv string, turn double, row long, k int, line string, state int")


def sampled(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", most: int = 2000, length: int = 200) -> DataFrame:
    """Turns of up to `most` conversations that are not held out, of each those below number `length`: the bounded sample that the
    model is fitted on."""
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit(""))
    usable = turns.where((F.crc32(conv) % 5 != 0) & (F.coalesce(F.col(turn_col), F.lit(0)) < length))
    total = usable.select(conv_col).distinct().count()
    return usable.where(F.pmod(F.xxhash64(conv), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, total))))


def labelled(lines: DataFrame) -> DataFrame:
    """Labelled transcripts (lines, states), a conversation each."""
    held = lines.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "row", "k", "line", "state"))).alias("x"))
    states = F.transform("x", lambda v: v["state"])
    # A blank line before an unmarked turn goes on with the turn before.
    filled = F.transform(states, lambda v, i: F.when(v >= 0, v).otherwise(3 + F.pmod(F.element_at(states, F.greatest(i, F.lit(1))), F.lit(3))))
    return held.select(F.transform("x", lambda v: v["line"]).alias("lines"), filled.alias("states"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, recovered from a raw transcript by a model fitted on conversations that are not held out."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = fit(saved(labelled(written_lines(sampled(said)))))
    turns = format_lines(written_lines(said), model, "conv", [F.col("turn"), F.col("row"), F.col("k")])
    return turns.select(F.col("conv").cast("long").alias("conv_id"), "turn", (F.crc32("conv") % 5 == 0).alias("held_out"), "role", F.length("text").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
