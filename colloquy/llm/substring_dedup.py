"""Substring dedup by collinear chaining.

Seeds are five-word shingles, all of them, so any run of five shared words has one. A seed's occurrences are matched with the first of
them and with the one before, never each with each: matches grow with the seeds. Matches next to each other on one
diagonal form runs; for a text and another that it matches, the runs in order on both sides are chained with gap costs by a
Fenwick tree, chains are aligned word by word, and what is alike enough is a repeated passage; a text's passages that touch count
together.

Seeds meet in ranges of their hashes. A task sends a range's seeds of a chunk of texts as one compressed block (sorted hashes as
differences, and where they are), some five bytes a seed, and no seed is written or shuffled a second time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, bit_words, gathered, in_bitmap, saved, short_batches, written
from colloquy.llm.exact_dedup import bloom, digests, exact_dedup, probe

#: Words of a shingle.
SHINGLE = 5
#: Seeds of a chunk of texts, and about how many seeds share a range: both are held in memory at once, some 50 bytes each.
CHUNK, RANGE = 1_000_000, 2_000_000
#: Of a seed with more occurrences in one chunk, the others are matched in the chunk and only the first goes on, so a seed that a
#: third of all texts have sends one occurrence a chunk.
COMMON = 16
#: What a matched seed adds to a chain, what each word between seeds takes (both sides counted): gaps of 40 words end a chain.
GAIN, GAP = 10.0, 0.125
#: Seeds that a chain has at least: a run of six words alike, or two of five.
LEAST_SEEDS = 2
#: Words that alignment may add at each end of a chain.
MARGIN = 20
#: Bits of the bitmap that picks the texts to be aligned: 2 MB, whatever the input.
PICK_BITS = 1 << 24

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

#: Bytes of texts whose words are hashed at once.
BLOCK = 1 << 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX[1]
        h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    base = int(_MIX[3])
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b % 2**64, np.uint64))]) for b in (base, pow(base, -1, 2**64)))


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text a 64-bit hash of each of its words, A-Z lower-cased.

    A word's bytes, each mapped to a 64-bit number, are the digits of a polynomial. Prefix sums over some BLOCK bytes of texts give those
    of all their words at once: the difference of two sums, divided by the power at which the word begins.
    """
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= BLOCK:
            yield from _hashed(held)
            held, size = [], 0
    yield from _hashed(held)


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    out, low = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK, "right")))
            part = raw[starts[low] : ends[high - 1]]
            power, inverse = _powers(1 << max(16, len(part).bit_length()))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * power[: len(part)], out=sums[1:])
            at = starts[low:high] - starts[low]
            out[low:high] = (sums[ends[low:high] - starts[low]] - sums[at]) * inverse[at]
            low = high
    return np.split(_mixed(out), np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[:-1]])))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[0])


def seeds(words: np.ndarray) -> np.ndarray:
    """The hashes (uint64) of a text's seeds, all its shingles, in order of position."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = sum((words[i : i + n] ^ (words[i : i + n] >> np.uint64(29 + i))) * _MIX[i] for i in range(SHINGLE))
        h = (h ^ (h >> np.uint64(32))) * _MIX[0]
        return h ^ (h >> np.uint64(29))


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers as bytes: each byte place of a column is compressed by itself, leading zero bytes are left out."""
    from zstandard import ZstdCompressor

    pack, out = ZstdCompressor(level=1).compress, []
    for c in columns:
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T
        parts = [pack(planes[i].tobytes()) for i in range((int(c.max()).bit_length() + 7) // 8 if len(c) else 0)]
        out.append(struct.pack(f"<QB{len(parts)}I", len(c), len(parts), *map(len, parts)) + b"".join(parts))
    return b"".join(out)


def spread(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns that squeeze() took, of these types."""
    from zstandard import ZstdDecompressor

    unpack, at, out = ZstdDecompressor().decompress, 0, []
    for kind in kinds:
        n, width = struct.unpack_from("<QB", data, at)
        sizes = struct.unpack_from(f"<{width}I", data, at + 9)
        at += 9 + 4 * width
        planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
        for i, size in enumerate(sizes):
            planes[i] = np.frombuffer(unpack(data[at : at + size]), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def chains(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Collinear chains of runs of n matches from positions p (ascending) and q on: lists of their numbers, each run after the end of
    the one before on both sides.

    A chain's score is GAIN a match less GAP a word between runs, on both sides. Predecessors that end at a smaller q are found as a
    prefix maximum in a Fenwick tree over q; each run is in one chain, best chains first.
    """
    ends = np.unique(q + n)
    first, last = np.searchsorted(ends, q, "right").tolist(), (np.searchsorted(ends, q + n) + 1).tolist()
    tree, who = [-np.inf] * (len(ends) + 1), [-1] * (len(ends) + 1)
    score, before = [0.0] * len(p), [-1] * len(p)
    waiting = np.argsort(p + n, kind="stable").tolist()
    begin, done, gone = p.tolist(), (p + n).tolist(), (q + n).tolist()
    gain, low, w = (GAIN * n).tolist(), (GAP * (p + q)).tolist(), 0
    for i in range(len(begin)):
        while w < len(waiting) and done[waiting[w]] <= begin[i]:
            j = waiting[w]
            v, r = score[j] + GAP * (done[j] + gone[j]), last[j]
            while r < len(tree):
                if v > tree[r]:
                    tree[r], who[r] = v, j
                r += r & -r
            w += 1
        best, found, r = -np.inf, -1, first[i]
        while r:
            if tree[r] > best:
                best, found = tree[r], who[r]
            r -= r & -r
        more = best - low[i]
        score[i], before[i] = (gain[i] + more, found) if found >= 0 and more > 0 else (gain[i], -1)
    used, out = [False] * len(begin), []
    for i in sorted(range(len(begin)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    mask: dict[int, int] = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & mask.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def within(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], n: list[int]) -> int:
    """Words alike from the first to the last seed of a chain of runs at p in a and q in b. Between runs an equal number of words is
    compared in place, other gaps by longest common subsequence."""
    alike, x, y = 0, p[0], q[0]
    for s, t, k in zip(p, q, n, strict=True):
        over = max(0, x - s, y - t)  # seeds of neighbouring runs may share words
        s, t, size = s + over, t + over, k + SHINGLE - 1 - over
        alike += int((a[x:s] == b[y:t]).sum()) if s - x == t - y else common_words(a[x:s].tolist(), b[y:t].tolist())
        alike += size
        x, y = s + size, t + size
    return alike


def extend(a: list[bytes], b: list[bytes], room: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words added, words alike of them) at one end of many chains: of up to `room` words (of four bytes) next to it, up to the best
    point of +1 a word alike, -2 a word that isn't. With `left` the words before the end are given, the nearest last."""
    wide = 4 * MARGIN

    def grid(parts: list[bytes], fill: bytes) -> np.ndarray:
        sized = (x[-wide:].rjust(wide, fill) if left else x[:wide].ljust(wide, fill) for x in parts)
        words = np.frombuffer(b"".join(sized), np.uint32).reshape(-1, MARGIN)
        return words[:, ::-1] if left else words

    same = (grid(a, b"\0") == grid(b, b"\1")) & (np.arange(MARGIN) < room[:, None])
    total = np.cumsum(np.where(same, 1, -2), axis=1)
    best = total.argmax(axis=1) if len(total) else np.zeros(0, int)
    more = np.where(total[np.arange(len(total)), best] > 0, best + 1, 0)
    return more, (same & (np.arange(MARGIN) < more[:, None])).sum(axis=1)


def _matches(key: np.ndarray, p: np.ndarray, other: np.ndarray, q: np.ndarray, star: np.ndarray) -> pa.RecordBatch:
    """Matches, a row for all those of two texts: (key, other, star, ps, qs)."""
    order = np.lexsort((p, star, other, key))
    key, other, star, p, q = key[order], other[order], star[order], p[order], q[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1]) | (star[1:] != star[:-1])
    at = np.flatnonzero(new)
    offsets = pa.array(np.append(at, len(key)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (p, q)]
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(other[at]), pa.array(star[at]), *lists], MATCH_NAMES)


MATCH = "key long, other long, star boolean, ps array<int>, qs array<int>"
MATCH_NAMES = ["key", "other", "star", "ps", "qs"]


def _neighbours(place: np.ndarray, start: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, other occurrence, star) of matches of each occurrence with its seed's first (star) and with the one before,
    of those in `among`; `place` and `start` give an occurrence's place in its seed's run and where that begins."""
    one, two = np.flatnonzero(among & (place > 0)), np.flatnonzero(among & (place > 1))
    return np.concatenate([one, two]), np.concatenate([start[one], two - 1]), np.concatenate([np.ones(len(one), bool), np.zeros(len(two), bool)])


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in its run, where the run begins, size of the run) of each row, given which rows begin one."""
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(new)))
    start = np.repeat(at, size)
    return np.arange(len(new)) - start, start, np.repeat(size, size)


def match_seeds(texts: DataFrame, total: int, text_col: str = "text") -> DataFrame:
    """Matches (key, other, star, ps, qs) of texts given as (key, text) with distinct bigint keys, with `total` seeds or so: for a
    seed that occurs twice or more, in one text or several, each position in ps, and in qs its first in order of (key, position)
    (star) or the one before. Occurrences beyond COMMON in a chunk have the first and the one before of that chunk.

    Hashes are cut to so many bits that one seed in 64 meets another by chance.
    """
    bits = min(63, max(16, int(total).bit_length() + 6))
    split = min(20, max(5, (int(total) // RANGE).bit_length()))
    down, low = np.uint64(64 - bits), np.uint64(bits - split)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.array([], pa.int32())

        def chunk(found: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            found.sort(key=lambda x: x[0])
            keys, sizes = np.array([k for k, _ in found], np.int64), np.array([len(h) for _, h in found])
            slot = np.concatenate([h for _, h in found]) >> down
            order = np.argsort(slot, kind="stable")
            doc = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)[order]
            pos = (np.arange(len(slot)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)[order]
            slot = slot[order]
            at, start, size = _runs(np.append(True, slot[1:] != slot[:-1]))
            common = size > COMMON
            i, j, star = _neighbours(at, start, common)
            if len(i):
                met = _matches(keys[doc[i]], pos[i], keys[doc[j]], pos[j], star)
                blank = pa.nulls(len(met), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((met.column(0).to_numpy() % (1 << split)).astype(np.int32)), blank, *met.columns], PLACED_NAMES)
            sent = ~common | (at == 0)
            slot, doc, pos = slot[sent], doc[sent], pos[sent]
            part = (slot >> low).astype(np.int64)
            edges = np.searchsorted(part, np.arange((1 << split) + 1)).tolist()
            blocks, number = [], []
            for r in np.unique(part).tolist():
                a, b = edges[r], edges[r + 1]
                inside, local = np.unique(doc[a:b], return_inverse=True)
                blocks.append(squeeze(np.diff(slot[a:b], prepend=np.uint64(r) << low), local.astype(np.uint32), pos[a:b], keys[inside].view(np.uint64)))
                number.append(r)
            nothing = [pa.nulls(len(blocks), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blocks, pa.binary()), *nothing], PLACED_NAMES)

        found, held = [], 0
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), word_hashes(x.as_py() for x in batch.column(1)), strict=True):
                h = seeds(words)
                if len(h):
                    found.append((key, h))
                    held += len(h)
                    if held >= CHUNK:
                        yield from chunk(found)
                        found, held = [], 0
        if found:
            yield from chunk(found)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(blocks: list[bytes], r: int) -> Iterator[pa.RecordBatch]:
            slots, keys, places = [], [], []
            for block in blocks:
                gaps, doc, pos, key = spread(block, np.uint64, np.uint32, np.uint32, np.int64)
                slots.append(np.cumsum(gaps, dtype=np.uint64))
                keys.append(key[doc])
                places.append(pos)
            slot = np.concatenate(slots)
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            _, _, size = _runs(np.append(True, slot[1:] != slot[:-1]))
            again = size > 1
            if not again.any():
                return
            slot, order = slot[again], order[again]
            key, pos = np.concatenate(keys)[order], np.concatenate(places)[order]
            order = np.lexsort((pos, key, slot))
            slot, key, pos = slot[order], key[order], pos[order]
            at, start, _ = _runs(np.append(True, slot[1:] != slot[:-1]))
            i, j, star = _neighbours(at, start, np.ones(len(at), bool))
            for k in range(0, len(i), 500_000):
                x, y = i[k : k + 500_000], j[k : k + 500_000]
                yield _matches(key[x], pos[x], key[y], pos[y], star[k : k + 500_000])

        held, now = [], -1
        for batch in batches:
            # Matches that a chunk found by itself pass through.
            met = batch.column(1).is_null()
            if pa.compute.any(met).as_py():
                yield pa.RecordBatch.from_arrays(batch.filter(met).columns[2:], MATCH_NAMES)
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block.is_valid:
                    if r != now and held:
                        yield from meet(held, now)
                        held = []
                    now = r
                    held.append(block.as_py())
        if held:
            yield from meet(held, now)

    placed = texts.select("key", text_col).mapInArrow(place, f"range int, data binary, {MATCH}")
    return placed.repartition("range").sortWithinPartitions("range").mapInArrow(match, MATCH)


PLACED_NAMES = ["range", "data", *MATCH_NAMES]


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, in frames that hold all rows of their keys."""
    kept = None
    for batch in gathered(batches):
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if len(rows):
            cut = int((rows["key"] != rows["key"].iloc[-1]).sum())
            kept = rows.iloc[cut:]
            if cut:
                yield rows.iloc[:cut]
    if kept is not None:
        yield kept


def _together(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the stretch that an interval belongs to, whether it reaches beyond those before it) of intervals sorted by key
    and start; a stretch is what touching or overlapping intervals of one key cover."""
    shift = np.append(0, np.cumsum(key[1:] != key[:-1])) << 32
    reach = np.maximum.accumulate(shift + end)
    first = np.append(True, (shift + start)[1:] > reach[:-1])
    at = np.flatnonzero(first)
    length = np.append(reach[at[1:] - 1], reach[-1]) - (shift + start)[at]
    return length[np.cumsum(first) - 1], np.append(True, (shift + end)[1:] > reach[:-1])


def needed(start: list[int], end: list[int]) -> list[int]:
    """Of intervals sorted by start the fewest that cover what all cover: each touches those before it and reaches farthest."""
    out, reach, i = [], -1, 0
    while i < len(start):
        best = i
        while i < len(start) and (start[i] <= reach or i == best):
            best = i if end[i] > end[best] else best
            i += 1
        if end[best] > reach or start[best] > reach:
            out.append(best)
            reach = end[best]
    return out


CHAIN = "key long, other long, star boolean, ps array<int>, qs array<int>, ns array<int>"


def chain_matches(matches: DataFrame, least: int = 50) -> DataFrame:
    """Chains (key, other, star, ps, qs, ns) of the matches between each two texts: where their runs begin on both sides and how many
    matches each has, LEAST_SEEDS together; star if any match has it. Chains that can't reach `least` words, even if extended and put
    together with all others of their text that they then touch, are left out. A text has no more matches than twice its seeds, so
    one text's fit in a task."""
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            size = rows["ps"].map(len).to_numpy()
            key, other, star = (np.repeat(rows[c].to_numpy(), size) for c in ("key", "other", "star"))
            p, q = np.concatenate(rows["ps"].tolist()).astype(np.int64), np.concatenate(rows["qs"].tolist()).astype(np.int64)
            order = np.lexsort((p, q - p, other, key))
            key, other, star, p, q = key[order], other[order], star[order], p[order], q[order]
            pair = np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1]))
            at = np.flatnonzero(np.append(True, pair[1:] | ((q - p)[1:] != (q - p)[:-1]) | (p[1:] > p[:-1] + 1)))
            n = p[np.append(at[1:], len(p)) - 1] - p[at] + 1
            star = np.logical_or.reduceat(star, at)
            pair = np.cumsum(pair)[at]
            key, other, p, q = key[at], other[at], p[at], q[at]
            edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            size = np.diff(np.append(edges, len(pair)))
            found: list[list[int]] = [[i] for i in edges[(size == 1) & (n[edges] >= LEAST_SEEDS)].tolist()]
            for a, k in zip(edges[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                if n[a : a + k].sum() >= LEAST_SEEDS:
                    here = np.argsort(p[a : a + k], kind="stable") + a
                    found += [here[c].tolist() for c in chains(p[here], q[here], n[here]) if len(c) > 1 or n[here[c[0]]] >= LEAST_SEEDS]
            if not found:
                continue
            head, tail = np.array([c[0] for c in found]), np.array([c[-1] for c in found])
            start, end = np.maximum(p[head] - MARGIN, 0), p[tail] + n[tail] + SHINGLE - 1 + MARGIN
            order = np.lexsort((start, key[head]))
            length, _ = _together(key[head][order], start[order], end[order])
            found = [found[i] for i in order[length >= least].tolist()]
            if not found:
                continue
            head = [c[0] for c in found]
            yield pd.DataFrame({"key": key[head], "other": other[head], "star": [bool(star[c].any()) for c in found], "ps": [p[c] for c in found], "qs": [q[c] for c in found], "ns": [n[c] for c in found]})

    return matches.repartition("key").sortWithinPartitions("key", "other").mapInPandas(link, CHAIN)


def passages(texts: DataFrame, total: int, text_col: str = "text", least: int = 50, alike: float = 0.8) -> DataFrame:
    """Repeated passages (key, start, end, other, other_start, other_end, alike) of texts given as (key, text), with `total` seeds or so;
    ends exclusive, in words. Passages have `alike` of their words in common with the other text; together with those that they
    touch or overlap they have `least` words or more. Of passages with one other text the fewest are listed that cover the same words
    (a text of few words in turn has a passage at every word). Of those with a text that has none of the text's seeds first,
    only those are listed that add words to others."""
    found = written(chain_matches(match_seeds(texts, total, text_col), least))
    hit = found.select(F.explode(F.array("key", "other")).alias("_cq_key")).distinct().select(F.pmod(F.xxhash64("_cq_key"), F.lit(PICK_BITS)).alias("_cq_bit"))
    picked = in_bitmap(texts.select("key", text_col), saved(bit_words(hit, "_cq_bit")), [F.pmod(F.xxhash64("key"), F.lit(PICK_BITS))], "_cq_in").where("_cq_in")

    @F.pandas_udf("binary")
    def hashed(column: pd.Series) -> pd.Series:
        return pd.Series([words.astype(np.uint32).tobytes() for words in word_hashes(column)], dtype=object)

    # Four bytes a word. Texts meet their chains twice, as one side and as the other, and both joins read one exchange.
    words = picked.select("key", hashed(text_col).alias("_cq_words")).repartition("key")
    low = lambda c: F.greatest(F.element_at(c, 1) - MARGIN, F.lit(0))
    end = lambda c: F.element_at(c, -1) + F.element_at("ns", -1) + SHINGLE - 1
    cut = lambda a, b: F.substring(F.col("_cq_words"), 4 * a + 1, 4 * (b - a))
    # Of a chain of one run, whose words are alike, only the words around it; of others the words between as well.
    part = lambda c: F.concat(cut(low(c), F.element_at(c, 1)), F.when(F.size("ns") > 1, cut(F.element_at(c, 1), end(c))).otherwise(F.lit(b"")), cut(end(c), end(c) + MARGIN))
    one = found.join(words, "key").select("key", "other", "star", "ps", "qs", "ns", part("ps").alias("a"))
    two = one.join(words.withColumnRenamed("key", "other"), "other").select("key", "other", "star", "ps", "qs", "ns", "a", part("qs").alias("b"))
    spans_schema = "key long, start int, end int, other long, other_start int, other_end int, alike double, star boolean"

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sides, lone = [], batch["ns"].map(len).to_numpy() == 1
            n = np.array([x[-1] for x in batch["ns"]])
            for words, places in (("a", "ps"), ("b", "qs")):
                begin, last = np.array([x[0] for x in batch[places]]), np.array([x[-1] for x in batch[places]])
                before, stop = np.minimum(begin, MARGIN), last + n + SHINGLE - 1
                middle = np.where(lone, 0, stop - begin)
                parts = list(map(bytes, batch[words]))
                left = [x[: 4 * k] for x, k in zip(parts, before.tolist(), strict=True)]
                right = [x[4 * k :] for x, k in zip(parts, (before + middle).tolist(), strict=True)]
                inner = [x[4 * k : 4 * (k + m)] for x, k, m in zip(parts, before.tolist(), middle.tolist(), strict=True)]
                sides.append((begin, stop, left, right, inner, before))
            (p, s, a_left, a_right, a, a_room), (q, t, b_left, b_right, b, b_room) = sides
            more_left, same_left = extend(a_left, b_left, np.minimum(a_room, b_room), True)
            room = np.minimum([len(x) // 4 for x in a_right], [len(x) // 4 for x in b_right])
            more_right, same_right = extend(a_right, b_right, room, False)
            same = same_left + same_right + np.where(lone, s - p, 0)
            for i in np.flatnonzero(~lone).tolist():
                same[i] += within(np.frombuffer(a[i], np.uint32), np.frombuffer(b[i], np.uint32), (batch["ps"].iat[i] - p[i]).tolist(), (batch["qs"].iat[i] - q[i]).tolist(), batch["ns"].iat[i].tolist())
            start, stop, other_start, other_stop = p - more_left, s + more_right, q - more_left, t + more_right
            share = same / np.maximum(stop - start, other_stop - other_start)
            spans = pd.DataFrame({"key": batch["key"], "start": start, "end": stop, "other": batch["other"], "other_start": other_start, "other_end": other_stop, "alike": share, "star": batch["star"]})
            yield spans[share >= alike]

    placed = two.mapInPandas(aligned, spans_schema).repartition("key").sortWithinPartitions("key", "start", F.desc("end"), F.desc("star"), "other", "other_start")

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches):
            key, start, end, other = (rows[c].to_numpy().astype(np.int64) for c in ("key", "start", "end", "other"))
            length, new = _together(key, start, end)
            order = np.lexsort((start, other, key))
            edges = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])))
            listed = np.ones(len(rows), bool)
            for group in np.split(order, edges[1:]):
                if len(group) > 2:
                    listed[group] = False
                    listed[group[needed(start[group].tolist(), end[group].tolist())]] = True
            yield rows[(length >= least) & listed & (rows["star"].to_numpy() | new)]

    return placed.mapInPandas(together, spans_schema).drop("star")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, alike: float = 0.8) -> DataFrame:
    """Repeated passages, a row each: doc_id, start, end, other_id, other_start, other_end (word numbers, ends exclusive), alike.

    A passage repeated within a document has other_id = doc_id and the earlier place as its other side; the two may overlap.
    Texts are first made distinct (A-Z folded): a copy is one passage, all of it, repeated from the document that stays for its
    text, and each distinct text is searched once. Of the places that hold a passage one is the other side only, so
    cutting all listed passages leaves one copy. Null and empty texts have no passages; texts under `least` words neither, copies
    or not. Rows with equal ids are different documents. Extra columns are passed over; an empty table gives an empty result.
    """
    rows = digests(short_batches(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text")
    # Ids, digests and sizes are kept. Whole texts are read where they are needed; only possible copies shuffle, after those of one task
    # are made one, and one of each is kept.
    narrow = saved(rows.select("_id", "text_sha256", F.regexp_count("_text", F.lit(WORD)).alias("end")))
    built = bloom(narrow)
    marked = saved(exact_dedup(narrow, "_id", built=built))
    ids = marked.where("kept").select(F.xxhash64("text_sha256").alias("key"), "_id")
    total = marked.where("kept").agg(F.sum(F.greatest(F.col("end") - SHINGLE + 1, F.lit(0)))).first()[0] or 0
    probed = probe(rows, built, "_id").select(F.xxhash64("text_sha256").alias("key"), F.col("_text").alias("text"), "_cq_again")
    repeated = written(probed.where("_cq_again").drop("_cq_again").dropDuplicates(["key"]))
    texts = probed.where("not _cq_again").drop("_cq_again").union(repeated)
    found = passages(texts, total, "text", least, alike)
    named = found.join(ids.withColumnRenamed("_id", "doc_id"), "key").join(ids.select(F.col("key").alias("other"), F.col("_id").alias("other_id")), "other")
    columns = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "alike"]
    copies = marked.where("not kept").where(F.col("end") >= least)
    copies = copies.select(F.col("_id").alias("doc_id"), F.lit(0).alias("start"), "end", F.col("keep_id").alias("other_id"), F.lit(0).alias("other_start"), F.col("end").alias("other_end"), F.lit(1.0).alias("alike"))
    return named.select(*columns).unionByName(copies)


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with the words of their passages cut from the text; other texts are unchanged. Ids must be unique."""
    spans = found.groupBy(F.col("doc_id").alias("_cq_id")).agg(F.collect_list(F.struct("start", "end")).alias("_cq_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        import re

        out = []
        for text, spans in zip(texts, lists, strict=True):
            if text is not None and spans is not None:
                gone = np.zeros(1 + max(s["end"] for s in spans), bool)
                for s in spans:
                    gone[s["start"] : s["end"]] = True
                number = iter(range(len(text)))
                text = re.sub(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", lambda m: "" if (i := next(number)) < len(gone) and gone[i] else m[0], text)  # noqa: B023
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, docs[id_col] == F.col("_cq_id"), "left")
    return joined.withColumn(text_col, cut(text_col, "_cq_spans")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
