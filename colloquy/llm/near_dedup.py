"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are two halves of 32. In each half the anchors are the words of a covering code: a perfect (23, 12)
code of covering radius 3 on 23 bits, times all words on the other 9. Two fingerprints within 3 bits agree in one half but for
one bit at most. So every fingerprint is put at its own anchor (the nearest, within the covering radius) and at the anchors nearest to
the words one flipped bit away; of any pair within 3 bits, one fingerprint's copies reach the other's own anchor. Only
distinct fingerprints are replicated, about 14 copies for each half, and compared per anchor. The members of an anchor with many
are parted by blocks of their other half, of which any pair within 3 bits has one in common. An anchor's links are
reduced to a spanning set where they are found, so a group of n near copies yields links in proportion to n, and the
connected components are found by distributed star rounds.

similar_dedup() links texts by the likeness of their shingle sets, with wider SimHashes: PRINT bits that are compared, and tables of
further bits. A fingerprint is put in each table at its own bits and at those with its least certain bit, the one with the closest
vote, flipped. Fingerprints that meet in a table and differ in COARSE bits or fewer are in one candidate group, and within
candidate groups the links are found by an exact check of the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import bit_words, components, gathered, in_bitmap, saved, short_batches, with_group, without, written

#: Links are at this many differing bits or fewer; the anchors are laid out for it.
RADIUS = 3
#: Generator polynomial of the perfect (23, 12) code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Bits of a SimHash that are compared for sets of shingles, and the most that differ in a candidate: sets with Jaccard 0.8 differ in 19.4
#: bits on average, with a standard deviation of 4.1, unrelated ones in 64, with 5.7.
PRINT, COARSE = 128, 36
#: Bits of a table's key at least, and so many tables of that many: one in 1,000 pairs with Jaccard 0.8 meets in none (tests count them).
KEY_BITS, TABLES = 16, 44
#: Tables of the first round; in the second, groups that are already one are not linked again.
FIRST = 4
#: Entries of the tables that meet in one task, about.
ENTRIES = 1 << 20
#: Of the members that a group has reached, so many are compared with the rest before the next are.
BEFORE = 8
#: The members of a candidate group with more shingles than this are compared in blocks of about so many.
SET_BLOCK = 1 << 21
#: Sets of so many shingles or fewer also meet those that have one more; their votes are close.
SHORT = 9
#: Bits of the bitmap that picks the rows whose sets are compared: 2 MB, whatever the input.
PICK_BITS = 1 << 24
#: Anchors with more members than this are compared block by block, smaller ones all at once.
SMALL = 64
#: The members of anchors with more than this are parted by blocks of bits.
BIG = 4096


@lru_cache(maxsize=1)
def nearest() -> np.ndarray:
    """For each of the 2^23 words, the number of its nearest code word (16 MB)."""
    words = np.zeros(1, np.int64)
    for i in range(12):
        words = np.concatenate([words, words ^ (GENERATOR << i)])
    errors = [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i in range(23) for j in range(i)), *((1 << i) | (1 << j) | (1 << k) for i in range(23) for j in range(i) for k in range(j))]
    table = np.zeros(1 << 23, np.uint16)
    for e in errors:
        table[words ^ e] = np.arange(len(words), dtype=np.uint16)
    return table


def anchors(half: np.ndarray) -> np.ndarray:
    """The anchors, 21-bit numbers, of 32-bit words: own anchor in column 0, then those a flipped bit away (with repeats)."""
    flips = np.array([0, *(1 << i for i in range(32))], np.int64)
    near = half[:, None] ^ flips[None, :]
    return (nearest()[near >> 9].astype(np.int64) << 9) | (near & 511)


def replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, whether it is the fingerprint's own anchor) of uint64 fingerprints, each anchor once for a half."""
    out = []
    for number, half in enumerate(((prints >> np.uint64(32)).astype(np.int64), (prints & np.uint64(0xFFFFFFFF)).astype(np.int64))):
        at = anchors(half)
        own = at[:, :1]
        rest = np.sort(np.where(at[:, 1:] == own, -1, at[:, 1:]), axis=1)
        new = (rest >= 0) & np.concatenate([np.ones((len(rest), 1), bool), rest[:, 1:] != rest[:, :-1]], axis=1)
        row, _ = np.nonzero(new)
        out += [(own[:, 0] | number << 21, prints, np.ones(len(prints), bool)), (rest[new] | number << 21, prints[row], np.zeros(len(row), bool))]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning(prints: np.ndarray, home: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs (home member, any member) within RADIUS connect: each member to its group's first.

    Labels pass between homes and members until nothing changes; memory is `block` rows of distances.
    """
    label, homes = np.arange(len(prints)), np.flatnonzero(home)
    changed = True
    while changed:
        before = label.copy()
        for i in range(0, len(homes), block):
            at = homes[i : i + block]
            near = np.bitwise_count(prints[at][:, None] ^ prints[None, :]) <= RADIUS
            low = np.where(near, label[None, :], len(label)).min(axis=1)
            label[at] = np.minimum(label[at], low)
            label = np.minimum(label, np.where(near, label[at][:, None], len(label)).min(axis=0))
        label = label[label]
        changed = bool((label != before).any())
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _links(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, given sorted by anchor."""
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    size = np.diff(edges)
    out = [(prints[:0], prints[:0])]
    for g in np.flatnonzero(size > SMALL):
        at = slice(edges[g], edges[g + 1])
        out.append(spanning(prints[at], home[at]))
    first, span = np.repeat(edges[:-1], size), np.repeat(size, size)
    for members in np.array_split(np.flatnonzero(home & (span > 1) & (span <= SMALL)), max(1, len(prints) // 20_000)):
        left = np.repeat(members, span[members])
        right = np.arange(len(left)) - np.repeat(np.cumsum(span[members]) - span[members], span[members]) + first[left]
        near = (np.bitwise_count(prints[left] ^ prints[right]) <= RADIUS) & (left != right)
        out.append((prints[left[near]], prints[right[near]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(distinct: DataFrame, print_col: str = "fingerprint", big: int = BIG) -> DataFrame:
    """Links (a, b) between distinct bigint fingerprints: all components, though not all pairs, at RADIUS bits or fewer.

    An anchor with more than `big` members is no single group: of two members within RADIUS bits, one of RADIUS + 1 blocks of the
    half that the anchor is not of is equal, so its members are dealt by block and the block's bits.
    """
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 5000):
                at, prints, own = replicas(batch[print_col].to_numpy()[i : i + 5000].view(np.uint64))
                yield pd.DataFrame({"anchor": at, "fp": prints.view(np.int64), "home": own})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"anchor": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64), "home": np.zeros(0, bool)})
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            a, b = _links(rows["anchor"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy())
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in gathered(batches):
            rows = pd.concat([kept, batch], ignore_index=True)
            cut = int(np.searchsorted(rows["anchor"].to_numpy(), rows["anchor"].iloc[-1])) if len(rows) else 0
            kept = rows.iloc[cut:]
            yield done(rows.iloc[:cut])
        if len(kept):
            yield done(kept)

    placed = distinct.select(print_col).mapInPandas(place, "anchor long, fp long, home boolean")
    crowded = saved(placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > big))
    if not crowded.isEmpty():
        marked = with_group(placed, ["anchor"], ["fp"], [], crowded, "left").select("anchor", "fp", "home", "n")
        # Anchors of the high half have numbers below 2^21, and their members' low halves are cut in blocks; a key has the block's number
        # and bits above the anchor's number.
        wide = 32 // (RADIUS + 1)
        other = F.when(F.col("anchor") < 1 << 21, F.col("fp")).otherwise(F.shiftright("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        blocks = F.array(*(F.col("anchor") + F.lit((i + 1) << 40) + F.shiftleft(F.shiftright(other, wide * i).bitwiseAND(F.lit((1 << wide) - 1)), 24) for i in range(RADIUS + 1)))
        placed = marked.withColumn("anchor", F.explode(F.when(F.col("n").isNull(), F.array("anchor")).otherwise(blocks))).drop("n")
    together = placed.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInPandas(compare, "a long, b long").distinct()


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Add `fingerprint`, a bigint with the 64 bits: a bit is 1 if it is set in over half of the text's shingle hashes.

    Shingles are `shingle` words of the text with A-Z lower-cased, joined by a space, repeats included; a text with fewer words
    is one shingle; one without words, or null, has fingerprint 0. The hash is XXH64 of the UTF-8 bytes, seed 42.
    """
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        def votes(groups: list[list[int]]) -> np.ndarray:
            sizes = np.array([len(g) for g in groups])
            out = np.zeros(len(groups), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                hashes = np.concatenate([np.array(groups[i], np.uint64) for i in full])
                ends = np.cumsum(sizes[full])
                bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
                counts = np.add.reduceat(bits, ends - sizes[full], axis=0, dtype=np.int32)
                on = (2 * counts > sizes[full][:, None]).astype(np.uint8)
                out[full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
            return out

        for texts in batches:
            out, groups, held = [], [], 0
            for text in texts:
                words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
                runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words] if words else []
                groups.append([xxh64_intdigest(b" ".join(run), 42) for run in runs])
                held += len(groups[-1])
                if held > 100_000:
                    out.append(votes(groups))
                    groups, held = [], 0
            yield pd.Series(np.concatenate([*out, votes(groups)]).view(np.int64))

    return without(short_batches(docs), ["fingerprint"]).withColumn("fingerprint", fingerprint(text_col))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """All rows of docs with fingerprint (bigint), component_id and kept.

    Rows are linked if their fingerprints differ in RADIUS bits or fewer; component_id is the smallest id that links reach
    (null ids are passed over; null if all are). One row of each component is kept: one with component_id, or any if ids are
    null. Null and empty texts have fingerprint 0 and are linked like any other. Input columns named like a result are
    replaced; an empty table gives an empty result. docs may already carry fingerprint (and then needs no text column); else the
    rows are written once with their fingerprints, which several steps read.
    """
    rows = docs if text_col not in docs.columns and "fingerprint" in docs.columns else written(fingerprints(docs, text_col, shingle))
    return _joined(rows, lambda distinct: components(links(distinct)), id_col)


def _joined(rows: DataFrame, members: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Rows with fingerprint, and component_id and kept by the components (node, root) that a function finds among distinct fingerprints."""
    rows = without(rows, ["component_id", "kept"])
    skinny = saved(rows.select("fingerprint", F.col(id_col).alias("_cq_id")).groupBy("fingerprint").agg(F.min("_cq_id").alias("_cq_first")))
    member = members(skinny).withColumnRenamed("node", "fingerprint")
    rooted = skinny.join(member, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = F.coalesce(F.min_by("fingerprint", "_cq_first"), F.min("fingerprint")).alias("_cq_keep")
    named = with_group(rooted, ["root"], ["fingerprint"], [F.min("_cq_first").alias("component_id"), first]).select("fingerprint", "component_id", "_cq_keep")
    marked = with_group(rows, ["fingerprint"], [id_col], [], named)
    # Rows with equal ids share a slice, so those that tie on component_id meet in this window; its rows are dealt as the join's.
    order = F.row_number().over(W.partitionBy("fingerprint", "_cq_slice").orderBy(F.col(id_col).asc_nulls_last()))
    one = (F.col("_cq_order") == 1) & (F.col("fingerprint") == F.col("_cq_keep")) & F.col(id_col).eqNullSafe(F.col("component_id"))
    return marked.withColumn("_cq_order", order).withColumn("kept", one).select(*rows.columns, "component_id", "kept")


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """The distinct hashes, ascending uint64, of all runs of `shingle` of a text's hashed words; of fewer words, one of all."""
    size = min(shingle, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ words[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.unique(h)


#: Byte i of entry b is bit i of b, so sums of up to 255 entries count the bits that are set.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def table_sizes(count: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many sets: from 4 million on keys get longer, and tables more, so that unrelated sets that meet by
    chance stay in proportion to the sets."""
    bits = min(32, max(KEY_BITS, int(count).bit_length() - 6))
    return bits, int(np.ceil(TABLES * 1.165 ** (bits - KEY_BITS)))


def simhash(shingles: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of a set of hashed shingles, as PRINT bits in uint64, and its uint32 keys: for each table the own one, then for each
    the one with the least certain bit flipped."""
    words = -(-(PRINT + bits * tables) // 64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(words * 64, np.int64)
    for i in range(0, len(shingles), 255):
        with np.errstate(over="ignore"):
            h = shingles[i : i + 255, None] + salt
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        votes += _SPREAD[h.view(np.uint8)].sum(axis=0).view(np.uint8)
    lead = 2 * votes - len(shingles)
    placed = lead[PRINT : PRINT + bits * tables].reshape(tables, bits)
    own = (placed > 0) @ (1 << np.arange(bits, dtype=np.int64))
    keys = np.concatenate([own, own ^ (1 << np.abs(placed).argmin(axis=1))])
    return np.packbits(lead[:PRINT] > 0, bitorder="little").view(np.uint64), keys.astype(np.uint32)


def grouped(count: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The connected components of members 0, 1, ...: for each the first member of its own.

    near(some, others) tells which of the others are linked to any of some. Members that have been reached are compared with the rest
    only, so a group of near copies takes about as many comparisons as it has members, and no pair's link is missed.
    """
    label = np.arange(count)
    rest = label.copy()
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            if len(front) <= len(rest):
                hit, front = near(front[:BEFORE], rest), front[BEFORE:]
            else:
                hit, front = np.array([near(rest[i : i + 1], front).any() for i in range(len(rest))]), front[:0]
            label[rest[hit]] = root
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return label


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, at most one a node, that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def met(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the groups of entries (rows: key, two words of print, group) with equal keys and prints within COARSE bits."""
    key, high, low, group = entries[:, np.argsort(entries[0])]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    out = [(group[:0], group[:0])]
    for g in np.flatnonzero(size > SMALL):
        x, y, names = (c[edges[g] : edges[g + 1]] for c in (high, low, group))
        def near(some: np.ndarray, others: np.ndarray, x=x, y=y) -> np.ndarray:
            return (np.bitwise_count(x[some, None] ^ x[others]) + np.bitwise_count(y[some, None] ^ y[others]) <= COARSE).any(axis=0)

        out.append((names, names[grouped(len(x), near)]))
    later = np.where(np.repeat(size, size) <= SMALL, np.repeat(edges[1:], size) - np.arange(len(key)) - 1, 0)
    for members in np.array_split(np.flatnonzero(later), max(1, len(key) // 20_000)):
        left = np.repeat(members, later[members])
        right = np.arange(len(left)) - np.repeat(np.cumsum(later[members]) - later[members], later[members]) + left + 1
        close = np.bitwise_count(high[left] ^ high[right]) + np.bitwise_count(low[left] ^ low[right]) <= COARSE
        out.append((group[left[close]], group[right[close]]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return joined(a[a != b], b[a != b])


def alike_sets(sets: list[np.ndarray], alike: float) -> np.ndarray:
    """The components of distinct sets (each an array of distinct hashes, none empty) by links with Jaccard `alike` or more."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), bool)

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size[others])
        begin = ends - size[others]
        theirs = flat[np.arange(ends[-1]) + np.repeat(start[others] - begin, size[others])]
        hit = np.zeros(len(others), bool)
        for i in some:
            mine = flat[start[i] : start[i] + size[i]]
            marked[mine] = True
            both = np.add.reduceat(marked[theirs], begin, dtype=np.int64)
            marked[mine] = False
            hit |= both / (size[i] + size[others] - both) >= alike
        return hit

    return grouped(len(sets), near)


def one_less(shingles: np.ndarray) -> list[int]:
    """The fingerprints of a short set without each of its shingles in turn; none of a longer one."""
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(np.delete(shingles, i).tobytes()) for i in range(len(shingles))] if 2 <= len(shingles) <= SHORT + 1 else []


def candidate_groups(distinct: DataFrame, bits: int, tables: int, count: int) -> DataFrame:
    """(fp, n, root): sets, given as (fp, high, low, keys, n, less), by their candidate groups.

    Entries go to the task of their key in packed blocks. The first round's groups are linked as wholes in the second, so links
    are in proportion to the sets, whatever the size of a group and the number of tables.
    """
    shards = max(8, count * 2 * tables // ENTRIES)

    def place(first: int, last: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = np.arange(first, last, dtype=np.uint64) << np.uint64(32)
            for batch in gathered(batches, 2000):
                keys = np.frombuffer(b"".join(batch["keys"]), np.uint32).reshape(len(batch), 2, tables)[:, :, first:last] | table
                each = keys.shape[1] * keys.shape[2]
                entries = np.stack([keys.reshape(-1), *(np.repeat(batch[c].to_numpy().view(np.uint64), each) for c in ("high", "low", "root"))])
                with np.errstate(over="ignore"):
                    shard = ((entries[0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"shard": full.astype(np.int32), "block": [entries[:, order[cuts[k] : cuts[k + 1]]].tobytes() for k in full]})

        return blocks

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            a, b = met(np.concatenate(held, axis=1))
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        held, at = [], None
        for batch in batches:
            for shard, block in zip(batch["shard"], batch["block"], strict=True):
                if held and shard != at:
                    yield done()
                    held = []
                at = shard
                held.append(np.frombuffer(block, np.uint64).reshape(4, -1))
        if held:
            yield done()

    def rooted(member: DataFrame) -> DataFrame:
        return distinct.join(member.withColumnRenamed("node", "high"), "high", "left").withColumn("root", F.coalesce("root", "high"))

    def round_of(named: DataFrame, first: int, last: int) -> DataFrame:
        placed = named.select("high", "low", "root", "keys").mapInPandas(place(first, last), "shard int, block binary")
        return saved(placed.repartition(shards, "shard").sortWithinPartitions("shard").mapInPandas(meet, "a long, b long").distinct())

    one = round_of(distinct.withColumn("root", F.col("high")), 0, FIRST)
    # One step of the way to the first round's components; the rest of it is made with all links.
    two = round_of(rooted(one.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))), FIRST, tables)
    short = distinct.where(F.col("n") <= SHORT).select("fp", F.col("high").alias("b"))
    more = distinct.select(F.col("high").alias("a"), F.explode("less").alias("fp")).join(short, "fp").select("a", "b")
    return rooted(components(one.union(two).union(more))).select("fp", "n", "root")


def similar(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], alike: float, bits: int, tables: int, count: int) -> DataFrame:
    """(node, root) for the fingerprints of rows with fingerprint and _cq_signed: the components, by links with Jaccard `alike` or more, of the
    sets in each candidate group. Not every fingerprint that is its own root has a row.

    A function adds the whole sets to the rows that are in candidate groups, as _cq_set. A group is compared in one task, a very large one in
    blocks (in_blocks()).
    """
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            names = np.array(fps, np.int64)
            label = alike_sets([np.frombuffer(x, np.uint32) for x in held], alike)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"node": names[moved], "root": names[label[moved]]})

        fps, held, at = [], [], None
        for batch in batches:
            for task, fp, x in zip(batch["task"], batch["fingerprint"], batch["_cq_set"], strict=True):
                if held and task != at:
                    yield done()
                    fps, held = [], []
                at = task
                fps.append(fp)
                held.append(x)
        if held:
            yield done()

    signed = rows.select(F.col("fingerprint").alias("fp"), "_cq_signed.high", "_cq_signed.low", "_cq_signed.keys", "_cq_signed.n", "_cq_signed.less").where("n > 0")
    groups = candidate_groups(written(signed.dropDuplicates(["fp"])), bits, tables, count)
    met_any = with_group(groups, ["root"], ["fp"], [F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes")]).where("members > 1")
    crowd = saved(met_any.select(F.col("fp").alias("fingerprint"), "root", F.ceil(F.col("hashes") / SET_BLOCK).cast("int").alias("blocks")))
    hit = crowd.select(F.pmod("fingerprint", F.lit(PICK_BITS)).alias("_cq_bit"))
    picked = in_bitmap(rows, saved(bit_words(hit, "_cq_bit")), [F.pmod("fingerprint", F.lit(PICK_BITS))], "_cq_in").where("_cq_in")
    whole = sets(picked).select("fingerprint", "_cq_set").dropDuplicates(["fingerprint"]).join(crowd, "fingerprint")
    def compared(dealt_out: DataFrame) -> DataFrame:
        return dealt_out.repartition("task").sortWithinPartitions("task").mapInPandas(check, "node long, root long")

    if crowd.where("blocks > 1").isEmpty():
        return saved(compared(whole.select("fingerprint", "_cq_set", F.col("root").alias("task"))))
    return in_blocks(whole, compared)


def in_blocks(whole: DataFrame, compared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components (node, root) of sets (fingerprint, _cq_set, root, blocks), where large groups are dealt into blocks.

    Each block is compared in one task, with one member of every other block. Then all pairs are tried but those of a group's largest component
    so far: its other members go, in parts, to every block. So a group of near copies is sent about once, and only members that
    the largest component lacks are sent often.
    """
    within = written(whole.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")))
    large, upto = within.where("blocks > 1"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A row for each block of a large group: as many as hold the input, SET_BLOCK shingles each.
    chosen = large.groupBy("root", "block").agg(F.min("fingerprint").alias("fingerprint")).select("fingerprint")
    chosen = large.join(F.broadcast(chosen), "fingerprint").withColumn("other", upto("blocks")).where("other <> block")
    own = within.select("fingerprint", "_cq_set", F.xxhash64("root", "block").alias("task"))
    first = saved(compared(own.union(chosen.select("fingerprint", "_cq_set", F.xxhash64("root", "other")))))
    label = components(first.toDF("a", "b")).toDF("fingerprint", "label")
    named = large.join(label, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    sizes = named.groupBy("root", "label").agg(F.sum(F.octet_length("_cq_set") / 4).alias("hashes"))
    most = sizes.groupBy("root").agg(F.max_by("label", "hashes").alias("most"), (F.sum("hashes") - F.max("hashes")).alias("lacks")).where("lacks > 0")
    both = named.join(F.broadcast(saved(most.select("root", "most", F.ceil(F.col("lacks") / SET_BLOCK).cast("int").alias("parts")))), "root")
    part = F.pmod(F.xxhash64("root", "fingerprint"), F.col("parts")).cast("int")
    lacking = both.where("label <> most").withColumn("part", part).withColumn("at", upto("blocks"))
    every = both.withColumn("part", upto("parts")).withColumn("at", F.col("block"))
    second = compared(lacking.union(every).select("fingerprint", "_cq_set", F.xxhash64("root", "part", "at").alias("task")))
    return components(first.union(second).toDF("a", "b"))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8) -> DataFrame:
    """As near_dedup(), but rows are linked if their sets of `shingle`-word shingles have Jaccard `alike` or more.

    fingerprint is a hash of the set, so rows with equal sets have equal ones; null and empty texts have the empty set.
    """
    from colloquy.llm.substring_dedup import word_hashes

    count = docs.count()
    bits, tables = table_sizes(count)

    @F.pandas_udf("fingerprint long, high long, low long, keys binary, n long, less array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        found = [shingle_set(words, shingle) for words in word_hashes(texts)]
        prints = np.array([xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
        hashes = [simhash(x, bits, tables) for x in found]
        high, low = np.array([x for x, _ in hashes], np.uint64).reshape(-1, 2).T.copy().view(np.int64)
        return pd.DataFrame({"fingerprint": prints, "high": high, "low": low, "keys": [k.tobytes() for _, k in hashes], "n": [len(x) for x in found], "less": [np.array(one_less(x), np.uint64).view(np.int64) for x in found]})

    @F.pandas_udf("binary")
    def shingled(texts: pd.Series) -> pd.Series:
        # Four bytes a shingle: two in a pair of 300 each fall together in 1 case of 50,000.
        return pd.Series([np.unique(shingle_set(words, shingle).astype(np.uint32)).tobytes() for words in word_hashes(texts)], dtype=object)

    rows = without(short_batches(docs), ["fingerprint", "component_id", "kept"]).withColumn("_cq_signed", signed(text_col))
    rows = written(rows.withColumn("fingerprint", F.col("_cq_signed.fingerprint")))
    sets = lambda some: some.withColumn("_cq_set", shingled(text_col))
    find = lambda _: similar(rows.select("fingerprint", "_cq_signed", text_col), sets, alike, bits, tables, count)
    return _joined(rows.drop("_cq_signed"), find, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    skinny = saved(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"))
    return near_dedup(skinny).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
