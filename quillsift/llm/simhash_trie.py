"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints are leaves of a binary trie over their bits.  Pairs of trie nodes
are traversed together, adding up the bits in which their paths differ, and a
pair is dropped as soon as that exceeds the error budget.  The upper levels of
the trie deal out the work: a task holds one subtree and some of the subtrees whose
paths are within the budget of its own, NEIGHBOURS of them at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.components import connected
from quillsift.llm.shared import as_bytes, frozen, meet

SEED = 42
#: Distinct fingerprints that a subtree should hold, and the multiple of it from which a subtree is split.
SUBTREE = 1 << 18
LARGE = 2
#: Neighbouring subtrees that a task gets beside its own, on average, at most.
NEIGHBOURS = 32
#: Fingerprints that are broadcast to meet their rows (24 bytes each); of more, only hot ones are.
FEW = 200_000
#: Node pairs that a traversal expands at once, and pairs of leaves below two nodes up to which it compares them all.
FRONTIER = 1 << 16
OUTRIGHT = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (repeats included), of all words if there are fewer; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    ends -= 1
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # Sums of 255 rows fit a byte, which keeps the additions in vector registers.
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
    ones = sums.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, size: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with a column of fingerprints (their 64 bits as a signed long)."""

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(shingle_hashes(t, size)) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return docs.withColumn(name, prints(as_bytes(F.col(text_col))))


class Trie:
    """The binary trie over sorted distinct fingerprints; its nodes are the ranges of their leaves, so no level is ever stored."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    def middle(self, begin: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Where the second child's leaves begin, for each node (a range of leaves) at a depth."""
        bit = np.uint64(1 << (63 - depth))
        first = self.prints[begin]
        out = np.where(first & bit, begin, end)
        both = np.flatnonzero((first & bit) != (self.prints[end - 1] & bit))
        # Leaves below a node are sorted, so the second child begins at the first leaf that has the bit.
        out[both] = np.searchsorted(self.prints, (first[both] >> np.uint64(63 - depth) | np.uint64(1)) << np.uint64(63 - depth))
        return out


def join_tries(a: Trie, b: Trie, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (leaf of a, leaf of b) differing in at most ``budget`` bits; with ``same``, each unordered pair of distinct leaves once.

    Only pairs of nodes that are still to be expanded are held: FRONTIER of
    them a level at most, times a small number, whatever the tries' sizes.
    """
    if not len(a.prints) or not len(b.prints):
        return
    zero = np.zeros(1, np.int32)
    todo = [(0, zero, zero + np.int32(len(a.prints)), zero, zero + np.int32(len(b.prints)), zero.astype(np.int8))]
    while todo:
        depth, *pairs = todo.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            todo += [(depth, *(x[:half] for x in pairs)), (depth, *(x[half:] for x in pairs))]
            continue
        u0, u1, v0, v1, differ = pairs
        # Leaves of small nodes are compared outright.
        size = (u1 - u0).astype(np.int64) * (v1 - v0)
        small = size <= OUTRIGHT
        if small.any():
            n, width = size[small], (v1 - v0)[small]
            at = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            row = place // width[at]
            i, j = u0[small][at] + row, v0[small][at] + place - row * width[at]
            near = np.bitwise_count(a.prints[i] ^ b.prints[j]) <= budget
            if same:
                near &= (i < j) | (u0 != v0)[small][at]
            if near.any():
                yield i[near], j[near]
            u0, u1, v0, v1, differ = (x[~small] for x in pairs)
        if not len(u0):
            continue
        um, vm = a.middle(u0, u1, depth), b.middle(v0, v1, depth)
        below = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            c0, c1 = (um, u1) if x else (u0, um)
            d0, d1 = (vm, v1) if y else (v0, vm)
            cost = differ + np.int8(x != y)
            keep = (c0 < c1) & (d0 < d1) & (cost <= budget)
            if same and (x, y) == (1, 0):
                keep &= u0 != v0  # under one node, (0, 1) has these pairs already
            below.append([z[keep] for z in (c0, c1, d0, d1, cost)])
        todo.append((depth + 1, *map(np.concatenate, zip(*below, strict=True))))


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it to.

    With ``near``, only pairs that it accepts count; it isn't asked about
    pairs that are connected already.
    """
    label = np.arange(n)
    for i, j in pairs:
        if near is not None:
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            close = near(i, j)
            i, j = i[close], j[close]
        while len(i):
            i, j = label[i], label[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
    return label


def near_paths(bits: int, budget: int) -> list[int]:
    """The differences of two paths of so many bits that are within the budget."""
    return sorted(sum(1 << k for k in at) for n in range(min(bits, budget) + 1) for at in combinations(range(bits), n))


def dealt(prints: DataFrame, budget: int) -> DataFrame:
    """``depth, task, print, own``: each fingerprint in its own subtree of the trie and in those whose paths are within the budget of its path.

    Subtrees begin at the depth where they hold SUBTREE fingerprints on
    average; wherever one holds more, it alone is split bit by bit.
    """
    count = prints.count()
    bits = max(6, math.ceil(math.log2(max(1, count / SUBTREE))))
    path = F.shiftrightunsigned("print", 64 - bits)
    flips = F.array(*[F.struct(F.lit(x).cast("long").alias("flip"), F.lit(x.bit_count()).alias("cost")) for x in near_paths(bits, budget)])
    held = (
        prints.select("print", path.alias("path"), F.explode(flips).alias("f"))
        .select("print", F.col("path").bitwiseXOR(F.col("f.flip")).alias("task"), "f.cost", "path")
        # A pair of subtrees meets once: in the one whose path is the smaller under a mix that spreads the load.
        .filter((F.col("cost") == 0) | (F.xxhash64("path") > F.xxhash64("task")))
        .select("task", "print", "cost")
    )
    done = []
    while bits < 64:
        sizes = prints.groupBy(F.shiftrightunsigned("print", 64 - bits).alias("task")).agg(F.count("*").alias("n"))
        # One subtree in SUBTREE fingerprints can be over it, so these are few.
        heavy = frozen(sizes.filter(F.col("n") > SUBTREE * LARGE).select("task"))
        if heavy.isEmpty():
            break
        done.append(held.join(F.broadcast(heavy), "task", "left_anti").withColumn("depth", F.lit(bits)))
        bits += 1
        bit = F.shiftrightunsigned("print", 64 - bits).bitwiseAND(F.lit(1).cast("long"))
        both = held.join(F.broadcast(heavy), "task", "left_semi").withColumn("bit", bit).withColumn("to", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        # Of two halves of a subtree, the second's fingerprints visit the first.
        met = both.filter((F.col("cost") > 0) | (F.col("bit") == F.col("to")) | (F.col("bit") == 1))
        held = met.select((F.col("task") * 2 + F.col("to")).alias("task"), "print", (F.col("cost") + (F.col("bit") != F.col("to")).cast("int")).alias("cost")).filter(F.col("cost") <= budget)
    done.append(held.withColumn("depth", F.lit(bits)))
    return reduce(DataFrame.unionByName, done).select("depth", "task", "print", (F.col("cost") == 0).alias("own"))


def links(prints: DataFrame, budget: int) -> DataFrame:
    """Links (high, low) that connect all fingerprints within ``budget`` bits; ``prints`` has distinct longs in ``print``.

    A task unites what it finds and returns one link per fingerprint at most,
    so large groups give no quadratic output.  Subtrees with more neighbours
    than a task may hold meet them in several tasks.
    """

    def join(group: pd.DataFrame) -> pd.DataFrame:
        all_prints = group["print"].to_numpy(np.int64).view(np.uint64)
        own = group["own"].to_numpy(bool)
        a, b = Trie(np.sort(all_prints[own])), Trie(np.sort(all_prints[~own]))
        n = len(a.prints)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if group["unit"].iloc[0] == 0:
                yield from join_tries(a, a, budget, True)
            for i, j in join_tries(a, b, budget, False):
                yield i, j + n

        label = forest(n + len(b.prints), pairs())
        leaves = np.concatenate((a.prints, b.prints)).view(np.int64)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": leaves[other], "v": leaves[label[other]]})

    units = F.get(F.array(*[F.lit(math.ceil(sum(math.comb(k, n) for n in range(budget + 1)) / 2 / NEIGHBOURS)) for k in range(65)]), F.col("depth"))
    # A neighbour's fingerprints go to one unit together; the own ones are in all.
    unit = F.pmod(F.xxhash64(F.expr("shiftrightunsigned(print, 64 - depth)")), units).cast("int")
    met = dealt(prints, budget).withColumn("unit", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), units - 1)).otherwise(F.array(unit))))
    return met.groupBy("depth", "task", "unit").applyInPandas(join, "u bigint, v bigint")


def group_near(docs: DataFrame, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked by steps of at most ``budget`` bits.

    Returns one row per document: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (the smallest doc_id reachable).  Null and empty texts
    have fingerprint zero and are linked like any other; rows with a null id
    take part, and a component of none but null ids has a null id; ids of any
    ordered type are kept as they are; repeated rows are returned as often as
    they come; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = frozen(with_fingerprint(source, words, "text", "print").select("doc_id", "print"))
    leaves = frozen(rows.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    labels = connected(frozen(links(leaves.select("print"), budget)))
    rooted = frozen(leaves.join(labels, leaves["print"] == labels["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "low", "n"))
    total = rows.count()
    # A root's fingerprints, and a fingerprint's rows, can be very many.
    smallest = frozen(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("prints")))
    named = frozen(meet(rooted, smallest, ["root"], "prints", total, FEW).select("print", "component_id", "n"))
    found = meet(rows, named, ["print"], "n", total, FEW)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
