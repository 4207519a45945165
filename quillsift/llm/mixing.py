"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its words takes every document floor(r)
times and, for the rest of r, a sample with equal inclusion probabilities.
The cube method (Deville and Tille, 2004) draws it: probabilities move inside
the null space of the balancing constraints (words and documents) until all
but a few are 0 or 1.  Blocks of a source are balanced independently; what they
leave undecided forms blocks of the next level, until one block per source is
left, whose last few units land on the side that meets the word total best.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import fresh, frozen, meet, word_count

#: Units of a source balanced together in one block.
BLOCK = 1024
#: Units of a block that wait for the next level, beside the two at most that a flight leaves.
WAITING = 64
#: Units that land, outcome by outcome, and exchanges of two units after that.
LANDING = 12
EXCHANGES = 8
#: Sources whose rows are broadcast; of more, only hot ones are.
FEW = 100_000
#: Times that a document may be taken.
MOST = 3
CYCLE = (1, 2, 3)


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (none, name, source_size, units) with ``target``: shares by weight, each at most MOST times its size, the excess reshared by weight.

    Sources are in order of code points, null last, and weigh 1, 2, 3,
    repeating.  Ranks and sums are Spark's; the driver sees sums only, and as
    many rounds of them as resharing takes.
    """
    dealt = sources.repartitionByRange("none", "name").sortWithinPartitions("none", "name").withColumn("at", F.monotonically_increasing_id())
    dealt = frozen(dealt.withColumn("part", F.shiftright("at", 33)))
    before, counts = {}, dealt.groupBy("part").count().collect()  # a row per partition
    for part, n in sorted(counts):
        before[part] = sum(n for p, n in counts if p < part)
    first = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map().cast("map<bigint,bigint>")
    rank = first[F.col("part")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int"))
    ranked = frozen(dealt.withColumn("weight", weight).drop("at", "part"))
    over = lambda share: F.col("source_size") * MOST < F.col("weight") * share
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while total:
        limited, weights, n = ranked.agg(F.coalesce(F.sum(F.when(over(share), F.col("source_size") * MOST)), F.lit(0)), F.sum(F.when(~over(share), F.col("weight"))), F.count_if(over(share))).first()
        if n == capped or not weights:
            break
        share, capped = (total - limited) / weights, n
    target = F.when(over(share), F.col("source_size") * MOST).otherwise(F.col("weight") * share)
    return ranked.withColumn("target", target.cast("double")).drop("weight")


def flight(p: np.ndarray, size: np.ndarray, draws: Iterator[float]) -> np.ndarray:
    """Inclusion probabilities moved until at most two are strictly between 0 and 1; word and unit totals stay.

    Units come in falling order of size, so that small ones are decided last.
    """
    p = p.copy()
    held: list[int] = []
    todo = iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    while True:
        held += itertools.islice(todo, 3 - len(held))
        if len(held) < 3:
            return p
        a, b, c = held
        # Null vector of the constraints [size; 1] on the three units.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u, strict=True) if d)
        down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(held, u, strict=True):
            x = p[k] + step * d
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        held = [k for k in held if 0 < p[k] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last units decided: of all outcomes, the one whose words come nearest to what is expected, then whose count does.

    Where large units leave that off, units that are in change places with
    units that are out, the pair that helps most each time.
    """
    rest = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    miss = outcomes @ size[rest] - float(np.dot(p[rest], size[rest]))
    count = np.abs(outcomes.sum(axis=1) - p[rest].sum())
    best = np.lexsort((count, np.abs(miss).round(6)))[0]
    p, off = p.copy(), float(miss[best])
    p[rest] = outcomes[best]
    for _ in range(EXCHANGES):
        ins, outs = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(size[outs], kind="stable")]
        # A unit of this size coming in for the one going out would end it.
        at = np.searchsorted(size[outs], size[ins] - off)
        pairs = [(off + size[outs[k]] - size[i], int(i), int(outs[k])) for i, a in zip(ins, at, strict=True) for k in (a - 1, a) if 0 <= k < len(outs)]
        left, i, o = min(pairs, key=lambda x: (abs(x[0]), x[1:]))
        if abs(left) >= abs(off):
            break
        p[i], p[o], off = 0.0, 1.0, float(left)
    return p


def fly(p: np.ndarray, size: np.ndarray, draws: Iterator[float], waiting: int) -> np.ndarray:
    """The flight of all units but ``waiting`` of them, spread over the sizes."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    wait = rest[np.unique(np.linspace(0, len(rest) - 1, min(waiting, len(rest))).astype(int))] if len(rest) else rest
    flying = p.copy()
    flying[wait] = 0.0
    moved = flight(flying, size, draws)
    moved[wait] = p[wait]
    return moved


def _decide(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size, p = block["size"].to_numpy(float), block["p"].to_numpy(float)
        rng = np.random.default_rng(int(block["unit"].iloc[0]) & (2**63 - 1))
        draws = iter(rng.random, None)
        moved = fly(p, size, draws, LANDING if last else WAITING)
        if last:
            moved = land(moved, size)
        return block.assign(p=moved)[["unit", "none", "name", "size", "p"]]

    return run


UNIT = "unit bigint, none boolean, name string, size double, p double"


def balanced(units: DataFrame) -> DataFrame:
    """``unit, none, name, extra`` (0 or 1) for ``units`` (unit, none, name, size, p), balanced by source on size and count.

    Blocks of about BLOCK units by key, level by level; every level but the
    last leaves at most WAITING + 2 units of each block undecided.  The units
    of a source are dealt to blocks by their keys, so a large source is many
    tasks.
    """
    done, left = [], frozen(units)
    while True:
        counts = frozen(left.groupBy("none", "name").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
        most, total = counts.agg(F.max("blocks"), F.sum("n")).first()
        if most is None:
            break
        blocked = meet(left, counts, ["none", "name"], "n", total, FEW).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")))
        level = frozen(blocked.groupBy("none", "name", "block").applyInPandas(_decide(most == 1), UNIT))
        done.append(level.filter("p = 0 or p = 1"))
        if most == 1:
            break
        left = level.filter("p > 0 and p < 1")
    return reduce(DataFrame.unionByName, done, units.limit(0).select(*units.columns)).select("unit", "none", "name", F.col("p").cast("int").alias("extra"))


#: What tells units apart; both parts of an id or source that may be null.
UNIT_KEY = ["no_id", "id", "none", "name", "size"]


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """The columns of UNIT_KEY."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = (F.col(id_col).isNull(), text(id_col), F.col(source_col).isNull(), text(source_col), word_count(F.col(text_col)))
    return [c.alias(n) for c, n in zip(found, UNIT_KEY, strict=True)]


def shares(sized: DataFrame) -> DataFrame:
    """One row per unit of ``sized`` (UNIT_KEY): ``rows`` (how often it comes), ``source_size, target, copies``."""
    units = frozen(sized.groupBy(*UNIT_KEY).agg(F.count("*").alias("rows")).withColumn("unit", F.xxhash64(*UNIT_KEY)))
    sums = units.groupBy("none", "name").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    wanted = frozen(targets(sums))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = meet(units, wanted, ["none", "name"], "units", units.count(), FEW)
    # A ratio within 1e-9 of a whole number is that number.
    rated = rated.withColumn("whole", F.floor(ratio + 1e-9).cast("int")).withColumn("part", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    # Units of one hash share their decision; each has a size of its own in the balance.
    waiting = rated.filter("part > 1e-9").groupBy("unit", "none", "name").agg(F.sum(F.col("size") * F.col("rows")).cast("double").alias("size"), F.max("part").alias("p"))
    decided = balanced(waiting)
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")
    same = rated.join(decided, ["unit", "none", "name"], "left")
    return frozen(same.select(*UNIT_KEY, "rows", "source_size", "target", copies.alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that sources meet their target words.

    Returns one row per document: ``doc_id, source, size, source_size, target,
    copies, taken`` (copies times size).  Null and empty texts have no words;
    null is a source of its own, the last; rows that repeat id, source and
    size are one unit and share its decision; an empty table gives no rows;
    other columns are ignored.  Draws depend on the rows alone, so reruns
    agree.  Inclusion probabilities are equal within a source up to the
    landing: its few units go where the total needs them, and a few pairs of
    units may change places, so these aren't drawn with their probability.
    """
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source")]
    sized = frozen(docs.select(*own, *_sized(docs, id_col, text_col, source_col)))
    found = meet(sized, shares(sized), UNIT_KEY, "rows", sized.count(), 0)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: ``docs`` with each row as often as ``mix`` takes it."""
    names = dict(zip(UNIT_KEY, fresh(docs, *UNIT_KEY), strict=True))
    copies, rows, copy = fresh(docs, "copies", "rows", "copy")
    keys = _sized(docs, id_col, text_col, source_col)
    taken = shares(docs.select(*keys)).filter("copies > 0")
    taken = taken.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("copies").alias(copies), F.col("rows").alias(rows))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(keys, names.values(), strict=True)])
    met = meet(keyed, taken, list(names.values()), rows, taken.agg(F.sum(rows)).first()[0] or 0, 0)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[met[c] for c in docs.columns])
