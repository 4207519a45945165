"""Repair of conversations to alternating turns, at least cost.

A min-plus matrix scan: every turn becomes a 4x4 matrix of (cost, audit) over
the states of the pattern ``(s?(ua)+)?`` - what a conversation costs from one
state to another, and the edits' initials.  Inserts are closed over before
each turn.  Products take the cheaper element, then the smaller audit; the two
never tie between edits of different cost, so products are associative, and a
long conversation's matrices are multiplied as a tree over many tasks.  The
way back down the tree gives every stretch of turns the states that it runs
between, and its edits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import as_bytes, frozen, meet

#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in the first and the last.
STATES, ENDS = 4, (0, 3)
#: Turns and bytes of a conversation up to which one task reads it whole.
TURNS, BYTES = 512, 1 << 16
#: Turns and bytes of a leaf of a longer one (a longer turn is a leaf by itself).
LEAF_TURNS, LEAF_BYTES = 512, 1 << 14
#: Long conversations are known by a broadcast of their keys up to so many.
FEW = 200_000
#: (cost, audit)
Element = tuple[int, bytes]
#: From each state: the states that can be reached, with their elements.
Matrix = list[dict[int, Element]]


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; ``left`` may have rows of some states only."""
    out: Matrix = []
    for row in left:
        found: dict[int, Element] = {}
        for middle, (cost, audit) in row.items():
            for end, (more, added) in right[middle].items():
                here = found.get(end)
                if here is None or cost + more < here[0] or (cost + more == here[0] and audit + added < here[1]):
                    found[end] = (cost + more, audit + added)
        out.append(found)
    return out


def identity() -> Matrix:
    return [{k: (0, b"")} for k in range(STATES)]


def cheaper(a: Matrix, b: Matrix) -> Matrix:
    return [{j: min(x for x in (p.get(j), q.get(j)) if x is not None) for j in p.keys() | q.keys()} for p, q in zip(a, b, strict=True)]


def steps(edit: bytes, cost: int, ways: dict[int, int]) -> Matrix:
    return [{ways[k]: (cost, edit)} if k in ways else {} for k in range(STATES)]


#: Where a user's or an assistant's turn leads.
SPEAKS = {0: 2, 1: 2, 2: 3, 3: 2}
KEEPS = {b"s": {0: 1}, b"u": {0: 2, 1: 2, 3: 2}, b"a": {2: 3}}


@lru_cache(maxsize=1)
def inserts() -> Matrix:
    """The closure of inserts: none, or as many as help."""
    one = cheaper(identity(), steps(b"I", 5, SPEAKS))
    return times(times(one, one), one)


@lru_cache(maxsize=64)
def turn_matrix(initial: bytes, must_go: bool, truncated: bool) -> Matrix:
    """Inserts, then what can be done to a turn."""
    ways = steps(b"D", 2, {k: k for k in range(STATES)})
    if not must_go:
        more = 5 if truncated else 0
        ways = cheaper(ways, steps(b"R", 1 + more, SPEAKS))
        ways = cheaper(ways, steps(b"K", more, KEEPS.get(initial, {})))
    return times(inserts(), ways)


def ending(row: dict[int, Element]) -> tuple[int, Element]:
    """The cheapest end state that a conversation may have, and its element."""
    closed = times([row], inserts())[0]
    return min(((k, closed[k]) for k in ENDS if k in closed), key=lambda x: x[1])


@dataclass
class Stretch:
    """Consecutive turns of a conversation: counts, initials of the first and last role, their matrix."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: bytes = b""
    last: bytes = b""
    matrix: Matrix = field(default_factory=identity)

    def then(self, other: Stretch) -> Stretch:
        if not self.rows or not other.rows:
            return other if not self.rows else self
        bad = self.last + other.first not in (b"su", b"ua", b"au")
        sums = (getattr(self, c) + getattr(other, c) for c in ("rows", "blank", "duplicate", "truncated"))
        return Stretch(*sums, self.illegal + other.illegal + bad, self.first, other.last, times(self.matrix, other.matrix))


def stretch_of(turns: list[tuple[bytes, bytes, bool]], states: int = STATES) -> Stretch:
    """The stretch of (role, text, duplicate) turns, from the first ``states`` states."""
    out = Stretch(rows=len(turns), matrix=identity()[:states])
    for role, text, duplicate in turns:
        body = text.rstrip()  # of bytes: ASCII white space
        blank = not body
        duplicate = duplicate and not blank
        truncated = not blank and not duplicate and body[-1:] not in (b".", b"!", b"?")
        out.blank, out.duplicate, out.truncated = out.blank + blank, out.duplicate + duplicate, out.truncated + truncated
        initial = initial_of(role)
        out.illegal += bool(out.first or out.last) and out.last + initial not in (b"su", b"ua", b"au")
        out.first, out.last = out.first or initial, initial
        out.matrix = times(out.matrix, turn_matrix(initial, blank or duplicate, truncated))
    return out


def initial_of(role: bytes) -> bytes:
    """The first character, as bytes; a role without one has the mark of none."""
    return role.decode("utf-8", "replace")[:1].encode() or b"\0"


def repaired(turns: list[tuple[bytes, bytes, bool]], audit: bytes, state: int) -> Iterator[bytes]:
    """``role:text`` of each turn that the edits leave, from a state on."""
    left = iter(turns)
    for edit in audit.decode():
        role, text, _ = (b"", b"", False) if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K" and initial_of(role) == b"s":
            state = 1
        else:
            state = SPEAKS[state]
            if edit != "K":
                role = b"user" if state == 2 else b"assistant"
        yield role + b":" + text


def damage(conversations: DataFrame) -> DataFrame:
    """``key, turn, role, text, mark`` after damage by ``crc32(conv_id:turn) % 20``.

    Nulls are one space; ``key`` tells a null conv_id from any other, ``mark``
    is the text's digest.
    """
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.crc32(F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn, space)).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space))
    times_ = F.when(kind == 3, 2).otherwise(1)
    rows = conversations.select(key_of(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), as_bytes(role).alias("role"), as_bytes(text).alias("text"), kind.alias("kind"), F.explode(F.array_repeat(F.lit(0), times_)).alias("again"))
    return rows.filter("kind != 0").drop("kind", "again").withColumn("mark", F.sha2("text", 256))


def key_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


FACTS = "key string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def short_ones(rows: DataFrame) -> DataFrame:
    """FACTS of conversations that a task reads whole, one after another."""

    def one(key: str, turns: list[tuple[bytes, bytes, bool]]) -> tuple:
        whole = stretch_of(turns, 1)
        _, (cost, audit) = ending(whole.matrix[0])
        digest = hashlib.sha256(b"\n".join(repaired(turns, audit, 0))).hexdigest()
        return key, whole.blank, whole.duplicate, whole.truncated, whole.illegal, cost, audit.decode(), digest

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, turns, seen = None, [], set()
        for batch in batches:
            out = []
            for k, role, text in zip(batch["key"], batch["role"], batch["text"], strict=True):
                if k != key:
                    out += [one(key, turns)] if turns else []
                    key, turns, seen = k, [], set()
                turns.append((role, text, (role, text) in seen))
                seen.add((role, text))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])
        if turns:
            yield pd.DataFrame([one(key, turns)], columns=[c.split()[0] for c in FACTS.split(", ")])

    dealt = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "mark")
    return dealt.select("key", "role", "text").mapInPandas(run, FACTS)


LEAF = "key string, part bigint, leaf bigint, turns binary, stretch binary"
NODE = "key string, part bigint, leaf bigint, stretch binary"
WAY = "key string, part bigint, leaf bigint, start int, stop int"


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` of long conversations, each with a number ``at``, and whether its role and text were seen earlier.

    First occurrences are partial minima; those of much repeated turns are
    broadcast to their rows, so no turn is a hot key.
    """
    numbered = frozen(rows.withColumn("at", F.monotonically_increasing_id()))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "at")
    firsts = frozen(numbered.groupBy("key", "role", "mark").agg(F.min(order)["at"].alias("first"), F.count("*").alias("n")))
    return meet(numbered, firsts, ["key", "role", "mark"], "n", numbered.count(), 10_000).withColumn("duplicate", F.col("at") != F.col("first")).drop("first", "n")


def long_ones(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """FACTS of long conversations: ranges of turns in many tasks, leaves of TURNS turns or BYTES bytes, a tree up and down.

    The digest of a repaired conversation is one pass over its bytes in order,
    leaf by leaf, as SHA-256 needs it; a task streams it and holds one leaf at
    a time.
    """

    def leaves(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, leaf, key, turns, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            out = []
            for k, role, text, duplicate in zip(batch["key"], batch["role"], batch["text"], batch["duplicate"], strict=True):
                if turns and (k != key or len(turns) >= LEAF_TURNS or size + len(text) > LEAF_BYTES):
                    out.append((key, part, leaf, pickle.dumps(turns), pickle.dumps(stretch_of(turns))))
                    leaf, turns, size = leaf + 1, [], 0
                key, size = k, size + len(text)
                turns.append((role, text, bool(duplicate)))
            yield pd.DataFrame(out, columns=["key", "part", "leaf", "turns", "stretch"])
        if turns:
            yield pd.DataFrame([(key, part, leaf, pickle.dumps(turns), pickle.dumps(stretch_of(turns)))], columns=["key", "part", "leaf", "turns", "stretch"])

    place = ["key", F.asc_nulls_first("turn"), "role", "mark", "at"]
    ranged = marked(rows).repartitionByRange(*place).sortWithinPartitions(*place)
    bottom = frozen(ranged.select("key", "role", "text", "duplicate").mapInPandas(leaves, LEAF))
    levels = [bottom.select("key", "part", "leaf", "stretch")]
    parts, most = bottom.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.max("leaf"), F.lit(0))).first()
    folds: list[str] = []

    def product(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["part", "leaf"])
        total = reduce(Stretch.then, map(pickle.loads, order["stretch"]))
        return pd.DataFrame({"key": [order["key"].iloc[0]], "part": [order["part"].iloc[0]], "leaf": [order["leaf"].iloc[0]], "stretch": [pickle.dumps(total)]})

    # Leaves of a partition meet first, then partitions; a node has the smallest place of its leaves.
    span = {"part": 1, "leaf": 1}
    while most or parts:
        by = "leaf" if most else "part"
        span[by] *= fan_in
        most, parts = (most // fan_in, parts) if most else (0, parts // fan_in)
        folds.append((by, span[by]))
        level = levels[-1]
        node = [F.floor(F.col(c) / (span[c] if c == by else 1)) for c in ("part", "leaf")] if by == "leaf" else [F.floor(F.col("part") / span["part"])]
        levels.append(frozen(level.groupBy("key", *node).applyInPandas(product, NODE)))

    def root(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, stretch in zip(batch["key"], batch["stretch"], strict=True):
                whole = pickle.loads(stretch)
                _, (cost, audit) = ending(whole.matrix[0])
                out.append((key, whole.blank, whole.duplicate, whole.truncated, whole.illegal, cost, audit.decode()))
            yield pd.DataFrame(out, columns=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    facts = frozen(levels[-1].mapInPandas(root, FACTS.replace(", repaired_sha256 string", "")))

    def begin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From the first state to that state before the closing inserts from which the end is cheapest."""
        for batch in batches:
            out = []
            for key, part, leaf, stretch in zip(*(batch[c] for c in ("key", "part", "leaf", "stretch")), strict=True):
                row = pickle.loads(stretch).matrix[0]
                stop = min((ending({k: e})[1], k) for k, e in row.items())[1]
                out.append((key, part, leaf, 0, stop))
            yield pd.DataFrame(out, columns=["key", "part", "leaf", "start", "stop"])

    def spread(_: tuple, above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        """The cheapest way through a node's children between the states that the node runs between."""
        start, stop = int(above["start"].iloc[0]), int(above["stop"].iloc[0])
        order = below.sort_values(["part", "leaf"])
        ways: dict[int, tuple[Element, list[int]]] = {start: ((0, b""), [start])}
        for stretch in order["stretch"]:
            matrix, found = pickle.loads(stretch).matrix, {}
            for middle, ((cost, audit), path) in ways.items():
                for end, (more, added) in matrix[middle].items():
                    option = ((cost + more, audit + added), [*path, end])
                    if end not in found or option < found[end]:
                        found[end] = option
            ways = found
        path = ways[stop][1]
        return pd.DataFrame({"key": order["key"], "part": order["part"], "leaf": order["leaf"], "start": path[:-1], "stop": path[1:]})

    way = frozen(levels[-1].mapInPandas(begin, WAY))
    for (by, width), level in zip(reversed(folds), reversed(levels[:-1]), strict=True):
        node = ["key", F.floor(F.col("part") / width)] if by == "part" else ["key", "part", F.floor(F.col("leaf") / width)]
        way = frozen(way.groupBy(*node).cogroup(level.groupBy(*node)).applyInPandas(spread, WAY))

    def mend(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for turns, stretch, start, stop in zip(*(batch[c] for c in ("turns", "stretch", "start", "stop")), strict=True):
                audit = pickle.loads(stretch).matrix[start][stop][1]
                bodies.append(pickle.dumps(list(repaired(pickle.loads(turns), audit, start))))
            yield pd.DataFrame({"key": batch["key"], "part": batch["part"], "leaf": batch["leaf"], "stop": batch["stop"], "body": bodies})

    met = bottom.join(way, ["key", "part", "leaf"])
    mended = met.select("key", "part", "leaf", "turns", "stretch", "start", "stop").mapInPandas(mend, "key string, part bigint, leaf bigint, stop int, body binary")

    def digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stop, some, digest = None, 0, False, hashlib.sha256()

        def add(lines: Iterable[bytes]) -> None:
            nonlocal some
            for line in lines:
                digest.update(b"\n" + line if some else line)
                some = True

        def close() -> tuple[str, str]:
            add(repaired([], ending({stop: (0, b"")})[1][1], stop))
            return key, digest.hexdigest()

        for batch in batches:
            out = []
            for k, last, body in zip(batch["key"], batch["stop"], batch["body"], strict=True):
                if k != key:
                    out += [close()] if key is not None else []
                    key, some, digest = k, False, hashlib.sha256()
                add(pickle.loads(body))
                stop = int(last)
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([close()], columns=["key", "repaired_sha256"])

    streamed = mended.repartition("key").sortWithinPartitions("key", "part", "leaf")
    return facts.join(streamed.mapInPandas(digests, "key string, repaired_sha256 string"), "key")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage conversations by their ids' checksums, and repair each at least cost.

    Returns a row per original ``conv_id`` (a null one too): ``gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Nulls in
    any column count as one space; a null turn comes first and takes no part
    in ``gaps``.  Turns of one number are ordered by role, then by their text's digest, so
    repeated rows are adjacent, and the later ones duplicates.  Roles without
    any character are no legal turn.  A conversation of which damage leaves
    nothing has zeros, an empty audit and the hash of the empty string.  An
    empty table gives no rows; other columns are ignored, whatever their names.

    Conversations of up to TURNS turns and BYTES bytes are read whole by one
    task; longer ones go by ranges of turns (``long_ones``), whatever share of
    the table they have.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    rows = damage(base)
    numbers = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("text") + F.length("role")).alias("bytes"), F.max("turn").cast("decimal(20,0)").alias("high"), F.min("turn").cast("decimal(20,0)").alias("low"), F.countDistinct("turn").alias("turns"))
    numbers = frozen(numbers.withColumn("gaps", F.expr("coalesce(try_cast(high - low + 1 - turns AS bigint), 0)")).select("key", "rows", "bytes", "gaps"))
    long_keys = numbers.filter((F.col("rows") > TURNS) | (F.col("bytes") > BYTES)).select("key")
    count = long_keys.count()
    facts = short_ones(rows)
    if count:
        keys = F.broadcast(long_keys) if count <= FEW else long_keys
        facts = short_ones(rows.join(keys, "key", "left_anti")).unionByName(long_ones(rows.join(keys, "key", "left_semi")))
    every = base.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", key_of(F.col("conv_id")).alias("key"))
    out = every.join(numbers.select("key", "gaps"), "key", "left").join(facts, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
