"""Packing of documents into windows of several lengths.

Documents are routed to tiers by their number of tokens: each tier's window is
twice as long as the next one's.  From the longest tier down, a document opens
a window, and its gap is filled by documents of shorter tiers, best fit first;
only where none fits is one cut.  So windows are full, without padding.  What
a task can't fill is handed up a tree of tasks, whose root cuts the last rest.
Windows of a tier are dealt to step groups of equal tokens and like cost.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.packing import byte_alphabet
from quillsift.llm.shared import as_bytes, frozen

#: Tokens that are packed together in a task: bounds what it holds.
BATCH_TOKENS = 2_000_000
#: Distinct stretches between spaces that a worker remembers at most; half of them are those not asked for lately.
REMEMBERED = 800_000
#: Text in which normalizing changes nothing but case; no apostrophe (contractions) and no < (added tokens) is in it.
PLAIN = re.compile("[ \n!-&(-;=-~À-ÖØ-öø-ÿ]*").fullmatch
#: The pre-tokens of plain text in lower case, and whether something is one of them.
PRE_TOKENS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+").findall
PLAIN_TOKEN = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@[-`{-~]+").fullmatch
#: Windows whose step group is found by a node of the tree are broadcast up to so many (two longs each), else joined by a shuffle.
FEW_STEPS = 1_000_000
ROW = "kind int, doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step bigint, cost bigint, ids binary, part bigint"
NAMES = [c.split()[0] for c in ROW.split(", ")]
#: Kinds of rows: a piece in its window, a piece without one, a window without a step group, a window's late step group.
PLACED, LOOSE, WINDOW, STEP = range(4)


class Stretches(dict):
    """Token ids, as little-endian bytes, of pre-tokens and of stretches between spaces, by the ``tokenizers`` library.

    The vocabulary drops white space and its pre-tokens never hold any, so a
    text's ids are those of its stretches, one after another; case doesn't
    count.  Plain stretches are cut into pre-tokens here, of which there are
    far fewer, and the library's model alone is asked about these.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = {byte: char for char, byte in byte_alphabet().items()}
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        known = self.before.get(part)
        if known is not None:
            self[part] = known
            return known
        if PLAIN_TOKEN(part):
            written = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            found = array("I", [token.id for token in self.model.tokenize(written)]).tobytes()
        else:
            found = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= 64:
            self[part] = found
        return found

    def __call__(self, text: str) -> bytes:
        tokens = []
        for part in [text] if PLAIN(text) else text.replace("\n", " ").split(" "):
            if PLAIN(part):
                tokens += PRE_TOKENS(part.lower())
            else:
                tokens.append(part)
        return b"".join(map(self.__getitem__, tokens))


_loaded: dict[str, Stretches] = {}


def stretch_ids(path: str) -> Callable[[str], bytes]:
    """The worker's tokenizer for a vocabulary that drops white space, loaded once."""
    if path not in _loaded:
        _loaded[path] = Stretches(path)
    return _loaded[path]


#: doc_id, doc_tokens, start, ids (four bytes each)
Piece = tuple[str | None, int, int, memoryview]


class Pool:
    """Pieces that wait for a window, by length."""

    def __init__(self, largest: int, smallest: int):
        self.largest, self.smallest = largest, smallest
        self.lengths: list[int] = []
        self.stacks: dict[int, list[Piece]] = {}
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        self.tokens += size
        if size in self.stacks:
            self.stacks[size].append(piece)
        else:
            self.stacks[size] = [piece]
            insort(self.lengths, size)

    def take(self, size: int) -> Piece:
        stack = self.stacks[size]
        piece = stack.pop()
        self.tokens -= size
        if not stack:
            del self.stacks[size]
            del self.lengths[bisect_left(self.lengths, size)]
        return piece

    def cut(self, size: int, at: int) -> Piece:
        """The first ``at`` ids of a piece of ``size``; its rest waits on."""
        doc_id, total, start, ids = self.take(size)
        self.put((doc_id, total, start + at, ids[4 * at :]))
        return doc_id, total, start, ids[: 4 * at]

    def fitting(self, gap: int) -> int:
        """The length to put into a gap: one that fills it, else the longer of two that fill it, else the longest that fits; 0 if none does."""
        if gap in self.stacks:
            return gap
        end = bisect_right(self.lengths, gap)
        for k in range(end - 1, -1, -1):
            size = self.lengths[k]
            if 2 * size < gap:
                break
            if gap - size in self.stacks and (2 * size != gap or len(self.stacks[size]) > 1):
                return size
        return self.lengths[end - 1] if end else 0

    def window(self, tier: int) -> list[Piece]:
        """A full window, of a pool with that many tokens at least: its longest document first."""
        longest = self.lengths[-1]
        if longest > tier:
            return [self.cut(longest, tier)]
        pieces, gap = [self.take(longest)], tier - longest
        while gap:
            size = self.fitting(gap)
            pieces.append(self.take(size) if size else self.cut(self.lengths[-1], gap))
            gap -= size or gap
        return pieces

    def opens(self, tier: int) -> bool:
        """Whether a document is routed to the tier (or a longer one)."""
        return bool(self.lengths) and (2 * self.lengths[-1] > tier or tier <= self.smallest)

    def windows(self, last: bool) -> Iterator[tuple[int, list[Piece]]]:
        """All windows that the pool fills, longest tier first; with ``last`` down to windows of one token, so that none is left."""
        tier = self.largest
        while tier >= (1 if last else self.smallest):
            while self.opens(tier) and self.tokens >= tier:
                yield tier, self.window(tier)
            if self.opens(tier) and not last:
                return  # too few for a window, but they may fill a gap elsewhere
            tier //= 2

    def left(self) -> Iterator[Piece]:
        for stack in self.stacks.values():
            yield from stack


def step_groups(windows: list[tuple[int, int]], size: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Windows (cost, number) of one tier dealt to groups of ``size``, and those left over.

    By falling cost they are dealt back and forth, so groups are alike in it.
    """
    count = len(windows) // size
    order = sorted(windows, reverse=True)
    dealt, left = order[: count * size], order[count * size :]
    groups: list[list[int]] = [[] for _ in range(count)]
    for k, (_, number) in enumerate(dealt):
        turn, at = divmod(k, count)
        groups[at if turn % 2 == 0 else count - 1 - at].append(number)
    return groups, left


class Packer:
    """Packs what a task gets; keeps windows that aren't in a step group yet."""

    def __init__(self, numbers: Iterator[int], largest: int, smallest: int, step_tokens: int):
        self.pool, self.numbers, self.step_tokens = Pool(largest, smallest), numbers, step_tokens
        self.waiting: dict[int, list[tuple[int, int]]] = {}

    def full(self, last: bool) -> list[tuple]:
        """Rows of the windows that can be filled, and of step groups."""
        rows, fresh = [], {}
        for tier, pieces in self.pool.windows(last):
            number, offset = next(self.numbers), 0
            fresh[number] = []
            for doc_id, total, start, ids in pieces:
                size = len(ids) // 4
                fresh[number].append((doc_id, start, size, zlib.crc32(ids), total, number, offset, tier))
                offset += size
            self.waiting.setdefault(tier, []).append((sum(p[2] ** 2 for p in fresh[number]), number))
        steps = {}
        for tier, windows in self.waiting.items():
            groups, left = step_groups(windows, max(1, self.step_tokens // tier))
            if last and left:
                groups.append([number for _, number in left])
                left = []
            self.waiting[tier] = left
            steps |= {number: min(group) for group in groups for number in group}
        for number, placed in fresh.items():
            rows += [(PLACED, *p, steps.get(number), None, None, None) for p in placed]
        rows += [(STEP, None, None, None, None, None, number, None, None, step, None, None, None) for number, step in steps.items() if number not in fresh]
        return rows

    def rest(self, part: int) -> list[tuple]:
        """Rows of what goes up the tree."""
        # No nulls among numbers, which pandas would make doubles.
        rows = [(LOOSE, doc_id, start, len(ids) // 4, 0, total, 0, 0, 0, 0, 0, bytes(ids), part) for doc_id, total, start, ids in self.pool.left()]
        return rows + [(WINDOW, None, 0, 0, 0, 0, number, 0, tier, 0, cost, b"", part) for tier, windows in self.waiting.items() for cost, number in windows]


def pack_multi(docs: DataFrame, vocabulary: str, largest: int = 4096, smallest: int = 512, step_tokens: int = 65_536, closing: int = 2, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, tokenizer: Callable[[str], Callable[[str], bytes]] = stretch_ids) -> DataFrame:
    """Pack the documents' token sequences (each closed by id ``closing``) into windows of ``smallest`` to ``largest`` tokens, powers of two.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, and ``tier`` (the window's length) and ``step``
    (the step group; groups of a tier have ``step_tokens`` tokens and like sums
    of squared piece lengths, the last of each tier may have fewer).  Every
    window is full: only the last rest of the whole table, shorter than the
    smallest window that it can fill, is cut into shorter powers of two, at
    most twelve of them.  Documents over ``largest`` are cut; others only to
    fill a gap that no document fits.  A null text counts as empty and gives
    the closing id alone; null and repeated ids, and ids of any type, are
    packed like others; an empty table gives no rows; further columns are
    ignored, whatever their names.

    A task holds BATCH_TOKENS ids (and one document).  A node of the tree gets
    from each of ``fan_in`` children less than ``largest`` ids and less than
    one step group of windows of each tier.
    """
    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    close = array("I", [closing]).tobytes()

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES)
        return out.astype({c: "Int64" for c in NAMES if c not in ("doc_id", "ids")})

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        packer = Packer(itertools.count(part << 32), largest, smallest, step_tokens)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text.decode("utf-8", "replace")) + close
                packer.pool.put((doc_id, len(ids) // 4, 0, memoryview(ids)))
                if packer.pool.tokens >= BATCH_TOKENS:
                    yield table(packer.full(False))
        yield table(packer.full(False) + packer.rest(part))

    def merge(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            part = int(group["part"].iloc[0]) // fan_in
            packer = Packer(itertools.count((level << 58) + (part << 32)), largest, smallest, step_tokens)
            rows = group.sort_values(["part", "kind", "doc_id", "start", "sequence_id"], kind="stable")
            for kind, doc_id, start, total, number, tier, cost, ids in zip(*(rows[c] for c in ("kind", "doc_id", "start", "doc_tokens", "sequence_id", "tier", "cost", "ids")), strict=True):
                if kind == LOOSE:
                    packer.pool.put((None if pd.isna(doc_id) else doc_id, int(total), int(start), memoryview(ids)))
                else:
                    packer.waiting.setdefault(int(tier), []).append((int(cost), int(number)))
            return table(packer.full(last) + ([] if last else packer.rest(part)))

        return run

    level = frozen(source.mapInPandas(local, ROW))
    top = level.agg(F.max("part")).first()[0]
    done = [level.filter(F.col("part").isNull())]
    depth = 0
    while top is not None:
        top, depth = top // fan_in, depth + 1
        up = level.filter(F.col("part").isNotNull())
        level = frozen(up.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(merge(depth, not top), ROW))
        done.append(level.filter(F.col("part").isNull()))
        top = top or None
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    late = rows.filter(F.col("kind") == STEP).select("sequence_id", F.col("step").alias("late"))
    late = F.broadcast(late) if late.count() <= FEW_STEPS else late
    placed = rows.filter(F.col("kind") == PLACED).join(late, "sequence_id", "left")
    kind = docs.schema[id_col].dataType
    return placed.select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", F.coalesce("step", "late").alias("step"))
