"""Best-fit packing of documents into sequences of a fixed token length.

Hierarchical residual packing: every input partition tokenizes its documents
and packs their pieces by best fit into bins, batch by batch.  Bins that are
(nearly) full are final.  Underfull bins become items themselves: nodes of a
tree pack the underfull bins of ``fan_in`` children by best fit again, until
one node is left.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import as_bytes, frozen, remember_only

PIECE = "struct<doc_id:string,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BIN = f"part bigint, batch bigint, up boolean, bin bigint, fill int, members array<{PIECE}>"
MERGED = "part bigint, batch bigint, up boolean, bin bigint, fill int, parts array<struct<bin:bigint,shift:bigint>>"
#: Pieces that are packed together as one leaf of the tree: bounds what a task holds.
LEAF_PIECES = 50_000
#: Levels that a tree can have (8 ** 24 leaves).
LEVELS = 24
#: Merged bins are broadcast up to so many rows of two longs each; beyond that, they are joined by shuffle.
FEW_MOVES = 1_000_000
#: Distinct stretches between spaces remembered by a worker; it forgets all of them beyond that.
REMEMBERED = 800_000


class Ids(dict):
    """Token ids, as little-endian bytes, of a text under a byte-level BPE tokenizer file.

    The ids are those of the ``tokenizers`` library for the file; they are
    found by the file's ranks, about three times as fast.  A space before
    anything but white space always begins a pre-token, and merges stay
    inside pre-tokens, so ids are looked up by stretches between spaces.
    """

    def __init__(self, path: str):
        import tiktoken

        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = byte_alphabet()
        ranks = {bytes(map(byte_of.__getitem__, token)): n for token, n in vocab.items() if all(c in byte_of for c in token) and not token.startswith("<|endof")}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __missing__(self, part: str) -> bytes | None:
        if len(self) >= REMEMBERED:
            self.clear()
        if not part or part[0].isspace():
            return None  # inside a run of white space, where a space may begin no pre-token
        found = self.slow(" " + part)
        if "\n" not in part:
            self[part] = found
        return found

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        return self.slow(text) if None in found else self.slow(first) + b"".join(found)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_loaded: dict[str, Ids] = {}


def token_ids(path: str) -> Ids:
    """The worker's tokenizer for a vocabulary file, loaded once; added tokens are text like any other to it."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    remember_only(_loaded[path])
    return _loaded[path]


def default_ids(path: str) -> Callable[[str], bytes]:
    """The ids that ``tokenizers`` gives at its default setting: added tokens of the file, found first, have their own."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with flags")
    plain, own = token_ids(path), {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
    if not own:
        return plain
    cut = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split

    def encode(text: str) -> bytes:
        first, *rest = cut(text)
        if not rest:
            return plain(text)
        return plain(first) + b"".join(own[x] if k % 2 == 0 else plain(x) for k, x in enumerate(rest))

    return encode


def pieces_of(doc_id: str | None, ids: bytes, capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc32) of a document's ids, with the closing id 0; all pieces but the first have ``capacity`` ids."""
    ids += b"\0\0\0\0"
    first = len(ids) % (4 * capacity) or 4 * capacity
    for piece, end in enumerate(range(first, len(ids) + 1, 4 * capacity)):
        start = max(0, end - 4 * capacity)
        part = ids[start:end]
        yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)


def _place(item: tuple[int, list]) -> tuple:
    """A fixed order among items of one size: by their first member, those without an id first."""
    first = item[1][0]
    return (first[0] is not None, 0 if first[0] is None else first[0], first[1:])


def best_fit(items: Iterable[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing: each (size, members) goes where it leaves least room.

    Bins are kept by the room they have left: sorted list of the distinct
    rooms (at most ``capacity``) and a stack of bins for each.
    """
    rooms: list[int] = []
    open_bins: dict[int, list[list]] = {}
    closed: list[tuple[int, list]] = []

    def put(room: int, members: list) -> None:
        if room == 0:
            closed.append((capacity, members))
        elif stack := open_bins.get(room):
            stack.append(members)
        else:
            open_bins[room] = [members]
            insort(rooms, room)

    for size, members in sorted(items, key=lambda x: (-x[0], _place(x))):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            put(capacity - size, list(members))
            continue
        room = rooms[at]
        stack = open_bins[room]
        chosen = stack.pop()
        if not stack:
            del open_bins[room]
            rooms.pop(at)
        chosen.extend(members)
        put(room - size, chosen)
    return closed + [(capacity - room, members) for room, stack in open_bins.items() for members in stack]


def laid_out(members: list[tuple]) -> list[tuple]:
    """The pieces of a bin with their places in it, from 0 on without gaps."""
    ends = list(itertools.accumulate(m[3] for m in members))
    return [(*m, end - m[3]) for m, end in zip(members, ends, strict=True)]


def handed_on(fills: Iterable[int], full: float, most: int) -> Iterator[bool]:
    """For each bin whether it goes on to the parent node: underfull ones do, ``most`` of each fill."""
    seen: Counter[int] = Counter()
    for fill in fills:
        seen[fill] += fill < full
        yield fill < full and seen[fill] <= most


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, near_full: float = 0.98, tokenizer: Callable[[str], Callable[[str], bytes]] = default_ids) -> DataFrame:
    """Pack the documents' token sequences (each closed by id 0) into bins of ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.  Documents longer than a sequence are cut into full
    pieces, of which a shorter one comes first; others stay whole.  Null texts count as empty and give
    the closing id alone; null and repeated ids, and ids of any type, are
    packed like others; an empty table gives no rows; further columns are
    ignored.

    Leaves are batches of LEAF_PIECES pieces of a partition, packed by best fit
    decreasing.  Bins filled to ``near_full`` are final; the others are items
    of the parent node, which packs those of ``fan_in`` children by best fit
    again, up to one root.  A node gets bins' numbers and fills, not their
    pieces, and no more of one fill than could ever be used: best fit leaves
    one bin at most that is half full or less, only such a bin can go into
    another, so a node with ``fan_in`` children uses up ``fan_in`` bins of a
    fill at most, and all nodes above a bin together ``fan_in * LEVELS``.
    What a node reads is bounded by that number times the fills there are, and
    the result is the same as if all bins went up.
    """
    # Ids go to Python as text: pandas would make longs beside nulls doubles.
    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    full, most = near_full * capacity, fan_in * LEVELS

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        number, leaf = itertools.count(part << 40), 0

        def rows(bins: list[tuple[int, list]]) -> pd.DataFrame:
            up = handed_on((fill for fill, _ in bins), full, most)
            return pd.DataFrame([(part, leaf, goes, next(number), fill, laid_out(members)) for (fill, members), goes in zip(bins, up, strict=True)], columns=["part", "batch", "up", "bin", "fill", "members"])

        waiting: list[tuple[int, list]] = []
        for batch in batches:
            whole: list[tuple[int, list]] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for piece in pieces_of(doc_id, encode(text.decode("utf-8", "replace")), capacity):
                    (whole if piece[3] == capacity else waiting).append((piece[3], [piece]))
                if len(waiting) >= LEAF_PIECES:
                    yield rows(best_fit(waiting, capacity))
                    waiting, leaf = [], leaf + 1
                if len(whole) >= LEAF_PIECES:
                    yield rows(whole)
                    whole = []
            if whole:
                yield rows(whole)
        if waiting:
            yield rows(best_fit(waiting, capacity))

    def merge(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            below = {int(b): p for b, p in zip(group["bin"], group["parts"], strict=True) if p is not None}
            packed = best_fit([(int(fill), [(int(b), int(fill))]) for b, fill in zip(group["bin"], group["fill"], strict=True)], capacity)
            out = []
            for (fill, members), goes in zip(packed, handed_on((f for f, _ in packed), full, most), strict=True):
                shift, parts = 0, []
                for number, size in members:
                    parts += [{"bin": int(p["bin"]), "shift": shift + int(p["shift"])} for p in below.get(number, ({"bin": number, "shift": 0},))]
                    shift += size
                out.append((group["part"].iloc[0], group["batch"].iloc[0], goes and not last, members[0][0], fill, parts if len(parts) > 1 else None))
            return pd.DataFrame(out, columns=["part", "batch", "up", "bin", "fill", "parts"])

        return run

    bins = frozen(source.mapInPandas(local, BIN))
    left = bins.filter("up").select("part", "batch", "bin", "fill", F.lit(None).cast("array<struct<bin:bigint,shift:bigint>>").alias("parts"))
    parts, leaves = left.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.max("batch"), F.lit(0))).first()
    moves = []
    # Leaves of a partition meet first, then partitions.
    while parts or leaves:
        if leaves:
            leaves //= fan_in
            node = left.withColumn("batch", F.floor(F.col("batch") / fan_in))
        else:
            parts //= fan_in
            node = left.withColumn("part", F.floor(F.col("part") / fan_in))
        level = frozen(node.groupBy("part", "batch").applyInPandas(merge(not parts and not leaves), MERGED))
        moves.append(level.filter("not up and parts is not null").select(F.col("bin").alias("sequence_id"), F.explode("parts").alias("p")))
        left = level.filter("up").drop("up")
    placed = bins.select("up", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("shift"), "members")
    if moves:
        # At most one bin of each node goes into another, so these are few.
        moved = frozen(reduce(DataFrame.unionByName, moves).select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.shift").alias("shift")))
        few = F.broadcast(moved) if moved.count() <= FEW_MOVES else moved
        own = bins.filter("up").select("bin", "members").join(few, "bin", "left")
        placed = placed.filter("not up").drop("up").unionByName(own.select(F.coalesce("sequence_id", "bin").alias("sequence_id"), F.coalesce("shift", F.lit(0)).cast("long").alias("shift"), "members"))
    one = placed.select("sequence_id", "shift", F.explode("members").alias("m"))
    kind = docs.schema[id_col].dataType
    return one.select(F.col("m.doc_id").cast(kind).alias("doc_id"), "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", (F.col("shift") + F.col("m.offset")).alias("offset"))
