"""One document of each group of near copies: candidates by long SimHash sketches, links by exact similarity.

At a resemblance of 0.8, 64 fingerprint bits differ in ten places, too many
for the pruning of a trie.  So documents have sketches of SKETCH bits, and
several tables each sample a short path from them: documents that are alike
agree on some path but for one bit, with a probability that the number of
tables is chosen by.  A task holds the paths of one table with one beginning,
joins their trie with itself under a budget of one bit, and checks the pairs
that it finds by the distance of the whole sketches.

What that unites are candidates only.  The texts of each such group are dealt
out in blocks, and texts are linked where the exact similarity of their sets of
shingles is what was asked for.  Groups of several blocks get their most central
members in each block; members whose link to the largest part is still open then
meet all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.components import connected
from quillsift.llm.shared import as_bytes, fresh, frozen, meet, remember_only
from quillsift.llm.simhash_trie import Trie, fingerprint, forest, join_tries, shingle_hashes

WORDS = 4
SKETCH = 64 * WORDS
COLUMNS = [f"s{k}" for k in range(WORDS)]
#: Chance that two documents at the similarity asked for meet in no table.
MISS = 0.001
#: Standard deviations by which sketches of candidates may differ more than is usual at the similarity asked for.
SPREAD = 3
#: Sketches that a task should hold, on average, and pairs that it checks at once.
HELD = 1 << 14
BLOCK = 1 << 19
#: Texts of a group of candidates that are compared in one block, central members that each block gets besides, and texts of a task.
GROUP = 512
HUBS = 16
TEXTS = 1024
#: Large groups, or rows that are repeated, are broadcast up to so many.
FEW = 200_000
_GOLDEN = 0x9E3779B97F4A7C15


def bit_difference(similarity: float) -> float:
    """The share of bits in which sketches of two documents of equal length differ at a resemblance of their shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(count: int, similarity: float) -> tuple[int, int, int, int]:
    """Path bits, bits of the beginning that deals paths to tasks, tables, and the largest distance of sketches.

    Paths grow with the logarithm of the corpus, so that chance meetings stay
    few (about ten in a table) for each document; the tables make up for longer paths.
    """
    p = bit_difference(similarity)
    size = math.log2(max(2, count))
    bits = min(60, max(16, math.ceil(size) + 1))
    head = max(0, min(bits - 8, math.ceil(size - math.log2(HELD))))
    meet = (1 - p) ** bits + (bits - head) * p * (1 - p) ** (bits - 1)
    return bits, head, math.ceil(math.log(MISS) / math.log(1 - meet)), math.floor(SKETCH * p + SPREAD * math.sqrt(SKETCH * p * (1 - p)))


def sketch(hashes: np.ndarray) -> list[int]:
    """WORDS SimHash words of the distinct hashes, each from another mix of them; zeros for none."""
    distinct = np.unique(hashes)
    words = []
    for k in range(WORDS):
        x = distinct + np.uint64((k + 1) * _GOLDEN % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(fingerprint(x ^ (x >> np.uint64(31))))
    return words


def with_sketch(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """``docs`` with ``_sketch``: COLUMNS, and ``print``, a hash of the set of shingles."""

    @F.pandas_udf("struct<" + ",".join(f"{c}:bigint" for c in (*COLUMNS, "print")) + ">")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remember_only()
        for texts in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in texts]
            found = np.array([[*sketch(s), xxhash.xxh64_intdigest(s.tobytes())] for s in sets], np.uint64).reshape(-1, WORDS + 1)
            yield pd.DataFrame(found.view(np.int64), columns=[*COLUMNS, "print"])

    return docs.withColumn("_sketch", sketched(as_bytes(F.col(text_col))))


def _pairs_of(groups: Iterable[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all pairs of members of the groups (leaf, leaf); members of a leaf are consecutive."""
    for i, j in groups:
        # Rows of the first leaf are split, so that a block stays small even where two leaves are large.
        rows = np.repeat(starts[i] - np.concatenate(([0], np.cumsum(counts[i])[:-1])), counts[i]) + np.arange(counts[i].sum())
        other, size = np.repeat(starts[j], counts[i]), np.repeat(counts[j], counts[i])
        upto = np.cumsum(size)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
            n = size[at:end]
            first = np.repeat(rows[at:end], n)
            second = np.repeat(other[at:end] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield first, second
            at = end


def near_links(sketches: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect the sketches (``print`` and COLUMNS, distinct) that tables bring together and whose distance is within the limit."""
    bits, head, tables, most = plan(sketches.count(), similarity)
    rng = np.random.default_rng(10)
    places = [rng.choice(SKETCH, bits, replace=False) for _ in range(tables)]

    def paths(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch[COLUMNS].to_numpy(np.int64).astype(">i8")
            every = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(batch), -1), axis=1)
            for t, at in enumerate(places):
                path = np.zeros((len(batch), 64), np.uint8)
                path[:, :bits] = every[:, at]
                value = np.packbits(path, axis=1).view(">u8")[:, 0].astype(np.uint64)
                key = value >> np.uint64(64 - head) if head else np.zeros(len(batch), np.uint64)
                yield batch.assign(task=(key.astype(np.int64) * tables + t), path=value.view(np.int64))

    schema = "print bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)
    dealt = sketches.select("print", *COLUMNS).mapInPandas(paths, f"{schema}, task bigint, path bigint")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        path = group["path"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(path, kind="stable")
        leaves, starts, counts = np.unique(path[order], return_index=True, return_counts=True)
        words = np.ascontiguousarray(group[COLUMNS].to_numpy(np.int64).view(np.uint64)[order])
        names = group["print"].to_numpy(np.int64)[order]
        trie = Trie(leaves)
        several = np.flatnonzero(counts > 1)

        def groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if len(several):
                yield several, several
            yield from join_tries(trie, trie, 1, True)

        label = forest(len(names), _pairs_of(groups(), starts, counts), lambda i, j: np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= most)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": names[tied], "v": names[label[tied]]})

    return dealt.groupBy("task").applyInPandas(join, "u bigint, v bigint")


def same_share(a: np.ndarray, b: np.ndarray) -> float:
    """The exact resemblance of two sets (sorted, distinct); that of two empty ones is 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def exact_links(members: DataFrame, tasks: int, words: int, similarity: float, most: int) -> DataFrame:
    """Links (u, v) that connect the members of each (root, block, minors) whose exact similarity is as asked for.

    ``members`` has these three, ``print``, COLUMNS, ``text`` (bytes), ``part``
    (members of one are connected already) and ``minor``; one of a pair at least is minor.
    Near sketches are compared first, pairs that are connected by then aren't.
    """

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["root", "block", "minors", "print"], kind="stable", ignore_index=True)
        keys = group[["root", "block", "minors"]].to_numpy(np.int64)
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        sketches = np.ascontiguousarray(group[COLUMNS].to_numpy(np.int64).view(np.uint64))
        names, parts, minor, texts = group["print"].to_numpy(np.int64), group["part"].to_numpy(np.int64), group["minor"].to_numpy(bool), group["text"].to_list()
        links: list[tuple[int, int]] = []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            near = []
            for i in range(start, end - 1):
                distance = np.bitwise_count(sketches[i + 1 : end] ^ sketches[i]).sum(axis=1, dtype=np.int64)
                j = np.flatnonzero((distance <= most) & (parts[i + 1 : end] != parts[i]) & (minor[i + 1 : end] | minor[i]))
                near.append(np.stack((distance[j], np.full(len(j), i), j + i + 1)))
            pairs = np.concatenate(near, axis=1) if near else np.empty((3, 0), np.int64)
            above: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def top(part: int, above: dict[int, int] = above) -> int:
                while (up := above.get(part, part)) != part:
                    above[part] = above.get(up, up)
                    part = up
                return part

            for i, j in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
                x, y = top(int(parts[i])), top(int(parts[j]))
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = np.unique(shingle_hashes(texts[k], words))
                small, large = sorted((len(sets[i]), len(sets[j])))
                if small >= similarity * large and same_share(sets[i], sets[j]) >= similarity:
                    above[x] = y
                    links.append((int(names[i]), int(names[j])))
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    dealt = members.withColumn("_task", F.pmod(F.xxhash64("root", "block", "minors"), F.lit(tasks)))
    return dealt.groupBy("_task").applyInPandas(verify, "u bigint, v bigint")


def central(members: DataFrame) -> DataFrame:
    """``root, print`` of the HUBS members of each root whose sketches are nearest to the majority of its bits."""

    def bits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = np.unpackbits(np.ascontiguousarray(batch[COLUMNS].to_numpy(np.int64).astype(">i8")).view(np.uint8).reshape(len(batch), -1), axis=1)
            roots, at = np.unique(batch["root"].to_numpy(np.int64), return_inverse=True)
            yield pd.DataFrame({"root": roots, "n": np.bincount(at), "ones": [every[at == k].sum(axis=0, dtype=np.int64) for k in range(len(roots))]})

    def majority(group: pd.DataFrame) -> pd.DataFrame:
        up = 2 * np.sum(np.stack(group["ones"].to_list()), axis=0) > group["n"].sum()
        return pd.DataFrame([[group["root"].iloc[0], *np.packbits(up).view(">i8").tolist()]], columns=["root", *(f"m{k}" for k in range(WORDS))])

    counted = members.select("root", *COLUMNS).mapInPandas(bits, "root bigint, n bigint, ones array<bigint>")
    middle = frozen(counted.groupBy("root").applyInPandas(majority, "root bigint, " + ", ".join(f"m{k} bigint" for k in range(WORDS))))
    away = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"m{k}"))) for k, c in enumerate(COLUMNS)), F.lit(0))
    order = Window.partitionBy("root").orderBy("away", "print")
    return members.join(_few(middle), "root").select("root", "print", away.alias("away")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= HUBS).select("root", "print")


def _few(df: DataFrame) -> DataFrame:
    """``df`` (a frozen one), for a broadcast if it has so few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def each_once(source: DataFrame, rows: DataFrame) -> DataFrame:
    """``source`` with one of the rows that repeat id and text; ``rows`` has ``doc_id, hash`` of all of it."""
    often = frozen(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")))
    if often.isEmpty():
        return source
    same, often = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), _few(often)
    return source.join(often, same, "left_anti").unionByName(source.join(often, same, "left_semi").dropDuplicates(["doc_id", "hash"]))


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def verified(source: DataFrame, nodes: DataFrame, labels: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) by exact similarity that connect what is alike in each group of candidates.

    ``nodes`` has ``print``, COLUMNS and ``first`` (doc_id and hash of the one row
    of ``source`` with its text), ``labels`` the groups (node, root).
    """
    count, most = labels.count(), plan(2, similarity)[3]
    members = frozen(labels.join(nodes, F.col("node") == F.col("print")).select("root", "print", "first", *COLUMNS))

    def with_text(rows: DataFrame) -> DataFrame:
        same = source["doc_id"].eqNullSafe(rows["first.doc_id"]) & (source["hash"] == rows["first.hash"])
        return rows.join(source, same).select("root", "print", *COLUMNS, "block", "minors", "part", "minor", as_bytes(source["text"]).alias("text"))

    zero, blocks = F.lit(0).cast("long"), F.ceil(F.col("size") / GROUP)
    large = frozen(members.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP))
    any_large = not large.isEmpty()
    sized = members.join(_few(large), "root", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)).cast("long"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks"))).withColumns({"minors": zero, "part": F.col("print"), "minor": F.lit(True)})
    first = sized
    if any_large:
        hubs = sized.filter("blocks > 1").join(_few(frozen(central(members.join(_few(large), "root", "left_semi")))), ["root", "print"], "left_semi")
        spread = hubs.withColumn("_own", F.col("block")).withColumn("block", _upto(F.col("blocks"))).filter("block != _own").drop("_own")
        first = sized.unionByName(spread)
    links = frozen(exact_links(with_text(first), 1 + count // TEXTS, words, similarity, most))
    if not any_large:
        return links
    # Large groups that aren't one part yet: all members out of the largest part meet all blocks.
    parts = connected(links)
    whole = frozen(sized.filter("blocks > 1").drop("part").join(parts, F.col("print") == F.col("node"), "left").select(sized["root"], "print", "first", *COLUMNS, "block", "blocks", F.coalesce(parts["root"], "print").alias("part")))
    sizes = whole.groupBy("root", "part").agg(F.count("*").alias("n"))
    split = sizes.groupBy("root").agg(F.max(F.struct("n", "part"))["part"].alias("major"), (F.sum("n") - F.max("n")).alias("rest")).filter("rest > 0")
    split = frozen(split.withColumn("parts", F.ceil(F.col("rest") / GROUP)))
    if split.isEmpty():
        return links
    open_ = whole.join(_few(split), "root")
    base = open_.withColumn("minors", _upto(F.col("parts"))).withColumn("minor", F.lit(False))
    out = open_.filter("part != major").withColumn("minors", F.pmod(F.xxhash64(F.lit(1), "print"), F.col("parts"))).withColumn("block", _upto(F.col("blocks"))).withColumn("minor", F.lit(True))
    met = base.unionByName(out)
    more = exact_links(with_text(met), 1 + met.count() // TEXTS, words, similarity, most)
    return links.unionByName(frozen(more))


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash`` (of the text), ``print`` and ``root`` for each row: rows of one root are near copies.

    Two texts are linked if the exact resemblance of their sets of word
    shingles is ``similarity`` at least.  Candidates are those whose sketches
    some table brings together, and what these connect; a table misses a pair
    at the similarity once in 1,000 times (MISS), and its sketches differ too
    much as seldom (SPREAD).  Texts of the same words always are of one group;
    null and empty texts are.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    rows = frozen(with_sketch(source, words, "text").select("doc_id", "hash", "_sketch.*"))
    nodes = frozen(rows.groupBy("print").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in COLUMNS]))
    candidates = frozen(connected(near_links(nodes, similarity)))
    labels = connected(verified(each_once(source, rows), nodes, candidates, words, similarity))
    rooted = frozen(nodes.select("print", "copies").join(labels, F.col("print") == F.col("node"), "left").select("print", "copies", F.coalesce("root", "print").alias("root")))
    # A text that very many rows have (all that are empty, say) meets its root by broadcast.
    return meet(rows.select("doc_id", "hash", "print"), rooted, ["print"], "copies", rows.count(), 0).select("doc_id", "hash", "print", "root")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id (null last).

    Rows that repeat id and text are one document; an empty table gives no
    rows; all columns pass through.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    own, text, here = fresh(docs, "id", "hash", "here")
    stay = groups(docs, words, similarity, id_col, text_col).groupBy("root").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.hash").alias(text))
    marked = docs.withColumn(here, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(here) == F.col(text))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_col, here]).drop(here)
