"""Exact de-duplication by an extendible-hash index on shared files.

Rows are entries, known by the leading bits of their text's digest.  The
directory doubles until no bucket has too many entries and routes each entry to
its bucket; an owner task has the buckets of a range of keys, whole, and sorts
their entries: equal digests are a chain, which says what stays and how many
there are.  Owner tasks write pages with that in the shared folder, and rows are
answered from them.  A bucket that is too large at the last bit has a digest
with very many rows: its entries are dealt to several owners, whose partial
chains are merged.  Texts of chains with several rows then go to their owners as
well, which compare their bytes; where one digest has different texts, each
text becomes a link of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.extendible import BITS, Directory, build, leading_bits
from quillsift.llm.shared import frozen, meet, shared_folder

#: Entries of one bucket.
CAPACITY = 100_000
#: Digests of several rows are broadcast up to so many (100 bytes each), else they meet the texts by a shuffle.
FEW = 500_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty.

    The pattern leaves single spaces alone, which are most of them.
    """
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def keyed(docs: DataFrame, digest_bits: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, norm, text_sha256, key`` (the digest's first bits, in hex) for each row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hashed = texts.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    # Never null, and Spark is told so: else joins on it would compute it once more to filter.
    return hashed.withColumn("key", F.coalesce(F.substring("text_sha256", 1, digest_bits // 4), F.lit("")))


@dataclass
class Index:
    """The index of a table's texts.

    ``pages``: a row per entry, ``owner, start, part`` (its bucket by the first
    of its hash values, and its share of a bucket that is dealt out), ``bits,
    key, doc_id, text_sha256, keep_id, group_size``; ``linked``: ``doc_id,
    text_sha256, key, chain, keep_id, group_size`` of rows whose digest has
    different texts, None if there are none; ``collided``: the keys of these.
    """

    pages: DataFrame
    linked: DataFrame | None
    collided: DataFrame
    directory: Directory


def owned(entries: DataFrame, directory: Directory, owners: int) -> DataFrame:
    """``entries`` (with ``bits``) with ``depth``, the ``start`` of their bucket, and its ``owner``: buckets of one range of keys have one."""
    start = F.call_function("shiftleft", F.col("prefix"), (F.lit(BITS) - F.col("depth")).cast("int"))
    routed = directory.route(entries).withColumn("start", start).drop("prefix")
    return routed.withColumn("owner", F.shiftright(F.col("start") * owners, BITS))


def index(docs: DataFrame, capacity: int = CAPACITY, digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Build the index: jobs run here, and its pages are in the shared folder when it returns.

    ``digest_bits`` of SHA-256 are the key (fewer of them make collisions, for
    tests; results are the same).
    """
    entries = keyed(docs, digest_bits, id_col, text_col).withColumn("bits", leading_bits(F.rpad("key", 8, "0")))
    entries = frozen(entries.select("doc_id", "text_sha256", "key", "bits", F.monotonically_increasing_id().alias("at")))
    directory = build(entries.select("bits", F.lit(1).alias("one")), capacity, "one")
    placed = owned(entries, directory, 1 + 2 * (entries.count() // capacity))
    # Buckets over the limit at the last bit: fewer than entries / capacity, so they are broadcast.
    full = placed.filter(F.col("depth") == BITS).groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") > capacity)
    full = frozen(full.select("start", F.lit(BITS).alias("depth"), F.ceil(F.col("n") / capacity).alias("parts")))
    dealt = placed.join(F.broadcast(full), ["start", "depth"], "left").withColumn("part", F.coalesce(F.pmod("at", "parts"), F.lit(0).cast("long")))
    # An owner sorts whole buckets by key; a chain is a run of one key in that order.
    chain = Window.partitionBy("owner", "start", "key", "part")
    chained = dealt.repartition("owner", "part").withColumns(
        {
            "place": F.row_number().over(chain.orderBy(F.col("doc_id").asc_nulls_last())),
            "keep_id": F.min("doc_id").over(chain),
            "group_size": F.count("*").over(chain),
        }
    )
    folder = shared_folder(docs.sparkSession, "exact-index")
    chained.drop("at").write.parquet(folder)
    pages = docs.sparkSession.read.parquet(folder)
    heads = pages.filter("place = 1").select("owner", "start", "key", "keep_id", "group_size", F.col("parts").isNotNull().alias("spread"))
    some_full = not full.isEmpty()
    if some_full:
        merged = heads.filter("spread").groupBy("owner", "start", "key").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(True).alias("spread"))
        merged = frozen(merged)
        heads = heads.filter("not spread").unionByName(merged)
        wide = pages.filter("parts is not null").drop("keep_id", "group_size")
        few = merged.count() <= FEW
        known = merged.select("start", "key", "keep_id", "group_size")
        pages = pages.filter("parts is null").unionByName(wide.join(F.broadcast(known) if few else known, ["start", "key"]))
    # Texts of chains with several rows go to the chains' owners.
    wanted = frozen(heads.filter("group_size > 1").select("owner", "start", "key", "spread"))
    texts = keyed(docs, digest_bits, id_col, text_col)
    members = texts.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "key")
    at = ["owner", "start", "key"]
    compared = members.filter("not spread").select(*at, "norm")
    if some_full:
        # Of a chain that several owners have, a map task hands on each of its texts once.
        compared = compared.unionByName(members.filter("spread").select(*at, "norm").distinct())
    compared = compared.repartition("owner")
    before = F.lag("norm").over(Window.partitionBy(*at).orderBy("key"))
    collided = frozen(compared.withColumn("before", before).filter("norm != before").select("key").distinct())
    linked = None
    if not collided.isEmpty():
        met = frozen(texts.join(collided, "key", "left_semi"))
        links = met.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        links = frozen(links.withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("norm"))))
        linked = meet(met, links, ["key", "norm"], "group_size", met.count(), 0).select("doc_id", "text_sha256", "key", "chain", "keep_id", "group_size")
    return Index(pages.drop("parts", "place", "depth"), linked, collided, directory)


def lookup(found: Index) -> DataFrame:
    """``doc_id, text_sha256, keep_id, group_size`` for each row of the indexed table, from its pages."""
    shown = ["doc_id", "text_sha256", "keep_id", "group_size"]
    if found.linked is None:
        return found.pages.select(*shown)
    return found.pages.join(found.collided, "key", "left_anti").select(*shown).unionByName(found.linked.select(*shown))


def dedup(docs: DataFrame, capacity: int = CAPACITY, digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark exact copies: of equal texts, the row with the smallest id stays.

    Returns one row per document: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  Texts are equal when they are identical after each run of
    ASCII white space is made one space; null counts as empty.  Rows with a
    null id are never preferred to others; where a group has no id at all,
    keep_id is null and all its rows are kept, as they can't be told apart.
    Repeated rows (same id, same text) are all kept or all dropped.  An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    found = lookup(index(docs, capacity, digest_bits, id_col, text_col))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), groups AS (
    SELECT norm, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM texts GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM texts t JOIN groups g ON t.norm = g.norm
"""
