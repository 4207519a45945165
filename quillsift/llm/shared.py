"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without the setting (tests) gets a folder of its own; on a
    cluster, where a machine's folder isn't shared, its absence is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillsift-")
        delete_at_exit(spark, found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the session delete a folder of its own when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the session ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    return folder


def frozen(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder until the session ends, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
        delete_at_exit(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint(eager=True)


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


_memories: list[dict] = []


def remember_only(memory: dict | None = None) -> None:
    """Empty the memories of other operators, as a task of this one begins: Spark uses a worker for the tasks of many, and it would hold all of theirs."""
    for other in _memories:
        if other is not memory:
            other.clear()
    _memories[:] = [] if memory is None else [memory]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in itertools.count() if (n := f"_{name}{k or ''}").lower() not in taken) for name in names]


def hot_limit(total: int) -> int:
    """Rows from which a key is hot: a thousandth of all, so that a thousand keys are at most."""
    return max(100, total // 1000)


def meet(rows: DataFrame, entries: DataFrame, on: list[str], count: str, total: int, few: int) -> DataFrame:
    """``rows`` joined with ``entries``, which has one row per key and the ``count`` of its rows (``total`` together).

    Up to ``few`` entries are broadcast.  Of more, only those of hot keys are,
    so that their rows stay where they are; others meet by a shuffle.
    """
    if few and entries.count() <= few:
        return rows.join(F.broadcast(entries), on)
    is_hot = F.col(count) > hot_limit(total)
    hot, cold = F.broadcast(entries.filter(is_hot)), entries.filter(~is_hot)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))
