"""Joins with keys that may hold a large share of the rows, and tasks in proportion to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than so small a part of all rows is hot; there can't be more than SHARE of them, so they are broadcast.
SHARE = 1000
#: Rows of a task where groups are sorted.
TASK_ROWS = 500_000
#: Rows of a task that parses an answer for each, or for several: a small file would be one task.
ANSWER_ROWS = 20_000


def spread(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """``rows`` dealt (by keys, if there are any) to as many tasks as hold ``most`` (TASK_ROWS) each, where that is more than there would be.

    What is grouped or windowed by the keys then isn't shuffled again, and no
    task's sorts grow with the table.  The rows are counted here.
    """
    tasks = -(-rows.count() // (most or TASK_ROWS))
    given = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys else rows.rdd.getNumPartitions()
    return rows.repartition(tasks, *keys) if tasks > given else rows


def meet(rows: DataFrame, entries: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``entries``, which has one row per key and the ``count`` of its rows.

    Hot keys are broadcast to their rows, which stay where they are; others
    meet by a shuffle.  The rows are counted here (from ``entries``).
    """
    total = entries.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) > max(100, total // SHARE)
    hot, cold = F.broadcast(entries.filter(is_hot)), entries.filter(~is_hot)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(entries.filter(is_hot).select(*on)), on, "left_anti").join(cold, on))
