"""Associative reduction of one value per partition, level by level."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import frozen


def tree_reduce(parts: DataFrame, merge: Callable[[list[bytes]], bytes], fan_in: int = 16) -> bytes | None:
    """The value of all ``parts`` (``part bigint, data binary``, a row per part at most) merged in the order of their parts.

    A task holds ``fan_in`` values at most, and only the root's comes to the
    driver.  No parts give None.  Jobs run here.
    """

    def node(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [group["part"].iloc[0] // fan_in], "data": [merge(list(group.sort_values("part")["data"]))]})

    left = frozen(parts)
    top = left.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while top:
        top //= fan_in
        left = frozen(left.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(node, "part bigint, data binary"))
    return bytes(left.first()["data"])
