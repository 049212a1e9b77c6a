"""All-against-all work in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def compare_blocks(
    left: DataFrame,
    right: DataFrame,
    function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = 5000,
) -> DataFrame:
    """Apply `function` to every pair of a left and a right block.

    Rows are hashed by `id` into blocks of about `block_rows`, so a task holds
    two blocks whatever the keys look like. `function` returns a reduced frame.
    """
    n_left = max(1, math.ceil(left.count() / block_rows))
    n_right = max(1, math.ceil(right.count() / block_rows))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = left.withColumn("_i", block(n_left)).withColumn("_j", every(n_right))
    b = right.withColumn("_j", block(n_right)).withColumn("_i", every(n_left))

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame(columns=[c.strip().split(" ")[0] for c in schema.split(",")])
        return function(l, r)

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(run, schema)
