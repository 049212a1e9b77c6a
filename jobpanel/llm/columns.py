"""Columns of operators beside those of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """The names, with underscores put before those the input has (case does not count)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        out.append(name)
    return out


def packed(docs: DataFrame, **needed: str) -> DataFrame:
    """Whole rows in `row`, beside the needed columns under an operator's names.

    A filter that adds columns of its own works on this; `select("row.*")` gives the
    rows back as they were, whatever their columns are called.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[F.col(f"`{c}`").alias(name) for name, c in needed.items()])

