"""Arrays of doubles as vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def constant(value: Sequence, ddl: str = "array<double>") -> Column:
    """A small constant array or matrix; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    return let(norm(a), lambda size: F.when(
        size > 0, F.transform(a, lambda x: x.cast("double") / size)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def softmax(a: Column) -> Column:
    def powers(top: Column) -> Column:
        return F.transform(a, lambda x: F.exp(x.cast("double") - top))

    return let(F.array_max(a).cast("double"), lambda top: let(
        powers(top), lambda p: let(total(p), lambda s: F.transform(p, lambda x: x / s))))


def mean_vector(c: Column, dim: int) -> Column:
    """Element-wise mean as an aggregate; combines on the map side."""
    return F.array(*[F.avg(F.get(c, F.lit(i)).cast("double")) for i in range(dim)])
