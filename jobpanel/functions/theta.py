"""Breadth and concentration of a topic distribution (array of K shares)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed
from .vec import constant, dot, let, total


def raw_entropy(theta: Column, eps: float = fixed.INFERENCE_EPS) -> Column:
    return -total(F.transform(theta, lambda p: p * F.log(p + eps)))


def entropy(theta: Column, k: int, eps: float = fixed.INFERENCE_EPS) -> Column:
    """Shannon entropy scaled to [0, 1]."""
    return raw_entropy(theta, eps) / math.log(k)


def hhi(theta: Column) -> Column:
    return dot(theta, theta)


def diversification(theta: Column, k: int) -> Column:
    return (1 - hhi(theta)) / (1 - 1 / k)


def dominant_share(theta: Column) -> Column:
    return F.array_max(theta)


def dominant_topic(theta: Column) -> Column:
    """Id of the largest share, the lowest id on ties."""
    return (F.array_position(theta, F.array_max(theta)) - 1).cast("int")


def effective_topics(theta: Column) -> Column:
    return F.exp(raw_entropy(theta))


def rao_q(theta: Column, distances: Sequence[Sequence[float]]) -> Column:
    """Quadratic entropy with a K x K distance matrix."""
    matrix = constant([list(map(float, row)) for row in distances], "array<array<double>>")
    return total(F.zip_with(theta, matrix, lambda p, row: p * dot(theta, row)))


def gini(theta: Column) -> Column:
    """Gini coefficient of the positive shares; 1 when there is at most one."""
    def body(p: Column) -> Column:
        n = F.size(p)
        ranked = total(F.transform(p, lambda x, i: x * (i + 1)))
        mass = total(p)
        return F.when(n <= 1, 1.0).otherwise((2 * ranked - (n + 1) * mass) / (n * mass))

    return let(F.array_sort(F.filter(theta, lambda x: x > 0)), body)


def significant_topics(theta: Column, k: int) -> Column:
    return F.size(F.filter(theta, lambda x: x > 1 / k))


def tail_mass(theta: Column, top: int = 3) -> Column:
    return 1 - total(F.slice(F.sort_array(theta, asc=False), 1, top))


def effective_domains(entropy_score: Column, k: int) -> Column:
    return F.pow(F.lit(float(k)), entropy_score)


def index_entropy(theta: Column, k: int) -> Column:
    """Entropy of the combined index: the small constant is inside and outside the log."""
    eps = fixed.INDEX_EPS
    return -total(F.transform(theta, lambda p: (p + eps) * F.log(p + eps))) / math.log(k)


def combined_index(theta: Column, k: int) -> Column:
    return (index_entropy(theta, k) + diversification(theta, k)) / 2


def skill_entropy(similarities: Column, k: int) -> Column:
    """Entropy of a similarity vector normalised to shares."""
    eps = fixed.INDEX_EPS

    def body(mass: Column) -> Column:
        return -total(F.transform(
            similarities, lambda s: (s / mass) * F.log(s / mass + eps))) / math.log(k)

    return let(total(similarities) + eps, body)


def metric_columns(
    theta: Column, k: int, distances: Sequence[Sequence[float]] | None = None
) -> dict[str, Column]:
    """All per-posting metrics under their table names."""
    out = {
        "entropy_score": entropy(theta, k),
        "hhi_score": hhi(theta),
        "dominant_topic_id": dominant_topic(theta),
        "dominant_topic_prob": dominant_share(theta),
        "ent_effective": effective_topics(theta),
        "gini": gini(theta),
        "n_sig_topics": significant_topics(theta, k),
        "tail_mass_ratio": tail_mass(theta),
    }
    if distances is not None:
        out["rao_q"] = rao_q(theta, distances)
    return out
