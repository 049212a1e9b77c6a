"""Least squares with effects of any number of levels, absorbed by iterated weighted demeaning.

Rows are reduced to cells, one per combination of the effects' levels, with their sums
and products. Outcome and covariates are then demeaned over the cells, effect after
effect, until no level mean is left: the residuals of the cells. What varies inside a
cell is not touched by any effect, so cell residuals and the products inside the cells
give the regression of the demeaned rows. Level means stay a table; nothing that grows
with the number of levels reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, stored
from .econ import Fit
from .ranks import join_on

TOLERANCE = 1e-8  # largest level mean left, in standard deviations of its column
MAX_ROUNDS = 1000
EXPLAINED = 1e-12  # share of a covariate's variance that may be left when the effects explain it


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _cells(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Per cell: rows, weight, means `m` and products of deviations inside the cell `p`."""
    w = F.col("w")
    sums = stored(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"),
        *[(F.sum(w * F.col(f"z{i}")) / F.sum(w)).alias(f"m{i}") for i in range(n)]))
    # products of deviations: the means are subtracted before anything is squared; one row alone has none
    several = sums.filter("n > 1").select(*keys, *[f"m{i}" for i in range(n)])
    dev = [F.col(f"z{i}") - F.col(f"m{i}") for i in range(n)]
    inside = stored(join_on(rows, several, keys).groupBy(*keys).agg(*[
        F.sum(w * dev[i] * dev[j]).alias(f"p{i}_{j}") for i, j in _pairs(n)]))
    products = {f"p{i}_{j}": F.when(F.col("n") > 1, F.col(f"p{i}_{j}")).otherwise(0.0) for i, j in _pairs(n)}
    out = stored(join_on(sums, inside, keys, "left").withColumns(products))
    discard(sums, inside)
    return out


def _residuals(cells: DataFrame, levels: Sequence[DataFrame], effects: Sequence[str], n: int) -> DataFrame:
    """Cells with `r`, their means without what the levels were given so far."""
    out = cells
    for k, (effect, given) in enumerate(zip(effects, levels)):
        out = join_on(out, given.select(effect, *[F.col(f"a{i}").alias(f"_a{k}_{i}") for i in range(n)]), [effect])
    left = {f"r{i}": F.col(f"m{i}") - sum((F.col(f"_a{k}_{i}") for k in range(len(levels))), F.lit(0.0)) for i in range(n)}
    return out.withColumns(left).drop(*[f"_a{k}_{i}" for k in range(len(levels)) for i in range(n)])


def _demeaned(cells: DataFrame, effects: Sequence[str], n: int, tolerance: float) -> tuple[DataFrame, int]:
    """Cells whose residuals have no mean left over any level of any effect, and the rounds it took.

    Cells stay as they are; a round rewrites one table per effect, of what each level
    was given (`a`) and given last (`d`).
    """
    w = F.col("w")
    spread = cells.agg(*[
        F.sqrt(F.sum(F.col(f"p{i}_{i}") + w * F.col(f"m{i}") * F.col(f"m{i}")) / F.sum(w)).alias(f"s{i}") for i in range(n)]).first()
    scale = [float(s or 0.0) or 1.0 for s in spread]
    levels = [stored(cells.select(e).distinct().select(e, *[F.lit(0.0).alias(f"a{i}") for i in range(n)])) for e in effects]
    for rounds in range(1, MAX_ROUNDS + 1):
        for k, effect in enumerate(effects):
            means = _residuals(cells, levels, effects, n).groupBy(effect).agg(*[
                (F.sum(w * F.col(f"r{i}")) / F.sum(w)).alias(f"d{i}") for i in range(n)])
            old = levels[k].select(effect, *[f"a{i}" for i in range(n)])
            given = stored(join_on(old, means, [effect]).withColumns({
                f"a{i}": F.col(f"a{i}") + F.col(f"d{i}") for i in range(n)}))
            discard(levels[k])
            levels[k] = given
        if len(effects) == 1:
            break
        change = F.greatest(*[F.abs(f"d{i}") / scale[i] for i in range(n)], F.lit(0.0))
        left = reduce(DataFrame.union, [t.agg(F.max(change).alias("d")) for t in levels]).agg(F.max("d")).first()[0]
        if (left or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"level means of {left:.1e} standard deviations are left after {MAX_ROUNDS} rounds")
    out = stored(_residuals(cells, levels, effects, n))
    discard(cells, *levels)
    return out, rounds


def absorbed_wls(
    df: DataFrame, y: str, covariates: Sequence[str], effects: Sequence[str], weight: str | None = None,
    cov: str = "nonrobust", cluster: str | None = None, tolerance: float = TOLERANCE,
) -> Fit:
    """Weighted least squares of `y` on covariates with `effects` absorbed.

    cov: nonrobust, hc1 or cluster. Coefficients are those of a model with one dummy
    per level; rows with a missing input or no positive weight leave, a null level is
    a level. Degrees of freedom count all levels of the first effect and all but one of
    every further one, which is exact where the effects connect all rows. A covariate
    the effects explain gets no coefficient of its own (0, without variance). Demeaning
    goes on until `tolerance`; where the effects barely connect, that takes many rounds,
    and it raises rather than return what has not converged. `extra` holds the rounds
    and the levels.
    """
    names, m = list(covariates), len(covariates) + 1
    z = [F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate([y, *names])]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    groups = [F.col(e).cast("string").alias(f"g{i}") for i, e in enumerate(effects)]
    by = [F.col(cluster).cast("string").alias("c")] if cluster else []
    rows = stored(
        df.select(*z, w.alias("w"), *groups, *by).dropna(subset=[f"z{i}" for i in range(m)]).filter("w > 0"))
    keys = [f"g{i}" for i in range(len(effects))]
    levels = [rows.select(k).distinct().count() for k in keys]
    cells, rounds = _demeaned(_cells(rows, [*keys, *(["c"] if cluster else [])], m), keys, m, tolerance)
    if cov != "hc1":
        discard(rows)

    def product(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"p{i}_{j}") + F.col("w") * F.col(f"r{i}") * F.col(f"r{j}")

    total = cells.agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("m0")) / F.sum("w")).alias("mean"),
        *[F.sum(product(i, j)).alias(f"x{i}_{j}") for i, j in _pairs(m)],
        *[F.sum(F.col("w") * F.col(f"m{i}")).alias(f"s{i}") for i in range(1, m)],
        *[F.sum(F.col(f"p{i}_{i}") + F.col("w") * F.col(f"m{i}") * F.col(f"m{i}")).alias(f"t{i}") for i in range(1, m)],
        F.sum(F.col("p0_0") + F.col("w") * F.col("m0") * F.col("m0")).alias("yy")).first()
    gram = np.zeros((m, m))
    for i, j in _pairs(m):
        gram[i, j] = gram[j, i] = float(total[f"x{i}_{j}"] or 0.0)
    for i in range(1, m):  # what the effects explain but for the rounding of their means counts as explained
        whole = float(total[f"t{i}"] or 0.0) - float(total[f"s{i}"] or 0.0) ** 2 / float(total["w"] or 1.0)
        if gram[i, i] <= EXPLAINED * whole:
            gram[i, :] = gram[:, i] = 0.0
    size = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    lam, vec = np.linalg.eigh(gram[1:, 1:] / np.outer(size[1:], size[1:])) if names else (np.empty(0), np.empty((0, 0)))
    good = lam > 1e-11
    inverse = (vec[:, good] / lam[good]) @ vec[:, good].T / np.outer(size[1:], size[1:]) if names else np.empty((0, 0))
    beta = inverse @ gram[1:, 0]
    n, rank = int(total["n"] or 0), int(good.sum()) + sum(levels) - max(len(levels) - 1, 0)
    rss = float(gram[0, 0] - beta @ gram[1:, 0])
    tss = float((total["yy"] or 0.0) - (total["w"] or 0.0) * (total["mean"] or 0.0) ** 2)
    df_tail, normal = n - rank, cov != "nonrobust"
    if cov == "nonrobust":
        v = rss / max(n - rank, 1) * inverse
    elif cov == "cluster":
        # a row's score is its covariate times its residual, both demeaned; sums by cluster come from the cells
        scores = [F.sum(product(i, 0) - sum((float(b) * product(i, j + 1) for j, b in enumerate(beta)), F.lit(0.0))).alias(f"u{i}")
                  for i in range(1, m)]
        by_cluster = cells.groupBy("c").agg(*scores)
        meat = by_cluster.agg(F.count(F.lit(1)).alias("g"), *[
            F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"v{i}_{j}") for i in range(1, m) for j in range(i, m)]).first()
        g = int(meat["g"])
        v = inverse @ _square(meat, m) @ inverse * (g / max(g - 1, 1)) * ((n - 1) / max(n - rank, 1))
        df_tail = g - 1
    elif cov == "hc1":
        shift = cells.select(*keys, *[(F.col(f"m{i}") - F.col(f"r{i}")).alias(f"_s{i}") for i in range(m)])
        own = join_on(rows, shift, keys)
        dev = [F.col(f"z{i}") - F.col(f"_s{i}") for i in range(m)]
        e = dev[0] - sum((float(b) * dev[j + 1] for j, b in enumerate(beta)), F.lit(0.0))
        meat = own.agg(*[
            F.sum(F.col("w") * F.col("w") * e * e * dev[i] * dev[j]).alias(f"v{i}_{j}") for i in range(1, m) for j in range(i, m)]).first()
        v = inverse @ _square(meat, m) @ inverse * n / max(n - rank, 1)
    else:
        raise ValueError(f"no covariance {cov}")
    return Fit(names, beta, v, n, rank, 1 - rss / tss if tss > 0 else float("nan"), df_tail, normal,
               {"rounds": rounds, "levels": dict(zip(effects, levels))})


def _square(row: object, m: int) -> np.ndarray:
    out = np.zeros((m - 1, m - 1))
    for i in range(1, m):
        for j in range(i, m):
            out[i - 1, j - 1] = out[j - 1, i - 1] = float(row[f"v{i}_{j}"] or 0.0)
    return out
