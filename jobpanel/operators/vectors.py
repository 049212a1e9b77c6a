"""Cosine neighbours, soft assignments and drift between groups of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vec
from ..session import checkpoint
from .blocks import compare_blocks
from .ranks import shuffled, top_per_key

TILE_ROWS = 2000  # rows of each side whose similarities are held at once
MAX_MODEL_CELLS = 20_000_000  # numbers in a reference matrix that goes to every task


def _unit(values: pd.Series) -> np.ndarray:
    m = np.stack(values.to_numpy()).astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _top(l_ids: np.ndarray, lm: np.ndarray, r_ids: np.ndarray, rm: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k best right rows of every left row, in tiles of both sides."""
    parts = []
    for at in range(0, len(l_ids), TILE_ROWS):
        own, best = l_ids[at:at + TILE_ROWS], None
        for to in range(0, len(r_ids), TILE_ROWS):
            ids = np.broadcast_to(r_ids[to:to + TILE_ROWS], (len(own), len(r_ids[to:to + TILE_ROWS])))
            sims = lm[at:at + TILE_ROWS] @ rm[to:to + TILE_ROWS].T
            if exclude_self:
                sims[own[:, None] == ids] = -2.0
            if k < ids.shape[1]:  # all rows that tie with the k-th may count
                least = np.partition(sims, -k, axis=1)[:, -k, None]
                width = int((sims >= least).sum(axis=1).max())
                kept = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < ids.shape[1] else np.arange(width)[None, :]
                ids, sims = np.take_along_axis(ids, kept, axis=1), np.take_along_axis(sims, kept, axis=1)
            if best is not None:
                ids, sims = np.hstack([best[0], ids]), np.hstack([best[1], sims])
            order = np.lexsort((ids, -sims), axis=1)[:, :k]
            best = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        if best is not None:
            parts.append(pd.DataFrame({"id": np.repeat(own, best[0].shape[1]), "neighbour": best[0].ravel(), "sim": best[1].ravel()}))
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"id": l_ids[:0], "neighbour": r_ids[:0], "sim": np.zeros(0)})
    return out[out["sim"] > -1.5]


_FOUND = "id bigint, neighbour bigint, sim double"


def nearest(left: DataFrame, right: DataFrame, k: int = 1, block_rows: int = 4000, exclude_self: bool = False) -> DataFrame:
    """The `k` most similar right vectors per left vector: id, neighbour, sim, rank.

    Both sides hold (id, v). A right side within the checked size goes to every
    task as one matrix; a larger one is searched by cells, see `pruned_nearest`.
    Only `k` rows per left row and block leave a task.
    """
    right = right.select("id", "v")
    sizes = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if sizes["n"] and sizes["n"] * sizes["d"] > MAX_MODEL_CELLS:
        return pruned_nearest(left, right, k, block_rows, exclude_self)[0]
    rows = right.toPandas()
    shared = left.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), _unit(rows["v"]) if len(rows) else None))

    def match(batches):
        r_ids, rm = shared.value
        for batch in batches:
            for at in range(0, len(batch) if len(r_ids) else 0, block_rows):
                part = batch.iloc[at:at + block_rows]
                yield _top(part["id"].to_numpy(), _unit(part["v"]), r_ids, rm, k, exclude_self)

    found = left.select("id", "v").mapInPandas(match, _FOUND)
    return top_per_key(found, ["id"], [F.desc("sim"), "neighbour"], k, rank="rank")


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1.0, 1.0))


MARGIN = 1e-6  # angle by which rounding may move a bound


def pruned_nearest(
    left: DataFrame, right: DataFrame, k: int = 1, block_rows: int = 4000, exclude_self: bool = False,
    cells: int | None = None, seed: int = 42,
) -> tuple[DataFrame, int]:
    """`nearest` by cells, and the number of pairs of rows that were compared.

    Right vectors belong to the nearest of some centres, drawn from them; a cell knows
    its widest angle. A left vector first visits its nearest cells until they hold enough
    rows, which gives a similarity its answers must reach, and then only those cells that
    can reach it by the triangle inequality of angles. The answer is exact; how many
    cells are left out depends on how far the data fall into clusters. Vectors of length
    zero are in a cell of their own, with similarity zero to all. Cells are cut into blocks on
    both sides by what meets there, so no task holds a large one.
    """
    left, right = checkpoint(left.select("id", "v")), checkpoint(right.select("id", "v"))
    m = right.count()
    count = cells or max(1, min(2048, math.isqrt(m)))  # bounds what goes to the tasks
    drawn = right.filter(vec.norm(F.col("v")) > 0).orderBy(shuffled("id", seed=seed), "id").limit(count).toPandas()
    centres = _unit(drawn["v"]) if len(drawn) else np.zeros((0, 1))
    count, wanted = len(centres), k + int(exclude_self)

    def deal(batches):
        for batch in batches:
            if len(batch):
                u = _unit(batch["v"])
                near, wide = np.full(len(u), count), np.zeros(len(u))
                own = np.linalg.norm(u, axis=1) > 0
                if count:
                    angle = _angles(u[own], centres)
                    near[own], wide[own] = angle.argmin(axis=1), angle.min(axis=1)
                yield pd.DataFrame({"cell": near, "angle": wide, "id": batch["id"], "v": batch["v"]})

    vectors = left.schema["v"].dataType.simpleString()
    placed = checkpoint(right.mapInPandas(deal, f"cell int, angle double, id bigint, v {right.schema['v'].dataType.simpleString()}"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect()  # one row per cell
    size, radius = np.zeros(count + 1, np.int64), np.zeros(count + 1)
    for r in stats:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["a"]

    def visits(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best similarity each cell can reach, and whether the cell is among the first visited."""
        angle = np.column_stack([_angles(u, centres), np.full(len(u), np.pi / 2)]) if count else np.full((len(u), 1), np.pi / 2)
        reach = np.cos(np.maximum(angle - radius - MARGIN, 0.0))
        flat = np.linalg.norm(u, axis=1) == 0
        reach[:, count], reach[flat] = 0.0, 0.0
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, order, before < wanted, axis=1)
        return reach, first & (size > 0)

    def pick(second: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    part = batch.iloc[at:at + 1000]
                    reach, first = visits(_unit(part["v"]))
                    chosen = first
                    if second:
                        chosen = (reach >= part["bound"].to_numpy()[:, None] - MARGIN) & ~first & (size > 0)
                    i, c = np.nonzero(chosen)
                    yield pd.DataFrame({"cell": c, "id": part["id"].to_numpy()[i], "v": part["v"].to_numpy()[i]})

        return run

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame(columns=["id", "neighbour", "sim"])
        return _top(l["id"].to_numpy(), _unit(l["v"]), r["id"].to_numpy(), _unit(r["v"]), k, exclude_self)

    def met(visitors: DataFrame) -> tuple[DataFrame, int]:
        asked = {r["cell"]: r["n"] for r in visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        deals = [(c, max(1, math.ceil(n / block_rows)), max(1, math.ceil(int(size[c]) / block_rows))) for c, n in asked.items()]
        table = F.broadcast(left.sparkSession.createDataFrame(deals, "cell int, nl int, nr int"))  # a row per cell

        def block(rows: DataFrame, own: str, n: str, other: str, n_other: str) -> DataFrame:
            return (rows.join(table, "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("cell", "_l", "_r", "id", "v"))

        a = block(visitors, "_l", "nl", "_r", "nr").groupBy("cell", "_l", "_r")
        b = block(placed.select("cell", "id", "v"), "_r", "nr", "_l", "nl").groupBy("cell", "_l", "_r")
        return checkpoint(a.cogroup(b).applyInPandas(compare, _FOUND)), sum(n * int(size[c]) for c, n in asked.items())

    home = checkpoint(left.mapInPandas(pick(False), f"cell int, id bigint, v {vectors}"))
    found, compared = met(home)
    reached = top_per_key(found, ["id"], [F.desc("sim"), "neighbour"], k, rank="rank").filter(F.col("rank") == k)
    bounded = left.join(reached.select("id", F.col("sim").alias("bound")).distinct(), "id", "left").fillna({"bound": -1.0})
    rest = checkpoint(bounded.mapInPandas(pick(True), f"cell int, id bigint, v {vectors}"))
    more, compared_then = met(rest)
    both = found.unionByName(more)
    return top_per_key(both, ["id"], [F.desc("sim"), "neighbour"], k, rank="rank"), compared + compared_then


def above_threshold(left: DataFrame, labels: DataFrame, threshold: float = 0.5, block_rows: int = 4000) -> DataFrame:
    """Labels more similar than the threshold, compared in blocks of both sides."""

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        sims = _unit(l["v"]) @ _unit(r["v"]).T
        i, j = np.nonzero(sims > threshold)
        return pd.DataFrame({"id": l["id"].to_numpy()[i], "label": r["id"].to_numpy()[j], "sim": sims[i, j]})

    return compare_blocks(
        left.select("id", "v"), labels.select("id", "v"), compare, "id bigint, label bigint, sim double", block_rows)


def exposure_score(left: DataFrame, right: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Similarity-weighted mean score of the `k` nearest codes and the best code."""
    found = nearest(left, right, k).join(scores.withColumnRenamed("id", "neighbour"), "neighbour")
    return found.groupBy("id").agg(
        (F.sum(F.col("sim") * F.col("score")) / F.sum("sim")).alias("jd_ai_score"),
        F.max(F.when(F.col("rank") == 1, F.col("neighbour"))).alias("top1_code"),
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1_sim"))


def centroids(df: DataFrame, keys: Sequence[str], dim: int, unit: bool = False) -> DataFrame:
    """Mean vector per key, combined on the map side."""
    out = df.groupBy(*keys).agg(vec.mean_vector(F.col("v"), dim).alias("v"))
    return out.withColumn("v", vec.normalize(F.col("v"))) if unit else out


def automation_split(df: DataFrame, automation: Sequence[float], augmentation: Sequence[float]) -> DataFrame:
    """Cosine to two concept centroids, their shares and the scores split by share."""
    unit = vec.normalize(F.col("v"))
    out = (
        df.withColumn("_u", unit)
        .withColumn("sim_auto", vec.dot(F.col("_u"), vec.normalize(vec.constant(list(automation)))))
        .withColumn("sim_aug", vec.dot(F.col("_u"), vec.normalize(vec.constant(list(augmentation)))))
        .withColumn("share_auto", F.col("sim_auto") / (F.col("sim_auto") + F.col("sim_aug")))
        .withColumn("share_aug", F.col("sim_aug") / (F.col("sim_auto") + F.col("sim_aug"))))
    return out.withColumns({
        "automation_score": F.col("share_auto") * F.col("score"),
        "augmentation_score": F.col("share_aug") * F.col("score")}).drop("_u")


def soft_assignment(df: DataFrame, centers: Sequence[Sequence[float]], eps: float = 1e-10) -> DataFrame:
    """Array of inverse squared distance weights to fixed centers, summing to one."""
    matrix = vec.constant([list(map(float, c)) for c in centers], "array<array<double>>")
    inverse = F.transform(matrix, lambda c: 1.0 / (vec.squared_distance(F.col("v"), c) + eps))
    weights = vec.let(inverse, lambda w: vec.let(
        vec.total(w), lambda s: F.transform(w, lambda x: x / s)))
    return df.withColumn("weights", weights)


def adjacent_cosines(df: DataFrame, window: str, topic: str) -> DataFrame:
    """Cosine of every topic with every topic of the next window; for topic tables, the pairs are the result."""
    windows = sorted(r[0] for r in df.select(window).distinct().collect())
    steps = df.sparkSession.createDataFrame(
        list(zip(windows, windows[1:])), f"window_from {df.schema[window].dataType.simpleString()}, "
        f"window_to {df.schema[window].dataType.simpleString()}")
    unit = df.withColumn("v", vec.normalize(F.col("v")))
    a = unit.select(F.col(window).alias("window_from"), F.col(topic).alias("source"), F.col("v").alias("a"))
    b = unit.select(F.col(window).alias("window_to"), F.col(topic).alias("target"), F.col("v").alias("b"))
    return (
        steps.join(a, "window_from").join(b, "window_to")
        .select("window_from", "window_to", "source", "target", vec.dot(F.col("a"), F.col("b")).alias("sim")))


def similarity_moments(df: DataFrame, group: str, dim: int) -> DataFrame:
    """Mean and population sd of the cosine over all pairs of adjacent groups.

    E[x.y] is the product of the mean vectors and E[(x.y)^2] that of the second
    moments, so two passes over the rows replace the pair table.
    """
    unit = df.withColumn("_u", vec.normalize(F.col("v")))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]

    def moments(batches):
        for batch in batches:
            if batch.empty:
                continue
            rows = []
            for g, part in batch.groupby("g"):
                m = np.stack(part["u"].to_numpy())
                rows.append((g, len(m), m.sum(axis=0), (m.T @ m)[np.triu_indices(dim)]))
            yield pd.DataFrame(rows, columns=["g", "n", "s", "c"])

    kind = df.schema[group].dataType.simpleString()
    parts = unit.select(F.col(group).alias("g"), F.col("_u").alias("u")).mapInPandas(
        moments, f"g {kind}, n bigint, s array<double>, c array<double>")
    long = parts.select("g", "n", F.posexplode(F.concat("s", "c")).alias("i", "x"))
    sums = long.groupBy("g", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    mean = sums.withColumn("x", F.col("x") / F.col("n"))
    groups = sorted(r[0] for r in mean.select("g").distinct().collect())
    steps = df.sparkSession.createDataFrame(
        list(zip(groups, groups[1:])), f"group_from {kind}, group_to {kind}")
    a = mean.select(F.col("g").alias("group_from"), "i", F.col("x").alias("a"))
    b = mean.select(F.col("g").alias("group_to"), "i", F.col("x").alias("b"))
    diagonal = [float(i == j) for i, j in pairs]
    twice = F.when(F.col("i") < dim, 0.0).otherwise(
        2.0 - F.get(vec.constant(diagonal), F.col("i") - dim))
    product = F.col("a") * F.col("b")
    out = steps.join(a, "group_from").join(b, ["group_to", "i"]).groupBy("group_from", "group_to").agg(
        F.sum(F.when(F.col("i") < dim, product).otherwise(0.0)).alias("mean_similarity"),
        F.sum(F.when(F.col("i") >= dim, product * twice).otherwise(0.0)).alias("_second"))
    variance = F.greatest(F.col("_second") - F.col("mean_similarity") ** 2, F.lit(0.0))
    return out.withColumn("std_similarity", F.sqrt(variance)).drop("_second")


def centroid_similarities(df: DataFrame, group: str, dim: int) -> DataFrame:
    """Cosine of every row with the centroid of the next group: group_from, group_to, sim."""
    centers = centroids(df, [group], dim, unit=True)
    groups = sorted(r[0] for r in centers.select(group).collect())
    kind = df.schema[group].dataType.simpleString()
    steps = df.sparkSession.createDataFrame(
        list(zip(groups, groups[1:])), f"group_from {kind}, group_to {kind}")
    ahead = steps.join(centers.select(F.col(group).alias("group_to"), F.col("v").alias("c")), "group_to")
    rows = df.select(F.col(group).alias("group_from"), vec.normalize(F.col("v")).alias("u"))
    return rows.join(F.broadcast(ahead), "group_from").select(  # one row per group
        "group_from", "group_to", vec.dot(F.col("u"), F.col("c")).alias("sim"))


def shifted_share(df: DataFrame, group: str, threshold: float = 0.3) -> DataFrame:
    """Per pair of adjacent groups, rows of the first whose best match in the second stays below the threshold."""
    values = sorted(r[0] for r in df.select(group).distinct().collect())
    best = None
    for first, second in zip(values, values[1:]):
        left, right = df.filter(F.col(group) == first), df.filter(F.col(group) == second)
        part = nearest(left, right, 1).select(F.lit(first).alias("group_from"), F.lit(second).alias("group_to"), "sim")
        best = part if best is None else best.unionByName(part)
    return best.groupBy("group_from", "group_to").agg(
        F.count_if(F.col("sim") < threshold).alias("n_shifted"), F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("sim") < threshold) / F.count(F.lit(1)) * 100).alias("shifted_percentage"),
        F.avg("sim").alias("avg_max_similarity"), F.min("sim").alias("min_max_similarity"))


def centroid_matches(sims: DataFrame) -> DataFrame:
    """Best and worst match of each centroid in the next window; ties go to the smaller id."""
    return sims.groupBy("window_from", "window_to", "source").agg(
        F.min_by("target", F.struct(-F.col("sim"), F.col("target"))).alias("best_match"),
        F.max("sim").alias("best_similarity"),
        F.min_by("target", F.struct(F.col("sim"), F.col("target"))).alias("worst_match"),
        F.min("sim").alias("worst_similarity"))


def profile_shares(df: DataFrame, key: str, words: DataFrame, tokens: str = "tokens", min_tokens: int = 5) -> DataFrame:
    """Long table of skill-cluster shares of documents with enough skill tokens.

    `words` maps word to cluster; a document is counted inside the join, then
    combined per (document, cluster) before it is shuffled.
    """
    counts = (
        df.select(key, F.explode(tokens).alias("word")).join(words, "word")
        .groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total")).filter(F.col("total") >= min_tokens)
    return counts.join(totals, key).select(key, "cluster", "n", (F.col("n") / F.col("total")).alias("share"))


def profile_columns(df: DataFrame, key: str, words: DataFrame, ai_cluster: str, tokens: str = "tokens") -> DataFrame:
    """Skill tokens, coverage, breadth, top cluster and AI share of every document.

    Ties for the top cluster go to the smaller cluster id.
    """
    counts = (
        df.select(key, F.explode(tokens).alias("word")).join(words, "word")
        .groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n")))
    ai = F.sum(F.when(F.col("cluster") == ai_cluster, F.col("n")).otherwise(0))
    per = counts.groupBy(key).agg(
        F.sum("n").alias("skill_token_count"), F.count(F.lit(1)).alias("n_skill_clusters"),
        F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("top_cluster"),
        ai.alias("_ai"))
    out = df.withColumn("token_count", F.size(tokens)).join(per, key, "left").fillna(
        {"skill_token_count": 0, "n_skill_clusters": 0, "top_cluster": "", "_ai": 0})
    skills, count = F.col("skill_token_count"), F.col("token_count")
    return out.withColumns({
        "skill_coverage": F.when(count > 0, skills / count).otherwise(0.0),
        "ai_intensity": F.when(skills > 0, F.col("_ai") / skills).otherwise(0.0),
        "ai_binary": (F.col("_ai") > 0).cast("int")}).drop("_ai")


def window_fingerprint(df: DataFrame, window: str, skills: Sequence[tuple[str, Sequence[float]]], weight: dict[str, Column] | None = None) -> DataFrame:
    """Mean cosine of each window's texts with each skill vector; gates may scale one skill."""
    unit = df.withColumn("_u", vec.normalize(F.col("v")))
    sims = []
    for name, v in skills:
        sim = vec.dot(F.col("_u"), vec.normalize(vec.constant(list(map(float, v)))))
        if weight and name in weight:
            sim = sim * weight[name]
        sims.append(F.avg(sim).alias(name))
    wide = unit.groupBy(window).agg(*sims)
    rows = F.array(*[F.struct(F.lit(n).alias("skill"), F.col(f"`{n}`").alias("similarity")) for n, _ in skills])
    return wide.select(window, F.inline(rows))
