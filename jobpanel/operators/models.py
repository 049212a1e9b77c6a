"""Fitted models (MLlib)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, GaussianMixture, KMeans, LDAModel
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, vec
from ..session import checkpoint, checkpoint_round, small_batches
from .ranks import join_on, ranked, shuffled, top_per_key


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.flat]).reshape(x.shape)


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def _expected_logs(concentration: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, one per row."""
    return _digamma(concentration) - _digamma(concentration.sum(axis=1, keepdims=True))


def _log_likelihood(model: LDAModel, bows: DataFrame) -> tuple[float, float]:
    """Lower bound of the log-likelihood of all documents, and their number of tokens.

    The bound of MLlib's `logLikelihood` (Hoffman et al. 2010), which takes the exponential of
    the whole topic-word table for every document, and again for the perplexity. Here MLlib
    infers the shares once, and each document costs its own words. Shares times the sum
    of the prior and the words are the variational parameters.
    """
    small_batches(bows.sparkSession)
    words = model.topicsMatrix().toArray().T  # topics x vocabulary, both bounded
    alpha, eta = np.array(model.estimatedDocConcentration().toArray()), 1.0 / len(words)
    logs = _expected_logs(words)
    shared = bows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(logs.T), alpha))

    @F.arrow_udf("struct<bound: double, n: double>")
    def bounds(at: pa.Array, times: pa.Array, shares: pa.Array) -> pa.Array:
        table, prior = shared.value
        out, sums = np.empty(len(at)), np.empty(len(at))
        counts = np.concatenate(([0], np.cumsum(pc.list_value_length(at).to_numpy())))
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy()
        shares = shares.flatten().to_numpy().reshape(len(out), -1)
        for r, (lo, hi) in enumerate(zip(counts, counts[1:])):
            sums[r] = times[lo:hi].sum()
        gamma = shares * (sums + prior.sum())[:, None]
        own = _expected_logs(gamma)
        for r, (lo, hi) in enumerate(zip(counts, counts[1:])):
            x = own[r] + table[at[lo:hi]]
            top = x.max(axis=1)
            out[r] = (times[lo:hi] * (top + np.log(np.exp(x - top[:, None]).sum(axis=1)))).sum()
        out += ((prior - gamma) * own).sum(axis=1) + (_log_gamma(gamma) - _log_gamma(prior)).sum(axis=1)
        out += math.lgamma(prior.sum()) - _log_gamma(gamma.sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(out), pa.array(sums)], ["bound", "n"])

    cells = F.unwrap_udt("features")
    known = F.size(cells["indices"]) > 0
    found = model.transform(bows.filter(known)).select(
        bounds(cells["indices"], cells["values"], vector_to_array(model.getTopicDistributionCol())).alias("b"))
    total = found.agg(F.sum("b.bound"), F.sum("b.n")).first()
    topics = ((eta - words) * logs).sum() + (_log_gamma(words) - math.lgamma(eta)).sum()
    topics += (math.lgamma(eta * words.shape[1]) - _log_gamma(words.sum(axis=1))).sum()
    return float((total[0] or 0.0) + topics), float(total[1] or 0.0)


def fit_topics(
    df: DataFrame, k: int, tokens: str = "tokens", vocab_size: int = fixed.VOCAB_KEEP,
    min_df: float = fixed.VOCAB_MIN_DF, max_df: float = fixed.VOCAB_MAX_DF, iterations: int = 15, fraction: float | None = None, seed: int = 42,
) -> tuple[DataFrame, list[float], dict[str, float]]:
    """Topic-word table (term, p), prior and fit figures of an online topic model.

    `fraction` trains on a Bernoulli sample, as the large corpus run does. The rows are
    read three times, so tokens should be materialised; only bags of words are held.
    """
    docs = df.select(tokens) if fraction is None else df.select(tokens).sample(fraction=fraction, seed=seed)
    n = docs.count()
    # MLlib holds all tokens as objects to find the number of documents for a share; as numbers the limits cost nothing
    least, most = (x if x >= 1 or x * n < 1 else x * n for x in (float(min_df), float(max_df)))
    counter = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=vocab_size, minDF=least, maxDF=most).fit(docs)
    bows = counter.transform(docs).select("features").persist()
    alpha = [1.0 / k] * k
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", docConcentration=alpha).fit(bows)
    likelihood, words = _log_likelihood(model, bows)
    figures = {"log_likelihood": likelihood, "log_perplexity": -likelihood / words if words else math.nan}
    bows.unpersist()
    weights = model.topicsMatrix().toArray()  # vocabulary x topics, both bounded
    shares = weights / weights.sum(axis=0, keepdims=True)
    rows = [(w, [float(x) for x in p]) for w, p in zip(counter.vocabulary, shares)]
    table = df.sparkSession.createDataFrame(rows, "term string, p array<double>")
    return table, alpha, figures


def fit_window_topics(df: DataFrame, window: str, k: int, **kw) -> DataFrame:
    """Topic-word rows per window, one model each; the number of windows is small."""
    out = None
    for value in sorted(r[0] for r in df.select(window).distinct().collect()):
        table, _, _ = fit_topics(df.filter(F.col(window) == value), k, **kw)
        table = table.withColumn(window, F.lit(value))
        out = table if out is None else out.unionByName(table)
    return out


def fit_word_vectors(df: DataFrame, dim: int = 200, window: int = 5, min_count: int = 50, tokens: str = "tokens", seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(term, v) word vectors (skip-gram), trained in as many tasks as the rows have partitions."""
    partitions = partitions or df.rdd.getNumPartitions()
    model = Word2Vec(
        vectorSize=dim, windowSize=window, minCount=min_count, inputCol=tokens, outputCol="_v",
        seed=seed, numPartitions=partitions, maxIter=1).fit(df.select(tokens))
    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("v"))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform("v", lambda x: x.cast("double"))))


def kmeans(df: DataFrame, k: int, seed: int = 42, iterations: int = 20) -> tuple[DataFrame, list[list[float]]]:
    """Rows with `cluster` and the k centers."""
    data = _vectors(df)
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features"), [[float(x) for x in c] for c in model.clusterCenters()]


def assign_by_dot(df: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Cluster with the largest dot product with the unit centers; lowest id on ties."""
    unit = vec.constant([list(map(float, c)) for c in centers], "array<array<double>>")
    dots = F.transform(unit, lambda c: vec.dot(F.col("v"), vec.normalize(c)))
    best = vec.let(dots, lambda d: F.array_position(d, F.array_max(d)) - 1)
    return df.withColumn("cluster", best.cast("int"))


def sub_clusters(
    df: DataFrame, parent: str, per_cluster: int = 20, seed: int = 42, iterations: int = 20, tolerance: float = 1e-4,
    block_rows: int = 4000,
) -> DataFrame:
    """K-means inside every parent cluster with enough members; columns `sub_cluster` and `cluster_label` (parent_sub).

    A parent of n rows has max(1, n // per_cluster) sub-clusters, which start at its
    rows first by a hash of their vector. All parents are fitted together: a round
    assigns every row to the nearest centre of its parent and averages by (parent,
    sub-cluster), one job however many parents there are. Rows of a parent are dealt
    into blocks, so a large one is many tasks; a task holds the centres of one parent.
    Rounds end when no centre moves by more than `tolerance`.
    """
    rows = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    n = F.col("_n")
    sizes = checkpoint(rows.groupBy(parent).agg(F.count(F.lit(1)).alias("_n")).select(
        parent, F.greatest(F.floor(n / per_cluster), F.lit(1)).alias("_k"), F.ceil(n / block_rows).cast("int").alias("_blocks")))
    block = F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int")
    dealt = checkpoint(join_on(rows.select(parent, "_row", "v"), sizes, [parent]).select(parent, block.alias("_block"), "_row", "v"))
    placed = ranked(rows.select(parent, "_row", "v").withColumn("_at", shuffled(F.col("v").cast("string"), seed=seed)), ["_at", "_row"], [parent], "_place")
    centres = join_on(placed, sizes, [parent]).filter(F.col("_place") <= F.col("_k")).select(
        parent, (F.col("_place") - 1).cast("int").alias("sub"), F.transform("v", lambda x: x.cast("double")).alias("c"))
    centres = checkpoint_round(centres)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    kind = df.schema[parent].dataType.simpleString()

    def near(r: pd.DataFrame, c: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, m = np.stack(r["v"].to_numpy()).astype(float), np.stack(c["c"].to_numpy())
        order = np.argsort(c["sub"].to_numpy())
        m = m[order]
        return x, ((m * m).sum(axis=1)[None, :] - 2.0 * (x @ m.T)).argmin(axis=1)

    def sums(key: tuple, r: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x, at = near(r, c)
        own = np.unique(at)
        total = np.zeros((len(c), x.shape[1]))
        np.add.at(total, at, x)
        return pd.DataFrame({
            "_p": [key[0]] * len(own), "sub": own.astype(np.int32), "n": np.bincount(at)[own], "s": list(total[own])})

    def assigned(key: tuple, r: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_row": r["_row"], "sub_cluster": near(r, c)[1].astype(np.int32)})

    def meet(function, schema: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
        other = join_on(centres, sizes, [parent]).select(F.col(parent).alias(parent), every, "sub", "c")
        return dealt.groupBy(parent, "_block").cogroup(other.groupBy(parent, "_block")).applyInPandas(function, schema)

    for _ in range(iterations):
        parts = meet(sums, f"_p {kind}, sub int, n bigint, s array<double>").withColumnRenamed("_p", parent)
        means = parts.groupBy(parent, "sub").agg(F.array(*[
            F.sum(F.get("s", F.lit(i))) / F.sum("n") for i in range(dim)]).alias("m"))
        moved = join_on(centres, means, [parent, "sub"], "left").select(
            parent, "sub", F.coalesce("m", "c").alias("c"), vec.squared_distance(F.coalesce("m", "c"), F.col("c")).alias("d"))
        centres = checkpoint_round(moved)
        if (centres.agg(F.max("d")).first()[0] or 0.0) <= tolerance * tolerance:
            break
    found = meet(assigned, "_row bigint, sub_cluster int")
    return rows.join(found, "_row").select(
        *df.columns, "sub_cluster").withColumn("cluster_label", F.concat_ws("_", F.col(parent), F.col("sub_cluster")))


def gaussian_mixture(df: DataFrame, k: int, seed: int = 42, dims: int | None = None) -> DataFrame:
    """Rows with soft membership per component (full covariance), on all or the first principal dimensions."""
    data, source = _vectors(df), "features"
    if dims is not None:
        data, source = PCA(k=dims, inputCol="features", outputCol="_x").fit(data).transform(data), "_x"
    model = GaussianMixture(
        k=k, seed=seed, maxIter=50, featuresCol=source, probabilityCol="_p", predictionCol="cluster").fit(data)
    return model.transform(data).withColumn("membership", vector_to_array("_p")).drop("features", "_x", "_p")


def cluster_grid(df: DataFrame, dims: Sequence[int], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """Inertia, silhouette and Calinski-Harabasz for each reduced dimension and k."""
    data = _vectors(df).select("features").persist()
    n = data.count()
    rows = []
    for d in dims:
        reduced = PCA(k=d, inputCol="features", outputCol="x").fit(data).transform(data).select("x").persist()
        spread = reduced.select(F.posexplode(vector_to_array("x")).alias("i", "x")).groupBy("i").agg(
            F.var_pop("x").alias("v")).agg(F.sum("v")).first()[0] * n
        for k in ks:
            model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(reduced)
            inertia = float(model.summary.trainingCost)
            silhouette = ClusteringEvaluator(featuresCol="x", predictionCol="cluster").evaluate(
                model.transform(reduced))
            ch = ((spread - inertia) / (k - 1)) / (inertia / (n - k)) if n > k > 1 else None
            rows.append((d, k, inertia, float(silhouette), ch))
        reduced.unpersist()
    data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "dim int, k int, inertia double, silhouette double, calinski_harabasz double")


def stratified_cap(df: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows per class, chosen by a hash of the key (a sampling operator)."""
    return top_per_key(df, [label], [shuffled(key, seed=seed), key], cap)


def _indexed(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """Columns `y`, `features` and `fold` of labelled topic shares."""
    classes = sorted(r[0] for r in df.select(label).distinct().collect())
    index = F.array(*[F.lit(c) for c in classes])
    return (
        df.withColumn("y", (F.array_position(index, F.col(label)) - 1).cast("double"))
        .withColumn("features", array_to_vector("theta"))
        .withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")))


def _cross_validated(data: DataFrame, folds: int) -> tuple[int, float, float]:
    """Rows and accuracies over all folds, each scored by a model that has not seen it."""
    parts = [_accuracy(data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)) for k in range(folds)]
    n = sum(p[0] for p in parts)
    return n, *(sum(p[0] * p[i] for p in parts) / max(n, 1) for i in (1, 2))


def classify_from_theta(df: DataFrame, label: str, key: str, folds: int = 5, cap: int = 5000, seed: int = 42) -> DataFrame:
    """Top-1 and top-3 accuracy per fold of a multinomial classifier on topic shares."""
    data = _indexed(stratified_cap(df, label, key, cap, seed), label, key, folds, seed).select(
        "y", "features", "fold").persist()
    rows = []
    for fold in range(folds):
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        rows.append((fold, *_accuracy(train, test)))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, n bigint, top1 double, top3 double")


def accuracy_by_year(
    df: DataFrame, label: str, key: str, year: str, folds: int = 5, cap: int = 5000, least: int = 5, seed: int = 42
) -> DataFrame:
    """Cross-validated accuracy inside every year; classes with fewer than `least` rows of a year are left out."""
    rows = []
    for value in sorted(r[0] for r in df.select(year).distinct().collect()):
        part = df.filter(F.col(year) == value)
        kept = part.groupBy(label).count().filter(F.col("count") >= least).select(label)
        data = _indexed(
            stratified_cap(part.join(kept, label, "left_semi"), label, key, cap, seed), label, key, folds, seed).persist()
        rows.append((value, *_cross_validated(data, folds)))
        data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, f"{year} {df.schema[year].dataType.simpleString()}, n bigint, top1 double, top3 double")


def _accuracy(train: DataFrame, test: DataFrame) -> tuple[int, float, float]:
    model = LogisticRegression(labelCol="y", maxIter=20, regParam=0.01, family="multinomial").fit(train)
    scored = model.transform(test).withColumn("p", vector_to_array("probability"))
    own = F.get("p", F.col("y").cast("int"))
    better = F.size(F.filter("p", lambda x: x > own))
    r = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg((better < 1).cast("int")).alias("a"),
        F.avg((better < 3).cast("int")).alias("b")).first()
    return int(r["n"]), float(r["a"] or 0.0), float(r["b"] or 0.0)


def cross_period_accuracy(
    df: DataFrame, label: str, key: str, period: str, first, second, folds: int = 5, cap: int = 5000,
    band: float = 0.01, seed: int = 42,
) -> DataFrame:
    """Accuracy within and across two periods, both ways.

    Within a period rows are scored by folds, so no model scores rows it has seen.
    The gap is the second period's accuracy minus the first's, read against a
    +-band. Only classes present in both periods take part.
    """
    shared = df.filter(F.col(period) == first).select(label).intersect(
        df.filter(F.col(period) == second).select(label))
    known = df.join(shared, label, "left_semi")
    capped = top_per_key(known, [period, label], [shuffled(key, seed=seed), key], cap)
    data = _indexed(capped, label, key, folds, seed).persist()
    parts = {p: data.filter(F.col(period) == p) for p in (first, second)}
    rows = [(str(p), str(p), *_cross_validated(parts[p], folds)) for p in (first, second)]
    rows += [(str(a), str(b), *_accuracy(parts[a], parts[b])) for a, b in ((first, second), (second, first))]
    data.unpersist()
    gap = rows[1][3] - rows[0][3]
    verdict = "worse" if gap < -band else "better" if gap > band else "stable"
    return df.sparkSession.createDataFrame(
        [(*r, gap, verdict) for r in rows],
        "train string, test string, n bigint, top1 double, top3 double, gap double, verdict string")


def _boosted(data: DataFrame, target: str, used: Sequence[str], seed: int) -> tuple[float, float, list[float]]:
    """R2 and RMSE on the test rows of boosted trees on some features, and their importances."""
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=list(used), outputCol="features"),
        GBTRegressor(labelCol=target, featuresCol="features", maxIter=10, maxDepth=4, seed=seed)])
    model = steps.fit(data.filter(~F.col("test")))
    scored = model.transform(data.filter("test"))
    r2 = RegressionEvaluator(labelCol=target, metricName="r2").evaluate(scored)
    rmse = RegressionEvaluator(labelCol=target, metricName="rmse").evaluate(scored)
    return float(r2), float(rmse), [float(x) for x in model.stages[-1].featureImportances.toArray()]


def _split(df: DataFrame, target: str, key: str, features: Sequence[str], seed: int) -> DataFrame:
    """Complete rows with `test`, a fifth of them by a hash of the key."""
    return df.select(target, key, *features).dropna().withColumn(
        "test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(5)) == 0)


def regress_metric(df: DataFrame, target: str, blocks: dict[str, Sequence[str]], key: str, seed: int = 42) -> DataFrame:
    """R2 and RMSE of boosted trees on all features and without each feature block."""
    features = [f for block in blocks.values() for f in block]
    data = _split(df, target, key, features, seed).persist()
    rows = []
    for name in ["all", *blocks]:
        used = [f for b, fs in blocks.items() for f in fs if b != name]
        r2, rmse, weights = _boosted(data, target, used, seed)
        rows.append((name, len(used), r2, rmse, used[weights.index(max(weights))], max(weights)))
    data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "left_out string, n_features int, r2 double, rmse double, top_feature string, importance double")


def feature_importance(df: DataFrame, target: str, features: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Importance of every feature in the full model, its share and rank."""
    data = _split(df, target, key, features, seed).persist()
    _, _, weights = _boosted(data, target, features, seed)
    data.unpersist()
    order = sorted(range(len(features)), key=lambda i: (-weights[i], features[i]))
    whole = sum(weights) or 1.0
    return df.sparkSession.createDataFrame(
        [(features[i], weights[i], weights[i] / whole, k + 1) for k, i in enumerate(order)],
        "feature string, importance double, share double, rank int")


def ablation_by_period(
    df: DataFrame, target: str, features: Sequence[str], tested: str, period: str, key: str, seed: int = 42
) -> DataFrame:
    """Per period, R2 with and without one feature, the difference and the feature's share of importance."""
    rows = []
    rest = [f for f in features if f != tested]
    for value in sorted(r[0] for r in df.select(period).distinct().collect()):
        data = _split(df.filter(F.col(period) == value), target, key, features, seed).persist()
        r2, _, weights = _boosted(data, target, features, seed)
        without, _, _ = _boosted(data, target, rest, seed)
        data.unpersist()
        rows.append((str(value), r2, without, r2 - without, weights[list(features).index(tested)] / (sum(weights) or 1.0)))
    return df.sparkSession.createDataFrame(
        rows, "period string, r2_with double, r2_without double, delta_r2 double, share double")
