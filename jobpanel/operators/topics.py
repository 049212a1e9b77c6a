"""Topic inference, topic tables and topic vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, vec
from ..session import checkpoint, small_batches
from .ranks import top_per_key


MAX_VOCABULARY = 2 * fixed.VOCAB_KEEP  # terms of a model that goes to every task
_SLICE_TOKENS = 50_000


def _mean_logs(model: DataFrame, k: int):
    """Arrow function from tokens to the number of known ones and their mean log-probability per topic."""
    small_batches(model.sparkSession)
    rows = model.toArrow()
    terms = rows["term"].combine_chunks()
    logs = np.array(rows["logp"].combine_chunks().flatten()).reshape(len(rows), k)
    shared = model.sparkSession.sparkContext.broadcast((terms, logs))

    @F.arrow_udf("struct<n: bigint, mean: array<double>>")
    def means(tokens: pa.Array) -> pa.Array:
        known, table = shared.value
        slot = pc.index_in(tokens.flatten(), value_set=known).to_numpy(zero_copy_only=False)
        found = ~np.isnan(slot) if slot.dtype.kind == "f" else np.ones(len(slot), bool)
        owner = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())[found]
        slot = slot[found].astype(np.int64)
        count = np.bincount(owner, minlength=len(tokens))
        total = np.zeros((len(tokens), k))
        for at in range(0, len(slot), _SLICE_TOKENS):
            own = owner[at:at + _SLICE_TOKENS]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total[own[first]] += np.add.reduceat(table[slot[at:at + _SLICE_TOKENS]], first, axis=0)
        mean = total / np.maximum(count, 1)[:, None]
        cuts = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * k)
        return pa.StructArray.from_arrays(
            [pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(mean.reshape(-1)))], ["n", "mean"])

    return means


def infer(
    df: DataFrame, key: str, topic_words: DataFrame, alpha: Sequence[float],
    noise: Sequence[int] = (), tokens: str = "tokens", min_tokens: int = fixed.MIN_TOKENS,
) -> DataFrame:
    """Folding-in: theta_k ~ alpha_k * (prod P(w|k))^(1/n), array of K shares per document.

    `topic_words` holds (term, p: array of K). A vocabulary of checked size goes to
    every task, which scores a document where it lies; nothing is shuffled. A larger
    one is joined to the exploded tokens, and the K log sums are combined per document
    before the shuffle.
    """
    k, eps = len(alpha), fixed.INFERENCE_EPS
    model = topic_words.select("term", F.transform("p", lambda x: F.log(x + eps)).alias("logp"))
    long = df.filter(F.size(tokens) >= min_tokens)
    if model.limit(MAX_VOCABULARY + 1).count() <= MAX_VOCABULARY:
        means = _mean_logs(model, k)
        sums = long.select(key, means(F.col(tokens)).alias("_m")).select(
            key, F.col("_m.n").alias("n_known"), F.col("_m.mean").alias("_mean"))
    else:
        words = long.select(key, F.explode(tokens).alias("term"))
        sums = words.join(model, "term").groupBy(key).agg(
            F.count(F.lit(1)).alias("n_known"),
            F.array(*[F.avg(F.get("logp", F.lit(i))) for i in range(k)]).alias("_mean"))
    prior = vec.constant([float(np.log(a + eps)) for a in alpha])
    scores = F.zip_with("_mean", prior, lambda m, a: m + a)
    known = sums.filter(F.col("n_known") >= min_tokens)
    theta = known.withColumn("theta", vec.softmax(scores))
    if noise:
        keep = vec.constant([0.0 if i in set(noise) else 1.0 for i in range(k)])
        masked = F.zip_with("theta", keep, lambda p, m: p * m)
        theta = theta.withColumn("theta", vec.let(masked, lambda p: vec.let(
            vec.total(p), lambda s: F.when(s >= 1e-30, F.transform(p, lambda x: x / s)))))
        theta = theta.filter("theta is not null")
    return theta.select(key, "theta", "n_known")


def long_theta(theta: DataFrame, key: str, min_prob: float = fixed.LONG_TABLE_MIN_PROB) -> DataFrame:
    """(document, topic, prob) rows with at least the minimum probability."""
    return theta.select(key, F.posexplode("theta").alias("topic", "prob")).filter(
        F.col("prob") >= min_prob)


def divergence(topic_words: DataFrame, k: int) -> DataFrame:
    """Jensen-Shannon divergence of every pair of topics: i < j, jsd."""
    eps = fixed.INFERENCE_EPS
    topics = F.posexplode("p")
    left = topic_words.select("term", "p", topics.alias("i", "pi"))
    both = left.select("i", "pi", F.posexplode("p").alias("j", "pj")).filter("i < j")
    m = (F.col("pi") + F.col("pj")) * 0.5

    def part(p: Column) -> Column:
        return p * F.log(p / (m + eps) + eps)

    return both.groupBy("i", "j").agg(
        (F.sum(part(F.col("pi")) + part(F.col("pj"))) * 0.5).alias("jsd"))


def divergence_matrix(topic_words: DataFrame, k: int) -> list[list[float]]:
    """The K x K matrix on the driver; K is the number of topics."""
    matrix = [[0.0] * k for _ in range(k)]
    for r in divergence(topic_words, k).collect():
        matrix[r["i"]][r["j"]] = matrix[r["j"]][r["i"]] = r["jsd"]
    return matrix


def top_words(topic_words: DataFrame, n: int = 20) -> DataFrame:
    """(topic, rank, term, p) of the most probable words; ties in term order."""
    long = topic_words.select("term", F.posexplode("p").alias("topic", "p"))
    return top_per_key(long, ["topic"], [F.desc("p"), "term"], n, rank="rank")


def topic_labels(words: DataFrame, n: int = 5) -> DataFrame:
    """One row per topic with its first words joined; used for codebooks as well."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return words.filter(F.col("rank") <= n).groupBy("topic").agg(
        F.array_join(F.transform(rows, lambda r: r["term"]), " ").alias("label"))


def u_mass(df: DataFrame, key: str, words: DataFrame, tokens: str = "tokens") -> DataFrame:
    """U_Mass coherence per topic from document co-occurrence counts.

    Only pairs of top words of one topic are formed, at most n(n-1)/2 per topic. Other
    words leave a document where it lies.
    """
    eps = fixed.INFERENCE_EPS
    top = checkpoint(words.select("topic", "rank", "term"))
    terms = sorted({r["term"] for r in top.collect() if r["term"] is not None})  # topics x top words
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    present = df.select(key, F.explode(F.array_intersect(tokens, wanted)).alias("term"))
    single = present.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    ranked = present.join(top, "term").groupBy(key, "topic").agg(
        F.sort_array(F.collect_list("rank")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(
        F.filter("r", lambda b: b < a), lambda b: F.struct(a.alias("hi"), b.alias("lo")))))
    both = ranked.select("topic", F.explode(pairs).alias("p")).groupBy("topic", "p.hi", "p.lo").agg(
        F.count(F.lit(1)).alias("d2"))
    a = top.select("topic", F.col("rank").alias("hi"))
    b = top.join(single, "term").select("topic", F.col("rank").alias("lo"), "d")
    n = df.agg(F.count(F.lit(1))).scalar()
    score = F.log((F.coalesce("d2", F.lit(0)) / F.col("n") + eps) / (F.col("d") / F.col("n")))
    return (
        a.join(b, "topic").filter("lo < hi").join(both, ["topic", "hi", "lo"], "left")
        .withColumn("n", n).groupBy("topic").agg(F.avg(score).alias("u_mass")))


def c_v(df: DataFrame, words: DataFrame, tokens: str = "tokens", window: int = 110) -> DataFrame:
    """C_V coherence per topic: cosine of NPMI vectors from sliding windows.

    Tasks count, per topic, the windows that hold each pair of its top words;
    the counts are summed by Spark and the small matrices scored at the end.
    """
    rows = words.orderBy("topic", "rank").collect()  # topics x top words
    topics: dict[int, list[str]] = {}
    for r in rows:
        topics.setdefault(r["topic"], []).append(r["term"])
    shared = df.sparkSession.sparkContext.broadcast(topics)

    def count(batches):
        lists = shared.value
        where: dict[str, list[tuple[int, int]]] = {}
        for t, terms in lists.items():
            for i, w in enumerate(terms):
                where.setdefault(w, []).append((t, i))
        for batch in batches:
            total = 0
            sums = {t: np.zeros((len(w), len(w))) for t, w in lists.items()}
            for doc in batch["tokens"]:
                n = max(1, len(doc) - window + 1)
                total += n
                seen: dict[int, dict[int, np.ndarray]] = {}
                for at, word in enumerate(doc):
                    for t, i in where.get(word, ()):
                        flags = seen.setdefault(t, {}).setdefault(i, np.zeros(n, dtype=np.float32))
                        flags[max(0, at - window + 1):at + 1] = 1
                for t, flags in seen.items():
                    index = sorted(flags)
                    m = np.stack([flags[i] for i in index])
                    sums[t][np.ix_(index, index)] += m @ m.T
            out = [(-1, 0, 0, float(total))]
            for t, m in sums.items():
                i, j = np.nonzero(m)
                out += [(t, int(a), int(b), float(m[a, b])) for a, b in zip(i, j)]
            yield pd.DataFrame(out, columns=["topic", "i", "j", "n"])

    counts = (
        df.select(F.col(tokens).alias("tokens")).mapInPandas(count, "topic int, i int, j int, n double")
        .groupBy("topic", "i", "j").agg(F.sum("n").alias("n")))
    size = counts.filter("topic = -1").agg(F.max("n")).scalar()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        t, total = int(pdf["topic"].iloc[0]), float(pdf["total"].iloc[0])
        k = len(shared.value[t])
        p = np.zeros((k, k))
        p[pdf["i"], pdf["j"]] = pdf["n"] / total
        single = np.diag(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log((p + 1e-12) / np.outer(single, single))
            npmi = np.where(np.outer(single, single) > 0, pmi / -np.log(p + 1e-12), 0.0)
        whole = npmi.sum(axis=0)
        size = np.linalg.norm(npmi, axis=1) * np.linalg.norm(whole)
        cosine = np.divide(npmi @ whole, size, out=np.zeros(k), where=size > 0)
        return pd.DataFrame({"topic": [t], "c_v": [cosine.mean()]})

    return (
        counts.filter("topic >= 0").withColumn("total", size)
        .groupBy("topic").applyInPandas(score, "topic int, c_v double"))


def topic_vectors(topic_words: DataFrame, word_vectors: DataFrame, dim: int, n: int = 50) -> DataFrame:
    """Unit vector of each topic: probability-weighted mean of its top words' vectors."""
    known = top_words(topic_words, n).join(word_vectors.select("term", "v"), "term")
    p = F.col("p")
    total = F.array(*[F.sum(p * F.get("v", F.lit(i))) / F.sum(p) for i in range(dim)])
    return known.groupBy("topic").agg(total.alias("v")).withColumn("v", vec.normalize(F.col("v")))


def representative_documents(theta: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The documents with the highest share of each topic."""
    return top_per_key(long_theta(theta, key, 0.0), ["topic"], [F.desc("prob"), key], n, rank="rank")


def keyword_profile(topic_words: DataFrame, theta: DataFrame, n_words: int = 30, n_label: int = 10) -> DataFrame:
    """Per topic: label words, all profile words and the mean share over documents."""
    words = top_words(topic_words, n_words)
    means = theta.select(F.posexplode("theta").alias("topic", "prob")).groupBy("topic").agg(
        F.avg("prob").alias("mean_prob"))
    return (
        topic_labels(words, n_label).withColumnRenamed("label", "top_keywords")
        .join(topic_labels(words, n_words).withColumnRenamed("label", "all_keywords"), "topic")
        .join(means, "topic"))


def topic_panel(
    theta: DataFrame, key: str, window: str, unified: DataFrame, min_prob: float = fixed.PANEL_MIN_PROB
) -> DataFrame:
    """One row per posting and topic of some weight, with the unified topic id.

    `theta` carries the posting's columns; topics without a chain keep a name of
    their own.
    """
    rows = theta.select(
        *[c for c in theta.columns if c != "theta"], F.posexplode("theta").alias("topic", "topic_proportion"))
    own = F.concat_ws("_", F.col(window).cast("string"), F.col("topic").cast("string"))
    return (
        rows.filter(F.col("topic_proportion") >= min_prob).join(unified, [window, "topic"], "left")
        .withColumn("unified_topic_id", F.coalesce(F.col("unified_topic_id"), own)))


def coherence_grid(df: DataFrame, fits: dict[int, DataFrame], key: str, tokens: str = "tokens", n: int = 10) -> DataFrame:
    """Mean U_Mass per number of topics for already fitted topic-word tables."""
    out = None
    for k, topic_words in fits.items():
        row = u_mass(df, key, top_words(topic_words, n), tokens).agg(
            F.lit(k).alias("k"), F.avg("u_mass").alias("u_mass"))
        out = row if out is None else out.unionByName(row)
    return out
