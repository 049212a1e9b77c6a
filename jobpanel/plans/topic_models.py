"""Topic inference, metrics on topic shares, vectors and topic evolution."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import theta as metrics, vec
from ..operators import evolution, models, panel, ranks, topics, vectors
from ..session import checkpoint
from ..sources import views
from ..sources.views import CENTROIDS, K_THETA, K_TOPICS, THETA, TOPIC_WORDS, table
from .panels import PROFILES, rounded, skill_words
from .registry import query

ALPHA = [(k + 1) / 36 for k in range(K_TOPICS)]
NOISE = 7


def _inferred(k: int, noise: int | None) -> str:
    """CTE `shares` (id, k, p): folding-in over the first k topics."""
    keep = "1 = 1" if noise is None else f"k <> {noise}"
    return f"""known AS (
  SELECT id, tw.k, tw.p FROM (SELECT id, unnest(tokens) AS term FROM toks) t JOIN topic_word tw ON tw.term = t.term WHERE tw.k < {k}),
scores AS (
  SELECT id, k, avg(ln(p + 1e-12)) + ln((k + 1) / 36 + 1e-12) AS s FROM known GROUP BY id, k HAVING count(*) >= 5),
powers AS (SELECT id, k, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM scores),
masked AS (SELECT id, k, CASE WHEN {keep} THEN e ELSE 0 END AS e FROM powers),
shares AS (SELECT id, k, e / sum(e) OVER (PARTITION BY id) AS p FROM masked)"""


INFERRED = TOPIC_WORDS + ", " + _inferred(K_TOPICS, NOISE)


def topic_table(spark, folder, rows=None):
    return checkpoint(views.topic_words(spark, folder, rows))


def inferred(spark, folder, words=None):
    """Shares of every document; tokens and model are tables of their own."""
    rows = checkpoint(views.token_docs(spark, folder).select("id", "tokens"))
    words = topic_table(spark, folder, rows) if words is None else words
    return topics.infer(rows, "id", words, ALPHA, [NOISE])


@query("mdl2_inference", f"WITH {INFERRED} SELECT id, CAST(k AS INTEGER) AS k, round(p, 6) AS p FROM shares")
def inference(spark, folder):
    return rounded(inferred(spark, folder).select("id", F.posexplode("theta").alias("k", "p")))


_JSD = """jsd AS (
  SELECT a.k AS i, b.k AS j, 0.5 * sum(a.p * ln(a.p / ((a.p + b.p) * 0.5 + 1e-12) + 1e-12) + b.p * ln(b.p / ((a.p + b.p) * 0.5 + 1e-12) + 1e-12)) AS d
  FROM topic_word a JOIN topic_word b ON a.term = b.term GROUP BY a.k, b.k)"""


@query("mdl3_divergence", f"WITH {TOPIC_WORDS}, {_JSD} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(d, 6) AS jsd FROM jsd WHERE i < j")
def divergence(spark, folder):
    return rounded(topics.divergence(views.topic_words(spark, folder), K_TOPICS))


@query("mdl4_top_words", f"""
WITH {TOPIC_WORDS} SELECT CAST(k AS INTEGER) AS topic, string_agg(term, ' ' ORDER BY rn) AS label FROM (
  SELECT k, term, row_number() OVER (PARTITION BY k ORDER BY round(p, 12) DESC, term) AS rn FROM topic_word) WHERE rn <= 5 GROUP BY k""")
def top_words(spark, folder):
    words = views.topic_words(spark, folder).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    return topics.topic_labels(topics.top_words(words, 20), 5)


_TOP10 = """top10 AS (
  SELECT k, term, row_number() OVER (PARTITION BY k ORDER BY round(p, 12) DESC, term) AS rn FROM topic_word QUALIFY rn <= 10)"""


@query("mdl5_u_mass", f"""
WITH {TOPIC_WORDS}, {_TOP10}, dt AS (SELECT id, term FROM doc_terms WHERE term IN (SELECT term FROM top10)),
d1 AS (SELECT term, count(*) AS d FROM dt GROUP BY term), nd AS (SELECT count(*) AS n FROM toks),
d2 AS (SELECT a.k, a.rn AS hi, b.rn AS lo, count(*) AS d FROM top10 a JOIN top10 b ON a.k = b.k AND b.rn < a.rn
  JOIN dt x ON x.term = a.term JOIN dt y ON y.term = b.term AND y.id = x.id GROUP BY 1, 2, 3)
SELECT CAST(a.k AS INTEGER) AS topic, round(avg(ln((coalesce(d2.d, 0) / n + 1e-12) / (d1.d / n))), 6) AS u_mass
FROM top10 a JOIN top10 b ON a.k = b.k AND b.rn < a.rn JOIN d1 ON d1.term = b.term LEFT JOIN d2 ON d2.k = a.k AND d2.hi = a.rn AND d2.lo = b.rn, nd GROUP BY a.k""")
def u_mass(spark, folder):
    words = views.topic_words(spark, folder).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    return rounded(topics.u_mass(views.token_docs(spark, folder), "id", checkpoint(topics.top_words(words, 10))))


@query("mdl5_c_v")
def c_v(spark, folder):
    words = checkpoint(topics.top_words(views.topic_words(spark, folder), 10))
    return rounded(topics.c_v(views.token_docs(spark, folder), words), 4)


def _yearly(k: int) -> str:
    return f"""SELECT {k} AS k, "year", avg(h) AS m FROM (
  SELECT id, -sum(p * ln(p + 1e-12)) / ln({k}) AS h FROM shares{k} GROUP BY id) JOIN toks USING (id) GROUP BY "year" """


_TWO_K = ", ".join(
    _inferred(k, None).replace("known", f"known{k}").replace("scores", f"scores{k}").replace("powers", f"powers{k}")
    .replace("masked", f"masked{k}").replace("shares", f"shares{k}") for k in (4, 8))


@query("mdl6_k_sensitivity", f"""
WITH {TOPIC_WORDS}, {_TWO_K}, y AS ({_yearly(4)} UNION ALL {_yearly(8)})
SELECT k, round(avg(m), 6) AS mean_entropy, round(regr_slope(m, "year"), 8) AS slope, count(*) AS n_years FROM y GROUP BY k""")
def k_sensitivity(spark, folder):
    words = topic_table(spark, folder)
    docs = views.token_docs(spark, folder)
    out = None
    for k in (4, 8):
        part = words.withColumn("p", F.slice("p", 1, k))
        theta = topics.infer(docs, "id", part, ALPHA[:k])
        yearly = theta.withColumn("h", metrics.entropy(F.col("theta"), k)).join(
            docs.select("id", "year"), "id").groupBy("year").agg(F.avg("h").alias("m"))
        row = yearly.agg(
            F.lit(k).alias("k"), F.round(F.avg("m"), 6).alias("mean_entropy"),
            F.round(F.regr_slope("m", "year"), 8).alias("slope"), F.count(F.lit(1)).alias("n_years"))
        out = row if out is None else out.unionByName(row)
    return out


@query("mdl8_topic_vectors", f"""
WITH {TOPIC_WORDS}, top50 AS (SELECT k, term, rank, p, row_number() OVER (PARTITION BY k ORDER BY round(p, 12) DESC, term) AS rn FROM topic_word QUALIFY rn <= 50),
v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
s AS (SELECT k, i, sum(p * CAST(x AS DOUBLE)) / sum(p) AS x FROM top50 JOIN v ON v.vec_id = rank GROUP BY k, i)
SELECT CAST(k AS INTEGER) AS topic, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 6) AS x FROM s""")
def topic_vectors(spark, folder):
    words = topic_table(spark, folder).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    word_vectors = words.select("term", F.col("rank").cast("bigint").alias("id")).join(
        views.vectors(spark, folder).select("id", "v"), "id")
    out = topics.topic_vectors(words, word_vectors, 64)
    return rounded(out.select("topic", F.posexplode("v").alias("i", "x")))


# --- evolution --------------------------------------------------------------------------------


def centroids(spark, folder):
    return checkpoint(views.topic_centroids(spark, folder).withColumnRenamed("win", "window").withColumn(
        "window", F.col("window").cast("bigint")))


@query("jon11_window_cosines", f"WITH {CENTROIDS} SELECT CAST(window_from AS BIGINT) AS window_from, CAST(window_to AS BIGINT) AS window_to, source, target, round(sim, 6) AS sim FROM cosines")
def window_cosines(spark, folder):
    return rounded(vectors.adjacent_cosines(centroids(spark, folder), "window", "topic"))


def _events(spark, folder):
    base = centroids(spark, folder)
    sims = vectors.adjacent_cosines(base, "window", "topic")
    return base, evolution.align(sims, 0.2, 0.1)


@query("mdl9_merge_topics")
def merge_topics(spark, folder):
    base = centroids(spark, folder)
    return evolution.merge_topics(base, evolution.topic_pairs(base), threshold=0.2, min_topics=3)


@query("udf3_grouped_alignment")
def grouped_alignment(spark, folder):
    """Alignment function run once per window pair; events per pair and kind."""
    return _events(spark, folder)[1].groupBy("window_from", "window_to", "event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("mdl10_merged_vectors")
def merged_vectors(spark, folder):
    base = centroids(spark, folder)
    mapping = checkpoint(evolution.merge_topics(base, evolution.topic_pairs(base), threshold=0.2, min_topics=3))
    return evolution.merged_vectors(base, mapping, K_THETA).select(
        "window", "merged", "n_topics", F.round(vec.norm(F.col("v")), 6).alias("size"))


@query("mdl10_reduction_report")
def reduction_report(spark, folder):
    base = centroids(spark, folder)
    mapping = evolution.merge_topics(base, evolution.topic_pairs(base), threshold=0.2, min_topics=3)
    return rounded(evolution.reduction_report(mapping))


@query("mdl10_merged_labels", f"""
WITH {views.TOPIC_WORDS}, w AS (SELECT k % 2 AS win, k AS topic, term, p AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(p, 12) DESC, term) AS rn FROM topic_word) WHERE rn <= 5),
s AS (SELECT win, topic // 4 AS merged, term, sum(weight) AS weight FROM w GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY win, merged ORDER BY round(weight, 9) DESC, term) AS rn FROM s)
SELECT CAST(win AS BIGINT) AS "window", CAST(merged AS BIGINT) AS merged, 'Merged_' || merged || ': ' || string_agg(term, ' ' ORDER BY rn) AS label FROM t WHERE rn <= 3 GROUP BY win, merged""")
def merged_labels(spark, folder):
    words = views.topic_words(spark, folder).withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    top = topics.top_words(words, 5).select(
        (F.col("topic") % 2).cast("bigint").alias("window"), "topic", "term", F.round("p", 12).alias("weight"))
    mapping = top.select("window", "topic").distinct().withColumn(
        "merged", F.floor(F.col("topic") / 4).cast("bigint"))
    return evolution.merged_labels(top, mapping)


@query("mdl11_alignment")
def alignment(spark, folder):
    return rounded(_events(spark, folder)[1].withColumns({
        "source_topics": F.array_join(F.col("source_topics").cast("array<string>"), ","),
        "target_topics": F.array_join(F.col("target_topics").cast("array<string>"), ",")}))


# events of the view: every part is an event between two of five windows
EVENTS = """ev AS (
  SELECT 'w' || (p_size % 4) AS window_from, 'w' || (p_size % 4 + 1) AS window_to,
    CASE WHEN p_partkey % 10 < 7 THEN 'survival' WHEN p_partkey % 10 = 7 OR p_partkey % 50 = 8 THEN 'merge' ELSE 'split' END AS event_type,
    CAST(p_partkey % 12 AS INTEGER) AS source, CAST((p_partkey * 5) % 12 AS INTEGER) AS target, p_retailprice / 10000 AS similarity FROM part)"""


def part_events(spark, folder):
    k = F.col("p_partkey")
    kind = F.when(k % 10 < 7, "survival").when((k % 10 == 7) | (k % 50 == 8), "merge").otherwise("split")
    one = F.array((k % 12).cast("int"))
    return table(spark, folder, "part").select(
        F.concat(F.lit("w"), (F.col("p_size") % 4).cast("string")).alias("window_from"),
        F.concat(F.lit("w"), (F.col("p_size") % 4 + 1).cast("string")).alias("window_to"),
        kind.alias("event_type"), one.alias("source_topics"), F.array(((k * 5) % 12).cast("int")).alias("target_topics"),
        (F.col("p_retailprice") / 10000).alias("similarity"), F.lit(1).alias("topic_count"))


@query("mdl12_event_rates", f"""
WITH {EVENTS} SELECT window_from, window_to, count(*) AS total_events, {", ".join(f"round(avg(CAST(event_type = '{k}' AS INTEGER)), 6) AS {k}_rate" for k in ("survival", "split", "merge"))}
FROM ev GROUP BY window_from, window_to""")
def event_rates(spark, folder):
    return rounded(evolution.event_rates(part_events(spark, folder)))


@query("mdl12_event_statistics", f"WITH {EVENTS} SELECT event_type, count(*) AS n, round((SELECT avg(CAST(event_type = 'survival' AS INTEGER)) FROM ev), 6) AS overall_survival_rate FROM ev GROUP BY event_type")
def event_statistics(spark, folder):
    return rounded(evolution.event_statistics(part_events(spark, folder)))


_INDEX = EVENTS + """,
ix AS (SELECT window_from, window_to, count(*) AS total, count(*) FILTER (event_type = 'merge') AS merges, count(*) FILTER (event_type = 'split') AS splits,
  (count(*) FILTER (event_type = 'merge') - count(*) FILTER (event_type = 'split')) / count(*) AS integration_index,
  avg(CAST(event_type = 'survival' AS INTEGER)) AS survival_rate FROM ev GROUP BY 1, 2)"""


@query("mdl13_integration_index", f"""
WITH {_INDEX}, t AS (SELECT regr_slope(integration_index, rn) AS trend FROM (SELECT integration_index, row_number() OVER (ORDER BY window_from) - 1 AS rn FROM ix))
SELECT window_from, window_to, total, merges, splits, round(integration_index, 6) AS integration_index, round(survival_rate, 6) AS survival_rate, round(trend, 6) AS trend FROM ix, t""")
def integration_index(spark, folder):
    index = evolution.integration_index(part_events(spark, folder))
    return rounded(index.withColumn("trend", evolution.integration_trend(index).scalar()))


@query("mdl14_unified_topics")
def unified_topics(spark, folder):
    base, events = _events(spark, folder)
    return evolution.unified_topics(base, events)


@query("mdl15_flow_links", f"""
WITH {EVENTS}, tp AS (SELECT 'w' || w AS win, CAST(t AS INTEGER) AS topic FROM range(5) a(w), range(13) b(t)),
prs AS (SELECT DISTINCT window_from, window_to FROM ev)
SELECT window_from, window_to, source, target, round(similarity * 100, 6) AS value, event_type AS kind FROM ev
UNION ALL SELECT p.window_from, p.window_to, topic, NULL, 50.0, 'death' FROM prs p JOIN tp ON win = p.window_from WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.window_from = p.window_from AND e.source = topic)
UNION ALL SELECT p.window_from, p.window_to, NULL, topic, 50.0, 'birth' FROM prs p JOIN tp ON win = p.window_to WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.window_to = p.window_to AND e.target = topic)""")
def flow_links(spark, folder):
    windows = spark.createDataFrame([(f"w{w}", t) for w in range(5) for t in range(13)], "window string, topic int")
    return rounded(evolution.flow_links(windows, part_events(spark, folder)))


# --- vectors ------------------------------------------------------------------------------------

_VEC = """q AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
qn AS (SELECT id, sqrt(sum(x * x)) AS size FROM q GROUP BY id),
r AS (SELECT win * 12 + topic AS id, i, x FROM cells), rn AS (SELECT win * 12 + topic AS id, size FROM sizes),
sims AS (SELECT q.id, r.id AS nb, sum(q.x * r.x) / (any_value(qn.size) * any_value(rn.size)) AS sim
  FROM q JOIN r ON q.i = r.i JOIN qn ON qn.id = q.id JOIN rn ON rn.id = r.id GROUP BY q.id, r.id),
nearest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nb) AS rank FROM sims)"""


def references(spark, folder):
    return views.topic_centroids(spark, folder).select(
        (F.col("win") * 12 + F.col("topic")).cast("bigint").alias("id"), "v")


@query("jon9_nearest_vectors", f"WITH {CENTROIDS}, {_VEC} SELECT id, CAST(nb AS BIGINT) AS neighbour, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM nearest WHERE rank <= 3")
def nearest_vectors(spark, folder):
    return rounded(vectors.nearest(views.vectors(spark, folder), references(spark, folder), 3))


@query("jon9_above_threshold", f"WITH {CENTROIDS}, {_VEC} SELECT id, CAST(nb AS BIGINT) AS label, round(sim, 6) AS sim FROM sims WHERE sim > 0.5")
def above_threshold(spark, folder):
    return rounded(vectors.above_threshold(views.vectors(spark, folder), references(spark, folder)))


@query("mdl21_exposure_score", f"""
WITH {CENTROIDS}, {_VEC} SELECT id, round(sum(sim * (nb / 60.0)) / sum(sim), 6) AS jd_ai_score, CAST(max(CASE WHEN rank = 1 THEN nb END) AS BIGINT) AS top1_code,
  round(max(CASE WHEN rank = 1 THEN sim END), 6) AS top1_sim FROM nearest WHERE rank <= 5 GROUP BY id""")
def exposure_score(spark, folder):
    right = references(spark, folder)
    scores = right.select("id", (F.col("id") / 60.0).alias("score"))
    return rounded(vectors.exposure_score(views.vectors(spark, folder), right, scores, 5))


AUTO = [float((j * 5) % 7 + 1) for j in range(64)]
AUG = [float((j * 3) % 5 + 1) for j in range(64)]


def _cos(v: list[float]) -> str:
    return f"list_dot_product(theta, {v}::DOUBLE[]) / (sqrt({_HHI}) * {math.sqrt(sum(x * x for x in v))})"


_H = "-list_sum(list_transform(theta, lambda p: p * ln(p + 1e-12)))"
_HHI = "list_sum(list_transform(theta, lambda p: p * p))"


@query("mdl22_automation_split", f"""
WITH {THETA}, s AS (SELECT id, {_cos(AUTO)} AS a, {_cos(AUG)} AS g, label / 10.0 AS score FROM theta)
SELECT id, round(a, 6) AS sim_auto, round(g, 6) AS sim_aug, round(a / (a + g), 6) AS share_auto, round(g / (a + g), 6) AS share_aug,
  round(a / (a + g) * score, 6) AS automation_score, round(g / (a + g) * score, 6) AS augmentation_score FROM s""")
def automation_split(spark, folder):
    rows = views.theta(spark, folder).select("id", F.col("theta").alias("v"), (F.col("label") / 10.0).alias("score"))
    return rounded(vectors.automation_split(rows, AUTO, AUG).drop("v", "score"))


CENTERS = [[((i + 1) * (j + 2) % 9 - 4) / 20.0 for j in range(64)] for i in range(3)]
_DIST = "list_sum(list_transform(list_zip(embedding, {c}::DOUBLE[]), lambda t: (t[1]::DOUBLE - t[2]) * (t[1]::DOUBLE - t[2])))"


@query("mdl18_soft_assignment", f"""
WITH d AS (SELECT vec_id AS id, [{", ".join("1.0 / (" + _DIST.format(c=c) + " + 1e-10)" for c in CENTERS)}] AS w FROM embeddings)
SELECT id, CAST(unnest(range(3)) AS INTEGER) AS cluster, round(unnest(list_transform(w, lambda x: x / list_sum(w))), 6) AS weight FROM d""")
def soft_assignment(spark, folder):
    out = vectors.soft_assignment(views.vectors(spark, folder), CENTERS)
    return rounded(out.select("id", F.posexplode("weights").alias("cluster", "weight")))


@query("mdl16_assign_unseen", f"""
WITH d AS (SELECT vec_id AS id, [{", ".join(f"list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), {c}::DOUBLE[]) / {math.sqrt(sum(x * x for x in c))}" for c in CENTERS)}] AS w FROM embeddings)
SELECT id, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS cluster FROM d""")
def assign_unseen(spark, folder):
    return models.assign_by_dot(views.vectors(spark, folder), CENTERS).select("id", "cluster")


_FIRST_LETTER = PROFILES + """,
per AS (SELECT id, CAST(sum(n) AS BIGINT) AS s, count(*) AS b, arg_min(cluster, (-n, cluster)) AS top, CAST(sum(CASE WHEN cluster = 'o' THEN n ELSE 0 END) AS BIGINT) AS ai FROM cl GROUP BY id)"""


@query("mdl20_skill_profile", f"""
WITH {_FIRST_LETTER} SELECT toks.id, CAST(len(tokens) AS INTEGER) AS token_count, coalesce(s, 0) AS skill_token_count, coalesce(b, 0) AS n_skill_clusters, coalesce(top, '') AS top_cluster,
  round(coalesce(s, 0) / len(tokens), 6) AS skill_coverage, round(CASE WHEN s > 0 THEN ai / s ELSE 0 END, 6) AS ai_intensity, CAST(coalesce(ai, 0) > 0 AS INTEGER) AS ai_binary
FROM toks LEFT JOIN per ON per.id = toks.id""")
def skill_profile(spark, folder):
    docs = views.token_docs(spark, folder)
    out = vectors.profile_columns(docs, "id", skill_words(docs), "o")
    return rounded(out.select("id", "token_count", "skill_token_count", "n_skill_clusters", "top_cluster",
                              "skill_coverage", "ai_intensity", "ai_binary"))


@query("mdl20_profile_shares", f"WITH {PROFILES} SELECT id, cluster, round(share, 6) AS share FROM shares")
def profile_shares(spark, folder):
    docs = views.token_docs(spark, folder)
    return rounded(vectors.profile_shares(docs, "id", skill_words(docs)).select("id", "cluster", "share"))


_PAIR_SIMS = """q AS (SELECT vec_id AS id, label % 5 AS g, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
qn AS (SELECT id, sqrt(sum(x * x)) AS size FROM q GROUP BY id),
ps AS (SELECT a.g AS group_from, b.g AS group_to, a.id, b.id AS other, sum(a.x * b.x) / (any_value(na.size) * any_value(nb.size)) AS sim
  FROM q a JOIN q b ON b.g = a.g + 1 AND a.i = b.i JOIN qn na ON na.id = a.id JOIN qn nb ON nb.id = b.id GROUP BY 1, 2, 3, 4)"""


@query("mdl23_drift_moments", f"WITH {_PAIR_SIMS} SELECT CAST(group_from AS INTEGER) AS group_from, CAST(group_to AS INTEGER) AS group_to, round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity FROM ps GROUP BY 1, 2")
def drift_moments(spark, folder):
    rows = views.vectors(spark, folder).withColumn("g", F.col("label") % 5)
    return rounded(vectors.similarity_moments(rows, "g", K_THETA))


@query("mdl23_drift_percentiles", f"""
WITH {_PAIR_SIMS}, m AS (SELECT g, i, avg(x) AS x FROM q GROUP BY g, i), mn AS (SELECT g, sqrt(sum(x * x)) AS size FROM m GROUP BY g),
s AS (SELECT q.g AS group_from, m.g AS group_to, q.id, sum(q.x * m.x) / (any_value(qn.size) * any_value(mn.size)) AS sim
  FROM q JOIN m ON m.g = q.g + 1 AND m.i = q.i JOIN qn ON qn.id = q.id JOIN mn ON mn.g = m.g GROUP BY 1, 2, 3)
SELECT CAST(group_from AS INTEGER) AS group_from, CAST(group_to AS INTEGER) AS group_to, count(*) AS n, round(quantile_cont(sim, 0.25), 6) AS p25,
  round(quantile_cont(sim, 0.75), 6) AS p75, round(quantile_cont(sim, 0.9), 6) AS p90, round(max(sim), 6) AS max, round(min(sim), 6) AS min FROM s GROUP BY 1, 2""")
def drift_percentiles(spark, folder):
    """Percentiles of the rows' cosines with the centroid of the next window."""
    rows = views.vectors(spark, folder).withColumn("g", F.col("label") % 5)
    sims = checkpoint(vectors.centroid_similarities(rows, "g", K_THETA))
    keys = ["group_from", "group_to"]
    picks = ranks.exact_quantiles(sims, keys, {"p25": ("sim", 0.25), "p75": ("sim", 0.75), "p90": ("sim", 0.9)})
    rest = sims.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("sim").alias("max"), F.min("sim").alias("min"))
    return rounded(rest.join(picks, keys))


@query("mdl23_shifted_share", f"""
WITH {_PAIR_SIMS}, b AS (SELECT group_from, group_to, id, max(sim) AS sim FROM ps GROUP BY 1, 2, 3)
SELECT CAST(group_from AS INTEGER) AS group_from, CAST(group_to AS INTEGER) AS group_to, count(*) FILTER (sim < 0.3) AS n_shifted, count(*) AS n,
  round(avg(CAST(sim < 0.3 AS INTEGER)) * 100, 6) AS shifted_percentage, round(avg(sim), 6) AS avg_max_similarity, round(min(sim), 6) AS min_max_similarity FROM b GROUP BY 1, 2""")
def shifted_share(spark, folder):
    rows = views.vectors(spark, folder).withColumn("g", F.col("label") % 5)
    return rounded(vectors.shifted_share(rows, "g"))


@query("mdl23_centroid_matches", f"""
WITH {CENTROIDS} SELECT CAST(window_from AS BIGINT) AS window_from, CAST(window_to AS BIGINT) AS window_to, source, arg_min(target, (-sim, target)) AS best_match, round(max(sim), 6) AS best_similarity,
  arg_min(target, (sim, target)) AS worst_match, round(min(sim), 6) AS worst_similarity FROM cosines GROUP BY 1, 2, 3""")
def centroid_matches(spark, folder):
    return rounded(vectors.centroid_matches(vectors.adjacent_cosines(centroids(spark, folder), "window", "topic")))


@query("mdl26_long_theta", f"WITH {INFERRED} SELECT id, CAST(k AS INTEGER) AS topic, round(p, 6) AS prob FROM shares WHERE p >= 0.01")
def long_theta(spark, folder):
    return rounded(topics.long_theta(inferred(spark, folder), "id"))


@query("mdl26_keyword_profile", f"""
WITH {INFERRED}, w AS (SELECT k, term, row_number() OVER (PARTITION BY k ORDER BY round(p, 12) DESC, term) AS rn FROM topic_word),
m AS (SELECT k, avg(p) AS m FROM shares GROUP BY k)
SELECT CAST(w.k AS INTEGER) AS topic, string_agg(term, ' ' ORDER BY rn) FILTER (rn <= 10) AS top_keywords, string_agg(term, ' ' ORDER BY rn) FILTER (rn <= 30) AS all_keywords,
  round(any_value(m.m), 6) AS mean_prob FROM w JOIN m ON m.k = w.k GROUP BY w.k""")
def keyword_profile(spark, folder):
    words = topic_table(spark, folder)
    flat = words.withColumn("p", F.transform("p", lambda x: F.round(x, 12)))
    return rounded(topics.keyword_profile(flat, inferred(spark, folder, words)))


@query("mdl26_representative_documents", f"""
WITH {INFERRED} SELECT CAST(k AS INTEGER) AS topic, id, CAST(row_number() OVER (PARTITION BY k ORDER BY round(p, 9) DESC, id) AS INTEGER) AS rank FROM shares QUALIFY rank <= 3""")
def representative_documents(spark, folder):
    theta = inferred(spark, folder).withColumn("theta", F.transform("theta", lambda x: F.round(x, 9)))
    return topics.representative_documents(theta, "id").select("topic", "id", "rank")


@query("mdl27_topic_panel", f"""
WITH {INFERRED} SELECT s.id, CAST(k AS INTEGER) AS topic, round(p, 6) AS topic_proportion, lang, CASE WHEN k % 3 = 0 THEN 'skill_' || k ELSE "year" || '_' || k END AS unified_topic_id
FROM shares s JOIN toks ON toks.id = s.id WHERE p >= 0.05""")
def topic_panel(spark, folder):
    theta = inferred(spark, folder).join(views.docs(spark, folder).select("id", "lang", "year"), "id")
    chains = spark.createDataFrame(
        [(y, k, f"skill_{k}") for y in range(2016, 2026) for k in range(0, K_TOPICS, 3)], "year int, topic int, unified_topic_id string")
    return rounded(topics.topic_panel(theta, "id", "year", chains).select(
        "id", "topic", "topic_proportion", "lang", "unified_topic_id"))


# --- metrics on shares -------------------------------------------------------------------------------

def _metric(name: str, column, sql: str) -> None:
    @query(name, f"WITH {THETA} SELECT id, {sql} AS value FROM theta")
    def run(spark, folder):
        return rounded(views.theta(spark, folder).select("id", column(F.col("theta")).alias("value")))


_metric("met1_entropy", lambda t: metrics.entropy(t, K_THETA), f"round({_H} / ln(64), 6)")
_metric("met2_hhi", metrics.hhi, f"round({_HHI}, 6)")
_metric("met2_diversification", lambda t: metrics.diversification(t, K_THETA), f"round((1 - {_HHI}) / (1 - 1 / 64::DOUBLE), 6)")
_metric("met3_dominant_topic", metrics.dominant_topic, "CAST(list_position(theta, list_max(theta)) - 1 AS INTEGER)")
_metric("met3_dominant_share", metrics.dominant_share, "round(list_max(theta), 6)")
_metric("met4_effective_topics", metrics.effective_topics, f"round(exp({_H}), 6)")
_metric("met6_gini", metrics.gini, """round((2 * list_sum(list_transform(list_zip(list_sort(theta), range(1, 65)), lambda t: t[1] * t[2]))
  - 65 * list_sum(theta)) / (64 * list_sum(theta)), 6)""")
_metric("met7_significant_topics", lambda t: metrics.significant_topics(t, K_THETA), "CAST(len(list_filter(theta, lambda p: p > 1 / 64::DOUBLE)) AS INTEGER)")
_metric("met7_tail_mass", metrics.tail_mass, "round(1 - list_sum(list_slice(list_reverse_sort(theta), 1, 3)), 6)")
_metric("met9_skill_entropy", lambda t: metrics.skill_entropy(t, K_THETA),
        "round(-list_sum(list_transform(theta, lambda s: s / (list_sum(theta) + 1e-10) * ln(s / (list_sum(theta) + 1e-10) + 1e-10))) / ln(64), 6)")
_metric("met13_effective_domains", lambda t: metrics.effective_domains(metrics.entropy(t, K_THETA), K_THETA), f"round(pow(64, {_H} / ln(64)), 6)")


@query("met5_rao_q", f"""
WITH {INFERRED}, {_JSD} SELECT a.id, round(sum(a.p * b.p * CASE WHEN a.k = b.k THEN 0 ELSE d END), 6) AS rao_q
FROM shares a JOIN shares b ON a.id = b.id JOIN jsd ON i = a.k AND j = b.k GROUP BY a.id""")
def rao_q(spark, folder):
    words = topic_table(spark, folder)
    matrix = topics.divergence_matrix(words, K_TOPICS)
    return rounded(inferred(spark, folder, words).select("id", metrics.rao_q(F.col("theta"), matrix).alias("rao_q")))


@query("met_all_metrics", f"""
WITH {INFERRED}, h AS (SELECT id, -sum(p * ln(p + 1e-12)) AS h, sum(p * p) AS hhi, max(p) AS top FROM shares GROUP BY id)
SELECT "year", count(*) AS n, round(avg(h / ln(8)), 6) AS entropy_score, round(avg(hhi), 6) AS hhi_score, round(avg(top), 6) AS dominant_topic_prob, round(avg(exp(h)), 6) AS ent_effective
FROM h JOIN toks USING (id) GROUP BY "year" """)
def all_metrics(spark, folder):
    columns = metrics.metric_columns(F.col("theta"), K_TOPICS)
    rows = inferred(spark, folder).select("id", *[c.alias(n) for n, c in columns.items()]).join(
        views.docs(spark, folder).select("id", "year"), "id")
    names = ["entropy_score", "hhi_score", "dominant_topic_prob", "ent_effective"]
    return rounded(rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names]))


_INDEX_SQL = """list_sum(list_transform(theta, lambda p: (p + 1e-10) * ln(p + 1e-10))) / -ln(64)"""


@query("met8_combined_index", f"""
WITH {THETA}, c AS (SELECT win, ({_INDEX_SQL} + (1 - {_HHI}) / (1 - 1 / 64::DOUBLE)) / 2 AS x FROM theta)
SELECT win, count(*) AS n, round(avg(x), 6) AS lda_mean, round(stddev_samp(x), 6) AS lda_std FROM c GROUP BY win""")
def combined_index(spark, folder):
    rows = views.theta(spark, folder).withColumn("x", metrics.combined_index(F.col("theta"), K_THETA))
    return rounded(rows.groupBy("win").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("lda_mean"), F.stddev_samp("x").alias("lda_std")))


@query("met10_profile_entropy", f"WITH {PROFILES} SELECT id, round(-sum(share * log2(share)), 6) + 0.0::DOUBLE AS entropy FROM shares GROUP BY id")
def profile_entropy(spark, folder):
    docs = views.token_docs(spark, folder)
    shares = vectors.profile_shares(docs, "id", skill_words(docs))
    return rounded(shares.groupBy("id").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy")))


@query("met11_agreement", f"""
WITH {THETA}, w AS (SELECT win, avg({_H} / ln(64)) AS a, avg({_HHI}) AS b FROM theta GROUP BY win),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM w)
SELECT round(corr(a, b), 6) AS pearson_r, round(corr(ra, rb), 6) AS spearman_r, count(*) AS n FROM r""")
def agreement(spark, folder):
    rows = views.theta(spark, folder).groupBy("win").agg(
        F.avg(metrics.entropy(F.col("theta"), K_THETA)).alias("a"), F.avg(metrics.hhi(F.col("theta"))).alias("b"))
    return rounded(panel.agreement(rows, "a", "b"))


@query("met12_margins", f"""
WITH {THETA}, m AS (SELECT win, k, avg(p) AS p FROM long GROUP BY win, k),
b AS (SELECT a.win, a.k, a.p, n.p AS q FROM m a JOIN m n ON n.win = a.win + 1 AND n.k = a.k)
SELECT win, round(sum(p * ln(p)) - sum(q * ln(q)), 6) + 0.0::DOUBLE AS delta_entropy, count(*) FILTER (q > 0.0157 AND NOT p > 0.0157) AS extensive_new, count(*) FILTER (p > 0.0157 AND NOT q > 0.0157) AS extensive_lost,
  round(sum(CASE WHEN p > 0.0157 AND q > 0.0157 THEN p * ln(p) - q * ln(q) ELSE 0 END), 6) + 0.0::DOUBLE AS intensive_delta, count(*) FILTER (q > 0.0157) AS n_active_topics FROM b GROUP BY win""")
def margins(spark, folder):
    return rounded(panel.margin_decomposition(views.theta(spark, folder), "win", 0.0157))
