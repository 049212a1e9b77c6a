"""Aggregations, windows, sorts and set operations on the panel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skills
from ..operators import evolution, lookup, panel, ranks, tokens
from ..sources import views
from ..sources.views import CELLS, DOCS, EXPOSURE, PANEL, POSTINGS, SCORES, TOKENS, table
from .cleaning import r6
from .registry import query
from .texts import _EDU, _YEARS


def rounded(df, digits: int = 6, exact: tuple[str, ...] = ()):
    """All double columns rounded, so that sums in another order compare equal.

    Columns that start with one of `exact` hold short fractions, whose halves fall on
    the rounding edge of few digits; they keep nine.
    """
    return df.select(*[
        F.round(c, 9 if exact and c.startswith(exact) else digits).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes])


# --- aggregations --------------------------------------------------------------------------

_METRICS = ["ent", "eff", "tax"]
_CELL_AGGS = ", ".join(
    f"round(avg({m}), 9) AS mean_{m}, round(median({m}), 9) AS median_{m}, round(stddev_pop({m}), 6) AS sd_{m}"
    for m in _METRICS)


@query("agg1_cell_panel", f"WITH {PANEL} SELECT ind, occ, \"year\", count(*) AS n_jobs, {_CELL_AGGS} FROM panel GROUP BY ind, occ, \"year\"")
def cell_panel(spark, folder):
    return rounded(panel.cell_panel(views.panel(spark, folder), ["ind", "occ", "year"], _METRICS), exact=("mean_", "median_"))


@query("agg1_occupation_panel", f"WITH {PANEL} SELECT occ, \"year\", count(*) AS n_jobs, {_CELL_AGGS} FROM panel GROUP BY occ, \"year\" HAVING count(*) >= 30")
def occupation_panel(spark, folder):
    return rounded(panel.cell_panel(views.panel(spark, folder), ["occ", "year"], _METRICS, 30), exact=("mean_", "median_"))


@query("agg2_partial_sums", f"WITH {PANEL} SELECT occ, \"year\", round(sum(ent), 4) AS total, count(*) AS n FROM panel GROUP BY occ, \"year\"")
def partial_sums(spark, folder):
    return views.panel(spark, folder).groupBy("occ", "year").agg(
        F.round(F.sum("ent"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("agg3_weighted_cluster", """
WITH p AS (SELECT p_size % 10 AS cluster_id, p_brand AS code, p_size / 50.0 AS score, CAST(p_retailprice AS DOUBLE) AS w FROM part),
s AS (SELECT cluster_id, sum(w * score) / sum(w) AS m, median(score) AS md, count(*) AS n FROM p GROUP BY cluster_id),
v AS (SELECT p.cluster_id, sqrt(sum(w * (score - m) * (score - m)) / sum(w)) AS sd FROM p JOIN s USING (cluster_id) GROUP BY p.cluster_id),
c AS (SELECT cluster_id, code, sum(w) AS w FROM p GROUP BY 1, 2),
t AS (SELECT cluster_id, string_agg(code || '(0.50)', '; ' ORDER BY rn) AS codes FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, code) AS rn FROM c) WHERE rn <= 3 GROUP BY cluster_id)
SELECT cluster_id, round(m, 6) AS wmean, round(sd, 6) AS wsd, round(md, 6) AS median, n, codes AS top_codes FROM s JOIN v USING (cluster_id) JOIN t USING (cluster_id)""")
def weighted_cluster(spark, folder):
    rows = table(spark, folder, "part").select(
        (F.col("p_size") % 10).alias("cluster_id"), F.col("p_brand").alias("code"),
        (F.col("p_size") / 50.0).alias("score"), F.col("p_retailprice").alias("w"), F.lit(0.5).alias("shown"))
    stats = panel.weighted_stats(rows, "cluster_id", "score", "w")
    return rounded(stats.join(panel.top_codes(rows, "cluster_id", "code", "w", "shown"), "cluster_id"))


@query("agg4_baseline_features", f"""
WITH {POSTINGS}, p AS (
  SELECT category, platform, TRY_CAST(salary_min AS DOUBLE) AS lo, TRY_CAST(salary_max AS DOUBLE) AS hi, {_EDU} AS edu,
    CAST({_YEARS} AS DOUBLE) AS exp FROM (SELECT *, trim(experience) AS s FROM postings))
SELECT category, platform, round(avg(CASE WHEN lo BETWEEN 500 AND 200000 AND hi BETWEEN 500 AND 200000 THEN (lo + hi) / 2 END), 4) AS mean_salary,
  round(avg(edu), 6) AS mean_edu, round(avg(exp), 6) AS mean_exp,
  count(CASE WHEN lo BETWEEN 500 AND 200000 AND hi BETWEEN 500 AND 200000 THEN 1 END) AS n_salary, count(edu) AS n_edu, count(exp) AS n_exp
FROM p GROUP BY category, platform""")
def baseline_features(spark, folder):
    out = panel.baseline_features(views.postings(spark, folder), ["category", "platform"])
    return out.select("category", "platform", F.round("mean_salary", 4).alias("mean_salary"), r6("mean_edu"),
                      r6("mean_exp"), "n_salary", "n_edu", "n_exp")


@query("agg5_baseline_means", f"WITH {CELLS} SELECT occ, round(avg(ent), 6) AS base_ent, round(avg(salary), 3) AS base_salary FROM cells WHERE \"year\" IN (1995, 1996) GROUP BY occ")
def baseline_means(spark, folder):
    out = panel.baseline_means(views.cells(spark, folder), "occ", [1995, 1996], {"base_ent": "ent", "base_salary": "salary"})
    return out.select("occ", r6("base_ent"), F.round("base_salary", 3).alias("base_salary"))


@query("agg6_yearly_metrics", f"""
WITH {PANEL}, y AS (SELECT ind, "year", count(*) AS sample_n, avg(ent) AS mean_entropy FROM panel GROUP BY ind, "year"),
t AS (SELECT *, CAST(sum(sample_n) OVER (PARTITION BY ind) AS BIGINT) AS total_n FROM y)
SELECT ind, "year", sample_n, round(mean_entropy, 6) AS mean_entropy, CAST(sample_n >= 500 AS INTEGER) AS valid_sample, total_n FROM t WHERE total_n >= 10000""")
def yearly_metrics(spark, folder):
    return rounded(panel.yearly_metrics(views.panel(spark, folder), "ind", {"mean_entropy": "ent"}))


_SCHEME_VALUES = """s AS (SELECT * FROM (VALUES ('a', 'heavy', 'MACHINERY'), ('a', 'heavy', 'AUTOMOBILE'), ('a', 'light', 'FURNITURE'),
  ('b', 'home', 'HOUSEHOLD'), ('b', 'home', 'FURNITURE'), ('b', 'work', 'BUILDING')) t(scheme, grp, ind))"""


@query("agg7_scheme_regroup", f"""
WITH {CELLS}, {_SCHEME_VALUES}
SELECT scheme, "year", grp AS "group", round(sum(ent * n_jobs) / sum(n_jobs), 6) AS mean_value, CAST(sum(n_jobs) AS BIGINT) AS n
FROM cells JOIN s USING (ind) GROUP BY scheme, "year", grp""")
def scheme_regroup(spark, folder):
    rows = [("a", "heavy", "MACHINERY"), ("a", "heavy", "AUTOMOBILE"), ("a", "light", "FURNITURE"),
            ("b", "home", "HOUSEHOLD"), ("b", "home", "FURNITURE"), ("b", "work", "BUILDING")]
    schemes = spark.createDataFrame(rows, "scheme string, group string, ind string")
    return rounded(panel.regroup(views.cells(spark, folder), schemes, "ind", "ent", "n_jobs"))


@query("agg8_gradient_years", f"""
WITH {PANEL}, {EXPOSURE}, g AS (SELECT p.*, CASE WHEN exposure > 0.52 THEN 'high' WHEN exposure > 0.5 THEN 'middle' ELSE 'low' END AS gradient, exposure
  FROM panel p JOIN exposure e ON e.occ = p.occ WHERE "year" BETWEEN 1995 AND 2001 AND ent > 0)
SELECT "year", gradient, count(*) AS n, round(avg(ent), 6) AS mean_entropy, round(avg(exposure), 6) AS mean_score FROM g GROUP BY "year", gradient""")
def gradient_years(spark, folder):
    e = F.col("exposure")
    rows = views.panel(spark, folder).filter("year between 1995 and 2001 and ent > 0").join(
        views.exposure(spark, folder), "occ").withColumn(
        "gradient", F.when(e > 0.52, "high").when(e > 0.5, "middle").otherwise("low"))
    return rounded(rows.groupBy("year", "gradient").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ent").alias("mean_entropy"), F.avg("exposure").alias("mean_score")))


@query("agg9_company_majority", f"""
WITH {PANEL}, v AS (SELECT company, kind, count(*) AS n FROM panel GROUP BY company, kind)
SELECT company, kind, round(n / sum(n) OVER (PARTITION BY company), 6) AS confidence FROM v
QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, kind) = 1""")
def company_majority(spark, folder):
    return rounded(lookup.majority(views.panel(spark, folder), "company", "kind"))


@query("agg10_title_majority", """
WITH v AS (SELECT p_name AS title, p_brand AS occ, count(*) AS n FROM part GROUP BY 1, 2)
SELECT title, occ, round(n / sum(n) OVER (PARTITION BY title), 6) AS confidence FROM v
QUALIFY row_number() OVER (PARTITION BY title ORDER BY n DESC, occ) = 1""")
def title_majority(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("occ"))
    return rounded(lookup.majority(rows, "title", "occ"))


_SHARES = ", ".join(f"round(count(*) FILTER (topic = {k}) / count(*), 6) AS share_{k}" for k in range(8))


@query("agg11_topic_shares", f"WITH {PANEL} SELECT occ, ind, \"year\", count(*) AS n_jobs, {_SHARES} FROM panel GROUP BY occ, ind, \"year\" HAVING count(*) >= 30")
def topic_shares(spark, folder):
    return rounded(panel.share_pivot(views.panel(spark, folder), ["occ", "ind", "year"], "topic", range(8)))


@query("agg12_category_shares", f"""
WITH {PANEL} SELECT occ, "year", count(*) AS n_jobs, {", ".join(f"round(count(*) FILTER (kind = '{k}') / count(*), 6) AS share_{k}" for k in ("ECONOMY", "PROMO", "STANDARD"))}
FROM panel GROUP BY occ, "year" HAVING count(*) >= 30""")
def category_shares(spark, folder):
    return rounded(panel.share_pivot(views.panel(spark, folder), ["occ", "year"], "kind", ["ECONOMY", "PROMO", "STANDARD"]))


@query("agg13_survival_rates", f"""
WITH {PANEL}, k AS (SELECT DISTINCT "year", CAST(topic AS BIGINT) AS topic FROM panel WHERE (topic + "year") % 3 <> 0),
j AS (SELECT p."year" AS window_from, ind, k.topic IS NOT NULL AS kept FROM panel p LEFT JOIN k ON k."year" = p."year" AND k.topic = p.topic)
SELECT window_from, ind, count(*) AS n_source, CAST(count(*) FILTER (kept) AS BIGINT) AS n_survive, round(avg(CAST(kept AS INTEGER)), 6) AS survival_rate,
  round(1 - avg(CAST(kept AS INTEGER)), 6) AS reorganization_rate, CAST(count(*) >= 500 AS INTEGER) AS valid_sample FROM j GROUP BY window_from, ind""")
def survival_rates(spark, folder):
    rows = views.panel(spark, folder).withColumnsRenamed({"year": "window_from", "topic": "dominant_topic_id"})
    kept = rows.filter((F.col("dominant_topic_id") + F.col("window_from")) % 3 != 0)
    return rounded(evolution.survival_by_group(rows, kept, "ind"))


@query("agg14_pooled_variance", f"""
WITH {CELLS}, a AS (SELECT occ, "year", sum(n_jobs) AS n, count(*) AS k, sum(n_jobs * ent) / sum(n_jobs) AS m FROM cells GROUP BY occ, "year" HAVING sum(n_jobs) >= 50),
b AS (SELECT c.occ, c."year", sqrt(sum(n_jobs * sd_ent * sd_ent) / any_value(a.n) + sum(n_jobs * (ent - a.m) * (ent - a.m)) / any_value(a.n)) AS sd
  FROM cells c JOIN a ON a.occ = c.occ AND a."year" = c."year" GROUP BY c.occ, c."year")
SELECT a.occ, a."year", CAST(n AS BIGINT) AS n_jobs, k AS n_cells, round(m, 4) AS mean_ent, round(sd, 4) AS sd_ent, round(sd / m, 4) AS cv_ent
FROM a JOIN b ON a.occ = b.occ AND a."year" = b."year" """)
def pooled_variance(spark, folder):
    cells = views.cells(spark, folder).withColumnRenamed("ent", "mean_ent")
    return rounded(panel.pooled_variance(cells, ["occ", "year"], "ent"), 4)


_TASKS = ["ECONOMY", "PROMO"]


@query("agg15_task_cells", f"""
WITH {PANEL}, p AS (SELECT *, length(regexp_replace(title, '[^aeiou]', '', 'g')) AS va, length(regexp_replace(title, '[^lr]', '', 'g')) AS vb, length(title) AS len FROM panel)
SELECT occ, "year", count(*) AS n, round(avg(len), 6) AS mean_textlen, round(avg(va), 6) AS mean_A_count, round(avg(vb), 6) AS mean_B_count,
  round(avg(CAST(va > 0 AS INTEGER)), 6) AS share_has_A, round(avg(CAST(vb > 0 AS INTEGER)), 6) AS share_has_B,
  round(sum(va) / (sum(va) + sum(vb)), 6) AS share_A_kw, round(sum(vb) / (sum(va) + sum(vb)), 6) AS share_B_kw, round(ln(greatest(avg(len), 1)), 6) AS log_textlen
FROM p GROUP BY occ, "year" """)
def task_cells(spark, folder):
    counts = {"A": F.regexp_count("title", F.lit("[aeiou]")), "B": F.regexp_count("title", F.lit("[lr]"))}
    return rounded(panel.task_cells(views.panel(spark, folder), ["occ", "year"], counts, F.length("title")))


@query("agg16_adoption", f"""
WITH {PANEL}, {EXPOSURE}, c AS (SELECT p.occ, "year", count(*) AS n, count(*) FILTER (flag = 'R') AS hits, any_value(exposure) AS exposure
  FROM panel p JOIN exposure e ON e.occ = p.occ GROUP BY p.occ, "year"),
m AS (SELECT sum(n * exposure) / sum(n) AS mx, sum(n * (hits / n)) / sum(n) AS my FROM c),
r AS (SELECT sum(n * (exposure - mx) * (hits / n - my)) / sqrt(sum(n * (exposure - mx) ** 2) * sum(n * (hits / n - my) ** 2)) AS r FROM c, m)
SELECT "year", count(*) AS cells, CAST(sum(n) AS BIGINT) AS total_n, CAST(sum(hits) AS BIGINT) AS mentions, round(sum(hits) / sum(n) * 100, 6) AS rate_pct,
  (SELECT round(r, 4) FROM r) AS weighted_r FROM c GROUP BY "year" """)
def adoption(spark, folder):
    cells = views.panel(spark, folder).join(views.exposure(spark, folder), "occ").groupBy("occ", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") == "R").alias("hits"), F.first("exposure").alias("exposure"))
    r = cells.agg(panel.weighted_correlation(F.col("exposure"), F.col("hits") / F.col("n"), F.col("n"))).scalar()
    return rounded(panel.adoption(cells, ["year"], "hits", "n")).withColumn("weighted_r", F.round(r, 4))


@query("agg17_industry_years", f"""
WITH {PANEL} SELECT ind, "year", count(*) AS n_jds, round(avg(CAST(ent > 0.05 AS INTEGER)), 6) AS exposure, round(avg(eff), 6) AS mean_breadth,
  round(median(eff), 6) AS median_breadth, round(avg(ent), 6) AS mean_entropy FROM panel GROUP BY ind, "year" HAVING count(*) >= 100""")
def industry_years(spark, folder):
    rows = views.panel(spark, folder)
    base = rows.groupBy("ind", "year").agg(
        F.count(F.lit(1)).alias("n_jds"), F.avg((F.col("ent") > 0.05).cast("int")).alias("exposure"),
        F.avg("eff").alias("mean_breadth"), F.avg("ent").alias("mean_entropy")).filter("n_jds >= 100")
    medians = ranks.exact_quantiles(rows, ["ind", "year"], {"median_breadth": ("eff", 0.5)})
    return rounded(ranks.join_on(base, medians, ["ind", "year"], "left"))


@query("agg18_quartile_summary", f"""
WITH {PANEL} SELECT "year", count(*) AS n, round(avg(salary), 3) AS mean, round(quantile_cont(salary, 0.25), 3) AS q25,
  round(quantile_cont(salary, 0.5), 3) AS q50, round(quantile_cont(salary, 0.75), 3) AS q75 FROM panel GROUP BY "year" """)
def quartile_summary(spark, folder):
    return rounded(panel.quartile_summary(views.panel(spark, folder), ["year"], "salary"), 3)


@query("agg19_breadth_depth", f"""
WITH {PANEL} SELECT status, "year", count(*) AS n, round(avg(CAST(ent > 0 AS INTEGER)), 6) AS breadth, round(avg(CASE WHEN ent > 0 THEN ent END), 6) AS depth
FROM panel GROUP BY status, "year" """)
def breadth_depth(spark, folder):
    return rounded(panel.breadth_depth(views.panel(spark, folder), ["status", "year"], "ent"))


@query("agg19_flag_pivot", f"""
WITH {PANEL} SELECT "year", {", ".join(f"round(avg(CASE WHEN flag = '{f}' THEN CAST(ent > 0.05 AS INTEGER) END), 6) AS {f}" for f in "ANR")} FROM panel GROUP BY "year" """)
def flag_pivot(spark, folder):
    rows = views.panel(spark, folder).withColumn("hit", (F.col("ent") > 0.05).cast("int"))
    return rounded(rows.groupBy("year").pivot("flag", ["A", "N", "R"]).agg(F.avg("hit")))


PROFILES = TOKENS + """,
words AS (SELECT id, "year", lang, unnest(tokens) AS term FROM toks),
cl AS (SELECT id, substr(term, 1, 1) AS cluster, count(*) AS n FROM words WHERE substr(term, 1, 1) IN ('a', 'e', 'o', 't', 's') GROUP BY 1, 2),
tot AS (SELECT id, sum(n) AS total FROM cl GROUP BY id HAVING sum(n) >= 5),
shares AS (SELECT cl.id, cluster, n / total AS share FROM cl JOIN tot USING (id)),
gp AS (
  SELECT "year", cluster, sum(share) / any_value(c.n) AS mean_share FROM shares JOIN toks USING (id)
  JOIN (SELECT "year" AS y, count(*) AS n FROM toks GROUP BY 1) c ON c.y = toks."year" GROUP BY "year", cluster)"""


def skill_words(docs):
    """Word to cluster table of the view: words by first letter."""
    first = F.substring("term", 1, 1)
    return tokens.term_counts(docs).filter(first.isin("a", "e", "o", "t", "s")).select(
        F.col("term").alias("word"), first.alias("cluster"))


def year_profiles(spark, folder):
    from ..operators.vectors import profile_shares

    docs = views.token_docs(spark, folder)
    shares = profile_shares(docs, "id", skill_words(docs))
    return panel.group_profiles(shares, docs.select("id", "year"), "id", "year")


@query("agg20_group_profiles", f"""
WITH {PROFILES}, p AS (
  SELECT cluster, coalesce(max(CASE WHEN "year" = 2016 THEN mean_share END), 0) AS a, coalesce(max(CASE WHEN "year" = 2025 THEN mean_share END), 0) AS b FROM gp GROUP BY cluster)
SELECT cluster, round(a, 6) AS share_first, round(b, 6) AS share_last, round(b - a, 6) AS diff, round(CASE WHEN a > 1e-6 THEN (b - a) / a * 100 ELSE 0 END, 4) AS change_pct FROM p""")
def group_profiles(spark, folder):
    out = panel.profile_change(year_profiles(spark, folder), "year", 2016, 2025)
    return out.select("cluster", r6("share_first"), r6("share_last"), r6("diff"), F.round("change_pct", 4).alias("change_pct"))


@query("agg21_centroid_shift", f"""
WITH {PROFILES}, p AS (
  SELECT cluster, coalesce(max(CASE WHEN "year" = 2016 THEN mean_share END), 0) AS a, coalesce(max(CASE WHEN "year" = 2025 THEN mean_share END), 0) AS b FROM gp GROUP BY cluster)
SELECT round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine FROM p""")
def centroid_shift(spark, folder):
    return rounded(panel.centroid_shift(year_profiles(spark, folder), "year", 2016, 2025))


_SKILLS = [(f"s{i}", [float((i * 7 + j * 3) % 11) - 5 for j in range(64)]) for i in range(4)]
_SKILL_SQL = ", ".join(
    f"round(avg(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {v}::DOUBLE[]) / (sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) * {sum(x * x for x in v) ** 0.5})), 6) AS {n}"
    for n, v in _SKILLS)


@query("agg22_skill_fingerprint", f"""
WITH w AS (SELECT label % 5 AS win, {_SKILL_SQL} FROM embeddings GROUP BY 1)
SELECT win, skill, CASE WHEN skill = 's0' THEN round(similarity, 4) ELSE round(similarity, 4) END AS similarity FROM w UNPIVOT (similarity FOR skill IN (s0, s1, s2, s3))""")
def skill_fingerprint(spark, folder):
    from ..operators.vectors import window_fingerprint

    rows = views.vectors(spark, folder).withColumn("win", F.col("label") % 5)
    return rounded(window_fingerprint(rows, "win", _SKILLS), 4)


@query("agg23_density", f"""
WITH {DOCS}, c AS (SELECT "year", length(text) // 1000 AS bin, count(*) AS n FROM docs WHERE "year" IN (2016, 2025) GROUP BY 1, 2)
SELECT "year", bin, n, round(n / sum(n) OVER (PARTITION BY "year"), 6) AS density FROM c""")
def density(spark, folder):
    rows = views.docs(spark, folder).withColumn("bin", F.floor(F.length("text") / 1000))
    return rounded(panel.density(rows, "bin", "year", [2016, 2025]))


@query("agg24_coverage", f"""
WITH {DOCS} SELECT "year", count(*) AS n, count(l.doc_id) AS matched, round(avg(CAST(l.doc_id IS NULL AS INTEGER)) * 100, 6) AS unknown_pct,
  count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic FROM docs LEFT JOIN labels l ON l.doc_id = docs.id GROUP BY "year" """)
def coverage(spark, folder):
    rows = views.docs(spark, folder).join(
        table(spark, folder, "labels").withColumnRenamed("doc_id", "id").withColumn("hit", F.lit(1)), "id", "left")
    return rounded(rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"),
        (F.avg(F.col("hit").isNull().cast("int")) * 100).alias("unknown_pct"),
        F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.count_if(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))


@query("agg25_reconcile", f"""
WITH {TOKENS}, a AS (SELECT lang, count(*) AS expected FROM docs GROUP BY lang), b AS (SELECT lang, count(*) AS actual FROM toks WHERE lang <> 'de' GROUP BY lang)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(expected, 0) AS diff
FROM a FULL JOIN b ON a.lang = b.lang""")
def reconcile(spark, folder):
    return panel.reconcile(views.docs(spark, folder), views.token_docs(spark, folder).filter("lang != 'de'"), "lang")


@query("agg26_token_statistics", f"""
WITH {TOKENS}, r AS (SELECT len(tokens) AS c, row_number() OVER (ORDER BY len(tokens)) - 1 AS i, count(*) OVER () AS n FROM toks)
SELECT any_value(n) AS n, round(avg(c), 6) AS mean, max(c) AS max, {", ".join(f"max(CASE WHEN i = floor(n * {q}::DOUBLE) THEN c END) AS {k}" for k, q in (("median", .5), ("p5", .05), ("p25", .25), ("p75", .75), ("p95", .95), ("p99", .99)))} FROM r""")
def token_statistics(spark, folder):
    return rounded(tokens.token_statistics(tokens.token_documents(views.docs(spark, folder), "text")))


@query("agg27_upper_median", f"""
WITH {PANEL}, r AS (SELECT "year", size, row_number() OVER (PARTITION BY "year" ORDER BY size) AS rn, count(*) OVER (PARTITION BY "year") AS n FROM panel)
SELECT "year", round(avg(size), 6) AS mean, max(CASE WHEN rn = n // 2 + 1 THEN size END) AS upper_median FROM r GROUP BY "year" """)
def upper_median(spark, folder):
    rows = views.panel(spark, folder)
    medians = ranks.order_statistics(rows, ["year"], "size", {"upper_median": 0.5})
    return rounded(rows.groupBy("year").agg(F.avg("size").alias("mean")).join(medians, "year"))


@query("agg28_describe", f"""
WITH {POSTINGS}, v AS (
  SELECT 'salary_min' AS "column", TRY_CAST(salary_min AS DOUBLE) AS x FROM postings
  UNION ALL SELECT 'publish_year', TRY_CAST(publish_year AS DOUBLE) FROM postings UNION ALL SELECT 'length', length(description) FROM postings)
SELECT "column", CAST(count(x) AS DOUBLE) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, max(x) AS max FROM v GROUP BY "column" """)
def describe(spark, folder):
    from ..operators.cleaning import describe as summary

    out = summary(views.postings(spark, folder), {
        "salary_min": F.col("salary_min").try_cast("double"), "publish_year": F.col("publish_year").try_cast("double"),
        "length": F.length("description")})
    return rounded(out, 4)


@query("agg29_vocabulary_statistics", f"""
WITH {TOKENS} SELECT count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, round(avg(len(tokens)), 6) AS avg_tokens,
  (SELECT count(DISTINCT term) FROM (SELECT unnest(tokens) AS term FROM toks)) AS vocabulary FROM toks""")
def vocabulary_statistics(spark, folder):
    return rounded(tokens.vocabulary_statistics(views.token_docs(spark, folder)))


@query("agg30_between_within", f"""
WITH {PANEL}, g AS (SELECT occ, stddev_samp(ent) AS sd, avg(ent) AS m FROM panel GROUP BY occ)
SELECT round(avg(sd), 6) AS within_std, round(stddev_samp(m), 6) AS between_std, round(avg(sd) / (avg(sd) + stddev_samp(m)), 6) AS within_share FROM g""")
def between_within(spark, folder):
    return rounded(panel.between_within(views.panel(spark, folder), "occ", "ent"))


@query("agg31_facets", f"""
WITH {PANEL}, b AS (SELECT *, CASE WHEN salary < 10000 THEN '<10k' WHEN salary < 40000 THEN '10-40k' ELSE '>40k' END AS band FROM panel)
SELECT "year", 'salary' AS facet, band, count(*) AS n, round(avg(ent), 6) AS mean_value FROM b GROUP BY "year", band
UNION ALL SELECT "year", 'status', status, count(*), round(avg(ent), 6) FROM b GROUP BY "year", status
UNION ALL SELECT "year", 'kind', kind, count(*), round(avg(ent), 6) FROM b GROUP BY "year", kind""")
def facets(spark, folder):
    s = F.col("salary")
    bands = {"salary_band": F.when(s < 10000, "<10k").when(s < 40000, "10-40k").otherwise(">40k"),
             "status_band": F.col("status"), "kind_band": F.col("kind")}
    out = panel.facets(views.panel(spark, folder), bands, "ent")
    return rounded(out.withColumn("facet", F.replace("facet", F.lit("_band"), F.lit(""))))


@query("agg32_year_table", f"""
WITH {PANEL} SELECT "year", count(*) AS n, round(avg(ent), 6) AS mean, round(stddev_samp(ent), 6) AS sd, min(ent) AS min, max(ent) AS max FROM panel GROUP BY "year" """)
def year_table(spark, folder):
    return rounded(panel.year_table(views.panel(spark, folder), "ent"))


# --- windows ------------------------------------------------------------------------------

@query("win1_year_sequence", f"""
WITH {DOCS} SELECT id, "year", CAST("year" AS BIGINT) * 10000000 + row_number() OVER (PARTITION BY "year" ORDER BY id) AS seq_id FROM docs""")
def year_sequence(spark, folder):
    rows = ranks.ranked(views.docs(spark, folder).select("id", "year"), ["id"], ["year"], "rn")
    return rows.select("id", "year", (F.col("year").cast("bigint") * 10_000_000 + F.col("rn")).alias("seq_id"))


@query("win2_demean", f"""
WITH {CELLS} SELECT occ, ind, "year", round(ent - avg(ent) OVER (PARTITION BY occ), 6) + 0.0::DOUBLE AS ent_within FROM cells""")
def demean(spark, folder):
    return rounded(panel.demean(views.cells(spark, folder), "occ", ["ent"]).select("occ", "ind", "year", "ent_within"))


@query("win3_quantile_bins", f"""
WITH {EXPOSURE}, e AS (SELECT quantile_cont(exposure, [1.0/3, 2.0/3]) AS t, quantile_cont(exposure, [0.25, 0.5, 0.75]) AS q FROM exposure)
SELECT occ, CASE WHEN exposure <= q[1] THEN 'Q1' WHEN exposure <= q[2] THEN 'Q2' WHEN exposure <= q[3] THEN 'Q3' ELSE 'Q4' END AS bin FROM exposure, e""")
def quantile_bins(spark, folder):
    return panel.quantile_bins(views.exposure(spark, folder), "occ", "exposure", 4, ["Q1", "Q2", "Q3", "Q4"]).select("occ", "bin")


@query("win4_first_last", f"""
WITH {CELLS}, y AS (SELECT ind, "year", avg(ent) AS m FROM cells GROUP BY ind, "year")
SELECT ind, round(arg_min(m, "year"), 6) AS first_value, round(arg_max(m, "year"), 6) AS last_value, count(*) AS n, round(arg_max(m, "year") - arg_min(m, "year"), 6) AS delta FROM y GROUP BY ind""")
def first_last(spark, folder):
    yearly = views.cells(spark, folder).groupBy("ind", "year").agg(F.avg("ent").alias("m"))
    return rounded(panel.first_last(yearly, "ind", "year", "m"))


@query("win5_adjacent_periods", f"""
WITH {PANEL} SELECT ind, "year", next_period FROM (
  SELECT ind, "year", lead("year") OVER (PARTITION BY ind ORDER BY "year") AS next_period FROM (SELECT DISTINCT ind, "year" FROM panel)) WHERE next_period IS NOT NULL""")
def adjacent_periods(spark, folder):
    return panel.adjacent_periods(views.panel(spark, folder), "year", ["ind"])


@query("win6_turning_points", f"""
WITH {PANEL}, i AS (SELECT ind, "year" AS window_from, (count(*) FILTER (flag = 'A') - count(*) FILTER (flag = 'N')) / count(*) AS x FROM panel GROUP BY ind, "year"),
d AS (SELECT ind, window_from, x, x - lag(x) OVER (PARTITION BY ind ORDER BY window_from) AS change FROM i)
SELECT ind, window_from, round(x, 6) AS integration_index, round(change, 6) AS change, CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS direction FROM d WHERE abs(change) > 0.01""")
def turning_points(spark, folder):
    flag = F.col("flag")
    index = views.panel(spark, folder).groupBy("ind", F.col("year").alias("window_from")).agg(
        ((F.count_if(flag == "A") - F.count_if(flag == "N")) / F.count(F.lit(1))).alias("integration_index"))
    return rounded(evolution.turning_points(index, least=0.01, group=["ind"]))


@query("win7_permuted_years", f"""
WITH {CELLS}, d AS (SELECT draw, occ, ind, "year" FROM cells, range(1, 4) r(draw)),
a AS (SELECT *, row_number() OVER (PARTITION BY draw, occ, ind ORDER BY "year") AS spot,
  row_number() OVER (PARTITION BY draw, occ, ind ORDER BY md5(concat_ws('|', draw, occ, ind, "year", '42')), "year") AS other FROM d)
SELECT CAST(a.draw AS INTEGER) AS draw, a.occ, a.ind, a."year", b."year" AS year_shuffled FROM a JOIN a b ON a.draw = b.draw AND a.occ = b.occ AND a.ind = b.ind AND a.spot = b.other""")
def permuted_years(spark, folder):
    return panel.permuted_years(views.cells(spark, folder), ["occ", "ind"], 3).select(
        "draw", "occ", "ind", "year", "year_shuffled")


# --- sorts, sets ------------------------------------------------------------------------------

@query("srt1_most_common", f"WITH {TOKENS}, t AS (SELECT unnest(tokens) AS term FROM toks) SELECT term, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS coverage FROM t GROUP BY term ORDER BY n DESC, term LIMIT 50")
def most_common(spark, folder):
    words = views.token_docs(spark, folder).select(F.explode("tokens").alias("term"))
    return rounded(panel.most_common(words, "term", 50))


@query("srt2_top_per_group", f"""
WITH {PANEL} SELECT occ, title, count(*) AS n FROM panel GROUP BY occ, title QUALIFY row_number() OVER (PARTITION BY occ ORDER BY n DESC, title) <= 5""")
def top_per_group(spark, folder):
    counts = views.panel(spark, folder).groupBy("occ", "title").agg(F.count(F.lit(1)).alias("n"))
    return ranks.top_per_key(counts, ["occ"], [F.desc("n"), "title"], 5)


@query("srt3_sorted_export", f"WITH {PANEL} SELECT \"year\", ind, count(*) AS n FROM panel GROUP BY \"year\", ind ORDER BY \"year\", n DESC, ind")
def sorted_export(spark, folder):
    return views.panel(spark, folder).groupBy("year", "ind").agg(F.count(F.lit(1)).alias("n")).orderBy("year", F.desc("n"), "ind")


@query("srt4_reservoir", "SELECT doc_id AS id, lang FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100")
def reservoir(spark, folder):
    return panel.reservoir(views.docs(spark, folder).select("id", "lang"), "id", 100)


@query("srt4_class_cap", """
SELECT doc_id AS id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 50""")
def class_cap(spark, folder):
    from ..operators.models import stratified_cap

    return stratified_cap(views.docs(spark, folder).select("id", "lang"), "lang", "id", 50)


@query("set1_concatenate", """
SELECT 'doc' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'page', count(*) FROM pages UNION ALL SELECT 'talk', count(*) FROM conversations""")
def concatenate(spark, folder):
    parts = [table(spark, folder, n).select(F.lit(k).alias("kind")) for n, k in (("documents", "doc"), ("pages", "page"), ("conversations", "talk"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("set2_intersection", f"WITH {PANEL} SELECT title FROM panel WHERE \"year\" = 1995 INTERSECT SELECT title FROM panel WHERE \"year\" = 2000")
def intersection(spark, folder):
    rows = views.panel(spark, folder)
    return rows.filter("year = 1995").select("title").intersect(rows.filter("year = 2000").select("title"))


@query("set3_difference", f"WITH {views.TERMS} SELECT term FROM terms WHERE cf >= 50 AND term NOT IN (SELECT term FROM doc_terms JOIN docs USING (id) WHERE lang = 'en')")
def difference(spark, folder):
    docs = views.token_docs(spark, folder)
    frequent = tokens.term_counts(docs).filter("cf >= 50").select("term")
    return frequent.exceptAll(docs.filter("lang = 'en'").select(F.explode("tokens").alias("term")).distinct())
