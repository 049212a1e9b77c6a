"""Fitted models and incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, topics
from ..session import checkpoint
from ..sources import views
from ..sources.views import table
from ..streaming import incremental
from .cleaning import JUDGED, REPOSTS, reposts
from .panels import rounded
from .registry import query


@query("mdl1_topic_model")
def topic_model(spark, folder):
    words, _, figures = models.fit_topics(checkpoint(views.token_docs(spark, folder).select("tokens")), 8, min_df=views.MIN_DF)
    labels = topics.topic_labels(topics.top_words(words, 10), 10)
    return labels.withColumn("log_perplexity", F.lit(round(figures["log_perplexity"], 4)))


@query("mdl1_window_models")
def window_models(spark, folder):
    docs = views.token_docs(spark, folder).withColumn("window", F.floor((F.col("year") - 2016) / 5))
    words = models.fit_window_topics(checkpoint(docs.select("tokens", "window")), "window", 4, min_df=views.MIN_DF)
    return words.groupBy("window").agg(F.count(F.lit(1)).alias("n_terms"))


@query("mdl5_model_grid")
def model_grid(spark, folder):
    docs = checkpoint(views.token_docs(spark, folder).select("id", "tokens"))
    rows, fits = [], {}
    for k in (4, 8):
        words, _, figures = models.fit_topics(docs, k, min_df=views.MIN_DF)
        fits[k] = words
        rows.append((k, figures["log_likelihood"], figures["log_perplexity"]))
    likelihood = spark.createDataFrame(rows, "k int, log_likelihood double, log_perplexity double")
    return rounded(topics.coherence_grid(docs, fits, "id").join(likelihood, "k"), 4)


@query("mdl7_word_vectors")
def word_vectors(spark, folder):
    out = models.fit_word_vectors(views.token_docs(spark, folder), dim=16, min_count=20)
    return out.select("term", F.size("v").alias("dim"))


@query("mdl16_kmeans")
def kmeans(spark, folder):
    rows, _ = models.kmeans(views.vectors(spark, folder), 10)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("mdl16_sub_clusters")
def sub_clusters(spark, folder):
    rows = views.vectors(spark, folder).withColumn("parent", F.col("label") % 3)
    return models.sub_clusters(rows, "parent", 60).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))


@query("mdl17_gaussian_mixture")
def gaussian_mixture(spark, folder):
    out = models.gaussian_mixture(views.vectors(spark, folder), 4, dims=8)
    total = F.aggregate("membership", F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "cluster", F.round(total, 6).alias("total"))


@query("mdl19_cluster_grid")
def cluster_grid(spark, folder):
    return rounded(models.cluster_grid(views.vectors(spark, folder), [4, 8], [5, 10]), 4)


@query("mdl24_classifier")
def classifier(spark, folder):
    return rounded(models.classify_from_theta(views.theta(spark, folder), "label", "id", folds=3, cap=3000), 4)


@query("mdl24_cross_period")
def cross_period(spark, folder):
    rows = views.theta(spark, folder).withColumn("period", F.when(F.col("id") % 2 == 0, "pre").otherwise("post"))
    return rounded(models.cross_period_accuracy(rows, "label", "id", "period", "pre", "post", folds=3), 4)


@query("mdl24_yearly")
def yearly_accuracy(spark, folder):
    rows = views.theta(spark, folder).withColumn("year", (2016 + F.col("id") % 5).cast("int"))
    return rounded(models.accuracy_by_year(rows, "label", "id", "year", folds=3), 4)


@query("mdl25_metric_regressor")
def metric_regressor(spark, folder):
    rows = views.panel(spark, folder).withColumn("row", F.xxhash64("order_id", "salary", "eff"))
    return rounded(models.regress_metric(
        rows, "salary", {"quantity": ["eff"], "part": ["size", "topic"], "time": ["year"]}, "row"), 4)


@query("mdl25_importance")
def metric_importance(spark, folder):
    rows = views.panel(spark, folder).withColumn("row", F.xxhash64("order_id", "salary", "eff"))
    return rounded(models.feature_importance(rows, "salary", ["eff", "size", "topic", "year"], "row"), 4)


@query("mdl25_periods")
def metric_by_period(spark, folder):
    rows = views.panel(spark, folder).withColumn("row", F.xxhash64("order_id", "salary", "eff")).withColumn(
        "period", F.when(F.col("year") < 1996, "pre").otherwise("post"))
    return rounded(models.ablation_by_period(rows, "salary", ["eff", "size", "topic", "year"], "size", "period", "row"), 4)


# --- incremental jobs -----------------------------------------------------------------------------

@query("str1_incremental_cleaning", f"""
WITH {REPOSTS}, {JUDGED.format(source="reposts")},
k AS (SELECT row_id, CASE WHEN len(reasons) > 0 THEN 'fake' WHEN irrelevant THEN 'irrelevant' END AS reason, CASE WHEN row_id % 3 = 0 THEN 0 ELSE 1 END AS batch,
  md5(concat_ws('|', coalesce(company, 'nan'), coalesce(title, 'nan'), coalesce(city, 'nan'),
    substr(coalesce(description, 'nan'), 1, 100), coalesce(publish_date, 'nan'))) AS k FROM judged),
f AS (SELECT *, row_number() OVER (PARTITION BY k, reason IS NULL ORDER BY batch, row_id) AS place FROM k)
SELECT batch, CASE WHEN reason IS NOT NULL THEN reason WHEN place > 1 THEN 'duplicate' ELSE 'valid' END AS reject_reason,
  count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM f GROUP BY ALL""")
def incremental_cleaning(spark, folder):
    """Posting files that arrive in two steps, some reposts before their originals, cleaned by all three rules with one checkpoint."""
    path, out, state = (views.scratch(spark) for _ in range(3))
    rows = reposts(spark, folder)
    batch = F.when(F.col("row_id") % 3 == 0, 0).otherwise(1)
    for part in (0, 1):
        rows.filter(batch == part).write.mode("append").parquet(path)
        stream = incremental.arriving(spark, path, rows.schema)
        incremental.clean_arrivals(stream, out, state).awaitTermination()
    return incremental.read_cleaned(spark, out).groupBy(batch.alias("batch"), "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query("str2_repost_dedup", "SELECT user_id, event_type, 1 AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def repost_dedup(spark, folder):
    path, out, state = (views.scratch(spark) for _ in range(3))
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(path)
    unique = incremental.drop_reposts(
        incremental.arriving(spark, path, rows.schema), ["user_id", "event_type"], "ts", "60 days")
    (unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(out).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


@query("str3_running_metrics", """
SELECT event_type, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean_value FROM events GROUP BY event_type""")
def running_metrics(spark, folder):
    """Partial sums of batches, added up over all of them."""
    path, out, state = (views.scratch(spark) for _ in range(3))
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(path)
        stream = incremental.arriving(spark, path, rows.schema)
        incremental.append_partials(stream, ["event_type"], ["value"], out, state).awaitTermination()
    return rounded(incremental.combine(spark.read.parquet(out), ["event_type"], ["value"]))
