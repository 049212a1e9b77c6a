"""Row-quality chain, reject profile, windows and run summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, quality, text
from ..session import checkpoint, small_batches
from .ranks import keep_where

KEY_CHARS = 100


def posting_key() -> Column:
    """MD5 over company, title, city, first characters of the description and date."""

    def cell(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("nan"))

    parts = [F.col("company"), F.col("title"), F.col("city"),
             F.substring("description", 1, KEY_CHARS), F.col("publish_date")]
    return F.md5(F.concat_ws("|", *[cell(p) for p in parts]))


def first_reason() -> Column:
    """Which of the rules on single rows rejects a posting first; null if none does."""
    return F.when(quality.is_fake(), "fake").when(quality.is_irrelevant(), "irrelevant")


def reject_reasons(df: DataFrame, order: str = "row_id") -> DataFrame:
    """(`order`, reject_reason): first of fake, irrelevant, duplicate that applies; 'valid' otherwise.

    Only survivors of the first two rules count as originals of a duplicate. The rules
    run once, into a narrow table; only the few repeated keys are joined back to it.
    `order` names each row.
    """
    narrow = checkpoint(df.select(order, first_reason().alias("_reason"), posting_key().alias("_key")))
    late = _repeated(narrow, order)
    reason = F.coalesce(F.col("_reason"), F.when(F.col("_late"), "duplicate"), F.lit("valid"))
    return narrow.join(late, order, "left").select(order, reason.alias("reject_reason"))


def _repeated(narrow: DataFrame, order: str) -> DataFrame:
    """Survivors that are not the first of their key."""
    alive = narrow.filter("_reason is null").select(order, "_key")
    firsts = alive.groupBy("_key").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    repeated = firsts.filter("_copies > 1").select("_key", "_first")
    return alive.join(repeated, "_key").filter(F.col(order) > F.col("_first")).select(order, F.lit(True).alias("_late"))


def with_reject_reason(df: DataFrame, order: str = "row_id") -> DataFrame:
    """`df` with `reject_reason`, see `reject_reasons`.

    The rules run once, into the written rows; only the ids of duplicates are joined to them.
    """
    judged = checkpoint(df.withColumns({"_reason": first_reason(), "_key": posting_key()}))
    late = _repeated(judged.select(order, "_reason", "_key"), order)
    reason = F.coalesce(F.col("_reason"), F.when(F.col("_late"), "duplicate"), F.lit("valid"))
    return judged.join(late, order, "left").withColumn("reject_reason", reason).drop("_reason", "_key", "_late")


def reject_profile(df: DataFrame) -> DataFrame:
    """Every reason that applies to a row, counted, with the share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = (
        df.select(F.explode(quality.fake_reasons()).alias("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    return counts.withColumn("pct", F.col("n") / total * 100)


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and blank counts per column plus description length statistics, one row."""
    aggs = [F.count_if(text.is_blank(F.col(c).cast("string"))).alias(f"missing_{c}") for c in columns]
    size = F.length(text.strip(F.col("description")))
    aggs += [
        F.count(F.lit(1)).alias("n"),
        F.min(size).alias("len_min"), F.max(size).alias("len_max"), F.avg(size).alias("len_mean")]
    return df.agg(*aggs)


def describe(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """count, mean, sd, min and max of numeric expressions in one pass, long form."""
    aggs = []
    for name, c in columns.items():
        c = c.cast("double")
        aggs += [F.count(c).alias(f"{name}|n"), F.avg(c).alias(f"{name}|mean"),
                 F.stddev_samp(c).alias(f"{name}|sd"), F.min(c).alias(f"{name}|min"),
                 F.max(c).alias(f"{name}|max")]
    row = df.agg(*aggs)
    stats = ["n", "mean", "sd", "min", "max"]
    rows = F.array(*[
        F.struct(F.lit(name).alias("column"),
                 *[F.col(f"`{name}|{s}`").cast("double").alias(s) for s in stats])
        for name in columns])
    return row.select(F.inline(rows))


def with_window(df: DataFrame, year: Column) -> DataFrame:
    return df.withColumn("window", quality.window_of(text.parse_year(year.cast("string"))))


def window_statistics(df: DataFrame) -> DataFrame:
    """Rows and share of all rows per window; rows outside every window stay in the base."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.filter("window is not null").groupBy("window").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.col("n") / total * 100))


def excluded_years(df: DataFrame, year: str) -> DataFrame:
    """Years outside every window with their row counts."""
    return (
        df.filter(F.col("window").isNull() & F.col(year).isNotNull())
        .groupBy(year).agg(F.count(F.lit(1)).alias("n")))


def require_text(df: DataFrame, source: str, year: str, target: str) -> DataFrame:
    """Drop rows without year or without text once HTML is removed."""
    return keep_where(
        df.filter(F.col(year).isNotNull()), target, text.strip_html(F.col(source)), lambda t: t != "")


def extract_requirements(df: DataFrame, source: str, target: str = "cleaned_requirements") -> DataFrame:
    """Cleaned requirement text of every posting that has enough of it."""
    small_batches(df.sparkSession)
    found = keep_where(df, "_section", text.requirement_section(F.col(source)), lambda t: F.length(t) > 0)
    cleaned = found.withColumn(target, text.remove_noise(F.col("_section"), apart=True)).drop("_section")
    return keep_where(cleaned, target, F.col(target), lambda t: F.length(t) >= fixed.MIN_REQUIREMENT_CHARS)


def with_skill_text(
    df: DataFrame, source: str, dictionary_hit: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Skill sentences of a posting joined, with the quality columns."""
    chars = F.length("skill_text")
    return (
        df.withColumn("_every", text.sentences(F.col(source)))
        .withColumn("_kept", text.kept_sentences(F.col("_every"), dictionary_hit))
        .withColumn("skill_text", F.array_join("_kept", "；"))
        .withColumns({
            "has_skill_text": (chars >= fixed.MIN_SKILL_TEXT_CHARS).cast("int"),
            "skill_char_count": chars,
            "original_char_count": F.length(F.coalesce(F.col(source), F.lit(""))),
            "n_sentences_total": F.size("_every"),
            "n_sentences_kept": F.size("_kept"),
        })
        .drop("_every", "_kept"))


def run_summary(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """One row: rows read and rows for which each condition holds."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counters.items()])
