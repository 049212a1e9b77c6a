"""Topic merging inside a window, alignment across windows, evolution tables.

Inputs are topic tables (tens of topics per window), so grouping by window or
window pair bounds every group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed, vec

EVENT_SCHEMA = (
    "window_from string, window_to string, event_type string, source_topics array<int>, "
    "target_topics array<int>, similarity double, topic_count int")


def topic_pairs(df: DataFrame, window: str = "window", topic: str = "topic") -> DataFrame:
    """Cosine of all topic pairs i < j inside a window; the pairs are the result."""
    unit = df.select(window, F.col(topic).alias("t"), vec.normalize(F.col("v")).alias("v"))
    a = unit.select(window, F.col("t").alias("i"), F.col("v").alias("a"))
    b = unit.select(window, F.col("t").alias("j"), F.col("v").alias("b"))
    return a.join(b, window).filter("i < j").select(
        window, "i", "j", vec.dot(F.col("a"), F.col("b")).alias("sim"))


def _group(topics: list[int], pairs: list[tuple[float, int, int]], limit: int | None) -> list[list[int]]:
    groups = {t: [t] for t in topics}
    home = {t: t for t in topics}
    for _, i, j in pairs:
        a, b = home[i], home[j]
        if a == b or (limit is not None and len(groups[a]) + len(groups[b]) > limit):
            continue
        for t in groups[b]:
            home[t] = a
        groups[a] += groups.pop(b)
    return list(groups.values())


def merge_topics(
    topics: DataFrame, pairs: DataFrame, window: str = "window",
    threshold: float = fixed.MERGE_SIMILARITY, max_size: int = fixed.MERGE_MAX_SIZE,
    min_topics: int = fixed.MERGE_MIN_TOPICS, relax: float = fixed.MERGE_RELAX,
) -> DataFrame:
    """(window, topic, merged) map: greedy union of similar topics, most similar first.

    While fewer than `min_topics` groups exist the threshold is lowered and the
    remaining pairs are grouped again without a size limit, as long as any
    pair remains above the threshold in force.
    """

    def run(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(int(x) for x in t["topic"])
        cut = threshold
        close = sorted(((-s, i, j) for i, j, s in zip(p["i"], p["j"], p["sim"]) if s > cut))
        groups = _group(ids, close, max_size)
        while len(groups) < min_topics and close:
            cut *= relax
            close = [x for x in close if -x[0] > cut]
            again = _group(ids, close, None)
            if again == groups:
                break
            groups = again
        rows = [(t["w"].iloc[0], topic, g) for g, members in enumerate(groups) for topic in members]
        return pd.DataFrame(rows, columns=["w", "topic", "merged"])

    kind = topics.schema[window].dataType.simpleString()
    left = topics.select(F.col(window).alias("w"), F.col("topic").cast("int").alias("topic"))
    right = pairs.select(F.col(window).alias("w"), "i", "j", "sim")
    out = left.groupBy("w").cogroup(right.groupBy("w")).applyInPandas(
        run, f"w {kind}, topic int, merged int")
    return out.withColumnRenamed("w", window)


def merged_vectors(topics: DataFrame, mapping: DataFrame, dim: int, window: str = "window") -> DataFrame:
    return (
        topics.join(mapping, [window, "topic"]).groupBy(window, "merged")
        .agg(vec.mean_vector(F.col("v"), dim).alias("v"), F.count(F.lit(1)).alias("n_topics"))
        .withColumn("v", vec.normalize(F.col("v"))))


def merged_labels(words: DataFrame, mapping: DataFrame, window: str = "window", n: int = 3) -> DataFrame:
    """Label of each merged topic from the summed weights of its topics' words."""
    sums = words.join(mapping, [window, "topic"]).groupBy(window, "merged", "term").agg(
        F.sum("weight").alias("weight"))
    w = Window.partitionBy(window, "merged").orderBy(F.desc("weight"), "term")
    top = sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    terms = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return top.groupBy(window, "merged").agg(F.concat(
        F.lit("Merged_"), F.col("merged").cast("string"), F.lit(": "),
        F.array_join(terms, " ")).alias("label"))


def reduction_report(mapping: DataFrame, window: str = "window") -> DataFrame:
    n, m = F.count(F.lit(1)), F.countDistinct("merged")
    return mapping.groupBy(window).agg(
        n.alias("n_topics"), m.alias("n_merged"), (1 - m / n).alias("reduction"))


def align(
    sims: DataFrame, survival: float = fixed.SURVIVAL_SIMILARITY,
    other: float = fixed.SPLIT_MERGE_SIMILARITY, most: int = fixed.EVENT_MAX_TOPICS,
) -> DataFrame:
    """Evolution events of every window pair from its topic cosines.

    One-to-one survival takes the most similar free pair again and again. Merges
    and splits use the topics left over; that list is not updated between the
    two, so a topic of a merge can appear in a split as well.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = (pdf["window_from"].iloc[0], pdf["window_to"].iloc[0])
        rows = sorted(zip(-pdf["sim"], pdf["source"], pdf["target"]))
        used_s, used_t, events = set(), set(), []
        for s, i, j in rows:
            if -s >= survival and i not in used_s and j not in used_t:
                used_s.add(i)
                used_t.add(j)
                events.append((*pair, "survival", [int(i)], [int(j)], float(-s), 1))
        free = [(s, i, j) for s, i, j in rows if -s >= other and i not in used_s and j not in used_t]
        for kind, at in (("merge", 2), ("split", 1)):
            for topic in sorted({r[at] for r in free}):
                part = [r for r in free if r[at] == topic][:most]
                if len([r for r in free if r[at] == topic]) < 2:
                    continue
                others = [int(r[3 - at]) for r in part]
                one = [int(topic)]
                mean = float(sum(-r[0] for r in part) / len(part))
                source, target = (others, one) if kind == "merge" else (one, others)
                events.append((*pair, kind, source, target, mean, len(part)))
        return pd.DataFrame(events, columns=[c.split(" ")[0] for c in EVENT_SCHEMA.split(", ")])

    text = sims.withColumns({
        "window_from": F.col("window_from").cast("string"), "window_to": F.col("window_to").cast("string")})
    return text.groupBy("window_from", "window_to").applyInPandas(run, EVENT_SCHEMA)


def event_rates(events: DataFrame) -> DataFrame:
    """Events and the share of each kind per window pair."""
    n = F.count(F.lit(1))
    return events.groupBy("window_from", "window_to").agg(
        n.alias("total_events"),
        *[(F.count_if(F.col("event_type") == kind) / n).alias(f"{kind}_rate")
          for kind in ("survival", "split", "merge")])


def event_statistics(events: DataFrame) -> DataFrame:
    """Count per event kind and the overall survival rate."""
    survived = events.agg(F.count_if(F.col("event_type") == "survival") / F.count(F.lit(1))).scalar()
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "overall_survival_rate", survived)


def integration_index(events: DataFrame) -> DataFrame:
    """(merge - split) / total per window pair with the survival rate and position."""
    n = F.count(F.lit(1))
    merge = F.count_if(F.col("event_type") == "merge")
    split = F.count_if(F.col("event_type") == "split")
    return events.groupBy("window_from", "window_to").agg(
        n.alias("total"), merge.alias("merges"), split.alias("splits"),
        ((merge - split) / n).alias("integration_index"),
        (F.count_if(F.col("event_type") == "survival") / n).alias("survival_rate"))


def integration_trend(index: DataFrame) -> DataFrame:
    """Slope of the index over the ordered window pairs."""
    placed = index.withColumn(
        "at", F.row_number().over(Window.orderBy("window_from")) - 1)  # one row per window pair
    return placed.agg(F.regr_slope("integration_index", "at").alias("trend"))


def turning_points(
    index: DataFrame, value: str = "integration_index", least: float = 0.1, group: Sequence[str] = ()
) -> DataFrame:
    """Window pairs whose index moves by more than `least`, with the direction; one series per group."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy("window_from"))  # a row per window pair
    return (
        index.withColumn("change", step).filter(F.abs("change") > least)
        .withColumn("direction", F.when(F.col("change") > 0, "up").otherwise("down")))


def unified_topics(topics: DataFrame, events: DataFrame, window: str = "window") -> DataFrame:
    """(window, topic, unified_topic_id): the id of the first topic of its survival chain."""
    links = events.filter("event_type = 'survival'").select(
        F.col("window_from"), F.col("window_to"),
        F.get("source_topics", F.lit(0)).alias("source"), F.get("target_topics", F.lit(0)).alias("target"))
    windows = sorted(r[0] for r in topics.select(F.col(window).cast("string")).distinct().collect())
    own = F.concat(F.lit("skill_"), F.col("w"), F.lit("_"), F.col("topic").cast("string"))
    every = topics.select(F.col(window).cast("string").alias("w"), F.col("topic").cast("int").alias("topic"))
    ids = None
    for w in windows:
        here = every.filter(F.col("w") == w)
        if ids is None:
            ids = here.withColumn("unified_topic_id", own)
            continue
        carried = (
            links.filter(F.col("window_to") == w)
            .join(ids.select(F.col("w").alias("window_from"), F.col("topic").alias("source"),
                             F.col("unified_topic_id").alias("_id")), ["window_from", "source"])
            .select(F.col("target").alias("topic"), "_id"))
        named = here.join(carried, "topic", "left").select(
            "w", "topic", F.coalesce(F.col("_id"), own).alias("unified_topic_id"))
        ids = ids.unionByName(named)
    return ids.withColumnRenamed("w", window)


def flow_links(topics: DataFrame, events: DataFrame, window: str = "window") -> DataFrame:
    """Source, target, value and kind of every flow between topics, births and deaths included."""
    moved = (
        events.select("*", F.explode("source_topics").alias("source"))
        .select("window_from", "window_to", "event_type", "similarity", "source",
                F.explode("target_topics").alias("target"))
        .select("window_from", "window_to", "source", "target",
                (F.col("similarity") * 100).alias("value"), F.col("event_type").alias("kind")))
    every = topics.select(F.col(window).cast("string").alias("w"), F.col("topic").cast("int").alias("topic"))
    pairs = events.select("window_from", "window_to").distinct()
    death = (
        pairs.join(every, F.col("window_from") == F.col("w")).select("window_from", "window_to", F.col("topic").alias("source"))
        .join(moved.select("window_from", "source").distinct(), ["window_from", "source"], "left_anti")
        .select("window_from", "window_to", "source", F.lit(None).cast("int").alias("target"),
                F.lit(50.0).alias("value"), F.lit("death").alias("kind")))
    birth = (
        pairs.join(every, F.col("window_to") == F.col("w")).select("window_from", "window_to", F.col("topic").alias("target"))
        .join(moved.select("window_to", "target").distinct(), ["window_to", "target"], "left_anti")
        .select("window_from", "window_to", F.lit(None).cast("int").alias("source"), "target",
                F.lit(50.0).alias("value"), F.lit("birth").alias("kind")))
    return moved.unionByName(death).unionByName(birth)


def survival_by_group(
    df: DataFrame, survivors: DataFrame, group: str, pair: str = "window_from",
    topic: str = "dominant_topic_id", min_source: int = 500,
) -> DataFrame:
    """Share of postings whose dominant topic survives into the next window."""
    kept = survivors.select(pair, topic).distinct().withColumn("_kept", F.lit(1))
    return (
        df.groupBy(pair, group, topic).agg(F.count(F.lit(1)).alias("_n"))
        .join(kept, [pair, topic], "left").groupBy(pair, group).agg(
            F.sum("_n").alias("n_source"),
            F.sum(F.when(F.col("_kept") == 1, F.col("_n")).otherwise(0)).alias("n_survive"))
        .withColumn("survival_rate", F.col("n_survive") / F.col("n_source"))
        .withColumn("reorganization_rate", 1 - F.col("survival_rate"))
        .withColumn("valid_sample", (F.col("n_source") >= min_source).cast("int")))


def parse_events(df: DataFrame) -> DataFrame:
    """Event rows whose topic lists are printed either as `[6, 13]` or as `[np.int64(0)]`."""

    def topics(name: str):
        plain = F.replace(F.col(name), F.lit("np.int64"), F.lit(""))
        return F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))

    return df.withColumns({"source_topics": topics("source_topics"), "target_topics": topics("target_topics")})
