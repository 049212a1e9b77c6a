"""Lookup joins, title and industry resolution, majority votes.

Lookup sides carry no broadcast hint: Spark broadcasts them by their measured
size and shuffles them when they outgrow the threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, titles
from ..functions.text import alternation, lookup as constant_lookup
from .ranks import first_per_key, top_per_key
from .rule_index import keyed_once, keyword_hits, known_words, words_counted

FEW_KEYWORDS = 64


def attach(df: DataFrame, table: DataFrame, on: str | Sequence[str], fill: Mapping | None = None) -> DataFrame:
    """Left lookup join; `fill` gives defaults for rows without a match."""
    out = df.join(table, on if isinstance(on, str) else list(on), "left")
    return out.fillna(dict(fill)) if fill else out


def attach_all(df: DataFrame, tables: Sequence[DataFrame], on: str) -> DataFrame:
    for table in tables:
        df = df.join(table, on, "left")
    return df


def members(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return df.join(table.select(on), on, "left_semi")


def pending(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return df.join(done.select(on), on, "left_anti")


def fill_from(df: DataFrame, updates: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Columns taken from `updates` where it has a value, else kept."""
    right = updates.select(on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(right, on, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    return out.drop(*[f"_new_{c}" for c in columns])


def contains_join(df: DataFrame, column: str, keywords: DataFrame, keyword: str) -> DataFrame:
    """Rows of `df` with every keyword their text contains, once per row and keyword.

    Up to `FEW_KEYWORDS` go to every task, and each text is compared with all of them where
    it lies. With more, a text meets only the keywords that share one of its distinct
    two-character openings (keywords of one character, its characters), and each is verified.
    """
    if keywords.limit(FEW_KEYWORDS + 1).count() <= FEW_KEYWORDS:
        return df.join(F.broadcast(keywords), (F.length(keyword) > 0) & F.contains(F.col(column), F.col(keyword)))
    t = F.coalesce(F.col(column), F.lit(""))
    openings = F.array_distinct(F.concat(
        F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), 1), F.regexp_extract_all(t, F.lit("(?s)(.)"), 1)))
    known = keywords.withColumn("_open", F.substring(keyword, 1, 2))
    return (
        df.withColumn("_open", F.explode(openings)).join(known, "_open")
        .filter(F.contains(F.col(column), F.col(keyword))).drop("_open"))


def title_tables(matches: DataFrame, exposure: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Raw and cleaned title lookups from accepted matches with a scored code.

    The last match of a raw title counts, the first of a cleaned one.
    """
    code = "isco08_4digit"
    valid = matches.filter("sbert_accepted = 'True'").join(
        exposure.select(code).distinct(), code, "left_semi")
    raw = first_per_key(valid, ["title"], [F.desc(order)]).select("title", code)
    cleaned = valid.withColumn("clean_title", titles.clean_title(F.col("title")))
    cleaned = first_per_key(
        cleaned.filter(F.length("clean_title") >= 2), ["clean_title"], [order])
    return raw, cleaned.select("clean_title", code)


def cluster_dominance(
    profile: DataFrame, exposure: DataFrame,
    min_purity: float = fixed.CLUSTER_MIN_PURITY, min_support: int = fixed.CLUSTER_MIN_SUPPORT,
) -> DataFrame:
    """Dominant code of each title cluster with purity and support thresholds.

    `profile` holds (cluster_id, isco08_4digit, n); ties go to the lower code.
    """
    best = profile.filter(~F.col("cluster_id").isin(*fixed.NOISE_TITLE_CLUSTERS)).groupBy(
        "cluster_id").agg(
        F.sum("n").alias("support"),
        F.min_by("isco08_4digit", F.struct(-F.col("n"), F.col("isco08_4digit"))).alias("isco08_4digit"),
        F.max("n").alias("top_n"))
    best = best.withColumn("purity", F.col("top_n") / F.col("support"))
    return best.filter((F.col("support") >= min_support) & (F.col("purity") >= min_purity)).join(
        exposure.select("isco08_4digit").distinct(), "isco08_4digit", "left_semi")


def match_titles(
    df: DataFrame, raw: DataFrame, cleaned: DataFrame, alias: DataFrame,
    title_cluster: DataFrame, dominance: DataFrame,
) -> DataFrame:
    """Code and match method of each title: raw, cleaned, alias, cluster or miss.

    Titles are made distinct first; the lookups run once per title.
    """
    code = "isco08_4digit"
    every = df.select("title").distinct().withColumn("clean_title", titles.clean_title(F.col("title")))

    def table(t: DataFrame, key: str, to: str, name: str) -> DataFrame:
        return t.select(F.col(key).alias(to), F.col(code).alias(name))

    clusters = title_cluster.select(F.col("title").alias("clean_title"), "cluster_id").join(
        dominance.select("cluster_id", F.col(code).alias("_cluster"), "purity"), "cluster_id")
    found = (
        every.join(table(raw, "title", "title", "_raw"), "title", "left")
        .join(table(cleaned, "clean_title", "clean_title", "_cleaned"), "clean_title", "left")
        .join(table(alias, "title", "title", "_alias"), "title", "left")
        .join(table(alias, "title", "clean_title", "_alias2"), "clean_title", "left")
        .join(clusters, "clean_title", "left"))
    by_alias = F.coalesce("_alias", "_alias2")
    direct = F.coalesce("_raw", "_cleaned", by_alias)
    found = found.select(
        "title", F.coalesce(direct, F.col("_cluster")).alias(code),
        F.when(F.col("_raw").isNotNull(), "raw").when(F.col("_cleaned").isNotNull(), "cleaned")
        .when(by_alias.isNotNull(), "alias").when(F.col("_cluster").isNotNull(), "cluster")
        .otherwise("miss").alias("match_method"),
        F.when(direct.isNull(), F.col("cluster_id")).alias("fallback_cluster"),
        F.when(direct.isNull(), F.col("purity")).alias("fallback_share"))
    return join_back(df, found, "title")


def join_back(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join of facts about distinct values; a null value is a value too."""
    facts = [f"f.{c}" for c in found.columns if c != key]
    return df.alias("d").join(found.alias("f"), F.col(f"d.{key}").eqNullSafe(F.col(f"f.{key}")), "left").select("d.*", *facts)


def override_code(title: Column, code: Column) -> Column:
    """Corrects systematic mismatches where the code is missing or suspect."""
    out = code
    suspect = code.isNull() | code.isin(*fixed.OVERRIDE_CODES)
    for word, right in reversed(fixed.TITLE_OVERRIDES):
        out = F.when(suspect & title.contains(word), right).otherwise(out)
    return out


def first_matches(values: DataFrame, text: Column, rules: DataFrame, name: str = "code") -> DataFrame:
    """`values` with the code of the first rule, by priority, whose keyword the text contains; else null.

    `rules` is a table (priority, keyword, code) of any size. Values should be
    distinct; each meets only the keywords that share an opening with it.
    """
    keyed = values.withColumn("_text", text)
    texts = keyed.select("_text").distinct()
    hits = contains_join(texts, "_text", rules.select("priority", "keyword", "code"), "keyword")
    first = hits.groupBy("_text").agg(F.min_by("code", F.struct("priority", "keyword")).alias(name))
    return join_back(keyed, first, "_text").drop("_text")


def classify_titles(df: DataFrame, rules: DataFrame, exposure: DataFrame) -> DataFrame:
    """Code, gradient and score of a title by a table of keyword rules (priority, keyword, code).

    Keywords are compared in lower case. A code without a score falls back to its
    major group; no rule gives 'unknown'.
    """
    code = "isco08_4digit"
    lowered = rules.withColumn("keyword", F.lower("keyword"))
    found = first_matches(df.select("title").distinct(), F.lower(F.trim(F.col("title"))), lowered, code)
    scored = found.join(
        exposure.select(code, "mean_score", "sd_score", "exposure_gradient"), code, "left")
    major = F.substring(code, 1, 1).try_cast("int")
    gradient = constant_lookup([(g, name) for g, name, _ in fixed.MAJOR_GROUP_FALLBACK], major)
    score = constant_lookup([(g, s) for g, _, s in fixed.MAJOR_GROUP_FALLBACK], major)
    has, known = F.col("mean_score").isNotNull(), F.col(code).isNotNull()
    name, value = fixed.FALLBACK_DEFAULT
    scored = scored.select(
        "title", code,
        F.when(has, F.col("exposure_gradient")).when(known, F.coalesce(gradient, F.lit(name)))
        .otherwise("unknown").alias("ai_exposure_gradient"),
        F.when(has, F.col("mean_score")).when(known, F.coalesce(score, F.lit(value)))
        .otherwise(fixed.UNKNOWN_SCORE).alias("ai_mean_score"),
        F.coalesce(F.col("sd_score"), F.lit(fixed.FALLBACK_SD)).alias("ai_sd_score"),
        F.when(has, "keyword").when(known, "keyword_noilo").otherwise("unknown")
        .alias("isco_match_method"))
    return join_back(df, scored, "title")


def classify_companies(df: DataFrame, rules: DataFrame, name: str = "company") -> DataFrame:
    """Industry of a company by a table of keyword rules (priority, keyword, code), retried without bracket signs."""
    c = F.col(name)
    once = first_matches(df.select(name).distinct(), c, rules, "_as_is")
    twice = first_matches(once, F.regexp_replace(c, "[（()）]", ""), rules, "_bare")
    found = twice.select(name, F.coalesce("_as_is", "_bare").alias("industry_code"))
    return join_back(df, found, name)


def ladder_industry(c: Column) -> Column:
    """Standard industry of a raw category by an ordered keyword ladder.

    `it` only counts as a word of its own.
    """
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[/|]", "_"), " ", "")
    word, code = fixed.INDUSTRY_LAST_RESORT
    out = F.when(s.contains(word), code).otherwise(fixed.INDUSTRY_UNKNOWN)
    for code, words in reversed(fixed.INDUSTRY_LADDER):
        pattern = alternation([w for w in words if w != "it"])
        if "it" in words:
            pattern += "|(?:^|[^a-z])it(?:[^a-z]|$)"
        out = F.when(s.rlike(pattern), code).otherwise(out)
    return F.coalesce(out, F.lit(fixed.INDUSTRY_UNKNOWN))


def resolve_industry(df: DataFrame, company_industry: DataFrame) -> DataFrame:
    """Industry with its source: company lookup, company name keyword or unknown."""
    table = company_industry.filter(F.col("standard_industry") != "U").select(
        "company", F.col("standard_industry").alias("_std"), F.col("confidence").alias("_conf"))
    by_name = ladder_industry(F.col("company"))
    return (
        df.join(table, "company", "left")
        .withColumn("industry_code", F.coalesce("_std", by_name))
        .withColumn("industry_confidence", F.coalesce("_conf", F.lit(0.0)))
        .withColumn("industry_source", F.when(F.col("_std").isNotNull(), "company_lookup")
                    .when(by_name != "U", "company_name_keyword").otherwise("unknown"))
        .drop("_std", "_conf"))


def score_industry(df: DataFrame, priors: DataFrame, primary: DataFrame) -> DataFrame:
    """Industry by weighted evidence, with its share of the score and its sources.

    `priors` and `primary` hold (company, code, confidence). Evidence is summed
    per distinct (company, title); ties go to the prior codes, then code order.
    """
    every = df.select("company", "title").distinct().withColumn(
        "company_key", titles.canonical_company(F.col("company")))

    def prior(table: DataFrame, name: str) -> DataFrame:
        return table.filter(F.col("code") != "U").select(
            F.col("company").alias("_k"), F.col("code").alias(f"{name}_code"),
            F.col("confidence").alias(f"{name}_conf"))

    for table, name in ((priors, "std"), (primary, "prim")):
        by_key = prior(table, name)
        by_name = by_key.select(*[F.col(c).alias(f"{c}2") for c in by_key.columns])
        every = (
            every.join(by_key, F.col("company_key") == F.col("_k"), "left").drop("_k")
            .join(by_name, F.col("company") == F.col("_k2"), "left").drop("_k2")
            .withColumn(f"{name}_conf", F.when(
                F.col(f"{name}_code").isNotNull(), F.col(f"{name}_conf")).otherwise(F.col(f"{name}_conf2")))
            .withColumn(f"{name}_code", F.coalesce(f"{name}_code", f"{name}_code2"))
            .drop(f"{name}_code2", f"{name}_conf2"))

    def hits(column: str, each: float) -> DataFrame:
        """Capped hit score per code of each distinct text."""
        c = F.lower(F.coalesce(F.col(column), F.lit("")))
        scores = [
            F.least(F.lit(fixed.MAX_HIT_SCORE), sum((c.contains(w).cast("int") for w in words), F.lit(0)) * each)
            for _, words in fixed.EVIDENCE_KEYWORDS]
        return df.select(column).distinct().select(
            F.col(column).alias(f"_{column}"), F.array(*scores).alias(f"{column}_hits"))

    for column, each in (("company", fixed.COMPANY_HIT), ("title", fixed.TITLE_HIT)):
        table = hits(column, each)
        every = every.join(table, F.col(column).eqNullSafe(F.col(f"_{column}")), "left").drop(f"_{column}")

    codes = F.array(*[F.lit(code) for code, _ in fixed.EVIDENCE_KEYWORDS])

    def prior_score(name: str, factor: float) -> Column:
        return factor * F.greatest(F.lit(fixed.MIN_PRIOR_CONF), F.col(f"{name}_conf"))

    def evidence(in_company: Column, i: Column) -> Column:
        code, in_title = F.get(codes, i), F.get("title_hits", i)
        is_std = F.coalesce(F.col("std_code") == code, F.lit(False))
        is_prim = F.coalesce(F.col("prim_code") == code, F.lit(False))
        score = (
            F.when(is_std, prior_score("std", fixed.PRIOR_WEIGHTS[0])).otherwise(0.0)
            + F.when(is_prim, prior_score("prim", fixed.PRIOR_WEIGHTS[1])).otherwise(0.0)
            + in_company + in_title)
        source = F.concat_ws(
            "|", F.when(is_std, "company_std_prior"), F.when(is_prim, "company_primary_prior"),
            F.when(in_company > 0, "company_name_keyword"), F.when(in_title > 0, "job_title_keyword"))
        place = F.when(is_std, 2).when(is_prim, 1).otherwise(-i)
        return F.struct(score.alias("score"), place.alias("place"), code.alias("code"), source.alias("source"))

    rows = F.filter(F.transform("company_hits", evidence), lambda r: r["score"] > 0)
    every = every.withColumn("_rows", rows)
    every = every.withColumn("_best", F.array_max("_rows")).withColumn(
        "_total", F.aggregate("_rows", F.lit(0.0), lambda a, r: a + r["score"]))
    scored = every.select(
        F.col("company").alias("_company"), F.col("title").alias("_title"),
        F.coalesce(F.col("_best.code"), F.lit("U")).alias("industry_code"),
        F.coalesce(F.col("_best.score") / F.nullif(F.col("_total"), F.lit(0.0)), F.lit(0.0)).alias("industry_confidence"),
        F.coalesce(F.col("_best.source"), F.lit("unmapped")).alias("industry_source"))
    same = F.col("company").eqNullSafe(F.col("_company")) & F.col("title").eqNullSafe(F.col("_title"))
    return df.join(scored, same, "left").drop("_company", "_title")


def majority(df: DataFrame, key: str, category: str) -> DataFrame:
    """Most frequent category per key with its share; ties go to the smaller category."""
    counts = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(
        F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias(category),
        (F.max("n") / F.sum("n")).alias("confidence"))


def clean_terms(labels: DataFrame, order: str) -> DataFrame:
    """Dictionary terms from preferred and alternative labels, first origin per term."""

    def clean(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"\(.*?\)|（.*?）", ""))

    kind, reuse = F.lower(F.coalesce("skillType", F.lit(""))), F.lower(F.coalesce("reuseLevel", F.lit("")))
    kind = (
        F.when(kind.contains("knowledge"), "knowledge")
        .when(kind.contains("skill") | kind.contains("competence"), "skill")
        .when(reuse.contains("transversal") | kind.contains("soft"), "soft").otherwise("unknown"))
    fits = F.length("term").between(2, 30)
    rows = (
        labels.filter(F.coalesce("preferredLabel", F.lit("")) != "")
        .withColumn("_pref", clean(F.col("preferredLabel")))
        .filter(F.length("_pref").between(2, 30))
        .withColumn("_terms", F.concat(
            F.array("_pref"), F.transform(F.split(F.coalesce("altLabels", F.lit("")), "\n"), clean)))
        .select(order, F.posexplode("_terms").alias("_pos", "term"),
                F.col("preferredLabel").alias("origin_label"), kind.alias("type"),
                "skillType", "reuseLevel")
        .filter(fits))
    return first_per_key(rows, ["term"], [order, "_pos"]).drop(order, "_pos")


def dictionary_counts(df: DataFrame, key: str, column: str, terms: DataFrame, term: str) -> DataFrame:
    """Number of different dictionary terms each text contains; both sides lower-cased."""
    words = terms.select(F.lower(term).alias("_term")).filter(F.length("_term") >= 2).distinct()
    known = known_words(words, "_term")
    if known is not None and keyed_once(df, key):  # counted where each text lies
        n = words_counted(known)(F.when(F.col(key).isNotNull(), F.lower(F.coalesce(column, F.lit("")))))
        return df.withColumn("skill_count", n)
    texts = df.select(key, F.lower(F.coalesce(column, F.lit(""))).alias("_t"))
    found = keyword_hits(texts, key, "_t", words, "_term").groupBy(key).agg(
        F.count(F.lit(1)).alias("skill_count"))
    return df.join(found, key, "left").fillna({"skill_count": 0})


def clean_seeds(df: DataFrame, platforms: Sequence[str], per_domain: int = fixed.SEED_PER_DOMAIN) -> DataFrame:
    """Seed URLs of known platforms, job-like ones first, capped per domain."""
    from ..functions import urls

    url, domain = F.trim(F.col("url")), F.lower(F.trim(F.col("domain")))
    platform = F.lower(F.trim(F.coalesce(F.nullif(F.trim("platform"), F.lit("")), F.lit("other"))))
    seeds = (
        df.withColumns({"url": url, "domain": domain, "platform": platform})
        .filter("url != '' and domain != ''"))
    seeds = first_per_key(seeds, ["domain", "url"], ["idx"])
    u = F.col("url")
    seeds = seeds.filter(urls.is_clean_seed(u, F.col("domain"), F.col("platform"), list(platforms)))
    order = [
        urls.is_root_path(u).cast("int"), (~urls.is_job_url(u)).cast("int"),
        (~u.contains("?")).cast("int"), F.length(u), F.col("domain"), u]
    return top_per_key(seeds, ["domain"], order, per_domain, rank="seed_rank")
