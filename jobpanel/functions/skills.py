"""Keyword-driven scores per posting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import fixed
from .text import alternation, has_any, lookup
from .vec import constant

Levels = Mapping[int, Sequence[str]]


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Code of the first rule, in list order, whose keyword the text contains; else null.

    `rules` is a small constant table, so no join is needed.
    """
    table = constant([{"kw": k, "code": c} for k, c in rules], "array<struct<kw:string,code:string>>")
    return F.get(F.filter(table, lambda r: F.contains(text, r["kw"])), F.lit(0))["code"]


def matching_rules(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords contained in the text."""
    return F.filter(constant(list(keywords), "array<string>"), lambda k: F.contains(text, k))


def skill_score(
    description: Column, education: Column, keywords: Sequence[str], levels: Levels
) -> Column:
    """0 when no keyword occurs, else level 1-5 shifted by education.

    The highest level with a hit counts, 2 when none has one. Both sides are
    lower-cased, halves round to even.
    """
    text = F.lower(F.coalesce(description, F.lit("")))
    level = F.lit(2)
    for value in sorted(levels):
        level = F.when(has_any(text, [w.lower() for w in levels[value]]), value).otherwise(level)
    factor = F.coalesce(lookup(fixed.EDUCATION_FACTORS, education), F.lit(0.0))
    score = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(level + factor, 0)))
    return F.when(has_any(text, [w.lower() for w in keywords]), score.cast("int")).otherwise(0)


def skill_tags(
    description: Column, categories: Sequence[tuple[str, Sequence[str], Sequence[tuple[str, Sequence[str]]]]]
) -> Column:
    """Array of (category, level, keywords) for every category with a keyword hit.

    The level is the first, in the given order, that has an indicator in the text.
    """
    text = F.lower(F.coalesce(description, F.lit("")))
    rows = []
    for name, keywords, levels in categories:
        level = F.lit("未指定")
        for label, words in reversed(list(levels)):
            level = F.when(has_any(text, [w.lower() for w in words]), label).otherwise(level)
        found = F.filter(
            constant(list(keywords), "array<string>"), lambda k: F.contains(text, F.lower(k)))
        rows.append(F.when(F.size(found) > 0, F.struct(
            F.lit(name).alias("category"), level.alias("level"), found.alias("keywords"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def top_keywords(tags: Column) -> Column:
    """At most five keywords: two each of the first three categories."""
    firsts = F.transform(F.slice(tags, 1, 3), lambda t: F.slice(t["keywords"], 1, 2))
    return F.slice(F.flatten(firsts), 1, 5)


def overall_level(tags: Column, education: Column, experience: Column) -> Column:
    scores = F.transform(tags, lambda t: lookup(fixed.SKILL_LEVEL_SCORES, t["level"]))
    mean = F.when(
        F.size(tags) > 0,
        F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(tags)).otherwise(0.0)
    edu = F.coalesce(lookup(fixed.EDUCATION_LEVELS, education), F.lit(0))
    exp = F.coalesce(lookup(fixed.EXPERIENCE_LEVELS, experience), F.lit(0))
    value = edu * 0.3 + exp * 0.3 + mean * 0.4
    out = F.lit(fixed.OVERALL_LEVELS[-1][1])
    for bound, label in reversed(fixed.OVERALL_LEVELS[:-1]):
        out = F.when(value < bound, label).otherwise(out)
    return out


def task_counts(text: Column) -> dict[str, Column]:
    """Non-overlapping keyword hits per task class, longer keywords first."""
    t = F.coalesce(text, F.lit(""))
    return {name: F.regexp_count(t, F.lit(alternation(words))) for name, words in fixed.TASK_KEYWORDS}


def mentions_ai(title: Column) -> Column:
    words = alternation(fixed.AI_TITLE_TERMS)
    return F.coalesce(title, F.lit("")).rlike(f"(?iu){words}").cast("int")


def tokens_mention_ai(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in fixed.AI_TOKEN_TERMS])).cast("int")


def gated_weight(text: Column, keywords: Sequence[str]) -> Column:
    """0 / 0.3 / 0.6 / 1 by the number of keywords in the text."""
    hits = F.size(matching_rules(F.lower(text), [k.lower() for k in keywords]))
    steps = fixed.GATED_WEIGHTS
    return F.get(constant(list(steps)), F.least(hits, F.lit(len(steps) - 1)))


def topic_category(topic: Column) -> Column:
    return F.coalesce(lookup(list(fixed.TOPIC_CATEGORIES), topic), F.lit("M"))


def pair_coherence(verb: Column, noun: Column, verb_pos: Column, noun_pos: Column) -> Column:
    """Plausibility of a verb-noun pair from length, word class and known pairs."""
    pair = F.concat_ws("_", verb, noun)
    managed = verb.isin(*fixed.COHERENCE_MANAGEMENT_VERBS) & noun.isin(*fixed.COHERENCE_COMMON_NOUNS)
    worked = verb.isin(*fixed.COHERENCE_WORK_VERBS) & noun.isin(*fixed.COHERENCE_TRAIT_NOUNS)
    known = pair.isin(*["_".join(p) for p in fixed.COHERENCE_FIXED_PAIRS])
    tagged = verb_pos.startswith("v") & noun_pos.startswith("n")
    return (
        F.when((F.length(verb) < 2) | (F.length(noun) < 2), 0.1)
        .when(~F.coalesce(tagged, F.lit(False)), 0.3)
        .when(managed, 0.9)
        .when(worked, 0.8)
        .when(known, 0.1)
        .otherwise(0.5)
    )


def is_bad_pair(verb: Column, noun: Column, verb_pos: Column, noun_pos: Column) -> Column:
    """Fixed collocations, impossible word classes, short words, digits or brackets."""
    both = F.concat(verb, noun)
    pairs = [f"{v}_{n}" for v, n in fixed.FIXED_COLLOCATIONS]
    classes = (verb_pos.rlike("^v") & noun_pos.rlike("^[tmq]")) | (
        verb_pos.rlike("^r") & noun_pos.rlike("^n"))
    return (
        F.concat_ws("_", verb, noun).isin(pairs)
        | F.coalesce(classes, F.lit(False))
        | (F.length(verb) < 2) | (F.length(noun) < 2)
        | both.rlike(r"(?U)\d")
        | both.rlike("[()\\[\\]{}【】《》]")
    )
