"""Row-quality predicates on the posting schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .text import alternation, count_hits, has_any, is_blank, parse_year, strip


def _salary(name: str) -> Column:
    c = F.col(name)
    return F.when(c.isNull(), F.lit(0.0)).otherwise(c.try_cast("double"))


def fake_rules() -> list[tuple[str, Column]]:
    """Ordered (reason, predicate) pairs; unparseable numbers reject nothing."""
    low, high = _salary("salary_min"), _salary("salary_max")
    both = low.isNotNull() & high.isNotNull()
    year = parse_year(F.col("publish_year"))
    description = F.col("description")

    def rule(p: Column) -> Column:
        return F.coalesce(p, F.lit(False))

    return [
        ("missing_company", is_blank(F.col("company"))),
        ("missing_title", is_blank(F.col("title"))),
        ("missing_city", is_blank(F.col("city"))),
        ("min_salary_low", rule(both & (low > 0) & (low < fixed.SALARY_MIN))),
        ("min_salary_high", rule(both & (low > fixed.SALARY_MAX))),
        ("max_salary_low", rule(both & (high > 0) & (high < fixed.SALARY_MIN))),
        ("max_salary_high", rule(both & (high > fixed.SALARY_MAX))),
        ("salary_order", rule(both & (low > 0) & (high > 0) & (low > high))),
        ("missing_description", description.isNull()),
        ("short_description",
         rule(F.length(strip(description)) < fixed.MIN_DESCRIPTION_CHARS)),
        ("year_early", rule((year > 0) & (year < fixed.YEAR_MIN))),
        ("year_late", rule(year > fixed.YEAR_MAX)),
    ]


def is_fake() -> Column:
    return reduce(lambda a, b: a | b, (p for _, p in fake_rules()))


def fake_reasons() -> Column:
    """Array of every reason that applies."""
    return F.filter(
        F.array(*[F.when(p, F.lit(name)) for name, p in fake_rules()]), lambda x: x.isNotNull())


def is_irrelevant() -> Column:
    city = F.coalesce(F.col("city"), F.lit(""))
    category = F.coalesce(strip(F.col("category")), F.lit(""))
    description = F.lower(F.coalesce(F.col("description"), F.lit("")))
    return (
        has_any(city, fixed.EXCLUDED_CITY_TERMS)
        | category.isin(*fixed.IRRELEVANT_CATEGORIES)
        | (count_hits(description, fixed.SPAM_KEYWORDS) >= fixed.MIN_SPAM_HITS)
    )


def is_domestic_city(c: Column, whitelist: tuple[str, ...] = ()) -> Column:
    """Whitelist, then foreign words, then province words, then an admin suffix."""
    s = F.lower(strip(c))
    rule = F.when(s.isNull() | (s == ""), False)
    if whitelist:
        rule = rule.when(s.isin(*[w.lower() for w in whitelist]), True)
    return (
        rule.when(has_any(s, fixed.FOREIGN_COUNTRIES + fixed.FOREIGN_CITIES), False)
        .when(has_any(s, fixed.PROVINCES), True)
        .otherwise(s.rlike(fixed.ADMIN_SUFFIX_PATTERN) & s.rlike("[一-龥]"))
    )


def window_of(year: Column) -> Column:
    """Two-year window label, null outside every window."""
    out = F.lit(None).cast("string")
    for start in fixed.WINDOW_STARTS:
        out = F.when(year.isin(start, start + 1), f"window_{start}_{start + 1}").otherwise(out)
    return out


def fresh_graduate() -> Column:
    """1 when experience, title or category marks a posting for graduates."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    category = text("category")
    hit = (
        has_any(text("experience"), fixed.FRESH_EXPERIENCE)
        | has_any(text("title"), fixed.FRESH_TITLE)
        | category.rlike("^(?:" + alternation(fixed.FRESH_CATEGORY_PREFIX) + ")")
        | has_any(category, fixed.FRESH_CATEGORY_CONTAINS)
    )
    return hit.cast("int")


def raw_category() -> Column:
    """Primary category, else the last part of the category unless it is an employment type."""
    primary = strip(F.coalesce(F.col("primary_category"), F.lit("")))
    category = strip(F.coalesce(F.col("category"), F.lit("")))
    return (
        F.when((primary != "") & (F.lower(primary) != "nan"), primary)
        .when(category.contains("<"), strip(F.substring_index(category, "<", -1)))
        .when(~category.isin("", *fixed.EMPLOYMENT_CATEGORIES), category)
        .otherwise("")
    )


def four_group(code: Column) -> Column:
    first = F.substring(F.trim(code), 1, 1)
    out = F.lit("Other")
    for name, codes in reversed(fixed.FOUR_GROUPS):
        out = F.when(first.isin(*codes), name).otherwise(out)
    return out
