"""Row expansion and filling of blank fields from extracted values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, titles
from ..functions.text import strip
from ..functions.vec import let

ITEM = "struct<company:string,title:string,city:string,district:string,location:string>"


def expand_titles(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """One row per title found; rows without one stay as they are.

    `n_titles` keeps how many rows a source row became.
    """
    found = titles.titles_from_description(F.col(description), F.col(title))
    out = df.withColumn("_titles", found).withColumn("n_titles", F.greatest(F.size("_titles"), F.lit(1)))
    return out.withColumn("_title", F.explode_outer("_titles")).withColumn(
        title, F.coalesce("_title", title)).drop("_titles", "_title")


def force_single_titles(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Rows with several real titles are split, those with one get it alone; copies leave."""
    blank = F.coalesce(strip(F.col(title)), F.lit("")) == ""

    def choose(parts: Column) -> Column:
        return let(titles.unique_ignoring_case(F.filter(parts, titles.is_strict_title)), lambda several: (
            F.when(F.size(several) >= 2, several).otherwise(F.array(titles.single_title(parts)))))

    chosen = F.when(blank, titles.strict_titles_from_description(F.col(description))).otherwise(
        let(titles.title_parts(F.col(title)), choose))
    out = df.withColumn("_titles", chosen).withColumn("_title", F.explode_outer("_titles"))
    return out.withColumn(title, F.coalesce("_title", title)).drop("_titles", "_title").dropDuplicates()


def fill_blank(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Sets a column only where it is blank and the value is not."""
    new = {f"_v_{c}": v for c, v in values.items()}
    out = df.withColumns(new)
    for c in values:
        blank = F.coalesce(strip(F.col(c)), F.lit("")) == ""
        fresh = F.coalesce(F.col(f"_v_{c}"), F.lit("")) != ""
        out = out.withColumn(c, F.when(blank & fresh, F.col(f"_v_{c}")).otherwise(F.col(c)))
    return out.drop(*new)


def fill_from_description(df: DataFrame, description: str = "description") -> DataFrame:
    """Blank company, location, city and district from labelled text."""
    text = F.coalesce(F.col(description), F.lit(""))
    staged = df.withColumn("_location", titles.extract_location(text)).withColumn(
        "_city", titles.extract_city(F.col("_location"), text))
    place = titles.extract_region(F.col("_location"), text, F.col("_city"))
    filled = fill_blank(staged, {
        "company": titles.extract_company(text), "location": F.col("_location"),
        "city": F.col("_city"), "district": place})
    return filled.drop("_location", "_city")


def _clean_value(c: Column, size: int) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), 1, size)


def parse_items(payload: Column) -> Column:
    """Array of items from a JSON array that may sit inside a code fence.

    Known aliases of a key are tried in order, empty items and copies leave.
    """
    text = F.regexp_replace(strip(F.coalesce(payload, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<map<string,string>>")

    def field(m: Column, names, size: int) -> Column:
        options = [F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names]
        return _clean_value(F.coalesce(*options, F.lit("")), size)

    items = F.transform(
        F.filter(F.coalesce(rows, F.array().cast("array<map<string,string>>")), lambda m: m.isNotNull()),
        lambda m: F.struct(*[field(m, names, size).alias(n) for n, names, size in fixed.ITEM_FIELDS]))
    names = [n for n, _, _ in fixed.ITEM_FIELDS]
    full = F.filter(items, lambda i: F.concat(*[i[n] for n in names]) != "")
    return unique_items(full)


def unique_items(items: Column) -> Column:
    names = [n for n, _, _ in fixed.ITEM_FIELDS]

    def key(i: Column) -> Column:
        return F.lower(F.concat_ws("\u0001", *[F.trim(i[n]) for n in names]))

    return let(F.transform(items, key), lambda keys: F.filter(
        items, lambda x, at: F.array_position(keys, key(x)) == at + 1))


def complete_items(items: Column, inferred: Column) -> Column:
    """Items with missing titles taken from the inferred ones and composite titles split."""
    names = [n for n, _, _ in fixed.ITEM_FIELDS]

    def with_title(i: Column, title: Column) -> Column:
        return F.struct(*[(title if n == "title" else i[n]).alias(n) for n in names])

    empty = F.struct(*[F.lit("").alias(n) for n in names])
    first = F.coalesce(F.get(items, F.lit(0)), empty)
    n, m = F.size(items), F.size(inferred)
    spread = (n == 0) | ((n == 1) & (F.trim(first["title"]) == "") & (m >= 2))

    def filled(i: Column, at: Column) -> Column:
        own = F.trim(i["title"])
        guess = F.when(m == 1, F.get(inferred, F.lit(0))).otherwise(F.get(inferred, at))
        return with_title(i, F.when(own == "", F.coalesce(guess, F.lit(""))).otherwise(i["title"]))

    whole = F.when(spread, F.transform(inferred, lambda t: with_title(first, t))).otherwise(
        F.transform(items, filled))

    def split(i: Column) -> Column:
        return let(titles.split_titles(i["title"]), lambda parts: F.when(
            F.size(parts) >= 2, F.transform(parts, lambda t: with_title(i, t))).otherwise(F.array(i)))

    return unique_items(F.flatten(F.transform(whole, split)))


def hybrid_items(df: DataFrame, cache: DataFrame, key: str = "row_id") -> DataFrame:
    """Items from the latest good cache record, else from rules; `item_source` tells which.

    `cache` holds (key, seq, ok, items). A good record without items counts
    apart from a missing or failed one.
    """
    from .dedup import latest_per_key

    latest = latest_per_key(cache, key, ["seq"]).select(key, F.col("ok").alias("_ok"), F.col("items").alias("_items"))
    inferred = titles.titles_from_description(F.col("description"), F.col("title"))
    names = [n for n, _, _ in fixed.ITEM_FIELDS]
    rules = F.transform(inferred, lambda t: F.struct(*[
        (t if n == "title" else F.lit("")).alias(n) for n in names]))
    good = F.coalesce(F.col("_ok"), F.lit(False))
    full = good & (F.size("_items") > 0)
    return (
        df.join(latest, key, "left")
        .withColumn("item_source", F.when(full, "cache").when(good, "cache_empty").otherwise("rules"))
        .withColumn("items", F.when(full, F.col("_items").cast(f"array<{ITEM}>")).otherwise(
            rules.cast(f"array<{ITEM}>")))
        .drop("_ok", "_items"))
