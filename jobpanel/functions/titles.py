"""Job titles, company names and places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import alternation, squeeze, strip
from .vec import let

_MARK = "\u0001"


def clean_title(c: Column) -> Column:
    """Title without bracketed remarks, pay, perks and promotional words."""
    for pattern in (
        r"[（(][^)）]*[)）]",
        r"(?U)\d{3,}元?/?",
        r"[+➕].{0,20}$",
        r"/[包入无].{0,15}$",
        alternation(fixed.TITLE_PROMO_WORDS),
    ):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"^[ /\\\-—_·.，,]+|[ /\\\-—_·.，,]+$", "")


def canonical_company(c: Column) -> Column:
    """Company name without punctuation, country mark, legal form, branch and region.

    Suffixes go in rounds, a branch with its region first and then each suffix
    once in list order, until a round changes nothing; two characters stay.
    """
    region = alternation(fixed.REGION_PREFIXES)
    branch = alternation(fixed.BRANCH_SUFFIXES)

    def one_round(s: Column) -> Column:
        s = F.regexp_replace(s, f"(?s)^(.{{2,}}?)(?:{region})[市省区县]?(?:{branch})$", "$1")
        for suffix in (*fixed.LEGAL_SUFFIXES, *fixed.BRANCH_SUFFIXES):
            s = F.regexp_replace(s, f"(?s)^(.{{2,}}){suffix}$", "$1")
        return s

    def step(state: Column, _: Column) -> Column:
        changed = let(one_round(state["s"]), lambda new: F.struct(
            new.alias("s"), (new != state["s"]).alias("open")))
        return F.when(state["open"], changed).otherwise(state)

    def without_suffixes(s: Column) -> Column:
        start = F.struct(s.alias("s"), F.lit(True).alias("open"))
        return F.aggregate(F.sequence(F.lit(0), F.length(s)), start, step, lambda x: x["s"])

    s = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "（）【】“”‘’", "()[]\"\"''")
    s = F.regexp_replace(s, r"(?U)[\s·.,，。/\\|_\-;；:：!！?？\"'\[\]{}<>《》]+", "")
    s = F.regexp_replace(s, r"\(中国\)|\(china\)", "")
    s = F.replace(s, F.lit("()"), F.lit(""))
    s = let(s, without_suffixes)
    s = F.regexp_replace(s, f"(?s)^(?:(?:{region})[市省]?+(?=..))+", "")
    return F.regexp_replace(s, "^[市省]+", "")


def candidate(c: Column) -> Column:
    """A title candidate without trailing punctuation and leading label."""
    c = F.trim(F.regexp_replace(c, r"[ \t\r]+", " "))
    c = F.trim(F.regexp_replace(c, "[，,。；;：:]+$", ""))
    return F.trim(F.regexp_replace(c, r"^(岗位|职位)\s*[:：]\s*", ""))


def strict_candidate(c: Column) -> Column:
    c = F.regexp_replace(squeeze(c), r"(?U)^[：:·•\-\s]+|[，,。；;：:]+$", "")
    return strip(c)


def _starts_with(c: Column, prefixes) -> Column:
    return c.rlike("^(?:" + alternation(prefixes) + ")")


def _likely(s: Column) -> Column:
    return (
        F.length(s).between(2, 24)
        & (s.rlike(fixed.TITLE_HINT_PATTERN) | s.rlike(fixed.TITLE_ROLE_PATTERN)
           | s.rlike(fixed.TITLE_SUFFIX_PATTERN))
        & ~s.rlike("[。；;！!？?@]")
        & ~s.rlike(fixed.TITLE_NEGATIVE_PATTERN)
        & ~_starts_with(s, fixed.TITLE_FORBIDDEN_PREFIXES)
        & ~F.lower(s).contains("http")
    )


def is_likely_title(c: Column) -> Column:
    return let(candidate(c), _likely)


def is_strict_title(c: Column) -> Column:
    def rule(s: Column) -> Column:
        return (
            F.length(s).between(2, 30)
            & (s.rlike(fixed.STRICT_TITLE_HINT_PATTERN) | s.rlike(fixed.STRICT_TITLE_ENDINGS))
            & ~s.rlike("[。；;!?！？]")
            & ~s.rlike(fixed.STRICT_TITLE_NEGATIVE_PATTERN)
            & ~_starts_with(s, fixed.STRICT_TITLE_PREFIXES)
        )

    return let(strict_candidate(c), rule)


def is_strong_enumerated_title(c: Column) -> Column:
    return let(candidate(c), lambda s: (
        (F.length(s) <= 18)
        & _likely(s)
        & ~s.rlike(fixed.ENUM_VERB_PATTERN)
        & ~s.rlike("[，,；;。:：]")))


def unique_ignoring_case(items: Column) -> Column:
    """Distinct strings, the first spelling kept in place."""
    return let(items, lambda found: let(F.transform(found, F.lower), lambda keys: F.filter(
        found, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)))


def split_outside_brackets(c: Column) -> Column:
    """Split at separators that stand outside brackets; A/B between latin signs stays."""
    latin = "^[A-Za-z0-9+#]$"

    def mark(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            def rule(ch: Column) -> Column:
                depth = state["depth"]
                joined = (
                    (ch == "/") & F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(latin)
                    & F.coalesce(F.get(chars, i + 1), F.lit("")).rlike(latin))
                cut = (depth == 0) & ch.isin(*fixed.TITLE_SEPARATORS) & ~joined
                return F.struct(
                    (depth + F.when(ch.isin("（", "("), 1)
                     .when(ch.isin("）", ")") & (depth > 0), -1).otherwise(0)).alias("depth"),
                    F.concat(state["out"], F.when(cut, _MARK).otherwise(ch)).alias("out"))

            return let(F.get(chars, i), rule)

        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["out"])

    def marked(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda x: x != "")
        return F.when(s.rlike(f"[{fixed.TITLE_SEPARATORS}]"), let(chars, mark)).otherwise(s)

    return F.filter(F.transform(F.split(let(c, marked), _MARK), candidate), lambda p: p != "")


def split_titles(c: Column) -> Column:
    """Titles of a multi-title field."""
    return unique_ignoring_case(F.filter(split_outside_brackets(candidate(c)), is_likely_title))


def _at_least(items: Column, n: int) -> Column:
    return let(items, lambda x: F.when(F.size(x) >= n, x).otherwise(F.array().cast("array<string>")))


def split_titles_protected(c: Column) -> Column:
    """Strict variant: protected tokens survive, fewer than two titles give an empty array."""
    s = strict_candidate(c)
    for token in fixed.PROTECTED_TITLE_TOKENS:
        s = F.replace(s, F.lit(token), F.lit(token.replace("/", _MARK)))
    parts = F.transform(
        F.split(s, f"[{fixed.TITLE_SEPARATORS}]"),
        lambda p: strict_candidate(F.replace(p, F.lit(_MARK), F.lit("/"))))
    return _at_least(unique_ignoring_case(F.filter(parts, is_strict_title)), 2)


def title_parts(c: Column) -> Column:
    return F.transform(split_outside_brackets(strict_candidate(c)), strict_candidate)


def single_title(parts: Column) -> Column:
    """The one real title among the parts of a field whose others are noise, else null.

    A leading grade such as 高级 is joined to the title it modifies.
    """
    def choose(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        merged = strict_candidate(F.concat(first, F.get(p, F.lit(1))))
        graded = (F.size(p) == 2) & first.isin(*fixed.TITLE_MODIFIERS)
        return F.when(F.size(p) >= 2, let(
            F.filter(p, is_strict_title),
            lambda real: F.when(F.size(real) == 1, F.when(graded, merged).otherwise(F.get(real, F.lit(0))))))

    return let(parts, choose)


def _lines(c: Column, clean) -> Column:
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), clean), lambda x: x != "")


def _description_line(lines: Column) -> Column:
    """1-based index of the first line that opens the description, 0 if none."""
    flags = F.transform(lines, lambda x: x.startswith("职位描述"))
    return F.array_position(flags, F.lit(True)).cast("int")


def _numbered(block: Column, clean, accept) -> Column:
    mark = r"^\s*\d{1,2}[.、]\s*"
    return F.filter(
        F.transform(F.filter(block, lambda x: x.rlike(mark + ".+$")),
                    lambda x: clean(F.regexp_replace(x, mark, ""))), accept)


def titles_from_description(c: Column, field: Column | None = None, lines_read: int | None = None) -> Column:
    """Titles found in the title field, in numbered lines (two or more) or after a label.

    `lines_read` limits the lines behind the heading; by default the description is read to its end.
    """
    empty = F.array().cast("array<string>")
    labelled = F.filter(
        F.transform(
            F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)" + fixed.TITLE_LABEL_PATTERN), 1),
            candidate),
        is_likely_title)
    own = empty
    if field is not None:
        own = let(candidate(F.coalesce(field, F.lit(""))), lambda value: let(
            split_titles(value), lambda parts: F.when(F.size(parts) > 0, parts)
            .when(_likely(value), F.array(value)).otherwise(empty)))

    def search(lines: Column, at: Column) -> Column:
        block = F.when(at > 0, F.slice(lines, at + 1, _span(lines, lines_read))).otherwise(lines)
        found = F.concat(
            own, _at_least(_numbered(block, candidate, is_strong_enumerated_title), 2), labelled)
        following = candidate(F.regexp_replace(F.get(lines, at), r"^\d{1,2}[.、]\s*", ""))
        fallback = let(following, lambda x: F.when((at > 0) & _likely(x), F.array(x)).otherwise(empty))
        return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(fallback))

    return unique_ignoring_case(let(_lines(c, candidate), lambda lines: let(
        _description_line(lines), lambda at: search(lines, at))))


def _span(lines: Column, limit: int | None) -> Column:
    return F.greatest(F.size(lines), F.lit(1)) if limit is None else F.lit(limit)


def strict_titles_from_description(c: Column, lines_read: int | None = None) -> Column:
    """Numbered titles of a description, of its first lines if limited; at least two or none."""

    def search(lines: Column) -> Column:
        at = _description_line(F.slice(lines, 1, _span(lines, lines_read)))
        block = F.slice(lines, at + 1, _span(lines, lines_read))
        return unique_ignoring_case(_numbered(block, strict_candidate, is_strict_title))

    return _at_least(let(_lines(c, strict_candidate), search), 2)


def _extract(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, "(?i)" + pattern, 1), F.lit(""))


def extract_company(c: Column) -> Column:
    """First labelled value that looks like a company name, else ''."""

    def accepted(value: Column) -> Column:
        spaces = F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit("")))
        good = value.rlike(fixed.COMPANY_HINT_PATTERN) & (F.length(value) <= 40) & (spaces <= 3)
        return F.when(good, value)

    options = [let(candidate(_extract(c, p)), accepted) for p in fixed.COMPANY_LABEL_PATTERNS]
    return F.coalesce(*options, F.lit(""))


def extract_location(c: Column) -> Column:
    found = F.coalesce(*[_extract(c, p) for p in fixed.LOCATION_LABEL_PATTERNS], F.lit(""))
    return F.substring(candidate(found), 1, 80)


def extract_city(location: Column, text: Column, cities=fixed.CITIES) -> Column:
    """First city, in list order, named in the location or the text; else ''."""
    source = F.concat_ws("\n", F.nullif(location, F.lit("")), text)
    options = F.array(*[F.lit(x) for x in cities])
    return F.coalesce(F.get(F.filter(options, lambda x: F.contains(source, x)), F.lit(0)), F.lit(""))


def extract_region(location: Column, text: Column, city: Column) -> Column:
    area = "([^\\s,，;；]{1,12}(?:区|县|市))"
    source = F.concat_ws("\n", F.nullif(location, F.lit("")), text)
    in_location = F.nullif(candidate(F.regexp_extract(location, "(?U)" + area, 1)), F.lit(""))
    pattern = F.concat(F.lit("(?U)"), city, F.lit(area))
    found = F.call_function("regexp_extract", source, pattern, F.lit(1))
    after_city = F.when(city != "", candidate(found))
    return F.coalesce(in_location, after_city, F.lit(""))
