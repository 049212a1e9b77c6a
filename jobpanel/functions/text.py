"""Text expressions: cleaning, protected terms, sentences, tokens, parsers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import fixed
from .vec import let

_WS = r"(?U)\s"


def alternation(words: Iterable[str]) -> str:
    """Regex that matches any of `words`, longer ones first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def has_any(c: Column, words: Iterable[str]) -> Column:
    return c.rlike(alternation(words))


def count_hits(c: Column, words: Iterable[str]) -> Column:
    """Number of different words contained in `c`."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def strip(c: Column) -> Column:
    """Strip every kind of white space, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, _WS + "+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def lookup(pairs: Iterable[tuple], key: Column) -> Column:
    """Constant map lookup; unknown keys give null."""
    cells = [F.lit(v) for pair in pairs for v in pair]
    return F.try_element_at(F.create_map(*cells), key)


def parse_year(c: Column) -> Column:
    return c.try_cast("double").cast("int")


# --- cleaning ----------------------------------------------------------------

def strip_html(c: Column) -> Column:
    """Decode the named entities, drop tags, squeeze white space."""
    for entity, char in fixed.HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def _replace_terms(c: Column, terms: Iterable[tuple[str, str]]) -> Column:
    for old, new in sorted(terms, key=lambda t: len(t[0]), reverse=True):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def protect_symbol_terms(c: Column) -> Column:
    """Lower-case and spell out terms a letters-only filter would destroy."""
    return _replace_terms(F.lower(c), fixed.SYMBOL_TERMS)


def protect_numeric_terms(c: Column) -> Column:
    return _replace_terms(c, fixed.NUMERIC_TERMS)


def keep_han_latin(c: Column, lower: bool = True) -> Column:
    return F.trim(F.regexp_replace(F.lower(c) if lower else c, "[^a-z一-龥]+", " "))


def keep_han_latin_symbols(c: Column) -> Column:
    """Variant that keeps digits, capitals and the characters . + # - _"""
    return squeeze(F.regexp_replace(c, r"[^一-龥a-zA-Z0-9.+#\-_\s]", " "))


def normalize_for_shingles(c: Column) -> Column:
    """Han, Latin letters and digits only; taking these runs costs a tenth of replacing what lies between."""
    return F.array_join(F.regexp_extract_all(c, F.lit("[一-龥a-zA-Z0-9]+"), F.lit(0)), "")


# --- requirement section -----------------------------------------------------

_STARTS = list(fixed.REQUIREMENT_STARTS)
_ENDS = list(fixed.REQUIREMENT_ENDS)
_FLAGS = "(?sU)"
# where the first end lies: headings share their opening, which is tried once for all of them
_OPEN, _CLOSE = r"[【\[]?\s*", r"\s*[】\]]?"
_HEADED = [p for p in _ENDS if p.startswith(_OPEN) and p.endswith(_CLOSE)]
_NEAREST_END = _FLAGS + "|".join([
    _OPEN + "(?:" + "|".join(p[len(_OPEN):-len(_CLOSE)] for p in _HEADED) + ")",
    *[p for p in _ENDS if p not in _HEADED]])


def _needles(pattern: str) -> list[str]:
    """Literals of which every match of `pattern` holds one, so that a text without them need not be searched."""
    if "|" in re.sub(r"\([^()]*\)|\[[^\]]*\]", "", pattern):
        return []
    body = re.sub(r"^(?:\(\?:[^()]*\)\?|\[[^\]]*\]\?|\\s\*)+", "", pattern)
    group = re.match(r"\(\?:([^()\[\]\\|*+?]+(?:\|[^()\[\]\\|*+?]+)*)\)(?![?*{])", body)
    if group:
        return group[1].split("|")
    run = re.match(r"[^()\[\]{}\\|*+?.^$]+(?![?*{])", body)
    return [run[0]] if run else []


def _holds(c: Column, pattern: str) -> Column | None:
    """Whether `c` holds a literal of the pattern: a search for bytes, far cheaper than one for the pattern."""
    words = _needles(pattern)
    return reduce(or_, (c.contains(w) for w in words)) if words else None


def _occurs(c: Column, pattern: str) -> Column:
    held, found = _holds(c, pattern), c.rlike(_FLAGS + pattern)
    return found if held is None else held & found


def _unless_empty(c: Column) -> Column:
    """`c`, or null if it is empty; evaluated once, which `nullif` inside a lambda is not."""
    return let(c, lambda x: F.when(x != "", x))


def _first_pattern(c: Column, patterns: list[str]) -> Column:
    """First pattern, in list order, that occurs in `c`; null if none does."""
    options = F.array(*[F.lit(_FLAGS + p) for p in patterns])
    return F.get(F.filter(options, lambda p: F.rlike(c, p)), F.lit(0))


def _after(c: Column, pattern: Column) -> Column:
    end = F.regexp_instr(c, pattern) + F.length(F.regexp_substr(c, pattern))
    return c.substr(end, F.length(c))


def _marked_section(text: Column) -> Column:
    """Text from the first start heading (list order) to the nearest end heading."""
    def until_end(rest: Column) -> Column:
        at = F.regexp_instr(rest, F.lit(_NEAREST_END))
        return strip(let(at, lambda cut: F.when(cut > 0, rest.substr(F.lit(1), cut - 1)).otherwise(rest)))

    out = F.lit("")
    for p in reversed(_STARTS):
        rest = F.regexp_extract(text, f"{_FLAGS}^.*?(?:{p})(.*)$", 1)
        out = F.when(_occurs(text, p), let(rest, until_end)).otherwise(out)
    return out


def _listed_section(text: Column) -> Column:
    """Whole text that opens with list item one, without its duty part."""

    def without_duties(end: Column) -> Column:
        at = F.regexp_instr(text, end)
        before = strip(text.substr(F.lit(1), at - 1))
        behind = let(_after(text, end), lambda tail: strip(_after(tail, _first_pattern(tail, _STARTS))))
        return F.when(at - 1 < F.length(text) / 2, behind).otherwise(before)

    opens = text.rlike(r"(?U)^[1１一][\s、\.．：:]")
    part = let(_first_pattern(text, _ENDS), without_duties)
    return F.when(opens, F.coalesce(_unless_empty(part), text)).otherwise("")


def requirement_section(c: Column) -> Column:
    """Requirement part of a posting, before noise removal; '' when there is none."""
    words = alternation(fixed.SKILL_SENTENCE_WORDS)

    def body(text: Column) -> Column:
        skilled = F.filter(F.split(text, r"[。；\n]"), lambda s: s.rlike(words))
        found = F.coalesce(
            _unless_empty(_marked_section(text)),
            _unless_empty(_listed_section(text)),
            F.array_join(skilled, "。"))
        return F.when(F.length(text) < 10, "").otherwise(found)

    return let(strip(F.coalesce(c, F.lit(""))), body)


_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # (?U)\\s of Java


def _noise_remover():
    """Arrow function for `remove_noise`: a text is searched for a pattern only if it holds one of its literals."""
    steps = []
    for pattern in fixed.NOISE_PATTERNS:
        folded = bool(re.search("[a-z]{3}", pattern))
        literals = None if folded else _needles(pattern) or None
        steps.append((re.compile(pattern.replace(r"\s", f"[{_SPACES}]"), re.I | re.A if folded else 0).sub, literals, ""))
    for pattern in fixed.LIST_MARKER_PATTERNS:
        steps.append((re.compile(pattern.replace(r"\s", f"[{_SPACES}]")).sub, None, " "))
    spaces, marks = re.compile(f"[{_SPACES}]+").sub, re.compile("[，。；、]{2,}").sub
    white = "".join(x for x in map(chr, range(0x3001)) if re.match(f"[{_SPACES}]", x))

    def cleaned(text: str | None) -> str | None:
        if text is None:
            return None
        for sub, literals, new in steps:
            if literals is None or any(w in text for w in literals):
                text = sub(new, text)
        return marks("。", spaces(" ", text).strip(white)).strip("，。；、" + white)

    @F.arrow_udf("string")
    def remover(texts: pa.Array) -> pa.Array:
        return pa.array([cleaned(t) for t in texts.to_pylist()], pa.string())

    return remover


def remove_noise(c: Column, apart: bool = False) -> Column:
    """Text without perks, pay, hours, contacts and list markers; no part of a lambda or generator.

    With `apart`, Spark merges the column into no other step.
    """
    remover = _noise_remover()
    return (remover.asNondeterministic() if apart else remover)(c)


# --- sentences ---------------------------------------------------------------

def sentences(c: Column) -> Column:
    """Array of sentences; long ones are cut at Chinese commas."""
    breaks = f"(?U){fixed.SENTENCE_BREAK_PATTERN}|\\s{{2,}}|{fixed.SENTENCE_NUMBER_PATTERN}"

    def pieces(s: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(s, pattern), strip), lambda x: F.length(x) > 3)

    def commas(s: Column) -> Column:
        parts = pieces(s, "，")
        cut = s.contains("，") & (F.length(s) > 15) & (F.size(parts) > 0)
        return F.when(cut, parts).otherwise(F.array(s))

    return F.flatten(F.transform(pieces(F.coalesce(c, F.lit("")), breaks), commas))


def sentence_class(s: Column, dictionary_hit: Column | None = None) -> Column:
    """KEEP, DISCARD or REMOVE:<label>; the first rule that matches decides."""
    rules = [(s.rlike("(?U)" + p), f"REMOVE:{label}") for label, p in fixed.SENTENCE_REMOVE_RULES]
    rules += [(s.rlike(p), "KEEP") for p in fixed.SENTENCE_KEEP_PATTERNS]
    if dictionary_hit is not None:
        rules.append((dictionary_hit, "KEEP"))
    rules.append((s.rlike(fixed.SOFT_TRAIT_PATTERN), f"REMOVE:{fixed.SOFT_TRAIT_LABEL}"))
    out = F.lit("DISCARD")
    for hit, label in reversed(rules):
        out = F.when(hit, label).otherwise(out)
    return out


def kept_sentences(
    every: Column, dictionary_hit: Callable[[Column], Column] | None = None
) -> Column:
    return F.filter(
        every,
        lambda s: sentence_class(s, dictionary_hit(s) if dictionary_hit else None) == "KEEP")


# --- tokens ------------------------------------------------------------------

def runs(c: Column) -> Column:
    """Latin words and Han runs of an already lower-cased text."""
    return F.regexp_extract_all(c, F.lit("([a-z]+|[一-龥]+)"), 1)


def filter_tokens(
    tokens: Column,
    latin_blacklist: Iterable[str] = fixed.LATIN_BLACKLIST,
    han_stopwords: Iterable[str] = fixed.HAN_STOPWORDS,
) -> Column:
    blacklist, stopwords = list(latin_blacklist), list(han_stopwords)

    def keep(t: Column) -> Column:
        latin = F.when(F.length(t) == 1, t.isin(*fixed.SINGLE_LETTERS)).otherwise(~t.isin(blacklist))
        han = (F.length(t) >= 2) & ~t.isin(stopwords)
        return F.when(t.rlike("^[a-z]+$"), latin).when(t.rlike("[一-龥]"), han).otherwise(False)

    return F.filter(tokens, keep)


def filter_tokens_generic(tokens: Column, stopwords: Iterable[str] = fixed.HAN_STOPWORDS) -> Column:
    """Generic variant: at least two characters, no stop word, not a number or version."""
    words = [w.lower() for w in stopwords]
    return F.filter(
        tokens,
        lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(words) & ~t.rlike(r"(?U)^[\d.]+$"))


def latin_tokens(c: Column, **kw) -> Column:
    """Tokens of a text without dictionary segmentation (Han runs stay whole)."""
    return filter_tokens(runs(F.lower(c)), **kw)


def drop_gate_tokens(tokens: Column) -> Column:
    """Drop education and experience threshold words."""
    terms = list(fixed.GATE_TERMS)
    return F.filter(
        tokens, lambda t: ~(F.trim(t).isin(terms) | F.trim(t).rlike("(?U)" + "|".join(fixed.GATE_PATTERNS))))


# --- parsers -----------------------------------------------------------------

def experience_years(c: Column) -> Column:
    s = strip(c)

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(s, pattern, group).try_cast("double")

    return (
        F.when((s == "") | s.isin(*fixed.EXPERIENCE_ANY), F.lit(None).cast("double"))
        .when(s.isin(*fixed.EXPERIENCE_NONE), F.lit(0.0))
        .when(s.rlike(r"^\d+-\d+年"),
              (number(r"^(\d+)-(\d+)年") + number(r"^(\d+)-(\d+)年", 2)) / 2)
        .when(s.rlike(r"^\d+年以上"), number(r"^(\d+)年"))
        .when(s.rlike(r"^\d+年以下"), number(r"^(\d+)年") / 2)
        .when(s.rlike(r"^\d+年"), number(r"^(\d+)年"))
    )


def education_code(c: Column) -> Column:
    return lookup(fixed.EDUCATION_CODES, strip(c))


def proficiency_columns(c: Column) -> dict[str, Column]:
    """Depth of skill demand from proficiency modifiers (3 / 2.5 / 2 / 1)."""
    words = [w for w, _ in fixed.PROFICIENCY_WEIGHTS]
    found = F.regexp_extract_all(c, F.lit(f"({alternation(words)})"), 1)
    weights = F.transform(found, lambda w: lookup(fixed.PROFICIENCY_WEIGHTS, w))
    n = F.size(found)

    def ratio(x: Column) -> Column:
        return F.when(n > 0, x / n)

    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    high = F.size(F.filter(weights, lambda x: x >= fixed.PROFICIENCY_HIGH))
    return {
        "proficiency_mean": ratio(total),
        "proficiency_max": F.array_max(weights),
        "proficiency_count": n,
        "high_ratio": ratio(high),
    }
