"""Text functions, classification rules, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, quality, skills, text, titles, urls
from ..functions.segment import MAX_DICTIONARY, embedder, segmenter
from ..functions.text import alternation
from ..operators import cleaning, enrich, lookup, panel, ranks, rule_index, tokens
from ..session import checkpoint
from ..sources import views
from ..sources.views import CAPTURES, DOCS, MATCHES, POSTINGS, SCORES, sql_list, table
from .cleaning import _CLEAN_TITLE, _STRIP_HTML, LOOKUPS, r6
from .registry import query

# --- shared SQL ---------------------------------------------------------------------------


def _fold(column: str, terms) -> str:
    for old, new in sorted(terms, key=lambda t: len(t[0]), reverse=True):
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''").replace("\\—", "—")


_NOISE = "{0}"
for _p in fixed.NOISE_PATTERNS:
    _NOISE = "regexp_replace(" + _NOISE + ", '" + _quoted(_p).replace("{", "{{").replace("}", "}}") + "', '', 'gi')"
for _p in fixed.LIST_MARKER_PATTERNS:
    _NOISE = "regexp_replace(" + _NOISE + ", '" + _quoted(_p).replace("{", "{{").replace("}", "}}") + "', ' ', 'g')"
_NOISE = "trim(regexp_replace(" + _NOISE + ", '\\s+', ' ', 'g'))"
_NOISE = "regexp_replace(" + _NOISE + ", '[，。；、]{{2,}}', '。', 'g')"
_NOISE = "regexp_replace(regexp_replace(" + _NOISE + ", '^[，。；、\\s]+', ''), '[，。；、\\s]+$', '')"

_BREAKS = _quoted(f"{fixed.SENTENCE_BREAK_PATTERN}|\\s{{2,}}|{fixed.SENTENCE_NUMBER_PATTERN}")
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
SENTENCES = POSTINGS + f""",
pieces AS (
  SELECT row_id, description, list_filter(list_transform(
    string_split_regex(coalesce(description, ''), '{_BREAKS}'), lambda s: {_TRIM.format("s")}),
    lambda s: length(s) > 3) AS parts FROM postings),
sents AS (
  SELECT row_id, description, flatten(list_transform(parts, lambda s:
    CASE WHEN contains(s, '，') AND length(s) > 15 AND len(list_filter(list_transform(
           string_split(s, '，'), lambda x: {_TRIM.format("x")}), lambda x: length(x) > 3)) > 0
         THEN list_filter(list_transform(string_split(s, '，'), lambda x: {_TRIM.format("x")}), lambda x: length(x) > 3)
         ELSE [s] END)) AS sentences FROM pieces)"""
_CLASS = "CASE " + " ".join(
    f"WHEN regexp_matches(s, '{_quoted(p)}') THEN 'REMOVE:{n}'" for n, p in fixed.SENTENCE_REMOVE_RULES)
_CLASS += " " + " ".join(f"WHEN regexp_matches(s, '{_quoted(p)}') THEN 'KEEP'" for p in fixed.SENTENCE_KEEP_PATTERNS)
_CLASS += (f" WHEN contains(s, 'Office') THEN 'KEEP' WHEN regexp_matches(s, '{fixed.SOFT_TRAIT_PATTERN}')"
           f" THEN 'REMOVE:{fixed.SOFT_TRAIT_LABEL}' ELSE 'DISCARD' END")


def _map_case(column: str, pairs, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN '{k}' THEN {repr(v) if isinstance(v, str) else v}" for k, v in pairs) + f" ELSE {default} END"


# --- text ----------------------------------------------------------------------------------

@query("txt1_strip_html", f"SELECT page_id, md5({_STRIP_HTML}) AS digest, length({_STRIP_HTML}) AS chars FROM pages")
def strip_html(spark, folder):
    c = text.strip_html(F.col("html"))
    return table(spark, folder, "pages").withColumn("c", c).select(
        "page_id", F.md5("c").alias("digest"), F.length("c").alias("chars"))


@query("txt2_symbol_terms", f"WITH {POSTINGS} SELECT row_id, {_fold('lower(description)', fixed.SYMBOL_TERMS)} AS t FROM postings")
def symbol_terms(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", text.protect_symbol_terms(F.col("description")).alias("t"))


@query("txt3_numeric_terms", f"WITH {POSTINGS} SELECT row_id, {_fold('lower(description)', fixed.NUMERIC_TERMS)} AS t FROM postings")
def numeric_terms(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", text.protect_numeric_terms(F.lower("description")).alias("t"))


@query("txt4_keep_han_latin", f"""
WITH {DOCS} SELECT id, md5(trim(regexp_replace(lower(text), '[^a-z一-龥]+', ' ', 'g'))) AS plain,
  md5(trim(regexp_replace(regexp_replace(text, '[^一-龥a-zA-Z0-9.+#\\-_\\s]', ' ', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g'))) AS symbols FROM docs""")
def keep_han_latin(spark, folder):
    return views.docs(spark, folder).select(
        "id", F.md5(text.keep_han_latin(F.col("text"))).alias("plain"),
        F.md5(text.keep_han_latin_symbols(F.col("text"))).alias("symbols"))


@query("txt5_requirement_section")
def requirement_section(spark, folder):
    return cleaning.extract_requirements(views.postings(spark, folder), "description").select(
        "row_id", "cleaned_requirements")


@query("txt6_remove_noise", f"WITH {POSTINGS} SELECT row_id, {_NOISE.format('description')} AS t FROM postings")
def remove_noise(spark, folder):
    return views.postings(spark, folder).select("row_id", text.remove_noise(F.col("description")).alias("t"))


@query("txt7_sentences", f"WITH {SENTENCES} SELECT row_id, array_to_string(sentences, '#') AS sentences FROM sents")
def sentences(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", F.array_join(text.sentences(F.col("description")), "#").alias("sentences"))


@query("txt8_sentence_class", f"""
WITH {SENTENCES} SELECT s AS sentence, {_CLASS} AS label, count(*) AS n
FROM (SELECT unnest(sentences) AS s FROM sents) GROUP BY s""")
def sentence_class(spark, folder):
    rows = views.postings(spark, folder).select(F.explode(text.sentences(F.col("description"))).alias("sentence"))
    counts = rows.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("sentence")
    return counts.withColumn("label", text.sentence_class(s, s.contains("Office")))


@query("txt9_skill_text", f"""
WITH {SENTENCES}, kept AS (
  SELECT *, list_filter(sentences, lambda s: {_CLASS} = 'KEEP') AS k FROM sents),
t AS (SELECT *, coalesce(array_to_string(k, '；'), '') AS skill_text FROM kept)
SELECT row_id, skill_text, CAST(length(skill_text) >= 10 AS INTEGER) AS has_skill_text, length(skill_text) AS skill_char_count,
  length(coalesce(description, '')) AS original_char_count, len(sentences) AS n_sentences_total, len(k) AS n_sentences_kept FROM t""")
def skill_text(spark, folder):
    rows = cleaning.with_skill_text(
        views.postings(spark, folder), "description", lambda s: s.contains("Office"))
    return rows.select(
        "row_id", "skill_text", "has_skill_text", "skill_char_count", "original_char_count",
        "n_sentences_total", "n_sentences_kept")


@query("txt10_tokens", f"WITH {views.TOKENS} SELECT id, md5(array_to_string(tokens, ' ')) AS digest, len(tokens) AS token_count FROM toks")
def document_tokens(spark, folder):
    rows = tokens.token_documents(views.docs(spark, folder), "text")
    return rows.select("id", F.md5(F.array_join("tokens", " ")).alias("digest"), "token_count")


@query("txt10_tokens_generic", f"""
WITH {DOCS} SELECT id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+|[一-龥]+'), lambda t:
  length(t) >= 2 AND t NOT IN ('the', 'and') AND NOT regexp_matches(t, '^[\\d.]+$'))) AS n FROM docs""")
def generic_tokens(spark, folder):
    kept = text.filter_tokens_generic(text.runs(F.lower("text")), ("the", "and"))
    return views.docs(spark, folder).select("id", F.size(kept).alias("n"))


@query("txt11_latin_statistics", f"""
WITH {DOCS}, t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM docs
  WHERE CAST('0x' || substr(md5(id || '|42'), 1, 8) AS BIGINT) < 0.1 * 4294967296)
SELECT term, count(*) AS n, CAST(length(term) AS INTEGER) AS length FROM t GROUP BY term""")
def latin_statistics(spark, folder):
    return tokens.latin_token_statistics(views.docs(spark, folder), "text")


@query("txt12_clean_title", f"WITH {POSTINGS} SELECT row_id, {_CLEAN_TITLE.format('title')} AS clean_title FROM postings")
def clean_title(spark, folder):
    return views.postings(spark, folder).select("row_id", titles.clean_title(F.col("title")).alias("clean_title"))


@query("txt13_canonical_company")
def canonical_company(spark, folder):
    rows = views.postings(spark, folder).select("company").distinct()
    return rows.withColumn("canonical", titles.canonical_company(F.col("company")))


@query("txt14_split_titles")
def split_titles(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", F.explode(titles.split_titles(F.col("title"))).alias("title"))


@query("txt15_protected_titles")
def protected_titles(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", F.array_join(titles.split_titles_protected(F.col("title")), "|").alias("titles"),
        titles.single_title(titles.title_parts(F.col("title"))).alias("single"))


_CAND = "trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({0}, '[ \\t\\r]+', ' ', 'g')), '[，,。；;：:]+$', '')), '^(岗位|职位)\\s*[:：]\\s*', ''))"


@query("txt16_title_likeness", f"""
WITH {POSTINGS}, c AS (SELECT row_id, {_CAND.format("title")} AS s FROM postings)
SELECT row_id, CAST(length(s) BETWEEN 2 AND 24 AND NOT regexp_matches(s, '^(?:{alternation(fixed.TITLE_FORBIDDEN_PREFIXES)})')
  AND NOT regexp_matches(s, '[。；;！!？?]') AND NOT contains(lower(s), 'http') AND NOT contains(s, '@')
  AND NOT regexp_matches(s, '{fixed.TITLE_NEGATIVE_PATTERN}')
  AND (regexp_matches(s, '{fixed.TITLE_HINT_PATTERN}') OR regexp_matches(s, '{fixed.TITLE_ROLE_PATTERN}')
       OR regexp_matches(s, '{fixed.TITLE_SUFFIX_PATTERN}')) AS INTEGER) AS likely FROM c""")
def title_likeness(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", titles.is_likely_title(F.col("title")).cast("int").alias("likely"))


_COMPANY = "''"
for _p in reversed(fixed.COMPANY_LABEL_PATTERNS):
    _v = _CAND.format(f"regexp_extract(d, '(?i){_p}', 1)")
    _COMPANY = (
        f"CASE WHEN regexp_matches({_v}, '{fixed.COMPANY_HINT_PATTERN}') AND length({_v}) <= 40 "
        f"AND length({_v}) - length(replace({_v}, ' ', '')) <= 3 THEN {_v} ELSE {_COMPANY} END")
_LOCATION = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(d, '(?i){p}', 1), '')" for p in fixed.LOCATION_LABEL_PATTERNS) + ", '')"


@query("txt17_field_extraction", f"""
WITH {POSTINGS}, a AS (SELECT row_id, coalesce(description, '') AS d FROM postings),
b AS (SELECT row_id, d, {_COMPANY} AS company, substr({_CAND.format(_LOCATION)}, 1, 80) AS location FROM a),
c AS (SELECT *, CASE WHEN location <> '' THEN location || chr(10) || d ELSE d END AS src FROM b),
e AS (SELECT *, coalesce(list_filter([{sql_list(fixed.CITIES)}], lambda x: contains(src, x))[1], '') AS city FROM c)
SELECT row_id, company, location, city, coalesce(nullif({_CAND.format("regexp_extract(location, '([^\\s,，;；]{1,12}(?:区|县|市))', 1)")}, ''),
  CASE WHEN city <> '' THEN {_CAND.format("regexp_extract(src, city || '([^\\s,，;；]{1,12}(?:区|县|市))', 1)")} END, '') AS region FROM e""")
def field_extraction(spark, folder):
    d = F.coalesce("description", F.lit(""))
    rows = views.postings(spark, folder).withColumn("location", titles.extract_location(d)).withColumn(
        "city", titles.extract_city(F.col("location"), d))
    return rows.select(
        "row_id", titles.extract_company(d).alias("company"), "location", "city",
        titles.extract_region(F.col("location"), d, F.col("city")).alias("region"))


@query("txt18_titles_from_description")
def titles_from_description(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", F.array_join(titles.titles_from_description(F.col("description"), F.col("title")), "|").alias("titles"),
        F.array_join(titles.strict_titles_from_description(F.col("description")), "|").alias("strict"))


_YEARS = f"""CASE WHEN s = '' OR s IN ({sql_list(fixed.EXPERIENCE_ANY)}) THEN NULL
  WHEN s IN ({sql_list(fixed.EXPERIENCE_NONE)}) THEN 0.0
  WHEN regexp_matches(s, '^\\d+-\\d+年') THEN (CAST(regexp_extract(s, '^(\\d+)-(\\d+)年', 1) AS DOUBLE) + CAST(regexp_extract(s, '^(\\d+)-(\\d+)年', 2) AS DOUBLE)) / 2
  WHEN regexp_matches(s, '^\\d+年以上') THEN CAST(regexp_extract(s, '^(\\d+)年', 1) AS DOUBLE)
  WHEN regexp_matches(s, '^\\d+年以下') THEN CAST(regexp_extract(s, '^(\\d+)年', 1) AS DOUBLE) / 2
  WHEN regexp_matches(s, '^\\d+年') THEN CAST(regexp_extract(s, '^(\\d+)年', 1) AS DOUBLE) END"""
_EDU = _map_case("trim(education)", fixed.EDUCATION_CODES)


@query("txt19_experience_years", f"WITH {POSTINGS} SELECT row_id, CAST({_YEARS} AS DOUBLE) AS years FROM (SELECT row_id, trim(experience) AS s FROM postings)")
def experience_years(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", text.experience_years(F.col("experience")).alias("years"))


@query("txt20_education_code", f"WITH {POSTINGS} SELECT row_id, {_EDU} AS edu FROM postings")
def education_code(spark, folder):
    return views.postings(spark, folder).select("row_id", text.education_code(F.col("education")).alias("edu"))


@query("txt21_platform", f"""
WITH {CAPTURES} SELECT idx, CASE {" ".join(f"WHEN regexp_matches(lower(domain), '{alternation(h)}') THEN '{n}'" for h, n in fixed.PLATFORM_HOSTS)}
  ELSE 'other' END AS platform FROM captures""")
def platform(spark, folder):
    return views.captures(spark, folder).select("idx", urls.platform_of_host(F.col("domain")).alias("platform"))


_PROF = alternation([w for w, _ in fixed.PROFICIENCY_WEIGHTS])
_WEIGHT = _map_case("w", fixed.PROFICIENCY_WEIGHTS)


@query("txt22_proficiency", f"""
WITH {POSTINGS}, f AS (SELECT row_id, coalesce(regexp_extract_all(description, '{_PROF}'), []) AS words FROM postings),
l AS (SELECT row_id, CAST({_WEIGHT} AS DOUBLE) AS x FROM (SELECT row_id, unnest(words) AS w FROM f))
SELECT f.row_id, round(avg(x), 6) AS proficiency_mean, max(x) AS proficiency_max, CAST(count(x) AS INTEGER) AS proficiency_count,
  round(avg(CASE WHEN x >= 2.5 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END), 6) AS high_ratio FROM f LEFT JOIN l ON f.row_id = l.row_id GROUP BY f.row_id""")
def proficiency(spark, folder):
    columns = text.proficiency_columns(F.coalesce("description", F.lit("")))
    rows = views.postings(spark, folder).withColumns(columns)
    return rows.select("row_id", r6("proficiency_mean"), "proficiency_max", "proficiency_count", r6("high_ratio"))


@query("txt23_dictionary_terms", """
WITH l AS (
  SELECT p_partkey, p_name || ' (' || p_type || ')' AS pref, p_type || chr(10) || p_brand || chr(10) || 'x' AS alt,
    CASE p_partkey % 3 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'skill/competence' ELSE '' END AS kind,
    CASE WHEN p_partkey % 2 = 0 THEN 'transversal' ELSE 'cross-sector' END AS reuse FROM part),
r AS (
  SELECT p_partkey, pref, kind, reuse, unnest([pref] || string_split(alt, chr(10))) AS raw, unnest(range(4)) AS pos FROM l),
t AS (SELECT *, trim(regexp_replace(raw, '\\(.*?\\)|（.*?）', '', 'g')) AS term FROM r)
SELECT term, pref AS origin_label, CASE WHEN kind LIKE '%knowledge%' THEN 'knowledge' WHEN kind LIKE '%skill%' THEN 'skill'
  WHEN reuse LIKE '%transversal%' THEN 'soft' ELSE 'unknown' END AS type
FROM t WHERE length(term) BETWEEN 2 AND 30 QUALIFY row_number() OVER (PARTITION BY term ORDER BY p_partkey, pos) = 1""")
def dictionary_terms(spark, folder):
    labels = table(spark, folder, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("preferredLabel"),
        F.concat_ws("\n", "p_type", "p_brand", F.lit("x")).alias("altLabels"),
        F.when(F.col("p_partkey") % 3 == 0, "knowledge").when(F.col("p_partkey") % 3 == 1, "skill/competence")
        .otherwise("").alias("skillType"),
        F.when(F.col("p_partkey") % 2 == 0, "transversal").otherwise("cross-sector").alias("reuseLevel"))
    return lookup.clean_terms(labels, "p_partkey").select("term", "origin_label", "type")


@query("udf4_embedding_hook", """
SELECT doc_id AS id, list_transform(['a', 'e', 'i', 'o'], lambda c: round((length(text) - length(replace(text, c, ''))) / greatest(1, length(text)), 9)) AS v FROM documents""")
def embedding_hook(spark, folder):
    """User function on text batches; here the shares of four letters."""
    embed = embedder(lambda batch: [[t.count(c) / max(1, len(t)) for c in "aeio"] for t in batch])
    return views.docs(spark, folder).select("id", F.transform(embed(F.col("text")), lambda x: F.round(x, 9)).alias("v"))


# --- classification ---------------------------------------------------------------------------

COMPANY_RULES = [("建筑", "E"), ("汽车", "C"), ("机械", "C"), ("家政", "O"), ("家具", "C"), ("有限", "C")]
TITLE_RULES = [("数据分析", "2009"), ("Java", "2012"), ("开发工程师", "2012"), ("销售", "2005"), ("会计", "2001"),
               ("翻译", "2021"), ("经理", "2010"), ("普工", "9329")]


def _rules_case(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{c}'" for k, c in rules) + " END"


def _rule_values(rules) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(rules)) + ") v(priority, keyword, code)"


def rule_table(spark, folder, rules, keyword, code):
    """The given rules, then one per part."""
    given = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(rules)], "priority long, keyword string, code string")
    return given.unionByName(table(spark, folder, "part").select(
        (F.col("p_partkey") + 100).cast("long").alias("priority"), keyword.alias("keyword"), code.alias("code")))


@query("cls1_company_industry", f"""
WITH {POSTINGS}, rules AS (SELECT * FROM {_rule_values(COMPANY_RULES[:2])} UNION ALL
  SELECT p_partkey + 100, p_partkey || '有限公司', chr(CAST(65 + p_partkey % 20 AS INTEGER)) FROM part),
c AS (SELECT DISTINCT company, regexp_replace(company, '[（()）]', '', 'g') AS bare FROM postings),
a AS (SELECT company, arg_min(code, priority) AS code FROM c JOIN rules ON contains(company, keyword) GROUP BY company),
b AS (SELECT company, arg_min(code, priority) AS code FROM c JOIN rules ON contains(bare, keyword) GROUP BY company)
SELECT row_id, coalesce(a.code, b.code) AS industry_code FROM postings p LEFT JOIN a ON a.company = p.company LEFT JOIN b ON b.company = p.company""")
def company_industry(spark, folder):
    number = F.col("p_partkey")
    rules = rule_table(
        spark, folder, COMPANY_RULES[:2], F.concat(number.cast("string"), F.lit("有限公司")), F.char((65 + number % 20).cast("long")))
    return lookup.classify_companies(views.postings(spark, folder), rules).select("row_id", "industry_code")


def _ladder(column: str) -> str:
    out = "CASE "
    for code, words in fixed.INDUSTRY_LADDER:
        pattern = alternation([w for w in words if w != "it"])
        if "it" in words:
            pattern += "|(?:^|[^a-z])it(?:[^a-z]|$)"
        out += f"WHEN regexp_matches({column}, '{pattern}') THEN '{code}' "
    return out + f"WHEN contains({column}, '服务') THEN 'O' ELSE 'U' END"


_NORM = "replace(regexp_replace(lower(trim({0})), '[/|]', '_', 'g'), ' ', '')"


@query("cls2_category_ladder", f"""
WITH {POSTINGS} SELECT row_id, {_ladder("s")} AS industry_code FROM (
  SELECT row_id, {_NORM.format("primary_category || ' ' || category")} AS s FROM postings)""")
def category_ladder(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", lookup.ladder_industry(F.concat_ws(" ", "primary_category", "category")).alias("industry_code"))


_RAW_CATEGORY = f"""CASE WHEN trim(primary_category) <> '' AND lower(trim(primary_category)) <> 'nan' THEN trim(primary_category)
  WHEN contains(category, '<') THEN trim(string_split(category, '<')[-1])
  WHEN category NOT IN ('', {sql_list(fixed.EMPLOYMENT_CATEGORIES)}) THEN category ELSE '' END"""


@query("cls3_raw_category", f"WITH {POSTINGS} SELECT row_id, {_RAW_CATEGORY} AS raw FROM postings")
def raw_category(spark, folder):
    return views.postings(spark, folder).select("row_id", quality.raw_category().alias("raw"))


VOTES = f"""votes AS (
  SELECT company, raw, count(*) AS n FROM (SELECT company, {_RAW_CATEGORY} AS raw FROM postings)
  WHERE raw <> '' AND company <> '' GROUP BY company, raw),
voted AS (
  SELECT company, raw, n / sum(n) OVER (PARTITION BY company) AS confidence FROM votes
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, raw) = 1),
company_industry AS (SELECT company, {_ladder(_NORM.format("raw"))} AS std, confidence FROM voted)"""


def voted_industries(spark, folder):
    rows = views.postings(spark, folder).withColumn("raw", quality.raw_category())
    votes = lookup.majority(rows.filter("raw != '' and company != ''"), "company", "raw")
    return votes.withColumn("standard_industry", lookup.ladder_industry(F.col("raw")))


@query("cls4_industry_resolution", f"""
WITH {POSTINGS}, {VOTES}, r AS (
  SELECT row_id, c.std, c.confidence, {_ladder(_NORM.format("p.company"))} AS by_name
  FROM postings p LEFT JOIN company_industry c ON c.company = p.company AND c.std <> 'U')
SELECT row_id, coalesce(std, by_name, 'U') AS industry_code, round(coalesce(confidence, 0.0), 6) AS industry_confidence,
  CASE WHEN std IS NOT NULL THEN 'company_lookup' WHEN by_name <> 'U' THEN 'company_name_keyword' ELSE 'unknown' END AS industry_source FROM r""")
def industry_resolution(spark, folder):
    out = lookup.resolve_industry(views.postings(spark, folder), voted_industries(spark, folder))
    return out.select("row_id", "industry_code", r6("industry_confidence"), "industry_source")


_REGION = alternation(fixed.REGION_PREFIXES)
_AFFIX = (f"(?:(?:{_REGION})[市省区县]?(?:{alternation(fixed.BRANCH_SUFFIXES)})|{alternation(fixed.LEGAL_SUFFIXES)}"
          f"|{alternation(fixed.BRANCH_SUFFIXES)})")
# enough for the names of the view: no name there ends inside a region prefix
_CANON = "replace(replace(lower(trim({0})), '（', '('), '）', ')')"
_CANON = f"replace(replace(regexp_replace({_CANON}, '[\\s·.,，。_;；:：-]+', '', 'g'), '(中国)', ''), '()', '')"
_CANON = f"regexp_replace(regexp_replace({_CANON}, '^(.{{{{2,}}}}?){_AFFIX}+$', '\\1'), '^(?:(?:{_REGION})[市省]?)+(..)', '\\1')"

_EVIDENCE = ", ".join(
    f"({i}, '{code}', '{w}')" for i, (code, words) in enumerate(fixed.EVIDENCE_KEYWORDS) for w in words)


@query("cls5_weighted_industry", f"""
WITH {POSTINGS}, {VOTES},
kw AS (SELECT * FROM (VALUES {_EVIDENCE}) t(pos, code, word)),
u AS (SELECT DISTINCT company, title FROM postings),
hit AS (
  SELECT u.company, u.title, pos, code, least(1.0, 0.35 * count(*) FILTER (contains(lower(coalesce(u.company, '')), word))) AS hc,
    least(1.0, 0.30 * count(*) FILTER (contains(lower(coalesce(u.title, '')), word))) AS ht FROM u, kw GROUP BY 1, 2, 3, 4),
ev AS (
  SELECT h.*, CASE WHEN coalesce(k.std, c.std) = h.code
    THEN 2.0 * greatest(0.1, CASE WHEN k.std IS NOT NULL THEN k.confidence ELSE c.confidence END) ELSE 0.0 END AS prior
  FROM hit h LEFT JOIN company_industry c ON c.company = h.company AND c.std <> 'U'
  LEFT JOIN company_industry k ON k.company = {_CANON.format("h.company")} AND k.std <> 'U'),
sc AS (SELECT *, hc + ht + prior AS score FROM ev WHERE hc + ht + prior > 0),
best AS (
  SELECT company, title, code, score / sum(score) OVER (PARTITION BY company, title) AS conf,
    concat_ws('|', CASE WHEN prior > 0 THEN 'company_std_prior' END, CASE WHEN hc > 0 THEN 'company_name_keyword' END,
      CASE WHEN ht > 0 THEN 'job_title_keyword' END) AS source,
    row_number() OVER (PARTITION BY company, title ORDER BY round(score, 9) DESC, CASE WHEN prior > 0 THEN -1 ELSE pos END) AS rn
  FROM sc)
SELECT row_id, coalesce(b.code, 'U') AS industry_code, round(coalesce(conf, 0.0), 6) AS confidence, coalesce(source, 'unmapped') AS source
FROM postings p LEFT JOIN best b ON b.company IS NOT DISTINCT FROM p.company AND b.title IS NOT DISTINCT FROM p.title AND rn = 1""")
def weighted_industry(spark, folder):
    priors = checkpoint(voted_industries(spark, folder).select(
        "company", F.col("standard_industry").alias("code"), "confidence"))
    empty = spark.createDataFrame([], priors.schema)
    out = lookup.score_industry(views.postings(spark, folder), priors, empty)
    return out.select("row_id", "industry_code", F.round("industry_confidence", 6).alias("confidence"),
                      F.col("industry_source").alias("source"))


@query("cls6_title_rules", f"""
WITH {POSTINGS}, {SCORES}, rules AS (SELECT * FROM {_rule_values(TITLE_RULES)} UNION ALL
  SELECT p_partkey + 100, p_name, '2' || lpad(replace(p_brand, 'Brand#', ''), 3, '0') FROM part),
t AS (SELECT title, arg_min(code, (priority, keyword)) AS code FROM (SELECT DISTINCT title FROM postings) JOIN rules ON contains(lower(trim(title)), lower(keyword)) GROUP BY title),
r AS (SELECT row_id, t.code FROM postings p LEFT JOIN t ON t.title IS NOT DISTINCT FROM p.title)
SELECT row_id, r.code AS isco08_4digit, CASE WHEN s.mean_score IS NOT NULL THEN s.exposure_gradient WHEN r.code IS NULL THEN 'unknown'
    WHEN substr(r.code, 1, 1) = '2' THEN 'Minimal Exposure' ELSE 'Not Exposed' END AS gradient,
  round(CASE WHEN s.mean_score IS NOT NULL THEN s.mean_score WHEN r.code IS NULL THEN 0.25 WHEN substr(r.code, 1, 1) = '2' THEN 0.38 ELSE 0.21 END, 6) AS score,
  CASE WHEN s.mean_score IS NOT NULL THEN 'keyword' WHEN r.code IS NULL THEN 'unknown' ELSE 'keyword_noilo' END AS method
FROM r LEFT JOIN scores s ON s.isco08_4digit = r.code""")
def title_rules(spark, folder):
    rules = rule_table(
        spark, folder, TITLE_RULES, F.col("p_name"), F.concat(F.lit("2"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 3, "0")))
    out = lookup.classify_titles(views.postings(spark, folder), rules, views.code_scores(spark, folder))
    return out.select("row_id", "isco08_4digit", F.col("ai_exposure_gradient").alias("gradient"),
                      F.round("ai_mean_score", 6).alias("score"), F.col("isco_match_method").alias("method"))


@query("cls7_keyword_override", f"""
WITH {POSTINGS} SELECT row_id, CASE WHEN (code IS NULL OR code IN ('2353', '2330')) AND contains(title, '翻译') THEN '2643' ELSE code END AS code
FROM (SELECT row_id, title, CASE row_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '2353' ELSE '2001' END AS code FROM postings)""")
def keyword_override(spark, folder):
    code = F.when(F.col("row_id") % 3 == 1, "2353").when(F.col("row_id") % 3 == 2, "2001")
    return views.postings(spark, folder).select(
        "row_id", lookup.override_code(F.col("title"), code).alias("code"))


DOMINANCE = """profile AS (
  SELECT CAST(p_size AS BIGINT) AS cluster_id, '2' || lpad(replace(p_brand, 'Brand#', ''), 3, '0') AS isco08_4digit, count(*) AS n
  FROM part GROUP BY 1, 2),
dominance AS (
  SELECT cluster_id, isco08_4digit, support, n / support AS purity FROM (
    SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS support,
      row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, isco08_4digit) AS rn
    FROM profile WHERE cluster_id NOT IN (5, 6, 9, 43, 51, 74, -1))
  WHERE rn = 1 AND support >= 20 AND n / support >= 0.1 AND isco08_4digit IN (SELECT isco08_4digit FROM scores))"""


def dominance(spark, folder):
    code = F.concat(F.lit("2"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 3, "0"))
    profile = table(spark, folder, "part").groupBy(
        F.col("p_size").cast("bigint").alias("cluster_id"), code.alias("isco08_4digit")).agg(
        F.count(F.lit(1)).alias("n"))
    return lookup.cluster_dominance(profile, views.code_scores(spark, folder), 0.1, 20)


@query("cls8_title_match", f"""
WITH {LOOKUPS}, {DOMINANCE},
alias AS (SELECT DISTINCT p_type AS title, '2' || lpad(replace(min(p_brand), 'Brand#', ''), 3, '0') AS isco08_4digit FROM part GROUP BY p_type),
tc AS (SELECT p_name AS title, CAST(max(p_size) AS BIGINT) AS cluster_id FROM part GROUP BY p_name),
ask AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '（双休）' WHEN 2 THEN p_type ELSE p_name || p_brand END AS title FROM part),
c AS (SELECT *, {_CLEAN_TITLE.format("title")} AS ct FROM ask),
j AS (
  SELECT c.p_partkey, c.title, r.isco08_4digit AS r, k.isco08_4digit AS k, coalesce(a.isco08_4digit, b.isco08_4digit) AS al, d.isco08_4digit AS cl
  FROM c LEFT JOIN raw_isco r ON r.title = c.title LEFT JOIN clean_isco k ON k.clean_title = c.ct
  LEFT JOIN alias a ON a.title = c.title LEFT JOIN alias b ON b.title = c.ct
  LEFT JOIN tc ON tc.title = c.ct LEFT JOIN dominance d ON d.cluster_id = tc.cluster_id)
SELECT p_partkey, coalesce(r, k, al, cl) AS isco08_4digit, CASE WHEN r IS NOT NULL THEN 'raw' WHEN k IS NOT NULL THEN 'cleaned'
  WHEN al IS NOT NULL THEN 'alias' WHEN cl IS NOT NULL THEN 'cluster' ELSE 'miss' END AS match_method FROM j""")
def title_match(spark, folder):
    part = table(spark, folder, "part")
    scores = views.code_scores(spark, folder)
    raw, cleaned = lookup.title_tables(views.title_matches(spark, folder), scores, "part_id")
    alias = part.groupBy(F.col("p_type").alias("title")).agg(F.concat(
        F.lit("2"), F.lpad(F.replace(F.min("p_brand"), F.lit("Brand#"), F.lit("")), 3, "0")).alias("isco08_4digit"))
    clusters = part.groupBy(F.col("p_name").alias("title")).agg(F.max("p_size").cast("bigint").alias("cluster_id"))
    k = F.col("p_partkey") % 4
    ask = part.select("p_partkey", F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("（双休）")))
                      .when(k == 2, F.col("p_type")).otherwise(F.concat("p_name", "p_brand")).alias("title"))
    out = lookup.match_titles(ask, raw, cleaned, alias, clusters, dominance(spark, folder))
    return out.select("p_partkey", "isco08_4digit", "match_method")


@query("cls9_cluster_dominance", f"WITH {SCORES}, {DOMINANCE} SELECT cluster_id, isco08_4digit, CAST(support AS BIGINT) AS support, round(purity, 6) AS purity FROM dominance")
def cluster_dominance(spark, folder):
    return dominance(spark, folder).select("cluster_id", "isco08_4digit", "support", r6("purity"))


# small tables in the shape of the full skill dimensions, which callers pass in
DIMENSIONS = {
    "communication": (["沟通", "交流", "协调", "汇报"], {
        1: ["配合", "记录"], 2: ["接待", "回复"], 3: ["协调", "需求分析"], 4: ["谈判"], 5: ["战略合作"]}),
    "software": (["office", "excel", "python", "java", "编程"], {
        1: ["会使用"], 2: ["熟练", "excel"], 3: ["熟练掌握", "精通"], 4: ["编程", "开发"], 5: ["架构"]}),
}


# the given tables and, up to 19 dimensions, every two-character piece of the descriptions in one by its code points
DIMENSION_NAMES = [*DIMENSIONS, *[f"d{k}" for k in range(3, 20)]]
_PIECES = """pieces AS (
  SELECT DISTINCT keyword, unicode(keyword) AS a, unicode(substring(keyword, 2)) AS b FROM (
    SELECT substring(d, i, 2) AS keyword FROM (
      SELECT d, unnest(range(1, length(d))) AS i FROM (SELECT DISTINCT lower(coalesce(description, '')) AS d FROM postings)))
  WHERE regexp_matches(keyword, '^[一-龥]{2}$'))"""


def description_pieces(rows):
    text_ = F.lower(F.coalesce("description", F.lit("")))
    return rows.select(text_.alias("d")).distinct().select(
        F.explode(F.regexp_extract_all("d", F.lit("(?=([一-龥]{2}))"), 1)).alias("keyword")).distinct().select(
        "keyword", F.ascii("keyword").alias("a"), F.ascii(F.substring("keyword", 2, 1)).alias("b"))


def dimension_rules(spark, rows):
    given = [(name, 0, k) for name, (words, _) in DIMENSIONS.items() for k in words]
    given += [(name, n, k) for name, (_, levels) in DIMENSIONS.items() for n, words in levels.items() for k in words]
    own = description_pieces(rows).select(
        F.concat(F.lit("d"), (3 + (F.col("a") + F.col("b")) % 17).cast("string")).alias("dimension"),
        (F.col("b") % 6).cast("int").alias("level"), "keyword")
    return spark.createDataFrame(given, "dimension string, level int, keyword string").unionByName(own)


_GIVEN_RULES = ", ".join(
    f"('{name}', {n}, '{k}')" for name, (words, levels) in DIMENSIONS.items()
    for n, ks in [(0, words), *levels.items()] for k in ks)
SKILL_SCORES = POSTINGS + f""",
p AS (SELECT row_id, education, title, lower(coalesce(description, '')) AS d FROM postings), {_PIECES},
rules AS (SELECT * FROM (VALUES {_GIVEN_RULES}) v(dimension, level, keyword)
  UNION ALL SELECT 'd' || (3 + (a + b) % 17), b % 6, keyword FROM pieces),
levels AS (SELECT row_id, dimension, max(level) AS top FROM p JOIN rules ON contains(d, keyword) GROUP BY row_id, dimension HAVING min(level) = 0),
l AS (
  SELECT p.row_id, education, title, skill, CASE WHEN top IS NULL THEN 0 ELSE CAST(greatest(1, least(5, round_even(
    CASE top WHEN 0 THEN 2 ELSE top END + {_map_case("education", fixed.EDUCATION_FACTORS, "0.0")}, 0))) AS INTEGER) END AS score
  FROM p CROSS JOIN (SELECT unnest([{sql_list(DIMENSION_NAMES)}]) AS skill) n LEFT JOIN levels v ON v.row_id = p.row_id AND v.dimension = n.skill)"""


def scored_postings(spark, folder):
    rows = checkpoint(views.postings(spark, folder).select("row_id", "education", "title", "description"))
    return rule_index.skill_scores(rows, "row_id", "description", "education", dimension_rules(spark, rows), DIMENSION_NAMES)


@query("cls10_skill_scores", f"""
WITH {SKILL_SCORES} SELECT row_id, {", ".join(f"max(CASE WHEN skill = '{n}' THEN score END) AS {n}" for n in DIMENSION_NAMES)} FROM l GROUP BY row_id""")
def skill_scores(spark, folder):
    """All 19 dimensions."""
    return scored_postings(spark, folder).select("row_id", *DIMENSION_NAMES)


CATEGORIES = [
    ("communication", ["沟通", "客户", "协调"], [("初级", ["协助"]), ("中级", ["负责", "独立"]), ("高级", ["管理"])]),
    ("digital", ["Excel", "Python", "Java", "Office"], [("初级", ["熟悉", "了解"]), ("中级", ["熟练", "精通"]), ("高级", ["架构"])]),
    ("analysis", ["分析", "数据", "报表"], [("初级", ["收集"]), ("中级", ["分析", "汇总"]), ("高级", ["决策"])]),
]


LEVEL_LABELS = ["初级", "中级", "高级"]
CATEGORY_NAMES = [*[c[0] for c in CATEGORIES], *[f"c{k}" for k in range(4, 11)]]


def category_rules(spark, rows):
    """The given categories, then seven of the pieces of the descriptions."""
    given, n = [], 0
    for place, (name, words, levels) in enumerate(CATEGORIES):
        for level, ks in [(0, words), *[(LEVEL_LABELS.index(lv) + 1, ks) for lv, ks in levels]]:
            for k in ks:
                given.append((place, name, level, n, k))
                n += 1
    place = 3 + (F.col("a") * 3 + F.col("b")) % 7
    own = description_pieces(rows).select(
        place.cast("int").alias("place"), F.concat(F.lit("c"), (place + 1).cast("string")).alias("category"),
        (F.col("b") % 4).cast("int").alias("level"), (1000 + F.col("a")).cast("int").alias("priority"), "keyword")
    return spark.createDataFrame(given, "place int, category string, level int, priority int, keyword string").unionByName(own)


def _given_categories() -> str:
    out, n = [], 0
    for place, (name, words, levels) in enumerate(CATEGORIES):
        for level, ks in [(0, words), *[(LEVEL_LABELS.index(lv) + 1, ks) for lv, ks in levels]]:
            for k in ks:
                out.append(f"({place}, '{name}', {level}, {n}, '{k}')")
                n += 1
    return ", ".join(out)


@query("cls11_skill_tags", f"""
WITH {POSTINGS}, p AS (SELECT row_id, trim(education) AS education, experience, lower(coalesce(description, '')) AS d FROM postings), {_PIECES},
rules AS (SELECT * FROM (VALUES {_given_categories()}) v(place, category, level, priority, keyword)
  UNION ALL SELECT 3 + (a * 3 + b) % 7, 'c' || (4 + (a * 3 + b) % 7), b % 4, 1000 + a, keyword FROM pieces),
h AS (
  SELECT row_id, place, category, coalesce(list(keyword ORDER BY priority, keyword) FILTER (level = 0), []) AS found, min(level) FILTER (level > 0) AS lv
  FROM p JOIN rules ON contains(d, lower(keyword)) GROUP BY row_id, place, category),
g AS (
  SELECT row_id, list({{'name': category, 'level': CASE lv WHEN 1 THEN '初级' WHEN 2 THEN '中级' WHEN 3 THEN '高级' ELSE '未指定' END, 'found': found}} ORDER BY place) AS tags
  FROM h WHERE len(found) > 0 GROUP BY row_id),
s AS (
  SELECT p.*, tags, coalesce(list_avg(list_transform(tags, lambda x: CASE x.level WHEN '初级' THEN 1.0 WHEN '中级' THEN 2.0 WHEN '高级' THEN 3.0 ELSE 0.0 END)), 0.0) AS lv
  FROM p LEFT JOIN g ON g.row_id = p.row_id),
v AS (
  SELECT *, {_map_case("education", fixed.EDUCATION_LEVELS, "0")} * 0.3::DOUBLE + {_map_case("experience", fixed.EXPERIENCE_LEVELS, "0")} * 0.3::DOUBLE + lv::DOUBLE * 0.4::DOUBLE AS value FROM s)
SELECT row_id, coalesce(array_to_string(list_transform(tags, lambda x: x.name || '(' || x.level || ')'), '; '), '') AS tags,
  coalesce(array_to_string(list_slice(flatten(list_transform(list_slice(tags, 1, 3), lambda x: list_slice(x.found, 1, 2))), 1, 5), ', '), '') AS top_keywords,
  CASE WHEN value < 1.5::DOUBLE THEN '初级' WHEN value < 2.5::DOUBLE THEN '中级' WHEN value < 3.5::DOUBLE THEN '高级' ELSE '专家' END AS overall FROM v""")
def skill_tags(spark, folder):
    """All ten categories."""
    rows = checkpoint(views.postings(spark, folder).select("row_id", "education", "experience", "description"))
    rows = rule_index.skill_tags(rows, "row_id", "description", category_rules(spark, rows), LEVEL_LABELS)
    return rows.select(
        "row_id", F.array_join(F.transform("tags", lambda x: F.concat(x["category"], F.lit("("), x["level"], F.lit(")"))), "; ").alias("tags"),
        F.array_join(skills.top_keywords(F.col("tags")), ", ").alias("top_keywords"),
        skills.overall_level(F.col("tags"), F.trim("education"), F.col("experience")).alias("overall"))


@query("cls12_score_report", f"""
WITH {SKILL_SCORES} SELECT skill, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN score = 0 THEN 100.0 ELSE 0.0 END), 6) AS zero_pct,
  round(avg(CASE WHEN score > 0 THEN score END), 6) AS nonzero_mean, {", ".join(f"count(*) FILTER (score = {i}) AS n{i}" for i in range(6))}
FROM l GROUP BY skill""")
def score_report(spark, folder):
    rows = skill_scores(spark, folder)
    return long_scores(rows, ["row_id"]).groupBy("skill").agg(
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg(F.when(F.col("score") == 0, 100.0).otherwise(0.0)), 6).alias("zero_pct"),
        F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 6).alias("nonzero_mean"),
        *[F.count_if(F.col("score") == i).alias(f"n{i}") for i in range(6)])


def long_scores(rows, keep):
    return rows.unpivot(keep, DIMENSION_NAMES, "skill", "score")


@query("cls12_scores_by_education", f"""
WITH {SKILL_SCORES}, t AS (SELECT title, skill, avg(score) AS m FROM l GROUP BY title, skill HAVING avg(score) > 0)
SELECT 'education' AS kind, education AS key, '' AS skill, round(avg(score), 6) AS mean_score FROM l GROUP BY education
UNION ALL SELECT 'title', title, skill, round(m, 6) FROM t
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY round(m, 9) DESC, skill) <= 1""")
def scores_by_education(spark, folder):
    long = checkpoint(long_scores(scored_postings(spark, folder).select("education", "title", *DIMENSION_NAMES), ["education", "title"]).groupBy(
        "education", "title", "skill").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")))
    mean = F.sum("s") / F.sum("n")
    a = long.groupBy(F.col("education").alias("key")).agg(F.round(mean, 6).alias("mean_score"))
    b = long.groupBy(F.col("title").alias("key"), "skill").agg(mean.alias("m")).filter("m > 0")
    b = ranks.top_per_key(b, ["key"], [F.desc(F.round("m", 9)), "skill"], 1)
    return a.select(F.lit("education").alias("kind"), "key", F.lit("").alias("skill"), "mean_score").unionByName(
        b.select(F.lit("title").alias("kind"), "key", "skill", F.round("m", 6).alias("mean_score")))


@query("cls13_task_counts", f"""
WITH {POSTINGS} SELECT row_id, {", ".join(f"CAST(coalesce(len(regexp_extract_all(coalesce(description, ''), '{alternation(w)}')), 0) AS INTEGER) AS {n.lower()}" for n, w in fixed.TASK_KEYWORDS)} FROM postings""")
def task_counts(spark, folder):
    counts = skills.task_counts(F.col("description"))
    return views.postings(spark, folder).select("row_id", *[c.alias(n.lower()) for n, c in counts.items()])


@query("cls14_ai_mentions", f"""
WITH {POSTINGS} SELECT row_id, CAST(regexp_matches(coalesce(title, ''), '(?i){alternation(fixed.AI_TITLE_TERMS)}') AS INTEGER) AS in_title,
  CAST(list_has_any(regexp_extract_all(lower(coalesce(description, '')), '[a-z]+|[一-龥]+'), [{sql_list(fixed.AI_TOKEN_TERMS)}, 'python']) AS INTEGER) AS in_tokens FROM postings""")
def ai_mentions(spark, folder):
    found = text.runs(F.lower(F.coalesce("description", F.lit(""))))
    in_tokens = F.greatest(
        skills.tokens_mention_ai(found), F.array_contains(found, "python").cast("int"))
    return views.postings(spark, folder).select(
        "row_id", skills.mentions_ai(F.col("title")).alias("in_title"), in_tokens.alias("in_tokens"))


GATE = ["python", "sql", "java", "建模"]


@query("cls15_gated_weight", f"""
WITH {POSTINGS} SELECT row_id, CASE n WHEN 0 THEN 0.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 ELSE 1.0 END AS weight FROM (
  SELECT row_id, len(list_filter([{sql_list(GATE)}], lambda k: contains(lower(coalesce(description, '')), k))) AS n FROM postings)""")
def gated_weight(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", skills.gated_weight(F.coalesce("description", F.lit("")), GATE).alias("weight"))


_TOPIC_CASE = "CASE " + " ".join(
    f"WHEN t = {t} THEN '{n}'" for t, n in fixed.TOPIC_CATEGORIES) + " ELSE 'M' END"


@query("cls16_topic_category", f"""
SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM (
  SELECT {_TOPIC_CASE} AS category FROM (SELECT l_partkey % 60 AS t FROM lineitem)) GROUP BY category""")
def topic_category(spark, folder):
    topic = (F.col("l_partkey") % 60).cast("int")
    counts = table(spark, folder, "lineitem").groupBy(topic.alias("t")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy(skills.topic_category(F.col("t")).alias("category")).agg(F.sum("c").alias("n"))
    return ranks.share_of(counts).withColumn("share", F.round("share", 6))


_TERM_SIZES = range(2, 7)
_TERMS = """term_pieces AS (
  SELECT DISTINCT substring(d, i, n) AS term FROM (
    SELECT d, unnest(range(1, length(d))) AS i FROM (SELECT DISTINCT lower(coalesce(description, '')) AS d FROM postings)),
    (SELECT unnest(range(2, 7)) AS n) WHERE i + n - 1 <= length(d) AND i % 3 = 1),
words AS (SELECT term FROM term_pieces UNION SELECT lower(p_name) FROM part UNION SELECT lower(p_type) FROM part)"""


def dictionary(spark, folder, rows):
    """Pieces of two to six characters of the descriptions, one place in three, and all part names and types."""
    texts = rows.select(F.lower(F.coalesce("description", F.lit(""))).alias("d")).distinct()
    grams = [F.filter(F.regexp_extract_all("d", F.lit(f"(?s)(?=(.{{{n}}}))"), 1), lambda x, i: i % 3 == 0) for n in _TERM_SIZES]
    part = table(spark, folder, "part")
    own = texts.select(F.explode(F.flatten(F.array(*grams))).alias("term"))
    return own.union(part.select(F.lower("p_name"))).union(part.select(F.lower("p_type"))).distinct()


@query("cls17_dictionary_counts", f"""
WITH {POSTINGS}, {_TERMS},
p AS (SELECT row_id, lower(coalesce(description, '')) AS d FROM postings),
-- every term is a piece of two to six characters or longer than any description holds
t AS (SELECT DISTINCT d, substring(d, i, n) AS term FROM (SELECT DISTINCT d, unnest(range(1, length(d))) AS i FROM p), (SELECT unnest(range(2, 7)) AS n) WHERE i + n - 1 <= length(d)),
f AS (SELECT d, count(*) AS n FROM t WHERE term IN (SELECT term FROM words) GROUP BY d)
SELECT row_id, coalesce(n, 0) AS skill_count FROM p LEFT JOIN f ON f.d = p.d""")
def dictionary_counts(spark, folder):
    rows = checkpoint(views.postings(spark, folder).select("row_id", "description"))
    return lookup.dictionary_counts(rows, "row_id", "description", dictionary(spark, folder, rows), "term").select(
        "row_id", "skill_count")


_SEGMENTED = f"""
WITH RECURSIVE {POSTINGS}, {_TERMS},
han AS (SELECT term FROM words WHERE regexp_matches(term, '^[一-龥]+$') AND length(term) >= 2),
p AS (SELECT row_id, regexp_extract_all(lower(coalesce(description, '')), '[a-z]+|[一-龥]+') AS runs FROM postings),
r AS (SELECT DISTINCT run FROM (SELECT unnest(runs) AS run FROM p) WHERE regexp_matches(run, '[一-龥]')),
l AS MATERIALIZED (
  SELECT run, pos, coalesce(max(n) FILTER (term IS NOT NULL), 1) AS n FROM (
    SELECT run, pos, n, substring(run, pos, n) AS piece FROM (SELECT run, unnest(range(1, length(run) + 1)) AS pos FROM r), (SELECT unnest(range(1, 7)) AS n)
    WHERE pos + n - 1 <= length(run)) LEFT JOIN han ON term = piece GROUP BY run, pos),
w AS (
  SELECT run, CAST(1 AS BIGINT) AS pos FROM r
  UNION ALL SELECT l.run, l.pos + l.n FROM w JOIN l ON l.run = w.run AND l.pos = w.pos WHERE l.pos + l.n <= length(l.run)),
s AS (SELECT w.run, list(substring(w.run, w.pos, l.n) ORDER BY w.pos) AS words FROM w JOIN l ON l.run = w.run AND l.pos = w.pos GROUP BY w.run),
k AS (SELECT row_id, place, run FROM (SELECT row_id, unnest(runs) AS run, unnest(range(len(runs))) AS place FROM p))
SELECT p.row_id, coalesce(string_agg(array_to_string(coalesce(s.words, [k.run]), ' '), ' ' ORDER BY place), '') AS tokens
FROM p LEFT JOIN k ON k.row_id = p.row_id LEFT JOIN s ON s.run = k.run GROUP BY p.row_id"""


@query("udf1_dictionary_segmentation", _SEGMENTED)
def dictionary_segmentation(spark, folder):
    """Tokens of the descriptions with Han runs cut by the longest match in a dictionary of any size."""
    rows = checkpoint(views.postings(spark, folder).select("row_id", "description"))
    terms = dictionary(spark, folder, rows).filter(F.col("term").rlike("^[一-龥]+$"))
    found = rows.withColumn("runs", text.runs(F.lower(F.coalesce("description", F.lit("")))))
    return rule_index.segment_runs(found, "row_id", "runs", terms).select("row_id", F.array_join("tokens", " ").alias("tokens"))


@query("udf1_segmentation_function", _SEGMENTED)
def segmentation_function(spark, folder):
    """The same cut by the Arrow function, whose workers hold the dictionary."""
    rows = checkpoint(views.postings(spark, folder).select("row_id", "description"))
    terms = dictionary(spark, folder, rows).filter(F.col("term").rlike("^[一-龥]+$"))
    cut = segmenter(spark, [r[0] for r in terms.limit(MAX_DICTIONARY + 1).collect()])
    found = cut(text.runs(F.lower(F.coalesce("description", F.lit("")))))
    return rows.select("row_id", F.array_join(found, " ").alias("tokens"))


VERBS = ["管理", "负责", "工作", "开发", "a", "沟通"]
NOUNS = ["团队", "经验", "系统", "能力", "b2", "项目"]


@query("cls18_pair_coherence", f"""
WITH p AS (
  SELECT o_orderkey, [{sql_list(VERBS)}][CAST(o_orderkey % 6 + 1 AS BIGINT)] AS v, [{sql_list(NOUNS)}][CAST(o_custkey % 6 + 1 AS BIGINT)] AS n FROM orders)
SELECT v, n, CASE WHEN length(v) < 2 OR length(n) < 2 THEN 0.1
    WHEN v IN ({sql_list(fixed.COHERENCE_MANAGEMENT_VERBS)}) AND n IN ({sql_list(fixed.COHERENCE_COMMON_NOUNS)}) THEN 0.9
    WHEN v IN ({sql_list(fixed.COHERENCE_WORK_VERBS)}) AND n IN ({sql_list(fixed.COHERENCE_TRAIT_NOUNS)}) THEN 0.8
    WHEN v || '_' || n IN ({sql_list('_'.join(x) for x in fixed.COHERENCE_FIXED_PAIRS)}) THEN 0.1 ELSE 0.5 END AS coherence,
  CAST(v || '_' || n IN ({sql_list(f'{a}_{b}' for a, b in fixed.FIXED_COLLOCATIONS)}) OR length(v) < 2 OR length(n) < 2
    OR regexp_matches(v || n, '\\d') AS INTEGER) AS bad, count(*) AS freq FROM p GROUP BY v, n""")
def pair_coherence(spark, folder):
    def pick(words, c):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (c % 6 + 1).cast("int"))

    rows = table(spark, folder, "orders").select(
        pick(VERBS, F.col("o_orderkey")).alias("v"), pick(NOUNS, F.col("o_custkey")).alias("n"))
    pairs = rows.groupBy("v", "n").agg(F.count(F.lit(1)).alias("freq"))
    pos = F.lit("v"), F.lit("n")
    return pairs.withColumn("coherence", skills.pair_coherence(F.col("v"), F.col("n"), *pos)).withColumn(
        "bad", skills.is_bad_pair(F.col("v"), F.col("n"), *pos).cast("int"))


# --- joins -----------------------------------------------------------------------------------

@query("jon1_lookup_join", f"""
WITH {SCORES} SELECT p_partkey, round(coalesce(mean_score, 0.0), 6) AS mean_score, coalesce(exposure_gradient, 'unknown') AS gradient
FROM part LEFT JOIN scores ON isco08_4digit = '2' || lpad(replace(p_brand, 'Brand#', ''), 3, '0')""")
def lookup_join(spark, folder):
    code = F.concat(F.lit("2"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 3, "0"))
    rows = table(spark, folder, "part").withColumn("isco08_4digit", code)
    out = lookup.attach(rows, views.code_scores(spark, folder), "isco08_4digit",
                        {"mean_score": 0.0, "exposure_gradient": "unknown"})
    return out.select("p_partkey", r6("mean_score"), F.col("exposure_gradient").alias("gradient"))


@query("jon2_large_left_join", """
SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n_lines FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def large_left_join(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"))
    return lookup.attach(table(spark, folder, "orders"), lines, "o_orderkey", {"n_lines": 0}).select(
        "o_orderkey", "n_lines")


@query("jon3_three_left_joins", """
SELECT d.doc_id, l.quality, p.url, e.label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def three_left_joins(spark, folder):
    return lookup.attach_all(table(spark, folder, "documents").select("doc_id"), [
        table(spark, folder, "labels").select("doc_id", "quality"),
        table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url"),
        table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")], "doc_id")


@query("jon4_frame_merges", """
SELECT n_name, r_name, c.n AS n_customers, s.n AS n_suppliers FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def frame_merges(spark, folder):
    n = F.count(F.lit(1))
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n.alias("n_customers"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(n.alias("n_suppliers"))
    return nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select(
        "n_name", "r_name", "n_customers", "n_suppliers")


@query("jon5_growth_table", f"""
WITH {views.PANEL}, y AS (SELECT ind, "year", count(*) AS n, avg(ent) AS m FROM panel GROUP BY ind, "year")
SELECT a.ind, a.n AS n_first, round(a.m, 6) AS value_first, b.n AS n_last, round(b.m, 6) AS value_last,
  round((b.m - a.m) / a.m * 100, 4) AS growth_rate_pct FROM y a JOIN y b ON a.ind = b.ind AND a."year" = 1995 AND b."year" = 2000""")
def growth_table(spark, folder):
    cells = views.panel(spark, folder).groupBy("ind", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("ent").alias("m"))
    return panel.growth(cells, "ind", "m", "n", 1995, 2000).select(
        "ind", "n_first", r6("value_first"), "n_last", r6("value_last"),
        F.round("growth_rate_pct", 4).alias("growth_rate_pct"))


@query("jon6_members", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def members(spark, folder):
    good = table(spark, folder, "labels").filter("quality = 1")
    return lookup.members(table(spark, folder, "documents"), good, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("jon7_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, folder):
    return lookup.pending(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("jon8_coalescing_fill", """
SELECT d.doc_id, coalesce(l.src, d.source) AS source FROM documents d
LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS src FROM labels) l ON l.doc_id = d.doc_id""")
def coalescing_fill(spark, folder):
    new = table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return lookup.fill_from(table(spark, folder, "documents").select("doc_id", "source"), new, "doc_id", ["source"])


@query("jon10_contains_join", f"""
WITH {POSTINGS}, kw AS (SELECT * FROM (VALUES ('Python', 'I'), ('数据', 'I'), ('会计', 'J'), ('沟通', 'L')) t(kw, code))
SELECT row_id, kw, code FROM postings JOIN kw ON contains(description, kw)""")
def contains_join(spark, folder):
    words = spark.createDataFrame([("Python", "I"), ("数据", "I"), ("会计", "J"), ("沟通", "L")], "kw string, code string")
    return lookup.contains_join(views.postings(spark, folder), "description", words, "kw").select("row_id", "kw", "code")


# --- enrichment --------------------------------------------------------------------------------

@query("enr1_expand_titles")
def expand_titles(spark, folder):
    return enrich.expand_titles(views.postings(spark, folder)).select("row_id", "title", "n_titles")


@query("enr1_force_single_titles")
def force_single_titles(spark, folder):
    rows = views.postings(spark, folder).select("row_id", "title", "description")
    return enrich.force_single_titles(rows).select("row_id", "title")


@query("enr2_fill_blank", f"""
WITH {POSTINGS}, a AS (SELECT row_id, company, city, location, coalesce(description, '') AS d FROM postings),
b AS (SELECT *, {_COMPANY} AS xc, substr({_CAND.format(_LOCATION)}, 1, 80) AS xl FROM a),
c AS (SELECT *, CASE WHEN xl <> '' THEN xl || chr(10) || d ELSE d END AS src FROM b),
e AS (SELECT *, coalesce(list_filter([{sql_list(fixed.CITIES)}], lambda x: contains(src, x))[1], '') AS xcity FROM c)
SELECT row_id, CASE WHEN trim(coalesce(company, '')) = '' AND xc <> '' THEN xc ELSE company END AS company,
  CASE WHEN trim(coalesce(city, '')) = '' AND xcity <> '' THEN xcity ELSE city END AS city,
  CASE WHEN trim(coalesce(location, '')) = '' AND xl <> '' THEN xl ELSE location END AS location FROM e""")
def fill_blank(spark, folder):
    return enrich.fill_from_description(views.postings(spark, folder)).select("row_id", "company", "city", "location")


def _payload(spark, folder):
    """Extraction records derived from the events: JSON items, sometimes in a code fence."""
    events = table(spark, folder, "events")
    item = F.concat(
        F.lit('{"job_title": "'), F.col("event_type"), F.lit('工程师/数据分析师", "city": "北京", "工作地点": "'),
        F.col("props"), F.lit('"}'))
    item = F.regexp_replace(item, r'"\{"k": (\d+)\}"', '"路$1号"')
    body = F.concat(F.lit("["), item, F.lit(", "), item, F.lit(', {"title": ""}]'))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    k = F.col("event_id") % 5
    return events.select(
        F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), (k != 4).alias("ok"),
        F.when(k == 0, fenced).when(k == 3, "[]").when(k == 4, "error").otherwise(body).alias("payload"))


@query("enr3_hybrid_items")
def hybrid_items(spark, folder):
    cache = _payload(spark, folder).select("row_id", "seq", "ok", enrich.parse_items(F.col("payload")).alias("items"))
    out = enrich.hybrid_items(views.postings(spark, folder), cache)
    return out.groupBy("item_source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("items")).alias("items"))


@query("enr4_parse_payload")
def parse_payload(spark, folder):
    rows = _payload(spark, folder).withColumn("i", F.explode(enrich.parse_items(F.col("payload"))))
    return rows.select("seq", "i.*")


@query("enr5_complete_items")
def complete_items(spark, folder):
    rows = _payload(spark, folder).withColumn("items", enrich.parse_items(F.col("payload")))
    guess = F.array(F.lit("Java工程师"), F.lit("测试工程师"))
    return rows.select("seq", F.explode(enrich.complete_items(F.col("items"), guess)).alias("i")).select("seq", "i.*")
