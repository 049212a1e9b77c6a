"""Sources, sinks, row-quality rules and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import fixed, quality, text, titles, urls
from ..functions.text import alternation
from ..operators import cleaning, dedup, econ, lookup, ranks
from ..sources import readers, sinks, views
from ..sources.views import CAPTURES, DOCS, MATCHES, POSTINGS, SCORES, TOKENS, sql_list, table
from .registry import query


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- shared SQL -----------------------------------------------------------------------

REPOSTS = POSTINGS + """,
reposts AS (
  SELECT * FROM postings
  UNION ALL SELECT row_id + 1000000000 AS row_id, * EXCLUDE (row_id) FROM postings WHERE row_id % 5 = 0)"""


def reposts(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with every fifth one posted again under a later row id."""
    base = views.postings(spark, folder)
    again = base.filter("row_id % 5 = 0").withColumn("row_id", F.col("row_id") + 1_000_000_000)
    return base.unionByName(again)


FAKE_RULES = """[
    CASE WHEN trim(coalesce(company, '')) = '' THEN 'missing_company' END,
    CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing_title' END,
    CASE WHEN trim(coalesce(city, '')) = '' THEN 'missing_city' END,
    CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo > 0 AND lo < 500 THEN 'min_salary_low' END,
    CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo > 1000000 THEN 'min_salary_high' END,
    CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND hi > 0 AND hi < 500 THEN 'max_salary_low' END,
    CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND hi > 1000000 THEN 'max_salary_high' END,
    CASE WHEN lo > 0 AND hi > 0 AND lo > hi THEN 'salary_order' END,
    CASE WHEN description IS NULL THEN 'missing_description' END,
    CASE WHEN length(trim(description)) < 10 THEN 'short_description' END,
    CASE WHEN yr > 0 AND yr < 2010 THEN 'year_early' END,
    CASE WHEN yr > 2026 THEN 'year_late' END]"""
SPAM = " + ".join(
    f"CASE WHEN contains(lower(coalesce(description, '')), '{w}') THEN 1 ELSE 0 END"
    for w in fixed.SPAM_KEYWORDS)
JUDGED = f"""parsed AS (
  SELECT *, CASE WHEN salary_min IS NULL THEN 0 ELSE TRY_CAST(salary_min AS DOUBLE) END AS lo,
         CASE WHEN salary_max IS NULL THEN 0 ELSE TRY_CAST(salary_max AS DOUBLE) END AS hi,
         CAST(trunc(TRY_CAST(publish_year AS DOUBLE)) AS INTEGER) AS yr
  FROM {{source}}),
judged AS (
  SELECT *, list_filter({FAKE_RULES}, lambda x: x IS NOT NULL) AS reasons,
    (regexp_matches(coalesce(city, ''), '{alternation(fixed.EXCLUDED_CITY_TERMS)}')
     OR trim(coalesce(category, '')) IN ({sql_list(fixed.IRRELEVANT_CATEGORIES)})
     OR ({SPAM}) >= 2) AS irrelevant
  FROM parsed)"""
CHAIN = JUDGED + """,
keyed AS (
  SELECT *, CASE WHEN len(reasons) > 0 THEN 'fake' WHEN irrelevant THEN 'irrelevant' END AS early,
    md5(concat_ws('|', coalesce(company, 'nan'), coalesce(title, 'nan'), coalesce(city, 'nan'),
                  substr(coalesce(description, 'nan'), 1, 100), coalesce(publish_date, 'nan'))) AS k
  FROM judged),
chained AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN early
    WHEN row_id > min(CASE WHEN early IS NULL THEN row_id END) OVER (PARTITION BY k) THEN 'duplicate'
    ELSE 'valid' END AS reject_reason
  FROM keyed)"""
WINDOW_CASE = "CASE " + " ".join(
    f"WHEN {{0}} IN ({y}, {y + 1}) THEN 'window_{y}_{y + 1}'" for y in fixed.WINDOW_STARTS) + " END"

# --- sources -------------------------------------------------------------------------


@query("src1_csv_scan", f"""
WITH {POSTINGS}, w AS (
  SELECT *, {WINDOW_CASE.format("CAST(trunc(TRY_CAST(publish_year AS DOUBLE)) AS INTEGER)")} AS win FROM postings)
SELECT win AS "window", count(*) AS n, count(nullif(title, '')) AS n_titles, CAST(sum(length(nullif(description, ''))) AS BIGINT) AS chars
FROM w WHERE win IS NOT NULL GROUP BY win""")
def csv_scan(spark, folder):
    """Postings written as one CSV per window, read back by name pattern."""
    path = views.scratch(spark)
    rows = cleaning.with_window(views.postings(spark, folder), F.col("publish_year"))
    (rows.filter("window is not null").withColumn("w", F.col("window")).write.partitionBy("w")
     .option("header", True).option("escape", '"').csv(path))
    back = readers.read_posting_csv(spark, f"{path}/w=window_*")
    return back.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.count("title").alias("n_titles"),
        F.sum(F.length("description")).alias("chars"))


@query("src2_jsonl_tokens", f"""
WITH {TOKENS} SELECT "year", count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM toks GROUP BY "year" """)
def jsonl_tokens(spark, folder):
    """Token documents written as JSON lines among broken lines, read back."""
    path = views.scratch(spark)
    rows = views.docs(spark, folder).select(
        "id", F.col("year").cast("string").alias("year"), text.latin_tokens(F.col("text")).alias("tokens"))
    lines = rows.select(F.to_json(F.struct("id", "year", "tokens")).alias("value"))
    broken = rows.filter("id % 10 = 0").select(F.lit('{"id": 1, "tokens": [').alias("value"))
    lines.unionByName(broken).write.text(path)
    return readers.read_tokens(spark, path).groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_tokens"))


@query("src3_column_pruning", "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY l_returnflag")
def column_pruning(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").cast("bigint").alias("qty"))


_CLEAN_TITLE = "{0}"
for _p in (r"[（(][^)）]*[)）]", r"\d{3,}元?/?", r"[+➕].{0,20}$", r"/[包入无].{0,15}$",
           alternation(fixed.TITLE_PROMO_WORDS), r"^[ /\\\-—_·.，,]+|[ /\\\-—_·.，,]+$"):
    _CLEAN_TITLE = "regexp_replace(" + _CLEAN_TITLE + ", '" + _p.replace("{", "{{").replace("}", "}}") + "', '', 'g')"
LOOKUPS = f"""{MATCHES}, {SCORES},
valid_matches AS (
  SELECT *, {_CLEAN_TITLE.format("title")} AS clean_title FROM matches
  WHERE sbert_accepted = 'True' AND isco08_4digit IN (SELECT isco08_4digit FROM scores)),
raw_isco AS (SELECT title, arg_max(isco08_4digit, part_id) AS isco08_4digit FROM valid_matches GROUP BY title),
clean_isco AS (
  SELECT clean_title, arg_min(isco08_4digit, part_id) AS isco08_4digit FROM valid_matches
  WHERE length(clean_title) >= 2 GROUP BY clean_title)"""


@query("src4_lookup_loaders", f"""
WITH {LOOKUPS} SELECT 'raw' AS kind, title AS key, isco08_4digit FROM raw_isco
UNION ALL SELECT 'cleaned', clean_title, isco08_4digit FROM clean_isco""")
def lookup_loaders(spark, folder):
    raw, cleaned = lookup.title_tables(
        views.title_matches(spark, folder), views.code_scores(spark, folder), "part_id")
    a = raw.select(F.lit("raw").alias("kind"), F.col("title").alias("key"), "isco08_4digit")
    b = cleaned.select(F.lit("cleaned").alias("kind"), F.col("clean_title").alias("key"), "isco08_4digit")
    return a.unionByName(b)


@query("src5_skill_dictionary", f"""
WITH {POSTINGS} SELECT DISTINCT term FROM (
  SELECT split_part(trim(regexp_replace(title || ' 2000 nz', '\\s+', ' ', 'g')), ' ', 1) AS term FROM postings)
WHERE length(term) >= 2 AND regexp_matches(term, '[一-龥]')""")
def skill_dictionary(spark, folder):
    lines = views.postings(spark, folder).select(F.concat("title", F.lit(" 2000 nz")).alias("value"))
    return readers.dictionary_terms(lines, F.col("value"))


@query("src6_source_union", """
SELECT '上市公司' AS data_source, c_name AS company, c_mktsegment AS platform, CAST(c_acctbal AS VARCHAR) AS salary_min FROM customer
UNION ALL SELECT '应届生', s_name, NULL, CAST(s_acctbal AS VARCHAR) FROM supplier
UNION ALL SELECT '综合', p_name, p_brand, NULL FROM part""")
def source_union(spark, folder):
    listed = table(spark, folder, "customer").select(
        F.col("c_name").alias("企业名称"), F.col("c_mktsegment").alias("数据平台"),
        F.col("c_acctbal").cast("string").alias("最低月薪"), F.lit("600000").alias("关联股票代码"))
    fresh = table(spark, folder, "supplier").select(
        F.col("s_name").alias("企业名称"), F.col("s_acctbal").cast("string").alias("最低月薪"))
    mixed = table(spark, folder, "part").select(
        F.col("p_name").alias("企业名称"), F.col("p_brand").alias("来源平台"))
    return readers.union_sources(dict(zip(schemas.DATA_SOURCES, (listed, fresh, mixed))))


_PLATFORM_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{0}}), '{alternation(h)}') THEN '{n}'" for h, n in fixed.PLATFORM_HOSTS) + " ELSE 'other' END"
_PLATFORM_NAME = "CASE trim({0}) " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in fixed.PLATFORM_NAMES) + " ELSE coalesce(nullif(trim({0}), ''), trim({1}), '') END"


@query("src7_schema_conversion", f"""
WITH {CAPTURES} SELECT '' AS company, '' AS title, original AS description,
  coalesce(strftime(TRY_STRPTIME(substr(ts, 1, 8), '%Y%m%d'), '%Y-%m-%d'), '') AS publish_date,
  {_PLATFORM_NAME.format("platform", "domain")} AS platform FROM captures""")
def schema_conversion(spark, folder):
    rows = views.captures(spark, folder)
    return readers.conform(rows, ["company", "title", "description", "publish_date", "platform"], {
        "description": F.col("original"), "publish_date": urls.capture_date(F.col("ts")),
        "platform": urls.platform_name(F.col("platform"), F.col("domain"))})


@query("src8_part_files", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def part_files(spark, folder):
    path = views.scratch(spark)
    table(spark, folder, "orders").select("o_orderkey", "o_orderstatus").write.option(
        "maxRecordsPerFile", 5000).parquet(path)
    return readers.read_parts(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ---------------------------------------------------------------------------

@query("snk1_routed_sink", f"""
WITH {REPOSTS}, {CHAIN.format(source="reposts")}
SELECT reject_reason, count(*) AS n FROM chained GROUP BY reject_reason""")
def routed_sink(spark, folder):
    path = views.scratch(spark)
    sinks.write_routed(cleaning.with_reject_reason(reposts(spark, folder)), path)
    return spark.read.parquet(path).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("snk2_window_sink", f"""
WITH {DOCS} SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM docs WHERE "year" IN (2018, 2019)""")
def window_sink(spark, folder):
    """Documents partitioned by window; one window read back by partition pruning."""
    path = views.scratch(spark)
    rows = cleaning.with_window(views.docs(spark, folder), F.col("year"))
    sinks.write_partitioned(rows.filter("window is not null"), path, ["window"])
    return spark.read.parquet(path).filter("window = 'window_2018_2019'").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("snk3_window_statistics", f"""
WITH {POSTINGS}, w AS (
  SELECT {WINDOW_CASE.format("CAST(trunc(TRY_CAST(publish_year AS DOUBLE)) AS INTEGER)")} AS win FROM postings)
SELECT win AS "window", count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM w), 6) AS pct
FROM w WHERE win IS NOT NULL GROUP BY win""")
def window_statistics(spark, folder):
    rows = cleaning.with_window(views.postings(spark, folder), F.col("publish_year"))
    return cleaning.window_statistics(rows).withColumn("pct", F.round("pct", 6))


@query("snk4_table_and_csv", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def table_and_csv(spark, folder):
    path = views.scratch(spark)
    sinks.write_table_and_csv(table(spark, folder, "part"), path, ["p_partkey", "p_brand"])
    light = spark.read.option("header", True).csv(f"{path}/light_csv")
    full = spark.read.parquet(f"{path}/table").select(F.col("p_partkey").cast("string"))
    return light.join(full, "p_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("snk5_run_summary", f"""
WITH {POSTINGS}, {JUDGED.format(source="postings")}
SELECT count(*) AS rows_in, count(*) FILTER (len(reasons) > 0) AS rows_fake,
  count(*) FILTER (irrelevant) AS rows_irrelevant, count(*) FILTER (platform = 'zhaopin') AS from_zhaopin FROM judged""")
def run_summary(spark, folder):
    return cleaning.run_summary(views.postings(spark, folder), {
        "rows_fake": quality.is_fake(), "rows_irrelevant": quality.is_irrelevant(),
        "from_zhaopin": F.col("platform") == "zhaopin"})


# --- filters ---------------------------------------------------------------------------

@query("flt1_fake_postings", f"""
WITH {POSTINGS}, {JUDGED.format(source="postings")}
SELECT row_id, CAST(len(reasons) > 0 AS INTEGER) AS fake, array_to_string(reasons, '|') AS reasons FROM judged""")
def fake_postings(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", quality.is_fake().cast("int").alias("fake"),
        F.array_join(quality.fake_reasons(), "|").alias("reasons"))


@query("flt2_irrelevant_postings", f"""
WITH {POSTINGS}, {JUDGED.format(source="postings")} SELECT row_id, CAST(irrelevant AS INTEGER) AS irrelevant FROM judged""")
def irrelevant_postings(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", quality.is_irrelevant().cast("int").alias("irrelevant"))


@query("flt3_rule_chain", f"""
WITH {REPOSTS}, {CHAIN.format(source="reposts")} SELECT row_id, reject_reason FROM chained""")
def rule_chain(spark, folder):
    return cleaning.reject_reasons(reposts(spark, folder))


@query("flt4_reject_profile", f"""
WITH {POSTINGS}, {JUDGED.format(source="postings")}
SELECT reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM judged), 6) AS pct
FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason""")
def reject_profile(spark, folder):
    return cleaning.reject_profile(views.postings(spark, folder)).withColumn("pct", F.round("pct", 6))


@query("flt4_missing_profile", f"""
WITH {POSTINGS} SELECT count(*) FILTER (trim(coalesce(company, '')) = '') AS missing_company,
  count(*) FILTER (trim(coalesce(title, '')) = '') AS missing_title,
  count(*) FILTER (trim(coalesce(publish_year, '')) = '') AS missing_publish_year, count(*) AS n,
  min(length(trim(description))) AS len_min, max(length(trim(description))) AS len_max,
  round(avg(length(trim(description))), 6) AS len_mean FROM postings""")
def missing_profile(spark, folder):
    out = cleaning.missing_profile(views.postings(spark, folder), ["company", "title", "publish_year"])
    return out.withColumn("len_mean", F.round("len_mean", 6))


@query("flt5_domestic_city", f"""
WITH {POSTINGS} SELECT row_id, CAST(CASE WHEN s IS NULL OR s = '' THEN false WHEN s = '杭州市西湖区' THEN true
  WHEN regexp_matches(s, '{alternation(fixed.FOREIGN_COUNTRIES + fixed.FOREIGN_CITIES)}') THEN false
  WHEN regexp_matches(s, '{alternation(fixed.PROVINCES)}') THEN true
  ELSE regexp_matches(s, '{fixed.ADMIN_SUFFIX_PATTERN}') AND regexp_matches(s, '[一-龥]') END AS INTEGER) AS domestic
FROM (SELECT row_id, lower(trim(city)) AS s FROM postings)""")
def domestic_city(spark, folder):
    return views.postings(spark, folder).select(
        "row_id", quality.is_domestic_city(F.col("city"), ("杭州市西湖区",)).cast("int").alias("domestic"))


@query("flt6_window_years", f"""
WITH {POSTINGS}, w AS (SELECT CAST(trunc(TRY_CAST(publish_year AS DOUBLE)) AS INTEGER) AS yr FROM postings)
SELECT yr AS "year", count(*) AS n FROM w WHERE yr IS NOT NULL AND yr NOT BETWEEN 2016 AND 2025 GROUP BY yr""")
def window_years(spark, folder):
    rows = views.postings(spark, folder).withColumn("year", text.parse_year(F.col("publish_year")))
    return cleaning.excluded_years(cleaning.with_window(rows, F.col("year")), "year")


_STRIP_HTML = "html"
for _a, _b in fixed.HTML_ENTITIES:
    _STRIP_HTML = f"replace({_STRIP_HTML}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_STRIP_HTML = (
    f"trim(regexp_replace(regexp_replace({_STRIP_HTML}, '<[^>]+>', ' ', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g'))")


@query("flt7_require_text", f"""
WITH {CAPTURES}, c AS (SELECT idx, {_STRIP_HTML} AS clean FROM captures WHERE idx % 11 <> 0)
SELECT idx, md5(clean) AS digest FROM c WHERE clean <> ''""")
def require_text(spark, folder):
    rows = views.captures(spark, folder).withColumn("year", F.when(F.col("idx") % 11 != 0, 2019))
    return cleaning.require_text(rows, "html", "year", "clean").select("idx", F.md5("clean").alias("digest"))


@query("flt8_min_length", f"""
WITH {TOKENS}, c AS (SELECT page_id, {_STRIP_HTML} AS clean FROM pages)
SELECT 'tokens' AS rule, count(*) AS kept FROM toks
UNION ALL SELECT 'archive', count(*) FILTER (length(clean) >= 120) FROM c
UNION ALL SELECT 'requirement', count(*) FILTER (length(text) >= 20) FROM documents""")
def min_length(spark, folder):
    docs, pages = views.docs(spark, folder), table(spark, folder, "pages")
    a = views.token_docs(spark, folder).agg(F.count(F.lit(1)).alias("kept")).withColumn("rule", F.lit("tokens"))
    b = pages.filter(F.length(text.strip_html(F.col("html"))) >= fixed.MIN_ARCHIVE_TEXT).agg(
        F.count(F.lit(1)).alias("kept")).withColumn("rule", F.lit("archive"))
    c = docs.filter(F.length("text") >= fixed.MIN_REQUIREMENT_CHARS).agg(
        F.count(F.lit(1)).alias("kept")).withColumn("rule", F.lit("requirement"))
    return a.unionByName(b).unionByName(c)


_URI = r"^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
SPLIT = CAPTURES + f""",
split_urls AS (
  SELECT *, lower(regexp_extract(original, '{_URI}', 1)) AS host, regexp_extract(original, '{_URI}', 2) AS path0,
         regexp_extract(original, '{_URI}', 3) AS query FROM captures),
paths AS (
  SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (
    SELECT *, regexp_replace(CASE WHEN starts_with(trim(path0), '/') THEN lower(trim(path0))
                             ELSE '/' || lower(trim(path0)) END, '/+$', '') AS p FROM split_urls)),
valued AS (
  SELECT *, path IN ({sql_list(fixed.ROOT_PATHS)}) AS is_root,
    regexp_matches(host || path || '?' || lower(trim(query)), '{alternation(fixed.JOB_URL_KEYWORDS)}') AS is_job
  FROM paths),
high AS (
  SELECT *, (original <> '' AND NOT contains(original, '@') AND host <> '' AND NOT is_root AND is_job) AS high_value
  FROM valued)"""


@query("flt9_url_intent", f"""
WITH {SPLIT} SELECT idx, original FROM high WHERE starts_with(ts, '2019') AND trim(original) <> ''
  AND NOT regexp_matches(lower(original), '{alternation(fixed.URL_EXCLUDE)}')
  AND (regexp_matches(lower(path0), '{alternation(fixed.URL_INCLUDE_PATHS)}')
       OR regexp_matches(lower(query), '{alternation(fixed.URL_INCLUDE_QUERY)}'))""")
def url_intent(spark, folder):
    return views.captures(spark, folder).filter(
        urls.has_job_intent(F.col("ts"), F.col("original"), "2019")).select("idx", "original")


@query("flt10_high_value_url", f"WITH {SPLIT} SELECT idx, CAST(high_value AS INTEGER) AS high_value FROM high")
def high_value_url(spark, folder):
    return views.captures(spark, folder).select(
        "idx", urls.is_high_value(F.col("original")).cast("int").alias("high_value"))


@query("flt11_low_value_text", f"""
WITH c AS (SELECT page_id, {_STRIP_HTML} || CASE page_id % 3 WHEN 0 THEN ' 客户服务热线 版权所有' ELSE '' END AS t FROM pages)
SELECT page_id, CASE WHEN length(t) < 220 THEN 'too_short'
  WHEN (CASE WHEN contains(t, '客户服务热线') THEN 1 ELSE 0 END + CASE WHEN contains(t, '未经') THEN 1 ELSE 0 END
        + CASE WHEN contains(t, '版权所有') THEN 1 ELSE 0 END + CASE WHEN contains(t, '按拼音选择') THEN 1 ELSE 0 END) >= 2
       AND length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) < 800 THEN 'boilerplate' ELSE '' END AS reason FROM c""")
def low_value_text(spark, folder):
    foot = F.when(F.col("page_id") % 3 == 0, " 客户服务热线 版权所有").otherwise("")
    t = F.concat(text.strip_html(F.col("html")), foot)
    return table(spark, folder, "pages").select("page_id", urls.low_value_reason(t).alias("reason"))


@query("flt12_strict_selection", f"""
WITH {SPLIT}, a AS (
  SELECT * FROM high WHERE high_value QUALIFY row_number() OVER (PARTITION BY trim(original) ORDER BY idx) = 1)
SELECT idx FROM a QUALIFY row_number() OVER (PARTITION BY digest ORDER BY idx) = 1""")
def strict_selection(spark, folder):
    rows = views.captures(spark, folder)
    return dedup.select_captures(
        rows, urls.is_high_value(F.col("original")), "original", "digest", ["idx"]).select("idx")


@query("flt12_drop_counters", f"""
WITH {SPLIT}, a AS (
  SELECT * FROM high WHERE high_value QUALIFY row_number() OVER (PARTITION BY trim(original) ORDER BY idx) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY digest ORDER BY idx) = 1),
n AS (SELECT (SELECT count(*) FROM high) AS i, (SELECT count(*) FROM high WHERE high_value) AS h, (SELECT count(*) FROM a) AS u, (SELECT count(*) FROM b) AS s)
SELECT i AS input_rows, i - h AS drop_low_value, h - u AS drop_same_url, u - s AS drop_same_digest, s AS selected_rows FROM n""")
def drop_counters(spark, folder):
    rows = views.captures(spark, folder)
    return dedup.selection_counts(rows, urls.is_high_value(F.col("original")), "original", "digest", ["idx"])


@query("flt13_clean_seeds", f"""
WITH {SPLIT}, seeds AS (
  SELECT *, CASE WHEN lower(trim(platform)) = '' THEN 'other' ELSE lower(trim(platform)) END AS plat FROM valued
  WHERE original <> '' QUALIFY row_number() OVER (PARTITION BY domain, original ORDER BY idx) = 1),
clean AS (
  SELECT * FROM seeds WHERE (plat IN ('zhaopin', '51job') OR regexp_matches(domain, 'zhaopin\\.com|zhiye\\.com|51job\\.com'))
    AND NOT contains(original, '@') AND NOT regexp_matches(domain, '^(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}$') AND length(original) <= 400)
SELECT idx, domain, original AS url, CAST(row_number() OVER (PARTITION BY domain ORDER BY CAST(is_root AS INTEGER),
    CAST(NOT is_job AS INTEGER), CAST(NOT contains(original, '?') AS INTEGER), length(original), domain, original) AS INTEGER) AS seed_rank
FROM clean QUALIFY seed_rank <= 5""")
def clean_seeds(spark, folder):
    rows = views.captures(spark, folder).withColumnRenamed("original", "url")
    return lookup.clean_seeds(rows, ["zhaopin", "51job"]).select("idx", "domain", "url", "seed_rank")


# --- derived flags -----------------------------------------------------------------------

@query("prj1_fresh_graduate", f"""
WITH {POSTINGS} SELECT row_id, CAST(regexp_matches(experience, '{alternation(fixed.FRESH_EXPERIENCE)}')
  OR regexp_matches(title, '{alternation(fixed.FRESH_TITLE)}') OR regexp_matches(category, '^(?:校园|实习)')
  OR regexp_matches(category, '{alternation(fixed.FRESH_CATEGORY_CONTAINS)}') AS INTEGER) AS is_fresh_grad FROM postings""")
def fresh_graduate(spark, folder):
    return views.postings(spark, folder).select("row_id", quality.fresh_graduate().alias("is_fresh_grad"))


@query("prj2_treatment_columns", f"""
WITH {views.CELLS}, z AS (SELECT avg(salary) AS m, stddev_samp(salary) AS s FROM cells)
SELECT occ, ind, "year", post, round(treat_x_post, 6) AS treat_x_post, round(exposure * "year", 3) AS occ_trend,
  round(exposure * greatest(0, "year" - 1998), 6) AS expo_spline_1998, round((salary - z.m) / z.s, 6) AS z_salary
FROM cells, z""")
def treatment_columns(spark, folder):
    rows = econ.standardize(econ.spline_column(views.cells(spark, folder), 1998), ["salary"])
    return rows.select("occ", "ind", "year", "post", r6("treat_x_post"), F.round("occ_trend", 3).alias("occ_trend"),
                       r6("expo_spline_1998"), r6("z_salary"))


_CODES = "chr(CAST(65 + p_partkey % 21 AS INTEGER))"
_FOUR = "CASE " + " ".join(
    f"WHEN code IN ({sql_list(c)}) THEN '{n}'" for n, c in fixed.FOUR_GROUPS) + " ELSE 'Other' END"


@query("prj3_industry_groups", f"""
WITH p AS (SELECT {_CODES} AS code, p_size FROM part),
s AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{g}', '{c}')" for s, table in fixed.ECONOMIC_SCHEMES for c, g in table)}) t(scheme, grp, code))
SELECT 'four' AS scheme, {_FOUR} AS "group", count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM p GROUP BY 2
UNION ALL SELECT scheme, grp, count(*), CAST(sum(p_size) AS BIGINT) FROM p JOIN s USING (code) GROUP BY 1, 2""")
def industry_groups(spark, folder):
    from ..operators.panel import scheme_table

    rows = table(spark, folder, "part").select(
        F.char((65 + F.col("p_partkey") % 21).cast("int")).alias("industry_code"), "p_size")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size")]
    four = rows.groupBy(quality.four_group(F.col("industry_code")).alias("group")).agg(*sums)
    schemes = rows.join(scheme_table(spark), "industry_code").groupBy("scheme", "group").agg(*sums)
    return four.withColumn("scheme", F.lit("four")).unionByName(schemes)


# --- duplicates ----------------------------------------------------------------------------

@query("dup1_composite_key", f"""
WITH {REPOSTS}, {CHAIN.format(source="reposts")}
SELECT row_id FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_id) = 1""")
def composite_key(spark, folder):
    return dedup.keep_first(reposts(spark, folder), [cleaning.posting_key()], ["row_id"]).select("row_id")


@query("dup2_six_fields", f"""
WITH {REPOSTS} SELECT row_id FROM reposts QUALIFY row_number() OVER (
  PARTITION BY company, title, city, publish_date, salary_min, salary_max ORDER BY row_id) = 1""")
def six_fields(spark, folder):
    keys = ["company", "title", "city", "publish_date", "salary_min", "salary_max"]
    return dedup.keep_first(reposts(spark, folder), keys, ["row_id"]).select("row_id")


@query("dup3_exact_text", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS INTEGER) AS is_duplicate FROM documents""")
def exact_text(spark, folder):
    rows = table(spark, folder, "documents")
    return dedup.split_duplicates(rows, dedup.text_key(F.col("text")), "doc_id").select("doc_id", "is_duplicate")


@query("dup4_near_duplicates", f"""
WITH RECURSIVE {DOCS}, t AS (SELECT id, lang, regexp_replace(coalesce(text, ''), '[^一-龥a-zA-Z0-9]', '', 'g') AS t FROM docs),
g AS (SELECT id, lang, t, CASE WHEN length(t) >= 3 THEN list_sort(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))) ELSE [t] END AS g FROM t),
f AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY lang, length(t) < 3, g) AS first FROM g WHERE t <> ''),
s AS (SELECT id, lang, g, len(g) AS n FROM f WHERE id = first AND length(t) >= 3),
-- sets that differ share a shingle, so pairs come from their common shingles
l AS (SELECT id, lang, n, unnest(g) AS x FROM s),
o AS (SELECT a.id AS head, b.id AS id, any_value(a.n) + any_value(b.n) AS n, count(*) AS common
  FROM l a JOIN l b ON a.lang = b.lang AND a.x = b.x AND a.id < b.id AND least(a.n, b.n) >= 0.9::DOUBLE * greatest(a.n, b.n) - 0.000001 GROUP BY a.id, b.id),
e AS (SELECT id, head FROM o WHERE common::DOUBLE / (n - common) >= 0.9::DOUBLE),
q AS MATERIALIZED (SELECT id, list(head) AS heads, row_number() OVER (ORDER BY id) AS k FROM e GROUP BY id),
-- row after row: similar if one of its earlier neighbours is not
w AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone
  UNION ALL SELECT q.k, CASE WHEN len(list_filter(q.heads, lambda h: NOT list_contains(w.gone, h))) > 0 THEN list_append(w.gone, q.id) ELSE w.gone END
  FROM w JOIN q ON q.k = w.k + 1),
d AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM w ORDER BY k DESC LIMIT 1))
SELECT t.id, CASE WHEN t.t = '' THEN 'empty' WHEN f.id > f.first THEN 'copy' WHEN d.id IS NOT NULL THEN 'similar' ELSE 'kept' END AS status
FROM t LEFT JOIN f ON f.id = t.id LEFT JOIN d ON d.id = t.id""")
def near_duplicates(spark, folder):
    return dedup.near_duplicates(views.docs(spark, folder), "id", "text", ["lang"])


@query("dup5_corpus_dedup", f"""
WITH u AS (
  SELECT 0 AS priority, doc_id AS id, source AS platform, text AS html FROM documents
  UNION ALL SELECT 1, page_id, 'web', html FROM pages),
c AS (SELECT priority, id, platform, {_STRIP_HTML} AS clean FROM u),
k AS (SELECT * FROM c WHERE length(clean) >= 120 QUALIFY row_number() OVER (PARTITION BY sha1(clean) ORDER BY priority, id) = 1)
SELECT priority, platform, count(*) AS n FROM k GROUP BY priority, platform""")
def corpus_dedup(spark, folder):
    a = table(spark, folder, "documents").select(
        F.lit(0).alias("priority"), F.col("doc_id").alias("id"), F.col("source").alias("platform"), "text")
    b = table(spark, folder, "pages").select(
        F.lit(1).alias("priority"), F.col("page_id").alias("id"), F.lit("web").alias("platform"),
        F.col("html").alias("text"))
    kept = dedup.corpus_dedup(a.unionByName(b), "text", ["priority", "id"])
    return kept.groupBy("priority", "platform").agg(F.count(F.lit(1)).alias("n"))


@query("dup6_alternate_key", f"""
WITH {CAPTURES}, k AS (
  SELECT idx, CASE WHEN idx % 3 = 0 THEN domain ELSE '' END AS snapshot_url, original, ts FROM captures)
SELECT idx FROM k QUALIFY row_number() OVER (
  PARTITION BY CASE WHEN snapshot_url <> '' THEN snapshot_url ELSE original || chr(1) || ts END ORDER BY idx) = 1""")
def alternate_key(spark, folder):
    rows = views.captures(spark, folder).withColumn(
        "snapshot_url", F.when(F.col("idx") % 3 == 0, F.col("domain")).otherwise(""))
    key = dedup.capture_key(F.col("snapshot_url"), F.col("original"), F.col("ts"))
    return dedup.keep_first(rows, [key], ["idx"]).select("idx")


@query("dup7_earliest_per_url", f"""
WITH {CAPTURES} SELECT original, ts, idx FROM captures
QUALIFY row_number() OVER (PARTITION BY original ORDER BY ts, idx) = 1""")
def earliest_per_url(spark, folder):
    return dedup.keep_first(views.captures(spark, folder), ["original"], ["ts", "idx"]).select(
        "original", "ts", "idx").orderBy("ts", "original")


@query("dup8_whole_rows", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS qty FROM lineitem")
def whole_rows(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("qty")).dropDuplicates()


@query("dup9_merge_batches", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def merge_batches(spark, folder):
    rows = table(spark, folder, "orders")
    parts = [rows.filter(F.col("o_orderstatus") == s) for s in ("O", "F", "P")]
    return dedup.merge_batches(parts, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus")


@query("dup10_latest_record", """
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(CAST(value AS DOUBLE), event_id) AS value FROM events GROUP BY user_id""")
def latest_record(spark, folder):
    return dedup.latest_per_key(table(spark, folder, "events"), "user_id", ["event_id"]).select(
        "user_id", "event_id", "event_type", "value")
