"""Phrases, vocabularies, verb-noun pairs and word entropies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import tokens
from ..session import stored
from ..sources import views
from ..sources.views import POSTINGS, TERMS, TOKENS, VOCABULARY, sql_list
from ..functions import fixed
from .panels import rounded
from .registry import query

MIN_COUNT, MIN_PMI = 10, 1.0
SELECTED = TERMS + f""",
total AS (SELECT sum(len(tokens) - 1) AS n FROM toks),
phrases AS (
  SELECT p.a, p.b, p.n, ln(CAST(p.n AS DOUBLE) * total.n / (x.cf * y.cf)) AS pmi
  FROM pairs p JOIN terms x ON x.term = p.a JOIN terms y ON y.term = p.b, total
  WHERE p.n >= {MIN_COUNT} AND ln(CAST(p.n AS DOUBLE) * total.n / (x.cf * y.cf)) >= {MIN_PMI})"""


def docs(spark, folder):
    """Token table, written once for the queries that read it several times."""
    return stored(views.token_docs(spark, folder).select("id", "lang", "year", "tokens"))


def phrases(rows, **limit):
    return tokens.phrases_by_pmi(rows, min_count=MIN_COUNT, min_pmi=MIN_PMI, **limit)


@query("nlp1_pair_counts", f"WITH {TERMS} SELECT a, b, n FROM pairs")
def pair_counts(spark, folder):
    return tokens.pair_counts(views.token_docs(spark, folder))


@query("nlp2_phrases_by_pmi", f"WITH {SELECTED} SELECT a, b, n, round(pmi, 6) AS pmi FROM phrases ORDER BY n DESC, a, b LIMIT 200000")
def phrases_by_pmi(spark, folder):
    return rounded(phrases(docs(spark, folder)))


@query("nlp3_phrases_by_count", f"WITH {TERMS} SELECT a, b, n FROM pairs WHERE n >= 20")
def phrases_by_count(spark, folder):
    return tokens.phrases_by_count(views.token_docs(spark, folder))


@query("nlp4_collocations", f"""
WITH {TERMS}, v AS (SELECT (SELECT count(*) FROM terms) + (SELECT count(*) FROM pairs) AS v)
SELECT a, b, n, round((n - 5) * v / (x.cf * y.cf), 6) AS score FROM pairs JOIN terms x ON x.term = a JOIN terms y ON y.term = b, v
WHERE n >= 5 AND (n - 5) * v / (x.cf * y.cf) > 15""")
def collocations(spark, folder):
    return rounded(tokens.collocations(docs(spark, folder), min_count=5))


def _joining(source: str, out: str, least: int) -> str:
    """CTEs that join the collocations of a token table by the parity rule of `nlp5`."""
    n = out
    return f"""
{n}_t AS (SELECT term, count(*) AS cf FROM (SELECT unnest(tokens) AS term FROM {source}) GROUP BY term),
{n}_p AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:len(tokens)]) AS b FROM {source}) GROUP BY a, b),
{n}_v AS (SELECT (SELECT count(*) FROM {n}_t) + (SELECT count(*) FROM {n}_p) AS v),
{n}_c AS (SELECT a, b FROM {n}_p JOIN {n}_t x ON x.term = a JOIN {n}_t y ON y.term = b, {n}_v WHERE n >= {least} AND (n - {least}) * v / (x.cf * y.cf) > 15),
{n}_w AS (SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos, unnest(list_append(tokens[2:], NULL)) AS u FROM {source}),
{n}_f AS (SELECT w.*, c.a IS NOT NULL AS f FROM {n}_w w LEFT JOIN {n}_c c ON c.a = w.t AND c.b = w.u),
{n}_r AS (SELECT *, coalesce(max(CASE WHEN NOT f THEN pos END) OVER (PARTITION BY id ORDER BY pos), -1) + 1 AS start FROM {n}_f),
{n}_s AS (SELECT *, f AND (pos - start) % 2 = 0 AS joins FROM {n}_r),
{n}_o AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY id ORDER BY pos), false) AS eaten FROM {n}_s),
{out} AS (SELECT id, list(CASE WHEN joins THEN t || '_' || u ELSE t END ORDER BY pos) AS tokens FROM {n}_o WHERE NOT eaten GROUP BY id)"""


@query("nlp4_two_passes", f"""
WITH {TERMS}, {_joining("toks", "once", 5)}, {_joining("once", "twice", 3)}
SELECT id, md5(array_to_string(tokens, ' ')) AS digest, CAST(len(tokens) AS INTEGER) AS n FROM twice""")
def two_passes(spark, folder):
    """Documents after two joining passes."""
    out = tokens.two_pass_collocations(docs(spark, folder), min_counts=(5, 3))
    return out.select("id", F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").alias("n"))


@query("nlp5_merge_phrases", f"""
WITH {SELECTED}, w AS (
  SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos, unnest(list_append(tokens[2:], NULL)) AS u FROM toks),
f AS (SELECT w.*, p.a IS NOT NULL AS f FROM w LEFT JOIN phrases p ON p.a = w.t AND p.b = w.u),
r AS (SELECT *, coalesce(max(CASE WHEN NOT f THEN pos END) OVER (PARTITION BY id ORDER BY pos), -1) + 1 AS start FROM f),
s AS (SELECT *, f AND (pos - start) % 2 = 0 AS joins FROM r),
o AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY id ORDER BY pos), false) AS eaten FROM s)
SELECT id, md5(string_agg(CASE WHEN joins THEN t || '_' || u ELSE t END, ' ' ORDER BY pos)) AS digest, count(*) AS n FROM o WHERE NOT eaten GROUP BY id""")
def merge_phrases(spark, folder):
    rows = docs(spark, folder)
    out = tokens.merge_phrases(rows, phrases(rows, limit=None))  # every phrase joins, however many there are
    return out.select("id", F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").cast("bigint").alias("n"))


@query("udf2_phrase_merge", f"""
WITH {TERMS}, phrases AS (SELECT a, b FROM pairs WHERE n >= 20), w AS (
  SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos, unnest(list_append(tokens[2:], NULL)) AS u FROM toks),
f AS (SELECT w.*, p.a IS NOT NULL AS f FROM w LEFT JOIN phrases p ON p.a = w.t AND p.b = w.u),
r AS (SELECT *, coalesce(max(CASE WHEN NOT f THEN pos END) OVER (PARTITION BY id ORDER BY pos), -1) + 1 AS start FROM f)
SELECT CAST("year" AS INTEGER) AS "year", count(*) AS n_joined FROM r JOIN docs USING (id) WHERE f AND (pos - start) % 2 = 0 GROUP BY "year" """)
def phrase_merge(spark, folder):
    """Joined phrases per year, with the phrases chosen by count."""
    rows = docs(spark, folder)
    out = tokens.merge_phrases(rows, tokens.held_phrases_by_count(rows))
    joined = F.filter("tokens", lambda t: t.contains("_"))
    return out.select("year", F.explode(joined)).groupBy("year").agg(F.count(F.lit(1)).alias("n_joined"))


def vocabulary_of(rows):
    return tokens.vocabulary(rows, "id", min_df=views.MIN_DF)


@query("nlp6_vocabulary", f"WITH {VOCABULARY} SELECT term, df, cf FROM vocab")
def vocabulary(spark, folder):
    return vocabulary_of(docs(spark, folder))


@query("nlp7_frequency_vocabulary", f"""
WITH {TERMS}, r AS (SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM terms)
SELECT term, cf FROM r WHERE cf >= 10 AND rank > 15""")
def frequency_vocabulary(spark, folder):
    return tokens.frequency_vocabulary(docs(spark, folder))


@query("nlp8_gate_tokens", f"""
WITH {POSTINGS}, t AS (SELECT row_id, [trim(education), experience, category, '3年经验', 'Java'] AS tokens FROM postings)
SELECT row_id, array_to_string(list_filter(tokens, lambda t: NOT (trim(t) IN ({sql_list(fixed.GATE_TERMS)}) OR regexp_matches(trim(t), '{'|'.join(fixed.GATE_PATTERNS)}'))), ' ') AS kept FROM t""")
def gate_tokens(spark, folder):
    items = F.array(F.trim("education"), F.col("experience"), F.col("category"), F.lit("3年经验"), F.lit("Java"))
    return views.postings(spark, folder).select(
        "row_id", F.array_join(text.drop_gate_tokens(items), " ").alias("kept"))


@query("nlp9_bag_of_words", f"WITH {VOCABULARY} SELECT id, term, n FROM doc_terms WHERE term IN (SELECT term FROM vocab)")
def bag_of_words(spark, folder):
    rows = docs(spark, folder)
    return tokens.bag_of_words(rows, "id", vocabulary_of(rows)).select("id", "term", "n")


LEXICON = TERMS + """,
lexicon AS (SELECT term AS word, CASE length(term) % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'n' ELSE 'x' END AS pos FROM terms)"""


def lexicon(rows):
    size = F.length("term") % 3
    return tokens.term_counts(rows).select(
        F.col("term").alias("word"), F.when(size == 0, "v").when(size == 1, "n").otherwise("x").alias("pos"))


VERB_NOUN = LEXICON + """,
vn AS (
  SELECT CASE WHEN x.pos = 'v' THEN a ELSE b END AS verb, CASE WHEN x.pos = 'v' THEN b ELSE a END AS noun, CAST(sum(n) AS BIGINT) AS n
  FROM pairs JOIN lexicon x ON x.word = a JOIN lexicon y ON y.word = b
  WHERE length(a) >= 2 AND length(b) >= 2 AND ((x.pos = 'v' AND y.pos = 'n') OR (x.pos = 'n' AND y.pos = 'v')) GROUP BY 1, 2)"""


@query("nlp10_verb_noun_pairs", f"WITH {VERB_NOUN} SELECT verb, noun, n FROM vn")
def verb_noun_pairs(spark, folder):
    rows = docs(spark, folder)
    return tokens.verb_noun_pairs(rows, lexicon(rows))


@query("nlp11_verb_noun_products", f"""
WITH {LEXICON}, w AS (SELECT id, term, pos, n FROM doc_terms JOIN lexicon ON word = term WHERE pos <> 'x')
SELECT v.term AS verb, o.term AS noun, CAST(sum(v.n * o.n) AS BIGINT) AS n FROM w v JOIN w o ON v.id = o.id AND v.pos = 'v' AND o.pos = 'n' GROUP BY 1, 2""")
def verb_noun_products(spark, folder):
    rows = docs(spark, folder)
    return tokens.verb_noun_products(rows, "id", lexicon(rows))


@query("nlp12_frequent_pairs", f"""
WITH {VERB_NOUN}, k AS (SELECT * FROM vn WHERE n >= 5) SELECT verb, noun, n FROM k WHERE n <= (SELECT quantile_cont(n, 0.99) FROM k)""")
def frequent_pairs(spark, folder):
    return tokens.frequent_pairs(verb_noun_pairs(spark, folder))


@query("nlp13_pair_trends", f"""
WITH {TERMS}, p AS (
  SELECT DISTINCT id, "year", a, b FROM (SELECT id, "year", unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:len(tokens)]) AS b FROM toks)),
c AS (SELECT a, b, count(*) FILTER ("year" = 2016) AS n_first, count(*) FILTER ("year" = 2025) AS n_last FROM p GROUP BY a, b)
SELECT a, b, n_first, n_last, round(n_last / greatest(n_first, 1), 6) AS growth_rate, CASE WHEN n_last / greatest(n_first, 1) > 2 THEN 'emerging'
  WHEN n_first > 0 AND n_last / greatest(n_first, 1) < 0.5 THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def pair_trends(spark, folder):
    out = tokens.pair_trends(views.token_docs(spark, folder), tokens.neighbours(F.col("tokens")), "year", 2016, 2025)
    return rounded(out)


@query("nlp14_word_entropy", f"""
WITH {TERMS}, d AS (SELECT id, CAST(sum(n) AS BIGINT) AS total, count(*) AS v FROM doc_terms GROUP BY id),
h AS (SELECT t.id, -sum(n / total * ln(n / total)) AS h FROM doc_terms t JOIN d ON d.id = t.id GROUP BY t.id)
SELECT h.id, round(CASE WHEN v <= 1 THEN 0 ELSE h / ln(v) END, 6) AS word_entropy, CAST(v AS INTEGER) AS unique_words, CAST(total AS INTEGER) AS total_words
FROM h JOIN d ON d.id = h.id""")
def word_entropy(spark, folder):
    out = tokens.word_entropy(views.token_docs(spark, folder), "id")
    return rounded(out.select("id", "word_entropy", "unique_words", "total_words"))


@query("nlp15_window_similarity", f"""
WITH {TOKENS}, s AS (SELECT id, "year", list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1])) AS p FROM toks WHERE "year" IN (2016, 2025)),
j AS (SELECT len(list_intersect(a.p, b.p)) AS shared, len(a.p) + len(b.p) AS total FROM s a JOIN s b ON a."year" = 2016 AND b."year" = 2025)
SELECT round(avg(shared / (total - shared)), 6) AS avg_similarity, round(max(shared / (total - shared)), 6) AS max_similarity, round(min(shared / (total - shared)), 6) AS min_similarity FROM j""")
def window_similarity(spark, folder):
    return rounded(tokens.window_pair_similarity(
        docs(spark, folder), "id", tokens.neighbours(F.col("tokens")), "year", 2016, 2025))


@query("nlp15_adjacent_windows", f"""
WITH {TOKENS}, s AS (SELECT id, "year", list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1])) AS p FROM toks),
y AS (SELECT "year" AS first, lead("year") OVER (ORDER BY "year") AS last FROM (SELECT DISTINCT "year" FROM toks)),
j AS (SELECT first, last, len(list_intersect(a.p, b.p)) AS shared, len(a.p) + len(b.p) AS total FROM y JOIN s a ON a."year" = first JOIN s b ON b."year" = last)
SELECT first, last, count(*) AS n_pairs, round(avg(shared / (total - shared)), 6) AS avg_similarity, round(max(shared / (total - shared)), 6) AS max_similarity,
  round(min(shared / (total - shared)), 6) AS min_similarity FROM j GROUP BY first, last""")
def adjacent_windows(spark, folder):
    """Every year with the next: all documents take part."""
    return rounded(tokens.adjacent_window_similarity(docs(spark, folder), "id", tokens.neighbours(F.col("tokens")), "year"))


# the flagship query: word entropy and length by language and year
FLAGSHIP = TERMS + """,
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS total, count(*) AS v FROM doc_terms GROUP BY id),
h AS (SELECT t.id, -sum(n / total * ln(n / total)) AS h FROM doc_terms t JOIN d ON d.id = t.id GROUP BY t.id)
SELECT lang, "year", count(*) AS n_docs, round(avg(CASE WHEN v <= 1 THEN 0 ELSE h / ln(v) END), 6) AS mean_entropy,
  round(avg(total), 6) AS mean_tokens FROM h JOIN d ON d.id = h.id JOIN toks ON toks.id = h.id GROUP BY lang, "year" """


@query("entropy_by_group_and_year", f"WITH {FLAGSHIP}")
def entropy_by_group(spark, folder):
    rows = tokens.word_entropy(views.token_docs(spark, folder), "id")
    return rounded(rows.groupBy("lang", "year").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("word_entropy").alias("mean_entropy"),
        F.avg("total_words").alias("mean_tokens")))
