"""Keyword rules and dictionaries of any size against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobpanel.functions import segment, skills
from jobpanel.operators import lookup, rule_index


def _texts(rng, n):
    words = ["沟通", "数据分析", "python", "c++", "管理", "项目", "a", ".", "(x)", " ", "报表", "分析"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "数"), (n + 3, "数据分析" * 3000)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    texts = _texts(rng, 120)
    rules = [(k, w) for k, w in enumerate(["沟通", "数据", "数据分析", "分析报", "c+", "a", "(x", "无", "", "管理", "管理"])]
    return spark.createDataFrame(texts, "id long, t string"), texts, spark.createDataFrame(rules, "code int, keyword string"), rules


def test_keyword_hits(data):
    df, texts, rules, plain = data
    got = {(r["id"], r["code"]) for r in rule_index.keyword_hits(df, "id", "t", rules).collect()}
    assert got == {(i, c) for i, t in texts for c, w in plain if w and w in (t or "")}
    long_only = rules.filter(F.length("keyword") > 2)
    got = {(r["id"], r["code"]) for r in rule_index.keyword_hits(df, "id", "t", long_only).collect()}
    assert got == {(i, c) for i, t in texts for c, w in plain if len(w) > 2 and w in (t or "")}
    assert rule_index.keyword_hits(df, "id", "t", rules.limit(0)).count() == 0


def test_dictionary_counts(data):
    df, texts, rules, plain = data
    got = {r["id"]: r["skill_count"] for r in lookup.dictionary_counts(df, "id", "t", rules, "keyword").collect()}
    words = {w for _, w in plain if len(w) >= 2}
    assert got == {i: sum(w in (t or "").lower() for w in words) for i, t in texts}


def test_scores_equal_the_expression(spark, data):
    df, texts, *_ = data
    tables = {"one": (["沟通", "Python"], {1: ["a"], 3: ["管理"], 5: ["报表"]}), "two": (["C+"], {2: ["项目"]}), "three": (["无"], {4: ["a"]})}
    rules = [(d, n, w) for d, (words, levels) in tables.items() for n, ws in [(0, words), *levels.items()] for w in ws]
    df = df.withColumn("edu", F.when(F.col("id") % 3 == 0, "博士").when(F.col("id") % 3 == 1, "高中"))
    got = rule_index.skill_scores(df, "id", "t", "edu", spark.createDataFrame(rules, "dimension string, level int, keyword string"), list(tables))
    want = df.select("id", *[skills.skill_score(F.col("t"), F.col("edu"), w, lv).alias(d) for d, (w, lv) in tables.items()])
    assert sorted(got.select("id", *tables).collect()) == sorted(want.collect())


def test_tags_equal_the_expression(spark, data):
    df, *_ = data
    categories = [("x", ["Python", "沟通"], [("初级", ["a"]), ("中级", ["管理"])]), ("y", ["分析"], [("初级", ["无"])]), ("z", ["无"], [("初级", ["a"])])]
    labels, rows = ["初级", "中级"], []
    for place, (name, words, levels) in enumerate(categories):
        rows += [(place, name, 0, k, w) for k, w in enumerate(words)]
        rows += [(place, name, labels.index(lv) + 1, 0, w) for lv, ws in levels for w in ws]
    rules = spark.createDataFrame(rows, "place int, category string, level int, priority int, keyword string")
    got = rule_index.skill_tags(df, "id", "t", rules, labels).select("id", "tags")
    want = df.select("id", skills.skill_tags(F.col("t"), categories).alias("tags"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_segmentation_by_table_equals_the_function(spark):
    rng = random.Random(2)
    letters = "甲乙丙丁"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)})
    rows = [(i, [rng.choice(["ab", "x", "".join(rng.choice(letters + "戊") for _ in range(rng.randint(1, 14)))]) for _ in range(rng.randint(0, 6))]) for i in range(150)]
    rows += [(500, None), (501, []), (502, ["甲乙丙丁" * 500])]
    df = spark.createDataFrame(rows, "id long, runs array<string>")
    got = {r["id"]: r["tokens"] for r in rule_index.segment_runs(df, "id", "runs", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    known = set(terms)
    want = {i: [w for r in runs or [] for w in ([r] if r.isascii() else segment.longest_match(r, known, 5))] for i, runs in rows}
    assert got == want


def test_a_large_dictionary(spark):
    words = sorted({chr(19968 + i % 20_000) + chr(19968 + i // 10) for i in range(200_000)})
    terms = spark.createDataFrame(pd.DataFrame({"term": words}))
    first = chr(19968 + 77) + chr(19968 + 7)
    df = spark.createDataFrame([(1, ["丠" * 3 + first])], "id long, runs array<string>")
    tokens = rule_index.segment_runs(df, "id", "runs", terms).first()["tokens"]
    assert "".join(tokens) == "丠" * 3 + first and tokens[-1] == first


def test_terms_of_one_opening_stay_in_the_task(spark):
    terms = spark.createDataFrame(pd.DataFrame({"term": [f"12{i}" for i in range(30_000)] + ["编号", "a" * 40]}))
    texts = [(1, "编号1229999"), (2, "x12" + "a" * 41), (None, "编号"), (4, None), (5, "😀编号😀120")]
    df = spark.createDataFrame(texts, "id long, t string")
    out = lookup.dictionary_counts(df, "id", "t", terms, "term")
    assert {r["id"]: r["skill_count"] for r in out.collect()} == {1: 6, 2: 1, None: 0, 4: 0, 5: 2}
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_paths_agree_on_repeated_keys(spark, data, monkeypatch):
    df, _, rules, _ = data
    twice = df.union(df.limit(30)).union(df.limit(9).select((F.col("id") + 1).alias("id"), "t"))
    scored = rules.select((F.col("code") % 3).cast("string").alias("dimension"), (F.col("code") % 4).alias("level"), "keyword")
    tagged = rules.select((F.col("code") % 2).alias("place"), F.lit("c").alias("category"), (F.col("code") % 3).alias("level"), (-F.col("code")).alias("priority"), "keyword")

    def found(rows):
        rows = rows.withColumn("edu", F.lit("博士"))
        return [sorted(map(repr, x.collect())) for x in (
            rule_index.keyword_hits(rows, "id", "t", rules), lookup.dictionary_counts(rows, "id", "t", rules, "keyword"),
            rule_index.skill_scores(rows, "id", "t", "edu", scored, ["0", "1", "2"]), rule_index.skill_tags(rows, "id", "t", tagged, ["x"]))]

    near = found(twice), found(df)
    monkeypatch.setattr(rule_index, "MAX_CHARACTERS", 0)
    assert near == (found(twice), found(df))
