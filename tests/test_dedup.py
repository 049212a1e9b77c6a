"""De-duplication and exact ranks against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobpanel.operators import blocks, dedup, lookup, ranks


def _greedy(rows, threshold):
    """Sequential rule on (id, block, text)."""
    kept, out = {}, {}
    for i, block, raw in sorted(rows):
        t = re.sub("[^一-龥a-zA-Z0-9]", "", raw or "")
        if not t:
            out[i] = False
            continue
        grams = {t[j:j + 3] for j in range(len(t) - 2)} or {"\0" + t}
        near = any(len(grams & g) / len(grams | g) >= threshold for g in kept.get(block, []))
        out[i] = not near
        if not near:
            kept.setdefault(block, []).append(grams)
    return out


def _texts(rng):
    base = ["".join(rng.choice("abcdefghij数据分析系统") for _ in range(rng.randint(60, 200))) for _ in range(12)]
    rows = []
    for i in range(260):
        t = list(rng.choice(base[:2]) if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, rng.choice(["u", "v"]), "".join(t)))
    return rows + [(900, "u", ""), (901, "u", None), (902, "u", "ab"), (903, "u", "a-b"), (904, "u", "!!")]


@pytest.mark.parametrize("parts", [1, 7])
def test_near_duplicates_follow_the_greedy_rule(spark, parts):
    rows = _texts(random.Random(3))
    df = spark.createDataFrame(rows, "id long, b string, t string").repartition(parts)
    got = {r["id"]: r["status"] for r in dedup.near_duplicates(df, "id", "t", ["b"]).collect()}
    want = _greedy(rows, 0.9)
    assert len(got) == len(rows)
    assert not [i for i in want if (got[i] == "kept") != want[i]]
    assert got[900] == got[901] == got[904] == "empty" and got[903] == "copy"


def test_frequent_shingles_and_families_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(dedup, "FREQUENT", 12)
    monkeypatch.setattr(dedup, "PARITY_WORDS", 1)
    family = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = _texts(rng)[:60]
    for i in range(40):  # one large family, which drifts
        t = list(family)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        if i % 20 == 0:
            family = "".join(t)
        rows.append((2000 + i, "u", "".join(t)))
    df = spark.createDataFrame(rows, "id long, b string, t string").repartition(3)
    got = {r["id"]: r["status"] == "kept" for r in dedup.near_duplicates(df, "id", "t", ["b"]).collect()}
    assert got == _greedy(rows, 0.9)


def test_alike_sets_meet_in_the_index(spark):
    """Every pair at the threshold, the least that counts included, shares a bucket."""
    rng = random.Random(8)
    rows, pairs = [], []
    for k in range(300):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), rng.randint(max(1, int(n * 0.85)), n))) | {-rng.randrange(10**6) for _ in range(rng.randint(0, 3))}
        rows += [(2 * k, 0, sorted(a), len(a)), (2 * k + 1, 0, sorted(b), len(b))]
        if a != b and len(a & b) / len(a | b) >= 0.9:
            pairs.append((2 * k + 1, 2 * k))
    sets = spark.createDataFrame(rows, "id long, block long, sh array<bigint>, n int")
    index = dedup._index(sets, 0.9)
    near = dedup._near(dedup._parities(sets.select("id", "sh")), dedup._met(index, index, 0.9), 0.9)
    found = {tuple(r) for r in near.collect()}
    assert pairs and set(pairs) <= found


def test_shingle_hashes_are_sorted_and_as_many_as_the_shingles(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab一龥é😀") for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 3000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r["id"]: r["h"] for r in df.select("id", dedup.shingle_hashes(F.col("t")).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sorted(set(got[i])) and len(got[i]) == len({t[k:k + 3] for k in range(len(t) - 2)} if t else [])
    assert not any(got[i] for i in (0, 1, 2, 7))


def test_stored_tables_leave_no_shuffle_files_and_can_go(spark):
    import os

    from jobpanel.session import discard, stored

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().mkString("\n").count("shuffle_")
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files.getAllFiles().mkString("\n").count("shuffle_") <= before and out.count() == 7
    (folder,) = {os.path.dirname(f).removeprefix("file:") for f in out.inputFiles()}
    discard(out)
    assert not os.path.exists(folder.replace("//", "/"))


def test_jaccard_is_exact(spark):
    df = spark.createDataFrame([("abcdef", "abcdxy")], "a string, b string")
    x = df.select(dedup.jaccard(dedup.shingles(F.col("a")), dedup.shingles(F.col("b")))).first()[0]
    assert x == pytest.approx(2 / 6)


def test_split_duplicates_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id long, t string")
    got = dedup.split_duplicates(df, dedup.text_key(F.col("t")), "id")
    assert {r["id"]: r["is_duplicate"] for r in got.collect()} == {1: 0, 3: 1, 2: 0, 4: 0, 5: 1}
    once = got.filter("is_duplicate = 0").drop("is_duplicate")
    again = dedup.split_duplicates(once, dedup.text_key(F.col("t")), "id")
    assert again.filter("is_duplicate = 1").count() == 0


def test_keep_first_uses_a_partial_limit(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = dedup.keep_first(df, ["k"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r["id"] for r in out.collect()} == {0, 1, 2}


@pytest.mark.parametrize("parts", [1, 8])
def test_ranked_matches_pandas(spark, parts):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["hot"] * 6 + ["a", "b"], 500), "v": rng.integers(0, 40, 500), "id": range(500)})
    df = spark.createDataFrame(pdf).repartition(parts)
    got = ranks.ranked(df, ["v", "id"], ["g"]).toPandas().set_index("id")["rank"].sort_index()
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got.to_numpy() == want.sort_index().to_numpy()).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    sizes = {"hot": 60_000, "cold": 7, "two": 2, "one": 1, "ties": 40}
    g = [k for k, n in sizes.items() for _ in range(n)]
    pdf = pd.DataFrame({"g": g, "v": np.round(rng.normal(size=len(g)), 3), "w": rng.normal(size=len(g))})
    pdf.loc[pdf["g"] == "ties", "v"] = 1.5
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([("hot", None, None)], "g string, v double, w double"))
    picks = {"a": ("v", 0.25), "b": ("v", 0.5), "c": ("w", 0.9), "least": ("v", 0.0), "most": ("w", 1.0)}
    got = ranks.exact_quantiles(df, ["g"], picks).toPandas().set_index("g")
    assert len(got) == len(sizes)
    for name, (c, p) in picks.items():
        want = pdf.groupby("g")[c].quantile(p)
        assert got[name].loc[want.index].to_numpy() == pytest.approx(want.to_numpy())


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 3, 9]] + [("b", 2)], "g string, v int")
    got = {r["g"]: r["m"] for r in ranks.order_statistics(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 5, "b": 2}


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "数据分析和数据"), (2, "会计"), (3, "")], "id int, t string")
    words = spark.createDataFrame([("数据", 1), ("数据分析", 2), ("会计", 3), ("计", 4)], "w string, c int")
    got = {(r["id"], r["c"]) for r in lookup.contains_join(texts, "t", words, "w").collect()}
    assert got == {(1, 1), (1, 2), (2, 3), (2, 4)}


def test_block_comparison_covers_every_pair_once(spark):
    left, right = spark.range(57), spark.range(33)
    got = blocks.compare_blocks(
        left, right, lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n bigint", block_rows=10)
    assert got.agg(F.sum("n")).first()[0] == 57 * 33


def test_large_limits_are_taken_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PARTIAL_LIMIT", 2)
    df = spark.range(300).select("id", (F.col("id") % 2).alias("k"))
    got = ranks.top_per_key(df, ["k"], [F.desc("id")], 5, rank="r").collect()
    assert {(r["k"], r["id"], r["r"]) for r in got} == {
        (k, 298 + k - 2 * i, i + 1) for k in (0, 1) for i in range(5)}


def test_rule_tables_and_null_values(spark):
    rules = spark.createDataFrame([(2, "数据", "B"), (1, "数据分析", "A"), (3, "计", "C"), (0, "没有", "Z")], "priority int, keyword string, code string")
    df = spark.createDataFrame([(1, "数据分析师"), (2, "大数据"), (3, "会计"), (4, None), (5, ""), (6, "司机")], "id int, company string")
    got = {r["id"]: r["industry_code"] for r in lookup.classify_companies(df, rules).collect()}
    assert got == {1: "A", 2: "B", 3: "C", 4: None, 5: None, 6: None}
    exposure = spark.createDataFrame([("A", 0.5, 0.1, "Gradient 1")], "isco08_4digit string, mean_score double, sd_score double, exposure_gradient string")
    titles = spark.createDataFrame([(1, "数据分析师"), (2, None), (3, None)], "id int, title string")
    out = {r["id"]: r for r in lookup.classify_titles(titles, rules, exposure).collect()}
    assert (out[1]["ai_mean_score"], out[1]["isco_match_method"]) == (0.5, "keyword")
    assert all((out[i]["ai_exposure_gradient"], out[i]["ai_mean_score"], out[i]["isco_match_method"]) == ("unknown", 0.25, "unknown") for i in (2, 3))


def test_contains_join_with_few_keywords_moves_no_text(spark):
    texts = spark.createDataFrame([(1, "数据分析"), (1, "数据分析"), (None, "会计"), (3, None), (4, "")], "id int, t string")
    words = spark.createDataFrame([("数据", 1), ("数", 2), ("会计", 3), ("", 4), (None, 5)], "w string, c int")
    out = lookup.contains_join(texts, "t", words, "w")
    assert sorted((r["id"] or 0, r["c"]) for r in out.collect()) == [(0, 3), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert "hashpartitioning" not in out._jdf.queryExecution().toString()


def test_contains_join_with_many_keywords(spark):
    words = spark.createDataFrame([(f"k{i}.", i) for i in range(200)] + [("z", 900)], "w string, c int")
    texts = spark.createDataFrame([(1, "k7.k177."), (2, "k1"), (3, "z")], "id int, t string")
    got = sorted((r["id"], r["c"]) for r in lookup.contains_join(texts, "t", words, "w").collect())
    assert got == [(1, 7), (1, 177), (3, 900)]
