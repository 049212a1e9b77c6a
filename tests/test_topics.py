"""Tokens, topics, metrics, vectors and evolution against numpy and hand-made cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobpanel.functions import theta as metrics, vec
from jobpanel.operators import evolution, panel, tokens, topics, vectors

DOCS = [(1, 2016, "a b c a b d e f a b".split()), (2, 2016, "a b x y z a b".split()),
        (3, 2017, "c d c d c d a b".split()), (4, 2017, "q r s t u v".split())]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, year int, tokens array<string>")


def test_phrases_by_pmi(docs):
    words = Counter(t for _, _, d in DOCS for t in d)
    pairs = Counter(p for _, _, d in DOCS for p in zip(d, d[1:]))
    total = sum(pairs.values())
    want = {p: math.log(n * total / (words[p[0]] * words[p[1]])) for p, n in pairs.items() if n >= 2}
    got = {(r["a"], r["b"]): r["pmi"] for r in tokens.phrases_by_pmi(docs, min_count=2, min_pmi=-9).collect()}
    assert got == pytest.approx(want)


def test_pairs_counted_in_shares_are_all_pairs(spark, monkeypatch):
    rows = [*((i, d) for i, _, d in DOCS), (1, ["a", "b", "a"]), (7, None), (8, []), (None, ["x"]), (9, ["a", None, "b"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = sorted(map(tuple, tokens.pair_counts(df).collect()), key=repr)
    plain = sorted(map(tuple, tokens.collocations(df, "tokens", 1, 0.1).collect()))
    for pairs_at_once in (10**9, 10, 1):
        monkeypatch.setattr(tokens, "SHARE_PAIRS", pairs_at_once)
        found, n = tokens.frequent_pair_counts(df, "tokens", 1)
        assert sorted(map(tuple, found.collect()), key=repr) == want and n == len(want)
        few, n = tokens.frequent_pair_counts(df, "tokens", 3)
        assert sorted(map(tuple, few.collect()), key=repr) == [r for r in want if r[2] >= 3] and n == len(want)
        assert sorted(map(tuple, tokens.held_phrases_by_count(df, min_count=3).collect()), key=repr) == [r for r in want if r[2] >= 3]
        assert sorted(map(tuple, tokens.collocations(df, "tokens", 1, 0.1).collect())) == plain


def test_merge_phrases(docs, spark):
    chosen = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r["id"]: r["tokens"] for r in tokens.merge_phrases(docs, chosen).collect()}
    assert got[1] == ["a_b", "c", "a_b", "d", "e", "f", "a_b"]
    empty = chosen.limit(0)
    assert {r["id"]: r["tokens"] for r in tokens.merge_phrases(docs, empty).collect()} == {i: d for i, _, d in DOCS}


def test_word_entropy(docs, spark):
    got = {r["id"]: r for r in tokens.word_entropy(docs, "id").collect()}
    for i, _, d in DOCS:
        p = np.array(list(Counter(d).values())) / len(d)
        assert got[i]["word_entropy"] == pytest.approx(-(p * np.log(p)).sum() / math.log(len(p)))
        assert (got[i]["unique_words"], got[i]["total_words"]) == (len(p), len(d))
    same = spark.createDataFrame([(9, ["z", "z"])], "id long, tokens array<string>")
    assert tokens.word_entropy(same, "id").first()["word_entropy"] == 0.0


def test_pairs_do_not_depend_on_partitions(docs):
    one = sorted(map(tuple, tokens.pair_counts(docs.repartition(1)).collect()))
    assert one == sorted(map(tuple, tokens.pair_counts(docs.repartition(8)).collect()))


def test_verb_noun_pairs(spark):
    rows = spark.createDataFrame([(1, "负责 系统 开发 软件 很 项目".split())], "id long, tokens array<string>")
    lexicon = spark.createDataFrame(
        [("负责", "v"), ("系统", "n"), ("开发", "vn"), ("软件", "n"), ("很", "d"), ("项目", "n")], "word string, pos string")
    got = {(r["verb"], r["noun"]): r["n"] for r in tokens.verb_noun_pairs(rows, lexicon).collect()}
    assert got == {("负责", "系统"): 1, ("开发", "系统"): 1, ("开发", "软件"): 1}
    both = {(r["verb"], r["noun"]): r["n"] for r in tokens.verb_noun_products(rows, "id", lexicon).collect()}
    assert len(both) == 6 and both[("负责", "项目")] == 1


def test_window_similarity_in_blocks(docs):
    pairs = tokens.neighbours(F.col("tokens"))
    r = tokens.window_pair_similarity(docs, "id", pairs, "year", 2016, 2017, block_rows=1).first()
    sets = {i: set(zip(d, d[1:])) for i, _, d in DOCS}
    sims = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in (1, 2) for j in (3, 4)]
    assert r["avg_similarity"] == pytest.approx(np.mean(sims))
    assert (r["max_similarity"], r["min_similarity"]) == pytest.approx((max(sims), min(sims)))


def test_every_window_is_compared_with_the_next(spark):
    rows = DOCS + [(5, 2019, "a b c d c d".split()), (6, 2019, "x y z".split()), (7, None, "a b".split())]
    df = spark.createDataFrame(rows, "id long, year int, tokens array<string>")
    sets = {i: set(zip(d, d[1:])) for i, _, d in rows}
    for block_rows in (1, 5000):
        out = tokens.adjacent_window_similarity(df, "id", tokens.neighbours(F.col("tokens")), "year", block_rows).collect()
        got = {(r["first"], r["last"]): r for r in out}
        assert sorted(got) == [(2016, 2017), (2017, 2019)] and len(out) == 2
        for (first, last), r in got.items():
            sims = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, v, _ in rows for j, w, _ in rows if (v, w) == (first, last)]
            assert r["n_pairs"] == len(sims) and r["avg_similarity"] == pytest.approx(np.mean(sims))
            assert (r["max_similarity"], r["min_similarity"]) == pytest.approx((max(sims), min(sims)))


def test_sets_of_adjacent_windows_are_not_shuffled(spark):
    import os

    rng = np.random.default_rng(5)
    rows = [(i // 2, str(i % 3), [str(t) for t in rng.integers(0, 40, 0 if i == 5 else 300)]) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, w string, tokens array<string>")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = held()
    out = {r["first"]: r for r in tokens.adjacent_window_similarity(df, "id", tokens.neighbours(F.col("tokens")), "w", 20).collect()}
    assert sum(os.path.getsize(f) for f in held() - before if os.path.exists(f)) < 50_000
    sets = {k: [set(zip(d, d[1:])) for _, w, d in rows if w == k] for k in "012"}
    for a, b in ("01", "12"):
        sims = [len(x & y) / max(len(x | y), 1) for x in sets[a] for y in sets[b]]
        assert out[a]["n_pairs"] == 3600 and out[a]["last"] == b
        assert tuple(out[a])[3:] == pytest.approx((np.mean(sims), max(sims), min(sims)))


def test_inference_matches_numpy(docs, spark):
    rng = np.random.default_rng(0)
    vocabulary = sorted({t for _, _, d in DOCS for t in d} - {"q", "r"})
    p = rng.dirichlet(np.ones(len(vocabulary)), 3)
    table = spark.createDataFrame(
        [(w, [float(x) for x in p[:, i]]) for i, w in enumerate(vocabulary)], "term string, p array<double>")
    alpha = [0.2, 0.3, 0.5]
    got = {r["id"]: np.array(r["theta"]) for r in topics.infer(docs, "id", table, alpha, noise=[1]).collect()}
    assert set(got) == {1, 2, 3}  # document 4 has four known tokens
    for i, _, d in DOCS[:3]:
        at = [vocabulary.index(t) for t in d if t in vocabulary]
        s = np.log(p[:, at] + 1e-12).mean(axis=1) + np.log(np.array(alpha) + 1e-12)
        e = np.exp(s - s.max())
        e[1] = 0
        assert got[i] == pytest.approx(e / e.sum())


def _value(spark, column, values):
    df = spark.createDataFrame([([float(x) for x in values],)], "t array<double>")
    return df.select(column(F.col("t"))).first()[0]


def test_metrics_of_extreme_shares(spark):
    k = 5
    flat, one = [1 / k] * k, [0.0, 1.0, 0.0, 0.0, 0.0]
    assert _value(spark, lambda t: metrics.entropy(t, k), flat) == pytest.approx(1)
    assert _value(spark, lambda t: metrics.entropy(t, k), one) == pytest.approx(0, abs=1e-9)
    assert _value(spark, metrics.hhi, flat) == pytest.approx(1 / k)
    assert _value(spark, metrics.effective_topics, flat) == pytest.approx(k)
    assert _value(spark, metrics.gini, flat) == pytest.approx(0)
    assert _value(spark, metrics.gini, one) == 1.0
    assert _value(spark, lambda t: metrics.significant_topics(t, k), flat) == 0
    assert _value(spark, lambda t: metrics.significant_topics(t, k), one) == 1
    assert _value(spark, metrics.tail_mass, flat) == pytest.approx(1 - 3 / k)
    assert _value(spark, metrics.dominant_topic, [0.4, 0.4, 0.2]) == 0
    assert _value(spark, lambda t: metrics.effective_domains(metrics.entropy(t, k), k), flat) == pytest.approx(k)
    distances = [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    assert _value(spark, lambda t: metrics.rao_q(t, distances), [0.5, 0.3, 0.2]) == pytest.approx(
        2 * (0.15 * 1 + 0.1 * 2 + 0.06 * 3))


def test_softmax_sums_to_one(spark):
    assert sum(_value(spark, vec.softmax, [0.1, 700.0, 701.0])) == pytest.approx(1)


def test_nearest_on_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 6)), rng.normal(size=(25, 6))
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "id long, v array<double>")
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], "id long, v array<double>")
    sims = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-sims[i])[:3]}
    for size in (10**6, 1):
        monkeypatch.setattr(vectors, "MAX_MODEL_CELLS", size)
        got = vectors.nearest(left, right, 3, block_rows=11).collect()
        assert {(r["id"], r["neighbour"]) for r in got} == want
        assert all(r["sim"] == pytest.approx(sims[r["id"], r["neighbour"]]) for r in got)


def test_similarity_moments(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 5))
    g = np.arange(60) % 3
    df = spark.createDataFrame([(int(x), [float(y) for y in v]) for x, v in zip(g, m)], "g int, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in vectors.similarity_moments(df, "g", 5).collect():
        s = u[g == r["group_from"]] @ u[g == r["group_to"]].T
        assert (r["mean_similarity"], r["std_similarity"]) == pytest.approx((s.mean(), s.std()))


@pytest.mark.parametrize("k,exclude_self,block_rows", [(1, False, 4000), (4, True, 50)])
def test_pruned_search_finds_the_same_neighbours(spark, k, exclude_self, block_rows):
    from jobpanel.operators import vectors

    rng = np.random.default_rng(7)
    middles = rng.normal(size=(25, 12))
    v = middles[rng.integers(0, 25, 1500)] + 0.08 * rng.normal(size=(1500, 12))
    v[3] = 0.0
    v[40:90] = v[40]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    right = spark.createDataFrame(rows, "id long, v array<double>")
    left = spark.createDataFrame(rows[::7] + [(3, rows[3][1]), (40, rows[40][1])], "id long, v array<double>").distinct()
    got, compared = vectors.pruned_nearest(left, right, k, block_rows, exclude_self)
    want = vectors.nearest(left, right, k, exclude_self=exclude_self)
    a = {(r["id"], r["rank"]): (r["neighbour"], r["sim"]) for r in got.collect()}
    b = {(r["id"], r["rank"]): (r["neighbour"], r["sim"]) for r in want.collect()}
    assert set(a) == set(b) and all(a[x][1] == pytest.approx(b[x][1], abs=1e-12) for x in a)
    assert sum(a[x][0] == b[x][0] for x in a) >= len(a) - 60  # copies differ in the last digit of their products
    assert compared < 0.35 * left.count() * right.count()


def test_pruned_search_of_few_rows(spark):
    from jobpanel.operators import vectors

    right = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    left = spark.createDataFrame([(5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, [-1.0, 0.0])], "id long, v array<double>")
    got, _ = vectors.pruned_nearest(left, right, 5)
    assert {(r["id"], r["rank"], r["neighbour"]) for r in got.collect()} == {(5, 1, 1), (5, 2, 2), (6, 1, 1), (6, 2, 2), (7, 1, 2), (7, 2, 1)}
    assert vectors.pruned_nearest(left, right.limit(0), 2)[0].count() == 0
    assert vectors.nearest(left, right.limit(0), 2).count() == 0


def test_sub_clusters_of_all_parents_at_once(spark):
    from jobpanel.operators import models

    rng = np.random.default_rng(9)
    rows = []
    for i in range(260):
        parent = [None, "a", "b", "b", "b"][i % 5] if i < 255 else "few"
        rows.append((i, parent, [float(x) for x in rng.normal(size=3) + 20 * (i % 2)]))
    df = spark.createDataFrame(rows, "id long, parent string, v array<double>").repartition(3)
    out = models.sub_clusters(df, "parent", 25, block_rows=40).collect()
    assert len(out) == 260 and set(out[0].asDict()) == {"id", "parent", "v", "sub_cluster", "cluster_label"}
    groups = {}
    for r in out:
        groups.setdefault(r["parent"], []).append(r)
    for parent, members in groups.items():
        k = max(1, len(members) // 25)
        assert {r["sub_cluster"] for r in members} <= set(range(k))
        x, at = np.array([r["v"] for r in members]), np.array([r["sub_cluster"] for r in members])
        centres = {c: x[at == c].mean(axis=0) for c in set(at)}
        for v, c in zip(x, at):  # a fixed point: nobody is nearer to another centre
            assert ((v - centres[c]) ** 2).sum() <= min(((v - m) ** 2).sum() for m in centres.values()) + 1e-6


def test_rounds_do_not_hand_on_the_product_of_their_sizes(spark):
    from jobpanel.session import checkpoint_round

    setting = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before, now = spark.conf.get(setting), spark.range(50).withColumn("x", F.col("id") % 5)
    for _ in range(6):  # a plain checkpoint plans the sixth join with a size of hundreds of digits
        now = checkpoint_round(now.select("id", "x").join(now.select("id", F.lit(1).alias("y")), "id").select("id", "x"))
    assert int(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10_000_000
    assert now.count() == 50 and spark.conf.get(setting) == before


def test_merge_topics_respects_size_and_order(spark):
    base = spark.createDataFrame([("w", t) for t in range(8)], "window string, topic int")
    pairs = spark.createDataFrame(
        [("w", 0, 1, .99), ("w", 1, 2, .98), ("w", 2, 3, .97), ("w", 3, 4, .96), ("w", 4, 5, .95), ("w", 6, 7, .74)],
        "window string, i int, j int, sim double")
    rows = evolution.merge_topics(base, pairs, min_topics=2).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["merged"], set()).add(r["topic"])
    # five topics fill a group, the sixth stays out; 0.74 is below the threshold
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [5], [6], [7]]


def test_alignment_events(spark):
    sims = [("a", "b", 0, 0, .9), ("a", "b", 1, 0, .85), ("a", "b", 1, 1, .2), ("a", "b", 2, 2, .6), ("a", "b", 3, 2, .65),
            ("a", "b", 2, 3, .55), ("a", "b", 1, 2, .1)]
    df = spark.createDataFrame(sims, "window_from string, window_to string, source int, target int, sim double")
    got = {(r["event_type"], tuple(r["source_topics"]), tuple(r["target_topics"])) for r in evolution.align(df).collect()}
    # topic 2 merges into 2 and, from the same list of free topics, splits as well
    assert got == {("survival", (0,), (0,)), ("merge", (3, 2), (2,)), ("split", (2,), (2, 3))}


def test_unified_ids_follow_survival_chains(spark):
    base = spark.createDataFrame([(w, t) for w in ("w1", "w2", "w3") for t in (0, 1)], "window string, topic int")
    events = spark.createDataFrame(
        [("w1", "w2", "survival", [0], [1], .9, 1), ("w2", "w3", "survival", [1], [0], .8, 1)], evolution.EVENT_SCHEMA)
    got = {(r["window"], r["topic"]): r["unified_topic_id"] for r in evolution.unified_topics(base, events).collect()}
    assert got[("w1", 0)] == got[("w2", 1)] == got[("w3", 0)]
    assert len(set(got.values())) == 4
    kinds = Counter(r["kind"] for r in evolution.flow_links(base, events).collect())
    assert kinds == {"survival": 2, "death": 2, "birth": 2}


def test_parse_events(spark):
    df = spark.createDataFrame([("[np.int64(6), np.int64(13)]", "[28]")], "source_topics string, target_topics string")
    r = evolution.parse_events(df).first()
    assert (r["source_topics"], r["target_topics"]) == ([6, 13], [28])


def test_agreement_uses_average_ranks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (3.0, 5.0), (4.0, 4.0)], "x double, y double")
    r = panel.agreement(df, "x", "y").first()
    assert r["pearson_r"] == pytest.approx(np.corrcoef([1, 1, 3, 4], [2, 1, 5, 4])[0, 1])
    assert r["spearman_r"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [2, 1, 4, 3])[0, 1])


def test_permuted_years_keep_the_years_of_a_cell(spark):
    rows = [(o, "i", y, 1.0) for o in ("a", "b") for y in range(2016, 2022)]
    df = spark.createDataFrame(rows, "occ string, ind string, year int, x double")
    got = panel.permuted_years(df, ["occ", "ind"], 20).toPandas()
    assert len(got) == 240
    for _, part in got.groupby(["draw", "occ"]):
        assert sorted(part["year_shuffled"]) == list(range(2016, 2022))
    assert (got["year"] != got["year_shuffled"]).any()


def test_period_classifier_scores_no_rows_it_has_seen(spark):
    from jobpanel.operators import models

    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), "pre" if i % 2 else "post", rng.random(6).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label int, period string, theta array<double>")
    out = {(r["train"], r["test"]): r for r in models.cross_period_accuracy(df, "label", "id", "period", "pre", "post", folds=3).collect()}
    assert set(out) == {("pre", "pre"), ("post", "post"), ("pre", "post"), ("post", "pre")}
    assert all(abs(r["top1"] - 0.5) < 0.1 for r in out.values())  # random labels: chance
    assert out[("pre", "pre")]["n"] == 400


def test_inference_in_rows_equals_the_join(spark, monkeypatch):
    from jobpanel.operators import topics

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    p = rng.dirichlet(np.ones(30), size=4).T
    model = spark.createDataFrame([(w, [float(x) for x in row]) for w, row in zip(words, p)], "term string, p array<double>")
    docs = spark.createDataFrame(
        [(i, [str(x) for x in rng.choice(words + ["none"], 40)]) for i in range(50)] + [(99, ["none"] * 9), (98, [])], "id long, tokens array<string>")
    in_rows = {r["id"]: r for r in topics.infer(docs, "id", model, [0.25] * 4, [3]).collect()}
    monkeypatch.setattr(topics, "MAX_VOCABULARY", 3)
    joined = {r["id"]: r for r in topics.infer(docs, "id", model, [0.25] * 4, [3]).collect()}
    assert set(in_rows) == set(joined) == set(range(50))
    for i, r in in_rows.items():
        assert r["theta"] == pytest.approx(joined[i]["theta"]) and r["n_known"] == joined[i]["n_known"]


def test_tiles_give_the_same_neighbours(monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (90, 4)) / 4  # many ties, sums exact in any order
    ids = rng.permutation(90)
    for k, own in ((1, False), (5, True), (200, False)):
        sims = m @ m.T
        if own:
            np.fill_diagonal(sims, -2.0)
        want = [(int(ids[i]), int(ids[j]), sims[i, j]) for i in range(90) for j in np.lexsort((ids, -sims[i]))[:k] if sims[i, j] > -1.5]
        for rows in (1, 7, 89, 2000):
            monkeypatch.setattr(vectors, "TILE_ROWS", rows)
            out = vectors._top(ids, m, ids, m, k, own)
            assert [*zip(out["id"].tolist(), out["neighbour"].tolist(), out["sim"].tolist())] == want


def test_documents_travel_to_few_blocks():
    assert tokens._blocks(180_000, 180_000 * 20, tokens.BLOCK_ROWS) == 8
    assert tokens._blocks(10, 60_000_000, tokens.BLOCK_ROWS) == 10 and tokens._blocks(0, 0, 5) == 1


def test_model_scores_few_documents_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "10000")
        model = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.9, 0.1])], "term string, p array<double>")
        df = spark.createDataFrame([(i, ["a", "b"] * 3) for i in range(2500)], "id long, tokens array<string>")
        assert topics.infer(df, "id", model, [0.5, 0.5]).count() == 2500
        assert int(spark.conf.get(setting)) <= 1000
    finally:
        spark.conf.set(setting, before)


def test_few_phrases_are_joined_in_place(spark, monkeypatch):
    rows = [(1, "a b a b c".split()), (1, ["b", "c", "a", "b"]), (None, ["a", "b"]), (4, None), (5, []), (6, ["a", None, "b"]), (7, ["x"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), (None, "b")], "a string, b string")
    near = tokens.merge_phrases(df, phrases)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    want = [(1, ["a_b", "a_b", "c"]), (1, ["b_c", "a_b"]), (None, ["a_b"]), (4, None), (5, []), (6, ["a", None, "b"]), (7, ["x"])]
    assert sorted(map(tuple, near.collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(tokens, "MAX_PHRASES", 0)
    far = tokens.merge_phrases(df, phrases)
    assert sorted(map(tuple, far.collect()), key=repr) == sorted(want, key=repr)


def test_all_phrases_join_documents_beyond_the_limit_of_the_phrase_list(spark, monkeypatch):
    from jobpanel.plans import words

    rows = [(i, "a b u c d v e f w".split()) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    defaults = tokens.phrases_by_pmi.__defaults__
    monkeypatch.setattr(tokens.phrases_by_pmi, "__defaults__", (*defaults[:-1], 1))
    assert words.phrases(df).count() == 1
    monkeypatch.setattr(words, "docs", lambda *_: df)
    every = sorted(tuple(r) for r in tokens.phrases_by_pmi(df, min_count=10, min_pmi=1.0, limit=None).select("a", "b").collect())
    assert len(every) == 8
    assert {r["n"] for r in words.merge_phrases(spark, "").collect()} == {5}


def test_likelihood_equals_that_of_mllib_and_tokens_are_not_held(spark, monkeypatch):
    from pyspark.ml.clustering import LDAModel
    from pyspark.ml.feature import CountVectorizer

    from jobpanel.operators import models

    rng = np.random.default_rng(5)
    rows = [([f"w{t}" for t in rng.integers(0, 30, rng.integers(1, 60)) + 30 * (i % 2)],) for i in range(80)] + [([],), (["rare"],)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(2).persist()
    theirs, asked, held = LDAModel.logLikelihood, [], []

    def refused(self, bows):
        asked.append(bows)
        raise AssertionError("takes the exponential of the whole table for every document")

    def bound(model, bows, own=models._log_likelihood):
        out = own(model, bows)
        held.append((out, theirs(model, bows), bows.count()))
        return out

    fit = CountVectorizer._fit

    def limits(self, docs):
        held.append((self.getMinDF(), self.getMaxDF()))
        return fit(self, docs)

    monkeypatch.setattr(LDAModel, "logLikelihood", refused)
    monkeypatch.setattr(LDAModel, "logPerplexity", refused)
    monkeypatch.setattr(models, "_log_likelihood", bound)
    monkeypatch.setattr(CountVectorizer, "_fit", limits)
    words, alpha, figures = models.fit_topics(df, 3, min_df=2, max_df=0.9)
    df.unpersist()
    assert not asked and alpha == [1 / 3] * 3 and words.count() == 60
    assert held[0] == (2.0, pytest.approx(0.9 * 82))  # as numbers: a share makes MLlib hold all tokens
    (got, n), want, rows_seen = held[1]
    assert rows_seen == 82 and n == sum(len(r[0]) for r in rows) - 1
    assert got == pytest.approx(want, rel=2e-3)
    assert figures == {"log_likelihood": got, "log_perplexity": pytest.approx(-got / n)}


def test_u_mass_reads_top_words_only_with_repeated_and_null_keys(spark):
    rows = [(1, "a b a".split()), (1, "b c".split()), (None, "a c".split()), (2, None), (3, ["x", None])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "topic int, rank int, term string")
    got = topics.u_mass(df, "id", words)
    eps = topics.fixed.INFERENCE_EPS

    def part(both, single):
        return math.log((both / 5 + eps) / (single / 5))

    # key 1 is one group of two rows: a, b and b, c are pairs of ranks 1, 2, 2, 3
    assert got.first()["u_mass"] == pytest.approx((part(2, 2) + part(2, 2) + part(2, 2)) / 3)
    assert topics.u_mass(df, "id", words.limit(0)).count() == 0


def _odd_documents(seed: int, repeated: bool) -> list[tuple]:
    rng = np.random.default_rng(seed)
    names = [f"a{i}" for i in range(12)] + [None]
    ids = [None, 1, 2, 3]
    return [(ids[rng.integers(0, 4)] if repeated and i % 2 else 10 + i,
             None if i % 9 == 0 else [names[j] for j in rng.integers(0, 13, rng.integers(0, 30))]) for i in range(60)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeated", [False, True])
def test_words_are_counted_in_rows_whatever_the_keys(spark, repeated):
    rows = _odd_documents(3, repeated)
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = Counter((i, w) for i, doc in rows for w in doc or [])
    out = tokens.document_terms(df, "id")
    assert sorted(map(str, ((r["id"], r["term"], r["n"]) for r in out.collect()))) == sorted(
        str((i, w, n)) for (i, w), n in want.items())
    if not repeated:
        assert "Exchange" not in _plan(out)
    terms = spark.createDataFrame([("a1",), ("a7",), ("zz",)], "term string")
    kept = {(r["id"], r["term"]): r["n"] for r in tokens.bag_of_words(df, "id", terms).collect()}
    assert kept == {k: n for k, n in want.items() if k[1] in ("a1", "a7")}


@pytest.mark.parametrize("repeated, chunk, cell", [(False, 4_000_000, 8_000_000), (True, 4_000_000, 8_000_000), (False, 40, 20)])
def test_products_are_summed_in_cells(spark, monkeypatch, repeated, chunk, cell):
    rows = _odd_documents(4, repeated)
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    lexicon = [(f"a{i}", ("vn", "n", "x")[i % 3]) for i in range(12)] + [("a1", "v"), ("a0", "v"), ("zz", "n"), ("a2", None)]
    bags = {}
    for i, doc in rows:
        bags.setdefault(i, Counter()).update(doc or [])
    want = Counter()
    for bag in bags.values():
        for v, p in lexicon:
            for o, q in lexicon:
                if (p or "x")[0] == "v" and (q or "x")[0] == "n" and bag[v] * bag[o]:
                    want[v, o] += bag[v] * bag[o]
    monkeypatch.setattr(tokens, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(tokens, "CELL_WORDS", cell)
    out = tokens.verb_noun_products(df, "id", spark.createDataFrame(lexicon, "word string, pos string"))
    assert "keys=[verb" not in _plan(out) and "Aggregate" not in _plan(out)  # no product is shuffled
    got = out.collect()
    assert {(r["verb"], r["noun"]): r["n"] for r in got} == want and len(got) == len(want)
    keys, values = np.array([5, 2, 5, 2 ** 61]), np.array([3, 1, 4, 2 ** 20])
    assert [x.tolist() for x in tokens._summed(keys, values)] == [[2, 5, 2 ** 61], [1, 7, 2 ** 20]]
    assert [x.tolist() for x in tokens._summed(keys[:3], values[:3])] == [[2, 5], [1, 7]]


def test_blocks_of_products_meet_without_a_shuffle_of_their_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [f"{'vn'[int(t) % 2]}{t}" for t in rng.integers(0, 60, 40)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    lexicon = spark.createDataFrame([(f"{'vn'[t % 2]}{t}", "vn"[t % 2]) for t in range(60)], "word string, pos string")
    monkeypatch.setattr(tokens, "CELL_WORDS", 150)
    out = tokens.verb_noun_products(df, "id", lexicon)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "word" not in plan.split("CartesianProduct")[1].replace("words", "")
    want = Counter()
    for _, d in rows:
        n = Counter(d)
        want.update({(a, b): n[a] * n[b] for a in n for b in n if a[0] == "v" and b[0] == "n"})
    got = [((r["verb"], r["noun"]), r["n"]) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("step", [1, 16, 1000])
def test_products_of_a_cell_in_small_steps(monkeypatch, step):
    import pyarrow as pa

    rng = np.random.default_rng(step)
    rows, want = [], Counter()
    for chunk in (5, 1 << 33):
        bags = {True: {}, False: {}}
        for word in range(9):
            docs = np.flatnonzero(rng.random(12) < (0.9 if word < 2 else 0.3))
            times = rng.integers(1, 4, len(docs)) if word % 2 else np.ones(len(docs), int)
            rows.append({"verb": word < 5, "word": f"w{word}", "chunk": chunk, "docs": docs.tolist(), "times": times.tolist() if word % 2 else []})
            bags[word < 5][word] = dict(zip(docs, times))
        for v, a in bags[True].items():
            for o, b in bags[False].items():
                for doc in a.keys() & b.keys():
                    want[f"w{v}", f"w{o}"] += int(a[doc] * b[doc])
    kinds = pa.schema([("verb", pa.bool_()), ("word", pa.string()), ("chunk", pa.int64()), ("docs", pa.list_(pa.int16())), ("times", pa.list_(pa.int32()))])
    monkeypatch.setattr(tokens, "_PRODUCTS", step)
    got = [r for b in tokens._products(pa.Table.from_pylist(rows, kinds)) for r in b.to_pylist()]
    assert {(r["verb"], r["noun"]): r["n"] for r in got} == want and len(got) == len(want)
    only = pa.Table.from_pylist([r for r in rows if r["verb"]], kinds)
    assert not [r for b in tokens._products(only) for r in b.to_pylist()]
