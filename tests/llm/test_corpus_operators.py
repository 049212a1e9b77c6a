"""Dedup, join, shards, mixing, classifier and language model against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobpanel.llm import components, exact_dedup, jaccard_join, lm, mixing, quality, queries, sharding

DOCS = "doc_id bigint, text string"
FULL = "doc_id bigint, text string, lang string, source string"


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") for _ in range(n))


# --- exact duplicates ------------------------------------------------------------

def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("capacity", [exact_dedup.CAPACITY, 3])
def test_exact_duplicates(spark, monkeypatch, capacity):
    build = exact_dedup.build_directory
    monkeypatch.setattr(exact_dedup, "build_directory", lambda keys: build(keys, capacity))
    rng = random.Random(3)
    texts = [None, "", "a", "A", "a ", "é", "x" * 200_000, *(f"t{k}" for k in range(150))]
    rows = [(k, rng.choice(texts)) for k in range(400)] + [(None, "a"), (None, "only null"), (None, "only null")]
    rows += [(5, rows[5][1])] * 2 + [(1000 + k, "hot") for k in range(200)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", keep_id int, kept int")
    out = exact_dedup.exact_duplicates(df)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == exact(rows)


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("_key"))
    directory = exact_dedup.build_directory(keys, 40)
    unsigned = np.array([r[0] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    sizes = np.bincount(np.searchsorted(directory, unsigned, side="right") - 1)
    assert directory[0] == 0 and sizes.max() <= 40 and len(sizes) <= len(directory) < 400


def test_owner_compares_bytes_under_one_key():
    schema = pa.schema([
        ("bucket", pa.int32()), ("key", pa.int64()), ("slot", pa.int32()), ("sha", pa.binary()), ("keep_id", pa.int64()),
        ("group_size", pa.int64())])
    batch = pa.table({
        "_bucket": [0] * 4, "_key": [7] * 4, "_text": ["x", "y", "x", "y"], "_sha": [b"1", b"2", b"1", b"2"],
        "_top": [1, 2, 5, None], "_n": [1, 1, 3, 1]}).to_batches()
    out = pa.Table.from_batches(list(exact_dedup._owner(schema)(iter(batch)))).to_pylist()
    assert [(r["slot"], r["keep_id"], r["group_size"]) for r in out] == [(0, 5, 4), (1, 2, 2)]


def test_exact_duplicates_empty(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# --- similarity join -------------------------------------------------------------

def near_copies(rng, n_groups, size, length):
    rows = []
    for _ in range(n_groups):
        base = prose(rng, length).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, length // 40))):
                own[rng.randrange(length)] = "edit" + str(rng.randint(0, 99))
            rows.append(" ".join(own))
    return rows


def joined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", class_id int")
    return {r.doc_id: tuple(r)[1:] for r in jaccard_join.similar_texts(df, **options).collect()}


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [None, "", "?!", "one", "One!", "two words", "a b c d e", "A b C d, e", *near_copies(rng, 25, 8, 120)]
    texts += [passage + " " + prose(rng, rng.randint(1, 300)) for _ in range(90)] + texts[8:20]
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute.similar(rows)


def test_join_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 50)
    rng = random.Random(6)
    rows = list(enumerate(near_copies(rng, 1, 260, 80) + [prose(rng, 80) for _ in range(60)]))
    out = joined(spark, rows)
    assert out == brute.similar(rows) and max(v[2] for v in out.values()) > 50


def test_join_of_groups_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 60)
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, 16, 2, 120) + near_copies(rng, 16, 3, 120)))
    assert joined(spark, rows) == brute.similar(rows)


def test_join_without_words_or_rows(spark):
    assert joined(spark, [(1, None), (2, ""), (3, "!")]) == {k: (k, k, 0, 1) for k in (1, 2, 3)}
    assert joined(spark, []) == {}


def test_keep_one_keeps_one_of_each_class(spark):
    rng = random.Random(7)
    texts = near_copies(rng, 6, 5, 100) + [None, "", "solo text here"]
    rows = [(k, t) for k, t in enumerate(texts)]
    classes = brute.similar(rows)
    rows += [rows[0], rows[0], (3, texts[3])]  # repeated rows
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted(i for i, c in classes.items() if c[0] == i)


def test_root_paths_reach_the_recall():
    assert jaccard_join.root_paths(0.8, 1 - 1e-7) == 12
    assert jaccard_join.root_paths(0.8, 0.9) < jaccard_join.root_paths(0.8, 0.999)


def test_paths_and_cut_together_reach_the_recall(spark):
    least = jaccard_join.least_equal(0.8, 1 - 1e-7, 12, 40)
    cut = sum(math.comb(40, k) * 0.8 ** k * 0.2 ** (40 - k) for k in range(least))
    paths = jaccard_join._root_misses(0.8) ** 12
    assert cut + paths <= 1e-7 < cut + paths + math.comb(40, least) * 0.8 ** least * 0.2 ** (40 - least)
    rows = [(bytes([k]), 100, list(range(17)) + [1000 + 100 * k + i for i in range(23)]) for k in (1, 2)]
    classes = spark.createDataFrame(rows, "cid binary, n int, mh array<int>")
    assert jaccard_join.candidate_edges(classes, 0.8, 12, 40).count()  # 17 of 40 samples are equal


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in out} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- language model --------------------------------------------------------------

@pytest.mark.parametrize("block", [lm.BLOCK_BYTES, 3_000])
def test_scores_equal_plain_counting(spark, block):
    rng = random.Random(9)
    texts = [None, "", "...", "lone", "Lone", *(prose(rng, rng.randint(1, 90)) for _ in range(60)), "w " * 20_000]
    rows = list(enumerate(texts))
    wanted = brute.lm_scores(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", log_score int")
    out = lm.score(df, block_bytes=block).collect()
    assert len(out) == len(rows)
    for r in out:
        n, s, backed = wanted[r.doc_id]
        assert (r.n_tokens, r.n_backed_off) == (n, backed) and math.isclose(r.log_score, s, rel_tol=1e-9, abs_tol=1e-9)
        assert (r.mean_log_score is None) == (n == 0)


def test_scores_repeated_rows_and_empty_table(spark):
    out = lm.score(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z")], DOCS)).collect()
    twice = [r for r in out if r.doc_id == 1]
    assert len(twice) == 2 and twice[0].n_backed_off == 0
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0


def scores_by_strings(rows, order, backoff=0.4):
    """`brute.lm_scores` for any order: a word's longest n-gram that the other rows have."""
    texts = [(i, brute.words(t)) for i, t in rows]
    grams = lambda w: Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    every = Counter()
    for _, w in texts:
        every.update(grams(w))
    whole, out = sum(len(w) for _, w in texts), {}
    for i, w in texts:
        others = every.copy()
        others.subtract(grams(w))
        total = backed = 0
        for k, x in enumerate(w):
            for n in range(min(order, k + 1), 0, -1):
                long, context = others[tuple(w[k - n + 1:k + 1])], others[tuple(w[k - n + 1:k])]
                if n > 1 and long > 0:
                    total += math.log(long / context)
                    break
                if n > 1:
                    total += math.log(backoff)
                else:
                    total += math.log((long if long > 0 else 0.5) / max(whole - len(w), 1))
            backed += n < min(order, k + 1)
        out[i] = (len(w), total, backed)
    return out


def test_query_scores_by_trigrams(spark, tmp_path):
    rng = random.Random(12)
    lines = ["the cat sat on the mat", "the dog sat on the cat", "the mat sat on the dog"]
    rows = list(enumerate([*lines * 3, *(prose(rng, 40) for _ in range(30)), "", "lone"]))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = scores_by_strings(rows, 3)
    out = queries.op9_lm_scoring(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        n, s, backed = wanted[r.doc_id]
        assert (r.n_tokens, r.n_backed_off) == (n, backed) and math.isclose(r.log_score, s, rel_tol=1e-9, abs_tol=1e-9)


def test_coded_hashes_survive():
    values = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=lm.U64))
    for v in (values, values[:1], values[:0], np.array([0, (1 << 64) - 1], lm.U64)):
        assert lm._decoded(lm._coded(v)).tolist() == v.tolist()


def test_counts_above_a_byte_survive():
    values = np.array([1, 254, 255, 256, 10**12])
    assert lm._unpacked(lm._packed(values), 5).tolist() == values.tolist()


def test_links_of_rows_with_null_or_one_id(spark):
    """Sets are found again by id and spelling, so ids that are null or repeat join nothing else."""
    rng = random.Random(31)
    bases = [prose(rng, 60) for _ in range(30)]
    texts = [t for b in bases for t in (b, b + " tail", b.upper())]
    for i in (None, 5):
        out = jaccard_join.similar_texts(spark.createDataFrame([(i, t) for t in texts], DOCS)).collect()
        assert len(out) == len(texts)
        assert {(r.class_id, r.copy_id, r.n_links) for r in out} == {(i, i, 1)}
        assert sorted(r.n_copies for r in out) == [1] * 30 + [2] * 60


# --- shards ----------------------------------------------------------------------

def check_shards(rows, out, n):
    assert len(out) == len(rows)
    by_text, slots, load, largest = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in out:
        size = len((r.text or "").encode()) + 16
        assert (r.size, r.text_crc32, r.law) == (size, zlib.crc32((r.text or "").encode()), "bytes")
        assert 0 <= r.shard < n and r.grown_shard is None
        by_text[r.text or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += size
        largest[r.text or ""] += size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, max(largest.values())


def test_shards_are_nearly_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 40)
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.randint(1, 60))) for k in range(4000)]
    rows += [(5000 + k, "copy of a very frequent text") for k in range(1500)] + [(k, None) for k in range(7000, 7010)]
    rows += [(9000, ""), (9001, prose(rng, 9000)), (None, "null id"), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x", -1) for r in rows], DOCS + ", shard string, slot int")
    out = sharding.shard(df, 10).collect()
    load, _ = check_shards(rows, out, 10)
    total = sum(load.values())
    assert max(load.values()) <= 1.03 * total / 10 and min(load.values()) >= 0.97 * total / 10


def test_shards_with_one_group_above_a_share(spark):
    rows = [(k, "hot text that fills a third") for k in range(500)] + [(1000 + k, f"text number {k:04d} of many") for k in range(1000)]
    load, hot = check_shards(rows, sharding.shard(spark.createDataFrame(rows, DOCS), 8).collect(), 8)
    rest = (sum(load.values()) - hot) / 7
    assert sorted(load.values())[-1] == hot and all(abs(x - rest) <= 0.03 * rest for x in sorted(load.values())[:-1])


def test_shards_of_few_or_no_rows(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    check_shards(rows, sharding.shard(spark.createDataFrame(rows, DOCS), 40).collect(), 40)
    assert sharding.shard(spark.createDataFrame([], DOCS), 40).count() == 0


def test_columns_that_clash_by_case_keep_their_values(spark, tmp_path):
    rows = [(k, f"text {k}", 100 + k, f"s{k}", f"l{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "DOC_ID bigint, Text_CRC32 string, `Size` int, slot string, `_Size` string")
    out = sharding.shard(df, 4, id_col="DOC_ID", text_col="Text_CRC32")
    out.write.parquet(f"{tmp_path}/out")
    assert out.columns == ["DOC_ID", "_Text_CRC32", "__Size", "_Size", *sharding.ADDED]
    for r in out.collect():
        k = r.DOC_ID
        assert (r["_Text_CRC32"], r["__Size"], r["_Size"]) == (f"text {k}", 100 + k, f"l{k}")
        assert (r["size"], r.text_crc32) == (len(f"text {k}") + 16, zlib.crc32(f"text {k}".encode()))


def test_null_and_repeated_ids_are_sliced_by_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 10)
    rows = [(None, f"null id {k}") for k in range(600)] + [(7, f"one id {k}") for k in range(300)] + [(None, None)] * 20
    out = sharding.shard(spark.createDataFrame(rows, DOCS), 4)
    check_shards(rows, out.collect(), 4)
    slices = math.ceil(len(rows) / 4 / 10)
    places = {hash_ % slices for hash_, in spark.createDataFrame(rows, DOCS).filter("doc_id IS NULL AND text IS NOT NULL").select(
        F.xxhash64("doc_id", "text")).collect()}
    assert len(places) > slices / 2
    same = [r.slot for r in out.filter("text IS NULL").collect()]
    assert max(same) - min(same) == 19


@pytest.mark.parametrize("slack", [0, 37])
def test_splitters_against_sorted_sums(spark, slack):
    rng = random.Random(21)
    keys = [rng.choice([rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-9, 9)]) for _ in range(400)]
    rows = [(k, rng.choice([16, 17, 40, 900])) for k in keys + keys[:60]]
    total = sum(s for _, s in rows)
    targets = [round(total * j / 7) for j in range(1, 7)]
    found = sharding.find_splitters(spark.createDataFrame(rows, "_key bigint, _size bigint"), targets, slack)
    options = [sum(s for k, s in rows if k < cut) for cut in sorted(set(keys))] + [total]
    assert found == sorted(found)
    for target, cut in zip(targets, found):
        miss = abs(sum(s for k, s in rows if k < cut) - target)
        assert miss <= max(slack, min(abs(o - target) for o in options))


# --- mixing ----------------------------------------------------------------------

def mixable(rng, n):
    return [
        (k, prose(rng, rng.randint(1, 30)) + rng.choice(["", "", " | x", " $$$"]), rng.choice(["en", "en", "de", None]),
         rng.choice(["big", "big", "big", "small", None])) for k in range(n)]


def test_marginals_meet_their_targets(spark):
    rows = mixable(random.Random(11), 3000)
    df = spark.createDataFrame(rows, FULL)
    out = mixing.mix(df, share=0.2).collect()
    whole = sum(r.tokens for r in out)
    for dim in ("source", "lang", "topic"):
        natural, raked = Counter(), Counter()
        for r in out:
            natural[getattr(r, dim)] += r.tokens
            raked[getattr(r, dim)] += r.tokens * r.factor
        roots = {k: math.sqrt(v) for k, v in natural.items()}
        for k in natural:
            assert math.isclose(raked[k] / whole, roots[k] / sum(roots.values()), rel_tol=1e-6)
    assert math.isclose(sum(r.tokens * r.probability for r in out), 0.2 * whole, rel_tol=1e-9)
    drawn = sum(r.tokens for r in out if r.sampled)
    assert abs(drawn - 0.2 * whole) < 0.05 * whole


def test_probabilities_stop_at_one(spark):
    rows = mixable(random.Random(12), 2000)
    out = mixing.mix(spark.createDataFrame(rows, FULL), share=0.9).collect()
    whole = sum(r.tokens for r in out)
    assert max(r.probability for r in out) == 1 and min(r.probability for r in out) < 0.9
    assert math.isclose(sum(r.tokens * r.probability for r in out), 0.9 * whole, rel_tol=1e-9)


def test_contradicting_targets_show_their_miss(spark):
    """Source a alone holds languages x and y, b alone z: tempered shares cannot all be met."""
    rows = [(k, "w " * 10, "xyz"[k % 3], "aab"[k % 3]) for k in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, FULL)).collect()
    share = Counter()
    for r in out:
        share[r.source] += r.tokens * r.factor / 3000
    wanted = math.sqrt(2) / (math.sqrt(2) + 1)
    assert {r.missed for r in out} == {out[0].missed} and out[0].missed > 0.05
    assert math.isclose(out[0].missed, abs(share["a"] - wanted), rel_tol=1e-6)
    met = mixing.mix(spark.createDataFrame(mixable(random.Random(13), 500), FULL)).collect()
    assert max(r.missed for r in met) <= mixing.CLOSE


def test_topics_by_column_and_rules_and_given_targets(spark):
    rows = [(k, ("cat dog" if k % 4 else "sky") + " w" * (k % 7), "en" if k % 3 else "de", "s") for k in range(400)]
    df = spark.createDataFrame(rows, FULL)
    by_rule = mixing.mix(df, topic_rules=[("sky", "^sky"), ("pets", "cat|dog")]).collect()
    assert {r.doc_id: r.topic for r in by_rule} == {k: "pets" if k % 4 else "sky" for k in range(400)}
    by_column = mixing.mix(df.withColumn("subject", F.when(F.col("doc_id") % 4 == 0, "sky")), topic="subject").collect()
    assert {(r.doc_id % 4 == 0, r.topic) for r in by_column} == {(True, "sky"), (False, None)}
    wanted = spark.createDataFrame([("en", 0.25), ("de", 0.75)], "level string, target double")
    out = mixing.mix(df, share=0.1, targets={"lang": wanted}).collect()
    whole = sum(r.tokens for r in out)
    assert math.isclose(sum(r.tokens * r.factor for r in out if r.lang == "de") / whole, 0.75, rel_tol=1e-9)
    with pytest.raises(ValueError):
        mixing.mix(df, targets={"place": wanted})


def test_mixing_odd_tables(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "word", "en", "b")]
    df = spark.createDataFrame([(*r, "t", 0.5) for r in rows], FULL + ", topic string, factor double")
    out = mixing.mix(df).collect()
    assert len(out) == 4 and all(r.probability is not None and r.sampled is not None for r in out)
    assert mixing.mix(spark.createDataFrame([], FULL)).count() == 0
    wordless = mixing.mix(spark.createDataFrame([(1, "", "en", "a")], FULL)).collect()
    assert [(r.tokens, r.factor) for r in wordless] == [(0, 1.0)]


# --- quality classifier ------------------------------------------------------------

def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        words = prose(rng, rng.randint(3, 80)).split()
        rows.append((k, " ".join(words) + "." if good else " | ".join(words)))
        labels.append((k, int(good)))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(13), 1500)
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", score int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = quality.with_scores(docs, marks).collect()
    truth = dict(labels)
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) > 0.97 * len(held)
    assert {r.doc_id for r in docs.filter(quality.held_out(F.col("doc_id"))).collect()} == {r.doc_id for r in held}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(random.Random(14), 400)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (
        {r.doc_id: r.score for r in quality.with_scores(docs, spark.createDataFrame(x, "doc_id bigint, quality int")).collect()}
        for x in (labels, turned))
    assert a == b


def test_classifier_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None), (1, None), (2, ""), (None, "word"), (3, "long text " * 30_000), (4, "\n\n| |")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.with_scores(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (3, 7), (4, 0)], "doc_id bigint, quality int")
    out = quality.with_scores(docs, odd).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert quality.with_scores(docs.limit(0), odd).count() == 0


def test_interactions_are_learned():
    rng = np.random.default_rng(15)
    x = np.zeros((4000, len(quality.FEATURES)), np.float32)
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature helps alone
    model = quality.fit(x[:3000], y[:3000])
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_features_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(16)
    texts = pa.array([None, "", "A b.\nA b.\n", *(prose(rng, 50) + "\n" + prose(rng, 9) for _ in range(20))])
    whole = quality.features(texts)
    one_by_one = np.concatenate([quality.features(texts.slice(k, 1)) for k in range(len(texts))])
    assert np.allclose(whole, one_by_one) and not np.isnan(whole).any()
