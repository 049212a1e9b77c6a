"""Fill-in-middle forms, packing and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobpanel.llm import centroids, infill, packing

DOCS = "doc_id bigint, text string"


# --- fill in the middle -----------------------------------------------------------

def plain_form(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng):
    scripts = ["abc ", "äöü", "中文字", "🤦🏼‍♂️", "é", "\x00", "\n", "<", "P>", "<S", ">", " "]
    texts = [None, "", "a", "é", "😀", "<P>", "x <M> y", "<<P", "a" * 50_000, "é" * 30_000, "a😀" * 20_000]
    texts += ["".join(rng.choice(scripts) * rng.choice((1, 1, 2, 700)) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return texts


def test_fill_in_middle(spark):
    rng = random.Random(4)
    rows = list(enumerate(odd_texts(rng))) + [(None, "no id, some words"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*r, "kept", "kept") for r in rows], DOCS + ", Form string, output string")
    out = infill.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "Form", "output", "n", "_form", "prefix_chars", "middle_chars", "_output"]
    back = out.withColumn("back", infill.restored(F.col("_output"), F.col("_form")))
    got = Counter((r["doc_id"], r["n"], r["_form"], r["prefix_chars"], r["middle_chars"], r["_output"]) for r in back.collect())
    assert got == Counter((i, *plain_form(i, t)) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") and r["Form"] == r["output"] == "kept" for r in back.collect())
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("error", [0, 1, 7, 1000])
def test_rank_index_is_exact_and_within_its_error(error):
    rng = np.random.default_rng(error)
    steps = np.concatenate([rng.integers(1, 5, 9000), np.ones(9000, int), np.full(9000, 3), rng.integers(1, 3, 9000)])
    for offsets in (np.append(0, np.cumsum(steps)), np.array([0]), np.array([0, 4]), np.arange(20_000) * 2):
        index = infill.fit(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offset(ranks) == offsets).all()
        assert np.abs(offsets - index.predict(ranks)).max() <= error + 1
        pick = rng.integers(0, len(offsets), 50)
        assert (index.offset(pick) == offsets[pick]).all()
    assert len(infill.fit(np.arange(20_000) * 2, error).first) == 1


# --- packing ----------------------------------------------------------------------

def best_fit(sizes, limits):
    """Sequences, as lists of lengths, of vector best-fit one piece at a time."""
    capacity, weight = limits.capacity.astype(float), np.array(limits.weights)
    left, bins = [], []
    for length in sorted((n for n, c in sizes.items() for _ in range(c)), reverse=True):
        need = np.array([length, 1, length * length])
        best = None
        for b, rest in enumerate(left):
            if (rest >= need).all():
                if limits.rule == "dot":
                    score = -((rest / capacity) @ (weight * need / capacity))
                else:
                    score = (((rest - need) / capacity) ** 2) @ weight
                score = round(float(score), packing.ROUNDING)
                if best is None or score < best[0]:
                    best = (score, b)
        if best is None:
            left.append(limits.capacity - need)
            bins.append([length])
        else:
            left[best[1]] = left[best[1]] - need
            bins[best[1]].append(length)
    return bins


LIMITS = [
    packing.Limits(), packing.Limits(rule="dot"), packing.Limits(64, 5, 64 * 20), packing.Limits(64, 5, 64 * 20, rule="dot"),
    packing.Limits(100, 3, 10_000, (1.0, 1.0, 1.0)), packing.Limits(100, 100, 900, (0.2, 0.1, 1.0)), packing.Limits(1, 1, 1)]


@pytest.mark.parametrize("limits", LIMITS)
def test_plan_is_best_fit_one_piece_at_a_time(limits):
    rng = random.Random(5)
    for _ in range(12):
        top = limits.longest
        sizes = Counter(min(top, 1 + int(rng.expovariate(3 / top))) for _ in range(rng.randint(0, 300)))
        found = packing.plan(sizes, limits)
        bins = defaultdict(list)
        for length, n in sizes.items():
            for s, o in zip(*found.places(np.full(n, length), np.arange(n))):
                bins[int(s)].append((int(o), length))
        assert sorted(bins) == list(range(found.sequences))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            need = [sum(n for _, n in parts), len(parts), sum(n * n for _, n in parts)]
            assert (np.array(need) <= limits.capacity).all()
        want = best_fit(sizes, limits)
        assert Counter(tuple(sorted(n for _, n in p)) for p in bins.values()) == Counter(tuple(sorted(b)) for b in want)


def test_plan_of_many_pieces_stays_small():
    sizes = {n: 10**9 + n for n in range(1, 1025)}
    found = packing.plan(sizes)
    assert len(found.first) < 20_000
    assert found.sequences <= sum(n * c for n, c in sizes.items()) / 1024 * 1.001


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(50, 6, 1200), packing.Limits(50, 6, 1200, rule="dot")])
def test_pack_covers_every_token_once(spark, limits):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    rows = list(enumerate(odd_texts(rng)))[:90] + [(200, "<|endoftext|> a <|endoftext|>"), (201, " " * 400_000), (None, "no id"), (300, "same"), (300, "same")]
    rows = [(i, t if limits.tokens == 1024 else t and t[:300]) for i, t in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", length string").repartition(5)
    out = packing.pack(df, limits=limits)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    pieces = out.collect()
    sequences = defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert (np.array([sum(n for _, n in parts), len(parts), sum(n * n for _, n in parts)]) <= limits.capacity).all()
    assert len(sequences) == len(best_fit(Counter(r["length"] for r in pieces), limits))
    got = defaultdict(list)
    for r in pieces:
        got[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
    for i, t in set(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        copies = rows.count((i, t))
        own = sorted(got[i])
        assert b"".join(p for _, _, p in own[::copies]) == ids.tobytes()
        n = -(-len(ids) // limits.longest)
        assert [p for p, _, _ in own] == [k for k in range(n) for _ in range(copies)]
        assert all(len(p) == 4 * limits.longest for k, _, p in own if k)
        assert [s for _, s, _ in own[::copies]] == [0] * bool(n) + [len(ids) - (n - k) * limits.longest for k in range(1, n)]
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["other"])
def test_limits_that_take_nothing_raise(rule):
    with pytest.raises(ValueError):
        packing.Limits(rule=rule).longest
    with pytest.raises(ValueError):
        packing.Limits(documents=0).longest


def test_other_vocabularies_go_through_their_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "Some WORDS, ein paar Wörter; 中文 <|endoftext|> 123"
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        assert packing.encoder(name)(text).tolist() == library.encode(text, add_special_tokens=False).ids


# --- centroids --------------------------------------------------------------------

def plain_clusters(rows, k, rounds, dims, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(x))) for x in v]))
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centre = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, vs in groups.items():
            centre[j] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d

    def bounded(x):
        return x if x < 2**63 else None

    return Counter((i, j, d, bounded(inertia[j]), bounded(sum(inertia.values())), tuple(centre[j])) for i, d, j in found)


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_centroid_clusters(spark, spread):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * spread + rng.integers(0, 3) * spread]) for i in range(400)]
    rows += [(i, list(rows[3][1])) for i in range(1000, 1400)]  # many copies
    rows += [(3, rows[3][1]), (None, [0.5] * 6), (None, [0.25] * 6), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7),
             (504, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (505, [float("nan")] * 6), (506, [float("inf")] * 6), (507, [-0.0, -1e-9, 1e-9, 0.0, 1.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, distance string").repartition(3)
    out = centroids.cluster(df, k=7, dims=6)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    got = Counter((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in out.collect())
    assert got == plain_clusters(rows, 7, 3, 6, 64)
    few = df.filter("vec_id < 4")
    assert Counter((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in centroids.cluster(few, k=7, dims=6).collect()) == plain_clusters(
        [r for r in rows if r[0] is not None and r[0] < 4], 7, 3, 6, 64)
    assert centroids.cluster(df.limit(0), dims=6).count() == 0


def test_components_without_exact_distances_raise(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df, dims=2).collect()
