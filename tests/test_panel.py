"""Cell statistics against numpy, null keys and null values included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobpanel.operators import panel, ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(600):
        key = [None, "a", "b", "c"][rng.integers(0, 4)]
        year = [None, 2016, 2017][rng.integers(0, 3)]
        x = None if i % 11 == 0 else float(np.round(rng.normal(), 2))
        out.append((key, year, x, float(rng.integers(1, 9))))
    out.append(("only nulls", 2016, None, 1.0))
    return spark.createDataFrame(out, "key string, year int, x double, w double"), out


def _cells(data, at):
    cells = {}
    for r in data:
        cells.setdefault(at(r), []).append(r)
    return cells


def test_quartiles_count_null_keys(rows):
    df, data = rows
    got = {(r["key"], r["year"]): r for r in panel.quartile_summary(df, ["key", "year"], "x").collect()}
    want = _cells(data, lambda r: (r[0], r[1]))
    assert set(got) == set(want) and (None, None) in got
    for cell, part in want.items():
        x = [r[2] for r in part if r[2] is not None]
        assert got[cell]["n"] == len(part)
        if not x:
            assert got[cell]["mean"] is None and got[cell]["q50"] is None
            continue
        assert [got[cell][c] for c in ("mean", "q25", "q50", "q75")] == pytest.approx([np.mean(x), *np.quantile(x, [.25, .5, .75])])


def test_cell_panel_counts_null_keys(rows):
    df, data = rows
    got = {(r["key"], r["year"]): r for r in panel.cell_panel(df, ["key", "year"], ["x"], 2).collect()}
    want = {c: p for c, p in _cells(data, lambda r: (r[0], r[1])).items() if len(p) >= 2}
    assert set(got) == set(want)
    for cell, part in want.items():
        x = [r[2] for r in part if r[2] is not None]
        assert got[cell]["n_jobs"] == len(part)
        assert [got[cell][c] for c in ("mean_x", "median_x", "sd_x")] == pytest.approx([np.mean(x), np.median(x), np.std(x)])


def test_weighted_stats_count_the_null_key(rows):
    df, data = rows
    got = {r["key"]: r for r in panel.weighted_stats(df.filter("x is not null"), "key", "x", "w").collect()}
    want = _cells([r for r in data if r[2] is not None], lambda r: r[0])
    assert set(got) == set(want) == {None, "a", "b", "c"}
    for key, part in want.items():
        x, w = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        m = (x * w).sum() / w.sum()
        assert (got[key]["wmean"], got[key]["wsd"], got[key]["median"], got[key]["n"]) == pytest.approx(
            (m, np.sqrt((w * (x - m) ** 2).sum() / w.sum()), np.median(x), len(x)))


def test_join_on_matches_null_with_null(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert {tuple(r) for r in ranks.join_on(a, b, ["k"], "left").collect()} == {(None, 1, 10), ("x", 2, 20), ("y", 3, None)}
    first = ranks.with_first(a.union(a), ["k"], "a").select("k", F.col("first"))
    assert {tuple(r) for r in first.collect()} == {(None, 1), ("x", 2), ("y", 3)}
