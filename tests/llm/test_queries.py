"""Registered queries and the pipeline on the small tables."""

from __future__ import annotations

import math
import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

from jobpanel.llm.queries import CHECKS, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def cells(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "-"
        return str(int(x)) if isinstance(x, bool) else repr(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    wanted = con.execute(CHECKS[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert cells(df.select(*names).collect()) == cells(wanted.fetchall())


def test_there_is_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    import brute

    import corpus_pipeline as pipeline
    from jobpanel.llm import decontam, mixing, quality
    from jobpanel.session import checkpoint

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        scored = (
            {r.doc_id for r in quality.with_scores(docs, labels).filter("score >= 0.5").collect()} if k == 0 else None)
        drawn = {r.doc_id for r in mixing.mix(docs).filter("sampled").collect()} if k == 3 else None
        hit = {r.doc_id for r in decontam.mark(docs, bench).filter("contaminated").collect()} if k == 2 else None
        columns = docs.columns
        docs = checkpoint(stage(spark, docs, FOLDER))
        rows = docs.collect()
        before, now = kept[-1], {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows) and now.items() <= before.items()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert set(now) == scored
        elif k == 1:
            assert set(now) == {i for i, c in brute.similar(before.items()).items() if c[0] == i}
        elif k == 2:
            assert set(now) == set(before) - hit
        elif k == 3:
            assert set(now) == drawn
        else:
            assert set(now) == set(before) and {"shard", "slot"} <= set(docs.columns)
        kept.append(now)
    whole = {r.doc_id for r in pipeline.run(spark, FOLDER).collect()}
    assert whole == set(kept[-1])


def test_stages_keep_odd_rows_and_columns_whole(spark):
    import corpus_pipeline as pipeline

    names = ("score", "n_words", "hit_spans", "contaminated", "tokens", "topic", "sampled", "factor", "_marks", "_id", "_key", "_slice", "row", "id")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    texts = [None, "", "  ", "?!", "one", "One two.", "A plain sentence of some words. " * 40, "A plain sentence of some words. " * 40, "é" * 5000]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 else "s", None, *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)]
    rows += [(None, "a null id", None, None, None, *names), (6, texts[6], "en", None, None, *(f"{n}6" for n in names))]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, FOLDER)
            got = out.select(*[f"`{c}`" for c in docs.columns]).collect()
            if k < 4:
                assert out.columns == docs.columns
            own = set(map(tuple, frame.collect()))
            assert all(tuple(r) in own for r in got)
            if k in (2, 4):  # nothing here is contaminated
                assert len(got) == frame.count()
