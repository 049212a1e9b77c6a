"""Sources, sinks, streams, entry point and a sample of the checked queries."""

import importlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from jobpanel.operators import cleaning
from jobpanel.plans import CHECKS, QUERIES
from jobpanel.sources import readers, sinks
from jobpanel.streaming import incremental

FOLDER = "/root/testdata/sf0.001"


def test_csv_with_mark_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "window_2016_2017.csv").write_bytes(
        "﻿企业名称,职位描述\n甲,\"第一行\n第二\"\"行\"\n".encode())
    (tmp_path / "window_2018_2019.csv").write_bytes("企业名称,职位描述\n乙,文\n".encode())
    (tmp_path / "other.csv").write_bytes("企业名称,职位描述\n丙,文\n".encode())
    df = readers.rename_postings(readers.read_windows(spark, str(tmp_path)))
    rows = sorted((r["company"], r["description"], r["window"]) for r in df.collect())
    assert rows == [("乙", "文", "window_2018_2019"), ("甲", '第一行\n第二"行', "window_2016_2017")]
    assert readers.read_windows(spark, str(tmp_path), ["window_2018_2019"]).count() == 1


def test_token_lines(spark, tmp_path):
    lines = [json.dumps({"id": 1, "year": "2016", "tokens": list("abcde")}), "{broken", json.dumps({"id": 2, "tokens": ["a"]})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert [r["id"] for r in readers.read_tokens(spark, str(tmp_path)).collect()] == [1]


def test_union_sources(spark):
    a = spark.createDataFrame([("甲", "智联", "600")], "`企业名称` string, `数据平台` string, `关联股票代码` string")
    b = spark.createDataFrame([("乙", "拉勾")], "`企业名称` string, `来源平台` string")
    got = readers.union_sources({"上市公司": a, "综合": b})
    assert sorted(got.columns) == ["company", "data_source", "platform"]
    assert {tuple(r) for r in got.select("company", "platform", "data_source").collect()} == {
        ("甲", "智联", "上市公司"), ("乙", "拉勾", "综合")}


def test_write_record(spark, tmp_path):
    df = spark.range(100)
    got = sinks.write_with_record(df, str(tmp_path / "x"), {"even": F.col("id") % 2 == 0})
    assert got == {"rows_out": 100, "even": 50}


def test_dynamic_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), path, ["k"])
    sinks.write_partitioned(spark.createDataFrame([(3, "b")], "x int, k string"), path, ["k"])
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_partial_batches_equal_the_batch_result(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for part in range(3):
        rows.filter(F.col("v") % 3 == part).write.mode("append").parquet(path)
        stream = incremental.arriving(spark, path, rows.schema)
        incremental.append_partials(stream, ["k"], ["v"], out, state).awaitTermination()
    got = {r["k"]: (r["n"], r["mean_v"]) for r in incremental.combine(spark.read.parquet(out), ["k"], ["v"]).collect()}
    want = {r["k"]: (r["n"], r["m"]) for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("m")).collect()}
    assert got == want


def test_duplicates_are_known_after_a_restart(spark, tmp_path, monkeypatch):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "row_id long, company string, title string, city string, description string, publish_date string, salary_min string, salary_max string, category string, publish_year string"

    def posting(i, text):
        return (i, "公司", "工程师", "北京", f"负责系统开发与测试工作，第{text}组", "2020-01-01", "5000", "8000", "全职", "2020")

    def arrive(ids):
        spark.createDataFrame([posting(i, t) for i, t in ids], schema).write.mode("append").parquet(path)
        incremental.clean_arrivals(incremental.arriving(spark, path, spark.createDataFrame([], schema).schema), out, state).awaitTermination()

    def found():
        return {r["row_id"]: r["reject_reason"] for r in incremental.read_cleaned(spark, out).collect()}

    arrive([(5, "甲"), (6, "甲"), (7, "乙")])
    assert found() == {5: "valid", 6: "duplicate", 7: "valid"}
    # a batch that fails after its keys were written is run again and does not take itself for a copy
    real, calls = incremental.checkpoint, []

    def failing(df):
        calls.append(1)
        if len(calls) == 3:
            real(df).write.mode("overwrite").parquet(f"{state}/first_rows/batch=1")
            raise RuntimeError("executor lost")
        return real(df)

    monkeypatch.setattr(incremental, "checkpoint", failing)
    with pytest.raises(Exception):
        arrive([(1, "甲"), (2, "丙"), (8, "丙")])
    monkeypatch.setattr(incremental, "checkpoint", real)
    arrive([(9, "丁")])
    rows = found()
    assert {k: rows[k] for k in (1, 2, 5, 6, 7, 8, 9)} == {
        1: "duplicate", 2: "valid", 5: "valid", 6: "duplicate", 7: "valid", 8: "duplicate", 9: "valid"}


def test_a_costly_column_is_computed_once(spark):
    df = spark.createDataFrame([("任职要求：熟悉Java与SQL等多种数据库技术并能独立完成开发工作",)], "d string")
    plan = cleaning.extract_requirements(df, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("filter", "")
    assert cleaning.extract_requirements(df, "d").count() == 1


def test_entry_point(spark):
    module = importlib.import_module("__spark_entry__")
    df = module.entry(spark)
    assert df.columns == ["lang", "year", "n_docs", "mean_entropy", "mean_tokens"] and df.count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())


SAMPLE = [
    "flt3_rule_chain", "txt9_skill_text", "cls8_title_match", "dup5_corpus_dedup", "jon9_nearest_vectors", "agg1_cell_panel",
    "agg31_facets", "win1_year_sequence", "nlp5_merge_phrases", "nlp14_word_entropy", "mdl2_inference", "mdl20_skill_profile",
    "met5_rao_q", "reg2_cluster_robust", "str1_incremental_cleaning"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
              " conversations").split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = con.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    got = sorted(map(repr, df.select(*[f"`{n}`" for n in names]).collect()))
    from pyspark.sql import Row

    want = sorted(repr(Row(**dict(zip(names, r)))) for r in cur.fetchall())
    assert got == want
