"""Readers for posting files, token corpora, dictionaries and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import fixed

WINDOW_FILE = r"window_(\d{4})_(\d{4})\.csv"


def read_posting_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None) -> DataFrame:
    """Posting CSV files with a header; damaged rows are kept with nulls.

    Quoted line breaks are allowed. A byte-order mark is removed from the first
    header cell, so the columns are matched by name.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("encoding", "UTF-8"))
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_windows(spark: SparkSession, folder: str, windows: Sequence[str] | None = None) -> DataFrame:
    """All window files of a folder with their window label, optionally only some."""
    df = read_posting_csv(spark, f"{folder.rstrip('/')}/window_*.csv")
    name = F.regexp_extract(F.input_file_name(), WINDOW_FILE, 0)
    df = df.withColumn("window", F.regexp_replace(name, r"\.csv$", ""))
    return df.filter(F.col("window").isin(*windows)) if windows else df.filter("window != ''")


def read_tokens(spark: SparkSession, path: str, min_tokens: int = fixed.MIN_TOKENS) -> DataFrame:
    """Token documents from JSON lines; malformed lines and short documents leave."""
    df = spark.read.schema(schemas.TOKENS).option("mode", "DROPMALFORMED").json(path)
    return df.filter(F.size("tokens") >= min_tokens)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a word list: first field per line, with a Han character, two or longer."""
    return dictionary_terms(spark.read.text(path), F.col("value"))


def dictionary_terms(lines: DataFrame, line: Column) -> DataFrame:
    word = F.get(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), F.lit(0))
    return (
        lines.select(word.alias("term")).filter(F.length("term") >= 2)
        .filter(F.col("term").rlike("[一-龥]")).distinct())


def rename_postings(df: DataFrame, renames: Mapping[str, str] = schemas.POSTING_RENAMES) -> DataFrame:
    known = {a: b for a, b in renames.items() if a in df.columns}
    return df.drop(*schemas.DROPPED_COLUMNS).withColumnsRenamed(known)


def union_sources(parts: Mapping[str, DataFrame], renames: Mapping[str, str] = schemas.POSTING_RENAMES) -> DataFrame:
    """Union of source tables under unified names with their provenance."""
    out = None
    for name, part in parts.items():
        one = rename_postings(part, renames).withColumn("data_source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def conform(df: DataFrame, columns: Sequence[str], values: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows in a target header; columns without a value are empty strings."""
    values = values or {}

    def cell(name: str) -> Column:
        source = values.get(name, F.col(name) if name in df.columns else F.lit(None))
        return F.coalesce(source.cast("string"), F.lit("")).alias(name)

    return df.select(*[cell(c) for c in columns])


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered part files of one folder as a single table."""
    return spark.read.parquet(folder)
