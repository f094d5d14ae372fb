"""The queries by name, with the SQL that tells their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import seq as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def records(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sequence records."""
    id_ = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("rec_ix"), id_.alias("id"), F.col("lang").alias("desc"), F.col("text").alias("seq"))


def dna(spark: SparkSession, sf: str) -> DataFrame:
    """documents as records over ACGT."""
    return records(spark, sf).withColumn("seq", S.dna_of(F.col("seq")))


RECORDS_SQL = """rec AS (SELECT doc_id AS rec_ix, source || '_' || doc_id AS id, lang AS "desc", text AS seq FROM documents)"""
DNA_SQL = """dna AS (SELECT doc_id AS rec_ix, source || '_' || doc_id AS id, lang AS "desc",
  translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
