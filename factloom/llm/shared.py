"""Helpers of the corpus operators: the shared folder and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, cut_rdd, delete_path, fresh_path, scratch, shared_dir, written

__all__ = ["cut", "cut_rdd", "delete_path", "fresh_path", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

