"""Catalog documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``urn, payload`` from JSON lines ``{"urn": ..., "payload": {...}}``; documents stay text."""
    return spark.read.schema("urn string, payload string").json(path)
