"""Demo contact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEED_EMAIL, SEED_PHONE_DIGITS, SEED_PHONE_PREFIX


def contacts(keys: DataFrame, key: str = "id") -> DataFrame:
    """``id, email, phone`` for every key. Short keys are padded in the phone, long ones stay whole."""
    number = F.col(key)
    text = number.cast("string")
    padded = F.when(F.length(text) < SEED_PHONE_DIGITS, F.lpad(text, SEED_PHONE_DIGITS, "0")).otherwise(text)
    return keys.select(
        number.alias("id"),
        F.format_string(SEED_EMAIL, number).alias("email"),
        F.concat(F.lit(SEED_PHONE_PREFIX), padded).alias("phone"),
    )


def seed_contacts(spark: SparkSession, rows: int = 100) -> DataFrame:
    return contacts(spark.range(1, rows + 1))
