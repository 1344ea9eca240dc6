"""String leaves of JSON text and malformed records, by the structural index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import json_index
from vigil.session import ship_package


def malformed(record: str) -> Column:
    """Whether a text is no JSON (a repeated key and half of a surrogate pair
    count as malformed); null texts aren't malformed."""
    ship_package(SparkSession.active())
    return F.coalesce(F.arrow_udf(lambda r: json_index.malformed(r), "boolean")(F.col(record)), F.lit(False))


def string_leaves(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(keys, leaf): every string in the records that isn't empty, however deep;
    object keys aren't leaves, and malformed records have none."""
    ship_package(df.sparkSession)
    leaves = F.arrow_udf(lambda r: json_index.string_leaves(r), "array<string>")(F.col(record))
    return df.select(*keys, F.explode(leaves).alias("leaf"))
