"""User settings kept as JSON arrays: the chosen presets and the user's own keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.catalog.dictionaries import PRESETS


def parse_list(json: Column) -> Column:
    """Array of strings; missing or broken JSON gives an empty array."""
    return F.coalesce(F.from_json(json, "array<string>"), F.expr("cast(array() as array<string>)"))


def format_list(values: Column) -> Column:
    return F.to_json(values)


def preset_catalog(spark: SparkSession) -> DataFrame:
    """Presets with the number of their rules and keywords."""
    rows = [
        (p.preset_id, p.name, p.description, len(p.rules), len(p.keywords)) for p in PRESETS.values()
    ]
    return spark.createDataFrame(
        rows,
        "preset_id string, name string, description string, n_rules bigint, n_keywords bigint",
    )
