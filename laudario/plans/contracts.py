"""Versions of the tables between stages: stamped where they are made, checked where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each layer reads, as (schema version, rules version).
READS = {"semantic": ("1.2", "1.0"), "derived": ("1.1", "1.0"), "projection": ("1.1", "1.0")}
_NAME = "laudario.contract"


def stamp(df: DataFrame, schema: str, rules: str, complete: bool = True) -> DataFrame:
    """Writes the versions, and whether the coverage was complete, into the first column's metadata; Parquet keeps them."""
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(first, metadata={_NAME: [schema, rules, str(complete)]}), *[F.col(f"`{c}`") for c in rest])


def guard(df: DataFrame, layer: str) -> DataFrame:
    """The table itself if the layer may read it; ValueError for another version, for none, or where a projection's source is incomplete."""
    found = df.schema.fields[0].metadata.get(_NAME)
    schema, rules = READS[layer]
    if not found or tuple(found[:2]) != (schema, rules):
        raise ValueError(f"{layer} reads schema {schema} with rules {rules}, not {found and tuple(found[:2])}")
    if layer == "projection" and found[2] != "True":
        raise ValueError("the source of a projection must be covered completely")
    return df
