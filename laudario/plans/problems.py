"""Queries of the general problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laudario.operators import nested, units
from laudario.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = units.common_units(table(spark, folder, "laboratory_concept"), table(spark, folder, "concept_molar_mass"))
    return units.p2_found(table(spark, folder, "lab_observation"), table(spark, folder, "derived_input"), catalogue)


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """By concept: observations with a number, with a stated unit, and in a unit of another size."""
    catalogue = units.common_units(table(spark, folder, "laboratory_concept"), table(spark, folder, "concept_molar_mass"))
    seen = units.convert(
        table(spark, folder, "lab_observation").select("concept_id", "raw_value", "numeric_value", "raw_unit", "label", "reference_text"),
        concept="concept_id", value="raw_value", numeric="numeric_value",
        places=[F.col("raw_unit"), units.label_unit(F.col("label")), units.reference_unit(F.col("reference_text"))], catalogue=catalogue,
    )
    return seen.groupBy("concept_id").agg(
        F.count("*").alias("observations"),
        F.count("unit_factor").alias("with_unit"),
        F.count_if(F.abs(F.col("unit_factor") - 1) > 1e-9).alias("converted"),
    )


def p2_unread(spark: SparkSession, folder: str) -> DataFrame:
    """By concept: unit texts that are stated and that no reading explains."""
    catalogue = units.common_units(table(spark, folder, "laboratory_concept"), table(spark, folder, "concept_molar_mass"))
    return units.unread(table(spark, folder, "lab_observation"), concept="concept_id", value="raw_value", unit="raw_unit", catalogue=catalogue)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.links(table(spark, folder, "nested_record"))


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, roots and last ordinal of each flat table, by schema path."""
    nodes = nested.label_nodes(table(spark, folder, "nested_record"), scalars=False)
    return nodes.groupBy("schema_path", "node_kind").agg(
        F.count("*").alias("rows"),
        F.count_if(nested.parent_label(F.col("dewey")).isNull()).alias("roots"),
        F.max("ordinal").alias("last_ordinal"),
    )


def _flat(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_table(nested.label_nodes(table(spark, folder, "nested_record")), kind)

    return run


def p3_others(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of all arrays of objects that are not known by name where they stand."""
    return nested.other_tables(nested.label_nodes(table(spark, folder, "nested_record")))


QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage, "p2_unread": p2_unread, "p3_found": p3_found, "p3_tables": p3_tables, "p3_others": p3_others}
QUERIES |= {f"p3_{kind}s": _flat(kind) for kind in ("patient", "episode", "occurrence", "observation", "page", "line", "cell", "word")}
SQL: dict[str, str] = {}
