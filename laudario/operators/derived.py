"""Estimated glomerular filtration (CKD-EPI 2021) with an explicit reason wherever there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons in order of precedence.
REASONS = (
    "UnsafeAssociation", "AgeAtRequestUnavailable", "AgeBelow18", "SexUnavailable", "SexUnsupported", "SerumSpecimenNotConfirmed", "CreatinineObservationMissing",
    "CreatinineObservationAmbiguous", "CreatinineValueNotNumeric", "CreatinineValueNotPositive", "CreatinineUnitMissing", "CreatinineUnitUnsupported", "ComputationNonFinite",
)


def egfr(creatinine: Column, age: Column, female: Column) -> Column:
    """mL/min/1.73 m² of a creatinine in mg/dL."""
    ratio = creatinine / F.when(female, 0.7).otherwise(0.9)
    alpha = F.when(female, -0.241).otherwise(-0.302)
    return 142 * F.pow(F.least(ratio, F.lit(1.0)), alpha) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age.cast("double")) * F.when(female, 1.012).otherwise(1.0)


def assess(inputs: DataFrame) -> DataFrame:
    """Adds reason (NULL where computed), status and value to rows of derived inputs.

    A row is one candidate: its source observation is missing if NULL and ambiguous if several rows of
    its derived observation name different sources.
    """
    sex, unit, specimen = F.lower(F.trim("raw_sex")), F.lower(F.trim("raw_creatinine_unit")), F.upper(F.trim("raw_specimen"))
    value = F.col("numeric_creatinine_value").cast("double")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    result = egfr(value, F.col("age_at_request_years"), sex == "feminino")
    reason = (
        F.when(F.col("episode_key").isNull() | F.col("patient_key").isNull(), REASONS[0])
        .when(F.col("age_at_request_years").isNull(), REASONS[1]).when(F.col("age_at_request_years") < 18, REASONS[2])
        .when(blank("raw_sex"), REASONS[3]).when(~sex.isin("feminino", "masculino"), REASONS[4])
        .when(~F.coalesce(specimen == "SORO", F.lit(False)), REASONS[5])
        .when(F.col("source_observation_id").isNull(), REASONS[6]).when(F.col("candidates") > 1, REASONS[7])
        .when(value.isNull(), REASONS[8]).when(value <= 0, REASONS[9])
        .when(blank("raw_creatinine_unit"), REASONS[10]).when(unit != "mg/dl", REASONS[11])
    )
    out = inputs.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), result))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    out = out.withColumn("reason", F.when(F.col("reason").isNull() & ~finite, REASONS[12]).otherwise(F.col("reason")))
    return out.withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).withColumn("status", F.when(F.col("reason").isNull(), "Computed").otherwise("NotComputed"))


# Fixed value: the label of rates that the laboratory reports itself.
REPORTED_LABEL = "Taxa de Filtração Glomerular Estimada"


def candidates(occurrences: DataFrame) -> DataFrame:
    """Inputs of the rate for each creatinine occurrence: its observation, if exactly one is no reported rate, and its specimen, if it has exactly one.

    `occurrences` has occurrence_id, patient_key, episode_key, observations (id, label, raw_value, numeric_value, raw_unit) and
    specimens. The columns are those that `assess` reads of an observation; `candidates` counts the observations.
    """
    own = F.filter("observations", lambda o: F.coalesce(o["label"], F.lit("")) != REPORTED_LABEL)
    df = occurrences.withColumn("own", own).withColumn("one", F.when(F.size("own") == 1, F.get("own", F.lit(0))))
    return df.select(
        "occurrence_id", "patient_key", "episode_key", F.when(F.size("own") > 0, F.get("own", F.lit(0))["id"]).alias("source_observation_id"), F.size("own").alias("candidates"), F.transform("own", lambda o: o["id"]).alias("candidate_ids"),
        F.col("one.raw_value").alias("raw_creatinine_value"), F.col("one.numeric_value").alias("numeric_creatinine_value"), F.col("one.raw_unit").alias("raw_creatinine_unit"), F.when(F.size("specimens") == 1, F.get("specimens", F.lit(0))).alias("raw_specimen"),
    )


def provenance(inputs: DataFrame, pages: DataFrame) -> DataFrame:
    """(derived_observation_id, sources, header_pages, header_lines): the observations a rate comes from, and the header lines of its episode's pages.

    `pages` has episode_key, document_id, page_number, source_line_ids. Sources are sorted and joined by commas; an episode without pages has none.
    """
    headers = pages.groupBy("episode_key").agg(F.count("*").alias("header_pages"), F.sum(F.coalesce(F.size("source_line_ids"), F.lit(0))).alias("header_lines"))
    own = inputs.groupBy("derived_observation_id").agg(F.array_join(F.array_sort(F.collect_set("source_observation_id")), ",").alias("sources"), F.min("episode_key").alias("episode_key"))
    return own.join(headers, "episode_key", "left").select("derived_observation_id", "sources", F.coalesce("header_pages", F.lit(0)).alias("header_pages"), F.coalesce("header_lines", F.lit(0)).alias("header_lines"))


def with_candidates(inputs: DataFrame) -> DataFrame:
    """Counts the sources of each derived observation; repeated deliveries of one source count once."""
    n = inputs.groupBy("derived_observation_id").agg(F.count_distinct("source_observation_id").alias("candidates"))
    return inputs.join(n, "derived_observation_id")


def coverage(assessed: DataFrame) -> DataFrame:
    """Rows by reason; every reason has a row, with zero if it never occurs."""
    spark = assessed.sparkSession
    codes = spark.createDataFrame([("Computed",), *((r,) for r in REASONS)], "reason string")
    counts = assessed.groupBy(F.coalesce("reason", F.lit("Computed")).alias("reason")).agg(F.count("*").alias("n"))
    return codes.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
