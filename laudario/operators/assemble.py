"""Pages grouped into patients and episodes, exact content collapsed, everything accounted for.

Input is one row a page header and one row a line. Grouping shuffles once by document, once by patient
and once by episode; texts travel only as fingerprints and are never gathered beyond one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.session import numbered


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def page_keys(headers: DataFrame) -> DataFrame:
    """Adds patient_key and episode_key; NULL where name or birth date, or request number, date or time are missing."""
    key = T.stable_id("patient", T.identity_text(F.col("patient_name")), T.iso_or_raw(F.col("birth_date")))
    known = ~_blank("patient_name") & ~_blank("birth_date")
    df = headers.withColumn("patient_key", F.when(known, key))
    whole = known & ~_blank("request_number") & ~_blank("request_date") & ~_blank("request_time")
    return df.withColumn("episode_key", F.when(whole, T.stable_id("episode", F.col("patient_key"), T.identity_text(F.col("request_number")), T.iso_or_raw(F.col("request_date")), F.trim("request_time"))))


def document_identity(headers: DataFrame) -> DataFrame:
    """One row a document: its identity from the first page, and the reason why it is refused, if any.

    The first failing page gives the reason: MissingIdentity, ConflictingIdentity or ConflictingSex. A
    missing sex agrees with any.
    """
    by_page = W.partitionBy("document_id").orderBy("page_number", "header_id")
    whole = by_page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pages = page_keys(headers).withColumn("sex_key", F.lower(F.trim("sex")))
    pages = pages.withColumn("first_key", F.first("patient_key").over(whole)).withColumn("first_sex", F.first("sex_key", ignorenulls=True).over(by_page.rowsBetween(W.unboundedPreceding, 0)))
    reason = (
        F.when(F.col("patient_key").isNull(), "MissingIdentity").when(F.col("patient_key") != F.col("first_key"), "ConflictingIdentity")
        .when(F.col("sex_key") != F.col("first_sex"), "ConflictingSex")
    )
    pages = pages.withColumn("reason", reason)
    order = F.struct("page_number", "header_id")
    return pages.groupBy("document_id").agg(
        F.min("input_index").alias("input_index"), F.min_by("file_name", order).alias("file_name"), F.min_by("patient_key", order).alias("patient_key"),
        F.min_by("sex_key", F.when(F.col("sex_key").isNotNull(), order)).alias("sex_key"), F.count("*").alias("pages"), F.count_if(F.col("episode_key").isNull()).alias("unassigned_pages"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("reason"),
    )


def ledger(headers: DataFrame) -> DataFrame:
    """One row a document: Assigned, AssignedWithUnassignedPages or Rejected, with counts and reason.

    A document whose sex differs from that of the patient's first accepted document is rejected; if that
    one has none, all are accepted.
    """
    documents = document_identity(headers)
    fine = documents.where("reason IS NULL")
    first = fine.groupBy("patient_key").agg(F.struct(F.min_by("sex_key", F.struct("input_index", "document_id")).alias("sex"), F.lit(1)).alias("f")).select("patient_key", F.col("f.sex").alias("patient_sex"))
    judged = documents.join(first, "patient_key", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("sex_key") != F.col("patient_sex"), "SexIncompatible")))
    status = F.when(F.col("reason").isNotNull(), "Rejected").when(F.col("unassigned_pages") > 0, "AssignedWithUnassignedPages").otherwise("Assigned")
    return judged.select("document_id", "input_index", "file_name", "patient_key", status.alias("status"), "pages", "unassigned_pages", "reason")


def accepted_pages(headers: DataFrame) -> DataFrame:
    """Pages of accepted documents that belong to an episode."""
    good = ledger(headers).where("status != 'Rejected'").select("document_id")
    return page_keys(headers).where("episode_key IS NOT NULL").join(good, "document_id", "left_semi")


def page_contents(lines: DataFrame) -> DataFrame:
    """One row a page: fingerprint and number of its active lines, in source order."""
    active = lines.where("disposition = 'Active'").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("source_index", "line_id", "text"))).alias("a"))
    texts = F.transform("a", lambda x: x["text"])
    return active.select("document_id", "page_number", F.sha2(F.concat_ws("\u001f", texts), 256).alias("fingerprint"), F.size("a").alias("lines"))


def content_blocks(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Canonical blocks: per episode, pages of equal text once, in order of first appearance, with their sources counted."""
    pages = accepted_pages(headers).join(page_contents(lines), ["document_id", "page_number"])
    order = F.struct("input_index", "document_id", "page_number", "header_id")
    blocks = pages.groupBy("episode_key", "fingerprint").agg(F.min(order).alias("o"), F.count("*").alias("sources"), F.first("lines").alias("lines"))
    ordinal = F.row_number().over(W.partitionBy("episode_key").orderBy("o")) - 1
    blocks = blocks.withColumn("ordinal", ordinal)
    return blocks.select("episode_key", "fingerprint", "ordinal", "sources", "lines", T.stable_id("block", F.col("episode_key"), F.col("fingerprint"), F.col("ordinal")).alias("block_id"))


def episodes(headers: DataFrame) -> DataFrame:
    """Episodes: representative request fields of the first page, pages, documents, distinct origins in page order."""
    order = F.struct("input_index", "document_id", "page_number", "header_id")
    pages = accepted_pages(headers)
    spelled = pages.where(~_blank("origin")).groupBy("episode_key", F.lower("origin").alias("k")).agg(F.min(order).alias("o"), F.min_by("origin", order).alias("origin"))
    origins = spelled.groupBy("episode_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "origin"))), lambda x: x["origin"]), " | ").alias("origins"))
    base = pages.groupBy("patient_key", "episode_key").agg(
        F.min_by("request_number", order).alias("request_number"), F.min_by("request_date", order).alias("request_date"), F.min_by("request_time", order).alias("request_time"),
        F.count("*").alias("pages"), F.count_distinct("document_id").alias("documents"),
    )
    return base.join(origins, "episode_key", "left")


def ordered_episodes(headers: DataFrame) -> DataFrame:
    """Place of each episode of a patient: newest first, times that are none before all, then by request number."""
    e = episodes(headers)
    ts = F.try_to_timestamp(F.concat_ws(" ", "request_date", "request_time"), F.lit("dd/MM/yyyy HH:mm:ss"))
    return e.select("patient_key", "episode_key", F.row_number().over(W.partitionBy("patient_key").orderBy(ts.desc_nulls_first(), "request_number", "episode_key")).alias("place"))


def ordered_patients(headers: DataFrame) -> DataFrame:
    """Place of each patient in the batch: by name in key form, then by the birth date as written on the first page. Numbered in a global sort."""
    order = F.struct("input_index", "document_id", "page_number", "header_id")
    first = accepted_pages(headers).groupBy("patient_key").agg(F.min_by("patient_name", order).alias("patient_name"), F.min_by("birth_date", order).alias("birth_date"))
    return numbered(first.withColumn("sorted", T.identity_text(F.col("patient_name"))), "sorted", "birth_date", "patient_key", name="place").select("patient_key", "patient_name", "birth_date", "place")


def ordered_pages(headers: DataFrame) -> DataFrame:
    """Place of each page in its episode: by input, then page."""
    w = W.partitionBy("episode_key").orderBy("input_index", "page_number", "document_id", "header_id")
    return accepted_pages(headers).select("episode_key", "header_id", F.row_number().over(w).alias("place"))


def coverage(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Per episode: pages with and without content, lines, blocks, lines saved, and whether the sums agree."""
    pages = accepted_pages(headers).join(page_contents(lines), ["document_id", "page_number"], "left")
    source = pages.groupBy("episode_key").agg(F.count("*").alias("pages"), F.count("fingerprint").alias("active_pages"), F.coalesce(F.sum("lines"), F.lit(0)).alias("source_lines"))
    blocks = content_blocks(headers, lines).groupBy("episode_key").agg(F.count("*").alias("blocks"), F.sum("lines").alias("canonical_lines"), F.sum("sources").alias("block_sources"), F.sum(F.col("lines") * (F.col("sources") - 1)).alias("saved_lines"))
    both = source.join(blocks, "episode_key", "left").na.fill(0, ["blocks", "canonical_lines", "block_sources", "saved_lines"])
    return both.withColumn("lossless", (F.col("block_sources") == F.col("active_pages")) & (F.col("canonical_lines") + F.col("saved_lines") == F.col("source_lines")))


def age_at(birth: Column, request: Column) -> Column:
    """Completed years between two dates; a birth on 29 February has its birthday on the 28th in common years."""
    years = F.year(request) - F.year(birth)
    return years - F.when(request < F.add_months(birth, 12 * years), 1).otherwise(0)


def ages(headers: DataFrame) -> DataFrame:
    """Age at request of each page, or the reason why there is none."""
    day = lambda c: F.when(F.col(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))).cast("date")
    d = headers.select("header_id", day("birth_date").alias("b"), day("request_date").alias("r"))
    status = F.when(F.col("b").isNull(), "BirthDateInvalid").when(F.col("r").isNull(), "RequestDateInvalid").when(F.col("r") < F.col("b"), "RequestBeforeBirth").otherwise("Computed")
    return d.withColumn("age_status", status).select("header_id", "age_status", F.when(F.col("age_status") == "Computed", age_at(F.col("b"), F.col("r"))).alias("age"))
