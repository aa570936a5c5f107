"""Outputs: JSON, JSON Lines and text, written by the executors into folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.session import numbered

LAYERS = ("capture", "reconstruction", "sanitized", "assembly", "semantic", "derived", "text")


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems refuse; blank names become `document`."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")), F.lit("")), F.lit("document"))


def unique_names(documents: DataFrame, name: str = "file_name", order: str = "input_index", extension: str = ".json") -> DataFrame:
    """Adds `output_name`: the safe stem, with -02, -03 … where it was used before in any letter case."""
    stem = safe_name(F.regexp_replace(F.col(name), r"\.[^.]*$", ""))
    n = F.row_number().over(W.partitionBy(F.lower(stem)).orderBy(order, "document_id"))
    return documents.withColumn("output_name", F.concat(stem, F.when(n > 1, F.format_string("-%02d", n)).otherwise(""), F.lit(extension)))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(r[:1].upper() + r[1:] for r in rest)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact JSON object a row, names in camel case; nulls are left out."""
    df.select(*[F.col(c).alias(camel(c)) for c in df.columns]).write.mode("overwrite").json(path)


def bundle(documents: DataFrame, order: str = "input_index") -> DataFrame:
    """One JSON text for each document, numbered in input order; no documents are an error."""
    if documents.limit(1).count() == 0:
        raise ValueError("there is no document to export")
    return numbered(documents, order, "document_id").select("number", F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in documents.columns])).alias("value"))


def write_audit(layers: dict[str, DataFrame], path: str, flags: dict[str, bool] | None = None) -> list[str]:
    """Writes each chosen layer as JSON Lines under a numbered folder; returns the folders."""
    unknown = set(layers) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    out = []
    for i, layer in enumerate(LAYERS):
        if layer in layers and (flags or {}).get(layer, True):
            folder = f"{path}/{i:02d}-{layer}"
            write_json_lines(layers[layer], folder)
            out.append(folder)
    return out


def page_dump(lines: DataFrame) -> DataFrame:
    """Fixed text of each page: a heading, then a line for each line with its disposition."""
    row = F.format_string("[%03d] %-16s %s", F.col("source_index"), F.col("disposition"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("source_index", "line_id", row.alias("r"))))
    return lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(parts, lambda x: x["r"]), "\n").alias("body")).select(
        "document_id", "page_number", F.concat(F.lit("== "), F.col("document_id"), F.lit(" / "), F.col("page_number").cast("string"), F.lit(" ==\n"), F.col("body")).alias("text")
    )
