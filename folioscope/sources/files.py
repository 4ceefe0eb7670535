"""File scans: text documents natively, other formats through an injectable page extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas

SUPPORTED = ("pdf", "txt")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension of the last path element, without the dot."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files directly inside a directory (bytes are read only if selected)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(directory)
        .filter(suffix(F.col("path")).isin(*SUPPORTED))
        .select("path", "length", "content")
    )


def require_supported(files: DataFrame) -> DataFrame:
    """Fail the job on the first file whose type has no extractor."""
    kind = suffix(F.col("path"))
    checked = F.when(kind.isin(*SUPPORTED), F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported file type: ."), kind)).cast("string")
    )
    return files.withColumn("path", checked)


def text_page(text: Column) -> list[Column]:
    """A plain text file as one page holding one block without layout."""
    block = F.struct(
        text.alias("text"),
        F.lit(None).cast(schemas.BBOX).alias("bbox"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit(False).alias("bold"),
    )
    return [
        F.lit(1).alias("page"),
        text.alias("text"),
        F.array(block).alias("text_blocks"),
        F.array().cast(f"ARRAY<{schemas.TABLE}>").alias("tables"),
        F.array().cast(f"ARRAY<{schemas.CHART}>").alias("charts"),
        F.array().cast("ARRAY<STRING>").alias("images"),
        text.alias("text_for_rag"),
    ]


def text_pages(files: DataFrame) -> DataFrame:
    """Pages of the ``.txt`` files; malformed UTF-8 becomes U+FFFD, line ends become ``\\n``."""
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    unix = F.regexp_replace(decoded, "\r\n?", "\n")
    texts = files.filter(suffix(F.col("path")) == "txt").select(
        file_name(F.col("path")).alias("document"), unix.alias("_text")
    )
    return texts.select("document", *text_page(F.col("_text")))


RawPages = Callable[[str, bytes], Iterator[dict]]


def binary_pages(files: DataFrame, extract: RawPages, schema: str) -> DataFrame:
    """Run a page extractor over the non-text files, streaming pages out file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for page in extract(path, content):
                    yield pd.DataFrame([page])

    binary = files.filter(suffix(F.col("path")) != "txt").select("path", "content")
    return binary.mapInPandas(run, schema)


def nest_documents(pages: DataFrame) -> DataFrame:
    """One row per document with its pages in order (the JSON artifact).

    A document is one JSON file by contract; operators never need this nested form.
    """
    fields = [c for c in pages.columns if c != "document"]
    nested = F.array_sort(F.collect_list(F.struct("page", *[c for c in fields if c != "page"])))
    return pages.groupBy("document").agg(nested.alias("pages"))


def explode_pages(documents: DataFrame) -> DataFrame:
    return documents.select("document", F.inline("pages"))
