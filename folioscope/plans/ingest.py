"""Files to page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.artifacts import write_documents_json
from folioscope.sources.files import scan_directory, suffix, text_pages
from folioscope.sources.pdf import pdf_pages
from pyspark.sql import functions as F


def run_ingestion(spark: SparkSession, input_dir: str, output_dir: str | None = None, load_decoder=None) -> DataFrame:
    """Parse every supported file of a directory; optionally write one JSON per document."""
    files = scan_directory(spark, input_dir)
    pages = text_pages(files)
    has_pdf = not files.filter(suffix(F.col("path")) == "pdf").select("path").isEmpty()
    if has_pdf:
        pages = pages.unionByName(pdf_pages(files, load_decoder))
    if output_dir is not None:
        write_documents_json(pages, output_dir)
    return pages
