"""Stage tables on storage: Parquet between stages, JSON where an export is wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.sources.files import explode_pages, nest_documents

REQUIRED = ("chunks", "registry", "vectors", "index_metadata")


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Overwrite one stage table; the path is returned for the next stage to read."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def require_artifacts(spark: SparkSession, root: str, names: tuple[str, ...] = REQUIRED) -> None:
    """Raise with the full list of missing stage tables."""
    paths = [f"{root.rstrip('/')}/{n}" for n in names]
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("Build the index first. Missing:\n- " + "\n- ".join(missing))


def write_documents_json(pages: DataFrame, path: str) -> None:
    """Parsed documents as JSON, one directory per document, nulls kept."""
    nested = nest_documents(pages).withColumn("stem", F.regexp_replace("document", r"\.[^.]*$", ""))
    nested.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("stem").json(path)


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of parsed-document JSON files written here or by another tool (multi-line allowed)."""
    return explode_pages(spark.read.schema(schemas.DOCUMENTS).json(path, multiLine=True, recursiveFileLookup=True))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def table_rows_of(raw: str = "raw"):
    """Rows of a table given as JSON text: a bare list of lists, or under rows, data or cells.

    The first of those keys that holds a list of lists wins; anything else has no rows.
    """
    kind = "array<array<string>>"
    bare = F.from_json(F.col(raw), kind)
    keyed = [F.from_json(F.get_json_object(F.col(raw), f"$.{k}"), kind) for k in ("rows", "data", "cells")]
    return F.coalesce(bare, *keyed, F.array().cast(kind))
