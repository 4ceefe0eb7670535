"""A shared folder for sessions that are one process and have none: tests, the bench, a notebook."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def with_folder(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, which on ``local[...]`` masters gets a temporary checkpoint folder if none is set. Clusters must name theirs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] == "local":
            spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        return query(spark, sf_dir)

    return run
