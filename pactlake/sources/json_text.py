"""Sources of JSON documents and of schema documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlake.plans.catalog import Catalog
from pactlake.plans.schema import Schema


def json_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One JSON text a line, not inferred: numbers and keys stay as they are written."""
    return spark.read.text(path).withColumnRenamed("value", name)


def json_documents(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One JSON text a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", name)


def spark_loader(spark: SparkSession):
    """A schema loader for any store that Spark reads; it runs on the driver."""
    return lambda uri: spark.read.text(uri, wholetext=True).first()[0]


def http_loader(timeout: float = 10.0):
    """A schema loader for http and https; never registered by default."""
    from urllib.request import urlopen

    def load(uri: str) -> bytes:
        with urlopen(uri, timeout=timeout) as answer:
            if answer.status != 200:
                raise OSError(f"{uri}: status {answer.status}")
            return answer.read()

    return load


def compile_folder(spark: SparkSession, path: str, catalog: Catalog | None = None) -> dict[str, Schema]:
    """Compiles all schema documents of a folder as one batch, by file name."""
    from pyspark.sql import functions as F

    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("uri"), "value").collect()  # schema documents
    return (catalog or Catalog()).compile_batch({r.uri: r.value for r in rows})
