"""Contracts on streams: validation keeps no state, so it runs on any streaming DataFrame."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.operators.contract import Contract


def quarantine(stream: DataFrame, contract: Contract, name: str | None, *, valid_path: str, invalid_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes valid rows to one Parquet folder and the others, with errors, to another.

    Each micro-batch is validated once.  A batch that is repeated after a failure overwrites the
    folder of its own number, so rows are written exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = contract.validate(batch, name).persist()
        checked.where("valid").drop("valid", "errors").write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        checked.where("NOT valid").drop("valid").write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")
        checked.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def error_rates(stream: DataFrame, contract: Contract, name: str | None, *, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and invalid rows in windows of event time."""
    checked = contract.validate(stream, name, with_errors=False).withWatermark(time, late)
    return checked.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where all of Spark is one process."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="pactlake-")
