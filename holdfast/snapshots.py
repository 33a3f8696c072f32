"""Relations that are computed once and read from the shared folder from then on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder on a local master where it is unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="holdfast-")
        context.setCheckpointDir(at)
    return at


def snapshot(df: DataFrame) -> DataFrame:
    """df, written now; its plan from here on is a scan of the columns that are asked for."""
    path = f"{shared_folder(df.sparkSession)}/holdfast-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ordered(df: DataFrame, order: list, amount: Column) -> tuple[DataFrame, Column]:
    """df in order, sorted by ranges and written, with `at_` and `amount_`; and the sum of the amounts in all ranges before a row's."""
    rows = snapshot(df.withColumn("amount_", amount.cast("long")).orderBy(*order).withColumn("at_", F.monotonically_increasing_id()))
    before, total = [F.lit(-1), F.lit(0)], 0
    for p, n in sorted(rows.groupBy(F.shiftright("at_", 33)).agg(F.sum("amount_")).collect()):  # a row for each partition
        before += [F.lit(p), F.lit(total)]
        total += n or 0
    return rows, F.coalesce(F.create_map(*before)[F.shiftright("at_", 33)], F.lit(0))


def numbered(df: DataFrame, order: list, to: str) -> DataFrame:
    """df with the position of each row from 0 in the given order."""
    rows, before = _ordered(df, order, F.lit(1))
    return rows.withColumn(to, (before + F.expr("at_ & 8589934591L")).cast("long")).drop("at_", "amount_")


def running_total(df: DataFrame, order: list, amount: str, to: str) -> DataFrame:
    """df with the sum of `amount` over all rows before each one; sums run within ranges, never over all rows in one task."""
    rows, before = _ordered(df, order, F.coalesce(F.col(amount), F.lit(0)))
    own = Window.partitionBy(F.shiftright("at_", 33)).orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(to, (before + F.coalesce(F.sum("amount_").over(own), F.lit(0))).cast("long")).drop("at_", "amount_")
