"""State changes as new snapshots: keep-first inserts, upserts, latest-wins locations, relocation, removal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..snapshots import snapshot


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key, in the given total order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """old, and the first new row of each key that old lacks."""
    return old.unionByName(keep_first(new, key, order).join(old.select(*key), key, "left_anti"))


def upsert_files(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """By sha1: the latest known other hashes win, size and first sighting stay as they were first seen."""
    both = old.withColumn("_at", F.lit(-1).cast("long")).unionByName(new.withColumn("_at", F.col(seq).cast("long")).drop(seq), allowMissingColumns=True)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    return both.groupBy("sha1").agg(last("sha1_no_header"), last("md5"), last("crc32"), F.min_by("size", "_at").alias("size"))


def upsert_locations(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """By (source, path, archive_path), a null archive path being a key of its own: the latest row wins."""
    both = old.withColumn("_at", F.lit(-1).cast("long")).unionByName(new.withColumn("_at", F.col(seq).cast("long")).drop(seq), allowMissingColumns=True)
    values = [c for c in old.columns if c not in ("source", "path", "archive_path")]
    return both.groupBy("source", "path", "archive_path").agg(F.max_by(F.struct(*values), "_at").alias("v")).select("source", "path", "archive_path", "v.*")


BUCKET = "bucket"


def stored(df: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """Writes df as a folder of `buckets` parts by the hash of its key, which `upsert_stored` changes in part."""
    _write_buckets(_in_bucket(df, key, buckets), path, "overwrite")


def _in_bucket(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _write_buckets(df: DataFrame, path: str, mode: str) -> None:
    df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "parts" else "static").partitionBy(BUCKET).parquet(path)


def upsert_stored(spark: SparkSession, path: str, new: DataFrame, key: list[str], merge, buckets: int = 256) -> int:
    """Merges new rows into a stored relation, reading and writing only the parts that they fall in; how many these are.

    merge(old, new) is one of the upserts here. The merged parts are written beside the relation first, so a job that fails
    leaves it whole. At most `buckets` numbers come to the driver.
    """
    incoming = snapshot(_in_bucket(new, key, buckets))
    touched = [r[BUCKET] for r in incoming.select(BUCKET).distinct().collect()]
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    _write_buckets(_in_bucket(snapshot(merge(old, incoming.drop(BUCKET))), key, buckets), path, "parts")
    return len(touched)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def relocate(locations: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: source, path, to_source, to_path."""
    met = locations.join(moves, ["source", "path"], "left")
    return met.withColumns({"source": F.coalesce("to_source", "source"), "path": F.coalesce("to_path", "path")}).drop("to_source", "to_path")


def remove(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def remove_source(sources: DataFrame, locations: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A source and its places go; contents stay known."""
    return sources.where(F.col("source") != source), locations.where(F.col("source") != source)


def stale(locations: DataFrame, source: str, before: str) -> DataFrame:
    return locations.where((F.col("source") == source) & (F.col("last_seen") < before))


def set_disposition(sources: DataFrame, source: str, disposition: str) -> DataFrame:
    if disposition not in ("consume", "preserve"):
        raise ValueError(f"a disposition is consume or preserve, not {disposition}")
    return sources.withColumn("disposition", F.when(F.col("source") == source, disposition).otherwise(F.col("disposition")))


def upsert_config(config: DataFrame, pattern: str, **changes: str | None) -> DataFrame:
    """One row by its exact pattern, with the given fields changed."""
    spark = config.sparkSession
    own = config.where(F.col("path_pattern") == pattern).union(spark.createDataFrame([(pattern,) + (None,) * (len(config.columns) - 1)], config.schema))
    merged = own.groupBy("path_pattern").agg(*[F.max(c).alias(c) for c in config.columns if c != "path_pattern"])
    return config.where(F.col("path_pattern") != pattern).unionByName(merged.withColumns({k: F.lit(v).cast("string") for k, v in changes.items()}))


def selected(rows: DataFrame, selector: str, number: str = "id", path: str = "path") -> Column:
    """A selector that is a number names an id, any other a part of the path."""
    return F.col(number) == int(selector) if re.fullmatch(r"[+-]?[0-9]+", selector) else F.contains(F.col(path), F.lit(selector))
