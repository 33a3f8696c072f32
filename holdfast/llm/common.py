"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java and Python class body; words are runs of other characters.
SPACE = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="holdfast-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on. For narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read from there. For wide tables: it is compressed and its columns are pruned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/holdfast-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more than a FREQUENT-th of all rows is frequent; so there are at most FREQUENT of them.
FREQUENT = 10_000


def attach(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with what per_key (a row for each value of key, null being one, of n rows) says of their key; nulls where it says nothing.

    Frequent keys, of which there are at most FREQUENT, are broadcast; the rows of all others meet them by a shuffle, in
    which no key has more than a FREQUENT-th of the rows. `total` is the number of rows.
    """
    at, more = f"_{key}", [c for c in per_key.columns if c not in (key, n)]
    often = F.broadcast(per_key.where(F.col(n) * FREQUENT > total).select(F.col(key).alias(at), *more))
    seldom = per_key.where(F.col(n) * FREQUENT <= total).select(F.col(key).alias(at), *more)
    same = F.col(key).eqNullSafe(F.col(at))
    return rows.join(often, same).drop(at).unionByName(rows.join(often.select(at), same, "left_anti").join(seldom, same, "left").drop(at))


def numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(number, text) for each row, (number, doc_id, text_hash) for each number, and whether no two rows can have one number.

    Rows of one id and text have one number; numbers are below 2**32, in the order of (id is null, id, text_hash). Ids
    that are such numbers already stay; else numbers are counted over the sorted ids, and the texts written with them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    fit = (F.min("doc_id") >= 0) & (F.max("doc_id") < 1 << 32) & (F.count("doc_id") == F.count(F.lit(1))) & (F.max("n") == 1)
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(fit.alias("fit")).first()["fit"]:
        return rows.select(F.col("doc_id").alias("number"), "text"), rows.select(F.col("doc_id").alias("number"), "doc_id", "text_hash"), True
    ordered = rows.select("doc_id", "text_hash").distinct().orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash")
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    first, total = [F.lit(-1), F.lit(0)], 0
    for p, n in sorted(ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each partition
        first += [F.lit(p), F.lit(total)]
        total += n
    if total >= 1 << 32:
        raise ValueError("more than 2**32 documents")
    keys = cut(ordered.select((F.create_map(*first)[part] + F.expr("at & 8589934591L")).alias("number"), "doc_id", "text_hash"))
    of = keys.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    met = rows.join(of, rows["doc_id"].eqNullSafe(of["_id"]) & (rows["text_hash"] == of["_hash"]))
    return table(met.select("number", "text"), "numbered"), keys, False


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
