"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, licenses, lines, lm, packing, pii, quality, secrets, simhash, token_files, vectors, warc
from .common import documents


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def _span_digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """doc_id, a count for each base kind, the hash of the base spans and all spans as text."""
    named = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("text")))
    rows = found.select("doc_id", named.alias("s"))
    is_base = lambda s: s["kind"].isin(list(base))
    text = lambda s: F.array_join(F.transform(s, lambda x: x["text"]), ",")
    of_kind = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(text(F.filter("s", is_base)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.scan(documents(spark, sf_dir)), secrets.BASE)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find(documents(spark, sf_dir)), pii.BASE)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/language/id.txt, as the table has no paths of its own."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return licenses.licenses(docs)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(documents(spark, sf_dir), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), carry={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim.*")
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


def op12_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vectors.fit(rows)
    coded = vectors.encode(rows, books).select("vec_id", "label", F.lower(F.hex("coded.code")).alias("code"), "coded.error")
    return vectors.label_errors(coded).withColumn("codebooks_sha256", F.lit(vectors.digest(books)))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_line_dedup, op4_quality_rules, op5_secret_scans, op6_license_scans, op7_token_files, op8_personal_data, op9_best_fit_packing, op10_lm_scoring, op11_fill_in_middle, op12_web_archives, op13_vector_codes)}
ORACLES = {"op2_benchmark_decontamination": decontam.ORACLE, "op4_quality_rules": quality.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op12_web_archives": warc.ORACLE, "op13_vector_codes": vectors.ORACLE}
