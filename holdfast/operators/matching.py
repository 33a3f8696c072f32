"""Content matching: which held files satisfy which required entries.

Two rules are kept apart on purpose. `present` (completeness) knows a file by SHA-1, by SHA-1 without a header, by MD5
and by CRC-32 with size. `matches` (planning) knows no MD5 and uses CRC-32 with size only where an entry has no SHA-1.
Each arm is an equi-join, so a disjunction never becomes a nested loop; arms are united and made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAFE_ROWS, GUARD, PER_CONTENT = 20_000_000, 50_000, 64


def large(df: DataFrame) -> DataFrame:
    """To be joined by sorting: it grows with the catalogue, and Spark takes a compressed file for a small table to send through the driver."""
    return df.hint("merge")


def required_key(sha1: str = "sha1", md5: str = "md5", crc32: str = "crc32", size: str = "size") -> Column:
    """The strongest identity of an entry as a tagged string; null if it has none."""
    return (
        F.when(F.col(sha1).isNotNull(), F.concat(F.lit("S:"), sha1))
        .when(F.col(md5).isNotNull(), F.concat(F.lit("M:"), md5))
        .when(F.col(crc32).isNotNull(), F.concat(F.lit("C:"), crc32, F.lit(":"), F.col(size).cast("string")))
    )


def held_keys(files: DataFrame) -> DataFrame:
    """All identities that files have, as `key`; an explode of one scan, not a union of four."""
    keys = F.array(
        F.concat(F.lit("S:"), "sha1"), F.concat(F.lit("S:"), "sha1_no_header"), F.concat(F.lit("M:"), "md5"), F.concat(F.lit("C:"), "crc32", F.lit(":"), F.col("size").cast("string"))
    )
    return files.select(F.explode(F.array_compact(keys)).alias("key")).distinct()


def present(roms: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct keys of roms that files hold."""
    return roms.select(required_key().alias("key")).where("key is not null").distinct().join(held_keys(files), "key", "left_semi")


def matches(roms: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct rows of `keep`, sha1 (the file's) and size (the file's) for each file that satisfies an entry."""
    want = roms.where("status <> 'nodump'").select(*keep, F.col("sha1").alias("want"), F.col("crc32").alias("crc"), F.col("size").alias("bytes"))
    have = large(files.select(F.col("sha1"), "sha1_no_header", "crc32", "size"))
    hashed = want.where("want is not null")
    plain = hashed.join(have, F.col("want") == F.col("sha1"))
    bare = hashed.join(have, F.col("want") == F.col("sha1_no_header"))
    weak = want.where("want is null and crc is not null").join(have, (F.col("crc") == F.col("crc32")) & (F.col("bytes") == F.col("size")))
    pick = [*keep, "sha1", "size"]
    return plain.select(*pick).union(bare.select(*pick)).union(weak.select(*pick)).distinct()


def split_only(roms: DataFrame, games: DataFrame) -> DataFrame:
    """Entries that a split set holds: a clone's merged ones go."""
    clones = games.select("coll", "version", "game", F.col("parent_name").isNotNull().alias("_clone"))
    return roms.join(clones, ["coll", "version", "game"]).where("not _clone or merge_tag is null").drop("_clone")


def holders(matched: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """Every place that holds a matched content, with the source's root and disposition."""
    at = locations.join(F.broadcast(sources.select("source", F.col("path").alias("root"), "disposition")), "source")
    return matched.join(large(at.select("sha1", "source", "root", "disposition", "path", "archive_path")), "sha1")


def capped_holders(matched: DataFrame, locations: DataFrame, sources: DataFrame, cap: int = PER_CONTENT) -> DataFrame:
    """Holders of matched contents, at most cap places of each content, first by source and path.

    Places are ranked and cut before they meet the entries, so no content grows to more than entries times cap rows.
    """
    places = locations.join(large(matched.select("sha1").distinct()), "sha1", "left_semi").dropDuplicates(["sha1", "source", "path", "archive_path"])
    return holders(matched, _first_places(places, cap), sources)


def expansion(matched: DataFrame, locations: DataFrame, cap: int | None = None) -> DataFrame:
    """How many (entry, place) rows a match grows to, from counts alone; with cap, at most cap + 1."""
    places = locations.groupBy("sha1").agg(F.count("*").alias("places"))
    total = matched.groupBy("sha1").agg(F.count("*").alias("entries")).join(places, "sha1").agg(F.coalesce(F.sum(F.col("entries") * F.col("places")), F.lit(0)).alias("n_rows"))
    return total if cap is None else total.select(F.least("n_rows", F.lit(cap + 1)).alias("n_rows"))


def unmatched(files: DataFrame, roms: DataFrame) -> DataFrame:
    """Files that no entry asks for by SHA-1 (with or without header) or, where it has none, by CRC-32 and size: three anti-joins."""
    hashes = roms.where("sha1 is not null").select(F.col("sha1").alias("want")).distinct()
    weak = roms.where("sha1 is null and crc32 is not null").select(F.col("crc32").alias("crc"), F.col("size").alias("bytes")).distinct()
    left = files.join(hashes, files["sha1"] == F.col("want"), "left_anti")
    left = left.join(hashes, left["sha1_no_header"] == F.col("want"), "left_anti")
    return left.join(weak, (left["crc32"] == F.col("crc")) & (left["size"] == F.col("bytes")), "left_anti")


def unknown_files(locations: DataFrame, files: DataFrame, roms: DataFrame) -> DataFrame:
    """Loose places whose content no active entry asks for."""
    return locations.where("archive_path is null").join(unmatched(files, roms).select("sha1", "size"), "sha1")


def missing_entries(roms: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that no file satisfies under the planner's rule."""
    want = roms.where("status <> 'nodump'")
    hashes = files.select(F.explode(F.array_compact(F.array("sha1", "sha1_no_header"))).alias("_h")).distinct()
    weak = files.where("crc32 is not null").select(F.col("crc32").alias("_c"), F.col("size").alias("_s")).distinct()
    strong = want.where("sha1 is not null").join(hashes, F.col("sha1") == F.col("_h"), "left_anti")
    loose = want.where("sha1 is null").join(weak, (F.col("crc32") == F.col("_c")) & (F.col("size") == F.col("_s")), "left_anti")
    return strong.union(loose)


def shared_content(matched: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Contents that entries of more than one game ask for; of those that lie anywhere, if locations are given."""
    matched = matched if locations is None else matched.join(large(locations.select("sha1")), "sha1", "left_semi")
    return matched.groupBy("sha1").agg(F.count_distinct("coll", "game").alias("games")).where("games > 1").select("sha1")


def shared_containers(held: DataFrame) -> DataFrame:
    """Archives whose entries serve more than one game."""
    return held.where("archive_path is not null").groupBy("source", "root", "path").agg(F.count_distinct("coll", "game").alias("games")).where("games > 1").drop("games")


def held_elsewhere(locations: DataFrame) -> DataFrame:
    """Contents that more than one source holds."""
    return locations.groupBy("sha1").agg(F.count_distinct("source").alias("n")).where("n > 1").select("sha1")


def reclaimable_loose(locations: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """Loose files of consumed sources that another source holds too."""
    own = locations.where("archive_path is null").join(sources.where("disposition = 'consume'").select("source"), "source", "left_semi")
    return own.join(held_elsewhere(locations), "sha1", "left_semi").join(files.select("sha1", "size"), "sha1").select("source", "path", "sha1", "size")


def reclaimable_containers(locations: DataFrame, files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Archives all of whose entries another source holds too, with their bytes; of consumed sources only, if sources are given."""
    inside = locations.where("archive_path is not null")
    if sources is not None:
        inside = inside.join(sources.where("disposition = 'consume'").select("source"), "source", "left_semi")
    entries = inside.join(files.select("sha1", "size"), "sha1")
    marked = entries.join(held_elsewhere(locations).withColumn("_else", F.lit(1)), "sha1", "left")
    return marked.groupBy("source", "path").agg(F.sum("size").alias("bytes"), F.count("*").alias("entries"), F.min(F.coalesce("_else", F.lit(0))).alias("ok")).where("ok = 1").drop("ok")


def reclaim(locations: DataFrame, files: DataFrame, sources: DataFrame, selector: Column | None = None) -> DataFrame:
    """What can go because another source holds it: source, path, kind (loose, container), bytes; of consumed sources, and those that the selector takes."""
    own = sources if selector is None else sources.where(selector)
    loose = reclaimable_loose(locations, files, own).select("source", "path", F.lit("loose").alias("kind"), F.col("size").alias("bytes"))
    return loose.unionByName(reclaimable_containers(locations, files, own).select("source", "path", F.lit("container").alias("kind"), "bytes"))


def _first_places(places: DataFrame, cap: int) -> DataFrame:
    """The first cap places of each content by source, path and entry. Each salt of a content keeps its own first ones before they meet."""
    order = ["source", "path", F.asc_nulls_first("archive_path")]
    salted = places.withColumn("_salt", F.pmod(F.xxhash64("source", "path", "archive_path"), F.lit(64)))
    some = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("sha1", "_salt").orderBy(*order))).where(F.col("_nth") <= cap)
    return some.withColumn("_nth", F.row_number().over(Window.partitionBy("sha1").orderBy(*order))).where(F.col("_nth") <= cap).drop("_nth", "_salt")


def survivors(locations: DataFrame, sources: DataFrame) -> DataFrame:
    """For each place: whether each of its contents is held at another place that may count: its own source, or a consumed one's any."""
    at = locations.join(sources.select("source", "disposition"), "source")
    here = at.select("source", "path", "sha1", "disposition").distinct()
    per_source = here.groupBy("sha1", "source").agg(F.count("*").alias("in_source"))
    everywhere = here.groupBy("sha1").agg(F.count("*").alias("in_all"))
    met = here.join(per_source, ["sha1", "source"]).join(everywhere, "sha1")
    safe = F.when(F.col("disposition") == "consume", F.col("in_all") > 1).otherwise(F.col("in_source") > 1)
    return met.groupBy("source", "path").agg(F.every(safe).alias("survives"))
