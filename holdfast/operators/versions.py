"""Versions of a manifest: counts, differences, which one is active, and name changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def counts(versions: DataFrame, games: DataFrame, roms: DataFrame) -> DataFrame:
    by = ["coll", "version"]
    g = games.groupBy(*by).agg(F.count("*").alias("games"))
    r = roms.groupBy(*by).agg(F.count("*").alias("roms"))
    return versions.select(*by, "is_active").join(g, by, "left").join(r, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("games", "roms")})


def previous(versions: DataFrame) -> DataFrame:
    """For each active version the one imported before it."""
    order = Window.partitionBy("coll").orderBy(F.desc("imported_seq"))
    return versions.withColumn("previous", F.lead("version").over(order)).where("is_active").select("coll", "version", "previous")


def difference(rows: DataFrame, old: str, new: str, value: str) -> DataFrame:
    """Distinct non-null values that one version of a collection has and the other lacks: coll, change, value."""
    side = lambda v: rows.where((F.col("version") == v) & F.col(value).isNotNull()).select("coll", F.col(value).alias("value")).distinct()
    added, removed = side(new).subtract(side(old)), side(old).subtract(side(new))
    return added.withColumn("change", F.lit("added")).union(removed.withColumn("change", F.lit("removed")))


def activate(versions: DataFrame, coll: str, version: str) -> DataFrame:
    """All other versions of the collection lose their mark, even where the wanted one is not there."""
    return versions.withColumn("is_active", F.when(F.col("coll") == coll, F.col("version") == version).otherwise(F.col("is_active")))


def after_removal(versions: DataFrame, coll: str) -> DataFrame:
    """Without the collection's active version; the newest of the rest becomes active."""
    left = versions.where(~((F.col("coll") == coll) & F.col("is_active")))
    newest = F.row_number().over(Window.partitionBy("coll").orderBy(F.desc("imported_seq"))) == 1
    return left.withColumn("is_active", F.when(F.col("coll") == coll, newest).otherwise(F.col("is_active")))


def removed(collections: DataFrame, versions: DataFrame, what: str, all_versions: bool = False) -> tuple[DataFrame, DataFrame]:
    """collections and versions without `what`: a collection's active version by its name, a version as Name:version, or all versions.

    A collection without versions goes too. Where the active version went, the newest of the rest becomes active.
    """
    name, _, version = what.partition(":")
    own = versions.join(collections.select("coll", "name"), "coll", "left")
    here = F.coalesce(F.col("name") == name, F.lit(False))
    gone = here if all_versions else here & (F.col("version") == version) if version else here & F.col("is_active")
    left = own.where(~gone)
    per = left.where(here).groupBy("coll").agg(F.max_by("version", "imported_seq").alias("newest"), F.max("is_active").alias("any"))
    met = left.join(per, "coll", "left").withColumn("is_active", F.when(F.col("any"), F.col("is_active")).otherwise(F.coalesce(F.col("version") == F.col("newest"), F.col("is_active"))))
    rest = met.select(*versions.columns)
    emptied = versions.select("coll").distinct().join(rest.select("coll"), "coll", "left_anti")
    return collections.join(emptied, "coll", "left_anti"), rest


def newest(versions: DataFrame) -> DataFrame:
    """The version of each collection that was imported last."""
    return versions.groupBy("coll").agg(F.max_by("version", "imported_seq").alias("version"))


def required(roms: DataFrame, games: DataFrame, versions: DataFrame, collections: DataFrame) -> DataFrame:
    """Every entry with its game, version and library path; entries without one of these are left out."""
    by = ["coll", "version"]
    chain = roms.join(games.select(*by, "game", "parent_name", "is_bios", "is_device", "is_mechanical"), [*by, "game"]).join(versions.select(*by, "is_active"), by)
    return chain.join(collections.select("coll", "name", "node_path"), "coll")


def rename(collections: DataFrame, old: str, new: str) -> DataFrame:
    """A path that equals the name follows it."""
    here = F.col("name") == old
    return collections.withColumns({"node_path": F.when(here & (F.col("node_path") == old), new).otherwise(F.col("node_path")), "name": F.when(here, new).otherwise(F.col("name"))})


def nest_under_name(collections: DataFrame, names: list[str]) -> DataFrame:
    return collections.withColumn("node_path", F.when(F.col("name").isin(names), F.concat_ws("/", "node_path", "name")).otherwise(F.col("node_path")))


def sort_into_folders(collections: DataFrame) -> DataFrame:
    return collections.withColumn("node_path", scalars.sort_path(F.col("name")))


def relink(names: DataFrame, found: DataFrame) -> DataFrame:
    """For each name: the one path with that file name, or whether there are none or several."""
    by_name = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path").groupBy("file").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("relinked")
    return names.join(by_name, "file", "left").select("file", state.alias("state"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def repair_names(collections: DataFrame, parsed: DataFrame) -> DataFrame:
    """Names as the manifests have them (coll, parsed); a change to a name that is taken is a conflict."""
    met = collections.join(parsed, "coll", "left").withColumn("wanted", F.coalesce("parsed", "name"))
    taken = F.count("*").over(Window.partitionBy("wanted"))
    return met.withColumn("state", F.when(F.col("wanted") == F.col("name"), "same").when(taken > 1, "conflict").otherwise("renamed")).drop("parsed")
