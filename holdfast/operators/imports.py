"""Import of manifests into versions, and registration of sources.

Manifests are judged together: a row for each, with `state` added, skipped (the version is there already, or an earlier
file of the import brings it) or failed (with `error`). Applying an import gives new snapshots of the relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def judge(headers: DataFrame, collections: DataFrame, versions: DataFrame, today: str, upgrade: bool = False) -> DataFrame:
    """path, name, version, node_path, state and error of each manifest (path, name, version, under, error).

    A manifest without a version has that of today; its library path is its folder, else its name. An upgrade asks for a
    collection that is there, and puts it at its name again.
    """
    known = collections.select("coll", "name").join(versions.select("coll", "version"), "coll").select("name", "version", F.lit(True).alias("known")).distinct()
    named = headers.withColumn("version", F.coalesce("version", F.lit(today)))
    named = named.join(collections.select("name", F.lit(True).alias("has_coll")).distinct(), "name", "left").join(known, ["name", "version"], "left")
    bad = F.coalesce("error", F.when(F.col("name").isNull(), "no name"))
    bad = F.coalesce(bad, F.when(F.col("has_coll").isNull(), "no such collection")) if upgrade else bad
    named = named.withColumn("error", bad)
    good = Window.partitionBy("name", "version", F.col("error").isNull()).orderBy("path")
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("known") | (F.row_number().over(good) > 1), "skipped").otherwise("added")
    node = F.col("name") if upgrade else F.coalesce("under", "name")
    return named.select("path", "name", "version", node.alias("node_path"), state.alias("state"), "error")


def report(judged: DataFrame) -> DataFrame:
    return judged.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def apply(judged: DataFrame, collections: DataFrame, versions: DataFrame, games: DataFrame, roms: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """collections (coll, name, node_path), versions, games and roms with what the added manifests bring.

    A new collection is known by its name. Of a collection's added versions the last by path is active, all others lose
    their mark. A game that is listed again keeps what its first listing said of it, and gains the entries that are new by
    name; of entries of one name the first counts. Places in a file are told by `ordinal`; a row without rom is a game alone.
    """
    added = judged.where("state = 'added'").join(collections.select("name", "coll"), "name", "left").withColumn("coll", F.coalesce("coll", "name"))
    fresh = added.join(collections.select("coll"), "coll", "left_anti").groupBy("coll", "name").agg(F.max_by("node_path", "path").alias("node_path"))
    last = added.groupBy("coll").agg(F.max_by("version", "path").alias("last"))
    most = F.coalesce(F.max("imported_seq"), F.lit(0)).cast("long")
    base = versions.agg(most.alias("base"))
    seq = F.row_number().over(Window.partitionBy("coll").orderBy("path"))
    new = added.withColumn("nth", seq).crossJoin(F.broadcast(base)).select("coll", "version", F.lit(False).alias("is_active"), (F.col("base") + F.col("nth")).cast("long").alias("imported_seq"))  # one row
    both = versions.select("coll", "version", "is_active", F.col("imported_seq").cast("long").alias("imported_seq")).unionByName(new).join(last, "coll", "left")
    both = both.withColumn("is_active", F.when(F.col("last").isNull(), F.col("is_active")).otherwise(F.col("version") == F.col("last"))).drop("last")
    own = entries.join(added.select("path", "coll", "version"), "path").drop("path")
    first = lambda *names: F.min_by(F.struct(*names), "ordinal").alias("first")
    found = own.groupBy("coll", "version", "game").agg(first("description", "parent_name", "is_bios", "is_device", "is_mechanical")).select("coll", "version", "game", "first.*")
    parts = own.where("rom is not null").groupBy("coll", "version", "game", "rom").agg(first("size", "sha1", "md5", "crc32", "status", "merge_tag", "is_disk")).select("coll", "version", "game", "rom", "first.*")
    return collections.select("coll", "name", "node_path").unionByName(fresh), both, games.unionByName(found, allowMissingColumns=True), roms.unionByName(parts, allowMissingColumns=True)


def register(sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """Sources (source, path, wanted) with path, disposition and whether they are refused.

    A source at or below a destination is preserved, any other consumed, unless something else is wanted; one below a
    destination is refused if it is to be consumed. Ancestors of a path meet destinations by equality.
    """
    own = sources.withColumn("path", F.when(scalars.no_slash(F.col("path")) == "", "/").otherwise(scalars.no_slash(F.col("path"))))
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    inside = own.select("source", above.alias("root")).join(destinations.select(scalars.no_slash(F.col("path")).alias("root")).distinct(), "root", "left_semi").select("source", F.lit(True).alias("inside")).distinct()
    met = own.join(inside, "source", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    disposition = F.coalesce("wanted", F.when(F.col("inside"), "preserve").otherwise("consume"))
    return met.select("source", "path", disposition.alias("disposition"), (F.col("inside") & (disposition == "consume")).alias("refused"))


def below(locations: DataFrame, folder: str) -> DataFrame:
    """The places of a scan that is bounded to a folder of its source; a path that leaves the source is refused."""
    steps = [s for s in folder.split("/") if s not in ("", ".")]
    if folder.startswith("/") or ".." in steps:
        raise ValueError(f"a folder inside the source is wanted, not {folder}")
    return locations.where(scalars.under(F.col("path"), F.lit("/".join(steps)))) if steps else locations
