"""Completeness of collections under the three merge modes, and its rollups.

Requirements are rows (coll, owner, status, key, size); every mode is a relational rewrite of the entry list:
non-merged asks each game for its own entries; split drops a clone's merge-tagged entries (after counting its nodumps);
merged asks parents for their own entries and their clones', each key once beyond the parent's own, and drops clones.
Game options apply to owners only, so an excluded clone still contributes to its parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..snapshots import snapshot
from .matching import held_keys, required_key

ENTRY = ["coll", "version"]


def owners(games: DataFrame, mode: str, mechanical: bool = False, bios: bool = True, devices: bool = True) -> DataFrame:
    own = games
    for wanted, flag in ((mechanical, "is_mechanical"), (bios, "is_bios"), (devices, "is_device")):
        own = own if wanted else own.where(~F.col(flag))
    return own.where("parent_name is null") if mode == "merged" else own


def requirements(games: DataFrame, roms: DataFrame, mode: str = "non-merged", **options) -> DataFrame:
    """coll, version, owner, status, key, size; nodump rows have no key, rows without a hash are left out."""
    own = owners(games, mode, **options).select(*ENTRY, F.col("game").alias("owner"), F.col("parent_name").isNotNull().alias("_clone"))
    keyed = roms.select(*ENTRY, "game", "rom", "status", "merge_tag", F.greatest("size", F.lit(0)).alias("size"), F.when(F.col("status") != "nodump", required_key()).alias("key"))
    keyed = keyed.where("key is not null or status = 'nodump'")
    mine = keyed.withColumnRenamed("game", "owner").join(own, [*ENTRY, "owner"])
    if mode == "split":
        mine = mine.where("status = 'nodump' or not _clone or merge_tag is null")
    out = mine.select(*ENTRY, "owner", "status", "key", "size")
    if mode == "merged":
        clones = games.where("parent_name is not null").select(*ENTRY, "game", F.col("parent_name").alias("owner")).join(own, [*ENTRY, "owner"], "left_semi")
        out = out.union(keyed.join(clones, [*ENTRY, "game"]).select(*ENTRY, "owner", "status", "key", "size"))
    return out


def _met(need: DataFrame, files: DataFrame) -> DataFrame:
    """coll, version, owner, key, held, n, nodump: the requirements of each owner by key, and whether a file holds it."""
    met = need.join(held_keys(files).withColumnRenamed("key", "_held"), F.col("key") == F.col("_held"), "left")
    return met.groupBy(*ENTRY, "owner", "key", F.col("_held").isNotNull().alias("held")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "nodump").alias("nodump"))


def _per_game(met: DataFrame, own: DataFrame) -> DataFrame:
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    counts = met.groupBy(*ENTRY, "owner").agg(total(F.when(F.col("key").isNotNull(), F.col("n")), "need"), total(F.when(F.col("held"), F.col("n")), "have"), total("nodump", "nodump"))
    own = own.select(*ENTRY, F.col("game").alias("owner"), "is_bios", "is_device")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("need", "have", "nodump")}
    met = own.join(counts, [*ENTRY, "owner"], "left").withColumns(zero)
    return met.withColumn("state", F.when(F.col("need") == F.col("have"), "complete").when(F.col("have") > 0, "partial").otherwise("missing"))


def per_game(games: DataFrame, roms: DataFrame, files: DataFrame, mode: str = "non-merged", **options) -> DataFrame:
    """A row for each owner: need, have, nodump, state; an owner without requirements is complete."""
    return _per_game(_met(requirements(games, roms, mode, **options), files), owners(games, mode, **options))


def stats(games: DataFrame, roms: DataFrame, files: DataFrame, mode: str = "non-merged", **options) -> DataFrame:
    """A row for each collection and version: games by state, distinct keys needed and held, nodumps, bytes.

    Requirements meet what is held once; the result, a row for each owner and key, is written and grouped both ways.
    """
    both = snapshot(_met(requirements(games, roms, mode, **options), files))
    per = _per_game(both, owners(games, mode, **options)).groupBy(*ENTRY).agg(
        F.count("*").alias("total_games"),
        *[F.count_if(F.col("state") == s).alias(f"{s}_games") for s in ("complete", "partial", "missing")],
        F.sum("nodump").cast("long").alias("nodump_roms"),
        F.count_if("is_bios").alias("bios_sets"),
        F.count_if("is_device").alias("device_sets"),
    )
    sizes = roms.select(*ENTRY, required_key().alias("key"), "size", "game", "rom").where("key is not null")
    sizes = sizes.groupBy(*ENTRY, "key").agg(F.greatest(F.min_by("size", F.struct("game", "rom")), F.lit(0)).alias("bytes"))
    keys = both.where("key is not null").groupBy(*ENTRY, "key").agg(F.max("held").alias("held"))
    unique = keys.join(sizes, [*ENTRY, "key"], "left").groupBy(*ENTRY).agg(
        F.count("*").alias("total_roms"), F.count_if("held").alias("have_roms"), F.sum("bytes").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("held"), F.col("bytes"))), F.lit(0)).alias("have_bytes")
    )
    numbers = ("total_roms", "have_roms", "total_bytes", "have_bytes")
    return per.join(unique, ENTRY, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})


def status(collections: DataFrame, versions: DataFrame, games: DataFrame, roms: DataFrame, files: DataFrame, mode: str = "non-merged") -> DataFrame:
    """A row for each collection, with zeros and no version where none is active; percent is have / total * 100."""
    active = versions.where("is_active").select("coll", "version")
    pick = lambda df: df.join(active, ENTRY, "left_semi")
    found = stats(pick(games), pick(roms), files, mode)
    numbers = [c for c in found.columns if c not in ENTRY]
    out = collections.select("coll", "name", "node_path").join(active, "coll", "left").join(found, ENTRY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return out.withColumn("percent", F.when(F.col("total_roms") > 0, F.col("have_roms") / F.col("total_roms") * 100).otherwise(F.lit(0.0)))


def rollup(status_rows: DataFrame, by: str) -> DataFrame:
    """Sums of status rows by `system` (the name before ' - ') or `set` (the path's top segment); percent is floored."""
    group = scalars.system_of(F.col("name")) if by == "system" else scalars.top_segment(F.col("node_path"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("total_games", "complete_games", "total_roms", "have_roms")]
    out = status_rows.groupBy(group.alias("grp")).agg(F.count("*").alias("collections"), *sums)
    return out.withColumn("percent", F.expr("case when total_roms > 0 then have_roms * 100 div total_roms else 0 end").cast("long"))


def tree(status_rows: DataFrame) -> DataFrame:
    """Sums for every ancestor of every library path, the path itself included."""
    parts = F.split("node_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("total_games", "complete_games", "total_roms", "have_roms")]
    return status_rows.withColumn("node", F.explode(above)).groupBy("node").agg(F.count("*").alias("leaves"), *sums)


def library_tree(collections: DataFrame, status_rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Every folder of the library with what lies below it: leaves, active_leaves, resolved, games, have, missing, to_write, bytes, percent.

    collections: coll, name, node_path (the name where it is null), has_active. status_rows may lack collections; percent is
    null while fewer are resolved than active, or none is active. plan_rows: name, to_write, bytes of the pending plan.
    """
    parts = F.filter(F.split(F.coalesce("node_path", "name"), "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = status_rows.select("coll", F.lit(1).alias("resolved"), F.col("total_games").alias("games"), F.col("have_roms").alias("have"), (F.col("total_roms") - F.col("have_roms")).alias("missing"))
    plan = plan_rows.groupBy("name").agg(F.sum("to_write").alias("to_write"), F.sum("bytes").alias("bytes"))
    met = collections.join(known, "coll", "left").join(plan, "name", "left").withColumn("node", F.explode(above))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    per = met.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("has_active").alias("active_leaves"), *(total(c) for c in ("resolved", "games", "have", "missing", "to_write", "bytes")))
    all_roms = F.col("have") + F.col("missing")
    share = F.when(all_roms > 0, F.col("have") * 100.0 / all_roms).otherwise(F.lit(0.0))
    return per.withColumn("percent", F.when((F.col("active_leaves") > 0) & (F.col("resolved") >= F.col("active_leaves")), share))
