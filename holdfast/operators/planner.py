"""The operation planner: what to copy, move, pack, relocate and delete so that the library is as its manifests want it.

All collections are planned together, each step as one relation. Input is `held`: entries and the places that hold their
contents, and `goals`: a row for each collection to plan (coll, name, node_path, dest_root, format). Entries and places stay
apart: a content that n entries ask for and that lies in n places has n * n pairs. Steps use what is known of a content's
places from aggregates, the places at one path, or, where every place gets an operation, those of contents that are not
shared between games.

Operations have coll, kind (copy, move, repack, relocate, delete, drain), source, archive_path, dest, size and reason. Of
several places that would do, the least by (root, path, entry) is taken, so a plan depends on no order of rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import snapshots
from ..functions import scalars
from .matching import GUARD, PER_CONTENT, SAFE_ROWS, large

OPERATION = ["coll", "kind", "source", "archive_path", "dest", "size", "reason"]
GAME = ["coll", "game"]
ENTRY = ["coll", "game", "rom", "is_disk", "sha1", "size"]
PLACE = ["root", "disposition", "path", "archive_path"]


def may_leave(disposition: Column, root: Column, dest: Column) -> Column:
    """A file may be moved, or deleted as redundant, if its source is consumed or the copy that stays lies in its own tree."""
    return F.coalesce(disposition == "consume", F.lit(False)) | scalars.under(dest, root)


def in_library(path: Column, dest_root: Column, library: str | None) -> Column:
    """Whether the path is a placement: files below a destination are never removed as duplicates."""
    here = scalars.under(path, dest_root)
    return here if library is None else here | scalars.under(path, F.lit(library))


def kept_reason(dest: Column) -> Column:
    return F.concat(F.lit("exact duplicate — kept "), dest)


def quarantine_name(sha1: Column, path: Column) -> Column:
    return F.concat(sha1, F.lit("_"), F.element_at(F.split(path, "/"), -1))


def volume(path: Column) -> Column:
    """/Volumes/<name> for a mounted volume, else /."""
    name = F.regexp_extract(path, "^/*Volumes/([^/]+)", 1)
    return F.when(name != "", F.concat(F.lit("/Volumes/"), name)).otherwise(F.lit("/"))


class Held(NamedTuple):
    """entries: coll, game, rom, is_disk, sha1, size, of. places: of, root, disposition, path, archive_path. An entry is held at every place of the same `of`."""

    entries: DataFrame
    places: DataFrame


def held_at(entries: DataFrame, places: DataFrame) -> Held:
    """Entries and places, each given once, that meet by sha1."""
    of = F.col("sha1").alias("of")
    return Held(entries.select(*ENTRY, of), places.select(of, *PLACE))


def wanted(held: Held | DataFrame, goals: DataFrame, shared: DataFrame) -> Held:
    """Of entries that are held, those of collections to plan, with dest_root, format and whether the content is shared between games; places with `at`, their path.

    Pairs of entry and place in one relation are taken apart.
    """
    entries, places = held_at(held.select(*ENTRY).distinct(), held.select("sha1", *PLACE).distinct()) if isinstance(held, DataFrame) else held
    met = entries.join(F.broadcast(goals.select("coll", scalars.no_slash(F.col("dest_root")).alias("dest_root"), "format")), "coll")  # a row for each collection
    met = met.join(large(places.select("of")), "of", "left_semi")
    met = met.join(shared.select("sha1").distinct().withColumn("is_shared", F.lit(True)).hint("merge"), "sha1", "left")
    return Held(met.withColumn("is_shared", F.coalesce("is_shared", F.lit(False))), places.withColumn("at", F.concat_ws("/", "root", "path")))


def shared_containers(held: Held) -> DataFrame:
    """at: the archives whose entries serve more than one game. A content's first and last game stand for all of its games."""
    game = F.struct(*GAME)
    per = held.entries.groupBy("of").agg(F.min(game).alias("first"), F.max(game).alias("last"))
    inside = held.places.where("archive_path is not null").select("of", F.concat_ws("/", "root", "path").alias("at")).join(large(per), "of")
    return inside.groupBy("at").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last").select("at")


def entries_per_game(rows: DataFrame) -> DataFrame:
    """How many different entries of a game are held; a game of several gets a folder of its own."""
    return rows.groupBy(*GAME).agg(F.count_distinct("rom").alias("entries"))


def with_dest(entries: DataFrame) -> DataFrame:
    """Loose entries and disks with the path each belongs at; a disk lies in its game's folder whatever the format."""
    loose = entries.where("not is_disk and format = 'loose'")
    flat = loose.join(large(entries_per_game(loose)), GAME)
    flat = flat.withColumn("dest", scalars.dest_path(F.col("dest_root"), F.col("game"), F.col("rom"), F.col("entries") > 1)).drop("entries")
    disks = entries.where("is_disk").withColumn("dest", F.concat(F.concat_ws("/", "dest_root", "game", "rom"), F.lit(".chd")))
    return flat.unionByName(disks)


def packed(entries: DataFrame) -> DataFrame:
    """Entries that belong in archives."""
    return entries.where("not is_disk and format <> 'loose'")


def _inside() -> Column:
    return F.coalesce("archive_path", F.lit("")).alias("entry")


def _place_order() -> Column:
    return F.struct("game", "rom", "root", "path", _inside(), "sha1")


def _kept(each: DataFrame, places: DataFrame) -> DataFrame:
    """For each destination the place to keep: one that is there already, else the first; and whether a content is shared.

    A content's first place is the first for each of its entries, so no other one meets them.
    """
    least = F.struct("root", "path", _inside(), "archive_path", "disposition", "at")
    first = each.join(large(places.groupBy("of").agg(F.min(least).alias("p"))), "of").select(*each.columns, "p.*", F.lit(True).alias("away"))
    here = each.join(large(places.where("archive_path is null").withColumn("dest", F.col("at"))), ["of", "dest"])
    both = first.drop("entry").unionByName(here.withColumn("away", F.lit(False)))
    keep = F.struct("away", _place_order().alias("by"), "at", "archive_path", "root", "disposition", "size")
    return both.groupBy("coll", "dest").agg(F.min(keep).alias("keep"), F.max("is_shared").alias("shared"))


def file_sources(rows: Held) -> DataFrame:
    """coll, dest, path, archive_path and sha1 of what is placed at each destination of a loose entry or disk."""
    return _kept(with_dest(rows.entries), rows.places).where("keep.away").select("coll", "dest", F.col("keep.at").alias("path"), "keep.archive_path", "keep.by.sha1")


def repack_sources(rows: Held, planned: DataFrame) -> DataFrame:
    """coll, dest, path, archive_path, sha1 and entry_name of every place that an archive is built from.

    Those of one complete file if there is one, else all places of the game; the entry is named as its manifest wants it.
    """
    built = packed(rows.entries).join(large(planned.where("action = 'repack'").select(*GAME, "dest", F.col("build_from").alias("at"))), GAME)
    met = built.where("at is null").drop("at").join(large(rows.places), "of").unionByName(_at_one(built, rows.places))
    return met.select("coll", "dest", F.col("at").alias("path"), "archive_path", "sha1", F.col("rom").alias("entry_name")).distinct()


def _at_one(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Entries with their places at the one path `at` that each names."""
    return entries.where("at is not null").join(large(places), ["of", "at"])


def plan_files(rows: Held, library: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Operations on loose entries and disks, and a row for each destination: coll, dest, correct, shared.

    A loose copy at the destination is right. Else the first copy is placed, by a move if its source allows that and its
    content is not shared. Other loose copies go, unless shared, if their source allows it and they are no placement.
    """
    each = with_dest(rows.entries)
    per = _kept(each, rows.places)
    place = per.where("keep.away")
    move = may_leave(F.col("keep.disposition"), F.col("keep.root"), F.col("dest")) & ~F.col("shared")
    put = place.select("coll", F.when(move, "move").otherwise("copy").alias("kind"), F.col("keep.at").alias("source"), "keep.archive_path", "dest", "keep.size", F.lit(None).cast("string").alias("reason"))
    alone = each.where("not is_shared").join(large(per.where("not shared").select("coll", "dest", "keep")), ["coll", "dest"])
    others = alone.join(large(rows.places.where("archive_path is null")), "of").where(_place_order() != F.col("keep.by"))
    others = others.where(may_leave(F.col("disposition"), F.col("root"), F.col("dest")) & (F.col("at") != F.col("dest")) & ~in_library(F.col("at"), F.col("dest_root"), library))
    gone = others.select("coll", F.lit("delete").alias("kind"), F.col("at").alias("source"), F.lit(None).cast("string").alias("archive_path"), "dest", F.lit(0).cast("long").alias("size"), kept_reason(F.col("dest")).alias("reason"))
    return put.select(*OPERATION).unionByName(gone), per.select("coll", "dest", (~F.col("keep.away")).alias("correct"), "shared")


def containers(rows: DataFrame) -> DataFrame:
    """Of pairs of entry and place, for each game and file that holds some of its entries: how many, whether all are archived, their bytes, and the first one."""
    key = F.struct("rom", F.lower("sha1"))
    return rows.groupBy(*GAME, "at").agg(
        F.count_distinct(key).alias("holds"),
        F.every(F.col("archive_path").isNotNull()).alias("archived"),
        F.sum("size").alias("bytes"),
        F.min(F.struct("rom", _inside(), "root", "disposition", "archive_path")).alias("first"),
    )


def relocatable(archived: Column, path: Column, extension: Column) -> Column:
    """A file can be renamed into place if all it holds for the game is archived and its extension is that of the format."""
    return archived & (F.lower(F.element_at(F.split(path, "\\."), -1)) == extension)


def complete_files(entries: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which files hold all entries of a game that are held at all: coll, game and `asks`; and asks and at.

    Games that ask for the same contents have the same complete files, so one game answers for all of them. Only files that
    hold the rarest of its entries are looked at.
    """
    keys = entries.groupBy(*GAME, "rom", F.lower("sha1").alias("low")).agg(F.array_sort(F.collect_set("of")).alias("any"))
    asking = keys.groupBy(*GAME).agg(F.sha2(F.to_json(F.array_sort(F.collect_set("any"))), 256).alias("asks"))
    one = asking.groupBy("asks").agg(F.min(F.struct(*GAME)).alias("g")).select("asks", "g.*")
    own = entries.join(large(one), GAME).select("asks", "rom", F.lower("sha1").alias("low"), "of").distinct()
    counted = own.join(large(places.groupBy("of").agg(F.count(F.lit(1)).alias("n"))), "of").groupBy("asks", "rom", "low").agg(F.sum("n").alias("n"))
    rarest = counted.groupBy("asks").agg(F.min(F.struct("n", "rom", "low")).alias("k"), F.count(F.lit(1)).alias("expected"))
    spots = places.select("of", "at").distinct()
    some = own.join(large(rarest.select("asks", "k.rom", "k.low", "expected")), ["asks", "rom", "low"]).join(large(spots), "of").select("asks", "at", "expected").distinct()
    holds = some.join(large(own), "asks").join(large(spots), ["of", "at"]).groupBy("asks", "at", "expected").agg(F.count_distinct("rom", "low").alias("holds"))
    return asking, holds.where("holds = expected").select("asks", "at")


def games(rows: Held, shared_containers: DataFrame) -> DataFrame:
    """A row for each game that belongs in an archive: what is planned for it.

    A file is complete if it holds all entries of the game that are held at all. The canonical one is that at `dest`, else
    the first complete one by path: `build_from`, null if no file is complete. action is correct, relocate or repack.
    """
    each, places = packed(rows.entries), rows.places
    ext = F.when(F.col("format") == "7z", "7z").otherwise("zip")
    sizes = each.join(large(places.groupBy("of").agg(F.min("at").alias("first_at"))), "of").groupBy(*GAME, "rom").agg(F.min_by("size", F.struct("first_at", "rom", "sha1")).alias("size"), F.count_distinct("sha1").alias("contents"))
    sizes = sizes.groupBy(*GAME).agg(F.sum(F.col("size") * F.col("contents")).alias("bytes"), F.sum("contents").cast("long").alias("entries"))
    per = each.groupBy(*GAME, "dest_root", "format").agg(F.max("is_shared").alias("shared"))
    per = per.withColumn("dest", F.concat(F.concat_ws("/", "dest_root", "game"), F.lit("."), ext)).join(large(sizes), GAME)
    asking, complete = complete_files(each, places)
    complete = snapshots.snapshot(complete)
    met = per.join(large(asking), GAME).join(large(complete.groupBy("asks").agg(F.min("at").alias("first_at"))), "asks", "left")
    met = met.join(large(complete.select("asks", F.col("at").alias("dest"), F.lit(True).alias("right"))), ["asks", "dest"], "left")
    met = snapshots.snapshot(met.withColumn("build_from", F.when(F.col("right"), F.col("dest")).otherwise(F.col("first_at"))).drop("asks", "first_at", "right"))
    meant = each.join(large(met.select(*GAME, "dest", F.col("build_from").alias("at"))), GAME)
    leaves = F.every(may_leave(F.col("disposition"), F.col("root"), F.col("dest"))).alias("all_leave")
    one = _at_one(meant, places)
    fed = one.groupBy(*GAME).agg(leaves, F.count(F.lit(1)).alias("n_sources"))
    roots = places.groupBy("of", "root", "disposition").agg(F.count(F.lit(1)).alias("n"))
    spread = meant.where("at is null").join(large(roots), "of").groupBy(*GAME).agg(leaves, F.sum("n").alias("n_sources"))
    best = containers(one).select(*GAME, "archived", F.col("bytes").alias("own_bytes"), "first")
    met = met.join(large(best), GAME, "left").join(large(fed.unionByName(spread)), GAME).withColumn("away", F.coalesce(F.col("build_from") != F.col("dest"), F.lit(True)))
    met = met.join(shared_containers.select(F.col("at").alias("build_from"), F.lit(True).alias("serves_others")).distinct().hint("merge"), "build_from", "left")
    free = F.col("build_from").isNotNull() & F.col("away") & may_leave(F.col("first.disposition"), F.col("first.root"), F.col("dest"))
    whole = free & ~F.col("shared") & F.col("serves_others").isNull() & (F.col("format") != "torrentzip") & relocatable(F.col("archived"), F.col("build_from"), ext)
    action = F.when(~F.col("away") & (F.col("format") != "torrentzip"), "correct").when(whole, "relocate").otherwise("repack")
    met = met.withColumn("action", action).withColumn("drains", (F.col("action") == "repack") & F.coalesce(free & F.col("first.archive_path").isNotNull(), F.lit(False)))
    moves = (F.col("action") == "repack") & F.col("all_leave") & ~F.col("shared")
    size = F.when(F.col("action") == "relocate", F.col("own_bytes")).when(F.col("action") == "repack", F.col("bytes")).otherwise(F.lit(0)).cast("long")
    return met.select(*GAME, "dest_root", "format", "dest", "build_from", "shared", "action", "entries", size.alias("size"), moves.alias("move_sources"), "drains", "n_sources")


def plan_archives(rows: Held, planned: DataFrame, shared_containers: DataFrame, library: str | None = None) -> DataFrame:
    """Operations on archives: relocations, repacks and the deletion of files whose content stays at the destination.

    A repack has no source of its own where it is built from several files.
    """
    none = F.lit(None).cast("string")
    build = planned.where("action <> 'correct'").select("coll", F.col("action").alias("kind"), F.col("build_from").alias("source"), none.alias("archive_path"), "dest", "size", F.when(F.col("move_sources"), "sources go").alias("reason"))
    alone = packed(rows.entries).where("not is_shared").drop("dest_root").join(large(planned.where("not shared").select(*GAME, "dest_root", "dest", "build_from")), GAME)
    extra = alone.join(large(rows.places), "of").where("at <> dest and not at <=> build_from")
    extra = extra.groupBy(*GAME, "at", "dest_root", "dest").agg(F.min(F.struct("rom", _inside(), "root", "disposition")).alias("first"))
    extra = extra.join(large(shared_containers.select("at").distinct()), "at", "left_anti")
    extra = extra.where(may_leave(F.col("first.disposition"), F.col("first.root"), F.col("dest")) & ~in_library(F.col("at"), F.col("dest_root"), library))
    gone = extra.select("coll", F.lit("delete").alias("kind"), F.col("at").alias("source"), none.alias("archive_path"), "dest", F.lit(0).cast("long").alias("size"), kept_reason(F.col("dest")).alias("reason"))
    return build.unionByName(gone)


def drains(rows: Held, planned: DataFrame, goals: DataFrame) -> DataFrame:
    """Files that repacks were built from and that may go after all of them: container, format, reason, and where each entry went.

    Of an entry that several games took, the first by collection name, game and entry counts. Entries are arrays of one file.
    """
    meant = packed(rows.entries).join(large(planned.where("drains").select(*GAME, "dest", F.col("build_from").alias("at"))), GAME)
    fed = _at_one(meant, rows.places.where("archive_path is not null")).join(F.broadcast(goals.select("coll", "name")), "coll")
    order = F.struct("name", "game", "rom", "sha1", "dest")
    entry = fed.groupBy("at", "archive_path").agg(F.min(order).alias("o"))
    spec = F.struct(F.col("archive_path").alias("container_entry"), F.col("o.rom").alias("dest_entry"), F.col("o.dest").alias("dest"), F.col("o.sha1").alias("sha1"))
    per = entry.groupBy("at").agg(F.array_sort(F.collect_list(spec)).alias("entries"), F.min("o").alias("o"))
    kind = F.when(F.lower("at").endswith(".7z"), "7z").otherwise("zip")
    return per.select(F.col("at").alias("container"), kind.alias("format"), F.concat(F.lit("consolidated into "), "o.dest").alias("reason"), "entries")


def per_collection(goals: DataFrame, files: DataFrame, file_ops: DataFrame, planned: DataFrame) -> DataFrame:
    """A row for each planned collection: what is right, what is to write and how many bytes that is."""
    right = files.groupBy("coll").agg(F.count_if("correct").alias("a"))
    puts = file_ops.where("kind in ('copy', 'move')").groupBy("coll").agg(F.count(F.lit(1)).alias("b"), F.sum("size").alias("c"))
    packs = planned.groupBy("coll").agg(F.sum(F.when(F.col("action") == "correct", F.col("entries"))).alias("d"), F.count_if(F.col("action") == "repack").alias("e"), F.sum("size").alias("f"))
    met = goals.select("coll", "name", "node_path").join(right, "coll", "left").join(puts, "coll", "left").join(packs, "coll", "left")
    total = lambda *cs: sum((F.coalesce(c, F.lit(0)) for c in cs), F.lit(0)).cast("long")
    return met.select("coll", "name", "node_path", total("b", "e").alias("to_write"), total("a", "d").alias("already_correct"), total("c", "f").alias("bytes"))


def pending(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.where("to_write > 0").select("name", "node_path", "to_write", "bytes")


def by_set(plan_rows: DataFrame) -> DataFrame:
    """Pending work by the top segment of the library path."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("to_write", "bytes")]
    return plan_rows.where("to_write > 0").groupBy(scalars.top_segment(F.col("node_path")).alias("grp")).agg(*sums)


def tally(operations: DataFrame) -> DataFrame:
    """Operations and bytes by kind."""
    return operations.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def summary(operations: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """One row of counters; a relocation counts as a move, a drain as a deletion."""
    kinds = {"copies": ["copy"], "moves": ["move", "relocate"], "repacks": ["repack"], "deletes": ["delete", "drain"]}
    ops = operations.agg(*[F.count_if(F.col("kind").isin(k)).alias(n) for n, k in kinds.items()], F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return ops.crossJoin(F.broadcast(plan_rows.agg(F.coalesce(F.sum("already_correct"), F.lit(0)).cast("long").alias("already_correct"))))  # one row each


def space_needed(operations: DataFrame) -> DataFrame:
    """Bytes that each destination volume must have free, with a tenth more; a move within a volume needs none."""
    free = F.col("kind").isin("move", "relocate") & (volume(F.col("source")) == volume(F.col("dest")))
    rows = operations.where(F.col("kind").isin("copy", "move", "relocate", "repack") & ~F.coalesce(free, F.lit(False)) & (F.col("size") > 0))
    per = rows.groupBy(volume(F.col("dest")).alias("volume")).agg(F.sum("size").cast("long").alias("bytes"))
    return per.withColumn("with_margin", (F.col("bytes").cast("double") * 1.1).cast("long"))


def numbered(operations: DataFrame, order: list[str]) -> DataFrame:
    """Operations with their position from 0, drains after all others; sorted by ranges, and counted for each partition."""
    return snapshots.numbered(operations, [F.col("kind") == "drain", *order], "op_id")


def sizes_of_matches(matched: DataFrame, locations: DataFrame, cap: int | None = None) -> DataFrame:
    """How many rows each collection's match grows to, from counts alone; with cap, that many places of a content count at most."""
    places = locations.groupBy("sha1").agg(F.count(F.lit(1)).alias("places"))
    n = F.col("places") if cap is None else F.least("places", F.lit(cap))
    per = matched.groupBy("coll", "sha1").agg(F.count(F.lit(1)).alias("entries")).join(large(places), "sha1")
    return per.groupBy("coll").agg(F.sum(F.col("entries") * n).cast("long").alias("n_rows"))


def gate(goals: DataFrame, active: DataFrame, roms: DataFrame, matched: DataFrame, locations: DataFrame, names: str | None = None, sets: list[str] | None = None, guard: int | None = GUARD, most: int = SAFE_ROWS, cap: int = PER_CONTENT) -> DataFrame:
    """Why each collection is planned or not: coll, name, state.

    A collection of fewer than `guard` entries is never too large, nor any without a guard; a larger one is, if its match grows to over `most` rows
    although `cap` places of a content are asked for at most.
    """
    entries = roms.groupBy("coll").agg(F.count(F.lit(1)).alias("entries"))
    met = goals.join(active.select("coll", F.lit(True).alias("has_version")).distinct(), "coll", "left").join(entries, "coll", "left").join(sizes_of_matches(matched, locations, cap), "coll", "left")
    chosen = F.lit(True) if names is None else scalars.matches_glob(F.col("name"), names)
    chosen = chosen if sets is None else chosen & scalars.top_segment(F.col("node_path")).isin(sets)
    state = F.when(F.col("has_version").isNull(), "no active version").when(~chosen, "filtered").when(F.col("dest_root").isNull(), "no destination")
    state = state if guard is None else state.when((F.col("entries") >= guard) & (F.col("n_rows") > most), "oversized")
    return met.select("coll", "name", state.otherwise("planned").alias("state"))


def desired_paths(rows: Held) -> DataFrame:
    """Every path that a planned collection wants to exist."""
    return with_dest(rows.entries).select("dest").union(archive_dest(packed(rows.entries)).select("dest")).distinct()


def archive_dest(entries: DataFrame) -> DataFrame:
    ext = F.when(F.col("format") == "7z", "7z").otherwise("zip")
    return entries.withColumn("dest", F.concat(F.concat_ws("/", "dest_root", "game"), F.lit("."), ext))


def archive_homes(rows: Held) -> DataFrame:
    """sha1 and dest: the archives that each content belongs in."""
    return archive_dest(packed(rows.entries)).select("sha1", "dest").distinct()


def superseded(rows: Held, locations: DataFrame, sources: DataFrame, files: DataFrame, library: str, sets: list[str] | None = None) -> DataFrame:
    """Loose files below the library: path, sha1, size, and whether each can go (`removable`).

    One can if its content lies in the very archive, below the library, that a collection wants it in, and no collection
    wants the loose path. Sets are first segments below the library.
    """
    at = locations.join(F.broadcast(sources.select("source", scalars.no_slash(F.col("path")).alias("root"))), "source").withColumn("at", F.concat_ws("/", "root", "path"))
    loose = at.where(F.col("archive_path").isNull() & scalars.under(F.col("root"), F.lit(library))).select("at", "sha1").join(large(files.select("sha1", "size")), "sha1")
    if sets is not None:
        loose = loose.where(scalars.top_segment(F.substring(F.col("at"), F.lit(len(library.rstrip("/")) + 2), F.length("at"))).isin(sets))
    canonical = at.where(F.col("archive_path").isNotNull() & scalars.under(F.col("at"), F.lit(library)))
    safe = canonical.join(large(archive_homes(rows).withColumnRenamed("dest", "at")), ["sha1", "at"], "left_semi").select("sha1").distinct()
    met = loose.join(large(safe.withColumn("safe", F.lit(True))), "sha1", "left").join(large(desired_paths(rows).select(F.col("dest").alias("at"), F.lit(True).alias("wanted"))), "at", "left")
    return met.select(F.col("at").alias("path"), "sha1", "size", (F.col("safe").isNotNull() & F.col("wanted").isNull()).alias("removable"))


def superseded_totals(found: DataFrame) -> DataFrame:
    """Files and bytes of the loose layer, and of those that can go."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(F.count(F.lit(1)).alias("files"), whole("size").alias("bytes"), F.count_if("removable").alias("removable_files"), whole(F.when(F.col("removable"), F.col("size"))).alias("removable_bytes"))


def placements(operations: DataFrame, entries: DataFrame) -> DataFrame:
    """What completed operations put where: dest, archive_path, sha1. Copies and moves give a loose file, a repack a row for
    each entry (dest, rom, sha1); relocations are left out, as their entries' names are not known."""
    loose = operations.where("kind in ('copy', 'move')").join(entries.select("dest", "sha1").distinct(), "dest").select("dest", F.lit(None).cast("string").alias("archive_path"), "sha1")
    packed = operations.where("kind = 'repack'").select("dest").distinct().join(entries, "dest").select("dest", F.col("rom").alias("archive_path"), "sha1")
    return loose.unionByName(packed).distinct()


def fingerprint(locations: DataFrame, stamp: str = "last_seen") -> DataFrame:
    return locations.agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("last_seen"))


def state_hash(active_ids: DataFrame, locations: DataFrame, config: DataFrame, stamp: str = "last_seen") -> DataFrame:
    """SHA-256 of the active versions' ids, the places' count and last sighting, and every pattern with its destination.

    The arrays hold versions and settings, which are as many as manifests, not as files.
    """
    le = lambda c: scalars.le_bytes(c)
    ids = active_ids.agg(F.array_sort(F.collect_list("id")).alias("ids"))
    seen = fingerprint(locations, stamp)
    rows = config.agg(F.array_sort(F.collect_list(F.struct("path_pattern", F.coalesce("dest_path", F.lit("")).alias("dest_path")))).alias("c"))
    met = ids.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(rows))  # one row each
    text = F.array_join(F.transform("c", lambda x: F.concat(x["path_pattern"], x["dest_path"])), "")
    hexed = F.array_join(F.transform("ids", lambda x: F.hex(le(x))), "")
    raw = F.concat(F.unhex(hexed), le(F.col("n")), F.coalesce(F.col("last_seen"), F.lit("")).cast("binary"), text.cast("binary"))
    return met.select(F.sha2(raw, 256).alias("state_hash"))


def titles(parsed: DataFrame, title: str = "title", name: str = "game") -> DataFrame:
    """Titles of more than one variant, with the variants' names; a title's variants are few."""
    return parsed.groupBy("coll", title).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names")).where("n > 1")
