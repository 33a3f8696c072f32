"""Reports over files, sources, quarantine and exports, and checks of the catalogue."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..snapshots import numbered


def files_per_source(sources: DataFrame, locations: DataFrame) -> DataFrame:
    n = locations.groupBy("source").agg(F.count_distinct("sha1").alias("files"))
    return sources.select("source", "path").join(n, "source", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def overall(files: DataFrame, sources: DataFrame, quarantine: DataFrame) -> DataFrame:
    one = lambda df, *aggs: df.agg(*aggs)
    f = one(files, F.count("*").alias("files"))
    s = one(sources, F.count("*").alias("sources"))
    q = one(quarantine, F.count("*").alias("quarantined"), F.coalesce(F.sum("size"), F.lit(0)).alias("quarantined_bytes"))
    row = lambda df: df.withColumn("_k", F.lit(1))
    return row(f).join(row(s), "_k").join(row(q), "_k").drop("_k")


def quarantine_by(quarantine: DataFrame, column: str) -> DataFrame:
    return quarantine.groupBy(column).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def unknown_by_source(unknown: DataFrame) -> DataFrame:
    return unknown.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def export(roms: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """Every entry with the first place that holds its SHA-1, if any does."""
    at = locations.join(sources.select("source", F.col("path").alias("root")), "source").select("sha1", F.concat_ws("/", "root", "path").alias("at"))
    first = at.groupBy("sha1").agg(F.min("at").alias("held_at"))
    return roms.select("coll", "game", "rom", "size", "sha1").join(first, "sha1", "left").withColumn("have", F.col("held_at").isNotNull())


def exported(rows: DataFrame, only: str | None = None) -> DataFrame:
    """All rows of an export, or only those that are there (have) or not (missing)."""
    if only not in (None, "have", "missing"):
        raise ValueError(f"an export is of all, have or missing, not {only}")
    return rows if only is None else rows.where(F.col("have") == (only == "have"))


def export_kind(kind: str | None, path: str) -> str:
    """The kind that is asked for, else that of the file's name, else txt."""
    asked = kind or path.rpartition(".")[2].lower() if kind or "." in path else "txt"
    return asked if kind or asked in ("csv", "json") else "txt"


#: What each listing is ordered by.
LISTINGS = {
    "collections": ["name"], "sources": ["path"], "config": ["path_pattern"], "games": ["game"], "roms": ["rom"], "entries": ["game", "rom"],
    "versions": ["-imported_seq"], "quarantine": ["-quarantined_seq"],
}


def listing(rows: DataFrame, kind: str, within: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """rows with their place in a listing (from 0, over all rows): by `within` first, then as the kind is ordered, then by `ties`."""
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in LISTINGS[kind]]
    return numbered(rows, [*within, *order, *ties], "place")


#: What single rows of each relation are asked for by.
LOOKUPS = {
    "collections": ["name"], "versions": ["coll", "version"], "games": ["coll", "version", "game"], "roms": ["sha1"], "files": ["sha1"], "sources": ["path"],
    "quarantine": ["sha1"], "config": ["path_pattern"],
}


def lookup(rows: DataFrame, kind: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the wanted ones (columns of LOOKUPS), however many these are; a null key finds nothing."""
    return rows.join(wanted.select(*LOOKUPS[kind]).distinct(), LOOKUPS[kind], "left_semi")


def head(rows: DataFrame, order: list, n: int = 20) -> tuple[DataFrame, int]:
    """The first n rows, as a display shows them, and how many more there are."""
    return rows.orderBy(*order).limit(n), max(0, rows.count() - n)


def write_export(rows: DataFrame, path: str, kind: str) -> None:
    """Export as csv, json or txt files."""
    if kind == "csv":
        rows.write.option("header", True).option("quoteAll", True).csv(path)
    elif kind == "json":
        rows.write.json(path)
    elif kind == "txt":
        rows.select(F.format_string("[%s] %s / %s", F.when(F.col("have"), "x").otherwise(" "), "game", "rom").alias("value")).write.text(path)
    else:
        raise ValueError(f"an export is csv, json or txt, not {kind}")


def resolve_paths(paths: DataFrame, sources: DataFrame, column: str = "path") -> DataFrame:
    """Absolute paths to (source, relative path), by the longest root that is a prefix: ancestors are exploded and met by equality."""
    parts = F.split(F.col(column), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select(F.col(column).alias("full"), F.explode(above).alias("root"))
    met = each.join(sources.select("source", scalars.no_slash(F.col("path")).alias("root")), "root")
    best = met.groupBy("full").agg(F.max_by(F.struct("source", "root"), F.length("root")).alias("b"))
    return best.select("full", "b.source", F.substring(F.col("full"), F.length("b.root") + 2, F.length("full")).alias("relative"))


def prunable_dirs(kept: DataFrame, dirs: DataFrame) -> DataFrame:
    """Folders below which no kept file lies. Names that systems leave behind do not keep a folder."""
    junk = F.element_at(F.split("path", "/"), -1).rlike(r"(?i)^(\._.*|\.ds_store|thumbs\.db|desktop\.ini)$")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    used = kept.where(~junk).where(F.size(parts) > 1).select(F.explode(above).alias("dir")).distinct()
    return dirs.join(used, "dir", "left_anti")


def orphans(games: DataFrame, versions: DataFrame) -> DataFrame:
    return games.join(versions.select("coll", "version"), ["coll", "version"], "left_anti")


def doctor(collections: DataFrame, versions: DataFrame, games: DataFrame, roms: DataFrame, files: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each check: its name and how many rows are at fault."""
    by = ["coll", "version"]
    active = versions.groupBy("coll").agg(F.count_if("is_active").alias("n"))
    checks = {
        "no_active_version": active.where("n = 0"),
        "several_active_versions": active.where("n > 1"),
        "games_without_version": orphans(games, versions),
        "roms_without_game": roms.join(games.select(*by, "game"), [*by, "game"], "left_anti"),
        "places_without_content": locations.join(files.select("sha1"), "sha1", "left_anti"),
        "places_without_source": locations.join(sources.select("source"), "source", "left_anti"),
        "shared_destinations": collections.groupBy("node_path").agg(F.count("*").alias("n")).where("n > 1"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
        out = one if out is None else out.union(one)
    return out


class Repaired(NamedTuple):
    collections: DataFrame
    versions: DataFrame
    games: DataFrame
    roms: DataFrame
    fixes: DataFrame


def repair(collections: DataFrame, versions: DataFrame, games: DataFrame, roms: DataFrame, placed: DataFrame) -> Repaired:
    """The relations without the faults that can be mended, and how many rows each fix changed (fix, n).

    Of a collection's versions, none of them active, the newest becomes so. Games without a version go, then entries without
    a game. Collections that share a destination (placed: coll, name, root, disk_only, dest_path) and have none of their own
    are nested below their own names, unless they are so already; those with their own are left to whoever set it.
    """
    newest = versions.groupBy("coll").agg(F.count_if("is_active").alias("n"), F.max_by("version", "imported_seq").alias("newest")).where("n = 0").select("coll", "newest")
    active = versions.join(newest, "coll", "left").withColumn("is_active", F.col("is_active") | F.coalesce(F.col("version") == F.col("newest"), F.lit(False))).drop("newest")
    by = ["coll", "version"]
    kept = games.join(versions.select(*by).distinct(), by, "left_semi")
    owned = roms.join(kept.select(*by, "game").distinct(), [*by, "game"], "left_semi")
    crowded = placed.where("root is not null").groupBy("root", "disk_only").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    moved = placed.where("dest_path is null").join(crowded, ["root", "disk_only"], "left_semi").select("coll", F.lit(True).alias("moved")).distinct()
    nested = F.concat_ws("/", "node_path", "name")
    fits = F.coalesce("moved", F.lit(False)) & (F.element_at(F.split("node_path", "/"), -1) != F.col("name"))
    spread = collections.join(moved, "coll", "left").withColumn("node_path", F.when(fits, nested).otherwise(F.col("node_path"))).drop("moved")
    gone = lambda before, after, key: before.join(after.select(*key).distinct(), key, "left_anti")
    changed = {
        "activated": newest, "games removed": gone(games, kept, [*by, "game"]), "entries removed": gone(roms, owned, [*by, "game"]),
        "nested": collections.select("coll", "node_path").subtract(spread.select("coll", "node_path")),
    }
    fixes = None
    for name, rows in changed.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fix"), "n")
        fixes = one if fixes is None else fixes.union(one)
    return Repaired(spread, active, kept, owned, fixes)


def write_lines(lines: DataFrame, path: str, order: list, text: str = "line") -> None:
    """A text report, a line for each row in order: files of the folder in the order of their names, each in order itself."""
    lines.orderBy(*order).select(F.col(text).alias("value")).write.text(path)


def unknown_lines(unknown: DataFrame, sources: DataFrame) -> DataFrame:
    """The full path of each unknown file, to be written in order of these."""
    at = unknown.join(sources.select("source", scalars.no_slash(F.col("path")).alias("root")), "source")
    return at.select(F.concat_ws("/", "root", "path").alias("line"))


def skipped_lines(states: DataFrame, state: str) -> DataFrame:
    """The names of collections that a plan left out for a reason."""
    return states.where(F.col("state") == state).select(F.col("name").alias("line"))
