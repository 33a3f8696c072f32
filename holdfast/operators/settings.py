"""Settings in force for each collection: where it goes, in which format, how its sets are merged."""

from __future__ import annotations

import tomllib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scalars

# Further settings of a collection, as they are written, and what counts where one is not.
EXTRA = "one_g_one_r boolean, region_priority array<string>, exclude_modified boolean, exclude_bad_dumps boolean, exclude_prereleases boolean, prefer_verified boolean"
DEFAULTS = {"one_g_one_r": False, "region_priority": [], "exclude_modified": True, "exclude_bad_dumps": True, "exclude_prereleases": False, "prefer_verified": True}
# The words for yes and no, and the names of formats and modes.
YES, NO = ("on", "true", "yes", "1", "enable"), ("off", "false", "no", "0", "disable")
FORMATS, MODES = ("loose", "zip", "torrentzip", "7z"), ("non-merged", "merged", "split")
KEYS = {"dest_path": "dest_path", "output_format": "output_format", "merge_mode": "merge_mode", "1g1r": "one_g_one_r", "regions": "region_priority", "exclude_prereleases": "exclude_prereleases"}


def effective(collections: DataFrame, config: DataFrame, output_format: str = "torrentzip", merge_mode: str = "non-merged") -> DataFrame:
    """The collection's own row counts first, then its set's, if its path lies in a set; a value that is not known is the default."""
    own = config.select(F.col("path_pattern").alias("name"), "dest_path", F.col("output_format").alias("_format"), F.col("merge_mode").alias("_mode"))
    of_set = config.select(F.col("path_pattern").alias("_set"), F.col("output_format").alias("_set_format"), F.col("merge_mode").alias("_set_mode"))
    named = collections.withColumn("_set", F.when(F.contains("node_path", F.lit("/")), scalars.top_segment(F.col("node_path"))))
    met = named.join(own, "name", "left").join(of_set, "_set", "left")
    return met.select(
        *collections.columns, "dest_path", scalars.output_format(F.coalesce("_format", "_set_format"), output_format).alias("output_format"), scalars.merge_mode(F.coalesce("_mode", "_set_mode"), merge_mode).alias("merge_mode")
    )


def destinations(settings: DataFrame, library: str | None) -> DataFrame:
    """With root: the explicit destination as it is, else the collection's path in the library; null without either."""
    return settings.withColumn("root", scalars.dest_root(F.col("dest_path"), F.lit(library).cast("string"), F.col("node_path")))


def disk_only(versions: DataFrame, roms: DataFrame) -> DataFrame:
    """coll, version and whether all that a version asks for, if anything, is disks."""
    per = roms.groupBy("coll", "version").agg(F.every("is_disk").alias("_all"))
    return versions.select("coll", "version").join(per, ["coll", "version"], "left").select("coll", "version", F.coalesce("_all", F.lit(False)).alias("disk_only"))


def collisions(placed: DataFrame) -> DataFrame:
    """Roots that more than one collection of a kind (disks alone, or not) would be written to, with their names."""
    groups = placed.where("root is not null").groupBy("root", "disk_only").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return groups.where("n > 1")


class Defaults(NamedTuple):
    """What holds for collections without settings of their own."""

    default_dest_path: str | None = None
    default_output_format: str = "torrentzip"
    default_merge_mode: str = "non-merged"
    data_dir: str | None = None


def defaults(text: str) -> Defaults:
    """Defaults as a TOML text states them; other keys are left alone, a format or mode that is not known is an error."""
    found = {k: v for k, v in tomllib.loads(text).items() if k in Defaults._fields}
    made = Defaults(**found)
    if made.default_output_format not in FORMATS or made.default_merge_mode not in MODES:
        raise ValueError(f"no such format or mode: {made.default_output_format}, {made.default_merge_mode}")
    return made


def extra(config_json: Column) -> Column:
    """The further settings that a JSON text states; the defaults for those it does not, or where it is no JSON."""
    found = F.from_json(config_json, EXTRA)
    default = {k: F.array().cast("array<string>") if isinstance(v, list) else F.lit(v) for k, v in DEFAULTS.items()}
    return F.struct(*(F.coalesce(found[k], default[k]).alias(k) for k in DEFAULTS))


def preferences(collections: DataFrame, config: DataFrame) -> DataFrame:
    """coll, name and what a collection prefers: its own row counts, else the defaults. No regions mean all, in the usual order; parents are always preferred."""
    own = config.select(F.col("path_pattern").alias("name"), "config_json")
    met = collections.select("coll", "name").join(own, "name", "left").select("coll", "name", extra(F.col("config_json")).alias("e")).select("coll", "name", "e.*")
    usual = F.array(*[F.lit(r) for r in names.REGIONS])
    return met.withColumns({"region_priority": F.when(F.size("region_priority") > 0, F.col("region_priority")).otherwise(usual), "prefer_parent": F.lit(True)})


def judged(changes: DataFrame) -> DataFrame:
    """changes (path_pattern, key, value) with the error of each that is refused; null for good ones."""
    low, key = F.lower("value"), F.col("key")
    switch = F.when(~low.isin(*YES, *NO), F.concat(F.lit("invalid "), key, F.lit(": "), "value"))
    plain = F.when(low.isin("enable", "disable"), F.concat(F.lit("invalid "), key, F.lit(": "), "value"))
    of_list = lambda values: F.when(~low.isin(*values), F.concat(F.lit("invalid "), key, F.lit(": "), "value"))
    regions = F.when(F.size(_regions(F.col("value"))) == 0, "at least one region is required")
    error = F.when(~key.isin(*KEYS), F.concat(F.lit("unknown key: "), key)).when(key == "output_format", of_list(FORMATS)).when(key == "merge_mode", of_list(MODES))
    return changes.withColumn("error", error.when(key == "1g1r", switch).when(key == "exclude_prereleases", F.coalesce(plain, switch)).when(key == "regions", regions))


def _regions(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda r: F.trim(r)), lambda r: r != "")


def changed(config: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """config (path_pattern, dest_path, output_format, merge_mode, config_json) after all good changes; of several to one setting the last by `order`.

    A pattern without a row gains one. What a change does not name stays: the JSON is read, merged and written again, with
    the defaults of what it did not state; it stays as it is where no further setting changes.
    """
    good = judged(changes).where("error is null")
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col(order))).alias(f"to_{KEYS[k]}")
    wanted = good.groupBy("path_pattern").agg(*(last(k) for k in KEYS))
    met = config.select("path_pattern", "dest_path", "output_format", "merge_mode", "config_json").join(wanted, "path_pattern", "full")
    on = lambda c: F.lower(c).isin(*YES)
    old = extra(F.col("config_json"))
    new = {k: old[k] for k in DEFAULTS}
    new |= {k: F.coalesce(on(f"to_{k}"), old[k]) for k in ("one_g_one_r", "exclude_prereleases")}
    new["region_priority"] = F.coalesce(_regions(F.col("to_region_priority")), old["region_priority"])
    touched = F.coalesce("to_one_g_one_r", "to_region_priority", "to_exclude_prereleases").isNotNull()
    merged = F.to_json(F.struct(*(c.alias(k) for k, c in new.items())))
    plain = [F.coalesce(f"to_{k}", k).alias(k) for k in ("dest_path", "output_format", "merge_mode")]
    return met.select("path_pattern", *plain, F.when(touched, merged).otherwise(F.col("config_json")).alias("config_json"))
