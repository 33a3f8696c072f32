"""Release names: title, regions, languages, revision and dump flags, and which variant of a title is preferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Region names, in the order of default preference.
REGIONS = (
    "World", "USA", "Europe", "Japan", "Australia", "Canada", "UK", "France", "Germany", "Spain", "Italy", "Netherlands",
    "Sweden", "Brazil", "Korea", "China", "Taiwan", "Hong Kong", "Russia", "Asia", "Scandinavia",
)
#: Two-letter country codes and their regions.
COUNTRY = {
    "US": "USA", "JP": "Japan", "EU": "Europe", "DE": "Germany", "FR": "France", "GB": "UK", "UK": "UK", "ES": "Spain", "IT": "Italy", "BR": "Brazil", "AU": "Australia",
    "CA": "Canada", "CN": "China", "KR": "Korea", "NL": "Netherlands", "SE": "Sweden", "RU": "Russia", "PL": "Poland", "PT": "Portugal", "TW": "Taiwan", "HK": "Hong Kong",
}
#: Language codes, words for unfinished releases, dump flags, and flags of changed dumps.
LANGUAGES = ("En", "Fr", "De", "Es", "It", "Ja", "Pt", "Zh", "Ko", "Nl", "Sv", "Ru", "Pl")
UNFINISHED = ("beta", "proto", "prototype", "demo", "sample", "preview")
FLAGS = ("cr", "f", "h", "m", "p", "t", "tr", "o", "u", "v", "a")
CHANGED = ("cr", "t", "h", "f", "p", "m", "tr", "o", "u", "v")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _groups(name: Column, opens: str, closes: str) -> Column:
    """What stands between outermost brackets, by a fold over the pieces at each bracket; nested ones stay inside."""
    pieces = F.regexp_extract_all(name, F.lit(f"[{opens}{closes}]|[^{opens}{closes}]+"), F.lit(0))
    plain = {"(": "(", "\\[": "["}[opens], {")": ")", "\\]": "]"}[closes]
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        is_open, is_close = p == plain[0], p == plain[1]
        depth = a["depth"] + F.when(is_open, 1).when(is_close, -1).otherwise(0)
        ends = is_close & (depth == 0)
        held = F.when(is_open & (a["depth"] == 0), F.lit("")).otherwise(F.concat(a["held"], p))
        return F.struct(depth.alias("depth"), held.alias("held"), F.when(ends, F.array_append(a["out"], a["held"])).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _known(part: Column) -> Column:
    return F.array_compact(F.array(F.try_element_at(_map((r.lower(), r) for r in REGIONS), F.lower(part))))


def _country(part: Column) -> Column:
    return F.array_compact(F.array(F.try_element_at(_map(COUNTRY.items()), part)))


def _each(parts: Column, to_regions) -> Column:
    return F.flatten(F.transform(parts, to_regions))


def _paren(a: Column, g: Column) -> Column:
    """One group's effect on what is known so far. A list of regions ends the group if any region is known by then."""
    low = F.lower(g)
    exact = _known(g)
    listed = F.when(F.contains(g, F.lit(",")), _each(F.split(g, ","), lambda p: _known(F.trim(p)))).otherwise(F.array().cast("array<string>"))
    after_list = F.concat(a["regions"], listed)
    coded = _country(g)
    dashed = F.contains(g, F.lit("-")) & (F.octet_length(g) <= 8)
    dash = F.when(dashed, _each(F.split(g, "-"), _country)).otherwise(F.array().cast("array<string>"))
    after_dash = F.concat(after_list, dash)
    list_ends = F.contains(g, F.lit(",")) & (F.size(after_list) > 0)
    code_ends = ~list_ends & (F.size(coded) > 0)
    dash_ends = ~list_ends & ~code_ends & dashed & (F.size(after_dash) > 0)
    open_ = (F.size(exact) == 0) & ~list_ends & ~code_ends & ~dash_ends
    language = F.filter(_strings(LANGUAGES), lambda x: F.lower(x) == low)
    spoken = open_ & (F.size(language) > 0)
    revised = open_ & ~spoken & (F.startswith(low, F.lit("rev ")) | F.startswith(low, F.lit("v")))
    regions = F.when(F.size(exact) > 0, F.concat(a["regions"], exact)).when(list_ends, after_list).when(code_ends, F.concat(after_list, coded)).otherwise(after_dash)
    return F.struct(
        regions.alias("regions"),
        F.when(spoken, F.concat(a["languages"], language)).otherwise(a["languages"]).alias("languages"),
        F.when(revised, g).otherwise(a["revision"]).alias("revision"),
        (a["is_prerelease"] | (open_ & ~spoken & ~revised & low.isin(*UNFINISHED))).alias("is_prerelease"),
    )


def with_parsed_name(df: DataFrame, name: str) -> DataFrame:
    """df with title, regions, languages, revision, is_prerelease, verified, bad_dump, flags, is_original and primary_region."""
    n = F.col(name)
    cut = F.when(F.contains(n, F.lit("(")), F.substring_index(n, "(", 1)).otherwise(F.substring_index(n, "[", 1))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("regions"), none.alias("languages"), F.lit(None).cast("string").alias("revision"), F.lit(False).alias("is_prerelease"))
    df = df.withColumns({"title": F.trim(cut), "_p": F.aggregate(_groups(n, "(", ")"), start, _paren), "_b": _groups(n, "\\[", "\\]")})
    is_bad = lambda g: (F.lower(g) == "b") | F.startswith(F.lower(g), F.lit("b "))
    flag = lambda g: F.lower(F.substring_index(g, " ", 1))
    flags = F.transform(F.filter("_b", lambda g: is_bad(g) | flag(g).isin(*FLAGS)), lambda g: F.when(is_bad(g), F.lit("b")).otherwise(flag(g)))
    df = df.select("*", "_p.*").withColumns({"verified": F.exists("_b", lambda g: g == "!"), "bad_dump": F.exists("_b", is_bad), "flags": F.array_sort(F.array_distinct(flags))})
    return df.withColumns({"is_original": ~F.arrays_overlap("flags", _strings(CHANGED)), "primary_region": F.get("regions", F.lit(0))}).drop("_p", "_b")


def region_score(regions: Column, priority: Column | tuple[str, ...] = REGIONS) -> Column:
    """The least place in the priority that a region has, from 0; null if none has one."""
    order = F.transform(priority, F.lower) if isinstance(priority, Column) else _strings([p.lower() for p in priority])
    return F.array_min(F.transform(regions, lambda r: F.nullif(F.array_position(order, F.lower(r)), F.lit(0).cast("long")))) - 1


def prefer(df: DataFrame, by: list[str], name: str, priority=REGIONS, exclude_prerelease: bool = True, exclude_bad: bool = True, exclude_changed: bool = True) -> DataFrame:
    """The preferred row of each title (and of `by`): verified first, then by region, then without a revision, then by name."""
    bad = F.lit(False)
    for wanted, col in ((exclude_prerelease, F.col("is_prerelease")), (exclude_bad, F.col("bad_dump")), (exclude_changed, ~F.col("is_original"))):
        bad = bad | col if wanted else bad
    order = [F.desc("verified"), F.asc_nulls_last("_score"), F.col("revision").isNotNull(), F.col(name)]
    parsed = with_parsed_name(df, name).where(~bad).withColumn("_score", region_score(F.col("regions"), priority))
    first = F.row_number().over(Window.partitionBy(*by, "title").orderBy(*order))
    return parsed.withColumn("_nth", first).where("_nth = 1").drop("_nth", "_score")


def preferred_games(games: DataFrame, preferences: DataFrame) -> DataFrame:
    """coll, title, game: of each title of a collection the variant that its preferences choose; none if they exclude all.

    games: coll, game, is_parent. A parent wins if the collection prefers it, then a verified dump if it prefers those, then
    the best region, then one without a revision, then the first by name. Only collections that want one variant are here.
    """
    one = preferences.where("one_g_one_r").drop("name")
    parsed = with_parsed_name(games.select("coll", "game", "is_parent").distinct(), "game").join(one, "coll")
    bad = (F.col("exclude_modified") & ~F.col("is_original")) | (F.col("exclude_bad_dumps") & F.col("bad_dump")) | (F.col("exclude_prereleases") & F.col("is_prerelease"))
    score = F.coalesce(region_score(F.col("regions"), F.col("region_priority")), F.lit(1 << 30))
    order = F.struct(~(F.col("prefer_parent") & F.col("is_parent")), ~(F.col("prefer_verified") & F.col("verified")), score, F.col("revision").isNotNull(), "game")
    return parsed.where(~bad).groupBy("coll", "title").agg(F.min_by("game", order).alias("game"))


def one_per_title(rows: DataFrame, preferences: DataFrame, mode: str = "game") -> DataFrame:
    """rows (coll, game, is_parent and more) with, of collections that want one variant of a title, only its rows.

    mode "game" keeps all rows of the chosen variant, "row" only its first, by all its columns in their order.
    """
    if mode not in ("game", "row"):
        raise ValueError(f"a mode is game or row, not {mode}")
    chosen = preferred_games(rows, preferences)
    free = rows.join(preferences.where("one_g_one_r").select("coll"), "coll", "left_anti")
    kept = rows.join(chosen.select("coll", "game"), ["coll", "game"], "left_semi")
    if mode == "row":
        kept = kept.groupBy("coll", "game").agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return free.unionByName(kept)
