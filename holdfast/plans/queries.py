"""Queries of the catalogue operators over the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scalars
from ..operators import archives, completeness, imports, matching, merges, planner, plans, reports, settings, torrents, versions
from ..projection import Relations, ctes
from ..snapshots import numbered, shared_folder, snapshot
from ..sources import files, manifests, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *relations: str, more: str = ""):
    """Registers a function of the relations under its name; sql may use the relations and the CTEs of `more`."""

    def add(f: Callable[[Relations], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        ORACLES[f.__name__] = (ctes(*relations) + ("," + more if more else "") + "\n" if relations else "") + sql
        return f

    return add


def active(df: DataFrame) -> DataFrame:
    return df.where("version = 'v2'")


ENTRY = ["coll", "game", "rom", "is_disk"]
KEY = "case when sha1 is not null then 'S:'||sha1 when md5 is not null then 'M:'||md5 when crc32 is not null then 'C:'||crc32||':'||cast(size as varchar) end"
HELD = """held as (select distinct key from (select 'S:'||sha1 as key from c_files union all select 'S:'||sha1_no_header from c_files union all select 'M:'||md5 from c_files
  union all select 'C:'||crc32||':'||cast(size as varchar) from c_files) where key is not null)"""
UNMATCHED = """asked as (select sha1, crc32, size from c_roms where version='v2'), unm as (select f.* from c_files f where f.sha1 not in (select sha1 from asked where sha1 is not null)
  and not exists (select 1 from asked a where a.sha1 is not null and a.sha1=f.sha1_no_header)
  and not exists (select 1 from asked a where a.sha1 is null and a.crc32=f.crc32 and a.size=f.size)),
unk as (select l.source, l.path, l.sha1, u.size from c_locations l join unm u on u.sha1=l.sha1 where l.archive_path is null)"""
HOLDERS = "hold as (select m.*, l.source, l.path, l.archive_path from c_match m join c_locations l on l.sha1=m.sha1)"
ELSEWHERE = "twice as (select sha1 from c_locations group by sha1 having count(distinct source)>1)"


@query("select v.coll, v.version, v.is_active, coalesce(g.n,0) as games, coalesce(r.n,0) as roms from c_versions v left join (select coll, version, count(*) n from c_games group by 1,2) g on g.coll=v.coll and g.version=v.version left join (select coll, version, count(*) n from c_roms group by 1,2) r on r.coll=v.coll and r.version=v.version", "c_versions", "c_games", "c_roms")
def a1_version_counts(r):
    return versions.counts(r.versions, r.games, r.roms)


@query("select * from c_match", "c_match")
def j2_content_match(r):
    return matching.matches(active(r.roms), r.files, ENTRY)


@query("select m.coll, m.game, m.rom, m.sha1, l.source, l.path, l.archive_path, s.path as root, s.disposition from c_match m join c_locations l on l.sha1=m.sha1 join c_sources s on s.source=l.source", "c_match", "c_locations", "c_sources")
def j3_holders(r):
    return matching.holders(matching.matches(active(r.roms), r.files, ENTRY), r.locations, r.sources).select("coll", "game", "rom", "sha1", "source", "path", "archive_path", "root", "disposition")


@query(f"select distinct k.key from (select {KEY} as key from c_roms where version='v2') k join held on held.key=k.key", "c_roms", "c_files", more=HELD)
def j4_present_keys(r):
    return matching.present(active(r.roms), r.files)


@query("""select coll, game, rom from c_roms r where version='v2' and status<>'nodump' and case when sha1 is not null then not exists (select 1 from c_files f where f.sha1=r.sha1 or f.sha1_no_header=r.sha1)
  else not exists (select 1 from c_files f where f.crc32=r.crc32 and f.size=r.size) end""", "c_roms", "c_files")
def j5_missing_entries(r):
    return matching.missing_entries(active(r.roms), r.files).select("coll", "game", "rom")


@query("select source, path, sha1, size from unk", "c_roms", "c_files", "c_locations", more=UNMATCHED)
def j6_unknown_files(r):
    return matching.unknown_files(r.locations, r.files, active(r.roms)).select("source", "path", "sha1", "size")


@query("select source, count(*) as n, cast(sum(size) as bigint) as bytes from unk group by source", "c_roms", "c_files", "c_locations", more=UNMATCHED)
def a19_unknown_by_source(r):
    return reports.unknown_by_source(matching.unknown_files(r.locations, r.files, active(r.roms)))


@query("select sha1 from twice", "c_locations", more=ELSEWHERE)
def j7_held_elsewhere(r):
    return matching.held_elsewhere(r.locations)


@query("select l.source, l.path, l.sha1, f.size from c_locations l join c_sources s on s.source=l.source join c_files f on f.sha1=l.sha1 where l.archive_path is null and s.disposition='consume' and l.sha1 in (select sha1 from twice)", "c_locations", "c_sources", "c_files", more=ELSEWHERE)
def l12_reclaimable_loose(r):
    return matching.reclaimable_loose(r.locations, r.files, r.sources)


@query("select l.source, l.path, cast(sum(f.size) as bigint) as bytes, count(*) as entries from c_locations l join c_files f on f.sha1=l.sha1 where l.archive_path is not null group by 1,2 having bool_and(l.sha1 in (select sha1 from twice))", "c_locations", "c_files", more=ELSEWHERE)
def a18_reclaimable_containers(r):
    return matching.reclaimable_containers(r.locations, r.files)


@query("""select source, path, bool_and(safe) as survives from (select a.source, a.path, exists (select 1 from c_locations o where o.sha1=a.sha1 and not (o.source=a.source and o.path=a.path) and (s.disposition='consume' or o.source=a.source)) as safe
  from c_locations a join c_sources s on s.source=a.source) group by 1,2""", "c_locations", "c_sources")
def j13_survivors(r):
    return matching.survivors(r.locations, r.sources)


@query("select sha1 from c_match group by sha1 having count(distinct coll||'/'||game)>1", "c_match")
def a15_shared_content(r):
    return matching.shared_content(r.match)


@query("select source, path from hold where archive_path is not null group by 1,2 having count(distinct coll||'/'||game)>1", "c_match", "c_locations", more=HOLDERS)
def a16_shared_containers(r):
    return matching.shared_containers(matching.holders(r.match, r.locations, r.sources)).select("source", "path")


@query("""select h.coll, h.game, h.rom, h.sha1, h.source, h.path, h.archive_path from hold h join (select sha1, source, path, archive_path from (select distinct sha1, source, path, archive_path from hold)
  qualify row_number() over (partition by sha1 order by source, path, archive_path nulls first)<=2) f on f.sha1=h.sha1 and f.source=h.source and f.path=h.path and f.archive_path is not distinct from h.archive_path""", "c_match", "c_locations", more=HOLDERS)
def n1_capped_holders(r):
    return matching.capped_holders(r.match, r.locations, r.sources, 2).select("coll", "game", "rom", "sha1", "source", "path", "archive_path")


@query("select count(*) as n_rows from hold", "c_match", "c_locations", more=HOLDERS)
def n2_expansion(r):
    return matching.expansion(r.match, r.locations)


def _stats_sql(mode: str) -> str:
    """CTEs up to `stats` for a merge mode."""
    own = "select * from c_games where not is_mechanical" + (" and parent_name is null" if mode == "merged" else "")
    split = " where status='nodump' or o.parent_name is null or k.merge_tag is null" if mode == "split" else ""
    clones = " union all select c.coll, c.version, c.parent_name, k.status, k.key from keyed k join c_games c using (coll,version,game) join own o on o.coll=c.coll and o.version=c.version and o.game=c.parent_name" if mode == "merged" else ""
    return f"""{HELD},
keyed as (select * from (select coll, version, game, rom, status, merge_tag, case when status<>'nodump' then {KEY} end as key from c_roms) where key is not null or status='nodump'),
own as ({own}),
need as (select o.coll, o.version, o.game as owner, k.status, k.key from own o join keyed k on k.coll=o.coll and k.version=o.version and k.game=o.game{split}{clones}),
game as (select o.coll, o.version, o.game, o.is_bios, o.is_device, count(n.key) as need, count(h.key) as have, count(*) filter (n.status='nodump') as nodump
  from own o left join need n on n.coll=o.coll and n.version=o.version and n.owner=o.game left join held h on h.key=n.key group by all),
sizes as (select coll, version, key, greatest(size,0) as bytes from (select coll, version, size, game, rom, {KEY} as key from c_roms) where key is not null qualify row_number() over (partition by coll, version, key order by game, rom)=1),
uniq as (select k.coll, k.version, count(*) as total_roms, count(h.key) as have_roms, sum(s.bytes) as total_bytes, coalesce(sum(s.bytes) filter (h.key is not null),0) as have_bytes
  from (select distinct coll, version, key from need where key is not null) k left join held h on h.key=k.key left join sizes s on s.coll=k.coll and s.version=k.version and s.key=k.key group by 1,2),
stats as (select g.coll, g.version, count(*) as total_games, count(*) filter (g.need=g.have) as complete_games, count(*) filter (g.need<>g.have and g.have>0) as partial_games, count(*) filter (g.need<>g.have and g.have=0) as missing_games,
  cast(sum(g.nodump) as bigint) as nodump_roms, count(*) filter (g.is_bios) as bios_sets, count(*) filter (g.is_device) as device_sets,
  cast(coalesce(any_value(u.total_roms),0) as bigint) as total_roms, cast(coalesce(any_value(u.have_roms),0) as bigint) as have_roms, cast(coalesce(any_value(u.total_bytes),0) as bigint) as total_bytes, cast(coalesce(any_value(u.have_bytes),0) as bigint) as have_bytes
  from game g left join uniq u on u.coll=g.coll and u.version=g.version group by 1,2),
stat as (select c.coll, c.name, c.node_path, s.* exclude (coll), case when total_roms>0 then have_roms/total_roms*100 else 0.0 end as percent from c_collections c join stats s on s.coll=c.coll and s.version='v2')"""


def _add_stats(mode: str) -> None:
    def stats(r):
        return completeness.stats(r.games, r.roms, r.files, mode)

    stats.__name__ = f"a3_stats_{mode.replace('-', '_')}"
    query("select * from stats", "c_games", "c_roms", "c_files", "c_collections", more=_stats_sql(mode))(stats)


for _mode in ("non-merged", "split", "merged"):
    _add_stats(_mode)


def _status(r):
    return completeness.status(r.collections, r.versions, r.games, r.roms, r.files)


_STATUS = {"more": _stats_sql("non-merged")}
_USED = ("c_games", "c_roms", "c_files", "c_collections")
_SUMS = "cast(sum(total_games) as bigint) as total_games, cast(sum(complete_games) as bigint) as complete_games, cast(sum(total_roms) as bigint) as total_roms, cast(sum(have_roms) as bigint) as have_roms"


@query("select * from stat", *_USED, **_STATUS)
def a5_status(r):
    return _status(r)


@query(f"select split_part(name,' - ',1) as grp, count(*) as collections, {_SUMS}, cast(case when sum(total_roms)>0 then floor(sum(have_roms)*100/sum(total_roms)) else 0 end as bigint) as percent from stat group by 1", *_USED, **_STATUS)
def a7_rollup_by_system(r):
    return completeness.rollup(_status(r), "system")


@query(f"select split_part(node_path,'/',1) as grp, count(*) as collections, {_SUMS}, cast(case when sum(total_roms)>0 then floor(sum(have_roms)*100/sum(total_roms)) else 0 end as bigint) as percent from stat group by 1", *_USED, **_STATUS)
def a7_rollup_by_set(r):
    return completeness.rollup(_status(r), "set")


@query(f"select node, count(*) as leaves, {_SUMS} from (select *, unnest([split_part(node_path,'/',1), node_path]) as node from stat) group by 1", *_USED, **_STATUS)
def a9_tree(r):
    return completeness.tree(_status(r))


def _diff_sql(table: str, value: str) -> str:
    side = lambda v: f"select coll, {value} as value from {table} where version='{v}' and {value} is not null"
    return f"select coll, value, 'added' as change from ({side('v2')} except {side('v1')}) union all select coll, value, 'removed' from ({side('v1')} except {side('v2')})"


@query(_diff_sql("c_games", "game"), "c_games")
def u3_diff_games(r):
    return versions.difference(r.games, "v1", "v2", "game")


@query(_diff_sql("c_roms", "sha1"), "c_roms")
def u3_diff_hashes(r):
    return versions.difference(r.roms, "v1", "v2", "sha1")


@query("select coll, version, previous from (select *, lead(version) over (partition by coll order by imported_seq desc) as previous from c_versions) where is_active", "c_versions")
def n6_previous_version(r):
    return versions.previous(r.versions)


@query("select coll, version, case when coll='en' then version='v1' else is_active end as is_active, imported_seq from c_versions", "c_versions")
def w8_activate(r):
    return versions.activate(r.versions, "en", "v1")


@query("select coll, version, case when coll='en' then true else is_active end as is_active, imported_seq from c_versions where not (coll='en' and is_active)", "c_versions")
def w10_remove_active(r):
    return versions.after_removal(r.versions, "en")


@query("select coll, name, replace(name,' - ','/') as node_path from c_collections", "c_collections")
def w13_sort_into_folders(r):
    return versions.sort_into_folders(r.collections)


@query("select reason, count(*) as n, cast(coalesce(sum(size),0) as bigint) as bytes from c_quarantine group by 1", "c_quarantine")
def a13_quarantine_by_reason(r):
    return reports.quarantine_by(r.quarantine, "reason")


@query("select collection_name, count(*) as n, cast(coalesce(sum(size),0) as bigint) as bytes from c_quarantine group by 1", "c_quarantine")
def a13_quarantine_by_collection(r):
    return reports.quarantine_by(r.quarantine, "collection_name")


@query("select sha1, quarantine_path from c_quarantine where collection_name ilike 'D_ - Doc%'", "c_quarantine")
def f3_quarantine_pattern(r):
    return r.quarantine.where(scalars.like_glob(F.col("collection_name"), "d? - doc*")).select("sha1", "quarantine_path")


@query("select coll, version, game from c_games where regexp_matches(lower(game), '^title 1. \\(.*\\)$')", "c_games")
def f2_glob(r):
    return r.games.where(scalars.matches_glob(F.col("game"), "Title 1? (*)")).select("coll", "version", "game")


@query("select s.source, s.path, count(distinct l.sha1) as files from c_sources s left join c_locations l on l.source=s.source group by 1,2", "c_sources", "c_locations")
def a14_files_per_source(r):
    return reports.files_per_source(r.sources, r.locations)


@query("select (select count(*) from c_files) as files, (select count(*) from c_sources) as sources, (select count(*) from c_quarantine) as quarantined, cast((select sum(size) from c_quarantine) as bigint) as quarantined_bytes", "c_files", "c_sources", "c_quarantine")
def a6_overall(r):
    return reports.overall(r.files, r.sources, r.quarantine)


@query("""select r.coll, r.game, r.rom, r.size, r.sha1, h.held_at, h.held_at is not null as have from (select * from c_roms where version='v2') r
  left join (select l.sha1, min(s.path||'/'||l.path) as held_at from c_locations l join c_sources s on s.source=l.source group by 1) h on h.sha1=r.sha1""", "c_roms", "c_locations", "c_sources")
def j11_export(r):
    return reports.export(active(r.roms), r.locations, r.sources)


@query("""select a.full_path as "full", s.source, substr(a.full_path, length(s.path)+2) as relative from (select distinct s.path||'/'||l.path as full_path from c_locations l join c_sources s on s.source=l.source) a
  join c_sources s on starts_with(a.full_path, s.path||'/') qualify row_number() over (partition by a.full_path order by length(s.path) desc)=1""", "c_locations", "c_sources")
def f5_resolve_paths(r):
    full = r.locations.join(r.sources.select("source", F.col("path").alias("root")), "source").select(F.concat_ws("/", "root", "path").alias("full_path")).distinct()
    return reports.resolve_paths(full, r.sources, "full_path")


@query("select coll, version, game, rom, merge_tag from c_roms join c_games using (coll, version, game) where parent_name is null or merge_tag is null", "c_roms", "c_games")
def f9_split_filter(r):
    return matching.split_only(r.roms, r.games).select("coll", "version", "game", "rom", "merge_tag")


@query("""select distinct coll, game, trim(split_part(game,'(',1)) as title, case when game like '%(USA)%' then 'USA' when game like '%(Europe)%' then 'Europe' else 'Japan' end as primary_region,
  case when game like '%(Rev A)%' then 'Rev A' end as revision, game like '%[b]%' as bad_dump from c_games""", "c_games")
def p1_parsed_names(r):
    return names.with_parsed_name(r.games.select("coll", "game").distinct(), "game").select("coll", "game", "title", "primary_region", "revision", "bad_dump")


@query("""select coll, title, game from (select distinct coll, game, trim(split_part(game,'(',1)) as title, case when game like '%(USA)%' then 1 else 2 end as place from c_games where version='v2' and game not like '%[b]%')
  qualify row_number() over (partition by coll, title order by place, game)=1""", "c_games")
def n7_one_per_title(r):
    return names.prefer(active(r.games).select("coll", "game").distinct(), ["coll"], "game").select("coll", "title", "game")


@query("select l_orderkey, l_suppkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber)=1")
def w1_keep_first(r):
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]  # of rows with one line number, the first listed stays
    rows = r.spark.read.parquet(f"{r.sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", *at)
    return merges.keep_first(rows, ["l_orderkey", "l_suppkey"], [F.asc_nulls_last("l_linenumber"), "file", "at"]).drop("file", "at")


@query("select source, path, sha1, archive_path from c_locations where source<>'src1'", "c_locations")
def w7_remove_source(r):
    return merges.remove_source(r.sources, r.locations, "src1")[1].select("source", "path", "sha1", "archive_path")


@query("select source, case when source='src2' then '/new/root' else path end as path, case when source='src2' then 'preserve' else disposition end as disposition from c_sources", "c_sources")
def w7_set_disposition(r):
    changed = merges.set_disposition(r.sources, "src2", "preserve")
    return changed.withColumn("path", F.when(F.col("source") == "src2", "/new/root").otherwise(F.col("path")))


@query("""select doc_id, case when n_chars>=1073741824 then printf('%.2f GB', n_chars/1073741824.0) when n_chars>=1048576 then printf('%.2f MB', n_chars/1048576.0) when n_chars>=1024 then printf('%.2f KB', n_chars/1024.0) else cast(n_chars as varchar)||' bytes' end as size_text,
  cast(least(greatest(power(2, ceil(log2(greatest(floor(n_chars*100000.0/1500),1)))),16384),16777216) as bigint) as piece_size from documents""")
def c1_sizes(r):
    n = F.col("n_chars").cast("long")
    return r.documents.select("doc_id", scalars.bytes_text(n).alias("size_text"), scalars.piece_size(n * 100_000).alias("piece_size"))


SETTINGS = """setting as (select c.coll, c.name, c.node_path, o.dest_path,
  case when lower(coalesce(o.output_format,g.output_format)) in ('loose','zip','torrentzip','7z') then lower(coalesce(o.output_format,g.output_format)) else 'torrentzip' end as output_format,
  case when lower(coalesce(o.merge_mode,g.merge_mode)) in ('non-merged','merged','split') then lower(coalesce(o.merge_mode,g.merge_mode)) else 'non-merged' end as merge_mode
  from c_collections c left join c_config o on o.path_pattern=c.name left join c_config g on c.node_path like '%/%' and g.path_pattern=split_part(c.node_path,'/',1))"""


@query("select * from setting", "c_collections", "c_config", more=SETTINGS)
def j14_effective_settings(r):
    return settings.effective(r.collections, r.config)


@query("select *, coalesce(dest_path, '/lib/ROMs/'||node_path) as root from setting", "c_collections", "c_config", more=SETTINGS)
def c6_destinations(r):
    return settings.destinations(settings.effective(r.collections, r.config), "/lib/ROMs/")


@query("select v.coll, v.version, coalesce(bool_and(r.is_disk),false) as disk_only from c_versions v left join c_roms r on r.coll=v.coll and r.version=v.version group by 1,2", "c_versions", "c_roms")
def f13_disk_only(r):
    return settings.disk_only(r.versions, r.roms)


@query("""select '/dest/'||split_part(node_path,'/',1) as root, disk_only, count(*) as n, string_agg(name, ',' order by name) as names from c_collections c
  join (select coll, bool_and(is_disk) as disk_only from c_roms where version='v2' group by 1) d on d.coll=c.coll group by 1,2 having count(*)>1""", "c_collections", "c_roms")
def a17_destination_collisions(r):
    """All collections of a set put in one folder."""
    kinds = settings.disk_only(active(r.versions), r.roms).select("coll", "disk_only")
    placed = r.collections.join(kinds, "coll").withColumn("root", F.concat(F.lit("/dest/"), scalars.top_segment(F.col("node_path"))))
    return settings.collisions(placed)


UNDER = lambda path, root: f"({path}={root} or starts_with({path},{root}||'/'))"
MAY = f"(disposition='consume' or {UNDER('dest', 'root')})"
PLACED = f"({UNDER('spot', 'dest_root')} or {UNDER('spot', chr(39) + '/lib/ROMs' + chr(39))})"
WANT = """shr as (select sha1 from c_held group by sha1 having count(distinct coll||'/'||game)>1),
shc as (select root||'/'||path as spot from c_held where archive_path is not null group by 1 having count(distinct coll||'/'||game)>1),
w as (select h.*, o.dest_root, o.format, h.root||'/'||h.path as spot, h.sha1 in (select sha1 from shr) as is_shared from c_held h join c_goals o on o.coll=h.coll),
cnt as (select coll, game, count(distinct rom) as n from w where not is_disk and format='loose' group by 1,2),
dd as (select w.*, case when is_disk then dest_root||'/'||game||'/'||rom||'.chd' when n>1 then dest_root||'/'||game||'/'||rom else dest_root||'/'||rom end as dest from w left join cnt using (coll,game) where is_disk or format='loose')"""
FILE_OPS = f"""{WANT},
rk as (select *, archive_path is null and spot=dest as here, bool_or(is_shared) over (partition by coll, dest) as shared,
  row_number() over (partition by coll, dest order by case when archive_path is null and spot=dest then 0 else 1 end, game, rom, root, path, coalesce(archive_path,''), sha1) as nth from dd),
fops as (select coll, is_disk, case when {MAY} and not shared then 'move' else 'copy' end as kind, spot as source, archive_path, dest, size, null as reason from rk where nth=1 and not here
  union all select coll, is_disk, 'delete', spot, null, dest, 0, 'exact duplicate — kept '||dest from rk where nth>1 and archive_path is null and not shared and {MAY} and spot<>dest and not {PLACED})"""
GAMES = f"""{WANT},
pk as (select *, dest_root||'/'||game||case when format='7z' then '.7z' else '.zip' end as dest, case when format='7z' then '7z' else 'zip' end as ext, rom||'|'||lower(sha1) as k from w where not is_disk and format<>'loose'),
gm as (select coll, game, dest_root, format, dest, ext, count(distinct k) as expected, bool_or(is_shared) as shared from pk group by all),
ct as (select coll, game, spot, count(distinct k) as holds, bool_and(archive_path is not null) as archived, sum(size) as own from pk group by all),
cf as (select coll, game, spot, root, disposition, archive_path from pk qualify row_number() over (partition by coll, game, spot order by rom, coalesce(archive_path,''), root, disposition)=1),
bf as (select c.*, f.root, f.disposition, f.archive_path from ct c join gm g on g.coll=c.coll and g.game=c.game and g.expected=c.holds join cf f on f.coll=c.coll and f.game=c.game and f.spot=c.spot
  qualify row_number() over (partition by c.coll, c.game order by c.spot<>g.dest, c.spot)=1),
sz as (select coll, game, sum(n) as entries, sum(n*size) as bytes from (select coll, game, rom, arg_min(size, row(spot, sha1, coalesce(archive_path,''))) as size, count(distinct sha1) as n from pk group by all) group by all),
fd as (select p.coll, p.game, bool_and(p.disposition='consume' or {UNDER('p.dest', 'p.root')}) as leaves, count(*) as n_sources from pk p left join bf b on b.coll=p.coll and b.game=p.game where b.spot is null or b.spot=p.spot group by all),
g1 as (select g.*, b.spot as build_from, b.archived, b.own, b.archive_path as first_entry, coalesce(b.spot<>g.dest,true) as away, b.spot in (select spot from shc) as serves, z.entries, z.bytes, f.leaves, f.n_sources, b.spot is not null and b.spot<>g.dest and (b.disposition='consume' or {UNDER('g.dest', 'b.root')}) as free
  from gm g left join bf b on b.coll=g.coll and b.game=g.game join sz z on z.coll=g.coll and z.game=g.game join fd f on f.coll=g.coll and f.game=g.game),
g2 as (select *, case when not away and format<>'torrentzip' then 'correct' when coalesce(free,false) and not shared and not coalesce(serves,false) and format<>'torrentzip' and archived and lower(regexp_extract(build_from,'[^.]*$'))=ext then 'relocate' else 'repack' end as action from g1),
gp as (select coll, game, dest_root, dest, build_from, shared, action, cast(entries as bigint) as entries, cast(case action when 'relocate' then own when 'repack' then bytes else 0 end as bigint) as size, action='repack' and leaves and not shared as move_sources,
  action='repack' and coalesce(free,false) and first_entry is not null as drains, n_sources from g2)"""
ARCHIVE_OPS = f"""{GAMES},
aops as (select coll, action as kind, build_from as source, null as archive_path, dest, size, case when move_sources then 'sources go' end as reason from gp where action<>'correct'
  union all select coll, 'delete', spot, null, dest, 0, 'exact duplicate — kept '||dest from (select f.*, g.dest, g.dest_root, g.build_from from cf f join gp g on g.coll=f.coll and g.game=f.game where not g.shared)
    where spot<>dest and spot is distinct from build_from and spot not in (select spot from shc) and {MAY} and not {PLACED})"""
ALL_OPS = FILE_OPS + ARCHIVE_OPS[len(WANT) :] + """,
ops as (select coll, kind, source, archive_path, dest, size, reason from fops union all select * from aops),
pc as (select o.coll, o.name, o.node_path, cast(coalesce(b.n,0)+coalesce(p.n,0) as bigint) as to_write, cast(coalesce(a.n,0)+coalesce(p.ok,0) as bigint) as already_correct, cast(coalesce(b.bytes,0)+coalesce(p.bytes,0) as bigint) as bytes
  from c_goals o left join (select coll, count(*) as n from rk where nth=1 and here group by 1) a on a.coll=o.coll left join (select coll, count(*) as n, sum(size) as bytes from fops where kind<>'delete' group by 1) b on b.coll=o.coll
  left join (select coll, count(*) filter (action='repack') as n, sum(entries) filter (action='correct') as ok, sum(size) as bytes from gp group by 1) p on p.coll=o.coll)"""
PLAN = ("c_held", "c_goals")
LIBRARY = "/lib/ROMs"


def _held(r):
    return planner.held_at(r.asked, r.homes)


def _rows(r):
    """Once for a query, with the entries written, as several steps read them."""
    if "rows" not in r._made:
        met = planner.wanted(_held(r), r.goals, matching.shared_content(r.asked, r.homes))
        r._made["rows"] = met._replace(entries=snapshot(met.entries))
    return r._made["rows"]


def _shared_at(r):
    return planner.shared_containers(_held(r))


def _planned(r):
    """Once for a query, with what is planned for each game written, as several steps read it."""
    if "planned" not in r._made:
        rows = _rows(r)
        files_ops, dests = planner.plan_files(rows, LIBRARY)
        built = snapshot(planner.games(rows, _shared_at(r)))
        r._made["planned"] = files_ops, dests, built, files_ops.unionByName(planner.plan_archives(rows, built, _shared_at(r), LIBRARY))
    return r._made["planned"]


def _only(r, which: str):
    rows = _rows(r)
    return rows._replace(entries=rows.entries.where(which))


def _plan_rows(r):
    files_ops, dests, built, _ = _planned(r)
    return planner.per_collection(r.goals, dests, files_ops, built)


@query("select coll, kind, source, archive_path, dest, size, reason from fops where not is_disk", *PLAN, more=FILE_OPS)
def l4_plan_loose(r):
    return planner.plan_files(_only(r, "not is_disk"), LIBRARY)[0]


@query("select coll, kind, source, archive_path, dest, size, reason from fops where is_disk", *PLAN, more=FILE_OPS)
def l9_plan_disks(r):
    return planner.plan_files(_only(r, "is_disk"), LIBRARY)[0]


@query("select coll, game, dest, build_from, action, size, entries from gp", *PLAN, more=GAMES)
def l5_plan_archives(r):
    return planner.games(_rows(r), _shared_at(r)).select("coll", "game", "dest", "build_from", "action", "size", "entries")


@query("select coll, game, size, move_sources, n_sources from gp where action='repack'", *PLAN, more=GAMES)
def l6_repack_sizes(r):
    return planner.games(_rows(r), _shared_at(r)).where("action = 'repack'").select("coll", "game", "size", "move_sources", "n_sources")


@query("select coll, source, dest, reason from aops where kind='delete'", *PLAN, more=ARCHIVE_OPS)
def l7_duplicate_archives(r):
    rows, spot = _rows(r), _shared_at(r)
    return planner.plan_archives(rows, planner.games(rows, spot), spot, LIBRARY).where("kind = 'delete'").select("coll", "source", "dest", "reason")


@query("""select spot as container, case when lower(spot) like '%.7z' then '7z' else 'zip' end as format, 'consolidated into '||arg_min(dest, row(name, game, rom, sha1, dest)) as reason, count(distinct archive_path) as entries
  from (select p.*, o.name from pk p join gp g on g.coll=p.coll and g.game=p.game and g.build_from=p.spot join c_goals o on o.coll=p.coll where g.drains and p.archive_path is not null) group by spot""", *PLAN, more=GAMES)
def l8_drains(r):
    rows = _rows(r)
    found = planner.drains(rows, planner.games(rows, _shared_at(r)), r.goals)
    return found.select("container", "format", "reason", F.size("entries").cast("long").alias("entries"))


@query("""select spot as container, archive_path as container_entry, arg_min(rom, row(name, game, rom, sha1, dest)) as dest_entry, arg_min(dest, row(name, game, rom, sha1, dest)) as dest
  from (select p.*, o.name from pk p join gp g on g.coll=p.coll and g.game=p.game and g.build_from=p.spot join c_goals o on o.coll=p.coll where g.drains and p.archive_path is not null) group by 1,2""", *PLAN, more=GAMES)
def u4_first_entry_names(r):
    rows = _rows(r)
    found = planner.drains(rows, planner.games(rows, _shared_at(r)), r.goals)
    return found.select("container", F.explode("entries").alias("e")).select("container", "e.container_entry", "e.dest_entry", "e.dest")


@query("""select count(*) filter (kind='copy') as copies, count(*) filter (kind in ('move','relocate')) as moves, count(*) filter (kind='repack') as repacks, count(*) filter (kind in ('delete','drain')) as deletes,
  cast(sum(size) as bigint) as bytes, (select cast(sum(already_correct) as bigint) from pc) as already_correct from ops""", *PLAN, more=ALL_OPS)
def l13_plan_summary(r):
    return planner.summary(_planned(r)[3], _plan_rows(r))


@query("select * from pc", *PLAN, more=ALL_OPS)
def l1_plan_per_collection(r):
    return _plan_rows(r)


@query("select name, node_path, to_write, bytes from pc where to_write>0", *PLAN, more=ALL_OPS)
def a11_pending_work(r):
    return planner.pending(_plan_rows(r))


@query("select split_part(node_path,'/',1) as grp, cast(sum(to_write) as bigint) as to_write, cast(sum(bytes) as bigint) as bytes from pc where to_write>0 group by 1", *PLAN, more=ALL_OPS)
def a10_pending_by_set(r):
    return planner.by_set(_plan_rows(r))


@query("select kind, count(*) as n, cast(sum(size) as bigint) as bytes from ops group by 1", *PLAN, more=ALL_OPS)
def a12_operations_by_kind(r):
    return planner.tally(_planned(r)[3])


@query("""select volume, cast(sum(size) as bigint) as bytes, cast(trunc(cast(sum(size) as double)*1.1) as bigint) as with_margin from (select *, case when coll in ('de','es') then '/Volumes/'||coll else '/' end as volume from ops) where kind in ('copy','repack') or (kind in ('move','relocate') and volume<>'/') group by 1 having sum(size)>0""", *PLAN, more=ALL_OPS)
def a22_space_needed(r):
    """Two collections go to volumes of their own, so that their moves need space too."""
    at = F.when(F.col("coll").isin("de", "es"), F.concat(F.lit("/Volumes/"), "coll", "dest")).otherwise(F.col("dest"))
    return planner.space_needed(_planned(r)[3].withColumn("dest", at))


@query("select row_number() over (order by coll, dest, source, kind, archive_path)-1 as op_id, coll, kind, source, dest from ops", *PLAN, more=ALL_OPS)
def l14_operation_ids(r):
    order = ["coll", "dest", F.asc_nulls_last("source"), "kind", F.asc_nulls_last("archive_path")]
    return planner.numbered(_planned(r)[3], order).select("op_id", "coll", "kind", "source", "dest")


@query("select coll, game, count(distinct rom) as entries from c_held where not is_disk group by 1,2", "c_held")
def a23_entries_per_game(r):
    return planner.entries_per_game(r.asked.where("not is_disk").join(r.homes.select("sha1"), "sha1", "left_semi"))


DESIRED = GAMES + ",\nwish as (select dest from dd union select dest from pk), homes as (select distinct sha1, dest from pk)"
LAYER = """loose as (select l.root||'/'||l.path as path, l.sha1, f.size from c_homes l join c_files f on f.sha1=l.sha1 where l.archive_path is null and (l.root='/lib/ROMs' or starts_with(l.root,'/lib/ROMs/'))),
layer as (select *, sha1 in (select h.sha1 from homes h join c_homes l on l.sha1=h.sha1 and l.root||'/'||l.path=h.dest where l.archive_path is not null) and path not in (select dest from wish) as removable from loose)"""


@query("select dest from wish", *PLAN, more=DESIRED)
def l10_desired_paths(r):
    return planner.desired_paths(_rows(r))


@query("select sha1, dest from homes", *PLAN, more=DESIRED)
def l10_archive_homes(r):
    return planner.archive_homes(_rows(r))


def _layer(r):
    roots = r.homes.select(F.col("root").alias("source"), F.col("root").alias("path")).distinct()
    places = r.homes.select("sha1", F.col("root").alias("source"), "path", "archive_path")
    return planner.superseded(_rows(r), places, roots, r.files, LIBRARY)


@query("select * from layer", *PLAN, "c_homes", "c_files", more=DESIRED + ",\n" + LAYER)
def l11_superseded(r):
    return _layer(r)


@query("select count(*) as files, cast(sum(size) as bigint) as bytes, count(*) filter (removable) as removable_files, cast(coalesce(sum(size) filter (removable),0) as bigint) as removable_bytes from layer", *PLAN, "c_homes", "c_files", more=DESIRED + ",\n" + LAYER)
def a20_superseded_totals(r):
    return planner.superseded_totals(_layer(r))


@query("select distinct dest, cast(null as varchar) as archive_path, d.sha1 from fops join (select distinct dest, sha1 from dd) d using (dest) where kind<>'delete' union select g.dest, p.rom, p.sha1 from gp g join pk p on p.coll=g.coll and p.game=g.game where action='repack'", *PLAN, more=ALL_OPS)
def w18_placements(r):
    entries, ops = _rows(r).entries, _planned(r)[3]
    packed = planner.archive_dest(planner.packed(entries))
    return planner.placements(ops, planner.with_dest(entries).select("dest", "rom", "sha1").unionByName(packed.select("dest", "rom", "sha1")))


@query("""select o.coll, o.name, case when v.coll is null then 'no active version' when o.coll in ('de','fr') then 'filtered' when e.n>=120 and m.n>200 then 'oversized' else 'planned' end as state from c_goals o
  left join (select distinct coll from c_versions where is_active and coll<>'es') v on v.coll=o.coll left join (select coll, count(*) as n from c_roms where version='v2' group by 1) e on e.coll=o.coll
  left join (select coll, sum(n*least(p,2)) as n from (select coll, sha1, count(*) as n from c_match group by 1,2) join (select sha1, count(*) as p from c_locations group by 1) using (sha1) group by 1) m on m.coll=o.coll""", "c_goals", "c_versions", "c_roms", "c_match", "c_locations")
def l3_why_planned(r):
    """One collection has no version, one is left out by its name, and small bounds stand for the large ones."""
    return planner.gate(r.goals, r.versions.where("is_active and coll <> 'es'"), active(r.roms), r.match, r.locations, names="e*", guard=120, most=200, cap=2)


@query("""select distinct sha1, root, path, disposition='consume' or starts_with('/lib/ROMs/src1/x', root||'/') as may_leave from c_homes""", "c_homes")
def f7_may_leave(r):
    return r.homes.select("sha1", "root", "path", planner.may_leave(F.col("disposition"), F.col("root"), F.lit("/lib/ROMs/src1/x")).alias("may_leave")).distinct()


@query("select coll, game, spot, archived and lower(regexp_extract(spot,'[^.]*$'))='zip' as can_relocate from (select coll, game, root||'/'||path as spot, bool_and(archive_path is not null) as archived from c_held group by 1,2,3)", "c_held")
def f12_relocatable(r):
    found = planner.containers(r.held.withColumn("at", F.concat_ws("/", "root", "path")))
    return found.select("coll", "game", F.col("at").alias("spot"), planner.relocatable(F.col("archived"), F.col("at"), F.lit("zip")).alias("can_relocate"))


@query("select sha1, path, sha1||'_'||split_part(path,'/',-1) as file from c_locations", "c_locations")
def c15_quarantine_names(r):
    return r.locations.select("sha1", "path", planner.quarantine_name(F.col("sha1"), F.col("path")).alias("file"))


@query("select sha1 from c_match where sha1 in (select sha1 from c_locations where source='src1') group by sha1 having count(distinct coll||'/'||game)>1", "c_match", "c_locations")
def j8_shared_and_held(r):
    return matching.shared_content(r.match, r.locations.where("source = 'src1'"))


HEADS = """head as (select distinct concat(source,'/',lang,'.dat') as path, case when source='src7' then 'XX - New' else concat(upper(lang),' - Documents') end as name,
  case when source in ('src1','src2') then 'v2' when source<>'src5' then source end as version, case when source in ('src4','src6') then source end as under, case when source='src3' then 'no header' end as error from documents)"""
JUDGED = f"""{HEADS}, named as (select path, name, coalesce(version,'20260101') as version, under, error from head),
here as (select distinct c.name, v.version from c_collections c join c_versions v on v.coll=c.coll),
judged as (select path, name, version, coalesce(under,name) as node_path, case when error is not null then 'failed' when (name,version) in (select (name,version) from here)
  or row_number() over (partition by name, version, error is null order by path)>1 then 'skipped' else 'added' end as state from named)"""


def _heads(r):
    return r.spark.sql(HEADS[HEADS.index("(select") + 1 : -1].replace("from documents", "from {documents}"), documents=r.documents)


@query("select * from judged", "c_collections", "c_versions", more=JUDGED)
def s18_import(r):
    return imports.judge(_heads(r), r.collections, r.versions, "20260101").drop("error")


@query("select state, count(*) as n from judged group by 1", "c_collections", "c_versions", more=JUDGED)
def a25_import_report(r):
    return imports.report(imports.judge(_heads(r), r.collections, r.versions, "20260101"))


@query("""select path, name as node_path, case when error is not null then error when name not in (select name from c_collections) then 'no such collection' end as error, case when error is not null or name not in (select name from c_collections) then 'failed'
  when (name,version) in (select (name,version) from here) or row_number() over (partition by name, version, error is null and name in (select name from c_collections) order by path)>1 then 'skipped' else 'added' end as state from named""", "c_collections", "c_versions", more=JUDGED)
def s20_upgrade(r):
    return imports.judge(_heads(r), r.collections, r.versions, "20260101", upgrade=True).select("path", "node_path", "error", "state")


@query("""select coll, version, version=last as is_active from (select coll, version from c_versions union select coalesce(c.coll,j.name), version from judged j left join c_collections c on c.name=j.name where state='added')
  left join (select coalesce(c.coll,j.name) as coll, arg_max(version, path) as last from judged j left join c_collections c on c.name=j.name where state='added' group by 1) using (coll)""", "c_collections", "c_versions", more=JUDGED)
def s19_versions_after_import(r):
    none = r.spark.createDataFrame([], "path string, game string, description string, parent_name string, is_bios boolean, is_device boolean, is_mechanical boolean, rom string, size long, crc32 string, md5 string, sha1 string, status string, merge_tag string, is_disk boolean, ordinal struct<block:bigint,row:bigint,part:int>")
    judged = imports.judge(_heads(r), r.collections, r.versions, "20260101")
    return imports.apply(judged, r.collections, r.versions, r.games, r.roms, none)[1].select("coll", "version", "is_active")


@query("""select source, path, case when source='src9' then 'consume' when inside then 'preserve' else 'consume' end as disposition, source='src9' and inside as refused
  from (select source, path, path='/lib/ROMs' or starts_with(path,'/lib/ROMs/') as inside from c_sources)""", "c_sources")
def s32_register_sources(r):
    wanted = r.sources.select("source", F.concat("path", F.lit("/")).alias("path"), F.when(F.col("source") == "src9", "consume").alias("wanted"))
    return imports.register(wanted, r.spark.createDataFrame([("/lib/ROMs/",)], "path string"))


@query("select source, path, sha1 from c_locations where path='z' or starts_with(path,'z/')", "c_locations")
def s23_subtree(r):
    return imports.below(r.locations, "./z/").select("source", "path", "sha1")


@query("select sha1, quarantine_path, size, reason, collection_name from c_quarantine where reason<>'duplicate' union all select sha1, 'again/'||sha1, min(size), 'duplicate', null from c_files where sha1 not in (select sha1 from c_quarantine where reason<>'duplicate') group by sha1", "c_quarantine", "c_files")
def w15_quarantine(r):
    """Rows of one reason go, and contents that are not quarantined come."""
    left = merges.remove(r.quarantine, r.quarantine.where("reason = 'duplicate'"), ["sha1", "quarantine_path", "reason"])
    new = r.files.select("sha1", F.concat(F.lit("again/"), "sha1").alias("quarantine_path"), "size", F.lit("duplicate").alias("reason"), F.lit(None).cast("string").alias("collection_name"))
    return merges.insert_or_ignore(left, new, ["sha1"], ["quarantine_path"])


@query("select coalesce(m.to_source,l.source) as source, coalesce(m.to_path,l.path) as path, l.archive_path, l.sha1 from c_locations l left join (select distinct source, path, 'moved' as to_source, source||'/'||path as to_path from c_locations where archive_path is not null) m on m.source=l.source and m.path=l.path", "c_locations")
def w5_relocate(r):
    moves = r.locations.where("archive_path is not null").select("source", "path", F.lit("moved").alias("to_source"), F.concat_ws("/", "source", "path").alias("to_path")).distinct()
    return merges.relocate(r.locations, moves).select("source", "path", "archive_path", "sha1")


@query("select source, path, archive_path, sha1 from c_locations l where not exists (select 1 from c_locations g where g.source='src1' and g.source=l.source and g.path=l.path)", "c_locations")
def w6_remove_locations(r):
    return merges.remove(r.locations, r.locations.where("source = 'src1'"), ["source", "path"]).select("source", "path", "archive_path", "sha1")


@query("""select sha1, any_value(b.payload) as sha1_no_header, any_value(f.md5) as md5, any_value(coalesce(b.crc,f.crc32)) as crc32, any_value(f.size) as size from c_files f
  left join (select upper(sha1(text)) as sha1, max(upper(sha1(substr(text,17)))) as payload, max(substr(upper(md5(text)),9,8)) as crc from documents where doc_id % 2 = 0 group by 1) b using (sha1) group by 1""", "c_files")
def w3_upsert_files(r):
    """A second scan knows other check sums and hashes without a header; sizes stay as first seen."""
    old = r.files.withColumn("sha1_no_header", F.lit(None).cast("string"))
    again = r.documents.where("doc_id % 2 = 0").selectExpr("upper(sha1(text)) as sha1", "upper(sha1(substr(text,17))) as sha1_no_header", "substr(upper(md5(text)),9,8) as crc32", "0L as size", "1L as seq")
    again = again.join(old.select("sha1"), "sha1", "left_semi")
    return merges.upsert_files(old, again, "seq").select("sha1", "sha1_no_header", "md5", "crc32", "size")


@query("""select source, path, archive_path, max(case when seq=m then sha1 end) as sha1 from (select *, max(seq) over (partition by source, path, archive_path) as m from (
  select source, path, archive_path, sha1, -1 as seq from c_locations union all select source, path, archive_path, reverse(sha1), 1 from c_locations where source<>'src1' union all select 'new', path, archive_path, max(sha1), 2 from c_locations group by 2,3)) group by 1,2,3""", "c_locations")
def w4_upsert_locations(r):
    place = r.locations.select("source", "path", "archive_path", "sha1")
    seen = place.where("source <> 'src1'").withColumns({"sha1": F.reverse("sha1"), "seq": F.lit(1).cast("long")})
    fresh = place.groupBy("path", "archive_path").agg(F.max("sha1").alias("sha1")).select(F.lit("new").alias("source"), "path", "archive_path", "sha1", F.lit(2).cast("long").alias("seq"))
    return merges.upsert_locations(place, seen.unionByName(fresh), "seq")


@query("select coll, case when name='EN - Documents' then 'English' else name end as name, case when coll in ('de','fr') then node_path||'/'||name else node_path end as node_path from c_collections", "c_collections")
def w9_rename_and_nest(r):
    nested = versions.nest_under_name(r.collections, ["DE - Documents", "FR - Documents"])
    return versions.rename(nested, "EN - Documents", "English").select("coll", "name", "node_path")


@query("""select f.file, case when n is null then 'missing' when n>1 then 'ambiguous' else 'relinked' end as state, case when n=1 then p.path end as path from (select distinct lang||'.dat' as file from documents union select 'src1.dat') f
  left join (select split_part(path,'/',-1) as file, count(*) as n, min(path) as path from head where path like 'src1/%' or path='src2/en.dat' group by 1) p on p.file=f.file""", "c_collections", more=HEADS)
def w11_relink(r):
    wanted = r.documents.select(F.concat("lang", F.lit(".dat")).alias("file")).distinct().union(r.spark.createDataFrame([("src1.dat",)], "file string"))
    return versions.relink(wanted, _heads(r).where("path like 'src1/%' or path = 'src2/en.dat'").select("path"))


@query("""select coll, name, case when wanted=name then 'same' when count(*) over (partition by wanted)>1 then 'conflict' else 'renamed' end as state, wanted
  from (select *, case when coll='en' then 'DE - Documents' when coll='fr' then 'French' else name end as wanted from c_collections)""", "c_collections")
def w12_repair_names(r):
    parsed = r.collections.select("coll", F.when(F.col("coll") == "en", "DE - Documents").when(F.col("coll") == "fr", "French").alias("parsed"))
    return versions.repair_names(r.collections, parsed).select("coll", "name", "state", "wanted")


@query("select sha1, path, path='z' or starts_with(path,'z/') as inside, case when length(path)>8 then '...'||right(path,5) else path end as short from c_locations", "c_locations")
def f6_under(r):
    return r.locations.select("sha1", "path", scalars.under(F.col("path"), F.lit("z/")).alias("inside"), scalars.shortened(F.col("path"), 8).alias("short"))


@query("select coll, game, repeat('#',cast(floor(g*20/n) as integer))||repeat('-',20-cast(floor(g*20/n) as integer)) as bar from (select coll, game, count(*) filter (status='good') as g, count(*) as n from c_roms group by 1,2)", "c_roms")
def c5_bars(r):
    per = r.roms.groupBy("coll", "game").agg(F.count_if(F.col("status") == "good").alias("g"), F.count(F.lit(1)).alias("n"))
    return per.select("coll", "game", scalars.bar(F.col("g"), F.col("n")).alias("bar"))


@query("select name, output_format from c_config_rows", "c_collections", "c_config", more="c_config_rows as (select path_pattern as name, output_format from c_config where output_format is not null)")
def f16_formats_listed(r):
    return r.config.where("output_format is not null").select(F.col("path_pattern").alias("name"), "output_format").orderBy("name")


@query("select coll, title, count(*) as n, string_agg(game, '|' order by game) as names from (select *, regexp_extract(game,'^[^(]*[^( ]') as title from c_names) group by 1,2 having count(*)>1", "c_names")
def a24_titles(r):
    titled = r.names.withColumn("title", F.regexp_extract("game", "^[^(]*[^( ]", 0))
    return planner.titles(titled).select("coll", "title", "n", F.array_join("names", "|").alias("names"))


@query("select sha256(from_hex((select string_agg(lpad(to_hex(n),2,'0')||'00000000000000', '' order by n) from (select row_number() over (order by name) as n from c_collections)))||from_hex(lpad(to_hex((select count(*) from c_locations) % 256),2,'0'))||from_hex(lpad(to_hex((select count(*) from c_locations) // 256),2,'0'))||from_hex('000000000000')||encode((select max(source) from c_locations))||encode((select string_agg(path_pattern||coalesce(dest_path,''),'' order by path_pattern) from c_config))) as state_hash", "c_locations", "c_config", "c_collections")
def c9_state_hash(r):
    ids = numbered(r.collections, [F.desc("name")], "n").select((F.lit(1) + F.col("n")).alias("id"))
    return planner.state_hash(ids, r.locations, r.config, "source")


@query("select upper(sha1(text)) as sha1, upper(md5(text)) as md5, doc_id from documents")
def s29_hashes(r):
    found = files.hashes(r.documents.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")))
    return found.select(F.col("path").cast("long").alias("doc_id"), "sha1", "md5")


DOC_FILE = "concat('d/',doc_id,'.txt')"
TORRENTS = """tf as (select lang as torrent, concat('d/',doc_id,'.txt') as path, text, strlen(text) as length from documents),
tw as (select torrent, string_agg(hex(text), '' order by path) as h, cast(sum(length) as bigint) as total, count(*) as n_files, string_agg('d6:lengthi'||length||'e4:pathl1:d'||(strlen(path)-2)||':'||path[3:]||'ee', '' order by path) as names from tf group by 1),
tp as (select *, cast(least(greatest(power(2, ceil(log2(greatest(total//1500,1)))),16384),16777216) as bigint) as p from tw),
pieces as (select torrent, k as piece, sha1(unhex(substr(h, k*p*2+1, p*2))) as sha1 from tp, lateral (select unnest(range(0, (total+p-1)//p)) as k))"""


def _torrent_files(r):
    own = r.documents.select(F.col("lang").alias("torrent"), F.expr(DOC_FILE).alias("path"), F.col("text").cast("binary").alias("content"))
    return torrents.placed(own.withColumn("length", F.octet_length("content")))


def _torrents(r):
    own = _torrent_files(r)
    return torrents.metadata(own.drop("content"), torrents.pieces_of_contents(own), ("udp://a", "udp://b"), "all texts")


@query("select * from pieces", "c_collections", more=TORRENTS)
def w20_torrent_pieces(r):
    return torrents.pieces_of_contents(_torrent_files(r))


@query("""select torrent, n_files, total, p as piece_length, n_pieces, sha1(encode('d5:filesl'||names||'e4:name'||strlen(torrent)||':'||torrent||'12:piece lengthi'||p||'e6:pieces'||(20*n_pieces)||':')||unhex(raw)||encode('e')) as info_hash
  from tp join (select torrent, count(*) as n_pieces, string_agg(sha1, '' order by piece) as raw from pieces group by 1) using (torrent)""", "c_collections", more=TORRENTS)
def w20_torrents(r):
    return _torrents(r).drop("content")


CHECKED = """listing as (select concat(lang,'/d/',doc_id,'.txt') as path, strlen(text)+case when doc_id%5=0 then 1 else 0 end as actual from documents where doc_id%7<>0),
checked as (select e.torrent||'.torrent' as source, e.torrent||'/'||e.path as path, case when l.path is null then 'missing' when l.actual=e.length then 'found' else 'wrong size' end as state, e.length as expected, l.actual from tf e left join listing l on l.path=e.torrent||'/'||e.path)"""


def _checked(r):
    """What the torrents' own bytes say of their files, against a tree that lacks some and has others longer."""
    parsed = torrents.read(_torrents(r).select(F.concat("torrent", F.lit(".torrent")).alias("path"), "content"))
    size = F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    listing = r.documents.where("doc_id % 7 <> 0").select(F.concat_ws("/", "lang", F.expr(DOC_FILE)).alias("path"), size.cast("long").alias("size"))
    return torrents.check(torrents.entries(parsed), listing)


@query("select * from checked", "c_collections", more=TORRENTS + ",\n" + CHECKED)
def j16_torrent_check(r):
    return _checked(r)


@query("select source, count(*) as files, count(*) filter (state='found') as found, count(*) filter (state='missing') as missing, count(*) filter (state='wrong size') as wrong_size, cast(floor(count(*) filter (state='found')*100/count(*)) as bigint) as percent from checked group by 1", "c_collections", more=TORRENTS + ",\n" + CHECKED)
def j16_torrent_report(r):
    return torrents.report(_checked(r))


def _tree(r):
    """The texts as files below a new folder, half of them with a header that scans know."""
    root = f"{shared_folder(r.spark)}/tree-{uuid.uuid4().hex}"
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"NES\x1a"), F.lit(bytes(12)))).otherwise(F.lit(b"")), F.when(F.col("doc_id") % 10 != 1, F.col("text").cast("binary")).otherwise(F.lit(b"")))
    trees.write_files(r.documents.select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".bin"))).alias("path"), content.alias("content")), root)
    return root


@query("""select concat(source,'/',lang,'/',doc_id,'.bin') as path, octet_length(b) as size, upper(sha1(b)) as sha1, upper(md5(b)) as md5, case when doc_id%2=0 and length(text)>0 then upper(sha1(text)) end as sha1_no_header
  from (select *, case when doc_id%2=0 then from_hex('4E45531A000000000000000000000000')||encode(text) when doc_id%10=1 then encode('') else encode(text) end as b from documents)""")
def s21_scanned_files(r):
    """Texts become files, a tenth of them empty; a scan lists and hashes them."""
    root = _tree(r)
    return trees.hash_files(trees.listed(r.spark, root), root).select("path", "size", "sha1", "md5", "sha1_no_header")


@query("select lang, count(*) as files, cast(sum(case when doc_id%2=0 then 16+strlen(text) when doc_id%10=1 then 0 else strlen(text) end) as bigint) as bytes from documents where source='src1' group by 1")
def s23_scanned_folder(r):
    """Only a folder of the tree is listed."""
    found = trees.listed(r.spark, _tree(r), "src1")
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


DRAINED = "select p.*, o.name from pk p join gp g on g.coll=p.coll and g.game=p.game and g.build_from=p.spot join c_goals o on o.coll=p.coll where g.drains and p.archive_path is not null"
WHOLE = """c_held as (select m.coll, m.game, m.rom, m.is_disk, m.sha1, m.size, s.path as root, s.disposition, l.path, l.archive_path from c_match m join c_locations l on l.sha1=m.sha1 join c_sources s on s.source=l.source),
""" + ALL_OPS + f""",
dr as ({DRAINED}),
allops as (select coll, kind, source, archive_path, dest, size, case when kind='repack' then null else reason end as reason, kind='repack' and reason is not null as moves from ops
  union all select null, 'drain', spot, null, null, 0, 'consolidated into '||arg_min(dest, row(name, game, rom, sha1, dest)), false from dr group by spot),
numd as (select row_number() over (order by kind='drain', coll, dest, source nulls last, kind, archive_path nulls last)-1 as op_id, * from allops)"""
WHOLE_PLAN = ("c_match", "c_locations", "c_sources", "c_goals")


def _whole_plan(r):
    """From what manifests ask for and where contents lie to operations, with no step prepared."""
    given = plans.Catalogue(r.goals, active(r.versions), active(r.roms), r.files, r.locations, r.sources)
    return plans.plan(given, LIBRARY)


@query("select op_id, coll, kind, source, dest, size, case when kind='repack' then moves end as move_sources, reason from numd", *WHOLE_PLAN, more=WHOLE)
def l1_plan(r):
    return _whole_plan(r).operations.drop("format")


@query("""select n.kind, n.dest, p.spot as path, p.archive_path, p.sha1, p.rom as entry_name from numd n join gp g on g.coll=n.coll and g.dest=n.dest join (select distinct coll, game, spot, archive_path, sha1, rom from pk) p on p.coll=g.coll and p.game=g.game and (g.build_from is null or p.spot=g.build_from) where n.kind='repack'
  union all select n.kind, n.dest, k.spot, k.archive_path, k.sha1, null from numd n join rk k on k.coll=n.coll and k.dest=n.dest and k.nth=1 where n.kind in ('copy','move')""", *WHOLE_PLAN, more=WHOLE)
def l6_operation_sources(r):
    made = _whole_plan(r)
    return made.sources.join(made.operations.select("op_id", "kind", "dest"), "op_id").drop("op_id")


@query("""select op_id, kind, source, case when kind<>'delete' then dest end as dest, size, (select count(*) from (select distinct coll, game, spot, archive_path, sha1, rom from pk) p join gp g on p.coll=g.coll and p.game=g.game and (g.build_from is null or p.spot=g.build_from) where n.kind='repack' and g.coll=n.coll and g.dest=n.dest)+case when kind in ('copy','move') then 1 else 0 end as sources,
  (select count(distinct archive_path) from dr where n.kind='drain' and dr.spot=n.source) as entries from numd n""", *WHOLE_PLAN, more=WHOLE)
def s34_saved_plan(r):
    """The plan is saved, found as the newest one and read again."""
    root = f"{shared_folder(r.spark)}/plans-{uuid.uuid4().hex}"
    plans.save(_whole_plan(r), root, "first")
    operations, sources, rebuilds = plans.load_newest(r.spark, root)
    count = lambda df, name: df.groupBy("op_id").agg(F.count(F.lit(1)).alias(name))
    met = operations.join(count(sources, "sources"), "op_id", "left").join(count(rebuilds, "entries"), "op_id", "left")
    return met.select("op_id", "kind", "source", "dest", "size", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sources", "entries")))


LISTED = "lst as (select concat(source,'/',lang,'.dat') as path, concat('Game ',doc_id%3) as game, concat('Doc ',doc_id) as description, concat('Game ',doc_id%2) as parent_name, concat('r',doc_id%4,'.rom') as rom, n_chars as size, upper(sha1(text)) as sha1, doc_id from documents)"
ADDED = "add as (select l.*, coalesce(c.coll,j.name) as coll, j.version from lst l join judged j on j.path=l.path and j.state='added' left join c_collections c on c.name=j.name)"


def _imported(r):
    """Manifests that list games and entries again and again, in the order of documents."""
    listed = r.spark.sql("select " + LISTED[LISTED.index("concat(source") : -1].replace("from documents", "from {documents}"), documents=r.documents)
    none, no = F.lit(None).cast("string"), F.lit(False)
    more = {"is_bios": no, "is_device": no, "is_mechanical": no, "md5": none, "crc32": none, "status": F.lit("good"), "merge_tag": none, "is_disk": no}
    entries = listed.withColumns(more).withColumn("ordinal", F.struct(F.lit(0).cast("long").alias("block"), F.col("doc_id").alias("row"), F.lit(0).alias("part"))).drop("doc_id")
    return imports.apply(imports.judge(_heads(r), r.collections, r.versions, "20260101"), r.collections, r.versions, r.games, r.roms, entries)


@query("select coll, version, game, cast(null as varchar) as description, parent_name from c_games union all select coll, version, game, arg_min(description, doc_id), arg_min(parent_name, doc_id) from add group by 1,2,3", "c_games", "c_collections", "c_versions", more=f"{JUDGED},\n{LISTED}, {ADDED}")
def w2_imported_games(r):
    return _imported(r)[2].select("coll", "version", "game", "description", "parent_name")


@query("select coll, version, game, rom, size, sha1 from c_roms union all select coll, version, game, rom, arg_min(size, doc_id), arg_min(sha1, doc_id) from add group by 1,2,3,4", "c_roms", "c_collections", "c_versions", more=f"{JUDGED},\n{LISTED}, {ADDED}")
def w1_imported_entries(r):
    return _imported(r)[3].select("coll", "version", "game", "rom", "size", "sha1")


PREFERRED = """par as (select coll, game, bool_or(parent_name is null) as is_parent from c_games where version='v2' group by 1,2),
named1 as (select *, trim(split_part(game,'(',1)) as title, case when game like '%(USA)%' then 2 when game like '%(Europe)%' then 3 else 4 end as usual, case when game like '%(Japan)%' then 1 when game like '%(Europe)%' then 2 else 99 end as own from par),
chosen as (select coll, title, game from named1 where coll='de' or coll='en' and game not like '%[b]%' qualify row_number() over (partition by coll, title order by not is_parent, case when coll='de' then own else usual end, game like '%(Rev %', game)=1)"""


def _preferences(r):
    return settings.preferences(r.collections, r.extra)


def _variants(r):
    return active(r.games).groupBy("coll", "game").agg(F.max(F.col("parent_name").isNull()).alias("is_parent"))


@query("select * from chosen", "c_games", more=PREFERRED)
def p11_preferred_games(r):
    """Each collection's own regions and exclusions, parents first."""
    return names.preferred_games(_variants(r), _preferences(r))


@query("select m.coll, m.game, m.rom, m.sha1 from c_match m where m.coll not in ('de','en') or (m.coll, m.game) in (select (coll, game) from chosen)", "c_match", "c_games", more=PREFERRED.replace("version='v2'", "version='v2' and (coll, game) in (select (coll, game) from c_match)"))
def p12_one_variant_matched(r):
    """The matched entries of one variant of a title, where a collection asks for that."""
    rows = r.match.select("coll", "game", "rom", "sha1").join(_variants(r), ["coll", "game"])
    return names.one_per_title(rows, _preferences(r)).drop("is_parent")


@query("""select coll, name, coalesce(coll in ('de','en'),false) as one_g_one_r, case when coll='de' then 'Japan,Europe' else 'World,USA,Europe,Japan,Australia,Canada,UK,France,Germany,Spain,Italy,Netherlands,Sweden,Brazil,Korea,China,Taiwan,Hong Kong,Russia,Asia,Scandinavia' end as regions, coll<>'de' as exclude_bad_dumps, false as exclude_prereleases from c_collections""", "c_collections")
def p13_preferences(r):
    return _preferences(r).select("coll", "name", "one_g_one_r", F.array_join("region_priority", ",").alias("regions"), "exclude_bad_dumps", "exclude_prereleases")


CHANGES = """chg as (select upper(lang)||' - Documents' as path_pattern, case doc_id%6 when 0 then 'regions' when 1 then '1g1r' when 2 then 'exclude_prereleases' when 3 then 'output_format' when 4 then 'merge_mode' else 'colour' end as key,
  case doc_id%6 when 0 then case when doc_id%4=0 then source||', x,,' else ' , ' end when 1 then case when doc_id%4=1 then 'ON' else 'maybe' end when 2 then 'disable' when 3 then case when doc_id%4=1 then '7Z' else 'rar' end else 'split' end as value, doc_id from documents),
ok as (select * from chg where key='regions' and value<>' , ' or key='1g1r' and value='ON' or key='output_format' and value='7Z' or key='merge_mode'),
last as (select path_pattern, arg_max(value, doc_id) filter (key='regions') as regions, max(value) filter (key='1g1r') as one, max(value) filter (key='output_format') as form, max(value) filter (key='merge_mode') as mode from ok group by 1)"""


def _changes(r):
    """Many changes of settings, most of one collection each, some of them wrong."""
    key = F.element_at(F.array(*[F.lit(k) for k in ("regions", "1g1r", "exclude_prereleases", "output_format", "merge_mode", "colour")]), (F.col("doc_id") % 6 + 1).cast("int"))
    rest = F.col("doc_id") % 4
    values = [F.when(rest == 0, F.concat("source", F.lit(", x,,"))).otherwise(" , "), F.when(rest == 1, "ON").otherwise("maybe"), F.lit("disable"), F.when(rest == 1, "7Z").otherwise("rar"), F.lit("split"), F.lit("split")]
    return r.documents.select(F.concat(F.upper("lang"), F.lit(" - Documents")).alias("path_pattern"), key.alias("key"), F.element_at(F.array(*values), (F.col("doc_id") % 6 + 1).cast("int")).alias("value"), "doc_id")


@query("""select coalesce(e.path_pattern, l.path_pattern) as path_pattern, coalesce(form, output_format) as output_format, coalesce(mode, merge_mode) as merge_mode,
  case when regions is not null then split_part(regions,',',1)||'|x' when e.path_pattern='DE - Documents' then 'Japan|Europe' when one is not null then '' end as regions, case when one is not null or e.path_pattern in ('DE - Documents','EN - Documents') then true when regions is not null then false end as one_g_one_r
  from c_extra e full join last l on l.path_pattern=e.path_pattern""", "c_extra", more=CHANGES)
def w14_changed_settings(r):
    """Settings after all good changes, in the order of documents; JSON is read, merged and written."""
    found = F.from_json("config_json", settings.EXTRA)
    made = settings.changed(r.extra, _changes(r), "doc_id")
    return made.select("path_pattern", "output_format", "merge_mode", F.array_join(found["region_priority"], "|").alias("regions"), found["one_g_one_r"].alias("one_g_one_r"))


@query("select key, count(*) as n, count(*) filter ((path_pattern, key, value, doc_id) not in (select (path_pattern, key, value, doc_id) from ok)) as refused from chg group by 1", "c_collections", more=CHANGES)
def w14_refused_settings(r):
    return settings.judged(_changes(r)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("refused"))


@query("""select l.source, l.path, 'loose' as kind, f.size as bytes from c_locations l join c_sources s on s.source=l.source and s.disposition='consume' join c_files f on f.sha1=l.sha1 where l.archive_path is null and l.sha1 in (select sha1 from twice)
  union all select l.source, l.path, 'container', cast(sum(f.size) as bigint) from c_locations l join c_sources s on s.source=l.source and s.disposition='consume' join c_files f on f.sha1=l.sha1 where l.archive_path is not null group by 1,2 having bool_and(l.sha1 in (select sha1 from twice))""", "c_locations", "c_sources", "c_files", more=ELSEWHERE)
def l12_reclaim(r):
    return matching.reclaim(r.locations, r.files, r.sources)


STAT0 = _stats_sql("non-merged")


@query("""select node, count(*) as leaves, count(*) filter (coll<>'es') as active_leaves, count(*) filter (coll<>'es') as resolved, cast(coalesce(sum(total_games),0) as bigint) as games, cast(coalesce(sum(have_roms),0) as bigint) as have, cast(coalesce(sum(total_roms-have_roms),0) as bigint) as missing,
  cast(coalesce(sum(to_write),0) as bigint) as to_write, cast(coalesce(sum(bytes),0) as bigint) as bytes, case when count(*) filter (coll<>'es')>0 then case when sum(total_roms)>0 then sum(have_roms)*100.0/sum(total_roms) else 0.0 end end as percent
  from (select c.coll, c.node_path, s.total_games, s.have_roms, s.total_roms, q.to_write, q.bytes, unnest([split_part(c.node_path,'/',1), c.node_path]) as node from c_collections c left join (select * from stat where coll<>'es') s on s.coll=c.coll left join (select coll, size as to_write, size*10 as bytes from (select coll, count(*) as size from c_games group by 1)) q on q.coll=c.coll and c.coll<>'fr') group by 1""", *_USED, **_STATUS)
def a9_library_tree(r):
    """One collection has no active version, and another no pending work."""
    has = r.collections.withColumn("has_active", F.col("coll") != "es")
    work = r.games.groupBy("coll").agg(F.count(F.lit(1)).alias("to_write")).join(r.collections.select("coll", "name"), "coll").where("coll <> 'fr'")
    return completeness.library_tree(has, _status(r).where("coll <> 'es'"), work.select("name", "to_write", (F.col("to_write") * 10).alias("bytes")))


def _damaged(r):
    """No active version of one collection, one version gone, and entries of missing games."""
    lost = r.versions.where("not (coll='fr' and version='v1')").withColumn("is_active", F.col("is_active") & (F.col("coll") != "de"))
    kinds = settings.disk_only(active(r.versions), r.roms).select("coll", "disk_only")
    placed = r.collections.join(kinds, "coll").withColumns({"root": F.concat(F.lit("/dest/"), scalars.top_segment(F.col("node_path"))), "dest_path": F.when(F.col("coll") == "en", F.lit("/dest/SETA"))})
    return lost, r.games.where("not is_bios"), placed


def _repaired(r):
    lost, games, placed = _damaged(r)
    return reports.repair(r.collections, lost, games, r.roms, placed)


DAMAGED = """lostv as (select coll, version, is_active and coll<>'de' as is_active, imported_seq from c_versions where not (coll='fr' and version='v1')), fewg as (select * from c_games where not is_bios),
keptg as (select * from fewg where (coll, version) in (select (coll, version) from lostv)), keptr as (select * from c_roms where (coll, version, game) in (select (coll, version, game) from keptg))"""
_ALL = ("c_collections", "c_versions", "c_games", "c_roms")


@query("select coll, version, is_active or (coll='de' and version='v2') as is_active from lostv", *_ALL, more=DAMAGED)
def l15_repaired_versions(r):
    return _repaired(r).versions.select("coll", "version", "is_active")


@query("select coll, version, game, rom from keptr", *_ALL, more=DAMAGED)
def l15_repaired_entries(r):
    return _repaired(r).roms.select("coll", "version", "game", "rom")


@query("select coll, name, case when coll='en' then node_path else node_path||'/'||name end as node_path from c_collections", *_ALL)
def l15_nested_collections(r):
    return _repaired(r).collections.select("coll", "name", "node_path")


@query("""select 'activated' as fix, 1 as n union all select 'games removed', (select count(*) from fewg)-(select count(*) from keptg) union all select 'entries removed', (select count(*) from c_roms)-(select count(*) from keptr) union all select 'nested', (select count(*)-1 from c_collections)""", *_ALL, more=DAMAGED)
def l15_fixes(r):
    return _repaired(r).fixes


@query("""select 'no_active_version' as "check", 1 as faults union all select 'several_active_versions', 0 union all select 'games_without_version', (select count(*) from fewg)-(select count(*) from keptg)
  union all select 'roms_without_game', (select count(*) from c_roms where (coll, version, game) not in (select (coll, version, game) from fewg)) union all select 'places_without_content', (select count(*) from c_locations where sha1 not in (select sha1 from c_files where size>=500))
  union all select 'places_without_source', (select count(*) from c_locations where source='src3') union all select 'shared_destinations', 0""", *_ALL, "c_files", "c_locations", more=DAMAGED)
def l15_checks(r):
    lost, games, _ = _damaged(r)
    return reports.doctor(r.collections, lost, games, r.roms, r.files.where("size >= 500"), r.locations, r.sources.where("source <> 'src3'"))


@query("""select sha1, any_value(b.payload) as sha1_no_header, any_value(f.md5) as md5, any_value(coalesce(b.crc,f.crc32)) as crc32, any_value(f.size) as size from c_files f
  left join (select upper(sha1(text)) as sha1, max(upper(sha1(substr(text,17)))) as payload, max(substr(upper(md5(text)),9,8)) as crc from documents where doc_id % 50 = 0 group by 1) b using (sha1) group by 1""", "c_files")
def w3_stored_files(r):
    """The contents are stored, and a second scan of some changes only the parts that they fall in."""
    path = f"{shared_folder(r.spark)}/files-{uuid.uuid4().hex}"
    merges.stored(r.files.withColumn("sha1_no_header", F.lit(None).cast("string")), path, ["sha1"])
    again = r.documents.where("doc_id % 50 = 0").selectExpr("upper(sha1(text)) as sha1", "upper(sha1(substr(text,17))) as sha1_no_header", "cast(null as string) as md5", "substr(upper(md5(text)),9,8) as crc32", "0L as size", "1L as seq")
    again = again.join(r.files.select("sha1"), "sha1", "left_semi")
    merges.upsert_stored(r.spark, path, again, ["sha1"], lambda old, new: merges.upsert_files(old, new, "seq"))
    return merges.read_stored(r.spark, path).select("sha1", "sha1_no_header", "md5", "crc32", "size")


@query("""select line, row_number() over (order by line) - 1 as place from (select s.path||'/'||u.path as line from unk u join c_sources s on s.source=u.source)""", "c_roms", "c_files", "c_locations", "c_sources", more=UNMATCHED)
def w17_unknown_report(r):
    """The report of unknown files is written and read again, a line for each file in order."""
    path = f"{shared_folder(r.spark)}/unknown-{uuid.uuid4().hex}"
    reports.write_lines(reports.unknown_lines(matching.unknown_files(r.locations, r.files, active(r.roms)), r.sources), path, ["line"])
    back = r.spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return numbered(back, ["file", "block", "nth"], "place").select("line", "place")


@query("select concat('packed/',source,'.zip') as path, concat('e',doc_id,'.bin') as archive_path, strlen(text) as size, upper(sha1(text)) as sha1, true as stamped from documents")
def w19_packed_archives(r):
    """Texts lie as files, repacks gather those of a source into an archive, and the archives are read again."""
    root = f"{shared_folder(r.spark)}/packed-{uuid.uuid4().hex}"
    loose = r.documents.select("source", "doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    trees.write_files(loose, root)
    ids = r.documents.select("source").distinct().select("source", F.xxhash64("source").alias("op_id"))
    ops = ids.select("op_id", F.lit("repack").alias("kind"), F.concat(F.lit("packed/"), "source", F.lit(".zip")).alias("dest"), F.lit("torrentzip").alias("format"), F.lit(0).cast("long").alias("size"))
    parts = loose.join(ids, "source").select("op_id", "path", F.lit(None).cast("string").alias("archive_path"), F.upper(F.sha1("content")).alias("sha1"), F.concat(F.lit("e"), "doc_id", F.lit(".bin")).alias("entry_name"))
    archives.build(ops, parts, root)
    listing = trees.listed(r.spark, root, "packed")
    stamps = trees.stamped(listing, trees.zip_directory(listing, root))
    return archives.entry_hashes(listing, root).select("path", "archive_path", "size", "sha1").join(stamps, "path")


@query("""select r.coll, r.game, r.rom, r.sha1 from c_roms r where r.version='v2' and (r.sha1 is null or r.sha1 not in (select sha1 from c_locations))""", "c_roms", "c_locations")
def f14_missing_export(r):
    return reports.exported(reports.export(active(r.roms), r.locations, r.sources), "missing").select("coll", "game", "rom", "sha1")


@query("""select 'collections' as listing, name as item, row_number() over (order by name)-1 as place from c_collections union all select 'sources', path, row_number() over (order by path)-1 from c_sources
  union all select 'config', path_pattern, row_number() over (order by path_pattern)-1 from c_config union all select 'versions', coll||version, row_number() over (order by coll, imported_seq desc)-1 from c_versions
  union all select 'games', game, row_number() over (order by coll, version, game)-1 from c_games union all select 'entries', game||rom, row_number() over (order by coll, version, game, rom)-1 from c_roms
  union all select 'quarantine', quarantine_path, row_number() over (order by size desc, quarantine_path)-1 from c_quarantine""", "c_collections", "c_sources", "c_config", "c_versions", "c_games", "c_roms", "c_quarantine")
def f16_listings(r):
    """Sizes stand for the times at which files were put away."""
    own = ["coll", "version"]
    put = r.quarantine.withColumn("quarantined_seq", F.col("size"))
    listings = {
        "collections": (reports.listing(r.collections, "collections"), "name"), "sources": (reports.listing(r.sources, "sources"), "path"), "config": (reports.listing(r.config, "config"), "path_pattern"),
        "versions": (reports.listing(r.versions, "versions", ["coll"]), F.concat("coll", "version")), "games": (reports.listing(r.games, "games", own), "game"),
        "entries": (reports.listing(r.roms, "entries", own), F.concat("game", "rom")), "quarantine": (reports.listing(put, "quarantine", ties=["quarantine_path"]), "quarantine_path"),
    }
    out = None
    for kind, (rows, item) in listings.items():
        one = rows.select(F.lit(kind).alias("listing"), (F.col(item) if isinstance(item, str) else item).alias("item"), "place")
        out = one if out is None else out.union(one)
    return out


@query("select r.coll, r.version, r.game, r.rom, g.parent_name, v.is_active, c.node_path from c_roms r join c_games g using (coll, version, game) join c_versions v using (coll, version) join c_collections c using (coll)", "c_roms", "c_games", "c_versions", "c_collections")
def j1_entries_in_place(r):
    return versions.required(r.roms, r.games, r.versions, r.collections).select("coll", "version", "game", "rom", "parent_name", "is_active", "node_path")


@query("select coll, arg_max(version, imported_seq) as version from c_versions group by 1", "c_versions")
def n5_newest_versions(r):
    return versions.newest(r.versions)


@query("select coll, name, node_path from c_collections where coll<>'fr'", "c_collections")
def w10_removed_collection(r):
    """All versions of a collection go, and it with them."""
    return versions.removed(r.collections, r.versions, "FR - Documents", all_versions=True)[0]


@query("select coll, version, is_active from c_versions where not (coll='de' and version='v1')", "c_versions")
def w10_removed_version(r):
    return versions.removed(r.collections, r.versions, "DE - Documents:v1")[1].select("coll", "version", "is_active")


#: Endings of names and what they say: regions, languages, revision, unfinished, verified, bad, flags, original.
ENDINGS = [
    (" (USA, Europe)", "USA,Europe", "", None, False, False, False, "", True), (" (JP-US) (Rev 2)", "Japan,USA", "", "Rev 2", False, False, False, "", True), (" (world) (Beta)", "World", "", None, True, False, False, "", True),
    (" (DE) (De) [!]", "Germany", "De", None, False, True, False, "", True), (" (USA) (En) (v1.1) [b]", "USA", "En", "v1.1", False, False, True, "b", True), (" [cr Them][h]", "", "", None, False, False, False, "cr,h", False),
    (" (Prototype) [a]", "", "", None, True, False, False, "a", True), (" (Nowhere (USA) here)", "", "", None, False, False, False, "", True), (" (Virgin) (UK)", "UK", "", "Virgin", False, False, False, "", True),
    ("", "", "", None, False, False, False, "", True), (" (Korea, Nowhere) [b bad]", "Korea", "", None, False, False, True, "b", True), (" (demo) [t] [f1]", "", "", None, True, False, False, "t", False),
]
_QUOTED = ", ".join("(" + ", ".join([str(i)] + ["null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in row]) + ")" for i, row in enumerate(ENDINGS))


@query(f"""select doc_id, 'Title '||doc_id as title, regions, languages, revision, is_prerelease, verified, bad_dump, flags, is_original from documents join (values {_QUOTED}) t(k, ending, regions, languages, revision, is_prerelease, verified, bad_dump, flags, is_original) on k=doc_id%{len(ENDINGS)}""")
def p2_name_parts(r):
    """Names of many shapes: nested brackets, lists, codes, languages, revisions and flags."""
    ending = F.element_at(F.array(*[F.lit(e[0]) for e in ENDINGS]), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    parsed = names.with_parsed_name(r.documents.select("doc_id", F.concat(F.lit("Title "), "doc_id", ending).alias("name")), "name")
    joined = {c: F.array_join(c, ",").alias(c) for c in ("regions", "languages", "flags")}
    return parsed.select("doc_id", "title", *(joined.get(c, F.col(c)) for c in ("regions", "languages", "revision", "is_prerelease", "verified", "bad_dump", "flags", "is_original")))


@query("""select doc_id, case when doc_id%3=0 then '/Volumes/'||source else '/' end as volume, upper(hex(text[1:4])) as first_bytes, repeat('#',doc_id%21)||repeat('-',20-doc_id%21) as bar, case when length(source||lang)>5 then '...'||right(source||lang,2) else source||lang end as short from documents""")
def c8_small_expressions(r):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/Volumes/"), "source", F.lit("/x/y"))).otherwise(F.concat(F.lit("/home/"), "source"))
    both = F.concat("source", "lang")
    return r.documents.select("doc_id", planner.volume(path).alias("volume"), F.hex(F.encode(F.substring("text", 1, 4), "UTF-8")).alias("first_bytes"), scalars.bar(F.col("doc_id") % 21, F.lit(20)).alias("bar"), scalars.shortened(both, 5).alias("short"))


@query("select dir from prd where not exists (select 1 from prf where starts_with(prf.path, prd.dir||'/'))", "c_locations",
  more="prf as (select source||'/'||path as path from c_locations where archive_path is null and source not in ('src2','src4')), prd as (select distinct unnest([source, source||'/'||split_part(path,'/',1)]) as dir from c_locations)")
def f18_prunable_folders(r):
    """Folders that hold nothing once some sources are empty and archives are gone."""
    at = F.concat_ws("/", "source", "path")
    dirs = r.locations.select(F.explode(F.array(F.col("source"), F.concat_ws("/", "source", F.split_part("path", F.lit("/"), F.lit(1))))).alias("dir")).distinct()
    return reports.prunable_dirs(r.locations.where("archive_path is null and source not in ('src2', 'src4')").select(at.alias("path")), dirs)


@query("""select 'files' as kind, sha1 as item from c_files where sha1 in (select upper(sha1(text)) from documents where doc_id%3=0) union all select 'roms', coll||version||rom from c_roms where sha1 in (select upper(sha1(text)) from documents where doc_id%3=0)
  union all select 'games', coll||version||game from c_games where version='v2' and game like 'Title 1%' union all select 'collections', coll from c_collections where name='DE - Documents' union all select 'sources', source from c_sources where path='/stage/src2'""", "c_files", "c_roms", "c_games", "c_collections", "c_sources")
def f15_lookups(r):
    """Single rows by their keys, for as many keys as are asked for."""
    hashes = r.documents.where("doc_id % 3 = 0").select(F.upper(F.sha1("text")).alias("sha1"))
    one = lambda column, value: r.spark.createDataFrame([(value,), ("none",)], f"{column} string")
    wanted = {
        "files": (r.files, hashes, F.col("sha1")), "roms": (r.roms, hashes, F.concat("coll", "version", "rom")), "collections": (r.collections, one("name", "DE - Documents"), F.col("coll")),
        "games": (r.games, active(r.games).where("game like 'Title 1%'"), F.concat("coll", "version", "game")), "sources": (r.sources, one("path", "/stage/src2"), F.col("source")),
    }
    out = None
    for kind, (rows, keys, item) in wanted.items():
        found = reports.lookup(rows, kind, keys).select(F.lit(kind).alias("kind"), item.alias("item"))
        out = found if out is None else out.union(found)
    return out


def _manifests(r):
    """The texts' hashes as manifests of up to 300 documents, in XML or nested blocks, below a new folder."""
    root = f"{shared_folder(r.spark)}/manifests-{uuid.uuid4().hex}"
    docs = r.documents.select("source", "doc_id", F.floor(F.col("doc_id") / 300).alias("part"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"), F.octet_length("text").alias("n"))
    xml = F.format_string(
        '<%s name="G &amp; %d"%s isbios="%s"><description> Doc %d </description><rom name="r.bin" size="%d" sha1="%s" md5="%s" status="%s"/>%s</%s>\n',
        F.when(F.col("doc_id") % 2 == 0, "game").otherwise("machine"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ' cloneof="P"').otherwise(""), F.when(F.col("doc_id") % 7 == 0, "yes").otherwise("no"), "doc_id", "n", "sha1", "md5",
        F.when(F.col("doc_id") % 3 == 0, "NoDump").otherwise("verified"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('<disk name="d" sha1="'), "sha1", F.lit('"/>'))).otherwise(""), F.when(F.col("doc_id") % 2 == 0, "game").otherwise("machine"),
    )
    block = F.format_string(
        'game ( name "G & %d" %s description "Doc %d" rom ( name r.bin size %d sha1 %s md5 %s flags %s ) )\n',
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "cloneof P").otherwise("; no parent\n"), "doc_id", "n", "sha1", "md5", F.when(F.col("doc_id") % 3 == 0, "nodump").otherwise("good"),
    )
    is_xml = F.substring("source", -1, 1).isin("0", "2", "4", "6", "8")
    each = docs.groupBy("source", "part").agg(F.array_join(F.array_sort(F.collect_list(F.when(is_xml, xml).otherwise(block))), "").alias("games"))
    head = F.format_string('<?xml version="1.0"?>\n<datafile><header><name>%s - %d</name><version>v%d</version><author>No-Intro</author><url> http://x </url></header>\n', "source", "part", "part")
    told = F.format_string('clrmamepro (\n name "%s - %d" version v%d author me homepage here )\n', "source", "part", "part")
    text = F.when(is_xml, F.concat(head, "games", F.lit("</datafile>"))).otherwise(F.concat(told, "games"))
    name = F.concat_ws("/", "source", F.concat("part", F.when(is_xml, ".xml").otherwise(".dat")))
    trees.write_files(each.select(name.alias("path"), text.cast("binary").alias("content")), root)
    return root


MANIFEST = "m as (select *, right(source,1) in ('0','2','4','6','8') as is_xml, cast(doc_id//300 as bigint) as part from documents)"


@query(f"""with {MANIFEST} select 'G & '||doc_id as game, 'Doc '||doc_id as description, case when doc_id%5=0 then 'P' end as parent_name, is_xml and doc_id%7=0 as is_bios, 'r.bin' as rom, strlen(text) as size, upper(sha1(text)) as sha1, upper(md5(text)) as md5, case when doc_id%3=0 then 'nodump' else 'good' end as status, false as is_disk from m
  union all select 'G & '||doc_id, 'Doc '||doc_id, case when doc_id%5=0 then 'P' end, doc_id%7=0, 'd', 0, upper(sha1(text)), null, 'good', true from m where is_xml and doc_id%4=0""")
def s2_manifest_entries(r):
    """Manifests in both formats are written and read: games and machines, entries and disks, comments and escapes."""
    found = manifests.entries(r.spark, _manifests(r))
    return found.select("game", "description", "parent_name", "is_bios", "rom", "size", "sha1", "md5", "status", "is_disk")


@query(f"""with {MANIFEST} select distinct source||' - '||part as name, 'v'||part as version, case when is_xml then 'No-Intro' else 'me' end as author, case when is_xml then 'http://x' else 'here' end as homepage, case when is_xml then 'nointro' else 'custom' end as kind, cast(null as varchar) as error from m""")
def s3_manifest_headers(r):
    found = manifests.headers(r.spark, _manifests(r))
    return found.select("name", "version", "author", "homepage", manifests.source_type(F.col("name"), F.col("author"), F.col("homepage"), F.col("category")).alias("kind"), "error")


@query("""select concat('d/f',doc_id,'.zip') as game, concat('f',doc_id,'.zip') as rom, strlen(text) as size, upper(md5(text)) as md5 from documents where doc_id%3<>0""")
def s13_dump_entries(r):
    """A table dump of a row for each text is written by all tasks and read by its statements."""
    path = f"{shared_folder(r.spark)}/dump-{uuid.uuid4().hex}"
    row = F.format_string("(%d,NULL,'it''s; (a) \\' quote','/d/f%d.zip', 4 ,%d,'%s')", "doc_id", "doc_id", F.octet_length("text"), F.when(F.col("doc_id") % 3 != 0, F.md5("text")).otherwise("none"))
    rows = r.documents.groupBy("source", F.floor(F.col("doc_id") / 300).alias("part")).agg(F.array_join(F.collect_list(row), ",\n").alias("rows"))
    rows.select(F.concat(F.lit("INSERT INTO `downloads` (`id`, `link`) VALUES "), "rows", F.lit(";")).alias("value")).write.text(path)
    return manifests.dump_entries(r.spark, path).select("game", "rom", "size", "md5")
