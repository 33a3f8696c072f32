"""A catalogue made from the driver's test tables, as SQL bodies that Spark and DuckDB both understand.

`relations(spark, sf_dir)` gives the relations as DataFrames; `ctes(*names)` gives the same bodies as a WITH clause for
the oracle. Names in the bodies refer to relations before them and to the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .snapshots import snapshot

_T = "concat('Title ',cast(cast(floor({g}/3) as bigint) as varchar(12))"

BODIES = {
    "c_content": """select doc_id, source, lang as coll, cast(floor(doc_id/4) as bigint) as g, upper(sha1(text)) as sha1, upper(md5(text)) as md5,
      substr(upper(md5(text)),1,8) as crc32, upper(sha1(substr(text,17))) as payload, n_chars as size from documents""",
    "c_collections": """select distinct lang as coll, concat(upper(lang),' - Documents') as name,
      concat(case when lang in ('de','en') then 'SETA' else 'SETB' end,'/',upper(lang)) as node_path from documents""",
    "c_versions": "select coll, 'v1' as version, false as is_active, 1 as imported_seq from c_collections union all select coll, 'v2', true, 2 from c_collections",
    "c_entries": "select c.*, 'v1' as version from c_content c where doc_id % 3 <> 0 union all select c.*, 'v2' as version from c_content c where doc_id % 3 <> 1",
    "c_names": f"""select distinct coll, g, {_T.format(g="g")},case g % 3 when 0 then ' (USA)' when 1 then ' (Europe) (Rev A)' else ' (Japan)[b]' end) as game from c_content""",
    "c_games": f"""select distinct e.coll, e.version, n.game, case when e.g % 3 = 1 then {_T.format(g="e.g")},' (USA)') end as parent_name,
      e.g % 41 = 0 as is_bios, e.g % 37 = 0 as is_device, e.g % 29 = 0 as is_mechanical from c_entries e join c_names n on n.coll=e.coll and n.g=e.g""",
    "c_roms": """select e.coll, e.version, n.game, concat('r',cast(doc_id as varchar(12)),'.rom') as rom, size,
      case when doc_id % 5 = 0 then payload when doc_id % 4 < 2 then sha1 end as sha1, case when doc_id % 4 = 2 then md5 end as md5,
      case when doc_id % 11 <> 0 then crc32 end as crc32, case when doc_id % 17 = 0 then 'nodump' when doc_id % 19 = 0 then 'baddump' else 'good' end as status,
      case when doc_id % 2 = 0 then concat('r',cast(doc_id as varchar(12)),'.rom') end as merge_tag, doc_id % 23 = 0 as is_disk
      from c_entries e join c_names n on n.coll=e.coll and n.g=e.g""",
    "c_files": """select sha1, min(case when doc_id % 5 = 0 then payload end) as sha1_no_header, min(md5) as md5, min(crc32) as crc32, min(size) as size
      from c_content where doc_id % 7 <> 0 group by sha1""",
    "c_sources": """select distinct source, case when cast(substr(source,4) as integer) % 2 = 0 then concat('/stage/',source) else concat('/lib/ROMs/',source) end as path,
      case when cast(substr(source,4) as integer) % 2 = 0 then 'consume' else 'preserve' end as disposition from documents""",
    "c_locations": """select sha1, source, case when doc_id % 6 < 4 then concat('d/doc_',cast(doc_id as varchar(12)),'.rom') else concat('z/pack_',cast(cast(floor(doc_id/200) as bigint) as varchar(12)),'.zip') end as path,
      case when doc_id % 6 >= 4 then concat('doc_',cast(doc_id as varchar(12)),'.rom') end as archive_path from c_content where doc_id % 7 <> 0
      union all select sha1, 'src1', concat('copy/doc_',cast(doc_id as varchar(12)),'.rom'), cast(null as varchar(40)) from c_content where doc_id % 7 <> 0 and doc_id % 10 = 0""",
    "c_quarantine": """select c.sha1, concat(c.sha1,'_doc_',cast(c.doc_id as varchar(12)),'.rom') as quarantine_path, c.size,
      case when l.toxic = 1 then 'content_changed' when l.quality = 0 then 'set_removed' else 'duplicate' end as reason,
      case when c.doc_id % 9 <> 0 then concat(upper(c.coll),' - Documents') end as collection_name from labels l join c_content c on c.doc_id=l.doc_id""",
    "c_config": """select name as path_pattern, case when coll in ('de','fr') then concat('/dest/',coll,'/') end as dest_path,
      case coll when 'en' then 'ZIP' when 'es' then 'loose' when 'fr' then 'bogus' end as output_format, case coll when 'de' then 'split' end as merge_mode from c_collections
      union all select 'SETB', cast(null as varchar(40)), '7z', 'Merged' union all select 'SETA', '/never', 'torrentzip', 'non-merged'""",
    "c_extra": """select path_pattern, dest_path, output_format, merge_mode, case path_pattern when 'DE - Documents' then '{"one_g_one_r":true,"region_priority":["Japan","Europe"],"exclude_bad_dumps":false}'
      when 'EN - Documents' then '{"one_g_one_r":true}' when 'ES - Documents' then 'no json' end as config_json from c_config""",
    "c_match": """with vr as (select coll, game, rom, sha1, crc32, size, is_disk from c_roms where version='v2' and status<>'nodump')
      select vr.coll, vr.game, vr.rom, vr.is_disk, f.sha1, f.size from vr join c_files f on f.sha1=vr.sha1 where vr.sha1 is not null
      union select vr.coll, vr.game, vr.rom, vr.is_disk, f.sha1, f.size from vr join c_files f on f.sha1_no_header=vr.sha1 where vr.sha1 is not null
      union select vr.coll, vr.game, vr.rom, vr.is_disk, f.sha1, f.size from vr join c_files f on f.crc32=vr.crc32 and f.size=vr.size where vr.sha1 is null and vr.crc32 is not null""",
    "c_goals": """select coll, name, node_path, concat('/lib/ROMs/',node_path) as dest_root, case coll when 'de' then 'loose' when 'en' then 'zip' when 'es' then 'torrentzip' else '7z' end as format
      from c_collections""",
    "c_asked": """select m.*, cast(substr(rom,2,length(rom)-5) as integer) as doc, cast(floor(cast(substr(rom,2,length(rom)-5) as integer)/4) as bigint) as g from c_match m""",
    "c_homes": """select l.sha1, s.path as root, s.disposition, l.path, l.archive_path from c_locations l join c_sources s on s.source=l.source
      union select w.sha1, '/lib/ROMs', 'preserve', concat(o.node_path,'/',w.game,EXT), w.rom from c_asked w join c_goals o on o.coll=w.coll where not w.is_disk and o.format<>'loose' and w.g % 4 = 0
      union select w.sha1, '/stage/sets', 'consume', concat(w.game,EXT), w.rom from c_asked w join c_goals o on o.coll=w.coll where not w.is_disk and o.format<>'loose' and w.g % 4 in (1,3)
      union select w.sha1, '/lib/ROMs', 'preserve', case when w.is_disk then concat(o.node_path,'/',w.game,'/',w.rom,'.chd') when n.n > 1 then concat(o.node_path,'/',w.game,'/',w.rom) else concat(o.node_path,'/',w.rom) end, cast(null as varchar(40))
        from c_asked w join c_goals o on o.coll=w.coll left join (select coll, game, count(distinct rom) as n from c_asked where not is_disk group by coll, game) n on n.coll=w.coll and n.game=w.game
        where (w.is_disk or o.format='loose') and w.doc % 2 = 0
      union select w.sha1, '/stage/loose', 'consume', concat('x/',w.rom), cast(null as varchar(40)) from c_asked w where w.doc % 3 = 0""".replace("EXT", "case when o.format='7z' then '.7z' else '.zip' end"),
    "c_held": """select m.coll, m.game, m.rom, m.is_disk, m.sha1, m.size, h.root, h.disposition, h.path, h.archive_path from c_asked m join c_homes h on h.sha1=m.sha1""",
}
#: Relations that one query uses in several places: each query computes and writes them once, and no other one reads them.
STORED = ("c_asked", "c_homes", "c_held")
TABLES = ("documents", "labels")
#: A row for each collection, setting or source. All other relations grow with the documents.
FEW = ("c_collections", "c_versions", "c_sources", "c_goals", "c_config", "c_extra")


def _uses(body: str) -> list[str]:
    return [n for n in (*TABLES, *BODIES) if re.search(rf"\b{n}\b", body)]


def ctes(*names: str) -> str:
    """A WITH clause of the named relations and all that they use."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name in BODIES and name not in wanted:
            wanted.add(name)
            for n in _uses(BODIES[name]):
                add(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({b})" for n, b in BODIES.items() if n in wanted)


class Relations:
    """The projection's relations by name, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        full = name if name in TABLES else f"c_{name}"
        if full not in self._made:
            if full in TABLES:
                self._made[full] = self.spark.read.parquet(f"{self.sf_dir}/{full}.parquet")
            else:
                body = BODIES[full].replace("{", "{{").replace("}", "}}")
                used = _uses(BODIES[full])
                for n in used:
                    body = re.sub(rf"(?<![.\w]){n}\b(?!\.)", "{" + n + "}", body)
                given = {n: getattr(self, n.removeprefix("c_")) for n in used}
                if " join " in body:  # large ones by sorting: Spark takes a compressed file for a small table to send through the driver
                    given = {n: df.hint("broadcast" if n in FEW else "merge") for n, df in given.items()}
                made = self.spark.sql(body, **given)
                self._made[full] = snapshot(made) if full in STORED else made
        return self._made[full]
