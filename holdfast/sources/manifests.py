"""Manifests: which contents a collection should hold.

`discover` finds the files, `entries` gives a row for each required entry of all of them and `headers` a row for each
file. XML goes through Spark's reader, which streams the games of a file in one task, and a table dump through its text
reader, which splits at statements; the text format is parsed a file at a time inside tasks, as its files are small.
A file that cannot be parsed gives no entries and an `error` in `headers`; the others are read all the same.

`ordinal` orders the entries of a file as they stand in it: the block of the file that the reader cut out, the row among
those of its task, which reads a block from front to back, and the entry's place in the row. A game without entries has one
row without `rom`. Of a file that uses both words for a game, those called "game" come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, game string, description string, parent_name string, is_bios boolean, is_device boolean, is_mechanical boolean, rom string, size long, crc32 string, md5 string, sha1 string, status string, merge_tag string, is_disk boolean, ordinal struct<block:bigint,row:bigint,part:int>, rom_of string"
HEADER = "path string, name string, description string, version string, author string, homepage string, category string, error string"
_FIELDS = [part.split(" ")[0] for part in ENTRY.split(", ")]

_ROM = "array<struct<_name string, _size string, _crc string, _md5 string, _sha1 string, _status string, _merge string>>"
_GAME = f"_name string, _cloneof string, _romof string, _isbios string, _isdevice string, _ismechanical string, description string, rom {_ROM}, disk {_ROM}"
_HEAD = "name string, description string, version string, author string, homepage string, url string, category string"


#: Names of manifests, as a pattern of the file sources.
NAMES = "*.{[dD][aA][tT],[xX][mM][lL]}"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, text and kind (xml, block) of every manifest under folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=NAMES)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), kind(F.col("value")).alias("kind"))


def kind(text: Column) -> Column:
    """The format of a manifest by how it begins; XML where that says nothing."""
    begins = F.ltrim(F.regexp_replace(F.substr(text, F.lit(1), F.lit(4096)), "^[\\uFEFF\\s]+", ""))
    xml = begins.rlike("^(<\\?|<!|<datafile|<mame|<softwarelist)")
    return F.when(~xml & begins.rlike("(?i)^(clrmamepro|header|game|machine|resource)"), "block").otherwise("xml")


def hierarchy(path: Column, root: str) -> Column:
    """The folders between root and a file, joined by slashes; null for a file at root itself."""
    inside = F.regexp_replace(path, "^(file:/*)?/?" + re.escape(root.strip("/")) + "/+", "")
    return F.nullif(F.regexp_replace(inside, "/?[^/]*$", ""), F.lit(""))


def source_type(name: Column, author: Column, homepage: Column, category: Column | None = None) -> Column:
    """Who published a manifest: the first of these words, in any letter case, in the header fields where it counts."""
    fields = {"no-intro": [author, name], "redump": [author, name], "tosec": [author, name, homepage] + ([] if category is None else [category]), "mame": [author, name]}
    named = [F.when(F.lower(F.concat_ws("\n", *of)).contains(word), word.replace("-", "")) for word, of in fields.items()]
    return F.coalesce(*named, F.lit("custom"))


def _xml(spark: SparkSession, folder: str, tag: str, schema: str) -> DataFrame:
    """The elements of a name in all manifests under folder; those of another format have none."""
    reader = spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreSurroundingSpaces", False)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", NAMES).load(folder)


def _status(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low.isin("nodump", "baddump"), low).otherwise("good")


def xml_entries(spark: SparkSession, folder: str) -> DataFrame:
    games = None
    for tag in ("game", "machine"):
        block = F.col("_metadata.file_block_start") + (0 if tag == "game" else 1 << 62)
        part = _xml(spark, folder, tag, _GAME).select(F.col("_metadata.file_path").alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("row"), "*")
        games = part if games is None else games.unionByName(part)
    tagged = lambda c, disk: F.transform(F.coalesce(c, F.array().cast(_ROM)), lambda r: F.struct(r.alias("r"), F.lit(disk).alias("is_disk")))
    each = games.where("_name is not null").select("*", F.posexplode_outer(F.filter(F.concat(tagged(F.col("rom"), False), tagged(F.col("disk"), True)), lambda e: e["r"]["_name"].isNotNull())).alias("part", "e"))
    yes = lambda c: F.coalesce(F.col(c) == "yes", F.lit(False))
    disk, rom = F.col("e.is_disk"), F.col("e.r")
    return each.select(
        "path", F.col("_name").alias("game"), F.trim("description").alias("description"), F.col("_cloneof").alias("parent_name"),
        yes("_isbios").alias("is_bios"), yes("_isdevice").alias("is_device"), yes("_ismechanical").alias("is_mechanical"),
        rom["_name"].alias("rom"), F.when(disk, F.lit(0).cast("long")).when(rom["_name"].isNotNull(), F.coalesce(F.try_to_number(rom["_size"], F.lit("999999999999999999")).cast("long"), F.lit(0).cast("long"))).alias("size"),
        F.when(~disk, F.upper(rom["_crc"])).alias("crc32"), F.upper(rom["_md5"]).alias("md5"), F.upper(rom["_sha1"]).alias("sha1"),
        F.when(rom["_name"].isNotNull(), _status(rom["_status"])).alias("status"), rom["_merge"].alias("merge_tag"), disk.alias("is_disk"), F.struct("block", "row", F.coalesce("part", F.lit(0)).alias("part")).alias("ordinal"), F.col("_romof").alias("rom_of"),
    )


def xml_headers(spark: SparkSession, folder: str) -> DataFrame:
    head = _xml(spark, folder, "header", _HEAD).select(F.col("_metadata.file_path").alias("path"), "*")
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return head.select("path", text("name"), text("description"), text("version"), text("author"), F.coalesce(text("homepage"), text("url")).alias("homepage"), text("category"), F.lit(None).cast("string").alias("error"))


# --- the text format: nested blocks of keys and values -------------------------------------------------------------

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([()])|[;#][^\n]*|([^\s()"]+)', re.S)


def blocks(text: str) -> list[tuple[str, list]]:
    """Top-level (key, pairs) of a text; a pair's value is a string or, for a nested block, a list of pairs."""
    top: list = []
    open_blocks, key = [top], None
    for m in _TOKEN.finditer(text):
        quoted, bracket, word = m.groups()
        if bracket == "(":
            inner: list = []
            open_blocks[-1].append((key or "", inner))
            open_blocks.append(inner)
            key = None
        elif bracket == ")":
            if len(open_blocks) == 1:
                raise ValueError(f"a block ends at {m.start()} that never began")
            open_blocks.pop()
            key = None
        elif quoted is not None or word is not None:
            value = word if quoted is None else quoted.replace('\\"', '"')
            if key is None:
                key = value.lower()
            else:
                open_blocks[-1].append((key, value))
                key = None
    if len(open_blocks) > 1:
        raise ValueError("a block does not end")
    return [b for b in top if isinstance(b[1], list)]


def _values(pairs: list) -> dict[str, str]:
    return {k: v for k, v in pairs if isinstance(v, str)}


def _count(text: str | None) -> int:
    return int(text) if text and re.fullmatch(r"\+?[0-9]{1,18}", text) else 0


def _upper(text: str | None) -> str | None:
    return text.upper() if text else None


def block_rows(path: str, text: str) -> Iterator[tuple]:
    for nth, (key, pairs) in enumerate(blocks(text)):
        game = _values(pairs)
        if key not in ("game", "machine", "resource") or not game.get("name"):
            continue
        head = (path, game["name"], game.get("description"), game.get("cloneof"), False, False, False)
        roms = [rom for inner, rom in ((k, _values(v)) for k, v in pairs if isinstance(v, list)) if inner == "rom" and rom.get("name")]
        if not roms:
            yield (*head, None, None, None, None, None, None, None, None, (0, nth, 0), game.get("romof"))
        for part, rom in enumerate(roms):
            status = (rom.get("status") or rom.get("flags") or "").lower()
            hashes = (_upper(rom.get("crc") or rom.get("crc32")), _upper(rom.get("md5")), _upper(rom.get("sha1")))
            yield (*head, rom["name"], _count(rom.get("size")), *hashes, status if status in ("nodump", "baddump") else "good", rom.get("merge"), False, (0, nth, part), game.get("romof"))


def block_header(path: str, text: str) -> tuple:
    try:
        found = [_values(pairs) for key, pairs in blocks(text) if key in ("clrmamepro", "header")]
    except ValueError as e:
        return (path, None, None, None, None, None, None, str(e))
    head = found[0] if found else {}
    return (path, head.get("name"), head.get("description"), head.get("version"), head.get("author"), head.get("homepage") or head.get("url"), head.get("category"), None if found else "no header")


def _block_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, text in zip(frame["path"], frame["text"]):
            try:
                rows = list(block_rows(path, text))
            except ValueError:  # told by headers()
                continue
            yield pd.DataFrame(rows, columns=_FIELDS)


def _block_headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([block_header(*row) for row in zip(frame["path"], frame["text"])], columns=[f.split(" ")[0] for f in HEADER.split(", ")])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each required entry of all manifests under folder."""
    found = discover(spark, folder)
    rows = found.where("kind = 'block'").select("path", "text").mapInPandas(_block_entries, ENTRY)
    return rows.unionByName(xml_entries(spark, folder).join(found.where("kind = 'xml'").select("path"), "path", "left_semi"))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each manifest under folder; error says why one could not be read."""
    found = discover(spark, folder)
    rows = found.where("kind = 'block'").select("path", "text").mapInPandas(_block_headers, HEADER)
    known = xml_headers(spark, folder).groupBy("path").agg(*[F.first(c).alias(c) for c in ("name", "description", "version", "author", "homepage", "category", "error")])
    met = found.where("kind = 'xml'").select("path").join(known, "path", "left")
    return rows.unionByName(met.withColumn("error", F.when(F.col("name").isNull(), "no header")))


# --- a table dump: INSERT statements of one table ------------------------------------------------------------------

# Quoted strings with doubled or escaped quotes in them; runs are possessive, so a long string takes few steps.
_QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
_TUPLE = rf"(?s)\((?:[^'()]++|{_QUOTED})*+\)"
_CELL = rf"(?s)(?:^|,)\s*+(?:{_QUOTED}|[^,']*+)"


def dump_entries(spark: SparkSession, path: str, table: str = "downloads", statement_ends: str = ";\n") -> DataFrame:
    """Entries of a dump's rows with an MD5 in their seventh cell; the fourth names the file, the sixth its size.

    Dumps write line ends within strings as escapes, so the statements are lines that end otherwise.
    """
    lines = spark.read.text(path, lineSep=statement_ends)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    rows = F.regexp_extract("value", rf"(?is)INSERT\s+INTO\s+`{re.escape(table)}`.*?VALUES(.*)$", 1)
    tuples = lines.select("path", "block", "row", F.posexplode(F.regexp_extract_all(rows, F.lit(_TUPLE), F.lit(0))).alias("part", "t"))
    raw = F.regexp_extract_all(F.expr("substring(t, 2, length(t) - 2)"), F.lit(_CELL), F.lit(0))

    def cell(c: Column) -> Column:
        bare = F.regexp_replace(c, "^,?\\s*", "")
        inner = F.regexp_replace(F.regexp_replace(bare, "(?s)^'(.*)'$", "$1"), "(?s)\\\\(.)|'(')", "$1$2")
        return F.when(F.startswith(bare, F.lit("'")), inner).otherwise(F.trim(bare))

    cells = tuples.withColumn("cells", F.transform(raw, cell)).where("size(cells) > 6")
    at = lambda i: F.get("cells", F.lit(i))
    link = F.ltrim(at(3), F.lit("/"))
    good = cells.where(at(6).rlike("^[0-9A-Fa-f]{32}$") & (F.element_at(F.split(at(3), "/"), -1) != ""))
    size = F.when(at(5).rlike("^[0-9]{1,18}$"), at(5).cast("long")).otherwise(F.lit(0).cast("long"))
    return good.select("path", link.alias("game"), F.element_at(F.split(at(3), "/"), -1).alias("rom"), size.alias("size"), F.upper(at(6)).alias("md5"), F.struct("block", "row", "part").alias("ordinal"))
