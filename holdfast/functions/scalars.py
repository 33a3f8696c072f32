"""Small expressions on paths, sizes and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_text(n: Column) -> Column:
    """A size in bytes, KB, MB or GB with two decimals; a tie goes to the even one."""

    def size(shift: int, unit: str) -> Column:
        parts, one = n.cast("decimal(20,0)") * 100, F.lit(1 << shift).cast("decimal(20,0)")
        rest = parts % one
        whole = ((parts - rest) / one).cast("long")
        near = whole + ((rest * 2 > one) | ((rest * 2 == one) & (whole % 2 == 1))).cast("long")
        return F.format_string(f"%d.%02d {unit}", F.floor(near / 100), near % 100)

    return F.when(n >= 1 << 30, size(30, "GB")).when(n >= 1 << 20, size(20, "MB")).when(n >= 1 << 10, size(10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def shortened(path: Column, width: int) -> Column:
    return F.when(F.char_length(path) > width, F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))).otherwise(path)


def bar(have: Column, total: Column, width: int = 20) -> Column:
    full = F.when(total > 0, F.floor(have * width / total)).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def no_slash(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def under(path: Column, root: Column) -> Column:
    """path is root or lies below it; a root's last slash does not count."""
    r = no_slash(root)
    return (path == r) | F.startswith(path, F.concat(r, F.lit("/")))


def top_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def system_of(name: Column) -> Column:
    return F.split_part(name, F.lit(" - "), F.lit(1))


def sort_path(name: Column) -> Column:
    """A name's parts at ' - ' as a path: trimmed, with slashes replaced, empty parts dropped."""
    parts = F.transform(F.split(name, " - "), lambda x: F.translate(F.trim(x), "/\\", "__"))
    return F.array_join(F.filter(parts, lambda x: x != ""), "/")


def dest_root(explicit: Column, default: Column, hierarchy: Column) -> Column:
    return F.coalesce(explicit, F.concat(no_slash(default), F.lit("/"), hierarchy))


def dest_path(root: Column, game: Column, rom: Column, several: Column) -> Column:
    return F.when(several, F.concat_ws("/", no_slash(root), game, rom)).otherwise(F.concat_ws("/", no_slash(root), rom))


def output_format(explicit: Column, default: str) -> Column:
    low = F.lower(explicit)
    return F.when(low.isin("loose", "zip", "torrentzip", "7z"), low).otherwise(F.lit(default))


def merge_mode(explicit: Column, default: str) -> Column:
    low = F.lower(explicit)
    return F.when(low.isin("non-merged", "merged", "split"), low).otherwise(F.lit(default))


def asked_mode(given: Column, default: str = "non-merged") -> Column:
    """A mode that someone asks for: it may be written without the hyphen; null is the default, and any other word fails the job."""
    low = F.lower(given)
    known = F.when(low.isNull(), default).when(low == "nonmerged", "non-merged").when(low.isin("non-merged", "merged", "split"), low)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("a mode is non-merged, merged or split, not "), given)).cast("string"))


def archive_extension(fmt: Column) -> Column:
    return F.when(fmt == "7z", F.lit("7z")).otherwise(F.lit("zip"))


def volume(path: Column) -> Column:
    found = F.regexp_extract(path, "^(/Volumes/[^/]+)", 1)
    return F.when(found != "", found).otherwise(F.lit("/"))


def glob(pattern: str) -> str:
    """A regular expression for a pattern with * and ?."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in pattern.lower())
    return f"(?s)^{escaped}$"


def matches_glob(name: Column, pattern: str) -> Column:
    return F.lower(name).rlike(glob(pattern))


def like_glob(name: Column, pattern: str) -> Column:
    """Case-insensitive LIKE with * and ? for its wildcards; % and _ keep their meaning."""
    return name.ilike(pattern.replace("*", "%").replace("?", "_"))


def le_bytes(n: Column) -> Column:
    """A long's eight bytes, least first."""
    word = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(word, 15 - 2 * i, 2) for i in range(8)]))


def piece_size(total: Column) -> Column:
    """The power of two nearest above a 1500th of the total, from 16 KiB to 16 MiB."""
    less = F.greatest(F.floor(total / 1500), F.lit(1)).cast("long") - 1
    above = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(less)))  # a bit more than the number before has
    return F.least(F.greatest(above, F.lit(1 << 14)), F.lit(1 << 24)).cast("long")
