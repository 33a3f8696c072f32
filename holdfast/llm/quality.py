"""Document quality rules: text measures and a table of thresholds, compiled into one projection.

Everything is a built-in expression, row by row: no shuffle, no user function.
Null texts count as empty; an empty text has no words and fails the length rule.
Repeated rows are judged one by one; other columns pass through untouched, and a
column of the same name as a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at from are this or an not have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et du en un une est que qui dans pour par sur pas au ne "
    "el los las y del se por con una su para como no al lo más"
).split()
WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when per_mille * over < numerator * 1000, or is under it for `least` rules."""

    name: str
    numerator: str
    denominator: str
    per_mille: int
    least: bool = False

    def broken(self) -> Column:
        share, bound = F.col(self.numerator) * 1000, (F.lit(1) if self.denominator == "one" else F.col(self.denominator)) * self.per_mille
        return share < bound if self.least else share > bound


#: The threshold table. `one` is the constant 1, so that plain bounds read like ratios.
RULES = (
    Rule("too_few_words", "n_words", "one", 20_000, least=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", 300),
    Rule("short_words", "word_chars", "n_words", 2_000, least=True),
    Rule("long_words", "word_chars", "n_words", 15_000),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("few_stop_words", "n_stop_words", "n_words", 40, least=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 500),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
#: The rules that the base verdict is made of.
BASE = ("too_few_words", "repeated_windows")


def _repeated(hashes: str) -> tuple[Column, Column, Column]:
    """Steps from window hashes to the number of words in windows that occur twice or more."""
    h = F.col(hashes)
    twice = F.size(F.array_distinct(h)) < F.size(h)
    by_hash = F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    s, p = F.col("_sorted"), F.col("_places")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"]))
    words = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, i: a + F.least(F.lit(WINDOW), F.get(p, i) - F.get(p, i - 1)))
    return by_hash, places, F.coalesce(words, F.lit(0)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words (long)."""
    words, lines = F.col("_words"), F.col("_lines")
    count = F.size(words)
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    windows = F.when(count >= WINDOW, F.transform(F.sequence(F.lit(0), count - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumns(
        {
            "_words": F.array_remove(F.split("_text", f"[{SPACE}]+"), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
            "n_symbols": F.char_length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long"),
        }
    )
    df = df.withColumns({"_hashes": windows, "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")})
    by_hash, places, repeated = _repeated("_hashes")
    df = df.withColumns(
        {
            "_sorted": by_hash,
            "n_words": count.cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    df = df.withColumn("_places", places).withColumn("n_repeat_words", repeated)
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in MEASURES], *MEASURES)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with base_failed, kept and broken_rules, all in one projection."""
    broken = {r.name: r.broken() for r in rules}
    base = F.lit(False)
    for name in BASE:
        base = base | broken[name]
    any_broken = base
    for b in broken.values():
        any_broken = any_broken | b
    names = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in broken.items()]))
    return measured.withColumns({"base_failed": base, "kept": ~any_broken, "broken_rules": names})


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(measures(docs, text), rules)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns they came with."""
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_own")) if docs.columns else docs
    # a number that no filter passes below: else the verdict, and with it every measure, is copied into the filter at each use
    judged = quality(marked, "_own").withColumn("_nth", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_nth") >= 0)).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 1000 * n_symbols > 100 * n_words
       OR 1000 * n_stop < 40 * n_words OR 1000 * n_dup_lines > 500 * n_lines) AS kept
FROM b
""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))
