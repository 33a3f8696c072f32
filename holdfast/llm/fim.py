"""Fill-in-the-middle: texts cut at unit boundaries and written as prefix, suffix and middle in another order.

A unit is a word with the white space before it; white space at the end is a unit of its own. So a text that is not
empty has one unit for each word that white space follows, and one that ends with the text. One automaton finds the
white-space characters and the sentinels. Two white-space characters with a gap between them enclose a word, so units are
counted from the gaps and the characters of words are never walked; a cut is looked up by its rank among the gaps, in the
stretch of events that holds it. Stretches are of STRIDE events, so a text of white space alone takes no more memory.

The cuts and the form of a document follow from the hash of its seed and id alone. A null text is empty, a null id is
written as nothing. Rows with equal ids are cut by equal hashes, each in its own text. All columns of the caller stay; one
of the name of the result is replaced. No text is ever left out: an empty text, one that contains a sentinel, and those
beyond the wanted share have the form plain and are their own output.
"""

from __future__ import annotations

import functools
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = " \t\n\x0b\x0c\r"
#: Events that are held at once.
STRIDE = 1 << 16


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in WHITE:
        found.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """The units of a text: how many, whether it contains a sentinel, and where the first k of them end."""

    def __init__(self, text: str, stride: int = STRIDE):
        self.text, self.stride = text, stride
        self.has_sentinel, self.stretches, last, closed, start = False, [], -1, 0, 0
        events, more = automaton().iter(text), True
        while more:
            at, sentinel, stop, more = self._stretch(events)
            ends = self._ends(at, last)
            self.has_sentinel |= sentinel
            self.stretches.append((closed, last, start))
            self._latest = len(self.stretches) - 1, ends
            closed += len(ends)
            last, start = int(at[-1]) if len(at) else last, stop
        self.n = closed + (1 if text else 0)

    def _stretch(self, events) -> tuple[np.ndarray, bool, int, bool]:
        """Places of white space among the next events, whether one is a sentinel, where they stop, and whether more may follow."""
        pairs = np.fromiter(chain.from_iterable(islice(events, self.stride)), np.int64).reshape(-1, 2)
        plain = pairs[:, 1] == 0
        return pairs[plain, 0], not plain.all(), int(pairs[-1, 0]) + 1 if len(pairs) else 0, len(pairs) == self.stride

    @staticmethod
    def _ends(at: np.ndarray, last: int) -> np.ndarray:
        """Places of white space that follow a word: those with a gap before them."""
        return at[np.diff(at, prepend=last) > 1]

    def end_of(self, k: int) -> int:
        """Where the first k units end, in code points."""
        if k == 0 or k == self.n:
            return len(self.text) if k else 0
        i = np.searchsorted([before for before, _, _ in self.stretches], k) - 1
        before, last, start = self.stretches[i]
        if self._latest[0] != i:
            self._latest = i, self._ends(self._stretch(automaton().iter(self.text, start))[0], last)
        return int(self._latest[1][k - before - 1])


CUTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("has_sentinel", T.BooleanType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType())])


@F.arrow_udf(CUTS)
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = []
    for t, a, b in zip(text, h1.to_pylist(), h2.to_pylist()):
        units = Units(t.as_py())
        a, b = sorted((a % (units.n + 1), b % (units.n + 1)))
        rows.append((units.n, units.has_sentinel, units.end_of(a), units.end_of(b)))
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], CUTS.names)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "fim", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs with a column `to`: n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    About `percent` of the texts are transformed, and of those `spm_percent` written suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.withColumn(to, F.struct(_cuts(text, h(1), h(2)).alias("c"), text.alias("text"), (h(3) % 100 < percent).alias("wanted"), (h(4) % 100 < spm_percent).alias("suffix_first")))
    at = lambda name: F.col(f"`{to}`.{name}")
    plain = (at("text") == "") | at("c.has_sentinel") | ~at("wanted")
    form = F.when(plain, "plain").when(at("suffix_first"), "spm").otherwise("psm")
    first, second = at("c.first").cast("int"), at("c.second").cast("int")
    prefix, middle, suffix = F.substr(at("text"), F.lit(1), first), F.substr(at("text"), first + 1, second - first), F.substr(at("text"), second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = F.struct(
        at("c.n").alias("n"), form.alias("form"), F.when(~plain, at("c.first")).alias("prefix_chars"), F.when(~plain, at("c.second") - at("c.first")).alias("middle_chars"),
        F.when(plain, at("text")).when(at("suffix_first"), spm).otherwise(psm).alias("output"),
    )
    return cut.withColumn(to, made)


def restore(output: Column, form: Column) -> Column:
    """The text again. Its parts hold no sentinel, and sentinels cannot overlap, so each occurs once in an output."""
    part = lambda after, before: F.split_part(F.split_part(output, F.lit(after), F.lit(2)), F.lit(before), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


ORACLE = """with h as (select doc_id, coalesce(text,'') as t, sha256('42:'||coalesce(cast(doc_id as varchar),'')) as d from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as us, cast('0x'||d[1:8] as bigint) as h1, cast('0x'||d[9:16] as bigint) as h2, cast('0x'||d[17:24] as bigint) as h3, cast('0x'||d[25:32] as bigint) as h4 from h),
c as (select *, len(us) as n, least(h1%(len(us)+1), h2%(len(us)+1)) as a, greatest(h1%(len(us)+1), h2%(len(us)+1)) as b from u),
p as (select *, array_to_string(us[1:a],'') as pre, array_to_string(us[a+1:b],'') as mid, array_to_string(us[b+1:],'') as suf,
  case when t='' or contains(t,'<P>') or contains(t,'<S>') or contains(t,'<M>') or h3%100>=50 then 'plain' when h4%100<80 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form<>'plain' then length(pre) end as prefix_chars, case when form<>'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>'||suf||'<P>'||pre||'<M>'||mid else '<P>'||pre||'<S>'||suf||'<M>'||mid end) as output_sha256, sha256(t) as restored_sha256 from p"""
