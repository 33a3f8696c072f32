"""Personal data in text by weak supervision: three labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are the spans of four fixed patterns (`email`, `ip`, `card`, `phone`; leftmost, non-overlapping for each
kind, failing matches dropped without a retry), which always stay, and six looser ones: `local`, a phone number without a
country code; `number`, a run of 12 to 19 digits that fails the card check; `iban`, an account number; `national`, a
personal number of the United States or Spain; `address`, a street with a house number in one of four languages; and
`name`, two or three capitalised words side by side, without a title or verb before them. Each candidate gets the vote (no,
yes, none) of a shape rule, a gazetteer and the words around it. Of a name, the shape rule is one of letter case: words that
the same text writes in lower case are no names, and capitals within a sentence speak for one; a given name that the
gazetteer lacks is no vote. Names are rare among capitalised words, so where two labelers say yes and none says no, that is
an anchor: taken for one in the estimation and in the end; without an anchor only a known given name is judged. Only counts of vote patterns leave a task: their number is
bounded by labelers and kinds, whatever the input. From them the driver estimates how reliable each labeler is
(a two-class model, by expectation-maximisation), and fits a logistic classifier of kind, votes and form to the
posteriors. A looser candidate that the classifier accepts, and that no pattern span overlaps, becomes a span.

A null text is empty and has no spans; repeated rows are scanned one by one; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "local", "number", "iban", "national", "address", "name")
BASE = KINDS[:4]
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z])(?![A-Za-z0-9-])")
TITLE = "[A-ZÄÖÜÀÂÇÉÈÊÎÔÁÍÓÚÑ][a-zäöüßàâçéèêëîïôûùáíóúñ]+"
ADDRESS = re.compile(
    rf"(?<!\w)(?:[0-9]{{1,5}}\x20{TITLE}(?:\x20{TITLE})?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)"
    rf"|[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place|chemin|quai)\x20(?:de\x20la\x20|de\x20l'|des\x20|de\x20|du\x20|d')?{TITLE}"
    rf"|(?:Calle|Avenida|Plaza|Paseo)\x20(?:de\x20)?(?:la\x20|las\x20|los\x20|el\x20)?{TITLE}(?:\x20{TITLE})?,?\x20[0-9]{{1,4}}"
    rf"|{TITLE}(?:(?<=traße)|(?<=trasse)|(?<=gasse)|(?<=allee)|(?<=weg)|(?<=platz))\x20[0-9]{{1,4}}[a-z]?)(?!\w)"
)
NAME = re.compile(rf"(?<!\w){TITLE}(?:\x20{TITLE}){{1,2}}(?!\w)")
POSTCODE = re.compile(r",?\s(?:[\w.-]+,?\x20){0,3}[0-9]{5}(?![0-9])")
DIGIT, DIGITS = re.compile("[0-9]"), re.compile("[0-9]+")

#: Gazetteers and the words that speak for or against a kind.
TOP_DOMAINS = frozenset("com org net edu gov de fr es uk eu io co info".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "98")
FOR = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "local": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "number": ("card", "visa", "credit", "account", "iban", "konto", "carte", "tarjeta"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "dni", "nif", "id"),
    "address": ("address", "lives", "live", "at", "adresse", "wohnt", "habite", "dirección", "vive"),
    "name": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "monsieur", "señor", "señora", "sr", "sra", "name", "named", "dear", "signed", "contact", "write", "call"),
}
GIVEN_NAMES = frozenset(
    "Adam Alejandro Alice Amélie Ana Andrea Andreas Andrew Anna Anne Antoine Antonio Barbara Benjamin Bernd Camille Carlos Carmen Caroline Charles "
    "Charlotte Chloé Christian Christine Claire Claudia Daniel David Diego Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco François Frank "
    "George Hannah Hans Heinz Helen Henri Isabel Jacques James Jan Javier Jean Jennifer Jessica Joan John Jonas José Joseph Juan Julia Julie Jürgen "
    "Karen Karl Katharina Kevin Klaus Laura Léa Linda Louis Lucas Lucía Luis Luke Manuel Marco Margaret María Maria Marie Mark Markus Martin Mary "
    "Matthew Matthias Michael Michel Miguel Monika Nathalie Nicolas Nina Olivier Pablo Patricia Patrick Paul Paula Pedro Peter Philippe Pierre Rachel Richard "
    "Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Sergio Sofía Sophie Stefan Stephen Steven Susan Susanne Thomas Ursula Victor Walter William Wolfgang".split()
)
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
NATIONAL_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Words of speech that follow a name.
AFTER = frozenset("said says wrote writes told asked replied answered sagte schreibt schrieb fragte antwortete dit écrit demande répond dijo escribe escribió preguntó respondió".split())
#: Titles and verbs with a capital, at the start of a sentence, are no part of the name after them.
BEFORE = frozenset(FOR["name"]) | frozenset("please contact ask tell thank thanks from by with and the see meet".split())
LOWER = re.compile(r"(?<![^\W_])[a-zäöüßàâçéèêëîïôûùáíóúñ]{2,}(?![^\W_])")
AGAINST = ("version", "isbn", "issn", "invoice", "order", "serial", "sku", "rfc", "section")
CONTEXT, SHARED = 32, 0.3


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _names(text: str) -> Iterator[tuple[int, int, int]]:
    for m in NAME.finditer(text):
        words, start = m[0].split(" "), m.start()
        while words and words[0].lower() in BEFORE:
            start += len(words.pop(0)) + 1
        if len(words) > 1:
            yield start, 9, m.end()


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all candidates, in order; those of the patterns, then the looser ones that overlap none."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    loose = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 12 <= len(digits := "".join(DIGITS.findall(m[0]))) <= 19:
                (found if luhn(digits) else loose).append((m.start(), 2 if luhn(digits) else 5, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
        for kind, of in ((4, LOCAL), (6, IBAN), (7, NATIONAL), (8, ADDRESS)):
            loose += [(m.start(), kind, m.end()) for m in of.finditer(text)]
    loose += _names(text)
    found.sort()
    more, at, reach = [], 0, 0
    for span in sorted(loose):
        while at < len(found) and found[at][0] < span[2]:
            reach = max(reach, found[at][2])
            at += 1
        if reach <= span[0]:
            more.append(span)
            reach = span[2]
    return sorted(found + more)


def _shape(kind: int, s: str, digits: str) -> int:
    """Whether the span is well formed in itself: check digits, ranges and lengths."""
    if kind == 0:
        return int(s.rpartition(".")[2].isalpha() and len(s) <= 254)
    if kind == 1:
        return int(all(p == (p.lstrip("0") or "0") for p in s.split(".")))
    if kind in (2, 5):
        return int(luhn(digits) and len(digits) >= 13)
    if kind == 3:
        return int(10 <= len(digits) <= 13)
    if kind == 6:
        plain = s.replace(" ", "")
        return int(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    if kind == 7:
        return int(NATIONAL_LETTERS[int(digits) % 23] == s[-1] if s[-1].isalpha() else digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if kind == 8:
        return int(digits[0] != "0")
    return int(len(set(digits)) > 2)


def _case(words: list[str], before: str, lower: frozenset[str]) -> int:
    """Of a name: no if the text has one of its words in lower case, yes for capitals within a sentence."""
    if any(w.lower() in lower or not 2 <= len(w) <= 15 for w in words):
        return 0
    return 1 if re.search(r"[\w,;)]\x20$", before) else 2


def _gazetteer(kind: int, s: str, digits: str, after: str) -> int:
    """Whether lists know a part of the span: endings of domains, calling codes, countries, given names; a postcode after a street."""
    if kind == 0:
        return 1 if s.rpartition(".")[2].lower() in TOP_DOMAINS else 2
    if kind == 1:
        return int(0 < int(s.split(".")[0]) < 224 and s.split(".")[0].lstrip("0") not in ("10", "127"))
    if kind in (2, 5):
        return int(digits[0] in "3456")
    if kind == 3:
        return int(digits.startswith(CALLING_CODES))
    if kind == 6:
        return int(IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")))
    if kind == 7:
        return 2 if s[-1].isalpha() else int(digits[:3] < "773")
    if kind == 8:
        return 1 if POSTCODE.match(after) else 2
    if kind == 9:
        return 1 if s.split(" ")[0] in GIVEN_NAMES else 2
    return int(digits[0] in "23456789")


def _context(kind: int, before: str, after: str) -> int:
    words = re.findall(r"[\w-]+", before.lower())
    if kind == 9 and (m := re.match(r",?\x20(\w+)", after)) and m[1] in AFTER:
        return 1
    return 1 if any(w in FOR[KINDS[kind]] for w in words) else 0 if any(w in AGAINST for w in words) else 2


def lower_words(text: str, found: list[tuple[int, int, int]]) -> frozenset[str]:
    """The words that a text has in lower case; only asked for where it has candidates for names."""
    return frozenset(LOWER.findall(text)) if any(s[1] == 9 for s in found) else frozenset()


def pattern(text: str, span: tuple[int, int, int], lower: frozenset[str] = frozenset()) -> int:
    """A candidate's kind, three votes (0 no, 1 yes, 2 none) and form, as one number."""
    start, kind, end = span
    s = text[start:end]
    digits = "".join(DIGITS.findall(s))
    apart = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    shape = _case(s.split(" "), before, lower) if kind == 9 else _shape(kind, s, digits)
    votes = shape, _gazetteer(kind, s, digits, after), _context(kind, before, after)
    code = kind
    for v in votes:
        code = code * 3 + v
    return (code * 2 + apart) * 2 + (len(s) > len(digits))


PATTERNS = len(KINDS) * 27 * 4


def _unpacked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes and form of every pattern."""
    code = np.arange(PATTERNS)
    form = np.stack([code >> 1 & 1, code & 1], 1)
    votes = np.stack([(code // 4) // d % 3 for d in (9, 3, 1)], 1)
    return code // 108, votes, form


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                found = candidates(text)
                lower = lower_words(text, found)
                total.update(pattern(text, s, lower) for s in found)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])


def posteriors(counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(personal data) of every pattern, from vote probabilities of each labeler for either class and a prior for each kind.

    A kind's vote probabilities are its own, drawn towards the labeler's over all kinds as by `SHARED` times as many candidates
    more, so all sizes of input are treated alike. No vote says nothing. Begun as labelers that are right more often than not.
    """
    kind, votes, _ = _unpacked()
    of_kind = kind[:, None] == np.arange(len(KINDS))
    p = 1 / (1 + np.exp(2.0 * ((votes == 0).sum(1) - (votes == 1).sum(1))))
    sure = anchors()
    for _ in range(rounds):
        like = []
        for weight in (counts * (1 - p), counts * p):
            log = np.log((weight @ of_kind + 1) / (counts @ of_kind + 2))[kind]
            for labeler in range(3):
                own = np.stack([(weight * (votes[:, labeler] == v)) @ of_kind for v in range(2)], 1)
                share = own.sum(0) + 1
                own = own + (SHARED * (counts @ of_kind) + 10)[:, None] * share / share.sum()
                log = log + np.pad(np.log(own / own.sum(1, keepdims=True)), ((0, 0), (0, 1)))[kind, votes[:, labeler]]
            like.append(log)
        p = np.where(sure, 1.0, 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50))))
    return p


def anchors() -> np.ndarray:
    """Patterns of names on which two labelers agree and none disagrees."""
    kind, votes, _ = _unpacked()
    return (kind == 9) & ((votes == 1).sum(1) >= 2) & ((votes == 0).sum(1) == 0)


def classifier(counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The final classifier's P(personal data) of every pattern: logistic regression on kind, votes, both together and form, fitted to the posteriors."""
    kind, votes, form = _unpacked()
    of_kind = kind[:, None] == np.arange(len(KINDS))
    cast = np.concatenate([votes[:, i, None] == np.arange(2) for i in range(3)], 1)
    x = np.concatenate([of_kind, cast, (of_kind[:, :, None] & cast[:, None]).reshape(PATTERNS, -1), form], 1).astype(float)
    target, weight = posteriors(counts), counts / max(counts.sum(), 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= 0.5 * np.linalg.solve(bend, x.T @ (weight * (p - target)) + 1e-3 * w)
    found = 1 / (1 + np.exp(-(x @ w)))
    return np.where(anchors(), 1.0, np.where((kind == 9) & (votes[:, 1] != 1), 0.0, found))


def train(rows: DataFrame) -> np.ndarray:
    counts = np.zeros(PATTERNS)
    for p, n in rows.select("text").mapInArrow(_count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        counts[p] = n
    return classifier(counts)


def spans(text: str, accept: np.ndarray) -> list[tuple[int, int, int]]:
    found = candidates(text)
    lower = lower_words(text, found)
    return [s for s in found if s[1] < len(BASE) or accept[pattern(text, s, lower)]]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, kinds, starts, ends (arrays, in order; code points, end exclusive)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    accept = train(rows) > 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t or "", accept) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[KINDS[s[1]] for s in f] for f in found], pa.list_(pa.string()))]
            lists += [pa.array([[s[i] for s in f] for f in found], pa.list_(pa.int32())) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "kinds", "starts", "ends"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, kinds array<string>, starts array<int>, ends array<int>")
