from __future__ import annotations

import random

import pytest

#: Columns that clash with names the operators use inside.
CLASHES = (
    "_id _hash _own _gone _nth _row _text _words _lines _hashes _sorted _places one row lines removed text_hash number id line root fp least keep none words found value "
    "values grams marks copies n_words n_hit items runs contaminated item_id item_key length kept h part ids piece start sequence_id offset n fits"
).split()
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def table(spark):
    """A table of (doc_id, text) rows with further columns, some of them null."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, *CLASHES) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """n invented texts of several lines, the same at every call."""

    def make(n, seed=1, vocabulary=900, least=30, most=90):
        draw = random.Random(seed)
        names = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "se", "ra") for b in ("ben", "dor", "fin", "gul", "hast") for c in ("", "a", "el", "ing", "on", "ür", "st", "ed", "is", "o", "um", "le", "y", "ik", "ap", "os", "et", "ia", "ul", "ers", "ant", "eck", "ow", "ium", "ad", "or", "em", "ut", "ol", "ig")][:vocabulary]
        out = []
        for _ in range(n):
            words = ["the" if draw.random() < 0.15 else draw.choice(names) for _ in range(draw.randint(least, most))]
            out.append("\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)))
        return out

    return make


#: Texts that every operator must take.
ODD = [None, "", "   \n\t ", "word", "a b c", "x " * 30_000, "\n\n\n", "é中\U0001f600 \u0085 naïve", "the same text twice", "the same text twice"]


@pytest.fixture(scope="session")
def odd():
    return [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (None, "no id at all"), (None, None)]
