"""Documents with every awkward kind of row."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, shard string, licence string, matches string, row_number string"

WORDS = {
    "en": "the of and river stone light under above carry window garden market quiet morning evening bright shadow people travel answer letter".split(),
    "de": "der die und nicht fenster garten straße schön morgen abend licht schatten leute reise antwort brief wasser stein unter über".split(),
    "fr": "le la et fenêtre jardin rue très matin soir lumière ombre gens voyage réponse lettre eau pierre sous élève français".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def rows() -> list[tuple]:
    """Null and empty texts, white space, exact and near copies, repeated rows, one long text, null columns."""
    out = []
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "different"
    texts = [None, "", " \t\n", base, base, " ".join(changed), base.upper(), "one two three", "One  two\nthree", "..., !!!", "x" * 5000, prose(2, 20000)]
    for i, t in enumerate(texts):
        out.append((i, t, ["en", None][i % 2], ["s0", "s1", None][i % 3]))
    for i in range(12, 60):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, prose(i, 80, lang), lang, "s0" if i % 2 else f"s{i % 5}"))
    out.append(out[20])  # a repeated row
    return [(a, b, c, d, len(b or ""), "digest", "shard", "licence", "matches", "n") for a, b, c, d in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
