"""License scans by a positional index of rare words.

Each template names the words of a notice and the phrases it cannot do without. Of its words the rarest over all
templates (highest IDF) are its anchors. A file's anchor places are looked up; places minus the anchor's place in the
template give candidate starts, and the starts of all anchors are intersected. At what is left the mandatory phrases
are compared word by word. Everything is computed within a row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Fixed values: (label, notice, mandatory phrases), in the words of the public licences.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "this software and associated documentation files"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "under the terms of the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms", "with or without modification"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ["permission to use copy modify", "with or without fee"]),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("unlicense", "free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
]

#: Anchors of a template.
ANCHORS = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z become lower case.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    anchors: tuple[tuple[str, int], ...]  # word and place, rarest first
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place and words
    base: bool


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[Template]:
    """The base phrases, each its own mandatory phrase, and the notices."""
    raw = [(label, phrase, [phrase], True) for phrase, label in BASE.items()] + [(*n, False) for n in NOTICES]
    held = [set(text.split()) for _, text, _, _ in raw]
    idf = lambda w: math.log((1 + len(held)) / sum(w in h for h in held))
    out = []
    for label, text, phrases, base in raw:
        words = text.split()
        places = {w: i for i, w in reversed(list(enumerate(words)))}
        rare = sorted(places, key=lambda w: (-idf(w), places[w]))[:ANCHORS]
        found = tuple((_at(words, p.split()), tuple(p.split())) for p in phrases)
        out.append(Template(label, tuple(words), tuple((w, places[w]) for w in rare), found, base))
    return out


def _starts(places: Column, t: Template) -> Column:
    """Where the template would begin, by all its anchors."""

    def of(word: str, place: int) -> Column:
        return F.transform(F.filter(places, lambda p: p["w"] == word), lambda p: p["i"] - place)

    return reduce(F.array_intersect, [of(*a) for a in t.anchors])


def _verified(words: Column, starts: Column, t: Template) -> Column:
    """The starts at which every mandatory phrase stands."""

    def stands(s: Column) -> Column:
        tests = [
            (s + k >= 0) & (F.slice(words, F.greatest(s + F.lit(k + 1), F.lit(1)), F.lit(len(p))) == F.array(*map(F.lit, p))) for k, p in t.phrases
        ]
        return reduce(lambda a, b: a & b, tests)

    return F.filter(starts, stands)


def _coverage(words: Column, starts: Column, t: Template) -> Column:
    """The largest share of the template's words that stand in their places; 0 without starts."""
    want = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(t.words)])

    def share(s: Column) -> Column:
        same = F.filter(want, lambda x: (s + x["k"] >= 0) & (F.get(words, s + x["k"]) == x["w"]))
        return F.size(same) / F.lit(float(len(t.words)))

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def scan(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds one column ``licence`` to ``documents``; a column of that name is replaced.

    Its fields: n_words; n_base, first_word, last_word: how many places the base phrases have and the smallest and
    largest word they begin at (null without any); base_labels and labels: distinct, sorted, comma-joined, labels being
    those of all templates; score: the largest share of a found template's words in place, 0 if none is found. Null and
    empty texts have no words. Every place in the whole text counts, however many there are.
    """
    known = templates()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    low = "weftline__low"
    lowered = documents.drop("licence").withColumn(low, F.lower(text))
    holds = lambda w: F.contains(F.col(low), F.lit(w))
    candidate = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [holds(w) for w, _ in t.anchors]) for t in known])
    rare = sorted({w for t in known for w, _ in t.anchors})
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " "))
    rows = lowered.withColumn("weftline__words", F.when(candidate, F.split(plain, " "))).drop(low)
    words = F.col("weftline__words")
    marked = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))
    rows = rows.withColumn("weftline__places", marked)
    found = [F.when(words.isNotNull(), _verified(words, _starts(F.col("weftline__places"), t), t)).alias(f"t{i}") for i, t in enumerate(known)]
    rows = rows.withColumn("weftline__found", F.struct(*found))
    at = lambda i: F.coalesce(F.col("weftline__found")[f"t{i}"], F.array().cast("array<int>"))
    base = [i for i, t in enumerate(known) if t.base]
    places = F.concat(*[at(i) for i in base])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(at(i)) > 0, known[i].label) for i in some])))), ",")
    none = F.lit(None).cast("bigint")
    score = F.greatest(*[F.when(words.isNotNull(), _coverage(words, at(i), t)).otherwise(0.0) for i, t in enumerate(known)])
    return rows.withColumn(
        "licence",
        F.struct(
            F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"),
            F.size(places).cast("bigint").alias("n_base"),
            F.coalesce(F.array_min(places).cast("bigint"), none).alias("first_word"),
            F.coalesce(F.array_max(places).cast("bigint"), none).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(range(len(known))).alias("labels"),
            score.alias("score"),
        ),
    ).drop("weftline__words", "weftline__places", "weftline__found")


def scan_sql() -> str:
    """The same for table ``documents`` in DuckDB."""
    known = templates()
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ",\n        ".join(
        f"({i}, '{t.label}', {str(t.base).lower()}, {quote(t.words)}, {quote([w for w, _ in t.anchors])}, {[k for _, k in t.anchors]})" for i, t in enumerate(known)
    )
    phrases = ",\n        ".join(f"({i}, {k}, {quote(p)})" for i, t in enumerate(known) for k, p in t.phrases)
    return rf"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), t(id, label, base, words, anchors, places) AS (VALUES
        {values}
    ), p(id, k, phrase) AS (VALUES
        {phrases}
    ), tok AS (
        SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d
    ), a AS (
        SELECT id, len(anchors) AS n, unnest(anchors) AS w, unnest(places) AS k FROM t
    ), s AS (
        SELECT r, id, i - k AS s FROM tok JOIN a USING (w) GROUP BY r, id, i - k HAVING count(DISTINCT w) = first(n)
    ), v AS (
        SELECT s.r, s.id, s.s, first(d.w) AS w FROM s JOIN d USING (r) JOIN p USING (id)
        GROUP BY s.r, s.id, s.s HAVING bool_and(s.s + k >= 0 AND list_slice(d.w, s.s + k + 1, s.s + k + len(phrase)) = phrase)
    ), c AS (
        SELECT r, s, label, base, len(list_filter(range(len(words)), lambda k: s + k >= 0 AND w[s + k + 1] = words[k + 1])) / len(words) AS share FROM v JOIN t USING (id)
    ), g AS (
        SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM c GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN g USING (r)
    """
