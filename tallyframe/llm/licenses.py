"""Licence notices in texts by a positional index of rare words, in DataFrame functions only.

A template is a notice of a licence with key phrases that every copy must hold; a short one is its own
key phrase. The index has, for each word of a key phrase, the templates and the places in them where it
stands. Words are ranked by how few documents hold them, counted over all documents. A document is looked up
by those of its licence words that rank highest: a template's rarest key word gives the places where a copy
could begin (place in the document less place in the template), its next rarest ones, at their own
relative places, leave few of them, and there the key phrases are verified word by word. The rest of a
longer template's words counts by inverse document frequency: their share within ``DRIFT`` words of
their places is the score, and a copy needs ``LEAST``. As a copy holds every key word, no copy is
missed by beginning with the rarest. Templates of one key phrase only admit no drift and score 1.

Documents are read twice, once for the counts of the licence words, which alone reach the driver (at most
one row for each word of the templates), and once for the scan; nothing else is shuffled. A text is
searched only for templates whose key words it all holds, in time linear in its words.

Defined results: a null text counts as empty and has no word; a document without a copy has null places, empty
labels and score 0; of several copies all places count, overlapping ones too; repeated rows agree; other
columns, whatever their names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: what a word is, after A-Z became lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that a copy of a longer notice may be shifted by at any place, and the share of its words it needs.
DRIFT, LEAST = 2, 0.6
#: Rarest key words that are looked up before phrases are verified.
PROBES = 3
_FOUND = "array<struct<label:string,template:int,start:int,share:double>>"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of ``text`` that must stand in a copy; none for a template that is its own phrase.
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def drift(self) -> int:
        return DRIFT if self.keys else 0

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Key phrases as words, with their places in the template."""
        own, found = self.words, []
        for phrase in self.keys or (self.text,):
            words = words_of(phrase)
            at = next((k for k in range(len(own) - len(words) + 1) if own[k : k + len(words)] == words), None)
            if at is None or not words:
                raise ValueError(f"template '{self.label}': its text lacks the phrase '{phrase}'")
            found.append((at, words))
        return found


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


# Phrases and labels that are always found, and opening notices of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", ("you may not use this file except in compliance with the license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("under the terms of the gnu general public license",)),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2",)),
    Template("epl", "eclipse public license"),
    Template("bsd", "under the bsd license"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc0", "cc0 1 0 universal"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _all_words(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def inverse_frequencies(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, float]:
    """Of each word of the templates, how rare it is among all documents."""
    listed = F.array(*(F.lit(w) for w in _all_words(templates)))
    held = F.concat(F.array(F.lit("")), F.array_intersect(_words(F.col("text")), listed))  # the empty word counts documents
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) + 1 for w in _all_words(templates)}


def _copies(number: int, t: Template, rarity: dict[str, float]) -> str:
    """The copies of one template as an expression over a document's ``words`` and the licence words it has, ``held``.

    It is built as text, since thousands of small calls from Python would take longer than the search.
    """
    keys = {at + j: w for at, phrase in t.phrases for j, w in enumerate(phrase)}
    ranked = sorted(set(keys.values()), key=lambda w: (-rarity[w], w))
    places = {w: [p for p, x in keys.items() if x == w] for w in ranked}
    width = 2 * t.drift + 1

    def stands(p: int, w: str) -> str:
        if not t.drift:
            return f"get(words, s + {p}) = '{w}'"
        return f"array_contains(slice(words, greatest(s + {p - t.drift + 1}, 1), greatest(least(s + {p + t.drift + 1}, {width}), 0)), '{w}')"

    def phrase_stands(at: int, phrase: list[str]) -> str:
        shifts = (" AND ".join(f"get(words, s + {at + d + j}) = '{w}'" for j, w in enumerate(phrase)) for d in sorted(range(-t.drift, t.drift + 1), key=abs))
        return "(" + " OR ".join(f"coalesce({s}, false)" for s in shifts) + ")"

    tests = [stands(p, w) for w in ranked[1:PROBES] for p in places[w]] + [phrase_stands(*phrase) for phrase in t.phrases]
    share = "1.0D"
    if t.keys:
        share = f"round(({' + '.join(f'if({stands(p, w)}, {rarity[w]!r}D, 0.0D)' for p, w in enumerate(t.words))}) / {sum(rarity[w] for w in t.words)!r}D, 6)"
    standing = f"filter(transform(words, (w, i) -> if(w = '{ranked[0]}', i, null)), i -> i IS NOT NULL)"
    starts = f"array_distinct(flatten(array({', '.join(f'transform({standing}, i -> i - {p})' for p in places[ranked[0]])})))"
    copy = f"named_struct('label', '{t.label}', 'template', {number}, 'start', s, 'share', {share})"
    found = f"filter(transform(filter({starts}, s -> {' AND '.join(tests)}), s -> {copy}), c -> c.share >= {LEAST}D)"
    all_held = " AND ".join(f"array_contains(held, '{w}')" for w in ranked)
    return f"if({all_held}, cast({found} AS {_FOUND}), cast(array() AS {_FOUND}))"


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, found``: copies of templates as ``label, template, start, share``; places count words from 0."""
    rarity = inverse_frequencies(docs, templates)
    by_rarity = sorted({w for t in templates for _, phrase in t.phrases for w in phrase}, key=lambda w: (-rarity[w], w))
    held = F.array_intersect(F.array(*(F.lit(w) for w in by_rarity)), F.col("words"))
    rows = docs.select("doc_id", _words(F.col("text")).alias("words")).withColumn("held", held)
    found = F.flatten(F.array(*(F.expr(_copies(k, t, rarity)) for k, t in enumerate(templates))))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))


def digests(found: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Counts, places and labels of ``scan``'s rows."""
    base = F.filter("found", lambda c: c["template"].isin([k for k, t in enumerate(templates) if t.base]))
    names = lambda copies: F.array_join(F.array_sort(F.array_distinct(F.transform(copies, lambda c: c["label"]))), ",")
    starts = F.transform("base", lambda c: c["start"].cast("long"))
    rows = found.withColumn("base", base)
    score = F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names("base").alias("base_labels"), names("found").alias("labels"), score.alias("score"))


def digests_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """The digests in SQL: words as rows, copies by counting the words of each phrase at each start."""
    rows = lambda values: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)
    listed = [(k, t.label, t.drift, int(t.base), len(t.words), len(t.phrases)) for k, t in enumerate(templates)]
    places = [(k, p, w) for k, t in enumerate(templates) for p, w in enumerate(t.words)]
    phrases = [(k, n, at + j, w, len(words)) for k, t in enumerate(templates) for n, (at, words) in enumerate(t.phrases) for j, w in enumerate(words)]
    return f"""
WITH t(k, label, drift, base, size, n_keys) AS (VALUES {rows(listed)}),
p(k, place, word) AS (VALUES {rows(places)}),
keys(k, phrase, place, word, size) AS (VALUES {rows(phrases)}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT row, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM d),
rare AS (SELECT p.word, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT w.row) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM p) p LEFT JOIN w USING (word) GROUP BY p.word),
lead AS (SELECT DISTINCT k, place, word FROM keys JOIN rare USING (word)
  QUALIFY rank() OVER (PARTITION BY k ORDER BY idf DESC, word) = 1),
start AS (SELECT DISTINCT w.row, lead.k, w.i - lead.place AS start FROM w JOIN lead USING (word)),
whole AS (SELECT s.row, s.k, s.start, keys.phrase FROM start s JOIN t USING (k), unnest(range(-drift, drift + 1)) AS u(shift), keys, w
  WHERE keys.k = s.k AND w.row = s.row AND w.i = s.start + keys.place + shift AND w.word = keys.word
  GROUP BY s.row, s.k, s.start, keys.phrase, shift HAVING count(*) = max(keys.size)),
full_of AS (SELECT row, k, start FROM whole JOIN t USING (k) GROUP BY row, k, start HAVING count(DISTINCT phrase) = max(n_keys)),
near AS (SELECT DISTINCT f.row, f.k, f.start, p.place, p.word FROM full_of f JOIN t USING (k) JOIN p ON p.k = f.k JOIN w ON w.row = f.row AND w.word = p.word AND w.i BETWEEN f.start + p.place - drift AND f.start + p.place + drift),
weight AS (SELECT k, sum(idf) AS total FROM p JOIN rare USING (word) GROUP BY k),
found AS (SELECT near.row, near.k, near.start, round(sum(idf) / any_value(total), 6) AS share FROM near JOIN rare USING (word) JOIN weight USING (k) GROUP BY near.row, near.k, near.start HAVING share >= {LEAST}),
told AS (SELECT row, count(*) FILTER (base = 1) AS n_base, min(start) FILTER (base = 1) AS first_word, max(start) FILTER (base = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found JOIN t USING (k) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN told USING (row)"""
