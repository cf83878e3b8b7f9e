import math
import random
import re

import duckdb
import pytest

from tallyframe.llm import licenses

MORE = [
    (700, "Under the MIT License. UNDER the mit-license!", "en", None), (701, "under the mit license under the mit license under the", "en", None), (702, "apache license, version 2.0 cc by nc", "en", "x"),
    (703, "Permission is hereby kindly granted free of charge", "en", "x"), (704, "cc-by-nc cc by-nc CC_BY_NC cc by n c", "en", "x"), (705, "Under thé MIT license; ünder the mit license mit", "en", "x"),
    (706, " ".join(t.text for t in licenses.TEMPLATES), "en", "x"), (707, "word " * 40_000 + licenses.TEMPLATES[3].text + " word" * 40_000 + " cc by nc", "en", "x"), (708, "mit " * 5000, "en", "x"),
    (709, "2 version license apache. license mit the under, nc by cc", "en", "x"), (710, "under the mit license", "en", "x"), (710, "under the mit license", "en", "x"),
]


def spoiled(rng, text):
    words = text.split(" ")
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = rng.choice(([], ["really"], ["so", "to"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(12)
    made = [(800 + k, f"one two {spoiled(rng, licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))].text)} and more", "en", "y") for k in range(120)]
    return [*rows, *MORE, *made]


def plain(rows):
    """Every start of every template in every text."""
    table = str.maketrans(licenses.UPPER, licenses.LOWER)
    split = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))) for i, text, *_ in rows]
    vocabulary = {w for t in licenses.TEMPLATES for w in t.words}
    sets = [set(words) for _, words in split]
    rarity = {w: math.log((len(rows) + 1) / (sum(w in s for s in sets) + 1)) + 1 for w in vocabulary}
    out = []
    for (i, words), held in zip(split, sets, strict=True):
        found = []
        for t in licenses.TEMPLATES:
            drift = 2 if t.keys else 0
            phrases = [(next(k for k in range(len(t.words)) if t.words[k : k + len(p)] == p), p) for p in map(licenses.words_of, t.keys or (t.text,))]
            keys = {at + j: w for at, p in phrases for j, w in enumerate(p)}
            if not set(keys.values()) <= held:
                continue
            rarest = min(keys.values(), key=lambda w: (-rarity[w], w))
            for start in sorted({k - p for k, w in enumerate(words) if w == rarest for p, x in keys.items() if x == rarest}):
                at = lambda k, words=words: words[k] if 0 <= k < len(words) else None
                if all(any(all(at(start + o + d + j) == w for j, w in enumerate(p)) for d in range(-drift, drift + 1)) for o, p in phrases):
                    share = sum(rarity[w] for p, w in enumerate(t.words) if any(at(start + p + d) == w for d in range(-drift, drift + 1))) / sum(rarity[w] for w in t.words)
                    if share >= 0.6:
                        found.append((t, start, share))
        base = [s for t, s, _ in found if t.base]
        names = lambda ts: ",".join(sorted({t.label for t in ts}))
        out.append((i, len(words), len(base), min(base, default=None), max(base, default=None), names(t for t, *_ in found if t.base), names(t for t, *_ in found), round(max((x for *_, x in found), default=0.0), 5)))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_scan_equals_a_plain_search_and_its_sql(spark, texts):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in texts], "doc_id long, text string, lang string, source string, words string, found int, base string").repartition(4)
    rounded = lambda rows: sorted(((*r[:-1], round(r[-1], 5)) for r in rows), key=key)
    got, want = rounded(map(tuple, licenses.digests(licenses.scan(df)).collect())), sorted(plain(texts), key=key)
    assert got == want
    by_id = {r[0]: r for r in got}
    assert by_id[701][2:5] == (2, 0, 4) and by_id[704][2] == 3 and by_id[709][2] == 0 and by_id[707][4] == 80_027 and by_id[707][6] == "cc-by-nc,mit"
    assert set(by_id[706][6].split(",")) == {t.label for t in licenses.TEMPLATES}
    assert 20 < sum(r[0] is not None and r[0] >= 800 and r[6] != "" for r in got) < 120
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert rounded(con.execute(licenses.digests_sql()).fetchall()) == want


def test_templates_can_be_given_and_must_hold_their_phrases(spark):
    own = (licenses.Template("acme", "the acme terms apply to every reader", ("acme terms",)), licenses.Template("house", "house rules", base=True))
    df = spark.createDataFrame([(1, "The ACME terms apply, to every reader. House rules"), (2, "acme terms"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_base"], r["labels"]) for r in licenses.digests(licenses.scan(df, own), own).collect()}
    assert got == {1: (1, "acme,house"), 2: (0, ""), 3: (0, "")}
    with pytest.raises(ValueError, match="lacks the phrase"):
        licenses.scan(df, (licenses.Template("bad", "some text", ("other text",)),))


def test_an_empty_table(empty):
    assert licenses.digests(licenses.scan(empty)).count() == 0
