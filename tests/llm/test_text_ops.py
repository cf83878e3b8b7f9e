import hashlib
import itertools
import random
import re
import time
from math import exp, lgamma, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid, mixing, ngram_join, pii, quality, textkit, toxicity
from tallyframe.llm.components import connected_components
from tests.llm.conftest import sentence


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
        return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0

    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = digits(m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii_keeps_every_base_span(spark, docs, rows, empty):
    rng = random.Random(1)
    noise = ["".join(rng.choice("0123456789.+- ()@abc_%é\n") for _ in range(200)) for _ in range(60)]
    mixed = [f"{rng.randrange(300)}.{rng.randrange(300)}.1.2 {rng.randrange(10**15, 10**16)} +1 {rng.randrange(10**9)} a{k}@b.c" for k in range(60)]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([*noise, *mixed, "1 " * 9000, "1" * 9000, "a." * 9000 + "@b.c"])], "doc_id long, text string")
    texts = {r[0]: r[1] or "" for r in rows} | {r["doc_id"]: r["text"] for r in more.collect()}
    spans = pii.find_spans(docs.select("doc_id", "text").unionByName(more))
    for r in pii.span_digests(spans).collect():
        want = brute_base(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), (r["doc_id"], written, r["spans"])
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in want) for k in pii.KINDS[:4]]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    assert pii.span_digests(pii.find_spans(empty)).count() == 0


def test_redaction(docs):
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    r = {x["doc_id"]: x["text"] for x in clean.where("doc_id in (300, 303, 308)").collect()}
    assert r[300] is None and r[303] == "one two"
    assert "example.com" not in r[308] and "[EMAIL]" in r[308] and "[CARD]" in r[308] and "[PHONE]" in r[308] and "[IP]" in r[308] and "300.1.1.1" in r[308]


def test_labeler_reliabilities_follow_agreement():
    counts = [(0, (1, 1, 1, 1, 1), 80), (0, (0, -1, -1, -1, -1), 60), (0, (1, 1, 0, 1, -1), 10), (0, (0, -1, 1, -1, -1), 10)]
    p = pii.reliabilities(counts)
    assert p[0, (1, 1, 1, 1, 1)] > 0.95 and p[0, (0, -1, -1, -1, -1)] < 0.05 and p[0, (1, 1, 0, 1, -1)] > 0.5 > p[0, (0, -1, 1, -1, -1)]


def test_added_spans_are_precise_and_found(spark):
    """Planted loose forms among look-alikes: held to what was planted."""
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    for k in range(600):
        words = sentence(rng, "en", 30).split()
        kind = k % 6
        loose = {0: f"jo{k}.doe [at] mail{k % 7} [dot] com", 1: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", 2: hexes(40), 3: f"v{k}.{k % 7}.{k % 5}"}.get(kind, "")
        lead = {0: "write to", 1: "call", 2: "token =", 3: "version"}.get(kind, "")
        text = " ".join([*words[:15], *([lead] if lead else []), *([loose] if loose else []), *words[15:]])
        rows.append((k, text))
        if kind < 3:
            want[k] = (text.index(loose), text.index(loose) + len(loose))
    rows += [(1000 + k, f"mail u{k}@host{k % 5}.org or phone +1 (523) 555-{1000 + k}") for k in range(100)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(k, s["start"], s["end"]) for k, spans in got.items() for s in spans if not s["strict"]}
    planted = {(k, *x) for k, x in want.items()}
    assert len(added & planted) >= 0.95 * len(planted) and len(added & planted) >= 0.95 * len(added)


def brute_posterior(counts):
    """Expectation-maximisation as a plain loop over single spans."""
    spans = [v for _, v, n in counts for _ in range(n)]
    p = [1 / (1 + np.exp(-sum(v))) for v in spans]
    for _ in range(pii.ROUNDS):
        chance = [[{x: 0.5 for x in (-1, 0, 1)} for _ in spans[0]] for _ in range(2)]
        for v, q in zip(spans, p, strict=True):
            for j, x in enumerate(v):
                chance[0][j][x] += q
                chance[1][j][x] += 1 - q
        prior = min(max(sum(p) / len(p), 0.01), 0.99)
        out = []
        for v in spans:
            odds = np.log(prior / (1 - prior))
            for j, x in enumerate(v):
                odds += np.log(chance[0][j][x] / sum(chance[0][j].values())) - np.log(chance[1][j][x] / sum(chance[1][j].values()))
            out.append(1 / (1 + np.exp(-odds)))
        p = out
    return dict(zip(spans, p, strict=True))


def test_reliabilities_equal_a_plain_loop():
    rng = random.Random(4)
    counts = list({(0, tuple(rng.choice((-1, 0, 1)) for _ in range(5))): rng.randint(1, 9) for _ in range(25)}.items())
    counts = [(k, v, n) for (k, v), n in counts]
    got, want = pii.reliabilities(counts), brute_posterior(counts)
    assert all(abs(got[0, v] - x) < 1e-6 for v, x in want.items())


def test_pii_takes_linear_time_and_any_column_name(spark):
    def seconds(n):
        text = " ".join(f"a{k}@b{k}.com 1.2.3.4 (523) 555-1055" for k in range(n))
        df = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, spans_ int").withColumn("spans", F.lit("mine")).withColumn("pieces", F.lit(2))
        began = time.perf_counter()
        clean = pii.redact(df).first()
        assert clean["text"] == " ".join(["[EMAIL] [IP] [PHONE]"] * n) and (clean["spans"], clean["spans_"], clean["pieces"]) == ("mine", 7, 2)
        return time.perf_counter() - began

    seconds(10)
    assert seconds(8000) < 2 * seconds(4000) + 3


def brute_classes(rows, n=5, percent=80):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), least.get(find(k))) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("block", "small", "frequent"), [(128, 8, 4), (2, 1, 1000), (3, 3, 2)])
def test_ngram_join_equals_brute_force(monkeypatch, docs, rows, block, small, frequent):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", frequent)
    got = ngram_join.jaccard_classes(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows)


def test_ngram_join_keeps_the_first(docs, empty):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 100 in ids and not set(range(101, 105)) & set(ids) and not set(range(200, 212)) & set(ids) and ids.count(5) == 1 and None in ids
    assert {300, 301, 302} <= set(ids) and 304 not in ids
    assert ngram_join.jaccard_classes(empty).count() == 0 and ngram_join.keep_first(empty).count() == 0


def test_copies_of_a_text_do_not_enlarge_a_group(spark):
    """Two texts that share an n-gram and are far apart are no candidates, in however many tasks they are."""
    rng = random.Random(8)
    texts = [sentence(rng, "en", 60) + f" {k} v w x y z" for k in "pq"]
    ranks = spark.sparkContext.broadcast((np.zeros(0, dtype=np.uint32),) * 2)
    for times in (1, 12):
        rows = [(2 * k + i, x) for k in range(times) for i, x in enumerate(texts)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, times), "doc_id long, text string")
        sets = ngram_join._scan(docs, 5, 64).where("sig IS NOT NULL").select("sig", "n").distinct()
        postings = ngram_join._postings(docs, 5, 1, ranks)  # percent 1: all n-grams are sent
        assert postings.count() == 2 * 62 * times
        assert postings.groupBy("gram").agg(F.countDistinct("sig").alias("sets")).where("sets > 1").count() == 1
        assert not ngram_join._candidates(postings, sets, 80).collect()


def test_ngram_join_decides_by_text_and_whatever_the_columns(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, "en", 60) for _ in range(3))
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (None, c, "n1"), (None, c, "n2"), (9, c + " end", "m"), (9, c + " end", "l"), (3, None, "p"), (3, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("own_id", F.lit(1)).withColumn("place", F.lit(2))
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["key"]) for r in kept.collect()), key=str)
    again = sorted(((r["doc_id"], r["key"]) for r in ngram_join.keep_first(docs.repartition(3)).collect()), key=str)
    assert got == again and {x for x in got if x[0] != 9} == {(1, "x"), (7, "z"), (3, "p"), (3, "q")} and sum(x[0] == 9 for x in got) == 1
    assert sorted((tuple(r) for r in ngram_join.jaccard_classes(docs).collect()), key=str) == brute_classes(rows)


def test_prefix_tree_links_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        base = rng.sample(range(60), 25)
        sets = list({tuple(sorted({*rng.sample(base, rng.randint(3, 25)), *rng.sample(range(100, 130), rng.randint(0, 4))})) for _ in range(25)})
        percent = rng.choice((50, 70, 80))
        edges = ngram_join.link_forest([np.array(s, dtype=np.uint64) for s in sets], percent)
        near = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        assert all(near(sets[a], sets[b]) for a, b in edges)

        def parts(pairs, n=len(sets)):
            group = list(range(n))
            for a, b in pairs:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
            return {frozenset(k for k in range(n) if group[k] == g) for g in group}

        assert parts(edges) == parts([(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if near(sets[a], sets[b])])


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + k, 201 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*pairs, (7, 7), (None, 3)], "u long, v long")).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(len(low)):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_language_models(docs, rows, empty):
    got = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    for doc_id, _, lang, _ in rows[:60]:
        assert got[doc_id]["lang_pred"] == lang and 0 <= got[doc_id]["score"] <= 1
    assert [got[k]["lang_pred"] for k in (300, 301, 302, 305)] == ["und"] * 4
    assert langid.predict_languages(empty).count() == 0
    kept = langid.keep_known(docs.withColumns({x: F.lit("mine") for x in ("lang_pred", "score", "rejected")}))
    assert {r["rejected"] for r in kept.collect()} == {"mine"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(60))
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("cells, part", [(300, 4_000_000), (6000, 600), (2, 600)])
def test_language_models_beyond_the_arrays_lose_no_n_gram(monkeypatch, docs, cells, part):
    """Some n-grams in the arrays, many and none; texts in one part and in several."""
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = order(langid.predict_languages(docs))
    monkeypatch.setattr(langid, "MAX_CELLS", cells)
    monkeypatch.setattr(langid, "PART", part)
    got = order(langid.predict_languages(docs))
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:3] == y[:3] and x[5] == y[5] and np.isclose(x[3], y[3], atol=1e-3)
        assert x[4] == y[4] or np.isclose(x[4], y[4], atol=1e-4)


def brute_kneser_ney(texts):
    """``p(lang, gram, order)`` of interpolated Kneser-Ney models of strings of symbols, from plain counts."""
    counts = {}
    for lang, text in texts:
        for code in langid.grams([text])[0].tolist():
            counts.setdefault(lang, {}).setdefault(langid.ORDER, {}).setdefault(code, 0)
            counts[lang][langid.ORDER][code] += 1
    for own in counts.values():
        for order in range(langid.ORDER - 1, 0, -1):
            own[order] = {}
            for code in own[order + 1]:
                low = code & ((1 << 16 * order) - 1)
                own[order][low] = own[order].get(low, 0) + 1
    vocabulary = len({c for own in counts.values() for c in own[1]}) + 1

    def p(lang, code, order):
        if order == 0:
            return 1 / vocabulary
        own = counts[lang][order]
        once, twice = (sum(n == k for n in own.values()) for k in (1, 2))
        cut = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
        below = p(lang, code & ((1 << 16 * (order - 1)) - 1), order - 1)
        rest = [n for c, n in own.items() if c >> 16 == code >> 16]
        return max(own.get(code, 0) - cut, 0) / sum(rest) + cut * len(rest) / sum(rest) * below if rest else below

    return p


def test_sixty_languages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "ASIDE_PART", 0.0)
    rng = random.Random(11)
    texts = []
    for k in range(60):
        letters = [chr(97 + (k * 7 + j * j) % 26) for j in range(5)] + [chr(0xE0 + k % 20)]
        texts += [(f"l{k:02}", " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(6))) for _ in range(2)]
    docs = spark.createDataFrame([(j, t, x) for j, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    p = brute_kneser_ney(texts)
    asked = np.unique(np.concatenate([langid.grams([t])[0] for _, t in texts[::40]]))
    model = langid.train(docs, F.lit(False))
    logs = model.log_probabilities(asked)
    for lang in ("l00", "l17", "l59"):
        want = np.log([p(lang, int(c), langid.ORDER) for c in asked])
        assert np.allclose(logs[:, model.langs.index(lang)], want, atol=1e-4)
    monkeypatch.setattr(langid, "MAX_CELLS", 10)
    spread = langid.train(docs, F.lit(False))
    tables = langid._tables(spread.langs, spread.counts)
    rows = langid._probabilities(tables, spark.createDataFrame([(int(c),) for c in asked.view(np.int64)], "gram long")).collect()
    assert len(rows) == len(asked)
    for k in (0, 17, 59):
        assert all(np.isclose(r["p"][k], p(spread.langs[k], r["gram"] % (1 << 64), langid.ORDER), rtol=1e-9) for r in rows)


@pytest.mark.parametrize("cells", [8_000_000, 10])
def test_language_score_and_rejection_equal_brute_force(spark, monkeypatch, cells):
    """Three languages and one of a single text, five times over; strange texts besides, which no one learns from."""
    monkeypatch.setattr(langid, "MAX_CELLS", cells)
    rng = random.Random(21)
    parts = {"de": ("ein", "sch", "keit", "ich", "ü"), "fr": ("eau", "ment", "ou", "que", "é"), "pl": ("szcz", "ow", "nie", "ź", "y")}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3)))
    texts = [(x, " ".join(word(x) for _ in range(rng.randint(2, 12)))) for x in parts for _ in range(25)] + [("en", "one text of thine own, five times")] * 5
    asked = [(None, "qwzx jvkk xxqq"), (None, "ein schich"), (None, "eau que ment"), (None, "ж" * 30), (None, "thine own"), (None, "12 ..."), (None, None)]
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts + asked)], "doc_id long, text string, lang string").repartition(3)
    rates = {x: min(langid.ASIDE_PART, langid.ASIDE / n) for x, n in ((x, sum(y == x for y, _ in texts)) for x in [*parts, "en"])}
    apart = {r["text"] for r in df.where("lang IS NOT NULL").where(langid.set_aside(rates)).collect()}
    assert apart
    whole, rest = brute_kneser_ney(texts), brute_kneser_ney([(x, t) for x, t in texts if t not in apart])
    symbols = lambda t: langid.grams([t])[0].tolist()
    cross = lambda p, x, t: -sum(np.log(p(x, c, langid.ORDER)) for c in symbols(t)) / len(symbols(t))
    seen = {}
    for x, t in texts:
        if t in apart and any(y == x and u not in apart for y, u in texts):
            seen.setdefault(x, []).append((cross(rest, x, t), len(symbols(t))))
    mean = {x: sum(c * n for c, n in rows) / sum(n for _, n in rows) for x, rows in seen.items()}
    spread = {x: np.sqrt(sum(n * (c - mean[x]) ** 2 for c, n in rows) / len(rows)) for x, rows in seen.items()}
    uniform = np.log(len({c & 0xFFFF for _, t in texts for c in symbols(t)}) + 1)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.train(df, F.lit(False))).collect()}
    rejections = set()
    for k, (_, t) in enumerate(texts + asked):
        if k < len(texts) and k % 6:
            continue
        if not t or not any(c.isalpha() for c in t):
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
            continue
        by = {x: cross(whole, x, t) for x in sorted([*parts, "en"])}
        best, n = min(by, key=lambda x: round(by[x], 9)), len(symbols(t))
        at = mean.get(best, np.mean(list(mean.values())))
        limit = at + max(langid.REJECT_ERRORS * spread.get(best, np.mean(list(spread.values()))) / np.sqrt(n), langid.REJECT_PART * (uniform - at))
        assert got[k]["lang_pred"] == best and abs(got[k]["cross_entropy"] - by[best]) < 1e-4
        assert abs(got[k]["score"] - 1 / sum(np.exp(-(v - by[best]) * n) for v in by.values())) < 1e-2
        assert got[k]["rejected"] == (by[best] > limit)
        rejections.add(got[k]["rejected"])
    assert rejections == {True, False} and got[len(texts) - 1]["lang_pred"] == "en" and got[len(texts) + 4]["lang_pred"] == "en"


def test_probabilities_of_a_context_sum_to_one(docs):
    model = langid.train(docs, F.lit(False))
    symbols = np.unique(langid.grams([r["text"] for r in docs.where("text is not null").collect()])[0] & np.uint64(0xFFFF))
    for context in ("the", "ei ", "zzz"):
        history = np.uint64(0)
        for c in context:
            history = history << np.uint64(16) | np.uint64(0 if c == " " else ord(c))
        total = np.exp(model.log_probabilities(history << np.uint64(16) | symbols).astype(float)).sum(axis=0)
        assert (total < 1.0001).all() and (total > 0.9).all()


def test_quality(spark, empty):
    rng = random.Random(4)
    texts = [(k, sentence(rng, "en", 40) if k % 3 else " ".join([sentence(rng, "en", 1)] * 40 if k % 2 else [w.upper() + "!!" for w in sentence(rng, "en", 40).split()]), int(k % 3 > 0)) for k in range(240)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in texts] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in texts if a % 4] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, quality.label_rows(labels, "quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    held = [(got[a] >= 0.5) == bool(c) for a, _, c in texts if a % 4 == 0]
    assert sum(held) / len(held) > 0.95
    assert quality.score(empty, model).count() == 0
    assert quality.fit(docs, quality.label_rows(labels.limit(0), "quality")).bias == 0.0


def brute_segments(scores):
    """The best segment, then those on either side of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = round(sum(scores[a:b]), 9)
            if s > 0 and (best is None or s > best[0]):
                best = (s, a, b)
    if best is None:
        return []
    _, a, b = best
    return [*brute_segments(scores[:a]), (a, b, best[0]), *((x + b, y + b, s) for x, y, s in brute_segments(scores[b:]))]


def test_maximal_segments():
    rng = random.Random(9)
    for _ in range(300):
        scores = [rng.uniform(-3, 2.5) for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_segments_take_linear_time():
    def seconds(scores):
        began = time.process_time()
        toxicity.maximal_segments(scores)
        return time.process_time() - began

    for scores in ([1.0, -0.5] * 40_000, [1.0, -1.5] * 40_000, [float(40_000 - k) * (1, -1)[k % 2] for k in range(80_000)], [-float(k) if k % 2 else 1.0 for k in range(80_000)]):
        seconds(scores[:1000])
        assert seconds(scores * 2) < 3 * seconds(scores) + 0.2


def test_k_comes_from_the_whole_tail():
    rng = np.random.default_rng(4)
    for k in (0.2, 3.0):
        z = log(k) - np.log(-np.log(rng.random(4000)))
        assert abs(toxicity._log_k(z) - log(k)) < 0.2
        spread = [toxicity._log_k(z[i : i + 200]) for i in range(0, 4000, 200)]
        assert abs(np.mean(spread) - log(k)) < 0.3 and np.std(spread) < 0.5
    assert toxicity._log_k(np.zeros(5)) == 0.0 and toxicity._log_k(np.array([2.0])) == 2.0


def test_negative_odds_of_a_word_count_without_stems():
    keys = np.sort(np.array([textkit.hash_word(w) for w in (b"harmless", b"grim", b"zero")], dtype=np.uint64))
    by_hash = {textkit.hash_word(b"harmless"): -2.0, textkit.hash_word(b"grim"): 1.5, textkit.hash_word(b"zero"): 0.0}
    scanner = toxicity.Scanner(keys, np.array([by_hash[int(k)] for k in keys]), -0.1)
    data = np.frombuffer(b"harmless grim grimly zero other", dtype=np.uint8)
    h, *_ = toxicity.tokens(data, np.array([0, len(data)]))
    want = [-2.0, 1.5, 1.5 if 4 in toxicity.STEMS else -0.1, -0.1, -0.1]
    assert scanner.worth(h).tolist() == want


def brute_scan(lexicon, text):
    """Words of a text and their scores, by plain look-ups."""
    out = []
    for m in re.finditer("[a-z\x80-\xff]+", text.encode().decode("latin-1").lower() if text.isascii() else text.encode().decode("latin-1").translate({k: k + 32 for k in range(65, 91)})):
        word = m[0].encode("latin-1")
        own = [lexicon.get(textkit.hash_word(w), 0.0) for w in dict.fromkeys([word, *(word[:k] for k in toxicity.STEMS)])]
        best = max((x for x in own if x), default=0.0)
        out.append((m.span(), best))
    return out


def test_log_odds_and_scan_equal_plain_loops(spark):
    rng = random.Random(21)
    bad, texts = ["vexom", "brigul", "snorpa"], []
    for k in range(150):
        words = sentence(rng, ("en", "de")[k % 2], 25).split()
        if k % 3 == 0:
            words[5:7] = [bad[k % 2], bad[2]]
        texts.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in texts], "doc_id long, text string")
    model = toxicity.fit(docs, quality.label_rows(spark.createDataFrame([(a, c) for a, _, c in texts], "doc_id long, toxic int"), "toxic"))
    counts = {}
    for _, text, y in texts:
        own = set()
        for w in re.findall("[a-z\x80-\xff]+", text.encode().decode("latin-1")):
            own |= {w.encode("latin-1")[:k] for k in (*toxicity.STEMS, 999)}
        for w in own:
            counts.setdefault(w, [0, 0])[1 - y] += 1
    n1, n0 = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    favour = {w: lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2) - a * log(n1 / (n1 + n0)) - b * log(n0 / (n1 + n0)) for w, (a, b) in counts.items()}
    part = 0.01
    for _ in range(200):
        part = min(max(sum(1 / (1 + (1 - part) / part * exp(-round(x, 1))) for x in favour.values()) / len(favour), 1e-6), 0.5)
    want = {}
    for w, (a, b) in counts.items():
        pa_, pb = a + n1 / (n1 + n0) * (a + b), b + n1 / (n1 + n0) * (a + b)
        odds = log(pa_ / (2 * n1 - pa_)) - log(pb / (n0 + n1 - pb))
        want[textkit.hash_word(w)] = odds / (1 + exp(-min(favour[w], 50)) * (1 - part) / part)
    got = {r["token"] % (1 << 64): r["score"] for r in model.lexicon.collect()}
    assert all(abs(got.get(h, 0.0) - x) < 0.0101 for h, x in want.items()) and len(got) <= len(want)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k, text, _ in texts:
        line = brute_scan(got, text)
        worth = [s or model.other for _, s in line]
        normal = [(line[a][0][0], line[b - 1][0][1], model.scale * s - model.log_k - log(len(line))) for a, b, s in brute_segments(worth)]
        evidence = toxicity.order_evidence([e for _, _, e in normal if e > 0])
        assert scored[k]["evidence"] == pytest.approx(evidence, abs=1e-6)
        assert scored[k]["score"] == pytest.approx(1 / (1 + exp(-model.slope * log(1 + evidence) - model.intercept)), abs=1e-6)
        raw = text.encode()
        assert [(p["start"], p["end"]) for p in scored[k]["passages"]] == [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b, e in normal if e > toxicity.LEVEL]


def test_lexicon_beyond_a_size_is_joined(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(k, sentence(rng, "en", 30) + (" scum and scum" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(120)] + [(500, None, 0), (501, "", 0)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in texts], "doc_id long, text string").repartition(3)
    labels = quality.label_rows(spark.createDataFrame([(a, c) for a, _, c in texts], "doc_id long, toxic int"), "toxic")
    model = toxicity.fit(docs, labels)
    want = sorted(map(tuple, toxicity.score(docs, model).collect()))
    monkeypatch.setattr(toxicity, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 2000)
    assert sorted(map(tuple, toxicity.score(docs, model).collect())) == want


def test_toxicity(spark, empty):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scum", "loser"]
    texts = []
    for k in range(400):
        words = sentence(rng, "en", 60).split()
        if k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "!", "."])
        texts.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in texts] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in texts if a % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, quality.label_rows(labels, "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[a]["score"] >= 0.5) == bool(c) for a, _, c in texts if a % 5 == 0]
    assert sum(held) / len(held) > 0.95 and got[900]["score"] < 0.5
    for a, text, c in texts[:40]:
        for p in got[a]["passages"]:
            assert c and any(w in text[p["start"] : p["end"]] for w in bad)
    assert toxicity.score(empty, model).count() == 0


def test_toxic_words_of_a_small_training_set_count(spark):
    rng = random.Random(9)
    bad, texts = ["vexom", "brigul", "snorpa", "dwelkin", "quoft"], []
    for k in range(120):
        words = sentence(rng, "en", 60).split()
        if k < 12:  # each word is in 4 or 5 of 10 training texts
            words[20:22] = [bad[k % 5], bad[(k + 2) % 5]]
        texts.append((k, " ".join(words), int(k < 12)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in texts if a >= 2 and a < 100], "doc_id long, toxic int")
    model = toxicity.fit(docs, quality.label_rows(labels, "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(got[a] >= 0.5 for a in (0, 1)) and sum(got[a] >= 0.5 for a in range(100, 120)) <= 1


def test_mixing(docs, empty, rows):
    plan = mixing.sampling_plan(docs).toPandas()
    assert len(plan) == len(rows)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    want = con.execute(mixing.plan_sql()).df()
    names = sorted(plan.columns)
    order = lambda t: t[names].astype(str).sort_values(names).reset_index(drop=True)
    plan["doc_id"], want["doc_id"] = plan["doc_id"].astype("float"), want["doc_id"].astype("float")
    assert order(plan).equals(order(want))
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    drawn = set(plan.loc[plan.sampled, "doc_id"].dropna().astype(int))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == drawn
    assert mixing.sampling_plan(empty).count() == 0 and mixing.sample(empty).count() == 0


def skewed(spark):
    rng = random.Random(4)
    rows = []
    for k in range(20000):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(4)}"
        rows.append((k, "w " * rng.randrange(5, 60), rng.choices(["en", "de", "es"], [12, 3, 1])[0], source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("listed", [1000, 2])
def test_sample_meets_its_targets_on_a_skewed_table(spark, monkeypatch, listed):
    monkeypatch.setattr(mixing, "LISTED", listed)
    monkeypatch.setattr(mixing, "ROUNDS", 20 if listed > 2 else 6)
    docs = skewed(spark)
    weights = {"lang": {"en": 6, "de": 3, "es": 1}}
    described = docs.select("source", "lang", F.lit("t").alias("topic"), F.regexp_count("text", F.lit(mixing.WORD)).cast("long").alias("n_tokens"))
    cells = mixing.raked_cells(described, weights, rounds=mixing.ROUNDS)
    found = mixing.reached(cells, weights).toPandas()
    assert (abs(found.share / found.target - 1) < (0.01 if listed > 2 else 0.02)).all() and len(found) == 9
    es = found[found.value == "es"].iloc[0]
    assert es.want == pytest.approx(0.1) and es.target == pytest.approx(cells.where("lang = 'es'").agg(F.sum("tokens")).first()[0] / 0.8 / cells.agg(F.sum("tokens")).first()[0])
    assert found[found.name == "lang"].target.sum() == pytest.approx(1) and cells.where("probability > 1").count() == 0
    if listed > 2:
        kept = mixing.sample(docs.withColumn("probability", F.lit(7)).withColumn("n_tokens", F.lit(1)), weights)
        drawn = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
        for x, t in found[found.name == "lang"].set_index("value").target.items():
            assert abs(drawn[x] / sum(drawn.values()) / t - 1) < 0.03
        assert "probability" in kept.columns and kept.where("probability <> 7").count() == 0


def test_raked_cells_equal_a_plain_loop(spark):
    rng = random.Random(8)
    cells = list({(f"s{rng.randrange(5)}", f"l{rng.randrange(3)}", f"t{rng.randrange(4)}"): rng.randrange(1, 1000) for _ in range(300)}.items())
    rows = [(*k, n) for k, n in cells]
    raked = mixing.raked_cells(spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long"), rounds=7).collect()
    total = sum(n for *_, n in rows)
    names, free, targets = list(mixing.TEMPER), {k: n / total for k, n in cells}, {}
    for at, name in enumerate(names):
        sums = {}
        for k, n in cells:
            sums[k[at]] = sums.get(k[at], 0) + n
        raw = {v: (n / total) ** mixing.TEMPER[name] for v, n in sums.items()}
        want = {v: x / sum(raw.values()) for v, x in raw.items()}
        cap = {v: n / (0.8 * total) for v, n in sums.items()}
        order, left, open_ = sorted(want, key=lambda v: cap[v] / want[v]), 1.0, sum(want.values())
        for v in order:
            targets[at, v] = min(cap[v], want[v] * left / open_)
            left, open_ = left - targets[at, v], open_ - want[v]
    for _ in range(7):
        for at in range(3):
            held = {}
            for k, n in cells:
                held[k[at]] = held.get(k[at], 0) + min(n / (0.8 * total), free[k])
            free = {k: x * targets[at, k[at]] / held[k[at]] for k, x in free.items()}
    for r in raked:
        cap = r["tokens"] / (0.8 * total)
        assert r["share"] == pytest.approx(min(cap, free[r["source"], r["lang"], r["topic"]]), rel=1e-6)
