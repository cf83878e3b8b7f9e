"""The quality classifier held to a plain one: features by hand, training in loops."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import quality, queries, textkit

MASK = (1 << 64) - 1
SPREAD = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def counted(text):
    """Shares of the feature rows of one text."""
    counts, add = {}, lambda k: counts.__setitem__(k, counts.get(k, 0) + 1)
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    for k, word in enumerate(words):
        add(textkit.hash_word(word.encode()) >> 64 - quality.BITS)
        if k:
            add((1 << quality.BITS) + (word == words[k - 1]))
    points = [ord(c) for c in text or ""]
    for n in quality.GRAMS:
        for at in range(len(points) - n + 1):
            code = points[at]
            for p in points[at + 1 : at + n]:
                code = code * SPREAD + p & MASK
            add(mixed(code + n & MASK) >> 64 - quality.BITS)
    total = sum(counts.values())
    return {k: c / total for k, c in sorted(counts.items())}


def trained(rows, prior):
    """Log-odds of any text from stochastic gradient descent over the rows, number by number."""
    rng = np.random.default_rng(quality.SEED)
    first = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.ROWS, quality.WIDTH)).astype(np.float32)
    table, wide = {}, range(quality.WIDTH)
    row = lambda k: table.setdefault(k, [float(x) for x in first[k]])
    out, bias, done = [[0.0, 0.0] for _ in wide], [0.0, 0.0], 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(rows)):
            shares, label = rows[k]
            rate = quality.RATE * (1 - done / (quality.EPOCHS * len(rows)))
            done += 1
            hidden = [sum(s * row(f)[j] for f, s in shares.items()) for j in wide]
            odds = [sum(hidden[j] * out[j][c] for j in wide) + bias[c] for c in (0, 1)]
            high = max(odds)
            p = [math.exp(x - high) for x in odds]
            p = [x / sum(p) for x in p]
            p[label] -= 1
            back = [sum(out[j][c] * p[c] for c in (0, 1)) for j in wide]
            for c in (0, 1):
                bias[c] -= 0.01 * rate * p[c]
                for j in wide:
                    out[j][c] -= 0.1 * rate * hidden[j] * p[c]
            size = max(sum(s * s for s in shares.values()), 1e-6)
            for f, s in shares.items():
                own = row(f)
                for j in wide:
                    own[j] -= rate * s / size * 0.02 * back[j]

    def log_odds(text):
        hidden = [sum(s * row(f)[j] for f, s in counted(text).items()) for j in wide]
        return sum(hidden[j] * (out[j][1] - out[j][0]) for j in wide) + bias[1] - bias[0] + prior

    return log_odds


def test_scores_equal_training_by_hand(spark, docs, rows, tmp_path):
    """The registered query, over texts with nulls, a long one, repeated rows, a null id and clashing columns."""
    docs.withColumn("score", F.lit("mine")).withColumn("label", F.lit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    label = {i: int(lang == "en") for i, _, lang, _ in rows if i is not None and (i < 45 or i >= 300)}
    told = [(i, y, 0) for i, y in label.items()] + [(1, 0, 0), (None, 1, 0), (50, None, 0)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    label[1] = max(label[1], 0)
    learned = {i: y for i, y in label.items() if not held(i)}
    order = sorted((i, list(counted(t)), t) for i, t, *_ in rows if i in learned)
    sample = [(counted(t), learned[i]) for i, _, t in order]
    sizes, drawn = (np.bincount(list(ys), minlength=2) for ys in (learned.values(), [y for _, y in sample]))
    log_odds = trained(sample, math.log(sizes[1] / sizes[0]) - math.log(drawn[1] / drawn[0]))
    got = queries.op8_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        if t not in want:
            want[t] = 1 / (1 + math.exp(-min(max(log_odds(t), -30), 30)))
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, set()).add(t)
    for r in got:
        near = min(abs(r["score"] - want[t]) for t in by_id[r["doc_id"]])
        assert near < 2e-3 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == held(r["doc_id"])
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[300] == scores[301] and len({scores[k] for k in range(100, 105)}) == 1
