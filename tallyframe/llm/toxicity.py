"""Toxic passages by maximum-scoring segments.

Token scores are log-odds of document frequencies in toxic and other labelled texts under an
informative Dirichlet prior taken from both together. Each counted token's log-odds, positive or
negative, are shrunk by the probability that it is not neutral: a mixture over all tokens of a toxic
share equal to that of all texts and of any share, whose weight is learnt. Scores stand to two places,
and tokens without one are neutral. Tokens are words and the beginnings of longer words, which stand
for inflected forms; a word scores as the best of its tokens that have a score, which is negative if theirs all
are, and words without any share one negative score. A
linear-time scan finds every maximal segment of positive sum.

A segment of sum S in a text of n words has the normalised score ``scale * S - ln(K * n)``: the scale is
Karlin and Altschul's root under the other texts, K the constant of the extreme value distribution
of their best sums, by maximum likelihood over its upper tail. Segments above LEVEL are significant. How many segments
reach a score by chance is Poisson, so the r-th best one bounds the p-value of r segments; a text's
evidence is the best such bound, as a logarithm, and is calibrated to a probability by a logistic model.
Scale, K and calibration score each labelled text by the counts of the others.

The lexicon is a table. Up to BROADCAST_TOKENS of it go to every task; beyond, and for the calibration,
texts are dealt into chunks of bounded size, a chunk's distinct tokens are joined with the lexicon by
shuffle, and each chunk is scanned with the scores that came back.

Defined results: null and empty texts have no token and no evidence; without labelled rows of both
classes there is no lexicon and every score is the share of toxic labels (0 without any);
repeated labels of an id count once, the largest; null labels are left out; repeated rows agree;
a null id keeps its row; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textkit
from tallyframe.llm.quality import label_rows
from tallyframe.llm.scratch import materialise

#: Labelled rows on which evidence is calibrated.
CALIBRATION = 6000
#: Part of the other texts whose best sums count as they are in K's fit, all others as below them, and the
#: normalised score from which a segment is significant: 1 in 20 texts has one by chance.
TAIL, LEVEL = 0.05, 3.0
#: Labels up to this many are sent to the scan of the texts; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Tokens of the lexicon up to this many are sent to every task, 16 bytes each.
BROADCAST_TOKENS = 4_000_000
#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 16 << 20

#: Lengths in bytes of the beginnings of words that are tokens beside the words.
STEMS = (5, 6, 7, 8)

NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters and of their beginnings, their texts, starts and ends.

    Hashes have a row for whole words and one for each of STEMS, which repeats a shorter word.
    """
    data = textkit.LOWER_AZ[data]
    starts, ends, doc = textkit.words(data, offsets, NOT_LETTER)
    if not len(starts):
        return np.zeros((1 + len(STEMS), 0), dtype=np.uint64), doc, starts, ends
    return textkit.span_hashes(data, starts, [ends, *(np.minimum(ends, starts + k) for k in STEMS)]), doc, starts, ends


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments of positive sum, as ``start, end, sum``, in linear time.

    Each open segment keeps the running total before it and at its end, and a link to the nearest
    earlier one that began lower. A new positive score opens a segment; it swallows the nearest
    open segment that began lower, as long as its own total is the higher one. Links jump over
    all that a lower beginning rules out, so each is followed once.
    """
    total = 0.0
    kept: list[tuple[int, float, float, int, int]] = []
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        begin, low, high = at, before, total
        k = len(kept) - 1
        while k >= 0 and kept[k][1] >= low:
            k = kept[k][4]
        while k >= 0 and kept[k][2] < high:
            begin, low, link = kept[k][0], kept[k][1], kept[k][4]
            del kept[k:]
            k = link
        kept.append((begin, low, high, at + 1, k))
    return [(begin, end, high - low) for begin, low, high, end, _ in kept]


def order_evidence(normalised: list[float]) -> float:
    """Evidence of significant segments: minus the logarithm of the least p-value of their r best.

    By chance, segments of at least a normalised score s are Poisson with mean exp(-s), so r of them
    have a p-value of at most exp(-r s) / r!; every further one doubles it, for the choice of r.
    """
    best = 0.0
    for r, s in enumerate(sorted(normalised, reverse=True), 1):
        best = max(best, r * s + lgamma(r + 1) - (r - 1) * log(2))
    return best


@dataclass
class Scanner:
    """Scores of tokens, by sorted hash, and of all others; scale and K of sums by chance."""

    keys: np.ndarray
    scores: np.ndarray
    other: float
    scale: float = 1.0
    log_k: float = 0.0

    @classmethod
    def of(cls, table: pa.Table, model: Model) -> Scanner:
        keys = table.column(0).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], table.column(1).combine_chunks().to_numpy(zero_copy_only=False)[order], model.other, model.scale, model.log_k)

    def worth(self, h: np.ndarray) -> np.ndarray:
        """Scores of words from the hashes of their tokens: that of the best one that has a score, ``other`` without any."""
        coded = pa.array(h[0]).dictionary_encode()
        index = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), dtype=np.int64)
        first[index[::-1]] = np.arange(len(index))[::-1]
        best = np.full(len(first), -np.inf)
        for row in h[:, first]:
            at = np.minimum(np.searchsorted(self.keys, row), len(self.keys) - 1)
            best = np.maximum(best, np.where((self.keys[at] == row) & (self.scores[at] != 0), self.scores[at], -np.inf))
        return np.where(np.isneginf(best), self.other, best)[index]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
        """Texts with words: number, scores of words, segments, byte starts and ends of words.

        Neighbouring words of one sign are never parted by a maximal segment, so they count as one.
        """
        data, offsets = textkit.buffers(texts)
        if not len(self.keys):
            return
        for i, j in textkit.blocks(offsets):
            h, doc, starts, ends = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not h.size:
                continue
            worth = self.worth(h)
            up = worth > 0
            run = np.flatnonzero(np.concatenate([[True], (up[1:] != up[:-1]) | (doc[1:] != doc[:-1])]))
            sums = np.add.reduceat(worth, run)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            cut = np.searchsorted(run, first)
            positive = np.concatenate([[0], np.cumsum(up)])
            for d in np.flatnonzero(np.diff(first)):
                a, b = first[d], first[d + 1]
                found: list[tuple[int, int, float]] = []
                if positive[b] > positive[a]:
                    edge = np.append(run[cut[d] : cut[d + 1]], b) - a
                    found = [(int(edge[x]), int(edge[y]), s) for x, y, s in maximal_segments(sums[cut[d] : cut[d + 1]].tolist())]
                base = offsets[i + d] - offsets[i]
                yield i + int(d), worth[a:b], found, starts[a:b] - base, ends[a:b] - base

    def evidence(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        total, lists = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        for d, words, found, starts, ends in self.scan(texts):
            level = self.log_k + log(len(words))
            if not (found := [(a, b, self.scale * s - level) for a, b, s in found if self.scale * s > level]):
                continue
            raw = np.frombuffer(texts[d].as_py().encode(), dtype=np.uint8)
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            total[d] = order_evidence([e for _, _, e in found])
            found = [x for x in found if x[2] > LEVEL]
            lists[d] = [{"start": int(lead[starts[a]]), "end": int(lead[ends[b - 1]]), "evidence": float(e)} for a, b, e in found]
        return pa.RecordBatch.from_arrays([ids, pa.array(total), pa.array(lists, _PASSAGES)], names=["doc_id", "evidence", "passages"])

    def chances(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """Words by score, and of each text its words and the sum of its best segment."""
        rows: list[tuple] = []
        for _, words, found, _, _ in self.scan(texts):
            rows += [(float(s), int(n), None, None) for s, n in zip(*np.unique(np.round(words, 2), return_counts=True), strict=True)]
            rows.append((None, None, max((s for _, _, s in found), default=0.0), len(words)))
        kinds = (pa.float64(), pa.int64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["score", "n", "top", "words"])


@dataclass
class Model:
    """``lexicon``: table of ``token, score``, and the scores without a text of either class."""

    lexicon: DataFrame | None
    size: int
    #: Score of any other token; scale and log K of sums by chance; slope and intercept of the calibration.
    other: float = 0.0
    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0


def count_tokens(labelled: DataFrame) -> DataFrame:
    """``token, toxic, other``: labelled texts of each class that have the token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            data, offsets = textkit.buffers(batch.column(0))
            pairs = []
            for i, j in textkit.blocks(offsets):
                h, doc, _, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for d in np.flatnonzero(np.diff(cut)):
                    own = np.unique(h[:, cut[d] : cut[d + 1]])
                    pairs.append((own, np.full(len(own), label[i + d])))
            if pairs:
                h, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                order = np.argsort(h)
                h, y = h[order], y[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                toxic = np.add.reduceat(y, first)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((np.diff(first, append=len(h)) - toxic).astype(np.int64))], names=["token", "toxic", "other"])

    return labelled.select("text", F.col("label").cast("long")).mapInArrow(run, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon from all labelled rows, the calibration from a bounded sample of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    plain = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(sizes) < 2:
        return Model(None, 0, slope=0.0, intercept=plain)
    labelled = rows.join(F.broadcast(labels) if total <= BROADCAST_ROWS else labels, "doc_id")
    counts = materialise(count_tokens(labelled), "tokens")
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    if not sums["toxic"] or not sums["other"]:
        return Model(None, 0, slope=0.0, intercept=plain)
    n1, n0 = float(sums["toxic"]), float(sums["other"])
    toxic, seen = F.col("toxic").cast("double"), F.col("other").cast("double")
    pairs = materialise(counts.groupBy("toxic", "other").count(), "pairs")  # few: most tokens are rare
    part = _part(pairs.groupBy(F.round(_favour(toxic, seen, n1, n0), 1).alias("x")).agg(F.sum("count").alias("count")).toArrow())
    own = {"score": (toxic, seen), "apart1": (toxic - 1, seen), "apart0": (toxic, seen - 1)}
    scored = pairs.select("toxic", "other", *(shrunken(t, o, n1, n0, part).alias(x) for x, (t, o) in own.items()), _certain(toxic, seen, n1, n0, part).alias("certain"))
    scored = materialise(scored.where(" or ".join(f"{x} != 0" for x in own)), "scored")
    lexicon = materialise(counts.join(F.broadcast(scored) if scored.count() <= BROADCAST_ROWS else scored, ["toxic", "other"]), "lexicon")
    bad = F.when(F.col("score") > 0, F.col("certain")).otherwise(0.0)
    found = lexicon.agg(F.count_if(F.col("score") != 0).alias("size"), F.coalesce(F.sum(toxic * bad), F.lit(0.0)).alias("q1"), F.coalesce(F.sum(seen * bad), F.lit(0.0)).alias("q0")).first()
    rest = min(log((1 - min(found["q1"] / n1, 0.99)) / (1 - min(found["q0"] / n0, 0.98))), -1e-3)
    model = Model(lexicon, found["size"], rest)
    rate = {y: min(1.0, CALIBRATION / 2 / n) for y, n in sizes.items()}
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.create_map(*(F.lit(x) for y, r in rate.items() for x in (y, r)))[F.col("label")] * (1 << 30))
    texts = materialise(rows.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("long").alias("doc_id"), "text"), "calibration")
    drawn = _by_chunks(texts.where("doc_id = 0"), model, "apart0", Scanner.chances, "score double, n long, top double, words long").toArrow().to_pandas()
    words = drawn.dropna(subset="score").groupby("score")["n"].sum()
    best = drawn.dropna(subset="top")
    if len(best):
        model.scale = _scale(words.index.to_numpy(), words.to_numpy() / words.sum(), rest)
        model.log_k = _log_k((model.scale * best["top"] - np.log(best["words"])).to_numpy())
    sample = []
    for y in (0, 1):
        found = _by_chunks(texts.where(F.col("doc_id") == y), model, f"apart{y}", Scanner.evidence, EVIDENCE)
        sample += [(r["x"], y, r["count"]) for r in found.groupBy(F.round(F.log1p("evidence"), 2).alias("x")).count().collect()]
    x, y, n = (np.array(c, dtype=float) for c in zip(*sample, strict=True)) if sample else (np.zeros(0),) * 3
    model.slope, model.intercept = _logistic(x, y, n / np.where(y == 1, rate[1], rate[0])) if len(set(y)) == 2 else (1.0, plain)
    return model


def _log_k(z: np.ndarray) -> float:
    """Log K by maximum likelihood over the upper TAIL of best sums less the logarithm of their words.

    A best sum is at most z with probability exp(-K exp(-z)). Those at the tail's lower end or above count as they
    are, the others as being below it, so that every sum has its say and the bulk, which fits worse, has no other.
    """
    low = np.quantile(z, 1 - TAIL, method="higher")
    above = z[z >= low]
    return float(log(len(above)) - np.log(np.exp(low - above).sum() + len(z) - len(above)) + low)


def _log_factorial(x: Column) -> Column:
    y = F.greatest(x, F.lit(1.0))
    return F.when(x < 1.5, 0.0).otherwise(y * F.log(y) - y + F.log(y * (2 * np.pi)) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y))


def _favour(toxic: Column, other: Column, n1: float, n0: float) -> Column:
    """Log likelihood ratio of counts under any toxic share and under that of all texts."""
    share = n1 / (n1 + n0)
    any_share = _log_factorial(toxic) + _log_factorial(other) - _log_factorial(toxic + other + 1)
    return any_share - toxic * float(np.log(share)) - other * float(np.log(1 - share))


def _part(table: pa.Table) -> float:
    """The part of tokens that are not neutral, by expectation-maximisation over ``x, count``."""
    x, n = np.clip(table.column("x").to_numpy(), -50, 50), table.column("count").to_numpy()
    part = 0.01
    for _ in range(200):
        p = 1 / (1 + (1 - part) / part * np.exp(-x))
        part = float(np.clip((n * p).sum() / n.sum(), 1e-6, 0.5))
    return part


def _certain(toxic: Column, other: Column, n1: float, n0: float, part: float) -> Column:
    """The probability that a token is not neutral."""
    favour = F.greatest(F.least(_favour(toxic, other, n1, n0), F.lit(50.0)), F.lit(-50.0))
    return 1 / (1 + F.exp(-favour) * ((1 - part) / part))


def shrunken(toxic: Column, other: Column, n1: float, n0: float, part: float) -> Column:
    """Log-odds under the Dirichlet prior times the probability that a token is not neutral."""
    prior = F.lit(n1 / (n1 + n0)) * (toxic + other)
    a, b = toxic + prior, other + prior
    odds = F.log(a / (2 * n1 - a)) - F.log(b / (n0 + n1 - b))
    return F.when((toxic < 0) | (other < 0) | (toxic + other < 1), 0.0).otherwise(F.coalesce(F.round(odds * _certain(toxic, other, n1, n0, part), 2), F.lit(0.0)))


def _scale(scores: np.ndarray, q: np.ndarray, other: float) -> float:
    """The positive root of ``E[exp(scale * score)] = 1`` under the other texts, by bisection."""
    if not len(scores):
        return 0.0
    rest = max(1 - q.sum(), 1e-9)
    excess = lambda k: float((q * np.exp(k * scores)).sum() + rest * np.exp(k * other) - 1)
    if float((q * scores).sum() + rest * other) >= 0:
        return 0.1  # no negative drift: a small scale, so that only long sums count
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps on smoothed counts."""
    design = np.stack([np.append(x, x), np.ones(2 * len(x))], axis=1)
    target, w = np.append(y, 1 - y), np.append(weight, np.full(len(x), 0.01))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, design.T @ (w * (target - p)) - 1e-3 * theta)
    return max(float(theta[0]), 0.0), float(theta[1])


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
EVIDENCE = "doc_id long, evidence double, passages array<struct<start:long,end:long,evidence:double>>"


def _by_chunks(rows: DataFrame, model: Model, column: str, scan: Callable, schema: str) -> DataFrame:
    """``scan`` of the texts of ``doc_id, text``, each chunk of them with its own part of the lexicon."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        seen: list[np.ndarray] = []

        def listed() -> pa.RecordBatch:
            own = [np.unique(np.concatenate(seen)).view(np.int64)] if seen else [np.zeros(0, dtype=np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array(own, pa.list_(pa.int64()))], names=["chunk", "doc_id", "text", "tokens"])

        for batch in batches:
            data, offsets = textkit.buffers(batch.column(1))
            for i, j in textkit.blocks(offsets):
                more = int(offsets[j] - offsets[i])
                if size and size + more > CHUNK_BYTES:
                    yield listed()
                    chunk, size, seen = chunk + 1, 0, []
                size += more
                seen.append(np.unique(tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, chunk)), part.column(0), part.column(1), pa.nulls(j - i, pa.list_(pa.int64()))], names=["chunk", "doc_id", "text", "tokens"])
        yield listed()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scanner = Scanner.of(right.select(["token", "score"]), bare)
        out = [scan(scanner, b.column(0), b.column(1)) for b in left.select(["doc_id", "text"]).combine_chunks().to_batches()]
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([scan(scanner, pa.nulls(0, pa.int64()), pa.nulls(0, pa.string()))])

    bare = replace(model, lexicon=None)
    dealt = materialise(rows.mapInArrow(deal, "chunk long, doc_id long, text string, tokens array<long>"), "chunks")
    own = dealt.where(F.col("tokens").isNotNull()).select("chunk", F.explode("tokens").alias("token"))
    found = own.join(model.lexicon.where(F.col(column) != 0).select("token", F.col(column).alias("score")), "token").select(F.col("chunk").alias("of"), "token", "score")
    return dealt.where(F.col("tokens").isNull()).select("chunk", "doc_id", "text").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, evidence, passages`` of each row; passages are code points ``start, end``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model.size > BROADCAST_TOKENS:
        return _by_chunks(rows, model, "score", Scanner.evidence, EVIDENCE)
    table = model.lexicon.where("score != 0").select("token", "score").toArrow() if model.lexicon is not None else pa.table({"token": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    shared = docs.sparkSession.sparkContext.broadcast(Scanner.of(table, model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield shared.value.evidence(batch.column(0), batch.column(1))

    return rows.mapInArrow(run, EVIDENCE)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, evidence, passages`` of each row."""
    odds = F.lit(model.slope) * F.log1p("evidence") + F.lit(model.intercept)
    return evidence(docs, model).select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"), "evidence", "passages")


__all__ = ["Model", "Scanner", "count_tokens", "evidence", "fit", "label_rows", "maximal_segments", "order_evidence", "score"]
