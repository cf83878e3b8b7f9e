"""Quality classification by supervised subword embeddings.

Words and character n-grams are hashed to rows of a table of learned vectors, and pairs of
neighbouring words have two rows of their own, for a repetition and for a change; a text is the
average of its rows and a softmax over it gives the classes. The table is trained by numpy stochastic
gradient descent on a bounded, class-balanced sample of labelled rows, whose features are counted
by tasks, so the driver holds no text; class priors are those of all labelled rows. Scoring folds table and output layer into one number for each row, so a text
of any length is one pass of look-ups.

Defined results: null and empty texts have no features and get the prior; without labelled rows
of both classes every score is the share of label 1 (0.5 without any); repeated labels of an id
count once, the largest; null labels are left out; repeated rows agree; a null id keeps its row;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textkit

BITS = 18
ROWS = (1 << BITS) + 2
WIDTH = 8
GRAMS = (3, 4, 5)
#: Labelled rows of each class that training takes; each has at most a number for every row of the table.
SAMPLE = 1500
EPOCHS = 6
RATE = 4.0
SEED = 7

_spread = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of features and the texts they belong to, one kind of feature after the other."""
    shift = np.uint64(64 - BITS)
    starts, ends, doc = textkit.words(data, offsets)
    if len(starts):
        h = textkit.span_hashes(data, starts, ends)
        yield (h >> shift).astype(np.int64), doc
        same = doc[1:] == doc[:-1]  # pairs of words: the same word again, or another
        yield (1 << BITS) + (h[1:] == h[:-1])[same].astype(np.int64), doc[1:][same]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    code = points
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            return
        code = code[:-1] * _spread + points[n - 1 :]
        if n in GRAMS:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            yield (textkit.mix64(code[inside] + np.uint64(n)) >> shift).astype(np.int64), doc[n - 1 :][inside]


@dataclass
class Model:
    """Contribution of each feature row to the log-odds of label 1, and the bias."""

    weights: np.ndarray
    bias: float

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        data, offsets = textkit.buffers(texts)
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in textkit.blocks(offsets):
            total, count = np.zeros(j - i), np.zeros(j - i)
            at = offsets[i : j + 1] - offsets[i]
            for rows, doc in features(data[offsets[i] : offsets[j]], at):
                total += np.bincount(doc, weights=self.weights[rows], minlength=j - i)
                count += np.bincount(doc, minlength=j - i)
            some = count > 0
            out[i:j][some] += total[some] / count[some]
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> Model:
    """From the features of each text, as rows and shares.

    ``prior``: log-odds of label 1 among all labelled rows, less those of the sample.
    """
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ table[ids]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            if len(ids):
                table[ids] -= (rate * share / max(float(share @ share), 1e-6) * 0.02)[:, None] * back
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + prior)


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label`` of each labelled id."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label")).where("label in (0, 1)")


def sample_features(docs: DataFrame, labelled: DataFrame, per_class: int, seed: int) -> tuple[pa.Table | None, dict[int, int]]:
    """``doc_id, label, ids, shares`` of about ``per_class`` rows of each class, chosen by hash, and class sizes."""
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not sizes:
        return None, {}
    rate = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, per_class / n))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < rate[F.col("label")] * (1 << 30))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shares = [], []
            for text in batch.column(2).to_pylist():
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                found = [r for r, _ in features(data, np.array([0, len(data)]))]
                own, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))
                ids.append(own.astype(np.int32))
                shares.append((counts / max(counts.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "label", "ids", "shares"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(run, "doc_id long, label int, ids array<int>, shares array<float>").toArrow()
    # repeated ids in the order of their features, so that training does not depend on the order of tasks
    order = sorted(range(rows.num_rows), key=lambda k: (rows["doc_id"][k].as_py(), rows["ids"][k].values.to_numpy().tobytes(), rows["shares"][k].values.to_numpy().tobytes()))
    return rows.take(order), sizes


def fit(docs: DataFrame, labelled: DataFrame) -> Model:
    sample, sizes = sample_features(docs, labelled, SAMPLE, SEED)
    labels = sample["label"].to_numpy() if sample is not None else np.zeros(0, dtype=np.int64)
    counts = np.bincount(labels, minlength=2)
    total = sum(sizes.values())
    if not counts.all():
        share = sizes.get(1, 0) / total if total else 0.5
        return Model(np.zeros(ROWS, dtype=np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    prior = np.log(sizes[1] / sizes[0]) - np.log(counts[1] / counts[0])
    rows = [(i.values.to_numpy(), w.values.to_numpy()) for i, w in zip(sample["ids"], sample["shares"], strict=True)]
    return train(rows, labels, float(prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.clip(shared.value.log_odds(batch.column(1)), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
