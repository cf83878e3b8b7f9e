"""SentencePiece encoding and decoding with exact n-best segmentation.

Every way to cut a text into vocabulary pieces is a path through a lattice. A forward Viterbi pass
gives the best score of each prefix; searching backward from the end by A-star with those scores,
which are exact, yields complete segmentations in order. Where no piece holds two neighbouring
bytes the lattice has a single node, so a text falls into chunks whose lattices are solved once;
the n best of a text combine the n best of its chunks. Forward and backward passes run over many
short chunks at once and give each its best segmentation and the distance to the second best; only
the chunks of a text that are nearest to another segmentation are searched for it.

A character without a piece is an edge of its byte pieces, scored below every piece.

Defined results: null and empty texts have no piece and score 0; the sign U+2581 decodes as a
space; of segmentations of equal score, those that change fewer chunks of the best one come first,
then those that change earlier ones, and within a chunk the search takes the shorter last piece
first; repeated rows agree; a null id keeps its row; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import textkit

SPACE = "▁"
N_BEST = 3
CACHE_CHUNKS = 250_000
#: Rows of a task's output at a time.
ROWS = 500
#: How far below the lowest ordinary piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Pieces scored lower are not meant for segmentation.
NEVER = -1e8


#: Longest chunk, in characters, that is solved with others at once, and how many at a time.
MATRIX = 32
TOGETHER = 2000


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of rows of code points."""
    out = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * textkit._pow[: points.shape[1]], axis=1, out=out[:, 1:])
    return out


def _substring_hashes(sums: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all stretches of ``m`` code points of each row."""
    width = sums.shape[1] - 1
    return textkit.mix64((sums[:, m:] - sums[:, : width - m + 1]) * textkit._inv[: width - m + 1] + np.uint64(m))


def _least_sums(options: list[list[tuple[float, tuple]]], n: int) -> list[tuple[float, tuple, tuple]]:
    """The ``n`` least sums of gaps with at most one option of each list: sum, order of ties, options.

    Lists are merged one after the other and only the ``n`` least sums go on, so the work grows with
    their number and not with that of all combinations.
    """
    found: list[tuple[float, tuple, tuple]] = [(0.0, (0, ()), ())]
    for at, own in enumerate(options):
        more = ((gap + g, (count + 1, (*where, (at, k))), (*way, o)) for gap, (count, where), way in found for k, (g, o) in enumerate(own))
        found = heapq.nsmallest(n, itertools.chain(found, more), key=lambda x: x[:2])
    return found


class Pieces:
    """The vocabulary of a SentencePiece model as a lattice of pieces."""

    def __init__(self, path: str, n_best: int = N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = []
        for k in range(model.vocab_size()):
            name = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(name[3:5], 16)] = k
                self.text.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.text.append(b"")
            else:
                self.piece[name] = (k, model.get_score(k))
                self.text.append(name.replace(SPACE, " ").encode())
        #: Every beginning of a piece; None where it is no piece itself.
        self.begun: dict[str, tuple[int, float] | None] = {}
        for name in self.piece:
            for k in range(1, len(name)):
                self.begun.setdefault(name[:k], None)
            self.begun[name] = self.piece[name]
        self.unknown = min((s for _, s in self.piece.values() if s > NEVER), default=0.0) - UNKNOWN_PENALTY
        self.joined = np.zeros((256, 256), dtype=bool)
        for name in self.piece:
            raw = np.frombuffer(name.replace(SPACE, " ").encode(), dtype=np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # never within a character
        #: By length: sorted hashes of pieces, their ids and scores.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, MATRIX + 1):
            own = [(x, *v) for x, v in self.piece.items() if len(x) == n]
            points = np.array([[ord(c) for c in x] for x, _, _ in own], dtype=np.uint32).reshape(len(own), n)
            keys = _substring_hashes(_prefix_sums(points), n)[:, 0] if own else np.zeros(0, dtype=np.uint64)
            order = np.argsort(keys)
            self.by_length.append((keys[order], np.array([k for _, k, _ in own], dtype=np.int32)[order], np.array([v for _, _, v in own])[order]))
        self.number: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.number.clear()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.best = np.zeros(1 << 14)
        self.gap = np.full(1 << 14, np.inf)  # to the second best
        self.others: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def n_best_of(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a text as ``score, ids``, best first."""
        n, begun = len(chunk), self.begun
        forward = [0.0] + [-np.inf] * n
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            base, single = forward[i], False
            for j in range(i + 1, n + 1):
                found = begun.get(chunk[i:j], False)
                if found:
                    single |= j == i + 1
                    edges[j].append((i, found[1], (found[0],)))
                    if base + found[1] > forward[j]:
                        forward[j] = base + found[1]
                elif found is False:
                    break
            if not single:
                edges[i + 1].append((i, self.unknown, tuple(self.byte[b] for b in chunk[i].encode())))
                if base + self.unknown > forward[i + 1]:
                    forward[i + 1] = base + self.unknown
        out: list[tuple[float, tuple[int, ...]]] = []
        waiting = [(-forward[n], 0, n, 0.0, None)]  # of equal bound, the latest goes first
        made = 0
        while waiting and len(out) < self.n_best:
            _, _, at, done, behind = heapq.heappop(waiting)
            if at == 0:
                ids: list[int] = []
                while behind is not None:
                    ids += behind[0]
                    behind = behind[1]
                out.append((done, tuple(ids)))
                continue
            for i, score, own in edges[at]:
                made -= 1
                heapq.heappush(waiting, (-(forward[i] + score + done), made, i, score + done, (own, behind)))
        return out

    def _store(self, key: int, score: float, ids, gap: float) -> None:
        k = len(self.number)
        if k == len(self.start):
            self.start, self.length, self.best, self.gap = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.best, self.gap))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.length[k], self.best[k], self.gap[k] = self.used, len(ids), score, gap
        self.used += len(ids)
        self.number[key] = k

    def _learn(self, keys: list[int], chunks: list[str]) -> None:
        short: dict[int, list[int]] = {}
        for k, chunk in enumerate(chunks):
            if len(chunk) <= MATRIX:
                short.setdefault((len(chunk) + 3) // 4, []).append(k)
            else:
                self._searched(keys[k], chunk)
        for group in short.values():
            for at in range(0, len(group), TOGETHER):
                self._solved([keys[k] for k in group[at : at + TOGETHER]], [chunks[k] for k in group[at : at + TOGETHER]])

    def _searched(self, key: int, chunk: str) -> None:
        found = self.n_best_of(chunk)
        self._store(key, *found[0], found[0][0] - found[1][0] if len(found) > 1 else np.inf)

    def _solved(self, keys: list[int], chunks: list[str]) -> None:
        """Best segmentation and distance to the second best of chunks of similar length.

        The best score of a path through an edge is forward score, edge and backward score; the
        second best segmentation is the best through an edge that the best one lacks.
        """
        sizes = np.array([len(c) for c in chunks])
        n, width = len(chunks), int(sizes.max())
        points = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le"), dtype=np.uint32).reshape(n, width)
        sums = _prefix_sums(points)
        score = np.full((width, n, width), -np.inf)  # by length - 1, chunk, begin
        own = np.full((width, n, width), -1, dtype=np.int32)
        for m in range(1, width + 1):
            hashes, ids, values = self.by_length[m - 1]
            if len(hashes):
                h = _substring_hashes(sums, m)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = (hashes[at] == h) & (np.arange(width - m + 1) + m <= sizes[:, None])
                score[m - 1, :, : width - m + 1][hit] = values[at[hit]]
                own[m - 1, :, : width - m + 1][hit] = ids[at[hit]]
        score[0][(own[0] < 0) & (np.arange(width) < sizes[:, None])] = self.unknown
        forward, back = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), dtype=np.int64)
        forward[:, 0] = 0
        for p in range(1, width + 1):
            ways = np.stack([forward[:, p - m] + score[m - 1, :, p - m] for m in range(1, p + 1)])
            back[:, p] = ways.argmax(axis=0) + 1
            forward[:, p] = ways.max(axis=0)
        backward = np.full((n, width + 1), -np.inf)
        row = np.arange(n)
        backward[row, sizes] = 0
        for p in range(width - 1, -1, -1):
            ways = np.stack([score[m - 1, :, p] + backward[:, p + m] for m in range(1, width - p + 1)])
            backward[:, p] = np.maximum(backward[:, p], ways.max(axis=0))
        best = forward[row, sizes]
        on_best = np.zeros((width, n, width), dtype=bool)
        at, live = sizes.copy(), np.arange(n)
        paths = []
        while len(live):
            m = back[live, at[live]]
            at[live] -= m
            on_best[m - 1, live, at[live]] = True
            paths.append((live, at[live].copy(), m))
            live = live[at[live] > 0]
        second = np.full(n, -np.inf)
        for m in range(1, width + 1):
            through = forward[:, : width - m + 1] + score[m - 1, :, : width - m + 1] + backward[:, m:]
            through[on_best[m - 1, :, : width - m + 1]] = -np.inf
            second = np.maximum(second, through.max(axis=1))
        gap = best - second
        ids: list[list[int]] = [[] for _ in chunks]
        for rows, begins, lengths in reversed(paths):
            for c, b, m in zip(rows.tolist(), begins.tolist(), lengths.tolist(), strict=True):
                k = int(own[m - 1, c, b])
                if k >= 0:
                    ids[c].append(k)
                else:
                    ids[c] += [self.byte[x] for x in chunks[c][b].encode()]
        for c in range(n):
            if gap[c] <= 0:  # a tie, which the search orders
                self._searched(keys[c], chunks[c])
            else:
                self._store(keys[c], float(best[c]), ids[c], float(gap[c]))

    def _others(self, k: int, at: int, chunk: bytes) -> list[tuple[float, tuple[int, int, tuple[int, ...]]]]:
        """Gaps and replacements of a chunk's other segmentations, the chunk's ids being at ``at``."""
        if k not in self.others:
            found = self.n_best_of(chunk.decode().replace(" ", SPACE))
            self.others[k] = [(found[0][0] - s, i) for s, i in found[1:]]
        return [(g, (at, int(self.length[k]), ids)) for g, ids in self.others[k]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]]:
        """Of each text: best ids, scores of the n best, and what each other replaces in the best.

        A replacement is ``at, drop, ids`` on the best ids.
        """
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))
        data, offsets = textkit.buffers(texts)
        for i, j in textkit.blocks(offsets):
            block, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cut = np.ones(len(block) + 1, dtype=bool)
            cut[1:-1] = ~self.joined[block[:-1], block[1:]]
            cut[at] = True
            bounds = np.flatnonzero(cut)
            begin, end = bounds[:-1], bounds[1:]
            coded = pa.array(textkit.span_hashes(block, begin, end) if len(begin) else np.zeros(0, dtype=np.uint64)).dictionary_encode()
            keys, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(self.number) + len(keys) > CACHE_CHUNKS:
                self._reset()
            first = np.zeros(len(keys), dtype=np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            new = [(key, where) for key, where in zip(keys, first.tolist(), strict=True) if key not in self.number]
            self._learn([k for k, _ in new], [block[begin[w] : end[w]].tobytes().decode().replace(" ", SPACE) for _, w in new])
            number = np.fromiter((self.number[k] for k in keys), dtype=np.int64, count=len(keys))[index]
            lengths = self.length[number]
            before = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.flat[np.repeat(self.start[number] - before[:-1], lengths) + np.arange(before[-1])]
            chunk = np.searchsorted(begin, at)
            for d in range(j - i):
                a, b = chunk[d], chunk[d + 1]
                scores, swaps = [float(self.best[number[a:b]].sum())], [[]]
                if b > a and self.n_best > 1:
                    gap = self.gap[number[a:b]]
                    few = np.argsort(gap, kind="stable")[: self.n_best - 1]
                    few = np.sort(few[np.isfinite(gap[few])])
                    options = [self._others(int(number[a + c]), int(before[a + c] - before[a]), block[begin[a + c] : end[a + c]].tobytes()) for c in few.tolist()]
                    for gap, _, way in _least_sums(options, self.n_best)[1:]:
                        scores.append(scores[0] - gap)
                        swaps.append(list(way))
                yield ids[before[a] : before[b]], scores, swaps

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join([self.text[k] for k in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, n_best: int = N_BEST) -> Pieces:
    if (path, n_best) not in _loaded:
        _loaded[path, n_best] = Pieces(path, n_best)
    return _loaded[path, n_best]


ENCODED = "doc_id long, ids array<int>, scores array<double>, others array<array<struct<at:int,drop:int,ids:array<int>>>>"
_swap = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, model: str, n_best: int = N_BEST, decoded: bool = False) -> DataFrame:
    """``doc_id, ids, scores, others``: the best ids, scores of the n best, and the others' changes.

    With ``decoded``, also the ``text`` that the ids decode to.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(model, n_best)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                rows = list(lattice.encode(piece.column(1)))
                sizes = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
                others = pa.array([[[{"at": a, "drop": n, "ids": new} for a, n, new in way] for way in r[2][1:]] for r in rows], pa.list_(pa.list_(_swap)))
                out = {"doc_id": piece.column(0), "ids": ids, "scores": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "others": others}
                if decoded:
                    out["text"] = _decoded(lattice, ids)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED + ", text string" * decoded)


def _decoded(lattice: Pieces, ids: pa.ListArray) -> pa.Array:
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([lattice.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the ``text`` of its ``ids``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(lattice, part.column("ids"))], names=[*part.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode every text, decode its best ids, and digest both."""
    found = encode(docs, model, decoded=True)
    best = F.col("scores")[0]
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.round(best, 3).alias("best_score"),
        F.size("scores").cast("long").alias("n_best"),
        F.round(best - F.element_at("scores", -1), 3).alias("spread"),
        F.length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
