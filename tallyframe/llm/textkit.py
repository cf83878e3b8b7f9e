"""Vectorised helpers over batches of whole texts, used inside Arrow tasks.

A batch column of strings becomes one byte buffer plus document offsets; words, hashes and
n-gram codes are then numpy arrays over that buffer. Work goes through the buffer in blocks of
whole documents, so memory is bounded by the block size or the longest text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_pow = _powers(_MULTIPLIER, BLOCK + 1)
_inv = _powers(_INVERSE, BLOCK + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """An avalanche step over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes fit the limit; a longer document stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of non-separator bytes.

    ``offsets`` count from 0 within ``data``; a run never crosses a document's border.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separator[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span; with several arrays of ends, a row for each."""
    n = len(data)
    if n + 1 > len(_pow):
        power, inverse = _powers(_MULTIPLIER, n + 1), _powers(_INVERSE, n + 1)
    else:
        power, inverse = _pow, _inv
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    before, turn = total[starts], inverse[starts]
    rows = [mix64((total[e] - before) * turn + (e - starts).astype(np.uint64)) for e in (ends if isinstance(ends, list) else [ends])]
    return np.stack(rows) if isinstance(ends, list) else rows[0]


def hash_word(word: bytes) -> int:
    """``span_hashes`` of one word."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
