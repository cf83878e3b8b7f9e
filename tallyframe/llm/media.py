"""Media columns: texts as 8-bit WAV, short-time Fourier transforms, spectral-peak fingerprints.

``encode_media`` turns bytes into WAV files held in a binary column, ``fingerprints`` reads such a
column with the wave module and returns time-coded arrays of spectral-peak pairs.

Defined results: a null text counts as empty, whose payload is one frame of spaces; each row is
handled by itself, so ties and repeated rows keep their values; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.scratch import materialise

UNIT = 192
HOP = 96
RATE = 8000
#: Edges of the bands of spectral bins; each band gives one peak for each frame.
BANDS = (1, 7, 15, 31, 63, 97)
FAN_OUT = 3
MAX_GAP = 63
FRAMES_AT_ONCE = 4096

_window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(UNIT) / UNIT)).astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Times and codes of peak pairs, and the number of frames.

    A peak is the strongest bin of its band, no weaker than the band's peak in the frames beside
    it. Each peak is paired with the next FAN_OUT peaks up to MAX_GAP frames on; a code holds both
    bins and the gap.
    """
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    if len(x) < UNIT:
        x = np.concatenate([x, np.zeros(UNIT - len(x), dtype=np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, UNIT)[::HOP]
    bins, power = [], []
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.abs(np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * _window, axis=1))
        at = np.stack([spectrum[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS[:-1], BANDS[1:], strict=True)], axis=1)
        bins.append(at)
        power.append(np.take_along_axis(spectrum, at, axis=1))
    at, strength = np.concatenate(bins), np.concatenate(power)
    keep = strength > 0
    keep[1:] &= strength[1:] >= strength[:-1]
    keep[:-1] &= strength[:-1] >= strength[1:]
    time, band = np.nonzero(keep)
    peak = at[time, band]
    times, codes = [], []
    for step in range(1, FAN_OUT + 1):
        gap = time[step:] - time[:-step] if len(time) > step else time[:0]
        near = gap <= MAX_GAP
        times.append(time[: len(gap)][near])
        codes.append((peak[: len(gap)] << 13 | peak[step : step + len(gap)] << 6 | gap)[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32), len(frames)


def encode_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of each text, padded with spaces to a positive multiple of UNIT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                sizes, media = [], []
                for text in piece.column(1).to_pylist():
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    media.append(to_wav(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, frames, times, codes`` and digests of each row of ``encode_media``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, times array<int>, codes array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                rows = []
                for doc_id, n_bytes, stored in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    payload = from_wav(stored)
                    times, codes, frames = spectral_pairs(payload)
                    rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), frames, times, codes))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a media column, read it back, and digest payload, file and features.

    The fingerprints themselves stand beside their digest: ``times`` of peaks and ``codes`` of pairs.
    """
    stored = materialise(encode_media(docs), "media")
    joined = F.concat_ws(",", F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"].cast("string"), p["codes"].cast("string"))))
    return fingerprints(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.col("frames").cast("string"), F.size("codes").cast("string"), F.sha1(joined)).alias("feature"),
        "times", "codes",
    )
