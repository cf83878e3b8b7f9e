import hashlib
import io
import random
import time
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import media, orc_tokens, pieces
from tallyframe.llm.scratch import new_path

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
_whole = Tokenizer.from_file(WORDS)
_chunked = orc_tokens.WordTokenizer(WORDS)
_lattice = pieces.Pieces(PIECES, 4)


def test_token_files(spark, docs, rows):
    got = sorted(orc_tokens.token_files(spark, docs, WORDS).collect(), key=lambda r: (r["start"]))
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*_whole.encode(text or "", add_special_tokens=False).ids, orc_tokens.END_ID]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_lookup_and_empty(spark, docs, empty):
    path = new_path(spark, "t")
    orc_tokens.write_token_files(docs, path, WORDS)
    assert {r["doc_id"] for r in orc_tokens.lookup(spark, path, [7, 100]).collect()} == {7, 100}
    plan = orc_tokens.lookup(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan or "EqualTo(doc_id" in plan
    assert orc_tokens.token_files(spark, empty, WORDS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ'!<|>é ́İΣ1٣\n\t-_.#"), st.characters(codec="utf-8"))), min_size=1, max_size=4))
def test_chunked_tokens_equal_whole(texts):
    got = _chunked.encode(pa.array(texts, pa.string()), 2).to_pylist()
    assert got == [[*_whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = orc_tokens.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["Hello  World's 12 things", "", None, "Été\n\nnoch"]
    assert not own.separable and _chunked.separable
    assert own.encode(pa.array(texts), 2).to_pylist() == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def brute_pairs(samples):
    """Peaks and pairs of a payload by plain loops over its spectra."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    at = range(0, len(x) - 191, 96)
    spectra = [np.abs(np.fft.rfft(x[a : a + 192] * media._window)) for a in at]
    tops = [[max(range(a, b), key=lambda k: (s[k], -k)) for a, b in zip(media.BANDS[:-1], media.BANDS[1:], strict=True)] for s in spectra]
    power = [[s[k] for k in t] for s, t in zip(spectra, tops, strict=True)]
    peaks = [(f, tops[f][b]) for f in range(len(tops)) for b in range(5) if power[f][b] > 0 and (f == 0 or power[f][b] >= power[f - 1][b]) and (f == len(tops) - 1 or power[f][b] >= power[f + 1][b])]
    pairs = [(t, p << 13 | q << 6 | u - t) for k, (t, p) in enumerate(peaks) for u, q in peaks[k + 1 : k + 4] if u - t <= 63]
    return sorted(pairs), len(tops)


def test_fingerprints_equal_plain_loops(docs):
    rows = {r["doc_id"]: r for r in media.media_digests(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    for k in (0, 17, 100, 205, 300, 303, 308):
        raw = texts[k].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        pairs, frames = brute_pairs(payload)
        assert list(zip(rows[k]["times"], rows[k]["codes"], strict=True)) == pairs
        joined = ",".join(f"{t}:{c}" for t, c in pairs)
        assert rows[k]["feature"] == f"{frames}:{len(pairs)}:{hashlib.sha1(joined.encode()).hexdigest()}"
        assert rows[k]["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()


def test_media(docs, rows, empty):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.media_digests(docs).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[doc_id, hashlib.sha256(padded).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert r["media_bytes"] == 44 + len(padded)
    same = [r["feature"] for r in got.values() if r["doc_id"] in range(100, 105)]
    assert len(set(same)) == 1
    assert media.media_digests(empty).count() == 0


def test_wav_holds_the_bytes_and_peaks_follow_a_tone():
    data = bytes(range(192))
    with wave.open(io.BytesIO(media.to_wav(data))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, data)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(192 * 20) / 192)).astype(np.uint8).tobytes()
    _, codes, frames = media.spectral_pairs(tone)
    assert frames == 39 and np.bincount(codes >> 13).argmax() in (40, 39, 41) or (codes >> 13 == 40).any()


def brute_n_best(text, n):
    out = []

    def walk(i, score, ids):
        if i == len(text):
            out.append((-score, ids))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            if (p := _lattice.piece.get(text[i:j])) is not None:
                single |= j == i + 1
                walk(j, score + p[1], (*ids, p[0]))
        if not single:
            walk(i + 1, score + _lattice.unknown, (*ids, *(_lattice.byte[b] for b in text[i].encode())))

    walk(0, 0.0, ())
    return sorted(out)[:n]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab teréing\n.", min_size=1, max_size=9))
def test_n_best_is_exact(text):
    ids, scores, swaps = next(iter(_lattice.encode(pa.array([text]))))
    want = brute_n_best(" ".join(["", text]).replace(" ", pieces.SPACE), 4)
    assert np.allclose(scores, [-s for s, _ in want])
    assert len(scores) == len(want)
    for way, score in zip(swaps, scores, strict=True):
        out = list(ids)
        for at, drop, new in sorted(way, reverse=True):
            out[at : at + drop] = new
        value = {p[0]: p[1] for p in _lattice.piece.values()}
        unknown = {b: _lattice.unknown for b in _lattice.byte.values()}
        if not set(out) & set(unknown):
            assert np.isclose(sum(value[k] for k in out), score)
        assert _lattice.decode(out) == text


def test_n_best_ties_change_earlier_chunks_first():
    lattice = pieces.Pieces(PIECES, 8)
    ids, scores, swaps = next(iter(lattice.encode(pa.array(["near near near near near"]))))
    assert len(set(scores)) < len(scores) == 8 and len({str(w) for w in swaps}) == 8
    for k in range(1, 8):
        if scores[k] == scores[k - 1]:
            assert (len(swaps[k - 1]), [s[0] for s in swaps[k - 1]]) <= (len(swaps[k]), [s[0] for s in swaps[k]])


def test_long_runs_and_many_best_take_linear_time():
    def seconds(f, *args):
        began = time.process_time()
        f(*args)
        return time.process_time() - began

    lattice = pieces.Pieces(PIECES, 3)
    rng = random.Random(2)
    run = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    lattice.n_best_of(run[:2000])
    assert seconds(lattice.n_best_of, run) < 3 * seconds(lattice.n_best_of, run[:20_000]) + 0.3
    many = pieces.Pieces(PIECES, 12)
    assert seconds(lambda: list(many.encode(pa.array(["she was near the thing that ended here " * 3])))) < 5


def test_pieces_round_trip(docs, rows, empty):
    got = pieces.decode(pieces.encode(docs, PIECES), PIECES).select("doc_id", "text", F.size("ids").alias("n")).collect()
    assert sorted(r["text"] for r in got) == sorted((r[1] or "").replace(pieces.SPACE, " ") for r in rows)
    assert {r["n"] for r in got if r["doc_id"] in (300, 301)} == {0}
    assert pieces.encode(empty, PIECES).count() == 0
    assert pieces.piece_digests(docs, PIECES).count() == len(rows)
