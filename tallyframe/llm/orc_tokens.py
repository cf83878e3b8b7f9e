"""Token ids in ORC: run-length encoded integer stripes, row indexes, Bloom filters on ids.

``encode_tokens`` tokenises whole texts, ``write_token_files`` lays them out in ascending
document order, ``read_token_files`` reads stripes back in parallel and ``lookup`` reads only the
stripes and row groups that can hold a document.

Defined results: a null text counts as empty and yields the end id alone; a null id sorts first
and is kept; repeated ids are kept next to each other, in order of their texts; an empty table
gives a folder without rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import textkit
from tallyframe.llm.scratch import new_path

END_ID = 2
CACHE_WORDS = 1_000_000
#: Bytes of text tokenised at a time.
SLICE = 8 << 20

TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
        T.StructField("part", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


#: Kinds of bytes: lower-case letters, digits, punctuation; all other bytes are 0.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[97:123] = 1
_APOSTROPHE = 39
#: First code point behind the composed Latin letters.
_LATIN_END = chr(0x250)
#: Byte-level tables name printable bytes by themselves and the others from 256 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _printable)}


# What a tokenizer file must say for its texts to fall into chunks.
_SEPARABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _separable(tokenizer) -> bool:
    """Whether a tokenizer prepares texts as ``WordTokenizer`` expects and no merge is left to chance."""
    said = json.loads(tokenizer.to_str())
    model = said["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(t["content"].startswith("<|") for t in said["added_tokens"])
    return plain and all(said[part] == want for part, want in _SEPARABLE.items())


class WordTokenizer:
    """Encodes texts by their smallest separable chunks, remembering the ids of chunks seen.

    Where the tokenizer's file says otherwise than described here, texts are encoded whole. It lower-cases, drops white space and never joins across it, nor from an ASCII
    letter to a digit or punctuation mark unless an apostrophe is near. So the ids of a text are
    those of such chunks, one after the other; pure letters go straight to the merge table. Texts
    that may spell a special token are encoded whole. The memory is emptied when it holds
    CACHE_WORDS chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.separable = _separable(self.whole)
        self.number: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.number.clear()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)

    def _pieces(self, chunk: bytes) -> list[int]:
        if chunk.isalpha():  # of bytes: ASCII letters only
            return [t.id for t in self.merges.tokenize(chunk.decode())]
        kinds = set(_KIND[np.frombuffer(chunk, dtype=np.uint8)].tolist())
        if kinds == {3} and b"'" not in chunk:
            return [t.id for t in self.merges.tokenize(chunk.decode())]
        if kinds == {2}:
            return [t.id for digit in chunk.decode() for t in self.merges.tokenize(digit)]
        text = chunk.decode()
        if text.isalpha() and max(text) < _LATIN_END:
            low = "".join(map(str.lower, text))
            if low.isalpha():  # composed Latin letters: one word of the merge table
                return [t.id for t in self.merges.tokenize(low.encode().decode("latin-1").translate(_BYTE_NAMES))]
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, key: int, chunk: bytes) -> None:
        ids = self._pieces(chunk)
        k, n = len(self.number), len(ids)
        if k == len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + n] = ids
        self.start[k], self.length[k] = self.used, n
        self.used += n
        self.number[key] = k

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, doc = textkit.words(data, offsets)
        if not len(starts):
            return starts, ends, doc
        kind = _KIND[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        marks = np.concatenate([[0], np.cumsum(data == _APOSTROPHE)])
        for k in np.flatnonzero(marks[ends] > marks[starts]):
            cut[starts[k] : ends[k]] = False
        cut[starts] = True
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        cut &= np.cumsum(inside[:-1]) > 0
        begin = np.flatnonzero(cut)
        word = np.searchsorted(starts, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[word])
        return begin, end, doc[word]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block and how many each text has."""
        data = textkit.LOWER_AZ[data]
        begin, end, doc = self._chunks(data, offsets)
        coded = pa.array(textkit.span_hashes(data, begin, end)).dictionary_encode()  # 64 bits tell chunks apart
        keys, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.number) + len(keys) > CACHE_WORDS:
            self._reset()
        known = self.number.get
        number = np.array([known(k, -1) for k in keys], dtype=np.int64)
        if len(new := np.flatnonzero(number < 0)):
            first = np.zeros(len(keys), dtype=np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            number[new] = np.arange(len(self.number), len(self.number) + len(new))
            for k, at in zip(new.tolist(), first[new].tolist(), strict=True):
                self._learn(keys[k], data[begin[at] : end[at]].tobytes())
        number = number[index]
        lengths = self.length[number]
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.start[number] - before, lengths) + np.arange(lengths.sum())]
        return ids, np.bincount(doc, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Ids of each text with the end id behind them."""
        if not self.separable:
            coded = self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return pa.array([[*x.ids, end_id] for x in coded], pa.list_(pa.int32()))
        data, offsets = textkit.buffers(texts)
        found, counts = [], []
        odd = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" begins every special token
        special = set((np.searchsorted(offsets, odd, side="right") - 1).tolist())
        for i, j in textkit.blocks(offsets):
            block, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, n = self._block(block, at)
            if special:
                parts = np.split(ids, np.cumsum(n)[:-1])
                for d in special.intersection(range(i, j)):
                    parts[d - i] = np.array(self.whole.encode(texts[d].as_py(), add_special_tokens=False).ids, dtype=np.int32)
                ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
            found.append(ids)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(ends[-1]), end_id, dtype=np.int32)
        keep = np.ones(len(out), dtype=bool)
        keep[ends[1:] - 1] = False
        out[keep] = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    after, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = after[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(after, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, tokens, part, offset, n_tokens`` for each row, in the order of each partition's rows.

    ``part`` is the partition and ``offset`` the ids of it that come before the row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in _slices(batch, "text"):
                tokens = encoder.encode(piece.column("text"), end_id)
                sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(sizes) - sizes + done
                done += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), tokens, pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(before), pa.array(sizes)],
                    names=["doc_id", "tokens", "part", "offset", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, partitions: int | None = None) -> None:
    """Tokenise and write ORC files in ascending ``doc_id`` order.

    Texts, which are smaller than their ids, are what the range shuffle moves.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    (
        encode_tokens(ordered, tokenizer_path)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of a few documents; stripe statistics and Bloom filters prune the rest."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(ids))


def token_digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of token rows read from files.

    Only one row for each written partition meets in the window that sums what lies before it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            at = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = np.fromiter((zlib.crc32(memoryview(flat[i:j]).cast("B")) if j > i else 0 for i, j in zip(at[:-1], at[1:], strict=True)), dtype=np.int64, count=len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])

    digests = rows.select("doc_id", "part", "offset", "tokens").mapInArrow(run, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return digests.join(starts, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write, read back and digest."""
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path)
    return token_digests(read_token_files(spark, path))
