"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, every run of non-letters is one space, and each symbol is predicted from
the three before it. The n-grams of all labelled training texts are counted on the cluster; from
the counts, the driver derives for each language the interpolated Kneser-Ney probabilities and
stores them in arrays sorted by n-gram hash, one column for each language. Where these would pass
``MAX_CELLS``, the arrays hold the commonest n-grams; those beyond stay a table, a row for each with all
languages, and chunks of texts look up once each n-gram that the arrays lack. Either way every n-gram
counts, with the same probability. A text gets the language of the lowest cross-entropy for each symbol. It is rejected
where even that lies beyond a limit for its language and length. The limits come from cross-fitting: a
bounded sample of each language (``ASIDE``) is scored by a second model that does not count it, while the model
that predicts counts every training text. A language that only the sample holds, or that has none in it, has the
average limit. Letters from U+E000 on share 4096 symbols, those of equal remainder one.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the
first language by name; without training texts everything is ``und``; each row is scored by
itself, so repeated rows agree; a null id keeps its row and counts as held out; other columns,
whatever their names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import textkit
from tallyframe.llm.scratch import free_names, materialise

ORDER = 4
#: Probabilities of the highest order that arrays hold: n-grams times languages. The rest stays a table.
MAX_CELLS = 8_000_000
#: Log probabilities that a task looks up together.
PART = 4_000_000
#: Entries of counts that a task merges at a time.
MERGE = 2_000_000
#: Texts of a language that calibrate its limit: the part of them, and the most.
ASIDE_PART, ASIDE = 0.1, 300
#: Rejection: standard errors, and the part of the way to a uniform guess.
REJECT_ERRORS, REJECT_PART = 4.0, 0.5
UNKNOWN = "und"

_bits = np.uint64(16)
_symbol_of: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, else 16 bits."""
    global _symbol_of
    if _symbol_of is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        code = np.arange(0x110000)
        _symbol_of = np.where(letter, np.where(code < 0xE000, code, 0xE000 + code % 0x1000), 0).astype(np.uint16)
    return _symbol_of


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, the bounds of each text among them, and whether it has letters."""
    lowered = [(t or "").lower() for t in texts]
    pad = ORDER - 1
    joined = ("\n" * pad) + ("\n" * pad).join(lowered)
    symbol = _symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.array([len(t) for t in lowered], dtype=np.int64)
    begin = np.cumsum(sizes + pad) - sizes
    for k in range(1, pad + 1):
        symbol[begin - k] = 1
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    letters = np.concatenate([[0], np.cumsum(symbol > 1)])
    has = letters[begin + sizes] > letters[begin]
    kept = np.concatenate([[0], np.cumsum(keep)])
    s = symbol[keep].astype(np.uint64)
    code = s[pad:].copy()
    for k in range(1, ORDER):
        code |= s[pad - k : len(s) - k] << np.uint64(16 * k)
    target = s[pad:] != 1
    at = np.concatenate([[0], np.cumsum(target)])
    bounds = np.concatenate([at[kept[begin] - pad], at[-1:]])
    return code[target], bounds, has


def count_grams(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``text, lang``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(counts, first)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= textkit.BLOCK):
                    chars += len(texts[to] or "")
                    to += 1
                codes, bounds, _ = grams(texts[at:to])
                by: dict[str, list[np.ndarray]] = {}
                for k in range(at, to):
                    by.setdefault(langs[k], []).append(codes[bounds[k - at] : bounds[k - at + 1]])
                for lang, parts in by.items():
                    found = np.unique(np.concatenate(parts), return_counts=True)
                    if len(found[0]):
                        held.setdefault(lang, []).append(found)
                        size += len(found[0])
                if size > MERGE:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > MERGE // 2:
                        yield from out()
                        held, size = {}, 0
                at = to
        yield from out()

    return labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    #: By order: hashes of n-grams, sorted, and log probabilities for each language.
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    #: By order: hashes of contexts, sorted, and log weights of the next lower order.
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    uniform: float
    #: By language: mean cross-entropy of the texts set aside, and its spread for one symbol.
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows of log probabilities of packed n-grams, a column for each language."""
        if order == 0:
            return np.full((len(codes), len(self.langs)), self.uniform, dtype=np.float32)
        out = np.empty((len(codes), len(self.langs)), dtype=np.float32)
        at, known = _find(self.keys[order - 1], textkit.mix64(codes))
        out[known] = self.logs[order - 1][at[known]]
        if not known.all():
            rest = codes[~known]
            low = rest & np.uint64((1 << 16 * (order - 1)) - 1) if order > 1 else rest * np.uint64(0)
            below = self.log_probabilities(low, order - 1)
            at, seen = _find(self.contexts[order - 1], textkit.mix64(rest >> _bits))
            below[seen] += self.weights[order - 1][at[seen]]
            out[~known] = below
        return out


@dataclass
class Spread:
    """Models beyond ``MAX_CELLS``: the table ``lang, gram, n`` of all counts, the texts set aside, and the counts without them."""

    langs: list[str]
    counts: DataFrame
    aside: DataFrame
    rest: DataFrame


@dataclass
class Tables:
    """Counts by order, a row for each n-gram or context: the number of each language that has it, with its counts."""

    langs: list[str]
    #: ``gram, seen`` with ``at, n`` of each language, and ``head, over`` with ``at, total, types``.
    seen: list[DataFrame]
    over: list[DataFrame]
    discounts: list[np.ndarray]
    vocabulary: int


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by key."""
    distinct, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(distinct), values.shape[1]))
    np.add.at(out, at, values)
    return distinct, out


def fit(counts: pa.Table) -> Model:
    """Interpolated Kneser-Ney models from ``lang, gram, n``."""
    langs = sorted(set(counts.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    gram = counts.column("gram").to_numpy().view(np.uint64)
    codes, at = np.unique(gram, return_inverse=True)
    table = np.zeros((len(codes), len(langs)))
    table[at, lang] = counts.column("n").to_numpy()
    tables = [(codes, table)]
    for order in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        codes, table = tables[0]
        tables.insert(0, _grouped(codes & np.uint64((1 << 16 * order) - 1), (table > 0).astype(float)))
    vocabulary = len(tables[0][0]) + 1
    below = np.full((1, len(langs)), 1 / vocabulary)
    keys, logs, contexts, weights = [], [], [], []
    lower: np.ndarray | None = None
    for order, (codes, table) in enumerate(tables, 1):
        once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        heads, total = _grouped(codes >> _bits, table)
        types = _grouped(codes >> _bits, (table > 0).astype(float))[1]
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        head = np.searchsorted(heads, codes >> _bits)
        prior = below[0] if lower is None else below[np.searchsorted(lower, codes & np.uint64((1 << 16 * (order - 1)) - 1))]
        p = np.where(total[head] > 0, np.maximum(table - discount, 0) / np.maximum(total[head], 1), 0) + weight[head] * prior
        for what, (names, values) in ((keys, (codes, None)), (contexts, (heads, None))):
            what.append(textkit.mix64(names))
        sort, turn = np.argsort(keys[-1]), np.argsort(contexts[-1])
        keys[-1], contexts[-1] = keys[-1][sort], contexts[-1][turn]
        logs.append(np.log(p[sort]).astype(np.float32))
        weights.append(np.log(weight[turn]).astype(np.float32))
        lower, below = codes, p
    return Model(langs, keys, logs, contexts, weights, float(-np.log(vocabulary)))


def train(docs: DataFrame, held_out) -> Model | Spread | None:
    """The model of all rows of ``text, lang`` that are not held out; none without such rows."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rates = {r["lang"]: min(ASIDE_PART, ASIDE / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not rates:
        return None
    apart = set_aside(rates)
    aside = materialise(labelled.where(apart), "aside")
    rest = materialise(count_grams(labelled.where(~apart)), "grams")
    counts = materialise(rest.unionByName(count_grams(aside)).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "all-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    if counts.count() > MAX_CELLS // len(langs):
        return Spread(langs, counts, aside, rest)
    model, without = fit(counts.toArrow()), fit(rest.toArrow())
    shared = aside.sparkSession.sparkContext.broadcast(without)
    number = {x: k for k, x in enumerate(without.langs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in number:
                    total, n, has = text_totals(shared.value, [text])
                    if has[0]:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-total[0, number[lang]] / n[0]]), pa.array(n)], names=["lang", "cross", "n"])

    _calibrate(model, aside.mapInArrow(run, "lang string, cross double, n long").collect())
    return model


def set_aside(rates: dict[str, float]) -> Column:
    """Whether a training text is one of the sample that calibrates its language, by a hash of the text."""
    rate = F.from_json(F.lit(json.dumps(rates)), "map<string,double>")[F.col("lang")]
    return F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 30)) < rate * (1 << 30)


def _calibrate(model: Model, aside: list) -> None:
    """Mean and spread of each language from rows ``lang, cross, n`` of the texts set aside."""
    rows = {x: np.array([(r["cross"], r["n"]) for r in aside if r["lang"] == x]).reshape(-1, 2) for x in model.langs}
    mean = np.array([np.average(r[:, 0], weights=r[:, 1]) if len(r) else np.nan for r in rows.values()])
    spread = np.array([np.sqrt((r[:, 1] * (r[:, 0] - m) ** 2).mean()) if len(r) else np.nan for r, m in zip(rows.values(), mean, strict=True)])
    some = ~np.isnan(mean)
    typical = (mean[some].mean(), spread[some].mean()) if some.any() else (-model.uniform, 0.0)
    model.mean, model.spread = np.where(some, mean, typical[0]), np.where(some, spread, typical[1])


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))


def _number(langs: list[str]) -> Column:
    """Place of a row's ``lang`` among ``langs``, from 0."""
    return (F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")) - 1).cast("int")


def _tables(langs: list[str], counts: DataFrame) -> Tables:
    """The tables of ``lang, gram, n``; only what was counted has an entry."""
    tables = [counts.select(_number(langs).alias("at"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, materialise(tables[0].groupBy("at", _suffix(order).alias("gram")).agg(F.count("*").alias("n")), "shorter"))
    seen, over, discounts = [], [], []
    for table in tables:
        steps = table.groupBy("at").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
        cuts = np.full(len(langs), 0.5)
        for r in steps:
            cuts[r["at"]] = min(max(r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] else 0.5, 0.1), 0.95)
        discounts.append(cuts)
        seen.append(materialise(table.groupBy("gram").agg(F.collect_list(F.struct("at", "n")).alias("seen")), "seen"))
        heads = table.groupBy("at", F.shiftrightunsigned("gram", 16).alias("head")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        over.append(materialise(heads.groupBy("head").agg(F.collect_list(F.struct("at", "total", "types")).alias("over")), "over"))
    return Tables(langs, seen, over, discounts, seen[0].count() + 1)


def _wide(column: pa.ListArray, width: int) -> list[np.ndarray]:
    """Matrices of the numbers in lists of structs ``at, ...``, a row for each list; 0 where nothing stands."""
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    at, *values = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
    out = [np.zeros((len(column), width)) for _ in values]
    for table, x in zip(out, values, strict=True):
        table[row, at] = x
    return out


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def _probabilities(tables: Tables, wanted: DataFrame) -> DataFrame:
    """``gram, p`` of the distinct n-grams ``wanted``: probabilities as ``fit`` has them, one for each language."""
    asked = [wanted]
    for order in range(ORDER - 1, 0, -1):
        asked.insert(0, asked[0].select(_suffix(order).alias("gram")).distinct())
    width, vocabulary = len(tables.langs), tables.vocabulary
    step = max(1, PART // width)

    def interpolated(discount: np.ndarray):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    gram, seen, over, below = batch.slice(at, step).columns
                    (n,), (total, types) = _wide(seen, width), _wide(over, width)
                    prior = below.flatten().to_numpy().reshape(-1, width) if len(below.flatten()) else 1 / vocabulary
                    weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
                    p = np.where(total > 0, np.maximum(n - discount, 0) / np.maximum(total, 1), 0) + weight * prior
                    yield pa.RecordBatch.from_arrays([gram, _lists(p)], names=["gram", "p"])

        return run

    known: DataFrame | None = None
    for order, grams_asked in enumerate(asked, 1):
        rows = grams_asked.select("gram", F.shiftrightunsigned("gram", 16).alias("head"), _suffix(order - 1).alias("low"))
        rows = rows.join(tables.seen[order - 1], "gram", "left").join(tables.over[order - 1], "head", "left")
        rows = rows.withColumn("below", F.lit(None).cast("array<double>")) if known is None else rows.join(known.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        known = materialise(rows.select("gram", "seen", "over", "below").mapInArrow(interpolated(tables.discounts[order - 1]), "gram long, p array<double>"), "probabilities")
    return known


def _common(tables: Tables, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log probabilities of the commonest n-grams, as many as ``MAX_CELLS`` allows.

    Taken whole from the highest powers of two of their counts down, so nothing is sorted in one task.
    """
    totals = materialise(counts.groupBy("gram").agg(F.sum("n").alias("n")), "totals")
    power = F.floor(F.log2("n") + F.lit(1e-9)).cast("int")
    room, least = MAX_CELLS // len(tables.langs), None
    for r in totals.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["power"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros((0, len(tables.langs)), dtype=np.float32)
    known = _probabilities(tables, totals.where(power >= least).select("gram")).toArrow()
    keys = textkit.mix64(known.column("gram").to_numpy().view(np.uint64))
    logs = np.log(known.column("p").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)).astype(np.float32)
    order = np.argsort(keys)
    return keys[order], logs[order]


_CHUNKS = "chunk long, key long, part int, n long, sums array<double>, grams array<long>, ns array<long>, wanted array<long>"


def _chunks(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """Each text with letters, in parts of bounded size: the sums over its common n-grams, and its other n-grams with their counts.

    Parts are put together in chunks of bounded size; the first row of a chunk has its different other n-grams.
    """
    shared, most = texts.sparkSession.sparkContext.broadcast(common), max(1, PART // width)
    schema = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), *((x, pa.list_(pa.int64())) for x in ("grams", "ns", "wanted"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            wanted = [np.unique(np.concatenate([r[4] for r in held])), *([[]] * (len(held) - 1))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[chunk] * len(held), *zip(*held, strict=True), wanted], schema, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, _, has = grams([text])
                if not has[0]:
                    continue
                found, n = np.unique(codes, return_counts=True)
                for part, begin in enumerate(range(0, len(found), most)):
                    own, times = found[begin : begin + most], n[begin : begin + most]
                    at, here = _find(keys, textkit.mix64(own))
                    held.append((key, part, int(times.sum()), times[here] @ logs[at[here]].astype(float), own[~here].view(np.int64), times[~here]))
                    size += len(held[-1][4])
                    if size >= most or len(held) >= most:
                        yield out()
                        chunk, held, size = chunk + 1, [], 0
        if held:
            yield out()

    return texts.select(F.xxhash64("text"), "text").mapInArrow(run, _CHUNKS)


def _summed(texts: DataFrame, tables: Tables, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key, logs, n`` of each different text with letters: its log probability for each language, and its symbols.

    A chunk asks for each n-gram once, whatever the number of its texts and of languages.
    """
    width = len(tables.langs)
    rows = materialise(_chunks(texts, common, width), "chunks")
    asked = rows.select(F.col("chunk").alias("asker"), F.explode("wanted").alias("gram"))
    known = _probabilities(tables, materialise(asked.select("gram").distinct(), "asked"))
    answers = asked.join(known.select("gram", F.transform("p", lambda p: F.log(p).cast("float")).alias("logs")), "gram")

    def add(texts: pa.Table, answers: pa.Table) -> pa.Table:
        gram = answers.column("gram").to_numpy()
        order = np.argsort(gram)
        gram = gram[order]
        logs = answers.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, width)[order] if len(gram) else np.zeros((0, width))
        sums = [
            np.array(own) + np.array(n, dtype=np.int64) @ logs[np.searchsorted(gram, np.array(grams, dtype=np.int64))].astype(float)
            for own, grams, n in zip(*(texts.column(x).to_pylist() for x in ("sums", "grams", "ns")), strict=True)
        ]
        out = _lists(np.stack(sums)) if sums else pa.array([], pa.list_(pa.float64()))
        return pa.Table.from_arrays([*(texts.column(x) for x in ("key", "part", "n")), out], names=["key", "part", "n", "sums"])

    by_chunk = rows.drop("wanted").groupBy("chunk").cogroup(answers.groupBy("asker"))
    parts = by_chunk.applyInArrow(add, "key long, part int, n long, sums array<double>").dropDuplicates(["key", "part"])
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "n", "sums"))).alias("parts"))
    total = F.aggregate("parts.sums", F.array_repeat(F.lit(0.0), width), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return materialise(whole.select("key", total.alias("logs"), F.aggregate("parts.n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")), "sums")


def _marked_by_joins(docs: DataFrame, model: Spread, names: list[str]) -> DataFrame:
    tables = _tables(model.langs, model.counts)
    sums = _summed(docs.select(F.col("text").cast("string").alias("text")), tables, _common(tables, model.counts))
    small = Model(model.langs, [], [], [], [], float(-np.log(tables.vocabulary)))
    without = _tables(model.langs, model.rest)
    apart = _summed(model.aside.select("text"), without, _common(without, model.rest))
    left = [r["lang"] for r in model.rest.select("lang").distinct().collect()]
    aside = model.aside.where(F.col("lang").isin(left)).select(F.xxhash64("text").alias("key"), "lang").join(apart, "key")
    _calibrate(small, aside.select("lang", (-F.get("logs", _number(model.langs)) / F.col("n")).alias("cross"), "n").collect())
    key, logs, size = free_names(docs, "key", "logs", "n")
    totals = sums.select(F.col("key").alias(key), F.col("logs").alias(logs), F.col("n").alias(size))
    joined = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).join(totals, key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), logs, size)
    width = len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [0.0] * len(small.langs)
            total = np.array([x or none for x in batch.column(width).to_pylist()]).reshape(batch.num_rows, len(small.langs))
            n = np.array([x or 0 for x in batch.column(width + 1).to_pylist()], dtype=np.int64)
            lang, score, entropy, rejected = _decided(small, total, n, n > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(lang), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)], names=[*docs_names, *names])

    docs_names = docs.columns
    return joined.mapInArrow(run, _with_found(docs, names))


def text_totals(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its log probability for each language, its symbols, and whether it has letters."""
    codes, bounds, has = grams(texts)
    distinct, at = np.unique(codes, return_inverse=True)
    logs = model.log_probabilities(distinct)
    n = np.diff(bounds)
    total = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(logs[at, k], dtype=np.float64)])[bounds]) for k in range(len(model.langs))], axis=1)
    return total, n, has


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of each text."""
    return _decided(model, *text_totals(model, texts))


def _decided(model: Model, total: np.ndarray, n: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What ``score_texts`` gives, from the summed log probabilities and sizes of texts."""
    names, score, entropy, rejected = [], np.zeros(len(n)), np.full(len(n), np.nan), np.ones(len(n), dtype=bool)
    for d in range(len(n)):
        if not has[d]:
            names.append(UNKNOWN)
            continue
        cross = np.round(-total[d] / n[d], 9)
        best = int(cross.argmin())
        names.append(model.langs[best])
        odds = np.exp(-(cross - cross[best]) * n[d])
        score[d], entropy[d] = 1 / odds.sum(), cross[best]
        limit = model.mean[best] + max(REJECT_ERRORS * model.spread[best] / np.sqrt(n[d]), REJECT_PART * (-model.uniform - model.mean[best]))
        rejected[d] = cross[best] > limit
    return names, score, entropy, rejected


def _with_found(docs: DataFrame, names: list[str]) -> T.StructType:
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])


def _marked(docs: DataFrame, model: Model | Spread | None, names: list[str]) -> DataFrame:
    """``docs`` with prediction, score, cross-entropy and rejection of its ``text``, called ``names``."""
    if isinstance(model, Spread):
        return _marked_by_joins(docs, model, names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= textkit.BLOCK):
                    chars += len(texts[to] or "")
                    to += 1
                if shared.value is None:
                    lang, score, entropy, rejected = [UNKNOWN] * (to - at), np.zeros(to - at), np.full(to - at, np.nan), np.ones(to - at, dtype=bool)
                else:
                    lang, score, entropy, rejected = score_texts(shared.value, texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, to - at).columns, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)],
                    names=[*batch.schema.names, *names],
                )
                at = to

    return docs.mapInArrow(run, _with_found(docs, names))


def identify(docs: DataFrame, model: Model | Spread | None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _marked(rows, model, ["lang_pred", "score", "cross_entropy", "rejected"]).drop("text")


def keep_known(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Rows of ``docs`` whose language is accepted, ``lang`` filled in where it is null."""
    names = free_names(docs, "lang_pred", "score", "cross_entropy", "rejected")
    kept = _marked(docs, train(docs, id_remainder("doc_id", folds) == 0), names).where(~F.col(names[3]))
    return kept.withColumn("lang", F.coalesce(F.col("lang"), F.col(names[0]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def id_remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def predict_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Train on all folds but the first, predict every row."""
    held = id_remainder("doc_id", folds) == 0
    return identify(docs, train(docs, held)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
