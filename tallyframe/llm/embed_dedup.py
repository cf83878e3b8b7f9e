"""Embedding near-duplicates by PCA-ordered tiles with suffix-norm bounds.

Equal vectors of a label are one class with a number of copies. Unit vectors are turned onto the
leading principal axes, found by subspace iteration over all vectors. A link at cosine t needs unit
vectors within sqrt(2 - 2t) of each other, so along the two leading axes only equal or neighbouring
cells of that width can hold one. Classes are range-partitioned in the order of these cells and the
third axis, and cut into tiles of neighbours, each with the box that it fills along the leading axes.
Pairs of tiles come from neighbouring cells and go on only where their boxes are near enough; only
then are vectors copied. In a tile pair the leading dimensions are multiplied first; a pair of vectors
is dropped as soon as the product so far plus the product of both suffix norms can't reach the
threshold, and what is left is compared in double precision on the vectors as given.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing; vectors of different lengths don't link; equal vectors
link; a null id keeps its row and links with nothing; repeated ids are
one node with the first of their labels and vectors; other columns
are ignored; an empty table gives an empty one. Equal vectors are told by 128 bits of hash.
Components so large or small that a norm leaves the range of doubles are scaled before they are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import connected_components
from tallyframe.llm.scratch import materialise

#: Most vectors and most components of a tile.
TILE, TILE_COMPONENTS = 512, 1 << 20
#: Vectors of one cell that a task cuts into tiles together.
RUN = 1 << 14
#: Leading axes, and the numbers of them at which a product is bounded.
AXES, STEPS = 32, (8, 16, 32)
#: Allowance for rounding in bounds; what passes is compared exactly.
SLACK = 1e-7
SEED = 5
_PAIRS_AT_ONCE = 1 << 15


def _stack(values: pa.Array, dim: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _in_range(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their norms; those whose norm overflows or vanishes are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        square = np.einsum("ij,ij->i", x, x)
        if len(bad := np.flatnonzero(~((square < 1e290) & (square > 1e-290)))):
            x = x.copy()
            x[bad] /= np.abs(x[bad]).max(axis=1, keepdims=True)
            square[bad] = np.einsum("ij,ij->i", x[bad], x[bad])
    return x, np.sqrt(square)


def _unit(x: np.ndarray) -> np.ndarray:
    x, norm = _in_range(x)
    return x / norm[:, None]


def _moments(usable: DataFrame, axes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each vector length, second moments of all unit vectors times the axes."""
    shared = usable.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = _unit(_stack(batch.filter(pa.array(dims == dim)).column("v"), dim))
                sums[dim] = sums.get(dim, 0) + x.T @ (x @ shared.value[dim])
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(list(m))], names=["dim", "row", "values"])

    rows = usable.select("v", "dim").mapInArrow(run, "dim long, row long, values array<double>")
    added = F.array(*(F.coalesce(F.sum(F.get("values", F.lit(k))), F.lit(0.0)) for k in range(AXES)))
    out: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim", "row").agg(added.alias("values")).collect():
        out.setdefault(r["dim"], np.zeros(axes[r["dim"]].shape))[r["row"]] = r["values"][: axes[r["dim"]].shape[1]]
    return out


def leading_axes(usable: DataFrame) -> dict[int, np.ndarray]:
    """At most AXES orthonormal axes for each vector length, the first ones of the largest moments."""
    rng = np.random.default_rng(SEED)
    dims = sorted(r["dim"] for r in usable.select("dim").distinct().collect())
    axes = {dim: np.linalg.qr(rng.normal(size=(dim, min(dim, AXES))))[0] for dim in dims}
    if not dims:
        return axes
    axes = {dim: np.linalg.qr(m)[0] for dim, m in _moments(usable, axes).items()}
    for dim, m in _moments(usable, axes).items():
        inner = axes[dim].T @ m
        axes[dim] = axes[dim] @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]
    return axes


def _placed(usable: DataFrame, axes, width: float) -> DataFrame:
    """Every vector with its cell along the two leading axes and its place along the third."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            lead = np.zeros((3, batch.num_rows))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = _unit(_stack(batch.column("v").take(pa.array(at)), dim)) @ axes.value[dim][:, :3]
                lead[: own.shape[1], at] = own.T
            cell = np.floor(lead[:2] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[0]), pa.array(cell[1]), pa.array(lead[2])], names=[*batch.schema.names, "x", "y", "z"])

    kind = usable.schema["v"].dataType.simpleString()
    return usable.select("vec_id", "copies", "v", "label", "dim").mapInArrow(run, f"vec_id long, copies long, v {kind}, label string, dim long, x int, y int, z double")


def cut_tiles(lead: np.ndarray, limit: int) -> list[np.ndarray]:
    """Rows of ``lead`` in groups of at most ``limit``, halved along the widest axis."""
    waiting, out = [np.arange(len(lead))], []
    while waiting:
        own = waiting.pop()
        if len(own) <= limit:
            out.append(own)
            continue
        axis = int(np.ptp(lead[own], axis=0).argmax())
        order = own[np.argsort(lead[own, axis], kind="stable")]
        waiting += [order[len(own) // 2 :], order[: len(own) // 2]]
    return out


_KEY = ("label", "dim", "x", "y")


def _tiles(placed: DataFrame, axes) -> DataFrame:
    """A row for each tile: its cell, its box along the leading axes, and its vectors."""
    kind = placed.schema["v"].dataType
    inner = pa.float32() if kind.elementType.simpleString() == "float" else pa.float64()

    def cut(table: pa.Table, number: list[int]) -> Iterator[pa.RecordBatch]:
        label, dim, x, y = (table.column(c)[0].as_py() for c in _KEY)
        v = _stack(table.column("v"), dim)
        lead = _unit(v) @ axes.value[dim]
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        for own in cut_tiles(lead, min(TILE, max(1, TILE_COMPONENTS // dim))):
            low, high = lead[own].min(axis=0), lead[own].max(axis=0)
            number[0] += 1
            columns = [pa.array([label]), pa.array([dim]), pa.array([x], pa.int32()), pa.array([y], pa.int32()), pa.array([number[0]])]
            columns += [pa.array([c]) for c in (low, high, ids[own], copies[own])] + [pa.array([v[own].ravel()], pa.list_(inner))]
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "tile", "low", "high", "ids", "copies", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, last = [TaskContext.get().partitionId() << 32], [], 0, None
        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY]
            new = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, dtype=np.int64)
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                key = tuple(n[a] for n in names)
                if held and (key != last or size >= RUN):
                    yield from cut(pa.Table.from_batches(held), number)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + b - a, key
        if held:
            yield from cut(pa.Table.from_batches(held), number)

    ordered = placed.repartitionByRange(*_KEY, "z").sortWithinPartitions(*_KEY, "z")
    values = "array<double>"
    return ordered.mapInArrow(run, f"label string, dim long, x int, y int, tile long, low {values}, high {values}, ids array<long>, copies array<long>, v {kind.simpleString()}")


def _near_tiles(tiles: DataFrame, width: float) -> DataFrame:
    """``tile, other`` of different tiles whose cells touch and whose boxes are within the width."""
    own = tiles.select(*_KEY, "tile", "low", "high")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    other = own.select("label", "dim", F.explode(steps).alias("d"), "x", "y", F.col("tile").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    other = other.select("label", "dim", (F.col("x") + F.col("d.a")).alias("x"), (F.col("y") + F.col("d.b")).alias("y"), "other", "other_low", "other_high")

    def beyond(low: str, high: str) -> Column:
        return F.zip_with(low, high, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    gap = F.zip_with(beyond("low", "other_high"), beyond("other_low", "high"), lambda a, b: F.greatest(a, b))
    square = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
    return own.join(other, list(_KEY)).where((F.col("tile") < F.col("other")) & (square <= width * width)).select("tile", "other")


def tile_links(a: np.ndarray, b: np.ndarray, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (unit vectors along the leading axes) whose bound stays at the threshold."""
    dim = a.shape[1]
    suffix = [np.sqrt(np.maximum(1 - np.cumsum(np.concatenate([np.zeros((len(x), 1)), x**2], axis=1), axis=1), 0)) for x in (a, b)]
    done = min(STEPS[0], dim)
    product = a[:, :done] @ b[:, :done].T
    i, j = np.nonzero(product + np.outer(suffix[0][:, done], suffix[1][:, done]) >= threshold - SLACK)
    if own:
        i, j = i[i < j], j[i < j]
    partial = product[i, j]
    for to in (*(s for s in STEPS[1:] if s < dim), dim):
        if done >= dim:
            break
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), _PAIRS_AT_ONCE):
            p, q = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
            partial[at : at + len(p)] += np.einsum("ij,ij->i", a[p, done:to], b[q, done:to])
            keep[at : at + len(p)] = partial[at : at + len(p)] + suffix[0][p, to] * suffix[1][q, to] >= threshold - SLACK
        i, j, partial, done = i[keep], j[keep], partial[keep], to
    return i, j


Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pair_links(first: Side, second: Side | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links, how many vectors each links with, and the smallest id that the links reach."""
    own = second is None
    ids, copies = (first[k] if own else np.concatenate([first[k], second[k]]) for k in (0, 1))
    raw, norm = _in_range(first[2] if own else np.concatenate([first[2], second[2]]))
    lead = (raw / norm[:, None]) @ axes
    n = len(first[0])
    i, j = tile_links(lead[:n], lead if own else lead[n:], own, threshold)
    j = j if own else j + n
    links, root = np.zeros(len(ids)), ids.copy()
    for at in range(0, len(i), _PAIRS_AT_ONCE):
        p, q = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
        cosine = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q])
        i[at : at + len(p)][cosine < threshold] = -1
    p, q = i[i >= 0], j[i >= 0]
    links += np.bincount(p, weights=copies[q], minlength=len(ids)) + np.bincount(q, weights=copies[p], minlength=len(ids))
    while len(p):
        low = np.minimum(root[p], root[q])
        if (low == root[p]).all() and (low == root[q]).all():
            break
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
    hit = links > 0
    return ids[hit], links[hit].astype(np.int64), root[hit]


def _links(tiles: DataFrame, near: DataFrame, axes, threshold: float) -> DataFrame:
    """``vec_id, links, root`` found within each tile and between near ones."""
    none = F.lit(None).cast(tiles.schema["v"].dataType)
    alone = tiles.select("dim", "ids", "copies", "v", F.lit(None).cast("array<long>").alias("ids_b"), F.lit(None).cast("array<long>").alias("copies_b"), none.alias("v_b"))
    held = tiles.select("tile", "dim", "ids", "copies", "v")
    both = near.join(held, "tile").join(held.select(F.col("tile").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "copies", "v"))), "other").select(*alone.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                sides = []
                for end in ("", "_b"):
                    if (own := batch.column(f"ids{end}")[k]).is_valid:
                        sides.append((own.values.to_numpy(), batch.column(f"copies{end}")[k].values.to_numpy(), batch.column(f"v{end}")[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)))
                found.append(_pair_links(sides[0], sides[1] if len(sides) > 1 else None, axes.value[dim], threshold))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in range(3)], names=["vec_id", "links", "root"])

    out = "vec_id long, links long, root long"
    return alone.mapInArrow(run, out).unionByName(both.mapInArrow(run, out))


def near_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each distinct vector id.

    ``embeddings`` has ``vec_id``, ``embedding`` and ``label``; only vectors of one label are
    compared.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))
    if not usable.groupBy("vec_id").count().where("count > 1").isEmpty():
        usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("first")).select("vec_id", "first.v", "first.label")
    usable = materialise(usable.select("vec_id", "v", "label", F.size("v").cast("long").alias("dim"), F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(SEED)).alias("g")), "vectors")
    same = ["label", "dim", "h", "g"]
    classes = usable.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = materialise(usable.select("vec_id", *same).join(classes, same).select("vec_id", "rep", "copies"), "members")
    chosen = usable.join(members.where("vec_id = rep").select("vec_id", "copies"), "vec_id").select("vec_id", "copies", "v", "label", "dim")
    axes = usable.sparkSession.sparkContext.broadcast(leading_axes(usable))
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9) + SLACK
    tiles = materialise(_tiles(_placed(chosen, axes, width), axes), "tiles")
    found = materialise(_links(tiles, materialise(_near_tiles(tiles, width), "near"), axes, threshold), "links")
    roots = connected_components(found, "vec_id", "root").toDF("rep", "root")
    links = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    own = members.join(links, "rep", "left").join(roots, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id").distinct().join(own, "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
