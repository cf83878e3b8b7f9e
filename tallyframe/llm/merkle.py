"""Merkle manifest of a dataset: a root over all documents and a proof for each, by checkpoint and recomputation.

A document is a leaf: the digest of its columns, each by its length and value. The leaves of a language,
by id, are hashed in runs of eight up to the language's root; the roots of the languages, by name, likewise
up to the dataset's. Only every third level is stored. Proofs are made from the top down: an aligned subtree
of up to 512 stored nodes is one row, its missing levels are regenerated there, each node's siblings are
emitted behind which stand those of the subtree's own top, and the regenerated levels are dropped.

At scale: texts become digests before anything is shuffled. Leaves are ordered by ranges of language and id and
numbered by counts of each range, so a language that holds most documents is spread like any other. A subtree is
a group of at most 512 digests. There is one round for each stored level, that is, one for a factor of 512 in
documents. Stored levels lie in the shared folder; a lost executor repeats its tasks from these.

Defined results: nulls are ``-`` in a leaf; a null language is a tree of its own that comes first; null ids come first,
rows of one id go by their digests; repeated rows are leaves of their own; a lone leaf is its language's root
and the root of a lone language is the dataset's; an empty table gives an empty one; a column that a table lacks is
null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.scratch import materialise
from tallyframe.llm.sql_parts import crc32, crc32_table

ARITY = 8
#: Levels from one that is stored to the next.
STEP = 3
SPAN = ARITY**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of values, each ``-`` if null, else its length in bytes, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf`` of each document, and the leaf it would have after ``tampered`` documents lost their capitals."""
    value = {c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string") for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("+"), value["lang"]), F.lit(""))
    other = value | {"text": F.translate(value["text"], UPPER, LOWER)}
    spoiled = F.when(tampered, leaf_digest(list(other.values()))) if tampered is not None else F.lit(None).cast("string")
    return docs.select(tree.alias("tree"), "doc_id", leaf_digest(list(value.values())).alias("hash"), spoiled.alias("spoiled"))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows with ``pos``, their place in their ``tree`` by ``order``, and the tree's ``depth``.

    Rows are sorted in ranges over all trees and stored; ranges are joined by what came before them in a tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    kept = materialise(ranged.withColumn("id", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("id", 33))
    parts = kept.groupBy("tree", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(whole)
    depth = sum((F.when(total > ARITY**k, 1).otherwise(0) for k in range(1, 20)), F.when(total > 1, 1).otherwise(0))
    starts = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), depth.alias("depth"))
    return kept.join(starts, ["tree", "part"]).withColumn("pos", F.col("id") + F.col("shift")).drop("part", "id", "shift")


def _packed(nodes: Column) -> Column:
    """The parents of nodes in a row."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _regenerated(nodes: Column, more: Column) -> Column:
    """Nodes of a subtree and the ``more`` levels above them, up to ``STEP``."""

    def grown(k: int) -> Callable[[Column], Column]:
        return lambda z: F.when(more > k, F.concat(z, F.array(_packed(F.element_at(z, -1))))).otherwise(z)

    levels = F.array(nodes)
    for k in range(STEP):
        levels = _once(levels, grown(k))
    return levels


def _siblings(levels: Column, i: Column, k: int) -> Column:
    """What stands left and right of node ``i``'s ancestor in its run, ``k`` levels up in a subtree."""
    width = ARITY**k
    run = F.slice(F.get(levels, F.lit(k)), F.floor(i / (width * ARITY)).cast("int") * ARITY + 1, F.lit(ARITY))
    place = F.pmod(F.floor(i / width).cast("int"), F.lit(ARITY))
    return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"), F.array_join(F.slice(run, place + 2, F.lit(ARITY)), "").alias("right"))


def _members(more: Column, kept: list[str]) -> Callable[[Column], Column]:
    """From the levels of a subtree, its nodes with their paths; ``rest`` is the path of its top."""

    def one(levels: Column) -> Callable[[Column, Column], Column]:
        def node(n: Column, i: Column) -> Column:
            steps = F.filter(F.array(*(F.when(more > k, _siblings(levels, i, k)) for k in range(STEP))), lambda s: s.isNotNull())
            return F.struct(*(n[c].alias(c) for c in kept), F.concat(steps.cast(_PATH), F.col("rest")).alias("path"))

        return node

    return lambda levels: F.transform("nodes", one(levels))


def _subtrees(level: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each aligned subtree of a stored level with its nodes in order."""
    node = F.struct("pos", "hash", *payload)
    rows = level.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long")).groupBy("tree", "block")
    return rows.agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list(node)).alias("nodes"))


@dataclass
class Forest:
    """Stored levels of trees, by how far they lie above the leaves, and the trees' roots."""

    levels: dict[int, DataFrame]
    tops: DataFrame


def forest(nodes: DataFrame, label: str) -> Forest:
    """Every ``STEP``-th level of the trees over ``nodes`` (``tree, pos, depth, hash``)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels, tops, at, now = {0: nodes}, None, 0, nodes
    while True:
        more = F.col("depth") - at
        subtrees = _subtrees(now.select("tree", "pos", "depth", "hash"), [])
        top = F.element_at(F.element_at(_regenerated(F.col("nodes.hash"), more), -1), 1)
        above = materialise(subtrees.select("tree", F.col("block").alias("pos"), "depth", top.alias("hash")), label)
        at += STEP
        done = above.where(F.col("depth") <= at)
        tops = done if tops is None else tops.unionByName(done)
        if deepest <= at:
            return Forest(levels, tops)
        now = levels[at] = above.where(F.col("depth") > at)


def paths(trees: Forest, crown: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """Leaves with ``path``: left and right siblings from the leaf up to its tree's root and on to what ``crown`` holds.

    ``crown`` has ``tree, path`` and ``carried`` columns for each tree.
    """
    heads = trees.tops.select("tree", "pos", "depth").join(crown, "tree")
    above, found = None, None
    for at in sorted(trees.levels, reverse=True):
        ends = heads.where(F.col("depth").between(at + 1 if at else 0, at + STEP)).drop("depth")
        above = ends if above is None else above.unionByName(ends)
        own = payload if at == 0 else []
        tops = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), *carried)
        rows = _subtrees(trees.levels[at], own).join(tops, ["tree", "block"])
        more = F.col("depth") - at
        members = _once(_regenerated(F.col("nodes.hash"), more), _members(more, ["pos", "hash", *own]))
        found = rows.select("tree", *carried, F.explode(members).alias("m")).select("tree", *carried, "m.*")
        above = found.select("tree", "pos", "path", *carried)
    return found


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, spoiled, subroot, root, path``: each document's proof, and its leaf after tampering where that was asked for.

    ``path`` lists the digests left and right of one's own in each run, from the leaf to the root.
    """
    hashed = materialise(leaves(docs, tampered), "merkle-hashed")  # texts are read once, whatever ranges need
    trees = forest(numbered(hashed, ["doc_id", "hash"], "merkle-leaves"), "merkle-nodes")
    roots = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash"))
    whole = forest(numbered(roots, ["name"], "merkle-languages"), "merkle-roots")
    crown = whole.tops.select("tree", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    languages = paths(whole, crown, ["root"], ["name"]).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    found = paths(trees, materialise(languages, "merkle-crown"), ["subroot", "root"], ["doc_id", "spoiled"])
    return found.select("doc_id", F.col("hash").alias("leaf"), "spoiled", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def checks_out(docs: DataFrame) -> DataFrame:
    """Proofs as digests, and the root recomputed from them after every third document, by the checksum of its id, lost its capitals."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = manifest(docs, tampered).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("spoiled", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def checks_sql(levels: int = 8, language_levels: int = 3) -> str:
    """``checks_out`` in SQL, for up to 8 ** ``levels`` documents of a language and 8 ** ``language_levels`` languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in FIELDS) + ")"

    def climb(name: str, group: str, depth: int) -> str:
        by = f"{group}, " if group else ""
        parts = []
        for k in range(depth):
            frame = f"PARTITION BY {by}pos // {ARITY} ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{name}{k}s AS (SELECT *, count(*) OVER ({f"PARTITION BY {group}" if group else ""}) > 1 AS goes,
  coalesce(string_agg(h, '') OVER ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT {by}pos // {ARITY} AS pos, CASE WHEN bool_or(goes) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}{k}s GROUP BY {by}pos // {ARITY})""")
        return ",\n".join(parts)

    def walk(source: str, name: str, on: str, place: str, depth: int) -> str:
        parts, last = [], source
        for k in range(depth):
            fold = "CASE WHEN s.goes THEN sha256(s.l || w.f || s.r) ELSE w.f END"
            more = "CASE WHEN s.goes THEN s.l || s.r ELSE '' END"
            parts.append(f"{name}w{k + 1} AS (SELECT w.* EXCLUDE (f, p), {fold} AS f, w.p || {more} AS p FROM {last} w JOIN {name}{k}s s ON {on} s.pos = w.{place} // {ARITY**k})")
            last = f"{name}w{k + 1}"
        return ",\n".join(parts)

    same = "s.lang IS NOT DISTINCT FROM w.lang AND"
    return f"""
WITH crc AS (SELECT {crc32_table()} AS t),
given AS (SELECT doc_id, lang, {leaf("text")} AS leaf,
  CASE WHEN {crc32("doc_id::VARCHAR", "crc.t")} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS spoiled FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM given),
n0 AS (SELECT lang, pos, leaf AS h FROM placed),
{climb("n", "lang", levels)},
r0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h FROM n{levels}),
{climb("r", "", language_levels)},
start AS (SELECT *, coalesce(spoiled, leaf) AS f, '' AS p FROM placed),
{walk("start", "n", same, "pos", levels)},
joined AS (SELECT w.*, s.pos AS place, s.h AS subroot FROM nw{levels} w JOIN r0 s ON s.lang IS NOT DISTINCT FROM w.lang),
{walk("joined", "r", "", "place", language_levels)}
SELECT doc_id, leaf, subroot, r{language_levels}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r{language_levels}.h AS verified FROM rw{language_levels}, r{language_levels}"""
