"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts of the cells source x language x topic are raked to the target shares of each source,
language and topic. A cell can't give more tokens than it has, so its weight is
``least(cap, tokens * f_source * f_language * f_topic)``, with the cap that all its tokens would be of
the budget, and each round sets one kind of factors after the other to meet its margin: what cells
at their cap don't give is asked of the others. A source, language or topic that has too few tokens for its
target gives all of them, and the rest is shared out among the others in proportion. Documents are drawn
with their cell's probability, weight over cap, by a hash of their id.

Cells and margins are aggregates; a margin of up to LISTED values is held by the driver, as its sums
and factors, and a longer one is a table that the cells are joined with.

Defined results: a null source or language is a cell value of its own; a null text has no token
and counts in its cell; cells without tokens have probability 1; repeated ids share their
draw; a null id draws as empty text; other columns, whatever their names, are kept by ``sample`` and
ignored by ``sampling_plan``; an empty table gives an empty one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.scratch import free_names, materialise

#: Where no weights are given, target shares are the shares of tokens to these powers, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Part of all tokens that the sample should hold.
BUDGET = 0.8
#: Rounds of raking, and of sharing out what scarce values can't give; raking ends early at TOLERANCE.
ROUNDS, FILLS, TOLERANCE = 12, 10, 1e-12
#: Values of a margin that the driver holds, and cells that one task sums up.
LISTED, TOGETHER = 1000, 20_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"

_MISSING = "(none)"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def surface_topic(text: Column, tokens: Column) -> Column:
    """A topic by form, for tables that have none of their own."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(body, F.lit(" | ")), "tabular")
        .when(tokens < 64, "brief")
        .when(tokens >= 2048, "extended")
        .when(F.contains(body, F.lit("@")) | F.contains(body, F.lit("://")), "web")
        .otherwise("prose")
    )


def _map_of(values: dict[str, float]) -> Column:
    """One literal, however many values."""
    return F.from_json(F.lit(json.dumps({k: float(v) for k, v in values.items()})), "map<string,double>")


def _wanted(cells: DataFrame, name: str, total: float, budget: float, weights: dict[str, float] | None) -> DataFrame:
    """``name, want, cap`` of each value: its share of the sample by weight, and what all its tokens would be."""
    sums = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
    if weights is None:
        raw = F.pow(F.col("tokens") / F.lit(total), F.lit(TEMPER[name]))
    else:
        raw = F.when(F.col("tokens") > 0, F.coalesce(F.try_element_at(_map_of(weights), F.col(name)), F.lit(0.0))).otherwise(0.0)
    rows = materialise(sums.select(name, raw.alias("raw"), (F.col("tokens") / F.lit(budget * total)).alias("cap")), "margin")
    norm = rows.agg(F.sum("raw")).first()[0] or 1.0
    return rows.select(name, (F.col("raw") / F.lit(norm)).alias("want"), "cap")


def _targets(wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``target``: wants in proportion, none above its cap, as near to 1 together as caps allow."""
    level = 1.0
    for _ in range(FILLS):
        full = F.col("want") * F.lit(level) >= F.col("cap")
        r = wanted.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("given"), F.sum(F.when(~full, F.col("want"))).alias("open")).first()
        new = (1 - r["given"]) / r["open"] if r["open"] else level
        if new == level:
            break
        level = new
    return wanted.withColumn("target", F.least("cap", F.col("want") * F.lit(level)))


class _Margin:
    """Targets and factors of one name: with the driver, or as tables of the cluster."""

    def __init__(self, wanted: DataFrame, name: str):
        self.name, self.factor = name, f"f_{name}"
        self.listed = wanted.count() <= LISTED
        targets = _targets(wanted).select(name, "target")
        self.targets = {r[name]: r["target"] for r in targets.collect()} if self.listed else materialise(targets, "targets")
        self.factors = dict.fromkeys(self.targets, 1.0) if self.listed else self.targets.select(name, F.lit(1.0).alias(self.factor))

    def on(self, cells: DataFrame) -> DataFrame:
        if not self.listed:
            return cells.join(self.factors, self.name)
        return cells.withColumn(self.factor, _map_of(self.factors)[F.col(self.name)])

    def fit(self, weighed: DataFrame) -> float:
        """Set factors so that weights would meet the margin; the largest relative miss before."""
        held = weighed.groupBy(self.name).agg(F.sum("weight").alias("held"))
        if self.listed:
            found = {r[self.name]: r["held"] for r in held.collect() if r["held"]}
            self.factors |= {v: self.factors[v] * self.targets[v] / h for v, h in found.items()}
            return max((abs(h / self.targets[v] - 1) for v, h in found.items() if self.targets[v]), default=0.0)
        step = F.when(F.col("held") > 0, F.col(self.factor) * F.col("target") / F.col("held")).otherwise(F.col(self.factor))
        joined = self.factors.join(self.targets, self.name).join(held, self.name, "left")
        self.factors = materialise(joined.select(self.name, step.alias(self.factor), F.abs(F.col("held") / F.col("target") - 1).alias("miss")), "factors")
        miss = self.factors.where("miss is not null").agg(F.max("miss")).first()[0]
        self.factors = self.factors.drop("miss")
        return miss or 0.0


def raked_cells(described: DataFrame, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``tokens``, ``share`` (of the sample's tokens), ``probability`` and ``weight``.

    ``weights`` gives relative target weights of the values of a name; names that it lacks keep
    their tempered shares. ``weight`` is above 1 where a cell can't give its full part.
    """
    cells = materialise(described.groupBy(*TEMPER).agg(F.sum("n_tokens").alias("tokens")), "cells")
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    total = float(whole["tokens"] or 1)
    if whole["cells"] <= TOGETHER:
        cells = cells.coalesce(1)  # so few rows need no shuffle to be summed
    margins = [_Margin(_wanted(cells, name, total, budget, (weights or {}).get(name)), name) for name in TEMPER]
    shares = cells.withColumns({"base": F.col("tokens") / F.lit(total), "cap": F.col("tokens") / F.lit(budget * total)})

    def weighed() -> DataFrame:
        rows, free = shares, F.col("base")
        for m in margins:
            rows, free = m.on(rows), free * F.col(m.factor)
        return rows.withColumn("free", free).withColumn("weight", F.least("cap", "free"))

    for _ in range(rounds):
        if max([m.fit(weighed()) for m in margins]) < TOLERANCE:
            break
    some = F.col("tokens") > 0
    return materialise(
        weighed().select(
            *TEMPER, "tokens", F.col("weight").alias("share"),
            F.when(some, F.least(F.col("weight") / F.col("cap"), F.lit(1.0))).otherwise(F.lit(1.0)).alias("probability"),
            F.when(some, F.greatest(F.col("free") / F.col("cap"), F.lit(1.0))).otherwise(F.lit(1.0)).alias("weight"),
        ),
        "raked",
    )


def reached(cells: DataFrame, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``name, value, want, target, share``: what was asked, what tokens allow, and what ``raked_cells`` gives."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    out = None
    for name in TEMPER:
        given = cells.groupBy(name).agg(F.sum("share").alias("share"))
        rows = _targets(_wanted(cells, name, total, budget, (weights or {}).get(name))).join(given, name)
        rows = rows.select(F.lit(name).alias("name"), F.col(name).alias("value"), "want", "target", "share")
        out = rows if out is None else out.unionByName(rows)
    return out


def _cell(docs: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    tokens = n_tokens(F.col("text").cast("string"))
    has_topic = "topic" in docs.columns
    return {
        names["source"]: F.coalesce(F.col("source").cast("string"), F.lit(_MISSING)),
        names["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit(_MISSING)),
        names["topic"]: F.coalesce(F.col("topic").cast("string"), F.lit(_MISSING)) if has_topic else surface_topic(F.col("text").cast("string"), tokens),
        names["n_tokens"]: tokens,
    }


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from an id, the same everywhere."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


_OWN = {x: x for x in ("source", "lang", "topic", "n_tokens")}


def sampling_plan(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Every document with its cell, sampling probability, decision and weight."""
    described = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in _cell(docs, _OWN).items())), "described")
    cells = raked_cells(described, weights).select(*TEMPER, "probability", "weight")
    return described.join(cells, list(TEMPER)).select(
        "doc_id", "source", "lang", "topic", "n_tokens",
        F.round("probability", 6).alias("probability"),
        (draw(F.col("doc_id")) < F.col("probability")).alias("sampled"),
        F.round("weight", 6).alias("weight"),
    )


def sample(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn rows of ``docs``, with its own columns.

    The expected tokens of each source, language and topic have their target shares, as far as
    these have the tokens.
    """
    inner = dict(zip((*_OWN, "probability"), free_names(docs, *_OWN, "probability"), strict=True))
    described = materialise(docs.select(*(c.alias(x) for x, c in _cell(docs, _OWN).items())).groupBy(*TEMPER).agg(F.sum("n_tokens").alias("n_tokens")), "sums")
    cells = raked_cells(described, weights).select(*(F.col(x).alias(inner[x]) for x in (*TEMPER, "probability")))
    marked = docs.withColumns(_cell(docs, inner))
    return marked.join(cells, [inner[x] for x in TEMPER]).where(draw(F.col("doc_id")) < F.col(inner["probability"])).select(*(F.col(f"`{c}`") for c in docs.columns))


def plan_sql() -> str:
    """``sampling_plan`` of the table ``documents`` in SQL, round by round."""
    word = r"[^\x20\x09-\x0D]+"
    steps = [
        f"d0 AS (SELECT doc_id, coalesce(source, '{_MISSING}') AS source, coalesce(lang, '{_MISSING}') AS lang, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n_tokens FROM documents)",
        "described AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN n_tokens < 64 THEN 'brief' WHEN n_tokens >= 2048 THEN 'extended' WHEN contains(text, '@') OR contains(text, '://') THEN 'web' ELSE 'prose' END AS topic FROM d0)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM described GROUP BY ALL)",
        "whole AS MATERIALIZED (SELECT CASE WHEN sum(tokens) > 0 THEN sum(tokens) ELSE 1.0 END AS total FROM cells)",
    ]
    for name, power in TEMPER.items():
        steps.append(f"m_{name} AS (SELECT {name}, pow(sum(tokens) / any_value(total), {power}) AS raw, sum(tokens) / ({BUDGET} * any_value(total)) AS cap FROM cells, whole GROUP BY {name})")
        steps.append(f"want_{name} AS MATERIALIZED (SELECT {name}, raw / (SELECT sum(raw) FROM m_{name}) AS want, cap FROM m_{name})")
        steps.append(f"level_{name}_0 AS (SELECT CAST(1.0 AS DOUBLE) AS level)")
        for k in range(FILLS):
            steps.append(f"level_{name}_{k + 1} AS MATERIALIZED (SELECT coalesce((1 - coalesce(sum(cap) FILTER (want * level >= cap), 0)) / nullif(sum(want) FILTER (want * level < cap), 0), any_value(level)) AS level FROM want_{name}, level_{name}_{k})")
        steps.append(f"t_{name} AS (SELECT {name}, least(cap, want * level) AS t_{name} FROM want_{name}, level_{name}_{FILLS})")
    factors = ", ".join(f"CAST(1.0 AS DOUBLE) AS f_{n}, t_{n}" for n in TEMPER)
    joins = " ".join(f"JOIN t_{n} USING ({n})" for n in TEMPER)
    steps.append(f"r0 AS (SELECT source, lang, topic, tokens, tokens / total AS base, tokens / ({BUDGET} * total) AS cap, {factors} FROM cells {joins}, whole)")
    free, k = "base * " + " * ".join(f"f_{n}" for n in TEMPER), 0
    for _ in range(ROUNDS):
        for name in TEMPER:
            held = f"sum(least(cap, {free})) OVER (PARTITION BY {name})"
            steps.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN {held} > 0 THEN f_{name} * t_{name} / {held} ELSE f_{name} END AS f_{name}) FROM r{k})")
            k += 1
    steps.append(f"rates AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(least(cap, {free}) / cap, 1.0) ELSE 1.0 END AS p, CASE WHEN tokens > 0 THEN greatest({free} / cap, 1.0) ELSE 1.0 END AS w FROM r{k})")
    draw_sql = f"CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, {draw_sql} < p AS sampled, round(w, 6) AS weight FROM described JOIN rates USING (source, lang, topic)"
