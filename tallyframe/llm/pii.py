"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans of five kinds. Five labelers vote for or against each or
abstain: the strict pattern, a gazetteer (tables of mail domains, reserved address blocks, card
issuers, calling codes and key prefixes), the words before it, a checksum or range, and its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
for each kind. The posteriors are the soft labels of a final span classifier, which never sees the
votes: a logistic model over surface features (digits, separators, brackets, letters, length, what
stands before and behind). Spans of the strict patterns always stay; of the other candidates those
that the classifier accepts are added, unless their checksum or range fails. Vote and feature
patterns are bounded in number, so only their counts reach the driver.

Work is linear in a text: positions are running sums over the gaps between matches, and contexts are
cut from those gaps.

Defined results: a null text counts as empty and has no span; positions count code points, ends
exclusive; ties are ordered by kind, start, end; repeated rows agree; a null id keeps its row;
other columns, whatever their names, are kept by ``redact`` and ignored by ``find_spans``; without
candidates nothing is fitted; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.scratch import free_names, materialise

KINDS = ("email", "ip", "card", "phone", "secret")

# Fixed patterns. They match what the plain forms
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+            (where it has 13 to 19 digits)
#   \+[0-9][\x20().0-9-]+[0-9]
# match, leftmost and without overlap, in time linear in the text.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: what a text must hold for them (a pattern, or one of several strings), and the pattern.
LOOSE = (
    ("email", r"(?i)(?:[\[(]at[\])][\x20]?|[\x20]at[\x20])[a-z0-9-]++(?:[\x20]?[\[(]dot[\])][\x20]?|[\x20]dot[\x20]|\.)[a-z0-9-]", r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:[\x20]?[\[(]at[\])][\x20]?|[\x20]at[\x20])[a-z0-9-]++(?:[\x20]?[\[(]dot[\])][\x20]?[a-z0-9-]++|[\x20]dot[\x20][a-z0-9-]++|\.[a-z0-9-]++)++"),
    ("ip", r"[0-9](?:\[\.\]|\(\.\)| \. )", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[\x20]\.[\x20])[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"[0-9]{4}[._/][0-9]{4}", r"(?<![0-9._/-])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9._/-])"),
    ("phone", r"[0-9]", r"(?<![0-9+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    ("phone", r"00[0-9]", r"(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,5}){2,4}(?![0-9.-])"),
    ("secret", r"[0-9a-fA-F]{32}", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    ("secret", ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xoxa-", "xoxb-", "xoxp-", "eyJ"), r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk[-_][0-9A-Za-z_-]{20,}|xox[abp]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]+)(?![0-9A-Za-z])"),
)
# The gazetteer's tables.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "dev", "app", "me", "ai", "eu", "uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pl", "pt", "se", "no", "dk", "fi", "ie", "cz", "gr", "hu", "ro", "ru", "ua", "tr", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp", "kr", "cn", "in", "za")
RESERVED_FIRST = ("0", "127", "255")
CARD_ISSUERS = ("34", "37", "35", "36", "38", "30", "40", "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "50", "56", "57", "58", "60", "62", "64", "65", "67", "22", "23", "24", "25", "26", "27")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "234", "254", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "886", "961", "962", "966", "971", "972")
KEY_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "xoxa", "xoxb", "xoxp", "eyJ")
CONTEXT_FOR = {
    "email": r"mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|addr|login|from",
    "card": r"card|visa|credit|debit|pay|amex|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|cell|fax|sms|tel[eé]fono|anruf",
    "secret": r"token|secret|passw|api|key|auth|credential|bearer",
}
CONTEXT_AGAINST = r"version|\bv\.?$|section|isbn|issn|doi|order|invoice|\bno\.?$|\bid\b|serial|chapter|page|sha1|md5|commit|digest|checksum"
SHAPE = {
    "email": r"(?i)^[^@\x20]{1,64}(?:@|[\x20]?[\[(]at[\])][\x20]?|[\x20]at[\x20])[^@]{4,}$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]+|[0-9]{4}(?:[^0-9][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,5}){2,4}$",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[^0-9a-f].*)$",
}
WINDOW = 24
ACCEPT = 0.5
VOTES = ("strict", "gazetteer", "context", "check", "shape")
FEATURES = 8
ROUNDS = 60
#: Numbers that running sums take together, characters of a piece of text, and what no position reaches.
BLOCK, CUT, FAR = 128, 256, 1 << 30

def _running(arrays: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of several arrays, what the numbers before each of its own combine to, from 0 on.

    Blocks of BLOCK numbers are combined within and, by their totals, among themselves, so the time
    is linear in the numbers up to many millions of them.
    """
    fold = lambda xs: F.aggregate(xs, F.lit(0), combine)
    so_far = lambda xs: F.transform(xs, lambda _, i: fold(F.slice(xs, F.lit(1), i)))
    blocks = F.transform(arrays, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda g: F.slice(v, g * BLOCK + 1, F.lit(BLOCK))))
    totals = F.transform(blocks, lambda b: F.struct(b.alias("blocks"), F.transform(b, fold).alias("totals")))
    starts = F.transform(totals, lambda s: F.struct(s["blocks"].alias("blocks"), so_far(s["totals"]).alias("starts")))
    return F.transform(starts, lambda s: F.flatten(F.transform(s["blocks"], lambda b, g: F.transform(so_far(b), lambda x: combine(F.get(s["starts"], g), x)))))


def _patterns() -> list[tuple[str, str, bool, Callable[[Column], Column]]]:
    """Kind, pattern, whether it is strict, and what a text must hold for it."""
    digit, holds = (lambda text: text.rlike("[0-9]")), (lambda *parts: lambda text: reduce(or_, (F.contains(text, F.lit(p)) for p in parts)))
    strict = [(kind, STRICT[kind], True, needs) for kind, needs in (("email", holds("@")), ("ip", digit), ("card", digit), ("phone", holds("+")))]
    return strict + [(kind, pattern, False, holds(*needs) if isinstance(needs, tuple) else lambda text, needs=needs: text.rlike(needs)) for kind, needs, pattern in LOOSE]


def _hits(text: Column) -> Column:
    """For each pattern, its matches."""
    return F.array(*(F.when(needs(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for _, pattern, _, needs in _patterns()))


def _proposed(text: Column, hits: Column) -> Column:
    """For each pattern with matches: the matches and the gaps around them."""
    rows = [
        F.when(F.size(hits[i]) > 0, F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.split(text, pattern, -1).alias("gaps"), hits[i].alias("hits")))
        for i, (kind, pattern, base, _) in enumerate(_patterns())
    ]
    return F.filter(F.array(*rows), lambda p: p.isNotNull())


def _located(proposed: Column) -> Column:
    """Matches of all patterns in order, with validity and what stands before and behind."""
    sizes = F.transform(proposed, lambda p: F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda g, h: F.length(g) + F.length(h)))

    def rows(p: Column, before: Column) -> Column:
        def row(hit: Column, i: Column) -> Column:
            gap = F.get(p["gaps"], i)
            start = F.get(before, i) + F.length(gap)
            strict = p["base"] & _by_kind(p["kind"], lambda k: F.lit(k in ("email", "secret")) if k in ("email", "secret") else _CHECKS[k](hit))
            return F.struct(
                start.alias("start"), (start + F.length(hit)).alias("end"), p["kind"].alias("kind"), strict.alias("strict"), hit.alias("hit"),
                F.lower(F.right(gap, F.lit(WINDOW))).alias("before"), F.left(F.get(p["gaps"], i + 1), F.lit(1)).alias("behind"),
            )

        return F.transform(p["hits"], row)

    return F.array_sort(F.flatten(F.zip_with(proposed, _running(sizes, lambda a, b: a + b), rows)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        turned = F.reverse(_digits(hit))
        d = turned.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(hit))), F.lit(0), add) % 10 == 0


def _in_range(hit: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return F.regexp_replace(hit, r"[\[\]()\x20]", "").rlike(rf"^{part}(?:\.{part}){{3}}$")


def _mixed(hit: Column) -> Column:
    """Whether a key looks drawn at random: many different characters, digits and letters among them."""
    return (F.size(F.array_distinct(F.split(hit, ""))) >= 10) & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")


def _called(digits: Column) -> Column:
    one, two, three = (F.left(digits, F.lit(k)).isin(*CALLING_CODES) for k in (1, 2, 3))
    return one | two | three


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: ~F.contains(hit, F.lit("..")),
    "ip": _in_range,
    "card": _luhn,
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
    "secret": _mixed,
}
_LISTED: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.regexp_extract(F.lower(hit), "([a-z0-9-]+)$", 1).isin(*MAIL_ENDINGS),
    "ip": lambda hit: ~F.regexp_extract(hit, "^0*([0-9]+)", 1).isin(*RESERVED_FIRST),
    "card": lambda hit: F.left(_digits(hit), F.lit(2)).isin(*CARD_ISSUERS),
    "phone": lambda hit: F.when(hit.rlike(r"^(?:\+|00)"), _called(F.regexp_replace(_digits(hit), "^00", ""))).otherwise(hit.rlike(r"^\(?[2-9]")),
    "secret": lambda hit: F.left(hit, F.lit(4)).isin(*KEY_PREFIXES) | F.left(hit, F.lit(3)).isin(*KEY_PREFIXES) | F.length(hit).isin(32, 40, 64),
}


def _by_kind(kind: Column, each: Callable[[str], Column]) -> Column:
    out = F.lit(None)
    for number, name in reversed(list(enumerate(KINDS))):
        out = F.when(kind == number, each(name)).otherwise(out)
    return out


def _reach(found: Column) -> Column:
    """Of sorted candidates: how far strict ones before each reach, and how near those behind begin.

    Beginnings are counted from FAR, and from the end of the text.
    """
    ends = F.transform(found, lambda s: F.when(s["strict"], s["end"]).otherwise(0))
    begins = F.transform(F.reverse(found), lambda s: F.when(s["strict"], FAR - s["start"]).otherwise(0))
    return _running(F.array(ends, begins), lambda a, b: F.greatest(a, b))


def _apart(found: Column, reach: Column) -> Column:
    """Candidates without the loose ones that touch a strict one."""
    last = F.size(found) - 1
    clear = lambda s, i: (F.get(reach[0], i) <= s["start"]) & (FAR - F.get(reach[1], last - i) >= s["end"])
    return F.filter(found, lambda s, i: s["strict"] | clear(s, i))


def _described(found: Column) -> Column:
    """Candidates with votes (1, 0, -1) and surface features."""
    sign = lambda yes, no=0: F.when(yes, 1).otherwise(no)

    def one(s: Column) -> Column:
        hit, kind, before, behind = s["hit"], s["kind"], s["before"], s["behind"]
        digits = F.length(_digits(hit))
        size = F.length(hit)
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"),
            F.array(
                sign(s["strict"]),
                sign(_by_kind(kind, lambda k: _LISTED[k](hit)), -1),
                F.when(_by_kind(kind, lambda k: before.rlike(CONTEXT_FOR[k])), 1).when(before.rlike(CONTEXT_AGAINST), -1).otherwise(0),
                sign(_by_kind(kind, lambda k: _CHECKS[k](hit)), -1),
                sign(_by_kind(kind, lambda k: hit.rlike(SHAPE[k])), -1),
            ).alias("votes"),
            F.array(
                F.least(F.floor(digits / 4), F.lit(5)).cast("int"),
                F.least(F.floor(size / 8), F.lit(6)).cast("int"),
                F.when(F.contains(hit, F.lit("[")), 3).when(F.contains(hit, F.lit("(")), 2).when(hit.rlike(r"[\x20]"), 1).otherwise(0),
                F.least(F.length(F.regexp_replace(hit, r"[^.\x20_/-]", "")), F.lit(4)),
                F.when(hit.rlike("[A-Z]"), 2).when(hit.rlike("[a-z]"), 1).otherwise(0),
                sign(hit.rlike(r"^[+0]")),
                F.when(F.length(before) == 0, 3).when(before.rlike(r"[\s]$"), 0).when(before.rlike(r"[\"'=:(<]$"), 1).otherwise(2),
                F.when(F.length(behind) == 0, 3).when(behind.rlike(r"^[\s]"), 0).when(behind.rlike(r"^[\"'),.;>]"), 1).otherwise(2),
            ).alias("features"),
        )

    return F.transform(found, one)


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each kind and vote pattern by expectation-maximisation.

    Votes are taken as independent given the truth; each labeler has a probability of each vote
    for true and for false spans of a kind. Starts from the balance of votes.
    """
    posterior: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        votes, n = np.array([v for v, _ in rows]), np.array([c for _, c in rows], dtype=float)
        p = 1 / (1 + np.exp(-votes.sum(axis=1)))
        for _ in range(ROUNDS):
            chance = []
            for weight in (n * p, n * (1 - p)):
                table = np.stack([[(weight * (votes[:, j] == v)).sum() + 0.5 for v in (-1, 0, 1)] for j in range(votes.shape[1])])
                chance.append(np.log(table / table.sum(axis=1, keepdims=True)))
            prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
            odds = np.log(prior / (1 - prior)) + sum(chance[0][j][votes[:, j] + 1] - chance[1][j][votes[:, j] + 1] for j in range(votes.shape[1]))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        posterior |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
    return posterior


def _design(kind: int, features: tuple[int, ...]) -> list[str]:
    return [f"k{kind}", *(f"k{kind}f{j}:{v}" for j, v in enumerate(features))]


def classifier(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], posterior: dict) -> dict[str, float]:
    """Weights of a logistic model fitted to the posteriors as soft labels, by damped Newton steps."""
    names = sorted({x for k, _, f, _ in counts for x in _design(k, f)})
    column = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    for r, (k, _, f, _) in enumerate(counts):
        x[r, [column[c] for c in _design(k, f)]] = 1
    y, n = np.array([posterior[k, v] for k, v, _, _ in counts]), np.array([c for *_, c in counts], dtype=float)
    theta = np.zeros(len(names))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(names))
        theta = theta + np.linalg.solve(hessian, x.T @ (n * (y - p)) - theta)
    return dict(zip(names, theta.tolist(), strict=True))


def _fitted(described: DataFrame, column: str) -> dict[str, float]:
    spans = described.select(F.explode(column).alias("s")).select("s.kind", "s.votes", "s.features").groupBy("kind", "votes", "features").count().collect()
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in spans)
    if not rows:
        return {}
    by_votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, n in rows:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    return classifier(rows, reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())]))


def _accepted(column: str, weights: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for name, w in sorted(weights.items()) for x in (name, w))) if weights else F.lit(None).cast("map<string,double>")

    def keep(s: Column) -> Column:
        key = F.concat(F.lit("k"), s["kind"].cast("string"))
        worth = lambda name: F.coalesce(F.try_element_at(table, name), F.lit(0.0))
        total = worth(key)
        for j in range(FEATURES):
            total = total + worth(F.concat(key, F.lit(f"f{j}:"), s["features"][j].cast("string")))
        return s["strict"] | ((s["votes"][VOTES.index("check")] > 0) & (1 / (1 + F.exp(-total)) >= ACCEPT))

    kept = F.filter(column, keep)
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"))))


def _with_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the accepted spans of a text column."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hits, proposed, found, reach, apart = free_names(docs, "hits", "proposed", "found", "reach", "apart")
    rows = docs.withColumn(hits, _hits(body)).withColumn(proposed, _proposed(body, F.col(hits))).withColumn(found, _located(F.col(proposed)))
    rows = rows.withColumn(reach, _reach(F.col(found))).withColumn(apart, _apart(F.col(found), F.col(reach)))
    described = materialise(rows.withColumn(out, _described(F.col(apart))).drop(hits, proposed, found, reach, apart), "spans")
    return described.withColumn(out, _accepted(out, _fitted(described, out)))


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of each row; a span has ``kind`` (its number in KINDS), ``start, end, strict``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    body = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", "text", _hits(body).alias("hits")).select("doc_id", _proposed(body, F.col("hits")).alias("proposed")).select("doc_id", _located(F.col("proposed")).alias("found"))
    rows = rows.select("doc_id", "found", _reach(F.col("found")).alias("reach")).select("doc_id", _apart(F.col("found"), F.col("reach")).alias("apart"))
    described = materialise(rows.select("doc_id", _described(F.col("apart")).alias("spans")), "spans")
    return described.withColumn("spans", _accepted("spans", _fitted(described, "spans")))


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts by kind, digest of the strict spans, all spans as text, and how many of each kind these are.

    ``n_email`` to ``n_phone`` and the digest count strict spans; ``all_`` columns count all.
    """
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    written = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))
    strict = F.filter("spans", lambda s: s["strict"])

    def count(column: str | Column, number: int) -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == number)).cast("long")

    return spans.select(
        "doc_id",
        *(count(strict, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])),
        F.sha2(written(strict), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        *(count("spans", k).alias(f"all_{kind}") for k, kind in enumerate(KINDS)),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns stay.

    Overlapping spans are replaced together, under the kind of the first. A null text stays null.
    The text is cut into pieces of CUT characters once, and what stands between two spans is put
    together from the pieces it lies in.
    """
    out, pieces, ends = free_names(docs, "spans", "pieces", "ends")
    own, cut, done = F.col(out), F.col(pieces), F.col(ends)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    tag = lambda s: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1)
    placed = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = _with_spans(docs, text, out).withColumn(out, placed)
    some = F.size(own) > 0
    found = found.withColumns({pieces: F.when(some, F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))), ends: F.when(some, _running(F.array(F.transform(own, lambda s: s["end"])), lambda a, b: F.greatest(a, b))[0])})

    def between(begin: Column, end: Column) -> Column:
        first = F.floor(begin / CUT).cast("int")
        last = F.floor(F.greatest(end - 1, begin) / CUT).cast("int")
        return F.array_join(F.slice(cut, first + 1, last - first + 1), "").substr(begin - first * CUT + 1, end - begin)

    def part(s: Column, i: Column) -> Column:
        begin = F.get(done, i)
        return F.when(s["start"] >= begin, F.concat(between(begin, s["start"]), tag(s))).otherwise(F.lit(""))

    behind = F.greatest(F.element_at(done, -1), F.element_at(own, -1)["end"])
    clean = F.concat(F.array_join(F.transform(own, part), ""), between(behind, F.length(body)))
    return found.withColumn(text, F.when(some, clean).otherwise(F.col(f"`{text}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))
