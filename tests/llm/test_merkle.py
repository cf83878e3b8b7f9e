import hashlib
import itertools
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """The root over a list of digests and each one's runs of siblings, by plain lists."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(nodes)):
        steps = []
        for k, level in enumerate(levels[:-1]):
            at = i // 8**k
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            steps.append((run[: at % 8], run[at % 8 + 1 :]))
        proofs.append(steps)
    return levels[-1][0], proofs


def plain(rows):
    table = str.maketrans(merkle.UPPER, merkle.LOWER)
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: digest(enc(i), enc(source), enc(lang), enc(n), enc(text))
    langs = {}
    for i, text, lang, source, n in rows:
        spoils = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        spoiled = leaf(i, None if text is None else text.translate(table), lang, source, n)
        langs.setdefault(lang, []).append((i, leaf(i, text, lang, source, n), spoiled if spoils else None))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = {name: climbed([r[1] for r in langs[name]]) for name in names}
    root, upper = climbed([tops[n][0] for n in names])
    out = []
    for name, rest in zip(names, upper, strict=True):
        for (i, own, spoiled), steps in zip(langs[name], tops[name][1], strict=True):
            now = spoiled or own
            for left, right in [*steps, *rest]:
                now = digest(*left, now, *right)
            out.append((i, own, tops[name][0], root, digest(*itertools.chain(*(a + b for a, b in [*steps, *rest]))), now, now == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def many(rows):
    """Languages of 1, 8, 9, 64, 65, 513 and 4,200 documents beside the shared texts, so trees of every depth up to five."""
    made, at = [(*r, len(r[1] or "")) for r in rows], 1000
    for lang, n in (("l1", 1), ("l8", 8), ("l9", 9), ("m64", 64), ("m65", 65), ("n513", 513), ("o4200", 4200), ("", 3), ("é", 2), ("Z", 2), ("a1", 1), ("a2", 1), ("a3", 1)):
        made += [(at + 7 * k, f"Text {k % 11} Of {lang}" if k % 5 else f"plain {k}", lang, f"s{k % 3}" if k % 4 else None, k if k % 6 else None) for k in range(n)]
        at += 7 * n
    return made


@pytest.fixture(scope="module")
def table(spark, many):
    full = [(*r, "clash", "clash", 1, "x") for r in many]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, pos int, path string").repartition(5)


def test_manifest_equals_plain_lists_and_its_sql(table, many):
    got = sorted((tuple(r) for r in merkle.checks_out(table).collect()), key=key)
    want = sorted(plain(many), key=key)
    assert got == want and {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.execute(f"SELECT {names} FROM ({merkle.checks_sql()})").fetchall(), key=key) == want


def test_root_does_not_depend_on_how_rows_are_dealt(table):
    small = table.where("doc_id < 400 OR doc_id IS NULL")
    roots = {tuple(sorted((r["leaf"], r["root"]) for r in merkle.manifest(small.repartition(n)).collect())) for n in (1, 7)}
    assert len(roots) == 1


def test_every_path_leads_to_the_root_and_missing_columns_are_null(table):
    rows = merkle.manifest(table.drop("source", "n_chars")).select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("again"), "spoiled")
    assert rows.where("root <> again OR spoiled IS NOT NULL").count() == 0 and rows.select("root").distinct().count() == 1


def test_an_empty_table_and_one_document(spark, table):
    assert merkle.checks_out(table.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "Aa", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.checks_out(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()
