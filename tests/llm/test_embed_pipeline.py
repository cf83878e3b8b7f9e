import numpy as np
import pytest

import corpus_pipeline
from tallyframe.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, root long, links string, tile int"


def vectors():
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in range(3):
        for _ in range(12):
            center = rng.normal(size=8)
            for _ in range(rng.integers(1, 9)):
                rows.append((k, (center + rng.normal(size=8) * 0.12).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], None), (k + 2, None, 0), (k + 3, [0.0] * 8, 0), (k + 4, [float("nan")] * 8, 0), (k + 5, [1.0, None] * 4, 0), (k + 6, [], 0), (k + 7, rows[0][1][:4], 0), (k + 8, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), (k + 9, [float("inf")] * 8, 1)]
    return rows


@pytest.mark.parametrize("tile", [512, 3])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()}
    good = [(i, np.array(v, dtype=np.float32).astype(float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, *_ in good}
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
    low = {i: i for i in links}
    for _ in links:
        for i, js in links.items():
            low[i] = min([low[i], *(low[j] for j in js)])
    assert sum(map(len, links.values())) > 50
    for i, *_ in rows:
        if i is not None:
            assert got[i] == (len(links.get(i, ())), low.get(i, i), low.get(i, i) == i)
    assert len(got) == len({r[0] for r in rows})
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_stages_keep_the_columns_of_documents(spark, docs):
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        seen.append((name, now.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
    counts = [n for _, n in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 20
    assert set(now.columns) == {"doc_id", "ids", "n_pieces", "scores"}


def test_stages_take_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
