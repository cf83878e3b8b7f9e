import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import classify, forecast, recommend
from tallyframe.operators.frame import build
from tallyframe.operators.ordering import positions, running_before
from tallyframe.plans.profile import column_roles, compile_profile, lift_task
from tallyframe.plans.spec import resolve
from tallyframe.sources import dialects, tables
from tallyframe.streaming.frames import stream_frame


def plain_fit(y, season):
    """The same search, one parameter set after the other."""
    best = None
    grid = forecast.GRID
    m = season if season and len(y) >= 2 * season else None
    for a in grid:
        for b, g in [(None, None)] + [(b, g) for b in grid for g in (None, *(grid if m else ()))]:
            s = [v - sum(y[:m]) / m for v in y[:m]] if g is not None else None
            level = sum(y[:m]) / m if g is not None else y[0]
            trend = (sum(y[m : 2 * m]) - sum(y[:m])) / m / m if g is not None else (y[1] - y[0] if b is not None else 0.0)
            sse = 0.0
            for t, v in enumerate(y):
                old = s[t % m] if s else 0.0
                sse += (v - level - trend - old) ** 2
                before = level
                level = a * (v - old) + (1 - a) * (level + trend)
                if b is not None:
                    trend = b * (level - before) + (1 - b) * trend
                if s:
                    s[t % m] = g * (v - before - trend) + (1 - g) * old
            if best is None or sse < best[0] - 1e-12 * max(1, best[0]):
                best = (sse, a, b, g)
    return best


@pytest.mark.parametrize("season", [None, 4])
def test_grid_search(season):
    rng = np.random.default_rng(0)
    y = (100 + np.arange(20) * 2 + 10 * np.sin(np.arange(20) * np.pi / 2) + rng.normal(size=20)).tolist()
    sse, a, b, g = plain_fit(y, season)
    f = forecast.fit(np.array(y), season)
    assert (f.alpha, f.beta, f.gamma) == (a, b, g) and math.isclose(f.sse, sse, rel_tol=1e-9)
    assert len(f.ahead(6)) == 6


@pytest.fixture(scope="module")
def months(spark):
    rows = [(s, f"{2020 + k // 12}-{k % 12 + 1:02d}-01", 100.0 + k + 20 * (k % 12 == 11) + s) for s in (1, 2) for k in range(36)]
    return spark.createDataFrame([*rows, (3, "2020-01-01", 5.0), (3, "2020-03-01", None)], "s int, d string, y double").withColumn("start", F.to_date("d"))


def test_forecast_and_backtest(months):
    rows = forecast.series(months, ["s"], "start", "y")
    out = forecast.forecast(rows, ["s"], "month", 6, 12).collect()
    future = [r for r in out if r["is_forecast"] == "yes"]
    assert len(future) == 12 and min(str(r["start"]) for r in future) == "2023-01-01" and all(r["y"] is None for r in future)
    assert [r["yhat"] for r in out if r["s"] == 3] == [None]
    errors = forecast.backtest(rows, ["s"], 2, 12)
    assert {r["s"]: r["n"] for r in errors.groupBy("s").agg(F.count_distinct("origin").alias("n")).collect()} == {1: 11, 2: 11}
    score = {r["s"]: r for r in forecast.accuracy(errors, ["s"]).collect()}
    assert score[1]["points"] == 22 and score[1]["skill"] > 20 and score[1]["mape"] < 15
    holes = forecast.clock_holes(months.where("d <> '2021-05-01'"), ["s"], "start", "month").collect()
    assert {(r["s"], r["missing"]) for r in holes} == {(1, 1), (2, 1), (3, 1)}


def test_short_series_are_held_out(spark):
    values = {"a": [3.0, 5.0, 4.0, 6.0, 8.0, 7.0], "b": [2.0, 2.0, 2.0], "c": [1.0, 1.0, 1.0, 1.0, 1.0], "d": [float(k % 3 + k) for k in range(12)]}
    rows = forecast.series(spark.createDataFrame([(s, k, v) for s, y in values.items() for k, v in enumerate(y)], "s string, k int, y double"), ["s"], "k", "y")
    held = {(r["s"], r["step"]): r for r in forecast.holdout(rows, ["s"]).collect()}
    assert sorted(held) == [("a", 1), ("c", 1), ("d", 1), ("d", 2), ("d", 3)]
    want = forecast.fit(np.array(values["d"][:9])).ahead(3)
    assert [held["d", k]["predicted"] for k in (1, 2, 3)] == pytest.approx(want.tolist()) and held["d", 2]["naive"] == values["d"][8]
    got = {r["s"]: r for r in forecast.evaluate(rows, ["s"], horizon=4).collect()}
    assert {s: r["method"] for s, r in got.items()} == {"a": "holdout", "c": "holdout", "d": "rolling-origin"}
    error = abs(7 - forecast.fit(np.array(values["a"][:5])).ahead(1)[0])
    assert got["a"]["mae"] == pytest.approx(error, abs=1e-4) and got["a"]["mase"] == pytest.approx(error / 1.75, abs=1e-4)
    assert got["c"]["mase"] is None and got["c"]["skill"] == 0.0 and got["d"]["points"] == 20
    errors = spark.createDataFrame([(4, k, v, v + 1, v - 1, 2.0) for k, v in enumerate([4.0, 8.0, 6.0, 2.0])], "origin int, step int, actual double, predicted double, naive double, scale double")
    one = forecast.accuracy(errors, []).first()
    assert (one["mase"], one["naive_mae"], one["mape"], one["naive_mape"]) == (0.5, 1.0, 26.0417, 26.0417)


def test_fold_summary_and_deliverable(spark):
    folds = spark.createDataFrame([(0, 10, 0.25, 40.0), (1, 12, 0.75, -10.0)], "fold int, users_scored int, precision double, lift double")
    assert recommend.summary(folds).first().asDict() == {"folds": 2, "users_scored": 11.0, "precision": 0.5, "lift": 15.0, "lift_min": -10.0, "lift_max": 40.0}
    assert recommend.summary(folds.limit(0)).count() == 0
    recs = spark.createDataFrame([("u", "i", 1, 0.5)], "user string, item string, rank int, score double")
    assert recommend.deliverable(recs, "who", "what").first().asDict() == {"who": "u", "what": "i", "rank": 1, "score": 0.5, "is_recommendation": "yes"}


def test_checks_against_the_data(spark):
    frame = spark.createDataFrame([("a", "2024-01", "1"), ("a", "2024-03", "x"), ("b", "2024-01", "2"), ("b", "2024-02", "3")], "k string, t string, v string")
    assert dialects.checks(frame, ["k"], "v", "nixtla", "t", "month", 2) == ["the target 'v' holds text, such as 'x'", "1 series skip buckets"]
    assert dialects.checks(frame.where("k = 'b'"), ["k"], "v", "nixtla", "t", "month", 2, 24) == ["fewer than two seasons of history"]
    assert dialects.checks(frame.limit(0), [], "v", "local", "t", "month") == []
    assert dialects.ignored_knobs("classify", {"trees": 9, "horizon": 3, "top_k": None, "kind": "classify", "season_length": 12}) == ["horizon", "season_length"]
    labels = spark.createDataFrame([("2024-01-05",), ("2024-W03",), ("2024-11",), ("2024-Q4",), ("2024",), ("soon",), (None,)], "t string")
    assert [r[0] for r in labels.select(dates.grain_of(F.col("t"))).collect()] == ["day", "week", "month", "quarter", "year", None, None]


def test_verdicts():
    assert [forecast.verdict(*x) for x in ((None,), (50, 0.5), (50, 10), (50, 40), (10, 40), (-5, 40), (50, None, 0.5))] == ["exact baseline", "exact", "trusted", "mixed", "weak", "unpredictable", "trusted"]
    assert [recommend.verdict(*x) for x in ((None,), (30,), (30, (-5, 60)), (5,), (-1,), (0,), (None, None, 0.1), (40, None, 0.0))] == ["not scored", "trusted", "unproven", "weak", "unpredictable", "tied", "no baseline", "unpredictable"]
    assert [classify.verdict(*x) for x in ((None, 1.0), (30, 0.8), (30, 0.5), (4, 0.9), (0, 0.4))] == ["no baseline", "trusted", "mixed", "weak", "unpredictable"]


def test_recommender_finds_tastes(spark):
    rows = [(f"u{u}", f"i{(u % 3) * 6 + (u * 5 + k) % 6}", "1") for u in range(60) for k in range(4)]
    df = spark.createDataFrame([*rows, ("", "i1", "1"), ("u1", None, "1"), ("u1", "i2", "x"), ("lone", "i99", "2"), ("lone", "i99", "3")], "u string, i string, w string")
    data = recommend.interactions(df, "u", "i", "w")
    assert data.count() == 241 and data.where("user = 'lone'").first()["w"] == 5.0
    parts = recommend.split(data)
    assert parts.where("user = 'lone' and held").count() == 0 and parts.where("held").groupBy("user").count().select(F.max("count")).first()[0] == 1
    m = recommend.evaluate(data, k=3, folds=2).collect()
    assert all(r["lift"] > 20 and r["precision"] > r["popular_precision"] for r in m)
    sim, pop = recommend.item_similarity(data), recommend.popularity(data)
    cold = {r["user"] for r in recommend.recommend(data, sim, pop, 3).collect()}
    assert "lone" in cold
    top = recommend.recommend(data, sim, pop, 3).join(data, ["user", "item"]).count()
    assert top == 0


def test_classifier(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b), int(a + 0.1 * rng.normal() > 0.6)) for k, (a, b) in enumerate(rng.random((160, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    out = classify.cross_validate(df, "k", "y", ["a", "b"], k=3, trees=15, depth=4)
    got = classify.accuracy(out, "y", "pred").first()
    assert got["accuracy"] > got["baseline"] and got["lift"] > 10
    assert classify.confusion(out, "y", "pred").agg(F.sum("rows")).first()[0] == 160
    assert classify.roc_auc(out, F.col("y") == 1, "proba").first()[0] > 0.9
    with pytest.raises(ValueError, match="one class"):
        classify.forest(df.withColumn("y", F.lit(1)), "y", ["a"])
    parts = classify.populations(spark.createDataFrame([(1.0, 1), (None, 1), (2.0, None)], "a double, y int"), "y", ["a"])
    assert [r["population"] for r in parts.collect()] == ["scorable", "incomplete", "to_predict"]


def test_tied_scores_share_ranks(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert classify.roc_auc(df, F.col("y") == 1, "s").first()[0] == 0.875


def test_dialects_and_routes(spark):
    df = spark.createDataFrame([("a", "b", "2024-01", 1.0)], "k string, j string, t string, v double")
    assert dialects.to_dialect(df, "nixtla", ["k", "j"], "v", "t").first().asDict() == {"unique_id": "a|b", "ds": "2024-01", "y": 1.0}
    assert dialects.to_dialect(df, "local", [], "v", "t").first()["series_id"] == "all"
    assert dialects.to_dialect(df, "recbole", ["k", "j"], "v").columns == ["user_id:token", "item_id:token", "rating:float"]
    for bad in (("recbole", ["k"], "v", None), ("nixtla", ["k"], "v", None), ("other", ["k"], "v", "t")):
        with pytest.raises(ValueError):
            dialects.to_dialect(df, *bad)
    assert dialects.route("classify", ["a"], None) == "forest" and dialects.route("rank", ["a", "b"], None) == "recommender" and dialects.route("forecast", ["a"], "t") == "smoothing"
    for kind, keys, clock in (("classify", ["a"], "t"), ("cluster", ["a"], None)):
        with pytest.raises(ValueError):
            dialects.route(kind, keys, clock)
    assert len(dialects.compatibility(["a", "b"], None, "nixtla", 4, 7, 3, "month")) == 5


def test_csv_profile_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,b\n1, \n2,x\n2,y\n", encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and tables.list_tables(spark, str(tmp_path)) == ["t"]
    got = {r["column"]: (r["sample"], r["cardinality"]) for r in tables.profile(df.withColumn("at", F.monotonically_increasing_id()), "at").collect()}
    assert got["a"] == ("1", 2) and got["b"] == ("x", 2)
    for form in ("parquet", "json", "csv", "orc"):
        tables.write(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() >= 3
    with pytest.raises(ValueError):
        tables.write(df, "x", "xml")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", "1", "x"), ("2024-01-01 12:00:00", "a", "5", "x"), ("2024-01-08 00:00:00", "b", "4", "x"), (None, "b", "9", "x"), ("2024-01-09 01:00:00", "b", "7", "drop"), ("2024-01-10 01:00:00", "c", "none", "x"), ("2024-02-01 01:00:00", "c", "8", "x")]
    rows = spark.createDataFrame(rows, "ts string, k string, v string, f string")
    rows.withColumn("ts", F.to_timestamp("ts")).withColumn("day", F.to_date("ts")).write.parquet(str(tmp_path / "in"))
    spec = {
        "time_from": "ts",
        "keys": [{"name": "k", "from": "k", "prefix": "k_", "aliases": [{"value": "a", "replace_with": "Z"}]}, {"name": "t", "via": "bin:week"}, {"name": "mo", "from": "day", "via": "bin:month"}, {"name": "dow", "from": "day", "via": "day_of_week"}],
        "aggregates": [{"name": "s", "using": "sum", "of": "v"}, {"name": "m", "using": "mean", "of": "v"}, {"name": "top", "using": "max", "of": "v"}],
        "derives": [{"name": "wk", "via": "week_of_year"}, {"name": "q", "via": "quarter_of_year", "from": "mo"}],
        "filters": [{"of": "f", "using": "notEquals", "value": "drop"}, {"of": "v", "using": "greaterThan", "value": 3}],
    }
    stream = spark.readStream.schema("ts timestamp, k string, v string, f string, day date").parquet(str(tmp_path / "in"))
    for key, name in (("week", "weeks"), ("day", "days")):
        own = spec | {"keys": [k | {"via": f"bin:{key}"} if k["name"] == "t" else k for k in spec["keys"]]}
        q = stream_frame(stream, own).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        want = build(spark.read.parquet(str(tmp_path / "in")), own).df
        assert spark.table(name).columns == want.columns
        got = sorted(map(tuple, spark.table(name).collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) == 3
    for more in ({"order_by": "k"}, {"aggregates": [{"name": "c", "using": "label", "of": "k"}]}, {"keys": [{"name": "k", "from": "k"}]}):
        with pytest.raises(ValueError, match="not on a stream"):
            stream_frame(stream, spec | {"derives": []} | more)


def test_ranks_without_one_sort_of_all(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(300)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in rng.sample(words, len(words))], "w string").repartition(5)
    got = {r["w"]: r["at"] for r in positions(df, "w", "at").collect()}
    assert [got[w] for w in words] == list(range(len(words)))
    numbers = spark.createDataFrame([(float(k % 37), k % 5) for k in range(500)], "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    before, rows = 0, running_before(numbers, "s", "n", "before").orderBy("s").collect()
    for r in rows:
        assert r["before"] == before
        before += r["n"]


def test_heavy_users_and_popular_gaps(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("heavy", f"i{k}", 1.0 + k % 3) for k in range(23)] + [(f"u{k}", f"i{rng.randrange(30)}", 1.0) for k in range(60)]
    data = recommend.interactions(spark.createDataFrame(rows, "u string, i string, w double"), "u", "i", "w")
    want = sorted(map(tuple, recommend.item_similarity(data).collect()))
    monkeypatch.setattr(recommend, "BLOCK", 4)
    assert [(a, b, pytest.approx(s)) for a, b, s in want] == sorted(map(tuple, recommend.item_similarity(data).collect()))
    pop = {r["item"]: r["pop"] for r in recommend.popularity(data).collect()}
    order = sorted(pop, key=lambda i: (-pop[i], i))
    seen = {}
    for r in data.collect():
        seen.setdefault(r["user"], set()).add(r["item"])
    users = spark.createDataFrame([(u,) for u in [*seen, "new"]], "user string")
    got = sorted((r["user"], r["rank"], r["item"], r["score"]) for r in recommend.popular_top(users, data, recommend.popularity(data), 4).collect())
    assert got == sorted((u, n, i, pop[i]) for u in [*seen, "new"] for n, i in enumerate([i for i in order if i not in seen.get(u, ())][:4], 1))


PROFILE = {
    "metrics": [{"name": "spread", "function": "hhi", "measure": "tonnes", "by": "haulier"}, {"name": "strike", "function": "max", "measure": "strike_flag"}],
    "dimensions": [{"name": "port"}, {"name": "haulier"}],
    "task": {"kind": "forecast", "clock": {"event": "landed", "grain": "month"}, "keys": ["port"], "target": "spread", "covariates": [{"metric": "strike", "availability": "known_ahead"}]},
}
BINDING = {"available_from": "filed", "bind": {"landed": "land_dt", "tonnes": "t_net", "haulier": "haulier_id", "port": "port_code", "strike_flag": "on_strike"}}


def test_profiles():
    spec, run = compile_profile(PROFILE, BINDING)
    assert spec == {
        "time_from": "land_dt", "keys": [{"name": "series_id", "from": "port_code"}, {"name": "t", "via": "bin:month"}],
        "aggregates": [{"name": "y", "using": "hhi", "of": "t_net", "by": "haulier_id"}, {"name": "x_strike", "using": "max", "of": "on_strike", "availability": "known_ahead"}],
        "validity": {"arrival_from": "filed"},
    }
    assert run == {"kind": "forecast", "pointer": "target", "targets": ["y"], "features": ["x_strike"], "known_ahead": ["x_strike"], "target": "y"}
    assert resolve(spec).sources[0].available_from == "filed"
    logical = compile_profile(PROFILE, BINDING, "logical")[0]
    assert [k["name"] for k in logical["keys"]] == ["port", "period"] and logical["aggregates"][0]["name"] == "spread"
    other = PROFILE | {"task": PROFILE["task"] | {"target": "strike", "covariates": []}}
    assert [a["using"] for a in compile_profile(other, BINDING, "logical")[0]["aggregates"]] == ["hhi", "max"]
    for task, words in (({"target": "none"}, "names no metric"), ({"keys": ["brand"]}, "no dimension"), ({"clock": {"event": "landed"}}, "grain"), ({"clock": {"event": "day", "grain": "day"}}, "not bound")):
        with pytest.raises(ValueError, match=words):
            compile_profile(PROFILE | {"task": PROFILE["task"] | task}, BINDING)


def test_flat_profiles_are_lifted():
    metrics = [m | {"role": r, "availability": a} for m, r, a in zip(PROFILE["metrics"], ("target", "feature"), (None, "known_ahead"), strict=True)]
    flat = {"kind": "forecast", "time": PROFILE["task"]["clock"], "keys": [{"from": "port"}, {"name": "t", "via": "bin:month"}], "metrics": metrics, "dimensions": PROFILE["dimensions"]}
    task, lifted = lift_task(flat)
    assert lifted and task == PROFILE["task"] | {"target": ["spread"]} and lift_task(PROFILE) == (PROFILE["task"], False)
    assert compile_profile(flat, BINDING) == compile_profile(PROFILE, BINDING)
    deep = {k: v for k, v in flat.items() if k != "keys"} | {"x-deep": {"series": "port"}}
    assert lift_task(deep) == (task, True)
    assert lift_task({"kind": "anomaly", "metrics": metrics[:1]})[0] == {"kind": "detect_anomaly", "signal": ["spread"]}
    for bad, words in (({"task": {"horizon": 3}}, "horizon"), ({"task": []}, "object"), ({"metrics": [{"name": "a"}]}, "role"), ({"time": {"grain": "day"}}, "event")):
        with pytest.raises(ValueError, match=words):
            lift_task(flat | bad)


def test_column_roles(spark):
    df = spark.createDataFrame([(f"2024-01-{k % 28 + 1:02d}", str(k * 1.5), f"id{k}", "ab"[k % 2]) for k in range(40)], "d string, n string, e string, g string")
    assert {r["column"]: r["role"] for r in column_roles(df).collect()} == {"d": "date", "n": "number", "e": "entity", "g": "dimension"}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_by_user_do_not_pass_through_the_driver(spark, tmp_path):
    rows = [(f"u{u}", f"i{(u + n) % 9}", n + 1) for u in range(40) for n in range(3)]
    spark.createDataFrame(rows, "user string, item string, rank int").write.parquet(str(tmp_path / "recs"))
    recs = spark.read.parquet(str(tmp_path / "recs"))
    held = recs.where("rank = 1").select("user", "item")
    assert "BroadcastExchange" not in planned(recommend.ranking_metrics(recs, held, 3))


def test_scores_shuffle_interactions_and_not_products(spark, monkeypatch):
    rows = [(f"u{u}", f"i{(u * 7 + n * n) % 9}", float(n + 1)) for u in range(40) for n in range(1 + u % 5)]
    data = recommend.interactions(spark.createDataFrame(rows, "u string, i string, w double"), "u", "i", "w").localCheckpoint()
    sim, pop, users = recommend.item_similarity(data).localCheckpoint(), recommend.popularity(data), data.select("user").distinct().where("user < 'u3'")
    scores = planned(recommend._scores(data, sim, None))
    assert scores.count("Exchange hashpartitioning(user") == 1 and "Exchange hashpartitioning(item" in scores and scores.count("Exchange hashpartitioning") == 2
    few = sorted(map(tuple, recommend.recommend(data, sim, pop, 3, users).collect()))
    monkeypatch.setattr(recommend, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(recommend, "ROWS_A_TASK", 7)
    assert few and few == sorted(map(tuple, recommend.recommend(data, recommend.item_similarity(data), pop, 3, users).collect()))
