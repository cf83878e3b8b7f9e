import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import anomaly, classify, cluster, dynamic, forecast, ordering, ranking, recommend, regress
from tallyframe.plans.spec import resolve


@pytest.fixture(scope="module")
def planted(spark):
    """Twenty noisy series of very different scale, each with one jump, one of few points, one constant."""
    rng, rows = random.Random(3), []
    for s in range(20):
        size = 10.0 ** (s % 5)
        for k in range(60):
            jump = 15 * size if k == 20 + s else 0.0
            rows.append((f"s{s}", dt.date(2020, 1, 6) + dt.timedelta(days=7 * k), size * (50 + rng.gauss(0, 1)) + jump))
    rows += [("short", dt.date(2020, 1, 6), 1.0), ("short", dt.date(2020, 1, 13), 900.0)]
    rows += [("flat", dt.date(2020, 1, 6) + dt.timedelta(days=7 * k), 5.0) for k in range(10)] + [("flat", dt.date(2021, 1, 4), None)]
    df = spark.createDataFrame(rows, "series string, start date, y double")
    return rows, forecast.series(df, ["series"], "start", "y")


def test_planted_outliers_are_found_in_series_of_any_scale(planted):
    rows, series = planted
    found = anomaly.anomalies(series, ["series"], alpha=0.02).collect()
    jumps = {(f"s{s}", dt.date(2020, 1, 6) + dt.timedelta(days=7 * (20 + s))) for s in range(20)}
    flagged = {(r["series"], r["start"]) for r in found if r["is_anomaly"]}
    assert jumps <= flagged and len(flagged) <= 0.02 * len(found) and len(found) == 20 * 58 + 8
    assert {r["score"] for r in found if r["series"] == "flat"} == {0.0} and not any(r["series"] == "short" for r in found)


def test_scores_equal_a_plain_loop(planted):
    rows, series = planted
    by, want = {}, []
    for s, start, y in rows:
        if y is not None:
            by.setdefault(s, []).append((start, y))
    for s, points in by.items():
        if len(points) >= 4:
            y = np.array([v for _, v in sorted(points)])
            sizes = np.abs(y - forecast.fit(y).fitted)[2:]
            scale = 1.4826 * np.median(sizes) or sizes.mean()
            want += [(s, t, round(x / scale, 6) if scale else 0.0) for (t, _), x in zip(sorted(points)[2:], sizes, strict=True)]
    scores = np.array([x for *_, x in want])
    got = {(r["series"], r["start"]): (r["score"], r["p_value"]) for r in anomaly.anomalies(series, ["series"]).collect()}
    assert len(got) == len(want)
    for s, t, x in want:
        assert abs(got[s, t][0] - x) <= 2e-6 * max(1, x) and abs(got[s, t][1] - (scores >= x - 2e-6 * max(1, x)).mean()) < 0.01


def test_quantiles_are_scores_that_are_rare_enough(planted):
    _, series = planted
    residual = anomaly.residuals(series, ["series"])
    scores = np.array([r["score"] for r in anomaly.scored(residual).collect()])
    for r in anomaly.quantiles(residual, [0.02, 0.3, 1e-9]).collect():
        if r["alpha"] < 1e-6:
            assert r["threshold"] is None
        else:
            assert (scores >= r["threshold"]).mean() <= r["alpha"] < (scores >= max(s for s in scores if s < r["threshold"])).mean()


def test_no_series_no_scores(planted):
    assert anomaly.anomalies(planted[1].limit(0), ["series"]).count() == 0


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * (1, 100, 0.01) + (5, -300, 2)
    y = 7 + x @ (2.0, -0.03, 40.0) + rng.normal(size=n) * 0.5
    rows = [(k, float(a), float(b), float(c), float(v), "kept") for k, ((a, b, c), v) in enumerate(zip(x, y, strict=True))]
    rows += [(n, None, 1.0, 1.0, 2.0, "lacks"), (n + 1, 1.0, float("inf"), 1.0, 2.0, "lacks"), (n + 2, 5.0, -300.0, 2.0, None, "asked")]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold string").repartition(5), x, y


def test_regression_equals_least_squares(spark):
    df, x, y = table(spark)
    model = regress.fit(df, "id", "y", ["a", "b", "c"], ridges=(0.0,))
    design = np.hstack([np.ones((len(x), 1)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose([model.intercept, *model.weights], want, rtol=1e-6)
    got = regress.out_of_fold(df.drop("fold"), "id", model).collect()
    folds = np.array([r["fold"] for r in sorted(got, key=lambda r: r["id"])])
    assert len(got) == len(x) and len(set(folds)) == 5
    for f in range(5):
        w = np.linalg.lstsq(design[folds != f], y[folds != f], rcond=None)[0]
        assert all(abs(r["predicted"] - design[r["id"]] @ w) < 1e-5 for r in got if r["fold"] == f)
    rmse = np.sqrt(np.mean([(r["y"] - r["predicted"]) ** 2 for r in got]))
    assert abs(model.errors[0.0] - rmse) < 1e-6
    told = regress.accuracy(regress.out_of_fold(df.drop("fold"), "id", model), "y").first()
    assert abs(told["rmse"] - rmse) < 1e-3 and told["r2"] > 0.9 and regress.verdict(told["r2"]) == "trusted"


def test_ridge_is_chosen_by_other_folds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 20))
    y = x[:, 0] + rng.normal(size=30) * 3
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"x{j} double" for j in range(20)) + ", y double")
    model = regress.fit(df, "id", "y", [f"x{j}" for j in range(20)])
    assert model.ridge > 0 and model.errors[model.ridge] == min(model.errors.values())
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    w = np.linalg.solve(z.T @ z + model.ridge * 30 * np.eye(20), z.T @ t)
    assert np.allclose(model.weights, w * y.std() / x.std(0), rtol=1e-6)


def test_predictions_say_which_rows_they_were_made_for(spark):
    df, *_ = table(spark)
    model = regress.fit(df, "id", "y", ["a", "b", "c"])
    rows = {r["id"]: r for r in regress.deliverable(df, model).where("id >= 399").collect()}
    assert [rows[k]["is_prediction"] for k in (399, 400, 401, 402)] == ["no", "unscorable", "unscorable", "yes"]
    assert rows[400]["predicted"] is None and abs(rows[402]["predicted"] - (7 + 10 + 9 + 80)) < 1 and rows[402]["fold"] == "asked"


def test_columns_that_say_nothing_and_too_few_rows(spark):
    df, x, y = table(spark)
    twice = df.withColumn("same", F.lit(3.0)).withColumn("a2", F.col("a") * 2)
    model = regress.fit(twice, "id", "y", ["a", "a2", "same"], ridges=(0.0,))
    alone = regress.fit(twice, "id", "y", ["a"], ridges=(0.0,))
    assert abs(model.weights[0] + 2 * model.weights[1] - alone.weights[0]) < 1e-6 and abs(model.errors[0.0] - alone.errors[0.0]) < 1e-6
    for bad in (df.limit(0), df.where("id = 1")):
        with pytest.raises(ValueError, match="two are needed"):
            regress.fit(bad, "id", "y", ["a"])


def blobs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, (cx, cy) in enumerate(((0, 0), (20, 0), (0, 900), (20, 900))):
        rows += [(100 * g + k, float(cx + rng.normal()), float(cy + 40 * rng.normal()), "mine") for k in range(50)]
    rows += [(900, None, 1.0, "mine"), (901, float("nan"), 1.0, "mine"), (5, rows[5][1], rows[5][2], "mine")]
    return spark.createDataFrame(rows, "id long, x double, y double, at string"), rows


def test_clusters_are_the_groups_and_the_same_from_any_partitioning(spark):
    df, rows = blobs(spark)
    seen = []
    for parts in (1, 6):
        model = cluster.fit(df.repartition(parts), "id", ["x", "y"], 4)
        assert model.settled and model.steps < cluster.STEPS
        seen.append({r["id"]: r["cluster"] for r in cluster.assign(df, model).collect()})
    assert seen[0] == seen[1] and seen[0][900] is None and seen[0][901] is None
    groups = {}
    for k, c in seen[0].items():
        if k < 900:
            groups.setdefault(k // 100, set()).add(c)
    assert sorted(map(len, groups.values())) == [1, 1, 1, 1] and len(set.union(*groups.values())) == 4
    told = cluster.summary(cluster.assign(df, model), ["x", "y"]).collect()
    assert sorted(r["rows"] for r in told) == [50, 50, 50, 51] and all(cluster.verdict(r["silhouette"]) == "trusted" for r in told)


def test_settled_clusters_are_a_fixed_point(spark):
    df, rows = blobs(spark)
    model = cluster.fit(df, "id", ["x", "y"], 7)
    kept = [(i, x, y) for i, x, y, _ in rows if x is not None and x == x]
    z = np.round((np.array([(x, y) for _, x, y in kept]) - model.mean) / model.scale * cluster.UNIT)
    d = ((z[:, None] - model.centers[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    for c in range(len(model.centers)):
        if (near == c).any():
            assert np.allclose(z[near == c].mean(axis=0), model.centers[c])
    got = cluster.assign(df, model).where("cluster IS NOT NULL").collect()
    assert sorted((r["id"], r["cluster"]) for r in got) == sorted((i, int(c)) for (i, *_), c in zip(kept, near, strict=True))
    two = np.sort(np.sqrt(d), axis=1) / cluster.UNIT
    for r in got:
        at = next(k for k, (i, *_) in enumerate(kept) if i == r["id"])
        assert abs(r["distance"] - two[at, 0]) < 1e-9 and abs(r["silhouette"] - (1 - two[at, 0] / two[at, 1])) < 1e-9


def test_clusters_of_few_rows(spark):
    df, _ = blobs(spark)
    assert cluster.fit(df.limit(0), "id", ["x", "y"], 3) is None and cluster.assign(df.limit(0), None).count() == 0
    same = spark.createDataFrame([(k, 1.0) for k in range(9)], "id long, x double")
    model = cluster.fit(same, "id", ["x"], 3)
    assert len(model.centers) == 1 and {(r["cluster"], r["distance"], r["silhouette"]) for r in cluster.assign(same, model).collect()} == {(0, 0.0, 0.0)}


@pytest.mark.parametrize("order", [["name"], ["w", "name"]])
def test_ranges_spread_text_with_a_common_beginning_and_ties(spark, monkeypatch, order):
    monkeypatch.setattr(ordering, "SAMPLE", 200)
    df = spark.range(5000).select(F.format_string("Customer#%06d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("name"), F.lit(1.0).alias("w"), F.lit("mine").alias("range")).repartition(7)
    at = ordering.cuts(df, order)
    sizes = sorted(r["count"] for r in df.groupBy(ordering.range_of(df, order, at).alias("r")).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * 5000 / 4
    got = [(r["name"], r["p"], r["range"]) for r in ordering.positions(df, order, "p").orderBy("p").collect()]
    assert got == [(f"Customer#{k:06d}", k, "mine") for k in range(5000)]
    nulls = df.where("name < 'Customer#000300'").select(F.when(F.col("name") > "Customer#000010", F.col("name")).alias("name"), F.lit(1).alias("w")).distinct()
    assert ordering.positions(nulls, "name", "p").where("name IS NULL").first()["p"] == 0


def tastes(spark):
    """Forty users of four tastes who take items of theirs, and now and then one of two that everybody takes."""
    rng, rows = random.Random(6), []
    for u in range(40):
        for i in rng.sample(range(12), 7):
            rows.append((f"u{u:02d}", f"t{u % 4}_{i:02d}", 1.0))
        rows += [(f"u{u:02d}", f"hit{j}", 1.0) for j in range(3) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "user string, item string, w double")


def test_ranking_beats_popularity_on_planted_tastes(spark):
    data = tastes(spark)
    parts = recommend.split(data, 0.3).cache()
    train, held = parts.where("not held").drop("held"), parts.where("held").drop("held")
    users = held.select("user").distinct()
    ranked = ranking.recommend(ranking.fit(train, rank=6), train, users, 5)
    popular = recommend.popular_top(users, train, recommend.popularity(train), 5)
    ours, theirs = (ranking.quality(r, held, 5).first() for r in (ranked, popular))
    assert ours["ndcg"] > 1.5 * theirs["ndcg"] and ours["users_scored"] == theirs["users_scored"] == 40
    rows = ranked.collect()
    seen = {(r["user"], r["item"]) for r in train.collect()}
    assert len(rows) == 200 and not any((r["user"], r["item"]) in seen for r in rows)
    assert all(sorted(r["rank"] for r in rows if r["user"] == u) == [1, 2, 3, 4, 5] for u in {r["user"] for r in rows})


def test_scores_are_products_of_factors_and_the_best_unseen_come_first(spark):
    data = tastes(spark).where("user < 'u10'")
    model = ranking.fit(data, rank=4)
    u = {r["user"]: np.array(r["features"]) for r in model.users.collect()}
    i = {r["item"]: np.array(r["features"]) for r in model.items.collect()}
    seen = {(r["user"], r["item"]) for r in data.collect()}
    got = {}
    for r in ranking.recommend(model, data, data.select("user").distinct(), 3).collect():
        got.setdefault(r["user"], []).append((r["rank"], r["item"], r["score"]))
    for user, rows in got.items():
        fresh = sorted((-(u[user] @ v), item) for item, v in i.items() if (user, item) not in seen)
        assert np.allclose([x for *_, x in sorted(rows)], [-x for x, _ in fresh[:3]], atol=1e-4)
        assert all(abs(u[user] @ i[item] - x) < 1e-4 and (user, item) not in seen for _, item, x in rows)


def test_ranking_of_a_small_catalogue_makes_no_product_of_tables(spark, monkeypatch):
    data = tastes(spark).where("user < 'u10'").unionByName(spark.createDataFrame([("all", f"t{t}_{i:02d}", 1.0) for t in range(4) for i in range(12)], "user string, item string, w double"))
    model = ranking.fit(data, rank=4)
    held = ranking.recommend(model, data, data.select("user"), 3)
    assert "Cartesian" not in held._jdf.queryExecution().executedPlan().toString() and held.rdd.getNumPartitions() <= 8
    monkeypatch.setattr(ranking, "HELD_CELLS", 0)
    rows, want = ({(r["user"], r["rank"]): (r["item"], r["score"]) for r in x.collect()} for x in (held, ranking.recommend(model, data, data.select("user"), 3)))
    assert rows.keys() == want.keys() and sum(u == "all" for u, _ in rows) == 3
    assert all(abs(rows[k][1] - want[k][1]) < 1e-5 for k in rows)
    assert held.dtypes == ranking.recommend(model, data, data.select("user"), 3).dtypes


def test_ndcg_by_hand_and_users_nobody_knows(spark):
    recs = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 1)], "user string, item string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "q"), ("c", "x")], "user string, item string")
    gain = (1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3))
    r = ranking.quality(recs, relevant, 3).first()
    assert r["users_scored"] == 3 and abs(r["ndcg"] - gain / 3) < 1e-4 and abs(r["hit_rate"] - 1 / 3) < 1e-4
    data = tastes(spark)
    strangers = spark.createDataFrame([("nobody",)], "user string")
    assert ranking.recommend(ranking.fit(data, rank=2), data, strangers, 3).count() == 0
    with pytest.raises(ValueError, match="no interactions"):
        ranking.fit(data.limit(0))


def test_one_pass_gives_the_fits_of_all_origins():
    rng = np.random.default_rng(9)
    y = 50 + np.arange(40) * 0.7 + 8 * np.sin(np.arange(40) * np.pi / 2) + rng.normal(size=40)
    for season in (None, 4):
        for f, n in zip(forecast.fits(y, [4, 5, 7, 8, 9, 20, 40], season), [4, 5, 7, 8, 9, 20, 40], strict=True):
            alone = forecast.fit(y[:n], season)
            assert (f.alpha, f.beta, f.gamma, f.model) == (alone.alpha, alone.beta, alone.gamma, alone.model) and np.allclose(f.ahead(6), alone.ahead(6))


def test_quantile_bands_cover_what_they_state(spark):
    """Calibrated on early origins, the share of later errors below each quantile is what it says."""
    rng, rows = np.random.default_rng(10), []
    for s in range(150):
        y = 100 * 10.0 ** (s % 3) + np.cumsum(rng.normal(size=60)) * 10.0 ** (s % 3)
        rows += [(f"s{s}", dt.date(2019 + k // 12, 1 + k % 12, 1), float(v)) for k, v in enumerate(y)]
    rows += [("still", dt.date(2020, 1 + k, 1), 3.0) for k in range(9)]
    series = forecast.series(spark.createDataFrame(rows, "s string, start date, y double"), ["s"], "start", "y")
    errors = forecast.backtest(series, ["s"], 2).withColumn("fold", F.dense_rank().over(Window.partitionBy("s").orderBy("origin")) % 2).cache()
    levels = forecast.error_quantiles(errors.where("fold = 0"), [0.1, 0.5, 0.9]).cache()
    told = forecast.coverage(errors.where("fold = 1"), levels).collect()
    assert len(told) == 6 and all(abs(r["covered"] - r["probability"]) <= 0.02 for r in told if r["probability"] != 0.5) and all(abs(r["covered"] - r["probability"]) <= 0.03 for r in told)
    scaled = {h: sorted(round((r["actual"] - r["predicted"]) / r["scale"], 6) for r in errors.where(f"fold = 0 AND step = {h} AND scale > 0").collect()) for h in (1, 2)}
    for r in levels.collect():
        pool = scaled[r["step"]]
        assert abs(r["error"] - pool[int(np.ceil(round((len(pool) + 1) * r["probability"], 9))) - 1]) < 2e-6
    bands = forecast.forecast_quantiles(series.where("s in ('s0', 's1')"), ["s"], "month", 2, [0.1, 0.9]).collect()
    by = {(r["s"], r["start"], r["probability"]): r["value"] for r in bands}
    assert len(by) == 8 and all(by[s, t, 0.1] < by[s, t, 0.9] for s, t, _ in by) and {t for _, t, _ in by} == {dt.date(2024, 1, 1), dt.date(2024, 2, 1)}
    few = forecast.error_quantiles(errors.where("s = 's0' AND step = 1").limit(5), [0.99, 0.5])
    assert {r["probability"]: r["error"] is None for r in few.collect()} == {0.99: True, 0.5: False}
    assert forecast.error_quantiles(errors.limit(0), [0.5]).count() == 0


def shops(spark):
    """Sales with a promotion worth 40 and a level that drifts, and a second shop with another effect."""
    rng, rows, later = np.random.default_rng(12), [], []
    for name, effect in (("a", 40.0), ("b", -15.0)):
        level = 100.0
        for k in range(72):
            level += rng.normal() * 0.5
            promo = float(rng.random() < 0.3)
            day = dt.date(2018 + k // 12, 1 + k % 12, 1)
            (rows if k < 66 else later).append((name, day, level + effect * promo + rng.normal() * 0.5 if k != 10 else None, promo))
    return rows, later


def test_planted_promotion_is_recovered_and_carried_into_the_future(spark):
    rows, later = shops(spark)
    points = spark.createDataFrame(rows, "shop string, start date, sales double, promo double").repartition(4)
    future = spark.createDataFrame([(n, d, p) for n, d, _, p in later if (n, d) != ("b", dt.date(2023, 12, 1))], "shop string, start date, promo double")
    out = dynamic.forecast_with(points, ["shop"], "start", "sales", ["promo"], future, "month", 6).collect()
    by = {(r["shop"], r["start"]): r for r in out}
    assert len(by) == len(out) == 144
    for name, day, y, promo in later:
        r = by[name, day]
        if (name, day) == ("b", dt.date(2023, 12, 1)):
            assert r["yhat"] is None and r["promo"] is None and r["is_forecast"] == "yes"
        else:
            assert r["is_forecast"] == "yes" and r["y"] is None and r["promo"] == promo and abs(r["yhat"] - y) < 6
    assert abs(by["a", later[0][1]]["weights"][0] - 40) < 1 and abs(by["b", later[0][1]]["weights"][0] + 15) < 1
    assert by["a", dt.date(2018, 11, 1)]["yhat"] is None and by["a", dt.date(2018, 12, 1)]["yhat"] is not None
    y, x = np.array([r[2] for r in rows if r[0] == "a" and r[2] is not None]), np.array([[r[3]] for r in rows if r[0] == "a" and r[2] is not None])
    design = np.column_stack([np.ones(65), np.arange(65), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0][2]
    assert abs(by["a", later[0][1]]["weights"][0] - want) < 1e-9
    assert abs(by["a", later[0][1]]["yhat"] - (forecast.fit(y - x[:, 0] * want).ahead(1)[0] + want * later[0][3])) < 1e-3


def test_covariates_of_the_calendar_constant_ones_and_short_series(spark):
    rows, _ = shops(spark)
    points = spark.createDataFrame([(*r, 1.0) for r in rows] + [("new", dt.date(2023, 1, 1), 5.0, 1.0, 1.0)], "shop string, start date, sales double, promo double, same double")
    calendar = spark.createDataFrame([(dt.date(2023, k, 1), float(k % 2), 1.0) for k in range(1, 13)], "start date, promo double, same double")
    out = dynamic.forecast_with(points, ["shop"], "start", "sales", ["promo", "same"], calendar, "month", 2).where("is_forecast = 'yes'").collect()
    assert len(out) == 6 and all(r["weights"][1] == 0 and r["yhat"] is not None for r in out if r["shop"] != "new")
    assert all(r["yhat"] is None and r["weights"] is None and r["promo"] is not None for r in out if r["shop"] == "new")
    assert dynamic.forecast_with(points.limit(0), ["shop"], "start", "sales", ["promo"], calendar, "month", 2).count() == 0


def test_what_is_not_known_ahead_is_refused():
    spec = resolve({"time_from": "d", "keys": [{"name": "t", "via": "bin:month"}], "aggregates": [{"name": "y", "using": "sum", "of": "v"}, {"name": "promo", "using": "max", "of": "p", "availability": "known_ahead"}, {"name": "visits", "using": "sum", "of": "n", "availability": "past_only"}], "derives": [{"name": "month", "via": "month_of_year"}]})
    assert dynamic.known_ahead(spec, ["promo", "month"]) == ["promo", "month"]
    for name, words in (("visits", "past_only"), ("y", "no stated"), ("z", "no such column")):
        with pytest.raises(ValueError, match=words):
            dynamic.known_ahead(spec, [name])


def test_class_weights_count_in_the_leaves_only(spark):
    """Splits are the same with and without weights, and probabilities are those of a loop over the trees' leaves."""
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(13)
    rows = [(k, float(rng.normal(loc=c)), float(rng.normal()), c) for k, c in enumerate([0] * 180 + [1] * 20)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int").repartition(2).cache()
    plain, weighted = (classify.forest(df, "y", ["a", "b"], trees=5, depth=4, balanced=w, seed=3) for w in (False, True))
    assert plain.stages[-1].toDebugString.split("\n", 1)[1] == weighted.model.stages[-1].toDebugString.split("\n", 1)[1]
    placed = {r["id"]: [int(x) for x in r["leaf"]] for r in plain.transform(df).select("id", vector_to_array("__leaf").alias("leaf")).collect()}
    want = {}
    for k, *_ in rows:
        shares = []
        for tree in range(5):
            inside = [c for i, _, _, c in rows if placed[i][tree] == placed[k][tree]]
            up = sum(200 / (2 * 20) for c in inside if c == 1)
            shares.append(up / (up + sum(200 / (2 * 180) for c in inside if c == 0)))
        want[k] = sum(shares) / 5
    got = classify.predict(weighted, df).collect()
    assert all(abs(r["proba"] - want[r["id"]]) < 1e-9 and r["pred"] == int(r["proba"] >= 0.5) for r in got) and set(got[0].asDict()) == {"id", "a", "b", "y", "proba", "pred"}
    unweighted = {r["id"]: r["proba"] for r in classify.predict(plain, df).collect()}
    assert sum(r["proba"] for r in got) > sum(unweighted.values()) * 1.5


def test_three_classes_and_the_deliverable(spark):
    rows = [(k, float(k % 3), 1.0, k % 3) for k in range(60)] + [(100, 2.0, 1.0, None), (101, None, 1.0, 1), (102, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    three = classify.forest(df.where("y IS NOT NULL AND a IS NOT NULL"), "y", ["a", "b"], trees=9, depth=3, balanced=True)
    assert {(r["y"], r["pred"]) for r in classify.predict(three, df.where("id < 60")).collect()} == {(0, 0), (1, 1), (2, 2)}
    done = {r["id"]: r for r in classify.deliverable(df, "y", ["a", "b"], positive=2, trees=9, depth=3).collect()}
    assert len(done) == 63 and [done[k]["is_prediction"] for k in (0, 100, 101, 102)] == ["no", "yes", "unscorable", "unscorable"]
    assert done[100]["pred"] == 2 and done[100]["proba"] > 0.5 and done[0]["pred"] is None and done[102]["proba"] is None
    with pytest.raises(ValueError, match="fold"):
        classify.folds(df.withColumn("fold", F.lit(1)), "id", "y", 3)
    odd = classify.folds(df.where("y IS NOT NULL").withColumnsRenamed({"a": "range", "b": "order"}), "id", "y", 3)
    assert odd.columns == ["id", "range", "order", "y", "fold"] and sorted(r["count"] for r in odd.groupBy("y", "fold").count().collect())[0] >= 6
