"""Registered queries of the estimators behind anomaly, regression, clustering and ranking tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import anomaly, cluster, dynamic, forecast, ranking, recommend, regress
from tallyframe.operators.frame import build
from tallyframe.queries import PAIRS, SPLIT, TOP, bought
from tallyframe.registry import query
from tallyframe.sources import tables


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, d, name)


# --- anomalies -----------------------------------------------------------------------------------

_RESIDUALS = """
RECURSIVE m AS (SELECT o_orderpriority AS priority, CAST(date_trunc('week', o_orderdate) AS DATE) AS start, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS y FROM orders GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY start) AS i, count(*) OVER (PARTITION BY priority) AS n FROM m),
g AS (SELECT a.a / 10.0::DOUBLE AS a, b.b / 10.0::DOUBLE AS b FROM range(1, 10) a(a), (SELECT unnest([NULL, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS b) b),
f AS (
  SELECT x.priority, a, b, 0::BIGINT AS i, x.y AS level, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE z.y - x.y END AS trend, 0.0::DOUBLE AS sse FROM p x JOIN p z USING (priority), g WHERE x.i = 1 AND z.i = 2 AND x.n >= 4
  UNION ALL
  SELECT f.priority, a, b, p.i, a * p.y + (1 - a) * (level + trend), CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE b * (a * p.y + (1 - a) * (level + trend) - level) + (1 - b) * trend END, sse + (p.y - level - trend) * (p.y - level - trend) FROM f JOIN p ON f.priority = p.priority AND p.i = f.i + 1
),
best AS (SELECT f.priority, arg_min({'a': a, 'b': b}, sse) AS w FROM f JOIN p ON f.priority = p.priority AND f.i = p.i AND p.i = p.n GROUP BY 1),
e AS (SELECT p.priority, p.start, p.y, f.level + f.trend AS expected FROM p JOIN best USING (priority) JOIN f ON f.priority = p.priority AND f.i = p.i - 1 AND f.a = w.a AND f.b IS NOT DISTINCT FROM w.b WHERE p.i > 2),
c AS (SELECT *, 1.4826 * median(abs(y - expected)) OVER (PARTITION BY priority) AS scale FROM e),
s AS (SELECT *, round(abs(y - expected) / scale, 6) AS score FROM c),
r AS (SELECT *, round((count(*) OVER () - rank() OVER (ORDER BY score) + 1) / count(*) OVER (), 6) AS p_value FROM s)
"""


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    f = build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "priority", "from": "o_orderpriority"}, {"name": "t", "via": "bin:week"}], "aggregates": [{"name": "y", "using": "sum", "of": "o_totalprice"}]})
    return forecast.series(f.df.select("priority", dates.start_of("week", F.col("t")).alias("start"), F.round("y", 2).alias("y")), ["priority"], "start", "y")


@query("anomaly_scores", f"WITH {_RESIDUALS} SELECT priority, start, round(y, 2) AS y, round(expected, 2) AS expected, score, p_value, p_value <= 0.01 AS is_anomaly FROM r")
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    found = anomaly.anomalies(_weekly(spark, d), ["priority"], alpha=0.01)
    return found.select("priority", "start", F.round("y", 2).alias("y"), F.round("expected", 2).alias("expected"), "score", "p_value", "is_anomaly")


@query("anomaly_quantiles", f"WITH {_RESIDUALS}, q AS (SELECT unnest([0.01, 0.05, 0.2])::DOUBLE AS alpha) SELECT alpha, round(min(score) FILTER (p_value <= alpha), 4) AS threshold FROM q, r GROUP BY 1")
def anomaly_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.quantiles(anomaly.residuals(_weekly(spark, d), ["priority"]), [0.01, 0.05, 0.2]).select("alpha", F.round("threshold", 4).alias("threshold"))


# --- regression ----------------------------------------------------------------------------------

_ORDERS = "x AS (SELECT o_orderkey AS k, any_value(o_totalprice) AS y, count(*) AS a, sum(l_quantity) AS b, ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT % 5 AS fold FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"
_WEIGHTS = f"""{_ORDERS},
folds AS (SELECT DISTINCT fold FROM x UNION ALL SELECT NULL),
g AS (SELECT f.fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM x JOIN folds f ON f.fold IS NULL OR x.fold <> f.fold GROUP BY 1),
w AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM g),
c AS (SELECT fold, wa, wb, my - wa * ma - wb * mb AS w0 FROM w),
o AS (SELECT k, x.fold, y, w0 + wa * a + wb * b AS predicted FROM x JOIN c ON c.fold = x.fold)"""


def _order_sizes(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"), "lines", "quantity")


def _order_model(rows: DataFrame) -> regress.Model:
    return regress.fit(rows, "order_id", "price", ["lines", "quantity"], ridges=(0.0,))


@query("regress_coefficients", f"WITH {_WEIGHTS} SELECT CAST(fold AS INTEGER) AS fold, unnest(['intercept', 'lines', 'quantity']) AS name, round(unnest([w0, wa, wb]), 4) AS weight FROM c")
def regress_coefficients(spark: SparkSession, d: str) -> DataFrame:
    rows = _order_sizes(spark, d)
    return regress.coefficients(rows, _order_model(rows)).select("fold", "name", F.round("weight", 4).alias("weight"))


@query("regress_out_of_fold", f"WITH {_WEIGHTS} SELECT k AS order_id, CAST(fold AS INTEGER) AS fold, y AS price, round(predicted, 4) AS predicted FROM o")
def regress_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _order_sizes(spark, d)
    return regress.out_of_fold(rows, "order_id", _order_model(rows)).select("order_id", "fold", "price", F.round("predicted", 4).alias("predicted"))


@query("regress_accuracy", f"WITH {_WEIGHTS}, e AS (SELECT count(*) AS rows, avg(abs(y - predicted)) AS mae, sqrt(avg((y - predicted) * (y - predicted))) AS rmse, stddev_pop(y) AS baseline FROM o) SELECT rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(baseline, 4) AS baseline, round(1 - (rmse / baseline) * (rmse / baseline), 4) AS r2, round((1 - rmse / baseline) * 100, 4) AS lift FROM e")
def regress_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _order_sizes(spark, d)
    return regress.accuracy(regress.out_of_fold(rows, "order_id", _order_model(rows)), "price")


# --- clusters ------------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """How often, how much and how lately each customer bought."""
    spans = F.datediff(F.lit("2000-01-01").cast("date"), F.max("o_orderdate"))
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"), spans.alias("days_since"))


_FEATURES = ["orders", "spent", "days_since"]


@query("cluster_customers")
def cluster_customers(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    done = cluster.assign(rows, cluster.fit(rows, "customer", _FEATURES, 5))
    return done.select("customer", "cluster", F.round("distance", 6).alias("distance"), F.round("silhouette", 6).alias("silhouette"))


@query("cluster_summary")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    return cluster.summary(cluster.assign(rows, cluster.fit(rows, "customer", _FEATURES, 5)), _FEATURES)


# --- ranking -------------------------------------------------------------------------------------


@query("rank_factors")
def rank_factors(spark: SparkSession, d: str) -> DataFrame:
    data = bought(spark, d)
    return ranking.recommend(ranking.fit(data), data, data.select("user"), 5)


@query("rank_quality")
def rank_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well held items are ranked by factors of the others."""
    parts = recommend.split(bought(spark, d))
    train, held = parts.where("not held").drop("held"), parts.where("held").drop("held")
    return ranking.quality(ranking.recommend(ranking.fit(train), train, held.select("user"), 5), held, 5)


_POPULAR = f"""{PAIRS}, {SPLIT}, t AS (SELECT "user", item, w FROM s WHERE NOT held), h AS (SELECT "user", item FROM s WHERE held),
p AS (SELECT item, sum(w) AS score FROM t GROUP BY 1), u AS (SELECT DISTINCT "user" FROM h),
a AS (SELECT u."user", p.item, p.score FROM u, p WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x."user" = u."user" AND x.item = p.item)), {TOP.format(scored='a')},
g AS (SELECT h."user", sum(1 / log2(rank + 1)) AS gain FROM h JOIN r ON r."user" = h."user" AND r.item = h.item AND rank <= 5 GROUP BY 1),
n AS (SELECT "user", list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda k: 1 / log2(k + 1))) AS ideal FROM h GROUP BY 1)
SELECT round(avg(coalesce(gain, 0) / ideal), 4) AS ndcg, round(avg((gain IS NOT NULL)::INT), 4) AS hit_rate, count(*) AS users_scored FROM n LEFT JOIN g USING ("user")"""


@query("rank_popular_quality", f"WITH {_POPULAR}")
def rank_popular_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same measure of a list by popularity, which a ranking has to beat."""
    parts = recommend.split(bought(spark, d))
    train, held = parts.where("not held").drop("held"), parts.where("held").drop("held")
    users = held.select("user").distinct()
    return ranking.quality(recommend.popular_top(users, train.join(users, "user", "left_semi"), recommend.popularity(train), 5), held, 5)


# --- quantile forecasts --------------------------------------------------------------------------

_BACKTEST = """
RECURSIVE m AS (SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS start, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS y FROM orders GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY start) AS i, count(*) OVER (PARTITION BY priority) AS n, abs(y - lag(y) OVER (PARTITION BY priority ORDER BY start)) AS moved FROM m),
g AS (SELECT a.a / 10.0::DOUBLE AS a, b.b / 10.0::DOUBLE AS b FROM range(1, 10) a(a), (SELECT unnest([NULL, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS b) b),
f AS (
  SELECT x.priority, a, b, 0::BIGINT AS i, x.y AS level, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE z.y - x.y END AS trend, 0.0::DOUBLE AS sse FROM p x JOIN p z USING (priority), g WHERE x.i = 1 AND z.i = 2 AND x.n >= 4
  UNION ALL
  SELECT f.priority, a, b, p.i, a * p.y + (1 - a) * (level + trend), CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE b * (a * p.y + (1 - a) * (level + trend) - level) + (1 - b) * trend END, sse + (p.y - level - trend) * (p.y - level - trend) FROM f JOIN p ON f.priority = p.priority AND p.i = f.i + 1
),
best AS (SELECT priority, i, arg_min({'level': level, 'trend': trend}, sse) AS s FROM f WHERE i >= 4 GROUP BY ALL),
scales AS (SELECT priority, i, avg(moved) OVER (PARTITION BY priority ORDER BY i) AS scale FROM p),
room AS (SELECT priority, any_value(n) - 4 AS room FROM p GROUP BY 1),
origins AS (SELECT priority, unnest(CASE WHEN room > 24 THEN list_transform(range(0, 24), lambda k: 4 + (k * room) // 24) ELSE list_transform(range(0, greatest(room, 0)), lambda k: 4 + k) END) AS origin FROM (SELECT priority, room - 1 AS room FROM room)),
e AS (SELECT o.priority, o.origin, h.h AS step, round((p.y - (s.level + h.h * s.trend)) / scale, 6) AS error FROM origins o JOIN best b ON b.priority = o.priority AND b.i = o.origin JOIN scales c ON c.priority = o.priority AND c.i = o.origin, range(1, 3) h(h), p WHERE p.priority = o.priority AND p.i = o.origin + h.h AND scale > 0),
pool AS (SELECT step, list_sort(list(error)) AS errors, count(*) AS n FROM e GROUP BY 1),
q AS (SELECT step, probability, errors[CAST(ceil(round((n + 1) * probability, 9)) AS BIGINT)] AS error FROM pool, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS probability))
"""


def _monthly_series(spark: SparkSession, d: str) -> DataFrame:
    f = build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "priority", "from": "o_orderpriority"}, {"name": "t", "via": "bin:month"}], "aggregates": [{"name": "y", "using": "sum", "of": "o_totalprice"}]})
    return forecast.series(f.df.select("priority", dates.start_of("month", F.col("t")).alias("start"), F.round("y", 2).alias("y")), ["priority"], "start", "y")


@query("forecast_error_quantiles", f"WITH {_BACKTEST} SELECT CAST(step AS INTEGER) AS step, probability, round(error, 4) AS error FROM q")
def forecast_error_quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = forecast.error_quantiles(forecast.backtest(_monthly_series(spark, d), ["priority"], 2), [0.1, 0.5, 0.9])
    return found.select("step", "probability", F.round("error", 4).alias("error"))


@query("forecast_coverage", f"WITH {_BACKTEST} SELECT CAST(q.step AS INTEGER) AS step, probability, count(*) AS points, round(avg((e.error <= q.error)::INT), 4) AS covered, round(avg(CASE WHEN e.error >= q.error THEN probability * (e.error - q.error) ELSE (probability - 1) * (e.error - q.error) END), 4) AS pinball FROM q JOIN e ON e.step = q.step GROUP BY ALL")
def forecast_coverage(spark: SparkSession, d: str) -> DataFrame:
    errors = forecast.backtest(_monthly_series(spark, d), ["priority"], 2)
    return forecast.coverage(errors, forecast.error_quantiles(errors, [0.1, 0.5, 0.9]))


@query("forecast_bands", f"WITH {_BACKTEST} SELECT p.priority, CAST(p.start + to_months(CAST(q.step AS INTEGER)) AS DATE) AS start, probability, round(round(s.level + q.step * s.trend, 4) + q.error * scale, 2) AS value FROM p JOIN best b ON b.priority = p.priority AND b.i = p.n JOIN scales c ON c.priority = p.priority AND c.i = p.n, q WHERE p.i = p.n")
def forecast_bands(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_quantiles(_monthly_series(spark, d), ["priority"], "month", 2, [0.1, 0.5, 0.9]).withColumn("value", F.round("value", 2))


# --- covariates that are known ahead -------------------------------------------------------------


@query("forecast_known_ahead")
def forecast_known_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Monthly totals with the number of days and of Mondays in a month, which are known for months to come."""
    f = build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "priority", "from": "o_orderpriority"}, {"name": "t", "via": "bin:month"}], "aggregates": [{"name": "y", "using": "sum", "of": "o_totalprice"}]})
    days = F.dayofmonth(F.last_day("start"))
    mondays = F.size(F.filter(F.sequence("start", F.last_day("start")), lambda x: F.weekday(x) == 0))
    told = lambda rows: rows.withColumns({"days": days, "mondays": mondays})
    points = told(f.df.select("priority", dates.start_of("month", F.col("t")).alias("start"), "y"))
    months = f.df.agg(F.max("t").alias("t")).select(dates.start_of("month", F.col("t")).alias("last"))
    future = told(months.select(F.explode(F.expr("sequence(add_months(last, 1), add_months(last, 6), interval 1 month)")).alias("start")))
    done = dynamic.forecast_with(points, ["priority"], "start", "y", ["days", "mondays"], future, "month", 6, 12)
    return done.select("priority", "start", "y", "yhat", "is_forecast", "days", "mondays")
