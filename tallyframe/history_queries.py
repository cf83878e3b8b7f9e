"""Registered queries over histories, registered functions, states and streams, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from tallyframe.functions import registered
from tallyframe.functions.registered import Aggregate
from tallyframe.operators.frame import build
from tallyframe.operators.history import with_history
from tallyframe.operators.rollup import merged, states
from tallyframe.plans.spec import RowDerive
from tallyframe.registry import query
from tallyframe.sources import tables
from tallyframe.streaming.frames import snapshot, stream_frame

_SHIPPED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = tables.read_parquet(spark, d, "lineitem"), tables.read_parquet(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


registered.register_aggregate(
    "root_mean_square",
    Aggregate(lambda v, _: {"q": F.sum(v * v), "n": F.count(v)}, {"q": F.sum, "n": F.sum}, lambda s: F.sqrt(s["q"] / s["n"])),
)
registered.register_aggregate(
    "weighted_mean",
    Aggregate(
        lambda v, by: {"p": F.sum(v * by.cast("double")), "w": F.sum(by.cast("double"))}, {"p": F.sum, "w": F.sum},
        lambda s: s["p"] / F.nullif(s["w"], F.lit(0.0)), by=True,
    ),
)


@query(
    "history_rolling",
    f"""WITH s AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_suppkey AS g, o_orderdate AS e, greatest(o_orderdate, l_shipdate) AS a, l_quantity AS v FROM {_SHIPPED})
    SELECT x.l_orderkey, x.l_linenumber, round(sum(p.v) FILTER (WHERE p.e >= x.e - INTERVAL 90 DAY), 6) AS quantity_90d,
    CAST(count(p.v) FILTER (WHERE p.e >= x.e - INTERVAL 30 DAY) AS DOUBLE) AS lines_30d, max(struct_pack(e := p.e, v := p.v)).v AS last_quantity
    FROM s x LEFT JOIN s p ON p.g = x.g AND p.e < x.e AND p.a <= x.e GROUP BY x.id, x.l_orderkey, x.l_linenumber, x.e""",
)
def history_rolling(spark: SparkSession, d: str) -> DataFrame:
    """For each order line, what was known of its supplier when it was ordered: lines count from their shipping on."""
    features = [RowDerive("quantity_90d", "rolling_sum", "", "l_quantity", ("l_suppkey",), 90), RowDerive("lines_30d", "rolling_count", "", "l_quantity", ("l_suppkey",), 30), RowDerive("last_quantity", "last_value", "", "l_quantity", ("l_suppkey",))]
    known = with_history(_shipped(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderdate", "l_shipdate", "l_quantity"), features, "o_orderdate", "l_shipdate")
    return known.select("l_orderkey", "l_linenumber", *(F.round(f.out, 6).alias(f.out) for f in features))


@query(
    "history_frame",
    f"""WITH s AS (SELECT l_returnflag AS flag, l_suppkey AS g, o_orderdate AS e, greatest(o_orderdate, l_shipdate) AS a, row_number() OVER () AS id, l_quantity AS v FROM {_SHIPPED}),
    h AS (SELECT x.id, x.flag, x.e, CAST(count(p.v) AS DOUBLE) AS seen FROM s x LEFT JOIN s p ON p.g = x.g AND p.e < x.e AND p.a <= x.e AND p.e >= x.e - INTERVAL 60 DAY GROUP BY ALL)
    SELECT flag, strftime(e, '%Y-%m') AS t, round(avg(seen), 6) AS mean_seen, max(seen) AS most_seen FROM h WHERE flag <> 'N' GROUP BY ALL""",
)
def history_frame(spark: SparkSession, d: str) -> DataFrame:
    """A derive of rows as the input of a frame's measures; filters drop rows, not history."""
    spec = {
        "time_from": "o_orderdate", "available_from": "l_shipdate", "keys": [{"name": "flag", "from": "l_returnflag"}, {"name": "t", "via": "bin:month"}],
        "derives": [{"name": "seen_60d", "scope": "row", "via": "rolling_count", "of": "l_quantity", "by": "l_suppkey", "days": 60}],
        "aggregates": [{"name": "mean_seen", "using": "mean", "of": "seen_60d"}, {"name": "most_seen", "using": "max", "of": "seen_60d"}],
        "filters": [{"of": "l_returnflag", "using": "notEquals", "value": "N"}],
    }
    return build(_shipped(spark, d), spec).df


_LATE = {
    "time_from": "o_orderdate", "available_from": "l_shipdate", "keys": [{"name": "flag", "from": "l_returnflag"}, {"name": "t", "via": "bin:month"}],
    "aggregates": [
        {"name": "spread", "using": "root_mean_square", "of": "l_quantity", "availability": "past_only"},
        {"name": "price", "using": "weighted_mean", "of": "l_extendedprice", "by": "l_quantity"},
        {"name": "shipped", "using": "sum", "of": "l_quantity", "availability": "past_only"},
    ],
}
_LATE_SQL = f"""WITH s AS (SELECT l_returnflag AS flag, date_trunc('month', o_orderdate) AS e, date_trunc('month', greatest(o_orderdate, l_shipdate)) AS a, l_quantity AS q, l_extendedprice AS p FROM {_SHIPPED}),
    x AS (SELECT flag, e AS t, p AS p, q AS w, NULL AS q FROM s UNION ALL SELECT flag, a, NULL, NULL, q FROM s)
    SELECT flag, strftime(t, '%Y-%m') AS t, round(sqrt(avg(q * q)), 6) AS spread, round(round(sum(p * w) / sum(w), 6), 2) AS price, round(sum(q), 6) AS shipped FROM x GROUP BY ALL"""


def _late(df: DataFrame) -> DataFrame:
    """Prices to two places, as sums of fractions depend on their order."""
    return df.withColumn("price", F.round("price", 2))


@query("registered_aggregates", _LATE_SQL)
def registered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates that a user registered, beside one of the catalog, with late values moved forward."""
    return _late(build(_shipped(spark, d), _LATE).df)


@query("states_merged", _LATE_SQL)
def states_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same frame out of daily states of three batches, rolled up to months."""
    days = _LATE | {"keys": [_LATE["keys"][0], {"name": "t", "via": "bin:day"}]}
    rows = _shipped(spark, d)
    batches = [states(rows.where(F.col("o_orderstatus").eqNullSafe(F.lit(x)) if x else ~F.coalesce(F.col("o_orderstatus").isin("F", "O"), F.lit(False))), days) for x in ("F", "O", "")]
    return _late(merged(batches[0].unionByName(batches[1]).unionByName(batches[2]), days, "month"))


@query("stream_refile_past_only", _LATE_SQL)
def stream_refile_past_only(spark: SparkSession, d: str) -> DataFrame:
    """The same frame over a stream of order lines, joined with the orders' table."""
    lines, orders = tables.stream_parquet(spark, d, "lineitem"), tables.read_parquet(spark, d, "orders")
    return _late(snapshot(stream_frame(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), _LATE), "refiled"))


@query(
    "stream_align_full_outer",
    "WITH o AS (SELECT date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS p FROM orders GROUP BY 1), l AS (SELECT date_trunc('month', l_shipdate) AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT strftime(coalesce(o.t, l.t), '%Y-%m') AS t, round(p, 2) AS ordered, round(q, 2) AS shipped FROM o FULL JOIN l ON o.t = l.t",
)
def stream_align_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Two streams with a clock and a watermark each, in one frame."""
    streams = {"o": tables.stream_parquet(spark, d, "orders"), "l": tables.stream_parquet(spark, d, "lineitem")}
    spec = {"sources": [{"id": "o", "time_from": "o_orderdate"}, {"id": "l", "time_from": "l_shipdate"}], "keys": [{"name": "t", "via": "bin:month"}], "aggregates": [{"name": "ordered", "using": "sum", "of": "o.o_totalprice"}, {"name": "shipped", "using": "sum", "of": "l.l_quantity"}]}
    found = snapshot(stream_frame(streams, spec, "7 days"), "aligned")
    return found.select("t", F.round("ordered", 2).alias("ordered"), F.round("shipped", 2).alias("shipped"))


class Alarm:
    """Table function: on from a value over ``high`` until one under ``low``."""

    @staticmethod
    def analyze(rows, column, low, high):
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("alarm", BooleanType())]))

    def __init__(self):
        self.on = False

    def eval(self, row, column, low, high):
        if row[column] is not None:
            self.on = row[column] > high or (self.on and row[column] >= low)
        yield *row, self.on


registered.register_table_function("alarm", Alarm)


@query(
    "table_function_alarm",
    """WITH f AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS t, round(max(value), 6) AS top FROM events GROUP BY ALL)
    SELECT kind, t, top, coalesce(last_value(CASE WHEN top > 250 THEN true WHEN top < 150 THEN false END IGNORE NULLS) OVER (PARTITION BY kind ORDER BY t), false) AS alarm FROM f""",
)
def table_function_alarm(spark: SparkSession, d: str) -> DataFrame:
    """A registered table function over a frame: each kind's days in order, with a memory of one flag."""
    spec = {"time_from": "ts", "keys": [{"name": "kind", "from": "event_type"}, {"name": "t", "via": "bin:day"}], "aggregates": [{"name": "top", "using": "max", "of": "value"}]}
    return registered.through(build(tables.read_parquet(spark, d, "events"), spec).df, "alarm", ["kind"], ["t"], column="top", low=150.0, high=250.0)
