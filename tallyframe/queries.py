"""Registered queries over the star schema, each with the same result in SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.functions.scratch import materialise
from tallyframe.operators import classify, forecast, recommend
from tallyframe.operators.frame import Frame, build
from tallyframe.registry import query
from tallyframe.sources import dialects, tables

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, d, name)


def _sales(spark: SparkSession, d: str, parts: str = "") -> DataFrame:
    """Order lines with order date, brand and type; ``parts``: a hint on how parts are joined."""
    lines, part = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), _t(spark, d, "part")
    return lines.join(part.hint(parts) if parts else part, F.col("l_partkey") == F.col("p_partkey"))


_SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


def _rounded(f: Frame, n: int = 2, also: tuple[str, ...] = ()) -> DataFrame:
    return f.df.select(*(F.round(c, n).alias(c) if c in {m.out for m in f.spec.measures} | set(also) and f.df.schema[c].dataType.simpleString() == "double" else c for c in f.df.columns))


# --- buckets, reductions -------------------------------------------------------------------------


@query(
    "frame_sum_brand_quarter",
    f"SELECT p_brand AS brand, strftime(date_trunc('quarter', o_orderdate), '%Y') || '-Q' || quarter(o_orderdate) AS period, round(sum(l_extendedprice), 2) AS revenue FROM {_SALES} GROUP BY ALL",
)
def frame_sum_brand_quarter(spark: SparkSession, d: str) -> DataFrame:
    spec = {"time_from": "o_orderdate", "keys": [{"name": "brand", "from": "p_brand"}, {"name": "period", "via": "bin:quarter"}], "aggregates": [{"name": "revenue", "using": "sum", "of": "l_extendedprice"}]}
    return _rounded(build(_sales(spark, d), spec))


_LABEL = {"day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%G-W%V')", "month": "strftime(ts, '%Y-%m')", "quarter": "year(ts) || '-Q' || quarter(ts)", "year": "strftime(ts, '%Y')"}


def _bins(grain: str):
    @query(f"frame_bins_{grain}", f"SELECT event_type AS kind, {_LABEL[grain]} AS t, CAST(count(*) AS DOUBLE) AS n, round(max(value), 6) AS top FROM events GROUP BY ALL")
    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = {"time_from": "ts", "keys": [{"name": "kind", "from": "event_type"}, {"name": "t", "via": f"bin:{grain}"}], "aggregates": [{"name": "n", "using": "count"}, {"name": "top", "using": "max", "of": "value"}]}
        return build(_t(spark, d, "events"), spec).df


for _grain in _LABEL:
    _bins(_grain)


@query(
    "frame_scalar_derives",
    "SELECT strftime(w, '%G-W%V') AS t, CAST(count(*) AS DOUBLE) AS n, CAST(weekofyear(w) AS INTEGER) AS wk, CAST(month(w) AS INTEGER) AS mo, CAST(quarter(w) AS INTEGER) AS q, CAST(isodow(w) AS INTEGER) AS dow, CAST(year(w) AS INTEGER) AS yr FROM (SELECT date_trunc('week', o_orderdate) AS w FROM orders) GROUP BY w",
)
def frame_scalar_derives(spark: SparkSession, d: str) -> DataFrame:
    names = {"wk": "week_of_year", "mo": "month_of_year", "q": "quarter_of_year", "dow": "day_of_week", "yr": "year"}
    spec = {"time_from": "o_orderdate", "keys": [{"name": "t", "via": "bin:week"}], "aggregates": [{"name": "n", "using": "count"}], "derives": [{"name": k, "via": v} for k, v in names.items()]}
    return build(_t(spark, d, "orders"), spec).df


@query(
    "frame_mean_min_max_count",
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_extendedprice) AS high, CAST(count(l_discount) AS DOUBLE) AS n FROM lineitem GROUP BY ALL",
)
def frame_mean_min_max_count(spark: SparkSession, d: str) -> DataFrame:
    aggs = [("mean", "mean", "l_quantity"), ("low", "min", "l_quantity"), ("high", "max", "l_extendedprice"), ("n", "count", "l_discount")]
    spec = {"keys": [{"name": "flag", "from": "l_returnflag"}, {"name": "status", "from": "l_linestatus"}], "aggregates": [{"name": n, "using": u, "of": c} for n, u, c in aggs]}
    return _rounded(build(_t(spark, d, "lineitem"), spec), 4)


@query("frame_first_last", "SELECT CAST(user_id AS VARCHAR) AS user_id, arg_min(value, event_id) AS opening, arg_max(value, event_id) AS closing FROM events GROUP BY ALL")
def frame_first_last(spark: SparkSession, d: str) -> DataFrame:
    spec = {"order_by": "event_id", "keys": [{"name": "user_id", "from": "user_id"}], "aggregates": [{"name": "opening", "using": "first", "of": "value"}, {"name": "closing", "using": "last", "of": "value"}]}
    return build(_t(spark, d, "events"), spec).df


@query(
    "frame_label_status",
    "WITH c AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, arg_min(s, (-n, s)) AS s FROM c GROUP BY 1), ids AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS DOUBLE) AS id FROM (SELECT DISTINCT s FROM m)) SELECT CAST(o_custkey AS VARCHAR) AS customer, id AS status FROM m JOIN ids USING (s)",
)
def frame_label_status(spark: SparkSession, d: str) -> DataFrame:
    return build(_t(spark, d, "orders"), {"keys": [{"name": "customer", "from": "o_custkey"}], "aggregates": [{"name": "status", "using": "label", "of": "o_orderstatus"}]}).df


_NETS = f"WITH e AS (SELECT p_brand AS brand, strftime(o_orderdate, '%Y') AS t, l_suppkey, sum(l_extendedprice) AS v FROM {_SALES} GROUP BY ALL)"


@query("frame_hhi_supplier", f"{_NETS} SELECT brand, t, round(10000 * sum(v * v) / (sum(v) * sum(v)), 6) AS hhi FROM e GROUP BY ALL HAVING sum(v) > 0")
def frame_hhi_supplier(spark: SparkSession, d: str) -> DataFrame:
    spec = {"time_from": "o_orderdate", "keys": [{"name": "brand", "from": "p_brand"}, {"name": "t", "via": "bin:year"}], "aggregates": [{"name": "hhi", "using": "hhi", "of": "l_extendedprice", "by": "l_suppkey"}]}
    return build(_sales(spark, d), spec).df


@query("frame_top_share", f"{_NETS} SELECT brand, t, round(100 * max(v) / sum(v), 6) AS top, round(sum(v), 2) AS total FROM e GROUP BY ALL HAVING sum(v) > 0")
def frame_top_share(spark: SparkSession, d: str) -> DataFrame:
    spec = {"time_from": "o_orderdate", "keys": [{"name": "brand", "from": "p_brand"}, {"name": "t", "via": "bin:year"}], "aggregates": [{"name": "top", "using": "top_share", "of": "l_extendedprice", "by": "l_suppkey"}, {"name": "total", "using": "sum", "of": "l_extendedprice"}]}
    return build(_sales(spark, d), spec).df.select("brand", "t", "top", F.round("total", 2).alias("total"))


# --- filters -------------------------------------------------------------------------------------


def _filtered(name: str, table: str, key: str, f: dict, where: str):
    @query(f"filter_{name}", f"SELECT CAST({key} AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM {table} WHERE {where} GROUP BY ALL")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return build(_t(spark, d, table), {"keys": [{"name": "k", "from": key}], "aggregates": [{"name": "n", "using": "count"}], "filters": [f]}).df


_filtered("equals", "lineitem", "l_returnflag", {"of": "l_quantity", "using": "equals", "value": "10"}, "l_quantity = 10")
_filtered("not_equals", "part", "p_brand", {"of": "p_type", "using": "notEquals", "value": "SMALL"}, "p_type <> 'SMALL'")
_filtered("greater_than", "lineitem", "l_linestatus", {"of": "l_extendedprice", "using": "greaterThan", "value": 40000}, "l_extendedprice > 40000")
_filtered("less_than", "customer", "c_mktsegment", {"of": "c_acctbal", "using": "lessThan", "value": "0"}, "c_acctbal < 0")
_filtered("contains", "documents", "lang", {"of": "text", "using": "contains", "value": "THE "}, "contains(lower(text), 'the ')")


@query("filter_is_empty", "SELECT o_orderstatus AS k, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') GROUP BY ALL")
def filter_is_empty(spark: SparkSession, d: str) -> DataFrame:
    given = F.col("o_orderpriority")
    note = F.when(given == "4-NOT SPECIFIED", F.lit("  ")).when(given != "3-MEDIUM", given)
    spec = {"keys": [{"name": "k", "from": "o_orderstatus"}], "aggregates": [{"name": "n", "using": "count"}], "filters": [{"of": "note", "using": "isEmpty"}]}
    return build(_t(spark, d, "orders").withColumn("note", note), spec).df


_filtered("is_not_empty", "documents", "lang", {"of": "source", "using": "isNotEmpty"}, "coalesce(trim(source), '') <> ''")


@query("filter_upstream", "SELECT p_type AS k, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL")
def filter_upstream(spark: SparkSession, d: str) -> DataFrame:
    spec = {"keys": [{"name": "k", "from": "p_type"}], "aggregates": [{"name": "n", "using": "count"}], "filters": [{"of": "p_size", "using": "greaterThan", "value": 10, "applied_upstream": True}]}
    return build(_t(spark, d, "part"), spec).df


# --- arrival -------------------------------------------------------------------------------------


def _refile(availability: str):
    moved = "greatest(date_trunc('month', l_shipdate), date_trunc('month', o_orderdate))" if availability == "past_only" else "date_trunc('month', o_orderdate)"
    sql = f"""WITH s AS (SELECT l_returnflag AS flag, date_trunc('month', o_orderdate) AS e, {moved} AS a, l_quantity AS q, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    x AS (SELECT flag, e AS t, q, NULL AS v FROM s UNION ALL SELECT flag, a, NULL, v FROM s)
    SELECT flag, strftime(t, '%Y-%m') AS t, round(sum(q), 2) AS quantity, round(sum(v), 2) AS price FROM x GROUP BY ALL"""

    @query(f"refile_{availability}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        spec = {"time_from": "o_orderdate", "available_from": "l_shipdate", "keys": [{"name": "flag", "from": "l_returnflag"}, {"name": "t", "via": "bin:month"}]}
        spec["aggregates"] = [{"name": "quantity", "using": "sum", "of": "l_quantity"}, {"name": "price", "using": "sum", "of": "l_extendedprice", "availability": availability}]
        return _rounded(build(rows, spec))


_refile("past_only")
_refile("known_ahead")


# --- alignment -----------------------------------------------------------------------------------


def _two(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"o": _t(spark, d, "orders"), "l": _t(spark, d, "lineitem")}


_SOURCES = [{"id": "o", "time_from": "o_orderdate"}, {"id": "l", "time_from": "l_shipdate"}]


@query(
    "align_full_outer",
    "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS p FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT strftime(coalesce(o.t, l.t), '%Y-%m-%d') AS t, round(p, 2) AS ordered, round(q, 2) AS shipped FROM o FULL JOIN l ON o.t = l.t",
)
def align_full_outer(spark: SparkSession, d: str) -> DataFrame:
    spec = {"sources": _SOURCES, "source_from": "src", "keys": [{"name": "t", "via": "bin:day"}], "aggregates": [{"name": "ordered", "using": "sum", "of": "o.o_totalprice"}, {"name": "shipped", "using": "sum", "of": "l.l_quantity"}]}
    return _rounded(build(_two(spark, d), spec))


def _by_flag() -> dict:
    return {"sources": _SOURCES, "source_from": "src", "keys": [{"name": "t", "via": "bin:month"}, {"name": "flag", "from": "l.l_returnflag"}], "aggregates": [{"name": "shipped", "using": "sum", "of": "l.l_quantity"}, {"name": "orders", "using": "count", "source": "o"}]}


@query(
    "align_broadcast",
    "WITH l AS (SELECT date_trunc('month', l_shipdate) AS t, l_returnflag AS flag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), o AS (SELECT date_trunc('month', o_orderdate) AS t, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) SELECT strftime(l.t, '%Y-%m') AS t, flag, round(q, 2) AS shipped, n AS orders FROM l LEFT JOIN o ON l.t = o.t",
)
def align_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(build(_two(spark, d), _by_flag()))


@query("align_fold", "SELECT strftime(o_orderdate, '%Y-%m') AS t, '' AS flag, CAST(NULL AS DOUBLE) AS shipped, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1")
def align_fold(spark: SparkSession, d: str) -> DataFrame:
    return build(_two(spark, d), _by_flag() | {"filters": [{"of": "l.l_quantity", "using": "lessThan", "value": 0}]}).df


# --- keys ----------------------------------------------------------------------------------------


@query("key_alias_prefix", "SELECT 'seg_' || CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'FURNITURE' THEN 'HOME' ELSE c_mktsegment END AS seg, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def key_alias_prefix(spark: SparkSession, d: str) -> DataFrame:
    aliases = [{"value": v, "replace_with": "HOME"} for v in ("HOUSEHOLD", "FURNITURE")]
    return _rounded(build(_t(spark, d, "customer"), {"keys": [{"name": "seg", "from": "c_mktsegment", "prefix": "seg_", "aliases": aliases}], "aggregates": [{"name": "balance", "using": "sum", "of": "c_acctbal"}]}))


@query("key_composite", "SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS c, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL")
def key_composite(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(build(_t(spark, d, "lineitem"), {"keys": [{"name": n, "from": c} for n, c in (("a", "l_returnflag"), ("b", "l_linestatus"), ("c", "l_linenumber"))], "aggregates": [{"name": "q", "using": "sum", "of": "l_quantity"}]}))


@query("key_scalar", "SELECT CAST(month(o_orderdate) AS INTEGER) AS m, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1")
def key_scalar(spark: SparkSession, d: str) -> DataFrame:
    return build(_t(spark, d, "orders"), {"keys": [{"name": "m", "from": "o_orderdate", "via": "month_of_year"}], "aggregates": [{"name": "n", "using": "count"}]}).df


@query("key_binned_column", "SELECT strftime(l_shipdate, '%Y') AS shipped, l_returnflag AS flag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL")
def key_binned_column(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(build(_t(spark, d, "lineitem"), {"keys": [{"name": "shipped", "from": "l_shipdate", "via": "bin:year"}, {"name": "flag", "from": "l_returnflag"}], "aggregates": [{"name": "q", "using": "sum", "of": "l_quantity"}]}))


@query("key_row_number", "SELECT 'p_r' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR), 6, '0') AS row, CAST(p_size AS DOUBLE) AS size FROM part")
def key_row_number(spark: SparkSession, d: str) -> DataFrame:
    return build(_t(spark, d, "part"), {"order_by": "p_partkey", "keys": [{"name": "row", "via": "row_number", "prefix": "p_"}], "aggregates": [{"name": "size", "using": "sum", "of": "p_size"}]}).df


# --- emission, accounting, older dialect ---------------------------------------------------------


@query("emission_rule", "SELECT CAST(user_id AS VARCHAR) AS user_id, round(avg(value), 4) AS high FROM events WHERE value > 95 GROUP BY 1")
def emission_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("high", F.when(F.col("value") > 95, F.col("value")))
    return _rounded(build(rows, {"keys": [{"name": "user_id", "from": "user_id"}], "aggregates": [{"name": "high", "using": "mean", "of": "high"}]}), 4)


@query("drop_counts", "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'filtered' ELSE 'bad_time' END AS reason, count(*) AS rows FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderkey % 7 = 0 GROUP BY 1")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy")))
    spec = {"time_from": "day", "keys": [{"name": "t", "via": "bin:month"}], "aggregates": [{"name": "n", "using": "count"}], "filters": [{"of": "o_orderpriority", "using": "notEquals", "value": "5-LOW"}]}
    return build(rows, spec).drop_counts()


@query(
    "flat_spec",
    "SELECT 'p_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' ELSE o_orderpriority END AS series_id, strftime(o_orderdate, '%Y-%m') AS t, round(sum(o_totalprice), 2) AS spent, round(avg(o_totalprice), 2) AS usual, round(max(o_totalprice), 2) AS x_top, CAST(any_value(month(o_orderdate)) AS INTEGER) AS x_month FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2",
)
def flat_spec(spark: SparkSession, d: str) -> DataFrame:
    flat = {
        "series_from": "o_orderpriority", "series_prefix": "p_", "series_aliases": [{"value": "1-URGENT", "replace_with": "fast"}, {"value": "2-HIGH", "replace_with": "fast"}],
        "time_from": "o_orderdate", "time_grain": "month", "targets": [{"name": "spent", "measure": "o_totalprice"}, {"name": "usual", "fn": "mean", "measure": "o_totalprice"}],
        "features": [{"name": "top", "measure": "o_totalprice"}, {"name": "month", "derive": "month_of_year", "availability": "known_ahead"}], "filters": [{"column": "o_orderstatus", "value": "F"}],
    }
    return _rounded(build(_t(spark, d, "orders"), flat))


@query("csv_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(arg_min({c}, c_custkey) AS VARCHAR) AS sample, count(DISTINCT {c}) AS cardinality FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    return tables.profile(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


# --- dialects, clocks ----------------------------------------------------------------------------


def _monthly(spark: SparkSession, d: str) -> Frame:
    return build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "priority", "from": "o_orderpriority"}, {"name": "status", "from": "o_orderstatus"}, {"name": "t", "via": "bin:month"}], "aggregates": [{"name": "y", "using": "sum", "of": "o_totalprice"}]})


for _name, (_series, _clock, _value) in dialects.CLOCKED.items():

    def _dialect(name=_name, names=(_series, _clock, _value)):
        @query(f"dialect_{name}", f"SELECT o_orderpriority || '|' || o_orderstatus AS {names[0]}, strftime(o_orderdate, '%Y-%m') AS {names[1]}, round(sum(o_totalprice), 2) AS {names[2]} FROM orders GROUP BY ALL")
        def run(spark: SparkSession, d: str) -> DataFrame:
            f = _monthly(spark, d)
            return dialects.to_dialect(_rounded(f), name, ["priority", "status"], "y", "t")

    _dialect()


@query("dialect_recbole", f"SELECT CAST(o_custkey AS VARCHAR) AS \"user_id:token\", p_type AS \"item_id:token\", round(sum(l_quantity), 2) AS \"rating:float\" FROM {_SALES} GROUP BY ALL")
def dialect_recbole(spark: SparkSession, d: str) -> DataFrame:
    f = build(_sales(spark, d), {"keys": [{"name": "u", "from": "o_custkey"}, {"name": "i", "from": "p_type"}], "aggregates": [{"name": "w", "using": "sum", "of": "l_quantity"}]})
    return dialects.to_dialect(_rounded(f), "recbole", ["u", "i"], "w")


@query("clock_holes", "WITH b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer, date_trunc('month', o_orderdate) AS t FROM orders), g AS (SELECT customer, t, year(t) * 12 + month(t) AS i FROM b) SELECT customer, CAST(t AS DATE) AS start, CAST(i - lag(i) OVER (PARTITION BY customer ORDER BY i) - 1 AS INTEGER) AS missing FROM g QUALIFY missing > 0")
def clock_holes(spark: SparkSession, d: str) -> DataFrame:
    f = build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "customer", "from": "o_custkey"}, {"name": "t", "via": "bin:month"}], "aggregates": [{"name": "n", "using": "count"}]})
    return forecast.clock_holes(f.df.select("customer", dates.start_of("month", F.col("t")).alias("start")), ["customer"], "start", "month")


@query("series_count", "SELECT count(DISTINCT (o_orderpriority, o_orderstatus)) AS series FROM orders")
def series_count(spark: SparkSession, d: str) -> DataFrame:
    return _monthly(spark, d).df.agg(F.count_distinct(F.struct("priority", "status")).alias("series"))


# --- recommendation ------------------------------------------------------------------------------

PAIRS = f"d AS (SELECT CAST(o_custkey AS VARCHAR) AS \"user\", p_brand AS item, sum(l_quantity) AS w FROM {_SALES} GROUP BY ALL)"
_SIM = "n AS (SELECT item, sqrt(sum(w * w)) AS norm FROM {t} GROUP BY 1), dots AS (SELECT a.item, b.item AS other, sum(a.w * b.w) AS dot FROM {t} a JOIN {t} b ON a.\"user\" = b.\"user\" AND a.item <> b.item GROUP BY ALL), sim AS (SELECT dots.item, other, dot / (n.norm * m.norm) AS sim FROM dots JOIN n ON dots.item = n.item JOIN n m ON dots.other = m.item)"
SPLIT = "s AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY substr(md5(chr(0) || \"user\" || chr(0) || item), 1, 16)) > count(*) OVER (PARTITION BY \"user\") - CASE WHEN count(*) OVER (PARTITION BY \"user\") < 2 THEN 0 ELSE least(count(*) OVER (PARTITION BY \"user\") - 1, greatest(1, round_even(count(*) OVER (PARTITION BY \"user\") * 0.3, 0))) END AS held FROM d)"


def bought(spark: SparkSession, d: str) -> DataFrame:
    return materialise(recommend.interactions(_sales(spark, d, "merge"), "o_custkey", "p_brand", "l_quantity"), "bought")  # parts grow, and broadcast they pass through the driver


@query("rec_similarity", f"WITH {PAIRS}, {_SIM.format(t='d')} SELECT item, other, round(sim, 6) AS sim FROM sim")
def rec_similarity(spark: SparkSession, d: str) -> DataFrame:
    return recommend.item_similarity(bought(spark, d)).select("item", "other", F.round("sim", 6).alias("sim"))


@query("rec_popularity", f"WITH {PAIRS} SELECT item, sum(w) AS pop FROM d GROUP BY 1")
def rec_popularity(spark: SparkSession, d: str) -> DataFrame:
    return recommend.popularity(bought(spark, d))


@query("rec_split", f"WITH {PAIRS}, {SPLIT} SELECT \"user\", item, w, held FROM s")
def rec_split(spark: SparkSession, d: str) -> DataFrame:
    return recommend.split(bought(spark, d))


TOP = "r AS (SELECT \"user\", item, score, row_number() OVER (PARTITION BY \"user\" ORDER BY round(score, 9) DESC, item) AS rank FROM {scored})"


@query(
    "rec_topk",
    f"WITH {PAIRS}, {_SIM.format(t='d')}, f AS (SELECT d.\"user\", other AS item, sum(sim * w) AS score FROM d JOIN sim ON d.item = sim.item WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.\"user\" = d.\"user\" AND x.item = other) GROUP BY ALL), p AS (SELECT item, sum(w) AS pop FROM d GROUP BY 1), cold AS (SELECT DISTINCT \"user\" FROM d WHERE \"user\" NOT IN (SELECT \"user\" FROM f)), a AS (SELECT * FROM f UNION ALL SELECT c.\"user\", p.item, p.pop FROM cold c, p WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.\"user\" = c.\"user\" AND x.item = p.item)), {TOP.format(scored='a')} SELECT \"user\", item, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5",
)
def rec_topk(spark: SparkSession, d: str) -> DataFrame:
    data = bought(spark, d)
    return recommend.recommend(data, recommend.item_similarity(data), recommend.popularity(data), 5)


@query(
    "rec_popular_topk",
    f"WITH {PAIRS}, p AS (SELECT item, sum(w) AS score FROM d GROUP BY 1), a AS (SELECT u.\"user\", p.item, p.score FROM (SELECT DISTINCT \"user\" FROM d) u, p WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.\"user\" = u.\"user\" AND x.item = p.item)), {TOP.format(scored='a')} SELECT \"user\", item, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 5",
)
def rec_popular_topk(spark: SparkSession, d: str) -> DataFrame:
    data = bought(spark, d)
    return recommend.popular_top(data.select("user").distinct(), data, recommend.popularity(data), 5)


def _measured(recs: str) -> str:
    """SQL of one row: how recommendations ``recs`` meet the held items ``h``."""
    listed = f"SELECT \"user\", count(*) AS listed FROM {recs} WHERE rank <= 5 GROUP BY 1"
    hits = f"SELECT x.\"user\", rank, row_number() OVER (PARTITION BY x.\"user\" ORDER BY rank) AS hit FROM {recs} x JOIN h ON h.\"user\" = x.\"user\" AND h.item = x.item WHERE rank <= 5"
    per = f"(SELECT \"user\", count(*) AS relevant FROM h GROUP BY 1) LEFT JOIN ({listed}) USING (\"user\") LEFT JOIN (SELECT \"user\", count(*) AS n, sum(hit / rank) AS gain FROM ({hits}) GROUP BY 1) USING (\"user\")"
    return f"SELECT round(avg(coalesce(n, 0) / 5), 4) AS precision, round(avg(coalesce(n, 0) / relevant), 4) AS recall, round(avg(CASE WHEN n > 0 THEN gain / least(relevant, listed) ELSE 0 END), 4) AS map, count(*) AS users_scored FROM {per}"


def _fold_sql(fold: int) -> str:
    held = SPLIT.replace("md5(chr(0)", f"md5('{fold}' || chr(0)")
    parts = [
        PAIRS, held, "t AS (SELECT \"user\", item, w FROM s WHERE NOT held)", "h AS (SELECT \"user\", item FROM s WHERE held)", "u AS (SELECT DISTINCT \"user\" FROM h)", _SIM.format(t="t"),
        "f AS (SELECT t.\"user\", other AS item, sum(sim * w) AS score FROM t JOIN u ON u.\"user\" = t.\"user\" JOIN sim ON t.item = sim.item WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.\"user\" = t.\"user\" AND x.item = other) GROUP BY ALL)",
        "p AS (SELECT item, sum(w) AS pop FROM t GROUP BY 1)",
        "o AS (SELECT u.\"user\", p.item, p.pop AS score FROM u, p WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.\"user\" = u.\"user\" AND x.item = p.item))",
        "a AS (SELECT * FROM f UNION ALL SELECT * FROM o WHERE \"user\" NOT IN (SELECT \"user\" FROM f))", TOP.format(scored="a"), TOP.format(scored="o").replace("r AS", "b AS", 1),
        f"m AS ({_measured('r')})", f"q AS ({_measured('b')})", "c AS (SELECT count(DISTINCT item) AS covered FROM r WHERE rank <= 5)", "k AS (SELECT count(*) AS items_known FROM p)",
    ]
    lift = "CASE WHEN q.precision > 0 THEN round((m.precision / q.precision - 1) * 100, 2) WHEN m.precision > 0 THEN 100.0 END AS lift"
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT {fold} AS fold, m.users_scored, items_known, m.precision, m.recall, m.map, q.precision AS popular_precision, q.recall AS popular_recall, q.map AS popular_map, {lift}, round(covered / items_known, 4) AS coverage FROM m, q, c, k)"


@query("rec_evaluate", f"{_fold_sql(0)} UNION ALL {_fold_sql(1)}")
def rec_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return recommend.evaluate(bought(spark, d), k=5, folds=2)


# --- forecasting ---------------------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    f = build(_t(spark, d, "orders"), {"time_from": "o_orderdate", "keys": [{"name": "priority", "from": "o_orderpriority"}, {"name": "t", "via": "bin:month"}], "aggregates": [{"name": "y", "using": "sum", "of": "o_totalprice"}]})
    return forecast.series(f.df.withColumn("start", dates.start_of("month", F.col("t"))), ["priority"], "start", "y")


@query("ets_forecast")
def ets_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast(_series(spark, d), ["priority"], "month", horizon=6, season=12)


@query("ets_backtest")
def ets_backtest(spark: SparkSession, d: str) -> DataFrame:
    return forecast.backtest(_series(spark, d), ["priority"], horizon=2, season=12)


@query("ets_accuracy")
def ets_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return forecast.accuracy(forecast.backtest(_series(spark, d), ["priority"], horizon=2, season=12), ["priority"])


_HELD_OUT = """
WITH RECURSIVE m AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
p AS (SELECT priority, CAST(round(y, 2) AS DOUBLE) AS y, row_number() OVER (PARTITION BY priority ORDER BY t) AS i, count(*) OVER (PARTITION BY priority) AS n FROM m),
h AS (SELECT *, n - greatest(1, least(n // 4, 4)) AS origin FROM p),
g AS (SELECT a.a / 10.0::DOUBLE AS a, b.b / 10.0::DOUBLE AS b FROM range(1, 10) a(a), (SELECT unnest([NULL, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS b) b),
f AS (
  SELECT x.priority, a, b, 0::BIGINT AS i, x.y AS level, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE z.y - x.y END AS trend, 0.0::DOUBLE AS sse FROM h x JOIN h z USING (priority), g WHERE x.i = 1 AND z.i = 2 AND x.origin >= 4
  UNION ALL
  SELECT f.priority, a, b, h.i, a * h.y + (1 - a) * (level + trend), CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE b * (a * h.y + (1 - a) * (level + trend) - level) + (1 - b) * trend END, sse + (h.y - level - trend) * (h.y - level - trend) FROM f JOIN h ON f.priority = h.priority AND h.i = f.i + 1 AND h.i <= h.origin
),
best AS (SELECT f.priority, arg_min(level, sse) AS level, arg_min(trend, sse) AS trend FROM f JOIN h ON f.priority = h.priority AND f.i = h.i AND h.i = h.origin GROUP BY 1)
SELECT h.priority, CAST(h.origin AS INTEGER) AS origin, CAST(h.i - h.origin AS INTEGER) AS step, round(h.y, 2) AS actual, round(level + (h.i - h.origin) * trend, 2) AS predicted, round(l.y, 2) AS naive
FROM h JOIN best USING (priority) JOIN h l ON l.priority = h.priority AND l.i = h.origin WHERE h.i > h.origin
"""


@query("ets_holdout", _HELD_OUT)
def ets_holdout(spark: SparkSession, d: str) -> DataFrame:
    rows = _series(spark, d).withColumn("y", F.transform("y", lambda v: F.round(v, 2)))
    return forecast.holdout(rows, ["priority"]).select("priority", "origin", "step", *(F.round(c, 2).alias(c) for c in ("actual", "predicted", "naive")))


# --- classification ------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.split("text", " "))
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("n_chars"), (F.col("n_chars") / words).alias("per_word"))


_FLAGGED = "x AS (SELECT doc_id, quality AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred, n_chars FROM labels JOIN documents USING (doc_id))"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("pred"), "n_chars")


@query("classify_confusion", f"WITH {_FLAGGED} SELECT label, pred, count(*) AS rows FROM x GROUP BY ALL")
def classify_confusion(spark: SparkSession, d: str) -> DataFrame:
    return classify.confusion(_flagged(spark, d), "label", "pred")


@query(
    "classify_per_class",
    f"WITH {_FLAGGED}, c AS (SELECT unnest([0, 1]) AS class), m AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (label = class AND pred = class) AS hit FROM c, x GROUP BY 1), r AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS q FROM m) SELECT class, support, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 4) AS f1 FROM r",
)
def classify_per_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.per_class(_flagged(spark, d), "label", "pred")


@query("classify_macro_f1", f"WITH {_FLAGGED}, c AS (SELECT DISTINCT unnest([label, pred]) AS class FROM x), m AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (label = class AND pred = class) AS hit FROM c, x GROUP BY 1) SELECT round(avg(round(CASE WHEN hit > 0 THEN 2 * hit / (support + predicted) ELSE 0.0 END, 4)), 4) AS macro_f1 FROM m")
def classify_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return classify.macro_f1(classify.per_class(_flagged(spark, d), "label", "pred"))


@query("classify_auc", f"WITH {_FLAGGED}, r AS (SELECT label, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rank FROM x) SELECT round((sum(rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 4) AS auc FROM r")
def classify_auc(spark: SparkSession, d: str) -> DataFrame:
    return classify.roc_auc(_flagged(spark, d), F.col("label") == 1, "n_chars")


@query("classify_accuracy", f"WITH {_FLAGGED}, b AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM x GROUP BY label)) SELECT round(count(*) FILTER (label = pred) / count(*), 4) AS accuracy, round(any_value(most) / count(*), 4) AS baseline, round((count(*) FILTER (label = pred) / any_value(most) - 1) * 100, 4) AS lift FROM x, b")
def classify_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return classify.accuracy(_flagged(spark, d), "label", "pred")


@query("stratified_folds", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id)) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return classify.folds(_t(spark, d, "labels"), "doc_id", "quality", 5).select("doc_id", "quality", "fold")


@query("classify_forest")
def classify_forest(spark: SparkSession, d: str) -> DataFrame:
    done = classify.cross_validate(_labelled(spark, d), "doc_id", "quality", ["n_chars", "per_word", "toxic"])
    return done.select("doc_id", "quality", "fold", F.round("proba", 6).alias("proba"), "pred")


@query(
    "classify_populations",
    "SELECT doc_id, CASE WHEN words <= 3 THEN 'unscorable' WHEN quality IS NULL THEN 'yes' ELSE 'no' END AS is_prediction, words > 3 AND quality IS NULL AS predicted FROM (SELECT doc_id, quality, len(string_split(text, ' ')) AS words FROM documents LEFT JOIN labels USING (doc_id))",
)
def classify_populations(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.split("text", " "))
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.col("n_chars").cast("double").alias("size"), F.when(words > 3, F.col("n_chars") / words).alias("per_word"))
    done = classify.deliverable(rows, "quality", ["size", "per_word"], trees=10)
    return done.select("doc_id", "is_prediction", (F.col("pred").isNotNull() & F.col("proba").between(0, 1)).alias("predicted"))
