import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from tallyframe.functions import registered
from tallyframe.functions.registered import Aggregate
from tallyframe.operators import history
from tallyframe.operators.frame import build
from tallyframe.operators.history import with_history
from tallyframe.operators.rollup import merged, states
from tallyframe.plans.spec import RowDerive, resolve
from tallyframe.streaming.frames import stream_frame

RMS = Aggregate(lambda v, _: {"q": F.sum(v * v), "n": F.count(v)}, {"q": F.sum, "n": F.sum}, lambda s: F.sqrt(s["q"] / s["n"]))
WEIGHTED = Aggregate(
    lambda v, by: {"p": F.sum(v * by.cast("double")), "w": F.sum(F.when(v.isNotNull(), by.cast("double")))},
    {"p": F.sum, "w": F.sum}, lambda s: s["p"] / F.nullif(s["w"], F.lit(0.0)), by=True,
)


@pytest.fixture(scope="module", autouse=True)
def functions():
    registered.register_aggregate("rms_test", RMS, replace=True)
    registered.register_aggregate("weighted_test", WEIGHTED, replace=True)
    yield
    for name in ("rms_test", "weighted_test"):
        del registered.AGGREGATES[name]


def made(seed, n):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.03 else start + dt.timedelta(hours=6 * rng.randrange(400))
        seen = None if at is None or rng.random() < 0.3 else at + dt.timedelta(hours=rng.choice((-5, 0, 6, 24, 24 * 9, 24 * 70)))
        key = rng.choice(("hot", "hot", "hot", "a", None))
        rows.append((i, key, at, seen, rng.choice((None, 1.5, -2.25, 100.0, 1e25, float("nan"))), str(rng.randrange(1, 4))))
    return rows


COLUMNS = "id int, k string, at timestamp, seen timestamp, v double, w string"
FEATURES = [RowDerive("s7", "rolling_sum", "", "v", ("k",), 7), RowDerive("m30", "rolling_mean", "", "v", ("k",), 30), RowDerive("c7", "rolling_count", "", "v", ("k",), 7), RowDerive("last", "last_value", "", "v", ("k",)), RowDerive("last3", "last_value", "", "v", ("k",), 3)]


def plain(rows, feature):
    out = {}
    for i, k, at, _, _, _ in rows:
        if at is None:
            out[i] = None
            continue
        far = at - dt.timedelta(days=feature.days) if feature.days else dt.datetime.min
        past = [(e, v) for _, g, e, a, v, _ in rows if e is not None and (g or "") == (k or "") and far <= e < at and max(e, a or e) <= at and v is not None and not math.isnan(v) and abs(v) < 1e22]
        total = sum(v for _, v in past)
        out[i] = {"rolling_count": float(len(past)), "rolling_sum": total if past else None, "rolling_mean": total / len(past) if past else None, "last_value": max(past)[1] if past else None}[feature.via]
    return out


def test_history_shuffles_rows_and_not_steps(spark):
    rows = spark.createDataFrame(made(3, 50), COLUMNS)
    plan = with_history(rows, FEATURES, "at", "seen")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_history_of_asked_rows(spark, monkeypatch):
    rows = spark.createDataFrame(made(4, 200), COLUMNS)
    features = [*FEATURES, RowDerive("c30", "rolling_count", "", "v", ("k", "w"), 30)]
    asked = F.col("w") != "2"
    want = sorted(map(str, with_history(rows, features, "at", "seen").where(asked).collect()))
    assert want == sorted(map(str, with_history(rows, features, "at", "seen", asked=asked).collect())) and 0 < len(want) < 200
    monkeypatch.setattr(history, "GROUP", 40)
    assert want == sorted(map(str, with_history(rows, features, "at", "seen", asked=asked).collect()))


def test_history_makes_only_needed_steps(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "a", start, start + dt.timedelta(days=8 * (i % 4 != 0)), 1.0, "1") for i in range(100)], COLUMNS)
    spec = {
        "time_from": "at", "available_from": "seen", "keys": [{"name": "t", "via": "bin:day"}],
        "derives": [{"name": "recent", "scope": "row", "via": "rolling_count", "of": "v", "by": "k", "days": 7}],
        "aggregates": [{"name": "n", "using": "count", "of": "recent"}], "filters": [{"of": "id", "using": "lessThan", "value": 10}],
    }
    f = build(rows, spec)
    assert [tuple(r) for r in f.df.collect()] == [("2024-01-01", 10.0)] and f.meta["rows_in"] == 100 and f.meta["rows_dropped"]["filtered"] == 90
    plan = f.df._jdf.queryExecution().optimizedPlan()
    while "Window" not in plan.nodeName() or "Window" in plan.children().head().toString():
        plan = plan.children().head()
    steps = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().head()).count()
    assert steps == 10 + 25 + 25  # questions of rows that are kept, arrivals within a window, and its ends
    assert "decimal" not in plan.toString()


@pytest.mark.parametrize("block", [1, 13])
def test_history_of_large_groups(spark, monkeypatch, block):
    rows = spark.createDataFrame(made(3, 350), COLUMNS)
    whole = sorted(map(str, with_history(rows, FEATURES, "at", "seen", block).collect()))
    monkeypatch.setattr(history, "GROUP", 100)  # of three groups one is large
    assert whole == sorted(map(str, with_history(rows, FEATURES, "at", "seen", block).collect()))
    monkeypatch.setattr(history, "GROUP", 0)
    assert whole == sorted(map(str, with_history(rows, FEATURES, "at", "seen", block).collect()))


@pytest.mark.parametrize("block", [1, 13])
def test_history_sees_only_what_had_arrived(spark, block):
    rows = made(3, 350)
    rows += rows[:5]
    got = with_history(spark.createDataFrame(rows, COLUMNS), FEATURES, "at", "seen", block).collect()
    assert len(got) == len(rows)
    for f in FEATURES:
        want = plain(rows, f)
        for r in got:
            assert r[f.out] == (None if want[r["id"]] is None else pytest.approx(want[r["id"]])), (f, r)


def test_history_of_nothing_and_clashing_names(spark):
    rows = spark.createDataFrame(made(1, 20), COLUMNS)
    assert with_history(rows.limit(0), FEATURES, "at", "seen").collect() == []
    odd = rows.withColumnsRenamed({"k": "g", "v": "event", "w": "block"})
    one = with_history(odd, [RowDerive("n", "rolling_count", "", "event", ("g",), 7)], "at", "seen")
    assert one.columns == [*odd.columns, "n"] and one.count() == 20
    with pytest.raises(ValueError, match="has a column 'w'"):
        with_history(rows, [RowDerive("w", "last_value", "", "v")], "at")


def test_row_derives_in_a_spec(spark):
    rows = spark.createDataFrame(made(5, 120), COLUMNS)
    spec = {
        "time_from": "at", "available_from": "seen", "keys": [{"name": "t", "via": "bin:month"}],
        "derives": [{"name": "recent", "scope": "row", "via": "rolling_count", "of": "v", "by": "k", "days": 7}],
        "aggregates": [{"name": "most", "using": "max", "of": "recent"}, {"name": "n", "using": "count"}],
        "filters": [{"of": "k", "using": "equals", "value": "hot"}],
    }
    f = build(rows, spec)
    counts = plain(made(5, 120), RowDerive("recent", "rolling_count", "", "v", ("k",), 7))
    want = {}
    for i, k, at, *_ in made(5, 120):
        if k == "hot" and at is not None:
            want[at.strftime("%Y-%m")] = max(want.get(at.strftime("%Y-%m"), 0.0), counts[i])
    assert f.df.columns == ["t", "most", "n"] and {r["t"]: r["most"] for r in f.df.collect()} == want
    for more, words in (({"days": 0}, "needs 'days'"), ({"via": "lead"}, "unknown 'lead'"), ({"of": ""}, "needs 'of'")):
        with pytest.raises(ValueError, match=words):
            resolve(spec | {"derives": [spec["derives"][0] | more]})


LATE = {
    "time_from": "at", "available_from": "seen",
    "keys": [{"name": "k", "from": "k"}, {"name": "t", "via": "bin:day"}],
    "aggregates": [{"name": "r", "using": "rms_test", "of": "x", "availability": "past_only"}, {"name": "w", "using": "weighted_test", "of": "x", "by": "w"}, {"name": "m", "using": "mean", "of": "x"}, {"name": "n", "using": "count"}],
}


def sane(spark, seed, n):
    return spark.createDataFrame(made(seed, n), COLUMNS).withColumn("x", F.when(F.abs("v") < 1e22, F.col("v")))


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=str), sorted(map(tuple, want), key=str), strict=True):
        assert [pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in a] == list(b)


def test_registered_aggregates_and_merged_states(spark):
    rows = sane(spark, 9, 400)
    whole = build(rows, LATE).df.collect()
    first, second = (states(rows.where(F.col("id") % 2 == i), LATE) for i in (0, 1))
    close(merged(first.unionByName(second), LATE).collect(), whole)
    monthly = LATE | {"keys": [LATE["keys"][0], {"name": "t", "via": "bin:month"}], "aggregates": LATE["aggregates"][1:]}
    daily = LATE | {"aggregates": LATE["aggregates"][1:]}
    close(merged(states(rows, daily), daily, "month").collect(), build(rows, monthly).df.collect())
    moved = {}
    for _, k, at, seen, v, _ in made(9, 400):
        if at is not None and v is not None and abs(v) < 1e22:
            moved.setdefault(((k or ""), max(at, seen or at).strftime("%Y-%m-%d")), []).append(v * v)
    want = {g: round(math.sqrt(sum(q) / len(q)), 6) for g, q in moved.items()}
    assert {(r["k"], r["t"]): pytest.approx(r["r"], abs=2e-6) for r in whole if r["r"] is not None} == want
    for bad in ({"aggregates": [{"name": "h", "using": "hhi", "of": "x", "by": "w"}]},):
        with pytest.raises(ValueError, match="can't be merged"):
            states(rows, LATE | bad)
    with pytest.raises(ValueError, match="don't nest"):
        merged(first, LATE | {"keys": [{"name": "t", "via": "bin:week"}]}, "month")
    with pytest.raises(ValueError, match="name of its own"):
        registered.register_aggregate("sum", RMS)


class Alarm:
    """On from a value over ``high`` until one under ``low``."""

    @staticmethod
    def analyze(rows, column, low, high):
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("on", BooleanType())]))

    def __init__(self):
        self.on = False

    def eval(self, row, column, low, high):
        v = row[column]
        if v is not None:
            self.on = v > high or (self.on and v >= low)
        yield *row, self.on


def test_table_function(spark):
    registered.register_table_function("alarm_test", Alarm, replace=True)
    rows = spark.createDataFrame([(k, i, v) for k in "ab" for i, v in enumerate((1.0, 9.0, None, 5.0, 2.0, 6.0))], "k string, i int, v double")
    got = registered.through(rows, "alarm_test", ["k"], ["i"], column="v", low=3.0, high=8.0).orderBy("k", "i").collect()
    assert [r["on"] for r in got] == [False, True, True, True, False, False] * 2
    with pytest.raises(ValueError, match="unknown 'none'"):
        registered.through(rows, "none", ["k"], ["i"])


def streamed(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("grain", ["day", "month", "quarter"])
def test_late_values_on_a_stream(spark, tmp_path, grain):
    sane(spark, 11, 200).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    spec = LATE | {"keys": [LATE["keys"][0], {"name": "t", "via": f"bin:{grain}"}]}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    close(streamed(spark, stream_frame(stream, spec), f"late_{grain}", "complete"), build(rows, spec).df.collect())


def test_two_streams_are_aligned_and_closed(spark, tmp_path):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    for name, step, shift in (("o", 1, 0), ("l", 3, 40)):
        for half, part in enumerate((days[:45], days[45:])):
            spark.createDataFrame([(d + dt.timedelta(days=shift), float(i)) for i, d in enumerate(part[::step])], f"{name}_at timestamp, {name}_v double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    spec = {"sources": [{"id": "o", "time_from": "o_at"}, {"id": "l", "time_from": "l_at"}], "keys": [{"name": "t", "via": "bin:month"}], "aggregates": [{"name": "a", "using": "sum", "of": "o.o_v"}, {"name": "b", "using": "sum", "of": "l.l_v"}]}
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("o", "l")}
    streams = {n: spark.readStream.schema(t.schema).parquet(str(tmp_path / n)) for n, t in tables.items()}
    want = build(tables, spec).df.collect()
    close(streamed(spark, stream_frame(streams, spec, {"o": "1 day", "l": "3 days"}), "aligned", "complete"), want)
    closed = streamed(spark, stream_frame(streams, spec, {"o": "1 day", "l": "3 days"}), "aligned_closed", "append")
    assert 0 < len(closed) < len(want) and {tuple(r) for r in closed} <= {tuple(r) for r in want}
    with pytest.raises(ValueError, match="late: needed by l"):
        stream_frame(streams, spec, {"o": "1 day"})
