"""A frame over streams: calendar buckets, keys, filters, plain reductions, late values moved forward, several sources."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import coerce, dates, registered
from tallyframe.functions.scratch import free_names, shared_dir
from tallyframe.operators.frame import _DROP, _aggregate, _copies, _prepared
from tallyframe.plans.spec import Spec, resolve

#: The most days a bucket has.
_LONGEST = {"day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}
_FUNCTIONS = ("sum", "mean", "min", "max", "count")


def _refused(rows: DataFrame | dict[str, DataFrame], s: Spec) -> list[str]:
    """What of a spec a stream can't do."""
    found = []
    if s.spine is None:
        found.append("a frame without a time spine, whose state would never end")
    if len(s.sources) > 1 and not isinstance(rows, dict) and not s.source_from:
        found.append("several sources in one stream without source_from")
    if len(s.sources) > 1 and any(k.source is not None for k in s.keys):
        found.append("keys that one source has and others lack, which need a join of frames")
    if s.order_by or any(k.returns == "position" for k in s.keys):
        found.append("an order of rows")
    if s.row_derives:
        found.append("derives of rows from rows before them")
    found += [f"{m.function} ({m.out})" for m in s.measures if m.function not in _FUNCTIONS and m.function not in registered.AGGREGATES]
    return found


def stream_frame(rows: DataFrame | dict[str, DataFrame], document: dict | Spec, late: str | dict[str, str] = "2 days") -> DataFrame:
    """The frame that ``build`` gives of the same rows, over a stream or over streams by source id.

    A bucket stays open until the newest buckets of all streams are ``late`` (by source, if it is a dict) and
    the longest bucket's length ahead of it: values at most ``late`` behind are counted, what comes for a closed
    bucket is dropped, and its state is let go. Each source has a watermark of its own and the slowest rules.
    A late ``past_only`` value moves to the bucket of its arrival, as in a batch, and so is never late itself;
    ``late`` must cover the delay of values that stay where they happened. Filters, aliases, binned keys, derives and the
    rule that a bucket needs a value hold as in a batch; whatever a stream can't do is an error.
    """
    s = document if isinstance(document, Spec) else resolve(document)
    if found := _refused(rows, s):
        raise ValueError(f"not on a stream: {'; '.join(found)}")
    spine, at = s.spine, next(f"__k{i}" for i, k in enumerate(s.keys) if k.spine)
    delays = late if isinstance(late, dict) else dict.fromkeys((x.id for x in s.sources), late)
    if missing := [x.id for x in s.sources if x.id not in delays]:
        raise ValueError(f"late: needed by {', '.join(missing)}")

    def part(df: DataFrame, source: str | None) -> DataFrame:
        (tag,) = free_names(df, "source")
        tagged = df.withColumn(tag, coerce.text(coerce.cell(df, s.source_from)) if source is None else F.lit(source))
        kept = _copies(_prepared(tagged, s, tag).where(F.col(_DROP).isNull()), s)
        some = reduce(lambda a, b: a | b, (F.col(f"__v_{m.out}").isNotNull() for m in s.measures))
        kept = kept.where(some)  # what adds nothing neither opens a bucket nor moves the watermark
        delay = f"{_LONGEST[spine.grain]} days {max(delays.values(), key=_seconds) if source is None else delays[source]}"
        end = dates.next_start(spine.grain, F.col(at), 1).cast("timestamp")
        return kept.withColumn("__end", end).withWatermark("__end", delay)

    if isinstance(rows, dict):
        parts = [part(rows[x.id], x.id) for x in s.sources if x.id in rows]
    else:
        parts = [part(rows, None if s.source_from else s.sources[0].id)]
    kept = reduce(lambda a, b: a.unionByName(b), parts)
    keys = [f"__k{i}" for i in range(len(s.keys))]
    grouped = kept.groupBy("__end", *keys).agg(*(_aggregate(m, False).alias(f"__m_{m.out}") for m in s.measures))
    found = grouped.where(F.coalesce(*(F.col(f"__m_{m.out}") for m in s.measures)).isNotNull())
    labels = [(dates.bucket_label(k.grain, F.col(c)) if k.returns == "bucket" else F.col(c)).alias(k.name) for k, c in zip(s.keys, keys, strict=True)]
    values = [F.round(f"__m_{m.out}", 6).alias(m.out) for m in s.measures]
    scalars = [dates.SCALARS[d.via](F.col(keys[d.key])).alias(d.out) for d in s.derives]
    return found.select(*labels, *values, *scalars)


def _seconds(delay: str) -> float:
    """Length of a delay such as ``2 days`` or ``36 hours``, to compare delays by."""
    number, unit = delay.split()[:2]
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def snapshot(stream: DataFrame, label: str) -> DataFrame:
    """What a streamed frame says of all that is there now, as a table in the shared folder; each micro-batch writes a whole one."""
    spark, place = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/tallyframe/{label}-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/{number}")
        last[:] = [number]

    running = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{place}/{last[0]}")
