"""Dashboard time-series expressions over a metrics table.

Input: ``(ts, instance, datname, metric, value)``; a *series* is one
combination of the three labels.  Each expression of the monitoring
dashboard becomes a DataFrame function:

* R01 instant lookup with label matchers (``=`` exact, ``=~`` anchored regex),
* R02 value filter, R03 scalar multiply,
* R04 ``rate(x[w])``: reset-corrected increase of a counter over the
  trailing window ``(t - w, t]`` divided by the time between the first
  and last sample in that window.  Unlike the original metrics system
  there is **no extrapolation** to the window edges;
* R05 ``irate(x[w])``: the same from the last two samples only, provided
  they are less than ``w`` apart,
* R06 ``avg(...)`` across series per evaluation step,
* R07 ratio of two metrics on matching labels per step,
* R08 label listing for dashboard selectors.

``*_at_steps`` evaluate on a step grid, as the dashboard's range queries do.

Rates are differences of prefix sums in two levels: the increase inside
small fixed time buckets, and one carried sum per series and bucket.  No
window partition holds more than the samples of one bucket, or one row per
bucket of a series; samples of one time are aggregated before any shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["instance", "datname", "metric"]
US = 1_000_000


def _matches(col: str, op: str, value: str) -> Column:
    c = F.col(col)
    if op == "=":
        return c == value
    if op == "!=":
        return c != value
    if op == "=~":
        return c.rlike(f"^(?:{value})$")
    if op == "!~":
        return ~c.rlike(f"^(?:{value})$")
    raise ValueError(op)


def select_series(metrics: DataFrame, metric: str | None = None, matchers: dict | None = None) -> DataFrame:
    """Series selector ``metric{label op value, ...}``."""
    df = metrics
    if metric is not None:
        df = df.filter(F.col("metric") == metric)
    for label, (op, value) in (matchers or {}).items():
        df = df.filter(_matches(label, op, value))
    return df


def latest_samples(metrics: DataFrame, metric: str | None = None, matchers: dict | None = None,
                   as_of: _dt.datetime | None = None, lookback_seconds: int | None = None) -> DataFrame:
    """Latest sample per matching series (at or before ``as_of``).

    With ``lookback_seconds`` only samples newer than ``as_of - lookback``
    count (an instant query's staleness window; series without one drop
    out).  ``max`` over a (ts, value) struct picks the newest sample and
    breaks exact time ties by value, so the answer is deterministic; it is
    a partial aggregate, so a busy series collapses map-side.
    """
    df = select_series(metrics, metric, matchers)
    if as_of is not None:
        df = df.filter(F.col("ts") <= F.lit(as_of))
        if lookback_seconds is not None:
            df = df.filter(F.col("ts") > F.lit(as_of - _dt.timedelta(seconds=lookback_seconds)))
    g = df.groupBy(*SERIES).agg(F.max(F.struct("ts", "value")).alias("last"))
    return g.select(*SERIES, F.col("last.ts").alias("ts"), F.col("last.value").alias("value"))


def nonzero_values(df: DataFrame, col: str = "value") -> DataFrame:
    """``expr != 0`` (drops zero samples)."""
    return df.filter(F.col(col) != 0)


def scale_values(df: DataFrame, factor, col: str = "value") -> DataFrame:
    """``expr * factor``."""
    return df.withColumn(col, F.col(col) * F.lit(factor))


def _increase(before: Column, after: Column) -> Column:
    """Reset-corrected growth of a counter: a lower value counts as a restart from zero."""
    return F.when(after >= before, after - before).otherwise(after)


def _bucket_us(window_seconds: int, bucket_seconds: int | None) -> int:
    return (bucket_seconds or max(1, window_seconds // 64)) * US


def _points(df: DataFrame, bucket_us: int) -> DataFrame:
    """One row per series and time: lowest and highest value, number of samples, time bucket."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return (df.groupBy(*SERIES, "ts").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
            .withColumn("t_us", t).withColumn("bucket", F.floor(F.col("t_us") / F.lit(bucket_us)).cast("bigint")))


def _summed(points: DataFrame) -> DataFrame:
    """First level: running increase inside each bucket, from the bucket's first value on.

    ``step``: growth since the point before in the bucket (NULL for the first); ``run``: growth up to this point's
    highest value; ``prev_t``: time of the point before in the bucket.
    """
    w = Window.partitionBy(*SERIES, "bucket").orderBy("t_us")
    x = points.withColumn("step", F.when(F.lag("hi").over(w).isNotNull(), _increase(F.lag("hi").over(w), F.col("lo"))))
    run = F.sum(F.coalesce("step", F.lit(0)) + F.col("hi") - F.col("lo")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("prev_t", F.lag("t_us").over(w)).withColumn("run", run)


def _carried(x: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Second level, one row per series and bucket: what earlier buckets hand on.

    ``base``: increase of the series up to the bucket's first value; ``border``: the part of it since the bucket
    before; ``last``: that bucket's last point; ``next``: time and increase of the first point of a later bucket.
    ``asked`` adds buckets without samples of their own.
    """
    rows = x.groupBy(*SERIES, "bucket").agg(F.min(F.struct("t_us", "lo")).alias("first"), F.max(F.struct("t_us", "hi")).alias("end"),
                                            F.max(F.struct("t_us", "run"))["run"].alias("total"))
    if asked is not None:
        rows = rows.unionByName(asked.select(*SERIES, "bucket").distinct(), allowMissingColumns=True)
        rows = rows.groupBy(*SERIES, "bucket").agg(F.max("first").alias("first"), F.max("end").alias("end"), F.max("total").alias("total"))
    w = Window.partitionBy(*SERIES).orderBy("bucket")
    rows = rows.withColumn("last", F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    border = F.when(F.col("first").isNotNull() & F.col("last").isNotNull(), _increase(F.col("last.hi"), F.col("first.lo")))
    rows = rows.withColumn("border", border)
    grown = F.coalesce("total", F.lit(0)) + F.coalesce("border", F.lit(0))
    rows = rows.withColumn("base", F.sum(grown).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce("total", F.lit(0)))
    start = F.when(F.col("first").isNotNull(), F.struct(F.col("first.t_us").alias("t"), F.col("base").alias("c")))
    # from the last bucket backwards: a frame that grows by one row a step, not one that is read anew for every row
    back = Window.partitionBy(*SERIES).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*SERIES, "bucket", "base", "border", "last", F.last(start, ignorenulls=True).over(back).alias("next"))


def _opens(rows: DataFrame, at: str, window_us: int, bucket_us: int) -> DataFrame:
    """The window starts of evaluation times: (series, sample_t, at, bucket); the window holds samples from ``at`` on."""
    opens = rows.select(*SERIES, F.col(at).alias("sample_t"), (F.col(at) - F.lit(window_us - 1)).alias("at"))
    return opens.withColumn("bucket", F.floor(F.col("at") / F.lit(bucket_us)).cast("bigint"))


def _begins(x: DataFrame, starts: DataFrame, carried: DataFrame) -> DataFrame:
    """Time and prefix sum of the first sample at or after each window start."""
    inner = F.col("hi") - F.col("lo")
    marks = x.select(*SERIES, "bucket", F.col("t_us").alias("at"), F.struct(F.col("t_us").alias("t"), (F.col("run") - inner).alias("c")).alias("mark"))
    both = marks.unionByName(starts, allowMissingColumns=True)
    # backwards in time, at one time samples before window starts: the last mark met is the next sample
    w = Window.partitionBy(*SERIES, "bucket").orderBy(F.col("at").desc(), F.col("sample_t").asc_nulls_first())
    found = both.withColumn("found", F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where("sample_t is not null").join(carried, [*SERIES, "bucket"])
    return found.select(*SERIES, "sample_t", F.coalesce("found.t", "next.t").alias("begin_t"),
                        F.coalesce(F.col("base") + F.col("found.c"), F.col("next.c")).alias("begin_c"))


def _per_second(end_t: str) -> Column:
    span = F.col(end_t) - F.col("begin_t")
    return F.when(span > 0, (F.col("c") - F.col("begin_c")).cast("double") / (span.cast("double") / F.lit(float(US))))


def rate(metrics: DataFrame, window_seconds: int = 300, metric: str | None = None, matchers: dict | None = None,
         bucket_seconds: int | None = None) -> DataFrame:
    """Per-second reset-corrected increase over the trailing window, at every sample.

    NULL when the window spans no time (one sample, or samples of one time only).  Samples of one time are ordered
    by value.  The increase is a difference of two prefix sums, so a task holds the samples of one small bucket (and
    the window starts that fall into it), however long the window or dense the series is.
    """
    wus, bus = window_seconds * US, _bucket_us(window_seconds, bucket_seconds)
    x = _summed(_points(select_series(metrics, metric, matchers), bus))
    starts = _opens(x, "t_us", wus, bus)
    carried = _carried(x, starts)
    begin = _begins(x, starts, carried).withColumnRenamed("sample_t", "t_us")
    ends = x.join(carried.select(*SERIES, "bucket", "base"), [*SERIES, "bucket"]).select(
        *SERIES, "ts", "t_us", "n", (F.col("base") + F.col("run")).alias("c"))
    j = ends.join(begin, [*SERIES, "t_us"])
    return j.select(*SERIES, "ts", _per_second("t_us").alias("rate"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")


def _grid(start: _dt.datetime, end: _dt.datetime) -> tuple[int, int]:
    """The ends of an evaluation grid in microseconds (naive times are UTC)."""
    us = [int((t.replace(tzinfo=None) - _dt.datetime(1970, 1, 1)) / _dt.timedelta(microseconds=1)) for t in (start, end)]
    if us[1] < us[0]:
        raise ValueError("the grid ends before it starts")
    return us[0], us[1]


def _on_grid(rows: DataFrame, value: str, grid: tuple[int, int], step_us: int, lookback_us: int) -> DataFrame:
    """As-of join of samples (series, t_us, ``value``) to a step grid: (series, step_us, t_us, ``value``).

    A step takes the latest sample of the ``lookback`` before it (the step itself included).  Samples are reduced to the
    latest one per step slot, so every sample answers for the steps up to the next slot with one or until it is stale.
    Slots meet in chunks at least as long as the look-back, a slot that reaches beyond its chunk stands in the next one,
    too: work is linear in samples and steps, and no task holds a whole series.
    """
    start, end = grid
    chunk = max(256, lookback_us // step_us + 1)
    slot = F.greatest(F.lit(0), F.expr(f"(t_us - {start} + {step_us - 1}) div {step_us}")).cast("bigint")
    held = rows.where((F.col("t_us") > start - lookback_us) & (F.col("t_us") <= end)).withColumn("slot", slot)
    held = held.groupBy(*SERIES, "slot").agg(F.max(F.struct("t_us", value)).alias("s"))
    stale = F.expr(f"(s.t_us + {lookback_us - 1 - start}) div {step_us}")
    held = held.withColumn("last", F.least(stale, F.lit((end - start) // step_us)).cast("bigint")).where("slot <= last")
    held = held.withColumn("chunk", F.explode(F.expr(f"sequence(slot div {chunk}, last div {chunk})")))
    after = F.lead("slot").over(Window.partitionBy(*SERIES, "chunk").orderBy("slot"))
    first = F.greatest(F.col("slot"), F.col("chunk") * chunk)
    last = F.least(F.col("last"), F.coalesce(after - 1, F.col("last")), (F.col("chunk") + 1) * chunk - 1)
    spans = held.select(*SERIES, "s", first.alias("a"), last.alias("b")).where("a <= b")
    steps = spans.select(*SERIES, "s", F.explode(F.sequence("a", "b")).alias("k"))
    return steps.select(*SERIES, (F.col("k") * step_us + start).alias("step_us"), "s.t_us", f"s.{value}")


def _step_ts() -> Column:
    return F.timestamp_micros("step_us").cast("timestamp_ntz").alias("step_ts")


def latest_at_steps(metrics: DataFrame, start: _dt.datetime, end: _dt.datetime, step_seconds: int = 15, lookback_seconds: int = 300,
                    metric: str | None = None, matchers: dict | None = None) -> DataFrame:
    """R01 as a range query: at every step from ``start`` to ``end`` the latest sample of each series that is not stale.

    A series without a sample in the look-back has no row at that step; samples of one time give their highest value.
    """
    rows = select_series(metrics, metric, matchers).withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp")))
    on = _on_grid(rows, "value", _grid(start, end), step_seconds * US, lookback_seconds * US)
    return on.select(*SERIES, _step_ts(), F.timestamp_micros("t_us").cast("timestamp_ntz").alias("ts"), "value")


def rate_at_steps(metrics: DataFrame, start: _dt.datetime, end: _dt.datetime, step_seconds: int = 15, window_seconds: int = 300,
                  metric: str | None = None, matchers: dict | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """R04 as a range query: the rate over the window that ends at each step; no row where the window has no sample.

    NULL when the window's samples have one time only.
    """
    wus, bus = window_seconds * US, _bucket_us(window_seconds, bucket_seconds)
    x = _summed(_points(select_series(metrics, metric, matchers), bus))
    sums = x.join(_carried(x).select(*SERIES, "bucket", "base"), [*SERIES, "bucket"])
    sums = sums.select(*SERIES, "t_us", (F.col("base") + F.col("run")).alias("c"))
    ends = _on_grid(sums, "c", _grid(start, end), step_seconds * US, wus)
    starts = _opens(ends, "step_us", wus, bus)
    begin = _begins(x, starts, _carried(x, starts)).withColumnRenamed("sample_t", "step_us")
    return ends.join(begin, [*SERIES, "step_us"]).select(*SERIES, _step_ts(), _per_second("t_us").alias("rate"))


def avg_at_steps(evaluated: DataFrame, value_col: str, digits: int = 6) -> DataFrame:
    """R06 as a range query: the average across series at every step that has a value."""
    g = evaluated.where(F.col(value_col).isNotNull()).groupBy("step_ts").agg(F.avg(value_col).alias("v"), F.count(F.lit(1)).alias("series"))
    return g.select("step_ts", F.round("v", digits).alias(f"avg_{value_col}"), "series")


def irate(metrics: DataFrame, window_seconds: int = 300, metric: str | None = None, matchers: dict | None = None,
          bucket_seconds: int | None = None) -> DataFrame:
    """Rate from the last two samples, if they are less than the window apart; NULL if they have one time."""
    wus, bus = window_seconds * US, _bucket_us(window_seconds, bucket_seconds)
    x = _summed(_points(select_series(metrics, metric, matchers), bus))
    x = x.join(_carried(x), [*SERIES, "bucket"])
    growth, gap = F.coalesce("step", "border"), F.col("t_us") - F.coalesce(F.col("prev_t"), F.col("last.t_us"))
    r = F.when(gap < wus, growth.cast("double") / (gap.cast("double") / F.lit(float(US))))
    rows = x.select(*SERIES, "ts", r.alias("r"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return rows.select(*SERIES, "ts", F.when(F.col("i") == 1, F.col("r")).alias("irate"))


def avg_by_step(samples: DataFrame, value_col: str, step_seconds: int = 15, digits: int = 6) -> DataFrame:
    """``avg(expr)`` across series at each step (latest value of each series in the step).

    Averages of inexact doubles depend on summation order, so the result
    is rounded to ``digits`` places.
    """
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_seconds * US)).cast("bigint")
    per_series = (samples.filter(F.col(value_col).isNotNull())
                  .groupBy(*SERIES, step.alias("step"))
                  .agg(F.max(F.struct("ts", value_col)).alias("last")))
    g = per_series.groupBy("step").agg(F.avg(F.col(f"last.{value_col}")).alias("avg_value"),
                                        F.count(F.lit(1)).alias("series"))
    return g.select(F.timestamp_micros(F.col("step") * step_seconds * US).cast("timestamp_ntz").alias("step_ts"),
                    F.round("avg_value", digits).alias(f"avg_{value_col}"), "series")


def metric_ratio(metrics: DataFrame, numerator: str, other: str, step_seconds: int = 15,
                 matchers: dict | None = None) -> DataFrame:
    """``a / (a + b)`` for two metrics on matching (instance, datname) per step.

    Each side is the latest sample of its metric in the step; zero-safe.
    """
    df = select_series(metrics, None, matchers).filter(F.col("metric").isin(numerator, other))
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_seconds * US)).cast("bigint")
    last = (df.groupBy("instance", "datname", step.alias("step"))
            .agg(F.max(F.when(F.col("metric") == numerator, F.struct("ts", "value"))).alias("a"),
                 F.max(F.when(F.col("metric") == other, F.struct("ts", "value"))).alias("b")))
    a = F.col("a.value").cast("double")
    b = F.col("b.value").cast("double")
    ratio = F.when((a + b) != 0, a / (a + b))
    return (last.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .select("instance", "datname", F.timestamp_micros(F.col("step") * step_seconds * US).cast("timestamp_ntz").alias("step_ts"),
                    ratio.alias("ratio")))


def label_values(metrics: DataFrame, label: str, metric_regex: str | None = None,
                 matchers: dict | None = None) -> DataFrame:
    """Distinct values of one label over the matching series, sorted.

    ``metric_regex`` restricts the metric name (anchored); ``matchers``
    restrict any label (``{"datname": ("=~", "db.*")}``), as a selector does.
    """
    df = select_series(metrics, None, matchers)
    if metric_regex is not None:
        df = df.filter(_matches("metric", "=~", metric_regex))
    return df.select(label).distinct().orderBy(label)


def reporting_series(metrics: DataFrame, as_of: _dt.datetime, lookback_seconds: int = 300) -> DataFrame:
    """Series whose latest sample lies within ``lookback`` before ``as_of`` (currently reporting)."""
    last = latest_samples(metrics, as_of=as_of)
    since = F.lit(as_of).cast("timestamp") - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                                                             F.lit(0), F.lit(lookback_seconds))
    return last.filter(F.col("ts") > since).select(*SERIES, "ts")
