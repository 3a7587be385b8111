"""Price panels: gap filling, means, coverage, gradients, dispersion.

Frames have (station_code, price_date, decicents) unless a docstring says otherwise. Windows are partitioned by
station, or run over series with a row a day; none runs over the whole panel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import blocks
from tidewell.operators.storage import stored


def by_station():
    """Rows of a station in the order of days."""
    return Window.partitionBy("station_code").orderBy("price_date")


def spans(prices: DataFrame, end: DataFrame | None = None, max_gap: int = 28) -> DataFrame:
    """(station_code, price_date, last_day, decicents): each price with the last day that gap_fill carries it to."""
    nxt = F.lead("price_date").over(by_station())
    rows = prices.withColumn("next_date", nxt)
    stop = F.when(F.datediff("next_date", "price_date") <= max_gap, F.date_sub("next_date", 1))
    if end is not None:
        last = end.select(F.col(end.columns[0])).scalar()
        stop = F.when(F.col("next_date").isNotNull(), stop).when(F.datediff(last, "price_date").between(0, max_gap), last)
    return rows.select("station_code", "price_date", F.coalesce(stop, "price_date").alias("last_day"), "decicents")


def gap_fill(prices: DataFrame, end: DataFrame | None = None, max_gap: int = 28) -> DataFrame:
    """A row a day from each price to the day before the next one, where these are `max_gap` days apart at most.

    end has one row and column with the day up to which the last price is carried, under the same limit.
    """
    return filled(spans(prices, end, max_gap))


def filled(spans: DataFrame) -> DataFrame:
    """(station_code, price_date, decicents): a row for each day of each span."""
    days = F.sequence("price_date", "last_day")
    return spans.withColumn("stop", days).select("station_code", F.explode("stop").alias("price_date"), "decicents")


def filled_delta(prices: DataFrame, days: int, end: DataFrame | None = None, max_gap: int = 28, name: str = "delta") -> DataFrame:
    """(station_code, price_date, `name`): calendar_delta of the filled panel by station, with prices of one row a station and day.

    A day `days` days before is in the price's own span or in one of the `days` spans before it, as each has a day or more.
    So the spans are sorted, not the days that they are filled with.
    """
    w, day = by_station(), F.col("price_date")
    before = [F.struct(*[F.lag(c, k).over(w).alias(c) for c in ("price_date", "last_day", "decicents")]).alias(f"_before{k}") for k in range(1, days + 1)]
    filled = spans(prices, end, max_gap).select("station_code", F.col("price_date").alias("_first"), "last_day", "decicents", *before)
    filled = filled.withColumn("_days", F.sequence("_first", "last_day")).select("*", F.explode("_days").alias("price_date"))
    past = F.date_sub(day, days)
    then = F.when(past >= F.col("_first"), F.col("decicents"))
    for k in range(1, days + 1):
        span = F.col(f"_before{k}")
        then = then.when(past.between(span["price_date"], span["last_day"]), span["decicents"])
    return filled.select("station_code", "price_date", (F.col("decicents") - then).alias(name))


def gap_fill_between(prices: DataFrame, first: str, last: str, end: DataFrame | None = None, max_gap: int = 28) -> DataFrame:
    """The filled rows of the days from `first` to `last`, from the prices within `max_gap` days of them."""
    low, high = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    near = prices.where(F.col("price_date").between(F.date_sub(low, max_gap), F.date_add(high, max_gap)))
    return gap_fill(near, end, max_gap).where(F.col("price_date").between(low, high))


def gap_fill_since(prices: DataFrame, since: str, end: DataFrame | None = None, max_gap: int = 28) -> DataFrame:
    """The filled rows from `since` on; each station's fill starts at its last price at or before that day."""
    day = F.to_date(F.lit(since))
    anchors = prices.where(F.col("price_date") <= day).groupBy("station_code").agg(F.max("price_date").alias("anchor"))
    recent = prices.join(anchors, "station_code", "left").where(F.col("anchor").isNull() | (F.col("price_date") >= F.col("anchor")))
    return gap_fill(recent.select(prices.columns), end, max_gap).where(F.col("price_date") >= day)


def mean_price(daily: DataFrame, *by: str, least: int = 1, name: str = "price") -> DataFrame:
    """Mean price in cents by day and `by`; groups of fewer than `least` rows are left out."""
    means = daily.groupBy("price_date", *by).agg((F.avg("decicents") / 10).alias(name), F.count(F.lit(1)).alias("n"))
    return (means.where(F.col("n") >= least) if least > 1 else means).drop("n")


def sums(daily: DataFrame, by: str, least: int = 3) -> DataFrame:
    return daily.groupBy("price_date", by).agg(F.sum("decicents").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def leave_one_out(daily: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Mean of all other groups' prices, for each day and group: the day's total less the group's own.

    A group has an anchor on days without a row of its own too. The groups are few (councils, brands): their names go
    to each day as one array; days times groups are the rows.
    """
    own = stored(daily.groupBy("price_date", by).agg(F.sum("decicents").alias("own"), F.count(F.lit(1)).alias("n")), "group-sums")  # read three times
    names = own.agg(F.collect_set(by).alias("names")).scalar()
    day = own.groupBy("price_date").agg(F.sum("own").alias("all"), F.sum("n").alias("rows")).select("*", F.explode(names).alias(by))
    others = F.col("rows") - F.coalesce("n", F.lit(0))
    rest = day.join(own, ["price_date", by], "left").select("price_date", by, (F.col("all") - F.coalesce("own", F.lit(0))).alias("rest"), others.alias("others"))
    return rest.where(F.col("others") >= least).select("price_date", by, (F.col("rest") / F.col("others") / 10).alias("anchor_price"))


def gradient(series: DataFrame, value: str, order: str = "price_date", by: tuple[str, ...] = (), name: str = "gradient") -> DataFrame:
    """Central difference by position, one-sided at the ends; null for a series of one row."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return series.withColumn(name, F.coalesce((after - before) / 2, after - here, here - before))


def coverage(daily: DataFrame) -> DataFrame:
    """Days with a price by station and month."""
    return daily.groupBy("station_code", F.date_format("price_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"))


def rolling_percentile(value: str | Column, p: float, window) -> Column:
    return F.percentile(value, F.lit(p)).over(window)


def usual_price(daily: DataFrame, days: int) -> DataFrame:
    """daily's (station_code, price_date, decicents) with `usual`, the median in cents of the `days` calendar days before; null for none.

    Frames are sorted by numpy, many stations at a time: a window that works each one out anew makes `days` times as much.
    """
    def work(t: pa.Table, at: np.ndarray) -> pa.Table:
        low = blocks.since(blocks.numbers(t, "price_date"), at, days)
        return t.append_column("usual", pa.array(blocks.moving_percentile(blocks.numbers(t, "decicents"), low, days, 0.5, 10.0), from_pandas=True))

    rows, kind = daily.select("station_code", "price_date", "decicents"), dict(daily.dtypes)
    return blocks.in_blocks(rows, ["station_code"], ["price_date"], work, f"station_code {kind['station_code']}, price_date date, decicents {kind['decicents']}, usual double")


def days_window(*by: str, start: int, end: int, order: str = "price_date"):
    """A frame of calendar days relative to the row's."""
    return Window.partitionBy(*by).orderBy(F.unix_date(F.col(order))).rangeBetween(start, end)


def calendar_delta(series: DataFrame, value: str, days: int, by: tuple[str, ...] = (), order: str = "price_date") -> Column:
    """The value less that of exactly `days` days before; null if that day isn't there."""
    return F.col(value) - F.max(value).over(days_window(*by, start=-days, end=-days, order=order))


def resample(series: DataFrame, day: str, value: str) -> DataFrame:
    """A gappy series as one row a day, the last value carried on."""
    w = Window.partitionBy().orderBy(day)
    rows = series.where(F.col(value).isNotNull()).withColumn("_next", F.lead(day).over(w))
    return rows.select(F.explode(F.sequence(F.col(day), F.coalesce(F.date_sub("_next", 1), F.col(day)))).alias(day), value)


def lagged_delta(series: DataFrame, day: str, value: str, days: int, name: str) -> DataFrame:
    """Change over `days` days of the resampled series as it stood the day before, so that no row uses its own day's value."""
    w = Window.partitionBy().orderBy(day)
    shifted = resample(series, day, value).withColumn("_known", F.lag(value).over(w))
    return shifted.select(day, (F.col("_known") - F.lag("_known", days).over(w)).alias(name))


def dispersion(panel: DataFrame, least: int = 2) -> DataFrame:
    return panel.groupBy("price_date").agg(F.stddev_samp(F.col("decicents") / 10).alias("px_std"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def islands(series: DataFrame, flag: str, by: tuple[str, ...] = (), order: str = "price_date", name: str = "run") -> DataFrame:
    """Length, so far, of the present run of rows where the flag holds; zero elsewhere."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = series.withColumn("_island", F.sum((~F.col(flag)).cast("int")).over(w))
    inside = Window.partitionBy(*by, "_island").orderBy(order)
    return marked.withColumn(name, F.sum(F.col(flag).cast("int")).over(inside)).drop("_island")


def presence_since(series: DataFrame, event: str, by: tuple[str, ...] = (), order: str = "price_date", name: str = "days_since") -> DataFrame:
    """Days since the last row, this one included, where `event` held."""
    w = Window.partitionBy(*by).orderBy(order)
    return series.withColumn(name, F.datediff(F.col(order), F.last(F.when(F.col(event), F.col(order)), ignorenulls=True).over(w)))
