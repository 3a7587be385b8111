"""Feature assembly: cycle state, distances from references, troughs by group, network dispersion, upstream momentum.

Every column is known on its day: states use confirmed peaks, troughs are detected on each day's own past, classes are
those that the days before it give. The panel is stored once and read by each part; the parts are tables with a row a
day, or a day and group, and are joined to the rows from the left, so that an absent value is null and drops no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import slug_of
from tidewell.operators import cycles
from tidewell.operators import panel as pn
from tidewell.operators.classify import on_its_day
from tidewell.operators.storage import stored

#: Columns in the order that a model is fitted with; those of groups come between them.
CYCLE = ["cycle_pct_through", "cycle_days_since_peak", "cycle_mean_length", "cycle_last_min", "cycle_last_max", "cycle_peak_count"]
PRICE = ["station_price", "minus_last_min", "minus_last_max", "minus_metro", "council_mean", "minus_council", "brand_mean", "minus_brand", "stickiness"]
NETWORK = ["network_std", "network_std_delta_3d", "phase_std", "phase_std_delta_3d"]
EXTRA = ["upstream_delta_7d"]


#: From a series (by, price_date, price) to its peaks (by, peak_date, confirmed_on).
Detector = Callable[[DataFrame, list[str]], DataFrame]


def cycle_features(metro: DataFrame, detector: Detector = cycles.confirmed_peaks) -> DataFrame:
    """price_date and the CYCLE columns, for days on which two peaks are known. metro has a row a day; any detector can stand in."""
    series = metro.withColumn("series", F.lit("metro"))
    state = cycles.cycle_state(series.select("series", "price_date"), cycles.in_time(detector(series, ["series"]), ["series"]), ["series"]).where("n_peaks >= 2 and mean_length > 0")
    whole = state.select("previous_peak", "last_peak").distinct()
    days = whole.select("*", F.explode(F.sequence("previous_peak", F.date_sub("last_peak", 1))).alias("price_date"))
    bounds = days.join(metro, "price_date").groupBy("previous_peak", "last_peak").agg(F.min("price").alias("cycle_last_min"), F.max("price").alias("cycle_last_max"))
    names = {"pct_through": "cycle_pct_through", "days_since": "cycle_days_since_peak", "mean_length": "cycle_mean_length", "n_peaks": "cycle_peak_count"}
    return state.join(bounds, ["previous_peak", "last_peak"]).withColumnsRenamed(names).select("price_date", *CYCLE)


def trough_features(means: DataFrame, by: str, names: list[str], prefix: str = "days_since_trough") -> DataFrame:
    """price_date and a column for each group of `names`: days since its last trough as each day's past shows it."""
    wide = cycles.days_since_trough(means, [by]).groupBy("price_date").pivot(by, names).agg(F.first("days_since"))
    return wide.select("price_date", *[F.col(f"`{n}`").cast("double").alias(f"{prefix}_{slug_of(n)}") for n in names])


def spread(troughs: DataFrame) -> DataFrame:
    """price_date, phase_std: sample deviation of the groups' days since their troughs, of two groups or more."""
    values = F.array_compact(F.array(*[F.col(f"`{c}`") for c in troughs.columns if c != "price_date"]))
    long = troughs.select("price_date", F.explode(values).alias("v"))
    return long.groupBy("price_date").agg(F.stddev_samp("v").alias("phase_std")).where("phase_std is not null")


def with_delta(series: DataFrame, value: str, days: int = 3) -> DataFrame:
    """The series with `value`_delta_`days`d, its change from exactly so many days before."""
    return series.withColumn(f"{value}_delta_{days}d", pn.calendar_delta(series, value, days))


def assemble(rows: DataFrame, panel: DataFrame, classes: DataFrame, upstream: DataFrame, councils: list[str], brands: list[str], detector: Detector = cycles.confirmed_peaks) -> DataFrame:
    """rows (station_code, price_date, ...) with the columns of columns(councils, brands).

    panel is the gap-filled one with council and brand; classes has snapshot_date, station_code, class and premium, and
    those of the day itself count; upstream has tgp_date and tgp. Rows of days without a cycle state
    are left out. Means of a council or brand need three stations that aren't Sticky.
    """
    daily = stored(panel, "features-panel")
    metro = stored(pn.mean_price(daily), "features-metro")
    classed = stored(on_its_day(daily, classes, "left"), "features-classed")
    fair = classed.where("class <> 'Sticky'")
    council, brand = (pn.mean_price(fair, by, least=3, name=f"{by}_mean") for by in ("council", "brand"))
    network = with_delta(pn.dispersion(classed.where("class = 'Competitive'")).withColumnRenamed("px_std", "network_std"), "network_std")
    troughs = stored(trough_features(pn.mean_price(fair, "council", least=3), "council", councils), "features-troughs")
    by_brand = trough_features(pn.mean_price(fair, "brand", least=3), "brand", brands)
    up = pn.lagged_delta(upstream, "tgp_date", "tgp", 7, "upstream_delta_7d").withColumnRenamed("tgp_date", "price_date")
    wide = rows.join(classed.select("station_code", "price_date", "council", "brand", (F.col("decicents") / 10).alias("station_price"), F.col("premium").alias("stickiness")).hint("merge"), ["station_code", "price_date"])
    wide = wide.join(cycle_features(metro, detector), "price_date").join(metro.withColumnRenamed("price", "_metro"), "price_date")
    wide = wide.join(council, ["price_date", "council"], "left").join(brand, ["price_date", "brand"], "left")
    for part in (troughs, network, with_delta(spread(troughs), "phase_std"), up, by_brand):
        wide = wide.join(part, "price_date", "left")
    less = lambda c: F.col("station_price") - F.col(c)
    wide = wide.withColumns({"minus_last_min": less("cycle_last_min"), "minus_last_max": less("cycle_last_max"), "minus_metro": less("_metro"), "minus_council": less("council_mean"), "minus_brand": less("brand_mean")})
    return wide.select(*rows.columns, *columns(councils, brands))


def columns(councils: list[str], brands: list[str]) -> list[str]:
    """All feature columns in their order. The brands' troughs and the upstream momentum are computed, but in no model."""
    return [*locked(councils), *EXTRA, *[f"days_since_trough_{slug_of(b)}" for b in brands]]


def locked(councils: list[str]) -> list[str]:
    """The columns that models are fitted with, in their order."""
    return [*CYCLE, *PRICE, *[f"days_since_trough_{slug_of(c)}" for c in councils], *NETWORK]
