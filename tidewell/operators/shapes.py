"""Shapes of descents: how long, how steep, and where a long one is shallow; upstream gaps before troughs.

Everything but `before_troughs`, which looks ahead for diagnosis, is known on its day. A series has a row a day, so that windows over
a whole series are over its days; rows of stations meet it by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators import panel

#: A descent longer than the usual cycle and shallower than so many cents a day is an extended shallow one.
LONG, SHALLOW = 1.0, -0.9
#: The first half of a cycle is the descent.
DESCENT = 0.5


def usual_length(state: DataFrame, days: int = 730) -> DataFrame:
    """price_date, usual: the median cycle length that the `days` days before knew; null on the first day. state has a row a day."""
    known = state.where("cycle_mean_length is not null")
    return known.select("price_date", F.percentile("cycle_mean_length", F.lit(0.5)).over(panel.days_window(start=-days, end=-1)).alias("usual"))


def descents(rows: DataFrame, state: DataFrame, days: int = 730) -> DataFrame:
    """rows with elongation, slope_so_far and shallow_long.

    rows has price_date, station_price and the columns of the cycle's state. Elongation is the time since the peak in usual cycles; the
    slope is cents a day from the last cycle's highest price; both are null where they would divide by nothing, and shallow_long is then 0.
    """
    usual = usual_length(state, days)
    out = rows.join(usual, "price_date", "left")
    since = F.col("cycle_days_since_peak")
    out = out.withColumns({
        "elongation": F.when(F.col("usual") > 0, since / F.col("usual")),
        "slope_so_far": F.when(since > 0, (F.col("station_price") - F.col("cycle_last_max")) / since),
    })
    corner = (F.col("elongation") > LONG) & (F.col("slope_so_far") > SHALLOW)
    return out.withColumn("shallow_long", F.coalesce(corner, F.lit(False)).cast("int")).drop("usual")


def interactions(rows: DataFrame, signal: str) -> DataFrame:
    """rows of `descents` with a signal in the corner, outside it, and weighted by length and shallowness; null where the signal or the shape is."""
    a, corner = F.col(signal), F.col("shallow_long")
    smooth = F.when(F.col("slope_so_far").isNotNull(), a * F.col("elongation") * F.greatest(F.lit(0.0), F.col("slope_so_far") - SHALLOW))
    return rows.withColumns({f"{signal}_corner": a * corner, f"{signal}_other": a * (1 - corner), f"{signal}_smooth": smooth})


def fold_shapes(rows: DataFrame, folds: DataFrame, lag: int = 14) -> DataFrame:
    """Of each fold's validation days: gradient, descent_share, cycle_slope and elongation, and n, the rows there.

    gradient is the median of the falls over `lag` rows of a station, in cents a day; cycle_slope the median slope so far of descending
    rows; descent_share the share of rows in the first half of a cycle; elongation the median time since the peak, in median cycle
    lengths of the station before the fold. folds (fold, val_start, val_end) is a bounded table; a row meets the folds it lies in, and a
    station's rows before a fold are summed up for each fold. A measure without rows is null.
    """
    back = (F.col("station_price") - F.lag("station_price", lag).over(Window.partitionBy("station_code").orderBy("price_date"))) / lag
    seen = rows.withColumn("_back", back)
    spans = F.broadcast(folds.select("fold", "val_start", "val_end"))
    inside = seen.join(spans, F.col("price_date").between(F.col("val_start"), F.col("val_end")))
    before = seen.join(spans, F.col("price_date") < F.col("val_start")).groupBy("fold", "station_code").agg(F.median("cycle_mean_length").alias("_usual"))
    met = inside.join(before.where("_usual > 0"), ["fold", "station_code"], "left")
    falling = (F.col("cycle_pct_through") < DESCENT) & (F.col("cycle_days_since_peak") > 0)
    median = lambda condition, x: F.median(F.when(condition, x))
    return met.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), median(F.col("_back") < 0, F.col("_back")).alias("gradient"), F.avg((F.col("cycle_pct_through") < DESCENT).cast("int")).alias("descent_share"),
        median(falling, F.col("slope_so_far")).alias("cycle_slope"), F.median(F.col("cycle_days_since_peak") / F.col("_usual")).alias("elongation"),
    )


def before_troughs(series: DataFrame, upstream: DataFrame, peaks: DataFrame, lows: DataFrame, by: list[str], lag: int = 7) -> DataFrame:
    """series (by, price_date, price) with gap, slope, low, in_descent, depth and days_to_low: a look ahead, for diagnosis.

    gap is the price above the last upstream value known (tgp_date, tgp); slope the change over `lag` rows, a day; depth and days_to_low
    are to the next low, the day itself included; in_descent says that no low came between the last peak and the day. peaks has by and
    peak_date, lows by and anchor_date.
    """
    marks = peaks.select(*by, F.col("peak_date").alias("price_date"), F.lit(True).alias("_peak"))
    ends = lows.select(*by, F.col("anchor_date").alias("price_date"), F.lit(True).alias("low"))
    up = upstream.select(F.col("tgp_date").alias("price_date"), "tgp")
    rows = series.join(up, "price_date", "left").join(marks, [*by, "price_date"], "left").join(ends, [*by, "price_date"], "left")
    w = Window.partitionBy(*by).orderBy("price_date")
    past, before, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_up": F.last("tgp", ignorenulls=True).over(past), "slope": (F.col("price") - F.lag("price", lag).over(w)) / lag,
        "_next": F.min(F.when(F.col("low"), F.struct("price_date", "price"))).over(ahead),
        "_last_peak": F.max(F.when(F.col("_peak"), F.col("price_date"))).over(past), "_last_low": F.max(F.when(F.col("low"), F.col("price_date"))).over(before),
    })
    falling = F.col("_last_peak").isNotNull() & F.col("_next").isNotNull() & (F.col("_last_low").isNull() | (F.col("_last_low") < F.col("_last_peak")))
    return rows.select(
        *by, "price_date", "price", (F.col("price") - F.col("_up")).alias("gap"), "slope", F.coalesce("low", F.lit(False)).alias("low"), falling.alias("in_descent"),
        (F.col("price") - F.col("_next.price")).alias("depth"), F.datediff("_next.price_date", "price_date").alias("days_to_low"),
    )


def gap_diagnosis(rows: DataFrame, by: list[str], fall: float = -0.1) -> DataFrame:
    """How much of depth and time left the upstream gap tells, over descending rows that fall by more than `fall` a day; and gaps at lows.

    r2_projection is of the days that gap and slope foretell. A squared correlation of fewer than two rows, or of constant ones, is null.
    """
    m = F.col("in_descent") & (F.col("slope") < fall) & F.col("gap").isNotNull()
    at = lambda x: F.when(m, x.cast("double"))
    projected = F.try_divide(F.col("gap"), -F.col("slope"))
    each = rows.select(
        *by, m.alias("m"), at(F.col("gap")).alias("g"), at(F.col("depth")).alias("depth"), at(F.col("days_to_low")).alias("days"), at(projected).alias("projected"), F.when(F.col("low"), F.col("gap")).alias("kiss")
    )
    square = lambda a, b: F.round(F.pow(stats.safe_corr(a, b), F.lit(2.0)), 4)
    return each.groupBy(*by).agg(
        F.count_if("m").alias("descending"), square("g", "depth").alias("r2_depth"), square("g", "days").alias("r2_days"), square("projected", "days").alias("r2_projection"), F.count("kiss").alias("lows"),
        F.round(F.avg("kiss"), 4).alias("kiss_mean"), F.round(F.stddev_samp("kiss"), 4).alias("kiss_sd"), *[F.round(F.percentile("kiss", F.lit(q)), 4).alias(f"kiss_p{round(q * 100)}") for q in (0.1, 0.5, 0.9)],
    )
