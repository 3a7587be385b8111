"""Rule signals: 1 buy, 0 wait, -1 don't buy, null neutral; and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cycle_time(share: Column, buy: float = 0.8, wait: float = 0.4) -> Column:
    return F.when(share > buy, 1).when(share > wait, 0).otherwise(-1)


def flatline(gradients: list[Column], since_peak: Column, cycle: Column, limit: float = 0.5) -> Column:
    """Neutral unless all gradients are nearly zero; then buy in the second half of a cycle."""
    flat = F.lit(True)
    for g in gradients:
        flat = flat & (F.abs(g) < limit)
    return F.when(~flat | flat.isNull(), F.lit(None)).when(since_peak > cycle / 2, 1).otherwise(-1)


def near_extremes(price: str, low: str, high: str, delta: float) -> Column:
    p = F.round(F.col(price), 6)
    return F.when(F.col(low).isNull(), F.lit(None)).when(p < F.round(F.col(low) + delta, 6), 1).when(p > F.round(F.col(high) - delta, 6), -1).otherwise(0)


def combine(signals: DataFrame, names: list[str], limit: float = 0.5) -> DataFrame:
    """Mean of the signals that aren't neutral; wait if all are."""
    values = F.array_compact(F.array(*[F.col(n).cast("double") for n in names]))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))
    out = signals.withColumn("_m", mean)
    m = F.col("_m")
    return out.select(*signals.columns, F.round(m, 4).alias("mean_value"), F.when(m >= limit, "BUY").when(m <= -limit, "DONT").otherwise("WAIT").alias("verdict"))


def favourites(prices: DataFrame, stations: DataFrame, by: str, rise: int) -> DataFrame:
    """The last change of each station's price; buy if some rose sharply, don't if all did."""
    w = Window.partitionBy("station_code").orderBy("price_date")
    newest = Window.partitionBy("station_code").orderBy(F.desc("price_date"))
    last = prices.withColumns({"g": F.col("decicents") - F.lag("decicents").over(w), "k": F.row_number().over(newest)}).where("k = 1 and g is not null")
    groups = last.join(stations, "station_code").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") >= rise).alias("big"))
    every, some = (F.col("big") > 0) & (F.col("big") == F.col("n")), F.col("big") > 0
    return groups.select(by, "n", "big", F.when(every, -1).when(some, 1).alias("value"), F.when(every, "DONT_BUY").when(some, "BUY").otherwise("NEUTRAL").alias("signal"))
