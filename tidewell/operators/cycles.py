"""Peaks, troughs and cycle states of price series.

Detection is sequential within a series, so that it runs on grouped rows, one series at a time: a series has a row a
day. What follows from the events, and joins them to days, is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.shipping import ship


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of the runs of equal values that are higher than both neighbours; ends don't count."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.append(starts[1:], len(x)) - 1
    level = x[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (starts[top] + ends[top]) // 2


def spaced(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Of the rows `at`, in order, those that no higher one (of equal ones no later one) that stays is closer to than `distance`."""
    keep = np.ones(len(at), dtype=bool)
    place = at.tolist()
    for i in np.argsort(x[at], kind="stable")[::-1].tolist():
        if not keep[i]:
            continue
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(place) and abs(place[j] - place[i]) < distance:
                keep[j] = False
                j += step
    return at[keep]


def base(x: np.ndarray, peak: int, step: int) -> float:
    """Lowest value from the peak to the next higher one, to the left (-1) or to the right (1)."""
    side = x[peak::-1] if step < 0 else x[peak:]
    higher = np.flatnonzero(side > x[peak])
    return float(side[: higher[0] if len(higher) else None].min())


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima, the higher of any two closer than `distance` (of equal ones the later), then those prominent enough."""
    at = spaced(x, local_maxima(x), distance)
    if prominence <= 0:
        return at
    return np.array([p for p in at.tolist() if x[p] - max(base(x, p, -1), base(x, p, 1)) >= prominence], dtype=np.int64)


def confirmation(x: np.ndarray, peak: int, drop: float) -> int | None:
    """First row after the peak that is lower by `drop`, unless a higher one comes before: from then on the peak is known."""
    later = x[peak + 1 :]
    low, high = np.flatnonzero(x[peak] - later >= drop), np.flatnonzero(later > x[peak])
    return int(peak + 1 + low[0]) if len(low) and (not len(high) or low[0] < high[0]) else None


def confirmed_peaks(series: DataFrame, by: list[str], value: str = "price", distance: int = 7, drop: float = 1.0, point_in_time: bool = True) -> DataFrame:
    """by, peak_date, confirmed_on: peaks of each series with the day they became known.

    A peak rises by `drop` or more from the lowest value since the last higher one before it, and is known once the
    price has fallen by `drop`. In point-in-time mode a later, higher peak can't take back one that was known before:
    peaks are settled in the order of confirmation, and one within `distance` of a settled peak is passed over.
    Otherwise the distance is settled over the whole series, the higher peak first. On series whose peaks are further
    apart than `distance` both modes agree. Series of fewer than three rows have none.
    """
    kind = dict(series.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in by) + ", peak_date date, confirmed_on date"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price_date")
        x = pdf[value].to_numpy(dtype=float)
        at = local_maxima(x) if point_in_time else peaks(x, distance, drop)
        known = sorted((c, p) for p in at.tolist() if (c := confirmation(x, p, drop)) is not None and x[p] - base(x, p, -1) >= drop)
        taken: list[tuple[int, int]] = []
        for c, p in known:
            if not point_in_time or all(abs(p - q) >= distance for _, q in taken[-distance:]):
                taken.append((c, p))
        # rows of pdf itself, so that none at all still have its types
        one, other = ([t[k] for t in taken] for k in (1, 0))
        out = pdf[[*by, "price_date"]].iloc[one].rename(columns={"price_date": "peak_date"}).reset_index(drop=True)
        return out.assign(confirmed_on=pdf["price_date"].iloc[other].reset_index(drop=True))

    ship(series.sparkSession)
    return series.groupBy(*by).applyInPandas(find, schema)


def turning_peaks(series: DataFrame, by: list[str], value: str = "price", least: float = 0.5) -> DataFrame:
    """by, peak_date, confirmed_on: rows higher than both neighbours by more than `least`, known with the next row. A detector in SQL's reach."""
    w = Window.partitionBy(*by).orderBy("price_date")
    rows = series.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w), "confirmed_on": F.lead("price_date").over(w)})
    return rows.where((F.col(value) > F.col("_b") + least) & (F.col(value) > F.col("_a") + least)).select(*by, F.col("price_date").alias("peak_date"), "confirmed_on")


def in_time(events: DataFrame, by: list[str]) -> DataFrame:
    """Events of any detector as by, peak_date and confirmed_on, failing at run time on one that is known before its own day."""
    if missing := sorted({*by, "peak_date", "confirmed_on"} - set(events.columns)):
        raise ValueError(f"the detector's events lack columns: {missing}")
    early = F.raise_error(F.concat(F.lit("a peak is known before its day: "), F.col("peak_date").cast("string"))).cast("date")
    return events.select(*by, "peak_date", F.when(F.col("confirmed_on") < F.col("peak_date"), early).otherwise(F.col("confirmed_on")).alias("confirmed_on"))


def centred_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the rows within width // 2 of each, fewer at the ends; added in one order, so that a part has the values of the whole."""
    half, n = width // 2, len(x)
    padded, there = np.pad(x, half), np.pad(np.ones(n), half)
    total, rows = padded[:n].copy(), there[:n].copy()
    for k in range(1, width):
        total += padded[k : k + n]
        rows += there[k : k + n]
    return total / rows


def troughs(x: np.ndarray, spacing: int = 18, smooth: int = 7, snap: int = 5) -> np.ndarray:
    """Minima of the centred mean, `spacing` apart, each moved to the lowest value within `snap` rows."""
    if len(x) < 2 * smooth:
        return np.zeros(0, dtype=np.int64)
    return np.array(sorted({snapped(x, t, snap) for t in peaks(-centred_mean(x, smooth), spacing).tolist()}), dtype=np.int64)


def snapped(x: np.ndarray, t: int, snap: int) -> int:
    lo = max(0, t - snap)
    return lo + int(np.argmin(x[lo : t + snap + 1]))


def settled(v: np.ndarray, spacing: int) -> int | None:
    """The start of the last peak of v that no row to come can take back, and that what comes after it can be told from.

    That is a peak ahead of all others within `spacing`, where the row `spacing` behind it belongs to a run that has ended: no
    further peak can come up within its reach. It stays and takes out those within its reach, so that peaks before it and
    after it don't meet.
    """
    at = local_maxima(v)
    for i in range(len(at) - 1, -1, -1):
        c, end = at[i], at[i] + spacing
        if end >= len(v) or (v[end:] == v[end]).all():
            continue
        near = at[np.abs(at - c) < spacing]
        if all(v[k] < v[c] or k <= c and v[k] == v[c] for k in near.tolist()):
            start = c
            while v[start - 1] == v[c]:
                start -= 1
            return int(start)
    return None


def last_troughs(x: np.ndarray, spacing: int = 18, smooth: int = 7, snap: int = 5) -> np.ndarray:
    """For each row the last of the troughs of the rows up to it, -1 where there is none.

    What lies before a settled peak of the (negated) mean is never looked at again: only the rows behind the last one, some multiples of
    `spacing`, are decided anew for each row, so that the work is in proportion to the rows.
    """
    out = np.full(len(x), -1, dtype=np.int64)
    half, start = smooth // 2, 0
    for n in range(2 * smooth, len(x) + 1):
        low = max(0, start - half)
        v = -centred_mean(x[low:n], smooth)[start - low :]
        at = peaks(v, spacing)
        if len(at):
            # moving to the lowest row near can change the order of two troughs
            out[n - 1] = max(snapped(x[:n], start + t, snap) for t in at[-2:].tolist())
        if len(v) > 4 * spacing and (s := settled(v[: len(v) - half], spacing)) is not None and s > 1:
            start += s - 1
    return out


def trough_events(series: DataFrame, by: list[str], value: str = "price", **how) -> DataFrame:
    """by, event_date: troughs of each whole series, for diagnosis: a day's troughs may depend on later days."""
    kind = dict(series.dtypes)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price_date")
        at = troughs(pdf[value].to_numpy(dtype=float), **how)
        return pdf[[*by, "price_date"]].iloc[at].rename(columns={"price_date": "event_date"})

    ship(series.sparkSession)
    return series.groupBy(*by).applyInPandas(find, ", ".join(f"{c} {kind[c]}" for c in by) + ", event_date date")


def days_since_trough(series: DataFrame, by: list[str], value: str = "price", **how) -> DataFrame:
    """by, price_date, days_since: days since the last trough that the rows up to that day show, for every day.

    Every day is detected on its own past, from the series' first row, so that no later row can change it. A series
    has a row a day, and the work is in proportion to its days; series are spread over the tasks.
    """
    kind = dict(series.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in by) + ", price_date date, days_since int"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price_date")
        days, last = pdf["price_date"].to_numpy().astype("datetime64[D]"), last_troughs(pdf[value].to_numpy(dtype=float), **how)
        since = pd.Series((days - days[last]).astype(np.int64)).where(last >= 0).astype("Int32")
        frame = pd.DataFrame({"price_date": pdf["price_date"].to_numpy(), "days_since": since})
        for c in by:
            frame[c] = pdf[c].iloc[0]
        return frame[[*by, "price_date", "days_since"]]

    ship(series.sparkSession)
    return series.groupBy(*by).applyInPandas(find, schema)


def leads(own: list, anchor: list, reach: int = 60) -> list[int]:
    """For each anchor day the lead of the nearest own day (of two as near the earlier), if within `reach` days."""
    out = []
    days = np.array(own, dtype="datetime64[D]")
    for a in np.array(anchor, dtype="datetime64[D]"):
        lead = (a - days).astype(np.int64)
        if len(lead) and np.abs(lead).min() <= reach:
            out.append(int(lead[np.argmin(np.abs(lead))]))
    return out


def leadership_snapshots(series: DataFrame, by: str, window: int = 730, step: int = 7, reach: int = 60) -> DataFrame:
    """by, snapshot_date, median_lead, consistency, matched, events: scores of every `step` days, each on the `window` days before it.

    series has by, price_date, price and anchor_price, either of which may be null. The first snapshot is the day after
    the first day of all series. A group without a price in the window has no row; one without matched troughs has
    null scores and a match share of zero; consistency needs two matches that differ. One group is one task: a row a day.
    """
    kind = dict(series.dtypes)
    first = series.agg(F.min("price_date").alias("d"), F.max("price_date").alias("e")).first()
    schema = f"{by} {kind[by]}, snapshot_date date, median_lead double, consistency double, matched double, events double"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price_date")
        days = pdf["price_date"].to_numpy().astype("datetime64[D]")
        price, other = pdf["price"].to_numpy(dtype=float), pdf["anchor_price"].to_numpy(dtype=float)
        out = []
        for snap in np.arange(np.datetime64(first.d, "D") + 1, np.datetime64(first.e, "D") + 2, step):
            i, j = np.searchsorted(days, [snap - window, snap])
            here, there = i + np.flatnonzero(~np.isnan(price[i:j])), i + np.flatnonzero(~np.isnan(other[i:j]))
            if not len(here):
                continue
            own, anchor = days[here][troughs(price[here])], days[there][troughs(other[there])]
            found = leads(own, anchor, reach)
            spread = float(np.std(found)) if len(found) >= 2 else 0.0
            out.append((snap.item(), float(np.median(found)) if found else None, 1 / spread if spread else None, len(found) / len(anchor) if len(anchor) else 0.0, len(own)))
        frame = pdf[[by, "price_date"]].iloc[[0] * len(out)].rename(columns={"price_date": "snapshot_date"}).reset_index(drop=True)
        frame["snapshot_date"] = pd.Series([r[0] for r in out], dtype=object)  # else none at all would be numbers
        names = ("median_lead", "consistency", "matched", "events")
        return frame.assign(**{c: pd.Series([r[k + 1] for r in out], dtype=float) for k, c in enumerate(names)})

    ship(series.sparkSession)
    return series.groupBy(by).applyInPandas(find, schema)


def cycle_state(days: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """days with last_peak, previous_peak, days_since, mean_length (2 decimals), pct_through and n_peaks, as known on each day.

    events has by, peak_date and confirmed_on, and peaks are known in their order. Both meet in one window ordered by the
    day a row is known.
    """
    before = F.lag("peak_date").over(Window.partitionBy(*by).orderBy("confirmed_on", "peak_date"))
    marks = events.select(*by, F.col("confirmed_on").alias("price_date"), F.lit(0).alias("_day"), "peak_date", before.alias("_before"))
    rows = days.select(*days.columns, F.lit(1).alias("_day"), F.lit(None).cast("date").alias("peak_date"), F.lit(None).cast("date").alias("_before")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("price_date", "_day", "peak_date").rowsBetween(Window.unboundedPreceding, 0)
    n, last, first = F.count("peak_date").over(w), F.max("peak_date").over(w), F.min("peak_date").over(w)
    seen = rows.withColumns({"n_peaks": n, "last_peak": last, "_first": first, "previous_peak": F.last("_before", ignorenulls=True).over(w)}).where("_day = 1")
    length = F.round(F.try_divide(F.datediff("last_peak", "_first").cast("double"), F.col("n_peaks") - 1), 2)
    since = F.datediff("price_date", "last_peak")
    return seen.withColumns({"days_since": since, "mean_length": length}).withColumn("pct_through", F.round(F.try_divide(F.col("days_since"), F.col("mean_length")), 4)).drop("_day", "_first", "peak_date", "_before")


def leadership(anchor: DataFrame, events: DataFrame, by: str, reach: int = 60) -> DataFrame:
    """by, median_lead, consistency, matched: how far and how steadily each series' troughs come before the anchor's."""
    from tidewell.operators.joins import nearest_within

    total = anchor.agg(F.count(F.lit(1)).alias("n")).scalar()
    met = nearest_within(anchor, events, by, reach).withColumn("_n", total)
    return met.groupBy(by).agg(F.median("lead").alias("median_lead"), F.round(F.try_divide(F.lit(1.0), F.stddev_pop("lead")), 6).alias("consistency"), F.round(F.count(F.lit(1)) / F.max("_n"), 4).alias("matched"))


def savitzky_golay(width: int = 7, degree: int = 2) -> np.ndarray:
    """Weights: row k gives the fitted value at place k of `width` rows."""
    x = np.arange(width) - width // 2
    a = np.vander(x, degree + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def smooth(series: DataFrame, value: str, by: list[str], width: int = 7, degree: int = 2, name: str = "smooth") -> DataFrame:
    """Savitzky-Golay: the middle row of the fit inside, the fits of the first and last `width` rows at the ends."""
    half = width // 2
    m = savitzky_golay(width, degree)
    w = Window.partitionBy(*by).orderBy("price_date")
    at = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
    rows = series.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    fit = F.lit(None).cast("double")
    for k in range(width):  # the row is at place k of the window that the fit is over
        here = sum((at(j - k) * float(m[k, j]) for j in range(width)), F.lit(0.0))
        place = F.when(F.col("_i") < half, F.col("_i")).when(F.col("_i") >= F.col("_n") - half, F.col("_i") - F.col("_n") + width).otherwise(half)
        fit = F.when((place == k) & (F.col("_n") >= width), here).otherwise(fit)
    return rows.withColumn(name, fit).drop("_i", "_n")
