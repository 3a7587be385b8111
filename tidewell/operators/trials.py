"""Trials of candidate features: leak tests, placebos, redundancy, noise bands, contracts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stats import safe_corr


@dataclass(frozen=True)
class Candidate:
    """A feature to try: df -> df with further columns, and what it may read and must add."""

    name: str
    inputs: list[str]
    columns: list[str]
    add: Callable[[DataFrame], DataFrame]
    target: str = "label"
    forbidden: list[str] = field(default_factory=lambda: ["label", "future_min"])


def validate(candidate: Candidate, frame: DataFrame) -> DataFrame:
    """(column, rows, nulls, null_rate) of the candidate's columns, computed from its declared inputs alone.

    Refuses targets among the inputs, inputs that aren't there, columns that aren't added, and columns that are null throughout.
    """
    if bad := sorted(set(candidate.inputs) & set(candidate.forbidden)):
        raise ValueError(f"targets can't be inputs: {bad}")
    if bad := sorted(set(candidate.inputs) - set(frame.columns)):
        raise ValueError(f"inputs aren't there: {bad}")
    out = candidate.add(frame.select(*candidate.inputs))
    if bad := sorted(set(candidate.columns) - set(out.columns)):
        raise ValueError(f"columns weren't added: {bad}")
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in candidate.columns]
    long = out.agg(F.count(F.lit(1)).alias("rows"), *nulls).unpivot(["rows"], candidate.columns, "column", "nulls")
    empty = F.raise_error(F.concat(F.lit("null throughout: "), F.col("column"))).cast("double")
    return long.select("column", "rows", "nulls", F.when((F.col("rows") > 0) & (F.col("nulls") == F.col("rows")), empty).otherwise(F.try_divide("nulls", "rows")).alias("null_rate"))


def leaks(build: Callable[[DataFrame], DataFrame], rows: DataFrame, cut: str, day: str = "price_date") -> DataFrame:
    """Rows up to `cut` that change when the input ends there: none, unless the feature looks ahead. Both ways, with repeats."""
    whole, short = (build(r).where(F.col(day) <= cut) for r in (rows, rows.where(F.col(day) <= cut)))
    columns = [F.col(f"`{c}`") for c in whole.columns]
    both = whole.withColumn("_more", F.lit(1)).unionByName(short.withColumn("_more", F.lit(-1)))
    said = [x for c in columns for x in (c, c.isNull())]
    hashes = [F.xxhash64(F.lit(k), *said) for k in (1, 2)]
    halves = [x.cast("long") for h in hashes for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftright(h, 32))]
    # days whose rows agree in number and in the sums of two hashes are the same; only the rows of others meet
    sums = both.groupBy(day).agg(F.sum("_more").alias("_n"), *[F.sum(x * F.col("_more")).alias(f"_h{i}") for i, x in enumerate(halves)])
    other = sums.where(" or ".join(f"{c} <> 0" for c in sums.columns[1:])).select(day)
    rest = both.join(F.broadcast(other), day, "left_semi").groupBy(*columns).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    side = F.when(F.col("_more") > 0, "whole").otherwise("cut")
    return rest.select(*columns, F.explode(F.array_repeat(side, F.abs("_more").cast("int"))).alias("side"))


def block_placebo(series: DataFrame, value: str, block: int, shift: int, order: str = "price_date", name: str = "placebo") -> DataFrame:
    """The series with its blocks of `block` rows moved round by `shift` blocks, so that none stays (0 < shift < blocks).

    A shorter last block stays where it is: the values are the same as often as before.
    """
    w = Window.partitionBy().orderBy(order)
    at = series.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    blocks = F.floor(F.col("_n") / block)
    home, inside = F.floor(F.col("_i") / block), F.col("_i") % block
    to = F.when(home < blocks, (home + shift) % blocks * block + inside).otherwise(F.col("_i")).cast("int")
    moved = at.select(to.alias("_i"), F.col(value).alias(name))
    return at.join(moved, "_i").drop("_i", "_n")


def pairwise(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(a, b, rho) for each two columns, over the rows that have both, each so often as its weight says; all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[safe_corr(a, b, weight).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])))


def redundancy(pairs: DataFrame, gate: float = 0.85) -> DataFrame:
    """What can't be computed doesn't pass."""
    return pairs.withColumn("verdict", F.when(F.col("rho").isNull(), "uncomputable").when(F.abs("rho") >= gate, "redundant").otherwise("pass"))


def noise_band(draws: DataFrame, value: str, observed: Column, by: str | None = None) -> DataFrame:
    """n, mean, sample deviation of the placebo draws; the observed value's z and share of draws below it."""
    m, s = F.avg(value), F.stddev_samp(value)
    g = draws.groupBy(by) if by else draws.groupBy()
    return g.agg(F.count(value).alias("n"), F.round(m, 6).alias("mean"), F.round(s, 6).alias("std"), F.round(F.try_divide(F.max(observed) - m, s), 4).alias("z"), F.round(F.avg((F.col(value) < observed).cast("int")), 4).alias("share_below"))


def same_contract(a: dict, b: dict, keys: tuple[str, ...] = ("fingerprint", "cadence", "method")) -> None:
    if bad := {k: (a.get(k), b.get(k)) for k in keys if a.get(k) != b.get(k)}:
        raise ValueError(f"results can't be compared: {bad}")


def unstamped(document, stamp: str = "cadence", value: str = "cpl") -> list[str]:
    """Paths of objects in a JSON document that have a cost per litre but no stamp, there or above."""
    out: list[str] = []

    def walk(x, path: str, stamped: bool) -> None:
        if isinstance(x, dict):
            here = stamped or stamp in x
            if not here and any(value in k for k in x):
                out.append(path or "/")
            for k, v in x.items():
                walk(v, f"{path}/{k}", here)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}", stamped)

    walk(document, "", False)
    return out


def unstamped_results(results: DataFrame, document: str = "document", stamp: str = "cadence", value: str = "cpl") -> DataFrame:
    """results with `path`, a row for each object of their JSON documents that has a cost per litre but no stamp, there or above.

    A document that can't be read has the path `unreadable`; one that is null or blank has none.
    """
    @F.pandas_udf("array<string>")
    def paths(documents: pd.Series) -> pd.Series:
        def of(x: str | None) -> list[str]:
            try:
                return unstamped(json.loads(x), stamp, value) if x and x.strip() else []
            except ValueError:
                return ["unreadable"]

        return documents.map(of)

    return results.select("*", F.explode(paths(document)).alias("path")).drop(document)


def family_share(level: float, candidates: int) -> float:
    """The percentile that the best of so many candidates must reach."""
    return 1 - (1 - level) / max(1, candidates)


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on its distribution function, which is integrated by Simpson's rule."""
    if not 0 < p < 1 or df < 1:
        raise ValueError("p must be between 0 and 1, df at least 1")
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float, n: int = 2000) -> float:
        h = t / n
        f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 0.5 + h / 3 * (f(0) + f(t) + 4 * sum(f((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2)))

    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def family_z(level: float, candidates: int, draws: int) -> float:
    """Critical z for the best of so many candidates against `draws` placebo draws."""
    return t_quantile(family_share(level, candidates), draws - 1) * math.sqrt(1 + 1 / draws)
