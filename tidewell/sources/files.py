"""Readers of the outside formats: snapshot CSV, shifted raw CSV, API JSON, links of pages; and searches."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in local mode without the setting, below a temporary folder of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewell-"))
    return f"{base.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"


#: Columns of a snapshot CSV, and of a raw price history.
SNAPSHOT = ("station_code", "name", "address", "suburb", "postcode", "brand", "fuel_code", "price", "date")
RAW = ("ServiceStationName", "Address", "Suburb", "Postcode", "Brand", "FuelCode", "PriceUpdatedDate", "Price")
DETAILS = RAW[:5]


def read_snapshot(spark: SparkSession, path: str, postcodes: list[str] | None = None, fuel_codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(stations, prices) of snapshot CSVs, whose columns are found by name.

    Rows whose code is no number are skipped, as are those of other postcodes. Prices need a fuel code, of the given
    ones if any, and a number. A station needs a price among these.
    """
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(F.col("station_code").try_cast("long").alias("station_code"), *[F.coalesce(c, F.lit("")).alias(c) for c in SNAPSHOT[1:6]], "fuel_code", F.col("price").try_cast("double").alias("cents"), "date")
    rows = rows.where("station_code is not null")
    if postcodes is not None:
        rows = rows.where(F.col("postcode").isin(postcodes))
    priced = rows.where("fuel_code <> '' and cents is not null")
    if fuel_codes is not None:
        priced = priced.where(F.col("fuel_code").isin(fuel_codes))
    prices = priced.select("station_code", "fuel_code", F.to_date("date").alias("price_date"), F.bround(F.col("cents") * 10).cast("int").alias("decicents"))
    stations = rows.join(priced.select("station_code").distinct(), "station_code", "left_semi").select(*SNAPSHOT[:6]).distinct()
    return stations, prices


def read_cleaned(spark: SparkSession, path: str, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices, suburbs) of cleaned price histories: (station_code, fuel_code, price_date, decicents, skipped) and (station_code, suburb).

    A row is of the station (station_code, address) whose address is the same when normalised; of several the smallest code. skipped
    says why a row isn't loaded, the first that applies of address, date, price and fuel, and is null for rows that are; dates are
    cut to their day. Suburbs are the first that isn't blank, by file and line of a station's rows, loaded or not. Normalising is
    dear, and histories are long: each spelling is normalised once, not each row.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[blank(F.col(c) if c in raw.columns else F.lit(None)).alias(c) for c in RAW], F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    index = stations.select(text.normalise_address(F.col("address")).alias("key"), "station_code").groupBy("key").agg(F.min("station_code").alias("station_code"))
    spelled = raw.select(blank(F.col("Address") if "Address" in raw.columns else F.lit(None)).alias("Address")).groupBy("Address").agg(F.count(F.lit(1)).alias("n"))
    # a left join: an inner one would look for null keys in each row, below the grouping
    known = spelled.withColumn("key", text.normalise_address(F.col("Address"))).join(index, "key", "left").select("Address", "station_code")
    met = rows.join(known, "Address", "left")
    price = F.col("Price").try_cast("double")
    why = F.when(F.col("station_code").isNull(), "address").when(F.col("PriceUpdatedDate") == "", "date").when(price.isNull(), "price").when(F.col("FuelCode") == "", "fuel")
    prices = met.select("station_code", F.col("FuelCode").alias("fuel_code"), F.substring("PriceUpdatedDate", 1, 10).try_cast("date").alias("price_date"), text.to_decicents(price).alias("decicents"), why.alias("skipped"))
    suburbs = met.where("station_code is not null").where(F.trim("Suburb") != "").groupBy("station_code").agg(F.min_by(F.trim("Suburb"), F.struct("file", "line")).alias("suburb"))
    return prices, suburbs


def skip_counts(prices: DataFrame) -> DataFrame:
    """(skipped, rows) of what read_cleaned gives; loaded rows under null."""
    return prices.groupBy("skipped").agg(F.count(F.lit(1)).alias("rows"))


def read_upstream(spark: SparkSession, path: str, city: str = "Sydney") -> DataFrame:
    """(tgp_date, tgp) of an upstream price CSV: the first column is the day, one column a city. Rows without a readable day are
    left out; a day without a price is null. A file without the city is refused."""
    raw = spark.read.option("header", True).csv(path)
    if city not in raw.columns[1:]:
        raise ValueError(f"no column {city!r}: the layout may have changed ({raw.columns})")
    day = F.to_date(text.parse_date(F.col(f"`{raw.columns[0]}`")))
    return raw.select(day.alias("tgp_date"), F.col(f"`{city}`").try_cast("double").alias("tgp")).where("tgp_date is not null")


def unshift(raw: DataFrame) -> DataFrame:
    """Rows whose station name is a number have one field too many in front: all others move to the left."""
    shifted = F.coalesce(F.col(RAW[0]).rlike(r"^\d+$"), F.lit(False))
    return raw.select(*[F.when(shifted, F.col(n)).otherwise(F.col(c)).alias(c) for c, n in zip(RAW, [*RAW[1:], "_extra"], strict=True)], *[c for c in raw.columns if c not in (*RAW, "_extra")])


def file_month(rows: DataFrame, at: str = "at") -> DataFrame:
    """(file, month): the month of the first line whose day is above 12; else, if all days are the same number in several months, that number; else the last line's."""
    day, month = F.dayofmonth(at), F.month(at)
    g = rows.where(F.col(at).isNotNull()).groupBy("file").agg(
        F.min(F.when(day > 12, F.struct("line", month.alias("m")))).alias("sure"), F.min(day).alias("d0"), F.max(day).alias("d1"), F.min(month).alias("m0"), F.max(month).alias("m1"), F.max_by(month, "line").alias("last"),
    )
    return g.select("file", F.coalesce("sure.m", F.when((F.col("d0") == F.col("d1")) & (F.col("m0") < F.col("m1")), F.col("d0")), "last").alias("month"))


def read_raw(spark: SparkSession, path: str, brands: list[tuple[str, str]]) -> DataFrame:
    """Clean rows of raw price histories, one per station, fuel and day: the latest of the day.

    Shifted rows are put right. A row without a station name is of the station above it; one without a date has that of
    the row above it of the same station. Dates follow the file's month; rows with an unreadable or future date, without
    a price, fuel, suburb, brand or postcode are left out. Lines are windows of a file, which is a month of data.
    """
    schema = ", ".join(f"{c} string" for c in (*RAW, "_extra"))
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return clean_raw(spark.read.schema(schema).option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"), line.alias("line")), brands)


def clean_raw(raw: DataFrame, brands: list[tuple[str, str]]) -> DataFrame:
    """What read_raw makes of rows with their file and line, the columns of RAW and _extra, all of them texts."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = unshift(raw).where(~(blank("FuelCode") & blank("Price") & blank("PriceUpdatedDate")))
    above = Window.partitionBy("file").orderBy("line")
    named = F.when(~blank(RAW[0]), F.struct("line", *DETAILS))
    rows = rows.withColumn("_of", F.last(named, ignorenulls=True).over(above)).where("_of is not null")
    rows = rows.select("file", "line", *[F.col(f"_of.{c}").alias(c) for c in DETAILS], "FuelCode", "Price", F.col("_of.line").alias("_station"), "PriceUpdatedDate").withColumn("at", text.parse_date(F.col("PriceUpdatedDate")))
    rows = rows.join(file_month(rows), "file")
    day = text.swap_day_month(F.col("at"), F.col("month"), F.current_date())
    stamp = F.when(day.isNotNull(), F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.hour("at"), F.minute("at"), F.second("at").cast("decimal(8,6)")))
    rows = rows.withColumn("stamp", stamp)
    # consecutive rows of one name are one station
    other = F.coalesce((F.col(RAW[0]) != F.lag(RAW[0]).over(above)).cast("int"), F.lit(0))
    rows = rows.withColumn("_block", F.sum(other).over(above))
    same = Window.partitionBy("file", "_block").orderBy("line")
    rows = rows.withColumn("stamp", F.when(blank("PriceUpdatedDate"), F.last("stamp", ignorenulls=True).over(same)).otherwise(F.col("stamp")))
    clean = rows.select(
        "file", "line", F.col(RAW[0]).alias("name"), F.col("Address").alias("address"), text.title(F.nullif(F.trim("Suburb"), F.lit(""))).alias("suburb"), text.clean_postcode(F.col("Postcode"), F.col("Address")).alias("postcode"),
        F.coalesce(F.nullif(F.trim("Brand"), F.lit("")), text.brand_by_prefix(F.col(RAW[0]), brands, None)).alias("brand"), F.nullif(F.trim("FuelCode"), F.lit("")).alias("fuel_code"), "stamp", text.clean_price(F.col("Price")).alias("price"),
    ).dropna()
    last = Window.partitionBy("file", "name", "address", "brand", "fuel_code", F.to_date("stamp")).orderBy(F.desc("stamp"), "line")
    return clean.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("name", "address", "suburb", "postcode", "brand", "fuel_code", F.to_date("stamp").alias("price_date"), "price")


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """Rows of API documents {stations: [brand, code, name, address, location], prices: [stationcode, fueltype, price, lastupdated]}.

    (station_code, name, address, suburb, postcode, brand, fuel_code, price): each price with its station; prices of
    unknown stations are left out. A file is one document; stations are known within it.
    """
    station = "brand: string, code: string, name: string, address: string, location: struct<latitude: double, longitude: double>"
    price = "stationcode: string, fueltype: string, price: double, lastupdated: string"
    doc = spark.read.schema(f"stations array<struct<{station}>>, prices array<struct<{price}>>").option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    stations = doc.select("file", F.inline("stations")).select("file", F.col("code").alias("stationcode"), "name", "address", "brand")
    a = F.col("address")
    rows = doc.select("file", F.inline("prices")).join(stations, ["file", "stationcode"])
    return rows.select(F.col("stationcode").cast("long").alias("station_code"), "name", "address", F.coalesce(text.suburb_of(a), F.lit("")).alias("suburb"), F.coalesce(text.postcode_of(a), F.lit("")).alias("postcode"), "brand", F.col("fueltype").alias("fuel_code"), "price")


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


def search(stations: DataFrame, terms: list[str]) -> DataFrame:
    """Stations that match any term: a number its code, other words a part of its name or council in any case."""
    def one(term: str):
        if term.isdigit() and len(term) < 6:
            return F.col("station_code") == int(term)
        return F.col("name").ilike(f"%{term}%") | F.col("council").ilike(f"%{term}%")

    return stations.where(reduce(lambda a, b: a | b, map(one, terms))).select("station_code", "name", "council")


def resolve(groups: list[str], name: str) -> str:
    """The group of that name, else the only one that contains it, in any case; ambiguity is an error."""
    exact = [g for g in groups if g.lower() == name.lower()]
    found = exact or [g for g in groups if name.lower() in g.lower()]
    if len(found) != 1:
        raise ValueError(f"{name!r} matches {found or 'nothing'}")
    return found[0]
