"""Readers of cleaned histories and upstream prices on rows that don't load."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files

HEAD = "ServiceStationName,Address,Suburb,Postcode,Brand,FuelCode,PriceUpdatedDate,Price\n"


def test_cleaned_rows_say_why_they_were_skipped(spark, tmp_path):
    stations = spark.createDataFrame([(1, "1 Main St, Penrith NSW 2750"), (2, "2 Main Road"), (3, "2 MAIN RD.")], "station_code long, address string")
    lines = [
        "A,1 MAIN STREET  PENRITH,,2750,B,E10,2020-01-02T10:00:00,150.15", "A,1 Main St Penrith, Penrith ,2750,B,P98,2020-01-03,160", "A,9 Else St,Else,2000,B,E10,2020-01-02,150",
        "A,1 Main St Penrith,Other,2750,B,E10,,150", "A,2 Main Rd,,2750,B,E10,2020-01-02,none", "A,2 Main Rd,,2750,B,,2020-01-02,150", "A,2 Main Rd,,2750,B,,,none",
    ]
    (tmp_path / "a.csv").write_text(HEAD + "\n".join(lines) + "\n")
    prices, suburbs = files.read_cleaned(spark, str(tmp_path), stations)
    assert sorted(((r.station_code, r.fuel_code, r.price_date, r.decicents) for r in prices.where("skipped is null").collect()), key=repr) == [
        (1, "E10", dt.date(2020, 1, 2), 1502), (1, "P98", dt.date(2020, 1, 3), 1600)
    ]
    assert {r.skipped: r.rows for r in files.skip_counts(prices).collect()} == {None: 2, "address": 1, "date": 2, "price": 1, "fuel": 1}
    assert [tuple(r) for r in suburbs.collect()] == [(1, "Penrith")]
    assert {r.station_code for r in prices.where("skipped = 'fuel'").collect()} == {2}


def test_each_spelling_of_an_address_is_normalised_once(spark, tmp_path, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def plain(address):
        asked.add(1)
        return address.upper()

    monkeypatch.setattr(files.text, "normalise_address", plain)
    (tmp_path / "a.csv").write_text(HEAD + "".join(f"A,{i % 3} Main St,,2750,B,E10,2020-01-02,150\n" for i in range(600)))
    prices, _ = files.read_cleaned(spark, str(tmp_path), spark.createDataFrame([(1, "1 main st"), (2, "2 Main St")], "station_code long, address string"))
    assert {r.station_code: r["count"] for r in prices.groupBy("station_code").count().collect()} == {None: 200, 1: 200, 2: 200}
    assert asked.value < 30


def test_upstream_prices_need_their_city(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Day,Sydney,Perth\n2020-01-02,150.5,1\nMean,9,9\n,7,7\n3/1/2020,,2\n")
    assert sorted(tuple(r) for r in files.read_upstream(spark, str(tmp_path)).select("tgp_date", "tgp").collect()) == [(dt.date(2020, 1, 2), 150.5), (dt.date(2020, 1, 3), None)]
    assert [r.tgp for r in files.read_upstream(spark, str(tmp_path), "Perth").orderBy("tgp_date").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError, match="Hobart"):
        files.read_upstream(spark, str(tmp_path), "Hobart")
