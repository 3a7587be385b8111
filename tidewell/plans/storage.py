"""Queries over table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import joins, panel, storage, versions
from tidewell.registry import query
from tidewell.sources.adapter import Tables
from tidewell.sources.files import scratch


@query("""WITH old AS (SELECT * FROM prices WHERE station_code % 2 = 0), new AS (SELECT l_suppkey AS station_code, CAST(l_shipdate AS DATE) AS price_date, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT n.* FROM new n ANTI JOIN old USING (station_code, price_date)""")
def insert_ignore(t: Tables) -> DataFrame:
    old = t.prices.where("station_code % 2 = 0")
    new = t.table("lineitem").select(F.col("l_suppkey").alias("station_code"), F.to_date("l_shipdate").alias("price_date"), F.col("l_quantity").cast("long").alias("q"))
    return storage.insert_or_ignore(old, new, ["station_code", "price_date"], [F.desc("q")])


@query("""SELECT station_code, price_date, q FROM (SELECT l_suppkey AS station_code, CAST(l_shipdate AS DATE) AS price_date, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def keep_latest(t: Tables) -> DataFrame:
    """WN18: the latest row of a station and day."""
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("station_code"), F.to_date("l_shipdate").alias("price_date"), F.col("l_quantity").cast("long").alias("q"), "l_orderkey")
    return storage.latest_of_day(rows, ["station_code", "price_date"], "l_orderkey", "q").drop("l_orderkey")


@query("""WITH old AS (SELECT s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'old' END AS suburb FROM supplier WHERE s_suppkey % 5 <> 0),
new AS (SELECT s_suppkey AS code, 'New ' || s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'new' END AS suburb FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(n.code, o.code) AS code, CASE WHEN n.code IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(nullif(n.suburb, ''), o.suburb) AS suburb FROM old o FULL JOIN new n ON o.code = n.code""")
def upsert_merge(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    s = t.table("supplier")
    old = s.where(k % 5 != 0).select(k.alias("code"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "").otherwise("old").alias("suburb"))
    new = s.where(k % 2 == 0).select(k.alias("code"), F.concat(F.lit("New "), "s_name").alias("name"), F.when(k % 4 == 0, "").otherwise("new").alias("suburb"))
    return storage.upsert(old, new, "code", ["name"], ["suburb"])


@query("""WITH seen AS (SELECT c_nationkey AS k, arg_min(c_mktsegment, c_custkey) AS seg FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1)
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN coalesce(seg, NULL) ELSE n_name END AS suburb FROM nation LEFT JOIN seen ON k = n_nationkey""", prelude=False)
def backfill_blank(t: Tables) -> DataFrame:
    """SNK10: blanks take the first value seen."""
    n = t.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise(F.col("n_name")).alias("suburb"))
    c = t.table("customer").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment")).alias("suburb"), "c_custkey")
    return storage.backfill_first(n, c, "n_nationkey", "suburb", "c_custkey")


@query("""SELECT station_code, price_date, decicents FROM prices""")
def snapshot_replace(t: Tables) -> DataFrame:
    """SNK3: the snapshots of years are replaced, some twice; the others stay, nothing doubles."""
    path = scratch(t.spark, "snapshots")
    prices = t.prices.withColumn("snapshot", F.year("price_date"))
    storage.replace_snapshot(prices.withColumn("decicents", F.lit(0)), path, "snapshot")
    for odd in (0, 1, 0):
        storage.replace_snapshot(prices.where(F.col("snapshot") % 2 == odd), path, "snapshot")
    return storage.read(t.spark, path).select("station_code", "price_date", "decicents")


@query("""SELECT fold, station_code, CAST(count(*) AS BIGINT) AS n FROM scores GROUP BY 1, 2""")
def prediction_log(t: Tables) -> DataFrame:
    """SNK6, SNK9: predictions appended fold by fold to a log of fixed columns."""
    path = scratch(t.spark, "predictions")
    rows = t.scores.select("fold", "station_code", "price_date", F.col("label").cast("short").alias("label"), F.col("seed").cast("short").alias("seed"), F.col("proba").cast("float").alias("proba"))
    for fold in range(5):
        storage.append_log(rows.where(F.col("fold") == fold), path)
    return storage.read(t.spark, path).groupBy("fold", "station_code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT 'prices-' || strftime(price_date, '%Y-%m') AS file FROM prices WHERE price_date >= DATE '2000-01-01'""")
def load_ledger(t: Tables) -> DataFrame:
    """SNK7: files that the ledger lacks."""
    files = t.prices.select(F.concat(F.lit("prices-"), F.date_format("price_date", "yyyy-MM")).alias("file"), "price_date")
    ledger = files.where("price_date < '2000-01-01'").select("file").distinct()
    return storage.unloaded(files.select("file").distinct(), ledger)


@query("""SELECT l_orderkey AS order_key, l_suppkey AS station_code, CASE WHEN l_suppkey % 7 = 0 THEN 'patched' ELSE l_returnflag END AS arm, l_quantity AS litres FROM lineitem""", prelude=False)
def patch_rows(t: Tables) -> DataFrame:
    """SNK8: a column changed in some rows of a stored table, which is replaced in one step."""
    path, item = scratch(t.spark, "ledger"), t.table("lineitem")
    versions.replace(item.select(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("station_code"), F.col("l_returnflag").alias("arm"), F.col("l_quantity").alias("litres")), path)
    some = t.table("supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("station_code"), F.lit("patched").alias("arm"))
    versions.patch(t.spark, path, some, ["station_code"])
    return versions.read(t.spark, path)


@query("""WITH old AS (SELECT s_suppkey AS code, s_name AS name, 'address ' || s_suppkey AS address FROM supplier WHERE s_suppkey % 3 > 0),
new AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1000000 END AS code, 'New ' || s_name AS name, 'address ' || (s_suppkey - s_suppkey % 4) AS address FROM supplier),
free AS (SELECT n.*, row_number() OVER (PARTITION BY n.address ORDER BY n.code) AS k FROM new n LEFT JOIN old o USING (address) WHERE o.code IS NULL OR o.code = n.code)
SELECT code, coalesce(f.name, o.name) AS name, coalesce(f.address, o.address) AS address FROM old o FULL JOIN (SELECT * FROM free WHERE k = 1) f USING (code)""")
def upsert_unique(t: Tables) -> DataFrame:
    """SNK2: new rows whose address another key has already are left out, as are later ones of one address."""
    s, at = t.table("supplier"), lambda c: F.concat(F.lit("address "), c)
    code = F.col("s_suppkey")
    old = s.where("s_suppkey % 3 > 0").select(code.alias("code"), F.col("s_name").alias("name"), at(code).alias("address"))
    new = s.select(F.when(code % 2 == 0, code).otherwise(code + 1000000).alias("code"), F.concat(F.lit("New "), F.col("s_name")).alias("name"), at(code - code % 4).alias("address"))
    return storage.upsert(old, new, "code", ["name", "address"], [], unique="address")


@query("""SELECT station_code, price_date, max(decicents) AS decicents FROM daily GROUP BY 1, 2""")
def rewritten(t: Tables) -> DataFrame:
    """SNK4: a table written, and replaced as a whole by rows computed from it."""
    path = scratch(t.spark, "whole")
    versions.replace(t.prices, path)
    versions.replace(panel.gap_fill(versions.read(t.spark, path), t.last_day), path)
    return versions.read(t.spark, path)


@query("""SELECT strftime(price_date, '%Y') AS year, strftime(price_date, '%m') AS month, count(*) AS n FROM prices GROUP BY 1, 2""")
def partitioned_snapshots(t: Tables) -> DataFrame:
    """SNK11: CSV by year and month."""
    path = scratch(t.spark, "monthly")
    t.prices.withColumns({"year": F.date_format("price_date", "yyyy"), "month": F.date_format("price_date", "MM")}).repartition("year", "month").write.partitionBy("year", "month").option("header", True).csv(path)
    back = t.spark.read.schema("station_code long, price_date date, decicents int, year string, month string").option("header", True).csv(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM prices WHERE station_code IN (SELECT station_code FROM stations WHERE brand = 'ASIA')) AS matched, (SELECT count(*) FROM prices WHERE station_code NOT IN (SELECT station_code FROM stations WHERE brand = 'ASIA')) AS skipped""")
def semi_and_anti(t: Tables) -> DataFrame:
    """JN4, JN11: rows of known stations, and how many were skipped, in one pass."""
    known = t.stations.where("brand = 'ASIA'").select("station_code", F.lit(True).alias("known"))
    return t.prices.join(known, "station_code", "left").agg(F.count_if("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("skipped"))


@query("""SELECT count(f.extra) AS hits, count(*) FILTER (f.extra IS NULL) AS misses FROM prices p LEFT JOIN (SELECT station_code, price_date, decicents * 2 AS extra FROM prices WHERE station_code % 3 = 0) f USING (station_code, price_date)""")
def feature_provider(t: Tables) -> DataFrame:
    """JN19, JN10: an extra feature table joined by unique keys, with its hits and misses."""
    extra = t.prices.where("station_code % 3 = 0").withColumn("extra", F.col("decicents") * 2)
    return joins.hit_rate(joins.lookup(t.prices, extra, ["station_code", "price_date"], ["extra"]), "extra")


@query("""WITH snap AS (SELECT station_code, price_date, decicents FROM daily WHERE price_date = date_trunc('month', price_date)),
a AS (SELECT s.station_code, s.price_date, s.decicents, p.decicents AS known FROM snap s ASOF LEFT JOIN prices p ON s.station_code = p.station_code AND s.price_date >= p.price_date)
SELECT strftime(price_date, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (decicents = known) AS agreed, round(count(*) FILTER (decicents = known) / count(*), 4) AS ratio FROM a GROUP BY 1""")
def month_agreement(t: Tables) -> DataFrame:
    """AG44, JN5, JN18: a month's snapshot against the value as of its day."""
    snap = t.daily.where(F.col("price_date") == F.trunc("price_date", "month"))
    known = t.prices.select("station_code", F.col("price_date").alias("seen"), F.col("decicents").alias("known"))
    a = joins.asof(snap, known, "station_code", "price_date", "seen", ["known"])
    agreed = F.count_if(F.col("decicents") == F.col("known"))
    return a.groupBy(F.date_format("price_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), agreed.alias("agreed"), F.round(agreed / F.count(F.lit(1)), 4).alias("ratio"))
