"""The domain's tables as views over the given ones, and the same views in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import panel, storage

PRELUDE = """
WITH RECURSIVE stations AS (
  SELECT s_suppkey AS station_code, s_name AS name, n_name AS council, r_name AS brand
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prices AS (
  SELECT l_suppkey AS station_code, CAST(l_shipdate AS DATE) AS price_date,
         CAST(min(1500 + CAST(round(l_extendedprice * 100) AS BIGINT) % 500) AS INTEGER) AS decicents
  FROM lineitem GROUP BY 1, 2),
last_day AS (SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem),
spans AS (
  SELECT station_code, price_date, decicents,
         coalesce(lead(price_date) OVER (PARTITION BY station_code ORDER BY price_date), (SELECT d FROM last_day) + 1) AS next_date,
         lead(price_date) OVER (PARTITION BY station_code ORDER BY price_date) IS NULL AS is_last
  FROM prices),
daily AS (
  SELECT station_code, CAST(u AS DATE) AS price_date, decicents
  FROM (SELECT station_code, decicents, unnest(generate_series(CAST(price_date AS TIMESTAMP),
          CAST(CASE WHEN next_date - CAST(is_last AS INTEGER) - price_date <= 28 THEN next_date - 1 ELSE price_date END AS TIMESTAMP), INTERVAL 1 DAY)) AS u
        FROM spans)),
panel AS (SELECT * FROM daily JOIN stations USING (station_code)),
metro AS (SELECT price_date, avg(decicents) / 10 AS price FROM daily GROUP BY 1),
tgp AS (SELECT CAST(o_orderdate AS DATE) AS tgp_date, CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / 100000 AS tgp FROM orders GROUP BY 1),
scores AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_suppkey AS station_code, CAST(l_shipdate AS DATE) AS price_date,
         (l_orderkey * 7919 + l_linenumber * 31) % 1000 / 1000.0 AS proba,
         CAST((l_orderkey * 7919 + l_linenumber * 31) % 1000 + l_partkey * 13 % 600 > 900 AS INTEGER) AS label,
         CAST(l_orderkey % 5 AS INTEGER) AS fold, CAST(l_partkey % 3 AS INTEGER) AS seed, l_quantity AS litres, l_extendedprice / 100 AS price, l_returnflag AS arm
  FROM lineitem)
"""


class Tables:
    """Lazy access to the given tables by name, and to the domain's views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stations(self) -> DataFrame:
        """(station_code, name, council, brand). nation and region are fixed dimensions of 25 and 5 rows."""
        s, n, r = self.table("supplier"), F.broadcast(self.table("nation")), F.broadcast(self.table("region"))
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(F.col("s_suppkey").alias("station_code"), F.col("s_name").alias("name"), F.col("n_name").alias("council"), F.col("r_name").alias("brand"))

    @cached_property
    def prices(self) -> DataFrame:
        """(station_code, price_date, decicents): price events, whole tenths of a cent."""
        tenths = 1500 + F.round(F.col("l_extendedprice") * 100).cast("long") % 500
        events = self.table("lineitem").select(F.col("l_suppkey").alias("station_code"), F.to_date("l_shipdate").alias("price_date"), tenths.cast("int").alias("decicents"))
        return events.groupBy("station_code", "price_date").agg(F.min("decicents").alias("decicents"))

    @cached_property
    def last_day(self) -> DataFrame:
        return self.table("lineitem").agg(F.max(F.to_date("l_shipdate")).alias("end_date"))

    @cached_property
    def daily(self) -> DataFrame:
        """(station_code, price_date, decicents): the gap-filled panel."""
        return panel.gap_fill(self.prices, self.last_day)

    @cached_property
    def stored_daily(self) -> DataFrame:
        """daily, filled once for queries that read it several times."""
        return storage.stored(self.daily, "daily")

    @cached_property
    def panel(self) -> DataFrame:
        return self.stored_daily.join(self.stations, "station_code")  # read more than once by most

    @cached_property
    def metro(self) -> DataFrame:
        return panel.mean_price(self.daily)

    @cached_property
    def tgp(self) -> DataFrame:
        """(tgp_date, tgp): an upstream series with gaps."""
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("tgp_date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count(F.lit(1)) / 100000).alias("tgp"))

    @cached_property
    def scores(self) -> DataFrame:
        """Scored decisions whose probability and label are fixed functions of the keys, so that metrics have an oracle."""
        k = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 1000
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("station_code"), F.to_date("l_shipdate").alias("price_date"),
            (k / 1000.0).alias("proba"), (k + F.col("l_partkey") * 13 % 600 > 900).cast("int").alias("label"),
            (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_partkey") % 3).cast("int").alias("seed"), F.col("l_quantity").alias("litres"), (F.col("l_extendedprice") / 100).alias("price"), F.col("l_returnflag").alias("arm"),
        )
