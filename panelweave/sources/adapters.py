"""Panels of bars derived from sales tables, in the schemas that the operators expect."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame, keys: list[str]) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.min_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber", price.alias("price")))
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return lines.groupBy(*keys).agg(
        F.round(first, 6).alias("open"),
        F.round(F.max(price), 6).alias("high"),
        F.round(F.min(price), 6).alias("low"),
        F.round(money / F.sum("l_quantity"), 6).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def monthly_bars(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One bar a supplier and month."""
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.trunc("l_shipdate", "month")).withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    return _bars(lines, ["ticker", "date", *extra])


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a brand and week."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return _bars(lines.withColumn("date", F.date_trunc("week", "l_shipdate").cast("date")).withColumn("ticker", F.col("p_brand")), ["ticker", "date"])


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's close by month; its dates number the sessions."""
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.trunc("l_shipdate", "month"))
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    rows = lines.groupBy("date").agg(F.round(money / F.sum("l_quantity"), 6).alias("m_close"))
    return rows.withColumn("session_no", F.row_number().over(Window.orderBy("date")))  # one row a session


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static sector (region) of each supplier."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"), F.col("r_regionkey").alias("sector_key"))


def membership(spark: SparkSession, sf_dir: str, calendar: DataFrame) -> DataFrame:
    """Half-open intervals [start_date, end_date) of index membership, by supplier number."""
    spans = spark.createDataFrame([(0, 1, None), (1, 10, 40), (1, 50, None), (2, 1, 60), (3, 20, None)], "r int, first int, last int")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), (F.col("s_suppkey") % 5).alias("r"))
    a = calendar.select(F.col("session_no").alias("first"), F.col("date").alias("start_date"))
    b = calendar.select(F.col("session_no").alias("last"), F.col("date").alias("end_date"))
    return s.join(F.broadcast(spans), "r").join(F.broadcast(a), "first").join(F.broadcast(b), "last", "left").select("ticker", "start_date", "end_date")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order value by month, one column a priority."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    cols = [F.round(F.sum(F.when(F.col("o_orderpriority").startswith(str(k)), price)).cast("double") / F.count(F.when(F.col("o_orderpriority").startswith(str(k)), 1)), 6).alias(f"x{k}") for k in range(1, 6)]
    return o.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(*cols)
