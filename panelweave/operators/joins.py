"""Joins of panels: calendars, intervals, as-of and snapshot pairs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """member: any interval [start_date, end_date) of the ticker holds the date. Equi-join on ticker with a range on top."""
    spans = intervals.select(F.col("ticker").alias("_t"), "start_date", "end_date")
    inside = (F.col("ticker") == F.col("_t")) & (F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") < F.col("end_date")))
    hit = bars.select("ticker", "date").distinct().join(spans, inside, "left_semi").withColumn("_m", F.lit(True))
    return bars.join(hit, ["ticker", "date"], "left").withColumn("member", F.coalesce("_m", F.lit(False))).drop("_m")


def overlapping(intervals: DataFrame, start, end) -> DataFrame:
    """Tickers with any membership that touches [start, end)."""
    return intervals.filter((F.col("start_date") < F.lit(end).cast("date")) & (F.col("end_date").isNull() | (F.col("end_date") > F.lit(start).cast("date")))).select("ticker").distinct()


def as_of(left: DataFrame, history: DataFrame, value: str, default=None, key: str = "ticker") -> DataFrame:
    """The last value of history at or before each row's date: one window over both tables, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(history.schema[value].dataType)).withColumn("_k", F.lit(1)).unionByName(history.select(key, "date", F.col(value).alias("_v"), F.lit(0).alias("_k")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_k = 1").drop("_v", "_k")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def densify(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every ticker on every session, gaps null, with observed; calendar: date and session_no (and market columns)."""
    grid = bars.select("ticker").distinct().crossJoin(F.broadcast(calendar))
    return grid.join(bars.withColumn("_o", F.lit(True)), ["ticker", "date"], "left").withColumn("observed", F.coalesce("_o", F.lit(False))).drop("_o")


def attach_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    return df.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))


def paired(case: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    a, b = case.select(key, F.col(value).alias("case_value")), base.select(key, F.col(value).alias("base_value"))
    return a.join(b, key, "full").withColumn("difference", F.col("case_value") - F.col("base_value"))


def snapshot_pairs(states: DataFrame, gap: int) -> DataFrame:
    """State at a session and `gap` sessions later, by ticker."""
    later = states.select("ticker", (F.col("session_no") - gap).alias("session_no"), F.col("state").alias("state_to"))
    return states.withColumnRenamed("state", "state_from").join(later, ["ticker", "session_no"])


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(actual, keys, "left_anti")


def outside_shocks(spans: DataFrame, shocks: DataFrame) -> DataFrame:
    """Spans (l, r) that touch no shock interval (start, end); shocks are a short list of events."""
    return spans.join(F.broadcast(shocks), (F.col("l") <= F.col("end")) & (F.col("r") >= F.col("start")), "left_anti")


def holdings_overlap(holdings: DataFrame) -> DataFrame:
    """Names that pairs of models hold on the same date, and the number of such dates; 0 for a pair that shares none."""
    a, b = holdings.select("date", "ticker", F.col("model").alias("a")), holdings.select("date", "ticker", F.col("model").alias("b"))
    common = a.join(b, ["date", "ticker"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"), F.countDistinct("date").alias("n_dates"))
    models = holdings.select("model").distinct()
    pairs = models.select(F.col("model").alias("a")).join(F.broadcast(models.select(F.col("model").alias("b"))), F.col("a") < F.col("b"))  # one row a model
    return pairs.join(common, ["a", "b"], "left").fillna(0, ["n_common", "n_dates"])


def attach_settlements(labels: DataFrame, settlements: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(labels filled from verified settlements of equal keys and dates, conflicts with observed labels)."""
    s = settlements.filter("verified").select("date", "ticker", F.col("entry_date").alias("_e"), F.col("exit_date").alias("_x"), F.col("simple_return").alias("_r"))
    rows = labels.join(s, ["date", "ticker"], "left")
    same = (F.col("_e") == F.col("entry_date")) & (F.col("_x") == F.col("exit_date"))
    clash = F.col("_r").isNotNull() & (~same | (F.col("simple_return").isNotNull() & (F.abs(F.col("_r") - F.col("simple_return")) > tolerance)))
    return rows.withColumn("simple_return", F.coalesce("simple_return", F.when(same, F.col("_r")))).drop("_e", "_x", "_r"), rows.filter(clash).select("date", "ticker", "simple_return", F.col("_r").alias("settled"))
