"""Roll-ups and reports: coverage, transitions, policies, regimes, explanations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.stats import draw
from panelweave.operators.xsec import percentile_rank


def ticker_coverage(bars: DataFrame, start, end, short: int) -> DataFrame:
    """Rows, first and last date, sources and the share of business days of each ticker."""
    days = F.size(F.filter(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1)), lambda d: F.weekday(d) < 5))
    rows = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return rows.withColumn("coverage", F.col("n_rows") / days).withColumn("short_history", F.col("n_rows") < short)


def member_coverage(members: DataFrame, priced: DataFrame) -> DataFrame:
    """Expected members of each date against those with a price, and the missing names."""
    rows = members.select("date", "ticker").distinct().join(priced.select("date", "ticker").distinct().withColumn("_p", F.lit(True)), ["date", "ticker"], "left")
    gone = F.array_join(F.array_sort(F.collect_set(F.when(F.col("_p").isNull(), F.col("ticker")))), ",")
    return rows.groupBy("date").agg(F.count("*").alias("expected"), F.count("_p").alias("priced"), gone.alias("missing"))


def group_risk(df: DataFrame, group: str, breach: float) -> DataFrame:
    """Future outcomes by group: means, share with a drawdown beyond the breach, risky rate."""
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.avg("future_vol").alias("mean_future_vol"), F.avg("future_mdd").alias("mean_future_mdd"), F.avg((F.col("future_mdd") <= breach).cast("double")).alias("mdd_breach"), F.avg(F.col("future_risky").cast("double")).alias("future_risky_rate"))


def policy_summary(df: DataFrame, policies: list[str], breach: float) -> DataFrame:
    """For each boolean policy column: selected rows, retention, false-stable rate, breach share, mean drawdown."""
    out = None
    for p in policies:
        part = df.agg(F.count(F.when(F.col(p), 1)).alias("selected"), F.avg(F.col(p).cast("double")).alias("retention"), F.avg(F.when(F.col(p), F.col("future_risky").cast("double"))).alias("false_stable_rate"), F.avg(F.when(F.col(p), (F.col("future_mdd") <= breach).cast("double"))).alias("mdd_breach"), F.avg(F.when(F.col(p), F.col("future_mdd"))).alias("mean_future_mdd")).select(F.lit(p).alias("policy"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def transitions(pairs: DataFrame, states: list) -> DataFrame:
    """Counts and row shares of state_from to state_to."""
    rows = pairs.groupBy("state_from").pivot("state_to", states).count().na.fill(0)
    total = sum((F.col(str(s)) for s in states[1:]), F.col(str(states[0])))
    return rows.select("state_from", *(F.col(str(s)).alias(f"n_{s}") for s in states), *((F.col(str(s)) / total).alias(f"share_{s}") for s in states))


def regimes(market: DataFrame, r: str, trend: int, short: int, quantile: float = 0.75, least: int = 12, vol: str | None = None) -> DataFrame:
    """up/down by compounded trend and calm/wild by volatility against the earlier quantile of volatility, known the session before.

    r holds log returns; vol may name another column for the volatility, as simple returns.
    """
    v = vol or r
    w = Window.partitionBy(F.lit(0)).orderBy("session_no")
    n = lambda k: w.rowsBetween(-(k - 1), 0)
    rows = market.withColumn("trend", F.when(F.count(r).over(n(trend)) == trend, F.exp(F.sum(r).over(n(trend))) - 1)).withColumn("vol", F.when(F.count(v).over(n(short)) == short, F.stddev_samp(v).over(n(short))))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cut", F.when(F.count("vol").over(past) >= least, F.percentile("vol", F.lit(quantile)).over(past)))
    name = F.concat(F.when(F.col("trend") >= 0, "up").otherwise("down"), F.lit("_"), F.when(F.col("vol") > F.col("cut"), "wild").otherwise("calm"))
    return rows.withColumn("regime", F.when(F.col("trend").isNotNull() & F.col("cut").isNotNull(), name))


def warnings(df: DataFrame, ratio: str, downside: str, at: float = 0.8) -> DataFrame:
    return df.withColumn("acceleration_warning", percentile_rank(ratio, "date") >= at).withColumn("downside_warning", percentile_rank(downside, "date") >= at)


def offset_sweep(df: DataFrame, target: str, step: int, pick: Column) -> DataFrame:
    """Mean return of picked rows for each rebalance offset 0..step-1."""
    rows = df.withColumn("offset", F.pmod(F.col("session_no"), F.lit(step)))
    return rows.groupBy("offset").agg(F.avg(F.when(pick, F.col(target))).alias("picked"), F.avg(target).alias("equal"), F.countDistinct("date").alias("n_dates"))


def offset_summary(sweep: DataFrame) -> DataFrame:
    """Over all offsets of a sweep: how often the picks beat equal weights, and the 5th, 50th and 95th percentile of the difference."""
    rows = sweep.filter("picked is not null and equal is not null").withColumn("_d", F.round(F.col("picked") - F.col("equal"), 12))
    return rows.agg(F.count("*").alias("n_offsets"), F.avg((F.col("_d") > 0).cast("double")).alias("win_share"), *(F.percentile("_d", F.lit(q)).alias(f"excess_p{round(100 * q)}") for q in (0.05, 0.5, 0.95)))


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of their keys: the same on any partitioning."""
    return df.orderBy(draw(F.lit(str(seed)), *keys), *keys).limit(n)


def block_means(series: DataFrame, value: str, size: int, order: str = "date") -> DataFrame:
    """Means of complete consecutive blocks of an ordered series."""
    rows = series.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).withColumn("block", F.floor(F.col("_i") / size).cast("int"))
    return rows.groupBy("block").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).filter(F.col("n") == size)


def explanation(score: str, parts: dict[str, str]) -> Column:
    """A sentence for each row from its score and parts; missing parts are left out."""
    said = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label} "), F.format_string("%.2f", F.col(c).cast("double")))) for c, label in parts.items()]
    return F.concat_ws("; ", F.concat(F.lit("score "), F.format_string("%.2f", F.col(score).cast("double"))), *said)
