"""Cross-section operators: ranks, buckets, scores and picks within a date."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean, nulls unranked."""
    w, ties = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()), Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def percentile_rank(value: str, *by: str) -> Column:
    return average_rank(value, *by) / F.count(value).over(Window.partitionBy(*by))


def first_rank(value: str, *by: str, tie: str = "ticker", descending: bool = False) -> Column:
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))


def minimum_rank(value: str, *by: str) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))


def buckets(df: DataFrame, value: str, q: int, by: str = "date", tie: str = "ticker", name: str = "bucket") -> DataFrame:
    """Quantile buckets 1..q of first-tie ranks, as equal-width cuts of the rank's range."""
    rows = df.withColumn("_r", first_rank(value, by, tie=tie)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    cut = F.ceil((F.col("_r") - 1) * q / F.nullif(F.col("_n") - 1, F.lit(0)))
    return rows.withColumn(name, F.greatest(F.lit(1), F.coalesce(cut, F.lit(1))).cast("int")).drop("_r", "_n")


def z_score(value: str, *by: str) -> Column:
    """Within-group z with the population deviation; 0 where that is 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(F.col(value).isNotNull(), F.coalesce(F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd), F.lit(0.0)))


def capped_top(df: DataFrame, score: str, n: int, cap: float = 0.5, by: str = "date", sector: str = "sector", floor: int = 1) -> DataFrame:
    """The n best of each date with at most max(floor, n * cap) of a sector: the same picks as going down the list greedily."""
    most = max(floor, int(n * cap))
    rows = df.filter(F.col(score).isNotNull()).withColumn("_s", first_rank(score, by, sector, descending=True)).filter(F.col("_s") <= most)
    return rows.withColumn("pick", first_rank(score, by, descending=True)).filter(F.col("pick") <= n).drop("_s")


def stable_first_top(df: DataFrame, score: str, n: int, cap: float = 0.5, by: str = "date", least: int = 5) -> DataFrame:
    """Stable names first, then fifth-bucket names that are not stable; nothing for a date with fewer rows than least."""
    rows = buckets(df.filter(F.col(score).isNotNull()), score, 5, by).withColumn("_n", F.count("*").over(Window.partitionBy(by))).filter(F.col("_n") >= least)
    rows = rows.filter(F.col("stable") | (F.col("bucket") == 5)).withColumn("pool", F.when(F.col("stable"), 0).otherwise(1))
    order = [F.col("pool"), F.col(score).desc(), F.col("ticker")]
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy(by, "sector").orderBy(*order))).filter(F.col("_s") <= int(n * cap))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("pick") <= n).drop("_s", "_n")


def lowest(df: DataFrame, value: str, n: int, by: str = "date") -> DataFrame:
    return df.filter(F.col(value).isNotNull()).withColumn("pick", first_rank(value, by)).filter(F.col("pick") <= n)


def top_fraction(df: DataFrame, score: str, share: float, by: str = "date") -> DataFrame:
    rows = df.filter(F.col(score).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    return rows.withColumn("pick", first_rank(score, by, descending=True)).filter(F.col("pick") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_n")


def rank_blend(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Long predictions (model, date, ticker, pred) and weights (model, weight) to the weighted mean percentile rank."""
    ranked = predictions.withColumn("pct", percentile_rank("pred", "model", "date"))
    return ranked.join(F.broadcast(weights), "model").groupBy("date", "ticker").agg(F.sum(F.col("weight") * F.col("pct")).alias("blend"), F.count("*").alias("models"))


def ic_weights(ic: DataFrame, method: str = "relu", tau: float = 0.05, on_empty: str = "equal") -> DataFrame:
    """Weights of models from their mean IC: relu (equal or null where none is positive) or softmax."""
    everything = Window.partitionBy(F.lit(0))  # one row a model
    if method == "softmax":
        power = F.exp((F.col("ic") - F.max("ic").over(everything)) / tau)
        return ic.select("model", "ic", (power / F.sum(power).over(everything)).alias("weight"))
    part = F.greatest(F.col("ic"), F.lit(0.0))
    total = F.sum(part).over(everything)
    empty = 1.0 / F.count("*").over(everything) if on_empty == "equal" else F.lit(None).cast("double")
    return ic.select("model", "ic", F.when(total > 0, part / total).otherwise(empty).alias("weight"))
