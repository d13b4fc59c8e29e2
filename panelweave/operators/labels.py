"""Forward labels that know when they became available, folds and schedules."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, drawdown
from panelweave.operators.xsec import z_score


def horizon_labels(panel: DataFrame, calendar: DataFrame, horizon: int, lag: int = 1) -> DataFrame:
    """Returns from session t+lag to t+lag+horizon on the calendar, beside the market's.

    Needs the densified panel; mature tells that the calendar reaches the exit. available_at is the exit's date.
    """
    sessions = calendar.select("session_no", F.col("date").alias("_d"), "m_close")
    entry = sessions.select((F.col("session_no") - lag).alias("session_no"), F.col("_d").alias("entry_date"), F.col("m_close").alias("_m0"))
    leave = sessions.select((F.col("session_no") - lag - horizon).alias("session_no"), F.col("_d").alias("exit_date"), F.col("m_close").alias("_m1"))
    w = by_ticker()
    rows = panel.withColumn("_c0", F.lead("close", lag).over(w)).withColumn("_c1", F.lead("close", lag + horizon).over(w))
    rows = rows.join(F.broadcast(entry), "session_no", "left").join(F.broadcast(leave), "session_no", "left")
    simple, market = F.col("_c1") / F.col("_c0") - 1, F.col("_m1") / F.col("_m0") - 1
    rows = rows.withColumn("horizon", F.lit(horizon)).withColumn("target_simple", simple).withColumn("target_log", F.when(F.col("_c1") > 0, F.log(F.col("_c1") / F.col("_c0")))).withColumn("target_market", market)
    rows = rows.withColumn("target_excess", simple - market).withColumn("mature", F.col("exit_date").isNotNull()).withColumn("available_at", F.col("exit_date"))
    status = F.when(~F.col("mature"), "immature").when(F.col("_c0").isNull(), "no_entry").when(F.col("_c1").isNull(), "no_exit").otherwise("observed")
    return rows.withColumn("label_status", status).drop("_c0", "_c1", "_m0", "_m1")


def forward_outcomes(bars: DataFrame, horizon: int, year: int, start: int = 1) -> DataFrame:
    """Volatility of simple returns and worst drawdown over a ticker's rows t+start .. t+start+horizon; start 0 includes the signal's row.

    Null where the rows run out or a price among them is missing, not finite or not positive.
    """
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(start, start + horizon)
    rows = bars.withColumn("_p", F.transform(F.collect_list(F.struct("close")).over(w), lambda x: x["close"]))
    full = (F.size("_p") == horizon + 1) & F.forall("_p", lambda x: F.coalesce((x > 0) & (x < float("inf")), F.lit(False)))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.element_at("_p", i + 1) / F.element_at("_p", i) - 1)
    mean = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / horizon
    var = F.aggregate("_r", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_a"), 2)) / (horizon - 1)
    rows = rows.withColumn("_r", F.when(full, pairs)).withColumn("_a", mean)
    return rows.withColumn("future_vol", F.sqrt(var * year)).withColumn("future_mdd", F.when(full, drawdown(F.col("_p")))).drop("_p", "_r", "_a")


def future_risk(df: DataFrame, share: float) -> DataFrame:
    """Score of a date's outcomes (z of volatility less z of drawdown, halved) and whether it is in the riskiest share."""
    rows = df.withColumn("risk_score", F.round((z_score("future_vol", "date") - z_score("future_mdd", "date")) / 2, 10))
    cut = F.expr(f"percentile(risk_score, {1 - share})").over(Window.partitionBy("date"))
    return rows.withColumn("future_risky", F.col("risk_score") >= F.round(cut, 10))


def graded(score: str, grades: int = 5, tie: str = "ticker"):
    """Relevance 0..grades-1 by first-tie rank within the date."""
    by = Window.partitionBy("date")
    r = F.row_number().over(by.orderBy(F.col(score), F.col(tie)))
    return F.least(F.greatest(F.ceil(r * grades / F.count("*").over(by)), F.lit(1)), F.lit(grades)).cast("int") - 1


def row_shift_target(bars: DataFrame, steps: int, most_days: int | None = None) -> DataFrame:
    """Return over the next `steps` observed rows with its end date; spans of more than most_days lose it."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars.withColumn("target_ret", F.lead("close", steps).over(w) / F.col("close") - 1).withColumn("target_end", F.lead("date", steps).over(w)).withColumn("span_days", F.datediff("target_end", "date"))
    return rows.withColumn("target_ret", F.when(F.col("span_days") <= most_days, F.col("target_ret"))) if most_days else rows


def label_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year"), "label_status").agg(F.count("*").alias("n"))


def purged(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Training rows of each fold (fold, day): dated before the day and with a label that ended and was known before it."""
    f = F.broadcast(folds.select("fold", "day"))
    return rows.join(f, (F.col("date") < F.col("day")) & (F.col("exit_date") < F.col("day")) & (F.col("available_at") < F.col("day")) & F.col("eligible"))


def thinned(df: DataFrame, every: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date")
    dates = df.select(*by, "date").distinct().withColumn("_k", F.row_number().over(w)).filter((F.col("_k") - 1) % every == 0).drop("_k")
    return df.join(F.broadcast(dates), [*by, "date"], "left_semi")


def recent(df: DataFrame, day: str = "day", months: int = 36) -> DataFrame:
    return df.filter(F.col("date") >= F.add_months(F.col(day), -months))


def leaks(df: DataFrame, split) -> DataFrame:
    before = F.col("date") < F.lit(split).cast("date")
    return df.agg(F.count(F.when(before, 1)).alias("n_before"), F.count(F.when(before & (F.col("exit_date") >= F.lit(split).cast("date")), 1)).alias("n_leaked"))


def schedule(calendar: DataFrame, first: int, step: int, horizon: int, lag: int = 1) -> DataFrame:
    """Every step-th session from `first` whose exit the calendar reaches."""
    last = calendar.agg(F.max("session_no").alias("_last"))
    rows = calendar.crossJoin(F.broadcast(last)).filter((F.col("session_no") >= first) & ((F.col("session_no") - first) % step == 0) & (F.col("session_no") + lag + horizon <= F.col("_last")))
    return rows.drop("_last").withColumn("period", ((F.col("session_no") - first) / step).cast("int"))


def expanding_folds(calendar: DataFrame, n_splits: int, purge: int) -> DataFrame:
    """(fold, train_end_no, test_first_no, test_last_no) of equal date blocks with `purge` sessions between train and test."""
    n = calendar.agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("n") / (n_splits + 1)))
    rows = n.select(F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold"), "n", "block")
    return rows.select("fold", (F.col("fold") * F.col("block") - purge).alias("train_end_no"), (F.col("fold") * F.col("block") + 1).alias("test_first_no"), F.when(F.col("fold") == n_splits, F.col("n")).otherwise((F.col("fold") + 1) * F.col("block")).alias("test_last_no"))


def yearly_snapshots(calendar: DataFrame, first: int = 120, every: int = 20) -> DataFrame:
    w = Window.partitionBy(F.year("date")).orderBy("date")
    rows = calendar.withColumn("_k", F.row_number().over(w))
    return rows.filter((F.col("_k") <= first) & ((F.col("_k") - 1) % every == 0)).drop("_k")


def train_audit(train: DataFrame) -> DataFrame:
    return train.groupBy("fold", "day").agg(F.count("*").alias("n_train"), F.max("exit_date").alias("last_exit"), F.max("available_at").alias("last_available"), F.countDistinct("date").alias("n_dates"))
