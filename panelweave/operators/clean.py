"""Cleaning and contracts of bars and membership."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources.bars import PRIORITY


def ticker_name(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))


def rename_tickers(df: DataFrame, aliases: DataFrame, deny: list[str] | None = None) -> DataFrame:
    """aliases: old, new. Denied names keep theirs."""
    known = aliases.filter(~F.col("old").isin(deny or [])) if deny else aliases
    return df.join(known, df.ticker == known.old, "left").withColumn("ticker", F.coalesce("new", "ticker")).drop("old", "new")


def standard_columns(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """For each wanted name the first candidate that the table has."""
    found = {next(c for c in options if c in df.columns): want for want, options in names.items() if any(c in df.columns for c in options)}
    return df.withColumnsRenamed(found)


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def best_source(df: DataFrame, priority: dict[str, int] = PRIORITY) -> DataFrame:
    """One row a ticker and date: the source of the best priority, then its name."""
    order = F.lit(len(priority))
    for name, k in priority.items():
        order = F.when(F.col("source") == name, k).otherwise(order)
    w = Window.partitionBy("ticker", "date").orderBy(order, "source")
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def clean_bars(raw: DataFrame, start, end) -> DataFrame:
    """Valid rows of the period, one a ticker and date, prices filled from the close and consistent, with a flag for each repair."""
    rows = raw.withColumn("ticker", ticker_name(F.col("ticker"))).filter(F.col("date").isNotNull() & (F.col("ticker") != "") & (F.col("close") > 0))
    rows = best_source(rows.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))))
    rows = rows.withColumn("price_imputed", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull())
    rows = rows.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})
    rows = rows.withColumn("volume_missing", F.col("volume").isNull())
    rows = rows.withColumn("volume", F.bround(F.greatest(F.coalesce(F.col("volume").cast("double"), F.lit(0.0)), F.lit(0.0))).cast("long"))
    top, bottom = F.greatest("open", "high", "low", "close"), F.least("open", "high", "low", "close")
    rows = rows.withColumn("ohlc_inconsistent", (F.col("high") < top) | (F.col("low") > bottom))
    return rows.withColumn("_h", top).withColumn("_l", bottom).withColumn("high", F.col("_h")).withColumn("low", F.col("_l")).drop("_h", "_l")


def eligibility(df: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """eligible and a status, from member, volume and identified; blocked: tickers never eligible."""
    if blocked is not None:
        df = df.join(blocked.select("ticker").distinct().withColumn("_b", F.lit(True)), "ticker", "left").withColumn("blocked", F.coalesce("_b", F.lit(False))).drop("_b")
    else:
        df = df.withColumn("blocked", F.lit(False))
    status = F.when(~F.col("member"), "not_member").when(F.col("blocked"), "blocked").when(~F.coalesce(F.col("identified"), F.lit(True)), "unidentified").when(F.coalesce(F.col("volume"), F.lit(0)) <= 0, "no_trade").otherwise("eligible")
    return df.withColumn("status", status).withColumn("eligible", F.col("status") == "eligible")


def universe_contract(frame: DataFrame, pit: DataFrame) -> DataFrame:
    """Rows against snapshots (date, ticker, eligible, known_at): a note says why a row is not eligible.

    unmatched: no snapshot; known_late: none that was known by its date; no_trade; ineligible. Snapshots of one key count as one, eligible only if all are.
    """
    known = F.col("known_at") <= F.col("date")
    one = pit.groupBy("date", "ticker").agg(F.bool_and(F.when(known, F.col("eligible"))).alias("_e"), F.lit(True).alias("_s"))
    rows = frame.join(one, ["date", "ticker"], "left")
    note = F.when(F.col("_s").isNull(), "unmatched").when(F.col("_e").isNull(), "known_late").when(F.coalesce(F.col("volume"), F.lit(0)) <= 0, "no_trade").when(~F.col("_e"), "ineligible")
    return rows.withColumn("note", note).withColumn("eligible", F.col("note").isNull()).drop("_e", "_s")


def last_sector(df: DataFrame, order: str) -> DataFrame:
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(order)))).filter("_r = 1")
    return rows.select("ticker", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("UNKNOWN")).alias("sector"))


def common_sample(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose date and ticker every model has, rows dropped by model)."""
    models = predictions.select("model").distinct().count()
    shared = predictions.groupBy("date", "ticker").agg(F.countDistinct("model").alias("m")).filter(F.col("m") == models).select("date", "ticker")
    kept = predictions.join(shared, ["date", "ticker"], "left_semi")
    all_, some = predictions.groupBy("model").agg(F.count("*").alias("n_rows")), kept.groupBy("model").agg(F.count("*").alias("n_common"))
    report = all_.join(some, "model", "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))
    return kept, report.withColumn("n_dropped", F.col("n_rows") - F.col("n_common"))


def complete_windows(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows with all columns, on dates that have at least `least` such rows."""
    rows = df.filter(finite(*columns))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") >= least).drop("_n")


def complete_tickers(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Tickers with a bar on every session of the calendar."""
    n = calendar.count()
    return bars.join(F.broadcast(calendar.select("date")), "date", "left_semi").groupBy("ticker").agg(F.countDistinct("date").alias("n")).filter(F.col("n") == n).select("ticker")


def hand_off(df: DataFrame, allowed: list[str], future: tuple[str, ...] = ("future_", "target_", "label_")) -> DataFrame:
    bad = [c for c in allowed if c.startswith(future)]
    if bad:
        raise ValueError(f"future columns in a hand-off: {bad}")
    return df.select(*allowed)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def validate(bars: DataFrame, universe: DataFrame, failures: DataFrame) -> DataFrame:
    """(rule, severity, n): violations of each rule of the final table."""
    counts = bars.agg(
        F.count("*").alias("rows"),
        *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in ("date", "ticker", "close", "volume")),
        F.count(F.when(F.col("close") <= 0, 1)).alias("close_not_positive"),
        F.count(F.when(F.col("volume") < 0, 1)).alias("negative_volume"),
        F.count(F.when((F.col("high") < F.col("low")), 1)).alias("high_below_low"),
    )
    names = [c for c in counts.columns if c != "rows"]
    rules = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.lit("error").alias("severity"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*")
    dup = duplicates(bars, ["ticker", "date"]).agg(F.count("*").alias("n")).select(F.lit("duplicate_key").alias("rule"), F.lit("error").alias("severity"), "n")
    have = bars.select("ticker").distinct()
    lost = universe.select("ticker").distinct().join(have, "ticker", "left_anti").join(failures.select("ticker").distinct(), "ticker", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unaccounted_ticker").alias("rule"), F.lit("error").alias("severity"), "n")
    both = have.join(failures.select("ticker").distinct(), "ticker", "left_semi").agg(F.count("*").alias("n")).select(F.lit("failed_but_present").alias("rule"), F.lit("warning").alias("severity"), "n")
    return rules.unionByName(dup).unionByName(lost).unionByName(both)


def calendar_contract(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    bad = bars.agg(F.count(F.when(~((F.col("close") > 0) & (F.col("close") < float("inf"))), 1)).alias("n")).select(F.lit("close_not_positive").alias("rule"), "n")
    off = bars.join(F.broadcast(calendar.select("date")), "date", "left_anti").agg(F.count("*").alias("n")).select(F.lit("date_off_calendar").alias("rule"), "n")
    return bad.unionByName(off)


def constant_by_date(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("date").agg(F.countDistinct(column).alias("n_values")).filter("n_values > 1")


def profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.count("*") - F.countDistinct("ticker", "date")).alias("n_duplicates"), F.count(F.when(F.col("close").isNull(), 1)).alias("n_null_close"), F.count(F.when(F.col("close") <= 0, 1)).alias("n_not_positive"), F.round(F.percentile("close", F.lit(0.5)), 6).alias("median_close"))


def membership_contract(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count(F.when(F.col("ticker").isNull(), 1)).alias("null_ticker"), F.count(F.when(F.col("start_date").isNull(), 1)).alias("null_start"), F.count(F.when(F.col("end_date") <= F.col("start_date"), 1)).alias("end_not_after_start"))
