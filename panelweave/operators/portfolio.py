"""Backtests, settlement of price paths, chained wealth and attribution."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.xsec import buckets


def backtest(df: DataFrame, pred: str, target: str, q: int = 5, cost_bps: float = 10.0, least: int = 5) -> DataFrame:
    """By rebalance date: net return of the top bucket, bottom, equal weight and long-short."""
    rows = buckets(df.dropna(subset=[pred, target]), pred, q)
    cost = cost_bps / 1e4
    out = rows.groupBy("date").agg(F.avg(F.when(F.col("bucket") == q, F.col(target))).alias("top_gross"), F.avg(F.when(F.col("bucket") == 1, F.col(target))).alias("bottom"), F.avg(target).alias("equal"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).withColumn("top", F.col("top_gross") - cost).withColumn("long_short", F.col("top_gross") - F.col("bottom") - 2 * cost).drop("top_gross")


def compounded(periods: DataFrame, r: str, *by: str) -> DataFrame:
    """Compound return and the same without the best period."""
    g = periods.filter(F.col(r).isNotNull())
    top = g.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(r), "date")))
    return top.groupBy(*by).agg((F.exp(F.sum(F.log1p(r))) - 1).alias("compound"), (F.exp(F.coalesce(F.sum(F.when(F.col("_k") > 1, F.log1p(r))), F.lit(0.0))) - 1).alias("without_best"), F.count("*").alias("n_periods"))


def paths(holdings: DataFrame, prices: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-weight buy-and-hold wealth of each session from entry to exit; known: share of names with a price."""
    days = calendar.select("date")
    grid = holdings.select(*keys, "ticker", "entry_date", "exit_date").join(F.broadcast(days), (F.col("date") >= F.col("entry_date")) & (F.col("date") <= F.col("exit_date")))
    rows = grid.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left")
    first = F.first("close").over(Window.partitionBy(*keys, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_w", F.col("close") / first)
    return rows.groupBy(*keys, "date").agg(F.avg("_w").alias("wealth"), (F.count("_w") / F.count("*")).alias("known"))


def drawdown_of(path: DataFrame, keys: list[str], value: str = "wealth") -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return path.withColumn("_d", F.col(value) / peak - 1).groupBy(*keys).agg(F.min("_d").alias("mdd"))


def settle(holdings: DataFrame, prices: DataFrame, calendar: DataFrame, keys: list[str], n: int, tolerance: float = 1e-6, relative: float = 1e-5) -> DataFrame:
    """One row a period with status, settled return, drawdown, missing weight, coverage and assumption returns.

    holdings: keys, ticker, entry_date, exit_date, target (the label's simple return); a return under -100 % is an error. The status is the
    first that holds: insufficient_candidates (not exactly n names: all else is null), missing_calendar (entry or exit is no session),
    unresolved_return, unresolved_path (a price of a name and session is missing or not positive), endpoint_mismatch (some name's
    prices disagree with its return), settled_path. Assumptions fill missing returns at 0, -50 % and -100 %. The return is settled
    once every name's is known, whatever the path; the drawdown is given for settled paths alone.
    """
    total = F.coalesce(F.sum("target"), F.lit(0.0))
    assumed = [((total + (F.count("*") - F.count("target")) * x) / n).alias(f"assumption_{name}") for name, x in (("flat", 0.0), ("loss50", -0.5), ("loss100", -1.0))]
    days = calendar.select(F.col("date").alias("_day"))
    held = holdings.join(F.broadcast(days.withColumnRenamed("_day", "_in")), F.col("entry_date") == F.col("_in"), "left").join(F.broadcast(days.withColumnRenamed("_day", "_out")), F.col("exit_date") == F.col("_out"), "left")
    base = held.groupBy(*keys).agg(F.count("*").alias("selected"), F.min("entry_date").alias("entry_date"), F.max("exit_date").alias("exit_date"), F.count("target").alias("_known"), F.avg("target").alias("_mean"), F.min("target").alias("_worst"), F.bool_and(F.col("_in").isNotNull() & F.col("_out").isNotNull()).alias("_dated"), *assumed)
    base = base.withColumn("selected", F.when(F.col("_worst") < -1, F.raise_error(F.lit("a return under -100 %"))).otherwise(F.col("selected")))
    grid = holdings.select(*keys, "ticker", "entry_date", "exit_date", "target").join(F.broadcast(days), (F.col("_day") >= F.col("entry_date")) & (F.col("_day") <= F.col("exit_date")))
    grid = grid.join(prices.select("ticker", F.col("date").alias("_day"), "close"), ["ticker", "_day"], "left").withColumn("_p", F.when(F.col("close") > 0, F.col("close")))
    names = grid.groupBy(*keys, "ticker").agg(F.max(F.when(F.col("_day") == F.col("entry_date"), F.col("_p"))).alias("_first"), F.max(F.when(F.col("_day") == F.col("exit_date"), F.col("_p"))).alias("_end"), F.first("target").alias("_t"), F.count("_p").alias("_valid"), F.count("*").alias("_all"))
    agree = F.abs(F.col("_end") / F.col("_first") - 1 - F.col("_t")) <= tolerance + relative * F.abs(F.col("_t"))
    paths_ = names.groupBy(*keys).agg((F.sum("_valid") / F.sum("_all")).alias("path_coverage"), F.bool_and(F.coalesce(agree, F.lit(False))).alias("_agree"))
    wealth = grid.join(names.select(*keys, "ticker", "_first"), [*keys, "ticker"]).groupBy(*keys, F.col("_day").alias("date")).agg(F.avg(F.col("_p") / F.col("_first")).alias("wealth"))
    rows = base.join(paths_, keys, "left").join(drawdown_of(wealth, keys), keys, "left")
    enough, known = F.col("selected") == n, F.col("_known") == F.col("selected")
    status = (
        F.when(~enough, "insufficient_candidates").when(~F.col("_dated"), "missing_calendar").when(~known, "unresolved_return")
        .when(F.coalesce("path_coverage", F.lit(0.0)) < 1, "unresolved_path").when(~F.col("_agree"), "endpoint_mismatch").otherwise("settled_path")
    )
    rows = rows.withColumns({"status": status, "missing_weight": F.when(enough, 1 - F.col("_known") / F.col("selected")), "return_settled": F.when(enough & known, F.col("_mean"))})
    rows = rows.withColumns({f"assumption_{name}": F.when(enough, F.col(f"assumption_{name}")) for name in ("flat", "loss50", "loss100")})
    rows = rows.withColumn("path_coverage", F.when(enough & F.col("_dated"), F.col("path_coverage"))).withColumn("mdd", F.when(F.col("status") == "settled_path", F.col("mdd")))
    return rows.drop("_known", "_mean", "_worst", "_dated", "_agree")


def summarise(periods: DataFrame, walk: DataFrame, by: list[str], period: str = "period", year: int = 12, limit: float = -0.15) -> DataFrame:
    """Settled periods of a strategy as one: a return where every period is settled and each entry is the exit before, a
    drawdown and volatility where every path is settled too, and whether the drawdown keeps to the limit.

    periods: what settle gives, with `by` among its keys; walk: `paths` of the same holdings.
    """
    order = Window.partitionBy(*by).orderBy(period)
    rows = periods.withColumn("_next", F.coalesce(F.col("entry_date") == F.lag("exit_date").over(order), F.row_number().over(order) == 1))
    known, path = F.col("return_settled").isNotNull(), F.col("status") == "settled_path"
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_periods"), F.count("return_settled").alias("settled_periods"), F.count(F.when(path, 1)).alias("path_periods"), F.avg("return_settled").alias("mean_period_return_available"),
        F.when(F.bool_and(F.col("_next") & known), F.exp(F.sum(F.log1p("return_settled"))) - 1).alias("cumulative_return"), F.bool_and(F.col("_next") & path).alias("_whole"),
    )
    out = out.join(chained(walk, by, period, year).select(*by, "mdd", "annualized_volatility"), by, "left")
    out = out.withColumns({c: F.when(F.col("_whole"), F.col(c)) for c in ("mdd", "annualized_volatility")})
    preference = F.when(~F.col("_whole"), "unresolved").when(F.col("mdd") >= limit, "met_observed_path").otherwise("not_met")
    return out.withColumn("status", F.when(F.col("_whole"), "complete_path").otherwise("incomplete")).withColumn("mdd_15_preference", preference).drop("_whole")


def loss50_path(holdings: DataFrame, prices: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Wealth with marks carried through gaps; a name without a last price ends at half."""
    grid = holdings.select(*keys, "ticker", "entry_date", "exit_date").join(F.broadcast(calendar.select("date")), (F.col("date") >= F.col("entry_date")) & (F.col("date") <= F.col("exit_date")))
    rows = grid.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left")
    w = Window.partitionBy(*keys, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last("close", ignorenulls=True).over(w) / F.first("close", ignorenulls=True).over(w)
    mark = F.when((F.col("date") == F.col("exit_date")) & F.col("close").isNull(), 0.5).otherwise(F.coalesce(mark, F.lit(1.0)))
    return rows.withColumn("_w", mark).groupBy(*keys, "date").agg(F.avg("_w").alias("wealth"))


def chained(walk: DataFrame, by: list[str], period: str = "period", year: int = 12) -> DataFrame:
    """Wealth chained over contiguous periods: total return, drawdown, annualised volatility of session returns."""
    ends = walk.groupBy(*by, period).agg(F.max_by("wealth", "date").alias("_e"))
    before = Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_base", F.coalesce(F.exp(F.sum(F.log("_e")).over(before)), F.lit(1.0)))
    rows = walk.join(ends.select(*by, period, "_base"), [*by, period]).withColumn("chain", F.col("wealth") * F.col("_base"))
    first = F.min("date").over(Window.partitionBy(*by, period))
    least = F.min(period).over(Window.partitionBy(*by))
    rows = rows.withColumn("_f", first).withColumn("_p", least).filter((F.col("date") != F.col("_f")) | (F.col(period) == F.col("_p")))
    order = Window.partitionBy(*by).orderBy("date")
    rows = rows.withColumn("_r", F.col("chain") / F.lag("chain").over(order) - 1).withColumn("_d", F.col("chain") / F.max("chain").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy(*by).agg((F.max_by("chain", "date") - 1).alias("total_return"), F.min("_d").alias("mdd"), (F.stddev_samp("_r") * F.sqrt(F.lit(year))).alias("annualized_volatility"), F.countDistinct(period).alias("n_periods"))


def concentration(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Largest sector share and number of sectors."""
    s = holdings.groupBy(*keys, "sector").agg(F.count("*").alias("n"))
    return s.groupBy(*keys).agg(F.sum("n").alias("holdings"), (F.max("n") / F.sum("n")).alias("max_sector_weight"), F.count("*").alias("unique_sectors"))


def contribution(holdings: DataFrame, keys: list[str], period: str = "date") -> DataFrame:
    """Linked contribution of each name: NAV before the period times weight times return. They add up to the final return."""
    sized = holdings.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(*keys, period)))
    nav = sized.groupBy(*keys, period).agg(F.sum(F.col("_w") * F.col("target")).alias("_r"))
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    nav = nav.withColumn("nav", F.coalesce(F.exp(F.sum(F.log1p("_r")).over(before)), F.lit(1.0)))
    return sized.join(nav.select(*keys, period, "nav"), [*keys, period]).withColumn("contribution", F.col("nav") * F.col("_w") * F.col("target"))


def ticker_shares(contributions: DataFrame, keys: list[str]) -> DataFrame:
    t = contributions.groupBy(*keys, "ticker").agg(F.sum("contribution").alias("contribution"), F.count("*").alias("times"))
    return t.withColumn("share", F.col("contribution") / F.nullif(F.sum("contribution").over(Window.partitionBy(*keys)), F.lit(0.0)))


def period_concentration(contributions: DataFrame, keys: list[str], k: int = 3, period: str = "date") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*keys, period).orderBy(F.desc("contribution"), "ticker"))
    rows = contributions.withColumn("_k", r)
    return rows.groupBy(*keys, period).agg(F.sum("contribution").alias("total"), F.sum(F.when(F.col("_k") <= k, F.col("contribution"))).alias("top"), F.avg(F.when(F.col("_k") > k, F.col("target"))).alias("return_without_top"))


def sector_effects(picked: DataFrame, universe: DataFrame) -> DataFrame:
    """Allocation and selection against the universe by date and sector."""
    total = lambda df, p: df.groupBy("date", "sector").agg((F.count("*")).alias(f"{p}_n"), F.avg("target").alias(f"{p}_r"))
    rows = total(universe, "u").join(total(picked, "p"), ["date", "sector"], "left")
    w = Window.partitionBy("date")
    pw, uw = F.coalesce(F.col("p_n") / F.sum("p_n").over(w), F.lit(0.0)), F.col("u_n") / F.sum("u_n").over(w)
    base = F.sum(F.col("u_n") * F.col("u_r")).over(w) / F.sum("u_n").over(w)
    return rows.select("date", "sector", pw.alias("weight"), uw.alias("universe_weight"), ((pw - uw) * (F.col("u_r") - base)).alias("allocation"), (pw * F.coalesce(F.col("p_r") - F.col("u_r"), F.lit(0.0))).alias("selection"))
