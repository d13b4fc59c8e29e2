"""Diagnostics, policies and comparison tables built on the panel operators."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, ratio, trailing
from panelweave.operators.xsec import average_rank, percentile_rank


def macro_features(macro: DataFrame, a: str, b: str, *, short: int = 20, long: int = 60, fill: int = 3) -> DataFrame:
    """Spread of two series with its change, level and relative change of the first, log return of the second.

    Gaps are filled forward over at most `fill` sessions, and the whole row is lagged by one, so a session sees the one before.
    macro has one row a session: its windows hold one short table.
    """
    w = Window.orderBy("date")
    x = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(-fill, 0)) for c in (a, b)}
    rows = macro.select("date", x[a].alias("a"), x[b].alias("b")).withColumn("spread", F.col("a") - F.col("b"))
    made = {
        "spread": F.col("spread"), "spread_change": F.col("spread") - F.lag("spread", short).over(w), "level": F.col("a"),
        "change": F.col("a") / F.lag("a", short).over(w) - 1, "log_return": F.log(F.col("b") / F.lag("b", long).over(w)),
    }
    rows = rows.withColumns({f"_{c}": v for c, v in made.items()})
    return rows.select("date", *(F.lag(f"_{c}").over(w).alias(c) for c in made))


def weekly_rsi(bars: DataFrame, n: int) -> DataFrame:
    """RSI of the last close of each week ending on Friday, known from the week after on."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    rows = bars.groupBy("ticker", week.alias("week")).agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("ticker").orderBy("week")
    rows = rows.withColumn("_d", F.col("close") - F.lag("close").over(w))
    over = w.rowsBetween(-(n - 1), 0)
    up, down = F.avg(F.greatest("_d", F.lit(0.0))).over(over), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(over)
    value = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    rows = rows.withColumn("_v", F.when(F.count("_d").over(over) == n, value))
    return rows.select("ticker", "week", F.lag("_v").over(w).alias("rsi"))


def adjacent_differences(values: dict[str, list[str]]) -> dict[str, Column]:
    """For each prefix, the difference of every window's column from the next longer one's."""
    return {f"{p}_diff_{i}": F.col(a) - F.col(b) for p, cols in values.items() for i, (a, b) in enumerate(zip(cols, cols[1:]))}


def volatility_ratios(columns: list[str]) -> dict[str, Column]:
    return {f"ratio_{a}_{b}": ratio(F.col(a), F.col(b)) for a, b in zip(columns, columns[1:])}


def snapshot_drift(rows: DataFrame, value: str) -> DataFrame:
    """Change of a feature between a ticker's snapshots: deviation of the changes over that of the levels."""
    moved = rows.withColumn("_d", F.col(value) - F.lag(value).over(by_ticker()))
    return moved.agg(F.stddev_samp("_d").alias("drift"), F.stddev_samp(value).alias("level"), F.count("_d").alias("n")).withColumn("ratio", ratio(F.col("drift"), F.col("level")))


def ready(columns: list[str], n: int) -> Column:
    """All columns finite on each of the last n sessions."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c)
    return F.sum(fine.cast("int")).over(trailing(n)) == n


def sequences(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The last n sessions of the columns as an array in order, for rows that are ready."""
    step = F.struct("session_no", *columns)
    out = rows.withColumn("_ok", ready(columns, n)).withColumn("sequence", F.collect_list(step).over(trailing(n)))
    return out.filter("_ok").drop("_ok")


def attach_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join that fails, when it runs, on a key that either side has twice."""

    def checked(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("a key occurs twice"))).otherwise(n)).filter("_n = 1").drop("_n")

    return checked(left).join(checked(right), keys, how)


def universe(raw: DataFrame, names: dict[str, list[str]], aliases: DataFrame, order: str) -> DataFrame:
    """Listed names in fixed columns: normalised, renamed, blanks dropped, the first row of each ticker."""
    from panelweave.operators.clean import rename_tickers, standard_columns, ticker_name

    rows = standard_columns(raw, names).withColumn("ticker", ticker_name(F.col("ticker"))).filter("ticker <> ''")
    first = F.row_number().over(Window.partitionBy("ticker").orderBy(order))
    return rename_tickers(rows, aliases).withColumn("_k", first).filter("_k = 1").drop("_k")


def threshold_sweep(scored: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """For each share, the rows at or above the date's matching quantile of the score."""
    cuts = scored.groupBy("date").agg(*(F.round(F.percentile(score, F.lit(1 - q)), 10).alias(f"c{i}") for i, q in enumerate(shares)))
    pairs = F.explode(F.array(*(F.struct(F.lit(q).alias("share"), F.col(f"c{i}").alias("cut")) for i, q in enumerate(shares))))
    return scored.join(cuts.select("date", pairs.alias("x")), "date").groupBy(F.col("x.share").alias("share")).agg(F.count("*").alias("n"), F.count(F.when(F.col(score) >= F.col("x.cut"), 1)).alias("n_risky"))


def future_close(horizon: int, lag: int = 1) -> Column:
    return F.lead("close", lag + horizon).over(by_ticker())


def fold_bounds(rows: DataFrame, feature: str, n_splits: int) -> DataFrame:
    """First and last date of equal blocks of the dates on which the feature is ready; the first block only trains."""
    dates = rows.filter(F.col(feature).isNotNull()).select("date").distinct()
    w = Window.orderBy("date")  # one row a date
    numbered = dates.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    block = F.least(F.floor(F.col("_i") * (n_splits + 1) / F.col("_n")), F.lit(n_splits))
    return numbered.groupBy(block.cast("int").alias("fold")).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_dates")).filter("fold > 0")


def inner_split(train: DataFrame, days: int = 365) -> DataFrame:
    """part: `validation` for the last year of the training dates, `inner` for rows whose label was known before it began, else null."""
    last = train.agg(F.date_sub(F.max("date"), days).alias("_v"))
    part = F.when(F.col("date") >= F.col("_v"), "validation").when(F.col("available_at") < F.col("_v"), "inner")
    return train.crossJoin(F.broadcast(last)).withColumn("part", part).drop("_v")


def composite(rows: DataFrame, risk: list[str], reward: list[str]) -> DataFrame:
    """stability (low risk ranks), profitability (high reward ranks) and their mean, by percentile ranks of the date."""
    mean = lambda cols, up: sum(((percentile_rank(c, "date") if up else 1 - percentile_rank(c, "date")) for c in cols[1:]), percentile_rank(cols[0], "date") if up else 1 - percentile_rank(cols[0], "date")) / len(cols)
    out = rows.withColumn("stability", mean(risk, False)).withColumn("profitability", mean(reward, True))
    return out.withColumn("selection", (F.col("stability") + F.col("profitability")) / 2)


def rank_within(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Place of a row in its date and group by the mean percentile of the columns, lowest first, equal ones by ticker; within is that mean to ten digits.

    Places follow the mean as a whole number, ranks over the columns' common denominator: rounded fractions of equal means can differ.
    """
    by = ["date", group]
    score = sum((percentile_rank(c, *by) for c in columns[1:]), percentile_rank(columns[0], *by)) / len(columns)
    whole = lambda x: x.cast("decimal(20,0)")
    known = {c: whole(F.count(c).over(Window.partitionBy(*by))) for c in columns}
    parts = []
    for c in columns:
        part = whole(2 * average_rank(c, *by))
        for other in columns:
            part = part * known[other] if other != c else part
        parts.append(part)
    out = rows.withColumns({"within": F.round(score, 10), "_exact": sum(parts[1:], parts[0])})
    return out.withColumn("within_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_exact", "ticker"))).drop("_exact")


def axis_ablation(rows: DataFrame, axes: list[str], stable: str = "stable") -> DataFrame:
    """As many rows of each date as are stable, by the lowest value of one axis at a time: boolean columns by_<axis>."""
    n = F.sum(F.col(stable).cast("int")).over(Window.partitionBy("date"))
    place = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(F.col(c).asc_nulls_last(), "ticker"))
    return rows.withColumns({f"by_{c}": place(c) <= n for c in axes})


def cross_window_flags(rows: DataFrame) -> DataFrame:
    """Policies from states of a short and a long window (low, mid, high): both low, long not high, and with a warning off."""
    low = F.col("short_state") == "low"
    return rows.withColumns({"strict": low & (F.col("long_state") == "low"), "loose": low & (F.col("long_state") != "high")}).withColumn("balanced", F.col("loose") & ~F.coalesce("warning", F.lit(False)))


def trailing_ic(ic: DataFrame, signals: DataFrame, last: int = 3) -> DataFrame:
    """Mean IC of the last few dates whose labels were known before each signal date. ic: model, date, available_at, ic."""
    both = ic.join(F.broadcast(signals.select(F.col("date").alias("signal"))), F.col("available_at") < F.col("signal"))
    k = F.row_number().over(Window.partitionBy("model", "signal").orderBy(F.desc("date")))
    return both.withColumn("_k", k).filter(F.col("_k") <= last).groupBy("signal", "model").agg(F.avg("ic").alias("ic"), F.count("*").alias("n"))


def signed(predictions: DataFrame, ic: DataFrame) -> DataFrame:
    """Predictions turned round where a model's past mean IC is negative; one row a model is broadcast."""
    way = ic.groupBy("model").agg(F.when(F.avg("ic") < 0, -1).otherwise(1).alias("direction"))
    return predictions.join(F.broadcast(way), "model", "left").withColumn("pred", F.col("pred") * F.coalesce("direction", F.lit(1)))


def profile_by(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean and median of columns by group, with counts."""
    parts = [x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}"))]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *parts)


def failures(wanted: DataFrame, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Wanted tickers that the clean table lacks, with the stage that lost them."""
    have = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    lost = wanted.select("ticker").distinct().join(have(raw, "_r"), "ticker", "left").join(have(cleaned, "_c"), "ticker", "left").filter("_c is null")
    stage = F.when(F.col("_r").isNull(), "collect").otherwise("clean")
    return lost.select("ticker", stage.alias("stage"), F.when(F.col("_r").isNull(), "no source has rows").otherwise("no valid row in the period").alias("reason"))


def exposure(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of each sector in equal-weight holdings."""
    n = F.sum("n").over(Window.partitionBy(*keys))
    return holdings.groupBy(*keys, "sector").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") / n)


def shock_windows(calendar: DataFrame, start: int, end: int) -> DataFrame:
    """Sessions of a shock and as many before and after it."""
    n, s = end - start + 1, F.col("session_no")
    phase = F.when(s.between(start - n, start - 1), "PRE").when(s.between(start, end), "SHOCK").when(s.between(end + 1, end + n), "POST")
    return calendar.withColumn("phase", phase).filter("phase is not null")


def realised(panel: DataFrame, phases: DataFrame, groups: DataFrame) -> DataFrame:
    """Realised volatility of returns by phase and by the group that a ticker was in before."""
    rows = panel.join(F.broadcast(phases.select("session_no", "phase")), "session_no").join(groups, "ticker")
    each = rows.groupBy("phase", "group", "ticker").agg(F.stddev_samp("r").alias("_v"), (F.exp(F.sum("r")) - 1).alias("_t"))
    return each.groupBy("phase", "group").agg(F.count("*").alias("n"), F.avg("_v").alias("mean_vol"), F.avg("_t").alias("mean_return"))


def retention(states: DataFrame, gap: int, shock: Column) -> DataFrame:
    """Share of rows that keep their state `gap` sessions later, in shock and normal sessions, and the difference in points."""
    later = states.select("ticker", (F.col("session_no") - gap).alias("session_no"), F.col("state").alias("_s"))
    rows = states.join(later, ["ticker", "session_no"]).withColumn("_same", (F.col("state") == F.col("_s")).cast("double")).withColumn("_shock", shock)
    part = lambda c: F.avg(F.when(c, F.col("_same")))
    out = rows.groupBy("state").agg(part(F.col("_shock")).alias("shock"), part(~F.col("_shock")).alias("normal"), F.count("*").alias("n"))
    return out.withColumn("delta_pp", 100 * (F.col("shock") - F.col("normal")))


def paired_scopes(periods: DataFrame, base: str, case: str) -> DataFrame:
    """Periods that both strategies settle: means, wins and coverage. Returns are compared at ten digits, so equal names in another order do not win."""
    wide = periods.groupBy("period").pivot("strategy", [base, case]).agg(F.round(F.first("r"), 10))
    both = F.col(base).isNotNull() & F.col(case).isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    return wide.agg(F.count(F.when(both, 1)).alias("n_both"), F.count("*").alias("n_periods"), mean(base).alias("mean_base"), mean(case).alias("mean_case"), F.count(F.when(both & (F.col(case) > F.col(base)), 1)).alias("wins"))


def yearly_pivot(ic: DataFrame, models: list[str]) -> DataFrame:
    return ic.groupBy(F.year("date").alias("year")).pivot("model", models).agg(F.avg("ic"))


def sign_flips(ic: DataFrame, split) -> DataFrame:
    """Mean IC of each model before and from a day on, and whether its sign turns."""
    early = F.col("date") < F.lit(split).cast("date")
    out = ic.groupBy("model").agg(F.avg(F.when(early, F.col("ic"))).alias("train_ic"), F.avg(F.when(~early, F.col("ic"))).alias("test_ic"))
    return out.withColumn("flipped", F.signum("train_ic") != F.signum("test_ic"))


def mean_by(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns))


def delta_class(risk: Column, reward: Column) -> Column:
    """A result class from the signs of two changes."""
    return F.when((risk <= 0) & (reward >= 0), "better").when((risk > 0) & (reward < 0), "worse").when(risk <= 0, "safer").otherwise("bolder")


def score_top(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n best of a date by the mean percentile rank of columns."""
    score = sum((percentile_rank(c, "date") for c in columns[1:]), percentile_rank(columns[0], "date")) / len(columns)
    out = rows.dropna(subset=columns).withColumn("score", F.round(score, 10))
    return out.withColumn("pick", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))).filter(F.col("pick") <= n)


def top_per_sector(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("date", "sector").orderBy(*order, "ticker"))
    return rows.withColumn("pick", place).filter(F.col("pick") <= n)


def select_candidate(summary: DataFrame, ic: DataFrame, expected: int, limit: float = -0.15) -> DataFrame:
    """Marks the strategy to take: complete, within the drawdown limit, best by return, then drawdown, IC and name.

    summary has a row a strategy (strategy, n_periods, status, cumulative_return, mdd), ic its mean_ic. Where no strategy
    keeps to the limit none is selected and the choice is deferred.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = summary.join(ic.select("strategy", "mean_ic"), "strategy", "left")
    eligible = (F.col("n_periods") == expected) & (F.col("status") == "complete_path") & finite("cumulative_return") & finite("mdd")
    rows = rows.withColumn("eligible", F.coalesce(eligible, F.lit(False))).withColumn("risk_preference_met", F.col("eligible") & (F.col("mdd") >= limit))
    best = Window.orderBy(F.desc("risk_preference_met"), F.desc_nulls_last("cumulative_return"), F.desc_nulls_last("mdd"), F.desc_nulls_last("mean_ic"), "strategy")  # one row a strategy
    rows = rows.withColumn("selected", F.col("risk_preference_met") & (F.row_number().over(best) == 1))
    any_met = F.bool_or("risk_preference_met").over(Window.partitionBy())
    return rows.withColumn("selection_status", F.when(any_met, "exploratory_selected").otherwise("deferred_no_complete_risk_qualified_candidate"))


def scope_comparison(predictions: DataFrame, target: str, sizes: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Equal-weight outcome of the stable-first picks by date, scope and size, before cost.

    predictions: scope, date, ticker, sector, stable, pred, target. Returns count only where all n names are picked and known; assumptions put
    0, -50 % and -100 % in the place of unknown ones; fewer than n picks leave them null. A return under -100 % fails the run.
    """
    from panelweave.operators.xsec import stable_first_top

    known = F.when(F.col(target) < -1, F.raise_error(F.lit("simple return under -100 %")).cast("double")).otherwise(F.col(target))
    rows = predictions.withColumn("_g", F.struct("scope", "date")).withColumn("_t", known)
    out = None
    for n in sizes:
        picked = stable_first_top(rows, "pred", n, by="_g").groupBy("scope", "date").agg(F.count("*").alias("selected"), F.count(F.when(~F.col("stable"), 1)).alias("fallback_n"), F.count("_t").alias("_k"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("_s"))
        part = predictions.select("scope", "date").distinct().join(picked, ["scope", "date"], "left").na.fill(0, ["selected", "fallback_n", "_k"])
        whole, gone = F.col("selected") == n, n - F.col("_k")
        part = part.withColumns({
            "top_n": F.lit(n), "status": F.when(~whole, "insufficient_candidates").when(gone > 0, "missing_return").otherwise("settled"),
            "return_settled": F.when(whole & (gone == 0), F.col("_s") / n), "missing_weight": F.when(whole, gone / n),
            **{f"assumption_{name}": F.when(whole, (F.col("_s") + gone * worth) / n) for name, worth in (("flat", 0.0), ("loss50", -0.5), ("loss100", -1.0))},
        }).drop("_k", "_s")
        out = part if out is None else out.unionByName(part)
    return out


def cash_paths(periods: DataFrame, weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Wealth of 1 on every session of the periods whose weights are all zero or missing, entry to exit: cash without interest.

    periods: period, date, entry_no, exit_no; weights: date, weight, one row a model.
    """
    total = weights.groupBy("date").agg(F.sum("weight").alias("_w"))
    cash = periods.join(total, "date", "left").filter(F.coalesce("_w", F.lit(0.0)) == 0)
    days = cash.select("period", F.explode(F.sequence("entry_no", "exit_no")).alias("session_no"))
    return days.join(calendar.select("session_no", "date"), "session_no").select("period", "date", F.lit(1.0).alias("wealth"), F.lit("cash").alias("status"))


def risk_free(annual_percent: Column, sessions: int = 252) -> Column:
    """The session's rate of an annual yield in percent, a negative yield counting as 0."""
    return F.pow(1 + F.greatest(annual_percent, F.lit(0.0)) / 100, F.lit(1.0 / sessions)) - 1


def policy_bootstrap(daily: DataFrame, case: str, base: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean daily difference of two rates with an interval from dates drawn with replacement."""
    from panelweave.operators.stats import draw

    rows = daily.filter(F.col(case).isNotNull() & F.col(base).isNotNull()).select((F.col(case) - F.col(base)).alias("d"), (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    size = rows.agg(F.count("*").alias("n"), F.avg("d").alias("difference"))
    drawn = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = drawn.withColumn("i", draw(F.lit(str(seed)), "rep", "k") % F.col("n"))
    means = drawn.join(F.broadcast(rows), "i").groupBy("rep").agg(F.round(F.avg("d"), 12).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high")).crossJoin(size)


def pooled_policy_bootstrap(rows: DataFrame, case: str, base: str, outcome: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Difference of two policies' rates over all rows, case less base, with an interval from dates drawn with replacement.

    A drawn date brings all its rows, so rates pool numerators and denominators; draws in which a policy has no row are left out.
    """
    from panelweave.operators.stats import draw

    hit = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col(outcome).cast("double"))), F.lit(0.0))
    size = lambda flag: F.count(F.when(F.col(flag), F.col(outcome)))
    daily = rows.groupBy("date").agg(hit(case).alias("a"), size(case).alias("na"), hit(base).alias("b"), size(base).alias("nb"))
    daily = daily.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    rate = lambda: F.sum("a") / F.nullif(F.sum("na"), F.lit(0)) - F.sum("b") / F.nullif(F.sum("nb"), F.lit(0))
    whole = daily.agg(F.count("*").alias("n_dates"), rate().alias("difference"))
    drawn = whole.select(F.col("n_dates").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = drawn.withColumn("i", draw(F.lit(str(seed)), "rep", "k") % F.col("n"))
    means = drawn.join(daily, "i").groupBy("rep").agg(F.round(rate(), 12).alias("m")).filter("m is not null")
    return means.agg(F.count("*").alias("n_boot"), F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high")).crossJoin(whole)


def hac_regression(daily: DataFrame, y: str, xs: list[str], max_lag: int, order: str = "date") -> DataFrame:
    """Coefficients with Bartlett-weighted standard errors: term, value, se, t.

    The sums of products and of lagged score products are Spark aggregations; the driver solves one small system of
    len(xs) + 1 unknowns. daily: one row a session.
    """
    import numpy as np

    names = ["one", *xs]
    rows = daily.dropna(subset=[y, *xs]).select(order, y, F.lit(1.0).alias("one"), *xs).withColumn("_i", F.row_number().over(Window.orderBy(order)))
    k = len(names)
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)), *(F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(names))).first()
    values = [x or 0.0 for x in sums]
    bread = np.linalg.pinv(np.array(values[: k * k]).reshape(k, k))
    beta = bread @ np.array(values[k * k :])
    left = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(names[1:], beta[1:])), F.col("one") * float(beta[0]))
    scores = rows.select("_i", *((F.col(c) * left).alias(f"s{i}") for i, c in enumerate(names)))
    lagged = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    ahead = lagged.select((F.col("_i") + F.col("lag")).alias("_i"), "lag", *(F.col(f"s{i}").alias(f"b{i}") for i in range(k)))
    weight = F.when(F.col("lag") == 0, 0.5).otherwise(1 - F.col("lag") / (max_lag + 1))
    meat = scores.join(ahead, "_i").agg(*(F.sum(weight * (F.col(f"s{i}") * F.col(f"b{j}") + F.col(f"b{i}") * F.col(f"s{j}"))) for i in range(k) for j in range(k))).first()
    se = np.sqrt(np.maximum(np.diag(bread @ np.array([x or 0.0 for x in meat]).reshape(k, k) @ bread), 0))
    return daily.sparkSession.createDataFrame([(n, float(b), float(s), float(b / s) if s else None) for n, b, s in zip(["alpha", *xs], beta, se)], "term string, value double, se double, t double")


def daily_portfolio(walk: DataFrame, holdings: DataFrame, keys: list[str], cost: float) -> DataFrame:
    """Session returns of each period's wealth, the cost of the round trip taken on its last session."""
    w = Window.partitionBy(*keys).orderBy("date")
    ends = holdings.groupBy(*keys).agg(F.max("exit_date").alias("_x"))
    rows = walk.join(ends, keys).withColumn("_r", F.col("wealth") / F.lag("wealth").over(w) - 1)
    return rows.filter("_r is not null").select(*keys, "date", (F.col("_r") - F.when(F.col("date") == F.col("_x"), F.lit(cost)).otherwise(F.lit(0.0))).alias("r"))


def regime_performance(daily: DataFrame, by: list[str], year: int) -> DataFrame:
    return daily.groupBy(*by, "regime").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"), (F.stddev_samp("r") * F.sqrt(F.lit(year))).alias("volatility"))


def beta_at_signal(holdings: DataFrame, keys: list[str], market: str = "target_market") -> DataFrame:
    """Mean beta of the names of a period where all have one, its coverage, and the return less beta times the market's."""
    out = holdings.groupBy(*keys).agg(F.avg("beta").alias("_b"), (F.count("beta") / F.count("*")).alias("coverage"), F.avg("target").alias("_r"), F.first(market).alias("_m"))
    out = out.withColumn("beta", F.when(F.col("coverage") == 1, F.col("_b")))
    return out.withColumn("residual", F.col("_r") - F.col("beta") * F.col("_m")).drop("_b", "_r", "_m")


def eligibility_ab(rows: DataFrame, pred: str, target: str, eligible: str, q: int = 5) -> DataFrame:
    """Top-bucket mean with and without names that are not eligible, and their share of the unrestricted top bucket."""
    from panelweave.operators.xsec import buckets

    full = buckets(rows.dropna(subset=[pred, target]), pred, q).filter(F.col("bucket") == q)
    kept = buckets(rows.filter(F.col(eligible)).dropna(subset=[pred, target]), pred, q).filter(F.col("bucket") == q)
    a = full.groupBy("date").agg(F.avg(target).alias("top_all"), F.avg((~F.col(eligible)).cast("double")).alias("ineligible_share"))
    return a.join(kept.groupBy("date").agg(F.avg(target).alias("top_eligible")), "date", "left")


def recommendation(blend: DataFrame, n: int, cap: float = 0.5) -> DataFrame:
    """The latest date's capped top names with status columns."""
    from panelweave.operators.xsec import capped_top

    last = blend.agg(F.max("date").alias("date"))
    rows = capped_top(blend.join(F.broadcast(last), "date", "left_semi"), "blend", n, cap)
    held = F.count("*").over(Window.partitionBy())
    return rows.withColumn("status", F.when(held == n, "complete").otherwise("short")).withColumn("weight", F.lit(1.0) / held)


def live_recommendation(scores: DataFrame, eligible: DataFrame, weights: dict[str, float], n: int = 10, cap: float = 0.5, horizon: int = 120) -> tuple[DataFrame, DataFrame]:
    """(picks of the latest date that has eligible names, their weight by sector): a signal whose outcome is not yet known.

    scores: model, date, ticker, pred; eligible: date, ticker, sector. Percentile ranks are taken among that date's eligible names, and the blend adds
    them up by weight; the explanation names each model's rank. Weights of picks are 1 / n even where fewer than n names are found.
    """
    from panelweave.operators.xsec import capped_top, percentile_rank

    last = eligible.agg(F.max("date").alias("date"))
    names = eligible.join(F.broadcast(last), "date", "left_semi").select("date", "ticker", "sector")
    rows = scores.filter(F.col("model").isin(list(weights))).join(names, ["date", "ticker"]).withColumn("_p", percentile_rank("pred", "model", "date"))
    part = lambda m: F.max(F.when(F.col("model") == m, F.col("_p")))
    blend = rows.groupBy("date", "ticker", "sector").agg(*(part(m).alias(f"{m}_rank_pct") for m in weights), F.count("*").alias("_n")).filter(F.col("_n") == len(weights)).drop("_n")
    score = sum((F.col(f"{m}_rank_pct") * w for m, w in weights.items()), F.lit(0.0))
    picks = capped_top(blend.withColumn("blend", F.round(score, 10)), "blend", n, cap)
    said = F.concat_ws("; ", *(F.format_string(f"{m} %.3f", F.round(f"{m}_rank_pct", 3)) for m in weights))
    picks = picks.withColumns({"weight": F.lit(1.0 / n), "recommendation_status": F.lit("unsettled_live_signal"), "holding_sessions": F.lit(horizon), "intended_entry": F.lit("next_session"), "explanation": said})
    return picks.withColumnRenamed("date", "signal_date"), picks.groupBy("sector").agg(F.sum("weight").alias("weight"))
