"""Audits: the contract of a finished table, value ranges, labels without a settled identity, shocks and sector effects."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import drawdown
from panelweave.operators.clean import finite, ticker_name
from panelweave.operators.joins import outside_shocks
from panelweave.operators.stats import correlation, wilson
from panelweave.operators.xsec import average_rank

# The columns that a finished table of bars must have, the numeric ones among them, and the derived ones that it must not have.
REQUIRED = ("date", "ticker", "open", "high", "low", "close", "volume")
NUMBERS = ("open", "high", "low", "close", "volume")
DERIVED = ("return", "simple_return", "log_return", "volatility", "mdd", "rsi", "sharpe", "sortino", "beta", "calmar", "moving_average", "momentum")


def dataset_contract(bars: DataFrame, universe: DataFrame, failed: DataFrame, coverage: DataFrame, short_sample: int = 10) -> DataFrame:
    """(rule, severity, n, sample): every rule of a finished table of bars, with the first few tickers or columns that break it.

    failed (ticker, n_rows_final) and coverage (ticker, n_rows, short_history) have a row a ticker. Rules of types come from the
    schema; all others from one aggregate over keys and one over tickers. A table without a required column fails at once.
    Rows of a null ticker count under null_ticker alone; empty tables break no rule but unaccounted_ticker and coverage_set.
    """
    absent = sorted(set(REQUIRED) - set(bars.columns))
    if absent:
        raise ValueError(f"required columns missing: {absent}")
    types = dict(bars.dtypes)
    words = [c for c in NUMBERS if types[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not types[c].startswith("decimal")]
    schema = {"date_type": [] if types["date"] in ("date", "timestamp_ntz") else ["date"], "number_type": words, "derived_column": sorted(c for c in bars.columns if c.lower() in DERIVED)}

    nulls = {f"null_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in REQUIRED}
    low = F.count(F.when(F.col("close") <= 0, 1))
    keyed = bars.groupBy("ticker", "date").agg(F.count("*").alias("_n"), low.alias("close_not_positive"), *(v.alias(k) for k, v in nulls.items()))
    own = keyed.groupBy("ticker").agg(F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("duplicate_key"), *(F.sum(c).alias(c) for c in ("close_not_positive", *nulls)))
    named = universe.select(ticker_name(F.col("ticker")).alias("ticker")).distinct().withColumn("_u", F.lit(1))
    lost = failed.groupBy("ticker").agg(F.max("n_rows_final").alias("_final"))
    told = coverage.groupBy("ticker").agg(F.max("n_rows").alias("_told"), F.max(F.col("short_history").cast("int")).alias("_short"), F.lit(1).alias("_c"))
    every = own.join(named, "ticker", "full").join(lost.withColumn("_f", F.lit(1)), "ticker", "full").join(told, "ticker", "full")
    u, f, c = (F.col(x).isNotNull() for x in ("_u", "_f", "_c"))
    have, key = F.col("_rows").isNotNull() & F.col("ticker").isNotNull(), F.col("ticker").isNotNull()
    broken = {
        "outside_universe": have & ~u, "failed_outside_universe": f & ~u & key, "failed_but_present": have & f, "unaccounted_ticker": u & ~have & ~f,
        "coverage_set": (have != c) & key, "coverage_rows": have & ~F.col("_rows").eqNullSafe(F.col("_told")),
        "failed_with_rows": f & (F.col("_final") != 0), "short_history": c & (F.col("_short") > 0),
    }
    counted = {x: F.coalesce(F.col(x), F.lit(0)) for x in ("duplicate_key", "close_not_positive", *nulls)} | {k: F.coalesce(v, F.lit(False)).cast("long") for k, v in broken.items()}
    faults = every.select("ticker", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), v.cast("long").alias("n")) for k, v in counted.items())))).filter("n > 0")
    first = Window.partitionBy("rule").orderBy("ticker")
    names = faults.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= short_sample).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("sample"))
    found = faults.groupBy("rule").agg(F.sum("n").alias("n")).join(names, "rule")
    rules = bars.sparkSession.createDataFrame([(k, "warning" if k == "short_history" else "error") for k in counted], "rule string, severity string")
    out = F.broadcast(rules).join(found, "rule", "left").select("rule", "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sample", F.lit("")).alias("sample"))
    fixed = bars.sparkSession.createDataFrame([(k, "error", len(v), ",".join(v)) for k, v in schema.items()], "rule string, severity string, n long, sample string")
    return out.unionByName(fixed)


def range_audit(rows: DataFrame, every: list[int], windows: dict[int, dict[str, str]], digits: int = 6) -> DataFrame:
    """Least, median and largest value of features by rebalance interval (each k-th session) and lookback window.

    windows: for each lookback the column of every feature. Values are taken at `digits`, which bounds the counts that an exact median needs.
    """
    features = list(next(iter(windows.values())))
    cells = F.array(*(F.struct(F.lit(w).alias("window"), *(F.round(F.col(cols[f]), digits).alias(f) for f in features)) for w, cols in windows.items()))
    steps = F.filter(F.array(*(F.lit(k) for k in every)), lambda k: (F.col("session_no") - 1) % k == 0)
    long = rows.select(F.explode(steps).alias("interval"), cells.alias("_c")).select("interval", F.inline("_c"))
    marks = [m for f in features for m in (F.min(f).alias(f"{f}_min"), F.percentile(f, F.lit(0.5)).alias(f"{f}_median"), F.max(f).alias(f"{f}_max"))]
    return long.groupBy("interval", "window").agg(*marks)


def settled_labels(rows: DataFrame, unclear: DataFrame | None = None, settlements: DataFrame | None = None, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(labels with status, source and the day they were known; settlements that are not usable, with a reason).

    rows: date, ticker, security_id, entry_date, exit_date, log_return, log_market; one row a date and ticker. A label whose security differs or
    is not known at signal, entry or exit, or that ends on or after the day from which its ticker is `unclear` (ticker, since: a short list),
    is security_or_venue_unresolved and has no return. A verified settlement of the same dates replaces a missing return, is known on its own
    day and may be -100 %: its logarithm is null, its excess return is not. A settlement is refused, and changes nothing, where it lacks a
    value, repeats a key, is not verified or has no source, is under -1 or not finite, is known before the exit, has no row or other dates,
    or differs from an observed return. Where no row has a security_id the identity is not judged.
    """
    out = rows.withColumn("simple_return", F.expm1("log_return")).withColumn("label_available_at", F.col("exit_date"))
    ids = rows.filter("security_id is not null").groupBy("ticker", "date").agg(F.max("security_id").alias("_id"))
    at = lambda c: ids.select("ticker", F.col("date").alias(c), F.col("_id").alias(f"_{c}"))
    judged = F.broadcast(rows.agg((F.count("security_id") > 0).alias("_judged")))
    out = out.join(at("entry_date"), ["ticker", "entry_date"], "left").join(at("exit_date"), ["ticker", "exit_date"], "left").crossJoin(judged)
    same = F.coalesce((F.col("_entry_date") == F.col("security_id")) & (F.col("_exit_date") == F.col("security_id")), F.lit(False))
    lost = F.col("_judged") & F.col("exit_date").isNotNull() & ~same
    if unclear is not None:
        out = out.join(F.broadcast(unclear.groupBy("ticker").agg(F.min("since").alias("_since"))), "ticker", "left")
        lost = lost | F.coalesce(F.col("exit_date") >= F.col("_since"), F.lit(False))
    status = F.when(lost, "security_or_venue_unresolved").when(F.col("exit_date").isNull(), "unmatured").when(finite("simple_return"), "observed").otherwise("missing_price")
    out = out.withColumn("label_status", status).withColumn("simple_return", F.when(~lost & finite("simple_return"), F.col("simple_return")))
    out = out.withColumn("settlement_source", F.lit(None).cast("string")).drop("_id", "_entry_date", "_exit_date", "_judged", "_since")
    problems = rows.select("date", "ticker", F.lit("").alias("reason")).limit(0)
    if settlements is not None:
        s = settlements.select("date", "ticker", *(F.col(c).alias(f"_{c}") for c in ("entry_date", "exit_date", "simple_return", "available_at", "verified", "source")))
        s = s.withColumn("_copies", F.count("*").over(Window.partitionBy("date", "ticker")))
        target = out.select("date", "ticker", F.lit(True).alias("_row"), F.col("entry_date").alias("_e"), F.col("exit_date").alias("_x"), F.col("simple_return").alias("_old"))
        blank = F.col("date").isNull() | F.col("ticker").isNull()
        for c in ("entry_date", "exit_date", "simple_return", "available_at", "verified", "source"):
            blank = blank | F.col(f"_{c}").isNull()
        reason = (
            F.when(blank, "missing_value").when(F.col("_copies") > 1, "repeated_key").when(~F.col("_verified") | (F.trim("_source") == ""), "not_verified")
            .when(~finite("_simple_return") | (F.col("_simple_return") < -1), "impossible_return").when(F.col("_available_at") < F.col("_exit_date"), "known_before_exit")
            .when(F.col("_row").isNull(), "no_row").when(~(F.col("_entry_date").eqNullSafe(F.col("_e")) & F.col("_exit_date").eqNullSafe(F.col("_x"))), "other_dates")
            .when(F.abs(F.col("_old") - F.col("_simple_return")) > tolerance, "contradicts_observed")
        )
        s = s.join(target, ["date", "ticker"], "left").withColumn("reason", reason)
        problems = s.filter("reason is not null").select("date", "ticker", "reason")
        good = s.filter("reason is null").select("date", "ticker", F.col("_simple_return").alias("_r"), F.col("_available_at").alias("_k"), F.col("_source").alias("_s"))
        out = out.join(good, ["date", "ticker"], "left").withColumns({
            "simple_return": F.coalesce("_r", "simple_return"), "label_status": F.when(F.col("_s").isNotNull(), "verified_settlement").otherwise(F.col("label_status")),
            "settlement_source": F.col("_s"), "label_available_at": F.coalesce("_k", "label_available_at"),
        }).drop("_r", "_k", "_s")
    out = out.withColumn("log_return", F.when(F.col("simple_return") > -1, F.log1p("simple_return")))
    return out.withColumn("target_excess", F.col("simple_return") - F.expm1("log_market")), problems


def incremental_ic(rows: DataFrame, pred: str, target: str, controls: list[str], sector: str | None = None, momentum: str | None = None, least: int = 20) -> DataFrame:
    """By date: correlation of ranks as it is, given the ranked controls (and the sector, point in time), and that of a momentum column.

    Candidates have the score, all controls and, where it is asked for, a sector; their control ranks do not depend on which outcomes are
    known. Scores and outcomes are ranked where the outcome is known. A sector is taken out by removing its means first, which equals a
    regression on its dummies. Dates with fewer than `least` candidates, or fewer outcomes than that or five more than regressors, are left out.
    A score that its controls explain wholly has no incremental IC, nor have controls that explain each other.
    """
    names = [pred, *controls]
    known = finite(*names) if sector is None else finite(*names) & F.col(sector).isNotNull()
    held = [F.col(sector).alias("_sector")] if sector else [F.lit(0).alias("_sector")]
    extra = [F.col(momentum).alias("_mom")] if momentum else [F.lit(None).cast("double").alias("_mom")]
    total = F.count("*").over(Window.partitionBy("date"))
    rows = rows.select("date", F.col(pred).alias("_p"), F.when(finite(target), F.col(target)).alias("_t"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(controls)), *held, *extra, total.alias("_total"), known.alias("_known"))
    rows = rows.filter("_known").withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") >= least)
    z = [f"_z{i}" for i in range(len(controls))]
    rows = rows.withColumns({c: average_rank(f"_k{i}", "date") / F.col("_n") for i, c in enumerate(z)}).filter("_t is not null")
    rows = rows.select("date", "_total", "_sector", *z, average_rank("_p", "date").alias("_a"), average_rank("_t", "date").alias("_b"), average_rank("_mom", "date").alias("_m"))
    inside = Window.partitionBy("date", "_sector")
    free = {f"_f{i}": F.col(c) - F.avg(c).over(inside) for i, c in enumerate(["_a", "_b", *z])}
    rows = rows.withColumns(free)
    pairs = [(i, j) for i in range(len(free)) for j in range(i)]
    regressors = 1 + len(controls) + (F.countDistinct("_sector") - 1 if sector else F.lit(0))
    out = rows.groupBy("date").agg(
        F.first("_total").alias("n_candidates"), F.count("*").alias("n_evaluated"), regressors.alias("_x"), correlation("_a", "_b").alias("raw_ic"),
        (correlation("_m", "_b") if momentum else F.lit(None).cast("double")).alias("momentum_ic"), *(correlation(f"_f{i}", f"_f{j}").alias(f"_c{i}_{j}") for i, j in pairs),
    )

    def given(i: int, j: int, left: int) -> Column:
        if left == 0:
            return F.col(f"_c{max(i, j)}_{min(i, j)}")
        k = left + 1
        a, b, c = given(i, j, left - 1), given(i, k, left - 1), given(j, k, left - 1)
        rest = (1 - b * b) * (1 - c * c)
        return F.when(rest > 1e-12, (a - b * c) / F.sqrt(rest))

    out = out.filter(F.col("n_evaluated") >= F.greatest(F.lit(least), F.col("_x") + 5)).withColumn("incremental_ic", given(0, 1, len(controls)))
    return out.select("date", "raw_ic", "incremental_ic", "momentum_ic", "n_candidates", "n_evaluated", F.lit("PIT_sector" if sector else "not_controlled_no_PIT").alias("sector_mode"))


def shock_retention(states: DataFrame, shocks: DataFrame, worst: str) -> DataFrame:
    """Share of names that keep their state over a shock, and that of equally distant pairs of dates which touch no shock.

    states: ticker, date, state on decision dates. shocks: shock, start, end, anchor_date, comparison_date; a short list. The step between
    anchor and comparison counts decision dates; a shock whose dates are none, or not in order, gives no rows. Deltas are in points.
    """
    dates = states.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row a decision date
    place = lambda c: dates.select(F.col("date").alias(c), F.col("_i").alias(f"_{c}"))
    told = shocks.join(place("anchor_date"), "anchor_date").join(place("comparison_date"), "comparison_date").withColumn("step_gap", (F.col("_comparison_date") - F.col("_anchor_date")).cast("long")).filter("step_gap > 0")
    gaps = told.select("step_gap").distinct()
    pairs = dates.crossJoin(F.broadcast(gaps)).withColumnRenamed("date", "_from").withColumn("_i", F.col("_i") + F.col("step_gap"))
    pairs = pairs.join(F.broadcast(dates.withColumnRenamed("date", "_to")), "_i").select("step_gap", "_from", "_to")
    later = states.select("ticker", F.col("date").alias("_to"), F.col("state").alias("_s"))
    moves = states.join(F.broadcast(pairs), F.col("date") == F.col("_from")).join(later, ["ticker", "_to"])
    share = lambda c: 100 * F.avg(c.cast("double"))
    rates = moves.groupBy("step_gap", "_from", "_to", "state").agg(F.count("*").alias("n"), share(F.col("state") == F.col("_s")).alias("kept"), share(F.col("_s") == worst).alias("fell"))
    calm = outside_shocks(rates.withColumns({"l": F.col("_from"), "r": F.col("_to")}), shocks.select("start", "end"))
    normal = calm.groupBy("step_gap", "state").agg(
        F.count("*").alias("normal_pairs"), F.avg("kept").alias("normal_retention_mean"), F.percentile("kept", F.lit(0.5)).alias("normal_retention_median"), F.stddev_samp("kept").alias("normal_retention_std"),
        F.avg("fell").alias("normal_to_worst_mean"), F.percentile("fell", F.lit(0.5)).alias("normal_to_worst_median"),
    )
    hit = rates.join(F.broadcast(told.select("shock", "step_gap", F.col("anchor_date").alias("_from"), F.col("comparison_date").alias("_to"))), ["step_gap", "_from", "_to"])
    out = hit.join(normal, ["step_gap", "state"], "left").withColumns({"retention_delta_pp": F.col("kept") - F.col("normal_retention_mean"), "to_worst_delta_pp": F.col("fell") - F.col("normal_to_worst_mean")})
    return out.select("shock", "state", "n", F.col("kept").alias("retention_pct"), F.col("fell").alias("to_worst_pct"), *normal.columns[:1], *normal.columns[2:], "retention_delta_pp", "to_worst_delta_pp")


def shock_outcomes(bars: DataFrame, calendar: DataFrame, states: DataFrame, shocks: DataFrame, year: int, least: int = 3) -> DataFrame:
    """Realised volatility and worst drawdown before, in and after each shock, by the state that a name had at the last decision before it.

    bars: ticker, date, close. PRE and POST have as many sessions as the shock, or as many as the calendar holds. A name counts with at least
    `least` closes in a phase; shocks (shock, start, end) without an earlier decision date or a session give no rows.
    """
    inside = F.col("date").between(F.col("start"), F.col("end"))
    spans = calendar.join(F.broadcast(shocks), inside).groupBy("shock").agg(F.min("session_no").alias("_a"), F.max("session_no").alias("_b"))
    n, s = F.col("_b") - F.col("_a") + 1, F.col("session_no")
    phase = F.when(s.between(F.col("_a") - n, F.col("_a") - 1), "PRE").when(s.between(F.col("_a"), F.col("_b")), "SHOCK").when(s.between(F.col("_b") + 1, F.col("_b") + n), "POST")
    phases = calendar.select("date", "session_no").crossJoin(F.broadcast(spans)).withColumn("phase", phase).filter("phase is not null").select("shock", "phase", "date")
    anchors = states.select("date").distinct().join(F.broadcast(shocks), F.col("date") < F.col("start")).groupBy("shock").agg(F.max("date").alias("date"))
    groups = states.join(F.broadcast(anchors), "date").groupBy("shock", "ticker", F.col("date").alias("anchor_date")).agg(F.min("state").alias("state"))
    rows = bars.filter("close is not null").join(F.broadcast(phases), "date").groupBy("shock", "phase", "ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("_p"))
    rows = rows.filter(F.size("_p") >= least).withColumn("_p", F.col("_p.close"))
    rows = rows.withColumn("_r", F.transform(F.sequence(F.lit(2), F.size("_p")), lambda i: F.element_at("_p", i) / F.element_at("_p", i - 1) - 1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_m", total(F.col("_r")) / F.size("_r"))
    vol = F.when(F.size("_r") >= 2, F.sqrt(total(F.transform("_r", lambda x: F.pow(x - F.col("_m"), 2))) / (F.size("_r") - 1) * year))
    rows = rows.select("shock", "phase", "ticker", vol.alias("_vol"), drawdown(F.col("_p")).alias("_mdd")).join(groups, ["shock", "ticker"])
    middle = lambda c: F.percentile(c, F.lit(0.5))
    return rows.groupBy("shock", "phase", "anchor_date", "state").agg(F.avg("_vol").alias("mean_vol"), middle("_vol").alias("median_vol"), F.avg("_mdd").alias("mean_mdd"), middle("_mdd").alias("median_mdd"), F.count("*").alias("n"))


def sector_effect(rows: DataFrame, base: str, case: str, risky: str, least: int = 10) -> DataFrame:
    """By sector: candidates of two policies and the share of them that turned out risky; sectors with fewer than `least` of the base are left out."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    wrong = lambda c: F.avg(F.when(yes(c), F.col(risky).cast("double")))
    out = rows.filter("sector is not null").groupBy("sector").agg(
        F.count("*").alias("n_rows"), F.count(F.when(yes(base), 1)).alias("base_candidates"), F.count(F.when(yes(case), 1)).alias("case_candidates"), wrong(base).alias("base_false_stable"), wrong(case).alias("case_false_stable")
    )
    return out.filter(F.col("base_candidates") >= least)


def stable_share(rows: DataFrame, stable: str) -> DataFrame:
    """Observations and the share of stable ones by known sector."""
    out = rows.filter(F.upper(F.coalesce("sector", F.lit("unknown"))) != "UNKNOWN").groupBy("sector").agg(F.count("*").alias("observations"), F.count(F.when(F.col(stable), 1)).alias("stable_n"))
    return out.withColumn("stable_share", F.col("stable_n") / F.col("observations"))


def planned_size(margin: float, p: float = 0.5, z: float = 1.96) -> int:
    """Observations for which a share of p is known to plus or minus margin."""
    return math.ceil(z * z * p * (1 - p) / (margin * margin))


def interval_recall(rows: DataFrame, calendar: DataFrame, every: list[int], label: str, predicted: str, margin: float = 0.15) -> DataFrame:
    """Recall of the risky rows by rebalance interval (each k-th session) and known sector, with Wilson bounds and whether its size was planned for.

    One pass: a row counts in every interval that holds its session.
    """
    days = calendar.select("date", F.explode(F.filter(F.array(*(F.lit(k) for k in every)), lambda k: (F.col("session_no") - 1) % k == 0)).alias("interval"))
    y, p = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    known = rows.filter(F.upper(F.coalesce("sector", F.lit("unknown"))) != "UNKNOWN").join(F.broadcast(days), "date")
    out = known.groupBy("interval", "sector").agg(F.count("*").alias("n_rows"), F.count(F.when(y, 1)).alias("actual_risky_n"), F.count(F.when(y & p, 1)).alias("found_n"))
    low, high = wilson(F.col("found_n"), F.nullif(F.col("actual_risky_n"), F.lit(0)))
    status = F.when(F.col("actual_risky_n") >= planned_size(margin), "CONFIRMATORY").otherwise("EXPLORATORY")
    return out.withColumns({"recall": F.col("found_n") / F.nullif(F.col("actual_risky_n"), F.lit(0)), "low": low, "high": high, "status": status})
