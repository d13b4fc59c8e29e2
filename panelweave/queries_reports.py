"""Registered queries of cleaning, joins, policies, diagnostics and comparison tables, each with its SQL twin."""

from pyspark.sql import functions as F

from panelweave.functions import frames as W
from panelweave.operators import clean, joins, labels, portfolio, reports, stats, tables, xsec
from panelweave.operators.clusters import cut
from panelweave.queries import CAPPED, HORIZON, IC, LAG, MARKS, PICKS, PRED, RANKS, RISK, SETTLED, YEAR, A, S, panel, picks, predictions, query, r6, risk_rows, signals

RANKED = RANKS.replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ")
CLUSTER = ", st AS (SELECT ticker, date, session_no, mom6, vol6, sector, CASE WHEN bucket = 1 THEN 'low' WHEN bucket = 5 THEN 'high' ELSE 'mid' END AS state FROM bk)"


def states(spark, sf):
    rows = xsec.buckets(signals(spark, sf), "mom6", 5)
    return rows.withColumn("state", F.when(F.col("bucket") == 1, "low").when(F.col("bucket") == 5, "high").otherwise("mid"))


def flags(spark, sf):
    return A.monthly_bars(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "source")


@query("p2_rename", " SELECT CASE WHEN ticker = 'S1' THEN 'X1' ELSE ticker END AS ticker, count(*) AS n FROM bars GROUP BY 1")
def p2(spark, sf):
    aliases = spark.createDataFrame([("S1", "X1"), ("S2", "X2")], "old string, new string")
    return clean.rename_tickers(A.monthly_bars(spark, sf), aliases, deny=["S2"]).groupBy("ticker").agg(F.count("*").alias("n"))


@query("p3_columns", "SELECT l_shipdate AS date, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1")
def p3(spark, sf):
    rows = clean.standard_columns(A.table(spark, sf, "lineitem"), {"date": ["day", "l_shipdate", "l_commitdate"], "volume": ["l_quantity"], "other": ["none"]})
    return rows.groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), F.sum("volume").cast("long").alias("volume"))


@query("p13_universe_contract", """ SELECT ticker, date, CASE WHEN volume % 3 = 2 THEN 'known_late' WHEN volume % 5 = 0 THEN 'unmatched' WHEN volume % 2 = 0 THEN 'ineligible' END AS note,
 volume % 3 <> 2 AND volume % 5 <> 0 AND volume % 2 = 1 AS eligible FROM bars""")
def p13(spark, sf):
    b, v = A.monthly_bars(spark, sf), F.col("volume")
    pit = b.filter((v % 3 == 2) | (v % 5 != 0)).select("date", "ticker", (v % 2 == 1).alias("eligible"), F.date_add("date", F.when(v % 3 == 2, 1).otherwise(0)).alias("known_at"))
    return clean.universe_contract(b, pit.unionByName(pit)).select("ticker", "date", "note", "eligible")


@query("p15_last_sector", "SELECT o_custkey AS ticker, arg_max(o_orderpriority, o_orderkey) AS sector FROM orders GROUP BY 1")
def p15(spark, sf):
    rows = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("sector"), "o_orderkey")
    return clean.last_sector(rows, "o_orderkey")


@query("p17_complete_windows", " SELECT ticker, date FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM sig WHERE vol6 IS NOT NULL) WHERE n >= 5")
def p17(spark, sf):
    return clean.complete_windows(signals(spark, sf), ["mom6", "vol6"], 5).select("ticker", "date")


@query("p18_complete_tickers", " SELECT ticker FROM bars WHERE year(date) = 1995 GROUP BY 1 HAVING count(DISTINCT date) = 12")
def p18(spark, sf):
    return clean.complete_tickers(A.monthly_bars(spark, sf), A.market(spark, sf).filter("year(date) = 1995"))


@query("p19_universe", "SELECT CASE WHEN p_brand = 'Brand#11' THEN 'BRAND#99' ELSE upper(p_brand) END AS ticker, arg_min(p_type, p_partkey) AS sector FROM part GROUP BY 1")
def p19(spark, sf):
    aliases = spark.createDataFrame([("BRAND#11", "BRAND#99")], "old string, new string")
    return reports.universe(A.table(spark, sf, "part"), {"ticker": ["symbol", "p_brand"], "sector": ["p_type"]}, aliases, "p_partkey").select("ticker", "sector")


@query("p20_hand_off", " SELECT ticker, date, mom6 FROM sig")
def p20(spark, sf):
    return clean.hand_off(signals(spark, sf), ["ticker", "date", "mom6"])


@query("p10_finite", " SELECT count(*) AS n FROM feat WHERE vol6 IS NOT NULL AND mom6 IS NOT NULL")
def p10(spark, sf):
    rows = panel(spark, sf).withColumns({"vol6": W.volatility("r", 6, YEAR), "mom6": W.momentum("close", 6)})
    return rows.filter(clean.finite("vol6", "mom6")).agg(F.count("*").alias("n"))


@query("p14_span", " SELECT ticker, date, CASE WHEN date_diff('day', date, lead(date, 6) OVER w) <= 190 THEN round(lead(close, 6) OVER w / close - 1, 6) END AS target_ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def p14(spark, sf):
    return labels.row_shift_target(A.monthly_bars(spark, sf), 6, most_days=190).select("ticker", "date", *r6("target_ret"))


@query("q3_calendar", " SELECT 'close_not_positive' AS rule, count(*) FILTER (WHERE NOT close > 0) AS n FROM bars UNION ALL SELECT 'date_off_calendar', count(*) FROM bars WHERE date NOT IN (SELECT date FROM cal WHERE session_no % 2 = 0)")
def q3(spark, sf):
    return clean.calendar_contract(A.monthly_bars(spark, sf), A.market(spark, sf).filter("session_no % 2 = 0"))


@query("q4_constant", " SELECT date, count(DISTINCT volume) AS n_values FROM bars GROUP BY 1 HAVING count(DISTINCT volume) > 1")
def q4(spark, sf):
    return clean.constant_by_date(A.monthly_bars(spark, sf), "volume")


@query("q6_membership", " SELECT count(*) FILTER (WHERE ticker IS NULL) AS null_ticker, count(*) FILTER (WHERE start_date IS NULL) AS null_start, count(*) FILTER (WHERE end_date <= start_date) AS end_not_after_start FROM member")
def q6(spark, sf):
    return clean.membership_contract(A.membership(spark, sf, A.market(spark, sf)))


@query("s8_tidy", """, t AS (SELECT try_cast(CASE WHEN l_linenumber = 7 THEN 'bad' ELSE CAST(l_shipdate AS VARCHAR) END AS DATE) AS d, try_cast(CASE WHEN l_linenumber = 6 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS c FROM lines)
SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM t WHERE d IS NOT NULL AND c > 0 GROUP BY 1""")
def s8(spark, sf):
    q = F.when(F.col("l_linenumber") == 6, "x").otherwise(F.col("l_quantity").cast("string"))
    day = F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    raw = A.table(spark, sf, "lineitem").select(day.alias("date"), F.lit("T").alias("ticker"), *(q.alias(c) for c in ("open", "high", "low", "close", "volume")))
    return S.tidy(raw, "R").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.sum("close").cast("long").alias("total"))


@query("s9_clip", " SELECT ticker, count(*) AS n FROM bars WHERE date >= DATE '1994-01-01' AND date < DATE '1995-03-01' GROUP BY 1")
def s9(spark, sf):
    return S.clip(A.monthly_bars(spark, sf), "1994-01-01", "1995-03-01").groupBy("ticker").agg(F.count("*").alias("n"))


@query("s10_back_adjust", " SELECT ticker, date, round(open * k, 6) AS open, round(close * k, 6) AS close FROM (SELECT *, CASE WHEN volume % 4 = 0 THEN 1 ELSE low / close END AS k FROM bars)")
def s10(spark, sf):
    rows = A.monthly_bars(spark, sf).withColumn("adj_close", F.when(F.col("volume") % 4 != 0, F.col("low")))
    return S.back_adjust(rows).select("ticker", "date", *r6("open", "close"))


@query("s11_upsert", """, f AS (SELECT ticker, date, l_returnflag AS source, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lines GROUP BY ALL)
SELECT ticker, date, source, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY source DESC) AS k FROM f WHERE ticker <> 'S1') WHERE k = 1""")
def s11(spark, sf):
    rows = flags(spark, sf).select("ticker", "date", "source", "volume")
    bad = rows.filter("ticker = 'S1'").select("ticker", "date").distinct()
    return S.upsert_latest(rows.filter("source <> 'R'"), rows.filter("source = 'R'"), ["ticker", "date"], "source", bad)


@query("s13_benchmark", " SELECT date, arg_max(close, ticker) AS close FROM bars GROUP BY 1")
def s13(spark, sf):
    return S.benchmark(A.monthly_bars(spark, sf), "ticker")


@query("j5_weekly", """, wk AS (SELECT ticker, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
d AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY week) AS d FROM wk), e AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS v FROM d),
v AS (SELECT ticker, week, CASE WHEN count(d) OVER w = 4 THEN CASE WHEN avg(u) OVER w = 0 AND avg(v) OVER w = 0 THEN 50 WHEN avg(v) OVER w = 0 THEN 100 ELSE 100 - 100 / (1 + avg(u) OVER w / avg(v) OVER w) END END AS x FROM e WINDOW w AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
h AS (SELECT ticker, week, lag(x) OVER (PARTITION BY ticker ORDER BY week) AS x FROM v), k AS (SELECT ticker, week, x FROM h WHERE x IS NOT NULL)
SELECT b.ticker, b.date, round(k.x, 6) AS rsi FROM bars b ASOF LEFT JOIN k ON b.ticker = k.ticker AND b.date >= k.week""")
def j5(spark, sf):
    b = A.monthly_bars(spark, sf)
    weekly = reports.weekly_rsi(b, 4).withColumnRenamed("week", "date")
    return joins.as_of(b.select("ticker", "date"), weekly, "rsi").select("ticker", "date", *r6("rsi"))


@query("j7_one_to_one", " SELECT s.ticker, s.date, round(mom6, 6) AS mom6, volume FROM sig s")
def j7(spark, sf):
    return reports.attach_one_to_one(signals(spark, sf).select("ticker", "date", "mom6"), A.monthly_bars(spark, sf).select("ticker", "date", "volume"), ["ticker", "date"]).select("ticker", "date", *r6("mom6"), "volume")


@query("j10_paired", """, f AS (SELECT date, l_returnflag AS s, count(*)::DOUBLE AS n FROM lines GROUP BY ALL), a AS (SELECT * FROM f WHERE s = 'A'), b AS (SELECT * FROM f WHERE s = 'N')
SELECT coalesce(a.date, b.date) AS date, a.n AS case_value, b.n AS base_value, a.n - b.n AS difference FROM a FULL JOIN b ON a.date = b.date""")
def j10(spark, sf):
    rows = A.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date"), "l_returnflag").agg(F.count("*").cast("double").alias("n"))
    return joins.paired(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'N'"), "date", "n")


@query("j13_outside_shocks", " SELECT ticker, start_date AS l, coalesce(end_date, DATE '1999-01-01') AS r FROM member WHERE NOT (start_date <= DATE '1992-06-30' AND coalesce(end_date, DATE '1999-01-01') >= DATE '1992-03-01')")
def j13(spark, sf):
    spans = A.membership(spark, sf, A.market(spark, sf)).select("ticker", F.col("start_date").alias("l"), F.coalesce("end_date", F.lit("1999-01-01").cast("date")).alias("r"))
    shocks = spark.sql("SELECT DATE '1992-03-01' AS start, DATE '1992-06-30' AS end")
    return joins.outside_shocks(spans, shocks)


@query("j14_overlap", CAPPED + """, low AS (SELECT date, ticker FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY round(vol6, 10), ticker) AS k FROM sig WHERE vol6 IS NOT NULL) WHERE k <= 10)
SELECT 'calm' AS a, 'momentum' AS b, count(*) AS n_common, count(DISTINCT date) AS n_dates FROM top JOIN low USING (date, ticker)""")
def j14(spark, sf):
    s = signals(spark, sf)
    one = xsec.capped_top(s, "mom6", 10).select("date", "ticker", F.lit("momentum").alias("model"))
    two = xsec.lowest(s.withColumn("v", F.round("vol6", 10)), "v", 10).select("date", "ticker", F.lit("calm").alias("model"))
    return joins.holdings_overlap(cut(one.unionByName(two)))  # at most twenty rows a date


@query("j15_settlements", """, x AS (SELECT *, CASE WHEN volume % 2 = 0 THEN target_simple END AS had, target_simple + CASE WHEN volume % 7 = 0 THEN 0.01 ELSE 0 END AS paid, volume % 3 <> 0 AS verified FROM lab WHERE observed AND target_simple IS NOT NULL)
SELECT count(*) AS n, count(coalesce(had, CASE WHEN verified THEN paid END)) AS n_known, round(sum(coalesce(had, CASE WHEN verified THEN paid END)), 4) AS total FROM x""")
def j15(spark, sf):
    from panelweave.queries import labelled

    rows = labelled(spark, sf).filter("observed and target_simple is not null").select("date", "ticker", "entry_date", "exit_date", "volume", "target_simple")
    paid = rows.select("date", "ticker", "entry_date", "exit_date", (F.col("target_simple") + F.when(F.col("volume") % 7 == 0, 0.01).otherwise(0.0)).alias("simple_return"), (F.col("volume") % 3 != 0).alias("verified"))
    had = rows.select("date", "ticker", "entry_date", "exit_date", F.when(F.col("volume") % 2 == 0, F.col("target_simple")).alias("simple_return"))
    return joins.attach_settlements(had, paid)[0].agg(F.count("*").alias("n"), F.count("simple_return").alias("n_known"), F.round(F.sum("simple_return"), 4).alias("total"))


@query("w2_simple_return", " SELECT ticker, date, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY session_no) - 1, 6) AS r FROM panel QUALIFY observed")
def w2(spark, sf):
    return joins.densify(A.monthly_bars(spark, sf), A.market(spark, sf)).withColumn("r", W.simple_return()).filter("observed").select("ticker", "date", *r6("r"))


BETA8 = "count(r) OVER w >= 8 THEN covar_samp(r, CASE WHEN r IS NOT NULL THEN m END) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0)"


@query("w6_beta_least", f" SELECT ticker, date, round(CASE WHEN {BETA8} END, 6) AS beta FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY observed")
def w6(spark, sf):
    return panel(spark, sf).withColumn("beta", W.beta("r", "m", 12, least=8)).filter("observed").select("ticker", "date", *r6("beta"))


VOLS = """, vs AS (SELECT *, CASE WHEN count(r) OVER a = 3 THEN stddev_samp(r) OVER a * sqrt(12) END AS v3, CASE WHEN count(r) OVER b = 6 THEN stddev_samp(r) OVER b * sqrt(12) END AS v6, CASE WHEN count(r) OVER c = 12 THEN stddev_samp(r) OVER c * sqrt(12) END AS v12 FROM rets
 WINDOW a AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), c AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def vols(spark, sf):
    return panel(spark, sf).withColumns({f"v{n}": W.volatility("r", n, YEAR) for n in (3, 6, 12)})


@query("w18_differences", VOLS + " SELECT ticker, date, round(v3 - v6, 6) AS v_diff_0, round(v6 - v12, 6) AS v_diff_1 FROM vs WHERE observed")
def w18(spark, sf):
    made = reports.adjacent_differences({"v": ["v3", "v6", "v12"]})
    return vols(spark, sf).withColumns(made).filter("observed").select("ticker", "date", *r6(*made))


@query("w19_ratios", VOLS + " SELECT ticker, date, round(v3 / nullif(v6, 0), 6) AS ratio_v3_v6, round(v6 / nullif(v12, 0), 6) AS ratio_v6_v12 FROM vs WHERE observed")
def w19(spark, sf):
    made = reports.volatility_ratios(["v3", "v6", "v12"])
    return vols(spark, sf).withColumns(made).filter("observed").select("ticker", "date", *r6(*made))


@query("w21_interactions", VOLS + " SELECT ticker, date, round(v6 * m, 6) AS v6_x_market FROM vs WHERE observed")
def w21(spark, sf):
    return vols(spark, sf).withColumn("v6_x_market", F.col("v6") * F.col("m")).filter("observed").select("ticker", "date", *r6("v6_x_market"))


@query("w23_drift", ", d AS (SELECT mom6, mom6 - lag(mom6) OVER (PARTITION BY ticker ORDER BY session_no) AS d FROM sig WHERE session_no % 6 = 1) SELECT round(stddev_samp(d), 6) AS drift, round(stddev_samp(mom6), 6) AS level, count(d) AS n, round(stddev_samp(d) / stddev_samp(mom6), 6) AS ratio FROM d")
def w23(spark, sf):
    return reports.snapshot_drift(signals(spark, sf).filter("session_no % 6 = 1"), "mom6").select(*r6("drift", "level"), "n", *r6("ratio"))


@query("w24_ready", VOLS + " SELECT ticker, date, coalesce(sum(CAST(v6 IS NOT NULL AND r IS NOT NULL AS INTEGER)) OVER (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6, false) AS ready FROM vs")
def w24(spark, sf):
    return vols(spark, sf).withColumn("ready", reports.ready(["v6", "r"], 6)).select("ticker", "date", "ready")


@query("w25_sequences", VOLS + """, s AS (SELECT ticker, date, count(CASE WHEN v6 IS NOT NULL AND r IS NOT NULL THEN 1 END) OVER w AS n, list(r) OVER w AS x FROM vs WINDOW w AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT ticker, date, array_to_string(list_transform(x, lambda v: CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR)), ' ') AS sequence FROM s WHERE n = 6""")
def w25(spark, sf):
    rows = reports.sequences(vols(spark, sf), ["v6", "r"], 6)
    return rows.select("ticker", "date", F.array_join(F.transform("sequence", lambda x: F.round(x["r"] * 10000).cast("long").cast("string")), " ").alias("sequence"))


@query("l6_thresholds", RISK + ", q AS (SELECT date, quantile_cont(z, [0.8, 0.7, 0.6]) AS c FROM s GROUP BY date), c AS (SELECT date, unnest([0.2, 0.3, 0.4])::DOUBLE AS share, round(unnest(c), 10) AS cut FROM q) SELECT share, count(*) AS n, count(*) FILTER (WHERE z >= cut) AS n_risky FROM s JOIN c USING (date) GROUP BY share")
def l6(spark, sf):
    return reports.threshold_sweep(risk_rows(spark, sf), "risk_score", [0.2, 0.3, 0.4])


@query("l7_future_close", " SELECT ticker, date, lead(close, 7) OVER (PARTITION BY ticker ORDER BY session_no) AS future FROM panel QUALIFY observed")
def l7(spark, sf):
    return panel(spark, sf).withColumn("future", reports.future_close(HORIZON, LAG)).filter("observed").select("ticker", "date", "future")


@query("l8_graded", " SELECT ticker, date, CAST(least(greatest(ceil(row_number() OVER (PARTITION BY date ORDER BY mom6, ticker) * 5.0::DOUBLE / count(*) OVER (PARTITION BY date)), 1), 5) - 1 AS INTEGER) AS grade FROM sig")
def l8(spark, sf):
    return signals(spark, sf).withColumn("grade", labels.graded("mom6")).select("ticker", "date", "grade")


@query("l13_recent", " SELECT ticker, date FROM bars WHERE date >= DATE '1995-06-01' - INTERVAL 18 MONTH AND date < DATE '1995-06-01'")
def l13(spark, sf):
    rows = A.monthly_bars(spark, sf).withColumn("day", F.lit("1995-06-01").cast("date"))
    return labels.recent(rows, "day", 18).filter("date < day").select("ticker", "date")


@query("l14_leaks", " SELECT count(*) FILTER (WHERE date < DATE '1995-06-01') AS n_before, count(*) FILTER (WHERE date < DATE '1995-06-01' AND exit_date >= DATE '1995-06-01') AS n_leaked FROM sig")
def l14(spark, sf):
    return labels.leaks(signals(spark, sf), "1995-06-01")


@query("l16_fold_bounds", ", d AS (SELECT DISTINCT date FROM feat WHERE vol6 IS NOT NULL), k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM d) SELECT CAST(least(floor(i * 5 / n::DOUBLE), 4) AS INTEGER) AS fold, min(date) AS start, max(date) AS end, count(*) AS n_dates FROM k GROUP BY 1 HAVING least(floor(i * 5 / n::DOUBLE), 4) > 0".replace("GROUP BY 1 HAVING least(floor(i * 5 / n::DOUBLE), 4) > 0", "WHERE floor(i * 5 / n::DOUBLE) > 0 GROUP BY 1"))
def l16(spark, sf):
    return reports.fold_bounds(panel(spark, sf).withColumn("vol6", W.volatility("r", 6, YEAR)), "vol6", 4)


@query("l18_inner_split", """, t AS (SELECT *, (SELECT max(date) FROM sig WHERE exit_date < DATE '1996-01-01') - 365 AS v FROM sig WHERE exit_date < DATE '1996-01-01')
SELECT CASE WHEN date >= v THEN 'validation' WHEN exit_date < v THEN 'inner' END AS part, count(*) AS n FROM t GROUP BY 1""")
def l18(spark, sf):
    return reports.inner_split(signals(spark, sf).filter("exit_date < DATE '1996-01-01'")).groupBy("part").agg(F.count("*").alias("n"))


@query("l19_yearly", " SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY year(date) ORDER BY date) AS k FROM cal) WHERE k <= 6 AND (k - 1) % 2 = 0")
def l19(spark, sf):
    return labels.yearly_snapshots(A.market(spark, sf), first=6, every=2).select("date")


@query("c2_minimum_rank", " SELECT ticker, date, CAST(rank() OVER (PARTITION BY date ORDER BY mom6) AS INTEGER) AS place FROM sig")
def c2(spark, sf):
    return signals(spark, sf).withColumn("place", xsec.minimum_rank("mom6", "date")).select("ticker", "date", "place")


PCT = "(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by})"


@query("c12_composite", f", k AS (SELECT ticker, date, 1 - {PCT.format(by='date', c='v')} AS a, {PCT.format(by='date', c='mom6')} AS b FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)) SELECT ticker, date, round(a, 6) AS stability, round(b, 6) AS profitability, round((a + b) / 2, 6) AS selection FROM k")
def c12(spark, sf):
    rows = signals(spark, sf).filter("vol6 is not null").withColumn("v", F.round("vol6", 10))
    return reports.composite(rows, ["v"], ["mom6"]).select("ticker", "date", *r6("stability", "profitability", "selection"))


#: Twice the mean rank, a whole number. v and mom6 are both known in every row of c13, so the sum of both orders as their mean percentile does, without its rounding.
TWICE = "2 * rank() OVER (PARTITION BY {by} ORDER BY {c}) + count(*) OVER (PARTITION BY {by}, {c}) - 1"


@query("c13_within", RANKED + CLUSTER + f", k AS (SELECT ticker, date, state, {TWICE.format(by='date, state', c='v')} + {TWICE.format(by='date, state', c='mom6')} AS w FROM (SELECT *, round(vol6, 10) AS v FROM st WHERE vol6 IS NOT NULL)) SELECT ticker, date, state, CAST(row_number() OVER (PARTITION BY date, state ORDER BY w, ticker) AS INTEGER) AS within_rank FROM k")
def c13(spark, sf):
    rows = states(spark, sf).filter("vol6 is not null").withColumn("v", F.round("vol6", 10))
    return reports.rank_within(rows, "state", ["v", "mom6"]).select("ticker", "date", "state", "within_rank")


@query("c14_ablation", RANKED + CLUSTER + ", k AS (SELECT *, sum(CAST(state = 'low' AS INTEGER)) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY round(vol6, 10) NULLS LAST, ticker) AS a, row_number() OVER (PARTITION BY date ORDER BY mom6, ticker) AS b FROM st) SELECT date, count(*) FILTER (WHERE a <= n) AS n_vol, count(*) FILTER (WHERE b <= n AND state = 'low') AS n_both FROM k GROUP BY date")
def c14(spark, sf):
    rows = states(spark, sf).withColumn("v", F.round("vol6", 10)).withColumn("stable", F.col("state") == "low")
    out = reports.axis_ablation(rows, ["v", "mom6"])
    return out.groupBy("date").agg(F.count(F.when(F.col("by_v"), 1)).alias("n_vol"), F.count(F.when(F.col("by_mom6") & F.col("stable"), 1)).alias("n_both"))


@query("c15_warnings", f" SELECT ticker, date, {PCT.format(by='date', c='mom6')} >= 0.8 AS acceleration_warning, {PCT.format(by='date', c='v')} >= 0.8 AS downside_warning FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)")
def c15(spark, sf):
    rows = signals(spark, sf).filter("vol6 is not null").withColumn("v", F.round("vol6", 10))
    return tables.warnings(rows, "mom6", "v").select("ticker", "date", "acceleration_warning", "downside_warning")


LONG = ", lg AS (SELECT ticker, date, CASE WHEN p <= 0.2 THEN 'low' WHEN p > 0.8 THEN 'high' ELSE 'mid' END AS long_state FROM (SELECT ticker, date, " + PCT.format(by="date", c="v") + " AS p FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)))"


@query("c16_policies", RANKED + CLUSTER + LONG + " SELECT date, count(*) AS n, count(*) FILTER (WHERE state = 'low' AND long_state = 'low') AS strict, count(*) FILTER (WHERE state = 'low' AND long_state <> 'high') AS loose, count(*) FILTER (WHERE state = 'low' AND long_state <> 'high' AND mom6 > -0.2) AS balanced FROM st JOIN lg USING (ticker, date) GROUP BY date")
def c16(spark, sf):
    rows = states(spark, sf).filter("vol6 is not null").withColumn("v", F.round("vol6", 10)).withColumn("p", xsec.percentile_rank("v", "date"))
    rows = rows.withColumn("long_state", F.when(F.col("p") <= 0.2, "low").when(F.col("p") > 0.8, "high").otherwise("mid")).withColumn("short_state", F.col("state")).withColumn("warning", F.col("mom6") <= -0.2)
    return reports.cross_window_flags(rows).groupBy("date").agg(F.count("*").alias("n"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in ("strict", "loose", "balanced")))


@query("c19_trailing_ic", PRED + IC + """, av AS (SELECT ic.*, x.date AS available_at FROM ic JOIN cal c ON c.date = ic.date JOIN cal x ON x.session_no = c.session_no + 7), sg AS (SELECT date AS signal FROM cal WHERE session_no % 6 = 1),
tk AS (SELECT signal, model, ic, row_number() OVER (PARTITION BY model, signal ORDER BY av.date DESC) AS k FROM av JOIN sg ON available_at < signal) SELECT signal, model, round(avg(ic), 6) AS ic, count(*) AS n FROM tk WHERE k <= 3 GROUP BY ALL""")
def c19(spark, sf):
    cal = A.market(spark, sf)
    ends = cal.select((F.col("session_no") - LAG - HORIZON).alias("session_no"), F.col("date").alias("available_at")).join(cal.select("session_no", "date"), "session_no").select("date", "available_at")
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date")).join(F.broadcast(ends), "date")
    return reports.trailing_ic(ic, cal.filter("session_no % 6 = 1")).select("signal", "model", *r6("ic"), "n")


@query("c20_signed", PRED + IC + ", w AS (SELECT model, CASE WHEN avg(ic) FILTER (WHERE date < DATE '1995-01-01') < 0 THEN -1 ELSE 1 END AS d FROM ic GROUP BY model) SELECT model, round(avg(pred * d), 6) AS mean_pred, count(*) AS n FROM preds JOIN w USING (model) GROUP BY model")
def c20(spark, sf):
    p = predictions(spark, sf)
    ic = stats.daily_ic(p, "pred", "target_excess", ("model", "date")).filter("date < DATE '1995-01-01'")
    return reports.signed(p, ic).groupBy("model").agg(F.round(F.avg("pred"), 6).alias("mean_pred"), F.count("*").alias("n"))


@query("c21_profile", RANKED + CLUSTER + " SELECT state, count(*) AS n, round(avg(mom6), 6) AS mean_mom6, round(quantile_cont(mom6, 0.5), 6) AS median_mom6 FROM st GROUP BY state")
def c21(spark, sf):
    return reports.profile_by(states(spark, sf), "state", ["mom6"]).select("state", "n", *r6("mean_mom6", "median_mom6"))


@query("g2_failures", " SELECT ticker, CASE WHEN ticker NOT IN (SELECT ticker FROM bars) THEN 'collect' ELSE 'clean' END AS stage FROM sect WHERE ticker NOT IN (SELECT ticker FROM bars WHERE volume >= 30 AND date < DATE '1992-04-01')")
def g2(spark, sf):
    b = A.monthly_bars(spark, sf)
    return reports.failures(A.sectors(spark, sf), b, b.filter("volume >= 30 and date < DATE '1992-04-01'")).select("ticker", "stage")


@query("g7_policies", RISK + """, p AS (SELECT *, d > -0.3 AS calm, v < 0.8 AS quiet FROM risk)
SELECT 'calm' AS policy, count(*) FILTER (WHERE calm) AS selected, round(avg(CAST(calm AS DOUBLE)), 6) AS retention, round(avg(CAST(risky AS DOUBLE)) FILTER (WHERE calm), 6) AS false_stable_rate, round(avg(CAST(d <= -0.2 AS DOUBLE)) FILTER (WHERE calm), 6) AS mdd_breach, round(avg(d) FILTER (WHERE calm), 6) AS mean_future_mdd FROM p
UNION ALL SELECT 'quiet', count(*) FILTER (WHERE quiet), round(avg(CAST(quiet AS DOUBLE)), 6), round(avg(CAST(risky AS DOUBLE)) FILTER (WHERE quiet), 6), round(avg(CAST(d <= -0.2 AS DOUBLE)) FILTER (WHERE quiet), 6), round(avg(d) FILTER (WHERE quiet), 6) FROM p""")
def g7(spark, sf):
    rows = risk_rows(spark, sf).withColumn("calm", F.col("future_mdd") > -0.3).withColumn("quiet", F.col("future_vol") < 0.8)
    return tables.policy_summary(rows, ["calm", "quiet"], -0.2).select("policy", "selected", *r6("retention", "false_stable_rate", "mdd_breach", "mean_future_mdd"))


@query("g8_sector_effect", RISK + " SELECT sector, count(*) AS n, round(avg(CAST(risky AS DOUBLE)), 6) AS risky, round(avg(d), 6) AS future_mdd FROM risk JOIN sect USING (ticker) GROUP BY sector")
def g8(spark, sf):
    rows = risk_rows(spark, sf).withColumn("risky", F.col("future_risky").cast("double"))
    return rows.groupBy("sector").agg(F.count("*").alias("n")).join(reports.mean_by(rows, "sector", ["risky", "future_mdd"]), "sector").select("sector", "n", *r6("risky", "future_mdd"))


@query("g10_exposure", PICKS + " SELECT period, sector, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY period), 6) AS weight FROM held GROUP BY period, sector")
def g10(spark, sf):
    return reports.exposure(picks(spark, sf), ["period"]).select("period", "sector", "n", *r6("weight"))


@query("g12_retention", RANKED + CLUSTER + """, pr AS (SELECT a.state, CAST(a.state = b.state AS DOUBLE) AS same, a.session_no BETWEEN 30 AND 40 AS shock FROM st a JOIN st b ON a.ticker = b.ticker AND b.session_no = a.session_no + 6)
SELECT state, round(avg(same) FILTER (WHERE shock), 6) AS shock, round(avg(same) FILTER (WHERE NOT shock), 6) AS normal, count(*) AS n, round(100 * (avg(same) FILTER (WHERE shock) - avg(same) FILTER (WHERE NOT shock)), 4) AS delta_pp FROM pr GROUP BY state""")
def g12(spark, sf):
    rows = states(spark, sf).select("ticker", "session_no", "state")
    return reports.retention(rows, 6, F.col("session_no").between(30, 40)).select("state", *r6("shock", "normal"), "n", F.round("delta_pp", 4).alias("delta_pp"))


@query("g13_shock", RANKED + CLUSTER + """, g AS (SELECT ticker, state AS grp FROM st WHERE session_no = 24), ph AS (SELECT session_no, CASE WHEN session_no < 30 THEN 'PRE' WHEN session_no <= 34 THEN 'SHOCK' ELSE 'POST' END AS phase FROM cal WHERE session_no BETWEEN 25 AND 39),
e AS (SELECT phase, grp, ticker, stddev_samp(r) AS v, exp(sum(r)) - 1 AS t FROM rets JOIN ph USING (session_no) JOIN g USING (ticker) GROUP BY ALL) SELECT phase, grp AS group, count(*) AS n, round(avg(v), 6) AS mean_vol, round(avg(t), 6) AS mean_return FROM e GROUP BY phase, grp""".replace("AS group,", 'AS "group",'))
def g13(spark, sf):
    groups = states(spark, sf).filter("session_no = 24").select("ticker", F.col("state").alias("group"))
    phases = reports.shock_windows(A.market(spark, sf), 30, 34)
    return reports.realised(panel(spark, sf), phases, groups).select("phase", "group", "n", *r6("mean_vol", "mean_return"))


@query("g14_paired_scopes", PICKS + """, pa AS (SELECT period, avg(target_simple) AS r FROM held GROUP BY 1), pb AS (SELECT CAST((session_no - 13) / 6 AS INTEGER) AS period, avg(target_simple) AS r FROM sig WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal) GROUP BY 1)
SELECT count(*) FILTER (WHERE pa.r IS NOT NULL AND pb.r IS NOT NULL) AS n_both, count(*) AS n_periods, round(avg(pb.r), 6) AS mean_base, round(avg(pa.r), 6) AS mean_case, count(*) FILTER (WHERE round(pa.r, 10) > round(pb.r, 10)) AS wins FROM pa FULL JOIN pb USING (period)""")
def g14(spark, sf):
    days = labels.schedule(A.market(spark, sf), 13, HORIZON, HORIZON, LAG).select("date", "period")
    case = picks(spark, sf).groupBy("period").agg(F.avg("target_simple").alias("r")).withColumn("strategy", F.lit("case"))
    base = signals(spark, sf).join(F.broadcast(days), "date").groupBy("period").agg(F.avg("target_simple").alias("r")).withColumn("strategy", F.lit("base"))
    return reports.paired_scopes(case.unionByName(base), "base", "case").select("n_both", "n_periods", *r6("mean_base", "mean_case"), "wins")


@query("g16_yearly_ic", PRED + IC + " SELECT CAST(year(date) AS INTEGER) AS year, round(avg(ic) FILTER (WHERE model = 'momentum'), 6) AS momentum, round(avg(ic) FILTER (WHERE model = 'low_vol'), 6) AS low_vol FROM ic GROUP BY 1")
def g16(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date"))
    return reports.yearly_pivot(ic, ["momentum", "low_vol"]).select("year", *r6("momentum", "low_vol"))


@query("g16_sign_flips", PRED + IC + ", f AS (SELECT model, avg(ic) FILTER (WHERE date < DATE '1995-01-01') AS a, avg(ic) FILTER (WHERE date >= DATE '1995-01-01') AS b FROM ic GROUP BY model) SELECT model, round(a, 6) AS train_ic, round(b, 6) AS test_ic, sign(a) <> sign(b) AS flipped FROM f")
def g16b(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date"))
    return reports.sign_flips(ic, "1995-01-01").select("model", *r6("train_ic", "test_ic"), "flipped")


@query("g17_mean_by", " SELECT sector, round(avg(mom6), 6) AS mom6, round(avg(vol6), 6) AS vol6 FROM sig GROUP BY sector")
def g17(spark, sf):
    return reports.mean_by(signals(spark, sf), "sector", ["mom6", "vol6"]).select("sector", *r6("mom6", "vol6"))


@query("g18_block_means", ", b AS (SELECT date, m_close, row_number() OVER (ORDER BY date) - 1 AS i FROM cal) SELECT CAST(floor(i / 6.0) AS INTEGER) AS block, round(avg(m_close), 4) AS mean, count(*) AS n FROM b GROUP BY 1 HAVING count(*) = 6")
def g18(spark, sf):
    return tables.block_means(A.market(spark, sf), "m_close", 6).select("block", F.round("mean", 4).alias("mean"), "n")


@query("g19_interval", RISK + " SELECT sector, count(*) AS n_rows, round(avg(CAST(risky AS DOUBLE)), 6) AS future_risky_rate FROM risk JOIN sect USING (ticker) JOIN cal USING (date) WHERE session_no % 3 = 1 GROUP BY sector")
def g19(spark, sf):
    days = A.market(spark, sf).filter("session_no % 3 = 1").select("date")
    return tables.group_risk(risk_rows(spark, sf).join(F.broadcast(days), "date", "left_semi"), "sector", -0.5).select("sector", "n_rows", *r6("future_risky_rate"))


@query("g20_classes", " SELECT ticker, date, CASE WHEN vol6 - 0.5 <= 0 AND mom6 >= 0 THEN 'better' WHEN vol6 - 0.5 > 0 AND mom6 < 0 THEN 'worse' WHEN vol6 - 0.5 <= 0 THEN 'safer' ELSE 'bolder' END AS class FROM sig WHERE vol6 IS NOT NULL")
def g20(spark, sf):
    rows = signals(spark, sf).filter("vol6 is not null")
    return rows.select("ticker", "date", reports.delta_class(F.col("vol6") - 0.5, F.col("mom6")).alias("class"))


@query("t2_stable_first", RANKED + """, f AS (SELECT *, vol6 IS NOT NULL AND vol6 < 0.5 AS stable, count(*) OVER (PARTITION BY date) AS n FROM bk), g AS (SELECT *, CASE WHEN stable THEN 0 ELSE 1 END AS pool FROM f WHERE n >= 5 AND (stable OR bucket = 5)),
h AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY pool, mom6 DESC, ticker) AS s FROM g), i AS (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY pool, mom6 DESC, ticker) AS INTEGER) AS pick FROM h WHERE s <= 5) SELECT date, ticker, pick FROM i WHERE pick <= 10""")
def t2(spark, sf):
    rows = signals(spark, sf).withColumn("stable", F.coalesce(F.col("vol6") < 0.5, F.lit(False)))
    return xsec.stable_first_top(rows, "mom6", 10).select("date", "ticker", "pick")


@query("t5_score_top", f", k AS (SELECT ticker, date, round(({PCT.format(by='date', c='mom6')} + {PCT.format(by='date', c='v')}) / 2, 10) AS s FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)) SELECT date, ticker, pick FROM (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS INTEGER) AS pick FROM k) WHERE pick <= 10")
def t5(spark, sf):
    rows = signals(spark, sf).withColumn("v", F.round("vol6", 10)).filter("v is not null")
    return reports.score_top(rows, ["mom6", "v"], 10).select("date", "ticker", "pick")


@query("t6_top_per_sector", RANKED + " SELECT date, sector, ticker, pick FROM (SELECT date, sector, ticker, CAST(row_number() OVER (PARTITION BY date, sector ORDER BY bucket DESC, vol6 IS NULL, round(vol6, 10), ticker) AS INTEGER) AS pick FROM bk) WHERE pick <= 2")
def t6(spark, sf):
    rows = xsec.buckets(signals(spark, sf), "mom6", 5).withColumn("v", F.round("vol6", 10))
    return reports.top_per_sector(rows, [F.desc("bucket"), F.asc_nulls_last("v")], 2).select("date", "sector", "ticker", "pick")


@query("e3_bucket_coverage", RANKED + " SELECT bucket, count(*) AS n, count(target_excess) AS n_target, round(avg(target_excess), 6) AS mean_target FROM bk GROUP BY bucket")
def e3b(spark, sf):
    return stats.bucket_coverage(signals(spark, sf), "mom6", "target_excess").select("bucket", "n", "n_target", *r6("mean_target"))


@query("e7_neutralised", """, k AS (SELECT ticker, date, rank() OVER (PARTITION BY date ORDER BY mom6) + (count(*) OVER (PARTITION BY date, mom6) - 1) / 2.0 AS y, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS x FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)),
f AS (SELECT ticker, date, y - avg(y) OVER w - coalesce(covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0), 0) * (x - avg(x) OVER w) AS e FROM k WINDOW w AS (PARTITION BY date)) SELECT ticker, date, round(CASE WHEN stddev_pop(e) OVER (PARTITION BY date) > 1e-10 THEN e END, 5) + 0 AS residual FROM f""")
def e7(spark, sf):
    rows = stats.neutralised(signals(spark, sf).withColumn("v", F.round("vol6", 10)), "mom6", ["v"])
    return rows.select("ticker", "date", (F.round("residual", 5) + 0.0).alias("residual"))  # no negative zeros


@query("e8_autocorrelation", PRED + IC + ", s AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic WHERE model = 'momentum') SELECT CAST(b.i - a.i AS INTEGER) AS lag, round(corr(a.ic, b.ic), 6) AS autocorrelation, count(*) AS n FROM s a JOIN s b ON b.i - a.i IN (1, 2, 6) GROUP BY 1")
def e8(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf).filter("model = 'momentum'"), "pred", "target_excess")
    return stats.autocorrelation(ic, "ic", [1, 2, 6]).select("lag", *r6("autocorrelation"), "n")


@query("e11_policy_bootstrap", RISK + """, d AS (SELECT date, avg(CAST(risky AS DOUBLE)) FILTER (WHERE v < 0.8) AS c, avg(CAST(risky AS DOUBLE)) AS b FROM risk GROUP BY date), x AS (SELECT c - b AS d, row_number() OVER (ORDER BY date) - 1 AS i FROM d WHERE c IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, avg(d) AS e FROM x),
r AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || k), 1, 8))::BIGINT % n AS i FROM n, range(1000) q(rep), range(0, n) z(k)), m AS (SELECT rep, round(avg(d), 12) AS m FROM r JOIN x USING (i) GROUP BY rep)
SELECT round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, (SELECT n FROM n) AS n, (SELECT round(e, 6) FROM n) AS difference FROM m""")
def e11(spark, sf):
    risky = F.col("future_risky").cast("double")
    daily = risk_rows(spark, sf).groupBy("date").agg(F.avg(F.when(F.col("future_vol") < 0.8, risky)).alias("case"), F.avg(risky).alias("base"))
    return reports.policy_bootstrap(daily, "case", "base").select(*r6("ci_low", "ci_high"), "n", *r6("difference"))


@query("e11_pooled_bootstrap", RISK + """, d AS (SELECT date, coalesce(sum(CAST(risky AS DOUBLE)) FILTER (WHERE v < 0.8), 0) AS a, count(*) FILTER (WHERE v < 0.8) AS na, sum(CAST(risky AS DOUBLE)) AS b, count(*) AS nb, row_number() OVER (ORDER BY date) - 1 AS i FROM risk GROUP BY date),
n AS (SELECT count(*) AS n, sum(a) / nullif(sum(na), 0) - sum(b) / sum(nb) AS e FROM d), r AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || k), 1, 8))::BIGINT % n AS i FROM n, range(2000) q(rep), range(0, n) z(k)),
m AS (SELECT rep, round(sum(a) / nullif(sum(na), 0) - sum(b) / sum(nb), 12) AS m FROM r JOIN d USING (i) GROUP BY rep)
SELECT count(m) AS n_boot, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, (SELECT n FROM n) AS n_dates, (SELECT round(e, 6) FROM n) AS difference FROM m""")
def e11_pooled(spark, sf):
    rows = risk_rows(spark, sf).select("date", (F.col("future_vol") < 0.8).alias("case"), F.lit(True).alias("base"), "future_risky")
    return reports.pooled_policy_bootstrap(rows, "case", "base", "future_risky").select("n_boot", *r6("ci_low", "ci_high"), "n_dates", *r6("difference"))


HAC = """, y AS (SELECT date, avg(r) AS r, any_value(m) AS m FROM rets WHERE r IS NOT NULL GROUP BY date), f AS (SELECT regr_slope(r, m) AS b, regr_intercept(r, m) AS a, count(*) AS n, sum(m) AS sx, sum(m * m) AS sxx FROM y),
u AS (SELECT row_number() OVER (ORDER BY date) AS i, r - a - b * m AS e, (r - a - b * m) * m AS g FROM y, f), z AS (SELECT p.i - q.i AS k, p.e AS e1, p.g AS g1, q.e AS e0, q.g AS g0 FROM u p JOIN u q ON p.i - q.i BETWEEN 0 AND 3),
s AS (SELECT sum(w * (e1 * e0 * 2)) AS s00, sum(w * (e1 * g0 + e0 * g1)) AS s01, sum(w * (g1 * g0 * 2)) AS s11 FROM (SELECT *, CASE WHEN k = 0 THEN 0.5 ELSE 1 - k / 4.0 END AS w FROM z)),
v AS (SELECT a, b, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11, s00, s01, s11 FROM f, s),
c AS (SELECT a, b, sqrt(i00 * i00 * s00 + 2 * i00 * i01 * s01 + i01 * i01 * s11) AS sa, sqrt(i01 * i01 * s00 + 2 * i01 * i11 * s01 + i11 * i11 * s11) AS sb FROM v)
SELECT 'alpha' AS term, round(a, 5) AS value, round(sa, 5) AS se, round(a / sa, 4) AS t FROM c UNION ALL SELECT 'm', round(b, 5), round(sb, 5), round(b / sb, 4) FROM c"""


@query("e15_hac_alpha", HAC)
def e15(spark, sf):
    daily = panel(spark, sf).filter("r is not null").groupBy("date").agg(F.avg("r").alias("r"), F.first("m").alias("m"))
    out = reports.hac_regression(daily, "r", ["m"], 3)
    return out.select("term", F.round("value", 5).alias("value"), F.round("se", 5).alias("se"), F.round("t", 4).alias("t"))


@query("e18_wilson", RANKED + """, h AS (SELECT sector, count(*) FILTER (WHERE target_excess > 0) AS k, count(*) AS n FROM sig WHERE target_excess IS NOT NULL GROUP BY sector), p AS (SELECT *, k / n::DOUBLE AS p, 1.96 AS z FROM h)
SELECT sector, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
def e18(spark, sf):
    rows = signals(spark, sf).filter("target_excess is not null").groupBy("sector").agg(F.count(F.when(F.col("target_excess") > 0, 1)).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("sector", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("e22_dispersion", " SELECT round(stddev_samp(mom6) / stddev_samp(target_excess), 6) AS ratio, count(*) AS n FROM sig WHERE target_excess IS NOT NULL")
def e22(spark, sf):
    return stats.dispersion(signals(spark, sf), "mom6", "target_excess").select(*r6("ratio"), "n")


@query("e23_metric_correlation", PRED + IC + ", y AS (SELECT year(date) AS y, avg(ic) AS a FROM ic WHERE model = 'momentum' GROUP BY 1), z AS (SELECT year(date) AS y, avg(ic) AS b FROM ic WHERE model = 'low_vol' GROUP BY 1) SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM y JOIN z USING (y)")
def e23(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date"))
    return reports.yearly_pivot(ic, ["momentum", "low_vol"]).dropna().agg(F.round(F.corr("momentum", "low_vol"), 6).alias("r"), F.count("*").alias("n"))


@query("b5_summary", SETTLED + """, o AS (SELECT *, coalesce(entry_date = lag(exit_date) OVER (ORDER BY period), row_number() OVER (ORDER BY period) = 1) AS nx FROM settled),
ends AS (SELECT period, arg_max(w, date) AS e FROM wealth GROUP BY period), base AS (SELECT period, coalesce(exp(sum(ln(e)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS b FROM ends),
c AS (SELECT period, date, w * b AS v, min(date) OVER (PARTITION BY period) AS f, min(period) OVER () AS p FROM wealth JOIN base USING (period)),
line AS (SELECT v / lag(v) OVER (ORDER BY date) - 1 AS r, v / max(v) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS f FROM c WHERE date <> f OR period = p),
l AS (SELECT min(f) AS mdd, stddev_samp(r) * sqrt(12) AS vol FROM line), s AS (SELECT count(*) AS n, count(return_settled) AS ns, count(*) FILTER (WHERE status = 'settled_path') AS np, avg(return_settled) AS m, bool_and(nx AND return_settled IS NOT NULL) AS known, exp(sum(ln(1 + return_settled))) - 1 AS cr, bool_and(nx AND status = 'settled_path') AS whole FROM o)
SELECT 'momentum' AS strategy, n AS n_periods, ns AS settled_periods, np AS path_periods, round(m, 6) AS mean_period_return_available, round(CASE WHEN known THEN cr END, 6) AS cumulative_return, round(CASE WHEN whole THEN mdd END, 6) AS mdd, round(CASE WHEN whole THEN vol END, 6) AS annualized_volatility,
 CASE WHEN whole THEN 'complete_path' ELSE 'incomplete' END AS status, CASE WHEN NOT whole THEN 'unresolved' WHEN mdd >= -0.15 THEN 'met_observed_path' ELSE 'not_met' END AS mdd_15_preference FROM s, l""")
def b5_summary(spark, sf):
    held, bars, cal = picks(spark, sf).withColumn("strategy", F.lit("momentum")), A.monthly_bars(spark, sf), A.market(spark, sf)
    keys = ["strategy", "period"]
    out = portfolio.summarise(portfolio.settle(held, bars, cal, keys, 10), portfolio.paths(held, bars, cal, keys), ["strategy"])
    return out.select("strategy", "n_periods", "settled_periods", "path_periods", *r6("mean_period_return_available", "cumulative_return", "mdd", "annualized_volatility"), "status", "mdd_15_preference")


@query("b4_loss50", MARKS + " SELECT period, date, round(w, 6) AS wealth FROM walk")
def b4(spark, sf):
    return portfolio.loss50_path(picks(spark, sf), A.monthly_bars(spark, sf), A.market(spark, sf), ["period"]).select("period", "date", *r6("wealth"))


CONTRIB = PICKS + """, s AS (SELECT period, ticker, sector, target_simple AS t, 1.0 / count(*) OVER (PARTITION BY period) AS w FROM held WHERE target_simple IS NOT NULL), n AS (SELECT period, sum(w * t) AS r FROM s GROUP BY period),
nav AS (SELECT period, coalesce(exp(sum(ln(1 + r)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS nav FROM n), ct AS (SELECT period, ticker, t, nav * w * t AS c FROM s JOIN nav USING (period))"""


def contributions(spark, sf):
    rows = picks(spark, sf).withColumn("model", F.lit("momentum")).filter("target is not null")
    return portfolio.contribution(rows, ["model"], "period")


@query("b9_ticker_shares", CONTRIB + ", g AS (SELECT ticker, sum(c) AS c, count(*) AS times FROM ct GROUP BY ticker) SELECT ticker, round(c, 6) AS contribution, times, round(c / sum(c) OVER (), 5) AS share FROM g")
def b9(spark, sf):
    return portfolio.ticker_shares(contributions(spark, sf), ["model"]).select("ticker", *r6("contribution"), "times", F.round("share", 5).alias("share"))


@query("b7_period_concentration", CONTRIB + ", k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(c, 10) DESC, ticker) AS k FROM ct) SELECT period, round(sum(c), 6) AS total, round(sum(c) FILTER (WHERE k <= 3), 6) AS top, round(avg(t) FILTER (WHERE k > 3), 6) AS return_without_top FROM k GROUP BY period")
def b7(spark, sf):
    rows = contributions(spark, sf).withColumn("contribution", F.round("contribution", 10))
    return portfolio.period_concentration(rows, ["model"], 3, "period").select("period", *r6("total", "top", "return_without_top"))


@query("b11_daily_portfolio", SETTLED + ", d AS (SELECT period, date, w / lag(w) OVER (PARTITION BY period ORDER BY date) - 1 AS r FROM wealth), e AS (SELECT d.*, (SELECT max(exit_date) FROM held h WHERE h.period = d.period) AS x FROM d) SELECT period, date, round(r - CASE WHEN date = x THEN 0.002 ELSE 0 END, 6) AS r FROM e WHERE r IS NOT NULL")
def b11(spark, sf):
    held = picks(spark, sf)
    walk = portfolio.paths(held, A.monthly_bars(spark, sf), A.market(spark, sf), ["period"])
    return reports.daily_portfolio(walk, held, ["period"], 0.002).select("period", "date", *r6("r"))


@query("b12_regimes", SETTLED + """, d AS (SELECT date, w / lag(w) OVER (PARTITION BY period ORDER BY date) - 1 AS r FROM wealth), g AS (SELECT date, CASE WHEN m_close >= lag(m_close) OVER (ORDER BY date) THEN 'up' ELSE 'down' END AS regime FROM cal)
SELECT regime, count(*) AS n, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(stddev_samp(r) * sqrt(12), 6) AS volatility FROM d JOIN g USING (date) WHERE r IS NOT NULL GROUP BY regime""")
def b12(spark, sf):
    from pyspark.sql import Window

    held, cal = picks(spark, sf), A.market(spark, sf)
    daily = reports.daily_portfolio(portfolio.paths(held, A.monthly_bars(spark, sf), cal, ["period"]), held, ["period"], 0.0)
    regime = F.when(F.col("m_close") >= F.lag("m_close").over(Window.orderBy("date")), "up").otherwise("down")
    rows = daily.join(F.broadcast(cal.select("date", regime.alias("regime"))), "date")
    return reports.regime_performance(rows, [], YEAR).select("regime", "n", *r6("total_return", "volatility"))


BETA12 = "CASE WHEN count(r) OVER w = 12 THEN covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0) END"


@query("b13_portfolio_beta", PICKS + f""", bt AS (SELECT ticker, date, round({BETA12}, 8) AS beta FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
g AS (SELECT period, avg(beta) AS b, count(beta) / count(*)::DOUBLE AS cover, avg(target_simple) AS r, any_value(target_market) AS m FROM held LEFT JOIN bt USING (ticker, date) GROUP BY period)
SELECT period, round(cover, 6) AS coverage, round(CASE WHEN cover = 1 THEN b END, 6) AS beta, round(r - CASE WHEN cover = 1 THEN b END * m, 6) AS residual FROM g""")
def b13(spark, sf):
    betas = panel(spark, sf).select("ticker", "date", F.round(W.beta("r", "m", 12), 8).alias("beta"))
    return reports.beta_at_signal(picks(spark, sf).join(betas, ["ticker", "date"], "left"), ["period"]).select("period", *r6("coverage", "beta", "residual"))


@query("b18_eligibility_ab", RANKED.replace("FROM sig)", "FROM sig WHERE target_simple IS NOT NULL)") + """, e AS (SELECT date, target_simple AS t, CAST(CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 AS DOUBLE) AS bad FROM bk WHERE bucket = 5),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom6, ticker) AS q, count(*) OVER (PARTITION BY date) AS c FROM sig WHERE target_simple IS NOT NULL AND CAST(substr(ticker, 2) AS BIGINT) % 3 <> 0),
z AS (SELECT date, avg(target_simple) AS x FROM k WHERE greatest(1, coalesce(ceil((q - 1) * 5.0::DOUBLE / nullif(c - 1, 0)), 1)) = 5 GROUP BY date)
SELECT date, round(avg(t), 6) AS top_all, round(avg(bad), 6) AS ineligible_share, round(any_value(x), 6) AS top_eligible FROM e LEFT JOIN z USING (date) GROUP BY date""")
def b18(spark, sf):
    rows = signals(spark, sf).withColumn("eligible", F.substring("ticker", 2, 12).cast("long") % 3 != 0)
    return reports.eligibility_ab(rows, "mom6", "target_simple", "eligible").select("date", *r6("top_all", "ineligible_share", "top_eligible"))


@query("b19_recommendation", PRED + """, k AS (SELECT *, (rank() OVER (PARTITION BY model, date ORDER BY pred) + (count(*) OVER (PARTITION BY model, date, pred) - 1) / 2.0) / count(*) OVER (PARTITION BY model, date) AS pct FROM preds),
b AS (SELECT date, ticker, round(sum(0.5 * pct), 10) AS blend FROM k GROUP BY date, ticker HAVING count(*) = 2), l AS (SELECT b.*, coalesce(sector, 'UNKNOWN') AS sector FROM b LEFT JOIN sect USING (ticker) WHERE date = (SELECT max(date) FROM b)),
c AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY blend DESC, ticker) AS s FROM l), t AS (SELECT *, CAST(row_number() OVER (ORDER BY blend DESC, ticker) AS INTEGER) AS pick FROM c WHERE s <= 5)
SELECT date, ticker, pick, CASE WHEN count(*) OVER () = 10 THEN 'complete' ELSE 'short' END AS status, round(1.0 / count(*) OVER (), 6) AS weight FROM t WHERE pick <= 10""")
def b19(spark, sf):
    weights = spark.createDataFrame([("momentum", 0.5), ("low_vol", 0.5)], "model string, weight double")
    blend = xsec.rank_blend(predictions(spark, sf), weights).filter("models = 2").withColumn("blend", F.round("blend", 10))
    return reports.recommendation(joins.attach_sector(blend, A.sectors(spark, sf)), 10).select("date", "ticker", "pick", "status", *r6("weight"))


SCOPES = RANKED + """, pr AS (SELECT 'momentum' AS scope, date, ticker, sector, vol6 IS NOT NULL AND vol6 < 0.5 AS stable, mom6 AS pred, target_simple AS t FROM bk
  UNION ALL SELECT 'low_vol', date, ticker, sector, vol6 < 0.5, -round(vol6, 10), target_simple FROM bk WHERE vol6 IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY scope, date ORDER BY pred, ticker) AS k, count(*) OVER (PARTITION BY scope, date) AS m FROM pr),
g AS (SELECT f.*, z.n AS top_n, CASE WHEN stable THEN 0 ELSE 1 END AS pool FROM f, (VALUES (4), (10)) z(n) WHERE m >= 5 AND (stable OR coalesce(ceil((k - 1) * 5.0::DOUBLE / nullif(m - 1, 0)), 1) = 5)),
h AS (SELECT *, row_number() OVER (PARTITION BY scope, top_n, date, sector ORDER BY pool, pred DESC, ticker) AS s FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY scope, top_n, date ORDER BY pool, pred DESC, ticker) AS pick FROM h WHERE s <= top_n / 2),
c AS (SELECT scope, top_n, date, count(*) AS selected, count(*) FILTER (WHERE NOT stable) AS fallback_n, count(t) AS k, coalesce(sum(t), 0) AS s FROM i WHERE pick <= top_n GROUP BY ALL),
d AS (SELECT DISTINCT scope, date, z.n AS top_n FROM pr, (VALUES (4), (10)) z(n))"""


@query("b6_scopes", SCOPES + """ SELECT scope, date, top_n, coalesce(selected, 0) AS selected, coalesce(fallback_n, 0) AS fallback_n,
 CASE WHEN coalesce(selected, 0) <> top_n THEN 'insufficient_candidates' WHEN k < top_n THEN 'missing_return' ELSE 'settled' END AS status,
 round(CASE WHEN selected = top_n AND k = top_n THEN s / top_n END, 6) AS return_settled, round(CASE WHEN selected = top_n THEN (top_n - k) / top_n::DOUBLE END, 6) AS missing_weight,
 round(CASE WHEN selected = top_n THEN (s - 0.5 * (top_n - k)) / top_n END, 6) AS assumption_loss50 FROM d LEFT JOIN c USING (scope, date, top_n)""")
def b6(spark, sf):
    scores = F.array(F.struct(F.lit("momentum").alias("scope"), F.col("mom6").alias("pred")), F.struct(F.lit("low_vol").alias("scope"), (-F.round("vol6", 10)).alias("pred")))
    rows = signals(spark, sf).withColumn("stable", F.coalesce(F.col("vol6") < 0.5, F.lit(False))).select("date", "ticker", "sector", "stable", "target_simple", F.inline(scores)).filter("pred is not null")
    return reports.scope_comparison(rows, "target_simple", (4, 10)).select("scope", "date", "top_n", "selected", "fallback_n", "status", *r6("return_settled", "missing_weight", "assumption_loss50"))


@query("b16_cash", PRED + IC + """, sc AS (SELECT date, session_no, CAST((session_no - 13) / 6 AS INTEGER) AS period FROM cal WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal)),
w AS (SELECT date, sum(greatest(round(ic, 10), 0)) AS w FROM ic GROUP BY date)
SELECT period, c.date, CAST(1 AS DOUBLE) AS wealth, 'cash' AS status FROM sc LEFT JOIN w USING (date) JOIN cal c ON c.session_no BETWEEN sc.session_no + 1 AND sc.session_no + 7 WHERE coalesce(w, 0) = 0""")
def b16(spark, sf):
    cal = A.market(spark, sf)
    weights = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date")).select("date", F.greatest(F.round("ic", 10), F.lit(0.0)).alias("weight"))
    periods = labels.schedule(cal, 13, HORIZON, HORIZON, LAG).select("period", "date", (F.col("session_no") + LAG).alias("entry_no"), (F.col("session_no") + LAG + HORIZON).alias("exit_no"))
    return reports.cash_paths(periods, weights, cal)


@query("b17_risk_free", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 round(pow(1 + greatest(round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) / 100000 - 1.5, 0) / 100, 1.0 / 12) - 1, 9) AS rf FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1""")
def b17(spark, sf):
    rows = A.macro(spark, sf).filter("x1 is not null")
    return rows.select("date", F.round(reports.risk_free(F.col("x1") / 100000 - 1.5, YEAR), 9).alias("rf"))


@query("t7_select", RANKED + """, sc AS (SELECT date, CAST((session_no - 13) / 6 AS INTEGER) AS period FROM cal WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal)),
p AS (SELECT sector, period, avg(target_simple) AS r, count(target_simple) = count(*) AS whole FROM sig JOIN sc USING (date) GROUP BY ALL),
v AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY sector ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM p),
u AS (SELECT *, c / greatest(1, max(c) OVER (PARTITION BY sector ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS f FROM v),
s AS (SELECT sector AS strategy, count(*) AS n_periods, CASE WHEN bool_and(whole) THEN 'complete_path' ELSE 'incomplete' END AS status, round(arg_max(c, period) - 1, 8) AS cumulative_return, round(min(f), 8) AS mdd FROM u GROUP BY sector),
q AS (SELECT sector, date, rank() OVER (PARTITION BY sector, date ORDER BY mom6) + (count(*) OVER (PARTITION BY sector, date, mom6) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY sector, date ORDER BY target_excess) + (count(*) OVER (PARTITION BY sector, date, target_excess) - 1) / 2.0 AS b, mom6, target_excess FROM sig WHERE target_excess IS NOT NULL),
i AS (SELECT sector AS strategy, round(avg(ic), 8) AS mean_ic FROM (SELECT sector, date, corr(a, b) AS ic FROM q GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT mom6) > 1 AND count(DISTINCT target_excess) > 1) GROUP BY sector),
e AS (SELECT s.*, mean_ic, coalesce(n_periods = (SELECT count(*) FROM sc) AND status = 'complete_path', false) AS eligible FROM s LEFT JOIN i USING (strategy)), m AS (SELECT *, eligible AND mdd >= -0.4 AS met FROM e)
SELECT strategy, n_periods, status, cumulative_return, mdd, mean_ic, eligible, met AS risk_preference_met, met AND row_number() OVER (ORDER BY met DESC, cumulative_return DESC, mdd DESC, mean_ic DESC NULLS LAST, strategy) = 1 AS selected,
 CASE WHEN bool_or(met) OVER () THEN 'exploratory_selected' ELSE 'deferred_no_complete_risk_qualified_candidate' END AS selection_status FROM m""")
def t7(spark, sf):
    from pyspark.sql import Window

    rows, dates = signals(spark, sf), labels.schedule(A.market(spark, sf), 13, HORIZON, HORIZON, LAG).select("date", "period")
    w = Window.partitionBy("sector").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.join(F.broadcast(dates), "date").groupBy("sector", "period").agg(F.avg("target_simple").alias("r"), (F.count("target_simple") == F.count("*")).alias("whole"))
    line = line.withColumn("c", F.exp(F.sum(F.log1p("r")).over(w))).withColumn("f", F.col("c") / F.greatest(F.lit(1.0), F.max("c").over(w)) - 1)
    status = F.when(F.bool_and("whole"), "complete_path").otherwise("incomplete")
    summary = line.groupBy(F.col("sector").alias("strategy")).agg(F.count("*").alias("n_periods"), status.alias("status"), F.round(F.max_by("c", "period") - 1, 8).alias("cumulative_return"), F.round(F.min("f"), 8).alias("mdd"))
    ic = stats.daily_ic(rows, "mom6", "target_excess", ("sector", "date")).groupBy(F.col("sector").alias("strategy")).agg(F.round(F.avg("ic"), 8).alias("mean_ic"))
    return reports.select_candidate(summary, ic, dates.count(), -0.4).select("strategy", "n_periods", "status", "cumulative_return", "mdd", "mean_ic", "eligible", "risk_preference_met", "selected", "selection_status")
