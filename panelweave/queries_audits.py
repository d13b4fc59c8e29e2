"""Registered queries of the audits and the sector refit, each deterministic one with its SQL twin."""

from pyspark.sql import functions as F

from panelweave.functions import frames as W
from panelweave.operators import audits, labels
from panelweave.operators.clusters import cut
from panelweave.queries import FEATURES, HORIZON, RANKS, RISK, YEAR, A, model_rows, panel, query, r6, risk_rows, signals
from panelweave.queries_reports import CLUSTER, states

RANKED = RANKS.replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ")


@query("q2_contract", """, x AS (SELECT date, ticker, open, high, low, CASE WHEN volume % 13 = 0 THEN 0 WHEN volume % 19 <> 0 THEN close END AS close, CASE WHEN volume % 17 <> 0 THEN volume END AS volume, volume AS v FROM bars),
b AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE v % 11 = 0),
u AS (SELECT ticker FROM sect WHERE ticker NOT LIKE '%7'), f AS (SELECT DISTINCT ticker FROM sect WHERE ticker LIKE '%1' OR ticker = 'S7' UNION SELECT 'S0'), c AS (SELECT ticker, count(*) + (ticker LIKE '%3')::INT AS n_rows, count(*) < 60 AS short FROM b WHERE ticker NOT LIKE '%9' GROUP BY ticker),
t AS (SELECT ticker, count(*) AS n FROM b GROUP BY ticker), faults AS (
  SELECT ticker, 'duplicate_key' AS rule, CAST(n - k AS BIGINT) AS n FROM (SELECT ticker, count(*) AS n, count(DISTINCT date) AS k FROM b GROUP BY ticker)
  UNION ALL SELECT ticker, 'close_not_positive', count(*) FILTER (WHERE close <= 0) FROM b GROUP BY ticker UNION ALL SELECT ticker, 'null_close', count(*) FILTER (WHERE close IS NULL) FROM b GROUP BY ticker
  UNION ALL SELECT ticker, 'null_volume', count(*) FILTER (WHERE volume IS NULL) FROM b GROUP BY ticker
  UNION ALL SELECT ticker, 'outside_universe', 1 FROM t WHERE ticker NOT IN (FROM u) UNION ALL SELECT ticker, 'failed_outside_universe', 1 FROM f WHERE ticker NOT IN (FROM u)
  UNION ALL SELECT ticker, 'failed_but_present', 1 FROM f WHERE ticker IN (SELECT ticker FROM t) UNION ALL SELECT ticker, 'unaccounted_ticker', 1 FROM u WHERE ticker NOT IN (SELECT ticker FROM t) AND ticker NOT IN (FROM f)
  UNION ALL SELECT ticker, 'coverage_set', 1 FROM t WHERE ticker NOT IN (SELECT ticker FROM c)
  UNION ALL SELECT t.ticker, 'coverage_rows', 1 FROM t LEFT JOIN c USING (ticker) WHERE t.n IS DISTINCT FROM c.n_rows UNION ALL SELECT ticker, 'failed_with_rows', 1 FROM f WHERE ticker = 'S0' UNION ALL SELECT ticker, 'short_history', 1 FROM c WHERE short),
g AS (SELECT rule, sum(n) AS n, string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE r <= 10) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ticker) AS r FROM faults WHERE n > 0) GROUP BY rule)
SELECT k.rule, CASE WHEN k.rule = 'short_history' THEN 'warning' ELSE 'error' END AS severity, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(sample, '') AS sample
FROM (SELECT unnest(['date_type', 'number_type', 'derived_column', 'null_date', 'null_ticker', 'null_open', 'null_high', 'null_low', 'null_close', 'null_volume', 'close_not_positive', 'duplicate_key', 'outside_universe', 'failed_outside_universe', 'failed_but_present', 'unaccounted_ticker', 'coverage_set', 'coverage_rows', 'failed_with_rows', 'short_history']) AS rule) k LEFT JOIN g USING (rule)""")
def q2b(spark, sf):
    v = F.col("volume")
    b = A.monthly_bars(spark, sf).withColumn("v", v).withColumn("close", F.when(v % 13 == 0, 0.0).when(v % 19 != 0, F.col("close"))).withColumn("volume", F.when(v % 17 != 0, v))
    b = b.unionByName(b.filter("v % 11 = 0")).drop("v")
    sectors = A.sectors(spark, sf).select("ticker")
    failed = sectors.filter("ticker like '%1' or ticker = 'S7'").select("ticker", F.lit(0).alias("n_rows_final")).unionByName(spark.createDataFrame([("S0", 4)], "ticker string, n_rows_final int"))
    coverage = b.filter("ticker not like '%9'").groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", (F.col("n") + F.col("ticker").like("%3").cast("int")).alias("n_rows"), (F.col("n") < 60).alias("short_history"))
    return audits.dataset_contract(b, sectors.filter("ticker not like '%7'"), failed, coverage)


@query("q5_ranges", """, z AS (SELECT *, CASE WHEN count(r) OVER w3 = 3 THEN stddev_samp(r) OVER w3 * sqrt(12) END AS vol3,
  CASE WHEN count(r) OVER w12 = 12 AND var_samp(m) OVER w12 > 0 THEN covar_samp(r, m) OVER w12 / var_samp(m) OVER w12 END AS b12, CASE WHEN count(r) OVER w24 = 24 AND var_samp(m) OVER w24 > 0 THEN covar_samp(r, m) OVER w24 / var_samp(m) OVER w24 END AS b24,
  CASE WHEN count(r) OVER w12 = 12 THEN stddev_samp(r) OVER w12 * sqrt(12) END AS vol12, CASE WHEN count(r) OVER w24 = 24 THEN stddev_samp(r) OVER w24 * sqrt(12) END AS vol24
  FROM rets WINDOW w3 AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w24 AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
c AS (SELECT session_no, 12 AS "window", round(vol12, 6) AS vol, round(b12, 6) AS beta FROM z UNION ALL SELECT session_no, 24, round(vol24, 6), round(b24, 6) FROM z)
SELECT k AS interval, "window", min(vol) AS vol_min, round(quantile_cont(vol, 0.5), 6) AS vol_median, max(vol) AS vol_max, min(beta) AS beta_min, round(quantile_cont(beta, 0.5), 6) AS beta_median, max(beta) AS beta_max
FROM c JOIN (VALUES (3), (6)) i(k) ON (session_no - 1) % k = 0 GROUP BY ALL""")
def q5b(spark, sf):
    names = {n: {"vol": f"vol{n}", "beta": f"beta{n}"} for n in (12, 24)}
    rows = panel(spark, sf).withColumns({c: x for n in names for c, x in ((f"vol{n}", W.volatility("r", n, YEAR)), (f"beta{n}", W.beta("r", "m", n)))})
    return audits.range_audit(rows, [3, 6], names).select("interval", "window", *r6("vol_min", "vol_median", "vol_max", "beta_min", "beta_median", "beta_max"))


LABELS = """, x AS (SELECT date, ticker, session_no, entry_date, exit_date, ln(1 + target_simple) AS log_return, ln(1 + target_market) AS log_market, target_simple FROM lab WHERE observed),
sid AS (SELECT x.*, CASE WHEN volume % 23 <> 0 THEN CASE WHEN ticker LIKE '%4' AND x.session_no >= 40 THEN 2 ELSE 1 END END AS security_id FROM x JOIN (SELECT ticker, date, volume FROM bars) USING (ticker, date)),
amb AS (SELECT a.*, coalesce(a.exit_date IS NOT NULL AND NOT coalesce(e.security_id = a.security_id AND o.security_id = a.security_id, false), false) OR coalesce(a.ticker = 'S5' AND a.exit_date >= DATE '1996-01-01', false) AS lost
  FROM sid a LEFT JOIN sid e ON e.ticker = a.ticker AND e.date = a.entry_date LEFT JOIN sid o ON o.ticker = a.ticker AND o.date = a.exit_date),
st0 AS (SELECT *, CASE WHEN lost THEN 'security_or_venue_unresolved' WHEN exit_date IS NULL THEN 'unmatured' WHEN target_simple IS NOT NULL THEN 'observed' ELSE 'missing_price' END AS s0, CASE WHEN NOT lost THEN target_simple END AS r0 FROM amb),
give AS (SELECT date, ticker, CASE WHEN ticker LIKE '%2' THEN 'contradicts_observed' WHEN ticker LIKE '%6' THEN 'known_before_exit' END AS reason, s0, r0, exit_date FROM st0 WHERE exit_date IS NOT NULL AND session_no % 10 = 0 AND (ticker LIKE '%2' AND r0 IS NOT NULL OR ticker LIKE '%6' OR ticker LIKE '%8' AND r0 IS NULL))"""


def _labels(spark, sf):
    rows = panel(spark, sf)
    rows = labels.horizon_labels(rows, A.market(spark, sf), HORIZON, 1).filter("observed").select("date", "ticker", "session_no", "volume", "entry_date", "exit_date", F.log1p("target_simple").alias("log_return"), F.log1p("target_market").alias("log_market"))
    rows = rows.withColumn("security_id", F.when(F.col("volume") % 23 != 0, F.when(F.col("ticker").like("%4") & (F.col("session_no") >= 40), 2).otherwise(1))).drop("volume")
    unclear = spark.createDataFrame([("S5", "1996-01-01")], "ticker string, since string").withColumn("since", F.to_date("since"))
    base = audits.settled_labels(rows, unclear)[0]
    late, good = F.col("ticker").like("%6"), F.col("ticker").like("%8") & F.col("simple_return").isNull()
    wrong = F.col("ticker").like("%2") & F.col("simple_return").isNotNull()
    s = base.filter("exit_date is not null and session_no % 10 = 0").filter(wrong | late | good)
    s = s.select("date", "ticker", "entry_date", "exit_date", F.when(wrong, F.col("simple_return") + 0.5).otherwise(-1.0).alias("simple_return"), F.date_add("exit_date", F.when(late, -1).otherwise(3)).alias("available_at"), F.lit(True).alias("verified"), F.lit("filing").alias("source"))
    return audits.settled_labels(rows, unclear, s)


@query("l2_settled_labels", LABELS + """ SELECT a.date, a.ticker, CASE WHEN g.date IS NOT NULL THEN 'verified_settlement' ELSE a.s0 END AS label_status, CASE WHEN g.date IS NOT NULL THEN 'filing' END AS settlement_source,
  CASE WHEN g.date IS NOT NULL THEN a.exit_date + 3 ELSE a.exit_date END AS label_available_at, round(CASE WHEN g.date IS NOT NULL THEN -1.0::DOUBLE ELSE a.r0 END, 6) AS simple_return,
  round(CASE WHEN g.date IS NULL THEN ln(1 + a.r0) END, 6) AS log_return, round(CASE WHEN g.date IS NOT NULL THEN -1.0::DOUBLE ELSE a.r0 END - (exp(log_market) - 1), 6) AS target_excess
FROM st0 a LEFT JOIN (SELECT * FROM give WHERE reason IS NULL) g ON g.date = a.date AND g.ticker = a.ticker""")
def l2(spark, sf):
    return _labels(spark, sf)[0].select("date", "ticker", "label_status", "settlement_source", "label_available_at", *r6("simple_return", "log_return", "target_excess"))


@query("l2_refused_settlements", LABELS + " SELECT date, ticker, reason FROM give WHERE reason IS NOT NULL")
def l2b(spark, sf):
    return _labels(spark, sf)[1]


@query("e6_incremental", """, c AS (SELECT date, ticker, sector, mom6, round(vol6, 10) AS v, target_excess AS t, count(*) OVER (PARTITION BY date) AS total FROM sig),
k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rv, count(*) OVER (PARTITION BY date) AS n FROM c WHERE v IS NOT NULL),
e AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY mom6) + (count(*) OVER (PARTITION BY date, mom6) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY t) + (count(*) OVER (PARTITION BY date, t) - 1) / 2.0 AS b FROM k WHERE n >= 8 AND t IS NOT NULL),
d AS (SELECT *, a - avg(a) OVER w AS ad, b - avg(b) OVER w AS bd, rv - avg(rv) OVER w AS vd FROM e WINDOW w AS (PARTITION BY date, sector)),
s AS (SELECT *, regr_slope(ad, vd) OVER w AS sa, regr_slope(bd, vd) OVER w AS sb FROM d WINDOW w AS (PARTITION BY date))
SELECT date, max(total) AS n_candidates, count(*) AS n_evaluated, round(corr(a, b), 6) AS raw_ic, round(corr(ad - sa * vd, bd - sb * vd), 6) AS incremental_ic, round(corr(a, b), 6) AS momentum_ic FROM s GROUP BY date HAVING count(*) >= greatest(8, 1 + count(DISTINCT sector) + 5)""")
def e6b(spark, sf):
    rows = signals(spark, sf).withColumn("v", F.round("vol6", 10))
    return audits.incremental_ic(rows, "mom6", "target_excess", ["v"], sector="sector", momentum="mom6", least=8).select("date", "n_candidates", "n_evaluated", *r6("raw_ic", "incremental_ic", "momentum_ic"))


SHOCKS = [("first", "1996-11-01", "1997-03-01", "1996-10-01", "1997-04-01"), ("second", "1998-02-01", "1998-04-01", "1998-01-01", "1998-05-01")]
SHOCK_SQL = ", shocks AS (SELECT name, a::DATE AS a, b::DATE AS b, c::DATE AS c, d::DATE AS d FROM (VALUES " + ", ".join(str(s) for s in SHOCKS) + ") v(name, a, b, c, d))"


def shocks(spark):
    rows = spark.createDataFrame(SHOCKS, "shock string, start string, end string, anchor_date string, comparison_date string")
    return rows.select("shock", *(F.to_date(c).alias(c) for c in ("start", "end", "anchor_date", "comparison_date")))


@query("g12_shock_retention", RANKED + CLUSTER + SHOCK_SQL + """, dt AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM st)),
sh AS (SELECT s.*, y.i - x.i AS gap FROM shocks s JOIN dt x ON x.date = c JOIN dt y ON y.date = d),
pr AS (SELECT gap, f.date AS f, t.date AS t FROM (SELECT DISTINCT gap FROM sh) JOIN dt f ON true JOIN dt t ON t.i = f.i + gap),
ra AS (SELECT gap, f, t, x.state, count(*) AS n, 100 * avg(CAST(x.state = y.state AS DOUBLE)) AS kept, 100 * avg(CAST(y.state = 'low' AS DOUBLE)) AS fell FROM pr JOIN st x ON x.date = f JOIN st y ON y.date = t AND y.ticker = x.ticker GROUP BY ALL),
no AS (SELECT gap, state, count(*) AS k, avg(kept) AS m, quantile_cont(kept, 0.5) AS q, stddev_samp(kept) AS s, avg(fell) AS fm, quantile_cont(fell, 0.5) AS fq FROM ra WHERE NOT EXISTS (SELECT 1 FROM shocks WHERE f <= b AND t >= a) GROUP BY ALL)
SELECT name AS shock, ra.state, n, sh.gap AS step_gap, k AS normal_pairs, round(kept, 4) AS retention_pct, round(fell, 4) AS to_worst_pct, round(m, 4) AS normal_retention_mean, round(q, 4) AS normal_retention_median, round(s, 4) AS normal_retention_std,
  round(fm, 4) AS normal_to_worst_mean, round(fq, 4) AS normal_to_worst_median, round(kept - m, 4) AS retention_delta_pp, round(fell - fm, 4) AS to_worst_delta_pp
FROM sh JOIN ra ON ra.gap = sh.gap AND f = c AND t = d LEFT JOIN no ON no.gap = sh.gap AND no.state = ra.state""")
def g12b(spark, sf):
    out = audits.shock_retention(states(spark, sf).select("ticker", "date", "state"), shocks(spark), "low")
    return out.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes))


@query("g13_shock_outcomes", RANKED + CLUSTER + SHOCK_SQL + """, sp AS (SELECT name, min(session_no) AS lo, max(session_no) AS hi FROM cal JOIN shocks ON date BETWEEN a AND b GROUP BY name),
ph AS (SELECT name, date, CASE WHEN session_no < lo THEN 'PRE' WHEN session_no <= hi THEN 'SHOCK' ELSE 'POST' END AS phase FROM cal JOIN sp ON session_no BETWEEN lo - (hi - lo + 1) AND hi + (hi - lo + 1)),
an AS (SELECT name, max(date) AS date FROM (SELECT DISTINCT date FROM st) d JOIN shocks ON date < a GROUP BY name), gr AS (SELECT name, date AS anchor_date, ticker, state FROM st JOIN an USING (date)),
pp AS (SELECT name, phase, ticker, list(close ORDER BY date) AS p FROM bars JOIN ph USING (date) GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT name, phase, ticker, list_stddev_samp(list_transform(range(2, len(p) + 1), lambda i: p[i] / p[i - 1] - 1)) * sqrt(12) AS v, list_min(list_transform(range(1, len(p) + 1), lambda i: p[i] / list_max(p[1:i]) - 1)) AS d FROM pp)
SELECT name AS shock, phase, anchor_date, state, round(avg(v), 6) AS mean_vol, round(quantile_cont(v, 0.5), 6) AS median_vol, round(avg(d), 6) AS mean_mdd, round(quantile_cont(d, 0.5), 6) AS median_mdd, count(*) AS n FROM e JOIN gr USING (name, ticker) GROUP BY ALL""")
def g13b(spark, sf):
    out = audits.shock_outcomes(A.monthly_bars(spark, sf), A.market(spark, sf), states(spark, sf), shocks(spark), YEAR)
    return out.select("shock", "phase", "anchor_date", "state", *r6("mean_vol", "median_vol", "mean_mdd", "median_mdd"), "n")


JUDGED = RISK + """, ju AS (SELECT ticker, date, session_no, sector, risky, vol6 < 0.9 AS base, coalesce(vol6 < 0.9 AND mom6 > 0, false) AS narrow, coalesce(vol6 >= 0.9, false) AS pred FROM risk JOIN sig USING (ticker, date))"""


def judged(spark, sf):
    base = signals(spark, sf).select("ticker", "date", "session_no", (F.col("vol6") < 0.9).alias("base"), (F.col("mom6") > 0).alias("_up"))
    rows = risk_rows(spark, sf).join(base, ["ticker", "date"])
    return rows.withColumn("narrow", F.col("base") & F.col("_up")).withColumn("pred", F.coalesce(~F.col("base"), F.lit(False)))


@query("g8_policy_effect", JUDGED + """ SELECT sector, count(*) AS n_rows, count(*) FILTER (WHERE base) AS base_candidates, count(*) FILTER (WHERE narrow) AS case_candidates, round(avg(CAST(risky AS DOUBLE)) FILTER (WHERE base), 6) AS base_false_stable,
  round(avg(CAST(risky AS DOUBLE)) FILTER (WHERE narrow), 6) AS case_false_stable FROM ju GROUP BY sector HAVING count(*) FILTER (WHERE base) >= 10""")
def g8b(spark, sf):
    return audits.sector_effect(judged(spark, sf), "base", "narrow", "future_risky").select("sector", "n_rows", "base_candidates", "case_candidates", *r6("base_false_stable", "case_false_stable"))


@query("g8_stable_share", JUDGED + " SELECT sector, count(*) AS observations, count(*) FILTER (WHERE base) AS stable_n, round(count(*) FILTER (WHERE base) / count(*), 6) AS stable_share FROM ju WHERE upper(sector) <> 'UNKNOWN' GROUP BY sector")
def g8c(spark, sf):
    return audits.stable_share(judged(spark, sf), "base").select("sector", "observations", "stable_n", *r6("stable_share"))


@query("g19_interval_recall", JUDGED + """, h AS (SELECT k AS interval, sector, count(*) AS n_rows, count(*) FILTER (WHERE risky) AS y, count(*) FILTER (WHERE risky AND pred) AS tp FROM ju JOIN (VALUES (1), (3)) v(k) ON (session_no - 1) % k = 0 WHERE upper(sector) <> 'UNKNOWN' GROUP BY ALL),
p AS (SELECT *, tp / nullif(y, 0)::DOUBLE AS p, 1.96::DOUBLE AS z FROM h)
SELECT interval, sector, n_rows, y AS actual_risky_n, tp AS found_n, round(p, 6) AS recall, round(((p + z * z / (2 * y)) - z * sqrt(p * (1 - p) / y + z * z / (4 * y * y))) / (1 + z * z / y), 6) AS low,
  round(((p + z * z / (2 * y)) + z * sqrt(p * (1 - p) / y + z * z / (4 * y * y))) / (1 + z * z / y), 6) AS high, CASE WHEN y >= 43 THEN 'CONFIRMATORY' ELSE 'EXPLORATORY' END AS status FROM p""")
def g19b(spark, sf):
    out = audits.interval_recall(judged(spark, sf).drop("session_no"), A.market(spark, sf), [1, 3], "future_risky", "pred")
    return out.select("interval", "sector", "n_rows", "actual_risky_n", "found_n", *r6("recall", "low", "high"), "status")


@query("l4_outcomes_from_signal", """, y AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS p FROM bars)
SELECT ticker, date, CASE WHEN len(p) = 7 THEN round(list_stddev_samp(list_transform(range(1, 7), lambda i: p[i + 1] / p[i] - 1)) * sqrt(12), 6) END AS future_vol,
       CASE WHEN len(p) = 7 THEN round(list_min(list_transform(range(1, 8), lambda i: p[i] / list_max(p[1:i]) - 1)), 6) END AS future_mdd FROM y""")
def l4(spark, sf):
    return labels.forward_outcomes(A.monthly_bars(spark, sf), HORIZON, YEAR, start=0).select("ticker", "date", *r6("future_vol", "future_mdd"))


@query("m12_sector_refit")
def m12b(spark, sf):
    from pyspark.ml.classification import LogisticRegression

    from panelweave.plans import models

    cal, bars = cut(A.market(spark, sf)), cut(A.monthly_bars(spark, sf).select("ticker", "date", "close"))
    rows = labels.future_risk(labels.forward_outcomes(model_rows(spark, sf, bars, cal), HORIZON, YEAR).dropna(subset=["future_vol", "future_mdd"]), 0.3)
    rows = cut(rows.select("date", "sector", "future_risky", *FEATURES))  # training and test rows come from one pass
    # labels of the training rows end before the test begins
    last, day = (r["date"] for r in cal.filter(F.col("session_no").isin(60 - HORIZON - 1, 60)).orderBy("session_no").collect())
    out = models.sector_refit(rows.filter(F.col("date") < F.lit(last)), rows.filter(F.col("date") >= F.lit(day)), FEATURES, "future_risky", lambda: LogisticRegression(maxIter=2000, regParam=0.01))
    return out.select("sector", "actual_risky_n", "status", *r6("global_recall", "sector_refit_recall", "delta_recall", "global_pr_auc", "sector_pr_auc"), "discordant_pairs", *r6("paired_exact_p"))
