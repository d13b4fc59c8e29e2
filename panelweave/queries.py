"""Registered queries of the panel operators, each with its SQL twin over the same tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions import frames as W
from panelweave.operators import clean, clusters, joins, labels, portfolio, stats, xsec
from panelweave.sources import adapters as A
from panelweave.sources import bars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Sessions a year, trailing windows, forward horizon and lag on monthly bars.
YEAR, WINDOWS, HORIZON, LAG = 12, (3, 6, 12, 24), 6, 1

PRELUDE = """
WITH lines AS (
  SELECT *, l_extendedprice / l_quantity AS price, CAST(l_extendedprice AS DECIMAL(18,2)) AS money,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'S' || l_suppkey AS ticker FROM lineitem
), bars AS (
  SELECT ticker, date, round(first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price), 6) AS open,
         round(max(price), 6) AS high, round(min(price), 6) AS low,
         round(CAST(sum(money) AS DOUBLE) / sum(l_quantity), 6) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lines GROUP BY ticker, date
), cal AS (
  SELECT date, m_close, row_number() OVER (ORDER BY date) AS session_no
  FROM (SELECT date, round(CAST(sum(money) AS DOUBLE) / sum(l_quantity), 6) AS m_close FROM lines GROUP BY date)
), sect AS (
  SELECT 'S' || s_suppkey AS ticker, r_name AS sector, r_regionkey AS sector_key
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), member AS (
  SELECT 'S' || s_suppkey AS ticker, a.date AS start_date, b.date AS end_date
  FROM supplier JOIN (VALUES (0, 1, NULL), (1, 10, 40), (1, 50, NULL), (2, 1, 60), (3, 20, NULL)) v(r, f, l) ON s_suppkey % 5 = r
  JOIN cal a ON a.session_no = f LEFT JOIN cal b ON b.session_no = l
), panel AS (
  SELECT t.ticker, c.date, c.session_no, c.m_close, b.open, b.high, b.low, b.close, b.volume, b.close IS NOT NULL AS observed
  FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN cal c LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date
), rets AS (
  SELECT *, ln(close / lag(close) OVER w) AS r, coalesce(ln(m_close / lag(m_close) OVER w), 0) AS m, close - lag(close) OVER w AS diff
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_no)
), feat AS (
  SELECT *, CASE WHEN count(r) OVER w6 = 6 THEN stddev_samp(r) OVER w6 * sqrt(12) END AS vol6,
         round(close / lag(close, 6) OVER w - 1, 10) AS mom6
  FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY session_no), w6 AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
), lab AS (
  SELECT f.*, e.date AS entry_date, x.date AS exit_date,
         lead(f.close, 7) OVER w / lead(f.close, 1) OVER w - 1 AS target_simple, x.m_close / e.m_close - 1 AS target_market,
         round(lead(f.close, 7) OVER w / lead(f.close, 1) OVER w - 1 - (x.m_close / e.m_close - 1), 10) AS target_excess,
         CASE WHEN x.date IS NULL THEN 'immature' WHEN lead(f.close, 1) OVER w IS NULL THEN 'no_entry'
              WHEN lead(f.close, 7) OVER w IS NULL THEN 'no_exit' ELSE 'observed' END AS label_status
  FROM feat f LEFT JOIN cal e ON e.session_no = f.session_no + 1 LEFT JOIN cal x ON x.session_no = f.session_no + 7
  WINDOW w AS (PARTITION BY f.ticker ORDER BY f.session_no)
), sig AS (
  SELECT lab.*, coalesce(sector, 'UNKNOWN') AS sector FROM lab LEFT JOIN sect USING (ticker) WHERE observed AND mom6 IS NOT NULL
)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = PRELUDE + sql if "lineitem" not in sql and not sql.lstrip().upper().startswith("WITH") else sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def panel(spark: SparkSession, sf: str, bars: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """The densified monthly panel with log returns of names and market; of bars and a calendar that the caller holds, where given."""
    rows = joins.densify(A.monthly_bars(spark, sf) if bars is None else bars, A.market(spark, sf) if calendar is None else calendar)
    m = F.coalesce(F.log(F.col("m_close") / F.lag("m_close").over(W.by_ticker())), F.lit(0.0))
    return rows.withColumn("r", W.log_return()).withColumn("m", m).withColumn("diff", F.col("close") - F.lag("close").over(W.by_ticker()))


def featured(spark: SparkSession, sf: str, bars: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    return panel(spark, sf, bars, calendar).withColumn("vol6", W.volatility("r", 6, YEAR)).withColumn("mom6", F.round(W.momentum("close", 6), 10))


def labelled(spark: SparkSession, sf: str, bars: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    rows = featured(spark, sf, bars, calendar)
    rows = labels.horizon_labels(rows, A.market(spark, sf) if calendar is None else calendar, HORIZON, LAG)
    return rows.withColumn("target_excess", F.round("target_excess", 10))


def signals(spark: SparkSession, sf: str, bars: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Observed rows with a momentum score, forward labels and sector."""
    return joins.attach_sector(labelled(spark, sf, bars, calendar).filter("observed and mom6 is not null"), A.sectors(spark, sf))


@query("s1_scan", " SELECT ticker, date, close FROM bars")
def s1(spark, sf):
    return A.monthly_bars(spark, sf).select("ticker", "date", "close")


@query("p6_best_source", """, byflag AS (
  SELECT ticker, date, l_returnflag AS source, round(CAST(sum(money) AS DOUBLE) / sum(l_quantity), 6) AS close FROM lines GROUP BY ALL
) SELECT ticker, date, source, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY CASE source WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, source) k FROM byflag) WHERE k = 1""")
def p6(spark, sf):
    return clean.best_source(A.monthly_bars(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "source")).select("ticker", "date", "source", "close")


@query("p5_clean_bars", """, byflag AS (
  SELECT ticker, date, l_returnflag AS source, round(first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low,
         round(CAST(sum(money) AS DOUBLE) / sum(l_quantity), 6) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lines GROUP BY ticker, date, l_returnflag
), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY CASE source WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, source) k FROM byflag WHERE date >= DATE '1993-01-01' AND date < DATE '1997-01-01') WHERE k = 1)
SELECT ticker, date, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, volume, false AS price_imputed, false AS volume_missing,
       (high < greatest(open, high, low, close)) OR (low > least(open, high, low, close)) AS ohlc_inconsistent FROM one""")
def p5(spark, sf):
    raw = A.monthly_bars(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "source")
    return clean.clean_bars(raw, "1993-01-01", "1997-01-01").select("ticker", "date", "open", "high", "low", "close", "volume", "price_imputed", "volume_missing", "ohlc_inconsistent")


@query("s7_ingest", """, byflag AS (SELECT ticker, date, l_returnflag AS source FROM lines GROUP BY ALL),
per AS (SELECT ticker, source, count(*) AS n FROM byflag WHERE source IN ('R', 'A') GROUP BY ALL),
best AS (SELECT ticker, coalesce(max(n) FILTER (WHERE source = 'R' AND n >= 36), max(n) FILTER (WHERE source = 'A' AND n >= 36)) AS n FROM per GROUP BY ticker)
SELECT s.ticker, coalesce(b.n, 0) AS n_rows, b.n IS NOT NULL AS collected,
       CASE WHEN b.n IS NOT NULL THEN NULL WHEN b.ticker IS NULL THEN 'no_rows' ELSE 'too_few_rows' END AS reason
FROM sect s LEFT JOIN best b USING (ticker)""")
def s7(spark, sf):
    raw = A.monthly_bars(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "source")
    return S.ingest([raw.filter("source = 'R'"), raw.filter("source = 'A'")], A.sectors(spark, sf), 36)[1]


@query("q2_validate", """, x AS (SELECT count(*) FILTER (WHERE date IS NULL) a, count(*) FILTER (WHERE close <= 0) c, count(*) FILTER (WHERE high < low) h FROM bars)
SELECT 'null_date' AS rule, 'error' AS severity, a AS n FROM x UNION ALL SELECT 'null_ticker', 'error', 0 UNION ALL SELECT 'null_close', 'error', 0 UNION ALL SELECT 'null_volume', 'error', 0
UNION ALL SELECT 'close_not_positive', 'error', c FROM x UNION ALL SELECT 'negative_volume', 'error', 0 UNION ALL SELECT 'high_below_low', 'error', h FROM x
UNION ALL SELECT 'duplicate_key', 'error', 0
UNION ALL SELECT 'unaccounted_ticker', 'error', count(*) FROM sect WHERE ticker NOT IN (SELECT ticker FROM bars)
UNION ALL SELECT 'failed_but_present', 'warning', 0""")
def q2(spark, sf):
    b = A.monthly_bars(spark, sf)
    return clean.validate(b, A.sectors(spark, sf), b.filter("false").select("ticker"))


@query("q5_profile", """ SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date, 0::BIGINT AS n_duplicates, count(*) FILTER (WHERE close IS NULL) AS n_null_close, count(*) FILTER (WHERE close <= 0) AS n_not_positive, round(quantile_cont(close, 0.5), 6) AS median_close FROM bars""")
def q5(spark, sf):
    return clean.profile(A.monthly_bars(spark, sf))


@query("j1_members", """ SELECT b.ticker, b.date, EXISTS (SELECT 1 FROM member m WHERE m.ticker = b.ticker AND b.date >= m.start_date AND (m.end_date IS NULL OR b.date < m.end_date)) AS member FROM bars b""")
def j1(spark, sf):
    cal = A.market(spark, sf)
    return joins.members(A.monthly_bars(spark, sf), A.membership(spark, sf, cal)).select("ticker", "date", "member")


@query("p12_eligibility", """ SELECT b.ticker, b.date, CASE WHEN NOT EXISTS (SELECT 1 FROM member m WHERE m.ticker = b.ticker AND b.date >= m.start_date AND (m.end_date IS NULL OR b.date < m.end_date)) THEN 'not_member' WHEN b.volume <= 0 THEN 'no_trade' ELSE 'eligible' END AS status FROM bars b""")
def p12(spark, sf):
    rows = joins.members(A.monthly_bars(spark, sf), A.membership(spark, sf, A.market(spark, sf)))
    return clean.eligibility(rows.withColumn("identified", F.lit(True))).select("ticker", "date", "status")


@query("j2_overlap", """ SELECT DISTINCT ticker FROM member WHERE start_date < DATE '1995-06-01' AND (end_date IS NULL OR end_date > DATE '1995-01-01')""")
def j2(spark, sf):
    return joins.overlapping(A.membership(spark, sf, A.market(spark, sf)), "1995-01-01", "1995-06-01")


@query("j3_sector_asof", """, hist AS (
  SELECT ticker, (SELECT date FROM cal WHERE session_no = 1) AS date, sector FROM sect
  UNION ALL SELECT ticker, (SELECT date FROM cal WHERE session_no = 42), r_name FROM sect JOIN region ON r_regionkey = (sector_key + 1) % 5)
SELECT b.ticker, b.date, coalesce(h.sector, 'Unknown') AS sector FROM bars b ASOF LEFT JOIN hist h ON b.ticker = h.ticker AND b.date >= h.date""")
def j3(spark, sf):
    cal, sect = A.market(spark, sf), A.sectors(spark, sf)
    regions = A.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("s"))
    first, later = (F.broadcast(cal.filter(F.col("session_no") == k).select("date")) for k in (1, 42))
    old = sect.crossJoin(first).select("ticker", "date", "sector")
    new = sect.join(F.broadcast(regions), (F.col("sector_key") + 1) % 5 == F.col("k")).crossJoin(later).select("ticker", "date", F.col("s").alias("sector"))
    return joins.as_of(A.monthly_bars(spark, sf).select("ticker", "date"), old.unionByName(new), "sector", "Unknown")


@query("j4_densify", " SELECT ticker, date, session_no, observed, close FROM panel")
def j4(spark, sf):
    return joins.densify(A.monthly_bars(spark, sf), A.market(spark, sf)).select("ticker", "date", "session_no", "observed", "close")


@query("j12_missing", " SELECT ticker, date FROM panel WHERE NOT observed")
def j12(spark, sf):
    b = A.monthly_bars(spark, sf)
    grid = b.select("ticker").distinct().crossJoin(F.broadcast(A.market(spark, sf).select("date")))
    return joins.missing(grid, b, ["ticker", "date"])


def _window(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY session_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _feature_sql() -> str:
    out = []
    for n in WINDOWS:
        w = _window(n)
        ok = f"count(r) OVER {w} = {n}"
        out += [
            f"round(CASE WHEN {ok} THEN stddev_samp(r) OVER {w} * sqrt(12) END, 6) AS vol_{n}",
            f"round(CASE WHEN {ok} THEN covar_samp(r, m) OVER {w} / nullif(var_samp(m) OVER {w}, 0) END, 6) AS beta_{n}",
            f"round(CASE WHEN {ok} THEN sqrt(avg(pow(least(r, 0), 2)) OVER {w} * 12) END, 6) AS down_{n}",
            f"round(CASE WHEN {ok} THEN avg(r) OVER {w} * 12 END, 6) AS mean_{n}",
            f"round(close / CASE WHEN count(close) OVER {w} = {n} THEN avg(close) OVER {w} END - 1, 6) AS gap_{n}",
            f"round(close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY session_no) - 1, 6) AS mom_{n}",
            f"round(CASE WHEN {ok} THEN sum(r) OVER {w} - sum(m) OVER {w} END, 6) AS rel_{n}",
        ]
    for n in (3, 6, 9):
        w = _window(n)
        for name, c in (("rsi", "diff"), ("rsir", "r")):
            up, down = f"avg(greatest({c}, 0)) OVER {w}", f"avg(greatest(-{c}, 0)) OVER {w}"
            out.append(f"round(CASE WHEN count({c}) OVER {w} = {n} THEN CASE WHEN {up} = 0 AND {down} = 0 THEN 50 WHEN {down} = 0 THEN 100 ELSE 100 - 100 / (1 + {up} / {down}) END END, 6) AS {name}_{n}")
    prior = "(PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
    out.append(f"round(nullif(volume, 0) / CASE WHEN count(nullif(volume, 0)) OVER {prior} = 6 THEN avg(nullif(volume, 0)) OVER {prior} END - 1, 6) AS rel_volume")
    out.append(f"round(CASE WHEN count(nullif(volume, 0)) OVER {_window(3)} = 3 THEN avg(nullif(volume, 0)) OVER {_window(3)} END / CASE WHEN count(nullif(volume, 0)) OVER {_window(12)} = 12 THEN avg(nullif(volume, 0)) OVER {_window(12)} END - 1, 6) AS volume_trend")
    # nulls stay nulls: least and greatest skip them in this engine
    return " , f AS (SELECT *, " + ", ".join(x.replace("least(r, 0)", "CASE WHEN r IS NOT NULL THEN least(r, 0) END").replace("greatest(r, 0)", "CASE WHEN r IS NOT NULL THEN greatest(r, 0) END").replace("greatest(-r, 0)", "CASE WHEN r IS NOT NULL THEN greatest(-r, 0) END").replace("greatest(diff, 0)", "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END").replace("greatest(-diff, 0)", "CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END") for x in out) + " FROM rets) SELECT ticker, date, " + ", ".join(x.rpartition(" AS ")[2] for x in out) + " FROM f WHERE observed"


def feature_columns() -> dict[str, F.Column]:
    out = {}
    for n in WINDOWS:
        out |= {f"vol_{n}": W.volatility("r", n, YEAR), f"beta_{n}": W.beta("r", "m", n), f"down_{n}": W.downside("r", n, YEAR), f"mean_{n}": W.annual_mean("r", n, YEAR), f"gap_{n}": W.ma_gap("close", n), f"mom_{n}": W.momentum("close", n), f"rel_{n}": W.relative_momentum("r", "m", n)}
    for n in (3, 6, 9):
        out |= {f"rsi_{n}": W.rsi("diff", n), f"rsir_{n}": W.rsi("r", n)}
    return out | {"rel_volume": W.relative_volume("volume", 6), "volume_trend": W.volume_trend("volume", 3, 12)}


@query("w27_features", _feature_sql())
def w27(spark, sf):
    cols = feature_columns()
    return panel(spark, sf).withColumns(cols).filter("observed").select("ticker", "date", *r6(*cols))


@query("w9_drawdown", """, y AS (SELECT ticker, date, observed, close, CASE WHEN count(close) OVER w = 6 THEN list(close) OVER w END AS p FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT ticker, date, round(list_min(list_transform(range(1, 7), lambda i: p[i] / list_max(p[1:i]) - 1)), 6) AS mdd_6 FROM y WHERE observed""")
def w9(spark, sf):
    return panel(spark, sf).withColumn("mdd_6", W.rolling_drawdown("close", 6)).filter("observed").select("ticker", "date", *r6("mdd_6"))


@query("w28_market_proxy", " SELECT date, round(avg(r), 6) AS proxy, count(r) AS n FROM rets GROUP BY date")
def w28(spark, sf):
    return panel(spark, sf).groupBy("date").agg(F.round(F.avg("r"), 6).alias("proxy"), F.count("r").alias("n"))


@query("l1_labels", " SELECT ticker, date, entry_date, exit_date, round(target_simple, 6) AS target_simple, round(target_market, 6) AS target_market, round(target_excess, 6) AS target_excess, label_status FROM lab WHERE observed")
def l1(spark, sf):
    return labelled(spark, sf).filter("observed").select("ticker", "date", "entry_date", "exit_date", *r6("target_simple", "target_market", "target_excess"), "label_status")


@query("l3_outcomes", """, y AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS p FROM bars)
SELECT ticker, date, CASE WHEN len(p) = 7 THEN round(list_stddev_samp(list_transform(range(1, 7), lambda i: p[i + 1] / p[i] - 1)) * sqrt(12), 6) END AS future_vol,
       CASE WHEN len(p) = 7 THEN round(list_min(list_transform(range(1, 8), lambda i: p[i] / list_max(p[1:i]) - 1)), 6) END AS future_mdd FROM y""")
def l3(spark, sf):
    return labels.forward_outcomes(A.monthly_bars(spark, sf), HORIZON, YEAR).select("ticker", "date", *r6("future_vol", "future_mdd"))


@query("l5_future_risk", """, y AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS p FROM bars),
o AS (SELECT ticker, date, round(list_stddev_samp(list_transform(range(1, 7), lambda i: p[i + 1] / p[i] - 1)) * sqrt(12), 8) AS v, round(list_min(list_transform(range(1, 8), lambda i: p[i] / list_max(p[1:i]) - 1)), 8) AS d FROM y WHERE len(p) = 7),
s AS (SELECT *, round((coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) - coalesce((d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 0)) / 2, 10) AS z FROM o WINDOW w AS (PARTITION BY date))
SELECT ticker, date, round(z, 6) AS risk_score, z >= round(quantile_cont(z, 0.7) OVER (PARTITION BY date), 10) AS future_risky FROM s""")
def l5(spark, sf):
    rows = labels.forward_outcomes(A.monthly_bars(spark, sf), HORIZON, YEAR).dropna(subset=["future_vol", "future_mdd"])
    rows = rows.withColumn("future_vol", F.round("future_vol", 8)).withColumn("future_mdd", F.round("future_mdd", 8))
    return labels.future_risk(rows, 0.3).select("ticker", "date", *r6("risk_score"), "future_risky")


@query("l9_row_shift", " SELECT ticker, date, round(lead(close, 6) OVER w / close - 1, 6) AS target_ret, lead(date, 6) OVER w AS target_end FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def l9(spark, sf):
    return labels.row_shift_target(A.monthly_bars(spark, sf), HORIZON).select("ticker", "date", *r6("target_ret"), "target_end")


@query("l10_label_coverage", " SELECT CAST(year(date) AS INTEGER) AS year, label_status, count(*) AS n FROM lab WHERE observed GROUP BY ALL")
def l10(spark, sf):
    return labels.label_coverage(labelled(spark, sf).filter("observed"))


@query("l11_purged", """, folds AS (SELECT row_number() OVER (ORDER BY session_no) AS fold, date AS day FROM cal WHERE session_no IN (40, 52, 64))
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_train, max(exit_date) AS last_exit, count(DISTINCT date) AS n_dates FROM sig s JOIN folds f ON s.date < f.day AND s.exit_date < f.day GROUP BY fold""")
def l11(spark, sf):
    days = A.market(spark, sf).filter(F.col("session_no").isin(40, 52, 64))
    folds = days.select(F.row_number().over(Window.orderBy("session_no")).alias("fold"), F.col("date").alias("day"))
    rows = labels.purged(signals(spark, sf).withColumn("eligible", F.lit(True)), folds)
    return labels.train_audit(rows).select("fold", "n_train", "last_exit", "n_dates")


@query("l15_schedule", " SELECT date, session_no, CAST((session_no - 13) / 6 AS INTEGER) AS period FROM cal WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal)")
def l15(spark, sf):
    return labels.schedule(A.market(spark, sf), 13, HORIZON, HORIZON, LAG).select("date", F.col("session_no").cast("long").alias("session_no"), "period")


RANKS = """, rk AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY mom6) + (count(*) OVER (PARTITION BY date, mom6) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct,
  row_number() OVER (PARTITION BY date ORDER BY mom6, ticker) AS rn, count(*) OVER (PARTITION BY date) AS cn FROM sig),
bk AS (SELECT *, CAST(greatest(1, coalesce(ceil((rn - 1) * 5 / nullif(cn - 1, 0)), 1)) AS INTEGER) AS bucket FROM rk)"""


@query("c1_percentile", RANKS + " SELECT ticker, date, round(pct, 6) AS pct FROM rk")
def c1(spark, sf):
    return signals(spark, sf).withColumn("pct", xsec.percentile_rank("mom6", "date")).select("ticker", "date", *r6("pct"))


@query("c3_buckets", RANKS.replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ") + " SELECT ticker, date, bucket FROM bk")
def c3(spark, sf):
    return xsec.buckets(signals(spark, sf), "mom6", 5).select("ticker", "date", "bucket")


@query("c4_z_score", " SELECT ticker, date, round(coalesce((mom6 - avg(mom6) OVER w) / nullif(stddev_pop(mom6) OVER w, 0), 0), 6) AS z FROM sig WINDOW w AS (PARTITION BY date)")
def c4(spark, sf):
    return signals(spark, sf).withColumn("z", xsec.z_score("mom6", "date")).select("ticker", "date", *r6("z"))


CAPPED = """, a AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY mom6 DESC, ticker) AS s FROM sig),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY mom6 DESC, ticker) AS INTEGER) AS pick FROM a WHERE s <= 5) WHERE pick <= 10)"""


@query("t1_capped_top", CAPPED + " SELECT date, ticker, sector, pick FROM top")
def t1(spark, sf):
    return xsec.capped_top(signals(spark, sf), "mom6", 10).select("date", "ticker", "sector", "pick")


@query("t3_lowest_vol", " SELECT date, ticker, pick FROM (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY v, ticker) AS INTEGER) AS pick FROM (SELECT *, round(vol6, 10) AS v FROM sig WHERE vol6 IS NOT NULL)) WHERE pick <= 10")
def t3(spark, sf):
    return xsec.lowest(signals(spark, sf).withColumn("v", F.round("vol6", 10)), "v", 10).select("date", "ticker", "pick")


@query("t4_top_fraction", " SELECT date, ticker, pick FROM (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY mom6 DESC, ticker) AS INTEGER) AS pick, count(*) OVER (PARTITION BY date) AS n FROM sig) WHERE pick <= greatest(1, ceil(n * 0.1::DOUBLE))")
def t4(spark, sf):
    return xsec.top_fraction(signals(spark, sf), "mom6", 0.1).select("date", "ticker", "pick")


def risk_axes(spark, sf):
    """Observed rows with volatility vol_n and absolute beta beta_n of each window."""
    axes = {}
    for n in WINDOWS:
        axes |= {f"vol_{n}": F.round(W.volatility("r", n, YEAR), 10), f"beta_{n}": F.round(F.abs(W.beta("r", "m", n)), 10)}
    return panel(spark, sf).withColumns(axes).filter("observed").select("date", "ticker", *axes)


@query("c5_kmeans")
def c5(spark, sf):
    return clusters.grouped_kmeans(risk_axes(spark, sf), ["vol_12", "beta_12"]).select("date", "ticker", "risk_rank", "stable")


@query("c7_k_sensitivity")
def c7(spark, sf):
    return clusters.k_sensitivity(risk_axes(spark, sf), ["vol_12", "beta_12"]).select("date", "k", *r6("silhouette", "dbi", "ch", "min_share"))


@query("c7_k_ranks")
def c7_ranks(spark, sf):
    return clusters.k_ranks(clusters.k_sensitivity(risk_axes(spark, sf), ["vol_12", "beta_12"])).select("k", "n_groups", *r6("silhouette", "dbi", "ch", "min_share"), "mean_place")


@query("c8_sector_policy")
def c8(spark, sf):
    rows = joins.attach_sector(clusters.grouped_kmeans(risk_axes(spark, sf), ["vol_12", "beta_12"]), A.sectors(spark, sf))
    return clusters.sector_policy(rows, ["vol_12", "beta_12"]).select("date", "ticker", "sector", "stable", "sector_status", "balanced_verified", "balanced_eligible")


@query("g6_lookback")
def g6(spark, sf):
    table = clusters.lookback_table(risk_axes(spark, sf), {n: [f"vol_{n}", f"beta_{n}"] for n in WINDOWS}, risk_rows(spark, sf))
    return table.select("lookback", "n_rows", "n_dates", "stable_n", *r6("false_stable_rate", "mean_future_mdd"))


PRED = """, preds AS (SELECT 'momentum' AS model, date, ticker, mom6 AS pred, target_excess FROM sig UNION ALL SELECT 'low_vol', date, ticker, -round(vol6, 10), target_excess FROM sig WHERE vol6 IS NOT NULL)"""


def scored(rows, *more):
    """Both models' scores, exploded from one pass over rows with their features."""
    scores = F.array(F.struct(F.lit("momentum").alias("model"), F.col("mom6").alias("pred")), F.struct(F.lit("low_vol").alias("model"), (-F.round("vol6", 10)).alias("pred")))
    return rows.select("date", "ticker", *more, F.inline(scores)).filter("pred is not null").select("model", "date", "ticker", "pred", *more)


def predictions(spark, sf, bars=None, calendar=None):
    return scored(signals(spark, sf, bars, calendar), "target_excess")


IC = """, k AS (SELECT *, rank() OVER (PARTITION BY model, date ORDER BY pred) + (count(*) OVER (PARTITION BY model, date, pred) - 1) / 2.0 AS p,
  rank() OVER (PARTITION BY model, date ORDER BY target_excess) + (count(*) OVER (PARTITION BY model, date, target_excess) - 1) / 2.0 AS t FROM preds WHERE target_excess IS NOT NULL),
ic AS (SELECT model, date, corr(p, t) AS ic, count(*) AS n FROM k GROUP BY model, date HAVING count(*) >= 5 AND count(DISTINCT pred) > 1 AND count(DISTINCT target_excess) > 1)"""


@query("e1_daily_ic", PRED + IC + " SELECT model, date, round(ic, 6) AS ic, n FROM ic")
def e1(spark, sf):
    return stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date")).select("model", "date", *r6("ic"), "n")


@query("e2_ic_summary", PRED + IC + " SELECT model, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(CAST(ic > 0 AS DOUBLE)), 6) AS hit_rate, count(*) AS n_days FROM ic GROUP BY model")
def e2(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date"))
    return stats.ic_summary(ic, "model").select("model", *r6("mean_ic", "ic_std", "ic_ir", "hit_rate"), "n_days")


@query("e3_spread", RANKS.replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ") + """ SELECT date, round(avg(target_excess) FILTER (WHERE bucket = 5), 6) AS top, round(avg(target_excess) FILTER (WHERE bucket = 1), 6) AS bottom, count(*) AS n,
 coalesce(bool_and(target_excess IS NOT NULL) FILTER (WHERE bucket IN (1, 5)), false) AS settled FROM bk GROUP BY date""")
def e3(spark, sf):
    return stats.quantile_spread(signals(spark, sf), "mom6", "target_excess").select("date", *r6("top", "bottom"), "n", "settled")


@query("e4_pooled_ic", """, k AS (SELECT rank() OVER (ORDER BY mom6) + (count(*) OVER (PARTITION BY mom6) - 1) / 2.0 AS p, rank() OVER (ORDER BY target_excess) + (count(*) OVER (PARTITION BY target_excess) - 1) / 2.0 AS t FROM sig WHERE target_excess IS NOT NULL)
SELECT round(corr(p, t), 6) AS pooled_ic, count(*) AS n FROM k""")
def e4(spark, sf):
    return stats.pooled_ic(signals(spark, sf), "mom6", "target_excess").select(*r6("pooled_ic"), "n")


@query("e5_ic_by_year", PRED + IC + " SELECT model, CAST(year(date) AS INTEGER) AS year, round(avg(ic), 6) AS mean_ic, count(*) AS n_days FROM ic GROUP BY ALL")
def e5(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date"))
    return ic.groupBy("model", F.year("date").alias("year")).agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.count("*").alias("n_days"))


@query("e6_partial_ic", """, k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom6) + (count(*) OVER (PARTITION BY date, mom6) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY target_excess) + (count(*) OVER (PARTITION BY date, target_excess) - 1) / 2.0 AS b,
  rank() OVER (PARTITION BY date ORDER BY round(vol6, 10)) + (count(*) OVER (PARTITION BY date, round(vol6, 10)) - 1) / 2.0 AS c FROM sig WHERE target_excess IS NOT NULL AND vol6 IS NOT NULL),
g AS (SELECT date, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM k GROUP BY date)
SELECT date, n, round(ab, 6) AS raw_ic, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS incremental_ic FROM g""")
def e6(spark, sf):
    return stats.partial_ic(signals(spark, sf).withColumn("v", F.round("vol6", 10)), "mom6", "target_excess", ["v"]).select("date", "n", *r6("raw_ic", "incremental_ic"))


@query("e9_hac", PRED + IC + """, s AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic WHERE model = 'momentum'), mu AS (SELECT avg(ic) AS m, count(*) AS n FROM s),
c AS (SELECT b.i - a.i AS lag, sum((a.ic - m) * (b.ic - m)) AS s FROM s a JOIN s b ON b.i - a.i BETWEEN 0 AND 5 CROSS JOIN mu GROUP BY 1)
SELECT round(m, 6) AS mean, n, round(sqrt((SELECT sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / 6.0) * s END) FROM c)) / n, 6) AS se, round(m / (sqrt((SELECT sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / 6.0) * s END) FROM c)) / n), 5) AS t FROM mu""")
def e9(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf).filter("model = 'momentum'"), "pred", "target_excess")
    return stats.hac_mean(ic, "ic", 5).select(*r6("mean"), "n", *r6("se"), F.round("t", 5).alias("t"))


@query("e10_bootstrap", PRED + IC + """, x AS (SELECT ic, date, row_number() OVER (ORDER BY date) - 1 AS i FROM ic WHERE model = 'momentum'),
size AS (SELECT count(*) AS n, avg(ic) AS e, (SELECT count(*) FROM cal WHERE date BETWEEN (SELECT min(date) FROM x) AND (SELECT max(date) FROM x)) AS span FROM x),
st AS (SELECT *, CASE WHEN span > n THEN 'calendar_gaps_in_metric' WHEN floor(span / 6.0) < 10 THEN 'insufficient_blocks' ELSE 'conditional_inference' END AS status FROM size),
d AS (SELECT rep, b, k, ('0x' || substr(md5('42|' || rep || '|' || b), 1, 8))::BIGINT % (n - 5) + k AS i FROM st, range(1000) r(rep), range(0, CAST(ceil(n / 6.0) AS BIGINT)) q(b), range(6) z(k) WHERE b * 6 + k < n AND status = 'conditional_inference'),
m AS (SELECT rep, round(avg(ic) - (SELECT e FROM st), 12) AS c FROM d JOIN x USING (i) GROUP BY rep),
a AS (SELECT quantile_cont(c, 0.975) AS high, quantile_cont(c, 0.025) AS low, (count(*) FILTER (WHERE abs(c) >= (SELECT abs(e) FROM st)) + 1) / (count(*) + 1.0) AS p, count(*) AS reps FROM m)
SELECT round(e, 6) AS estimate, round(e - high, 6) AS ci_low, round(e - low, 6) AS ci_high, round(CASE WHEN reps > 0 THEN p END, 6) AS p, n, CAST(floor(span / 6.0) AS BIGINT) AS full_blocks, status FROM st, a""")
def e10(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf).filter("model = 'momentum'"), "pred", "target_excess")
    return stats.block_bootstrap(ic, "ic", 6, A.market(spark, sf).select("date"), n_boot=1000).select(*r6("estimate", "ci_low", "ci_high", "p"), "n", "full_blocks", "status")


@query("e12_permutation", """, f AS (SELECT date, ticker, mom6, target_excess AS t FROM sig WHERE target_excess IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom6, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM f),
b AS (SELECT *, CAST(greatest(1, coalesce(ceil((rn - 1) * 5.0::DOUBLE / nullif(n - 1, 0)), 1)) AS INTEGER) AS bucket FROM k),
g AS (SELECT *, count(*) FILTER (WHERE bucket = 5) OVER (PARTITION BY date) AS n_top, count(*) FILTER (WHERE bucket = 1) OVER (PARTITION BY date) AS n_low FROM b),
o AS (SELECT avg(s) AS observed FROM (SELECT date, avg(t) FILTER (WHERE bucket = 5) - avg(t) FILTER (WHERE bucket = 1) AS s FROM b GROUP BY date)),
r AS (SELECT rep, g.*, row_number() OVER (PARTITION BY rep, date ORDER BY ('0x' || substr(md5('42|' || rep || '|' || CAST(date AS VARCHAR) || '|' || ticker), 1, 8))::BIGINT, ticker) AS place FROM g, range(1000) q(rep)),
m AS (SELECT rep, avg(s) AS m FROM (SELECT rep, date, avg(t) FILTER (WHERE place > n - n_top) - avg(t) FILTER (WHERE place <= n_low) AS s FROM r GROUP BY ALL) GROUP BY rep)
SELECT round(observed, 6) AS observed, round((count(*) FILTER (WHERE m >= observed) + 1) / (count(*) + 1.0), 6) AS p, count(*) AS reps FROM m, o GROUP BY observed""")
def e12(spark, sf):
    cal, bars = clusters.cut_once(A.market(spark, sf)), clusters.cut_once(A.monthly_bars(spark, sf).select("ticker", "date", "close"))
    return stats.permutation_null(signals(spark, sf, bars, cal), "mom6", "target_excess", reps=1000).select(*r6("observed", "p"), "reps")


@query("e14_capm", " SELECT round(regr_slope(r, m), 6) AS beta, round(regr_intercept(r, m), 6) AS alpha, round(regr_r2(r, m), 6) AS r2, count(*) AS n FROM rets WHERE r IS NOT NULL")
def e14(spark, sf):
    return stats.capm(panel(spark, sf), "r", "m").select(*r6("beta", "alpha", "r2"), "n")


@query("e16_classification", """, d AS (SELECT CAST(target_excess > 0 AS INTEGER) AS y, CAST(mom6 > 0 AS INTEGER) AS p, mom6 AS s FROM sig WHERE target_excess IS NOT NULL),
k AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY s), u AS (SELECT *, sum(pos) OVER w AS ap, sum(pos + neg) OVER w AS al FROM k WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn,
  (SELECT round(sum(neg * (ap - pos / 2.0)) / (sum(pos) * sum(neg)), 6) FROM u) AS roc_auc, (SELECT round(sum(pos * ap / al) / sum(pos), 6) FROM u) AS pr_auc FROM d""")
def e16(spark, sf):
    rows = signals(spark, sf).filter("target_excess is not null").select((F.col("target_excess") > 0).cast("int").alias("y"), (F.col("mom6") > 0).cast("int").alias("p"), F.col("mom6").alias("s"))
    return stats.classification(rows, "y", "p", "s").select("tp", "fp", "fn", "tn", *r6("roc_auc", "pr_auc"))


@query("e17_regression", " SELECT round(avg(abs(target_excess - mom6)), 6) AS mae, round(sqrt(avg(pow(target_excess - mom6, 2))), 6) AS rmse, round(1 - sum(pow(target_excess - mom6, 2)) / (var_pop(target_excess) * count(*)), 6) AS r2, count(*) AS n FROM sig WHERE target_excess IS NOT NULL")
def e17(spark, sf):
    return stats.regression(signals(spark, sf), "target_excess", "mom6").select(*r6("mae", "rmse", "r2"), "n")


@query("e20_redundancy", " SELECT round(corr(mom6, vol6), 6) AS pearson, round(1 / (1 - pow(corr(mom6, vol6), 2)), 6) AS vif, count(*) AS n FROM sig WHERE vol6 IS NOT NULL")
def e20(spark, sf):
    return stats.redundancy(signals(spark, sf), "mom6", "vol6").select(*r6("pearson", "vif"), "n")


@query("c17_blend", PRED + """, k AS (SELECT *, (rank() OVER (PARTITION BY model, date ORDER BY pred) + (count(*) OVER (PARTITION BY model, date, pred) - 1) / 2.0) / count(*) OVER (PARTITION BY model, date) AS pct FROM preds)
SELECT date, ticker, round(sum(CASE model WHEN 'momentum' THEN 0.7 ELSE 0.3 END * pct), 6) AS blend, count(*) AS models FROM k GROUP BY date, ticker""")
def c17(spark, sf):
    weights = spark.createDataFrame([("momentum", 0.7), ("low_vol", 0.3)], "model string, weight double")
    return xsec.rank_blend(predictions(spark, sf), weights).select("date", "ticker", *r6("blend"), "models")


@query("b1_backtest", RANKS.replace("count(*) OVER (PARTITION BY date) AS cn FROM sig", "count(*) OVER (PARTITION BY date) AS cn FROM sig WHERE target_simple IS NOT NULL").replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ") + """ SELECT date, round(avg(target_simple) FILTER (WHERE bucket = 5) - 0.001, 6) AS top, round(avg(target_simple) FILTER (WHERE bucket = 1), 6) AS bottom, round(avg(target_simple), 6) AS equal,
 round(avg(target_simple) FILTER (WHERE bucket = 5) - avg(target_simple) FILTER (WHERE bucket = 1) - 0.002, 6) AS long_short, count(*) AS n FROM bk GROUP BY date HAVING count(*) >= 5""")
def b1(spark, sf):
    return portfolio.backtest(signals(spark, sf), "mom6", "target_simple").select("date", *r6("top", "bottom", "equal", "long_short"), "n")


def picks(spark, sf):
    s = signals(spark, sf).join(F.broadcast(labels.schedule(A.market(spark, sf), 13, HORIZON, HORIZON, LAG).select("date", "period")), "date")
    return xsec.capped_top(s, "mom6", 10).withColumn("target", F.col("target_simple"))


PICKS = CAPPED + """, held AS (SELECT top.*, CAST((session_no - 13) / 6 AS INTEGER) AS period FROM top WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal))"""


SETTLED = PICKS + """, grid AS (SELECT h.period, h.ticker, h.entry_date, h.exit_date, h.target_simple AS t, c.date, CASE WHEN b.close > 0 THEN b.close END AS p
  FROM held h JOIN cal c ON c.date BETWEEN h.entry_date AND h.exit_date LEFT JOIN bars b ON b.ticker = h.ticker AND b.date = c.date),
names AS (SELECT period, ticker, any_value(t) AS t, max(p) FILTER (WHERE date = entry_date) AS c0, max(p) FILTER (WHERE date = exit_date) AS c1, count(p) AS valid, count(*) AS days FROM grid GROUP BY ALL),
ways AS (SELECT period, sum(valid) / sum(days) AS cover, bool_and(coalesce(abs(c1 / c0 - 1 - t) <= 1e-6 + 1e-5 * abs(t), false)) AS agree FROM names GROUP BY period),
wealth AS (SELECT period, date, avg(p / c0) AS w FROM grid JOIN names USING (period, ticker) GROUP BY ALL),
falls AS (SELECT period, min(f) AS mdd FROM (SELECT period, w / max(w) OVER (PARTITION BY period ORDER BY date) - 1 AS f FROM wealth) GROUP BY period),
sums AS (SELECT period, count(*) AS selected, count(target_simple) AS known, avg(target_simple) AS r, coalesce(sum(target_simple), 0) AS s, min(entry_date) AS entry_date, max(exit_date) AS exit_date FROM held GROUP BY period),
settled AS (SELECT period, selected, entry_date, exit_date, CASE WHEN selected <> 10 THEN 'insufficient_candidates' WHEN known < selected THEN 'unresolved_return' WHEN coalesce(cover, 0) < 1 THEN 'unresolved_path' WHEN NOT agree THEN 'endpoint_mismatch' ELSE 'settled_path' END AS status,
  CASE WHEN selected = 10 AND known = selected THEN r END AS return_settled, CASE WHEN selected = 10 AND known = selected AND cover = 1 AND agree THEN mdd END AS mdd,
  CASE WHEN selected = 10 THEN 1 - known / selected END AS missing_weight, CASE WHEN selected = 10 THEN cover END AS path_coverage, CASE WHEN selected = 10 THEN s / 10 END AS assumption_flat,
  CASE WHEN selected = 10 THEN (s - (selected - known) * 0.5) / 10 END AS assumption_loss50, CASE WHEN selected = 10 THEN (s - (selected - known)) / 10 END AS assumption_loss100
  FROM sums LEFT JOIN ways USING (period) LEFT JOIN falls USING (period))"""


@query("b3_settle", SETTLED + """ SELECT period, status, selected, round(return_settled, 6) AS return_settled, round(mdd, 6) AS mdd, round(missing_weight, 6) AS missing_weight, round(path_coverage, 6) AS path_coverage,
 round(assumption_flat, 6) AS assumption_flat, round(assumption_loss50, 6) AS assumption_loss50, round(assumption_loss100, 6) AS assumption_loss100 FROM settled""")
def b3(spark, sf):
    p = portfolio.settle(picks(spark, sf), A.monthly_bars(spark, sf), A.market(spark, sf), ["period"], 10)
    return p.select("period", "status", "selected", *r6("return_settled", "mdd", "missing_weight", "path_coverage", "assumption_flat", "assumption_loss50", "assumption_loss100"))


MARKS = PICKS + """, grid AS (SELECT h.period, h.ticker, h.exit_date, c.date, b.close FROM held h JOIN cal c ON c.date BETWEEN h.entry_date AND h.exit_date LEFT JOIN bars b ON b.ticker = h.ticker AND b.date = c.date),
marks AS (SELECT *, last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w AS m FROM grid WINDOW w AS (PARTITION BY period, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
walk AS (SELECT period, date, avg(CASE WHEN date = exit_date AND close IS NULL THEN 0.5 ELSE coalesce(m, 1) END) AS w FROM marks GROUP BY ALL)"""
CHAINED = """, ends AS (SELECT period, arg_max(w, date) AS e FROM walk GROUP BY period), base AS (SELECT period, coalesce(exp(sum(ln(e)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS b FROM ends),
c AS (SELECT period, date, w * b AS v, min(date) OVER (PARTITION BY period) AS f, min(period) OVER () AS p FROM walk JOIN base USING (period)),
line AS (SELECT date, v, v / lag(v) OVER (ORDER BY date) - 1 AS r, v / max(v) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS f, period FROM c WHERE date <> f OR period = p)"""


@query("b5_chained", MARKS + CHAINED + " SELECT 'momentum' AS strategy, round(arg_max(v, date) - 1, 6) AS total_return, round(min(f), 6) AS mdd, round(stddev_samp(r) * sqrt(12), 6) AS annualized_volatility, count(DISTINCT period) AS n_periods FROM line")
def b5(spark, sf):
    walk = portfolio.loss50_path(picks(spark, sf).withColumn("strategy", F.lit("momentum")), A.monthly_bars(spark, sf), A.market(spark, sf), ["strategy", "period"])
    return portfolio.chained(walk, ["strategy"]).select("strategy", *r6("total_return", "mdd", "annualized_volatility"), "n_periods")


@query("g9_concentration", PICKS + """, s AS (SELECT period, sector, count(*) AS n FROM held GROUP BY ALL) SELECT period, CAST(sum(n) AS BIGINT) AS holdings, round(max(n) / sum(n), 6) AS max_sector_weight, count(*) AS unique_sectors FROM s GROUP BY period""")
def g9(spark, sf):
    return portfolio.concentration(picks(spark, sf), ["period"]).select("period", "holdings", *r6("max_sector_weight"), "unique_sectors")


@query("b8_contribution", PICKS + """, s AS (SELECT period, ticker, target_simple AS t, 1.0 / count(*) OVER (PARTITION BY period) AS w FROM held WHERE target_simple IS NOT NULL),
n AS (SELECT period, sum(w * t) AS r FROM s GROUP BY period), nav AS (SELECT period, coalesce(exp(sum(ln(1 + r)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS nav FROM n)
SELECT period, ticker, round(nav * w * t, 6) AS contribution FROM s JOIN nav USING (period)""")
def b8(spark, sf):
    rows = picks(spark, sf).withColumn("model", F.lit("momentum")).filter("target is not null")
    return portfolio.contribution(rows, ["model"], "period").select("period", "ticker", *r6("contribution"))


@query("g4_coverage_year", " , d AS (SELECT date, avg(CAST(observed AS DOUBLE)) AS c, count(*) FILTER (WHERE NOT observed) AS m FROM panel GROUP BY date) SELECT CAST(year(date) AS INTEGER) AS year, round(avg(c), 6) AS mean_price_coverage, round(min(c), 6) AS min_price_coverage, round(avg(m), 6) AS mean_missing_securities FROM d GROUP BY 1")
def g4(spark, sf):
    d = panel(spark, sf).groupBy("date").agg(F.avg(F.col("observed").cast("double")).alias("c"), F.count(F.when(~F.col("observed"), 1)).alias("m"))
    return d.groupBy(F.year("date").alias("year")).agg(F.round(F.avg("c"), 6).alias("mean_price_coverage"), F.round(F.min("c"), 6).alias("min_price_coverage"), F.round(F.avg("m"), 6).alias("mean_missing_securities"))


MACRO = """WITH mac AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / count(*) FILTER (WHERE o_orderpriority LIKE '1%'), 6) AS x1,
 round(CAST(sum(CASE WHEN o_orderpriority LIKE '2%' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / count(*) FILTER (WHERE o_orderpriority LIKE '2%'), 6) AS x2 FROM orders GROUP BY 1),
thin AS (SELECT date, CASE WHEN month(date) % 5 <> 0 AND NOT (year(date) = 1995 AND month(date) BETWEEN 2 AND 8) THEN x1 END AS x1, x2 FROM mac),
full_ AS (SELECT date, last_value(x1 IGNORE NULLS) OVER w AS x1, last_value(x2 IGNORE NULLS) OVER w AS x2 FROM thin WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
made AS (SELECT date, x1 - x2 AS spread, x1 - x2 - lag(x1 - x2, 4) OVER o AS spread_change, x1 AS level, x1 / lag(x1, 4) OVER o - 1 AS change, ln(x2 / lag(x2, 6) OVER o) AS log_return FROM full_ WINDOW o AS (ORDER BY date))"""


@query("w20_macro", MACRO + " SELECT date, " + ", ".join(f"round(lag({c}) OVER (ORDER BY date), 6) AS {c}" for c in ("spread", "spread_change", "level", "change", "log_return")) + " FROM made")
def w20(spark, sf):
    from panelweave.operators import reports

    gap = ((F.month("date") % 5 == 0) | ((F.year("date") == 1995) & F.month("date").between(2, 8)))
    rows = A.macro(spark, sf).withColumn("x1", F.when(~gap, F.col("x1")))
    return reports.macro_features(rows, "x1", "x2", short=4, long=6).select("date", *r6("spread", "spread_change", "level", "change", "log_return"))


@query("st1_batch_bars", """WITH e AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bar FROM events WHERE value > 0)
SELECT bar, event_type AS ticker, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS ticks FROM e GROUP BY ALL""")
def st1(spark, sf):
    from panelweave.streaming.bars import tick_bars

    return tick_bars(A.table(spark, sf, "events")).select("bar", "ticker", "open", "high", "low", "close", "ticks")


def model_rows(spark, sf, bars=None, calendar=None):
    cal = A.market(spark, sf) if calendar is None else calendar
    rows = panel(spark, sf, bars, cal).withColumns({"vol": W.volatility("r", 6, YEAR), "beta": W.beta("r", "m", 12), "gap": W.ma_gap("close", 6), "mom": W.momentum("close", 6), "rsi": W.rsi("diff", 6)})
    rows = labels.horizon_labels(rows, cal, HORIZON, LAG).filter("observed").withColumn("eligible", F.lit(True))
    return joins.attach_sector(rows, A.sectors(spark, sf))


FEATURES = ["vol", "beta", "gap", "mom", "rsi"]


def fold_days(spark, sf, sessions, calendar=None):
    rows = (A.market(spark, sf) if calendar is None else calendar).filter(F.col("session_no").isin(*sessions)).select("session_no", "date").collect()
    return [r["date"] for r in sorted(rows)]


@query("m5_walk_forward")
def m5(spark, sf):
    from panelweave.plans import models

    cal, bars = clusters.cut(A.market(spark, sf)), clusters.cut(A.monthly_bars(spark, sf).select("ticker", "date", "close"))
    folds = [(r["period"], r["date"]) for r in labels.schedule(cal, 13, HORIZON, HORIZON, LAG).orderBy("period").collect()]
    return models.walk_forward(model_rows(spark, sf, bars, cal), folds, FEATURES, "target_excess", {"elastic_net": models.elastic_net, "boosted": models.boosted}).select("model", "fold", "date", "ticker", "pred")


@query("m4_training_scopes")
def m4(spark, sf):
    from panelweave.plans import models

    day = fold_days(spark, sf, [60])[0]
    rows = clusters.cut(model_rows(spark, sf))
    train = labels.purged(rows, spark.createDataFrame([(0, day)], "fold int, day date"))
    return models.training_scopes(train, rows.filter(F.col("date") == F.lit(day)), FEATURES, ["vol", "beta"], "target_excess", models.elastic_net).select("scope", "ticker", "stable", "pred")


@query("m12_risk_classifiers")
def m12(spark, sf):
    from panelweave.plans import models

    cal, bars = clusters.cut(A.market(spark, sf)), clusters.cut(A.monthly_bars(spark, sf).select("ticker", "date", "close"))
    rows = labels.future_risk(labels.forward_outcomes(model_rows(spark, sf, bars, cal).select("ticker", "date", "close", *FEATURES), HORIZON, YEAR).dropna(subset=["future_vol", "future_mdd"]), 0.3)
    rows = clusters.cut(rows.select("date", *FEATURES, "future_risky"))
    a, b = fold_days(spark, sf, [48, 60], cal)
    return models.risk_classifiers(rows.filter(F.col("date") < F.lit(a)), rows.filter(F.col("date").between(a, b)), rows.filter(F.col("date") > F.lit(b)), FEATURES, "future_risky")


@query("m14_locked_ensemble")
def m14(spark, sf):
    from panelweave.plans import models

    rows, lock = clusters.cut(model_rows(spark, sf)), fold_days(spark, sf, [60])[0]
    # the half-year of sessions that starts each year, as far as its labels are known before the lock
    snapshots = labels.yearly_snapshots(A.market(spark, sf), first=6, every=1).filter(F.col("session_no") + LAG + HORIZON < 60)
    years = snapshots.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("start"), F.max("date").alias("end")).orderBy("year").collect()
    ic = clusters.cut(models.purged_cv(rows, [(r["start"], r["end"]) for r in years], FEATURES, "target_excess", models.elastic_net))
    cv = ic.select(F.lit("elastic_net").alias("model"), "ic")
    cv = cv.unionByName(stats.daily_ic(rows.join(ic.select("date"), "date", "left_semi"), "mom", "target_excess").select(F.lit("momentum").alias("model"), "ic"))
    scores = models.walk_forward(rows, [(0, lock)], FEATURES, "target_excess", {"elastic_net": models.elastic_net}).select("model", "date", "ticker", "sector", "pred")
    scores = scores.unionByName(rows.filter((F.col("date") == F.lit(lock)) & F.col("mom").isNotNull()).select(F.lit("momentum").alias("model"), "date", "ticker", "sector", F.col("mom").alias("pred")))
    return models.locked_ensemble(cv, scores).select("date", "ticker", "sector", "pick", *r6("blend"))


@query("g1_ticker_coverage", """, byflag AS (SELECT ticker, date, l_returnflag AS source FROM lines GROUP BY ALL)
SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
 round(count(*) / (SELECT count(*) FROM range(DATE '1992-01-01', DATE '1999-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6), 6) AS coverage, count(*) < 150 AS short_history FROM byflag GROUP BY ticker""")
def g1(spark, sf):
    from panelweave.operators import tables

    raw = A.monthly_bars(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "source")
    return tables.ticker_coverage(raw, "1992-01-01", "1999-01-01", 150).withColumn("coverage", F.round("coverage", 6))


@query("g3_member_coverage", """, m AS (SELECT DISTINCT c.date, m.ticker FROM cal c JOIN member m ON c.date >= m.start_date AND (m.end_date IS NULL OR c.date < m.end_date))
SELECT m.date, count(*) AS expected, count(b.close) AS priced, coalesce(string_agg(CASE WHEN b.close IS NULL THEN m.ticker END, ',' ORDER BY m.ticker), '') AS missing FROM m LEFT JOIN bars b ON b.ticker = m.ticker AND b.date = m.date GROUP BY m.date""")
def g3(spark, sf):
    from panelweave.operators import tables

    cal = A.market(spark, sf)
    spans = A.membership(spark, sf, cal)
    rows = joins.members(spans.select("ticker").distinct().crossJoin(F.broadcast(cal.select("date"))), spans).filter("member")
    return tables.member_coverage(rows, A.monthly_bars(spark, sf))


RISK = """, y AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS p FROM bars),
o AS (SELECT ticker, date, round(list_stddev_samp(list_transform(range(1, 7), lambda i: p[i + 1] / p[i] - 1)) * sqrt(12), 8) AS v, round(list_min(list_transform(range(1, 8), lambda i: p[i] / list_max(p[1:i]) - 1)), 8) AS d FROM y WHERE len(p) = 7),
s AS (SELECT *, round((coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) - coalesce((d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 0)) / 2, 10) AS z FROM o WINDOW w AS (PARTITION BY date)),
risk AS (SELECT *, z >= round(quantile_cont(z, 0.7) OVER (PARTITION BY date), 10) AS risky FROM s)"""


def risk_rows(spark, sf):
    rows = labels.forward_outcomes(A.monthly_bars(spark, sf), HORIZON, YEAR).dropna(subset=["future_vol", "future_mdd"])
    rows = rows.withColumn("future_vol", F.round("future_vol", 8)).withColumn("future_mdd", F.round("future_mdd", 8))
    return joins.attach_sector(labels.future_risk(rows, 0.3), A.sectors(spark, sf))


@query("g5_group_risk", RISK + " SELECT sector, count(*) AS n_rows, count(DISTINCT date) AS n_dates, round(avg(v), 6) AS mean_future_vol, round(avg(d), 6) AS mean_future_mdd, round(avg(CAST(d <= -0.5 AS DOUBLE)), 6) AS mdd_breach, round(avg(CAST(risky AS DOUBLE)), 6) AS future_risky_rate FROM risk JOIN sect USING (ticker) GROUP BY sector")
def g5(spark, sf):
    from panelweave.operators import tables

    return tables.group_risk(risk_rows(spark, sf), "sector", -0.5).select("sector", "n_rows", "n_dates", *r6("mean_future_vol", "mean_future_mdd", "mdd_breach", "future_risky_rate"))


@query("g11_transitions", RANKS.replace("(rn - 1) * 5 / ", "(rn - 1) * 5.0::DOUBLE / ") + """, st AS (SELECT ticker, session_no, CASE WHEN bucket = 1 THEN 'low' WHEN bucket = 5 THEN 'high' ELSE 'mid' END AS state FROM bk),
pr AS (SELECT a.state AS state_from, b.state AS state_to FROM st a JOIN st b ON a.ticker = b.ticker AND b.session_no = a.session_no + 6)
SELECT state_from, count(*) FILTER (WHERE state_to = 'low') AS n_low, count(*) FILTER (WHERE state_to = 'mid') AS n_mid, count(*) FILTER (WHERE state_to = 'high') AS n_high,
 round(avg(CAST(state_to = 'low' AS DOUBLE)), 6) AS share_low, round(avg(CAST(state_to = 'mid' AS DOUBLE)), 6) AS share_mid, round(avg(CAST(state_to = 'high' AS DOUBLE)), 6) AS share_high FROM pr GROUP BY state_from""")
def g11(spark, sf):
    from panelweave.operators import tables

    rows = xsec.buckets(signals(spark, sf), "mom6", 5)
    state = F.when(F.col("bucket") == 1, "low").when(F.col("bucket") == 5, "high").otherwise("mid")
    pairs = joins.snapshot_pairs(rows.select("ticker", "session_no", state.alias("state")), 6)
    return tables.transitions(pairs, ["low", "mid", "high"]).select("state_from", "n_low", "n_mid", "n_high", *r6("share_low", "share_mid", "share_high"))


@query("w22_regimes", """, mk AS (SELECT session_no, ln(m_close / lag(m_close) OVER (ORDER BY session_no)) AS r FROM cal),
a AS (SELECT *, CASE WHEN count(r) OVER w12 = 12 THEN exp(sum(r) OVER w12) - 1 END AS trend, CASE WHEN count(r) OVER w3 = 3 THEN stddev_samp(r) OVER w3 END AS vol FROM mk
 WINDOW w12 AS (ORDER BY session_no ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w3 AS (ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN count(vol) OVER p >= 12 THEN quantile_cont(vol, 0.75) OVER p END AS cut FROM a WINDOW p AS (ORDER BY session_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(session_no AS BIGINT) AS session_no, CASE WHEN trend IS NOT NULL AND cut IS NOT NULL THEN CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END || '_' || CASE WHEN vol > cut THEN 'wild' ELSE 'calm' END END AS regime FROM b""")
def w22(spark, sf):
    from panelweave.operators import tables

    rows = A.market(spark, sf).withColumn("r", F.log(F.col("m_close") / F.lag("m_close").over(Window.orderBy("session_no"))))
    return tables.regimes(rows, "r", 12, 3).select(F.col("session_no").cast("long").alias("session_no"), "regime")


@query("e13_offsets", RANKS + " SELECT CAST(session_no % 6 AS INTEGER) AS offset_no, round(avg(target_simple) FILTER (WHERE pct > 0.8), 6) AS picked, round(avg(target_simple), 6) AS equal, count(DISTINCT date) AS n_dates FROM rk GROUP BY 1")
def e13(spark, sf):
    from panelweave.operators import tables

    rows = signals(spark, sf).withColumn("pct", xsec.percentile_rank("mom6", "date"))
    return tables.offset_sweep(rows, "target_simple", 6, F.col("pct") > 0.8).select(F.col("offset").cast("int").alias("offset_no"), *r6("picked", "equal"), "n_dates")


@query("e19_paired_exact", RANKS + """, d AS (SELECT sector, count(*) FILTER (WHERE pct > 0.5 AND target_excess > 0 AND mom6 <= 0) AS b, count(*) FILTER (WHERE pct <= 0.5 AND target_excess > 0 AND mom6 > 0) AS c FROM rk GROUP BY sector)
SELECT sector, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) END, 5) AS p FROM d""")
def e19(spark, sf):
    rows = signals(spark, sf).withColumn("pct", xsec.percentile_rank("mom6", "date"))
    up = F.col("target_excess") > 0
    pairs = rows.groupBy("sector").agg(F.count(F.when((F.col("pct") > 0.5) & up & (F.col("mom6") <= 0), 1)).alias("b"), F.count(F.when((F.col("pct") <= 0.5) & up & (F.col("mom6") > 0), 1)).alias("c"))
    return pairs.withColumn("p", F.round(stats.paired_exact(F.col("b"), F.col("c")), 5))


@query("e21_correlations", " SELECT 'mom6' AS a, 'mom6' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'mom6', 'vol6', (SELECT round(corr(mom6, vol6), 6) FROM sig) UNION ALL SELECT 'vol6', 'vol6', 1.0")
def e21(spark, sf):
    return stats.correlation_matrix(signals(spark, sf), ["mom6", "vol6"]).withColumn("r", F.round("r", 6))


@query("t10_seeded_sample", " SELECT ticker, date FROM bars ORDER BY ('0x' || substr(md5('42|' || ticker || '|' || CAST(date AS VARCHAR)), 1, 8))::BIGINT, ticker, date LIMIT 50")
def t10(spark, sf):
    from panelweave.operators import tables

    rows = A.monthly_bars(spark, sf).withColumn("day", F.col("date").cast("string"))
    return tables.seeded_sample(rows, ["ticker", "day"], 50).select("ticker", "date")


@query("b2_compounded", PICKS + """, p AS (SELECT period, min(date) AS date, avg(target_simple) AS r FROM held GROUP BY period), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, date) AS n FROM p WHERE r IS NOT NULL)
SELECT 'momentum' AS strategy, round(exp(sum(ln(1 + r))) - 1, 6) AS compound, round(exp(coalesce(sum(ln(1 + r)) FILTER (WHERE n > 1), 0)) - 1, 6) AS without_best, count(*) AS n_periods FROM k""")
def b2(spark, sf):
    rows = picks(spark, sf).groupBy("period").agg(F.min("date").alias("date"), F.avg("target_simple").alias("r")).withColumn("strategy", F.lit("momentum"))
    return portfolio.compounded(rows, "r", "strategy").select("strategy", *r6("compound", "without_best"), "n_periods")


@query("b10_sector_effects", PICKS + """, u AS (SELECT date, sector, count(*) AS un, avg(target_simple) AS ur FROM sig WHERE session_no >= 13 AND (session_no - 13) % 6 = 0 AND session_no + 7 <= (SELECT max(session_no) FROM cal) GROUP BY ALL),
p AS (SELECT date, sector, count(*) AS pn, avg(target_simple) AS pr FROM held GROUP BY ALL)
SELECT date, sector, round(coalesce(pn / sum(pn) OVER w, 0), 6) AS weight, round(un / sum(un) OVER w, 6) AS universe_weight,
 round((coalesce(pn / sum(pn) OVER w, 0) - un / sum(un) OVER w) * (ur - sum(un * ur) OVER w / sum(un) OVER w), 6) + 0 AS allocation,
 round(coalesce(pn / sum(pn) OVER w, 0) * coalesce(pr - ur, 0), 6) + 0 AS selection FROM u LEFT JOIN p USING (date, sector) WINDOW w AS (PARTITION BY date)""")
def b10(spark, sf):
    dates = labels.schedule(A.market(spark, sf), 13, HORIZON, HORIZON, LAG).select("date")
    universe = signals(spark, sf).join(F.broadcast(dates), "date", "left_semi").withColumn("target", F.col("target_simple"))
    return portfolio.sector_effects(picks(spark, sf), universe).select("date", "sector", *r6("weight", "universe_weight"), *((F.round(c, 6) + 0.0).alias(c) for c in ("allocation", "selection")))  # no negative zeros


@query("x1_explanation", CAPPED + " SELECT date, ticker, 'score ' || format('{:.2f}', mom6) || coalesce('; volatility ' || format('{:.2f}', vol6), '') AS why FROM top")
def x1(spark, sf):
    from panelweave.operators import tables

    rows = xsec.capped_top(signals(spark, sf), "mom6", 10)
    return rows.select("date", "ticker", tables.explanation("mom6", {"vol6": "volatility"}).alias("why"))


@query("l12_thinned", " SELECT ticker, date FROM (SELECT ticker, date, dense_rank() OVER (ORDER BY date) AS k FROM bars) WHERE (k - 1) % 5 = 0")
def l12(spark, sf):
    return labels.thinned(A.monthly_bars(spark, sf), 5).select("ticker", "date")


@query("l17_folds", ", n AS (SELECT count(*) AS n, floor(count(*) / 5.0) AS b FROM cal) SELECT CAST(f AS INTEGER) AS fold, CAST(f * b - 6 AS BIGINT) AS train_end_no, CAST(f * b + 1 AS BIGINT) AS test_first_no, CAST(CASE WHEN f = 4 THEN n ELSE (f + 1) * b END AS BIGINT) AS test_last_no FROM n, range(1, 5) t(f)")
def l17(spark, sf):
    return labels.expanding_folds(A.market(spark, sf), 4, 6)


@query("c18_ic_weights", PRED + IC + ", m AS (SELECT model, avg(ic) AS ic FROM ic GROUP BY model) SELECT model, round(ic, 6) AS ic, round(CASE WHEN sum(greatest(ic, 0)) OVER () > 0 THEN greatest(ic, 0) / sum(greatest(ic, 0)) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM m")
def c18(spark, sf):
    ic = stats.daily_ic(predictions(spark, sf), "pred", "target_excess", ("model", "date")).groupBy("model").agg(F.avg("ic").alias("ic"))
    return xsec.ic_weights(ic).select("model", *r6("ic", "weight"))


@query("p16_common_sample", PRED + ", c AS (SELECT date, ticker FROM preds GROUP BY ALL HAVING count(DISTINCT model) = 2) SELECT model, count(*) AS n_rows, count(c.ticker) AS n_common, count(*) - count(c.ticker) AS n_dropped FROM preds LEFT JOIN c USING (date, ticker) GROUP BY model")
def p16(spark, sf):
    return clean.common_sample(predictions(spark, sf))[1]


from panelweave import queries_audits, queries_models, queries_reports  # noqa: E402, F401  they register their queries in the same tables
