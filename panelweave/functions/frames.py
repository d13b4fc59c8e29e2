"""Window expressions of panel features; all share one partitioning by ticker and order by session."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_ticker(order: str = "session_no"):
    return Window.partitionBy("ticker").orderBy(order)


def trailing(n: int, order: str = "session_no"):
    return by_ticker(order).rowsBetween(-(n - 1), 0)


def full(value: Column, window, n: int, statistic: Column) -> Column:
    """A windowed statistic where all n values are there, else null."""
    return F.when(F.count(value).over(window) == n, statistic.over(window))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log_return(close: str = "close", order: str = "session_no") -> Column:
    return F.log(F.col(close) / F.lag(close).over(by_ticker(order)))


def simple_return(close: str = "close", order: str = "session_no") -> Column:
    return F.col(close) / F.lag(close).over(by_ticker(order)) - 1


def volatility(r: str, n: int, year: int) -> Column:
    return full(F.col(r), trailing(n), n, F.stddev_samp(r)) * F.sqrt(F.lit(year))


def beta(r: str, m: str, n: int, least: int | None = None) -> Column:
    """Covariance with the market over its variance where both are known; null at zero variance or under `least` pairs."""
    w = trailing(n)
    x, y = F.when(F.col(r).isNotNull(), F.col(m)), F.when(F.col(m).isNotNull(), F.col(r))
    variance = F.var_samp(x).over(w)
    return F.when((F.count(y).over(w) >= (least or n)) & (variance > 0), F.covar_samp(y, x).over(w) / variance)


def downside(r: str, n: int, year: int) -> Column:
    low = F.least(F.col(r), F.lit(0.0))
    return F.when(F.count(r).over(trailing(n)) == n, F.sqrt(F.avg(F.when(F.col(r).isNotNull(), low * low)).over(trailing(n)) * year))


def sortino(r: str, n: int, year: int, guard: float = 1e-9) -> Column:
    """Annual mean over annual downside deviation; the guard keeps windows without losses finite."""
    return annual_mean(r, n, year) / (downside(r, n, year) + guard)


def annual_mean(r: str, n: int, year: int) -> Column:
    return full(F.col(r), trailing(n), n, F.avg(r)) * year


def drawdown(values: Column) -> Column:
    """The worst fall of an array of prices from its running peak."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, c):
        peak = F.greatest(acc["peak"], c)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], c / peak - 1).alias("worst"))

    return F.aggregate(values, start, step, lambda acc: acc["worst"])


def rolling_drawdown(close: str, n: int) -> Column:
    w = trailing(n)
    return F.when(F.count(close).over(w) == n, drawdown(F.collect_list(close).over(w)))


def ma_gap(close: str, n: int) -> Column:
    return F.col(close) / full(F.col(close), trailing(n), n, F.avg(close)) - 1


def momentum(close: str, n: int) -> Column:
    return F.col(close) / F.lag(close, n).over(by_ticker()) - 1


def relative_momentum(r: str, m: str, n: int) -> Column:
    return full(F.col(r), trailing(n), n, F.sum(r)) - F.sum(m).over(trailing(n))


def rsi(change: str, n: int) -> Column:
    """From a column of price differences or of returns: 100 without falls, 0 without rises, 50 without either."""
    w = trailing(n)
    up = F.avg(F.greatest(F.col(change), F.lit(0.0))).over(w)
    down = F.avg(F.greatest(-F.col(change), F.lit(0.0))).over(w)
    value = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return F.when(F.count(change).over(w) == n, value)


def relative_volume(volume: str, n: int) -> Column:
    v = F.nullif(F.col(volume), F.lit(0))
    w = by_ticker().rowsBetween(-n, -1)
    return v / F.when(F.count(v).over(w) == n, F.avg(v).over(w)) - 1


def volume_trend(volume: str, short: int, long: int) -> Column:
    v = F.nullif(F.col(volume), F.lit(0))
    return full(v, trailing(short), short, F.avg(v)) / full(v, trailing(long), long, F.avg(v)) - 1


def product(a: str, b: str, scale: float = 1.0) -> Column:
    """An interaction of a name's feature with one of the session, as beta with a spread."""
    return F.col(a) * F.col(b) / scale


def guarded_ratio(a: str, log_b: str, guard: float = 1e-5) -> Column:
    """A feature over the level that a log change stands for; the guard keeps the divisor from 0."""
    return F.col(a) / (F.exp(log_b) + guard)
