"""Fitted sector models and the diagnosis of predictions, on small tables against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import clusters, sector_model, stats
from panelweave.plans import diagnostics

DAY = dt.date(2020, 1, 1)


def blobs(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"T{i}", s, *(float(x) for x in rng.normal([c, 2 * c], 0.3).round(4))) for s in ("A", "B") for i in range(n) for c in [i % 3 * (3 if s == "A" else -4)]]
    return spark.createDataFrame(rows, "ticker string, sector string, x double, y double")


def test_sector_model_equals_plain_lloyd(spark):
    rows = blobs(spark)
    model = {r.sector: r for r in sector_model.fit(rows, ["x", "y"], k=3).collect()}
    got = sector_model.assign(rows, sector_model.fit(rows, ["x", "y"], k=3), ["x", "y"]).toPandas()
    for sector, part in rows.toPandas().groupby("sector"):
        x = part[["x", "y"]].to_numpy()
        low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        z = np.round((x - mid) / (high - low), 10)
        s = np.round(z.sum(axis=1), 10)
        own = (s[:, None] > np.quantile(s, [1 / 3, 2 / 3], method="inverted_cdf")).sum(axis=1)
        for _ in range(100):
            centres = np.stack([z[own == k].mean(axis=0) for k in range(3)])
            fresh = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            if (fresh == own).all():
                break
            own = fresh
        assert np.allclose(model[sector].centres, centres, atol=1e-6) and model[sector].n_train == len(x)
        mine = got[got.sector == sector].set_index("ticker").cluster
        assert (mine[part.ticker].to_numpy() == own).all()


def test_sector_model_is_not_moved_by_later_rows(spark):
    train, later = blobs(spark), blobs(spark, 30, seed=9).withColumn("x", F.col("x") * 50)
    model = clusters.cut(sector_model.fit(train, ["x", "y"]))
    alone = sector_model.assign(later, model, ["x", "y"]).count()
    again = sector_model.fit(train, ["x", "y"]).orderBy("sector").collect()
    assert model.orderBy("sector").collect() == again and alone == later.count()
    other = sector_model.assign(later.withColumn("sector", F.lit("C")), model, ["x", "y"])
    assert other.count() == 0  # a group without a model has no cluster
    assert sector_model.fit(train.limit(0), ["x", "y"]).count() == 0
    broken = later.withColumn("x", F.when(F.col("ticker") == "T1", None).otherwise(F.col("x")))
    assert sector_model.assign(broken, model, ["x", "y"]).count() == later.count() - 2


def test_priorities_equal_ranks_of_centres(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(rng.integers(0, 3)), *(float(v) for v in rng.normal(size=4))) for s in "AB" for _ in range(40)]
    df = pd.DataFrame(rows, columns=["sector", "cluster", "v1", "v2", "b1", "b2"])
    got = sector_model.priorities(spark.createDataFrame(rows, "sector string, cluster int, v1 double, v2 double, b1 double, b2 double"), ["v1", "v2"], ["b1", "b2"]).toPandas().set_index(["sector", "cluster"])
    for sector, part in df.groupby("sector"):
        centres, absolute = part.groupby("cluster")[["v1", "v2"]].mean(), part[["b1", "b2"]].abs().groupby(part.cluster).mean()
        risk = 0.5 * centres.rank().mean(axis=1) + 0.5 * absolute.rank().mean(axis=1)
        order = risk.sort_values(kind="stable").index.tolist()
        assert [got.loc[(sector, c)].priority for c in order] == [1, 2, 3]
        assert np.allclose(got.loc[sector].risk_score.sort_index(), risk.sort_index())
        assert np.allclose(got.loc[sector].abs_beta_mean.sort_index(), absolute.mean(axis=1).sort_index())


def test_pairwise_silhouette_and_choice(spark):
    rng = np.random.default_rng(5)
    points = [(g, [float(x) for x in rng.normal(c, 1, 2)], c) for g in "AB" for c in (0, 1, 2) for _ in range(9)] + [("B", [50.0, 50.0], 7)]
    got = {r.g: r for r in sector_model.pairwise_silhouette(spark.createDataFrame(points, "g string, _zs array<double>, cluster int"), "g").collect()}
    for g in "AB":
        z, c = np.array([p[1] for p in points if p[0] == g]), np.array([p[2] for p in points if p[0] == g])
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        want = []
        for i in range(len(z)):
            own = (c == c[i]) & (np.arange(len(z)) != i)
            a, b = d[i, own].mean() if own.any() else 0, min(d[i, c == k].mean() for k in set(c) if k != c[i])
            want.append((b - a) / max(a, b) if own.any() else 0.0)
        assert np.isclose(got[g].silhouette, np.mean(want)) and got[g].n_sample == len(z)
    table = sector_model.choose_k(blobs(spark).filter("sector = 'A'"), ["x", "y"], ["ticker"], (2, 3, 4), sample=40).toPandas()
    assert table.k[table.silhouette.idxmax()] == 3 and (table.n_sample == 40).all() and (table.n_rows == 60).all()
    assert table.inertia.is_monotonic_decreasing


def test_market_beta_equals_a_plain_sandwich(spark):
    rng = np.random.default_rng(7)
    rows = []
    for model, n, moves in (("a", 90, 1), ("b", 40, 1), ("short", 12, 1), ("flat", 50, 0)):
        m = rng.normal(0, 0.02, n) * moves
        y = 0.001 + 0.7 * m + np.convolve(rng.normal(0, 0.01, n + 2), [0.5, 0.3, 0.2], "valid")
        rows += [(model, DAY + dt.timedelta(days=i), float(y[i]), float(m[i]), 0.0001 * (i % 3) * moves) for i in range(n)]
    got = stats.market_beta(spark.createDataFrame(rows, "model string, date date, r double, m double, rf double"), ["model"], "r", "m", "rf", 5, year=250).toPandas().set_index("model")
    assert got.loc["short"].status == "insufficient_data" and got.loc["flat"].status == "constant_market" and got.loc[["short", "flat"]].beta.isna().all()
    for model in "ab":
        d = np.array([[y - f, m - f] for k, _, y, m, f in rows if k == model])
        n, x = len(d), np.column_stack([np.ones(len(d)), d[:, 1]])
        coef = np.linalg.lstsq(x, d[:, 0], rcond=None)[0]
        u = d[:, 0] - x @ coef
        s = x * u[:, None]
        meat = s.T @ s
        for k in range(1, 6):
            c = s[k:].T @ s[:-k]
            meat += (1 - k / 6) * (c + c.T)
        bread = np.linalg.inv(x.T @ x)
        se = np.sqrt(np.diag(bread @ meat @ bread) * n / (n - 2))
        r = got.loc[model]
        assert np.allclose([r.alpha_daily, r.beta, r.alpha_hac_t], [coef[0], coef[1], coef[0] / se[0]])
        assert np.allclose([r.alpha_ann_ci_low, r.beta_ci_high], [(coef[0] - 1.96 * se[0]) * 250, coef[1] + 1.96 * se[1]])
        assert np.isclose(r.r_squared, 1 - (u**2).sum() / ((d[:, 0] - d[:, 0].mean()) ** 2).sum())


OPTIONS = {"horizon": 4, "lag": 1, "top_fraction": 0.3, "top_k": 2, "beta_window": 8, "beta_least": 4, "hac_lag": 3, "min_stocks": 5, "trend": 6, "short": 3, "history": 4, "year": 250}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    days, names = [DAY + dt.timedelta(days=i) for i in range(60)], [f"N{i}" for i in range(9)]
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, (60, 9)), axis=0))
    prices = [(d, n, float(close[i, j])) for i, d in enumerate(days) for j, n in enumerate(names)]
    market = [(d, float(rng.normal(0, 0.02))) for d in days]
    preds = [(m, d, n, float(rng.normal())) for m in ("one", "two") for d in days[10:] for n in names[: 9 if m == "one" else 8]]
    return days, names, close, preds, prices, market


def frames(spark, preds, prices, market):
    return spark.createDataFrame(preds, "model string, date date, ticker string, pred double"), spark.createDataFrame(prices, "date date, ticker string, close double"), spark.createDataFrame(market, "date date, market_return double")


def test_diagnosis_of_a_plain_backtest(spark, world):
    days, names, close, preds, prices, market = world
    out = diagnostics.diagnose(*frames(spark, preds, prices, market), **OPTIONS)
    periods = out["periods"].toPandas().sort_values(["model", "date"]).set_index(["model", "date"])
    nav = {"one": 1.0, "two": 1.0}
    for i in range(10, 60 - 5, 4):
        for m in ("one", "two"):
            score = {n: p for k, d, n, p in preds if k == m and d == days[i] and n in names[:8]}  # both models have these
            best = sorted(score, key=lambda n: (score[n], n))[-3:]
            f = {n: close[i + 5, names.index(n)] / close[i + 1, names.index(n)] - 1 for n in score}
            r = periods.loc[(m, days[i])]
            assert np.isclose(r.portfolio_net, np.mean([f[n] for n in best]) - 0.001) and np.isclose(r.universe_return, np.mean(list(f.values()))) and r.n_universe == 8 and r.n_selected == 3
            assert np.isclose(r.market_return, np.prod([1 + x for _, x in market[i + 2 : i + 6]]) - 1) and np.isclose(r.linked_cost, nav[m] * 0.001)
            nav[m] *= 1 + r.portfolio_net
    assert len(periods) == 24
    table = out["comparison"].toPandas().set_index("model")
    daily = out["daily_portfolio"].toPandas().sort_values(["model", "date"])
    for m in ("one", "two"):
        curve = np.r_[1, np.cumprod(1 + daily[daily.model == m].portfolio_net.to_numpy())]
        assert np.isclose(table.loc[m].total_return_net, nav[m] - 1) and np.isclose(curve[-1], nav[m]) and np.isclose(table.loc[m].mdd, (curve / np.maximum.accumulate(curve) - 1).min())
        held = out["holdings"].filter(F.col("model") == m).agg(F.sum("linked_contribution")).first()[0]
        assert np.isclose(held - periods.loc[m].linked_cost.sum(), nav[m] - 1)
    assert not daily.duplicated(["model", "date"]).any() and len(daily) == 2 * 12 * 4
    weights = out["sector_weights"].toPandas()
    assert (weights.sector == "Unknown").all() and np.allclose(weights.top_weight, 1) and np.allclose(weights.active_weight, 0)
    report = out["alignment"].toPandas().set_index("model")
    assert report.loc["one"].n_dropped == 50 and report.loc["two"].n_dropped == 0 and (report.evaluated_rows == 45 * 8).all()
    assert dict(out["metadata"].collect())["risk_free"] == "zero_assumed"
    assert {"comparison", "regime_ic", "regime_performance", "sector_summary", "period_concentration"} <= set(out)


def test_diagnosis_sectors_and_schedule(spark, world):
    days, names, _, preds, prices, market = world
    tables = frames(spark, preds, prices, market)
    moved = spark.createDataFrame([(n, days[0], "Old") for n in names[:4]] + [(names[0], days[30], "New")], "ticker string, date date, sector string")
    out = diagnostics.diagnose(*tables, moved, n_periods=6, offset=2, **OPTIONS)
    sectors = out["sector_weights"].groupBy("date").agg(F.collect_set("sector").alias("s")).orderBy("date").collect()
    assert [r.date for r in sectors] == [days[i] for i in range(12, 36, 4)] and [("New" in r.s) for r in sectors] == [r.date >= days[30] for r in sectors] and all("Unknown" in r.s for r in sectors)
    assert dict(out["metadata"].collect())["sector_mode"] == "point_in_time"
    summed = out["sector_weights"].groupBy("model", "date").agg(F.sum("allocation_effect").alias("a"), F.sum("selection_effect").alias("s")).join(out["periods"], ["model", "date"]).toPandas()
    assert np.allclose(summed.a + summed.s, summed.portfolio_gross - summed.universe_return)


@pytest.mark.parametrize(("change", "message"), [
    (lambda p, c, m: (p + p[:1], c, m), "repeated keys of pred"),
    (lambda p, c, m: ([(*p[0][:3], None)] + p[1:], c, m), "values of pred"),
    (lambda p, c, m: (p, [x for x in c if not (x[1] == "N3" and x[0] == DAY + dt.timedelta(days=15))], m), "entry or exit price"),
    (lambda p, c, m: (p, c, m[:-1] + [(m[-1][0], -1.5)]), "values of market_return"),
    (lambda p, c, m: ([x for x in p if x[1] != DAY + dt.timedelta(days=14)], c, m), "scheduled"),
    (lambda p, c, m: ([], c, m), "no common row"),
])
def test_diagnosis_refuses_what_would_bend_its_result(spark, world, change, message):
    with pytest.raises(ValueError, match=message):
        diagnostics.diagnose(*frames(spark, *change(*world[3:])), **OPTIONS)


def test_clustering_does_not_take_a_job_a_step(spark):
    rng = np.random.default_rng(5)
    rows = [(d, f"T{i}", float(a), float(b)) for d in range(9) for i, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "date int, ticker string, a double, b double")
    _, steps = clusters.settled(rng.random((400, 2)), np.arange(400) * 5 // 400, 5, 300)
    assert not steps  # uniform points take many steps
    spark.sparkContext.setJobGroup("kmeans", "kmeans")
    try:
        got = {(r.date, r.ticker): r.risk_rank for r in clusters.grouped_kmeans(df, ["a", "b"], 5).collect()}
        clusters.k_sensitivity(df, ["a", "b"]).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans")) < 60
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(got) == len(rows) and set(got.values()) == set(range(5))


def test_the_walks_of_few_and_many_groups_find_the_same_centres(spark):
    rng = np.random.default_rng(6)
    points = [("ab"[i % 2], [round(float(x), 10) for x in z], int(i * 3 // 300)) for i, z in enumerate(rng.random((300, 3)))]
    rows = spark.createDataFrame(points, "g string, _zs array<double>, _seed int").repartition(5)
    few, many = ({r.g: r._centres for r in clusters.walk(rows, 3, 4, ["g"], 100, f)[1].collect()} for f in (True, False))
    assert few == many and few["a"][3] is None
    for g, centres in few.items():
        own = [(z, s) for name, z, s in points if name == g]
        alone, moved = clusters.settled(np.array([z for z, _ in own]), np.array([s for _, s in own]), 4, 100)
        assert not moved and np.allclose(alone[:3], np.array(centres[:3]), rtol=0, atol=1e-8) and np.isnan(alone[3]).all()


def test_quantiles_are_of_exact_rank(spark):
    rng = np.random.default_rng(9)
    x = {"a": rng.random(60_000), "b": rng.integers(0, 7, 50) / 2, "c": np.array([3.5])}
    rows = [(g, float(v), float(-v)) for g, own in x.items() for v in own]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x", "y"])).repartition(8)
    got = {r.g: (r.n, r.quantiles) for r in sector_model.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], "g").collect()}
    rank = lambda v, q: float(np.sort(v)[max(1, int(np.ceil(q * len(v)))) - 1])
    assert got == {g: (len(v), [[rank(s * v, q) for q in (0.25, 0.5, 0.75)] for s in (1, -1)]) for g, v in x.items()}
