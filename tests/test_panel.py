"""Panel operators against plain formulas, identities and SQL."""

import datetime as dt
import glob

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave import queries as Q
from panelweave.functions import frames as W
from panelweave.operators import clean, joins, labels, portfolio, stats, xsec
from panelweave.sources import bars as S


def days(n):
    return [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(n)]


def bars(spark, prices, ticker="A"):
    return spark.createDataFrame([(ticker, d, i + 1, None if p is None else float(p)) for i, (d, p) in enumerate(zip(days(len(prices)), prices, strict=True))], "ticker string, date date, session_no int, close double")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    a, b = Q.QUERIES[name](spark, sf).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def rows(d):
        def text(x):
            if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
                return "null"
            return f"{x:.5f}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")

        return sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].itertuples(index=False))

    assert rows(a) == rows(b)


def test_gap_leaves_windows_null(spark):
    rows = bars(spark, [1, 2, None, 4, 5, 6, 7, 8]).withColumn("r", W.log_return()).withColumn("v", W.volatility("r", 3, 12)).orderBy("session_no").collect()
    assert [r.v is None for r in rows] == [True] * 6 + [False] * 2


def test_rsi_edges(spark):
    for prices, want in (([1, 2, 3, 4], 100.0), ([4, 3, 2, 1], 0.0), ([2, 2, 2, 2], 50.0)):
        rows = bars(spark, prices).withColumn("d", F.col("close") - F.lag("close").over(W.by_ticker())).withColumn("x", W.rsi("d", 3))
        assert rows.orderBy("session_no").collect()[-1].x == want


def test_drawdown_is_inside_the_window(spark):
    prices = [10, 5, 6, 7, 8, 4]
    got = [r.x for r in bars(spark, prices).withColumn("x", W.rolling_drawdown("close", 3)).orderBy("session_no").collect()]
    want = [None, None] + [min(p / max(prices[i - 2 : j + 1]) - 1 for j, p in zip(range(i - 2, i + 1), prices[i - 2 : i + 1])) for i in range(2, 6)]
    assert got[:2] == [None, None] and np.allclose(got[2:], want[2:])


def test_buckets_equal_quantile_cuts(spark):
    for n in (5, 6, 7, 11, 23, 50):
        rows = spark.createDataFrame([("d", f"t{i:03}", float(i)) for i in range(n)], "date string, ticker string, x double")
        got = xsec.buckets(rows, "x", 5).orderBy("x").toPandas().bucket.tolist()
        assert got == (pd.qcut(np.arange(1, n + 1), 5, labels=False) + 1).tolist()


def test_capped_top_is_greedy(spark):
    rng = np.random.default_rng(1)
    data = [("d", f"t{i:03}", f"s{rng.integers(3)}", float(rng.integers(20))) for i in range(60)]
    got = xsec.capped_top(spark.createDataFrame(data, "date string, ticker string, sector string, x double"), "x", 10, 0.3).orderBy("pick").toPandas()
    want, used = [], {}
    for _, t, s, x in sorted(data, key=lambda r: (-r[3], r[1])):
        if used.get(s, 0) < 3 and len(want) < 10:
            want.append(t)
            used[s] = used.get(s, 0) + 1
    assert got.ticker.tolist() == want


def test_membership_end_is_exclusive(spark):
    d = days(6)
    spans = spark.createDataFrame([("A", d[0], d[2]), ("A", d[4], None)], "ticker string, start_date date, end_date date")
    got = joins.members(bars(spark, [1] * 6), spans).orderBy("date").toPandas().member.tolist()
    assert got == [True, True, False, False, True, True]


def test_no_leak_from_later_prices(spark):
    cal = spark.createDataFrame([(d, i + 1, 100.0 + i) for i, d in enumerate(days(20))], "date date, session_no int, m_close double")
    def run(prices):
        rows = joins.densify(bars(spark, prices).drop("session_no"), cal).withColumn("r", W.log_return()).withColumn("v", W.volatility("r", 3, 12))
        return labels.horizon_labels(rows, cal, 3).filter("session_no <= 10").orderBy("session_no").toPandas()
    a = [float(x) for x in range(1, 21)]
    b = a[:10] + [x * 7 for x in a[10:]]
    x, y = run(a), run(b)
    assert x.v.equals(y.v)
    known = x.available_at.map(lambda t: t is not None and t <= days(20)[9])
    assert x[known].target_simple.equals(y[known].target_simple)


def test_settlement_statuses(spark):
    d = days(4)
    cal = spark.createDataFrame([(x,) for x in d], "date date")
    prices = bars(spark, [1, 2, 3, 4]).unionByName(bars(spark, [1, None, 1, 1], "B"))
    rows = [("ok", "A", d[0], d[3], 3.0), ("gap", "B", d[0], d[3], 0.0), ("open", "A", d[0], None, None), ("lost", "A", d[0], d[3], None), ("off", "A", d[0], d[3], 9.0)]
    got = portfolio.settle(spark.createDataFrame(rows, "period string, ticker string, entry_date date, exit_date date, target double"), prices, cal, ["period"], 1).toPandas().set_index("period")
    assert got.status.to_dict() == {"ok": "settled_path", "gap": "unresolved_path", "open": "missing_calendar", "lost": "unresolved_return", "off": "endpoint_mismatch"}
    assert got.assumption_loss50["lost"] == -0.5


def test_contributions_add_up(spark):
    rows = spark.createDataFrame([("m", p, t, r) for p, x in enumerate(([0.1, -0.2], [0.3, 0.05], [-0.1, 0.02])) for t, r in zip("AB", x, strict=True)], "model string, period int, ticker string, target double")
    total = portfolio.contribution(rows, ["model"], "period").agg(F.sum("contribution")).first()[0]
    assert np.isclose(total, np.prod([1 - 0.05, 1 + 0.175, 1 - 0.04]) - 1)


def test_best_source_and_upsert(spark):
    d = days(1)[0]
    rows = spark.createDataFrame([("A", d, "N", 1), ("A", d, "R", 2), ("A", d, "A", 3)], "ticker string, date date, source string, load int")
    assert clean.best_source(rows).first().source == "R"
    assert S.upsert_latest(rows, rows.filter("false"), ["ticker", "date"], "load").first().load == 3


def test_hand_off_refuses_future(spark):
    with pytest.raises(ValueError):
        clean.hand_off(spark.range(1).withColumn("future_vol", F.lit(1)), ["id", "future_vol"])


def test_paired_exact(spark):
    row = spark.createDataFrame([(1, 9), (0, 0), (5, 5)], "b int, c int").withColumn("p", stats.paired_exact(F.col("b"), F.col("c"))).collect()
    assert np.allclose([r.p for r in row], [0.021484375, 1.0, 1.0])


def test_stream_equals_batch(spark, sf, tmp_path):
    from panelweave.streaming.bars import current_bars, stream_bars, tick_bars

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    stream_bars(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = current_bars(spark.read.parquet(str(tmp_path / "out"))).drop("version").toPandas()
    want = tick_bars(events.withColumn("ts", F.col("ts").cast("timestamp"))).toPandas()
    key = ["bar", "ticker"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True)[want.columns], want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_model_queries_run_the_whole_job(spark, sf, monkeypatch):
    from panelweave.plans import models

    class Seen(Exception):
        pass

    def stop(*args, **more):
        raise Seen(args, more)

    def arguments(module, function, query):
        with monkeypatch.context() as patch, pytest.raises(Seen) as seen:
            patch.setattr(module, function, stop)
            Q.QUERIES[query](spark, sf)
        return seen.value.args

    calendar = Q.A.market(spark, sf)
    first, step, last = 13, 6, calendar.agg(F.max("session_no")).first()[0]
    number = {r["date"]: r["session_no"] for r in calendar.collect()}
    (_, folds, _, _, estimators), _ = arguments(models, "walk_forward", "m5_walk_forward")
    assert [number[day] for _, day in folds] == list(range(first, last - 6, step)) and len(folds) > 2
    assert estimators["boosted"]().getMaxIter() == 100
    (_, years, *_), _ = arguments(models, "purged_cv", "m14_locked_ensemble")
    assert len(years) > 1 and all(number[a] <= number[b] < 60 - 7 for a, b in years)
    assert arguments(stats, "block_bootstrap", "e10_bootstrap")[1]["n_boot"] == 1000
    assert arguments(stats, "permutation_null", "e12_permutation")[1]["reps"] == 1000


def lloyd(x, k):
    """Standardised points, labels and centres from the same seeds, one step after another until nothing moves."""
    sd = x.std(axis=0)
    z = np.round(np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0), 10)
    place = np.empty(len(z), int)
    place[np.lexsort((np.arange(len(z)), np.round(z.sum(axis=1), 10)))] = np.arange(len(z)) * k // len(z)
    old = None
    while old is None or not np.array_equal(old, place):
        centres = np.array([np.round(z[place == c].mean(axis=0), 10) for c in range(k)])
        old, place = place, np.round(((z[:, None] - centres) ** 2).sum(axis=2), 9).argmin(axis=1)
    return z, place, centres


def points(spark, per_day, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for day, n in zip(days(len(per_day)), per_day, strict=True):
        middle = rng.choice([0.1, 0.4, 0.9], n)
        rows += [(day, f"T{i:03d}", float(m + rng.normal(0, 0.08)), float(2 * m + rng.normal(0, 0.2)), "A" if i % 2 else None) for i, m in enumerate(middle)]
    return rows, spark.createDataFrame(rows, "date date, ticker string, a double, b double, sector string")


def test_kmeans_equals_plain_lloyd(spark):
    from panelweave.operators import clusters

    rows, df = points(spark, (60, 45, 11))
    got = {(r.date, r.ticker): r.risk_rank for r in clusters.grouped_kmeans(df, ["a", "b"]).collect()}
    want = {}
    for day in days(2):  # the third has too few rows
        mine = [r for r in rows if r[0] == day]
        _, place, centres = lloyd(np.array([r[2:4] for r in mine]), 3)
        rank = np.argsort(np.argsort(centres.sum(axis=1)))
        want |= {(day, r[1]): rank[p] for r, p in zip(mine, place, strict=True)}
    assert got == want
    assert clusters.grouped_kmeans(df.limit(0), ["a", "b"]).count() == 0


def test_k_sensitivity_equals_plain_formulas(spark):
    from panelweave.operators import clusters

    rows, df = points(spark, (50,))
    for r in clusters.k_sensitivity(df, ["a", "b"], (2, 4)).collect():
        z, place, centres = lloyd(np.array([x[2:4] for x in rows]), r.k)
        gaps = np.sqrt(((z[:, None] - centres) ** 2).sum(axis=2))
        near = np.sort(gaps, axis=1)
        within = [gaps[place == c, c].mean() for c in range(r.k)]
        dbi = np.mean([max((within[i] + within[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(r.k) if j != i) for i in range(r.k)])
        inside = (near[:, 0] ** 2).sum()
        ch = ((z**2).sum() - inside) / (r.k - 1) / (inside / (len(z) - r.k))
        want = (((near[:, 1] - near[:, 0]) / near[:, 1]).mean(), dbi, ch, np.bincount(place).min() / len(z))
        np.testing.assert_allclose((r.silhouette, r.dbi, r.ch, r.min_share), want, rtol=1e-5)


def test_sector_policy_knows_unknown_sectors(spark):
    from panelweave.operators import clusters

    _, df = points(spark, (40,))
    out = clusters.sector_policy(clusters.grouped_kmeans(df, ["a", "b"]), ["a", "b"]).toPandas()
    assert len(out) == 40 and (out[out.sector.isna()].sector_status == "UNKNOWN").all()
    assert set(out[out.sector == "A"].sector_status) == {"STABLE", "MIDDLE", "RISKY"}
    assert (out.balanced_verified <= out.balanced_eligible).all() and (out.balanced_eligible <= out.stable).all()


def test_running_sums_equal_a_plain_scan(spark):
    rng = np.random.default_rng(3)
    values = sorted({round(float(v), 3) for v in rng.normal(0, 1, 400)} | {float(10**6)})
    rows = [(v, int(rng.integers(1, 9))) for v in values]
    df = spark.createDataFrame(rows, "v double, n long")
    up = {r.v: r.n_to for r in stats.running_sums(df, "v", ["n"], slices=7).collect()}
    down = {r.v: r.n_to for r in stats.running_sums(df, "v", ["n"], descending=True, slices=7).collect()}
    counts = np.array([n for _, n in rows])
    assert up == dict(zip(values, np.cumsum(counts).tolist(), strict=True))
    assert down == dict(zip(values, np.cumsum(counts[::-1])[::-1].tolist(), strict=True))
    assert stats.running_sums(df.limit(0), "v", ["n"]).count() == 0


def test_candidate_is_deferred_without_a_path_within_the_limit(spark):
    from panelweave.operators import reports

    rows = [("a", 4, "complete_path", 0.9, -0.3), ("b", 4, "complete_path", 0.2, -0.1), ("c", 4, "complete_path", 0.2, -0.1), ("d", 3, "complete_path", 2.0, -0.01), ("e", 4, "incomplete", None, None)]
    summary = spark.createDataFrame(rows, "strategy string, n_periods int, status string, cumulative_return double, mdd double")
    ic = spark.createDataFrame([("b", 0.01), ("c", 0.02)], "strategy string, mean_ic double")
    got = reports.select_candidate(summary, ic, 4).toPandas().set_index("strategy")
    assert got.selected[got.selected].index.tolist() == ["c"] and got.eligible.to_dict() == {"a": True, "b": True, "c": True, "d": False, "e": False}
    none = reports.select_candidate(summary, ic, 4, limit=-0.05).toPandas()
    assert not none.selected.any() and set(none.selection_status) == {"deferred_no_complete_risk_qualified_candidate"}


def test_scopes_settle_only_whole_picks(spark):
    from panelweave.operators import reports

    def scope(day, returns):
        return [("all", day, f"T{i}", f"s{i}", i < 4, float(10 - i), r) for i, r in enumerate(returns)]

    a, b, c = days(3)
    rows = scope(a, [0.1, 0.2, 0.3, 0.0, 0.5, 0.5]) + scope(b, [0.1, None, 0.3, 0.0, 0.5, 0.5]) + scope(c, [0.1, 0.2])
    df = spark.createDataFrame(rows, "scope string, date date, ticker string, sector string, stable boolean, pred double, ret double")
    got = {r.date: r for r in reports.scope_comparison(df, "ret", (4,)).collect()}
    assert [got[d].status for d in (a, b, c)] == ["settled", "missing_return", "insufficient_candidates"]
    assert got[a].return_settled == pytest.approx(0.15) and got[b].return_settled is None and got[c].assumption_flat is None
    assert got[b].missing_weight == 0.25 and got[b].assumption_loss50 == pytest.approx((0.4 - 0.5) / 4)
    with pytest.raises(Exception, match="under -100"):
        reports.scope_comparison(spark.createDataFrame(scope(a, [-1.5, 0.2, 0.3, 0.0, 0.5]), df.schema), "ret", (4,)).collect()


def test_overlap_tells_pairs_that_share_nothing(spark):
    rows = [(1, "A", "x"), (1, "B", "x"), (1, "A", "y"), (2, "A", "y"), (2, "B", "z")]
    got = {(r.a, r.b): (r.n_common, r.n_dates) for r in joins.holdings_overlap(spark.createDataFrame(rows, "date int, ticker string, model string")).collect()}
    assert got == {("x", "y"): (1, 1), ("x", "z"): (0, 0), ("y", "z"): (0, 0)}


def test_permutations_equal_a_plain_loop_and_are_drawn_in_the_tasks(spark):
    import hashlib

    rng = np.random.default_rng(8)
    rows = [(dt.date(2020, 1, 1 + d), f"S{i}", float(x), float(y)) for d in range(4) for i, (x, y) in enumerate(rng.random((1 if d == 3 else 23, 2)))]
    out = stats.permutation_null(spark.createDataFrame(rows, "date date, ticker string, x double, y double"), "x", "y", reps=30)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()  # no row is copied once for each replicate
    got, spreads, seen = out.first(), [[] for _ in range(30)], []
    for day in sorted({r[0] for r in rows})[:3]:  # a single name has no top
        own = sorted((r for r in rows if r[0] == day), key=lambda r: (r[2], r[1]))
        bucket = [max(1, int(np.ceil(k * 5 / (len(own) - 1)))) for k in range(len(own))]
        top, low = bucket.count(5), bucket.count(1)
        mean = lambda xs: sum(r[3] for r in xs) / len(xs)
        seen.append(mean(own[len(own) - top :]) - mean(own[:low]))
        for rep in range(30):
            mixed = sorted(own, key=lambda r: (hashlib.md5(f"42|{rep}|{day}|{r[1]}".encode()).hexdigest()[:8], r[1]))
            spreads[rep].append(mean(mixed[len(own) - top :]) - mean(mixed[:low]))
    observed = np.mean(seen)
    assert np.isclose(got.observed, observed) and got.reps == 30
    assert np.isclose(got.p, (sum(np.mean(s) >= observed for s in spreads) + 1) / 31)


@pytest.mark.parametrize(("function", "query"), [("training_scopes", "m4_training_scopes"), ("purged_cv", "m14_locked_ensemble"), ("risk_classifiers", "m12_risk_classifiers")])
def test_fits_read_rows_that_are_held(spark, sf, monkeypatch, function, query):
    from panelweave.plans import models

    class Seen(Exception):
        pass

    def stop(*args, **more):
        raise Seen(args[0])

    monkeypatch.setattr(models, function, stop)
    with pytest.raises(Seen) as e:
        Q.QUERIES[query](spark, sf)
    assert "lineitem" not in e.value.args[0]._jdf.queryExecution().toString()  # a fit's passes do not build the panel again
