"""Audits on small tables, against plain arithmetic."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from panelweave.operators import audits
from panelweave.plans import models
from panelweave.sources import bars as S

DAY = dt.date(2024, 1, 1)
LABEL = "date date, ticker string, security_id int, entry_date date, exit_date date, log_return double, log_market double"
BARS = "date date, ticker string, open double, high double, low double, close double, volume long"


def day(n):
    return DAY + dt.timedelta(n)


def test_contract_names_what_is_wrong(spark):
    rows = [(day(0), "A", 1.0, 1.0, 1.0, 1.0, 5), (day(0), "A", 1.0, 1.0, 1.0, 1.0, 5), (None, None, 1.0, 1.0, 1.0, 0.0, None), (day(1), "Z", 1.0, 1.0, 1.0, None, 3)]
    table = spark.createDataFrame(rows, BARS).withColumn("Volatility", F.lit(1.0))
    universe = spark.createDataFrame([("a",), ("b.c",)], "ticker string")
    failed = spark.createDataFrame([("Q", 0), ("A", 2)], "ticker string, n_rows_final int")
    coverage = spark.createDataFrame([("A", 3, True)], "ticker string, n_rows int, short_history boolean")
    got = {r.rule: (r.n, r["sample"]) for r in audits.dataset_contract(table, universe, failed, coverage).collect()}
    want = {
        "duplicate_key": (1, "A"), "null_date": (1, ""), "null_ticker": (1, ""), "null_volume": (1, ""), "null_close": (1, "Z"), "close_not_positive": (1, ""), "outside_universe": (1, "Z"), "failed_outside_universe": (1, "Q"),
        "failed_but_present": (1, "A"), "unaccounted_ticker": (1, "B-C"), "coverage_set": (1, "Z"), "coverage_rows": (2, "A,Z"), "failed_with_rows": (1, "A"), "short_history": (1, "A"), "derived_column": (1, "Volatility"),
    }
    assert {k: v for k, v in got.items() if v[0]} == want
    none = {r.rule: r.n for r in audits.dataset_contract(table.drop("Volatility").limit(0), universe, failed.limit(0), coverage.limit(0)).collect()}
    assert none.pop("unaccounted_ticker") == 2 and not any(none.values())
    with pytest.raises(ValueError, match="volume"):
        audits.dataset_contract(table.drop("volume"), universe, failed, coverage)


def labels_of(spark):
    gone = float(np.log(0.5))
    rows = [(day(i), t, s, day(i + 1), day(i + 3) if i < 4 else None, 0.1 if t != "C" else None, 0.02) for t in "ABCD" for i, s in enumerate([1, 1, 1, 1, 1 if t != "B" else 2])]
    return spark.createDataFrame(rows + [(day(9), "D", None, day(4), day(4), gone, 0.0)], LABEL)


def test_labels_without_identity_have_no_return(spark):
    unclear = spark.createDataFrame([("D", day(5))], "ticker string, since date")
    got = {(r.ticker, (r.date - DAY).days): r for r in audits.settled_labels(labels_of(spark), unclear)[0].collect()}
    assert got["A", 0].label_status == "observed" and abs(got["A", 0].simple_return - np.expm1(0.1)) < 1e-12 and abs(got["A", 0].target_excess - (np.expm1(0.1) - np.expm1(0.02))) < 1e-12
    assert got["A", 4].label_status == "unmatured" and got["C", 0].label_status == "missing_price"
    # the exit of row 1 of B is row 4, another security; the exits of rows 2 and 3 have no row, so no identity
    assert [got["B", i].label_status for i in range(4)] == ["observed"] + ["security_or_venue_unresolved"] * 3
    assert got["D", 1].label_status == "observed" and got["D", 2].label_status == "security_or_venue_unresolved" and got["D", 2].target_excess is None
    assert got["D", 9].label_status == "security_or_venue_unresolved" and got["D", 9].log_return is None
    bare = audits.settled_labels(labels_of(spark).withColumn("security_id", F.lit(None).cast("int")))[0]
    assert bare.filter("label_status = 'security_or_venue_unresolved'").count() == 0


def test_settlements_fill_only_what_they_may(spark):
    give = lambda i, t, r=-1.0, exit_=None, known=9, ok=True, source="filing": (day(i), t, day(i + 1), day(i + 3) if exit_ is None else exit_, r, day(known), ok, source)
    rows = [give(0, "C"), give(1, "C", -1.5), give(2, "C", known=3), give(3, "C", ok=False), give(0, "A", 0.3), give(1, "A", float(np.expm1(0.1))), give(0, "B", exit_=day(8)), give(0, "X"), give(1, "D"), give(1, "D"), give(3, "A", None)]
    table = spark.createDataFrame(rows, "date date, ticker string, entry_date date, exit_date date, simple_return double, available_at date, verified boolean, source string")
    out, refused = audits.settled_labels(labels_of(spark), None, table)
    got = {(r.ticker, (r.date - DAY).days): r for r in out.collect()}
    assert len(got) == labels_of(spark).count()
    total = got["C", 0]
    assert (total.label_status, total.simple_return, total.log_return, total.label_available_at, total.settlement_source) == ("verified_settlement", -1.0, None, day(9), "filing")
    assert abs(total.target_excess + np.exp(0.02)) < 1e-12 and got["A", 1].label_status == "verified_settlement" and got["A", 0].label_status == "observed" and got["C", 1].simple_return is None
    why = sorted((r.ticker, (r.date - DAY).days, r.reason) for r in refused.collect())
    assert why == [("A", 0, "contradicts_observed"), ("A", 3, "missing_value"), ("B", 0, "other_dates"), ("C", 1, "impossible_return"), ("C", 2, "known_before_exit"), ("C", 3, "not_verified"), ("D", 1, "repeated_key"), ("D", 1, "repeated_key"), ("X", 0, "no_row")]


def plain_incremental(part, controls, sector, least):
    part = part.dropna(subset=["pred", *controls])
    if len(part) < least:
        return None
    x = np.column_stack([part[c].rank(pct=True) for c in controls])
    if sector:
        x = np.column_stack([x, pd.get_dummies(part.sector, drop_first=True, dtype=float)])
    x = np.column_stack([np.ones(len(part)), x])
    known = part.target.notna().to_numpy()
    x, part = x[known], part[known]
    if len(part) < max(least, x.shape[1] + 5):
        return None
    p, y = part.pred.rank().to_numpy(), part.target.rank().to_numpy()
    rest = lambda v: v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    return np.corrcoef(p, y)[0, 1], np.corrcoef(rest(p), rest(y))[0, 1], np.corrcoef(part.a.rank(), y)[0, 1]


@pytest.mark.parametrize("sector", [None, "sector"])
def test_incremental_ic_equals_residuals(spark, sector):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame([(day(d), f"T{i}", "xyz"[i % 3], *rng.normal(size=4).round(1)) for d in range(4) for i in range(40 if d else 15)], columns=["date", "ticker", "sector", "pred", "a", "b", "target"])
    frame["target"] += frame.pred + frame.a
    frame["c"] = (frame.a + rng.normal(size=len(frame))).round(2)
    frame.loc[rng.choice(len(frame), 12, replace=False), "target"] = np.nan
    frame.loc[rng.choice(len(frame), 5, replace=False), "b"] = np.nan
    table = spark.createDataFrame(frame).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("target", "b")})
    got = {r.date: r for r in audits.incremental_ic(table, "pred", "target", ["a", "b", "c"], sector=sector, momentum="a").collect()}
    want = {d: plain_incremental(g, ["a", "b", "c"], sector, 20) for d, g in frame.groupby("date")}
    assert set(got) == {d for d, v in want.items() if v} and len(got) == 3
    for d, r in got.items():
        assert np.allclose((r.raw_ic, r.incremental_ic, r.momentum_ic), want[d]) and r.n_candidates == 40
    alone = audits.incremental_ic(table.filter("target is not null"), "a", "target", ["a", "b"]).collect()
    assert alone and all(r.incremental_ic is None for r in alone)


def test_normal_pairs_touch_no_shock(spark):
    # ten decision dates, two apart; the states of T1 and T2 change in the shock alone
    rows = [(t, day(2 * i), "low" if i >= 5 and t != "T0" else "high") for i in range(10) for t in ("T0", "T1", "T2", "T3")]
    shock = spark.createDataFrame([("s", day(9), day(10), day(8), day(12)), ("none", day(1), day(1), day(1), day(2))], "shock string, start date, end date, anchor_date date, comparison_date date")
    got = audits.shock_retention(spark.createDataFrame(rows, "ticker string, date date, state string"), shock, "low").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.state, r.n, r.step_gap, r.retention_pct, r.to_worst_pct, r.normal_retention_mean) == ("high", 4, 2, 25.0, 75.0, 100.0)
    # pairs two steps apart that lie wholly before day 1, between it and day 9, or after day 10, for names of the state `high`
    assert r.normal_pairs == sum(not (a <= 10 and b >= 9) and not (a <= 1 and b >= 1) for i in range(8) for a, b in [(2 * i, 2 * i + 4)]) and r.retention_delta_pp == -75.0


def test_planned_size_and_ranges(spark):
    assert audits.planned_size(0.15) == 43 and audits.planned_size(0.05) == 385
    rows = spark.createDataFrame([(i, float(i), None if i == 1 else -float(i)) for i in range(1, 8)], "session_no int, v double, b double")
    got = {r.interval: r for r in audits.range_audit(rows, [1, 3], {5: {"vol": "v", "beta": "b"}}).collect()}
    assert (got[3].vol_min, got[3].vol_median, got[3].vol_max, got[3].beta_min, got[3].beta_max) == (1.0, 4.0, 7.0, -7.0, -4.0) and got[1].vol_median == 4.0


def test_sector_refit_finds_what_the_whole_cannot(spark):
    # the sign of x turns between the sectors, so one model of all rows knows nothing
    rng = np.random.default_rng(5)
    rows = [(s, float(x), bool((x > 0) == (s == "A"))) for s in ("A", "B", "UNKNOWN") for x in rng.normal(size=120)] + [("C", 1.0, True)] * 60 + [("D", 1.0, False)] * 3
    table = spark.createDataFrame(rows, "sector string, x double, risky boolean")
    got = {r.sector: r for r in models.sector_refit(table, table, ["x"], "risky", lambda: LogisticRegression(maxIter=50, regParam=0.01)).collect()}
    assert set(got) == {"A", "B"}
    for r in got.values():
        assert r.sector_refit_recall > 0.9 and r.sector_pr_auc > 0.95 and r.status == "CONFIRMATORY" and abs(r.delta_recall - (r.sector_refit_recall - r.global_recall)) < 1e-12
        n, more = r.discordant_pairs, round(r.delta_recall * r.actual_risky_n)
        tail = sum(math.comb(n, i) for i in range((n - abs(more)) // 2 + 1)) / 2**n
        assert r.paired_exact_p is None if n == 0 else abs(r.paired_exact_p - min(1.0, 2 * tail)) < 1e-9
    assert max(r.discordant_pairs for r in got.values()) > 0


def test_scans_and_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(day(i), "A", float(i)) for i in (0, 1, 400)], "date date, ticker string, close double")
    S.write_tables({"a": rows, "b": rows.limit(0)}, str(tmp_path / "run"))
    read = S.scan_csv(spark, str(tmp_path / "run" / "a"), "date date, ticker string, close double")
    assert sorted(read.collect()) == sorted(rows.collect()) and S.scan_csv(spark, str(tmp_path / "run" / "b"), "date date").count() == 0
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        S.write_tables({"a": rows}, str(tmp_path / "run"), kind="parquet")
    S.write_features(rows, str(tmp_path / "features"))
    back = spark.read.parquet(str(tmp_path / "features"))
    assert sorted((r.date, r.close, r.year) for r in back.collect()) == [(day(0), 0.0, 2024), (day(1), 1.0, 2024), (day(400), 400.0, 2025)]
    assert "PartitionFilters: [isnotnull(year" in back.filter("year = 2025")._jdf.queryExecution().toString()
    assert S.scan_parquet(spark, str(tmp_path / "features"), ["ticker", "close"]).columns == ["ticker", "close"]
