"""What the findings of the rounds asked for."""

import datetime as dt
import hashlib
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelweave import queries, queries_models
from panelweave.llm import lm
from panelweave.operators import clusters, reports, sector_model, stats
from panelweave.plans import diagnostics, models, suites, trees


def test_equal_mean_percentiles_are_ordered_by_ticker(spark):
    n, c = 5120, 2012  # a size at which halves of the tenth digit occur, and float sums fall on both sides of them
    rows = [("d", "g", f"S{i}", (i * 77) % n + 1.0, (c - (i * 77) % n - 1) % n + 1.0) for i in range(n)]
    out = reports.rank_within(spark.createDataFrame(rows, "date string, state string, ticker string, a double, b double"), "state", ["a", "b"])
    places = {r["ticker"]: r["within_rank"] for r in out.collect()}
    expected = sorted(rows, key=lambda r: (r[3] + r[4], r[2]))
    assert places == {r[2]: k for k, r in enumerate(expected, 1)}


def test_a_missing_value_leaves_the_mean_unknown(spark):
    rows = spark.createDataFrame([("d", "g", "A", 2.0, 1.0), ("d", "g", "B", 1.0, 3.0), ("d", "g", "C", 3.0, 2.0), ("d", "g", "D", 0.0, None)], "date string, state string, ticker string, a double, b double")
    out = {r["ticker"]: (r["within"], r["within_rank"]) for r in reports.rank_within(rows, "state", ["a", "b"]).collect()}
    # percentiles: a A 3/4, B 2/4, C 4/4; b A 1/3, B 3/3, C 2/3
    assert [out[t][1] for t in "DABC"] == [1, 2, 3, 4] and out["D"][0] is None
    assert abs(out["A"][0] - (3 / 4 + 1 / 3) / 2) < 1e-9


def test_grams_are_shuffled_in_fewer_bytes_than_their_hashes(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a, b, c in rng.integers(0, 26, (400, 3))) for _ in range(300)]
    table, _ = lm.grams(pa.array(texts), 3)
    known, n = lm.known_grams(table)
    starts = lm.range_starts(known, 7)
    assert starts[0] == 0 and starts[-1] == len(known) and (np.diff(starts) > 0).all()
    steps = [lm.packed(np.diff(known[a:b], prepend=np.uint64(0))) for a, b in zip(starts, starts[1:])]
    assert np.array_equal(np.concatenate([np.cumsum(lm.unpacked(x)) for x in steps]), known)
    assert np.array_equal(lm.unpacked(lm.packed(n), np.int64), n)
    assert sum(map(len, steps)) < 8 * len(known)


def test_scores_do_not_hang_on_the_blocks(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join("ab cd ef gh ij kl".split()[k] for k in rng.integers(0, 6, int(m)))) for i, m in enumerate(rng.integers(0, 40, 60))], "doc_id long, text string")
    one, many = (sorted(lm.score(docs, block_chars=b).collect(), key=lambda r: r["doc_id"]) for b in (10_000_000, 50))
    assert [r[:3] for r in one] == [r[:3] for r in many]
    assert all((a["lm_score"] is None and b["lm_score"] is None) or abs(a["lm_score"] - b["lm_score"]) < 1e-9 for a, b in zip(one, many, strict=True))


def test_bundles_hold_every_text_of_a_block():
    rows = pa.table({"id": pa.array([1, 2, None, 4, 2]), "text": ["a b", "", "c", "é" * 50, "d"], "block": pa.array([3, 1, 3, 0, 1])})
    found = pa.Table.from_batches([lm.bundles(rows)])
    assert found.column("block").to_pylist() == [0, 1, 3]
    got = [lm.unbundled(found.slice(k, 1)).to_pydict() for k in range(3)]
    assert got == [{"id": [4], "text": ["é" * 50]}, {"id": [2, 2], "text": ["", "d"]}, {"id": [1, None], "text": ["a b", "c"]}]
    assert lm.bundles(rows.slice(0, 0)).num_rows == 0


def test_the_diagnosis_reads_what_is_held(spark, sf, monkeypatch):
    class Seen(Exception):
        pass

    def stop(*tables, **more):
        raise Seen(tables[:3])

    monkeypatch.setattr(diagnostics, "diagnose", stop)
    with pytest.raises(Seen) as e:
        queries_models.diagnosis(spark, sf)
    for table in e.value.args[0]:
        assert "lineitem" not in table._jdf.queryExecution().toString()  # its passes do not build the panel again


def test_the_diagnosis_takes_held_scores_and_prices_sessions_only_where_asked(spark, sf, monkeypatch):
    def stop(*tables, **more):
        raise AssertionError("sessions are priced")

    diagnose = diagnostics.diagnose

    def seen(predictions, prices, *tables, **more):
        for table in (predictions, prices):
            plan = table._jdf.queryExecution().toString()
            assert "Window" not in plan and "Join" not in plan
        return diagnose(predictions, prices, *tables, **more)

    monkeypatch.setattr(diagnostics, "_daily", stop)
    monkeypatch.setattr(diagnostics, "diagnose", seen)
    assert queries_models.b15_sector_summary(spark, sf).count() == 10
    with pytest.raises(AssertionError, match="priced"):
        queries_models.b15_daily_portfolio(spark, sf)


def test_past_folds_are_fitted_beside_the_cases_from_needed_columns(spark, monkeypatch):
    calls, both = [], threading.Barrier(2, timeout=60)

    class Seen(Exception):
        pass

    def run(rows, folds, cases, every=5):
        calls.append(len(folds))
        both.wait()  # a run after the other would wait here for ever
        raise Seen

    monkeypatch.setattr(suites, "run_cases", run)
    rows = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(Seen):
        suites.controlled(rows, [(1, None), (2, None)], [(1, None)], [suites.Case("base", ("x",), None)], None, None)
    assert sorted(calls) == [1, 2]


class Counted:
    """A table that counts how often it is passed over."""

    def __init__(self, df):
        self.df, self.passes = df, 0

    def mapInArrow(self, *args):
        self.passes += 1
        return self.df.mapInArrow(*args)


def test_a_walk_passes_over_all_points_less_often_than_it_steps(spark):
    rng = np.random.default_rng(8)
    x = [np.round(rng.random((n, 2)), 10) for n in (3000, 500)]
    seeds = [np.argsort(np.argsort(z.sum(axis=1))) * 4 // len(z) for z in x]
    block = lambda g, z, s: (np.full(len(z), g, np.int32).tobytes(), z.tobytes(), np.c_[s, s * 0].astype(np.int32).tobytes())
    halves = [block(g, z[a:b], s[a:b]) for g, (z, s) in enumerate(zip(x, seeds, strict=True)) for a, b in ((0, len(z) // 2), (len(z) // 2, len(z)))]
    held = Counted(spark.createDataFrame([tuple(map(bytearray, h)) for h in halves], "g binary, zs binary, seeds binary").repartition(2).persist())
    centres, moving = clusters._walk_few(held, 2, 2, 4, 300, (0, 2))
    steps = 0
    for z, s, found in zip(x, seeds, centres, strict=True):
        want, moved = clusters.settled(z, s, 4, 300)
        assert not moved and np.allclose(found, want, rtol=0, atol=1e-8)
        steps = max(steps, next(i for i in range(300) if not clusters.settled(z, s, 4, i + 1)[1]))
    assert not moving.any() and steps > 20 and held.passes <= 2 * steps / 3
    held.df.unpersist()


def test_the_choice_of_k_scales_and_seeds_once(spark, monkeypatch):
    calls, plain = [], sector_model.exact_quantiles
    monkeypatch.setattr(sector_model, "exact_quantiles", lambda rows, columns, *a: calls.append(columns) or plain(rows, columns, *a))
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"T{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.random((200, 2)))], "ticker string, x double, y double")
    table = sector_model.choose_k(rows, ["x", "y"], ["ticker"], (2, 3, 5), sample=50).toPandas().set_index("k")
    assert len(calls) == 2  # the scale, and the seeds of all k
    for k in (2, 3, 5):
        model = sector_model.fit(rows.withColumn("g", F.lit("all")), ["x", "y"], "g", k)
        alone = sector_model.assign(rows.withColumn("g", F.lit("all")), model, ["x", "y"], "g").agg(F.sum("gap")).first()[0]
        assert np.isclose(table.inertia[k], alone) and table.n_rows[k] == 200


def test_a_horizon_fits_from_the_rows_of_its_training_dates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=31 * i) for i in range(30)]
    rows = [(h, days[i], f"T{t}", "A" if t % 2 else "B", bool(t % 3), True, days[i + 1], days[i + 1 + h], days[i + 1 + h], float(a), float(b), float(a), float(b), 1.0) for h in (2, 3) for i in range(26) for t in range(30) for a, b in [rng.normal(size=2)]]
    names = "horizon int, date date, ticker string, sector string, stable boolean, eligible boolean, entry_date date, exit_date date, available_at date, target_simple double, target_excess double, x double, vol double, unused double"
    folds = spark.createDataFrame([(h, f, days[20 + 2 * f]) for h in (2, 3) for f in (1, 2)], "horizon int, fold int, day date")
    seen, plain = {}, suites.fit_predict

    def fit(train, test, features, target, estimator):
        seen[test.select("horizon", "fold").first(), train.filter("not stable").isEmpty()] = (train.columns, {r["date"] for r in train.select("date").distinct().collect()}, "InMemoryRelation" in train._jdf.queryExecution().withCachedData().toString())
        return plain(train, test, features, target, estimator)

    monkeypatch.setattr(suites, "fit_predict", fit)
    calendar = spark.createDataFrame([(d, i + 1, 1.0) for i, d in enumerate(days)], "date date, session_no int, m_close double")
    prices = spark.createDataFrame([(f"T{t}", d, 1.0 + t) for t in range(30) for d in days], "ticker string, date date, close double")
    suites.horizon_suite(spark.createDataFrame(rows, names), folds, prices, calendar, {2: ["x"], 3: ["x", "vol"]}, models.elastic_net, n=3, every=5)
    assert len(seen) == 8
    for ((h, fold), _), (columns, dates, held) in seen.items():
        known = [d for i, d in enumerate(days[:26]) if days[i + 1 + h] < days[20 + 2 * fold]]
        assert held and dates == set(known[::5]) and set(columns) == {"date", "stable", "target_excess", "x"} | ({"vol"} if h == 3 else set())


def test_tallies_equal_plain_counts():
    texts = pa.array(["a b a b a", "", None, "b a b c", "x", "a b a b a"])
    keys, of = lm.grams(texts, 3)
    known, n, at, own = lm.tallied(keys, of)
    flat = [(int(g), int(d)) for key in keys for g, d in zip(key, of, strict=True) if g]
    everywhere, inside = Counter(g for g, _ in flat), Counter(flat)
    assert dict(zip(known.tolist(), n.tolist(), strict=True)) == everywhere and (np.diff(known) > 0).all()
    for key, place, count in zip(keys, at, own, strict=True):
        real = key > 0
        assert (known[place[real]] == key[real]).all()
        assert count[real].tolist() == [inside[int(g), int(d)] for g, d in zip(key[real], of[real], strict=True)]
    empty = lm.tallied(*lm.grams(pa.array([None, "..."], pa.string()), 2))
    assert [x.size for x in empty] == [0, 0, 0, 0] and empty[2].shape[0] == 2


class Stop(Exception):
    pass


def test_the_refit_and_the_walk_fit_from_held_rows_of_needed_columns(spark, sf, monkeypatch):
    seen = []

    def stop(train, test, features, *args):
        seen.extend((set(x.columns), x._jdf.queryExecution().analyzed().toString()) for x in (train, test))
        raise Stop

    monkeypatch.setattr(models, "sector_refit", stop)
    with pytest.raises(Stop):
        queries.QUERIES["m12_sector_refit"](spark, sf)
    monkeypatch.setattr(models, "fit_predict", stop)
    with pytest.raises(Stop):
        queries.QUERIES["m5_walk_forward"](spark, sf)
    assert len(seen) >= 4
    for columns, plan in seen:
        assert "parquet" not in plan.lower() and not columns & {"volume", "m_close", "close", "r"}


def test_workers_give_back_what_they_freed(monkeypatch):
    from panelweave.llm import common

    collected = []
    monkeypatch.setattr(common.gc, "collect", lambda: collected.append(1))
    run = common.freeing(lambda batches: (b * 2 for b in batches))([1, 2])
    assert next(run) == 2 and not collected
    assert [*run] == [4] and collected


def test_numbers_drawn_side_by_side_are_those_of_md5():
    names = ["", "S1", "S22", "é€x", "a" * 30, "b" * 41, "c" * 80, *(f"S{i}" for i in range(700))]
    for prefixes in (["42|1|1995-01-01|", "42|7|1995-01-01|"], ["42|100|1995-01-01|"], [""], ["x" * 55], ["y" * 70]):
        got = stats.drawn_numbers([p.encode() for p in prefixes], [n.encode() for n in names])
        assert got.tolist() == [[int(hashlib.md5((p + n).encode()).hexdigest()[:8], 16) for n in names] for p in prefixes]
    place, t = np.array([5, 1, 5, 1, 9, 5], np.uint32), np.arange(6.0)
    assert stats.end_means(place, t, 3, 2) == (4 + 5) / 2 - (0 + 1 + 3) / 3
    assert stats.end_means(place, t, 1, 4) == (0 + 2 + 4 + 5) / 4 - 1 and stats.end_means(place, t, 0, 2) is None


def test_permutations_read_held_bars_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(stats, "permutation_null", lambda df, *a, **k: seen.append(df) or df.limit(0).selectExpr("1.0D observed", "1.0D p", "1L reps"))
    queries.QUERIES["e12_permutation"](spark, sf)
    assert "lineitem" not in seen[0]._jdf.queryExecution().toString()
    monkeypatch.undo()
    plan = stats.permutation_null(seen[0], "mom6", "target_excess", reps=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("s_suppkey#") and plan.count("parquet") == 3, plan  # supplier, nation and region, once each


def grid_rows(spark, n=1500):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] * (x[:, 2] > 5) + rng.normal(size=n)
    return spark.createDataFrame([(*map(float, r), float(a), float(a > 1.2)) for r, a in zip(x, y, strict=True)], "a double, b double, c double, y double, risky double").persist()


@pytest.mark.parametrize("few", [trees.FEW, 10])
def test_boosting_over_cells_is_spark_mls(spark, few, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 100)
    rows = grid_rows(spark)
    for estimator, label in ((models.boosted(maxIter=6), "y"), (GBTClassifier(maxIter=6, maxDepth=5, seed=42), "risky")):
        full = rows.select("a", "b", "c", F.col(label).alias("label"))
        plain = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), estimator]).fit(full).transform(full).toPandas()
        got = trees.fit(full, ["a", "b", "c"], estimator, few)[0].scored(full).toPandas()
        assert np.allclose(got.prediction, plain.prediction, atol=1e-9)
        if label == "risky":
            off = np.abs(np.array([p[1] for p in got.probability]) - [p[1] for p in plain.probability])
            assert off.mean() < (1e-9 if few == trees.FEW else 1e-4)  # blocks add up in another order, so that splits of equal gain may change places
    rows.unpersist()


@pytest.mark.parametrize("few", [trees.FEW, 10])
def test_a_forest_over_cells_is_near_spark_mls(spark, few):
    rows = grid_rows(spark)
    full, estimator = rows.select("a", "b", "c", F.col("risky").alias("label")), RandomForestClassifier(numTrees=40, maxDepth=4, minInstancesPerNode=10, seed=42)
    plain = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), estimator]).fit(full).transform(full).toPandas()
    first, again = (trees.fit(full, ["a", "b", "c"], estimator, few)[0].scored(full).toPandas() for _ in range(2))
    share = lambda t: np.array([p[1] for p in t.probability])
    assert np.abs(share(first) - share(plain)).mean() < 0.03 and np.array_equal(share(first), share(again))
    assert (first.prediction == (share(first) > 0.5)).all()
    rows.unpersist()


def test_a_boosted_fit_takes_few_jobs_and_other_rules_stay_with_spark(spark):
    rows = grid_rows(spark)
    group = "boosted fit of the test"
    together = models.together(spark, {group: lambda: clusters.cut(models.fit_predict(rows, rows, ["a", "b", "c"], "y", models.boosted()))})
    assert together[group].count() == 1500
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40  # not one for every level of 100 trees
    assert trees.covers(models.boosted()) and not trees.covers(models.boosted(subsamplingRate=0.5)) and not trees.covers(RandomForestClassifier(impurity="entropy")) and not trees.covers(models.elastic_net())
    rows.unpersist()


def test_bounds_of_bins_count_every_row(spark, monkeypatch):
    monkeypatch.setattr(trees, "POINTS", 400)
    values = np.random.default_rng(3).normal(size=30_000) ** 3
    rows = spark.createDataFrame([(float(x), 1.0) for x in values], "x double, one double").repartition(3)
    (x, one), n = trees.bounds_of(rows, ["x", "one"])
    assert n == 30_000 and one.tolist() == [1.0] and len(x) == trees.BINS - 1 and x[0] == values.min()
    assert np.allclose([(values <= b).mean() for b in x[1:]], [i / 31 for i in range(1, 31)], atol=0.01)
    bounds, n = trees.bounds_of(rows.filter("x > 1e9"), ["x", "one"])
    assert n == 0 and [len(b) for b in bounds] == [0, 0]


@pytest.mark.parametrize(("query", "function"), [("m8_macro_suite", "run_cases"), ("m7_controlled_models", "controlled"), ("m12_risk_classifiers", "risk_classifiers")])
def test_suites_build_bars_and_calendar_once(spark, sf, monkeypatch, query, function):
    calls = Counter()
    for name in ("monthly_bars", "market"):
        plain = getattr(queries.A, name)
        monkeypatch.setattr(queries.A, name, lambda *a, n=name, f=plain: calls.update([n]) or f(*a))

    def stop(rows, *args, **more):
        assert "lineitem" not in rows._jdf.queryExecution().toString()
        raise Stop

    monkeypatch.setattr(models if query == "m12_risk_classifiers" else suites, function, stop)
    with pytest.raises(Stop):
        queries.QUERIES[query](spark, sf)
    assert calls == {"monthly_bars": 1, "market": 1}
