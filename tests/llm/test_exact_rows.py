"""Near copies under shared ids, and searches over components of any size: nothing is lost, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import dedup, mixing, topk


def brute_rows(rows, words, share):
    """(n, component) of every row: rows of equal or similar sets are linked, whatever their ids; a component has its smallest id."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(sets[a]), least.get(root(a), i) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def components(spark, rows, words=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("id", F.lit("x")).repartition(4)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in dedup.group(df, words=words, share=80).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_a_text_of_two_ids_is_judged_by_its_own_set(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    near = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (2, b), (3, near)]
    assert components(spark, rows) == [(1, 37, 1), (1, 37, 1), (2, 37, 1), (3, 37, 1)]
    assert components(spark, [(5, a), (5, b), (7, near), (9, a + " more")]) == [(5, 37, 5), (5, 37, 5), (7, 37, 5), (9, 38, 5)]


def test_near_copies_with_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 50)]
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for k in rng.integers(0, 50, int(rng.integers(0, 4))):
                own[k] = f"v{rng.integers(0, 4000)}"
            rows.append((int(rng.integers(0, 15)) if rng.random() < 0.9 else None, " ".join(own)))
    rows += [(3, None), (3, ""), (None, ""), rows[0], rows[1]]
    key = lambda r: tuple((x is None, x) for x in r)
    assert components(spark, rows) == sorted(brute_rows(rows, 4, 80), key=key)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_search_over_components_of_any_size(spark, scale):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in (rng.normal(size=3) * (scale if i % 3 else 1.0))]) for i in range(60)]
    vectors += [(1, [1e6, 1.0, 0.0]), (7, [-1e300, 2.0, 1.0]), (50, [0.0, 0.0, 0.0])]
    got = topk.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), is_query=F.col("vec_id") % 50 == 0, k=5, block=16).collect()
    import math

    whole = [(i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in vectors]
    want = []
    for a, (q, v) in enumerate(whole):
        if q % 50 == 0:
            found = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(whole) if b != a))[:5]
            want += [(q, k, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i) in enumerate(found, 1)]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=order) == sorted(want, key=order)


def test_sortable_bytes_sort_as_integers():
    rng = np.random.default_rng(6)
    numbers = [0, 1, -1, 127, 128, -128, -129, 2**63, -(2**63), 10**200, -(10**200), *(int(x) for x in rng.integers(-(10**6), 10**6, 300))]
    assert sorted(numbers) == sorted(numbers, key=topk.sortable)


@pytest.mark.parametrize(("least", "kw"), [(1.0, {"power": 0.8}), (0.0, {"targets": {"en": 0.42, "de": 0.18, "fr": 0.18, "es": 0.14, "junk": 0.08}}), (0.0, {"targets": {"de": 0.5, "junk": 0.5}})])
def test_mixing_rates_are_the_nearest_that_meet_the_targets(spark, sf, least, kw, recwarn):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, mixing.domains_of(docs, labels), least=least, **kw).toPandas()
    got = got[got.n_tokens > 0]
    names = [c for c in got.columns if c.startswith("p_")]
    p, r, n = got[names].to_numpy(), got.rate.to_numpy(), got.n_tokens.to_numpy(float)
    have = (n[:, None] * p).sum(axis=0)
    weight = np.array([kw["targets"].get(c[2:], 0.0) for c in names]) if "targets" in kw else have**0.8
    weight = weight / weight.sum()
    want = weight * max(have.sum(), least * (have[weight > 0] / weight[weight > 0]).max())
    assert np.abs(((r * n)[:, None] * p).sum(axis=0) - want).max() <= 1e-3 * want.sum() and r.min() >= least
    # conditions of the least squares over tokens: inside, the way from the start is a combination of memberships; at the bound it points out
    inside = r > least + 1e-9
    owed = np.linalg.lstsq(p[inside], 1.0 - r[inside], rcond=None)[0]
    assert np.abs(p[inside] @ owed - (1.0 - r[inside])).max() < 1e-6
    assert (1.0 - p[~inside] @ owed <= least + 1e-6).all()
    assert not [w for w in recwarn if "missed" in str(w.message)]
