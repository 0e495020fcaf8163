"""Statistics of every prefix against the plain computation on each prefix, and results that no order of rows may change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import numeric as Q
from siftwell.operators import evaluate as E
from siftwell.operators import scorers as S


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i, s, "m", None if rng.random() < 0.05 else float(np.round(rng.normal(k * 0.4, 1), 1))) for i in range(60) for k, s in enumerate("abcd")]
    return spark.createDataFrame(rows, "item_id long, pos long, system string, metric string, value double").cache()


def test_running_signed_ranks_against_every_prefix():
    rng = np.random.default_rng(0)
    for _ in range(20):
        d = np.round(rng.normal(0.1, 1, 45), 1)
        d[rng.random(45) < 0.1] = np.nan
        n, z = Q.running_signed_ranks(d)
        for k in range(1, 46):
            x = d[:k][~np.isnan(d[:k])]
            x = x[x != 0]
            assert n[k - 1] == len(x)
            size = np.abs(x)
            ties = np.unique(size, return_counts=True)[1]
            spread = len(x) * (len(x) + 1) * (2 * len(x) + 1) / 24 - (ties**3 - ties).sum() / 48
            if len(x) and spread > 0:
                want = (Q.average_ranks(size)[x > 0].sum() - len(x) * (len(x) + 1) / 4) / np.sqrt(spread)
                assert abs(z[k - 1] - want) < 1e-9
            else:
                assert np.isnan(z[k - 1])
    assert [x.tolist() for x in Q.running_signed_ranks(np.zeros(0))] == [[], []]
    n, z = Q.running_signed_ranks(np.array([-1.0, -2, -3, -4, -5, -6, 7, -8]))
    assert n[-1] == 8 and round(Q.normal_cdf(z[-1]), 6) == 0.061743


def test_clusters_of_every_prefix(spark, noise):
    ranked = E.seeded_ranks(noise, [3, 4])
    got = {(r["seed"], r["k"]): r["clusters"] for r in E.clusters_every_prefix(noise, ranked, "m", ("seed",)).collect()}
    assert len(got) == 120
    for k in (1, 2, 3, 5, 20, 60):
        part = noise.join(ranked.where(F.col("rank") <= k).select("seed", "item_id"), "item_id")
        assert {r["seed"]: r["clusters"] for r in E.cluster_count(part, "m", ("seed",)).collect()} == {s: got[s, k] for s in (3, 4)}
    same = spark.createDataFrame([(i, i, s, "m", float(i)) for i in range(4) for s in "AB"], "item_id long, pos long, system string, metric string, value double")
    order = same.select("item_id", (F.col("pos") + 1).alias("rank")).distinct()
    assert [r["clusters"] for r in E.clusters_every_prefix(same, order, "m").orderBy("k").collect()] == [1, 1, 2, 2]
    assert [r["clusters"] for r in E.clusters_every_prefix(same, order, "m", equal_splits=False).orderBy("k").collect()] == [1, 1, 1, 1]
    assert E.clusters_every_prefix(same.limit(0), order, "m").count() == 0


def test_spa_of_every_prefix_is_the_curve(spark, noise, monkeypatch):
    ranked = E.rank_items(S.metric_var(noise, "m"))
    points = spark.createDataFrame([(k / 60, k) for k in (1, 2, 6, 7, 8, 15, 60)], "prop double, k long")
    curve = {round(r["prop"] * 60): round(r["spa"], 9) for r in E.spa_curve(noise, ranked, "m", points, 200).collect()}
    whole = {r["k"]: round(r["spa"], 9) for r in E.spa_every_prefix(noise, ranked, "m", 200).collect()}
    monkeypatch.setattr(E, "STRETCH_RANKS", 7)
    cut = {r["k"]: round(r["spa"], 9) for r in E.spa_every_prefix(noise, ranked, "m", 200).collect()}
    assert whole == cut and len(whole) == 60
    assert curve == {k: whole[k] for k in curve}


def test_spa_of_prefixes_fixed_values(spark):
    """Two systems with constant differences: p is the share of sign flips that reach the full difference, which can be counted."""
    rows = [(i, i, s, "m", v) for i in range(3) for s, v in (("a", 1.0), ("b", 0.0))]
    df = spark.createDataFrame(rows, "item_id long, pos long, system string, metric string, value double")
    order = df.select("item_id", (F.col("pos") + 1).alias("rank")).distinct()
    n = 512
    new, old = E.sign_rows(0, ["0", "1", "2"], n), E.sign_rows(1, ["0", "1", "2"], n)
    want = [1 - abs((new[:k].sum(0) >= k).mean() - (old.sum(0) >= 3).mean()) for k in (1, 2, 3)]
    got = [r["spa"] for r in E.spa_every_prefix(df, order, "m", n).orderBy("k").collect()]
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("kind", ["correlation", "clusters", "spa"])
def test_row_order_and_partitions_change_no_baseline(spark, noise, kind):
    full = noise.fillna(0.0)
    want = None
    for seed, parts in ((1, 1), (2, 5)):
        mixed = full.orderBy(F.rand(seed)).repartition(parts)
        got = sorted((round(r["prop"], 2), round(r["target"], 9), round(r["random_parity"], 9)) for r in E.random_baseline(mixed, "m", kind, [0.1, 0.5], 3, 100).collect())
        want = want or got
        assert got == want


def test_targets_meet_values_that_differ_by_rounding(spark):
    """The same ten values added up in two orders give two averages; both must be reached by the value that they stand for."""
    values = [0.1 * i for i in range(10)]
    up, down = sum(values) / 10, sum(reversed(values)) / 10
    curve = spark.createDataFrame([(5, 0.45), (6, 0.46)], "k long, correlation double")
    for target in (up, down, 0.45 + 1e-13):
        goal = spark.createDataFrame([(0.5, target)], "prop double, target double")
        assert E.parity(curve, goal, 10).first()["k"] == 5


def test_correlation_of_tiny_scales(spark):
    rows = [(float(i), float((i * 7) % 5), 3.0) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    want = np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1]
    for scale in (1.0, 1e-9, 1e-30, 1e30):
        got = df.select((F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y")).agg(E.pearson("x", "y").alias("r")).first()["r"]
        assert abs(got - want) < 1e-9
    assert df.agg(E.pearson("x", "c").alias("r")).first()["r"] == 0
    assert spark.createDataFrame([(0.1 + 0.2, 1.0), (0.3, 2.0)], "x double, y double").agg(E.pearson("x", "y").alias("r")).first()["r"] == 0


def test_equal_means_keep_the_order_of_names(spark):
    rows = [(i, i, s, "m", v) for s, vs in (("a", (0.3, 0.2, 0.1)), ("b", (0.1, 0.2, 0.3))) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "item_id long, pos long, system string, metric string, value double")
    assert [r["system"] for r in E.model_ordering(df, "m").orderBy("ord").collect()] == ["a", "b"]
