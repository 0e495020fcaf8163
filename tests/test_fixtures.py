"""Hand-checked values for small inputs."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import columns as C
from siftwell.functions import numeric as Q
from siftwell.operators import evaluate as E
from siftwell.operators import experiments as X
from siftwell.operators import normalize as N
from siftwell.operators import scorers as S
from siftwell.operators import select as L
from siftwell.operators.ranking import bucketed, in_order
from siftwell.sources import items

VALUES = {"a": ([0.9, 0.5, 0.1], [90, 60, 20]), "b": ([0.8, 0.8, 0.2], [80, 70, 30]), "c": ([0.5, 0.5, 0.5], [50, 40, 60]), "d": ([0.1, 0.6, 0.7], [30, 65, 70])}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, p, s, m, float(v)) for p, (i, both) in enumerate(VALUES.items()) for m, vs in zip(("m", "human"), both, strict=True) for s, v in zip("ABC", vs, strict=True)]
    return spark.createDataFrame(rows, "item_id string, pos long, system string, metric string, value double").cache()


def by_item(df, column="utility"):
    return {r["item_id"]: round(r[column], 6) for r in df.collect()}


def one(df, column):
    return round(df.first()[column], 6)


def test_system_means(scores):
    got = {r["system"]: round(r["mean"], 6) for r in E.model_absolute(scores, "m").collect()}
    assert got == {"A": 0.575, "B": 0.6, "C": 0.375}
    assert [r["system"] for r in E.model_ordering(scores, "human").orderBy("ord").collect()] == ["A", "B", "C"]


def test_metric_scorers(scores):
    assert by_item(S.metric_avg(scores, "m")) == {"a": -0.5, "b": -0.6, "c": -0.5, "d": -0.466667}
    assert by_item(S.metric_var(scores, "m")) == {"a": 0.106667, "b": 0.08, "c": 0, "d": 0.068889}
    assert by_item(S.metric_cons(scores, "m")) == {"a": 0.333333, "b": 0.888889, "c": 0, "d": -0.333333}


def test_ranking_and_prefix(scores):
    ranked = E.rank_items(S.metric_var(scores, "m"))
    assert [r["item_id"] for r in ranked.orderBy("rank").collect()] == ["a", "b", "d", "c"]
    means = E.both_means(E.prefix(scores, ranked, 2), scores)
    assert {r["system"]: r["x"] for r in means.collect()} == {"A": 85, "B": 65, "C": 25}
    assert one(E.correlation(means), "correlation") == 1 and one(E.pairwise_accuracy(means), "accuracy") == 1
    assert one(E.error(means), "error") == 16.25 and one(E.error(means, "root"), "error") == 17.751174
    assert one(E.top_match(means), "top") == 1


def test_unknown_names_raise(scores):
    means = E.both_means(scores, scores)
    for bad in (lambda: E.correlation(means, "x"), lambda: E.error(means, "x"), lambda: L.basic({"scores": scores}, "x"), lambda: S.diversity("x", scores), lambda: S.combine([], "x")):
        with pytest.raises(ValueError):
            bad()


def test_metrics_correlations(scores):
    got = {r["metric"]: round(r["correlation"], 6) for r in E.metrics_correlations(scores).collect()}
    assert got == {"m": 0.95671, "human": 1}
    assert E.best_metric(scores).first()["metric"] == "m"


def test_clusters(scores):
    z = {r["ord"]: (r["w"], round(r["z"], 6)) for r in E.wilcoxon_z(E.neighbour_differences(scores), ["ord"]).collect()}
    assert z == {1: (4, -0.36823), 2: (3, -0.73646)}
    assert {r["cluster"] for r in E.clusters(scores).collect()} == {1}
    exact = {r["ord"]: r["p"] for r in E.clusters(scores, mode="exact").collect()}
    assert round(exact[1], 6) == 0.375 and round(exact[2], 6) == 0.25


def test_equal_systems_split_or_not(spark):
    rows = [(str(i), i, s, "human", float(i)) for i in range(5) for s in "AB"]
    df = spark.createDataFrame(rows, "item_id string, pos long, system string, metric string, value double")
    assert E.cluster_count(df).first()["clusters"] == 2
    assert E.cluster_count(df, equal_splits=False).first()["clusters"] == 1
    assert E.cluster_count(df.where("pos < 2")).first()["clusters"] == 1


def test_wilcoxon():
    d = np.array([-1, -2, -3, -4, -5, -6, 7, -8])
    assert round(Q.wilcoxon_less(d, "normal"), 6) == 0.061743 and round(Q.wilcoxon_less(d, "exact"), 6) == 0.074219
    assert Q.wilcoxon_less(np.zeros(4)) == 1


TEXTS = ["the cat sat", "the cat sat down", "a dog"]


def test_text_similarity():
    b = [Q.bleu_grams(t) for t in TEXTS]
    assert [round(Q.sentence_bleu(b[i], b[j]), 4) for i, j in ((0, 1), (1, 0), (0, 0), (0, 2))] == [71.6531, 59.4604, 100, 0]
    c = [Q.chrf_grams(t) for t in TEXTS]
    assert [round(Q.chrf(c[i], c[j]), 4) for i, j in ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))] == [66.0176, 88.5985, 5, 3.125, 18.1792, 9.1523]


def test_diversity(spark):
    df = spark.createDataFrame([("x", 0, s, t) for s, t in zip("ABC", TEXTS, strict=True)] + [("y", 1, "A", "alone")], "item_id string, pos long, system string, tgt string")
    assert by_item(S.diversity_unigram(df)) == {"x": -0.285714, "y": 0}
    assert by_item(S.diversity_bleu(df)) == {"x": -47.901499, "y": 0}
    assert by_item(S.diversity_chrf(df)) == {"x": -54.452524, "y": -100}
    empty = spark.createDataFrame([("z", 0, "A", ""), ("z", 0, "B", "a b")], "item_id string, pos long, system string, tgt string")
    assert by_item(S.diversity_unigram(empty)) == {"z": -1}


def test_costs(spark):
    items = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate((3, 10, 20))], "item_id long, src string")
    items = items.withColumn("cost", C.annotation_cost(F.col("src"), F.lit("en-de")))
    assert [round(r["cost"], 6) for r in items.orderBy("item_id").collect()] == [34.15, 35.2, 36.7]
    assert [round(r["cost"], 6) for r in N.cost_normalize(items).orderBy("item_id").collect()] == [0, 0.875, 2.125]


def test_budget(spark):
    items = spark.createDataFrame([(str(i), i, u, c) for i, (u, c) in enumerate(zip((0.9, 0.8, 0.5, 0.1), (4.0, 3.0, 1.0, 2.0), strict=True))], "item_id string, pos long, utility double, cost double")
    # two optima have a cost of exactly the budget; the strict rule drops the item that reaches it
    assert {r["item_id"] for r in L.costaware(items, 5.0, strict=False).collect()} in ({"0", "2"}, {"1", "3"})
    assert len(L.costaware(items, 5.0).collect()) == 1
    assert [r["item_id"] for r in L.costaware_greedy(items, 5.0).orderBy("rank").collect()] == ["2", "1"]


def test_knapsack_against_all_subsets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        u, c = rng.random(8), rng.integers(1, 9, 8).astype(float)
        best = max(sum(u[i] for i in range(8) if k >> i & 1) for k in range(256) if sum(c[i] for i in range(8) if k >> i & 1) <= 12)
        assert math.isclose(u[Q.knapsack(u, c, 12, 12)].sum(), best)


def test_knapsack_on_real_costs_at_every_size():
    rng = np.random.default_rng(1)
    for _ in range(20):
        u, c = rng.random(9), 34 + 3 * rng.random(9)
        c[:2] = 50.0004, 49.9996  # fit together only without rounding
        best = max(sum(u[i] for i in range(9) if k >> i & 1) for k in range(512) if sum(c[i] for i in range(9) if k >> i & 1) <= 100)
        got = Q.knapsack(u, c, 100)
        assert math.isclose(u[got].sum(), best) and c[got].sum() <= 100 + 1e-9
    # more rows than the former table held: the densest item keeps the best pair out
    u, c = np.full(60_000, 0.1), np.full(60_000, 90.0)
    u[[5, 7, 9]], c[[5, 7, 9]] = (0.5, 0.6, 0.6), (40.0, 50.0, 50.0)
    assert Q.knapsack(u, c, 100) == [7, 9]


def test_irt(spark):
    df = spark.createDataFrame([("i", 0, 0.5, 1.5, 0.2)], "item_id string, pos long, diff double, disc double, feas double")
    models = spark.createDataFrame([("a", -1.0), ("b", 0.0), ("c", 2.0)], "system string, theta double")
    mirrored = df.withColumn("diff", -F.col("diff"))
    assert by_item(S.irt_utility(df, "fic", models)) == {"i": by_item(S.irt_utility(df, "fic", models))["i"]}
    p = df.select(C.irt_prediction(F.lit(0.0), F.col("diff"), F.col("disc"), F.col("feas")).alias("p"))
    assert one(p, "p") == 0.456657
    assert by_item(S.irt_utility(df, "diffdisc")) == {"i": 0.75} and mirrored.count() == 1
    a = 1.5
    want = sum(a * a * math.exp(a * (t + 0.5)) / (1 + math.exp(a * (t + 0.5))) ** 2 for t in (-1, 0, 2))
    assert math.isclose(S.irt_utility(df, "fic", models).first()["utility"], want)


def test_irt_fit_orders_systems(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), i, s, "m", float(np.clip(q + rng.normal(0, 0.1), 0, 1))) for i in range(30) for s, q in zip("ABC", (0.8, 0.5, 0.2), strict=True)]
    df = spark.createDataFrame(rows, "item_id string, pos long, system string, metric string, value double")
    for model in ("1pl", "2pl", "4pl"):
        items, models = S.irt_fit(df, "m", model, binarize=False)
        assert items.count() == 30
        assert [r["system"] for r in models.orderBy(F.desc("theta")).collect()] == ["A", "B", "C"]
        assert X.theta_accuracy(models, df, "m").first()["accuracy"] == 1


def test_severities(spark):
    df = spark.range(1).select(F.array(*[F.struct(F.lit(s).alias("severity")) for s in ("Minor", "major", "critical", "neutral", "odd")]).alias("e"))
    assert one(df.select(C.mqm_score(C.severities(F.col("e"))).alias("s")), "s") == -31
    assert one(df.select((100 + C.mqm_score(C.severities(F.col("e")), {"minor": -1, "major": -5})).alias("s")), "s") == 94


def test_normalisers(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("b", "m", None), ("c", "m", 3.0), ("a", "k", 2.0), ("c", "k", 2.0)], "item_id string, metric string, value double")
    got = {(r["item_id"], r["metric"]): r["value"] for r in N.minmax(df).collect()}
    assert got == {("a", "m"): 0, ("b", "m"): None, ("c", "m"): 1, ("a", "k"): 0, ("c", "k"): 0}
    human = spark.createDataFrame([("a", "human", -3.0), ("b", "human", -30.0), ("c", "human", 0.0)], "item_id string, metric string, value double")
    assert sorted(r["value"] for r in N.human_scale(human).collect()) == [0, 88, 100]
    share = human.withColumn("value", F.lit(0.4))
    assert {r["value"] for r in N.human_scale(share).collect()} == {40}


def test_dense_items(spark):
    rows = [("a", s) for s in "ABC"] + [("b", s) for s in "AB"] + [("c", s) for s in "ABD"]
    df = spark.createDataFrame([(i, 0, s, "m", 1.0) for i, s in rows], "item_id string, pos long, system string, metric string, value double")
    assert {(r["item_id"], r["system"]) for r in N.dense_items(df, 2).collect()} == {(i, s) for i in "abc" for s in "AB"}
    assert N.dense_items(df, 3).select("item_id").distinct().count() == 1


def test_combination(spark):
    u = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 2.0)], "item_id string, pos long, utility double")
    assert by_item(S.combine([u, u])) == {"a": 1, "b": 2.5, "c": 2.5}
    assert by_item(S.combine([(u, 3), (u, -1)], "avg", None)) == {"a": 1, "b": 2, "c": 2}
    assert by_item(S.combine([u, u], "mul", "01")) == {"a": 0, "b": 1, "c": 1}


def test_spa_of_itself_is_one(scores):
    p = E.permutation_p(scores, "human", 64)
    assert one(E.soft_accuracy(p, p), "spa") == 1
    assert p.count() == 3


def test_single_system_top(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "system string, x double, y double")
    assert E.top_match(df).first()["top"] == 1


def test_student():
    assert round(Q.student_quantile(0.975, 10), 5) == 2.22814
    assert round(Q.student_quantile(0.975, 1), 3) == 12.706


def test_order_of_rows_does_not_matter(scores):
    shuffled = scores.orderBy(F.rand(3))
    assert by_item(S.metric_cons(scores, "m")) == by_item(S.metric_cons(shuffled, "m"))
    assert by_item(L.basic({"scores": scores}, "metric_var", "m"), "rank") == by_item(L.basic({"scores": shuffled}, "metric_var", "m"), "rank")


def test_empty_table(spark, scores):
    none = scores.limit(0)
    assert S.metric_var(none, "m").count() == 0 and E.model_ordering(none).count() == 0 and N.minmax(none).count() == 0


def test_registry(scores, spark):
    L.register_method("mine", lambda t, metric=None, **_: S.metric_avg(t["scores"], metric))
    assert L.basic({"scores": scores}, "mine", "m").orderBy("rank").first()["item_id"] == "d"
    both = L.basic({"scores": scores}, "combinator", "m", methods=[({"method": "metric_var"}, 1), {"method": "metric_avg"}])
    assert both.count() == 4


def test_bruteforce_takes_the_budget(scores):
    got = L.bruteforce_greedy(scores, 2, 1, 8, permutations=8).collect()
    assert sum(r["utility"] for r in got) == 2


def test_vectors(spark):
    rows = [(str(i), i, s, [float(i // 3), float(k)]) for i in range(6) for k, s in enumerate("AB")]
    df = spark.createDataFrame(rows, "item_id string, pos long, system string, embedding array<double>")
    assert sum(r["utility"] for r in L.kmeans(df, 2, "tgt_0").collect()) == 2
    assert L.kmeans_supersample(df, 2, True, "tgt_avg").count() == 6
    assert sum(r["utility"] for r in L.diffuse(df, 2).collect()) <= 2


def test_ward():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert len(set(Q.ward(x, 3))) == 3 and Q.ward(x, 3)[0] == Q.ward(x, 3)[1] and Q.ward(x, 3)[2] == Q.ward(x, 3)[3]
    assert len(set(Q.ward(x, 1))) == 1


@pytest.mark.parametrize("descending", [True, False])
def test_distributed_order_is_the_plain_one(spark, descending):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 17 == 0 else float(rng.integers(0, 9)), float(i % 5)) for i in range(300)] + [(300, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "pos long, u double, cost double")
    plain, cut = (in_order(df, "u", ["pos"], descending, running="cost", buckets=n).orderBy("rank").collect() for n in (1, 7))
    assert [(r["pos"], r["rank"], r["running"]) for r in plain] == [(r["pos"], r["rank"], r["running"]) for r in cut]
    assert in_order(df.limit(0), "u", ["pos"], buckets=4).count() == 0


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("first", ["u", "big", "dec"])
def test_groups_are_ordered_in_buckets(spark, descending, first):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        u = None if i % 19 == 0 else [0.0, 0.0, 0.0, float("-inf"), float(rng.integers(0, 4)), float(rng.random())][rng.integers(6)]
        rows.append((i, f"i{i:03}", u, (1 << 53) + int(rng.integers(0, 4)), Decimal(int(rng.integers(0, 5))) / 4, "hot" if i < 200 else [None, "a", "b"][i % 3], None if rng.random() < 0.2 else float(i % 5), 1, 2))
    df = spark.createDataFrame(rows, "pos long, item_id string, u double, big long, dec decimal(20,10), g string, cost double, s_ int, c_ int")
    for rest in (["pos"], ["item_id"]):
        plain, cut = (in_order(df, first, rest, descending, running="cost", by=("g",), buckets=n).orderBy("pos").collect() for n in (1, 8))
        assert [(r["pos"], r["g"], r["rank"], r["running"], r["s_"], r["c_"]) for r in plain] == [(r["pos"], r["g"], r["rank"], r["running"], r["s_"], r["c_"]) for r in cut]
    assert in_order(df.limit(0), first, ["pos"], by=("g",), buckets=4).count() == 0


def test_no_bucket_holds_a_hot_group_or_value(spark):
    df = spark.range(8000).selectExpr("id AS pos", "IF(id % 10 < 9, 'hot', 'other') AS g", "CASE WHEN id % 3 = 0 THEN 1D WHEN id % 3 = 1 THEN NULL ELSE rand(0) END AS u")
    for descending in (True, False):
        sizes = [r["count"] for r in bucketed(df, "u", ["pos"], descending, 16).groupBy("g", "bucket_").count().collect()]
        assert sum(sizes) == 8000 and max(sizes) <= 3 * 8000 / 16


def test_groupwise_orders_of_much_data(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i, float(rng.integers(0, 3)), float(1 + i % 4), "news" if i % 4 else [None, "talks"][i % 8 // 4], f"d{i // 9}" if i % 11 else None) for i in range(240)]
    items = spark.createDataFrame(rows, "item_id long, pos long, utility double, cost double, domain string, doc string").cache()
    u, docs, noise = items.select("item_id", "pos", "utility"), items.select("item_id", "domain", "doc"), _noise(spark)
    kinds = {
        "document": lambda: L.by_document(u, docs),
        "domain": lambda: L.by_domain(u, docs),
        "domain document": lambda: L.by_domain_document(u, docs),
        "greedy": lambda: L.costaware_greedy(items, 90.0, by=("domain",)),
        "ranks": lambda: E.rank_items(items, ("domain",)),
        "signed ranks": lambda: E.wilcoxon_z(E.neighbour_differences(noise, "m"), ["ord"]),
        "clusters": lambda: E.clusters(noise, "m"),
    }
    shown = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    plain = {name: shown(run()) for name, run in kinds.items()}
    monkeypatch.setattr("siftwell.operators.ranking.planned_buckets", lambda df: 6)
    for name, run in kinds.items():
        assert shown(run()) == plain[name], name


def test_seeds_share_the_scores(scores):
    curve = E.random_curve(scores, scores, "human", [0, 1, 2])
    assert sorted(r["k"] for r in curve.collect()) == [1, 2, 3, 4] and round(curve.where("k = 4").first()["correlation"], 6) == 1
    base = E.random_baseline(scores, "human", props=[0.5, 1.0], seeds=2)
    assert {r["prop"] for r in E.parity_normalized(scores, E.rank_items(S.metric_var(scores, "human")), base, "human").collect()} == {0.5, 1.0}


# ---- plans for many items give what the plain ones give --------------------------------------------------------------


def _noise(spark, n=60, systems="abcd"):
    rng = np.random.default_rng(5)
    rows = [(i, i, s, "m", None if rng.random() < 0.05 else float(np.round(rng.normal(k * 0.4, 1), 2))) for i in range(n) for k, s in enumerate(systems)]
    return spark.createDataFrame(rows, "item_id long, pos long, system string, metric string, value double")


def test_prefix_means_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET_RANKS", 7)
    scores = _noise(spark)
    ranked = E.seeded_ranks(scores, [0, 1])
    plain, cut = (E.prefix_means(scores, ranked, "m", ("seed",), buckets=b).orderBy("seed", "system", "k").collect() for b in (False, True))
    assert len(plain) == len(cut) == 2 * 4 * 60
    for a, b in zip(plain, cut, strict=True):
        assert a[:3] == b[:3] and (a["x"] == b["x"] or abs(a["x"] - b["x"]) < 1e-9)


def test_ranks_without_one_task(spark, monkeypatch):
    u = _noise(spark, systems="a").select("item_id", "pos", F.round("value", 0).alias("utility"))
    plain = S.combine([u]).orderBy("item_id").collect()
    monkeypatch.setattr(S, "planned_buckets", lambda df: 3)
    monkeypatch.setattr("siftwell.operators.ranking.planned_buckets", lambda df: 3)
    assert S.combine([u]).orderBy("item_id").collect() == plain


def test_signs_are_balanced_and_stable():
    signs = E.sign_rows(3, [str(i) for i in range(200)], 300)
    assert set(np.unique(signs)) == {-1.0, 1.0} and abs(signs.mean()) < 0.02
    assert (E.sign_rows(3, ["7"], 300)[0] == signs[7]).all() and (E.sign_rows(4, ["7"], 300)[0] != signs[7]).any()


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "x.txt").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = items.numbered_lines(spark, str(tmp_path / "x.txt")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == list(enumerate(lines))
