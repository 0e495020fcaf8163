"""Item-response fits recover what scores were simulated from; features tell about items without scores; curves are smoothed."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import experiments as X
from siftwell.functions import numeric
from siftwell.operators import response as R
from siftwell.operators import scorers as S

SCHEMA = "dataset string, item_id string, pos long, system string, metric string, value double"


def simulated(spark, seed, items=300, systems=12, missing=0.05):
    rng = np.random.default_rng(seed)
    theta, diff, disc = np.linspace(-1.5, 1.5, systems), rng.normal(0, 1, items), rng.uniform(0.6, 1.6, items)
    p = 1 / (1 + np.exp(-disc[:, None] * (theta - diff[:, None])))
    rows = [(f"d{seed}", str(i), i, f"s{k:02}", "m", float(p[i, k])) for i in range(items) for k in range(systems) if rng.random() >= missing]
    return rows, theta, diff, disc


def test_parameters_are_recovered_in_every_data_set(spark):
    parts = [simulated(spark, s) for s in (1, 2)]
    df = spark.createDataFrame([r for p in parts for r in p[0]], SCHEMA).repartition(5)
    cells = R.cells_of(df, "m", ("dataset",), "none")
    items, theta = R.alternate(cells, R.Curve("2pl"), ("dataset",))
    for n, (_, t, diff, disc) in zip((1, 2), parts, strict=True):
        got = {int(r["item_id"]): r for r in items.where(F.col("dataset") == f"d{n}").collect()}
        assert len(got) == 300
        assert np.corrcoef([got[i]["diff"] for i in range(300)], diff)[0, 1] > 0.97
        assert np.corrcoef([got[i]["disc"] for i in range(300)], disc)[0, 1] > 0.8
        found = theta.where(F.col("dataset") == f"d{n}").first()["theta"]
        assert np.corrcoef(found, t)[0, 1] > 0.995 and np.argsort(found).tolist() == list(range(12))


@pytest.mark.parametrize("model", ["1pl", "2pl", "4pl"])
def test_models_order_systems(spark, model):
    rows, t, diff, _ = simulated(spark, 3, 60, 6)
    df = spark.createDataFrame(rows, SCHEMA).drop("dataset")
    items, systems = R.irt_fit(df, "m", model, binarize=model == "1pl", rounds=4)
    assert [r["system"] for r in systems.orderBy("theta").collect()] == [f"s{k:02}" for k in range(6)]
    assert items.count() == 60 and (items.where("feas between 0 and 0.99").count() == 60)
    with pytest.raises(ValueError):
        R.Curve("3pl")


def test_two_dimensions(spark):
    rng = np.random.default_rng(4)
    theta, disc = rng.normal(0, 1.2, (14, 2)), rng.uniform(0, 1.5, (200, 2))
    p = 1 / (1 + np.exp(-(disc @ theta.T)))
    df = spark.createDataFrame([("d", str(i), i, f"s{k:02}", "m", float(p[i, k])) for i in range(200) for k in range(14)], SCHEMA).drop("dataset")
    cells = R.cells_of(df, "m", (), "none")
    items, theta_ = R.alternate(cells, R.Plane(2), (), 15)
    t = np.array(theta_.first()["theta"]).reshape(-1, 2)
    got = {int(r["item_id"]): r for r in items.collect()}
    q = np.array([R.sigmoid(np.array([got[i]["disc0"], got[i]["disc1"]]) @ t.T - got[i]["diff"]) for i in range(200)])
    assert np.abs(q - p).mean() < 0.04 < np.abs(p - p.mean(0)).mean()
    assert X.multidimensional_irt(df, "m", rounds=1).count() == 200


def test_features_predict_items_without_scores(spark):
    rng = np.random.default_rng(5)
    x, theta = rng.normal(0, 1, (400, 5)), np.linspace(-1, 1, 5)
    diff = x @ np.array([1.0, -0.7, 0.0, 0.4, 0.0])
    y = 1 / (1 + np.exp(-(theta - diff[:, None])))
    vectors = spark.createDataFrame([(str(i), i, x[i].tolist()) for i in range(400)], "item_id string, pos long, embedding array<double>")
    df = spark.createDataFrame([("d", str(i), i, f"s{k}", "m", float(y[i, k])) for i in range(300) for k in range(5)], SCHEMA).drop("dataset")
    items, systems, predicted = R.feature_irt(df, vectors, "m", scale="none")
    got, t = {int(r["item_id"]): r for r in items.collect()}, [r["theta"] for r in systems.orderBy("system").collect()]
    assert len(got) == 400 and t == sorted(t)
    q = np.array([got[i]["feas"] + (1 - got[i]["feas"]) * R.sigmoid(got[i]["disc"] * (np.array(t) - got[i]["diff"])) for i in range(300, 400)])
    scalar = np.abs(y[300:] - y[:300].mean(0)).mean()  # what is known of an item without features: the systems' means
    assert np.abs(q - y[300:]).mean() < 0.4 * scalar
    assert predicted(vectors.limit(3)).count() == 3


def test_words_predict_difficulty(spark):
    hard, easy = "quantum tensor manifold".split(), "cat house tree".split()
    rng = np.random.default_rng(6)
    items = [(str(i), i, " ".join(rng.choice(hard if i % 2 else easy, 3).tolist() + ["the"])) for i in range(80)]
    src = spark.createDataFrame(items, "item_id string, pos long, src string")
    df = spark.createDataFrame([(str(i), i, f"s{k}", "m", (0.3 if i % 2 else 0.7) + 0.1 * k) for i in range(60) for k in range(3)], "item_id string, pos long, system string, metric string, value double")
    found, _, _ = R.feature_irt(df, R.tfidf_vectors(src, 64), "m", rounds=30, scale="none")
    got = {int(r["item_id"]): r["diff"] for r in found.where("pos >= 60").collect()}
    assert min(v for i, v in got.items() if i % 2) > max(v for i, v in got.items() if not i % 2)


def test_smoothing_is_local_least_squares(spark):
    rng = np.random.default_rng(7)
    curves = {"a": rng.normal(0, 1, 25), "b": rng.normal(0, 1, 4), "c": rng.normal(0, 1, 1), "d": np.arange(9.0) ** 2}
    df = spark.createDataFrame([(k, float(i), float(v)) for k, vs in curves.items() for i, v in enumerate(vs)], "k string, x double, y double")
    got = {(r["k"], int(r["x"])): r["smooth"] for r in X.smoothed(df, "x", "y", 7, 2, ("k",)).collect()}
    for k, vs in curves.items():
        n = len(vs)
        w = min(7, n if n % 2 else n - 1)
        for i, v in enumerate(vs):
            start = max(0, min(i - w // 2, n - w))
            want = v if w <= 2 else np.polyval(np.polyfit(np.arange(w), vs[start : start + w], 2), i - start)
            assert abs(got[k, i] - want) < 1e-8
    assert all(abs(got["d", i] - i * i) < 1e-9 for i in range(9))  # a parabola stays one
    pairs = {(r["k"], int(r["x"])): r["smooth"] for r in X.smoothed(df, "x", "y", 2, 1, ("k",)).collect()}  # neighbours' means; the ends stay
    for k, vs in curves.items():
        assert all(abs(pairs[k, i] - (v if i in (0, len(vs) - 1) else (v + vs[i + 1]) / 2)) < 1e-9 for i, v in enumerate(vs))
    with pytest.raises(ValueError):
        X.smoothed(df, "x", "y", 2, 2)


def test_a_network_beats_a_line(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (600, 3))
    target = np.abs(x[:, 0]) * 2 + x[:, 1] * x[:, 2]
    vectors = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(600)], "item_id long, pos long, embedding array<double>")
    utility = spark.createDataFrame([(i, float(target[i])) for i in range(600)], "item_id long, utility double")
    train = F.col("item_id") < 400
    wrong = {}
    for name, found in (("line", S.distilled_from_vectors(vectors, utility, train)), ("network", S.distilled_network(vectors, utility, train, rounds=80))):
        got = {r["item_id"]: r["utility"] for r in found.collect()}
        assert len(got) == 600
        wrong[name] = np.mean([(got[i] - target[i]) ** 2 for i in range(400, 600)])
    assert wrong["network"] < 0.5 * wrong["line"]


def test_feature_vectors_are_not_broadcast(spark, monkeypatch, tmp_path):
    """The optimiser takes an array for one number, so a table of vectors that does not fit into the driver looks small to it."""
    plans = []
    monkeypatch.setattr(R, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    df = spark.createDataFrame([(str(i), i, f"s{k}", "m", (i + k) / 12) for i in range(8) for k in range(4)], "item_id string, pos long, system string, metric string, value double")
    spark.createDataFrame([(str(i), i, [1.0, i / 8]) for i in range(8)], "item_id string, pos long, embedding array<double>").write.parquet(f"{tmp_path}/vectors")
    items, _, _ = R.feature_irt(df, spark.read.parquet(f"{tmp_path}/vectors"), "m", rounds=1)
    assert items.count() == 8 and len(plans) == 1 and "BroadcastHashJoin" not in plans[0]


def reference_sari(src, tgt, refs):
    grams = lambda t, n: Counter(" ".join(t[i : i + n]) for i in range(len(t) - n + 1))
    s, c, rs = (numeric.tokens_13a(src.lower()), numeric.tokens_13a(tgt.lower()), [numeric.tokens_13a(r.lower()) for r in refs])
    f = lambda p, r: 2 * p * r / (p + r) if p + r else 0.0
    total = 0.0
    for n in range(1, 5):
        k = len(refs)
        a, b = (Counter({g: v * k for g, v in grams(t, n).items()}) for t in (s, c))
        r = sum((grams(t, n) for t in rs), Counter())
        keep, every = a & b, a & r
        good = keep & r
        p1 = sum(good[g] / keep[g] for g in good) / len(keep) if keep else 1.0
        r1 = good.total() / every.total() if every else 1.0
        gone = a - b
        dropped = gone - r
        p2 = sum(dropped[g] / gone[g] for g in dropped) / len(gone) if gone else 1.0
        new, wanted = set(b) - set(a), set(r) - set(a)
        p3, r3 = (len(new & set(r)) / len(new) if new else 1.0), (len(new & set(r)) / len(wanted) if wanted else 1.0)
        total += (f(p1, r1) + p2 + f(p3, r3)) / 3
    return 100 * total / 4


def test_simplification_score(spark):
    rng = np.random.default_rng(9)
    words = "the cat, sat on a mat. Dog's 3.5 big-old house &amp; tree".split()
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 9)))
    rows = [(str(i), i, text(), [text() for _ in range(1 + i % 2)], [text() for _ in range(2)]) for i in range(30)] + [("same", 30, "a b", ["a b"], ["a b"]), ("about", 31, "About 95 species are currently accepted.", ["About 95 species are currently known.", "About 95 species are now accepted.", "95 species are now accepted."], ["About 95 you now get in."])]
    outputs = spark.createDataFrame([(i, p, f"s{k}", t) for i, p, _, _, ts in rows for k, t in enumerate(ts)], "item_id string, pos long, system string, tgt string")
    sources = spark.createDataFrame([(i, s) for i, _, s, _, _ in rows], "item_id string, src string")
    refs = spark.createDataFrame([(i, r) for i, _, _, rs, _ in rows for r in rs], "item_id string, ref string")
    got = {(r["item_id"], r["system"]): r["value"] for r in S.simplification_score(outputs, sources, refs).collect()}
    want = {(i, f"s{k}"): reference_sari(s, t, rs) for i, _, s, rs, ts in rows for k, t in enumerate(ts)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got["same", "s0"] == 100 and abs(got["about", "s0"] - 26.953601953601954) < 1e-9
    assert S.simplification_score(outputs, sources, refs.where("item_id = '1'")).select("item_id").distinct().count() == 1


def test_simplification_score_shuffles_no_ngrams(spark):
    """One row for each item and system; items whose texts are too long for that have the same scores by n-grams."""
    rng = np.random.default_rng(11)
    words = "a the cat, mat. 3.5 big-old &amp; tree".split()
    text = lambda most=12: " ".join(rng.choice(words, rng.integers(0, most)))
    rows = [(i, i, f"s{k}", text()) for i in range(40) for k in range(i % 4)] + [(7, 7, "s0", text()), (8, 9, "s0", None), (9, None, "s0", ""), (9, 9, None, text()), (None, 3, "s0", "a b")]
    outputs = spark.createDataFrame(rows, "item_id long, pos long, system string, tgt string")
    sources = spark.createDataFrame([(i, text()) for i in range(36)] + [(5, text()), (6, None), (None, "a b")], "item_id long, src string")
    refs = spark.createDataFrame([(i, text()) for i in range(2, 40) for _ in range(1 + i % 3)] + [(3, None), (None, "a b")], "item_id long, ref string")
    value = lambda df: {(r["item_id"], r["pos"], r["system"]): r["value"] for r in df.collect()}
    found = S.simplification_score(outputs, sources, refs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate explode(") == 1
    want, got = value(S._sari_by_grams(outputs, sources, refs, 4)), value(found)
    assert len(want) == found.count() > 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_simplification_score_of_long_items(spark, monkeypatch):
    outputs = spark.createDataFrame([(1, 1, "s0", "a b c d a b"), (1, 1, "s1", "a"), (2, 2, "s0", "b c")], "item_id long, pos long, system string, tgt string")
    sources, refs = (spark.createDataFrame([(1, "a b c"), (2, "b d")], f"item_id long, {c} string") for c in ("src", "ref"))
    plain = sorted(map(tuple, S.simplification_score(outputs, sources, refs).collect()))
    taken = []
    by_grams = S._sari_by_grams
    monkeypatch.setattr(S, "_sari_by_grams", lambda *a: taken.append(sorted({r["item_id"] for r in a[0].collect()})) or by_grams(*a))
    monkeypatch.setattr(S, "LONG_ITEM", 9)
    got = sorted(map(tuple, S.simplification_score(outputs, sources, refs).collect()))
    assert taken == [[1]] and len(got) == 3 and [r[:3] for r in got] == [r[:3] for r in plain] and [r[3] for r in got] == pytest.approx([r[3] for r in plain])


def test_simplification_kernel():
    import pyarrow as pa

    from siftwell.functions import sari

    rng = np.random.default_rng(12)
    text = lambda: " ".join(rng.choice(list("abcde"), rng.integers(0, 30)))
    src, refs, item = [text() for _ in range(20)], [[text() for _ in range(rng.integers(1, 5))] for _ in range(20)], rng.integers(0, 20, 200)
    tgt = [text() for _ in item]
    column = lambda rows: pa.array([[t.split() for t in r] for r in rows], pa.list_(pa.list_(pa.string())))
    got = sari.scores(column([[t] for t in tgt]), column([[t] for t in src]), column(refs), item, 4)
    assert np.allclose(got, [reference_sari(src[i], t, refs[i]) for i, t in zip(item, tgt, strict=True)], atol=1e-9)
    none = column([[""]])
    assert sari.scores(none, none, none, np.array([0]), 4).tolist() == [100.0]
    assert sari.steps(np.array([5, 5, 20, 1, 1, 1]), 10) == [(0, 2), (2, 3), (3, 6)] and sari.steps(np.array([]), 10) == []


def plain_ward(x, clusters):
    """Labels by merging the two clusters whose union costs least, over and over."""
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > max(1, clusters):
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    groups.sort()
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(len(x))]


def test_ward_by_chains():
    rng = np.random.default_rng(10)
    for n, k in ((1, 1), (2, 1), (2, 5), (30, 4), (30, 1), (40, 11), (25, 25)):
        x = rng.normal(0, 1, (n, 3))
        assert numeric.ward(x, k).tolist() == plain_ward(x, k)
    same = np.repeat(rng.normal(0, 1, (4, 2)), 5, axis=0)  # heights of 0
    assert numeric.ward(same, 4).tolist() == plain_ward(same, 4)
    assert len(set(numeric.ward(rng.normal(0, 1, (2000, 4)), 7).tolist())) == 7
