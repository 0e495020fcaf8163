"""Sequential searches against plain loops over one small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import numeric as Q
from siftwell.functions.columns import uniform
from siftwell.operators import evaluate as E
from siftwell.operators import experiments as X
from siftwell.operators import select as L

SYSTEMS = "abcd"


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("x", 70), ("y", 25), (None, 6)):
        for i in range(n):
            for k, s in enumerate(SYSTEMS):
                if not (i == 4 and s == "b"):  # one item of each data set lacks a system
                    rows.append((name, f"{name}{i}", i, s, "m", float(np.round(rng.normal(k * 0.3, 1), 1))))
    return spark.createDataFrame(rows, "dataset string, item_id string, pos long, system string, metric string, value double").cache()


def table(sets, name):
    """item ids and values (item x system) of the complete items, by pos."""
    found = {}
    for r in sets.where(F.col("dataset") == name).orderBy("pos").collect():
        found.setdefault(r["item_id"], {})[r["system"]] = r["value"]
    found = {i: v for i, v in found.items() if len(v) == len(SYSTEMS)}
    return list(found), np.array([[v[s] for s in SYSTEMS] for v in found.values()])


def drawn(sets, seed, key):
    return {(r["item_id"], r["system"]): r["u"] for r in sets.select("item_id", "system", uniform(seed, key).alias("u")).collect()}


@pytest.mark.parametrize("farthest", [False, True])
def test_search_by_orderings(sets, monkeypatch, farthest):
    monkeypatch.setattr(X, "NEXT_ITEMS", 5)  # lists run out and are asked for again
    known = sets.where("dataset IS NOT NULL")
    got = X.ordering_distance_selection(known, 40, "m", farthest, start=6, seed=2, by=("dataset",)).collect()
    u = drawn(sets, 2, F.col("item_id"))
    for name in "xy":
        ids, x = table(sets, name)
        places = lambda v: np.argsort(np.argsort(-v, kind="stable"), kind="stable")
        chosen = sorted(range(len(ids)), key=lambda k: u[ids[k], "a"])[:6]
        while len(chosen) < min(40, len(ids)):
            subset = places(np.add.reduce([x[k] for k in chosen]))
            d = [((places(v) - subset) ** 2).sum() for v in x]
            rest = [k for k in range(len(ids)) if k not in chosen]
            chosen.append(min(rest, key=lambda k: (-d[k] if farthest else d[k], k)))
        mine = [r["item_id"] for r in sorted(got, key=lambda r: r["step"]) if r["dataset"] == name]
        assert mine == [ids[k] for k in chosen]
    assert X.ordering_distance_selection(sets.limit(0), 5, "m").count() == 0
    assert X.ordering_distance_selection(sets.where("dataset = 'x'"), 3, "m").count() == 3


def test_active_learning_is_the_plain_loop(sets):
    known = sets.where("dataset IS NOT NULL")
    got = X.active_learning(known, 30, "m", start=4, seed=1, by=("dataset",)).collect()
    u = drawn(sets, 1, F.concat_ws("|", "item_id", "system"))
    for name in "xy":
        ids, x = table(sets, name)
        orders = [sorted(range(len(ids)), key=lambda k, s=s: u[ids[k], s]) for s in SYSTEMS]
        have, want = [4] * 4, []
        for step in range(1, 31):
            bands = []
            for s in range(4):
                v = x[orders[s][: have[s]], s]
                half = Q.student_quantile(0.95, len(v) - 1) * v.std()
                bands.append((v.mean() - half, v.mean() + half))
            overlap = [sum(a[0] <= b[1] and b[0] <= a[1] for b in bands) if have[s] < len(ids) else -1 for s, a in enumerate(bands)]
            s = int(np.argmax(overlap))
            so_far = [round(x[orders[k][: have[k]], k].mean(), 9) for k in range(4)]
            want.append((step, SYSTEMS[s], ids[orders[s][have[s]]], round(Q.kendall(np.array(so_far), x.mean(0).round(9), "c"), 9)))
            have[s] += 1
        mine = sorted((r["step"], r["system"], r["item_id"], round(r["tau"], 9)) for r in got if r["dataset"] == name)
        assert mine == want
    assert X.active_learning(sets.limit(0), 5, "m").count() == 0
    few = X.active_learning(sets.where("dataset = 'x'").where("pos < 3"), 50, "m", start=1).collect()
    assert len(few) == 8  # two more items of each of four systems


def test_bruteforce_takes_the_best_simulation(sets):
    one = sets.where("dataset = 'x'").drop("dataset")
    ids = [r["item_id"] for r in one.select("item_id", "pos").distinct().orderBy("pos").collect()]
    full = E.permutation_p(one, "m", 50, 8)

    def spa(places):
        part = one.where(F.col("item_id").isin([ids[k] for k in places]))
        return round(E.soft_accuracy(E.permutation_p(part, "m", 50, 7), full).first()["spa"], 9)

    chosen = []
    for _ in range(2):
        tries = []
        for sim in range(4):
            rest = [k for k in range(len(ids)) if k not in chosen]
            places = np.random.default_rng([7, len(chosen), sim]).choice(len(rest), 5, replace=False)
            tries.append([rest[k] for k in places])
        chosen += max(tries, key=lambda t: spa(chosen + t))  # the first of equals
    got = L.bruteforce_greedy(one, 10, 5, 4, "m", 50, 7).where("utility = 1").collect()
    assert sorted(r["item_id"] for r in got) == sorted(ids[k] for k in chosen)
    assert L.bruteforce_greedy(one.limit(0), 3, 2, 2, "m").count() == 0
