"""Operators of the experiments: ordering-distance selection, active learning, IRT analyses, tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import numeric
from siftwell.functions.columns import irt_prediction, uniform
from siftwell.operators import evaluate
from siftwell.operators.lineage import written
from siftwell.operators.ranking import in_order
from siftwell.operators.response import multidimensional_irt  # noqa: F401

By = tuple[str, ...]
#: Rows that the search by orderings asks for at once, in each data set.
NEXT_ITEMS = 64


def complete_items(scores: DataFrame, metric: str, by: By = ()) -> DataFrame:
    """by, item_id, pos, values (one for each system, by name): the items that have a value for every system of their data set."""
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(*by, "item_id", "pos", "system").agg(F.avg(F.col("value").cast("double")).alias("v_"))
    rows = own.groupBy(*by, "item_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("system", "v_"))), lambda x: x["v_"]).alias("values"))  # as many as there are systems
    systems = own.groupBy(*by).agg(F.countDistinct("system").alias("m_"))
    both = rows.join(systems, list(by)) if by else rows.crossJoin(F.broadcast(systems))  # without groups, one row
    return both.where(F.size("values") == F.col("m_")).drop("m_")


def _places(values: np.ndarray) -> list[int]:
    """Rank of each system, best 0, equals by name."""
    return np.argsort(np.argsort(-values, kind="stable"), kind="stable").tolist()


def ordering_distance_selection(scores: DataFrame, budget: int, metric: str = "human", farthest: bool = False, start: int = 10, seed: int = 0, by: By = ()) -> DataFrame:
    """by, item_id, step: starts with random items, then keeps adding the item whose own ordering of the systems is nearest to (or farthest from) the subset's; equals by pos.

    The search is sequential, but the next items depend on the subset only through its ordering. So one job finds the NEXT_ITEMS nearest items to the present
    ordering in every data set (each task keeps only as many of a data set), and they are taken in turn until the ordering changes. The driver holds
    the chosen rows (budget of them for each data set) and such lists, never the items. Items without a value for some system take no part.
    """
    spark, types = scores.sparkSession, dict(scores.dtypes)
    place = F.transform("values", lambda v, i: F.size(F.filter("values", lambda w, j: (w > v) | ((w == v) & (j < i)))))
    items = written(complete_items(scores, metric, by).withColumn("places", place), "orderings")
    first = in_order(items.withColumn("r_", uniform(seed, F.col("item_id"))), "r_", ["pos", "item_id"], descending=False, by=by).where(F.col("rank") <= min(start, budget))
    chosen: dict[tuple, list] = {}
    totals: dict[tuple, np.ndarray] = {}
    for r in first.orderBy("rank").collect():
        key = tuple(r[c] for c in by)
        chosen.setdefault(key, []).append(r["item_id"])
        totals[key] = totals.get(key, 0.0) + np.array(r["values"])
    lists: dict[tuple, list] = {}  # (data set, ordering) -> rows not chosen when they were asked for, best last
    group = ", ".join(f"{c} {types[c]}" for c in by) + (", " if by else "")
    same = lambda table: [F.col(f"i.{c}").eqNullSafe(F.col(f"{table}.{c}")) for c in by]
    distance = F.aggregate(F.zip_with("i.places", "a.asked", lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)
    order = [F.desc("d_") if farthest else F.asc("d_"), "pos", "item_id"]
    active = [k for k in chosen if len(chosen[k]) < budget]
    while active:
        asked = []
        for key in list(active):
            taken = set(chosen[key])
            while len(chosen[key]) < budget:
                at = (key, tuple(_places(totals[key])))
                rows = lists.get(at, [])
                while rows and rows[-1][0] in taken:
                    rows.pop()
                if not rows:
                    asked.append(at)
                    break
                item, values = rows.pop()
                chosen[key].append(item)
                taken.add(item)
                totals[key] = totals[key] + values
            else:
                active.remove(key)
        if not asked:
            break
        orders = spark.createDataFrame([(*key, list(places)) for key, places in asked], group + "asked array<int>").alias("a")  # a row for each data set
        gone = spark.createDataFrame([(*key, i) for key, _ in asked for i in chosen[key]], group + f"item_id {types['item_id']}").alias("c")  # at most budget rows for each
        near = items.alias("i").join(F.broadcast(orders), same("a")) if by else items.alias("i").crossJoin(F.broadcast(orders))
        near = near.join(gone, [*same("c"), F.col("i.item_id") == F.col("c.item_id")], "left_anti")
        near = near.select("i.*", distance.alias("d_")).withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn_") <= NEXT_ITEMS)
        found: dict[tuple, list] = {}
        for r in near.select(*by, "item_id", "values", "rn_").collect():
            found.setdefault(tuple(r[c] for c in by), []).append((r["rn_"], r["item_id"], np.array(r["values"])))
        for at in asked:
            lists[at] = [x[1:] for x in sorted(found.get(at[0], []), key=lambda x: -x[0])]
            if not lists[at]:  # no item is left
                active.remove(at[0])
    rows = [(*key, item, step) for key, own in chosen.items() for step, item in enumerate(own, 1)]
    return spark.createDataFrame(rows, group + f"item_id {types['item_id']}, step long")


def active_learning(scores: DataFrame, budget: int, metric: str = "human", start: int = 10, confidence: float = 0.9, seed: int = 0, by: By = ()) -> DataFrame:
    """by, step, system, item_id, tau: after start items for all systems, always asks for a random item of the system whose interval overlaps most others; tau-c of the means so far with the full means.

    At most start + budget items of a system are ever asked for, so each system's random order is cut there before the loop, which then holds so many rows
    for each system of one data set, however large that is. Means are of all items. Items without a value for some system take no part.
    """
    types = dict(scores.dtypes)
    keys = [*by, "system"]
    whole = complete_items(scores, metric, by).select(*by, "item_id")
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull()).join(whole, [*by, "item_id"], "left_semi")
    own = own.groupBy(*keys, "item_id", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    means = own.groupBy(*keys).agg(F.round(F.avg("value"), evaluate.PLACES).alias("mean"))
    drawn = in_order(own.withColumn("r_", uniform(seed, F.concat_ws("|", "item_id", "system"))), "r_", ["pos", "item_id"], descending=False, by=tuple(keys)).where(F.col("rank") <= start + budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(s, rows.sort_values("rank")) for s, rows in pdf.groupby("system", sort=True)]
        known = [rows["value"].to_numpy() for _, rows in parts]
        full = np.array([rows["mean"].iloc[0] for _, rows in parts])
        have, quantile, out = [min(start, len(v)) for v in known], {}, []
        for step in range(1, budget + 1):
            bands = []
            for n, v in zip(have, known, strict=True):
                if n not in quantile:
                    quantile[n] = numeric.student_quantile(0.5 + confidence / 2, max(1, n - 1))
                half, mean = quantile[n] * v[:n].std(), v[:n].mean()
                bands.append((mean - half, mean + half, mean))
            overlap = [sum(a[0] <= b[1] and b[0] <= a[1] for b in bands) if have[s] < len(known[s]) else -1 for s, a in enumerate(bands)]
            s = int(np.argmax(overlap))
            if overlap[s] < 0:
                break
            name, rows = parts[s]
            out.append((step, name, rows["item_id"].iloc[have[s]], numeric.kendall(np.round([b[2] for b in bands], evaluate.PLACES), full, "c")))
            have[s] += 1
        answer = pd.DataFrame(out, columns=["step", "system", "item_id", "tau"])
        return answer.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, *answer.columns]]

    rows = drawn.join(means, keys)
    rows = rows if by else rows.withColumn("g_", F.lit(0))
    return rows.groupBy(*(by or ("g_",))).applyInPandas(run, "".join(f"{c} {types[c]}, " for c in by) + f"step long, system string, item_id {types['item_id']}, tau double")


def average_parameters(runs: DataFrame) -> DataFrame:
    """Mean item parameters over repeated fits (item_id, pos, run, diff, disc, feas)."""
    return runs.groupBy("item_id", "pos").agg(*[F.avg(c).alias(c) for c in ("diff", "disc", "feas")])


def irt_item_error(scores: DataFrame, items: DataFrame, models: DataFrame, metric: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Mean squared error of the predicted scores of each item whose mean lies between low and high."""
    own = scores.where(F.col("metric") == metric)
    both = own.join(items.select("item_id", "diff", "disc", "feas"), "item_id").join(models, "system")
    p = irt_prediction(F.col("theta"), F.col("diff"), F.col("disc"), F.col("feas"))
    per = both.groupBy("item_id", "pos").agg(F.avg("value").alias("mean"), F.avg((p - F.col("value")) ** 2).alias("loss"))
    return per.where((F.col("mean") > low) & (F.col("mean") < high))


def characteristic_curve(items: DataFrame, thetas: list[float]) -> DataFrame:
    """theta, expected: mean predicted score over items."""
    points = items.sparkSession.createDataFrame([(float(t),) for t in thetas], "theta double")
    both = items.crossJoin(F.broadcast(points))
    return both.groupBy("theta").agg(F.avg(irt_prediction(F.col("theta"), F.col("diff"), F.col("disc"), F.col("feas"))).alias("expected"))


def observed_curve(scores: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """system, theta, observed mean."""
    return evaluate.model_absolute(scores, metric).join(models, "system").select("system", "theta", F.col("mean").alias("observed"))


def holdout_error(scores: DataFrame, fit, metric: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """mae and correlation of predictions for a random share of the scores; fit maps the rest to (items, models)."""
    own = scores.where(F.col("metric") == metric)
    out = uniform(seed, F.concat_ws("|", "item_id", "system")) < share
    items, models = fit(own.where(~out))
    both = own.where(out).join(items.select("item_id", "diff", "disc", "feas"), "item_id").join(models, "system")
    both = both.withColumn("p", irt_prediction(F.col("theta"), F.col("diff"), F.col("disc"), F.col("feas")))
    return both.agg(F.avg(F.abs(F.col("p") - F.col("value"))).alias("mae"), evaluate.pearson("p", "value").alias("correlation"))


def additive_baseline(scores: DataFrame, metric: str) -> DataFrame:
    """item_id, system, predicted: item mean + system mean - grand mean (the least-squares fit of both dummies on dense data), clipped to [0, 1]."""
    own = scores.where(F.col("metric") == metric)
    item = own.groupBy("item_id").agg(F.avg("value").alias("i_"))
    system = own.groupBy("system").agg(F.avg("value").alias("s_"))
    grand = own.agg(F.avg("value").alias("g_"))
    both = own.join(item, "item_id").join(system, "system").crossJoin(grand)
    return both.select("item_id", "system", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("i_") + F.col("s_") - F.col("g_"))).alias("predicted"))


def item_lines(scores: DataFrame, metric: str) -> DataFrame:
    """Least-squares line of each item's scores on the systems' means: slope, intercept (0 and the mean where the systems are equal)."""
    means = evaluate.model_absolute(scores, metric)
    both = scores.where(F.col("metric") == metric).join(means, "system")
    slope = F.coalesce(F.when(F.var_pop("mean") > 1e-12, F.try_divide(F.covar_pop("mean", "value"), F.var_pop("mean"))), F.lit(0.0))
    return both.groupBy("item_id").agg(slope.alias("slope"), F.avg("value").alias("v_"), F.avg("mean").alias("m_")).select("item_id", "slope", (F.col("v_") - F.col("slope") * F.col("m_")).alias("intercept"))


def theta_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute Spearman correlation of two fits' abilities (system, theta)."""
    both = a.withColumnRenamed("theta", "x").join(b.withColumnRenamed("theta", "y"), "system")
    return evaluate.correlation(both, "spearman").select(F.abs("correlation").alias("correlation"))


def theta_accuracy(models: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    """Share of pairs of systems that abilities and means order alike."""
    both = models.select("system", F.col("theta").alias("x")).join(evaluate.model_absolute(scores, metric).withColumnRenamed("mean", "y"), "system")
    return evaluate.pairwise_accuracy(both)


def ordering_convergence(scores: DataFrame, ranked: DataFrame, metric: str = "human", by: By = ()) -> DataFrame:
    """k, distance: mean absolute distance of the prefix means from the full means."""
    means = evaluate.prefix_means(scores, ranked, metric, by)
    own = evaluate.shared(scores, by)
    means = means.join(evaluate.model_absolute(scores, metric, tuple(own)).withColumnRenamed("mean", "y"), [*own, "system"])
    return means.groupBy(*by, "k").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def average_curves(curves: DataFrame, value: str, keys: By = ("method", "prop")) -> DataFrame:
    """Mean over repetitions and data sets."""
    return curves.groupBy(*keys).agg(F.avg(value).alias(value))


def binned_means(df: DataFrame, x: str, y: str, edges: list[float], absolute: bool = False) -> DataFrame:
    """bin (number of edges at most x), n, mean of y."""
    v = F.abs(x) if absolute else F.col(x)
    number = sum(((v >= e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))


def cost_correlation(items: DataFrame, by: By = ("dataset",)) -> DataFrame:
    """Pearson of cost and utility in each data set."""
    return items.groupBy(*by).agg(evaluate.pearson("cost", "utility").alias("correlation"))


def expected_improvement(curves: DataFrame) -> DataFrame:
    """Method minus random at each point (method, prop, value)."""
    base = curves.where("method = 'random'").select("prop", F.col("value").alias("base_"))
    return curves.where("method <> 'random'").join(base, "prop").select("method", "prop", (F.col("value") - F.col("base_")).alias("gain"))


def results_table(results: DataFrame, methods: list[str], digits: int = 3) -> DataFrame:
    """One row for each data set, one column for each method, and the best method after rounding (equals: first by name)."""
    rounded = results.withColumn("value", F.round("value", digits))
    order = Window.partitionBy("dataset").orderBy(F.desc("value"), "method")
    best = rounded.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").select("dataset", F.col("method").alias("best"))
    return rounded.groupBy("dataset").pivot("method", methods).agg(F.first("value")).join(best, "dataset")


def mean_correlations(correlations: DataFrame) -> DataFrame:
    """Mean correlation of each metric over data sets (dataset, metric, correlation)."""
    return correlations.groupBy("metric").agg(F.avg("correlation").alias("correlation"))


def metric_quality(scores: DataFrame, methods: dict, target: str = "human", value: str = "spa", props: list[float] | None = None, seeds: int = 10, permutations: int = 1000) -> DataFrame:
    """metric, method, prop, quality (correlation of the metric with the target), parity (of the target on the order by that metric and method, divided by a random order's).

    methods maps names to functions (scores, metric, by) -> utility. Metric and method are columns from the scorer through the ranking to the curve, so the sweep is one plan.
    value: correlation, clusters or spa.
    """
    spark = scores.sparkSession
    others = scores.where(F.col("metric") != target).select("item_id", "pos", "system", F.col("metric").alias("sweep"), F.lit("x").alias("metric"), "value")
    ranked = None
    for name, fn in methods.items():
        utility = fn(others, "x", ("sweep",)).select("sweep", "item_id", "pos", F.round("utility", evaluate.PLACES).alias("utility"), F.lit(name).alias("method"))
        ranked = utility if ranked is None else ranked.unionByName(utility)
    by = ("sweep", "method")
    ranked = evaluate.rank_items(ranked, by)
    baseline = evaluate.random_baseline(scores, target, value, props, seeds, permutations)
    groups = others.select("sweep").distinct().crossJoin(spark.createDataFrame([(m,) for m in methods], "method string"))  # metrics and methods are few
    targets = groups.crossJoin(baseline.select("prop", "target"))
    curve = {"correlation": lambda: evaluate.correlation_curve(scores, ranked, target, by=by), "clusters": lambda: evaluate.clusters_every_prefix(scores, ranked, target, by), "spa": lambda: evaluate.spa_every_prefix(scores, ranked, target, permutations, by=by)}
    if value not in curve:
        raise ValueError(f"unknown value: {value}")
    n = scores.select("item_id").distinct().count()
    found = evaluate.parity(curve[value](), targets, n, value, by=by).join(baseline.select("prop", "random_parity"), "prop")
    found = found.select(F.col("sweep").alias("metric"), "method", "prop", F.try_divide("parity", "random_parity").alias("parity"))
    return found.join(evaluate.metrics_correlations(scores, target).withColumnRenamed("correlation", "quality"), "metric")


def smoothing_weights(window: int, degree: int) -> np.ndarray:
    """Row p: weights of the window's rows for the polynomial's value at its place p; the last row: at its middle."""
    places = np.arange(window, dtype=float)
    basis = np.vander(places, degree + 1, increasing=True)
    at = np.vander(np.append(places, (window - 1) / 2), degree + 1, increasing=True)
    return at @ np.linalg.pinv(basis)


def smoothed(curves: DataFrame, x: str, y: str, window: int = 7, degree: int = 2, by: By = ()) -> DataFrame:
    """Adds smooth: the curve's local polynomial (Savitzky-Golay) at each row, rows ordered by x.

    A row gets the value in the middle of the least-squares polynomial through the window rows around it (an even window has one more row behind than before, and
    its middle lies between two rows); within half a window of an end, the polynomial through the first or last window rows at its own place. Curves with fewer rows
    use the largest window of the same parity that fits, and stay as they are where that has degree rows or fewer. All curves are one window.
    """
    if window < 1 or not 0 <= degree < window:
        raise ValueError("the window must be larger than the degree")
    order = Window.partitionBy(*by).orderBy(x)
    value = F.coalesce(F.col(y).cast("double"), F.lit(float("nan")))
    near = curves.withColumns({"i_": F.row_number().over(order) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy(*by)), "near_": F.collect_list(value).over(order.rowsBetween(-(window - 1), window - 1))})
    fits = F.least(F.lit(window), F.col("n_") - F.pmod(F.col("n_") - window, F.lit(2)))
    out = F.col(y).cast("double")
    for w in range(window, degree, -2):
        half = w // 2
        low, high = F.col("i_") < half, F.col("i_") >= F.col("n_") - half
        start = F.when(low, F.lit(0)).when(high, F.col("n_") - w).otherwise(F.col("i_") - (half if w % 2 else half - 1))  # the window's first row
        place = F.when(low | high, F.col("i_") - start).otherwise(w)
        first = start - F.greatest(F.lit(0), F.col("i_") - (window - 1))  # within near_
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in smoothing_weights(w, degree)])
        products = F.zip_with(F.slice("near_", (first + 1).cast("int"), F.lit(w)), F.element_at(rows, (place + 1).cast("int")), lambda a, b: a * b)
        out = F.when(fits == w, F.aggregate(products, F.lit(0.0), lambda s, v: s + v)).otherwise(out)
    return near.withColumn("smooth", out).drop("i_", "n_", "near_")
