"""Meta-evaluation: how well a selected prefix reproduces what all items say about the systems.

Score tables are long (item_id, pos, system, metric, value); ranked tables have item_id and rank (from 1). System means
have system, mean. Systems are ordered by name wherever an order among equals is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import numeric
from siftwell.functions.columns import PROPS, uniform
from siftwell.operators.ranking import in_order, planned_buckets

By = tuple[str, ...]
#: Permutations whose signs one MD5 gives; rows whose signs a task holds at once; vectors that it adds up before it lets them go.
SIGNS, SIGNED_ROWS, HELD_VECTORS = 128, 2000, 10_000
#: Ranks of one bucket of a running mean over many items, and of one stretch of a scan of signed vectors.
BUCKET_RANKS, STRETCH_RANKS = 10_000, 256
#: Digits after which averages count as equal: the order in which tasks add up must not decide a comparison.
PLACES = 9


def kendall_columns(df: DataFrame, keys: list[str], name: str, x: str, y: str, variant: str = "b") -> DataFrame:
    """tau of x and y within each group of keys; 0 if a side is constant. One equi-join on the keys makes the pairs of systems."""
    a = df.select(*keys, F.col(name).alias("a_"), F.col(x).alias("xa_"), F.col(y).alias("ya_"))
    b = df.select(*keys, F.col(name).alias("b_"), F.col(x).alias("xb_"), F.col(y).alias("yb_"))
    pairs = a.join(b, keys) if keys else a.crossJoin(b)  # without keys there is one row for each system
    pairs = pairs.where("a_ < b_")
    dx, dy = F.signum(F.col("xa_") - F.col("xb_")), F.signum(F.col("ya_") - F.col("yb_"))
    sums = pairs.groupBy(*keys).agg(F.sum(dx * dy).alias("s_"), F.sum(F.abs(dx)).alias("nx_"), F.sum(F.abs(dy)).alias("ny_"))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.countDistinct(x).alias("ux_"), F.countDistinct(y).alias("uy_"))
    both = groups.join(sums, keys, "left") if keys else groups.crossJoin(sums)
    if variant == "c":
        m = F.least("ux_", "uy_")
        tau = F.when(m < 2, 0.0).otherwise(F.try_divide(2 * F.col("s_") * m, F.col("n_") * F.col("n_") * (m - 1)))
    else:
        tau = F.try_divide(F.col("s_"), F.sqrt(F.col("nx_") * F.col("ny_")))
    return both.select(*keys, F.coalesce(tau, F.lit(0.0)).alias("tau"))


def rank_items(utility: DataFrame, by: By = ()) -> DataFrame:
    """rank from 1: utility descending, ties in input order."""
    return in_order(utility, "utility", ["pos", "item_id"], by=by)


def model_absolute(scores: DataFrame, metric: str = "human", by: By = ()) -> DataFrame:
    """Mean of each system."""
    return scores.where(F.col("metric") == metric).groupBy(*by, "system").agg(F.avg("value").alias("mean"))


def model_ordering(scores: DataFrame, metric: str = "human", by: By = ()) -> DataFrame:
    """ord from 0, best first; means that are equal to PLACES digits keep the order of names."""
    order = Window.partitionBy(*by).orderBy(F.round("mean", PLACES).desc(), "system")
    return model_absolute(scores, metric, by).withColumn("ord", F.row_number().over(order) - 1)


def prefix(scores: DataFrame, ranked: DataFrame, k: Column | int, by: By = ()) -> DataFrame:
    """Scores of the first k items."""
    top = ranked.where(F.col("rank") <= k).select(*by, "item_id")
    return scores.join(top, [*by, "item_id"], "left_semi")


def both_means(new: DataFrame, old: DataFrame, metric: str | tuple[str, str] = "human", by: By = ()) -> DataFrame:
    """system, x (mean on new), y (mean on old). metric may be a pair: one for new, one for old."""
    m_new, m_old = (metric, metric) if isinstance(metric, str) else metric
    a = model_absolute(new, m_new, by).withColumnRenamed("mean", "x")
    return a.join(model_absolute(old, m_old, by).withColumnRenamed("mean", "y"), [*by, "system"])


def pairwise_accuracy(means: DataFrame, by: By = ()) -> DataFrame:
    """Share of pairs of systems that both sides order alike; two ties agree. Input: system, x, y."""
    keys = list(by)
    a = means.select(*keys, F.col("system").alias("a_"), F.col("x").alias("xa_"), F.col("y").alias("ya_"))
    b = means.select(*keys, F.col("system").alias("b_"), F.col("x").alias("xb_"), F.col("y").alias("yb_"))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("a_ < b_")
    same = (F.col("xa_") < F.col("xb_")) == (F.col("ya_") < F.col("yb_"))
    return pairs.groupBy(*keys).agg(F.avg(same.cast("double")).alias("accuracy"))


def top_match(means: DataFrame, by: By = ()) -> DataFrame:
    """1 minus the rank share that the best system by x has by y; a single system gives 1."""
    x = Window.partitionBy(*by).orderBy(F.desc("x"), "system")
    y = Window.partitionBy(*by).orderBy(F.desc("y"), "system")
    ranked = means.select(*by, F.row_number().over(x).alias("rx_"), (F.row_number().over(y) - 1).alias("ry_"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("m_"))
    return ranked.where("rx_ = 1").select(*by, F.when(F.col("m_") == 1, 1.0).otherwise(1 - F.try_divide(F.col("ry_").cast("double"), F.col("m_") - 1)).alias("top"))


def correlation(means: DataFrame, kind: str = "kendall", by: By = ()) -> DataFrame:
    """kendall (tau-b), spearman or pearson of x and y; 0 if a side is constant."""
    keys = list(by)
    if kind == "kendall":
        return kendall_columns(means, keys, "system", "x", "y", "b").withColumnRenamed("tau", "correlation")
    if kind == "spearman":
        rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
        means = means.select(*by, rank("x").alias("x"), rank("y").alias("y"))
    elif kind != "pearson":
        raise ValueError(f"unknown correlation: {kind}")
    return means.groupBy(*keys).agg(pearson("x", "y").alias("correlation"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r from sums; 0 for constant sides (those whose deviation is below 1e-12 of their size, whatever their scale)."""
    varies = lambda c: F.var_pop(c) > 1e-24 * F.avg(F.col(c) * F.col(c))
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
    return F.coalesce(F.when(varies(x) & varies(y), r), F.lit(0.0))


def error(means: DataFrame, kind: str = "absolute", by: By = ()) -> DataFrame:
    d = F.col("x") - F.col("y")
    value = {"absolute": F.avg(F.abs(d)), "squared": F.avg(d * d), "root": F.sqrt(F.avg(d * d))}.get(kind)
    if value is None:
        raise ValueError(f"unknown error: {kind}")
    return means.groupBy(*by).agg(value.alias("error"))


def metrics_correlations(scores: DataFrame, target: str = "human", by: By = ()) -> DataFrame:
    """Pearson of every metric with the target over all items and systems."""
    keys = [*by, "item_id", "system"]
    y = scores.where(F.col("metric") == target).select(*keys, F.col("value").alias("y_"))
    return scores.join(y, keys).groupBy(*by, "metric").agg(pearson("value", "y_").alias("correlation"))


def best_metric(scores: DataFrame, target: str = "human", by: By = ()) -> DataFrame:
    """The other metric that correlates best with the target; equals by name."""
    order = Window.partitionBy(*by).orderBy(F.desc("correlation"), "metric")
    found = metrics_correlations(scores, target, by).where(F.col("metric") != target)
    return found.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


# ---- significance clusters ------------------------------------------------------------------------------------------


def neighbour_differences(scores: DataFrame, metric: str = "human", by: By = ()) -> DataFrame:
    """Walk down the ordering: for each system but the best, its item-wise differences from the one before (ord, system, item_id, d)."""
    ordered = model_ordering(scores, metric, by)
    walk = ordered.select(*by, "system", "ord", F.lag("system").over(Window.partitionBy(*by).orderBy("ord")).alias("before_")).where("before_ IS NOT NULL")
    own = scores.where(F.col("metric") == metric).select(*by, "item_id", "system", "value")
    a = own.join(walk, [*by, "system"])
    b = own.select(*by, "item_id", F.col("system").alias("before_"), F.col("value").alias("v_"))
    return a.join(b, [*by, "item_id", "before_"]).select(*by, "ord", "system", "item_id", F.round(F.col("value") - F.col("v_"), 9).alias("d"))


def wilcoxon_z(differences: DataFrame, keys: list[str]) -> DataFrame:
    """n (non-zero differences), w (rank sum of the positive ones) and z of the signed-rank test, normal form with tie correction.

    Ranks are running counts of the distinct absolute differences, which with much data are cut into buckets of their size.
    """
    nonzero = differences.where("d <> 0").withColumn("s_", F.abs("d"))
    tied = nonzero.groupBy(*keys, "s_").agg(F.count(F.lit(1)).alias("t_"), F.sum((F.col("d") > 0).cast("long")).alias("p_"))
    ranks = in_order(tied, "s_", [], descending=False, rank="i_", running="t_", total="c_up_", by=tuple(keys))
    ranks = ranks.withColumn("r_", F.col("c_up_") - (F.col("t_") - 1) / 2)
    t = F.col("t_").cast("double")
    sums = ranks.groupBy(*keys).agg(F.sum("t_").alias("n"), F.sum(F.col("r_") * F.col("p_")).alias("w"), F.sum(t * t * t - t).alias("ties_"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties_") / 48))
    return differences.select(*keys).distinct().join(sums.select(*keys, "n", "w", z.alias("z")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def clusters(scores: DataFrame, metric: str = "human", mode: str = "normal", equal_splits: bool = True, by: By = ()) -> DataFrame:
    """ord, system, p or z, cluster (from 1, best first). A system opens a cluster if it is significantly worse than the one before.

    mode: normal (z against its critical value, all DataFrame operations), exact or auto (p by numpy, one task for each
    neighbouring pair). equal_splits: whether a system equal to the one before in all items opens a cluster. With fewer
    than three items all systems are one cluster.
    """
    ordered = model_ordering(scores, metric, by)
    d = neighbour_differences(scores, metric, by)
    keys = [*by, "ord"]
    enough = scores.where(F.col("metric") == metric).groupBy(*by).agg((F.countDistinct("item_id") >= 3).alias("enough_"))
    if mode == "normal":
        tested = wilcoxon_z(d, keys).select(*keys, "z", F.when(F.col("n") == 0, F.lit(equal_splits)).otherwise(F.coalesce(F.col("z") < numeric.CRITICAL_Z, F.lit(False))).alias("new_"))
        shown = ["z"]
    else:
        types = dict(d.dtypes)

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf["d"].to_numpy()
            equal = not (x != 0).any()
            p = numeric.wilcoxon_less(x, mode)
            return pdf[keys].head(1).assign(p=p, new_=equal_splits if equal else p < 0.05)

        tested = d.groupBy(*keys).applyInPandas(test, ", ".join(f"{k} {types[k]}" for k in keys) + ", p double, new_ boolean")
        shown = ["p"]
    both = ordered.join(tested, keys, "left")
    both = both.join(enough, list(by)) if by else both.crossJoin(enough)
    step = (F.coalesce("new_", F.lit(False)) & F.col("enough_")).cast("int")
    running = F.sum(step).over(Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.select(*by, "ord", "system", *shown, (running + 1).cast("long").alias("cluster"))


def cluster_count(scores: DataFrame, metric: str = "human", by: By = (), **options) -> DataFrame:
    return clusters(scores, metric, by=by, **options).groupBy(*by).agg(F.max("cluster").alias("clusters"))


def clusters_top(new: DataFrame, old: DataFrame, metric: str = "human", by: By = (), **options) -> DataFrame:
    """Dice overlap of the best clusters."""
    a = clusters(new, metric, by=by, **options).where("cluster = 1").select(*by, "system", F.lit(1).alias("a_"))
    b = clusters(old, metric, by=by, **options).where("cluster = 1").select(*by, "system", F.lit(1).alias("b_"))
    return a.join(b, [*by, "system"], "full").groupBy(*by).agg((2.0 * F.count(F.col("a_") + F.col("b_")) / (F.count("a_") + F.count("b_"))).alias("dice"))


# ---- soft pairwise accuracy -----------------------------------------------------------------------------------------


def sign_rows(seed: int, items: list[str], permutations: int) -> np.ndarray:
    """+1 or -1 for each item and permutation. One MD5 of seed, block and item gives the signs of 128 permutations."""
    out = np.empty((len(items), permutations))
    for block in range(-(-permutations // SIGNS)):
        raw = b"".join(hashlib.md5(f"{seed}:{block}:{x}".encode()).digest() for x in items)
        bits = np.unpackbits(np.frombuffer(raw, ">u4").astype("<u4").view(np.uint8), bitorder="little").reshape(len(items), SIGNS)
        at = block * SIGNS
        out[:, at : at + SIGNS] = 1.0 - 2.0 * bits[:, : permutations - at]
    return out


def permutation_p(scores: DataFrame, metric: str = "human", permutations: int = 1000, seed: int = 0, by: By = ()) -> DataFrame:
    """p of each pair of systems (sys_i before sys_j by name): share of sign flips whose difference reaches the real one.

    The signs depend on (seed, permutation, item), so all pairs share them. Each task adds up the signed values of its
    rows, a vector for each system of a group; the vectors are one aggregation, and the items never meet in one task.
    """
    keys = list(by)
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull()).select(*keys, "system", F.col("item_id").cast("string").alias("item_id"), F.col("value").cast("double").alias("value"))
    types = dict(own.dtypes)
    names = [*keys, "system"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=names)
            out["v_"] = list(held.values())
            held.clear()
            return out

        for whole in batches:
            for at in range(0, len(whole), SIGNED_ROWS):
                pdf = whole.iloc[at : at + SIGNED_ROWS]
                code, items = pd.factorize(pdf["item_id"])
                signs = sign_rows(seed, list(items), permutations)
                for key, rows in pdf.groupby(names, sort=False, dropna=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    total = pdf["value"].to_numpy()[rows] @ signs[code[rows]]
                    held[key] = held[key] + total if key in held else total
                if len(held) > HELD_VECTORS:
                    yield flush()
        if held:
            yield flush()

    parts = own.mapInPandas(add, "".join(f"{k} {types[k]}, " for k in names) + "v_ array<double>")
    sums = parts.select(*names, F.posexplode("v_").alias("perm", "v_")).groupBy(*keys, "perm", "system").agg(F.round(F.sum("v_"), 6).alias("s_"))
    real = own.groupBy(*keys, "system").agg(F.round(F.sum("value"), 6).alias("r_"))
    both = sums.join(real, [*keys, "system"])
    a = both.select(*keys, "perm", F.col("system").alias("sys_i"), F.col("s_").alias("si_"), F.col("r_").alias("ri_"))
    b = both.select(*keys, "perm", F.col("system").alias("sys_j"), F.col("s_").alias("sj_"), F.col("r_").alias("rj_"))
    pairs = a.join(b, [*keys, "perm"]).where("sys_i < sys_j")
    reached = F.round(F.col("si_") - F.col("sj_"), 5) >= F.round(F.col("ri_") - F.col("rj_"), 5)
    return pairs.groupBy(*keys, "sys_i", "sys_j").agg(F.avg(reached.cast("double")).alias("p"))


def soft_accuracy(p_new: DataFrame, p_old: DataFrame, by: By = ()) -> DataFrame:
    """1 minus the mean absolute difference of the p values."""
    keys = [*by, "sys_i", "sys_j"]
    both = p_new.withColumnRenamed("p", "a_").join(p_old.withColumnRenamed("p", "b_"), keys)
    return both.groupBy(*by).agg((1 - F.avg(F.abs(F.col("a_") - F.col("b_")))).alias("spa"))


def spa(new: DataFrame, old: DataFrame, metric: str | tuple[str, str] = "human", permutations: int = 1000, seed: int = 0, by: By = ()) -> DataFrame:
    m_new, m_old = (metric, metric) if isinstance(metric, str) else metric
    return soft_accuracy(permutation_p(new, m_new, permutations, seed, by), permutation_p(old, m_old, permutations, seed + 1, by), by)


# ---- curves over prefixes -------------------------------------------------------------------------------------------


def proportions(spark: SparkSession, n: int, props: list[float] | None = None) -> DataFrame:
    """prop and the prefix size k = floor(n * prop)."""
    return spark.createDataFrame([(float(p), int(n * p)) for p in (props or PROPS)], "prop double, k long")


def at_proportions(scores: DataFrame, ranked: DataFrame, props: DataFrame, by: By = ()) -> DataFrame:
    """The scores of every prefix, tagged with prop and k. props has a row for each point of the curve.

    by may name columns that ranked alone has (the seed of a random order).
    """
    tagged = ranked.select(*by, "item_id", "rank").join(F.broadcast(props), F.col("rank") <= F.col("k")).drop("rank")
    return scores.join(tagged, [*shared(scores, by), "item_id"])


def shared(scores: DataFrame, by: By) -> list[str]:
    """The grouping columns that the scores have."""
    return [c for c in by if c in scores.columns]


def prefix_means(scores: DataFrame, ranked: DataFrame, metric: str = "human", by: By = (), buckets: bool | None = None) -> DataFrame:
    """Means of each system on every prefix at once: one cumulative window instead of a scan for each k. system, k, x.

    With much data (or buckets) the ranks are cut into stretches of BUCKET_RANKS: the window runs within a stretch, and
    the sums of the stretches before it are added, so that no task walks through all items of a system.
    by may name columns that ranked alone has (the seed of a random order): each order then meets the same scores.
    """
    own = scores.where(F.col("metric") == metric).join(ranked.select(*by, "item_id", "rank"), [*shared(scores, by), "item_id"])
    return running_means(own, by, planned_buckets(scores) > 1 if buckets is None else buckets)


def running_means(own: DataFrame, by: By, cut: bool) -> DataFrame:
    """system, k, x of rows (by, system, rank, value): means of the values up to each rank, nulls left out."""
    keys = [*by, "system"]
    if not cut:
        running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return own.select(*keys, F.col("rank").alias("k"), F.avg("value").over(running).alias("x"))
    own = own.select(*keys, "rank", "value", F.expr(f"(rank - 1) DIV {BUCKET_RANKS}").alias("b_"))
    before = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*keys, "b_").agg(F.sum("value").alias("s_"), F.count("value").alias("c_"))
    sums = sums.select(*keys, "b_", F.coalesce(F.sum("s_").over(before), F.lit(0.0)).alias("s_"), F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("c_"))
    running = Window.partitionBy(*keys, "b_").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = own.select(*keys, "b_", F.col("rank").alias("k"), F.coalesce(F.sum("value").over(running), F.lit(0.0)).alias("v_"), F.count("value").over(running).alias("n_"))
    return here.join(sums, [*keys, "b_"]).select(*keys, "k", F.try_divide(F.col("v_") + F.col("s_"), F.col("n_") + F.col("c_")).alias("x"))


def grid(scores: DataFrame, ranked: DataFrame, metric: str, by: By = ()) -> DataFrame:
    """rank, item_id, cells (system to value), systems (all of the group, by name): one row for each item of each ranking."""
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull()).join(ranked.select(*by, "item_id", "rank"), [*shared(scores, by), "item_id"])
    own = own.groupBy(*by, "rank", F.col("item_id").cast("string").alias("item_id"), "system").agg(F.avg(F.col("value").cast("double")).alias("value"))
    cells = own.groupBy(*by, "rank", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("system", "value"))).alias("cells"))  # as many as there are systems
    names = own.groupBy(*by).agg(F.array_sort(F.collect_set("system")).alias("systems"))
    return cells.join(names, list(by)) if by else cells.crossJoin(F.broadcast(names))  # without groups, names is one row


def correlation_curve(scores: DataFrame, ranked: DataFrame, metric: str | tuple[str, str] = "human", kind: str = "kendall", by: By = ()) -> DataFrame:
    """k, correlation of the prefix means with the full means, for every k."""
    m_new, m_old = (metric, metric) if isinstance(metric, str) else metric
    own = shared(scores, by)
    means = prefix_means(scores, ranked, m_new, by).join(model_absolute(scores, m_old, tuple(own)).withColumnRenamed("mean", "y"), [*own, "system"])
    means = means.withColumn("x", F.round("x", 9)).withColumn("y", F.round("y", 9))
    return correlation(means, kind, (*by, "k"))


def parity(curve: DataFrame, targets: DataFrame, n: int, value: str = "correlation", least: int = 5, by: By = ()) -> DataFrame:
    """For each target (prop, target): the least k >= least whose value reaches it (else n), divided by n * prop. Both sides are rounded to PLACES digits."""
    hit = curve.where(F.col("k") >= least).join(targets, list(by)) if by else curve.where(F.col("k") >= least).crossJoin(F.broadcast(targets))
    first = hit.where(F.round(value, PLACES) >= F.round("target", PLACES)).groupBy(*by, "prop").agg(F.min("k").alias("k"))
    return targets.join(first, [*by, "prop"], "left").select(*by, "prop", F.coalesce("k", F.lit(n)).alias("k"), (F.coalesce("k", F.lit(n)) / (n * F.col("prop"))).alias("parity"))


def cluster_curve(scores: DataFrame, ranked: DataFrame, props: DataFrame, metric: str = "human", by: By = (), **options) -> DataFrame:
    """prop, clusters: the number of significance clusters on each prefix of the ranking."""
    tagged = at_proportions(scores, ranked, props, by)
    return cluster_count(tagged, metric, (*by, "prop"), **options)


def clusters_every_prefix(scores: DataFrame, ranked: DataFrame, metric: str = "human", by: By = (), equal_splits: bool = True) -> DataFrame:
    """k, clusters: the number of significance clusters (normal form) on every prefix of the rankings.

    Which systems are neighbours changes along a ranking, so each pair of systems gets the statistic of its signed ranks on all prefixes, from counts of
    earlier smaller differences; the running means then say which pairs count at which prefix. A task holds the differences of one pair of systems.
    """
    cells = grid(scores, ranked, metric, by)
    i = F.sequence(F.lit(0), F.size("systems") - 1)
    pairs = F.flatten(F.transform(i, lambda a: F.transform(F.filter(i, lambda b: b > a), lambda b: F.struct(F.get("systems", a).alias("a_"), F.get("systems", b).alias("b_")))))
    value = lambda name: F.try_element_at("cells", F.col(name))
    apart = cells.select(*by, "rank", "cells", F.explode(pairs).alias("p_")).select(*by, "rank", "cells", "p_.*")
    apart = apart.select(*by, "a_", "b_", "rank", F.round(value("a_") - value("b_"), PLACES).alias("d_"))
    types = dict(apart.dtypes)
    keys = [*by, "a_", "b_"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        n, z = numeric.running_signed_ranks(pdf["d_"].to_numpy(float))
        return pdf[keys].assign(k=pdf["rank"].to_numpy(), n_=n, z_=z)

    tested = apart.groupBy(*keys).applyInPandas(test, "".join(f"{k} {types[k]}, " for k in keys) + "k long, n_ long, z_ double")
    own = cells.select(*by, "rank", "cells", F.explode("systems").alias("system")).withColumn("value", value("system"))
    means = running_means(own.select(*by, "rank", "system", "value"), by, planned_buckets(scores) > 1)
    here = Window.partitionBy(*by, "k").orderBy(F.round("x", PLACES).desc_nulls_last(), "system")
    walk = means.select(*by, F.col("k").cast("long").alias("k"), "system", F.lag("system").over(here).alias("before_"))
    asked = walk.select(*by, "k", F.least("system", "before_").alias("a_"), F.greatest("system", "before_").alias("b_"), (F.col("system") < F.col("before_")).alias("up_"), F.col("before_").isNull().alias("first_"))
    both = asked.join(tested, [*keys, "k"], "left")
    new = F.when(F.col("first_"), False).when(F.col("n_") == 0, equal_splits).otherwise(F.coalesce(F.when(F.col("up_"), F.col("z_")).otherwise(-F.col("z_")) < numeric.CRITICAL_Z, F.lit(False)))
    return both.groupBy(*by, "k").agg(F.when(F.col("k") < 3, F.lit(1)).otherwise(1 + F.sum(new.cast("int"))).cast("long").alias("clusters"))


def cluster_parity(scores: DataFrame, ranked: DataFrame, targets: DataFrame, n: int, metric: str = "human", least: int = 5, by: By = ()) -> DataFrame:
    """For each target (prop, target): the least prefix of least items or more that has so many clusters (else n), divided by n * prop."""
    return parity(clusters_every_prefix(scores, ranked, metric, by), targets, n, "clusters", least, by)


def random_curve(scores: DataFrame, items: DataFrame, metric: str = "human", seeds: list[int] | None = None, kind: str = "kendall") -> DataFrame:
    """Mean correlation curve of random orders; seeds are rows, so that all orders are one job."""
    ranked = seeded_ranks(items, seeds or list(range(10)))
    return correlation_curve(scores, ranked, metric, kind, ("seed",)).groupBy("k").agg(F.avg("correlation").alias("correlation"))


def spa_curve(scores: DataFrame, ranked: DataFrame, metric: str = "human", props: DataFrame | None = None, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """prop, spa. The p values on all items are made once."""
    tagged = at_proportions(scores, ranked, props)
    new = permutation_p(tagged, metric, permutations, seed, ("prop",))
    old = permutation_p(scores, metric, permutations, seed + 1)
    both = new.withColumnRenamed("p", "a_").join(old.withColumnRenamed("p", "b_"), ["sys_i", "sys_j"])
    return both.groupBy("prop").agg((1 - F.avg(F.abs(F.col("a_") - F.col("b_")))).alias("spa"))


def spa_every_prefix(scores: DataFrame, ranked: DataFrame, metric: str = "human", permutations: int = 1000, seed: int = 0, by: By = ()) -> DataFrame:
    """k, spa of every prefix of the rankings with all items: what spa_curve gives at the same k.

    A prefix scan in three steps: the signed sums of each stretch of STRETCH_RANKS ranks, their running sums over the stretches, and a walk through each stretch
    from the sums before it. A task holds one stretch of one ranking and a vector of permutations for each system.
    """
    keys = [*by, "s_"]
    cells = grid(scores, ranked, metric, by).withColumn("s_", F.expr(f"(rank - 1) DIV {STRETCH_RANKS}"))
    cells = cells.select(*keys, "rank", "item_id", "systems", F.transform("systems", lambda x: F.coalesce(F.try_element_at("cells", x), F.lit(float("nan")))).alias("values"))
    types = dict(cells.dtypes)
    kinds = "".join(f"{k} {types[k]}, " for k in keys)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["values"].tolist())
        known = ~np.isnan(m)
        m = np.where(known, m, 0.0)
        total = np.concatenate([sign_rows(seed, pdf["item_id"].tolist(), permutations).T @ m, [m.sum(0), known.sum(0)]])  # the last rows: without signs, and how many
        names = list(pdf["systems"].iloc[0])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "system": names, "v_": list(total.T)})

    parts = cells.groupBy(*keys).applyInPandas(sums, kinds + "system string, v_ array<double>")
    each = parts.select(*keys, "system", F.posexplode("v_").alias("perm_", "v_"))
    before = Window.partitionBy(*by, "system", "perm_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*keys, "system", "perm_", F.coalesce(F.sum("v_").over(before), F.lit(0.0)).alias("v_"))
    offsets = offsets.groupBy(*keys, "system").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm_", "v_"))), lambda x: x["v_"]).alias("v_"))

    def walk(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, start = pdf.sort_values("rank"), start.sort_values("system")
        names = start["system"].to_numpy()
        total = np.array(start["v_"].tolist()).T
        total, real, seen = total[:-2], total[-2], total[-1]
        i, j = np.triu_indices(len(names), 1)
        signs, m = sign_rows(seed, pdf["item_id"].tolist(), permutations), np.array(pdf["values"].tolist())
        p = np.empty((len(m), len(i)))
        for r, row in enumerate(m):
            seen, row = seen + ~np.isnan(row), np.nan_to_num(row)
            total, real = total + signs[r][:, None] * row, real + row
            s, x = np.round(total, 6), np.round(real, 6)
            p[r] = np.where((seen[i] > 0) & (seen[j] > 0), (np.round(s[:, i] - s[:, j], 5) >= np.round(x[i] - x[j], 5)).mean(0), np.nan)
        n, k = len(i), pdf["rank"].to_numpy()
        out = pd.DataFrame({**{x: pdf[x].iloc[0] for x in by}, "k": np.repeat(k, n), "sys_i": np.tile(names[i], len(k)), "sys_j": np.tile(names[j], len(k)), "p": p.ravel()})
        return out.dropna(subset="p")  # a pair counts once both systems have a score

    schema = "".join(f"{k} {types[k]}, " for k in by) + "k long, sys_i string, sys_j string, p double"
    new = cells.groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInPandas(walk, schema)
    own = shared(scores, by)
    old = permutation_p(scores, metric, permutations, seed + 1, tuple(own))
    both = new.withColumnRenamed("p", "a_").join(old.withColumnRenamed("p", "b_"), [*own, "sys_i", "sys_j"])
    return both.groupBy(*by, "k").agg((1 - F.avg(F.abs(F.col("a_") - F.col("b_")))).alias("spa"))


def seeded_ranks(items: DataFrame, seeds: list[int]) -> DataFrame:
    """seed, item_id, pos, rank: random orders, all seeds as rows of one job."""
    seeded = items.select("item_id", "pos").distinct().select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    return rank_items(seeded.withColumn("utility", uniform(F.col("seed"), F.col("item_id"))), ("seed",))


def random_baseline(scores: DataFrame, metric: str = "human", value: str = "correlation", props: list[float] | None = None, seeds: int = 10, permutations: int = 1000) -> DataFrame:
    """prop, target (mean curve of the first seeds at the proportions), random_parity (mean parity of as many further seeds against it). value: correlation, clusters or spa."""
    spark, items = scores.sparkSession, scores.select("item_id", "pos").distinct()
    n = items.count()
    points = proportions(spark, n, props)

    def curves(numbers: list[int]) -> DataFrame:
        ranked = seeded_ranks(items, numbers)
        return correlation_curve(scores, ranked, metric, "kendall", ("seed",)) if value == "correlation" else spa_every_prefix(scores, ranked, metric, permutations, by=("seed",))

    first, further = list(range(seeds)), list(range(seeds, 2 * seeds))
    if value == "clusters":
        found = cluster_curve(scores, seeded_ranks(items, first), points, metric, ("seed",))
        targets = found.groupBy("prop").agg(F.round(F.avg("clusters"), PLACES).alias("target"))
    else:
        targets = curves(first).join(points, "k").groupBy("prop").agg(F.round(F.avg(value), PLACES).alias("target"))
    each = targets.select("prop", "target", F.explode(F.array(*[F.lit(s) for s in further])).alias("seed"))
    found = cluster_parity(scores, seeded_ranks(items, further), each, n, metric, by=("seed",)) if value == "clusters" else parity(curves(further), each, n, value, by=("seed",))
    return found.groupBy("prop").agg(F.avg("parity").alias("random_parity")).join(targets, "prop")


def parity_normalized(scores: DataFrame, ranked: DataFrame, baseline: DataFrame, metric: str = "human", value: str = "correlation", permutations: int = 1000) -> DataFrame:
    """prop, parity of an order divided by the random one's. baseline comes from random_baseline and can be kept for many methods."""
    n = scores.select("item_id").distinct().count()
    targets = baseline.select("prop", "target")
    if value == "clusters":
        own = cluster_parity(scores, ranked, targets, n, metric)
    else:
        own = parity(correlation_curve(scores, ranked, metric) if value == "correlation" else spa_every_prefix(scores, ranked, metric, permutations), targets, n, value)
    return own.join(baseline.select("prop", "random_parity"), "prop").select("prop", F.try_divide("parity", "random_parity").alias("parity"))


def confidence_bands(scores: DataFrame, by: By, confidence: float = 0.95) -> DataFrame:
    """Mean and Student interval (population deviation as scale) of value in each group."""
    stats = scores.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s_"), F.count("value").alias("n_"))

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: numeric.student_quantile(0.5 + confidence / 2, k - 1) if k > 1 else np.nan for k in n.unique()}
        return n.map(known)

    half = quantile("n_") * F.col("s_")
    return stats.withColumn("half_", half).select(*by, "mean", (F.col("mean") - F.col("half_")).alias("low"), (F.col("mean") + F.col("half_")).alias("high"))
