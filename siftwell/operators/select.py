"""Selection: top k, budgets, documents and domains, samples, clustering and search based choices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import numeric
from siftwell.functions.columns import uniform
from siftwell.operators import evaluate, scorers
from siftwell.operators.lineage import written
from siftwell.operators.ranking import in_order

By = tuple[str, ...]

#: The open registry of scorers: name -> function of (tables, options) that returns item_id, pos, utility.
METHODS: dict[str, Callable[..., DataFrame]] = {}


def register_method(name: str, fn: Callable[..., DataFrame]) -> None:
    """Adds a scorer: fn(tables, metric, **options), tables being a dict with items, scores, outputs, vectors."""
    METHODS[name] = fn


def _defaults() -> None:
    register_method("random", lambda t, metric=None, seed=0, **_: scorers.random_utility(t["scores"], seed))
    register_method("metric_avg", lambda t, metric=None, **_: scorers.metric_avg(t["scores"], metric))
    register_method("metric_var", lambda t, metric=None, **_: scorers.metric_var(t["scores"], metric))
    register_method("metric_cons", lambda t, metric=None, metric_target=None, **_: scorers.metric_cons(t["scores"], metric, metric_target))
    for kind in ("bleu", "chrf", "unigram"):
        register_method(f"diversity_{kind}", lambda t, metric=None, kind=kind, **_: scorers.diversity(kind, t["outputs"]))
    register_method("diversity_lm", lambda t, metric=None, **_: scorers.diversity_dot(t["vectors"]))
    register_method("diversity", lambda t, metric="bleu", **_: scorers.diversity(metric, t["vectors" if metric.lower() == "lm" else "outputs"]))
    for kind in ("diff", "disc", "diffdisc", "feas", "fic"):
        register_method(f"pyirt_{kind}", lambda t, metric=None, kind=kind, model="4pl", binarize=False, **o: scorers.pyirt(t["scores"], metric, kind, model, binarize, **o))
    register_method("kmeans", lambda t, metric=None, budget=1, **o: kmeans(t["vectors"], budget, **o))
    register_method("diffuse", lambda t, metric=None, budget=1, **_: diffuse(t["vectors"], budget))
    register_method("bruteforce", lambda t, metric=None, budget=1, **o: bruteforce_greedy(t["scores"], budget, stepsize=budget, metric=metric or "human", **o))
    register_method("bruteforce_greedy", lambda t, metric=None, budget=1, **o: bruteforce_greedy(t["scores"], budget, metric=metric or "human", **o))
    register_method("combinator", lambda t, metric=None, methods=(), operation="avg", normalize="rank", **_: scorers.combine([_part(t, m, metric) for m in methods], operation, normalize))
    register_method("external", lambda t, metric=None, score=None, column="src", reverse=False, **_: scorers.external_scorer(t["items"], score, column, reverse))


def _part(tables: dict[str, DataFrame], spec, metric: str | None):
    """One part of a combination: a dict with method and options, or (dict, weight)."""
    if isinstance(spec, tuple | list):
        return _part(tables, spec[0], metric), float(spec[1])
    options = dict(spec)
    return METHODS[options.pop("method")](tables, **({"metric": metric} | options))


def basic(tables: dict[str, DataFrame], method: str, metric: str | None = None, digits: int | None = None, **options) -> DataFrame:
    """Scores with a registered method and ranks: item_id, pos, utility, rank. digits: utilities that are equal when rounded to so many digits are ties."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    found = METHODS[method](tables, metric=metric, **options)
    if digits is not None:
        found = found.withColumn("utility", F.round("utility", digits) + F.lit(0.0))
    return evaluate.rank_items(found)


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def costaware_greedy(items: DataFrame, budget: float, by: By = ()) -> DataFrame:
    """Takes items by utility per cost until the running cost reaches the budget: rank, spent."""
    worth = items.withColumn("worth_", F.try_divide("utility", "cost"))
    ranked = in_order(worth, "worth_", ["pos", "item_id"], running="cost", total="spent", by=by)
    return ranked.where(F.col("spent") < budget).drop("worth_")


def costaware(items: DataFrame, budget: float, strict: bool = True, scale: int = 1000, by: By = ()) -> DataFrame:
    """Exact 0/1 knapsack on utility rescaled to [0.1, 0.6] (scale has no effect), then the chosen items by utility while the running cost stays below the budget.

    strict: the budget itself must not be reached; otherwise it may be met exactly. Data sets (by) are solved in parallel.
    """
    types = dict(items.dtypes)
    cols = [*by, "item_id", "pos", "utility", "cost"]
    src = items.select(*cols)
    keys = list(by) or ["g_"]
    src = src if by else src.withColumn("g_", F.lit(0))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        u = pdf["utility"].to_numpy(float)
        span = u.max() - u.min()
        scaled = (u - u.min()) / span / 2 + 0.1 if span else np.full(len(u), 0.1)
        chosen = pdf.iloc[numeric.knapsack(scaled, pdf["cost"].to_numpy(float), budget, scale)].sort_values(["utility", "pos"], ascending=[False, True])
        spent = chosen["cost"].cumsum()
        keep = spent < budget if strict else spent <= budget + 1e-9
        # the walk stops at the first item that reaches the budget
        return chosen.assign(spent=spent)[keep.cummin().astype(bool)][[*cols, "spent"]]

    return src.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {types[c]}" for c in cols) + ", spent double")


def _documents(both: DataFrame, keys: list[str]) -> DataFrame:
    """Mean utility (rounded, since it is ordered by) and first position of each document."""
    return both.groupBy(*keys).agg(F.round(F.avg("utility"), 9).alias("doc_utility"), F.min("pos").alias("doc_first_"))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group; nulls are a group too."""
    groups = groups.withColumnsRenamed({k: f"{k}_of_" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in keys]
    return rows.join(groups, same).drop(*[f"{k}_of_" for k in keys])


def by_document(utility: DataFrame, docs: DataFrame) -> DataFrame:
    """Whole documents by their mean utility: rank. docs has item_id, doc."""
    both = utility.join(docs.select("item_id", "doc"), "item_id")
    both = _joined(both, _documents(both, ["doc"]), ["doc"])
    return in_order(both, "doc_utility", ["doc_first_", "pos", "item_id"]).drop("doc_first_")


def by_domain(utility: DataFrame, docs: DataFrame) -> DataFrame:
    """Interleaves the domains, best items first in each; domains in the order of their first item."""
    both = utility.join(docs.select("item_id", "domain"), "item_id")
    both = _joined(both, both.groupBy("domain").agg(F.min("pos").alias("first_")), ["domain"])
    both = in_order(both, "utility", ["pos", "item_id"], rank="turn_", by=("domain",))
    return in_order(both, "turn_", ["first_", "domain"], descending=False).drop("first_", "turn_")


def by_domain_document(utility: DataFrame, docs: DataFrame) -> DataFrame:
    """Interleaves the domains document by document; documents by mean utility inside their domain."""
    both = utility.join(docs.select("item_id", "domain", "doc"), "item_id")
    turns = in_order(_documents(both, ["domain", "doc"]), "doc_utility", ["doc_first_", "doc"], rank="turn_", by=("domain",))
    both = _joined(both, turns, ["domain", "doc"])
    both = _joined(both, both.groupBy("domain").agg(F.min("pos").alias("first_")), ["domain"])
    return in_order(both, "turn_", ["first_", "domain", "pos", "item_id"], descending=False).drop("first_", "turn_", "doc_first_")


def sample(items: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k items by a reproducible random order."""
    return items.orderBy(uniform(seed, F.col("item_id")), "item_id").limit(k)


def item_vectors(vectors: DataFrame, features: str = "src") -> DataFrame:
    """One vector for each item: src (the only one), tgt_0 (first system), tgt_rand (a random system), tgt_avg (their mean)."""
    keys = ["item_id", "pos"]
    if features == "src":
        return vectors.select(*keys, "embedding")
    if features in ("tgt_0", "tgt_rand"):
        order = F.col("system") if features == "tgt_0" else uniform(0, F.concat_ws("|", "item_id", "system"))
        return vectors.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "system"))).where("rn_ = 1").select(*keys, "embedding")
    if features == "tgt_avg":
        each = vectors.select(*keys, F.posexplode("embedding").alias("d_", "v_")).groupBy(*keys, "d_").agg(F.avg("v_").alias("v_"))
        return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d_", "v_"))), lambda s: s["v_"]).alias("embedding"))
    raise ValueError(f"unknown features: {features}")


def _centres(vectors: DataFrame, budget: int, seed: int) -> DataFrame:
    """item_id, pos, cluster, distance to the cluster's centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("item_id", "pos", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=budget, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    placed = model.transform(data).select("item_id", "pos", "cluster", vector_to_array("features").alias("v_"))
    square = F.aggregate(F.zip_with("v_", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return placed.join(F.broadcast(centres), "cluster").select("item_id", "pos", "cluster", square.alias("distance"))  # budget rows


def kmeans(vectors: DataFrame, budget: int, features: str = "src", seed: int = 0) -> DataFrame:
    """utility 1 for the item nearest to each of budget centres, 0 for others."""
    placed = _centres(item_vectors(vectors, features), budget, seed)
    near = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "pos", "item_id"))
    return placed.select("item_id", "pos", (near == 1).cast("double").alias("utility"))


def kmeans_supersample(vectors: DataFrame, budget: int, supersample: bool = False, features: str = "src", seed: int = 0) -> DataFrame:
    """The item nearest to each centre, repeated as often as its cluster is large if supersample."""
    placed = _centres(item_vectors(vectors, features), budget, seed)
    own = Window.partitionBy("cluster")
    best = placed.select("item_id", "pos", "cluster", F.row_number().over(own.orderBy("distance", "pos", "item_id")).alias("rn_"), F.count(F.lit(1)).over(own).cast("int").alias("size")).where("rn_ = 1")
    if not supersample:
        return best.select("item_id", "pos", "cluster", "size")
    return best.select("item_id", "pos", "cluster", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("copy"))


def diffuse(vectors: DataFrame, budget: int, by: By = ()) -> DataFrame:
    """Ward clusters of the items' vectors of pairwise output differences; utility 1 for the item nearest to each cluster's mean.

    Ward linkage needs all distances of a data set, so each data set (by) is one task.
    """
    keys = [*by, "item_id", "pos"]
    a = vectors.select(*keys, F.col("system").alias("a_"), F.col("embedding").alias("va_"))
    b = vectors.select(*keys, F.col("system").alias("b_"), F.col("embedding").alias("vb_"))
    mean = F.try_divide(F.aggregate(F.zip_with("va_", "vb_", lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x), F.size("va_"))
    pairs = a.join(b, keys).where("a_ < b_").select(*keys, F.struct("a_", "b_", mean.alias("d_")).alias("p_"))
    lists = pairs.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("p_")), lambda s: s["d_"]).alias("x_"))
    lists = lists if by else lists.withColumn("g_", F.lit(0))
    types = dict(lists.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        width = max(len(v) for v in pdf["x_"])
        x = np.array([list(v) + [0.0] * (width - len(v)) for v in pdf["x_"]])
        label, u = numeric.ward(x, budget), np.zeros(len(x))
        for c in np.unique(label):
            own = np.flatnonzero(label == c)
            u[own[np.argmin(((x[own] - x[own].mean(0)) ** 2).sum(1))]] = 1.0
        return pdf.assign(utility=u)[[*keys, "utility"]]

    return lists.groupBy(*(by or ("g_",))).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", utility double")


def bruteforce_greedy(scores: DataFrame, budget: int, stepsize: int = 10, simulations: int = 1000, metric: str = "human", permutations: int = 50, seed: int = 0) -> DataFrame:
    """Grows a subset by the best of many random extensions (by soft pairwise accuracy, equals by number) until it has budget items; utility 1 for the chosen.

    Simulations are a column: tasks draw the numbers of the items of each, a join brings their scores, and one aggregation gives the accuracy of all. The
    driver knows the number of items and the chosen numbers (budget of them), no scores.
    """
    spark = scores.sparkSession
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull())
    items = scores.select("item_id", "pos").distinct()
    places = in_order(own.select("item_id", "pos").distinct(), "pos", ["item_id"], descending=False, rank="place").select("item_id", (F.col("place") - 1).alias("place"))
    own = written(own.join(places, "item_id").select("item_id", "place", "system", "metric", "value"), "placed")
    n = own.select("place").distinct().count()
    full = evaluate.permutation_p(own, metric, permutations, seed + 1).withColumnRenamed("p", "full_").cache()
    chosen: list[int] = []
    while len(chosen) < min(budget, n):
        state, step, size = sorted(chosen), len(chosen), min(stepsize, n - len(chosen))

        def draw(batches, state=state, step=step, size=size):
            for b in batches:
                for k in b["id"]:
                    places = np.random.default_rng([seed, step, int(k)]).choice(n - step, size, replace=False)
                    for taken in state:  # from places among the rest to places among all
                        places = places + (places >= taken)
                    yield pd.DataFrame({"sim": k, "place": np.concatenate([np.array(state, dtype=np.int64), places]), "fresh": np.arange(step + size) >= step})

        drawn = spark.range(simulations).mapInPandas(draw, "sim long, place long, fresh boolean")
        p = evaluate.permutation_p(drawn.join(own, "place"), metric, permutations, seed, ("sim",))
        near = p.join(full, ["sys_i", "sys_j"]).groupBy("sim").agg(F.round(1 - F.avg(F.abs(F.col("p") - F.col("full_"))), evaluate.PLACES).alias("spa"))
        best = near.orderBy(F.desc("spa"), "sim").first()
        taken = drawn.where((F.col("sim") == (best["sim"] if best else 0)) & F.col("fresh"))  # a single system has no pairs: any extension is as good
        chosen += [r["place"] for r in taken.select("place").collect()]
    full.unpersist()
    marked = own.where(F.col("place").isin(chosen)).select("item_id").distinct().withColumn("utility", F.lit(1.0))
    return items.join(marked, "item_id", "left").select("item_id", "pos", F.coalesce("utility", F.lit(0.0)).alias("utility"))


_defaults()
