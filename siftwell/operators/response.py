"""Item-response models fitted over many items: items are independent once the systems' abilities are known.

A fit alternates. Given the abilities, every item is fitted by itself, in Arrow batches of items; the slopes and curvatures of the abilities are added up over the
batches and move the abilities by one damped Newton step. So no task holds the matrix of a data set, and what goes round is one row of abilities for each
data set (systems are few). Data sets (by) are fitted side by side. Scores lie in [0, 1]; missing ones are left out.

With features, an item's parameters are linear functions of its vector, so they are known for items without scores too; there the gradients of the shared
weights are added up over the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.columns import words
from siftwell.operators.gradients import Adam, summed
from siftwell.operators.lineage import written
from siftwell.operators.normalize import median_binarize, minmax

By = tuple[str, ...]
#: Rounds of an alternating fit, and steps of an item's fit in each.
ROUNDS, STEPS = 10, 40


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cells_of(scores: DataFrame, metric: str, by: By = (), scale: str = "unit") -> DataFrame:
    """by, item_id, pos, systems (all of the data set, by name), y (their values, null where missing). scale: binary (from the median up), unit (0 to 1) or none."""
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull()).select(*by, "item_id", "pos", "system", "metric", F.col("value").cast("double").alias("value"))
    if scale != "none":
        own = median_binarize(own, by) if scale == "binary" else minmax(own, by)
    names = own.groupBy(*by).agg(F.array_sort(F.collect_set("system")).alias("systems"))
    cells = own.groupBy(*by, "item_id", "pos", "system").agg(F.avg("value").alias("value")).groupBy(*by, "item_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("system", "value"))).alias("c_"))
    both = cells.join(names, list(by)) if by else cells.crossJoin(F.broadcast(names))  # without data sets, names is one row
    return both.select(*by, "item_id", "pos", "systems", F.transform("systems", lambda s: F.try_element_at("c_", s)).alias("y"))


def with_theta(cells: DataFrame, theta: DataFrame, by: By) -> DataFrame:
    theta = theta.select(*by, "theta")
    return cells.join(theta, list(by)) if by else cells.crossJoin(F.broadcast(theta))  # without data sets, theta is one row


def matrix(lists: pd.Series) -> np.ndarray:
    return np.array([np.array(x, float) for x in lists])


class Curve:
    """One ability: feas + (1 - feas) * sigmoid(disc * (theta - diff)), fitted on the cross-entropy with normal priors. model: 1pl (diff), 2pl (and disc), 4pl (and feas, in [0.01, 0.99])."""

    names = ("diff", "disc", "feas")

    def __init__(self, model: str) -> None:
        if model not in ("1pl", "2pl", "4pl"):
            raise ValueError(f"unknown model: {model}")
        self.free = {"1pl": 1, "2pl": 2, "4pl": 3}[model]
        self.dims = 1

    def parts(self, y: np.ndarray, theta: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted errors, weights, and slopes of the prediction in (diff, disc, feas) and in theta."""
        z = theta[:, 0] - p[:, :1]
        s = sigmoid(p[:, 1:2] * z)
        low = p[:, 2:] if self.free == 3 else np.zeros_like(p[:, 2:])
        q = np.clip(low + (1 - low) * s, 1e-6, 1 - 1e-6)
        weight = np.where(np.isnan(y), 0.0, 1 / (q * (1 - q)))
        inner = (1 - low) * s * (1 - s)
        return weight * (q - np.nan_to_num(y)), weight, np.stack([-inner * p[:, 1:2], inner * z, 1 - s], 2), inner * p[:, 1:2]

    def fit(self, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
        p = np.tile([0.0, 1.0, 0.05 if self.free == 3 else 0.0], (len(y), 1))
        firm, rest = np.array([0.1, 0.5, 2.0]), np.array([0.0, 1.0, 0.05])
        for _ in range(STEPS):
            error, weight, slopes, _ = self.parts(y, theta, p)
            step = ((error[:, :, None] * slopes).sum(1) + firm * (p - rest)) / ((weight[:, :, None] * slopes**2).sum(1) + firm)
            p[:, : self.free] -= 0.6 * np.clip(step[:, : self.free], -0.5, 0.5)
            if self.free == 3:
                p[:, 2] = np.clip(p[:, 2], 0.01, 0.99)
        return p

    def abilities(self, y: np.ndarray, theta: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes and curvatures of the loss in the abilities, added up over the items."""
        error, weight, _, slope = self.parts(y, theta, p)
        return (error * slope).sum(0)[:, None], (weight * slope**2).sum(0)[:, None, None]


class Plane:
    """Several abilities: sigmoid(sum of disc * theta - diff), squared priors around 0.5 and 0."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        self.names = (*(f"disc{k}" for k in range(dims)), "diff")

    def parts(self, y: np.ndarray, theta: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = sigmoid(p[:, :-1] @ theta.T - p[:, -1:])
        known = ~np.isnan(y)
        return np.where(known, q - np.nan_to_num(y), 0.0), np.where(known, np.maximum(q * (1 - q), 1e-6), 0.0)

    def fit(self, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
        x = np.column_stack([theta, -np.ones(len(theta))])
        rest = np.append(np.full(self.dims, 0.5), 0.0)
        p = np.tile(rest, (len(y), 1))
        for _ in range(STEPS // 4):  # whole Newton steps
            error, weight = self.parts(y, theta, p)
            curve = np.einsum("ns,sa,sb->nab", weight, x, x) + 0.1 * np.eye(len(rest))
            p -= np.clip(np.linalg.solve(curve, (error @ x + 0.1 * (p - rest))[:, :, None])[:, :, 0], -1, 1)
        return p

    def abilities(self, y: np.ndarray, theta: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        error, weight = self.parts(y, theta, p)
        d = p[:, :-1]
        return error.T @ d, np.einsum("ns,na,nb->sab", weight, d, d)


def each_data_set(batches: Iterator[pd.DataFrame], by: By) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for b in batches:
        if by:
            yield from ((k if isinstance(k, tuple) else (k,), part) for k, part in b.groupby(list(by), sort=False, dropna=False))
        elif len(b):
            yield (), b


def alternate(cells: DataFrame, model: Curve | Plane, by: By = (), rounds: int = ROUNDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Items (by, item_id, pos, parameters) and abilities (by, systems, theta: flattened, systems times dimensions)."""
    d, types = model.dims, dict(cells.dtypes)
    kinds = "".join(f"{k} {types[k]}, " for k in by)
    means = cells.select(*by, "systems", F.posexplode("y").alias("s_", "v_")).groupBy(*by, "systems", "s_").agg(F.avg("v_").alias("v_"))
    logit = F.log(F.greatest(F.least("v_", F.lit(0.99)), F.lit(0.01)) / (1 - F.greatest(F.least("v_", F.lit(0.99)), F.lit(0.01))))
    start = means.select(*by, "systems", "s_", logit.alias("v_")).withColumn("v_", F.col("v_") - F.avg("v_").over(Window.partitionBy(*by, "systems")))
    start = start.groupBy(*by, "systems").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_", "v_"))), lambda x: x["v_"]).alias("v_"))
    jitter = np.random.default_rng(seed).normal(0, 0.3, (1000, d))  # tells the dimensions apart; none for one

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            theta = [(np.array(v, float)[:, None] + (jitter[np.arange(len(v)) % 1000] if d > 1 else 0)).ravel() for v in b["v_"]]
            yield b[[*by, "systems"]].assign(theta=theta)

    def slopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for key, part in each_data_set(batches, by):
            y, theta = matrix(part["y"]), np.array(part["theta"].iloc[0], float).reshape(-1, d)
            g, h = model.abilities(y, theta, model.fit(y, theta))
            total = np.concatenate([g.ravel(), h.ravel()])
            held[key] = held[key] + total if key in held else total
        if held:
            yield pd.DataFrame(list(held), columns=list(by)).assign(v_=list(held.values())) if by else pd.DataFrame({"v_": list(held.values())})

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for old, sums in zip(b["theta"], b["sums_"], strict=True):
                theta, sums = np.array(old, float).reshape(-1, d), np.array(sums, float)
                g, h = sums[: theta.size].reshape(-1, d) + 0.1 * theta, sums[theta.size :].reshape(-1, d, d) + 0.1 * np.eye(d)
                theta = theta - np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -1, 1)
                out.append((theta - theta.mean(0) if d > 1 else theta).ravel())
            yield b[[*by, "systems"]].assign(theta=out)

    state = f"{kinds}systems array<string>, theta array<double>"
    theta = written(start.mapInPandas(begin, state), "abilities")
    for _ in range(rounds):
        sums = with_theta(cells, theta, by).select(*by, "y", "theta").mapInPandas(slopes, kinds + "v_ array<double>").select(*by, F.posexplode("v_").alias("i_", "v_"))
        sums = sums.groupBy(*by, "i_").agg(F.sum("v_").alias("v_")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "v_"))), lambda x: x["v_"]).alias("sums_"))
        both = theta.join(sums, list(by)) if by else theta.crossJoin(F.broadcast(sums))  # one row for each data set
        theta = written(both.mapInPandas(move, state), "abilities")

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in each_data_set(batches, by):
            p = model.fit(matrix(part["y"]), np.array(part["theta"].iloc[0], float).reshape(-1, d))
            yield part[[*by, "item_id", "pos"]].assign(**{x: p[:, i] for i, x in enumerate(model.names)})

    fitted = with_theta(cells, theta, by).select(*by, "item_id", "pos", "y", "theta")
    return fitted.mapInPandas(items, f"{kinds}item_id {types['item_id']}, pos {types['pos']}, " + ", ".join(f"{x} double" for x in model.names)), theta


def irt_fit(scores: DataFrame, metric: str, model: str = "2pl", binarize: bool = True, rounds: int = ROUNDS, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, pos, diff, disc, feas) and systems (system, theta) of a one-dimensional model; the mirror image that puts better systems higher."""
    cells = written(cells_of(scores, metric, by, "binary" if binarize else "unit"), "cells")
    items, theta = alternate(cells, Curve(model), by, rounds)
    items = written(items, "item-parameters")
    side = items.groupBy(*by).agg(F.when(F.avg("disc") < 0, -1.0).otherwise(1.0).alias("side_"))
    turned = items.join(side, list(by)) if by else items.crossJoin(F.broadcast(side))
    systems = theta.select(*by, F.explode(F.arrays_zip("systems", "theta")).alias("x_"))
    systems = systems.join(side, list(by)) if by else systems.crossJoin(F.broadcast(side))
    return (
        turned.select(*by, "item_id", "pos", (F.col("side_") * F.col("diff")).alias("diff"), (F.col("side_") * F.col("disc")).alias("disc"), "feas"),
        systems.select(*by, F.col("x_.systems").alias("system"), (F.col("side_") * F.col("x_.theta")).alias("theta")),
    )


def multidimensional_irt(scores: DataFrame, metric: str, dimensions: int = 2, rounds: int = ROUNDS, seed: int = 0, by: By = ()) -> DataFrame:
    """item_id, pos, diff, disc_sum: sigmoid(sum over dimensions of disc * theta - diff) on scores scaled to [0, 1]."""
    cells = written(cells_of(scores, metric, by, "unit"), "cells")
    items, _ = alternate(cells, Plane(dimensions), by, rounds, seed)
    return items.select(*by, "item_id", "pos", "diff", sum((F.col(f"disc{k}") for k in range(dimensions)), F.lit(0.0)).alias("disc_sum"))


# ---- parameters as functions of features ----------------------------------------------------------------------------


def tfidf_vectors(items: DataFrame, features: int = 256) -> DataFrame:
    """item_id, pos, embedding: hashed words of src, weighted by their rarity, of length 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    data = items.select("item_id", "pos", words(F.lower(F.coalesce("src", F.lit("")))).alias("tokens"))
    model = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="v")]).fit(data)
    return model.transform(data).select("item_id", "pos", vector_to_array("v").alias("embedding"))


class FeatureModel:
    """Weights of (diff, disc, feas) for each feature and a constant, and abilities of the systems."""

    def __init__(self, width: int, systems: list[str]) -> None:
        self.systems = systems
        self.weights = np.zeros((width + 1, 3))
        self.theta = np.zeros(len(systems))
        self.weights[-1] = 0.0, 1.0, -3.0

    def parameters(self, x: np.ndarray) -> np.ndarray:
        """diff, disc, feas of items with these vectors; feas through a sigmoid."""
        p = np.column_stack([x, np.ones(len(x))]) @ self.weights
        return np.column_stack([p[:, 0], p[:, 1], sigmoid(p[:, 2])])

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slopes of the squared error, added up over the cells; the last two are the error and the number of cells."""
        p = self.parameters(x)
        z = self.theta - p[:, :1]
        s = sigmoid(p[:, 1:2] * z)
        low = p[:, 2:]
        error = np.where(np.isnan(y), 0.0, low + (1 - low) * s - np.nan_to_num(y))
        inner = error * (1 - low) * s * (1 - s)
        own = np.column_stack([-(inner * p[:, 1:2]).sum(1), (inner * z).sum(1), (error * (1 - s) * low * (1 - low)).sum(1)])
        return np.concatenate([(np.column_stack([x, np.ones(len(x))]).T @ own).ravel(), (inner * p[:, 1:2]).sum(0), [(error**2).sum(), (~np.isnan(y)).sum()]])


def feature_irt(scores: DataFrame, vectors: DataFrame, metric: str, rounds: int = 60, rate: float = 0.1, ridge: float = 1e-4, scale: str = "unit") -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Items (item_id, pos, diff, disc, feas) of all vectors, systems (system, theta), and a function that gives parameters of further vectors.

    feas + (1 - feas) * sigmoid(disc * (theta - diff)) with parameters linear in an item's vector (item_id, pos, embedding, all of one length), fitted by
    Adam on the mean squared error. Each round reads the cells once; a task gives one vector of slopes, as long as the weights. The driver holds the weights.
    """
    spark = scores.sparkSession
    # the optimiser's estimate of a vector's size is far too small, so neither side is left to a broadcast
    features = vectors.select("item_id", F.col("embedding").cast("array<double>").alias("x")).hint("merge")
    cells = cells_of(scores, metric, (), scale).drop("pos").join(features, "item_id")
    cells = written(cells.select("systems", "x", "y"), "feature-cells")
    first = cells.select("systems", F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no item has both scores and a vector")
    model = FeatureModel(first["n"], list(first["systems"]))
    split = model.weights.size
    adam = Adam(split + len(model.theta), rate)
    for _ in range(rounds):
        g = summed(cells.select("x", "y"), lambda b, model=model: model.slopes(matrix(b["x"]), matrix(b["y"])), len(adam.first) + 2)
        now = np.concatenate([model.weights.ravel(), model.theta])
        g = g[:-2] / max(1.0, g[-1]) + ridge * np.concatenate([np.where(np.arange(split) < split - 3, model.weights.ravel(), 0.0), model.theta])
        now = now - adam.step(g)
        model.weights, model.theta = now[:split].reshape(-1, 3), now[split:]

    def predicted(more: DataFrame) -> DataFrame:
        types = dict(more.dtypes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p = model.parameters(matrix(b["embedding"]))
                    yield b[["item_id", "pos"]].assign(diff=p[:, 0], disc=p[:, 1], feas=p[:, 2])

        return more.select("item_id", "pos", "embedding").mapInPandas(run, f"item_id {types['item_id']}, pos {types['pos']}, diff double, disc double, feas double")

    systems = spark.createDataFrame(list(zip(model.systems, model.theta.tolist(), strict=True)), "system string, theta double")
    return predicted(vectors), systems, predicted
