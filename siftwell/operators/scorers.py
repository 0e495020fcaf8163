"""Scorers: a utility for every item, higher is better to annotate. Inputs are long tables; outputs have item_id, pos, utility.

Score tables: item_id, pos, system, metric, value. Output tables: item_id, pos, system, tgt. Vector tables: item_id, pos,
[system,] embedding. ``by`` names grouping columns (dataset, seed and the like) that are carried through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import numeric, sari
from siftwell.functions.columns import dot, irt_information, ngrams, tokens_13a, uniform, words
from siftwell.operators.evaluate import kendall_columns
from siftwell.operators.gradients import Adam, summed
from siftwell.operators.lineage import written
from siftwell.operators.ranking import in_order, planned_buckets
from siftwell.operators.response import irt_fit

By = tuple[str, ...]
#: Characters of an item's source and references, or of its outputs by one system, that one row may hold.
LONG_ITEM = 1_000_000


def random_utility(items: DataFrame, seed: int = 0, by: By = ()) -> DataFrame:
    """A reproducible random number for each item."""
    return items.select(*by, "item_id", "pos").distinct().withColumn("utility", uniform(seed, F.col("item_id")))


def _metric(scores: DataFrame, metric: str) -> DataFrame:
    return scores.where((F.col("metric") == metric) & F.col("value").isNotNull())


def metric_avg(scores: DataFrame, metric: str, by: By = ()) -> DataFrame:
    """Hardest items first: minus the mean over systems."""
    return _metric(scores, metric).groupBy(*by, "item_id", "pos").agg((-F.avg("value")).alias("utility"))


def metric_var(scores: DataFrame, metric: str, by: By = ()) -> DataFrame:
    """Population variance over systems."""
    return _metric(scores, metric).groupBy(*by, "item_id", "pos").agg(F.var_pop("value").alias("utility"))


def metric_cons(scores: DataFrame, metric: str, target: str | None = None, by: By = ()) -> DataFrame:
    """Kendall's tau-c between the item's values and the systems' means of the target metric; 0 if a side is constant."""
    means = _metric(scores, target or metric).groupBy(*by, "system").agg(F.avg("value").alias("mean_"))
    own = _metric(scores, metric).select(*by, "item_id", "pos", "system", "value").join(means, [*by, "system"])
    return kendall_columns(own, [*by, "item_id", "pos"], "system", "value", "mean_", "c").withColumnRenamed("tau", "utility")


def diversity_unigram(outputs: DataFrame, by: By = ()) -> DataFrame:
    """Minus the mean unigram F1 over pairs of outputs; two empty or one empty output count as equal; fewer than two outputs give 0."""
    keys = [*by, "item_id", "pos"]
    sized = outputs.select(*keys, "system", words(F.coalesce("tgt", F.lit(""))).alias("w_"))
    counts = sized.select(*keys, "system", F.explode("w_").alias("t_")).groupBy(*keys, "system", "t_").agg(F.count(F.lit(1)).alias("c_"))
    a = counts.withColumnRenamed("system", "a_").withColumnRenamed("c_", "ca_")
    b = counts.withColumnRenamed("system", "b_").withColumnRenamed("c_", "cb_")
    common = a.join(b, [*keys, "t_"]).where("a_ < b_").groupBy(*keys, "a_", "b_").agg(F.sum(F.least("ca_", "cb_")).alias("both_"))
    sizes = sized.select(*keys, "system", F.size("w_").alias("n_"))
    x = sizes.withColumnRenamed("system", "a_").withColumnRenamed("n_", "na_")
    y = sizes.withColumnRenamed("system", "b_").withColumnRenamed("n_", "nb_")
    pairs = x.join(y, keys).where("a_ < b_").join(common, [*keys, "a_", "b_"], "left")
    f1 = F.when((F.col("na_") == 0) | (F.col("nb_") == 0), 1.0).otherwise(2 * F.coalesce("both_", F.lit(0)) / (F.col("na_") + F.col("nb_")))
    means = pairs.groupBy(*keys).agg(F.avg(f1).alias("m_"))
    return outputs.select(*keys).distinct().join(means, keys, "left").select(*keys, F.coalesce(-F.col("m_"), F.lit(0.0)).alias("utility"))


def _pairwise_text(outputs: DataFrame, prepare: Callable, score: Callable, least: int, itself: float, by: By) -> DataFrame:
    """Minus the mean score over all ordered pairs of outputs of an item, itself included; items travel as lists, in Arrow batches."""
    keys = [*by, "item_id", "pos"]
    lists = outputs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("system", F.coalesce("tgt", F.lit("")).alias("t")))).alias("x_"))
    lists = lists.select(*keys, F.transform("x_", lambda s: s["t"]).alias("x_"))

    def utility(texts: list[str]) -> float:
        if len(texts) < least:
            return 0.0
        grams = [prepare(t) for t in texts]
        cache: dict[tuple[str, str], float] = {}
        total = 0.0
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if i == j:
                    total += itself if texts[i].strip() else 0.0
                else:
                    pair = (texts[i], texts[j])
                    if pair not in cache:
                        cache[pair] = score(a, b)
                    total += cache[pair]
        return -total / len(grams) ** 2

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: utility(list(t)))

    return lists.select(*keys, run("x_").alias("utility"))


def diversity_bleu(outputs: DataFrame, by: By = ()) -> DataFrame:
    """Minus the mean sentence BLEU over all ordered pairs, a text with itself included; fewer than two outputs give 0."""
    return _pairwise_text(outputs, numeric.bleu_grams, numeric.sentence_bleu, 2, 100.0, by)


def diversity_chrf(outputs: DataFrame, by: By = ()) -> DataFrame:
    """Minus the mean chrF over all ordered pairs, a text with itself included; a single output is its own pair."""
    return _pairwise_text(outputs, numeric.chrf_grams, numeric.chrf, 1, 100.0, by)


def diversity_dot(vectors: DataFrame, by: By = ()) -> DataFrame:
    """Minus the mean dot product over pairs of the outputs' vectors; fewer than two vectors give 0."""
    keys = [*by, "item_id", "pos"]
    a = vectors.select(*keys, F.col("system").alias("a_"), F.col("embedding").alias("va_"))
    b = vectors.select(*keys, F.col("system").alias("b_"), F.col("embedding").alias("vb_"))
    means = a.join(b, keys).where("a_ < b_").groupBy(*keys).agg(F.avg(dot(F.col("va_"), F.col("vb_"))).alias("m_"))
    return vectors.select(*keys).distinct().join(means, keys, "left").select(*keys, F.coalesce(-F.col("m_"), F.lit(0.0)).alias("utility"))


def diversity(kind: str, table: DataFrame, by: By = ()) -> DataFrame:
    found = {"bleu": diversity_bleu, "chrf": diversity_chrf, "unigram": diversity_unigram, "lm": diversity_dot}.get(kind.lower())
    if found is None:
        raise ValueError(f"unknown diversity metric: {kind}")
    return found(table, by)


def combine(utilities: list[DataFrame | tuple[DataFrame, float]], operation: str = "avg", normalize: str | None = "rank", by: By = ()) -> DataFrame:
    """Joins utilities after normalising each (zscore, 01, rank with average ranks, or None); avg with weights, or mul."""
    if normalize not in ("zscore", "01", "rank", None):
        raise ValueError(f"unknown normalisation: {normalize}")
    if operation not in ("avg", "mul"):
        raise ValueError(f"unknown operation: {operation}")
    keys, out, weights = [*by, "item_id", "pos"], None, []
    for i, u in enumerate(utilities):
        df, w = u if isinstance(u, tuple | list) else (u, 1.0)
        weights.append(abs(w))
        x, all_ = F.col("utility"), Window.partitionBy(*by)
        if normalize == "rank" and not by and planned_buckets(df) > 1:
            place = in_order(df, "utility", ["item_id"], descending=False)
            ends = place.groupBy("utility").agg(((F.min("rank") + F.max("rank")) / 2).alias(f"u{i}_"))  # equals share the mean of their places
            part = place.join(ends, place["utility"].eqNullSafe(ends["utility"])).select(*keys, f"u{i}_")
        elif normalize == "rank":
            equal = Window.partitionBy(*by, "utility")
            value: Column = F.rank().over(all_.orderBy("utility")) + (F.count(F.lit(1)).over(equal) - 1) / 2
            part = df.select(*keys, value.cast("double").alias(f"u{i}_"))
        else:
            stats = df.groupBy(*by).agg(F.avg("utility").alias("m_"), F.stddev_pop("utility").alias("s_"), F.min("utility").alias("lo_"), F.max("utility").alias("hi_"))
            both = df.join(stats, list(by)) if by else df.crossJoin(stats)
            if normalize == "zscore":
                value = F.when(F.col("s_") == 0, 0.0).otherwise(F.try_divide(x - F.col("m_"), F.col("s_")))
            elif normalize == "01":
                value = F.when(F.col("hi_") == F.col("lo_"), 0.0).otherwise(F.try_divide(x - F.col("lo_"), F.col("hi_") - F.col("lo_")))
            else:
                value = x
            part = both.select(*keys, value.alias(f"u{i}_"))
        out = part if out is None else out.join(part, keys)
    columns = [F.col(f"u{i}_") for i in range(len(weights))]
    if operation == "avg":
        total = sum(w * c for w, c in zip(weights, columns, strict=True)) / sum(weights)
    else:
        total = columns[0]
        for c in columns[1:]:
            total = total * c
    return out.select(*keys, total.alias("utility"))


def irt_utility(params: DataFrame, kind: str, models: DataFrame | None = None, by: By = ()) -> DataFrame:
    """Utility from item parameters (item_id, pos, diff, disc, feas): diff, disc, diffdisc, feas, or fic (information summed over the systems' theta)."""
    keys = [*by, "item_id", "pos"]
    simple = {"diff": -F.col("diff"), "disc": -F.col("disc"), "diffdisc": F.col("diff") * F.col("disc"), "feas": F.col("feas")} if kind in ("diff", "disc", "diffdisc", "feas") else None
    if simple:
        return params.select(*keys, simple[kind].alias("utility"))
    if kind != "fic" or models is None:
        raise ValueError(f"unknown item-response utility: {kind}")
    both = params.join(models, list(by)) if by else params.crossJoin(models)  # systems are few: as many as a data set has
    return both.groupBy(*keys).agg(F.sum(irt_information(F.col("theta"), F.col("diff"), F.col("disc"))).alias("utility"))


def pyirt(scores: DataFrame, metric: str, kind: str, model: str = "4pl", binarize: bool = False, by: By = (), **options) -> DataFrame:
    """Fits, then maps the parameters to a utility."""
    items, models = irt_fit(scores, metric, model, binarize, by=by, **options)
    return irt_utility(items, kind, models, by)


def external_scorer(items: DataFrame, score: Callable[[pd.Series], pd.Series], column: str = "src", reverse: bool = False, by: By = ()) -> DataFrame:
    """Utility by any function of a text column (a learned source scorer, say), called on Arrow batches; reverse negates."""
    udf = F.pandas_udf(score, "double")
    return items.select(*by, "item_id", "pos", ((-1 if reverse else 1) * udf(F.col(column))).alias("utility"))


def product_of_scorers(a: DataFrame, b: DataFrame, by: By = ()) -> DataFrame:
    """The product of two utilities (difficulty times discrimination of two source scorers)."""
    return combine([a, b], "mul", None, by)


def pairwise_confidence(outputs: DataFrame, score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], reverse: bool = False, by: By = ()) -> DataFrame:
    """Mean over systems of a score of (src, tgt). Each distinct pair is scored once and joined back; score maps frames with src, tgt to src, tgt, score."""
    pairs = outputs.select("src", "tgt").distinct().mapInPandas(score, "src string, tgt string, score double")
    both = outputs.join(pairs, ["src", "tgt"])
    return both.groupBy(*by, "item_id", "pos").agg(((-1 if reverse else 1) * F.avg("score")).alias("utility"))


def distilled(items: DataFrame, utility: DataFrame, train: Column, features: int = 256, regularization: float = 0.1) -> DataFrame:
    """Learns a utility from source texts (TF-IDF, ridge regression) on the rows where train holds and predicts it for all."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.regression import LinearRegression

    data = items.select("item_id", "pos", words(F.lower(F.coalesce("src", F.lit("")))).alias("tokens"))
    known = data.join(utility.select("item_id", F.col("utility").alias("label")), "item_id").where(train)
    model = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LinearRegression(regParam=regularization, solver="normal")]).fit(known)
    return model.transform(data).select("item_id", "pos", F.col("prediction").alias("utility"))


def distilled_from_vectors(vectors: DataFrame, utility: DataFrame, train: Column, regularization: float = 0.1) -> DataFrame:
    """The same from ready vectors."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = vectors.select("item_id", "pos", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    known = data.join(utility.select("item_id", F.col("utility").alias("label")), "item_id").where(train)
    return LinearRegression(regParam=regularization, solver="normal").fit(known).transform(data).select("item_id", "pos", F.col("prediction").alias("utility"))


class Network:
    """Two hidden layers of rectified units and one output."""

    def __init__(self, width: int, hidden: tuple[int, int], seed: int) -> None:
        rng = np.random.default_rng(seed)
        sizes = [width, *hidden, 1]
        self.shapes = [shape for a, b in zip(sizes, sizes[1:], strict=False) for shape in ((a, b), (b,))]
        self.weights = np.concatenate([rng.normal(0, np.sqrt(2 / s[0]), s).ravel() if len(s) == 2 else np.zeros(s) for s in self.shapes])

    def layers(self) -> list[np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        return [w.reshape(s) for w, s in zip(np.split(self.weights, cuts), self.shapes, strict=True)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out, w = [x], self.layers()
        for k in range(0, len(w), 2):
            z = out[-1] @ w[k] + w[k + 1]
            out.append(z if k == len(w) - 2 else np.maximum(z, 0))
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slopes of the squared error, added up over the rows."""
        out, w = self.forward(x), self.layers()
        back, found = out[-1] - y[:, None], []
        for k in range(len(w) - 2, -1, -2):
            found += [back.sum(0), out[k // 2].T @ back]
            back = (back @ w[k].T) * (out[k // 2] > 0)
        return np.concatenate([g.ravel() for g in reversed(found)])


def distilled_network(vectors: DataFrame, utility: DataFrame, train: Column, hidden: tuple[int, int] = (128, 16), rounds: int = 200, rate: float = 0.02, seed: int = 0) -> DataFrame:
    """Learns a utility from vectors (all of one length) with two hidden layers on the rows where train holds, and predicts it for all.

    Each round adds up the slopes of all rows over the tasks (back-propagation in Arrow batches) and makes one step; the driver holds the weights. Features and target are standardised.
    """
    data = vectors.select("item_id", "pos", F.col("embedding").cast("array<double>").alias("x"))
    known = written(data.join(utility.select("item_id", F.col("utility").cast("double").alias("y")), "item_id").where(train & F.col("y").isNotNull()).select("x", "y"), "distil")
    first = known.first()
    if first is None:
        raise ValueError("nothing to learn from")
    width = len(first["x"])
    frame = lambda b: np.column_stack([np.array(b["x"].tolist(), float), b["y"].to_numpy(float)])

    def moments(b: pd.DataFrame) -> np.ndarray:
        m = frame(b)
        return np.concatenate([m.sum(0), (m * m).sum(0), [len(m)]])

    sums = summed(known, moments, 2 * width + 3)
    mean = sums[: width + 1] / sums[-1]
    scale = np.sqrt(np.maximum(sums[width + 1 : -1] / sums[-1] - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    net = Network(width, hidden, seed)
    adam = Adam(len(net.weights), rate)
    for _ in range(rounds):

        def slopes(b: pd.DataFrame, net=net) -> np.ndarray:
            m = (frame(b) - mean) / scale
            return net.slopes(m[:, :-1], m[:, -1])

        net.weights = net.weights - adam.step(summed(known, slopes, len(net.weights)) / sums[-1])
    types = dict(data.dtypes)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = (np.array(b["x"].tolist(), float) - mean[:-1]) / scale[:-1]
                yield b[["item_id", "pos"]].assign(utility=net.forward(x)[-1][:, 0] * scale[-1] + mean[-1])

    return data.mapInPandas(predict, f"item_id {types['item_id']}, pos {types['pos']}, utility double")


def simplification_score(outputs: DataFrame, sources: DataFrame, references: DataFrame, order: int = 4) -> DataFrame:
    """item_id, pos, system, value: SARI (0 to 100) of each output (tgt) against the source (item_id, src) and all references (item_id, ref) of its item.

    For each length of n-grams: F1 of what was kept, precision of what was deleted, F1 of what was added, by three multisets that meet on the n-gram; no n-grams count as
    a perfect match. Texts are lower-cased and cut by the 13a rules; nulls are empty. Items without a reference have no score.

    Outputs meet their item's source and references as token lists, one row for each item and system, so no n-gram is shuffled. Items of which the source and references
    or the texts of one system have over LONG_ITEM characters do not become one row: their n-grams are shuffled.
    """
    size = lambda text: F.sum(F.length(F.coalesce(text, F.lit(""))) + 1)
    texts = sources.select("item_id", F.col("src").alias("t_")).unionByName(references.select("item_id", F.col("ref").alias("t_")))
    long = texts.groupBy("item_id").agg(size("t_").alias("n_")).unionByName(outputs.groupBy("item_id", "system").agg(size("tgt").alias("n_")).select("item_id", "n_"))
    long = written(long.where(F.col("n_") > LONG_ITEM).select("item_id").distinct(), "long-items")
    if long.isEmpty():
        return _sari_by_lists(outputs, sources, references, order)
    few, rest = ([df.join(long, "item_id", how) for df in (outputs, sources, references)] for how in ("left_semi", "left_anti"))
    return _sari_by_lists(*rest, order).unionByName(_sari_by_grams(*few, order))


def _sari_by_lists(outputs: DataFrame, sources: DataFrame, references: DataFrame, order: int) -> DataFrame:
    types = dict(outputs.dtypes)
    spark = outputs.sparkSession
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):  # a row holds the texts of its item
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
    tokens = lambda text: tokens_13a(F.lower(F.coalesce(text, F.lit(""))))
    src = sources.groupBy("item_id").agg(F.collect_list(tokens("src")).alias("src_"))
    ref = references.groupBy("item_id").agg(F.collect_list(tokens("ref")).alias("ref_"))
    none = F.array().cast("array<array<string>>")
    sides = ref.join(src.hint("merge"), "item_id", "left").select("item_id", F.coalesce("src_", none).alias("src_"), "ref_")
    own = outputs.groupBy("item_id", "system").agg(F.collect_set(F.struct("pos")).alias("at_"), F.collect_list(F.coalesce("tgt", F.lit(""))).alias("t_"))
    both = own.join(sides.hint("merge"), "item_id").select("item_id", "system", "at_", F.transform("t_", tokens).alias("t_"), "src_", "ref_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            first = np.array([True] + [x != y for x, y in zip(ids, ids[1:], strict=False)])  # rows of one item follow each other
            each = [np.asarray(pc.list_value_length(pc.list_flatten(b.column(i)))) for i in (3, 4, 5)]
            rows = [np.asarray(pc.list_parent_indices(b.column(i))) for i in (3, 4, 5)]
            weights = sum(np.bincount(r, w, b.num_rows) for r, w in zip(rows, each, strict=True))
            value = np.empty(b.num_rows)
            for x, y in sari.steps(weights):
                new = first[x:y].copy()
                new[0] = True
                heads = pa.array(x + np.flatnonzero(new))
                value[x:y] = sari.scores(b.column(3).slice(x, y - x), b.column(4).take(heads), b.column(5).take(heads), np.cumsum(new) - 1, order)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(value)], ["item_id", "system", "at_", "value"])

    found = both.mapInArrow(run, f"item_id {types['item_id']}, system {types['system']}, at_ array<struct<pos:{types['pos']}>>, value double")
    # a system without a name meets no n-grams
    value = F.when(F.col("system").isNull(), 100.0).otherwise(F.col("value")).alias("value")
    return found.select("item_id", F.explode("at_").alias("at_"), "system", value).select("item_id", "at_.pos", "system", "value")


def _sari_by_grams(outputs: DataFrame, sources: DataFrame, references: DataFrame, order: int) -> DataFrame:
    def grams(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
        tokens = df.select(*keys, tokens_13a(F.lower(F.coalesce(text, F.lit("")))).alias("t_"))
        sizes = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("t_"), n).alias("g")) for n in range(1, order + 1)])
        sized = tokens.select(*keys, F.explode(sizes).alias("x_")).select(*keys, "x_.n", F.explode("x_.g").alias("g"))
        return sized.groupBy(*keys, "n", "g").agg(F.count(F.lit(1)).alias("c_"))

    many = references.groupBy("item_id").agg(F.count(F.lit(1)).alias("many_"))
    own = outputs.select("item_id", "pos", "system").distinct().join(many, "item_id")
    keys = ["item_id", "system"]
    s = own.select(*keys).join(grams(sources, "src", ["item_id"]), "item_id").select(*keys, "n", "g", F.col("c_").alias("s"), F.lit(0).alias("c"), F.lit(0).alias("r"))
    r = own.select(*keys).join(grams(references, "ref", ["item_id"]), "item_id").select(*keys, "n", "g", F.lit(0).alias("s"), F.lit(0).alias("c"), F.col("c_").alias("r"))
    c = grams(outputs, "tgt", keys).select(*keys, "n", "g", F.lit(0).alias("s"), F.col("c_").alias("c"), F.lit(0).alias("r"))
    met = s.unionByName(c).unionByName(r).groupBy(*keys, "n", "g").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    met = met.join(own.select(*keys, "many_"), keys).select(*keys, "n", (F.col("s") * F.col("many_")).alias("s"), (F.col("c") * F.col("many_")).alias("c"), "r")
    kept, gone, zero = F.least("s", "c"), F.greatest(F.col("s") - F.col("c"), F.lit(0)), F.lit(0)
    good = F.least("s", "c", "r")
    new, wanted = (F.col("c") > 0) & (F.col("s") == 0), (F.col("r") > 0) & (F.col("s") == 0)
    count = lambda x: F.sum(x.cast("int"))
    sums = met.groupBy(*keys, "n").agg(
        F.sum(F.try_divide(good, kept)).alias("k1"), count(kept > 0).alias("k2"), F.sum(good).alias("k3"), F.sum(F.least("s", "r")).alias("k4"),
        F.sum(F.try_divide(F.greatest(gone - F.col("r"), zero), gone)).alias("d1"), count(gone > 0).alias("d2"), count(new & (F.col("r") > 0)).alias("a1"), count(new).alias("a2"), count(wanted).alias("a3"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.coalesce(F.col(a), F.lit(0)), F.col(b)), F.lit(1.0))
    f1 = lambda p, q: F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))
    each = own.select("item_id", "pos", "system", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")).join(sums, [*keys, "n"], "left")
    value = (f1(share("k1", "k2"), share("k3", "k4")) + share("d1", "d2") + f1(share("a1", "a2"), share("a1", "a3"))) / 3
    return each.groupBy("item_id", "pos", "system").agg((100 * F.avg(value)).alias("value"))
