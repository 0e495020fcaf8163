"""Command line: select ranks the items of a JSON-lines file, eval compares a selection with all items."""

from __future__ import annotations

import argparse
import ast
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.functions.columns import PROPS
from siftwell.operators import evaluate, select
from siftwell.sources import items


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("siftwell").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def select_items(spark: SparkSession, data: str, method: str, options: dict):
    """Nested items with utility and rank."""
    tables = items.load_data(spark, data)
    ranked = select.basic(tables, method, **options).select("item_id", "utility", "rank")
    return items.to_wire(tables).join(ranked.withColumnRenamed("item_id", "i"), "i")


def evaluate_selection(spark: SparkSession, old: str, new: str, metric: str, props: list[float] | None = None) -> tuple[float, float]:
    """Mean correlation (percent) and mean number of clusters over the proportions; new lists the items of old in selected order."""
    full, chosen = items.load_data(spark, old), items.load_data(spark, new)
    ranked = chosen["items"].select("item_id", (F.col("pos") + 1).alias("rank"))
    scores, n = full["scores"], full["items"].count()
    points = evaluate.proportions(spark, n, props or PROPS)
    tagged = evaluate.at_proportions(scores, ranked, points)
    means = evaluate.model_absolute(tagged, metric, ("prop",)).withColumnRenamed("mean", "x")
    both = means.join(evaluate.model_absolute(scores, metric).withColumnRenamed("mean", "y"), "system")
    correlation = evaluate.correlation(both, "kendall", ("prop",)).agg(F.avg("correlation")).first()[0]
    clusters = evaluate.cluster_curve(scores, ranked, points, metric).agg(F.avg("clusters")).first()[0]
    return 100 * (correlation or 0.0), clusters or 0.0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftwell", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("select")
    one.add_argument("data")
    one.add_argument("--method", default="metric_var", choices=sorted(select.METHODS))
    one.add_argument("--args", default="{'metric': 'human'}", help="options of the method, a Python literal")
    two = sub.add_parser("eval")
    two.add_argument("data_old")
    two.add_argument("data_new")
    two.add_argument("--metric", default="human")
    found = parser.parse_args(args)
    spark = _spark()
    if found.command == "select":
        ranked = select_items(spark, found.data, found.method, ast.literal_eval(found.args))
        # a selection is for people to annotate: it streams to standard output in order, not into memory
        for row in ranked.orderBy("rank").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            sys.stdout.write(row["j"] + "\n")
    else:
        correlation, clusters = evaluate_selection(spark, found.data_old, found.data_new, found.metric)
        print(f"Correlation: {correlation:.1f}%\nClusters: {clusters:.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
