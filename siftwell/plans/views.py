"""The driver's tables as evaluation data: long tables with items, systems, metrics and values.

events: an item is a user, a system is an event type; dense. parts: an item is a part, a system is an order priority;
not quite dense. conversations: an item is a conversation, a system is a role; ragged texts. documents: items with a
language as domain and a source as document.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
    return f"{shared.rstrip('/')}/siftwell-{name}-{uuid.uuid4().hex}"


def _long(wide: DataFrame, metrics: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("value")) for m in metrics])
    return wide.select("item_id", "pos", "system", F.explode(cells).alias("c")).select("item_id", "pos", "system", "c.metric", "c.value")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics m (mean), human (largest value), n (count)."""
    wide = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("system")).agg(F.avg("value").alias("m"), F.max("value").alias("human"), F.count("value").alias("n"))
    return _long(wide.withColumn("pos", F.col("item_id")), ["m", "human", "n"])


EVENT_SQL = """
ev_wide AS (SELECT user_id AS item_id, user_id AS pos, event_type AS system, round(avg(value), 6) AS m, round(max(value), 6) AS human, count(value)::DOUBLE AS n FROM events GROUP BY 1, 2, 3),
scores AS (SELECT item_id, pos, system, 'm' AS metric, m AS value FROM ev_wide UNION ALL SELECT item_id, pos, system, 'human', human FROM ev_wide UNION ALL SELECT item_id, pos, system, 'n', n FROM ev_wide)
"""


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics price, quantity, discount (means over the part's lines of one order priority)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    wide = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("item_id"), F.col("o_orderpriority").alias("system"))
    wide = wide.agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return _long(wide.withColumn("pos", F.col("item_id")), ["price", "quantity", "discount"])


PART_SQL = """
pt_wide AS (SELECT l_partkey AS item_id, l_partkey AS pos, o_orderpriority AS system, round(avg(l_extendedprice), 6) AS price, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
scores AS (SELECT item_id, pos, system, 'price' AS metric, price AS value FROM pt_wide UNION ALL SELECT item_id, pos, system, 'quantity', quantity FROM pt_wide UNION ALL SELECT item_id, pos, system, 'discount', discount FROM pt_wide)
"""


def conversation_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pos, system, tgt: each turn is an output of its conversation."""
    x = table(spark, sf_dir, "conversations")
    return x.select(F.col("conv_id").alias("item_id"), F.col("conv_id").alias("pos"), F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("system"), F.col("text").alias("tgt"))


CONVERSATION_SQL = """
outputs AS (SELECT conv_id AS item_id, conv_id AS pos, 't' || lpad(turn::VARCHAR, 4, '0') AS system, text AS tgt FROM conversations)
"""


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pos, domain (language), doc (source), src, utility (characters)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("domain"), F.col("source").alias("doc"), F.col("text").alias("src"), F.col("n_chars").cast("double").alias("utility"))


DOCUMENT_SQL = """
items AS (SELECT doc_id AS item_id, doc_id AS pos, lang AS domain, source AS doc, text AS src, n_chars::DOUBLE AS utility FROM documents)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id (ten neighbouring vectors make an item), system, embedding."""
    x = table(spark, sf_dir, "embeddings")
    return x.select(F.floor(F.col("vec_id") / 10).cast("long").alias("item_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("pos"), F.concat(F.lit("v"), F.pmod("vec_id", F.lit(10)).cast("string")).alias("system"), "embedding")


VECTOR_SQL = """
vectors AS (SELECT vec_id // 10 AS item_id, vec_id // 10 AS pos, 'v' || (vec_id % 10)::VARCHAR AS system, embedding FROM embeddings)
"""


def single_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("vec_id").alias("pos"), "embedding")
