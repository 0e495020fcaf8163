"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the rows by their normalised text (a bounded prefix and a hash go first, so
that the samples sent to the driver are small), an external sort puts equal texts next to each other, and the
window operator compares each text in full with its neighbour.

A text with very many copies would fill one range. Counts by hash (combined before the shuffle) find such texts;
at most ``4 * partitions`` hashes can be above the threshold, so that list is broadcast. Rows of a hot text are
salted into ranges of bounded size; the salted groups, again a bounded number, are merged by hash and digest afterwards.

Defined cases: a null text counts as empty; repeated rows (same id, same text) are one group of which exactly one
row stays; a null id sorts below every other id; ties of the id go to one of its rows, any; very long texts are compared whole; columns other than the id and
the text are ignored, or kept as they are with carry, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import ascii_lower, shuffle_partitions, table

#: Characters of the normalised text that take part in the splitters as they are.
SPLIT_PREFIX = 32
#: A text is hot if it has more than total / (HOT_SHARE * partitions) copies.
HOT_SHARE = 4


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", carry: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, norm (the normalised text).

    keep: "max" or "min", the id that stays. carry: also return the whole input row as struct ``row``.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    norm = lambda text: ascii_lower(F.coalesce(text, F.lit("")))
    shipped = F.struct("*").alias("row") if carry else norm(F.col(text_col)).alias("norm")
    src = docs.select(F.col(id_col).alias("doc_id"), norm(F.col(text_col)).alias("norm_"), shipped).withColumn("h", F.xxhash64("norm_"))
    best = F.max if keep == "max" else F.min
    order = F.desc_nulls_last("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")

    threshold = max(16, docs.count() // (HOT_SHARE * n))
    hot = src.groupBy("h").count().where(F.col("count") > threshold)
    # at most total / threshold <= HOT_SHARE * n rows, whatever the input
    hot_rows = [(r["h"], -(-r["count"] // threshold)) for r in hot.collect()]
    salted, keys = src, ["p", "h"]
    if hot_rows:
        keys = ["p", "h", "salt"]
        sizes = F.broadcast(spark.createDataFrame(hot_rows, "h long, salts int"))
        salted = src.join(sizes, "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), "salts").cast("int") + 1, F.lit(0)))

    ranged = salted.withColumn("p", F.substring("norm_", 1, SPLIT_PREFIX)).drop("norm_").repartitionByRange(n, *keys)
    if carry:  # the row holds the text, so the normalised one is made again instead of shuffled
        ranged = ranged.withColumn("norm", norm(F.col("row")[text_col]))
    group = Window.partitionBy(*keys, "norm")  # the ranges already hold each group whole: no second shuffle
    out = ranged.select(
        "doc_id", "norm", *(["h", "salt"] if hot_rows else []), *(["row"] if carry else []),
        F.row_number().over(group.orderBy(order)).alias("rn"),
        best("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    if hot_rows:
        # the digest stands for the text, which may be long; it is made of hot rows only
        digest = lambda text: F.when(F.col("salt") > 0, F.sha2(text, 256))
        parts = salted.where("salt > 0").groupBy("h", "salt", digest(F.col("norm_")).alias("digest")).agg(best("doc_id").alias("local"), F.count(F.lit(1)).alias("c"))
        whole = Window.partitionBy("h", "digest")
        merged = parts.select(F.col("h").alias("h_"), F.col("salt").alias("salt_"), F.col("digest").alias("digest_"), best("local").over(whole).alias("whole_id"), F.sum("c").over(whole).alias("whole_size"), "local")
        # equal ids have equal salts, so one part alone holds the id that stays
        merged = merged.withColumn("first", F.col("local").eqNullSafe(F.col("whole_id"))).drop("local")
        # at most two rows for each threshold rows of the input: bounded by the number of partitions, not by the data
        merged = F.broadcast(merged)
        out = out.withColumn("digest", digest(F.col("norm"))).join(merged, (F.col("h") == F.col("h_")) & (F.col("salt") == F.col("salt_")) & (F.col("digest") == F.col("digest_")), "left").select(
            "doc_id", "norm", *(["row"] if carry else []),
            F.when((F.col("salt") > 0) & ~F.col("first"), F.lit(0)).otherwise(F.col("rn")).alias("rn"),
            F.when(F.col("salt") > 0, F.col("whole_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("whole_size", "group_size").alias("group_size"),
        )
    return out.select("doc_id", "keep_id", "group_size", (F.col("rn") == 1).alias("kept"), "norm", *(["row"] if carry else []))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.sha2("norm", 256).alias("text_sha256"))


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
