"""Helpers that the operators share: table access, the shared folder, bounded broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; SIFTWELL_TOKENIZERS overrides the installed package's folder."""
    if folder := os.environ.get("SIFTWELL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter of likely_members, and so, divided by 64, the most rows that it broadcasts.
FILTER_BITS = 1 << 24


def bit_table(wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, Callable[[Column], Column], Column]:
    """A broadcast bit table (word_, mask_) over the hashes of a long column; what gives the bit of a key; and, for rows with bit_ joined by word_, whether it is set."""
    bit = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS)).cast("int")
    bits = wanted.select(bit(F.col(wanted_key)).alias("bit_")).selectExpr("bit_ DIV 64 AS word_", "shiftleft(1L, bit_ % 64) AS mask_")
    return F.broadcast(bits.groupBy("word_").agg(F.bit_or("mask_").alias("mask_"))), bit, F.expr("shiftright(mask_, bit_ % 64) & 1L = 1")


def likely_members(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of df whose key may be in wanted: all that are, and few others, by a bit table of fixed size.

    An exact semi-join should follow; it then shuffles few rows. The bit table has at most FILTER_BITS / 64 rows,
    whatever wanted holds, so it can be broadcast.
    """
    bits, bit, inside = bit_table(wanted, wanted_key)
    return df.withColumn("bit_", bit(F.col(key))).join(bits, F.expr("word_ = bit_ DIV 64") & inside, "left_semi").drop("bit_")


def split_members(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key is in wanted (distinct, of the same name), and the others. Only rows that pass the bit table are shuffled."""
    bits, bit, inside = bit_table(wanted, key)
    columns = df.columns
    marked = df.withColumn("bit_", bit(F.col(key))).join(bits, F.expr("word_ = bit_ DIV 64"), "left")
    maybe = marked.where(inside).select(columns)
    surely_not = marked.where(~F.coalesce(inside, F.lit(False))).select(columns)
    return maybe.join(wanted, key, "left_semi"), surely_not.unionByName(maybe.join(wanted, key, "left_anti"))


#: Rows and bytes of the batches that go to Python: rows hold whole documents, so Spark's defaults would be large.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, where they are not bounded more tightly already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        number = int(now) if now.isdigit() else 1 << 62
        if not 0 < number <= most:
            spark.conf.set(key, most)
