"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). A document that holds a window
holds each of its words, so one of them, its prefix, is enough to find the candidates. Words are ordered by rarity:
their counts over all documents decide, and the rarest word of a window (ties: the word that sorts first, then the
leftmost place) becomes its prefix. Document words meet the prefixes in a join; the prefix's place in the window
fixes where the window would start, the length bound drops starts that would run over the document's ends, and the
words in between are compared in full.

Documents are read twice, whatever the size of the benchmark: to count its words and to find prefixes. What is
broadcast for that are the words themselves if they are at most ``MOST_BROADCAST``, counted first, and a bit table of
fixed size otherwise, which lets few other words through to the exact joins. Each word that passes takes its
neighbours along, a window's length to both sides, so that the comparison needs no second look at the document.
Item lists stay in a table of their own, which verified windows are joined with at the end.

Defined cases: null texts and texts without words have no words, hits or items; repeated items count once per
item_id; a null item_id is skipped; every document row gets its own result row, whatever ids are null or shared;
empty tables give documents without hits, or no rows; words that are equally rare tie by their hash, which changes no result; very long texts are read whole;
columns other than the ids and texts are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import ascii_lower, bit_table, likely_members, table, text_or_empty, written

WINDOW = 10
#: Fixed pattern of what lies between words, after A-Z became lower case: all that a word doesn't hold.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many words are broadcast as they are.
MOST_BROADCAST = 50_000
#: What tells document rows apart; rows that agree in all three are alike.
ROW = ["doc_id", "t1", "t2"]


def words_of(text: Column) -> Column:
    """The words in order. Splitting is linear in the text; extracting all matches took 19 times as long."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """item_id, words, wid (digest of the words) of the different windows of each item."""
    src = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(text_or_empty(text_col)).alias("all"))
    src = src.where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    each = src.select("item_id", "all", F.explode(starts).alias("s")).select("item_id", F.slice("all", F.col("s") + 1, window).alias("words"))
    return each.distinct().select("item_id", "words", F.md5(F.concat_ws(" ", "words")).alias("wid"))


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1 and t2 (hashes of the text), words."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), words_of(text).alias("words"))


def contaminated_words(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted as strings), t1 (xxhash64 of the text)."""
    src = document_rows(docs, id_col, text_col)
    held = written(windows_of(items, item_id, item_text, window), "windows")
    windows = held.select("wid", "words").distinct()

    # how often each benchmark word occurs in all documents
    vocabulary = written(windows.select(F.explode("words").alias("w")).distinct(), "vocabulary")
    # the outer form adds no filter on the array, which would split each document once more for each of its conditions
    each = src.select(F.explode_outer("words").alias("w")).where("w IS NOT NULL")
    if vocabulary.count() <= MOST_BROADCAST:
        each = each.join(F.broadcast(vocabulary), "w", "left_semi")
    else:
        each = likely_members(each.withColumn("wh", F.xxhash64("w")), "wh", vocabulary.select(F.xxhash64("w").alias("wh")), "wh")
    counted = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # a window with a word that no document has can't occur; it is short of one row and dropped
    rare = windows.select("wid", "words", F.posexplode("words").alias("off", "w")).join(counted, "w").groupBy("wid").agg(
        F.first("words").alias("window"), F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "w", "off")).alias("least")
    ).where(F.col("known") == F.size("window"))
    prefixes = written(rare.select(F.col("least.w").alias("prefix"), F.col("least.off").alias("off"), "window", "wid"), "prefixes")

    near = written(_near_prefixes(src, prefixes, window), "near")
    start = F.col("pos") - F.col("off")
    same = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = same & (F.slice("context", F.greatest(start - F.col("begin"), F.lit(0)) + 1, F.size("window")) == F.col("window"))
    hits = near.where("w IS NOT NULL").join(prefixes, F.col("w") == F.col("prefix")).where(same).select(*ROW, start.alias("s"), (start + F.size("window")).alias("e"), "wid")
    hits = written(hits.distinct(), "hits")
    return _summary(near.where("w IS NULL").select(*ROW, "n_words"), hits, held)


def _near_prefixes(src: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """Document words that may be prefixes (w), their places and neighbours; and for each row of src one without a word.

    The explode and the look into what is broadcast are one code-generated stage: nothing is copied per word.
    """
    # the null behind the last word gives each row one row of its own
    each = src.select(*ROW, "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "w"))
    words = written(prefixes.select("prefix").distinct(), "prefix-words")
    if words.count() <= MOST_BROADCAST:
        found = each.join(F.broadcast(words), F.col("w") == F.col("prefix"), "left").where(F.col("w").isNull() | F.col("prefix").isNotNull())
    else:
        bits, bit, inside = bit_table(words.select(F.xxhash64("prefix").alias("wh")), "wh")
        found = each.withColumn("bit_", bit(F.xxhash64("w"))).join(bits, F.expr("word_ = bit_ DIV 64"), "left").where(F.col("w").isNull() | inside)
    begin = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    context = F.when(F.col("w").isNotNull(), F.slice("words", begin + 1, 2 * window - 1))
    return found.select(*ROW, F.size("words").cast("long").alias("n_words"), "w", "pos", begin.alias("begin"), context.alias("context"))


def _summary(heads: DataFrame, hits: DataFrame, held: DataFrame) -> DataFrame:
    """Length of the union of the hit intervals, and the items, for each document row."""
    by_row = Window.partitionBy(*ROW).orderBy("s", "e")
    before = F.max("e").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0))))
    none = lambda kind: F.lit(None).cast(kind)
    length = hits.select(*ROW, "s", "e").distinct().select(*ROW, none("long").alias("n_words"), new.cast("long").alias("new"), none("string").alias("item"))
    items = hits.select(*ROW, "wid").distinct().join(held.select("wid", F.col("item_id").cast("string").alias("item")), "wid").select(*ROW, none("long").alias("n_words"), none("long").alias("new"), "item").distinct()
    rows = heads.select(*ROW, "n_words", none("long").alias("new"), none("string").alias("item")).unionByName(length).unionByName(items)
    found = rows.groupBy(*ROW).agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    return found.select("doc_id", "n_words", "n_hit", "items", "t1", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
firsts AS (SELECT DISTINCT win[1] AS f, len(win) AS n FROM iw),
dw AS (SELECT doc_id, w, unnest(w) AS f, unnest(range(1, len(w) + 1)) AS s FROM d),
cand AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM dw JOIN firsts USING (f) WHERE s + n - 1 <= len(w)),
hit AS (SELECT doc_id, s, n, item_id FROM cand JOIN iw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
