"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

Rows are packed into blocks as they are read, and every block of anchors meets every block of rows (a stated query set against
all rows): anchors are repeated once for each shard of row blocks, rows are shuffled once. In a block all scores of an anchor are integer
inner products, sorted by score and id. First each anchor's positives are found: its best rows of the same label, block by block, then over all
blocks. Then the blocks are met again: in the sorted scores of an anchor, binary search finds where each positive's upper limit begins, and
reading on from there gives the first rows of other labels above its lower limit. The first k of all blocks are the first k of the firsts of each block, so
nothing is lost, and no task holds more than two blocks.

Scores are exact: components become whole numbers, products are added in double precision while all sums stay below 2**53, and as whole numbers
of any size beyond; a score that doesn't fit a long raises an error.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; a vector that is shorter than another counts as
filled up with zeros, an empty one has the score 0; repeated rows each count, but an anchor that is repeated as a whole is one anchor; other rows
than an anchor are those of another id; equal scores go by the smaller id; a positive whose score is not above 0 has a band that holds only 0 or nothing; an
anchor without positives, or a positive without negatives, has no row; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import dropped, shuffle_partitions, small_batches, table, written
from siftwell.llm.packs import decoder, matrix, packed, usable_vector

#: Rows and anchors of a block, and anchors whose scores a task holds at once.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 8192, 512, 64
#: Sums of doubles are exact below this.
EXACT = 2.0**53


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, as longs; anchors and rows hold whole numbers."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if most < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    found = whole(anchors) @ whole(rows).T if anchors.size and rows.size else np.zeros((len(anchors), len(rows)), object)
    if any(abs(x) >= 2**63 for x in found.flat):
        raise OverflowError("a score doesn't fit a long")
    return found.astype(np.int64)


class Sorted:
    """The scores of some anchors with some rows (of ascending id), each anchor's sorted by score, best first, then by id."""

    def __init__(self, scores: np.ndarray) -> None:
        n = scores.shape[1]
        self.bits = max(1, (n - 1).bit_length())
        self.keys = None
        if n and float(np.abs(scores).max()) < 2.0 ** (62 - self.bits):  # score and place fit one number, which sorts like the two
            self.keys = np.sort((-scores << self.bits) | np.arange(n), axis=1)
        else:
            self.order = np.array([np.lexsort((np.arange(n), -s.astype(object) if s.size and s.min() == -(2**63) else -s)) for s in scores], np.int64).reshape(scores.shape)
            self.scores = np.take_along_axis(scores, self.order, 1)

    def first_at_most(self, i: int, score: int) -> int:
        """The place in anchor i's order at which scores are no longer above score."""
        if self.keys is not None:
            top = 1 << (62 - self.bits)
            return 0 if score >= top else self.keys.shape[1] if score <= -top else int(np.searchsorted(self.keys[i], -score << self.bits))
        return int(np.searchsorted(-self.scores[i], -score))

    def places(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Which rows stand from lo to hi in anchor i's order."""
        return self.keys[i, lo:hi] & ((1 << self.bits) - 1) if self.keys is not None else self.order[i, lo:hi]

    def score(self, i: int, at: np.ndarray) -> np.ndarray:
        return -(self.keys[i, at] >> self.bits) if self.keys is not None else self.scores[i, at]


def first_fitting(ranked: Sorted, i: int, lo: int, hi: int, fits, k: int) -> np.ndarray:
    """Places in anchor i's order, from lo to hi, of the first k rows that fit; reads on in growing steps."""
    found: list[np.ndarray] = []
    left, step = k, 4 * k
    while left > 0 and lo < hi:
        end = min(hi, lo + step)
        got = np.flatnonzero(fits(ranked.places(i, lo, end)))[:left] + lo
        found.append(got)
        left, lo, step = left - len(got), end, step * 4
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), batch.column("label").to_numpy(), np.floor(matrix(batch.column("vector")) * scale)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    wide = lambda m: m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))
    return wide(a), wide(b)


def positives_in(rows: tuple, anchors: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor: its number, scores and ids of its first k other rows of the same label among these rows (sorted by label and id)."""
    ids, labels, vectors = rows
    numbers, anchor_ids, anchor_labels, anchor_vectors = anchors
    vectors, anchor_vectors = _same_width(vectors, anchor_vectors)
    for label in np.unique(anchor_labels):
        lo, hi = np.searchsorted(labels, [label, label], side="left")[0], np.searchsorted(labels, label, side="right")
        if lo == hi:
            continue
        mine = np.flatnonzero(anchor_labels == label)
        for at in range(0, len(mine), AT_ONCE):
            some = mine[at : at + AT_ONCE]
            ranked = Sorted(scores_of(anchor_vectors[some], vectors[lo:hi]))
            own = ids[lo:hi]
            for i, a in enumerate(some):
                got = first_fitting(ranked, i, 0, hi - lo, lambda x, a=a, own=own: own[x] != anchor_ids[a], k)
                yield int(numbers[a]), ranked.score(i, got), own[ranked.places(i, 0, hi - lo)[got]]


def negatives_in(rows: tuple, anchors: tuple, positives: list, k: int, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor and positive (score, id): the anchor's place, the positive's, scores and ids of its first k rows of another label within the band."""
    ids, labels, vectors = rows
    anchor_labels, anchor_vectors = anchors
    vectors, anchor_vectors = _same_width(vectors, anchor_vectors)
    for at in range(0, len(anchor_labels), AT_ONCE):
        ranked = Sorted(scores_of(anchor_vectors[at : at + AT_ONCE], vectors))
        for i, label in enumerate(anchor_labels[at : at + AT_ONCE]):
            for p, positive in enumerate(positives[at + i]):
                most, least = high * positive["score"] // 100, -(-low * positive["score"] // 100)
                lo, hi = ranked.first_at_most(i, most), ranked.first_at_most(i, least - 1)
                got = first_fitting(ranked, i, lo, hi, lambda x, label=label: labels[x] != label, k)
                if len(got):
                    first = int(got[0])
                    yield at + i, p, ranked.score(i, got), ids[ranked.places(i, first, int(got[-1]) + 1)[got - first]]


def _met(rows: DataFrame, anchors: DataFrame, shards: list[int], parts: int) -> DataFrame:
    """Pairs of a block of rows and a block of anchors; those of one block of rows follow each other."""
    each = anchors.select(F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard"), F.col("pack").alias("anchor_pack"), F.col("data").alias("anchor_data"))
    return rows.repartition(parts, "shard").join(each.repartition(parts, "shard"), "shard").select("pack", "data", "anchor_pack", "anchor_data")


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, by_label: bool) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    def decode(batch: pa.RecordBatch) -> tuple:
        ids, labels, vectors = _whole(batch, scale)
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        return ids[order], labels[order], vectors[order]

    rows_of, anchors_of = decoder(decode), decoder(lambda batch: batch)
    for b in batches:
        for i in range(b.num_rows):
            yield rows_of(b.column(0)[i].as_py(), b.column(1)[i]), anchors_of(b.column(2)[i].as_py(), b.column(3)[i])


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor is a condition on the columns of vectors; ids and labels are whole numbers.

    Components become floor(scale * x). A negative's score is from low to high hundredths of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable_vector(F.col("vector")))
    parts = shuffle_partitions(spark)
    blocks = packed(usable.select("id", "label", "vector"), BLOCK_ROWS).select("pack", "data", F.pmod(F.shiftright("pack", 33) + F.col("pack").bitwiseAND((1 << 33) - 1), F.lit(parts)).cast("int").alias("shard"))
    blocks = written(blocks, "row-blocks")
    shards = sorted(r["shard"] for r in blocks.select("shard").distinct().collect())  # at most as many as shuffle partitions
    asked = usable.where("anchor").select("id", "label", "vector").distinct().withColumn("number", F.monotonically_increasing_id())
    asked = written(asked, "anchors")
    if not shards:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def positives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("number", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
        for rows, anchors in _blocks(batches, scale, True):
            ids, labels, own = _whole(anchors, scale)
            found = list(positives_in(rows, (anchors.column("number").to_numpy(), ids, labels, own), positives))
            out = [(number, s, i) for number, score, got in found for s, i in zip(score.tolist(), got.tolist(), strict=True)]
            if out:
                yield _out(out, schema)

    best = _met(blocks, packed(asked, BLOCK_ANCHORS), shards, parts).mapInArrow(positives_of, "number long, score long, id long")
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))).where(F.col("at") <= positives)
    best = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
    held = written(asked.join(best, "number"), "positives")

    def negatives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("number", pa.int64()), ("at", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64()), ("negative_id", pa.int64())])
        for rows, anchors in _blocks(batches, scale, False):
            ids, labels, own = _whole(anchors, scale)
            numbers, known = anchors.column("number").to_pylist(), anchors.column("positives").to_pylist()
            out = []
            for a, p, score, got in negatives_in(rows, (labels, own), known, negatives, low, high):
                x = known[a][p]
                out += [(numbers[a], x["at"], int(ids[a]), x["id"], x["score"], s, i) for s, i in zip(score.tolist(), got.tolist(), strict=True)]
            if out:
                yield _out(out, schema)

    found = _met(blocks, packed(held, BLOCK_ANCHORS), shards, parts).mapInArrow(negatives_of, "number long, at int, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    order = Window.partitionBy("number", "at").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = written(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    dropped(blocks, asked, held)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH c AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, embedding FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
r AS (SELECT vec_id, label, v FROM c WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
"""
