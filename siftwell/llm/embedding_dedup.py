"""Near-copies among vectors by collision-counting projections.

Equal vectors of a label are one node. Each node is projected on ``PROJECTIONS`` directions (random orthonormal bases, scaled
so that two unit vectors at distance t differ by about t in each). A window around a query's projection has the half width ``WINDOW`` times the distance of
a pair at the threshold; the first ``LEADS`` directions have wider windows (``LEAD_WINDOW`` times that distance), outside of which no pair is counted. A
pair is verified by its cosine in double precision if it lies in all lead windows and collides in enough of all windows; how many is enough is calibrated on
simulated pairs that lie exactly at the threshold, so that at least ``RECALL`` of those with that many leads pass. What is found is exact; what is lost is measured in the tests.

Projections are sorted into cells: each lead direction in turn is split at its median (fitted on at most ``SAMPLE`` nodes) until cells hold
about ``CELL`` nodes. A node stands in one cell as a point and goes as a query to every cell that its lead windows touch, so pairs that
cannot collide never meet, and the cells change no result. Nodes are range-partitioned by cell and packed; a cell of any size is many
packs, and packs of queries meet packs of points one pair at a time. A pair of packs gives the sums of links of its queries and a spanning
forest of its links, so that a dense group of g vectors gives about g rows for each two packs, not its g * g pairs.

Defined cases: a null id is a vector without a name: it is linked, counted and returned, but is never a component's id (a component of such rows alone has a null id);
vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing; vectors of different length never link;
repeated rows are vectors of their own that link with each other; a single vector is its own component; ties cannot arise (the threshold belongs to the links); other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import dropped, shuffle_partitions, small_batches, table, written
from siftwell.llm.components import components
from siftwell.llm.packs import decoder, matrix, packed, usable_vector

PROJECTIONS, LEADS = 32, 12
#: Half widths of the windows, in distances of a pair at the threshold.
WINDOW, LEAD_WINDOW = 1.0, 3.0
#: Share of the simulated pairs at the threshold that the count must let through, and how many are simulated.
RECALL, SIMULATED = 0.995, 20_000
#: Nodes of a cell that is split no further and of a pack, and nodes that the medians are taken from.
CELL, SAMPLE = 4096, 4096
#: Components that the sample, the simulation and a step of the verification hold at most.
HELD = 1 << 22
#: A node with more than total / (HOT_SHARE * partitions) equal vectors is hot.
HOT_SHARE = 4
#: Queries of a step, and lead windows that every pair of a step is tried on before pairs are listed.
STEP, DENSE_LEADS = 64, 4


@lru_cache(maxsize=16)
def directions(d: int) -> np.ndarray:
    """d x PROJECTIONS: columns of random orthonormal bases, scaled by the root of d."""
    rng = np.random.default_rng([20_231, d])
    bases = [np.linalg.qr(rng.standard_normal((d, d if d < PROJECTIONS else PROJECTIONS)))[0] for _ in range(-(-PROJECTIONS // min(d, PROJECTIONS)))]
    return np.concatenate(bases, 1)[:, :PROJECTIONS] * math.sqrt(d)


def distance(threshold: float) -> float:
    """Distance of two unit vectors whose cosine is the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


@lru_cache(maxsize=16)
def enough(d: int, threshold: float) -> int:
    """The most collisions that RECALL of the simulated pairs at the threshold reach."""
    n = max(500, min(SIMULATED, HELD // max(1, d)))
    rng = np.random.default_rng([7, d])
    a = unit(rng.standard_normal((n, d)))
    b = rng.standard_normal((n, d))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)  # at right angles; of one dimension there are none
    gap = (a * (threshold - 1) + b * math.sqrt(1 - threshold * threshold)) @ directions(d)
    collisions = np.sort((np.abs(gap) <= WINDOW * distance(threshold)).sum(1))
    return int(collisions[int((1 - RECALL) * n)])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; components are scaled first, so that squares neither overflow nor vanish."""
    most = np.abs(vectors).max(1, keepdims=True, initial=0)
    scaled = np.divide(vectors, most, out=np.zeros_like(vectors), where=most > 0)
    length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return np.divide(scaled, length, out=scaled, where=length > 0)


def linked(queries: np.ndarray, points: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and points (unit vectors) whose cosine reaches the threshold, among those that collide often enough; in steps."""
    d = queries.shape[1]
    least, gap = enough(d, threshold), distance(threshold)
    q, p = (queries @ directions(d)).astype(np.float32), (points @ directions(d)).astype(np.float32)
    wide, narrow = np.float32(LEAD_WINDOW * gap + 1e-5), np.float32(WINDOW * gap + 1e-5)
    leads = np.ascontiguousarray(p[:, :DENSE_LEADS].T)
    most = max(1, HELD // max(PROJECTIONS, d))
    for at in range(0, len(q), STEP):
        near = np.ones((min(STEP, len(q) - at), len(p)), bool)
        for j in range(DENSE_LEADS):
            near &= np.abs(q[at : at + STEP, j, None] - leads[j]) <= wide
        i, k = np.nonzero(near)
        i += at
        for lo in range(0, len(i), most):
            a, b = i[lo : lo + most], k[lo : lo + most]
            apart = np.abs(q[a] - p[b])
            ok = (apart[:, :LEADS] <= wide).all(1) & ((apart <= narrow).sum(1) >= least)
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", queries[a], points[b]) >= threshold
            if ok.any():
                yield a[ok], b[ok]


class Forest:
    """Joins numbers 0..n-1 pair by pair; each is tied to the least of its group."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def found_in(queries: tuple, points: tuple, threshold: float) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(node, vectors that it links with among the points), and edges that connect what is linked."""
    q_nodes, q_vectors, _ = queries
    p_nodes, p_vectors, counts = points
    number = {x: i for i, x in enumerate(dict.fromkeys([*q_nodes, *p_nodes]))}
    q_number, p_number = np.array([number[x] for x in q_nodes]), np.array([number[x] for x in p_nodes])
    links, forest = np.zeros(len(q_nodes), np.int64), Forest(len(number))
    for i, k in linked(q_vectors, p_vectors, threshold):
        other = q_number[i] != p_number[k]
        i, k = i[other], k[other]
        links += np.bincount(i, counts[k], len(links)).astype(np.int64)
        forest.join(q_number[i], p_number[k])
    names = list(number)
    tied = np.flatnonzero(forest.root != np.arange(len(names)))
    return [(q_nodes[i], int(links[i])) for i in np.flatnonzero(links)], [(names[i], names[forest.root[i]]) for i in tied]


def routed(nodes: DataFrame, medians: dict[int, np.ndarray], splits: int, threshold: float) -> DataFrame:
    """label, d, cell, query, node, n, vector: each node as a point of its cell and as a query of all cells that its lead windows touch."""
    types = dict(nodes.dtypes)
    wide = LEAD_WINDOW * distance(threshold) + 1e-4  # a little wider than the windows, so that rounding loses nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                p = unit(matrix(part.column("vector"))) @ directions(int(d))[:, :splits]
                middle = medians.get(int(d), np.zeros(LEADS))[:splits]
                bits = 1 << np.arange(splits)
                own = ((p > middle) @ bits).astype(np.int64)
                rows, cells = np.arange(len(p)), np.zeros(len(p), np.int64)
                for j in range(splits):  # a query goes to both sides of a split that its window touches
                    low, high = p[rows, j] - wide <= middle[j], p[rows, j] + wide > middle[j]
                    rows, cells = np.concatenate([rows[low], rows[high]]), np.concatenate([cells[low], cells[high] + bits[j]])
                for at, cell, query in ((np.arange(len(p)), own, 0), (rows, cells, 1)):
                    for lo in range(0, len(at), 4096):
                        some = part.take(pa.array(at[lo : lo + 4096]))
                        yield pa.RecordBatch.from_arrays(
                            [some.column("label"), some.column("d"), pa.array(cell[lo : lo + 4096]), pa.array(np.full(some.num_rows, query, np.int8)), some.column("node"), some.column("n"), some.column("vector")],
                            ["label", "d", "cell", "query", "node", "n", "vector"],
                        )

    return nodes.mapInArrow(run, f"label {types['label']}, d int, cell long, query byte, node string, n long, vector {types['vector']}")


def met(packs: DataFrame, parts: int) -> DataFrame:
    """Pairs of a pack of points and a pack of queries of one cell. The packs of points of a cell are numbered and its packs of queries repeated for each,
    so that a cell of many packs is dealt over many tasks."""
    cell = ["label", "d", "cell"]
    points = packs.where("query = 0").withColumn("s", F.row_number().over(Window.partitionBy(*cell).orderBy("pack")))
    numbers = points.select(*cell, "pack", "s")
    many = numbers.groupBy(*cell).agg(F.max("s").alias("most"))
    points = packs.where("query = 0").join(numbers, [*cell, "pack"]).select(*cell, "s", F.col("pack").alias("point_pack"), F.col("data").alias("point_data"))
    asked = packs.where("query = 1").join(many, cell).select(*cell, F.explode(F.sequence(F.lit(1), "most")).alias("s"), F.col("pack").alias("query_pack"), F.col("data").alias("query_data"))
    keys = [*cell, "s"]
    return points.repartition(parts, *keys).join(asked.repartition(parts, *keys), keys).select("point_pack", "point_data", "query_pack", "query_data")


def links_and_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """node and links (partial sums), or node and other (edges), of the nodes (node, label, d, vector, n)."""
    spark = nodes.sparkSession
    parts = shuffle_partitions(spark)
    shape = nodes.groupBy("label", "d").count().agg(F.max("count").alias("most"), F.max("d").alias("widest")).first()
    most, widest = shape["most"] or 1, shape["widest"] or 1
    splits = min(LEADS, max(0, math.ceil(math.log2(most / CELL))))
    medians: dict[int, np.ndarray] = {}
    if splits:
        sample = nodes.orderBy("node").limit(max(64, min(SAMPLE, HELD // widest))).select("d", "vector").collect()  # bounded in rows and components
        for d in {r["d"] for r in sample}:
            medians[d] = np.median(unit(np.array([r["vector"] for r in sample if r["d"] == d], float)) @ directions(d)[:, :LEADS], axis=0)
    cells = routed(nodes, medians, splits, threshold).repartitionByRange(parts, "label", "d", "cell", "query", "node").sortWithinPartitions("label", "d", "cell", "query")
    packs = written(packed(cells, CELL, ["label", "d", "cell", "query"]), "vector-packs")

    def decode(batch: pa.RecordBatch) -> tuple:
        return batch.column("node").to_pylist(), unit(matrix(batch.column("vector"))), batch.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.string()), ("other", pa.string()), ("links", pa.int64())])
        points_of, queries_of = decoder(decode), decoder(decode)
        for b in batches:
            for i in range(b.num_rows):
                sums, edges = found_in(queries_of(b.column(2)[i].as_py(), b.column(3)[i]), points_of(b.column(0)[i].as_py(), b.column(1)[i]), threshold)
                rows = [(x, None, n) for x, n in sums] + [(x, y, 0) for x, y in edges]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)

    out = written(met(packs, parts).mapInArrow(run, "node string, other string, links long"), "vector-links")
    dropped(packs)
    return out


def similar_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept: one row for each vector. Vectors link if their labels are equal and their cosine is at least the threshold (above 0, at most 1)."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = F.col("label").isNotNull() & usable_vector(v) & F.exists(v, lambda x: x != 0)
    text = F.concat_ws(",", F.col("label").cast("string"), F.transform(v, lambda x: (x + 0.0).cast("string")))
    rows = rows.withColumn("node", F.when(usable, F.md5(text)))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = written(nodes.withColumn("d", F.size("vector")), "vectors")
    found = links_and_edges(nodes.select("node", "label", "d", "vector", "n"), threshold)
    sums = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "n", "least").join(sums, "node", "left").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = written(known.join(least, "component").select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-groups")
    dropped(nodes, found)

    # Rows of hot nodes, of which there are at most HOT_SHARE * partitions, are answered by a broadcast; they and rows without a node go by other keys to the join.
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") > max(1000, total // (HOT_SHARE * shuffle_partitions(spark))))
    hot = hot.select(F.col("node").alias("hot_"), F.col("n_links").alias("hot_links"), F.col("component_id").alias("hot_id"))
    marked = rows.select("id", "node").join(F.broadcast(hot), F.col("node") == F.col("hot_"), "left")
    marked = marked.withColumn("key_", F.when(F.col("hot_").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    cold = known.select(F.col("node").alias("key_"), "n_links", "component_id")
    out = marked.join(cold, "key_", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).when(F.col("hot_").isNotNull(), F.col("hot_id")).otherwise(F.col("component_id"))
    out = out.select("id", F.coalesce("hot_links", "n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
w(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, w.c FROM w JOIN l ON l.b = w.a),
c AS (SELECT a, min(c) AS component_id FROM w GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
