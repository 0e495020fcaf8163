"""N-gram Jaccard self-join with a token-group matrix, up to its connected components.

A document's set holds its distinct shingles (``shingle`` words, 4 in the query) as 64-bit hashes (a document of fewer
words has one shingle). Two documents link if 100 * intersection >= ``numerator`` (85 in the query) * union.

Candidates, without a loss: sets of at most r shingles that link differ in at most d = floor(2 (100 - numerator) r /
(100 + numerator)) shingles. The
shingles are dealt to more than d parts by their hash; a part without a difference is equal in both sets. So linked
sets share the signature (hash of all shingles) of a part that isn't empty. Part numbers depend on the size class
alone; a set also signs for the next class if a partner there can link with it. With more parts than d + 1, linked
sets share several signatures. If they share at least A, each may leave out its A - 1 most frequent ones (one order for
all) and they still share one: passages that many documents quote stop making candidates.

Groups: documents that share signatures gather around the least document of their most frequent signature partner.
Groups are cut into, or packed to, chunks of about ``CHUNK`` documents, so that no task holds an unbounded one.

1. In each chunk, documents are joined exactly: local groups keep the union of their tokens, the overlap of a document
   with that union bounds its similarity with every member, and only groups that the bound lets through are opened.
2. Signatures whose documents all lie in one component need nothing more. Of the others, chunks that hold documents
   outside the signature's largest component meet the chunks that the signature touches: chunks are paired, not
   documents, and each pair once, however many signatures it shares. In a pair, such documents are queries against
   the groups (by component) that share a signature with them, by the same bound.

Both steps verify on whole sets, so the links decide alone. Equal sets are linked through their 128-bit digest and do
not meet otherwise.

Defined cases: null texts and texts without words have an empty set and link with nothing; a null id keeps its own
row with a null component; rows that share an id count as linked, and each of their texts links; an empty table gives
an empty result; ties cannot arise (the threshold belongs to the links, the smallest id names a component); very long texts are read whole; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import dropped, likely_members, shuffle_partitions, small_batches, table, text_or_empty, written
from siftwell.llm.components import components
from siftwell.llm.repeats import BASE_A, BASE_B, BLOCK, _pieces, mixed, symbols, text_buffer

SHINGLE = 4
NUMERATOR = 85  # of 100
CHUNK = 256
#: About so many queries meet a chunk in one task; more are dealt over copies of the chunk.
QUERIES = 1000
#: Parts that the documents of one set are dealt to before they are linked.
EQUAL_SALTS = 32
CLASS_RATIO = 1.7
SLACK_SHARE, SLACK = 0.1, 5
U = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z counts as a-z."""
    out: list[np.ndarray] = []
    at, total = 0, len(offsets) - 1
    while at < total:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        part, borders = FOLD[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        if len(part) <= BLOCK:
            h, sizes = symbols(part, borders, True)
        else:
            h = np.concatenate([symbols(x, np.array([0, len(x)]), True)[0] for x in _pieces(part, True)])
            sizes = np.array([len(h)])
        ends = np.cumsum(sizes)
        g = h
        for j in range(1, n):
            g = g[:-1] * U(BASE_A) + h[j:] if len(g) > 1 else g[:0]
        g = mixed(g)
        for e, k in zip(ends.tolist(), sizes.tolist(), strict=True):
            if k >= n:
                out.append(np.unique(g[e - k : e - n + 1]))
            elif k:
                x = np.array([k], np.uint64)
                for i in range(e - k, e):
                    x = mixed(x + h[i : i + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def links(a: int, b: int, common: int, numerator: int = NUMERATOR) -> bool:
    return 100 * common >= numerator * (a + b - common)


def least_common(a: int, b: int, numerator: int = NUMERATOR) -> int:
    """The overlap that two sets of these sizes need."""
    return -(-numerator * (a + b) // (100 + numerator))


def size_class(n: int) -> int:
    k = max(0, int(np.log(max(n, 1)) / np.log(CLASS_RATIO)) - 1)
    while class_end(k) < n:
        k += 1
    return k


def class_end(k: int) -> int:
    """The largest size in class k."""
    return int(CLASS_RATIO ** (k + 1))


def parts_of(k: int, numerator: int = NUMERATOR) -> tuple[int, int]:
    """Number of parts for size class k, and the empty parts that it allows for; no parts if only equal sets link."""
    d = 2 * class_end(k) * (100 - numerator) // (100 + numerator)
    if not d:
        return 0, 0
    slack = SLACK + int(SLACK_SHARE * d)
    return d + 1 + slack, slack


def signatures(s: np.ndarray, numerator: int = NUMERATOR) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, all linked sets share one with it; and for each its size class and how many of that class may be left out."""
    n = len(s)
    none = np.zeros(0, np.int64)
    if not n:
        return s, none
    k = size_class(n)
    classes = [k] + ([k + 1] if 100 * n >= numerator * (class_end(k) + 1) else [])
    out, spare = [], []
    for c in classes:
        m, slack = parts_of(c, numerator)
        if not m:
            continue
        part = (mixed(s + U(c + 1)) % U(m)).astype(np.int64)
        filled = np.bincount(part, minlength=m) > 0
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mixed(s ^ U(BASE_B)))
        place = np.arange(m, dtype=np.uint64) + U(c << 40)
        signed = mixed(sums + mixed(place))
        largest = min(class_end(c), 100 * n // numerator)
        differ = (n + largest) * (100 - numerator) // (100 + numerator)
        empty = int(m - filled.sum())
        if empty > slack:  # more empty parts than allowed for: the empty ones have to speak as well
            empty = slack
        else:
            signed = signed[filled]
        out.append(signed)
        spare.append(np.full(len(signed), c << 32 | max(0, m - differ - empty - 1)))
    return (np.concatenate(out), np.concatenate(spare)) if out else (s[:0], none)


SIGNED = "doc long, sig long, spare long, digest struct<n:long,s1:long,s2:long>"


def _signed(src: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """doc, sig, spare of each signature (none where the task has already seen the set), and for each row of src one row with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, ids = b.num_rows, b.column(0).to_pylist()
                sets = shingle_sets(*text_buffer(b.column(1)), shingle)
                s1 = np.array([mixed(s ^ U(BASE_A)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([mixed(s + U(BASE_B)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                docs, sigs, spares = [], [], []
                for doc, s, key in zip(ids, sets, zip(s1.tolist(), s2.tolist(), strict=True), strict=True):
                    if doc is None or key in seen:
                        continue
                    if len(seen) > 200_000:  # only saves work: a set that is signed twice is still right
                        seen.clear()
                    seen.add(key)
                    signed, left = signatures(s, numerator)
                    docs.append(np.full(len(signed), doc, np.int64))
                    sigs.append(signed.view(np.int64))
                    spares.append(left)
                spread = mixed(np.arange(rows, rows + n, dtype=np.uint64) + U(1 << 62)).view(np.int64)  # deals the digests out evenly
                rows += n
                k = sum(map(len, sigs))
                flags = np.concatenate([np.ones(k, bool), np.zeros(n, bool)])
                fill = np.zeros(k, np.int64)
                digest = pa.StructArray.from_arrays([pa.array(np.concatenate([fill, x])) for x in (np.array([len(s) for s in sets], np.int64), s1, s2)], ["n", "s1", "s2"], mask=pa.array(flags))
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(np.concatenate([fill[:0], *docs])), b.column(0)]),
                    pa.array(np.concatenate([fill[:0], *sigs, spread])), pa.array(np.concatenate([fill[:0], *spares, np.zeros(n, np.int64)])), digest,
                ], ["doc", "sig", "spare", "digest"])

    return src.mapInArrow(run, SIGNED)


class Groups:
    """Token-group matrix of one task: groups of linked documents with the union of their tokens."""

    def __init__(self, numerator: int = NUMERATOR) -> None:
        self.numerator = numerator
        self.members: list[list[tuple[int, np.ndarray]]] = []
        self.union: list[np.ndarray] = []
        self.least: list[int] = []

    @staticmethod
    def overlap(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return 0
        i = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int((b[i] == a).sum())

    def linked(self, s: np.ndarray, among: Iterable[int] | None = None) -> list[tuple[int, int]]:
        """(group, a member that s links with) for every group, or each of those among, with such a member."""
        out = []
        for g in range(len(self.union)) if among is None else among:
            if self.overlap(s, self.union[g]) < least_common(len(s), self.least[g], self.numerator):
                continue  # no member shares enough
            for node, x in self.members[g]:
                if 100 * min(len(s), len(x)) >= self.numerator * max(len(s), len(x)) and links(len(s), len(x), self.overlap(s, x), self.numerator):
                    out.append((g, node))
                    break
        return out

    def add(self, node: int, s: np.ndarray) -> list[int]:
        """Takes a document in; the members that it was linked with (one for each group)."""
        found = self.linked(s)
        if not found:
            self.members.append([(node, s)])
            self.union.append(s)
            self.least.append(len(s))
        else:
            g = found[0][0]
            self.members[g].append((node, s))
            for other, _ in found[1:]:
                self.members[g] += self.members[other]
            self.union[g] = np.unique(np.concatenate([s, *(self.union[x] for x, _ in found)]))
            self.least[g] = min([len(s), *(self.least[x] for x, _ in found)])
            for other, _ in sorted(found[1:], reverse=True):
                del self.members[other], self.union[other], self.least[other]
        return [n for _, n in found]

    def put(self, group: dict, key: int, node: int, s: np.ndarray) -> int:
        """Takes a document in whose component is known; its group."""
        g = group.get(key)
        if g is None:
            g = group[key] = len(self.members)
            self.members.append([(node, s)])
            self.union.append(s)
            self.least.append(len(s))
        else:
            self.members[g].append((node, s))
            self.union[g] = np.union1d(self.union[g], s)
            self.least[g] = min(self.least[g], len(s))
        return g


def _grouped(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[tuple]:
    """Rows of sorted batches with the set of the last column's text appended."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            sets = shingle_sets(*text_buffer(part.column(part.num_columns - 1)), shingle)
            yield from zip(*(part.column(c).to_pylist() for c in range(part.num_columns - 1)), sets, strict=True)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["a", "b"])


def chunk_links(placed: DataFrame, partitions: int, shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """Exact links within chunks: placed has hub, salt, doc, text. Links that components don't need are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups, rows = None, Groups(numerator), []
        for hub, salt, doc, s in _grouped(batches, shingle):
            if (hub, salt) != now:
                now, groups = (hub, salt), Groups(numerator)
            rows += [(doc, other) for other in groups.add(doc, s)]
            if len(rows) > 5000:
                yield _pairs(rows)
                rows = []
        yield _pairs(rows)

    return placed.select("hub", "salt", "doc", "text").repartition(partitions, "hub", "salt").sortWithinPartitions("hub", "salt", "doc").mapInArrow(run, "a long, b long")


def query_links(asked: DataFrame, partitions: int, shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """Exact links of queries with chunks: asked has hub, salt, block, query (false: member), doc, component, sigs, text.

    A query looks at the groups that share a signature with it, the bound is asked for those, and the rest stay closed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups, place, signed, rows = None, Groups(numerator), {}, {}, []
        for hub, salt, block, query, doc, component, sigs, s in _grouped(batches, shingle):
            if (hub, salt, block) != now:
                now, groups, place, signed = (hub, salt, block), Groups(numerator), {}, {}
            if not query:
                g = groups.put(place, component, doc, s)
                for x in sigs:
                    signed.setdefault(x, set()).add(g)
            else:
                among = set().union(*(signed.get(x, ()) for x in sigs)) - {place.get(component)}
                rows += [(doc, other) for _, other in groups.linked(s, sorted(among))]
            if len(rows) > 5000:
                yield _pairs(rows)
                rows = []
        yield _pairs(rows)

    return asked.select("hub", "salt", "block", "query", "doc", "component", "sigs", "text").repartition(partitions, "hub", "salt", "block").sortWithinPartitions("hub", "salt", "block", "query", "doc").mapInArrow(run, "a long, b long")


def chunked(shared: DataFrame) -> DataFrame:
    """doc, hub, salt: the chunk of each document of shared (sig, doc, hub, n: documents of the signature).

    A document votes for the hub that it shares most signatures with; a hub without a better one stays its own. A hub
    of more than CHUNK documents is cut by their hashes. Smaller ones are packed, whole, with others of the same
    most frequent signature, so that a frequent signature touches few chunks, not one for each little hub.
    """
    votes = shared.groupBy("doc", "hub").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    best = votes.groupBy("doc").agg(F.max(F.struct(F.col("doc") != F.col("hub"), F.col("c"), F.bitwise_not("hub").alias("h"))).alias("v"), F.max(F.struct(F.col("n"), F.bitwise_not("hub").alias("h"))).alias("w"))
    best = written(best.select("doc", F.bitwise_not("v.h").alias("hub"), F.bitwise_not("w.h").alias("pack")), "votes")
    hubs = best.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).join(best.select(F.col("doc").alias("hub"), "pack"), "hub")
    packs = hubs.where(F.col("size") <= CHUNK).groupBy("pack").agg(F.ceil(F.sum("size") / CHUNK).alias("packs"))
    hubs = hubs.join(packs, "pack", "left")
    small = F.col("size") <= CHUNK
    placed = best.select("doc", "hub").join(hubs, "hub").select(
        "doc", F.col("hub").alias("centre"), F.when(small, F.col("pack")).otherwise(F.col("hub")).alias("hub"),
        F.when(small, -1 - F.pmod(F.xxhash64("hub"), "packs")).otherwise(F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / CHUNK))).alias("salt"),
    )
    placed = written(placed, "groups")
    dropped(best)
    return placed


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    # one shuffle of all signatures and digests; only shared signatures are kept, and of those the rarer ones of each document
    counted = _signed(src, shingle, numerator).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("c > 1 OR digest IS NOT NULL")
    counted = written(counted, "signatures")
    sets = written(counted.where("digest IS NOT NULL").selectExpr("doc AS doc_id", "digest.n AS n_shingles", "digest.s1", "digest.s2"), "sets")
    frequent = Window.partitionBy("doc", "spare").orderBy(F.desc("c"), "sig")
    trimmed = counted.where("digest IS NULL").withColumn("r", F.row_number().over(frequent)).where(F.col("r") > F.col("spare").bitwiseAND((1 << 32) - 1))
    trimmed = written(trimmed.select("sig", "doc"), "trimmed")
    dropped(counted)
    least = trimmed.groupBy("sig").agg(F.min("doc").alias("hub"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("hub <> last")
    shared = written(trimmed.join(least, "sig").select("sig", "doc", "hub", "n"), "shared")
    dropped(trimmed)
    equal = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # in two steps, so that the copies of one set are spread over tasks
    same, some = ["s1", "s2", "n_shingles"], F.pmod(F.xxhash64("doc_id"), F.lit(EQUAL_SALTS)).alias("part")
    local = equal.select(*same, some, "doc_id").groupBy(*same, "part").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("c"))
    whole = local.groupBy(*same).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    inside = equal.select(*same, some, "doc_id").join(local.where("c > 1"), [*same, "part"]).select(F.col("doc_id").alias("a"), "b")
    equal_links = inside.unionByName(local.join(whole, same).select(F.col("b").alias("a"), F.col("least").alias("b")))

    chunks = chunked(shared)
    centres = chunks.select(F.col("centre").alias("doc"), "hub", "salt").distinct()
    everyone = chunks.select("doc", "hub", "salt").unionByName(centres).distinct()
    wanted = chunks.select("doc")  # one row for each document
    texts = likely_members(src, "doc_id", wanted, "doc").join(wanted, F.col("doc_id") == F.col("doc"), "left_semi")
    texts = written(texts.select(F.col("doc_id").alias("doc"), "text").distinct(), "texts")  # every different text of an id
    inner = written(chunk_links(everyone.join(texts, "doc"), n, shingle, numerator), "links")
    known = written(equal_links.unionByName(inner), "known")
    labels = components(known)

    # signatures that still join several components
    place = chunks.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "hub", "salt", F.coalesce("component", "doc").alias("component"))
    named = written(shared.select("sig", "doc").join(place, "doc"), "named")
    sizes = named.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed_sigs = sizes.groupBy("sig").agg(F.max(F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sig", F.col("main.component").alias("main"))
    open_rows = written(named.join(mixed_sigs, "sig"), "open")
    # chunks of queries against chunks of members; within one chunk everything has met already
    touched = open_rows.groupBy("sig", "hub", "salt").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("component") != F.col("main")).alias("asks"))
    asking = touched.where("asks").select("sig", F.col("hub").alias("own"), F.col("salt").alias("part"), F.col("lo").alias("least"), F.col("hi").alias("most"))
    pairs = touched.join(asking, "sig").where("(hub <> own OR salt <> part) AND (lo <> hi OR least <> most OR lo <> least)").select("own", "part", "hub", "salt").distinct()
    pairs = written(pairs, "pairs")
    docs_open = open_rows.groupBy("doc", "hub", "salt", "component").agg(F.collect_set("sig").alias("sigs"), F.max(F.col("component") != F.col("main")).alias("asks"))
    docs_open = written(docs_open, "askers")
    queries = docs_open.where("asks").select(F.col("hub").alias("own"), F.col("salt").alias("part"), "doc", "component", "sigs")
    counts = queries.groupBy("own", "part").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(counts, ["own", "part"]).groupBy("hub", "salt").agg(F.ceil(F.sum("c") / QUERIES).cast("int").alias("blocks"))
    members = docs_open.join(dealt, ["hub", "salt"]).select("hub", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), "doc", "component", "sigs")
    asked = pairs.join(dealt, ["hub", "salt"]).join(queries, ["own", "part"]).select("hub", "salt", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block"), F.lit(True).alias("query"), "doc", "component", "sigs")
    outer = written(query_links(members.unionByName(asked).join(texts, "doc"), n, shingle, numerator), "links")
    if outer.take(1):
        before, labels = labels, components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(outer))
        dropped(before)
    dropped(shared, chunks, texts, inner, known, named, open_rows, pairs, docs_open, outer)
    return sets.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m ON m.doc_id = d.doc_id
"""
