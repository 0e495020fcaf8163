"""Which windows of a fixed number of symbols occur more than once in a corpus; shared by the two substring dedups.

A symbol is a byte or a word. Every window of ``window`` symbols has an anchor: the gram of ``gram`` symbols in it
with the least hash (the leftmost of equals). Equal windows have equal anchors, so windows with different anchor
hashes never have to meet. Consecutive windows with one anchor form a run; its text is a segment of at most
``2 * window - gram`` symbols. The steps:

1. runs of all documents, by numpy over whole batches (anchor hash, hash of the segment, document, place);
2. anchor hashes that occur once are dropped: their windows can't repeat. Counts are combined before the shuffle;
3. equal segments of one anchor count once, with their number (again combined before the shuffle);
4. one copy of each remaining segment goes to a shard by its anchor; a shard is a bounded number of symbols of whole
   anchors. All windows of a run hold the anchor's gram, so the gram becomes one symbol there. A compressed self-index
   of the shard gives the matching statistics of its segments, and with them the windows that occur twice;
5. the repeated windows go back to every run of the segment, and by document to the texts.

An anchor with more than ``most_segments`` different segments would outgrow a shard. Its windows are told apart by
128-bit fingerprints instead, counted by DataFrame operations over all executors; nothing is dropped.

With ``lone`` off, a segment that is the only one of its anchor skips the index: its windows occur as often as it does.

The tables between the steps are written to the shared folder, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import dropped, shuffle_partitions, small_batches, split_members, written
from siftwell.llm.text_index import Parents, Suffixes, joined, matching_statistics

BLOCK = 1 << 18  # symbols that are hashed at once
PLACE_BITS = 20  # of a symbol within a block; the rest of the anchor's 64 bits is hash
COUNT_BITS, START_BITS = 12, 31  # pos: 20 bits of the text's hash, start, number of windows less one
SHARD = 400_000  # symbols of one index
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Spec:
    words: bool
    window: int
    gram: int
    index: type
    most_segments: int
    lone: bool = True

    def __post_init__(self) -> None:
        assert self.gram & (self.gram - 1) == 0 and self.gram < self.window and self.window - self.gram < 1 << COUNT_BITS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE_A))


def _spans_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of h[begin:end]."""
    up, down = powers(1 << (len(h) + 1).bit_length(), base)
    summed = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=summed[1:])
    return mixed((summed[end] - summed[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of texts that lie side by side; offsets are the texts' borders."""
    word = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each symbol, and the number of symbols of each text."""
    if not words:
        return BYTE_HASH[data], np.diff(offsets)
    begin, end = word_bounds(data, offsets)
    sizes = np.diff(np.searchsorted(begin, offsets))
    return (_spans_hash(BYTE_HASH[data], begin, end, BASE_B) if len(begin) else np.zeros(0, np.uint64)), sizes


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k symbols, k a power of two."""
    span = 1
    while span < k:
        h = h[:-span] * np.uint64(BASE_A + 2 * span) + h[span:]
        span *= 2
    return mixed(h)


def runs(h: np.ndarray, sizes: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """Runs of the windows of texts that lie side by side: text, start, windows, anchor hash, segment hash."""
    n, size, k = len(h), spec.window, spec.gram
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < size:
        return none
    g = grams(h, k)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    m = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    width, span = size - k + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: n - size + 1], m[width - span :])
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.arange(n - size + 1) + size <= np.repeat(ends, sizes)[: n - size + 1])
    if not len(at):
        return none
    m = m[at]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    text = np.searchsorted(ends, start, side="right")
    segment = _spans_hash(h, start, start + count + size - 1, BASE_B)
    return text, start - (ends - sizes)[text], count, g[(m[first] & mask).astype(np.int64)], segment


def text_runs(data: np.ndarray, offsets: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of the texts of one batch, in blocks: whole texts, or overlapping pieces of a long one."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        part, borders = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(part) <= BLOCK:
            h, sizes = symbols(part, borders, spec.words)
            text, start, count, key, seg = runs(h, sizes, spec)
            yield text + at, start, count, key, seg
        else:
            step = BLOCK // 2
            h = np.concatenate([symbols(x, np.array([0, len(x)]), spec.words)[0] for x in _pieces(part, spec.words)])
            for s in range(0, max(1, len(h) - spec.window + 1), step):
                piece = h[s : s + step + spec.window - 1]
                text, start, count, key, seg = runs(piece, np.array([len(piece)]), spec)
                yield text + at, start + s, count, key, seg
        at = to


def _pieces(data: np.ndarray, words: bool) -> Iterator[np.ndarray]:
    """A long text in blocks; with words, cut at white space."""
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while words and to < len(data) and not SPACES[data[to]]:
            to += 1
        yield data[at:to]
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string column, without copies of the texts. Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (never null), and what tells rows apart: doc and rh.

    Ids that are all different do so by themselves, and take little room. Otherwise doc is 64 bits of a hash of id and
    text and rh 20 bits of another; rows of one id and one text are alike in everything, so they may share the mark.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    if not docs.select(own.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR id IS NULL").take(1):
        whole = F.coalesce(own, F.lit(0))  # there is no null, and so Spark knows it: a filter for it would undo the reuse of the texts' shuffle
        return docs.select(own.alias("id"), whole.alias("doc"), F.lit(0).cast("long").alias("rh"), text.alias("text"))
    return docs.select(own.alias("id"), F.xxhash64(own.isNull(), own, text).alias("doc"), F.xxhash64(F.lit(1), text).bitwiseAND((1 << 20) - 1).alias("rh"), text.alias("text"))


def run_table(src: DataFrame, spec: Spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rh = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for text, start, count, key, seg in text_runs(*text_buffer(b.column(2)), spec):
                pos = (rh[text] << START_BITS | start) << COUNT_BITS | (count - 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc[text]), pa.array(pos)], ["key", "seg", "doc", "pos"])

    return src.select("doc", "rh", "text").mapInArrow(run, "key long, seg long, doc long, pos long")


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bits of the text, start, number of windows."""
    return pos >> START_BITS + COUNT_BITS, pos >> COUNT_BITS & (1 << START_BITS) - 1, (pos & (1 << COUNT_BITS) - 1) + 1


def _slices(text: str, spec: Spec) -> Callable[[int, int], bytes]:
    """Cuts segments out of a text: symbols [a, b)."""
    data = text.encode()
    if not spec.words:
        return lambda a, b: data[a:b]
    words = data.split()
    return lambda a, b: b" ".join(words[a:b])


def segment_table(wanted: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """key, seg, copies, hot, body of the wanted segments (key, seg, copies, hot, doc, pos), cut from the texts."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "seg", "copies", "hot", "pos")).alias("wanted"))
    both = texts.join(lists, "doc").select("rh", "text", "wanted", "doc", "id")  # id: so that the shuffle of the texts serves twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for i, mark in enumerate(zip(b.column(3).to_pylist(), b.column(0).to_pylist(), strict=True)):
                if mark == last:  # repeated rows follow each other; one of them speaks for all
                    continue
                last = mark
                w = b.column(2)[i].values
                rh, start, count = unpacked(w.field("pos").to_numpy())
                mine = np.flatnonzero(rh == b.column(0)[i].as_py())
                if len(mine):
                    cut = _slices(b.column(1)[i].as_py(), spec)
                    w = w.take(pa.array(mine))
                    bodies = [cut(int(start[j]), int(start[j] + count[j]) + spec.window - 1) for j in mine]
                    yield pa.RecordBatch.from_arrays([*(w.field(x) for x in ("key", "seg", "copies", "hot")), pa.array(bodies, pa.binary())], ["key", "seg", "copies", "hot", "body"])

    return both.mapInArrow(run, "key long, seg long, copies long, hot boolean, body binary")


def as_symbols(bodies: list[bytes], words: bool) -> list[np.ndarray]:
    """Symbols from 1 on; equal words of one shard have equal numbers."""
    if not words:
        used = np.zeros(257, np.int64)
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        seen = np.flatnonzero(np.bincount(flat, minlength=256))
        used[seen] = np.arange(1, len(seen) + 1)
        return np.split(used[flat], np.cumsum([len(b) for b in bodies])[:-1])
    number: dict[bytes, int] = {}
    put = number.setdefault
    return [np.array([put(w, len(number) + 1) for w in b.split(b" ")], np.int64) for b in bodies]


def anchored(keys: list[int], bodies: list[bytes], spec: Spec) -> list[np.ndarray]:
    """Symbols of each segment with the anchor's gram, which its windows share, as one symbol."""
    sequences = as_symbols(bodies, spec.words)
    glue = b" " if spec.words else b""
    data = np.frombuffer(glue.join(bodies), np.uint8)
    h, _ = symbols(data, np.array([0, len(data)]), spec.words)
    sizes = np.array([len(s) for s in sequences], np.int64)
    begin = np.cumsum(sizes) - sizes
    hit = np.flatnonzero(grams(h, spec.gram) == np.repeat(np.array(keys, np.int64).view(np.uint64), sizes)[: len(h) - spec.gram + 1])
    at = hit[np.searchsorted(hit, begin)] - begin  # the anchor is the leftmost such gram
    core = max(int(s.max()) for s in sequences) + 1 + np.unique(np.array(keys), return_inverse=True)[1]
    return [np.concatenate([s[:a], [c], s[a + spec.gram :]]) for s, a, c in zip(sequences, at.tolist(), core.tolist(), strict=True)]


def repeated_windows(keys: list[int], bodies: list[bytes], copies: list[int], spec: Spec) -> list[list[int]]:
    """For each segment of a shard the windows that occur twice or more, as [a, b) pairs one after another."""
    out: list[list[int]] = []
    size = spec.window - spec.gram + 1
    sequences = anchored(keys, bodies, spec)
    suffixes = Suffixes(joined(sequences)[0], size)
    parents = Parents(suffixes.lcp, size)
    stats = matching_statistics(spec.index(suffixes), parents, sequences, size)
    for s, n in zip(stats, copies, strict=True):
        windows = len(s) - size + 1
        if n > 1:
            out.append([0, windows])
        else:
            hit = np.concatenate([[False], s[:windows] == size, [False]])
            out.append(np.flatnonzero(hit[1:] != hit[:-1]).tolist())
    return out


def shard_results(segments: DataFrame, spec: Spec, shards: int) -> DataFrame:
    """key, seg, spans of the segments that have repeated windows. Each task indexes whole anchors, about SHARD symbols at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            spans = repeated_windows([x[0] for x in held], [x[3] for x in held], [x[2] for x in held], spec)
            keep = [i for i, s in enumerate(spans) if s]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int64()), pa.array([spans[i] for i in keep], pa.list_(pa.int32()))], ["key", "seg", "spans"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += (row[3].count(b" ") + 1 if spec.words else len(row[3])) - spec.gram
        if held:
            yield flush()

    return segments.select("key", "seg", "copies", "body").repartition(shards, "key").sortWithinPartitions("key", "seg").mapInArrow(run, "key long, seg long, spans array<int>")


def hot_results(segments: DataFrame, spec: Spec) -> DataFrame:
    """The same for anchors with very many segments: windows are counted by 128-bit fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, seg, copies, body in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                data = np.frombuffer(body, np.uint8)
                h, _ = symbols(data, np.array([0, len(data)]), spec.words)
                at = np.arange(len(h) - spec.window + 1)
                a, c = (_spans_hash(h, at, at + spec.window, base).view(np.int64) for base in (BASE_A, BASE_B))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, seg)), pa.array(np.full(n, copies)), pa.array(at.astype(np.int32)), pa.array(a), pa.array(c)], ["key", "seg", "copies", "at", "a", "b"])

    each = segments.select("key", "seg", "copies", "body").mapInArrow(run, "key long, seg long, copies long, at int, a long, b long")
    twice = each.groupBy("key", "a", "b").agg(F.sum("copies").alias("n")).where("n > 1").select("key", "a", "b")
    found = each.join(twice, ["key", "a", "b"], "left_semi")
    return found.groupBy("key", "seg").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("spans"))


def repeats(src: DataFrame, spec: Spec, partitions: int | None = None) -> DataFrame:
    """id, rh, text, found: the runs of the text that hold repeated windows, as structs of pos and spans (null: none).

    Anchors and segments with very many rows are only counted (combined before the shuffle) and joined by equality,
    where adaptive execution splits a partition that one of them fills.
    """
    small_batches(src.sparkSession)
    n = partitions or shuffle_partitions(src.sparkSession)
    every = written(run_table(src, spec), "runs")
    twice = written(every.groupBy("key").count().where("count > 1").select("key"), "anchors")
    kept = written(every.join(twice, "key", "left_semi"), "kept")
    dropped(every, twice)
    segments = kept.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "pos")).alias("one"))
    segments = written(segments.select("key", "seg", "copies", "one.doc", "one.pos"), "segments")
    rivals = segments.groupBy("key").agg(F.count(F.lit(1)).alias("rivals"))
    crowded = written(rivals.where(F.col("rivals") > spec.most_segments).select("key", F.lit(True).alias("hot")), "crowded")
    any_hot = bool(crowded.take(1))
    wanted, lone = segments, None
    if not spec.lone:
        wanted, lone = split_members(segments, "key", written(rivals.where("rivals > 1").select("key"), "rivals"))
    wanted = wanted.join(crowded, "key", "left") if any_hot else wanted.withColumn("hot", F.lit(False))
    wanted = wanted.select("key", "seg", "copies", "doc", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))
    texts = src.repartition(n, "doc")
    bodies = segment_table(wanted, texts, spec)
    if any_hot:
        bodies = written(bodies, "bodies")
        results = shard_results(bodies.where("NOT hot"), spec, n).unionByName(hot_results(bodies.where("hot"), spec))
    else:
        results = shard_results(bodies, spec, n)
    if lone is not None:
        windows = F.col("pos").bitwiseAND((1 << COUNT_BITS) - 1).cast("int") + 1
        results = results.unionByName(lone.select("key", "seg", F.array(F.lit(0), windows).alias("spans")))
    placed = kept.join(results, ["key", "seg"]).groupBy("doc").agg(F.collect_list(F.struct("pos", "spans")).alias("found"))
    return texts.join(placed, "doc", "left").select("id", "rh", "text", "found")


def covered(found: pa.Scalar, rh: int, n: int, window: int) -> np.ndarray:
    """Which of the n symbols of a text are covered by its repeated windows."""
    mark = np.zeros(n + 1, np.int32)
    if found.is_valid and len(found):
        items = found.values
        bits, start, _ = unpacked(items.field("pos").to_numpy())
        spans = items.field("spans")
        flat, per = spans.flatten().to_numpy(), np.diff(spans.offsets.to_numpy()) // 2
        base, mine = np.repeat(start, per), np.repeat(bits == rh, per)
        a, b = (base + flat[0::2])[mine], (base + flat[1::2] - 1 + window)[mine]
        np.add.at(mark, a, 1)
        np.add.at(mark, b, -1)
    return np.cumsum(mark[:n]) > 0
