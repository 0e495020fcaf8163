"""Writes pages as WARC archives and reads archives back with a verified boundary chain.

Writing: pages with equal payloads are found by SHA-256 of the payload; the page with the largest id becomes the
response, the others revisit it. A payload with very many copies is spread over salted groups (its response is known
from counts that are combined before the shuffle; at most ``4 * partitions`` payloads can be that frequent). Spark's
text writer puts the records into gzip files in the shared folder, at most ``RECORDS_PER_FILE`` in each.

Reading: Spark's text reader cuts archives at the version mark, so a plain archive is read in splits by many tasks, a
gzip file as a stream by one; no task holds an archive. Every mark is a candidate record. A task emits, for each candidate
of its split, the offset of its successor and where the chain from it leaves the split (pointer jumping). Offsets within
a split become offsets in the file by running sums of split sizes; pointer jumping over the joined offsets (each round
doubles the known chain, one round for each doubling of the splits of a file) finds where the chain from the start of the
file enters each split, and only the candidates reached from there stay: marks inside payloads are rejected. Payloads
are hashed as they are read; a record that goes on in the next split behind a mark in its payload is put together from
its pieces afterwards.

Defined cases: a null html is an empty payload; empty payloads count as equal; a null url is left out of the header;
repeated rows of one page make one response and revisits of it; an empty table gives an empty result; a file whose
chain breaks raises an error instead of losing records; a file without bytes has no records; ids are any long; ties cannot arise (the largest id is the
response); a very long payload is one record, which a task holds whole; columns other than the id, the url and the payload are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import dropped, shared_dir, shuffle_partitions, small_batches, table, text_or_empty, written

RECORDS_PER_FILE = 10_000
HOT_SHARE = 4
#: What every record starts with, and what may follow it.
MARK, VERSIONS = b"WARC/1.", (b"0\r\n", b"1\r\n")
#: Kinds of rows of a scan.
RECORD, CANDIDATE, SPLIT, HEADLESS = 0, 1, 2, 3
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hexadecimal digits give four characters each."""
    hexed = F.sha1(payload.cast("binary"))
    chars = []
    for g in range(8):
        group = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def with_response(pages: DataFrame, id_col: str, url_col: str, payload_col: str, partitions: int | None = None) -> DataFrame:
    """page_id, url, payload, refers_to (id of the response; null for the response itself)."""
    spark = pages.sparkSession
    n = partitions or shuffle_partitions(spark)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(payload_col).alias("payload"))
    src = src.withColumn("same", F.sha2("payload", 256)).withColumn("salt", F.lit(0).cast("long"))
    threshold = max(16, pages.count() // (HOT_SHARE * n))
    counted = src.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("known"))
    hot = [(r["same"], r["known"]) for r in counted.where(F.col("n") > threshold).collect()]  # HOT_SHARE * n at most
    if hot:
        marked = F.broadcast(spark.createDataFrame(hot, "same string, known long"))
        src = src.join(marked, "same", "left").withColumn("salt", F.when(F.col("known").isNotNull(), F.xxhash64("page_id")).otherwise(0))
    group = Window.partitionBy("same", "salt")
    best = F.max("page_id").over(group)
    if hot:
        best = F.coalesce("known", best)
    first = F.row_number().over(group.orderBy(F.desc_nulls_last("page_id"))) == 1
    return src.select("page_id", "url", "payload", best.alias("best"), first.alias("first")).select(
        "page_id", "url", "payload", F.when(F.col("first") & F.col("page_id").eqNullSafe(F.col("best")), None).otherwise(F.col("best")).alias("refers_to"),
        (~(F.col("first") & F.col("page_id").eqNullSafe(F.col("best")))).alias("revisit"),
    )


def record(page_id: Column, url: Column, payload: Column, revisit: Column, refers_to: Column) -> Column:
    """One record without its last line feed, which the text writer adds."""
    digest = base32_sha1(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.coalesce(refers_to.cast("string"), F.lit("null")), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip") -> None:
    """Writes archives into the folder path, which all executors must share. With compression="none" they are read in splits later."""
    found = with_response(pages, id_col, url_col, payload_col)
    records = found.select(record(*(F.col(c) for c in ("page_id", "url", "payload", "revisit", "refers_to"))).alias("value"))
    records.write.option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).option("lineSep", "\n").text(path)


BREAK = b"\r\n\r\n"
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
#: Records are handed on in batches of this many.
BATCH = 1000


def _header(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(uri: str | None) -> int | None:
    found = (uri or "").strip("<>").removeprefix(ID)
    if not re.fullmatch(r"-?[0-9]{1,19}", found):
        return None
    return int(found) if -(2**63) <= int(found) < 2**63 else None


class Candidate:
    """A record that is being read from the bytes behind its mark. What it keeps of them: headers, a digest, and the payload if asked to. One that is not read keeps its length only."""

    def __init__(self, at: int, keep: bool, read: bool = True):
        self.at, self.keep, self.read, self.head, self.need, self.left = at, keep, read, None, None, 0
        self.pending, self.http, self.tail = bytearray(MARK), None, b""
        self.sha, self.bytes, self.parts, self.valid, self.closed = hashlib.sha1(), 0, [], False, False

    def feed(self, data: bytes) -> None:
        if self.head is None:
            searched = max(0, len(self.pending) - 3)
            self.pending += data
            end = self.pending.find(BREAK, searched)
            if end < 0:
                return
            found = LENGTH.search(self.pending, 0, end + 2)
            if not found:
                self.closed = True
                return
            self.head, self.left = _header(bytes(self.pending[:end])), int(found[1])
            self.need = end + 4 + self.left + 4
            if not self.read:
                return
            data, self.pending = bytes(self.pending[end + 4 :]), bytearray()
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        if block and self.http is None:
            searched = max(0, len(self.pending) - 3)
            self.pending += block
            end = self.pending.find(BREAK, searched)
            if end < 0:
                block = b""
            else:
                self.http, block = bytes(self.pending[:end]), bytes(self.pending[end + 4 :])
                self.pending = bytearray()
        if block:
            self.sha.update(block)
            self.bytes += len(block)
            if self.keep:
                self.parts.append(block)
        if not self.left:
            self.tail += rest[: 4 - len(self.tail)]
            if len(self.tail) == 4:
                self.closed, self.valid = True, self.tail == BREAK

    def row(self) -> tuple:
        """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
        head = self.head
        kind, page, url = head.get("warc-type"), _page(head.get("warc-record-id")), head.get("warc-target-uri")
        if kind == "revisit":
            http = self.http if self.http is not None else bytes(self.pending)
            length = _header(http).get("content-length", "")
            return page, url, int(length) if re.fullmatch(r"\d{1,18}", length) else 0, head.get("warc-payload-digest", "").removeprefix("sha1:"), kind, _page(head.get("warc-refers-to")), None
        return page, url, self.bytes, base64.b32encode(self.sha.digest()).decode(), kind, None, b"".join(self.parts) if self.keep else None


def leaps(at: np.ndarray, successor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For candidates at ascending offsets of a split of that size: the place of each one's successor among them (its own place: none there), and the
    offset at or behind the split's end where the chain from it comes out (-1: it breaks), by pointer jumping."""
    n = len(at)
    place = np.searchsorted(at, successor)
    inside = (place < n) & (at[np.minimum(place, n - 1)] == successor) if n else np.zeros(0, bool)
    step = np.where(inside, place, np.arange(n))
    root = step
    for _ in range(n.bit_length()):
        root = root[root]
    return step, np.where(successor[root] >= size, successor[root], -1)


def chain(at: np.ndarray, successor: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which candidates of a split the chains from the entries reach: each round doubles the jump and follows it from all reached so far."""
    step, _ = leaps(at, successor, 0)
    reached = np.isin(at, entries)
    for _ in range(len(at).bit_length()):
        reached[step[reached]] = True
        step = step[step]
    return reached


class Split:
    """The pieces of one split, in order. Offsets count from the first of its pieces.

    Every candidate's length is read from its header and its last four bytes are looked at, which is all that the chain needs. The block of one candidate
    at a time is read and hashed: a mark inside the record that is being read opens no other. So the work grows with the bytes, however many marks a payload holds. A record
    that turns out to be on the chain without having been read is put together afterwards, like one that goes on behind its split.
    In the first split of a file the chain is known from its start, so marks inside its records are no candidates at all.
    """

    def __init__(self, file: str, start: int, keep: bool):
        self.file, self.start, self.keep, self.size, self.pieces = file, start, keep, 0, 0
        self.now: Candidate | None = None
        self.headers: list[Candidate] = []  # whose header goes on; a mark follows an empty line, which ends a header, so there are two at most
        self.ends: list[tuple[int, int]] = []  # where a candidate ends and begins, the nearest end first
        self.at: list[int] = []
        self.successor: dict[int, int] = {}
        self.before = BREAK

    def add(self, piece: bytes) -> Iterator[tuple]:
        """The bytes between two marks; those before the first mark of a file are no candidate."""
        self.pieces += 1
        marked = self.start > 0 or self.pieces > 1
        whole = MARK + piece if marked else piece
        fed = self.headers if self.now is None or self.now in self.headers else [*self.headers, self.now]
        for c in fed:
            c.feed(whole)
        if marked and piece[:3] in VERSIONS and (self.before == BREAK or self.pieces == 1):
            now = self.now
            inside = now is not None and (not now.closed if now.need is None else self.size < now.at + now.need)  # it may end in this piece
            if not (inside and self.start == 0):
                c = Candidate(self.size, self.keep, not inside)
                c.feed(piece)
                self.at.append(c.at)
                self.headers.append(c)
                self.now = self.now if inside else c
        for c in self.headers:
            if c.need is not None:
                heapq.heappush(self.ends, (c.at + c.need, c.at))
        self.headers = [c for c in self.headers if c.need is None and not c.closed]
        last = self.before + whole
        while self.ends and self.ends[0][0] <= self.size + len(whole):
            end, at = heapq.heappop(self.ends)
            if last[end - self.size : end - self.size + 4] == BREAK:
                self.successor[at] = end
                yield self._record(at, end, self.now if self.now is not None and self.now.at == at else None)
        self.size += len(whole)
        self.before = last[-4:]
        if self.now is not None and self.now.closed:
            self.now = None

    def _record(self, at: int, end: int, read: Candidate | None) -> tuple:
        return (RECORD, self.file, self.start, at, end, None, read is None, *((None,) * 7 if read is None else read.row()))

    def end(self) -> Iterator[tuple]:
        for c in self.headers:  # the header goes on behind the split
            yield (HEADLESS, self.file, self.start, c.at, None, None, None, *(None,) * 7)
        for end, at in sorted(self.ends):  # the record does
            self.successor[at] = end
            yield self._record(at, end, None)
        at = np.array(self.at, np.int64)
        successor = np.array([self.successor.get(a, -1) for a in self.at], np.int64)
        _, out = leaps(at, successor, self.size)
        yield (SPLIT, self.file, self.start, self.size, None, None, None, *(None,) * 7)
        for a, s, o in zip(at.tolist(), successor.tolist(), out.tolist(), strict=True):
            yield (CANDIDATE, self.file, self.start, a, s, o, None, *(None,) * 7)


READ = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
READ_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SCANNED = {"what": pa.int8(), "file": pa.string(), "start": pa.int64(), "at": pa.int64(), "successor": pa.int64(), "out": pa.int64(), "unfinished": pa.bool_()} | READ
SCANNED_SQL = f"what byte, file string, start long, at long, successor long, out long, unfinished boolean, {READ_SQL}"


def _in_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds.values(), strict=True)], list(kinds))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()


def _cut(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of the split), value (bytes between two marks), in the order of the file within a split."""
    small_batches(spark)
    return spark.read.option("lineSep", MARK.decode()).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))


def scan(cut: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each whole or unfinished record, each candidate and each split (at: its size); which records count, the chain decides."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (file, start), pieces in itertools.groupby(_pieces(batches), lambda p: p[:2]):
            split = Split(file, start, payload)
            for _, _, piece in pieces:
                yield from split.add(piece)
            yield from split.end()

    return cut.mapInArrow(lambda batches: _in_batches(rows(batches), SCANNED), SCANNED_SQL)


def scan_all(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """scan(), written. A file in which a mark inside a header parts that header from its split is scanned again, as one split (rare: only a
    header that holds a mark can be parted)."""
    scanned = written(scan(_cut(spark, path), payload), "warc-scan")
    parted = scanned.where(F.col("what") == HEADLESS).select("file").distinct()
    files = [r["file"] for r in parted.collect()]
    if not files:
        return scanned
    whole = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": str(1 << 59)}
    before = {k: spark.conf.get(k, None) for k in whole}
    try:
        for k, v in whole.items():
            spark.conf.set(k, v)
        again = written(scan(_cut(spark, files), payload), "warc-scan")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return scanned.join(parted, "file", "left_anti").unionByName(again.where(F.col("what") != HEADLESS))


def entries(scanned: DataFrame, splits: DataFrame) -> DataFrame:
    """file, start, at: where the chain of each file enters its splits. An error where a chain breaks before the end of its file."""
    to_file = splits.select("file", "start", "base")
    found = scanned.where(F.col("what") == CANDIDATE).join(to_file, ["file", "start"])
    found = found.select("file", "start", (F.col("base") + F.col("at")).alias("from"), F.when(F.col("out") >= 0, F.col("base") + F.col("out")).alias("to"))
    first = splits.select("file", F.lit(0).cast("long").alias("from")).distinct()
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    # Only candidates at which another split's chain comes out, or that begin a file, can be entries.
    asked = found.where("to is not null").select("file", F.col("to").alias("from")).distinct().union(first).distinct()
    jump = written(found.join(asked, ["file", "from"], "left_semi"), "warc-jumps")
    steps, reached, temporary = jump.select("file", "from", "to"), first, [jump]
    for _ in range(max(0, most - 1).bit_length()):
        onward = steps.where("to is not null").select("file", "from", F.col("to").alias("at"))
        reached = written(reached.union(reached.join(onward, ["file", "from"]).select("file", "at")).distinct(), "warc-reached")
        twice = steps.select("file", F.col("from").alias("at"), F.col("to").alias("further"))
        steps = written(onward.join(twice, ["file", "at"], "left").select("file", "from", F.coalesce("further", "at").alias("to")), "warc-steps")
        temporary += [reached, steps]
    on_chain = jump.join(reached, ["file", "from"], "left_semi")
    sizes = splits.groupBy("file").agg(F.max(F.col("base") + F.col("size")).alias("size")).where("size > 0")
    broken = sizes.join(on_chain, (sizes["file"] == on_chain["file"]) & (on_chain["to"] == sizes["size"]), "left_anti").take(1)
    if broken:
        raise ValueError(f"not a WARC file, or the chain of records breaks before its end: {broken[0]['file']}")
    out = written(on_chain.join(to_file, ["file", "start"]).select("file", "start", (F.col("from") - F.col("base")).alias("at")), "warc-entries")
    dropped(*temporary)
    return out


def on_chain(scanned: DataFrame, entered: DataFrame) -> DataFrame:
    """file, start, at of the candidates that the chain reaches."""

    def run(candidates: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        candidates = candidates.sort_values("at")
        return candidates[chain(candidates["at"].to_numpy(), candidates["successor"].to_numpy(), entry["at"].to_numpy())][["file", "start", "at"]]

    candidates = scanned.where(F.col("what") == CANDIDATE).select("file", "start", "at", "successor")
    return candidates.groupBy("file", "start").cogroup(entered.groupBy("file", "start")).applyInPandas(run, "file string, start long, at long")


def finished(cut: DataFrame, unfinished: DataFrame, splits: DataFrame, payload: bool) -> DataFrame:
    """Records (file, start, at, successor) that go on behind their split, from their pieces in all splits; one record's pieces meet in one row."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (file, start), group in itertools.groupby(_pieces(batches), lambda p: p[:2]):
            at = 0
            for k, (_, _, piece) in enumerate(group):
                whole = MARK + piece if start > 0 or k > 0 else piece
                yield file, start, at, whole
                at += len(whole)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for parts in b.column(0):
                c = Candidate(0, payload)
                for k, part in enumerate(parts.as_py()):
                    c.feed(part["data"] if k else part["data"][len(MARK) :])
                if not c.valid:
                    raise ValueError("the chain of records breaks: a record does not end with its declared length")
                yield c.row()

    kinds = {"file": pa.string(), "start": pa.int64(), "at": pa.int64(), "data": pa.binary()}
    all_pieces = cut.mapInArrow(lambda batches: _in_batches(pieces(batches), kinds), "file string, start long, at long, data binary")
    spans = unfinished.join(splits.select("file", "start", "base"), ["file", "start"])
    spans = spans.select("file", (F.col("base") + F.col("at")).alias("lo"), (F.col("base") + F.col("successor")).alias("hi"))
    touched = spans.join(splits, "file").where("base < hi and base + size > lo").select("file", "start", "base", "lo", "hi")
    inside = all_pieces.join(touched, ["file", "start"]).withColumn("at", F.col("base") + F.col("at")).where("at >= lo and at < hi")
    groups = inside.groupBy("file", "lo").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts")).select("parts")
    return groups.mapInArrow(lambda batches: _in_batches(whole(batches), READ), READ_SQL)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row for each response or revisit record of the archives (plain or gzip) in a folder."""
    scanned = scan_all(spark, path, payload)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = scanned.where(F.col("what") == SPLIT).select("file", "start", F.col("at").alias("size"))
    splits = written(splits.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "warc-splits")
    reached = on_chain(scanned, entries(scanned, splits))
    records = scanned.where(F.col("what") == RECORD).join(reached, ["file", "start", "at"], "left_semi")
    out = records.where("not unfinished").select(*READ)
    unfinished = records.where("unfinished").select("file", "start", "at", "successor")
    if scanned.where(F.col("what") == RECORD).where("unfinished").take(1):
        out = out.unionByName(finished(_cut(spark, path), unfinished, splits, payload))
    out = out.where(F.col("record_type").isin("response", "revisit"))
    return out if payload else out.drop("payload")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/siftwell-warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, best FROM p JOIN g USING (h))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM x
"""
