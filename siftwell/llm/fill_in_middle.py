"""Fill-in-the-middle transformation with a sparse checkpoint index.

A text is counted in units (code points, or words with the white space behind them) in one pass over its UTF-8 bytes, and
while counting the byte offset and the code-point offset of every ``STEP``-th unit are kept. A cut at unit u is found by
binary search among these checkpoints and a rescan of fewer than ``STEP`` units; neither the text nor an array of its
characters is held besides the bytes. Two cuts part a text into prefix, middle and suffix, which come out in one of two orders behind
the marks ``<P>``, ``<S>`` and ``<M>``; no mark can arise across a seam, since a mark ends in the only ``>`` it has.

Everything that is drawn comes from SHA-256 of the seed and the decimal id, so neither partitions nor retries change it.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark, stays plain; a null id counts as an empty
decimal; repeated rows are transformed alike, each on its own; ties cannot arise (equal cuts give an empty middle); very long texts are cut
like others, one text at a time in memory; columns other than the id and the text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, table

#: Units between two checkpoints, and bytes that are counted at once.
STEP, BLOCK = 1024, 1 << 16
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Hundredths of texts that stay plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: A word with the white space behind it; white space before the first word is a unit too.
WORD = re.compile(rb"[^\x09-\x0D\x20]+[\x09-\x0D\x20]*|[\x09-\x0D\x20]+")
#: Bytes of output that a task hands on at once.
OUT_BYTES = 8 << 20


class Checkpoints:
    """Counts the units of UTF-8 bytes and finds the byte and code-point offset of any of them."""

    def __init__(self, data: bytes, unit: str = "char", step: int = STEP) -> None:
        if unit not in ("char", "word"):
            raise ValueError(f"unknown unit: {unit}")
        self.data, self.unit, self.step = data, unit, step
        self.units: list[int] = []  # of each checkpoint, ascending
        self.bytes: list[int] = []
        self.points: list[int] = []
        self.n = 0
        if unit == "char":
            self._count_points()
        else:
            self._count_words()

    @staticmethod
    def starts(data: bytes, lo: int, hi: int) -> np.ndarray:
        """Offsets, from lo, at which a code point begins."""
        return np.flatnonzero((np.frombuffer(data, np.uint8, hi - lo, lo) & 0xC0) != 0x80)

    def _count_points(self) -> None:
        for lo in range(0, len(self.data), BLOCK):
            found = self.starts(self.data, lo, min(lo + BLOCK, len(self.data)))
            first = -self.n % self.step
            at = found[first :: self.step] + lo
            numbers = range(self.n + first, self.n + first + self.step * len(at), self.step)
            self.units += numbers
            self.points += numbers
            self.bytes += at.tolist()
            self.n += len(found)

    def _count_words(self) -> None:
        points = last = 0
        for m in WORD.finditer(self.data):
            if self.n % self.step == 0:
                points += self._points(last, m.start())
                last = m.start()
                self.units.append(self.n)
                self.bytes.append(last)
                self.points.append(points)
            self.n += 1

    def _points(self, lo: int, hi: int) -> int:
        return sum(len(self.starts(self.data, a, min(a + BLOCK, hi))) for a in range(lo, hi, BLOCK))

    def find(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the unit behind the last one begins at the end."""
        if not self.n:
            return 0, 0
        i = bisect_right(self.units, unit) - 1
        at, points, left = self.bytes[i], self.points[i], unit - self.units[i]
        if self.unit == "char":
            near = self.starts(self.data, at, min(at + 4 * (left + 1), len(self.data)))
            return (at + int(near[left]) if left < len(near) else len(self.data)), points + left
        end = at
        for _, m in zip(range(left), WORD.finditer(self.data, at), strict=False):
            end = m.end()
        return end, points + self._points(at, end)


def drawn(id_col: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group, from 1, of the SHA-256 of seed:id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(data: bytes, h1: int, h2: int, form: str, unit: str = "char") -> tuple[int, int | None, int | None, bytes]:
    """n, code points of prefix and middle, output."""
    index = Checkpoints(data, unit)
    if form == "plain":
        return index.n, None, None, data
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (lo, lo_points), (hi, hi_points) = index.find(a), index.find(b)
    prefix, middle, suffix = data[:lo], data[lo:hi], data[hi:]
    parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    return index.n, lo_points, hi_points - lo_points, b"".join(parts)


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that an output of that form was made of."""
    if form == "plain":
        return output
    middle_at = output.index(MIDDLE)
    head, middle = output[:middle_at], output[middle_at + 3 :]
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    parted = head.index(second)
    one, two = head[len(first) : parted], head[parted + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


def in_slices(batches: Iterator[pa.RecordBatch], work, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Calls work with the values of each row, and hands its rows on whenever they hold OUT_BYTES (the last column counts)."""
    rows, size = [], 0
    for b in batches:
        for i in range(b.num_rows):
            rows.append(work(*(c[i].as_py() for c in b.columns)))
            size += len(rows[-1][-1])
            if size >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)
            rows, size = [], 0


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = text.contains("<P>") | text.contains("<S>") | text.contains("<M>")
    key = F.col(id_col)
    form = F.when((text == "") | marked | (drawn(key, seed, 3) % 100 >= plain_from(plain)), "plain").when(drawn(key, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    src = docs.select(key.alias("id_"), drawn(key, seed, 1).alias("h1"), drawn(key, seed, 2).alias("h2"), form.alias("form"), text.cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(i, h1, h2, how, data) -> tuple:
            n, before, inside, output = transform(data, h1, h2, how, unit)
            return i, n, how, before, inside, output

        schema = None
        for b in batches:
            schema = schema or pa.schema([("id_", b.schema.field(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
            yield from in_slices(iter([b]), one, schema)

    found = src.mapInArrow(run, f"id_ {dict(src.dtypes)['id_']}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(F.col("id_").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def plain_from(plain: int) -> int:
    return 100 - plain


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of, by its form."""

    @F.pandas_udf("binary")
    def undo(outputs, forms):
        return outputs.combine(forms, rebuilt)

    return F.when(form == "plain", output).otherwise(undo(output.cast("binary"), form).cast("string"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(s, 1, 8))::UBIGINT AS h1, ('0x' || substr(s, 9, 8))::UBIGINT AS h2, ('0x' || substr(s, 17, 8))::UBIGINT AS h3, ('0x' || substr(s, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p
"""
