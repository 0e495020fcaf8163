"""Suffix-array dedup with run-length indexes.

A byte goes if a string of ``WINDOW`` bytes that covers it starts at a second place of the corpus. ``repeats`` finds
these strings: segments around common anchors are sharded, the Burrows-Wheeler transform of each shard is kept as
runs with sampled run ends, and backward search streams the segments against it. Anchors are grams of 256 bytes; a
segment that is the only one of its anchor skips the index, as its windows occur as often as the segment does.

Defined cases: a null text has no bytes; texts shorter than a window keep all; repeated rows of one document are
occurrences of their own, so both lose what they share; kept bytes need not be valid UTF-8, so the general operator
returns them as binary; ties cannot arise, since every occurrence goes; very long texts are read whole; columns other than the id and the text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import table
from siftwell.llm.repeats import Spec, covered, identified, repeats
from siftwell.llm.text_index import RunIndex

WINDOW = 400
SPEC = Spec(words=False, window=WINDOW, gram=256, index=RunIndex, most_segments=3_000, lone=False)


def _documents(docs: DataFrame, id_col: str, text_col: str, spec: Spec, whole: bool) -> DataFrame:
    both = repeats(identified(docs, id_col, text_col), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, total, gone, spans, out = [], [], [], [], []
            for i in range(b.num_rows):
                doc, rh, text = (b.column(c)[i].as_py() for c in range(3))
                data = text.encode()
                bad = covered(b.column(3)[i], rh, len(data), spec.window)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], bad, [False]]).astype(np.int8)))
                cuts = [0, *edge.tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(cuts[0::2], cuts[1::2], strict=True)) if len(edge) else data
                ids.append(doc)
                total.append(len(data))
                gone.append(int(bad.sum()))
                spans.append(len(edge) // 2)
                out.append(kept if whole else hashlib.sha256(kept).hexdigest())
            columns = [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.binary() if whole else pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    last = "kept" if whole else "kept_sha256"
    return both.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'binary' if whole else 'string'}")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    return _documents(docs, id_col, text_col, spec, whole=True)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(table(spark, sf_dir, "documents"), "doc_id", "text", SPEC, whole=False)
