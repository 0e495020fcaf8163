"""Substring dedup with compressed FM-indexes.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A word goes if a
window of ``WINDOW`` words that covers it has its word sequence at a second place of the corpus. ``repeats`` finds
these windows: segments around common anchors are sharded, each shard gets an FM-index in a wavelet matrix, and
backward search streams the segments against it.

Defined cases: a null text has no words; texts of fewer words than a window keep all; repeated rows of one document
are occurrences of their own, so both lose what they share; the digest of no words is that of the empty string;
ties cannot arise, since every occurrence goes; very long texts are read whole; columns other than the id and the text are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import table
from siftwell.llm.repeats import Spec, covered, identified, repeats
from siftwell.llm.text_index import FMIndex

WINDOW = 35
SPEC = Spec(words=True, window=WINDOW, gram=8, index=FMIndex, most_segments=20_000)


def _documents(docs: DataFrame, id_col: str, text_col: str, spec: Spec, whole: bool) -> DataFrame:
    both = repeats(identified(docs, id_col, text_col), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, total, gone, out = [], [], [], []
            for i in range(b.num_rows):
                doc, rh, text = (b.column(c)[i].as_py() for c in range(3))
                words = text.encode().split()
                bad = covered(b.column(3)[i], rh, len(words), spec.window)
                kept = b" ".join([words[j] for j in np.flatnonzero(~bad).tolist()] if bad.any() else words)
                ids.append(doc)
                total.append(len(words))
                gone.append(int(bad.sum()))
                out.append(kept.decode() if whole else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", last])

    last = "kept_text" if whole else "kept_sha256"
    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Spec = SPEC) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words, joined by one space)."""
    return _documents(docs, id_col, text_col, spec, whole=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(table(spark, sf_dir, "documents"), "doc_id", "text", SPEC, whole=False)


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
bad AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 35)) AS p FROM win SEMI JOIN twice USING (h))),
each AS (SELECT r, w[p] AS word, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN bad USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS n FROM bad GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
