"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: for each context of up to ``ORDER`` bytes, the counts of the
bytes that follow it. A byte costs -log2 of its share in the longest known context (counts over total plus distinct);
if it was never seen there, the escape (distinct over total plus distinct) is paid and the next shorter context is
asked, down to a uniform code over 256 bytes. The statistics are frozen after training, so the code length of a text
is exact and the trees are a finite automaton over their common contexts: one table gives the next state, another
the code lengths under every language. Texts are cut into columns that advance together; each column starts with the
ORDER bytes before it, so the cut changes nothing.

Training reads at most ``ROWS_PER_LANGUAGE`` rows of each language, whole: first those of at most ``ROW_CHARS`` characters (by hash of the id), then
longer ones, the shortest first, while the rows of the language have at most ``LANGUAGE_CHARS`` characters together. The first row of a language
is always read, so no language is lost for the length of its texts. No context of these rows is left out. Prediction reads whole texts.

Defined cases: ``und`` with score 0 for a null text or one without letters, and for every text if there was nothing
to learn from; ties go to the language that sorts first; repeated rows are predicted alike, each on its own; very long texts are read whole; columns
other than those named are ignored (``identified_rows`` keeps them as they are), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, table

ORDER = 4
ROWS_PER_LANGUAGE, ROW_CHARS, LANGUAGE_CHARS = 64, 4000, 256_000
COLUMN = 512
BATCH_BYTES = 3_000_000
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"[\W\d_]+")
UND = "und"


@dataclass
class Automaton:
    """Frozen trees of all languages. step and cost have one row for each state and byte class; class 0 pads and costs nothing."""

    languages: list[str]
    classes: np.ndarray
    width: int
    step: np.ndarray
    cost: np.ndarray


def _count(sample: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length: context codes, following bytes, counts."""
    out = []
    for k in range(order + 1):
        codes = [np.zeros(0, np.int64)]
        for s in sample:
            b = np.frombuffer(s, np.uint8).astype(np.int64)
            if len(b) > k:
                c = np.zeros(len(b) - k, np.int64)
                for j in range(k + 1):
                    c = c << 8 | b[j : j + len(c)]
                codes.append(c)
        got, n = np.unique(np.concatenate(codes), return_counts=True)
        out.append((got >> 8, got & 255, n))
    return out


def train(samples: dict[str, list[bytes]], order: int = ORDER, max_contexts: int | None = None) -> Automaton | None:
    """samples: the training bytes of each language; max_contexts: keep the most frequent ones only."""
    languages = sorted(k for k, v in samples.items() if any(v))
    if not languages:
        return None
    counted = [_count(samples[x], order) for x in languages]
    seen = np.unique(np.concatenate([c[0][1] for c in counted]))
    classes = np.ones(256, np.int64)  # 1: bytes that no tree knows; they all cost the same
    classes[seen] = np.arange(len(seen)) + 2
    width = len(seen) + 2

    per_level = []
    for k in range(order + 1):
        codes = np.concatenate([c[k][0] for c in counted])
        weight = np.concatenate([c[k][2] for c in counted])
        ctx, at = np.unique(codes, return_inverse=True)
        per_level.append((ctx, np.bincount(at, weight)))
    totals = np.concatenate([w for _, w in per_level])
    level = np.repeat(np.arange(order + 1), [len(c) for c, _ in per_level])
    # a context occurs at most as often as any part of it, so the most frequent ones hold all their parts
    chosen = np.zeros(len(totals), bool)
    chosen[np.lexsort((level, -totals))[:max_contexts]] = True
    kept, base, at = [], [0], 0
    for k, (ctx, _) in enumerate(per_level):
        kept.append(ctx[chosen[at : at + len(ctx)]])
        at += len(ctx)
        base.append(base[-1] + len(kept[k]))

    def find(k: int, codes: np.ndarray) -> np.ndarray:
        """State numbers of contexts of length k, -1 for unknown ones."""
        if not len(kept[k]):
            return np.full(len(codes), -1)
        i = np.minimum(np.searchsorted(kept[k], codes), len(kept[k]) - 1)
        return np.where(kept[k][i] == codes, base[k] + i, -1)

    states, known = base[-1], np.concatenate([[0, 0], seen])
    step = np.zeros((states, width), np.int32)
    cost = np.zeros((states, width, len(languages)), np.float32)
    for k in range(order + 1):
        ctx, rows = kept[k], slice(base[k], base[k + 1])
        shorter = find(k - 1, ctx & ((1 << 8 * (k - 1)) - 1)) if k else None
        for x, c in enumerate(counted):
            codes, sym, n = c[k]
            count = np.zeros((len(ctx), width))
            state = find(k, codes) - base[k]
            ok = state >= 0
            count[state[ok], classes[sym[ok]]] = n[ok]
            total, distinct = count.sum(1), (count > 0).sum(1)
            under = cost[shorter, :, x] if k else np.full((len(ctx), width), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = -np.log2(distinct / (total + distinct))
                own = np.where(count > 0, -np.log2(count / (total + distinct)[:, None]), escape[:, None] + under)
            cost[rows, :, x] = np.where((total > 0)[:, None], own, under)
        # the longest known context that ends the old one and the new byte
        pair = (ctx[:, None] << 8 | known[None, :]) if len(ctx) else np.zeros((0, width), np.int64)
        best = np.zeros(pair.shape, np.int64)
        for j in range(1, min(k + 1, order) + 1):
            got = find(j, (pair & ((1 << 8 * j) - 1)).ravel()).reshape(pair.shape)
            best = np.where(got >= 0, got, best)
        best[:, :2] = 0
        step[rows] = best
    cost[:, 0] = 0
    return Automaton(languages, classes.astype(np.uint8), width, step.ravel(), cost.reshape(states * width, -1))


def code_lengths(model: Automaton, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    n, languages = len(texts), len(model.languages)
    out = np.zeros((n, languages))
    sizes = np.array([len(t) for t in texts], np.int64)
    columns = -(-sizes // COLUMN)
    if not columns.sum():
        return out
    owner = np.repeat(np.arange(n), columns)
    first = np.concatenate([[0], np.cumsum(columns)[:-1]])
    inside = (np.arange(len(owner)) - first[owner]) * COLUMN
    data = np.concatenate([np.zeros(ORDER, np.uint8), model.classes[np.frombuffer(b"".join(texts), np.uint8)], np.zeros(COLUMN, np.uint8)])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner] + inside + ORDER
    left = np.minimum(sizes[owner] - inside, COLUMN)
    order = np.argsort(-left, kind="stable")  # longest first, so that a step works on a prefix of the columns
    owner, begin, left, inside = owner[order], begin[order], left[order], inside[order]
    state, bits = np.zeros(len(owner), np.int64), np.zeros((len(owner), languages), np.float32)
    for t in range(-ORDER, 0):
        sym = np.where(inside + t >= 0, data[begin + t], 0)
        state = model.step[state * model.width + sym].astype(np.int64)
    alive = np.searchsorted(-left, -np.arange(int(left[0])), side="left")
    for t in range(int(left[0])):
        m = alive[t]
        at = state[:m] * model.width + data[begin[:m] + t]
        bits[:m] += model.cost[at]
        state[:m] = model.step[at]
    for x in range(languages):
        out[:, x] = np.bincount(owner, bits[:, x], n)
    return out


def posteriors(bits: np.ndarray) -> np.ndarray:
    """Shares of 2 to the power of minus the code length."""
    p = np.exp2(bits.min(1, keepdims=True) - bits)
    return p / p.sum(1, keepdims=True)


def prepared(text: str | None) -> bytes:
    """Lower case; whatever lies between letters (digits, signs, white space) becomes one space, as no language is told by it."""
    return GAP.sub(" ", (text or "").lower()).encode("utf-8", "replace")


def sample_rows(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, rows: int = ROWS_PER_LANGUAGE, chars: int = ROW_CHARS, total: int = LANGUAGE_CHARS) -> dict[str, list[bytes]]:
    """The training sample, whole rows: at most rows of each language and, but for its first row, at most total characters of each reach the driver."""
    src = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("size")
    )
    first = Window.partitionBy("lang").orderBy(F.when(F.col("size") > chars, F.col("size")).otherwise(0), "at", "id", "text")  # Spark keeps the first rows of each task before it shuffles
    some = src.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= rows)
    sums = F.sum("size").over(Window.partitionBy("lang").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))  # of rows at most
    got = some.withColumn("sum", sums).where((F.col("sum") <= total) | (F.col("rn") == 1)).select("lang", "text").collect()
    out: dict[str, list[bytes]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append(prepared(r["text"]))
    return out


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def identify_languages(docs: DataFrame, model: Automaton | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language), bits_per_byte (its code length)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def flush(ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
        m = shipped.value
        letters = [bool(t) and LETTER.search(t) is not None for t in texts]
        lang, score, rate = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if m is not None and any(letters):
            data = [prepared(t) if ok else b"" for t, ok in zip(texts, letters, strict=True)]
            bits = code_lengths(m, data)
            p, best = posteriors(bits), bits.argmin(1)
            for i, ok in enumerate(letters):
                if ok:
                    lang[i], score[i], rate[i] = m.languages[best[i]], p[i, best[i]], bits[i, best[i]] / max(1, len(data[i]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum([len(x) if x else 0 for x in b.column(1).to_pylist()]) // BATCH_BYTES if b.num_rows else []
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    yield flush([b.column(0).slice(lo, hi - lo)], b.column(1).slice(lo, hi - lo).to_pylist())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def identified_rows(docs: DataFrame, model: Automaton | None, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and a language of posterior min_score at least. Without a model, letters alone decide."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b, m = whole.slice(lo, 500), shipped.value
                texts = b.column(at).to_pylist()
                good = np.array([bool(t) and LETTER.search(t) is not None for t in texts])
                if m is not None:
                    good &= posteriors(code_lengths(m, [prepared(t) for t in texts])).max(1) >= min_score
                yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = train(sample_rows(docs, ~out, "doc_id", "text", "lang"))
    found = identify_languages(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")
