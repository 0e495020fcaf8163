"""Toxicity by a linear-chain conditional random field.

A token is toxic or not. Its potential is the sum of the weights of its features (the word, its beginnings of three
to five letters, a bias); a 2 x 2 matrix scores neighbouring tags. Forward-backward gives each token's marginal;
the marginals aggregate to a document score (a logistic calibration of the largest and of the sum of the notable ones), and the
tokens above ``SPAN_AT`` are the offending spans.

The table labels whole documents, so token labels are derived in training: in a toxic document, a token is labelled
toxic if one of its features separates the labelled documents (log odds of ``LABEL_ODDS`` at least, counted by the
different words it follows, and hardly ever in a clean one). Training reads at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled rows (by hash of the id), whole; of
each kind a row that no longer fits into ``TRAIN_CHARS`` characters is passed over, and the next ones are tried. Scoring reads whole texts.

Defined cases: null and empty texts get the calibrated score of a document without tokens; without labels of both
kinds every score is 0; several label rows for one document count as toxic if one is; rows of one id and text are learnt from once, rows of one id with several
texts count each; repeated rows are scored alike, each on its own; columns other than those named are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import shuffle_partitions, small_batches, table
from siftwell.llm.language_id import held_out

TOKEN = re.compile(r"[^\W_]+")
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1500, 3000, 16_000_000
#: Documents whose marginals training holds at once.
TRAIN_BLOCK = 256
LABEL_ODDS = 3.5
SPAN_AT = 0.5
#: Marginals below this are background.
NOTABLE = 0.1
#: After a fit, words of clean documents with marginals of HARD_AT or more are added to the training windows; so many times.
HARD_AT, HARD_ROUNDS = 0.02, 2
BACKGROUND = "\0"
CACHE = 400_000


def features(word: str) -> list[str]:
    """The word and its beginnings. The leading digit tells the kinds apart."""
    return ["0" + word, *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) >= k)]


@dataclass
class ChainField:
    """Weights of the toxic tag against the other, transition scores [from][to], calibration (bias, largest marginal, sum)."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def potential(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            got = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = got
        return got

    def marginals(self, potentials: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag for every token; potentials lists the tokens of one chain after another."""
        return chain_marginals(potentials, sizes, self.transitions)[0]


def chain_marginals(potentials: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, in odds form. Also the expected transition counts.

    Chains are sorted by length so that each step works on those still running.
    """
    n, total = len(sizes), len(potentials)
    expected = np.zeros((2, 2))
    if not total:
        return np.zeros(0), expected
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    longest = int(left[0])
    alive = np.searchsorted(-left, -np.arange(longest), side="left")
    e = np.exp(np.clip(potentials, -30, 30))
    t = np.exp(transitions)
    a = np.empty(total)  # forward odds of toxic against not, the token's own potential included
    for k in range(longest):
        at = begin[: alive[k]] + k
        if k == 0:
            a[at] = e[at]
        else:
            prev = a[at - 1]
            a[at] = e[at] * (t[0, 1] + prev * t[1, 1]) / (t[0, 0] + prev * t[1, 0])
    b = np.ones(total)  # backward odds
    for k in range(longest - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        nxt = e[at + 1] * b[at + 1]
        b[at] = (t[1, 0] + t[1, 1] * nxt) / (t[0, 0] + t[0, 1] * nxt)
    odds = a * b
    if n < total:
        inner = np.ones(total, bool)
        inner[(np.cumsum(sizes) - 1)[sizes > 0]] = False
        i = np.flatnonzero(inner)
        nxt = e[i + 1] * b[i + 1]
        joint = np.stack([np.full(len(i), t[0, 0]), t[0, 1] * nxt, a[i] * t[1, 0], a[i] * t[1, 1] * nxt])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return odds / (1 + odds), expected


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def train(texts: list[str], toxic: list[int], rounds: int = 80, window: int = 24, seed: int = 7) -> ChainField | None:
    """Derives token labels from document labels and fits the weights by full-batch AdaGrad."""
    one: dict[str, str] = {}  # each different word is held once
    docs, y = [[one.setdefault(w, w) for w in tokens(t)] for t in texts], np.array(toxic)
    if len(set(y.tolist())) < 2:
        return None
    bad, good = Counter(), Counter()
    places: dict[str, set[str]] = {}
    for d, v in zip(docs, y, strict=True):
        if v:
            for before, w in zip(["", *d], d, strict=False):
                for f in features(w):
                    places.setdefault(f, set()).add(before)
        else:
            good.update({f for w in set(d) for f in features(w)})
    # copies of one toxic document repeat its other words too, but always behind the same word
    bad.update({f: len(x) for f, x in places.items()})
    n_bad, n_good = y.sum(), len(y) - y.sum()
    strong = {f for f, n in bad.items() if np.log((n + 0.5) / (n_bad + 1)) - np.log((good[f] + 0.5) / (n_good + 1)) >= LABEL_ODDS and good[f] <= 0.001 * n_good}
    rng = np.random.default_rng(seed)
    hits = [[i for i, w in enumerate(d) if v and any(f in strong for f in features(w))] for d, v in zip(docs, y, strict=True)]
    windows = []
    for k, d in enumerate(docs):
        windows += [(k, max(0, hits[k][0] - window // 2))] if hits[k] else []
        windows += [(k, int(rng.integers(0, max(1, len(d) - window))))] if d else []
    model = None
    for _ in range(HARD_ROUNDS + 1):
        if model:  # clean words that look toxic so far, each once
            known: set[str] = set()
            for first in range(0, len(docs), TRAIN_BLOCK):
                p, owner = document_marginals(model, docs[first : first + TRAIN_BLOCK])
                place = np.arange(len(p)) - np.searchsorted(owner, owner)
                for t in np.flatnonzero((p >= HARD_AT) & (y[owner + first] == 0)).tolist():
                    k = int(owner[t]) + first
                    word = docs[k][place[t]]
                    if word not in known:
                        known.add(word)
                        windows.append((k, max(0, int(place[t]) - window // 2)))
        model = _fitted(docs, hits, windows, window, rounds)
    x = np.concatenate([aggregates(model, docs[i : i + TRAIN_BLOCK]) for i in range(0, len(docs), TRAIN_BLOCK)])
    x, c = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(100):  # damped Newton steps of the calibration
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        move = np.linalg.solve(h, x.T @ (y - p) - 0.5 * c)
        c = c + move * min(1, 0.5 / max(np.abs(move).max(), 1e-9))
    model.calibration = c
    return model


def _fitted(docs: list[list[str]], hits: list[list[int]], windows: list[tuple[int, int]], window: int, rounds: int) -> ChainField:
    """Weights of a chain field on stretches (document, start) of window tokens, labelled toxic at the hits."""
    number: dict[str, int] = {}
    rows, labels, sizes = [], [], []
    for k, start in windows:
        part, tagged = docs[k][start : start + window], {i - start for i in hits[k]}
        rows += [[number.setdefault(f, len(number)) for f in features(w)] for w in part]
        labels += [float(i in tagged) for i in range(len(part))]
        sizes.append(len(part))
    flat = np.array([f for r in rows for f in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    gold, sizes = np.array(labels), np.array(sizes, np.int64)
    gold_trans = np.zeros((2, 2))
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(sizes) - 1] = False
    i = np.flatnonzero(inner)
    np.add.at(gold_trans, (gold[i].astype(int), gold[i + 1].astype(int)), 1)
    w, bias, trans = np.zeros(len(number)), -3.0, np.zeros((2, 2))
    sw, sb, st = np.full(len(w), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(rounds):
        p, expected = chain_marginals(bias + np.bincount(owner, w[flat], len(rows)), sizes, trans)
        err = gold - p
        gw, gb, gt = np.bincount(flat, err[owner], len(w)) - 0.02 * w, err.sum(), gold_trans - expected - 0.1 * trans
        sw, sb, st = sw + gw**2, sb + gb**2, st + gt**2
        w, bias, trans = w + 0.5 * gw / np.sqrt(sw), bias + 0.5 * gb / np.sqrt(sb), trans + 0.2 * gt / np.sqrt(st)
    return ChainField({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, float(bias), trans)


def aggregates(model: ChainField, docs: list[list[str]]) -> np.ndarray:
    """For each document: clipped logit of its largest marginal, log of one plus the sum of the marginals that are not background.

    Background marginals are left out, or the many of a very long text would add up.
    """
    p, owner = document_marginals(model, docs)
    n = len(docs)
    most = np.full(n, 1e-4)
    np.maximum.at(most, owner, p)
    most = np.minimum(most, 1 - 1e-4)
    total = np.bincount(owner, np.where(p >= NOTABLE, p, 0.0), n)
    return np.column_stack([np.log(most / (1 - most)), np.log1p(total)])


def document_marginals(model: ChainField, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(d) for d in docs], np.int64)
    cache, miss = model.cache, model.potential
    flat = np.array([cache[w] if w in cache else miss(w) for d in docs for w in d], float)
    return model.marginals(flat, sizes), np.repeat(np.arange(len(docs)), sizes)


def document_scores(model: ChainField, docs: list[list[str]]) -> np.ndarray:
    x = aggregates(model, docs)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ model.calibration, -30, 30)))


def offending_spans(model: ChainField, text: str | None, at: float = SPAN_AT) -> list[tuple[int, int]]:
    """Character offsets [begin, end) in text of the maximal runs of tokens whose marginal reaches at."""
    text = text or ""
    small = text.lower()
    found = list(TOKEN.finditer(small))
    back = range(len(text)) if len(small) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]  # a capital may give several letters
    p, _ = document_marginals(model, [[m.group() for m in found]])
    out: list[tuple[int, int]] = []
    for i, m in enumerate(found):
        if p[i] >= at:
            if out and i and p[i - 1] >= at:
                out[-1] = (out[-1][0], back[m.end() - 1] + 1)
            else:
                out.append((back[m.start()], back[m.end() - 1] + 1))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable=None) -> tuple[list[str], list[int]]:
    """At most TOXIC_ROWS + CLEAN_ROWS labelled documents, and of each kind at most TRAIN_CHARS characters (or one row), reach the driver. Whole texts."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    marks = marks.where(usable) if usable is not None else marks
    most = {1: TOXIC_ROWS, 0: CLEAN_ROWS}
    picked = None
    for value, rows in most.items():
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    got = src.join(F.broadcast(picked), "doc_id")
    # one id may have very many rows: only the first keys of each kind are taken, and of those the texts
    keys = got.groupBy("toxic", "doc_id", "same").agg(F.max(F.length("text")).alias("size")).withColumn("at", F.xxhash64(F.col("doc_id").cast("string")))
    most_rows = F.when(F.col("toxic") == 1, TOXIC_ROWS).otherwise(CLEAN_ROWS)
    for parts in (["toxic", "part"], ["toxic"]):  # the first of each part, of which there are as many as tasks, then of those the first of all
        order = F.row_number().over(Window.partitionBy(*parts).orderBy("at", "doc_id", "same"))
        keys = keys.withColumn("part", F.pmod("same", F.lit(shuffle_partitions(docs.sparkSession)))).withColumn("rn", order).where(F.col("rn") <= most_rows)
    keys = keys.collect()
    chosen = []
    for value in most:
        mine, used = sorted((r for r in keys if r["toxic"] == value), key=lambda r: r["rn"]), 0
        fitting = []
        for r in mine:
            if used + r["size"] <= TRAIN_CHARS:
                fitting.append(r)
                used += r["size"]
        chosen += fitting or sorted(mine, key=lambda r: (r["size"], r["rn"]))[:1]
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["same"], int(r["toxic"]), r["at"]) for r in chosen], f"doc_id {dict(src.dtypes)['doc_id']}, same long, toxic int, at long")
    rows = src.join(F.broadcast(wanted), ["doc_id", "same"]).groupBy("at", "doc_id", "same", "toxic").agg(F.min("text").alias("text")).select("at", "doc_id", "text", "toxic").collect()
    rows.sort()
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def score_toxicity(docs: DataFrame, model: ChainField | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked for, spans: array of (begin, end) character offsets in the text."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                score = document_scores(m, [tokens(t) for t in texts]) if m else np.zeros(len(texts))
                columns = [b.column(0), pa.array(score, pa.float64())]
                if spans:
                    found = [[{"begin": x, "end": y} for x, y in (offending_spans(m, t) if m else [])] for t in texts]
                    columns.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"][: len(columns)])

    schema = "doc_id long, score double" + ", spans array<struct<begin:int,end:int>>" * spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out("doc_id", 4, 2)
    model = train(*labelled_sample(docs, labels, usable=~out))
    return score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
