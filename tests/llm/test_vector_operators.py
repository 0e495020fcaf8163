"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import embedding_dedup as E12
from siftwell.llm import fill_in_middle as M
from siftwell.llm import hard_negatives as H
from siftwell.llm.packs import from_bytes, packed

# ---- 11 -------------------------------------------------------------------------------------------------------------


def reference_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ☃𝄞é<PSM>\n", max_size=60), st.integers(1, 9))
def test_checkpoints_find_every_unit(text, step):
    data = text.encode()
    index = M.Checkpoints(data, "char", step)
    assert index.n == len(text)
    for u in range(len(text) + 1):
        assert index.find(u) == (len(text[:u].encode()), u)
    words = M.Checkpoints(data, "word", step)
    pieces = [x.decode() for x in M.WORD.findall(data)]
    assert words.n == len(pieces) and "".join(pieces) == text
    for u in range(len(pieces) + 1):
        head = "".join(pieces[:u])
        assert words.find(u) == (len(head.encode()), len(head))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<PSM>ab𝄞", max_size=30), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_transformation_is_undone(text, h1, h2, form):
    if any(x in text for x in ("<P>", "<S>", "<M>")):
        return
    assert M.rebuilt(M.transform(text.encode(), h1, h2, form)[3], form) == text.encode()


def test_fill_in_middle(spark):
    texts = [None, "", "x", "plain words\n here", "𝄞☃é" * 50_000, "has <P> in it", "<S", "tail <M", "a" * 70_001]
    rows = [(i if i != 7 else None, texts[i % len(texts)], "psm") for i in range(120)] + [(3, texts[3], "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumns({"output": F.lit(1), "h1": F.lit("x"), "id_": F.lit(None).cast("string")})
    got = M.fill_in_middle(docs)
    kept = got.select("*", M.restored(F.col("output"), F.col("form")).alias("again")).collect()
    want = sorted(((i, *reference_fim(i, t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r)[:6] for r in kept), key=str) == want
    assert {hashlib.sha256(r["again"].encode()).hexdigest() for r in kept} == {hashlib.sha256((t or "").encode()).hexdigest() for t in texts}
    assert {r["form"] for r in kept} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.where("false")).count() == 0
    words = M.fill_in_middle(docs, unit="word").where("doc_id = 3").first()
    assert words["n"] == 3
    with pytest.raises(Exception, match="unknown unit"):
        M.Checkpoints(b"", "line")


def test_fill_in_middle_query(spark, data, duck):
    got = M.op11_fill_in_middle(spark, data)
    names = sorted(got.columns)
    key = lambda r: sorted(str(tuple(t)) for t in r)
    assert key(got.select(names).collect()) == key(duck.execute(f"SELECT {', '.join(names)} FROM ({M.OP11_SQL})").fetchall())


def rows_of(rows):
    return [tuple(r) for r in rows]


# ---- 12 -------------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.98):
    """Links and least linked id of rows (id, label, vector), by cosine in double precision."""
    good = [label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, _, v), g in zip(rows, good, strict=True)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(r[0], n[i], least[top(i)]) for i, r in enumerate(rows)]


def near(rng, v, cosine):
    b = rng.standard_normal(len(v))
    v = v / np.linalg.norm(v)
    b -= (b @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b)


def vector_rows(rng, d=32, n=120):
    rows = []
    for i in range(n):
        v = rng.standard_normal(d)
        rows.append((1000 - i, i % 3, v.tolist()))
        if i % 4 == 0:
            rows += [(2000 + 10 * i + k, i % 3, (near(rng, v, c) * 3).tolist()) for k, c in enumerate((0.999, 0.99, 0.985, 0.975))]
        if i % 10 == 0:
            rows += [(5000 + i, i % 3, v.tolist()), (6000 + i, (i + 1) % 3, v.tolist())]
    return rows


def run12(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"node": F.lit("x"), "n": F.lit(1), "component_id": F.lit(2), "key_": F.lit(1), "kept": F.lit("no")})
    return df, E12.similar_vectors(df, **options)


def test_similar_vectors(spark):
    rows = vector_rows(np.random.default_rng(1))
    _, got = run12(spark, rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == sorted(brute_links(rows))


def test_similar_vectors_cells_and_packs_change_nothing(spark, monkeypatch):
    rows = vector_rows(np.random.default_rng(2), 16, 200)
    rows += [(9000 + i, 1, near(np.random.default_rng(i), np.ones(16), 0.997).tolist()) for i in range(150)]  # a dense group
    _, got = run12(spark, rows)
    whole = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(E12, "CELL", 16)
    monkeypatch.setattr(E12, "HELD", 4096)
    E12.enough.cache_clear()
    small = sorted(map(tuple, run12(spark, rows)[1].collect()))
    E12.enough.cache_clear()
    want = brute_links(rows)
    links = sum(n for _, n, _ in want)
    assert sum(r[1] for r in small) >= 0.97 * links and sum(r[1] for r in whole) >= 0.97 * links
    exact = {i: n for i, n, _ in want}
    assert all(r[1] <= exact[r[0]] for r in whole + small)


@pytest.mark.parametrize("d", [2, 3, 8, 64, 200])
def test_recall_at_the_threshold(d):
    """Pairs that lie just above the threshold, the hardest ones."""
    rng = np.random.default_rng(d)
    a = E12.unit(rng.standard_normal((400, d)))
    b = np.array([near(rng, v, 0.9801) for v in a])
    found = {(i, k) for x, y in E12.linked(a, b, 0.98) for i, k in zip(x.tolist(), y.tolist(), strict=True)}
    assert sum((i, i) in found for i in range(400)) >= 360
    assert all(a[i] @ b[k] >= 0.98 - 1e-12 for i, k in found)


def test_similar_vectors_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    same = [1.0, 2.0, 3.0]
    rows = [(1, 1, same), (1, 1, same), (2, 1, same), (None, 1, same), (3, 2, same), (4, None, same), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0, 0.0]), (8, 1, [1.0, None, 3.0]), (9, 1, [1.0, nan, 3.0]), (10, 1, [inf, 2.0, 3.0]),
            (11, 1, [1.0, 2.0]), (12, 1, [2e300, 4e300, 6e300]), (13, 1, [1e-320, 2e-320, 3e-320]), (14, 5, [4.0]), (15, 5, [9.0]), (16, 5, [-1.0]), (None, 9, [0.5, 0.5]), (17, 3, [-0.0, 1.0]), (18, 3, [0.0, 1.0])]
    df, got = run12(spark, rows)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    group = [(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (None, 5, 1, False), (12, 5, 1, False), (13, 5, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 16)] + [(None, 0, None, True)]
    assert found == sorted([*group, *alone, (14, 1, 14, True), (15, 1, 14, False), (17, 1, 17, True), (18, 1, 17, False)], key=str)
    assert E12.similar_vectors(df.where("false")).count() == 0


def test_hot_vectors(spark):
    rows = [(i, 1, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, 1, [1.0, -float(i)]) for i in range(4)]
    got = run12(spark, rows)[1].groupBy("component_id").agg(F.count("*").alias("n"), F.max("n_links").alias("links"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert (0, 3000, 2999, 1) in [tuple(r) for r in got]


def test_embedding_query(spark, data, duck):
    names = ["vec_id", "n_links", "component_id", "kept"]
    got = E12.op12_embedding_dedup(spark, data).select(names)
    assert sorted(rows_of(got.collect())) == sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({E12.OP12_SQL})").fetchall())


# ---- 13 -------------------------------------------------------------------------------------------------------------


def brute_negatives(rows, k=10, positives=5):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for a in good:
        if a[0] % 100 or (a[0], a[1], tuple(a[2])) in seen:
            continue
        seen.add((a[0], a[1], tuple(a[2])))
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in good if b[0] != a[0])
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(a[0], i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def run13(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "anchor": F.lit(1), "number": F.lit(2), "vector": F.lit(3), "pack": F.lit("p")})
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block", [8192, 7])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", block // 2)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), (rng.integers(-4, 9, 6) / 8).tolist()) for i in range(0, 900, 3)]  # coarse, so that scores tie
    rows += [(1, 0, rows[0][2])] * 3 + [rows[0]] + [(7, 1, None), (8, None, [1.0]), (None, 1, [1.0]), (9, 1, [1.0, None]), (10, 1, [float("nan")]), (11, 1, []), (500, 2, [1.0, 1.0]), (12, 1, [3.0] * 9)]
    want = brute_negatives(rows)
    assert want and run13(spark, rows) == want


def test_hard_negatives_without_rows(spark):
    assert run13(spark, [(1, 1, None)]) == []
    assert run13(spark, [(100, 1, [1.0]), (2, 2, [1.0])]) == []  # no positive
    assert run13(spark, [(100, 1, [1.0]), (2, 1, [-1.0]), (3, 2, [-0.5])]) == []  # no score above 0
    assert run13(spark, [(0, 1, [1.0]), (100, 1, [1.0]), (5, 1, [0.5]), (3, 2, [0.5])]) == brute_negatives([(0, 1, [1.0]), (100, 1, [1.0]), (5, 1, [0.5]), (3, 2, [0.5])])


def test_large_scores_are_exact(spark):
    big = 2.0**17 + 1 / 256
    rows = [(100, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big / 2, 3.0]), (3, 2, [big / 2, 2.0]), (4, 2, [big / 2 - 1, 2.0])]
    assert run13(spark, rows) == brute_negatives(rows)
    found = H.Sorted(np.array([[2**62, 5, 2**62, -(2**62), 5]]))  # too large for one number: the two-key sort
    assert found.keys is None and found.order.tolist() == [[0, 2, 1, 4, 3]] and found.first_at_most(0, 5) == 2
    with pytest.raises(Exception, match="fit a long"):
        H.scores_of(np.array([[1e30]]), np.array([[1e30]]))


def test_hard_negative_query(spark, data, duck):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = H.op13_hard_negatives(spark, data).select(names)
    assert sorted(rows_of(got.collect())) == sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({H.OP13_SQL})").fetchall())


def test_packs(spark):
    df = spark.range(0, 1000, 1, 3).selectExpr("id DIV 7 AS k", "id", "repeat('x', cast(id as int)) AS t").repartitionByRange(2, "k").sortWithinPartitions("k")
    got = packed(df, 5, ["k"]).collect()
    assert sum(r["rows"] for r in got) == 1000 and max(r["rows"] for r in got) <= 5 and len({r["pack"] for r in got}) == len(got)
    assert sorted(x for r in got for x in from_bytes(r["data"]).column("id").to_pylist()) == list(range(1000))
    assert all(x // 7 == r["k"] for r in got for x in from_bytes(r["data"]).column("id").to_pylist())
