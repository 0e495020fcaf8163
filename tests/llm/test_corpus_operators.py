"""Exact dedup, decontamination, the substring dedups, the n-gram join and the pipeline against brute force."""

import dataclasses
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, components, decontamination, exact_dedup, ngram_join, registry, repeats, substring_dedup, suffix_dedup
from siftwell.llm.text_index import FMIndex, Parents, RunIndex, Suffixes, joined, matching_statistics
from tests.conftest import same_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


ODD = [None, "", " ", "A", "a", "É", "é", "same text", "SAME TEXT", "same text", "x" * 200_000]


# ---- queries with SQL ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, data, duck, name):
    assert same_rows(registry.QUERIES[name](spark, data), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_split_members(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.createDataFrame([(k % 50, k) for k in range(200)], "key long, bit_ long").withColumnRenamed("bit_", "n")
    inside, outside = common.split_members(rows, "key", spark.createDataFrame([(k,) for k in range(0, 60, 7)], "key long"))
    assert sorted(r["n"] for r in inside.collect()) == [k for k in range(200) if k % 50 % 7 == 0]
    assert sorted(r["n"] for r in outside.collect()) == [k for k in range(200) if k % 50 % 7]


# ---- exact dedup ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [1, 120])
def test_exact_dedup(spark, copies):
    texts = ODD + ["hot text"] * copies + ["Hot Text"] * copies
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), partitions=5).collect()}
    last, size = {}, Counter(map(lower, texts))
    for i, t in enumerate(texts):
        last[lower(t)] = i
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["norm"]) == (last[lower(t)], size[lower(t)], last[lower(t)] == i, lower(t))


def test_exact_dedup_smallest_and_rows(spark):
    df = docs(spark, ["a", "A", "b"] + ["h"] * 50).withColumn("norm", F.lit("clash")).withColumn("kept", F.lit(1))
    found = exact_dedup.exact_dedup(df, keep="min", carry=True).where("kept").select("row.*")
    assert found.columns == df.columns and sorted(r["doc_id"] for r in found.collect()) == [0, 2, 3]


@pytest.mark.parametrize("carry", [False, True])
def test_hot_texts_that_share_ids(spark, carry):
    hot = docs(spark, ["first"] * 100 + ["second"] * 100 + ["rare"], [*range(1, 101)] * 2 + [7])
    got = exact_dedup.exact_dedup(hot, partitions=2, carry=carry).collect()
    assert len(got) == 201 and sorted((r["norm"], r["doc_id"]) for r in got if r["kept"]) == [("first", 100), ("rare", 7), ("second", 100)]
    assert {(r["norm"], r["keep_id"], r["group_size"]) for r in got} == {("first", 100, 100), ("second", 100, 100), ("rare", 7, 1)}
    if carry:
        assert all(r["row"]["text"] == r["norm"] and r["row"]["doc_id"] == r["doc_id"] for r in got)


def test_exact_dedup_odd_ids(spark):
    df = docs(spark, ["a", "a", "a", "b", "b"], [1, 1, None, None, None])
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got if r["norm"] == "a"} == {1}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# ---- decontamination ------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(texts, items, size):
    w_items = {i: WORD.findall(lower(t)) for i, t in items}
    out = []
    for t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for i, own in w_items.items():
            n = min(size, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("bits, most", [(None, None), (1 << 20, 0), (64, 0)])
def test_decontamination(spark, monkeypatch, bits, most):
    if bits:
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    rng = random.Random(0)
    vocabulary = ["a", "b", "c", "dd", "é", "x9"]
    texts = [None, "", "!!", "A-b a"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate((1, 2, 3, 5, 8, 8))] + [(20, None), (21, "?"), (22, "not-in here"), (3, "a b")]
    bench = spark.createDataFrame([*items, (None, "a")], "item_id long, text string")
    both = defaultdict(list)
    for i, t in items:
        both[i].append(t)
    for extra in (["a", "b"], []):
        clash = docs(spark, texts).withColumns({x: F.lit(1) for x in ["w", "pos", "words", *extra]})
        got = decontamination.contaminated_words(clash, bench, window=4).orderBy("doc_id").collect()
        want = [brute_hits([t], [(f"{i}", x) for i, xs in both.items() for x in xs], 4)[0] for t in texts]
        merged = []
        for t in texts:
            hit, found, w = set(), set(), WORD.findall(lower(t))
            for i, xs in both.items():
                for x in xs:
                    own = WORD.findall(lower(x))
                    n = min(4, len(own))
                    for s in range(len(own) - n + 1 if n else 0):
                        for p in range(len(w) - n + 1):
                            if w[p : p + n] == own[s : s + n]:
                                hit |= set(range(p, p + n))
                                found.add(str(i))
            merged.append((len(w), len(hit), sorted(found)))
        assert [(r["n_words"], r["n_hit"], list(r["items"])) for r in got] == merged and len(want) == len(merged)


def test_decontamination_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contaminated_words(docs(spark, []), bench).count() == 0
    got = decontamination.contaminated_words(docs(spark, ["a b", None]), bench.limit(0)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(2, 0, []), (0, 0, [])]


def test_decontamination_rows_of_one_id(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "x y")], "item_id long, text string")
    texts = ["a b c q", "q a b c x y", "x y", "x y", None, "a b c"]
    got = decontamination.contaminated_words(docs(spark, texts, [1, 1, None, None, None, 4]), bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == [
        (0, 0, 0, ()), (0, 2, 2, ("2",)), (0, 2, 2, ("2",)), (1, 4, 3, ("1",)), (1, 6, 5, ("1", "2")), (4, 3, 3, ("1",)),
    ]


# ---- indexes and substring dedups -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", [FMIndex, RunIndex])
def test_matching_statistics(kind):
    rng = np.random.default_rng(3)
    for _ in range(25):
        cap = int(rng.integers(2, 10))
        seqs = [rng.integers(1, int(rng.integers(2, 6)), rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        count = Counter(tuple(s[i : i + n].tolist()) for s in seqs for n in range(1, cap + 1) for i in range(len(s) - n + 1))
        suffixes = Suffixes(joined(seqs)[0], cap)
        got = matching_statistics(kind(suffixes), Parents(suffixes.lcp, cap), seqs, cap)
        for s, g in zip(seqs, got, strict=True):
            assert g.tolist() == [max([n for n in range(1, min(cap, len(s) - i) + 1) if count[tuple(s[i : i + n].tolist())] > 1], default=0) for i in range(len(s))]


def corpus(rng, alphabet, joiner):
    base = [joiner.join(rng.choices(alphabet, k=rng.randint(20, 90))) for _ in range(6)]
    out = [None, "", alphabet[0], joiner.join([alphabet[0]] * 150)]
    for _ in range(40):
        parts = [rng.choice(base) if rng.random() < 0.5 else joiner.join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        out.append(joiner.join(parts))
    return out + [out[-1]] * 3


def brute_marks(sequences, size):
    count = Counter(tuple(s[i : i + size]) for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        bad = [False] * len(s)
        for i in range(len(s) - size + 1):
            if count[tuple(s[i : i + size])] > 1:
                bad[i : i + size] = [True] * size
        out.append(bad)
    return out


@pytest.mark.parametrize("most_segments, block", [(1000, None), (2, None), (1000, 64)])
def test_substring_dedup(spark, monkeypatch, most_segments, block):
    rng = random.Random(5)
    texts = corpus(rng, [f"w{i}" for i in range(30)] + ["é", "Ü"], " ")
    if block:
        monkeypatch.setattr(repeats, "BLOCK", block)
    spec = dataclasses.replace(substring_dedup.SPEC, window=9, gram=4, most_segments=most_segments)
    got = substring_dedup.remove_repeated_passages(docs(spark, texts), spec=spec).orderBy("doc_id").collect()
    sequences = [words(t) for t in texts]
    for r, s, bad in zip(got, sequences, brute_marks(sequences, 9), strict=True):
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(s), sum(bad), " ".join(w for w, b in zip(s, bad, strict=True) if not b))


@pytest.mark.parametrize("lone, most_segments", [(True, 1000), (False, 1000), (False, 2)])
def test_suffix_dedup(spark, lone, most_segments):
    rng = random.Random(6)
    texts = corpus(rng, list("abcdefghij é"), "")
    spec = dataclasses.replace(suffix_dedup.SPEC, window=24, gram=8, lone=lone, most_segments=most_segments)
    got = suffix_dedup.remove_repeated_bytes(docs(spark, texts), spec=spec).orderBy("doc_id").collect()
    sequences = [(t or "").encode() for t in texts]
    for r, s, bad in zip(got, sequences, brute_marks(sequences, 24), strict=True):
        kept = bytes(x for x, b in zip(s, bad, strict=True) if not b)
        spans = sum(b and (i == 0 or not bad[i - 1]) for i, b in enumerate(bad))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(s), sum(bad), spans, kept)


def test_substring_dedup_odd_tables(spark):
    spec = dataclasses.replace(substring_dedup.SPEC, window=5, gram=2)
    assert substring_dedup.remove_repeated_passages(docs(spark, []), spec=spec).count() == 0
    twice = docs(spark, ["a b c d e f", "a b c d e f", "q r s t u v"], [7, 7, None])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeated_passages(twice, spec=spec).collect())
    assert got == [(0, 0), (7, 6), (7, 6)]
    mixed = docs(spark, ["a b c d e f", "q r s t u v", "a b c d e f"], [7, 7, 8]).withColumn("pos", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeated_passages(mixed, spec=spec).collect())
    assert got == [(7, 0), (7, 6), (8, 6)]


def test_queries_on_data(spark, data):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in substring_dedup.op4_substring_dedup(spark, data).collect()}
    sequences = [words(t) for _, t in rows]
    for (i, _), s, bad in zip(rows, sequences, brute_marks(sequences, 35), strict=True):
        kept = " ".join(w for w, b in zip(s, bad, strict=True) if not b).encode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(s), sum(bad), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: r for r in suffix_dedup.op10_suffix_dedup(spark, data).collect()}
    count = Counter(hash(d[i : i + 400]) for _, t in rows for d in [t.encode()] for i in range(len(d) - 399))
    for i, t in rows:
        d, mark = t.encode(), np.zeros(len(t.encode()) + 1, int)
        for j in range(len(d) - 399):
            if count[hash(d[j : j + 400])] > 1:
                mark[j] += 1
                mark[j + 400] -= 1
        bad = np.cumsum(mark[:-1]) > 0
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(d), int(bad.sum()))
        assert got[i]["kept_sha256"] == hashlib.sha256(np.frombuffer(d, np.uint8)[~bad].tobytes()).hexdigest()


# ---- n-gram join ----------------------------------------------------------------------------------------------------


def brute_components(texts, ids=None, size=4, numerator=85):
    ids = list(ids or range(len(texts)))
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return [(len(s), find(i)) for i, s in zip(ids, sets, strict=True)]


def near_copies(rng, n=150):
    vocabulary = [f"v{i}" for i in range(60)]
    texts = [None, "", "one", "One", "one two", "ONE two three", "one two three", "a b c d", "a b c d a b c d"]
    bases = [rng.choices(vocabulary, k=rng.randint(4, 120)) for _ in range(6)]
    passage = rng.choices(vocabulary, k=25)
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = passage + rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed, chunk", [(0, 256), (1, 3)])
def test_ngram_join(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "QUERIES", 2 if chunk == 3 else 1000)
    texts = near_copies(random.Random(seed))
    got = ngram_join.similar_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)


@pytest.mark.parametrize("seed, chunk", [(2, 256), (3, 3)])
def test_ngram_join_other_threshold(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "QUERIES", 2 if chunk == 3 else 1000)
    texts = near_copies(random.Random(seed))
    got = ngram_join.similar_components(docs(spark, texts), shingle=5, numerator=80).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, size=5, numerator=80) != brute_components(texts)


def test_linked_sets_share_kept_signatures():
    """Whatever the order of the signatures, two linked sets keep a common one after leaving out what they may."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, int(0.1 * n)) + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or not ngram_join.links(len(x), len(y), common) or (len(x) == len(y) == common):
            continue
        salt = np.uint64(rng.integers(0, 2**63))
        kept = []
        for s in (x, y):
            sig, spare = ngram_join.signatures(s)
            own = set()
            for c in np.unique(spare):
                mine = sig[spare == c]
                order = mine[np.argsort(repeats.mixed(mine ^ salt))]
                own |= set(order[: len(order) - int(c & 0xFFFFFFFF)].tolist())
            kept.append(own)
        assert kept[0] & kept[1]


def test_ngram_join_odd_tables(spark):
    assert ngram_join.similar_components(docs(spark, [])).count() == 0
    got = ngram_join.similar_components(docs(spark, ["a b c d e", "a b c d e", None], [None, 4, 3]).withColumn("sig", F.lit(1))).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (4, 4), (3, 3)}


def test_ngram_join_null_and_shared_ids(spark):
    w = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(w), " ".join([*w, "x"]), "a b c d e f"
    for order in ([(None, text), (5, text), (9, near)], [(5, text), (9, near), (None, text)]):
        got = ngram_join.similar_components(docs(spark, [t for _, t in order], [i for i, _ in order]).coalesce(1)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (5, 5), (9, 5)}
    for pair in ([other, text], [text, other]):
        got = ngram_join.similar_components(docs(spark, [*pair, near, other], [1, 1, 2, 3])).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_ngram_join_pairs_chunks(spark, monkeypatch):
    """A passage in all documents: signatures of many components, and hubs that are packed."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = random.Random(11)
    passage = rng.choices([f"p{i}" for i in range(30)], k=60)
    texts = [" ".join(passage + [f"q{i}x{j}" for j in range(rng.choice([0, 8, 12, 16, 20, 25]))]) for i in range(90)]
    got = ngram_join.similar_components(docs(spark, texts), shingle=5, numerator=80).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, size=5, numerator=80)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------


def test_decontamination_words(spark):
    from pyspark.sql import functions as F

    texts = ["", " ", "..a", "a..", "A0b1", "\x00a\n", "İAb", "É-é\x7fx", "😀b 😀", "a  b\u00a0c"]
    rows = docs(spark, texts).select("doc_id", decontamination.words_of(F.col("text")).alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in rows} == {i: WORD.findall(lower(t)) for i, t in enumerate(texts)}


def test_pipeline(spark, data):
    import corpus_pipeline

    base = spark.read.parquet(f"{data}/documents.parquet")
    now, seen = base, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        if name != "piece_encoding":
            assert out.columns == base.columns
        seen.append({r["doc_id"]: r for r in out.collect()})
        if name != "piece_encoding":
            now = spark.createDataFrame(list(seen[-1].values()), base.schema)
    ids = [set(s) for s in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] and len(ids[0]) > 0.9 * base.count()
    last = {}
    for i in sorted(ids[0]):
        last[lower(seen[0][i]["text"])] = i
    assert ids[1] == set(last.values())
    order = sorted(ids[1])
    kept = {i for i, (_, c) in zip(order, brute_components([seen[1][i]["text"] for i in order], order), strict=True) if c == i}
    assert ids[2] == kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = defaultdict(set)
    for _, t in items:
        own = WORD.findall(lower(t))
        n = min(10, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            windows[n].add(tuple(own[s : s + n]))
    clean = set()
    for i in ids[2]:
        w = WORD.findall(lower(seen[2][i]["text"]))
        if not any(tuple(w[p : p + n]) in found for n, found in windows.items() for p in range(len(w) - n + 1)):
            clean.add(i)
    assert ids[3] == clean
    assert corpus_pipeline.run(spark, data).count() == len(ids[4])
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"]


def test_pipeline_near_copies(spark, data):
    import corpus_pipeline

    w, other = [f"w{i}" for i in range(104)], [f"o{i}" for i in range(46 + 4)]
    more = [f"m{i}" for i in range(25)]  # 100 of 125 runs of 5 words, 101 of 126 of 4: appended text
    changed = [*other[:20], "new", *other[21:]]  # 41 of 51 of 5, 43 of 51 of 4: one word changed
    texts = [" ".join(x) for x in (w, w + more, other, changed, w + more + ["last"])]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), data).collect())
    assert kept == [i for i, (_, c) in enumerate(brute_components(texts, size=5, numerator=80)) if i == c] == [0, 2]


def test_pipeline_rows_without_an_id_or_with_a_shared_one(spark, data):
    import corpus_pipeline

    bad = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    some = docs(spark, [bad, bad, "clean words here", "more clean words"], [None, 1, 1, None]).withColumn("gone_", F.lit(1))
    kept = corpus_pipeline.drop_contaminated(spark, some, data)
    assert kept.columns == some.columns and sorted(r["text"] for r in kept.collect()) == ["clean words here", "more clean words"]
    copies = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q r s"], [2, 1, None, 2]).withColumn("gone_", F.lit(1))
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, copies, data).collect()) == ["1", "None"]


def test_pipeline_odd_rows(spark, data, tmp_path):
    import corpus_pipeline

    docs(spark, [None, "", "123", "hello there", "hello there", None], [1, 2, 3, 4, 5, None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [5]
