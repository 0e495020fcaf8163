"""Readers on miniature folders, writers, command line, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell import __main__ as cli
from siftwell.sources import items as I
from siftwell.streaming import scores as R


def rows(n=8):
    out = []
    for i in range(n):
        out.append({"i": str(i), "src": f"source {i}", "ref": None, "doc": f"d{i // 2}", "domain": "news", "cost": 1.0, "tgt": {"A": f"a {i}", "B": f"b {i}"}, "scores": {"A": {"human": float(i), "m": 1.0}, "B": {"human": float(i * i % 5), "m": None}}})
    return out


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows()))
    t = I.load_data(spark, str(path))
    assert t["items"].count() == 8 and t["scores"].count() == 32 and t["outputs"].count() == 16
    assert [r["item_id"] for r in t["items"].orderBy("pos").collect()] == [str(i) for i in range(8)]
    wire = I.to_wire(t).withColumn("rank", F.col("pos"))
    I.write_jsonl(wire, str(tmp_path / "out"))
    back = [json.loads(x) for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert [b["i"] for b in back] == [str(i) for i in range(8)]
    assert back[3]["scores"] == {"A": {"human": 3.0, "m": 1.0}, "B": {"human": 4.0, "m": None}}


def test_list_and_unknown(spark):
    assert I.load_data(spark, rows(2))["items"].count() == 2
    with pytest.raises(ValueError):
        I.load_data(spark, "nothing")


def test_command_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows(20)))
    ranked = cli.select_items(spark, str(path), "metric_var", {"metric": "human"})
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 21))
    I.write_jsonl(ranked, str(tmp_path / "new"))
    new = tmp_path / "new.jsonl"
    new.write_text("".join(f.read_text() for f in sorted((tmp_path / "new").glob("part*"))))
    correlation, clusters = cli.evaluate_selection(spark, str(path), str(new), "human")
    assert -100 <= correlation <= 100 and clusters >= 1


def wmt(root, canary=True, human=True):
    base = root / "wmt23"
    head = ["a canary line"] if canary else []
    for folder in ("sources", "documents", "references", "system-outputs/en-cs", "human-scores", "metric-scores/en-cs"):
        (base / folder).mkdir(parents=True)
    put = lambda name, lines: (base / name).write_text("\n".join(lines) + "\n")
    put("sources/en-cs.txt", head + ["one two", "three", "four five six"])
    put("references/en-cs.refA.txt", head + ["r1", "r2", "r3"])
    put("documents/en-cs.docs", ["news\td1"] * (3 + len(head)))
    for s in ("A", "B", "refA", "synthetic_ref"):
        put(f"system-outputs/en-cs/{s}.txt", head + [f"{s}{k}" for k in range(3)])
    if human:
        put("human-scores/en-cs.mqm.seg.score", ["A 0", "A -1", "A -5", "B -2", "B None", "B -3", "C None", "C None", "C None"])
    put("metric-scores/en-cs/X-refA.seg.score", ["A\t0.1", "A\t0.2", "A\t0.3", "B\t0.4", "B\t0.5", "B\t0.6"])
    put("metric-scores/en-cs/Y-refB.seg.score", ["A\t1", "A\t1", "A\t1"])


@pytest.mark.parametrize("canary", [True, False])
def test_wmt_folder(spark, tmp_path, canary):
    wmt(tmp_path, canary)
    t = I.read_wmt(spark, str(tmp_path), "wmt23", "en-cs")
    assert [r["src"] for r in t["items"].orderBy("pos").collect()] == ["one two", "four five six"]  # B has no score for the second
    got = {(r["pos"], r["system"], r["metric"]): r["value"] for r in t["scores"].collect()}
    assert got == {(0, "A", "human"): 100, (2, "A", "human"): 80, (0, "B", "human"): 92, (2, "B", "human"): 88, (0, "A", "X"): 0.1, (2, "A", "X"): 0.3, (0, "B", "X"): 0.4, (2, "B", "X"): 0.6}
    assert {r["system"] for r in t["outputs"].collect()} == {"A", "B"}
    many = I.read_wmt_many(spark, str(tmp_path), [("wmt23", "en-cs"), ("wmt23", "en-xx")], min_items=1, name_filter=lambda y, l: l == "en-cs")
    assert list(many) == [("wmt23", "en-cs")]
    assert I.wmt_pairs(spark, str(tmp_path)) == [("wmt23", "en-cs")]
    assert list(I.read_wmt_test(spark, str(tmp_path))) == [("wmt23", "en-cs")]
    assert list(I.load_data(spark, "wmt/all", str(tmp_path), min_items=1)) == [("wmt23", "en-cs")]


def test_wmt_without_human_scores(spark, tmp_path):
    wmt(tmp_path, human=False)
    assert I.read_wmt(spark, str(tmp_path), "wmt23", "en-cs") is None
    t = I.read_wmt(spark, str(tmp_path), "wmt23", "en-cs", require_human=False)
    assert t["items"].count() == 3 and {r["value"] for r in t["scores"].collect()} == {0.1, 0.2, 0.3, 0.4, 0.5, 0.6}
    assert I.read_wmt(spark, str(tmp_path), "wmt23", "xx-yy") is None


def lines(path, objects):
    path.write_text("".join(json.dumps(o) + "\n" for o in objects))
    return str(path)


def test_biomqm(spark, tmp_path):
    base = {"src": "s", "ref": ["r"], "doc_id": "d", "lang_src": "en", "lang_tgt": "de", "tgt": "t"}
    path = lines(tmp_path / "b.jsonl", [base | {"system": "A", "errors_tgt": [{"severity": "Minor"}, {"severity": "Major"}, {"severity": "Critical"}]}, base | {"system": "B", "errors_tgt": []}])
    t = I.read_biomqm(spark, path)
    assert {r["system"]: r["value"] for r in t["scores"].collect()} == {"A": 94, "B": 100} and t["items"].count() == 1


def test_qe4pe(spark):
    df = spark.createDataFrame([("ﬁne ", "m", "p", "d", 1, "news", "eng", "ita", "t1", "[{'severity': 'Minor'}, {'severity': 'Critical'}]", "2.5"), ("ﬁne ", "m", "q", "d", 1, "news", "eng", "ita", "t2", "[]", None)], "src_text string, mt_text string, pe_text string, doc_id string, segment_in_doc_id int, wmt_category string, src_lang string, tgt_lang string, translator_main_id string, mqm_errors string, edit_time string")
    t = I.read_qe4pe(spark, df, ["mqm_errors"], ["edit_time"])
    assert {(r["system"], r["metric"]): r["value"] for r in t["scores"].collect()} == {("t1", "mqm_errors"): 74, ("t2", "mqm_errors"): 100, ("t1", "edit_time"): 2.5, ("t2", "edit_time"): 0}
    assert t["items"].first()["src"] == "fine"


def test_summeval(spark, tmp_path):
    one = {"id": "x", "text": "t", "model_id": "M1", "decoded": "s", "metric_scores_1": {"coverage": 0.5, "supert": [0.25], "rouge": {"rouge_1": 0.75}}, "expert_annotations": [{"relevance": 4, "fluency": 2}, {"relevance": 2, "fluency": 2}]}
    t = I.read_summeval(spark, lines(tmp_path / "s.jsonl", [one, one | {"id": "y"}]), normalize_scores=False)
    got = {r["metric"]: r["value"] for r in t["scores"].where("item_id = 'x'").collect()}
    assert got == {"coverage": 0.5, "supert": 0.25, "rouge_1": 0.75, "human_relevance": 3, "human_fluency": 2, "human_sum": 5, "human_mul": 6}


def test_iwslt_rose_and_csv(spark, tmp_path):
    meta = lines(tmp_path / "m.jsonl", [{"id": "1", "meta": "sysA.x.doc1.seg_3.end", "previous_context": ""}])
    data = lines(tmp_path / "d.jsonl", [{"id": "1", "source": None, "target": "t", "annotations": [{"quality_rating": 70}]}])
    t = I.read_iwslt(spark, meta, data, "en-ar")
    assert t["scores"].first()["value"] == 70 and t["items"].first()["doc"] == "doc1" and t["items"].first()["src"] == ""
    rose = I.read_rose(spark, lines(tmp_path / "r.jsonl", [{"source": "s", "reference": "r", "system_outputs": {"A": "x"}, "annotations": {"A": {"normalized_acu": 0.5}}}]))
    assert rose["scores"].first()["value"] == 0.5
    (tmp_path / "c.csv").write_text("src,out,sys,r1,r2\nx,y,A,1,3\n")
    assert I.read_rating_csv(spark, str(tmp_path / "c.csv"), "src", "out", "sys", ["r1", "r2"])["scores"].first()["value"] == 2


def test_cache_and_training_file(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    for _ in range(2):
        assert I.cached(spark, str(tmp_path), {"a": 1}, "1", make).count() == 3
    I.cached(spark, str(tmp_path), {"a": 1}, "2", make)
    assert len(made) == 2
    t = I.from_rows(spark, rows(3))
    I.write_training_csv(t["items"].select("item_id", "pos", F.lit(0.5).alias("utility")), t["items"], str(tmp_path / "train"))
    assert spark.read.option("header", True).csv(str(tmp_path / "train")).count() == 3


def test_streaming(spark, tmp_path):
    df = spark.createDataFrame([("i", "A", "m", 1.0), ("i", "B", "m", 3.0), ("j", "A", "m", 5.0)], "item_id string, system string, metric string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {r["system"]: r["mean"] for r in R.into_table(R.running_means(stream), "means").collect()} == {"A": 3, "B": 3}
    assert {r["item_id"]: r["utility"] for r in R.into_table(R.running_utility(stream, "m"), "utilities").collect()} == {"i": 1, "j": 0}
