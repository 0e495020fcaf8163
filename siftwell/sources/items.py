"""Readers and writers of evaluation data. Readers give long tables: items, outputs, scores (with a dataset column)."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.columns import SEVERITY_WEIGHTS, annotation_cost, mqm_score, severities
from siftwell.operators import normalize

Tables = dict[str, DataFrame]

#: The wire form: one JSON object for each item, maps for systems and metrics.
WIRE = "i string, src string, ref string, doc string, domain string, cost double, tgt map<string,string>, scores map<string,map<string,double>>"
NEUTRAL_BIOMQM = {"minor": -1.0, "major": -5.0}
HUMAN_PROTOCOLS = ("mqm", "esa-merged", "esa", "da-sqm", "mqm", "wmt", "appraise", "wmt-raw", "wmt-appraise")
REFERENCES = ("refA", "refB", "refC", "ref")
#: The test pairs of wmt23.
TEST_PAIRS = ("cs-uk", "de-en", "en-cs", "en-de", "en-ja", "en-zh", "he-en", "ja-en", "zh-en")
NOT_SYSTEMS = ("synthetic_ref", "chrf_bestmbr")


def to_long(wire: DataFrame, dataset: str) -> Tables:
    """Nested items (pos, i, src, ref, doc, domain, cost, tgt, scores) as long tables."""
    base = wire.withColumn("dataset", F.lit(dataset)).withColumn("item_id", F.coalesce("i", F.col("pos").cast("string")))
    items = base.select("dataset", "item_id", "pos", "src", "ref", "doc", "domain", "cost")
    outputs = base.select("dataset", "item_id", "pos", F.explode("tgt").alias("system", "tgt"))
    scores = base.select("dataset", "item_id", "pos", F.explode("scores").alias("system", "m_")).select("dataset", "item_id", "pos", "system", F.explode("m_").alias("metric", "value"))
    return {"items": items, "outputs": outputs, "scores": scores}


def to_wire(tables: Tables, extra: list[str] | None = None) -> DataFrame:
    """Long tables as nested items. Repeated (item, system, metric) entries keep their largest value."""
    keys = ["dataset", "item_id"]
    one = tables["scores"].groupBy(*keys, "system", "metric").agg(F.max("value").alias("value"))
    per = one.groupBy(*keys, "system").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m_"))
    scores = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("system", "m_"))).alias("scores"))
    out = tables["items"].join(scores, keys, "left")
    if "outputs" in tables:
        texts = tables["outputs"].groupBy(*keys, "system").agg(F.max("tgt").alias("tgt"))
        out = out.join(texts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("system", "tgt"))).alias("tgt")), keys, "left")
    return out.withColumnRenamed("item_id", "i")


def numbered_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """pos (from 0, in each file), line. Files are read in blocks: lines count within their block, and the lines of the blocks before it are added."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias(name), F.col("_metadata.file_path").alias("f_"), F.col("_metadata.file_block_start").alias("b_"), F.monotonically_increasing_id().alias("o_")
    )
    before = Window.partitionBy("f_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("f_", "b_").agg(F.count(F.lit(1)).alias("c_"))
    blocks = blocks.select("f_", "b_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("c_"))
    inside = F.row_number().over(Window.partitionBy("f_", "b_").orderBy("o_")) - 1
    return lines.withColumn("n_", inside).join(blocks, ["f_", "b_"]).select((F.col("n_") + F.col("c_")).cast("long").alias("pos"), name)


def read_jsonl(spark: SparkSession, path: str, dataset: str = "custom") -> Tables:
    """Items in wire form; their order is that of the lines."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.select("pos", F.from_json("value", WIRE).alias("x")).select("pos", "x.*")
    return to_long(parsed, dataset)


def read_parquet(spark: SparkSession, path: str, dataset: str = "custom") -> Tables:
    return to_long(spark.read.parquet(path), dataset)


def from_rows(spark: SparkSession, rows: list[dict], dataset: str = "custom") -> Tables:
    """Items given as Python dicts in wire form."""
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, value string")
    return to_long(lines.select("pos", F.from_json("value", WIRE).alias("x")).select("pos", "x.*"), dataset)


def write_jsonl(wire: DataFrame, path: str, order: str = "rank") -> None:
    """One JSON object for each item, in order, in one file: a selection is as small as what people can annotate."""
    wire.coalesce(1).sortWithinPartitions(order).write.option("ignoreNullFields", "false").json(path)


def write_training_csv(utility: DataFrame, items: DataFrame, path: str) -> None:
    """src,score pairs for training a source scorer."""
    items.join(utility, ["item_id", "pos"]).select("src", F.col("utility").alias("score")).write.option("header", True).csv(path)


def cached(spark: SparkSession, folder: str, options: dict, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Parquet cache keyed by all options and the version."""
    key = hashlib.sha256(json.dumps([version, options], sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - a missing path is the normal case
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


# ---- shared-task folders: text files by line ------------------------------------------------------------------------


def _names(spark: SparkSession, folder: str) -> list[str]:
    """File names in a folder, by Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def _bad(value: Column, zero_bad: bool) -> Column:
    return value.isNull() | (value == 0) if zero_bad else value.isNull()


def read_wmt(spark: SparkSession, root: str, year: str, langs: str, normalize_scores: bool = False, binarize: bool = False, protocol: str | None = None, reference: str | None = None, zero_bad: bool = False, include_ref: bool = False, require_human: bool = True) -> Tables | None:
    """A language pair of a shared task: sources, documents, references, system-outputs, human-scores, metric-scores.

    None if there is no reference, or no human scores where they are required. Without them (require_human off) every
    item keeps its own metric scores and has no human one.
    """
    base = f"{root}/{year}"
    dataset = f"{year}/{langs}"
    refs = [n.removeprefix(f"{langs}.").removesuffix(".txt") for n in _names(spark, f"{base}/references") if n.startswith(f"{langs}.") and n.endswith(".txt")]
    wanted = [r for r in ((reference,) if reference else ()) + REFERENCES if r in refs]
    if not wanted:
        return None
    ref = wanted[0]
    source = numbered_lines(spark, f"{base}/sources/{langs}.txt", "src")
    canary = source.where((F.col("pos") == 0) & F.lower("src").contains("canary")).count() if year != "wmt24pp" else 0

    def lines(path: str, name: str) -> DataFrame:
        x = numbered_lines(spark, path, name)
        return x.where(F.col("pos") >= canary).withColumn("pos", F.col("pos") - canary)

    items = lines(f"{base}/sources/{langs}.txt", "src").join(lines(f"{base}/references/{langs}.{ref}.txt", "ref"), "pos")
    docs = numbered_lines(spark, f"{base}/documents/{langs}.docs", "d_")
    part = F.split("d_", "\t")
    docs = docs.select((F.col("pos") - (canary if canary else 0)).alias("pos"), part[0].alias("domain"), F.try_element_at(part, F.lit(2)).alias("doc"))
    items = items.join(docs, "pos", "left")
    folder = f"{base}/system-outputs/{langs}"
    outputs = None
    for n in _names(spark, folder):
        name = n.removesuffix(".txt").removesuffix(".jsonl")
        if name in NOT_SYSTEMS or (name in refs and not include_ref):
            continue
        own = lines(f"{folder}/{n}", "tgt")
        own = own.withColumn("tgt", F.get_json_object("tgt", "$.hypothesis")) if n.endswith(".jsonl") else own
        own = own.withColumn("system", F.lit(name))
        outputs = own if outputs is None else outputs.unionByName(own)
    if outputs is None:
        return None

    def score_file(path: str, metric: str) -> DataFrame:
        x = numbered_lines(spark, path, "s_").where(F.trim("s_") != "")
        cell = F.split(F.trim("s_"), r"\s+")
        return x.select("pos", cell[0].alias("system"), F.when(cell[1] != "None", F.expr("try_cast(split(trim(s_), '\\\\s+')[1] AS double)")).alias("value")).withColumn(
            "pos", F.row_number().over(Window.partitionBy("system").orderBy("pos")).cast("long") - 1
        ).withColumn("metric", F.lit(metric))

    known = _names(spark, f"{base}/human-scores")
    human = next((p for p in ((protocol,) if protocol else ()) + HUMAN_PROTOCOLS if f"{langs}.{p}.seg.score" in known), None)
    if human is None and require_human:
        return None
    scores = score_file(f"{base}/human-scores/{langs}.{human}.seg.score", "human") if human else None
    for n in _names(spark, f"{base}/metric-scores/{langs}"):
        for end in (f"-{ref}.seg.score", "-src.seg.score"):
            if n.endswith(end):
                own = score_file(f"{base}/metric-scores/{langs}/{n}", n.removesuffix(end))
                scores = own if scores is None else scores.unionByName(own)
    scores = scores.join(outputs.select("pos", "system"), ["pos", "system"], "left_semi")
    if human:
        h = scores.where("metric = 'human'")
        good = h.groupBy("system").agg(F.max((~_bad(F.col("value"), zero_bad)).cast("int")).alias("g_")).where("g_ = 1").select("system")
        marked = outputs.select("pos", "system").join(good, "system", "left_semi").join(h.select("pos", "system", "value"), ["pos", "system"], "left")
        poor = marked.where(_bad(F.col("value"), zero_bad)).select("pos").distinct()
        outputs = outputs.join(good, "system", "left_semi").join(poor, "pos", "left_anti")
        scores = scores.join(good, "system", "left_semi").join(poor, "pos", "left_anti")
        items = items.join(poor, "pos", "left_anti")
    items = items.select(F.lit(dataset).alias("dataset"), F.col("pos").cast("string").alias("item_id"), "pos", "src", "ref", "doc", "domain", annotation_cost(F.col("src"), F.lit(langs)).alias("cost"))
    items = normalize.cost_normalize(items, ("dataset",))
    tag = lambda df: df.withColumn("dataset", F.lit(dataset)).withColumn("item_id", F.col("pos").cast("string"))
    scores = normalize.human_scale(tag(scores), by=("dataset",))
    if binarize:
        scores = normalize.median_binarize(scores, ("dataset",))
    elif normalize_scores:
        scores = normalize.minmax(scores, ("dataset",))
    return {"items": items, "outputs": tag(outputs), "scores": scores}


def read_wmt_many(spark: SparkSession, root: str, pairs: list[tuple[str, str]], min_items: int = 100, name_filter: Callable[[str, str], bool] = lambda year, langs: True, **options) -> dict[tuple[str, str], Tables]:
    """Every pair that name_filter lets through (asked before loading) and that has more than min_items items."""
    out = {}
    for year, langs in pairs:
        if name_filter(year, langs) and (t := read_wmt(spark, root, year, langs, **options)) and t["items"].count() > min_items:
            out[year, langs] = t
    return out


def wmt_pairs(spark: SparkSession, root: str, years: list[str] | None = None) -> list[tuple[str, str]]:
    """Every (year, language pair) with a source file below root."""
    found = years or [n for n in _names(spark, root) if n.startswith("wmt")]
    return [(y, n.removesuffix(".txt")) for y in found for n in _names(spark, f"{root}/{y}/sources") if n.endswith(".txt")]


def read_wmt_test(spark: SparkSession, root: str, **options) -> dict[tuple[str, str], Tables]:
    """The fixed test pairs."""
    return read_wmt_many(spark, root, [("wmt23", p) for p in TEST_PAIRS], min_items=0, **options)


# ---- other collections ----------------------------------------------------------------------------------------------


def read_biomqm(spark: SparkSession, path: str, normalize_scores: bool = False) -> Tables:
    """Medical error annotations: 100 minus 1 for a minor and 5 for a major error; items are (src, ref, doc)."""
    errors = "array<struct<severity:string>>"
    x = spark.read.schema(f"src string, ref array<string>, doc_id string, lang_src string, lang_tgt string, system string, tgt string, errors_tgt {errors}").json(path)
    x = x.select(F.concat_ws("-", "lang_src", "lang_tgt").alias("dataset"), "src", F.try_element_at("ref", F.lit(1)).alias("ref"), F.col("doc_id").alias("doc"), "system", "tgt", (100 + mqm_score(severities(F.coalesce("errors_tgt", F.array().cast(errors))), NEUTRAL_BIOMQM)).alias("value"))
    keys = x.select("dataset", "src", "ref", "doc").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("dataset").orderBy("doc", "src", "ref")).cast("long") - 1)
    both = x.alias("x").join(keys.alias("k"), (F.col("x.dataset") == F.col("k.dataset")) & (F.col("x.src") == F.col("k.src")) & F.col("x.ref").eqNullSafe(F.col("k.ref")) & F.col("x.doc").eqNullSafe(F.col("k.doc"))).select("x.*", "k.pos")
    both = both.withColumn("item_id", F.col("pos").cast("string"))
    items = both.select("dataset", "item_id", "pos", "src", "ref", "doc", F.lit(None).cast("string").alias("domain")).distinct().withColumn("cost", annotation_cost(F.col("src"), F.col("dataset")))
    scores = both.groupBy("dataset", "item_id", "pos", "system").agg(F.avg("value").alias("value")).withColumn("metric", F.lit("human")).select("dataset", "item_id", "pos", "system", "metric", "value")
    if normalize_scores:
        items, scores = normalize.cost_normalize(items, ("dataset",)), normalize.minmax(scores, ("dataset",), 100.0)
    return {"items": items, "outputs": both.select("dataset", "item_id", "pos", "system", "tgt"), "scores": scores}


def parse_error_list(text: Column) -> Column:
    """Severities out of an error list that is written as a Python literal."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""['"]severity['"]\s*:\s*['"]([^'"]*)['"]"""), F.lit(1))
    return F.transform(found, lambda s: F.lower(s))


def nfkc(text: Column) -> Column:
    """Unicode NFKC, stripped; in Arrow batches, as Spark has no such function."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())

    return run(text)


def read_qe4pe(spark: SparkSession, rows: DataFrame, mqm: list[str], attributes: list[str], normalize_scores: bool = False, weights: dict[str, float] | None = None, skip: Column | None = None) -> Tables:
    """Post-editing rows (src_text, mt_text, pe_text, doc_id, segment_in_doc_id, wmt_category, src_lang, tgt_lang, translator_main_id): error lists become 100 + penalties, attributes become numbers (null is 0)."""
    x = rows if skip is None else rows.where(~skip)
    x = x.withColumns({c: nfkc(F.col(c)) for c in ("src_text", "mt_text", "pe_text")})
    value = {m: 100 + mqm_score(parse_error_list(F.col(m)), weights or SEVERITY_WEIGHTS) for m in mqm} | {a: F.coalesce(F.expr(f"try_cast(`{a}` AS double)"), F.lit(0.0)) for a in attributes}
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in value.items()])
    x = x.select(F.concat_ws("-", "src_lang", "tgt_lang").alias("dataset"), F.col("doc_id").cast("string").alias("doc"), F.col("segment_in_doc_id").cast("long").alias("seg_"), F.col("wmt_category").alias("domain"), F.col("src_text").alias("src"), F.col("translator_main_id").alias("system"), F.col("pe_text").alias("tgt"), cells.alias("c_"))
    place = Window.partitionBy("dataset").orderBy("doc", "seg_")
    x = x.withColumn("pos", (F.dense_rank().over(place) - 1).cast("long")).withColumn("item_id", F.col("pos").cast("string"))
    items = x.groupBy("dataset", "item_id", "pos").agg(F.min("src").alias("src"), F.lit(None).cast("string").alias("ref"), F.min("doc").alias("doc"), F.min("domain").alias("domain"))
    items = normalize.cost_normalize(items.withColumn("cost", annotation_cost(F.col("src"), F.col("dataset"))), ("dataset",))
    scores = x.select("dataset", "item_id", "pos", "system", F.explode("c_").alias("c")).select("dataset", "item_id", "pos", "system", "c.metric", "c.value")
    if normalize_scores:
        scores = normalize.minmax(scores, ("dataset",), 100.0)
    return {"items": items, "outputs": x.select("dataset", "item_id", "pos", "system", "tgt"), "scores": scores}


def read_summeval(spark: SparkSession, path: str, normalize_scores: bool = True, extra: list[str] | None = None) -> Tables:
    """Summaries: flat metrics, rouge, mean expert annotations (human_*) with their sum and product; extra score files (id, system, metric, value) join by id."""
    x = spark.read.text(path).select(F.from_json("value", "id string, text string, model_id string, decoded string, metric_scores_1 string, expert_annotations array<map<string,double>>").alias("x")).select("x.*")
    flat = F.from_json("metric_scores_1", "map<string,string>")
    number = lambda v: F.coalesce(F.expr("try_cast(0 AS double)") if v is None else v.try_cast("double"), F.try_element_at(F.from_json(v, "array<double>"), F.lit(1)))
    metrics = x.select("id", "model_id", F.explode(flat).alias("metric", "v")).where("metric <> 'rouge'").select("id", "model_id", "metric", number(F.col("v")).alias("value"))
    rouge = x.select("id", "model_id", F.explode(F.from_json(F.get_json_object("metric_scores_1", "$.rouge"), "map<string,double>")).alias("metric", "value"))
    expert = x.select("id", "model_id", F.explode("expert_annotations").alias("e")).select("id", "model_id", F.explode("e").alias("m", "v")).groupBy("id", "model_id", F.concat(F.lit("human_"), "m").alias("metric")).agg(F.avg("v").alias("value"))
    total = expert.groupBy("id", "model_id").agg(F.sum("value").alias("human_sum"), F.product("value").alias("human_mul"))
    total = total.select("id", "model_id", F.explode(F.create_map(F.lit("human_sum"), "human_sum", F.lit("human_mul"), "human_mul")).alias("metric", "value"))
    scores = metrics.unionByName(rouge).unionByName(expert).unionByName(total)
    for file in extra or []:
        scores = scores.unionByName(spark.read.schema("id string, model_id string, metric string, value double").json(file))
    ids = x.select("id").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))
    scores = scores.where("value IS NOT NULL").join(ids, "id").select(F.lit("summeval").alias("dataset"), F.col("id").alias("item_id"), "pos", F.col("model_id").alias("system"), "metric", "value")
    none = F.lit(None).cast("string")
    items = x.groupBy("id").agg(F.max("text").alias("src")).join(ids, "id").select(F.lit("summeval").alias("dataset"), F.col("id").alias("item_id"), "pos", "src", none.alias("ref"), none.alias("doc"), none.alias("domain"), F.lit(None).cast("double").alias("cost"))
    outputs = x.join(ids, "id").select(F.lit("summeval").alias("dataset"), F.col("id").alias("item_id"), "pos", F.col("model_id").alias("system"), F.col("decoded").alias("tgt"))
    if normalize_scores:
        scores = normalize.minmax(scores, ("dataset",))
    return {"items": items, "outputs": outputs, "scores": scores}


def read_iwslt(spark: SparkSession, meta_path: str, data_path: str, dataset: str) -> Tables:
    """Two JSON-lines files joined by id: meta names system (without its last part), document and segment; the score is the first annotation's rating."""
    meta = spark.read.schema("id string, meta string, previous_context string").json(meta_path)
    data = spark.read.schema("id string, source string, target string, annotations array<struct<quality_rating:double>>").json(data_path)
    part = F.split("meta", r"\.")
    x = meta.join(data, "id").select(
        F.regexp_replace("meta", r"\.[^.]*$", "").alias("full_"), F.regexp_extract("meta", r"seg_(\d+)", 1).cast("long").alias("seg_"), F.try_element_at(part, F.lit(3)).alias("doc"),
        part[0].alias("system"), F.coalesce("source", F.lit("")).alias("src"), F.col("target").alias("tgt"), F.try_element_at("annotations", F.lit(1))["quality_rating"].alias("value"),
    )
    x = x.withColumn("pos", (F.dense_rank().over(Window.orderBy("doc", "seg_")) - 1).cast("long")).withColumn("item_id", F.col("pos").cast("string")).withColumn("dataset", F.lit(dataset))
    none = F.lit(None).cast("string")
    items = x.groupBy("dataset", "item_id", "pos").agg(F.max("src").alias("src"), none.alias("ref"), F.min("doc").alias("doc"), none.alias("domain")).withColumn("cost", annotation_cost(F.col("src"), F.col("dataset")))
    scores = x.select("dataset", "item_id", "pos", "system", F.lit("human").alias("metric"), "value")
    return {"items": items, "outputs": x.select("dataset", "item_id", "pos", "system", "tgt"), "scores": scores}


def read_rose(spark: SparkSession, path: str, dataset: str = "rose") -> Tables:
    """Summaries with key-fact scores (source, reference, system_outputs map, annotations map of system to score)."""
    lines = numbered_lines(spark, path)
    x = lines.select("pos", F.from_json("value", "source string, reference string, system_outputs map<string,string>, annotations map<string,struct<normalized_acu:double>>").alias("x")).select("pos", "x.*")
    wire = x.select("pos", F.lit(None).cast("string").alias("i"), F.col("source").alias("src"), F.col("reference").alias("ref"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("cost"), F.col("system_outputs").alias("tgt"), F.transform_values("annotations", lambda k, v: F.create_map(F.lit("human"), v["normalized_acu"])).alias("scores"))
    return to_long(wire, dataset)


def read_rating_csv(spark: SparkSession, path: str, src: str, tgt: str, system: str, ratings: list[str], dataset: str = "simplification") -> Tables:
    """A CSV with several ratings in each row: human is their mean."""
    x = spark.read.option("header", True).option("multiLine", True).csv(path)
    x = x.withColumn("pos", (F.dense_rank().over(Window.orderBy(src)) - 1).cast("long")).withColumn("item_id", F.col("pos").cast("string"))
    mean = sum((F.col(r).cast("double") for r in ratings), F.lit(0.0)) / len(ratings)
    base = x.select(F.lit(dataset).alias("dataset"), "item_id", "pos", F.col(src).alias("src"), F.col(tgt).alias("tgt"), F.col(system).alias("system"), mean.alias("value"))
    none = F.lit(None).cast("string")
    items = base.select("dataset", "item_id", "pos", "src", none.alias("ref"), none.alias("doc"), none.alias("domain")).distinct().withColumn("cost", annotation_cost(F.col("src"), F.lit("en")))
    return {"items": items, "outputs": base.select("dataset", "item_id", "pos", "system", "tgt"), "scores": base.select("dataset", "item_id", "pos", "system", F.lit("human").alias("metric"), "value")}


READERS: dict[str, Callable[..., Tables]] = {"summeval": read_summeval, "biomqm": read_biomqm, "qe4pe": read_qe4pe, "iwslt": read_iwslt, "rose": read_rose}


def register_reader(name: str, fn: Callable[..., Tables]) -> None:
    READERS[name] = fn


def load_data(spark: SparkSession, data: str | list[dict], root: str | None = None, **options) -> Tables | dict[tuple[str, str], Tables] | None:
    """A list of items, a shared-task name (wmt23/en-cs), a registered collection, or a JSON-lines path."""
    if isinstance(data, list):
        return from_rows(spark, data)
    if data.startswith("wmt") and root:
        year, langs = data.split("/")
        if year == "wmt":
            return read_wmt_many(spark, root, options.pop("pairs", None) or wmt_pairs(spark, root), **options)
        return read_wmt(spark, root, year, langs, **options)
    if data in READERS:
        return READERS[data](spark, root, **options)
    if "/" in data or data.endswith((".jsonl", ".json")):
        return read_jsonl(spark, data)
    raise ValueError(f"no such data: {data}")
