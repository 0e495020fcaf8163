"""Queries over the driver's tables, one for each operator, with the SQL that must give the same rows.

Floats are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import columns as C
from siftwell.operators import evaluate as E
from siftwell.operators import experiments as X
from siftwell.operators import normalize as N
from siftwell.operators import scorers as S
from siftwell.operators import select as L
from siftwell.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Rounds; minus zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


EV, PT, CV, DC, VC = (f"WITH {x.strip()}" for x in (V.EVENT_SQL, V.PART_SQL, V.CONVERSATION_SQL, V.DOCUMENT_SQL, V.VECTOR_SQL))
UNIFORM = "(('0x' || substr(md5({seed}::VARCHAR || ':' || {key}::VARCHAR), 1, 8))::UBIGINT / 4294967296.0)"


def uniform_sql(seed, key: str) -> str:
    return UNIFORM.format(seed=seed, key=key)


# ---- normalisers and scalar functions -------------------------------------------------------------------------------


@query(PT + "SELECT item_id, system, metric, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS value FROM scores JOIN (SELECT metric, min(value) AS lo, max(value) AS hi FROM scores GROUP BY metric) USING (metric)")
def minmax_normalize(spark, d):
    return r6(N.minmax(V.part_scores(spark, d)), "value").select("item_id", "system", "metric", "value")


@query(PT + "SELECT item_id, system, metric, round(100 * CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS value FROM scores JOIN (SELECT metric, min(value) AS lo, max(value) AS hi FROM scores GROUP BY metric) USING (metric)")
def minmax_percent(spark, d):
    return r6(N.minmax(V.part_scores(spark, d), top=100.0), "value").select("item_id", "system", "metric", "value")


@query(PT + "SELECT item_id, system, metric, (value >= mid)::INT::DOUBLE AS value FROM scores JOIN (SELECT metric, median(value) AS mid FROM scores GROUP BY metric) USING (metric)")
def median_binarize(spark, d):
    return N.median_binarize(V.part_scores(spark, d)).select("item_id", "system", "metric", "value")


@query(PT + "SELECT item_id, system, round(greatest(0, least(100, CASE WHEN hi <= 0 THEN 100 + 4 * value WHEN lo >= 0 AND hi <= 1 THEN 100 * value ELSE value END)), 6) AS value FROM scores, (SELECT min(value) AS lo, max(value) AS hi FROM scores WHERE metric = 'discount') WHERE metric = 'discount'")
def human_scale(spark, d):
    return r6(N.human_scale(V.part_scores(spark, d), "discount").where("metric = 'discount'"), "value").select("item_id", "system", "value")


WORDS_SQL = r"len(list_filter(regexp_split_to_array(src, '\s+'), lambda x: x <> ''))"


@query(DC + f"SELECT item_id, round(0.15 * {WORDS_SQL} + 33.7, 6) AS cost FROM items")
def cost_words(spark, d):
    items = V.document_items(spark, d)
    return r6(items.select("item_id", C.annotation_cost(F.coalesce("src", F.lit("")), F.concat_ws("-", F.lit("en"), "domain")).alias("cost")), "cost")


@query(DC + r"SELECT item_id, round(0.15 * length(regexp_replace(src, '^\s+|\s+$', '', 'g')) + 33.7, 6) AS cost FROM items")
def cost_characters(spark, d):
    return r6(V.document_items(spark, d).select("item_id", C.annotation_cost(F.col("src"), F.lit("en-ja")).alias("cost")), "cost")


COST_SQL = DC + f", c AS (SELECT item_id, pos, domain, doc, utility, 0.15 * {WORDS_SQL} + 33.7 AS cost FROM items), st AS (SELECT avg(cost) AS m, stddev_pop(cost) AS s, min(cost) AS lo FROM c)"


@query(COST_SQL + "SELECT item_id, round(((cost - m) / s + 1 - ((lo - m) / s + 1)) / (1 - ((lo - m) / s + 1)), 6) AS cost FROM c, st")
def cost_normalize(spark, d):
    return r6(N.cost_normalize(_costs(spark, d)), "cost").select("item_id", "cost")


def _costs(spark, d):
    items = V.document_items(spark, d)
    return items.withColumn("cost", C.annotation_cost(F.coalesce("src", F.lit("")), F.lit("en-de"))).drop("src")


@query("SELECT user_id, sum(CASE event_type WHEN 'error' THEN -25.0 WHEN 'click' THEN -1.0 WHEN 'view' THEN 0.0 ELSE 0.0 END) AS score FROM events GROUP BY user_id")
def mqm_score(spark, d):
    names = F.when(F.col("event_type") == "error", "Critical").when(F.col("event_type") == "click", "MINOR").when(F.col("event_type") == "view", "neutral").otherwise("odd")
    errors = V.table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(names.alias("severity"))).alias("errors"))
    return errors.select("user_id", C.mqm_score(C.severities(F.col("errors"))).alias("score"))


@query(PT + "SELECT item_id, system, metric, round(CASE WHEN hi = lo THEN 0 ELSE (greatest(lo, least(hi, value)) - lo) / (hi - lo) END, 6) AS value FROM scores JOIN (SELECT metric, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM scores GROUP BY metric) USING (metric)")
def quantile_scale(spark, d):
    return r6(N.quantile_scale(V.part_scores(spark, d)), "value").select("item_id", "system", "metric", "value")


@query(EV + "SELECT item_id, system, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM scores WHERE metric = 'm'")
def standardize(spark, d):
    return r6(N.standardize(V.event_scores(spark, d).where("metric = 'm'"), "value"), "value").select("item_id", "system", "value")


@query(EV + "SELECT item_id, system, metric, round(value / 7, 6) AS value FROM (SELECT item_id, system, metric, value FROM scores UNION ALL SELECT item_id, system, 'both', sum(value) FROM scores WHERE metric IN ('m', 'human') GROUP BY 1, 2 UNION ALL SELECT item_id, system, 'mul', product(value) FROM scores WHERE metric IN ('m', 'human') GROUP BY 1, 2)")
def derived_metrics(spark, d):
    scores = V.event_scores(spark, d)
    made = N.add_metric(N.add_metric(scores, "both", ["m", "human"]), "mul", ["m", "human"], "mul")
    return made.select("item_id", "system", "metric", F.round(F.col("value") / 7, 6).alias("value"))


DENSE_SQL = """, pairs AS (SELECT DISTINCT item_id, system FROM scores),
top AS (SELECT system FROM (SELECT system, row_number() OVER (ORDER BY count(*) DESC, system) AS rn FROM pairs GROUP BY system) WHERE rn <= 4),
good AS (SELECT item_id FROM pairs WHERE system IN (SELECT system FROM top) GROUP BY item_id HAVING count(*) = (SELECT count(*) FROM top)),
sys AS (SELECT system FROM pairs WHERE item_id IN (SELECT item_id FROM good) GROUP BY system HAVING count(*) = (SELECT count(*) FROM good)),
dense AS (SELECT * FROM scores WHERE item_id IN (SELECT item_id FROM good) AND system IN (SELECT system FROM sys))
"""


@query(PT + DENSE_SQL + "SELECT item_id, system, metric, value FROM dense")
def sanitize_dense(spark, d):
    return N.dense_items(V.part_scores(spark, d), 4).select("item_id", "system", "metric", "value")


@query(EV + "SELECT item_id, system, value FROM scores WHERE metric = 'm' AND system NOT IN ('click', 'error')")
def system_split(spark, d):
    return N.only_systems(V.event_scores(spark, d).where("metric = 'm'"), ["click", "error"], keep=False).select("item_id", "system", "value")


@query(DC + f"SELECT item_id FROM items WHERE NOT contains(src, 'http') AND NOT contains(src, '<div') AND {WORDS_SQL} < 60")
def text_predicates(spark, d):
    return V.document_items(spark, d).where(C.plain_text(F.col("src"))).select("item_id")


# ---- scorers --------------------------------------------------------------------------------------------------------


@query(EV + f"SELECT DISTINCT item_id, round({uniform_sql(7, 'item_id')}, 6) AS utility FROM scores")
def random_order(spark, d):
    return r6(S.random_utility(V.event_scores(spark, d), 7), "utility").select("item_id", "utility")


@query(PT + "SELECT item_id, round(-avg(value), 6) AS utility FROM scores WHERE metric = 'price' GROUP BY item_id")
def metric_avg(spark, d):
    return r6(S.metric_avg(V.part_scores(spark, d), "price"), "utility").select("item_id", "utility")


@query(EV + "SELECT item_id, round(var_pop(value), 6) AS utility FROM scores WHERE metric = 'm' GROUP BY item_id")
def metric_var(spark, d):
    return r6(S.metric_var(V.event_scores(spark, d), "m"), "utility").select("item_id", "utility")


CONS_SQL = """, mu AS (SELECT system, round(avg(value), 9) AS mean FROM scores WHERE metric = 'human' GROUP BY system),
o AS (SELECT item_id, system, value, mean FROM scores JOIN mu USING (system) WHERE metric = 'm'),
g AS (SELECT item_id, count(*) AS n, least(count(DISTINCT value), count(DISTINCT mean)) AS m FROM o GROUP BY item_id),
s AS (SELECT a.item_id, sum(sign(a.value - b.value) * sign(a.mean - b.mean)) AS s FROM o a JOIN o b ON a.item_id = b.item_id AND a.system < b.system GROUP BY a.item_id)
"""


@query(EV + CONS_SQL + "SELECT item_id, round(CASE WHEN m < 2 THEN 0 ELSE 2.0 * coalesce(s, 0) * m / (n * n * (m - 1)) END, 6) AS utility FROM g LEFT JOIN s USING (item_id)")
def metric_cons(spark, d):
    return r6(S.metric_cons(V.event_scores(spark, d), "m", "human"), "utility").select("item_id", "utility")


@query(CV + r""", w AS (SELECT item_id, system, list_filter(regexp_split_to_array(coalesce(tgt, ''), '\s+'), lambda x: x <> '') AS w FROM outputs),
c AS (SELECT item_id, system, t, count(*) AS c FROM (SELECT item_id, system, unnest(w) AS t FROM w) GROUP BY 1, 2, 3),
o AS (SELECT a.item_id, a.system AS a, b.system AS b, sum(least(a.c, b.c)) AS k FROM c a JOIN c b ON a.item_id = b.item_id AND a.t = b.t AND a.system < b.system GROUP BY 1, 2, 3),
p AS (SELECT x.item_id, CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 1.0 ELSE 2.0 * coalesce(k, 0) / (len(x.w) + len(y.w)) END AS f FROM w x JOIN w y ON x.item_id = y.item_id AND x.system < y.system LEFT JOIN o ON o.item_id = x.item_id AND o.a = x.system AND o.b = y.system)
SELECT item_id, round(coalesce(-avg(f), 0), 6) + 0.0 AS utility FROM (SELECT DISTINCT item_id FROM outputs) LEFT JOIN p USING (item_id) GROUP BY item_id""")
def diversity_unigram(spark, d):
    return r6(S.diversity_unigram(V.conversation_outputs(spark, d)), "utility").select("item_id", "utility")


@query(VC + "SELECT item_id, round(coalesce(-avg(s), 0), 6) + 0.0 AS utility FROM (SELECT DISTINCT item_id FROM vectors) LEFT JOIN (SELECT a.item_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM vectors a JOIN vectors b ON a.item_id = b.item_id AND a.system < b.system) USING (item_id) GROUP BY item_id")
def diversity_dot(spark, d):
    return r6(S.diversity_dot(V.vectors(spark, d)), "utility").select("item_id", "utility")


BLEU_SQL = CV + r""", t1 AS (SELECT item_id, system, ' ' || replace(replace(replace(replace(replace(replace(replace(coalesce(tgt, ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ' AS s FROM outputs),
t2 AS (SELECT item_id, system, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\S+') AS w FROM t1),
ln AS (SELECT item_id, system, len(w) AS l FROM t2),
g AS (SELECT item_id, system, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM t2, (SELECT unnest(range(1, 5)) AS n)) GROUP BY ALL),
m AS (SELECT a.item_id, a.system AS x, b.system AS y, a.n, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.item_id = b.item_id AND a.n = b.n AND a.gram = b.gram AND a.system <> b.system GROUP BY ALL),
p AS (SELECT a.item_id, a.system AS x, b.system AS y, a.l AS la, b.l AS lb, q.n, a.l - q.n + 1 AS total, coalesce(m.m, 0) AS m FROM ln a JOIN ln b ON a.item_id = b.item_id AND a.system <> b.system JOIN (SELECT unnest(range(1, 5)) AS n) q ON a.l >= q.n LEFT JOIN m ON m.item_id = a.item_id AND m.x = a.system AND m.y = b.system AND m.n = q.n),
z AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY item_id, x, y ORDER BY n) AS zeros FROM p),
f AS (SELECT item_id, x, y, CASE WHEN sum(m) = 0 THEN 0 ELSE 100 * exp(least(0, 1 - max(lb) / max(la)) + avg(ln(CASE WHEN m > 0 THEN m / total ELSE 1 / (2.0 ** zeros * total) END))) END AS s FROM z GROUP BY ALL),
o AS (SELECT item_id, count(*) AS n, 100.0 * count(*) FILTER (trim(tgt) <> '') AS own FROM outputs GROUP BY item_id)
SELECT item_id, round(CASE WHEN n < 2 THEN 0 ELSE -(own + coalesce(s, 0)) / (n * n) END, 6) + 0.0 AS utility FROM o LEFT JOIN (SELECT item_id, sum(s) AS s FROM f GROUP BY item_id) USING (item_id)"""
CHRF_SQL = CV + r""", t AS (SELECT item_id, system, regexp_replace(coalesce(tgt, ''), '\s+', '', 'g') AS s FROM outputs),
g AS (SELECT item_id, system, n, substr(s, i, n) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, length(s) - n + 2)) AS i FROM t, (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
tot AS (SELECT item_id, system, n, sum(c) AS c FROM g GROUP BY ALL),
m AS (SELECT a.item_id, a.system AS x, b.system AS y, a.n, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.item_id = b.item_id AND a.n = b.n AND a.gram = b.gram AND a.system <> b.system GROUP BY ALL),
f AS (SELECT a.item_id, a.system AS x, b.system AS y, avg(coalesce(m.m, 0) / a.c) AS p, avg(coalesce(m.m, 0) / b.c) AS r FROM tot a JOIN tot b ON a.item_id = b.item_id AND a.n = b.n AND a.system <> b.system LEFT JOIN m ON m.item_id = a.item_id AND m.x = a.system AND m.y = b.system AND m.n = a.n GROUP BY ALL),
o AS (SELECT item_id, count(*) AS n, 100.0 * count(*) FILTER (trim(tgt) <> '') AS own FROM outputs GROUP BY item_id)
SELECT item_id, round(-(own + coalesce(s, 0)) / (n * n), 6) + 0.0 AS utility FROM o LEFT JOIN (SELECT item_id, sum(CASE WHEN p + r = 0 THEN 0 ELSE 500 * p * r / (4 * p + r) END) AS s FROM f GROUP BY item_id) USING (item_id)"""


@query(BLEU_SQL)
def diversity_bleu(spark, d):
    return r6(S.diversity("BLEU", V.conversation_outputs(spark, d)), "utility").select("item_id", "utility")


@query(CHRF_SQL)
def diversity_chrf(spark, d):
    return r6(S.diversity("chrF", V.conversation_outputs(spark, d)), "utility").select("item_id", "utility")


def _two(spark, d):
    scores = V.event_scores(spark, d)
    return [(r6(S.metric_var(scores, "m"), "utility"), 2.0), (r6(S.metric_avg(scores, "human"), "utility"), -1.0)]


TWO_SQL = ", a AS (SELECT item_id, round(var_pop(value), 6) AS u FROM scores WHERE metric = 'm' GROUP BY 1), b AS (SELECT item_id, round(-avg(value), 6) AS u FROM scores WHERE metric = 'human' GROUP BY 1)"
RANK_SQL = "(rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0)"


@query(EV + TWO_SQL + f" SELECT item_id, round((2 * x + y) / 3, 6) AS utility FROM (SELECT item_id, {RANK_SQL} AS x FROM a) JOIN (SELECT item_id, {RANK_SQL} AS y FROM b) USING (item_id)")
def combinator_rank(spark, d):
    return r6(S.combine(_two(spark, d), "avg", "rank"), "utility").select("item_id", "utility")


@query(EV + TWO_SQL + " SELECT item_id, round((2 * x + y) / 3, 6) AS utility FROM (SELECT item_id, (u - avg(u) OVER ()) / stddev_pop(u) OVER () AS x FROM a) JOIN (SELECT item_id, (u - avg(u) OVER ()) / stddev_pop(u) OVER () AS y FROM b) USING (item_id)")
def combinator_zscore(spark, d):
    return r6(S.combine(_two(spark, d), "avg", "zscore"), "utility").select("item_id", "utility")


@query(EV + TWO_SQL + " SELECT item_id, round(x * y, 6) AS utility FROM (SELECT item_id, (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) AS x FROM a) JOIN (SELECT item_id, (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) AS y FROM b) USING (item_id)")
def combinator_mul(spark, d):
    return r6(S.combine(_two(spark, d), "mul", "01"), "utility").select("item_id", "utility")


@query(EV + TWO_SQL + " SELECT item_id, round(a.u * b.u, 4) AS utility FROM a JOIN b USING (item_id)")
def product_scorer(spark, d):
    (a, _), (b, _) = _two(spark, d)
    return S.product_of_scorers(a, b).select("item_id", F.round("utility", 4).alias("utility"))


#: Item and system parameters that any engine can derive: the item-response formulas are under test, not a fit.
PARAMS_SQL = """, params AS (SELECT item_id, round(avg(value) / 25 - 1, 6) AS diff, round(0.2 + stddev_pop(value) / 20, 6) AS disc, round((item_id % 10) / 50.0, 6) AS feas FROM scores WHERE metric = 'm' GROUP BY item_id),
models AS (SELECT system, round(avg(value) / 50 - 1, 6) AS theta FROM scores WHERE metric = 'human' GROUP BY system)
"""


def _params(spark, d):
    scores = V.event_scores(spark, d)
    m = scores.where("metric = 'm'").groupBy("item_id", "pos")
    items = m.agg(F.round(F.avg("value") / 25 - 1, 6).alias("diff"), F.round(0.2 + F.stddev_pop("value") / 20, 6).alias("disc"), F.round(F.pmod("item_id", F.lit(10)) / 50.0, 6).alias("feas"))
    return items, E.model_absolute(scores, "human").select("system", F.round(F.col("mean") / 50 - 1, 6).alias("theta"))


@query(EV + PARAMS_SQL + "SELECT item_id, system, round(feas + (1 - feas) / (1 + exp(-disc * (theta - diff))), 6) AS p4, round(1 / (1 + exp(-disc * (theta - diff))), 6) AS p2, round(1 / (1 + exp(diff - theta)), 6) AS p1, round(feas / (1 + exp(-disc * (theta - diff))), 6) AS ceiling FROM params, models")
def irt_predict(spark, d):
    items, models = _params(spark, d)
    t, f, a, c = (F.col(x) for x in ("theta", "diff", "disc", "feas"))
    both = items.crossJoin(F.broadcast(models))
    return r6(both.select("item_id", "system", C.irt_prediction(t, f, a, c).alias("p4"), C.irt_prediction(t, f, a).alias("p2"), C.irt_prediction(t, f).alias("p1"), C.irt_ceiling(t, f, a, c).alias("ceiling")), "p4", "p2", "p1", "ceiling")


@query(EV + PARAMS_SQL + "SELECT item_id, round(sum(disc * disc * exp(disc * (theta + diff)) / (1 + exp(disc * (theta + diff))) ** 2), 6) AS utility FROM params, models GROUP BY item_id")
def irt_fisher(spark, d):
    items, models = _params(spark, d)
    return r6(S.irt_utility(items, "fic", models), "utility").select("item_id", "utility")


@query(EV + PARAMS_SQL + "SELECT item_id, round(diff * disc, 6) AS diffdisc, round(-diff, 6) AS diff, round(-disc, 6) AS disc, feas FROM params")
def irt_utilities(spark, d):
    items, _ = _params(spark, d)
    out = None
    for kind in ("diffdisc", "diff", "disc", "feas"):
        u = r6(S.irt_utility(items, kind), "utility").select("item_id", F.col("utility").alias(kind))
        out = u if out is None else out.join(u, "item_id")
    return out


@query()
def irt_fit(spark, d):
    items, _ = S.irt_fit(V.event_scores(spark, d), "m", "4pl", binarize=False)
    return r6(items, "diff", "disc", "feas").select("item_id", "diff", "disc", "feas")


@query(DC + f"SELECT item_id, -len(src)::DOUBLE AS utility FROM items")
def external_scorer(spark, d):
    return S.external_scorer(V.document_items(spark, d), lambda s: s.str.len().astype(float), reverse=True).select("item_id", "utility")


@query(CV + ", p AS (SELECT DISTINCT substr(tgt, 1, 20) AS src, tgt FROM outputs), s AS (SELECT src, tgt, length(tgt)::DOUBLE AS s FROM p) SELECT item_id, round(avg(length(tgt)), 6) AS utility FROM outputs GROUP BY item_id")
def pairwise_confidence(spark, d):
    def score(batches):
        for b in batches:
            yield b.assign(score=b["tgt"].str.len().astype(float))

    outputs = V.conversation_outputs(spark, d).withColumn("src", F.substring("tgt", 1, 20))
    return r6(S.pairwise_confidence(outputs, score), "utility").select("item_id", "utility")


@query()
def distilled_scorer(spark, d):
    items = V.document_items(spark, d)
    return r6(S.distilled(items, items.select("item_id", F.log1p("utility").alias("utility")), F.col("item_id") % 2 == 0), "utility").select("item_id", "utility")


@query()
def distilled_network(spark, d):
    x = V.single_vectors(spark, d)
    target = x.select("item_id", F.abs(F.element_at("embedding", 1)).cast("double").alias("utility"))
    return r6(S.distilled_network(x, target, F.col("item_id") % 2 == 0, rounds=60), "utility").select("item_id", "utility")


def _rules_13a_sql(text: str) -> str:
    for pattern, by in C.RULES_13A:
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def _grams_sql(source: str, keys: str, text: str) -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, {n} AS n, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS g FROM (SELECT {keys}, {_rules_13a_sql(f'lower(coalesce({text}, {chr(39) * 2}))')} AS t FROM {source}) WHERE len(t) >= {n}" for n in range(1, 5))
    return f"(SELECT {keys}, n, g, count(*) AS c FROM ({each}) GROUP BY ALL)"


@query(CV + f""", src AS (SELECT item_id, tgt FROM outputs WHERE system = 't0000'), ref AS (SELECT item_id, tgt FROM outputs WHERE system IN ('t0001', 't0002')), many AS (SELECT item_id, count(*) AS many FROM ref GROUP BY 1),
own AS (SELECT DISTINCT item_id, system, many FROM outputs JOIN many USING (item_id)),
x AS (SELECT item_id, system, n, g, sum(s) * any_value(many) AS s, sum(c) * any_value(many) AS c, sum(r) AS r FROM (
SELECT item_id, system, n, g, c AS s, 0 AS c, 0 AS r FROM own JOIN {_grams_sql('src', 'item_id', 'tgt')} USING (item_id) UNION ALL SELECT item_id, system, n, g, 0, 0, c FROM own JOIN {_grams_sql('ref', 'item_id', 'tgt')} USING (item_id)
UNION ALL SELECT item_id, system, n, g, 0, c, 0 FROM {_grams_sql('outputs', 'item_id, system', 'tgt')}) JOIN own USING (item_id, system) GROUP BY ALL),
y AS (SELECT item_id, system, n, sum(least(s, c, r) / least(s, c)) FILTER (least(s, c) > 0) / nullif(count(*) FILTER (least(s, c) > 0), 0) AS kp, sum(least(s, c, r)) / nullif(sum(least(s, r)), 0) AS kr,
sum(greatest(s - c - r, 0) / (s - c)) FILTER (s > c) / nullif(count(*) FILTER (s > c), 0) AS d, count(*) FILTER (c > 0 AND s = 0 AND r > 0) / nullif(count(*) FILTER (c > 0 AND s = 0), 0) AS ap, count(*) FILTER (c > 0 AND s = 0 AND r > 0) / nullif(count(*) FILTER (r > 0 AND s = 0), 0) AS ar FROM x GROUP BY ALL),
z AS (SELECT item_id, system, coalesce(kp, 1) AS kp, coalesce(kr, 1) AS kr, coalesce(d, 1) AS d, coalesce(ap, 1) AS ap, coalesce(ar, 1) AS ar FROM own CROSS JOIN (SELECT unnest(range(1, 5)) AS n) LEFT JOIN y USING (item_id, system, n))
SELECT item_id, system, round(100 * avg((coalesce(2 * kp * kr / nullif(kp + kr, 0), 0) + d + coalesce(2 * ap * ar / nullif(ap + ar, 0), 0)) / 3), 6) AS value FROM z GROUP BY ALL""")
def simplification_score(spark, d):
    """Turns as outputs, the first one as the source and the next two as references."""
    x = V.conversation_outputs(spark, d)
    sources = x.where("system = 't0000'").select("item_id", F.col("tgt").alias("src"))
    found = S.simplification_score(x, sources, x.where("system IN ('t0001', 't0002')").select("item_id", F.col("tgt").alias("ref")))
    return r6(found, "value").select("item_id", "system", "value")


@query()
def distilled_vectors(spark, d):
    x = V.single_vectors(spark, d)
    target = x.select("item_id", F.element_at("embedding", 1).cast("double").alias("utility"))
    return r6(S.distilled_from_vectors(x, target, F.col("item_id") % 2 == 0), "utility").select("item_id", "utility")


# ---- selection ------------------------------------------------------------------------------------------------------

RANKED_SQL = ", u AS (SELECT item_id, pos, round(var_pop(value), 6) AS utility FROM scores WHERE metric = 'm' GROUP BY 1, 2), ranked AS (SELECT item_id, pos, utility, row_number() OVER (ORDER BY utility DESC, pos) AS rank FROM u), new AS (SELECT * FROM scores WHERE item_id IN (SELECT item_id FROM ranked WHERE rank <= (SELECT count(*) // 4 FROM u)))"


def _ranked(scores: DataFrame) -> DataFrame:
    return E.rank_items(r6(S.metric_var(scores, "m"), "utility"))


def _quarter(spark, d) -> tuple[DataFrame, DataFrame]:
    scores = V.event_scores(spark, d)
    ranked = _ranked(scores)
    k = scores.select("item_id").distinct().count() // 4
    return E.prefix(scores, ranked, k), scores


@query(EV + RANKED_SQL + " SELECT item_id, utility, rank FROM ranked WHERE rank <= 20")
def topk_prefix(spark, d):
    return L.top(_ranked(V.event_scores(spark, d)), 20).select("item_id", "utility", F.col("rank").cast("long").alias("rank"))


@query(EV + RANKED_SQL + " SELECT item_id, utility, rank FROM ranked")
def basic_metric_var(spark, d):
    scores = V.event_scores(spark, d)
    return L.basic({"scores": scores}, "metric_var", "m", digits=6).select("item_id", "utility", F.col("rank").cast("long").alias("rank"))


@query(COST_SQL + ", r AS (SELECT item_id, round(sum(cost) OVER (ORDER BY utility / cost DESC, pos ROWS UNBOUNDED PRECEDING), 4) AS spent FROM c) SELECT item_id, spent FROM r WHERE spent < 5000")
def costaware_greedy(spark, d):
    return L.costaware_greedy(_costs(spark, d), 5000.0).select("item_id", F.round("spent", 4).alias("spent"))


@query()
def costaware_exact(spark, d):
    return r6(L.costaware(_costs(spark, d), 3000.0, by=("domain",)), "spent").select("item_id", "spent")


DOC_SQL = DC + ", m AS (SELECT *, round(avg(utility) OVER (PARTITION BY doc), 9) AS du, min(pos) OVER (PARTITION BY doc) AS f FROM items)"


@query(DOC_SQL + " SELECT item_id, row_number() OVER (ORDER BY du DESC, f, pos) AS rank FROM m")
def doc_level(spark, d):
    x = V.document_items(spark, d)
    return L.by_document(x.select("item_id", "pos", "utility"), x).select("item_id", F.col("rank").cast("long").alias("rank"))


@query(DC + ", t AS (SELECT item_id, domain, min(pos) OVER (PARTITION BY domain) AS f, row_number() OVER (PARTITION BY domain ORDER BY utility DESC, pos) AS turn FROM items) SELECT item_id, row_number() OVER (ORDER BY turn, f, domain) AS rank FROM t")
def domain_interleave(spark, d):
    x = V.document_items(spark, d)
    return L.by_domain(x.select("item_id", "pos", "utility"), x).select("item_id", F.col("rank").cast("long").alias("rank"))


@query(DC + ", m AS (SELECT *, round(avg(utility) OVER (PARTITION BY domain, doc), 9) AS du, min(pos) OVER (PARTITION BY domain, doc) AS df, min(pos) OVER (PARTITION BY domain) AS f FROM items), t AS (SELECT *, dense_rank() OVER (PARTITION BY domain ORDER BY du DESC, df, doc) AS turn FROM m) SELECT item_id, row_number() OVER (ORDER BY turn, f, domain, pos) AS rank FROM t")
def domain_doc_interleave(spark, d):
    x = V.document_items(spark, d)
    return L.by_domain_document(x.select("item_id", "pos", "utility"), x).select("item_id", F.col("rank").cast("long").alias("rank"))


@query(DC + f"SELECT item_id FROM items ORDER BY {uniform_sql(3, 'item_id')}, item_id LIMIT 50")
def random_sample(spark, d):
    return L.sample(V.document_items(spark, d), 50, 3).select("item_id")


@query()
def kmeans_select(spark, d):
    return L.kmeans(V.vectors(spark, d), 12, "tgt_avg").select("item_id", "utility")


@query()
def kmeans_supersample(spark, d):
    return L.kmeans_supersample(V.vectors(spark, d), 12, True, "tgt_0").select("item_id", "size", "copy")


@query()
def diffuse_select(spark, d):
    return L.diffuse(V.vectors(spark, d), 12).select("item_id", "utility")


@query()
def bruteforce_greedy(spark, d):
    return L.bruteforce_greedy(V.event_scores(spark, d), 20, 10).select("item_id", "utility")


# ---- meta-evaluation ------------------------------------------------------------------------------------------------


@query(EV + "SELECT system, metric, round(avg(value), 6) AS mean FROM scores GROUP BY 1, 2")
def model_absolute(spark, d):
    scores = V.event_scores(spark, d)
    out = None
    for m in ("m", "human", "n"):
        x = E.model_absolute(scores, m).withColumn("metric", F.lit(m))
        out = x if out is None else out.unionByName(x)
    return r6(out, "mean")


@query(EV + "SELECT system, row_number() OVER (ORDER BY round(avg(value), 9) DESC, system) - 1 AS ord FROM scores WHERE metric = 'm' GROUP BY system")
def model_ordering(spark, d):
    return E.model_ordering(V.event_scores(spark, d), "m").select("system", F.col("ord").cast("long").alias("ord"))


MEANS_SQL = EV + RANKED_SQL + ", means AS (SELECT system, x, y FROM (SELECT system, round(avg(value), 9) AS x FROM new WHERE metric = 'm' GROUP BY system) JOIN (SELECT system, round(avg(value), 9) AS y FROM scores WHERE metric = 'm' GROUP BY system) USING (system)), pairs AS (SELECT a.x AS ax, b.x AS bx, a.y AS ay, b.y AS by_ FROM means a JOIN means b ON a.system < b.system)"


def _means(spark, d, metric="m"):
    new, old = _quarter(spark, d)
    return E.both_means(new, old, metric).withColumns({c: F.round(c, 9) for c in ("x", "y")})


@query(MEANS_SQL + " SELECT round(avg(((ax < bx) = (ay < by_))::INT), 6) AS accuracy FROM pairs")
def pairwise_accuracy(spark, d):
    return r6(E.pairwise_accuracy(_means(spark, d)), "accuracy")


@query(MEANS_SQL + ", r AS (SELECT row_number() OVER (ORDER BY x DESC, system) AS rx, row_number() OVER (ORDER BY y DESC, system) - 1 AS ry, count(*) OVER () AS m FROM means) SELECT round(1 - ry / (m - 1), 6) AS top FROM r WHERE rx = 1")
def top1(spark, d):
    return r6(E.top_match(_means(spark, d)), "top")


TAU_SQL = " SELECT round(CASE WHEN sum(abs(sign(ax - bx))) * sum(abs(sign(ay - by_))) = 0 THEN 0 ELSE sum(sign(ax - bx) * sign(ay - by_)) / sqrt(sum(abs(sign(ax - bx))) * sum(abs(sign(ay - by_)))) END, 6) AS correlation FROM pairs"


@query(MEANS_SQL + TAU_SQL)
def kendall_b(spark, d):
    return r6(E.correlation(_means(spark, d), "kendall"), "correlation")


@query(MEANS_SQL + TAU_SQL)
def flagship(spark, d):
    """Scores, variance ranking, a quarter of the items, tau-b of the system means against all items."""
    return r6(E.correlation(_means(spark, d), "kendall"), "correlation")


@query(MEANS_SQL + ", r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM means) SELECT round(corr(x, y), 6) AS correlation FROM r")
def spearman(spark, d):
    return r6(E.correlation(_means(spark, d), "spearman"), "correlation")


@query(MEANS_SQL + " SELECT round(corr(x, y), 6) AS correlation FROM means")
def pearson(spark, d):
    return r6(E.correlation(_means(spark, d), "pearson"), "correlation")


@query(MEANS_SQL + " SELECT round(avg(abs(x - y)), 6) AS absolute, round(avg((x - y) ** 2), 6) AS squared, round(sqrt(avg((x - y) ** 2)), 6) AS root FROM means")
def prefix_error(spark, d):
    m = _means(spark, d)
    out = None
    for kind in ("absolute", "squared", "root"):
        x = r6(E.error(m, kind), "error").withColumnRenamed("error", kind)
        out = x if out is None else out.crossJoin(x)
    return out


@query(EV + "SELECT a.metric, round(corr(a.value, b.value), 6) AS correlation FROM scores a JOIN scores b ON a.item_id = b.item_id AND a.system = b.system AND b.metric = 'human' GROUP BY a.metric")
def metrics_correlations(spark, d):
    return r6(E.metrics_correlations(V.event_scores(spark, d), "human"), "correlation")


@query(EV + "SELECT a.metric, round(corr(a.value, b.value), 6) AS correlation FROM scores a JOIN scores b ON a.item_id = b.item_id AND a.system = b.system AND b.metric = 'human' WHERE a.metric <> 'human' GROUP BY a.metric ORDER BY 2 DESC, 1 LIMIT 1")
def best_metric(spark, d):
    return r6(E.best_metric(V.event_scores(spark, d), "human"), "correlation")


def wilcoxon_sql(source: str) -> str:
    return f"""ord AS (SELECT system, row_number() OVER (ORDER BY round(avg(value), 9) DESC, system) - 1 AS ord FROM {source} WHERE metric = 'm' GROUP BY system),
walk AS (SELECT system, ord, lag(system) OVER (ORDER BY ord) AS prev FROM ord),
df AS (SELECT w.ord, w.system, round(a.value - b.value, 9) AS d FROM walk w JOIN {source} a ON a.system = w.system AND a.metric = 'm' JOIN {source} b ON b.system = w.prev AND b.item_id = a.item_id AND b.metric = 'm'),
rk AS (SELECT ord, system, d, rank() OVER (PARTITION BY ord ORDER BY abs(d)) + (count(*) OVER (PARTITION BY ord, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ord, abs(d)) AS t FROM df WHERE d <> 0),
z AS (SELECT ord, count(*) AS n, sum(r) FILTER (d > 0) AS w, (coalesce(sum(r) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1.0) * (2 * count(*) + 1) / 24 - sum(t * t - 1.0) / 48) AS z FROM rk GROUP BY ord),
cl AS (SELECT o.ord, o.system, z.n, z.w, z.z, 1 + sum(CASE WHEN o.ord = 0 THEN 0 WHEN z.n IS NULL THEN 1 WHEN z.z < -1.6448536269514722 THEN 1 ELSE 0 END) OVER (ORDER BY o.ord) AS cluster FROM ord o LEFT JOIN z USING (ord))"""


@query(EV + ", " + wilcoxon_sql("scores") + " SELECT ord, n, round(coalesce(w, 0), 4) AS w, round(z, 6) AS z FROM cl WHERE ord > 0")
def wilcoxon_z(spark, d):
    diffs = E.neighbour_differences(V.event_scores(spark, d), "m")
    z = E.wilcoxon_z(diffs, ["ord"])
    return z.select(F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n"), F.round("w", 4).alias("w"), F.round("z", 6).alias("z"))


@query(EV + ", " + wilcoxon_sql("scores") + " SELECT ord, system, cluster::BIGINT AS cluster FROM cl")
def clusters(spark, d):
    return E.clusters(V.event_scores(spark, d), "m").select(F.col("ord").cast("long").alias("ord"), "system", "cluster")


@query(EV + ", " + wilcoxon_sql("scores") + " SELECT max(cluster)::BIGINT AS clusters FROM cl")
def cluster_count(spark, d):
    return E.cluster_count(V.event_scores(spark, d), "m")


@query()
def clusters_exact(spark, d):
    return r6(E.clusters(V.event_scores(spark, d), "m", "auto", equal_splits=False), "p").select("ord", "system", "p", "cluster")


@query(EV + RANKED_SQL + ", a AS (WITH " + wilcoxon_sql("new") + " SELECT system FROM cl WHERE cluster = 1), b AS (WITH " + wilcoxon_sql("scores") + " SELECT system FROM cl WHERE cluster = 1) SELECT round(2.0 * (SELECT count(*) FROM a JOIN b USING (system)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS dice")
def clusters_top_dice(spark, d):
    new, old = _quarter(spark, d)
    return r6(E.clusters_top(new, old, "m"), "dice")


def perm_sql(source: str, name: str, seed: int, n: int = 1000, metric: str = "m") -> str:
    bit = f"(('0x' || substr(md5('{seed}:' || (perm // 128) || ':' || item_id), 1 + (perm % 128) // 32 * 8, 8))::UBIGINT >> (perm % 32)::UBIGINT) & 1"
    return f"""{name}_s AS (SELECT perm, system, round(sum(CASE WHEN {bit} = 1 THEN -value ELSE value END), 6) AS s FROM {source}, (SELECT unnest(range({n})) AS perm) WHERE metric = '{metric}' GROUP BY 1, 2),
{name}_r AS (SELECT system, round(sum(value), 6) AS r FROM {source} WHERE metric = '{metric}' GROUP BY 1),
{name} AS (SELECT a.system AS sys_i, b.system AS sys_j, avg((round(a.s - b.s, 5) >= round(x.r - y.r, 5))::INT) AS p FROM {name}_s a JOIN {name}_s b ON a.perm = b.perm AND a.system < b.system JOIN {name}_r x ON x.system = a.system JOIN {name}_r y ON y.system = b.system GROUP BY 1, 2)"""


@query(EV + ", " + perm_sql("scores", "p", 0) + " SELECT sys_i, sys_j, round(p, 6) AS p FROM p")
def perm_pvalues(spark, d):
    return r6(E.permutation_p(V.event_scores(spark, d), "m"), "p")


@query(EV + RANKED_SQL + ", " + perm_sql("new", "p", 0) + ", " + perm_sql("scores", "q", 1) + " SELECT round(1 - avg(abs(p.p - q.p)), 6) AS spa FROM p JOIN q USING (sys_i, sys_j)")
def spa(spark, d):
    new, old = _quarter(spark, d)
    return r6(E.spa(new, old, "m"), "spa")


CURVE_SQL = EV + RANKED_SQL + """, pm AS (SELECT system, rank AS k, round(avg(value) OVER (PARTITION BY system ORDER BY rank ROWS UNBOUNDED PRECEDING), 9) AS x FROM scores JOIN ranked USING (item_id) WHERE metric = 'm'),
fm AS (SELECT system, round(avg(value), 9) AS y FROM scores WHERE metric = 'm' GROUP BY system), mm AS (SELECT * FROM pm JOIN fm USING (system)),
curve AS (SELECT a.k, CASE WHEN sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))) = 0 THEN 0 ELSE sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) END AS correlation FROM mm a JOIN mm b ON a.k = b.k AND a.system < b.system GROUP BY a.k)
"""


@query(CURVE_SQL + "SELECT k, round(correlation, 6) AS correlation FROM curve")
def clucor_curve(spark, d):
    scores = V.event_scores(spark, d)
    return r6(E.correlation_curve(scores, _ranked(scores), "m"), "correlation").select(F.col("k").cast("long").alias("k"), "correlation")


@query(CURVE_SQL + ", pr AS (SELECT 0.05 + i * 0.05 AS prop FROM (SELECT unnest(range(10))::DOUBLE AS i)), n AS (SELECT count(*) AS n FROM u), hit AS (SELECT prop, min(k) AS k FROM curve, pr WHERE k >= 5 AND correlation >= 0.6 GROUP BY prop) SELECT round(prop, 2) AS prop, coalesce(k, n) AS k, round(coalesce(k, n) / (n * prop), 6) AS parity FROM pr CROSS JOIN n LEFT JOIN hit USING (prop)")
def parity_k(spark, d):
    scores = V.event_scores(spark, d)
    n = scores.select("item_id").distinct().count()
    targets = spark.createDataFrame([(p, 0.6) for p in C.PROPS], "prop double, target double")
    found = E.parity(E.correlation_curve(scores, _ranked(scores), "m"), targets, n)
    return r6(found, "parity").select(F.round("prop", 2).alias("prop"), F.col("k").cast("long").alias("k"), "parity")


SEEDED_SQL = EV + f""", sd AS (SELECT unnest(range(10)) AS seed), it AS (SELECT DISTINCT item_id, pos FROM scores), rk AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY {uniform_sql('seed', 'item_id')} DESC, pos) AS rank FROM it, sd),
pm AS (SELECT seed, system, rank AS k, round(avg(value) OVER (PARTITION BY seed, system ORDER BY rank ROWS UNBOUNDED PRECEDING), 9) AS x FROM scores JOIN rk USING (item_id) WHERE metric = 'm'),
mm AS (SELECT * FROM pm JOIN (SELECT system, round(avg(value), 9) AS y FROM scores WHERE metric = 'm' GROUP BY system) USING (system)),
cs AS (SELECT a.seed, a.k, CASE WHEN sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))) = 0 THEN 0 ELSE sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) END AS c FROM mm a JOIN mm b ON a.seed = b.seed AND a.k = b.k AND a.system < b.system GROUP BY 1, 2)
"""


@query(SEEDED_SQL + "SELECT k, round(avg(c), 6) + 0.0 AS correlation FROM cs GROUP BY k")
def random_norm(spark, d):
    scores = V.event_scores(spark, d)
    return r6(E.random_curve(scores, scores, "m"), "correlation").select(F.col("k").cast("long").alias("k"), "correlation")


BASE_SQL = EV + f""", sd AS (SELECT unnest(range(20)) AS seed), it AS (SELECT DISTINCT item_id, pos FROM scores), n AS (SELECT count(*) AS n FROM it), rk AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY {uniform_sql('seed', 'item_id')} DESC, pos) AS rank FROM it, sd),
pm AS (SELECT seed, system, rank AS k, round(avg(value) OVER (PARTITION BY seed, system ORDER BY rank ROWS UNBOUNDED PRECEDING), 9) AS x FROM scores JOIN rk USING (item_id) WHERE metric = 'm'),
mm AS (SELECT * FROM pm JOIN (SELECT system, round(avg(value), 9) AS y FROM scores WHERE metric = 'm' GROUP BY system) USING (system)),
cs AS (SELECT a.seed, a.k, CASE WHEN sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))) = 0 THEN 0 ELSE sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) END AS c FROM mm a JOIN mm b ON a.seed = b.seed AND a.k = b.k AND a.system < b.system GROUP BY 1, 2),
pr AS (SELECT 0.05 + i * 0.05 AS prop FROM (SELECT unnest(range(10))::DOUBLE AS i)), tg AS (SELECT prop, round(avg(c), 9) AS target FROM cs, pr, n WHERE seed < 10 AND k = floor(n * prop) GROUP BY prop),
hit AS (SELECT seed, prop, min(k) AS k FROM cs, tg WHERE seed >= 10 AND k >= 5 AND round(c, 9) >= target GROUP BY 1, 2),
bl AS (SELECT prop, target, avg(coalesce(k, n) / (n * prop)) AS random_parity FROM tg CROSS JOIN (SELECT seed FROM sd WHERE seed >= 10) CROSS JOIN n LEFT JOIN hit USING (seed, prop) GROUP BY prop, target)
"""


@query(BASE_SQL + "SELECT round(prop, 2) AS prop, round(target, 6) + 0.0 AS target, round(random_parity, 6) AS random_parity FROM bl")
def random_baseline(spark, d):
    found = r6(E.random_baseline(V.event_scores(spark, d), "m"), "target", "random_parity")
    return found.select(F.round("prop", 2).alias("prop"), "target", "random_parity")


@query(BASE_SQL + RANKED_SQL + """, om AS (SELECT system, rank AS k, round(avg(value) OVER (PARTITION BY system ORDER BY rank ROWS UNBOUNDED PRECEDING), 9) AS x FROM scores JOIN ranked USING (item_id) WHERE metric = 'm'),
omm AS (SELECT * FROM om JOIN (SELECT system, round(avg(value), 9) AS y FROM scores WHERE metric = 'm' GROUP BY system) USING (system)),
oc AS (SELECT a.k, CASE WHEN sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))) = 0 THEN 0 ELSE sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) END AS c FROM omm a JOIN omm b ON a.k = b.k AND a.system < b.system GROUP BY 1),
oh AS (SELECT prop, min(k) AS k FROM oc, tg WHERE k >= 5 AND round(c, 9) >= target GROUP BY 1)
SELECT round(prop, 2) AS prop, round(coalesce(k, n) / (n * prop) / random_parity, 6) AS parity FROM bl CROSS JOIN n LEFT JOIN oh USING (prop)""")
def parity_normalized(spark, d):
    scores = V.event_scores(spark, d)
    found = E.parity_normalized(scores, _ranked(scores), E.random_baseline(scores, "m"), "m")
    return r6(found, "parity").select(F.round("prop", 2).alias("prop"), "parity")


def clusters_by_sql(source: str, keys: str, out: str) -> str:
    """clusters in each group of keys; source has keys, item_id, system, value."""
    on = " AND ".join(f"b.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    return f"""{out}_o AS (SELECT {keys}, system, row_number() OVER (PARTITION BY {keys} ORDER BY round(avg(value), 9) DESC, system) - 1 AS ord FROM {source} GROUP BY {keys}, system),
{out}_n AS (SELECT {keys}, count(DISTINCT item_id) >= 3 AS enough FROM {source} GROUP BY {keys}),
{out}_w AS (SELECT *, lag(system) OVER (PARTITION BY {keys} ORDER BY ord) AS prev FROM {out}_o),
{out}_d AS (SELECT {own}, w.ord, round(a.value - b.value, 9) AS d FROM {out}_w w JOIN {source} a ON a.system = w.system AND {on.replace('b.', 'a.')} JOIN {source} b ON b.system = w.prev AND b.item_id = a.item_id AND {on}),
{out}_r AS (SELECT {keys}, ord, d, rank() OVER (PARTITION BY {keys}, ord ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, ord, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {keys}, ord, abs(d)) AS t FROM {out}_d WHERE d <> 0),
{out}_z AS (SELECT {keys}, ord, 1 AS has, (coalesce(sum(r) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(nullif(greatest(count(*) * (count(*) + 1.0) * (2 * count(*) + 1) / 24 - sum(t * t - 1.0) / 48, 0), 0)) AS z FROM {out}_r GROUP BY {keys}, ord),
{out} AS (SELECT {keys}, 1 + sum(CASE WHEN ord = 0 OR NOT enough THEN 0 WHEN has IS NULL THEN 1 WHEN z < -1.6448536269514722 THEN 1 ELSE 0 END)::BIGINT AS clusters FROM {out}_o LEFT JOIN {out}_z USING ({keys}, ord) JOIN {out}_n USING ({keys}) GROUP BY {keys})"""


POINTS_SQL = ", pr AS (SELECT 0.05 + i * 0.05 AS prop FROM (SELECT unnest(range(10))::DOUBLE AS i)), n AS (SELECT count(DISTINCT item_id) AS n FROM scores), pk AS (SELECT prop, floor(n * prop) AS k FROM pr, n)"
PREFIX_SQL = POINTS_SQL + ", ks AS (SELECT unnest(range(5, n + 1)) AS k FROM n), every AS (SELECT k, item_id, system, value FROM scores JOIN ranked USING (item_id) JOIN ks ON rank <= k WHERE metric = 'm'), " + clusters_by_sql("every", "k", "ck")


@query(EV + RANKED_SQL + POINTS_SQL + ", part AS (SELECT prop, item_id, system, value FROM scores JOIN ranked USING (item_id) JOIN pk ON rank <= k WHERE metric = 'm'), " + clusters_by_sql("part", "prop", "cp") + " SELECT round(prop, 2) AS prop, clusters FROM cp")
def cluster_curve(spark, d):
    scores = V.event_scores(spark, d)
    points = E.proportions(spark, scores.select("item_id").distinct().count())
    return E.cluster_curve(scores, _ranked(scores), points, "m").select(F.round("prop", 2).alias("prop"), "clusters")


@query(EV + RANKED_SQL + PREFIX_SQL + ", hit AS (SELECT prop, min(k) AS k FROM ck, pr WHERE clusters >= 2 GROUP BY prop) SELECT round(prop, 2) AS prop, coalesce(k, n) AS k, round(coalesce(k, n) / (n * prop), 6) AS parity FROM pr CROSS JOIN n LEFT JOIN hit USING (prop)")
def cluster_parity(spark, d):
    scores = V.event_scores(spark, d)
    n = scores.select("item_id").distinct().count()
    targets = spark.createDataFrame([(p, 2.0) for p in C.PROPS], "prop double, target double")
    return r6(E.cluster_parity(scores, _ranked(scores), targets, n, "m"), "parity").select(F.round("prop", 2).alias("prop"), "k", "parity")


CLUSTER_BASE_SQL = EV + POINTS_SQL + f""", sd AS (SELECT unnest(range(20)) AS seed), it AS (SELECT DISTINCT item_id, pos FROM scores), rk AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY {uniform_sql('seed', 'item_id')} DESC, pos) AS rank FROM it, sd),
tp AS (SELECT seed, prop, item_id, system, value FROM scores JOIN rk USING (item_id) JOIN pk ON rank <= k WHERE metric = 'm' AND seed < 10), {clusters_by_sql("tp", "seed, prop", "ct")}, tg AS (SELECT prop, round(avg(clusters), 9) AS target FROM ct GROUP BY prop),
sk AS (SELECT unnest(range(5, n + 1)) AS k FROM n), se AS (SELECT seed, k, item_id, system, value FROM scores JOIN rk USING (item_id) JOIN sk ON rank <= k WHERE metric = 'm' AND seed >= 10), {clusters_by_sql("se", "seed, k", "cs")},
hit AS (SELECT seed, prop, min(k) AS k FROM cs, tg WHERE clusters >= target GROUP BY 1, 2),
bl AS (SELECT prop, target, avg(coalesce(k, n) / (n * prop)) AS random_parity FROM tg CROSS JOIN (SELECT seed FROM sd WHERE seed >= 10) CROSS JOIN n LEFT JOIN hit USING (seed, prop) GROUP BY prop, target)
"""


@query(CLUSTER_BASE_SQL + "SELECT round(prop, 2) AS prop, round(target, 6) + 0.0 AS target, round(random_parity, 6) AS random_parity FROM bl")
def random_baseline_clusters(spark, d):
    found = r6(E.random_baseline(V.event_scores(spark, d), "m", "clusters"), "target", "random_parity")
    return found.select(F.round("prop", 2).alias("prop"), "target", "random_parity")


@query(CLUSTER_BASE_SQL + RANKED_SQL + PREFIX_SQL.removeprefix(POINTS_SQL) + ", oh AS (SELECT prop, min(k) AS k FROM ck, tg WHERE clusters >= target GROUP BY 1) SELECT round(prop, 2) AS prop, round(coalesce(k, n) / (n * prop) / random_parity, 6) AS parity FROM bl CROSS JOIN n LEFT JOIN oh USING (prop)")
def parity_normalized_clusters(spark, d):
    scores = V.event_scores(spark, d)
    found = E.parity_normalized(scores, _ranked(scores), E.random_baseline(scores, "m", "clusters"), "m", "clusters")
    return r6(found, "parity").select(F.round("prop", 2).alias("prop"), "parity")


SIGN_SQL = ", sg AS (SELECT perm, item_id, 1 - 2 * (((('0x' || substr(md5('0:' || (perm // 128) || ':' || item_id), 1 + (perm % 128) // 32 * 8, 8))::UBIGINT >> (perm % 32)::UBIGINT) & 1)::INT) AS sg FROM (SELECT DISTINCT item_id FROM scores), (SELECT unnest(range(1000)) AS perm)), "
SIGNS_SQL = SIGN_SQL + perm_sql("scores", "q", 1)


def prefix_spa_sql(ranked: str, out: str, key: str = "", metric: str = "m") -> str:
    """spa of every prefix of the rankings in a table (key, item_id, rank)."""
    k, on, own = (f"{key}, ", f"AND b.{key} = a.{key} ", f"a.{key}, ") if key else ("", "", "")
    same = f"AND {{0}}.{key} = a.{key} " if key else ""
    return f""", {out}_c AS (SELECT {k}perm, system, rank AS k, round(sum(sg * value) OVER (PARTITION BY {k}perm, system ORDER BY rank), 6) AS s FROM scores JOIN {ranked} USING (item_id) JOIN sg USING (item_id) WHERE metric = '{metric}'),
{out}_r AS (SELECT {k}system, rank AS k, round(sum(value) OVER (PARTITION BY {k}system ORDER BY rank), 6) AS r FROM scores JOIN {ranked} USING (item_id) WHERE metric = '{metric}'),
{out}_p AS (SELECT {own}a.k, a.system AS sys_i, b.system AS sys_j, avg((round(a.s - b.s, 5) >= round(x.r - y.r, 5))::INT) AS p FROM {out}_c a JOIN {out}_c b ON a.perm = b.perm AND a.k = b.k {on}AND a.system < b.system JOIN {out}_r x ON x.system = a.system AND x.k = a.k {same.format('x')}JOIN {out}_r y ON y.system = b.system AND y.k = a.k {same.format('y')}GROUP BY {own}a.k, a.system, b.system),
{out} AS (SELECT {k}k, 1 - avg(abs({out}_p.p - q.p)) AS spa FROM {out}_p JOIN q USING (sys_i, sys_j) GROUP BY {k}k)"""


@query(EV + RANKED_SQL + POINTS_SQL + SIGNS_SQL + f""", sd AS (SELECT unnest(range(20)) AS seed), rk AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY {uniform_sql('seed', 'item_id')} DESC, pos) AS rank FROM (SELECT DISTINCT item_id, pos FROM scores), sd)"""
       + prefix_spa_sql("ranked", "own") + prefix_spa_sql("rk", "ev", "seed") + """, tg AS (SELECT prop, round(avg(spa), 9) AS target FROM ev JOIN pk USING (k) WHERE seed < 10 GROUP BY prop),
hit AS (SELECT seed, prop, min(k) AS k FROM ev, tg WHERE seed >= 10 AND k >= 5 AND round(spa, 9) >= target GROUP BY 1, 2),
bl AS (SELECT prop, avg(coalesce(k, n) / (n * prop)) AS random_parity FROM tg CROSS JOIN (SELECT seed FROM sd WHERE seed >= 10) CROSS JOIN n LEFT JOIN hit USING (seed, prop) GROUP BY prop),
oh AS (SELECT prop, min(k) AS k FROM own, tg WHERE k >= 5 AND round(spa, 9) >= target GROUP BY 1)
SELECT round(prop, 2) AS prop, round(coalesce(k, n) / (n * prop) / random_parity, 6) AS parity FROM bl CROSS JOIN n LEFT JOIN oh USING (prop)""")
def parity_normalized_spa(spark, d):
    scores = V.event_scores(spark, d)
    found = E.parity_normalized(scores, _ranked(scores), E.random_baseline(scores, "m", "spa"), "m", "spa")
    return r6(found, "parity").select(F.round("prop", 2).alias("prop"), "parity")


@query(EV + POINTS_SQL + SIGN_SQL + perm_sql("scores", "q", 1, metric="human") + f""", sd AS (SELECT unnest(range(20)) AS seed), rk AS (SELECT seed, item_id, row_number() OVER (PARTITION BY seed ORDER BY {uniform_sql('seed', 'item_id')} DESC, pos) AS rank FROM (SELECT DISTINCT item_id, pos FROM scores), sd),
ut AS (SELECT metric, 'var' AS method, item_id, pos, round(var_pop(value), 9) AS u FROM scores WHERE metric <> 'human' GROUP BY ALL UNION ALL SELECT metric, 'avg', item_id, pos, round(-avg(value), 9) FROM scores WHERE metric <> 'human' GROUP BY ALL),
rm AS (SELECT metric || ':' || method AS grp, item_id, row_number() OVER (PARTITION BY metric, method ORDER BY u DESC, pos) AS rank FROM ut)"""
       + prefix_spa_sql("rm", "own", "grp", "human") + prefix_spa_sql("rk", "ev", "seed", "human") + """, tg AS (SELECT prop, round(avg(spa), 9) AS target FROM ev JOIN pk USING (k) WHERE seed < 10 GROUP BY prop),
hit AS (SELECT seed, prop, min(k) AS k FROM ev, tg WHERE seed >= 10 AND k >= 5 AND round(spa, 9) >= target GROUP BY 1, 2),
bl AS (SELECT prop, avg(coalesce(k, n) / (n * prop)) AS random_parity FROM tg CROSS JOIN (SELECT seed FROM sd WHERE seed >= 10) CROSS JOIN n LEFT JOIN hit USING (seed, prop) GROUP BY prop),
oh AS (SELECT grp, prop, min(k) AS k FROM own, tg WHERE k >= 5 AND round(spa, 9) >= target GROUP BY 1, 2),
gr AS (SELECT DISTINCT metric, method, metric || ':' || method AS grp FROM ut), ql AS (SELECT a.metric, corr(a.value, b.value) AS quality FROM scores a JOIN scores b USING (item_id, system) WHERE b.metric = 'human' GROUP BY a.metric)
SELECT metric, method, round(prop, 2) AS prop, round(quality, 6) AS quality, round(coalesce(k, n) / (n * prop) / random_parity, 6) AS parity FROM gr CROSS JOIN bl CROSS JOIN n JOIN ql USING (metric) LEFT JOIN oh USING (grp, prop)""")
def metric_quality(spark, d):
    methods = {"var": lambda s, m, by: S.metric_var(s, m, by), "avg": lambda s, m, by: S.metric_avg(s, m, by)}
    found = r6(X.metric_quality(V.event_scores(spark, d), methods), "quality", "parity")
    return found.select("metric", "method", F.round("prop", 2).alias("prop"), "quality", "parity")


# The published weights of the quadratic through five neighbours, in units of 1/35.
@query(CURVE_SQL + """, l AS (SELECT list(correlation ORDER BY k) AS c, count(*) AS n FROM curve), w AS (SELECT [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]] AS w),
p AS (SELECT k, greatest(1, least(k - 2, n - 4)) AS s, c, w FROM (SELECT unnest(range(1, n + 1)) AS k, n, c, w FROM l, w))
SELECT k, round(list_sum(list_transform(range(0, 5), lambda i: c[s + i] * w[k - s + 1][i + 1])) / 35, 6) + 0.0 AS correlation, round(c[k], 6) AS raw FROM p""")
def smoothed_curve(spark, d):
    scores = V.event_scores(spark, d)
    curve = E.correlation_curve(scores, _ranked(scores), "m")
    found = X.smoothed(curve, "k", "correlation", 5, 2).select(F.col("k").cast("long").alias("k"), F.col("smooth").alias("correlation"), F.col("correlation").alias("raw"))
    return r6(found, "correlation", "raw")


@query()
def feature_irt(spark, d):
    """Parameters of parts from the words of their names, learnt from the prices of their lines."""
    from siftwell.operators import response as R

    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("src"))
    items, _, _ = R.feature_irt(V.part_scores(spark, d), R.tfidf_vectors(names, 64), "price")
    return r6(items, "diff", "disc", "feas").select("item_id", "diff", "disc", "feas")


@query()
def multidimensional_irt(spark, d):
    return r6(X.multidimensional_irt(V.event_scores(spark, d), "m"), "diff", "disc_sum").select("item_id", "diff", "disc_sum")


@query(EV + RANKED_SQL + POINTS_SQL + SIGNS_SQL + prefix_spa_sql("ranked", "own") + " SELECT round(prop, 2) AS prop, round(spa, 6) AS spa FROM own JOIN pk USING (k)")
def spa_curve(spark, d):
    scores = V.event_scores(spark, d)
    props = E.proportions(spark, scores.select("item_id").distinct().count())
    return r6(E.spa_curve(scores, _ranked(scores), "m", props), "spa").select(F.round("prop", 2).alias("prop"), "spa")


@query(EV + RANKED_SQL + SIGNS_SQL + prefix_spa_sql("ranked", "own") + " SELECT k, round(spa, 6) AS spa FROM own")
def spa_every_prefix(spark, d):
    scores = V.event_scores(spark, d)
    return r6(E.spa_every_prefix(scores, _ranked(scores), "m"), "spa")


@query(CURVE_SQL + "SELECT k, round(avg(abs(x - y)), 6) AS distance FROM mm GROUP BY k")
def convergence(spark, d):
    scores = V.event_scores(spark, d)
    return r6(X.ordering_convergence(scores, _ranked(scores), "m"), "distance").select(F.col("k").cast("long").alias("k"), "distance")


@query()
def confidence_bands(spark, d):
    return r6(E.confidence_bands(V.event_scores(spark, d), ("system", "metric")), "mean", "low", "high")


# ---- experiments ----------------------------------------------------------------------------------------------------


@query(DC + ", b AS (SELECT CASE WHEN utility >= 4000 THEN 3 WHEN utility >= 1500 THEN 2 WHEN utility >= 500 THEN 1 ELSE 0 END AS bin, length(doc) AS y FROM items) SELECT bin, count(*) AS n, round(avg(y), 6) AS mean FROM b GROUP BY bin")
def binned_means(spark, d):
    x = V.document_items(spark, d).select("utility", F.length("doc").alias("y"))
    return r6(X.binned_means(x, "utility", "y", [500.0, 1500.0, 4000.0]), "mean")


@query(COST_SQL + " SELECT domain, round(coalesce(corr(cost, utility), 0), 6) AS correlation FROM c GROUP BY domain")
def cost_correlation(spark, d):
    return r6(X.cost_correlation(_costs(spark, d), ("domain",)), "correlation")


@query(DC + "SELECT domain, count(*) AS n FROM items GROUP BY domain")
def domain_counts(spark, d):
    return V.document_items(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(EV + ", mu AS (SELECT system, avg(value) AS mean FROM scores WHERE metric = 'm' GROUP BY system) SELECT item_id, round(regr_slope(value, mean), 4) AS slope FROM scores JOIN mu USING (system) WHERE metric = 'm' GROUP BY item_id")
def item_lines(spark, d):
    return X.item_lines(V.event_scores(spark, d), "m").select("item_id", F.round("slope", 4).alias("slope"))


@query(EV + ", s AS (SELECT item_id, system, value / 100 AS value FROM scores WHERE metric = 'm') SELECT item_id, system, round(greatest(0, least(1, (avg(value) OVER (PARTITION BY item_id)) + (avg(value) OVER (PARTITION BY system)) - (avg(value) OVER ()))), 6) AS predicted FROM s")
def additive_baseline(spark, d):
    scores = V.event_scores(spark, d).withColumn("value", F.col("value") / 100)
    return r6(X.additive_baseline(scores, "m"), "predicted")


@query(EV + PARAMS_SQL + ", t AS (SELECT unnest([-2.0, -1.0, 0.0, 1.0, 2.0])::DOUBLE AS theta) SELECT t.theta, round(avg(feas + (1 - feas) / (1 + exp(-disc * (t.theta - diff)))), 6) AS expected FROM params, t GROUP BY t.theta")
def characteristic_curve(spark, d):
    items, _ = _params(spark, d)
    return r6(X.characteristic_curve(items, [-2, -1, 0, 1, 2]), "expected")


@query(EV + PARAMS_SQL + ", s AS (SELECT item_id, system, value / 100 AS value FROM scores WHERE metric = 'm') SELECT item_id, round(avg(value), 8) AS mean, round(avg((feas + (1 - feas) / (1 + exp(-disc * (theta - diff))) - value) ** 2), 6) AS loss FROM s JOIN params USING (item_id) JOIN models USING (system) GROUP BY item_id HAVING avg(value) > 0.05 AND avg(value) < 0.8")
def irt_item_error(spark, d):
    items, models = _params(spark, d)
    scores = V.event_scores(spark, d).withColumn("value", F.col("value") / 100)
    found = r6(X.irt_item_error(scores, items, models, "m", 0.05), "loss")
    return found.select("item_id", F.round("mean", 8).alias("mean"), "loss")  # means of five values of eight digits have nine: at six, some lie between two


@query(EV + PARAMS_SQL + ", mu AS (SELECT system, avg(value) AS y FROM scores WHERE metric = 'm' GROUP BY system), t AS (SELECT system, theta AS x, y FROM models JOIN mu USING (system)) SELECT round(avg(((a.x < b.x) = (a.y < b.y))::INT), 6) AS accuracy FROM t a JOIN t b ON a.system < b.system")
def theta_accuracy(spark, d):
    _, models = _params(spark, d)
    return r6(X.theta_accuracy(models, V.event_scores(spark, d), "m"), "accuracy")


@query(EV + ", c AS (SELECT system AS dataset, a.metric, round(corr(a.value, b.value), 9) AS correlation FROM scores a JOIN scores b USING (item_id, system) WHERE b.metric = 'human' GROUP BY 1, 2) SELECT metric, round(avg(correlation), 6) AS correlation FROM c GROUP BY metric")
def mean_correlations(spark, d):
    scores = V.event_scores(spark, d).withColumn("dataset", F.col("system"))
    return r6(X.mean_correlations(E.metrics_correlations(scores, "human", ("dataset",))), "correlation")


RESULTS_SQL = EV + ", r AS (SELECT item_id % 20 AS dataset, metric AS method, round(avg(value) / 7.3, 3) AS value FROM scores GROUP BY 1, 2)"


@query(RESULTS_SQL + ", b AS (SELECT dataset, method AS best FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, method) AS rn FROM r) WHERE rn = 1) SELECT dataset, max(value) FILTER (method = 'm') AS m, max(value) FILTER (method = 'human') AS human, max(value) FILTER (method = 'n') AS n, best FROM r JOIN b USING (dataset) GROUP BY dataset, best")
def results_table(spark, d):
    r = V.event_scores(spark, d).groupBy(F.pmod("item_id", F.lit(20)).alias("dataset"), F.col("metric").alias("method")).agg((F.avg("value") / 7.3).alias("value"))
    return X.results_table(r, ["m", "human", "n"])


@query(EV + ", r AS (SELECT item_id % 20 AS prop, CASE metric WHEN 'n' THEN 'random' ELSE metric END AS method, round(avg(value), 6) AS value FROM scores GROUP BY 1, 2) SELECT a.method, a.prop, round(a.value - b.value, 6) AS gain FROM r a JOIN r b ON a.prop = b.prop AND b.method = 'random' WHERE a.method <> 'random'")
def expected_improvement(spark, d):
    r = V.event_scores(spark, d).groupBy(F.pmod("item_id", F.lit(20)).alias("prop"), F.when(F.col("metric") == "n", "random").otherwise(F.col("metric")).alias("method")).agg(F.round(F.avg("value"), 6).alias("value"))
    return r6(X.expected_improvement(r), "gain")


@query(EV + ", r AS (SELECT item_id % 7 AS prop, metric AS method, system, avg(value) AS value FROM scores GROUP BY 1, 2, 3) SELECT method, prop, round(avg(value), 6) AS value FROM r GROUP BY 1, 2")
def average_curves(spark, d):
    r = V.event_scores(spark, d).groupBy(F.pmod("item_id", F.lit(7)).alias("prop"), F.col("metric").alias("method"), "system").agg(F.avg("value").alias("value"))
    return r6(X.average_curves(r, "value"), "value")


@query(EV + PARAMS_SQL + " SELECT item_id, round(avg(diff + run), 6) AS diff, round(avg(disc * run), 6) AS disc, round(avg(feas), 6) AS feas FROM params, (SELECT unnest(range(5)) AS run) GROUP BY item_id")
def average_parameters(spark, d):
    items, _ = _params(spark, d)
    runs = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")).withColumns({"diff": F.col("diff") + F.col("run"), "disc": F.col("disc") * F.col("run")})
    return r6(X.average_parameters(runs), "diff", "disc", "feas").select("item_id", "diff", "disc", "feas")


@query()
def ordering_distance_selection(spark, d):
    return X.ordering_distance_selection(V.event_scores(spark, d), 25, "m")


@query()
def active_learning(spark, d):
    return r6(X.active_learning(V.event_scores(spark, d), 15, "m"), "tau")


@query()
def holdout_error(spark, d):
    scores = V.event_scores(spark, d).withColumn("value", F.when(F.col("metric") == "m", F.col("value") / 100).otherwise(F.col("value")))
    return r6(X.holdout_error(scores, lambda s: S.irt_fit(s, "m", "4pl", binarize=False), "m"), "mae", "correlation")


# ---- sources and sinks ----------------------------------------------------------------------------------------------


def _wire(spark, d):
    """The events as nested items."""
    from siftwell.sources import items as I

    scores = V.event_scores(spark, d).withColumn("dataset", F.lit("x")).withColumn("item_id", F.col("item_id").cast("string"))
    none = F.lit(None).cast("string")
    rows = scores.select("dataset", "item_id", "pos").distinct().select("*", none.alias("src"), none.alias("ref"), none.alias("doc"), none.alias("domain"), F.lit(None).cast("double").alias("cost"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("tgt"))
    return I.to_wire({"items": rows, "scores": scores})


@query(EV + "SELECT item_id::VARCHAR AS item_id, system, metric, value FROM scores")
def nested_round_trip(spark, d):
    from siftwell.sources import items as I

    return I.to_long(_wire(spark, d).drop("dataset"), "x")["scores"].select("item_id", "system", "metric", "value")


@query(EV + "SELECT dense_rank() OVER (ORDER BY item_id) - 1 AS pos, item_id::VARCHAR AS item_id, system, metric, value FROM scores")
def jsonl_round_trip(spark, d):
    """Written as JSON lines in order, read back with the lines' numbers as positions."""
    from siftwell.sources import items as I

    path = V.scratch(spark, "jsonl")
    I.write_jsonl(_wire(spark, d), path, "pos")
    return I.load_data(spark, path)["scores"].select("pos", "item_id", "system", "metric", "value")


@query(EV + "SELECT 'user ' || item_id AS src, avg(value) AS score FROM scores WHERE metric = 'n' GROUP BY item_id")
def training_csv(spark, d):
    from siftwell.sources import items as I

    scores, path = V.event_scores(spark, d), V.scratch(spark, "csv")
    utility = S.metric_avg(scores, "n").withColumn("utility", -F.col("utility"))
    I.write_training_csv(utility, scores.select("item_id", "pos", F.concat(F.lit("user "), "item_id").alias("src")).distinct(), path)
    return spark.read.option("header", True).schema("src string, score double").csv(path).select("src", F.abs("score").alias("score"))


@query(EV + "SELECT item_id, system, metric, value FROM scores")
def cached_table(spark, d):
    """Made once, then read from the cache: the second maker would give nothing."""
    from siftwell.sources import items as I

    folder, scores = V.scratch(spark, "cache"), V.event_scores(spark, d).select("item_id", "system", "metric", "value")
    I.cached(spark, folder, {"data": "events"}, "1", lambda: scores)
    return I.cached(spark, folder, {"data": "events"}, "1", lambda: scores.limit(0))


@query(PT + "SELECT item_id, system, metric, value FROM scores")
def registered_reader(spark, d):
    from siftwell.sources import items as I

    I.register_reader("parts", lambda session, root, **options: {"scores": V.part_scores(session, root)})
    return I.load_data(spark, "parts", d)["scores"].select("item_id", "system", "metric", "value")


@query("SELECT dense_rank() OVER (ORDER BY s_name) - 1 AS pos, s_name AS src, s_nationkey::VARCHAR AS system, round((s_acctbal + s_suppkey) / 2, 6) AS value FROM supplier")
def rating_csv(spark, d):
    from siftwell.sources import items as I

    path = V.scratch(spark, "ratings")
    V.table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("system"), F.col("s_suppkey").cast("string").alias("output"), F.col("s_acctbal").alias("first"), F.col("s_suppkey").alias("second")).write.option("header", True).csv(path)
    found = I.read_rating_csv(spark, path, "source", "output", "system", ["first", "second"])
    return r6(found["scores"].join(found["items"].select("item_id", "src"), "item_id"), "value").select("pos", "src", "system", "value")


@query(EV + "SELECT item_id::VARCHAR AS item_id, system, metric, value FROM scores")
def item_source(spark, d):
    """Nested items in JSON lines, read by a source with a task for each file."""
    from siftwell.sources import pluggable

    path = V.scratch(spark, "items")
    _wire(spark, d).select("i", "scores").repartition(4).write.json(path)
    pluggable.register_json_items(spark)
    return spark.read.format("siftwell_items").option("path", path).option("suffix", ".json").load()


# ---- collections: the tables in the files of each collection, then read back ---------------------------------------


@query("""WITH x AS (SELECT p_partkey, p_name AS src, p_type AS ref, p_brand AS doc, l_returnflag AS system, 100.0 - count(*) FILTER (l_linenumber = 1) - 5 * count(*) FILTER (l_linenumber = 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT src, ref, doc, system, round(avg(value), 6) AS value FROM x GROUP BY ALL""")
def read_biomqm(spark, d):
    from siftwell.sources import items as I

    path = V.scratch(spark, "biomqm")
    lines = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    severity = F.when(F.col("l_linenumber") == 1, "Minor").when(F.col("l_linenumber") == 2, "MAJOR").otherwise("critical")
    rows = lines.groupBy("p_partkey", F.col("p_name").alias("src"), F.array("p_type").alias("ref"), F.col("p_brand").alias("doc_id"), F.col("l_returnflag").alias("system")).agg(F.collect_list(F.struct(severity.alias("severity"))).alias("errors_tgt"))
    rows.withColumns({"lang_src": F.lit("en"), "lang_tgt": F.lit("de"), "tgt": F.lit("t")}).drop("p_partkey").write.json(path)
    t = I.load_data(spark, "biomqm", path)
    return r6(t["scores"].join(t["items"].select("item_id", "src", "ref", "doc"), "item_id"), "value").select("src", "ref", "doc", "system", "value")


@query(EV + """, w AS (SELECT item_id::VARCHAR AS item_id, system, max(value) FILTER (metric = 'm') AS m, max(value) FILTER (metric = 'human') AS h, max(value) FILTER (metric = 'n') AS n FROM scores GROUP BY ALL), e AS (SELECT item_id, system, (floor(m) + floor(h)) / 2 AS a, n AS b FROM w)
SELECT item_id, system, metric, round(value, 6) AS value FROM (SELECT item_id, system, 'coverage' AS metric, m AS value FROM w UNION ALL SELECT item_id, system, 'supert', h FROM w UNION ALL SELECT item_id, system, 'rouge_1', n FROM w
UNION ALL SELECT item_id, system, 'human_a', a FROM e UNION ALL SELECT item_id, system, 'human_b', b FROM e UNION ALL SELECT item_id, system, 'human_sum', a + b FROM e UNION ALL SELECT item_id, system, 'human_mul', a * b FROM e)""")
def read_summeval(spark, d):
    from siftwell.sources import items as I

    path = V.scratch(spark, "summeval")
    w = V.event_scores(spark, d).groupBy("item_id", "system").pivot("metric", ["m", "human", "n"]).agg(F.max("value"))
    scores = F.struct(F.col("m").alias("coverage"), F.array("human").alias("supert"), F.struct(F.col("n").alias("rouge_1")).alias("rouge"))
    experts = F.array(*[F.struct(F.floor(c).cast("double").alias("a"), F.col("n").alias("b")) for c in ("m", "human")])
    w.select(F.col("item_id").cast("string").alias("id"), F.lit("t").alias("text"), F.col("system").alias("model_id"), F.lit("s").alias("decoded"), scores.alias("metric_scores_1"), experts.alias("expert_annotations")).write.json(path)
    return r6(I.load_data(spark, "summeval", path, normalize_scores=False)["scores"], "value").select("item_id", "system", "metric", "value")


@query(EV + "SELECT 'user ' || item_id AS src, system, value FROM scores WHERE metric = 'm'")
def read_rose(spark, d):
    from siftwell.sources import items as I

    path = V.scratch(spark, "rose")
    own = V.event_scores(spark, d).where("metric = 'm'")
    maps = own.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("system", F.lit("x")))).alias("system_outputs"), F.map_from_entries(F.collect_list(F.struct("system", F.struct(F.col("value").alias("normalized_acu"))))).alias("annotations"))
    maps.select(F.concat(F.lit("user "), "item_id").alias("source"), F.lit("r").alias("reference"), "system_outputs", "annotations").coalesce(1).write.json(path)
    t = I.load_data(spark, "rose", path)
    return t["items"].select("pos", "src").join(t["scores"], "pos").select("src", "system", "value")


@query(EV + "SELECT 'doc' || item_id AS doc, system, value FROM scores WHERE metric = 'm'")
def read_iwslt(spark, d):
    from siftwell.sources import items as I

    meta, data = V.scratch(spark, "iwslt"), V.scratch(spark, "iwslt")
    own = V.event_scores(spark, d).where("metric = 'm'").withColumn("id", F.concat_ws("-", "item_id", "system"))
    own.select("id", F.concat("system", F.lit(".x.doc"), "item_id", F.lit(".seg_"), "item_id", F.lit(".end")).alias("meta")).write.json(meta)
    own.select("id", F.lit("s").alias("source"), F.lit("t").alias("target"), F.array(F.struct(F.col("value").alias("quality_rating"))).alias("annotations")).write.json(data)
    t = I.read_iwslt(spark, meta, data, "en-ar")
    return t["scores"].join(t["items"].select("item_id", "doc"), "item_id").select("doc", "system", "value")


@query("""SELECT o_orderkey::VARCHAR AS doc, 't' || l_linenumber AS system, 'mqm' AS metric, (100 - CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 5 ELSE 26 END)::DOUBLE AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey::VARCHAR, 't' || l_linenumber, 'time', coalesce(l_quantity::DOUBLE, 0) FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def read_qe4pe(spark, d):
    from siftwell.sources import items as I

    found = {"A": "[{'severity': 'Minor'}]", "N": '[{"severity": "major"}]', "R": "[{'severity': 'Minor'}, {'severity': 'Critical'}]"}
    errors = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[F.col("l_returnflag")]
    rows = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("\ufb01ne ").alias("src_text"), F.lit("m").alias("mt_text"), F.lit("p").alias("pe_text"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("segment_in_doc_id"), F.col("o_orderpriority").alias("wmt_category"),
        F.lit("eng").alias("src_lang"), F.lit("ita").alias("tgt_lang"), F.concat(F.lit("t"), "l_linenumber").alias("translator_main_id"), errors.alias("mqm"), F.col("l_quantity").cast("string").alias("time"),
    )
    t = I.read_qe4pe(spark, rows, ["mqm"], ["time"])
    return t["scores"].join(t["items"].where("src = 'fine'").select("item_id", "doc"), "item_id").select("doc", "system", "metric", "value")


WMT_SQL = EV + """, w AS (SELECT dense_rank() OVER (ORDER BY item_id) - 1 AS pos, system, metric, CASE metric WHEN 'human' THEN least(100, greatest(0, value)) ELSE value END AS value FROM scores WHERE metric IN ('m', 'human'))"""


def _wmt_folder(spark, d) -> str:
    """The events as a shared task's folder: files of lines, one for each system and metric."""
    root = V.scratch(spark, "wmt")
    base, langs = f"{root}/wmt23", "en-de"
    scores = V.event_scores(spark, d)
    users = scores.select("item_id").distinct()

    def lines(df: DataFrame, path: str, *order: str) -> None:
        df.coalesce(1).sortWithinPartitions(*order).select("value").write.text(f"{base}/{path}")

    lines(users.select("item_id", F.concat(F.lit("user "), "item_id").alias("value")), f"sources/{langs}.txt", "item_id")
    lines(users.select("item_id", F.lit("reference").alias("value")), f"references/{langs}.refA.txt", "item_id")
    lines(users.select("item_id", F.concat(F.lit("news\tdoc"), F.pmod("item_id", F.lit(3))).alias("value")), f"documents/{langs}.docs", "item_id")
    for system in sorted(r["system"] for r in scores.select("system").distinct().collect()):  # systems are few
        lines(users.select("item_id", F.concat(F.lit(f"{system} "), "item_id").alias("value")), f"system-outputs/{langs}/{system}.txt", "item_id")
    for metric, path in (("human", f"human-scores/{langs}.mqm.seg.score"), ("m", f"metric-scores/{langs}/m-refA.seg.score")):
        lines(scores.where(F.col("metric") == metric).select("system", "item_id", F.concat_ws("\t", "system", F.col("value").cast("string")).alias("value")), path, "system", "item_id")
    return root


@query(WMT_SQL + " SELECT 'wmt23/en-de' AS dataset, pos, system, metric, round(value, 6) AS value FROM w")
def read_wmt(spark, d):
    from siftwell.sources import items as I

    found = I.load_data(spark, "wmt23/en-de", _wmt_folder(spark, d))
    return r6(found["scores"], "value").select("dataset", "pos", "system", "metric", "value")


@query(WMT_SQL + " SELECT 'wmt23/en-de' AS dataset, metric, count(*) AS n FROM w GROUP BY metric")
def read_wmt_test(spark, d):
    """The pairs of the fixed test list that are there, and all pairs below a folder."""
    from siftwell.sources import items as I

    root = _wmt_folder(spark, d)
    found, every = I.read_wmt_test(spark, root), I.load_data(spark, "wmt/all", root, min_items=1)
    assert list(found) == list(every)
    return found["wmt23", "en-de"]["scores"].groupBy("dataset", "metric").agg(F.count(F.lit(1)).alias("n"))
