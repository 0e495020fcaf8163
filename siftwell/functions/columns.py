"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Proportions of the data at which a selection is judged: 0.05 to 0.5 in ten steps.
PROPS = [0.05 + i * 0.05 for i in range(10)]
#: Penalties of error severities.
SEVERITY_WEIGHTS = {"neutral": 0, "minor": -1, "major": -5, "critical": -25}
#: Languages that are counted in characters, not words.
UNSPACED = ("ja", "zh", "ko", "th")
#: Seconds per unit of text, and per item.
COST_SLOPE, COST_BASE = 0.15, 33.7


def uniform(seed: Column | int, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone, not on partitions or the engine."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat_ws(":", seed.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sign(seed: Column | int, key: Column) -> Column:
    """+1 or -1, by the same generator."""
    return F.when(uniform(seed, key) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


def words(text: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def annotation_cost(text: Column, langs: Column) -> Column:
    """Expected seconds to judge a text; characters count if the language pair names an unspaced language."""
    unspaced = F.lit(False)
    for code in UNSPACED:
        unspaced = unspaced | langs.contains(code)
    size = F.when(unspaced, F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))).otherwise(F.size(words(text)))
    return COST_SLOPE * size + COST_BASE


def severities(errors: Column, field: str = "severity") -> Column:
    """Lower-cased severities of an array of error structs or maps; a missing one is empty."""
    return F.transform(errors, lambda e: F.lower(F.coalesce(e[field], F.lit(""))))


def mqm_score(found: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of the weights of an array of severities; unknown ones weigh nothing."""
    table = F.create_map(*[F.lit(x) for k, v in (weights or SEVERITY_WEIGHTS).items() for x in (k, float(v))])
    return F.aggregate(found, F.lit(0.0), lambda total, s: total + F.coalesce(F.try_element_at(table, s), F.lit(0.0)))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def irt_prediction(theta: Column, diff: Column, disc: Column | None = None, feas: Column | None = None, legacy: bool = False) -> Column:
    """Expected score of a system of ability theta. legacy: the one-parameter form with its sign turned round."""
    if disc is None:
        return logistic(diff - theta) if legacy else logistic(theta - diff)
    base = logistic(disc * (theta - diff))
    return base if feas is None else feas + (1.0 - feas) * base


def irt_ceiling(theta: Column, diff: Column, disc: Column, feas: Column) -> Column:
    """The variant in which feas is the upper limit."""
    return feas * logistic(disc * (theta - diff))


def irt_information(theta: Column, diff: Column, disc: Column) -> Column:
    """Information of an item about a system: a squared times p times one minus p, with p at disc * (theta + diff)."""
    p = logistic(disc * (theta + diff))
    return disc * disc * p * (1.0 - p)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def plain_text(text: Column, most_words: int = 60) -> Column:
    """Whether a text is short and free of links and markup."""
    return ~text.contains("http") & ~text.contains("<div") & (F.size(words(text)) < most_words)


#: The rules of the international evaluations' tokenisation, version 13a, in their order.
RULES_13A = [
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("^(.*)$", " $1 "),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
]


def tokens_13a(text: Column) -> Column:
    for pattern, by in RULES_13A:
        text = F.regexp_replace(text, pattern, by)
    return words(text)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
