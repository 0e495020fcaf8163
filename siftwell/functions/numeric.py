"""Small numerical routines without a library: distributions, rank statistics, text similarity."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

#: z below which a one-sided normal p is below 0.05.
CRITICAL_Z = -1.6448536269514722


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def student_cdf(t: float, df: float) -> float:
    half = 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - half if t > 0 else half


def student_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def confidence_interval(x: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Student interval around the mean whose scale is the population deviation, not the standard error."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return math.nan, math.nan
    h = student_quantile(0.5 + confidence / 2, len(x) - 1) * x.std()
    return x.mean() - h, x.mean() + h


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ascending ranks from 1, ties share their mean rank."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def wilcoxon_less(d: np.ndarray, mode: str = "auto") -> float:
    """p-value that the differences lie below zero. mode: exact, normal, auto (exact for up to 50 differences without ties and zeros)."""
    d = np.asarray(d, float)
    had_zero = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    size = np.abs(d)
    ranks = average_ranks(size)
    w = ranks[d > 0].sum()
    ties = np.unique(size, return_counts=True)[1]
    if mode == "exact" or (mode == "auto" and n <= 50 and not had_zero and ties.max() == 1):
        doubled = np.rint(2 * ranks).astype(int)  # tied ranks are halves
        ways = np.zeros(doubled.sum() + 1)
        ways[0] = 1
        for r in doubled:
            ways[r:] = ways[r:] + ways[:-r]
        return float(ways[: int(round(2 * w)) + 1].sum() / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return normal_cdf((w - n * (n + 1) / 4) / math.sqrt(var))


def kendall(x: np.ndarray, y: np.ndarray, variant: str = "b") -> float:
    """Kendall's tau-b or tau-c; 0 if a side is constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    i, j = np.triu_indices(n, 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    s = float((a * b).sum())
    if variant == "c":
        m = min(len(np.unique(x)), len(np.unique(y)))
        return 0.0 if m < 2 else 2 * s * m / (n * n * (m - 1))
    under = math.sqrt(float((a != 0).sum()) * float((b != 0).sum()))
    return s / under if under else 0.0


TOKENS_13A = [
    (re.compile(r"<skipped>"), ""), (re.compile(r"-\n"), ""), (re.compile(r"\n"), " "),
    (re.compile(r"&quot;"), '"'), (re.compile(r"&amp;"), "&"), (re.compile(r"&lt;"), "<"), (re.compile(r"&gt;"), ">"),
]
SPLIT_13A = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def tokens_13a(text: str) -> list[str]:
    """The international machine-translation evaluation's tokenisation, version 13a."""
    for a, b in TOKENS_13A:
        text = a.sub(b, text)
    text = f" {text} "
    for a, b in SPLIT_13A:
        text = a.sub(b, text)
    return text.split()


def ngrams(tokens: list[str] | str, n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu_grams(text: str) -> tuple[int, list[Counter]]:
    t = tokens_13a(text)
    return len(t), [ngrams(t, n) for n in range(1, 5)]


def sentence_bleu(hyp: tuple[int, list[Counter]], ref: tuple[int, list[Counter]]) -> float:
    """BLEU of one pair (0 to 100), exponential smoothing, effective order."""
    logs, halves = [], 1.0
    matched = False
    for n in range(4):
        total = max(0, hyp[0] - n)
        if not total:
            break
        match = sum((hyp[1][n] & ref[1][n]).values())
        if match:
            matched = True
            logs.append(math.log(match / total))
        else:
            halves *= 2
            logs.append(math.log(1 / (halves * total)))
    if not logs or not matched:
        return 0.0
    brevity = min(0.0, 1 - ref[0] / hyp[0]) if hyp[0] else 0.0
    return 100 * math.exp(brevity + sum(logs) / len(logs))


def chrf_grams(text: str, order: int = 6) -> list[Counter]:
    t = "".join(text.split())
    return [ngrams(t, n) for n in range(1, order + 1)]


def chrf(hyp: list[Counter], ref: list[Counter], beta: float = 2.0) -> float:
    """Character n-gram F score of one pair (0 to 100)."""
    precision = recall = 0.0
    orders = 0
    for h, r in zip(hyp, ref, strict=True):
        a, b = sum(h.values()), sum(r.values())
        if a and b:
            match = sum((h & r).values())
            precision, recall, orders = precision + match / a, recall + match / b, orders + 1
    if not orders or not precision + recall:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r)


def knapsack(utility: np.ndarray, cost: np.ndarray, budget: float, scale: int = 1000) -> list[int]:
    """Positions that maximise utility within the budget, exact on the real costs at every size; scale has no effect.

    Items come by density. States that another one beats in cost and utility go, as do those whose fractional bound
    is not above the best whole completion so far. Sums that differ by rounding errors (1e-12) count as equal.
    """
    utility, cost = np.asarray(utility, float), np.asarray(cost, float)
    most = budget + 1e-12 * abs(budget)
    able = np.flatnonzero((utility > 0) & (cost <= most))
    density = utility[able] / np.maximum(cost[able], 1e-300)
    able = able[np.argsort(-density, kind="stable")]
    u, c = utility[able], cost[able]
    n = len(able)
    us, cs = np.concatenate([[0.0], np.cumsum(u)]), np.concatenate([[0.0], np.cumsum(c)])
    density = np.append(u / np.maximum(c, 1e-300), 0.0)
    spent, gain, node = np.zeros(1), np.zeros(1), np.full(1, -1)
    nodes: list[tuple[int, np.ndarray, int]] = []  # item, parents, id of the first
    made, best, found = 0, 0.0, (-1, 0, 0)
    for i in range(n + 1):
        left = most - spent
        to = np.maximum(np.searchsorted(cs, cs[i] + left, side="right") - 1, i)
        whole = gain + us[to] - us[i]
        k = int(np.argmax(whole))
        if whole[k] > best:
            best, found = float(whole[k]), (int(node[k]), i, int(to[k]))
        open_ = whole + np.maximum(left - (cs[to] - cs[i]), 0) * density[to] > best + 1e-12 * max(1.0, best)
        spent, gain, node = spent[open_], gain[open_], node[open_]
        if i == n or not len(spent):
            break
        fits = spent + c[i] <= most
        parents = node[fits]
        nodes.append((i, parents, made))
        more = np.arange(made, made + len(parents))
        made += len(parents)
        spent, gain, node = np.concatenate([spent, spent[fits] + c[i]]), np.concatenate([gain, gain[fits] + u[i]]), np.concatenate([node, more])
        order = np.lexsort((-gain, spent))
        spent, gain, node = spent[order], gain[order], node[order]
        before = np.concatenate([[-np.inf], np.maximum.accumulate(gain)[:-1]])
        kept = gain > before + 1e-12
        spent, gain, node = spent[kept], gain[kept], node[kept]
    at, start, end = found
    out = list(range(start, end))
    for i, parents, first in reversed(nodes):
        if at >= first:
            out.append(i)
            at = int(parents[at - first])
    return sorted(able[out].tolist())


def ward(x: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of the first level of Ward linkage with at most so many clusters.

    Chains of nearest neighbours: from a cluster to its nearest, on to that one's nearest, until two are nearest to each other and merge (equal distances go by the
    lowest index, and back along the chain first). Only the centres and sizes are held, so memory is linear in the items. The merges of the least heights are then applied.
    """
    n = len(x)
    centre, size, alive = np.array(x, float), np.ones(n), np.ones(n, bool)
    square = (centre * centre).sum(1)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            tip = chain[-1]
            gap = np.maximum(square + square[tip] - 2 * (centre @ centre[tip]), 0.0)
            height = np.where(alive, 2 * size * size[tip] / (size + size[tip]) * gap, np.inf)
            height[tip] = np.inf
            nearest = int(np.argmin(height))
            if len(chain) > 1 and height[chain[-2]] <= height[nearest] * (1 + 1e-12) + 1e-300:
                break
            chain.append(nearest)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((float(height[i if tip == j else j]), i, j))
        total = size[i] + size[j]
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / total
        square[i], size[i], alive[j] = (centre[i] ** 2).sum(), total, False
    label = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - max(1, clusters))]:
        while label[i] != i:
            i = label[i]
        while label[j] != j:
            j = label[j]
        label[max(i, j)] = min(i, j)
    for k in range(n):
        label[k] = label[label[k]]
    return np.unique(label, return_inverse=True)[1]


def earlier_counts(code: np.ndarray, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each weighting and each place: the weight of the earlier places with a smaller code, and with a code at most as large.

    The levels of an order-statistics tree, one at a time and for all places at once: on each, the right half of every block looks up its left half.
    """
    n = len(code)
    out = [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for _ in weights]
    span, at, half = int(code.max(initial=0)) + 1, np.arange(n), 1
    while half < n:
        block, right = at // (2 * half), (at // half) % 2 == 1
        key = block * span + code
        order = np.argsort(key, kind="stable")
        keys = key[order]
        first, less, equal = (np.searchsorted(keys, x, side) for x, side in ((block[right] * span, "left"), (key[right], "left"), (key[right], "right")))
        for weight, (below, up_to) in zip(weights, out, strict=True):
            total = np.concatenate([[0], np.cumsum(np.where(right, 0, weight)[order])])
            below[right] += total[less] - total[first]
            up_to[right] += total[equal] - total[first]
        half *= 2
    return out


def running_signed_ranks(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n (differences that are not zero) and z of the signed-rank test on every prefix of d, normal form with tie correction. NaNs count as no difference; z is NaN where it has no spread."""
    size, use = np.abs(d), ~np.isnan(d) & (d != 0)
    n, positive = use.astype(np.int64), (use & (d > 0)).astype(np.int64)
    code = np.unique(np.where(use, size, -1.0), return_inverse=True)[1]
    (less, up_to), (less_positive, up_to_positive) = earlier_counts(code, [n, positive])
    tied, seen = up_to - less, np.cumsum(positive) - positive
    # a new difference lifts the larger ones by a rank and its equals by half a rank, and has a rank itself
    gain = (seen - up_to_positive) + (up_to_positive - less_positive) / 2 + positive * (less + tied / 2 + 1)
    w, ties, n = np.cumsum(use * gain), np.cumsum(use * 3 * tied * (tied + 1)), np.cumsum(n)
    size = n.astype(float)
    spread = size * (size + 1) * (2 * size + 1) / 24 - ties / 48
    return n, np.divide(w - size * (size + 1) / 4, np.sqrt(np.maximum(spread, 0)), out=np.full(len(d), np.nan), where=spread > 0)
