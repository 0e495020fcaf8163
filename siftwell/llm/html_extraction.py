"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags. A classifier gives the log odds that a block is
content, from its words, full stops and share of links, from what its ancestors' tags and class, id and role words
say, and from the tag and word names themselves. Inside an article such a tag or word is no verdict but a doubt, one feature of bounded weight among the others. The odds, bounded by ``MOST_ODDS``, become the capacities of the
block's edges to the two terminals. Blocks that follow each other and blocks whose tag paths share an ancestor are
joined by smoothness edges, weaker ones where a doubt begins or ends. The maximum flow from the content terminal to the boilerplate terminal gives the cheapest
labelling; the text of the content blocks is the result.

The classifier is a logistic regression, fitted from a prior that holds the general knowledge (``PRIOR``) to blocks
of at most ``TRAIN_PAGES`` pages that mark their article themselves: first those of at most ``PAGE_CHARS`` characters (by hash of the id), then longer ones, the
shortest first, together at most ``TRAIN_CHARS`` characters (but for the first). Each block counts twice, once without what its article and its markup say, so that the weights also serve
pages without such marks; blocks in doubt teach nothing. Every page is labelled, whole. Without such pages the prior alone decides.

Whatever can never be text (scripts, styles, markup, forms, comments) is dropped while cutting. Tags are found in one pass: a quote counts only where
a value begins, and once a page has left a quote open, its tags end at the next ``>``. A ``<`` that no ``>`` follows is text.

Defined cases: a null or empty page gives an empty text; unclosed and stray tags are closed by the nearest fitting
ancestor; white space (including that from character references) becomes one space; a block knows the ``MOST_PATH`` nearest of its open elements and the names of the
first ``MOST_NAMES``, so that no nesting is too deep; blocks whose capacities tie stay boilerplate; repeated rows are extracted alike, each on its own; very long pages are read whole;
columns other than the id, the url and the html are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import small_batches, table

#: Elements that hold no text of the page.
SILENT = frozenset("script style template head iframe form select textarea button datalist".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input ruby rb rt rp".split())
#: Elements that name themselves boilerplate or content.
BOILERPLATE = frozenset("nav header footer aside menu dialog".split())
CONTENT = frozenset("article main".split())
#: Words of class, id and role that name boilerplate.
BAD_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|widget|related|share|sharing|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|login|search|comments?|commentlist|reply|replies|disqus|respond|pagination|pager|complementary|contentinfo|skip|hidden)(?=$|[\s_-]|\d)", re.I)
#: An element of these ends an open element of those.
ENDS = {x: frozenset({"p"}) for x in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}

#: Of these, the words whose element can't hold the page's article.
CLOSED_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|comments?|commentlist|reply|replies|disqus|respond|related|cookies?|popup|modal)(?=$|[\s_-]|\d)", re.I)
#: Of these, the words that leave little doubt inside an article either.
FIRM_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|comments?|commentlist|reply|replies|disqus|respond|cookies?|popup|modal)(?=$|[\s_-]|\d)", re.I)

OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
COMMENT_END = re.compile(r"--!?>")
#: Where a tag may end, or a quoted value begin.
STOP = re.compile(r"=\s*([\"'])|>")
NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WHITE = re.compile(r"\s+")

#: Weights of the features before anything is learnt, in log odds. A doubt is a tag or word inside an article.
PRIOR = {"bias": -1.5, "words": 3.0, "stops": 1.5, "links": -4.0, "says:content": 6.0, "says:bad word": -6.0, "says:boilerplate": -8.0}
DOUBTS = {"doubt:firm word": -16.0, "doubt:word": -6.0, "doubt:nav": -14.0, "doubt:menu": -14.0, "doubt:dialog": -12.0, "doubt:footer": -9.0, "doubt:aside": -11.0, "doubt:header": -4.0}
#: Variances of the weights around these, and of the weights of tag and word names around 0.
PRIOR_VARIANCE, NAME_VARIANCE = 1.0, 0.25
#: A weight moves from its prior by at most this; the odds of a block are cut to MOST_ODDS.
MOST_MOVE, MOST_ODDS = 3.0, 12.0
#: Capacities of the smoothness edges, in log odds, and units of a log odds in integer capacities.
NEXT, BORDER, RELATED, UNITS = 1.0, 0.25, 0.5, 1000
TRAIN_PAGES, PAGE_CHARS, TRAIN_CHARS = 200, 200_000, 40_000_000
MOST_PATH, MOST_NAMES = 64, 256


class Block:
    __slots__ = ("text", "path", "linked", "verdict", "names", "doubts")

    def __init__(self, text: str, path: tuple[int, ...], linked: int, verdict: int, names: frozenset[str] = frozenset(), doubts: frozenset[str] = frozenset()) -> None:
        self.text, self.path, self.linked, self.verdict, self.names, self.doubts = text, path, linked, verdict, names, doubts


class Tags:
    """Finds the tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.lenient = html, html.rfind(">"), False

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """Begin, end, name (None for what is no tag), whether it is an end tag, and attributes of the next one at or behind at."""
        html = self.html
        while (m := OPEN.search(html, at)) is not None:
            if m[1]:
                end = COMMENT_END.search(html, m.end())
                return m.start(), end.end() if end else len(html), None, False, ""
            if m.start() > self.last:
                return None  # no > follows: all that is left is text
            end = self._end(m.end()) if m[3] else html.find(">", m.end())
            if end < 0:
                at = m.start() + 1
                continue
            return m.start(), end + 1, m[3].lower() if m[3] else None, bool(m[2]), html[m.end() : end] if m[3] else ""
        return None

    def _end(self, at: int) -> int:
        start = at
        while not self.lenient and (m := STOP.search(self.html, at)) is not None:
            if m[1] is None:
                return m.start()
            close = self.html.find(m[1], m.end())
            if close < 0:
                break
            at = close + 1
        self.lenient = True  # a quote stays open, here or up to the end of the page
        return self.html.find(">", start)


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order. path: numbers of the nearest open elements; verdict: what the markup says, below 0 boilerplate (-2: outright), 1 content, 0 nothing;
    doubts: what speaks against a block inside an article."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool, frozenset[str], frozenset[str]]] = []  # name, verdict, silent, link, tag and word names, doubts
    path: list[int] = []  # numbers of the open elements that end blocks
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = number = 0
    bare = (0, False, False, frozenset(), frozenset())
    verdict, silent, link, names, doubts = bare

    def flush() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, tuple(path[-MOST_PATH:]), min(linked, len(text)), verdict, names, doubts))
            parts.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        if name not in INLINE:
            path.pop()
        return name

    def restore() -> None:
        nonlocal verdict, silent, link, names, doubts
        verdict, silent, link, names, doubts = stack[-1][1:] if stack else bare

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if link:
                linked += len(piece.strip())

    at, tags = 0, Tags(html)
    while True:
        found = tags.next(at)
        if found is None:
            text(html[at:])
            break
        begin, end, name, ends_it, attributes = found
        text(html[at:begin])
        at = end
        if name is None:
            continue
        if ends_it:
            if opened.get(name):
                if name not in INLINE:
                    flush()
                while pop() != name:
                    pass
                restore()
            elif name in ("p", "br"):
                flush()
            continue
        if name not in INLINE:
            flush()
            if ends := ENDS.get(name):
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] in INLINE:
                    depth -= 1
                while depth >= 0 and stack[depth][0] in ends:
                    while len(stack) > depth:
                        pop()
                    depth -= 1
                restore()
        if name in VOID:
            continue
        number += 1
        mine, quiet, called, doubt = verdict, silent or name in SILENT, [] if name in INLINE else [f"tag:{name}"], []
        if name in CONTENT:
            mine = 1 if verdict >= -1 else verdict
        elif name in BOILERPLATE:
            if verdict > 0:
                doubt.append(f"doubt:{name}")
            else:
                mine = -2
        if attributes and name not in ("html", "body"):
            for a in NAMING.finditer(attributes):
                word = a[1] or a[2] or a[3] or ""
                called += [f"word:{x}" for x in word.lower().split()]
                if verdict > 0:
                    if FIRM_WORDS.search(word):
                        doubt.append("doubt:firm word")
                    elif name not in CONTENT and BAD_WORDS.search(word):
                        doubt.append("doubt:word")
                elif verdict >= -1:  # a wrapper that is only called a sidebar or header may still hold the article
                    if CLOSED_WORDS.search(word):
                        mine = -2
                    elif name not in CONTENT and mine > -2 and BAD_WORDS.search(word):
                        mine = -1
        if attributes.endswith("/") and name in ("svg", "math"):
            continue
        stack.append((name, mine, quiet, link or name == "a", names.union(called) if called and len(names) < MOST_NAMES else names, doubts.union(doubt) if doubt else doubts))
        opened[name] = opened.get(name, 0) + 1
        if name not in INLINE:
            path.append(number)
        restore()
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.start() if close else len(html)
    flush()
    return out


SAYS = {1: "says:content", -1: "says:bad word", -2: "says:boilerplate"}


def text_features(b: Block) -> dict[str, float]:
    """What the text of a block alone tells, each between 0 and 1."""
    words = b.text.count(" ") + 1
    stops = sum(map(b.text.count, ".!?…。"))
    return {"bias": 1.0, "words": min(1.0, math.log2(words) / 5), "stops": min(1.0, stops / 2), "links": b.linked / max(1, len(b.text))}


class Classifier:
    """Logistic regression of content against boilerplate."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or PRIOR

    def odds(self, b: Block) -> float:
        """Log odds of content."""
        w = self.weights
        z = sum(w[k] * v for k, v in text_features(b).items()) + sum(w.get(x, 0.0) for x in b.names)
        if b.verdict:
            z += w[SAYS[b.verdict]]
        z += sum(map(DOUBTS.__getitem__, b.doubts))
        return max(-MOST_ODDS, min(MOST_ODDS, z))


def train(pages: list[str], rounds: int = 30) -> Classifier:
    """Fits the weights to the blocks of pages that mark an article, by damped Newton steps on the diagonal."""
    rows: list[dict[str, float]] = []
    gold: list[float] = []
    for html in pages:
        blocks = blocks_of(html)
        if not any(b.verdict > 0 for b in blocks):
            continue
        for b in blocks:
            if b.doubts:
                continue
            plain = text_features(b)
            rows += [plain | {x: 1.0 for x in b.names} | ({SAYS[b.verdict]: 1.0} if b.verdict else {}), plain]
            gold += [float(b.verdict > 0)] * 2
    if not rows:
        return Classifier()
    number = {k: i for i, k in enumerate(dict.fromkeys(k for r in [PRIOR, *rows] for k in r))}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([number[k] for r in rows for k in r])
    val = np.array([v for r in rows for v in r.values()])
    y, prior = np.array(gold), np.array([PRIOR.get(k, 0.0) for k in number])
    firm = np.where(np.isin(np.arange(len(number)), [number[k] for k in PRIOR]), 1 / PRIOR_VARIANCE, 1 / NAME_VARIANCE)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col] * val, len(rows)), -30, 30)))
        slope = np.bincount(col, (y - p)[at] * val, len(w)) - firm * (w - prior)
        curve = np.bincount(col, (p * (1 - p))[at] * val * val, len(w)) * 8 + firm  # 8: features overlap
        w = np.clip(w + slope / curve, prior - MOST_MOVE, prior + MOST_MOVE)
    return Classifier({k: float(w[i]) for k, i in number.items()})


class MaxFlow:
    """Shortest augmenting paths in level graphs. Nodes are 0..n-1."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, forward: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forward)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.cap[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Which nodes stay connected with s once the flow is maximal."""
        to, cap, out = self.to, self.cap, self.out
        while (level := self._levels(s))[t] >= 0:
            nxt = [0] * len(out)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    least = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= least
                        cap[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if not cap[e])
                    a = to[path[k] ^ 1]
                    del path[k:]
                while nxt[a] < len(out[a]):
                    e = out[a][nxt[a]]
                    if cap[e] and level[to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                else:
                    if a == s:
                        break
                    e = path.pop()
                    a = to[e ^ 1]
                    nxt[a] += 1
                    continue
                path.append(e)
                a = to[e]
        return [x >= 0 for x in level]


def label(blocks: list[Block], classifier: Classifier) -> list[bool]:
    """Which blocks are content: the source side of the minimum cut."""
    n = len(blocks)
    s, t = n, n + 1
    flow = MaxFlow(n + 2)
    last: dict[int, int] = {}
    near, border, related = round(NEXT * UNITS), round(BORDER * UNITS), round(RELATED * UNITS)
    for i, b in enumerate(blocks):
        odds = round(classifier.odds(b) * UNITS)
        if odds > 0:
            flow.edge(s, i, odds)
        elif odds < 0:
            flow.edge(i, t, -odds)
        if i:
            side = near if b.doubts == blocks[i - 1].doubts else border
            flow.edge(i - 1, i, side, side)
        for d, x in enumerate(b.path):  # nearest earlier block below each ancestor but the outermost two; joined once, by the deepest
            last_seen = last.get(x)
            if d >= 2 and last_seen is not None and (d + 1 == len(b.path) or b.path[d + 1] not in last) and last_seen != i - 1:
                flow.edge(last_seen, i, related, related)
        for x in b.path:
            last[x] = i
    return flow.source_side(s, t)[:n]


def main_text(html: str | None, classifier: Classifier | None = None) -> str:
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, label(blocks, classifier or Classifier()), strict=True) if keep)


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """At most TRAIN_PAGES different whole pages of TRAIN_CHARS characters together (or one). Only their keys are ordered, not their texts."""
    src = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("at"), F.xxhash64(html_col).alias("same"), F.length(html_col).alias("size"), F.col(html_col).alias("html"))
    late = F.when(F.col("size") > PAGE_CHARS, F.col("size")).otherwise(0)
    keys = src.select("at", "same", "size", late.alias("late")).distinct().orderBy("late", "at", "same").limit(TRAIN_PAGES).collect()
    if not keys:
        return []
    total = np.cumsum([r["size"] for r in keys])
    picked = pages.sparkSession.createDataFrame([(r["at"], r["same"]) for i, r in enumerate(keys) if i == 0 or total[i] <= TRAIN_CHARS], "at long, same long")
    got = src.join(F.broadcast(picked), ["at", "same"]).groupBy("at", "same").agg(F.min("html").alias("html")).collect()
    return [r["html"] for r in sorted(got)]


def extract_text(pages: DataFrame, classifier: Classifier | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    classifier = classifier or Classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [main_text(x, classifier) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train(sample_pages(pages)))
