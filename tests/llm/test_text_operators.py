"""Language ID, toxicity, encoding, HTML, WARC: held-out accuracy, round trips, brute force and odd inputs."""

import base64
import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import html_extraction, language_id, piece_encoding, toxicity, warc
from siftwell.llm.common import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)


# ---- language ID ----------------------------------------------------------------------------------------------------


def brute_bits(sample, text, order, contexts):
    """Code length by the definition, byte for byte, with the contexts that the automaton keeps."""
    tree = {}
    for s in sample:
        for k in range(order + 1):
            for i in range(k, len(s)):
                node = tree.setdefault(s[i - k : i], {})
                node[s[i]] = node.get(s[i], 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        k = min(i, order)
        while True:
            if text[i - k : i] in contexts and (node := tree.get(text[i - k : i])):
                total, distinct = sum(node.values()), len(node)
                if b in node:
                    bits -= math.log2(node[b] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
            if k == 0:
                bits += 8
                break
            k -= 1
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(0)
    words = [b"the ", b"and ", b"le ", b"une ", b"der ", b"xyz "]
    samples = {"a": [b"".join(rng.choices(words[:3], k=60)), b"", b"q"], "b": [b"".join(rng.choices(words[2:], k=80))]}
    model = language_id.train(samples, order=3)
    contexts = {s[i - k : i] for v in samples.values() for s in v for k in range(4) for i in range(k, len(s))}
    texts = [b"", b"t", b"the une \xff\x00zz", b"".join(rng.choices(words, k=400))]
    got = language_id.code_lengths(model, texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(samples[lang], t, 3, contexts), rel=1e-4, abs=1e-3)


def test_contexts_are_bounded():
    rng = np.random.default_rng(0)
    model = language_id.train({"a": [rng.integers(0, 255, 5000).astype(np.uint8).tobytes()]}, max_contexts=300)
    assert len(model.step) // model.width <= 300
    assert np.isfinite(language_id.code_lengths(model, [b"abc" * 100])).all()


def test_language_accuracy_on_held_out(spark, data):
    found = language_id.op1_language_id(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert found.count() == truth.count() and found.where("score < 0 OR score > 1").count() == 0


def test_language_odd_inputs(spark):
    model = language_id.train({"en": [b"the cat and the dog"], "fr": [b"le chat et le chien"]})
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, [None, "", "123 $$", "the cat", "le chien " * 40000]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "fr"]
    assert {r["lang_pred"] for r in language_id.identify_languages(docs(spark, ["the"]), None).collect()} == {"und"}
    assert language_id.identify_languages(docs(spark, []), model).count() == 0
    assert language_id.train({}) is None and language_id.train({"a": [b""]}) is None
    extra = docs(spark, ["the cat", None]).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    kept = language_id.identified_rows(extra, model, 0.5)
    assert kept.columns == extra.columns and [r["doc_id"] for r in kept.collect()] == [0]


# ---- toxicity -------------------------------------------------------------------------------------------------------


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, t = rng.normal(size=n), rng.normal(size=(2, 2))
        total, marginal, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(2**n):
            tags = [k >> i & 1 for i in range(n)]
            w = math.exp(sum(e[i] for i in range(n) if tags[i]) + sum(t[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            marginal += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w
        other = rng.normal(size=3)
        got, expected = toxicity.chain_marginals(np.concatenate([other, e]), np.array([3, n]), t)
        assert np.allclose(got[3:], marginal / total)
        _, alone = toxicity.chain_marginals(e, np.array([n]), t)
        assert np.allclose(alone, pairs / total)


def test_toxic_spans_and_scores():
    rng = random.Random(1)
    plain = ["river", "stone", "garden", "window", "paper", "silver", "morning", "kettle"]
    texts, labels = [], []
    for i in range(300):
        w = rng.choices(plain, k=30)
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["vileword", "meanword"])
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, labels)
    score = toxicity.document_scores(model, [toxicity.tokens(t) for t in ["river stone vileword garden", "river stone garden", ""]])
    assert score[0] > 0.7 > 0.3 > score[1] and 0 <= score[2] < 0.3
    text = "River stone VILEWORD garden"
    assert [text[a:b] for a, b in toxicity.offending_spans(model, text)] == ["VILEWORD"]
    assert toxicity.offending_spans(model, None) == [] and toxicity.offending_spans(model, "İİİ vileword") == [(4, 12)]
    assert toxicity.train(["a", "b"], [1, 1]) is None


def test_toxicity_query(spark, data):
    found = toxicity.op8_toxicity(spark, data)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert found.count() == n and found.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 AS int)").count() == 0


def test_toxicity_of_held_out_rows(spark, data):
    """Labelled rows that were not learnt from: nearly all toxic ones are found, few clean ones are marked."""
    larger = f"{os.path.dirname(data)}/sf0.1"
    if not os.path.isdir(larger):
        pytest.skip("too few labels")
    marks = spark.read.parquet(f"{larger}/labels.parquet").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op8_toxicity(spark, larger).where("held_out").join(marks, "doc_id").collect()
    found = [r["predicted"] for r in rows if r["toxic"]]
    alarms = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(found) >= 0.85 * len(found) > 0 and sum(alarms) <= 0.1 * len(alarms), (sum(found), len(found), sum(alarms), len(alarms))


def test_toxicity_odd_inputs(spark):
    model = toxicity.train([f"w{i} bad word" for i in range(40)] + [f"w{i} fine day" for i in range(40)], [1] * 40 + [0] * 40)
    got = toxicity.score_toxicity(docs(spark, [None, "", "bad word", "fine " * 50000]), model, spans=True).orderBy("doc_id").collect()
    assert got[0]["spans"] == [] and got[2]["score"] > got[3]["score"]
    assert toxicity.score_toxicity(docs(spark, ["x"]), None).first()["score"] == 0
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0


# ---- encoding -------------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "  two  spaces ", "▁already", "tab\tline\n", "naïve €uro 😀 漢字", "a\u0000b", "x" * 5000, "<s> </s> <unk>", "éẞ ﬁ"]


def test_encoding_is_the_librarys(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_encoding.MODEL))
    for r in piece_encoding.encode_documents(docs(spark, ODD)).collect():
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == lib.encode(text) and r["decoded"] == lib.decode(lib.encode(text))
        size = len(text.encode())
        assert not r["ids"] or (r["begins"][0] == 0 and r["ends"][-1] == size)
        assert r["begins"][1:] == r["ends"][:-1]
        for i, b, e in zip(r["ids"], r["begins"], r["ends"], strict=True):
            piece = lib.id_to_piece(i)
            if not lib.is_byte(i) and "▁" not in text:
                assert text.encode()[b:e].decode() == piece.replace("▁", " ") or piece.startswith("▁") and b == 0


def test_encoding_query_against_library(spark, data):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_encoding.MODEL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = piece_encoding.op9_piece_encoding(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r["covered_bytes"] == len(texts[r["doc_id"]].encode())
        # the library's own offsets, in normalised text, which has two more bytes for each space and three in front
        text, at, spans = texts[r["doc_id"]].encode(), 0, b""
        place = np.cumsum([0, *([3] if text else []), *(3 if x == 32 else 1 for x in text)])
        back = np.concatenate([np.repeat([0, *range(len(text))][: len(place) - 1], np.diff(place)), [len(text)]])
        for i in ids:
            end = at + (1 if lib.is_byte(i) else len(lib.id_to_piece(i).encode()))
            spans += np.array([back[at], back[end]], "<i8").tobytes()
            at = end
        assert r["spans_sha256"] == hashlib.sha256(spans).hexdigest()


def test_encoding_by_words_and_as_a_whole():
    import sentencepiece

    path = tokenizer_path(piece_encoding.MODEL)
    lib, words, whole = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.PieceEncoder(path), piece_encoding.PieceEncoder(path)
    assert words.by_words
    whole.by_words = False
    rng = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "▁", "é", "漢", "\n", "\t", "ing", "<s>", "😀", "\u00a0", "1", ".", "Re"]
    for text in [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(800)]:
        assert words.encode(text) == whole.encode(text) == lib.encode(text), text


def test_character_map_takes_the_longest_prefix():
    """A map built by hand: 'a' -> 'x', 'ab' -> 'yz'."""
    import struct

    units = [0] * 1024
    units[0] = 256 << 10  # root: children at 256 ^ label
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | (a ^ 512) << 10  # has a value; its value and children at 512
    units[512] = 1 << 31 | 0
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | (b ^ 768) << 10
    units[768] = 1 << 31 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yz\0"
    m = piece_encoding.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) == (0, b"")
    n = piece_encoding.Normalizer(b"")
    n.map, n.dummy, n.squeeze, n.escape = m, True, True, True
    norm, align = n(b" ab  c ")
    assert norm.decode() == "▁yz▁c" and align.tolist() == [1, 1, 1, 1, 1, 3, 3, 3, 5, 7]


# ---- HTML -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<nav>a b</nav>", ""),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T&eacute;st</h1><p>One\n  two&nbsp;three.</p></article><footer>&copy; x</footer>", "Tést One two three."),
    ("<article><p>Short.<p>Unclosed <b>bold<br>next</article><aside>Side</aside>", "Short. Unclosed bold next"),
    ("<article><p>Text.</p><div class='comments'><p>Reader says a lot of things here.</p></div><form>Mail <input></form><script>var a='</p>'</script></article>", "Text."),
    ("<main><p>a &lt;b&gt; &amp;amp; c</p><!-- <p>hidden</p> --><style>p{}</style></main>", "a <b> &amp; c"),
    ("<div class=cookie-notice>We use cookies. Accept all of them now.</div><main><p>Main</p></main>", "Main"),
    ("<div class='layout sidebar-right'><div id=menu>Menu</div><article><p>Body.</p></article><div id=comments><article>First!</article></div></div>", "Body."),
    ("<p>A page without an article that still has a long paragraph. It has sentences, and words enough to be content by itself.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "A page without an article that still has a long paragraph. It has sentences, and words enough to be content by itself."),
])
def test_main_text(html, text):
    assert html_extraction.main_text(html) == text


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = n, n + 1
        caps = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        flow = html_extraction.MaxFlow(n + 2)
        for i, (a, b) in enumerate(caps):
            flow.edge(s, i, a)
            flow.edge(i, t, b)
        for i, j, c in edges:
            flow.edge(i, j, c, c)
        cost = lambda keep: sum(b if k else a for k, (a, b) in zip(keep, caps)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: B023, E731
        got = flow.source_side(s, t)[:n]
        assert cost(got) == min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))


def test_html_query(spark, data):
    found = html_extraction.op5_html_extraction(spark, data)
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert found.count() == pages.count() and found.where("n_chars <> length(text)").count() == 0
    assert html_extraction.extract_text(pages.limit(0)).count() == 0
    assert html_extraction.extract_text(pages.limit(3).withColumn("text", F.lit(1))).count() == 3


def without_marks(html):
    """The page with nothing that names an article or boilerplate."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html))


def test_pages_without_marks(spark, data):
    """Precision and recall of words where only text and neighbours tell; the cut decides some of the blocks."""
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").where("html IS NOT NULL").collect()]
    model = html_extraction.train(html_extraction.sample_pages(spark.read.parquet(f"{data}/pages.parquet")))
    both = found = wanted = changed = 0
    for html in pages:
        inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
        want = [w for b in html_extraction.blocks_of(inside) for w in b.text.split()]
        assert html_extraction.main_text(html, model).split() == want
        blocks = html_extraction.blocks_of(without_marks(html))
        keep = html_extraction.label(blocks, model)
        got = [w for b, k in zip(blocks, keep, strict=True) if k for w in b.text.split()]
        both += (Counter(want) & Counter(got)).total()
        found, wanted = found + len(got), wanted + len(want)
        changed += sum(k != (model.odds(b) > 0) for b, k in zip(blocks, keep, strict=True))
    assert both / found > 0.9 and both / wanted > 0.97 and changed > 0


def test_classifier_is_bounded_and_learns():
    page = "<div class=zig><p>One two three four five six. Seven eight.</p></div><article><p>Short</p><p>Text of the article. More of it.</p></article>" * 5
    model = html_extraction.train([page] * 10)
    assert model.weights["word:zig"] < 0 < model.weights["tag:article"]
    assert all(abs(w - html_extraction.PRIOR.get(k, 0)) <= html_extraction.MOST_MOVE for k, w in model.weights.items())
    assert html_extraction.train([]).weights == html_extraction.train(["<p>no article</p>"]).weights == html_extraction.PRIOR


@pytest.mark.parametrize("html, text", [
    ('<article title="The hidden cost"><p>One.</p><p data-x="a hidden b">Two.</p></article>', "One. Two."),
    ("<article><p>One two three four.</p><div class='share-prices'><p>The share went up by a tenth today. Analysts had expected that much.</p></div><section class='related'><p>A related finding came from the same group last year. It was confirmed.</p></section></article>", "One two three four. The share went up by a tenth today. Analysts had expected that much. A related finding came from the same group last year. It was confirmed."),
    ("<article><header><h1>The title of it</h1></header><p>Body text. More.</p><div class='share'><a href=x>Tweet</a> <a href=y>Mail</a></div><noscript>Shown without scripts, too. Yes.</noscript></article>", "The title of it Body text. More. Shown without scripts, too. Yes."),
    ('<article><p title="abc>First paragraph. It counts.</p><p>Second one.</p></article>', "First paragraph. It counts. Second one."),
    ("<article><p>Prices < 5 and > 3, a<b. End <", "Prices < 5 and > 3, a<b. End <"),
    ("<article><p title='a > b' class=x>Quoted. <a href=\"x?a='1\">link</a> and text.</p></article>", "Quoted. link and text."),
    ("<article><p>Let <math><mi>x</mi></math> be <object>an object</object>.</p></article>", "Let x be an object ."),
])
def test_nothing_else_is_dropped(html, text):
    assert html_extraction.main_text(html).replace(" .", ".") == text.replace(" .", ".")


def test_the_cut_with_and_without_marks(spark, data):
    """Where marks are missing the cut mends single blocks; where articles hold doubtful elements it decides by their text and neighbours."""
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").where("html IS NOT NULL").collect()]
    model = html_extraction.train(html_extraction.sample_pages(spark.read.parquet(f"{data}/pages.parquet")))
    prose = "<p>The market opened higher. Trading was thin.</p><h4>Oil</h4><p>Prices fell by a tenth, as they had the week before. No one knows why.</p>"
    links = "<ul><li><a href=a>One more</a></li><li><a href=b>Another one</a></li></ul>"
    scored = {}
    for kind in ("without marks", "doubtful"):
        for cut in (False, True):
            both = found = wanted = changed = 0
            for i, html in enumerate(pages):
                inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
                want = [w for b in html_extraction.blocks_of(inside) for w in b.text.split()]
                if kind == "without marks":
                    html = without_marks(html)
                else:
                    word = ("share-prices", "related", "side-note")[i % 3]
                    html = html.replace("</article>", f"<div class='{word}'>{prose}</div><div class='{word}'>{links}</div></article>")
                    want += [w for b in html_extraction.blocks_of(prose) for w in b.text.split()]
                blocks = html_extraction.blocks_of(html)
                plain = [model.odds(b) > 0 for b in blocks]
                keep = html_extraction.label(blocks, model) if cut else plain
                got = [w for b, k in zip(blocks, keep, strict=True) if k for w in b.text.split()]
                both += (Counter(want) & Counter(got)).total()
                found, wanted, changed = found + len(got), wanted + len(want), changed + sum(a != b for a, b in zip(keep, plain, strict=True))
            scored[kind, cut] = both / found, both / wanted, changed
    for kind in ("without marks", "doubtful"):
        (p, r, _), (q, s, changed) = scored[kind, False], scored[kind, True]
        assert changed > 0 and 2 * q * s / (q + s) >= 2 * p * r / (p + r) and q > 0.9 and s > 0.97


@pytest.mark.parametrize("unit", ['<a "', '<a x="', "<p title='", "<b></i>", "<", "<!", '<a x=">', "<div class=c%d>"])
def test_tags_are_found_in_linear_time(unit):
    def seconds(n):
        page = "".join(unit % i if "%" in unit else unit for i in range(n)) + "text >"
        began = time.process_time()
        html_extraction.blocks_of(page)
        return time.process_time() - began

    seconds(100)
    small, large = min(seconds(2000) for _ in range(3)), min(seconds(16_000) for _ in range(2))
    assert large < 24 * small + 0.2


def test_samples_of_pages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "PAGE_CHARS", 100)
    monkeypatch.setattr(html_extraction, "TRAIN_CHARS", 1000)
    rows = [(i, "x" * (50 + i)) for i in range(5)] + [(10, "y" * 600), (11, "z" * 900), (12, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted(len(x) for x in html_extraction.sample_pages(pages)) == [50, 51, 52, 53, 54, 600]
    assert [len(x) for x in html_extraction.sample_pages(pages.where("page_id = 11").withColumn("html", F.repeat("html", 2)))] == [1800]
    assert html_extraction.sample_pages(pages.where("page_id = 12")) == []


def test_deep_and_long_pages():
    assert html_extraction.main_text("<div>" * 3000 + "x" + "</div>" * 3000) in ("", "x")
    long = "<article>" + "<p>Some words here, and more.</p>" * 3000 + "</article>"
    assert html_extraction.main_text(long).count("words") == 3000


# ---- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = ["<p>é</p>", None, "", magic, "same", "same", "same", "line\nbreak\r\n\r\n", "x" * 300_000] + ["hot"] * 60
    pages = spark.createDataFrame([(i, f"http://x/{i} y" if i % 2 else None, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    rows = {r["page_id"]: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert sorted(rows) == list(range(len(htmls)))
    last = {}
    for i, h in enumerate(htmls):
        last[h or ""] = i
    for i, h in enumerate(htmls):
        data, r = (h or "").encode(), rows[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[h or ""] == i
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[h or ""]))
        assert r["payload"] == (data if first else None)
    assert rows[1]["url"] == "http://x/1%20y" and rows[0]["url"] is None


@pytest.mark.parametrize("split", [700, 5000])
def test_warc_splits_inside_archives(spark, tmp_path, split):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = [magic * k + "WWARC/1" * (k % 3) + "y" * (37 * k) for k in range(12)] + ["WARC/1." * 300, "WARC/1.0\r\n" * 200]
    pages = spark.createDataFrame([(i, "http://x/WARC/1.1" if i % 4 == 0 else None, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages.coalesce(2), path, compression="none")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = {r["page_id"]: r for r in warc.read_warc(spark, path, payload=True).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(rows) == list(range(len(htmls)))
    for i, h in enumerate(htmls):
        assert rows[i]["payload"] == h.encode() and rows[i]["payload_bytes"] == len(h.encode()) and rows[i]["record_type"] == "response"
        assert rows[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert rows[i]["url"] == ("http://x/WARC/1.1" if i % 4 == 0 else None)


def test_warc_header_parted_from_its_split(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://x/" + "WARC/1.1/" * 12, f"{i}" + "z" * (11 * i)) for i in range(10)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages.coalesce(1), path, compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 600)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert warc.scan(warc._cut(spark, path)).where(f"what = {warc.HEADLESS}").count() > 0
        rows = {r["page_id"]: r["payload_bytes"] for r in warc.read_warc(spark, path).collect()}
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "600"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert rows == {i: 1 + 11 * i for i in range(10)}


def test_warc_broken_chains(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for k, (data, fine) in enumerate([(good * 3, True), (b"", True), (good.replace(b"1.1", b"1.0"), True), (good + good[:-3], False), (b"junk" + good, False), (b"junk", False), (good.replace(b"Length: 2", b"Length: 9"), False)]):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "a.warc").write_bytes(data)
        if fine:
            assert warc.read_warc(spark, f"file://{folder}").count() == 0
        else:
            with pytest.raises(ValueError):
                warc.read_warc(spark, f"file://{folder}")


def test_warc_pointer_jumping():
    at, successor = np.array([0, 5, 10, 20, 30]), np.array([10, 20, 30, -1, 47])
    step, out = warc.leaps(at, successor, 40)
    assert step.tolist() == [2, 3, 4, 3, 4] and out.tolist() == [47, -1, 47, -1, 47]
    assert warc.chain(at, successor, np.array([0])).tolist() == [True, False, True, False, True]
    assert warc.leaps(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)[1].tolist() == []


def test_warc_repeated_rows_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/a")
    got = sorted((r["page_id"] or 0, r["record_type"]) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect())
    assert got == [(0, "response"), (1, "response"), (1, "revisit")]
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_warc(spark, f"file://{tmp_path}/b").count() == 0


def test_warc_query(spark, data):
    found = warc.op6_warc(spark, data).toPandas()
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    assert len(found) == len(pages)
    digest = {p: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for p, h in zip(pages.page_id, pages.html, strict=True)}
    assert all(digest[p] == d for p, d in zip(found.page_id, found.payload_digest, strict=True))


def test_text_buffer_slices():
    from siftwell.llm.repeats import text_buffer

    data, offsets = text_buffer(pa.array(["ab", None, "", "é"]).slice(1))
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 0, 2]


# ---- bounds of samples and of reading ---------------------------------------------------------------------------------

CLASHING = "lang id at size same toxic score value payload best start file salt n_tokens ids"


def clashing(df):
    """With extra columns that are called like columns the operators use inside."""
    return df.withColumns({x: F.lit(x) for x in CLASHING.split() if x not in df.columns})


def test_no_language_is_lost_for_its_length(spark):
    french = "le chat noir dort sur la chaise du jardin "
    rows = [(i, french * 150, "fr") for i in range(9)] + [(100 + i, "the black cat sleeps on the garden chair", "en") for i in range(9)] + [(200, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample_rows(df, F.lit(True), "doc_id", "text", "lang")
    assert set(sample) == {"fr", "en"} and len(sample["fr"]) == 9
    model = language_id.train(sample)
    assert language_id.identify_languages(docs(spark, ["le chat du jardin"]), model).first()["lang_pred"] == "fr"
    few = language_id.sample_rows(df, F.lit(True), "doc_id", "text", "lang", total=7000)
    assert len(few["fr"]) == 1 and len(few["en"]) == 9  # the first row is read whole, however long
    short_first = spark.createDataFrame([(i, "x" * (50 + i % 2 * 9000), "a") for i in range(200)], "doc_id long, text string, lang string")
    assert {len(t) for t in language_id.sample_rows(short_first, F.lit(True), "doc_id", "text", "lang")["a"]} == {50}


def test_a_long_text_hides_no_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 1000)
    rows = [(i, "clean words " + str(i)) for i in range(20)] + [(50, "w " * 9000)] + [(60 + i, f"vile {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = clashing(df)
    marks = spark.createDataFrame([(i, 0) for i in [*range(20), 50]] + [(60 + i, 1) for i in range(3)], "doc_id long, toxic int")
    texts, labels = toxicity.labelled_sample(df, marks)
    assert labels.count(0) == 20 and labels.count(1) == 3 and max(map(len, texts)) < 100
    texts, labels = toxicity.labelled_sample(df.where("doc_id >= 50"), marks)
    assert labels.count(0) == 1  # the only clean row is read, however long


def test_rows_of_one_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 50)
    df = spark.createDataFrame([(1, "")] * 3000 + [(1, f"text {i}") for i in range(3000)] + [(2, "bad")] * 100, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    texts, labels = toxicity.labelled_sample(df, marks)
    assert labels.count(0) == 50 and labels.count(1) == 1 and len(set(texts)) == 51
    first = [r["text"] for r in df.where("doc_id = 1").distinct().orderBy(F.xxhash64("text")).limit(50).collect()]
    assert set(texts) == {*first, "bad"}  # the first of all, however they are dealt to tasks


def test_clashing_names_change_nothing(spark, tmp_path):
    plain = docs(spark, ["the cat", "le chien", None, "", "vile word", "the cat"])
    extra = clashing(plain)
    chain = toxicity.train([f"w{i} vile word" for i in range(40)] + [f"w{i} fine day" for i in range(40)], [1] * 40 + [0] * 40)
    model = language_id.train({"en": [b"the cat and the dog"], "fr": [b"le chat et le chien"]})
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(toxicity.score_toxicity(extra, chain, spans=True)) == rows(toxicity.score_toxicity(plain, chain, spans=True))
    assert rows(language_id.identify_languages(extra, model)) == rows(language_id.identify_languages(plain, model))
    assert rows(piece_encoding.encoding_digests(extra)) == rows(piece_encoding.encoding_digests(plain))
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    for name, df in (("a", pages), ("b", clashing(pages))):
        warc.write_warc(df, f"file://{tmp_path}/{name}")
    assert rows(warc.read_warc(spark, f"file://{tmp_path}/a")) == rows(warc.read_warc(spark, f"file://{tmp_path}/b"))


def test_warc_ids_are_any_long(spark, tmp_path):
    ids = [1234567890123456789, 2**63 - 1, -(2**63), 0, -5]
    pages = spark.createDataFrame([(i, "u", h) for i in ids for h in ("same",)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/a")
    got = {r["page_id"]: r["refers_to"] for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect()}
    assert got == {i: None if i == 2**63 - 1 else 2**63 - 1 for i in ids}


def false_headers(n):
    return "".join(f"WARC/1.1\r\nContent-Length: {10**6 + i}\r\n\r\n" for i in range(n))


@pytest.mark.parametrize("split", [1 << 30, 40_000])
def test_warc_with_many_false_headers(spark, tmp_path, split):
    htmls = ["x\r\n\r\n" + false_headers(3000) + str(i) for i in range(3)] + ["short"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_warc(pages.coalesce(1), path, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = {r["page_id"]: r for r in warc.read_warc(spark, path, payload=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: bytes(r["payload"]).decode() for k, r in rows.items()} == dict(enumerate(htmls))


def test_reading_grows_with_the_bytes():
    def seconds(n):
        data = ("x\r\n\r\n" + false_headers(n)).encode().split(warc.MARK)
        began = time.process_time()
        split = warc.Split("f", 1, False)
        assert sum(1 for piece in data for _ in split.add(piece)) == 0 and len(list(split.end())) > n
        return time.process_time() - began

    seconds(500)
    small, large = min(seconds(2000) for _ in range(3)), min(seconds(8000) for _ in range(2))
    assert large < 12 * small
