"""Token counts, quality, languages, page text and decontamination."""

from __future__ import annotations

import os
import random
import re
import subprocess
import sys
import tracemalloc
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsift.llm import common, decontamination, html_text, language_id, quality, token_counts
from tarsift.llm.common import held_out

SF = "/root/testdata/sf0.01"


def utf8(text):
    return (text or "").encode()


# --- quality terms ---


def test_bags_against_plain_counts():
    """Shares of class trigrams and of words, counted one by one."""
    texts = ["", "One two two, thrée!", "a", "  x\ny  X  ", "|| ** 12 a1", "word " * 40]
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    found = quality.bags(np.frombuffer("".join(texts).encode(), np.uint8), at)
    grams, first = quality.CLASSES**3, quality.CLASSES**3 + quality.HABITS
    places = {}
    for text, bag in zip(texts, found, strict=True):
        kinds = [int(quality.KIND[b]) for b in text.encode()]
        want = np.zeros(grams)
        for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False):
            want[(a * quality.CLASSES + b) * quality.CLASSES + c] += 1 / (len(kinds) - 2)
        assert np.allclose(bag[:grams], want, atol=1e-6)
        own = text.encode().lower().split()
        shares = sorted(quality.WORD_PART * own.count(w) / len(own) for w in set(own))
        assert np.allclose(sorted(bag[first:][bag[first:] > 0]), shares, atol=1e-6)
        for w in set(own):
            alone = quality.bags(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0, first:]
            places[w] = int(alone.argmax())
            assert bag[first + places[w]] > 0


def test_leading_vectors_are_those_of_the_decomposition():
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(90, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.normal(size=(12, 150))
    ours, theirs = quality.leading(matrix, 6), np.linalg.svd(matrix)[2][:6].T
    assert np.allclose(ours @ ours.T, theirs @ theirs.T, atol=1e-6)


def test_texts_that_differ_in_words_alone(spark):
    """Both kinds have words of one shape and the same punctuation; only which words differs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    rows = [(k, " ".join(rng.choice(words[60 * (k % 2) :][:60]) for _ in range(50)) + ".", k % 2) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = quality.quality(docs.drop("quality"), quality.fit(docs, docs)).where("held_out").collect()
    assert len(found) > 50 and sum(r.predicted == r.doc_id % 2 for r in found) >= 0.95 * len(found)


# --- token counts -----------------------------------------------------------------------


def best_segmentation(text, pieces, byte):
    """(score, fewest tokens) by recursion over all first pieces, without sharing anything."""
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [
            (best[b][0] + pieces[text[b:end]], -(best[b][1] + 1)) for b in range(end) if text[b:end] in pieces
        ]
        if text[end - 1] not in pieces:
            options.append((best[end - 1][0] + byte, -(best[end - 1][1] + len(text[end - 1].encode()))))
        score, tokens = max(options)
        best[end] = (score, -tokens)
    return best[-1][1]


@pytest.fixture(scope="module")
def pieces():
    public = pytest.importorskip("public_tokenizers")
    return token_counts.unigram_pieces(str(public.path("piece_bpe_32k.model")))


def test_token_counts(docs, rows, pieces):
    byte = min(pieces.values()) - token_counts.BYTE_PENALTY
    memo = {}
    found = token_counts.token_counts(docs, pieces).collect()
    assert len(found) == len(rows)
    want = {}
    for i, text, *_ in rows:
        words = utf8(text).split()
        for w in words:
            if w not in memo:
                memo[w] = best_segmentation("▁" + w.decode(), pieces, byte)
        want.setdefault(i, []).append((len(words), sum(memo[w] for w in words)))
    for r in found:
        assert (r.n_words, r.n_tokens) in want[r.doc_id]


def test_trie_restarts_and_long_words(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 50)
    trie = token_counts.Trie(pieces)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    byte = min(pieces.values()) - token_counts.BYTE_PENALTY
    for w in words + words:
        assert trie[w.encode()] == best_segmentation("▁" + w, pieces, byte)
    assert len(trie.score) < 300


def test_unigram_library_agrees(pieces):
    tokenizers = pytest.importorskip("tokenizers")
    chars = [(p, s) for p, s in pieces.items()]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -1e9), *chars], 0, False))
    trie = token_counts.Trie(pieces)
    for word in ["internationalization", "the", "ouest", "erbleou", "thationing", "wheresh"]:
        assert trie[word.encode()] == len(model.encode("▁" + word).ids)


# --- quality ----------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 50
    right = [r.predicted == r.quality for r in scored]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)


def test_quality_learns_from_other_rows_only(spark, docs):
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    only_held = ids.where(held_out()).select("doc_id", F.lit(1).alias("quality"))
    assert quality.fit(docs, only_held) is None
    assert {r.score for r in quality.quality(docs, None).collect()} == {0.5}


def test_quality_odd_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame(
        [(r[0], k % 2 if k % 7 else None) for k, r in enumerate(rows)] + [(None, 1)], "doc_id long, quality int"
    )
    model = quality.fit(docs, labels)
    found = quality.quality(docs, model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= quality.THRESHOLD for r in found)
    assert quality.quality(no_docs, model).count() == 0
    assert quality.accepted(no_docs, model).count() == 0


def test_blocked_cosines_are_exact():
    rng = np.random.default_rng(4)
    bag = rng.random((60, quality.TERMS)).astype(np.float32) * (rng.random((60, quality.TERMS)) < 0.02)
    model = quality.train(bag, rng.integers(0, 2, 60))
    found = model.scores(bag)
    for k, v in enumerate(model.project(bag)):
        near = model.vectors @ v
        top = np.argsort(-near)[: quality.NEIGHBOURS]
        weight = np.maximum(0, near[top]).astype(float) ** 8
        assert abs(found[k] - (weight * model.labels[top]).sum() / weight.sum()) < 1e-4


# --- languages --------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_languages_odd_rows(docs, no_docs, rows):
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    lettered = {}
    for i, text, *_ in rows:
        lettered.setdefault(i, set()).add(any(ch.isalpha() for ch in text or ""))
    for r in found:
        assert (r.lang_pred != "und") in lettered[r.doc_id]
        assert 0 <= r.score <= 1
        assert r.lang_pred in ("en", "fr", "und")
    assert language_id.fit(no_docs) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


# --- page text --------------------------------------------------------------------------


def test_blocks_of_broken_markup():
    page = (
        "<!DOCTYPE html><head><title>A &amp; B</title><script>var t='</p><p>no';</script><style>p{}</style></head>"
        "<body class='x'><!-- <p>no</p> --><div id=\"menu\"><a href='/'>Home &gt;</a></div><article><p>One\n <b>two"
        "<br><p>three&nbsp;&eacute;&#33;<ul><li>a<li>b</ul>tail<p>unclosed &copy"
    )
    found = [(b.path[-1], b.text) for b in html_text.blocks_of(page)]
    assert found == [
        ("title", "A & B"), ("div.menu", "Home >"), ("p", "One two"), ("p", "three é!"), ("li", "a"), ("li", "b"),
        ("article", "tail"), ("p", "unclosed ©"),
    ]
    for odd in ("", "<", "a < b", "<p", "<!-- open", "<script>open", "</>", "<a href='x", "x" * 100_000):
        html_text.blocks_of(odd)
    assert [b.text for b in html_text.blocks_of("a < b")] == ["a < b"]


def test_gradients():
    rng = np.random.default_rng(0)
    pages = [rng.random((n, html_text.WIDTH)).astype(np.float32) for n in (3, 5)]
    labels = [rng.random(n) < 0.5 for n in (3, 5)]
    model = html_text.Labeller.fresh()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        chances = np.concatenate(model.chances(pages))
        y = np.concatenate(labels)
        return -np.log(np.where(y, chances, 1 - chances)).mean()

    grad = model.gradients(pages, labels)
    for name in ("fx", "fh", "bb", "bh", "out"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        value = model.weights[name][at]
        model.weights[name][at] = value + 1e-3
        up = loss()
        model.weights[name][at] = value - 1e-3
        down = loss()
        model.weights[name][at] = value
        assert abs((up - down) / 2e-3 - grad[name][at]) < 0.02 * abs(grad[name][at]) + 1e-4


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_the_pages(spark, labeller):
    """Against the articles as the pages' own markup has them."""
    found = html_text.main_text(spark.read.parquet(f"{SF}/pages.parquet"), labeller)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    same = 0
    for r in found.collect():
        blocks = html_text.blocks_of(pages[r.page_id])
        same += r.text == "\n".join(b.text for b in blocks if "article" in b.path)
    assert same >= 0.99 * len(pages)


def test_other_templates(labeller):
    """Surroundings that the sampled pages do not have."""
    text = "And therhean is the is esndha reedes ha, ontiou an thth erndes reti. Tionrean eres the arethorndor that."
    page = (
        "<html><head><title>t</title></head><body><header class='site'><h2>Name</h2></header>"
        "<div class='cookie banner'><p>We use them.</p></div><main><h1>Head line</h1>"
        f"<p>{text}</p><p>{text}</p><p>{text}</p><aside class='sidebar'><p>Aside from it.</p></aside><p>{text}</p></main>"
        "<section class='comments'><h3>Comments</h3><p>I like it.</p><p>So do I.</p></section>"
        "<form class='newsletter'><p>Your mail</p></form><footer><p>All rights</p></footer></body></html>"
    )
    blocks = html_text.blocks_of(page)
    (chances,) = labeller.chances([html_text.vectors(blocks)])
    kept = [b.text for b, chance in zip(blocks, chances, strict=True) if chance >= 0.5]
    assert kept == ["Head line", text, text, text, text]


def test_pages_odd_rows(spark, labeller):
    schema = "page_id long, url string, html string, text double"
    rows = [(1, None, None, 1.0), (None, "u", "", None), (3, "u", "<article><p>x</p></article>", 0.0)] * 2
    found = html_text.main_text(spark.createDataFrame(rows, schema), labeller).collect()
    assert len(found) == 6
    assert [r.text for r in found if r.page_id != 3] == [""] * 4
    assert html_text.main_text(spark.createDataFrame([], schema), labeller).count() == 0
    untrained = html_text.fit(spark.createDataFrame([], schema))
    assert html_text.main_text(spark.createDataFrame(rows, schema), untrained).count() == 6


# --- decontamination --------------------------------------------------------------------


def plain_words(text):
    out, word = [], ""
    for ch in text or "":
        if ch.isascii() and not ch.isalnum():
            out, word = (out + [word], "") if word else (out, "")
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return out + [word] if word else out


def weighted(a, b, weight):
    names = set(a) | set(b)
    low = sum(weight(n) * min(a.count(n), b.count(n)) for n in names)
    return low / sum(weight(n) * max(a.count(n), b.count(n)) for n in names)


def plain_matches(rows, items):
    """Every window of every item's size against the item."""
    grams = {}
    for item, text in items:
        w = plain_words(text)
        grams[item] = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    shared = {}
    for g in grams.values():
        for name in set(g):
            shared[name] = shared.get(name, 0) + 1
    weight = lambda n: np.log1p(len(items) / max(1, shared.get(n, 0)))
    out = {}
    for i, text in rows:
        w = plain_words(text)
        own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        found = {}
        for item, g in grams.items():
            for s in range(max(1, len(own) - len(g) + 1)):
                window = own[s : s + len(g)]
                if g and set(g) & set(window):
                    found[item] = max(found.get(item, 0), weighted(g, window, weight))
        out[i] = {k: v for k, v in found.items() if v >= 0.8}
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_decontamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontamination, "ITEM_WORDS", block_words)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(rng.choice([16, 40, 60])))) for k in range(6)]
    items += [(90, "too short"), (91, None), (92, items[0][1])]
    rows = []
    for k in range(40):
        text = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            planted = items[rng.randrange(6)][1].split()
            for _ in range(k // 2 % 4):
                planted[rng.randrange(len(planted))] = word()
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() if k % 3 else w + "," for w in planted]
        rows.append((k, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1])]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, item_ids double")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = decontamination.contamination(frame, bench).collect()
    assert len(found) == len(rows)
    if block_words > 60:  # weights are of a block's items: with one block the model is the whole
        want = plain_matches(rows, [(i, t) for i, t in items if t is not None])
        for r in found:
            assert list(r.item_ids) == sorted(want[r.doc_id])
            assert abs(r.similarity - max(want[r.doc_id].values(), default=0)) < 1e-9
    whole = {i for i, t in rows if any(" ".join(plain_words(x)) in " ".join(plain_words(t)) for _, x in items[:6])}
    assert whole <= {r.doc_id for r in found if r.contaminated}
    clean = decontamination.clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in found if not r.contaminated)


def test_decontamination_odd_rows(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(docs, none).collect())
    assert decontamination.clean(docs, none).count() == len(rows)
    assert decontamination.contamination(no_docs, none).count() == 0
    long_text = next(t for _, t, *_ in rows if t and len(t) > 1500)
    bench = spark.createDataFrame([(None, long_text)], "item_id long, text string")
    found = decontamination.contamination(docs, bench).collect()
    assert sum(r.contaminated for r in found) >= 1
    assert decontamination.clean(docs, bench).count() == sum(not r.contaminated for r in found)


@pytest.mark.parametrize("block_words", [3, 1 << 20])
def test_items_shorter_than_a_shingle(spark, monkeypatch, block_words):
    """One shingle as a whole; equal items are all named, a missing item_id by a null."""
    monkeypatch.setattr(decontamination, "ITEM_WORDS", block_words)
    items = [(4, "Alpha beta, gamma delta"), (2, "alpha BETA gamma delta"), (None, "beta gamma"), (7, "omega"), (8, ""),
             (9, "one two three four five six")]
    texts = ["alpha beta gamma delta", "x alpha beta y gamma delta", "zz beta\ngamma zz", "omega", "omegas betagamma",
             "", None, "one two three four five six", "one two three four five", "alpha beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontamination.contamination(docs, bench).collect()}
    want = {}
    for k, text in enumerate(texts):
        whole = " " + " ".join(plain_words(text)) + " "
        hits = [i for i, t in items if t and " " + " ".join(plain_words(t)) + " " in whole]
        want[k] = sorted(hits, key=lambda i: (i is not None, i or 0))
    assert found == want and want[0] == [None, 2, 4] and want[3] == [7]
    kept = {r.doc_id for r in decontamination.clean(docs, bench).collect()}
    assert kept == {k for k, hits in want.items() if not hits}
    few = decontamination.contamination(docs, bench, shortest=4)
    assert {r.doc_id for r in few.where("contaminated").collect()} == {0, 7}


def test_probes_guarantee_the_radius():
    rng = np.random.default_rng(3)
    words = " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(30))
    items = decontamination.Items.of([(1, words)], 5)
    own = int(items.prints[0])
    for _ in range(300):
        bits = rng.choice(64, int(rng.integers(0, 30)), replace=False)
        value = own
        for b in bits:
            value ^= 1 << int(b)
        assert items.within(len(items.grams[0]), value, 20) == ([0] if len(bits) <= 20 else [])


def test_long_page_does_not_widen_the_others(monkeypatch):
    """Arrays stay within the budget of blocks, or hold one page; a longer page goes in pieces."""
    model, sizes, pad = html_text.Labeller.fresh(), [], html_text.padded
    rng = np.random.default_rng(2)
    pages = [rng.random((n, html_text.WIDTH)).astype(np.float32) for n in (0, 3, 700, 5, 4, 9)]
    want = [model.chances([p])[0] for p in pages]

    def recorded(some):
        x, mask = pad(some)
        sizes.append(mask.size)
        return x, mask

    monkeypatch.setattr(html_text, "CELLS", 40)
    monkeypatch.setattr(html_text, "padded", recorded)
    for a, b in zip(model.chances(pages), want, strict=True):
        assert np.allclose(a, b, atol=1e-5)
    assert max(sizes) == 700 and sum(sizes) < 760
    blocks = [html_text.Block(("html", "body", "p"), f"word {k} and more.", 0) for k in range(130)]
    (whole,) = model.chances([html_text.vectors(blocks)])
    for got in model.chances_of([blocks[:7], blocks])[1:]:
        assert np.allclose(got, whole, atol=1e-5)


def test_labeller_without_short_pages(spark):
    """Long pages are learnt from; where there is nothing to learn, pages keep all their text."""
    page = "<html><body><nav><ul><li>Home</li></ul></nav><article>{}</article><footer><p>All rights</p></footer></body></html>"
    rows = [(k, "u", page.format(f"<p>{'A long sentence of the article. ' * 400}</p>" * 9)) for k in range(4)]
    schema = "page_id long, url string, html string"
    assert min(len(r[2]) for r in rows) > html_text.LONGEST
    model = html_text.fit(spark.createDataFrame(rows, schema))
    assert not np.array_equal(model.weights["out"], html_text.Labeller.fresh().weights["out"])
    nothing = html_text.fit(spark.createDataFrame([(1, "u", ""), (2, "u", None)], schema))
    (found,) = html_text.main_text(spark.createDataFrame([(1, "u", page.format("<p>Text</p>"))], schema), nothing).collect()
    assert found.text == "Home\nText\nAll rights" and found.n_main == found.n_blocks


@pytest.mark.parametrize(("page", "texts"), [
    ('<p data-x="1 > 0">hello</p>', ["hello"]),
    ("<p data-x='a > b' title = \"c > d\">hello</p>", ["hello"]),
    ('<p>see <a title="x > y" href=/z>this</a> one</p>', ["see this one"]),
    ('<p class=a"b>odd</p><p title="open>rest</p>', ["odd", "rest"]),
    ("<p a=1 b = 2>plain</p><p =>x</p>", ["plain", "x"]),
    ('<img alt="a > b"><p>after', ["after"]),
])
def test_quoted_values_do_not_end_a_tag(page, texts):
    assert [block.text for block in html_text.blocks_of(page)] == texts


def test_a_class_behind_a_quoted_sign_is_seen():
    (block,) = html_text.blocks_of("""<div data-json='{"a":">"}' class=sidebar>y</div>""")
    assert block.text == "y" and "sidebar" in block.path[-1]


class Outline(HTMLParser):
    """The blocks of well-formed pages, from another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.blocks = [], "", []

    def cut(self):
        if self.text.split():
            self.blocks.append((tuple(self.open), " ".join(self.text.split())))
        self.text = ""

    def handle_starttag(self, tag, attributes):
        if tag in html_text.BLOCKS:
            self.cut()
            words = [w for key, value in attributes if key in ("class", "id", "role") for w in re.findall("[a-z]+", value)]
            self.open.append(".".join([tag, *map(html_text.stem, words)]))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
            self.open.pop()

    def handle_data(self, data):
        self.text += data


@pytest.mark.parametrize("seed", range(20))
def test_blocks_against_another_parser(seed):
    rng = random.Random(seed)
    values = ["site-nav", "ads", "a > b", "it's", "x=1", "", "post body"]

    def element(depth):
        tag = rng.choice(["div", "section", "article", "ul", "blockquote", "nav", "main"])
        attributes = ""
        for key in rng.sample(["class", "id", "role", "data-x", "title"], rng.randint(0, 3)):
            attributes += f' {key} = "{rng.choice(values)}"' if rng.random() < 0.7 else f" {key}='{rng.choice(values[:3])}'"
        inner = ""
        for _ in range(rng.randint(0, 4)):
            if depth and rng.random() < 0.6:
                inner += element(depth - 1)
            else:
                inner += rng.choice([" some  text ", "a &lt; b &amp;c", '<a title="x > y" href=/>link</a>', "<b>x</b>\n", "1 > 0 "])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    page = "".join(element(5) for _ in range(4))
    model = Outline()
    model.feed(page)
    model.close()
    model.cut()
    assert [(b.path, b.text) for b in html_text.blocks_of(page)] == model.blocks


def test_deep_pages_take_room_by_their_elements():
    tracemalloc.start()
    blocks = html_text.blocks_of('<div class="post body">x' * 50_000 + "</div></p>" * 50_000)
    assert len(blocks) == 50_000 and tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    rows = html_text.vectors(blocks, 49_990)
    assert np.array_equal(rows[-1, : html_text.PATH_PLACES], rows[0, : html_text.PATH_PLACES])


def test_chunks_are_cut_by_rows_too():
    at = np.arange(1, 12) * 3
    cuts = list(common.chunks(np.zeros(0, np.uint8), at, most_rows=4))
    assert cuts == [(0, 4), (4, 8), (8, 10)] and list(common.chunks(np.zeros(0, np.uint8), at, 9, 4))[0] == (0, 3)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, executors cannot import this package: all comes with the tasks."""
    root = Path(__file__).resolve().parents[2]
    script = tmp_path / "away.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {str(root)!r})
from tarsift.llm import queries
from tarsift.session import build_session
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
def absent(_):
    try:
        import tarsift
    except ImportError:
        return True
assert spark.sparkContext.parallelize([0], 1).map(absent).first()
for name in ("op4_quality_classifier", "op8_html_extraction", "op9_benchmark_decontamination", "op10_language_id"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 8
