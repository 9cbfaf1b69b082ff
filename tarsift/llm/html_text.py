"""Main text of web pages: a recurrent labeller over the sequence of a page's blocks.

1. A page is cut into its leaf blocks: runs of text between block-level tags, with the path of
   elements (tags, words of class and id) they stand in. Comments, scripts and styles are no
   text; character references are decoded; unclosed elements end as browsers end them.
2. A block is a vector: its path's names and its words hashed to a few dozen places each, and
   some measures (length, links, stops, place on the page).
3. A bidirectional LSTM in numpy reads the sequence of vectors in both directions and gives
   every block its chance to be main text in the context of the whole page.

It is trained on a bounded sample of pages (`SAMPLE`, of at most `LONGEST` bytes) whose labels
come from their own markup (inside article or main, and inside nothing that is known as menu,
header, footer, sidebar, notice, advert, form or comments). Sampled pages are varied: the
article's container takes other usual names, and blocks of the page are set again under other
usual names of such surroundings, inside and outside the article, so that the labeller learns
names and neighbourhood and not one template. At work the labels are the LSTM's alone.

Pages are read whole, in one pass without a shuffle; the model is some thousand numbers. A null
or empty html gives an empty text. Repeated rows get equal texts; null page_id and url are kept.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import chunks, flat, remembered, sent
from tarsift.session import ship_with_tasks

SAMPLE = 300
LONGEST = 100_000
EPOCHS = 7
VARIANTS = 6
HIDDEN = 20
PATH_PLACES = 256
WORD_PLACES = 24
MEASURES = 8
WIDTH = PATH_PLACES + WORD_PLACES + MEASURES
#: Pages whose blocks are labelled together, their bytes (or one page), and the blocks, with
#: padding, of one array; a page with more blocks is labelled in pieces.
TOGETHER = 256
TOGETHER_BYTES = 1 << 20
CELLS = 1 << 15

# HTML's block-level elements, those without an end tag, and what closes what.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements in which the search for an element to close ends.
BARRIERS = frozenset("ul ol dl table select body html article section div nav aside main form".split())
PARAGRAPH_STAYS = frozenset("button option optgroup noscript".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*?)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")

# Usual names of surroundings, by what they hold; the words are what class and id are made of.
MAIN_PLACES = ("article", "main", "main.content", "div.content", "div.article", "div.post", "div.entry", "section.article",
               "div.story", "div.main")
OTHER_PLACES = {
    "menu": ("nav", "ul.menu", "div.nav", "div.menu", "nav.navbar", "div.breadcrumb", "ul.navigation", "div.toc"),
    "header": ("header", "div.header", "div.masthead", "div.topbar", "header.site", "div.logo"),
    "footer": ("footer", "div.footer", "footer.site", "div.copyright", "div.legal", "div.bottom"),
    "sidebar": ("aside", "div.sidebar", "aside.sidebar", "div.widget", "div.related", "section.related", "div.recommended"),
    "notice": ("div.notice", "div.cookie", "div.banner", "div.alert", "div.consent", "div.popup", "div.modal",
               "noscript", "dialog", "div.notification", "div.warning", "div.subscribe", "div.gdpr", "section.notice"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsor", "div.sponsored",
               "div.promo", "section.promotion", "ins.adsbygoogle", "div.adbox"),
    "form": ("form", "form.search", "div.form", "form.login", "fieldset", "form.newsletter", "div.newsletter", "select",
             "button", "textarea", "div.login"),
    "comments": ("div.comments", "section.comments", "div.comment", "ol.comments", "ul.commentlist", "div.discussion",
                 "div.replies", "div.reply", "div.disqus", "article.comment", "li.comment", "section.responses",
                 "div.reader"),
    "share": ("div.share", "div.social", "div.tag", "div.meta", "div.byline", "div.pagination", "div.pager"),
    "head": ("title", "head"),
}
#: Words that stand beside those in real names (site-nav, post-comments, ad-slot) and mean nothing.
FILLERS = ("site", "main", "post", "box", "list", "bar", "wrap", "inner", "block", "area", "top", "container", "slot", "item")


def stem(word: str) -> str:
    """A class word without a plural's s: comments and comment are one name."""
    return word[:-1] if len(word) > 2 and word.endswith("s") else word


def stemmed(place: str) -> str:
    tag, *words = place.split(".")
    return ".".join([tag, *map(stem, words)])


OTHER_PLACES = {kind: tuple(map(stemmed, places)) for kind, places in OTHER_PLACES.items()}
OTHER_NAMES = frozenset(
    part
    for places in OTHER_PLACES.values()
    for place in places
    for part in place.split(".")
    if part not in ("div", "section", "article", "ul", "ol", "li", "ins", *FILLERS)
)


#: Bits of a path's purposes.
MAIN, OTHER, TITLE = 1, 2, 4


class Place:
    """An open element: its parent, and the places of all names on its path as the bits of a number.

    Elements share their parents, so that a page takes room by its elements and not by their depth.
    """

    __slots__ = ("parent", "tag", "name", "bits", "purpose")

    def __init__(self, parent: Place | None, name: str):
        self.parent, self.name, self.tag = parent, name, name.split(".", 1)[0]
        self.bits = (parent.bits if parent else 0) | name_bits(name)
        self.purpose = (parent.purpose if parent else 0) | purpose(name)

    @classmethod
    def of(cls, path: tuple[str, ...]) -> Place | None:
        place = None
        for name in path:
            place = cls(place, name)
        return place


@dataclass
class Block:
    place: Place | tuple[str, ...] | None  # the innermost element, or the names of its path
    text: str
    links: int = 0

    def __post_init__(self) -> None:
        if isinstance(self.place, tuple):
            self.place = Place.of(self.place)

    @property
    def path(self) -> tuple[str, ...]:
        """Outermost first; each a tag with the words of its class and id."""
        out, place = [], self.place
        while place:
            out.append(place.name)
            place = place.parent
        return tuple(reversed(out))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    stack: list[Place] = []
    opened: dict[str, list[int]] = {}  # where on the stack each tag stands
    barriers: list[int] = []
    pieces: list[str] = []
    state = {"anchor": 0, "links": 0}

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, state["links"]))
            pieces.clear()
        state["links"] = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BARRIERS:
                barriers.pop()

    def close(tags: tuple[str, ...], most: int = 1) -> None:
        """Ends the innermost of these elements that no barrier hides, and the next if most is 2."""
        for _ in range(most):
            k = max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
            if k < 0 or (barriers and k < barriers[-1]):
                return
            cut(k)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if state["anchor"]:
                state["links"] += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m["end"])
        if tag == "a":
            state["anchor"] = 0 if ends else 1
            continue
        if tag not in BLOCKS:
            if tag == "br":
                pieces.append(" ")
            continue
        flush()
        state["anchor"] = 0
        if ends:
            if opened.get(tag):
                cut(opened[tag][-1])
            continue
        if tag not in PARAGRAPH_STAYS:
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag], most=2)
        if tag not in VOID:
            opened.setdefault(tag, []).append(len(stack))
            if tag in BARRIERS:
                barriers.append(len(stack))
            stack.append(Place(stack[-1] if stack else None, named(tag, m["rest"])))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


@remembered(4096)
def named(tag: str, attributes: str) -> str:
    """The tag, and the words of its class, id and role."""
    words = [stem(p) for found in NAMES.findall(attributes) for p in PARTS.findall("".join(found).lower())]
    return ".".join([tag, *words]) if words else tag


def place_of(word: str, places: int) -> int:
    return crc32(word.encode()) % places


@remembered(4096)
def name_bits(name: str) -> int:
    """The places of a name's parts, as bits."""
    bits = 0
    for part in name.split("."):
        bits |= 1 << place_of(part, PATH_PLACES)
    return bits


@remembered(4096)
def purpose(name: str) -> int:
    """What the markup says by this name, for training only."""
    parts = name.split(".")
    main = MAIN if any(p in ("article", "main") for p in parts) else 0
    return main | (OTHER if any(p in OTHER_NAMES for p in parts) else 0) | (TITLE if name == "title" else 0)


@remembered(4096)
def innermost_bits(*tags: str) -> int:
    """The places that the innermost two elements have for themselves, innermost first."""
    bits = 0
    for k, tag in enumerate(tags):
        bits |= 1 << place_of(f"{k}:{tag}", PATH_PLACES)
    return bits


def path_row(place: Place | None) -> np.ndarray:
    """1 at each place of a path's names; the innermost two stand for themselves too."""
    bits = 0
    if place:
        inner = (place.tag, place.parent.tag) if place.parent else (place.tag,)
        bits = place.bits | innermost_bits(*inner)
    return np.unpackbits(np.frombuffer(bits.to_bytes(PATH_PLACES // 8, "little"), np.uint8), bitorder="little")


def vectors(blocks: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
    """Of the blocks of a page, or of some of them."""
    some = blocks[first:end]
    out = np.zeros((len(some), WIDTH), np.float32)
    for k, block in enumerate(some, first):
        text, row = block.text, out[k - first]
        row[:PATH_PLACES] = path_row(block.place)
        some = text.split()
        places = np.bincount([word_place(word) for word in some], minlength=WORD_PLACES)
        row[PATH_PLACES : PATH_PLACES + WORD_PLACES] = places / len(some)
        size = len(text)
        stops = text.count(".") + text.count(",")
        row[-MEASURES:] = (
            np.log1p(size) / 8, min(1.0, block.links / size), k / len(blocks), 1 / (1 + k), 1 / (len(blocks) - k),
            min(1.0, 5 * stops / (1 + len(some))), text[-1] in ".!?", size / (10 * (1 + len(some))),
        )
    return out


@remembered(65536)
def word_place(word: str) -> int:
    return place_of(word.lower(), WORD_PLACES)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions (input, recurrent, bias; gates i, f, o, g) and of the answer."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 11) -> Labeller:
        rng, w = np.random.default_rng(seed), {}
        for way in "fb":
            w[way + "x"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            w[way + "h"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[way + "b"] = np.zeros(4 * HIDDEN, np.float32)
            w[way + "b"][HIDDEN : 2 * HIDDEN] = 1
        w["out"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        w["ob"] = np.zeros(1, np.float32)
        return cls(w)

    def run(
        self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None
    ) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN); x: (steps, pages, WIDTH). state: where the piece
        before ended (empty: none), and then where this one did."""
        w, (steps, pages) = self.weights, mask.shape
        ready = x @ w[way + "x"] + w[way + "b"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        if state:
            h, c = state
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = ready[t] + h @ w[way + "h"]
            gates, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            live = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new))
            c = np.where(live, new, c)
            h = np.where(live, o * np.tanh(new), h)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of main text, by page and block."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        for some in grouped([len(p) for p in pages], order):
            x, mask = padded([pages[k] for k in some])
            both = np.concatenate((self.run("f", x, mask), self.run("b", x, mask)), axis=2)
            chance = sigmoid(both @ self.weights["out"] + self.weights["ob"])[:, :, 0]
            for j, k in enumerate(some):
                out[k] = chance[: len(pages[k]), j]
        return out

    def chances_of(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """As chances, from the blocks; never more than CELLS vectors of one page at once."""
        short = iter(self.chances([vectors(b) for b in pages if len(b) <= CELLS]))
        return [next(short) if len(b) <= CELLS else self.in_pieces(b) for b in pages]

    def in_pieces(self, blocks: list[Block]) -> np.ndarray:
        both = np.zeros((len(blocks), 2 * HIDDEN), np.float32)
        cuts = range(0, len(blocks), CELLS)
        for way, order, at in (("f", cuts, 0), ("b", reversed(cuts), HIDDEN)):
            state: list = []
            for a in order:
                x = vectors(blocks, a, a + CELLS)[:, None]
                both[a : a + len(x), at : at + HIDDEN] = self.run(way, x, np.ones(x.shape[:2], bool), state=state)[:, 0]
        return sigmoid(both @ self.weights["out"] + self.weights["ob"])[:, 0]

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by backpropagation through time."""
        w = self.weights
        x, mask = padded(pages)
        want, _ = padded([y[:, None].astype(np.float32) for y in labels])
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.run(way, x, mask, kept[way]) for way in "fb"], axis=2)
        chance = sigmoid(both @ w["out"] + w["ob"])
        error = (chance - want) * mask[:, :, None] / mask.sum()
        grad = {"out": np.einsum("tph,tpo->ho", both, error), "ob": error.sum((0, 1))}
        down = error @ w["out"].T
        for way, part in (("f", down[:, :, :HIDDEN]), ("b", down[:, :, HIDDEN:])):
            for name in "xhb":
                grad[way + name] = np.zeros_like(w[way + name])
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h, c, i, f, o, g, new in reversed(kept[way]):
                live = mask[t][:, None]
                dh = dh + part[t]
                tanh = np.tanh(new)
                dnew = np.where(live, dh * o * (1 - tanh**2) + dc, 0)
                dz = np.concatenate(
                    (
                        dnew * g * i * (1 - i),
                        dnew * c * f * (1 - f),
                        np.where(live, dh * tanh * o * (1 - o), 0),
                        dnew * i * (1 - g**2),
                    ),
                    axis=1,
                )
                grad[way + "x"] += x[t].T @ dz
                grad[way + "h"] += h.T @ dz
                grad[way + "b"] += dz.sum(0)
                dc = np.where(live, dnew * f, dc)
                dh = np.where(live, dz @ w[way + "h"].T, dh)
        return grad


def grouped(sizes: list[int], order: list[int]) -> Iterator[list[int]]:
    """The pages with blocks, in this order (shortest first): at most 64, and CELLS padded blocks or one page."""
    some: list[int] = []
    for k in order:
        if some and (len(some) == 64 or (len(some) + 1) * sizes[k] > CELLS):
            yield some
            some = []
        if sizes[k]:
            some.append(k)
    if some:
        yield some


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = True
    return x, mask


def markup_says(block: Block) -> bool:
    """The training label: in article or main, and in nothing of another purpose."""
    return bool(block.place) and block.place.purpose & (MAIN | OTHER) == MAIN


def varied(blocks: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page under other names: its article's container, and more surroundings in and around it."""
    labels = [markup_says(b) for b in blocks]
    place = MAIN_PLACES[rng.integers(len(MAIN_PLACES))]
    if rng.random() < 0.3:
        place = f"{place}.{FILLERS[rng.integers(len(FILLERS))]}"
    wrap = ("html", "body", *(["div.page"] if rng.random() < 0.3 else []))
    inner = ((), (), ("section",), ("div",), ("div.body",))[rng.integers(5)]
    out, marks = [], []
    kinds = list(OTHER_PLACES)

    def surrounding(inside: bool) -> None:
        kind = kinds[rng.integers(len(kinds))]
        if kind == "head" or (inside and kind == "header"):
            return
        options = OTHER_PLACES[kind]
        outer = (*wrap, place, *inner) if inside else wrap
        name = options[rng.integers(len(options))]
        if "." in name and rng.random() < 0.4:
            name = f"{name}.{FILLERS[rng.integers(len(FILLERS))]}"
        leaf = (("p",), ("div",), (), ("ul", "li"), ("h2",), ("h3",), ("blockquote", "p"))[rng.integers(7)]
        for _ in range(rng.integers(1, 5)):
            source = blocks[rng.integers(len(blocks))]
            out.append(Block((*outer, name, *leaf), source.text, len(source.text) if kind in ("menu", "share") else 0))
            marks.append(False)

    keep_own = rng.random() < 0.5
    for k, (block, main) in enumerate(zip(blocks, labels, strict=True)):
        if main:
            if not (marks and any(marks)):
                for _ in range(rng.integers(3)):
                    surrounding(False)
            leaf = block.place.tag if block.place else "p"
            if leaf == "p" and rng.random() < 0.15:
                leaf = ("h2", "h3", "blockquote", "pre", "figcaption", "td")[rng.integers(6)]
            nested = ("ul", "li") if rng.random() < 0.15 else (leaf,)
            out.append(Block((*wrap, place, *inner, *nested), block.text, block.links))
            marks.append(True)
            if rng.random() < 0.07:
                surrounding(True)
        elif keep_own or (block.place and block.place.purpose & TITLE) or rng.random() < 0.5:
            out.append(block)
            marks.append(False)
        if k + 1 < len(labels) and main and not any(labels[k + 1 :]):
            for _ in range(rng.integers(2)):
                surrounding(True)
    for _ in range(rng.integers(3)):
        surrounding(False)
    return out, np.array(marks, bool)


def train(pages: list[str], seed: int = 11) -> Labeller:
    rng, labeller = np.random.default_rng(seed), Labeller.fresh(seed)
    xs, ys = [], []
    for page in pages:
        blocks = blocks_of(page)
        if not blocks:
            continue
        for some, marks in [(blocks, np.array([markup_says(b) for b in blocks]))] + [
            varied(blocks, rng) for _ in range(VARIANTS)
        ]:
            if some:
                xs.append(vectors(some))
                ys.append(marks)
    if not xs:  # nothing to learn from: every chance is 0.5, and pages keep all their text
        return Labeller({k: np.zeros_like(v) for k, v in labeller.weights.items()})
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in labeller.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = np.argsort([len(x) + rng.random() * 8 for x in xs])
        groups = [order[a : a + 16] for a in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)):
            step += 1
            some = groups[g]
            grad = labeller.gradients([xs[k] for k in some], [ys[k] for k in some])
            for name, value in grad.items():
                one, two = moments[name]
                one += 0.1 * (value - one)
                two += 0.001 * (value**2 - two)
                rate = 0.01 * (1 - epoch / EPOCHS) ** 0.5
                labeller.weights[name] -= (
                    rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
                ).astype(np.float32)
    return labeller


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """The labeller from about `sample` pages, chosen by a hash of page_id; of longer ones it learns from the beginning."""
    total = pages.count()
    uniform = F.pmod(F.xxhash64(F.lit("page"), F.col("page_id").cast("long")), F.lit(1 << 30)) / float(1 << 30)
    rows = (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.substring(F.col("html").cast("string"), 1, LONGEST).alias("html")
        )
        .where(F.col("html").isNotNull())
        .withColumn("page_id", F.coalesce("page_id", F.lit(0)))
        .where(uniform < min(1.0, sample / max(1, total)))
        .limit(2 * sample)
        .toArrow()
        .sort_by([("page_id", "ascending"), ("html", "ascending")])
    )
    return train(rows["html"].to_pylist())


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_blocks (of the page), n_main (of the text), by row."""
    shared = sent(pages.sparkSession, labeller)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared()
        for whole in batches:
            for batch in slices(whole):
                found = [blocks_of(t or "") for t in batch.column(2).to_pylist()]
                chances = labeller.chances_of(found)
                kept = [
                    [b.text for b, chance in zip(own, by, strict=True) if chance >= 0.5]
                    for own, by in zip(found, chances, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(["\n".join(k) for k in kept], pa.string()),
                        pa.array([len(b) for b in found], pa.int32()),
                        pa.array([len(k) for k in kept], pa.int32()),
                    ],
                    ["page_id", "url", "text", "n_blocks", "n_main"],
                )

    def slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = flat(whole.column(2))[1]
        for a, b in chunks(np.zeros(0, np.uint8), at, TOGETHER_BYTES):
            for k in range(a, b, TOGETHER):
                yield whole.slice(k, min(TOGETHER, b - k))

    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return chosen.mapInArrow(scan, "page_id long, url string, text string, n_blocks int, n_main int")


ship_with_tasks(__name__)
