"""Main text of web pages by a recurrent labeller of leaf blocks.

A page is a sequence of blocks, each described by hashes of the path of its elements (names, words of class and id), by
hashes of its words and by a few numbers on its shape. A bidirectional LSTM reads the whole sequence, so every block is
judged in the context of the whole page. What it labels as main text is joined in the order of the page.

Labels need no annotator. Pages that mark up their article (`article`, `main`) teach: what lies in it and not in furniture
inside it is main text. Each teaching page is also shown in disguise: its blocks in containers with other names, common
class words or none at all, with furniture of all kinds put around and into the article (menus, notices, sidebars, forms,
adverts, readers' comments, made of fixed phrases and of sentences of the same pages). So the labeller does not depend on
`article` being there. It learns from a bounded sample of pages (`SAMPLE`, chosen by a hash of page_id and url); all
pages are read.

Cases: null html counts as empty; a page without text gives an empty text. Every row is a page of its own, whatever its
id. Pages of any length are read whole. If no page marks up an article, the labeller learns from made-up pages of the
table's sentences alone, and without any sentences from those of the fixed phrases. No rows give no rows.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, Node, blocks
from waymark.llm.common import stage
from waymark.llm.recurrent import Labeller

#: Pages that teach at most; copies in disguise of each; buckets of path and word hashes; size of a direction's state.
SAMPLE, DISGUISES, PATHS, WORDS, HIDDEN, EPOCHS = 300, 5, 128, 64, 24, 16
WIDTH = 2 * PATHS + WORDS + 10
#: Steps of a teaching sequence (longer pages are cut into several), blocks computed at once.
WINDOW, AT_ONCE = 200, 20_000

# Words of class and id that pages use for their parts, and phrases found in them
NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb links toolbar tabs",
    "header": "header masthead top branding logo hero site-title",
    "footer": "footer foot bottom copyright legal colophon site-info",
    "sidebar": "sidebar aside widget rail related side secondary popular tags",
    "notice": "cookie consent notice banner alert popup modal gdpr warning message",
    "advert": "ad ads advert advertisement sponsored promo sponsor partner banner-ad",
    "form": "form search login newsletter subscribe signup contact comment-form",
    "comments": "comments comment comment-list discussion responses replies disqus reactions",
    "share": "share social sharing buttons follow",
    "main": "content main post entry article story body text page-content post-body article-body prose",
}
TAGS = {
    "menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section", "td"),
    "notice": ("div", "section", "dialog", "p"), "advert": ("div", "aside", "section"), "form": ("form", "div", "fieldset"),
    "comments": ("section", "div", "ol"), "share": ("div", "ul"), "main": ("article", "article", "main", "div", "section", "td"),
}
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Archive|Help|FAQ|Sport|Politics|Start|Kontakt|Accueil|Inicio",
    "header": "Daily News|My Blog|The Example Times|Welcome to our site|Your source for news|Menu|Skip to content",
    "footer": "Copyright 2024|All rights reserved|Privacy policy|Terms of use|Imprint|Powered by|Sitemap|Impressum|Mentions légales",
    "sidebar": "Related articles|Popular posts|Most read|Tags|Categories|Recent posts|You may also like|Read more|Trending",
    "notice": "We use cookies to improve your experience|Accept all cookies|This site uses cookies|Manage preferences|Accept|Close",
    "advert": "Advertisement|Sponsored|Buy now|Special offer|Sponsored content|Anzeige|Publicité|Publicidad|50 % off today only",
    "form": "Name|E-mail|Your message|Send|Search|Subscribe to our newsletter|Sign up|Password|Log in|Enter your e-mail address|Submit",
    "comments": "Comments|3 comments|Leave a reply|Reply|Posted by anna|2 days ago|Report|Show more comments|Kommentare|Great article!",
    "share": "Share|Tweet|Facebook|Print|E-mail this|Follow us|Share on Twitter|Teilen",
}
#: Elements whose content is furniture wherever they stand; words of class or id that say the same.
FURNITURE = frozenset("nav menu footer aside form dialog fieldset button select label".split())
FURNITURE_WORDS = frozenset(
    word for kind, names in NAMES.items() if kind not in ("main", "header") for name in names.split() for word in name.split("-")
) - frozenset("links top side buttons form site info message related tags popular list".split())


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


class _Buckets(dict):
    """Buckets of words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = _bucket(word, WORDS)
        return found


_BUCKETS = _Buckets()


def _path(node: Node) -> np.ndarray:
    """Hashes of the elements around a block, the nearer the heavier; kept at the node."""
    waiting = []
    while node.mark is None and node.parent is not None:
        waiting.append(node)
        node = node.parent
    if node.mark is None:
        node.mark = np.zeros(PATHS, dtype=np.float32)
    found = node.mark
    for node in reversed(waiting):
        found = 0.8 * found
        for word in (f"<{node.name}", f"<{node.parent.name}<{node.name}", *(f".{word}" for word in node.words)):
            found[_bucket(word, PATHS)] += 1.0
        node.mark = found
    return found


def _own(node: Node) -> list[int]:
    """Buckets of the names of a block's own element and of the one around it, by their place."""
    near = [(f"0{node.name}", *(f"0.{word}" for word in node.words))]
    if node.parent is not None:
        near.append((f"1{node.parent.name}", *(f"1.{word}" for word in node.parent.words)))
    return [_bucket(word, PATHS) for words in near for word in words]


def features(page: list[Block]) -> np.ndarray:
    """One row per block."""
    found = np.zeros((len(page), WIDTH), dtype=np.float32)
    for place, (block, row) in enumerate(zip(page, found, strict=True)):
        text = block.text
        words = text.lower().split()
        row[:PATHS] = _path(block.node)
        bag = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), minlength=WORDS).astype(np.float32)
        row[PATHS : 2 * PATHS][_own(block.node)] = 1.0
        row[2 * PATHS : -10] = bag / np.sqrt((bag * bag).sum())
        size = len(text)
        row[-10:] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 4, block.linked / size, sum(map(str.isdigit, text[:200])) / min(size, 200),
            sum(map(text.count, ".,;!?")) / len(words), text[-1] in ".!?…", text[0].isupper(), min(block.node.depth, 30) / 10,
            min(place, 10) / 10, min(len(page) - place, 10) / 10,
        )
    return found


def taught(page: list[Block]) -> np.ndarray | None:
    """1 for blocks of the marked-up article, 0 for others; None if the page marks up none."""
    labels, known = np.zeros(len(page), dtype=np.float32), False
    for i, block in enumerate(page):
        node, inside, furniture = block.node, False, False
        while node.parent is not None:
            inside |= node.name in ("article", "main")
            furniture |= node.name in FURNITURE or not FURNITURE_WORDS.isdisjoint(node.words)
            node = node.parent
        labels[i] = inside and not furniture
        known |= inside
    return labels if known else None


class _Disguise:
    """Pages made of given main blocks and of furniture, in markup drawn at random."""

    def __init__(self, sentences: list[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.sentences = sentences or [phrase for kind in PHRASES.values() for phrase in kind.split("|")]

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def open(self, kind: str, parent: Node, plain: float = 0.25, tag: str | None = None) -> Node:
        """A container: by name, by class word, or plain."""
        tag = tag or self.one(TAGS[kind])
        name = self.one(NAMES[kind].split())
        words = tuple(name.split("-")) if self.rng.random() > plain or tag in ("div", "section", "td") and self.rng.random() < 0.8 else ()
        if words and self.rng.random() < 0.2:
            words += (self.one(("wrapper", "container", "box", "block", "inner", "area")),)
        return Node(tag, words, parent, parent.depth + 1)

    def phrase(self, kind: str) -> str:
        if self.rng.random() < 0.6:
            return self.one(PHRASES[kind].split("|"))
        words = self.one(self.sentences).split()
        return " ".join(words[: int(self.rng.integers(1, 9))])

    def furniture(self, kind: str, parent: Node) -> list[tuple[Block, int]]:
        top, found = self.open(kind, parent, 0.15), []
        long = kind in ("comments", "notice", "advert", "sidebar", "footer")
        for _ in range(int(self.rng.integers(1, 9 if kind in ("menu", "comments") else 4))):
            usual = {"menu": "li", "share": "li", "form": "label", "comments": "div", "sidebar": "li"}.get(kind, "p")
            draw = self.rng.random()
            inner = self.one(("p", "li", "div", "h2", "h3", "h4", "td", "button")) if draw > 0.6 else usual
            node = Node(inner, (), top, top.depth + 1) if draw > 0.15 else top
            text = self.one(self.sentences) if long and self.rng.random() < 0.5 else self.phrase(kind)
            linked = len(text) if kind in ("menu", "share") or kind in ("sidebar", "footer") and self.rng.random() < 0.5 else 0
            found.append((Block(text, node, linked), 0))
        return found

    def page(self, main: list[Block]) -> tuple[list[Block], np.ndarray]:
        body = Node("body", (), Node("html", (), Node("", (), None, 0), 1), 2)
        rng, found, parent = self.rng, [], body
        if rng.random() < 0.1:  # nothing but text
            top = self.one((body, body.parent.parent))
            return [Block(b.text, Node(b.node.name, (), top, top.depth + 1), b.linked) for b in main], np.ones(len(main), dtype=np.float32)
        for _ in range(int(rng.integers(0, 3))):
            parent = Node("div", (self.one(("page", "wrapper", "container", "site", "layout")),) if rng.random() < 0.6 else (), parent, parent.depth + 1)
        for kind in ("notice", "header", "menu", "advert", "sidebar", "form", "share"):
            if rng.random() < 0.45:
                found += self.furniture(kind, parent)
        article = self.open("main", parent, 0.3)
        if rng.random() < 0.3:
            article = self.open("main", article, 0.3)
        inner = rng.random() < 0.6
        for place, block in enumerate(main):
            if inner and place and rng.random() < 0.12:
                found += self.furniture(self.one(("advert", "share", "form", "notice", "sidebar")), article)
            draw, name, top = rng.random(), block.node.name, article
            if name not in ("p", "h1", "h2", "h3", "h4", "li", "td", "blockquote", "pre", "dd", "figcaption"):
                name = "p"
            if name == "p" and draw < 0.3:
                name = self.one(("li", "td", "h2", "h3", "blockquote", "pre", "figcaption", "dd", "div", "p"))
            holder = {"li": "ul", "td": "tr", "dd": "dl", "figcaption": "figure"}.get(name)
            if holder:
                top = Node(holder, (), article, article.depth + 1)
            if name == "h1" and rng.random() < 0.3:
                top = Node("header", (), article, article.depth + 1)
            text = block.text
            if name != block.node.name and rng.random() < 0.5:  # points of a list, cells and headings are short
                text = " ".join(text.split()[: int(rng.integers(1, 8))])
            found.append((Block(text, Node(name, (), top, top.depth + 1), min(block.linked, len(text))), 1))
        for kind in ("share", "footer", "form", "sidebar", "comments"):
            if inner and rng.random() < 0.4:
                found += self.furniture(kind, article)
        for kind in ("share", "sidebar", "advert", "comments", "form", "notice", "menu", "footer"):
            if rng.random() < 0.45:
                found += self.furniture(kind, parent)
        return [block for block, _ in found], np.array([label for _, label in found], dtype=np.float32)

    def invented(self) -> list[Block]:
        """Main blocks of a page that no page taught: a title and paragraphs of the known sentences."""
        body = Node("body", (), Node("", (), None, 0), 1)
        texts = [" ".join(self.one(self.sentences) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(int(self.rng.integers(2, 15)))]
        return [Block(text, Node("p" if i else "h1", (), body, 2), 0) for i, text in enumerate(texts)]


def _windows(page: list[Block], labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = features(page)
    for first in range(0, len(rows), WINDOW):
        yield rows[first : first + WINDOW], labels[first : first + WINDOW]


def train(pages: list[str], seed: int = 11) -> bytes:
    """The weights of a labeller that learned from these pages and their disguises."""
    teaching = [(page, labels) for page in map(blocks, pages) if (labels := taught(page)) is not None and labels.any()]
    sentences = [block.text for page, _ in teaching for block in page] or [b.text for page in pages for b in blocks(page)]
    disguise = _Disguise(sentences, seed)
    shown = []
    mains = [[block for block, label in zip(page, labels, strict=True) if label] for page, labels in teaching]
    mains = mains or [disguise.invented() for _ in range(SAMPLE)]
    for page, labels in teaching:
        shown += _windows(page, labels)
    for place in range(max(DISGUISES * len(mains), DISGUISES * SAMPLE)):  # few pages are shown in more disguises each
        shown += _windows(*disguise.page(mains[place % len(mains)]))
    model = Labeller(WIDTH, HIDDEN, seed)
    model.fit([rows for rows, _ in shown], [labels for _, labels in shown], EPOCHS, seed=seed)
    return model.dump()


def learn(pages: DataFrame, folder: str, most: int = SAMPLE) -> bytes:
    """Learn from about `most` pages that mark up an article (all, if fewer), in one task; the weights are small."""
    page = F.coalesce("html", F.lit(""))
    marked = pages.where(page.rlike("(?i)<(article|main)[\\s>]"))
    count = marked.count()
    chosen = marked if count else pages
    total = count or pages.count()
    point = F.pmod(F.xxhash64(F.lit("teach"), "page_id", "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = chosen.where(point < F.lit(most / max(total, 1))).select(F.col("page_id").cast("string").alias("page_id"), page.alias("html"), F.lit(0).alias("one"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"weights": [train(rows.sort_values(["page_id", "html"])["html"].tolist())]})

    weights = stage(sample.groupBy("one").applyInPandas(run, "weights binary"), folder, "labeller").first()
    return bytes(weights["weights"]) if weights else train([])


def extract(pages: DataFrame, weights: bytes) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller.load(weights)

        def judged(rows: pd.DataFrame, waiting: list[list[Block]]) -> pd.DataFrame:
            found = model.predict([features(page) for page in waiting])
            texts = [
                "\n".join(block.text for block, p in zip(page, score, strict=True) if p >= 0.5)
                for page, score in zip(waiting, found, strict=True)
            ]
            return rows.assign(text=texts, n_chars=[len(text) for text in texts])

        for batch in batches:
            own, waiting, first, size = batch[["page_id", "url"]], [], 0, 0
            for i, page in enumerate(batch["html"], 1):
                waiting.append(blocks(page))
                size += len(waiting[-1])
                if size >= AT_ONCE or i == len(batch):
                    yield judged(own.iloc[first:i], waiting)
                    waiting, first, size = [], i, 0

    kept = pages.select("page_id", "url")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", text string, n_chars long"
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, schema)
