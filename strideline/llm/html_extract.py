"""HTML extraction: flat text blocks, classified by a decision tree over words and links of a block and its neighbours.

A page becomes a flat list of text blocks, cut at block-level tags. A block's features are its word count and link
density, those of the two blocks before and the two after it, whether it or a neighbour is a heading or a list item, and
one input for what its containers say (1: an article, -1: a menu, a class such as "sidebar", 0: nothing). A decision
tree that Spark trains on a small labelled table (``labelled_pages``, written-out layouts with fillers of varying
length) decides which blocks are main text; it is flattened into arrays and applied to a batch of pages at once.

Null and empty pages give an empty text; broken or cut-off markup is read as far as it goes. White space is what
``str.split`` takes for it, so a non-breaking space becomes a space too. Repeated rows are extracted alike; extra columns
are not returned, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm.quality import Trees, flatten_tree

# Element names of HTML, and words that pages use for classes, ids and roles.
SKIPPED = "script style template noscript textarea title select button".split()
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section search table td th ul".split())
SPACED = frozenset("br td th wbr img input".split())
MAIN_TAGS = frozenset("article main".split())
PLAIN_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story body".split())
PLAIN_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply search share sharing side sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
#: Words that may also name a part of the article, so they say nothing inside one.
WITHIN = frozenset("header banner search tags side form content main body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<({'|'.join(SKIPPED)})(?![\w-])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.IGNORECASE)
SEPARATOR = re.compile(r"[^a-z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)


#: Layouts for training: on each line the labels of its blocks, then markup with {n} words and links of [n] words.
LAYOUTS = """
11 <article><h1>{7}</h1><p>{45}</p>
1 <p>{60}</p>
1 <p>{3}</p>
1 <p>{30} [2] {20}</p></article>

00000 <nav><ul><li>[1]</li><li>[1]</li><li>[2]</li><li>[1]</li><li>[1]</li></ul></nav>
0 <div class="ad">{9}</div>
11 <article><h1>{9}</h1><p>{60}</p>
1 <p>{1}</p>
11 <p>{2}</p><p>{30}</p>
1 <p>{80}</p></article>
0 <footer>{9}</footer>

000 <div class="top"><ul><li>[1]</li><li>[2]</li><li>[1]</li></ul></div>
0 <div>{10}</div>
11 <div class="wrap"><h1>{8}</h1><p>{55}</p>
111 <p>{70}</p><p>{5}</p><p>{40}</p>
1 <p>{90}</p></div>
0 <div>{9}</div>

0 <div id="cookie-notice"><p>{22} [2]</p></div>
00 <header><div>{3}</div><p>{6}</p></header>
0000 <nav><a href="/">{1}</a><ul><li>[1]</li><li>[2]</li><li>[1]</li></ul></nav>
11 <main><h1>{6}</h1><p>{50}</p>
111 <h2>{4}</h2><p>{40} [3] {10}</p><ul><li>{9}</li>
11 <li>{7}</li><li>{12}</li></ul>
1 <p>{35}</p></main>
000 <aside><h3>{2}</h3><p>[5]</p><p>[6]</p></aside>
0 <footer>{6} [1] [1]</footer>

0000 <ul><li>[2]</li><li>[1]</li><li>[2]</li><li>[1]</li></ul>
11 <h1>{7}</h1><p>{48}</p>
11 <p>{9}</p><p>{52}</p>
11 <h2>{4}</h2><p>{60}</p>
1 <p>{44}</p>
0000 <h4>{2}</h4><ul><li>[5]</li><li>[6]</li><li>[4]</li></ul>
0 <p>{8} [2]</p>

0 <p>{24} [2] [2]</p>
00 <div>[2]</div><div>[1]</div>
1 <div><div><h1>{9}</h1></div>
11 <div><p>{50}</p></div><div><p>{45} [2] {10}</p></div>
1 <div><p>{65}</p></div></div>
00000 <div><h3>{2}</h3><div>[4]</div><div>[5]</div><div>[6]</div><div>[3]</div></div>
000 <div>[1]</div><div>[1]</div><div>{7}</div>

0 <header><h1>{2}</h1></header>
00 <div class="menu"><p>[1]</p><p>[2]</p></div>
11 <div class="post"><h2>{7}</h2><p>{40}</p>
111 <p>{70}</p><blockquote>{20}</blockquote><p>{33}</p></div>
00000 <div class="comments"><h3>{2}</h3><p>{20}</p><p>{44}</p><p>{12}</p><p>{4}</p></div>
00 <form><p>{6}</p><p>{10}</p></form>
0 <footer><p>{15}</p></footer>

11 <article class="story"><header><h1>{8}</h1><p>{12}</p></header>
11 <div class="entry-header"><p>{30}</p></div><p>{55}</p>
0 <div class="ad-slot"><p>{14}</p></div>
11 <p>{66}</p><p>{4}</p>
000 <ul class="share"><li>[1]</li><li>[1]</li><li>[1]</li></ul>
0 <footer>{9} [2]</footer></article>
00 <section id="related"><p>[6]</p><p>[7]</p></section>

1 <article><p>{70}</p>
11 <p>{40}</p><p>{9} [3]</p>
1 <p>[6]</p>
11 <p>{50}</p><p>{35}</p>
0000 <ul><li>[4]</li><li>[5]</li><li>[4]</li><li>[6]</li></ul></article>
0 <div class="newsletter">{18}</div>

00 <table><tr><td>[1]</td></tr><tr><td>[2]</td></tr></table>
11 <table><tr><td><h1>{5}</h1><p>{58}</p>
111 <p>{47}</p><p>{15}</p><p>{62}</p></td>
000 <td><p>[3]</p><p>[4]</p><p>[2]</p></td></tr></table>
0 <p>{5} [1] [1] [1]</p>

11 <div><h1>{8}</h1><p>{40}</p>
1 <p>{60}</p>
1 <p>{25}</p></div>
00000 <div><h3>{2}</h3><div>{2}</div><div>{14}</div><div>{2}</div><div>{11}</div></div>
00 <div>{2}</div><div>{9}</div>

1 <div class="sidebar-layout"><div><h1>{8}</h1>
111 <p>{50}</p><p>{44}</p><p>{3}</p>
1 <p>{58}</p></div>
000 <div class="sidebar"><h3>{3}</h3><p>{30}</p><p>[4]</p></div></div>
0 <div>{8}</div>

000 <div class="breadcrumbs"><ol><li>[1]</li><li>[2]</li><li>{2}</li></ol></div>
11 <section class="content"><h1>{6}</h1><p>{9}</p>
11111 <ol><li>{14}</li><li>{8}</li><li>{20}</li></ol><p>{40}</p><p>{30}</p></section>
00 <div role="dialog"><p>{20}</p><p>[2]</p></div>

1 <div class="content"><p>{1}</p></div>
0 <footer>{8}</footer>

11 <article><h1>{5}</h1><p>{40}</p>
1111 <p>{4}</p><p>{2}</p><p>{30}</p><p>{3}</p></article>

000 <ul><li>[1]</li><li>[1]</li><li>[2]</li></ul>
1111 <main><p>{6}</p><p>{1}</p><p>{9}</p><p>{1}</p></main>

11 <article><h1>{3}</h1><p>{4}</p></article>
0 <div class="promo"><p>{25} [3]</p></div>
0 <footer>{4}</footer>

00 <ul><li>[1]</li><li>[1]</li></ul>
0 <div class="ad">{6}</div>
11 <article><h1>{10}</h1><p>{12}</p>
11 <p>{5}</p><p>{2}</p></article>
0 <footer>{9}</footer>

0000 <nav><ul><li>[1]</li><li>[1]</li><li>[1]</li><li>[1]</li></ul></nav>
11 <article><h1>{4}</h1><p>{1}</p>
11111 <p>{2}</p><p>{14}</p><p>{1}</p><p>{1}</p><p>{35}</p>
11111 <p>{4}</p><p>{1}</p><p>{50}</p><p>{2}</p><p>{8}</p>
11111 <p>{1}</p><p>{300}</p><p>{2}</p><p>{20}</p><p>{1}</p>
11111 <p>{9}</p><p>{3}</p><p>{3}</p><p>{120}</p><p>{5}</p>
111 <p>{11}</p><p>{2}</p><p>{16}</p></article>
0 <footer>{7}</footer>

000 <div>[1]</div><div>[2]</div><div>[1]</div>
11 <div><h1>{6}</h1><p>{30}</p>
11111 <p>{5}</p><p>{60}</p><p>{4}</p><p>{7}</p><p>{44}</p>
11111 <p>{8}</p><p>{20}</p><p>{3}</p><p>{150}</p><p>{12}</p>
111 <p>{26}</p><p>{6}</p><p>{35}</p></div>
0 <div>{6}</div>

00 <p>[2] [2] [3]</p><p>{3}</p>
11 <h2>{6}</h2><p>{42}</p>
111 <p>{36}</p><p>{28} [2]</p><p>{51}</p>
0 <p>[1] [1] [2]</p>
11 <h2>{5}</h2><p>{45}</p>
1 <p>{60}</p>
00 <p>[2] [3]</p><p>{6}</p>

1 <div><p>{80}</p>
0 <div>[1] [1]</div>
1 <p>{60}</p></div>

11 <div><p>{60}</p><p>{40}</p>
0 <p>[2] [1]</p>
11 <p>{70}</p><p>{30}</p></div>
"""


@dataclass
class Container:
    """An open element: its name, the cue it gives, and the cue in force inside it."""

    name: str
    cue: int
    says: int
    weak: bool


@dataclass
class Block:
    cues: tuple[int, ...]
    says: int
    heading: int
    item: int
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)

    def close(self) -> Cut:
        text = " ".join(html.unescape("".join(self.parts)).split())
        n = len(text.split())
        return Cut(text, n, min(n, len(html.unescape(" ".join(self.linked)).split())), self.says, self.heading, self.item, self.cues)


@dataclass(frozen=True)
class Cut:
    """A finished block: its text, words, words in links, what its containers say, and whether it is a heading or an item."""

    text: str
    words: int
    linked: int
    says: int
    heading: int
    item: int
    cues: tuple[int, ...]


def cue(name: str, attributes: str, inside: int) -> tuple[int, bool]:
    """What a container says by its tag or its class, id and role: 1, 0 or -1, and whether only a word says so."""
    if HIDDEN.search(attributes) or (name in PLAIN_TAGS and not (name == "header" and inside > 0)):
        return -1, False
    if name in MAIN_TAGS:
        return 1, False
    said = {w for a in ATTRIBUTE.findall(attributes) for x in a if x for w in SEPARATOR.split(x.lower())} if "=" in attributes else set()
    said -= WITHIN if inside > 0 else frozenset()
    return (-1, True) if said & PLAIN_WORDS else (int(bool(said & MAIN_WORDS)), True)


def blocks(page: str) -> list[Cut]:
    """The flat text blocks of a page, in order, without empty ones."""
    stack: list[Container] = []
    out: list[Cut] = []
    now, link, at, count = Block((), 0, 0, 0), False, 0, 0
    wraps: set[int] = set()  # containers named like a side part that hold an article or the first title

    def cut(heading: int = 0, item: int = 0) -> Block:
        if now.parts:
            done = now.close()
            if done.text:
                out.append(done)
        weak = tuple(c.cue for c in stack if c.weak and c.says < 0)
        return Block(weak, stack[-1].says if stack else 0, heading, item)

    def feed(text: str) -> None:
        if text:
            now.parts.append(text)
            if link:
                now.linked.append(text)

    for m in TOKEN.finditer(page):
        feed(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                feed(" ")
            continue
        closes, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name == "a":
            link = not closes
        elif name in SPACED:
            now.parts.append(" ")
        if not closes and (name in MAIN_TAGS or name == "h1"):
            wraps.update(c.cue for c in stack if c.weak)
        if name in CONTAINERS:
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                link = False
            elif name != "body":
                inside = stack[-1].says if stack else 0
                says, weak = cue(name, attributes, inside)
                count += 1
                stack.append(Container(name, count, inside if inside < 0 or not says else says, weak and says < 0))
        if name in BLOCKS:
            now = cut(int(len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closes), int(name == "li" and not closes))
    feed(page[at:])
    cut()
    return [replace(b, says=0) if b.says < 0 and b.cues and wraps.issuperset(b.cues) else b for b in out]


FEATURES = "words density words_before density_before words_after density_after words_before2 density_before2 words_after2 density_after2 heading item heading_before heading_after containers".split()


def features(page: list[Cut]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; where there is no neighbour, a block without words."""
    n = len(page)
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked for b in page], float) / np.maximum(1, words)
    heading = np.array([b.heading for b in page], float)

    def beside(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([np.zeros(2), x, np.zeros(2)])[2 + by : 2 + by + n]

    near = [beside(x, by) for by in (-1, 1, -2, 2) for x in (words, density)]
    return np.column_stack([words, density, *near, heading, [b.item for b in page], beside(heading, -1), beside(heading, 1), [b.says for b in page]])


def _fill(layout: str, seed: int) -> str:
    """The layout with {n} as about n words and [n] as a link of about n words."""

    def words(n: int, k: int) -> str:
        n = max(1, n + (seed * 7 + k * 5) % max(1, n // 2 + 1) - n // 4)
        return " ".join("word" + "s" * ((i * 7 + k + seed) % 5) for i in range(n))

    return re.sub(r"[{\[](\d+)[}\]]", lambda m: words(int(m[1]), m.start()) if m[0][0] == "{" else f'<a href="/x">{words(int(m[1]), m.start())}</a>', layout)


def labelled_pages(layouts: str = LAYOUTS, variants: int = 8) -> list[tuple[str, list[int]]]:
    """The labelled table: filled layouts, each with the label of every block in order (1: main text)."""
    out = []
    for layout in layouts.strip().split("\n\n"):
        lines = [x.split(" ", 1) for x in layout.split("\n")]
        labels = [int(c) for x, _ in lines for c in x]
        out += [(_fill("".join(x for _, x in lines), seed), labels) for seed in range(variants)]
    return out


def train(spark: SparkSession, use: tuple[str, ...] = tuple(FEATURES)) -> Trees:
    """The tree over the features in ``use``; the others are held at 0."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    mask = np.array([f in use for f in FEATURES], float)
    rows = [(x, float(y)) for page, labels in labelled_pages() for x, y in zip((features(blocks(page)) * mask).tolist(), labels, strict=True)]
    table = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    return flatten_tree(DecisionTreeClassifier(maxDepth=9, minInstancesPerNode=3, maxBins=128, seed=1).fit(table))


def main_texts(pages: list[str | None], tree: Trees) -> list[str]:
    cut = [blocks(p) if p else [] for p in pages]
    full = [b for b in cut if b]
    good = iter((tree.score(np.concatenate([features(b) for b in full])) > 0.5).tolist() if full else [])
    return ["\n\n".join(b.text for b in page if next(good)) for page in cut]


def extract(pages: DataFrame, page: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the key columns, text, and n_chars (code points)."""
    tree = train(pages.sparkSession)
    own = pages.select(*keys, F.col(page).cast("string").alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                text = main_texts(part.column("html").to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keys, "text", "n_chars"])

    schema = own.drop("html").schema.add("text", "string").add("n_chars", "long")
    return own.mapInArrow(scan, schema)
