"""Main text of web pages: a conditional random field over DOM leaf blocks.

A page is read into leaf blocks, each the text between two block-level boundaries, with the
block-level ancestors it stands in.  Blocks are the places of a chain; their features are
the ancestors' tags and class words and a few measures of the text.  Viterbi decoding
labels them main or not.  Text inside elements that are never shown as text (scripts,
styles, the head) makes no block.

The field is trained on labelled pages that are laid out here in many templates, since the
tables have no labels; the words in them say nothing, so they are made by rule.
"""

from __future__ import annotations

import html
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh
from corpusloom.llm.crf import ChainCrf

# Fixed values of HTML.
RAW_TEXT = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements whose text is not part of the page's text.
HIDDEN = frozenset("script style head title noscript iframe noembed noframes template svg annotation annotation-xml".split())
#: Formulas are part of their sentence.
MATH = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mspace msub msup msubsup munder mover "
    "munderover mmultiscripts mtable mtr mtd maction semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button select option input".split()
) | MATH
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")


class Path:
    """A block element and all it lies in: the last tag, and the names of all ancestors.

    Names are shared with the parent unless the element brings a new one, so the paths of a
    page together are as large as what its tags say.
    """

    __slots__ = ("tag", "names")

    def __init__(self, tag: str, own: frozenset, parent: Path | None):
        self.tag = tag
        before = parent.names if parent else frozenset()
        self.names = before if own <= before else before | own


class Block:
    __slots__ = ("parts", "path", "linked", "buttons", "chars")

    def __init__(self, path):
        self.parts, self.path, self.linked, self.buttons, self.chars = [], path, 0, 0, 0


def leaf_blocks(page: str) -> list[tuple[str, tuple, float, bool]]:
    """(text, path, share of linked text, in a control) of the leaf blocks in page order.

    A path names the tags around a block with their class, id and role words.  Unclosed and misplaced tags
    are closed as a browser would, as far as that moves block boundaries.
    """
    stack: list[tuple[str, Path | None]] = []  # tag, the path of its nearest block element
    opened: Counter = Counter()
    blocks: list[Block] = []
    current: Block | None = None
    hidden = links = controls = 0
    at, raw_end, size = 0, None, len(page)

    def count(tag: str, by: int) -> None:
        nonlocal hidden, links, controls
        opened[tag] += by
        hidden += by * (tag in HIDDEN)
        links += by * (tag == "a")
        controls += by * (tag in ("button", "select", "option", "textarea", "label"))

    def text(part: str) -> None:
        nonlocal current
        if hidden or not part:
            return
        if current is None:
            if part.isspace():
                return
            current = Block(stack[-1][1] if stack else None)
            blocks.append(current)
        current.parts.append(part)
        solid = len(part.strip())
        current.chars += solid
        current.linked += solid * bool(links)
        current.buttons += solid * bool(controls)

    def pop_to(index: int) -> None:
        while len(stack) > index:
            count(stack.pop()[0], -1)

    def close_open(tags: set, until: set) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return
            if stack[k][0] in until:
                return

    while at < size:
        if raw_end is not None:  # inside raw text: only its own end tag counts
            found = re.compile(rf"</{raw_end}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = found.start() if found else size
            if raw_end == "textarea":
                text(html.unescape(page[at:stop]))
            at, raw_end = stop, None
            if at >= size:
                break
        mark = page.find("<", at)
        if mark < 0:
            text(html.unescape(page[at:]))
            break
        if mark > at:
            text(html.unescape(page[at:mark]))
        token = _TOKEN.match(page, mark)
        if token is None:
            text("<")
            at = mark + 1
            continue
        at = token.end()
        if token.group(2) is None:
            continue
        closing, tag = token.group(1), token.group(2).lower()
        if tag not in INLINE and tag not in HIDDEN or tag in ("head", "title"):
            current = None
        elif tag == "br":
            text(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            close_open(*SIBLINGS[tag])
        if tag in VOID or token.group(3).endswith("/") and tag in ("path", "use"):
            continue
        found = _ATTRIBUTE.findall(token.group(3)) if token.group(3) else ()
        around = stack[-1][1] if stack else None
        if tag not in INLINE:
            words = {w for _, *value in found for w in _WORDS.findall("".join(value).lower()) if w.isalpha()}
            if any(name.lower() == "hidden" for name, *_ in found):
                words.add("hidden")
            around = Path(tag, frozenset({f"in:{tag}", *(f"word:{w}" for w in words)}), around)
        stack.append((tag, around))
        count(tag, 1)
        if tag in RAW_TEXT:
            raw_end = tag
    out = []
    for block in blocks:
        clean = " ".join("".join(block.parts).split())
        if clean:
            out.append((clean, block.path, block.linked / max(1, block.chars), block.buttons * 2 > block.chars))
    return out


BUCKETS = 1 << 14
WIDTH = 40  # of the arrays for training, unless a block has more features


def _bucket(name: str) -> int:
    return 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)


@lru_cache(maxsize=200_000)
def _path_features(tag: str, names: frozenset) -> tuple[int, ...]:
    return tuple(_bucket(n) for n in sorted(names | {f"tag:{tag}"}))


def _features(block: tuple) -> list[int]:
    text, path, linked, control = block
    words = text.count(" ") + 1
    names = [
        "any", f"words:{min(words, 30) // 5}", f"linked:{int(linked * 4)}", f"control:{control}",
        f"end:{text[-1] if text[-1] in '.!?:,;' else 'other'}",
        f"mark:{'©' in text}",
    ]
    around = _path_features(path.tag, path.names) if path else (_bucket("tag:none"),)
    return [*[_bucket(n) for n in names], *around]


def page_features(blocks: list[tuple]) -> np.ndarray:
    """All features of the blocks, padded to the longest."""
    found = [_features(block) for block in blocks]
    out = np.zeros((len(blocks), max([WIDTH, *map(len, found)])), np.int64)  # bucket 0 has no weight
    for k, own in enumerate(found):
        out[k, : len(own)] = own
    return out


def emissions(blocks: list[tuple], field: ChainCrf) -> np.ndarray:
    """Scores of the blocks from all their features; nothing is padded, as paths may be long."""
    return np.fromiter((field.weights[_features(block)].sum() for block in blocks), float, len(blocks))


# -- labelled pages ------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ten ra sel du por vi an est or".split()
MAIN_WRAPS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div id="content">', "</div>"), ('<div class="post-content">', "</div>"), ('<div class="article-body">', "</div>"),
    ('<section class="entry-content">', "</section>"), ('<div class="main"><div class="story text">', "</div></div>"),
    ('<div role="main">', "</div>"), ('<article class="post"><div class="body">', "</div></article>"),
)
SIDE_NAMES = (
    "sidebar", "widget", "related", "recommended", "popular", "tags", "share", "social", "newsletter", "subscribe",
    "promo", "sponsored", "ad", "ads", "advert", "advertisement", "banner", "cookie", "cookies", "consent", "notice",
    "alert", "popup", "modal", "gdpr", "breadcrumb", "breadcrumbs", "menu", "navigation", "nav", "topbar", "masthead",
    "header", "footer", "copyright", "legal", "disclaimer", "pagination", "pager", "toolbar", "skip", "login", "signup",
    "search", "author bio", "meta", "byline", "outbrain", "taboola",
)
COMMENT_NAMES = ("comments", "comment", "comment list", "replies", "reply", "discussion", "respond", "disqus", "reviews")


class _Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
        return " ".join(made).capitalize() + r.choice(("", ".", ".", ".", "!", "?"))

    def links(self, tag: str = "li") -> str:
        items = "".join(f'<{tag}><a href="/x">{self.words(1, 3)}</a></{tag}>' for _ in range(self.r.randint(2, 8)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def side(self) -> str:
        r = self.r
        kind = r.randrange(9)
        name = r.choice(SIDE_NAMES)
        if kind == 0:
            return f"<nav>{self.links()}</nav>"
        if kind == 1:
            return f"<aside>{self.words(2, 4)}<p>{self.words(5, 40)}</p>{self.links()}</aside>"
        if kind == 2:
            return f"<form><label>{self.words(1, 2)}</label><input><button>{self.words(1, 2)}</button>{self.words(3, 12)}</form>"
        if kind == 3:
            tag = r.choice(("ul", "ol"))
            name = r.choice(COMMENT_NAMES)
            items = "".join(f"<li><p>{self.words(4, 40)}</p></li>" for _ in range(r.randint(1, 5)))
            return f'<section class="{name}"><h3>{self.words(1, 3)}</h3><{tag}>{items}</{tag}></section>'
        if kind == 4:
            name = r.choice(COMMENT_NAMES)
            inner = "".join(f'<div class="{name}"><b>{self.words(1, 2)}</b><p>{self.words(4, 50)}</p></div>' for _ in range(r.randint(1, 4)))
            return f'<div id="{name}">{inner}</div>'
        if kind == 5:
            return f'<div class="{name}">{self.words(3, 25)}</div>'
        if kind == 6:
            return f'<div class="{name}"><p>{self.words(5, 30)}</p><p>{self.words(5, 30)}</p></div>'
        if kind == 7:
            return f'<div id="{name}"><h4>{self.words(1, 3)}</h4>{self.links()}</div>'
        return f'<section class="{name}">{self.words(3, 20)}</section>'

    def main(self) -> str:
        r = self.r
        out = [f"<h1>{self.words(3, 10)}</h1>"]
        for _ in range(r.randint(1, 14)):
            out.append(r.choice((
                lambda: f"<p>{self.words(6, 90)}</p>", lambda: f"<p>{self.words(6, 90)}</p>",
                lambda: f"<p><b>{self.words(3, 10)}<br>", lambda: f"<p>{self.words(1, 6)}",
                lambda: f"<h2>{self.words(2, 6)}</h2>", lambda: f"<ul><li>{self.words(3, 20)}<li>{self.words(3, 20)}</ul>",
                lambda: f"<blockquote>{self.words(6, 40)}</blockquote>", lambda: f"<pre>{self.words(4, 20)}</pre>",
                lambda: f'<p>{self.words(3, 30)} <a href="/y">{self.words(1, 4)}</a> {self.words(2, 30)}</p>',
                lambda: f"<table><tr><td>{self.words(1, 5)}<td>{self.words(1, 5)}</table>",
                lambda: f"<figure><img><figcaption>{self.words(3, 12)}</figcaption></figure>",
                lambda: f"<div>{self.words(6, 60)}</div>",
                lambda: f"<section><h3>{self.words(2, 5)}</h3><p>{self.words(8, 60)}</p></section>",
            ))())
        return "".join(out)

    def page(self) -> tuple[str, str, str, str, list[str]]:
        """Before, wrapper's start, main pieces with side pieces inside, end, after."""
        r = self.r
        before = "".join(self.side() for _ in range(r.randint(0, 4)))
        if r.random() < 0.7:
            before = f"<nav>{self.links()}</nav>" + before
        if r.random() < 0.5:
            head = r.choice(("<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>'))
            before = head.format(self.words(1, 8) + self.links()) + before
        after = "".join(self.side() for _ in range(r.randint(0, 3)))
        if r.random() < 0.8:
            foot = r.choice(("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>'))
            after += foot.format(r.choice(("&copy; ", "", "")) + self.words(2, 14))
        inside = [(True, self.main())]
        if r.random() < 0.3:
            inside.insert(r.randint(0, 1), (False, self.side()))
        return before, r.choice(MAIN_WRAPS), inside, after


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page and the labels of its leaf blocks, which follow from where they were put."""
    before, (start, end), inside, after = _Pages(seed).page()
    open_tag, close_tag = "\ue000", "\ue001"  # marks that only label the training text

    def marked(part: str) -> str:
        return re.sub(r"(^|>)([^<]*[^\s<][^<]*)", lambda m: m.group(1) + open_tag + m.group(2) + close_tag, part)

    body = "".join(marked(p) if main else p for main, p in inside)
    page = f"<html><head><title>x</title></head><body>{before}{start}{body}{end}{after}</body></html>"
    return page, [int(open_tag in text) for text, *_ in leaf_blocks(page)]


#: Labelled pages that the field is trained on.
TRAINING_PAGES = 1000


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> ChainCrf:
    made = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        clean = leaf_blocks(page.replace("\ue000", "").replace("\ue001", ""))
        if len(clean) == len(labels) and labels:
            made.append((page_features(clean), labels))
    longest = max(len(labels) for _, labels in made)
    features = np.zeros((len(made), longest, max(own.shape[1] for own, _ in made)), np.int64)
    marks = np.zeros((len(made), longest), np.int64)
    for k, (own, labels) in enumerate(made):
        features[k, : len(labels), : own.shape[1]], marks[k, : len(labels)] = own, labels
    lengths = np.array([len(labels) for _, labels in made])
    field = ChainCrf(BUCKETS).fit(features, marks, lengths, epochs=80, rate=0.1, penalty=1e-5)
    field.weights[0] = 0
    return field


def main_text(page: str | None, field: ChainCrf) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = field.viterbi(emissions(blocks, field))
    return "\n".join(block[0] for block, label in zip(blocks, labels) if label)


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> ChainCrf:
    return pickle.loads(packed)


def extract(pages: DataFrame, html_column: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """The columns of ``pages`` but the html, plus ``text`` and ``n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one space, and
    blocks are joined by a line feed in page order.  Null, empty and blockless pages give
    an empty text.  Columns named ``text`` or ``n_chars`` are replaced.
    """
    cell = fresh("html")
    rows = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in (html_column, "text", "n_chars")],
        F.col(html_column).cast("string").alias(cell))
    packed = pages.sparkSession.sparkContext.broadcast(pickle.dumps(trained(training_pages)))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _loaded(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(p, field) for p in part.column(part.num_columns - 1).to_pylist()]
                arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.record_batch([*part.columns[:-1], *arrays], names=[*part.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "text string, n_chars long"])
    return rows.mapInArrow(run, schema)
