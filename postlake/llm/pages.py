"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each block element gets the log-odds that it belongs to the article, from its own and its subtree's
text and link density, its attribute words, its depth and its siblings. A page's labels are then
chosen together: the sum of log-odds is largest under the rule that a dropped element's descendants
are dropped with it, so no descendant contradicts its ancestor.

The trees learn from pages whose elements say what they are (tags, classes, roles), in a bounded
sample. Copies of those pages without such words teach what structure alone tells.
"""

from __future__ import annotations

import html
import pickle
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.boosting import BoostedTrees
from postlake.llm.common import sample_rows, texts_in, with_columns

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*+>|<!(?!--)[^>]*+>"
_LOOSE = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|{_OTHER}", re.DOTALL)
_STRICT = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(<)/?[a-zA-Z]|{_OTHER}", re.DOTALL)
_BEGINS = re.compile(r"<[a-zA-Z!/?]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

# Fixed lists of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript iframe object svg math select textarea audio video canvas".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul hr button".split()
)
#: An opening element closes an open one of these, up to the nearest of the containers behind it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}

# Words of tags, classes, ids and roles that tell what an element is, for teaching.
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert advertisement "
    "banner sponsor sponsored promo notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "signup login share sharing social comment comments reply replies discussion related recommended pagination pager "
    "widget toolbar copyright disclaimer search form contentinfo complementary hidden".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article post entry story main content text body articlebody".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset[str]
    texts: list[int] = field(default_factory=list)  # positions among the page's text runs
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str, bool]]  # block node, text, inside a link
    borders: list[int]  # for each run, how many block borders come before it


def _words(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
        elif name != "aria-hidden":
            found.update(t.lower() for t in _TOKEN.findall(value))
    return frozenset(found)


def parse(markup: str) -> Page:
    """Block elements and text runs, in page order. Never fails, and reads each character a few times at most.

    After a tag whose quotes never close, quotes no longer hide the end of a tag. What begins like a
    tag and has no end is dropped. Inline elements only mark their text as linked or not. An element inside head, script, style or
    other unseen elements has no text.
    """
    nodes = [Node("html", -1, 0, frozenset())]
    runs: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, its block node, unseen
    open_: dict[str, int] = {"html": 1}
    links = passed = 0
    borders: list[int] = []

    def add(text: str) -> None:
        if text and not stack[-1][2]:
            nodes[stack[-1][1]].texts.append(len(runs))
            runs.append((stack[-1][1], text, links > 0))
            borders.append(passed)

    def close_until(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        """Close up to the nearest open element of ``tags``, if no element of ``stops`` comes first."""
        nonlocal links, passed
        if not any(open_.get(t) for t in tags):
            return
        if stops:
            for tag, _, _ in reversed(stack):
                if tag in tags:
                    break
                if tag in stops:
                    return
        while len(stack) > 1:
            tag = stack.pop()[0]
            open_[tag] -= 1
            links -= tag == "a"
            passed += tag in BLOCKS
            if tag in tags:
                break

    at, size, pattern = 0, markup.rfind(">") + 1, _STRICT
    while at < size:
        m = pattern.search(markup, at, size)
        if m and pattern is _STRICT and m.group(4):
            pattern = _LOOSE
            m = pattern.search(markup, at, size)
        if not m:
            add(html.unescape(markup[at:size]))
            break
        add(html.unescape(markup[at : m.start()]))
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "br":
                add(" ")
            elif tag != "html" and open_.get(tag):
                close_until((tag,))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "html":
            nodes[0].words |= _words(m.group(3))
            continue
        if tag in BLOCKS:
            close_until(("p",), ("td", "th", "table", "button"))
        if tag == "body":
            close_until(("head",))
        if tag == "a":
            close_until(("a",), tuple(BLOCKS))
        if tag in CLOSES:
            close_until(*CLOSES[tag])
        passed += tag in BLOCKS
        if tag in VOID:
            if tag == "hr":
                nodes.append(Node(tag, stack[-1][1], nodes[stack[-1][1]].depth + 1, frozenset()))
                nodes[stack[-1][1]].children.append(len(nodes) - 1)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(markup, at)
            at = end.end() if end else len(markup)
            continue
        above = stack[-1]
        block = above[1]
        if tag in BLOCKS:
            words = _words(m.group(3)) if m.group(3) else frozenset()
            nodes.append(Node(tag, block, nodes[block].depth + 1, words))
            nodes[block].children.append(len(nodes) - 1)
            block = len(nodes) - 1
        stack.append((tag, block, above[2] or tag in UNSEEN))
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
    if at <= size:
        add(html.unescape(_BEGINS.split(markup[size:], maxsplit=1)[0]))
    return Page(nodes, runs, borders)


_KINDS = ("p", "div", "section", "li", "ul", "td", "h1", "h2", "h3", "blockquote", "pre", "body", "table")
N_FEATURES = 24 + len(_KINDS)


def features(page: Page) -> np.ndarray:
    """(nodes, N_FEATURES); the last axis starts with what attributes and telling tags say."""
    nodes, n = page.nodes, len(page.nodes)
    own, linked, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text, in_link in page.runs:
        length = len(text) - text.count(" ") * 0.5 if text.strip() else 0
        own[i] += length
        linked[i] += length * in_link
        marks[i] += text.count(".") + text.count(",")
    total, total_linked, total_marks, size = own.copy(), linked.copy(), marks.copy(), np.ones(n)
    paragraphs = np.array([node.tag in ("p", "br") for node in nodes], float)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        for column in (total, total_linked, total_marks, size, paragraphs):
            column[p] += column[i]
    whole = total[0] + 1
    before = np.cumsum(own) - own
    rows = np.zeros((n, N_FEATURES))
    aside, mains = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        up = node.parent
        siblings = nodes[up].children if up >= 0 else [0]
        is_aside = node.tag in ASIDE_TAGS or bool(node.words & ASIDE_WORDS)
        is_main = node.tag in MAIN_TAGS or bool(node.words & MAIN_WORDS)
        aside[i] = is_aside or (up >= 0 and aside[up])
        mains[i] = is_main or (up >= 0 and mains[up])
        around = total[up] if up >= 0 else total[i]
        rows[i, :24] = (
            node.tag in ASIDE_TAGS, bool(node.words & ASIDE_WORDS), node.tag in MAIN_TAGS, bool(node.words & MAIN_WORDS),
            up >= 0 and aside[up], up >= 0 and mains[up],
            np.log1p(own[i]), np.log1p(total[i]), total[i] / whole, total[i] / size[i], total_linked[i] / (total[i] + 1),
            linked[i] / (own[i] + 1), total_marks[i] / (total[i] + 1) * 100, node.depth, len(node.children), np.log1p(size[i]),
            len(siblings), 0, total[i] / (around + 1), before[i] / whole, np.log1p(paragraphs[i]),
            total_linked[up] / (around + 1) if up >= 0 else 0, np.log1p(around / (size[up] if up >= 0 else 1)), len(node.words),
        )
        if node.tag in _KINDS:
            rows[i, 24 + _KINDS.index(node.tag)] = 1
    for node in nodes:
        for at, child in enumerate(node.children):
            rows[child, 17] = at / len(node.children)
    return rows


#: Features that name what an element is; masked in the copies that teach structure alone.
_SAID = (0, 1, 2, 3, 4, 5, 23)


def taught(page: Page) -> list[int | None]:
    """What an element's and its ancestors' words say: 1 main text or on the way to it, 0 not, None unsaid."""
    nodes = page.nodes
    label: list[int | None] = [None] * len(nodes)
    for i, node in enumerate(nodes):
        above = label[node.parent] if node.parent >= 0 else None
        if above == 0 or node.tag in ASIDE_TAGS or (node.words & ASIDE_WORDS and node.tag not in ("html", "body")):
            label[i] = 0
        elif above == 1 or node.tag in MAIN_TAGS or (node.words & MAIN_WORDS and node.tag not in ("html", "body")):
            label[i] = 1
    if 1 not in label:
        return [None] * len(nodes)
    holds = [x == 1 for x in label]
    for i in range(len(nodes) - 1, 0, -1):
        if holds[i]:
            holds[nodes[i].parent] = True
    return [1 if h and x != 0 else 0 if x == 0 else None for h, x in zip(holds, label)]


_PARAGRAPH = re.compile(r"<p\b[^>]*>[^<]*(?:</p>)?", re.I)


def _other_kind(paragraph: str, rnd: random.Random) -> str:
    """Now and then a paragraph as another kind of block with the same text."""
    if rnd.random() > 0.25:
        return paragraph
    inner = re.sub(r"</?p\b[^>]*>", "", paragraph, flags=re.I)
    opening, closing = rnd.choice(
        (("<blockquote>", "</blockquote>"), ("<blockquote><p>", "</blockquote>"), ("<div>", "</div>"), ("<h2>", "</h2>"),
         ("<h3>", "</h3>"), ("<ul><li>", "</li></ul>"), ("<pre>", "</pre>"), ("<table><tr><td>", "</td></tr></table>"))
    )
    return opening + inner + closing


def varied(markup: str, seed: int) -> str:
    """The page with some of its own paragraphs also put into an aside, and its article told in another way.

    So the trees see paragraphs that are not main text because of what holds them, and main text
    under other names than the page's own.
    """
    rnd = random.Random(seed)
    found = _PARAGRAPH.findall(markup)
    markup = _PARAGRAPH.sub(lambda m: _other_kind(m.group(), rnd), markup)
    some = [rnd.choice(found) for _ in range(rnd.randint(1, 4))] if found else ["<p>More</p>"]
    if rnd.random() < 0.4:
        tag, words = rnd.choice(sorted(ASIDE_TAGS)), ""
    else:
        tag, words = rnd.choice(("div", "section", "ul", "div")), f' {rnd.choice(("class", "id"))}="{rnd.choice(sorted(ASIDE_WORDS))}"'
    body = "".join(f"<li>{p}</li>" if tag == "ul" else p for p in some)
    if rnd.random() < 0.3:
        body = re.sub(r"</?p\b[^>]*>", " ", body)
    aside = f"<{tag}{words}>{body}</{tag}>"
    end = rnd.choice(("</article>", "</body>", "</main>", "<article>"))
    markup = markup.replace(end, aside + end if end != "<article>" or rnd.random() < 0.5 else end + aside, 1)
    opening, closing = rnd.choice(
        (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ('<section id="content">', "</section>"))
    )
    markup = markup.replace("<article>", opening).replace("</article>", closing)
    return markup if rnd.random() < 0.5 else markup.replace(opening, f"{opening}<div>").replace(closing, f"</div>{closing}")


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best sum of log-odds in which no kept node has a dropped ancestor."""
    nodes = page.nodes
    drop, keep = -odds.astype(float), odds.astype(float)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        drop[p] += drop[i]
        keep[p] += max(drop[i], keep[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def main_text(page: Page, kept: np.ndarray) -> str:
    """Text of the kept nodes: one block per stretch of runs without a block border, two line ends between."""
    blocks: list[str] = []
    part: list[str] = []
    last = -1
    for (node, text, _), border in zip(page.runs, page.borders):
        if border != last:
            blocks.append(_SPACE.sub(" ", "".join(part)).strip())
            part = []
        last = border
        if kept[node]:
            part.append(text)
    blocks.append(_SPACE.sub(" ", "".join(part)).strip())
    return "\n\n".join(b for b in blocks if b)


class PageModel:
    def __init__(self, trees: BoostedTrees) -> None:
        self.trees = trees

    def texts(self, markups: list[str]) -> list[str]:
        pages = [parse(m) for m in markups]
        rows = [features(p) for p in pages]
        if not rows:
            return []
        odds = self.trees.log_odds(np.concatenate(rows))
        cuts = np.cumsum([len(r) for r in rows])[:-1]
        return [main_text(p, decode(p, o)) for p, o in zip(pages, np.split(odds, cuts))]


def fit(df: DataFrame, key: str = "page_id", markup: str = "html", sample: int = 300) -> PageModel:
    """Fit on at most ``sample`` distinct pages, chosen by the hashes of key and markup.

    Pages without a key are left out of it; repeated rows teach once. Without a telling page all is kept.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["m"]:
                seed = zlib.crc32((value or "").encode("utf-8", "surrogatepass"))
                for turn in range(4):
                    page = parse(varied(value or "", seed + turn) if turn else value or "")
                    out += [(x.tolist(), y, turn) for x, y in zip(features(page), taught(page)) if y is not None]
            yield pd.DataFrame(out, columns=["x", "y", "turn"])

    chosen = sample_rows(df, key, markup, sample).select(F.col(markup).cast("string").alias("m"))
    got = chosen.mapInPandas(rows, "x array<double>, y int, turn int").toPandas()
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["turn", "key", "y"], kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    y = got["y"].to_numpy(int)
    if not len(y) or y.min() == y.max():
        return PageModel(BoostedTrees().fit(np.zeros((1, N_FEATURES)), np.ones(1, int)))
    draw = np.random.default_rng(0).integers(0, 4, len(y))
    own = got["turn"].to_numpy(int) == 0
    blind = x[own & (draw == 2)].copy()
    blind[:, _SAID] = 0
    fitted = np.concatenate([x[draw != 3], blind]), np.concatenate([y[draw != 3], y[own & (draw == 2)]])
    trees = BoostedTrees(rounds=60).fit(*fitted)
    return PageModel(trees.calibrate(x[draw == 3], y[draw == 3]))


def extract(
    df: DataFrame, model: PageModel, markup: str = "html", into: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add the main text of each page's whole markup. Null and empty markup gives an empty text."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(pickle.loads(shipped.value).texts(texts_in(batch, markup)), pa.string())]

    return with_columns(df, [T.StructField(into, T.StringType())], make, keep)
