"""Pages in, text and links out.

One Arrow pass (`read_markup`) turns every page into a row-local ``dom`` struct: its text
nodes in document order, its elements with the range of text nodes they span, and on request the
positions of the elements of each tag, class, id and attribute, so that a selector is a look-up.
All other operators are expressions over that struct, so no page is shuffled or parsed again.

Tree rules: void elements close at once, an end tag closes up to the nearest open tag of that
name, and nothing else is closed implicitly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions import lexicons as lex
from postlake.functions.jsonv import parse
from postlake.functions.text import (
    SPACE_CHARS,
    any_contains,
    cut_at_last_line,
    first_by,
    let,
    lit_array,
    or_empty,
    strip,
)
from postlake.functions.urls import absolutize_url

# Tag groups an operator may hide, one bit each.
HIDE_NOSCRIPT, HIDE_IFRAME, HIDE_CHROME = 1, 2, 4
_HIDING = {
    "noscript": HIDE_NOSCRIPT,
    "iframe": HIDE_IFRAME,
    "nav": HIDE_CHROME,
    "footer": HIDE_CHROME,
    "header": HIDE_CHROME,
}
HIDE_NONE = 0
HIDE_PAYLOAD = HIDE_NOSCRIPT
HIDE_PARSER = HIDE_NOSCRIPT | HIDE_IFRAME
HIDE_CLEANER = HIDE_NOSCRIPT | HIDE_IFRAME | HIDE_CHROME
# Elements without content, and elements whose text is never visible.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
_UNSEEN = frozenset(("script", "style", "template"))
_KEEPS_SPACE = frozenset(("pre", "textarea"))
_CARD_TAGS = frozenset(("article", "li", "div"))

_ELEMENT = (
    "struct<pos:int,parent:int,card:int,last:int,tag:string,id:string,classes:array<string>,"
    "itemprop:string,testid:string,automation:string,role:string,type:string,href:string,"
    "t0:int,t1:int,hide:int,raw:string>"
)
DOM_TYPE = f"struct<texts:array<struct<s:string,hide:int>>,els:array<{_ELEMENT}>,at:map<string,array<int>>>"
#: Attributes that selectors can name, and the fields that hold them.
_NAMED = {"itemprop": "itemprop", "data-testid": "testid", "data-automation": "automation", "role": "role", "type": "type"}


class _Markup(HTMLParser):
    """Collects text nodes and elements of one page."""

    def __init__(self, index: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.at: dict[str, list[int]] | None = {} if index else None
        self.texts: list[dict] = []
        self.els: list[dict] = []
        self.open: list[dict] = []
        self.pending: list[str] = []
        self.open_tags: Counter[str] = Counter()
        self.unseen: list[dict] = []  # open elements whose text is never visible
        self.keeping = 0  # open elements that keep white space

    def flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending.clear()
        if not self.keeping and not text.strip(" \t\n\r\x0c"):
            text = "\n" if "\n" in text else " "
        if self.unseen:
            unseen = self.unseen[-1]
            unseen["raw"] = (unseen["raw"] or "") + text
        else:
            self.texts.append({"s": text, "hide": self.open[-1]["hide"] if self.open else 0})

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections of unknown kinds count as comments."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self.flush()

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        have = {k: ("" if v is None else v) for k, v in attrs}
        above = self.open[-1] if self.open else None
        element = {
            "pos": len(self.els),
            "parent": above["pos"] if above else None,
            # The nearest article, li or div around the element.
            "card": (above["pos"] if above["tag"] in _CARD_TAGS else above["card"]) if above else None,
            "last": len(self.els),
            "tag": tag,
            "id": have.get("id"),
            "classes": have.get("class", "").split(),
            "itemprop": have.get("itemprop"),
            "testid": have.get("data-testid"),
            "automation": have.get("data-automation"),
            "role": have.get("role"),
            "type": have.get("type"),
            "href": have.get("href"),
            "t0": len(self.texts),
            "t1": len(self.texts),
            "hide": (above["hide"] if above else 0) | _HIDING.get(tag, 0),
            "raw": None,
        }
        self.els.append(element)
        if self.at is not None:
            keys = [tag, *(f".{c}" for c in set(element["classes"]))]
            keys += [f"#{element['id']}"] if element["id"] is not None else []
            keys += [f"[{n}={have[n]}]" for n in _NAMED if n in have]
            for key in keys:
                self.at.setdefault(key, []).append(element["pos"])
        if tag not in _VOID:
            self.open.append(element)
            self.open_tags[tag] += 1
            self.keeping += tag in _KEEPS_SPACE
            if tag in _UNSEEN:
                self.unseen.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if self.open_tags[tag]:
            while self._shut()["tag"] != tag:
                pass

    def _shut(self) -> dict:
        element = self.open.pop()
        self.open_tags[element["tag"]] -= 1
        self.keeping -= element["tag"] in _KEEPS_SPACE
        if self.unseen and self.unseen[-1] is element:
            self.unseen.pop()
        element["t1"] = len(self.texts)
        element["last"] = len(self.els) - 1
        return element

    def finish(self) -> dict:
        self.close()
        self.flush()
        while self.open:
            self._shut()
        at = None if self.at is None else list(self.at.items())
        return {"texts": self.texts, "els": self.els, "at": at}


def _dom(html: str | None, index: bool = False) -> dict | None:
    if html is None or not html.strip():
        return None
    page = _Markup(index)
    page.feed(html)
    return page.finish()


def _lines(dom: dict | None) -> tuple[list[str], list[int]]:
    """Stripped lines with text, node by node, and how many of them lie before each node (and the end)."""
    found: list[str] = []
    before = [0]
    for node in dom["texts"] if dom else ():
        found += [line for part in node["s"].split("\n") if (line := part.strip(SPACE_CHARS))]
        before.append(len(found))
    return found, before


def read_markup(
    pages: DataFrame, html: str = "html", keep_html: bool = False, index: bool = False, lines: bool = False
) -> DataFrame:
    """Replace ``html`` by the parsed ``dom`` column; other columns pass through.

    ``index`` fills ``dom.at``, which look-ups by selector need. ``lines`` adds the page's lines and,
    in ``line_at``, the number of them before each text node, so that the lines of an element are a range.
    """
    kept = [f for f in pages.schema.fields if keep_html or f.name != html]
    more = [T.StructField("dom", T._parse_datatype_string(DOM_TYPE))]
    if lines:
        more += [T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("line_at", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(kept + more)
    names = [f.name for f in kept]

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        small = pa.int32()
        dom_type = pa.struct(
            [
                ("texts", pa.list_(pa.struct([("s", text), ("hide", small)]))),
                (
                    "els",
                    pa.list_(
                        pa.struct(
                            [("pos", small), ("parent", small), ("card", small), ("last", small), ("tag", text)]
                            + [("id", text), ("classes", pa.list_(text))]
                            + [
                                (n, text)
                                for n in ("itemprop", "testid", "automation", "role", "type", "href")
                            ]
                            + [("t0", small), ("t1", small), ("hide", small), ("raw", text)]
                        )
                    ),
                ),
                ("at", pa.map_(text, pa.list_(small))),
            ]
        )
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                doms = [_dom(h.as_py(), index) for h in source.slice(start, 256)]
                arrays = [part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(doms, type=dom_type)]
                if lines:
                    cut = [_lines(d) for d in doms]
                    arrays += [pa.array([c[0] for c in cut], pa.list_(text)), pa.array([c[1] for c in cut], pa.list_(small))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return pages.mapInArrow(parse_batches, schema)


# --- Expressions over dom ---------------------------------------------------


def _shown(texts: Column, hide: int) -> Column:
    if hide:
        texts = F.filter(texts, lambda t: t.s.isNotNull() & (t.hide.bitwiseAND(F.lit(hide)) == 0))
    return F.transform(texts, lambda t: t.s)


def _joined(strings: Column, sep: str, strip_nodes: bool) -> Column:
    if strip_nodes:
        strings = F.filter(F.transform(strings, strip), lambda s: s != "")
    return F.array_join(strings, sep)


def dom_text(dom: Column, hide: int = HIDE_NONE, sep: str = "\n", strip_nodes: bool = True) -> Column:
    """Visible text of the page."""
    return or_empty(_joined(_shown(dom.texts, hide), sep, strip_nodes))


def element_text(
    dom: Column, el: Column, hide: int = HIDE_NONE, sep: str = " ", strip_nodes: bool = True
) -> Column:
    """Visible text below one element."""
    span = F.slice(dom.texts, el.t0 + 1, el.t1 - el.t0)
    return _joined(_shown(span, hide), sep, strip_nodes)


def dom_elements(dom: Column, hide: int = HIDE_NONE) -> Column:
    if not hide:
        return dom.els
    return F.filter(dom.els, lambda e: e.hide.bitwiseAND(F.lit(hide)) == 0)


def matches(selector: str) -> Callable[[Column], Column]:
    """Predicate for ``tag``, ``.class``, ``#id`` or ``[attribute=value]``."""
    if selector.startswith("."):
        return lambda e: F.array_contains(e.classes, selector[1:])
    if selector.startswith("#"):
        return lambda e: e.id == selector[1:]
    if selector.startswith("["):
        name, value = selector[1:-1].split("=", 1)
        column = _NAMED.get(name, name)
        return lambda e: e[column] == value.strip("\"'")
    return lambda e: e.tag == selector


def _index_key(selector: str) -> str:
    """A selector as the index of a page names it."""
    if not selector.startswith("["):
        return selector
    name, value = selector[1:-1].split("=", 1)
    if name not in _NAMED:
        raise ValueError(f"elements are not indexed by {name}")
    return f"[{name}={value.strip(chr(34) + chr(39))}]"


def positions(dom: Column, selector: str | Column, hide: int = HIDE_NONE) -> Column:
    """Positions of the elements that match, in document order, by a look-up in the page's index."""
    key = F.lit(_index_key(selector)) if isinstance(selector, str) else selector
    missing = F.raise_error("read_markup needs index=True here").cast("map<string,array<int>>")
    index = F.when(dom.isNotNull(), F.coalesce(dom["at"], missing))
    found = F.coalesce(F.try_element_at(index, key), F.array().cast("array<int>"))
    if not hide:
        return found
    return F.filter(found, lambda p: F.get(dom.els, p).hide.bitwiseAND(F.lit(hide)) == 0)


def first_element(dom: Column, selector: str, hide: int = HIDE_NONE) -> Column:
    """The first element that matches, else null."""
    return F.get(dom.els, F.get(positions(dom, selector, hide), F.lit(0)))


def selector_text(
    dom: Column,
    selectors: Sequence[str],
    hide: int = HIDE_NONE,
    sep: str = "",
    min_len: int = 0,
    skip_empty: bool = True,
) -> Column:
    """Text of the first selector whose first element qualifies, else null.

    ``skip_empty=False`` stops at the first element found, even when it has no text. A selector is a
    look-up in ``dom.at``, so the expression is the same for any number of them.
    """
    keys = lit_array([_index_key(s) for s in selectors])
    firsts = F.transform(keys, lambda k: F.get(positions(dom, k, hide), F.lit(0)))
    texts = F.transform(
        F.filter(firsts, lambda p: p.isNotNull()), lambda p: element_text(dom, F.get(dom.els, p), hide, sep)
    )
    if skip_empty:
        texts = F.filter(texts, lambda t: F.length(t) > min_len)
    return F.try_element_at(texts, F.lit(1))


# --- C1, C2, C13 ------------------------------------------------------------


def visible_text(
    pages: DataFrame, hide: int = HIDE_PAYLOAD, sep: str = "\n", strip_nodes: bool = True
) -> DataFrame:
    """Visible text per page; ``hide`` names the tag set that is left out."""
    return read_markup(pages).withColumn("text", dom_text(F.col("dom"), hide, sep, strip_nodes)).drop("dom")


def clean_markup(html: Column) -> Column:
    """Page markup without script, style and noscript blocks."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


def payload(pages: DataFrame, min_len: int = 500) -> DataFrame:
    """Text if long enough, else cleaned markup if long enough, else the raw page."""
    text = dom_text(F.col("dom"), HIDE_PAYLOAD, "\n", strip_nodes=False)
    cleaned = clean_markup(F.col("html"))
    blank = strip(or_empty(F.col("html"))) == ""
    source = (
        F.when(blank, F.lit("empty"))
        .when(F.length("_text") > min_len, F.lit("text"))
        .when(F.length(cleaned) > min_len, F.lit("cleaned_html"))
        .otherwise(F.lit("raw_html"))
    )
    body = (
        F.when(F.col("source") == "empty", F.lit(""))
        .when(F.col("source") == "text", F.col("_text"))
        .when(F.col("source") == "cleaned_html", cleaned)
        .otherwise(F.col("html"))
    )
    return (
        read_markup(pages, keep_html=True)
        .withColumn("_text", text)
        .withColumn("source", source)
        .withColumn("payload", body)
        .drop("dom", "html", "_text")
    )


def flag_thin(payloads: DataFrame, minimum: int = 2000) -> DataFrame:
    return payloads.withColumn("is_thin", F.length("payload") < minimum)


# --- C3, C4 -----------------------------------------------------------------


def html_elements(
    pages: DataFrame, page_id: str = "page_id", selectors: Sequence[str] = (), hide: int = HIDE_NONE
) -> DataFrame:
    """Long element table in document order; selectors keep only what is needed."""
    dom = F.col("dom")
    chosen = dom_elements(dom, hide)
    if selectors:
        tests = [matches(s) for s in selectors]

        def wanted(e: Column) -> Column:
            hit = tests[0](e)
            for test in tests[1:]:
                hit = hit | test(e)
            return hit

        chosen = F.filter(chosen, wanted)
    rows = F.transform(
        chosen, lambda e: F.struct(e.alias("e"), element_text(dom, e, hide, " ").alias("text"))
    )
    fields = ("pos", "parent", "last", "tag", "id", "classes", "itemprop", "testid", "type", "href")
    return (
        read_markup(pages.select(page_id, "html"))
        .select(page_id, F.explode(rows).alias("r"))
        .select(page_id, *[F.col(f"r.e.{f}").alias(f) for f in fields], F.col("r.text").alias("text"))
    )


def select_first(
    pages: DataFrame,
    selectors: Sequence[str],
    sep: str = "",
    min_len: int = 0,
    skip_empty: bool = True,
    hide: int = HIDE_PARSER,
    name: str = "value",
) -> DataFrame:
    picked = selector_text(F.col("dom"), selectors, hide, sep, min_len, skip_empty)
    return read_markup(pages, index=True).withColumn(name, picked).drop("dom")


# --- C5 ---------------------------------------------------------------------


def clean_dom_text(dom: Column, phrases: Sequence[str] = lex.DROPPED_SECTIONS) -> Column:
    """Text outside chrome tags and outside any section holding one of the phrases."""

    def cut(e: Column) -> Column:
        return e.tag.isin(*lex.SECTION_TAGS) & any_contains(
            F.lower(element_text(dom, e, HIDE_CLEANER, "")), phrases
        )

    dropped = F.transform(
        F.filter(dom_elements(dom, HIDE_CLEANER), cut),
        lambda e: F.struct(e.t0.alias("t0"), e.t1.alias("t1")),
    )
    # Spans come in page order, so the outermost ones are those that begin behind the last one kept.
    outermost = F.aggregate(
        dropped,
        F.array().cast("array<struct<t0:int,t1:int>>"),
        lambda kept, s: F.when(
            F.size(kept).cast("boolean") & (s.t0 < F.coalesce(F.try_element_at(kept, F.lit(-1)).t1, F.lit(0))), kept
        ).otherwise(F.array_append(kept, s)),
    )

    def between(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.t1))
        ends = F.concat(F.transform(spans, lambda s: s.t0), F.array(F.size(dom.texts)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(dom.texts, a + 1, F.greatest(b - a, F.lit(0)))))

    left = let(outermost, between)
    text = _joined(_shown(left, HIDE_CLEANER), "\n", True)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return or_empty(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")))


def clean_text(
    pages: DataFrame,
    truncate: bool = True,
    phrases: Sequence[str] = lex.DROPPED_SECTIONS,
    cap: int = 4800,
) -> DataFrame:
    text = clean_dom_text(F.col("dom"), phrases)
    out = read_markup(pages).withColumn("text", text).drop("dom")
    return out.withColumn("text", cut_at_last_line(F.col("text"), cap)) if truncate else out


# --- C6 - C9 ----------------------------------------------------------------


def anchor_array(html: Column) -> Column:
    """Anchors of a page as ``array<struct<href, inner>>``; one scan of the page."""
    found = F.regexp_extract_all(or_empty(html), F.lit(lex.ANCHOR_PATTERN), 0)
    return F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, lex.ANCHOR_PATTERN, 1).alias("href"),
            F.regexp_extract(a, lex.ANCHOR_PATTERN, 2).alias("inner"),
        ),
    )


def anchors(pages: DataFrame, page_id: str = "page_id", keep: Sequence[str] = ()) -> DataFrame:
    """Anchor table: position in the page, href, label with tags replaced by blanks."""
    return (
        pages.select(page_id, *keep, F.posexplode(anchor_array(F.col("html"))).alias("pos", "a"))
        .select(
            page_id,
            *keep,
            "pos",
            F.col("a.href").alias("href"),
            strip(F.regexp_replace("a.inner", lex.TAG_PATTERN, " ")).alias("label"),
            F.col("a.inner").alias("inner"),
        )
    )


def listings_from_anchors(
    pages: DataFrame,
    base: str = "url",
    page_id: str = "page_id",
    limit: int = 200,
    bad_titles: Sequence[str] = lex.LISTING_BAD_TITLES,
    bad_urls: Sequence[str] = lex.LISTING_BAD_URLS,
    signals: Sequence[str] = lex.LISTING_SIGNALS,
    generic: Sequence[str] = lex.LISTING_GENERIC_LABELS,
    html: str = "html",
) -> DataFrame:
    """Anchors that look like postings, first one per label and URL, ``limit`` per page.

    A page's anchors are judged, made distinct and cut inside its row, so no page is shuffled.
    """

    def named(a: Column, i: Column) -> Column:
        title = strip(F.regexp_replace(F.regexp_replace(a.inner, lex.TAG_PATTERN, ""), r"\s+", " "))
        return F.struct(i.alias("pos"), title.alias("title"), a.href.alias("href"))

    def wanted(a: Column) -> Column:
        def judged(low: Column) -> Column:
            signal_in_href = any_contains(low.href, signals)
            return (
                (F.length(a.title) >= 3)
                & ~any_contains(low.title, bad_titles)
                & ~any_contains(low.href, bad_urls)
                & (any_contains(low.title, signals) | signal_in_href)
                & (~low.title.isin(*generic) | signal_in_href)
            )

        return let(F.struct(F.lower(a.title).alias("title"), F.lower(a.href).alias("href")), judged)

    def listing(a: Column) -> Column:
        url = absolutize_url(F.col(base), a.href)
        return F.struct(a.pos.alias("pos"), a.title.alias("title"), F.lit("").alias("location"), url.alias("url"))

    found = F.transform(F.filter(F.transform(anchor_array(F.col(html)), named), wanted), listing)
    firsts = let(found, lambda rows: first_by(rows, lambda x: F.lower(F.concat_ws("|", x.title, x.url))))
    return _row_per(pages.select(page_id, F.slice(firsts, 1, limit).alias("_l")), page_id)


def _row_per(rows: DataFrame, page_id: str) -> DataFrame:
    """One row per element of the computed array ``_l`` (outer form, see `explode_rows`)."""
    return rows.select(page_id, F.explode_outer("_l").alias("_x")).where(F.col("_x").isNotNull()).select(page_id, "_x.*")


def listings_from_cards(
    pages: DataFrame,
    cards: str = "cards",
    base: str = "base_url",
    page_id: str = "page_id",
    generic_titles: Sequence[str] = lex.CARD_GENERIC_TITLES,
    generic_parts: Sequence[str] = lex.CARD_GENERIC_PARTS,
    bad_urls: Sequence[str] = lex.CARD_BAD_URLS,
    job_urls: Sequence[str] = lex.CARD_JOB_URLS,
) -> DataFrame:
    """Card links ``cards: array<struct<pos, title, href, location>>`` that are postings.

    `card_array` gives such an array. Its links are judged and made distinct inside the row.
    """

    def clean(c: Column) -> Column:
        parts = {n: strip(or_empty(c[n])) for n in ("title", "href", "location")}
        return F.struct(c.pos.alias("pos"), *[v.alias(n) for n, v in parts.items()])

    def wanted(c: Column) -> Column:
        low_title, low_href = F.lower(c.title), F.lower(c.href)
        return (
            (F.length(c.title) >= 3)
            & (c.href != "")
            & ~low_title.isin(*lex.CARD_NAV_TITLES)
            & ~low_title.isin(*generic_titles)
            & ~any_contains(low_title, generic_parts)
            & ~any_contains(low_href, bad_urls)
            & (any_contains(low_href, job_urls) | (c.location != ""))
        )

    def listing(c: Column) -> Column:
        url = absolutize_url(F.col(base), c.href)
        return F.struct(c.pos.alias("pos"), c.title.alias("title"), c.location.alias("location"), url.alias("url"))

    def key(x: Column) -> Column:
        return F.lower(F.coalesce(F.nullif(x.url, F.lit("")), F.concat_ws("|", x.title, x.location)))

    found = F.transform(F.filter(F.transform(F.col(cards), clean), wanted), listing)
    return _row_per(pages.select(page_id, let(found, lambda rows: first_by(rows, key)).alias("_l")), page_id)


def card_array(
    dom: Column,
    lines: Column,
    line_at: Column,
    tokens: Sequence[str] = lex.CARD_LINK_TOKENS,
    places: Sequence[str] = lex.CARD_PLACE_WORDS,
) -> Column:
    """Links with the title and location read from the card around them: pos, title, href, location.

    The card is the nearest article, li or div; its lines are a range of the page's lines. What a card
    says is worked out once per card, however many links it holds; a link keeps none of its lines. Whether
    an element is displayed cannot be known from the page source, so every link counts.
    """

    def facts(card: Column) -> Column:
        def of(e: Column) -> Column:
            start = F.get(line_at, e.t0)
            return let(F.struct(start.alias("a"), (F.get(line_at, e.t1) - start).alias("n")), said)

        def said(span: Column) -> Column:
            place = F.filter(
                F.slice(lines, span.a + 2, F.greatest(F.lit(0), F.least(F.lit(7), span.n - 1))),
                lambda s: (F.length(s) > 2)
                & ~any_contains(F.lower(s), lex.CARD_PLACE_BLOCKERS)
                & s.rlike("(?i)[a-z]")
                & (s.contains(",") | any_contains(F.lower(s), places)),
            )
            usable = F.filter(
                F.slice(lines, span.a + 1, span.n),
                lambda s: (F.length(s) >= 6) & ~any_contains(F.lower(s), lex.CARD_SKIPPED_LINES),
            )
            return let(usable, lambda us: F.struct(F.get(place, F.lit(0)).alias("place"), *two(us)))

        def two(us: Column) -> tuple[Column, Column]:
            """The first usable line, and the first that is another one in lower case."""
            first = F.get(us, F.lit(0))
            return first.alias("one"), F.get(F.filter(us, lambda s: F.lower(s) != F.lower(first)), F.lit(0)).alias("other")

        return let(F.get(dom.els, card), of)

    def titled(a: Column) -> Column:
        return F.struct(
            a.pos.alias("pos"), a.href.alias("href"), a.card.alias("card"),
            strip(element_text(dom, a, HIDE_NONE, "", False)).alias("label"),
        )

    links = F.filter(
        F.transform(F.filter(dom.els, lambda e: (e.tag == "a") & (or_empty(e.href) != "")), titled),
        lambda a: (a.label != "") & any_contains(F.lower(F.concat_ws(" ", a.href, a.label)), tokens),
    )

    def with_facts(found: Column) -> Column:
        held = F.array_distinct(F.filter(F.transform(found, lambda a: a.card), lambda c: c.isNotNull()))
        return let(
            let(held, lambda cards: F.map_from_arrays(cards, F.transform(cards, facts))),
            lambda of: F.transform(found, lambda a: let(F.try_element_at(of, a.card), lambda f: row(a, f))),
        )

    def row(a: Column, f: Column) -> Column:
        low = F.lower(a.label)
        other = F.when(F.lower(f.one) != low, f.one).otherwise(f.other)
        title = F.when(low.isin(*lex.CARD_ACTION_LABELS), F.coalesce(other, a.label)).otherwise(a.label)
        return F.struct(
            a.pos.alias("pos"), title.alias("title"), a.href.alias("href"), or_empty(f.place).alias("location")
        )

    return let(links, with_facts)


def card_fields(
    pages: DataFrame,
    page_id: str = "page_id",
    tokens: Sequence[str] = lex.CARD_LINK_TOKENS,
    places: Sequence[str] = lex.CARD_PLACE_WORDS,
) -> DataFrame:
    """Link table of `card_array`."""
    cards = card_array(F.col("dom"), F.col("lines"), F.col("line_at"), tokens, places)
    read = read_markup(pages.select(page_id, "html"), lines=True)
    return _row_per(read.select(page_id, cards.alias("_l")), page_id)


# --- C10 - C12 --------------------------------------------------------------


def ld_json_array(dom: Column) -> Column:
    """Texts of the structured-data script blocks in document order."""
    typed = F.transform(positions(dom, "[type=application/ld+json]"), lambda p: F.get(dom.els, p))
    return F.transform(F.filter(typed, lambda e: e.tag == "script"), lambda e: or_empty(e.raw))


def ld_json_blocks(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Parsed structured-data blocks; blocks that are not JSON are left out."""
    return (
        read_markup(pages.select(page_id, "html"), index=True)
        .select(page_id, F.posexplode(ld_json_array(F.col("dom"))).alias("pos", "raw"))
        .withColumn("doc", parse(F.col("raw")))
        .where(F.col("doc").isNotNull())
    )


def description_of(dom: Column) -> Column:
    """Main body text: tagged description, else main paragraphs, else longer lines."""
    by_attribute = F.map_filter(dom["at"], lambda k, _: k.rlike(r"(?i)^\[data-automation=[\s\S]*job.*description"))
    tagged = F.get(dom.els, F.array_min(F.flatten(F.map_values(by_attribute))))
    main_div = F.filter(F.transform(positions(dom, "[role=main]"), lambda p: F.get(dom.els, p)), lambda e: e.tag == "div")
    main = F.coalesce(first_element(dom, "main"), first_element(dom, "article"), F.get(main_div, F.lit(0)))
    paragraphs = let(
        main,
        lambda m: F.transform(
            F.filter(positions(dom, "p"), lambda p: (m.pos < p) & (p <= m["last"])), lambda p: F.get(dom.els, p)
        ),
    )
    body = F.array_join(
        F.filter(F.transform(paragraphs, lambda e: element_text(dom, e, HIDE_NONE, "")), lambda s: s != ""),
        "\n",
    )
    lines = F.filter(F.split(dom_text(dom), "\n"), lambda s: F.length(strip(s)) > 10)
    return F.coalesce(
        let(element_text(dom, tagged, HIDE_NONE, "\n"), lambda t: F.when(F.length(t) > 50, t)),
        let(body, lambda t: F.when(F.length(t) > 100, t)),
        F.array_join(F.slice(lines, 1, 100), "\n"),
    )


def main_description(pages: DataFrame) -> DataFrame:
    return read_markup(pages, index=True).withColumn("description", description_of(F.col("dom"))).drop("dom")


def is_signin(html: Column) -> Column:
    return html.contains("Sign In") & F.lower(html).contains("sign-in")


def drop_signin(pages: DataFrame) -> DataFrame:
    """Pages that are not a sign-in wall; a left join back keeps their listing rows."""
    return pages.where(~is_signin(or_empty(F.col("html"))))

