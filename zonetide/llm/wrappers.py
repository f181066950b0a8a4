"""HTML extraction by union-free regular expressions (wrappers) inferred for each host.

A page is a stream of tags and texts. Groups of tokens that follow one another are folded to one repeated group. The
folded streams of some pages of a host are aligned one after the other: equal tags stay, texts that differ become slots,
tags that only one side has become optional. What results is the host's wrapper: no alternatives, only optional and
repeated groups and slots. From its slots the main container is chosen: an article, else a main element, else the
element that holds most of the text that varies from page to page. Text of a page is kept if it stands in the main
container, in no element that is a menu, header, footer, notice, advert, form, script, style or comment section, and
is not the host's own fixed text outside an article.

A wrapper is inferred from the ``SAMPLE`` pages of a host with the smallest hash; every page is extracted, whole. Null html:
empty text. A null or hostless url belongs to a host of its own, "". Repeated pages are extracted each for itself;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 16
#: A fixed text must have been met on this many pages of a host.
FIXED_PAGES = 3
_LONGEST_GROUP = 12
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "fieldset", "label"}
_DROPPED_NAME = re.compile(
    r"^(ads?|adverts?|advertisements?|banners?|cookies?|consent|notices?|alerts?|sidebars?|side|menus?|nav|navbar|navigation|navbox|footers?|headers?|masthead|topbar|"
    r"comments?|replies|reply|respond|disqus|share|sharing|social|promos?|promoted|sponsored|related|recommended|popups?|modal|newsletter|subscribe|signup|login|search|"
    r"breadcrumbs?|pagination|pager|widgets?|contentinfo|complementary)$", re.I)
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
           "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
           "th", "thead", "tr", "ul"}
#: Tags that a new block closes, and tags that close one of their own kind.
_CLOSED_BY_BLOCK = {"p"}
_CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "td", "th", "nav", "aside", "blockquote"}


class Token:
    """A tag or a text, with the elements it stands in: ``inside`` are keys like ``div.content``, ``dropped`` if one is not content."""

    __slots__ = ("key", "text", "tag", "inside", "dropped")

    def __init__(self, key: str, text: str | None, tag: str, inside: tuple[str, ...], dropped: bool):
        self.key, self.text, self.tag, self.inside, self.dropped = key, text, tag, inside, dropped


def _names(attributes: str) -> list[str]:
    return [n for _, v in _ATTRIBUTE.findall(attributes) for n in v.strip("\"'").split()]


def _not_content(tag: str, names: list[str], inside: tuple[str, ...]) -> bool:
    if tag == "header" and any(k.split(".")[0] in ("article", "main") for k in inside):
        return False
    return tag in _DROPPED or (tag not in ("html", "body", "article", "main") and any(_DROPPED_NAME.match(p) for n in names for p in [n, *re.split(r"[-_]", n)[:1]])) or (
        tag == "article" and any(_DROPPED_NAME.match(n) for n in names))


def tokens(page: str) -> list[Token]:
    """Tags and texts of a page in order; contents of scripts, styles and the like are left out."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool]] = []
    inside: tuple[str, ...] = ()
    at, end = 0, len(page)

    def again() -> tuple[tuple[str, ...], bool]:
        return tuple(k for _, k, _ in stack), any(d for *_, d in stack)

    dropped = False
    while at < end:
        m = _MARKUP.search(page, at)
        text = page[at:m.start() if m else end]
        if text and not text.isspace():
            out.append(Token("#", text, "", inside, dropped))
        elif text:
            out.append(Token(" ", text, "", inside, dropped))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            inside, dropped = again()
            out.append(Token("/" + tag, None, tag, inside, dropped))
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        closing = (_CLOSED_BY_BLOCK if tag in _BLOCKS else set()) | _CLOSES_OWN.get(tag, set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closing:
                del stack[k:]
                break
            if stack[k][0] in _SCOPES and stack[k][0] not in closing:
                break
        inside, dropped = again()
        names = _names(m[3])
        key = tag + (("." + names[0]) if names else "")
        if tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append((tag, key, _not_content(tag, names, inside)))
            inside, dropped = again()
        out.append(Token(key, None, tag, inside, dropped))
    return out


class Node:
    """One position of a wrapper: a tag or a text, maybe optional; ``text`` None: a slot. ``pages``: how many agreed on the text."""

    __slots__ = ("key", "text", "optional", "many", "pages")

    def __init__(self, key: str, text: str | None, optional: bool = False, many: bool = False, pages: int = 1):
        self.key, self.text, self.optional, self.many, self.pages = key, text, optional, many, pages


def fold(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """Fold groups that repeat; also the place of each input node in the result."""
    out: list[Node] = []
    members: list[list[int]] = []
    for number, node in enumerate(nodes):
        out.append(node)
        members.append([number])
        for size in range(1, _LONGEST_GROUP + 1):
            if len(out) < 2 * size:
                break
            if out[-1].key != out[-1 - size].key or any(out[-1 - k].key != out[-1 - size - k].key for k in range(size)):
                continue
            if size == 1 and out[-1].key != "#" and out[-1].key[0] != "/" and out[-1].key.split(".")[0] not in ("br", "hr", "img"):
                continue  # a tag opened twice is nested, not repeated
            for k in range(size):
                first, second = out[-1 - size - k], out[-1 - k]
                out[-1 - size - k] = Node(first.key, first.text if first.text == second.text else None, first.optional or second.optional, True, max(first.pages, second.pages))
                members[-1 - size - k] += members[-1 - k]
            del out[-size:], members[-size:]
            break
    place = [0] * len(nodes)
    for k, group in enumerate(members):
        for number in group:
            place[number] = k
    return out, place


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def stream(found: list[Token]) -> tuple[list[Node], list[int]]:
    """Folded nodes of a page, and for each token that is no white space its place among them."""
    return fold([Node(t.key, _plain(t.text) if t.text is not None else None) for t in found if t.key != " "])


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper that also matches ``page``."""
    out: list[Node] = []
    match = SequenceMatcher(None, [n.key for n in wrapper], [n.key for n in page], autojunk=False)
    for kind, a, b, c, d in match.get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[a:b], page[c:d], strict=True):
                same = x.text is not None and x.text == y.text
                out.append(Node(x.key, x.text if same else None, x.optional or y.optional, x.many or y.many, x.pages + same))
        else:
            out += [Node(n.key, n.text, True, n.many, n.pages) for n in (*wrapper[a:b], *page[c:d])]
    return fold(out)[0]


def infer(pages: list[str]) -> dict:
    """Wrapper of some pages of one host: nodes and the key of the main container."""
    wrapper: list[Node] | None = None
    mass: Counter = Counter()
    parsed = [tokens(p) for p in pages]
    for found in parsed:
        page = stream(found)[0]
        wrapper = page if wrapper is None else align(wrapper, page)
    fixed = {n.text for n in wrapper or [] if n.key == "#" and n.text and n.pages >= FIXED_PAGES}
    for found in parsed:
        for t in found:
            if t.key == "#" and not t.dropped and _plain(t.text) not in fixed:
                for k in set(t.inside):
                    mass[k] += len(t.text)
    total = max(mass.values(), default=0)
    keys = [k for k in mass if k.split(".")[0] == "article"] or [k for k in mass if k.split(".")[0] == "main"]
    if not keys:  # the smallest element that still holds most of the varying text, and is no text block itself
        keys = sorted((k for k in mass if mass[k] >= 0.7 * total and k.split(".")[0] in ("body", "div", "section", "td")), key=lambda k: (mass[k], k))[:1]
    return {"nodes": [[n.key, n.text, n.optional, n.many, n.pages] for n in wrapper or []], "main": sorted(keys)}


def extract(page: str, wrapper: dict | None) -> str:
    """Main text of a page by its host's wrapper: blocks joined by two line feeds."""
    found = tokens(page)
    nodes = [Node(*n) for n in wrapper["nodes"]] if wrapper else []
    folded, place = stream(found)
    fixed = [False] * len(folded)
    match = SequenceMatcher(None, [n.key for n in nodes], [n.key for n in folded], autojunk=False)
    for a, b, size in match.get_matching_blocks():
        for k in range(size):
            x, y = nodes[a + k], folded[b + k]
            fixed[b + k] = x.text is not None and x.text == y.text and x.pages >= FIXED_PAGES
    main = set(wrapper["main"]) if wrapper else set()
    main = main & {k for t in found for k in t.inside}
    if not main:
        main = {k for t in found for k in t.inside if k.split(".")[0] in ("article", "main")}
    out: list[str] = []
    block: list[tuple[str, bool]] = []  # texts, and whether each is the host's fixed text

    def close() -> None:
        text = " ".join("".join(x for x, _ in block).split())
        if text and not all(known for _, known in block):
            out.append(text)
        block.clear()

    number = 0
    for t in found:
        where = None
        if t.key != " ":
            where = place[number]
            number += 1
        if t.text is None:
            if t.tag in _BLOCKS:
                close()
            elif t.tag == "br":
                block.append((" ", True))
            continue
        held = not t.dropped and (not main or any(k in main for k in t.inside))
        article = any(k.split(".")[0] in ("article", "main") for k in t.inside)
        if held:
            block.append((entities.unescape(t.text), not article and (where is None or fixed[where])))
    close()
    return "\n\n".join(out)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper as JSON), inferred from at most ``sample`` pages a host; the rest of a host is cut before the shuffle."""
    order = W.partitionBy("host").orderBy(F.xxhash64("page_id", "html"), "page_id", "html")
    some = pages.select(host_of(F.col("url")).alias("host"), "page_id", "html").filter(F.col("html").isNotNull())
    some = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample)

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        return pa.table({"host": [rows[0]["host"]], "wrapper": [json.dumps(infer([r["html"] for r in rows]))]})

    return some.groupBy("host").applyInArrow(run, "host string, wrapper string")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: page_id, url and text."""
    known = wrappers(pages, sample)
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, raw in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if raw is not None and raw not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[raw] = json.loads(raw)
                texts.append(extract(page, parsed.get(raw)) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
