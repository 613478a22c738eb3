"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its parent and, halved, to its grandparent; a container's
points are discounted by its share of link text. The best container is kept, widened to the article or main element
around it, together with siblings that score well, read like prose or stand between kept ones.

Elements and roles of menus, headers, footers, sidebars, notices, adverts, forms, scripts and styles are cut before scoring. A class or id is only a
hint: one that names such a part and nothing else (sidebar, cookie-notice, user-comments-list) cuts its element unless that holds the article or most of the page's prose, one that has
another word, too (social-science, related-work), cuts it only where its text is mostly links. Names of readers' comments always cut, classes that say what a page
lacks (no-comments, has-sidebar) never do, nor does an id of a heading or paragraph. Where little would be left, hints count less, then not at all. Lists and tables of links are left
out as menus outside article and main, if no prose stands before and after them. A header in the article gives its headings and its long paragraphs. Pages of any length and depth are read whole,
in time in proportion to their length.

A null or empty page, or one without text, gives an empty text. Broken markup is read as far as it goes: a tag
that is cut off at the end of the page is dropped. Repeated rows are treated one by one, and input columns named like results are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clausework.llm.session import table, without

QUERY = "op3_html_extraction"
ORACLE_SQL = None

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|(<[a-zA-Z][^>]*>)|([^<]+)|<[a-zA-Z/!?][^>]*\Z|(<)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp"}
_CUT = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "svg", "dialog", "menu", "object", "audio", "video", "canvas", "input", "fieldset"} | _RAW
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {
    "p", "div", "section", "article", "main", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "tbody", "thead", "tfoot", "caption", "blockquote", "pre",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "figcaption", "address", "details", "summary", "body", "html", "center", "hgroup",
} | (_CUT - {"button", "input", "svg", "select", "object"})
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_CUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CUT_WORD = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "aside", "comment", "comments",
    "commentlist", "disqus", "respond", "replies", "reply", "footer", "foot", "header", "masthead", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "widget", "rail", "copyright", "disclaimer", "skip", "tags", "outbrain", "taboola",
}
_COMMENT_WORD = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"}
#: Words that say where or what kind of box a named part is.
_NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "fixed", "form", "global", "group", "holder", "icon", "icons", "id", "inline", "inner",
    "item", "items", "left", "link", "links", "list", "main", "message", "module", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "show", "site", "slot", "small", "sticky",
    "story", "stories", "text", "thread", "title", "top", "unit", "user", "users", "view", "with", "wrap", "wrapper",
}
_STATES = {"has", "no", "not", "without", "hide", "js", "enable", "disable", "is"}  # a class that begins so tells of a state
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
_NO_HINT, _WEAK, _STRONG, _COMMENTS, _INTRO = range(5)
_BYLINE = re.compile(r"(?i)\s*(?:by|von|par|por|published|posted|updated)\b")  # how a line about the author or date begins
_KEEP_ALWAYS = {"html", "body", "article", "main"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Node:
    __slots__ = ("tag", "parent", "kids", "cut", "hint", "score", "chars", "linked")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, hint: int = _NO_HINT):
        self.tag, self.parent, self.cut, self.hint = tag, parent, cut, hint
        self.kids: list[_Node | str] = []
        self.score = self.chars = self.linked = 0


def _hint(value: str) -> int:
    """What a class or id says of its element."""
    most = _NO_HINT
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or parts[0] in _STATES or _CUT_WORD.isdisjoint(parts):
            continue
        alone = all(x in _CUT_WORD or x in _NEUTRAL for x in parts)
        most = max(most, _COMMENTS if alone and not _COMMENT_WORD.isdisjoint(parts) else _STRONG if alone else _WEAK)
    return most


def _judged(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether element or role cut, and what class and id hint at."""
    cut, hint = tag in _CUT, _NO_HINT
    if not attrs or tag in _KEEP_ALWAYS:
        return cut, hint
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _CUT_ROLE) or (name == "style" and "display:none" in value.replace(" ", "")):
            cut = True
        elif name == "class" or name == "id" and tag not in _TEXT:
            hint = max(hint, _hint(value))
    return cut, _NO_HINT if hint == _WEAK and tag in _INLINE else hint


def _parse(page: str) -> _Node:
    root = at = _Node("#root", None, False)
    pos, end = 0, len(page)
    open_: Counter[str] = Counter()  # open elements by name, so that nothing is sought that is not there

    def leave(node: _Node) -> None:
        """Close the open elements up to ``node`` and it, too."""
        nonlocal at
        while at is not node.parent:
            open_[at.tag] -= 1
            at = at.parent

    def above(stop: set[str], over: set[str] | None = None) -> _Node:
        up = at
        while up.parent is not None and up.tag not in stop and (over is None or up.tag not in over):
            up = up.parent
        return up

    while pos < end:
        m = _TOKEN.match(page, pos)
        if m is None:
            break
        pos = m.end()
        closing, tag, attrs, odd, text, lone = m.groups()
        if odd:
            parts = re.match(r"<([a-zA-Z][^\s/>]*)", odd)
            closing, tag, attrs = "", parts[1], ""
        if text or lone:
            at.kids.append(text or lone)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if open_[tag] > 0:
                leave(above({tag}))
            continue
        if tag == "br":
            at.kids.append(" ")
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = stop.end() if stop else end
            continue
        if tag in _BLOCK and any(open_[x] > 0 for x in ("p", *_HEADING)):
            up = above({"p", *_HEADING}, _BLOCK)
            if up.tag == "p" or (up.tag in _HEADING and tag in _HEADING | {"p"}):
                leave(up)
        if tag in _CLOSES and any(open_[x] > 0 for x in _CLOSES[tag]):
            up = above(_CLOSES[tag], {"ul", "ol", "dl", "table", "body"})
            if up.tag in _CLOSES[tag]:
                leave(up)
        inside = open_["article"] > 0 or open_["main"] > 0
        cut, hint = _judged(tag, attrs)
        cut = cut or at.cut
        if tag == "button" and not at.cut and any(open_[x] > 0 for x in ("p", "td", *_HEADING)):
            cut = False  # a word of a sentence
        if tag == "header" and not at.cut and inside:
            cut = False
        if at.tag == "header" and not at.cut:
            cut, hint = cut or tag in ("div", "span", "li"), _INTRO if tag == "p" else hint
        elif tag in _INLINE and hint < _COMMENTS and any(open_[x] > 0 for x in ("p", "td", *_HEADING)):
            hint = _NO_HINT  # words of a sentence
        node = _Node(tag, at, cut, hint)
        at.kids.append(node)
        if tag not in _VOID and not attrs.rstrip().endswith("/"):
            at = node
            open_[tag] += 1
    return root


def _title(container: _Node) -> None:
    """Give the headings of a header in the chosen container back, unless it holds a menu, too."""
    for k in container.kids:
        if isinstance(k, _Node) and k.tag == "header" and k.cut:
            below = [x for x in k.kids if isinstance(x, _Node)]
            if any(x.tag in ("nav", "ul", "form") for x in below):
                continue
            if heads := [x for x in below if x.tag in _HEADING]:
                k.cut, k.kids = False, heads
                stack = list(heads)
                while stack:
                    x = stack.pop()
                    x.cut = x.tag in _CUT
                    stack += [y for y in x.kids if isinstance(y, _Node)]


def _order(root: _Node) -> list[_Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, _Node) and not k.cut]
    return out


def _score(nodes: list[_Node]) -> None:
    commas = {}
    for n in reversed(nodes):
        own = [k for k in n.kids if isinstance(k, str)]
        n.chars += sum(len(k.strip()) for k in own)
        commas[id(n)] = commas.get(id(n), 0) + sum(k.count(",") for k in own)
        if n.tag == "a":
            n.linked = n.chars
        p = n.parent
        if p is not None:
            p.chars += n.chars
            p.linked += n.linked
            if n.tag not in _BLOCK:
                commas[id(p)] = commas.get(id(p), 0) + commas[id(n)]
    for n in nodes:
        direct = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        if n.tag in ("p", "pre", "blockquote", "li", "td") and n.chars:
            points, up = 1 + commas[id(n)] + min(n.chars / 100, 3), n.parent
        elif n.tag in ("article", "main", "div", "section", "body", "center") and direct:
            points, up = 1 + commas[id(n)] + min(direct / 100, 3), n
        else:
            continue
        points *= 1 - n.linked / max(n.chars, 1)
        if up is not None:
            up.score += points
            if up.parent is not None:
                up.parent.score += points / 2


def _density(n: _Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _text_of(n: _Node) -> str:
    out, stack = [], [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.cut:
            stack += reversed(k.kids)
    return " ".join("".join(out).split())


def _follow_hints(root: _Node, least: int) -> None:
    """Cut what hints of ``least`` or more name, by what its text is like."""
    nodes = _order(root)
    holds = {id(n): [n.tag in ("article", "main"), n.tag in _TEXT] for n in nodes}  # how many articles, and blocks of text
    for n in reversed(nodes):
        n.chars += sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        if n.tag == "a":
            n.linked = n.chars
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            above = holds[id(n.parent)]
            above[0], above[1] = above[0] + holds[id(n)][0], above[1] + holds[id(n)][1]
    prose, articles = root.chars - root.linked, holds[id(root)][0]

    def is_the_text(n: _Node) -> bool:
        """Most of the page's prose, with its article or else some blocks of text."""
        inside, texts = holds[id(n)]
        return 2 * (n.chars - n.linked) > prose and (inside > 0 or not articles and texts > 1)

    for n in nodes:
        if n.parent is not None and n.parent.cut:
            n.cut = True
        elif n.hint == _INTRO:
            n.cut = n.chars < 50 or _density(n) > 0.25 or bool(_BYLINE.match(_text_of(n)))
        elif n.hint >= least:
            n.cut = n.hint == _COMMENTS or n.hint == _WEAK and _density(n) > 0.4 or n.hint == _STRONG and not is_the_text(n)
    for n in nodes:
        n.chars = n.linked = 0


def _reads_as_prose(n: _Node) -> bool:
    return n.chars > 0 and _density(n) <= 0.25 and (n.tag in _TEXT or n.tag in ("table", "ul", "ol", "dl", "figure", "details") or re.search(r"\w\W*[.!?:;]|[\u3002\uff01\uff1f]", _text_of(n)) is not None)


def _kept(root: _Node) -> list[_Node]:
    nodes = _order(root)
    _score(nodes)
    best = max((n for n in nodes if n.score > 0), key=lambda n: n.score * (1 - _density(n)), default=None)
    if best is None:
        rest = [n for n in nodes if n.tag in ("article", "main")] or [n for n in nodes if n.tag == "body"] or [root]
        return rest[:1]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    while best.parent is not None and best.tag in ("ul", "ol", "table", "tbody", "tr", "dl", "p", "li", "td"):
        best = best.parent
    if best.parent is None or best.tag == "body":
        return [best]
    if best.tag not in ("article", "main"):
        _title(best)
    least = max(4.0, 0.2 * best.score)
    whole = best.tag in ("article", "main")
    around = [k for k in best.parent.kids if isinstance(k, _Node) and not k.cut]
    kept = set()
    for i, k in enumerate(around):
        scored = k.tag in ("article", "section", "div", "main") and k.score * (1 - _density(k)) >= least
        told = not whole and (k.tag in _HEADING or (k.tag in _BLOCK and (k.tag not in ("div", "section", "center") or best.parent.tag != "body") and _reads_as_prose(k)))
        if k is best or scored or told:
            kept.add(i)
    if not whole:  # what stands between kept parts belongs to them
        kept = {i for i in range(min(kept), max(kept) + 1) if i in kept or around[i].tag in _BLOCK and _density(around[i]) <= 0.5}
    return [around[i] for i in sorted(kept)]


def _links_of_article(n: _Node) -> bool:
    """Whether a list of links has prose before and after it."""
    sides = n.parent.kids
    at = next(i for i, k in enumerate(sides) if k is n)
    prose = lambda some: any(isinstance(k, _Node) and not k.cut and k.tag in ("p", "blockquote", "pre") and k.chars and _density(k) <= 0.25 for k in some)
    return prose(sides[:at]) and prose(sides[at + 1 :])


def _written(root: _Node) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    for top in _kept(root):
        menus = top.tag not in ("article", "main")
        stack: list[_Node | str | None] = [None, top]
        while stack:
            k = stack.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                line.append(k)
            elif k.cut or menus and k.tag in ("ul", "ol", "div", "section", "table", "dl") and k is not top and k.chars and _density(k) > 0.5 and not _links_of_article(k):
                continue
            else:
                block = k.tag in _BLOCK
                if block:
                    flush()
                    stack.append(None)
                if k.tag in ("td", "th"):
                    line.append(" ")
                stack += reversed(k.kids)
        flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by newlines."""
    if not page:
        return ""
    text = ""
    for least in (_WEAK, _COMMENTS, _INTRO):
        root = _parse(page)
        _follow_hints(root, least)
        text = _written(root)
        if least == _WEAK:
            enough = 0.1 * sum(len(k.strip()) for n in _order(root) for k in n.kids if isinstance(k, str))
        if text and len(text) >= enough:
            break
    return text


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; the html itself is dropped."""
    kept = without(pages, *{"text", "n_chars"} - {html_col})
    names = [c for c in kept.columns if c != html_col]
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(html_col)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, "text", "n_chars"]
            )

    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
