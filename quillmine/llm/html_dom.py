"""Block trees of HTML pages, however broken.

Inline elements dissolve into the text of the block around them; what is left
is a tree of blocks (tag, names, mark, items, links): each item a string or a
block, links a list of the number of characters in links. Scripts, styles and
other parts that are never text do not enter it. Nothing limits the depth.
"""

from __future__ import annotations

import html
import marshal
import re

#: Where something other than text begins; a tag's end is looked for by _tag_end.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_APART = re.compile(r"[^a-z0-9]+")

_NAMES = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))

#: Marks of a block: none, one that may also be a name for a part of the article,
#: one that is not of the article.
PLAIN, DOUBTFUL, ASIDE = range(3)

#: Elements of HTML and MathML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea title select button datalist map annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none "
    "mtable mtr mlabeledtr mtd maction".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
#: Elements that hold other parts of a page than its article.
ASIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class names and ids for what varies by page as an article does, so that
#: alignment cannot tell it from one: adverts and readers' comments.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense comment comments commentlist disqus promo promoted sponsor sponsored".split()
)
#: Words for other parts of pages, which can also name parts of articles: outside of the
#: article they count, in it alignment decides.
DOUBTFUL_WORDS = frozenset(
    "alert aside banner banners breadcrumb breadcrumbs consent cookie cookies discussion disclaimer footer footnav gdpr lightbox login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination paywall popup promotion rail recommendations recommended related replies reply respond search share sharing sidebar sidebars signup skip social "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Words beside them that say where a part of a page is, or what it looks like.
LAYOUT_WORDS = frozenset(
    "area article bar block body bottom box button buttons col column container content desktop entry first form global group header heading holder icon icons inner item items label large last left "
    "link links list main mobile outer page panel post primary right row secondary section site slot small text title top unit wrap wrapper".split()
)


def marks_of(attrs: str) -> tuple[str, int]:
    """Class and id words, and the mark that these, the role or the style give."""
    words: list[str] = []
    mark = PLAIN
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name not in _NAMES:
            continue
        if name in ("class", "id"):
            for token in value.split():
                parts = _APART.split(_CAMEL.sub("-", token).lower())
                # names with digits in them are a page's own
                parts = [p for p in parts if p.isalpha()]
                words += parts
                if not ASIDE_WORDS.isdisjoint(parts):
                    # a word among others is a name of something else: social-history, comment-style
                    plain = all(p in ASIDE_WORDS or p in DOUBTFUL_WORDS or p in LAYOUT_WORDS for p in parts)
                    mark = max(mark, ASIDE if plain else DOUBTFUL)
                elif not DOUBTFUL_WORDS.isdisjoint(parts):
                    mark = max(mark, DOUBTFUL)
        elif name == "role":
            mark = ASIDE if value.lower() in ASIDE_ROLES else mark
        elif name == "style":
            mark = ASIDE if "display:none" in value.lower().replace(" ", "") else mark
        elif name == "hidden" or value.lower() not in ("", "false"):
            mark = ASIDE
    return " ".join(words), mark


class _Parser:
    """The open elements, all of them blocks: inline ones leave no trace, but for
    those that are marked."""

    def __init__(self):
        self.root = ("#root", "", PLAIN, [], [0])
        self.open = [self.root]
        self.count: dict[str, int] = {}
        #: of marked inline elements: how many of the same name are open inside
        self.inside: list[tuple[int, list[int]]] = []
        self.links = 0

    def put(self, piece: str) -> None:
        if piece:
            node = self.open[-1]
            piece = html.unescape(piece)
            items = node[3]
            if items and isinstance(items[-1], str):
                items[-1] += piece
            else:
                items.append(piece)
            if self.links:
                node[4][0] += len(piece)

    def push(self, node: tuple) -> None:
        self.open[-1][3].append(node)
        self.open.append(node)
        self.count[node[0]] = self.count.get(node[0], 0) + 1

    def close_to(self, n: int) -> None:
        for node in self.open[n:]:
            self.count[node[0]] -= 1
        del self.open[n:]
        while self.inside and self.inside[-1][0] >= n:
            self.inside.pop()

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in INLINE:
            # an inline end tag does not close blocks
            if self.inside and self.inside[-1][0] == len(self.open) - 1 and self.open[-1][0] == tag:
                if self.inside[-1][1][0]:
                    self.inside[-1][1][0] -= 1
                else:
                    self.close_to(len(self.open) - 1)
        elif self.count.get(tag):
            n = len(self.open) - 1
            while self.open[n][0] != tag:
                n -= 1
            self.close_to(n)

    def begin(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and self.count.get("p"):
            for n in range(len(self.open) - 1, 0, -1):
                if self.open[n][0] == "p":
                    self.close_to(n)
                    break
                if self.open[n][0] in ("td", "th", "table", "li", "div", "article", "section", "main"):
                    break
        if tag in SAME_LEVEL and any(self.count.get(t) for t in SAME_LEVEL[tag]):
            for n in range(len(self.open) - 1, 0, -1):
                if self.open[n][0] in SAME_LEVEL[tag]:
                    self.close_to(n)
                    if tag not in ("tbody", "thead", "tfoot", "tr"):
                        break
                elif self.open[n][0] in SCOPES.get(tag, ("table",)):
                    break
        if tag in ("html", "body", "head"):
            return
        words, mark = marks_of(attrs) if attrs else ("", PLAIN)
        if tag in INLINE and mark != ASIDE:
            if tag == "a":
                self.links = 1
            if self.inside and self.inside[-1][0] == len(self.open) - 1 and self.open[-1][0] == tag:
                self.inside[-1][1][0] += 1
            return
        self.links = 0
        self.push((tag, words, ASIDE if tag in ASIDE_TAGS else mark, [], [0]))
        if tag in INLINE:
            self.inside.append((len(self.open) - 1, [0]))


class _Tags:
    """The ends of a page's tags, found in time that grows with the page: what a
    search has shown not to be there is not searched for again."""

    def __init__(self, text: str):
        self.text, self.last, self.loose = text, text.rfind(">"), -1
        self.open_raw: set[str] = set()

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`, -1 if none
        does. A > in quotes ends no tag, but where a quote has no partner quotes count
        for nothing up to it."""
        if at > self.last:
            return -1
        if at > self.loose:
            stop = _QUOTED.match(self.text, at).end()
            if stop < len(self.text) and self.text[stop] == ">":
                return stop
            self.loose = stop
        return self.text.find(">", at)

    def after_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no text, -1 if it has none."""
        if tag in self.open_raw:
            return -1
        found = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(self.text, at)
        if not found:
            self.open_raw.add(tag)
            return -1
        return self.text.find(">", found.start()) + 1 or len(self.text)


def parse(page: str | None) -> tuple:
    """The root block. A < that no > follows is text, as is one that no name follows."""
    text = page or ""
    state, at, tags = _Parser(), 0, _Tags(text)
    done = 0
    while m := _MARKUP.search(text, at):
        at = m.end()
        if m[3] is None:
            state.put(text[done : m.start()])
            done = at
            continue
        tag, end = m[3].lower(), tags.end(at)
        if end < 0:
            continue
        state.put(text[done : m.start()])
        attrs, at = text[at:end], end + 1
        if m[2]:
            state.end(tag)
        elif tag == "br":
            state.put(" ")
        elif tag in VOID:
            if tag == "hr":
                state.open[-1][3].append(("hr", "", PLAIN, [], [0]))
        elif tag in RAW:
            if not attrs.endswith("/"):
                end = tags.after_raw(tag, at)
                if end >= 0:
                    at = end
                elif tag in ("script", "style", "textarea", "title", "template", "iframe", "noscript"):
                    at = len(text)
        else:
            state.begin(tag, attrs)
        done = at
    state.put(text[done:])
    return state.root


def packed(root: tuple) -> bytes:
    """The tree as bytes: its blocks in page order, with gaps for blocks among the
    items, so that trees of any depth can be written."""
    out, todo = [], [root]
    while todo:
        tag, words, mark, items, links = todo.pop()
        out.append((tag, words, mark, [x if isinstance(x, str) else None for x in items], links))
        todo += [x for x in reversed(items) if not isinstance(x, str)]
    return marshal.dumps(out, 2)  # of this version, equal trees give equal bytes


def unpacked(data: bytes) -> tuple:
    rows = iter(marshal.loads(data))
    root = next(rows)
    todo = [(root, 0)]
    while todo:
        node, at = todo.pop()
        items = node[3]
        while at < len(items) and items[at] is not None:
            at += 1
        if at < len(items):
            items[at] = next(rows)
            todo += [(node, at + 1), (items[at], 0)]
    return root


def squeezed(text: str) -> str:
    return " ".join(text.split())
