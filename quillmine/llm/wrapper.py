"""HTML extraction by wrapper induction.

Pages of a host share a template. One page of each host of two or more, the one
with the smallest hash, is its pattern; the block tree of every page of the host
is aligned with it by simple tree matching (a match of two roots plus the best
order-keeping match of their children). Blocks that the pattern lacks join it
under the block they hang from, by the tags and classes of the way to them, so
further layouts and blocks of few pages are learned too. Each text of a block is
counted over the pages that have the block. A text that most of these share is
template, and so is, at a block that nearly always has it, another of like length.

What is left varies, and chooses the content: the smallest block that holds most
of the page's varying text outside what is marked as menu, notice, advert, form,
comments and the like. Article or main elements that hold as much confirm the
choice and give its borders; if they do not, they are passed over. Only where
nothing varies, or a host has one page, do the marks alone, or else the mass of
text, choose. Inside the content all text is taken but template and parts that are
not of the article: by their element or role, or by a class or id that names
adverts or readers' comments and has no other word in it (``comments``,
``ad-slot``), as the text of these varies like the article's own. Other names,
which may be those of an article's parts (``menu``, ``banner``, ``discussion``),
count only where the alignment finds the block on most pages of the host, and in
article or main elements only if it is mostly links besides. A marked part of a
line leaves it without breaking it. Content that is mostly "template" is
that of copies, and stays.

Two lists of children are matched exactly, however long; equal subtrees at their
ends are matched beforehand, which loses nothing.

Pages are parsed once; counts are summed by (host, block, text) before anything
is gathered by host, and a host's rule is as large as its template, so a host may
hold any share of the pages.

Cases: null or empty html gives an empty text; pages without a host are one
host; equal pages of a host count as one; equal page ids are extracted each; of
pages with equal hashes the one with the smallest id is the pattern; pages of any
length and depth are parsed whole, in time that grows with their length, whatever
tags, quotes and comments stay open; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, lean, written
from .html_dom import ASIDE, DOUBTFUL, INLINE, packed, parse, squeezed, unpacked

#: Pages of a host, and with a text at a block, from which there is a template.
MIN_PAGES = 2
#: Template is a text that so many of a block's pages have, one page not counted: of
#: two pages both, of four three, of many half. Texts that more than SHARE_OF_ALL have
#: make others at their place template too.
SHARE, SHARE_OF_ALL = 0.5, 0.8
#: Share of the varying text that the content block holds.
CONTENT_SHARE = 0.6
#: A table up to this size is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Pairs of children whose table is kept at once, and for how few it is made one by one.
CELLS, FEW_CELLS = 1 << 18, 400
#: Shapes and pairs of them that are remembered for a pattern.
KNOWN = 50_000
#: Blocks around an article inside the main element that are of the article.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure".split())
#: Stands for the text of a block with a doubtful mark in the counts.
MARKED = 0


def _kids(node: tuple) -> list[tuple]:
    return [x for x in node[3] if x.__class__ is not str]


def _own_text(node: tuple) -> str:
    return squeezed(" ".join(x for x in node[3] if isinstance(x, str)))


class Matching:
    """Simple tree matching. Equal subtrees, by tags, names and marks, have one
    number, a shape; scores are kept by pairs of shapes."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.heads: list[tuple] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def learn(self, root: tuple) -> dict[int, int]:
        """The shape of each block by its id()."""
        shapes: dict[int, int] = {}
        order, todo, depth = [], [(root, 1, _kids(root))], 1
        while todo:
            node, level, kids = todo.pop()
            order.append((node, kids))
            depth = max(depth, level)
            todo += [(k, level + 1, _kids(k)) for k in kids]
        for node, below in reversed(order):
            kids = tuple([shapes[id(k)] for k in below])
            key = (node[0], node[1], node[2], kids)
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.size)
                self.heads.append((node[0], node[2], node[1], frozenset(node[1].split())))
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))
            shapes[id(node)] = number
        if 8 * depth > 1000:
            sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 1000))
        return shapes

    def score(self, a: int, b: int) -> int:
        """Blocks of the best match of two shapes."""
        if a == b:
            return self.size[a]
        x, y = self.heads[a], self.heads[b]
        if x[0] != y[0] or x[1] != y[1] or x[2] != y[2] and x[3].isdisjoint(y[3]):
            return 0
        if not self.kids[a] or not self.kids[b]:
            return 1
        if (a, b) not in self.known:
            self.known[a, b] = 1 + sum(s for *_, s in self.pairs(self.kids[a], self.kids[b]))
        return self.known[a, b]

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """The best order-keeping pairs (place, place, score) of two lists of shapes."""
        a, b, c = 0, len(x), len(y)
        while a < b and a < c and x[a] == y[a]:
            a += 1
        while a < b and a < c and x[b - 1] == y[c - 1]:
            b, c = b - 1, c - 1
        out = [(i, i, self.size[x[i]]) for i in range(a)]
        if a < b and a < c:
            middle = self._few if (b - a) * (c - a) <= FEW_CELLS else self._many
            out += [(a + i, a + j, s) for i, j, s in middle(x[a:b], y[a:c])]
        return out + [(b + i, c + i, self.size[x[b + i]]) for i in range(len(x) - b)]

    def _few(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int, int]]:
        own = [[self.score(p, q) for q in y] for p in x]
        best = [[0] * (len(y) + 1)]
        for row in own:
            new, up = [0], best[-1]
            for j, s in enumerate(row):
                new.append(max(new[j], up[j + 1], up[j] + s))
            best.append(new)
        i, j, out = len(x), len(y), []
        while i and j:
            if own[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + own[i - 1][j - 1]:
                out.append((i - 1, j - 1, own[i - 1][j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def _many(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """As _few, a row of the table at a time. Larger tables are not kept: a row from
        above and one from below give the place where the best way passes the middle, and
        each half is a table of its own, so memory grows with the lists and not with
        their product."""
        kinds, kind = np.unique(np.array(y), return_inverse=True)
        shapes = kinds.tolist()
        held: dict[int, np.ndarray] = {}

        def own(p: int) -> np.ndarray:
            if p not in held:
                if len(held) >= 64:
                    held.clear()
                held[p] = np.array([self.score(p, q) for q in shapes], dtype=np.int64)
            return held[p][kind]

        def after(up: np.ndarray, scores: np.ndarray) -> np.ndarray:
            row = up.copy()
            np.maximum(row[1:], up[:-1] + scores, out=row[1:])
            return np.maximum.accumulate(row)

        out, todo = [], [(0, len(x), 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) > CELLS and b - a > 1:
                middle = (a + b) // 2
                above, below = np.zeros(d - c + 1, dtype=np.int64), np.zeros(d - c + 1, dtype=np.int64)
                for p in x[a:middle]:
                    above = after(above, own(p)[c:d])
                for p in reversed(x[middle:b]):
                    below = after(below, own(p)[c:d][::-1])
                cut = c + int((above + below[::-1]).argmax())
                todo += [(middle, b, cut, d), (a, middle, c, cut)]
                continue
            scores = [own(p)[c:d] for p in x[a:b]]
            best = [np.zeros(d - c + 1, dtype=np.int64)]
            for row in scores:
                best.append(after(best[-1], row))
            i, j, way = b - a, d - c, []
            while i and j:
                s = scores[i - 1][j - 1]
                if s and best[i][j] == best[i - 1][j - 1] + s:
                    way.append((a + i - 1, c + j - 1, int(s)))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            out += way[::-1]
        return out

    def aligned(self, a: tuple, b: tuple, shapes: dict[int, int] | None = None) -> list[tuple[tuple, tuple]]:
        """All matched pairs of blocks of the two trees; shapes: those of the first, if
        they were learned before."""
        shapes = shapes or self.learn(a)
        others = self.learn(b)
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            out.append((a, b))
            x, y = _kids(a), _kids(b)
            if shapes[id(a)] == others[id(b)]:
                todo += zip(x, y)
            elif x and y:
                matched = self.pairs(tuple([shapes[id(k)] for k in x]), tuple([others[id(k)] for k in y]))
                todo += [(x[i], y[j]) for i, j, _ in matched]
        return out


def _numbered(root: tuple) -> tuple[list[tuple], dict[int, int], list[int]]:
    """Blocks in page order, the number of each by its id(), and each one's parent."""
    nodes, number, parent, todo = [], {}, [], [(root, -1)]
    while todo:
        node, up = todo.pop()
        number[id(node)] = len(nodes)
        nodes.append(node)
        parent.append(up)
        todo += [(k, number[id(node)]) for k in reversed(_kids(node))]
    return nodes, number, parent


def _find(node: tuple, wanted) -> list[tuple]:
    """Outermost blocks that fit, outside what is not of the article."""
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if node[2] == ASIDE:
            continue
        if wanted(node):
            out.append(node)
        else:
            todo += reversed(_kids(node))
    return out


def _article(node: tuple) -> bool:
    return node[0] == "article"


def content_roots(root: tuple) -> list[tuple]:
    """The page's article elements, with headings and paragraphs beside a single one
    in the main element; or else the main element."""
    articles = _find(root, _article)
    mains = _find(root, lambda n: n[0] == "main" or "main" == n[1] or n[1] == "content")
    if not articles:
        return mains
    if len(articles) > 1 or len(mains) != 1 or _find(mains[0], _article) != articles or _article(mains[0]):
        return articles
    nodes, number, parent = _numbered(mains[0])
    way, at = set(), number[id(articles[0])]
    while at:
        at = parent[at]
        way.add(id(nodes[at]))
    out, todo = [], [mains[0]]
    while todo:
        node = todo.pop()
        if id(node) in way:
            todo += reversed(_kids(node))
        elif node is articles[0] or node[0] in PROSE and node[2] != ASIDE:
            out.append(node)
    return out


def _densest(root: tuple, mass: dict[int, int]) -> tuple:
    """The smallest block under root that holds CONTENT_SHARE of its mass."""
    total = mass.get(id(root), 0)
    node = root
    while total:
        # a paragraph is not all of the content, however long
        inner = [k for k in _kids(node) if mass.get(id(k), 0) >= CONTENT_SHARE * total and _kids(k)]
        if not inner:
            break
        node = inner[0]
    return node


def _masses(nodes: list[tuple], parent: list[int], own: list[int]) -> dict[int, int]:
    total = list(own)
    dead = [False] * len(nodes)
    for i, n in enumerate(nodes):
        dead[i] = n[2] > 0 or (parent[i] >= 0 and dead[parent[i]])
        if dead[i]:
            total[i] = 0
    for i in range(len(nodes) - 1, 0, -1):
        total[parent[i]] += total[i]
    return {id(n): t for n, t in zip(nodes, total)}


def page_text(roots: list[tuple], template: set[int], away: set[int]) -> str:
    """The blocks' text, one line each; id() of blocks whose own text, and of those
    that are left out whole."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (line := squeezed("".join(run))):
            lines.append(line)
        run.clear()

    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if x is not None and x[0] in INLINE:  # a marked part of a line: the line goes on behind it
            continue
        flush()
        if x is not None and x[2] != ASIDE and id(x) not in away:
            todo.append(None)
            todo += [y for y in reversed(x[3]) if not (id(x) in template and isinstance(y, str))]
    flush()
    return "\n".join(lines)


def _linked(node: tuple) -> bool:
    """Whether most of the block's text is links."""
    text = links = 0
    todo = [node]
    while todo:
        n = todo.pop()
        text += sum(len(x) for x in n[3] if isinstance(x, str))
        links += n[4][0]
        todo += _kids(n)
    return 2 * links >= text


def _off_headers(root: tuple, inside: bool = False) -> set[int]:
    """Page headers: header elements that no article or main element is around."""
    out, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside |= node[0] in ("article", "main")
        if not inside and (node[0] == "header" or "header" in node[1].split()):
            out.add(id(node))
            continue
        todo += [(k, inside) for k in _kids(node)]
    return out


class Pattern:
    """A host's pattern page, and what matching has learned with it."""

    def __init__(self, tree: bytes):
        self.root = unpacked(tree)
        _, self.number, _ = _numbered(self.root)
        self.matching = None

    def places(self, page: tuple) -> dict[int, int]:
        """The number of the pattern's block by the id() of the page's block."""
        if self.matching is None or len(self.matching.size) + len(self.matching.known) > KNOWN:
            self.matching = Matching()
            self.shapes = self.matching.learn(self.root)
        return {id(b): self.number[id(a)] for a, b in self.matching.aligned(self.root, page, self.shapes)}


_pattern = lru_cache(maxsize=16)(Pattern)


def _hash(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Places below this are those of the n-th blocks of their kind.
NTH = -(1 << 61)


def placed(root: tuple, pattern: bytes) -> list[tuple[int, int, tuple, str]]:
    """(place, narrow place, block, text) of a page's blocks: the number of the
    pattern's block, or below zero a hash of the block they hang from and the way
    from there; that with the block's number among its like is the narrow one."""
    at = _pattern(pattern).places(root)
    out, todo = [], [(root, at[id(root)], "", "", 0)]
    while todo:
        node, anchor, way, narrow, nth = todo.pop()
        if id(node) in at:
            anchor, way, narrow = at[id(node)], "", ""
            place = exact = anchor
        else:
            way += f"/{node[0]}.{node[1]}"
            narrow += f"/{node[0]}.{node[1]}.{nth}"
            place = -1 - (_hash(f"{anchor}{way}") & (1 << 61) - 1)
            exact = NTH - 1 - (_hash(f"{anchor}{narrow}") & (1 << 61) - 1)
        out.append((place, exact, node, _own_text(node)))
        like: dict[tuple, int] = {}
        for k in _kids(node):
            n = like[k[:2]] = like.get(k[:2], 0) + 1
            todo.append((k, anchor, way, narrow, n))
    return out


def place_texts(tree: bytes, pattern: bytes) -> list[tuple[int, int, int, bool]]:
    """(place, hash of the text, its length, whether the place is new) of a page,
    each text once a place; length zero for blocks without text, and -1 for blocks
    with a doubtful mark, once more."""
    seen: dict[int, set[int]] = {}
    out = []
    for place, exact, node, text in placed(unpacked(tree), pattern):
        h = _hash(text)
        if node[2] == DOUBTFUL and MARKED not in seen.setdefault(place, set()):
            out.append((place, MARKED, -1, not seen[place]))
            seen[place].add(MARKED)
        for at in {place, exact}:
            new = at not in seen
            if h not in seen.setdefault(at, set()):
                seen[at].add(h)
                out.append((at, h, len(text), new))
    return out


def extract(tree: bytes, pattern: bytes | None, rule: dict[tuple[int, int], tuple[int, bool]]) -> str:
    """rule: the length of template texts by place and hash, and whether others of
    like length are template there, on pages without the usual text; length -1 for
    places of blocks with a doubtful mark that most pages have."""
    root = unpacked(tree)
    headers = _off_headers(root)
    marked = content_roots(root)
    nodes, _, parent = _numbered(root)
    template: set[int] = set()
    doubtful = {id(n) for n in nodes if n[2] == DOUBTFUL} if pattern is None else set()
    roots: list[tuple] = []
    if rule:
        usual = {place: (h, chars) for (place, h), (chars, all_of_it) in rule.items() if all_of_it}
        blocks = [(place, exact, node, text, _hash(text)) for place, exact, node, text in placed(root, pattern)]
        doubtful = {id(node) for place, _, node, *_ in blocks if node[2] == DOUBTFUL and (place, MARKED) in rule}
        there = {h for *_, h in blocks}
        for place, exact, node, text, h in blocks:
            common, chars = usual.get(exact, (0, 0))
            if text and ((place, h) in rule or common not in there and chars / 2 <= len(text) <= 2 * chars):
                template.add(id(node))
        length = {id(node): len(text) for _, _, node, text, _ in blocks}
    else:
        length = {id(n): len(_own_text(n)) for n in nodes}
    own = [0 if id(n) in headers else length[id(n)] for n in nodes]
    mass = _masses(nodes, parent, own)
    if rule:
        varying = _masses(nodes, parent, [0 if id(n) in template else size for n, size in zip(nodes, own)])
        if total := varying[id(root)]:
            fits = sum(varying[id(n)] for n in marked) >= CONTENT_SHARE * total
            roots = marked if fits else [_densest(root, varying)]
    if roots and 2 * sum(varying[id(n)] for n in roots) < sum(mass[id(n)] for n in roots) and marked:
        template = set()  # copies of one article are no template
    if not roots:
        template = set()
        roots = marked or [_densest(root, mass)]
    if roots is marked:
        doubtful = {id(n) for n in nodes if id(n) in doubtful and _linked(n)}
    doubtful -= {id(n) for n in roots}
    if headers:
        roots = [x for x in (_pruned(x, headers) for x in roots) if x is not None]
    return page_text(roots, template, doubtful)


def _pruned(node: tuple, away: set[int]) -> tuple | None:
    """The block without some inside it; itself if none is."""
    if id(node) in away:
        return None
    todo = [node]
    while todo:
        n = todo.pop()
        n[3][:] = [x for x in n[3] if isinstance(x, str) or id(x) not in away]
        todo += _kids(n)
    return node


def _joined(spark: SparkSession, pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """hosts is a written table: its size is known before the join is chosen."""
    size = int(str(hosts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # parquet is compressed; a row in memory takes a few times as much
    return pages.join(F.broadcast(hosts) if 4 * size <= BROADCAST_BYTES else hosts, "host", "left")


def extract_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    bounded_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def parsed(batches):
        for batch in batches:
            trees = pa.array([packed(parse(h)) for h in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], trees], names=["page_id", "url", "host", "tree"])

    trees = written(spark, rows.mapInArrow(lean(parsed), "page_id long, url string, host string, tree binary"), "page-trees", compression="zstd")
    same = F.xxhash64("tree").alias("same")
    order = F.struct(F.xxhash64("tree"), "page_id")
    seeds = written(spark, trees.groupBy("host").agg(F.min_by("tree", order).alias("pattern"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES).drop("pages"), "page-patterns")

    def count(batches):
        for batch in batches:
            out: dict[tuple, list] = {}
            for h, tree, copies, pattern in zip(*(c.to_pylist() for c in batch.columns)):
                for place, text, chars, new in place_texts(tree, pattern):
                    # summed within the batch, so that few rows leave it
                    got = out.setdefault((h, place, text, chars), [0.0, 0.0])
                    got[0] += 1 / copies
                    got[1] += new / copies
            if out:
                hosts, nodes, texts, chars = zip(*out)
                n, pages = zip(*out.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(texts, pa.int64()), pa.array(chars, pa.int64()), pa.array(n, pa.float64()), pa.array(pages, pa.float64())],
                    names=["host", "node", "h", "chars", "n", "pages"],
                )

    copies = written(spark, trees.groupBy("host", same).count().where("count > 1").withColumnRenamed("count", "copies"), "page-copies", slim=True)
    aligned = _joined(spark, trees.select("host", "tree"), seeds).where("pattern is not null")
    small = 4 * int(str(copies._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
    aligned = aligned.withColumn("same", same).join(F.broadcast(copies) if small else copies, ["host", "same"], "left")
    aligned = aligned.select("host", "tree", F.coalesce("copies", F.lit(1)).alias("copies"), "pattern")
    counts = written(spark, aligned.mapInArrow(lean(count), "host string, node long, h long, chars long, n double, pages double"), "page-counts")
    text_hash = F.when(F.col("chars") >= 0, F.col("h"))
    places = counts.groupBy("host", "node").agg(F.sum("pages").alias("pages"), (F.min(text_hash) != F.max(text_hash)).alias("varies"))
    texts = counts.where("chars > 0").groupBy("host", "node", "h", "chars").agg(F.sum("n").alias("n")).where(F.col("n") > MIN_PAGES - 0.001)
    shared = texts.join(places, ["host", "node"])
    share = (F.col("n") + 0.001) / F.col("pages")
    shared = shared.where(F.col("n") - 1 >= SHARE * F.col("pages") - 0.001)
    shared = shared.withColumn("all", ((F.col("node") >= 0) | (F.col("node") < NTH)) & (share >= SHARE_OF_ALL))
    # pages that are all alike tell nothing about a template
    varied = places.where("varies").select("host").distinct()
    shared = shared.join(varied, "host", "left_semi").select("host", "node", "h", "chars", "all")
    # blocks with a doubtful mark, on most pages of the host: all pages have the root
    hosts = places.where("node = 0").select("host", F.col("pages").alias("of"))
    doubtful = counts.where("chars < 0").groupBy("host", "node", "h", "chars").agg(F.sum("n").alias("n")).join(hosts, "host")
    doubtful = doubtful.where(F.col("n") - 1 >= SHARE * F.col("of") - 0.001).select("host", "node", "h", "chars", F.lit(False).alias("all"))
    rule = shared.unionByName(doubtful).groupBy("host").agg(F.collect_list(F.struct("node", "h", "chars", "all")).alias("rule"))
    rule = written(spark, seeds.join(rule, "host", "left").select("host", "pattern", "rule"), "page-wrappers")

    def text(batches):
        for batch in batches:
            known: dict[bytes, dict] = {}
            out = []
            rules = batch.column(4)
            for i, (tree, pattern) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if pattern is not None and pattern not in known:
                    known[pattern] = {(x["node"], x["h"]): (x["chars"], x["all"]) for x in rules[i].as_py() or ()}
                out.append(extract(tree, pattern, known.get(pattern, {})))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    final = _joined(spark, trees, rule).select("page_id", "url", "tree", "pattern", "rule")
    return final.mapInArrow(lean(text), "page_id long, url string, text string, n_chars long")
