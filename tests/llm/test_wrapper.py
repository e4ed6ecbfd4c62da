"""Extraction: tree matching against brute force, marks, depth and width."""

import random
import time

import pytest


def extracted(spark, pages):
    from quillmine.llm.wrapper import extract_pages

    rows = [(i, url, page, "x", 1) for i, (url, page) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in extract_pages(spark, frame).collect()}
    return [got[i] for i in range(len(rows))]


def random_tree(rng, depth):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []
    return (rng.choice("ab"), rng.choice(("", "x", "x y")), 0, kids, [0])


def brute(a, b):
    if a[0] != b[0] or a[1] != b[1] and not set(a[1].split()) & set(b[1].split()):
        return 0
    m = [[0] * (len(b[3]) + 1) for _ in range(len(a[3]) + 1)]
    for i, x in enumerate(a[3]):
        for j, y in enumerate(b[3]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(x, y))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("few, cells", [(0, 1 << 18), (400, 1 << 18), (0, 4)])
def test_tree_matching_against_brute_force(monkeypatch, few, cells):
    from quillmine.llm import wrapper

    monkeypatch.setattr(wrapper, "FEW_CELLS", few)
    monkeypatch.setattr(wrapper, "CELLS", cells)
    rng = random.Random(5)
    for _ in range(400):
        a, b = (("r", "", 0, random_tree(rng, 3)[3] + random_tree(rng, 3)[3], [0]) for _ in range(2))
        matching = wrapper.Matching()
        pairs = matching.aligned(a, b)
        assert len(pairs) == brute(a, b) == matching.score(matching.learn(a)[id(a)], matching.learn(b)[id(b)])
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_trees_of_any_depth_and_width():
    from quillmine.llm.html_dom import packed, parse, unpacked
    from quillmine.llm.wrapper import Matching

    deep = parse("<div>" * 20000 + "<p>one</p><nav>menu</nav><p>two</p>")
    assert packed(unpacked(packed(deep))) == packed(deep)
    began = time.monotonic()
    assert len(Matching().aligned(deep, parse("<div>" * 19000 + "<p>one</p>"))) >= 19000
    rng = random.Random(2)
    wide = [parse("<table>" + "".join(f"<tr><td>{i}<td>{'<ul><li>' * rng.randrange(1, 4)}x" for i in range(10_000)) + "</table>") for _ in range(2)]
    assert len(Matching().aligned(*wide)) > 20_000
    tags = [parse("<b>" * 50_000 + "x" + "</i>" * 50_000 + "</b>" * 50_000), parse("<p>" + "<blockquote>" * 20_000 + "y" + "<li>" * 20_000)]
    assert len(tags) == 2 and time.monotonic() - began < 20


def test_blocks_under_many_others(spark):
    page = "<div>" * 600 + "<p>one</p><nav>MENU</nav><p>two</p>"
    assert extracted(spark, [("http://a.example/", page)]) == ["one\ntwo"]


PARTS = (
    '<section id="discussion"><p>What we make of it {i}</p></section><p class="social-history">Of the town {i}</p><div class="related work">Others did this {i}</div>'
    '<section class="search-methods">How we looked {i}</section><p>Then <math><mi>x</mi><mo>+</mo><mn>{i}</mn><annotation>x+{i}</annotation></math> holds</p>'
)
KEPT = "What we make of it {i}\nOf the town {i}\nOthers did this {i}\nHow we looked {i}\nThen x+{i} holds"
AWAY = '<div class="comments"><p>Reader {i} says</p></div><div class="ad-slot">Buy {i}</div><aside>Beside {i}</aside><div class="related"><a href=/1>More {i}</a> <a href=/2>And {i}</a></div>'


@pytest.mark.parametrize("pages", [1, 3, 12])
def test_names_of_parts_of_an_article(spark, pages):
    page = "<nav>menu</nav><article><h1>T{i}</h1><p>Body {i} and so on</p>" + PARTS + AWAY + "</article><footer>foot</footer>"
    got = extracted(spark, [(f"http://a.example/{i}", page.format(i=i)) for i in range(pages)])
    assert got == [f"T{i}\nBody {i} and so on\n" + KEPT.format(i=i) for i in range(pages)]


def test_doubtful_names_without_article_elements(spark):
    page = "<div><div><h2>Head {i}</h2><p>First text {i} of this page</p>{own}<p>Second text {i} of it</p><div class=notice>Note {i} for you</div></div></div>"
    own = '<div id="discussion">Only here {i}</div>'
    got = extracted(spark, [(f"http://a.example/{i}", page.format(i=i, own=own.format(i=i) if i == 4 else "")) for i in range(12)])
    assert got[3] == "Head 3\nFirst text 3 of this page\nSecond text 3 of it"
    assert got[4] == "Head 4\nFirst text 4 of this page\nOnly here 4\nSecond text 4 of it"


def test_main_around_an_article(spark):
    page = "<main><nav>a</nav><div><h1>Title {i}</h1><ul><li>list</ul><article><p>Body {i}</p></article></div><p>After {i}</p></main>"
    assert extracted(spark, [("http://a.example/", page.format(i=1))]) == ["Title 1\nBody 1\nAfter 1"]


def test_equal_ids_and_awkward_pages(spark):
    from quillmine.llm.wrapper import extract_pages

    rows = [(7, "http://a.example/1", "<article><p>one"), (7, "http://a.example/2", "<article><p>two"), (None, None, None), (8, "", ""), (8, "x", "<p>" + "word " * 200_000)]
    got = extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 3, 3, 999_999] and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


INSIDE = (
    '<p title="hidden gems">First {i} paragraph</p><p>In <a title="the hidden valley">valley</a> {i}</p><p data-id="menu">Data {i}</p><p data-hidden="0" data-role="search">Zero {i}</p>'
    '<p aria-label="hidden">Label {i}</p><p>See <a class="ad">x</a> here {i}</p><p>x <span hidden>tip</span> y{i}</p><div class="menu">Soup {i}</div><section id="login">Log {i}</section>'
    '<p class="banner">Red {i}</p><p class="skip">Rope {i}</p><h2 class="share-post-title">Sharing {i}</h2><p hidden>gone {i}</p><p aria-hidden="true">gone {i}</p><p aria-hidden="false">Kept {i}</p>'
)
INSIDE_TEXT = "First {i} paragraph\nIn valley {i}\nData {i}\nZero {i}\nLabel {i}\nSee here {i}\nx y{i}\nSoup {i}\nLog {i}\nRed {i}\nRope {i}\nSharing {i}\nKept {i}"


@pytest.mark.parametrize("pages", [1, 3, 12])
def test_attributes_and_names_inside_an_article(spark, pages):
    page = "<div class=menu><a href=/>Home</a></div><article><h1>T{i}</h1>" + INSIDE + "</article><div class=footer>foot</div>"
    got = extracted(spark, [(f"http://a.example/{i}", page.format(i=i)) for i in range(pages)])
    assert got == [f"T{i}\n" + INSIDE_TEXT.format(i=i) for i in range(pages)]


@pytest.mark.parametrize(
    "piece, n, after",
    [("<a ", 1_700_000, ""), ("if a <b then ", 400_000, ""), ("<a href='x ", 450_000, ""), ("<select>", 400_000, ""), ("<a '>' \"", 300_000, ""), ("<a b='>' ", 300_000, '"'), ("<!-- x ", 500_000, ""), ("<p ", 900_000, ">"),
     ("<a title=\"x>", 300_000, ""), ("<button>x", 300_000, "")],
)
def test_what_stays_open_takes_linear_time(piece, n, after):
    from quillmine.llm.html_dom import parse

    began = time.monotonic()
    parse(piece * n + after)
    assert time.monotonic() - began < 30


def test_open_marks_are_text():
    from quillmine.llm.html_dom import parse

    assert parse("if a <b then c")[3] == ["if a <b then c"] and parse("1 < 2 <p>x</p> <i")[3] == ["1 < 2 ", ("p", "", 0, ["x"], [0]), " <i"]
    assert parse("<p title='a>b'>x</p>")[3] == [("p", "", 0, ["x"], [0])] and parse("<p title='a>b</p><i>c</i>")[3] == [("p", "", 0, ["b"], [0]), "c"]


def test_long_lists_are_matched_whole():
    from quillmine.llm.html_dom import parse
    from quillmine.llm.wrapper import Matching

    common = "".join(f"<p class='c{chr(97 + i % 26)} {chr(97 + i // 26)}x'>{i}</p>" for i in range(700))
    pairs = Matching().aligned(parse(f"<div>{common}</div>"), parse("<div>" + "<h2>n</h2>" * 500 + common + "</div>"))
    assert len(pairs) == 702
