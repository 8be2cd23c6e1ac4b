import random

import pytest

from factloom.llm import html_pages as h
from tests.llm import cases

PAGES = "page_id long, url string, html string"


def text(page, wrapper=None):
    return h.main_text(page, wrapper)


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Cookies!</div>
    <article><h1>Title &amp; more</h1><p><b>First   line<br>
    goes on<p>Second &lt;b&gt; para<div class="ad">Buy</div><ul><li>one<li>two</ul><form><p>mail</form>
    <aside>side</aside><section class="comments"><article><p>reader</p></article></section><p hidden>gone</p><p>Last</article>
    <div id="sidebar"><p>Side</p></div><footer>&copy; foot</footer></body></html>"""
    assert text(page) == "Title & more\nFirst line goes on\nSecond <b> para\none\ntwo\nLast"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>a &#233;&nbsp;b &bogus; &#x41;</p>", "a é b &bogus; A"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<article></article><p>body</p>", "body"), ("<p>x</b></i></p>y</div>z", "x\nyz"),
    ("<article><p>1</p></article><article><p>2</p></article>", "1\n2"), ("<script>never closed <p>x", ""), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<nav>only a menu</nav>", ""), ("<p>cut off <b", "cut off <b"),
])
def test_odd_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize("name", ["content-with-sidebar", "has-sidebar", "no-ads", "article-header", "post-tags", "search-result", "legal-text", "hasSidebar"])
def test_names_that_only_mention_an_aside_keep_their_text(name):
    assert text(f"<div class='{name}'><p>story</p></div><div class='wide cookie-notice'>c</div><div id=sidebar>s</div>") == "story"


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><svg width=1 /><p>b</p><svg><text>no</text></svg><p>c</p>", "a\nb\nc"), ("<p>a<math/>b</p><p>c</p>", "ab\nc"),
    ("<p>a</p><object data='x' /><p>b</p>", "a\nb"), ("<p>a</p><svg><p>b</p>", "a\nb"), ("<p>a</p><object>no</object><p>b</p>", "a\nb"),
])
def test_foreign_elements_swallow_no_text(page, want):
    assert text(page) == want


@pytest.mark.parametrize("name", ["related-posts", "site-header", "comment-list", "comments-area", "user-comment", "ad-container", "widget-area",
                                  "article-comments", "newsletter-box", "main-sidebar", "post-navigation", "relatedPosts", "social-share"])
def test_names_of_asides_hide_their_text(spark, name):
    assert text(f"<div class='{name}'><p>other</p></div><p>story</p>") == "story"
    rows = [(n, "http://a.example", f"<body><div class='{name}'><p>other {n}</p></div><div class=s><p>story {n}</p></div></body>") for n in range(12)]
    wrapper = h.Wrapper(h.folded(h.parse(rows[0][2])))
    for row in rows[1:]:
        wrapper = wrapper.add(h.Wrapper(h.folded(h.parse(row[2]))))
    assert [text(r[2], wrapper.decided()) for r in rows] == [f"story {n}" for n in range(12)]


def induced(pages):
    wrapper = h.Wrapper(h.folded(h.parse(pages[0])))
    for page in pages[1:]:
        wrapper = wrapper.add(h.Wrapper(h.folded(h.parse(page))))
    return wrapper


def test_header_of_the_page_is_no_article():
    pages = [f"<header><p>Updated at {n} o'clock, {50 + n} users</p></header><div class=s><p>story {n}</p></div>" for n in range(12)]
    wrapper = induced(pages).decided()
    assert [text(p, wrapper) for p in pages] == [f"story {n}" for n in range(12)]
    assert text("<header>My Site log in</header><p>story</p>") == "story"
    assert text("<header>site</header><article><header><h1>Title</h1></header><p>story</p></article>") == "Title\nstory"
    assert text("<main><header><h1>Title</h1></header><p>story</p></main>") == "Title\nstory"
    assert text("<section><header><h1>Title</h1></header><p>story</p></section>") == "Title\nstory"


def test_classes_of_the_body_keep_pages_aligned():
    slugs = ["about", "contact", "news", "team", "jobs", "prices", "help", "blog"]
    pages = [f"<html class='js-{s}'><body class='page-{s}'><div class=top>Home Products</div><main id='m-{s}'><p>all about {s}</p></main><div class=end>Call us</div></body></html>" for s in slugs]
    wrapper = induced(pages).decided()
    assert [text(p, wrapper) for p in pages] == [f"all about {s}" for s in slugs]


def slug(n):
    return "".join("abcdefghij"[int(c)] for c in f"{n:06d}")


def test_wrappers_stay_small_however_many_names_there_are():
    pages = 100_000
    page = lambda n: h.Wrapper(h.folded(h.parse(
        f"<body><div class=top>Home</div><div id='{slug(n)}'><h2 id='x{slug(n)}'>t {n}</h2><p>story {n}</p></div><div class=end>Call us</div></body>")))
    wrapper, largest = None, 0
    for start in range(0, pages, 20):  # partial wrappers first, as tasks make them
        part = page(start)
        for n in range(start + 1, start + 20):
            part = part.add(page(n))
        wrapper = part if wrapper is None else wrapper.add(part)
        largest = max(largest, len(h.flat(wrapper.tree)))
    assert wrapper.tree[1] == pages and largest < 2 * h.NODES
    assert len(h.flat(wrapper.decided().tree)) < 10
    told = text("<body><div class=top>Home</div><div id=new><h2>title</h2><p>story</p></div><div class=end>Call us</div></body>", wrapper.decided())
    assert told == "title\nstory"


def test_slots_that_come_up_late_are_counted(monkeypatch):
    monkeypatch.setattr(h, "NODES", 8)
    pages = [f"<body><div id='{slug(n)}'>story {n}</div>{'<div class=end>Call us</div>' if n >= 200 else ''}</body>" for n in range(400)]
    wrapper = induced(pages).decided()
    assert {text(p, wrapper) for p in pages} == {f"story {n}" for n in range(400)}


def test_many_elements_of_different_classes():
    page = "<body>" + "".join(f"<div class='{slug(n)}'>part {n}</div>" for n in range(8_000)) + "</body>"
    wrapper = induced([page, page.replace("part 5<", "part five<"), page.replace("part 7<", "part seven<"), page.replace("part 9<", "part nine<")]).decided()
    assert text(page, wrapper) == "part 5\npart 7\npart 9"


def random_tree(rng, depth):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return [rng.choice("abc"), 1, 0, True, kids]


def brute_matching(a, b):
    """Largest order-preserving matching of two trees, roots matched, by trying every way."""
    if a[0] != b[0]:
        return 0

    def rest(i, j):
        if i == len(a[4]) or j == len(b[4]):
            return 0
        both = brute_matching(a[4][i], b[4][j])
        return max(rest(i + 1, j), rest(i, j + 1), both + rest(i + 1, j + 1))

    return 1 + rest(0, 0)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng, 3), random_tree(rng, 3)
    score, pairs = h.alignment(a, b)
    assert score == brute_matching(a, b)
    assert pairs == sorted(pairs) and all(a[4][i][0] == b[4][j][0] for i, j in pairs)
    if a[0] == b[0]:
        size = lambda t: 1 + sum(map(size, t[4]))
        assert size(h.merged(a, b)) == size(a) + size(b) - score


@pytest.mark.parametrize("start,end", [("<div>", "</div>"), ("<font>", ""), ("<a name=x>", "")])
def test_deep_pages(spark, start, end):
    rows = [(n, "http://a.example", "<p>top</p>" + start * 5_000 + f"text {n}" + end * 5_000) for n in range(4)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, PAGES).repartition(2)).collect()}
    assert [got[n].split("\n")[-1] for n in range(4)] == [f"text {n}" for n in range(4)]


def site(n, body):
    return f"<html><body><div>My site</div><div class=x>{body}</div><p>Call us</p><p class=y>Number {n}</p></body></html>"


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = [(n, f"http://a.example/{n}", site(n, f"<p>text {n}</p><p>same</p>")) for n in range(6)]
    rows += [(10 + n, "https://B.example:80/x", site(0, "<p>all</p><p>same</p>")) for n in range(6)]
    rows += [(20, "http://c.example/1", site(1, "one page")), (21, None, site(1, "no host")), (22, "no url", None), (23, "http://d.example", "")]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    for n in range(6):
        assert got[n] == f"text {n}\nsame\nNumber {n}"
        assert got[10 + n] == "My site\nall\nsame\nCall us\nNumber 0"  # one page, however often, shows no template
    assert got[20] == "My site\none page\nCall us\nNumber 1" and got[22] == got[23] == ""


def test_template_of_nearly_all_pages(spark):
    rows = [(n, "http://a.example", site(n, f"<p>text {n}</p>")) for n in range(40)]
    rows += [(40, "http://a.example", "<html><body><h2>Error</h2></body></html>"), (41, "http://a.example", site(41, "<p>text 41</p>").replace("Call us", "Write to us"))]
    rows += [(100 + n, "http://b.example", f"<html><body><ul class=menu><li>m{n}</ul><div class=ad>{n}</div><p>one story</p></body></html>") for n in range(9)]
    rows += [(200 + n, "http://c.example", f"<p>copied</p><b>{min(n, 5)}</b>") for n in range(60)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert [got[n] for n in range(40)] == [f"text {n}\nNumber {n}" for n in range(40)]
    assert got[40] == "Error" and got[41] == "text 41\nWrite to us\nNumber 41"
    assert {got[100 + n] for n in range(9)} == {"one story"}  # adverts and menus make no other page
    assert [got[200 + n] for n in range(60)] == [str(min(n, 5)) for n in range(60)]  # copies count once


def test_story_beside_teaser_articles_and_without_tags(spark):
    def page(n):
        teasers = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(3))
        return f"<html><body><div>My site</div><div class=story><p>{f'story {n} ' * 20}</p></div><div class=more>{teasers}</div><p class=y>Call us</p></body></html>"

    rows = [(n, "http://a.example", page(n)) for n in range(8)] + [(10, "http://b.example", page(10))]
    rows += [(20 + n, "http://c.example", f"<div class=top>Site</div><div class=x>story {n}</div><main>Read more</main><p>Bye</p>") for n in range(8)]
    rows += [(30 + n, "http://d.example", f"<div>Site</div><article><h1>Title {n}</h1><p>story</p></article><div class=x>end of story {n}</div>") for n in range(8)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert [got[n] for n in range(8)] == [f"story {n} " * 19 + f"story {n}" for n in range(8)]
    assert "story 10 story 10" in got[10]  # a host of one page
    assert [got[20 + n] for n in range(8)] == [f"story {n}" for n in range(8)]
    assert [got[30 + n] for n in range(8)] == [f"Title {n}\nend of story {n}" for n in range(8)]


def test_bounded_texts_find_the_frequent_one():
    rng = random.Random(1)
    pages = [["p", 1, [[7 if n % 20 else n + 100, 1]], 0, []] for n in range(2_000)]
    rng.shuffle(pages)
    whole = pages[0]
    for page in pages[1:]:
        whole = h.merged(whole, page)
    assert whole[1] == 2_000 and len(whole[2]) <= h.TEXTS and h.Wrapper(whole).template_of(whole) == 7
    other = ["p", 1, [[1, 1]], 0, []]
    for n in range(2, 500):
        other = h.merged(other, ["p", 1, [[n, 1]], 0, []])
    assert h.Wrapper(other).template_of(other) is None


def test_article_of_given_pages_equals_a_plain_cut(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in h.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page["html"], re.S)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner[1])]
        want = "\n".join(b for b in blocks if b)
        assert re.sub(r" +", " ", got[page["page_id"]]["text"]) == want
        assert got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])


def test_empty_clashing_and_repeated_rows(spark):
    assert h.extract_pages(cases.empty(spark, PAGES)).collect() == []
    rows = [(1, "http://a.example", "<p>x</p>", "h", "w")] * 2
    got = h.extract_pages(spark.createDataFrame(rows, f"{PAGES}, host string, wrapper string")).collect()
    assert [r["text"] for r in got] == ["x", "x"]
    assert h.extract_pages(spark.createDataFrame([(None, None, None)], PAGES)).collect()[0]["text"] == ""
